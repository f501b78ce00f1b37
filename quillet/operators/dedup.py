"""Exact and normalised duplicates: groups, totals, and the rows that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(rows: DataFrame, key: Column, id_field: str = "doc_id") -> DataFrame:
    """Groups of two rows or more with the same key: digest, n, first_id. Null keys form none."""
    found = rows.where(key.isNotNull()).groupBy(F.md5(key.cast("binary")).alias("digest"))
    return found.agg(F.count("*").alias("n"), F.min(id_field).alias("first_id")).where("n > 1")


def totals(rows: DataFrame, key: Column) -> DataFrame:
    """total, unique, duplicates, rate (percent, two digits), n_groups and the largest group."""
    each = rows.groupBy(F.md5(F.coalesce(key, F.lit("")).cast("binary"))).agg(F.count("*").alias("n"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_rows"), F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    gone = F.col("total") - F.col("unique_rows")
    return sums.select("total", "unique_rows", gone.alias("duplicates"), F.when(F.col("total") > 0, F.round(100 * gone / F.col("total"), 2)).otherwise(0.0).alias("rate"), "n_groups", "largest")


def keep_first(rows: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """One row of each key, that of least ``order`` (nulls first; of equal ones any). A group of
    copies is reduced in each task before it is shuffled, so no key gathers its rows in one place."""
    packed = rows.select(F.md5(F.coalesce(key, F.lit("")).cast("binary")).alias("k"), F.struct("*").alias("row"), F.struct(F.col(order).isNotNull(), F.col(order)).alias("at"))
    return packed.groupBy("k").agg(F.min_by("row", "at").alias("row")).select("row.*")


def remove(rows: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """The rows that :func:`keep_first` leaves out are the duplicates: one row, how many of each."""
    kept = keep_first(rows, key, order).agg(F.count("*").alias("kept"))
    return rows.agg(F.count("*").alias("total")).join(F.broadcast(kept)).select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"))  # one row each


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; the window's limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place__", place).where("place__ = 1").drop("place__")
