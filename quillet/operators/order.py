"""Ordinals of a whole table and what follows from them: pages, splits, slices, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.sources import shared

#: Rows that one task may sort and number.
_FEW = 100_000


def ordinals(rows: DataFrame, key: str) -> DataFrame:
    """``idx`` from 0 in order of a key (null keys first; equal ones in any order).

    Rows are dealt into ranges of the key and written with their range's number, so that it
    stands; each range counts its own rows, and the ranges' running sums, a row for each
    partition whatever the table's size, give each its start."""
    dealt = shared.cut(rows.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("range__", F.spark_partition_id()))
    counts = dealt.groupBy("range__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("range__", F.coalesce(before, F.lit(0)).alias("start__"))
    place = F.row_number().over(Window.partitionBy("range__").orderBy(F.col(key).asc_nulls_first())) - 1
    numbered = dealt.withColumn("place__", place).join(F.broadcast(starts), "range__")  # a row for each partition
    return numbered.withColumn("idx", F.col("start__") + F.col("place__")).drop("range__", "place__", "start__")


def page(rows: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """``size`` rows from the ``offset``-th on, with ``idx``; no more than the first
    ``offset + size`` rows of each task are looked at."""
    part = rows.orderBy(F.col(key).asc_nulls_first()).offset(offset).limit(size)
    return part.withColumn("idx", (F.row_number().over(Window.orderBy(F.col(key).asc_nulls_first())) + offset - 1).cast("long"))  # of ``size`` rows


def prefix_split(rows: DataFrame, key: str, ratio: float = 0.8) -> DataFrame:
    """``split``: train for the first floor(n * ratio) rows, validation for the others."""
    n = rows.agg(F.floor(F.count("*") * F.lit(ratio)).alias("cut__"))  # one row
    return ordinals(rows, key).join(F.broadcast(n)).withColumn("split", F.when(F.col("idx") < F.col("cut__"), "train").otherwise("validation")).drop("cut__")


def round_robin(rows: DataFrame, key: str, workers: int) -> DataFrame:
    """``worker`` from 0, dealt in turn."""
    return ordinals(rows, key).withColumn("worker", F.pmod("idx", F.lit(workers)))


def budget(rows: DataFrame, key: str, count: int, factor: float, cap: int) -> DataFrame:
    """The rows that a budget of min(int(count * factor), cap) calls reaches. Up to ``_FEW`` each task keeps
    no more rows than that; larger budgets number the table."""
    n = max(0, min(int(count * factor), cap))
    return page(rows, key, 0, n) if n <= _FEW else ordinals(rows, key).where(F.col("idx") < n)


def sample(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows, or all if there are fewer, drawn by a seeded hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(size)


def pairs(rows: DataFrame, key: str) -> DataFrame:
    """``pair`` from 0: rows taken two by two in order; an odd last one stands alone."""
    return ordinals(rows, key).withColumn("pair", F.floor(F.col("idx") / 2))
