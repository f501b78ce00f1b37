"""Differences, patches and merges of two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: of several that of greatest ``order``, or else the greatest row. Null keys
    are keys of their own, told apart by the row."""
    fields = F.struct(*(c for c in rows.columns if c != key))
    own = F.when(F.col(key).isNull(), F.md5(F.to_json(F.struct("*")).cast("binary")))
    packed = rows.select(F.col(key).alias("key"), own.alias("own"), fields.alias("row"), (F.col(order) if order else fields).alias("at"))
    one = packed.groupBy("key", "own").agg(F.max(F.struct("at", "row")).alias("last"))
    return one.select(F.col("key").alias(key), "own", F.col("last.row").alias("row"))


def _both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = (last_wins(df, key).select(F.col(key).alias(f"{n}_key"), F.coalesce("own", F.lit("")).alias(f"{n}_own"), F.col("row").alias(n)) for df, n in ((a, "one"), (b, "two")))
    same = F.col("one_key").eqNullSafe(F.col("two_key")) & (F.col("one_own") == F.col("two_own"))
    return left.join(right, same, "full_outer").select(F.coalesce("one_key", "two_key").alias(key), "one", "two")


def _conflict() -> Column:
    return F.col("one").isNotNull() & F.col("two").isNotNull() & ~F.col("one").eqNullSafe(F.col("two"))


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change (added, removed, modified, unchanged) of each key. Of repeated keys in one
    version the last row counts; rows without a key are told apart by their content."""
    change = F.when(F.col("one").isNull(), "added").when(F.col("two").isNull(), "removed").when(_conflict(), "modified").otherwise("unchanged")
    return _both(before, after, key).select(key, change.alias("change"))


def merge(one: DataFrame, two: DataFrame, key: str, strategy: str = "union") -> DataFrame:
    """Rows of both versions and ``conflict``. Strategies: union and prefer1 keep the first
    version's row of a conflict, prefer2 the second's, intersection only keys of both."""
    sides = {"union": ("one", "two"), "prefer1": ("one", "two"), "prefer2": ("two", "one"), "intersection": ("one", "two")}
    if strategy not in sides:
        raise ValueError(f"unknown strategy {strategy!r}")
    both = _both(one, two, key)
    if strategy == "intersection":
        both = both.where("one IS NOT NULL AND two IS NOT NULL")
    row = F.coalesce(*sides[strategy])
    return both.select(key, row.alias("row__"), _conflict().alias("conflict")).select(key, "row__.*", "conflict")


def apply_patch(rows: DataFrame, key: str, removed: DataFrame, modified: DataFrame, added: DataFrame) -> DataFrame:
    """Removals, then modifications, then additions."""
    left = rows.join(removed.select(key), key, "left_anti")
    kept = left.join(modified.select(key), key, "left_anti")
    changed = modified.join(left.select(key), key, "left_semi")
    return reduce(DataFrame.unionByName, (kept, changed, added))


def diff_summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row of counts: rows before and after, keys added, removed, modified and unchanged, net change."""
    kinds = diff(before, after, key).agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "modified", "unchanged")))
    sizes = [df.agg(F.count("*").alias(n)) for df, n in ((before, "total_before"), (after, "total_after"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), sizes, kinds).withColumn("net_change", F.col("total_after") - F.col("total_before"))  # one row each


def _by_content(one: DataFrame, two: DataFrame, text: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    sides = [df.groupBy(digest.alias("digest")).agg(F.max(F.struct(*df.columns)).alias(n)) for df, n in ((one, "one"), (two, "two"))]
    return sides[0].join(sides[1], "digest", "full_outer")


def merge_by_content(one: DataFrame, two: DataFrame, text: str = "text") -> DataFrame:
    """Rows of both versions, one for each text: the first version's, and of several the greatest row."""
    return _by_content(one, two, text).select(F.coalesce("one", "two").alias("row")).select("row.*")


def content_counts(one: DataFrame, two: DataFrame, text: str = "text") -> DataFrame:
    """One row: distinct texts in all, of one version only, and of both."""
    a, b = F.col("one").isNotNull(), F.col("two").isNotNull()
    return _by_content(one, two, text).agg(F.count("*").alias("total"), F.count_if(a & ~b).alias("only_one"), F.count_if(b & ~a).alias("only_two"), F.count_if(a & b).alias("common"))


def conflicts(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ, with both rows as structs."""
    return _both(one, two, key).where(_conflict())


def resolve(one: DataFrame, two: DataFrame, key: str, how: str = "keep_both") -> DataFrame:
    """The union of two versions with conflicts resolved: keep_both and keep_first leave the first
    version's row, keep_second takes the second's."""
    if how not in ("keep_both", "keep_first", "keep_second"):
        raise ValueError(f"unknown resolution {how!r}")
    row = F.when(_conflict() & F.lit(how == "keep_second"), F.col("two")).otherwise(F.coalesce("one", "two"))
    return _both(one, two, key).select(key, row.alias("row__")).select(key, "row__.*")


def concatenated(versions: list[DataFrame]) -> DataFrame:
    """All rows of several tables, each with its table's ordinal; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source_no", F.lit(i)) for i, df in enumerate(versions)))


def outcome(one: DataFrame, two: DataFrame, key: str, strategy: str = "union") -> DataFrame:
    """One row about a merge: n_merged, n_conflicts and success, which a union or intersection has without conflicts only and a
    preference always."""
    found = merge(one, two, key, strategy).agg(F.count("*").alias("n_merged"), F.count_if("conflict").alias("n_conflicts"))
    return found.withColumn("success", F.lit(True) if strategy.startswith("prefer") else F.col("n_conflicts") == 0)
