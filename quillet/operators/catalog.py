"""Listings over tables of datasets, versions, templates, tasks and examples, and the choice among variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that datasets may be sorted by; the first for all others.
SORTABLE = ("created_at", "updated_at", "name", "example_count")


def datasets(rows: DataFrame, domain: str | None = None, format_: str | None = None, path: str | None = None, sort_by: str = "created_at", order: str = "DESC", limit: int = 100) -> DataFrame:
    """The datasets that match all filters given, sorted, ``limit`` at most. Unknown columns and orders fall back to the newest
    first; equal ones are in order of their id, nulls last either way. An empty filter is none."""
    for column, wanted in (("domain", domain), ("format", format_), ("file_path", path)):
        rows = rows.where(F.col(column) == wanted) if wanted else rows
    column = F.col(sort_by if sort_by in SORTABLE else SORTABLE[0])
    return rows.orderBy(column.asc_nulls_last() if order == "ASC" else column.desc_nulls_last(), "dataset_id").limit(limit)


def newest(rows: DataFrame, at: str, id_field: str, limit: int | None = None, **wanted) -> DataFrame:
    """Rows whose columns have the values ``wanted`` (null: any), the greatest ``at`` first, ties by id."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    out = rows.orderBy(F.col(at).desc_nulls_last(), id_field)
    return out.limit(limit) if limit else out


def newest_of_each(rows: DataFrame, keys: list[str], at: str, limit: int) -> DataFrame:
    """The same with a limit for each key, which each task applies before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last()))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    """Rows with the tag among their tags."""
    return rows.where(F.array_contains("tags", tag))


def all_tags(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and tag: each tag that any row of the key has, once."""
    return rows.select(*keys, F.explode("tags").alias("tag")).where("tag IS NOT NULL").distinct()


def tasks(generation: DataFrame, quality: DataFrame) -> DataFrame:
    """id, type, status, progress (0 to 1, 0 if nothing is asked for), progress_details, created_at and updated_at of the jobs
    of both kinds. Jobs have job_id, status, done, total, started_at and completed_at; those not completed
    were last changed when they started."""

    def of(jobs: DataFrame, kind: str) -> DataFrame:
        share = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0)
        details = F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" examples"))
        return jobs.select(F.col("job_id").alias("id"), F.lit(kind).alias("type"), "status", share.alias("progress"), details.alias("progress_details"), F.col("started_at").alias("created_at"), F.coalesce("completed_at", "started_at").alias("updated_at"))

    return of(generation, "generator").unionByName(of(quality, "quality"))


def with_paths(examples: DataFrame, sets: DataFrame) -> DataFrame:
    """Examples with the file_path of their dataset; those whose dataset is unknown go. Adaptive execution splits a
    dataset with very many examples, as ids of datasets are unique."""
    return examples.join(sets.select("dataset_id", "file_path"), "dataset_id")


def with_versions(templates: DataFrame, versions: DataFrame) -> DataFrame:
    """Each template with its versions, the newest first as ``place`` 1; templates without any have one row of nulls."""
    place = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("version")))
    return templates.join(versions.withColumn("place", place), "template_id", "left")


def basic_stats(rows: DataFrame) -> DataFrame:
    """One row: rows, and the names of the fields that the rows have, in the table's order and joined by commas."""
    n = F.count("*")
    return rows.agg(n.alias("total_examples"), F.when(n > 0, F.lit(",".join(rows.columns))).otherwise("").alias("fields"))


def updated(base: Column, change: Column) -> Column:
    """Two maps as one, the second's values winning; a null map is empty."""
    kind = lambda m: F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))
    old = F.filter(kind(base), lambda e: ~F.coalesce(F.map_contains_key(change, e["key"]), F.lit(False)))
    return F.map_from_entries(F.concat(old, kind(change)))


def gate(rows: DataFrame, score: str, threshold: float = 0.7) -> DataFrame:
    """Rows with the score at least; a missing score is 0."""
    return rows.where(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)


def best_variants(variants: DataFrame, example: str, order: str, choice: str) -> DataFrame:
    """One variant of each example: the one whose place (from 0, in ``order``) the judge's ``choice`` names, moved into the range
    there is; without a choice, the first. ``choice`` is a column of the variants, of which the example's first counts.

    Places come from a window over the example's variants; of them one row stays, so what is kept is small."""
    by_order = Window.partitionBy(example).orderBy(order)
    whole = Window.partitionBy(example)
    placed = variants.withColumns({"place__": F.row_number().over(by_order) - 1, "n__": F.count("*").over(whole), "choice__": F.first(choice).over(by_order)})
    wanted = F.greatest(F.lit(0), F.least(F.coalesce("choice__", F.lit(0)), F.col("n__") - 1))
    return placed.where(F.col("place__") == wanted).drop("place__", "choice__").withColumnRenamed("n__", "n_variants")


def top_candidates(rows: DataFrame, score: str, order: str, target: int) -> DataFrame:
    """The 2 * ``target`` rows of greatest score (missing: 0), ties in order, with their ``place`` (from 0); ``chosen`` says which
    ``target`` of them stay if no one judges them."""
    ranked = rows.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), order).limit(2 * target)
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), order)) - 1  # of 2 * target rows
    return ranked.withColumn("place", place).withColumn("chosen", F.col("place") < target)


def displayed(messages: Column, instruction: Column, output: Column, content: Column) -> Column:
    """What a viewer shows of an example, as JSON: a chat, an instruction with its output, or the content as it is. Null roles,
    contents and texts are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    turns = F.transform(messages, lambda m: F.struct(text(m["role"]).alias("role"), text(m["content"]).alias("content")))
    chat = F.to_json(F.struct(F.lit("chat").alias("type"), turns.alias("messages")))
    task = F.to_json(F.struct(F.lit("instruction").alias("type"), text(instruction).alias("instruction"), text(output).alias("output")))
    other = F.to_json(F.struct(F.lit("unknown").alias("type"), text(content).alias("content")))
    return F.when(messages.isNotNull(), chat).when(instruction.isNotNull() & output.isNotNull(), task).otherwise(other)
