"""JSON-lines scans and sinks, listings of files, and single JSON arrays.

All files are read and written by Spark's own readers and writers and Hadoop's file systems, so
they may lie in any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null fields are written, as nulls.
_WHOLE = {"ignoreNullFields": "false"}


def read(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of the files under ``path``; bad lines are left out, or fail the job if ``strict``."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)


def lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, size, ``at`` (increasing along a file) and value of each line of the files of that name under
    ``path``. A file's blocks may be read by several tasks: a line stands by its block's start, then by its turn
    in the task that reads it."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), at.alias("at"), "value")


def _is_bad(value: str):
    return F.try_parse_json(value).isNull()


def read_until_bad(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, ``at`` and the fields of ``schema``: each file's rows before its first line that is no JSON; blank lines do not
    count. The first bad line of each file is a minimum with partial minima in each task, so a large file is still
    read by many tasks."""
    full = lines(spark, path, pattern).where(F.col("value").rlike(r"\S"))
    stop = full.where(_is_bad("value")).groupBy("path").agg(F.min("at").alias("stop"))  # a row for each file that has one
    kept = full.join(stop, "path", "left").where(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return kept.select("path", "at", F.from_json("value", schema).alias("row")).select("path", "at", "row.*")


def preview(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first ``n`` lines of a file but blank ones, as they are; none of them if one is no JSON. The limit is
    met from the file's first blocks, without reading the others."""
    first = spark.read.text(path).limit(n).where(F.col("value").rlike(r"\S"))
    bad = first.agg(F.coalesce(F.bool_or(_is_bad("value")), F.lit(False)).alias("bad"))  # one row
    return first.crossJoin(F.broadcast(bad)).where("NOT bad").select("value")


def listing(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, name, format, example_count (lines that are not blank) and size_mb of the files under ``path``. The format is
    that of the first line: chat, instruction or unknown. One pass, with partial counts in each task. Empty files make
    no rows there and come from the names that Spark has listed anyway."""
    each = lines(spark, path, pattern).groupBy("path", "size").agg(F.count_if(F.col("value").rlike(r"\S")).alias("example_count"), F.min_by("value", "at").alias("first"))
    names = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).inputFiles()
    plain = lambda c: F.regexp_replace(F.url_decode(c), r"^[a-z]+:/*", "/")
    files = spark.createDataFrame([(n,) for n in names], "path string").withColumn("k", plain("path"))
    joined = files.join(each.select(plain("path").alias("k"), "size", "example_count", "first"), "k", "left")
    has = lambda name: F.coalesce(F.array_contains(F.json_object_keys("first"), name), F.lit(False))
    kind = F.when(F.try_parse_json(F.col("first")).isNull(), "unknown").when(has("messages"), "chat").when(has("instruction") & has("output"), "instruction").otherwise("unknown")
    return joined.select("path", F.element_at(F.split("k", "/"), -1).alias("name"), kind.alias("format"), F.coalesce("example_count", F.lit(0)).alias("example_count"), (F.coalesce("size", F.lit(0)) / (1024 * 1024)).alias("size_mb"))


def _objects(rows: DataFrame) -> DataFrame:
    return rows if rows.columns == ["value"] else rows.select(F.to_json(F.struct("*"), _WHOLE).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """One object a line, null fields kept as nulls."""
    _objects(rows).write.mode("overwrite").text(path)


def write_array(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One file that holds one JSON array: a row an element, in the order of ``by`` or else of the rows.

    Tasks write their parts, in which every object ends with a comma; then the parts are joined in order, as streams
    of bytes, and the last comma becomes the end of the array. No task or driver holds more than a buffer
    of it. The file appears under its name when it is whole."""
    spark = rows.sparkSession
    ordered = rows.orderBy(*by) if by else rows
    parts = f"{path}-parts-{uuid.uuid4().hex}"
    _objects(ordered).write.option("lineSep", ",\n").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    files = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    whole = hadoop.fs.Path(f"{parts}/whole")
    out = fs.create(whole, True)
    try:
        out.write(bytearray(b"[\n"))
        for k, (_, size, name) in enumerate(files):
            source = fs.open(name)
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (2 if k == len(files) - 1 else 0))
            finally:
                source.close()
        out.write(bytearray(b"\n]\n" if files else b"]\n"))
    finally:
        out.close()
    fs.delete(target, True)
    fs.rename(whole, target)
    fs.delete(folder, True)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of such a file; its objects stand on lines of their own, so it is read like JSON lines."""
    text = spark.read.text(path).where(~F.col("value").isin("[", "]", ""))
    return text.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("row")).select("row.*")
