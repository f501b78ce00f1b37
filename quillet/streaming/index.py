"""Near-duplicates against an index that grows: each row is looked up before it is added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators import similar
from quillet.sources import shared

_KEY = ["band", "hash"]


class BandIndex:
    """MinHash bands of all rows so far, in a folder of Parquet files by batch number.

    A band's hash is written once, by the first batch that has it, with the least id of that batch;
    so the index has a row for each distinct hash and no key of it is hot. A batch looks at batches
    of smaller numbers only and replaces what it wrote itself, so a batch that is run again, after
    a failure or by mistake, changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, id_field: str = "doc_id", text: str = "text", bands: int = 9, per_band: int = 13) -> None:
        self.spark, self.folder, self.id_field, self.text, self.shape = spark, folder, id_field, text, (bands, per_band)
        self.numbers: set[int] = set()

    def _part(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/n={number}"

    def _read(self, kind: str, schema: str, numbers: list[int]) -> DataFrame:
        none = self.spark.createDataFrame([], schema)
        paths = [self._part(kind, n) for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else none

    def add(self, batch: DataFrame, number: int) -> None:
        """Look up the rows of a batch, in order of id, and add them. Rows find the earliest row (by batch,
        then id) with which they share a band."""
        kind = batch.schema[self.id_field].dataType.simpleString()
        each = shared.cut(similar.band_rows(batch, self.text, self.id_field, *self.shape).withColumnRenamed(self.id_field, "id"))
        known = self._read("bands", f"band int, hash long, batch int, first {kind}", sorted(n for n in self.numbers if n < number))
        own = each.groupBy(*_KEY).agg(F.lit(number).alias("batch"), F.min("id").alias("first"))
        own.join(known, _KEY, "left_anti").write.mode("overwrite").parquet(self._part("bands", number))
        self.numbers.add(number)
        earliest = self._read("bands", f"band int, hash long, batch int, first {kind}", sorted(n for n in self.numbers if n <= number))
        met = each.join(earliest, _KEY).where((F.col("batch") < number) | (F.col("first") < F.col("id")))
        found = met.groupBy("id").agg(F.min(F.struct("batch", "first")).alias("x"))
        found.select(F.col("id").alias(self.id_field), F.col("x.first").alias("first")).write.mode("overwrite").parquet(self._part("found", number))
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(self._part("sizes", number))

    def found(self) -> DataFrame:
        """id and first, of all rows that met an earlier one."""
        kind = self.spark.read.parquet(self._part("found", min(self.numbers))).schema[self.id_field].dataType.simpleString() if self.numbers else "long"
        return self._read("found", f"{self.id_field} {kind}, first {kind}", sorted(self.numbers))

    def progress(self) -> DataFrame:
        """batch, n (rows), n_found and percent: the state after each batch."""
        out = self.spark.createDataFrame([], "batch int, n long, n_found long")
        for number in sorted(self.numbers):
            n = self.spark.read.parquet(self._part("sizes", number))
            found = self.spark.read.parquet(self._part("found", number)).agg(F.count("*").alias("n_found"))
            out = out.unionByName(n.crossJoin(F.broadcast(found)).select(F.lit(number).alias("batch"), "n", "n_found"))  # one row each
        return out.withColumn("percent", F.round(F.when(F.col("n") > 0, 100 * F.col("n_found") / F.col("n")).otherwise(0.0), 2))


def grow(rows: DataFrame, folder: str | None = None, **options) -> BandIndex:
    """Run a stream of rows through an index, a micro-batch at a time, over all that its source has now. Without a
    ``folder`` the index starts empty in the shared folder."""
    spark = rows.sparkSession
    index = BandIndex(spark, folder or shared.folder(spark, "bands"), **options)
    stream = rows.writeStream.option("checkpointLocation", f"{index.folder}/progress").trigger(availableNow=True)
    stream.foreachBatch(index.add).start().awaitTermination()
    return index
