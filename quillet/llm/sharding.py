"""Operator 2, contiguous shards of near equal size.

All rows stand in one global order, by the digest of their text, so equal texts are neighbours.
The order is dealt into a fixed number of buckets; each bucket's total is summed on the
executors, the totals' prefix sums give each bucket's place in the whole, and a window inside
each bucket gives each row's. Cutting the total into equal targets gives the shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import join_hot, table, written

#: Leading hexadecimal digits of the order that name a bucket. Groups too large to be kept whole
#: are dealt to 256 parts of their bucket: 4096 * 257 totals of 32 bytes at most (34 MB), whatever
#: the input, so they may meet on the driver and be broadcast.
BUCKET_DIGITS = 3


def shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """Put each row into one of ``n_shards`` shards of near equal bytes.

    Size: the text's UTF-8 bytes (null: none) plus 16. Returns doc_id, size, text_crc32, shard
    and slot (place in the shard, from 0). The order is that of the texts' MD5 digests, null
    texts being empty ones. Rows of equal text are kept in one shard as long as they are together
    no larger than the largest single row, which bounds the imbalance anyway; larger groups are
    split like single rows. A row lies in the shard that holds the middle of its group's (or its
    own) bytes. Repeated rows each count; null ids are kept and come first; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(data) + 16).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.md5(data).alias("h"),
        )
    )
    largest = rows.agg(F.max("size")).first()[0] or 0
    big = rows.groupBy("h").agg(F.sum("size").alias("group_size")).where(F.col("group_size") > largest)
    own = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10)
    deal = F.when(F.col("group_size").isNull(), 0).otherwise(1 + own.cast("int"))
    dealt = join_hot(rows, big, "h", "left").select(
        "doc_id", "size", "text_crc32", "h", F.substring("h", 1, BUCKET_DIGITS).alias("bucket"), deal.alias("part")
    )
    place = Window.partitionBy("bucket", "part")
    each = place.orderBy("h", "doc_id")
    groups = place.orderBy("h")
    before_row = F.coalesce(F.sum("size").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    up_to_group = F.sum("size").over(groups.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("size").over(groups.rangeBetween(0, 0))
    placed = written(
        dealt.select(
            "doc_id", "size", "text_crc32", "bucket", "part",
            (F.row_number().over(each) - 1).cast("long").alias("rank"),
            F.when(F.col("part") == 0, 2 * up_to_group - whole).otherwise(2 * before_row + F.col("size")).alias("twice_middle"),
        )
    )

    totals = placed.groupBy("bucket", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    totals = sorted(totals.collect(), key=lambda r: (r["bucket"], r["part"]))  # 4096 * 257 at most
    sizes = np.cumsum([0, *(r["size"] for r in totals)], dtype=np.int64).tolist()
    counts = np.cumsum([0, *(r["n"] for r in totals)], dtype=np.int64).tolist()
    bases = spark.createDataFrame(
        [(r["bucket"], r["part"], s, c) for r, s, c in zip(totals, sizes, counts)],
        "bucket string, part int, base long, base_rank long",
    )
    # whole numbers throughout: a quotient of doubles would be wrong beyond 2**53
    middle = (F.col("twice_middle") + 2 * F.col("base")).cast("decimal(30,0)") * n_shards
    cut = F.least(F.floor(F.expr("m DIV w").cast("long")), F.lit(n_shards - 1).cast("long"))
    sharded = placed.join(F.broadcast(bases), ["bucket", "part"]).withColumns({"m": middle, "w": F.lit(2 * max(1, sizes[-1])).cast("decimal(30,0)")})
    sharded = sharded.select("doc_id", "size", "text_crc32", cut.cast("int").alias("shard"), (F.col("rank") + F.col("base_rank")).alias("rank"))
    firsts = sharded.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``bytes``."""
    return shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
