"""Formats for training and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Roles of a question and of its answer.
_ASKING, _ANSWERING = ("user", "human"), ("assistant", "bot", "ai")


def qa_pairs(turns: DataFrame) -> DataFrame:
    """Each conversation's first user turn with a text, and the first assistant turn with one after it."""
    said = turns.where("text <> ''")
    user = said.where(F.col("role").isin(*_ASKING)).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("q"))
    later = said.where(F.col("role").isin(*_ANSWERING)).join(user, "conv_id").where("turn > q.turn")
    return later.groupBy("conv_id").agg(F.first("q.text").alias("question"), F.min_by("text", "turn").alias("answer"))


def messages(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as an array of role and content, in order of turn."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Texts longer than ``size`` in pieces that overlap; shorter ones whole. chunk counts from 0."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    text = F.coalesce("text", F.lit(""))
    starts = F.when(F.length(text) > size, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    each = docs.select("doc_id", text.alias("text"), F.size(starts).cast("long").alias("n_chunks"), F.posexplode(starts).alias("chunk", "at"))
    return each.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "n_chunks", F.substring("text", F.col("at") + 1, F.lit(size)).alias("piece"))
