"""Queries over both sides of a filter, coverage, version histories, templates and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import algebra, collaboration, conversion, metrics, quality
from quillet.plans import curation, reports
from quillet.plans.examples import _EX, examples


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _events(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _messages(spark, sf_dir: str) -> DataFrame:
    """The messages of all examples, as turns."""
    said = examples(spark, sf_dir).select(F.col("id").alias("conv_id"), F.posexplode(F.coalesce("messages", "conversation")).alias("turn", "m"))
    return said.select("conv_id", "turn", "m.role", F.col("m.content").alias("text"))


def _ends(spark, sf_dir: str) -> DataFrame:
    """The first and the latest version of each dataset, compared."""
    v = reports.versions(spark, sf_dir)
    ends = v.groupBy("dataset_id").agg(F.min("version_number").alias("low"), F.max("version_number").alias("high"))
    of = lambda c: v.join(ends.select("dataset_id", F.col(c).alias("version_number")), ["dataset_id", "version_number"])
    return collaboration.versions_compared(of("low"), of("high"))


def _filled(spark, sf_dir: str) -> DataFrame:
    """A template of both kinds with values of documents; every fifth has no source."""
    values = {"lang": F.col("lang"), "source": F.when(F.col("doc_id") % 5 != 0, F.col("source")), "n": F.col("n_chars")}
    full = T.filled(F.concat(F.lit("{{lang}} of {{source}} {{n}} {{other}} "), "source"), values, {"source": "nowhere"})
    plain = T.filled(F.lit("{lang} of {source}, {lang}"), values, marks=("{", "}"))
    lacking = T.missing(values, {"lang": "en"}, ["lang", "source", "n", "user"])
    return _docs(spark, sf_dir).select("doc_id", full.alias("filled"), plain.alias("plain"), F.array_join(lacking, ",").alias("missing"))


def _exported(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("domain", F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("d"), F.col("conv_id") % 3)))
    out = conversion.with_metadata(turns, {"domain": "domain"})
    return out.select("conv_id", F.md5(F.col("page_content").cast("binary")).alias("digest"), "metadata")


QUERIES = {
    "toxicity_split": lambda s, d: quality.sided(quality.detect(_docs(s, d), sensitivity="high")).select("doc_id", "side"),
    "invalid_messages": lambda s, d: conversion.invalid_turns(_messages(s, d)),
    "coverage_of_fields": lambda s, d: metrics.coverage(_docs(s, d).withColumn("subdomain", F.concat("lang", F.lit("/"), "source")), ["source", "lang", "subdomain"]),
    "status_histogram": lambda s, d: metrics.histogram(_events(s, d).withColumn("status", F.when(F.col("user_id") % 4 != 0, 200 + F.col("event_id") % 3)), "status"),
    "version_history": lambda s, d: collaboration.version_history(reports.versions(s, d)),
    "versions_apart": _ends,
    "templates_filled": _filled,
    "merge_outcome": lambda s, d: algebra.outcome(*reports._two(s, d), "doc_id"),
    "documents_with_metadata": _exported,
}

ORACLE_SQL = {
    "toxicity_split": f"SELECT doc_id, CASE WHEN is_toxic THEN 'toxic' ELSE 'clean' END AS side FROM ({curation._HIGH})",
    "invalid_messages": f"""WITH {_EX}, m AS (SELECT id AS conv_id, unnest(coalesce(messages, conversation)) AS m, unnest(range(len(coalesce(messages, conversation))))::INT AS turn FROM ex)
        SELECT conv_id, turn, CASE WHEN m.role IS NULL THEN 'missing_role' WHEN m.content IS NULL THEN 'missing_content' ELSE 'unknown_role' END AS issue FROM m WHERE m.role IS NULL OR m.content IS NULL OR m.role NOT IN ('system', 'user', 'assistant', 'function')""",
    "coverage_of_fields": """WITH v AS (SELECT unnest(['source', 'lang', 'subdomain']) AS field, unnest([source, lang, lang || '/' || source]) AS value FROM documents)
        SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 10""",
    "status_histogram": "SELECT CASE WHEN user_id % 4 <> 0 THEN (200 + event_id % 3)::VARCHAR ELSE 'unknown' END AS status, count(*) AS n FROM events GROUP BY 1",
    "version_history": f"""WITH {reports._VS} SELECT dataset_id, version_number::INT AS version_number, examples_count, examples_count - lag(examples_count) OVER w AS examples_count_diff, examples_count = lag(examples_count) OVER w AS is_same_content FROM vs WINDOW w AS (PARTITION BY dataset_id ORDER BY version_number)""",
    "versions_apart": f"""WITH {reports._VS} SELECT dataset_id, max_by(examples_count, version_number) - min_by(examples_count, version_number) AS examples_count_diff, max_by(examples_count, version_number) = min_by(examples_count, version_number) AS is_same_content FROM vs GROUP BY 1""",
    "templates_filled": """SELECT doc_id, lang || ' of ' || CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'nowhere' END || ' ' || n_chars || ' {{other}} ' || source AS filled, lang || ' of ' || CASE WHEN doc_id % 5 <> 0 THEN source ELSE '{source}' END || ', ' || lang AS plain,
        CASE WHEN doc_id % 5 <> 0 THEN 'user' ELSE 'source,user' END AS missing FROM documents""",
    "merge_outcome": f"WITH {reports._BOTH} SELECT count(*) AS n_merged, count_if(i IS NOT NULL AND j IS NOT NULL AND t IS DISTINCT FROM u)::BIGINT AS n_conflicts, count_if(i IS NOT NULL AND j IS NOT NULL AND t IS DISTINCT FROM u) = 0 AS success FROM bt",
    "documents_with_metadata": """WITH p AS (SELECT conv_id, md5(string_agg(upper(coalesce(role, 'unknown')[1:1]) || lower(coalesce(role, 'unknown')[2:]) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1)
        SELECT conv_id, digest, '{"source":"synthetic","id":' || conv_id || CASE WHEN conv_id % 3 <> 0 THEN ',"domain":"d' || conv_id % 3 || '"' ELSE '' END || '}' AS metadata FROM p""",
}
