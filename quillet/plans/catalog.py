"""Queries over listings and variants, and their SQL. Datasets, jobs, versions and variants are views of events, a row
of these for each or an aggregate of all; examples are documents of every shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import catalog as K
from quillet.plans.examples import _EX, examples


def _events(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _sets(spark, sf_dir: str) -> DataFrame:
    """A dataset for each user."""
    e = _events(spark, sf_dir)
    at = lambda f: f(F.col("ts")).cast("timestamp_ntz").cast("string")
    out = e.groupBy(F.col("user_id").alias("dataset_id")).agg(at(F.min).alias("created_at"), at(F.max).alias("updated_at"), F.count("*").alias("example_count"), F.array_sort(F.collect_set("event_type")).alias("tags"))
    k = F.col("dataset_id")
    return out.select("*", F.concat(F.lit("set "), (k % 7).cast("string")).alias("name"), F.when(k % 3 == 0, "code").when(k % 3 == 1, "chat").alias("domain"), F.when(k % 2 == 0, "chat").otherwise("instruction").alias("format"), F.concat(F.lit("/data/"), k.cast("string"), F.lit(".jsonl")).alias("file_path"))


def _jobs(spark, sf_dir: str, kinds: list[str]) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type").isin(kinds))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), (F.col("event_id") % 9).alias("done"), F.when(F.col("user_id") % 5 == 0, 0).otherwise(F.col("user_id") % 9 + 8).cast("long").alias("total"),
        F.col("ts").alias("started_at"), F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
    )


def _tasks(spark, sf_dir: str) -> DataFrame:
    out = K.tasks(_jobs(spark, sf_dir, ["view", "click"]), _jobs(spark, sf_dir, ["signup"]))
    text = lambda c: F.col(c).cast("timestamp_ntz").cast("string").alias(c)
    return out.select("id", "type", "status", F.round("progress", 6).alias("progress"), "progress_details", text("created_at"), text("updated_at"))


def _templates(spark, sf_dir: str) -> DataFrame:
    """Templates are event types and one that has no versions; versions are the days on which they occur."""
    e = _events(spark, sf_dir)
    versions = e.groupBy(F.col("event_type").alias("template_id"), F.dayofyear("ts").alias("version")).agg(F.count("*").alias("size"))
    templates = e.select(F.col("event_type").alias("template_id")).distinct().unionByName(spark.createDataFrame([("draft",)], "template_id string"))
    return K.with_versions(templates, versions)


def _variants(spark, sf_dir: str) -> DataFrame:
    """A user's events are variants of one example; the judge names the place that the first's value does."""
    e = _events(spark, sf_dir).withColumn("choice", F.when(F.col("user_id") % 4 != 0, F.floor(F.col("value")).cast("int") - 3))
    return K.best_variants(e, "user_id", "event_id", "choice").select("user_id", "event_id", "n_variants")


def _shown(spark, sf_dir: str) -> DataFrame:
    ex = examples(spark, sf_dir)
    return ex.select("id", F.md5(K.displayed(F.col("messages"), F.col("instruction"), F.col("output"), F.col("text")).cast("binary")).alias("digest"))


def _merged(spark, sf_dir: str) -> DataFrame:
    base = F.from_json("props", "map<string, string>")
    change = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    return _events(spark, sf_dir).select("event_id", K.updated(base, change).alias("m")).select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("merged"))


QUERIES = {
    "datasets_listed": lambda s, d: K.datasets(_sets(s, d), domain="chat", sort_by="example_count", order="ASC", limit=25).select("dataset_id", "example_count", "format"),
    "datasets_newest": lambda s, d: K.datasets(_sets(s, d), format_="chat", sort_by="size", limit=20).select("dataset_id", "created_at"),
    "versions_newest": lambda s, d: K.newest_of_each(_events(s, d).withColumn("version", F.col("event_id")), ["user_id"], "version", 3).select("user_id", "version", "place"),
    "templates_newest": lambda s, d: K.newest(_sets(s, d), "updated_at", "dataset_id", domain="code").select("dataset_id", "updated_at"),
    "sets_tagged": lambda s, d: K.tagged(_sets(s, d), "purchase").select("dataset_id"),
    "tags_of_domains": lambda s, d: K.all_tags(_sets(s, d), "domain"),
    "tasks_all": _tasks,
    "examples_with_paths": lambda s, d: K.with_paths(_events(s, d).select("event_id", F.col("user_id").alias("dataset_id")), _sets(s, d).where("dataset_id % 3 <> 2")),
    "template_versions": _templates,
    "basic_stats": lambda s, d: K.basic_stats(_events(s, d).select("event_id", "ts", "user_id")),
    "metadata_merged": _merged,
    "quality_gate": lambda s, d: K.gate(_events(s, d).withColumn("score", F.when(F.col("user_id") % 9 != 0, F.col("value") / 100)), "score", 0.25).select("event_id"),
    "best_variants": _variants,
    "top_candidates": lambda s, d: K.top_candidates(_events(s, d), "value", "event_id", 50).select("event_id", "place", "chosen"),
    "examples_displayed": _shown,
}

_SETS = """st AS (SELECT user_id AS dataset_id, min(ts)::VARCHAR AS created_at, max(ts)::VARCHAR AS updated_at, count(*) AS example_count, list(DISTINCT event_type) AS tags, CASE WHEN user_id % 3 = 0 THEN 'code' WHEN user_id % 3 = 1 THEN 'chat' END AS domain,
    CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'instruction' END AS format, '/data/' || user_id || '.jsonl' AS file_path FROM events GROUP BY user_id)"""
_SHOW = """CASE WHEN messages IS NOT NULL THEN '{"type":"chat","messages":' || to_json(list_transform(messages, lambda m: {'role': m.role, 'content': coalesce(m.content, '')}))::VARCHAR || '}'
    WHEN instruction IS NOT NULL AND output IS NOT NULL THEN to_json({'type': 'instruction', 'instruction': instruction, 'output': output})::VARCHAR ELSE to_json({'type': 'unknown', 'content': coalesce(text, '')})::VARCHAR END"""

ORACLE_SQL = {
    "datasets_listed": f"WITH {_SETS} SELECT dataset_id, example_count, format FROM st WHERE domain = 'chat' ORDER BY example_count, dataset_id LIMIT 25",
    "datasets_newest": f"WITH {_SETS} SELECT dataset_id, created_at FROM st WHERE format = 'chat' ORDER BY created_at DESC, dataset_id LIMIT 20",
    "versions_newest": "SELECT user_id, event_id AS version, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC))::INT AS place FROM events QUALIFY place <= 3",
    "templates_newest": f"WITH {_SETS} SELECT dataset_id, updated_at FROM st WHERE domain = 'code'",
    "sets_tagged": "SELECT DISTINCT user_id AS dataset_id FROM events WHERE event_type = 'purchase'",
    "tags_of_domains": f"WITH {_SETS} SELECT DISTINCT domain, unnest(tags) AS tag FROM st",
    "tasks_all": """SELECT id, type, status, round(CASE WHEN total > 0 THEN done / total ELSE 0 END, 6)::DOUBLE AS progress, done || '/' || total || ' examples' AS progress_details, ts::VARCHAR AS created_at, CASE WHEN status = 'view' THEN ts ELSE ts + INTERVAL 1 HOUR END::VARCHAR AS updated_at
        FROM (SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'quality' ELSE 'generator' END AS type, event_type AS status, event_id % 9 AS done, CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id % 9 + 8 END AS total, ts FROM events WHERE event_type IN ('view', 'click', 'signup'))""",
    "examples_with_paths": "SELECT event_id, user_id AS dataset_id, '/data/' || user_id || '.jsonl' AS file_path FROM events WHERE user_id % 3 <> 2",
    "template_versions": "SELECT event_type AS template_id, dayofyear(ts)::INT AS version, count(*) AS size, (row_number() OVER (PARTITION BY event_type ORDER BY dayofyear(ts) DESC))::INT AS place FROM events GROUP BY 1, 2, dayofyear(ts) UNION ALL SELECT 'draft', NULL, NULL, NULL",
    "basic_stats": "SELECT count(*) AS total_examples, 'event_id,ts,user_id' AS fields FROM events",
    "metadata_merged": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k=' || event_type || ';user=' || user_id ELSE 'k=' || (props->>'$.k') END AS merged FROM events",
    "quality_gate": "SELECT event_id FROM events WHERE user_id % 9 <> 0 AND value / 100 >= 0.25",
    "best_variants": """WITH v AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, first_value(CASE WHEN user_id % 4 <> 0 THEN floor(value) - 3 END) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events)
        SELECT user_id, event_id, n AS n_variants FROM v WHERE p = greatest(0, least(coalesce(c, 0), n - 1))""",
    "top_candidates": "SELECT event_id, (row_number() OVER (ORDER BY value DESC, event_id) - 1)::INT AS place, place < 50 AS chosen FROM events QUALIFY place < 100",
    "examples_displayed": f"WITH {_EX} SELECT id, md5({_SHOW}) AS digest FROM ex",
}
