"""Queries over streams with state, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.streaming import durations, index
from quillet.streaming import events as E


def _durations(spark, sf_dir: str) -> DataFrame:
    """Times from a user's last signup to a purchase."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return durations.durations(spark, sf_dir, "events.parquet", schema, "signup", "purchase").withColumn("seconds", F.round("seconds", 6))


def _growing(spark, sf_dir: str) -> DataFrame:
    """For each document the first earlier one of an index that grows, file by file."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return index.grow(E.stream(spark, sf_dir, "documents.parquet", schema)).found()


QUERIES = {"event_durations": _durations, "growing_index": _growing}

_HOURS = 48

ORACLE_SQL = {
    "event_durations": f"""WITH e AS (SELECT user_id, event_id, ts, event_type = 'signup' AS s FROM events WHERE event_type IN ('signup', 'purchase')),
        l AS (SELECT *, last_value(CASE WHEN s THEN event_id END IGNORE NULLS) OVER w AS sid, last_value(CASE WHEN s THEN ts END IGNORE NULLS) OVER w AS sts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT user_id, event_id, ts, CASE WHEN ts - sts <= INTERVAL {_HOURS} HOURS THEN sid END AS sid, sts FROM l WHERE NOT s),
        n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e WHERE s),
        o AS (SELECT n.* FROM n ANTI JOIN c ON c.sid = n.event_id),
        m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e),
        g AS (SELECT user_id, event_id, CASE WHEN next - ts <= INTERVAL {_HOURS} HOURS THEN 'restarted' WHEN next IS NOT NULL OR ts + INTERVAL {_HOURS} HOURS <= mark
            OR EXISTS (SELECT 1 FROM c WHERE c.user_id = o.user_id AND c.ts - o.ts > INTERVAL {_HOURS} HOURS) THEN 'timed out' END AS status FROM o, m)
        SELECT user_id AS agent, sid AS start_id, event_id AS end_id, CASE WHEN sid IS NULL THEN 0 ELSE round(epoch_us(ts) / 1e6 - epoch_us(sts) / 1e6, 6) END AS seconds, CASE WHEN sid IS NULL THEN 'no start' ELSE 'done' END AS status FROM c
        UNION ALL SELECT user_id, event_id, NULL, NULL, status FROM g WHERE status IS NOT NULL""",
}
