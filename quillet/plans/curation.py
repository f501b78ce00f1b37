"""More queries over the reference's own operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import safety
from quillet.functions import text as T
from quillet.operators import conversion, metrics, order, quality, similar, stats
from quillet.streaming import events as E


def _of(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_docs, _turns, _events, _labels, _vectors = map(_of, ("documents", "conversations", "events", "labels", "embeddings"))


def _digest(name: str):
    return F.md5(F.col(name).cast("binary")).alias(name)


def _daily(spark, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    measures = [
        F.count_if(kind == "purchase").alias("generated"), F.sum(F.when(kind == "purchase", F.col("value"))).alias("cost"), F.avg(F.when(kind == "view", F.col("value"))).alias("quality"),
    ]
    out = metrics.daily(_events(spark, sf_dir), "ts", measures, "2023-12-30", "2024-02-02")
    zero = lambda c, d: F.round(F.coalesce(c, F.lit(0.0)), d).alias(c)
    return out.select("day", F.coalesce("generated", F.lit(0)).alias("generated"), zero("cost", 4), zero("quality", 2))


def _history(spark, sf_dir: str) -> DataFrame:
    counts = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return metrics.history(counts, ["event_type"], "day", "n")


def _similar(spark, sf_dir: str) -> DataFrame:
    """The five vectors of greatest cosine to each whose id is divisible by 20."""
    return similar.cosine_top(_vectors(spark, sf_dir), _vectors(spark, sf_dir).where("vec_id % 20 = 0"), 5).withColumn("score", F.round("score", 6))


#: Words that are no keywords.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "to of in for on with at by from as into through during before after above below between under again further then once "
    "and but or nor so yet both either neither not only own same than too very can just don now i you he she it "
    "we they what which who whom this that these those am if because until while"
).split()


def _keywords(spark, sf_dir: str) -> DataFrame:
    """Of each language's 20 most frequent words the first five that are keywords."""
    counts = _docs(spark, sf_dir).select("lang", F.explode(T.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(ranked)).where("place <= 20")
    left = top.where(~F.col("word").isin(STOPWORDS) & (F.length("word") > 2))
    return left.withColumn("place", F.row_number().over(ranked)).where("place <= 5").select("lang", "place", "word", "n")


def _by_content(spark, sf_dir: str) -> DataFrame:
    """Texts of two versions, by content: removed, added or in both."""
    docs = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    two = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("+"), "text")).otherwise(F.col("text")))
    sides = [df.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.max("doc_id").alias(c)) for df, c in ((docs, "one"), (two, "two"))]
    change = F.when(F.col("one").isNull(), "added").when(F.col("two").isNull(), "removed").otherwise("unchanged")
    return sides[0].join(sides[1], "digest", "full_outer").select("digest", "one", "two", change.alias("change"))


def _decided(spark, sf_dir: str) -> DataFrame:
    action = F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 0, "fix").otherwise("keep")
    return _labels(spark, sf_dir).select("doc_id", quality.decision(F.col("quality").cast("double"), action, auto_fix=False).alias("decision"))


def _costs(spark, sf_dir: str) -> DataFrame:
    cost = metrics.cost(F.lit("OpenAI"), F.lit("gpt-4"), T.token_estimate(F.col("text")))
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("n_tokens"), F.round(F.sum(cost), 4).alias("cost"))


def _agents(spark, sf_dir: str) -> DataFrame:
    events = E.stream(spark, sf_dir, "events.parquet", _events(spark, sf_dir).schema)
    return E.latest_state(E.agent_state(events), ["user_id"]).select("user_id", "n", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def _windows(length: str, slide: str | None):
    def query(spark, sf_dir: str) -> DataFrame:
        events = E.stream(spark, sf_dir, "events.parquet", _events(spark, sf_dir).schema)
        state = E.latest_state(E.windows(events, length, slide), ["span", "event_type"])
        return state.select(F.col("span.start").cast("timestamp_ntz").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))

    return query


def _sessions(spark, sf_dir: str) -> DataFrame:
    return E.sessions(_events(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def _format(dialect: str):
    return lambda s, d: conversion.turns_in(_turns(s, d), dialect).select("conv_id", "turn", "role", _digest("content"))


QUERIES = {
    "filter_docs": lambda s, d: _docs(s, d).where("lang = 'en' AND n_chars BETWEEN 100 AND 2000").select("doc_id", "source", "n_chars"),
    "search_like": lambda s, d: _docs(s, d).where(F.col("text").like("%the%")).select("doc_id"),
    "paginate": lambda s, d: order.page(_docs(s, d), "doc_id", 40, 20).select("doc_id", "idx"),
    "soft_delete_filter": lambda s, d: _events(s, d).where("event_type <> 'error'").select("event_id", "user_id", "event_type"),
    "prefix_split": lambda s, d: order.prefix_split(_docs(s, d), "doc_id").select("doc_id", "split"),
    "round_robin": lambda s, d: order.round_robin(_docs(s, d), "doc_id", 3).select("doc_id", "worker"),
    "budget_limit": lambda s, d: order.budget(_docs(s, d), "doc_id", 50, 24, 500).select("doc_id", "idx"),
    "lang_detect": lambda s, d: _docs(s, d).select("doc_id", T.language(F.col("text")).alias("script")),
    "length_histogram": lambda s, d: _docs(s, d).groupBy(T.length_bucket(F.size(T.words(F.col("text")))).alias("bucket")).agg(F.count("*").alias("n")),
    "render_template": lambda s, d: _labels(s, d).select("doc_id", T.rendered("Rate {{id}}: {{q}} of {{q}}", {"id": F.col("doc_id"), "q": F.col("quality")}).alias("prompt")),
    "json_prop": lambda s, d: _events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "injection_flags": lambda s, d: _docs(s, d).select("doc_id", *(c.alias(n) for n, c in safety.injection(F.col("text")).items())),
    "topic_coverage": lambda s, d: metrics.top(_docs(s, d), "source"),
    "quality_label_stats": lambda s, d: _labels(s, d).groupBy("quality", "toxic").agg(F.count("*").alias("n")),
    "diversity_by_source": lambda s, d: _docs(s, d).select("source", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("vocabulary")),
    "daily_stats": _daily,
    "metrics_summary": lambda s, d: metrics.by_type(_events(s, d), "event_type", "value"),
    "top_users": lambda s, d: metrics.top(_events(s, d), "user_id"),
    "cost_estimate": _costs,
    "lag_delta": _history,
    "cosine_topk": _similar,
    "keywords": _keywords,
    "semi_join": lambda s, d: _docs(s, d).join(_labels(s, d).where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id"),
    "anti_join": lambda s, d: _docs(s, d).join(_labels(s, d).select("doc_id"), "doc_id", "left_anti").select("doc_id"),
    "diff_by_content": _by_content,
    "toxicity_detect": lambda s, d: quality.detect(_docs(s, d)),
    "toxicity_filter": lambda s, d: quality.detect(_docs(s, d), sensitivity="high").where("NOT is_toxic").select("doc_id"),
    "toxicity_stats": lambda s, d: quality.toxicity_totals(quality.detect(_docs(s, d), sensitivity="high")),
    "pii_anonymize": lambda s, d: _docs(s, d).select("doc_id", F.md5(safety.redacted(F.col("text")).cast("binary")).alias("digest")),
    "quality_score": lambda s, d: quality.score(_docs(s, d)),
    "decision_table": _decided,
    "to_openai": _format("openai"),
    "to_sharegpt": _format("sharegpt"),
    "to_langchain_chat": _format("langchain"),
    "to_alpaca": lambda s, d: conversion.alpaca(_turns(s, d)).select("conv_id", _digest("instruction"), _digest("input"), _digest("output")),
    "to_langchain_docs": lambda s, d: conversion.documents(_turns(s, d)).select("conv_id", _digest("page_content")),
    "invalid_turns": lambda s, d: conversion.invalid_turns(_turns(s, d)),
    "agent_state": _agents,
    "tumbling_daily": _windows("1 day", None),
    "sliding_window": _windows("1 day", "12 hours"),
    "session_window": _sessions,
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_TOKENS = f"list_filter(list_transform({_WORDS}, lambda w: trim(w, '{T.EDGES}')), lambda w: w <> '')"
_FOLD = r"regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F\pL\pN]', ' ', 'g'), '[^\x00-\x7F]', 'z', 'g')"
_INDEXED = "i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)"
_COUNTS = ", ".join(f"({' + '.join(f'len(regexp_extract_all(t, $$(?i){p}$$))' for p in found)})::BIGINT AS {name}" for name, found in safety.TOXIC.items())
_FOUND = " + ".join(f"({c} > 0)::INT" for c in safety.TOXIC)
_SCORE = f"CASE WHEN {_FOUND} = 0 THEN 0.0 ELSE least(({_FOUND})::DOUBLE / 6 + least(({' + '.join(safety.TOXIC)}) * 0.1::DOUBLE, 0.5::DOUBLE), 1) END::DOUBLE"


def _detect_sql(least: float) -> str:
    return f"""SELECT doc_id, {', '.join(safety.TOXIC)}, round(s, 6) AS score, s >= {least} AS is_toxic FROM (SELECT *, {_SCORE} AS s FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, {_FOLD} AS t FROM documents)))"""


_HIGH = _detect_sql(safety.THRESHOLDS["high"])
_LETTERS = {"cy": "[^а-яА-ЯёЁ]", "la": "[^a-zA-Z]", "zh": "[^一-鿿]"}
_REDACTED = "text"
for _name, _pattern in safety.ENTITIES.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '<{_name}>', 'g')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _roles_sql(dialect: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in conversion.ROLES[dialect].items())
    other = "role" if dialect == "langchain" else "NULL"
    return f"SELECT * FROM (SELECT conv_id, turn, CASE role {cases} ELSE {other} END AS role, md5(coalesce(text, '')) AS content FROM conversations) WHERE role IS NOT NULL"


def _windows_sql(starts: str) -> str:
    return f"SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest({starts}) AS start FROM events) GROUP BY ALL"


_HALF = "time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01')"

ORACLE_SQL = {
    "filter_docs": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 100 AND 2000",
    "search_like": "SELECT doc_id FROM documents WHERE text LIKE '%the%'",
    "paginate": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40",
    "soft_delete_filter": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
    "prefix_split": f"WITH {_INDEXED} SELECT doc_id, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS split FROM i",
    "round_robin": f"WITH {_INDEXED} SELECT doc_id, idx % 3 AS worker FROM i",
    "budget_limit": f"WITH {_INDEXED} SELECT doc_id, idx FROM i WHERE idx < 500",
    "lang_detect": f"""WITH c AS (SELECT doc_id, {', '.join(f"length(regexp_replace(coalesce(text, ''), '{p}', '', 'g')) AS {n}" for n, p in _LETTERS.items())} FROM documents), t AS (SELECT *, cy + la + zh AS n FROM c)
        SELECT doc_id, CASE WHEN n = 0 THEN 'other' WHEN zh > 0.3 * n THEN 'zh' WHEN cy > 0.5 * n THEN 'ru' WHEN la > 0.5 * n THEN 'en' WHEN cy > 0.2 * n AND la > 0.2 * n THEN 'mixed' ELSE 'other' END AS script FROM t""",
    "length_histogram": f"SELECT CASE {' '.join(f'WHEN n <= {m} THEN $${b}$$' for m, b in T.BUCKETS.items())} ELSE '1000+' END AS bucket, count(*) AS n FROM (SELECT len({_WORDS}) AS n FROM documents) GROUP BY 1",
    "render_template": "SELECT doc_id, 'Rate ' || doc_id || ': ' || quality || ' of ' || quality AS prompt FROM labels",
    "json_prop": "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events",
    "injection_flags": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '(?i){p}'), false) AS \"{n}\"" for n, p in safety.INJECTION.items()) + " FROM documents",
    "topic_coverage": "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10",
    "quality_label_stats": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "diversity_by_source": f"SELECT source, count(*) AS n_tokens, count(DISTINCT w) AS vocabulary FROM (SELECT source, unnest({_TOKENS}) AS w FROM documents) GROUP BY 1",
    "daily_stats": """WITH s AS (SELECT unnest(range(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day),
        d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS g, sum(value) FILTER (event_type = 'purchase') AS c, avg(value) FILTER (event_type = 'view') AS q FROM events GROUP BY 1)
        SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(g, 0) AS generated, round(coalesce(c, 0), 4) AS cost, round(coalesce(q, 0), 2) AS quality FROM s LEFT JOIN d ON s.day = d.day""",
    "metrics_summary": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1",
    "top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "cost_estimate": "SELECT source, sum(t)::BIGINT AS n_tokens, round(sum(t / 1000 * 0.03::DOUBLE), 4) AS cost FROM (SELECT source, length(coalesce(text, '')) // 4 AS t FROM documents) GROUP BY 1",
    "lag_delta": "SELECT *, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS added FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)",
    "cosine_topk": """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank, vec_id, round(s, 6) AS score FROM
        (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) QUALIFY rank <= 5""",
    "keywords": f"""WITH c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL),
        t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place, word, n FROM t WHERE word NOT IN ({_STOP}) AND length(word) > 2 QUALIFY place <= 5""",
    "semi_join": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "diff_by_content": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS (SELECT md5(text) AS digest, max(doc_id) AS one FROM d GROUP BY 1), b AS (SELECT md5(CASE WHEN doc_id % 5 = 0 THEN '+' || text ELSE text END) AS digest, max(doc_id) AS two FROM d GROUP BY 1)
        SELECT digest, one, two, CASE WHEN one IS NULL THEN 'added' WHEN two IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (digest)""",
    "toxicity_detect": _detect_sql(safety.THRESHOLDS["medium"]),
    "toxicity_filter": f"SELECT doc_id FROM ({_HIGH}) WHERE NOT is_toxic",
    "toxicity_stats": f"SELECT count(*) AS total, count(*) FILTER (is_toxic) AS toxic, round(100 * count(*) FILTER (is_toxic) / count(*), 2) AS toxic_percentage, round(avg(score), 4) AS average_score, {', '.join(f'count(*) FILTER ({c} > 0) AS {c}' for c in safety.TOXIC)} FROM ({_HIGH})",
    "pii_anonymize": f"SELECT doc_id, md5({_REDACTED}) AS digest FROM documents",
    "quality_score": f"""WITH x AS (SELECT 100 - round(100 * count(*) FILTER (is_toxic) / count(*), 2) AS toxicity FROM ({_detect_sql(safety.THRESHOLDS['medium'])})),
        g AS (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, '')), p AS (SELECT 100 * count(*) / sum(n) AS deduplication FROM g),
        w AS (SELECT unnest({_TOKENS}) AS w FROM documents), c AS (SELECT count(*)::DOUBLE AS n FROM w GROUP BY w),
        v AS (SELECT least(100 * CASE WHEN sum(n) > 1000 THEN count(*) / sqrt(sum(n)) ELSE count(*) / sum(n) END, 100) AS ttr, least(100 * (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / 12, 100) AS e FROM c),
        k AS (SELECT count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), m AS (SELECT 1 - sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE AS s FROM k),
        f AS (SELECT 100 * count(*) FILTER (coalesce(text, '') <> '') / count(*) AS completeness FROM documents),
        j AS (SELECT toxicity, deduplication, CASE WHEN s > 0 THEN 0.4 * ttr + 0.3 * e + 30 * s ELSE 0.6 * ttr + 0.4 * e END AS diversity, completeness, 100.0::DOUBLE AS consistency FROM x, p, v, m, f),
        o AS (SELECT *, 0.3 * toxicity + 0.25 * deduplication + 0.25 * diversity + 0.1 * completeness + 0.1 * consistency AS o FROM j)
        SELECT round(toxicity, 4) AS toxicity, round(deduplication, 4) AS deduplication, round(diversity, 4) AS diversity, round(completeness, 4) AS completeness, consistency, round(o, 1) AS overall,
        CASE WHEN o >= 90 THEN 'A' WHEN o >= 80 THEN 'B' WHEN o >= 70 THEN 'C' WHEN o >= 60 THEN 'D' ELSE 'F' END AS grade FROM o""",
    "decision_table": "SELECT doc_id, CASE WHEN quality IS NULL THEN 'error' WHEN quality >= 0.7 THEN 'kept' WHEN toxic = 1 THEN 'removed' ELSE 'kept' END AS decision FROM labels",
    "to_openai": _roles_sql("openai"),
    "to_sharegpt": _roles_sql("sharegpt"),
    "to_langchain_chat": _roles_sql("langchain"),
    "to_alpaca": r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE WHEN role IN ('user', 'human') THEN 'u' WHEN role IN ('assistant', 'bot', 'ai') THEN 'a' WHEN role = 'system' THEN 's' END AS side FROM conversations),
        f AS (SELECT *, min(turn) FILTER (text <> '') OVER (PARTITION BY conv_id, side) AS first_turn FROM t)
        SELECT conv_id, md5(coalesce(nullif(max_by(text, turn) FILTER (side = 's'), ''), 'Respond to the following conversation.')) AS instruction,
        md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (side = 'u' AND turn >= first_turn), '')) AS input, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (side = 'a' AND turn >= first_turn), '')) AS output FROM f GROUP BY conv_id""",
    "to_langchain_docs": r"""SELECT conv_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY turn, line)) AS page_content FROM (SELECT conv_id, turn, upper(r[1]) || lower(r[2:]) || ': ' || coalesce(text, '') AS line FROM (SELECT *, coalesce(role, 'unknown') AS r FROM conversations)) GROUP BY 1""",
    "invalid_turns": "SELECT * FROM (SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'missing_role' WHEN text IS NULL THEN 'missing_content' WHEN role NOT IN ('system', 'user', 'assistant', 'function') THEN 'unknown_role' END AS issue FROM conversations) WHERE issue IS NOT NULL",
    "agent_state": "SELECT user_id, count(*) AS n, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "tumbling_daily": _windows_sql("[date_trunc('day', ts)::TIMESTAMP]"),
    "sliding_window": _windows_sql(f"[{_HALF}, {_HALF} - INTERVAL 12 HOUR]"),
    "session_window": """WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
        SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""",
}
