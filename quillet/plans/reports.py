"""Queries over logs, reviews, threads, versions, checks and augmented texts, and their SQL.

Tables that the data lack are views of those it has, each over all its rows: reviews, comments,
permissions and job logs are events; templates are documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import checks as C
from quillet.functions import text as T
from quillet.operators import algebra, augment, collaboration, dedup, metrics, order, similar, stats
from quillet.operators import shapes as S
from quillet.plans.examples import _EX, examples


def _of(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_docs, _turns, _events, _labels, _vectors = map(_of, ("documents", "conversations", "events", "labels", "embeddings"))
_STATES = "array('pending', 'approved', 'rejected', 'needs_changes')"


def reviews(s, d) -> DataFrame:
    return _events(s, d).select(
        F.col("event_id").alias("review_id"), (F.col("user_id") % 5).alias("dataset_id"), F.col("user_id").alias("example_id"), F.col("event_type").alias("reviewer_id"),
        F.expr(f"{_STATES}[event_id % 4]").alias("status"), F.date_trunc("day", "ts").alias("created_at"),
    )


def comments(s, d) -> DataFrame:
    return _events(s, d).select(F.col("event_id").alias("comment_id"), F.expr("CASE WHEN event_id % 4 <> 0 THEN event_id DIV 4 END").alias("parent_id"), (F.col("event_type") == "click").alias("resolved"), "user_id", (F.col("user_id") % 5).alias("dataset_id"))


def permissions(s, d) -> DataFrame:
    return _events(s, d).select((F.col("event_id") % 20).alias("dataset_id"), "user_id", F.expr("array('owner', 'write', 'read', 'none')[event_id % 4]").alias("permission_level"))


def templates(s, d) -> DataFrame:
    return _docs(s, d).select("doc_id", F.col("source").alias("name"), F.col("lang").alias("description"), F.array("lang", "source").alias("tags"))


def versions(s, d) -> DataFrame:
    counts = _events(s, d).groupBy(F.col("event_type").alias("dataset_id"), F.dayofyear("ts").alias("version_number")).agg(F.count("*").alias("examples_count"))
    return counts.withColumn("examples_hash", F.md5(F.col("examples_count").cast("string").cast("binary")))


def log(s, d) -> DataFrame:
    e = _events(s, d)
    return e.select(
        "ts", F.col("event_type").alias("provider"), (F.col("user_id") % 10).alias("examples_generated"), F.col("event_id").alias("tokens_used"), F.col("value").alias("cost_estimate"), F.col("value").alias("duration_seconds"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("response_time_ms"), (F.col("user_id") % 3 == 0).alias("success"), (F.col("user_id") % 7).alias("examples_checked"), (F.col("user_id") % 2).alias("issues_found"), (F.col("value") / 100).alias("average_score"),
    )


def _two(s, d) -> tuple[DataFrame, DataFrame]:
    from quillet.queries import _versions

    return _versions(s, d)


def _md5(c):
    return F.md5(F.coalesce(c, F.lit("")).cast("binary"))


_PREFIX = "Good old work is hard, but I think this is very good because what is new and fast isn't working. "


def _augmented(name: str):
    return lambda s, d: _docs(s, d).select("doc_id", _md5(augment.TECHNIQUES[name](F.concat(F.lit(_PREFIX), "text"), F.col("doc_id"))).alias("digest"))


def _answers(s, d) -> DataFrame:
    """Model answers: the event's properties, fenced, bare, broken or empty by its id."""
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {ok}"))).when(k == 1, F.concat(F.lit("It is "), "props", F.lit(" I think"))).when(k == 2, F.concat(F.lit("# {"), "props")).when(k == 3, F.lit("  "))
    return _events(s, d).select("event_id", text.otherwise(F.col("props")).alias("text"))


def _found(s, d) -> DataFrame:
    """Entities as a detector gives them: one of each kind for a document, scores by its id."""
    kinds = F.array(*map(F.lit, ["EMAIL_ADDRESS", "DATE_TIME", "PERSON", "URL", "US_SSN"]))
    entity = lambda t, i: F.struct(t.alias("type"), (i * 10).alias("start"), (F.pmod(F.col("doc_id") + i, F.lit(10)) / 10.0).alias("score"))
    return _docs(s, d).select("doc_id", F.transform(kinds, entity).alias("entities"))


def _jaccard(s, d) -> DataFrame:
    return similar.jaccard_pairs(_docs(s, d), 80)


def _leaders(s, d) -> DataFrame:
    """Greedy groups: each document's leader, documents with the same words being one."""
    docs = _docs(s, d)
    one = similar.set_keys(docs).where("n > 0").groupBy("k").agg(F.min("doc_id").alias("id"))
    return similar.leaders(_jaccard(s, d).select("a", "b"), one.select("id"))


QUERIES = {
    "reviews_latest": lambda s, d: collaboration.latest_reviews(reviews(s, d)).select("dataset_id", "example_id", "review_id", "status"),
    "reviews_approved": lambda s, d: collaboration.approved(reviews(s, d)),
    "review_summary": lambda s, d: collaboration.review_summary(reviews(s, d)),
    "top_reviewers": lambda s, d: collaboration.most_active(reviews(s, d), "dataset_id", "reviewer_id"),
    "comment_threads": lambda s, d: collaboration.threads(comments(s, d)),
    "comment_descendants": lambda s, d: collaboration.descendants(comments(s, d), comments(s, d).where("comment_id IN (1, 5, 64)")),
    "comments_without_threads": lambda s, d: collaboration.without_threads(comments(s, d), comments(s, d).where("comment_id IN (1, 5, 64)")).select("comment_id"),
    "comment_totals": lambda s, d: collaboration.comment_totals(comments(s, d)),
    "comments_newest": lambda s, d: comments(s, d).where("NOT resolved AND dataset_id = 2").orderBy(F.desc("comment_id")).select("comment_id", "user_id"),
    "permissions_allowed": lambda s, d: collaboration.allowed(permissions(s, d), "write").distinct(),
    "permission_totals": lambda s, d: collaboration.permission_totals(permissions(s, d)),
    "templates_with_tags": lambda s, d: collaboration.with_tags(templates(s, d), ["en", "src3"]).select("doc_id"),
    "templates_matching": lambda s, d: collaboration.matching(templates(s, d), "SRC").select("doc_id"),
    "hooks_subscribed": lambda s, d: collaboration.subscribed(templates(s, d).withColumnRenamed("tags", "events"), "fr").select("doc_id"),
    "version_totals": lambda s, d: collaboration.version_totals(versions(s, d)),
    "version_content_hash": lambda s, d: collaboration.content_hash(_docs(s, d), ["doc_id", "text"]),
    "versions_compared": lambda s, d: _events(s, d).groupBy("user_id").agg(C.duration(F.min("ts"), F.max("ts")).alias("between"), C.recently(F.max("ts"), F.lit("2024-01-31").cast("timestamp")).alias("active")),
    "diff_summary": lambda s, d: algebra.diff_summary(*_two(s, d), "doc_id"),
    "merge_content": lambda s, d: algebra.merge_by_content(*_two(s, d)).select("doc_id", _md5(F.col("text")).alias("digest")),
    "merge_content_counts": lambda s, d: algebra.content_counts(*_two(s, d)),
    "merge_conflicts": lambda s, d: algebra.conflicts(*_two(s, d), "doc_id").select("doc_id", _md5(F.col("one.text")).alias("one"), _md5(F.col("two.text")).alias("two")),
    "merge_resolved": lambda s, d: algebra.resolve(*_two(s, d), "doc_id", "keep_second").select("doc_id", _md5(F.col("text")).alias("digest")),
    "last_duplicate_wins": lambda s, d: algebra.last_wins(_turns(s, d).select("conv_id", "turn", "role"), "conv_id", "turn").select("conv_id", "row.turn", "row.role"),
    "concatenated": lambda s, d: algebra.concatenated([_docs(s, d).select("doc_id", "lang"), _labels(s, d).select("doc_id", "quality")]),
    "generation_totals": lambda s, d: metrics.generation_totals(log(s, d)),
    "provider_histogram": lambda s, d: metrics.histogram(log(s, d), "provider"),
    "api_totals": lambda s, d: metrics.api_totals(log(s, d)),
    "export_totals": lambda s, d: metrics.export_totals(log(s, d)),
    "check_totals": lambda s, d: metrics.check_totals(log(s, d)),
    "log_within": lambda s, d: metrics.generation_totals(metrics.within(log(s, d), "ts", "2024-01-05", "2024-01-12")),
    "majority_domain": lambda s, d: metrics.majority(_docs(s, d), "source", "doc_id"),
    "content_stats": lambda s, d: stats.content_stats(examples(s, d), F.coalesce("conversation", "messages"), S.text_of(examples(s, d), "dedup")),
    "domain_histogram": lambda s, d: metrics.histogram(examples(s, d).select("domain", "language"), "language"),
    "quality_indicators": lambda s, d: stats.quality_indicators(examples(s, d), F.col("metadata.quality_score"), F.col("id") % 3 == 0, F.col("metadata")),
    "compare_sizes": lambda s, d: stats.compare_sizes(_docs(s, d), _labels(s, d)),
    "compare_diversity": lambda s, d: stats.compare_diversity(_docs(s, d), _turns(s, d).withColumn("source", F.col("role")), T.tokens(F.col("text")), "source"),
    "message_stats": lambda s, d: stats.message_stats(S.questions_and_answers(examples(s, d))),
    "json_extracted": lambda s, d: _answers(s, d).select("event_id", C.json_in(F.col("text")).alias("found")),
    "output_format": lambda s, d: _answers(s, d).select("event_id", *(C.format_error(F.col("text"), k).alias(k) for k in ("text", "json", "markdown"))),
    "output_length": lambda s, d: _docs(s, d).select("doc_id", C.length_error(F.col("text"), 500, 3000).alias("error")),
    "output_words": lambda s, d: _docs(s, d).select("doc_id", F.array_join(C.words_in(F.col("text"), ["The", "und", "que"]), ",").alias("found"), F.array_join(C.words_missing(F.col("text"), ["The", "und", "que"]), ",").alias("missing")),
    "template_references": lambda s, d: _docs(s, d).select(
        "doc_id", F.array_join(C.undefined(F.concat(F.lit("{{a}} {{"), "lang", F.lit("}} {{a}}")), F.array(F.lit("a"), F.lit("b"), F.lit("en"))), ",").alias("undefined"),
        F.array_join(C.unused(F.concat(F.lit("{{a}} {{"), "lang", F.lit("}} {{a}}")), F.array(F.lit("a"), F.lit("b"), F.lit("en"))), ",").alias("unused"),
    ),
    "pii_sensitive": lambda s, d: _found(s, d).select("doc_id", F.array_join(F.transform(C.sensitive(F.col("entities")), lambda e: e["type"]), ",").alias("kinds")),
    "hydrated_examples": lambda s, d: _answers(s, d).select(C.hydrated(F.col("text"), F.col("event_id"), F.lit(0.5), F.lit("")).alias("h")).select("h.id", _md5(F.col("h.example")).alias("digest"), "h.status"),
    "augment_synonym": _augmented("synonym"),
    "augment_delete": _augmented("delete"),
    "augment_insert": _augmented("insert"),
    "augment_swap": _augmented("swap"),
    "augment_back_translation": _augmented("back_translation"),
    "augment_contextual": _augmented("contextual"),
    "augment_totals": lambda s, d: augment.augmented_totals(augment.augmented(_docs(s, d).select("doc_id", "text"), techniques=["delete", "contextual"])),
    "exact_sample": lambda s, d: order.sample(_docs(s, d), "doc_id", 50).select("doc_id"),
    "pairs_in_order": lambda s, d: order.pairs(_docs(s, d), "doc_id").select("doc_id", "pair"),
    "duplicates_removed": lambda s, d: dedup.remove(_docs(s, d), T.normal(F.col("text"))),
    "keep_first_normal": lambda s, d: dedup.keep_first(_docs(s, d), T.normal(F.col("text"))).select("doc_id"),
    "minhash_first": lambda s, d: similar.lsh_groups(_docs(s, d)),
    "jaccard_pairs": _jaccard,
    "jaccard_leaders": _leaders,
    "jaccard_groups": lambda s, d: similar.similar_groups(_docs(s, d)),
    "augment_paraphrase": lambda s, d: _docs(s, d).select("doc_id", _md5(augment.paraphrased(F.col("text"), F.col("doc_id"))).alias("digest")),
    "augment_all_totals": lambda s, d: augment.augmented_totals(augment.augmented(_docs(s, d).select("doc_id", "text"), copies=2)),
    "self_bleu_2": lambda s, d: stats.self_bleu(_turns(s, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "text", "id", 2, 100),
}

_RV = "rv AS (SELECT event_id AS review_id, user_id % 5 AS dataset_id, user_id AS example_id, event_type AS reviewer_id, ['pending', 'approved', 'rejected', 'needs_changes'][event_id % 4 + 1] AS status, date_trunc('day', ts) AS created_at FROM events), la AS (SELECT * FROM rv QUALIFY row_number() OVER (PARTITION BY dataset_id, example_id ORDER BY created_at DESC, review_id) = 1)"
_CM = "cm AS (SELECT event_id AS comment_id, CASE WHEN event_id % 4 <> 0 THEN event_id // 4 END AS parent_id, event_type = 'click' AS resolved, user_id, user_id % 5 AS dataset_id FROM events)"
_DOWN = f"{_CM}, down AS (SELECT comment_id FROM cm WHERE comment_id IN (1, 5, 64) UNION SELECT cm.comment_id FROM cm JOIN down ON cm.parent_id = down.comment_id)"
_PM = "pm AS (SELECT event_id % 20 AS dataset_id, user_id, ['owner', 'write', 'read', 'none'][event_id % 4 + 1] AS permission_level FROM events)"
_VS = "vs AS (SELECT event_type AS dataset_id, dayofyear(ts) AS version_number, count(*) AS examples_count FROM events GROUP BY ALL)"
_2 = "one AS (SELECT doc_id, text FROM documents), two AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '+' || text ELSE text END AS text FROM documents)"
_BOTH = f"{_2}, bt AS (SELECT one.doc_id AS i, two.doc_id AS j, one.text AS t, two.text AS u FROM one FULL JOIN two ON one.doc_id = two.doc_id)"
_CT = f"{_2}, a AS (SELECT md5(coalesce(text, '')) AS digest, max(doc_id) AS i FROM one GROUP BY 1), b AS (SELECT md5(coalesce(text, '')) AS digest, max(doc_id) AS j FROM two GROUP BY 1), f AS (SELECT digest, i, j FROM a FULL JOIN b USING (digest))"
_LOG = "lg AS (SELECT ts, event_type AS provider, user_id % 10 AS eg, event_id AS tu, value, CASE WHEN event_type <> 'view' THEN value END AS rt, user_id % 3 = 0 AS success, user_id % 7 AS ec, user_id % 2 AS isf, value / 100 AS sc FROM events)"
_GEN = "count(*) AS jobs, coalesce(sum(eg), 0)::BIGINT AS examples, coalesce(sum(tu), 0)::BIGINT AS tokens, round(coalesce(sum(value), 0), 2) AS cost, round(coalesce(sum(value), 0) / 3600, 2) AS hours, round(coalesce(sum(eg), 0) / count(*), 1) AS examples_each"
_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_TOKENS = f"list_filter(list_transform({_WORDS}, lambda w: trim(w, '{T.EDGES}')), lambda w: w <> '')"
_AN = r"""an AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done {ok}' WHEN 1 THEN 'It is ' || props || ' I think' WHEN 2 THEN '# {' || props WHEN 3 THEN '  ' ELSE props END AS text, props FROM events)"""
_PRE = _PREFIX.replace("'", "''")


def _spread(x: str) -> str:
    return f"min({x}) AS {x}_min, max({x}) AS {x}_max, round(avg({x}), 2) AS {x}_mean, quantile_cont({x}, 0.5)::DOUBLE AS {x}_median"


def _chance(salt: str, of: str) -> str:
    return f"(('0x' || md5(doc_id || '|' || {salt})[1:8])::BIGINT % ({of}))"


_AW = rf"w AS (SELECT doc_id, '{_PRE}' || text AS text, list_filter(string_split_regex('{_PRE}' || text, '\s+'), lambda x: x <> '') AS w FROM documents)"


def _drawn(salt: str) -> str:
    """All places of the words in drawn order, one row each, with the place's turn from 0."""
    return f"""e AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_chance(f"'{salt}:' || i", '4294967296')}, i) - 1 AS turn FROM e)"""


_LEXICON = ", ".join(f"({word!r}, {options!r})" for word, options in augment.SYNONYMS.items())
_NORMAL = f"translate(array_to_string({_WORDS}, ' '), '{T.PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
_SETS = rf"""d AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex({_NORMAL}, '\s+'), lambda x: x <> ''))) AS w FROM documents), st AS (SELECT w, min(doc_id) AS id FROM d WHERE len(w) > 0 GROUP BY 1),
    pr AS (SELECT a.id AS a, b.id AS b FROM st a, st b WHERE a.id < b.id AND 100 * len(list_intersect(a.w, b.w)) >= 80 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""
_SAID = f"""q AS (SELECT id, CASE k WHEN 2 THEN [messages[2].content] WHEN 3 THEN [language] WHEN 4 THEN [prompt] WHEN 5 THEN [instruction] WHEN 6 THEN [question] ELSE [] END AS q,
    CASE k WHEN 2 THEN [domain] WHEN 3 THEN [conversation[2].content] WHEN 4 THEN [completion] WHEN 5 THEN [output] WHEN 6 THEN [answer] ELSE [] END AS a FROM ex),
    m AS (SELECT false AS ans, unnest(q) AS text FROM q UNION ALL SELECT true, unnest(a) FROM q), mw AS (SELECT ans, text, len({_WORDS}) AS n FROM m)"""
_DIVERSITY = """(SELECT count(*) AS v, round(CASE WHEN sum(n) > 1000 THEN count(*) / sqrt(sum(n)) ELSE count(*) / sum(n) END, 6) AS t, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS e FROM (SELECT count(*) AS n FROM (SELECT unnest({0}) AS w FROM {1}) GROUP BY w))"""
_SIMPSON = "(SELECT round(1 - sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE, 6) AS d FROM (SELECT count(*) AS n FROM {1} WHERE {0} IS NOT NULL GROUP BY {0}))"



def _paraphrase_sql() -> str:
    """One nested step a pattern, each with its own chance."""
    order = ", ".join(f"{{'r': {_chance(f"'pattern:' || {i}", '4294967296')}, 'i': {i}}}" for i in range(len(augment.PARAPHRASES)))
    rows = f"SELECT doc_id, text, lower(text) AS t, list_transform(list_sort([{order}])[1:{len(augment.PARAPHRASES) // 2}], lambda x: x.i) AS chosen FROM documents"
    for i, (pattern, new) in enumerate(augment.PARAPHRASES):
        first = "\\1" + new.replace("\\1", "\\2").replace("'", "''")
        rows = f"SELECT doc_id, text, chosen, CASE WHEN list_contains(chosen, {i}) AND {_chance(f"'try:{i}'", '2')} = 0 THEN regexp_replace(t, '(?s)^(.*?){pattern}', '{first}') ELSE t END AS t FROM ({rows})"
    return f"""SELECT doc_id, md5(coalesce(CASE WHEN t = lower(text) THEN text WHEN regexp_matches(text[1:1], '\\p{{Lu}}') THEN upper(t[1:1]) || t[2:] ELSE t END, '')) AS digest FROM ({rows})"""


ORACLE_SQL = {
    "augment_paraphrase": _paraphrase_sql(),
    "reviews_latest": f"WITH {_RV} SELECT dataset_id, example_id, review_id, status FROM la",
    "reviews_approved": f"WITH {_RV} SELECT dataset_id, example_id FROM la WHERE status = 'approved'",
    "review_summary": f"WITH {_RV}, n AS (SELECT dataset_id, count(*) AS n_reviews FROM rv GROUP BY 1) SELECT dataset_id, any_value(n_reviews) AS n_reviews, count(*) AS n_examples, {', '.join(f'''count(*) FILTER (status = '{x}') AS {x}''' for x in collaboration.STATES)} FROM la JOIN n USING (dataset_id) GROUP BY 1",
    "top_reviewers": f"WITH {_RV} SELECT dataset_id, reviewer_id, count(*) AS n, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, reviewer_id)::INT AS rank FROM rv GROUP BY 1, 2 QUALIFY rank <= 5",
    "comment_threads": f"WITH RECURSIVE {_CM}, th AS (SELECT comment_id, comment_id AS root, 0::BIGINT AS depth FROM cm WHERE parent_id IS NULL OR parent_id NOT IN (SELECT comment_id FROM cm) UNION ALL SELECT cm.comment_id, th.root, th.depth + 1 FROM cm JOIN th ON cm.parent_id = th.comment_id) SELECT * FROM th",
    "comment_descendants": f"WITH RECURSIVE {_DOWN} SELECT comment_id FROM down",
    "comments_without_threads": f"WITH RECURSIVE {_DOWN} SELECT comment_id FROM cm WHERE comment_id NOT IN (SELECT comment_id FROM down)",
    "comment_totals": f"WITH {_CM} SELECT count(*) AS total, count(*) FILTER (resolved) AS resolved, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (parent_id IS NULL) AS roots, count(parent_id) AS replies FROM cm",
    "comments_newest": f"WITH {_CM} SELECT comment_id, user_id FROM cm WHERE NOT resolved AND dataset_id = 2 ORDER BY comment_id DESC",
    "permissions_allowed": f"WITH {_PM} SELECT DISTINCT dataset_id, user_id FROM pm WHERE permission_level IN ('owner', 'write')",
    "permission_totals": f"WITH {_PM} SELECT count(*) AS total, {', '.join(f'''count(*) FILTER (permission_level = '{x}') AS n_{x}''' for x in collaboration.LEVELS)}, count(DISTINCT dataset_id) AS n_datasets, count(DISTINCT user_id) AS n_users FROM pm",
    "templates_with_tags": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'",
    "templates_matching": "SELECT doc_id FROM documents WHERE lower(source) LIKE '%src%' OR lower(lang) LIKE '%src%'",
    "hooks_subscribed": "SELECT doc_id FROM documents WHERE 'fr' IN (lang, source) OR 'all' IN (lang, source)",
    "version_totals": f"""WITH {_VS}, g AS (SELECT *, greatest(examples_count - lag(examples_count) OVER (PARTITION BY dataset_id ORDER BY version_number), 0) AS added FROM vs)
        SELECT dataset_id, count(*) AS n_versions, min_by(examples_count, version_number) AS first_count, max_by(examples_count, version_number) AS latest_count, coalesce(sum(added), 0)::BIGINT AS total_added, (max(version_number) + 1)::INT AS next_number,
        min_by(examples_count, version_number) = max_by(examples_count, version_number) AS same_content FROM g GROUP BY 1""",
    "version_content_hash": "SELECT md5(sum(('0x' || md5(doc_id || '|' || coalesce(text, ''))[1:15])::HUGEINT)::VARCHAR) AS hash, count(*) AS n FROM documents",
    "versions_compared": """WITH t AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, max(ts) AS last FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN us < 60000000 THEN us // 1000000 || ' seconds' WHEN us < 3600000000 THEN us // 60000000 || ' minutes' WHEN us < 86400000000 THEN us // 3600000000 || ' hours' ELSE us // 86400000000 || ' days' END AS between,
        (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) // 86400000000 <= 7 AS active FROM t""",
    "diff_summary": f"""WITH {_BOTH} SELECT count(*) FILTER (i IS NULL) AS added, count(*) FILTER (j IS NULL) AS removed, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL AND t IS DISTINCT FROM u) AS modified,
        count(*) FILTER (i IS NOT NULL AND j IS NOT NULL AND t IS NOT DISTINCT FROM u) AS unchanged, (SELECT count(*) FROM one) AS total_before, (SELECT count(*) FROM two) AS total_after, (SELECT count(*) FROM two) - (SELECT count(*) FROM one) AS net_change FROM bt""",
    "merge_content": f"WITH {_CT} SELECT coalesce(i, j) AS doc_id, digest FROM f",
    "merge_content_counts": f"WITH {_CT} SELECT count(*) AS total, count(*) FILTER (j IS NULL) AS only_one, count(*) FILTER (i IS NULL) AS only_two, count(*) FILTER (i IS NOT NULL AND j IS NOT NULL) AS common FROM f",
    "merge_conflicts": f"WITH {_BOTH} SELECT i AS doc_id, md5(coalesce(t, '')) AS one, md5(coalesce(u, '')) AS two FROM bt WHERE i IS NOT NULL AND j IS NOT NULL AND t IS DISTINCT FROM u",
    "merge_resolved": f"WITH {_BOTH} SELECT coalesce(i, j) AS doc_id, md5(coalesce(CASE WHEN i IS NULL OR (j IS NOT NULL AND t IS DISTINCT FROM u) THEN u ELSE t END, '')) AS digest FROM bt",
    "last_duplicate_wins": "SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM conversations GROUP BY 1",
    "concatenated": "SELECT doc_id, lang, NULL::INT AS quality, 0 AS source_no FROM documents UNION ALL SELECT doc_id, NULL, quality, 1 FROM labels",
    "generation_totals": f"WITH {_LOG} SELECT {_GEN} FROM lg",
    "provider_histogram": "SELECT event_type AS provider, count(*) AS n FROM events GROUP BY 1",
    "api_totals": f"WITH {_LOG} SELECT count(*) AS calls, round(avg(coalesce(rt, 0)), 2) AS response_time_ms FROM lg",
    "export_totals": f"WITH {_LOG} SELECT count(*) AS exports, count(*) FILTER (success) AS successful, round(100 * count(*) FILTER (success) / count(*), 1) AS success_rate FROM lg",
    "check_totals": f"WITH {_LOG} SELECT count(*) AS checks, sum(ec)::BIGINT AS examples, sum(isf)::BIGINT AS issues, round(avg(sc), 2) AS score FROM lg",
    "log_within": f"WITH {_LOG} SELECT {_GEN} FROM lg WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'",
    "majority_domain": "SELECT max_by(source, (n, -first)) AS source FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "content_stats": f"""WITH {_EX}, c AS (SELECT len(coalesce(conversation, messages))::INT AS turns, length(coalesce(text, content, array_to_string(list_transform(conversation, lambda m: coalesce(m.content, '')), ' '), array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' '), prompt || ' ' || completion, ''))::INT AS chars FROM ex),
        t AS (SELECT *, (chars // 4)::BIGINT AS tokens FROM c) SELECT {_spread('turns')}, {_spread('chars')}, {_spread('tokens')}, sum(tokens)::BIGINT AS tokens_total FROM t""",
    "domain_histogram": "SELECT coalesce(lang, 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1",
    "quality_indicators": f"WITH {_EX}, c AS (SELECT m_score AS score, id % 3 = 0 AS f, k <> 1 AS h FROM ex) SELECT count(*) AS n, {_spread('score')}, count(*) FILTER (f) AS n_flagged, round(100 * count(*) FILTER (f) / count(*), 2) AS flagged_percent, count(*) FILTER (h) AS n_metadata, round(100 * count(*) FILTER (h) / count(*), 2) AS metadata_percent FROM c",
    "compare_sizes": "WITH s AS (SELECT (SELECT count(*) FROM documents) AS one, (SELECT count(*) FROM labels) AS two) SELECT one, two, two - one AS difference, round(two / one, 2) AS ratio FROM s",
    "compare_diversity": f"""WITH x AS (SELECT a.v AS v1, round(a.t, 3) AS t1, round(a.e, 3) AS e1, c.d AS d1, b.v AS v2, round(b.t, 3) AS t2, round(b.e, 3) AS e2, g.d AS d2 FROM {_DIVERSITY.format(_TOKENS, 'documents')} a, {_DIVERSITY.format(_TOKENS, 'conversations')} b, {_SIMPSON.format('source', 'documents')} c, {_SIMPSON.format('role', 'conversations')} g),
        y AS (SELECT *, 0.4::DOUBLE * t1 + 0.3::DOUBLE * e1 / 15 + 0.3::DOUBLE * d1 - (0.4::DOUBLE * t2 + 0.3::DOUBLE * e2 / 15 + 0.3::DOUBLE * d2) AS s FROM x)
        SELECT v2 - v1 AS vocabulary_diff, round(t2 - t1, 3) AS ratio_diff, round(e2 - e1, 3) AS entropy_diff, CASE WHEN abs(s) < 0.05 THEN 'similar' WHEN s > 0 THEN 'dataset1' ELSE 'dataset2' END AS winner FROM y""",
    "message_stats": rf"""WITH {_EX}, {_SAID}, l AS (SELECT *, length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) AS cy, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS la, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS zh FROM mw),
        g AS (SELECT *, CASE WHEN cy + la + zh = 0 THEN 'other' WHEN zh > 0.3 * (cy + la + zh) THEN 'zh' WHEN cy > 0.5 * (cy + la + zh) THEN 'ru' WHEN la > 0.5 * (cy + la + zh) THEN 'en' WHEN cy > 0.2 * (cy + la + zh) AND la > 0.2 * (cy + la + zh) THEN 'mixed' ELSE 'other' END AS lang FROM l),
        s AS (SELECT coalesce(sum(n), 0)::BIGINT AS n_tokens, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(*) FILTER (ans AND regexp_matches(text, '```|`[^`]+`')) AS has_code, count(*) FILTER (ans AND regexp_matches(text, '(?m)^\s*[-*•]\s+|(?m)^\s*[0-9]+\.\s+')) AS has_list,
        count(*) FILTER (ans AND regexp_matches(text, 'https?://[^\s<>"{{}}|\\^`\[\]]+')) AS has_url, count(*) FILTER (ans AND regexp_matches(text, '[0-9]{{3,}}|[0-9]+\.[0-9]+')) AS has_numbers, {', '.join(f'''count(*) FILTER (ans AND lang = '{k}') AS lang_{k}''' for k in ('en', 'ru', 'zh', 'mixed', 'other'))},
        count(*) FILTER (ans AND n = 0) AS empty, count(*) FILTER (ans AND n BETWEEN 1 AND 9) AS very_short, count(*) FILTER (ans AND n > 500) AS very_long FROM g),
        r AS (SELECT list_sum(list_transform(q, lambda text: len({_WORDS}))) AS q, list_sum(list_transform(a, lambda text: len({_WORDS}))) AS a FROM q WHERE len(q) > 0 AND len(a) > 0)
        SELECT (SELECT count(*) FROM ex) AS n_examples, s.*, (SELECT round(coalesce(avg(a / q), 0), 2) FROM r WHERE q > 0) AS qa_ratio FROM s""",
    "json_extracted": f"WITH {_AN} SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 4) THEN props END AS found FROM an",
    "output_format": f"WITH {_AN} SELECT event_id, CASE WHEN trim(text) = '' THEN 'empty' END AS text, CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT json_valid(text) THEN 'json' END AS json, CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '[#*-]|```') THEN 'markdown' END AS markdown FROM an",
    "output_length": "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 500 THEN 'short' WHEN length(coalesce(text, '')) > 3000 THEN 'long' END AS error FROM documents",
    "output_words": "SELECT doc_id, array_to_string(list_filter(['The', 'und', 'que'], lambda w: contains(lower(coalesce(text, '')), lower(w))), ',') AS found, array_to_string(list_filter(['The', 'und', 'que'], lambda w: NOT contains(lower(coalesce(text, '')), lower(w))), ',') AS missing FROM documents",
    "template_references": "SELECT doc_id, CASE WHEN lang IN ('a', 'b', 'en') THEN '' ELSE lang END AS undefined, CASE WHEN lang = 'en' THEN 'b' WHEN lang = 'b' THEN 'en' ELSE 'b,en' END AS unused FROM documents",
    "pii_sensitive": "SELECT doc_id, array_to_string(list_filter(['EMAIL_ADDRESS', 'DATE_TIME', 'PERSON', 'URL', 'US_SSN'], lambda t, i: t NOT IN ('DATE_TIME', 'URL') AND ((doc_id + i - 1) % 10) / 10 >= 0.7::DOUBLE), ',') AS kinds FROM documents",
    "hydrated_examples": f"""WITH {_AN} SELECT event_id AS id, md5(CASE WHEN json_valid(text) THEN text ELSE to_json({{'content': text}})::VARCHAR END) AS digest, NULL::VARCHAR AS status FROM an""",
    "augment_synonym": f"""WITH {_AW}, lx AS (SELECT * FROM (VALUES {_LEXICON}) AS t(k, o)), e AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM w),
        m AS (SELECT e.*, o FROM e LEFT JOIN lx ON lx.k = trim(lower(word), '.,!?;:')), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o IS NULL ORDER BY {_chance("'place:' || i", '4294967296')}, i) AS turn FROM m),
        r AS (SELECT doc_id, i, CASE WHEN o IS NOT NULL AND turn <= greatest(1, floor(n * 0.3::DOUBLE)) THEN CASE WHEN regexp_matches(word[1], '\\p{{Lu}}') THEN upper(s[1]) || s[2:] ELSE s END || regexp_extract(word, '[.,!?;:]*$') ELSE word END AS word, n
        FROM (SELECT *, o[{_chance("'synonym:' || i", 'len(o)')} + 1] AS s FROM p)) SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM r GROUP BY 1""",
    "augment_delete": f"WITH {_AW}, {_drawn('delete')} SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM o WHERE turn < greatest(1, floor(n * 0.9::DOUBLE)) GROUP BY 1",
    "augment_insert": f"""WITH {_AW}, own AS (SELECT doc_id, unnest(range(len(w))) AS i, 0 AS j, unnest(w) AS word FROM w), x AS (SELECT doc_id, w, unnest(range(1, 1 + greatest(1, floor(len(w) * 0.1::DOUBLE))::BIGINT)) AS j FROM w),
        more AS (SELECT doc_id, {_chance("'at:' || j", 'len(w)')} AS i, j, w[{_chance("'word:' || j", 'len(w)')} + 1] AS word FROM x) SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i, j)) AS digest FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY 1""",
    "augment_swap": f"""WITH {_AW}, {_drawn('swap')}, t AS (SELECT a.doc_id, a.word, coalesce(b.i, a.i) AS i FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND a.turn < 2 * greatest(1, floor(a.n * 0.1::DOUBLE)) AND b.turn = xor(a.turn, 1))
        SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM t GROUP BY 1""",
    "augment_back_translation": f"""WITH {_AW}, e AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM w), h AS (SELECT doc_id, i, CASE WHEN {_chance("'hit:' || i", '100')} >= 30 THEN word WHEN {_chance("'how:' || i", '3')} = 1 THEN replace(word, '''', ' ')
        WHEN {_chance("'how:' || i", '3')} = 2 THEN regexp_replace(word, 'ing$', 'e') ELSE word END AS word FROM e) SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM h GROUP BY 1""",
    "augment_contextual": f"""WITH {_AW} SELECT doc_id, md5(replace('{_PRE}', 'very good', ['excellent', 'outstanding', 'superb'][{_chance("'phrase:very good'", '3')} + 1]) || text[{len(_PREFIX) + 1}:]) AS digest FROM w""",
    "exact_sample": "SELECT doc_id FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 50",
    "pairs_in_order": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS pair FROM documents",
    "duplicates_removed": f"SELECT count(*) AS total, count(DISTINCT {_NORMAL}) AS kept, count(*) - count(DISTINCT {_NORMAL}) AS removed FROM documents",
    "keep_first_normal": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORMAL}",
    "jaccard_pairs": f"WITH {_SETS} SELECT a, b FROM pr",
}
