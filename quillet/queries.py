"""The queries over the reference's own operators, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import algebra, dedup, export, stats
from quillet.plans import catalog, clusters, curation, details, evaluation, examples, privacy, quality_reports, reports, streams

FLAGSHIP = "exact_duplicates"


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _turns(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _versions(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of all documents: in the second some ids have moved by a million, so that they
    are removed and added, and some texts have changed."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    moved = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
    return docs, docs.select(moved.alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("+"), "text")).otherwise(F.col("text")).alias("text"))


def _merged(strategy: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return algebra.merge(*_versions(spark, sf_dir), "doc_id", strategy).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "conflict")

    return query


def _patched(spark, sf_dir: str) -> DataFrame:
    one, two = _versions(spark, sf_dir)
    changes = algebra.diff(one, two, "doc_id")
    of = lambda kind: changes.where(F.col("change") == kind)
    new = lambda kind: two.join(of(kind).select("doc_id"), "doc_id", "left_semi")
    return algebra.apply_patch(one, "doc_id", of("removed"), new("modified"), new("added")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {
    "exact_duplicates": lambda s, d: dedup.groups(_docs(s, d), F.coalesce("text", F.lit(""))),
    "fuzzy_duplicates": lambda s, d: dedup.groups(_docs(s, d), T.normal(F.col("text"))),
    "dedup_stats": lambda s, d: dedup.totals(_docs(s, d), F.col("text")),
    "keep_first": lambda s, d: dedup.keep_first(_docs(s, d), F.col("text")).select("doc_id", "lang", "source"),
    "latest_per_key": lambda s, d: dedup.latest(_turns(s, d), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role"),
    "diversity_tokens": lambda s, d: stats.diversity(stats.token_counts(_docs(s, d), T.tokens(F.col("text")))),
    "simpson": lambda s, d: stats.simpson(_docs(s, d), "source"),
    "distinct_1": lambda s, d: stats.distinct_n(_docs(s, d), "text", 1),
    "distinct_2": lambda s, d: stats.distinct_n(_docs(s, d), "text", 2),
    "distinct_3": lambda s, d: stats.distinct_n(_docs(s, d), "text", 3),
    "length_distribution": lambda s, d: stats.length_distribution(_docs(s, d), F.length("text")),
    "token_estimate": lambda s, d: _docs(s, d).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens")),
    "top_words": lambda s, d: stats.token_counts(_docs(s, d), T.words(F.col("text"))).orderBy(F.desc("n"), "item").limit(20),
    "pattern_flags": lambda s, d: _docs(s, d).select("doc_id", *(c.alias(n) for n, c in T.flags(F.col("text")).items())),
    "conversation_stats": lambda s, d: stats.conversation_stats(_turns(s, d)),
    "role_counts": lambda s, d: _turns(s, d).groupBy("role").agg(F.count("*").alias("n")),
    "diff_by_id": lambda s, d: algebra.diff(*_versions(s, d), "doc_id"),
    "merge_union": _merged("union"),
    "merge_intersection": _merged("intersection"),
    "merge_prefer1": _merged("prefer1"),
    "merge_prefer2": _merged("prefer2"),
    "apply_patch": _patched,
    "to_qa_pairs": lambda s, d: export.qa_pairs(_turns(s, d)).select("conv_id", F.md5(F.col("question").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer")),
    "chunk_documents": lambda s, d: export.chunks(_docs(s, d)).select("doc_id", "chunk", "n_chunks", F.md5(F.col("piece").cast("binary")).alias("digest")),
    **curation.QUERIES, **clusters.QUERIES, **streams.QUERIES, **quality_reports.QUERIES, **privacy.QUERIES, **evaluation.QUERIES, **catalog.QUERIES, **details.QUERIES,
    **examples.QUERIES,
    **reports.QUERIES,
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_ONE = "one AS (SELECT doc_id, text FROM documents)"
_TWO = "two AS (SELECT CASE WHEN doc_id % 7 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '+' || text ELSE text END AS text FROM documents)"
_PUNCT = T.PUNCTUATION.replace("'", "''")
_MARKS = T.EDGES


_TOKENS = f"list_filter(list_transform({_WORDS}, lambda w: trim(w, '{T.EDGES}')), lambda w: w <> '')"


def _grams_sql(n: int) -> str:
    marks = T.MORE_EDGES.replace("'", "''")
    return f"""WITH t AS (SELECT list_filter(list_transform({_WORDS}, lambda w: trim(w, '{marks}')), lambda w: w <> '') AS w FROM documents),
        g AS (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM t)
        SELECT count(*) AS total, count(DISTINCT g) AS distinct_grams, round(count(DISTINCT g) / count(*), 4) AS ratio FROM g"""


def _merge_sql(text: str, join: str = "FULL JOIN") -> str:
    return f"""WITH {_ONE}, {_TWO} SELECT coalesce(one.doc_id, two.doc_id) AS doc_id, md5({text}) AS digest,
        one.doc_id IS NOT NULL AND two.doc_id IS NOT NULL AND one.text IS DISTINCT FROM two.text AS conflict
        FROM one {join} two ON one.doc_id = two.doc_id"""


_FIRST = "CASE WHEN one.doc_id IS NOT NULL THEN one.text ELSE two.text END"
_SECOND = "CASE WHEN two.doc_id IS NOT NULL THEN two.text ELSE one.text END"

ORACLE_SQL = {
    "exact_duplicates": "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY coalesce(text, ''), 1 HAVING count(*) > 1",
    "fuzzy_duplicates": f"SELECT md5(translate(array_to_string({_WORDS}, ' '), '{_PUNCT}', '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "dedup_stats": """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, ''))
        SELECT sum(n)::BIGINT AS total, count(*) AS unique_rows, (sum(n) - count(*))::BIGINT AS duplicates,
        round(100.0 * (sum(n) - count(*)) / sum(n), 2)::DOUBLE AS rate, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest FROM g""",
    "keep_first": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1",
    "latest_per_key": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "diversity_tokens": f"""WITH c AS (SELECT item, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS item FROM documents) GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_tokens, count(*) AS vocabulary, round(log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n), 6) AS entropy,
        round(CASE WHEN sum(n) > 1000 THEN count(*) / sqrt(sum(n)) ELSE count(*) / sum(n) END, 6) AS ttr FROM c""",
    "simpson": "WITH c AS (SELECT count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT round(1 - sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE, 6) AS simpson FROM c",
    **{f"distinct_{n}": _grams_sql(n) for n in (1, 2, 3)},
    "length_distribution": """SELECT min(length(text))::INT AS least, max(length(text))::INT AS greatest, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS deviation,
        quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.75) AS p75, quantile_cont(length(text), 0.9) AS p90 FROM documents""",
    "token_estimate": "SELECT doc_id, length(coalesce(text, '')) // 4 AS n_tokens FROM documents",
    "top_words": f"SELECT item, count(*) AS n FROM (SELECT unnest({_WORDS}) AS item FROM documents) GROUP BY 1 ORDER BY n DESC, item LIMIT 20",
    "pattern_flags": r"""SELECT doc_id, coalesce(regexp_matches(text, '```|`[^`]+`'), false) AS has_code, coalesce(regexp_matches(text, '(?m)^\s*[-*•]\s+|(?m)^\s*[0-9]+\.\s+'), false) AS has_list,
        coalesce(regexp_matches(text, 'https?://[^\s<>"{}|\\^`\[\]]+'), false) AS has_url, coalesce(regexp_matches(text, '[0-9]{3,}|[0-9]+\.[0-9]+'), false) AS has_numbers FROM documents""",
    "conversation_stats": """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role IN ('user', 'human')) AS n_user, count(*) FILTER (role IN ('assistant', 'bot', 'gpt')) AS n_assistant,
        coalesce(sum(length(text)), 0)::BIGINT AS n_chars, sum(length(coalesce(text, '')) // 4)::BIGINT AS n_tokens FROM conversations GROUP BY conv_id""",
    "role_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY role",
    "diff_by_id": f"""WITH {_ONE}, {_TWO} SELECT coalesce(one.doc_id, two.doc_id) AS doc_id, CASE WHEN one.doc_id IS NULL THEN 'added' WHEN two.doc_id IS NULL THEN 'removed'
        WHEN one.text IS DISTINCT FROM two.text THEN 'modified' ELSE 'unchanged' END AS change FROM one FULL JOIN two ON one.doc_id = two.doc_id""",
    "merge_union": _merge_sql(_FIRST),
    "merge_intersection": _merge_sql("one.text", "JOIN"),
    "merge_prefer1": _merge_sql(_FIRST),
    "merge_prefer2": _merge_sql(_SECOND),
    "apply_patch": f"WITH {_TWO} SELECT doc_id, md5(text) AS digest FROM two",
    "to_qa_pairs": """WITH u AS (SELECT conv_id, min(turn) AS start_turn, min_by(text, turn) AS q FROM conversations WHERE role IN ('user', 'human') AND text <> '' GROUP BY 1)
        SELECT c.conv_id, md5(any_value(q)) AS question, md5(min_by(c.text, turn)) AS answer FROM conversations c JOIN u ON c.conv_id = u.conv_id AND turn > start_turn
        WHERE role IN ('assistant', 'bot', 'ai') AND text <> '' GROUP BY 1""",
    "chunk_documents": """WITH s AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN length(text) > 1000 THEN range(0, length(text), 800) ELSE [0] END AS starts FROM documents),
        e AS (SELECT doc_id, text, len(starts) AS n_chunks, unnest(starts) AS pos FROM s)
        SELECT doc_id, (pos // 800)::BIGINT AS chunk, n_chunks, md5(substring(text, (pos + 1)::BIGINT, 1000)) AS digest FROM e""",
}
for _more in (curation, examples, reports, clusters, streams, quality_reports, privacy, evaluation, catalog, details):
    ORACLE_SQL |= _more.ORACLE_SQL
