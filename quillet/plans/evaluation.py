"""Queries over the evaluation of a dataset, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import dedup, evaluation, privacy, quality, stats
from quillet.operators import shapes as S
from quillet.plans import curation, privacy as P, reports
from quillet.plans.examples import examples
from quillet.plans.quality_reports import _sentences


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _turns(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def _bleu(spark, sf_dir: str) -> DataFrame:
    """BLEU of each turn against the one before."""
    tokens = _turns(spark, sf_dir).select("conv_id", "turn", T.tokens(F.col("text"), T.MORE_EDGES).alias("w"))
    before = F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = tokens.withColumn("before", before).where("before IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(evaluation.bleu(F.col("before"), F.col("w"), 2), 6).alias("bleu"))


def _evaluated(spark, sf_dir: str) -> DataFrame:
    bundle = evaluation.diversity_bundle(_turns(spark, sf_dir), id_field="id")
    row = evaluation.evaluated(bundle, stats.message_stats(S.questions_and_answers(examples(spark, sf_dir))))
    return row.select("overall_diversity", "overall_quality", F.array_join("recommendations", "\n").alias("recommendations"), F.array_join("warnings", "\n").alias("warnings"))


def _summary(spark, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    personal = privacy.totals(docs.select(privacy.spans(F.col("text"), 1.0, P.CERTAIN).alias("pii")))
    return evaluation.summary(quality.toxicity_totals(quality.detect(docs, sensitivity="high")), personal, dedup.totals(docs, F.col("text")))


def _first_words(spark, sf_dir: str) -> DataFrame:
    """The 20 most frequent words, ties to the one that comes first."""
    return stats.top_words(_docs(spark, sf_dir), "text", "doc_id")


QUERIES = {
    "diversity_bundle": lambda s, d: evaluation.diversity_bundle(_turns(s, d), id_field="id"),
    "bleu_of_turns": _bleu,
    "evaluation_scores": _evaluated,
    "quality_summary": _summary,
    "top_words_in_order": _first_words,
}

_W = curation._WORDS
_MARKS = T.MORE_EDGES.replace("'", "''")
_TOKENS = f"list_filter(list_transform({_W}, lambda w: trim(w, '{_MARKS}')), lambda w: w <> '')"


def _grams(rows: str, most: int) -> str:
    """i, n, gram and c of the token lists of a table with i and w."""
    one = "SELECT i, {n} AS n, unnest(list_transform(range(1, len(w) - {m}), lambda k: array_to_string(w[k:k + {k}], ' '))) AS gram FROM {rows}"
    return "SELECT i, n, gram, count(*) AS c FROM (" + " UNION ALL ".join(one.format(n=n, m=n - 2, k=n - 1, rows=rows) for n in range(1, most + 1)) + ") GROUP BY ALL"


_BUNDLE = f"""WITH t AS (SELECT conv_id * 1000 + turn AS i, {_TOKENS} AS w FROM conversations),
    k AS (SELECT i, w FROM (SELECT * FROM t ORDER BY md5(i::VARCHAR), i LIMIT 500) WHERE len(w) > 0),
    g AS ({_grams('k', 3)}),
    hits AS (SELECT a.i, b.i AS j, a.n, sum(least(a.c, b.c)) AS x FROM g a JOIN g b ON a.n = b.n AND a.gram = b.gram AND a.i <> b.i GROUP BY 1, 2, 3),
    o AS (SELECT i, j, len(h.w) AS h, len(r.w) AS r, sum(ln(x / (len(h.w) - n + 1))) FILTER (n <= 1) AS l1, count(*) FILTER (n <= 1) AS c1, sum(ln(x / (len(h.w) - n + 1))) FILTER (n <= 2) AS l2, count(*) FILTER (n <= 2) AS c2,
        sum(ln(x / (len(h.w) - n + 1))) AS l3, count(*) AS c3 FROM hits JOIN k AS h USING (i) JOIN k AS r ON r.i = j GROUP BY 1, 2, 3, 4),
    b AS (SELECT i, {", ".join(f"max(CASE WHEN c{n} = least({n}, h) THEN exp(l{n} / least({n}, h)) * CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END ELSE 0 END) AS b{n}" for n in (1, 2, 3))} FROM o GROUP BY 1),
    s AS (SELECT {", ".join(f"sum(b{n}) / (SELECT count(*) FROM k) AS s{n}" for n in (1, 2, 3))} FROM b),
    d AS (SELECT {", ".join(f"count(DISTINCT gram) FILTER (n = {n}) / sum(c) FILTER (n = {n}) AS d{n}" for n in (1, 2, 3))}, count(DISTINCT gram) FILTER (n = 1) AS v, (sum(c) FILTER (n = 1))::BIGINT AS n FROM ({_grams('t', 3)}))
    SELECT {", ".join(f"round(d{n}, 4) AS distinct_{n}" for n in (1, 2, 3))}, {", ".join(f"round(s{n}, 4) AS self_bleu_{n}" for n in (1, 2, 3))}, round((s1 + s2 + s3) / 3, 4) AS self_bleu_avg, v AS vocabulary_size, n AS total_tokens,
        round(((d1 + d2 + d3) / 3 + 1 - (s1 + s2 + s3) / 3) / 2, 4) AS diversity_score FROM d, s"""

_ZEROS = "0 AS num_clusters, 0.0 AS largest_cluster_ratio, 0.0 AS largest_cluster_percent"
_ALL = f"a AS (SELECT *, {_ZEROS}, vocabulary_size / total_tokens AS v FROM ({_BUNDLE}), ({reports.ORACLE_SQL['message_stats']}))"
_SCORES = f"""{_ALL}, e AS (SELECT *, round((least((distinct_1 + distinct_2 + distinct_3) / 3 * 2, 1) + 1 - self_bleu_avg + least(v * 5, 1)) / 3, 4) AS overall_diversity,
    round((1 - empty / n_examples + 1 - least(very_short / n_examples, 0.5) * 2 + CASE WHEN qa_ratio > 0 THEN least(qa_ratio / 3, 1) ELSE 0 END + diversity_score + least(v * 3, 1)) / (4 + (qa_ratio > 0)::INT), 4) AS overall_quality FROM a)"""
_ADVICE = _sentences(evaluation.ADVICE)

ORACLE_SQL = {
    "diversity_bundle": _BUNDLE,
    "bleu_of_turns": f"""WITH t AS (SELECT conv_id * 1000 + turn AS i, conv_id, turn, {_TOKENS} AS w FROM conversations), p AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY turn) AS j, lag(len(w)) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t),
        g AS ({_grams('t', 2)}), x AS (SELECT p.i, a.n, sum(least(a.c, b.c)) AS x FROM p JOIN g a ON a.i = p.i JOIN g b ON b.i = p.j AND b.n = a.n AND b.gram = a.gram GROUP BY 1, 2),
        s AS (SELECT i, count(*) AS c, sum(ln(x / (len(w) - n + 1))) AS l FROM x JOIN p USING (i) GROUP BY 1)
        SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR r = 0 OR coalesce(c, 0) < least(2, len(w)) THEN 0 ELSE exp(l / least(2, len(w))) * CASE WHEN len(w) >= r THEN 1 ELSE exp(1 - r / len(w)) END END, 6) AS bleu FROM p LEFT JOIN s USING (i) WHERE j IS NOT NULL""",
    "evaluation_scores": f"""WITH {_SCORES} SELECT overall_diversity, overall_quality, array_to_string(CASE WHEN len({_ADVICE}) > 0 THEN {_ADVICE} ELSE ['{evaluation.NO_ADVICE}'] END, chr(10)) AS recommendations, array_to_string({_sentences(evaluation.WARNINGS)}, chr(10)) AS warnings FROM e""",
    "quality_summary": f"""SELECT t.total AS total_examples, toxic AS toxic_count, toxic_percentage, pii_count, pii_percentage, n_groups AS duplicate_groups, duplicates AS total_duplicates, rate AS duplicate_percentage
        FROM ({curation.ORACLE_SQL['toxicity_stats']}) AS t, ({P.ORACLE_SQL['pii_totals']}), (WITH g AS (SELECT count(*) AS n FROM documents GROUP BY coalesce(text, ''))
        SELECT (sum(n) - count(*))::BIGINT AS duplicates, round(100.0 * (sum(n) - count(*)) / sum(n), 2)::DOUBLE AS rate, count(*) FILTER (n > 1) AS n_groups FROM g)""",
    "top_words_in_order": f"""SELECT word, count(*) AS n FROM (SELECT doc_id, unnest({_W}) AS word, unnest(range(len({_W}))) AS pos FROM documents) GROUP BY 1 ORDER BY n DESC, min(doc_id * 10000000 + pos) LIMIT 20""",
}
