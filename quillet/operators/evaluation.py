"""Evaluation of a dataset: BLEU, self-BLEU, the diversity bundle, overall scores with advice, summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import stats
from quillet.operators.reports import Rule, sentences

#: Texts that self-BLEU compares, each with each: the measure's own sample.
SAMPLE = 500


def grams(tokens: list[str], most: int) -> list[Counter]:
    """Counts of the 1-grams up to ``most``-grams."""
    return [Counter(zip(*(tokens[k:] for k in range(n)))) for n in range(1, most + 1)]


def bleus(reference: list[Counter], hypothesis: list[Counter], r: int, h: int) -> list[float]:
    """BLEU with 1-grams, with 1- and 2-grams, and so on: the geometric mean of the clipped precisions, of no more
    orders than the hypothesis has tokens, times the brevity penalty; 0 once a precision is."""
    if not r or not h:
        return [0.0] * len(hypothesis)
    penalty, total, out = (1.0 if h >= r else math.exp(1 - r / h)), 0.0, []
    for n, (a, b) in enumerate(zip(hypothesis, reference), 1):
        if n <= h and total > -math.inf:
            hits = sum(min(c, b[g]) for g, c in a.items() if g in b)
            total += math.log(hits / (h - n + 1)) if hits else -math.inf
        out.append(penalty * math.exp(total / min(n, h)))
    return out


def bleu(reference: Column, hypothesis: Column, most: int = 4) -> Column:
    """BLEU of two arrays of tokens; 0 if one is null or empty. N-grams are counted in Python, by Arrow batches: with
    array functions they would be compared each with each."""

    @F.pandas_udf("double")
    def score(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        def one(r, h) -> float:
            r, h = (list(x) if x is not None else [] for x in (r, h))
            return bleus(grams(r, most), grams(h, most), len(r), len(h))[-1]

        return pd.Series([one(r, h) for r, h in zip(refs, hyps)], dtype="float64")

    return score(reference, hypothesis)


def self_bleu(rows: DataFrame, text: str = "text", id_field: str = "doc_id", most: int = 3, size: int = SAMPLE) -> DataFrame:
    """One row, self_bleu_1 to self_bleu_``most`` and their mean self_bleu_avg, of four digits: over the sampled texts with
    tokens, the mean of each one's greatest BLEU against the others; 0 if there is no other.

    The sample, ``size`` rows drawn by a hash of the id, is part of the measure; its token lists go to every
    task, and the tasks share the texts to be scored."""
    drawn = rows.orderBy(F.md5(F.col(id_field).cast("string").cast("binary")), id_field).limit(size)
    tokens = [r["w"] for r in drawn.select(T.tokens(F.col(text), T.MORE_EDGES).alias("w")).collect() if r["w"]]  # ``size`` at most
    spark, names = rows.sparkSession, [f"self_bleu_{n}" for n in range(1, most + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [grams(w, most) for w in tokens]
        for batch in batches:
            best = []
            for i in batch.column(0).to_pylist():
                each = [bleus(counts[j], counts[i], len(tokens[j]), len(tokens[i])) for j in range(len(tokens)) if j != i]
                best.append([max(x) for x in zip(*each)])
            yield pa.RecordBatch.from_arrays([pa.array([b[n] for b in best], pa.float64()) for n in range(most)], names=names)

    n = len(tokens) if len(tokens) > 1 else 0
    scored = spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, ", ".join(f"{c} double" for c in names))
    means = scored.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names))
    average = reduce(Column.__add__, map(F.col, names)) / most
    return means.select(*(F.round(c, 4).alias(c) for c in names), average.alias("self_bleu_raw"))


def diversity_bundle(rows: DataFrame, text: str = "text", id_field: str = "doc_id", size: int = SAMPLE) -> DataFrame:
    """One row: distinct_1 to 3, self_bleu_1 to 3 and their mean, vocabulary_size, total_tokens and
    diversity_score, the mean of the mean distinct ratio and of what self-BLEU leaves of 1; all zeros for an empty table.
    Ratios and tokens are of all rows, self-BLEU of its sample."""
    parts = [stats.distinct_n(rows, text, n).select(F.coalesce(F.col("distinct_grams") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias(f"d{n}"), F.col("total").alias(f"t{n}"), F.col("distinct_grams").alias(f"v{n}")) for n in (1, 2, 3)]
    out = self_bleu(rows, text, id_field, 3, size)
    for part in parts:  # one row each
        out = out.crossJoin(F.broadcast(part))
    distinct = (F.col("d1") + F.col("d2") + F.col("d3")) / 3
    score = F.when(F.col("t1") > 0, F.round((distinct + 1 - F.col("self_bleu_raw")) / 2, 4)).otherwise(0.0)
    return out.select(*(F.round(f"d{n}", 4).alias(f"distinct_{n}") for n in (1, 2, 3)), "self_bleu_1", "self_bleu_2", "self_bleu_3", F.round("self_bleu_raw", 4).alias("self_bleu_avg"), F.col("v1").alias("vocabulary_size"), F.col("t1").alias("total_tokens"), score.alias("diversity_score"))


#: Advice over a dataset's measures.
ADVICE = [
    Rule("self_bleu_avg > 0.5", "High Self-BLEU score indicates similar examples. Consider adding more varied content or rephrasing existing examples."),
    Rule("distinct_1 < 0.3", "Low Distinct-1 score. Dataset uses repetitive vocabulary. Try using synonyms and varied phrasing."),
    Rule("very_short > n_examples * 0.2", "%d examples have very short responses (<10 words). Consider expanding these with more detailed answers.", ("very_short",)),
    Rule("qa_ratio < 1.5", "Answers are relatively short compared to questions. For training, longer, more detailed responses often work better."),
    Rule("largest_cluster_ratio > 0.4", "One topic dominates %.0f%% of the dataset. Consider adding examples from other topics for better balance.", ("largest_cluster_percent",)),
    Rule("num_clusters < 3 AND n_examples > 50", "Dataset has low topic diversity. Consider adding examples covering different subjects or use cases."),
    Rule("overall_diversity < 0.4", "Overall diversity is low. Use data augmentation or add more varied examples."),
    Rule("overall_quality < 0.5", "Overall quality score is below average. Review and improve low-quality examples."),
]
NO_ADVICE = "Dataset shows good quality and diversity. Ready for training!"

#: Warnings over the same.
WARNINGS = [
    Rule("empty > 0", "⚠️ %d examples have empty responses", ("empty",)),
    Rule("n_examples < 100", "⚠️ Dataset is small (<100 examples). May not be sufficient for fine-tuning."),
    Rule("vocabulary_size < 500", "⚠️ Very limited vocabulary. Dataset may be too narrow."),
    Rule("lang_mixed > 0", "⚠️ Dataset contains mixed languages. Ensure this is intentional."),
]


def evaluated(diversity: DataFrame, messages: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row from a row each of :func:`diversity_bundle`, ``stats.message_stats`` and ``clusters.analysis`` (none: zeros):
    all of their columns, overall_diversity, overall_quality, and the arrays recommendations and warnings."""
    zeros = {"num_clusters": 0, "outlier_count": 0, "avg_cluster_size": 0.0, "largest_cluster_ratio": 0.0, "semantic_diversity": 0.0}
    out = diversity.crossJoin(F.broadcast(messages))  # one row each
    out = out.crossJoin(F.broadcast(clusters)) if clusters is not None else out.withColumns({k: F.lit(v) for k, v in zeros.items()})
    mean = lambda parts: F.round(F.aggregate(F.array_compact(F.array(*parts)), F.lit(0.0), lambda a, x: a + x, lambda a: a) / F.size(F.array_compact(F.array(*parts))), 4)
    at_most = lambda c: F.least(c, F.lit(1.0))
    ratio = F.when(F.col("total_tokens") > 0, F.col("vocabulary_size") / F.col("total_tokens"))
    distinct = (F.col("distinct_1") + F.col("distinct_2") + F.col("distinct_3")) / 3
    overall = mean([at_most(distinct * 2), 1 - F.col("self_bleu_avg"), F.when(F.col("semantic_diversity") > 0, F.col("semantic_diversity")), at_most(ratio * 5)])
    share = lambda c: F.col(c) / F.col("n_examples")
    quality = mean([1 - share("empty"), 1 - F.least(share("very_short"), F.lit(0.5)) * 2, F.when(F.col("qa_ratio") > 0, at_most(F.col("qa_ratio") / 3)), F.col("diversity_score"), at_most(ratio * 3)])
    out = out.withColumns({"overall_diversity": overall, "overall_quality": F.when(F.col("n_examples") > 0, quality).otherwise(0.0), "largest_cluster_percent": 100 * F.col("largest_cluster_ratio")})
    advice = sentences(ADVICE)
    return out.withColumns({"recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NO_ADVICE))), "warnings": sentences(WARNINGS)}).drop("largest_cluster_percent")


def summary(toxicity: DataFrame, personal: DataFrame, copies: DataFrame) -> DataFrame:
    """One row from the totals of toxicity, personal data and duplicates: how many examples, and how many and what share of
    them each check finds."""
    found = toxicity.select(F.col("total").alias("total_examples"), F.col("toxic").alias("toxic_count"), "toxic_percentage")
    own = personal.select("pii_count", "pii_percentage")
    groups = copies.select(F.col("n_groups").alias("duplicate_groups"), F.col("duplicates").alias("total_duplicates"), F.col("rate").alias("duplicate_percentage"))
    return found.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(groups))  # one row each
