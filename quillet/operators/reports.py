"""Quality reports: measures of a table, component scores, rules that turn them into sentences, comparisons."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import dedup, quality, stats


class Rule(NamedTuple):
    """A sentence that holds under a condition over the measures; ``fields`` fill its printf marks in turn."""

    condition: str
    message: str
    fields: tuple[str, ...] = ()


#: What counts against a table, by component and in this order.
ISSUES = [
    Rule("toxic_rate > 0.1", "High toxicity rate: %s%%", ("toxic_percentage",)),
    Rule("toxic_rate > 0.05 AND toxic_rate <= 0.1", "Moderate toxicity detected: %s%%", ("toxic_percentage",)),
    Rule("n_pii > 0", "PII (Personal Identifiable Information) detected"),
    Rule("dup_rate > 0.2", "High duplication rate: %.1f%%", ("dup_percentage",)),
    Rule("dup_rate > 0.1 AND dup_rate <= 0.2", "Moderate duplication: %.1f%%", ("dup_percentage",)),
    Rule("lexical < 0.4", "Low lexical diversity - examples may be too similar"),
    Rule("vocabulary < 500", "Small vocabulary: %d unique tokens", ("vocabulary",)),
    Rule("domains > 0 AND domains < 0.3", "Low domain diversity"),
    Rule("empty_rate > 0.05", "%d examples with missing content", ("n_empty",)),
    Rule("metadata_rate < 0.5", "Low metadata coverage: %.1f%%", ("metadata_percentage",)),
    Rule("n_formats NOT IN (1, 2)", "Mixed formats detected: %d different types", ("n_formats",)),
]

#: What speaks for a table.
STRENGTHS = [
    Rule("toxic_rate < 0.01", "Excellent toxicity control - dataset is very clean"),
    Rule("toxic_rate >= 0.01 AND toxic_rate < 0.05", "Good toxicity control"),
    Rule("dup_rate < 0.05", "Excellent deduplication - minimal duplicates"),
    Rule("dup_rate >= 0.05 AND dup_rate < 0.1", "Good deduplication"),
    Rule("lexical > 0.7", "Excellent lexical diversity"),
    Rule("vocabulary > 10000", "Rich vocabulary: %,d unique tokens", ("vocabulary",)),
    Rule("empty_rate = 0", "Complete dataset - no empty examples"),
    Rule("metadata_rate > 0.8", "Excellent metadata coverage"),
    Rule("n_formats = 1", "Consistent format across all examples"),
]

#: Advice that follows from the component scores.
ADVICE = [
    Rule("toxicity < 80", "Run toxicity filtering to remove harmful content"),
    Rule("deduplication < 80", "Remove duplicate examples to improve dataset quality"),
    Rule("diversity < 70", "Add more diverse examples to improve coverage"),
    Rule("completeness < 90", "Fill in missing fields and add metadata"),
    Rule("consistency < 80", "Standardize format across all examples"),
    Rule("overall < 70", "Dataset needs significant quality improvements before production use"),
    Rule("overall >= 70 AND overall < 85", "Dataset is acceptable but has room for improvement"),
]
NO_ADVICE = "Dataset meets high quality standards. Ready for use!"

#: Advice of the whole report, which comes first.
URGENT = [
    Rule("toxic_percentage > 5", "CRITICAL: Remove toxic content (%s%% toxic rate)", ("toxic_percentage",)),
    Rule("n_pii > 0", "CRITICAL: Remove Personal Identifiable Information (PII)"),
    Rule("dup_percentage > 10", "HIGH: Remove duplicates (%.1f%% duplication)", ("dup_percentage",)),
    Rule("lexical < 0.4", "MEDIUM: Improve diversity - add more varied examples"),
]


def sentences(rules: list[Rule]) -> Column:
    """The sentences of the rules that hold, in their order: one expression over the measures' row."""
    return F.array_compact(F.array(*(F.when(F.expr(r.condition), F.format_string(r.message, *map(F.col, r.fields))) for r in rules)))


def row_format(columns: list[str]) -> Column:
    """The format of a row by the fields that it has: conversation, instruction, prompt-completion, text or null."""
    has = lambda *names: reduce(Column.__or__, (F.col(n).isNotNull() for n in names if n in columns), F.lit(False))
    return F.when(has("conversation", "messages"), "conversation").when(has("instruction"), "instruction").when(has("prompt"), "prompt-completion").when(has("text", "content"), "text")


def measures(rows: DataFrame, text: str = "text", id_field: str = "doc_id", domain: str = "source", metadata: str | None = None) -> DataFrame:
    """One row: what the rules look at. Rates of an empty table are 0.

    toxic_percentage (two digits) and toxic_rate, n_pii (rows with the pattern category), dup_rate and
    dup_percentage (rows that repeat an earlier text), vocabulary, lexical (type-token ratio), entropy, domains
    (Simpson index, 0 if there is no domain), n_empty and empty_rate, metadata_rate and metadata_percentage,
    n_formats and n. Each part is an aggregate of one row."""
    toxic = quality.toxicity_totals(quality.detect(rows, text, id_field)).select("toxic_percentage", (F.col("toxic_percentage") / 100).alias("toxic_rate"), F.col("pii").alias("n_pii"))
    rate = F.when(F.col("total") > 0, F.col("duplicates") / F.col("total")).otherwise(0.0)
    copies = dedup.totals(rows, F.col(text)).select(rate.alias("dup_rate"), (100 * rate).alias("dup_percentage"))
    lexical = stats.diversity(stats.token_counts(rows, T.tokens(F.col(text)))).select(
        "vocabulary", F.coalesce("ttr", F.lit(0.0)).alias("lexical"), F.coalesce("entropy", F.lit(0.0)).alias("entropy")
    )
    spread = stats.simpson(rows, domain).select(F.coalesce("simpson", F.lit(0.0)).alias("domains"))
    n, empty = F.count("*"), F.count_if(F.coalesce(text, F.lit("")) == "")
    described = F.count_if(F.col(metadata).isNotNull()) if metadata else F.lit(0)
    share = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    form = row_format(rows.columns)
    whole = rows.agg(
        empty.alias("n_empty"), share(empty).alias("empty_rate"), share(described).alias("metadata_rate"), (100 * share(described)).alias("metadata_percentage"),
        F.count_distinct(form).alias("n_formats"), n.alias("n"),
    )
    out = toxic
    for part in (copies, lexical, spread, whole):  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


COMPONENTS = list(quality.WEIGHTS)


def scored(found: DataFrame) -> DataFrame:
    """Adds the components (0 to 100), overall, grade and status to a row of measures."""
    ttr, entropy = F.least(100 * F.col("lexical"), F.lit(100.0)), F.least(100 * F.col("entropy") / 12, F.lit(100.0))
    bonus = F.when(F.col("metadata_rate") > 0.8, 5.0).otherwise(0.0)
    out = found.withColumns(
        {
            "toxicity": 100 * (1 - F.col("toxic_rate")), "deduplication": 100 * (1 - F.col("dup_rate")),
            "diversity": F.when(F.col("domains") > 0, 0.4 * ttr + 0.3 * entropy + 30 * F.col("domains")).otherwise(0.6 * ttr + 0.4 * entropy),
            "completeness": F.least(100 * (1 - F.col("empty_rate")) + bonus, F.lit(100.0)), "consistency": F.when(F.col("n_formats") == 1, 100.0).when(F.col("n_formats") == 2, 80.0).otherwise(60.0),
        }
    )
    overall = F.round(sum(w * F.col(n) for n, w in quality.WEIGHTS.items()), 1)
    status = F.when(F.col("overall") >= 85, "READY FOR PRODUCTION").when(F.col("overall") >= 70, "NEEDS IMPROVEMENT").otherwise("NOT READY")
    out = out.withColumn("overall", overall)
    return out.withColumns({"grade": T.grade(F.col("overall")), "status": status})


def report(rows: DataFrame, **fields) -> DataFrame:
    """One row: measures, components, overall, grade, status, and the arrays issues, strengths and recommendations. What is
    urgent comes first; a sentence that follows from several rules stands once, at its first place."""
    out = scored(measures(rows, **fields))
    advice = sentences(ADVICE)
    own = F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NO_ADVICE)))
    return out.withColumns({"issues": sentences(ISSUES), "strengths": sentences(STRENGTHS), "recommendations": F.array_distinct(F.concat(sentences(URGENT), own))})


def messages(reports: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, place (from 1) and message: a row for each sentence."""
    kinds = ("issues", "strengths", "recommendations")
    of = lambda kind: lambda m, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("place"), m.alias("message"))
    each = F.concat(*(F.transform(k, of(k)) for k in kinds))
    return reports.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """component, dataset1, dataset2, difference and winner, for each component and overall, from a report row of
    each. The second wins only if it is better."""
    parts = [*COMPONENTS, "overall"]
    sides = [df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias(name)) for c in parts))).alias("x")).select("x.*") for df, name in ((one, "dataset1"), (two, "dataset2"))]
    both = sides[0].join(F.broadcast(sides[1]), "component")  # six rows each
    apart = F.col("dataset2") - F.col("dataset1")
    return both.select("component", F.round("dataset1", 4).alias("dataset1"), F.round("dataset2", 4).alias("dataset2"), F.round(apart, 4).alias("difference"), F.when(apart > 0, "dataset2").otherwise("dataset1").alias("winner"))
