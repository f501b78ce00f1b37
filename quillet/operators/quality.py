"""Toxicity of a table, its quality score with components and grade, and keep-or-fix decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import safety
from quillet.functions import text as T
from quillet.operators import dedup, stats

#: The weight of each component in the quality score.
WEIGHTS = {"toxicity": 0.30, "deduplication": 0.25, "diversity": 0.25, "completeness": 0.10, "consistency": 0.10}


def detect(rows: DataFrame, text: str = "text", id_field: str = "doc_id", sensitivity: str = "medium") -> DataFrame:
    """Matches of each category, score and is_toxic of each row."""
    told = lambda c: F.struct(*(c[n].cast("long").alias(n) for n in safety.TOXIC), safety.toxicity([c[n] for n in safety.TOXIC]).alias("score"))
    each = rows.select(id_field, T.let(safety.category_counts(F.col(text)), told).alias("found__"))  # one value, so that a filter on the score counts once
    whole = each.select(id_field, *(F.col(f"found__.{n}").alias(n) for n in safety.TOXIC), F.col("found__.score").alias("whole__"))
    return whole.select(id_field, *safety.TOXIC, F.round("whole__", 6).alias("score"), (F.col("whole__") >= safety.THRESHOLDS[sensitivity]).alias("is_toxic"))


def toxicity_totals(found: DataFrame) -> DataFrame:
    """Rows, toxic ones, their percentage, the mean score, and the rows with each category."""
    n, toxic = F.count("*"), F.count_if("is_toxic")
    each = [F.count_if(F.col(c) > 0).alias(c) for c in safety.TOXIC]
    rate = F.when(n > 0, F.round(100 * toxic / n, 2)).otherwise(0.0)
    return found.agg(n.alias("total"), toxic.alias("toxic"), rate.alias("toxic_percentage"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("average_score"), *each)


def decision(score: Column, action: Column, threshold: float = 0.7, auto_remove: bool = True, auto_fix: bool = True, fixed: Column | None = None) -> Column:
    """What becomes of a row that a judge gave a score and an action. No score: error. Rows
    at the threshold or above stay; a fix that gave nothing is an error."""
    fix = F.when(fixed.isNotNull() if fixed is not None else F.lit(False), "fixed").otherwise("error") if auto_fix else F.lit("kept")
    to_fix = (action == "fix") | ((action == "remove") & F.lit(not auto_remove))
    return F.when(score.isNull(), "error").when(score >= threshold, "kept").when((action == "remove") & F.lit(auto_remove), "removed").when(to_fix, fix).otherwise("kept")


def score(rows: DataFrame, text: str = "text", domain: str = "source", metadata: str | None = None) -> DataFrame:
    """One row: the five components from 0 to 100, overall (one digit) and grade.

    Toxicity and duplicates lower theirs by their rate; diversity blends the type-token ratio,
    entropy and the domains' Simpson index; completeness is the share of rows with a text, and
    5 more if over 80 % have metadata; consistency is 100 for one format of rows, else 60."""
    toxic = toxicity_totals(detect(rows, text)).select((100 - F.col("toxic_percentage")).alias("toxicity"))
    copies = dedup.totals(rows, F.col(text)).select(
        F.when(F.col("total") > 0, 100 * F.col("unique_rows") / F.col("total")).otherwise(100.0).alias("deduplication")
    )
    lexical = stats.diversity(stats.token_counts(rows, T.tokens(F.col(text))))
    spread = stats.simpson(rows, domain)
    ttr, entropy = F.least(100 * F.coalesce("ttr", F.lit(0.0)), F.lit(100.0)), F.least(100 * F.coalesce("entropy", F.lit(0.0)) / 12, F.lit(100.0))
    blend = F.when(F.col("simpson") > 0, 0.4 * ttr + 0.3 * entropy + 30 * F.col("simpson")).otherwise(0.6 * ttr + 0.4 * entropy)
    diverse = lexical.join(F.broadcast(spread)).select(blend.alias("diversity"))  # one row each
    filled, n = F.count_if(F.coalesce(text, F.lit("")) != ""), F.count("*")
    more = F.when(F.count_if(F.col(metadata).isNotNull()) > 0.8 * n, 5.0).otherwise(0.0) if metadata else F.lit(0.0)
    whole = rows.agg(F.least(F.when(n > 0, 100 * filled / n).otherwise(100.0) + more, F.lit(100.0)).alias("completeness"))
    out = toxic
    for part in (copies, diverse, whole):  # one row each
        out = out.join(F.broadcast(part))
    out = out.withColumn("consistency", F.lit(100.0 if T.format_of(rows.columns) != "unknown" else 60.0))
    overall = sum(w * F.col(n) for n, w in WEIGHTS.items())
    return out.select(*(F.round(n, 4).alias(n) for n in WEIGHTS), F.round(overall, 1).alias("overall"), T.grade(overall).alias("grade"))


def sided(found: DataFrame) -> DataFrame:
    """Adds ``side``, clean or toxic, to what :func:`detect` gives; a filter on it is either half of the table."""
    return found.withColumn("side", F.when(F.col("is_toxic"), "toxic").otherwise("clean"))
