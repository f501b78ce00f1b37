"""Roll-ups of a metric log: per type, per day on a spine without gaps, and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US dollars for 1000 tokens; all others cost nothing.
PRICES = {
    ("openai", "gpt-4"): 0.03,
    ("openai", "gpt-4-turbo-preview"): 0.01,
    ("openai", "gpt-3.5-turbo"): 0.0015,
    ("anthropic", "claude-3-7-sonnet-20250219"): 0.003,
    ("anthropic", "claude-3-5-sonnet-20241022"): 0.003,
    ("anthropic", "claude-3-opus-20240229"): 0.015,
    ("anthropic", "claude-3-haiku-20240307"): 0.00025,
}


def cost(provider: Column, model: Column, tokens: Column) -> Column:
    """US dollars for so many tokens; unknown models cost nothing."""
    rate = F.lit(0.0)
    for (firm, name), price in PRICES.items():
        rate = F.when((F.lower(provider) == firm) & (model == name), price).otherwise(rate)
    return F.coalesce(tokens, F.lit(0)) / 1000 * rate


def daily(log: DataFrame, at: str, measures: list[Column], first: str | None = None, last: str | None = None) -> DataFrame:
    """The measures of each day from the first to the last (by default those of the log);
    days without rows have nulls for the caller to fill. The spine has a row a day."""
    day = F.to_date(at)
    bound = lambda given, of: F.lit(given).cast("date") if given else of(day)
    ends = log.agg(bound(first, F.min).alias("a"), bound(last, F.max).alias("b")).where("a <= b")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day__"))
    each = log.groupBy(day.alias("day__")).agg(*measures)
    return spine.join(each, "day__", "left").withColumn("day__", F.col("day__").cast("string")).withColumnRenamed("day__", "day")


def by_type(log: DataFrame, kind: str, value: str) -> DataFrame:
    """Rows, sum, mean and extremes of a value for each type."""
    return log.groupBy(kind).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 4).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("greatest"),
    )


def top(log: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties to the smaller."""
    return log.groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field).limit(k)


def history(counts: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """Each count's change from the one before; null for the first."""
    before = F.lag(n).over(Window.partitionBy(*keys).orderBy(order))
    return counts.withColumn("added", F.col(n) - before)


def within(log: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of a log from ``start`` to ``end``, both included; rows whose time is no time are left out."""
    when = F.try_to_timestamp(F.col(at).cast("string"))
    return log.where((when >= F.lit(start).cast("timestamp")) & (when <= F.lit(end).cast("timestamp")))


def histogram(log: DataFrame, field: str) -> DataFrame:
    """Rows by value of a field; missing values are ``unknown``."""
    return log.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias(field)).agg(F.count("*").alias("n"))


def generation_totals(log: DataFrame) -> DataFrame:
    """One row of a log of generation jobs: jobs, examples, tokens, cost, hours and examples a job."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = F.count("*")
    return log.agg(
        n.alias("jobs"), total("examples_generated").alias("examples"), total("tokens_used").alias("tokens"), F.round(total("cost_estimate"), 2).alias("cost"),
        F.round(total("duration_seconds") / 3600, 2).alias("hours"), F.when(n > 0, F.round(total("examples_generated") / n, 1)).otherwise(0.0).alias("examples_each"),
    )


def api_totals(log: DataFrame) -> DataFrame:
    """One row of a log of calls: calls and mean response time; a missing time is 0."""
    return log.agg(F.count("*").alias("calls"), F.round(F.coalesce(F.avg(F.coalesce("response_time_ms", F.lit(0.0))), F.lit(0.0)), 2).alias("response_time_ms"))


def export_totals(log: DataFrame) -> DataFrame:
    """One row of a log of exports: exports, successful ones and their percentage."""
    n, good = F.count("*"), F.count_if(F.coalesce("success", F.lit(False)))
    return log.agg(n.alias("exports"), good.alias("successful"), F.when(n > 0, F.round(100 * good / n, 1)).otherwise(0.0).alias("success_rate"))


def check_totals(log: DataFrame) -> DataFrame:
    """One row of a log of quality checks: checks, examples, issues and mean score."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return log.agg(F.count("*").alias("checks"), total("examples_checked").alias("examples"), total("issues_found").alias("issues"), F.round(F.coalesce(F.avg(F.coalesce("average_score", F.lit(0.0))), F.lit(0.0)), 2).alias("score"))


def majority(rows: DataFrame, field: str, order: str) -> DataFrame:
    """One row: the most frequent value of a field; of equally frequent ones that which comes first in ``order``."""
    counts = rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.agg(F.max_by(field, F.struct("n", -F.col("first"))).alias(field))


def coverage(rows: DataFrame, fields: list[str], k: int = 10) -> DataFrame:
    """field, value and n: the ``k`` most frequent values of each field, ties to the smaller, nulls left out. The fields are
    counted in one pass, with partial counts in each task."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    counts = rows.select(F.explode(each).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k).drop("place")
