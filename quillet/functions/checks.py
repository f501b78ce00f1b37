"""Column functions that judge generated outputs, templates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_in(text: Column) -> Column:
    """The JSON object in a model's answer: of the first fenced block, if there is one, from the first
    opening brace to the last closing one; null if there is none or it is no JSON."""
    fenced = F.when(text.contains("```json"), F.split(text, "```json")[1]).when(text.contains("```"), F.split(text, "```")[1]).otherwise(text)
    inside = F.when(text.contains("```"), F.split(fenced, "```")[0]).otherwise(text)
    start, end = F.instr(inside, "{"), F.length(inside) - F.instr(F.reverse(inside), "}") + 1
    found = F.when((start > 0) & (F.instr(inside, "}") > 0) & (end > start), F.substring(inside, start, end - start + 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def references(template: Column) -> Column:
    """The distinct names that a template has in double braces, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(template, F.lit("")), F.lit(r"\{\{(\w+)\}\}"), F.lit(1))))


def undefined(template: Column, defined: Column) -> Column:
    """Names that the template has and the definitions lack."""
    return F.array_except(references(template), defined)


def unused(template: Column, defined: Column) -> Column:
    """Names that are defined and the template lacks, sorted."""
    return F.array_sort(F.array_except(defined, references(template)))


def format_error(text: Column, kind: str = "text") -> Column:
    """empty, json or markdown: what an output is not; null if nothing is wrong."""
    checks = {
        "json": F.when(F.try_parse_json(text).isNull(), "json"),
        "markdown": F.when(~text.rlike(r"[#*-]|```"), "markdown"),
        "text": F.lit(None).cast("string"),
    }
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s", " ")), F.lit("")) == "", "empty").otherwise(checks[kind])


def length_error(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """short, long or null; bounds of 0 or None do not count."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < (least or 0), "short").when(n > most, "long") if most else F.when(n < (least or 0), "short")


def words_in(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that stand in the text, whatever their case, in the given order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: lower.contains(F.lower(w)))


def words_missing(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that do not."""
    return F.array_except(F.array(*map(F.lit, words)).cast("array<string>"), words_in(text, words))


def duration(first: Column, second: Column) -> Column:
    """The time between two moments in its largest whole unit; unknown if one is null."""
    seconds = F.abs(F.unix_micros(second.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1e6
    of = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {unit}"))
    return F.when(seconds.isNull(), "unknown").when(seconds < 60, of(1, "seconds")).when(seconds < 3600, of(60, "minutes")).when(seconds < 86400, of(3600, "hours")).otherwise(of(86400, "days"))


def recently(at: Column, now: Column, days: int = 7) -> Column:
    """Whether a moment lies no more than so many whole days before another; false for null."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(F.floor(micros / 86_400_000_000) <= days, F.lit(False))


def hydrated(content: Column, id_: Column, score: Column, status: Column) -> Column:
    """A stored example: its JSON object as text, or an object with ``content`` where it is none, and beside
    it id, quality_score and status."""
    plain = F.to_json(F.struct(content.alias("content")))
    return F.struct(F.when(F.try_parse_json(content).isNotNull(), content).otherwise(plain).alias("example"), id_.alias("id"), score.alias("quality_score"), F.nullif(status, F.lit("")).alias("status"))


#: Kinds of personal data that count as sensitive.
SENSITIVE = [
    "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "PERSON", "LOCATION", "MEDICAL_LICENSE", "US_SSN",
    "US_PASSPORT", "US_DRIVER_LICENSE", "US_BANK_NUMBER", "UK_NHS", "SG_NRIC_FIN", "AU_ABN", "AU_ACN", "AU_TFN", "AU_MEDICARE",
]
LEAST_SCORE = 0.7


def sensitive(entities: Column, least: float = LEAST_SCORE) -> Column:
    """Of detected entities (structs with type and score) those of a sensitive kind with enough confidence."""
    return F.filter(entities, lambda e: e["type"].isin(SENSITIVE) & (e["score"] >= least))
