"""Column functions on texts: normal forms, tokens, n-grams, estimates and flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and the marks stripped from a token's ends.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EDGES = ".,!?;:()[]{}"
#: Marks stripped for n-gram statistics.
MORE_EDGES = EDGES + "\"'-"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. Without this, a function over arrays
    that names a computed array in its lambda computes it anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased runs between white space; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def normal(text: Column) -> Column:
    """Lower case, white space collapsed, then ASCII punctuation deleted."""
    return F.translate(F.array_join(words(text), " "), PUNCTUATION, "")


def tokens(text: Column, edges: str = EDGES) -> Column:
    """Words without marks at their ends; those of marks only go."""
    return F.array_remove(F.transform(words(text), lambda w: F.btrim(w, F.lit(edges))), "")


def ngrams(of: Column, n: int) -> Column:
    """Runs of ``n`` items joined by a blank; none if there are fewer."""
    none = F.array().cast("array<string>")
    gram = lambda ws: lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " ")
    return let(of, lambda ws: F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), gram(ws))).otherwise(none))


def token_estimate(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), F.lit(0.0))
    )


def flags(text: Column) -> dict[str, Column]:
    """Code, lists, links and numbers of three digits or with decimals in a text."""
    found = {"has_code": r"```|`[^`]+`", "has_list": r"(?m)^\s*[-*•]\s+|^\s*[0-9]+\.\s+", "has_url": r"https?://[^\s<>\"{}|\\^`\[\]]+", "has_numbers": r"[0-9]{3,}|[0-9]+\.[0-9]+"}
    return {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in found.items()}


def grade(score: Column) -> Column:
    """Letter for a score from 0 to 100."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def language(text: Column) -> Column:
    """Language by script: zh, ru, en, mixed or other, from the shares of CJK, Cyrillic and
    unaccented Latin letters. Runs of letters are found, not all else replaced, which takes many times as long."""
    known = F.coalesce(text, F.lit(""))
    count = lambda letters: F.length(F.array_join(F.regexp_extract_all(known, F.lit(f"[{letters}]+"), F.lit(0)), ""))
    counts = F.struct(count("а-яА-ЯёЁ").alias("cyrillic"), count("a-zA-Z").alias("latin"), count("一-鿿").alias("chinese"))

    def named(found: Column) -> Column:
        cyrillic, latin, chinese = found["cyrillic"], found["latin"], found["chinese"]
        total = cyrillic + latin + chinese
        return (
            F.when(total == 0, "other").when(chinese > 0.3 * total, "zh").when(cyrillic > 0.5 * total, "ru").when(latin > 0.5 * total, "en")
            .when((cyrillic > 0.2 * total) & (latin > 0.2 * total), "mixed").otherwise("other")
        )

    return let(counts, named)


#: Upper bounds of the length buckets and their names; longer ones are "1000+".
BUCKETS = {10: "0-10", 25: "11-25", 50: "26-50", 100: "51-100", 200: "101-200", 500: "201-500", 1000: "501-1000"}


def length_bucket(length: Column) -> Column:
    """The bucket that a length falls in."""
    out = F
    for most, name in BUCKETS.items():
        out = out.when(length <= most, name)
    return out.otherwise("1000+")


def format_of(columns: list[str]) -> str:
    """The format that a table's columns show: conversation, instruction, prompt-completion, text or unknown."""
    have = set(columns)
    if have & {"conversation", "messages"}:
        return "conversation"
    for field, name in (("instruction", "instruction"), ("prompt", "prompt-completion"), ("text", "text"), ("content", "text")):
        if field in have:
            return name
    return "unknown"


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{{name}}`` replaced by its value; null values are empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def filled(template: Column, values: dict[str, Column], defaults: dict[str, str] | None = None, marks: tuple[str, str] = ("{{", "}}")) -> Column:
    """The template, a column, with each name between ``marks`` replaced by its value, or where that is null by its default;
    a name without either stays as it is. With single marks, ``{name}``, the same for the plainer kind."""
    out, given = template, defaults or {}
    for name, value in values.items():
        known = F.coalesce(value.cast("string"), F.lit(given.get(name)).cast("string"))
        out = F.coalesce(F.replace(out, F.lit(marks[0] + name + marks[1]), known), out)
    return out


def missing(values: dict[str, Column], defaults: dict[str, str], required: list[str]) -> Column:
    """The required names that have neither value nor default, in order."""
    lacks = lambda n: values[n].isNull() if n in values else F.lit(True)
    return F.array_compact(F.array(*(F.when(lacks(n), F.lit(n)) for n in required if n not in defaults)).cast("array<string>"))
