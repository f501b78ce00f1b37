"""Operator 6, quality rules by divergence from language references. Built-in functions only.

Each text has a histogram of character classes and one of common words. Every language of which
the corpus holds enough is a reference, and all other texts together are one more: its 16 most
frequent words, their shares, and the shares of the character classes, all counted over all its
texts. A text is kept if, for some reference, the Jensen-Shannon distances of both histograms
stay under their limits, whatever its own language is said to be; a histogram of too little text
is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import table, written

#: Words of a language that make its reference: its most frequent ones.
COMMON = 16
#: A language with fewer words, or a smaller share of all, is no reference of its own; its texts, and those
#: without a language, belong to ``REST``. So there are 1001 references at most, whatever stands in ``lang``.
MIN_LANG_WORDS, MIN_LANG_SHARE, REST = 1000, 0.001, "und"
#: Histograms of fewer characters or words are not judged.
MIN_CHARS, MIN_WORDS = 200, 100
#: Greatest distances (from 0 to 1) of a text that is kept.
MAX_CHARS, MAX_WORDS = 0.18, 0.26

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    for space in "\t\n\x0b\x0c\r":  # a single blank is what Java splits at fastest
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text`` and ``lang``: whatever the columns are called, none clashes."""
    lang = F.coalesce(F.lower("lang"), F.lit(REST)) if "lang" in docs.columns else F.lit(REST)
    return docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))


def _belonging(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """``rows`` with the language replaced by the reference that it counts for; ``langs``: 1000 at most."""
    return rows.join(F.broadcast(langs.select("lang", F.col("lang").alias("ref"))), "lang", "left").withColumn("lang", F.coalesce("ref", F.lit(REST))).drop("ref")


def common_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, word and count of the most frequent words of each reference, as written, and the languages that are
    references of their own."""
    each = _packed(docs).select("lang", F.explode(_words(F.col("text"))).alias("word"))
    counts = written(each.groupBy("lang", "word").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    whole = sizes.agg(F.sum("total").alias("whole"))  # one row
    large = (F.col("total") >= MIN_LANG_WORDS) & (F.col("total") >= MIN_LANG_SHARE * F.col("whole")) & (F.col("lang") != REST)
    langs = written(sizes.join(F.broadcast(whole)).where(large).select("lang"))
    rest = _belonging(counts, langs).where(F.col("lang") == REST).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.join(F.broadcast(langs), "lang", "left_semi").unionByName(rest)
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= COMMON)
    return top.select("lang", "word", "n"), langs


def features(docs: DataFrame, common: list[str]) -> DataFrame:
    """row, lang and the counts of each row of ``docs``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, ``chars`` (an array of counts) and ``found`` (words of ``common``, with how
    often they stand in the text)."""
    split = _packed(docs).withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")

    def gram(i: Column) -> Column:
        return F.xxhash64(*(F.get("words", i + k) for k in range(5)))

    counted = split.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "lines": lines,
            "grams": F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), gram)),
            "seen": F.sort_array(F.filter("words", lambda w: w.isin(common))) if common else F.array().cast("array<string>"),
            "upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
            "stops": F.regexp_count("text", F.lit(r"""[.,;:?!'"()-]""")),
            "marks": F.regexp_count("text", F.lit(r"""[^\p{L}\s.,;:?!'"()-]""")),
            "size": F.length("text"),
        }
    )
    # windows found twice: the sorted (hash, place) with an equal neighbour; then the union of their words
    placed = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter(
        "placed",
        lambda x, k: (F.get("placed", k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get("placed", k + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform("twice", lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.coalesce(F.least(F.lit(5), F.get("starts", k + 1) - s), F.lit(5))),
        F.lit(0), lambda a, b: a + b,
    )
    distinct = F.size(F.array_distinct("grams")) == F.size("grams")
    counted = counted.withColumn("placed", F.when(~distinct, placed)).withColumn("twice", twice).withColumn("starts", starts)
    # the sorted common words: a run of equal ones is a word with its count
    runs = F.filter(F.transform("seen", lambda w, i: F.when((i == 0) | (F.get("seen", i - 1) != w), i)), lambda i: i.isNotNull())
    counted = counted.withColumn("runs", runs)
    found = F.transform("runs", lambda i, k: F.struct(F.get("seen", i).alias("word"), (F.coalesce(F.get("runs", k + 1), F.size("seen")) - i).alias("n")))
    letters = F.col("size") - F.col("upper") - F.col("stops") - F.col("marks") - (F.col("size") - F.col("word_chars"))
    return counted.select(
        "row", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(letters, "upper", "stops", "marks", F.col("size") - F.col("word_chars")).cast("array<long>").alias("chars"),
        found.alias("found"),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _part(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)


def _distance(sum_: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), sum_ / 2))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2: from 0 to 1; null if either is."""
    return _distance(_total(F.zip_with(p, q, lambda a, b: _part(a, b) + _part(b, a))))


def word_distance(found: Column, n_words: Column, shares: Column) -> Column:
    """The same for the words of ``found`` and a map of shares, all other words being one class.
    A word of the map that is not found adds its share, so only those found are looked at."""
    own = F.filter(F.transform(found, lambda x: F.struct((x["n"] / n_words).alias("p"), F.element_at(shares, x["word"]).alias("q"))), lambda x: x["q"].isNotNull())
    terms = F.transform(own, lambda x: _part(x["p"], x["q"]) + _part(x["q"], x["p"]) - x["q"])
    whole = _total(F.map_values(shares))
    p, q = 1 - _total(F.transform(own, lambda x: x["p"])), 1 - whole
    return _distance(_total(terms) + whole + _part(p, q) + _part(q, p))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds to ``docs`` n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word windows.
    kept: not base_failed, and near to a reference; where nothing has enough text to be one, only
    base_failed decides. All rows are compared with all references, also those whose lang has no
    reference of its own, is null, or is no column of the table. Null and empty texts fail. Repeated
    rows count as often as they stand. Columns with names of the added ones are replaced; an
    empty table gives no rows. ``keep``: the columns of ``docs`` that are returned, by default all.
    """
    docs = docs.drop(*ADDED, "base_failed", "kept")
    words, langs = common_words(docs)
    words = written(words)
    common = sorted({r["word"] for r in words.select("word").distinct().collect()})  # COMMON * 1000 words at most
    rows = features(docs, common)
    rows = written(rows if keep is None else rows.withColumn("row", F.struct(*(F.col("row")[c].alias(c) for c in keep))))
    sums = _belonging(rows.select("lang", "chars", "n_words"), langs).groupBy("lang").agg(F.array(*(F.sum(F.col("chars")[i]) for i in range(5))).alias("chars"), F.sum("n_words").alias("total")).where(F.col("total") >= MIN_LANG_WORDS)
    shares = words.join(sums.select("lang", "total"), "lang").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", F.try_divide("n", "total")))).alias("words"))
    each = shares.join(sums, "lang").select("lang", F.transform("chars", lambda x: F.try_divide(x, _total(F.col("chars")))).alias("chars"), "words")
    references = each.agg(F.collect_list(F.struct("lang", "chars", "words")).alias("references"))  # one row, 1000 entries at most
    p = F.transform("chars", lambda x: F.try_divide(x, _total(F.col("chars"))))
    judged_chars, judged_words = F.col("word_chars") >= MIN_CHARS, F.col("n_words") >= MIN_WORDS

    def near(r: Column) -> Column:
        return (~judged_chars | (distance(F.col("p"), r["chars"]) <= MAX_CHARS)) & (~judged_words | (word_distance(F.col("found"), F.col("n_words"), r["words"]) <= MAX_WORDS))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumn("p", p).crossJoin(F.broadcast(references))  # by one row
    fits = (F.size("references") == 0) | F.exists("references", near)
    decided = out.select("row", *ADDED, failed.alias("base_failed"), (~failed & fits).alias("kept"))
    return decided.select("row.*", *ADDED, "base_failed", "kept")  # whatever the row's columns are called


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents against references of their own corpus."""
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return rows.select("doc_id", *ADDED, "base_failed", "kept")
