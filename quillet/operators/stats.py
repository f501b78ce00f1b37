"""Statistics of texts, tokens and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T

#: N-grams that start in one piece of a row, n-grams that a task packs at once, and bytes of text a bucket.
_PIECE, _CHUNK, _BUCKET_BYTES = 512, 1_000_000, 1 << 21


def token_counts(rows: DataFrame, items: Column) -> DataFrame:
    """Occurrences of each item."""
    return rows.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def top_words(rows: DataFrame, text: str, id_field: str, k: int = 20) -> DataFrame:
    """word and n of the ``k`` most frequent words, ties to the one that comes first, in order of id."""
    each = rows.select(F.col(id_field).alias("id"), F.posexplode(T.words(F.col(text))).alias("pos", "word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def diversity(counts: DataFrame) -> DataFrame:
    """n_tokens, vocabulary, type-token ratio (root ratio above 1000 tokens) and Shannon entropy
    in bits, from one pass over the counts."""
    n, v = F.sum("n"), F.count("*")
    entropy = F.log2(n.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n
    sums = counts.agg(n.alias("n_tokens"), v.alias("vocabulary"), F.round(entropy, 6).alias("entropy"))
    ratio = F.when(F.col("n_tokens") > 1000, F.col("vocabulary") / F.sqrt("n_tokens")).otherwise(F.col("vocabulary") / F.col("n_tokens"))
    return sums.withColumn("ttr", F.round(ratio, 6))


def simpson(rows: DataFrame, field: str) -> DataFrame:
    """Simpson diversity of a field's values, nulls left out."""
    each = rows.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n"))
    return each.agg(F.round(1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("simpson"))


def _packed(n: int, buckets: int):
    """Bucket, distinct n-grams of some rows as packed pairs of 64-bit hashes, and their occurrences (on one row
    of each chunk). Rows hold word hashes; buckets are ranges of the first hash."""

    def grams(words: pa.ListArray) -> np.ndarray:
        ends = np.repeat(words.offsets[1:].to_numpy(), np.diff(words.offsets.to_numpy())) - words.offsets[0].as_py()
        known = words.flatten()
        m = max(len(known) - n + 1, 0)
        out = np.zeros((m, 2), np.uint64)
        for side in range(2):
            hashes = known.field(side).to_numpy().view(np.uint64)
            for k in range(n):
                out[:, side] = (out[:, side] ^ (out[:, side] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : m + k]
            out[:, side] ^= out[:, side] >> np.uint64(32)
            out[:, side] *= np.uint64(0xBF58476D1CE4E5B9)
        return out[np.arange(m) + n <= ends[:m]]

    def packed(found: np.ndarray) -> pa.RecordBatch:
        n_all, found = len(found), _distinct(found)
        of = (found[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        data = [found[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(found)])]
        counts = [n_all] + [0] * (len(starts) - 1)
        return pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int64)), pa.array(data, pa.binary()), pa.array(counts, pa.int64())], names=["bucket", "grams", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            chunk.append(grams(batch.column(0)))
            size += len(chunk[-1])
            if size > _CHUNK:
                yield packed(np.concatenate(chunk))
                chunk, size = [], 0
        if size:
            yield packed(np.concatenate(chunk))

    return run


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Distinct rows of pairs, in order."""
    pairs = pairs[np.argsort(pairs[:, 0])]
    same = pairs[1:, 0] == pairs[:-1, 0]
    if (same & (pairs[1:, 1] != pairs[:-1, 1])).any():  # first hashes of different pairs are equal
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        same = (pairs[1:] == pairs[:-1]).all(axis=1)
    return pairs[np.append(True, ~same)] if len(pairs) else pairs


def _counted(bucket: pa.Table) -> pa.Table:
    """Occurrences and distinct n-grams of a bucket."""
    found = np.frombuffer(b"".join(bucket.column("grams").to_pylist()), np.uint64).reshape(-1, 2)
    return pa.table({"total": [sum(bucket.column("n").to_pylist())], "distinct_grams": [len(_distinct(found))]})


def distinct_n(rows: DataFrame, text: str, n: int) -> DataFrame:
    """One row: n-grams of the corpus, distinct ones, and their ratio. Two grams are the same where their 128-bit
    hashes are. Rows go to tasks as word hashes in pieces of bounded length, and grams are shuffled packed,
    without repeats in a chunk, to as many buckets as the corpus has ``_BUCKET_BYTES``."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    hashed = F.transform(T.tokens(F.col(text), T.MORE_EDGES), lambda w: F.struct(F.xxhash64(w).alias("a"), F.xxhash64(F.lit(1), w).alias("b")))
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - n + 1, F.lit(_PIECE))
    pieces = T.let(hashed, lambda w: F.when(F.size(w) >= n, F.transform(starts(w), lambda i: F.slice(w, i, F.lit(_PIECE + n - 1)))))
    packed = rows.select(F.explode(pieces).alias("w")).mapInArrow(_packed(n, size // _BUCKET_BYTES + 1), "bucket long, grams binary, n long")
    counts = packed.groupBy("bucket").applyInArrow(_counted, "total long, distinct_grams long")
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct_grams")))
    return sums.withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("distinct_grams") / F.col("total")).otherwise(0.0), 4))


def length_distribution(rows: DataFrame, length: Column) -> DataFrame:
    """Least, greatest, mean, deviation, exact quartiles and ninth decile of a length."""
    return rows.select(length.alias("x")).agg(
        F.min("x").alias("least"), F.max("x").alias("greatest"), F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("deviation"), F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9)))).alias("p"),
    ).select("*", *(F.get("p", i).alias(f"p{q}") for i, q in enumerate((25, 50, 75, 90)))).drop("p")


def conversation_stats(turns: DataFrame) -> DataFrame:
    """Turns, user and assistant turns, characters and estimated tokens of each conversation."""
    user, assistant = F.col("role").isin("user", "human"), F.col("role").isin("assistant", "bot", "gpt")
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(user).alias("n_user"), F.count_if(assistant).alias("n_assistant"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"),
        F.sum(T.token_estimate(F.col("text"))).alias("n_tokens"),
    )


def _spread(x: str) -> list[Column]:
    return [F.min(x).alias(f"{x}_min"), F.max(x).alias(f"{x}_max"), F.round(F.avg(x), 2).alias(f"{x}_mean"), F.percentile(x, F.lit(0.5)).alias(f"{x}_median")]


def content_stats(rows: DataFrame, turns: Column, text: Column) -> DataFrame:
    """One row: least, greatest, mean and median of turns (of rows that have any), of characters and of estimated
    tokens, and the tokens' sum."""
    each = rows.select(F.when(F.size(turns) > 0, F.size(turns)).alias("turns"), F.length(text).alias("chars"), T.token_estimate(text).alias("tokens"))
    return each.agg(*_spread("turns"), *_spread("chars"), *_spread("tokens"), F.sum("tokens").alias("tokens_total"))


def quality_indicators(rows: DataFrame, score: Column, flagged: Column, metadata: Column) -> DataFrame:
    """One row: rows, spread of the score where there is one, flagged rows and rows with metadata, in percent too."""
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.round(100 * c / n, 2)).otherwise(0.0)
    yes, have = F.count_if("flagged"), F.count_if("has_metadata")
    each = rows.select(score.alias("score"), F.coalesce(flagged, F.lit(False)).alias("flagged"), F.coalesce(metadata.isNotNull(), F.lit(False)).alias("has_metadata"))
    return each.agg(n.alias("n"), *_spread("score"), yes.alias("n_flagged"), share(yes).alias("flagged_percent"), have.alias("n_metadata"), share(have).alias("metadata_percent"))


def compare_sizes(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: sizes of two tables, difference and ratio (0 if the first is empty)."""
    sizes = one.agg(F.count("*").alias("one")).join(F.broadcast(two.agg(F.count("*").alias("two"))))  # one row each
    return sizes.select("*", (F.col("two") - F.col("one")).alias("difference"), F.when(F.col("one") > 0, F.round(F.col("two") / F.col("one"), 2)).otherwise(0.0).alias("ratio"))


def compare_diversity(one: DataFrame, two: DataFrame, items: Column, domain: str) -> DataFrame:
    """One row: differences of vocabulary, type-token ratio and entropy, and which table is more diverse: dataset1,
    dataset2, or similar where the blended scores lie within a twentieth."""
    sides = []
    for df, side in ((one, "1"), (two, "2")):
        both = diversity(token_counts(df, items)).join(F.broadcast(simpson(df, domain)))  # one row each
        sides.append(both.select(F.col("vocabulary").alias(f"v{side}"), F.round("ttr", 3).alias(f"t{side}"), F.round("entropy", 3).alias(f"e{side}"), F.coalesce("simpson", F.lit(0.0)).alias(f"d{side}")))
    score = lambda s: 0.4 * F.col(f"t{s}") + 0.3 * F.col(f"e{s}") / 15 + 0.3 * F.col(f"d{s}")
    apart = score("1") - score("2")
    winner = F.when(F.abs(apart) < 0.05, "similar").when(apart > 0, "dataset1").otherwise("dataset2")
    return sides[0].join(F.broadcast(sides[1])).select(
        (F.col("v2") - F.col("v1")).alias("vocabulary_diff"), F.round(F.col("t2") - F.col("t1"), 3).alias("ratio_diff"), F.round(F.col("e2") - F.col("e1"), 3).alias("entropy_diff"), winner.alias("winner"),
    )


def message_stats(rows: DataFrame) -> DataFrame:
    """One row over examples with ``questions`` and ``answers``: words, characters, how answers look and how long they
    are, and the mean of answer words to question words of the examples that have a question."""
    said = rows.select(F.explode(F.concat(F.transform("questions", lambda t: F.struct(F.lit(False).alias("answer"), t.alias("t"))), F.transform("answers", lambda t: F.struct(F.lit(True).alias("answer"), t.alias("t"))))).alias("m"))
    said = said.select("m.answer", F.col("m.t").alias("t"), F.size(T.words(F.col("m.t"))).alias("n"))
    of = F.col("answer")
    flags = {name: F.count_if(of & c).alias(name) for name, c in T.flags(F.col("t")).items()}
    languages = [F.count_if(of & (T.language(F.col("t")) == k)).alias(f"lang_{k}") for k in ("en", "ru", "zh", "mixed", "other")]
    sums = said.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n_chars"), *flags.values(), *languages,
        F.count_if(of & (F.col("n") == 0)).alias("empty"), F.count_if(of & F.col("n").between(1, 9)).alias("very_short"), F.count_if(of & (F.col("n") > 500)).alias("very_long"),
    )
    size = lambda c: F.aggregate(F.transform(c, lambda t: F.size(T.words(t))), F.lit(0), lambda a, b: a + b)
    ratio = rows.where((F.size("answers") > 0) & (F.size("questions") > 0)).select(size("questions").alias("q"), size("answers").alias("a")).where("q > 0")
    ratios = ratio.agg(F.round(F.coalesce(F.avg(F.col("a") / F.col("q")), F.lit(0.0)), 2).alias("qa_ratio"))
    return rows.agg(F.count("*").alias("n_examples")).join(F.broadcast(sums)).join(F.broadcast(ratios))  # one row each


def bleu(reference: Column, hypothesis: Column, most: int = 4) -> Column:
    """BLEU of two token arrays: clipped precisions of 1-grams up to ``most``-grams (no longer than the hypothesis), 0 if
    one is 0, their geometric mean, and the brevity penalty."""

    def precision(n: int) -> Column:
        return T.let(
            F.struct(T.ngrams(reference, n).alias("r"), T.ngrams(hypothesis, n).alias("h")),
            lambda g: F.aggregate(
                F.transform(F.array_distinct(g["h"]), lambda x: F.least(F.size(F.filter(g["h"], lambda y: y == x)), F.size(F.filter(g["r"], lambda y: y == x)))), F.lit(0), lambda a, b: a + b
            )
            / F.size(g["h"]),
        )

    r, h = F.size(reference), F.size(hypothesis)
    orders = F.least(F.lit(most), h)
    logs = [F.when(h >= n, F.log(precision(n))) for n in range(1, most + 1)]  # the logarithm of 0 is null
    none = F.lit(False)
    for n, log in enumerate(logs, 1):
        none = none | ((h >= n) & log.isNull())
    total = sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0))
    penalty = F.when(h >= r, 1.0).otherwise(F.exp(1 - r / h))
    return F.when((r == 0) | (h == 0), 0.0).when(none, 0.0).otherwise(penalty * F.exp(total / orders))


def self_bleu(rows: DataFrame, text: str, id_field: str, most: int = 4, size: int = 500) -> DataFrame:
    """One row: the mean over ``size`` rows, drawn by a hash of the id, of each one's greatest BLEU against the others.
    The sample is the measure's own; its pairs are ``size`` squared whatever the table's size."""
    drawn = rows.orderBy(F.md5(F.col(id_field).cast("string").cast("binary")), id_field).limit(size)
    tokens = drawn.select(F.col(id_field).alias("i"), T.tokens(F.col(text), T.MORE_EDGES).alias("h")).where(F.size("h") > 0)
    others = F.broadcast(tokens.select(F.col("i").alias("j"), F.col("h").alias("r")))  # ``size`` rows at most
    best = tokens.join(others, F.col("i") != F.col("j")).groupBy("i").agg(F.max(bleu(F.col("r"), F.col("h"), most)).alias("best"))
    return best.agg(F.round(F.coalesce(F.avg("best"), F.lit(0.0)), 4).alias(f"self_bleu_{most}"))
