"""Operator 8, removal of passages that also stand elsewhere.

Windows are counted over the whole corpus, in place of a relative Lempel-Ziv parse (the README
says why). A first count is of *anchors*: of every ``window`` consecutive words, the 8-word
sequence with the least hash. Equal windows have equal anchors, so a window whose anchor stands
nowhere else need not be looked up; a second count is of the windows that are left, by 128-bit
hashes. Runs of windows that stand elsewhere too are the spans that go.

Both counts are sums by hash with partial sums in each task, so neither a passage that stands
in a third of all documents nor thousands of copies of one text gather in one place. What the
documents get back are the hashes that stand *nowhere* else, each of which has one owner. Texts
that hold a good share of all rows as copies need nothing back: all their windows stand elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillet.llm.common import gram_hashes, hot_keys, mixed, table, text_bytes, word_hashes, written

WINDOW = 35
_GRAM = 8
_FOUND = "hash long, check long, n int, owner long"


def anchor_positions(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the short sequences, and for each window the place of its anchor (the first of
    the least ones)."""
    grams = gram_hashes(words, min(_GRAM, window))
    span = window - min(_GRAM, window) + 1
    if len(grams) < span:
        return grams, np.empty(0, dtype=np.int64)
    least = sliding_window_view(grams, span).argmin(axis=1)
    return grams, least + np.arange(len(least))


class _Counted:
    """Hashes of a task's texts with their counts. The third and later copies of one text add
    nothing: whether a hash stands once or more often is known by then."""

    def __init__(self) -> None:
        self.copies: dict[int, int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def wanted(self, owner: int) -> bool:
        n = self.copies.get(owner, 0)
        self.copies[owner] = n + 1
        return n < 2

    def add(self, hashes: np.ndarray, owner: int, checks: np.ndarray | None = None) -> None:
        values, at, n = np.unique(hashes, return_index=True, return_counts=True)
        checks = np.zeros(len(values), dtype=np.uint64) if checks is None else checks[at]
        self.parts.append((values, checks, n, np.full(len(values), owner, dtype=np.int64)))
        self.size += len(values)

    def batch(self) -> pa.RecordBatch:
        values, checks, n, owners = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(owners)], names=["hash", "check", "n", "owner"]
        )


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counted()
        for batch in batches:
            for owner, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found.wanted(owner):
                    grams, at = anchor_positions(word_hashes(data.as_py()), window)
                    if len(at):
                        found.add(grams[np.unique(at)], owner)
                if found.size > 100_000:
                    yield found.batch()
        if found.parts:
            yield found.batch()

    return run


def _held(words: np.ndarray, lone: np.ndarray, window: int) -> np.ndarray:
    """For each window, whether its anchor stands more than once."""
    grams, at = anchor_positions(words, window)
    return ~np.isin(grams, lone)[at]


def _as_hashes(value) -> np.ndarray:
    """An Arrow list of longs, or null, as unsigned numbers."""
    return np.asarray(value.values if value.is_valid else [], dtype=np.int64).view(np.uint64)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Counted()
        for batch in batches:
            for owner, data, lone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if found.wanted(owner):
                    words = word_hashes(data.as_py())
                    held = _held(words, _as_hashes(lone), window)
                    if held.any():
                        found.add(gram_hashes(words, window)[held], owner, gram_hashes(mixed(words), window)[held])
                if found.size > 100_000:
                    yield found.batch()
        if found.parts:
            yield found.batch()

    return run


def _lone(found: DataFrame) -> DataFrame:
    """For each owner the hashes that stand once in the whole corpus."""
    once = found.groupBy("hash", "check").agg(F.sum("n").alias("n"), F.min("owner").alias("owner")).where("n = 1")
    return once.groupBy("owner").agg(F.collect_list("hash").alias("lone"))


def covered(words: np.ndarray, lone_anchors: np.ndarray, lone_windows: np.ndarray, window: int) -> np.ndarray:
    """For each word whether a factor covers it."""
    out = np.zeros(len(words) + 1, dtype=np.int64)
    held = _held(words, lone_anchors, window)
    if held.any():
        held &= ~np.isin(gram_hashes(words, window), lone_windows)
        edges = np.diff(held.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # factors, as first windows
        np.add.at(out, starts, 1)
        np.add.at(out, ends + window - 1, -1)
    return np.cumsum(out[:-1]) > 0


def index(docs: DataFrame, hot: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each distinct text that has enough words: ``owner`` (the text's hash), its anchors and
    its windows that stand nowhere else. ``hot``: texts that stand in a good share of all rows."""
    texts = docs.select(F.xxhash64("text").alias("owner"), text_bytes().alias("text"))
    anchors = written(_lone(texts.mapInArrow(_anchors(window), _FOUND))).withColumnRenamed("lone", "lone_anchors")
    rest = texts.join(F.broadcast(hot), "owner", "left_anti").join(anchors, "owner", "left")
    copies = texts.join(F.broadcast(hot), "owner", "left_semi").withColumn("lone_anchors", F.lit(None).cast("array<long>"))
    found = [df.select("owner", "text", "lone_anchors").mapInArrow(_windows(window), _FOUND) for df in (rest, copies)]
    windows = written(_lone(found[0].unionByName(found[1]))).withColumnRenamed("lone", "lone_windows")
    return anchors.join(windows, "owner", "full")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a ``window`` of words that also starts anywhere else.

    Words are runs of other than the six ASCII white-space characters. Windows are judged on
    the input, in the same document too; all copies go, none is kept as the original. Adds
    n_words, n_removed and kept_text (kept words joined by one blank) to the columns of
    ``docs``. Null and empty texts have no words and an empty kept_text; texts shorter than
    the window keep all words; repeated rows are copies of each other. Columns that clash
    with the three added ones are replaced; an empty table gives no rows.
    """
    plain = docs.drop("n_words", "n_removed", "kept_text")
    packed = plain.select(F.struct("*").alias("row"), "text", F.xxhash64("text").alias("owner"))
    hot = hot_keys(packed.where("text IS NOT NULL"), "owner")
    known = index(plain, hot, window)
    none = F.lit(None).cast("array<long>")
    copies = packed.join(F.broadcast(hot), "owner", "left_semi").select("row", "text", none.alias("lone_anchors"), none.alias("lone_windows"))
    blank = packed.where("text IS NULL").select("row", "text", none.alias("lone_anchors"), none.alias("lone_windows"))
    rest = packed.where("text IS NOT NULL").join(F.broadcast(hot), "owner", "left_anti").join(known, "owner", "left").select("row", "text", "lone_anchors", "lone_windows")
    joined = rest.unionByName(copies.where("text IS NOT NULL")).unionByName(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, anchors, windows in zip(batch.column("text"), batch.column("lone_anchors"), batch.column("lone_windows")):
                data = (text.as_py() or "").encode()
                words = data.split()
                gone = covered(word_hashes(data), _as_hashes(anchors), _as_hashes(windows), window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n, removed, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "kept_text"],
            )

    added = StructType().add("row", packed.schema["row"].dataType).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(run, added).select("row.*", "n_words", "n_removed", "kept_text")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words that stand elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same on a few rows of (doc_id, text), by comparing all windows: for tests."""
    words = [(text or "").encode().split() for _, text in rows]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {
            j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)
        }
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
