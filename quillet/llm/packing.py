"""Operator 1, best-fit packing of token sequences.

Bounded-space online best-fit: pieces arrive one by one; a fixed number of bins is open,
found through a bitset in which bit ``f`` says that some open bin has ``f`` tokens free. A
piece goes to the fullest bin that it fits. If it fits none and all places are taken, the
fullest open bin closes.

Every partition packs on its own, so nothing is gathered: pieces are dealt out by a hash of
document and piece and arrive in the order of another hash, so at every moment short ones are
still to come for the gaps that long ones leave, however many there are. Of the next
``LOOK_AHEAD`` pieces the longest is placed first; nothing else is known of what is to come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import table
from quillet.llm.wordtokens import WordTokens, in_parts

CAPACITY = 2048
OPEN_BINS = 4096
LOOK_AHEAD = 4096

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_PACKED = _PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise each document, end it with ``end_id``, and cut what is longer than ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32. A null or empty text is the single
    ``end_id``; every input row counts, also repeated ones and those whose doc_id is null.
    Other columns are ignored.
    """
    closing = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.load(tokenizer)
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in in_parts(batch.column(1).to_pylist()):
                out: list[tuple] = []
                for doc_id, ids in zip([next(doc_ids) for _ in texts], words.packed(texts)):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _PIECES)


class BestFit:
    """Open bins by free space; one step for each piece, whatever the number of bins."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.mask = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_made = 0

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.mask ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece, and its offset there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.n_open -= 1
            found, free = self.n_made, self.capacity
            self.n_made += 1
            self.n_open += 1
        left = free - length
        if left:
            self.bins[left].append(found)
            self.mask |= 1 << left
        else:
            self.n_open -= 1
        return found, self.capacity - free


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Add sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32.

    Lengths are from 1 to ``capacity``; other rows fail the job. Repeated rows and null ids are
    pieces like others; an empty table has no sequences; columns that clash with the two added
    ones are replaced, others dropped. Rows arrive in the order of a hash, ties by all columns,
    so a task that runs again on another executor packs alike.
    """

    def placed(rows: pa.Table, bins: BestFit, base: int) -> pa.RecordBatch:
        lengths = rows.column("length").to_numpy()
        places: list = [None] * len(lengths)
        if not ((lengths >= 1) & (lengths <= bins.capacity)).all():
            raise ValueError(f"a piece has from 1 to {bins.capacity} tokens")
        for i in np.argsort(-lengths, kind="stable").tolist():
            places[i] = bins.place(int(lengths[i]))
        added = [pa.array([base + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
        whole = rows.combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*whole.columns, *added], names=[*whole.schema.names, "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        ahead: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + len(batch) >= look_ahead:
                first = batch.slice(0, look_ahead - n)
                yield placed(pa.Table.from_batches([*ahead, first]), bins, base)
                batch, ahead, n = batch.slice(len(first)), [], 0
            if len(batch):
                ahead.append(batch)
                n += len(batch)
        if ahead:
            yield placed(pa.Table.from_batches(ahead), bins, base)

    dealt = items.select(*_NAMES).repartition("doc_id", "piece", "ids_crc32")
    return dealt.sortWithinPartitions(F.xxhash64("ids_crc32", "piece", "doc_id"), *_NAMES).mapInArrow(run, _PACKED)


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
