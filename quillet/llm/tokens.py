"""Operator 5, byte-level BPE encoding and decoding.

The split pattern attaches a single blank to what follows it, so a blank with other than white
space on both sides always begins a new match. Texts are cut there into units; a unit's ids do
not depend on its neighbours. Known units are looked up, and the pieces of all new ones are
merged together in padded matrices (``quillet.llm.bpe``).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.bpe import PairTable, closed, merge_flat
from quillet.llm.common import table
from quillet.llm.wordtokens import in_parts

_TWO_SPACES = re.compile(r"\s\s")
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], "ByteTokens"] = {}


class ByteTokens:
    """Encoder and decoder of one rank file. Keeps up to ``kept`` units with their ids. A file in
    which some token is not what its own bytes merge to is merged one place at a time."""

    def __init__(self, path: str, pattern: str, kept: int = 400_000) -> None:
        import regex

        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.bytes_of = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.pairs = PairTable(left, right, rank, rank)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = list(self.ranks)
        raw = self.single[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        self.lone = not closed(raw, np.array([len(t) for t in tokens]), np.array([self.ranks[t] for t in tokens]), self.pairs)
        self.find = regex.compile(pattern).findall
        self.kept = kept
        self.heads: dict[str, tuple[bytes, str]] = {}  # units at the start of a text
        self.ids: dict[str, bytes] = {}  # units after a blank: their ids ...
        self.digits: dict[str, str] = {}  # ... and the same in decimal, joined by commas

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteTokens":
        """One instance for each file, pattern and Python worker."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]

    def _encoded(self, units: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids of units given with their blank, packed and in decimal."""
        numbers: dict[str, int] = {}
        parts = [[numbers.setdefault(p, len(numbers)) for p in self.find(unit)] for unit in units]
        ids: list[tuple] = [None] * len(numbers)
        raw, todo = [], []
        for piece, k in numbers.items():
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is None:
                raw.append(data)
                todo.append(k)
            else:
                ids[k] = (rank,)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat, merged = merge_flat(self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)], lengths, self.pairs, self.lone)
        flat, ends = flat.tolist(), np.cumsum(merged).tolist()
        for k, start, end in zip(todo, [0, *ends], ends):
            ids[k] = flat[start:end]
        for part in parts:
            all_ids = [i for k in part for i in ids[k]]
            yield np.array(all_ids, dtype="<u4").tobytes(), ",".join(map(str, all_ids))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, and in decimal."""
        if len(self.ids) > self.kept:
            self.ids.clear()
            self.digits.clear()
        self.heads.clear()
        units = [_LONE_BLANK.split(t) if _TWO_SPACES.search(t) else t.split(" ") for t in texts]
        new = list(set().union(*(u[1:] for u in units)).difference(self.ids))
        for unit, (ids, digits) in zip(new, self._encoded([" " + u for u in new])):
            self.ids[unit], self.digits[unit] = ids, digits
        heads = list({u[0] for u in units})
        self.heads.update(zip(heads, self._encoded(heads)))
        out = []
        for head, *rest in units:
            ids, digits = self.heads[head]
            if rest:
                ids = b"".join([ids, *map(self.ids.__getitem__, rest)])
                digits = ",".join([digits, *map(self.digits.__getitem__, rest)] if digits else map(self.digits.__getitem__, rest))
            out.append((ids, digits))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of each row; a null text has no ids. Every row
    counts, repeated ones too; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTokens.load(ranks_path, pattern)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in in_parts(batch.column(1).to_pylist()):
                found = [ids for ids, _ in coder.encode(texts)]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The inverse: doc_id and ``data``, the bytes of ``ids``; null ids have no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTokens.load(ranks_path, pattern)
        for batch in batches:
            data = [coder.decode(np.array(ids or [], dtype="<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass, and return the digests of ids and of decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteTokens.load(ranks_path, pattern)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in in_parts(batch.column(1).to_pylist()):
                rows = [
                    (len(ids) // 4, hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest())
                    for ids, digits in coder.encode(texts)
                ]
                n, ids_sha, decoded_sha = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents by the multilingual byte-level ranks."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
