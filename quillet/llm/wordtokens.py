"""Ids of a word-level BPE file in the ``tokenizers`` format, run by run.

The file's normaliser works inside runs of other than white space and its split rule never
crosses white space, so a text's ids are those of its runs, one after another. Most runs come
again and again: their ids are kept, and only new ones are merged, many in one call. The file's
added tokens are cut out of the raw text before all that, as the library does it.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from quillet.llm.bpe import PairTable, merge_flat

#: Unicode's White_Space. ``str.split()`` also cuts at the four controls 1C to 1F.
_RUN = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_CONTROLS = re.compile("[\\x1c-\\x1f]")


def runs_of(text: str) -> list[str]:
    return _RUN.findall(text) if _CONTROLS.search(text) else text.split()


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: Latin-1's
    printable ones stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


_LOADED: dict[str, WordTokens] = {}


class WordTokens:
    """Encodes batches of texts; keeps up to ``kept`` runs with their ids, then starts afresh."""

    def __init__(self, path: str, kept: int = 500_000) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, ending = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + ending] for c in letters], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, merged = (
            np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges))
        )
        self.pairs = PairTable(left, right, np.arange(len(merges)), merged)
        self.find = regex.compile(split).findall
        added = spec["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens are matched as they stand; this file has some that are not")
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        # of several that start at one place the longest counts
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.kept, self.known = kept, dict(self.added)

    @classmethod
    def load(cls, path: str) -> WordTokens:
        """One instance for each file and Python worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _learn(self, new: list[str]) -> None:
        pieces: dict[str, int] = {}
        number = pieces.setdefault
        parts = []
        for run in new:
            if not run.isascii():
                run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
            elif run.isalpha():
                parts.append(number(run.lower(), len(pieces)))
                continue
            found = self.find(run.lower())
            parts.append(number(found[0], len(pieces)) if len(found) == 1 else tuple([number(p, len(pieces)) for p in found]))
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        flat, merged = merge_flat(symbols, lengths, self.pairs)
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(merged)).tolist()
        ids = [data[a:b] for a, b in zip([0, *ends], ends)]
        for run, part in zip(new, parts):
            self.known[run] = ids[part] if isinstance(part, int) else b"".join([ids[p] for p in part])

    def _runs(self, text: str) -> list[str]:
        """The runs of a text, each added token a run of its own."""
        if not any(mark in text for mark in self.added):
            return runs_of(text)
        return [run for part in self.marks.split(text) for run in ((part,) if part in self.added else runs_of(part))]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned little-endian 32-bit numbers."""
        runs = [self._runs(text) for text in texts]
        if len(self.known) > self.kept:
            self.known = dict(self.added)
        new = set().union(*runs).difference(self.known)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, r)) for r in runs]


def in_parts(texts: list, size: int = 2_000_000):
    """Split a list of strings so that each part has about ``size`` characters."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
