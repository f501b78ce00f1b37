"""Byte-pair merging of many pieces at once in padded numpy matrices.

Pieces of like length stand in one matrix, a row each. In every round each row merges its
leftmost pair of least rank, and with it, from left to right, all places of the same pair that
do not overlap; closes the gaps and looks up the new neighbours. Rows without a known pair leave.

The other places may go in the same round since a merge uncovers no pair of lower rank: where
each token of a vocabulary is what its own bytes merge to, its bytes have become that token
before one of greater rank stands beside its rest. ``closed`` tells whether that holds; where it
does not, ``lone`` merges the leftmost place alone.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int32(2**31 - 1)


class PairTable:
    """Rank and merged id of a pair of ids, in a hash table with open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]] = keys[todo[put]]
            self.rank[at[put]], self.merged[at[put]] = rank[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's place of each pair; one of rank ``_NONE`` where there is no such pair."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self._home(keys)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != np.uint64(2**64 - 1))]
        return at.reshape(shape)


def _least_places(rank: np.ndarray, lone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's least rank: of places that overlap the leftmost, then the
    next that does not; with ``lone`` the leftmost only."""
    if lone:
        return np.arange(len(rank)), rank.argmin(axis=1)
    hit = rank == rank.min(axis=1, keepdims=True)
    if (hit[:, 1:] & hit[:, :-1]).any():
        columns = np.arange(hit.shape[1])[None, :]
        in_run = columns - np.maximum.accumulate(np.where(hit, -1, columns), axis=1)
        hit &= in_run % 2 == 1
    return np.nonzero(hit)


def _merge_rows(rows: np.ndarray, lengths: np.ndarray, pairs: PairTable, out: list, ids: np.ndarray, lone: bool) -> None:
    """Merge the padded matrix ``rows``, whose pieces have the numbers ``ids``; append what leaves it to
    ``out`` as numbers, rows and lengths. ``rank`` holds at each place the rank of the pair that
    begins there."""
    rank = np.full(rows.shape, _NONE, dtype=np.int32)
    if rows.shape[1] > 1:
        rank[:, :-1] = pairs.rank[pairs.places(rows[:, :-1], rows[:, 1:])]
        rank[np.arange(rows.shape[1])[None, :] >= lengths[:, None] - 1] = _NONE
    while True:
        live = rank.min(axis=1) < _NONE
        if not live.all():
            out.append((ids[~live], rows[~live], lengths[~live]))
            if not live.any():
                return
            rows, rank, lengths, ids = rows[live], rank[live], lengths[live], ids[live]
        r, c = _least_places(rank, lone)
        rows[r, c] = pairs.merged[pairs.places(rows[r, c], rows[r, c + 1])]
        keep = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        keep[r, c + 1] = False
        turn = np.arange(len(r)) - np.searchsorted(r, r)  # merges of the row before this one
        lengths = lengths - np.bincount(r, minlength=len(rows))
        filled = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
        closed = np.zeros(filled.shape, dtype=np.int32)
        closed[filled] = rows[keep]
        rows = closed
        ranks = np.full(filled.shape, _NONE, dtype=np.int32)
        ranks[filled] = rank[keep]
        rank, at = ranks, c - turn
        for who, where in ((r[at > 0], at[at > 0] - 1), (r, at)):
            last = where >= lengths[who] - 1
            rank[who[last], where[last]] = _NONE
            who, where = who[~last], where[~last]
            rank[who, where] = pairs.rank[pairs.places(rows[who, where], rows[who, where + 1])]


def merge_flat(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable, lone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Merge pieces given end to end in ``symbols``; returns their ids end to end, and how many each has.
    ``lone``: one place of each row in a round, for vocabularies that are not closed."""
    out: list = []
    starts = np.cumsum(lengths) - lengths
    lower, longest = 0, int(lengths.max()) if len(lengths) else 0
    bounds = [4, 8, 12, 16, 24, 48]
    while bounds[-1] < longest:
        bounds.append(2 * bounds[-1])
    for upper in bounds:
        ids = np.flatnonzero((lengths > lower) & (lengths <= upper))
        lower = upper
        for part in np.array_split(ids, -(-len(ids) // max(1, 2**19 // upper))) if len(ids) else ():
            n = lengths[part]
            columns = np.arange(n.max())[None, :]
            inside = columns < n[:, None]
            rows = symbols[np.where(inside, starts[part][:, None] + columns, 0)].astype(np.int32)
            _merge_rows(rows, n, pairs, out, part, lone)
    merged = np.zeros(len(lengths), dtype=np.int64)
    for ids, _, n in out:
        merged[ids] = n
    starts, flat = np.cumsum(merged) - merged, np.empty(int(merged.sum()), dtype=np.int32)
    for ids, rows, n in out:
        columns = np.arange(rows.shape[1])[None, :]
        inside = columns < n[:, None]
        flat[(starts[ids][:, None] + columns)[inside]] = rows[inside]
    return flat, merged


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """The same as an id array for each piece."""
    flat, merged = merge_flat(symbols, lengths, pairs)
    return np.split(flat, np.cumsum(merged)[:-1]) if len(merged) else []


def closed(symbols: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, pairs: PairTable) -> bool:
    """Whether each of the ``tokens``, whose symbols are given end to end, is what these merge to."""
    flat, merged = merge_flat(symbols, lengths, pairs, lone=True)
    return bool((merged == 1).all() and (flat == tokens).all())
