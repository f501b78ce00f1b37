"""Operator 11, the trie of conversation prefixes.

Every turn becomes a SHA-256 digest where it is read, so texts are never shuffled. The turns of a
conversation, in order, are chained: the digest of a prefix is that of the digest before it and the
turn's. One row for each prefix of each conversation, grouped by (depth, digest), gives the nodes.

A node is named by its smallest member, and the nodes of one name form the end of that
conversation's chain. For subtree sums every node goes to all its ancestors along that chain: to
those of the same name by a running sum from the end, to each one above by a row with the sum of
the whole end. So a chain of n turns makes n rows and not n * n / 2, whatever its length.

A conversation's own rows are read in order by one task, one at a time. Root and common first
turns, of which very many conversations are members, are sums with partial sums in each task; the
list of ids that end in one node is cut into chunks by ranges, and only chunks meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import is_hot, join_hot, table, written

#: A conversation takes its first turns from the first of its group of GROUP ids: fewer than HEADS.
GROUP, HEADS = 5, 9
#: Ids in a chunk of a node's list.
CHUNK = 4096
_ROWS = 10_000
_ROOT = hashlib.sha256().digest()
_CHAINED = "conv_id long, depth int, digest binary, parent binary, size long, ends boolean"


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, base, other, heads (turns taken from the base), turn, turn's digest and size."""
    role, text = (F.coalesce(F.col(c).cast("binary"), F.lit(b"")) for c in ("role", "text"))
    mark = F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role, text)
    c = F.col("conv_id").cast("long")
    base = c - c % GROUP
    return rows.where(F.col("conv_id").isNotNull()).select(
        c.alias("conv_id"), base.alias("base"), (base != c).alias("other"), (F.crc32(c.cast("string")) % HEADS).cast("int").alias("heads"),
        "turn", F.unhex(F.sha2(mark, 256)).alias("mark"), F.octet_length(text).cast("long").alias("size"),
    )


class _Chain:
    """The prefixes of conversations as their turns come by."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.base = self.conv = None
        self.first: list[tuple] = []  # the first turns of the base

    def step(self, mark: bytes, size: int) -> None:
        self.depth, before = self.depth + 1, self.digest
        self.digest = hashlib.sha256(before + mark).digest()
        self.rows.append([self.conv, self.depth, self.digest, before, size, False])

    def end(self) -> None:
        if self.conv is not None:
            self.rows[-1][5] = True

    def take(self, base: int, conv: int, other: bool, heads: int, mark: bytes, size: int) -> None:
        if base != self.base:
            self.base, self.first = base, []
        if conv != self.conv:
            self.end()
            self.conv, self.depth, self.digest, self.turn = conv, 0, _ROOT, 0
            self.rows.append([conv, 0, _ROOT, None, 0, False])
            for head in self.first[:heads] if other else ():
                self.step(*head)
        if not other and len(self.first) < HEADS - 1:
            self.first.append((mark, size))
        self.turn += 1
        if not other or self.turn > heads:
            self.step(mark, size)

    def batch(self, n: int) -> pa.RecordBatch:
        out, self.rows = self.rows[:n], self.rows[n:]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "depth", "digest", "parent", "size", "ends"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain = _Chain()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "other", "heads", "mark", "size"))):
            chain.take(*row)
            if len(chain.rows) > _ROWS:  # the last row may still turn out to be an end
                yield chain.batch(_ROWS)
    chain.end()
    if chain.rows:
        yield chain.batch(len(chain.rows))


def chained(rows: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one too: conv_id, depth,
    digest, parent (the digest before), size (bytes of the last text), ends (it is the whole)."""
    dealt = _turns(rows).repartition("base").sortWithinPartitions("base", "other", "conv_id", F.asc_nulls_first("turn"), "mark")
    return dealt.select("base", "conv_id", "other", "heads", "mark", "size").mapInArrow(_chained, _CHAINED)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (digest, conv_id) in order: ids of one node, joined by commas, in chunks."""
    node, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != node or len(ids) >= CHUNK:
                close()
                node, ids = digest, []
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["digest", "first", "ids"])
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["digest", "first", "ids"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (digest, ids) in order: the digest of each node's whole list."""
    node, sha, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = ids.as_py().encode()
            if digest == node:
                sha.update(b"," + text)
            else:
                if sha:
                    out.append((node, sha.hexdigest()))
                node, sha = digest, hashlib.sha256(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["digest", "ends_sha256"])
            out = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])


def _ends(prefixes: DataFrame) -> DataFrame:
    ranged = prefixes.where("ends").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    chunks = ranged.mapInArrow(_chunks, "digest binary, first long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_list_digests, "digest binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations in ``rows`` (conv_id, turn, role, text).

    Conversation c, its turns in order (null first), is rebuilt: the first h turns of conversation
    c - c % 5, fewer if it has not as many and none if it does not exist, then its own turns after
    its first h; h is the CRC-32 of the decimal c modulo 9, and remainders have the sign of c. Each
    distinct sequence of the first d rebuilt turns (role, text) is a node; depth 0 is the root.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and ``digest``, which names the node and
    serves to join it to ``chained(rows)``. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and are left out; turns of one number are in the order of their
    digests, repeated rows being turns of their own. An empty table gives no rows, not even a
    root; other columns are ignored.
    """
    prefixes = written(chained(rows))
    # size and parent follow from the digest; as keys they need no aggregate of their own
    found = written(prefixes.groupBy("depth", "digest", "parent", "size").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")))
    children = written(found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")))
    nodes = written(found.join(children, "digest", "left").fillna(0, ["n_children"]))

    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    zero = F.lit(0).cast("long")
    from_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = prefixes.select("conv_id", "depth", "digest", zero.alias("saved"), zero.alias("leaf")).unionByName(own)
    summed = summed.select("digest", F.sum("saved").over(from_end).alias("saved"), F.sum("leaf").over(from_end).alias("leaf")).where("digest IS NOT NULL")
    sums = summed.groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    whole = nodes.join(sums, "digest").join(_ends(prefixes), "digest", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])
    names = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = written(children.where(is_hot(F.col("n_children"), nodes.count())).select(F.col("digest").alias("parent")))
    return join_hot(whole, names, "parent", "left", hot).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"
    )


def op11(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations")).drop("digest")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same nodes of a few rows of (conv_id, turn, role, text) with turns that differ, by
    comparing all conversations: for tests."""
    import zlib

    turns: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        rebuilt[c] = turns.get(c - (abs(c) % GROUP) * (1 if c > 0 else -1), [])[:h] + own[h:]
    nodes = sorted({tuple(t[:d]) for t in rebuilt.values() for d in range(len(t) + 1)}, key=len)
    members = {x: [c for c, t in rebuilt.items() if tuple(t[: len(x)]) == x] for x in nodes}
    children = {x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes) for x in nodes}
    out = []
    for x in nodes:
        below = [y for y in nodes if y[: len(x)] == x]
        saved = sum((len(members[y]) - 1) * len(y[-1][1].encode()) for y in below if y)
        ends = ",".join(map(str, sorted(c for c in members[x] if len(rebuilt[c]) == len(x))))
        out.append((
            min(members[x]), len(x), min(members[x[:-1]]) if x else None, len(members[x]), children[x],
            sum(children[y] == 0 for y in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out
