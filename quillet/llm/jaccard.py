"""Operator 3, exact Jaccard join on word shingles.

The join is a sparse product of the document by shingle incidence with itself, in which only
what can reach the bound is multiplied:

* Documents with the same set are one *class*; the product runs over classes.
* All shingles have one order, those that many documents share last. Two sets of Jaccard
  similarity t share, among the first ``n - ceil(t n) + LEVEL`` shingles of each, at least
  ``LEVEL`` ones, so only these columns are kept (a class's prefix).
* A pair is discarded where its sizes, the places of a shared shingle in both sets, or the
  count of shared prefix shingles bar it from the bound.
* What is left is verified on the whole sets.

Pairs inside a component that is already known need no product. So a first round multiplies
each column only with one row, its *centre* (the class most made of shared shingles), and joins
what is verified; the second round multiplies, in blocks, just the pairs of a column that still
lie in different components. A group of thousands of near copies thus costs about one pair for
each member. No link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import gram_hashes, is_hot, join_hot, mixed, table, text_bytes, word_hashes, written

LEVEL = 4
#: Size of the sketch that says which shingles many documents share. It is a fixed number of
#: counters whatever the input and decides only about the order, never about the result.
_BINS = 1 << 18
_CHUNK = 2_000_000
#: Columns whose counter has this binary logarithm are dealt to several tasks in the first round.
_HOT = 12
#: Further rounds with centres drawn by a hash.
_TURNS = 1
#: A pair of the last round must meet in so many of the first columns it can first meet in.
_MEETINGS = 1
#: Edges that one task may hold.
_FEW = 1_000_000
#: Rows of a column that form a block in the last round.
_BLOCK_ROWS = 2048
#: Pairs that the last round compares at once.
_PAIRS = 1 << 16
#: 64-bit words of a set's bit map, which bounds from above what two sets share.
_WORDS = 16


def shingles(data: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lower-cased; with fewer words than a
    shingle has, the whole sequence as one; without words, none."""
    hashes = word_hashes(data.lower())
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(words, len(hashes))))


def _fingerprint(found: np.ndarray) -> int:
    """One number for a set."""
    return int(np.bitwise_xor.reduce(mixed(found + np.uint64(len(found)))).astype(np.int64)) if len(found) else 0


def _bit_map(found: np.ndarray) -> list[int]:
    """A bit for each shingle, by hash. A bit that only one of two sets has stands for a shingle
    at least that only that set has."""
    bits = np.zeros(64 * _WORDS, dtype=np.uint8)
    bits[(mixed(found ^ np.uint64(1)) % np.uint64(64 * _WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _bins(found: np.ndarray) -> np.ndarray:
    return (mixed(found) >> np.uint64(64 - 18)).astype(np.int64)


def _sizes(words: int):
    """Rows (kind 0) of doc_id, set size, fingerprint and the text's hash, and (kind 1) of counter
    and count for shingles that several documents of a chunk share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, seen = [], 0, set()

        def sketch() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(chunk), return_counts=True)
            shared = n > 1
            total = np.bincount(_bins(values[shared]), weights=n[shared], minlength=_BINS)
            at = np.flatnonzero(total)
            none = np.zeros(len(at), np.int64)
            return _rows(np.ones(len(at), np.int8), at, total[at].astype(np.int64), none, none)

        for batch in batches:
            n, prints = [], []
            for data in batch.column(2):
                found = shingles(data.as_py(), words)
                n.append(len(found))
                prints.append(_fingerprint(found))
                if prints[-1] not in seen:
                    seen.add(prints[-1])
                    chunk.append(found)
                    size += len(found)
                if size > _CHUNK:
                    yield sketch()
                    chunk, size = [], 0
            yield _rows(np.zeros(len(n), np.int8), batch.column(0), n, prints, batch.column(1))
        if chunk:
            yield sketch()

    return run


def _rows(kind, doc_id, n, print_, owner) -> pa.RecordBatch:
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((kind, doc_id, n, print_, owner), types)],
        names=["kind", "doc_id", "n", "class", "owner"],
    )


def _prefixes(words: int, percent: int, levels):
    """Class, size, share of common shingles (in thousandths) and prefix of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            rows = []
            for doc_id, owner, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = shingles(data.as_py(), words)
                n, print_ = len(found), _fingerprint(found)
                if not n or print_ in seen:
                    continue
                seen.add(print_)
                common = level[_bins(found)]
                least = -(-percent * n // 100)
                prefix = found[np.lexsort((found, common))][: n - least + min(LEVEL, least)]
                rows.append((doc_id, owner, print_, n, int(1000 * (common > 0).mean()), prefix.view(np.int64), level[_bins(prefix)], _bit_map(found)))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "owner", "class", "n", "common", "prefix", "levels", "bits"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(data.as_py(), words).tobytes() for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class", "grams"])

    return run


def _linked(percent: int):
    """Pairs whose whole sets reach the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_reach(n_a, n_b, pos_a, pos_b, percent: int):
    """Whether the sizes and one shared shingle's places leave the bound in reach. Works on
    columns and on arrays: what stands before both places, the shingle, what stands after."""
    least, both = (F.least, F.lit(1)) if hasattr(n_a, "cast") else (np.minimum, 1)
    overlap = least(pos_a, pos_b) + both + least(n_a - pos_a - 1, n_b - pos_b - 1)
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def _cross(percent: int):
    """Pairs in different components of one column, or pair of its blocks. Rows come sorted by
    shingle and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in _with_end(batches):
            rows = rest if batch is None else [*rest, np.column_stack([np.asarray(c) for c in batch.columns])]
            rest = []
            if not rows:
                continue
            rows = np.concatenate(rows)
            starts = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
            ends = np.append(starts[1:], len(rows))
            if batch is not None:  # the last column may go on in the next batch
                rest = [rows[starts[-1] :]]
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                yield from _column_pairs(rows[: ends[-1]], starts, ends, percent)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _suffix(n, percent: int):
    """How many shingles of a set of ``n`` its prefix leaves out."""
    least = -(-percent * n // 100)
    return least - np.minimum(LEVEL, least)


def _column_pairs(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the columns that begin and end at these rows, together: most columns hold a few rows, and a
    column at a time would spend its time on calls. Of the pairs, ``_PAIRS`` and one row's are in memory.

    Of a row: shingle, the two blocks met here and the row's own, class, n, pos, component, in how
    many open columns the class is and the place of this one among them, and the bit map.

    What two sets share outside their prefixes lies in the suffix of the one whose prefix ends
    first, so ``need`` of the prefix shingles must be shared for the bound to be in reach. The
    first of these have places that leave room for the others: only there a pair is named.
    """
    _, x_block, y_block, block, cls, n, pos, comp, open_, rank = np.ascontiguousarray(rows[:, :10].T)
    bits = rows[:, 10:].view(np.uint64)
    two = x_block != y_block  # pairs inside a block are met where it is met with itself
    suffix = _suffix(n, percent)
    apart = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    after = np.repeat(np.where(apart, ends, starts), ends - starts) - np.arange(len(rows)) - 1  # a row meets those after it
    after = np.maximum(after, 0)
    total = np.cumsum(after)
    to = 0
    while to < len(rows):
        at, to = to, max(to + 1, int(np.searchsorted(total, total[to] - after[to] + _PAIRS, "right")))
        met = after[at:to]
        x = np.repeat(np.arange(at, to), met)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(met) - met, met)
        ok = (comp[x] != comp[y]) & (~two[x] | (block[x] != block[y]))
        x, y = x[ok], y[ok]
        ok = _may_reach(n[x], n[y], pos[x], pos[y], percent)
        x, y = x[ok], y[ok]
        need = -(-percent * (n[x] + n[y]) // (100 + percent)) - np.maximum(suffix[x], suffix[y])
        left = np.minimum(open_[x] - rank[x], open_[y] - rank[y])
        ok = (left >= need - np.minimum(_MEETINGS, need)) & (np.minimum(rank[x], rank[y]) + left >= need)
        x, y, need = x[ok], y[ok], need[ok]
        shared = np.minimum(
            n[x] - np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1, dtype=np.int64),
            n[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1, dtype=np.int64),
        )
        ok = (100 + percent) * shared >= percent * (n[x] + n[y])
        if ok.any():
            a, b, need = cls[x][ok], cls[y][ok], np.minimum(_MEETINGS, need[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])


def _with_least(edges: DataFrame, least: DataFrame, key: str, n: int) -> DataFrame:
    """Edges with the least neighbour ``m`` of their ``key``. Up to ``_FEW`` edges any hub is one
    task's work; beyond, hubs are looked up in a broadcast."""
    if n <= _FEW:
        return edges.join(least.drop("n"), key)
    least = written(least)
    return join_hot(edges, least.drop("n"), key, hot=least.where(is_hot(F.col("n"), n)).select(key))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for all nodes of edges ``a``, ``b``.

    Alternating large and small stars; each round is a sum by node and a join, and the edges
    are written between rounds. A node with a good share of all edges is looked up in a
    broadcast. Nothing but two totals comes to the driver.
    """
    now = written(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct())
    total = None
    while True:
        n = now.count()
        both = now.unionAll(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))  # lo: the node, hi: its neighbour
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.col("lo")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, "lo", 2 * n).where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct()
        large = written(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, least, "hi", n)
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionAll(joined.select(F.col("m").alias("lo"), "hi"))
        now = written(small.where("lo <> hi").distinct())
        last, total = total, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if last == total:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, class (of equal sets; null for an
    empty set), component_id, owner (the text's hash), and first (whether doc_id and owner are
    the least of the component, null ids last; null for an empty set).

    Two documents link when their shingle sets have a Jaccard similarity of ``percent``
    hundredths or more; component_id is the least doc_id that links reach, its own included.
    Null and empty texts, and those of white space only, have an empty set and link with
    nothing. Repeated rows are equal sets. Null doc_ids take part, but never become a
    component_id unless nothing else is in reach. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("owner"), text_bytes().alias("text"))
    sized = written(texts.mapInArrow(_sizes(words), "kind byte, doc_id long, n long, class long, owner long"))
    counters = np.zeros(_BINS, dtype=np.float64)
    for row in sized.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # a row a counter at most
        counters[row["doc_id"]] = row["n"]
    levels = spark.sparkContext.broadcast(np.ceil(np.log2(counters + 1)).astype(np.int8))

    schema = "doc_id long, owner long, class long, n int, common int, prefix array<long>, levels array<byte>, bits array<long>"
    kept = written(texts.mapInArrow(_prefixes(words, percent, levels), schema).dropDuplicates(["class"]))
    column = kept.select("class", "n", "common", F.posexplode(F.arrays_zip("prefix", "levels")).alias("pos", "p")).select(
        F.col("p.prefix").alias("shingle"), "class", "n", "pos", "common",
        F.when(F.col("p.levels") >= _HOT, F.pmod("class", F.lit(64))).otherwise(-1).cast("int").alias("part"),
    )
    place = Window.partitionBy("shingle", "part")
    first = place.orderBy(F.desc("common"), "class")
    centred = column.select(
        "shingle", "class", "n", "pos", "common", "part",
        F.first(F.struct("class", "n", "pos")).over(first).alias("centre"), F.count("*").over(place).alias("m"),
    )
    multi = written(centred.where("m > 1 OR part >= 0").drop("m"))
    # of a column dealt to several tasks, the centres meet once more
    again = Window.partitionBy("shingle").orderBy(F.desc("common"), "class")
    centres = multi.where("part >= 0 AND class = centre.class").withColumn("centre", F.first(F.struct("class", "n", "pos")).over(again))
    tried = _pairs(multi.unionByName(centres), percent)

    level = F.least(F.lit(LEVEL), F.ceil(F.col("n") * percent / 100))
    multi = multi.select("shingle", "class", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    needed = multi.groupBy("class").agg(F.count("*").alias("m"), F.first("n").alias("n")).where(F.col("m") >= level)
    wanted = kept.select("doc_id", "owner", "class").join(needed.select("class"), "class", "left_semi")
    wanted = wanted.select("class", F.col("owner").alias("own"), F.col("doc_id").alias("id"))
    texts_of = texts.join(wanted, (F.col("owner") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
    grams = written(texts_of.select("class", "text").mapInArrow(_sets(words), "class long, grams binary").dropDuplicates(["class"]))

    edges = written(_verified(tried, grams, percent))
    found = components(edges)
    for turn in range(_TURNS):  # other centres for what is still apart
        rest = _open(multi, found)
        by_turn = Window.partitionBy("shingle").orderBy(F.xxhash64("class", F.lit(turn)), "class")
        centred = rest.withColumn("centre", F.first(F.struct("class", "n", "pos", "comp")).over(by_turn))
        more = _pairs(centred.where("comp <> centre.comp"), percent)
        edges = written(edges.unionAll(_verified(more, grams, percent)))
        found = components(edges)
    rest = _open(multi, found)
    large = written(rest.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > _BLOCK_ROWS))
    own = Window.partitionBy("class")
    rest = rest.withColumn("open", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("pos")).cast("long"))
    rest = rest.where(F.col("open") >= F.greatest(F.lit(1), level - 1))  # no pair needs fewer
    rest = rest.join(kept.select("class", "bits"), "class")
    rest = rest.select("shingle", "class", "n", "pos", "comp", "open", "rank", *(F.col("bits")[w].alias(f"bits{w}") for w in range(_WORDS)))
    rest = _in_blocks(rest, large)
    cross = rest.mapInArrow(_cross(percent), "a long, b long, need long")
    cross = cross.groupBy("a", "b", "need").agg(F.count("*").alias("m")).where("m >= need").select("a", "b")
    found = components(edges.unionAll(_verified(cross, grams, percent)))

    rows = sized.where("kind = 0").select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"), "owner")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "owner")  # null ids last
    ids = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(one).alias("least"))
    rooted = ids.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ends = rooted.groupBy("root").agg(F.min("least").alias("end"))
    by_class = rooted.join(ends, "root").select("class", F.col("end.doc_id").alias("component_id"), F.col("end.owner").alias("end"))
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("owner") == F.col("end"))
    return join_hot(rows, by_class, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("component_id", "doc_id").alias("component_id"),
        "owner", F.when(F.col("class").isNotNull(), is_first).alias("first"),
    )


def _in_blocks(rest: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of the columns, ``large`` ones (with their number of rows, ``m``) dealt into blocks: a row
    goes to each pair (x, y) of blocks that its own block is part of. So a column's pairs are
    spread over tasks, and a matrix is never larger than two blocks."""
    if large.isEmpty():
        dealt = rest.withColumns({c: F.lit(0).cast("long") for c in ("x", "y", "block")})
    else:
        n = F.coalesce(F.ceil(F.col("m") / _BLOCK_ROWS), F.lit(1)).cast("long")
        dealt = rest.join(large, "shingle", "left").withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    dealt = dealt.select("shingle", "x", "y", "block", *(c for c in rest.columns if c != "shingle"))
    return dealt.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")


def _open(multi: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of those columns that still hold different components, with ``comp``."""
    labels = found.select(F.col("node").alias("class"), "root")
    labelled = multi.join(labels, "class", "left").select("shingle", "class", "n", "pos", F.coalesce("root", "class").alias("comp"))
    labelled = written(labelled)
    apart = labelled.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("shingle")
    return written(labelled.join(apart, "shingle", "left_semi"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs of class and centre that share enough columns for a first try."""
    c = "centre"
    ok = _may_reach(F.col("n"), F.col(f"{c}.n"), F.col("pos"), F.col(f"{c}.pos"), percent)
    pairs = rows.where(F.col("class") != F.col(f"{c}.class")).where(ok)
    pairs = pairs.groupBy(F.least("class", f"{c}.class").alias("a"), F.greatest("class", f"{c}.class").alias("b"))
    return written(pairs.agg(F.count("*").alias("m"), F.min("n").alias("n")).where(F.col("m") >= F.least(F.lit(LEVEL), "n")).select("a", "b"))


def _verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    right = grams.select(F.col("class").alias("b"), F.col("grams").alias("right"))
    left = grams.select(F.col("class").alias("a"), F.col("grams").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return both.mapInArrow(_linked(percent), "a long, b long")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row stays, with all its columns: that with the least doc_id (null
    ids last), and of several such rows that with the least hash of its text. Rows whose set is
    empty link with nothing, so all of them stay. A doc_id may stand in several components."""
    key = ["id__", "none__", "owner__"]
    keyed = lambda df, owner: df.withColumns({"id__": F.coalesce("doc_id", F.lit(0)), "none__": F.col("doc_id").isNull(), "owner__": owner})
    gone = keyed(classes(docs, words, percent).where("NOT first"), F.col("owner")).select(*key).distinct()
    full = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))  # holds a word
    kept = keyed(docs.where(full), F.xxhash64("text")).join(gone, key, "left_anti").dropDuplicates(key)
    return kept.drop(*key).unionByName(docs.where(~full))


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents by 5-word shingles and a similarity of 0.8."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(rows: list[tuple], words: int = 5, percent: int = 80) -> list[tuple]:
    """The same on a few rows of (doc_id, text), by comparing all pairs of sets: for tests."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(top(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]
