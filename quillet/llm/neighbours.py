"""Operator 4, nearest neighbours by multi-index hashing.

Vectors get binary codes several times as long as they have dimensions: centred, turned by
learned rotations (iterative quantisation, each from another start), signs taken. A code is cut
into substrings of about log2(n / 50) bits, and each substring is an index of its own: a table
keyed by (substring, value), the values of all substrings being joined at once. A query probes
every value within one bit of its own, so by the pigeonhole principle it meets every code within
``2 * tables - 1`` bits, and most codes somewhat further away. Of what it meets, codes within a
learned Hamming radius stay, and these are reranked by inner products of the original vectors in
double precision.

Number of tables and radius are learned on a bounded sample: so that of the neighbours there, as
many ranks deep as match the whole table's, the wanted share is met. Every vector is indexed.

Equal vectors are one class, which keeps its ``k + 1`` smallest ids: no more of them can be among
anyone's ``k`` nearest. So copies, however many, make no bucket large. Codes travel through the
index, vectors do not: candidates are gathered by blocks of vectors, and a query's vector goes
once to each block in which it has any.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import table, written

#: Rotations, tables and radius are learned on at most so many vectors, and so many of them as
#: queries (the first by a hash of vec_id).
FIT_ROWS, FIT_QUERIES = 10_000, 500
#: Rows of one value in a table, about; and the most tables.
BUCKET, MAX_TABLES = 50, 128
#: The share of the sample's neighbours that the tables, and then the radius, must meet.
WANTED = 0.975
#: Vectors in a block of the rerank, about.
BLOCK = 16_384


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and ``v`` (array of double): rows with an id and a vector that is neither null nor
    zero and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )


class Codes:
    """Learned rotations, number and width of the substrings, and the radius."""

    def __init__(self, sample: np.ndarray, n: int, k: int) -> None:
        rng = np.random.default_rng(7)
        self.width = int(min(24, max(3, np.log2(max(1, n / BUCKET)))))
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        dim = x.shape[1]
        base = np.linalg.eigh(x.T @ x)[1]
        y, turns = x @ base, []
        for _ in range(-(-MAX_TABLES * self.width // dim)):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(5):
                u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
                turn = (u @ vt).T
            turns.append(base @ turn)
        self.rotation = np.concatenate(turns, axis=1)[:, : MAX_TABLES * self.width]
        self.tables, self.radius = MAX_TABLES, MAX_TABLES * self.width
        self._learn(sample, max(1, round(k * len(sample) / max(1, n))))

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        """A row of tables * width bits for each vector."""
        return (vectors - self.centre) @ self.rotation[:, : self.tables * self.width] >= 0

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """The substrings' values."""
        parts = bits.reshape(len(bits), -1, self.width)
        return parts @ (1 << np.arange(self.width, dtype=np.int64))

    def _learn(self, sample: np.ndarray, depth: int) -> None:
        score = sample[:FIT_QUERIES] @ sample.T
        score[np.arange(len(score)), np.arange(len(score))] = -np.inf
        depth = min(depth, len(sample) - 1)
        if depth < 1:
            return
        near = np.argpartition(-score, depth - 1, axis=1)[:, :depth].ravel()
        used, at = np.unique(np.append(np.arange(len(score)), near), return_inverse=True)
        bits = np.concatenate([self.bits(sample[used[i : i + 1000]]) for i in range(0, len(used), 1000)])  # a tenth of the products at a time
        apart = bits[np.repeat(at[: len(score)], depth)] ^ bits[at[len(score) :]]
        met = np.cumsum((apart.reshape(len(near), -1, self.width).sum(axis=2) <= 1), axis=1) > 0
        share = met.mean(axis=0)
        self.tables = int(min(MAX_TABLES, 8 * -(-(1 + int(np.argmax(share >= WANTED)) if share[-1] >= WANTED else MAX_TABLES) // 8)))
        self.radius = int(np.ceil(np.quantile(apart[:, : self.tables * self.width].sum(axis=1), WANTED)))


def _coded(rows: DataFrame, codes: Codes) -> DataFrame:
    """c (the class), subs (values of the substrings) and the code as longs c0, c1, ..."""
    n_words = -(-codes.tables * codes.width // 64)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column("v")
            bits = codes.bits(vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(len(batch), -1))
            subs = codes.substrings(bits).astype(np.int32)
            whole = np.zeros((len(bits), 64 * n_words), dtype=np.uint8)
            whole[:, : bits.shape[1]] = bits
            words = np.packbits(whole, axis=1).view(np.int64)
            ends = np.arange(0, subs.size + 1, subs.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), pa.ListArray.from_arrays(ends, subs.ravel()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(n_words))],
                names=["c", "subs", *(f"c{i}" for i in range(n_words))],
            )

    return rows.select("c", "v").mapInArrow(run, "c long, subs array<int>, " + ", ".join(f"c{i} long" for i in range(n_words)))


def _reranked(k: int):
    """Per block: the best ``k`` ids of each query, of its candidates there (null: of all)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype({"q": "int64", "vec_id": "int64", "score": "float64"})]
        if len(left) and len(right):
            left = left.sort_values("c")
            x, c, ids = np.stack(left["v"].to_numpy()), left["c"].to_numpy(), left["ids"].to_numpy()
            first = np.array([i[0] for i in ids])
            queries, names = np.stack(right["v"].to_numpy()), right["q"].to_numpy()
            places = [np.arange(len(c)) if w is None else np.searchsorted(c, w) for w in right["wanted"]]
            sizes = np.cumsum([len(p) for p in places])
            start = 0
            while start < len(places):  # about 2**16 inner products at a time
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + 2**16)))
                at = np.concatenate(places[start:stop])
                who = np.repeat(np.arange(start, stop), [len(p) for p in places[start:stop]])
                score = (x[at] * queries[who]).sum(axis=1)
                order = np.lexsort((first[at], -score, who))
                at, who, score = at[order], who[order], score[order]
                turn = np.arange(len(who)) - np.searchsorted(who, who)
                at, who, score = at[turn < k], who[turn < k], score[turn < k]
                n = np.array([len(ids[i]) for i in at], dtype=np.int64)
                found = np.concatenate([ids[i] for i in at]) if len(at) else np.empty(0, dtype=np.int64)
                who, score = np.repeat(who, n), np.repeat(score, n)
                order = np.lexsort((found, -score, who))
                who, score, found = who[order], score[order], found[order]
                turn = np.arange(len(who)) - np.searchsorted(who, who)
                best = turn < k
                out.append(pd.DataFrame({"q": names[who[best]], "vec_id": found[best], "score": score[best]}))
                start = stop
        return pd.concat(out)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).drop("place")


def _sample(classes: DataFrame, n: int) -> np.ndarray:
    """The vectors of the FIT_ROWS first of ``n`` classes by a hash of ``c``. Each task sends the first FIT_ROWS of its own rows to
    the driver, so only rows below a bound of the hash are asked for, about a tenth more than FIT_ROWS over all tasks."""
    place, share = F.xxhash64("c"), 1.1 * FIT_ROWS / max(1, n)
    while True:
        few = classes if share >= 1 else classes.where(place < F.lit(int(share * 2**64) - 2**63))
        found = few.orderBy(place, "c").limit(FIT_ROWS).select("v").collect()
        if share >= 1 or len(found) == FIT_ROWS:
            return np.array([r["v"] for r in found])
        share *= 2


def _search(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The search among usable vectors of one dimension: query_id, vec_id, score, the ``k`` best."""
    same = ["h1", "h2"]
    keyed = lambda df: df.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    least = Window.partitionBy(*same).orderBy("vec_id")
    few = keyed(rows).withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    classes = few.groupBy(*same).agg(F.min("vec_id").alias("c"), F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.select("c", "v", "ids"))
    members = written(keyed(asked).select("vec_id", "v", *same))
    queries = written(members.groupBy(*same).agg(F.min("vec_id").alias("c"), F.first("v").alias("v")))
    n = classes.count()
    codes = Codes(_sample(classes, n), n, k)
    n_blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("c"), F.lit(n_blocks))

    index, probes = _coded(classes, codes), _coded(queries, codes)
    words = [c for c in index.columns if c not in ("c", "subs")]
    key = lambda t, value: (t * F.lit(1 << codes.width) + value).cast("long")
    index = index.select("c", *words, F.posexplode("subs").alias("t", "value")).select(key(F.col("t"), F.col("value")).alias("key"), "c", *words)
    near = F.concat(F.array("value"), F.transform(F.sequence(F.lit(0), F.lit(codes.width - 1)), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i))))
    probes = probes.select(F.col("c").alias("q"), *(F.col(w).alias(f"q{w}") for w in words), F.posexplode("subs").alias("t", "value"))
    probes = probes.select("q", *(f"q{w}" for w in words), "t", F.explode(near).alias("value")).select(key(F.col("t"), F.col("value")).alias("key"), "q", *(f"q{w}" for w in words))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"q{w}"))) for w in words))
    # by its file's size, which the probes' number and width do not show, Spark would broadcast them through the driver
    met = index.join(probes.hint("merge"), "key").where(apart <= codes.radius).select("q", "c", block.alias("block"))
    wanted = met.groupBy("block", "q").agg(F.collect_set("c").alias("wanted"))

    vectors = queries.select(F.col("c").alias("q"), "v")
    blocks = classes.withColumn("block", block)
    schema = "q long, vec_id long, score double"
    rerank = lambda asked: _first(blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_reranked(k + 1), schema), k + 1)
    found = written(rerank(wanted.join(vectors, "q").select("block", "q", "wanted", "v")))
    # queries that met too few look at every block
    enough = found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > k).select("q")
    short = written(vectors.join(enough, "q", "left_anti"))
    if not short.isEmpty():
        rest = short.select("q", "v", F.lit(None).cast("array<long>").alias("wanted"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        rest = rest.select(F.col("block").cast("long").alias("block"), "q", "wanted", "v")
        found = found.join(enough, "q", "left_semi").unionByName(rerank(rest))
    each = members.join(queries.select(*same, F.col("c").alias("q")), same).select(F.col("vec_id").alias("query_id"), "q")
    return each.join(found, "q").where("vec_id <> query_id").select("query_id", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest of ``rows`` to each of ``queries`` by inner product, of those found.

    Both have vec_id and embedding; other columns are ignored. Returns query_id, rank (from 1),
    vec_id and score; ties go to the smaller vec_id; a vector is no neighbour of rows with its own
    id. Rows without an id, and vectors that are null, zero or hold other than finite components,
    take no part. Vectors of different dimensions have no inner product: each dimension is
    searched apart. Of rows with the same id and vector one counts; an id with several vectors is
    a query, and a neighbour, by each of them, and counts once with its best. An empty table gives
    no rows. A query that meets fewer than ``k`` others looks at all vectors.
    """
    rows, asked = usable(rows).distinct(), usable(queries).distinct()
    dims = sorted(r["d"] for r in asked.select(F.size("v").alias("d")).distinct().collect())  # the dimensions in use
    of = lambda df, d: df.where(F.size("v") == d)
    parts = [_search(of(rows, d), of(asked, d), k) for d in dims if not of(rows, d).isEmpty()]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest to every vector whose id is divisible by 20, of all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
