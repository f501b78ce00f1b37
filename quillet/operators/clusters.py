"""Clusters of texts and vectors: TF-IDF weights, k-means, silhouette, keywords, representatives.

Vectors are sparse or dense: a row has an id, ``v`` (its values) and ``at`` (their places), where a
null ``at`` means all places in turn. What travels to every task are the centroids of all runs,
whose size is that of the clusters and not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.sources import shared

#: Rows of which the seeds are drawn, at most, and rows turned into a matrix at a time.
SEED_ROWS, SLICE = 2000, 1024
#: Components are held as whole multiples of 1 / GRAIN, so that sums do not depend on their order.
GRAIN = float(1 << 20)


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of rows its terms, each with its uses and the rows that hold it."""
    for batch in _slices(batches):
        w = batch.column("w")
        code = w.flatten().dictionary_encode()
        names, code = code.dictionary, np.asarray(code.indices, dtype=np.int64)
        row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(w.offsets)))
        held = np.unique(row * len(names) + code) % max(1, len(names))
        uses, holders = (np.bincount(x, minlength=len(names)).astype(np.int64) for x in (code, held))
        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(uses), pa.array(holders)], names=["term", "uses", "holders"])


def vocabulary(rows: DataFrame, text: str, most: int, stopwords: list[str]) -> DataFrame:
    """term, place (from 0, in alphabetical order), idf: the ``most`` most frequent terms but stop words, ties
    to the first in the alphabet. idf is ln((1 + rows) / (1 + rows with the term)) + 1. Uses and holders
    are counted by slices of rows, a row for each term of a slice, and added; ``most`` rows are left."""
    uses = rows.select(terms(F.col(text)).alias("w")).mapInArrow(_told, "term string, uses long, holders long")
    counts = uses.where(~F.col("term").isin(list(stopwords))).groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("holders").alias("holders"))
    top = counts.orderBy(F.desc("uses"), "term").limit(most)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    return top.crossJoin(n).select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"), (F.log((1 + F.col("n")) / (1 + F.col("holders"))) + 1).alias("idf"))


def _weighed(names: pa.Array, idf: np.ndarray, field: str):
    """Rows of terms as TF-IDF vectors over these names, each row where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            w = batch.column("w")
            place = pc.index_in(w.flatten().cast(pa.string()), value_set=names)
            known = np.asarray(place.is_valid())
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(w.offsets)))[known]
            cell, n = np.unique(row * max(1, len(names)) + np.asarray(place.drop_null(), dtype=np.int64), return_counts=True)
            row, at = np.divmod(cell, max(1, len(names)))
            weight = n * idf[at]
            weight /= np.sqrt(np.bincount(row, weight * weight, minlength=len(batch)))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(at.astype(np.int32)), pa.array(weight))]
            yield pa.RecordBatch.from_arrays([batch.column(field), *lists], names=[field, "at", "v"])

    return run


def _known(rows: DataFrame, text: str, id_field: str, most: int, stopwords: list[str]) -> tuple[DataFrame, pa.Table]:
    """id and text of rows whose text is not blank, and their vocabulary: ``most`` rows at most, which go to every task."""
    rows = rows.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\S")).select(id_field, text)
    return rows, vocabulary(rows, text, most, stopwords).toArrow().sort_by("place")


def _vectors(rows: DataFrame, known: pa.Table, text: str, id_field: str) -> DataFrame:
    names, idf = known["term"].combine_chunks().cast(pa.string()), known["idf"].to_numpy()
    kind = rows.schema[id_field].dataType.simpleString()
    return rows.select(id_field, terms(F.col(text)).alias("w")).mapInArrow(_weighed(names, idf, id_field), f"`{id_field}` {kind}, at array<int>, v array<double>")


def tfidf(rows: DataFrame, text: str = "text", id_field: str = "doc_id", most: int = 1000, stopwords: list[str] = ()) -> DataFrame:
    """id, ``at`` and ``v``: the TF-IDF vector of each row over the ``most`` most frequent terms, of length 1.

    Blank and null texts are left out, before rows are counted; a row without any of the terms has
    an empty vector. Ids are unique. Rows stay in their tasks: nothing but the vocabulary's counts is shuffled.
    """
    rows, known = _known(rows, text, id_field, most, stopwords)
    return _vectors(rows, known, text, id_field)


def weights(rows: DataFrame, text: str = "text", id_field: str = "doc_id", most: int = 1000, stopwords: list[str] = ()) -> DataFrame:
    """The same as id, term and weight: a row for each term of each row."""
    rows, known = _known(rows, text, id_field, most, stopwords)
    names = rows.sparkSession.createDataFrame(known.select(["place", "term"]))  # ``most`` rows
    each = _vectors(rows, known, text, id_field).select(id_field, F.explode(F.arrays_zip("at", "v")).alias("x")).select(id_field, F.col("x.at").alias("place"), F.col("x.v").alias("weight"))
    return each.join(F.broadcast(names), "place").select(id_field, "term", "weight")


def dense(rows: DataFrame, vector: str = "embedding", id_field: str = "vec_id") -> DataFrame:
    """id, ``at`` (null) and ``v`` of rows with a vector of finite components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_field), F.lit(None).cast("array<int>").alias("at"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def default_clusters(n: int) -> int:
    """Clusters for ``n`` rows: a twentieth, 3 at least and 15 at most."""
    return min(max(3, n // 20), 15)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The rows' vectors as a matrix."""
    out, v = np.zeros((len(batch), dim)), batch.column("v")
    sizes = np.diff(np.asarray(v.offsets))
    row = np.repeat(np.arange(len(batch)), sizes)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    given = np.asarray(batch.column("at").is_valid())[row] if len(row) else np.zeros(0, dtype=bool)
    place = turn.copy()
    place[given] = np.asarray(batch.column("at").flatten())
    out[row, place] = np.asarray(v.flatten())
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1))


def seeds(sample: np.ndarray, k: int, run: int, seed: int) -> np.ndarray:
    """``k`` rows of the sample, each drawn by its squared distance to those drawn before."""
    draw = np.random.default_rng((seed, run))
    chosen = [int(draw.integers(len(sample)))]
    near = _apart(sample, sample[chosen]).ravel()
    for _ in range(1, k):
        total = near.sum()
        chosen.append(int(draw.choice(len(sample), p=near / total)) if total > 0 else int(draw.integers(len(sample))))
        near = np.minimum(near, _apart(sample, sample[chosen[-1:]]).ravel())
    return sample[chosen]


def _bytes(lists: pa.ListArray, kind: str, scale: float | None = None) -> pa.Array:
    """A column of lists of numbers as one of bytes; null lists have none."""
    values = np.asarray(lists.flatten())
    values = (np.rint(values * scale) if scale else values).astype(kind)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of bytes, and how many of each row."""
    size = np.dtype(kind).itemsize
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return values, np.diff(ends) // size


def packed(points: DataFrame) -> tuple[DataFrame, str]:
    """``at`` and ``v`` of points as bytes, values as whole multiples of 1 / GRAIN, and the type of these: float32 where it
    holds them all exactly. Written once and read in every round, so a round decodes no arrays."""
    most = points.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0.0
    kind = "f4" if most * GRAIN <= 1 << 24 else "f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([_bytes(batch.column("at"), "i4"), _bytes(batch.column("v"), kind, GRAIN)], names=["at", "v"])

    return shared.cut(points.select("at", "v").mapInArrow(run, "at binary, v binary")), kind


def _partial(centres: dict[int, np.ndarray], kind: str):
    """A task's number and sum of the rows of each cluster of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = next(iter(centres.values())).shape
        every = np.concatenate(list(centres.values()))  # all runs' centroids, for one product
        long, turned = (every**2).sum(axis=1), np.ascontiguousarray(-2 * every.T)
        first = np.arange(len(centres)) * k
        n, total = np.zeros(len(every), dtype=np.int64), np.zeros((len(every), dim), dtype=np.int64)
        for batch in _slices(batches):
            values, sizes = _numbers(batch.column("v"), kind)
            at, placed = _numbers(batch.column("at"), "i4")
            full = not len(at) and (sizes == dim).all()
            if full:
                x = values.reshape(len(batch), dim).astype(np.float64)
            else:
                row = np.repeat(np.arange(len(batch)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                place[np.repeat(placed > 0, sizes)] = at
                x = np.zeros((len(batch), dim))
                x[row, place] = values
            label = (x @ turned + long).reshape(len(x), len(centres), k).argmin(axis=2) + first
            n += np.bincount(label.ravel(), minlength=len(every))
            if full:
                member = np.zeros((len(x), len(every)))
                member[np.arange(len(x))[:, None], label] = 1.0
                total += (member.T @ x).astype(np.int64)  # whole numbers below 2**53, so exact in any order
            else:
                for i in range(len(centres)):  # only the components that there are
                    total[i * k : i * k + k] += np.bincount((label[:, i] - i * k)[row] * dim + place, values, minlength=k * dim).reshape(k, dim).astype(np.int64)
        own = [slice(i * k, i * k + k) for i in range(len(centres))]
        yield pa.RecordBatch.from_arrays([pa.array(list(centres)), pa.array([n[o].tobytes() for o in own]), pa.array([total[o].tobytes() for o in own])], names=["run", "n", "total"])

    return run


_SUMS = "run long, n binary, total binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run's numbers and sums over all tasks, added as they come; all rows of a run are in one task."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            part = [np.frombuffer(row[c], dtype=np.int64) for c in ("n", "total")]
            sums[row["run"]] = [a + b for a, b in zip(sums[row["run"]], part)] if row["run"] in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([s[i].tobytes() for s in sums.values()], pa.binary()) for i in range(2))], names=["run", "n", "total"])


def kmeans(points: DataFrame, dim: int, k: int, runs: int = 10, seed: int = 42, rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Centroids of ``k`` clusters of ``points`` (id, at, v): the best of ``runs`` starts.

    Seeds are drawn from at most SEED_ROWS rows, the first by a hash of id; each round assigns all
    rows and takes means, for all runs in one job, until a run's centroids move by no more than
    ``tolerance`` of the components' mean variance. A cluster that loses all rows keeps its
    centroid. The run with the least sum of squared distances wins, the first of equal ones; that sum less the rows'
    own squares, which are the same for all runs, follows from the clusters' sums.
    """
    name = points.columns[0]
    sample = points.orderBy(F.xxhash64(name), name).limit(SEED_ROWS).select("at", "v").toArrow()  # SEED_ROWS at most
    start = np.concatenate([np.rint(_matrix(b, dim) * GRAIN) for b in sample.to_batches()] or [np.zeros((0, dim))])
    if not len(start):
        return np.zeros((0, dim))
    spread = tolerance * start.var(axis=0).mean()
    open_ = {r: seeds(start, k, r, seed) for r in range(runs)}
    done: dict[int, tuple[float, np.ndarray]] = {}
    table, kind = packed(points)
    for turn in range(rounds):
        partial = table.mapInArrow(_partial(open_, kind), _SUMS)
        found = partial.repartition("run").mapInArrow(_added, _SUMS).toArrow().to_pylist()  # a row for each run
        moved = {r: c.copy() for r, c in open_.items()}
        inertia = {}
        for row in found:
            r, old = row["run"], open_[row["run"]]
            n, total = (np.frombuffer(row[c], dtype=np.int64).astype(np.float64) for c in ("n", "total"))
            total = total.reshape(k, dim)
            inertia[r] = float((n * (old * old).sum(axis=1)).sum() - 2 * (total * old).sum())
            moved[r][n > 0] = total[n > 0] / n[n > 0, None]
        for r in list(open_):
            if turn == rounds - 1 or ((moved[r] - open_[r]) ** 2).sum() <= spread:
                done[r] = (inertia[r], moved[r])
                open_.pop(r)
            else:
                open_[r] = moved[r]
        if not open_:
            break
    return min(done.items(), key=lambda x: (x[1][0], x[0]))[1][1] / GRAIN


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster (the nearest centroid, the first of equally near ones) and distance to it."""
    name, kind = points.columns[0], points.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            d = _apart(np.rint(_matrix(batch, centres.shape[1]) * GRAIN), centres * GRAIN)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (name, "at", "v")), pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), own]) / GRAIN)], names=[name, "at", "v", "cluster", "distance"])

    return points.select(name, "at", "v").mapInArrow(run, f"{name} {kind}, at array<int>, v array<double>, cluster int, distance double")


def _places() -> Column:
    return F.coalesce("at", F.when(F.size("v") > 0, F.sequence(F.lit(0), F.size("v") - 1)).otherwise(F.array().cast("array<int>")))


def _parts(points: DataFrame) -> DataFrame:
    """A row for each component: cluster, place, x."""
    return points.select("cluster", F.explode(F.arrays_zip(_places().alias("at"), "v")).alias("x")).select("cluster", F.col("x.at").alias("place"), F.col("x.v").alias("x"))


def silhouettes(points: DataFrame, dim: int) -> DataFrame:
    """Adds to points (id, at, v, cluster) their silhouette by squared distances, from -1 to 1.

    The mean squared distance of x to a cluster of n rows is |x|^2 - 2 x.S / n + Q / n, where S is
    the sum of its rows and Q that of their squared lengths, so no two rows meet; what every task
    gets is S, Q and n of each cluster. Rows that are alone in their cluster have 0, as have all
    rows if there is one cluster. Rows without a cluster are left out.
    """
    points = points.where(F.col("cluster").isNotNull())
    sums = _parts(points).groupBy("cluster", "place").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sizes = {r["cluster"]: r["n"] for r in points.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    order = sorted(sizes)
    s, q, n = np.zeros((len(order), dim)), np.zeros(len(order)), np.array([sizes[c] for c in order], dtype=np.float64)
    index = {c: i for i, c in enumerate(order)}
    for r in sums.toLocalIterator():  # clusters * dim rows
        s[index[r["cluster"]], r["place"]] = r["s"]
        q[index[r["cluster"]]] += r["q"]
    name, kind = points.columns[0], points.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch, dim)
            own = np.array([index[c] for c in batch.column("cluster").to_pylist()], dtype=np.int64)
            mean = np.maximum(0.0, (x**2).sum(axis=1)[:, None] - 2 * x @ s.T / n + q / n)
            at = np.arange(len(x))
            with np.errstate(divide="ignore", invalid="ignore"):
                a = mean[at, own] * n[own] / (n[own] - 1)
                mean[at, own] = np.inf
                b = mean.min(axis=1)
                score = np.where((n[own] == 1) | ~np.isfinite(b) | (np.maximum(a, b) == 0), 0.0, (b - a) / np.maximum(a, b))
            yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("cluster"), pa.array(np.nan_to_num(score))], names=[name, "cluster", "silhouette"])

    return points.select(name, "at", "v", "cluster").mapInArrow(run, f"{name} {kind}, cluster {points.schema['cluster'].dataType.simpleString()}, silhouette double")


def keywords(rows: DataFrame, stopwords: list[str], text: str = "text", id_field: str = "doc_id", top: int = 20, most: int = 5) -> DataFrame:
    """cluster, place (from 1), word, n: of the ``top`` most frequent words of each cluster's texts the first ``most``
    that are no stop words and longer than two characters. Ties go to the word that comes first, in order of id."""
    each = rows.select("cluster", F.col(id_field).alias("id"), F.posexplode(T.words(F.col(text))).alias("pos", "word"))
    counts = each.groupBy("cluster", "word").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    ranked = Window.partitionBy("cluster").orderBy(F.desc("n"), "first", "word")
    best = counts.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= top)
    best = best.where(~F.col("word").isin(list(stopwords)) & (F.length("word") > 2))
    return best.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= most).select("cluster", "place", "word", "n")


def representatives(points: DataFrame) -> DataFrame:
    """cluster, id and distance of the row nearest to the mean of its cluster, ties to the smaller id. The mean is that of
    the rows given; |x|^2 - 2 x.c + |c|^2 needs the components of x and c only, which meet by place."""
    name = points.columns[0]
    points = points.where(F.col("cluster").isNotNull())
    sizes = points.groupBy("cluster").agg(F.count("*").alias("n"))
    centre = _parts(points).groupBy("cluster", "place").agg(F.sum("x").alias("s")).join(sizes, "cluster").select("cluster", "place", (F.col("s") / F.col("n")).alias("c"))
    centres = centre.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("place", "c"))).alias("c"))  # one row of ``dim`` entries a cluster
    length = F.aggregate(F.map_values("c"), F.lit(0.0), lambda a, c: a + c * c)
    centres = centres.select("cluster", length.alias("length"), F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("c"))), lambda i: F.coalesce(F.element_at("c", i), F.lit(0.0))).alias("c"))
    joined = points.join(F.broadcast(centres), "cluster", "left")  # a cluster of empty vectors has no components
    dot = F.aggregate(F.zip_with(_places(), "v", lambda i, x: x * x - 2 * x * F.coalesce(F.get("c", i), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), dot + F.coalesce("length", F.lit(0.0))))
    nearest = joined.withColumn("d", apart).groupBy("cluster").agg(F.min(F.struct("d", name)).alias("best"))
    return nearest.select("cluster", F.col(f"best.{name}").alias(name), F.col("best.d").alias("distance"))


def excerpt(text: Column, most: int = 200) -> Column:
    """The first ``most`` characters, and three dots if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def cluster_sizes(labelled: DataFrame, least: int = 2) -> DataFrame:
    """One row: clusters of ``least`` rows or more, their mean size, the share of the largest cluster, and outliers: the
    number of clusters that are smaller. Simpson diversity is over the clusters that count."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    large = F.col("n") >= least
    total = F.sum("n")
    return sizes.agg(
        total.alias("n_rows"), F.count_if(large).alias("num_clusters"), F.count_if(~large).alias("outlier_count"),
        F.coalesce(F.round(total / F.nullif(F.count_if(large), F.lit(0)), 1), F.lit(0.0)).alias("avg_cluster_size"),
        F.coalesce(F.round(F.max("n") / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("largest_cluster_ratio"),
        F.coalesce(F.round(F.when(F.count_if(large) > 0, 1 - F.sum(F.when(large, F.col("n") * F.col("n"))) / (total * total)).otherwise(0.0), 4), F.lit(0.0)).alias("simpson"),
    )


def analysis(points: DataFrame, dim: int, k: int | None = None, least: int = 2, by: str = "silhouette", **options) -> tuple[DataFrame, DataFrame]:
    """Labelled points (id, at, v, cluster, distance), and one row of statistics: num_clusters, outlier_count,
    avg_cluster_size, largest_cluster_ratio and semantic_diversity, which is the mean silhouette moved to 0..1 (for
    vectors) or ``by`` "simpson" the clusters' Simpson index (for TF-IDF). Fewer than three rows are not
    clustered: no labelled rows, and zeros."""
    points = shared.cut(points.repartition(points.columns[0]))  # one file may be one task; a round is for all
    n = points.count()
    if n < 3:
        none = points.limit(0).select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
        return none, cluster_sizes(none, least).select("num_clusters", "outlier_count", "avg_cluster_size", "largest_cluster_ratio", F.lit(0.0).alias("semantic_diversity"))
    labelled = shared.cut(assigned(points, kmeans(points, dim, k or default_clusters(n), **options)))
    stats = cluster_sizes(labelled, least)
    if by == "simpson":
        diversity = F.col("simpson")
    else:
        mean = silhouettes(labelled, dim).agg(F.avg("silhouette").alias("mean"))  # one row
        stats = stats.crossJoin(F.broadcast(mean))
        diversity = F.when(F.col("num_clusters") + F.col("outlier_count") > 1, F.round((F.col("mean") + 1) / 2, 4)).otherwise(0.0)
    return labelled, stats.select("num_clusters", "outlier_count", "avg_cluster_size", "largest_cluster_ratio", diversity.alias("semantic_diversity"))


def topics(labelled: DataFrame, words: DataFrame, least: int = 2) -> DataFrame:
    """cluster, topic ("Cluster 3: a, b, c" of its first three keywords) and its share of all rows in percent."""
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    total = F.broadcast(sizes.agg(F.sum("n").alias("total")))  # one row
    first = words.where("place <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("words"))
    named = sizes.where(F.col("n") >= least).join(first, "cluster", "left").crossJoin(total)
    return named.select("cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), F.coalesce("words", F.lit(""))).alias("topic"), F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))
