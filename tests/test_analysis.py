"""Clusters, MinHash bands, the growing index and durations against plain versions."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import clusters as K
from quillet.operators import similar, stats
from quillet.streaming import durations, index

WORDS = ["alpha", "beta", "gamma", "delta", "The", "of", "épée", "x", "_id", "42"]


def texts(n, seed=1):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(30)))) for i in range(n)]


def test_tfidf_is_the_plain_one(spark):
    rows = [*texts(40), (100, None), (101, "  \n"), (102, "x !"), (103, "only onceever")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {i: [w for w in re.findall(r"\w\w+", t.lower())] for i, t in rows if t and t.strip()}
    uses = Counter(w for ws in plain.values() for w in ws if w not in ("the", "of"))
    known = sorted(w for w, _ in sorted(uses.items(), key=lambda x: (-x[1], x[0]))[:6])
    df_of = {w: sum(w in ws for ws in plain.values()) for w in known}
    want = {}
    for i, ws in plain.items():
        raw = {w: n * (math.log((1 + len(plain)) / (1 + df_of[w])) + 1) for w, n in Counter(ws).items() if w in known}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, w): x / norm for w, x in raw.items()}
    got = {(r.doc_id, r.term): r.weight for r in K.weights(df, most=6, stopwords=["the", "of"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    vectors = {r.doc_id: r for r in K.tfidf(df, most=6, stopwords=["the", "of"]).collect()}
    assert vectors.keys() == plain.keys() and list(vectors[102].v) == []
    assert K.weights(df.limit(0)).count() == 0


def plain_kmeans(x, k, runs, seed, rounds=300, tolerance=1e-4):
    x = np.rint(x * K.GRAIN)
    best = None
    for run in range(runs):
        c = K.seeds(x, k, run, seed)
        for turn in range(rounds):
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            inertia = d[np.arange(len(x)), own].sum()
            new = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= tolerance * x.var(axis=0).mean():
                break
        if best is None or inertia < best[0]:
            best = (inertia, c)
    return best[1] / K.GRAIN


def test_rounds_read_rows_of_one_file_in_many_tasks(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.random((6000, 64)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/one")
    labelled, _ = K.analysis(K.dense(spark.read.parquet(f"{tmp_path}/one")), 64, 3, runs=1, rounds=2)
    assert len({r[0] for r in labelled.select(F.spark_partition_id()).collect()}) > 1


def test_packed_values_keep_places_nulls_and_large_ones(spark):
    rows = [(1, [3, 0], [0.25, -1.0]), (2, None, [1.5, 2.5, 0.0, 4.0]), (3, [], []), (4, [1], [0.125])]
    for more, kind in (([], "f4"), ([(5, [2], [1e5 + 1 / 3])], "f8")):
        table, got = K.packed(spark.createDataFrame(rows + more, "id long, at array<int>, v array<double>").coalesce(1))
        assert got == kind
        batch = table.toArrow().combine_chunks().to_batches()[0].slice(1)
        values, sizes = K._numbers(batch.column("v"), kind)
        assert sizes.tolist() == [4, 0, 1] + [1] * len(more) and (values / K.GRAIN)[:5].tolist() == [1.5, 2.5, 0.0, 4.0, 0.125]
        assert [x.tolist() for x in K._numbers(batch.column("at"), "i4")] == [[1] + [2] * len(more), [0, 0, 1] + [1] * len(more)]
        assert not more or values[5] == np.rint((1e5 + 1 / 3) * K.GRAIN)


def test_tfidf_shuffles_no_rows(spark):
    df = spark.createDataFrame(texts(40), "doc_id long, text string")
    assert "Exchange" not in K.tfidf(df, most=6)._jdf.queryExecution().toString()


def test_kmeans_and_silhouette_are_the_plain_ones(spark):
    draw = np.random.default_rng(2)
    centre = draw.standard_normal((5, 6)) * 3
    x = np.concatenate([c + draw.standard_normal((30, 6)) for c in centre] + [np.full((1, 6), 40.0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (901, [float("nan")] * 6)], "vec_id long, embedding array<double>")
    points = K.dense(df.repartition(3))
    ordered = [rows[i][1] for i in [r.vec_id for r in df.where("vec_id < 900").orderBy(F.xxhash64("vec_id"), "vec_id").collect()]]
    want = plain_kmeans(np.array(ordered), 7, 3, 42)
    assert np.allclose(K.kmeans(points, 6, 7, runs=3), want)
    labelled, stats = K.analysis(points, 6, 7, runs=3)
    own = {r.vec_id: r.cluster for r in labelled.collect()}
    apart = ((x[:, None] - want[None]) ** 2).sum(axis=2)
    assert own == dict(enumerate(apart.argmin(axis=1).tolist()))
    label = np.array([own[i] for i in range(len(x))])
    pairs = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    score = []
    for i in range(len(x)):
        same = (label == label[i]) & (np.arange(len(x)) != i)
        b = min(pairs[i, label == j].mean() for j in set(label.tolist()) - {label[i]})
        score.append((b - pairs[i, same].mean()) / max(b, pairs[i, same].mean()) if same.any() else 0.0)
    got = {r.vec_id: r.silhouette for r in K.silhouettes(labelled, 6).collect()}
    assert np.allclose([got[i] for i in range(len(x))], score)
    row, sizes = stats.first(), Counter(own.values())
    assert row.outlier_count == sum(n < 2 for n in sizes.values()) >= 1 and row.num_clusters == sum(n >= 2 for n in sizes.values())
    assert row.semantic_diversity == round((sum(score) / len(score) + 1) / 2, 4)


def test_few_rows_and_empty_vectors(spark):
    points = K.dense(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    labelled, stats = K.analysis(points, 2)
    assert labelled.count() == 0 and stats.first().semantic_diversity == 0.0 and K.default_clusters(7) == 3 and K.default_clusters(10**6) == 15
    equal = K.dense(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>"))
    assert {r.cluster for r in K.analysis(equal, 2, 3)[0].collect()} == {0}
    sparse = spark.createDataFrame([(1, [0, 3], [0.6, 0.8], 0), (2, [], [], 1), (3, [3], [1.0], 0), (4, [], [], 1), (5, [1], [1.0], None)], "doc_id long, at array<int>, v array<double>, cluster int")
    assert sorted(map(tuple, K.representatives(sparse).select("cluster", "doc_id").collect())) == [(0, 1), (1, 2)]
    assert K.silhouettes(sparse, 4).count() == 4


def test_keywords_go_by_count_then_first_place(spark):
    rows = [(1, "A", "the zebra ox apple apple"), (2, "A", "mango zebra kiwi"), (3, "B", None), (4, None, "lone words")]
    df = spark.createDataFrame(rows, "doc_id long, cluster string, text string")
    got = [(r.cluster, r.place, r.word) for r in K.keywords(df, ["the"]).where("cluster IS NOT NULL").orderBy("cluster", "place").collect()]
    assert got == [("A", 1, "zebra"), ("A", 2, "apple"), ("A", 3, "mango"), ("A", 4, "kiwi")]
    labelled = df.where("cluster IS NOT NULL").select("doc_id", "cluster")
    topics = {r.cluster: (r.topic, r.percent) for r in K.topics(labelled, K.keywords(df, ["the"])).collect()}
    assert topics == {"A": ("Cluster A: zebra, apple, mango", 66.7)}
    assert [r[0] for r in df.select(K.excerpt(F.col("text"), 5)).collect()] == ["the z...", "mango...", None, "lone ..."]


def near_texts():
    draw = random.Random(4)
    rows = []
    for i in range(120):
        if rows and draw.random() < 0.5:
            words = rows[draw.randrange(len(rows))][1].split()
            for _ in range(draw.randrange(3)):
                words[draw.randrange(len(words))] = f"n{draw.randrange(99)}"
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(f"w{draw.randrange(4000)}" for _ in range(60))))
    return rows


MASK = (1 << 64) - 1


def plain_mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_bands(text):
    """The bands' least values, one at a time in Python's own numbers."""
    from xxhash import xxh3_64_intdigest

    words = re.sub(r"[^\w\s]", "", text.lower()).split()
    shingles = set()
    for i in range(len(words) - 2):
        h = 0
        for w in words[i : i + 3]:
            h = plain_mixed((h + xxh3_64_intdigest(w)) & MASK)
        shingles.add(h)
    least = [min((plain_mixed(s ^ plain_mixed((r + 1) * 0x9E3779B97F4A7C15 & MASK)) for s in shingles), default=None) for r in range(117)]
    return [tuple(least[b * 13 : b * 13 + 13]) for b in range(9)] if shingles else []


def plain_first(rows):
    bands = {i: plain_bands(t) for i, t in rows}
    out = {}
    for i, _ in rows:
        earlier = [j for j, _ in rows if j < i and any(a == b for a, b in zip(bands[i], bands[j]))]
        if earlier:
            out[i] = min(earlier)
    return out


def test_bands_are_those_of_all_pairs(spark):
    rows = near_texts()
    df = spark.createDataFrame([*rows, (500, None), (501, "two words")], "doc_id long, text string")
    want = plain_first(rows)
    assert len(want) > 20
    assert {r.doc_id: r.first for r in similar.lsh_groups(df.repartition(3)).collect()} == want


def test_hash_functions_are_independent():
    """Estimates of a known similarity spread as those of independent functions do."""
    draw, hits = np.random.default_rng(0), []
    for _ in range(200):
        both = draw.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate([both, draw.integers(0, 2**63, 20).astype(np.uint64)]) for _ in "ab")
        salts = similar.function_seeds(117)[:, None]
        hits.append((similar._mixed(a ^ salts).min(axis=1) == similar._mixed(b ^ salts).min(axis=1)).mean())
    p = 80 / 120
    assert abs(np.mean(hits) - p) < 0.02 and np.std(hits) < 1.25 * math.sqrt(p * (1 - p) / 117)


def test_growing_index_is_one_ordered_scan(spark, tmp_path):
    rows = near_texts()
    df = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    grown = index.BandIndex(spark, f"{tmp_path}/index")
    grown.add(df.where("doc_id < 40"), 0)
    grown.add(df.where("doc_id BETWEEN 40 AND 79"), 1)
    grown.add(df.where("doc_id >= 80"), 2)
    want = plain_first(rows)
    assert {r.doc_id: r.first for r in grown.found().collect()} == want
    grown.add(df.where("doc_id BETWEEN 40 AND 79"), 1)  # again
    grown.add(df.where("doc_id >= 80"), 2)
    assert {r.doc_id: r.first for r in grown.found().collect()} == want
    grown.add(df.limit(0), 3)
    state = {r.batch: (r.n, r.n_found) for r in grown.progress().collect()}
    assert state[0][0] == 40 and state[3] == (0, 0) and sum(f for _, f in state.values()) == len(want)


def test_growing_index_follows_a_stream(spark, tmp_path):
    rows = near_texts()
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    grown = index.grow(stream, f"{tmp_path}/index")
    assert grown.progress().count() == 3
    first = {r.doc_id: r.first for r in grown.found().collect()}
    assert first == plain_first(rows)


def test_durations_pair_starts_and_ends(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    one = [(1, at(0), 7, "signup"), (2, at(5), 7, "purchase"), (3, at(6), 7, "purchase"), (4, at(1), 8, "purchase"), (5, at(2), 8, "signup"), (6, at(3), 8, "signup"), (7, None, 8, "purchase"), (8, at(2), None, "signup"), (9, at(1), 9, "view")]
    two = [(10, at(40), 8, "purchase"), (11, at(60), 7, "purchase"), (12, at(60), 10, "signup"), (13, at(200), 11, "signup"), (14, at(20), 12, "signup")]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet-{k}")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/flat")
    for k in range(2):
        part = next(p for p in os.listdir(f"{tmp_path}/in/events.parquet-{k}") if p.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/events.parquet-{k}/{part}", f"{tmp_path}/flat/events.parquet-{k}")
        os.utime(f"{tmp_path}/flat/events.parquet-{k}", (1_700_000_000 + k * 100,) * 2)
    types = spark.createDataFrame([], schema).schema
    got = durations.durations(spark, f"{tmp_path}/flat", "events.parquet", types, "signup", "purchase", files=1)
    want = [(7, 1, 2, 18000.0, "done"), (7, 1, 3, 21600.0, "done"), (8, None, 4, 0.0, "no start"), (8, 5, None, None, "restarted"), (8, 6, 10, 37 * 3600.0, "done"), (7, None, 11, 0.0, "no start"), (10, 12, None, None, "timed out"), (12, 14, None, None, "timed out")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_an_agents_batch_reads_and_writes_its_state_once():
    import pandas as pd

    calls = []

    class State:
        value = (1_000_000, 7, False)

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return State()

        def deleteTimer(self, at):
            calls.append(("delete", at))

        def registerTimer(self, at):
            calls.append(("register", at))

    pairs = durations._Pairs(3_600_000_000)
    pairs.init(Handle())
    events = pd.DataFrame([(2_000_000 + i * 1_000_000, 10 + i, "start" if i % 3 == 0 else "end") for i in range(300)], columns=["at", "event_id", "kind"])
    out = pd.concat(list(pairs.handleInputRows((5,), iter([events]), None)))
    assert out["status"].value_counts().to_dict() == {"done": 200, "restarted": 1} and pairs.open.value == (299_000_000, 307, True)
    assert calls == ["exists", "get", ("delete", 3_601_000), ("register", 3_899_000), "update"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams_are_packed_across_pieces_and_chunks(spark, monkeypatch, n):
    monkeypatch.setattr(stats, "_PIECE", 4)
    monkeypatch.setattr(stats, "_CHUNK", 30)
    monkeypatch.setattr(stats, "_BUCKET_BYTES", 400)
    draw = np.random.default_rng(n)
    texts = [" ".join(draw.choice(["a", "b", "(c)", "D.", "e", "...", "ab", "\t"], int(k))) for k in draw.integers(0, 40, 60)] + [None, "", " ", "a", "a b", "a b c"] + ["a b c d e"] * 9
    words = [[w for w in (x.strip(T.MORE_EDGES) for x in (t or "").lower().split()) if w] for t in texts]
    grams = [tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)]
    got = stats.distinct_n(spark.createDataFrame([(t,) for t in texts], "text string"), "text", n).first()
    assert (got.total, got.distinct_grams, got.ratio) == (len(grams), len(set(grams)), round(len(set(grams)) / len(grams), 4))
    pairs = pa.array([[{"a": i % 5, "b": i % 5} for i in range(20)]] * 50, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
    rows = pa.Table.from_batches(stats._packed(n, 2)(iter([pa.RecordBatch.from_arrays([pairs], names=["w"])])))
    assert rows.num_rows <= 2 and sum(rows["n"].to_pylist()) == 50 * (21 - n)  # a row a bucket, not a row a gram
    assert sum(len(x) for x in rows["grams"].to_pylist()) == 5 * 16


def test_equal_first_hashes_are_told_apart():
    pairs = np.array([[7, 1], [7, 2], [7, 1], [3, 1], [7, 2]], np.uint64)
    assert stats._distinct(pairs).tolist() == [[3, 1], [7, 1], [7, 2]] and len(stats._distinct(pairs[:0])) == 0
