"""Every query against its SQL in DuckDB on the smallest tables; those without SQL against plain versions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillet import queries
from quillet.operators import algebra, collaboration, dedup, order, similar, stats

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "events", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLE_SQL[name])
    assert sorted(c[0] for c in want.description) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_leaders_are_those_of_a_scan(spark):
    import random

    draw = random.Random(3)
    edges = sorted({tuple(sorted(draw.sample(range(40), 2))) for _ in range(60)})
    want = {}
    for i in range(40):
        if i not in want:
            want[i] = i
            want.update({b: i for a, b in edges if a == i and b not in want})
    ids = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = similar.leaders(spark.createDataFrame(edges, "a long, b long"), ids).collect()
    assert {r.id: r.leader for r in got} == want


def test_rounds_of_leaders_leave_one_state(spark, monkeypatch, tmp_path):
    import uuid

    monkeypatch.setattr(similar.shared, "folder", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    got = similar.leaders(edges, spark.createDataFrame([(i,) for i in range(10)], "id long")).collect()
    assert {r.id: r.leader for r in got} == {i: i - i % 2 for i in range(10)}
    assert len(list(tmp_path.iterdir())) <= 3


def test_groups_leave_little_on_the_disk(spark, monkeypatch, tmp_path):
    import uuid

    monkeypatch.setattr(similar.shared, "folder", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    texts = ["a b c d e f g h i j", "A, b c d e f g h i k", "x y", "Y x!", None, " .", "a b c d e f g h i j l", "a b c d e f g h i"]
    got = similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.leader for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 0, 7: 0}
    assert len(list(tmp_path.iterdir())) <= 8


@pytest.mark.parametrize("percent", [0, 34, 50, 75, 80, 100])
def test_jaccard_pairs_are_those_of_brute_force(spark, percent):
    import random

    draw = random.Random(percent)
    texts = [" ".join(["hot"] + draw.sample("abcdefghijklmnop", draw.choice([1, 2, 3, 4, 7, 8, 15, 16]))) for _ in range(150)] + ["hot", "hot", "", None]
    sets = {}
    for i, t in enumerate(texts):
        if t:
            sets.setdefault(frozenset(t.split()), i)
    want = {tuple(sorted((i, j))) for a, i in sets.items() for b, j in sets.items() if i < j and a & b and 100 * len(a & b) >= percent * len(a | b)}
    got = similar.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_jaccard_pairs_of_near_copies_meet_few_times_and_in_small_blocks(spark, monkeypatch):
    import random

    draw = random.Random(5)
    base = [[f"w{b}x{i}" for i in range(60)] for b in range(3)]
    sets = [frozenset(draw.sample(base[i % 3], 57 if i % 2 else 54) + ["hot"]) for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(sets)], "doc_id long, text string").repartition(3)
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    monkeypatch.setattr(similar, "KNOWN", 10)
    monkeypatch.setattr(similar, "BLOCK", 4)
    got = similar.jaccard_pairs(rows, 80)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300


def test_jaccard_pairs_are_counted_where_they_meet(spark, monkeypatch):
    """Sets that share a few words of their prefixes only are not named, and large parts are dealt into blocks."""
    import random

    import numpy as np
    import pyarrow as pa

    draw = random.Random(8)
    sets = [draw.sample(range(20_000), 250) for _ in range(60)]
    sets += [w[:230] + draw.sample(range(20_000, 30_000), 20) for w in sets[:10]]
    none = np.zeros(0, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(70)), pa.array([sorted(w) for w in sets], pa.list_(pa.int64()))], names=["id", "words"])
    rows = pa.Table.from_batches(similar._packed(none, none, 80)(iter([batch])))
    rows = rows.append_column("home", pa.array([True] * len(rows)))
    named, met = set(), set()
    for of, part in {(r["class"], r["part"]) for r in rows.select(["class", "part"]).to_pylist()}:
        group = rows.filter(pa.array([r["class"] == of and r["part"] == part for r in rows.select(["class", "part"]).to_pylist()]))
        named |= {(r["a"], r["b"]) for r in similar._met(80)(group).to_pylist()}
        held = {r["id"]: set(r["words"]) for r in group.to_pylist()}
        met |= {(a, b) for a in held for b in held if a < b and held[a] & held[b]}
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert len(want) == 10 and want <= named and 10 * len(named) < len(met)
    monkeypatch.setattr(similar, "PART", 100)
    texts = spark.createDataFrame([(i, " ".join(f"w{x}" for x in w)) for i, w in enumerate(sets)], "doc_id long, text string")
    assert sorted(map(tuple, similar.jaccard_pairs(texts, 80).collect())) == sorted(want)


def test_prefixes_tell_words_of_one_hash_apart():
    import numpy as np
    import pyarrow as pa

    none = np.zeros(0, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([4, 9]), pa.array([[7, 7, 5], [7, 7, 7]], pa.list_(pa.int64()))], names=["id", "words"])
    found = pa.Table.from_batches(similar._prefixes(none, none, 80)(iter([batch]))).to_pylist()
    words = {i: {r["word"] for r in found if r["id"] == i} for i in (4, 9)}
    assert len(words[4]) == len(words[9]) == 3 and len(words[4] & words[9]) == 2


def test_scripts_are_those_of_counted_letters_without_replacing_all_else(spark):
    from quillet.functions import text as T

    texts = ["Ёлка и ёж", "plain words", "中文字 a", "мир peace", "中 words words words", "é ü 12", "", None, "ab cd ёж йц ab"]
    found = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.language(F.col("text")).alias("s"))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()

    def plain(t):
        cy, la, zh = (sum(any(a <= c <= b for a, b in r) for c in t or "") for r in (("ая", "АЯ", "ёё", "ЁЁ"), ("az", "AZ"), ("一鿿",)))
        n = cy + la + zh
        return "other" if not n else "zh" if zh > 0.3 * n else "ru" if cy > 0.5 * n else "en" if la > 0.5 * n else "mixed" if cy > 0.2 * n and la > 0.2 * n else "other"

    assert [r.s for r in found.orderBy("i").collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("few", [0, 100])
def test_budgets_reach_the_first_rows(spark, monkeypatch, few):
    monkeypatch.setattr(order, "_FEW", few)
    rows = spark.createDataFrame([(i,) for i in (9, 4, None, 7, 1)], "k long")
    reached = lambda *limits: sorted((r.idx, r.k) for r in order.budget(rows, "k", *limits).collect())
    assert reached(1, 2.9, 50) == [(0, None), (1, 1)] and len(reached(5, 3, 50)) == 5 and reached(5, 3, 0) == []


def test_bands_find_copies_and_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, base + " more"), (4, " ".join(f"v{i}" for i in range(200))), (5, None), (6, "two words"), (7, "two words")]
    got = {r.doc_id: r.first for r in similar.lsh_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 1, 3: 1}


def plain_bleu(r, h, most):
    import math
    from collections import Counter

    if not r or not h:
        return 0.0
    logs = []
    for n in range(1, min(most, len(h)) + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
        hit = sum((a & b).values())
        if not hit:
            return 0.0
        logs.append(math.log(hit / sum(b.values())))
    return (1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(logs) / len(logs))


def test_self_bleu_is_that_of_all_pairs(spark):
    texts = ["a b c d", "a b c e", "x y", "a b", "", "A, b! c d e f", "q"]
    tokens = [[w.strip(".,!?;:()[]{}\"'-") for w in t.lower().split()] for t in texts]
    tokens = [t for t in tokens if t]
    best = [max(plain_bleu(r, h, 3) for j, r in enumerate(tokens) if j != i) for i, h in enumerate(tokens)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert stats.self_bleu(df, "text", "id", 3).first()[0] == round(sum(best) / len(best), 4)


def test_keep_first_and_versions_with_null_and_repeated_keys(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, "a"), (None, None), (3, ""), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text or "") for r in dedup.keep_first(df, F.col("text")).collect()), key=repr)
    assert kept == sorted([(1, "a"), (1, "b"), (None, "c"), (None, "")], key=repr)
    assert dedup.keep_first(df.limit(0), F.col("text")).count() == 0
    other = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (4, "n")], "doc_id long, text string")
    changes = sorted(((r.doc_id, r.change) for r in algebra.diff(df, other, "doc_id").collect()), key=repr)
    assert changes == sorted([(1, "unchanged"), (2, "removed"), (3, "removed"), (4, "added"), (None, "unchanged"), (None, "removed")], key=repr)
    assert algebra.merge(df.limit(0), other, "doc_id").count() == 3


def test_ordinals_hold_nulls_ties_and_sparse_keys(spark):
    keys = [None, 5, 5, 1 << 60, -(1 << 60), None, 7]
    got = order.ordinals(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert sorted(r.idx for r in got) == list(range(7))
    assert [r.k for r in sorted(got, key=lambda r: r.idx)] == [None, None, -(1 << 60), 5, 5, 7, 1 << 60]
    assert order.ordinals(spark.createDataFrame([], "k long"), "k").count() == 0


def test_threads_leave_out_circles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5)]
    got = collaboration.threads(spark.createDataFrame(rows, "comment_id long, parent_id long")).collect()
    assert sorted((r.comment_id, r.root, r.depth) for r in got) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)]


def test_augmented_keeps_rows_and_repeats_itself(spark):
    from quillet.operators import augment

    rows = [(i, f"one two three four five {i} six seven eight nine ten") for i in range(20)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = ([tuple(r) for r in augment.augmented(df, copies=2).orderBy("doc_id", "augmented", "text").collect()] for _ in range(2))
    assert first == second
    plain = augment.augmented(df, copies=2).where("NOT augmented").select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, plain))) == sorted(map(repr, rows))
    copies = augment.augmented(df, copies=2).where("augmented").collect()
    assert copies and all(r.text and (r.original_id, r.text) not in rows for r in copies)


def test_threads_write_comments_with_a_root_once(spark, monkeypatch):
    rows = [(i, None if i % 64 == 0 or i > 128 else i - 1) for i in range(1000)] + [(2000, 5000)]
    written, cut = [], collaboration.shared.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(collaboration.shared, "cut", counted)
    got = {r.comment_id: (r.root, r.depth) for r in collaboration.threads(spark.createDataFrame(rows, "comment_id long, parent_id long")).collect()}
    assert got == {i: ((i, 0) if p is None or p == 5000 else (i - i % 64, i % 64)) for i, p in rows}
    assert len(written) > 3 and sum(written) < 2 * len(rows)


def test_toxicity_filter_counts_each_category_once(spark):
    from quillet.operators import quality

    df = spark.createDataFrame([(1, "You RACIST, racist"), (2, "mail me: a@b.org or 12345"), (3, None), (4, "ſtupid stupidity, kill  them, 123-45-6789")], "doc_id long, text string")
    found = quality.detect(df, sensitivity="high")
    got = {r.doc_id: r for r in found.collect()}
    assert (got[1].hate_speech, got[2].pii, got[3].score, got[4].profanity, got[4].violence, got[4].pii) == (2, 1, 0.0, 1, 1, 1)
    plan = found.where("NOT is_toxic").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("racist") == 1


def test_drawn_places_are_sorted_without_an_expression(spark):
    from quillet.operators import augment

    for technique in (augment.swapped, augment.deleted, augment.inserted, augment.synonyms):
        assert "comparefunc" not in str(spark.range(1).select(technique(F.lit("a b c d"), F.col("id")))._jdf.queryExecution().optimizedPlan().toString()).lower()
