"""Listings, variants, groups, BLEU and evaluation against plain versions, with null and empty rows."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import catalog, evaluation, similar, stats


def plain_bleu(r, h, most):
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


TEXTS = ["a b c d", "a b c e", "x y", "a b", "", "A, b! c d e f", "q", None, "a b c d e f g h"]
TOKENS = [[w.strip(".,!?;:()[]{}\"'-") for w in t.lower().split()] for t in TEXTS if t]


def test_self_bleu_has_every_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    row = evaluation.self_bleu(df).first()
    for n in (1, 2, 3):
        best = [max(plain_bleu(r, h, n) for j, r in enumerate(TOKENS) if j != i) for i, h in enumerate(TOKENS)]
        assert row[f"self_bleu_{n}"] == round(sum(best) / len(best), 4)
    assert evaluation.self_bleu(df.where("doc_id = 0")).first().self_bleu_1 == 0.0
    bundle = evaluation.diversity_bundle(df).first()
    words = [w for t in TOKENS for w in t]
    assert bundle.total_tokens == len(words) and bundle.vocabulary_size == len(set(words)) and bundle.distinct_1 == round(len(set(words)) / len(words), 4)
    none = evaluation.diversity_bundle(df.limit(0)).first()
    assert none.diversity_score == 0.0 and none.total_tokens == 0 and none.distinct_3 == 0.0


def test_bleu_of_pairs(spark):
    pairs = [(r, h) for r in TEXTS for h in TEXTS]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "id long, r string, h string")
    tokens = lambda c: T.tokens(F.col(c), T.MORE_EDGES)
    got = {r.id: r.b for r in df.select("id", evaluation.bleu(tokens("r"), tokens("h")).alias("b")).collect()}
    clean = lambda t: [w.strip(".,!?;:()[]{}\"'-") for w in (t or "").lower().split()]
    assert all(abs(got[i] - plain_bleu(clean(r), clean(h), 4)) < 1e-12 for i, (r, h) in enumerate(pairs))
    assert spark.range(1).select(evaluation.bleu(F.lit(None).cast("array<string>"), F.array(F.lit("a"))).alias("b")).first().b == 0.0


def test_evaluation_takes_clusters_or_none(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    messages = stats.message_stats(spark.createDataFrame([(["what is it"], ["a b"]), (["why"], [""]), ([], ["x"])], "questions array<string>, answers array<string>"))
    row = evaluation.evaluated(evaluation.diversity_bundle(df), messages).first()
    assert row.num_clusters == 0 and "⚠️ 1 examples have empty responses" in row.warnings and any(x.startswith("2 examples have very short") for x in row.recommendations)
    big = spark.createDataFrame([(3, 1, 2.0, 0.62, 0.5)], "num_clusters int, outlier_count int, avg_cluster_size double, largest_cluster_ratio double, semantic_diversity double")
    assert any("One topic dominates 62% of" in x for x in evaluation.evaluated(evaluation.diversity_bundle(df), messages, big).first().recommendations)


def plain_groups(rows, percent):
    words = {i: frozenset(w for w in (t or "").lower().split()) for i, t in rows}
    out = {}
    for i, _ in rows:
        if i in out:
            continue
        out[i] = i
        for j, _ in rows:
            if j > i and j not in out:
                a, b = words[i], words[j]
                if (not a and not b) or (a and b and 100 * len(a & b) >= percent * len(a | b)):
                    out[j] = i
    return out


def test_groups_hold_every_row(spark):
    draw = random.Random(7)
    rows = []
    for i in range(150):
        kind = draw.random()
        if kind < 0.1:
            rows.append((i, draw.choice(["", None, "  "])))
        elif rows and kind < 0.7:
            words = (draw.choice(rows)[1] or "z").split()
            rows.append((i, " ".join(words[: max(1, len(words) - draw.randrange(3))] + [f"w{draw.randrange(30)}"] * draw.randrange(2))))
        else:
            rows.append((i, " ".join(f"w{draw.randrange(30)}" for _ in range(draw.randrange(1, 12)))))
    got = {r.doc_id: r.leader for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 70).collect()}
    assert got == plain_groups(rows, 70)


def test_listings_and_tasks(spark):
    sets = spark.createDataFrame([(1, "b", 5, "chat", None, "x"), (2, "a", None, None, "f", "y"), (3, None, 5, "chat", "f", "x")], "dataset_id long, name string, example_count long, domain string, format string, file_path string").withColumns({"created_at": F.col("dataset_id"), "updated_at": -F.col("dataset_id")})
    ids = lambda df: [r.dataset_id for r in df.collect()]
    assert ids(catalog.datasets(sets)) == [3, 2, 1] and ids(catalog.datasets(sets, domain="chat", sort_by="example_count", order="ASC")) == [1, 3]
    assert ids(catalog.datasets(sets, sort_by="name", order="no such order", limit=2)) == [1, 2] and ids(catalog.datasets(sets, domain="", path="x")) == [3, 1]
    assert ids(catalog.newest(sets, "updated_at", "dataset_id", 1, domain="chat", name=None)) == [1]
    jobs = spark.createDataFrame([(1, "running", 1, 0, 10, None), (2, "done", 3, 4, 11, 12)], "job_id long, status string, done long, total long, started_at long, completed_at long")
    got = {(r.id, r.type): (r.progress, r.progress_details, r.updated_at) for r in catalog.tasks(jobs, jobs.limit(0)).collect()}
    assert got == {(1, "generator"): (0.0, "1/0 examples", 10), (2, "generator"): (0.75, "3/4 examples", 12)}


def test_variants_maps_and_views(spark):
    rows = [(1, 10, None), (1, 11, 5), (2, 20, 9), (2, 21, 0), (3, 30, -4), (3, 31, None), (4, 40, 1), (4, 41, 1), (4, 42, 1)]
    df = spark.createDataFrame(rows, "example long, v long, choice int")
    assert {r.example: r.v for r in catalog.best_variants(df, "example", "v", "choice").collect()} == {1: 10, 2: 21, 3: 30, 4: 41}
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None}), (None, {"x": "y"}), ({"a": None}, None), (None, None)], "m map<string, string>, n map<string, string>")
    assert [r.u for r in maps.select(catalog.updated(F.col("m"), F.col("n")).alias("u")).collect()] == [{"a": "1", "b": "3", "c": None}, {"x": "y"}, {"a": None}, {}]
    scored = spark.createDataFrame([(i, s) for i, s in enumerate([None, 0.5, 0.9, 0.5, 0.1])], "id long, s double")
    assert [(r.id, r.chosen) for r in catalog.top_candidates(scored, "s", "id", 2).orderBy("place").collect()] == [(2, True), (1, True), (3, False), (4, False)]
    assert [r.id for r in catalog.gate(scored, "s", 0.5).orderBy("id").collect()] == [1, 2, 3]
    assert catalog.basic_stats(scored.limit(0)).first() == (0, "")
    shown = spark.createDataFrame([([("user", None)], None, None, None), (None, "i", "o", None), (None, "i", None, None)], "m array<struct<role: string, content: string>>, i string, o string, t string")
    assert [r.d for r in shown.select(catalog.displayed(F.col("m"), F.col("i"), F.col("o"), F.col("t")).alias("d")).collect()] == [
        '{"type":"chat","messages":[{"role":"user","content":""}]}', '{"type":"instruction","instruction":"i","output":"o"}', '{"type":"unknown","content":""}',
    ]


def test_paraphrase_changes_texts_of_the_table(spark):
    from quillet.operators import augment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    assert docs.where(augment.paraphrased(F.col("text"), F.col("doc_id")) != F.col("text")).count() > 0
