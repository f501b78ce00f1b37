"""Operators 11 to 13 against brute force, and on nulls, ties, repeated rows, empty tables, long
inputs and columns whose names clash."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import codebooks, lines, prefixes

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def nodes(spark, rows):
    df = spark.createDataFrame(rows, TURNS).select("*", *(F.lit(None).cast("string").alias(c) for c in ("base", "depth", "digest", "parent", "size", "heads", "ends")))
    return [tuple(r) for r in prefixes.trie(df.repartition(3)).select(*NODE).collect()]


def test_trie_is_brute_force(spark):
    draw = random.Random(3)
    words = ["", "a", "b", None, "Ü b"]
    rows = [(c, t if t else None, draw.choice(["user", None]), draw.choice(words)) for c in [*range(-12, 60), 10**9, -(10**9)] for t in range(draw.randrange(12)) if draw.random() < 0.9]
    rows += [(None, 0, "user", "no conversation")]
    got = nodes(spark, rows)
    same(got, prefixes.brute_force(rows))
    assert sum(r[1] == 0 for r in got) == 1
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "a", "b")]) == []


def test_copies_and_long_conversations(spark):
    rows = [(c, t, "user", f"{t}") for c in range(0, 2000, 5) for t in range(3)] + [(7, t, "user", str(t % 3)) for t in range(3000)]
    rows += [(3, 1, "user", "x" * 500_000), (3, 2, None, None)]
    got = nodes(spark, rows)
    top = next(r for r in got if r[1] == 0)
    assert top[3] == 402 and max(r[1] for r in got) >= 2992 and len({(r[0], r[1]) for r in got}) == len(got)
    assert top[5] == sum(r[4] == 0 for r in got)
    by = {(r[0], r[1]): r for r in got}
    assert all(by[(r[2], r[1] - 1)][4] >= 1 and by[(r[2], r[1] - 1)][6] >= r[6] for r in got if r[1])


def test_repeated_turns_have_one_order(spark):
    rows = [(1, 5, "b", "y"), (1, 5, "a", "x"), (1, 5, "a", "x"), (2, 5, "a", "x"), (2, 5, "b", "y"), (2, 5, "a", "x")]
    one, two = nodes(spark, rows), nodes(spark, rows[::-1])
    same(one, two)
    assert one


def test_a_chain_of_turns_makes_as_many_rows(spark):
    rows = spark.range(4000).selectExpr("5L AS conv_id", "id AS turn", "'u' AS role", "CAST(id AS string) AS text")
    assert prefixes.chained(rows).count() == 4001


VECTORS = "vec_id long, embedding array<double>, label int"


def codes(spark, rows, kind=VECTORS):
    df = spark.createDataFrame(rows, kind).select("*", *(F.lit(1).alias(c) for c in ("v", "code", "error", "label_error", "label_key", "data")))
    got = codebooks.compress(df.repartition(2)).collect()
    return [tuple(r) for r in got]


@pytest.mark.parametrize("dim", [16, 11, 3])
def test_codes_are_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(codebooks, "BLOCK", 20 * dim)  # several blocks in a task
    draw = np.random.default_rng(dim)
    rows = [(int(i), [float(x) for x in np.round(draw.standard_normal(dim), 1) / 50], int(draw.integers(3)) if i % 7 else None) for i in draw.permutation(150)]
    rows += rows[:20] + [(None, rows[0][1], 1), (None, rows[1][1], 2)]
    bad = [(1000, None, 1), (1001, [None, *rows[0][1][1:]], 1), (1002, [float("nan"), *rows[0][1][1:]], None), (1003, [float("inf"), *rows[0][1][1:]], 1)]
    same(codes(spark, rows + bad), codebooks.brute_force(rows + bad))


def test_codes_of_few_equal_and_huge_vectors(spark):
    few = [(i, [0.5 * i, -1.0, 0.1, 3e-5, 0.0, 2.0, -0.3, 1.0], 1) for i in range(5)]
    same(codes(spark, few), codebooks.brute_force(few))
    equal = [(i, [0.25] * 8, 0) for i in range(40)]
    assert {r[2] for r in codes(spark, equal)} == {"00" * 8}
    huge = [(i, [1e300 * (i % 4 - 1), -1e38, 3.0, 1e-300, 2.0**60 * i, 0.5, -0.5, float(i)], None) for i in range(30)]
    same(codes(spark, huge), codebooks.brute_force(huge))
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1)]) == []
    mixed = codes(spark, [*few, (9, [1.0, 2.0], 1), (10, [], 2)])
    assert len(mixed) == 7 and len({r[5] for r in mixed}) == 3


def test_only_parts_that_drift_has_reached_are_compared(monkeypatch):
    draw = np.random.default_rng(0)
    x = np.floor(draw.standard_normal((2000, 16)) * 4096).astype(np.int64)
    books = [x[:16, p * 2 : p * 2 + 2] for p in range(8)]
    block = codebooks.Block(x.tobytes(), "<i8", 2000, 16, False)
    block.start(books)
    seen = []
    scan = codebooks.Block.scan
    monkeypatch.setattr(codebooks.Block, "scan", lambda self, p, rows, book: (seen.append(len(rows)), scan(self, p, rows, book))[1])
    block.move(books, np.zeros((8, 16)))
    assert sum(seen) < 200  # ties only
    moved = [b + 3 for b in books]
    seen.clear()
    block.move(moved, np.full((8, 16), 2 * np.sqrt(18)))
    assert 0 < sum(seen) < 4000
    whole = codebooks.Block(x.tobytes(), "<i8", 2000, 16, False)
    whole.start(moved)
    assert (whole.entry == block.entry).all() and whole.sums == block.sums


def test_lines_are_brute_force(spark):
    draw = random.Random(5)
    known = [" Copyright notice ", "copyright NOTICE", "short", "", "Ärger mit Zeilen", "ärger mit Zeilen", "the same long line", "\tthe same long line\r", "another quite long line"]
    rows = [(i, "\n".join(draw.choice(known + [f"own line number {i}", "ten chars!"]) for _ in range(draw.randrange(12)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "x" * 1_000_000 + "\nthe same long line"), (5, rows[5][1]), (404, "\n".join(f"line number {i % 7000}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("c").alias(c) for c in ("lines", "holder", "own", "hashes", "n_lines", "kept_text", "row_")))
    got = lines.remove_lines(df.repartition(3))
    assert set(df.columns) <= set(got.columns)
    same([tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()], lines.brute_force(rows))


def test_lines_without_ids_and_empty_tables(spark):
    rows = [(None, "a line of some length"), (None, "a line of some length"), (None, "a line of some length\nand a second one"), (3, "A LINE of some length")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1), (0, 1), (0, 1), (3, 0)]
    alone = sorted(r.n_dropped for r in lines.remove_lines(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect())
    assert alone in ([0, 0, 1], [0, 1, 1])  # one of the two texts holds the line
    assert lines.remove_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_compacted_and_earlier_batches_keep_their_lines(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batches = [spark.createDataFrame([(10 - b, f"line of batch {b % 3}\nshared by all of them")], "doc_id long, text string") for b in range(6)]
    for batch in batches:
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    held = {r.holder: len(r.own) for r in runs.held().collect()}
    assert held == {10: 2, 9: 1, 8: 1}
    runs.close()
