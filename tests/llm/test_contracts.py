"""The ten operators against brute force and on nulls, ties, repeated rows, empty tables, long texts
and columns whose names clash."""

import base64
import collections
import json
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import chat, jaccard, neighbours, packing, pii, quality, queries, sharding, substrings, tokens, toxicity
from quillet.llm.oracles import ORACLE_SQL

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
CLASH = "row struct<a:int>, owner string, lone_anchors string, lone_windows string, reference__ string, references string, shingle string, class long, n long, h string, size string, words string, p string, hits string, kept string, sequence_id long, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing names."""
    long_text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "a b c"), (None, None), (None, ""), (2, None), (3, " \n\t"), (4, "x" * 1_000_000), (5, long_text), (6, long_text + " end"), (7, "Mail a@b.cd or +1 415 555 0100 you idiot")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in CLASH.replace("struct<a:int>", "int").split(", "))), rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{DATA}/{name_}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_operator_takes_odd_rows(spark, odd):
    docs, rows = odd
    n = len(rows)
    assert packing.pack(packing.pieces(docs, P.path("word_bpe_49k.json"))).where("piece = 0").count() == n
    assert sharding.shards(docs, 4).count() == n
    assert jaccard.classes(docs).count() == n
    assert tokens.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == n
    assert quality.judged(docs).count() == n
    labels = spark.createDataFrame([(7, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).count() == n and toxicity.scored(docs, labels.limit(0)).where("score BETWEEN 0 AND 1").count() == n
    cut = substrings.remove_repeats(docs)
    assert set(docs.columns) <= set(cut.columns) and cut.count() == n
    new = pii.replace_entities(docs, "k")
    assert set(docs.columns) <= set(new.columns) and new.count() == n


def test_every_operator_takes_empty_tables(spark, odd):
    docs = odd[0].limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frames = [
        packing.pack(packing.pieces(docs, P.path("word_bpe_49k.json"))), sharding.shards(docs, 4), jaccard.classes(docs), tokens.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), quality.judged(docs),
        toxicity.scored(docs, labels), substrings.remove_repeats(docs), pii.replace_entities(docs, "k"), chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [df.count() for df in frames] == [0] * len(frames)


def test_packing_stays_near_the_bound(spark):
    draw = np.random.default_rng(0)
    for lengths in (draw.integers(1, 2049, 20_000), np.repeat([1100, 940], 10_000)):
        rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
        items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
        packed = packing.pack(items).select("sequence_id", "offset", "length").collect()
        bins = collections.defaultdict(list)
        for r in packed:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(packed) == len(rows) and len(bins) <= 1.02 * sum(lengths) / 2048 + 8


def test_packing_needs_no_more_bins_as_pieces_grow():
    draw = np.random.default_rng(1)
    for n in (10_000, 300_000):
        lengths, bins = draw.integers(1, 2049, n), packing.BestFit(2048, packing.OPEN_BINS)
        for at in range(0, n, packing.LOOK_AHEAD):
            for length in sorted(lengths[at : at + packing.LOOK_AHEAD].tolist(), reverse=True):
                bins.place(length)
        assert bins.n_made <= 1.015 * lengths.sum() / 2048


def test_shards_are_balanced(spark):
    rows = [(i, "t" * (i % 97)) for i in range(3000)] + [(i, "copy " * 40) for i in range(3000, 4000)] + [(None, None)] * 5
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r["size"]
    largest = max(r["size"] for r in got)
    assert len(got) == len(rows) and len(size) == 8 and max(size.values()) - min(size.values()) <= 4 * largest
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_a_text_of_half_the_rows_is_dealt_and_joined_in_parts(spark, monkeypatch):
    taken = []
    join = sharding.join_hot
    monkeypatch.setattr(sharding, "join_hot", lambda left, *more: taken.append(join(left, *more)) or taken[-1])
    rows = [(i, "the same text" if i % 2 else f"text {i % 300}") for i in range(6000)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = collections.Counter(r.shard for r in got for _ in range(r["size"]))
    largest = max(r["size"] for r in got)
    assert sorted(r.doc_id for r in got) == list(range(6000)) and max(size.values()) - min(size.values()) <= 4 * largest
    assert len(taken) == 1 and taken[0].where("group_size IS NOT NULL").count() == 6000  # every text here is a large group


def test_hot_columns_in_blocks_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "_FEW", 0)
    draw = np.random.default_rng(5)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"own{i}_{k}" for k in range(int(draw.integers(0, 14)))])) for i in range(30)]
    got = [tuple(r) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(jaccard.brute_force(rows))


def test_small_columns_are_compared_together(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "_PAIRS", 500, raising=False)
    draw, rows = np.random.default_rng(3), []
    for shingle in range(400):
        two = shingle % 7 == 0  # met by two blocks
        for _ in range(int(draw.integers(1, 6)) if shingle else 90):
            n, open_ = int(draw.integers(20, 30)), int(draw.integers(4, 16))
            bits = np.random.default_rng(int(draw.integers(0, 3))).integers(-(2**62), 2**62, jaccard._WORDS).tolist()
            rows.append([shingle, 0, int(two), int(draw.integers(0, 2)) * two, len(rows), n, int(draw.integers(0, 5)), int(draw.integers(0, 3)), open_, int(draw.integers(1, 5)), *bits])

    def pair(x, y):
        (_, _, _, bx, a, n, pos, cx, open_, rank), (_, _, _, by, b, m, pos2, cy, open2, rank2) = x[:10], y[:10]
        if x[:3] != y[:3] or cx == cy or x[1] != x[2] and bx == by or not jaccard._may_reach(n, m, pos, pos2, 80):
            return []
        ones = [sum(((p & ~q) % 2**64).bit_count() for p, q in zip(i, j)) for i, j in ((x[10:], y[10:]), (y[10:], x[10:]))]
        need, left = -(-80 * (n + m) // 180) - max(jaccard._suffix(n, 80), jaccard._suffix(m, 80)), min(open_ - rank, open2 - rank2)
        fits = left >= need - min(1, need) and min(rank, rank2) + left >= need and 180 * min(n - ones[0], m - ones[1]) >= 80 * (n + m)
        return [(min(a, b), max(a, b), min(1, need))] if fits else []

    table = pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=[str(i) for i in range(len(rows[0]))])
    batches = list(jaccard._cross(80)(iter(table.to_batches(300))))
    want = [p for i, x in enumerate(rows) for y in rows[i + 1 : i + 90] for p in pair(x, y)]
    assert sorted(tuple(r.values()) for b in batches for r in b.to_pylist()) == sorted(want) and len(want) > 50
    assert len(batches) < 40  # a batch a column before


def test_copies_that_fill_a_table_are_found(spark, monkeypatch):
    from quillet.llm import common

    monkeypatch.setattr(common, "is_hot", lambda n, total: n * 3 >= total)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(6)] + [(10, text + " tail"), (11, " ".join(f"v{i}" for i in range(60))), (12, "short"), (13, "short"), (14, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()]
    assert sorted(got, key=repr) == sorted(substrings.brute_force(rows), key=repr)
    got = [tuple(r) for r in jaccard.classes(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == sorted(jaccard.brute_force(rows), key=repr)


def exact(ids, x, q, k):
    score = (x * x[q]).sum(axis=1)
    return [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]


def test_neighbours_reach_nine_of_ten(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.search(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    want = {q: exact(np.arange(len(x)), x, q, 20) for q in range(0, 10_000, 100)}
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_neighbours_with_copies_ties_and_dimensions(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [0.0, 2.0, 0.0]), (101, [1.0, 1.0, 0.0]), (101, [1.0, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (102, None), (103, [0.0] * 3), (104, [float("inf"), 0.0, 0.0]), (200, [1.0, 2.0]), (201, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[7] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)] and got[2] == [(0, 1.0), (1, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)]
    assert got[100] == [(101, 2.0), (0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)] and got[200] == [(201, 5.0)]
    assert set(got) == {*range(40), 100, 101, 200, 201}


def test_neighbours_send_no_probes_and_few_sampled_rows_to_the_driver(spark, monkeypatch):
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.standard_normal((3000, 8)))], "vec_id long, embedding array<double>").repartition(8)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(neighbours, "FIT_ROWS", 200)
    few = df.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v"))
    want = few.orderBy(F.xxhash64("c"), "c").limit(200).select("v").collect()
    asked, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: asked.append(plan(self)) or collect(self))
    assert np.array_equal(neighbours._sample(few, 3000), np.array([r.v for r in want]))
    assert len(asked) == 1 and "xxhash64" in asked[0].split("Filter")[1].split("\n")[0]
    plans, cut = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda x: plans.append(plan(x)) or cut(x))
    neighbours.search(df, df.where("vec_id % 20 = 0"), k=5)
    assert any("strategy=merge" in p for p in plans)


def test_every_token_is_what_its_bytes_merge_to():
    """So a merge uncovers no pair of lower rank, and all places of a pair may merge at once."""
    from quillet.llm.bpe import merge_all

    coder = tokens.ByteTokens(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    found = merge_all(coder.single[np.frombuffer(b"".join(coder.ranks), np.uint8)], np.array([len(t) for t in coder.ranks]), coder.pairs)
    assert all(len(x) == 1 and int(x[0]) == rank for x, rank in zip(found, coder.ranks.values()))


def test_files_whose_tokens_do_not_merge_from_their_bytes(tmp_path):
    """Ranks in any order: then one place merges in a round, and ids are still the library's."""
    import tiktoken

    lone = 0
    for seed in range(20):
        draw = np.random.default_rng(seed)
        more = sorted({"".join(draw.choice(list("abc"), n)).encode() for n in draw.integers(2, 6, 12)}, key=lambda _: draw.random())
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *more])}
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
        own = tiktoken.Encoding(str(seed), pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        coder = tokens.ByteTokens(str(path), P.PATTERN)
        lone += coder.lone
        texts = ["".join(draw.choice(list("abc"), int(n))) for n in draw.integers(1, 60, 50)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in coder.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert 0 < lone
    assert not tokens.ByteTokens(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).lone


def test_long_pieces_are_those_of_the_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = np.random.default_rng(3)
    texts = ["a" * 100_000, "ab" * 5000 + "aab" * 333, "".join(chr(c) for c in draw.integers(0x4E00, 0x4F00, 3000)), "".join(draw.choice(list("abcdef"), 4000))]
    got = tokens.ByteTokens(path, P.PATTERN).encode(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == [own.encode_ordinary(t) for t in texts]


def test_counts_of_quality_are_plain_counts(spark):
    import re

    rows = [(1, "the cat sat on the mat the cat sat on the mat again"), (2, "A # b\nA # b\n\n \nc <x> $"), (3, " ".join(["word"] * 30)), (4, "é ö " * 6)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        repeated = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in quality.ADDED) == want
        assert got[i].base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_edits_are_those_of_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    draw = np.random.default_rng(4)
    terms = ["stupid", "stupids", "worthless", "scum", "pathetic", "empathetic", "disgusting"]
    automaton = toxicity.Automaton(terms)
    for _ in range(2000):
        word = list(draw.choice(terms))
        for _ in range(int(draw.integers(0, 4))):
            at = int(draw.integers(0, len(word) + 1))
            word[at : at + int(draw.integers(0, 2))] = list(draw.choice(["", "a", "s", "t"]))
        word = "".join(word)
        within = sorted((distance(word, t), t) for t in terms if distance(word, t) <= automaton._own(t))
        assert automaton.nearest(word) == (within[0][1] if within else None)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.scored(docs, x).collect())) for x in (labels, other))
    assert first == second and all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h, _, _ in first)


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def iban_is_valid(account):
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_surrogates_keep_check_digits_names_and_secrets(spark):
    rows = [
        (1, "Mr John Smith saw Dr John Smith and Mr Smith."), (2, "Prof. Jane Smith"), (3, "Mrs Jane Doe"), (4, "4111 1111 1111 1111"), (5, "4111111111111111"), (6, "4111 1111 1111 1112"),
        (7, "GB29 NWBK 6016 1331 9268 19"), (8, "DE89370400440532013000"), (9, "sk-" + "a1B2" * 30), (10, "0af9" * 32), (11, "x" * 80 + "@example.com"), (12, "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), (13, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4"),
    ]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    mr, given, family, _, dr, given_2, family_2, _, mr_2, family_3 = got[1].rstrip(".").split()
    assert (mr, dr, mr_2) == ("Mr", "Dr", "Mr") and given == given_2 and family == family_2 == family_3 and "Smith" not in got[1]
    assert got[2].split()[1:] == [got[3].split()[1], family] and given != got[3].split()[1]
    assert luhn(got[4]) and got[4].replace(" ", "") == got[5] and not luhn(got[6]) and got[4] != rows[3][1]
    assert iban_is_valid(got[7]) and iban_is_valid(got[8]) and got[7][:2] == "GB" and got[8][:2] == "DE"
    for i in (9, 10, 11, 12, 13):
        old = rows[i - 1][1]
        assert not any(old[k : k + 12] in got[i] for k in range(8, len(old) - 24, 8))
    assert len(got[9]) == 123 and len(got[10]) == 128 and [len(x) for x in got[12].split(":")] == [4] * 8 and got[13].count(".") == 2


def test_different_entities_keep_different_surrogates(spark):
    rows = [(i, f"user{i}@mail.org, +1 415 555 {i:04d}, Mr John{chr(97 + i % 26)} Smith{chr(97 + i // 26)}") for i in range(400)]
    got = [r.text.split(", ") for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert all(len({r[k] for r in got}) == 400 for k in range(3))


def test_bad_json_is_a_message(spark):
    bad = ['{"tool_call": {"id": "\\ud800", "name": "x"}}', '{"tool_call": {"id": "a", "arguments": NaN}}', '{"tool_call": {"id": "b", "arguments": 1e999}}', "{" * 5000, '{"tool_result": {"id": "c", "content": "\\ud800"}}', '{"tool_call": ["id"]}', "[1]"]
    rows = [(1, i, "a", t) for i, t in enumerate(bad)] + [(None, 1, "a", '{"tool_call": {"id": "n", "name": "search", "arguments": {"query": "x"}}}'), (None, 1, "t", '{"tool_result": {"id": "n", "content": 1}}')]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and all(json.loads(r.json) for r in got)
    assert sorted(r.kind for r in got if r.conv_id == 1) == ["message"] * 6 + ["result"] and sorted(r.state for r in got if r.conv_id is None) == ["orphan", "unanswered"]


def plain_order(rows):
    """Calls and results of one conversation, each need before what needs it."""
    calls = {c["id"]: (turn, c.get("after", [])) for turn, kind, c in rows if kind == "call"}
    done = {}
    while True:
        new = {i: (max([t, *(done[a][0] for a in after if a in calls)], default=t), 1 + max((done[a][1] for a in after if a in calls), default=-1)) for i, (t, after) in calls.items() if i not in done and all(a in done for a in after if a in calls)}
        if not new:
            return done
        done |= new


def test_random_calls_stand_in_their_needs_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "_BLOCK", 4)
    draw = np.random.default_rng(6)
    rows, plain = [], collections.defaultdict(list)
    for conv in range(12):
        turns = draw.permutation(20).tolist()
        for i in range(10):
            call = {"id": f"c{i}", "name": "search", "arguments": {"query": "x"}, "after": [f"c{j}" for j in draw.integers(0, 12, 2) if j != i and (j < i or conv % 4 == 0)]}
            rows.append((conv, turns[i], "a", json.dumps({"tool_call": call})))
            plain[conv].append((turns[i], "call", call))
        rows += [(conv, turns[10 + i], "t", json.dumps({"tool_result": {"id": f"c{i}", "content": i}})) for i in range(5)]
    got = collections.defaultdict(list)
    for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect():
        got[r.conv_id].append(r)
    for conv, found in got.items():
        ranks = plain_order(plain[conv])
        assert [r.place for r in found] == list(range(15))
        order = [r.call_id for r in found if r.kind == "call" and r.state != "circular"]
        assert order == sorted(ranks, key=lambda i: (ranks[i][0], ranks[i][1], i))
        for i, r in enumerate(found):
            if r.kind == "result" and r.state == "linked" and r.call_id in ranks:
                assert found[i - 1].call_id == r.call_id and found[i - 1].kind == "call"


def test_texts_decide_and_not_their_language(spark):
    """A language of long words is a reference; junk goes whatever its lang says; rare and unnamed languages are judged."""
    draw = np.random.default_rng(3)
    syllables = ["lona", "mira", "peto", "savi", "dure", "kola"]
    words = [a + b for a in syllables for b in syllables]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda: " ".join(draw.choice(words, 300, p=weights / weights.sum()).tolist())
    junk = lambda: " ".join("".join(draw.choice(list("Q#1$X%7&Z9@"), 8).tolist()) for _ in range(300))
    rows = [(i, text(), "zz") for i in range(60)] + [(100, junk(), "zz"), (101, junk(), "xx"), (102, junk(), None), (103, text(), "xx"), (104, text(), None)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in (100, 101, 102)) and got[103] and got[104]
    bare = spark.createDataFrame(rows, "doc_id long, text string, lang string").drop("lang")
    alone = {r.doc_id: r.kept for r in quality.judged(bare).collect()}
    assert alone[0] and not alone[100]


def test_surrogates_keep_every_column(spark):
    rows = [(1, "Mail a@b.cd or Mr Jon Smith", 7), (2, None, 8), (3, "Dr Jon Smith and nothing else", None)]
    names = ["found__", "new__", "names__", "genders__", "text__", "row", "n_entities"]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").select("*", *(F.lit(n).alias(n) for n in names))
    got = {r.doc_id: r.asDict() for r in pii.replace_entities(df, "k").collect()}
    plain = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_entities(df.select("doc_id", "text"), "k").collect()}
    assert all(set(r) == set(df.columns) and all(r[n] == n for n in names[:-1]) for r in got.values())
    assert {i: (r["text"], r["n_entities"]) for i, r in got.items()} == plain and [got[i]["x"] for i in (1, 2, 3)] == [7, 8, None]
