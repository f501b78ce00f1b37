"""JSON files, canonical hashes, reports and personal data against plain versions."""

import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from quillet.functions import spans as S
from quillet.operators import hashing, privacy, reports
from quillet.sources import jsonl


def put(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_rows_before_the_first_bad_line(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", ['{"id": 1}', "", '{"id": 2}', "{bad", '{"id": 3}'])
    put(f"{tmp_path}/b.jsonl", ['{"id": 4}', "  ", '{"id": "x"}', "null", '{"id": 5}'])
    put(f"{tmp_path}/c.jsonl", ["oops", '{"id": 6}'])
    put(f"{tmp_path}/d.jsonl", [])
    got = jsonl.read_until_bad(spark, f"{tmp_path}", "id long")
    assert sorted((os.path.basename(r.path), r.id) for r in got.where("id IS NOT NULL").collect()) == [("a.jsonl", 1), ("a.jsonl", 2), ("b.jsonl", 4), ("b.jsonl", 5)]
    assert got.where("path LIKE '%b.jsonl'").count() == 4


def test_first_bad_line_of_a_file_that_many_tasks_read(spark, tmp_path):
    rows = [json.dumps({"id": i, "pad": "x" * 200}) for i in range(20_000)]
    rows[13_500] = rows[17_000] = "{"
    put(f"{tmp_path}/big.jsonl", rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        got = jsonl.read_until_bad(spark, f"{tmp_path}", "id long")
        assert got.rdd.getNumPartitions() > 1 and got.agg(F.count("*"), F.max("id")).first() == (13_500, 13_499)
        shown = jsonl.preview(spark, f"{tmp_path}/big.jsonl", 3)
        assert [json.loads(r.value)["id"] for r in shown.collect()] == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_preview_counts_blank_lines_and_refuses_bad_ones(spark, tmp_path):
    put(f"{tmp_path}/a.jsonl", ['{"id": 1}', "", '{"id": 2}', "{bad"])
    values = lambda n: [r.value for r in jsonl.preview(spark, f"{tmp_path}/a.jsonl", n).collect()]
    assert values(2) == ['{"id": 1}'] and values(3) == ['{"id": 1}', '{"id": 2}'] and values(4) == []


def test_listing_counts_and_knows_formats(spark, tmp_path):
    put(f"{tmp_path}/chat.jsonl", ['{"messages": []}', "", '{"id": 2}'])
    os.makedirs(f"{tmp_path}/deep")
    put(f"{tmp_path}/deep/task.jsonl", ['{"instruction": "a", "output": "b"}', "{bad"])
    put(f"{tmp_path}/deep/other.jsonl", ["", '{"messages": []}'])
    put(f"{tmp_path}/none.jsonl", [])
    put(f"{tmp_path}/no.txt", ["x"])
    got = {r.name: (r.format, r.example_count) for r in jsonl.listing(spark, f"{tmp_path}").collect()}
    assert got == {"chat.jsonl": ("chat", 2), "task.jsonl": ("instruction", 2), "other.jsonl": ("unknown", 1), "none.jsonl": ("unknown", 0)}
    assert all(r.size_mb == os.path.getsize(r.path.replace("file:", "")) / 2**20 for r in jsonl.listing(spark, f"{tmp_path}").collect())


def test_one_array_of_many_parts(spark, tmp_path):
    rows = [(i, None if i % 3 else "ü, \"q\"\n]", [i]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, more array<long>").repartition(3)
    jsonl.write_array(df, f"{tmp_path}/all.json", ["id"])
    with open(f"{tmp_path}/all.json", encoding="utf-8") as f:
        assert json.load(f) == [{"id": i, "text": t, "more": m} for i, t, m in rows]
    back = jsonl.read_array(spark, f"{tmp_path}/all.json", "id long, text string, more array<long>")
    assert sorted(map(tuple, back.collect())) == rows
    jsonl.write_array(df.limit(0), f"{tmp_path}/all.json")
    with open(f"{tmp_path}/all.json", encoding="utf-8") as f:
        assert json.load(f) == []
    assert sorted(os.listdir(tmp_path)) in (["all.json"], [".all.json.crc", "all.json"], [".whole.crc", "all.json"])
    jsonl.write(df, f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").where(F.col("value").contains('"text":null')).count() == 33


def test_hashes_tell_fields_apart_and_not_orders(spark):
    one = spark.createDataFrame([(1, "a|", "b"), (2, "x", None), (None, "", "y")], "id long, a string, b string")
    two = spark.createDataFrame([(1, "a", "|b"), (2, "x", ""), (None, None, "y")], "id long, a string, b string")
    assert [r.differs for r in hashing.changed(one, two, "id").collect()] == [True, True]
    same = one.select("b", "id", "a")
    assert [r.differs for r in hashing.changed(one, same, "id").collect()] == [False, False]
    assert hashing.same_content(one, same.repartition(3), "id") and not hashing.same_content(one, two, "id")
    assert not hashing.same_content(one, one.unionByName(one.where("id = 1")), "id")
    assert not hashing.same_content(one.where("id = 1"), spark.createDataFrame([(1, "a| ", "b")], one.schema), "id")
    assert hashing.tree_hash(one.limit(0), "id").first().n == 0
    nested = spark.createDataFrame([(1, [("u", None)]), (2, None)], "id long, m array<struct<role: string, content: string>>")
    assert nested.select(hashing.row_hash(nested)).distinct().count() == 2
    many = spark.range(300).selectExpr("id", "CAST(id AS string) AS a")
    assert hashing.same_content(many.repartition(7), many.orderBy(F.desc("id")), "id") and hashing.tree_hash(many, "id", fan=4).first() == hashing.tree_hash(many.repartition(5), "id", fan=4).first()


def test_the_last_level_of_a_tree_hashes_all_that_are_left(spark):
    rows = spark.range(100)
    joined = lambda hs: hashlib.sha256("".join(hs).encode()).hexdigest()
    level = [r.h for r in rows.select("id", hashing.row_hash(rows).alias("h")).orderBy("id").collect()]
    for _ in range(2):
        level = [joined(level[i : i + 4]) for i in range(0, len(level), 4)]
    assert hashing.tree_hash(rows, "id", fan=4, levels=3).first().hash == joined(level) != hashing.tree_hash(rows, "id", fan=4).first().hash
    assert hashing.tree_hash(rows.limit(1), "id", fan=4, levels=3).first() == hashing.tree_hash(rows.limit(1), "id", fan=4).first()


def test_sentences_follow_the_rules(spark):
    text = lambda i: " ".join(f"w{i * 31 + j}" for j in range(20))
    good = spark.createDataFrame([(i, text(i), "abcdef"[i % 6], {"a": 1}) for i in range(60)], "doc_id long, text string, source string, metadata map<string, int>")
    row = reports.report(good, metadata="metadata").first()
    assert row.issues == [] and row.grade == "A" and row.status == "READY FOR PRODUCTION" and row.recommendations == [reports.NO_ADVICE]
    assert row.strengths == [
        "Excellent toxicity control - dataset is very clean", "Excellent deduplication - minimal duplicates", "Excellent lexical diversity", "Complete dataset - no empty examples", "Excellent metadata coverage",
        "Consistent format across all examples",
    ]
    bad = spark.createDataFrame([(i, ["same words here", "same words here", "you stupid idiot, a@b.co", None][i % 4], "s") for i in range(40)], "doc_id long, text string, source string")
    low = reports.report(bad).first()
    assert low.issues[0].startswith(("High toxicity rate: ", "Moderate")) and "Low metadata coverage: 0.0%" in low.issues and "10 examples with missing content" in low.issues
    assert low.issues[2] == "High duplication rate: 92.5%" and "Small vocabulary: 7 unique tokens" in low.issues
    assert low.recommendations[0].startswith("CRITICAL: Remove toxic content") and low.status == "NOT READY" and len(set(low.recommendations)) == len(low.recommendations)
    both = {r.component: (r.difference, r.winner) for r in reports.compared(reports.report(good, metadata="metadata"), reports.report(good, metadata="metadata")).collect()}
    assert set(both.values()) == {(0.0, "dataset1")} and len(both) == 6
    empty = reports.report(bad.limit(0)).first()
    assert empty.n == 0 and empty.n_formats == 0 and "Mixed formats detected: 0 different types" in empty.issues
    kinds = {(r.kind, r.place) for r in reports.messages(reports.report(bad).withColumn("d", F.lit(1)), "d").collect()}
    assert ("issues", 1) in kinds and ("recommendations", len(low.recommendations)) in kinds


CASES = {
    "write to jo.ann@mail.example.com now": ["EMAIL_ADDRESS"],
    "card 4111 1111 1111 1111 ok": ["CREDIT_CARD"],
    "card 4111 1111 1111 1112 no": [],
    "GB82 WEST 1234 5698 7654 32": ["IBAN_CODE"],
    "GB83 WEST 1234 5698 7654 32": [],
    "my ip is 10.0.0.1": ["IP_ADDRESS"],
    "version 10.0.0.1": [],
    "my ip is 10.0.0.256": [],
    "ipv6 address fe80::1ff:fe23:4567:890a": ["IP_ADDRESS"],
    "call me, phone 415-555-2670": ["PHONE_NUMBER"],
    "415-555-2670": [],
    "ssn 123-45-6789": ["US_SSN"],
    "ssn 000-45-6789": [],
    "nhs 943 476 5919": ["UK_NHS"],
    "nric S1234567D": ["SG_NRIC_FIN"],
    "abn 51 824 753 556": ["AU_ABN"],
    "acn 000 000 019": ["AU_ACN"],
    "tfn 876 543 210": ["AU_TFN"],
    "medicare 2123 45670 1": ["AU_MEDICARE"],
    "dea BB1388568": ["MEDICAL_LICENSE"],
    "": [],
}


def test_spans_of_known_cases(spark):
    rows = list(enumerate(CASES))
    df = spark.createDataFrame([*rows, (99, None)], "id long, text string")
    got = {r.id: r for r in df.withColumn("pii", privacy.spans(F.col("text"))).collect()}
    assert {CASES_TEXT: [s.type for s in got[i].pii] for i, CASES_TEXT in rows} == CASES and got[99].pii == []
    clean = {r.id: r.text for r in privacy.anonymize(df).collect()}
    assert clean[0] == "write to <EMAIL_ADDRESS> now" and clean[99] == "" and clean[2] == "card 4111 1111 1111 1112 no"
    assert all(clean[i] == S.anonymized(t, S.find(t)) for i, t in rows)
    one = privacy.totals(df.withColumn("pii", privacy.spans(F.col("text")))).first()
    assert one.n == len(rows) + 1 and one.pii_count == sum(map(bool, CASES.values())) == one.n_spans


def test_overlaps_go_to_the_best_then_the_longest():
    draw = random.Random(1)
    for _ in range(200):
        found = [S.Span(draw.choice("AB"), a := draw.randrange(30), a + draw.randrange(1, 8), draw.choice([0.7, 0.8, 1.0])) for _ in range(draw.randrange(12))]
        kept = []
        for s in sorted(found, key=lambda s: (-s.score, s.start - s.end, s.start, s.type)):
            if all(s.end <= k.start or s.start >= k.end for k in kept):
                kept.append(s)
        assert S.resolved(found) == sorted(kept, key=lambda s: s.start)
    person = lambda t: [S.Span("PERSON", t.index("Ann"), t.index("Ann") + 3, 0.85)]
    assert [s.type for s in S.find("Ann, a@b.co", more=[person])] == ["PERSON", "EMAIL_ADDRESS"]
    assert len(S.find("a@b.co " * 20_000)) == 20_000


def test_messages_are_anonymised_one_by_one(spark):
    turn = lambda r, c: (r, c)
    rows = [
        (1, [turn("user", "I am a@b.co"), turn("assistant", None), None, turn("user", "a@b.co a@b.co")], "a@b.co", None),
        (2, None, "mail a@b.co", "a@b.co"), (3, None, None, "b@c.de"), (4, None, None, None), (5, [], "a@b.co", None),
    ]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role: string, content: string>>, output string, text string")
    got = {r.id: r for r in privacy.anonymize_examples(df).collect()}
    assert got[1].n_changed == 2 and got[1].messages[0].content == "I am <EMAIL_ADDRESS>" and got[1].messages[2] is None and got[1].messages[1].content is None and got[1].output == "a@b.co"
    assert (got[2].output, got[2].text, got[2].n_changed) == ("mail <EMAIL_ADDRESS>", "a@b.co", 1)
    assert (got[3].text, got[3].n_changed) == ("<EMAIL_ADDRESS>", 1) and got[4].n_changed == 0 and got[5].output == "a@b.co"
    plain = privacy.anonymize_examples(df.select("id", "text")).orderBy("id").collect()
    assert [r.n_changed for r in plain] == [0, 1, 1, 0, 0] and set(plain[0].asDict()) == {"id", "text", "n_changed"}


def test_spans_of_an_array_take_no_objects(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    from quillet.functions import spans as S
    from quillet.operators import privacy as P

    texts = ["mail a@b.org or c@d.org", None, "", "ü" * 30, "nothing", "x@y.com"]
    monkeypatch.setattr(P, "_CHARS", 20)
    got = P._found(pa.array(["cut off", *texts]).slice(1), S.find)
    assert got.to_pylist() == [[s._asdict() for s in S.find(t)] for t in texts]
    assert P._found(pa.array([], pa.string()), S.find).to_pylist() == []
    many = [S.Span("EMAIL_ADDRESS", i, i + 1, 1.0) for i in range(100)]
    tracemalloc.start()
    assert len(P._found(pa.array(["t"] * 5000), lambda t: many)) == 5000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
