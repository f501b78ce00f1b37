"""The pipeline's stages one by one on small tables, against plain versions."""

import zlib

import pytest

import corpus_pipeline
from quillet.llm import jaccard, substrings

P = pytest.importorskip("public_tokenizers")
SHARED = " ".join(f"w{i}" for i in range(60))
ROWS = [(1, SHARED), (2, SHARED), (3, "own words here " + SHARED), (4, ""), (5, None), (6, "  "), (7, "\n\n"), (8, "Mail a@b.com now"), (8, "same id")]


def table_of(spark, rows):
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_packing_keeps_every_row(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    got = corpus_pipeline.pack(spark, table_of(spark, ROWS), "").select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert ordered(got) == ordered(want)


def test_passages_keep_every_row(spark):
    got = corpus_pipeline.drop_passages(spark, table_of(spark, ROWS), "").collect()
    plain = [n for _, _, n, _ in substrings.brute_force(ROWS)]
    want = [(i, t if not n else "own words here" if i == 3 else "") for (i, t), n in zip(ROWS, plain)]
    assert ordered((r.doc_id, r.text) for r in got) == ordered(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_private_data_keep_every_row(spark):
    got = corpus_pipeline.replace_private(spark, table_of(spark, ROWS), "").collect()
    assert ordered((r.doc_id, r.text) for r in got if "Mail" not in (r.text or "")) == ordered(r for r in ROWS if "Mail" not in (r[1] or ""))
    mail = [r for r in got if "Mail" in (r.text or "")]
    assert len(mail) == 1 and "a@b.com" not in mail[0].text and mail[0].n_chars == len(mail[0].text)


def test_toxicity_takes_what_is_predicted_only(spark):
    from quillet.llm import toxicity
    from quillet.llm.common import table

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    toxic = {r.doc_id for r in toxicity.op7(spark, sf_dir).collect() if r.predicted == 1}
    want = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect() if r.doc_id not in toxic]
    assert toxic and ordered(corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()) == ordered(want)


def plain_keep_one(rows):
    """Of each component (by the ids of rows numbered apart) the texts of its least doc_id."""
    roots = [c for _, _, c in jaccard.brute_force(list(enumerate(t for _, t in rows)))]
    sizes = [n for _, n, _ in jaccard.brute_force(rows)]
    out = [[r] for r, n in zip(rows, sizes) if not n]
    for root in {c for c, n in zip(roots, sizes) if n}:
        group = [r for r, c in zip(rows, roots) if c == root]
        least = min((i is None, i or 0) for i, _ in group)
        out.append([r for r in group if (r[0] is None, r[0] or 0) == least])
    return out


def test_near_copies_keep_one_of_each_component(spark):
    near = [SHARED.replace("w7 ", f"x{i} ") for i in range(4)]
    other = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    rows = [
        (1, near[0]), (9, near[1]), (9, other[0]), (5, other[1]), (5, other[2]), (5, other[2]), (None, other[3]), (None, other[3].replace("d7 ", "y ")),
        (None, near[2]), (0, other[4]), (0, other[4].replace("e7 ", "z ")), (7, ""), (7, None), (7, None), (8, " \n"), (None, ""),
    ]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table_of(spark, rows), "").collect()]
    want = plain_keep_one(rows)
    assert len(got) == len(want)
    for choices in want:
        assert any(c in got for c in choices)
        got.remove(next(c for c in choices if c in got))
    assert not got
