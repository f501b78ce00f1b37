"""DuckDB SQL of those operators that SQL can express, over the same tables."""

from __future__ import annotations

from quillet.llm import quality

#: Words of a text: runs of other than the six ASCII white-space characters.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = """WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i))),
    r AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS h,
        xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
        FROM documents, bits),
    g AS (SELECT *, sum(size) OVER (PARTITION BY h) AS whole, max(size) OVER () AS largest, sum(size) OVER () AS total FROM r),
    p AS (SELECT *, h[1:3] AS bucket, CASE WHEN whole <= largest THEN 0 ELSE 1 + ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:2])::INT END AS part FROM g),
    o AS (SELECT *, sum(size) OVER (ORDER BY bucket, part, h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS up_to_row, sum(size) OVER (ORDER BY bucket, part, h) AS up_to_group FROM p),
    s AS (SELECT *, least((CASE WHEN part = 0 THEN 2 * up_to_group - whole ELSE 2 * up_to_row - size END) * 40 // (2 * total), 39)::INT AS shard FROM o)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, part, h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

OP3 = rf"""WITH RECURSIVE w AS (SELECT md5(coalesce(text, '')) AS d, any_value({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS w FROM documents GROUP BY 1),
    s AS (SELECT d, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    u AS (SELECT d, len(s) AS n, unnest(s) AS g FROM s),
    e AS (SELECT a.d AS a, b.d AS b FROM u a JOIN u b ON a.g = b.g AND a.d <> b.d GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    reach(d, other) AS (SELECT d, d FROM s UNION SELECT reach.d, e.b FROM reach JOIN e ON reach.other = e.a),
    ids AS (SELECT md5(coalesce(text, '')) AS d, min(doc_id) AS least FROM documents GROUP BY 1),
    c AS (SELECT reach.d, min(least) AS component_id FROM reach JOIN ids ON reach.other = ids.d GROUP BY 1)
    SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE coalesce(component_id, doc_id) END AS component_id
    FROM documents JOIN s ON md5(coalesce(text, '')) = s.d JOIN c ON c.d = s.d"""

OP8 = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    v AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS v FROM w),
    twice AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY v) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
    each AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""

_TERM = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"


def _both(p: str, q: str) -> str:
    return f"{_TERM.format(a=p, b=q)} + {_TERM.format(a=q, b=p)}"


OP6 = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lower(lang), '{quality.REST}') AS lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    each AS (SELECT r, lang, unnest(w) AS word FROM t),
    langs AS (SELECT lang, count(*) AS total, sum(count(*)) OVER () AS whole FROM each WHERE lang <> '{quality.REST}' GROUP BY 1 QUALIFY total >= {quality.MIN_LANG_WORDS} AND total >= {quality.MIN_LANG_SHARE} * (SELECT count(*) FROM each)),
    belong AS (SELECT r, CASE WHEN lang IN (SELECT lang FROM langs) THEN lang ELSE '{quality.REST}' END AS lang FROM t),
    counts AS (SELECT belong.lang, word, count(*) AS n FROM each JOIN belong USING (r) GROUP BY 1, 2),
    sizes AS (SELECT lang, sum(n) AS total FROM counts GROUP BY 1 HAVING sum(n) >= {quality.MIN_LANG_WORDS}),
    top AS (SELECT lang, word, n / total AS q FROM counts JOIN sizes USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {quality.COMMON}),
    lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
    grams AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t),
    twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS i FROM twice) GROUP BY 1),
    f AS (SELECT r, doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(text) AS size, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '[.,;:?!''"()-]')) AS stops,
        len(regexp_extract_all(text, '[^\p{{L}}\t\n\x0B\f\r .,;:?!''"()-]')) AS marks FROM t JOIN lines USING (r) LEFT JOIN repeated USING (r)),
    c AS (SELECT r, unnest(range(5)) AS k, unnest([word_chars - upper - stops - marks, upper, stops, marks, size - word_chars]) AS n, size FROM f),
    rc AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM c JOIN belong USING (r) WHERE lang IN (SELECT lang FROM sizes) GROUP BY 1, 2),
    dc AS (SELECT r, lang, sqrt(greatest(0, sum({_both('p', 'q')}) / 2)) AS d FROM (SELECT r, rc.lang, n / size AS p, q FROM c JOIN rc USING (k) WHERE size > 0) GROUP BY 1, 2),
    own AS (SELECT r, word, count(*) AS n FROM each WHERE word IN (SELECT word FROM top) GROUP BY 1, 2),
    pw AS (SELECT f.r, top.lang, coalesce(own.n, 0) / n_words AS p, q FROM f JOIN top ON n_words > 0 LEFT JOIN own ON own.r = f.r AND own.word = top.word),
    sw AS (SELECT r, lang, sum({_both('p', 'q')}) AS s, 1 - sum(p) AS p, 1 - sum(q) AS q FROM pw GROUP BY 1, 2),
    dw AS (SELECT r, lang, sqrt(greatest(0, (s + {_both('p', 'q')}) / 2)) AS d FROM sw),
    near AS (SELECT r, bool_or((word_chars < {quality.MIN_CHARS} OR dc.d <= {quality.MAX_CHARS}) AND (n_words < {quality.MIN_WORDS} OR dw.d <= {quality.MAX_WORDS})) AS near FROM f JOIN dc USING (r) JOIN dw USING (r) WHERE dc.lang = dw.lang GROUP BY 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ((SELECT count(*) FROM sizes) = 0 OR near) AS kept FROM f LEFT JOIN near USING (r)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    each AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM each),
    o AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k),
    kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped FROM o GROUP BY 1)
    SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM d JOIN kept USING (r)"""

OP11 = """WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i))),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i, m, n FROM
        (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM t), bits),
    r AS (SELECT c.conv_id, 0 AS side, i, m, n FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT conv_id, 1, i, m, n FROM c JOIN t USING (conv_id) WHERE i > h),
    s AS (SELECT conv_id, count(*) OVER w AS depth, string_agg(m, '') OVER w AS path, n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, i) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    p AS (SELECT conv_id, depth, md5(path) AS d, CASE WHEN depth > 0 THEN md5(left(path, length(path) - 64)) END AS parent, n, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM s),
    v AS (SELECT depth, d, any_value(parent) AS parent, any_value(n) AS n, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
    k AS (SELECT parent, count(*) AS n_children FROM v GROUP BY 1),
    w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k ON k.parent = v.d),
    b AS (SELECT p.d, sum((n_convs - 1) * w.n)::BIGINT AS saved_tokens, count_if(n_children = 0)::BIGINT AS n_leaves FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY 1)
    SELECT w.conv_id, w.depth, above.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN b USING (d) LEFT JOIN v AS above ON above.d = w.parent"""


def _lloyd() -> str:
    """Plain Lloyd, a pair of common tables for each round."""
    near = "SELECT r, p, min(d * 16 + e) AS m FROM (SELECT r, x.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT AS d FROM x JOIN c{k} AS c ON c.p = x.p) GROUP BY 1, 2"
    better = """SELECT c.p, c.e, coalesce(n.y, c.y) AS y FROM c{k} AS c LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS y FROM
        (SELECT x.p, m % 16 AS e, i, (sum(x[i])::BIGINT - ((sum(x[i])::BIGINT % count(*) + count(*)) % count(*))) // count(*) AS s FROM x JOIN a{k} USING (r, p), range(1, 9) AS q(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) AS n ON n.p = c.p AND n.e = c.e"""
    rounds = ",\n    ".join(f"a{k} AS MATERIALIZED ({near.format(k=k)}),\n    c{k + 1} AS MATERIALIZED ({better.format(k=k)})" for k in range(6))
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda z: floor(4096 * z::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
    x AS MATERIALIZED (SELECT r, p, v[p * 8 + 1:p * 8 + 8] AS x FROM v, range(8) AS q(p)),
    c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM x WHERE r <= 16),
    {rounds},
    a6 AS ({near.format(k=6)}),
    o AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a6 GROUP BY 1),
    h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"""


ORACLE_SQL = {"op2_byte_balanced_sharding": OP2, "op3_ngram_jaccard_join": OP3, "op6_distribution_divergence": OP6, "op8_substring_dedup": OP8, "op11_prefix_trie": OP11, "op12_heap_lloyd": _lloyd(), "op13_line_runs": OP13}
