"""Queries over spans of personal data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import spans
from quillet.operators import privacy
from quillet.plans.examples import examples

#: Types of which every candidate that passes its check is certain, so that SQL can count them.
CERTAIN = ("CREDIT_CARD", "EMAIL_ADDRESS", "IBAN_CODE")


def _docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _found(spark, sf_dir: str, **options) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("pii", privacy.spans(F.col("text"), **options))


def _examples(spark, sf_dir: str) -> DataFrame:
    """All examples anonymised: how many of their texts changed, and a digest of what they say now."""
    out = privacy.anonymize_examples(examples(spark, sf_dir))
    said = F.concat_ws("\n", F.transform("messages", lambda m: m["content"]), "output", "text", "content")
    return out.select("id", "n_changed", F.md5(said.cast("binary")).alias("digest"))


def _turns(spark, sf_dir: str) -> DataFrame:
    """The certain types over all turns: spans and rows of each."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    both = turns.unionByName(_docs(spark, sf_dir).select("text"))
    return privacy.by_type(both.select(privacy.spans(F.col("text"), 1.0, CERTAIN).alias("pii")))


QUERIES = {
    "pii_spans": lambda s, d: _found(s, d, least=0.4).select("doc_id", F.explode("pii").alias("s")).select("doc_id", "s.*"),
    "pii_totals": lambda s, d: privacy.totals(_found(s, d, least=1.0, types=CERTAIN)),
    "pii_certain_counts": _turns,
    "pii_anonymized_examples": _examples,
}

_CARD, _MAIL, _IBAN = (next(r.pattern.pattern for r in spans.RECOGNIZERS if r.type == t) for t in CERTAIN)
_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i:i]::INT WHEN d[i:i]::INT > 4 THEN 2 * d[i:i]::INT - 9 ELSE 2 * d[i:i]::INT END)) % 10 = 0"
_CERTAIN = f"""m AS (SELECT r, 'EMAIL_ADDRESS' AS type, unnest(regexp_extract_all(text, '{_MAIL}')) AS x FROM t UNION ALL SELECT r, 'CREDIT_CARD', unnest(regexp_extract_all(text, '{_CARD}')) FROM t
        UNION ALL SELECT r, 'IBAN_CODE', unnest(regexp_extract_all(text, '{_IBAN}')) FROM t),
    n AS (SELECT *, CASE WHEN type = 'IBAN_CODE' THEN '1' ELSE regexp_replace(x, '[^0-9]', '', 'g') END AS d, list_reduce([0::BIGINT] || list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(replace(x, ' ', ''), 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR WHEN c BETWEEN '0' AND '9' THEN c ELSE '0' END), ''), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE 0 END), lambda a, b: (a * 10 + b) % 97) AS rest FROM m),
    s AS (SELECT r, type FROM n WHERE type = 'EMAIL_ADDRESS' OR (type = 'CREDIT_CARD' AND {_LUHN}) OR (type = 'IBAN_CODE' AND rest = 1))"""

ORACLE_SQL = {
    "pii_certain_counts": f"""WITH t AS (SELECT row_number() OVER () AS r, text FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)), {_CERTAIN} SELECT type, count(*) AS n, count(DISTINCT r) AS n_rows FROM s GROUP BY 1""",
    "pii_totals": f"""WITH t AS (SELECT row_number() OVER () AS r, text FROM documents), {_CERTAIN} SELECT (SELECT count(*) FROM documents) AS n, count(DISTINCT r) AS pii_count, round(100 * count(DISTINCT r) / (SELECT count(*) FROM documents), 2) AS pii_percentage, count(*) AS n_spans FROM s""",
}
