"""Queries over examples of every shape, and their SQL.

The examples are the documents: by the remainder of its id, each takes another of the shapes
that datasets come in, so every row of the table is one example.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import shapes as S


def examples(spark, sf_dir: str) -> DataFrame:
    """id, the fields of seven shapes, metadata (domain and score), domain and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.pmod("doc_id", F.lit(7))
    at = lambda n, c: F.when(k == n, c)
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("About "), "source").alias("content"))
    return docs.select(
        F.col("doc_id").alias("id"), at(0, F.col("text")).alias("text"), at(1, F.col("text")).alias("content"),
        at(2, F.array(system, turn("user", "text"), turn("assistant", "source"), turn("tool", "lang"))).alias("messages"),
        at(3, F.array(turn("human", "lang"), turn("bot", "text"), turn("agent", "source"))).alias("conversation"),
        at(4, F.col("text")).alias("prompt"), at(4, F.col("source")).alias("completion"), at(5, F.col("lang")).alias("instruction"), at(5, F.col("source")).alias("input"),
        at(5, F.col("text")).alias("output"), at(6, F.col("lang")).alias("question"), at(6, F.col("text")).alias("answer"), F.col("source").alias("domain"), F.col("lang").alias("language"),
        F.when(k != 1, F.struct(F.col("source").alias("domain"), (F.col("n_chars") / 1000.0).alias("quality_score"))).alias("metadata"),
    )


def _md5(c: str):
    return F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary")).alias(c)


def _text(flavour: str, text_field: str | None = None):
    return lambda s, d: examples(s, d).select("id", S.text_of(examples(s, d), flavour, text_field).alias("text")).select("id", _md5("text"))


def _chat(spark, sf_dir: str) -> DataFrame:
    chat = S.to_messages(examples(spark, sf_dir))
    return chat.select("id", F.posexplode("chat").alias("place", "m")).select("id", "place", F.col("m.role").alias("role"), F.md5(F.col("m.content").cast("binary")).alias("content"))


def _sharegpt(spark, sf_dir: str) -> DataFrame:
    rows = S.to_sharegpt(examples(spark, sf_dir))
    return rows.select("id", F.posexplode("conversations").alias("place", "m")).select("id", "place", F.col("m.from").alias("speaker"), F.md5(F.col("m.value").cast("binary")).alias("value"))


def _alpaca(spark, sf_dir: str) -> DataFrame:
    return S.to_alpaca(examples(spark, sf_dir)).select("id", *(F.md5(F.col(f"alpaca.{c}").cast("binary")).alias(c) for c in ("instruction", "input", "output")))


def _hub(spark, sf_dir: str) -> DataFrame:
    rows = S.to_hub(examples(spark, sf_dir))
    return rows.select("id", "domain", "language", F.size("messages").alias("n_messages"), *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("instruction", "input", "output", "prompt", "completion", "text")))


def _asked(spark, sf_dir: str) -> DataFrame:
    rows = S.questions_and_answers(examples(spark, sf_dir))
    return rows.select("id", F.size("questions").alias("n_questions"), F.size("answers").alias("n_answers"), F.md5(F.array_join(F.concat("questions", "answers"), "|").cast("binary")).alias("digest"))


def _report(spark, sf_dir: str) -> DataFrame:
    """Totals of a chat table for fine-tuning: messages, roles, estimated tokens and cost."""
    each = S.to_messages(examples(spark, sf_dir)).select("id", F.explode("chat").alias("m"))
    sums = each.agg(
        F.count_distinct("id").alias("n"), F.count("*").alias("messages"), *(F.count_if(F.col("m.role") == r).alias(r) for r in ("system", "user", "assistant")),
        F.coalesce(F.sum(F.floor(F.length("m.content") / 4)), F.lit(0)).cast("long").alias("tokens"),
    )
    return sums.select("*", F.round(F.col("messages") / F.col("n"), 2).alias("messages_each"), F.round(F.col("tokens") * F.lit(0.008) / 1000, 2).alias("cost"))


def _filtered(spark, sf_dir: str) -> DataFrame:
    """Examples of one domain with a quality score; a missing one counts as 0."""
    score = F.coalesce("metadata.quality_score", F.lit(0.0))
    return examples(spark, sf_dir).where((F.col("metadata.domain") == "src3") & (score >= 0.5) | (F.col("metadata.domain") != "src3") & (score >= 2)).select("id")


QUERIES = {
    "text_for_dedup": _text("dedup"),
    "text_for_score": _text("score"),
    "text_for_version": _text("version", "answer"),
    "text_for_analysis": _text("analyze"),
    "text_for_clusters": _text("semantic"),
    "texts_flat": lambda s, d: S.texts_of(examples(s, d)).select("id", "place", _md5("text")),
    "questions_answers": _asked,
    "to_chat_any": _chat,
    "to_sharegpt_any": _sharegpt,
    "to_alpaca_any": _alpaca,
    "to_hub": _hub,
    "chat_to_instruction": lambda s, d: S.chat_to_instruction(examples(s, d)).select("id", _md5("instruction"), _md5("output")),
    "instruction_to_chat": lambda s, d: S.instruction_to_chat(examples(s, d)).select("id", F.size("messages").alias("n"), F.md5(F.col("messages")[1]["content"].cast("binary")).alias("answer")),
    "csv_columns": lambda s, d: S.chat_columns(examples(s, d)).select("id", F.coalesce("metadata.domain", F.lit("")).alias("domain"), "first_message", "first_response", "messages_count"),
    "structure_issues_chat": lambda s, d: examples(s, d).select("id", F.explode(S.structure_issues(examples(s, d), "chat")).alias("issue")),
    "structure_issues_instruction": lambda s, d: examples(s, d).select("id", F.explode(S.structure_issues(examples(s, d), "instruction")).alias("issue")),
    "exportable": lambda s, d: examples(s, d).select("id", *(S.exportable(examples(s, d), e).alias(e) for e in ("alpaca", "openai", "huggingface", "langchain"))),
    "shape_counts": lambda s, d: examples(s, d).groupBy(S.shape(examples(s, d)).alias("shape")).agg(F.count("*").alias("n")),
    "shape_consistency": lambda s, d: S.consistency(examples(s, d)),
    "truncated": lambda s, d: examples(s, d).select("id", S.cut(S.text_of(examples(s, d), "dedup"), 60).alias("start")),
    "chat_report": _report,
    "metadata_filter": _filtered,
}

_EX = """ex AS (SELECT doc_id AS id, CASE WHEN k = 0 THEN text END AS text, CASE WHEN k = 1 THEN text END AS content,
    CASE WHEN k = 2 THEN [{'role': 'system', 'content': 'About ' || source}, {'role': 'user', 'content': text}, {'role': 'assistant', 'content': source}, {'role': 'tool', 'content': lang}] END AS messages,
    CASE WHEN k = 3 THEN [{'role': 'human', 'content': lang}, {'role': 'bot', 'content': text}, {'role': 'agent', 'content': source}] END AS conversation,
    CASE WHEN k = 4 THEN text END AS prompt, CASE WHEN k = 4 THEN source END AS completion, CASE WHEN k = 5 THEN lang END AS instruction, CASE WHEN k = 5 THEN source END AS input,
    CASE WHEN k = 5 THEN text END AS output, CASE WHEN k = 6 THEN lang END AS question, CASE WHEN k = 6 THEN text END AS answer, source AS domain, lang AS language, CASE WHEN k <> 1 THEN source END AS m_domain,
    CASE WHEN k <> 1 THEN n_chars / 1000.0::DOUBLE END AS m_score, k FROM (SELECT *, doc_id % 7 AS k FROM documents))"""
_JOIN = "array_to_string(list_transform({0}, lambda m: coalesce(m.content, '')), ' ')"
_SOME = "array_to_string(list_filter(list_transform({0}, lambda m: coalesce(m.content, '')), lambda c: c <> ''), ' ')"


def _text_sql(*parts: str) -> str:
    return f"WITH {_EX} SELECT id, md5(coalesce({', '.join(parts)}, '')) AS text FROM ex"


_CHAT = """chat AS (SELECT id, CASE WHEN k = 3 THEN [{'role': 'user', 'content': conversation[1].content}, {'role': 'assistant', 'content': conversation[2].content}, {'role': 'assistant', 'content': conversation[3].content}]
    WHEN k = 2 THEN messages WHEN k = 5 THEN list_filter([{'role': 'system', 'content': instruction}, {'role': 'user', 'content': input}, {'role': 'assistant', 'content': output}], lambda m: m.content <> '')
    WHEN k = 4 THEN [{'role': 'user', 'content': prompt}] || list_filter([{'role': 'assistant', 'content': completion}], lambda m: m.content <> '') END AS chat FROM ex WHERE k IN (2, 3, 4, 5)),
    turns AS (SELECT id, unnest(range(len(chat))) AS place, unnest(chat) AS m FROM chat)"""
_CUT = "CASE WHEN length({0}) > {1} THEN substring({0}, 1, {1}) || '...' ELSE {0} END"

ORACLE_SQL = {
    "text_for_dedup": _text_sql("text", "content", _JOIN.format("conversation"), _JOIN.format("messages"), "prompt || ' ' || completion"),
    "text_for_score": _text_sql("text", "content", "prompt", "instruction"),
    "text_for_version": _text_sql("answer", "text", "content", "prompt"),
    "text_for_analysis": _text_sql(_JOIN.format("messages"), "output", "text", "content"),
    "text_for_clusters": _text_sql(_SOME.format("messages"), _SOME.format("conversation"), "text", "prompt || ' ' || completion", "instruction || ' ' || output"),
    "texts_flat": f"""WITH {_EX}, t AS (SELECT id, CASE WHEN k IN (2, 3) THEN list_filter(list_transform(coalesce(messages, conversation), lambda m: m.content), lambda c: coalesce(c, '') <> '')
        WHEN text IS NOT NULL THEN [text] WHEN prompt IS NOT NULL AND completion IS NOT NULL THEN [prompt, completion] END AS t FROM ex)
        SELECT id, unnest(range(len(t)))::INT AS place, md5(coalesce(unnest(t), '')) AS text FROM t""",
    "questions_answers": f"""WITH {_EX}, q AS (SELECT id, CASE k WHEN 2 THEN [text_2] WHEN 3 THEN [language] WHEN 4 THEN [prompt] WHEN 5 THEN [instruction] WHEN 6 THEN [question] ELSE [] END AS q,
        CASE k WHEN 2 THEN [domain] WHEN 3 THEN [text_3] WHEN 4 THEN [completion] WHEN 5 THEN [output] WHEN 6 THEN [answer] ELSE [] END AS a FROM (SELECT *, messages[2].content AS text_2, conversation[2].content AS text_3 FROM ex))
        SELECT id, len(q)::INT AS n_questions, len(a)::INT AS n_answers, md5(coalesce(array_to_string(q || a, '|'), '')) AS digest FROM q""",
    "to_chat_any": f"WITH {_EX}, {_CHAT} SELECT id, place::INT AS place, m.role AS role, md5(m.content) AS content FROM turns",
    "to_sharegpt_any": f"""WITH {_EX}, s AS (SELECT id, CASE k WHEN 3 THEN [['human', language], ['gpt', conversation[2].content]] WHEN 2 THEN [['system', messages[1].content], ['human', messages[2].content], ['gpt', domain]]
        WHEN 5 THEN [['human', instruction || CASE WHEN input <> '' THEN chr(10) || chr(10) || input ELSE '' END], ['gpt', output]] WHEN 4 THEN [['human', prompt], ['gpt', completion]] END AS s FROM ex),
        e AS (SELECT id, unnest(range(len(s)))::INT AS place, unnest(s) AS m FROM s) SELECT id, place, m[1] AS speaker, md5(m[2]) AS value FROM e""",
    "to_alpaca_any": f"""WITH {_EX}, a AS (SELECT id, CASE k WHEN 5 THEN [instruction, input, output] WHEN 3 THEN ['Respond to the following conversation.', language, conversation[2].content] WHEN 2 THEN ['About ' || domain, messages[2].content, domain]
        WHEN 4 THEN ['Complete the following prompt.', prompt, completion] END AS a FROM ex) SELECT id, md5(a[1]) AS instruction, md5(a[2]) AS input, md5(a[3]) AS output FROM a WHERE a IS NOT NULL""",
    "to_hub": f"""WITH {_EX} SELECT id, domain, language, len(coalesce(messages, conversation))::INT AS n_messages, md5(instruction) AS instruction, md5(input) AS input, md5(output) AS output, md5(prompt) AS prompt, md5(completion) AS completion, md5(text) AS text FROM ex""",
    "chat_to_instruction": f"WITH {_EX} SELECT id, md5(messages[2].content) AS instruction, md5(messages[3].content) AS output FROM ex WHERE k = 2 AND messages[2].content <> '' AND messages[3].content <> ''",
    "instruction_to_chat": f"WITH {_EX} SELECT id, 2 AS n, md5(output) AS answer FROM ex WHERE instruction <> '' AND output <> ''",
    "csv_columns": f"""WITH {_EX}, c AS (SELECT *, coalesce(messages[2].content, '') AS m, CASE WHEN k = 2 THEN coalesce(domain, '') ELSE '' END AS r FROM ex)
        SELECT id, coalesce(m_domain, '') AS domain, {_CUT.format('m', 100)} AS first_message, {_CUT.format('r', 100)} AS first_response, coalesce(len(messages), 0)::INT AS messages_count FROM c""",
    "structure_issues_chat": f"""WITH {_EX} SELECT id, 'Missing ''messages'' field' AS issue FROM ex WHERE k <> 2 UNION ALL SELECT id, 'Message 3 has invalid role: tool' FROM ex WHERE k = 2
        UNION ALL SELECT id, 'Missing ''metadata'' field' FROM ex WHERE k = 1""",
    "structure_issues_instruction": f"""WITH {_EX} SELECT id, 'Missing ''instruction'' field' AS issue FROM ex WHERE instruction IS NULL UNION ALL SELECT id, 'Missing ''output'' field' FROM ex WHERE output IS NULL
        UNION ALL SELECT id, 'Missing ''metadata'' field' FROM ex WHERE k = 1""",
    "exportable": f"WITH {_EX} SELECT id, k IN (2, 3, 4, 5) AS alpaca, k IN (2, 3, 4, 5) AS openai, k < 6 AS huggingface, true AS langchain FROM ex",
    "shape_counts": f"WITH {_EX} SELECT CASE WHEN k IN (2, 3) THEN 'conversation' WHEN k = 5 THEN 'instruction' WHEN k = 4 THEN 'prompt-completion' WHEN k < 2 THEN 'text' ELSE 'unknown' END AS shape, count(*) AS n FROM ex GROUP BY 1",
    "shape_consistency": f"WITH {_EX}, s AS (SELECT count(DISTINCT CASE WHEN k IN (2, 3) THEN 1 WHEN k = 5 THEN 2 WHEN k = 4 THEN 3 WHEN k < 2 THEN 4 END) AS n_formats FROM ex) SELECT n_formats, CASE n_formats WHEN 1 THEN 100 WHEN 2 THEN 80 ELSE 60 END AS score FROM s",
    "truncated": f"WITH {_EX}, t AS (SELECT id, coalesce(text, content, {_JOIN.format('conversation')}, {_JOIN.format('messages')}, prompt || ' ' || completion, '') AS t FROM ex) SELECT id, {_CUT.format('t', 60)} AS start FROM t",
    "chat_report": f"""WITH {_EX}, {_CHAT}, s AS (SELECT count(DISTINCT id) AS n, count(*) AS messages, count(*) FILTER (m.role = 'system') AS system, count(*) FILTER (m.role = 'user') AS user, count(*) FILTER (m.role = 'assistant') AS assistant,
        coalesce(sum(length(m.content) // 4), 0)::BIGINT AS tokens FROM turns) SELECT *, round(messages / n, 2) AS messages_each, round(tokens * 0.008::DOUBLE / 1000, 2) AS cost FROM s""",
    "metadata_filter": f"WITH {_EX} SELECT id FROM ex WHERE (m_domain = 'src3' AND coalesce(m_score, 0) >= 0.5) OR (m_domain <> 'src3' AND coalesce(m_score, 0) >= 2)",
}
