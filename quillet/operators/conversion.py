"""Conversations in the formats of training and retrieval tools.

Formats of single messages are made turn by turn, without gathering a conversation; those of
one text for a conversation gather its turns, so a conversation has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T

#: The roles of each format. Roles that are not listed go, or stay for langchain.
ROLES = {
    "openai": {"user": "user", "assistant": "assistant", "system": "system", "human": "user", "person": "user", "bot": "assistant", "ai": "assistant", "agent": "assistant"},
    "sharegpt": {"system": "system", "user": "human", "human": "human", "assistant": "gpt", "bot": "gpt", "ai": "gpt"},
    "langchain": {"assistant": "ai", "bot": "ai", "user": "human", "person": "human"},
}


def role(of: Column, dialect: str) -> Column:
    """A role's name in a dialect; null if it has none."""
    out = of if dialect == "langchain" else F.lit(None).cast("string")
    for name, other in ROLES[dialect].items():
        out = F.when(of == name, other).otherwise(out)
    return out


def turns_in(turns: DataFrame, dialect: str) -> DataFrame:
    """conv_id, turn, role and content of the turns whose role the dialect knows."""
    each = turns.select("conv_id", "turn", role(F.col("role"), dialect).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return each.where("role IS NOT NULL")


def _joined(parts: Column) -> Column:
    """Texts in order of turn, a line each; empty ones before the first other go."""
    ordered = F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["text"])
    first = lambda texts: F.array_position(F.transform(texts, lambda t: t != ""), True)
    return T.let(ordered, lambda ts: T.let(first(ts), lambda at: F.when(at > 0, F.array_join(F.filter(ts, lambda t, i: i >= at - 1), "\n")).otherwise("")))


def alpaca(turns: DataFrame) -> DataFrame:
    """instruction (the last system turn, else a general one), input (user) and output (assistant)."""
    row = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    pick = lambda *names: _joined(F.when(F.col("role").isin(*names), F.struct("turn", "text")))
    system = F.max_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn")))
    out = row.groupBy("conv_id").agg(system.alias("instruction"), pick("user", "human").alias("input"), pick("assistant", "bot", "ai").alias("output"))
    return out.withColumn("instruction", F.coalesce(F.nullif("instruction", F.lit("")), F.lit("Respond to the following conversation.")))


def documents(turns: DataFrame) -> DataFrame:
    """page_content: ``Role: text`` of each turn, with an empty line between."""
    name = F.coalesce("role", F.lit("unknown"))
    line = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 20)), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda p: p["line"])
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "\n\n").alias("page_content"))


def to_chat(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """messages of a user's and an assistant's turn; empty ones go."""
    of = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("content"))
    return rows.withColumn("messages", F.filter(F.array(of("user", question), of("assistant", answer)), lambda m: F.coalesce(m["content"], F.lit("")) != ""))


def invalid_turns(turns: DataFrame) -> DataFrame:
    """Turns that fine-tuning would refuse, and why: missing_role, missing_content or unknown_role."""
    known = F.col("role").isin("system", "user", "assistant", "function")
    issue = F.when(F.col("role").isNull(), "missing_role").when(F.col("text").isNull(), "missing_content").when(~known, "unknown_role")
    return turns.select("conv_id", "turn", issue.alias("issue")).where("issue IS NOT NULL")


def with_metadata(turns: DataFrame, fields: dict[str, str], source: str = "synthetic") -> DataFrame:
    """page_content as :func:`documents` makes it, and ``metadata`` as JSON: the source, the id, and those of ``fields``
    (name to column of the turns, the first that is not null counts) that have a value."""
    of = {name: F.first(column, ignorenulls=True).alias(name) for name, column in fields.items()}
    own = turns.groupBy("conv_id").agg(*of.values())
    packed = F.to_json(F.struct(F.lit(source).alias("source"), F.col("conv_id").alias("id"), *fields))
    return documents(turns).join(own.select("conv_id", packed.alias("metadata")), "conv_id")
