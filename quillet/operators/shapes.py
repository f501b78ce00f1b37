"""Rows of any shape: the text they hold, their messages, other formats, and what is wrong with them.

An example has some of the fields text, content, messages, conversation (arrays of role and
content), prompt, completion, response, instruction, input, output, question and answer. A field
that a table lacks, or that is null, is a field the example does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,content:string>>"


def field(rows: DataFrame, name: str) -> Column:
    """A column, or null where the table has none of that name."""
    if name in rows.columns:
        return F.col(name)
    return F.lit(None).cast(TURNS if name in ("messages", "conversation") else "string")


def joined(turns: Column, skip_empty: bool = False) -> Column:
    """The contents of turns with a blank between; missing ones are empty, or left out."""
    parts = F.transform(turns, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.filter(parts, lambda p: p != "") if skip_empty else parts, " ")


def _pair(rows: DataFrame, first: str, second: str) -> Column:
    """Two fields with a blank between; null unless both are there."""
    return F.concat(field(rows, first), F.lit(" "), field(rows, second))


#: What each reader of examples looks at, in its order.
ORDERS = {
    "dedup": ["text", "content", "conversation", "messages", "prompt+completion"],
    "score": ["text", "content", "prompt", "instruction"],
    "version": ["text", "content", "prompt"],
    "analyze": ["messages", "output", "text", "response", "content"],
    "semantic": ["messages*", "conversation*", "text", "prompt+completion", "instruction+output"],
}


def text_of(rows: DataFrame, flavour: str, text_field: str | None = None) -> Column:
    """The text of an example as a reader sees it; empty if it finds none. A ``text_field`` that
    the example has goes first."""

    def part(name: str) -> Column:
        if "+" in name:
            return _pair(rows, *name.split("+"))
        plain = name.rstrip("*")
        return joined(field(rows, plain), name.endswith("*")) if plain in ("messages", "conversation") else field(rows, plain)

    first = [field(rows, text_field)] if text_field else []
    return F.coalesce(*first, *map(part, ORDERS[flavour]), F.lit(""))


def texts_of(rows: DataFrame, id_field: str = "id") -> DataFrame:
    """id, place and text: each text of an example on its own, messages without content left out."""
    contents = lambda name: F.filter(F.transform(field(rows, name), lambda m: m["content"]), lambda c: F.coalesce(c, F.lit("")) != "")
    both = F.when(field(rows, "prompt").isNotNull() & field(rows, "completion").isNotNull(), F.array(field(rows, "prompt"), field(rows, "completion")))
    one = F.when(field(rows, "text").isNotNull(), F.array(field(rows, "text")))
    return rows.select(id_field, F.posexplode(F.coalesce(contents("messages"), contents("conversation"), one, both)).alias("place", "text"))


#: Roles that ask and that answer.
ASKING, ANSWERING = ("user", "human"), ("assistant", "bot", "gpt")


def questions_and_answers(rows: DataFrame) -> DataFrame:
    """Adds ``questions`` and ``answers``, arrays of an example's user and assistant messages."""
    turns = F.coalesce(field(rows, "messages"), field(rows, "conversation"))
    said = lambda roles: F.transform(F.filter(turns, lambda m: m["role"].isin(*roles)), lambda m: F.coalesce(m["content"], F.lit("")))
    out = {"questions": said(ASKING), "answers": said(ANSWERING)}
    for first, second in (("prompt", "completion"), ("instruction", "output"), ("question", "answer")):
        there = field(rows, first).isNotNull() & field(rows, second).isNotNull()
        out["questions"] = F.coalesce(out["questions"], F.when(there, F.array(field(rows, first))))
        out["answers"] = F.coalesce(out["answers"], F.when(there, F.array(field(rows, second))))
    none = F.array().cast("array<string>")
    return rows.withColumns({n: F.coalesce(c, none) for n, c in out.items()})


#: The roles of conversations in chat format; others go.
CHAT_ROLES = {"user": "user", "assistant": "assistant", "system": "system", "human": "user", "person": "user", "bot": "assistant", "ai": "assistant", "agent": "assistant"}


def _turn(role: str, content: Column) -> Column:
    """An array of one turn, or of none if it has no content."""
    one = F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.when(F.coalesce(content, F.lit("")) != "", one).otherwise(F.array().cast(TURNS))


def to_messages(rows: DataFrame, system: str | None = None) -> DataFrame:
    """Adds ``chat``, the example's messages in chat format, from whatever fields it has; rows of which
    no message comes go. ``system``: a first message, instead of the instruction."""
    f = lambda name: field(rows, name)
    names = F.create_map(*(F.lit(x) for pair in CHAT_ROLES.items() for x in pair))
    renamed = F.transform(f("conversation"), lambda m: F.struct(F.element_at(names, F.coalesce(m["role"], F.lit("user"))).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    instruction = _turn("system", f("instruction")) if system is None else F.array().cast(TURNS)
    always = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    chat = (
        F.when(f("conversation").isNotNull(), F.filter(renamed, lambda m: m["role"].isNotNull())).when(f("messages").isNotNull(), f("messages").cast(TURNS))
        .when(f("instruction").isNotNull(), F.concat(instruction, _turn("user", f("input")), _turn("assistant", f("output"))))
        .when(f("prompt").isNotNull(), F.concat(always("user", f("prompt")), _turn("assistant", F.coalesce(f("completion"), f("response")))))
        .when(f("input").isNotNull() & f("output").isNotNull(), F.concat(always("user", f("input")), always("assistant", f("output"))))
        .otherwise(F.array().cast(TURNS))
    )
    if system is not None:
        chat = F.concat(_turn("system", F.lit(system)), chat)
    return rows.withColumn("chat", chat).where(F.size("chat") > 0)


def _texts(turns: Column, roles: tuple[str, ...]) -> Column:
    """Contents of some roles, a line each; empty ones before the first other go."""
    said = F.transform(F.filter(turns, lambda m: m["role"].isin(*roles)), lambda m: F.coalesce(m["content"], F.lit("")))
    return F.aggregate(said, F.lit(""), lambda a, c: F.when(a == "", c).otherwise(F.concat(a, F.lit("\n"), c)))


def to_alpaca(rows: DataFrame) -> DataFrame:
    """Adds alpaca's ``instruction``, ``input`` and ``output``, as one struct ``alpaca``; rows of other
    shapes go."""
    f = lambda name: field(rows, name)
    row = lambda i, q, a: F.struct(i.alias("instruction"), q.alias("input"), a.alias("output"))
    empty = F.lit("")
    turns = F.coalesce(f("conversation"), f("messages"))
    system = F.coalesce(F.get(F.reverse(F.filter(turns, lambda m: m["role"] == "system")), 0)["content"], empty)
    general = F.when(system == "", "Respond to the following conversation.").otherwise(system)
    out = (
        F.when(f("instruction").isNotNull() & f("output").isNotNull(), row(f("instruction"), F.coalesce(f("input"), empty), f("output")))
        .when(turns.isNotNull(), row(general, _texts(turns, ("user", "human")), _texts(turns, ("assistant", "bot", "ai"))))
        .when(f("prompt").isNotNull(), row(F.lit("Complete the following prompt."), f("prompt"), F.coalesce(f("completion"), f("response"), empty)))
        .when(f("input").isNotNull() & f("output").isNotNull(), row(F.coalesce(f("instruction"), F.lit("Respond to the input.")), f("input"), f("output")))
    )
    return rows.withColumn("alpaca", out).where("alpaca IS NOT NULL")


def chat_to_instruction(rows: DataFrame) -> DataFrame:
    """Adds ``instruction`` and ``output``, the first user and the first assistant message; rows without
    both, or with fewer than two messages, go."""
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]
    out = rows.where(F.size("messages") >= 2).withColumns({"instruction": first("user"), "output": first("assistant")})
    return out.where("instruction <> '' AND output <> ''")


def instruction_to_chat(rows: DataFrame) -> DataFrame:
    """Adds ``messages`` of the instruction and the output; rows without both go."""
    both = F.concat(_turn("user", F.col("instruction")), _turn("assistant", F.col("output")))
    return rows.where("instruction <> '' AND output <> ''").withColumn("messages", both)


def cut(text: Column, size: int) -> Column:
    """The first ``size`` characters with dots, if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def chat_columns(rows: DataFrame) -> DataFrame:
    """Adds first_message and first_response (the first that are not empty, cut at 100 characters)
    and messages_count, for a flat file."""
    first = lambda role: cut(F.coalesce(F.get(F.filter("messages", lambda m: (m["role"] == role) & (m["content"] != "")), 0)["content"], F.lit("")), 100)
    return rows.withColumns({"first_message": first("user"), "first_response": first("assistant"), "messages_count": F.coalesce(F.size("messages"), F.lit(0))})


def structure_issues(rows: DataFrame, kind: str) -> Column:
    """What an example of kind ``chat`` or ``instruction`` lacks, as an array of sentences."""
    f = lambda name: field(rows, name)
    if kind == "instruction":
        issues = F.array(*(F.when(f(n).isNull(), f"Missing '{n}' field") for n in ("instruction", "output")))
    else:
        each = lambda m, i: (
            F.when(m["role"].isNull(), F.concat(F.lit("Message "), i, F.lit(" is missing 'role'")))
            .when(m["content"].isNull(), F.concat(F.lit("Message "), i, F.lit(" is missing 'content'")))
            .when(~m["role"].isin("user", "assistant", "system"), F.concat(F.lit("Message "), i, F.lit(" has invalid role: "), m["role"]))
        )
        turns = f("messages")
        issues = (
            F.when(turns.isNull(), F.array(F.lit("Missing 'messages' field")))
            .when(F.size(turns) < 2, F.array(F.lit("Too few messages (need at least 2)")))
            .otherwise(F.transform(turns, each))
        )
    missing = F.array(F.when(F.col("metadata").isNull() if "metadata" in rows.columns else F.lit(True), "Missing 'metadata' field"))
    return F.array_compact(F.concat(issues, missing))


def exportable(rows: DataFrame, exporter: str) -> Column:
    """Whether an example has fields that the exporter can use."""
    f = lambda name: field(rows, name).isNotNull()
    base = f("conversation") | f("messages") | f("instruction") | f("prompt")
    if exporter == "alpaca":
        return base | f("input") | f("output")
    if exporter == "openai":
        return base | (f("input") & f("output"))
    if exporter == "huggingface":
        return base | (f("input") & f("output")) | f("text") | f("content")
    if exporter == "langchain":
        return F.lit(True)
    raise ValueError(f"unknown exporter {exporter!r}")


def to_sharegpt(rows: DataFrame) -> DataFrame:
    """Adds ``conversations``, an array of from and value; rows of which none comes go."""
    f = lambda name: field(rows, name)
    names = F.create_map(*(F.lit(x) for pair in {"system": "system", "user": "human", "human": "human", "assistant": "gpt", "bot": "gpt", "ai": "gpt"}.items() for x in pair))
    turns = F.transform(F.coalesce(f("conversation"), f("messages")), lambda m: F.struct(F.element_at(names, m["role"]).alias("from"), F.coalesce(m["content"], F.lit("")).alias("value")))
    said = lambda q, a: F.array(F.struct(F.lit("human").alias("from"), q.alias("value")), F.struct(F.lit("gpt").alias("from"), a.alias("value")))
    empty = F.lit("")
    asked = F.concat(f("instruction"), F.when(F.coalesce(f("input"), empty) != "", F.concat(F.lit("\n\n"), f("input"))).otherwise(""))
    out = (
        F.when(turns.isNotNull(), F.filter(turns, lambda m: m["from"].isNotNull())).when(f("instruction").isNotNull(), said(asked, F.coalesce(f("output"), empty)))
        .when(f("prompt").isNotNull(), said(f("prompt"), F.coalesce(f("completion"), f("response"), empty))).when(f("input").isNotNull() & f("output").isNotNull(), said(f("input"), f("output")))
    )
    return rows.withColumn("conversations", out).where("size(conversations) > 0")


def to_hub(rows: DataFrame) -> DataFrame:
    """The columns of one format of each row (messages, or instruction with input and output, or prompt
    with completion, or input and output, or text), others null, beside id, metadata, domain, subdomain
    and language where the table has them."""
    f = lambda name: field(rows, name)
    turns, empty = F.coalesce(f("conversation"), f("messages")), F.lit("")
    chat, told, asked = turns.isNotNull(), f("instruction").isNotNull(), f("prompt").isNotNull()
    plain = f("input").isNotNull() & f("output").isNotNull()
    kind = F.when(chat, "chat").when(told, "told").when(asked, "asked").when(plain, "plain").when(f("text").isNotNull(), "text")
    keep = [c for c in ("id", "metadata", "domain", "subdomain", "language") if c in rows.columns]
    return rows.withColumn("kind__", kind).select(
        *keep, F.when(F.col("kind__") == "chat", turns).alias("messages"), F.when(F.col("kind__") == "told", f("instruction")).alias("instruction"),
        F.when(F.col("kind__") == "told", F.coalesce(f("input"), empty)).when(F.col("kind__") == "plain", f("input")).alias("input"),
        F.when(F.col("kind__") == "told", F.coalesce(f("output"), empty)).when(F.col("kind__") == "plain", f("output")).alias("output"),
        F.when(F.col("kind__") == "asked", f("prompt")).alias("prompt"), F.when(F.col("kind__") == "asked", F.coalesce(f("completion"), f("response"), empty)).alias("completion"),
        F.when(F.col("kind__") == "text", f("text")).alias("text"),
    )


#: Names of the types in a table's description.
FEATURES = {"string": "string", "bigint": "int32", "int": "int32", "double": "float32", "float": "float32", "boolean": "int32", "array": "list", "struct": "dict", "map": "dict"}


def features(rows: DataFrame) -> dict[str, str]:
    """The type of each column by its name in a table's description."""
    return {f.name: FEATURES.get(f.dataType.simpleString().split("<")[0], "string") for f in rows.schema}


def shape(rows: DataFrame) -> Column:
    """conversation, instruction, prompt-completion, text or unknown, by the fields of each row."""
    f = lambda name: field(rows, name).isNotNull()
    return (
        F.when(f("conversation") | f("messages"), "conversation").when(f("instruction"), "instruction").when(f("prompt"), "prompt-completion")
        .when(f("text") | f("content"), "text").otherwise("unknown")
    )


def consistency(rows: DataFrame) -> DataFrame:
    """One row: the number of known formats and the score, 100 for one, 80 for two, else 60."""
    n = F.count_distinct(F.nullif(shape(rows), F.lit("unknown")))
    return rows.agg(n.alias("n_formats")).withColumn("score", F.when(F.col("n_formats") == 1, 100).when(F.col("n_formats") == 2, 80).otherwise(60))
