"""Operator 10, chat formatting with linked tool calls.

Turns carry calls and results as JSON objects in their text. Calls are joined to results by
conversation and identifier; a call that names the results it needs (``after``) comes after
them, and every result directly after its call. Arguments are checked against the tool's schema,
and each turn is written as one canonical JSON object: sorted keys, no blanks, no escapes but
the needed ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import table, written

#: Schemas of known tools: required and optional arguments with their JSON types. Callers pass
#: their own; arguments of unknown tools are not valid.
TOOLS: dict[str, dict] = {
    "search": {"required": {"query": "string"}, "optional": {"limit": "integer"}},
    "calculate": {"required": {"expression": "string"}, "optional": {}},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
_PARSED = "conv_id long, turn long, role string, text string, kind string, call_id string, name string, arguments string, after array<string>, valid boolean"


_HALVES = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON of a value; half surrogate pairs, which no encoding has, stay escapes.
    ValueError for numbers that JSON does not have."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON number")


def valid_arguments(name: str | None, arguments, tools: dict) -> bool:
    """Whether arguments fit the tool's schema: all required ones, no unknown ones, right types."""
    schema = tools.get(name)
    if schema is None or not isinstance(arguments, dict):
        return False
    known = {**schema["required"], **schema["optional"]}

    def fits(value, kind: str) -> bool:
        return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool))

    return set(schema["required"]) <= set(arguments) and all(k in known and fits(v, known[k]) for k, v in arguments.items())


_PLAIN = ("message", None, None, None, [], None)


def _parse(text: str | None, tools: dict) -> tuple:
    """(kind, call_id, name, arguments, after, valid) of a turn's text."""
    if not text or text.lstrip()[:1] != "{":
        return _PLAIN
    try:
        return _linkable(json.loads(text, parse_constant=_no_number), tools) or _PLAIN
    except (ValueError, RecursionError):
        return _PLAIN


def _linkable(found, tools: dict) -> tuple | None:
    """A call or result, or None. Ids and names with half surrogate pairs are no strings."""
    string = lambda x: isinstance(x, str) and not _HALVES.search(x)
    call = found.get("tool_call") if isinstance(found, dict) else None
    if isinstance(call, dict) and string(call.get("id")):
        after = call.get("after")
        after = sorted({a for a in after if string(a)}) if isinstance(after, list) else []
        name = call.get("name") if string(call.get("name")) else None
        return "call", call["id"], name, canonical(call.get("arguments")), after, valid_arguments(name, call.get("arguments"), tools)
    result = found.get("tool_result") if isinstance(found, dict) else None
    if isinstance(result, dict) and string(result.get("id")):
        return "result", result["id"], None, canonical(result.get("content")), [], None
    return None


def parsed(turns: DataFrame, tools: dict) -> DataFrame:
    """Turns with what their text says of calls and results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
        for batch in batches:
            cols = list(zip(*(_parse(t, tools) for t in batch.column("text").to_pylist()))) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types))],
                names=[*batch.schema.names, "kind", "call_id", "name", "arguments", "after", "valid"],
            )

    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return turns.select(*columns).mapInArrow(run, _PARSED)


def _ranks(calls: DataFrame) -> DataFrame:
    """Topological level and anchor of each call: level 0 and its own turn without needs, else one
    more than its needs' levels, and its own turn or its needs' last anchor, whichever is later.
    Calls in a circle, or after one, have none.

    Each round settles the calls whose needs are all settled, of all conversations at once, and
    tells those that wait for them; a call is settled once and a need is told once."""
    key = ["conv_id", "call_id"]
    needs = calls.select(*key, F.explode("after").alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    needs = written(needs.join(known, ["conv_id", "need"], "left_semi"))  # needs of calls that exist
    waits = needs.groupBy(*key).agg(F.count("*").alias("open"))
    todo = calls.select(*key, F.col("turn").alias("anchor")).join(waits, key, "left")
    todo = written(todo.select(*key, "anchor", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("level")))
    done = None
    while not (new := todo.where("open = 0").select(*key, "level", "anchor")).isEmpty():
        done = new if done is None else done.unionByName(new)
        told = needs.join(new.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).groupBy(*key)
        told = told.agg(F.count("*").alias("n"), F.max("level").alias("top"), F.max("anchor").alias("last"))
        todo = todo.where("open > 0").join(told, key, "left")
        todo = written(todo.select(*key, F.greatest("anchor", "last").alias("anchor"), (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("level", F.col("top") + 1).alias("level")))
    return done if done is not None else todo.select(*key, "level", "anchor").limit(0)


def linked(turns: DataFrame, tools: dict | None = None) -> DataFrame:
    """One row for each row of ``turns``, in the conversation's linked order.

    Adds kind (message, call, result), call_id, valid, state and json, and ``place``, the order
    in the conversation. A text is a call or a result if it is a JSON object with ``tool_call``
    or ``tool_result`` that has a string id; all others are messages, null ones with null
    content, as are objects with numbers that JSON lacks (NaN, infinities). State: of calls
    ``linked`` or ``unanswered``, ``circular`` if its needs never end, ``repeated`` if the id was
    called before; of results ``linked``, ``orphan`` without a call, ``repeated`` after the first;
    of messages ``plain``. Messages keep their turn; calls stand in their needs' order at their
    own turn or the place of their last need, whichever is later; first results stand after their
    call. Null turns come first, equal ones in order of role and text. A row without a conv_id is
    a conversation of its own, in which nothing is linked. Extra columns are dropped; an empty
    table gives no rows.
    """
    rows = written(parsed(turns, tools if tools is not None else TOOLS))
    by_id = Window.partitionBy("conv_id", "call_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    in_one = F.col("conv_id").isNotNull()
    calls = written(rows.where("kind = 'call'").where(in_one).withColumn("nth", F.row_number().over(by_id)))
    results = rows.where("kind = 'result'").where(in_one).withColumn("nth", F.row_number().over(by_id))
    firsts = calls.where("nth = 1").select("conv_id", "call_id", "turn", "after")
    info = firsts.select("conv_id", "call_id").join(_ranks(firsts), ["conv_id", "call_id"], "left").withColumn("called", F.lit(True))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    joined = calls.unionByName(results).join(info.withColumnRenamed("anchor", "at"), ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    call, first = F.col("kind") == "call", F.col("nth") == 1
    circular = F.col("level").isNull()
    state = (
        F.when(~first, "repeated").when(call & circular, "circular").when(call & F.col("answered"), "linked").when(call, "unanswered")
        .when(F.col("called").isNull(), "orphan").otherwise("linked")
    )
    bound = first & F.col("level").isNotNull()
    shaped = joined.select(
        *rows.columns, F.when(bound, F.col("at")).otherwise(F.col("turn")).alias("anchor"),
        F.when(bound, F.col("level")).otherwise(0).alias("level"), F.when(call, 0).otherwise(1).alias("part"), state.alias("state"),
    )
    alone = F.when(F.col("kind") == "message", "plain").when(F.col("kind") == "call", "unanswered").otherwise("orphan")
    others = rows.where((F.col("kind") == "message") | ~in_one).withColumns({"anchor": F.col("turn"), "level": F.lit(0), "part": F.lit(0), "state": alone})
    return _ordered(others.unionByName(shaped))


#: Turns in a block of a conversation's order.
_BLOCK = 1024


def _ordered(rows: DataFrame) -> DataFrame:
    """Adds ``place``. Turns are numbered inside blocks of a conversation, and running sums of the
    blocks' sizes give each its start, so no conversation is one task's work, whatever its length."""
    block = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.floor(F.col("anchor") / _BLOCK))
    rows = rows.withColumn("block", block)
    order = ["anchor", "level", F.coalesce("call_id", F.lit("")), "part", "role", "text"]
    inside = rows.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.where("conv_id IS NOT NULL").groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    both = inside.join(starts, (F.col("conv_id") == F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    nth = F.when(F.col("conv_id").isNull(), 0).otherwise(F.col("own") + F.col("start") - 1)
    place = both.withColumn("place", nth.cast("int")).drop("c", "b", "start", "own", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["role", "text", "kind", "call_id", "name", "arguments"]).to_pylist():
                turn = {"role": r["role"]}
                if r["kind"] == "message":
                    turn["content"] = r["text"]
                elif r["kind"] == "call":
                    turn["tool_call"] = {"id": r["call_id"], "name": r["name"], "arguments": json.loads(r["arguments"])}
                else:
                    turn["tool_result"] = {"id": r["call_id"], "content": json.loads(r["arguments"])}
                out.append(canonical(turn))
            keep = ["conv_id", "turn", "place", "kind", "call_id", "valid", "state"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "json"])

    schema = "conv_id long, turn long, place int, kind string, call_id string, valid boolean, state string, json string"
    return place.mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """All turns of all conversations."""
    return linked(table(spark, sf_dir, "conversations"))
