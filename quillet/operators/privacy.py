"""Personal data in texts and conversations: spans, totals, anonymised copies."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import spans as S

_SPANS = "array<struct<type: string, start: int, end: int, score: double>>"


#: Characters of texts that stand as Python's strings at a time.
_CHARS = 1 << 20


def _found(texts: pa.Array, find: Callable[[str], list[S.Span]]) -> pa.Array:
    """The spans of an array of texts. Texts become strings a few at a time and spans become numbers at once, so
    memory follows the batch's bytes and not its spans."""
    names: dict[str, int] = {}
    ends, kinds, numbers, scores = array("i", [0]), array("i"), (array("i"), array("i")), array("d")
    sizes = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
    part = np.cumsum(np.asarray(sizes)) // _CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        for text in texts.slice(low, high - low).to_pylist():
            for s in find(text):
                kinds.append(names.setdefault(s.type, len(names)))
                numbers[0].append(s.start)
                numbers[1].append(s.end)
                scores.append(s.score)
            ends.append(len(kinds))
    types = pa.DictionaryArray.from_arrays(pa.array(np.array(kinds, dtype=np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
    fields = [types, *(pa.array(np.array(n, dtype=np.int32)) for n in numbers), pa.array(np.array(scores, dtype=np.float64))]
    return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.StructArray.from_arrays(fields, names=["type", "start", "end", "score"]))


def spans(text: Column, least: float = S.LEAST_SCORE, types: Iterable[str] = S.SENSITIVE, more: Iterable[Callable[[str], list[S.Span]]] = ()) -> Column:
    """The spans of a text as an array of type, start, end and score, in order and without overlaps; empty for null and
    empty texts. Positions count code points from 0. Patterns with check digits and context words do not
    fit into built-in functions, which give no positions; texts go to Python by Arrow, a batch at a time."""
    kinds, models = frozenset(types), tuple(more)

    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return _found(texts, lambda t: S.find(t, least, kinds, models))

    return found(text)


def anonymized(text: Column, found: Column) -> Column:
    """The text with each span replaced by its type in angle brackets, by built-in functions; null becomes empty. ``found``:
    spans in order, a column of the row."""
    whole = F.coalesce(text, F.lit(""))
    after = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
    pieces = F.transform(found, lambda s, i: F.concat(F.substring(whole, after(i) + 1, s["start"] - after(i)), F.lit("<"), s["type"], F.lit(">")))
    tail = F.substring(whole, F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0)) + 1, F.length(whole))
    return F.when(F.size(found) == 0, whole).otherwise(F.concat(F.array_join(pieces, ""), tail))


def anonymize(rows: DataFrame, text: str = "text", **options) -> DataFrame:
    """Adds ``pii`` (the spans) and replaces the text. Other columns are kept; a column ``pii`` is replaced."""
    return rows.withColumn("pii", spans(F.col(text), **options)).withColumn(text, anonymized(F.col(text), F.col("pii")))


def totals(found: DataFrame, spans_field: str = "pii") -> DataFrame:
    """One row: n, pii_count (rows with a span), pii_percentage and n_spans."""
    any_ = F.count_if(F.size(spans_field) > 0)
    n = F.count("*")
    return found.agg(n.alias("n"), any_.alias("pii_count"), F.when(n > 0, F.round(100 * any_ / n, 2)).otherwise(0.0).alias("pii_percentage"), F.coalesce(F.sum(F.size(spans_field)), F.lit(0)).cast("long").alias("n_spans"))


def by_type(found: DataFrame, spans_field: str = "pii") -> DataFrame:
    """type, n and n_rows: spans and rows with one, of each type."""
    each = found.select(F.explode(F.array_distinct(F.transform(spans_field, lambda s: s["type"]))).alias("type"), F.lit(0).alias("n"), F.lit(1).alias("n_rows"))
    each = each.unionByName(found.select(F.explode(spans_field).alias("s")).select(F.col("s.type").alias("type"), F.lit(1).alias("n"), F.lit(0).alias("n_rows")))
    return each.groupBy("type").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


#: The field that is anonymised where there are no messages, the first that the row has.
FIELDS = ("output", "text", "response", "content")


def anonymize_examples(rows: DataFrame, least: float = S.LEAST_SCORE, types: Iterable[str] = S.SENSITIVE, more: Iterable[Callable[[str], list[S.Span]]] = ()) -> DataFrame:
    """Examples of every shape, anonymised, and ``n_changed``: of a row with ``messages`` (an array of structs with a
    ``content``) each message on its own, every changed one counting; else the first of FIELDS that the row has.
    Null messages and contents, and rows with none of the fields, stay as they are."""
    kinds, models = frozenset(types), tuple(more)

    @F.pandas_udf("array<string>")
    def cleaned(texts: pd.Series) -> pd.Series:
        clean = lambda t: None if t is None else S.anonymized(t, S.find(t, least, kinds, models))
        return texts.map(lambda row: None if row is None else [clean(t) for t in row], na_action=None)

    out, chat = rows, "messages" in rows.columns
    present = [f for f in FIELDS if f in rows.columns]
    if chat:
        out = out.withColumn("new__", cleaned(F.transform("messages", lambda m: m["content"])))
        changed = F.size(F.filter(F.zip_with("messages", "new__", lambda m, c: m["content"] != c), lambda x: x))
        renewed = F.zip_with("messages", "new__", lambda m, c: F.when(m.isNotNull(), m.withField("content", c)))
        out = out.withColumn("n_changed", F.when(F.col("messages").isNotNull(), changed)).withColumn("messages", renewed).drop("new__")
    else:
        out = out.withColumn("n_changed", F.lit(None).cast("int"))
    if present:
        first = F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in present))
        named = F.when(F.col("messages").isNull(), first) if chat else first
        out = out.withColumn("field__", named).withColumn("new__", F.get(cleaned(F.array(F.coalesce(*(F.when(F.col("field__") == f, F.col(f)) for f in present)))), 0))
        same = F.coalesce(*(F.when(F.col("field__") == f, F.col(f) != F.col("new__")) for f in present))
        out = out.withColumn("n_changed", F.coalesce("n_changed", same.cast("int"), F.lit(0)))
        out = out.withColumns({f: F.when(F.col("field__") == f, F.col("new__")).otherwise(F.col(f)) for f in present}).drop("field__", "new__")
    return out.withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
