"""Operator 13, removal of lines that an earlier document holds. Built-in functions only.

What is known of earlier lines is kept as sorted runs in levels: tables of 128-bit line hashes,
bucketed and sorted by hash, each with the document that holds the line first. A new batch of
documents is grouped by hash once; merge-anti-joins with the runs, which need no further shuffle
since all are bucketed alike, leave the hashes that no run knows, and these become a new run on
the lowest level. A level that has ``FANOUT`` runs is compacted into one run of the next, by a
merge join of its sorted runs, again without a shuffle. So a batch meets a number of runs that
grows with the logarithm of the number of batches.

A line stays where it is held first, so every hash has one holder. The runs' hashes go back to
their holders, and a line whose hash does not come back is dropped: a line that stands in a third
of all documents goes to one document only and makes no group of rows.
"""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.common import _delete, shared_dir, table

#: Lines with a key of fewer code points are never dropped.
MIN_CHARS = 10
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Batches that op13 cuts the table into, by ranges of doc_id.
BATCHES = 4

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]
_HOLDER = ["holder", "nameless"]


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_SPACE))


def _lower(bare: Column) -> Column:
    """A-Z in lower case. For plain ASCII ``lower`` does the same as ``translate``, and faster."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept``, holder, nameless and ``lines``. A document is known by its id; one without an id
    by a hash of its text, in ``nameless``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64(text))
    return docs.select(*kept, F.col("doc_id").alias("holder"), nameless.alias("nameless"), text.alias("text"), F.split(text, "\n").alias("lines"))


class LineRuns:
    """The levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folder = f"{shared_dir(spark)}/quillet/{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.folder)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"quillet_run_{uuid.uuid4().hex}"
        rows.select(*_KEY, *_HOLDER).write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        _delete(self.spark, f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> None:
        """Add a batch: of its lines those that no earlier batch holds, each with the smallest
        doc_id of the batch that holds it. Documents without an id come after those with one."""
        each = _lines(docs).select(*_HOLDER, F.explode("lines").alias("line")).select(*_HOLDER, _bare(F.col("line")).alias("bare")).select(*_HOLDER, _lower(F.col("bare")).alias("key"))
        each = each.where(F.length("key") >= MIN_CHARS).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_HOLDER)
        held = each.groupBy(*_KEY).agg(F.min("holder").alias("holder"), F.min("nameless").alias("nameless"))
        held = held.withColumn("nameless", F.when(F.col("holder").isNull(), F.col("nameless")))
        fresh = reduce(lambda left, run: left.join(run, _KEY, "left_anti"), self.runs(), held)
        self._place(self._write(fresh), 0)

    def _place(self, name: str, at: int) -> None:
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at].append(name)
        if len(self.levels[at]) >= self.fanout:
            full, self.levels[at] = self.levels[at], []
            self._place(self._write(reduce(_merged, map(self.spark.table, full))), at + 1)
            for old in full:
                self._drop(old)

    def held(self) -> DataFrame:
        """holder, nameless and ``own``: the first halves of the hashes that each document holds."""
        return reduce(DataFrame.unionByName, self.runs()).groupBy(*_HOLDER).agg(F.collect_list("h1").alias("own"))

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one; no hash stands in both."""
    either = lambda c: F.coalesce(F.col(f"one.{c}"), F.col(f"two.{c}")).alias(c)
    return one.alias("one").join(two.alias("two"), _KEY, "full").select(*_KEY, *map(either, _HOLDER))


def kept(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to documents that all have been added to ``runs``."""
    plain = docs.drop("n_lines", "n_dropped", "kept_text")
    own = runs.held().select(*(F.col(c).alias(f"{c}_of") for c in _HOLDER), "own")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in _HOLDER))
    joined = _lines(plain, F.struct("*").alias("row")).drop("lines").join(own, same, "left")
    hashed = F.transform(F.transform(F.transform("lines", _bare), _lower), lambda key: F.when(F.length(key) >= MIN_CHARS, F.xxhash64(key)))
    split = joined.select("row", "text", F.coalesce("own", F.array().cast("array<long>")).alias("own"), F.split("text", "\n").alias("lines"))
    split = split.withColumn("hashes", hashed)
    # the text's hashes that are not its own; most texts have none and stay as they are
    split = split.withColumn("gone", F.array_except(F.array_compact("hashes"), "own"))
    # hashes sorted with their places; in front of each that is gone stands a mark, at place -1
    marked = F.concat(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), F.transform("gone", lambda h: F.struct(h.alias("h"), F.lit(-1).alias("i"))))
    split = split.withColumn("marked", F.when(F.size("gone") > 0, F.array_sort(F.filter(marked, lambda x: x["h"].isNotNull()))))
    first = F.transform("marked", lambda x, k: F.when((k == 0) | (F.get("marked", k - 1)["h"] != x["h"]), k))
    split = split.withColumn("starts", F.array_compact(first))
    length = lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("marked")) - s
    places = F.flatten(F.transform("starts", lambda s, k: F.when(F.get("marked", s)["i"] == -1, F.slice("marked", s + 2, length(s, k) - 1)).otherwise(F.slice("marked", 1, 0))))
    split = split.withColumn("dropped", F.coalesce(F.transform(places, lambda x: x["i"]), F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    out = split.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), text.alias("kept_text"))
    return out.select("row.*", "n_lines", "n_dropped", "kept_text")


def remove_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Drop each line that a document with a smaller doc_id holds too.

    Lines are what ``\\n`` separates; they are equal if their keys are: the line without the six
    ASCII white-space characters at its ends and with A-Z in lower case. Lines with keys of fewer
    than ``MIN_CHARS`` code points stay. Adds n_lines (before dropping),
    n_dropped and kept_text (the lines left, joined by ``\\n``) to the columns of ``docs``; columns
    of these names are replaced. A line that one document holds several times is dropped in all
    places or in none. A null or empty text is one empty line. Rows of one doc_id count as one
    document, so repeated rows keep their lines; rows without a doc_id come after all others, equal
    texts of them being one document, in the order of a hash. An empty table gives no rows.

    The table is added in ``batches`` of about equal size by ranges of doc_id, smallest first.
    """
    runs = LineRuns(docs.sparkSession)
    edges = docs.stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(e) for e in edges})
    known, at = F.col("doc_id"), [None, *edges, None]
    for low, high in zip(at, at[1:]):
        above = F.lit(True) if low is None else known > low
        below = (known <= high) if high is not None else F.lit(True)
        last = known.isNull() if high is None else F.lit(False)
        runs.add(docs.where((above & below) | last))
    return kept(docs, runs)


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds."""
    docs = remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same on a few rows of (doc_id, text) with ids: for tests."""
    import hashlib

    def key(line: str) -> str:
        return line.strip(_SPACE).translate(str.maketrans(_UPPER, _LOWER))

    first: dict[str, int] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(doc_id, first.get(key(line), doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < MIN_CHARS or first[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out
