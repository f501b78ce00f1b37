"""What the operators of this subpackage share: tables, the shared folder, word hashes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: blank and the five control characters from tab to carriage return.
#: ``bytes.split()`` cuts at exactly these six bytes.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader so that any file system works. The Python
    workers get to know this package's folder, should it not be installed."""
    known = spark.sparkContext.environment
    if _ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), _ROOT]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder of this process, on a local master only: executors elsewhere would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="quillet-")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the cluster's own cleaning takes over
        pass


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached or local checkpoint the copy outlives any executor. Once it stands, the
    shuffle files it was made from are of no use and go; the folder itself goes when the
    driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillet/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with this share of the rows, or more, is hot; so there are 4096 hot keys at most.
_HOT_SHARE = 4096


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of ``rows``, nulls left out: 4096 at most, so they may be broadcast. Keys of under 1000
    rows are not hot."""
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("n__"))
    return written(counts.where(is_hot(F.col("n__"), rows.count())).select(key))


def is_hot(n: Column, total: int) -> Column:
    """Whether a key with ``n`` of ``total`` rows is hot."""
    return (n >= 1000) & (n * _HOT_SHARE >= total)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """A join with a ``right`` side whose keys are unique, inner or left. Rows of hot keys stay
    where they are and meet a broadcast of 4096 rows at most, and null keys meet nothing, so no
    key brings more than its small share of rows to one task. ``hot``: these keys, if known."""
    hot = hot_keys(left, key) if hot is None else hot
    few = F.broadcast(hot)
    known = F.broadcast(right.join(few, key, "left_semi"))
    filled = left.where(F.col(key).isNotNull())
    out = filled.join(few, key, "left_semi").join(known, key, how).unionByName(filled.join(few, key, "left_anti").join(right, key, how))
    if how == "inner":
        return out
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    return out.unionByName(left.where(F.col(key).isNull()).select("*", *more))


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order."""
    from xxhash import xxh3_64_intdigest

    words = data.split()
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` word hashes, from prefix sums of a polynomial
    with an odd base modulo 2**64, then mixed."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    if len(_POWERS.get("up", ())) < n:
        size = max(4096, 2 * n)
        _POWERS["up"] = _powers(_ODD, size)
        _POWERS["down"] = _powers(pow(_ODD, -1, 1 << 64), size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _POWERS["up"][:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _POWERS["down"][: n - k + 1] + np.uint64(k))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: spreads a sum's bits over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
