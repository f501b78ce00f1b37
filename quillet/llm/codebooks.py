"""Operator 12, compression of vectors to codes by heap Lloyd.

Vectors become whole numbers and are cut into parts; each part position has a codebook, which
rounds of Lloyd's algorithm improve. Vectors lie in blocks, a row of the table each, and a block
keeps, besides its vectors, what it knows: the entry of each part, and for each part position and
entry a heap of the parts there. Its key is the slack between the distances to the second nearest
and to the nearest entry when the part was last looked at, plus what the entries had drifted by
then. All that entries drift afterwards is one cumulative number for an entry, and only parts whose
key it has reached can have changed: these are popped, compared exactly with all entries, and
pushed again. The others are not touched.

Each round is a job over the blocks, whose result is written in the shared folder, so nothing is
lost with an executor; the table of the round before then goes. Sums of the parts of an entry are
kept by block and changed by what moved; the driver sees a sum and a count for each entry and
position, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import _delete, join_hot, shared_dir, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components in a block at most (but for a single longer vector).
BLOCK = 1 << 19
#: Bits of the pieces in which sums travel, so that none is too large for a long.
_PIECE = 62
#: Relative error allowed for in bounds, far above that of double precision.
_ERROR = 1e-9


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is not null and has finite components only: vec_id, label and ``v``."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", v.alias("v")).where(F.coalesce(finite, F.lit(False)))


def whole(x: float) -> int:
    """floor(4096 * x), also where the product is no finite double."""
    return math.floor(x * SCALE) if abs(x) < 2.0**40 else int(x) * SCALE


def _edges(dim: int) -> list[int]:
    """Where parts begin and end; the first ones are one longer where ``dim`` is no multiple of 8."""
    return [k * (dim // PARTS) + min(k, dim % PARTS) for k in range(PARTS + 1)]


def _blocks(dim: int):
    """Vectors into blocks: ids, labels and numbers as bytes, ``wide`` if as the doubles given."""
    step, most = max(1, BLOCK // max(1, dim)), math.sqrt(2.0**60 / max(1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False)
                wide = bool(len(x)) and float(np.abs(x).max()) * SCALE >= most
                data = x if wide else np.floor(x * SCALE).astype(np.int64)
                if not wide and len(x) and np.abs(data).max() < 2**15 - 1:
                    data = data.astype(np.int16)
                ends = np.array([0, len(part)], dtype=np.int32)
                listed = [pa.ListArray.from_arrays(ends, part.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([data.tobytes()]), pa.array([data.dtype.str]), pa.array([wide])], names=["vec_id", "label", "data", "kind", "wide"])

    return run


class Block:
    """The parts of one block, each with its entry, and the heaps."""

    def __init__(self, data: bytes, kind: str, n: int, dim: int, wide: bool) -> None:
        numbers = np.frombuffer(data, dtype=kind)
        if wide:  # Python's own numbers: no sum or square is too large
            numbers = np.array([whole(float(x)) if kind == "<f8" else int(x) for x in numbers], dtype=object)
        self.x = numbers.reshape(n, dim).astype(object if wide else np.int64)
        self.n, self.dim, self.edges, self.wide = n, dim, _edges(dim), wide
        self.entry = np.zeros((PARTS, n), dtype=np.uint8)
        self.sums: list[int] = []
        self.heaps: dict[tuple[int, int], list] = {}
        self.keys, self.places, self.sizes = np.empty(0), np.empty(0, dtype=np.int32), np.zeros((PARTS, ENTRIES), dtype=np.int32)

    def part(self, p: int, rows=slice(None)) -> np.ndarray:
        return self.x[rows, self.edges[p] : self.edges[p + 1]]

    def distances(self, p: int, rows, book: np.ndarray) -> np.ndarray:
        """Exact squared distances of parts to entries."""
        x = self.part(p, rows)
        out = np.empty((len(x), len(book)), dtype=self.x.dtype)
        for k, y in enumerate(book):
            out[:, k] = ((x - y) ** 2).sum(axis=1)
        return out

    def scan(self, p: int, rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each, the first of equally near ones, and the slack: how much nearer it is
        than any other, at least."""
        d = self.distances(p, rows, book)
        best = d.argmin(axis=1) if len(d) else np.empty(0, dtype=np.int64)
        if self.wide:
            return best, np.full(len(d), -np.inf)
        if len(book) == 1:
            return best, np.full(len(d), np.inf)
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
        return best, (two[:, 1] - two[:, 0]) - _ERROR * (1 + two.sum(axis=1))

    def start(self, books: list[np.ndarray]) -> None:
        """Every part is compared with all entries. A sorted list is a heap."""
        keys, places = [], []
        for p, book in enumerate(books):
            best, slack = self.scan(p, np.arange(self.n), book)
            self.entry[p] = best
            order = np.lexsort((slack, best))
            keys.append(slack[order])
            places.append(order.astype(np.int32))
            self.sizes[p] = np.bincount(best, minlength=ENTRIES)
            width = self.edges[p + 1] - self.edges[p]
            total = np.zeros((ENTRIES, width), dtype=self.x.dtype)
            np.add.at(total, best, self.part(p))
            self.sums += [int(v) for k in range(ENTRIES) for v in (self.sizes[p][k], *total[k])]
        self.keys, self.places = np.concatenate(keys), np.concatenate(places)

    def move(self, books: list[np.ndarray], drift: np.ndarray) -> None:
        """Only parts are compared whose key the drift has reached."""
        starts = np.concatenate([[0], np.cumsum(self.sizes.ravel())])
        at = 0  # of the part's sums
        for p, book in enumerate(books):
            heaps: dict[int, list] = {}

            def heap(k: int) -> list:
                if k not in heaps:
                    one, two = starts[p * ENTRIES + k], starts[p * ENTRIES + k + 1]
                    heaps[k] = list(zip(self.keys[one:two].tolist(), self.places[one:two].tolist()))
                return heaps[k]

            popped: list[int] = []
            for k in range(len(book)):
                first = starts[p * ENTRIES + k]
                if self.sizes[p, k] and self.keys[first] <= drift[p, k]:
                    while heap(k) and heap(k)[0][0] <= drift[p, k]:
                        popped.append(heapq.heappop(heap(k))[1])
            rows = np.array(popped, dtype=np.int64)
            best, slack = self.scan(p, rows, book)
            width = self.edges[p + 1] - self.edges[p] + 1
            for row, k, gap in zip(popped, best.tolist(), slack.tolist()):
                heapq.heappush(heap(k), (gap + drift[p, k], row))
                old = int(self.entry[p, row])
                if old != k:
                    for j, v in enumerate((1, *self.part(p, row).tolist())):
                        self.sums[at + old * width + j] -= v
                        self.sums[at + k * width + j] += v
                    self.entry[p, row] = k
            self.heaps |= {(p, k): h for k, h in heaps.items()}
            at += ENTRIES * width
        if self.heaps:
            keys, places = [], []
            for j in range(PARTS * ENTRIES):
                if (own := self.heaps.get(divmod(j, ENTRIES))) is None:
                    keys.append(self.keys[starts[j] : starts[j + 1]])
                    places.append(self.places[starts[j] : starts[j + 1]])
                else:
                    keys.append(np.array([x[0] for x in own]))
                    places.append(np.array([x[1] for x in own], dtype=np.int32))
                self.sizes[divmod(j, ENTRIES)] = len(keys[-1])
            self.keys, self.places, self.heaps = np.concatenate(keys), np.concatenate(places).astype(np.int32), {}

    def state(self) -> list:
        return [json.dumps(self.sums), self.entry.tobytes(), self.keys.tobytes(), self.places.tobytes(), self.sizes.tobytes()]

    def restore(self, sums: str, entry: bytes, keys: bytes, places: bytes, sizes: bytes) -> None:
        self.sums = json.loads(sums)
        self.entry = np.frombuffer(entry, dtype=np.uint8).reshape(PARTS, self.n).copy()
        self.keys, self.places = np.frombuffer(keys), np.frombuffer(places, dtype=np.int32)
        self.sizes = np.frombuffer(sizes, dtype=np.int32).reshape(PARTS, ENTRIES).copy()


_STATE = ["sums", "entry", "keys", "places", "sizes"]


def _assigned(block: dict, dim: int, books: list, drift: np.ndarray | None, wide: bool) -> Block:
    out = Block(block["data"], block["kind"], len(block["vec_id"]), dim, wide)
    arrays = [np.array(b, dtype=out.x.dtype).reshape(len(b), -1) for b in books]
    if drift is None:
        out.start(arrays)
    else:
        out.restore(*(block[c] for c in _STATE))
        out.move(arrays, drift)
    return out


def _round(dim: int, books: list, drift: np.ndarray | None, wide: bool):
    """A round: the blocks with their new state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                state = _assigned(row.to_pylist()[0], dim, books, drift, wide).state()
                kept = ["vec_id", "label", "data", "kind"]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), *(pa.array([s]) for s in state)], names=[*kept, *_STATE])

    return run


def _coded(dim: int, books: list, drift: np.ndarray | None, wide: bool):
    """The last assignment: vec_id, label, code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                block = _assigned(row.to_pylist()[0], dim, books, drift, wide)
                error = np.zeros(block.n, dtype=block.x.dtype)
                for p, book in enumerate(books):
                    near = np.array(book, dtype=block.x.dtype).reshape(len(book), -1)[block.entry[p]]
                    error = error + ((block.part(p) - near) ** 2).sum(axis=1)
                codes = [bytes(c).hex() for c in block.entry.T.tolist()]
                fits = [int(e) if e < 2**63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([row.column("vec_id").flatten(), row.column("label").flatten(), pa.array(codes, pa.string()), pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _pieces(total: int) -> list[tuple[int, int]]:
    """(place, piece) with total = sum of piece * 2**(62 * place)."""
    sign, total, out = (1 if total >= 0 else -1), abs(total), []
    while total or not out:
        out.append((len(out), sign * (total & ((1 << _PIECE) - 1))))
        total >>= _PIECE
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by slot."""
    total = None
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = json.loads(text)
            total = own if total is None else [a + b for a, b in zip(total, own)]
    rows = [(slot, place, piece) for slot, t in enumerate(total or []) for place, piece in _pieces(t)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], names=["slot", "place", "piece"])


class _Table:
    """Written tables of which only the last stays."""

    def __init__(self, spark) -> None:
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        import atexit

        path = f"{shared_dir(self.spark)}/quillet/{uuid.uuid4().hex}"
        atexit.register(_delete, self.spark, path)
        df.write.parquet(path)
        if self.path:
            _delete(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def _improved(blocks: DataFrame, books: list, dim: int) -> list:
    """Codebooks after an update; unused entries stay."""
    sums = blocks.select("sums").mapInArrow(_summed, "slot int, place int, piece long").groupBy("slot", "place").agg(F.sum(F.col("piece").cast("decimal(38,0)")).alias("s"))
    total: dict[int, int] = {}
    for r in sums.collect():  # a few for each slot: entries * (dimension + parts)
        total[r["slot"]] = total.get(r["slot"], 0) + (int(r["s"]) << (_PIECE * r["place"]))
    out, slot, edges = [], 0, _edges(dim)
    for p, book in enumerate(books):
        width, new = edges[p + 1] - edges[p], []
        for k in range(ENTRIES):
            n = total.get(slot, 0)
            if k < len(book):
                new.append([total[slot + 1 + j] // n for j in range(width)] if n else book[k])
            slot += width + 1
        out.append(new)
    return out


def _drifts(before: list, after: list, wide: bool) -> np.ndarray:
    """For each entry: how far it has moved, and the farthest other one."""
    out = np.zeros((PARTS, ENTRIES))
    for p, (one, two) in enumerate(zip(before, after)):
        moved = [0.0 if wide else math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + _ERROR) for x, y in zip(one, two)]
        for k in range(len(moved)):
            out[p, k] = moved[k] + max((m for j, m in enumerate(moved) if j != k), default=0.0)
    return out


def _compressed(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors of one dimension: vec_id, label, code, error and codebooks_sha256."""
    spark = rows.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    first = [[whole(x) for x in r["v"]] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    edges = _edges(dim)
    books = [[v[edges[p] : edges[p + 1]] for v in first] for p in range(PARTS)]
    kept, columns = _Table(spark), f"vec_id array<long>, label array<{kind}>, data binary, kind string"
    blocks = kept.put(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v").mapInArrow(_blocks(dim), f"{columns}, wide boolean"))
    wide = bool(blocks.agg(F.max("wide")).first()[0])
    state, drift, total = ", sums string, entry binary, keys binary, places binary, sizes binary", None, np.zeros((PARTS, ENTRIES))
    for _ in range(ROUNDS):
        blocks = kept.put(blocks.mapInArrow(_round(dim, books, drift, wide), columns + state))
        better = _improved(blocks, books, dim)
        total = total + _drifts(books, better, wide)
        books, drift = better, total
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    coded = kept.put(blocks.mapInArrow(_coded(dim, books, drift, wide), f"vec_id long, label {kind}, code string, error long"))
    return coded.withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest()))


def compress(rows: DataFrame) -> DataFrame:
    """Codes of the vectors of ``rows`` (vec_id, embedding, label; other columns are ignored).

    Components become floor(4096 * x), vectors are cut into 8 parts, and each part position has a
    codebook of 16 entries, at first the parts of the 16 smallest vec_ids, improved in 6 rounds by
    means rounded down. Returns vec_id, label, code (entries in part order, two hexadecimal digits
    each), error (squared distances to the entries), label_error (the sum over equal labels, nulls
    together) and codebooks_sha256. All arithmetic that decides is in whole numbers, of any size.

    Vectors that are null or hold null or infinite components or NaN are dropped. Ids may be null
    (they come last) or repeated (ordered by vector); each row has its code. With fewer than 16
    rows there are as many entries as rows; equal entries are kept, and the first one is used.
    Where the dimension is no multiple of 8 the first parts are one longer, and parts without
    components have entry 0. Vectors of different dimensions are compressed apart, with codebooks
    of their own. An error or a sum that is too large for a long is null. An empty table gives no
    rows.
    """
    kept = usable(rows)
    dims = sorted(r["d"] for r in kept.select(F.size("v").alias("d")).distinct().collect())  # the dimensions in use
    kind = rows.schema["label"].dataType.simpleString()
    coded = kept.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")
    for d in dims:
        coded = coded.unionByName(_compressed(kept.where(F.size("v") == d), d))
    key = F.concat(F.when(F.col("label").isNull(), "-").otherwise("="), F.coalesce(F.col("label").cast("string"), F.lit("")))
    coded = coded.withColumn("label_key", key)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = written(coded.groupBy("label_key").agg(F.when(F.count("error") == F.count("*"), total).try_cast("long").alias("label_error")))
    return join_hot(coded, sums, "label_key").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    """The codes of all vectors."""
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def brute_force(vectors: list[tuple]) -> list[tuple]:
    """The same on a few (vec_id, components, label) of one dimension, by plain Lloyd: for tests."""
    kept = [(i, [whole(x) for x in v], label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dim = len(kept[0][1])
    edges = _edges(dim)
    parts = [[v[edges[p] : edges[p + 1]] for p in range(PARTS)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, vectors[r][1]))[:ENTRIES]
    books = [[parts[r][p] for r in order] for p in range(PARTS)]

    def nearest(x: list, book: list) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(ROUNDS):
        chosen = [[nearest(row[p], books[p])[1] for p in range(PARTS)] for row in parts]
        for p in range(PARTS):
            for k in range(len(books[p])):
                own = [row[p] for row, c in zip(parts, chosen) if c[p] == k]
                if own:
                    books[p][k] = [sum(column) // len(own) for column in zip(*own)]
    last = [[nearest(row[p], books[p]) for p in range(PARTS)] for row in parts]
    errors = [sum(d for d, _ in row) for row in last]
    by_label: dict = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    fits = lambda e: e if e < 2**63 else None
    return [(i, label, bytes(k for _, k in row).hex(), fits(e), fits(by_label[label]) if all(map(fits, [e])) or e == 0 else None, sha) for (i, _, label), row, e in zip(kept, last, errors)]
