"""Vector code compression by product codebooks, assigned through value dictionaries.

Each component x of a vector becomes the integer floor(4096 * x); a vector is cut into equal consecutive parts, and
each part is coded as the number of its nearest codebook entry. Codebooks start as the parts of the vectors with the
smallest ids and are moved ``rounds`` times to the floor of their parts' means. All arithmetic is in integers, so the
result depends neither on how rows are dealt nor on the order of sums.

Dictionaries. A block of vectors keeps, for every dimension, the sorted list of its distinct integers, and of every
vector the places in these lists (two bytes each). To assign a block, the squared differences of every distinct integer
to all entries are tabulated once per dimension; the distance of a part is then a gather and an add per dimension. The
coded blocks are a written table, read once a round. A round sends one sum per entry and dimension, by task, to a
grouped aggregate; only entries x dimensions numbers meet at the driver.

``label_error`` needs the sum of a label at each of its rows. Labels may be hot or many: the sums of the
``HOT_LABELS`` most frequent ones are broadcast, all others are joined by a shuffle (in which no label is frequent).

Defined cases: vectors that are null, empty, or hold a null, NaN or infinite component are dropped; so are vectors
whose length is not that of the smallest kept id (which must be divisible by the number of parts: else ValueError).
Fewer kept vectors than entries make as many entries. A null id counts as the largest; rows that repeat an id are
rows of their own, smaller vectors first. An empty table gives an empty result. Integers of 2^27 and more in size are
computed as Python integers; an error that does not fit 64 bits raises.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block: at most 65,536, so that a place in a dictionary takes two bytes.
BLOCK = 8192
#: Integers from this size on are not computed in 64 bits.
WIDE = 1 << 27
HOT_LABELS = 100_000


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers: 64-bit integers, or Python ones if any is large."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < WIDE:
        return scaled.astype(np.int64)
    big = np.abs(values.astype(np.float64)) >= 2.0 ** 53
    return np.array([int(x) * scale if b else int(y) for x, y, b in
                     zip(values.astype(np.float64).ravel().tolist(), scaled.ravel().tolist(), big.ravel().tolist(),
                         strict=True)], object).reshape(values.shape)


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them)."""
    if column.dtype == object:
        values = sorted(set(column.tolist()))
        place = {v: i for i, v in enumerate(values)}
        return np.array(values, object), np.array([place[v] for v in column.tolist()], np.uint16)
    values, places = np.unique(column, return_inverse=True)
    return values, places.astype(np.uint16)


def _stored(values: np.ndarray) -> bytes:
    if values.dtype == object:
        return b"o" + ",".join(map(str, values.tolist())).encode()
    return b"i" + values.astype("<i4").tobytes()


def _loaded(data: bytes) -> np.ndarray:
    if data[:1] == b"o":
        return np.array([int(x) for x in data[1:].split(b",")], object)
    return np.frombuffer(data, "<i4", offset=1).astype(np.int64)


def tables(values: list[np.ndarray], entries: np.ndarray) -> list[np.ndarray]:
    """Per dimension of a part, the squared difference of every distinct integer (rows) to every entry (columns)."""
    return [(v[:, None] - entries[None, :, j]) ** 2 for j, v in enumerate(values)]


def assign(values: list[np.ndarray], places: np.ndarray, books: list[np.ndarray]):
    """Yield (part, nearest entry of every vector, its squared distance) from a block's dictionaries."""
    size = len(values) // len(books)
    for part, entries in enumerate(books):
        at = range(part * size, (part + 1) * size)
        wide = any(values[d].dtype == object for d in at) or entries.dtype == object
        total = np.zeros((places.shape[1], len(entries)), object if wide else np.int64)
        for d, table in zip(at, tables([values[d] for d in at], entries), strict=True):
            total += table[places[d]]
        best = total.argmin(axis=1)
        yield part, best, total[np.arange(len(best)), best]


def _book(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) >= WIDE for row in rows for x in row)
    return np.array(rows, object if wide else np.int64)


def _block(rows: DataFrame, dims: int):
    """Coded blocks of (vec_id, label, embedding)."""
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"ids array<{id_type}>, labels array<{label_type}>, dictionaries array<binary>, places binary"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(2)
                flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
                whole = integers(flat.reshape(part.num_rows, dims))
                coded = [dictionary(whole[:, d]) for d in range(dims)]
                one = [pa.array([0, part.num_rows], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one[0], part.column(0)), pa.ListArray.from_arrays(one[0], part.column(1)),
                     pa.array([[_stored(v) for v, _ in coded]], pa.list_(pa.binary())),
                     pa.array([np.stack([p for _, p in coded]).tobytes()], pa.binary())],
                    ["ids", "labels", "dictionaries", "places"])

    return rows.mapInArrow(run, schema)


def _blocks_of(batch: pa.RecordBatch):
    """(ids, labels, dictionaries, places) of each stored block."""
    for i in range(batch.num_rows):
        ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
        values = [_loaded(x) for x in batch.column(2)[i].as_py()]
        yield ids, labels, values, np.frombuffer(batch.column(3)[i].as_py(), np.uint16).reshape(len(values), len(ids))


def moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry moved to the floor of its parts' means; unused ones stay."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    size = books[0].shape[1]

    def sums(batches):
        own = sent.value
        total = np.zeros((len(own), len(own[0]), size), object)
        count = np.zeros((len(own), len(own[0])), np.int64)
        for batch in batches:
            for _, _, values, places in _blocks_of(batch):
                for part, best, _ in assign(values, places, own):
                    count[part] += np.bincount(best, minlength=len(own[0]))
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    for j in range(size):
                        d = part * size + j
                        total[part, used, j] += np.add.reduceat(values[d][places[d]][order], first)
        part, entry = np.nonzero(count)
        part, entry, place = np.repeat(part, size), np.repeat(entry, size), np.tile(np.arange(size), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
             pa.array([Decimal(int(x)) for x in total[part, entry, place]], pa.decimal128(38, 0)),
             pa.array(count[part, entry], pa.int64())], ["part", "entry", "place", "total", "n"])

    found = blocks.mapInArrow(sums, "part int, entry int, place int, total decimal(38,0), n long")
    out = [b.tolist() for b in books]
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    sent.unpersist()
    return [_book(b) for b in out]


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in books for row in book.tolist() for x in row)


def with_label_error(coded: DataFrame, hot_labels: int = HOT_LABELS) -> DataFrame:
    """``coded`` (a stored table with label and error) and the sum of the errors of equal labels."""
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "label-errors")

    def joined(rows: DataFrame, by: DataFrame, how: str) -> DataFrame:
        by = by.select(F.col("label").alias("__label"), "label_error", F.lit(True).alias("__met"))
        return rows.join(by, F.col("label").eqNullSafe(F.col("__label")), how)

    if sums.count() <= hot_labels:
        return joined(coded, F.broadcast(sums), "inner").drop("__label", "__met")
    hot = saved(sums.orderBy(F.desc("__n"), "label").limit(hot_labels), "hot-labels")
    met = joined(coded, F.broadcast(hot), "left")
    rest = met.filter("__met is null").select(*coded.columns)
    return (met.filter("__met").drop("__label", "__met")
            .unionByName(joined(rest, sums, "inner").drop("__label", "__met")))


def _clean(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256: one row per kept vector."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries must be in 1..256, parts at least 1")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("embedding")).filter(_clean(F.col("embedding")))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    dims = len(first[0]["embedding"]) if first else parts
    if dims % parts:
        raise ValueError(f"{dims} dimensions cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("embedding") == dims)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    start = integers(np.array([r["embedding"] for r in seeds], np.float64).reshape(-1, dims))
    size = dims // parts
    books = [_book(start[:, p * size:(p + 1) * size].tolist()) for p in range(parts)]
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"vec_id {id_type}, label {label_type}, code string, error long"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema + ", label_error long, codebooks_sha256 string").drop("label")
    blocks = saved(_block(rows, dims), "coded-blocks")
    for _ in range(rounds):
        books = moved(blocks, books)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def final(batches):
        for batch in batches:
            for ids, labels, values, places in _blocks_of(batch):
                codes = np.zeros((len(ids), len(sent.value)), np.uint8)
                error = np.zeros(len(ids), object)
                for part, best, distance in assign(values, places, sent.value):
                    codes[:, part] = best
                    error += distance
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error.tolist(), pa.int64())],
                    ["vec_id", "label", "code", "error"])

    coded = saved(blocks.mapInArrow(final, schema), "vector-codes")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error",
                                          F.lit(digest).alias("codebooks_sha256"))
