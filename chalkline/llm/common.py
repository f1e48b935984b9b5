"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* a table is a DataFrame of any width; an operator selects the few columns it
  names (``id_col``, ``text_col``, ...) under internal names first, so extra
  columns with clashing names never meet its own;
* a null text is an empty text; a null id is an ordinary value;
* intermediate tables are written as Parquet below ``spark.checkpoint.dir``
  (shared storage), which cuts the lineage: a lost executor repeats its own
  tasks, not the job.
"""

from __future__ import annotations

import ctypes
import string
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.session import scratch_path

SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again (a recovery point).

    The folder belongs to the run; it can be deleted once the run's result is stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The column that carries a row's number through a job.
ROW_NO = "__row_no"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written once: the numbers of a scan depend on how its files are split, which
    may change with the executors there are, so all who use a row's number read it from this table."""
    return saved(docs.withColumn(ROW_NO, F.monotonically_increasing_id()), "numbered-rows")


def row_number(row_no: str | None) -> Column:
    """The column ``row_no`` of a numbered table or, if None, a number that holds within one scan only."""
    return F.monotonically_increasing_id() if row_no is None else F.col(row_no)


def row_key(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """``docs`` with a 128-bit hash of some columns, under the name that is returned beside it: rows that are alike in
    them share it, in every scan, without a written copy of the texts."""
    name = ROW_NO
    while name in docs.columns:
        name += "_"
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    null = [F.col(f"`{c}`").isNull() for c in columns]
    return docs.withColumn(name, F.struct(F.xxhash64(*own, *null).alias("k1"),
                                          F.xxhash64(F.lit(1), *own, *null).alias("k2"))), name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


# --------------------------------------------------------------------------- Arrow batches as numpy
def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + n + 1] \
        if n else np.zeros(1, kind)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    return data[low:high], offsets.astype(np.int64) - low


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 2 << 20):
    """Cut a record batch into consecutive slices of at most ``most_bytes`` of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Jobs that run inside hand their Python workers at most ``rows`` rows at a time, where rows hold whole texts or
    blocks of documents: the JVM and the worker each hold one batch per task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def memory_back() -> None:
    """Give what this process has freed back to the system; a Python worker keeps it otherwise, for later stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_GAP = np.zeros(256, bool)
_GAP[list(SPACES)] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words ``[^\\x20\\x09-\\x0D]+``: byte bounds of every word, and
    ``first[d]:first[d + 1]`` are the words of row d. No word crosses two rows."""
    inside = ~_GAP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread, and one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class RollingHash:
    """Polynomial hashes modulo 2^64 of spans of a sequence, from prefix sums.

    ``base`` is odd, so it has an inverse and a span's hash doesn't depend on where
    it stands. Inputs are mixed first; results are mixed again.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.zeros(0, np.uint64)

    def _grown(self, n: int):
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            self._up, self._down = _powers(self.base, size), _powers(self.inverse, size)
        return self._up, self._down

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._grown(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self._grown(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start])


BYTES = RollingHash(0x9E3779B97F4A7C15)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    return BYTES.spans(BYTES.prefix(_BYTE_VALUES[data]), start, end) ^ mix((end - start).astype(np.uint64))
