"""Quality classifier: supervised subword embeddings.

A text's features are its hashed words and its hashed character n-grams (bytes,
3 to 5 long, without white space inside); each has a learned vector. A text is the
average of its features' vectors; a softmax over two classes follows. Vectors and
output weights are trained by stochastic gradient descent in numpy, one text a
step, on a bounded sample of labelled rows.

The network is linear in the average, so for scoring every feature's vector
shrinks to one number, its share of the logit. That table (``BUCKETS`` floats) is all
that the executors get, and scoring is one pass over the table without a shuffle.

The sample: of the labelled rows that are not held out, the ``SAMPLE_ROWS`` with the
smallest hash of their id, without texts over ``SAMPLE_CHARS`` characters. Labels
are never read for any other purpose, and lang, source and doc_id are no features.

Defined cases: a null or empty text has no features and gets the bias's score.
Labels that are null, or of ids that no document has, are ignored. Without any
label every score is 0.5. Repeated rows are scored each for itself; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import _GAP, slices, text_bytes, word_bounds, word_hashes

BUCKETS, DIM = 1 << 16, 16
GRAMS = (3, 4, 5)
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
EPOCHS, RATE, SEED = 8, 1.0, 7
KEEP_FROM = 0.7
_STEP = np.uint32(0x01000193)
#: Bytes of text whose features are held at a time.
SLICE_BYTES = 1 << 20


def features(column: pa.Array):
    """Yield (row, bucket) arrays of a string column's features: words, equal neighbours, then n-grams."""
    data, offsets = text_bytes(column)
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield row, (words >> np.uint64(48)).astype(np.int64) % BUCKETS
    same = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1]))
    yield row[same + 1], np.full(len(same), BUCKETS - 1)
    byte_row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gaps = np.concatenate([[0], np.cumsum(_GAP[data])])
    value = np.where(_GAP[data], 32, data).astype(np.uint32) + np.uint32(1)
    power, hashes = np.uint32(1), np.zeros(len(data), np.uint32)
    for j in range(max(GRAMS)):
        n = len(data) - j
        if n <= 0:
            return
        hashes = hashes[:n] + value[j:] * power
        power = np.uint32((int(power) * int(_STEP)) & 0xFFFFFFFF)
        if j + 1 in GRAMS:
            inside = gaps[j:n + j] - gaps[1:n + 1] if j > 1 else np.zeros(n, np.int64)
            at = np.flatnonzero((byte_row[:n] == byte_row[j:]) & (inside == 0))
            mixed = hashes[at] * np.uint32(0x9E3779B1 + 2 * j)
            yield byte_row[at], (mixed >> np.uint32(16)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """Share of the logit by feature, and the bias."""

    shares: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, n = np.zeros(len(column)), np.zeros(len(column))
        for row, bucket in features(column):
            total += np.bincount(row, self.shares[bucket], minlength=len(column))
            n += np.bincount(row, minlength=len(column))
        logit = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-logit))


def train(texts: list[str], labels: list[int]) -> Model:
    """Stochastic gradient descent on the softmax loss; class 1 is the one that is scored."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    bags = []
    for i in range(0, len(texts), 100):
        column = pa.array(texts[i:i + 100])
        rows, buckets = (np.concatenate(x) for x in zip(*features(column), strict=True))
        key, n = np.unique(rows * BUCKETS + buckets, return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(column) + 1) * BUCKETS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bags.append((key[a:b] % BUCKETS, (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, weight = bags[i]
            hidden = weight @ vectors[bucket]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            wrong = p / p.sum()
            wrong[labels[i]] -= 1
            back = wrong @ out
            out -= rate * np.outer(wrong, hidden)
            bias -= rate * 0.1 * wrong
            scale = 1 / float(np.sqrt((weight ** 2).sum()) + 1e-6) if len(weight) else 0.0
            vectors[bucket] -= (rate * scale) * np.outer(weight, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the bounded sample of labelled rows that are not held out."""
    known = (labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1))
             .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = (d.filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(known), "id")
            .select(F.xxhash64("id", "text").alias("at"), "text", "label").collect())
    rows.sort(key=lambda r: (r["at"], r["label"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))],
                                                 ["doc_id", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= keep_from).cast("int").alias("predicted"))
