"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words of one document. A word is removed if a
window that covers it also starts, word for word, in a document with a smaller id.

Anchors. A difference cover D modulo v has, for every shift, two members that
differ by it. So if two documents share a window, at p in one and q in the other,
some d < v puts p + d and q + d both on positions that are in D modulo v. Hashing
spans of ``window - v + 1`` words at cover positions only (a fifth of all for
v = 31) therefore gives every shared window at least one anchor common to both
documents. Three steps, each one shuffle of hashes, none of pairs:

1. anchors that occur in two documents;
2. each common anchor is extended to the windows that contain it; a window's
   96-bit hash meets the same window of other documents and finds the smallest id;
3. the words that a removed window covers go.

Hot spans. Before each shuffle a map task reduces what it holds: of a span that
many documents share it sends on two rows (step 1) or that of its smallest id
(step 2), and settles the rest itself, so a passage in a third of all documents
is a few rows per map task. Settled rows are dealt by document.

Defined cases: a null or empty text has no words; a text shorter than a window
keeps all of them. Windows are judged on the input, not on what is left. A null id
is smaller than any other. Rows of one id are one document for the test of smaller
ids, and each gives its own row. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import RollingHash, mix, slices, text_bytes, word_bounds, word_hashes

WINDOW = 50
#: A difference cover and its period: every shift modulo 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Spans that a map task holds before it reduces and sends them.
HELD = 2_000_000
NULL_ID = -(1 << 63)

SPANS, AGAIN = RollingHash(0xD6E8FEB86659FD93), RollingHash(0xA0761D6478BD642F)


def covers_all_shifts(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Words:
    """The words of a slice of rows: hashes, row of each, position in its row, row lengths."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        start, end, self.first = word_bounds(data, offsets)
        self.values = word_hashes(data, start, end)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(start)) - self.first[self.row]
        self.prefix = SPANS.prefix(self.values)

    def anchors(self, window: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of the anchors."""
        size = window - period + 1
        n = self.n[self.row]
        index = np.flatnonzero(cover[self.at % period] & (self.at + size <= n) & (n >= window))
        return index, SPANS.spans(self.prefix, index, index + size).view(np.int64)

    def tagged(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.uint64) ^ mix(rows.astype(np.uint64) + np.uint64(1))

    def listed(self, rows: np.ndarray, hashes: np.ndarray, lists: pa.Array) -> np.ndarray:
        """Which (row, hash) are in the row's list."""
        lists = lists.cast(pa.list_(pa.int64()))
        sizes = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.values.to_numpy()[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        keep = valid[owner]
        return np.isin(self.tagged(rows, hashes), self.tagged(owner[keep], values[keep]))


def _grouped(columns: list[np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns and ids sorted by (columns, id), without repeats; the smallest and largest id of each row's group."""
    order = np.lexsort((ids, *columns[::-1]))
    columns, ids = [c[order] for c in columns], ids[order]
    if not len(ids):
        return columns, ids, ids, ids
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    keep = new.copy()
    keep[1:] |= ids[1:] != ids[:-1]
    columns, ids, new = [c[keep] for c in columns], ids[keep], new[keep]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(ids)))
    return columns, ids, np.repeat(ids[starts], sizes), np.repeat(ids[starts + sizes - 1], sizes)


SPAN_SCHEMA = "hash long, again int, id long, settled boolean"


def _sent(columns: list[np.ndarray], ids: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
    again = columns[1] if len(columns) > 1 else np.zeros(len(ids), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(again), pa.array(ids), pa.array(settled)],
                                      names=["hash", "again", "id", "settled"])


class _Held:
    """Spans of a map task, reduced and sent when enough are held."""

    def __init__(self, reduce):
        self.reduce, self.parts, self.n = reduce, [], 0

    def add(self, columns: list[np.ndarray], ids: np.ndarray):
        self.parts.append((columns, ids))
        self.n += len(ids)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self):
        if self.n:
            columns = [np.concatenate(c) for c in zip(*(c for c, _ in self.parts), strict=True)]
            ids = np.concatenate([i for _, i in self.parts])
            self.parts, self.n = [], 0
            yield from self.reduce(*_grouped(columns, ids))


def _reduce_anchors(columns, ids, least, most):
    """Settled: common to two of the task's documents. Of such an anchor, its two outer rows also go on."""
    common = least < most
    outer = ~common | (ids == least) | (ids == most)
    yield _sent([columns[0][common]], ids[common], np.ones(int(common.sum()), bool))
    yield _sent([columns[0][outer]], ids[outer], np.zeros(int(outer.sum()), bool))


def _reduce_windows(columns, ids, least, most):
    """Settled: the task has the window in a document with a smaller id. Only the smallest id goes on."""
    later = ids > least
    yield _sent([c[later] for c in columns], ids[later], np.ones(int(later.sum()), bool))
    yield _sent([c[~later] for c in columns], ids[~later], np.zeros(int((~later).sum()), bool))


def _met(choose):
    """A task over all rows of its spans: the (id, hash) that ``choose`` picks, and the settled ones."""
    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        hashes, again, ids, settled = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        columns, rest, least, most = _grouped([hashes[~settled], again[~settled]], ids[~settled])
        pick = choose(rest, least, most)
        out_id = np.concatenate([ids[settled], rest[pick]])
        out_hash = np.concatenate([hashes[settled], columns[0][pick]])
        for i in range(0, len(out_id), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(out_id[i:i + (1 << 18)]), pa.array(out_hash[i:i + (1 << 18)])],
                                             names=["id", "hash"])
    return run


def _marks(spans: DataFrame, choose) -> DataFrame:
    """(id, hashes): what ``choose`` picks of each span's rows, gathered by document."""
    dealt = spans.repartition(F.when(F.col("settled"), F.xxhash64("id")).otherwise(F.col("hash")))
    return (dealt.mapInArrow(_met(choose), "id long, hash long")
            .groupBy("id").agg(F.collect_set("hash").alias("hashes")))


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD,
                            cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text",
                            with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``: the kept words joined by one space), one
    row per input row."""
    if not covers_all_shifts(cover, period) or not period <= window:
        raise ValueError("cover must be a difference cover of a period no longer than the window")
    on = np.zeros(period, bool)
    on[list(cover)] = True
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def anchors(batches):
        held = _Held(_reduce_anchors)
        for batch in batches:
            for part in slices(batch, "text"):
                words, ids = _Words(part.column(1)), part.column(0).to_numpy()
                index, hashes = words.anchors(window, period, on)
                yield from held.add([hashes], ids[words.row[index]])
        yield from held.flush()

    def windows(batches):
        held = _Held(_reduce_windows)
        for batch in batches:
            for part in slices(batch, "text"):
                words, ids = _Words(part.column(1)), part.column(0).to_numpy()
                index, hashes = words.anchors(window, period, on)
                index = index[words.listed(words.row[index], hashes, part.column(2))]
                low = index - np.minimum(period - 1, words.at[index])
                high = np.minimum(index, words.first[words.row[index] + 1] - window)
                some = np.zeros(len(words.row) + 1, np.int64)
                np.add.at(some, low, 1)
                np.add.at(some, high + 1, -1)
                start = np.flatnonzero(np.cumsum(some[:-1]) > 0)
                again = AGAIN.spans(AGAIN.prefix(words.values), start, start + window)
                yield from held.add([SPANS.spans(words.prefix, start, start + window).view(np.int64),
                                     (again >> np.uint64(32)).astype(np.uint32).view(np.int32)], ids[words.row[start]])
        yield from held.flush()

    def kept(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = _Words(part.column(1))
                start = np.flatnonzero(words.at + window <= words.n[words.row])
                hashes = SPANS.spans(words.prefix, start, start + window)
                start = start[words.listed(words.row[start], hashes, part.column(2))]
                gone = np.zeros(len(words.row) + 1, np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed = np.bincount(words.row[gone], minlength=part.num_rows)
                texts = []
                for i, text in enumerate(part.column(1)):
                    own = text.as_py().encode().split()
                    if removed[i]:
                        own = [w for w, g in zip(own, gone[words.first[i]:words.first[i + 1]], strict=True) if not g]
                    texts.append(b" ".join(own))
                columns = [part.column(0), pa.array(words.n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                           pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    common = _marks(base.mapInArrow(anchors, SPAN_SCHEMA), lambda ids, least, most: least < most)
    repeated = _marks(base.join(common, "id").select("id", "text", "hashes").mapInArrow(windows, SPAN_SCHEMA),
                      lambda ids, least, most: ids > least)
    out = base.join(repeated, "id", "left").select("id", "text", "hashes").mapInArrow(kept, schema)
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), *names[1:])
