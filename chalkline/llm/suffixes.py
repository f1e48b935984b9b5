"""Substring dedup with a logarithmic family of suffix arrays.

A string is ``length`` bytes of one text. A byte goes if a string that covers it also starts, byte for
byte, in a document with a smaller id.

Batches. Texts are dealt into batches of about ``batch_bytes`` (by id and text). A batch gets a sampled
suffix array: the suffixes that start at the minimizers of all windows of ``length`` bytes, so two equal
strings start their first ``head`` bytes (24 of 50) at the same place; sorted by their first eight bytes,
then by a hash of the whole head.

Family. Arrays of equal size merge ``fan`` at a time into one of the next size, until one is left, so an
entry is merged once per level and the levels grow with the logarithm of the corpus. The schedule runs for
all batches at once: a round is one shuffle, and a task merge-scans one class of heads (classes grow with
the level, so a task's share stays the same). Three families, each on what the one before has left:

1. heads that start in two documents (the others go no further);
2. of these, the bytes that the strings around the head cover: where they are equal to those of a smaller id, all
   these strings are settled at once; a head that has only one such surrounding is done;
3. what is left in two halves, the longer core that a half's strings have in common taking the head's place;
4. single strings at what is left, most of them at the ends of copies; their smallest id decides.

Hot strings. Before it sends, every merge reduces what it holds: of a head, a surrounding or a string that many
documents share it sends the smallest id (and, of heads, one more) and settles the rest at once, so a
passage in a third of all documents is a few entries per batch. A head with many surroundings hands them on
to the next family, where they part.

A settled entry is a mark (id, occurrence of the id, position) that goes back to its batch; the last step
covers the marks' ranges. Strings are equal if 80 bits of hashes are, surroundings of one head if 64 are.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` keeps all of them. A null id
is smaller than any other (ids are integers above -2^63). Rows of one id are one document for the test of
smaller ids, and each gives its own row. An empty table gives an empty result. A task needs about 80 bytes
of memory per byte of its longest text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import RollingHash, mix, text_bytes

LENGTH, HEAD = 50, 24
BATCH_BYTES, FAN = 16 << 20, 64
#: Bytes of text hashed at a time, and entries of one class that a merge should meet.
SLICE_BYTES, CLASS_ROWS = 1 << 20, 500_000
#: Entries that a batch holds before it reduces and sends them.
HELD = 1_500_000
#: Surroundings of one head in a merge from which they part.
MANY = 64
NULL_ID = -(1 << 63)

HASH, AGAIN = RollingHash(0xC2B2AE3D27D4EB4F), RollingHash(0x9FB21C651E98DF25)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))

#: Fields of an entry: sort keys, document, batch, occurrence of the id in the batch (-1: marked already), position.
HEADS = (("k1", np.uint32), ("k2", np.uint64), ("id", np.int64), ("batch", np.int32), ("occ", np.int32))
AROUND = (("k1", np.uint64), ("k2", np.uint64), *HEADS[2:], ("pos", np.int32))
STRINGS = (("k1", np.uint64), ("k2", np.uint16), *HEADS[2:], ("pos", np.int32))
MARKS = (("id", np.int64), ("occ", np.int32), ("pos", np.int32), ("kind", np.int8))
#: Kinds of marks. The position is a tag of the head's hash, a head's place, twice that and 1 for its right half, a start.
HEAD_SHARED, SETTLED, LOOK, HALF_SETTLED, HALF_LOOK, REPEATED = range(6)
TAG = (1 << 20) - 1

ROWS = "node long, part long, data binary"
#: Node of a row that holds marks; its part is the batch they go to.
TO_BATCH = -1


# --------------------------------------------------------------------------- arrays as bytes
def packed(columns: dict[str, np.ndarray], fields) -> bytes:
    """Columns as compressed byte planes: sorted keys and small numbers take few bytes."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(columns[name], kind).view(np.uint8)
                                   .reshape(len(columns[name]), -1).T).tobytes() for name, kind in fields]
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blobs: list[bytes], fields) -> dict[str, np.ndarray]:
    parts = {name: [] for name, _ in fields}
    width = sum(np.dtype(kind).itemsize for _, kind in fields)
    for blob in blobs:
        size = int.from_bytes(blob[:8], "little")
        raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        n, at = size // width, 0
        for name, kind in fields:
            w = np.dtype(kind).itemsize
            parts[name].append(np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).view(kind).ravel())
            at += n * w
    return {name: np.concatenate(parts[name]) if parts[name] else np.zeros(0, kind) for name, kind in fields}


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    node, group, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"node": pa.array(node, pa.int64()), "part": pa.array(group, pa.int64()),
                     "data": pa.array(data, pa.binary())})


def _take(e: dict, index: np.ndarray) -> dict:
    return {k: v[index] for k, v in e.items()}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the (sorted) keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _outer(new: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last value of each row's group."""
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(new)))
    return np.repeat(values[first], sizes), np.repeat(values[first + sizes - 1], sizes)


# --------------------------------------------------------------------------- merge scans
def reduce_heads(e: dict, last: bool) -> tuple[dict, list]:
    """Heads that two documents have are marked; of them the smallest and the largest id go on."""
    least, most = _outer(_starts(e["k1"], e["k2"]), e["id"])
    shared = least < most
    marks = [(HEAD_SHARED, np.flatnonzero(shared & (e["occ"] >= 0)))]
    new = _starts(e["k1"], e["k2"], e["id"])
    keep = (~shared | (new & ((e["id"] == least) | (e["id"] == most)))) & (not last)
    out = _take(e, np.flatnonzero(keep))
    out["occ"] = np.where(shared[keep], -1, out["occ"]).astype(np.int32)
    return out, marks


def reduce_around(settle: int, look_at: int, many: int):
    """k1 is the core, k2 what surrounds it. Larger ids of one surrounding are settled; where a core has several, they
    are looked at in more detail (at the end of the family, or at once if there are many)."""
    def reduce(e: dict, last: bool) -> tuple[dict, list]:
        core, around = _starts(e["k1"]), _starts(e["k1"], e["k2"])
        least, _ = _outer(around, e["id"])
        settled, open_ = e["id"] > least, e["occ"] >= 0
        number = np.cumsum(core) - 1
        several = np.bincount(number[around])[number]
        look = ~settled & (several > (1 if last else many))
        marks = [(settle, np.flatnonzero(settled & open_)), (look_at, np.flatnonzero(look & open_))]
        order = np.cumsum(around) - 1
        nth = order - order[np.flatnonzero(core)][number]
        keep = ~settled & (~look | (around & (nth < 2))) & (not last)
        out = _take(e, np.flatnonzero(keep))
        out["occ"] = np.where(look[keep], -1, out["occ"]).astype(np.int32)
        return out, marks
    return reduce


def reduce_strings(e: dict, last: bool) -> tuple[dict, list]:
    """Larger ids of one string are marked; the smallest goes on."""
    least, _ = _outer(_starts(e["k1"], e["k2"]), e["id"])
    later = e["id"] > least
    return _take(e, np.flatnonzero(~later & (not last))), [(REPEATED, np.flatnonzero(later))]


class Family:
    """The levels of a family: its entries' fields, how a merge reduces them, and classes (by the hash ``by``) at each
    level. All families of a job have the same batches, ``fan`` and so the same levels."""

    def __init__(self, fields, reduce, by: str, batches: int, fan: int, class_rows: int, batch_rows: int):
        self.fields, self.reduce, self.by, self.fan, self.rounds = fields, reduce, by, fan, 1
        batches = max(1, batches)
        while fan ** self.rounds < batches:
            self.rounds += 1
        share = max(1, -(-batch_rows // class_rows))
        self.classes = [1] + [share * min(batches, fan ** r) for r in range(1, self.rounds + 1)]

    def scan(self, e: dict, node: int, level: int) -> list[tuple[int, int, bytes]]:
        """Merge-scan of the entries that have come together in ``node`` at ``level``: what is left goes to its classes
        of the level above, marks go to their batches."""
        e = _take(e, np.lexsort([e[k] for k in ("pos", "occ", "id", "k2", "k1") if k in e]))
        kept, found = self.reduce(e, level == self.rounds)
        rows = []
        for kind, index in found:
            m = _take({k: e[k] for k in ("batch", "id", "occ")}, index)
            m["pos"] = e["pos"][index] if "pos" in e else (e["k2"][index] & np.uint64(TAG)).astype(np.int32)
            m = _take(m, np.lexsort((m["pos"], m["occ"], m["id"], m["batch"])))
            m["kind"] = np.full(len(index), kind, np.int8)
            cuts = np.append(np.flatnonzero(_starts(m["batch"])), len(index)) if len(index) else []
            rows += [(TO_BATCH, int(m["batch"][a]), packed({k: m[k][a:b] for k, _ in MARKS}, MARKS))
                     for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(kept["id"]):
            group = (mix(kept[self.by].astype(np.uint64)) % np.uint64(self.classes[level + 1])).astype(np.int64)
            order = np.argsort(group, kind="stable")
            kept, group = _take(kept, order), group[order]
            cuts = np.append(np.flatnonzero(_starts(group)), len(group))
            rows += [(node // self.fan, int(group[a]), packed({k: v[a:b] for k, v in kept.items()}, self.fields))
                     for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return rows

    def merge(self, sent: DataFrame) -> DataFrame:
        """All levels from the rows that the batches send; only marks are left."""
        def scans(level: int):
            def run(key, rows):
                node, group = key[0].as_py(), key[1].as_py()
                blobs = rows.column("data").to_pylist()
                if node == TO_BATCH:
                    return _table([(node, group, b) for b in blobs])
                return _table(self.scan(unpacked(blobs, self.fields), node, level))
            return run

        for level in range(1, self.rounds + 1):
            sent = sent.groupBy("node", "part").applyInArrow(scans(level), ROWS)
        return sent


# --------------------------------------------------------------------------- batches
class Batch:
    """The rows of a batch in order of id and text, whatever order they came in."""

    def __init__(self, rows: pa.Table):
        own = []
        for ids, sizes, text, size in zip(*(rows.column(c).to_pylist() for c in ("ids", "sizes", "text", "size")),
                                          strict=True):
            text = pa.decompress(text, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
            ends = np.cumsum(np.frombuffer(sizes, np.int64))
            own += [(i, text[b - s:b]) for i, s, b in zip(np.frombuffer(ids, np.int64).tolist(),
                                                       np.frombuffer(sizes, np.int64).tolist(), ends.tolist(),
                                                       strict=True)]
        own.sort()
        self.ids = np.array([i for i, _ in own], np.int64)
        self.texts = [t for _, t in own]
        new = _starts(self.ids) if own else np.zeros(0, bool)
        self.occ = (np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1] if own else np.zeros(0)
                    ).astype(np.int32)

    def slices(self):
        """(first row, bytes, offsets) of consecutive rows of about SLICE_BYTES."""
        start, total = 0, 0
        for i in range(len(self.texts) + 1):
            size = len(self.texts[i]) if i < len(self.texts) else 0
            if i > start and (i == len(self.texts) or total + size > SLICE_BYTES):
                part = self.texts[start:i]
                yield (start, np.frombuffer(b"".join(part), np.uint8),
                       np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64))
                start, total = i, 0
            total += size

    def marked(self, blobs: list[bytes], *kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, kind) of the marks of some kinds, sorted by row and position, without repeats."""
        m = unpacked(blobs, MARKS)
        m = _take(m, np.flatnonzero(np.isin(m["kind"], kinds)))
        row = np.searchsorted(self.ids, m["id"]) + m["occ"]
        order = np.lexsort((m["kind"], m["pos"], row))
        row, pos, kind = row[order], m["pos"][order].astype(np.int64), m["kind"][order]
        keep = _starts(row, pos, kind) if len(row) else np.zeros(0, bool)
        return row[keep], pos[keep], kind[keep]

    def entries(self, batch: int, rows: np.ndarray, **columns: np.ndarray) -> dict:
        return {"id": self.ids[rows], "batch": np.full(len(rows), batch, np.int32), "occ": self.occ[rows], **columns}


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    size = 1
    out = a
    while 2 * size <= width:
        out, size = op(out[:-size], out[size:]), 2 * size
    return op(out[:len(out) - (width - size)], out[width - size:]) if size < width else out


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """``n`` (a power of two, at most 8) bytes from every place on, as a number that sorts like them."""
    out, size = data.astype(np.uint64), 1
    while size < n:
        out, size = out[:-size] << np.uint64(8 * size) | out[size:], 2 * size
    return out


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, head: int):
    """(row, index) of the minimizers of all windows of ``length`` bytes within a row, by a hash of eight bytes that
    the first ``length - head + 1`` places of a window are compared by; the hashes of all places, and each window's
    least one (0: not a window)."""
    n, width = len(data), length - head + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    order = (_grams(data, 8) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)[:n - head + 1]
    order |= np.uint32(1)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    least = _slide(order, width, np.minimum)
    least[row[:n - length + 1] != row[length - 1:]] = 0
    edge = np.zeros(width - 1, np.uint32)
    index = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == order)
    return row[index].astype(np.int64), index, order, least


class _Sent:
    """Entries of a batch, reduced and sent when there are many."""

    def __init__(self, family: Family, batch: int):
        self.family, self.batch, self.parts, self.rows, self.n = family, batch, [], [], 0

    def add(self, entries: dict) -> None:
        self.parts.append(entries)
        self.n += len(entries["id"])
        if self.n >= HELD:
            self.flush()

    def flush(self) -> None:
        if self.n:
            e = {k: np.concatenate([p[k] for p in self.parts]).astype(t, copy=False) for k, t in self.family.fields}
            self.parts, self.n = [], 0
            self.rows += self.family.scan(e, self.batch, 0)

    def table(self) -> pa.Table:
        self.flush()
        return _table(self.rows)


def _compressed(texts: list[bytes]) -> bytes:
    raw = b"".join(texts)
    return pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True) if raw else b""


BATCHES = "batch long, ids binary, sizes binary, text binary, size long"


def batches(docs: DataFrame, n: int, held_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ``n`` batches; a row of the result is a map task's share of a batch, compressed."""
    def deal(rows):
        held, total = {}, 0

        def send():
            out = []
            for batch, (ids, sizes, texts) in sorted(held.items()):
                out.append((batch, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(),
                            _compressed(texts), sum(sizes)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                     (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
                    ["batch", "ids", "sizes", "text", "size"])

        for part in rows:
            ids = part.column(0).to_numpy()
            data, offsets = text_bytes(part.column(1))
            data = data.tobytes()
            for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b]
                own = held.setdefault(zlib.crc32(text, zlib.crc32(i.to_bytes(8, "little", signed=True))) % n, ([], [], []))
                own[0].append(i), own[1].append(len(text)), own[2].append(text)
                total += len(text) + 64
                if total >= held_bytes:
                    yield from send()
                    held, total = {}, 0
        yield from send()

    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(deal, BATCHES)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, head: int = HEAD, batch_bytes: int = BATCH_BYTES,
                            fan: int = FAN, class_rows: int = CLASS_ROWS, many: int = MANY, id_col: str = "doc_id",
                            text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``: the remaining bytes), one row per input row.

    The size of the texts, one number, sets how many batches, levels and classes there are; the result is the same
    for any.
    """
    if not 8 <= head <= length or fan < 2:
        raise ValueError("head must be in 8..length, fan at least 2")
    before = length - head
    half = (before + 1) // 2  # starts of the left half's strings
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))).first()[0] or 0
    sizes = -(-total // batch_bytes), fan, class_rows, int(batch_bytes * 2 / (before + 2)) + 1
    by_head = Family(HEADS, reduce_heads, "k2", *sizes)
    by_around = Family(AROUND, reduce_around(SETTLED, LOOK, many), "k1", *sizes)
    by_half = Family(AROUND, reduce_around(HALF_SETTLED, HALF_LOOK, many), "k1", *sizes)
    by_string = Family(STRINGS, reduce_strings, "k1", *sizes)
    bits = np.uint64(max(0, 64 - 10 - max(20, int(total * 2 // (before + 2)).bit_length())))
    base = batches(docs, sizes[0] or 1, batch_bytes, id_col, text_col)

    def starts(at, side, low, high):
        """First and last start (of a string within low..high) of the strings that hold a head at ``at``; side: 0 for the
        left half of them, 1 for the right one, None for all."""
        first = at - before + (0 if side is None else half * side)
        last = at if side is None else np.where(side == 1, at, at - before + half - 1)
        return np.maximum(first, low), np.minimum(last, high - length)

    def heads(key, rows):
        batch, sent = Batch(rows), _Sent(by_head, key[0].as_py())
        for first, data, offsets in batch.slices():
            row, index, _, _ = sampled(data, offsets, length, head)
            prefix = HASH.prefix(_VALUES[data])
            sent.add(batch.entries(sent.batch, first + row, k1=_grams(data, 4)[index] if len(index) else index,
                                   k2=HASH.spans(prefix, index, index + head) >> bits))
        return sent.table()

    def around(key, rows, marks):
        batch, sent = Batch(rows), _Sent(by_around, key[0].as_py())
        marked, tag, _ = batch.marked(marks.column("data").to_pylist(), HEAD_SHARED)
        marked = marked << 20 | tag
        for first, data, offsets in batch.slices():
            row, index, _, _ = sampled(data, offsets, length, head)
            prefix = HASH.prefix(_VALUES[data])
            hashes = HASH.spans(prefix, index, index + head)
            a, b = np.searchsorted(marked, (first << 20, (first + len(offsets) - 1) << 20))
            shared = np.isin((first + row) << 20 | (hashes >> bits & np.uint64(TAG)).astype(np.int64), marked[a:b])
            row, index = row[shared], index[shared]
            low, high = np.maximum(index - before, offsets[row]), np.minimum(index + length, offsets[row + 1])
            sent.add(batch.entries(sent.batch, first + row, pos=index - offsets[row], k1=hashes[shared],
                                   k2=HASH.spans(prefix, low, high) ^ mix((index - low).astype(np.uint64))))
        return sent.table()

    def again(batch, sent, blobs, settled, look):
        """The positions to look at; settled ones go back to the batch as they are."""
        row, pos, kind = batch.marked(blobs, *settled, look)
        done = kind != look
        if done.any():
            m = {"id": batch.ids[row[done]], "occ": batch.occ[row[done]], "pos": pos[done], "kind": kind[done]}
            sent.rows.append((TO_BATCH, sent.batch, packed(m, MARKS)))
        return row[~done], pos[~done]

    def halves(key, rows, marks):
        batch, sent = Batch(rows), _Sent(by_half, key[0].as_py())
        row, pos = again(batch, sent, marks.column("data").to_pylist(), (SETTLED,), LOOK)
        for first, data, offsets in batch.slices():
            a, b = np.searchsorted(row, (first, first + len(offsets) - 1))
            if a == b:
                continue
            own = np.repeat(row[a:b] - first, 2)
            at, side = offsets[own] + np.repeat(pos[a:b], 2), np.tile([0, 1], b - a)
            low, high = starts(at, side, offsets[own], offsets[own + 1])
            some = low <= high
            own, at, side, low, high = own[some], at[some], side[some], low[some], high[some]
            prefix = HASH.prefix(_VALUES[data])
            core = HASH.spans(prefix, np.where(side == 1, at, at - before + half - 1),
                              np.where(side == 1, at - before + half + length, at + head))
            sent.add(batch.entries(
                sent.batch, first + own, pos=2 * (at - offsets[own]) + side, k1=core ^ mix(side.astype(np.uint64)),
                k2=HASH.spans(prefix, low, high + length) ^ mix((at - low).astype(np.uint64))))
        return sent.table()

    def strings(key, rows, marks):
        batch, sent = Batch(rows), _Sent(by_string, key[0].as_py())
        row, pos = again(batch, sent, marks.column("data").to_pylist(), (SETTLED, HALF_SETTLED), HALF_LOOK)
        for first, data, offsets in batch.slices():
            a, b = np.searchsorted(row, (first, first + len(offsets) - 1))
            if a == b:
                continue
            _, _, order, least = sampled(data, offsets, length, head)
            own = row[a:b] - first
            at, side = offsets[own] + pos[a:b] // 2, pos[a:b] % 2
            low, high = starts(at, side, offsets[own], offsets[own + 1])
            n = high - low + 1
            start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = np.unique(start[least[start] == order[np.repeat(at, n)]])  # a string belongs to its minimizers
            own = np.searchsorted(offsets, start, "right") - 1
            values = _VALUES[data]
            sent.add(batch.entries(
                sent.batch, first + own, pos=start - offsets[own],
                k1=HASH.spans(HASH.prefix(values), start, start + length),
                k2=AGAIN.spans(AGAIN.prefix(values), start, start + length) >> np.uint64(48)))
        return sent.table()

    def kept(key, rows, marks):
        batch = Batch(rows)
        row, pos, kind = batch.marked(marks.column("data").to_pylist(), SETTLED, HALF_SETTLED, REPEATED)
        sizes = np.array([len(t) for t in batch.texts], np.int64)
        low, high = pos.copy(), pos.copy()
        for which, at, side in ((SETTLED, pos, None), (HALF_SETTLED, pos // 2, pos % 2)):
            is_ = kind == which
            low[is_], high[is_] = (x[is_] for x in starts(at, side, 0, sizes[row]))
        high += length
        cut = np.searchsorted(row, np.arange(len(sizes) + 1))
        removed, spans, left = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
        for i, text in enumerate(batch.texts):
            a, b = cut[i], cut[i + 1]
            if a < b:
                gone = np.zeros(len(text) + 1, np.int64)
                np.add.at(gone, low[a:b], 1)
                np.add.at(gone, high[a:b], -1)
                out = np.cumsum(gone[:-1]) > 0
                removed[i] = out.sum()
                spans[i] = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                text = np.frombuffer(text, np.uint8)[~out].tobytes()
            left.append(text)
        columns = {"id": batch.ids, "n_bytes": sizes, "n_removed": removed, "n_spans": spans,
                   "kept_sha256": [hashlib.sha256(t).hexdigest() for t in left]}
        if with_text:
            columns["kept"] = pa.array(left, pa.binary())
        out = pa.table(columns)
        return out.set_column(4, "kept_sha256", pa.array(columns["kept_sha256"], pa.string()))

    def with_marks(marks: DataFrame, run, schema: str) -> DataFrame:
        to = marks.filter(F.col("node") == TO_BATCH).select(F.col("part").alias("batch"), "data")
        return base.groupBy("batch").cogroup(to.groupBy("batch")).applyInArrow(run, schema)

    marks = by_head.merge(base.groupBy("batch").applyInArrow(heads, ROWS))
    for family, run in ((by_around, around), (by_half, halves), (by_string, strings)):
        marks = family.merge(with_marks(marks, run, ROWS))
    out = with_marks(marks, kept, RESULT + ", kept binary" * with_text)
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
                      *[c for c in out.columns if c != "id"])
