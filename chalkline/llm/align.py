"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), cut the same bytes. The sorted token ends of both
are merged: between two neighbouring ends lies exactly one link, the A token and the B token that overlap there, and
where both end a group is closed.

Merge path. The merged order of a text with a A ends and b B ends is a path through an a x b grid. Where the path
crosses the diagonals at ``work``, 2 x ``work``, ... steps, found for all diagonals at once by binary searches, it is cut
into pieces of equal work that need nothing from each other but the next token's id. Pieces are rows of a written table,
so a long text is many rows, dealt like any others. Each piece emits its links and its closed groups; what stands before
the first and after the last common end of a piece is stitched to its neighbours by the text's key (texts of one piece
need none of this).

Counts. A pair of ids is counted by task and then by a grouped sum over the whole corpus. The counts of the
``hot_pairs`` most frequent pairs are broadcast (16 bytes each); links of any others go through a shuffle join in which no
pair is frequent. The highest count of each B id is one number per id of B's vocabulary.

Defined cases: a text that is null or empty, or that either tokenizer does not give back byte for byte (with the space
before it), has no tokens: zeros and an empty ``groups_sha256``. Contents of special tokens are plain text. Rows that
repeat an id or a text are counted and returned each for itself. An empty table gives an empty result. A task needs
about 100 bytes of memory per byte of its longest text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import saved, slices
from chalkline.llm.packing import _byte_letters, encoder

WORK, HOT_PAIRS = 16_384, 2_000_000
#: Distinct pairs that a task holds before it sends their counts.
HELD = 1_000_000
SLICE_BYTES = 1 << 20
#: Words that a Python worker remembers (about 300 bytes each; forgotten together beyond that), and their longest.
REMEMBERED, LONG_WORD = 500_000, 1000
#: Fixed value of piece vocabularies: the letter that stands for a space.
MARK = "\u2581"


# --------------------------------------------------------------------------- merge path
def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): piece k takes the ends a[i[k]:i[k + 1]] and b[j[k]:j[k + 1]] of two strictly increasing arrays. An end that
    both hold is in one piece."""
    steps = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # at (mid, step - mid): is a[mid] among the first steps?
        first = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(steps - mid - 1, 0, len(b) - 1)]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    i, j = low, steps - low
    tie = (i > 0) & (j < len(b))
    tie[tie] = a[i[tie] - 1] == b[j[tie]]
    return i, j + tie


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of small numbers as compressed byte planes, with their lengths."""
    raw = [np.array([len(c) for c in columns], "<i4").tobytes()]
    raw += [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    raw = b"".join(raw)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int = 4) -> list[np.ndarray]:
    raw = pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    raw, out, at = np.frombuffer(raw, np.uint8), [], 4 * n
    for size in raw[:4 * n].view("<i4").tolist():
        out.append(np.ascontiguousarray(raw[at:at + 4 * size].reshape(4, size).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return out


# --------------------------------------------------------------------------- tokens
class Tokens:
    """Ids and end offsets of space+text by both tokenizers, by way of remembered words.

    Neither tokenizer joins a word to the space that follows it, so a text is tokenised word by word, each with the space
    before it, and a word only once. Where this doesn't hold (two spaces in a row, a word that begins or ends with other
    white space, a piece mark in the text, a tokenizer of another kind) the text is tokenised as a whole. Bytes are
    compared per remembered word, or per whole text.
    """

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        self.a, self.b = encoder(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = _byte_letters()
        j = json.loads(spec)
        vocab = j["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in j.get("added_tokens") or ())]))
        for token, i in vocab.items():
            if all(x in letters for x in token):
                self.a_bytes[i] = bytes(letters[x] for x in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        apart = all(MARK not in p[1:] or not p.strip(MARK) for p in names)
        self.words: dict[str, tuple[bytes, bytes]] | None = {} if apart and self.a.fast is not None else None

    def _same(self, a: list[int], b: list[int], whole: bytes) -> bool:
        return (b"".join(map(self.a_bytes.__getitem__, a)) == whole
                and b"".join(map(self.b_bytes.__getitem__, b)) == whole)

    def _whole(self, text: str):
        a = np.frombuffer(self.a.whole(" " + text), "<u4")
        b = self.b.encode(text, out_type=int)
        return (a, np.array(b, "<u4")) if self._same(a.tolist(), b, b" " + text.encode()) else None

    def _learn(self, new: set[str]) -> None:
        """Remember the words of ``new`` that can stand alone and that both tokenizers give back."""
        alone = [w for w in new if w and len(w) <= LONG_WORD and not w[0].isspace() and not w[-1].isspace()
                 and MARK not in w]
        if not alone:
            return
        whole = (" " + " ".join(alone)).encode()
        a = self.a.fast.encode_ordinary(whole.decode())
        b = self.b.encode(alone, out_type=int, num_threads=1)
        b_at = np.cumsum([0, *map(len, b)]).tolist()
        b = list(itertools.chain.from_iterable(b))
        if not self._same(a, b, whole):  # some word is not given back: it shows in its texts
            for w in alone:
                found = self._whole(w)
                if found:
                    self.words[w] = tuple(x.tobytes() for x in found)
            return
        a = np.array(a, "<u4")
        sizes = np.cumsum([len(w) + 1 for w in alone] if len(whole) == sum(map(len, alone)) + len(alone) else
                          [len(w.encode()) + 1 for w in alone])
        a_at = [0, *(np.searchsorted(np.cumsum(self.a_size[a]), sizes) + 1).tolist()]
        a_data, b_data = a.tobytes(), np.array(b, "<u4").tobytes()
        for k, w in enumerate(alone):
            self.words[w] = a_data[4 * a_at[k]:4 * a_at[k + 1]], b_data[4 * b_at[k]:4 * b_at[k + 1]]

    def of(self, texts: list[str | None]):
        """Per text: (A ids, B ids), or None where there are no tokens."""
        if self.words is None:
            return [self._whole(t) if t else None for t in texts]
        parts = [(t or "").split(" ") for t in texts]
        new = set().union(*parts).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = set().union(*parts)
        self._learn(new)
        out = []
        for text, own in zip(texts, parts, strict=True):
            try:
                a, b = zip(*map(self.words.__getitem__, own), strict=True)
                out.append((np.frombuffer(b"".join(a), "<u4"), np.frombuffer(b"".join(b), "<u4")))
            except KeyError:
                out.append(self._whole(text) if text else None)
        return out


_tokens: dict[int, Tokens] = {}


def tokens(spec: str, model: bytes) -> Tokens:
    """The worker's tokenizers; kept for later tasks of the worker."""
    key = zlib.crc32(model, zlib.crc32(spec.encode()))
    if key not in _tokens:
        _tokens[key] = Tokens(spec, model)
    return _tokens[key]


PIECES = "key long, doc_id {id}, n_a long, n_b long, pieces int, piece int, data binary"


def pieces(docs: DataFrame, a_path: str, b_path: str, work: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (text's key, piece, tokens whose ends are in the piece and the next token's ids)."""
    sc = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        spec, model = sc.broadcast(f.read()), sc.broadcast(g.read())

    def cut(batches):
        both, key = tokens(spec.value, model.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = []
                for row, found in enumerate(both.of(part.column(1).to_pylist())):
                    key += 1
                    if found is None:
                        rows.append((key, row, 0, 0, 1, 0, b""))
                        continue
                    a, b = found
                    a_size, b_size = both.a_size[a], both.b_size[b]
                    if len(a) + len(b) <= work:
                        rows.append((key, row, len(a), len(b), 1, 0, _packed(a, a_size, b, b_size)))
                        continue
                    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
                    i, j = merge_path(a_end, b_end, work)
                    for k in range(len(i) - 1):
                        own = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
                        base = min(a_end[i[k] - 1] if i[k] else 0, b_end[j[k] - 1] if j[k] else 0)
                        rows.append((key, row, len(a), len(b), len(i) - 1, k, _packed(
                            a[i[k]:i[k + 1] + 1], np.diff(a_end[own[0]], prepend=base),
                            b[j[k]:j[k + 1] + 1], np.diff(b_end[own[1]], prepend=base))))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), part.column(0).take(pa.array(columns[1], pa.int64())),
                     *(pa.array(c, t) for c, t in zip(columns[2:], (pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                                                                     pa.binary()), strict=True))],
                    ["key", "doc_id", "n_a", "n_b", "pieces", "piece", "data"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(cut, PIECES.format(id=own.schema["doc_id"].dataType.simpleString()))


# --------------------------------------------------------------------------- a piece
class Piece:
    """Links and groups of a piece. Offsets count from the piece's own base."""

    def __init__(self, data: bytes):
        self.a, a_size, self.b, b_size = _unpacked(data)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        n = 1 + int(max(a_end[-1] if len(a_end) else 0, b_end[-1] if len(b_end) else 0))
        self.a_ends, self.b_ends = np.zeros(n, bool), np.zeros(n, bool)  # A and B merge on a line of the piece's bytes
        self.a_ends[a_end], self.b_ends[b_end] = True, True
        cut = self.a_ends & self.b_ends
        self.a_cut, self.b_cut = np.flatnonzero(cut[a_end]), np.flatnonzero(cut[b_end])  # the tokens that close groups

    def links(self) -> np.ndarray:
        """Each link's pair of ids, as one number."""
        ends = np.flatnonzero(self.a_ends | self.b_ends)
        a, b = ((np.cumsum(x) - x)[ends] for x in (self.a_ends, self.b_ends))
        return (self.a[a] << 32) | self.b[b]

    def text(self, first: int, last: int) -> bytes:
        """The groups first..last - 1, ids joined by ``,``, A and B by ``|``, groups by ``;`` (and one at the end)."""
        a_last, b_last = self.a_cut[first:last], self.b_cut[first:last]
        a0, b0 = (x[first - 1] + 1 if first else 0 for x in (self.a_cut, self.b_cut))
        a1, b1 = a_last[-1] + 1, b_last[-1] + 1
        a_last, b_last = a_last - a0, b_last - b0
        a_count, b_count = np.append(0, a_last + 1), np.append(0, b_last + 1)
        of_a, of_b = (np.repeat(np.arange(last - first), np.diff(x)) for x in (a_count, b_count))
        ids = np.empty(a1 - a0 + b1 - b0, np.int64)
        mark = np.zeros(len(ids), np.int64)  # 0 "," 1 "|" 2 ";"
        a_at = np.arange(a1 - a0) + b_count[of_a]
        b_at = np.arange(b1 - b0) + a_count[of_b + 1]
        ids[a_at], ids[b_at] = self.a[a0:a1], self.b[b0:b1]
        mark[a_at[a_last]], mark[b_at[b_last]] = 1, 2
        return b"".join(map(_marked().__getitem__, (3 * ids + mark).tolist()))


@functools.cache
def _marked(most: int = 1 << 17) -> list[bytes]:
    """The decimal text of every id below ``most`` with each of the marks ``,|;`` after it."""
    return [b"%d%c" % (i, c) for i in range(most) for c in b",|;"]


def _ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def count_pairs(stored: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair of ids."""
    def run(batches):
        keys, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            every, weight = np.concatenate([keys, new]), np.concatenate([counts, n])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[first], np.add.reduceat(weight, first) if len(first) else weight

        def send():
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + (1 << 18)]), pa.array(counts[i:i + (1 << 18)])],
                                                 ["pair", "n"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(Piece(data).links())
                size += len(held[-1])
                if size >= HELD:
                    (keys, counts), held, size = merged(), [], 0
                    if len(keys) >= HELD:
                        yield from send()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from send()

    found = stored.filter("n_a > 0").select("data").mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


MEASURED = ("key long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
            "piece int, head_a string, head_b string, body binary, tail_a string, tail_b string, groups_sha256 string")


def align(docs: DataFrame, a_path: str, b_path: str, work: int = WORK, hot_pairs: int = HOT_PAIRS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row."""
    sc = docs.sparkSession.sparkContext
    stored = saved(pieces(docs, a_path, b_path, work, id_col, text_col), "aligned-pieces")
    counts = saved(count_pairs(stored), "pair-counts")
    n_pairs = counts.count()
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best_rows = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("best")).collect()  # one per id of B's vocabulary
    best = np.zeros(1 + max((r["b"] for r in best_rows), default=0), np.int64)
    for r in best_rows:
        best[r["b"]] = r["best"]
    hot = counts if n_pairs <= hot_pairs else counts.orderBy(F.desc("n"), "pair").limit(hot_pairs)
    table = hot.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    known = sc.broadcast((table["pair"].to_numpy()[order], table["n"].to_numpy()[order], best))
    del table, order
    id_type = stored.schema["doc_id"].dataType.simpleString()
    schema = MEASURED.format(id=id_type)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def looked_up(pairs: np.ndarray):
        """(counts of the known pairs, which are known)."""
        keys, n, _ = known.value
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        met = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return n[at[met]] if len(keys) else n, met

    def measure(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for n_a, n_pieces, data in zip(*(part.column(c).to_pylist() for c in (2, 4, 6)), strict=True):
                    if not n_a:
                        rows.append((0, 0, 0, 0, None, None, None, None, None, ""))
                        continue
                    piece = Piece(data)
                    pairs, cuts = piece.links(), len(piece.a_cut)
                    n, met = looked_up(pairs)
                    top = int((n == known.value[2][pairs[met] & 0xFFFFFFFF]).sum())
                    own = cuts, len(pairs), top, int(n.sum())
                    if n_pieces == 1:
                        groups = piece.text(0, cuts)[:-1]
                        rows.append((*own, None, None, None, None, None, hashlib.sha256(groups).hexdigest()))
                        continue
                    a, b = piece.a[:piece.a_ends.sum()], piece.b[:piece.b_ends.sum()]
                    if not cuts:
                        rows.append((*own, _ids(a), _ids(b), b"", "", "", None))
                        continue
                    (a0, a1), (b0, b1) = piece.a_cut[[0, -1]] + 1, piece.b_cut[[0, -1]] + 1
                    body = piece.text(1, cuts) if cuts > 1 else b""
                    rows.append((*own, _ids(a[:a0]), _ids(b[:b0]), body, _ids(a[a1:]), _ids(b[b1:]), None))
                c = list(zip(*rows, strict=True))
                longs = [pa.array(x, pa.int64()) for x in c[:4]]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in range(4)), *longs, part.column(5), pa.array(c[4], pa.string()),
                     pa.array(c[5], pa.string()), pa.array(c[6], pa.binary()), pa.array(c[7], pa.string()),
                     pa.array(c[8], pa.string()), pa.array(c[9], pa.string())], names)

    def stitch(key, rows):
        rows = rows.sort_by("piece")
        sha, open_a, open_b, some = hashlib.sha256(), [], [], False
        for cut, head_a, head_b, body, tail_a, tail_b in zip(*(rows.column(c).to_pylist() for c in (
                "n_groups", "head_a", "head_b", "body", "tail_a", "tail_b")), strict=True):
            open_a, open_b = open_a + [head_a] * bool(head_a), open_b + [head_b] * bool(head_b)
            if cut:
                sha.update((";" * some + ",".join(open_a) + "|" + ",".join(open_b)).encode())
                if body:
                    sha.update(b";" + body[:-1])
                open_a, open_b, some = [tail_a] * bool(tail_a), [tail_b] * bool(tail_b), True
        total = {c: sum(rows.column(c).to_pylist()) for c in names[4:8]}
        return pa.table({"key": rows.column("key")[:1], "doc_id": rows.column("doc_id")[:1], "n_a": rows.column("n_a")[:1],
                         "n_b": rows.column("n_b")[:1], **{c: pa.array([v], pa.int64()) for c, v in total.items()},
                         "groups_sha256": pa.array([sha.hexdigest()])})

    final = ", ".join(x.strip() for x in schema.split(",")[:8]) + ", groups_sha256 string"
    out = names[:8] + ["groups_sha256"]
    one = stored.filter("pieces = 1").mapInArrow(measure, schema).select(*out)
    many = stored.filter("pieces > 1").mapInArrow(measure, schema).groupBy("key").applyInArrow(stitch, final)
    result = one.unionByName(many)
    if n_pairs > hot_pairs:
        def rare(batches):
            for batch in batches:
                for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    pairs = Piece(data).links()
                    pair, n = np.unique(pairs[~looked_up(pairs)[1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), key)), pa.array(pair), pa.array(n)],
                                                     ["key", "pair", "times"])

        links = stored.filter("n_a > 0").select("key", "data").mapInArrow(rare, "key long, pair long, times long")
        top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("best"))
        met = links.join(counts, "pair").join(F.broadcast(top), b_id == F.col("b"))  # one row per id of B
        more = met.groupBy("key").agg(F.sum(F.col("times") * F.col("n")).alias("more"),
                                      F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        result = (result.join(more, "key", "left")
                  .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
                  .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))))
    return result.select(*out[1:])
