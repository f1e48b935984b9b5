"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Pieces of equal length are interchangeable, so the packing itself needs only the
histogram of piece lengths: at most ``capacity`` rows, however large the corpus.
``plan_bins`` packs the histogram on the driver; Spark tokenises, cuts, counts,
ranks the pieces of each length and joins each rank to its place.

Best-two-fit: a bin is filled greedily, the longest fitting piece first. When
nothing fits the gap, the bin's smallest piece is taken out and two unpacked
pieces that fill the widened gap more tightly replace it, until no two do.

Ranks: the pieces of one length may be most of the table (full pieces are), so
they are ranked within (length, salt) and shifted by the counts of the smaller
salts; the number of salts follows the largest count.

Defined cases: a null or empty text is one piece, the end token alone. Equal rows
are packed each for itself. An empty table gives no pieces. With ``added`` the
contents of added tokens (such as "<|endoftext|>") are these tokens, as the tokenizer
has it (the registered queries do this); without, they are ordinary text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chalkline.llm.common import saved, slices

CAPACITY = 2048
#: Bytes of text that a Python worker holds as chunks at a time.
SLICE_BYTES = 4 << 20
#: Chunks remembered by a Python worker (about 150 bytes each); they are forgotten together beyond that.
REMEMBERED = 400_000
#: Characters from which a chunk is left to the tokenizer itself (merge ranks take quadratic time).
LONG_CHUNK = 1000
#: Pieces of one length that one task ranks.
RANK_ROWS = 500_000


# --------------------------------------------------------------------------- tokens
class Encoder:
    """Texts to ids, by way of remembered chunks.

    A chunk is what stands between two spaces, with the space before it. The
    pre-tokeniser never joins a word to what stands before its leading space, so
    chunks tokenise alone, and a corpus has far fewer distinct chunks than words.
    New chunks of a slice are encoded together as one text and told apart by the
    byte lengths of their tokens. A chunk that is empty or that begins or ends with
    white space could join a run of white space across the cut: it is never
    remembered, and a text that has one is encoded whole. So is a text that holds what
    ``special``, a pattern of the added tokens' contents, matches.
    """

    def __init__(self, tokenizer, fast=None, sizes: np.ndarray | None = None, special: re.Pattern | None = None):
        self.tokenizer, self.fast, self.sizes, self.special = tokenizer, fast, sizes, special
        self.chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """A text's ids as little-endian 32-bit integers."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        if len(self.chunks) + len(new) > REMEMBERED:
            self.chunks.clear()
        alone = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        for c in (c for c in alone if len(c) > LONG_CHUNK):
            self.chunks[c] = self.whole(" " + c)
        alone = [c for c in alone if len(c) <= LONG_CHUNK]
        if not alone:
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(alone)), "<u4")
        ends = np.cumsum(np.array([len(c.encode()) + 1 for c in alone]))
        after = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        for c, to in zip(alone, (4 * after).tolist(), strict=True):
            self.chunks[c] = data[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [self.whole(t) if t else b"" for t in texts]
        if self.special is not None and any(alone := [bool(self.special.search(t)) for t in texts]):
            rest = iter(self.encode([t for t, x in zip(texts, alone, strict=True) if not x]))
            return [self.whole(t) if x else next(rest) for t, x in zip(texts, alone, strict=True)]
        parts = [t.split(" ") for t in texts]
        new = set().union(*(p[1:] for p in parts)).difference(self.chunks)
        if new:
            if len(self.chunks) + len(new) > REMEMBERED:
                new = set().union(*(p[1:] for p in parts))
            self._learn(new)
        out = []
        for text, (first, *rest) in zip(texts, parts, strict=True):
            try:
                if first[-1:].isspace() and rest or len(first) > LONG_CHUNK:
                    raise KeyError
                head = np.array(self.fast.encode_ordinary(first), "<u4").tobytes()
                out.append(b"".join([head, *map(self.chunks.__getitem__, rest)]))
            except KeyError:
                out.append(self.whole(text))
        return out


#: Fixed values of byte-level BPE: its pre-tokeniser's pattern.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _by_ranks(spec: str):
    """The same encoding by merge ranks (about three times as fast), or None where the JSON is not a plain
    byte-level BPE whose ids follow its merges."""
    import json

    import tiktoken
    j = json.loads(spec)
    pre, model = j.get("pre_tokenizer") or {}, j["model"]
    if (j.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        return None
    letters = _byte_letters()
    added = {t["content"] for t in j.get("added_tokens", ())}
    ranks = {bytes(letters[x] for x in token): i for token, i in model["vocab"].items() if token not in added}
    merged = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if any(model["vocab"].get(token) != 256 + i for i, token in enumerate(merged)):
        return None
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _added(spec: str) -> re.Pattern | None:
    """A pattern of the contents of a tokenizer's added tokens (merge ranks are for texts without them)."""
    import json
    each = [re.escape(t["content"]) for t in json.loads(spec).get("added_tokens") or ()]
    return re.compile("|".join(each)) if each else None


_loaded: dict[tuple[int, bool], Encoder] = {}


def encoder(spec: str, added: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer's JSON; kept for later tasks of the worker."""
    key = zlib.crc32(spec.encode()), added
    if key not in _loaded:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.encode_special_tokens = not added
        fast = _by_ranks(spec)
        sizes = None
        if fast is not None:
            sizes = np.array([len(fast.decode_single_token_bytes(i)) for i in range(fast.max_token_value + 1)])
        _loaded[key] = Encoder(tokenizer, fast, sizes, _added(spec) if added else None)
    return _loaded[key]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut into full
    pieces from its end, so only the first may be shorter."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        codec = encoder(spec.value, added)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, data in enumerate(codec.encode(part.column(1).to_pylist())):
                    data += end
                    at, n, k = 0, len(data) // 4, 0
                    while at < n:
                        to = at + ((n - at) % capacity or capacity)
                        rows.append(row), piece.append(k), start.append(at), length.append(to - at)
                        crc.append(zlib.crc32(data[4 * at:4 * to]))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(cut, PIECES.format(id=d.schema["doc_id"].dataType.simpleString()))


# --------------------------------------------------------------------------- packing a histogram
def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, longest first; how many such bins)] for {length: pieces}."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left[length] += n
    sizes = np.arange(capacity + 1)
    bins = []
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        lengths, gap = [], capacity

        def longest(upto: int) -> int:
            fits = np.flatnonzero(left[:upto + 1] > used[:upto + 1]) if upto > 0 else ()
            return int(fits[-1]) if len(fits) else 0

        def fill() -> None:
            nonlocal gap
            while gap and (x := longest(gap)):
                n = min(gap // x, int(left[x] - used[x]))
                lengths.extend([x] * n)
                used[x] += n
                gap -= n * x

        fill()
        while gap and lengths:
            smallest = min(lengths)
            used[smallest] -= 1
            room = gap + smallest
            free = left - used
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = np.flatnonzero(free[:room] > 0)
            b = below[room - a]
            alone = (b == a) & (free[a] < 2)
            b[alone] = below[a[alone] - 1]
            pair = np.where(b > 0, a + b, 0)
            best = int(pair.argmax()) if len(pair) else 0
            if not len(pair) or pair[best] <= smallest:
                used[smallest] += 1
                break
            lengths.remove(smallest)
            for x in (int(a[best]), int(b[best])):
                lengths.append(x)
                used[x] += 1
            gap = room - int(pair[best])
        own = np.flatnonzero(used)
        times = int((left[own] // used[own]).min())
        left[own] -= times * used[own]
        bins.append((sorted(lengths, reverse=True), times))
    return bins


def places(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of that length in each bin, offset of the
    first): which ranks of a length go to which sequences."""
    out, taken, sequence = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for x in dict.fromkeys(lengths):
            n, rank = lengths.count(x), taken.get(x, 0)
            out.append((x, rank, rank + n * times, sequence, n, offset))
            taken[x] = rank + n * times
            offset += n * x
        sequence += times
    return out


PLACES = T.StructType([T.StructField(x, T.LongType()) for x in
                       ("__length", "__from", "__to", "__sequence", "__each", "__offset")])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stored table with a column ``length``) with sequence_id and offset.

    The table of places is made from the histogram and bounded by it, so it may be broadcast.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(16, -(-max(counts.values(), default=0) // RANK_ROWS))
    where = spark.createDataFrame(places(plan_bins(counts, capacity)), PLACES)
    keyed = cut.withColumn("__salt", F.pmod(F.xxhash64(*cut.columns), F.lit(salts)))
    by_salt = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = (keyed.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(by_salt), F.lit(0))).drop("__n"))
    order = Window.partitionBy("length", "__salt").orderBy(*[c for c in cut.columns if c != "length"])
    ranked = (keyed.withColumn("__local", F.row_number().over(order) - 1)
              .join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__local")))
    hit = ((F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from"))
           & (F.col("__rank") < F.col("__to")))
    at = F.col("__rank") - F.col("__from")
    return ranked.join(F.broadcast(where), hit).select(
        *cut.columns, (F.col("__sequence") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + (at % F.col("__each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(saved(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, added), "pieces"), capacity)
