"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Documents are linked when
their sets' Jaccard similarity is at least ``threshold``; the answer is the
connected components of the links.

Chosen paths. Each of ``trees`` independent trees sends a document from the root
to the node of one selected minwise token; a node that is too mixed sends its
documents on to the nodes of two more tokens, and so on, so similar documents
keep meeting while others part. Every tree misses a pair at the threshold with
probability 1/4 at the root, so ten trees miss one in a million.

No node's pairs are all written out. Documents with equal sets are one class
beforehand. Then

1. every document of a node is paired with the node's smallest document only, the
   estimate from the signatures sorts out most pairs, the rest are confirmed on the
   full sets, and the links give components; a second star pairs the documents outside
   a node's largest component (the minority) with another member of it;
2. a node whose documents are all in one component has nothing to add. Of the
   others, the minority is compared with the whole node, exhaustively, in blocks of
   signatures; a node with a minority over ``leaf`` branches instead, up to ``depth``
   levels, and is compared in blocks all the same after the last;
3. documents whose estimates pass come together in families; in a family, the
   documents outside its largest component are compared with all of it on the full
   sets, block by block, and what is linked joins the components.

A block gives one row per document that it connects, not one per pair, and only
links between different components are looked for, so a group of near copies that
holds a third of all rows is one star, not its square.

Defined cases: a text of fewer than five words has its whole sequence as one
shingle; a null or empty text has none and is linked with nothing. A null id is
smaller than any other. Rows that repeat an id are one document, linked where one
of its rows is; each row gives its own result row. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import RollingHash, arrow_batches, memory_back, mix, saved, slices, text_bytes, word_bounds, word_hashes
from chalkline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.75
TREES = 10
SIGNATURE = 128
LEAF = 2048
#: Documents of a node, and of a family, that are compared with as many others at a time.
BLOCK, TEXT_BLOCK = 256, 64
DEPTH = 8
#: Standard errors that an estimate may lie below the threshold and still be confirmed on the sets.
SLACK = 4.5
#: Ids that are broadcast to pick documents from the table (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Rows of an Arrow batch: of texts or pairs, and of blocks.
BATCH_ROWS, BLOCK_ROWS = 500, 64
NULL_ID = -(1 << 63)

SPANS = RollingHash(0xE7037ED1A0B428DB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
_ODD = mix(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every row, sorted."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    start, end, first = word_bounds(data, offsets)
    prefix = SPANS.prefix(word_hashes(data, start, end))
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(start)) - first[row]
    index = np.flatnonzero((at + size <= n[row]) | ((at == 0) & (n[row] < size)))
    row = row[index]
    hashes = SPANS.spans(prefix, index, index + np.minimum(size, n[row]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


FEATURES = "id long, n int, d1 long, d2 long, nodes array<long>, sig binary"


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
             trees: int = TREES) -> DataFrame:
    """Set size, set digest, root nodes by tree and signature of every document."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, hashes = shingle_sets(part.column(1), size)
                rows = part.num_rows
                n = np.bincount(row, minlength=rows)
                some = np.flatnonzero(n)
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64)
                d1, d2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                sig, nodes = np.zeros((rows, SIGNATURE), np.uint16), np.zeros((rows, trees), np.uint64)
                if len(some):
                    d1[some] = np.add.reduceat(mix(hashes), starts)
                    d2[some] = np.add.reduceat(mix(hashes ^ _SALT[0]), starts)
                    for k in range(SIGNATURE):
                        least = np.minimum.reduceat((hashes ^ _SALT[k]) * _ODD[k], starts)
                        sig[some, k] = mix(least) & np.uint64(0xFFFF)
                        if k < trees:
                            nodes[some, k] = mix(least ^ _SALT[-1 - k])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int32)), pa.array(d1.view(np.int64)),
                     pa.array(d2.view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, rows * trees + 1, trees, dtype=np.int32),
                                              pa.array(nodes.view(np.int64).ravel())),
                     pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["id", "n", "d1", "d2", "nodes", "sig"])
            memory_back()

    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, FEATURES)


def least_matches(threshold: float) -> int:
    """Equal signature places below which a pair is not confirmed on its sets."""
    return int(SIGNATURE * threshold - SLACK * (SIGNATURE * threshold * (1 - threshold)) ** 0.5)


def _sizes_allow(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold)


def _signatures(column: pa.Array) -> np.ndarray:
    """A binary column of signatures as a matrix, without copying."""
    if not len(column):
        return np.zeros((0, SIGNATURE), np.uint16)
    column = column.cast(pa.binary())
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint16, len(column) * SIGNATURE, int(first)).reshape(-1, SIGNATURE)


def estimated(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough."""
    least = least_matches(threshold)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))

    sided = (pairs.join(sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
             .join(sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"))
    return (sided.filter(_sizes_allow("na", "nb", threshold)).select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long").distinct())


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of some documents."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: float, size: int, id_col: str,
              text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are at least ``threshold`` similar. ``pairs`` is stored."""
    share = round(threshold * 100)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta", 1 << 20):
                a, b = (shingle_sets(part.column(i), size) for i in (2, 3))
                row, hashes = (np.concatenate(x) for x in zip(a, b, strict=True))
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])],
                                   minlength=part.num_rows)
                union = np.bincount(row, minlength=part.num_rows) - both
                yield part.select([0, 1]).filter(pa.array((100 * both >= share * union) & (union > 0)))
            memory_back()

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = saved(_texts(docs, ids, id_col, text_col), "pair-texts")
    return (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())


def _star_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each document with the smallest of its node."""
    centre = met.groupBy("node").agg(F.min("id").alias("b"))
    return met.join(centre, "node").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows (node, id) of nodes that hold several documents."""
    several = rows.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi")
    return rows.join(several.select("node"), "node", "left_semi")


def _mixed(rows: DataFrame) -> DataFrame:
    """(node, major, minority) of nodes (node, id, component) with several components: the component with
    most documents, and how many documents are outside it."""
    per = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    return (per.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
            .select("node", F.col("top.component").alias("major"), "n", (F.col("n") - F.col("top.n")).alias("minority"))
            .filter("minority > 0"))


def _connected(mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id) of the documents that a matrix of pairs connects, without those smallest themselves."""
    none = np.iinfo(np.int64).max
    some, other = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    mask, rows, columns = mask[np.ix_(some, other)], rows[some], columns[other]
    if not len(rows):
        return rows, rows
    low, least = rows.copy(), columns.copy()
    while True:
        new_least = np.minimum(least, np.where(mask, low[:, None], none).min(axis=0))
        new_low = np.minimum(low, np.where(mask, new_least, none).min(axis=1))
        if (new_low == low).all() and (new_least == least).all():
            break
        low, least = new_low, new_least
    ids, smallest = np.concatenate([rows, columns]), np.concatenate([low, least])
    return ids[ids != smallest], smallest[ids != smallest]


def _agreeing(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of two signature matrices agree in ``least`` places."""
    out = np.zeros((len(a), len(b)), bool)
    for i in range(0, len(a), 16):
        out[i:i + 16] = (a[i:i + 16, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int32) >= least
    return out


def _similar(a: pa.Array, b: pa.Array, size: int, share: int) -> np.ndarray:
    """Which pairs of two text columns have shingle sets at least ``share`` percent similar: products of the
    incidence matrices over the shingles that both sides have, some columns at a time."""
    (ra, ha), (rb, hb) = shingle_sets(a, size), shingle_sets(b, size)
    na, nb = np.bincount(ra, minlength=len(a)), np.bincount(rb, minlength=len(b))
    shared = np.intersect1d(ha, hb)
    both = np.zeros((len(a), len(b)), np.float32)
    ka, kb = np.searchsorted(shared, ha), np.searchsorted(shared, hb)
    ina, inb = np.isin(ha, shared), np.isin(hb, shared)
    ra, ka, rb, kb = ra[ina], ka[ina], rb[inb], kb[inb]
    for low in range(0, len(shared), 4096):
        left, right = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        at, bt = (ka >= low) & (ka < low + 4096), (kb >= low) & (kb < low + 4096)
        left[ra[at], ka[at] - low] = 1
        right[rb[bt], kb[bt] - low] = 1
        both += left @ right.T
    both = both.astype(np.int64)
    return (both > 0) & (100 * both >= share * (na[:, None] + nb[None, :] - both))


def _blocks(rows: DataFrame, groups: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(a, b): of each group (``node``, major, n, minority), its rows in blocks, each beside each block of the minority.

    A group of k blocks has ceil(sqrt(k)) salts: its blocks are dealt over them and those of its minority are repeated for
    each, so a hot group's comparisons are spread over that many tasks, and what is repeated grows slower than they do."""
    own = rows.join(groups, "node")
    salts = F.ceil(F.sqrt(F.ceil(F.col("n") / block))).cast("int")
    cut = lambda size: F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / block))
    packed = F.collect_list(F.struct(*columns))
    every = (own.groupBy("node", cut("n").alias("cut"), salts.alias("salts")).agg(packed.alias("a"))
             .select("node", F.pmod("cut", "salts").cast("int").alias("salt"), "a"))
    few = (own.filter("component <> major").groupBy("node", cut("minority").alias("cut"), salts.alias("salts"))
           .agg(packed.alias("b")).select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "b"))
    return every.join(few, ["node", "salt"]).select("a", "b")


def _node_families(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): documents of ``nodes`` that passing estimates between different components connect. rows: (node, id,
    component, shingles, sig)."""
    least = least_matches(threshold)

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = x.values, y.values
                (ia, ca, na), (ib, cb, nb) = ([v.field(k).to_numpy() for k in range(3)] for v in (x, y))
                mask = ((ca[:, None] != cb[None, :])
                        & (np.minimum(na[:, None], nb[None, :]) >= threshold * np.maximum(na[:, None], nb[None, :])))
                if mask.any():
                    mask &= _agreeing(_signatures(x.field(3)), _signatures(y.field(3)), least)
                    out.append(_connected(mask, ia, ib))
            a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _blocks(rows, nodes, ["id", "component", "shingles", "sig"], BLOCK).mapInArrow(run, "a long, b long").distinct()


def _family_links(edges: DataFrame, found: DataFrame, docs: DataFrame, threshold: float, size: int, id_col: str,
                  text_col: str) -> DataFrame:
    """(a, b): documents that links on the full sets, between different components of a family, connect."""
    share = round(threshold * 100)

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = x.values, y.values
                (ia, ca), (ib, cb) = ([v.field(k).to_numpy() for k in range(2)] for v in (x, y))
                mask = (ca[:, None] != cb[None, :]) & _similar(x.field(2), y.field(2), size, share)
                out.append(_connected(mask, ia, ib))
            a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    family = saved(components(edges).select("id", F.col("component").alias("node")).join(found, "id", "left")
                   .select("node", "id", F.coalesce("component", "id").alias("component")), "families")
    texts = saved(_texts(docs, family.select("id"), id_col, text_col), "family-texts")
    rows = family.join(texts, "id")
    return _blocks(rows, _mixed(family), ["id", "component", "text"], TEXT_BLOCK).mapInArrow(
        run, "a long, b long").distinct()


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """(node, id) of the two children of each row (node, id, sig): by two more places of the signature."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                node, sig = batch.column(0).to_numpy().view(np.uint64), _signatures(batch.column(2))
                for k in range(2):
                    place = ((mix(node) >> np.uint64(8)) % np.uint64(SIGNATURE // 2)).astype(np.int64) * 2
                    place = (place + 2 * level + k) % SIGNATURE
                    value = sig[np.arange(len(node)), place].astype(np.uint64)
                    child = mix(mix(node ^ _SALT[k]) ^ (value + (place.astype(np.uint64) << np.uint64(20))))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1)], ["node", "id"])

    return rows.select("node", "id", "sig").mapInArrow(run, "node long, id long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, leaf: int = LEAF,
                          depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row. ``docs`` is a stored table."""
    if not 0.5 <= threshold <= 1 or not 0 < trees <= SIGNATURE:
        raise ValueError("threshold must be in 0.5..1 and trees in 1..the signature's places")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _groups(docs, id_col, text_col, threshold, size, trees, leaf, depth)


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, size: int, trees: int, leaf: int,
            depth: int) -> DataFrame:
    """All jobs that need Python run in here; what is returned joins their tables."""
    spark = docs.sparkSession
    every = saved(features(docs, id_col, text_col, size, trees), "features")
    classes = saved(every.filter("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("id").alias("id"), F.first("nodes").alias("nodes"), F.first("sig").alias("sig")), "classes")
    sigs = classes.select("id", "n", "sig")
    met = saved(_meeting(classes.select(F.explode("nodes").alias("node"), "id").distinct()), "nodes")

    checked = saved(estimated(_star_pairs(met), sigs, threshold), "star-pairs")
    links = saved(confirmed(checked, docs, threshold, size, id_col, text_col), "star-links")
    found = components(links)

    def with_components(rows: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))

    # a second star: the minority of each mixed node with another member of its largest component
    rows = with_components(met)
    other = (rows.join(_mixed(rows), "node").groupBy("node", "major")
             .agg(F.max(F.when(F.col("component") == F.col("major"), F.col("id"))).alias("b")))
    again = (rows.join(other, "node").filter("component <> major").select(F.greatest("id", "b").alias("a"),
                                                                        F.least("id", "b").alias("b")).distinct()
             .join(checked, ["a", "b"], "left_anti"))
    again = saved(estimated(again, sigs, threshold), "star-pairs")
    links = links.unionByName(saved(confirmed(again, docs, threshold, size, id_col, text_col), "star-links"))
    found = components(links)

    edges, level, rows = [], 0, with_components(met)
    while True:
        mixed = saved(_mixed(rows), "mixed")
        large = mixed.filter(F.col("minority") > leaf)
        last = level >= depth or large.limit(1).count() == 0
        own = saved(rows.join(mixed.select("node"), "node", "left_semi"), "mixed-rows")
        full = own.join(sigs, "id").select("node", "id", "component", F.col("n").alias("shingles"), "sig")
        now = mixed if last else mixed.filter(F.col("minority") <= leaf)
        with arrow_batches(spark, BLOCK_ROWS):
            edges.append(saved(_node_families(full, now, threshold), "family-edges"))
        if last:
            break
        level += 1
        on = _branches(full.join(large.select("node"), "node", "left_semi"), level)
        rows = with_components(saved(_meeting(on.distinct()), "nodes"))

    more = edges[0]
    for e in edges[1:]:
        more = more.unionByName(e)
    if more.limit(1).count():
        with arrow_batches(spark, BLOCK_ROWS):
            links = links.unionByName(
                saved(_family_links(more, found, docs, threshold, size, id_col, text_col), "family-links"))
        found = components(links)

    of_class = (classes.select("d1", "d2", "n", "id").join(found, "id", "left")
                .select("d1", "d2", "n", F.coalesce("component", "id").alias("component")))
    back = F.when(F.col("component_id") != NULL_ID, F.col("component_id"))
    return (every.select("id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
            .select("id", "n", F.coalesce("component", "id").alias("component_id"))
            .select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    back.alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` (a stored table) whose id is the smallest of its group, with all their columns."""
    name = "__id"
    while name in docs.columns:
        name += "_"
    gone = (near_duplicate_groups(docs, id_col, text_col, **params).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(name)).distinct())
    return docs.join(saved(gone, "near-copies"), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
