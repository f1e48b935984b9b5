"""Vector codes against plain Python, on tables with every edge."""

import hashlib
import math
import random

import pytest

from chalkline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, ids int, __n int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2 ** 50 else int(x) * 4096 for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == size * parts]
    cut = lambda v: [v[p * size:(p + 1) * size] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [(nearest(cut(v)[p], books[p])[1], cut(v)[p]) for _, v, _ in kept]
            for k in range(len(books[p])):
                mine = [x for n, x in own if n == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, lab in kept:
        near = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, total[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 1, 2) for i, v, lab in rows], SCHEMA)


def vectors(seed, n, dims=16):
    rng = random.Random(seed)
    # a third of all rows share one label, another group has none; values are float32
    return [(i, [struct32(rng.gauss(0, 0.2)) for _ in range(dims)], rng.choice([1, 1, 1, 2, 3, None])) for i in range(n)]


def struct32(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("hot", [codes.HOT_LABELS, 1])
def test_codes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(codes.with_label_error, "__defaults__", (hot,))
    rows = vectors(1, 300)
    rows += [rows[7], rows[7], (7, [0.5] * 16, None), (None, [0.25] * 16, 2)]  # repeats, an id twice, no id
    rows += [(400, None, 1), (401, [], 1), (402, [None] + [0.1] * 15, 1), (403, [math.nan] * 16, 1),
             (404, [math.inf] + [0.0] * 15, 2), (405, [0.1] * 8, 1)]
    got = sorted((tuple(r) for r in codes.compress(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(2, 5)
    assert sorted((tuple(r) for r in codes.compress(table(spark, rows)).collect()), key=str) == brute(rows)
    out = codes.compress(table(spark, [(1, None, 1)]))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_ties_take_the_lower_entry(spark):
    rows = [(i, [0.0] * 16, 1) for i in range(40)] + [(50 + i, [float(i % 3)] * 16, 1) for i in range(20)]
    got = sorted((tuple(r) for r in codes.compress(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_large_integers_are_exact(spark):
    rows = vectors(3, 40) + [(100, [60000.0 + i for i in range(16)], 1), (101, [-60000.5] * 16, 2)]
    got = sorted((tuple(r) for r in codes.compress(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_uneven_parts_are_refused(spark):
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [0.5] * 12, 1)]))
