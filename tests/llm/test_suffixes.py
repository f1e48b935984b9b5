"""Substring dedup by suffix-array levels against brute force, with one level and with many."""

import hashlib
import random

import pytest

from chalkline.llm import suffixes

SCHEMA = "doc_id long, text string, id long, node int, part string, data string, batch int, pos int"


def brute(rows, length=50):
    rank = lambda i: -(1 << 63) if i is None else i
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            least[t[p:p + length]] = min(least.get(t[p:p + length], rank(i)), rank(i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < rank(i):
                gone[p:p + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "déjà", "delta", "日本", "zeta", "eta", "theta", "iota"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(12)]

    def text():
        return " ".join(rng.choice([rng.choice(passages), rng.choice(passages)[:rng.randint(10, 60)],
                                    " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))])
                        for _ in range(rng.randint(0, 6)))

    out = [(rng.choice([i, i, i, 7, None]), text()) for i in range(300)]  # ids that repeat, and none
    out += [(900, None), (901, ""), (902, "x" * 300), (903, "x" * 200), (3, "x" * 120), (904, "ab" * 100), (905, "ab" * 100)]
    out += [(906, "y" * 49), (907, "y" * 49), (908, "z" * 50), (909, "z" * 50)]
    out += [(1000 + i, passages[3] * 2) for i in range(150)]  # a third of all rows
    # one head, many surroundings: a short passage between words that differ
    out += [(2000 + i, f"{i} {rng.random()} " + passages[0][:40] + f" {rng.random()} {i % 9}") for i in range(150)]
    return out + [(5, passages[3] * 2)] * 3


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 4000, "fan": 3, "class_rows": 200},
                                   {"batch_bytes": 1500, "fan": 2, "class_rows": 50},
                                   {"batch_bytes": 6000, "fan": 2, "many": 2}])
def test_levels_match_brute_force(spark, sizes):
    own = rows(len(sizes))
    table = spark.createDataFrame([(i, t, 1, 2, "p", "d", 3, 4) for i, t in own], SCHEMA)
    got = sorted((tuple(r) for r in suffixes.remove_repeated_strings(table, **sizes).collect()), key=str)
    assert got == brute(own)


def test_kept_bytes_and_other_lengths(spark):
    own = [(i, t) for i, t in rows(9)[:120] if i is not None]
    table = spark.createDataFrame(own, "doc_id long, text string")
    out = suffixes.remove_repeated_strings(table, length=21, head=11, batch_bytes=3000, fan=2, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute(own, 21)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_long_and_empty_tables(edge_docs, empty_docs):
    out = suffixes.remove_repeated_strings(edge_docs).collect()
    assert len(out) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[8]["n_removed"] == by_id[7]["n_bytes"] and by_id[8]["n_spans"] == 1  # a long text and one more word
    assert by_id[7]["n_removed"] == 0 and by_id[0]["n_bytes"] == 0
    assert suffixes.remove_repeated_strings(empty_docs).count() == 0

