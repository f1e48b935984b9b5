"""Exact dedup, substring dedup and near-dedup against brute force."""

import hashlib
import random
import re
import string

import pytest

from chalkline.llm import exact, neardup, substrings
from chalkline.llm.components import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_edges(edge_docs):
    rows = exact.exact_groups(edge_docs, runs=8, fan_in=2).collect()
    assert len(rows) == 16
    empty = [r for r in rows if r["doc_id"] in (0, 1)]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(1, 2)}
    assert {r["keep_id"] for r in rows if r["doc_id"] in (3, 4)} == {4}  # A-Z only
    same = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"same text of six words here").hexdigest()]
    assert len(same) == 5 and {(r["keep_id"], r["group_size"]) for r in same} == {(12, 5)}
    assert sum(r["kept"] for r in same) == 1  # one of the repeated rows


def test_drop_exact_keeps_columns(edge_docs, empty_docs):
    out = exact.drop_exact_copies(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == 10
    assert exact.drop_exact_copies(empty_docs).count() == 0


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (5, 3), (256, 16)])
def test_exact_any_tree(stored, runs, fan_in):
    rng = random.Random(runs)
    rows = [(i, f"text {rng.randint(0, 20)}") for i in range(200)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in
           exact.exact_groups(stored(rows, "doc_id long, text string"), runs=runs, fan_in=fan_in).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert got[i] == (max(same), len(same))


# ----------------------------------------------------------------- substrings
def brute_windows(rows, window):
    words = {i: WORDS.findall(t or "") for i, t in rows}
    first = {}
    for i, w in sorted(words.items()):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s:s + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_cover_has_every_shift():
    assert substrings.covers_all_shifts(substrings.COVER, substrings.PERIOD)
    assert not substrings.covers_all_shifts((0, 1), 7)
    with pytest.raises(ValueError):
        substrings.remove_repeated_windows(None, cover=(0, 1), period=7)


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_windows_match_brute_force(stored, monkeypatch, held):
    """Shared passages of all lengths around the window, at all shifts, inside random words."""
    monkeypatch.setattr(substrings, "HELD", held)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(160)]
    rows = [(0, None), (1, ""), (2, "a b c\x0bd\x1ce")]
    for i in range(3, 90):
        a = rng.randint(0, 90)
        cut = passage[a:a + rng.randint(45, 70)]
        noise = lambda: [f"n{rng.randint(0, 9)}" for _ in range(rng.randint(0, 80))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(noise() + cut + noise() + (cut if i % 7 == 0 else []))))
    rows += [(100, rows[50][1]), (101, rows[50][1]), (102, "z " * 400), (103, "z " * 300)]
    got = {r["doc_id"]: tuple(r)[1:] for r in
           substrings.remove_repeated_windows(stored(rows, "doc_id long, text string")).collect()}
    assert got == brute_windows(rows, 50)


def test_substring_edges(edge_docs, empty_docs):
    rows = {}
    for r in substrings.remove_repeated_windows(edge_docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == 16
    assert rows[0][0]["n_words"] == 0 and rows[7][0]["n_removed"] == 0
    assert rows[8][0]["n_removed"] == 30_000 and rows[8][0]["n_words"] == 30_001
    assert rows[6][0]["n_removed"] == 0  # repeats itself only
    assert substrings.remove_repeated_windows(empty_docs).count() == 0


# ----------------------------------------------------------------- near copies
def shingles(text, size=5):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("leaf,block", [(2, 3), (2048, 256)])
def test_near_groups_match_brute_force(stored, monkeypatch, leaf, block):
    """Chains of edits (links only between neighbours), a large star, a passage that many texts share."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", block)
    rng = random.Random(9)
    word = lambda: f"v{rng.randint(0, 5000)}"
    rows = [(0, None), (1, "  "), (2, "a b c"), (3, "A B c"), (4, "a b c d")]
    for g in range(6):
        text = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, len(text) // 40)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(150)]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = word()
        rows.append((len(rows), " ".join(own)))
    passage = [word() for _ in range(60)]
    rows += [(len(rows) + i, " ".join(passage + [word() for _ in range(60)])) for i in range(40)]
    rng.shuffle(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicate_groups(
        stored(rows, "doc_id long, text string"), leaf=leaf, depth=2).collect()}
    assert got == brute_components(rows)


def test_near_edges(edge_docs, empty_docs):
    rows = neardup.near_duplicate_groups(edge_docs).collect()
    assert len(rows) == 16
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == 0 and by[0]["kept"] and by[1]["kept"]
    assert by[4]["component_id"] == 3 and not by[4]["kept"]
    assert by[8]["component_id"] == 7
    assert by[12]["component_id"] is None and by[None]["kept"]  # a null id is the smallest
    assert neardup.near_duplicate_groups(empty_docs).count() == 0
    assert neardup.drop_near_copies(edge_docs).columns == edge_docs.columns


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
