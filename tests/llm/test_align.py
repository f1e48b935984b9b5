"""Alignment of two tokenizers against a byte-by-byte version with unmodified tokenizers."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chalkline.llm import align
from chalkline.llm.packing import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, names = _byte_letters(), {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    each, count = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_parts, b_parts = [bytes(letters[c] for c in names[i]) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            each.append((doc, [], [], [], 0, ""))
            continue
        owner = [[k for k, p in enumerate(parts) for _ in p] for parts in (a_parts, b_parts)]
        links = sorted({(x, y) for x, y in zip(*owner, strict=True)})
        ends = [set(np.cumsum([len(p) for p in parts]).tolist()) for parts in (a_parts, b_parts)]
        groups, low = [], 0
        for cut in sorted(ends[0] & ends[1]):
            of = [sorted({o[k] for k in range(low, cut)}) for o in owner]
            groups.append(",".join(str(a[k]) for k in of[0]) + "|" + ",".join(str(b[k]) for k in of[1]))
            low = cut
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(pairs)
        each.append((doc, a, b, pairs, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((doc, len(a), len(b), g, len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), sha)
                   for doc, a, b, p, g, sha in each), key=str)


def rows():
    rng = random.Random(3)
    words = ["the", " of", "Straße", "naïve", "été", "日本語", "🙂🙂", "x1y2", "\n\n", "   ", "don't", "international", "—", "\t", "ﬁ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "a <|endoftext|> b </s> <s> <0x41>", "same text here", "same text here", "word " * 3000,
              "é" * 2000, "▁under▁", "\x00\x01", " leading and trailing  "]
    out = list(enumerate(texts))
    return out + [(5, "an id twice"), (None, "no id")]


@pytest.mark.parametrize("work,hot", [(align.WORK, align.HOT_PAIRS), (7, align.HOT_PAIRS), (16, 20), (1, 1)])
def test_alignment_matches_brute_force(stored, work, hot):
    table = stored([(i, t, "k", 1, "x") for i, t in rows()], "doc_id long, text string, key string, pair int, data string")
    out = align.align(table, A, B, work=work, hot_pairs=hot)
    assert out.columns == RESULT
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows())


def test_edges(edge_docs, empty_docs):
    out = align.align(edge_docs, A, B, work=512)
    want = brute([(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert align.align(empty_docs, A, B).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_merge_path_pieces_are_the_merged_order(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    a = np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n))
    b = np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n))
    work = int(rng.integers(1, 30))
    i, j = align.merge_path(a, b, work)
    assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    assert max(np.diff(i) + np.diff(j)) <= work + 1
    for k in range(1, len(i) - 1):  # all that a piece takes ends before what the next one takes
        before = max([0, *a[:i[k]][-1:], *b[:j[k]][-1:]])
        after = min([n + 1, *a[i[k]:i[k] + 1], *b[j[k]:j[k] + 1]])
        assert before < after
