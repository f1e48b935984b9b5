"""The other operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chalkline.llm import decontaminate, language, licenses, packing, pii, quality, warc
from chalkline.llm.common import table

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


# ----------------------------------------------------------------- decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add("" if item is None else str(item))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[s:s + m])):
                    hit.update(range(s, s + m))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_contamination_matches_brute_force(stored, broadcast_rows):
    """Items shorter than a window, repeated items, partial and whole passages, small vocabularies with ties."""
    rng = random.Random(6)
    w = lambda n, v: [f"{rng.choice('aBc')}{rng.randint(0, v)}" for _ in range(n)]
    items = [(1, None), (2, ""), (3, "Solo"), (4, "two Words"), (5, " ".join(w(5, 99))), (6, " ".join(w(9, 99)))]
    items += [(7 + i, " ".join(w(rng.randint(10, 40), 400))) for i in range(15)]
    items += [(30, items[10][1]), (31, "q " * 14), (None, items[11][1]), (30, items[10][1])]
    docs = [(0, None), (1, ""), (2, "q " * 30), (3, "solo, SOLO! two-words"), (4, "é " * 20)]
    for i in range(5, 70):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(own) - 8))
            parts += w(rng.randint(0, 12), 400) + own[a:a + rng.randint(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts).upper()))
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(
        stored(docs, DOC), stored(items, "item_id long, text string"), broadcast_rows=broadcast_rows).collect()}
    assert got == brute_contamination(docs, items)


def test_contamination_edges(edge_docs, empty_docs, stored):
    none = stored([], "item_id long, text string", 1)
    assert decontaminate.contamination(edge_docs, none).filter("not contaminated").count() == 16
    items = stored([(1, "same text of six words here")], "item_id long, text string")
    rows = decontaminate.contamination(edge_docs, items)
    assert rows.count() == 16 and rows.filter("n_hit = 6 and n_items = 1").count() == 5
    kept = decontaminate.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == 11
    assert decontaminate.contamination(empty_docs, items).count() == 0


# ----------------------------------------------------------------- packing
@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_piece_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 3000).astype(int), 1, 2048)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
    bins = packing.plan_bins(counts)
    packed = {}
    for own, times in bins:
        assert sum(own) <= 2048
        for x in own:
            packed[x] = packed.get(x, 0) + times
    assert packed == counts
    assert sum(t for _, t in bins) <= -(-lengths.sum() // 2048) + 2
    assert packing.plan_bins({}) == []
    with pytest.raises(ValueError):
        packing.plan_bins({2049: 1})


def test_two_smaller_pieces_replace_the_smallest():
    # greedy: 6 + 3, gap 1; the 3 goes out and 2 + 2 fill the gap of 4
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_pieces_are_the_tokens_and_sequences_have_no_gap(stored, edge_docs, empty_docs):
    from tokenizers import Tokenizer
    rng = random.Random(2)
    texts = ["a  b", "a \n b", "\n a", "x ", "  ", "don't <|endoftext|> it's x  y", "a\n\nb c\n\n d", "1 234 a\tb \t c",
             "w" * 5000, "💬 é  b", None, ""]
    texts += [" ".join(rng.choice(["Haus", "été", "x1.", "\n", "(ok)", "word,"]) for _ in range(rng.randint(1, 4000)))
              for _ in range(40)]
    rows = list(enumerate(texts))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    got = packing.pack_documents(stored(rows, DOC), TOKENIZER).collect()
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(range(len(rows)))
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            data = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(data))
            assert r["length"] == 2048 or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    edge = packing.pack_documents(edge_docs, TOKENIZER)
    assert edge.filter("piece = 0").count() == 16
    assert packing.pack_documents(empty_docs, TOKENIZER).count() == 0


# ----------------------------------------------------------------- quality
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality.score(docs, quality.fit(docs, labels))
    out = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(out) > 60 and auc > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
    ids = [r["doc_id"] for r in scored.filter("held_out").collect()]
    assert sorted(ids) == [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2]


def test_quality_edges(edge_docs, empty_docs, stored):
    labels = stored([(3, 1, 0), (6, 0, 0), (7, None, None), (999, 1, 0), (None, 1, 0)],
                    "doc_id long, quality int, toxic int")
    rows = quality.score(edge_docs, quality.fit(edge_docs, labels)).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit(edge_docs, labels.limit(0))
    assert {r["score"] for r in quality.score(edge_docs, none).collect()} == {0.5}
    assert quality.score(empty_docs, none).count() == 0


# ----------------------------------------------------------------- language
def test_language_of_documents_and_pages(spark):
    docs = table(spark, SF, "documents")
    rows = language.identify_documents(docs).join(docs.select("doc_id", F.col("lang").alias("said")), "doc_id").collect()
    assert len(rows) == 200 and np.mean([r["lang"] == r["said"] and r["accepted"] for r in rows]) > 0.97
    assert language.identify_pages(table(spark, SF, "pages")).filter("accepted").count() >= 48


def test_wrong_declaration_and_weak_text_are_outvoted(spark, stored):
    """A long French text that says "en" is French; a text without words takes its host's language."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", F.concat("lang", F.lit(".example")).alias("source"))
    french = docs.filter("lang = 'fr' and length(text) > 800").first()
    odd = stored([(9001, french["text"], "en", "fr.example"), (9002, "", None, "de.example"), (9003, "7", None, "es.example")],
                 "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["lang"] for r in language.identify_documents(docs.unionByName(odd)).collect()}
    assert (got[9001], got[9002], got[9003]) == ("fr", "de", "es")


def test_language_edges(edge_docs, empty_docs):
    assert language.identify_documents(edge_docs).count() == 16
    assert language.identify_documents(empty_docs).count() == 0
    assert language.drop_unknown_language(edge_docs).columns == edge_docs.columns


# ----------------------------------------------------------------- personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(x) * 2 - 9 * (x > "4")) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, re_ in BASE.items():
        for m in re.finditer(re_, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_brute_force_and_long_runs_end(stored):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("a1@.+- 5(9)%_é\n0:💬x,") for _ in range(rng.randint(0, 120)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5005, "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (706) 555-3138 💬 a@b.co a@b.c_d@e.f")]
    slow = [(6000, "x" * 200_000), (6001, "1" * 100_000), (6002, "a.b" * 50_000 + "@x"), (6003, "1.1." * 30_000)]
    got = {r["doc_id"]: r for r in pii.personal_data(stored(rows + slow, DOC)).collect()}
    for i, text in rows:
        spans = base_spans(text)
        text_form = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text_form.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert set(text_form.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert got[6000]["spans"] == got[6001]["spans"] == got[6002]["spans"] == ""


def test_contexts_find_unseen_identifiers(stored):
    rows = [(i, f"please contact user{i}@site{i}.org today") for i in range(20)]
    rows += [(100, "please contact bob9[at]site.org today"), (101, "room 9a is free")]
    got = {r["doc_id"]: r for r in pii.personal_data(stored(rows, DOC)).collect()}
    assert got[100]["spans"] == "email:15:31" and got[100]["n_email"] == 0 and got[100]["n_found"] == 1
    assert got[101]["spans"] == ""


def test_pii_edges(edge_docs, empty_docs):
    assert pii.personal_data(edge_docs).filter("spans = ''").count() == 16
    assert pii.personal_data(empty_docs).count() == 0


# ----------------------------------------------------------------- WARC
def test_warc_round_trip(spark, stored, tmp_path):
    pages = stored([(1, "http://a.org/x", "<html lang=\"en\"><head><title>T &amp; t</title></head><body><p>a&lt;b&#233;&#0;"
                     "<br>c <a href=\"/l\">link</a><script>x<p></script></body>"), (2, None, None),
                    (3, "http://b.org/\r\nX: y", "<p>one\r\n\r\nWARC-like</p>"), (3, "http://b.org/\r\nX: y", "")],
                   "page_id long, url string, html string")
    records = warc.derive(warc.page_responses(pages))
    rows = records.collect()
    assert len(rows) == 8
    text = next(r for r in rows if r["page_id"] == 1 and r["type"] == "conversion")
    assert text["block"] == "a<bé�\nc link"
    for r in rows:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert f"WARC-Refers-To: {r['refers_to']}" in r["headers"] and len(r["headers"].split("\r\n")) in (11, 12)
    meta = next(r for r in rows if r["page_id"] == 1 and r["type"] == "metadata")["block"]
    assert "title: T &amp; t" in meta and "outlink: /l" in meta and "language: en" in meta
    for how in ("gzip", "none"):
        warc.write_warc(records, str(tmp_path / how), how)
        back = warc.read_warc(spark, str(tmp_path / how)).collect()
        assert all(b["complete"] for b in back)
        assert sorted((b["headers"]["warc-record-id"], b["block"]) for b in back) == sorted(
            (r["record_id"], r["block"]) for r in rows)
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


# ----------------------------------------------------------------- licences
def test_license_texts_and_notices(stored):
    s = licenses.SENTENCES
    mit = "Copyright (c) 2020 A. B.\n\n" + s["mit-grant"].replace(" and ", "\nand ", 1) + "\n\n" + s["mit-notice"]
    rows = [(1, mit), (2, None), (3, ""), (4, "Title\nReleased under the MIT License\nmore. Licensed under CC BY-NC 4.0."),
            (5, "# SPDX-License-Identifier: Apache-2.0\ncode"),
            (6, " ".join(s[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")) + " All rights reserved."),
            (7, "the license is unknown"), (8, " ".join(s[x] for x in ("bsd-grant", "bsd-source", "bsd-binary"))),
            (9, s["gpl-free"] + " " + s["gpl-2-later"]), (9, "All rights reserved. " * 3)]
    got = [(r["doc_id"], r["licenses"], r["n_unmatched"]) for r in licenses.recognise(stored(rows, DOC)).collect()]
    assert sorted(got) == [(1, "MIT", 1), (2, "", 0), (3, "", 0), (4, "MIT,CC-BY-NC-4.0", 0), (5, "Apache-2.0", 0),
                           (6, "BSD-3-Clause,All-rights-reserved", 0), (7, "", 0), (8, "BSD-2-Clause", 0),
                           (9, "All-rights-reserved", 0), (9, "GPL-2.0-or-later", 0)]


def test_license_notices_of_the_corpus(spark, edge_docs, empty_docs):
    """The notices that the generated documents hold, found by plain search."""
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
               "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r["licenses"] for r in licenses.recognise(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        for text, name in notices.items():
            assert (name in got[r["doc_id"]].split(",")) == (text in r["text"])
    assert licenses.recognise(edge_docs).count() == 16 and licenses.recognise(empty_docs).count() == 0
