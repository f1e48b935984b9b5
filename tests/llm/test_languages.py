"""Languages come from the table; hosts of any frequency meet the same priors."""

import random

import pytest

from chalkline.llm import language

WORDS = {"en": "the and of with from house river green people work", "de": "der und das mit von haus fluss leute arbeit schön",
         "it": "il che della con dalla casa fiume verde gente lavoro"}


@pytest.fixture
def docs(stored):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = ("it", "en", "de", "it")[i % 4]
        host = "hot" if i % 3 == 0 else f"host.{i % 40}"
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(40)), lang if i % 5 else None, host))
    rows += [(900 + i, "zzz qqq", "toolongtag", "x") for i in range(15)] + [(950, "rare words", "pt", "y")]
    return stored(rows, "doc_id long, text string, lang string, source string")


def test_languages_of_the_table(docs):
    from pyspark.sql import functions as F
    assert language.declared_languages(docs, F.col("lang")) == ("de", "en", "it")


def test_a_fifth_language_is_kept(docs):
    out = {r["doc_id"]: r for r in language.identify_documents(docs).collect()}
    italian = [out[i] for i in range(400) if i % 4 in (0, 3)]
    assert {r["lang"] for r in italian} == {"it"} and all(r["accepted"] for r in italian)
    kept = {r["doc_id"] for r in language.drop_unknown_language(docs).collect()}
    assert {i for i in range(400)} <= kept


def test_hosts_by_shuffle_and_by_broadcast_agree(docs, monkeypatch):
    def result():
        return sorted((r["doc_id"], r["lang"], round(r["posterior"], 9)) for r in language.identify_documents(docs).collect())
    many = result()
    monkeypatch.setattr(language, "HOST_NUMBERS", 12)     # three hosts are broadcast, the others are not
    assert result() == many


def test_no_declared_language(stored):
    docs = stored([(i, "some words here", None, None) for i in range(20)], "doc_id long, text string, lang string, source string")
    assert {r["lang"] for r in language.identify_documents(docs).collect()} == {"und"}


def test_clashing_names_stay(stored):
    docs = stored([(i, f"the and of words {i % 7}", "en", "h", f"mine{i}") for i in range(30)],
                  "doc_id long, text string, lang string, source string, __row_no string")
    out = language.drop_unknown_language(docs)
    assert out.columns == docs.columns
    assert {r["__row_no"] for r in out.collect()} <= {f"mine{i}" for i in range(30)}
    from chalkline.llm import exact
    out = exact.drop_exact_copies(docs)
    assert out.columns == docs.columns and out.count() == 7
