"""Identifiers that only a long chain of contexts reaches, and labels far from their values."""

from chalkline.llm import pii

DOC = "doc_id long, text string"
LETTERS = "abcdefgh"


def test_chains_of_any_length(stored):
    """Values of step k stand after label k and label k + 1: each round reaches one step more."""
    rows = [f"lab{LETTERS[0]} user{i}@site{i}.org" for i in range(20)]
    for k in range(5):
        rows += [f"lab{LETTERS[k + side]} {LETTERS[k]}{i}z" for i in range(20) for side in (0, 1)]
    got = {r["doc_id"]: r for r in pii.personal_data(stored(list(enumerate(rows)), DOC), accept=0.45).collect()}
    assert [got[i]["spans"].partition(":")[0] for i in range(len(rows))] == ["email"] * len(rows)
    few = pii.personal_data(stored(list(enumerate(rows)), DOC), accept=0.45, rounds=3)
    assert few.filter("spans = ''").count() > 0


def test_labels_far_away(stored):
    rows = [(i, f"contact user{i}@site{i}.org") for i in range(20)]
    rows += [(100, "contact " + "." * 300 + " bob9[at]site.org"), (101, "contact" + " " * 5000 + "eve9[at]site.org")]
    rows += [(200 + i, f"+1 555 0100 {i:03d}" + " _" * 100 + " desk") for i in range(20)]
    got = {r["doc_id"]: r for r in pii.personal_data(stored(rows, DOC)).collect()}
    assert got[100]["spans"].startswith("email:") and got[101]["spans"].startswith("email:")
    spans = pii.occurrences(stored(rows, DOC)).filter("kind = 'phone'").select("after").distinct().collect()
    assert [r["after"] for r in spans] == ["desk"]
