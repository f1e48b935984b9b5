"""Wrapped and commented licence sentences, and SPDX expressions."""

import re

import pytest

from chalkline.llm import licenses


def found(stored, texts):
    rows = licenses.recognise(stored(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r["licenses"], r["n_unmatched"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_sentences_wrapped_anywhere(stored, prefix):
    """Every known sentence, each with a line end at every blank in turn (and so within each of its cues)."""
    s = licenses.SENTENCES
    words = s["unlicense"].split(" ")
    texts = [prefix + " ".join(words[:k]) + "\n" + prefix + " ".join(words[k:]) for k in range(1, len(words))]
    texts.append("\n".join(prefix + x for x in s["gpl-free"].split(" ")) + "\n"
                 + "\n".join(prefix + x for x in s["gpl-2-later"].split(" ")))
    assert found(stored, texts) == [("Unlicense", 0)] * (len(words) - 1) + [("GPL-2.0-or-later", 0)]


def test_every_known_sentence_holds_a_cue_when_wrapped():
    for s in licenses.known_sentences():
        for gap in ("\n", "\n# ", "\r\n * "):
            assert re.search(licenses._CUE, s.replace(" ", gap)), s


def test_spdx_expressions(stored):
    tag = "SPDX-License-Identifier: "
    cases = {"GPL-2.0-or-later": "GPL-2.0-or-later", "LGPL-2.1-or-later": "LGPL-2.1-or-later", "GPL-2.0+": "GPL-2.0-or-later",
             "GPL-2.0": "GPL-2.0-only", "MIT OR Apache-2.0": "MIT,Apache-2.0", "(MIT AND BSD-3-Clause) OR ISC": "MIT,BSD-3-Clause,ISC",
             "((GPL-2.0-only WITH Linux-syscall-note) OR MIT)": "MIT,GPL-2.0-only", "MIT or Unknown-1.0": "MIT",
             "AGPL-3.0-or-later": "AGPL-3.0-or-later", "MIT and more words": "MIT", "MIT-0": "", "(MIT)OR(ISC)": "MIT,ISC"}
    texts = [f"{a}{tag}{x}{b}" for x in cases for a, b in (("", ""), ("// ", "\nint x;"), ("Title\n/* ", " */\n\nx"))]
    assert found(stored, texts) == [(x, 0) for x in cases.values() for _ in range(3)]
