"""The ids of the registered queries are those of the tokenizer as its JSON has it, added tokens included."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chalkline.llm import catalog

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_in_texts(spark, stored, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  z ", "<|endoftext| >", "no token", "", None,
             "word " * 3000 + "<|endoftext|>"]
    stored(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for rows in (catalog.op10_best_two_fit(spark, str(tmp_path)).collect(),
                 corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).collect()):
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r)
        for i, text in enumerate(texts):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            own = sorted(by[i], key=lambda r: r["start"])
            assert sum(r["length"] for r in own) == len(ids)
            for r in own:
                data = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
                assert r["ids_crc32"] == zlib.crc32(data), text
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
