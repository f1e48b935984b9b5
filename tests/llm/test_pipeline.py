"""The pipeline against a brute-force version of its stages, and what every stage must keep."""

import corpus_pipeline
from chalkline.llm import language
from chalkline.llm.common import table
from tests.llm.test_dedup import LOWER, brute_components
from tests.llm.test_operators import brute_contamination

SF = "/root/testdata/sf0.001"


def brute_kept(spark, sf):
    """Ids that stay; language ID is taken from its operator, which has tests of its own."""
    docs = table(spark, sf, "documents")
    known = {r["doc_id"] for r in language.identify_documents(docs).filter("accepted").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in known}
    last = {}
    for i in sorted(texts):
        last[texts[i].translate(LOWER)] = i
    rows = [(i, texts[i]) for i in sorted(last.values())]
    groups = brute_components(rows)
    rows = [(i, t) for i, t in rows if groups[i][2]]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    bad = brute_contamination(rows, items)
    return {i for i, _ in rows if not bad[i][4]}


def test_pipeline_keeps_what_brute_force_keeps(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == brute_kept(spark, SF)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_columns_on_edge_rows(spark, edge_docs, empty_docs, tmp_path):
    for name, docs in (("edge", edge_docs), ("empty", empty_docs)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == 0 if name == "empty" else docs.count() > 0


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_dedup", "decontamination", "best_fit_packing"]
