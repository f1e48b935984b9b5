"""Rows that leave are the same ones when files are split and packed differently while a job runs, as after the loss or
the gain of an executor."""

from contextlib import contextmanager

import pytest

from chalkline.llm import decontaminate, exact, language

CORES = "spark.sql.files.minPartitionNum"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def docs(stored):
    """Files of unequal sizes, so that packing them anew changes their order."""
    rows = [(i, (ITEM if i % 7 == 0 else f"own text {i % 50} ") + " filler" * (i % 11), "en" if i % 3 else "xx", f"h{i % 3}")
            for i in range(200)]
    return stored(rows, "doc_id long, text string, lang string, source string", 6)


@contextmanager
def cores(spark, n):
    before = spark.conf.get(CORES, None)
    spark.conf.set(CORES, n)
    try:
        yield
    finally:
        spark.conf.unset(CORES) if before is None else spark.conf.set(CORES, before)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_exact_copies_that_leave(spark, docs):
    last = {r["text"]: r["doc_id"] for r in docs.orderBy("doc_id").collect()}
    with cores(spark, 1):
        out = exact.drop_exact_copies(docs, runs=4, fan_in=2)
    with cores(spark, 64):
        assert ids(out) == sorted(last.values())


def test_rejected_languages_that_leave(spark, docs):
    found = language.identify_documents(docs).collect()
    at = sorted({round(r["posterior"], 6) for r in found if r["lang"] != "und"})
    bar = (at[0] + at[-1]) / 2
    good = sorted(r["doc_id"] for r in found if r["lang"] != "und" and r["posterior"] >= bar)
    assert 0 < len(good) < 200
    with cores(spark, 1):
        out = language.drop_unknown_language(docs, accept=bar)
    with cores(spark, 64):
        assert ids(out) == good


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_contaminated_rows_that_leave(spark, docs, stored, broadcast_rows):
    items = stored([(1, ITEM)], "item_id long, text string", 1)
    with cores(spark, 1):
        out = decontaminate.drop_contaminated(docs, items, broadcast_rows=broadcast_rows)
    with cores(spark, 64):
        assert ids(out) == [i for i in range(200) if i % 7]


def test_shuffled_benchmark_numbers_the_texts_once(spark, docs, stored):
    """The branch for large benchmarks reads the texts again for their words and counts."""
    items = stored([(1, ITEM)], "item_id long, text string", 1)
    found = decontaminate.contamination(docs, items, broadcast_rows=0)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "monotonically_increasing_id" not in plan
    assert sorted(r["doc_id"] for r in found.filter("contaminated").collect()) == list(range(0, 200, 7))
