import uuid

import pytest


@pytest.fixture
def stored(spark, tmp_path):
    """Write rows as a Parquet table and read it: the operators take stored tables."""
    def make(rows, schema, parts=3):
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)
    return make


WIDE = "doc_id long, text string, lang string, source string, n_chars long, row_no string, id int, run int, kept string"


@pytest.fixture
def edge_docs(stored):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "One", "a b c d", "word " * 300, long, long + " end", "x" * 50_000,
             "Émile ÉMILE émile", "same text of six words here", "same text of six words here"]
    rows = [(i, t, "en", "src0", 1, "r", i, 0, "k") for i, t in enumerate(texts)]
    rows += [(12, "same text of six words here", "en", "src0", 1, "r", 12, 0, "k")] * 2
    rows += [(None, "same text of six words here", None, None, None, None, None, None, None)]
    return stored(rows, WIDE)


@pytest.fixture
def empty_docs(stored):
    return stored([], WIDE, 1)
