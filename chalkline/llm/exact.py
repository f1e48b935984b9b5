"""Exact dedup by a tree merge of sorted digest runs (DataFrame functions only).

Rows are dealt into ``runs`` runs. Each run is reduced to one line per digest
(level 0), then runs merge ``fan_in`` at a time in rounds until one is left. A
line keeps the identifier that stays and the group's size at every level, so a
text that a third of all rows carry is ``runs`` lines after the first round and
never one group of rows in one task. The answer then goes down the same tree:
root to level 0 to rows, and a hot text's rows are spread over all runs there
too.

Verified: a line's key is the SHA-256 digest, an independent 64-bit hash and the
length of the normalised text, so two texts merge only if all three agree.

Defined cases: a null text counts as empty, and empty texts are equal; texts are
equal when identical after lower-casing A-Z only. The largest id stays; a null id
is smaller than any other. Rows that repeat one id and one text give one row each,
and exactly one of them is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import ascii_lower, row_key, row_number, saved

KEY = ["sha", "check", "length"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256,
            row_no: str | None = None) -> DataFrame:
    """(doc_id, row_no, sha, check, length, run) of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), row_number(row_no).alias("row_no"),
                    ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    return d.select("doc_id", "row_no", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("check"),
                    F.octet_length("norm").alias("length"),
                    F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(runs)).cast("int").alias("run"))


def merge_levels(rows: DataFrame, runs: int, fan_in: int) -> list[DataFrame]:
    """Level 0 (one line per run and digest) up to the root (run 0), each saved and sorted by run and digest."""
    level = rows.groupBy("run", *KEY).agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count("*").alias("n"))
    levels = [saved(level.sortWithinPartitions("run", "sha"), "digest-run")]
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (levels[-1].withColumn("run", F.expr(f"cast(run div {fan_in} as int)")).groupBy("run", *KEY)
                 .agg(F.max("keep").alias("keep"), F.sum("n").alias("n")))
        levels.append(saved(level.sortWithinPartitions("run", "sha"), "digest-run"))
    return levels


def answer_down(levels: list[DataFrame], fan_in: int) -> DataFrame:
    """Level 0 with the root's answer: (run, key, keep, n)."""
    answer = levels[-1]
    for level in reversed(levels[:-1]):
        parent = answer.select(F.col("run").alias("parent"), *KEY, "keep", "n")
        answer = (level.select("run", *KEY, F.expr(f"cast(run div {fan_in} as int)").alias("parent"))
                  .join(parent, ["parent", *KEY]).select("run", *KEY, "keep", "n"))
    return answer


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256,
                 fan_in: int = 16, row_no: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_no (of the column ``row_no``, if given)."""
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    rows = saved(digests(docs, id_col, text_col, runs, row_no), "digest-rows")
    answer = answer_down(merge_levels(rows, runs, fan_in), fan_in)
    return rows.join(answer, ["run", *KEY]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"), F.col("sha").alias("text_sha256"), "row_no")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256,
                      fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is named by a hash of its id and text. Rows that are alike in both would all stay; where there are such, one of
    them is picked. The dropped rows' names are the smaller side of the anti join.
    """
    rows, key = row_key(docs, id_col, text_col)
    groups = saved(exact_groups(rows, id_col, text_col, runs, fan_in, key).select(
        F.col("row_no").alias(key), "kept"), "digest-kept")
    left = rows.join(groups.filter(~F.col("kept")), key, "left_anti")
    twice = saved(groups.filter("kept").groupBy(key).count().filter("count > 1").select(key), "digest-twice")
    if twice.limit(1).count():
        left = left.join(twice, key, "left_anti").unionByName(
            left.join(twice, key, "left_semi").dropDuplicates([key]))
    return left.drop(key)
