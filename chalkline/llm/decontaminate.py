"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A
window is ``span`` consecutive words of an item; an item of fewer words is one
window. A document word inside any occurrence of a window is hit.

Winnowing keeps, of every ``w`` consecutive k-gram hashes, the smallest (the first
of equals). Two texts that share ``k + w - 1`` words keep the same k-gram of it, so
with ``k + w - 1 = span`` every shared window has a common fingerprint. Documents
and items are fingerprinted alike, fingerprints are joined, and each hit is
extended word by word to both sides, as far as a window that contains it can
reach; a run of ``span`` equal words is a hit. Equal words are compared, not
hashes. An item of m < span words is found by fingerprints of its own length.

The benchmark's fingerprints are broadcast while there are at most
``BROADCAST_ROWS`` of them; a larger benchmark is joined by shuffle on the hash and
the words of the documents that were hit are fetched afterwards, by numbers that
are written with the texts once.

Defined cases: a null or empty text has no words, and an item without words hits
nothing. Repeated documents give one row each; repeated items count once by
item_id, a null item_id as the empty string. An empty benchmark hits nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import ROW_NO, ascii_lower, numbered, row_key, row_number, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 10
#: Fingerprints of a benchmark (about 300 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_and_window(span: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = span."""
    k = max(1, span // 2)
    return k, span - k + 1


def fingerprints(texts: DataFrame, span: int) -> DataFrame:
    """``texts`` (any columns, ``words``) with ``picks``: the (at, hash) kept by winnowing, at from 1.

    Each step is a projection of its own that uses the array before it twice, so that
    the optimizer never moves an array's computation into another one's lambda. Explode ``picks`` with
    ``explode_outer``: for ``explode`` the optimizer would push a test of the array's size below all steps.
    """
    k, w = gram_and_window(span)
    at = lambda name, n: ", ".join(f"get({name}, i + {j})" for j in range(n))  # noqa: E731  slice() would copy the array
    least = f"least({at('packed', w)})" if w > 1 else "x"
    return (
        texts
        .withColumn("grams", F.expr(f"""if(size(words) < {span}, cast(array() as array<bigint>),
             transform(words, (x, i) -> if(i <= size(words) - {k}, xxhash64({at('words', k)}), null)))"""))
        .withColumn("packed", F.expr("transform(grams, (x, i) -> shiftleft(x, 32) | (i + 1))"))
        .withColumn("least", F.expr(f"transform(packed, (x, i) -> {least})"))
        .withColumn("picks", F.expr("""
             transform(filter(least, (x, i) -> x is not null and (i = 0 or x <> get(least, i - 1))),
                       x -> named_struct('at', cast(x & 4294967295 as int),
                                         'hash', get(grams, cast((x & 4294967295) - 1 as int))))"""))
        .drop("grams", "packed", "least"))


def item_fingerprints(items: DataFrame, spans: list[int], span: int) -> DataFrame:
    """(hash, span, around, core, item_ids): each kept k-gram, the words around it that a window with it can
    reach, the gram's place among them, and the items that have just this."""
    out = None
    for m in spans:
        k, w = gram_and_window(m)
        own = items.filter(F.size("words") >= m if m == span else F.size("words") == m)
        own = (fingerprints(own, m).select("item_id", "words", F.explode_outer("picks").alias("pick"))
               .filter("pick is not null")
               .withColumn("low", F.expr(f"greatest(1, pick.at - {w - 1})"))
               .select(F.col("pick.hash").alias("hash"), F.lit(m).alias("span"),
                       F.expr(f"""transform(sequence(low - 1, least(size(words), pick.at + {k + w - 2}) - 1),
                                  j -> get(words, j))""").alias("around"),
                       F.expr("pick.at - low + 1").alias("core"), "item_id"))
        out = own if out is None else out.unionByName(own)
    return (out.groupBy("hash", "span", "around", "core")
            .agg(F.collect_set("item_id").alias("item_ids")))


def _run(step: str, most: str) -> str:
    """How many words in a row are equal, going from the gram to one side."""
    return f"""aggregate(sequence(1, {most}), 0, (n, j) -> if(n = j - 1 and
               get(words, at {step}) = get(around, core {step}), j, n))"""


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS, row_no: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, row_no: one row per input row.
    ``docs`` is a stored table; ``row_no`` names a column of row numbers, without which the rows are numbered here."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"),
                             words_of(F.col(item_text_col)).alias("words")).filter(F.size("words") > 0)
    short = sorted(r[0] for r in items.filter(F.size("words") < span).select(F.size("words")).distinct().collect())
    spans = [*short, span]
    prints = saved(item_fingerprints(items, spans, span), "item-fingerprints")
    # the words are needed beside every fingerprint, but only a row that meets an item's is ever written out
    few = prints.count() <= broadcast_rows
    if not few and row_no is None:   # the texts are read three times below
        docs, row_no = numbered(docs.select(*dict.fromkeys([id_col, text_col]))), ROW_NO
    base = docs.select(row_number(row_no).alias("row_no"), F.col(id_col).alias("doc_id"),
                       words_of(F.col(text_col)).alias("words"))

    # one row without a fingerprint for each document, for n_words, and those for all spans
    every = base.withColumn("all", F.expr("array(cast(null as struct<at: int, hash: bigint, span: int>))"))
    for m in spans:
        every = fingerprints(every, m).withColumn("all", F.expr(
            f"concat(all, transform(picks, x -> named_struct('at', x.at, 'hash', x.hash, 'span', {m})))")).drop("picks")
    every = (every.select("row_no", "doc_id", F.size("words").alias("n_words"), "words", F.explode_outer("all").alias("pick"))
             .select("row_no", "doc_id", "n_words", "words", "pick.at", "pick.hash", "pick.span"))
    if few:
        met = every.join(F.broadcast(prints), ["hash", "span"], "left").filter("at is null or core is not null")
    else:
        hits = every.select("row_no", "at", "hash", "span").join(prints, ["hash", "span"])
        met = hits.join(base, "row_no").withColumn("n_words", F.size("words"))
        bare = base.select("row_no", "doc_id", F.size("words").alias("n_words"))
        met = met.unionByName(bare, allowMissingColumns=True)
    sizes = {m: gram_and_window(m) for m in spans}
    gram = F.expr("case " + " ".join(f"when span = {m} then {k}" for m, (k, _) in sizes.items()) + " end")
    reach = F.expr("case " + " ".join(f"when span = {m} then {w - 1}" for m, (_, w) in sizes.items()) + " end")
    # get() counts from 0: the word j before the gram is at - 1 - j, the word j after it at - 1 + k - 1 + j
    sided = (met.withColumn("k", gram).withColumn("reach", F.greatest(reach, F.lit(1)))
             .withColumn("before", F.expr(f"if(span = 1, 0, {_run('- 1 - j', 'reach')})"))
             .withColumn("after", F.expr(f"if(span = 1, 0, {_run('+ k - 2 + j', 'reach')})")))
    whole = F.expr("""at is not null and before + k + after >= span and
                      forall(sequence(0, k - 1), j -> get(words, at - 1 + j) = get(around, core - 1 + j))""")
    hit = sided.select(
        "row_no", "doc_id", "n_words",
        F.when(whole, F.expr("named_struct('from', at - before, 'to', at + k + after)")).alias("run"),
        F.when(whole, F.col("item_ids")).alias("item_ids"))
    per = hit.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.collect_set("run").alias("runs"), F.collect_set("item_ids").alias("item_ids"))
    covered = """aggregate(sort_array(runs), named_struct('n', 0L, 'upto', 0),
                 (a, x) -> named_struct('n', a.n + greatest(0, x.to - greatest(a.upto, x.from)),
                                        'upto', greatest(a.upto, x.to)), a -> a.n)"""
    return (per.withColumn("n_hit", F.expr(covered))
            .withColumn("item_ids", F.sort_array(F.array_distinct(F.flatten("item_ids"))))
            .select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                    F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"), "item_ids", "row_no"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, id_col: str = "doc_id",
                      text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` (a stored table) without a hit word, with all their columns."""
    rows, key = row_key(docs, id_col, text_col)   # rows that are alike are judged alike
    bad = contamination(rows, benchmark, span, id_col, text_col, row_no=key, **columns).filter("contaminated")
    bad = saved(bad.select(F.col("row_no").alias(key)), "contaminated")
    return rows.join(bad, key, "left_anti").drop(key)
