"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over ``languages`` and "und" (no known
language):

* text: a hashed byte-trigram model of each language, estimated over all rows from
  their declared languages (which may be wrong now and then); "und" spreads evenly.
  Overlapping trigrams are dependent, so the log likelihood counts ``TEMPER`` of itself;
* the declared (markup) language, by how often each language declares it;
* the address suffix, likewise;
* the host: a prior smoothed from all rows over the domain to the host, each level
  leaning on the one above with the weight of ``LEAN`` rows. A row's own share is left
  out of its host's counts.

Counts of hosts, domains, suffixes and declarations are grouped aggregates of the
text posteriors. The languages are the tags that at least ``LEAST_ROWS`` rows of the table
declare; other declarations are one value. The trigram model has languages x ``BUCKETS``
numbers (and "und"), the broadcast host priors at most ``HOST_NUMBERS`` of each kind; rows
of rarer hosts meet theirs by a shuffle, so a hot host's rows are never dealt to one task.

Defined cases: a text without trigrams leaves the other evidence; a null host,
domain or suffix is the empty string's; a null declaration is "none". Equal rows
are judged each for itself. A row is accepted if its best language is not "und" and
its posterior is at least ``ACCEPT``. Ties go to the first language in order. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import _GAP, arrow_batches, memory_back, row_key, row_number, saved, slices, text_bytes

#: A declared language is a class if it is a two- or three-letter tag of at least this many rows; of more such tags than
#: the second number (no table of natural languages has them) the most frequent ones are.
LEAST_ROWS, MOST_LANGUAGES = 10, 256
#: Tags that name no language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
#: Numbers of host priors that are broadcast; rows of other hosts meet theirs by a shuffle.
HOST_NUMBERS = 2_000_000
#: Texts of an Arrow batch.
BATCH_ROWS = 500
BUCKETS = 1 << 14
TEMPER, LEAN, ACCEPT = 0.3, 10.0, 0.6
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[_GAP] = 32


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams of every row."""
    data, offsets = text_bytes(column)
    value = _FOLD[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = max(0, len(value) - 2)
    mixed = (value[:n] | value[1:n + 1] << np.uint32(8) | value[2:n + 2] << np.uint32(16)) * np.uint32(0x9E3779B1)
    at = np.flatnonzero(row[:n] == row[2:n + 2])
    return row[at], (mixed[at] >> np.uint32(18)).astype(np.int64)


def _tag(col: Column) -> Column:
    """The main tag of a declared language; empty if there is none."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*([A-Za-z]*)", 1)))


def declared_languages(docs: DataFrame, declared: Column, least_rows: int = LEAST_ROWS) -> tuple[str, ...]:
    """The languages that the table itself declares, in order of their names."""
    tags = docs.select(_tag(declared).alias("tag")).filter(F.length("tag").between(2, 3) & ~F.col("tag").isin(*NO_LANGUAGE))
    found = (tags.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least_rows)
             .orderBy(F.desc("n"), "tag").limit(MOST_LANGUAGES).collect())
    return tuple(sorted(r["tag"] for r in found))


def _declared(col: Column, languages: tuple[str, ...]) -> Column:
    """The declared language's main tag if it is one of ``languages``, "none" if there is none, else "other"."""
    tag = _tag(col)
    return F.when(tag.isin(*languages), tag).when(tag == "", "none").otherwise("other")


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probabilities, BUCKETS x (languages and "und"), from rows (text, declared)."""
    at = {x: i for i, x in enumerate(languages)}

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lang = np.array([at.get(x, -1) for x in part.column(1).to_pylist()])
                row, bucket = trigrams(part.column(0))
                known = lang[row] >= 0
                counts += np.bincount(lang[row][known] * BUCKETS + bucket[known],
                                      minlength=counts.size).reshape(counts.shape)
            memory_back()
        i, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(counts[i, b])], ["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    total = rows.select("text", "declared").mapInArrow(run, "lang long, bucket long, n long")
    for r in total.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["bucket"]] = r["n"]
    smooth = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return np.vstack([smooth, np.full(BUCKETS, -np.log(BUCKETS))]).T.astype(np.float32)


def _likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` (row_no, text, ...) with ``ll`` in place of text: the tempered log likelihood of each class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in rows.columns if c != "text"]

    def run(batches):
        table = sent.value
        classes = table.shape[1]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, bucket = trigrams(part.column(part.schema.get_field_index("text")))
                ll = np.stack([np.bincount(row, table[:, k][bucket], minlength=part.num_rows)
                               for k in range(classes)], axis=1) * TEMPER
                ll -= ll.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in rest),
                     pa.ListArray.from_arrays(np.arange(0, ll.size + 1, classes, dtype=np.int32), ll.ravel())],
                    [*rest, "ll"])
            memory_back()

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{kept}, ll array<double>")


def _sums(classes: int) -> list[Column]:
    return [F.count("*").alias("rows"), F.array(*[F.sum(F.col("p")[k]) for k in range(classes)]).alias("mass")]


def _smoothed(mass: str, rows: str, parent: str) -> Column:
    return F.expr(f"transform({mass}, (m, i) -> (m + {LEAN} * {parent}[i]) / ({rows} + {LEAN}))")


def _with_host(scored: DataFrame, by_host: DataFrame, most: int) -> DataFrame:
    """``scored`` beside its host's row. The ``most`` frequent hosts are broadcast, so no key of the shuffle is hot."""
    key = ["host", "domain", "suffix"]
    by_host = saved(by_host, "hosts")
    if by_host.count() <= most:
        return scored.join(F.broadcast(by_host), key)
    hot = saved(by_host.orderBy(F.desc("rows"), *key).limit(most), "hot-hosts")
    rest = scored.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return scored.join(F.broadcast(hot), key).unionByName(rest.join(by_host, key))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None,
             host: Column | None = None, domain: Column | None = None, suffix: Column | None = None,
             languages: tuple[str, ...] | None = None, accept: float = ACCEPT,
             row_no: str | None = None) -> DataFrame:
    """doc_id, lang, posterior, accepted, text_lang, declared, row_no: one row per input row.

    ``declared``, ``host``, ``domain`` and ``suffix`` are expressions over ``docs`` (a stored table);
    absent ones say nothing. ``languages`` are those that the table declares, unless given. ``row_no`` names a column that
    tells rows apart; without it the rows are numbered here.
    """
    if languages is None:
        languages = declared_languages(docs, declared) if declared is not None else ()
    said = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    names = F.array(*[F.lit(x) for x in (*languages, "und")])
    classes = len(languages) + 1
    rows = docs.select(row_number(row_no).alias("row_no"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       _declared(said(declared), languages).alias("declared"), said(host).alias("host"),
                       said(domain).alias("domain"), said(suffix).alias("suffix"))
    share = "aggregate(transform(ll, x -> exp(x)), 0D, (a, x) -> a + x)"
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        ll = _likelihoods(rows, text_model(rows, languages))
        scored = saved(ll.withColumn("p", F.expr(f"transform(ll, x -> exp(x) / {share})")), "language-text")

    total = scored.agg(*_sums(classes)).first()
    mass = [x or 0.0 for x in total["mass"]]
    prior = [(m + 1) / ((total["rows"] or 0) + classes) for m in mass]
    given = [x / sum(prior) for x in prior]
    top = F.array(*[F.lit(x) for x in given])
    by_domain = scored.groupBy("domain").agg(*_sums(classes)).withColumn("top", top)
    by_domain = by_domain.select("domain", _smoothed("mass", "rows", "top").alias("above"))
    by_suffix = scored.groupBy("suffix").agg(*_sums(classes))
    likes = F.expr("transform(mass, (m, i) -> ln((m + 1) / (whole[i] + 20)))")
    by_suffix = (by_suffix.withColumn("whole", F.array(*[F.lit(x) for x in mass]))
                 .select("suffix", likes.alias("suffix_ll")))
    by_host = (scored.groupBy("host", "domain", "suffix").agg(*_sums(classes))
               .join(by_domain, "domain").join(by_suffix, "suffix")
               .select("host", "domain", "suffix", "rows", "mass", "above", "suffix_ll"))
    seen = {r["declared"]: r["mass"] for r in scored.groupBy("declared").agg(*_sums(classes)).collect()}
    values = (*languages, "none", "other")
    log = {v: [float(np.log((seen.get(v, [0.0] * classes)[k] + 1) / (mass[k] + len(values)))) for k in range(classes)]
           for v in values}
    said_ll = F.create_map(*[x for v in values for x in (F.lit(v), F.array(*[F.lit(y) for y in log[v]]))])

    own = _with_host(scored, by_host, max(1, HOST_NUMBERS // classes)).withColumn("said", said_ll[F.col("declared")])
    own = own.withColumn("post", F.expr(f"""transform(ll, (x, i) -> x + said[i] + suffix_ll[i]
                         + ln((greatest(mass[i] - p[i], 0D) + {LEAN} * above[i]) / (rows - 1 + {LEAN})))"""))
    own = own.withColumn("best", F.expr("array_max(post)"))
    own = own.withColumn("posterior", F.expr("1 / aggregate(post, 0D, (a, x) -> a + exp(x - best))"))
    lang = names[F.array_position("post", F.col("best")).cast("int") - 1]
    return own.select(
        "doc_id", lang.alias("lang"), "posterior", ((lang != "und") & (F.col("posterior") >= accept)).alias("accepted"),
        names[F.array_position("ll", F.expr("array_max(ll)")).cast("int") - 1].alias("text_lang"), "declared", "row_no")


def identify_documents(docs: DataFrame, **params) -> DataFrame:
    """``identify`` with lang as the declaration and source as the host."""
    return identify(docs, declared=F.col("lang"), host=F.col("source"), **params)


def identify_pages(pages: DataFrame, **params) -> DataFrame:
    """``identify`` over web pages: the markup's lang attribute, the URL's host, domain and suffix, and the
    text outside tags, scripts and styles. The id column is page_id."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    bare = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")),
                            r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    own = pages.select(F.col("page_id"), bare.alias("text"), host.alias("host"),
                       F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("said"))
    return identify(own, id_col="page_id", declared=F.col("said"), host=F.col("host"),
                    domain=F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1),
                    suffix=F.regexp_extract("host", r"([^.]+)$", 1), **params)


def drop_unknown_language(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` (a stored table) that are accepted, with all their columns. Rows that are alike in all that
    the operator reads are judged alike."""
    rows, key = row_key(docs, "doc_id", "text", "lang", "source")
    out = identify_documents(rows, row_no=key, **params).filter(~F.col("accepted"))
    out = saved(out.select(F.col("row_no").alias(key)).distinct(), "language-rejected")
    return rows.join(out, key, "left_anti").drop(key)
