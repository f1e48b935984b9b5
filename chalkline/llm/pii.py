"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base spans come from four patterns (email, ip, card, phone) with their checks. They
seed the rest: the word before and the word after a seed, however far away, are lexical patterns, and
every other token with a digit or an "@" is a candidate that shares such words with
the seeds. Patterns and values form a graph, which is scored in rounds:

* a pattern's confidence for a kind is the share of its distinct values that are
  known to be of the kind (the count over all values plus one), if at least
  ``SUPPORT`` are;
* a value's score is one less the product of (1 - confidence) over its patterns; from
  ``ACCEPT`` on it counts as known in the next round, with the kind that scores best.

The rounds go on until one accepts nothing new; an accepted value stays, with its
kind, so they end. ``rounds`` can end them earlier. Then every occurrence of an accepted value that touches no base
span becomes a span of that kind. Base spans always stay.

One pass over the texts writes all matches with their contexts; offsets are running
sums over a document's matches, so nothing depends on a document's length squared.
Repetitions have possessive forms: they match the same spans, in linear time and
without recursion.

Defined cases: a null or empty text has no spans. Offsets count code points, ends are
exclusive. Equal rows give one row each. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as they match leftmost and without overlap. A run is entered at its start only (or where the
#: last match ended), since a match from its middle exists only if one from its start does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
SUPPORT, ACCEPT = 3, 0.8


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _valid() -> Column:
    """Whether a match passes its kind's check; candidates ("other") always do."""
    d = _digits(F.col("value"))
    luhn = F.expr("""aggregate(transform(split(reverse(regexp_replace(value, '[^0-9]', '')), ''), x -> try_cast(x as int)),
        named_struct('sum', 0, 'odd', true),
        (a, x) -> named_struct('sum', a.sum + if(a.odd, coalesce(x, 0), coalesce(x, 0) * 2 - if(x > 4, 9, 0)),
                               'odd', not a.odd), a -> a.sum % 10 = 0)""")
    parts = F.expr("""forall(split(value, '[.]'), x -> length(ltrim('0', x)) < 4
                      and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)""")
    return (F.when(F.col("kind") == "ip", parts)
            .when(F.col("kind") == "card", F.when(F.length(d).between(16, 19), luhn).otherwise(False))
            .when(F.col("kind") == "phone", F.length(d).between(8, 15)).otherwise(F.col("kind").isNotNull()))


def _matches(kind: str) -> Column:
    """The matches of one kind: place among them, length of the text before each since the last, value, and
    the words before and after."""
    re = "'" + PATTERNS[kind].replace("\\", "\\\\") + "'"
    first = r"^[^\\p{L}\\p{N}]*+([\\p{L}\\p{N}]++)"   # of the text after, and of the text before from its end
    return F.expr(f"""if(text rlike {re}, transform(
        arrays_zip(split(text, {re}, -1), regexp_extract_all(text, {re}, 0), slice(split(text, {re}, -1), 2, 2147483646)),
        (x, i) -> named_struct('kind', '{kind}', 'place', i, 'gap', length(x['0']), 'value', x['1'],
            'before', lower(reverse(regexp_extract(reverse(x['0']), '{first}', 1))),
            'after', lower(regexp_extract(x['2'], '{first}', 1)))),
        cast(array() as array<struct<kind: string, place: int, gap: int, value: string, before: string, after: string>>))""")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_no, doc_id, kind, start, end, value, before, after) of valid matches and candidates, and a row
    without a kind for every document. Stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.expr("""array(cast(null as struct<kind: string, place: int, gap: int, value: string, before: string,
                     after: string>))""")
    # explode_outer: explode would make the optimizer evaluate all patterns again for a test of the array's size
    found = rows.select("row_no", "doc_id", F.explode_outer(F.concat(none, *[_matches(k) for k in PATTERNS])).alias("m"))
    found = saved(found.select("row_no", "doc_id", "m.*").filter("place is null or value is not null"), "pii-matches")
    order = Window.partitionBy("row_no", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("value")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return saved(spans.filter(F.col("kind").isNull() | _valid())
                 .select("row_no", "doc_id", "kind", "start", "end", "value", "before", "after"), "pii-spans")


def _free_candidates(spans: DataFrame) -> DataFrame:
    """The candidates that touch no base span of their document."""
    base = F.col("kind") != "other"
    order = Window.partitionBy("row_no").orderBy("start", "end")
    upto = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    next_one = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (spans.filter("kind is not null").withColumn("upto", upto).withColumn("next", next_one)
            .filter((F.col("kind") == "other") & (F.coalesce("upto", F.lit(0)) <= F.col("start"))
                    & (F.coalesce("next", F.col("end")) >= F.col("end"))).drop("upto", "next"))


def bootstrap(seeds: DataFrame, candidates: DataFrame, rounds: int | None = None, support: int = SUPPORT,
              accept: float = ACCEPT) -> DataFrame:
    """(value, kind) of the candidates' accepted values, from (value, kind, before, after) of seeds and candidates."""
    both = seeds.select("value", "kind", "before", "after").unionByName(
        candidates.select("value", F.lit(None).cast("string").alias("kind"), "before", "after"))
    sides = F.explode(F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"))).alias("pattern")
    edges = saved(both.select("value", "kind", sides).filter(F.length("pattern") > 1).distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    sure = edges.filter("kind is not null").select("value", "kind", "pattern")
    accepted, upto = None, 0
    for _ in range(rounds) if rounds is not None else count():
        known = sure
        if accepted is not None:
            known = sure.unionByName(edges.filter("kind is null").select("value", "pattern")
                                     .join(accepted, "value").select("value", "kind", "pattern")).distinct()
        trust = (known.groupBy("pattern", "kind").agg(F.count_distinct("value").alias("hits"))
                 .filter(F.col("hits") >= support).join(sizes, "pattern")
                 .select("pattern", "kind", (F.col("hits") / (F.col("n") + 1)).alias("trust")))
        scored = (edges.filter("kind is null").select("value", "pattern").join(trust, "pattern")
                  .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
                  .filter(F.col("score") >= accept).groupBy("value")
                  .agg(F.max(F.struct("score", "kind")).alias("best")).select("value", F.col("best.kind").alias("kind")))
        if accepted is not None:
            scored = accepted.unionByName(scored.join(accepted, "value", "left_anti"))
        accepted = saved(scored, "pii-accepted")
        before, upto = upto, accepted.count()
        if upto == before:
            break
    return accepted if accepted is not None else candidates.select("value", F.lit("").alias("kind")).limit(0)


def _listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["at"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None,
                  support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end), n_found,
    row_no: one row per input row."""
    spans = occurrences(docs, id_col, text_col)
    seeds = spans.filter(F.col("kind").isin(*KINDS))
    free = saved(_free_candidates(spans), "pii-candidates")
    more = free.drop("kind").join(bootstrap(seeds, free, rounds, support, accept), "value")
    at = reduce(lambda c, i: c.when(F.col("kind") == KINDS[i], i + 1), range(1, 4), F.when(F.col("kind") == KINDS[0], 1))
    rows = (spans.filter(F.col("kind").isNull() | (F.col("kind") != "other")).withColumn("base", F.lit(True))
            .unionByName(more.withColumn("base", F.lit(False)))
            .select("row_no", "doc_id", "base", "kind", F.struct(at.alias("at"), "start", "end").alias("span")))
    own = rows.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base") & F.col("kind").isNotNull(), F.col("span"))).alias("base"),
        F.collect_list(F.when(F.col("kind").isNotNull(), F.col("span"))).alias("every"))
    return own.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                      _listed(F.col("every")).alias("spans"),
                      (F.size("every") - F.size("base")).cast("long").alias("n_found"), "row_no")
