"""Registered queries of this subpackage: each applies one operator, with production parameters, to a
whole table. ``ORACLE`` has the DuckDB statement of each query that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import align, codes, decontaminate, exact, language, licenses, neardup, packing, pii, quality, substrings, suffixes, warc
from chalkline.llm.common import table

TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "row_no")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.page_responses(table(spark, sf_dir, "pages")))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents")).drop("row_no")


def op5_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents")).drop("row_no")


def pages_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over the web pages, where markup, suffix, domain and host all speak."""
    found = language.identify_pages(table(spark, sf_dir, "pages")).drop("row_no")
    return found.withColumnRenamed("doc_id", "page_id")


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_windows(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("row_no")


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), added=True)


def op11_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))


def op12_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                       public_tokenizers.path(PIECE_TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_subword_quality": op3_subword_quality,
    "op4_license_sentences": op4_license_sentences,
    "op5_evidence_fusion": op5_evidence_fusion,
    "pages_evidence_fusion": pages_evidence_fusion,
    "op6_difference_cover": op6_difference_cover,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bootstrapped_pii": op8_bootstrapped_pii,
    "op9_chosen_path": op9_chosen_path,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_suffix_levels": op11_suffix_levels,
    "op12_value_dictionaries": op12_value_dictionaries,
    "op13_merge_path": op13_merge_path,
}

def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """The rounds of op12 written out: c<r> are the entries before round r, a<r> the assignment to them."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, p, any_value(q.x) AS x, min({{'d': list_sum(list_transform(range(1, len(q.x) + 1),
                   lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i]))), 'k': k}}) AS best
            FROM q JOIN c{r} AS c USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
            WITH u AS (SELECT p, best.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}),
                 s AS (SELECT p, k, i, sum(y) AS s, count(*) AS n FROM u GROUP BY ALL),
                 e AS (SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s GROUP BY ALL)
            SELECT c.p, c.k, coalesce(e.x, c.x) AS x FROM c{r} AS c LEFT JOIN e ON e.p = c.p AND e.k = c.k)""")
    return f"""
        WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS nth,
                          list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             q AS MATERIALIZED (SELECT vec_id, nth, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x
                                FROM v CROSS JOIN range(8) AS g(p)),
             c0 AS (SELECT p, nth AS k, x FROM q WHERE nth < 16),
             {", ".join(steps)},
             books AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, k, i)) AS sha
                       FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM c{rounds})),
             coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best.k), 2, '0')), '' ORDER BY p) AS code,
                              sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
             sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN v USING (vec_id) GROUP BY label)
        SELECT coded.vec_id, code, error, label_error, sha AS codebooks_sha256
        FROM coded JOIN v USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM v.label CROSS JOIN books"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_winnowing": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             b AS (SELECT item_id::VARCHAR AS item_id,
                          regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m,
                            unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1),
                                                  lambda i: array_to_string(ws[i:i + 9], ' '))) AS key
                     FROM b WHERE len(ws) > 0),
             size AS (SELECT DISTINCT m FROM win),
             seen AS (SELECT doc_id, m, unnest(list_transform(range(1, len(ws) - m + 2),
                             lambda i: {{'i': i, 'key': array_to_string(ws[i:i + m - 1], ' ')}})) AS x
                      FROM d CROSS JOIN size WHERE len(ws) >= m),
             hit AS (SELECT DISTINCT doc_id, x.i AS i, seen.m AS m, item_id
                     FROM seen JOIN win ON win.m = seen.m AND win.key = x.key),
             words AS (SELECT doc_id, count(*) AS n_hit
                       FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) FROM hit) GROUP BY doc_id),
             ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS txt
                     FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(txt, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_difference_cover": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             k AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48),
                          lambda s: {'s': s, 'key': md5(array_to_string(ws[s:s + 49], ' '))})) AS x
                   FROM w WHERE len(ws) >= 50),
             m AS (SELECT x.key AS key, min(doc_id) AS least FROM k GROUP BY 1),
             gone AS (SELECT DISTINCT doc_id, unnest(range(x.s, x.s + 50)) AS i
                      FROM k JOIN m ON x.key = m.key WHERE doc_id > least),
             t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt, count(*) AS n
                      FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(txt, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER}) AS sha FROM documents),
             g AS (SELECT sha, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY sha)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM d JOIN g USING (sha)""",
    "op9_chosen_path": rf"""
        WITH RECURSIVE
             w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE
                          WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3),
                                                                lambda i: array_to_string(ws[i:i + 4], ' '))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y
                   WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
             r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
             c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT x AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, x = component_id AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.x""",
    "op11_suffix_levels": """
        WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             t AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2, 500),
                          lambda b: {'b': b, 'h': substr(h, 2 * b + 1, 1098)})) AS y FROM w),
             k AS (SELECT doc_id, unnest(list_transform(range(0, least(500, length(y.h) // 2 - 49)),
                          lambda s: {'s': y.b + s, 'key': md5(substr(y.h, 2 * s + 1, 100))})) AS x
                   FROM t WHERE length(y.h) >= 100),
             m AS (SELECT x.key AS key, min(doc_id) AS least FROM k GROUP BY 1),
             f AS (SELECT doc_id, x.s AS s, coalesce(x.s - lag(x.s) OVER (PARTITION BY doc_id ORDER BY x.s) > 50, true)
                   AS starts FROM k JOIN m ON x.key = m.key WHERE doc_id > least),
             r AS (SELECT doc_id, s, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM f),
             cut AS (SELECT doc_id, run, min(s) AS a, max(s) + 50 AS b FROM r GROUP BY ALL),
             part AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM cut),
             kept AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS rest,
                             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS txt
                      FROM part JOIN w USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
               coalesce(n, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(txt, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_value_dictionaries": _codes_sql(),
}
