"""WARC derivative builder: from response records to linked metadata and conversion records.

``derive`` gives two records for each response:

* ``metadata`` (application/warc-fields): what the response was (its identifier, digests and the headers it
  came with) and what its markup says (title, language, outgoing links; attribute values in double quotes, in
  single quotes or bare);
* ``conversion`` (text/plain): the page's text, all of HTML's character references decoded, with its own block digest.

Both refer to the response by WARC-Refers-To and repeat its target and date; the
conversion names the metadata record in WARC-Concurrent-To. Identifiers are made of
the source's identifier, so a second run writes the same records. A record's own
digest is SHA-256; a digest that the source has is carried over as it stands.

``write_warc`` writes whole WARC files with Spark's text sink: a record is one line
whose separator is the empty lines that end a record. ``read_warc`` reads them (or
others, plain or gzipped) back in the same way and checks every block's length, so a
block that holds a record of its own is reported, not mistaken.

Defined cases: a null or empty payload gives an empty text; a null URL the empty
target; missing digests are computed. Repeated pages give records with equal
identifiers. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF, END = "\r\n", "\r\n\r\n"
#: Elements whose content is no text, elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section",
          "table", "td", "th", "tr", "ul")
#: HTML's named references ("amp;", and "amp" where the semicolon may be missing); a no-break space is a blank here.
ENTITIES = {**html5, "nbsp;": " ", "nbsp": " "}
#: What HTML reads for the numbers 128 to 159 (as in windows-1252).
WINDOWS = {n: ord(bytes([n]).decode("cp1252")) for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
#: Slots of the table of names: a lookup in a map goes along its entries, so each slot has a short map.
SLOTS = 1024
REFERENCE = "^(#[xX][0-9A-Fa-f]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: The names that need no semicolon, longest first: more letters may follow them.
PREFIX = f"^({'|'.join(sorted((x for x in html5 if not x.endswith(';')), key=len, reverse=True))})"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
NOT_SHOWN = "(?is)<(?:!--.*?-->|" + "|".join(rf"{x}\b[^>]*>.*?</{x}\s*>" for x in HIDDEN) + ")"
LINE_ENDS = rf"(?i)</?({'|'.join(BLOCKS)})\b[^>]*>"


def _once(col: Column, f) -> Column:
    """``f`` of a column that is evaluated once, however often ``f`` names it."""
    return F.transform(F.array(col), f)[0]


def _attribute(element: str, wanted: str) -> str:
    """A pattern whose group 1 is the value, with any quotes, of the element's first attribute of the name ``wanted``.
    Attributes are passed one by one, so nothing within another one's value is taken for it."""
    gap = r"""(?:[\s/]++|(?<=["']))"""
    other = rf"{gap}(?!{wanted}\s*=)[^\s>/][^\s=>/]*+(?:\s*+=\s*+{_VALUE})?+"
    return rf"(?i)<{element}(?=[\s/])(?:{other})*+{gap}{wanted}\s*=\s*({_VALUE})"


def _bare(value: Column) -> Column:
    return F.when(F.left(value, F.lit(1)).isin('"', "'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _after(text: Column, start: Column) -> Column:
    return F.substring(text, F.length(start) + 1, F.length(text))


def _named(name: Column) -> Column:
    """The characters of a named reference, or null."""
    slots = [{} for _ in range(SLOTS)]
    for x, chars in ENTITIES.items():
        slots[crc32(x.encode()) % SLOTS][x] = chars
    names = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")   # a constant once planned
    return F.get(names, (F.crc32(name) % SLOTS).cast("int"))[name]


def _number(name: Column) -> Column:
    """The character of a decimal or hexadecimal reference; a number that is no character's gives U+FFFD."""
    base = F.lower(F.substring(name, 2, 1))
    code = lambda x: F.when(F.length(x) > 7, 0).when(base == "x", F.conv(x, 16, 10).cast("int")).otherwise(x.cast("int"))
    windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
    valid = lambda x: (F.when((x < 1) | (x > 1114111) | x.between(55296, 57343), 65533)
                       .when(x.between(128, 159), F.coalesce(windows[x], x)).otherwise(x))
    digits = F.regexp_replace(name, "^#[xX]?0*(?=[0-9A-Fa-f])|;$", "")
    return _once(_once(digits, code), lambda x: F.decode(F.unhex(F.lpad(F.hex(valid(x)), 8, "0")), "UTF-32"))


def _decoded(text: Column) -> Column:
    """Character references decoded as in HTML, each once: what one gives is not read again."""
    prefixed = lambda name: _once(F.regexp_extract(name, PREFIX, 1), lambda x: F.when(
        x == "", F.concat(F.lit("&"), name)).otherwise(F.concat(_named(x), _after(name, x))))
    chars = lambda name: (F.when(name == "", "&").when(name.startswith("#"), _number(name))
                          .otherwise(F.coalesce(_named(name), prefixed(name))))
    part = lambda x, i: F.when(i == 0, x).otherwise(_once(
        F.regexp_extract(x, REFERENCE, 1), lambda name: F.concat(chars(name), _after(x, name))))
    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), part), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """A page's text: hidden elements go, block elements end lines, references are decoded, blanks are joined."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NOT_SHOWN, " "), LINE_ENDS, "\n"), "<[^>]*>", "")
    t = _once(t, _decoded)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]{2,}|[\t\r\f]", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(t, F.lit(" \n"))


def _urn(*parts: Column) -> Column:
    """A name-based identifier in UUID form."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                                                          ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _sha256(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html) that has no WARC headers of its own."""
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", "")  # a header is one line
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id"), _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url)
        .alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.lit(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"), html.alias("payload"),
        _sha256(html).alias("payload_digest"))


def derive(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, type, record_id, refers_to, target_uri, date, content_type, source_digest, block_digest,
    content_length, headers, block): two rows per response (record_id, target_uri, date, status,
    content_type, payload, payload_digest)."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    first = lambda re: F.regexp_extract(payload, re, 1)
    title = F.regexp_replace(first(r"(?is)<title\b[^>]*>(.*?)</title"), r"\s+", " ")
    links = F.regexp_extract_all(payload, F.lit(_attribute("a", "href")), F.lit(1))
    digest = F.coalesce(F.col("payload_digest"), _sha256(payload))
    fields = F.concat_ws(
        CRLF, F.concat(F.lit("source-record-id: "), F.col("record_id")),
        F.concat(F.lit("source-payload-digest: "), digest),
        F.concat(F.lit("source-status: "), F.col("status").cast("string")),
        F.concat(F.lit("source-content-type: "), F.col("content_type")),
        F.concat(F.lit("source-payload-length: "), F.octet_length(payload).cast("string")),
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("language: "), _once(first(_attribute("html", "(?:xml:)?lang")), _bare)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(_bare(x), r"\s+", "%20"))))
    metadata_id, source = _urn(F.lit("metadata"), F.col("record_id")), F.col("record_id")
    both = responses.select(
        F.col(key), source.alias("refers_to"), F.col("target_uri"), F.col("date"), digest.alias("source_digest"),
        metadata_id.alias("metadata_id"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("type"), metadata_id.alias("record_id"),
                     F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("type"), _urn(F.lit("conversion"), source).alias("record_id"),
                     F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block"))))
        .alias("r")).select(key, "refers_to", "target_uri", "date", "source_digest", "metadata_id", "r.*")
    both = both.withColumn("block_digest", _sha256(F.col("block"))).withColumn(
        "content_length", F.octet_length("block").cast("long"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    headers = F.concat_ws(
        CRLF, F.lit(VERSION), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        F.when(F.col("type") == "conversion", line("WARC-Concurrent-To", F.col("metadata_id"))),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")))
    return both.select(key, "type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest",
                       "block_digest", "content_length", headers.alias("headers"), "block")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write (headers, block) as WARC files, one per partition, into the folder ``path``."""
    (records.select(F.concat("headers", F.lit(END), "block"))
     .write.option("lineSep", END).option("compression", compression).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block, complete) of every record of the WARC files at ``path``; ``complete`` is false where the
    block isn't as long as its header says. Blocks are read as UTF-8 text."""
    raw = spark.read.option("lineSep", f"{END}WARC/").text(path)
    cut = F.instr("value", END)
    head = F.when(cut > 0, F.expr(f"left(value, instr(value, '{END}') - 1)")).otherwise(F.col("value"))
    fields = F.filter(F.split(head, CRLF), lambda x: F.instr(x, ":") > 0)
    names = F.transform(fields, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    values = F.transform(fields, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    block = F.when(cut > 0, F.expr(f"substring(value, instr(value, '{END}') + 4)")).otherwise("")
    rows = raw.filter(F.trim("value") != "").select(F.map_from_arrays(names, values).alias("headers"), block.alias("block"))
    # the last record of a file still has the empty lines that end it
    bare = F.when(F.octet_length("block") == F.col("headers")["content-length"].cast("long") + len(END),
                  F.regexp_replace("block", "\r\n\r\n$", "")).otherwise(F.col("block"))
    rows = rows.withColumn("block", bare)
    return rows.withColumn("complete", F.coalesce(
        F.octet_length("block") == F.col("headers")["content-length"].cast("long"), F.lit(False)))
