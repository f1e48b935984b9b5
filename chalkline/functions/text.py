"""Text rules shared by reports, imports and change feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spreadsheet words that mean "true".
TRUE_WORDS = ["yes", "true", "1"]

# Fixed value: a loose address shape (something@something.something, no blanks).
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def parse_bool(c: Column) -> Column:
    """null -> false; trimmed lower-cased text in TRUE_WORDS -> true; else false."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def parse_int_safe(c: Column) -> Column:
    """Leading integer of the text ('12abc' -> 12, '-3.9' -> -3), else 0."""
    digits = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(_try_int(digits), F.lit(0))


def _try_int(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("int")).otherwise(c.try_cast("int"))


def parse_status(c: Column) -> Column:
    """Missing or empty -> 'ACTIVE'; otherwise trimmed and upper-cased."""
    return F.when(c.isNull() | (c == ""), F.lit("ACTIVE")).otherwise(F.upper(F.trim(c)))


def like_contains(search: str) -> str:
    """ILIKE pattern for a user search term, wildcards left active.

    ``%`` and ``_`` in the term stay wildcards. A backslash before an
    ordinary character means that character, so it is dropped; ``\\%``,
    ``\\_`` and ``\\\\`` stay escapes. A trailing lone backslash is literal.
    """
    out, i = [], 0
    while i < len(search):
        ch = search[i]
        if ch == "\\":
            nxt = search[i + 1] if i + 1 < len(search) else None
            if nxt is None:
                out.append("\\\\")
            elif nxt in "%_\\":
                out.append("\\" + nxt)
                i += 1
            else:
                out.append(nxt)
                i += 1
        else:
            out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def email_ok(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def normalise_email(c: Column) -> Column:
    return F.lower(F.trim(c))
