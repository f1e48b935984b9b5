"""Directory listings and exports (Q11, Q12, Q15).

Projections and filters only: Catalyst prunes the scan to the listed
columns and pushes the visibility predicate into parquet. Whole-table
ordered exports are a range-partitioned sort (no single-task coalesce);
for very large exports ``sort_within_partitions`` keeps parallel files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Anonymised portal columns: list view and detail view.
PORTAL_LIST_COLUMNS = ["id", "teacher_code", "highest_qualification", "years_experience",
                       "current_country", "visa_status", "profile_status", "bio"]
PORTAL_DETAIL_COLUMNS = ["teacher_code", "highest_qualification", "current_country",
                         "current_region", "years_experience", "subjects", "profile_status"]

# Columns that never leave the system in an export.
SECRET_COLUMNS = {"password_hash", "verify_token", "forgot_password_token", "forgot_password_expires_at"}


def portal_teacher_list(teachers: DataFrame, ids=None, subjects: str | None = None,
                        region: str | None = None, detail: bool = False,
                        seed: int | None = None) -> DataFrame:
    """Q11: visible teachers without personal data.

    ``ids`` restricts to given ids (detail lookup); ``subjects`` is a
    case-insensitive contains, ``region`` an equality on current_region.
    ``seed`` gives the random presentation order; None leaves rows unordered.
    """
    t = teachers.filter(F.col("is_visible_in_school_portal"))
    if ids is not None:
        if isinstance(ids, DataFrame):
            t = t.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")
        else:
            t = t.filter(F.col("id").isin(list(ids)))
    if subjects:
        t = t.filter(F.lower(F.col("subjects")).contains(subjects.lower()))
    if region:
        t = t.filter(F.col("current_region") == region)
    out = t.select(*(PORTAL_DETAIL_COLUMNS if detail else PORTAL_LIST_COLUMNS))
    if seed is not None:
        out = out.orderBy(F.rand(seed))
    return out


def _without_secrets(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in SECRET_COLUMNS])


def teacher_export(teachers: DataFrame) -> DataFrame:
    """Q12: every teacher column, newest first."""
    return _without_secrets(teachers).orderBy(F.desc("created_at"), F.desc("id"))


def school_export(schools: DataFrame) -> DataFrame:
    """Q12: schools without secret columns (unordered, as in the reference)."""
    return _without_secrets(schools)


def archived_teacher_export(archived: DataFrame) -> DataFrame:
    """Q12: every column of the archive (``Run.append``'s folders, or one job's rows), secret ones left out, unordered."""
    return _without_secrets(archived)


def access_code_report(access_codes: DataFrame, schools: DataFrame) -> DataFrame:
    """Q15: access codes with the owning school's name and email, newest first.

    Left join: codes without a school (or with an unknown one) are kept.
    """
    s = schools.select(F.col("id").alias("school_id"), F.col("name").alias("school_name"), "email")
    return (access_codes.select("id", "code", "status", "school_id", "first_used_at", "expires_at", "created_at")
            .join(s, "school_id", "left")
            .select("id", "code", "status", "school_id", "first_used_at", "expires_at", "created_at",
                    "school_name", "email")
            .orderBy(F.desc("created_at"), F.desc("id")))


def write_sorted_export(df: DataFrame, path: str, order_col: str, fmt: str = "parquet") -> None:
    """Write a large ordered export as parallel files.

    A global ``orderBy`` range-partitions the data, so file i holds an
    ordered key range and the files concatenate in order; no task sees more
    than its range.
    """
    df.orderBy(F.desc(order_col)).write.mode("overwrite").format(fmt).save(path)
