"""Teacher sheet import (I1): a cleaning, de-duplicating, rejecting load job.

Input is the sheet exported to CSV/JSON/parquet (string columns named as in
the sheet header, plus ``sheet_row`` = spreadsheet row number). Every rule
is a built-in column expression; de-duplication is one group-by on the code
over the sheet and the existing table (partial aggregation absorbs a code
repeated a million times) and one join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chalkline.functions.text import parse_bool, parse_int_safe, parse_status
from chalkline.session import scratch_path
from chalkline.sources import schemas as sch

# Sheet header -> teacher column; text cells default to ''.
SHEET_TEXT_COLUMNS = {
    "Phone": "phone", "CV Link": "cv_link", "Job Title": "current_job_title", "Subjects": "subjects",
    "Highest Qualification": "highest_qualification", "Country": "current_country",
    "Region": "current_region", "Visa Status": "visa_status", "Notice Period": "notice_period",
    "Preferred Regions": "preferred_regions", "Current School": "current_school_name", "Bio": "bio",
}
SHEET_BOOL_COLUMNS = {"Will Move Sem 1": "will_move_sem1", "Will Move Sem 2": "will_move_sem2",
                      "Visible in Portal": "is_visible_in_school_portal"}
SHEET_COLUMNS = (["Teacher Code", "Full Name", "Email"] + list(SHEET_TEXT_COLUMNS)
                 + list(SHEET_BOOL_COLUMNS) + ["Years Experience", "Profile Status"])


def read_sheet(spark, path: str, fmt: str = "csv") -> DataFrame:
    """Read an exported sheet: columns by header name, as text; absent columns are null, others are left out.

    ``path`` is a file or a folder of files with one header. A CSV cell in quotes may hold line ends, and a quote is
    written twice in it; such a file cannot be cut, so it is one task, and large sheets are exported as several files.

    Rows are numbered from 2 on (the header is row 1), file by file in the order of their paths; a sheet that has a
    ``sheet_row`` column keeps it. A row's number follows from its file, the block of the file it was read in and its
    place there, not from how files and blocks are dealt to tasks. The rows are written once and numbered from there,
    so both steps see one scan.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    else:
        raw = spark.read.format(fmt).load(path)
    cells = [(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in SHEET_COLUMNS]
    if "sheet_row" in raw.columns:
        return raw.select(F.col("sheet_row").cast("long").alias("sheet_row"), *cells)
    folder = scratch_path(spark, "sheet")
    raw.select(*cells, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
               F.monotonically_increasing_id().alias("_at")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)   # one row per block
    blocks = (rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_start"))
              .select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_shift")))
    return rows.join(blocks, ["_file", "_block"]).select((F.col("_at") + F.col("_shift") + 2).alias("sheet_row"),
                                                         *[F.col(f"`{c}`") for c in SHEET_COLUMNS])


def teacher_import(sheet: DataFrame, teachers: DataFrame, as_of):
    """I1: returns (inserted, rejects, summary).

    * rows missing code, name or email (null or '') are rejected;
    * text cells default to ''; booleans: yes/true/1 (trimmed, any case) are
      true, everything else false; years: leading integer or 0; status:
      missing -> ACTIVE else trimmed upper-case, then checked against the
      enum (row-level reject, not a failed batch);
    * a code already in the table is skipped; within the file the first
      insertable row (lowest sheet_row) wins and the others are skipped.
    New ids continue after the table maximum in sheet-row order.
    """
    from chalkline.functions.time import ts_lit

    code, name, email = F.col("Teacher Code"), F.col("Full Name"), F.col("Email")
    blank = lambda c: c.isNull() | (c == "")
    rows = sheet.select(
        "sheet_row",
        *[F.col(c) for c in SHEET_COLUMNS],
        parse_status(F.col("Profile Status")).alias("_status"))
    missing = blank(code) | blank(name) | blank(email)
    bad_status = ~F.col("_status").isin(*sch.PROFILE_STATUSES)
    # per code: is it in the table, and the first row that could be inserted; one join back
    mine = F.when(~missing & ~bad_status, F.col("sheet_row").cast("long"))
    codes = (rows.select("Teacher Code", mine.alias("_row"), F.lit(False).alias("_there"))
             .unionByName(teachers.select(F.col("teacher_code").alias("Teacher Code"), F.lit(None).cast("long").alias("_row"),
                                          F.lit(True).alias("_there")))
             .groupBy("Teacher Code").agg(F.min("_row").alias("_first"), F.max("_there").alias("_exists")))
    rows = rows.join(codes, "Teacher Code", "left")
    row_no = F.col("sheet_row").cast("string")
    reason = (F.when(missing, F.concat(F.lit("Row "), row_no, F.lit(": Missing Code, Name, or Email")))
              .when(bad_status, F.concat(F.lit("Row "), row_no, F.lit(" ("), code, F.lit("): invalid input value for enum "
                                                                                      "teacher_profile_status: \""),
                                         F.col("_status"), F.lit("\"")))
              .when(F.col("_exists") | (F.col("sheet_row") != F.col("_first")),
                    F.concat(F.lit("Row "), row_no, F.lit(": Skipped (Duplicate Teacher Code: "), code, F.lit(")"))))
    rows = rows.withColumn("_reason", reason)
    rejects = rows.filter(F.col("_reason").isNotNull()).select("sheet_row", F.col("Teacher Code").alias("teacher_code"),
                                                              F.col("_reason").alias("reason"))
    ok = rows.filter(F.col("_reason").isNull())
    start = F.coalesce(teachers.agg(F.max("id").alias("id")).scalar(), F.lit(0))
    now = ts_lit(as_of)
    values = {
        "id": (start + F.col("sheet_row")).cast("long"),
        "teacher_code": code, "full_name": name, "email": email,
        "years_experience": parse_int_safe(F.col("Years Experience")),
        "profile_status": F.col("_status"),
        "created_at": now, "updated_at": now,
    }
    for header, col in SHEET_TEXT_COLUMNS.items():
        values[col] = F.coalesce(F.col(header), F.lit(""))
    for header, col in SHEET_BOOL_COLUMNS.items():
        values[col] = parse_bool(F.col(header))
    inserted = ok.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in sch.TEACHERS.fields])
    summary = rows.agg(F.count(F.lit(1)).alias("total_rows_found"),
                       F.count_if(F.col("_reason").isNull()).alias("successfully_inserted"),
                       F.count_if(F.col("_reason").isNotNull()).alias("errors"))
    return inserted, rejects, summary
