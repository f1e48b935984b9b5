"""Teacher sheet import (I1) parsing and de-duplication."""

import pytest
from pyspark.sql import functions as F

from chalkline.functions.text import parse_bool, parse_int_safe, parse_status
from chalkline.operators import ingest as I
from tests import helpers as H


@pytest.mark.parametrize("text,val", [("12abc", 12), ("", 0), ("-3.9", -3), (" 7", 7), ("x", 0), (None, 0),
                                      ("+4", 4), ("99999999999", 0)])
def test_parse_int_safe(spark, text, val):
    assert spark.createDataFrame([(text,)], "s string").select(parse_int_safe(F.col("s"))).first()[0] == val


@pytest.mark.parametrize("text,val", [("YES ", True), ("no", False), (None, False), ("1", True), ("TRUE", True),
                                      ("", False), ("y", False)])
def test_parse_bool(spark, text, val):
    assert spark.createDataFrame([(text,)], "s string").select(parse_bool(F.col("s"))).first()[0] is val


@pytest.mark.parametrize("text,val", [(None, "ACTIVE"), ("", "ACTIVE"), (" placed ", "PLACED"), ("bogus", "BOGUS")])
def test_parse_status(spark, text, val):
    assert spark.createDataFrame([(text,)], "s string").select(parse_status(F.col("s"))).first()[0] == val


def _sheet(spark, rows):
    cols = ["sheet_row"] + I.SHEET_COLUMNS
    full = [tuple(r.get(c) for c in cols) for r in rows]
    schema = "sheet_row int, " + ", ".join(f"`{c}` string" for c in I.SHEET_COLUMNS)
    return spark.createDataFrame(full, schema)


def test_import_rules(spark):
    t = H.teachers(spark, [{"id": 10, "teacher_code": "T-00010"}])
    sheet = _sheet(spark, [
        {"sheet_row": 2, "Teacher Code": "X1", "Full Name": "A", "Email": "a@x", "Profile Status": "bogus"},
        {"sheet_row": 3, "Teacher Code": "X1", "Full Name": "B", "Email": "b@x", "Years Experience": "12abc",
         "Will Move Sem 1": "YES ", "Visible in Portal": None},
        {"sheet_row": 4, "Teacher Code": "X1", "Full Name": "C", "Email": "c@x"},
        {"sheet_row": 5, "Teacher Code": "T-00010", "Full Name": "D", "Email": "d@x"},
        {"sheet_row": 6, "Teacher Code": "X2", "Full Name": "", "Email": "e@x"},
    ])
    ins, rej, summ = I.teacher_import(sheet, t, H.AS_OF)
    row = ins.first()
    assert ins.count() == 1 and row.full_name == "B" and row.years_experience == 12
    assert row.will_move_sem1 is True and row.is_visible_in_school_portal is False and row.phone == ""
    assert row.id == 13 and row.profile_status == "ACTIVE"
    reasons = {x.sheet_row: x.reason for x in rej.collect()}
    assert reasons[2].startswith("Row 2 (X1): invalid input value")
    assert reasons[4] == "Row 4: Skipped (Duplicate Teacher Code: X1)"
    assert reasons[5] == "Row 5: Skipped (Duplicate Teacher Code: T-00010)"
    assert reasons[6] == "Row 6: Missing Code, Name, or Email"
    assert tuple(summ.first()) == (5, 1, 4)


def test_read_sheet_csv(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("sheet_row," + ",".join(f'"{c}"' for c in I.SHEET_COLUMNS) + "\n2,X-1,Ann,a@x.org"
                 + "," * (len(I.SHEET_COLUMNS) - 3) + "\n")
    df = I.read_sheet(spark, str(p))
    assert df.first()["Teacher Code"] == "X-1"


def test_read_sheet_maps_by_header_and_numbers_rows(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("Email,Teacher Code,Unused,Full Name\na@x.org,T1,z,Ann\nb@x.org,T2,z,Bob\n")
    got = [(r.sheet_row, r["Teacher Code"], r["Full Name"], r["Email"], r["Phone"])
           for r in I.read_sheet(spark, str(p)).orderBy("sheet_row").collect()]
    assert got == [(2, "T1", "Ann", "a@x.org", None), (3, "T2", "Bob", "b@x.org", None)]


def test_read_sheet_numbers_rows_over_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("Teacher Code\n" + "".join(f"T{k}{i}\n" for i in range(5)))
    rows = I.read_sheet(spark, str(tmp_path)).collect()
    assert sorted(r.sheet_row for r in rows) == list(range(2, 17)) and len({r["Teacher Code"] for r in rows}) == 15


def test_read_sheet_with_line_ends_and_quotes_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Teacher Code,Bio,Email\nT1,"two\nlines, ""quoted""",a@x\nT2,"c:\\",b@x\n')
    (tmp_path / "b.csv").write_text('Teacher Code,Bio,Email\nT3,"one\n\n\nmore",c@x\nT4,plain,d@x\n')
    got = [(r.sheet_row, r["Teacher Code"], r["Bio"], r["Email"])
           for r in I.read_sheet(spark, str(tmp_path)).orderBy("sheet_row").collect()]
    assert got == [(2, "T1", 'two\nlines, "quoted"', "a@x"), (3, "T2", "c:\\", "b@x"),
                   (4, "T3", "one\n\n\nmore", "c@x"), (5, "T4", "plain", "d@x")]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_numbers_do_not_depend_on_split_sizes(spark, tmp_path, fmt):
    rows = spark.range(6000).select(F.concat(F.lit("T"), "id").alias("Teacher Code"),
                                    F.concat(F.lit("x"), F.col("id") * 7).alias("Email"))
    rows.repartitionByRange(3, F.expr("cast(substr(`Teacher Code`, 2) as long)")).sortWithinPartitions(
        F.expr("cast(substr(`Teacher Code`, 2) as long)")).write.format(fmt).option("header", True).save(str(tmp_path / "s"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("8k", "0"), ("1m", "0"), ("128m", "4m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            got = I.read_sheet(spark, str(tmp_path / "s"), fmt)
            wrong = got.filter(F.concat(F.lit("T"), F.col("sheet_row") - 2) != F.col("Teacher Code"))
            assert wrong.count() == 0 and got.count() == 6000, size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Teacher Code,Email\nT1,a@x\n")
    (tmp_path / "b.csv").write_text("Email,Teacher Code\nb@x,T2\n")
    with pytest.raises(Exception, match="header"):
        I.read_sheet(spark, str(tmp_path)).collect()
