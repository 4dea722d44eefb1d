import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tabloom.plans.trail import Trail
from tabloom.plans.trail_report import write_trail_report
from tabloom.sources import book as B
from tabloom.sources import xlsx as X
from tabloom.streaming import audit as ST


@pytest.fixture
def trail(spark, tmp_path):
    t = Trail(spark, f"file://{tmp_path}/trail")
    t.initialise()
    t.append("workbook", spark.createDataFrame([(1, "s", "d", "i", "Book & <1>", "p", "t"), (2, "s", "d", "j", "Other", "q", "t")], "workbook_id bigint, site_id string, drive_id string, item_id string, name string, path string, created_at string"))
    cells = spark.createDataFrame([(w, str(v), "s", r, 1, f"{v * r}", f"str:{v * r}") for w in (1, 2) for v in (1, 2, 10) for r in range(1, 8 + v % 3)], ST.CELLS)
    one = t.open_run(1)
    ST.audit(spark.createDataFrame([(w, str(v)) for w in (1, 2) for v in (1, 2, 10)] + [(1, "11")], ST.VERSIONS), cells, t, run_id=one)
    t.finish_run(one)
    return t


def test_a_trail_becomes_one_workbook(spark, trail, tmp_path):
    to = f"file://{tmp_path}/report.xlsx"
    parts = write_trail_report(trail, 1, to, per_sheet=5)
    n = trail.changes().filter("workbook_id = 1").count()
    names = ["Resumo", "Execuções", "Versões processadas", *[f"Alterações_{i:03d}" for i in range(1, -(-n // 5) + 1)], "Erros", "Integridade"]
    with zipfile.ZipFile(tmp_path / "report.xlsx") as z:
        assert z.testzip() is None and len(z.namelist()) == 4 + len(names)
    sheets = X.read_sheets(spark, to).orderBy("position").collect()
    assert [s.sheet for s in sheets] == names and n > 10
    cells = X.read_cells(spark, to)
    value = {(r.sheet, r.address): r.text for r in cells.collect()}
    assert value["Resumo", "B2"] == "Book & <1>" and value["Resumo", "B5"] == "2" and value["Resumo", "B6"] == str(n)
    ids = [int(value[f"Alterações_{i:03d}", f"A{r}"]) for i in range(1, -(-n // 5) + 1) for r in range(2, 7) if (f"Alterações_{i:03d}", f"A{r}") in value]
    assert ids == list(range(1, n + 1)) and value["Erros", "D2"].startswith("no content") and ("Erros", "A3") not in value
    fields = {value["Integridade", f"A{r}"]: value.get(("Integridade", f"B{r}")) for r in range(2, 40) if ("Integridade", f"A{r}") in value}
    assert fields["Alterações exportadas"] == str(n) and fields["Número de abas de alterações"] == str(-(-n // 5)) and fields["Registros em Alterações_001"] == "5" and fields["Checkpoint observado"] == "10"
    assert B.check_book(parts, to).collect() == []
    wrong = parts.withColumn("n", F.when(F.col("sheet") == "Resumo", F.col("n") + 1).otherwise(F.col("n"))).withColumn("sheet", F.when(F.col("sheet") == "Erros", "Nowhere").otherwise(F.col("sheet")))
    assert sorted(map(tuple, B.check_book(wrong, to).collect())) == [("Nowhere", "the sheet is not there once"), ("Resumo", "rows are missing")]
    only = write_trail_report(trail, 1, to, start="2", per_sheet=5)
    assert {r.sheet: r.n for r in only.collect()}["Versões processadas"] == 1
    with pytest.raises(ValueError, match="not in the trail"):
        write_trail_report(trail, 7, to)


def test_a_report_that_fails_leaves_the_old_one(spark, trail, tmp_path, monkeypatch):
    to = f"file://{tmp_path}/report.xlsx"
    write_trail_report(trail, 2, to)
    before = (tmp_path / "report.xlsx").read_bytes()
    monkeypatch.setattr(B, "check_book", lambda parts, at: spark.createDataFrame([("Resumo", "rows are missing")], "sheet string, problem string"))
    with pytest.raises(ValueError, match="was not published"):
        write_trail_report(trail, 2, to)
    assert (tmp_path / "report.xlsx").read_bytes() == before


def test_empty_sheets_have_a_header(spark, tmp_path):
    none = spark.createDataFrame([], "id bigint, x double, ok boolean, day date")
    some = spark.createDataFrame([(2, 0.5, True, None), (1, None, False, "2024-01-01")], "id bigint, x double, ok boolean, day string").withColumn("day", F.col("day").cast("date"))
    book = [B.Sheet("A", none, "id", {"id": "Id", "x": "X"}), B.Sheet("B", some, "id", {"id": "Id", "x": "X", "ok": "Ok", "day": "Day"})]
    B.write_book(spark, f"file://{tmp_path}/b.xlsx", book, f"file://{tmp_path}/work")
    got = {(r.sheet, r.address): (r.kind, r.text) for r in X.read_cells(spark, str(tmp_path / "b.xlsx")).collect()}
    assert got == {("A", "A1"): ("str", "Id"), ("A", "B1"): ("str", "X"), ("B", "A1"): ("str", "Id"), ("B", "B1"): ("str", "X"), ("B", "C1"): ("str", "Ok"), ("B", "D1"): ("str", "Day"),
        ("B", "A2"): ("num", "1"), ("B", "C2"): ("bool", "False"), ("B", "D2"): ("str", "2024-01-01"), ("B", "A3"): ("num", "2"), ("B", "B3"): ("num", "0.5"), ("B", "C3"): ("bool", "True")}
    with pytest.raises(Exception, match="one name"):
        B.write_book(spark, f"file://{tmp_path}/c.xlsx", [book[0], book[0]], f"file://{tmp_path}/work")


def test_large_entries_are_told_in_64_bits():
    """A directory whose entries claim more than 4 GB, by sizes alone: Python's reader finds them."""
    out = io.BytesIO()
    z = B.Joined(out)
    z.text("a.txt", "hello")
    z.entries.append((b"big", 7, 5 << 32, 6 << 32, 5 << 32))
    z.close()
    found = {i.filename: i for i in zipfile.ZipFile(out).infolist()}
    assert (found["big"].compress_size, found["big"].file_size, found["big"].header_offset) == (5 << 32, 6 << 32, 5 << 32) and zipfile.ZipFile(out).read("a.txt") == b"hello"


def test_differences_become_one_workbook(spark, tmp_path):
    from tabloom.operators.structural import DIFFERENCES
    from tabloom.plans.comparison_report import write_comparison

    rows = [("S", f"S!A{i}", "content changed" if i % 3 else "row added", "1", "2", "") for i in range(1, 8)] + [("", "", "sheet added", None, None, None), ("S", "S!A1", "content changed", "1", "2", "")]
    to = str(tmp_path / "c.xlsx")
    write_comparison(spark.createDataFrame(rows, DIFFERENCES), f"file://{to}", "a.xlsx", "b.xlsx")
    got = {(r.sheet, r.address): r.text for r in X.read_cells(spark, to).collect()}
    assert [got["Resumo", f"B{i}"] for i in range(2, 8)] == ["a.xlsx", "b.xlsx", "9", "6", "2", "1"] and got["Resumo", "A5"] == "content changed" and got["Resumo", "A8"] == "Aba S"
    assert got["Divergências", "D2"] == "sheet added" and got["Divergências", "A10"] == "9" and got["Divergências", "C3"] == "S!A1" == got["Divergências", "C4"]
