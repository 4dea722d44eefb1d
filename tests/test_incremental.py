import datetime as dt

from pyspark.sql import functions as F

from tabloom.operators.diff import snapshot_diff
from tabloom.sources import incremental as I
from tabloom.sources import report as R
from tabloom.sources import xlsx as X

from .test_xlsx import book


def row(r, *cells):
    return f'<row r="{r}">' + "".join(cells) + "</row>"


def s(at, i):
    return f'<c r="{at}" t="s"><v>{i}</v></c>'


def n(at, v, extra=""):
    return f'<c r="{at}"{extra}><v>{v}</v></c>'


def master(at, text, ref):
    return f'<c r="{at}"><f t="shared" si="0" ref="{ref}">{text}</f></c>'


def follower(at):
    return f'<c r="{at}"><f t="shared" si="0"/></c>'


BASE = [row(1, s("A1", 0), n("B1", 5)), row(2, s("A2", 1)), row(3, master("A3", "B3*2", "A3:A4")), row(4, follower("A4"), n("B4", 7)), row(5, n("A5", 40000, ' s="1"')), row(5, n("B5", 1)), "<row/>", row(8, n("A8", 3))]


def versions():
    """Files of one workbook: a value, a shared string, a master formula and a date style change, a row comes and one goes."""
    strings, styles = ["<t>a</t>", "<t>b</t>"], ("0", "14")
    rows = list(BASE)
    yield book({"S": "".join(rows)}, strings, styles=styles)
    rows[7] = row(8, n("A8", 4))
    yield book({"S": "".join(rows)}, strings, styles=styles)
    yield book({"S": "".join(rows)}, ["<t>a</t>", "<t>c</t>"], styles=styles)
    rows[2] = row(3, master("A3", "B3*3", "A3:A4"))
    yield book({"S": "".join(rows)}, ["<t>a</t>", "<t>c</t>"], styles=styles)
    yield book({"S": "".join(rows), "T": row(1, n("A1", 1))}, ["<t>a</t>", "<t>c</t>"], styles=("0", "0"))
    yield book({"S": "<!-- note -->" + "".join(rows[1:]) + row(9, n("C9", 9))}, ["<t>a</t>", "<t>c</t>"], styles=("0", "0"))


def test_rows_are_split_and_parsed_as_in_a_full_read():
    for data in versions():
        keys = {(r[1], r[2]) for r in I.index_of("p", data)}
        assert list(I.cells_of_rows("p", data, keys)) == list(X.cells_of("p", data))
        only = {(sheet, key) for sheet, key in keys if key in ("4#0", "5#1")}
        assert [r[4] for r in I.cells_of_rows("p", data, only)] == ["A4", "B4", "B5"]
        assert [r[6] for r in I.cells_of_rows("p", data, only)][0].startswith("=B4*")


def test_changes_equal_those_of_full_reads(spark, tmp_path):
    for i, data in enumerate(versions()):
        (tmp_path / f"v{i}.xlsx").write_bytes(data)
    files = I.files_of(spark, str(tmp_path))
    made = iter(range(99))

    def stage(df):
        at = str(tmp_path / f"stage{next(made)}")
        df.write.parquet(at)
        return spark.read.parquet(at)

    chain = files.select(F.lit(1).alias("workbook"), F.regexp_extract("path", r"v(\d)\.xlsx", 1).cast("int").alias("seq"), "path")
    index = stage(I.read_index(files))
    wanted = stage(I.changed_rows(index, stage(chain)))
    per_pair = {(r.pair, r.side): r.n for r in wanted.groupBy("pair", "side").agg(F.count("*").alias("n")).collect()}
    # One row; the row of the changed string; the master and its follower; all rows, as dates are none any more.
    assert [per_pair[p, "current"] for p in (1, 2, 3)] == [1, 1, 2]
    got = {(r.pair, r.sheet, r.row, r.column, r.change_type, r.previous_value, r.new_value) for r in I.incremental_changes(files, stage(chain), stage).collect()}
    cells = [spark.createDataFrame(list(X.cells_of(f"v{i}", data)), X.CELLS) for i, data in enumerate(versions())]
    want = {(i + 1, r.sheet, r.row, r.column, r.change_type, r.previous_value, r.new_value) for i in range(5) for r in snapshot_diff(cells[i], cells[i + 1]).collect()}
    assert got == want and (1, "S", 8, 1, "MOD", "3", "4") in got and (2, "S", 2, 1, "MOD", "b", "c") in got and (3, "S", 4, 1, "MOD", "=B4*2", "=B4*3") in got


def test_rows_are_kept_by_content_and_files_read_once(spark, tmp_path, monkeypatch):
    """New files are read once, a part that broke off is not used, and a content is parsed once however many versions have it."""
    (tmp_path / "in").mkdir()
    data = list(versions())
    put = lambda i: (tmp_path / "in" / f"v{i}.xlsx").write_bytes(data[i])
    store = I.RowStore(spark, f"file://{tmp_path}/store")
    assert store.stored().count() == 0
    for i in range(3):
        put(i)
    assert store.add(str(tmp_path / "in")) == 3 and store.add(str(tmp_path / "in")) == 0
    I.read_stored(I.files_of(spark, str(tmp_path / "in" / "v0.xlsx"))).write.parquet(f"{tmp_path}/store/rows/part=broken")
    for i in range(3, 6):
        put(i)
    monkeypatch.setattr(I, "FILES", 2)
    assert store.add(str(tmp_path / "in")) == 3 and store.files().select("part").distinct().count() == 3
    stored = store.stored()
    assert stored.count() == sum(len(list(I.index_of("p", d))) for d in data)
    chain = stored.select("path").distinct().select(F.lit(1).alias("workbook"), F.regexp_extract("path", r"v(\d)\.xlsx", 1).cast("int").alias("seq"), "path")
    plan = I.changed_rows(stored, chain)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "xml binary" not in plan and "xml:binary" not in plan
    got = {(r.pair, r.sheet, r.row, r.column, r.change_type, r.previous_value, r.new_value) for r in store.changes(chain).collect()}
    cells = [spark.createDataFrame(list(X.cells_of(f"v{i}", d)), X.CELLS) for i, d in enumerate(data)]
    want = {(i + 1, r.sheet, r.row, r.column, r.change_type, r.previous_value, r.new_value) for i in range(5) for r in snapshot_diff(cells[i], cells[i + 1]).collect()}
    assert got == want
    wanted = I.changed_rows(stored, chain)
    once = I.parse_contents(stored, wanted)
    assert once.groupBy("digest", "column").count().filter("count > 1").count() == 0 and once.select("digest").distinct().count() <= wanted.select("digest").distinct().count()
    monkeypatch.setattr(I, "NARROW", 0)
    assert sorted(map(str, I.parse_contents(stored, wanted).collect())) == sorted(map(str, once.collect()))
    row = store.reuse(chain).head()
    assert row.rows == stored.count() and 0 < row.rows_reused < row.rows and row.cells_reused < row.cells


def test_report_is_written_and_read_again(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"name <{i}> & \x07", i / 4, i % 2 == 0, dt.date(2024, 1, 1)) for i in range(1, 26)]
    df = spark.createDataFrame(rows, "id bigint, name string, share double, even boolean, day date").repartition(3)
    folder = f"file://{tmp_path}/report"
    manifest = R.write_report(df, folder, "Changes", "id", ["id", "name", "share", "even", "day"], per_sheet=10)
    got = [tuple(r) for r in manifest.select("sheet", "n", "first", "last").orderBy("sheet_no").collect()]
    assert got == [("Changes_001", 10, "1", "10"), ("Changes_002", 10, "11", "20"), ("Changes_003", 5, "21", "25")]
    assert R.check_report(manifest, folder).collect() == []
    cells = X.read_cells(spark, folder)
    assert {(r.address, r.kind, r.text) for r in cells.filter("sheet = 'Changes_003' and row = 3").collect()} == {("A3", "num", "22"), ("B3", "str", "name <22> & "), ("C3", "num", "5.5"), ("D3", "bool", "True"), ("E3", "str", "2024-01-01")}
    wrong = manifest.withColumn("n", F.when(F.col("sheet_no") == 2, F.lit(11)).otherwise(F.col("n"))).withColumn("last", F.when(F.col("sheet_no") == 3, F.lit("26")).otherwise(F.col("last")))
    assert sorted(map(tuple, R.check_report(wrong, folder).collect())) == [("Changes_002", "rows are missing"), ("Changes_003", "other first or last row")]
