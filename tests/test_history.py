import shutil

import pytest
from pyspark.sql import functions as F

from tabloom.plans.trail import Trail
from tabloom.sources import history as H
from tabloom.streaming import audit as ST

from .test_xlsx import book


def put(root, workbook, version, *values, name=None):
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="str"><v>{v}</v></c></row>' for i, v in enumerate(values, 1))
    (root / str(workbook)).mkdir(parents=True, exist_ok=True)
    (root / str(workbook) / (name or f"{version}.xlsx")).write_bytes(book({"S": rows}))


@pytest.fixture
def trail(spark, tmp_path):
    t = Trail(spark, f"file://{tmp_path}/trail")
    t.initialise()
    return t


def test_three_arrivals_feed_the_audit(spark, trail, tmp_path):
    root = tmp_path / "history"
    spark.dataSource.register(H.HistorySource)
    stream = lambda: spark.readStream.format("tabloom_history").option("root", f"file://{root}").load()

    def arrive():
        query = ST.start(stream(), H.contents(spark, f"file://{root}"), trail, str(tmp_path / "at"), available_now=False)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    put(root, 1, 2, "a", "b")
    put(root, 1, 10, "a", "c")
    put(root, 2, 5, "x")
    put(root, 1, 99, "no version", name="note.xlsx")
    arrive()
    pairs = lambda: sorted((r.workbook_id, r.previous_id, r.current_id, r.changes) for r in trail.read("pair").collect())
    assert pairs() == [(1, "2", "10", 1)]
    put(root, 2, 6)  # an empty workbook: all is deleted
    put(root, 1, 11, "a", "c", name="11.XLSX")
    arrive()
    assert pairs() == [(1, "10", "11", 0), (1, "2", "10", 1), (2, "5", "6", 1)]
    put(root, 2, 7, "y", "z")
    arrive()
    assert pairs()[-1] == (2, "6", "7", 2)
    assert sorted((r.workbook_id, r.version_id) for r in trail.read("checkpoint").collect()) == [(1, "11"), (2, "7")]
    got = sorted((r.workbook_id, r.current_id, r.address, r.change_type, r.previous_value, r.new_value) for r in trail.changes().collect())
    assert got == [(1, "10", "A2", "MOD", "b", "c"), (2, "6", "A1", "DEL", "x", None), (2, "7", "A1", "ADD", None, "y"), (2, "7", "A2", "ADD", None, "z")]
    put(root, 2, 1, "late")
    with pytest.raises(Exception, match="not those that were given"):
        arrive()


def test_a_batch_is_given_again_alike(tmp_path):
    root = tmp_path / "h"
    for v in (1, 2, 3):
        put(root, 7, v, "a")
    stream = H.HistoryStream(str(root), 1, 0)
    first = stream.latestOffset()
    put(root, 7, 4, "b")
    put(root, 8, 1, "b")
    rows = lambda a, b: [r[:2] for p in stream.partitions(a, b) for r in stream.read(p)]
    assert first == {"7": [3, 3]} and rows(stream.initialOffset(), first) == [(7, "1"), (7, "2"), (7, "3")]
    assert rows(first, stream.latestOffset()) == rows(first, stream.latestOffset()) == [(7, "4"), (8, "1")]
    shutil.rmtree(root / "7")
    with pytest.raises(H.Inconsistent):
        stream.partitions(first, {"7": [4, 4]})


def test_shards_part_the_workbooks(tmp_path):
    root = tmp_path / "h"
    for w in range(20):
        put(root, w, 1, "a")
    parts = [set(H.listed(str(root), 3, i)) for i in range(3)]
    assert all(parts) and set.union(*parts) == {str(w) for w in range(20)} and sum(map(len, parts)) == 20
    assert H.listed(str(tmp_path / "nowhere")) == {}


def test_versions_as_a_table(spark, tmp_path):
    root = tmp_path / "h"
    put(root, 3, 1, "a", "b")
    put(root, 3, 2, "a")
    spark.dataSource.register(H.HistorySource)
    versions = spark.read.format("tabloom_history").option("root", str(root)).load()
    assert sorted((r.workbook_id, r.version_id) for r in versions.collect()) == [(3, "1"), (3, "2")]
    (root / "3" / "2.xlsx").unlink()
    gone = spark.createDataFrame([(3, "1", f"{root}/3/1.xlsx"), (3, "2", f"{root}/3/2.xlsx")], H.VERSIONS)
    rows = H.read_contents(gone).groupBy("version_id").agg(F.count("sheet").alias("cells"), F.count("digest").alias("digests")).collect()
    assert [tuple(r) for r in rows] == [("1", 2, 1)]
