import pytest
from pyspark.sql import functions as F

from tabloom.plans.catalog import Inconsistent
from tabloom.plans.trail import Trail
from tabloom.streaming import audit as ST


@pytest.fixture
def trail(spark, tmp_path):
    t = Trail(spark, f"file://{tmp_path}/trail")
    t.initialise()
    t.append("workbook", spark.createDataFrame([(1, "s", "d", "i", "Book", "p", "t")], "workbook_id bigint, site_id string, drive_id string, item_id string, name string, path string, created_at string"))
    return t


def content(spark):
    values = {"1": {1: "a", 2: "b"}, "2": {1: "a", 2: "c"}, "10": {1: "a", 2: "c", 3: "d"}}
    return spark.createDataFrame([(1, v, "s", r, 1, t, f"str:{t}") for v, rows in values.items() for r, t in rows.items()], ST.CELLS)


def versions(spark, *ids):
    return spark.createDataFrame([(1, i) for i in ids], ST.VERSIONS)


def test_audit_is_idempotent_and_ordered(spark, trail):
    assert ST.audit(versions(spark, "1", "2"), content(spark), trail).count() == 1
    assert ST.audit(versions(spark, "1", "2", "10"), content(spark), trail).count() == 1
    assert ST.audit(versions(spark, "1", "2", "10"), content(spark), trail).count() == 0
    got = [(r.previous_id, r.current_id, r.address, r.change_type) for r in trail.changes().orderBy("current_id").collect()]
    assert got == [("2", "10", "A3", "ADD"), ("1", "2", "A2", "MOD")]
    assert trail.read("checkpoint").head().version_id == "10"
    assert trail.integrity().count() == 0
    row = trail.listing().head()
    assert (row.pairs, row.changes) == (2, 2)


def test_a_broken_commit_leaves_nothing(spark, trail):
    changes = ST.compare_pairs(ST.missing_pairs(versions(spark, "1", "2"), trail), content(spark))
    trail.append("change", changes)
    assert trail.changes().count() == 0
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    assert trail.read("change").count() == trail.changes().count() == 1


def test_backup_and_restore(spark, trail, tmp_path):
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    trail.backup(f"file://{tmp_path}/backup", 1)
    with pytest.raises(ValueError):
        trail.restore_workbook(f"file://{tmp_path}/backup")
    trail.restore_workbook(f"file://{tmp_path}/backup", replace=True)
    assert trail.changes().count() == 1 and trail.integrity().count() == 0
    trail.append("error", spark.createDataFrame([(9, 99)], "run_id bigint, workbook_id bigint"))
    assert [(r.table, r.problem, r.n) for r in trail.integrity().collect()] == [("error", "orphans", 1)]


def test_constraints(spark, trail):
    with pytest.raises(ValueError):
        trail.append("change", spark.createDataFrame([(1, "1", "2", "s", "A1", "XXX")], "workbook_id bigint, previous_id string, current_id string, sheet string, address string, change_type string"))


def test_stream(spark, trail, tmp_path):
    source = str(tmp_path / "in")
    run = lambda: ST.start(spark.readStream.schema(ST.VERSIONS).parquet(source), content(spark), trail, str(tmp_path / "ck")).awaitTermination(120)
    versions(spark, "1", "2").write.parquet(source)
    run()
    versions(spark, "10").write.mode("append").parquet(source)
    run()
    assert trail.changes().agg(F.count("*")).head()[0] == 2
    versions(spark, "5").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="below the checkpoint"):
        run()
    assert issubclass(Inconsistent, ValueError)


def test_replayed_versions_make_no_pairs(spark, trail, tmp_path):
    """Versions that arrive again are left out; new ones are paired with their neighbours among all known ones."""
    source = str(tmp_path / "in")
    cells = spark.createDataFrame([(1, str(v), "s", 1, 1, f"t{v}", f"str:t{v}") for v in range(1, 9)], ST.CELLS)
    run = lambda: ST.start(spark.readStream.schema(ST.VERSIONS).parquet(source), cells, trail, str(tmp_path / "ck")).awaitTermination(120)
    versions(spark, "1", "2", "3", "4", "5").write.parquet(source)
    run()
    pairs = lambda: sorted((r.previous_id, r.current_id) for r in trail.read("pair").collect())
    want = [("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")]
    assert pairs() == want
    versions(spark, "2", "3").write.mode("append").parquet(source)
    run()
    assert pairs() == want and trail.read("checkpoint").head().version_id == "5"
    # An interval beyond the checkpoint is done already; what arrives later closes the gap before it.
    ST.audit(versions(spark, "7", "8"), cells, trail, move_checkpoint=False)
    versions(spark, "4", "6").write.mode("append").parquet(source)
    run()
    assert pairs() == [*want, ("5", "6"), ("6", "7"), ("7", "8")] and trail.read("checkpoint").head().version_id == "8"


def test_a_pair_that_was_begun_is_replaced(spark, trail):
    trail.append("pair", spark.createDataFrame([(7, 1, 3, "1", "2", "EM_ANDAMENTO", None, 0)], "pair_id bigint, workbook_id bigint, run_id bigint, previous_id string, current_id string, status string, digest string, changes bigint"))
    assert ST.audit(versions(spark, "1", "2"), content(spark), trail).count() == 1
    assert [(r.status, r.changes) for r in trail.read("pair").collect()] == [("PROCESSADA", 1)] and trail.integrity().count() == 0


def test_a_pair_holds_a_digest_of_its_content(spark, trail):
    a = {r.version_id: r.digest for r in ST.content_digests(content(spark)).collect()}
    b = {r.version_id: r.digest for r in ST.content_digests(content(spark).orderBy(F.desc("row"))).collect()}
    assert a == b and len(set(a.values())) == 3 and {len(d) for d in a.values()} == {64}
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    assert trail.read("pair").head().digest == a["2"]


def test_runs_and_failures(spark, trail):
    one = trail.open_run(1)
    ST.audit(versions(spark, "1", "2"), content(spark), trail, run_id=one)
    trail.finish_run(one)
    two = trail.open_run(1)
    trail.fail_run(two, "download", "no answer")
    rows = {r.run_id: r for r in trail.read("run").collect()}
    assert (rows[one].status, rows[one].processed, rows[one].changes) == ("CONCLUIDA", 1, 1) and (rows[two].status, rows[two].message) == ("FALHA", "no answer")
    assert rows[one].code.startswith("AUD-") and len(rows[one].code.rsplit("-", 1)[1]) == 8 and rows[one].started_at.endswith("Z")
    assert [r.stage for r in trail.read("error").collect()] == ["download"] and trail.read("checkpoint").head().version_id == "2"
    # The next run goes on from the checkpoint.
    assert ST.audit(versions(spark, "1", "2", "10"), content(spark), trail, run_id=trail.open_run(1)).count() == 1


def test_full_restore_keeps_a_safety_copy(spark, trail, tmp_path):
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    trail.backup(f"file://{tmp_path}/b")
    ST.audit(versions(spark, "1", "2", "10"), content(spark), trail)
    safety = trail.restore(f"file://{tmp_path}/b")
    assert trail.read("pair").count() == 1 and spark.read.parquet(f"{safety}/pair").count() == 2


def test_a_replacement_that_broke_off_leaves_the_old_table(spark, trail):
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    (path, fs), (old, _) = trail._path("pair"), trail._path("pair.old")
    fs.rename(path, old)
    assert trail.read("pair").count() == 1
    trail.initialise()
    assert fs.exists(path) and trail.read("pair").count() == 1


def test_a_pair_waits_for_its_content(spark, trail):
    """A version that is not loaded yet makes no deletions: its pairs stay open, with an error, until its cells are there."""
    cells = content(spark)
    assert ST.audit(versions(spark, "1", "2", "10"), cells.filter("version_id <> '2'"), trail, run_id=5).count() == 0
    assert trail.read("pair").count() == 0 and trail.read("checkpoint").count() == 0
    assert sorted((r.run_id, r.stage, r.message.split(": ")[1]) for r in trail.read("error").collect()) == [(5, "content", "1 -> 2"), (5, "content", "2 -> 10")]
    assert ST.audit(versions(spark, "1", "2", "10"), cells, trail).count() == 2
    assert {r.change_type for r in trail.changes().collect()} == {"ADD", "MOD"} and trail.read("checkpoint").head().version_id == "10"


def test_an_empty_workbook_is_not_one_that_is_not_loaded(spark, trail):
    loaded = spark.createDataFrame([(1, "1", "a" * 64), (1, "2", "b" * 64)], "workbook_id bigint, version_id string, digest string")
    assert ST.audit(versions(spark, "1", "2", "10"), content(spark).filter("version_id = '1'"), trail, digests=loaded).count() == 1
    assert {r.change_type for r in trail.changes().collect()} == {"DEL"} and trail.read("checkpoint").head().version_id == "2"


def test_a_checkpoint_moves_over_done_pairs_only_and_never_back(spark, trail):
    cells = spark.createDataFrame([(1, str(v), "s", 1, 1, f"t{v}", f"str:t{v}") for v in (1, 2, 3, 4, 5, 6)], ST.CELLS)
    at = lambda: [r.version_id for r in trail.read("checkpoint").collect()]
    ST.audit(versions(spark, "1", "2", "3", "4", "5"), cells.filter("version_id <> '4'"), trail)
    assert at() == ["3"]
    ST.audit(versions(spark, "1", "2"), cells, trail)  # an older listing
    assert at() == ["3"]
    ST.audit(versions(spark, "5", "6"), cells, trail)  # a listing with a gap after the checkpoint
    assert at() == ["3"] and trail.read("pair").filter("current_id = '6'").count() == 1
    ST.audit(versions(spark, "3", "4", "5", "6"), cells, trail)
    assert at() == ["6"]
    trail.move_checkpoint(spark.createDataFrame([(1, "2"), (2, "1")], ST.VERSIONS))
    assert sorted(at()) == ["1", "6"]


def test_a_made_up_digest_is_not_final(spark, trail):
    from tabloom.plans.trail import authoritative

    rows = spark.createDataFrame([("PROCESSADA", d) for d in ("0" * 64, "x" * 64, "a" * 63, "0" * 63 + "1", None)] + [("EM_ANDAMENTO", "a" * 64)], "status string, digest string")
    assert [r.digest for r in authoritative(rows).collect()] == ["0" * 63 + "1"]


def test_a_stream_tries_versions_without_content_again(spark, trail, tmp_path):
    source = str(tmp_path / "in")
    table = str(tmp_path / "cells")
    cells = spark.createDataFrame([(1, str(v), "s", 1, 1, f"t{v}", f"str:t{v}") for v in (1, 2, 3, 4)], ST.CELLS)
    cells.filter("version_id in ('1', '3')").write.parquet(table)
    run = lambda: ST.start(spark.readStream.schema(ST.VERSIONS).parquet(source), spark.read.schema(ST.CELLS).parquet(table), trail, str(tmp_path / "ck")).awaitTermination(120)
    versions(spark, "1", "2", "3").write.parquet(source)
    run()
    assert trail.read("pair").count() == 0 and trail.read("pending_version").count() == 3
    cells.filter("version_id in ('2', '4')").write.mode("append").parquet(table)
    versions(spark, "4").write.mode("append").parquet(source)
    run()
    assert sorted((r.previous_id, r.current_id) for r in trail.read("pair").collect()) == [("1", "2"), ("2", "3"), ("3", "4")]
    assert trail.read("pending_version").count() == 0 and trail.read("checkpoint").head().version_id == "4"


def test_pending_pairs(spark, trail):
    known = versions(spark, "1", "2", "10").union(spark.createDataFrame([(2, "5")], ST.VERSIONS))
    count = lambda: sorted(tuple(r) for r in ST.pending(known, trail).collect())
    assert count() == [(1, 3, 2), (2, 1, 0)]
    ST.audit(versions(spark, "1", "2"), content(spark), trail)
    assert count() == [(1, 3, 1), (2, 1, 0)]
