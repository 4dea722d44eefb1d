import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.operators import timing as M
from tabloom.plans import artifacts, catalog, profiles
from tabloom.plans.trail import Trail
from tabloom.sources import listings


def test_profiles(spark, tmp_path):
    trail = Trail(spark, f"file://{tmp_path}/trail")
    trail.initialise()
    schema = "identity string, slots bigint, rate double, prefetch bigint, kind string, completed boolean, comparable boolean, tasks bigint"
    rows = [("a", 2, 10.0, 4, "normal_run", True, True, 30), ("a", 4, 10.2, 6, "normal_run", True, True, 30), ("a", 4, 99.0, 6, "normal_run", True, True, 5), ("a", 9, 99.0, 6, "normal_run", True, True, 30), ("b", 3, float("nan"), 2, "normal_run", True, True, 40)]
    got = profiles.record(trail, spark.createDataFrame(rows, schema)).collect()
    assert [(r.identity, r.slots, r.prefetch, r.confidence) for r in got] == [("a", 2, 4, "LOW")]
    assert profiles.load(trail, "a").count() == 1 and trail.read("runtime_benchmark").count() == 2
    trail.append("runtime_profile", spark.createDataFrame([("c", 9, 1, 1.0, "LOW")], "identity string, slots bigint, prefetch bigint, rate double, confidence string"))
    assert profiles.load(trail, "c").count() == 0
    profiles.prefer(trail, "a", 3)
    profiles.prefer(trail, "a", 5)
    assert [tuple(r) for r in trail.read("slot_preference").collect()] == [("a", 5)]
    samples = spark.createDataFrame([("a", 1, 10.0, True), ("a", 2, 20.0, False)], "identity string, at int, rate double, completed boolean")
    # (10 * 1 + 20 * 0.5) / (1 + 0.5)
    assert abs(profiles.running_means(samples, "at").head().mean - 20.0 / 1.5) < 1e-12


def test_reports_are_found(spark):
    books = spark.createDataFrame([(1, "s", "d", "1", "x/A.xlsx"), (2, "s", "d", "2", "y/A.xlsx"), (3, "s", "d", "3", "B.xlsx"), (4, "s", "d", "4", "C.xlsx")], "workbook_id bigint, site_id string, drive_id string, item_id string, name string")
    canonical = {r.workbook_id: r.canonical for r in artifacts.names(books).collect()}
    files = spark.createDataFrame([(n,) for n in ("A.xlsx", "B.xlsx", canonical[1])], "name string")
    assert {r.workbook_id: (r.file, r.how) for r in artifacts.locate(books, files).collect()} == {1: (canonical[1], "canonical"), 2: (None, None), 3: ("B.xlsx", "legacy"), 4: (None, None)}


def test_small_functions(spark):
    lit = F.lit
    row = spark.range(1).select(
        T.same_site(lit("https://X.org/sites/a/f.xlsx"), lit("https://x.org/sites/a/")), T.same_site(lit("https://x.org.evil.com/sites/a/f"), lit("https://x.org/sites/a")), T.same_site(lit("https://x.org/sites/ab"), lit("https://x.org/sites/a")),
        T.version_url(lit("https://x.org/"), lit("/a/it's.xlsx"), lit("512")), T.version_url(lit("https://x.org"), lit("/a"), lit("5 or 1")),
        T.compact(lit(" a  b\ncd "), 4), T.compact(lit("abc"), 4), F.length(T.temporary_name(lit("a"), lit("b"))),
        M.valid_sample(lit(20), lit(8), lit(1.0)), M.valid_sample(lit(19), lit(8), lit(1.0)), M.valid_sample(lit(20), lit(8), lit(float("inf"))),
        M.task_mean(lit(None).cast("double"), [lit(1.0), lit(None).cast("double")], 18.0), M.task_mean(lit(None).cast("double"), [lit(None).cast("double")] * 2, 18.0), M.task_mean(lit(2.0), [lit(1.0)], 18.0),
    ).head()
    assert tuple(row) == (True, False, False, "https://x.org/_api/web/GetFileByServerRelativePath(decodedurl='/a/it''s.xlsx')/Versions(512)/$value", None, "a b…", "abc", 64, True, False, False, 1.0, 18.0, 2.0)
    v = spark.createDataFrame([("512", "1.0"), ("1024", "2.0"), ("90", "0.1")], "version_id string, label string")
    assert sorted(r.version_id for r in listings.from_id(v, 512).collect()) == ["1024", "512"] and listings.id_of_label(v, "2.0").head().version_id == "1024"
    marks = iter([5, 5, 5, 6])
    assert catalog.guarded(lambda: next(marks), lambda: v) is v
    with pytest.raises(catalog.Inconsistent):
        catalog.guarded(lambda: next(marks), lambda: v)
