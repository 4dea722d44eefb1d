import pytest

from tabloom.plans import stored_catalog as C
from tabloom.plans.catalog import Inconsistent
from tabloom.plans.trail import Trail


@pytest.fixture
def catalog(spark, tmp_path):
    t = Trail(spark, f"file://{tmp_path}/trail")
    t.initialise()
    return C.StoredCatalog(t)


def listing(spark, *ids, label=lambda i: f"{i}.0", current=None):
    return spark.createDataFrame([(i, label(i), i == (max(ids) if current is None else current)) for i in ids], C.VERSIONS)


def test_problems_of_listings(spark):
    v = lambda *ids, **kw: C.problem(listing(spark, *ids, **kw))
    assert v(3, 1, 2) is None and v(1, 1) == "two versions have one id" and v(1, 2, label=lambda i: "x") == "two versions have one label"
    assert v(1, 2, current=1) == "the current version is not the last one alone" and C.problem(listing(spark, 1).limit(0)) == "there are no versions"
    assert C.problem(spark.createDataFrame([(None, "1.0", True)], C.VERSIONS)) == "a version has no number or label"


def test_the_stored_catalog_follows_its_source(spark, catalog):
    reads = []

    def source(*ids, delta=None, **kw):
        def read_all():
            reads.append("all")
            return listing(spark, *ids, **kw)

        def read_from(at):
            reads.append(f"from {at}")
            return delta if delta is not None else listing(spark, *[i for i in ids if i >= at])

        versions, how = catalog.synchronise("book", lambda: (max(ids), f"{max(ids)}.0"), read_all, read_from)
        return sorted(r.version_id for r in versions.collect()), how, catalog.load("book")[1]["status"]

    assert source(1, 5) == ([1, 5], "full", "VALID")
    assert source(1, 5) == ([1, 5], "local", "VALID")
    assert source(1, 5, 9, 12) == ([1, 5, 9, 12], "delta", "VALID")
    rows, _ = catalog.load("book")
    assert [r.version_id for r in rows.filter("is_current").collect()] == [12] and reads == ["all", "from 5"]
    assert source(1, 5, 9, 12, 15, delta=listing(spark, 13, 15)) == ([1, 5, 9, 12, 15], "rebuilt", "VALID")
    assert source(1, 5) == ([1, 5], "rebuilt", "VALID")  # the source went back
    # All can't be read: the catalog stays as it was, flagged, and is read in full next time.
    with pytest.raises(Inconsistent, match="one label"):
        source(1, 5, 7, delta=listing(spark, 6, 7), label=lambda i: "x")
    assert catalog.load("book")[1]["status"] == C.FLAGGED and sorted(r.version_id for r in catalog.load("book")[0].collect()) == [1, 5]
    reads.clear()
    assert source(1, 5, 7) == ([1, 5, 7], "rebuilt", "VALID") and reads == ["all"]


def test_catalogs_of_other_workbooks_stay(spark, catalog):
    one = lambda name, *ids: catalog.synchronise(name, lambda: (max(ids), f"{max(ids)}.0"), lambda: listing(spark, *ids), lambda at: listing(spark, *[i for i in ids if i >= at]))
    one("a", 1, 2)
    one("b", 7)
    one("a", 1, 2, 3)
    assert sorted((r.identity, r.version_id, r.pos) for r in catalog.trail.read("version_catalog").collect()) == [("a", "1", 1), ("a", "2", 2), ("a", "3", 3), ("b", "7", 1)]
    # What was changed behind its back is not trusted.
    catalog.trail.replace("version_catalog", catalog.trail.stage(catalog.trail.read("version_catalog").filter("version_id <> '2'")))
    assert one("a", 1, 2, 3)[1] == "rebuilt" and one("b", 7)[1] == "local"
