import hashlib
import json
from base64 import b64encode
from urllib.parse import quote

import pytest

from tabloom.sources import listings as L
from tabloom.sources import paged as P


def answer(ids, link=None, shape=0, label=lambda i: f"{i}.0"):
    """A page in one of the four shapes that services write."""
    items = [{"ID": i, "VersionLabel": label(i)} for i in ids]
    if shape == 0:
        return json.dumps({"value": items} | ({"@odata.nextLink": link} if link else {}))
    if shape == 1:
        return json.dumps({"value": items} | ({"odata.nextLink": link} if link else {}))
    if shape == 2:
        return json.dumps({"d": {"results": items} | ({"__next": link} if link else {})})
    return json.dumps({"d": items} | ({"__next": link} if link else {}))


def put(root, listing, pages):
    (root / listing).mkdir(parents=True, exist_ok=True)
    for page, body in pages.items():
        (root / listing / (quote(page, safe="") + ".json")).write_text(body)


def chain(shape, **kw):
    return {"0": answer([1, 2, 3], "x?$skip=a", shape, **kw), "x?$skip=a": answer([5, 8, 9], "x?$skip=b", shape, **kw), "x?$skip=b": answer([10], None, shape, **kw)}


#: listing -> (pages, problem)
LISTINGS = {f"shape{i}": (chain(i), None) for i in range(4)} | {
    "skipped": ({"0": answer([9, 8, 7]), "3": answer([6, 5, 4]), "6": answer([3, 2])}, None),
    "one": ({"0": answer([4])}, None),
    "none": ({"0": answer([])}, None),
    "full last": ({"0": answer([1, 2, 3]), "3": answer([])}, None),
    "error": ({"0": '{"error": "busy"}'}, "an answer has no list"),
    "absent": ({"0": answer([1, 2, 3], "y")}, "a page is missing"),
    "truncated": ({"0": answer([1, 2, 3])}, "a page is missing"),
    "ring": ({"0": answer([1], "0")}, "there is no first page"),
    "two into one": ({"0": answer([1], "z"), "5": answer([2], "z"), "z": answer([9])}, "a page is gone on with twice"),
    "apart": ({"0": answer([1]), "7": answer([2])}, "pages don't hang together"),
    "empty": ({"0": answer([], "z"), "z": answer([1])}, "an empty page goes on"),
    "no label": ({"0": json.dumps({"value": [{"ID": 1}]})}, "a version has no id or label"),
    "no number": ({"0": json.dumps({"value": [{"ID": "a", "VersionLabel": "1"}]})}, "a version has no id or label"),
    "twice": ({"0": answer([1, 2, 3]), "3": answer([3])}, "an id comes twice"),
    "labels": ({"0": answer([1, 2], label=lambda i: "same")}, "a label stands for two ids"),
    "order": ({"0": answer([1, 5, 3])}, "a page is missing"),
    "order2": ({"0": answer([1, 5]), "2": answer([3])}, "pages don't hang together"),
    "order3": ({"0": answer([1, 5, 6]), "3": answer([4])}, "ids are out of order"),
    "moved": (chain(0), "the listing changed while it was read"),
    "unmarked": (chain(1), "there is no watermark"),
}


def test_what_is_proven_and_what_is_refused(spark, tmp_path):
    for name, (pages, _) in LISTINGS.items():
        put(tmp_path / "in", name, pages)
    spark.dataSource.register(P.PagesSource)
    pages = spark.read.format("tabloom_pages").option("root", f"file://{tmp_path}/in").load()
    assert pages.rdd.getNumPartitions() == sum(len(p) for p, _ in LISTINGS.values())
    marks = spark.createDataFrame([(n, "7", "8" if n == "moved" else "7") for n in LISTINGS if n != "unmarked"], "listing string, before string, after string")
    got = {r.listing: r for r in P.proof(pages, marks, page_size=3).collect()}
    assert {n: r.problem for n, r in got.items()} == {n: problem for n, (_, problem) in LISTINGS.items()}
    assert (got["shape2"].pages, got["shape2"].versions, got["skipped"].descending, got["none"].versions) == (3, 7, True, 0)
    versions, outcome = P.enumerated(pages, marks, page_size=3)
    assert {r.listing for r in outcome.filter("mode = 'full'").collect()} == {n for n, (_, problem) in LISTINGS.items() if problem is None}
    assert sorted(r.version_id for r in versions.filter("listing = 'shape3'").collect()) == [1, 2, 3, 5, 8, 9, 10] and versions.filter("listing = 'moved'").count() == 0
    assert spark.read.format("tabloom_pages").option("root", f"{tmp_path}/nowhere").load().count() == 0


def test_a_delta_that_is_not_proven_falls_back(spark):
    full = [(n, "0", answer([1, 2])) for n in "abcde"] + [("f", "0", answer([1], "gone"))]
    delta = {"a": answer([2, 3]), "b": answer([3]), "c": answer([2, 3], "gone"), "d": answer([2, 3], label=lambda i: "other" + str(i)), "f": answer([9])}
    frame = lambda rows: spark.createDataFrame(rows, P.PAGES)
    marks = spark.createDataFrame([(n, "1", "1") for n in "abcdef"], "listing string, before string, after string")
    known = spark.createDataFrame([(n, 2, "2.0") for n in "abcdf"], "listing string, version_id bigint, label string")
    versions, outcome = P.enumerated(frame(full), marks, frame([(n, "0", b) for n, b in delta.items()]), marks, known)
    assert {r.listing: (r.mode, r.problem) for r in outcome.collect()} == {
        "a": ("delta", None), "b": ("fallback", "it doesn't begin with the known version"), "c": ("fallback", "a page is missing"), "d": ("fallback", "it doesn't begin with the known version"),
        "e": ("full", None), "f": ("refused", "it doesn't begin with the known version"),
    }
    got = {}
    for r in versions.collect():
        got.setdefault(r.listing, []).append(r.version_id)
    assert {n: sorted(v) for n, v in got.items()} == {"a": [2, 3], "b": [1, 2], "c": [1, 2], "d": [1, 2], "e": [1, 2]}


def test_blocks_are_carried_in_order(spark):
    data = {n: bytes((i * 7 + k) % 251 for i in range(5000)) for k, n in enumerate(("good", "gap", "overlap", "short", "long", "sizes", "bad", "twice"))}
    rows = []
    for name, whole in data.items():
        for at in range(0, 5000, 700):
            block = b64encode(whole[at : at + 700]).decode()
            offset, size = at, 5000
            if name == "gap" and at == 1400:
                continue
            if name == "overlap" and at == 2100:
                offset = 2099
            if name == "short":
                size = 5001
            if name == "long":
                size = 4999
            if name == "sizes" and at == 700:
                size = 5002
            if name == "bad" and at == 700:
                block = "!"
            rows += [(name, offset, block, size)] * (2 if name == "twice" and at == 700 else 1)
    rows += [("empty", 0, "", 0), (None, 0, b64encode(b"x").decode(), 1)]
    df = spark.createDataFrame(rows[::-1], "file string, offset bigint, data string, size bigint").repartition(5)
    got = {r.file: r for r in L.blocks(df).collect()}
    assert {n: r.problem for n, r in got.items()} == {"good": None, "gap": "gap", "overlap": "overlap", "short": "bytes are missing", "long": "too many bytes", "sizes": "sizes differ", "bad": "not a block", "twice": "overlap", "empty": None, None: None}
    assert got["good"].digest == hashlib.sha256(data["good"]).hexdigest() and got["empty"].digest == hashlib.sha256(b"").hexdigest() and (got["good"].blocks, got["good"].bytes) == (8, 5000)
    assert L.blocks(df.limit(0)).count() == 0


def test_a_large_file_is_not_held(spark):
    """A gigabyte in blocks: the task's Python process grows by a part of it only."""
    block = 1 << 19
    n = 2048
    from pyspark.sql import functions as F

    df = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") * block).alias("offset"), F.base64(F.repeat(F.lit("z"), block).cast("binary")).alias("data"), F.lit(n * block).alias("size"))
    row = L.blocks(df).head()
    whole = hashlib.sha256()
    for _ in range(n):
        whole.update(b"z" * block)
    assert (row.problem, row.bytes, row.digest) == (None, n * block, whole.hexdigest())

    def peak(batches):
        import resource

        import pyarrow as pa

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for _ in L._carry(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024])], names=["mb"])

    rows = df.select("file", "offset", F.unbase64("data").alias("data"), "size").repartition("file").sortWithinPartitions("file", "offset")
    assert max(r.mb for r in rows.mapInArrow(peak, "mb bigint").collect()) < 400


@pytest.mark.parametrize("body", ['{"value": 3}', "[]", "nonsense", ""])
def test_other_answers_are_refused(spark, body):
    pages = spark.createDataFrame([("a", "0", body)], P.PAGES)
    marks = spark.createDataFrame([("a", "1", "1")], "listing string, before string, after string")
    assert P.proof(pages, marks).head().problem == "an answer has no list"


def test_listings_by_identity_and_name(spark):
    rows = spark.createDataFrame([("A1", "first", 1), ("a1", "second", 2), ("b", "only", 3)], "id string, what string, at int")
    assert sorted(r.what for r in L.last_by_identity(rows, "id", "at").collect()) == ["only", "second"]
    folders = spark.createDataFrame([("2", "b/X"), ("1", "B/x"), ("3", "a"), ("4", "C")], "folder_id string, path string")
    assert [r.folder_id for r in L.in_name_order(folders).collect()] == ["3", "1", "2", "4"]
    pages = spark.createDataFrame([(2, '{"value":[{"id":"1","size":"7"}]}'), (1, '{"value":[{"id":"3"},{"id":"2","size":"x"}]}')], "page int, body string")
    assert [(r.version_id, r.size) for r in L.versions(pages).collect()] == [("1", 7), ("2", None), ("3", None)]
    assert [r.version_id for r in L.from_id(L.versions(pages), 2).collect()] == ["2", "3"]
