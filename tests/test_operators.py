import random
import time
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from tabloom.operators import alignment as A
from tabloom.operators import diff as D
from tabloom.operators import sequences as S
from tabloom.operators import timing as M
from tabloom.plans import catalog


def cells(spark, values):
    return spark.createDataFrame([("s", r, c, str(v), f"{type(v).__name__}:{v}") for (r, c), v in values.items()], "sheet string, row bigint, column bigint, text string, key string")


def brute(a, b):
    out = set()
    for k in {*a, *b}:
        x, y = a.get(k), b.get(k)
        if type(x) is not type(y) or x != y:
            out.add((k, "ADD" if x is None else "DEL" if y is None else "MOD"))
    return out


def test_diff_equals_brute_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        make = lambda: {(rng.randint(1, 9), rng.randint(1, 4)): rng.choice([0, False, "", "0", 15, "x"]) for _ in range(25)}
        a, b = make(), make()
        for diff in (D.snapshot_diff, D.hash_skip_diff):
            got = {((r.row, r.column), r.change_type) for r in diff(cells(spark, a), cells(spark, b)).collect()}
            assert got == brute(a, b)
    assert D.snapshot_diff(cells(spark, {(1, 1): 1}).limit(0), cells(spark, {(1, 1): 1}).limit(0)).count() == 0


def test_alignment_of_an_inserted_row():
    base = [(i, [f"T:{i}", f"N:{i * i}"]) for i in range(1, 9)]
    other = [(i if i < 4 else i + 1, p) for i, p in base] + [(4, ["T:new"])]
    assert A.align(base, sorted(other)) == {i: i if i < 4 else i + 1 for i in range(1, 9)}
    assert A.align(base, [(1, ["T:q"])]) == {1: 1}
    assert A.align([], base) == {}


def test_gaps(spark):
    anchors = spark.createDataFrame([(1, b, b + (b > 3) - 2 * (b > 8)) for b in (1, 2, 3, 4, 5, 8, 11, 12)], "k int, base_pos bigint, eval_pos bigint")
    assert sorted((r.side, r.position) for r in A.gaps(anchors, ["k"]).collect()) == [("added", 4), ("removed", 9), ("removed", 10)]


def plain_inference(position, mapping):
    """The rule once more, on its own: a mapping with its sorted keys."""
    found, at = mapping
    if position in found:
        return found[position]
    i, j = bisect_left(at, position), bisect_right(at, position)
    shifts = {found[p] - p for p in at[max(i - 1, 0) : i] + at[j : j + 1]}
    return position + (shifts.pop() if len(shifts) == 1 else 0)


def test_inference_over_a_long_axis(spark):
    """40,000 positions of one key, and keys without anchors, with one, and with few: as by hand, without a pass for each row."""
    rng = random.Random(11)
    asked = [("long", p) for p in range(0, 80_000, 2)] + [(k, p) for k in ("none", "one", "few") for p in range(300)]
    anchors = [("long", p, p + p // 9000) for p in range(501, 79_000) if p % 7 and (p // 400) % 5]
    anchors += [("one", 120, 90)] + [("few", p, p + rng.choice([0, 0, 3])) for p in rng.sample(range(20, 280), 60)]
    maps = {k: {b: e for a, b, e in anchors if a == k} for k in ("long", "none", "one", "few")}
    want = {(k, p): plain_inference(p, (maps[k], at)) for k, at in ((k, sorted(m)) for k, m in maps.items()) for a, p in asked if a == k}
    positions = spark.createDataFrame(asked, "k string, position bigint")
    frame = A.infer(positions, spark.createDataFrame(anchors, "k string, base_pos bigint, eval_pos bigint"), ["k"])
    began = time.perf_counter()
    got = {(r.k, r.position): r.mapped for r in frame.collect()}
    assert got == want and any(p != m for (_, p), m in want.items())
    assert time.perf_counter() - began < 90


def test_inference_of_repeated_positions_and_null_keys(spark):
    """As the SQL has it: a row for each anchor of a position, and no anchor for a null key."""
    positions = spark.createDataFrame([("a", p) for p in (1, 5, 5, 6, 20, None)] + [(None, 5), (None, 6)], "k string, position bigint")
    anchors = spark.createDataFrame([("a", 5, 7), ("a", 5, 7), ("a", 8, 10), ("a", 20, 22), ("a", 20, 30), (None, 5, 50), (None, 9, 90)], "k string, base_pos bigint, eval_pos bigint")
    got = sorted(map(str, map(tuple, A.infer(positions, anchors, ["k"]).collect())))
    assert got == sorted(map(str, [("a", 1, 3), ("a", 5, 7), ("a", 5, 7), ("a", 6, 8), ("a", 20, 22), ("a", 20, 30), ("a", None, None), (None, 5, 5), (None, 6, 6)]))


def test_sheets_number_rows_without_gaps(spark):
    ids = [3, 4, 900, 10**12, 10**12 + 1, -5]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r.id: (r.seq, r.sheet_no) for r in S.sheets(rows, "id", 4).collect()}
    assert got == {i: (n, (n - 1) // 4 + 1) for n, i in enumerate(sorted(ids), 1)}
    assert S.sheets(rows.limit(0), "id", 4).count() == 0
    with pytest.raises(ValueError, match="no id"):
        S.sheets(rows.union(spark.createDataFrame([(None,)], "id bigint")), "id", 4)


def test_intervals_are_resolved_or_refused(spark):
    v = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = lambda rows, *ends: sorted(r.id for r in S.resolve_interval(rows, F.col("id"), *ends).collect())
    assert got(v(5, 1, 9, 3), 3, 9) == [3, 5, 9] and got(v(5, 1, 9), None, 5) == [1, 5] and got(v(2, 1)) == [1, 2]
    for rows, ends, why in ((v(1), (), "fewer"), (v(1, 2, 2), (), "one id"), (v(1, None), (), "one id"), (v(1, 3), (2, 3), "no version has the id 2"), (v(1, 3), (1, 4), "id 4"), (v(1, 3), (3, 1), "in order"), (v(1, 3), (3, 3), "in order"), (v(1, 3), (3, None), "in order")):
        with pytest.raises(ValueError, match=why):
            S.resolve_interval(rows, F.col("id"), *ends)


def test_sheets_of_many_ranges_and_an_outlier(spark, monkeypatch):
    """Ranges are cut at values that occur, so one far value doesn't put all others in one range."""
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    rows = spark.range(1000).select("id").union(spark.createDataFrame([(10**15,)], "id bigint"))
    made = S.sheets(rows, "id", 100)
    assert [r.seq for r in made.orderBy("id").collect()] == list(range(1, 1002))
    assert made.groupBy("sheet_no").count().count() == 11


def test_current_versions_that_contradict_their_history(spark):
    v = lambda rows: spark.createDataFrame(rows, "book int, version_id bigint, label string")
    history = v([(b, 1, "1.0") for b in range(5)] + [(b, 2, "2.0") for b in range(5)])
    current = v([(0, 2, "2.0"), (1, 3, "3.0"), (2, 2, "9.0"), (3, 3, "1.0"), (4, 1, "1.0"), (5, 1, "1.0")])
    assert {r.book: r.problem for r in catalog.conflicts(history, current, ["book"]).collect()} == {2: "the id has another label", 3: "the label has another id", 4: "the history goes beyond it"}
    got = sorted((r.book, r.version_id, r.label) for r in catalog.reconciled(history, current, ["book"]).collect())
    assert got == sorted([(b, 1, "1.0") for b in range(6)] + [(b, 2, "2.0") for b in range(5)] + [(1, 3, "3.0")])


def test_robust_means(spark):
    def mean(values, f):
        return spark.createDataFrame([(values,)], "v array<double>").select(f(F.col("v"))).head()[0]

    assert mean([1.0, 3.0], M.winsorised_mean) == 2
    assert abs(mean([2.0, 2.0, 2.0, 100.0], M.winsorised_mean) - 3.0) < 1e-12
    assert mean([5.0, 1.0, 3.0], M.median_of) == 3
    assert mean([1.0, 1.0, 1.0, 9.0], M.slot_mean) == 1.25
    assert mean([5.0, 1.0, 3.0], lambda v: M.nearest_rank(v, 0.95)) == 5


def test_catalog(spark):
    v = lambda *ids: spark.createDataFrame([(i,) for i in ids], "version_id bigint")
    ids = lambda df: sorted(r[0] for r in df.collect())
    run = lambda local, now, delta: catalog.synchronise(local, now, lambda: v(1, 2, 3, 4), lambda a: delta)
    assert run(None, 4, None)[1] == "full" and run(v(1, 2), 2, None)[1] == "local"
    got, how = run(v(1, 2), 4, v(2, 3, 4))
    assert how == "delta" and ids(got) == [1, 2, 3, 4]
    assert run(v(1, 2), 4, v(3, 4))[1] == "rebuilt" and run(v(1, 9), 4, None)[1] == "rebuilt"


def test_aligned_rows_takes_the_whole_table(spark, tmp_path):
    from tabloom import queries

    rows = [(k, f"part {k}", f"Brand#{k % 7}", f"type {k * 31 % 101}", k % 50) for k in range(1, 951)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.block, r.base_pos): r.eval_pos for r in queries.aligned_rows(spark, str(tmp_path)).collect()}
    want = {}
    for block in range(10):
        base = [(k, ["T:" + name, "T:" + brand.lower(), "T:" + kind, f"N:{size}"]) for k, name, brand, kind, size in rows if (k - 1) // 100 == block]
        want |= {(block, at): to for at, to in A.align(base, [(k + (k - 1) % 100 // 30, p) for k, p in base]).items()}
    assert got == want and {k for _, k in got} == set(range(1, 951))


def test_reports_and_remaps_of_whole_tables(spark, tmp_path):
    from tabloom import queries

    orders = [(k, k % 10) for k in (1, 50, 100, 101, 20_000, 20_001, 30_007)]
    lines = [(k, n, k % 7, k % 3, "ANR"[(k + n) % 3]) for k, _ in orders for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    flags = [r[4] for r in lines]
    assert [tuple(r) for r in queries.QUERIES["report_stats"](spark, str(tmp_path)).collect()] == [(7, 14, flags.count("A"), flags.count("N"), flags.count("R"), 1, 30_007)]
    new = {k: 5_000_001 + n for n, (k, _) in enumerate(orders)}
    assert sorted(map(tuple, queries.QUERIES["restore_remap"](spark, str(tmp_path)).collect())) == sorted((new[k], *rest) for k, *rest, _ in lines)


def test_coordinates_and_merged_values(spark):
    from tabloom.operators import areas

    cells = spark.createDataFrame([("S", 1, 1, "a"), ("S", 1, 3, " "), ("S", 5, 2, "b")], "sheet string, row bigint, column bigint, text string")
    styles = spark.createDataFrame([("S", 9, 9, "font", "x")], "sheet string, row bigint, column bigint, part string, value string")
    at = lambda df: sorted((r.row, r.column) for r in df.collect())
    assert at(areas.meaningful(cells)) == [(1, 1), (5, 2)] and at(areas.relevant(cells, styles)) == [(1, 1), (5, 2), (9, 9)] == at(areas.relevant(cells, styles.union(styles)))
    assert [r.row for r in areas.used(areas.relevant(cells, styles), "row").collect()] == [1, 5, 9]
    layout = spark.createDataFrame([("S", "merge", 0, 0, "A1:B3", "A1:B3"), ("S", "row", 2, 2, "", "{}")], "sheet string, item string, first bigint, last bigint, ref string, value string")
    ranges = areas.merged_ranges(layout)
    assert tuple(ranges.head()) == ("S", "A1:B3", 1, 3, 1, 2)
    want = spark.createDataFrame([("S", r, c) for r, c in ((1, 1), (3, 2), (4, 1), (5, 2))], "sheet string, row bigint, column bigint")
    assert {(r.row, r.column): (r.text, r.range_id) for r in areas.effective(want, cells, ranges).collect()} == {(1, 1): ("a", "A1:B3"), (3, 2): ("a", "A1:B3"), (4, 1): (None, None), (5, 2): ("b", None)}


def test_content_of_inserted_areas(spark):
    from tabloom.operators import areas

    cells = spark.createDataFrame([("S", 1, 1, "anchor"), ("S", 4, 1, "x"), ("S", 4, 3, "both"), ("S", 6, 3, "y"), ("S", 7, 7, "no"), ("S", 9, 5, "wide")], "sheet string, row bigint, column bigint, text string")
    ranges = spark.createDataFrame([("S", "A1:B4", 1, 4, 1, 2), ("S", "E9:F9", 9, 9, 5, 6), ("S", "J1:K2", 1, 2, 10, 11)], "sheet string, range_id string, min_row bigint, max_row bigint, min_col bigint, max_col bigint")
    pos = lambda *ps: spark.createDataFrame([("S", p) for p in ps], "sheet string, position bigint")
    got = {(r.location, r.text, r.area) for r in areas.area_content(cells, ranges, pos(4), pos(3, 6)).collect()}
    assert got == {("S!A1:B4", "anchor", "row"), ("S!C4", "both", "row"), ("S!C6", "y", "column"), ("S!E9:F9", "wide", "column")}


def test_options_of_a_comparison(spark):
    from tabloom.operators import structural as X

    layout = "sheet string, item string, first bigint, last bigint, ref string, value string"

    def make(rows, height, extra=()):
        cells = [("S", r, c, "str", t) for r, ts in rows.items() for c, t in enumerate(ts, 1)]
        frame = spark.createDataFrame(cells, "sheet string, row bigint, column bigint, kind string, text string")
        return X.Book(frame, spark.createDataFrame([("S", "visible")], "sheet string, state string"), spark.createDataFrame([("S", "row", 1, 1, "", f'{{"height": "{height}", "hidden": false}}'), *extra], layout))

    base = {i: [f"name {i}", f"x{i * i}"] for i in range(1, 9)}
    other = {i if i < 4 else i + 1: list(t) for i, t in base.items()} | {4: ["new", "merged"]}
    other[8][1] = "changed"
    a, b = make(base, 10), make(other, 20, [("S", "merge", 0, 0, "B4:D4", "B4:D4")])
    stage = lambda df: spark.createDataFrame(df.collect(), df.schema)
    every = {(r.category, r.location, r.details) for r in X.compare_workbooks(a, b, stage=stage).collect()}
    assert every == {("row added", "row 4", ""), ("content changed", "S!B7 → B8", ""), ("content added", "S!A4", "in an added row"), ("content added", "S!B4:D4", "in an added row"), ("row height changed", "S!row 1", ""), ("merge added", "S!B4:D4", "")}
    flags = {"value", "row_height"}
    got = {(r.category, r.location, r.details) for r in X.compare_workbooks(a, b, flags, stage).collect()}
    assert got == {x for x in every if x[0] in [c for f in flags for c in X.FLAGS[f]]} and len(got) == 2


def test_running_totals_and_overlaps_over_many_ranges(spark, monkeypatch):
    """Many ranges and blocks, a hot key, null keys and null order values: the same as one window per key."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v double").repartition(5)
    got = {r.id: r.total for r in S.running_total(df, ["k"], ["at", "id"], F.col("id"), "total", 40).collect()}
    want, sums = {}, {}
    for k, at, i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        sums[k] = sums.get(k, 0) + i
        want[i] = sums[k]
    assert got == want
    texts = df.select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t"))
    assert [r.n for r in S.running_total(texts, [], ["t"], F.lit(1), "n", 50).orderBy("t").collect()] == list(range(1, 901))
    monkeypatch.setattr(S, "BLOCK", 32)
    monkeypatch.setattr(S, "RANGE_ROWS", 70)
    got = {r.id: r.robust for r in M.rolling(df, ["k"], ["id"], "v", 20, M.mean_of).collect()}
    last = {}
    for k, _, i, v in rows:
        last.setdefault(k, []).append(v)
        assert abs(got[i] - sum(last[k][-20:]) / len(last[k][-20:])) < 1e-9
    summary = {r.k: (r.p95, r.median, r.low, r.high) for r in M.summary(df, ["k"], "v").collect()}
    for k, vs in last.items():
        vs = sorted(vs)
        n = len(vs)
        want_k = (vs[min(n - 1, int(n * 0.95))], (vs[(n - 1) // 2] + vs[n // 2]) / 2, vs[0], vs[-1])
        assert all(abs(a - b) < 1e-12 for a, b in zip(summary[k], want_k, strict=True))
