import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import sequences as S
from tabloom.plans.trail import Trail
from tabloom.streaming import ordered as O


def arrivals(spark, folder, rows, schema, batches):
    """Rows as files of a streaming table, one file for each batch."""
    for i in range(batches):
        spark.createDataFrame(rows[i::batches], schema).coalesce(1).write.mode("append").parquet(folder)


def test_shuffled_results_are_given_out_in_order_and_once(spark, tmp_path):
    rng = random.Random(4)
    missing = {(3, 7), (5, 1)}
    rows = [(k, n, f"{k}-{n}") for k in range(6) for n in range(1, 40) if (k, n) not in missing]
    rows += rng.sample(rows, 60)  # some arrive again
    rng.shuffle(rows)
    schema = "key int, n bigint, what string"
    arrivals(spark, str(tmp_path / "in"), rows, schema, 4)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = O.committed(spark, stream(), ["key"], "n", str(tmp_path / "out"))
    whole = spark.createDataFrame(rows, schema).distinct()
    want = sorted(tuple(r) for r in S.contiguous(whole, ["key"], "n").collect())
    assert sorted(tuple(r) for r in out.collect()) == want
    # After a restart what was missing lets the rest go out, and what came before doesn't come again.
    arrivals(spark, str(tmp_path / "in"), [(3, 7, "3-7"), (1, 2, "again")], schema, 1)
    out = O.committed(spark, stream(), ["key"], "n", str(tmp_path / "out"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == len(want) + 33 and {r for r in got if r[0] == 3} == {(3, n, f"3-{n}") for n in range(1, 40)}


def test_rows_leave_in_ascending_order(spark, tmp_path):
    rows = [(1, n, 10 * n) for n in (5, 4, 3, 2, 1, 6, 7)]
    arrivals(spark, str(tmp_path / "in"), rows, "key int, n bigint, x bigint", 1)
    seen = []
    stream = O.in_order(spark.readStream.schema("key int, n bigint, x bigint").parquet(str(tmp_path / "in")), ["key"], "n")
    stream.writeStream.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [(1, n, 10 * n) for n in range(1, 8)]


def test_a_result_without_a_sequence_ends_the_stream(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"), [(1, None, "x")], "key int, n bigint, what string", 1)
    with pytest.raises(Exception, match="has no n"):
        O.committed(spark, spark.readStream.schema("key int, n bigint, what string").parquet(str(tmp_path / "in")), ["key"], "n", str(tmp_path / "out"))


def test_commits_follow_the_order_and_survive_a_restart(spark, tmp_path):
    trail = Trail(spark, f"file://{tmp_path}/trail")
    trail.initialise()
    result = lambda w, n: (w, n, str(10 * n), str(10 * n + 10), f"{n:064x}"[:63] + "f", n % 2)
    staged = [(w, str(10 * n), str(10 * n + 10), "s", f"A{n}", "ADD", None, "x") for w in (1, 2) for n in range(1, 9) if n % 2]
    changes = spark.createDataFrame(staged, "workbook_id bigint, previous_id string, current_id string, sheet string, address string, change_type string, previous_value string, new_value string")
    run = lambda: O.start_commits(spark.readStream.schema(O.RESULTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), changes, trail, str(tmp_path / "at")).awaitTermination(180)
    at = lambda: sorted((r.workbook_id, r.version_id) for r in trail.read("checkpoint").collect())
    arrivals(spark, str(tmp_path / "in"), [result(1, n) for n in (3, 1, 5)] + [result(2, n) for n in (2, 4)], O.RESULTS, 2)
    run()
    assert at() == [(1, "20")] and trail.read("pair").count() == 1 and trail.changes().count() == 1
    arrivals(spark, str(tmp_path / "in"), [result(1, n) for n in (2, 4, 3)] + [result(2, n) for n in (3, 1)], O.RESULTS, 1)
    run()
    assert at() == [(1, "60"), (2, "50")]
    pairs = trail.read("pair").groupBy("workbook_id").agg(F.count("*").alias("n"), F.count_distinct("current_id").alias("d"), F.sum("changes").alias("c")).orderBy("workbook_id").collect()
    assert [tuple(r) for r in pairs] == [(1, 5, 5, 3), (2, 4, 4, 2)] and trail.changes().count() == 5
