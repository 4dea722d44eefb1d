"""Queries of the core operators over the test tables, with their SQL for DuckDB.

A table stands for a sheet: its key is the row, the order of its columns the letter. A second version of it comes from a
fixed edit (rows left out, values changed, fields emptied).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import text as T
from .operators import alignment as A
from .operators import diff as D
from .operators import sequences as S
from .operators import timing as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- two versions of orders as sheets --------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def order_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders after the edit. Prices are cents, as whole numbers are written alike everywhere."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice").cast("double") * 100).cast("bigint").alias("o_totalprice"), "o_orderpriority")
    k = F.col("o_orderkey")
    edited = base.filter(k % 97 != 0).withColumns({"o_totalprice": F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 17 != 0, F.col("o_orderpriority"))})
    added = base.filter(k % 101 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    return base, edited.unionByName(added)


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as cells."""
    return tuple(C.to_cells(t, "orders", ["o_orderkey"], ORDER_COLUMNS) for t in order_tables(spark, sf_dir))


_ORDERS = """
WITH b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT) AS p, o_orderpriority AS q FROM orders),
e AS (SELECT k, c, s, CASE WHEN k % 13 = 0 THEN p + 1 ELSE p END AS p, CASE WHEN k % 17 <> 0 THEN q END AS q FROM b WHERE k % 97 <> 0
  UNION ALL SELECT k + 1000000000, c, s, p, q FROM b WHERE k % 101 = 0),
cb AS (SELECT k, 1 AS col, CAST(c AS VARCHAR) AS t FROM b UNION ALL SELECT k, 2, s FROM b UNION ALL SELECT k, 3, CAST(p AS VARCHAR) FROM b UNION ALL SELECT k, 4, q FROM b),
ce AS (SELECT k, 1 AS col, CAST(c AS VARCHAR) AS t FROM e UNION ALL SELECT k, 2, s FROM e UNION ALL SELECT k, 3, CAST(p AS VARCHAR) FROM e UNION ALL SELECT k, 4, q FROM e),
d AS (SELECT coalesce(x.k, y.k) AS k, coalesce(x.col, y.col) AS col, x.t AS old, y.t AS new,
  CASE WHEN x.t IS NULL THEN 'ADD' WHEN y.t IS NULL THEN 'DEL' WHEN x.t <> y.t THEN 'MOD' END AS kind
  FROM (SELECT * FROM cb WHERE t IS NOT NULL) x FULL OUTER JOIN (SELECT * FROM ce WHERE t IS NOT NULL) y ON x.k = y.k AND x.col = y.col)
"""
_DIFF = _ORDERS + "SELECT 'orders' AS sheet, chr(CAST(64 + col AS INTEGER)) || k AS address, kind AS change_type, old AS previous_value, new AS new_value FROM d WHERE kind IS NOT NULL"


def _addressed(changes: DataFrame) -> DataFrame:
    return changes.select("sheet", C.address(F.col("row"), F.col("column")).alias("address"), "change_type", "previous_value", "new_value")


@query(_DIFF)
def snapshot_diff(spark, sf_dir):
    """The difference of two snapshots, cell by cell."""
    return _addressed(D.snapshot_diff(*order_versions(spark, sf_dir)))


@query(_DIFF)
def ordered_diff(spark, sf_dir):
    """The same in the order of changes (sheet by code point, row, column), from a join per row."""
    changes = D.table_diff(*order_tables(spark, sf_dir), "orders", "o_orderkey", ORDER_COLUMNS)
    return _addressed(changes.orderBy("sheet", "row", "column"))


@query(_DIFF)
def hash_skip_diff(spark, sf_dir):
    """The same, of those rows alone whose digests differ."""
    return _addressed(D.hash_skip_diff(*order_versions(spark, sf_dir)))


@query(_ORDERS + "SELECT count(*) AS total, count(*) FILTER (kind = 'ADD') AS add, count(*) FILTER (kind = 'MOD') AS mod, count(*) FILTER (kind = 'DEL') AS del FROM d WHERE kind IS NOT NULL")
def diff_summary(spark, sf_dir):
    """Counts per kind of change."""
    return D.summary(D.snapshot_diff(*order_versions(spark, sf_dir)))


@query(_ORDERS + """, r AS (SELECT k, string_agg(CAST(col AS VARCHAR) || t, '|' ORDER BY col) AS h FROM cb WHERE t IS NOT NULL GROUP BY k), s AS (SELECT k, string_agg(CAST(col AS VARCHAR) || t, '|' ORDER BY col) AS h FROM ce WHERE t IS NOT NULL GROUP BY k)
SELECT count(*) FILTER (r.h = s.h) AS reused, count(*) FILTER (r.h <> s.h) AS parsed, count(*) FILTER (r.k IS NULL) AS added, count(*) FILTER (s.k IS NULL) AS removed FROM r FULL OUTER JOIN s ON r.k = s.k""")
def reuse_metrics(spark, sf_dir):
    """Rows reused by digest, parsed, added and removed."""
    a, b = (D.row_digests(x) for x in order_versions(spark, sf_dir))
    j = a.withColumnRenamed("digest", "x").join(b.withColumnRenamed("digest", "y"), ["sheet", "row"], "full_outer")
    return j.agg(F.count_if(F.col("x") == F.col("y")).alias("reused"), F.count_if(F.col("x") != F.col("y")).alias("parsed"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"))


# -- conversations and events as version chains -----------------------------------------------------------------------


@query("SELECT conv_id, CAST(turn AS BIGINT) AS previous, CAST(next AS BIGINT) AS current FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE next IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    """Pairs of neighbouring versions."""
    v = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn")).distinct()
    return S.consecutive_pairs(v, ["conv_id"], "turn")


@query("""WITH f AS (SELECT conv_id, turn, 'role' AS field, max(role) AS v FROM conversations GROUP BY ALL UNION ALL SELECT conv_id, turn, 'text', max(text) FROM conversations WHERE length(text) % 5 <> 0 GROUP BY ALL),
r AS (SELECT conv_id, min(turn) AS a, max(turn) AS z FROM f GROUP BY 1), t AS (SELECT DISTINCT r.conv_id, f.field, generate_series AS turn FROM r, generate_series(a + 1, z), (SELECT DISTINCT field FROM f) f),
p AS (SELECT t.conv_id, t.turn, t.field, x.v AS old, y.v AS new FROM t LEFT JOIN f x ON x.conv_id = t.conv_id AND x.field = t.field AND x.turn = t.turn - 1 LEFT JOIN f y ON y.conv_id = t.conv_id AND y.field = t.field AND y.turn = t.turn)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, field, CASE WHEN old IS NULL THEN 'ADD' WHEN new IS NULL THEN 'DEL' ELSE 'MOD' END AS change_type, old AS previous_value, new AS new_value FROM p WHERE old IS DISTINCT FROM new""")
def chain_diff(spark, sf_dir):
    """Changes between all consecutive versions of many chains, in one pass."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("turn").cast("bigint").alias("turn")).agg(F.max("role").alias("role"), F.max("text").alias("text"))
    fields = F.filter(F.array(F.struct(F.lit("role").alias("field"), F.col("role").alias("v")), F.struct(F.lit("text").alias("field"), F.when(F.length("text") % 5 != 0, F.col("text")).alias("v"))), lambda x: x["v"].isNotNull())
    return D.chain_diff(c.select("conv_id", "turn", F.explode(fields).alias("x")).select("conv_id", "turn", "x.*"), ["conv_id"], "turn", "field", "v")


def user_pairs(spark, sf_dir):
    """Events of a user in their order as pairs; purchases and views are done."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return e.select("user_id", pos.alias("pos"), F.col("event_type").isin("purchase", "view").alias("covered"))


_PAIRS = "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type IN ('purchase', 'view') AS covered FROM events) "


@query(_PAIRS + ", t AS (SELECT *, CASE WHEN covered IS DISTINCT FROM lag(covered) OVER (PARTITION BY user_id ORDER BY pos) THEN 1 ELSE 0 END AS turn FROM p), r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM t) SELECT user_id, CAST(run AS BIGINT) AS run, covered, min(pos) AS first, max(pos) AS last, count(*) AS pairs FROM r GROUP BY user_id, run, covered")
def coverage_islands(spark, sf_dir):
    """Runs of covered and of missing pairs."""
    return S.islands(user_pairs(spark, sf_dir), ["user_id"], "pos", "covered")


@query(_PAIRS + ", w AS (SELECT *, min(CAST(covered AS INTEGER)) OVER (PARTITION BY user_id ORDER BY pos) AS whole FROM p) SELECT user_id, CAST(sum(whole) AS BIGINT) AS prefix, max(pos) FILTER (whole = 1) AS checkpoint FROM w GROUP BY user_id")
def covered_prefix(spark, sf_dir):
    """The checkpoint of a contiguous prefix."""
    return S.covered_prefix(user_pairs(spark, sf_dir), ["user_id"], "pos", "covered")


@query(_PAIRS + ", g AS (SELECT *, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM p) SELECT user_id, CAST(gap AS BIGINT) AS gap, min(pos) AS open, max(pos) AS target FROM g WHERE gap > 0 GROUP BY user_id, gap")
def checkpoint_targets(spark, sf_dir):
    """Where the checkpoint goes once a gap is closed."""
    return S.checkpoint_targets(user_pairs(spark, sf_dir), ["user_id"], "pos", "covered")


@query(_PAIRS + "SELECT user_id, count(*) AS requested, count(*) FILTER (covered) AS covered, count(*) FILTER (NOT covered) AS missing, 100.0::DOUBLE * count(*) FILTER (covered) / count(*) AS percent FROM p GROUP BY user_id")
def coverage_counts(spark, sf_dir):
    """Coverage counts and percent."""
    return S.coverage_counts(user_pairs(spark, sf_dir), ["user_id"])


@query("SELECT r.o_orderkey, r.o_custkey, d.l_orderkey IS NOT NULL AS covered FROM orders r LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) d ON r.o_orderkey = d.l_orderkey")
def coverage_join(spark, sf_dir):
    """Requested pairs against those that are done."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.coverage(o, done, ["o_orderkey"])


@query(_PAIRS + ", q AS (SELECT user_id, pos FROM p WHERE pos < 4 OR covered), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM q) SELECT user_id, pos FROM n WHERE place = pos")
def ordered_commit(spark, sf_dir):
    """Staged results without a gap before them."""
    p = user_pairs(spark, sf_dir)
    return S.contiguous(p.filter("pos < 4 or covered").select("user_id", "pos"), ["user_id"], "pos")


@query(_PAIRS + "SELECT user_id, max(pos) AS committed FROM (SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM p WHERE pos < 4 OR covered) WHERE place = pos GROUP BY 1")
def ordered_commit_stream(spark, sf_dir):
    """The same by a stream's state: results come as files, in the order of a hash, several to a micro-batch."""
    from .plans.shared import new_folder
    from .streaming.ordered import committed

    folder = new_folder(spark, "results")
    p = user_pairs(spark, sf_dir).filter("pos < 4 or covered").select("user_id", F.col("pos").alias("sequence"), F.col("covered").cast("int").alias("changes"))
    p.repartition(16, F.xxhash64("user_id", "sequence")).write.parquet(f"{folder}/in")
    results = spark.readStream.schema("user_id bigint, sequence bigint, changes int").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    return committed(spark, results, ["user_id"], "sequence", folder).groupBy("user_id").agg(F.max("sequence").alias("committed"))


@query("WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey > lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders) SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey) AS distinct_values, coalesce(bool_and(up), true) AS ascending FROM x GROUP BY 1")
def monotonic_ids(spark, sf_dir):
    """Ids that ascend strictly in the order of their dates."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return S.monotonic(o, ["o_custkey"], "at", "o_orderkey")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders) SELECT (seq - 1) // 900 + 1 AS sheet_no, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM n GROUP BY 1")
def report_sheets(spark, sf_dir):
    """An ordered export in sheets of fixed size."""
    o = S.sheets(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 900)
    return o.groupBy("sheet_no").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_run(spark, sf_dir):
    """The latest row of each key."""
    return S.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS x, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal FROM lineitem")
def row_ordinal(spark, sf_dir):
    """How often a row number came before."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("x"))
    return S.occurrence(li, ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", "q", "x")


_SEQ = "WITH e AS (SELECT user_id, event_id, event_id % 37 AS v FROM events) "


@query(_SEQ + ", m AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e) SELECT user_id, event_id, v, greatest(v, coalesce(b, v)) AS shown, CASE WHEN b IS NULL OR v > b THEN 'new' WHEN v = b THEN 'current' ELSE 'stale' END AS state FROM m")
def high_water(spark, sf_dir):
    """The greatest value so far; new, current and stale rows."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 37).alias("v"))
    return S.high_water(e, ["user_id"], "event_id", "v")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carried_master(spark, sf_dir):
    """A shared master carried on to what follows it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("master"))
    return S.carried(e, ["user_id"], "event_id", "master").drop("master")


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS paused FROM events")
def active_clock(spark, sf_dir):
    """Pauses so far, which active time leaves out."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", 3).otherwise(0).alias("p"))
    return S.active_clock(e, ["user_id"], "event_id", "p").drop("p")


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id, event_type FROM events), x AS (SELECT user_id, event_type, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - s AS span FROM e) SELECT user_id, CAST(coalesce(sum(span) FILTER (event_type = 'view'), 0) AS BIGINT) AS held FROM x GROUP BY 1")
def state_time(spark, sf_dir):
    """Time in which a state holds."""
    e = seconds(spark, sf_dir).select("user_id", F.struct("s", "event_id").alias("at"), "s", (F.col("event_type") == "view").alias("holds"))
    return S.state_time(e, ["user_id"], "at", "s", "holds")


def seconds(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("value").cast("double").alias("value"), F.floor(F.unix_micros(ts) / 1000000).alias("s"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events) SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM e")
def trailing_count(spark, sf_dir):
    """Rows in a trailing span of time."""
    return M.trailing_count(seconds(spark, sf_dir), ["user_id"], "s", 86400).select("user_id", "event_id", "recent")


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events), w AS (SELECT *, first_value(s) OVER x AS f, count(*) OVER x AS n FROM e WINDOW x AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, round(CASE WHEN s > f THEN (n - 1) * 60.0::DOUBLE / (s - f) END, 9) AS rate FROM w")
def commit_rate(spark, sf_dir):
    """Commits a minute over the latest twenty."""
    return M.throughput(seconds(spark, sf_dir), ["user_id"], ["s", "event_id"], "s").select("user_id", "event_id", F.round("rate", 9).alias("rate"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events), w AS (SELECT *, first_value(s) OVER x AS f, count(*) OVER x AS n FROM e WINDOW x AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT user_id, s, event_id, CASE WHEN s > f THEN (n - 1) * 60.0::DOUBLE / (s - f) END AS rate FROM w), g AS (SELECT user_id, count(*) AS commits, list(rate ORDER BY s, event_id) FILTER (rate IS NOT NULL) AS l FROM r GROUP BY 1)
SELECT user_id, commits, round(CASE WHEN l IS NOT NULL THEN list_reduce(l, lambda a, x: 0.25::DOUBLE * x + 0.75::DOUBLE * a) END, 9) AS smoothed FROM g""")
def smoothed_rate(spark, sf_dir):
    """The exponentially weighted rate."""
    r = M.throughput(seconds(spark, sf_dir), ["user_id"], ["s", "event_id"], "s")
    return M.smoothed_rates(r, ["user_id"], ["s", "event_id"]).withColumn("smoothed", F.round("smoothed", 9))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events),
w AS (SELECT *, first_value(s) OVER x AS f, count(*) OVER x AS n, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS pos FROM e WINDOW x AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT user_id, pos, CASE WHEN s > f THEN (n - 1) * 60.0::DOUBLE / (s - f) END AS rate, CAST(event_id % 9 AS DOUBLE) AS rest FROM w),
x AS (SELECT user_id, pos, rate AS rate, CASE WHEN rest <= 0 THEN 0.0::DOUBLE END AS eta FROM r WHERE pos = 1 UNION ALL
SELECT user_id, pos, rate, CASE WHEN rest <= 0 THEN 0.0::DOUBLE WHEN pos >= 5 AND rate > 0 THEN CASE WHEN eta IS NULL THEN rest * 60.0::DOUBLE / rate ELSE 0.2::DOUBLE * (rest * 60.0::DOUBLE / rate) + 0.8::DOUBLE * eta END ELSE eta END FROM (
SELECT r.user_id, r.pos, r.rest, x.eta, CASE WHEN r.rate IS NULL THEN x.rate WHEN x.rate IS NULL THEN r.rate ELSE 0.25::DOUBLE * r.rate + 0.75::DOUBLE * x.rate END AS rate FROM x JOIN r ON r.user_id = x.user_id AND r.pos = x.pos + 1))
SELECT user_id, round(eta, 6) AS eta FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) = 1""")
def smoothed_eta(spark, sf_dir):
    """The time left as it is shown: smoothed, from five commits on, and the last valid one kept."""
    r = M.throughput(seconds(spark, sf_dir).withColumn("rest", F.col("event_id") % 9), ["user_id"], ["s", "event_id"], "s")
    return M.smoothed_etas(r, ["user_id"], ["s", "event_id"], "rest").withColumn("eta", F.round("eta", 6))


_WINS = """WITH e AS (SELECT event_id, event_type, CAST(value AS DOUBLE) AS v FROM events WHERE value >= 0 AND NOT isnan(CAST(value AS DOUBLE))),
w AS (SELECT event_id, event_type, list(v) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS l FROM e),
m AS (SELECT *, list_median(l) AS med FROM w), d AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - med))) AS mad FROM m)
SELECT event_type, event_id, round({value}, 9) AS robust FROM d"""


@query(_WINS.format(back=19, value="CASE WHEN len(l) < 3 THEN list_avg(l) WHEN mad = 0 THEN list_avg(list_transform(l, lambda x: least(x, greatest(med * 3.0, med + 1.0)))) ELSE list_avg(list_transform(l, lambda x: least(greatest(x, med - 3.0::DOUBLE * 1.4826::DOUBLE * mad), med + 3.0::DOUBLE * 1.4826::DOUBLE * mad))) END"))
def stage_mean(spark, sf_dir):
    """The robust mean of a stage's latest twenty durations."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").cast("double").alias("v"))
    return M.rolling(e, ["event_type"], ["event_id"], "v").select("event_type", "event_id", F.round("robust", 9).alias("robust"))


@query(_WINS.format(back=14, value="CASE WHEN len(l) < 3 THEN list_avg(l) ELSE list_avg(list_transform(l, lambda x: least(greatest(x, med - greatest(1.0, 3.0::DOUBLE * 1.4826::DOUBLE * mad)), med + greatest(1.0, 3.0::DOUBLE * 1.4826::DOUBLE * mad)))) END"))
def slot_mean(spark, sf_dir):
    """The robust mean of a slot's latest fifteen durations."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").cast("double").alias("v"))
    return M.rolling(e, ["event_type"], ["event_id"], "v", M.SLOT_WINDOW, M.slot_mean).select("event_type", "event_id", F.round("robust", 9).alias("robust"))


@query("SELECT event_type, event_id, round(list_median(list(CAST(value AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 9) AS median FROM events WHERE value >= 0")
def milestone_median(spark, sf_dir):
    """The median of the latest twenty."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").cast("double").alias("v"))
    return M.rolling(e, ["event_type"], ["event_id"], "v", 20, M.median_of).select("event_type", "event_id", F.round("robust", 9).alias("median"))


@query("SELECT event_type, event_id, round(avg(CAST(value AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 7) AS mean FROM events WHERE value >= 0")
def queue_mean(spark, sf_dir):
    """The mean of the latest twenty waits."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").cast("double").alias("v"))
    return M.rolling(e, ["event_type"], ["event_id"], "v", 20, M.mean_of).select("event_type", "event_id", F.round("robust", 7).alias("mean"))


@query("WITH g AS (SELECT event_type, list_sort(list(CAST(value AS DOUBLE))) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, l[least(len(l) - 1, CAST(floor(len(l) * 0.95::DOUBLE) AS BIGINT)) + 1] AS p95, list_median(l) AS median, round(list_avg(l), 7) AS mean, list_min(l) AS low, list_max(l) AS high FROM g")
def sample_summary(spark, sf_dir):
    """Nearest-rank percentile, median, mean, extremes."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("double").alias("v"))
    return M.summary(e, ["event_type"], "v").withColumn("mean", F.round("mean", 7))


@query("""WITH s AS (SELECT event_type AS workbook, user_id % 8 + 1 AS slots, CAST(event_id % 50 + 1 AS DOUBLE) AS rate, event_id % 5 AS prefetch, CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS b, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS c FROM events WHERE event_id % 11 <> 0),
r AS (SELECT workbook, slots, sum(rate * b * c) / sum(b * c) AS rate, count(*) AS samples, CAST(round(sum(prefetch * b) / sum(b)) AS BIGINT) AS prefetch FROM s GROUP BY 1, 2),
p AS (SELECT *, max(rate) OVER (PARTITION BY workbook) AS peak FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY slots) AS n FROM p WHERE rate >= peak * 0.95)
SELECT workbook, CAST(slots AS BIGINT) AS slots, round(rate, 9) AS rate, samples, prefetch, CASE WHEN samples >= 4 THEN 'HIGH' WHEN samples >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM q WHERE n = 1""")
def recommended_slots(spark, sf_dir):
    """The fewest slots within 5 % of the best weighted rate."""
    i = F.col("event_id")
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("workbook"), (F.col("user_id") % 8 + 1).cast("bigint").alias("slots"), (i % 50 + 1).cast("double").alias("rate"), (i % 5).alias("prefetch"), F.when(i % 3 == 0, "benchmark_run").otherwise("normal_run").alias("kind"), (i % 7 != 0).alias("completed"), (i % 11 != 0).alias("comparable"))
    return M.recommend(s, ["workbook"]).withColumn("rate", F.round("rate", 9))


@query("SELECT event_id, round(least(CASE WHEN r <= 1 THEN 0.9::DOUBLE * r ELSE 0.9::DOUBLE + 0.1::DOUBLE * (1 - exp(-(r - 1))) END, 0.999::DOUBLE), 9) AS fraction FROM (SELECT event_id, CAST(event_id % 400 AS DOUBLE) / 100 AS r FROM events)")
def progress_curve(spark, sf_dir):
    """progress within a stage."""
    r = (F.col("event_id") % 400).cast("double") / 100
    return table(spark, sf_dir, "events").select("event_id", F.round(M.stage_fraction(r), 9).alias("fraction"))


# -- reports, stored audits, restore --------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, count(*) AS pairs, CAST(max(o_orderdate) AS VARCHAR) AS last FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS changes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(pairs, 0) AS pairs, coalesce(changes, 0) AS changes, last FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def stored_audits(spark, sf_dir):
    """Workbooks with counts that were summed before the join; none is left out."""
    orders = table(spark, sf_dir, "orders")
    o = orders.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.max("o_orderdate").cast("string").alias("last"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    changes = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("changes"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = c.join(o, F.col("c_custkey") == o["o_custkey"], "left").drop("o_custkey").join(changes, F.col("c_custkey") == changes["o_custkey"], "left")
    return j.select("c_custkey", "c_name", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("changes", F.lit(0)).alias("changes"), "last").orderBy(T.nocase(F.col("c_name")), "c_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def category_histogram(spark, sf_dir):
    """Categories by falling count, then name."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("SELECT count(DISTINCT o.o_orderkey) AS pairs, count(*) AS changes, count(*) FILTER (l.l_returnflag = 'A') AS add, count(*) FILTER (l.l_returnflag = 'N') AS mod, count(*) FILTER (l.l_returnflag = 'R') AS del, min(o.o_orderkey) AS first, max(o.o_orderkey) AS last FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def report_stats(spark, sf_dir):
    """Conditional sums over changes joined with their pairs."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = lambda v: F.count_if(F.col("l_returnflag") == v)
    return j.agg(F.count_distinct("o_orderkey").alias("pairs"), F.count("*").alias("changes"), flag("A").alias("add"), flag("N").alias("mod"), flag("R").alias("del"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("WITH m AS (SELECT o_orderkey, 5000000 + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders) SELECT m.new_id AS pair_id, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN m ON l_orderkey = o_orderkey")
def restore_remap(spark, sf_dir):
    """Rows of a backup under new surrogate keys."""
    from .plans.trail import remap

    ids = remap(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5_000_000)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(ids, F.col("l_orderkey") == F.col("old_id")).select(F.col("new_id").alias("pair_id"), "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT count(*) AS orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def orphan_check(spark, sf_dir):
    """M3, M4: children without a parent."""
    from .plans.trail import orphans

    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", o, "o_orderkey").agg(F.count("*").alias("orphans"))


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """Groups that a unique key would reject."""
    from .plans.trail import duplicates

    return duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


# -- version catalog -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 4000 THEN 'delta' ELSE 'local' END AS origin FROM orders WHERE o_orderkey < 4000 OR o_orderkey % 2 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 4000)")
def catalog_delta(spark, sf_dir):
    """A cached prefix without its last version, and the delta from there on."""
    from .plans.catalog import merge_delta

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    anchor = o.filter("id <= 4000").agg(F.max("id").alias("anchor"))
    remote = o.join(F.broadcast(anchor), (F.col("id") == F.col("anchor")) | ((F.col("id") >= 4000) & (F.col("id") % 2 == 0))).select("id")
    merged = merge_delta(o.filter("id <= 4000"), remote, "id")
    return merged.select("id", F.when(F.col("id") >= 4000, "delta").otherwise("local").alias("origin"))


@query("WITH h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT max(o_orderkey) AS id FROM orders) SELECT id FROM h WHERE id <> (SELECT id FROM c) UNION ALL SELECT id FROM c")
def reconcile_current(spark, sf_dir):
    """The current version put into the history, in the place of an equal one."""
    from .plans.catalog import reconcile

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return reconcile(o.filter("id % 5 <> 0"), o.agg(F.max("id").alias("id")), "id")


@query("WITH v AS (SELECT o_custkey, o_orderkey AS id, 'v' || o_orderkey AS label FROM orders WHERE o_orderkey % 4 <> 0), l AS (SELECT o_custkey, min(label) AS least FROM v GROUP BY 1), t AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders GROUP BY 1), cur AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 3 THEN top - 9 ELSE top END AS id, CASE WHEN o_custkey % 5 = 1 THEN 'other' WHEN o_custkey % 5 = 2 THEN least ELSE 'v' || (CASE WHEN o_custkey % 5 = 3 THEN top - 9 ELSE top END) END AS label FROM t LEFT JOIN l USING (o_custkey)), per AS (SELECT v.o_custkey, bool_or(v.id = cur.id AND v.label <> cur.label) AS a, bool_or(v.id <> cur.id AND v.label = cur.label) AS b, bool_or(v.id > cur.id) AS c FROM v JOIN cur ON v.o_custkey = cur.o_custkey GROUP BY 1) SELECT o_custkey, CASE WHEN a THEN 'the id has another label' WHEN b THEN 'the label has another id' ELSE 'the history goes beyond it' END AS problem FROM per WHERE a OR b OR c")
def current_conflicts(spark, sf_dir):
    """Current versions that contradict their history by id, label or order."""
    from .plans.catalog import conflicts

    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("label"))
    history, kind = o.filter("id % 4 <> 0"), F.col("o_custkey") % 5
    top = o.groupBy("o_custkey").agg(F.max("id").alias("top")).join(history.groupBy("o_custkey").agg(F.min("label").alias("least")), "o_custkey", "left")
    number = F.when(kind == 3, F.col("top") - 9).otherwise(F.col("top"))
    current = top.select("o_custkey", number.alias("id"), F.when(kind == 1, "other").when(kind == 2, F.col("least")).otherwise(F.concat(F.lit("v"), number)).alias("label"))
    return conflicts(history, current, ["o_custkey"], "id", "label")


@query("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders), per AS (SELECT o_custkey AS c, count(*) AS n FROM e GROUP BY 1), k AS (SELECT c, n, (n - 1) // 5 + 1 AS pages FROM per)
SELECT CAST(c AS VARCHAR) AS listing, CASE WHEN c % 7 = 1 AND pages > 1 THEN pages - 1 ELSE pages END AS pages, CASE WHEN c % 7 = 1 AND pages > 1 THEN n - least(5, n - 5) ELSE n END AS versions,
CASE WHEN c % 7 = 1 AND pages > 1 THEN 'a page is missing' WHEN c % 7 = 2 AND n > 1 THEN 'an id comes twice' WHEN c % 7 = 3 THEN 'the listing changed while it was read' WHEN c % 7 = 4 THEN 'there is no watermark' END AS problem FROM k""")
def proven_listings(spark, sf_dir):
    """Pages of orders by customer, some with a fault, and which listings they prove to be whole."""
    from pyspark.sql import Window

    from .sources.paged import proof

    c, n, w = F.col("o_custkey"), F.col("n"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("n"), F.lag("o_orderkey").over(w).alias("earlier"))
    # Of customers with a remainder of 2 the second entry has the first one's id.
    e = e.withColumn("id", F.when((c % 7 == 2) & (n == 1), F.col("earlier")).otherwise(F.col("o_orderkey")))
    entry = F.struct("n", F.struct(F.col("id").alias("ID"), F.concat(F.lit("v"), F.col("id")).alias("VersionLabel")).alias("x"))
    pages = e.groupBy("o_custkey", F.floor(n / 5).alias("p")).agg(F.array_sort(F.collect_list(entry)).alias("all")).join(e.groupBy("o_custkey").agg((F.floor(F.max("n") / 5)).alias("last")), "o_custkey")
    address = lambda p: F.concat(F.lit("page?"), p.cast("string"))
    items, on = F.transform("all", lambda x: x["x"]), F.when(F.col("p") < F.col("last"), address(F.col("p") + 1))
    shapes = [F.struct(items.alias("value"), on.alias("@odata.nextLink")), F.struct(items.alias("value"), on.alias("odata.nextLink")), F.struct(F.struct(items.alias("results"), on.alias("__next")).alias("d")), F.struct(items.alias("d"), on.alias("__next"))]
    body = F.coalesce(*[F.when(c % 4 == i, F.to_json(shape)) for i, shape in enumerate(shapes)])
    kept = pages.filter(~((c % 7 == 1) & (F.col("p") == 1))).select(c.cast("string").alias("listing"), address(F.col("p")).alias("page"), body.alias("body"))
    marks = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 4").select(F.col("c_custkey").cast("string").alias("listing"), F.lit("1").alias("before"), F.when(F.col("c_custkey") % 7 == 3, "2").otherwise("1").alias("after"))
    return proof(kept, marks).drop("descending")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, greatest(1, (b + 999) // 1000) AS blocks, CASE WHEN doc_id % 10 = 3 AND b > 1000 THEN 1000 ELSE b END AS bytes, CASE WHEN NOT (doc_id % 10 = 3 AND b > 1000) AND doc_id % 10 <> 7 THEN sha256(t) END AS digest, CASE WHEN doc_id % 10 = 3 AND b > 1000 THEN 'gap' WHEN doc_id % 10 = 7 THEN 'bytes are missing' END AS problem FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS b FROM documents)")
def carried_blocks(spark, sf_dir):
    """Texts as files in base64 blocks that come in any order, some with a gap or too short; their digests."""
    from .sources.listings import blocks

    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    size = F.octet_length("b")
    at = d.select("doc_id", "b", size.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(1000))).alias("at"))
    fault = F.col("doc_id") % 10
    chunk = F.base64(F.expr("substring(b, at + 1, 1000)"))
    chunks = at.select(F.col("doc_id").cast("string").alias("file"), (F.col("at") + F.when((fault == 3) & (F.col("at") > 0), 1).otherwise(0)).alias("offset"), chunk.alias("data"), (F.col("n") + F.when(fault == 7, 1).otherwise(0)).alias("size"))
    return blocks(chunks)


@query("SELECT o_custkey, count(*) AS versions, count(DISTINCT o_orderkey) = count(*) AS unique_ids, bool_and(o_orderkey > 0) AS positive, count(*) FILTER (o_orderstatus = 'O') AS current_versions, max(o_orderkey) = max(o_orderkey) FILTER (o_orderstatus = 'O') AS current_is_last FROM orders GROUP BY 1")
def catalog_validation(spark, sf_dir):
    """What a valid catalog must satisfy, per workbook."""
    from .plans.catalog import validation

    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("is_current"))
    return validation(o, ["o_custkey"], "id", "is_current")


@query("SELECT o_orderkey FROM orders WHERE coalesce(TRY_CAST(regexp_extract(o_clerk_like, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) BETWEEN 100 AND 900".replace("o_clerk_like", "CASE WHEN o_orderkey % 3 = 0 THEN 'version-' || o_orderkey ELSE o_orderkey || ' v' END"))
def interval_by_text_id(spark, sf_dir):
    """An interval over ids kept as text."""
    text_id = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("version-"), F.col("o_orderkey"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(" v")))
    return S.slice_interval(table(spark, sf_dir, "orders"), T.sqlite_integer(text_id), 100, 900).select("o_orderkey")


# -- alignment ---------------------------------------------------------------------------------------------------------


def part_anchors(spark, sf_dir):
    """Parts of a brand as anchors; every 25th key shifts what follows by one."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 6 <> 0")
    return p.select("p_brand", F.col("p_partkey").cast("bigint").alias("base_pos"), (F.col("p_partkey") + F.floor(F.col("p_partkey") / 25)).cast("bigint").alias("eval_pos"))


_ANCHORS = "WITH a AS (SELECT p_brand, CAST(p_partkey AS BIGINT) AS b, CAST(p_partkey + p_partkey // 25 AS BIGINT) AS e FROM part WHERE p_partkey % 6 <> 0) "


@query(_ANCHORS + """, n AS (SELECT *, lead(b) OVER w AS nb, lead(e) OVER w AS ne, row_number() OVER w AS nth FROM a WINDOW w AS (PARTITION BY p_brand ORDER BY b)),
g AS (SELECT p_brand, 'added' AS side, unnest(range(e + 1, e + 1 + (ne - e) - (nb - b))) AS position FROM n WHERE nb > b AND ne > e AND ne - e > nb - b
 UNION SELECT p_brand, 'removed', unnest(range(b + 1, b + 1 + (nb - b) - (ne - e))) FROM n WHERE nb > b AND ne > e AND ne - e < nb - b
 UNION SELECT p_brand, 'added', unnest(range(1, e - b + 1)) FROM n WHERE nth = 1 AND ne - nb = e - b AND e > b
 UNION SELECT p_brand, 'removed', unnest(range(1, b - e + 1)) FROM n WHERE nth = 1 AND ne - nb = e - b AND e < b)
SELECT * FROM g""")
def structural_gaps(spark, sf_dir):
    """Positions that were inserted or removed between anchors."""
    return A.gaps(part_anchors(spark, sf_dir), ["p_brand"])


@query(_ANCHORS + ", c AS (SELECT p_brand, e - b AS shift, count(*) AS n FROM a GROUP BY 1, 2) SELECT p_brand, bool_or(shift <> 0 AND n >= 2) AS shifted FROM c GROUP BY 1")
def real_shift(spark, sf_dir):
    """Does some shift other than 0 occur twice?"""
    return A.real_shift(part_anchors(spark, sf_dir), ["p_brand"])


@query(_ANCHORS + """, q AS (SELECT DISTINCT p_brand, CAST(p_partkey AS BIGINT) AS position FROM part),
l AS (SELECT q.*, a.e - a.b AS d FROM q ASOF LEFT JOIN a ON q.p_brand = a.p_brand AND q.position > a.b), r AS (SELECT q.*, a.e - a.b AS d FROM q ASOF LEFT JOIN a ON q.p_brand = a.p_brand AND q.position < a.b)
SELECT q.p_brand, q.position, coalesce(a.e, q.position + coalesce(CASE WHEN l.d = r.d THEN l.d WHEN r.d IS NULL THEN l.d WHEN l.d IS NULL THEN r.d END, 0)) AS mapped
FROM q LEFT JOIN a ON q.p_brand = a.p_brand AND q.position = a.b LEFT JOIN l ON l.p_brand = q.p_brand AND l.position = q.position LEFT JOIN r ON r.p_brand = q.p_brand AND r.position = q.position""")
def inferred_positions(spark, sf_dir):
    """Positions mapped through their neighbours on both sides."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("bigint").alias("position"))
    return A.infer(p, part_anchors(spark, sf_dir), ["p_brand"])


PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size", "p_container"]


def part_cells(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    columns = [c for c in PART_COLUMNS if c in t.columns]
    return C.to_cells(t, "part", ["p_partkey"], columns)


@query()
def aligned_rows(spark, sf_dir):
    """Rows of two sheets aligned by profile; some rows were inserted."""
    cells = part_cells(spark, sf_dir).withColumn("block", F.floor((F.col("row") - 1) / 100))
    base = A.profiles(cells, ["block", "row"], "column").withColumnRenamed("row", "pos")
    other = base.withColumn("pos", F.col("pos") + F.floor(F.pmod(F.col("pos") - 1, F.lit(100)) / 30))
    return A.aligned(base, other, ["block"])


@query("WITH n AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS n FROM part) SELECT k AS base_pos, k + (n - 1) // 30 AS eval_pos FROM n")
def aligned_axis(spark, sf_dir):
    """The rows of part as one axis, walked in segments; after every thirty rows the other sheet has an empty one."""
    from .operators.segments import aligned_in_segments
    from .plans.shared import stage

    t = table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), F.col("p_partkey").alias("pos"), F.array(F.concat(F.lit("T:"), "p_name"), F.concat(F.lit("N:"), "p_partkey")).alias("profile"))
    n = S.running_total(t.select("pos"), [], ["pos"], F.lit(1).cast("bigint"), "n")
    other = t.join(n, "pos").withColumn("pos", F.col("pos") + F.floor((F.col("n") - 1) / 30)).drop("n")
    return aligned_in_segments(t, other, ["sheet"], lambda df: stage(df, "axis"), 500).drop("sheet")


@query("SELECT 'part' AS sheet, p_brand, list_transform(list_slice(list(x ORDER BY p_partkey), 1, 40), lambda t: 'T:' || t) AS profile FROM (SELECT p_brand, p_partkey, left(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), 80) AS x FROM part) GROUP BY p_brand")
def column_profiles(spark, sf_dir):
    """The first forty tokens along an axis."""
    t = table(spark, sf_dir, "part").select(F.lit("part").alias("sheet"), "p_brand", "p_partkey", F.lit("str").alias("kind"), F.col("p_name").alias("text"))
    return A.profiles(t, ["sheet", "p_brand"], "p_partkey")


@query("""SELECT o.o_orderkey AS row, o.o_custkey % 40 AS col, r.s_suppkey AS range_id FROM orders o JOIN (SELECT s_suppkey, s_suppkey * 40 AS a, s_suppkey * 40 + 100 AS z, s_suppkey % 30 AS x, s_suppkey % 30 + 5 AS y FROM supplier) r ON o.o_orderkey BETWEEN a AND z AND o.o_custkey % 40 BETWEEN x AND y""")
def cells_in_ranges(spark, sf_dir):
    """Cells in merged ranges."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 40).alias("col"), F.lit(1).alias("sheet"))
    ranges = table(spark, sf_dir, "supplier").select(F.lit(1).alias("sheet"), k.alias("range_id"), (k * 40).alias("min_row"), (k * 40 + 100).alias("max_row"), (k % 30).alias("min_col"), (k % 30 + 5).alias("max_col"))
    return A.in_ranges(points, ranges, ["sheet"]).select("row", "col", "range_id")


def _area_frames(spark, sf_dir):
    """Cells of a sheet, a cell a row, and merged ranges of five columns that don't overlap."""
    k = F.col("s_suppkey")
    cells = table(spark, sf_dir, "orders").select(F.lit("S").alias("sheet"), F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 40 + 1).alias("column"), F.col("o_orderstatus").alias("text"))
    ranges = table(spark, sf_dir, "supplier").select(F.lit("S").alias("sheet"), F.concat(F.lit("R"), k).alias("range_id"), (k * 40).alias("min_row"), (k * 40 + 20).alias("max_row"), F.lit(1).cast("bigint").alias("min_col"), F.lit(5).cast("bigint").alias("max_col"))
    return cells, ranges


_AREAS = "WITH c AS (SELECT o_orderkey AS row, o_custkey % 40 + 1 AS col, o_orderstatus AS text FROM orders), r AS (SELECT 'R' || s_suppkey AS id, s_suppkey * 40 AS a, s_suppkey * 40 + 20 AS z, 1 AS x, 5 AS y FROM supplier) "


@query(_AREAS + 'SELECT c.row, c.col AS "column", CASE WHEN r.id IS NOT NULL THEN m.text ELSE c.text END AS text, r.id AS range_id FROM c LEFT JOIN r ON c.row BETWEEN a AND z AND c.col BETWEEN x AND y LEFT JOIN c m ON m.row = r.a AND m.col = r.x')
def merged_values(spark, sf_dir):
    """A cell of a merged range has the value of the range's upper left cell."""
    from .operators import areas

    cells, ranges = _area_frames(spark, sf_dir)
    return areas.effective(areas.relevant(cells), cells, ranges).drop("sheet")


@query(_AREAS + """, m AS (SELECT r.*, c.text FROM r JOIN c ON c.row = r.a AND c.col = r.x), p AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE c.row BETWEEN a AND z AND c.col BETWEEN x AND y))
SELECT 'S!' || CASE WHEN col <= 26 THEN chr(CAST(64 + col AS INTEGER)) ELSE 'A' || chr(CAST(38 + col AS INTEGER)) END || row AS location, text, CASE WHEN row % 50 = 0 THEN 'row' ELSE 'column' END AS area FROM p WHERE row % 50 = 0 OR col IN (3, 7)
UNION ALL SELECT 'S!' || id, text, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.row % 50 = 0 AND c.row BETWEEN a AND z) THEN 'row' ELSE 'column' END FROM m""")
def inserted_content(spark, sf_dir):
    """What lies in inserted rows and columns; a merged range counts once."""
    from .operators import areas

    cells, ranges = _area_frames(spark, sf_dir)
    rows = areas.used(areas.meaningful(cells), "row").filter("row % 50 = 0").select("sheet", F.col("row").alias("position"))
    columns = areas.used(areas.meaningful(cells), "column").filter(F.col("column").isin(3, 7)).select("sheet", F.col("column").alias("position"))
    return areas.area_content(cells, ranges, rows, columns).drop("sheet")


# -- functions and sets --------------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT p_partkey, p_partkey % 18278 + 1 AS n FROM part) SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER)) ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END AS letters, n AS back FROM k")
def column_letters(spark, sf_dir):
    """letters of columns, there and back."""
    n = table(spark, sf_dir, "part").select("p_partkey", C.column_letters((F.col("p_partkey") % 18278 + 1).cast("bigint")).alias("letters"))
    return n.withColumn("back", C.column_number(F.col("letters")))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(concat_ws(chr(31), source, lang, CAST(doc_id AS VARCHAR))), 1, 24) AS token, concat_ws('|', source, lang, CAST(doc_id AS VARCHAR)) AS identity FROM documents")
def identities(spark, sf_dir):
    """Digests, identities and their tokens."""
    parts = [F.col("source"), F.col("lang"), F.col("doc_id").cast("string")]
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), T.identity_token(*parts).alias("token"), T.identity(*parts).alias("identity"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b(password|senha|token|client[_-]?secret|secret|cookie|authorization)(\s*[:=]\s*)(?:bearer\s+)?[^\s,;]+', '\1\2[REDACTED]', 'gi'), '\bbearer\s+[^\s,;]+', 'Bearer [REDACTED]', 'gi')) AS redacted FROM documents")
def redacted_text(spark, sf_dir):
    """Values of sensitive fields masked."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("redacted"))


@query(r"SELECT conv_id, turn, regexp_replace(trim(lower(text)), '\s+', ' ', 'g') AS flat, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM conversations")
def normalised_text(spark, sf_dir):
    """Text with case and white space folded."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.normalised(F.col("text")).alias("flat"), T.nocase(F.col("text")).alias("folded"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def natural_order(spark, sf_dir):
    """Names with numbers, in the order of the numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", T.natural_key(F.concat(F.lit("File "), F.col("p_partkey"))).alias("key"))
    return S.running_total(p, [], ["key", "p_partkey"], F.lit(1).cast("bigint"), "place").select("p_partkey", "place")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'base_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'eval_only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'common', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)""")
def set_operations(spark, sf_dir):
    """Union, differences and intersection of keys."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "base_only": a.subtract(b), "eval_only": b.subtract(a), "common": a.intersect(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH e AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 8 * 10, event_id) AS n FROM events) SELECT event_type, event_id FROM e WHERE n <= 5")
def sample_per_class(spark, sf_dir):
    """The first few of each class in a composed priority."""
    e = table(spark, sf_dir, "events").withColumn("priority", F.col("user_id") % 8 * 10)
    return S.first_per_class(e, ["event_type"], ["priority", "event_id"], 5).select("event_type", "event_id")


@query("SELECT event_id, CASE WHEN s < 3600 THEN '' WHEN s < 36000 THEN '0' || s // 3600 || ':' ELSE s // 3600 || ':' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, event_id * 7 AS s FROM events)")
def clock_text(spark, sf_dir):
    """seconds as a clock."""
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id") * 7).alias("clock"))


_SITE = r"regexp_extract(url, '^(https?://[^/?#@\s]+)(?:[/?#]|$)', 1)"


@query(f"SELECT page_id, nullif(lower({_SITE}), '') AS site, {_SITE} <> '' AND starts_with(lower(url), lower({_SITE}) || '/') AS same, 'https://h.example/x/_api/web/GetFileByServerRelativePath(decodedurl=' || chr(39) || replace(url, chr(39), chr(39) || chr(39)) || chr(39) || ')/Versions(' || page_id || ')/$value' AS version_url FROM pages")
def url_checks(spark, sf_dir):
    """The site of an address, whether an address is of a site, a version's address."""
    p = table(spark, sf_dir, "pages")
    site = T.site_of(F.col("url"))
    return p.select("page_id", site.alias("site"), T.same_site(F.col("url"), site).alias("same"), T.version_url(F.lit("https://h.example/x/"), F.col("url"), F.col("page_id").cast("string")).alias("version_url"))


# -- telemetry, lookups and listings -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN b >= 104857600 THEN least(s, 2) WHEN b >= 20971520 THEN s ELSE 2 * s END AS prefetch, 3 * s AS scheduler_window, least(b, t) > 0 AND greatest(b, t)::DOUBLE / least(b, t) >= 1.75 AS drifted, CASE WHEN t > 0 THEN round(60.0::DOUBLE * s / t, 9) END AS per_minute FROM (SELECT o_orderkey, o_orderkey % 8 + 1 AS s, o_orderkey * 9973 % 150000000 AS b, o_custkey * 7919 % 90000000 AS t FROM orders)")
def slot_plan(spark, sf_dir):
    """Prefetch by size and slots, drift, throughput."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (k % 8 + 1).cast("bigint").alias("s"), (k * 9973 % 150000000).alias("b"), (F.col("o_custkey") * 7919 % 90000000).alias("t"))
    s, b, t = F.col("s"), F.col("b"), F.col("t")
    return o.select("o_orderkey", M.prefetch_target(s, b).alias("prefetch"), M.scheduler_window(s).alias("scheduler_window"), M.drifted(b, t).alias("drifted"), F.when(t > 0, F.round(60.0 * s / t, 9)).alias("per_minute"))


@query("SELECT user_id, count(*) AS states, count(*) FILTER (event_type = 'view') AS ready, round(avg(CAST(value AS DOUBLE)), 7) AS mean_wait, max(CAST(value AS DOUBLE)) AS max_wait, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / greatest(1, count(*)), 9) AS hit_rate FROM events GROUP BY 1")
def pool_metrics(spark, sf_dir):
    """Counts per state, mean and greatest waits, rates."""
    of = lambda v: F.count_if(F.col("event_type") == v)
    wait = F.col("value").cast("double")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("states"), of("view").alias("ready"), F.round(F.avg(wait), 7).alias("mean_wait"), F.max(wait).alias("max_wait"), F.round(of("purchase") / F.greatest(F.lit(1), F.count("*")), 9).alias("hit_rate"))


@query("SELECT event_id, CASE WHEN r <= 0 THEN 0.0::DOUBLE WHEN n >= 3 THEN round(r / (n / 4.0::DOUBLE) * 60.0, 9) ELSE round(r * 18.45::DOUBLE / greatest(1, s), 9) END AS eta FROM (SELECT event_id, event_id % 9 AS r, event_id % 7 AS n, user_id % 3 AS s FROM events)")
def bootstrap_eta(spark, sf_dir):
    """Time left by the rate, or by the mean task before there is one."""
    e = table(spark, sf_dir, "events")
    r, n, s = F.col("event_id") % 9, F.col("event_id") % 7, F.col("user_id") % 3
    return e.select("event_id", F.round(M.eta(r, F.when(n > 0, n / 4.0), n, F.lit(18.45), s), 9).alias("eta"))


@query("SELECT name, depth FROM (SELECT r_name AS name, 0 AS depth FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')")
def folder_tree(spark, sf_dir):
    """All that lies below the roots; an excluded name hides what is below it."""
    from .sources.listings import below

    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = r.select(F.concat(F.lit("r"), "r_regionkey").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    rows = rows.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))
    rows = rows.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("folder_id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("name")))
    return below(spark, rows, rows.filter("parent_id is null").select("folder_id"), ("ASIA",)).select(F.col("path").alias("name"), "depth")


@query("WITH b AS (SELECT p_partkey AS i, md5(p_name) AS sig FROM part), c AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 11 = 0 THEN 'changed' ELSE md5(p_name) END AS sig FROM part WHERE p_partkey % 13 <> 0) SELECT l_orderkey, bool_and(coalesce(b.sig = c.sig, false)) AS reusable, count(*) AS strings FROM lineitem LEFT JOIN b ON l_partkey = b.i LEFT JOIN c ON l_partkey = c.i GROUP BY 1")
def string_dependencies(spark, sf_dir):
    """May a row be reused, given the shared strings that it names?"""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    sig = F.md5(F.col("p_name").cast("binary"))
    before = p.select(k.alias("i"), sig.alias("was"))
    after = p.filter(k % 13 != 0).select(k.alias("i"), F.when(k % 11 == 0, "changed").otherwise(sig).alias("now"))
    strings = before.join(after, "i", "full_outer").select("i", F.coalesce(F.col("was") == F.col("now"), F.lit(False)).alias("same"))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("i")).join(strings, "i", "left")
    return used.groupBy("l_orderkey").agg(F.bool_and(F.coalesce("same", F.lit(False))).alias("reusable"), F.count("*").alias("strings"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 5 <> o_custkey % 5")
def identity_mismatch(spark, sf_dir):
    """Children whose workbook differs from their parent's."""
    from .plans.trail import inconsistent

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("run"), (F.col("l_suppkey") % 5).alias("book"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 5).alias("book"))
    return inconsistent(li, o, "run", "book").drop("run", "book")


@query("SELECT sheet_no, n, n = z - a + 1 AND n <= 900 AS whole, a, z FROM (SELECT (seq - 1) // 900 + 1 AS sheet_no, count(*) AS n, min(seq) AS a, max(seq) AS z FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders) GROUP BY 1)")
def report_validation(spark, sf_dir):
    """A written report read again: counts, and sequences without gaps."""
    o = S.sheets(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 900)
    g = o.groupBy("sheet_no").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z"))
    return g.select("sheet_no", "n", ((F.col("n") == F.col("z") - F.col("a") + 1) & (F.col("n") <= 900)).alias("whole"), "a", "z")


@query("WITH n AS (SELECT p_partkey AS k, p_name AS a, p_size AS z, row_number() OVER (ORDER BY p_partkey) AS seq FROM part), c AS (SELECT (seq - 1) // 500 + 1 AS sheet_no, (seq - 1) % 500 + 2 AS row, k, a, z FROM n) SELECT sheet_no, row, CAST(2 AS BIGINT) AS col, 'MOD' AS change_type, a AS previous_value, a || ' *' AS new_value FROM c WHERE k % 13 = 0 UNION ALL SELECT sheet_no, row, 3, 'DEL', CAST(z AS VARCHAR), NULL FROM c WHERE k % 17 = 0")
def stored_rows_diff(spark, sf_dir):
    """Part as workbooks in two versions, whose rows are kept by content and compared from there."""
    from .plans.shared import new_folder
    from .sources.incremental import RowStore
    from .sources.report import write_report

    folder, k = new_folder(spark, "books"), F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))
    edited = p.withColumns({"p_name": F.when(k % 13 == 0, F.concat("p_name", F.lit(" *"))).otherwise(F.col("p_name")), "p_size": F.when(k % 17 != 0, F.col("p_size"))})
    store, chain = RowStore(spark, f"{folder}/store"), None
    for seq, rows in ((1, p), (2, edited)):
        made = write_report(rows, f"{folder}/v{seq}", "P", "p_partkey", ["p_partkey", "p_name", "p_size"], 500)
        store.add(f"{folder}/v{seq}")
        own = made.select(F.col("sheet_no").alias("workbook"), F.lit(seq).alias("seq"), "file")
        chain = own if chain is None else chain.unionByName(own)
    # The manifest names files; the store has their whole paths.
    versions = store.files().select("path", F.element_at(F.split("path", "/"), -1).alias("file")).join(chain, "file").select("workbook", "seq", "path")
    return store.changes(versions).select(F.col("workbook").alias("sheet_no"), "row", F.col("column").alias("col"), "change_type", "previous_value", "new_value")


@query("SELECT count(*) AS rows, count(*) FILTER (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) AS a, count(*) FILTER (p_partkey % 7 = 0) AS b, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0) AS c, CAST(0 AS BIGINT) AS context, round(100.0::DOUBLE * count(*) FILTER (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) / count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 7 = 0), 9) AS false_negative_percent FROM part")
def row_classes(spark, sf_dir):
    """Rows of part as fragments of a sheet in two versions; which differ in bytes, which in values."""
    from .sources import diagnosis as G

    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    seq = p.select(k, F.col("p_size").cast("bigint").alias("size"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    later = F.col("seq") == 2
    blank = F.when(later & (k % 5 == 0), " ").otherwise("")
    value = F.col("size") + F.when(later & (k % 7 == 0), 1).otherwise(0)
    xml = F.concat(F.lit('<row r="'), k, F.lit('">'), blank, F.lit('<c r="A'), k, F.lit('"><v>'), value, F.lit("</v></c></row>")).cast("binary")
    none = lambda kind: F.expr(f"cast(map() as {kind})")
    stored = seq.select(
        F.concat(F.lit("v"), "seq").alias("path"), F.lit("part").alias("sheet"), F.concat(k, F.lit("#0")).alias("row_key"), F.sha2(xml, 256).alias("digest"), F.lit(1).cast("bigint").alias("cells"),
        F.lit(f'<worksheet xmlns="{G.MAIN}">').cast("binary").alias("head"), xml.alias("xml"), none("map<int, string>").alias("strings"), F.expr("cast(array() as array<int>)").alias("dates"), F.lit(False).alias("epoch_1904"), none("map<string, array<string>>").alias("masters"),
    )
    versions = stored.select("path").distinct().select(F.lit("part").alias("workbook"), F.substring("path", 2, 9).cast("int").alias("seq"), "path")
    return G.totals(G.classes(stored, versions)).withColumn("false_negative_percent", F.round("false_negative_percent", 9))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012') ORDER BY c_custkey LIMIT 8")
def label_suggestions(spark, sf_dir):
    """The first eight labels that hold a text."""
    return table(spark, sf_dir, "customer").filter(F.lower("c_name").contains("00012")).select("c_custkey", "c_name").orderBy("c_custkey").limit(8)


@query("WITH d AS (SELECT doc_id, sha256(text) AS raw, sha256(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS meaning FROM documents), p AS (SELECT doc_id, raw, meaning, lead(raw) OVER w AS raw2, lead(meaning) OVER w AS meaning2 FROM d WINDOW w AS (ORDER BY doc_id)) SELECT CASE WHEN raw = raw2 THEN 'A' WHEN meaning = meaning2 THEN 'B' ELSE 'C' END AS class, count(*) AS n FROM p WHERE raw2 IS NOT NULL GROUP BY 1")
def digest_diagnosis(spark, sf_dir):
    """Equal bytes, equal meaning in other bytes, different meaning, of neighbouring versions."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha2("text", 256).alias("raw"), F.sha2(T.normalised(F.col("text")), 256).alias("meaning"))
    numbered = S.sheets(d, "doc_id", 1).select("seq", "raw", "meaning")
    after = numbered.select((F.col("seq") - 1).alias("seq"), F.col("raw").alias("raw2"), F.col("meaning").alias("meaning2"))
    kind = F.when(F.col("raw") == F.col("raw2"), "A").when(F.col("meaning") == F.col("meaning2"), "B").otherwise("C")
    return numbered.join(after, "seq").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
