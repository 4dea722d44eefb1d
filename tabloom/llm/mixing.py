"""Operator 6, mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of a digest of doc_id, form blocks of BLOCK_CHARS characters: a document is in
block floor(characters before it / BLOCK_CHARS). A source of quota p in SLOTS slots releases block j at slot
floor(j * SLOTS / p), with the deadline ceil((j + 1) * SLOTS / p). In each slot the released block with the earliest
deadline goes next (ties: the source that sorts first). As quotas add up to SLOTS, every block meets its deadline, so
until a source ends each source has received less than one block more or less than its weight says. The schedule repeats
after SLOTS slots: one period is made, and block j of a source goes to slot (j div p) * SLOTS + the place of j mod p.

When a source ends, its slots stay empty and the others go on in their proportions; no row is left out or repeated.

Quotas: one slot for each source with a weight, the rest by weight, by largest remainder. A period has SLOTS slots, or
EACH times these sources if that is more, so shares differ from the weights by 1/EACH of the whole at most. Sources with
the weight 0, given or not, come after all others, in the order of their blocks. Without given weights a source weighs the
whole part of the square root of its characters. No source is one group in one task: its order is dealt by digest
prefixes, whose totals give the characters before each.

Sources of equal quota have equal releases and deadlines and so take turns: the schedule is folded over the distinct
quotas, of which there are at most the square root of twice the slots. It is one row of a number per source and slot.

Defined results: a null source is a source of its own and sorts first; null and empty texts count as one character; a
null doc_id has an empty digest, and such rows are dealt by a digest of their text; equal doc_ids share a digest and are
ordered by length;
a document longer than a block fills the following blocks too, so that source is ahead by its length then; if no source
has a weight, all weigh the same; blocks of sources with the weight 0 have slots from LAST on and no release or deadline;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow

BLOCK_CHARS = 1 << 16
SLOTS, EACH = 1024, 64
#: The first slot of sources that weigh nothing.
LAST = 1 << 60
#: Rows of a source under one digest prefix, about.
PREFIX_ROWS = 4096
#: Slots of one inner fold: their list is copied for each slot, the list of these lists only once for each.
_TURN = 256


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def quotas(sizes: DataFrame, weights: dict[str | None, int] | None = None, slots: int = SLOTS) -> DataFrame:
    """(sources, quotas, slots): one row of arrays in the order of the source keys, from sizes(key, chars)."""
    if weights is None:
        weight = F.floor(F.sqrt(F.col("chars"))).cast("bigint")
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit("" if k is None else f"={k}"), F.lit(int(v)).cast("bigint"))]) if weights else F.create_map().cast("map<string,bigint>")
        weight = F.coalesce(given[F.col("key")], F.lit(0)).cast("bigint")
    every = sizes.select("key", weight.alias("weight")).agg(F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("all"))
    heavy = F.filter("all", lambda x: x["weight"] > 0)
    every = every.select(F.when(F.size(heavy) > 0, heavy).otherwise(F.col("all")).alias("all"))
    n = F.size("all")
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["weight"])
    every = every.select("all", F.greatest(F.lit(slots), EACH * n).cast("bigint").alias("slots"), n.cast("bigint").alias("n"), total.alias("total"))
    # If no source weighs anything, all weigh the same.
    share = lambda x: F.when(F.col("total") > 0, x["weight"]).otherwise(F.lit(1).cast("bigint")) * (F.col("slots") - F.col("n"))
    of = F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("n"))
    parts = every.select("slots", F.transform("all", lambda x: F.struct(x["key"].alias("key"), F.expr("1L").alias("one"), share(x).alias("share"), F.pmod(share(x), of).alias("left"))).alias("parts"), of.alias("of"))
    parts = parts.select("slots", F.transform("parts", lambda x: F.struct(x["key"].alias("key"), (F.lit(1) + F.floor((x["share"] - x["left"]) / F.col("of"))).cast("bigint").alias("base"), x["left"].alias("left"))).alias("parts"))
    spare = F.col("slots") - F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["base"])
    ranked = F.array_sort(F.transform("parts", lambda x: F.struct((-x["left"]).alias("by"), x["key"].alias("key"))))
    # The last source that gets one of the spare slots; null if there is none to spare.
    parts = parts.select("slots", "parts", F.get(ranked, spare.cast("int") - 1).alias("last"))
    more = lambda x: F.coalesce(F.struct((-x["left"]).alias("by"), x["key"].alias("key")) <= F.col("last"), F.lit(False)).cast("bigint")
    return parts.select(F.transform("parts", lambda x: x["key"]).alias("sources"), F.transform("parts", lambda x: x["base"] + more(x)).alias("quotas"), "slots")


def period(quota_row: DataFrame) -> DataFrame:
    """(key, quota, slots, nth, slot): the schedule of one period, earliest deadline first."""
    each = quota_row.select("slots", F.posexplode(F.arrays_zip("sources", "quotas")).alias("i", "x")).select("slots", "i", F.col("x.sources").alias("key"), F.col("x.quotas").alias("quota"))
    classes = each.groupBy("slots", "quota").agg(F.array_sort(F.collect_list("i")).alias("members"))
    row = classes.groupBy("slots").agg(F.array_sort(F.collect_list(F.struct("quota", "members"))).alias("classes"))
    release = lambda j, quota: F.floor(j * F.col("slots") / quota)
    deadline = lambda j, quota: F.ceil((j + 1) * F.col("slots") / quota)

    def turn(at, j, place):
        """The next block of class number at: block j of the member at place. Its deadline and source come first."""
        of = F.get(F.col("classes"), at)
        return F.struct(
            deadline(j, of["quota"]).alias("deadline"),
            F.get(of["members"], place).alias("i"),
            at.alias("at"),
            F.when(j < of["quota"], release(j, of["quota"])).otherwise(F.col("slots")).alias("release"),
            j.alias("j"),
            place.alias("place"),
        )

    def after(x):
        last = x["place"] + 1 == F.size(F.get(F.col("classes"), x["at"])["members"])
        return turn(x["at"], x["j"] + last.cast("bigint"), F.when(last, 0).otherwise(x["place"] + 1))

    def step(state, t):
        chosen = F.array_min(F.filter(state["turns"], lambda x: x["release"] <= t))
        # An array of one binds the choice, which would else be worked out again for every class.
        bound = F.transform(F.array(chosen), lambda ch: F.struct(F.transform(state["turns"], lambda x: F.when(x["at"] == ch["at"], after(x)).otherwise(x)).alias("turns"), F.array_append(state["order"], ch["i"]).alias("order")))
        return F.get(bound, F.lit(0))

    none = F.expr("cast(array() as array<int>)")

    def block(state, start):
        within = F.aggregate(F.sequence(start, F.least(start + _TURN, F.col("slots")) - 1), F.struct(state["turns"].alias("turns"), none.alias("order")), step)
        bound = F.transform(F.array(within), lambda w: F.struct(w["turns"].alias("turns"), F.array_append(state["orders"], w["order"]).alias("orders")))
        return F.get(bound, F.lit(0))

    begin = F.struct(F.transform(F.sequence(F.lit(0), F.size("classes") - 1), lambda at: turn(at, F.lit(0).cast("bigint"), F.lit(0))).alias("turns"), F.expr("cast(array() as array<array<int>>)").alias("orders"))
    order = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1, F.lit(_TURN).cast("bigint")), begin, block, lambda s: F.flatten(s["orders"]))
    made = row.select(F.posexplode(order).alias("slot", "i"))
    nth = F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1
    return made.join(each, "i").select("key", "quota", "slots", nth.cast("bigint").alias("nth"), F.col("slot").cast("bigint").alias("slot"))


def mixed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_chars: int = BLOCK_CHARS, slots: int = SLOTS, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs (or its columns carry) as row, a struct, with block, release, deadline, slot and digest.

    Read in the order of (slot, digest, doc_id), rows are mixed to the weights.
    """
    size = F.greatest(F.coalesce(F.char_length(docs["text"].cast("string")), F.lit(0)), F.lit(1)).cast("bigint")
    of_id = F.md5(docs["doc_id"].cast("string").cast("binary"))
    slim = [source_key(docs["source"]).alias("key"), size.alias("size"), F.coalesce(of_id, F.md5(docs["text"].cast("string").cast("binary")), F.lit("")).alias("place")]
    rows = docs.select(F.struct(*[docs[c] for c in (docs.columns if carry is None else carry)]).alias("row"), F.coalesce(of_id, F.lit("")).alias("digest"), *slim)
    digits, n = 0, docs.count()
    while 16**digits * PREFIX_ROWS < n:
        digits += 1
    prefix = F.substring("place", 1, digits) if digits else F.lit("")
    totals = docs.select(*slim).groupBy("key", prefix.alias("prefix")).agg(F.sum("size").alias("chars"))
    ahead = totals.select("key", "prefix", F.coalesce(F.sum("chars").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "prefix").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("prefix", prefix).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ahead, ["key", "prefix"]).withColumn("block", F.floor((F.col("ahead") + F.col("within")) / block_chars))
    plan = cut(period(quotas(totals.groupBy("key").agg(F.sum("chars").alias("chars")), weights, slots)), "mixing-plan")
    quota = plan.groupBy("key").agg(F.first("quota").alias("quota"), F.first("slots").alias("slots"), F.map_from_entries(F.collect_list(F.struct("nth", "slot"))).alias("places"))
    # One row per source, of as many entries in all as there are slots.
    out = placed.join(narrow(quota, plan.count()), "key", "left")
    j, p, q = F.col("block"), F.col("quota"), F.col("slots")
    return out.select(
        "row",
        "digest",
        "block",
        F.floor(j * q / p).alias("release"),
        F.ceil((j + 1) * q / p).alias("deadline"),
        F.coalesce(F.floor(j / p) * q + F.col("places")[F.pmod(j, p)], F.lit(LAST) + j).alias("slot"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows themselves, mixed: ranges of slots, each in order."""
    return rows.repartitionByRange("slot", "digest").sortWithinPartitions("slot", "digest", "row.doc_id").select("row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, greatest(coalesce(length(text), 0), 1) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS digest FROM documents
), b AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 65536 AS block FROM d
), w AS (SELECT key, CAST(floor(sqrt(sum(size))) AS BIGINT) AS weight FROM d GROUP BY key),
k AS (SELECT count(*) AS n, sum(weight)::BIGINT AS total, greatest(1024, 64 * count(*)) AS slots FROM w),
p AS (SELECT key, 1 + weight * (slots - n) // total AS base, weight * (slots - n) % total AS rest FROM w, k),
q AS (SELECT key, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= (SELECT slots FROM k) - (SELECT sum(base) FROM p) THEN 1 ELSE 0 END AS quota FROM p),
a AS (SELECT list(key ORDER BY key) AS keys, list(CAST(quota AS BIGINT) ORDER BY key) AS ps, any_value(slots) AS slots FROM q, k),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ps, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS chosen FROM a
  UNION ALL
  SELECT t, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = chosen THEN 1 ELSE 0 END), chosen FROM (
    SELECT t + 1 AS t, done, list_min(list_transform(range(1, len(done) + 1), lambda i: CASE WHEN done[i] < ps[i] AND done[i] * slots // ps[i] <= t + 1
      THEN ((done[i] + 1) * slots + ps[i] - 1) // ps[i] * 1000000 + i ELSE 9000000000000000 END)) % 1000000 AS chosen
    FROM edf, a WHERE t < slots - 1)
), s AS (SELECT keys[chosen] AS key, ps[chosen] AS quota, slots, t, row_number() OVER (PARTITION BY chosen ORDER BY t) - 1 AS nth FROM edf, a WHERE chosen > 0)
SELECT b.doc_id, b.source, b.block, b.block * s.slots // s.quota AS release, ((b.block + 1) * s.slots + s.quota - 1) // s.quota AS deadline,
  b.block // s.quota * s.slots + s.t AS slot, b.digest
FROM b JOIN s ON b.key = s.key AND b.block % s.quota = s.nth
"""
