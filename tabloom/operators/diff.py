"""Differences between versions of a sheet, as added, deleted and modified cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["sheet", "row", "column"]


def snapshot_diff(previous: DataFrame, current: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ADD, DEL and MOD rows of two snapshots (CELL, text, key): one full outer join on the cell.

    A sheet that one side lacks is one without cells. by: columns that tell versions apart (a pair's id), joined too.
    """
    on = [*(by or []), *CELL]
    a = previous.select(*on, F.col("text").alias("previous_value"), F.col("key").alias("previous_key"))
    b = current.select(*on, F.col("text").alias("new_value"), F.col("key").alias("new_key"))
    kind = F.when(F.col("previous_key").isNull(), "ADD").when(F.col("new_key").isNull(), "DEL").when(F.col("previous_key") != F.col("new_key"), "MOD")
    return a.join(b, on, "full_outer").withColumn("change_type", kind).filter("change_type is not null").select(*on, "change_type", "previous_value", "new_value")


def packed(cells: DataFrame) -> DataFrame:
    """sheet, row, cells (in the order of their columns), digest: a row of a sheet has 16,384 cells at most."""
    rows = cells.groupBy("sheet", "row").agg(F.array_sort(F.collect_list(F.struct("column", "key", "text"))).alias("cells"))
    return rows.withColumn("digest", F.sha2(F.concat_ws("\x1e", F.transform("cells", lambda c: F.concat_ws("\x1f", c["column"].cast("string"), c["key"]))), 256))


def row_digests(cells: DataFrame) -> DataFrame:
    """sheet, row, digest of each row's cells in their order."""
    return packed(cells).select("sheet", "row", "digest")


def hash_skip_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """snapshot_diff, of those rows only whose digests differ: each side is gathered by row once, and joined once."""
    a, b = (packed(x).select("sheet", "row", F.col("cells").alias(f"{n}_cells"), F.col("digest").alias(f"{n}_digest")) for x, n in ((previous, "a"), (current, "b")))
    changed = a.join(b, ["sheet", "row"], "full_outer").filter(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    side = lambda n: F.transform(f"{n}_cells", lambda c: F.struct(c["column"].alias("column"), F.lit(n).alias("side"), c["key"].alias("key"), c["text"].alias("text")))
    cells = changed.select("sheet", "row", F.explode(F.flatten(F.filter(F.array(side("a"), side("b")), lambda x: x.isNotNull()))).alias("c")).select("sheet", "row", "c.*")
    of = lambda n, what: F.max(F.when(F.col("side") == n, F.col(what)))
    both = cells.groupBy(*CELL).agg(of("a", "key").alias("a_key"), of("b", "key").alias("b_key"), of("a", "text").alias("previous_value"), of("b", "text").alias("new_value"))
    kind = F.when(F.col("a_key").isNull(), "ADD").when(F.col("b_key").isNull(), "DEL").when(F.col("a_key") != F.col("b_key"), "MOD")
    return both.withColumn("change_type", kind).filter("change_type is not null").select(*CELL, "change_type", "previous_value", "new_value")


def table_diff(previous: DataFrame, current: DataFrame, sheet: str, key: str, columns: list[str]) -> DataFrame:
    """snapshot_diff of two tables of equal columns: one join per row, and cells are made of those that differ only.

    The key (one whole number, unique) is the row, the place of a column in columns its number.
    """
    names = [f"v{i}" for i in range(1, len(columns) + 1)]
    side = lambda t, n: t.select(F.col(key).cast("bigint").alias("row"), F.lit(True).alias(f"{n}_is"), *[F.col(c).alias(f"{n}_{v}") for c, v in zip(columns, names, strict=True)])
    both = side(previous, "a").join(side(current, "b"), "row", "full_outer")
    # Rows that are equal in all columns go before anything is written as text.
    both = both.filter(~(F.struct(*[f"a_{v}" for v in names]).eqNullSafe(F.struct(*[f"b_{v}" for v in names]))) | F.col("a_is").isNull() | F.col("b_is").isNull())
    kinds = dict(previous.dtypes)

    def cell(i: int, v: str):
        a, b = F.col(f"a_{v}"), F.col(f"b_{v}")
        texts = F.struct(F.lit(i).alias("column"), F.when(a.isNull(), "ADD").when(b.isNull(), "DEL").otherwise("MOD").alias("change_type"), a.cast("string").alias("previous_value"), b.cast("string").alias("new_value"))
        return F.when(~a.eqNullSafe(b), texts)

    if any(dict(current.dtypes)[c] != kinds[c] for c in columns):
        raise ValueError("both tables must have the same types")
    found = F.filter(F.array(*[cell(i, v) for i, v in enumerate(names, 1)]), lambda x: x.isNotNull())
    return both.select(F.lit(sheet).alias("sheet"), "row", F.explode(found).alias("c")).select("sheet", "row", "c.*")


def summary(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per kind of change."""
    of = lambda k: F.count_if(F.col("change_type") == k).alias(k.lower())
    return changes.groupBy(*(by or [])).agg(F.count("*").alias("total"), of("ADD"), of("MOD"), of("DEL"))


def chain_diff(cells: DataFrame, chain: list[str], version: str, field: str, value: str) -> DataFrame:
    """Changes between consecutive versions of one chain, all pairs in one pass: each field against the version before.

    A field that a version lacks is deleted there; one that appears is added. Versions are numbers without gaps.
    """
    w = Window.partitionBy(*chain, field).orderBy(version)
    last = cells.groupBy(*chain).agg(F.max(version).alias("last"), F.min(version).alias("first_version"))
    rows = cells.join(last, chain).withColumn("before", F.lag(F.struct(version, value)).over(w)).withColumn("after", F.lead(version).over(w))
    gap = F.col("before").isNull() | (F.col(f"before.{version}") != F.col(version) - 1)
    here = F.struct(F.col(version).alias("at"), F.when(gap, "ADD").when(F.col(f"before.{value}") != F.col(value), "MOD").alias("kind"), F.when(~gap, F.col(f"before.{value}")).alias("old"), F.col(value).alias("new"))
    here = F.when((F.col(version) > F.col("first_version")) & here["kind"].isNotNull(), here)
    gone = F.when((F.col(version) < F.col("last")) & (F.col("after").isNull() | (F.col("after") != F.col(version) + 1)), F.struct((F.col(version) + 1).alias("at"), F.lit("DEL").alias("kind"), F.col(value).alias("old"), F.lit(None).cast("string").alias("new")))
    events = rows.select(*chain, field, F.explode(F.filter(F.array(here, gone), lambda x: x.isNotNull())).alias("e"))
    return events.select(*chain, F.col("e.at").alias(version), field, F.col("e.kind").alias("change_type"), F.col("e.old").alias("previous_value"), F.col("e.new").alias("new_value"))
