"""Listings that come in pages: read a page in a task, and prove that what was read is the whole listing.

Answers of a service are kept as files, <root>/<listing>/<page>.json, where page is the address that the page was asked
for, escaped as in a URL, or the number of entries skipped ("0", "1000"). A page goes on with a next link, in any of the
four shapes that services write, or, if it is full and has none, with the entries skipped so far and its own.

A listing is complete if its pages form one chain from the first page to one that doesn't go on: every page but the first is
what exactly one other goes on with, ids ascend or descend strictly over the chain, no id comes twice, no label stands for
two ids, no page that goes on is empty, and the watermark of the listing was the same before and after. These are joins and
sums over pages; no task follows a chain. What isn't complete is refused with its reason, never taken in part: an
incremental listing, which begins with a version that is known, is then replaced by the full one.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import json_value, next_page
from .history import file_system

PAGES = "listing string, page string, body string"
#: Fixed value: entries that are asked for in a page.
PAGE_SIZE = 1000


class Page(InputPartition):
    def __init__(self, listing: str, page: str, path: str):
        self.listing, self.page, self.path = listing, page, path


class PagesSource(DataSource):
    """spark.read.format("tabloom_pages").option("root", root): a partition for each page."""

    @classmethod
    def name(cls) -> str:
        return "tabloom_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options["root"])


class PagesReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Page]:
        fs, top = file_system(self.root)
        found = []
        for listing in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
            if listing.type == pafs.FileType.Directory:
                found += [Page(listing.base_name, unquote(f.base_name.removesuffix(".json")), f.path) for f in fs.get_file_info(pafs.FileSelector(listing.path)) if f.base_name.endswith(".json")]
        # Spark asks for a partition at least.
        return sorted(found, key=lambda p: (p.listing, p.page)) or [Page("", "", "")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.path:
            fs, _ = file_system(self.root)
            with fs.open_input_file(partition.path) as f:
                yield partition.listing, partition.page, f.read().decode("utf-8", "replace")


def _entries() -> Column:
    """The entries of a page as JSON texts; null if the answer has no list."""
    return F.from_json(json_value(F.col("body")), "array<string>")


def pages_of(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """listing, page, n (entries; null if the answer is none), goes_on (the page it goes on with, null at the end)."""
    n = F.size("_entries")
    skipped = F.col("page").try_cast("bigint")
    link = F.when(F.col("_link") != "", F.col("_link"))
    on = F.coalesce(link, F.when((n >= page_size) & skipped.isNotNull(), (skipped + n).cast("string")))
    return pages.withColumns({"_entries": _entries(), "_link": next_page(F.col("body"))}).select("listing", "page", F.when(F.col("_entries").isNotNull(), n).alias("n"), on.alias("goes_on"))


def versions_of(pages: DataFrame) -> DataFrame:
    """listing, page, pos, version_id (bigint; null if it is no whole number), label of every entry."""
    get = lambda p: F.get_json_object("item", p)
    rows = pages.select("listing", "page", F.posexplode(_entries()).alias("pos", "item"))
    return rows.select("listing", "page", "pos", get("$.ID").try_cast("bigint").alias("version_id"), get("$.VersionLabel").alias("label"))


def proof(pages: DataFrame, marks: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """listing, pages, versions, problem: null if the listing is complete, else the first reason that was found.

    pages: PAGES, a page may be there several times if the bodies are equal. marks: listing, before, after.
    """
    own = pages_of(pages.select("listing", "page", "body").distinct(), page_size)
    entries = versions_of(pages.select("listing", "page", "body").distinct())
    own = own.join(_spans(entries), ["listing", "page"], "left")
    into = own.filter("goes_on is not null").groupBy("listing", F.col("goes_on").alias("page")).agg(F.count("*").alias("comes_from"), F.max("last_id").alias("id_before"))
    linked = own.withColumn("_is", F.lit(True)).join(into, ["listing", "page"], "full_outer")
    step = F.signum(F.col("first_id") - F.col("id_before"))
    per = linked.groupBy("listing").agg(
        F.count("_is").alias("pages"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("versions"),
        F.count_if(F.col("_is").isNotNull() & F.col("n").isNull()).alias("_no_list"),
        F.count_if(F.col("_is").isNull()).alias("_absent"),
        F.count_if(F.col("comes_from") > 1).alias("_twice"),
        F.count_if(F.col("_is").isNotNull() & F.col("comes_from").isNull()).alias("_firsts"),
        F.count_if((F.col("n") == 0) & F.col("goes_on").isNotNull()).alias("_empty"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("_bad"),
        (F.coalesce(F.sum("ups"), F.lit(0)) + F.count_if(step > 0)).alias("_ups"),
        (F.coalesce(F.sum("downs"), F.lit(0)) + F.count_if(step < 0)).alias("_downs"),
        (F.coalesce(F.sum("equal"), F.lit(0)) + F.count_if(step == 0)).alias("_equal"),
    )
    ids = entries.groupBy("listing", "version_id").agg(F.count("*").alias("n")).groupBy("listing").agg(F.count_if(F.col("n") > 1).alias("_repeated"))
    labels = entries.groupBy("listing", "label").agg(F.count_distinct("version_id").alias("n")).groupBy("listing").agg(F.count_if(F.col("n") > 1).alias("_labels"))
    moved = marks.select("listing", (~F.col("before").eqNullSafe(F.col("after")) | F.col("before").isNull()).alias("_moved"))
    every = per.join(ids, "listing", "left").join(labels, "listing", "left").join(moved, "listing", "left")
    reasons = [
        ("an answer has no list", F.col("_no_list") > 0),
        ("a page is missing", F.col("_absent") > 0),
        ("a page is gone on with twice", F.col("_twice") > 0),
        ("there is no first page", F.col("_firsts") == 0),
        ("pages don't hang together", F.col("_firsts") > 1),
        ("an empty page goes on", F.col("_empty") > 0),
        ("a version has no id or label", F.col("_bad") > 0),
        ("an id comes twice", (F.coalesce(F.col("_repeated"), F.lit(0)) > 0) | (F.col("_equal") > 0)),
        ("a label stands for two ids", F.coalesce(F.col("_labels"), F.lit(0)) > 0),
        ("ids are out of order", (F.col("_ups") > 0) & (F.col("_downs") > 0)),
        ("there is no watermark", F.col("_moved").isNull()),
        ("the listing changed while it was read", F.col("_moved")),
    ]
    return every.select("listing", "pages", "versions", (F.col("_downs") > 0).alias("descending"), F.coalesce(*[F.when(x, F.lit(text)) for text, x in reasons]).alias("problem"))


def _spans(entries: DataFrame) -> DataFrame:
    """Per page: its first and last id, entries without an id or label, and steps up, down and nowhere between neighbours."""
    # A page has as many rows as were asked for, so a page is a task's at most.
    step = F.signum(F.col("version_id") - F.lag("version_id").over(Window.partitionBy("listing", "page").orderBy("pos")))
    return entries.withColumn("_step", step).groupBy("listing", "page").agg(
        F.min_by("version_id", "pos").alias("first_id"), F.max_by("version_id", "pos").alias("last_id"), F.count_if(F.col("version_id").isNull() | F.col("label").isNull()).alias("bad"),
        F.count_if(F.col("_step") > 0).alias("ups"), F.count_if(F.col("_step") < 0).alias("downs"), F.count_if(F.col("_step") == 0).alias("equal"),
    )


def enumerated(full: DataFrame, full_marks: DataFrame, delta: DataFrame | None = None, delta_marks: DataFrame | None = None, known: DataFrame | None = None, page_size: int = PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(versions, outcome): listing, version_id, label of listings that are proven; listing, mode, problem of all.

    delta: pages from a known version on, which it must begin with (known: listing, version_id, label), in ascending order.
    A listing whose delta is proven is taken from it (mode delta), else from its full pages (full, or fallback if there was
    a delta); one that neither proves is refused, with the problem of its full pages.
    """
    whole = proof(full, full_marks, page_size).select("listing", F.col("problem").alias("_full"))
    if delta is None:
        outcome = whole.select("listing", F.when(F.col("_full").isNull(), "full").otherwise("refused").alias("mode"), F.col("_full").alias("problem"))
        return versions_of(full).join(outcome.filter("mode = 'full'").select("listing"), "listing", "left_semi").select("listing", "version_id", "label"), outcome
    least = versions_of(delta).groupBy("listing").agg(F.min(F.struct("version_id", "label")).alias("_least"))
    anchor = known.select("listing", F.struct("version_id", "label").alias("_anchor"))
    part = proof(delta, delta_marks, page_size).join(least, "listing", "left").join(anchor, "listing", "left")
    wrong = F.coalesce(F.col("problem"), F.when(F.col("descending"), F.lit("a delta must ascend")), F.when(~F.col("_least").eqNullSafe(F.col("_anchor")), F.lit("it doesn't begin with the known version")))
    part = part.select("listing", F.lit(True).alias("_asked"), wrong.alias("_delta"))
    both = part.join(whole.withColumn("_is", F.lit(True)), "listing", "full_outer")
    proven = F.col("_is").isNotNull() & F.col("_full").isNull()
    mode = F.when(F.col("_asked").isNotNull() & F.col("_delta").isNull(), "delta").when(proven & F.col("_asked").isNotNull(), "fallback").when(proven, "full").otherwise("refused")
    outcome = both.select("listing", mode.alias("mode"), F.coalesce(F.col("_delta"), F.col("_full")).alias("problem"))
    take = lambda pages, modes: versions_of(pages).join(outcome.filter(F.col("mode").isin(*modes)).select("listing"), "listing", "left_semi").select("listing", "version_id", "label")
    return take(delta, ["delta"]).unionByName(take(full, ["full", "fallback"])), outcome
