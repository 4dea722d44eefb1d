"""Coordinates of a sheet that matter, the values of merged cells, and what lies in inserted or removed rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import address, column_number
from .alignment import in_ranges

REF = r"^([A-Z]+)([0-9]+)(?::([A-Z]+)([0-9]+))?$"


def content(cells: DataFrame) -> DataFrame:
    """Cells with content: blank text is none."""
    return cells.filter(F.trim("text") != "")


def meaningful(cells: DataFrame) -> DataFrame:
    """sheet, row, column of cells with content."""
    return content(cells).select("sheet", "row", "column").distinct()


def styled(styles: DataFrame) -> DataFrame:
    """sheet, row, column of cells with a style, empty ones too."""
    return styles.select("sheet", "row", "column").distinct()


def relevant(cells: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Coordinates with content, and those with a style if styles are compared."""
    return meaningful(cells) if styles is None else meaningful(cells).unionByName(styled(styles)).distinct()


def used(coordinates: DataFrame, axis: str) -> DataFrame:
    """The rows (or columns) of each sheet that hold a coordinate, in order."""
    return coordinates.select("sheet", axis).distinct().orderBy("sheet", axis)


def merged_ranges(layout: DataFrame) -> DataFrame:
    """sheet, range_id (its text), min_row, max_row, min_col, max_col of the merged ranges of a layout."""
    part = lambda i: F.regexp_extract(F.upper("ref"), REF, i)
    row = lambda i: part(i).try_cast("bigint")
    column = lambda i: F.when(part(i) != "", column_number(part(i)))
    found = layout.filter("item = 'merge'").select("sheet", "ref").distinct().filter(F.upper("ref").rlike(REF))
    return found.select("sheet", F.col("ref").alias("range_id"), row(2).alias("min_row"), F.coalesce(row(4), row(2)).alias("max_row"), column(1).alias("min_col"), F.coalesce(column(3), column(1)).alias("max_col"))


def anchors(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges with text: the value of their upper left cell, null without one."""
    at = cells.select("sheet", F.col("row").alias("min_row"), F.col("column").alias("min_col"), "text")
    return ranges.join(at, ["sheet", "min_row", "min_col"], "left")


def effective(coordinates: DataFrame, cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """sheet, row, column, text, range_id: a cell of a merged range has the value of the range's anchor."""
    points = coordinates.select("sheet", "row", F.col("column").alias("col"))
    inside = in_ranges(points, ranges, ["sheet"]).select("sheet", "row", F.col("col").alias("column"), "range_id").join(anchors(cells, ranges).select("sheet", "range_id", F.col("text").alias("merged_text")), ["sheet", "range_id"])
    key = ["sheet", "row", "column"]
    own = coordinates.select(*key).join(cells.select(*key, "text"), key, "left").join(inside, key, "left")
    return own.select(*key, F.when(F.col("range_id").isNotNull(), F.col("merged_text")).otherwise(F.col("text")).alias("text"), "range_id")


def area_content(cells: DataFrame, ranges: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """sheet, location, text, area (row or column) of content in given rows and columns (sheet, position).

    A merged range is one entry, with its anchor's value, wherever it touches an area. What lies in a row and in a column
    of them counts for the row.
    """
    points = content(cells).select("sheet", "row", F.col("column").alias("col"), "text")
    merged = in_ranges(points, ranges, ["sheet"]).select("sheet", "row", "col").distinct()
    plain = points.join(merged, ["sheet", "row", "col"], "left_anti")
    whole = content(anchors(cells, ranges))
    # A row (or column) touches a range if its place lies between the range's; the other axis is left out as 0.
    flat = lambda low, high: whole.select("sheet", "range_id", F.col(low).alias("min_row"), F.col(high).alias("max_row"), F.lit(0).alias("min_col"), F.lit(0).alias("max_col"))
    touch = lambda area, low, high: in_ranges(area.select("sheet", F.col("position").alias("row"), F.lit(0).alias("col")), flat(low, high), ["sheet"]).select("sheet", "range_id").distinct()
    out = None
    for area, axis, low, high, name in ((rows, "row", "min_row", "max_row", "row"), (columns, "col", "min_col", "max_col", "column")):
        here = plain.join(area.select("sheet", F.col("position").alias(axis)).distinct(), ["sheet", axis])
        cells_in = here.select("sheet", F.concat("sheet", F.lit("!"), address(F.col("row"), F.col("col"))).alias("location"), "text", F.lit(name).alias("area"))
        ranges_in = whole.join(touch(area, low, high), ["sheet", "range_id"]).select("sheet", F.concat("sheet", F.lit("!"), "range_id").alias("location"), "text", F.lit(name).alias("area"))
        both = cells_in.unionByName(ranges_in)
        out = both if out is None else out.unionByName(both)
    return out.groupBy("sheet", "location", "text").agg(F.max("area").alias("area"))  # row goes before column
