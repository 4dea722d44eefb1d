"""Structural comparison of two workbooks: columns, then rows are aligned, then contents and formulas are compared.

Inputs are cells (sheet, row, column, kind, text) and sheets. Contents here follow other rules than in a diff of
versions: blank text is no content, and an inserted row or column is one difference, not one per cell.
compare_workbooks() takes layouts and styles too, lists what lies in inserted rows and columns, and has an option for
each kind of difference.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import address
from ..functions.formulas import Mapping, equivalent, remap_formula
from ..plans import shared
from .alignment import aligned, gaps, profiles
from .areas import area_content, content, merged_ranges
from .segments import aligned_in_segments

DIFFERENCES = "sheet string, location string, category string, base string, evaluated string, details string"
#: The categories, by the option that asks for them.
CATEGORIES = {
    "sheets": ("sheet removed", "sheet added"),
    "columns": ("column removed", "column added"),
    "rows": ("row removed", "row added"),
    "content": ("content removed", "content added", "content changed"),
    "formula": ("formula changed",),
    "sheet_state": ("sheet state changed",),
}


def axis(base: DataFrame, other: DataFrame, pos: str, along: str, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sheet, base_pos, eval_pos of one axis; positions without anchors stay where they are unless they were inserted."""
    a, b = (profiles(x, ["sheet", pos], along).withColumnRenamed(pos, "pos") for x in (base, other))
    # Columns of a sheet are 16,384 at most; rows can be a million, and are walked in segments.
    return aligned(a, b, ["sheet"]) if pos == "column" else aligned_in_segments(a, b, ["sheet"], stage)


def complete(anchors: DataFrame, changed: DataFrame, base: DataFrame, other: DataFrame, pos: str) -> DataFrame:
    """Anchors, and every used position without one mapped to itself unless that was inserted or removed."""
    used = base.select("sheet", F.col(pos).alias("p")).unionByName(other.select("sheet", F.col(pos).alias("p"))).distinct()
    for side in ("base_pos", "eval_pos"):
        used = used.join(anchors.select("sheet", F.col(side).alias("p")), ["sheet", "p"], "left_anti")
    used = used.join(changed.select("sheet", F.col("position").alias("p")), ["sheet", "p"], "left_anti")
    return anchors.select("sheet", "base_pos", "eval_pos").unionByName(used.select("sheet", F.col("p").alias("base_pos"), F.col("p").alias("eval_pos")))


def _difference(rows: DataFrame, location, category, base=None, evaluated=None, details=None) -> DataFrame:
    text = lambda c: (F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit("")))
    return rows.select("sheet", location.alias("location"), category.alias("category"), text(base).alias("base"), text(evaluated).alias("evaluated"), text(details).alias("details"))


class Axes(NamedTuple):
    """How rows and columns of two workbooks go together (sheet, base_pos, eval_pos), and what has no partner."""

    columns: DataFrame
    column_gaps: DataFrame
    rows: DataFrame
    row_gaps: DataFrame


def written(rows: DataFrame) -> DataFrame:
    """Anchors are used several times: they are a table in the shared folder."""
    return shared.stage(rows, "axes")


def axes(base: DataFrame, other: DataFrame, stage: Callable[[DataFrame], DataFrame] = written) -> Axes:
    """Columns are aligned first, and rows on the columns that both sides have. stage: writes a table, and reads it."""
    column_anchors = stage(axis(base, other, "column", "row", stage))
    column_gaps = gaps(column_anchors, ["sheet"])
    columns = complete(column_anchors, column_gaps, base, other, "column")
    moved = base.join(columns.withColumnRenamed("base_pos", "column"), ["sheet", "column"]).drop("column").withColumnRenamed("eval_pos", "column")
    there = other.join(columns.select("sheet", F.col("eval_pos").alias("column")), ["sheet", "column"], "left_semi")
    row_anchors = stage(axis(moved, there, "row", "column", stage))
    row_gaps = gaps(row_anchors, ["sheet"])
    return Axes(columns, column_gaps, complete(row_anchors, row_gaps, base, other, "row"), row_gaps)


def compare(base: DataFrame, other: DataFrame, base_sheets: DataFrame, other_sheets: DataFrame, options: set[str] | None = None, found_axes: Axes | None = None) -> DataFrame:
    """Differences between two workbooks, of the asked categories (all by default)."""
    options = set(CATEGORIES) if options is None else options
    base, other = content(base), content(other)
    names = base_sheets.select("sheet", F.col("state").alias("a")).join(other_sheets.select("sheet", F.col("state").alias("b")), "sheet", "full_outer")
    sheets = _difference(names.filter("a is null or b is null"), F.lit(""), F.when(F.col("b").isNull(), "sheet removed").otherwise("sheet added"))
    state = _difference(names.filter("a <> b"), F.lit(""), F.lit("sheet state changed"), F.col("a"), F.col("b"))
    common = names.filter("a is not null and b is not null").select("sheet")
    base, other = base.join(common, "sheet", "left_semi"), other.join(common, "sheet", "left_semi")

    columns, column_gaps, rows, row_gaps = found_axes or axes(base, other)
    events = [_difference(g, F.concat(F.lit(f"{what} "), F.col("position")), F.concat(F.lit(f"{what} "), F.col("side"))) for what, g in (("column", column_gaps), ("row", row_gaps))]

    a = (
        base.join(rows.withColumnRenamed("base_pos", "row"), ["sheet", "row"]).withColumnRenamed("eval_pos", "to_row")
        .join(columns.withColumnRenamed("base_pos", "column"), ["sheet", "column"]).withColumnRenamed("eval_pos", "to_column")
        .select("sheet", "to_row", "to_column", F.col("row").alias("base_row"), F.col("column").alias("base_column"), F.col("text").alias("base_text"), F.col("kind").alias("base_kind"))
    )
    b = (
        other.join(rows.select("sheet", F.col("eval_pos").alias("row")), ["sheet", "row"], "left_semi")
        .join(columns.select("sheet", F.col("eval_pos").alias("column")), ["sheet", "column"], "left_semi")
        .select("sheet", F.col("row").alias("to_row"), F.col("column").alias("to_column"), F.col("text").alias("eval_text"), F.col("kind").alias("eval_kind"))
    )
    both = a.join(b, ["sheet", "to_row", "to_column"], "full_outer").filter("not (base_text <=> eval_text)")
    here = address(F.coalesce("base_row", "to_row"), F.coalesce("base_column", "to_column"))
    to = address(F.col("to_row"), F.col("to_column"))
    place = F.when(here == to, F.concat("sheet", F.lit("!"), to)).otherwise(F.concat("sheet", F.lit("!"), here, F.lit(" → "), to))
    formula = F.coalesce(F.col("base_text").startswith("="), F.lit(False)) | F.coalesce(F.col("eval_text").startswith("="), F.lit(False))
    plain = both if "formula" not in options else both.filter(F.col("base_text").isNull() | F.col("eval_text").isNull() | ~formula)
    kind = F.when(F.col("eval_text").isNull(), "content removed").when(F.col("base_text").isNull(), "content added").otherwise("content changed")
    values = _difference(plain, place, kind, F.col("base_text"), F.col("eval_text"))
    texts = both.filter(F.col("base_text").isNotNull() & F.col("eval_text").isNotNull() & formula).withColumn("place", place)
    maps = rows.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("base_pos", "eval_pos"))).alias("row_map")).join(columns.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("base_pos", "eval_pos"))).alias("column_map")), "sheet")

    def judge(k, cells: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        out = []
        rm, cm = (Mapping(maps[c].iloc[0] if len(maps) else {}) for c in ("row_map", "column_map"))
        for place, x, y in cells[["place", "base_text", "eval_text"]].itertuples(index=False):
            if not (x.startswith("=") and y.startswith("=")) or not equivalent(x, y, rm, cm):
                expected = remap_formula(x, rm, cm) if x.startswith("=") else ""
                out.append((k[0], place, "formula changed", x, y, f"expected {expected}" if expected else ""))
        return pd.DataFrame(out, columns=["sheet", "location", "category", "base", "evaluated", "details"], dtype="object")

    formulas = texts.groupBy("sheet").cogroup(maps.groupBy("sheet")).applyInPandas(judge, DIFFERENCES)
    found = sheets
    for part, option in ((state, "sheet_state"), (events[0], "columns"), (events[1], "rows"), (values, "content"), (formulas, "formula")):
        if option in options:
            found = found.unionByName(part)
    wanted = [c for o in options for c in CATEGORIES[o]]
    return found.filter(F.col("category").isin(wanted))


#: Items of a layout, with their categories; rows and columns as a whole, or by part after split_layout().
LAYOUT_ITEMS = {"state": "sheet state changed", "protection": "sheet protection changed", "freeze": "frozen panes changed", "row": "row layout changed", "column": "column layout changed"}
LAYOUT_PARTS = {"row_height": "row height changed", "row_hidden": "row hidden changed", "column_width": "column width changed", "column_hidden": "column hidden changed"}


def split_layout(layout: DataFrame) -> DataFrame:
    """A layout whose rows and columns have an entry for each part (height or width, hidden) instead of one in all."""
    parts = lambda item, names: F.when(F.col("item") == item, F.array(*[F.struct(F.lit(f"{item}_{n}").alias("item"), F.get_json_object("value", f"$.{n}").alias("value")) for n in names]))
    own = F.array(F.struct("item", "value"))
    split = layout.withColumn("x", F.explode(F.coalesce(parts("row", ("height", "hidden")), parts("column", ("width", "hidden")), own)))
    return split.withColumns({"item": F.col("x.item"), "value": F.col("x.value")}).drop("x").filter("value is not null")


def compare_layout(base: DataFrame, other: DataFrame, rows: DataFrame, columns: DataFrame, items: set[str] | None = None) -> DataFrame:
    """Differences of layouts (sheet, item, first, last, ref, value): sheets by name, rows and columns through their maps.

    Merged ranges are held against each other as texts, without being moved.
    """
    every = LAYOUT_ITEMS | LAYOUT_PARTS
    items = {*every, "merge"} if items is None else items
    at = lambda d: d.filter(F.col("item").isin(*every)).select("sheet", "item", F.explode(F.sequence("first", "last")).alias("pos"), "value")
    of = lambda d, axis_: d.select("sheet", "base_pos", "eval_pos", F.explode(F.array(*[F.lit(i) for i in every if i.startswith(axis_)])).alias("item"))
    maps = of(rows, "row").unionByName(of(columns, "column"))
    moved = at(base).alias("x").join(maps.alias("m"), (F.col("x.sheet") == F.col("m.sheet")) & (F.col("x.item") == F.col("m.item")) & (F.col("x.pos") == F.col("m.base_pos")), "left")
    b = moved.select(F.col("x.sheet").alias("sheet"), F.col("x.item").alias("item"), F.coalesce("eval_pos", "pos").alias("pos"), F.col("x.value").alias("base"))
    e = at(other).withColumnRenamed("value", "evaluated")
    both = b.join(e, ["sheet", "item", "pos"], "full_outer").filter(F.col("item").isin(*items) & ~F.col("base").eqNullSafe(F.col("evaluated")))
    category = F.create_map(*[F.lit(x) for kv in every.items() for x in kv])[F.col("item")]
    found = _difference(both, F.when(F.col("pos") == 0, F.col("sheet")).otherwise(F.concat("sheet", F.lit("!"), F.substring_index("item", "_", 1), F.lit(" "), "pos")), category, F.col("base"), F.col("evaluated"))
    if "merge" in items:
        m = [d.filter("item = 'merge'").select("sheet", "ref").distinct() for d in (base, other)]
        for one, two, what in ((m[0], m[1], "merge removed"), (m[1], m[0], "merge added")):
            gone = one.subtract(two)
            found = found.unionByName(_difference(gone, F.concat("sheet", F.lit("!"), "ref"), F.lit(what), *([F.col("ref")] if what == "merge removed" else [None, F.col("ref")])))
    return found


def compare_styles(base: DataFrame, other: DataFrame, rows: DataFrame, columns: DataFrame, parts: set[str]) -> DataFrame:
    """Differences of cell styles (sheet, row, column, part, value) after rows and columns are mapped."""
    a = (
        base.filter(F.col("part").isin(*parts))
        .join(rows.withColumnRenamed("base_pos", "row"), ["sheet", "row"], "left").withColumn("row", F.coalesce("eval_pos", "row")).drop("eval_pos")
        .join(columns.withColumnRenamed("base_pos", "column"), ["sheet", "column"], "left").withColumn("column", F.coalesce("eval_pos", "column")).drop("eval_pos")
        .withColumnRenamed("value", "base")
    )
    b = other.filter(F.col("part").isin(*parts)).withColumnRenamed("value", "evaluated")
    key = ["sheet", "row", "column", "part"]
    both = a.select(*key, "base").join(b.select(*key, "evaluated"), key, "full_outer").filter(~F.col("base").eqNullSafe(F.col("evaluated")))
    return _difference(both, F.concat("sheet", F.lit("!"), address(F.col("row"), F.col("column"))), F.concat(F.col("part"), F.lit(" changed")), F.col("base"), F.col("evaluated"))


#: The options of a comparison, with the categories that each asks for.
FLAGS = {
    "value": ("content changed",),
    "formula": ("formula changed",),
    "removed_content": ("content removed",),
    "added_content": ("content added",),
    "font": ("font changed",),
    "fill": ("fill changed",),
    "border": ("border changed",),
    "alignment": ("alignment changed",),
    "number_format": ("number_format changed",),
    "protection": ("protection changed",),
    "added_rows": ("row added",),
    "removed_rows": ("row removed",),
    "added_columns": ("column added",),
    "removed_columns": ("column removed",),
    "row_height": ("row height changed",),
    "column_width": ("column width changed",),
    "row_hidden": ("row hidden changed",),
    "column_hidden": ("column hidden changed",),
    "merged_cells": ("merge removed", "merge added"),
    "sheets": ("sheet removed", "sheet added"),
    "sheet_state": ("sheet state changed",),
    "sheet_protection": ("sheet protection changed",),
    "freeze_panes": ("frozen panes changed",),
}
STYLE_FLAGS = ("font", "fill", "border", "alignment", "number_format", "protection")


class Book(NamedTuple):
    """What a comparison takes of a workbook: cells and sheets, and layout and styles where they are compared."""

    cells: DataFrame
    sheets: DataFrame
    layout: DataFrame | None = None
    styles: DataFrame | None = None


def compare_workbooks(base: Book, other: Book, flags: set[str] | None = None, stage: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Differences of the kinds that flags ask for (all by default), with the content of inserted and removed areas."""
    flags = set(FLAGS) if flags is None else flags
    if flags - set(FLAGS):
        raise ValueError(f"unknown options: {sorted(flags - set(FLAGS))}")
    common = base.sheets.select("sheet").join(other.sheets.select("sheet"), "sheet", "left_semi")
    a, b = (content(x.cells).join(common, "sheet", "left_semi") for x in (base, other))
    found_axes = axes(a, b, stage)
    options = {o for o, cs in CATEGORIES.items() if any(c in FLAGS[f] for f in flags for c in cs)}
    # Where formulas are not asked for, cells with one are no change of value either.
    found = compare(base.cells, other.cells, base.sheets, other.sheets, options | {"formula"}, found_axes)
    layouts = base.layout is not None and other.layout is not None
    if layouts:
        found = found.unionByName(compare_layout(*(split_layout(x.layout).join(common, "sheet", "left_semi") for x in (base, other)), found_axes.rows, found_axes.columns, {"protection", "freeze", "merge", *LAYOUT_PARTS}))
    if base.styles is not None and other.styles is not None and flags & set(STYLE_FLAGS):
        found = found.unionByName(compare_styles(*(x.styles.join(common, "sheet", "left_semi") for x in (base, other)), found_axes.rows, found_axes.columns, flags & set(STYLE_FLAGS)))
    none = found_axes.rows.sparkSession.createDataFrame([], "sheet string, range_id string, min_row bigint, max_row bigint, min_col bigint, max_col bigint")
    for side, x, cells in (("added", other, b), ("removed", base, a)):
        pick = lambda g: g.filter(F.col("side") == side).select("sheet", "position")  # noqa: B023, E731
        inside = area_content(cells, merged_ranges(x.layout) if layouts else none, pick(found_axes.row_gaps), pick(found_axes.column_gaps))
        values = (None, F.col("text")) if side == "added" else (F.col("text"), None)
        found = found.unionByName(_difference(inside, F.col("location"), F.lit(f"content {side}"), *values, F.concat(F.lit("in an added " if side == "added" else "in a removed "), "area")))
    return found.filter(F.col("category").isin([c for f in flags for c in FLAGS[f]]))
