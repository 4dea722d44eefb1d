"""Where the reports of workbooks are: under their canonical names, else under legacy names that are not ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_token, safe_stem


def names(workbooks: DataFrame) -> DataFrame:
    """workbook_id, canonical, legacy: a report's name with the identity's token, and the one by its stem alone."""
    stem = safe_stem(F.col("name"))
    return workbooks.select("workbook_id", F.concat(stem, F.lit("-"), identity_token("site_id", "drive_id", "item_id"), F.lit(".xlsx")).alias("canonical"), F.concat(stem, F.lit(".xlsx")).alias("legacy"))


def ambiguous(workbooks: DataFrame) -> DataFrame:
    """legacy names that more than one workbook would have."""
    return names(workbooks).groupBy("legacy").agg(F.count("*").alias("workbooks")).filter("workbooks > 1")


def locate(workbooks: DataFrame, files: DataFrame) -> DataFrame:
    """workbook_id, file, how (canonical, legacy or null) of each workbook; files: name."""
    wanted = names(workbooks)
    there = files.select("name").distinct()
    by = lambda c: there.select(F.col("name").alias(c), F.lit(True).alias(f"has_{c}"))
    clear = wanted.join(ambiguous(workbooks).select("legacy"), "legacy", "left_anti").select("workbook_id", F.lit(True).alias("clear"))
    both = wanted.join(by("canonical"), "canonical", "left").join(by("legacy"), "legacy", "left").join(clear, "workbook_id", "left")
    how = F.when(F.col("has_canonical"), "canonical").when(F.col("has_legacy") & F.col("clear"), "legacy")
    return both.select("workbook_id", F.when(how == "canonical", F.col("canonical")).when(how == "legacy", F.col("legacy")).alias("file"), how.alias("how"))
