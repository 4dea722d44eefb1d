"""The report of a structural comparison: one .xlsx with a summary and the differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import running_total
from ..sources.book import PER_SHEET, Sheet, write_book
from .shared import new_folder, stage

#: Titles of the differences' columns.
TITLES = {"id": "ID", "sheet": "Aba", "location": "Localização", "category": "Categoria", "base": "Base", "evaluated": "Avaliada", "details": "Detalhes"}


def summary(differences: DataFrame, base: str, evaluated: str) -> DataFrame:
    """i, field, value: the files, and how many differences there are, in all, by category and by sheet, the commonest first."""
    spark = differences.sparkSession
    by = lambda c, k: differences.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k))
    found = sorted((r["kind"], -r["n"], r["name"] or "") for r in by("category", 1).unionByName(by("sheet", 2)).collect())  # a row for each category and sheet
    rows = [("Base", base), ("Avaliada", evaluated), ("Total de divergências", str(sum(-n for k, n, _ in found if k == 1)))]
    rows += [(name if k == 1 else f"Aba {name}", str(-n)) for k, n, name in found]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i bigint, field string, value string")


def write_comparison(differences: DataFrame, to: str, base: str, evaluated: str, per_sheet: int = PER_SHEET) -> DataFrame:
    """Write differences (see structural.DIFFERENCES) in the order of sheet, place and category; gives the workbook's parts."""
    spark = differences.sparkSession
    text = [F.coalesce(c, F.lit("")).alias(c) for c in TITLES if c != "id"]
    rows = differences.select(*text).withColumn("_h", F.monotonically_increasing_id())
    kept = stage(running_total(stage(rows, "differences"), [], ["sheet", "location", "category", "_h"], F.lit(1).cast("bigint"), "id"), "numbered-differences")
    book = [Sheet("Resumo", summary(kept, base, evaluated), "i", {"field": "Campo", "value": "Valor"}), Sheet("Divergências", kept, "id", TITLES, kept.count() > per_sheet)]
    return write_book(spark, to, book, new_folder(spark, "comparison"), per_sheet)
