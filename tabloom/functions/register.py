"""Python functions for SQL: xlsx_cells(path, content) as a table function, and formula and profile functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..operators.alignment import likeness
from .formulas import equivalent, remap_formula, shift_formula


@udtf(returnType="path string, sheet string, row bigint, column bigint, address string, kind string, text string, key string, style bigint")
class XlsxCells:
    def eval(self, path: str, content: bytes):
        from ..sources.xlsx import cells_of

        yield from cells_of(path, content)


@pandas_udf("double")
def profile_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(list(x), list(y)) for x, y in zip(a, b, strict=True)])


@pandas_udf("string")
def translate_formula(formula: pd.Series, origin: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([shift_formula(*x) for x in zip(formula, origin, target, strict=True)])


@pandas_udf("string")
def remapped_formula(formula: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([remap_formula(f, dict(r), dict(c)) for f, r, c in zip(formula, rows, columns, strict=True)])


@pandas_udf("boolean")
def formulas_equal(a: pd.Series, b: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([equivalent(x, y, dict(r), dict(c)) for x, y, r, c in zip(a, b, rows, columns, strict=True)])


def register(spark: SparkSession) -> None:
    spark.udtf.register("xlsx_cells", XlsxCells)
    for name, f in {"profile_likeness": profile_likeness, "translate_formula": translate_formula, "remap_formula": remapped_formula, "formulas_equal": formulas_equal}.items():
        spark.udf.register(name, f)
