"""Addresses of cells, typed cell values, and tables as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**31 - 1
ADDRESS = r"^([A-Z]+)([1-9][0-9]*)$"


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """1 -> A, 27 -> AA; up to three letters."""
    n = number.cast("bigint")
    letter = lambda x: F.char(F.pmod(x, F.lit(26)) + 65)
    one, two, three = n - 1, n - 27, n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def address(row: Column, column: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def address_row(a: Column) -> Column:
    """The row of an address; malformed ones go last."""
    return F.when(F.upper(a).rlike(ADDRESS), F.regexp_extract(F.upper(a), ADDRESS, 2).try_cast("bigint")).otherwise(F.lit(LAST).cast("bigint"))


def address_column(a: Column) -> Column:
    return F.when(F.upper(a).rlike(ADDRESS), column_number(F.regexp_extract(F.upper(a), ADDRESS, 1))).otherwise(F.lit(LAST).cast("bigint"))


def order_key(sheet: Column, a: Column) -> list[Column]:
    """Sheets by code point, then row, column and text of the address."""
    return [sheet, address_row(a), address_column(a), a]


def equality_key(kind: Column, text: Column) -> Column:
    """A string that is equal for equal typed values: an integral number is one whatever it is written as.

    Booleans equal booleans only, text equals text only, an empty text is a value.
    """
    integral = text.rlike(r"^[+-]?\d+(\.0*)?$")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0*$", ""), r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    number = F.when(text.rlike(r"^(0|-?[1-9]\d*)$"), text).when(integral, F.when(whole == "-0", "0").otherwise(whole)).otherwise(text.try_cast("double").cast("string"))
    return F.concat(kind, F.lit(":"), F.when(kind == "num", number).otherwise(text))


def to_cells(table: DataFrame, sheet: str, keys: list[str], columns: list[str]) -> DataFrame:
    """A table as cells (sheet, row, column, kind, text, key): keys give the row, the order of columns the letter.

    keys is one integer column, or a total order to number the rows by.
    """
    kinds = {"string": "str", "boolean": "bool", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date"}
    types = dict(table.dtypes)
    values = F.array(*[F.struct(F.lit(i).alias("column"), F.lit(kinds.get(types[c], "num")).alias("kind"), F.col(c).cast("string").alias("text")) for i, c in enumerate(columns, 1)])
    cells = table.select(F.col(keys[0]).cast("bigint").alias("row"), F.explode(values).alias("cell")).select(F.lit(sheet).alias("sheet"), "row", "cell.*").filter("text is not null")
    return cells.withColumn("key", equality_key(F.col("kind"), F.col("text")))
