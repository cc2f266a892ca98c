"""Small model links, also an example of own ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.plans.base import ColumnLink, Context, InColumn, Link, append_errors, c, fresh, register


def _number(df: DataFrame, name: str) -> tuple[Column, Column]:
    """A column as double, and where that fails. In a numeric column missing is no failure."""
    x = c(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(False)
    value = F.trim(x.cast("string")).try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double")), value.isNull()


@register
@dataclass
class LinearModelRow(ColumnLink):
    """y = slope * x + bias, row by row."""

    slope: float
    bias: float
    in_column: InColumn = "x"
    out_column: str = "y"

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: F.lit(float(self.slope)) * _number(df, self.in_column)[0] + F.lit(float(self.bias))}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        shown = F.coalesce(c(self.in_column).cast("string"), F.lit("None"))
        return [(_number(df, self.in_column)[1], F.concat(F.lit("ValueError: could not convert to a number: "), shown))]


@register
@dataclass
class LinearModelDf(Link):
    """y = slope * x + bias over the table; rows that are no number get an error."""

    slope: float
    bias: float
    in_column: InColumn = "x"
    out_column: str = "y"
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        value, _ = _number(df, self.in_column)
        (failed,) = fresh(df, "__failed__")
        out = df.withColumns({self.out_column: F.lit(float(self.slope)) * value + F.lit(float(self.bias)), failed: value.isNull()})
        return append_errors(out, F.when(F.col(failed), F.lit(f"Error in {self.in_column} row data"))).drop(failed)
