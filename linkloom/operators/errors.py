"""Errors of rows: predicates, the splitter, context managers."""

from __future__ import annotations

import contextlib
import io
import traceback
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.plans.base import ERROR, Context, Link, c, register, stable


def has_error(row: Any) -> bool:
    """Whether a row (mapping or Row) carries an error."""
    value = row.asDict().get(ERROR) if hasattr(row, "asDict") else row.get(ERROR)
    return bool(value) and value == value


def error_condition(df: DataFrame) -> Column:
    return F.coalesce(F.length(c(ERROR)) > 0, F.lit(False)) if ERROR in df.columns else F.lit(False)


def rows_with_errors(df: DataFrame, aslist: bool = False) -> DataFrame | list[bool]:
    """One column, has_error; as a list only for tables that fit the driver."""
    if not isinstance(aslist, bool):
        raise ValueError("aslist must be True or False")
    mask = df.select(error_condition(df).alias("has_error"))
    return [r[0] for r in mask.collect()] if aslist else mask


@register
@dataclass
class StripErrors(Link):
    """Rows without error go on; those with one are in error_df, and in filename if given."""

    filename: str | None = None

    def __post_init__(self) -> None:
        self.error_df: DataFrame | None = None

    @property
    def has_errors(self) -> bool:
        return self.error_df is not None and bool(self.error_df.columns) and not self.error_df.isEmpty()

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if ERROR not in df.columns:
            self.error_df = df.where(F.lit(False))
            return df
        bad, sink = error_condition(df), self.filename and not ctx.dry
        if sink:
            df = stable(df)  # three consumers
        self.error_df = df.where(bad)
        if sink and self.has_errors:
            from linkloom.sources.files import write_csv

            write_csv(self.error_df, self.filename, {})
        return df.where(~bad).drop(ERROR)


class ErrorContextManager:
    """Captures stderr and swallows an exception into `.errors`."""

    swallow = True

    def __enter__(self) -> ErrorContextManager:
        self.errors, self._stream = "", io.StringIO()
        self._redirect = contextlib.redirect_stderr(self._stream)
        self._redirect.__enter__()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, tb: Any) -> bool:
        self._redirect.__exit__(None, None, None)
        self.errors = self._stream.getvalue()
        if error is not None and self.swallow:
            self.errors += "".join(traceback.format_exception_only(kind, error))
            return isinstance(error, Exception)
        return False


class StderrContextManager(ErrorContextManager):
    """Captures stderr; exceptions go on."""

    swallow = False
