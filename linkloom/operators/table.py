"""Links on columns and rows of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.plans import expr
from linkloom.plans.base import ROW_ID, ColumnLink, Context, Link, c, empty_table, fresh, register
from linkloom.plans.rows import order_of, with_row_id


def _require(df: DataFrame, columns: list[str], who: str) -> None:
    missing = [n for n in columns if n not in df.columns]
    if missing:
        raise KeyError(f"{who}: no columns {missing}; there are {df.columns}")


@register
@dataclass
class NullLink(Link):
    """Returns its input."""

    name: str = "NullLink"
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        return df


@register
@dataclass
class DropColumns(Link):
    """Drops columns."""

    columns: list[str] = field(default_factory=list)
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        _require(df, self.columns, "DropColumns")
        gone = set(self.columns)
        return df.select(*(c(n) for n in df.columns if n not in gone))


@register
@dataclass
class KeepColumns(Link):
    """Keeps columns, in the order given."""

    columns: list[str] = field(default_factory=list)
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        _require(df, self.columns, "KeepColumns")
        return df.select(*(c(n) for n in self.columns), *(c(n) for n in ctx.carried(df)))


@register
@dataclass
class RenameColumns(Link):
    """Renames columns, all at once; unknown names are passed over."""

    columns: dict[str, str] = field(default_factory=dict)
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.columns:
            self.logger.warning("no columns to rename")
            return df
        new = [self.columns.get(n, n) for n in df.columns]
        if len(set(new)) < len(new):
            raise ValueError(f"RenameColumns would make duplicate names: {sorted({n for n in new if new.count(n) > 1})}")
        return df.select(*(c(n).alias(m) for n, m in zip(df.columns, new)))


@register
@dataclass
class DropTable(Link):
    """Ends a branch that exists for its side effects: no rows, no columns."""

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        return empty_table(df)


@register
@dataclass
class DropDuplicates(Link):
    """Keeps the first row of each key; missing values are equal.

    First in input order, or by order_by.  Without columns nothing is dropped."""

    columns: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.columns:
            self.logger.warning("no columns to find duplicates by")
            return df
        _require(df, [*self.columns, *self.order_by], "DropDuplicates")
        rows = df if self.order_by else with_row_id(df)
        key = [_nan_as_null(rows, n) for n in self.columns]
        flag = [c(ctx.keep)] if ctx.keep else []  # rows that are gone are first of none
        place = F.row_number().over(Window.partitionBy(*(c(n) for n in ctx.scope), *flag, *key).orderBy(*order_of(rows, self.order_by)))
        (tmp,) = fresh(rows, "__place__")
        out = ctx.where(rows.withColumn(tmp, place), F.col(tmp) == 1).drop(tmp)
        return out.drop(ROW_ID) if ctx.keep and ROW_ID not in df.columns else out

    @property
    def flags_rows(self) -> bool:
        return True


def _nan_as_null(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.nanvl(c(name), F.lit(None).cast(kind)) if kind in ("float", "double") else c(name)


@register
@dataclass
class Query(Link):
    """Keeps the rows that meet a condition."""

    query: str = ""
    row_local = True

    def reads(self) -> set[str] | None:
        """Names that the condition mentions."""
        import ast

        text, names = expr._masked(self.query)
        found = {n.id for n in ast.walk(ast.parse(text.strip(), mode="eval")) if isinstance(n, ast.Name)}
        return None if "index" in found else {names.get(n, n) for n in found}

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.query:
            self.logger.warning("an empty query keeps all rows")
            return df
        return ctx.where(df, *expr.condition(df, self.query))


@register
@dataclass
class DfEval(Link):
    """Computes columns: eval_str into out_column, or assignments line by line."""

    eval_str: str
    out_column: str = ""
    row_local = True

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        compiler = expr.Compiler(df)
        if self.out_column:
            return df.withColumn(self.out_column, compiler.value(self.eval_str).col)
        made = dict(compiler.assignments(self.eval_str))
        return df.withColumns({n: v.col for n, v in made.items()})


@register
@dataclass
class RowEval(ColumnLink):
    """Computes out_column from an expression of `row.<column>`; failing rows get an error."""

    eval_str: str
    out_column: str

    def _compiled(self, df: DataFrame) -> tuple[Column, list[Column]]:
        compiler = expr.Compiler(df, row=True)
        return compiler.value(self.eval_str).col, compiler.fails

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: self._compiled(df)[0]}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(f, "TypeError: a missing value can't be added to a string") for f in self._compiled(df)[1]]
