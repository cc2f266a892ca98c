"""Links: declarative DataFrame -> DataFrame steps that describe themselves.

A link's parameters are its dataclass fields.  `link(df)` checks the columns
it needs and compiles it into the DataFrame's plan; nothing runs but sinks.
Links add up to a Chain, which is a link.  Row links carry errors of single
rows in `__error__` instead of failing the job.
"""

from __future__ import annotations

import dataclasses
import logging
import typing
from dataclasses import dataclass, field
from typing import Annotated, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "0.1.0"
ERROR, LOG, ROW_ID = "__error__", "__log__", "__row_id__"


class _In:
    """Marks a field that names a column which must be there."""


InColumn = Annotated[str, _In]
OutColumn = str

_REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    """Make a link class known to configurations and the toolbox."""
    _REGISTRY[cls.__name__] = cls
    return cls


def registered() -> dict[str, type]:
    return dict(_REGISTRY)


@dataclass
class Context:
    """What links share while one plan is compiled."""

    scope: list[str] = field(default_factory=list)  # pieces: operators across rows stay within them
    hidden: list[str] = field(default_factory=list)  # columns that projections must carry along
    keep: str | None = None  # filters set this flag instead of dropping rows
    dry: bool = False  # nothing is written

    def visible(self, df: DataFrame) -> list[str]:
        out = {*self.hidden, *self.scope, ROW_ID, *([self.keep] if self.keep else [])}
        return [c for c in df.columns if c not in out]

    def carried(self, df: DataFrame) -> list[str]:
        seen = set(self.visible(df))
        return [c for c in df.columns if c not in seen]

    def where(self, df: DataFrame, condition: Column, loose: Column | None = None) -> DataFrame:
        """Rows that meet a condition; loose is the same for filters, where null is false."""
        if self.keep is None:
            return df.where(condition if loose is None else loose)
        return df.withColumn(self.keep, F.col(self.keep) & condition)


def c(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of df's, case aside."""
    taken, out = {n.lower() for n in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stable(df: DataFrame) -> DataFrame:
    """df for several readers, who must see the same rows: a checkpoint where the
    cluster names a folder for them, else a cached table."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def empty_table(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], T.StructType([]))


def is_no_table(df: DataFrame) -> bool:
    return not df.columns


class Configurable:
    @classmethod
    def tooltip(cls) -> str:
        return (cls.__doc__ or "").strip().split("\n")[0]

    def set_log_level(self, level: str | int) -> None:
        self.log_level = logging.getLevelName(level) if isinstance(level, int) else level
        self.logger.setLevel(level)
        for child in self.children():
            child.set_log_level(level)

    log_level = "WARNING"

    @property
    def logger(self) -> logging.Logger:
        return logging.getLogger(f"linkloom.{type(self).__name__}")

    def children(self) -> list[Link]:
        return []

    def get_params(self, defaults: bool = True, version: bool = True, log_level: bool = True) -> dict[str, Any]:
        """Plain description from which `from_params` builds an equal link."""

        def plain(x: Any) -> Any:
            if isinstance(x, Configurable):
                return x.get_params(defaults, False, False)
            if isinstance(x, (list, tuple)):
                return [plain(y) for y in x]
            if isinstance(x, (set, frozenset)):
                return [plain(y) for y in sorted(x)]
            if isinstance(x, dict):
                return {k: plain(v) for k, v in x.items()}
            return x

        out: dict[str, Any] = {}
        if version:
            out["__version__"] = VERSION
        if log_level:
            out["__loglevel__"] = self.log_level
        out["__class__"] = type(self).__name__
        for f in dataclasses.fields(self):
            if not f.init:
                continue
            value = plain(getattr(self, f.name))
            usual = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else dataclasses.MISSING
            if defaults or usual is dataclasses.MISSING or plain(usual) != value:
                out[f.name] = value
        return out

    @staticmethod
    def from_params(params: dict[str, Any]) -> Link:
        params = dict(params)
        version, level = params.pop("__version__", VERSION), params.pop("__loglevel__", None)
        if version != VERSION:
            logging.getLogger("linkloom").warning("configuration of version %s, this is %s", version, VERSION)
        name = params.pop("__class__").rpartition(".")[2]
        if name not in _REGISTRY:
            raise ValueError(f"no link named {name} is registered")

        def built(x: Any) -> Any:
            if isinstance(x, dict):
                return Configurable.from_params(x) if "__class__" in x else {k: built(v) for k, v in x.items()}
            return [built(y) for y in x] if isinstance(x, list) else x

        link = _REGISTRY[name](**{k: built(v) for k, v in params.items()})
        if level is not None:
            link.set_log_level(level)
        return link

    def to_config_file(self, path: str) -> None:
        from .config import save_chain

        save_chain(self, path)

    @staticmethod
    def from_config_file(path: str) -> Link:
        from .config import load_chain

        return load_chain(path)


class Link(Configurable):
    """A table step. Subclasses are dataclasses and implement compile."""

    #: each output row depends on one input row only
    row_local = False

    @property
    def flags_rows(self) -> bool:
        """Rows only change or go, and with Context.keep they get a flag instead of going."""
        return self.row_local

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        ctx = ctx or Context()
        self.assert_incolumns(df)
        return self.compile(df, ctx)

    def __call__(self, df: DataFrame) -> DataFrame:
        had = ROW_ID in df.columns
        out = self.apply(df)
        return out if had or ROW_ID not in out.columns else out.drop(ROW_ID)

    def output_schema(self, schema: T.StructType, spark) -> T.StructType:
        """Schema of the result; sinks write nothing for it."""
        ctx = Context(dry=True)
        out = self.apply(spark.createDataFrame([], schema), ctx)
        return out.schema if ROW_ID in schema.names or ROW_ID not in out.columns else out.drop(ROW_ID).schema

    def in_columns(self) -> list[str]:
        kinds = typing.get_type_hints(type(self), include_extras=True)
        return [getattr(self, f.name) for f in dataclasses.fields(self) if _In in getattr(kinds.get(f.name), "__metadata__", ())]

    def assert_incolumns(self, df: DataFrame) -> None:
        for name in self.in_columns():
            assert name in df.columns, f"{type(self).__name__} needs a column {name!r}; there are {df.columns}"

    def __add__(self, other: Any) -> Link:
        if isinstance(other, Link):
            return Chain([*_flat(self), *_flat(other)])
        return self if not other else NotImplemented

    def __radd__(self, other: Any) -> Link:
        return self if not other else NotImplemented


def _flat(link: Link) -> list[Link]:
    return list(link.links) if isinstance(link, Chain) else [link]


def append_to_column(df: DataFrame, column: str, text: Column) -> DataFrame:
    """Joins text to what the column holds, on a line of its own; nulls add nothing."""
    old = c(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.nullif(F.concat_ws("\n", old, text), F.lit("")))


def append_errors(df: DataFrame, text: Column) -> DataFrame:
    return append_to_column(df, ERROR, text)


def append_log(df: DataFrame, text: Column) -> DataFrame:
    return append_to_column(df, LOG, text)


class ColumnLink(Link):
    """A row step made of expressions; it skips rows that have an error."""

    row_local = True

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def sets(self) -> set[str] | None:
        """The columns it sets, where that is known without a table."""
        return {self.out_column} if hasattr(self, "out_column") else None

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        """Conditions under which a row fails, and the messages."""
        return []

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        old = c(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
        failed = F.coalesce(*(F.when(cond, msg if isinstance(msg, Column) else F.lit(msg)) for cond, msg in self.errors(df)), F.lit(None).cast("string"))
        error = F.coalesce(F.nullif(old, F.lit("")), failed)
        out = {}
        for name, value in self.exprs(df).items():
            before = c(name) if name in df.columns else None
            if before is not None and df.select(before).schema[0].dataType != df.select(value).schema[0].dataType:
                before = None
            out[name] = F.when(error.isNull(), value).otherwise(F.lit(None) if before is None else before)
        return df.withColumns(out | {ERROR: error})


class RowLogger:
    """Collects a row's log lines of at least the link's level."""

    def __init__(self, level: str):
        self.level, self.lines = logging.getLevelName(level), []

    def _add(self, level: str, message: str) -> None:
        if logging.getLevelName(level) >= self.level:
            self.lines.append(f"{level}: {message}")

    def debug(self, message: str) -> None:
        self._add("DEBUG", message)

    def info(self, message: str) -> None:
        self._add("INFO", message)

    def warning(self, message: str) -> None:
        self._add("WARNING", message)

    def error(self, message: str) -> None:
        self._add("ERROR", message)

    def critical(self, message: str) -> None:
        self._add("CRITICAL", message)


class RowLink(Link):
    """A row step in Python: row_apply(row) gets and returns a dict.

    output() declares the columns it sets, as DDL; needs() those it reads
    (None: all).  An exception becomes the row's error.  Adjacent row links
    are fused into one Arrow function."""

    row_local = True

    def output(self) -> str:
        raise NotImplementedError

    def needs(self) -> list[str] | None:
        return None

    def sets(self) -> set[str] | None:
        return set(T.StructType.fromDDL(self.output()).names)

    def row_apply(self, row: dict, log: RowLogger) -> dict:
        raise NotImplementedError

    def bind(self, spark) -> None:
        """Called on the driver when a plan is made."""

    def prepare(self) -> None:
        """Called once a batch, before its rows."""

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        return compile_rows([self], df, ctx)

    def run(self, columns: dict[str, list], errors: list[str | None], lines: list[list[str]]) -> None:
        """Applies the link to a batch, in place; rows that have an error are passed over."""
        for i, error in enumerate(errors):
            if error:
                continue
            log = RowLogger(self.log_level)
            try:
                for n, value in self.row_apply({n: v[i] for n, v in columns.items()}, log).items():
                    columns.setdefault(n, [None] * len(errors))[i] = _present(value)
            except Exception as e:  # noqa: BLE001  a row's failure is its own
                errors[i] = f"{type(e).__name__}: {e}"
            lines[i] += log.lines


class BatchLink(RowLink):
    """A row step in Python over whole batches: batch_apply(columns) gets lists of
    values by column, of rows without error, and returns the lists it sets.

    If a batch fails its rows are tried one by one, so an exception becomes the
    error of the rows that cause it."""

    def batch_apply(self, columns: dict[str, list], log: RowLogger) -> dict[str, list]:
        raise NotImplementedError

    def run(self, columns: dict[str, list], errors: list[str | None], lines: list[list[str]]) -> None:
        good = [i for i, error in enumerate(errors) if not error]

        def attempt(rows: list[int]) -> None:
            log = RowLogger(self.log_level)
            found = self.batch_apply({n: [v[i] for i in rows] for n, v in columns.items()}, log)
            for n, values in found.items():
                if len(values) != len(rows):
                    raise ValueError(f"{type(self).__name__} made {len(values)} values of {n} for {len(rows)} rows")
            for n, values in found.items():
                column = columns.setdefault(n, [None] * len(errors))
                for i, value in zip(rows, values):
                    column[i] = _present(value)
            for i in rows:
                lines[i] += log.lines

        try:
            if good:
                attempt(good)
        except Exception:  # noqa: BLE001  which rows it is shows one by one
            for i in good:
                try:
                    attempt([i])
                except Exception as e:  # noqa: BLE001
                    errors[i] = f"{type(e).__name__}: {e}"


def _present(x: Any) -> Any:
    return None if isinstance(x, float) and x != x else x


def compile_rows(links: list[RowLink], df: DataFrame, ctx: Context) -> DataFrame:
    """One Arrow function for a run of row links."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields: dict[str, T.StructField] = {}
    for link in links:
        link.bind(df.sparkSession)
        for f in T.StructType.fromDDL(link.output()):
            fields[f.name] = T.StructField(f.name, f.dataType, True)
    needs: list[str] = []
    for link in links:
        wanted = link.needs()
        needs += [n for n in (ctx.visible(df) if wanted is None else wanted) if n not in needs and n in df.columns]
    for n in fields:  # values that an error leaves in place
        if n in df.columns and n not in needs and df.schema[n].dataType == fields[n].dataType:
            needs.append(n)
    result = T.StructType([*fields.values(), T.StructField(ERROR, T.StringType()), T.StructField(LOG, T.StringType())])
    names = list(fields)
    old_error = c(ERROR) if ERROR in df.columns else F.lit(None).cast("string")
    row_in = F.struct(*(c(n).alias(f"c{i}") for i, n in enumerate(needs)), old_error.alias("e"))
    arrow = to_arrow_type(result)

    def kernel(rows: pa.Array) -> pa.Array:
        for link in links:
            link.prepare()
        fields = rows.flatten()
        columns = {n: [_present(x) for x in fields[i].to_pylist()] for i, n in enumerate(needs)}
        errors = [e or None for e in fields[-1].to_pylist()]
        lines: list[list[str]] = [[] for _ in errors]
        for link in links:
            link.run(columns, errors, lines)
        made = [columns.get(n, [None] * len(errors)) for n in names]
        logs = ["\n".join(x) or None for x in lines]
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip([*made, errors, logs], arrow)], fields=list(arrow))

    call = F.arrow_udf(kernel, result)
    # not deterministic for the optimizer: it must not run a kernel twice
    (tmp,) = fresh(df, "__kernel__")
    made = df.withColumn(tmp, call.asNondeterministic()(row_in))
    logs = F.nullif(F.concat_ws("\n", c(LOG) if LOG in df.columns else F.lit(None).cast("string"), F.col(f"{tmp}.{LOG}")), F.lit(""))
    any_log = LOG in df.columns or any(getattr(link, "logs", False) for link in links)
    made = made.withColumns({n: F.col(tmp)[n] for n in names} | {ERROR: F.col(tmp)[ERROR]} | ({LOG: logs} if any_log else {}))
    return made.drop(tmp)


@register
@dataclass
class Chain(Link):
    """Links one after another."""

    links: list[Link]

    def __post_init__(self) -> None:
        self.links = list(self.links)

    @property
    def row_local(self) -> bool:
        return all(link.row_local for link in self.links)

    @property
    def flags_rows(self) -> bool:
        return all(link.flags_rows for link in self.links)

    def children(self) -> list[Link]:
        return self.links

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        return self.compile(df, ctx or Context())

    def in_columns(self) -> list[str]:
        return []

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        links, i = self._hoisted(), 0
        while i < len(links):
            run = []
            while i + len(run) < len(links) and isinstance(links[i + len(run)], RowLink):
                run.append(links[i + len(run)])
            if len(run) > 1:
                made = set(df.columns)
                for link in run:
                    missing = [n for n in link.in_columns() if n not in made]
                    assert not missing, f"{type(link).__name__} needs columns {missing}"
                    made |= set(T.StructType.fromDDL(link.output()).names)
                df = compile_rows(run, df, ctx)
                i += len(run)
            else:
                df = links[i].apply(df, ctx)
                i += 1
        return df

    def _hoisted(self) -> list[Link]:
        """Filters move before row steps whose columns they don't read."""
        from linkloom.operators.table import Query

        links: list[Link] = []
        for link in self.links:
            links.extend(link._hoisted() if isinstance(link, Chain) else [link])
        for i, link in enumerate(links):
            j = i
            while isinstance(link, Query) and link.query and j and isinstance(links[j - 1], (RowLink, ColumnLink)):
                reads, sets = link.reads(), links[j - 1].sets()
                if reads is None or sets is None or reads & {*sets, ERROR, LOG}:
                    break
                links[j - 1 : j + 1] = [links[j], links[j - 1]]
                j -= 1
        return links


@register
@dataclass
class UnionLink(Link):
    """Two branches of one input, merged row by row with the left one first.

    Rows are those of either branch; each cell is the left branch's unless it
    is missing there.  Branches of projections and filters become one
    projection; others meet in a join on the row id."""

    link1: Link
    link2: Link

    @property
    def row_local(self) -> bool:
        return False

    @property
    def row_local_branches(self) -> bool:
        return self.link1.row_local and self.link2.row_local

    def children(self) -> list[Link]:
        return [self.link1, self.link2]

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.link1.flags_rows and self.link2.flags_rows and not ctx.hidden and ctx.keep is None:
            if not self.row_local_branches and ROW_ID not in df.columns:
                df = df.withColumn(ROW_ID, F.monotonically_increasing_id())  # one order for both branches
            return self._one_pass(df, ctx)
        if ROW_ID not in df.columns:
            df = stable(df.withColumn(ROW_ID, F.monotonically_increasing_id()))
        left, right = self.link1.apply(df, ctx), self.link2.apply(df, ctx)
        if is_no_table(right):
            return left
        if is_no_table(left):
            return right
        columns = self._columns(ctx.visible(left), ctx.visible(right))
        carried = [ROW_ID, *ctx.scope]
        a = left.select(*(c(n).alias(f"l{i}") for i, n in enumerate([*carried, *columns]) if n in left.columns))
        b = right.select(*(c(n).alias(f"r{i}") for i, n in enumerate([*carried, *columns]) if n in right.columns))
        both = a.join(b, F.col("l0") == F.col("r0"), "full_outer")
        return both.select(*(F.coalesce(*(F.col(s) for s in (f"l{i}", f"r{i}") if s in both.columns)).alias(n) for i, n in enumerate([*carried, *columns])))

    @staticmethod
    def _columns(left: list[str], right: list[str]) -> list[str]:
        return left if set(left) == set(right) else sorted({*left, *right})

    def _one_pass(self, df: DataFrame, ctx: Context) -> DataFrame:
        names, carried = ctx.visible(df), ctx.carried(df)
        whole = [c(n) for n in carried]
        first, second, keep, kept = fresh(df, "__in__", "__left__", "__keep__", "__kept__")
        inner = Context(scope=ctx.scope, hidden=[first, second], keep=keep, dry=ctx.dry)
        rows = df.select(*whole, F.struct(*(c(n) for n in names)).alias(first), *(c(n) for n in names), F.lit(True).alias(keep))
        left = self.link1.apply(rows, inner)
        lnames = inner.visible(left)
        again = left.select(*whole, F.struct(F.col(keep).alias(kept), *(c(n) for n in lnames)).alias(second), first)
        again = again.select(*whole, second, first, *(F.col(first)[n].alias(n) for n in names), F.lit(True).alias(keep))
        right = self.link2.apply(again, inner)
        rnames = inner.visible(right)
        keep1, keep2 = F.col(second)[kept], F.col(keep)

        def merged(n: str) -> Column:
            parts = [F.when(keep1, F.col(second)[n])] if n in lnames else []
            parts += [F.when(keep2, c(n))] if n in rnames else []
            return F.coalesce(*parts).alias(n)

        return right.where(keep1 | keep2).select(*whole, *(merged(n) for n in self._columns(lnames, rnames)))
