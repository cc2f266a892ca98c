"""CSV sources and sinks as links."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.plans.base import ROW_ID, Context, Link, c, is_no_table, register, stable

# Strings that read as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
_TYPES = {"int": "long", "int64": "long", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "object": "string", "string": "string", "bool": "boolean"}
_SAME = {"encoding": "encoding", "quotechar": "quote", "escapechar": "escape", "comment": "comment"}


def _dialect(options: dict[str, Any]) -> dict[str, str]:
    return {"escape": str(options.get("quotechar", '"'))}


def read_csv(spark: SparkSession, path: str, options: dict[str, Any]) -> DataFrame:
    """sep, delimiter, header, names, usecols, dtype, nrows, na_values, encoding, quotechar, escapechar, comment, schema, multiline.

    A quote within quotes is doubled unless escapechar is given.  Quoted values
    may hold line ends; with multiline=False they may not, and one file is read
    by many tasks."""
    options = dict(options)
    conf = _dialect(options) | {"header": "true", "sep": str(options.pop("sep", options.pop("delimiter", ","))), "nullValue": "", "multiLine": str(bool(options.pop("multiline", True))).lower()}
    if options.pop("header", 0) is None:
        conf["header"] = "false"
    for name, spark_name in _SAME.items():
        if name in options:
            conf[spark_name] = options.pop(name)
    names, wanted, kinds = options.pop("names", None), options.pop("usecols", None), options.pop("dtype", None)
    rows, missing, schema = options.pop("nrows", None), options.pop("na_values", []), options.pop("schema", None)
    if options:
        raise ValueError(f"unknown read options: {sorted(options)}")
    reader = spark.read.options(**conf)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if names:
        df = df.toDF(*names)
    if wanted is not None:
        df = df.select(*(c(n) for n in wanted))
    if not schema:
        tokens = [*NA_TOKENS, *([missing] if isinstance(missing, str) else missing)]
        df = df.select(*(F.when(~c(n).isin(tokens), c(n)).alias(n or "Unnamed: 0") for n in df.columns))
        df = _typed(df, kinds if isinstance(kinds, dict) else dict.fromkeys(df.columns, kinds) if kinds else {})
    return df.limit(int(rows)) if rows is not None else df


def _typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns as long, double or boolean where all their values are."""
    free = [n for n in df.columns if n not in kinds]
    fits = {}
    if free:
        checks = []
        for i, n in enumerate(free):
            for kind in ("long", "double", "boolean"):
                ok = F.lower(c(n)).isin("true", "false") if kind == "boolean" else c(n).try_cast(kind).isNotNull() & (F.rlike(c(n), F.lit(r"^\s*[+-]?\d+\s*$")) if kind == "long" else F.lit(True))
                checks.append(F.coalesce(F.bool_and(F.when(c(n).isNotNull(), ok)), F.lit(False)).alias(f"{kind}{i}"))
        row = df.agg(*checks).first()
        fits = {n: next((k for k in ("long", "double", "boolean") if row[f"{k}{i}"]), "string") for i, n in enumerate(free)}
    kind_of = lambda n: _TYPES.get(str(kinds[n]), str(kinds[n])) if n in kinds else fits[n]
    return df.select(*(c(n).cast(kind_of(n)).alias(n) for n in df.columns))


def write_csv(df: DataFrame, path: str, options: dict[str, Any]) -> None:
    """A folder of part files. sep, header, index, columns, na_rep, encoding, quotechar, escapechar, mode, single_file."""
    options = dict(options)
    conf = _dialect(options) | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    conf |= {"sep": str(options.pop("sep", ",")), "header": str(bool(options.pop("header", True))).lower(), "nullValue": str(options.pop("na_rep", "")), "emptyValue": ""}
    for name, spark_name in _SAME.items():
        if name in options and name != "comment":
            conf[spark_name] = options.pop(name)
    columns, index, mode, single = options.pop("columns", None), options.pop("index", False), options.pop("mode", "overwrite"), options.pop("single_file", False)
    if options:
        raise ValueError(f"unknown write options: {sorted(options)}")
    if index and ROW_ID not in df.columns:
        df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    visible = columns or [n for n in df.columns if n != ROW_ID]
    simple = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    shown = [F.to_json(c(n)).alias(n) if isinstance(df.schema[n].dataType, simple) and not isinstance(df.schema[n].dataType, T.BinaryType) else c(n) for n in visible]
    out = df.select(*([c(ROW_ID).alias("index")] if index else []), *shown)
    (out.coalesce(1) if single else out).write.mode({"w": "overwrite", "a": "append"}.get(mode, mode)).options(**conf).csv(path)


@register
@dataclass
class FromFile(Link):
    """Reads a CSV file in place of the incoming table."""

    filename: str
    read_options: dict[str, Any] = field(default_factory=lambda: {"sep": ","})

    def __call__(self, df: DataFrame | None = None) -> DataFrame:
        if df is None:
            return read_csv(SparkSession.active(), self.filename, self.read_options)
        return super().__call__(df)

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not is_no_table(df):
            self.logger.warning("the incoming table is replaced by %s", self.filename)
        return read_csv(df.sparkSession, self.filename, self.read_options)


@register
@dataclass
class ToFile(Link):
    """Writes the table as CSV and passes it on."""

    filename: str
    write_options: dict[str, Any] = field(default_factory=lambda: {"sep": ","})

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if ctx.dry:
            return df
        df = stable(df)  # read by the sink and by what follows
        write_csv(df.select(*(c(n) for n in ctx.visible(df))), self.filename, self.write_options)
        return df
