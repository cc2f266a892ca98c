"""Queries of the links over the driver's tables, and the SQL they must equal."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.chem import ElementsInList, HeavyAtomCount, HeteroAtomRatio, LongestAliphaticChain, MolFromSmiles, MolToSmiles, NumberOfTokens, PandasAddMoleculeColumn, RDKitDescriptors, RemoveStereoMol, RemoveStereoSmiles, SuperParent
from linkloom.operators.custom import LinearModelDf, LinearModelRow
from linkloom.operators.errors import StripErrors, rows_with_errors
from linkloom.operators.model import ScikitMolSmilesModel
from linkloom.operators.partition import ParallelPartitionProcessor, SerialPartitionProcessor
from linkloom.operators.table import DfEval, DropColumns, DropDuplicates, DropTable, KeepColumns, NullLink, Query, RenameColumns, RowEval
from linkloom.plans import config
from linkloom.plans.base import ERROR, BatchLink, Chain, Configurable, Link, RowLink, RowLogger, UnionLink
from linkloom.sources.files import FromFile, ToFile

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}

# SMILES by part key, with what is known about each:
# heavy atoms, hetero atoms, only allowed elements, longest CH2 chain, parses, tokens, donors, rings
MOLECULES = [
    ("C", 1, 0, True, 0, True, 1, 0, 0),
    ("CN", 2, 1, True, 0, True, 2, 1, 0),
    ("OCN", 3, 2, True, 1, True, 3, 2, 0),
    ("c1ccccc1", 6, 0, True, 0, True, 8, 0, 1),
    ("c1ccccc1CN", 8, 1, True, 1, True, 10, 1, 1),
    ("C[C@](N)(O)Cl", 5, 3, True, 0, True, 9, 2, 0),
    ("CCCCCCC", 7, 0, True, 5, True, 7, 0, 0),
    ("CC(=O)[O-].[Na+]", 5, 3, False, 0, True, 9, 0, 0),
    ("FC(F)(F)CCBr", 7, 4, True, 2, True, 11, 0, 0),
    ("ImNotASmiles", 0, 0, False, 0, False, 0, 0, 0),
    ("C1CC", 0, 0, False, 0, False, 4, 0, 0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, source: str, sql: str, columns: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Registers a link (made anew for each run) over a table, with its SQL."""

    def add(make: Callable[[], Link]) -> Callable[[], Link]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = table(spark, sf_dir, source)
            df = prepare(df) if prepare else df
            return make()(df.select(*columns) if columns else df)

        QUERIES[name], ORACLE_SQL[name] = run, sql
        return make

    return add


def molecules(df: DataFrame) -> DataFrame:
    """p_partkey, Smiles."""
    names = F.array(*(F.lit(m[0]) for m in MOLECULES))
    return df.select("p_partkey", F.element_at(names, F.pmod("p_partkey", F.lit(len(MOLECULES))).cast("int") + 1).alias("Smiles"))


def _known(field: int, kind: str, only_parsed: bool = True) -> str:
    """SQL for a fact of MOLECULES by part key."""
    cases = " ".join(f"WHEN {i} THEN {m[field]}" for i, m in enumerate(MOLECULES) if m[5] or not only_parsed)
    return f"CAST(CASE p_partkey % {len(MOLECULES)} {cases} END AS {kind})"


_SMILES = f"(CASE p_partkey % {len(MOLECULES)} " + " ".join(f"WHEN {i} THEN '{m[0]}'" for i, m in enumerate(MOLECULES)) + " END)"
_PARSED = _known(5, "BOOLEAN", False)
_FLAGSHIP = [DfEval("revenue = l_extendedprice * (1 - l_discount)"), Query("l_quantity < 24 and l_discount >= 0.05"), KeepColumns(["l_orderkey", "l_linenumber", "l_quantity", "revenue"])]
_FLAGSHIP_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05"


@query("chain_flagship", "lineitem", _FLAGSHIP_SQL)
def _() -> Link:
    return Chain(_FLAGSHIP)


@query("config_roundtrip", "lineitem", _FLAGSHIP_SQL)
def _() -> Link:
    return Configurable.from_params(Chain(_FLAGSHIP).get_params())


@query("sum_of_links", "lineitem", _FLAGSHIP_SQL)
def _() -> Link:
    return sum(_FLAGSHIP)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]
_LINE_SQL = ", ".join(_LINE)
_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ORDER_SQL = ", ".join(_ORDER)

for _name, _source, _cols, _text, _where in [
    ("query_and", "lineitem", _LINE, "l_quantity > 10 & l_discount <= 0.03", "l_quantity > 10 AND l_discount <= 0.03"),
    ("query_or_not", "lineitem", _LINE, "not (l_quantity > 10) or ~(l_tax < 0.07)", "NOT l_quantity > 10 OR NOT l_tax < 0.07"),
    ("query_in", "orders", _ORDER, "o_orderstatus in ['F', 'P'] and o_custkey not in [1, 2, 3]", "o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)"),
    ("query_chained", "lineitem", _LINE, "5 < l_quantity <= 20", "l_quantity > 5 AND l_quantity <= 20"),
    ("query_backtick", "orders", _ORDER, "`o_totalprice` >= 1000.5 and o_orderstatus == 'O'", "o_totalprice >= 1000.5 AND o_orderstatus = 'O'"),
    ("query_string", "orders", _ORDER, "o_orderpriority.str.contains('URG') or o_orderpriority.str.startswith('5')", "contains(o_orderpriority, 'URG') OR starts_with(o_orderpriority, '5')"),
]:
    query(_name, _source, f"SELECT {', '.join(_cols)} FROM {_source} WHERE {_where}", _cols)(lambda t=_text: Query(t))


def _nulls(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.expr("nullif(event_id % 7, 0)").alias("x"), "event_type")


query("query_missing_ne", "events", "SELECT event_id, nullif(event_id % 7, 0) AS x, event_type FROM events WHERE nullif(event_id % 7, 0) IS DISTINCT FROM 3", prepare=_nulls)(lambda: Query("x != 3"))
query("query_missing_not", "events", "SELECT event_id, nullif(event_id % 7, 0) AS x, event_type FROM events WHERE NOT coalesce(nullif(event_id % 7, 0) < 3, false)", prepare=_nulls)(lambda: Query("not (x < 3)"))
query("query_isnull", "events", "SELECT event_id, nullif(event_id % 7, 0) AS x, event_type FROM events WHERE event_id % 7 = 0", prepare=_nulls)(lambda: Query("x.isnull()"))

query("dfeval_assign", "lineitem", f"SELECT {_LINE_SQL}, l_quantity * 2 + 1 AS y FROM lineitem", _LINE)(lambda: DfEval("y = l_quantity * 2 + 1"))
query("dfeval_multiline", "lineitem", f"SELECT {_LINE_SQL}, l_quantity + l_tax AS a, (l_quantity + l_tax) * 2 AS b FROM lineitem", _LINE)(lambda: DfEval("a = l_quantity + l_tax\nb = a * 2"))
query("dfeval_out_column", "lineitem", f"SELECT {_LINE_SQL}, -l_quantity AS neg FROM lineitem", _LINE)(lambda: DfEval("-l_quantity", "neg"))
query(
    "dfeval_floordiv_mod", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity, floor((l_quantity - 25) / 7.0::DOUBLE) AS d, (l_quantity - 25) - (-7.0::DOUBLE) * floor((l_quantity - 25) / (-7.0::DOUBLE)) AS m FROM lineitem",
    ["l_orderkey", "l_linenumber", "l_quantity"],
)(lambda: DfEval("d = (l_quantity - 25) // 7\nm = (l_quantity - 25) % -7"))
query(
    "dfeval_div_zero", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity / l_tax END AS q FROM lineitem",
    ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"],
)(lambda: DfEval("q = l_quantity / l_tax"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("s", "l", "f", "p")))


def _math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(DfEval("s = sqrt(p_retailprice)\nl = log(p_size)\nf = floor(p_retailprice / 3)\np = p_size ** 2 / 1")(table(spark, sf_dir, "part")))


QUERIES["dfeval_math"] = _math
ORACLE_SQL["dfeval_math"] = "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(CASE WHEN p_size = 0 THEN '-Infinity'::DOUBLE ELSE ln(p_size) END, 6) AS l, round(floor(p_retailprice / 3), 6) AS f, round(p_size * p_size::DOUBLE, 6) AS p FROM part"

query("keep", "nation", "SELECT n_name, n_nationkey FROM nation")(lambda: KeepColumns(["n_name", "n_nationkey"]))
query("drop", "nation", "SELECT n_nationkey, n_name FROM nation")(lambda: DropColumns(["n_regionkey"]))
query("rename", "nation", "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")(lambda: RenameColumns({"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "none": "x"}))
query("null_link", "customer", "SELECT * FROM customer")(lambda: NullLink())
query("drop_duplicates_first", "orders", f"SELECT {_ORDER_SQL} FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", _ORDER)(lambda: DropDuplicates(["o_custkey"], order_by=["o_orderkey"]))
query("drop_duplicates_text", "documents", "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1", ["doc_id", "text"])(lambda: DropDuplicates(["text"], order_by=["doc_id"]))
query("drop_duplicates_no_key", "region", "SELECT * FROM region")(lambda: DropDuplicates([]))

query("linear_model", "events", "SELECT event_id, value, 2.0::DOUBLE * value + 0.5::DOUBLE AS y, CAST(NULL AS VARCHAR) AS __error__ FROM events", ["event_id", "value"])(lambda: LinearModelRow(2.0, 0.5, "value", "y"))


def _strings(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.expr("case event_id % 4 when 0 then 'BAD' when 1 then cast(null as string) else cast(event_id as string) end").alias("x"))


_X = "CASE event_id % 4 WHEN 0 THEN 'BAD' WHEN 1 THEN NULL ELSE CAST(event_id AS VARCHAR) END"


def _flagged(link: Link, prepare: Callable[[DataFrame], DataFrame], source: str, columns: list[str]) -> Run:
    """Result with the error as a flag: its text isn't for SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = link(prepare(table(spark, sf_dir, source)))
        return out.select(*columns, F.col(ERROR).isNotNull().alias("failed"))

    return run


QUERIES["linear_model_errors"] = _flagged(LinearModelRow(3, 1), _strings, "events", ["event_id", "x", "y"])
ORACLE_SQL["linear_model_errors"] = f"SELECT event_id, x, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS y, try_cast(x AS DOUBLE) IS NULL AS failed FROM (SELECT event_id, {_X} AS x FROM events)"
QUERIES["linear_model_table"] = _flagged(LinearModelDf(3, 1), _strings, "events", ["event_id", "x", "y"])
ORACLE_SQL["linear_model_table"] = ORACLE_SQL["linear_model_errors"]
QUERIES["roweval"] = _flagged(RowEval("row.x + row.t", "z"), lambda df: _strings(df).withColumn("t", F.lit("!")), "events", ["event_id", "z"])
ORACLE_SQL["roweval"] = f"SELECT event_id, x || '!' AS z, x IS NULL AS failed FROM (SELECT event_id, {_X} AS x FROM events)"
QUERIES["row_kernel_chain"] = _flagged(Chain([MolFromSmiles(), LongestAliphaticChain(), RDKitDescriptors(descriptors=["NumHDonors", "RingCount"])]), molecules, "part", ["p_partkey", "LongestAliphaticChain", "NumHDonors", "RingCount"])
ORACLE_SQL["row_kernel_chain"] = f'SELECT p_partkey, {_known(4, "INTEGER")} AS "LongestAliphaticChain", {_known(7, "DOUBLE")} AS "NumHDonors", {_known(8, "DOUBLE")} AS "RingCount", NOT {_PARSED} AS failed FROM part'

query("strip_errors", "events", f"SELECT event_id, x, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS y FROM (SELECT event_id, {_X} AS x FROM events) WHERE try_cast(x AS DOUBLE) IS NOT NULL", prepare=_strings)(lambda: LinearModelRow(3, 1) + StripErrors())


def _errors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    strip = StripErrors()
    (LinearModelRow(3, 1) + strip)(_strings(table(spark, sf_dir, "events")))
    return strip.error_df.select("event_id", "x")


QUERIES["errors_only"] = _errors_only
ORACLE_SQL["errors_only"] = f"SELECT event_id, x FROM (SELECT event_id, {_X} AS x FROM events) WHERE try_cast(x AS DOUBLE) IS NULL"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = rows_with_errors(LinearModelRow(3, 1)(_strings(table(spark, sf_dir, "events"))))
    return mask.groupBy("has_error").agg(F.count("*").alias("n"))


QUERIES["error_mask"] = _mask
ORACLE_SQL["error_mask"] = f"SELECT try_cast(x AS DOUBLE) IS NULL AS has_error, count(*) AS n FROM (SELECT {_X} AS x FROM events) GROUP BY 1"

query(
    "union_fast", "orders",
    "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 1000 THEN o_totalprice * 2 END AS a, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS b FROM orders WHERE o_totalprice > 1000 OR o_orderstatus = 'F'",
    _ORDER,
)(lambda: UnionLink(Query("o_totalprice > 1000") + DfEval("a = o_totalprice * 2"), DfEval("b = o_custkey + 1") + Query("o_orderstatus == 'F'")))
query(
    "union_general", "orders",
    "WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 1::BIGINT END AS flag FROM d WHERE n = 1 OR o_orderstatus = 'P'",
    _ORDER,
)(lambda: UnionLink(DropDuplicates(["o_custkey"], order_by=["o_orderkey"]), Query("o_orderstatus == 'P'") + DfEval("1", "flag")))
query("union_droptable", "orders", f"SELECT {_ORDER_SQL} FROM orders WHERE o_custkey < 50", _ORDER)(lambda: UnionLink(Query("o_custkey < 50"), NullLink() + DropTable()))
query("pieces_row_local", "orders", f"SELECT {_ORDER_SQL}, o_custkey * 2 AS k FROM orders", _ORDER)(lambda: ParallelPartitionProcessor(DfEval("k = o_custkey * 2"), num_partitions=4, num_processes=4))
_PIECES = f"SELECT {_ORDER_SQL} FROM (SELECT *, {{piece}} AS piece FROM orders) QUALIFY row_number() OVER (PARTITION BY piece, o_custkey ORDER BY o_orderkey) = 1"
query("pieces_dedup", "orders", _PIECES.format(piece="ntile(4) OVER (ORDER BY o_orderkey)"), _ORDER)(lambda: SerialPartitionProcessor(DropDuplicates(["o_custkey"], order_by=["o_orderkey"]), num_partitions=4, order_by=["o_orderkey"]))
query("pieces_by_size", "orders", "WITH n AS (SELECT count(*) // 400 + 1 AS k, count(*) // (count(*) // 400 + 1) AS s, count(*) % (count(*) // 400 + 1) AS r FROM orders), p AS (SELECT o.*, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders o) " + f"SELECT {_ORDER_SQL} FROM (SELECT p.*, CASE WHEN i < r * (s + 1) THEN i // (s + 1) ELSE r + (i - r * (s + 1)) // s END AS piece FROM p, n) QUALIFY row_number() OVER (PARTITION BY piece, o_custkey ORDER BY o_orderkey) = 1", _ORDER)(lambda: ParallelPartitionProcessor(DropDuplicates(["o_custkey"], order_by=["o_orderkey"]), partition_size=400, order_by=["o_orderkey"]))


def _folder(spark: SparkSession) -> str:
    """A new folder where the session says that all can read; a local one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="linkloom-csv-")
    return f"{base.rstrip('/')}/linkloom-csv/{uuid.uuid4().hex}"


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    ToFile(path, {"sep": ";"})(table(spark, sf_dir, "nation"))
    return FromFile(path, {"sep": ";"})()


QUERIES["csv_roundtrip"] = _csv
ORACLE_SQL["csv_roundtrip"] = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"

query("smiles_strip_stereo", "part", f'SELECT p_partkey, replace({_SMILES}, \'@\', \'\') AS "Smiles", CAST(NULL AS VARCHAR) AS __error__ FROM part', prepare=molecules)(lambda: RemoveStereoSmiles())
query("smiles_tokens", "part", f'SELECT p_partkey, {_SMILES} AS "Smiles", len(regexp_extract_all({_SMILES}, \'(\\[[^\\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\\(|\\)|\\.|=|#|-|\\+|\\\\|\\/|:|~|@|\\?|>|\\*|\\$|\\%[0-9]{{2}}|[0-9])\'))::INTEGER AS "NumTokens", CAST(NULL AS VARCHAR) AS __error__ FROM part', prepare=molecules)(lambda: NumberOfTokens())


def _mol_query(name: str, link: Link, column: str, sql: str) -> None:
    QUERIES[name] = _flagged(Chain([MolFromSmiles(), link]), molecules, "part", ["p_partkey", column])
    ORACLE_SQL[name] = f'SELECT p_partkey, {sql} AS "{column}", NOT {_PARSED} AS failed FROM part'


_mol_query("mol_heavy", HeavyAtomCount(), "HeavyAtomCount", _known(1, "INTEGER"))
_mol_query("mol_hetero", HeteroAtomRatio(), "HeteroAtomRatio", f"{_known(2, 'DOUBLE')} / {_known(1, 'DOUBLE')}")
_mol_query("mol_elements", ElementsInList(), "ElementsAllowed", _known(3, "BOOLEAN"))
_mol_query("mol_chain", LongestAliphaticChain(max_chain_length=4), "LongestAliphaticChain", f"CASE WHEN {_known(4, 'INTEGER')} >= 4 THEN 0 ELSE {_known(4, 'INTEGER')} END")
_mol_query("mol_to_smiles", MolToSmiles(out_column="Again"), "Again", f"CASE WHEN {_PARSED} THEN {_SMILES} END")
_mol_query("mol_strip_stereo", RemoveStereoMol() + MolToSmiles(out_column="Flat"), "Flat", f"CASE WHEN {_PARSED} THEN replace({_SMILES}, '@', '') END")
_mol_query("mol_parent", SuperParent() + MolToSmiles(out_column="Parent"), "Parent", f"CASE WHEN {_PARSED} THEN CASE p_partkey % {len(MOLECULES)} WHEN 5 THEN 'CC(N)(O)Cl' WHEN 7 THEN 'CC(=O)O' ELSE {_SMILES} END END")
_mol_query("mol_from_smiles_errors", NullLink(), "Smiles", _SMILES)
QUERIES["mol_add_column"] = _flagged(PandasAddMoleculeColumn(), molecules, "part", ["p_partkey"])
ORACLE_SQL["mol_add_column"] = f"SELECT p_partkey, NOT {_PARSED} AS failed FROM part"


def _lipinski(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Chain([MolFromSmiles(), RDKitDescriptors(descriptors=["MolWt", "NumHDonors", "NumHAcceptors"]), Query("MolWt < 500 and NumHAcceptors < 10 and NumHDonors < 2"), KeepColumns(["p_partkey", "Smiles"])])
    return chain(molecules(table(spark, sf_dir, "part")))


QUERIES["lipinski_shape"] = _lipinski
ORACLE_SQL["lipinski_shape"] = f'SELECT p_partkey, {_SMILES} AS "Smiles" FROM part WHERE {_PARSED} AND {_known(7, "INTEGER")} < 2'


# -- files: quoting, missing values, errors, configurations, the command line


def _quoted(df: DataFrame) -> DataFrame:
    """Names with quotes, separators and line ends, blanks at their ends, and missing ones."""
    text = """CASE n_nationkey % 6 WHEN 0 THEN concat('say "', n_name, '", ok') WHEN 1 THEN concat(n_name, chr(10), 'two') WHEN 2 THEN concat('"', n_name, '"') WHEN 3 THEN 'N/A' WHEN 4 THEN concat(' ', n_name, ' ;') ELSE n_name END"""
    return df.select("n_nationkey", F.expr(text).alias("t"), F.expr("n_nationkey / 4.0D").alias("x"))


_QUOTED_SQL = """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'say "' || n_name || '", ok' WHEN 1 THEN n_name || chr(10) || 'two' WHEN 2 THEN '"' || n_name || '"' WHEN 3 THEN NULL WHEN 4 THEN ' ' || n_name || ' ;' ELSE n_name END AS t, n_nationkey / 4.0::DOUBLE AS x FROM nation"""


def _csv_quotes(spark: SparkSession, sf_dir: str, sep: str = ",") -> DataFrame:
    path = _folder(spark)
    ToFile(path, {"sep": sep})(_quoted(table(spark, sf_dir, "nation")))
    return FromFile(path, {"sep": sep, "dtype": {"n_nationkey": "int", "x": "float"}})()


QUERIES["csv_quotes"] = _csv_quotes
ORACLE_SQL["csv_quotes"] = f"SELECT n_nationkey::BIGINT AS n_nationkey, t, x FROM ({_QUOTED_SQL})"
QUERIES["csv_quotes_semicolon"] = lambda spark, sf_dir: _csv_quotes(spark, sf_dir, ";")
ORACLE_SQL["csv_quotes_semicolon"] = ORACLE_SQL["csv_quotes"]


def _errors_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    (LinearModelRow(3, 1) + StripErrors(path))(_strings(table(spark, sf_dir, "events")))
    return FromFile(path, {"dtype": {"event_id": "int", "x": "str"}, "usecols": ["event_id", "x"]})()


QUERIES["errors_file"] = _errors_file
ORACLE_SQL["errors_file"] = f"SELECT event_id::BIGINT AS event_id, x FROM (SELECT event_id, {_X} AS x FROM events) WHERE try_cast(x AS DOUBLE) IS NULL"


def _config_file(kind: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:  # the driver's own
            path = f"{folder}/chain.{kind}"
            config.save_chain(Chain(_FLAGSHIP), path, defaults=False, version=False, log_level=False)
            return config.load_chain(path)(table(spark, sf_dir, "lineitem"))

    return run


for _suffix in ("yaml", "json"):
    QUERIES[f"config_{_suffix}"], ORACLE_SQL[f"config_{_suffix}"] = _config_file(_suffix), _FLAGSHIP_SQL


def _cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom import cli

    base = _folder(spark)
    _strings(table(spark, sf_dir, "events")).write.option("header", True).csv(f"{base}/in")
    with tempfile.TemporaryDirectory() as folder:
        config.save_chain(Chain([LinearModelRow(3, 1), Query("event_id < 5000 or event_id != event_id")]), f"{folder}/c.yaml")
        cli.main(["run", f"{folder}/c.yaml", "--in_file", f"{base}/in", "--out_file", f"{base}/out", "--error_file", f"{base}/errors"])
    kinds = {"event_id": "int", "x": "str", "y": "float"}
    good = FromFile(f"{base}/out", {"dtype": kinds})().select("event_id", "x", "y", F.lit(False).alias("failed"))
    return good.union(FromFile(f"{base}/errors", {"dtype": kinds | {"__error__": "str"}})().select("event_id", "x", "y", F.lit(True)))


QUERIES["cli_run"] = _cli
ORACLE_SQL["cli_run"] = f"SELECT event_id::BIGINT AS event_id, x, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS y, try_cast(x AS DOUBLE) IS NULL AS failed FROM (SELECT event_id, {_X} AS x FROM events) WHERE event_id < 5000"

# -- models, batches, logs, errors that add up


class _Lengths:
    """A model: lengths of strings; a batch with a string that is no molecule fails."""

    def predict(self, xs: list) -> list[float]:
        if "ImNotASmiles" in xs:
            raise ValueError("no molecule")
        return [float(len(x)) for x in xs]


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/model.pkl"
        with open(path, "wb") as f:
            pickle.dump(_Lengths(), f)
        link = ScikitMolSmilesModel(f"file://{path}", allow_pickle=True)
        out = link(molecules(table(spark, sf_dir, "part")))  # the file is read when the plan is made
    return out.select("p_partkey", "skmol_prediction", F.col(ERROR).isNotNull().alias("failed"))


QUERIES["model_predict"] = _model
ORACLE_SQL["model_predict"] = f"SELECT p_partkey, CASE WHEN {_SMILES} <> 'ImNotASmiles' THEN length({_SMILES})::DOUBLE END AS skmol_prediction, {_SMILES} = 'ImNotASmiles' AS failed FROM part"


@dataclass
class _Share(BatchLink):
    """A value's share of 100, over batches."""

    in_column: str = "value"

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return "share double"

    def batch_apply(self, columns: dict[str, list], log: RowLogger) -> dict[str, list]:
        import numpy as np

        return {"share": (np.array(columns[self.in_column], float) / 100).tolist()}


@dataclass
class _Halves(RowLink):
    """Halves even numbers, and says so."""

    in_column: str = "event_id"
    logs = True

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return "half long"

    def row_apply(self, row: dict, log: RowLogger) -> dict:
        log.warning("seen")
        log.debug("hidden")
        if row[self.in_column] % 2:
            raise ValueError("odd")
        return {"half": row[self.in_column] // 2}


query("batch_link", "events", "SELECT event_id, value, value / 100 AS share, CAST(NULL AS VARCHAR) AS __error__ FROM events", ["event_id", "value"])(lambda: _Share())
query("row_log", "events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id // 2 END AS half, CASE WHEN event_id % 2 = 1 THEN 'ValueError: odd' END AS __error__, 'WARNING: seen' AS __log__ FROM events", ["event_id"])(lambda: _Halves())
query(
    "errors_add_up", "events",
    f"SELECT event_id, x, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS y, CASE WHEN try_cast(x AS DOUBLE) IS NULL THEN 'Error in x row data' || chr(10) || 'Error in y row data' END AS __error__, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS z FROM (SELECT event_id, {_X} AS x FROM events)",
    prepare=_strings,
)(lambda: LinearModelDf(3, 1) + DfEval("y2 = y") + DropColumns(["y2"]) + LinearModelDf(1, 0, "y", "z"))
QUERIES["partial_output"] = _flagged(Chain([LinearModelRow(2, 0, "event_id", "y"), LinearModelRow(3, 1, "x", "z"), LinearModelRow(1, 0, "event_id", "w")]), _strings, "events", ["event_id", "x", "y", "z", "w"])
ORACLE_SQL["partial_output"] = f"SELECT event_id, x, 2.0::DOUBLE * event_id + 0.0::DOUBLE AS y, 3.0::DOUBLE * try_cast(x AS DOUBLE) + 1.0::DOUBLE AS z, CASE WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE * event_id + 0.0::DOUBLE END AS w, try_cast(x AS DOUBLE) IS NULL AS failed FROM (SELECT event_id, {_X} AS x FROM events)"


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("__row_id__"))


query("query_index", "orders", "SELECT o_orderkey, o_custkey, o_orderkey AS __row_id__ FROM orders WHERE o_orderkey < 100 OR o_custkey = 7", prepare=_numbered)(lambda: Query("index < 100 or o_custkey == 7"))
query("query_quoted_name", "orders", "SELECT o_orderkey, o_totalprice AS \"total price\" FROM orders WHERE o_totalprice > 1000.5", prepare=lambda df: df.select("o_orderkey", F.col("o_totalprice").alias("total price")))(lambda: Query("`total price` > 1000.5"))

_CALLS = {
    "sin(x)": "sin(x)", "cos(x)": "cos(x)", "exp(x)": "exp(x)", "expm1(x)": "exp(x) - 1", "sinh(x)": "sinh(x)", "cosh(x)": "cosh(x)", "tanh(x)": "tanh(x)", "arctan(x)": "atan(x)", "arcsinh(x)": "asinh(x)",
    "log10(x)": "CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN '-Infinity'::DOUBLE END", "log1p(x)": "CASE WHEN x > -1 THEN ln(1 + x) WHEN x = -1 THEN '-Infinity'::DOUBLE END", "arcsin(x)": "CASE WHEN abs(x) <= 1 THEN asin(x) END", "arccos(x)": "CASE WHEN abs(x) <= 1 THEN acos(x) END",
    "arccosh(x)": "CASE WHEN x >= 1 THEN acosh(x) END", "arctanh(x)": "CASE WHEN abs(x) < 1 THEN atanh(x) WHEN abs(x) = 1 THEN sign(x) * 'Infinity'::DOUBLE END", "ceil(x) + 0": "ceil(x) + 0", "abs(x)": "abs(x)", "arctan2(x, 2)": "atan2(x, 2)",
}


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", ((F.pmod("p_partkey", F.lit(25)) - 12) / 4).cast("double").alias("x"))
    out = DfEval("\n".join(f"c{i} = {text}" for i, text in enumerate(_CALLS)))(df)
    return out.select("p_partkey", "x", *(F.round(f"c{i}", 6).alias(f"c{i}") for i in range(len(_CALLS))))


QUERIES["dfeval_calls"] = _calls
ORACLE_SQL["dfeval_calls"] = "SELECT p_partkey, x, " + ", ".join(f"round({sql}, 6) AS c{i}" for i, sql in enumerate(_CALLS.values())) + " FROM (SELECT p_partkey, (p_partkey % 25 - 12) / 4.0::DOUBLE AS x FROM part)"


def _toolbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.toolbox import toolbox

    return toolbox().table(spark).where("module = 'linkloom.operators.table'").select("class")


QUERIES["toolbox"] = _toolbox
ORACLE_SQL["toolbox"] = "SELECT unnest(['DfEval', 'DropColumns', 'DropDuplicates', 'DropTable', 'KeepColumns', 'NullLink', 'Query', 'RenameColumns', 'RowEval']) AS class"

# -- chemistry over 120 molecules: alkanes, alcohols, amines and alkylbenzenes of 1 to 30 carbons in the chain


def series(df: DataFrame) -> DataFrame:
    """p_partkey, Smiles, Turned: one molecule written from either end."""
    n, kind = F.pmod("p_partkey", F.lit(30)).cast("int") + 1, F.pmod(F.floor(F.col("p_partkey") / 30), F.lit(4))
    chain = F.repeat(F.lit("C"), n)
    ends = [("", ""), ("O", "O"), ("N", "N"), ("c1ccccc1", "c1ccccc1")]
    one = two = F.lit(None).cast("string")
    for i, (head, tail) in enumerate(ends):
        one = F.when(kind == i, F.concat(chain, F.lit(tail))).otherwise(one)
        two = F.when(kind == i, F.concat(F.lit(head), chain)).otherwise(two)
    return df.select("p_partkey", one.alias("Smiles"), two.alias("Turned"))


_SERIES = """(SELECT p_partkey, n, kind, n + CASE kind WHEN 3 THEN 6 ELSE 0 END AS carbons, 2 * n + CASE kind WHEN 2 THEN 3 WHEN 3 THEN 6 ELSE 2 END AS hydrogens,
  repeat('C', n) || CASE kind WHEN 0 THEN '' WHEN 1 THEN 'O' WHEN 2 THEN 'N' ELSE 'c1ccccc1' END AS "Smiles"
  FROM (SELECT p_partkey, (p_partkey % 30 + 1)::INTEGER AS n, (p_partkey // 30) % 4 AS kind FROM part))"""
# Atomic weights, and the published contributions of the atom types that occur.
_WEIGHT = "carbons * 12.011::DOUBLE + hydrogens * 1.008::DOUBLE + CASE kind WHEN 1 THEN 15.999::DOUBLE WHEN 2 THEN 14.007::DOUBLE ELSE 0 END"
_LOGP = """CASE kind WHEN 0 THEN n * 0.1441::DOUBLE + hydrogens * 0.123::DOUBLE
  WHEN 1 THEN (n - 1) * 0.1441::DOUBLE - 0.2035 - 0.2893 + (hydrogens - 1) * 0.123::DOUBLE - 0.2677
  WHEN 2 THEN (n - 1) * 0.1441::DOUBLE - 0.2035 - 1.019 + (hydrogens - 2) * 0.123::DOUBLE + 2 * 0.2142
  ELSE 5 * 0.1581::DOUBLE + 0.136 + CASE n WHEN 1 THEN 0.08452 ELSE -0.0516 + (n - 1) * 0.1441::DOUBLE END + hydrogens * 0.123::DOUBLE END"""
_POLAR = "(kind IN (1, 2))::INTEGER::DOUBLE"


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Chain([MolFromSmiles(), RDKitDescriptors()])(series(table(spark, sf_dir, "part")))
    return out.select("p_partkey", "Smiles", F.round("MolWt", 3).alias("MolWt"), F.round("MolLogP", 4).alias("MolLogP"), "NumHAcceptors", "NumHDonors")


QUERIES["mol_descriptors"] = _descriptors
ORACLE_SQL["mol_descriptors"] = f'SELECT p_partkey, "Smiles", round({_WEIGHT}, 3) AS "MolWt", round({_LOGP}, 4) AS "MolLogP", {_POLAR} AS "NumHAcceptors", {_POLAR} AS "NumHDonors" FROM {_SERIES}'


def _series_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Chain([MolFromSmiles(), HeavyAtomCount(), LongestAliphaticChain(), RDKitDescriptors(descriptors=["RingCount", "NumHeteroatoms"])])
    return chain(series(table(spark, sf_dir, "part"))).select("p_partkey", "HeavyAtomCount", "LongestAliphaticChain", "RingCount", "NumHeteroatoms")


QUERIES["mol_series_counts"] = _series_counts
_CHAIN = "CASE kind WHEN 0 THEN greatest(n - 2, 0) ELSE n - 1 END"
ORACLE_SQL["mol_series_counts"] = f'SELECT p_partkey, (carbons + (kind IN (1, 2))::INTEGER)::INTEGER AS "HeavyAtomCount", (CASE WHEN {_CHAIN} < 11 THEN {_CHAIN} ELSE 0 END)::INTEGER AS "LongestAliphaticChain", (kind = 3)::INTEGER::DOUBLE AS "RingCount", {_POLAR} AS "NumHeteroatoms" FROM {_SERIES}'


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Chain([MolFromSmiles("Smiles", "m1"), MolFromSmiles("Turned", "m2"), MolToSmiles("m1", "c1", canonical=True), MolToSmiles("m2", "c2", canonical=True)])
    return chain(series(table(spark, sf_dir, "part"))).select("p_partkey", (F.col("c1") == F.col("c2")).alias("same"), F.length("c1").cast("long").alias("n"))


QUERIES["mol_canonical"] = _canonical
ORACLE_SQL["mol_canonical"] = f'SELECT p_partkey, true AS same, length("Smiles")::BIGINT AS n FROM {_SERIES}'


def _lipinski_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Chain([MolFromSmiles(), RDKitDescriptors(), Query("MolWt < 500 and MolLogP < 5 and NumHAcceptors < 10 and NumHDonors < 5"), KeepColumns(["p_partkey", "Smiles"])])
    return chain(series(table(spark, sf_dir, "part")))


QUERIES["lipinski"] = _lipinski_rules
ORACLE_SQL["lipinski"] = f'SELECT p_partkey, "Smiles" FROM {_SERIES} WHERE {_WEIGHT} < 500 AND {_LOGP} < 5'
