"""Files, configurations, errors, command line."""

import glob
import json

import pytest
import yaml

import linkloom as L
from linkloom import cli
from linkloom.operators.errors import ErrorContextManager, StderrContextManager, has_error, rows_with_errors
from linkloom.plans import config
from linkloom.plans.base import ERROR, Configurable


@pytest.fixture()
def csv(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("int1,letters,x\n1,a,1.5\n2,NA,bad\n3,c,\n")
    return str(p)


def test_read(spark, csv):
    df = L.FromFile(csv)()
    assert df.dtypes == [("int1", "bigint"), ("letters", "string"), ("x", "string")]
    assert [tuple(r) for r in df.orderBy("int1").collect()] == [(1, "a", "1.5"), (2, None, "bad"), (3, "c", None)]
    some = L.FromFile(csv, {"usecols": ["x", "int1"], "na_values": "bad", "nrows": 2, "dtype": {"int1": "str"}})()
    assert some.dtypes == [("x", "double"), ("int1", "string")] and some.count() == 2
    with pytest.raises(ValueError):
        L.FromFile(csv, {"engine": "c"})()


def test_write_is_a_tee(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    df = (L.FromFile(csv) + L.ToFile(out, {"sep": "|", "index": True}) + L.Query("int1 > 1"))(spark.range(1))
    assert df.count() == 2
    again = L.FromFile(out, {"sep": "|"})()
    assert again.columns == ["index", "int1", "letters", "x"] and again.count() == 3
    with pytest.raises(ValueError):
        L.ToFile(out, {"compression": "x"})(df)


def test_errors(spark, csv, tmp_path):
    errors = str(tmp_path / "err")
    strip = L.StripErrors(errors)
    assert strip.has_errors is False
    out = (L.FromFile(csv) + L.LinearModelRow(2, 0, "x") + strip)(spark.range(1))
    assert ERROR not in out.columns and out.count() == 1
    assert strip.has_errors and strip.error_df.count() == 2
    assert L.FromFile(errors)().count() == 2
    clean = L.StripErrors()
    assert clean(out).count() == 1 and clean.has_errors is False
    assert rows_with_errors(strip.error_df, aslist=True) == [True, True]
    assert rows_with_errors(out, aslist=True) == [False]
    with pytest.raises(ValueError):
        rows_with_errors(out, aslist="yes")
    assert has_error({ERROR: "x"}) and not has_error({ERROR: ""}) and not has_error({}) and not has_error({ERROR: float("nan")})
    with ErrorContextManager() as e:
        raise ValueError("swallowed")
    assert "swallowed" in e.errors
    with pytest.raises(ValueError), StderrContextManager():
        raise ValueError("goes on")


@pytest.mark.parametrize("ext", ["yaml", "yml", "json"])
def test_config(tmp_path, ext):
    chain = L.Query("x > 1") + L.ElementsInList() + L.UnionLink(L.NullLink("a"), L.DropTable()) + L.RenameColumns({"a": "b"})
    path = str(tmp_path / f"chain.{ext}")
    chain.to_config_file(path)
    clone = Configurable.from_config_file(path)
    assert clone.get_params() == chain.get_params() and clone.links[1].allowed_elements == [6, 7, 8, 9, 16, 17, 35]
    short = chain.get_params(defaults=False, version=False, log_level=False)
    assert "allowed_elements" not in short["links"][1] and "__version__" not in short
    with pytest.raises(ValueError):
        config.save_dict({}, str(tmp_path / "x.txt"))
    with pytest.raises(ValueError):
        Configurable.from_params({"__class__": "os.system"})


def test_cli(spark, csv, tmp_path):
    path = str(tmp_path / "c.yaml")
    (L.LinearModelRow(2, 0, "x") + L.RenameColumns({"y": "z"})).to_config_file(path)
    out, err = str(tmp_path / "o"), str(tmp_path / "e")
    cli.main(["run", path, "--in_file", csv, "--out_file", out, "--error_file", err, "--pd_write_option", "sep=;", "--debug_level", "INFO"])
    assert L.FromFile(out, {"sep": ";"})().columns == ["int1", "letters", "x", "z"]
    assert L.FromFile(err)().count() == 2
    target = str(tmp_path / "c.json")
    cli.main(["config", path, target, "--no-version", "--no-defaults"])
    with open(target) as f, open(path) as g:
        new, old = json.load(f), yaml.safe_load(g)
    assert "__version__" not in new and len(new["links"]) == len(old["links"])


def test_chunks_of_parts(spark, tmp_path):
    L.ToFile(str(tmp_path / "one"), {"single_file": True})(spark.range(5).repartition(3))
    assert len(glob.glob(str(tmp_path / "one" / "part-*"))) == 1


def test_quotes_and_line_ends(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b\n1,"say ""hi"", ok"\n2,"two\nlines"\n3," blank "\n')
    rows = [tuple(r) for r in L.FromFile(str(p))().orderBy("a").collect()]
    assert rows == [(1, 'say "hi", ok'), (2, "two\nlines"), (3, " blank ")]
    out = str(tmp_path / "out")
    L.ToFile(out)(L.FromFile(str(p))()).count()
    assert [tuple(r) for r in L.FromFile(out)().orderBy("a").collect()] == rows
    assert L.FromFile(str(p), {"multiline": False})().count() == 4
    (tmp_path / "e.csv").write_text("a|b\n1|'x\\'y'\n")
    assert L.FromFile(str(tmp_path / "e.csv"), {"sep": "|", "quotechar": "'", "escapechar": "\\"})().first().b == "x'y"


def test_schema_writes_nothing(spark, csv, tmp_path):
    out, errors = str(tmp_path / "out"), str(tmp_path / "errors")
    chain = L.FromFile(csv) + L.LinearModelRow(2, 0, "x") + L.StripErrors(errors) + L.ToFile(out)
    result = chain(spark.range(1))
    written = {f: len(L.FromFile(f)().collect()) for f in (out, errors)}
    assert written == {out: 1, errors: 2}
    assert chain.output_schema(spark.range(1).schema, spark) == result.schema
    assert {f: len(L.FromFile(f)().collect()) for f in (out, errors)} == written


def test_chain_files(tmp_path):
    path = str(tmp_path / "c.yaml")
    config.save_chain(L.NullLink("x") + L.Query("a > 1"), path, defaults=False, version=False, log_level=False)
    assert yaml.safe_load(open(path)) == {"__class__": "Chain", "links": [{"__class__": "NullLink", "name": "x"}, {"__class__": "Query", "query": "a > 1"}]}
    config.save_dict({"links": []}, path)
    with pytest.raises(ValueError):
        config.load_chain(path)
