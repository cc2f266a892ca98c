"""Every link keeps the contract of links: tables in and out, sums, parameters."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

import linkloom as L
from linkloom.plans.base import ERROR, Configurable, registered
from linkloom.streaming import apply_stream
from linkloom.toolbox import toolbox

toolbox()


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.createDataFrame([(1, 2, "a", 1, "C"), (2, 3, "b", 2, "CN"), (3, 4, "c", 1, "OCN")], "int1 long, int2 long, letters1 string, duplicates long, Smiles string").coalesce(1)
    return L.MolFromSmiles()(df).drop(ERROR).persist()


@pytest.fixture(scope="module")
def faulty(spark):
    rows = [(1, "a", "a", "c1ccccc1"), (2, "b", "b", "c1ccccc1CN"), (3, "c", "c", "c1ccccc1.C"), (4, "d", "1", "ImNotASmiles"), (5, "e", None, "1"), (6, "f", "1.0", None)]
    df = spark.createDataFrame(rows, "int1 long, letters1 string, mixed_types string, Smiles string").coalesce(1)
    return L.MolFromSmiles()(df).drop(ERROR).persist()


def links(tmp):
    null = [L.NullLink("a"), L.NullLink("b")]
    return [
        (L.NullLink("x"), L.NullLink("y")),
        (L.Chain(null), L.Chain(null[:1])),
        (L.UnionLink(*null), L.UnionLink(null[1], null[1])),
        (L.DfEval("z = int1 + int2"), L.DfEval("int1 * 2", "q")),
        (L.DropColumns(["int2"]), L.DropColumns(["letters1"])),
        (L.DropDuplicates(["duplicates"]), L.DropDuplicates([])),
        (L.DropTable(), None),
        (L.KeepColumns(["int2", "int1"]), L.KeepColumns([])),
        (L.RowEval("row.int1 + row.int2", "s"), L.RowEval("row.int1 * 2", "t")),
        (L.Query("int1 > 1"), L.Query("")),
        (L.RenameColumns({"int1": "x"}), L.RenameColumns({"int2": "y"})),
        (L.ToFile(f"{tmp}/out.csv"), L.ToFile(f"{tmp}/other.csv", {"sep": ";"})),
        (L.StripErrors(), L.StripErrors(f"{tmp}/errors.csv")),
        (L.LinearModelRow(1, 2, "int1"), L.LinearModelRow(2, 3, "int2", "z")),
        (L.LinearModelDf(1, 2, "int1"), L.LinearModelDf(2, 3, "int2", "z")),
        (L.SerialPartitionProcessor(null[0], num_partitions=2), L.SerialPartitionProcessor(null[1], partition_size=2)),
        (L.ParallelPartitionProcessor(null[0], num_partitions=2), L.ParallelPartitionProcessor(null[1], partition_size=2, num_processes=2)),
        (L.ElementsInList(), L.ElementsInList(allowed_elements={6, 7}, out_column="e")),
        (L.HeavyAtomCount(), L.HeavyAtomCount(out_column="n")),
        (L.HeteroAtomRatio(), L.HeteroAtomRatio(out_column="r")),
        (L.LongestAliphaticChain(), L.LongestAliphaticChain(max_chain_length=3)),
        (L.MolFromSmiles(), L.MolFromSmiles(out_column="m")),
        (L.MolToSmiles(), L.MolToSmiles(out_column="s")),
        (L.NumberOfTokens(), L.NumberOfTokens(out_column="t")),
        (L.PandasAddMoleculeColumn(), L.PandasAddMoleculeColumn(molCol="m")),
        (L.RDKitDescriptors(descriptors=["MolWt"]), L.RDKitDescriptors(descriptors=["RingCount"])),
        (L.RemoveStereoMol(), L.RemoveStereoMol(out_column="flat")),
        (L.RemoveStereoSmiles(), L.RemoveStereoSmiles(out_column="flat")),
        (L.SuperParent(), L.SuperParent(out_column="p")),
    ]


def test_contract(spark, sample, tmp_path):
    before = sample.schema
    for link, other in links(tmp_path):
        name = type(link).__name__
        out = link(sample)
        if name not in ("DropTable",):
            assert out.count() >= 0
        assert sample.schema == before, name
        assert isinstance(link + L.NullLink(), L.Chain) and isinstance(L.NullLink() + link, L.Chain)
        assert type(sum([link])) is type(link)
        assert [type(x) for x in (L.NullLink("n") + link).links][0] is L.NullLink
        assert len((link + (L.NullLink() + L.NullLink())).links) == (len(link.links) if name == "Chain" else 1) + 2
        params = json.loads(json.dumps(link.get_params()))
        assert params["__class__"] == name and {"__version__", "__loglevel__"} <= set(params)
        clone = Configurable.from_params(params)
        assert clone.get_params() == link.get_params()
        if other is not None:
            assert Configurable.from_params(other.get_params()).get_params() != link.get_params()
        with pytest.raises(TypeError):
            link + 1
        if name != "ToFile":
            assert link.output_schema(sample.schema, spark).names == out.columns


def test_all_links_are_covered(tmp_path):
    named = {type(a).__name__ for a, _ in links(tmp_path)} | {"FromFile", "ScikitMolMolModel", "ScikitMolSmilesModel"}
    own = {n for n, k in registered().items() if k.__module__.startswith("linkloom.")}
    assert own - named == set()


def mask(df, by="int1"):
    return [r[0] is not None for r in df.orderBy(by).select(ERROR).collect()]


def test_error_masks(faulty):
    molecule = [False] * 3 + [True] * 3
    for link in (L.ElementsInList(), L.HeavyAtomCount(), L.HeteroAtomRatio(), L.LongestAliphaticChain(), L.MolFromSmiles(), L.MolToSmiles(), L.RDKitDescriptors(descriptors=["MolWt"]), L.RemoveStereoMol(), L.SuperParent(), L.PandasAddMoleculeColumn()):
        assert mask(link(faulty)) == molecule, type(link).__name__
    for link in (L.NumberOfTokens(), L.RemoveStereoSmiles()):
        assert mask(link(faulty)) == [False] * 5 + [True]
    assert mask(L.RowEval("row.letters1 + row.mixed_types", "z")(faulty)) == [False, False, False, False, True, False]
    # an errored row is skipped by later row links and keeps its error
    out = (L.LinearModelRow(1, 0, "mixed_types", "y") + L.LinearModelRow(1, 0, "int1", "z"))(faulty).orderBy("int1").collect()
    assert [r.z for r in out] == [None, None, None, 4.0, None, 6.0]
    assert "convert" in out[0][ERROR]


def test_values(spark, sample):
    assert [r[0] for r in L.HeteroAtomRatio()(sample).orderBy("int1").select("HeteroAtomRatio").collect()] == [0, 1 / 2, 2 / 3]
    assert [r.y for r in L.LinearModelRow(1, 2, "int1")(sample).orderBy("int1").collect()] == [3, 4, 5]
    assert sorted(r.int1 for r in L.DropDuplicates(["duplicates"])(sample).collect()) == [1, 2]
    assert L.Query("int1 > 1")(sample).count() == 2
    assert L.KeepColumns(["int2", "int1"])(sample).columns == ["int2", "int1"]
    assert L.KeepColumns([])(sample).count() == 3
    assert L.DropTable()(sample).columns == []
    stereo = spark.createDataFrame([("C[C@](N)(O)Cl",)], "Smiles string")
    out = (L.MolFromSmiles() + L.RemoveStereoMol(out_column="m2") + L.MolToSmiles("m2", "s2"))(stereo).first()
    assert "@" not in out.s2 and "@" in out.ROMol.smiles and not any(a.chiral for a in out.m2.atoms)
    assert L.RemoveStereoSmiles(out_column="flat")(stereo).first().flat == "C[C](N)(O)Cl"
    assert L.NumberOfTokens()(stereo).first().NumTokens == 9
    with pytest.raises(KeyError):
        L.DropColumns(["none"])(sample)
    with pytest.raises(AssertionError):
        L.LinearModelRow(1, 2, "none")(sample)
    with pytest.raises(ImportError):
        L.RDKitDescriptors(descriptors=["TPSA"])(sample)


def test_union(spark, sample):
    df = sample.drop("ROMol")
    fast = L.UnionLink(L.Query("int1 > 1") + L.DfEval("a = int1 * 2"), L.Query("int1 < 3") + L.DfEval("b = int2 + 1"))(df)
    assert fast.columns == sorted(["int1", "int2", "letters1", "duplicates", "Smiles", "a", "b"])
    assert [(r.int1, r.a, r.b) for r in fast.orderBy("int1").collect()] == [(1, None, 3), (2, 4, 4), (3, 6, None)]
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    general = L.UnionLink(L.DropDuplicates(["duplicates"]), L.Query("int1 > 2") + L.DfEval("b = int1"))(df)
    assert [(r.int1, r.b) for r in general.orderBy("int1").collect()] == [(1, None), (2, None), (3, 3)]
    assert "__row_id__" not in general.columns
    assert L.UnionLink(L.NullLink(), L.DropTable())(df).count() == 3
    left = L.UnionLink(L.LinearModelRow(1, 0, "letters1", "y"), L.LinearModelRow(1, 0, "int1", "y"))(df).orderBy("int1").collect()
    assert all(r[ERROR] for r in left) and [r.y for r in left] == [1, 2, 3]  # cells merge one by one


def test_pieces(spark):
    df = spark.range(13).select("id", F.lit(1).alias("k"))
    for n, size in ((5, None), (None, 4), (20, None)):
        k = n or 13 // size + 1
        out = L.SerialPartitionProcessor(L.DropDuplicates(["k"], order_by=["id"]), num_partitions=n, partition_size=size, order_by=["id"])(df)
        first = [r.id for r in out.orderBy("id").collect()]
        q, r = divmod(13, k)
        sizes = [q + 1] * r + [q] * (k - r)
        starts = [sum(sizes[:i]) for i in range(k) if sizes[i]]
        assert first == starts
    assert [r.id for r in L.ParallelPartitionProcessor(L.DropDuplicates(["k"]), num_partitions=2)(df.coalesce(1)).orderBy("id").collect()] == [0, 7]
    inner = L.SerialPartitionProcessor(L.DropDuplicates(["k"], order_by=["id"]), num_partitions=2, order_by=["id"])
    nested = L.SerialPartitionProcessor(inner, num_partitions=2, order_by=["id"])(df)
    assert [r.id for r in nested.orderBy("id").collect()] == [0, 4, 7, 10]
    with pytest.raises(ValueError):
        L.SerialPartitionProcessor(L.NullLink(), partition_size=1, num_partitions=1)
    with pytest.raises(ValueError):
        L.SerialPartitionProcessor(L.NullLink())(df)


def test_kernels_are_fused_and_filters_move(sample):
    chain = L.Chain([L.MolFromSmiles(out_column="m"), L.LongestAliphaticChain("m"), L.Query("int1 > 1")])
    plan = chain(sample.drop("ROMol"))._jdf.queryExecution().optimizedPlan().toString()
    plan = plan.split("InMemoryRelation")[0]  # what is cached has a kernel of its own
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # the filter is below


def test_row_link_and_log(spark, sample):
    @L.register
    @dataclasses.dataclass
    class Half(L.RowLink):
        """Halves even numbers."""

        in_column: str = "int1"
        logs = True

        def output(self):
            return "half double"

        def needs(self):
            return [self.in_column]

        def row_apply(self, row, log):
            log.info("seen")
            log.debug("hidden")
            if row[self.in_column] % 2:
                raise ValueError("odd")
            return {"half": row[self.in_column] / 2}

    link = Half()
    link.set_log_level("INFO")
    rows = link(sample).orderBy("int1").collect()
    assert [r.half for r in rows] == [None, 1.0, None]
    assert rows[0][ERROR] == "ValueError: odd" and rows[1]["__log__"] == "INFO: seen"
    assert toolbox()["Half"] is Half and Half.tooltip() == "Halves even numbers."


def test_toolbox(spark):
    t = toolbox().table(spark)
    assert t.columns == ["module", "class", "tooltip", "api"] and t.where("class = 'Query'").count() == 1


def test_streams(spark, sample, tmp_path):
    sample.select("int1", "int2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("int1 long, int2 long").parquet(str(tmp_path / "in"))
    out = apply_stream(L.Query("int1 > 1") + L.DfEval("z = int1 + int2"), stream)
    q = out.writeStream.format("memory").queryName("linkloom_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.z for r in spark.table("linkloom_stream").collect()) == [5, 7]
    with pytest.raises(ValueError):
        apply_stream(L.DropDuplicates(["int1"]), stream)


class Doubler:
    def predict(self, xs):
        return [2.0 * len(x) for x in xs]


def test_models(spark, sample, tmp_path):
    import pickle

    path = str(tmp_path / "model.pkl")
    with open(path, "wb") as f:
        pickle.dump(_FakeModel(), f)
    with pytest.raises(ValueError):
        L.ScikitMolSmilesModel(path)
    out = L.ScikitMolSmilesModel(path, allow_pickle=True)(sample).orderBy("int1").collect()
    assert [r.skmol_prediction for r in out] == [1.0, 2.0, 3.0]
    assert L.ScikitMolModelServer(path, allow_pickle=True).predict(["CC", None, "C"]) == [2.0, None, 1.0]
    clone = Configurable.from_params(L.ScikitMolMolModel(path, allow_pickle=True).get_params())
    assert clone.in_column == "ROMol"


class _FakeModel:
    """Pickled by value: workers need not import the tests."""

    def __reduce__(self):
        return (eval, ("type('M', (), {'predict': lambda self, xs: [float(len(x)) for x in xs]})()",))


def test_batches_fall_back_to_rows(spark):
    @dataclasses.dataclass
    class Inverse(L.BatchLink):
        """One over x; batches with a zero fail."""

        def needs(self):
            return ["x"]

        def output(self):
            return "inverse double"

        def batch_apply(self, columns, log):
            return {"inverse": [1 / x for x in columns["x"]]}

    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, x double").coalesce(1)
    rows = (L.LinearModelRow(1, 0, "x") + Inverse())(df).orderBy("id").collect()
    assert [r.inverse for r in rows] == [None, 1.0, 0.5, 1 / 3, 0.25]
    assert rows[0][ERROR].startswith("ZeroDivisionError") and not any(r[ERROR] for r in rows[1:])


def test_own_columns_with_working_names(spark):
    names = ["__kernel__", "__place__", "__failed__", "__in__", "__left__", "__keep__", "__piece0__at"]
    df = spark.createDataFrame([("C", 1, 1.0, *names)], "Smiles string, k long, x double, " + ", ".join(f"`{n}` string" for n in names))
    for link in (L.MolFromSmiles(), L.DropDuplicates(["k"]), L.LinearModelDf(1, 0), L.UnionLink(L.Query("k > 0"), L.DropDuplicates(["k"])), L.SerialPartitionProcessor(L.DropDuplicates(["k"]), num_partitions=2)):
        row = link(df).first()
        assert [row[n] for n in names] == names, type(link).__name__


def test_pieces_with_one_frequent_value(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = L.SerialPartitionProcessor(L.DropDuplicates(["k"], order_by=["id"]), num_partitions=10, order_by=["k", "id"])(df)
    assert sorted(r.id for r in out.collect()) == [*range(0, 900, 100), *range(900, 1000)]


def test_descriptors_of_known_molecules(spark):
    known = {"CC(=O)Oc1ccccc1C(=O)O": (180.159, 1.3101), "Cn1cnc2c1c(=O)n(C)c(=O)n2C": (194.194, -1.0293), "CC(=O)Nc1ccc(O)cc1": (151.165, 1.3506), "CC(C)Cc1ccc(cc1)C(C)C(=O)O": (206.285, 3.0732), "c1ccc2ccccc2c1": (128.174, 2.8398), "O": (18.015, -0.8247)}
    df = spark.createDataFrame([(s,) for s in known], "Smiles string")
    for r in (L.MolFromSmiles() + L.RDKitDescriptors())(df).collect():
        assert abs(r.MolWt - known[r.Smiles][0]) < 0.01 and abs(r.MolLogP - known[r.Smiles][1]) < 1e-4


def test_canonical_strings_and_matchings():
    import itertools
    import random

    from linkloom.functions import smiles as S

    rng = random.Random(1)
    for text in ["CC(=O)Oc1ccccc1C(=O)O", "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "c1ccc2ccccc2c1", "[Na+].CC(=O)[O-]", "C1CC2CC1CC2", "C12C3C4C1C5C2C3C45", "FC(F)(F)c1ccc(Cl)cc1", "C" * 3000]:
        mol = S.parse(text)
        one = S.canonical(mol) if len(text) < 100 else S.write(mol)
        assert len(S.parse(one)["atoms"]) == len(mol["atoms"])
        for _ in range(10 if len(text) < 100 else 0):
            p = rng.sample(range(len(mol["atoms"])), len(mol["atoms"]))
            to = {v: i for i, v in enumerate(p)}
            bonds = [{**b, "a": to[b["a"]], "b": to[b["b"]]} for b in rng.sample(mol["bonds"], len(mol["bonds"]))]
            assert S.canonical({"atoms": [mol["atoms"][v] for v in p], "bonds": bonds}) == one
    with pytest.raises(S.SmilesError):
        S.parse("c1cccc1")

    def brute(left, edges):
        return not left or any(w in left and brute(left - {left_first, w}, edges) for left_first in [min(left)] for w in edges[left_first])

    for _ in range(400):
        n = rng.randint(0, 9)
        edges = {i: [] for i in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.35:
                edges[a].append(b)
                edges[b].append(a)
        assert S._matched(edges) == brute(frozenset(range(n)), edges)


del Doubler
