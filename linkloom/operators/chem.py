"""Chemistry links. Molecules are nested columns; counts over them are expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import molecule as M
from linkloom.functions import smiles as S
from linkloom.functions.crippen import logp
from linkloom.plans.base import ERROR, ColumnLink, Context, InColumn, Link, RowLink, RowLogger, append_errors, c, compile_rows, register

NO_MOL = "TypeError: not a molecule"


def _no_mol(df: DataFrame, name: str) -> Column:
    return c(name).isNull() if isinstance(df.schema[name].dataType, T.StructType) else F.lit(True)


def _mol(df: DataFrame, name: str) -> Column:
    """The column, or a null molecule where it holds something else."""
    return c(name) if isinstance(df.schema[name].dataType, T.StructType) else F.lit(None).cast(M.MOL)


@register
@dataclass
class MolFromSmiles(RowLink):
    """Molecules from SMILES."""

    in_column: InColumn = "Smiles"
    out_column: str = "ROMol"

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return f"`{self.out_column}` {M.MOL}"

    def row_apply(self, row: dict, log: RowLogger) -> dict:
        return {self.out_column: S.parsed(row[self.in_column])}


@register
@dataclass
class PandasAddMoleculeColumn(Link):
    """Molecules from SMILES for the whole table; failures get a fixed error text."""

    smilesCol: InColumn = "Smiles"
    molCol: str = "ROMol"
    includeFingerprints: bool = False
    row_local = True

    def __post_init__(self) -> None:
        if self.includeFingerprints:
            raise ImportError("fingerprints need RDKit, which is not installed")

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        def mol(text: str | None) -> dict | None:
            try:
                return S.parsed(text)
            except S.SmilesError:
                return None

        kind = T.StructType.fromDDL(f"m {M.MOL}")[0].dataType
        arrow = to_arrow_type(kind)

        def kernel(texts: pa.Array) -> pa.Array:
            return pa.array([mol(x) for x in texts.to_pylist()], arrow)

        out = df.withColumn(self.molCol, F.arrow_udf(kernel, kind).asNondeterministic()(c(self.smilesCol).cast("string")))
        return append_errors(out, F.when(c(self.molCol).isNull(), F.lit("Error in SMILES conversion")))


@register
@dataclass
class MolToSmiles(ColumnLink):
    """SMILES of molecules, in input order, or canonical ones: the same for any order of the atoms."""

    in_column: InColumn = "ROMol"
    out_column: str = "Smiles"
    canonical: bool = False

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if self.canonical:
            return compile_rows([_Canonical(self.in_column, self.out_column)], df, ctx)
        return super().compile(df, ctx)

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: _mol(df, self.in_column)["smiles"]}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(_no_mol(df, self.in_column), NO_MOL)]


@dataclass
class _FromMol(RowLink):
    """A value of a molecule, in Python."""

    in_column: InColumn = "ROMol"
    out_column: str = ""
    kind = "string"

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return f"`{self.out_column}` {self.kind}"

    def value(self, mol: dict) -> object:
        raise NotImplementedError

    def row_apply(self, row: dict, log: RowLogger) -> dict:
        return {self.out_column: self.value(_plain(row[self.in_column]))}


class _Canonical(_FromMol):
    def value(self, mol: dict) -> str:
        return S.canonical(mol)


class _LogP(_FromMol):
    kind = "double"

    def value(self, mol: dict) -> float:
        return logp(mol)


@dataclass
class _MolLink(ColumnLink):
    in_column: InColumn = "ROMol"
    out_column: str = ""

    def value(self, mol: Column) -> Column:
        raise NotImplementedError

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: self.value(_mol(df, self.in_column))}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(_no_mol(df, self.in_column), NO_MOL)]


@register
@dataclass
class HeavyAtomCount(_MolLink):
    """Number of atoms that are no hydrogen."""

    out_column: str = "HeavyAtomCount"

    def value(self, mol: Column) -> Column:
        return M.heavy_atoms(mol)


@register
@dataclass
class HeteroAtomRatio(_MolLink):
    """Share of heavy atoms that are no carbon."""

    out_column: str = "HeteroAtomRatio"

    def value(self, mol: Column) -> Column:
        return M.hetero_ratio(mol)


@register
@dataclass
class ElementsInList(_MolLink):
    """Whether all elements are among the allowed ones."""

    out_column: str = "ElementsAllowed"
    allowed_elements: list[int] = field(default_factory=lambda: [6, 7, 8, 9, 16, 17, 35])

    def __post_init__(self) -> None:
        self.allowed_elements = sorted(self.allowed_elements)

    def value(self, mol: Column) -> Column:
        return M.elements_in(mol, self.allowed_elements)


def _plain(mol: object) -> dict:
    if hasattr(mol, "asDict"):
        mol = mol.asDict(True)
    if not isinstance(mol, dict):
        raise TypeError("not a molecule")
    return {"atoms": [dict(a) for a in mol["atoms"]], "bonds": [dict(b) for b in mol["bonds"]], "smiles": mol["smiles"]}


@register
@dataclass
class LongestAliphaticChain(_MolLink):
    """Length of the longest chain of CH2; at or above the maximum it is 0, or the maximum with saturate."""

    out_column: str = "LongestAliphaticChain"
    max_chain_length: int = 11
    saturate: bool = False

    def value(self, mol: Column) -> Column:
        return F.when(mol["chain"] < self.max_chain_length, mol["chain"]).otherwise(F.lit(self.max_chain_length if self.saturate else 0))


# what can be computed here: over the molecule's columns, and MolLogP in Python
DESCRIPTORS = {
    "MolWt": M.weight,
    "HeavyAtomCount": M.heavy_atoms,
    "NumHeteroatoms": M.hetero_atoms,
    "NumHDonors": M.donors,
    "NumHAcceptors": M.acceptors,
    "RingCount": M.rings,
}


@register
@dataclass
class RDKitDescriptors(ColumnLink):
    """A column for each descriptor."""

    in_column: InColumn = "ROMol"
    descriptors: list[str] = field(default_factory=lambda: ["MolWt", "MolLogP", "NumHAcceptors", "NumHDonors"])

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        unknown = [d for d in self.descriptors if d not in DESCRIPTORS and d != "MolLogP"]
        if unknown:
            raise ImportError(f"descriptors {unknown} need RDKit, which is not installed")
        out = compile_rows([_LogP(self.in_column, "MolLogP")], df, ctx) if "MolLogP" in self.descriptors else df
        out = super().compile(out, ctx)
        last = {d: None for d in self.descriptors} | {ERROR: None}
        return out.select(*(c(n) for n in out.columns if n not in last or n in df.columns), *(c(n) for n in last if n not in df.columns))

    def sets(self) -> set[str]:
        return set(self.descriptors)

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        mol = _mol(df, self.in_column)
        return {d: DESCRIPTORS[d](mol).cast("double") for d in self.descriptors if d != "MolLogP"}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(_no_mol(df, self.in_column), NO_MOL)]


@register
@dataclass
class RemoveStereoMol(_MolLink):
    """Molecules without stereo marks."""

    out_column: str = "ROMol"

    def value(self, mol: Column) -> Column:
        return M.without_stereo(mol)


@register
@dataclass
class RemoveStereoSmiles(ColumnLink):
    """SMILES without `@`."""

    in_column: InColumn = "Smiles"
    out_column: str = "Smiles"

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: F.replace(c(self.in_column).cast("string"), F.lit("@"), F.lit(""))}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(c(self.in_column).isNull(), "TypeError: not a string")]


@register
@dataclass
class NumberOfTokens(ColumnLink):
    """Number of atom-level tokens of a SMILES, valid or not."""

    in_column: InColumn = "Smiles"
    out_column: str = "NumTokens"

    def exprs(self, df: DataFrame) -> dict[str, Column]:
        return {self.out_column: M.token_count(c(self.in_column).cast("string"))}

    def errors(self, df: DataFrame) -> list[tuple[Column, str | Column]]:
        return [(c(self.in_column).isNull(), "TypeError: not a string")]


def parent(mol: dict) -> dict:
    """Approximate parent: largest fragment without isotopes, stereo and simple charges."""
    part = max(S.fragments(mol), key=lambda f: (sum(mol["atoms"][i]["z"] > 1 for i in f), -f[0]), default=[])
    place = {v: i for i, v in enumerate(part)}
    atoms = [dict(mol["atoms"][v], isotope=0, chiral="") for v in part]
    bonds = [dict(b, a=place[b["a"]], b=place[b["b"]], dir="") for b in mol["bonds"] if b["a"] in place]
    near = S.neighbours(len(atoms), bonds)
    for i, a in enumerate(atoms):
        if a["charge"] > 0 and a["h"] >= a["charge"]:
            a["h"], a["charge"] = a["h"] - a["charge"], 0
        elif a["charge"] < 0 and a["z"] in (7, 8, 16) and not any(atoms[w]["charge"] > 0 for w, _ in near[i]):
            a["h"], a["charge"] = a["h"] - a["charge"], 0
    out = S.counted({"atoms": atoms, "bonds": bonds, "smiles": ""})
    return out | {"smiles": S.write(out)}


@register
@dataclass
class SuperParent(RowLink):
    """Approximate parent molecules: largest fragment, no isotopes, stereo or simple charges."""

    in_column: InColumn = "ROMol"
    out_column: str = "ROMol"
    maxTautomers: int = 0

    def __post_init__(self) -> None:
        if self.maxTautomers:
            raise ImportError("tautomers need RDKit, which is not installed")

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return f"`{self.out_column}` {M.MOL}"

    def row_apply(self, row: dict, log: RowLogger) -> dict:
        return {self.out_column: parent(_plain(row[self.in_column]))}
