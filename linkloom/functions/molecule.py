"""Molecules as nested columns, and expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import smiles as S

MOL = (
    "struct<atoms:array<struct<z:int,aromatic:boolean,charge:int,isotope:int,h:int,ring:boolean,chiral:string>>,"
    "bonds:array<struct<a:int,b:int,order:double,dir:string>>,smiles:string,parts:int,chain:int>"
)
# Fixed value: atom-level tokens of a SMILES string, as published for reaction prediction models.
TOKENS = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"


def heavy_atoms(mol: Column) -> Column:
    return F.size(F.filter(mol["atoms"], lambda a: a["z"] > 1))


def hetero_atoms(mol: Column) -> Column:
    return F.size(F.filter(mol["atoms"], lambda a: ~a["z"].isin(1, 6)))


def hetero_ratio(mol: Column) -> Column:
    heavy = heavy_atoms(mol)
    return F.when(heavy == 0, F.lit(0.0)).otherwise(hetero_atoms(mol) / heavy)


def elements_in(mol: Column, allowed: list[int]) -> Column:
    return F.forall(mol["atoms"], lambda a: a["z"].isin(*allowed))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def weight(mol: Column) -> Column:
    """Molecular weight; an isotope counts with its mass number."""
    table = F.create_map(*(x for z, w in S.weights_by_number().items() for x in (F.lit(z), F.lit(w))))
    own = lambda a: F.when(a["isotope"] > 0, a["isotope"].cast("double")).otherwise(F.try_element_at(table, a["z"]))
    return _sum(F.transform(mol["atoms"], lambda a: own(a) + a["h"] * S.WEIGHTS["H"]))


def donors(mol: Column) -> Column:
    return F.size(F.filter(mol["atoms"], lambda a: a["z"].isin(7, 8) & (a["h"] > 0)))


def acceptors(mol: Column) -> Column:
    return F.size(F.filter(mol["atoms"], lambda a: a["z"].isin(7, 8) & (a["charge"] <= 0) & ~(a["aromatic"] & (a["h"] > 0))))


def rings(mol: Column) -> Column:
    return F.size(mol["bonds"]) - F.size(mol["atoms"]) + mol["parts"]


def without_stereo(mol: Column) -> Column:
    atoms = F.transform(mol["atoms"], lambda a: a.withField("chiral", F.lit("")))
    bonds = F.transform(mol["bonds"], lambda b: b.withField("dir", F.lit("")))
    return F.when(mol.isNotNull(), F.struct(atoms.alias("atoms"), bonds.alias("bonds"), F.regexp_replace(mol["smiles"], r"[@/\\]", "").alias("smiles"), mol["parts"].alias("parts"), mol["chain"].alias("chain")))


def token_count(smiles: Column) -> Column:
    return F.size(F.regexp_extract_all(smiles, F.lit(TOKENS), 1))
