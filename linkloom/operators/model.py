"""Links that apply a pickled model, and a server around one."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from linkloom.plans.base import BatchLink, InColumn, RowLogger, register


@lru_cache(maxsize=8)
def _model(data: bytes) -> Any:
    return pickle.loads(data)  # noqa: S301  the caller has allowed it


@dataclass
class ModelLink(BatchLink):
    """A model's predictions, batch by batch; the model is loaded once per worker.

    If a batch fails its rows are predicted one by one.  Unpickling runs code of
    the file, so it has to be allowed."""

    model_file: str
    out_column: str = "skmol_prediction"
    allow_pickle: bool = False

    def __post_init__(self) -> None:
        if not self.allow_pickle:
            raise ValueError("set allow_pickle=True to load a pickled model that you trust")

    def bind(self, spark: SparkSession) -> None:
        """Reads the file where Spark can; workers get its bytes and unpickle them once."""
        rows = spark.read.format("binaryFile").load(self.model_file).select("content").collect()
        if len(rows) != 1:
            raise ValueError(f"{self.model_file} is no file")
        self._data = bytes(rows[0][0])

    def needs(self) -> list[str]:
        return [self.in_column]

    def output(self) -> str:
        return f"`{self.out_column}` double"

    def batch_apply(self, columns: dict[str, list], log: RowLogger) -> dict[str, list]:
        rows = [x.asDict(True) if hasattr(x, "asDict") else x for x in columns[self.in_column]]
        return {self.out_column: [float(y) for y in _model(self._data).predict(rows)]}


@register
@dataclass
class ScikitMolMolModel(ModelLink):
    """Predictions from molecules."""

    in_column: InColumn = "ROMol"


@register
@dataclass
class ScikitMolSmilesModel(ModelLink):
    """Predictions from SMILES."""

    in_column: InColumn = "Smiles"


@dataclass
class ScikitMolModelServer:
    """Predictions for a list: for the driver, so the list is small."""

    model_file: str
    model_type: str = "smiles"
    allow_pickle: bool = False

    def predict(self, values: list) -> list:
        if self.model_type not in ("smiles", "mol"):
            raise ValueError("model_type must be smiles or mol")
        kind = ScikitMolSmilesModel if self.model_type == "smiles" else ScikitMolMolModel
        link = kind(self.model_file, allow_pickle=self.allow_pickle)
        if self.model_type == "mol":
            from linkloom.functions.molecule import MOL

            schema = f"i int, `{link.in_column}` {MOL}"
        else:
            schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField(link.in_column, T.StringType())])
        df = SparkSession.active().createDataFrame(list(enumerate(values)), schema)
        return [r[link.out_column] for r in link(df).orderBy("i").collect()]
