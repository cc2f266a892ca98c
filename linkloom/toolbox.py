"""Catalogue of links."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans import base

_MODULES = ["linkloom.operators.table", "linkloom.operators.custom", "linkloom.operators.errors", "linkloom.operators.partition", "linkloom.operators.chem", "linkloom.operators.model", "linkloom.sources.files"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(m)


class LinkToolbox:
    """Links by name, and as a table of module, class, tooltip and parameters."""

    def __init__(self) -> None:
        load_all()

    @property
    def modules(self) -> list[str]:
        return sorted({c.__module__ for c in base.registered().values()})

    @property
    def class_names(self) -> list[str]:
        return sorted(base.registered())

    def __getitem__(self, name: str) -> type:
        return base.registered()[name]

    def register_class(self, cls: type) -> type:
        return base.register(cls)

    def rows(self) -> list[tuple[str, str, str, str]]:
        import inspect

        return sorted((c.__module__, n, c.tooltip(), str(inspect.signature(c))) for n, c in base.registered().items())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "module string, class string, tooltip string, api string")


_toolbox: LinkToolbox | None = None


def toolbox() -> LinkToolbox:
    global _toolbox
    _toolbox = _toolbox or LinkToolbox()
    return _toolbox


def assert_import_dependency(package: str, install_name: str | None = None) -> None:
    try:
        importlib.import_module(package)
    except ImportError:
        raise ImportError(f"{package} is needed; install {install_name or package}") from None
