"""Composable, self-describing DataFrame links compiled to Spark plans."""

from linkloom.operators.chem import (
    ElementsInList,
    HeavyAtomCount,
    HeteroAtomRatio,
    LongestAliphaticChain,
    MolFromSmiles,
    MolToSmiles,
    NumberOfTokens,
    PandasAddMoleculeColumn,
    RDKitDescriptors,
    RemoveStereoMol,
    RemoveStereoSmiles,
    SuperParent,
)
from linkloom.operators.custom import LinearModelDf, LinearModelRow
from linkloom.operators.errors import StripErrors
from linkloom.operators.model import ScikitMolModelServer, ScikitMolMolModel, ScikitMolSmilesModel
from linkloom.operators.partition import ParallelPartitionProcessor, SerialPartitionProcessor
from linkloom.operators.table import DfEval, DropColumns, DropDuplicates, DropTable, KeepColumns, NullLink, Query, RenameColumns, RowEval
from linkloom.plans.base import BatchLink, Chain, ColumnLink, Link, RowLink, RowLogger, UnionLink, register
from linkloom.sources.files import FromFile, ToFile
from linkloom.toolbox import LinkToolbox, toolbox

__all__ = [n for n in dir() if not n.startswith("_")]
