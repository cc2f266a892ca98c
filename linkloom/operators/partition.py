"""Applying a link to contiguous pieces of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from linkloom.plans.base import ROW_ID, Context, Link, register
from linkloom.plans.rows import pieces


@dataclass
class PartitionProcessorBase(Link):
    """Splits a table in pieces, applies a link to each, and puts them together."""

    link: Link
    partition_size: int | None = None
    num_partitions: int | None = None
    order_by: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.partition_size and self.num_partitions:
            raise ValueError("give partition_size or num_partitions, not both")

    @property
    def row_local(self) -> bool:
        return self.link.row_local

    def children(self) -> list[Link]:
        return [self.link]

    def spread(self, df: DataFrame) -> DataFrame:
        return df

    def compile(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not (self.partition_size or self.num_partitions):
            raise ValueError("partition_size or num_partitions is needed")
        if self.link.row_local:  # pieces make no difference
            return self.link.apply(self.spread(df), ctx)
        name = f"__piece{len(ctx.scope)}__"
        cutup = pieces(df, name, order_by=self.order_by, scope=ctx.scope, size=self.partition_size, number=self.num_partitions)
        out = self.link.apply(self.spread(cutup), Context([*ctx.scope, name], ctx.hidden, ctx.keep, ctx.dry))
        if ROW_ID in out.columns and ROW_ID not in df.columns:
            out = out.drop(ROW_ID)
        return out.drop(name) if name in out.columns else out


@register
@dataclass
class SerialPartitionProcessor(PartitionProcessorBase):
    """Pieces one after another: Spark's tasks bound the memory."""


@register
@dataclass
class ParallelPartitionProcessor(PartitionProcessorBase):
    """Pieces at the same time; num_processes is a hint for the number of tasks."""

    num_processes: int | None = None

    def spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.num_processes) if self.num_processes and self.link.row_local and not df.isStreaming else df


__all__ = ["PartitionProcessorBase", "SerialPartitionProcessor", "ParallelPartitionProcessor"]
