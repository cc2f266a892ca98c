"""Links on streams: row-local chains run unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkloom.plans.base import Link, UnionLink


def _local(link: Link) -> bool:
    if isinstance(link, UnionLink):
        return link.link1.row_local and link.link2.row_local
    return link.row_local if not link.children() else all(_local(x) for x in link.children())


def apply_stream(link: Link, df: DataFrame) -> DataFrame:
    """link on a stream; links that need the order of all rows are refused."""
    if df.isStreaming and not _local(link):
        raise ValueError(f"{type(link).__name__} needs rows of the whole table and can't run on a stream")
    return link(df)
