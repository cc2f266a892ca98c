"""Row identity: ids in input order, dense numbers, contiguous pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import ROW_ID, c, fresh, stable


def with_row_id(df: DataFrame) -> DataFrame:
    """Ids that grow in input order, unless there are some."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def order_of(df: DataFrame, order_by: list[str]) -> list[Column]:
    return [c(n).asc_nulls_first() for n in order_by] if order_by else [F.col(ROW_ID)]


def pieces(df: DataFrame, name: str, *, order_by: list[str], scope: list[str], size: int | None, number: int | None) -> DataFrame:
    """df with the number of each row's contiguous piece, from 0.

    By size there are n // size + 1 pieces, by number as many; the first
    n % pieces of them have one row more.  Rows are dealt out by range over all
    of the order, ties by row id, so a frequent value is no task of its own; the
    sorted table is kept, and of its partitions only the counts go to the driver."""
    df = with_row_id(df)
    order = [*(order_of(df, order_by) if order_by else []), F.col(ROW_ID)]
    if scope:  # pieces of pieces: counted where they are
        within = Window.partitionBy(*scope)
        n, at = F.count("*").over(within), F.row_number().over(within.orderBy(*order)) - 1
        k = F.lit(number).cast("long") if number else F.floor(n / size) + 1
        return df.withColumn(name, _piece(at, n, k))
    (tmp,) = fresh(df, f"{name}at")
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *order).sortWithinPartitions(*order)
    dealt = stable(dealt.withColumn(tmp, F.monotonically_increasing_id()))  # partition << 33 | place
    part = F.shiftright(tmp, 33).cast("int")
    counts = {r["p"]: r["count"] for r in dealt.groupBy(part.alias("p")).count().collect()}
    before, start = 0, []
    for p in range(max(counts, default=-1) + 1):
        start.append(before)
        before += counts.get(p, 0)
    at = F.array(*(F.lit(x).cast("long") for x in start or [0]))[part] + F.col(tmp).bitwiseAND(F.lit((1 << 33) - 1))
    k = number or before // size + 1
    return dealt.withColumn(name, _piece(at, F.lit(before).cast("long"), F.lit(k).cast("long"))).drop(tmp)


def _piece(at: Column, n: Column, k: Column) -> Column:
    small = F.floor(n / k)
    longer = n - small * k
    head = longer * (small + 1)
    return F.when(at < head, F.floor(at / (small + 1))).otherwise(longer + F.floor((at - head) / F.greatest(small, F.lit(1)))).cast("long")
