"""Order-dependent building blocks that stay balanced when one chat holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRIPE_ROWS = 1 << 20


def stripe_of(seq: Column, rows: int = STRIPE_ROWS) -> Column:
    """Stripe number of a sequence number; a stripe holds at most `rows` rows of a chat."""
    return F.floor(seq.cast("decimal(20,0)") / rows).cast("long")


def first_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The first n rows, overall or per group, with their rank.

    Without groups this is a distributed top-n followed by numbering n rows. With groups the rank filter is
    applied before the shuffle too, so a large group sends at most n rows per task.
    """
    if not by:
        return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def with_total(df: DataFrame, total: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add an aggregate over all rows, or over the row's group, as a column."""
    if not by:
        return df.withColumn(name, df.agg(total.alias(name)).scalar())
    return df.join(df.groupBy(*by).agg(total.alias(name)), list(by))


def number_rows(
    df: DataFrame, by: Sequence[str] = ("chat_id",), seq: str = "seq", name: str = "pos", stripe_rows: int = STRIPE_ROWS
) -> DataFrame:
    """Position 1, 2, ... of each row in its chat, in seq order.

    A chat is cut into stripes of consecutive sequence numbers. Rows are numbered inside their stripe, and the
    row counts of the earlier stripes are added, so no task ever holds a whole chat.
    """
    striped = df.withColumn("_stripe", stripe_of(F.col(seq), stripe_rows))
    keys = [*by, "_stripe"]
    earlier = W.partitionBy(*by).orderBy("_stripe").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        striped.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = striped.withColumn("_inside", F.row_number().over(W.partitionBy(*keys).orderBy(seq)))
    return (
        inside.join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_stripe", "_before", "_inside")
    )
