"""Who answers whom, and how fast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.operators.ordering import STRIPE_ROWS, stripe_of


def with_previous(messages: DataFrame, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """chat_id, date, seq, user and the date and user of the row before it in (date, seq) order.

    Message times have minute resolution. Rows are linked inside a minute (cut into stripes of sequence numbers) by one
    window over the table. The first and last row of each such slice come from an aggregate that combines before its
    shuffle; they are linked inside their hour, and the ends of the hours inside the chat. Group sizes are bounded by the
    stripe and by the calendar, so a chat with most of the rows is spread over many tasks, whatever its busiest hour or
    minute.
    """
    placed = messages.select("chat_id", "date", "seq", "user", stripe_of(F.col("seq"), stripe_rows).alias("stripe"))
    inside = W.partitionBy("chat_id", "date", "stripe").orderBy("seq")
    close = placed.withColumns({"previous_date": F.lag("date").over(inside), "previous_user": F.lag("user").over(inside)})

    row = F.struct("date", "seq", "user")
    slices = placed.groupBy("chat_id", "date", "stripe").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    slices = slices.select("chat_id", F.date_trunc("hour", "date").alias("hour"), "first", "last")
    hours = slices.groupBy("chat_id", "hour").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    def linked(ends: DataFrame, *keys: str) -> DataFrame:
        """The first row of every slice, with the last row of the slice before it."""
        before = F.lag("last").over(W.partitionBy("chat_id", *keys).orderBy("first"))
        met = ends.withColumn("before", before).where(F.col("before").isNotNull())
        return met.select(
            "chat_id", "first.*", F.col("before.date").alias("previous_date"), F.col("before.user").alias("previous_user")
        )

    within = close.where(F.col("previous_date").isNotNull()).drop("stripe")
    return within.unionByName(linked(slices, "hour")).unionByName(linked(hours))


def response_pairs(messages: DataFrame, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """Rows that follow another user's message, with the minutes in between.

    The row before must not be a notification; the row itself may be one.
    """
    minutes = F.timestamp_diff("SECOND", F.col("previous_date"), F.col("date")) / 60
    return (
        with_previous(messages, stripe_rows)
        .where((F.col("user") != F.col("previous_user")) & (F.col("previous_user") != S.NOTIFICATION))
        .select("chat_id", "seq", "user", "previous_user", minutes.alias("minutes"))
    )


def response_stats(messages: DataFrame, by: Sequence[str] = (), stripe_rows: int = STRIPE_ROWS, exact: bool = True) -> DataFrame:
    """Mean, median and number of responses per responder, fastest mean first.

    The exact median keeps one counter per distinct waiting time in whole minutes; exact=False uses a sketch.
    """
    minutes = F.col("minutes")
    median = F.median(minutes) if exact else F.percentile_approx(minutes, 0.5)
    return (
        response_pairs(messages, stripe_rows)
        .groupBy(*by, "user")
        .agg(F.avg(minutes).alias("mean_minutes"), median.alias("median_minutes"), F.count("*").alias("responses"))
        .orderBy(*by, "mean_minutes", "user")
    )
