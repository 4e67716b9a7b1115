"""Counts, timelines, heatmap and user rankings.

`by` adds grouping columns (usually chat_id), so one call serves every chat at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import calendar, text
from parlance.operators import filters
from parlance.operators.ordering import first_n, with_total

By = Sequence[str]


def overview(messages: DataFrame, by: By = ()) -> DataFrame:
    """All rows, and distinct users without the notification sender."""
    person = F.when(F.col("user") != S.NOTIFICATION, F.col("user"))
    return messages.groupBy(*by).agg(F.count("*").alias("messages"), F.count_distinct(person).alias("users"))


def key_metrics(messages: DataFrame, user: str = S.OVERALL, by: By = (), media_marker: str = S.MEDIA_MARKER) -> DataFrame:
    """Messages and words of real, non-blank, non-system rows; media and links of all rows of the user."""
    message = F.col("message")
    counted = (F.col("user") != S.NOTIFICATION) & (text.strip(message) != "")
    if "is_system_message" in messages.columns:
        counted = counted & ~F.col("is_system_message")
    words = F.sum(F.when(counted, text.word_count(message)).otherwise(0))
    return (
        messages.transform(filters.for_user(user))
        .groupBy(*by)
        .agg(
            F.count_if(counted).alias("messages"),
            F.coalesce(words, F.lit(0)).alias("words"),
            F.count_if(filters.is_media(media_marker)).alias("media"),
            F.coalesce(F.sum(text.url_count(message)), F.lit(0)).alias("links"),
        )
    )


def basic_stats(messages: DataFrame, user: str = S.OVERALL, by: By = (), media_marker: str = S.MEDIA_MARKER) -> DataFrame:
    """Rows, words, media and links over every row of the user."""
    message = F.col("message")
    return (
        messages.transform(filters.for_user(user))
        .groupBy(*by)
        .agg(
            F.count("*").alias("messages"),
            F.coalesce(F.sum(text.word_count(message)), F.lit(0)).alias("words"),
            F.count_if(filters.is_media(media_marker)).alias("media"),
            F.coalesce(F.sum(text.url_count(message)), F.lit(0)).alias("links"),
        )
    )


def users(messages: DataFrame, by: By = ()) -> DataFrame:
    """Distinct users in name order, without the notification sender."""
    people = messages.transform(filters.without_notifications)
    return people.select(*by, "user").distinct().orderBy(*by, "user")


def monthly_timeline(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Messages per calendar month, in time order, with a Month-Year label."""
    keys = [*by, "year", "month_num", "month"]
    return (
        messages.transform(filters.for_user(user))
        .groupBy(*keys)
        .agg(F.count("*").alias("messages"))
        .withColumn("time", calendar.month_label(F.col("month"), F.col("year")))
        .orderBy(*by, "year", "month_num")
    )


def daily_timeline(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Messages per day that has any, in time order."""
    chosen = messages.transform(filters.for_user(user))
    return chosen.groupBy(*by, "only_date").agg(F.count("*").alias("messages")).orderBy(*by, "only_date")


def daily_counts_between(messages: DataFrame, start: str | date, end: str | date, by: By = ()) -> DataFrame:
    """Messages per day inside a date range."""
    return daily_timeline(messages.transform(filters.between_dates(start, end)), by=by)


def _value_counts(messages: DataFrame, column: str, by: By) -> DataFrame:
    counts = messages.groupBy(*by, column).agg(F.count("*").alias("messages"))
    return counts.orderBy(*by, F.desc("messages"), column)


def weekday_activity(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    return _value_counts(messages.transform(filters.for_user(user)), "day_name", by)


def month_activity(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Messages per month name, years taken together."""
    return _value_counts(messages.transform(filters.for_user(user)), "month", by)


def activity_cells(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Long form of the heatmap: one row per observed weekday and hour bucket."""
    chosen = messages.transform(filters.for_user(user))
    return chosen.groupBy(*by, "day_name", "period").agg(F.count("*").alias("messages"))


def activity_heatmap(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """One row per weekday, one column per hour bucket in clock order, 0 where nothing was sent."""
    cells = activity_cells(messages, user, by)
    grid = cells.groupBy(*by, "day_name").pivot("period", S.PERIODS).agg(F.first("messages"))
    return grid.na.fill(0, S.PERIODS)


def busiest_users(messages: DataFrame, n: int = 5, by: By = ()) -> DataFrame:
    """The n senders with most rows; the notification sender counts as one."""
    counts = messages.groupBy(*by, "user").agg(F.count("*").alias("messages"))
    return first_n(counts, n, [F.desc("messages"), F.col("user")], by)


def user_share(messages: DataFrame, by: By = ()) -> DataFrame:
    """Each sender's percentage of all rows; percent is unrounded, percent_shown has two decimals."""
    counts = messages.groupBy(*by, "user").agg(F.count("*").alias("messages"))
    share = F.col("messages") / F.col("_all") * 100
    return with_total(counts, F.sum("messages"), "_all", by).select(
        *by, F.col("user").alias("name"), "messages", share.alias("percent"), F.bround(share, 2).alias("percent_shown")
    )


def top_user_share(messages: DataFrame, n: int = 10, by: By = ()) -> DataFrame:
    """The n busiest real users and each one's percentage of those n users' messages."""
    top = busiest_users(messages.transform(filters.without_notifications), n, by)
    share = F.col("messages") / F.col("_all") * 100
    return with_total(top, F.sum("messages"), "_all", by).select(
        *by, "user", "messages", share.alias("percent"), F.bround(share, 2).alias("percent_shown")
    )


def user_daily_stats(messages: DataFrame, user: str, by: By = ()) -> DataFrame:
    """One user's total, and mean, largest and smallest number of messages over the days with any."""
    days = messages.transform(filters.for_user(user)).groupBy(*by, "only_date").agg(F.count("*").alias("n"))
    return days.groupBy(*by).agg(
        F.sum("n").alias("total_messages"),
        F.avg("n").alias("daily_average"),
        F.max("n").alias("peak_day"),
        F.min("n").alias("quiet_day"),
    )


def talkativeness(messages: DataFrame, by: By = ()) -> DataFrame:
    """Per real user: messages, messages per day of the span from first to last message, words."""
    span = F.greatest(F.lit(1), F.datediff(F.max("only_date"), F.min("only_date")) + 1)
    return (
        messages.transform(filters.without_notifications)
        .groupBy(*by, "user")
        .agg(
            F.count("*").alias("messages"),
            (F.count("*") / span).alias("avg_daily"),
            F.sum(text.word_count(F.col("message"))).alias("words"),
        )
        .orderBy(*by, F.desc("messages"), "user")
    )


def top_user_trend(messages: DataFrame, n: int = 3, by: By = ()) -> DataFrame:
    """Daily messages of the n busiest real users; days without messages are absent."""
    daily = (
        messages.transform(filters.without_notifications)
        .groupBy(*by, "user", "only_date")
        .agg(F.count("*").alias("messages"))
    )
    totals = daily.groupBy(*by, "user").agg(F.sum("messages").alias("messages"))
    top = first_n(totals, n, [F.desc("messages"), F.col("user")], by)
    return daily.join(top.select(*by, "user"), [*by, "user"], "left_semi").orderBy(*by, "user", "only_date")
