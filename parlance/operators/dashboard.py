"""Every count of the analytics page in one scan of the messages.

`totals` first counts by sender, day and hour bucket, with map-side combining, and then sums that much smaller table over
GROUPING SETS into one long table, one `part` for each set. `tables` reads the page's tables off its rows, so a stored
long table serves the whole page; text is split into words and links once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import calendar, text
from parlance.operators import filters
from parlance.operators.activity import By
from parlance.operators.ordering import first_n, with_total

MONTH = ("year", "month_num", "month")
PARTS = {
    "all": (),
    "users": ("user",),
    "days": ("only_date",),
    "months": MONTH,
    "weekdays": ("day_name",),
    "month_names": ("month",),
    "cells": ("day_name", "period"),
    "user_days": ("user", "only_date"),
}
KEYS = ("user", "only_date", *MONTH, "day_name", "period")
MEASURES = ("messages", "words", "counted_messages", "counted_words", "media", "links")


def totals(messages: DataFrame, user: str = S.OVERALL, by: By = (), media_marker: str = S.MEDIA_MARKER) -> DataFrame:
    """One row for each group of each part: by, part, KEYS (null where the part has no such key), MEASURES, first and last day.

    `counted` measures leave out notifications, blank and system messages, as the key metrics do. No messages: no rows.
    """
    message = F.col("message")
    counted = (F.col("user") != S.NOTIFICATION) & (text.strip(message) != "")
    if "is_system_message" in messages.columns:
        counted = counted & ~F.col("is_system_message")
    chosen = messages.transform(filters.for_user(user))
    split = chosen.select(*by, *KEYS, counted.alias("_counted"), text.word_count(message).alias("_words"), filters.is_media(media_marker).alias("_media"), text.url_count(message).alias("_links"))
    cube = split.groupBy(*by, *KEYS).agg(
        F.count("*").alias("messages"),
        F.coalesce(F.sum("_words"), F.lit(0)).cast("long").alias("words"),
        F.count_if("_counted").alias("counted_messages"),
        F.coalesce(F.sum(F.when(F.col("_counted"), F.col("_words"))), F.lit(0)).cast("long").alias("counted_words"),
        F.count_if("_media").alias("media"),
        F.coalesce(F.sum("_links"), F.lit(0)).cast("long").alias("links"),
    )
    cube = cube.withColumn("_day", F.col("only_date"))
    sums = [F.sum(m).alias(m) for m in MEASURES]
    days = [F.min("_day").alias("first_day"), F.max("_day").alias("last_day")]
    keys = [*by, *KEYS]
    sets = [[F.col(c) for c in (*by, *own)] for own in PARTS.values()]
    grouped = cube.groupingSets(sets, *[F.col(c) for c in keys]).agg(F.grouping_id().alias("_set"), *sums, *days)
    # The bits of a grouping id, first key highest, are set where a key is summed over.
    names = {sum(1 << (len(KEYS) - 1 - i) for i, key in enumerate(KEYS) if key not in own): name for name, own in PARTS.items()}
    part = F.coalesce(*[F.when(F.col("_set") == bits, F.lit(name)) for bits, name in names.items()])
    return grouped.select(*by, part.alias("part"), *KEYS, *MEASURES, "first_day", "last_day")


def tables(found: DataFrame, user: str = S.OVERALL, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The page's tables from totals (of the same user), in the shape of the single operators of `activity`."""

    def part(name: str) -> DataFrame:
        return found.where(F.col("part") == name)

    def ranked(name: str, column: str) -> DataFrame:
        return part(name).select(*by, column, "messages").orderBy(*by, F.desc("messages"), column)

    people = part("users").where(F.col("user") != S.NOTIFICATION)
    share = F.col("messages") / F.col("_all") * 100
    shown = [share.alias("percent"), F.bround(share, 2).alias("percent_shown")]
    label = calendar.month_label(F.col("month"), F.col("year"))
    grid = part("cells").groupBy(*by, "day_name").pivot("period", S.PERIODS).agg(F.first("messages"))
    numbers = part("all")
    page = {
        "users": people.select(*by, "user").orderBy(*by, "user"),
        "key_metrics": numbers.select(*by, F.col("counted_messages").alias("messages"), F.col("counted_words").alias("words"), "media", "links"),
        "basic_stats": numbers.select(*by, "messages", "words", "media", "links"),
        "monthly_timeline": part("months").select(*by, *MONTH, "messages", label.alias("time")).orderBy(*by, "year", "month_num"),
        "daily_timeline": part("days").select(*by, "only_date", "messages").orderBy(*by, "only_date"),
        "weekday_activity": ranked("weekdays", "day_name"),
        "month_activity": ranked("month_names", "month"),
        "activity_heatmap": grid.na.fill(0, S.PERIODS),
    }
    if user != S.OVERALL:
        days = part("days").groupBy(*by)
        page["user_daily_stats"] = days.agg(
            F.sum("messages").alias("total_messages"), F.avg("messages").alias("daily_average"), F.max("messages").alias("peak_day"), F.min("messages").alias("quiet_day")
        )
        return page
    everyone = part("users").select(*by, "user", "messages")
    top = first_n(people.select(*by, "user", "messages"), 10, [F.desc("messages"), F.col("user")], by)
    trend = first_n(people.select(*by, "user", "messages"), 3, [F.desc("messages"), F.col("user")], by).select(*by, "user")
    span = F.greatest(F.lit(1), F.datediff("last_day", "first_day") + 1)
    sender_days = part("user_days").where(F.col("user") != S.NOTIFICATION).select(*by, "user", "only_date", "messages")
    page["overview"] = part("users").groupBy(*by).agg(F.sum("messages").alias("messages"), F.count_if(F.col("user") != S.NOTIFICATION).alias("users"))
    page["busiest_users"] = first_n(everyone, 5, [F.desc("messages"), F.col("user")], by)
    page["user_share"] = with_total(everyone, F.sum("messages"), "_all", by).select(*by, F.col("user").alias("name"), "messages", *shown)
    page["top_user_share"] = with_total(top, F.sum("messages"), "_all", by).select(*by, "user", "messages", *shown)
    page["talkativeness"] = people.select(*by, "user", "messages", (F.col("messages") / span).alias("avg_daily"), "words").orderBy(*by, F.desc("messages"), "user")
    page["top_user_trend"] = sender_days.join(trend, [*by, "user"], "left_semi").orderBy(*by, "user", "only_date")
    return page
