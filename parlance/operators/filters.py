"""Row filters. Each takes and returns a message table, for use with DataFrame.transform."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import text

Filter = Callable[[DataFrame], DataFrame]


def for_user(user: str = S.OVERALL) -> Filter:
    return lambda df: df if user == S.OVERALL else df.where(F.col("user") == user)


def without_notifications(df: DataFrame) -> DataFrame:
    return df.where(F.col("user") != S.NOTIFICATION)


def is_media(marker: str = S.MEDIA_MARKER) -> Column:
    return F.col("message") == marker


def without_media(marker: str = S.MEDIA_MARKER) -> Filter:
    return lambda df: df.where(~is_media(marker))


def without_blank(stripped: bool = True) -> Filter:
    """Drop blank messages; with stripped=False only the empty string counts as blank."""
    return lambda df: df.where((text.strip(F.col("message")) if stripped else F.col("message")) != "")


def without_system(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_system_message")) if "is_system_message" in df.columns else df


def _day(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def valid_range(start: str | date, end: str | date) -> bool:
    """True when start is not after end; a string that is no date raises."""
    return _day(start) <= _day(end)


def between_dates(start: str | date, end: str | date, column: str = "only_date") -> Filter:
    """Both ends inclusive."""
    if not valid_range(start, end):
        raise ValueError(f"range starts after it ends: {start} > {end}")
    return lambda df: df.where(F.col(column).between(F.lit(_day(start)), F.lit(_day(end))))


def preset(name: str, as_of: str | date) -> Filter:
    """One of the presets, counted back from as_of; both ends inclusive. 'All Time' keeps everything."""
    if name == "All Time":
        return lambda df: df
    last = _day(as_of)
    return between_dates(last - timedelta(days=S.PRESET_DAYS[name]), last)


def preset_ranges(as_of: str | date, messages: DataFrame | None = None) -> dict[str, tuple[Column, Column]]:
    """(start, end) of every preset as column expressions; with a table, also its own first and last day."""
    last = F.lit(_day(as_of))
    ranges = {name: (F.date_sub(last, days), last) for name, days in S.PRESET_DAYS.items()}
    if messages is not None:
        ends = messages.agg(F.min("only_date").alias("first"), F.max("only_date").alias("last"))
        ranges["All Time"] = (ends.select("first").scalar(), ends.select("last").scalar())
    return ranges


def in_retrieval_range(date_column: Column, start: Column, end: Column, end_inclusive: bool = False) -> Column:
    """Range test on message times: from the first moment of start up to, by default, the first of end.

    The end day itself is left out unless end_inclusive is set; a missing bound does not restrict.
    """
    stop = F.date_add(end, 1) if end_inclusive else end
    return F.coalesce(date_column >= start.cast("timestamp_ntz"), F.lit(True)) & F.coalesce(
        date_column < stop.cast("timestamp_ntz"), F.lit(True)
    )


def indexable(df: DataFrame) -> DataFrame:
    """What goes into the retrieval index: no notifications, media or blanks."""
    return df.transform(without_notifications).transform(without_media()).transform(without_blank())


def analysable(start: str | date, end: str | date) -> Filter:
    """What sentiment and topics look at: a date range without notifications, media and empty messages."""
    return lambda df: (
        df.transform(between_dates(start, end))
        .transform(without_notifications)
        .transform(without_media())
        .transform(without_blank(stripped=False))
    )
