"""Column expressions over message time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import patterns as P


def period(hour: Column) -> Column:
    """Label of the hour bucket, not zero padded except at midnight."""
    text = hour.cast("string")
    return (
        F.when(hour == 23, "23-00")
        .when(hour == 0, "00-1")
        .otherwise(F.concat(text, F.lit("-"), (hour + 1).cast("string")))
    )


def month_label(month: Column, year: Column) -> Column:
    return F.concat_ws("-", month, year.cast("string"))


def iso(date: Column) -> Column:
    """ISO text of a time, whatever the session's time zone."""
    return F.translate(date.cast("string"), " ", "T")


def parts(date: Column) -> dict[str, Column]:
    """The calendar columns of the message table."""
    return {
        "only_date": F.to_date(date),
        "year": F.year(date),
        "month_num": F.month(date),
        "month": F.date_format(date, "MMMM"),
        "day": F.dayofmonth(date),
        "day_name": F.date_format(date, "EEEE"),
        "hour": F.hour(date),
        "minute": F.minute(date),
        "period": period(F.hour(date)),
    }


def header_time(header: Column) -> Column:
    """Time of a record header; null when it is not a valid day/month/4-digit-year, 12-hour time."""

    def time(piece: Column) -> Column:
        number = [piece.getItem(i).try_cast("int") for i in range(5)]
        day, month, year, hour, minute = number
        valid = (F.length(piece.getItem(2)) == 4) & hour.between(1, 12)
        hour24 = hour % 12 + F.when(piece.getItem(5) == "pm", 12).otherwise(0)
        return F.when(
            valid, F.try_make_timestamp_ntz(year, month, day, hour24, minute, F.lit(0))
        )

    # As the argument of a lambda the pieces are made once, also in a filter.
    return F.get(F.transform(F.array(F.split(header, f"(?:[/,:-]|{P.WS})+")), time), F.lit(0))
