"""Derived columns of the message table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import calendar, text


def is_system_message(user: Column, message: Column) -> Column:
    """System sender, or one of the system phrases anywhere in the sender or the message."""
    sender, body = F.lower(user), F.lower(message)
    phrases = [side.contains(phrase) for phrase in S.SYSTEM_PHRASES for side in (body, sender)]
    return sender.isin(S.SYSTEM_USERS) | reduce(or_, phrases)


def message_id(chat_id: Column, seq: Column) -> Column:
    """Stable id: the same row gets the same id in every run."""
    return F.sha2(F.concat_ws(":", chat_id, seq.cast("string")), 256)


def enrich(messages: DataFrame) -> DataFrame:
    """chat_id, seq, date, user, message (and message_id, when there) -> the full message table."""
    chat_id, seq, date, user, message = (F.col(c) for c in ("chat_id", "seq", "date", "user", "message"))
    given = F.col("message_id") if "message_id" in messages.columns else message_id(chat_id, seq)
    derived = {
        **calendar.parts(date),
        "message_id": given,
        "is_system_message": is_system_message(user, message),
        "language": text.language(message),
        "message_length": F.length(message),
    }
    return messages.withColumns(derived).select(*S.MESSAGES.fieldNames())
