"""The message-table contract and the fixed values that carry data meaning."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("chat_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("user", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("is_system_message", T.BooleanType()),
        T.StructField("only_date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month_num", T.IntegerType()),
        T.StructField("month", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("day_name", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("minute", T.IntegerType()),
        T.StructField("period", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("message_length", T.IntegerType()),
    ]
)

# Markers and names other parts compare against.
NOTIFICATION = "group_notification"
MEDIA_MARKER = "<Media omitted>"
OVERALL = "Overall"

# Senders and phrases that mark a row as a system message.
SYSTEM_USERS = ["group_notification", "meta ai", "system"]
SYSTEM_PHRASES = [
    "group notification",
    "added",
    "removed",
    "created group",
    "left",
    "calls are end-to-end encrypted",
    "learn more",
    "messages are generated by ai",
    "this message was deleted",
    "meta ai",
    "only people in this chat",
    "meta can",
]

# Transliterated Hindi and Bengali words that are folded to lower case.
HINGLISH_WORDS = ["kya", "haan", "nahi", "acha", "ache", "bhai", "yaar", "thik"]
BENGLISH_WORDS = ["tumi", "ami", "ache", "eita", "koto", "kothay"]
TRANSLITERATED_WORDS = HINGLISH_WORDS + BENGLISH_WORDS

# Stop words used when the single-file list is missing.
FALLBACK_STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at"]

# The seven emotion names and the three that count as positive / the four as negative. In alphabetical
# order because of the tie rule: of equal emotions the first in the alphabet leads.
EMOTIONS = ["anger", "concern", "enthusiasm", "excitement", "frustration", "joy", "sadness"]
POSITIVE_EMOTIONS = ["enthusiasm", "excitement", "joy"]
NEGATIVE_EMOTIONS = ["anger", "concern", "frustration", "sadness"]

# Date presets, as days before the reference day.
PRESET_DAYS = {"Last 7 Days": 7, "Last 30 Days": 30, "Last 90 Days": 90, "Last Year": 365}

# Hour bucket labels in clock order.
PERIODS = ["00-1"] + [f"{h}-{h + 1}" for h in range(1, 23)] + ["23-00"]

# The columns an indexed message keeps.
INDEX_COLUMNS = [
    "message_id",
    "user",
    "date",
    "only_date",
    "language",
    "message",
    "message_length",
    "hour",
    "day_name",
]

SENTIMENT = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("positive", "neutral", "negative")]
)

SENTIMENT_RESPONSE = T.StructType(
    [
        T.StructField("overall_sentiment", SENTIMENT),
        T.StructField("emotions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("primary_emotion", T.StringType()),
        T.StructField("insights", T.StringType()),
    ]
)

TOPIC = T.StructType(
    [
        T.StructField("topic_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("participants", T.ArrayType(T.StringType())),
        T.StructField("message_count", T.LongType()),
        T.StructField("sentiment", SENTIMENT),
        T.StructField("key_keywords", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
    ]
)

TOPICS_RESPONSE = T.StructType(
    [
        T.StructField("topics", T.ArrayType(TOPIC)),
        T.StructField("analysis_summary", T.StringType()),
        T.StructField("insights", T.StringType()),
    ]
)
