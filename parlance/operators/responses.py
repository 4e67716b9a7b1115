"""Model replies as typed rows. Input tables have a raw column with the reply text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import text

# What a sentiment reply that cannot be read is replaced with.
FALLBACK_SENTIMENT = {"positive": 0.6, "neutral": 0.3, "negative": 0.1}
FALLBACK_EMOTIONS = {"joy": 0.7, "frustration": 0.2, "concern": 0.1}
RAW_SHOWN = {"sentiment": 500, "topics": 300}


def json_span(raw: Column) -> Column:
    """From the first opening to the last closing brace, over line ends; null when there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def fenced_json(raw: Column) -> Column:
    """The content of a json-marked fence, else of any fence, else the whole text; null for errors and blanks.

    A fence counts only when it is closed.
    """
    marked = raw.contains("```json")
    closed = F.when(marked, raw.rlike(r"(?s)```json.*```")).otherwise(raw.rlike(r"(?s)```.*```"))
    inside = F.when(marked, F.regexp_extract(raw, r"(?s)\A.*?```json(.*?)```", 1)).otherwise(
        F.regexp_extract(raw, r"(?s)\A.*?```(.*?)```", 1)
    )
    body = text.strip(F.when(closed, inside).otherwise(raw))
    return F.when(raw.startswith("[Error") | (text.strip(raw) == ""), F.lit(None)).otherwise(body)


def valid_json(value: Column) -> Column:
    """The text itself when it is exactly one JSON value, else null.

    The parsers stop after the first value; wrapping the text as the only element of an array and as the only
    field of an object makes anything behind it an error.
    """
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    parses = F.try_parse_json(F.concat(F.lit('{"v":'), value, F.lit("}"))).isNotNull()
    return F.when(alone & parses, value)


def parse_json(replies: DataFrame) -> DataFrame:
    """Replies with a json column: the fenced or plain JSON text, null when it is missing or broken."""
    return replies.withColumn("json", valid_json(fenced_json(F.col("raw"))))


def _pick(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def _asked(parsed: DataFrame, asked: DataFrame | None) -> DataFrame:
    """With what the reply was asked about: asked has response_id, total_messages and date_range."""
    if asked is None:
        return parsed
    return parsed.join(asked.select("response_id", "total_messages", "date_range"), "response_id", "left")


def parse_sentiment(replies: DataFrame, fallback: bool = True, asked: DataFrame | None = None) -> DataFrame:
    """Sentiment replies as columns; parse_error tells rows that could not be read.

    With fallback such rows carry the fixed substitute values, otherwise nulls. With asked (response_id,
    total_messages, date_range) its two columns are added.
    """
    parsed = replies.withColumn("_json", valid_json(json_span(F.col("raw")))).withColumn(
        "_parsed", F.from_json("_json", S.SENTIMENT_RESPONSE)
    )
    bad = F.col("_json").isNull()

    def value(name: str, substitute: Column) -> Column:
        return F.when(bad, substitute if fallback else F.lit(None)).otherwise(F.col("_parsed")[name]).alias(name)

    overall = F.struct(*[F.lit(v).alias(k) for k, v in FALLBACK_SENTIMENT.items()]).cast(S.SENTIMENT)
    emotions = F.create_map(*[F.lit(part) for pair in FALLBACK_EMOTIONS.items() for part in pair])
    shown = F.concat(F.lit("Unreadable reply: "), F.substring("raw", 1, RAW_SHOWN["sentiment"]))
    columns = parsed.select(
        *replies.columns,
        value("overall_sentiment", overall),
        value("emotions", emotions),
        value("primary_emotion", F.lit(None).cast("string")),
        value("insights", shown),
        bad.alias("parse_error"),
    )
    return _asked(columns, asked)


def parse_topics(replies: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Topic replies: topics array, analysis_summary (either key) and parse_error; unreadable ones have no topics.

    With asked (response_id, total_messages, date_range) its two columns are added.
    """
    parsed = replies.withColumn("_json", valid_json(json_span(F.col("raw")))).withColumn(
        "_parsed", F.from_json("_json", S.TOPICS_RESPONSE)
    )
    bad = F.col("_json").isNull()
    none = F.array().cast(S.TOPICS_RESPONSE["topics"].dataType)
    shown = F.concat(F.lit("Unreadable reply: "), F.substring("raw", 1, RAW_SHOWN["topics"]))
    summary = _pick(F.col("_parsed.analysis_summary"), F.col("_parsed.insights"))
    columns = parsed.select(
        *replies.columns,
        F.coalesce(F.col("_parsed.topics"), none).alias("topics"),
        F.when(bad, shown).otherwise(summary).alias("analysis_summary"),
        bad.alias("parse_error"),
    )
    return _asked(columns, asked)


def topic_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per topic of parsed replies, whichever of the two key names was used."""
    rows = parsed.select(*keys, F.posexplode("topics").alias("_at", "t"))
    one = F.col("t")
    keywords = F.when(F.size(one["key_keywords"]) > 0, one["key_keywords"]).otherwise(one["keywords"])
    empty = F.array().cast("array<string>")
    return rows.select(
        *keys,
        (F.col("_at") + 1).alias("topic"),
        F.coalesce(F.nullif(one["topic_name"], F.lit("")), one["name"], F.lit("Unknown")).alias("topic_name"),
        F.coalesce(one["description"], F.lit("N/A")).alias("description"),
        F.coalesce(one["participants"], empty).alias("participants"),
        F.coalesce(one["message_count"], F.lit(0)).alias("message_count"),
        F.struct(
            *[F.coalesce(one["sentiment"][k], F.lit(0.0)).alias(k) for k in ("positive", "neutral", "negative")]
        ).alias("sentiment"),
        F.coalesce(keywords, empty).alias("key_keywords"),
    )
