"""Sentiment, topics, prompts and model replies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from catalog import duck as D
from catalog import views as V
from catalog.registry import query
from parlance.operators import filters, prompts, responses, topics
from parlance.operators import sentiment as mood
from parlance.schema import EMOTIONS, NEGATIVE_EMOTIONS, POSITIVE_EMOTIONS
from parlance.sources import store

START, END = "2024-01-05", "2024-01-24"
RANGE = f"{START} to {END}"


def _in_range(spark, sf):
    return V.messages(spark, sf).transform(filters.analysable(START, END))


def _rated(spark, sf, by=()):
    return mood.sentiment(V.messages(spark, sf), V.lexicon(spark, sf), START, END, by)


def _group_sql(group: str = "") -> str:
    """Counts per group: total, positive, negative and every emotion's hits."""
    cols = f"{group}, " if group else ""
    hits = ", ".join(f"count(*) FILTER (emotion = '{e}') AS {e}" for e in EMOTIONS)
    join = f"LEFT JOIN {{}} USING ({group})" if group else "CROSS JOIN {}"
    topic = "*, CAST(seq % 5 AS BIGINT) AS topic"
    signs = f"""(SELECT {cols}count(*) FILTER (score > 0) AS positives, count(*) FILTER (score < 0) AS negatives
      FROM (SELECT {topic} FROM scores JOIN (SELECT chat_id, seq, "user" FROM in_range) USING (chat_id, seq)) GROUP BY ALL)"""
    emotions = f"(SELECT {cols}{hits} FROM (SELECT {topic} FROM hits_of_tokens) GROUP BY ALL)"
    return f"""(SELECT * FROM (SELECT {cols}count(*) AS total_messages FROM (SELECT {topic} FROM in_range) GROUP BY ALL)
      {join.format(signs)} {join.format(emotions)})"""


_ALL = " + ".join(f"coalesce({e}, 0)" for e in EMOTIONS)
_SHARES = """round(coalesce(positives, 0) / total_messages, 6) AS positive,
      round((total_messages - coalesce(positives, 0) - coalesce(negatives, 0)) / total_messages, 6) AS neutral,
      round(coalesce(negatives, 0) / total_messages, 6) AS negative"""
_EMOTION_SHARES = ", ".join(
    f"CASE WHEN {_ALL} > 0 THEN round(coalesce({e}, 0) / ({_ALL}), 6) ELSE 0.0 END AS {e}" for e in EMOTIONS
)
_NAMES = "[" + ", ".join(f"{{'n': -coalesce({e}, 0), 'e': '{e}'}}" for e in EMOTIONS) + "]"
_PRIMARY = f"CASE WHEN {_ALL} > 0 THEN list_min({_NAMES}).e END AS primary_emotion"


@query("sentiment_overall", f"SELECT {_SHARES}, total_messages FROM {_group_sql()}")
def sentiment_overall(spark, sf):
    return _rated(spark, sf).select(*mood.LABELS, "total_messages")


@query("emotions_overall", f"SELECT {_EMOTION_SHARES}, {_PRIMARY} FROM {_group_sql()}")
def emotions_overall(spark, sf):
    return _rated(spark, sf).select(*EMOTIONS, "primary_emotion")


@query(
    "sentiment_by_user",
    f'SELECT "user", {_SHARES}, {_EMOTION_SHARES}, {_PRIMARY}, total_messages FROM {_group_sql(chr(34) + "user" + chr(34))}',
)
def sentiment_by_user(spark, sf):
    return _rated(spark, sf, ["user"]).drop("insights")


@query(
    "sentiment_scores",
    f"""SELECT chat_id, positive AS positive_score, neutral AS neutral_score, negative AS negative_score
    FROM (SELECT chat_id, {_SHARES} FROM {_group_sql('chat_id')})""",
)
def sentiment_scores(spark, sf):
    return mood.sentiment_scores(_rated(spark, sf, ["chat_id"]), ["chat_id"])


@query("sentiment_empty_range", "SELECT CAST(0 AS DOUBLE) AS positive, CAST(0 AS BIGINT) AS total_messages, 'No messages found.' AS insights")
def sentiment_empty_range(spark, sf):
    rated = mood.sentiment(V.messages(spark, sf), V.lexicon(spark, sf), "1999-01-01", "1999-01-02")
    return rated.select("positive", "total_messages", "insights")


@query("sentiment_of_topics", f"SELECT topic, {_SHARES}, {_EMOTION_SHARES}, total_messages FROM {_group_sql('topic')}")
def sentiment_of_topics(spark, sf):
    return mood.topic_sentiment(V.assigned(spark, sf), V.lexicon(spark, sf)).drop("insights", "primary_emotion")


@query("sentiment_of_one_topic", f"SELECT topic, {_SHARES}, total_messages FROM {_group_sql('topic')} WHERE topic = 2")
def sentiment_of_one_topic(spark, sf):
    one = mood.topic_sentiment(V.assigned(spark, sf), V.lexicon(spark, sf), 2)
    return one.select("topic", *mood.LABELS, "total_messages")


_UNPIVOT = " UNION ALL ".join(
    f"SELECT chat_id, '{e}' AS emotion, {e} AS value FROM e" for e in EMOTIONS
)


@query(
    "emotion_rows",
    f"""SELECT *, CASE WHEN emotion IN ({D.sql_list(POSITIVE_EMOTIONS)}) THEN 'positive'
      WHEN emotion IN ({D.sql_list(NEGATIVE_EMOTIONS)}) THEN 'negative' ELSE 'other' END AS bucket
    FROM (SELECT * FROM (WITH e AS (SELECT chat_id, {_EMOTION_SHARES} FROM {_group_sql('chat_id')}) {_UNPIVOT}))
    WHERE value > 0""",
)
def emotion_rows(spark, sf):
    return mood.emotion_rows(mood.sentiment_record(_rated(spark, sf, ["chat_id"]), ["chat_id"]), ["chat_id"])


def _percent(value: str) -> str:
    """A share as text with one decimal, rounded from the binary number's exact value."""
    return f"printf('%.1f%%', {value} * 100)"


_UNROUNDED = re.sub(r"round\((.*?), 6\)( AS| ELSE)", r"\1\2", f"{_SHARES}, {_EMOTION_SHARES}")


_REPORT_LINES = [
    "'Sentiment Analysis Report'",
    D.q(f"Date Range: {RANGE}"),
    "'Total Messages: ' || total_messages",
    "''",
    "'Overall Sentiment:'",
    *[f"'- {label.title()}: ' || {_percent(label)}" for label in mood.LABELS],
    "''",
    "'Emotions:'",
    *[f"CASE WHEN {e} > 0 THEN '- {e}: ' || {_percent(e)} END" for e in EMOTIONS],
    "''",
    "'Insights:'",
    "total_messages || ' messages: ' || " + " || ', ' || ".join(f"{_percent(label)} || ' {label}'" for label in mood.LABELS) + " || '.'",
]


@query(
    "sentiment_report",
    f"""SELECT value, count(*) AS reports FROM (
      SELECT unnest([{', '.join(_REPORT_LINES)}]) AS value
      FROM (SELECT total_messages, {_UNROUNDED} FROM {_group_sql('chat_id')})) WHERE value IS NOT NULL GROUP BY value""",
)
def sentiment_report(spark, sf):
    records = mood.sentiment_record(_rated(spark, sf, ["chat_id"]), ["chat_id"])
    path = V.scratch(spark)
    store.write_report(mood.report_text(records, RANGE, ["chat_id"]), path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("reports"))


_TOPIC_PEOPLE = """(SELECT chat_id, topic, array_to_string(list_sort(list(DISTINCT "user")), ',') AS participants
    FROM (SELECT *, CAST(seq % 5 AS BIGINT) AS topic FROM in_range) GROUP BY chat_id, topic)"""
_TOPIC_WORDS = f"""(SELECT chat_id, topic, string_agg(word, ',' ORDER BY rank) AS words FROM (
      SELECT *, row_number() OVER (PARTITION BY chat_id, topic ORDER BY n DESC, word) AS rank FROM (
        SELECT chat_id, topic, word, count(*) AS n
        FROM (SELECT chat_id, CAST(seq % 5 AS BIGINT) AS topic, unnest({D.tokens('message')}) AS word FROM in_range)
        WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stopwords) GROUP BY ALL)) WHERE rank <= 3 GROUP BY ALL)"""
_TOPIC_ROWS = f"""SELECT chat_id, topic, 'Topic ' || (topic + 1) AS topic_name, coalesce(replace(words, ',', ', '), '') AS description,
      participants, total_messages AS message_count, {_SHARES}, coalesce(words, '') AS key_keywords
    FROM {_group_sql('chat_id, topic')} JOIN {_TOPIC_PEOPLE} USING (chat_id, topic)
      LEFT JOIN {_TOPIC_WORDS} USING (chat_id, topic)"""


def _flat_topics(rows, *keys):
    return rows.select(
        *keys, "topic_name", "description", F.array_join("participants", ",").alias("participants"), "message_count",
        *[F.col(f"sentiment.{label}").alias(label) for label in mood.LABELS],
        F.array_join("key_keywords", ",").alias("key_keywords"),
    )


@query("topic_summaries", _TOPIC_ROWS)
def topic_summaries(spark, sf):
    rows = topics.summarize_topics(V.assigned(spark, sf), V.lexicon(spark, sf), V.stopwords(spark, sf))
    return _flat_topics(rows, "chat_id", "topic")


@query(
    "topic_keywords",
    f"""SELECT topic, string_agg(word, ',' ORDER BY rank) AS key_keywords FROM (
      SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank FROM (
        SELECT topic, word, count(*) AS n FROM (SELECT CAST(seq % 5 AS BIGINT) AS topic, unnest({D.tokens('message')}) AS word FROM in_range)
        WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stopwords) GROUP BY ALL)) WHERE rank <= 3 GROUP BY topic""",
)
def topic_keywords(spark, sf):
    words = topics.topic_keywords(V.assigned(spark, sf), V.stopwords(spark, sf), by=())
    return words.withColumn("key_keywords", F.array_join("key_keywords", ","))


@query(
    "topics_found",
    f"""SELECT chat_id, count(*) AS message_count, array_to_string(list_sort(list(DISTINCT "user")), ',') AS participants,
      true AS at_most_k
    FROM in_range JOIN (
      SELECT DISTINCT chat_id, seq FROM (SELECT chat_id, seq, unnest({D.tokens('message')}) AS word FROM in_range)
      WHERE length(word) > 2 AND word NOT IN (SELECT word FROM stopwords)) USING (chat_id, seq)
    WHERE chat_id IN (SELECT chat_id FROM in_range GROUP BY chat_id HAVING count(*) >= 10) GROUP BY chat_id""",
)
def topics_found(spark, sf):
    """What holds for any model: each message with a word is in one of the k topics, under its user."""
    found = topics.topics(V.messages(spark, sf), V.lexicon(spark, sf), START, END, 3, V.stopwords(spark, sf))
    everyone = F.array_sort(F.array_distinct(F.flatten(F.collect_list("participants"))))
    return found.groupBy("chat_id").agg(
        F.sum("message_count").alias("message_count"),
        F.array_join(everyone, ",").alias("participants"),
        ((F.max("topic") < 3) & (F.count("*") <= 3)).alias("at_most_k"),
    )


@query(
    "planted_topics",
    """SELECT c_mktsegment AS chat_id, n_regionkey AS region, count(*) AS message_count, 1 AS topics_of_region,
      (SELECT count(DISTINCT n_regionkey) FROM customer c JOIN nation m ON c.c_nationkey = m.n_nationkey WHERE c.c_mktsegment = o.c_mktsegment) AS topics_of_chat
    FROM customer o JOIN nation n ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def planted_topics(spark, sf):
    """Customers as messages of their segment's chat, each naming its nation and one more of the same region, which is not told:
    a chat's topics have to be its regions."""
    rows = topics.assign_topics(V.nation_messages(spark, sf))
    of_region = rows.groupBy("chat_id", "region").agg(F.count("*").alias("message_count"), F.countDistinct("topic").alias("topics_of_region"))
    return of_region.join(rows.groupBy("chat_id").agg(F.countDistinct("topic").alias("topics_of_chat")), "chat_id")


@query(
    "topics_json",
    f"""SELECT t.* EXCLUDE (topic), {D.q(RANGE)} AS date_range, total_messages, 'Topics: ' || names AS analysis_summary
    FROM ({_TOPIC_ROWS}) t JOIN (
      SELECT chat_id, sum(message_count)::BIGINT AS total_messages, string_agg(topic_name, ', ' ORDER BY topic) AS names
      FROM ({_TOPIC_ROWS}) GROUP BY chat_id) USING (chat_id)""",
)
def topics_json(spark, sf):
    messages = V.messages(spark, sf)
    rows = topics.summarize_topics(V.assigned(spark, sf), V.lexicon(spark, sf), V.stopwords(spark, sf))
    path = V.scratch(spark)
    store.write_topics_json(topics.topics_record(rows, messages, START, END), path)
    schema = f"chat_id string, date_range string, total_messages bigint, topics array<struct<{topics.TOPIC_FIELDS}>>, analysis_summary string"
    back = spark.read.schema(schema).json(path)
    flat = back.select("chat_id", "date_range", "total_messages", "analysis_summary", F.explode("topics").alias("t"))
    return _flat_topics(flat.select("*", "t.*"), "chat_id", "date_range", "total_messages", "analysis_summary")


# Prompts


def _prompt_sql(template: str, source: str, n: int, group: str = "", bullet: str = "- ", **values: str) -> str:
    cols = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    values = {"lines": "lines", "total": "total_messages", **values}
    pieces, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        pieces.append(D.q(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        pieces.append(values[name])
    return f"""SELECT {cols}{' || '.join(pieces)} AS prompt, total_messages FROM (
      SELECT {cols}count(*) AS total_messages,
        string_agg({D.q(bullet)} || "user" || ': ' || message, chr(10) ORDER BY nth) FILTER (nth <= {n}) AS lines
      FROM (SELECT *, row_number() OVER ({part}ORDER BY chat_id, seq) AS nth FROM {source}) GROUP BY ALL)"""


_Q_RANGE = D.q(RANGE)


@query("sentiment_prompts", _prompt_sql(prompts.SENTIMENT, "in_range", 50, "chat_id", range=_Q_RANGE))
def sentiment_prompts(spark, sf):
    return prompts.sentiment_prompts(_in_range(spark, sf), RANGE, ["chat_id"])


@query("sentiment_prompt_overall", _prompt_sql(prompts.SENTIMENT, "in_range", 50, range=_Q_RANGE))
def sentiment_prompt_overall(spark, sf):
    return prompts.sentiment_prompts(_in_range(spark, sf), RANGE)


@query("score_prompts", _prompt_sql(prompts.SCORES, "in_range", 50, "chat_id", "", range=_Q_RANGE))
def score_prompts(spark, sf):
    return prompts.score_prompts(_in_range(spark, sf), RANGE, ["chat_id"])


@query("topic_prompts", _prompt_sql(prompts.TOPICS, "in_range", 50, "chat_id", range=_Q_RANGE, topics="'5'"))
def topic_prompts(spark, sf):
    return prompts.topic_prompts(_in_range(spark, sf), RANGE, 5, ["chat_id"])


@query(
    "topic_sentiment_prompts",
    _prompt_sql(
        prompts.TOPIC_SENTIMENT, "(SELECT *, CAST(seq % 5 AS BIGINT) AS topic FROM in_range)", 15, "topic", topic="topic"
    ),
)
def topic_sentiment_prompts(spark, sf):
    return prompts.topic_sentiment_prompts(V.assigned(spark, sf))


# Model replies


def _asked(replies):
    """What each reply was asked about."""
    number = F.col("response_id")
    return replies.select("response_id", (number % 100).alias("total_messages"), F.concat(F.lit("range "), number.cast("string")).alias("date_range"))


@query(
    "sentiment_replies",
    """SELECT response_id, doc IS NULL AS parse_error,
      CASE WHEN doc IS NULL THEN 0.6 ELSE CAST(doc->>'$.overall_sentiment.positive' AS DOUBLE) END AS positive,
      CASE WHEN doc IS NULL THEN 0.3 ELSE CAST(doc->>'$.overall_sentiment.neutral' AS DOUBLE) END AS neutral,
      CASE WHEN doc IS NULL THEN 0.7 ELSE CAST(doc->>'$.emotions.joy' AS DOUBLE) END AS joy,
      CASE WHEN doc IS NULL THEN 'Unreadable reply: ' || left(raw, 500) ELSE doc->>'$.insights' END AS insights,
      response_id % 100 AS total_messages, 'range ' || response_id AS date_range
    FROM parsed WHERE kind = 'sentiment'""",
)
def sentiment_replies(spark, sf):
    replies = V.model_replies(spark, sf).where(F.col("kind") == "sentiment")
    parsed = responses.parse_sentiment(replies, asked=_asked(replies))
    return parsed.select(
        "response_id", "parse_error", "overall_sentiment.positive", "overall_sentiment.neutral",
        F.col("emotions")["joy"].alias("joy"), "insights", "total_messages", "date_range",
    )


@query(
    "topic_replies",
    """SELECT response_id, doc IS NULL AS parse_error, CAST(coalesce(json_array_length(doc, '$.topics'), 0) AS BIGINT) AS topics,
      CASE WHEN doc IS NULL THEN 'Unreadable reply: ' || left(raw, 300) ELSE doc->>'$.insights' END AS analysis_summary,
      response_id % 100 AS total_messages, 'range ' || response_id AS date_range
    FROM parsed WHERE kind = 'topics'""",
)
def topic_replies(spark, sf):
    replies = V.model_replies(spark, sf).where(F.col("kind") == "topics")
    parsed = responses.parse_topics(replies, asked=_asked(replies))
    return parsed.select(
        "response_id", "parse_error", F.size("topics").alias("topics"), "analysis_summary", "total_messages", "date_range"
    )


@query(
    "topic_reply_rows",
    """SELECT response_id, topic, coalesce(one->>'topic_name', one->>'name', 'Unknown') AS topic_name,
      coalesce(one->>'description', 'N/A') AS description,
      coalesce(CAST(one->>'message_count' AS BIGINT), 0) AS message_count,
      coalesce(CAST(one->>'$.sentiment.positive' AS DOUBLE), 0.0) AS positive,
      array_to_string(CAST(coalesce(one->'key_keywords', one->'keywords') AS VARCHAR[]), ',') AS key_keywords
    FROM (SELECT response_id, unnest(CAST(doc->'$.topics' AS JSON[])) AS one,
        unnest(range(1, 1 + CAST(json_array_length(doc, '$.topics') AS BIGINT))) AS topic
      FROM parsed WHERE kind = 'topics' AND doc IS NOT NULL)""",
)
def topic_reply_rows(spark, sf):
    parsed = responses.parse_topics(V.model_replies(spark, sf).where(F.col("kind") == "topics"))
    rows = responses.topic_rows(parsed, ["response_id"])
    return rows.select(
        "response_id", "topic", "topic_name", "description", "message_count", F.col("sentiment.positive").alias("positive"),
        F.array_join("key_keywords", ",").alias("key_keywords"),
    )


@query(
    "fenced_json",
    r"""SELECT response_id, CASE WHEN json_valid(body) THEN body END AS json FROM (
      SELECT response_id, CASE WHEN starts_with(raw, '[Error') OR trim(raw) = '' THEN NULL
        WHEN starts_with(raw, '```json') THEN trim(regexp_extract(raw, '(?s)```json(.*?)```', 1), chr(10))
        WHEN starts_with(raw, '```') THEN trim(regexp_extract(raw, '(?s)```(.*?)```', 1), chr(10)) ELSE raw END AS body
      FROM model_replies)""",
)
def fenced_json(spark, sf):
    return responses.parse_json(V.model_replies(spark, sf)).select("response_id", "json")
