"""Prompt tables: one row of prompt text per question, date range, group or topic.

The wording is ours; each function takes a template with the same named places instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import calendar
from parlance.operators.ordering import first_n

SAMPLE = 50
TOPIC_SAMPLE = 15

QUESTION = """Here is part of a chat among friends, one message per line.

{lines}

Question: {question}

Answer the question from these messages only."""

SENTIMENT = """Chat messages from {range}; {total} in all, the first ones below.

{lines}

Judge the mood of the chat. Reply with one JSON object and nothing else, with the keys overall_sentiment (positive,
neutral, negative; together 1.0), emotions (joy, anger, frustration, sadness, enthusiasm, excitement, concern),
primary_emotion and insights."""

SCORES = """Chat messages from {range}; {total} in all, the first ones below.

{lines}

Reply with one JSON object and nothing else, with the keys positive_score, neutral_score and negative_score; together
1.0."""

TOPICS = """Chat messages from {range}; {total} in all, the first ones below.

{lines}

Name at most {topics} topics. Reply with one JSON object and nothing else, with the keys topics (a list of topic_name,
description, participants, message_count, sentiment, key_keywords) and analysis_summary."""

TOPIC_SENTIMENT = """Chat messages about "{topic}".

{lines}

Reply with one JSON object and nothing else, with the keys topic, sentiment (positive, neutral, negative), key_points and
summary."""


def fill(template: str, **values: Column | str | int) -> Column:
    """The template with its named places replaced, in one concatenation."""
    parts, rest = [], template
    while rest:
        before, brace, after = rest.partition("{")
        parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        value = values[name]
        parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def _joined(line: Column, order: Sequence[Column]) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return F.array_join(F.transform(ordered, lambda one: one["_line"]), "\n")


def question_prompts(questions: DataFrame, context: DataFrame, template: str = QUESTION) -> DataFrame:
    """question_id and a prompt with its context lines `user (date): message` in order of appearance.

    A question has at most (hits) x (2 x window + 1) context lines.
    """
    date = calendar.iso(F.col("date"))
    line = F.concat(F.col("user"), F.lit(" ("), date, F.lit("): "), F.col("message"))
    order = [F.col(c) for c in ("rank", "pos", "message_id")]
    lines = context.groupBy("question_id").agg(_joined(line, order).alias("_lines"), F.count("*").alias("context_messages"))
    return questions.join(lines, "question_id").select(
        "question_id", fill(template, lines=F.col("_lines"), question=F.col("question")).alias("prompt"), "context_messages"
    )


def sample_prompts(
    messages: DataFrame, template: str, n: int = SAMPLE, by: Sequence[str] = (), bullet: str = "- ", **values
) -> DataFrame:
    """A prompt per group from its first n messages in chat order, and the number of all its messages."""
    line = F.concat(F.lit(bullet), F.col("user"), F.lit(": "), F.col("message"))
    order = [F.col("chat_id"), F.col("seq")]
    sample = first_n(messages.select(*dict.fromkeys([*by, "chat_id", "seq", "user", "message"])), n, order, by, "_rank")
    lines = sample.groupBy(*by).agg(_joined(line, [F.col("_rank")]).alias("_lines"))
    totals = messages.groupBy(*by).agg(F.count("*").alias("total_messages"))
    both = lines.join(totals, list(by)) if by else lines.withColumn("total_messages", totals.scalar())
    filled = fill(template, lines=F.col("_lines"), total=F.col("total_messages"), **values)
    return both.select(*by, filled.alias("prompt"), "total_messages")


def sentiment_prompts(messages: DataFrame, date_range: str, by: Sequence[str] = (), template: str = SENTIMENT) -> DataFrame:
    return sample_prompts(messages, template, by=by, range=date_range)


def score_prompts(messages: DataFrame, date_range: str, by: Sequence[str] = (), template: str = SCORES) -> DataFrame:
    return sample_prompts(messages, template, by=by, bullet="", range=date_range)


def topic_prompts(messages: DataFrame, date_range: str, topics: int = 5, by: Sequence[str] = (), template: str = TOPICS) -> DataFrame:
    return sample_prompts(messages, template, by=by, range=date_range, topics=topics)


def topic_sentiment_prompts(assigned: DataFrame, template: str = TOPIC_SENTIMENT) -> DataFrame:
    """A prompt per topic from its first messages; assigned has a topic column."""
    return sample_prompts(assigned, template, n=TOPIC_SAMPLE, by=["topic"], topic=F.col("topic"))
