"""The user-facing jobs, put together from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from parlance import schema as S
from parlance.operators import activity, answers, prompts, response, responses, retrieval, topics, words
from parlance.operators import dashboard as page
from parlance.operators import sentiment as mood
from parlance.operators.filters import for_user
from parlance.sources import store, transcripts


def read_chats(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Transcript files -> full message table; records without a valid time are left out (see rejected)."""
    return transcripts.accepted(transcripts.read_transcripts(spark, paths, **options))


def dashboard(messages: DataFrame, user: str = S.OVERALL, stopwords: DataFrame | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every table of the analytics page, lazily. Persist or store the messages first: each table reads them once."""
    tables = {
        "users": activity.users(messages, by),
        "overview": activity.overview(messages, by),
        "key_metrics": activity.key_metrics(messages, user, by),
        "monthly_timeline": activity.monthly_timeline(messages, user, by),
        "daily_timeline": activity.daily_timeline(messages, user, by),
        "weekday_activity": activity.weekday_activity(messages, user, by),
        "month_activity": activity.month_activity(messages, user, by),
        "activity_heatmap": activity.activity_heatmap(messages, user, by),
        "term_weights": words.term_weights(messages, stopwords, user, by),
        "common_words": words.common_words(messages, stopwords, user=user, by=by),
        "emoji_counts": words.emoji_counts(messages, user, by),
        "top_emojis": words.top_emojis(messages, user=user, by=by),
        "response_stats": response.response_stats(messages.transform(for_user(user)), by),
    }
    if user == S.OVERALL:
        tables["busiest_users"] = activity.busiest_users(messages, by=by)
        tables["user_share"] = activity.user_share(messages, by)
        tables["top_user_share"] = activity.top_user_share(messages, by=by)
        tables["talkativeness"] = activity.talkativeness(messages, by)
        tables["top_user_trend"] = activity.top_user_trend(messages, by=by)
    else:
        tables["user_daily_stats"] = activity.user_daily_stats(messages, user, by)
    return tables


def stored_dashboard(messages: DataFrame, path: str, user: str = S.OVERALL, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The counts of the analytics page, from one scan of the messages: its long table is stored, and every table reads that."""
    totals = page.totals(messages, user, by)
    totals.write.mode("overwrite").partitionBy("part").parquet(path)
    return page.tables(messages.sparkSession.read.schema(totals.schema).parquet(path), user, by)


def build_index(messages: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Embed the indexable messages, replace their chats in the stored index, and return the stored index.

    Without an embedding of the caller's, the built-in one of the path is used; the first call fits and stores it.
    """
    spark = messages.sparkSession
    rows = retrieval.index_rows(messages)
    if embed:
        store.write_index(embed(rows), path)
    else:
        model = index_embedding(rows, path)
        store.write_index(rows, path, embed=lambda moved: retrieval.embed(moved, model))
    return store.read_index(spark, path)


def index_embedding(rows: DataFrame, path: str) -> PipelineModel:
    """The embedding stored beside an index; fitted on the rows and stored where there is none."""
    place = f"{path.rstrip('/')}.embedding"
    if store.exists(rows.sparkSession, f"{place}/metadata"):
        return retrieval.load_embedding(place)
    model = retrieval.fit_embedding(rows)
    model.save(place)
    return model


def ask(questions: DataFrame, path: str, k: int = 5, **options) -> DataFrame:
    """The hits of questions (question_id, question, start, end) in a stored index, by its own embedding."""
    spark = questions.sparkSession
    asked = retrieval.embed_questions(questions, retrieval.load_embedding(f"{path.rstrip('/')}.embedding"))
    return question_hits(asked, store.read_index(spark, path), k, **options)


def question_hits(questions: DataFrame, index: DataFrame, k: int = 5, **options) -> DataFrame:
    """The hits of a batch of questions. Both the prompts and the answers need them: store or persist the result."""
    return retrieval.retrieve(questions, index, k, **options)


def prompt_batch(questions: DataFrame, hits: DataFrame, index: DataFrame, context_rows: int = retrieval.CONTEXT_ROWS) -> DataFrame:
    """The prompts to send out for a batch of questions. The stored hits are counted: few ones are broadcast."""
    return prompts.question_prompts(questions, retrieval.context_union(hits, index, context_rows, measure=True))


def answer_batch(questions: DataFrame, hits: DataFrame, replies: DataFrame) -> DataFrame:
    """The result table once the replies are back."""
    return answers.answer_table(questions, hits, replies)


def sentiment(messages: DataFrame, lexicon: DataFrame, start: str | date, end: str | date, by: Sequence[str] = ()) -> DataFrame:
    return mood.sentiment_record(mood.sentiment(messages, lexicon, start, end, by), by)


def topic_report(messages: DataFrame, lexicon: DataFrame, start: str | date, end: str | date, k: int = 5, **options) -> DataFrame:
    """Export-shaped topic rows, one per chat."""
    found = topics.topics(messages, lexicon, start, end, k, **options)
    return topics.topics_record(found, messages, start, end)


def parse_responses(replies: DataFrame, kind: str) -> DataFrame:
    """Replies of one kind (sentiment, topics or json) as typed rows."""
    parse = {"sentiment": responses.parse_sentiment, "topics": responses.parse_topics, "json": responses.parse_json}
    return parse[kind](replies)
