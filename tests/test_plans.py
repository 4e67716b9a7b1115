"""What the physical plans must look like at scale."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import views as V
from parlance.operators import activity, dashboard, filters, response, retrieval, sentiment, words

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    V.messages(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_filter_and_columns_reach_the_scan(stored):
    text = plan(activity.daily_timeline(stored.transform(filters.between_dates("2024-01-05", "2024-01-10")), "user_7"))
    assert "PushedFilters: [IsNotNull(only_date)" in text.replace("PushedFilters: [IsNotNull(user), IsNotNull(only_date)", "PushedFilters: [IsNotNull(only_date)")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "message" not in schema


def test_no_python_in_jvm_operators(stored, spark):
    for df in (
        words.common_words(stored, V.stopwords(spark, SF)),
        words.top_emojis(stored),
        response.response_stats(stored),
        activity.key_metrics(stored),
    ):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_sentiment_is_one_scan_and_one_exchange_by_group(stored, spark):
    """The lexicon goes with the tasks; a JVM look-up in a constant took three times as long, a join meets by message."""
    text = plan(sentiment.sentiment(stored, V.lexicon(spark, SF), "2024-01-05", "2024-01-10", ["user"]))
    assert text.count("Exchange") == 1 and text.count("Scan parquet") == 1 and "hashpartitioning(user" in text


def test_counts_combine_before_the_shuffle_by_hash(stored):
    text = plan(words.word_counts(stored))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_one_shuffle_per_count(stored):
    text = plan(activity.talkativeness(stored).groupBy("user").agg(F.max("words")))
    assert text.count("Exchange hashpartitioning") == 1


def test_top_n_is_cut_before_the_shuffle(spark):
    found = retrieval.retrieve_similar(V.questions(spark, SF), V.index(spark, SF), 5)
    text = plan(found)
    assert "WindowGroupLimit" in text and "MapInArrow" in text
    assert "TakeOrderedAndProject" in plan(activity.busiest_users(V.messages(spark, SF)))


def test_date_range_stays_above_the_ranking(spark):
    """The rule filters the fetched rows; pushing the filter below would change the result."""
    text = plan(retrieval.retrieve(V.questions(spark, SF), V.index(spark, SF), 5))
    scan = text[text.index("MapInArrow"):]
    assert "date#" not in "".join(re.findall(r"Filter \(.*", scan))


def test_no_window_over_a_whole_chat(stored):
    """Rows are linked inside minutes first; only end rows of slices reach the chat-wide window."""
    text = plan(response.with_previous(stored))
    assert re.search(r"hashpartitioning\(chat_id#\d+, date#\d+, \w+#\d+L?, ", text)
    assert len([line for line in text.splitlines() if "Window [" in line and "stripe" in line]) == 1


def test_dashboard_totals_are_one_scan(stored):
    """The messages are read and combined once; the grouping sets expand the combined rows."""
    text = plan(dashboard.totals(stored, by=["chat_id"]))
    assert text.count("Scan parquet") == 1 and text.count("Exchange") == 2 and text.count("Expand") == 1
    assert text.index("Expand") < text.index("Scan parquet") and "Python" not in text and "SortAggregate" not in text
