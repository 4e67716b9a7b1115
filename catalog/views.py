"""The registered queries' inputs: the given tables, shaped as chats, an index, questions and replies."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import text
from parlance.operators.enrich import enrich
from parlance.sources.shared import scratch  # noqa: F401
from parlance.sources.stopwords import stopwords_from_text

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


EMOJIS = "😀🎉😂👍🙏🔥😊😍😢🚀🌟🍕🎂🐱"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The table, cut finer when it comes in fewer scan tasks than there are cores.

    Small inputs are one file and would be worked on by one core; large ones are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def chat(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages with conversation texts, and planted special cases (see FIXTURES.md).

    Event e takes turn (e div conversations) mod turns of conversation e mod conversations: two equality joins.
    """
    events, conversations = table(spark, sf, "events"), table(spark, sf, "conversations")
    turns = conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    # One number, read first: a subquery here would keep Spark from sharing the chat's shuffles within a query.
    conv_count = (conversations.agg(F.max("conv_id")).first()[0] or 0) + 1
    placed = (
        spread(events.select("event_id", "ts", "user_id", "event_type"), "event_id")
        .withColumn("conv_id", F.col("event_id") % conv_count)
        .join(turns, "conv_id")
        .withColumn("turn", F.expr(f"event_id div {conv_count}") % F.col("turns"))
        .join(spread(conversations.select("conv_id", "turn", "text"), "conv_id"), ["conv_id", "turn"])
    )
    e, c = F.col("event_id"), F.col("text")
    message = (
        F.when(e % 41 == 0, "Someone created group")
        .when(e % 23 == 0, S.MEDIA_MARKER)
        .when(e % 29 == 0, "")
        .when(e % 31 == 0, F.concat(F.lit("see http://example.com/"), e.cast("string"), F.lit(" now")))
        .when(e % 37 == 0, F.concat(c, F.lit(" 😀"), F.substring(F.lit(EMOJIS), F.expr("cast(event_id div 37 % 14 + 1 as int)"), F.lit(1))))
        .when(e % 86 == 0, "আমি ভালো")
        .when(e % 43 == 0, "আমি ভালো ok")
        .when(e % 94 == 0, "नमस्ते ji")
        .when(e % 47 == 0, "नमस्ते")
        .when(e % 53 == 0, "I LEFT, Kya yaar")
        .when(e % 59 == 0, "note: one: two")
        .otherwise(c)
    )
    user = F.when(e % 41 == 0, S.NOTIFICATION).otherwise(F.concat(F.lit("user_"), F.col("user_id").cast("string")))
    return placed.select(
        F.col("event_type").alias("chat_id"),
        e.alias("seq"),
        F.concat(F.lit("m"), e.cast("string")).alias("message_id"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("date"),
        user.alias("user"),
        message.alias("message"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return enrich(chat(spark, sf))


def order_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as messages, for timelines over several years."""
    orders = table(spark, sf, "orders")
    return enrich(
        orders.select(
            F.col("o_orderpriority").alias("chat_id"),
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
            F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("user"),
            F.col("o_orderstatus").alias("message"),
        )
    )


def nation_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as messages of two nations of one region (see `planted_topics`)."""
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("region"))
    listed = nations.groupBy("region").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    known = F.broadcast(nations.join(F.broadcast(listed), "region"))  # 25 rows, as many as there are nations
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    other = F.get("names", (F.expr("c_custkey div 25") % F.size("names")).cast("int"))
    return customers.join(known, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("chat_id"), F.col("c_custkey").alias("seq"), "region", F.concat_ws(" ", "n_name", F.lit("and"), other).alias("message")
    )


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as messages: long texts for word counts."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("chat_id"),
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("user"),
        F.col("text").alias("message"),
    )


def page_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages as messages: real link text."""
    return spread(table(spark, sf, "pages"), "page_id").select(
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("chat_id"),
        F.col("page_id").alias("seq"),
        F.col("html").alias("message"),
    )


def transcript_parts(spark: SparkSession, sf: str, rows: int = 1000) -> DataFrame:
    """The chats as transcript texts: one text per chat and range of sequence numbers, at most `rows` records each."""
    date = F.date_format("date", "d/M/yyyy, h:mm ")
    half = F.when(F.hour("date") < 12, "am").otherwise("pm")
    sender = F.when(F.col("user") == S.NOTIFICATION, "").otherwise(F.concat("user", F.lit(": ")))
    line = F.concat(date, half, F.lit(" - "), sender, "message", F.lit("\n"))
    part = F.floor(F.col("seq") / rows)
    return (
        chat(spark, sf)
        .withColumns({"part": part, "line": line})
        .groupBy("chat_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("date", "seq", "line"))).alias("entries"))
        .select(
            F.concat_ws("/", "chat_id", F.col("part").cast("string")).alias("chat_id"),
            F.array_join(F.transform("entries", lambda e: e["line"]), "").alias("value"),
        )
    )


def transcript_folder(spark: SparkSession, sf: str) -> str:
    """The transcript texts as files `chat_part.txt` in a new shared folder.

    In a folder of the machines' own file system, tasks write them under their names; in any other store they are written
    by Spark, then given their names.
    """
    texts = transcript_parts(spark, sf).select(
        F.translate("chat_id", "/", "_").alias("name"), F.expr("substring(value, 1, length(value) - 1)").alias("value")
    )
    raw, named = scratch(spark), scratch(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(raw).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop.Path(named))
    place = files.makeQualified(hadoop.Path(named)).toUri()
    if place.getScheme() == "file":
        write_named(texts, place.getPath())
        return named
    texts.repartition("name").write.partitionBy("name").text(raw)

    def rename(found) -> None:
        name = found.getPath().getParent().getName().partition("=")[2]
        files.rename(found.getPath(), hadoop.Path(f"{named}/{name}.txt"))

    with ThreadPoolExecutor(16) as threads:
        list(threads.map(rename, files.globStatus(hadoop.Path(f"{raw}/name=*/part-*"))))
    return named


#: Characters that a folder `name=...` of Spark's writer has as %XX.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def write_named(texts: DataFrame, folder: str) -> None:
    """Write each text (name, value) and a line end as the file `name.txt`, as Spark's writer would, of one task each.

    A file has its name when it is whole, so a task that runs again replaces it by the same.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            # One by one: texts are long.
            for name, value in zip(batch.column(0), batch.column(1)):
                yield name.as_py() or "", value.as_py() or ""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for name, same in groupby(rows(batches), key=itemgetter(0)):
            escaped = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", name) or "__HIVE_DEFAULT_PARTITION__"
            whole = os.path.join(folder, f"{escaped}.txt")
            partial = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(partial, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{value}\n" for _, value in same)
            os.replace(partial, whole)
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    texts.repartition("name").sortWithinPartitions("name").select("name", "value").mapInArrow(task, "files long").agg(F.sum("files")).collect()


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as indexed messages."""
    v = F.col("vec_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (v % 30).cast("int")).cast("timestamp_ntz")
    date = day + F.make_dt_interval(hours=(v % 24).cast("int"))
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("chat_id"),
        v.alias("seq"),
        F.concat(F.lit("v"), v.cast("string")).alias("message_id"),
        F.concat(F.lit("user_"), (v % 7).cast("string")).alias("user"),
        date.alias("date"),
        F.concat(F.lit("message "), v.cast("string")).alias("message"),
        "embedding",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector as a question, with a date range from its number; every fifth question is blank."""
    n = F.expr("cast(vec_id div 50 as int)")
    start = F.date_add(F.lit("2024-01-01").cast("date"), n % 5)
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("question_id"),
        F.when(n % 5 == 4, "  ").otherwise(F.concat(F.lit("question "), F.col("vec_id").cast("string"))).alias("question"),
        "embedding",
        start.alias("start"),
        F.when(n % 5 == 3, start).otherwise(F.date_add(start, 20)).alias("end"),
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the questions: a normal one, an error, and none, by label."""
    asked = questions(spark, sf).select("question_id")
    raw = F.when(F.col("question_id") % 3 == 1, "[Error: quota").otherwise(
        F.concat(F.lit("answer "), F.col("question_id").cast("string"))
    )
    return asked.where(F.col("question_id") % 3 != 2).select("question_id", raw.alias("raw"))


def stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """Words that occur in more than a tenth of the conversation turns."""
    conversations = spread(table(spark, sf, "conversations"), "conv_id")
    tokens = F.array_distinct(text.words(F.lower("text")))
    counts = conversations.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    limit = conversations.agg((F.count("*") * 0.1).alias("n")).scalar()
    return counts.where(F.col("n") > limit).select("word")


def stopword_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation texts as the lines of a word-list file."""
    return stopwords_from_text(table(spark, sf, "conversations").select(F.col("text").alias("value")))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation token, with polarity and emotion by its length."""
    token, length = F.col("token"), F.length("token")
    turns = spread(table(spark, sf, "conversations"), "conv_id")
    tokens = turns.select(F.explode(text.sentiment_tokens(F.col("text"))).alias("token"))
    polarity = F.when(length % 5 == 0, 1).when(length % 5 == 1, -1).otherwise(0)
    emotion = F.element_at(F.array(*[F.lit(e) for e in S.EMOTIONS]), (length % 7 + 1).cast("int"))
    return tokens.distinct().select(token, polarity.alias("polarity"), emotion.alias("emotion"))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with a fixed topic."""
    from parlance.operators.filters import analysable

    chosen = messages(spark, sf).transform(analysable("2024-01-05", "2024-01-24"))
    return chosen.withColumn("topic", (F.col("seq") % 5).cast("int"))


def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A model reply per conversation turn: JSON built from the turn, wrapped or broken in eight ways."""
    c, t = F.col("conv_id"), F.col("turn")
    case = (c + t) % 8
    sentiment = F.format_string(
        '{"overall_sentiment": {"positive": 0.%d, "neutral": 0.25, "negative": 0.125}, '
        '"emotions": {"joy": 0.%d, "anger": 0.0}, "primary_emotion": "joy", "insights": "conv %d"}',
        c % 10, t % 10, c,
    )
    topics = F.format_string(
        '{"topics": [{"topic_name": "T%d", "description": "about %d", "participants": ["a", "b"], "message_count": %d, '
        '"sentiment": {"positive": 0.5, "neutral": 0.25, "negative": 0.25}, "key_keywords": ["k%d", "z"]}, '
        '{"name": "N%d", "keywords": ["w%d"]}], "insights": "sum %d"}',
        c, t, c + t, c, t, t, c,
    )
    kind = F.when(t % 2 == 0, "sentiment").otherwise("topics")
    plain = F.when(t % 2 == 0, sentiment).otherwise(topics)
    raw = (
        F.when(case == 0, plain)
        .when(case == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(case == 2, F.concat(F.lit("```\n"), plain, F.lit("\n```")))
        .when(case == 3, F.concat(F.lit("Here it is:\n"), plain, F.lit("\nDone.")))
        .when(case == 4, F.concat(plain, F.lit(" and "), plain))
        .when(case == 5, F.substring(plain, 1, 60))
        .when(case == 6, "")
        .otherwise("[Error: quota")
    )
    turns = table(spark, sf, "conversations")
    return turns.select((c * 1000 + t).alias("response_id"), kind.alias("kind"), raw.alias("raw"))
