"""Sentiment and emotions by lexicon, over every message of a date range.

Token rule: lower case, only letters, digits and apostrophes kept. A message's score is the sum of its tokens'
polarities; the sign is its label and no hit means neutral. Equal emotion shares resolve to the first name in
alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import date
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import schema as S
from parlance.functions import text
from parlance.operators import filters
from parlance.sources import shared

LEXICON_BYTES = 64 << 20
#: Lexicons of up to so many tokens go with the tasks.
LOOKUP_TOKENS = 500_000
#: Tokens of messages that meet a larger lexicon together.
BLOCK_TOKENS = 1_000_000
SALTS = 32
LABELS = ["positive", "neutral", "negative"]
# Fixed value: the note of an empty range.
NO_MESSAGES = "No messages found."


def sized_broadcast(table: DataFrame, text_column: str, limit: int = LEXICON_BYTES) -> DataFrame:
    """Broadcast hint when the table's measured size is within the limit; otherwise the table as it is."""
    size = table.agg(F.sum(F.octet_length(text_column) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table


def token_hits(tokens: DataFrame, lexicon: DataFrame, limit: int = LEXICON_BYTES) -> DataFrame:
    """Tokens (chat_id, seq, token, ...) that the lexicon has, with its columns.

    The lexicon's size is measured. Beyond the limit both sides are shuffled by token and salt: a frequent word goes to
    `SALTS` tasks, for each of which the lexicon has a copy of its row.
    """
    size = lexicon.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0
    if size <= limit:
        return tokens.join(F.broadcast(lexicon), "token")
    copies = lexicon.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = tokens.withColumn("_salt", F.pmod(F.xxhash64("chat_id", "seq"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["token", "_salt"]).drop("_salt")


def _by_token(lexicon: DataFrame) -> DataFrame:
    """One row for each token: the sum of its polarities and how often it has each emotion (`hits`)."""
    emotions = [F.count_if(F.col("emotion") == name) for name in S.EMOTIONS]
    return lexicon.where(F.col("token").isNotNull()).groupBy("token").agg(F.coalesce(F.sum("polarity"), F.lit(0)).cast("long").alias("polarity"), F.array(*emotions).alias("hits"))


def rated_messages(messages: DataFrame, lexicon: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns to keep, `found` (how many tokens of a message the lexicon has), `score` and the emotions' hits of every message.

    A lexicon of up to LOOKUP_TOKENS tokens goes with the tasks, which look up all tokens of a batch at once, without a
    shuffle; a larger one meets the tokens of whole blocks of messages (see `_rated_by_blocks`).
    """
    rows = _by_token(lexicon.select("token", "polarity", "emotion"))
    given = messages.select(*keep, F.coalesce(text.sentiment_tokens(F.col("message")), F.array().cast("array<string>")).alias("_tokens"))
    # One row more than the limit tells a larger lexicon.
    table = rows.limit(LOOKUP_TOKENS + 1).toArrow().combine_chunks()
    if len(table) > LOOKUP_TOKENS:
        return _rated_by_blocks(given, rows, keep)
    numbers = np.column_stack([np.ones(len(table)), table["polarity"].to_numpy(), _matrix(table["hits"], len(S.EMOTIONS))]).astype(np.int64)
    sent = messages.sparkSession.sparkContext.broadcast((table["token"].combine_chunks() if len(table) else pa.array([], pa.string()), numbers))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, numbers = sent.value
        for batch in batches:
            lists = batch.column(len(keep))
            places = pc.index_in(lists.flatten(), value_set=tokens)
            hit = places.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[hit]
            sums = _sums(row, numbers[places.drop_null().to_numpy()].T, len(lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *sums], names=[*keep, *_RATED])

    return given.mapInArrow(task, _rated_type(given, keep))


#: Columns of a rated message.
_RATED = ["found", "score", *S.EMOTIONS]


def _rated_type(given: DataFrame, keep: Sequence[str]) -> T.StructType:
    return T.StructType([given.schema[c] for c in keep] + [T.StructField(name, T.LongType()) for name in _RATED])


def _sums(row: np.ndarray, columns: Iterable[np.ndarray], rows: int) -> list[pa.Array]:
    """Each column summed by row; row is ascending, and rows without a number get 0."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    sums = []
    for column in columns:
        total = np.zeros(rows, dtype=np.int64)
        if len(starts):
            total[row[starts]] = np.add.reduceat(column, starts)
        sums.append(pa.array(total))
    return sums


def blocks_of(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.Table]:
    """The rows in tables that end when they hold so many rows and tokens."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows + len(batch.column(batch.num_columns - 1).flatten())
        if n >= tokens:
            yield pa.Table.from_batches(some).combine_chunks()
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def _rated_by_blocks(given: DataFrame, lexicon: DataFrame, keep: Sequence[str]) -> DataFrame:
    """As rated_messages, for a lexicon of any size.

    Messages are taken in blocks of about BLOCK_TOKENS tokens. A block sends one row for each of its distinct tokens, with
    the places of the messages that have it, four bytes each, and one row with the columns to keep. The rows are written
    to the shared folder, so that a task that runs again can't deal messages to blocks another way. Tokens meet the
    lexicon, and what the lexicon has meets its block again; a frequent word is one row a block.
    """
    columns = len(keep)
    block_type = "block long, token string, places binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for nth, table in enumerate(blocks_of(batches, BLOCK_TOKENS)):
            lists = table.column(columns).combine_chunks()
            words = lists.flatten().dictionary_encode()
            code = words.indices.to_numpy()
            row = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy())
            ends = np.cumsum(np.bincount(code, minlength=len(words.dictionary)))
            offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(row[np.argsort(code, kind="stable")])])
            # The column without a value holds the number of rows where nothing else is kept.
            own = table.select(keep).append_column("", pa.nulls(len(lists)))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, own.schema) as stream:
                stream.write_table(own)
            kept = pa.array([out.getvalue().to_pybytes()], pa.binary())
            # A token has no white space: this one is the block itself.
            for names, values in (([f" {first + nth}"], kept), (words.dictionary, places)):
                names = pa.array(names, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), first + nth)), names, values], names=["block", "token", "places"])

    packed = shared.keep(given.mapInArrow(pack, block_type), "sentiment-blocks")
    own = F.col("token").startswith(" ")
    known = lexicon.where(~own)
    met = packed.join(known, "token", "left").where(own | F.col("polarity").isNotNull())
    sent = met.select("block", own.alias("own"), "places", "polarity", *[F.col("hits")[i].alias(name) for i, name in enumerate(S.EMOTIONS)])

    def unpack(block: pa.Table) -> pa.Table:
        is_own = block["own"].combine_chunks()
        with pa.ipc.open_stream(block.filter(is_own)["places"][0].as_py()) as stream:
            kept = stream.read_all()
        hits = block.filter(pc.invert(is_own))
        times = pc.binary_length(hits["places"]).to_numpy() // 4
        row = np.frombuffer(b"".join(hits["places"].to_pylist()), dtype=np.int32)
        order = np.argsort(row, kind="stable")
        numbers = (np.repeat(hits[c].to_numpy(), times)[order] for c in ("polarity", *S.EMOTIONS))
        sums = _sums(row[order], chain([np.ones(len(row), dtype=np.int64)], numbers), len(kept))
        return pa.Table.from_arrays([*kept.columns[:columns], *sums], names=[*keep, *_RATED])

    return sent.groupBy("block").applyInArrow(unpack, _rated_type(given, keep))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, width) if len(lists) else np.zeros((0, width))


def message_scores(messages: DataFrame, lexicon: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """chat_id, seq, score and emotion hits of the messages that contain any lexicon token."""
    keys = list(dict.fromkeys([*keep, "chat_id", "seq"]))
    return rated_messages(messages, lexicon, keys).where("found > 0").drop("found")


def group_counts(messages: DataFrame, lexicon: DataFrame, by: Sequence[str]) -> DataFrame:
    """Messages, those above and below zero, and emotion hits of each group, all summed before the shuffle."""
    sums = [F.count_if(F.col("score") > 0).alias("_positive"), F.count_if(F.col("score") < 0).alias("_negative")]
    sums += [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in S.EMOTIONS]
    return rated_messages(messages, lexicon, by).groupBy(*by).agg(F.count("*").alias("total_messages"), *sums)


def _emotion_columns(all_hits: Column) -> list[Column]:
    return [
        F.when(all_hits > 0, F.col(name) / all_hits).otherwise(0.0).alias(name) for name in S.EMOTIONS
    ]


def sentiment(messages: DataFrame, lexicon: DataFrame, start: str | date, end: str | date, by: Sequence[str] = ()) -> DataFrame:
    """Sentiment and emotion shares of a date range, overall or per group (for example by user).

    Columns: positive, neutral, negative, one per emotion, primary_emotion, total_messages, insights. An empty
    range gives one row with total 0 (no row when grouped).
    """
    return score_groups(messages.transform(filters.analysable(start, end)), lexicon, by)


def score_groups(messages: DataFrame, lexicon: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As sentiment, over the given messages."""
    filled = group_counts(messages, lexicon, by)

    total = F.col("total_messages")
    share = {"positive": F.col("_positive"), "negative": F.col("_negative")}
    share["neutral"] = total - F.col("_positive") - F.col("_negative")
    all_hits = sum((F.col(name) for name in S.EMOTIONS[1:]), F.col(S.EMOTIONS[0]))
    ranked = F.array(*[F.struct((-F.col(name)).alias("less"), F.lit(name).alias("name")) for name in S.EMOTIONS])
    rated = filled.select(
        *by,
        *[F.when(total > 0, share[label] / total).otherwise(0.0).alias(label) for label in LABELS],
        *_emotion_columns(all_hits),
        F.when(all_hits > 0, F.array_min(ranked)["name"]).alias("primary_emotion"),
        "total_messages",
    )
    parts = [F.concat(percent(F.col(label)), F.lit(f" {label}")) for label in LABELS]
    note = F.concat(total.cast("string"), F.lit(" messages: "), F.concat_ws(", ", *parts), F.lit("."))
    return rated.withColumn("insights", F.when(total > 0, note).otherwise(NO_MESSAGES))


def sentiment_record(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The shares as nested columns: overall_sentiment struct and emotions map."""
    pairs = [part for name in S.EMOTIONS for part in (F.lit(name), F.col(name))]
    return rated.select(
        *by,
        F.struct(*LABELS).alias("overall_sentiment"),
        F.create_map(*pairs).alias("emotions"),
        "primary_emotion",
        "insights",
        "total_messages",
    )


def sentiment_scores(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The three flat scores."""
    return rated.select(*by, *[F.col(label).alias(f"{label}_score") for label in LABELS])


def topic_sentiment(assigned: DataFrame, lexicon: DataFrame, topic: int | None = None) -> DataFrame:
    """Sentiment of one topic, or of every topic; assigned has a topic column."""
    chosen = assigned if topic is None else assigned.where(F.col("topic") == topic)
    return score_groups(chosen, lexicon, ["topic"])


def emotion_rows(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per emotion above zero, with its bucket."""
    emotion = F.col("emotion")
    bucket = (
        F.when(emotion.isin(S.POSITIVE_EMOTIONS), "positive")
        .when(emotion.isin(S.NEGATIVE_EMOTIONS), "negative")
        .otherwise("other")
    )
    exploded = records.select(*keys, F.explode("emotions").alias("emotion", "value"))
    return exploded.where(F.col("value") > 0).withColumn("bucket", bucket)


def percent(share: Column) -> Column:
    """A share of 0 to 1 as a percentage with one decimal, rounded by the exact value of the binary number (ties: to even).

    The number's fraction is cut in two, so that twenty times each part is exact: the sign of their sum tells on which side
    of the middle between two tenths the number lies.
    """
    value = share * 100
    whole = F.floor(value)
    fraction = value - whole
    upper = F.floor(fraction * (1 << 26)) / (1 << 26)
    tenth = F.floor(fraction * 10)
    beyond = (upper * 20 - (tenth * 2 + 1)) + (fraction - upper) * 20
    tenths = whole * 10 + tenth + F.when((beyond > 0) | ((beyond == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def report_text(records: DataFrame, date_range: str, keys: Sequence[str] = ()) -> DataFrame:
    """A text report per record, percentages with one decimal; emotions that are not there are left out."""
    overall = F.col("overall_sentiment")
    shown = F.filter(F.map_entries("emotions"), lambda e: e["value"] > 0)
    entries = F.transform(
        F.array_sort(shown), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), percent(e["value"]))
    )
    # The report's labels.
    lines = [
        F.lit("Sentiment Analysis Report"),
        F.lit(f"Date Range: {date_range}"),
        F.concat(F.lit("Total Messages: "), F.col("total_messages").cast("string")),
        F.lit(""),
        F.lit("Overall Sentiment:"),
        *[F.concat(F.lit(f"- {label.title()}: "), percent(overall[label])) for label in LABELS],
        F.lit(""),
        F.lit("Emotions:"),
        F.array_join(entries, "\n"),
        F.lit(""),
        F.lit("Insights:"),
        F.coalesce(F.col("insights"), F.lit("N/A")),
    ]
    return records.select(*keys, F.concat_ws("\n", *lines).alias("report"))
