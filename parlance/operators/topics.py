"""Topics of a date range: assignment by a model of each chat, then one summary row per topic."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text
from parlance.operators import filters
from parlance.operators.ordering import first_n
from parlance.operators.sentiment import LABELS, SALTS, blocks_of, score_groups, sized_broadcast
from parlance.sources.shared import keep

MINIMUM_MESSAGES = 10
KEYWORDS = 3
#: Shares and logarithms are whole numbers of 1 / ONE.
ONE = 1 << 20
#: Added to the count of each word in each topic.
SMOOTHING = 0.1
#: The shares of all chats' words go with the tasks up to this size.
FACTOR_BYTES = 64 << 20
#: Messages with more words, each counted once a message, are fitted by blocks.
ROWS = 200_000
#: Tokens of a block.
BLOCK_TOKENS = 1_000_000
#: Words of blocks, each counted once a block, whose sums are made together.
SHARD_ENTRIES = 500_000
# Fixed value: the summary of a chat with too few messages.
TOO_FEW = "Not enough messages."
CHAT = ("chat_id",)
TOPIC_FIELDS = (
    "topic_name: string, description: string, participants: array<string>, message_count: bigint, "
    "sentiment: struct<positive: double, neutral: double, negative: double>, key_keywords: array<string>"
)


def with_enough_messages(messages: DataFrame, by: Sequence[str] = CHAT) -> DataFrame:
    """Only the chats with at least ten messages."""
    counts = messages.groupBy(*by).agg(F.count("*").alias("n"))
    return messages.join(counts.where(F.col("n") >= MINIMUM_MESSAGES).select(*by), list(by), "left_semi")


def _meet(rows: DataFrame, table: DataFrame, keys: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """An equality join with a written table, broadcast if its size, counted before, is small.

    Else both sides are shuffled by keys and salt: a hot key goes to `SALTS` tasks, each with a copy of its row.
    """
    if small:
        return rows.join(F.broadcast(table), list(keys), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("chat_id", "seq", *keys), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def counted_words(messages: DataFrame, stopwords: DataFrame | None, by: Sequence[str], partitions: int) -> DataFrame:
    """(chat_id, seq, word, n) of messages with a counted word, dealt and sorted by message; the word '' stands for the message itself."""
    keys = list(dict.fromkeys([*by, "chat_id", "seq"]))
    tokens = F.filter(text.sentiment_tokens(F.col("message")), lambda t: F.length(t) > 2)
    dealt = messages.select(*keys, tokens.alias("_tokens")).where(F.size("_tokens") > 0).repartition(partitions, "chat_id", "seq")
    words = dealt.select(*keys, F.explode("_tokens").alias("word"))
    if stopwords is not None:
        words = words.join(sized_broadcast(stopwords.select("word").distinct(), "word"), "word", "left_anti")
    counts = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    whole = words.groupBy(*keys).agg(F.lit("").alias("word"), F.lit(1).cast("long").alias("n"))
    # With the repartition by number the plan knows, and keeps, that a message's rows lie side by side.
    return counts.unionByName(whole.select(*keys, "word", "n")).repartition(partitions, "chat_id", "seq").sortWithinPartitions("chat_id", "seq")


def _seeds(words: DataFrame, by: Sequence[str], topics: int, sizes: DataFrame, few: bool) -> DataFrame:
    """(by, word, seed): for each group the words that start its topics, seed 0 to topics - 1; fewer if there are no more.

    Each is the word that is in most messages without an earlier seed, weighed down by how common it is in the group.
    """
    spark = words.sparkSession
    found = None
    for seed in range(topics):
        open_ = F.lit(True)
        rows = words
        if found is not None:
            rows = _meet(words, found, [*by, "word"], few, "left")
            open_ = F.max("seed").over(W.partitionBy("chat_id", "seq")).isNull()
        counts = rows.withColumn("_open", open_).where("word <> ''").groupBy(*by, "word").agg(F.count("*").alias("_in"), F.count_if("_open").alias("_new"))
        sized = counts.where("_new > 0").join(F.broadcast(sizes) if few else sizes, list(by))
        score = F.col("_new") * F.log(F.col("_all") / F.col("_in"))
        best = first_n(sized.withColumn("_score", score), 1, [F.desc("_score"), F.col("word")], by)
        one = best.select(*by, "word", F.lit(seed).alias("seed"))
        found = keep(one if found is None else found.unionByName(one), "topics-seeds")
    return found if found is not None else spark.createDataFrame([], words.select(*by, "word").schema.add("seed", "int"))


def _weights(factors: DataFrame, by: Sequence[str], topics: int, few: bool) -> DataFrame:
    """From counts (by, word, c0, c1, ...): whole-number logarithms of each word's share of each topic (l0, l1, ...); '': the topic's share."""
    each = range(topics)
    totals = factors.groupBy(*by).agg(
        F.count_if(F.col("word") != "").alias("_words"),
        *[F.sum(F.when(F.col("word") != "", F.col(f"c{t}")).otherwise(0)).alias(f"_t{t}") for t in each],
        F.sum(F.when(F.col("word") == "", sum(F.col(f"c{t}") for t in each))).alias("_messages"),
    )
    met = factors.join(F.broadcast(totals) if few else totals, list(by))

    return met.select(*by, "word", *_logarithms(F.col("word") == "", topics))


def _logarithms(whole: Column, topics: int) -> list[Column]:
    """l0, l1, ... of rows with c0, c1, ... and their group's totals; whole: the row is the message itself."""

    def weight(t: int) -> Column:
        own = F.log((F.col(f"c{t}") / ONE + SMOOTHING) / (F.col(f"_t{t}") / ONE + SMOOTHING * F.col("_words")))
        prior = F.log((F.col(f"c{t}") / ONE + 1) / (F.col("_messages") / ONE + topics))
        return F.round(F.when(whole, prior).otherwise(own) * ONE).cast("long").alias(f"l{t}")

    return [weight(t) for t in range(topics)]


def _scored(words: DataFrame, weights: DataFrame, by: Sequence[str], topics: int, small: bool) -> DataFrame:
    """words with the score of their message under each topic (s0, s1, ...), sums of whole numbers."""
    message = W.partitionBy("chat_id", "seq")
    met = _meet(words, weights, [*by, "word"], small)
    return met.select(*words.columns, *[F.sum(F.col(f"l{t}") * F.col("n")).over(message).alias(f"s{t}") for t in range(topics)])


def _shared(scored: DataFrame, by: Sequence[str], topics: int) -> DataFrame:
    """Counts (by, word, c0, c1, ...) of words, dealt to topics as the messages' scores say, in parts of 1 / ONE."""
    most = F.greatest(*[F.col(f"s{t}") for t in range(topics)]) if topics > 1 else F.col("s0")
    raised = scored.select("*", *[F.exp((F.col(f"s{t}") - most) / ONE).alias(f"e{t}") for t in range(topics)])
    total = sum((F.col(f"e{t}") for t in range(1, topics)), F.col("e0"))
    parts = raised.select(*by, "word", "n", *[F.round(F.col(f"e{t}") / total * ONE).cast("long").alias(f"r{t}") for t in range(topics)])
    return parts.groupBy(*by, "word").agg(*[F.sum(F.col(f"r{t}") * F.col("n")).alias(f"c{t}") for t in range(topics)])


def packed_words(messages: DataFrame, by: Sequence[str], partitions: int) -> DataFrame:
    """Blocks of messages, as a table in the shared folder with three kinds of rows.

    One for each distinct word of a group in a block, its entry: its place in the block and the number `n` of messages that
    have it; the word '' stands for the messages themselves. One for each block, with all of its words in `places` (see
    `_Block`). And one for each message: its keys, and as `block` its number, which is the block's plus the message's place.
    Messages are dealt by ranges of group and sequence number, so a block has few groups. Messages whose group is null are
    left out, they can't be told a topic.
    """
    keys = list(dict.fromkeys([*by, "chat_id", "seq"]))
    dealt = messages.select(*keys, "message").dropna(subset=by).repartitionByRange(partitions, *keys)
    # The rows of equal keys are one message, and lie in one range.
    joined = dealt.groupBy(*keys).agg(F.concat_ws(" ", F.collect_list("message")).alias("_message"))
    tokens = F.filter(text.sentiment_tokens(F.col("_message")), lambda t: F.length(t) > 2)
    whole = joined.sortWithinPartitions(*keys).select(*keys, tokens.alias("_tokens"))
    names = ["block", "entry", *keys, "word", "n", "places"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("entry", T.IntegerType()), *[T.StructField(k, whole.schema[k].dataType) for k in keys]])
    schema = schema.add("word", "string").add("n", "long").add("places", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for table in blocks_of(batches, BLOCK_TOKENS):
            # Not in a `where`, for which Spark would make the tokens twice.
            table = table.filter(pc.greater(pc.list_value_length(table.column(len(keys))), 0)).combine_chunks()
            if not len(table):
                continue
            lists = table.column(len(keys)).combine_chunks()
            words = lists.flatten().dictionary_encode()
            width, n = len(words.dictionary), len(table)
            # Codes in the order of the words, by which equal seeds are told apart.
            order = pc.sort_indices(words.dictionary).to_numpy()
            ranks = np.empty(width, dtype=np.int64)
            ranks[order] = np.arange(width)
            codes = [table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in by]
            _, own, group = np.unique(np.column_stack(codes), axis=0, return_index=True, return_inverse=True)
            group = group.reshape(-1)
            at = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
            pairs, times = np.unique(at * width + ranks[words.indices.to_numpy()], return_counts=True)
            # A code beyond those of the words stands for the message itself.
            message = np.concatenate([pairs // width, np.arange(n)])
            code = group[message] * (width + 1) + np.concatenate([pairs % width, np.full(n, width)])
            by_code = np.argsort(code, kind="stable")
            found, sizes = np.unique(code[by_code], return_counts=True)
            times = np.concatenate([times, np.ones(n, dtype=np.int64)])[by_code]
            numbers = [[len(found), len(code)], found // (width + 1), sizes, message[by_code], times]
            places = b"".join(np.asarray(x, dtype=np.int32).tobytes() for x in numbers)
            word = pa.concat_arrays([words.dictionary.take(pa.array(order)), pa.array([""], words.dictionary.type)]).take(pa.array(found % (width + 1)))
            chosen = table.take(pa.array(own[found // (width + 1)]))
            columns = [chosen[k] if k in by else pa.nulls(len(found), table[k].type) for k in keys]
            entry = pa.array(np.arange(len(found)), pa.int32())
            blocks = [pa.array(np.full(len(found), first)), entry, *columns, word.cast(pa.string()), pa.array(sizes), pa.nulls(len(found), pa.binary())]
            yield from pa.Table.from_arrays(blocks, names=names).to_batches()
            itself = [pa.array([first]), pa.nulls(1, pa.int32()), *[pa.nulls(1, table[k].type) for k in keys]]
            yield from pa.Table.from_arrays([*itself, pa.nulls(1, pa.string()), pa.array([n]), pa.array([places], pa.binary())], names=names).to_batches()
            none = [pa.nulls(n, kind) for kind in (pa.string(), pa.int64(), pa.binary())]
            own_rows = [pa.array(first + np.arange(n)), pa.nulls(n, pa.int32()), *[table[k] for k in keys], *none]
            yield from pa.Table.from_arrays(own_rows, names=names).to_batches()
            first += n

    return keep(whole.mapInArrow(pack, schema), "topics-blocks")


def _dealt_entries(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of entries (shard, block, entry, by, word, total) the ones of each block in each shard: their places in the block, which
    of them are the first of their word (`data`, five bytes each), and their words' numbers in the shard (`ids`)."""

    def deal(table: pa.Table) -> pa.Table:
        number = np.zeros(len(table), dtype=np.int64)
        for name in [*by, "word", "total"]:
            code = table[name].combine_chunks().dictionary_encode()
            _, first, number = np.unique(number * len(code.dictionary) + code.indices.to_numpy(), return_index=True, return_inverse=True)
            number = number.reshape(-1)
        own = np.zeros(len(table), dtype=np.uint8)
        own[first] = 1
        block, entry = table["block"].to_numpy(), table["entry"].to_numpy().astype(np.int32)
        order = np.argsort(block, kind="stable")
        blocks, starts = np.unique(block[order], return_index=True)
        parts = np.split(order, starts[1:])
        return pa.table(
            {
                "shard": pa.array(np.full(len(blocks), table["shard"][0].as_py()), pa.int32()),
                "block": blocks,
                "data": pa.array([entry[p].tobytes() + own[p].tobytes() for p in parts], pa.binary()),
                "ids": pa.array([number[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
                "size": pa.array(np.full(len(blocks), len(first)), pa.int32()),
            }
        )

    return keep(dealt.groupBy("shard").applyInArrow(deal, "shard int, block long, data binary, ids binary, size int"), "topics-entries")


def _added(members: pa.Table, values: pa.Table) -> pa.Table:
    """Numbers of a shard's entries, summed over the blocks for each word and told to all blocks that have it."""
    ids = {b: np.frombuffer(i, dtype=np.int32) for b, i in zip(members["block"].to_pylist(), members["ids"].to_pylist())}
    given = {b: np.frombuffer(d, dtype=np.int64).reshape(-1, len(ids[b])) for b, d in zip(values["block"].to_pylist(), values["data"].to_pylist())}
    shard = pa.array(np.full(len(given), members["shard"][0].as_py()), pa.int32())
    sums = np.zeros((max([len(g) for g in given.values()], default=0), members["size"][0].as_py()), dtype=np.int64)
    for block, numbers in given.items():
        # A word is one entry of a block.
        sums[:, ids[block]] += numbers
    return pa.table({"block": pa.array(given, pa.int64()), "shard": shard, "data": pa.array([sums[:, ids[b]].tobytes() for b in given], pa.binary())})


class _Block:
    """The words of a block of messages, from its rows (block, kind, shard, data).

    Entries are sorted by group and word, a group's last is that of the messages themselves. Behind the m entries there is one
    for all words of each group. Kind 0 has the words: numbers of entries and of pairs, groups and sizes of the entries, then
    of all pairs of entry and message the message and how often it has the word. Kind 1 has the entries that go to a shard
    (others are stop words), kind 2 what came back from it for `sizes`.
    """

    def __init__(self, table: pa.Table):
        self.number = table["block"][0].as_py()
        rows = sorted(zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["data"].to_pylist()), key=lambda r: r[:2])
        numbers = np.frombuffer(rows[0][2], dtype=np.int32)
        self.m, pairs = int(numbers[0]), int(numbers[1])
        self.group, sizes, message, times = np.split(numbers[2:], [self.m, 2 * self.m, 2 * self.m + pairs])
        self.last = np.flatnonzero(np.diff(self.group, append=-1))
        self.whole = np.zeros(self.m, dtype=bool)
        self.whole[self.last] = True
        self.shards, owned = {}, np.zeros(self.m + len(self.last), dtype=bool)
        for _, shard, data in (r for r in rows if r[0] == 1):
            n = len(data) // 5
            entry = np.frombuffer(data, dtype=np.int32, count=n).astype(np.int64)
            place = np.where(entry >= 0, entry, self.m + self.group[np.where(entry >= 0, 0, -1 - entry)])
            self.shards[shard] = place
            owned[place] = np.frombuffer(data, dtype=np.uint8, offset=4 * n) == 1
        live = np.zeros(self.m + len(self.last), dtype=bool)
        live[np.concatenate(list(self.shards.values()))] = True
        self.word = live[: self.m] & ~self.whole
        self.owned = owned[: self.m] & self.word
        row = np.repeat(np.arange(self.m), sizes)
        self.n = int(message.max()) + 1
        self.counted = np.zeros(self.n, dtype=bool)
        self.counted[message[self.word[row]]] = True
        # A message whose words are all stop words is none.
        known = self.counted[message] & live[row]
        self.message, self.times, self.row = message[known], times[known], row[known]
        told = {shard: data for kind, shard, data in rows if kind == 2}
        self.told = self.returned(told)[0] if told else None

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers of the pairs, summed by entry; exact below 2^53."""
        return np.bincount(self.row, values, self.m).astype(np.int64)

    def with_totals(self, numbers: np.ndarray) -> np.ndarray:
        """Numbers of entries, and behind them the sums over the words of each group."""
        totals = np.bincount(self.group[self.word], numbers[self.word], len(self.last)).astype(np.int64)
        return np.concatenate([numbers, totals])

    def sent(self, numbers: list[np.ndarray]) -> pa.Table:
        """Numbers of the entries and groups, to their shards."""
        whole = np.stack(numbers)
        data = [np.ascontiguousarray(whole[:, place]).tobytes() for place in self.shards.values()]
        return pa.table({"shard": pa.array(self.shards, pa.int32()), "block": pa.array(np.full(len(data), self.number)), "data": pa.array(data, pa.binary())})

    def returned(self, data: dict[int, bytes]) -> np.ndarray:
        found = None
        for shard, numbers in data.items():
            place = self.shards[shard]
            rows = np.frombuffer(numbers, dtype=np.int64).reshape(-1, len(place))
            found = np.zeros((len(rows), self.m + len(self.last)), dtype=np.int64) if found is None else found
            found[:, place] = rows
        return found

    def sizes(self) -> pa.Table:
        """How many messages have a word, how many a group has, and in how many words."""
        words = np.bincount(self.group[self.owned], minlength=len(self.last))
        return self.sent([np.concatenate([self.sums(np.ones(len(self.row))), words])])

    def scores(self, counts: np.ndarray) -> list[np.ndarray]:
        """Of every message under each topic, by logarithms as in `_logarithms`."""
        topics, own = len(counts), counts[:, : self.m]
        words = self.told[self.m :][self.group]
        messages = own[:, self.last].sum(axis=0)[self.group]
        found = []
        for t in range(topics):
            total = counts[t, self.m :][self.group]
            share = np.where(
                self.whole,
                (own[t] / ONE + 1) / (messages / ONE + topics),
                (own[t] / ONE + SMOOTHING) / np.maximum(total / ONE + SMOOTHING * words, SMOOTHING),
            )
            weight = np.floor(np.log(share) * ONE + 0.5)
            found.append(np.bincount(self.message, weight[self.row] * self.times, self.n))
        return found

    def shared(self, scores: list[np.ndarray]) -> pa.Table:
        """As `_shared`, of this block alone."""
        raised = [np.exp((s - np.max(scores, axis=0)) / ONE) for s in scores]
        total = sum(raised[1:], raised[0])
        parts = [np.floor(e / total * ONE + 0.5) for e in raised]
        return self.sent([self.with_totals(self.sums(part[self.message] * self.times)) for part in parts])

    def seeds(self, found: pa.Table) -> np.ndarray:
        """The smallest seed of each message; one more than any int where it has none."""
        seed = np.full(self.m, 1 << 31)
        seed[found["entry"].to_numpy()] = found["seed"].to_numpy()
        least = np.full(self.n, 1 << 31)
        np.minimum.at(least, self.message, seed[self.row])
        return least

    def candidates(self, new: np.ndarray) -> pa.Table:
        """Of each group the best next seed among the words that are first in this block."""
        own = np.flatnonzero(self.owned & (new[: self.m] > 0))
        score = new[own] * np.log(self.told[self.last][self.group[own]] / self.told[own])
        order = np.lexsort((own, -score, self.group[own]))
        _, first = np.unique(self.group[own][order], return_index=True)
        best = order[first]
        return pa.table({"block": pa.array(np.full(len(best), self.number)), "entry": pa.array(own[best], pa.int32()), "score": pa.array(score[best])})


def _told_by_blocks(packed: DataFrame, stopwords: DataFrame | None, by: Sequence[str], topics: int, iterations: int, partitions: int, limit: int) -> DataFrame:
    """Keys and topic of the messages of `packed_words` that have a counted word, by the model of `assign_topics`.

    A block keeps its words in one place, and distinct words are dealt to shards. In an iteration a block sends the sums of
    its entries, as one row for each shard, and the shard sends back the sums over all blocks: eight bytes a topic for each
    entry, both ways, in rows of thousands. Nothing is held whole.
    """
    listed = packed.where("word is not null")
    entries = listed.select("block", "entry", *by, "word")
    if stopwords is not None:
        entries = entries.join(stopwords.select("word").where("word <> ''"), "word", "left_anti")
    few = listed.where("word = ''").select(*by).distinct().count() * topics * (64 + 16 * topics) <= limit

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    # A group's entry has a double for all its words.
    both = F.explode(F.when(F.col("word") == "", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    doubled = entries.select("block", "entry", *by, "word", both.alias("total"))
    shard = F.pmod(F.xxhash64(*by, "word", "total"), F.lit(max(1, -(-listed.count() // SHARD_ENTRIES)))).cast("int")
    place = F.when(F.col("total"), -1 - F.col("entry")).otherwise(F.col("entry"))
    dealt = _dealt_entries(doubled.select(shard.alias("shard"), "block", place.alias("entry"), *by, "word", "total"), by)
    members = dealt.select("shard", "block", "ids", "size").repartition(partitions, "shard").persist(StorageLevel.MEMORY_AND_DISK)
    words = packed.where("places is not null").select("block", F.lit(0).alias("kind"), F.lit(0).alias("shard"), F.col("places").alias("data"))
    base = words.unionByName(dealt.select("block", F.lit(1).alias("kind"), "shard", "data"))
    schema = "shard int, block long, data binary"

    def summed(values: DataFrame) -> DataFrame:
        other = values.toDF(*values.columns)
        return members.groupBy("shard").cogroup(other.groupBy("shard")).applyInArrow(_added, "block long, shard int, data binary")

    def step(given: DataFrame, work: Callable[[_Block, pa.Table], pa.Table], schema: str) -> DataFrame:
        def task(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(_Block(left), right)

        # Columns of their own, as rows that were made of the blocks would be taken for them.
        other = given.toDF(*given.columns)
        return keep(state.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(task, schema), "topics-step")

    def numbers(block: _Block, rows: pa.Table) -> np.ndarray:
        return block.returned(dict(zip(rows["shard"].to_pylist(), rows["data"].to_pylist())))

    def fresh(block: _Block, found: pa.Table) -> pa.Table:
        new = block.sums((block.seeds(found) == 1 << 31)[block.message])
        return block.sent([np.concatenate([new, np.zeros(len(block.last), dtype=np.int64)])])

    def offered(block: _Block, new: pa.Table) -> pa.Table:
        return block.candidates(numbers(block, new)[0])

    def begun(block: _Block, found: pa.Table) -> pa.Table:
        start = block.seeds(found)
        return block.shared([np.where((start == t) | (start == 1 << 31), 0.0, -64.0 * ONE) for t in range(topics)])

    def again(block: _Block, counts: pa.Table) -> pa.Table:
        return block.shared(block.scores(numbers(block, counts)))

    def best(block: _Block, counts: pa.Table) -> pa.Table:
        told = np.flatnonzero(block.counted)
        topic = np.argmax(block.scores(numbers(block, counts)), axis=0)[told].astype(np.int32)
        return pa.table({"block": block.number + told, "topic": topic})

    state = None
    try:
        sizes = keep(base.groupBy("block").applyInArrow(lambda table: _Block(table).sizes(), schema), "topics-sizes")
        told = keep(summed(sizes), "topics-sizes")
        state = base.unionByName(told.select("block", F.lit(2).alias("kind"), "shard", "data"))
        state = state.repartition(partitions, "block").persist(StorageLevel.MEMORY_AND_DISK)
        found = packed.sparkSession.createDataFrame([], "block long, entry int, seed int")
        for seed in range(topics):
            new = step(found, fresh, schema)
            best_of_blocks = step(summed(new), offered, "block long, entry int, score double")
            named = listed.select("block", "entry", *by, "word").join(small(best_of_blocks), ["block", "entry"])
            one = first_n(named, 1, [F.desc("score"), F.col("word")], by).select(*by, "word", F.lit(seed).alias("seed"))
            everywhere = listed.select("block", "entry", *by, "word").join(small(keep(one, "topics-seeds")), [*by, "word"])
            found = keep(found.unionByName(everywhere.select("block", "entry", "seed")), "topics-seeds")
        counts = step(found, begun, schema)
        for _ in range(iterations):
            counts = step(summed(counts), again, schema)
        topic = step(summed(counts), best, "block long, topic int")
    finally:
        members.unpersist()
        if state is not None:
            state.unpersist()
    keys = [c for c in packed.columns if c not in ("block", "entry", "word", "n", "places")]
    return packed.where("word is null and places is null").join(topic, "block").select(*keys, "topic")


def assign_topics(
    messages: DataFrame,
    stopwords: DataFrame | None = None,
    topics: int = 5,
    iterations: int = 6,
    partitions: int | None = None,
    by: Sequence[str] = CHAT,
    broadcast_bytes: int = FACTOR_BYTES,
) -> DataFrame:
    """The messages with the number of their most likely topic; a message without a counted word has none (null).

    One model for each chat (or group of `by`), fitted on that chat's messages alone, all chats in the same jobs: a message
    is of one topic, a topic draws words with its own shares, and expectation and maximisation take turns. Each chat's
    topics start from seed words, each the one that is in most messages without an earlier seed. Every word counts.
    All sums are over whole numbers, so a result depends neither on partitions nor on the order of rows, and a chat's
    topics not on what other chats are there. Ties go to the smaller topic number.

    Messages of up to ROWS words (counted once a message) whose chats' shares fit `broadcast_bytes` are rows of words: an
    iteration is one pass over them with one exchange, of (chat, word) sums combined before it. More are packed into
    blocks (see `_told_by_blocks`). The counts of an iteration are written to the shared folder. A lost executor's words
    are computed again.
    """
    by = list(by)
    partitions = partitions or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed_words(messages, by, partitions)
    met, size = packed.where("word <> ''").agg(F.sum("n"), F.sum(F.octet_length("word") + 64 + 8 * topics)).first()
    if (met or 0) > ROWS or (size or 0) > broadcast_bytes:
        return _with_topic(messages, _told_by_blocks(packed, stopwords, by, topics, iterations, partitions, broadcast_bytes))
    lazy = counted_words(messages, stopwords, by, partitions)
    words = lazy.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = keep(words.where("word = ''").groupBy(*by).agg(F.count("*").alias("_all")), "topics-sizes")
        # Rows of the tables by group and of the seeds: a proven bound of their sizes.
        few = sizes.count() * topics * (64 + 16 * topics) <= broadcast_bytes
        seeds = _seeds(words, by, topics, sizes, few)
        start = F.min("seed").over(W.partitionBy("chat_id", "seq"))
        seeded = _meet(words, seeds, [*by, "word"], few, "left").withColumn("_start", start)
        # A message of a seed's topic starts there, others in all topics alike.
        first = [F.when(F.col("_start") == t, 0).when(F.col("_start").isNull(), 0).otherwise(-64 * ONE).cast("long") for t in range(topics)]
        factors = keep(_shared(seeded.select(*words.columns, *[c.alias(f"s{t}") for t, c in enumerate(first)]), by, topics), "topics")
        for _ in range(iterations):
            factors = keep(_shared(_scored(words, _weights(factors, by, topics, few), by, topics, True), by, topics), "topics")
        final = _scored(words, _weights(factors, by, topics, few), by, topics, True).where("word = ''")
        scores = F.array(*[F.col(f"s{t}") for t in range(topics)])
        best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
        told = keep(final.select("chat_id", "seq", best.alias("topic")), "topics-of-messages")
    finally:
        words.unpersist()
    return _with_topic(messages, told)


def _with_topic(messages: DataFrame, told: DataFrame) -> DataFrame:
    keys = [c for c in told.columns if c != "topic"]
    return messages.drop("topic").join(told, keys, "left").select(*[c for c in messages.columns if c != "topic"], "topic")


def topic_keywords(assigned: DataFrame, stopwords: DataFrame | None = None, n: int = KEYWORDS, by: Sequence[str] = CHAT) -> DataFrame:
    """The n most frequent longer words of each topic, as one array per topic."""
    keys = [*by, "topic"]
    tokens = F.filter(text.sentiment_tokens(F.col("message")), lambda t: F.length(t) > 2)
    counts = assigned.select(*keys, F.explode(tokens).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    if stopwords is not None:
        counts = counts.join(stopwords.select("word"), "word", "left_anti")
    top = first_n(counts, n, [F.desc("n"), F.col("word")], keys)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy(*keys).agg(F.transform(ordered, lambda one: one["word"]).alias("key_keywords"))


def summarize_topics(
    assigned: DataFrame, lexicon: DataFrame, stopwords: DataFrame | None = None, by: Sequence[str] = CHAT
) -> DataFrame:
    """One row per chat and topic: name, description, participants, message count, sentiment, keywords.

    Messages without a topic are in none. The participants of one chat are bounded by its membership, so they fit in one array.
    """
    keys = [*by, "topic"]
    assigned = assigned.where(F.col("topic").isNotNull())
    users = assigned.groupBy(*keys, "user").agg(F.count("*").alias("n"))
    people = users.groupBy(*keys).agg(
        F.sum("n").alias("message_count"), F.sort_array(F.collect_list("user")).alias("participants")
    )
    shares = score_groups(assigned, lexicon, keys).select(*keys, F.struct(*LABELS).alias("sentiment"))
    joined = people.join(shares, keys).join(topic_keywords(assigned, stopwords, by=by), keys, "left")
    keywords = F.coalesce(F.col("key_keywords"), F.array().cast("array<string>"))
    return joined.select(
        *keys,
        F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string")).alias("topic_name"),
        F.array_join(keywords, ", ").alias("description"),
        "participants",
        "message_count",
        "sentiment",
        keywords.alias("key_keywords"),
    )


def topics(
    messages: DataFrame,
    lexicon: DataFrame,
    start: str | date,
    end: str | date,
    k: int = 5,
    stopwords: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Topic rows of a date range; chats with fewer than ten messages in it have none."""
    chosen = messages.transform(filters.analysable(start, end)).transform(with_enough_messages)
    return summarize_topics(assign_topics(chosen, stopwords, k, **options), lexicon, stopwords)


def topics_record(
    topic_rows: DataFrame, messages: DataFrame, start: str | date, end: str | date, by: Sequence[str] = CHAT
) -> DataFrame:
    """One row per chat in the export shape: date_range, total_messages, topics, analysis_summary.

    A chat without messages in the range has a row too, with total 0 and no topics.
    """
    fields = ["topic_name", "description", "participants", "message_count", "sentiment", "key_keywords"]
    listed = F.sort_array(F.collect_list(F.struct("topic", *fields)))
    all_topics = topic_rows.groupBy(*by).agg(listed.alias("_topics"))
    inside = messages.transform(filters.analysable(start, end)).groupBy(*by).agg(F.count("*").alias("_n"))
    # As many rows as there are chats; counted first, so that only those counts meet.
    everyone = messages.groupBy(*by).agg(F.count("*").alias("_all")).drop("_all")
    totals = everyone.join(inside, list(by), "left").withColumn("total_messages", F.coalesce("_n", F.lit(0)))
    empty = F.array().cast(f"array<struct<{TOPIC_FIELDS}>>")
    plain = F.transform("_topics", lambda t: F.struct(*[t[f].alias(f) for f in fields]))
    names = F.array_join(F.transform("_topics", lambda t: t["topic_name"]), ", ")
    return totals.join(all_topics, list(by), "left").select(
        *by,
        F.lit(f"{start} to {end}").alias("date_range"),
        "total_messages",
        F.coalesce(plain, empty).alias("topics"),
        F.when(F.col("_topics").isNull(), TOO_FEW).otherwise(F.concat(F.lit("Topics: "), names)).alias("analysis_summary"),
    )
