"""Topic models of single chats: planted topics, independence of other chats, partitions and the way words and shares meet."""

import random

import pytest

from parlance.operators import topics

GROUPS = {"food": "bread rice soup noodle cheese apple".split(), "travel": "train hotel flight beach ticket".split(), "work": "meeting report budget office".split()}


def chat(name: str, seed: int, kinds: list[str], n: int = 90) -> list[tuple]:
    """Messages of three words of one group and one word that is in all; the group is told by the user."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        kind = kinds[i % len(kinds)]
        out.append((name, i, kind, " ".join([*draw.sample(GROUPS[kind], 3), "today"])))
    return out


def told(found) -> dict:
    return {(r.chat_id, r.seq): r.topic for r in found.select("chat_id", "seq", "topic").collect()}


@pytest.fixture(scope="module")
def rows(make_messages):
    return make_messages(chat("a", 1, list(GROUPS)) + chat("b", 2, ["work", "travel"]))


def test_planted_topics_are_found(rows):
    found = topics.assign_topics(rows, topics=3).where("chat_id = 'a'").groupBy("user").pivot("topic").count().collect()
    assert len(found) == 3
    for row in found:
        counts = sorted(c or 0 for c in row[1:])
        assert counts == [0, 0, 30]


def test_other_chats_partitions_and_salts_change_nothing(rows):
    whole = told(topics.assign_topics(rows, topics=3, iterations=3))
    assert told(topics.assign_topics(rows, topics=3, iterations=3, partitions=7)) == whole
    assert told(topics.assign_topics(rows, topics=3, iterations=3, broadcast_bytes=0)) == whole
    alone = told(topics.assign_topics(rows.where("chat_id = 'b'"), topics=3, iterations=3))
    assert alone == {k: v for k, v in whole.items() if k[0] == "b"}


def test_an_iteration_has_one_exchange_of_combined_sums(rows):
    words = topics.counted_words(rows, None, ["chat_id"], 4).persist()
    words.count()
    counts = topics.keep(topics._shared(words.selectExpr("*", "0L as s0", "n as s1"), ["chat_id"], 2), "test")
    step = topics._shared(topics._scored(words, topics._weights(counts, ["chat_id"], 2, True), ["chat_id"], 2, True), ["chat_id"], 2)
    plan = step._jdf.queryExecution().executedPlan().toString().partition("InMemoryTableScan")[0]
    words.unpersist()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan


def test_one_model_for_groups_of_another_key(rows):
    """By user: every group has one kind of messages, and its own topics."""
    found = topics.assign_topics(rows, topics=2, iterations=2, by=["chat_id", "user"])
    assert found.columns == rows.columns + ["topic"] and found.where("topic is null").count() == 0
    assert found.select("chat_id", "user", "topic").distinct().count() <= 10


def test_fewer_words_than_topics_and_no_words(make_messages, spark):
    few = make_messages([("one", 0, "u", "hello")] + [("none", 1, "u", "a b")])
    assert told(topics.assign_topics(few, topics=5)) == {("one", 0): 0, ("none", 1): None}
    assert topics.assign_topics(few.where("false")).count() == 0
    stop = spark.createDataFrame([("hello",)], "word string")
    assert told(topics.assign_topics(few, stop)) == {("one", 0): None, ("none", 1): None}


def test_blocks_tell_what_rows_of_words_tell(rows, spark, monkeypatch):
    """Small blocks, a stop word, a message in two rows, one of stop words alone and ones without a key."""
    by = ["chat_id", "user"]
    stop = spark.createDataFrame([("today",), ("hotel",)], "word string")
    odd = rows.where("seq < 3").unionByName(rows.where("seq in (4, 5)").selectExpr("* except (message)", "'Today hotel' as message").withColumn("seq", topics.F.col("seq") + 500))
    odd = odd.unionByName(rows.where("seq = 6").withColumn("seq", topics.F.lit(None).cast("long"))).unionByName(rows.where("seq = 7").withColumn("chat_id", topics.F.lit(None).cast("string")))
    given = rows.unionByName(odd)

    def counted(**options):
        found = topics.assign_topics(given, stop, 3, 2, by=by, **options)
        return sorted(map(str, found.select("chat_id", "seq", "user", "message", "topic").collect()))

    whole = counted()
    monkeypatch.setattr(topics, "ROWS", 0)
    monkeypatch.setattr(topics, "BLOCK_TOKENS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    packed = topics.packed_words(given, by, 3)
    assert packed.where("word is not null").select("block").distinct().count() > 6
    # Neither a row for each word of each message nor a message's text is left.
    assert packed.where("word is not null").count() < given.count() * 3
    try:
        assert counted(partitions=3) == whole and len(whole) == given.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_and_shards_exchange_rows_of_many_words(rows, spark, monkeypatch):
    """Words of several shards, of which a step sends one row for each block and shard, not one for each word."""
    want = told(topics.assign_topics(rows, None, 3, 2))
    monkeypatch.setattr(topics, "ROWS", 0)
    monkeypatch.setattr(topics, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(topics, "SHARD_ENTRIES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    steps, keep = [], topics.keep
    monkeypatch.setattr(topics, "keep", lambda df, name: steps.append((name, keep(df, name))) or steps[-1][1])
    try:
        assert told(topics.assign_topics(rows, None, 3, 2, partitions=3)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = steps[0][1].where("word is not null").count()
    sent = [df.count() for name, df in steps if name == "topics-step" and "data" in df.columns]
    pairs = next(df for name, df in steps if name == "topics-entries").select("block", "shard").distinct().count()
    assert len(sent) == 3 + 1 + 2 and set(sent) == {pairs} and pairs < words / 2
