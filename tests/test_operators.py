"""Operators against plain Python on small tables, with block and stripe sizes that force the large-data paths."""

import random
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators import activity, answers, filters, ordering, response, responses, retrieval, sentiment, topics, words
from parlance.operators.nearest import nearest
from parlance.schema import EMOTIONS, PERIODS
from parlance.sources import stopwords, store


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_words_follow_python_split(spark):
    values = [" a b\x1cc ", "", "  ", "x\n\ny z", "q\x85r　"]
    assert column(spark, values, text.words) == [v.split() for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_language(spark):
    values = ["আমি ok", "আমি", "नमस्ते 1", "नमस्ते", "plain", "नम আমি"]
    assert column(spark, values, text.language) == ["benglish", "bengali", "hinglish", "hindi", "english", "bengali"]


def test_normalize(spark):
    values = ["KYA kya Kya, akya Kya_", "Bhai BHAI", "éKya"]
    assert column(spark, values, text.normalize) == ["kya kya kya, akya Kya_", "bhai bhai", "éKya"]


def test_urls(spark):
    values = ["see http://a.b/c and www.x.y, foo.com/p me@foo.com a.b", "end. Next", "x.org.", "ftp://h"]
    found = column(spark, values, text.urls)
    assert found == [["http://a.b/c", "www.x.y,", "foo.com/p"], [], ["x.org"], ["ftp://h"]]
    assert column(spark, values, text.url_count) == [3, 0, 1, 1]


def test_emojis_count_code_points(spark):
    assert column(spark, ["a👍🏽 b😀😀 ©", "1#*"], text.emojis) == [["👍", "🏽", "😀", "😀", "©"], []]


def test_clean(spark):
    values = ["a <Media  Omitted> b http://x y wwwz", "keep < this"]
    assert column(spark, values, text.clean) == ["a  b  y ", "keep < this"]


def test_terms(spark):
    values = ["It's 12 12's 3d x don't <b>"]
    found = column(spark, values, lambda v: F.transform(text.terms(v), text.term_of))
    assert found == [["it", "3d", "don't"]]


def test_system_flag(make_messages):
    rows = make_messages([("c", 0, "A", "I LEFT"), ("c", 1, "Meta AI", "x"), ("c", 2, "A", "hello"), ("c", 3, "Bill removed", "x")])
    assert [r.is_system_message for r in rows.orderBy("seq").collect()] == [True, True, False, True]


def test_ranges():
    assert filters.valid_range("2024-01-01", "2024-01-01")
    assert not filters.valid_range("2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        filters.valid_range("soon", "later")
    with pytest.raises(ValueError):
        filters.between_dates("2024-01-02", "2024-01-01")


def test_presets_include_both_ends(make_messages):
    rows = make_messages([("c", 1440 * d, "A", "x") for d in range(40)])
    kept = rows.transform(filters.preset("Last 7 Days", "2024-03-20")).select("only_date").collect()
    assert len(kept) == 8
    assert rows.transform(filters.preset("All Time", "2024-03-20")).count() == 40


def test_media_marker_variants(make_messages):
    rows = make_messages([("c", 0, "A", "<Media omitted>"), ("c", 1, "A", "word")])
    assert activity.basic_stats(rows).first().media == 1
    assert activity.basic_stats(rows, media_marker="<Media omitted>\n").first().media == 0


def test_number_rows_over_many_stripes(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.8 else f"c{rng.randint(0, 4)}", s) for s in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(data, "chat_id string, seq long")
    got = {(r.chat_id, r.seq): r.pos for r in ordering.number_rows(df, stripe_rows=16).collect()}
    want = {}
    for chat in {c for c, _ in data}:
        for i, s in enumerate(sorted(s for c, s in data if c == chat), 1):
            want[chat, s] = i
    assert got == want


@pytest.mark.parametrize("stripe", [2, 7, 1 << 20])
def test_response_pairs(make_messages, stripe):
    """Hot chat, hot minute, sequence numbers that do not follow time."""
    rng = random.Random(stripe)
    rows = []
    for _ in range(500):
        chat = "hot" if rng.random() < 0.7 else f"c{rng.randint(0, 3)}"
        minute = rng.choice([5, 5, 5, 6, 61, rng.randint(0, 4000)])
        rows.append((chat, minute, rng.choice(["A", "B", "group_notification"]), "x"))
    messages = make_messages(rows)
    want = []
    for chat in {r[0] for r in rows}:
        ordered = sorted((m, i, u) for i, (c, m, u, _) in enumerate(rows) if c == chat)
        for before, now in zip(ordered, ordered[1:]):
            if before[2] != now[2] and before[2] != "group_notification":
                want.append((chat, now[1], now[2], before[2], float(now[0] - before[0])))
    got = [tuple(r) for r in response.response_pairs(messages, stripe_rows=stripe).collect()]
    assert sorted(got) == sorted(want)


def test_common_words_ties_go_to_the_first_seen(make_messages, spark):
    rows = make_messages([("c", 0, "A", "zebra apple the"), ("c", 1, "A", "apple zebra mango"), ("c", 2, "group_notification", "mango mango")])
    stop = spark.createDataFrame([("the",)], "word string")
    got = [(r.word, r.frequency) for r in words.common_words(rows, stop).orderBy("rank").collect()]
    assert got == [("zebra", 2), ("apple", 2), ("mango", 1)]


def test_heatmap_has_every_bucket(make_messages):
    grid = activity.activity_heatmap(make_messages([("c", 0, "A", "x"), ("c", 23 * 60, "A", "x")]))
    row = grid.first()
    assert grid.columns == ["day_name", *PERIODS]
    assert row["00-1"] == 1 and row["23-00"] == 1 and row["5-6"] == 0


def test_shares_sum_to_100(make_messages):
    rng = random.Random(5)
    rows = make_messages([("c", i, f"u{rng.randint(0, 20)}", "x") for i in range(300)])
    assert abs(activity.user_share(rows).agg(F.sum("percent")).first()[0] - 100) < 1e-9
    assert abs(activity.top_user_share(rows).agg(F.sum("percent")).first()[0] - 100) < 1e-9


def vectors(spark, n, d=6, copies=0):
    rng = np.random.default_rng(n)
    matrix = rng.normal(size=(n, d)).astype(np.float32)
    matrix[:copies] = matrix[0]
    rows = [(f"c{i % 3}", i, f"v{i}", [float(x) for x in matrix[i]]) for i in range(n)]
    return matrix, spark.createDataFrame(rows, "chat_id string, seq long, message_id string, embedding array<float>")


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_nearest_with_many_copies(spark, limit):
    """A third of the vectors are copies of one question: ties resolve by chat and sequence number."""
    matrix, index = vectors(spark, 300, copies=100)
    asked = index.where("seq in (0, 150, 299)").select(F.col("seq").alias("question_id"), "embedding")
    found = nearest(asked, index.repartition(5), 9, broadcast_bytes=limit)
    got = {(r.question_id, r["rank"]): r.message_id for r in found.collect()}
    for q in (0, 150, 299):
        d = ((matrix.astype(np.float64) - matrix[q].astype(np.float64)) ** 2).sum(axis=1)
        best = sorted(range(300), key=lambda i: (d[i], f"c{i % 3}", i))[:9]
        assert [got[q, r] for r in range(1, 10)] == [f"v{i}" for i in best]


def test_nearest_caps_k_at_table_size(spark):
    _, index = vectors(spark, 4)
    asked = index.where("seq = 0").select(F.col("seq").alias("question_id"), "embedding")
    assert nearest(asked, index, 50).count() == 4
    assert nearest(asked, index.where("false"), 5).count() == 0
    assert nearest(asked.where("false"), index, 5).count() == 0


def test_context(spark):
    _, index = vectors(spark, 30)
    hits = spark.createDataFrame([("v0",), ("v15",), ("nope",)], "message_id string")
    for measure in (False, True):
        rows = retrieval.context(hits, index, 2, stripe_rows=4, measure=measure).collect()
        assert sorted(r.message_id for r in rows if r.hit_id == "v0") == ["v0", "v3", "v6"]
        assert sorted(r.seq for r in rows if r.hit_id == "v15") == [9, 12, 15, 18, 21]
        assert not [r for r in rows if r.hit_id == "nope"]
    placed = retrieval.positioned(index)
    again = retrieval.context(placed.where("message_id = 'v15'"), placed, 2)
    assert sorted(r.seq for r in again.collect()) == [9, 12, 15, 18, 21]


def test_answers_without_hits(spark):
    questions = spark.createDataFrame([(1, " "), (2, "who")], "question_id long, question string")
    schema = "question_id long, rank int, user string, message string, date timestamp_ntz, similarity double"
    hits = spark.createDataFrame([], schema)
    replies = spark.createDataFrame([(2, "me")], "question_id long, raw string")
    rows = answers.answer_table(questions, hits, replies).orderBy("question_id").collect()
    assert [(r.outcome, r.citations, r.confidence, r.sources_count) for r in rows] == [
        ("blank", [], 0.0, 0),
        ("nothing_found", [], 0.0, 0),
    ]


def test_embed_with_model_of_the_caller(make_messages):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = make_messages([("c", 0, "A", "KYA now"), ("c", 1, "A", "")])
    got = {r.seq: r.embedding for r in retrieval.embed_with(rows, load).collect()}
    assert got == {0: [7.0, 1.0], 1: [0.0, 0.0]}


def test_store(spark, make_messages, tmp_path):
    rows = make_messages([(f"0{c}", c, "A", f"text {c}") for c in range(3)])
    path = str(tmp_path / "messages")
    store.write_messages(rows, path)
    store.write_messages(rows.where("chat_id = '01'").withColumn("message", F.lit("new")), path)
    got = {r.chat_id: r.message for r in store.read_table(spark, path).collect()}
    assert got == {"00": "text 0", "01": "new", "02": "text 2"}


def test_stored_tables_keep_few_files(spark, make_messages, tmp_path):
    """Files are bounded by sizes, not by the chats."""
    rows = make_messages([(f"chat {c}", m, "A", "x") for c in range(1000) for m in range(2)])
    path = tmp_path / "many"
    store.write_messages(rows, str(path))
    assert len(list(path.glob("rows/batch=*"))) == 1
    assert len(list(path.glob("rows/batch=*/*.parquet"))) <= 8
    assert store.read_table(spark, str(path)).count() == 2000
    assert store.read_table(spark, str(path), "chat 7").count() == 2
    assert store.read_table(spark, str(path), "no chat").count() == 0


def sizes(path):
    return {f: f.stat().st_size for f in path.rglob("*.parquet")}


def test_appending_one_chat_writes_only_that_chat(spark, tmp_path):
    schema = "chat_id string, seq long, message_id string, embedding array<float>"
    rows = [(f"chat {c}", i, f"{c}:{i}", [float(c), float(i)] * 32) for c in range(1000) for i in range(20)]
    path = tmp_path / "index"
    store.write_index(spark.createDataFrame(rows, schema), str(path))
    before = sizes(path)
    more = [("chat 7", i, f"7:{i}", [7.0, float(i)] * 32) for i in range(15, 30)]
    store.append_index(spark.createDataFrame(more, schema), str(path))
    after = sizes(path)
    added = {f: n for f, n in after.items() if f not in before}
    assert {f: after.get(f) for f in before} == before
    assert len(added) <= 4 and sum(added.values()) < 0.05 * sum(before.values())
    one = store.read_table(spark, str(path), "chat 7").orderBy("pos").collect()
    assert [(r.seq, r.pos) for r in one] == [(i, i + 1) for i in range(30)]
    assert store.read_index(spark, str(path)).count() == 20_010
    # A row before the stored ones gives the chat new positions; the others' files still stay.
    early = [("chat 8", -1, "8:early", [0.0, 0.0] * 32), ("chat 8", 3, "8:3", [0.0, 0.0] * 32), ("new", 0, "n:0", [0.0, 0.0] * 32)]
    store.append_index(spark.createDataFrame(early, schema), str(path))
    assert {f: sizes(path).get(f) for f in after} == after
    assert [(r.seq, r.pos) for r in store.read_table(spark, str(path), "chat 8").orderBy("pos").collect()] == [(i, i + 2) for i in range(-1, 20)]
    assert [r.pos for r in store.read_table(spark, str(path), "new").collect()] == [1]
    # Appending again goes on after the rewritten chat.
    store.append_index(spark.createDataFrame([("chat 8", 20, "8:20", [0.0, 0.0] * 32)], schema), str(path))
    index = store.read_index(spark, str(path))
    assert index.where("chat_id = 'chat 8'").agg(F.max("pos"), F.count("*")).first() == (22, 22)
    stats = {r.chat_id: (r.total_vectors, r.dimension) for r in store.stored_stats(spark, str(path)).collect()}
    assert (stats["chat 7"], stats["chat 8"], stats["new"], len(stats)) == ((30, 64), (22, 64), (1, 64), 1001)
    rows_before = sorted(map(tuple, index.select("chat_id", "seq", "message_id", "pos").collect()))
    store.compact(spark, str(path))
    store.vacuum(spark, str(path))
    assert len(list(path.glob("rows/batch=*"))) == len(list(path.glob("manifest/batch=*"))) == 1
    assert sorted(map(tuple, store.read_index(spark, str(path)).select("chat_id", "seq", "message_id", "pos").collect())) == rows_before


def test_an_unfinished_batch_is_not_read(spark, make_messages, tmp_path):
    path = tmp_path / "messages"
    rows = make_messages([("a", 0, "A", "one"), ("b", 1, "B", "two")])
    store.write_messages(rows, str(path))
    rows.withColumn("message", F.lit("lost")).write.parquet(str(path / "rows" / "batch=2"))
    assert {r.message for r in store.read_table(spark, str(path)).collect()} == {"one", "two"}
    store.write_messages(rows.where("chat_id = 'a'").withColumn("message", F.lit("new")).withColumn("extra", F.lit(1)), str(path))
    assert {(r.message, r.extra) for r in store.read_table(spark, str(path)).collect()} == {("new", 1), ("two", None)}
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, str(tmp_path / "nothing"))


def test_statistics_read_no_row_of_the_index(spark, tmp_path):
    _, index = vectors(spark, 20)
    store.write_index(index, str(tmp_path / "i"))
    stats = store.stored_stats(spark, str(tmp_path / "i"))
    plan = stats._jdf.queryExecution().toString()
    assert "embedding" not in plan and "/rows" not in plan
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, retrieval.index_stats(index).collect()))


def test_append_creates_and_numbers(spark, tmp_path):
    path = str(tmp_path / "index")
    _, index = vectors(spark, 12)
    store.append_index(index.where("seq % 2 = 0"), path)
    store.append_index(index, path)
    got = {(r.chat_id, r.seq): r.pos for r in store.read_index(spark, path).collect()}
    assert got == {(f"c{i % 3}", i): i // 3 + 1 for i in range(12)}
    for bad in ([1.0] * 5, [float("nan")] * 6):
        with pytest.raises(Exception, match="no valid vector"):
            store.append_index(spark.createDataFrame([("c9", 0, "new", bad)], index.schema), path)


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "index")
    _, index = vectors(spark, 20)
    store.write_index(index.where("seq < 15"), path, 6)
    store.append_index(index, path, 6)
    read = store.read_index(spark, path)
    assert read.count() == 20
    assert retrieval.positioned(read).where("pos is null").count() == 0
    with pytest.raises(Exception, match="no valid vector"):
        store.write_index(index.withColumn("embedding", F.when(F.col("seq") != 3, F.col("embedding"))), path)
    store.clear_index(spark, path)
    assert store.read_index(spark, path).count() == 0


def test_stopwords(spark, tmp_path):
    one = tmp_path / "one.txt"
    one.write_text("The and\nand  über", encoding="utf-8")
    missing = str(tmp_path / "missing.txt")

    def words_of(df):
        return sorted(r.word for r in df.collect())

    assert words_of(stopwords.load_stopwords(spark, [str(one), missing])) == ["and", "the", "über"]
    assert words_of(stopwords.load_stopwords(spark, [str(one)], lower=False)) == ["The", "and", "über"]
    assert words_of(stopwords.load_stopwords(spark, [missing])) == []
    assert len(words_of(stopwords.load_stopwords_or_fallback(spark, missing))) == 9


def test_sentiment_shares(make_messages, spark):
    lexicon = spark.createDataFrame([("good", 1, "joy"), ("bad", -1, "anger")], "token string, polarity int, emotion string")
    rows = make_messages([("c", 0, "A", "Good, good!"), ("c", 1, "B", "bad"), ("c", 2, "A", "plain"), ("c", 3, "A", "good bad")])
    row = sentiment.sentiment(rows, lexicon, "2024-03-01", "2024-03-01").first()
    assert (row.positive, row.neutral, row.negative, row.total_messages) == (0.25, 0.5, 0.25, 4)
    assert row.joy == 0.6 and row.anger == 0.4 and row.primary_emotion == "joy"
    empty = sentiment.sentiment(rows, lexicon, date(1999, 1, 1), date(1999, 1, 2)).first()
    assert (empty.total_messages, empty.insights) == (0, "No messages found.")


def test_percentages_are_rounded_by_the_exact_value(spark):
    draw = np.random.default_rng(3)
    shares = [389 / 2000, 1 / 16, 3 / 16, 0.0, 1.0, 0.0005, 0.00049999, 0.0015, 0.1945, 0.9995, 0.99949999]
    shares += [n / 2000 for n in range(0, 2001, 7)] + [n / d for d in (3, 7, 16, 160, 800, 1600) for n in range(1, d, 5)] + draw.random(2000).tolist()
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", sentiment.percent(F.col("x")).alias("shown")).collect()
    assert all(r.shown == f"{r.x:.1%}" for r in got)


def test_scores_do_not_shuffle_messages(make_messages, spark, monkeypatch):
    lexicon = spark.createDataFrame([("good", 1, "joy"), ("good", 1, "anger"), ("bad", -1, "anger"), ("odd", None, None), (None, 1, "joy")], "token string, polarity int, emotion string")
    rows = make_messages([("c", 0, "A", "Good, good!"), ("d", 1, "B", "bad"), ("c", 2, "A", "plain"), ("c", 3, "A", "good bad odd"), ("d", 4, "B", ""), ("d", 5, "B", None)])
    counted = sentiment.group_counts(rows, lexicon, ["user"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "seq" not in plan.split("Exchange", 1)[1].split("\n")[0]
    want = {tuple(r) for r in counted.collect()}
    scores = {tuple(r) for r in sentiment.message_scores(rows, lexicon).collect()}
    assert {(r[0], r[1], r[2]) for r in scores} == {("c", 0, 4), ("d", 1, -1), ("c", 3, 1)}
    monkeypatch.setattr(sentiment, "LOOKUP_TOKENS", 1)
    assert {tuple(r) for r in sentiment.group_counts(rows, lexicon, ["user"]).collect()} == want
    assert {tuple(r) for r in sentiment.message_scores(rows, lexicon).select("chat_id", "seq", "score", *EMOTIONS).collect()} == scores
    nothing = sentiment.group_counts(rows, lexicon.where("false"), [])
    assert nothing.first().total_messages == 6


def test_questions_with_enough_equal_rows_need_no_search(spark, monkeypatch):
    draw = np.random.default_rng(5).integers(-3, 4, (40, 4)).astype(float)
    rows = [(f"c{i % 3}", i, [float(x) for x in draw[i % 40]]) for i in range(100)]
    rows += [("c", 900 + i, v) for i, v in enumerate([[0.0] * 4, [-0.0] * 4, [0.0, -0.0, 0.0, 0.0], None, [float("nan")] * 4])]
    rows += [("d", 950 + i, [9.0, 9.0, 9.0, 9.0]) for i in range(2)]
    index = spark.createDataFrame(rows, "chat_id string, seq long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in draw[i]]) for i in range(20)] + [(50, [-0.0] * 4), (51, [9.0] * 4)], "question_id long, embedding array<float>")
    from parlance.operators import nearest as module

    # As an embedding's vectors: without null elements by their type.
    asked = asked.withColumn("embedding", F.transform("embedding", lambda x: F.coalesce(x, F.lit(0).cast("float"))))
    met, meeting = [], module.meeting
    monkeypatch.setattr(module, "meeting", lambda rest, *others: met.append(rest.count()) or meeting(rest, *others))
    hits = [{tuple(r) for r in nearest(asked, index, 3, broadcast_bytes=b).collect()} for b in (1 << 20, 200)]
    assert hits[0] == hits[1] and len(hits[0]) == 66
    # 51 has two equal rows only.
    copies = Counter(tuple(x + 0.0 for x in v) for _, _, v in rows if v)
    assert met == [sum(copies[tuple(x + 0.0 for x in r.embedding)] < 3 for r in asked.collect())] and 0 < met[0] < 22


def test_few_questions_without_equal_rows_do_not_move_the_index(spark, monkeypatch):
    from parlance.operators import nearest as module

    rows = [("c", i, [float(i % 30), 0.0], f"t{i}") for i in range(120)]
    index = spark.createDataFrame(rows, "chat_id string, seq long, embedding array<float>, message string")
    index = index.withColumn("embedding", F.transform("embedding", lambda x: F.coalesce(x, F.lit(0).cast("float"))))
    asked = index.where("seq < 30").select(F.col("seq").alias("question_id"), "embedding")
    asked = asked.unionByName(asked.where("question_id < 2").select(F.col("question_id") + 100, F.transform("embedding", lambda x: x + F.lit(0.25).cast("float")).alias("embedding")).toDF("question_id", "embedding"))
    want = {tuple(r) for r in nearest(asked, index, 3).collect()}
    monkeypatch.setattr(module, "SPLIT_BYTES", 100)
    monkeypatch.setattr(module, "meeting", lambda *_: pytest.fail("the index was dealt to cells"))
    read, known = [], module._known_rows
    monkeypatch.setattr(module, "_known_rows", lambda *given: read.append(known(*given)) or read[-1])
    assert {tuple(r) for r in nearest(asked, index, 3, broadcast_bytes=400).collect()} == want and len(want) == 96
    # Over the limit, all rows are joined.
    assert read[0].count() == 120
    keys = index.where("seq in (3, 5)").select("chat_id", "seq")
    assert {r.seq for r in known(index, keys, ["chat_id", "seq"], 16).collect()} == {3, 5}
    assert known(index, keys.where("false"), ["chat_id", "seq"], 16).count() == 0


def test_vectors_are_made_after_rows_were_moved(spark, make_messages, tmp_path):
    rows = retrieval.index_rows(make_messages([(f"c{i % 2}", i, "u", f"word{i % 5} and more") for i in range(40)]))
    given = []

    def embed(moved):
        given.append(moved)
        return retrieval.embed(moved, model)

    model = retrieval.fit_embedding(rows, 8)
    store.write_index(retrieval.embed(rows, model), str(tmp_path / "before"))
    store.write_index(rows, str(tmp_path / "after"), embed=embed)
    before, after = (store.read_index(spark, str(tmp_path / name)) for name in ("before", "after"))
    assert before.schema == after.schema and sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    assert "pos" in given[-1].columns and store.stored_stats(spark, str(tmp_path / "after")).first().dimension == 8
    plan = store.checked_vectors(embed(given[-1]), 8)._jdf.queryExecution().sparkPlan().toString()
    assert "embedding" not in plan.partition("RebalancePartitions")[2]


def test_large_lexicons_meet_blocks_of_messages(make_messages, spark, monkeypatch):
    lexicon = spark.createDataFrame([("good", 1, "joy"), ("good", 1, "anger"), ("bad", -1, "anger"), (" 0", 9, "joy"), (None, 1, "joy")], "token string, polarity int, emotion string")
    rows = make_messages([(f"c{i % 3}", i, f"u{i % 2}", ["good Good! bad", "bad", "", None, "plain words", "bad good bad bad"][i % 6]) for i in range(120)])
    rows = rows.unionByName(rows.where("seq < 30"))  # some come twice
    groups = ([], ["user"], ["chat_id", "user"])
    want = [{tuple(r) for r in sentiment.group_counts(rows, lexicon, by).collect()} for by in groups]
    monkeypatch.setattr(sentiment, "LOOKUP_TOKENS", 1)
    stored, keep = [], sentiment.shared.keep
    monkeypatch.setattr(sentiment.shared, "keep", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    for size in (1_000_000, 5):
        monkeypatch.setattr(sentiment, "BLOCK_TOKENS", size)
        assert [{tuple(r) for r in sentiment.group_counts(rows.coalesce(1), lexicon, by).collect()} for by in groups] == want
    # One row for each word of a block and one for itself, however often the words occur.
    assert stored[0].count() == 5
    assert sentiment.group_counts(rows.where("false"), lexicon, []).first().total_messages == 0


def test_bare_domains_by_their_last_label(spark):
    values = ["see example.icu and foo.sbs/x", "bar.website nice.photography", "A.COM:80 b.co.uk?x=1", "file.doc x.toolong a@b.com", "http://any.thing www.else"]
    assert column(spark, values, text.url_count) == [2, 2, 2, 0, 2]
    # A list of any length costs one look-up.
    registry = [f"label{i}" for i in range(5000)] + ["doc"]
    assert column(spark, values, lambda v: text.url_count(v, registry)) == [0, 0, 0, 1, 2]


def test_topics_need_ten_messages(make_messages, spark):
    lexicon = spark.createDataFrame([("good", 1, "joy")], "token string, polarity int, emotion string")
    few = [("few", i, "A", "good words here") for i in range(9)]
    enough = [("enough", i, "A", f"good words number{i % 3}") for i in range(12)]
    rows = make_messages(few + enough)
    found = topics.topics(rows, lexicon, "2024-03-01", "2024-03-02", 2, iterations=2)
    assert {r.chat_id for r in found.collect()} == {"enough"}
    records = {r.chat_id: r for r in topics.topics_record(found, rows, "2024-03-01", "2024-03-02").collect()}
    assert records["few"].analysis_summary == topics.TOO_FEW
    assert sum(t.message_count for t in records["enough"].topics) == 12


def test_reply_parsing(spark):
    good = '{"overall_sentiment": {"positive": 1.0, "neutral": 0.0, "negative": 0.0}, "insights": "ok"}'
    texts = [good, f"```json\n{good}\n```", f"x {good} y", f"{good} {good}", good[:40], "", "[Error: x", "```json\n{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    parsed = responses.parse_sentiment(df).orderBy("i").collect()
    assert [r.parse_error for r in parsed] == [False, False, False, True, True, True, True, False]
    assert parsed[4].overall_sentiment.positive == 0.6
    assert responses.parse_sentiment(df, fallback=False).orderBy("i").collect()[4].overall_sentiment is None
    fenced = [r.json is not None for r in responses.parse_json(df).orderBy("i").collect()]
    assert fenced == [True, True, False, False, False, False, False, False]


def test_word_count_matches_python(make_messages):
    rows = [("c", 0, "A", "a b  c"), ("c", 1, "B", ""), ("c", 2, "A", "d")]
    got = {r.user: r.words for r in activity.talkativeness(make_messages(rows)).collect()}
    want = Counter()
    for _, _, user, body in rows:
        want[user] += len(body.split())
    assert got == dict(want)


@pytest.mark.parametrize("k", [1, 7, 500])
def test_nearest_by_pivots(spark, monkeypatch, k):
    """Questions in many blocks meet the rows by cells, with the hits of brute force; far rows don't travel."""
    import parlance.operators.nearest as module

    monkeypatch.setattr(module, "SPLIT_BYTES", 2000)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 50
    matrix = (centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 5))).astype(np.float32)
    matrix[:130] = matrix[0]
    rows = [(f"c{i % 3}", i, f"v{i}", [float(x) for x in matrix[i]]) for i in range(400)]
    rows += [("c0", 900, "nan", [float("nan")] * 5), ("c0", 901, "none", None)]
    index = spark.createDataFrame(rows, "chat_id string, seq long, message_id string, embedding array<float>").repartition(4)
    asked = index.where("seq % 5 = 0 or seq = 900").select(F.col("seq").alias("question_id"), "embedding")
    got = {}
    for r in nearest(asked, index, k, broadcast_bytes=500).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.message_id)
    assert set(got) == set(range(0, 400, 5))
    for q, ids in got.items():
        d = ((matrix.astype(np.float64) - matrix[q].astype(np.float64)) ** 2).sum(axis=1)
        assert ids == [f"v{i}" for i in sorted(range(400), key=lambda i: (d[i], f"c{i % 3}", i))[:k]]
    assert nearest(asked, index.where("false"), k, broadcast_bytes=500).count() == 0


def test_pivots_skip_rows_and_keep_questions_off_the_driver(spark, monkeypatch):
    import parlance.operators.nearest as module

    rng = np.random.default_rng(6)
    matrix = (np.arange(600) % 6)[:, None] * 100.0 + rng.normal(size=(600, 4))
    index = spark.createDataFrame([("c", i, [float(x) for x in matrix[i]]) for i in range(600)], "chat_id string, seq long, embedding array<double>")
    asked = index.where("seq % 6 = 2").select(F.col("seq").alias("question_id"), F.col("embedding").alias("_vector"))
    questions, rows = module.meeting(asked, index, 3, False, 1 << 20)
    # All questions lie in one of six clusters: the rows of the others are in nobody's reach.
    assert rows.select("seq").distinct().where("seq % 6 <> 2").count() == 0 and rows.count() <= 100
    assert questions.count() < 100 * module.PIVOTS / 3
    monkeypatch.setattr(module, "_question_blocks", None)
    assert nearest(asked.withColumnRenamed("_vector", "embedding"), index, 3, broadcast_bytes=1000).count() == 300


def test_nearest_by_pivots_within_dates(spark):
    _, index = vectors(spark, 200)
    index = index.withColumn("date", F.expr("timestamp_ntz '2024-01-01 12:00:00' + make_dt_interval(cast(seq % 20 as int))"))
    asked = index.where("seq % 7 = 0").select(F.col("seq").alias("question_id"), "embedding", F.to_date("date").alias("a"), F.date_add(F.to_date("date"), 5).alias("b"))
    few, many = (nearest(asked, index, 4, within=("a", "b"), broadcast_bytes=n).select("question_id", "rank", "seq") for n in (1 << 20, 300))
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() > 100


def test_nearest_leaves_out_bad_vectors(spark):
    """A vector that is no number hides no other one; one of another length is named."""
    matrix, index = vectors(spark, 50)
    bad = [("c0", 900, "nan", [float("nan")] * 6), ("c0", 901, "inf", [float("inf")] + [0.0] * 5), ("c0", 902, "none", None)]
    index = index.unionByName(spark.createDataFrame(bad, index.schema)).coalesce(1)
    asked = index.where("seq in (0, 900)").select(F.col("seq").alias("question_id"), "embedding")
    got = [r.message_id for r in nearest(asked, index, 5).orderBy("rank").collect()]
    d = ((matrix.astype(np.float64) - matrix[0].astype(np.float64)) ** 2).sum(axis=1)
    assert got == [f"v{i}" for i in np.argsort(d)[:5]]
    ragged = index.unionByName(spark.createDataFrame([("c0", 903, "short", [0.0] * 3), ("c0", 904, "long", [0.0] * 9)], index.schema))
    with pytest.raises(Exception, match="seq 903"):
        nearest(asked, ragged.coalesce(1), 5).collect()


def test_nearest_blocks_do_not_shuffle_the_index(spark):
    _, index = vectors(spark, 100)
    asked = index.where("seq < 20").select(F.col("seq").alias("question_id"), "embedding")
    found = nearest(asked, index, 3, broadcast_bytes=600).select("question_id", "chat_id", "seq", "rank")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 2
    assert not [line for line in plan.splitlines() if "Exchange" in line and "embedding" in line]
    assert found.count() == 60


def test_messages_without_words_have_no_topic(spark, make_messages):
    from parlance.operators import topics

    rows = make_messages([("c", i, "u", "ok" if i % 2 else f"alpha beta gamma{i % 3}") for i in range(30)])
    found = topics.assign_topics(rows, topics=2, iterations=2, partitions=2)
    assert found.where("message = 'ok' and topic is not null").count() == 0
    assert found.where("message <> 'ok' and topic is null").count() == 0
    assert topics.assign_topics(rows.where("message = 'ok'"), topics=2).where("topic is null").count() == 15


def test_exports_of_short_chats(spark, make_messages):
    from parlance.operators import topics

    rows = make_messages([("few", 0, "u", "hello")])
    none = spark.createDataFrame([], f"chat_id string, topic int, {topics.TOPIC_FIELDS}")
    inside, outside = (topics.topics_record(none, rows, a, b).first() for a, b in (("2024-01-01", "2024-12-31"), ("2020-01-01", "2020-01-02")))
    assert (inside.topics, inside.total_messages, inside.analysis_summary) == ([], 1, topics.TOO_FEW)
    assert (outside.topics, outside.total_messages) == ([], 0)


def test_links_by_hand(spark):
    """Cases written down from the rule: a scheme, www, or a bare domain under a known top-level domain."""
    from parlance.functions import text

    cases = {
        "see https://a.example/x?y=1 and http://b.org": 2, "www.site.de": 1, "my.club and foo.news/x": 2, "e.g. this": 0,
        "mail me@site.com": 0, "no link.here": 0, "ftp://files.example": 1, "": 0,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").withColumn("got", text.url_count(F.col("t")))
    assert {r.t: r.got for r in rows.collect()} == cases
    own = spark.createDataFrame([("no link.here",)], "t string").select(text.url_count(F.col("t"), "here").alias("n"))
    assert own.first().n == 1


def test_salted_lexicon_join_gives_the_same_hits(spark):
    from parlance.operators.sentiment import token_hits

    tokens = spark.createDataFrame([("c", i, "good" if i % 3 else "odd") for i in range(200)], "chat_id string, seq long, token string")
    lexicon = spark.createDataFrame([("good", 1, "joy"), ("bad", -1, "anger")], "token string, polarity int, emotion string")
    small, large = token_hits(tokens, lexicon), token_hits(tokens, lexicon, limit=0)
    assert small.exceptAll(large.select(small.columns)).count() == 0 and large.count() == small.count() == 133


@pytest.mark.parametrize("user", ["Overall", "b"])
def test_dashboard_tables_equal_the_operators(spark, make_messages, tmp_path, user):
    """Every table of the stored page is that of its own operator, also with notifications, media, links and blank rows."""
    from parlance import schema as S
    from parlance.operators import activity
    from parlance.plans import jobs

    texts = ["hello there", "see https://a.org/x and b.com", S.MEDIA_MARKER, "  ", "one two three", "d"]
    people = ["a", "b", "b", "c", S.NOTIFICATION, "d", "e"]
    rows = make_messages([(f"c{i % 2}", i * 997, people[i * i % 7], texts[i % 6]) for i in range(200)])
    user = S.OVERALL if user == "Overall" else user
    names = ["key_metrics", "basic_stats", "monthly_timeline", "daily_timeline", "weekday_activity", "month_activity", "activity_heatmap"]
    plain = ["overview", "users", "busiest_users", "user_share", "top_user_share", "talkativeness", "top_user_trend"]
    for by in ([], ["chat_id"]):
        page = jobs.stored_dashboard(rows, str(tmp_path / f"page{len(by)}"), user, by)
        for name in names + (plain if user == S.OVERALL else ["user_daily_stats"]):
            made = getattr(activity, name)
            want = made(rows, by=by) if name in plain else made(rows, user, by=by)
            got = page[name].select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (name, by)
        assert page["daily_timeline"].count() > 2
    empty = jobs.stored_dashboard(rows.where("false"), str(tmp_path / "none"), user)
    assert empty["daily_timeline"].count() == 0 and empty["activity_heatmap"].count() == 0


def test_tokens_of_normalized_text_need_no_folding(spark):
    """Every letter in place of each letter of a folded word that it could be taken for, in upper case too."""
    from parlance import schema as S

    letters = sorted({c for c in map(chr, range(0x80, 0x10000)) if c.isalpha() and c.casefold()[0] in "abcdefghijklmnopqrstuvwxyz"} | {"İ", "ı", "K", "ſ"})
    words = [w for w in S.TRANSLITERATED_WORDS for w in (w, w.upper(), w.title(), f"x{w}", f"{w}'s Σ")]
    texts = [w[:i] + c + w[i + 1 :] for w in words for i in range(len(w)) for c in letters] + words + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "message string")
    col = F.col("message")
    assert rows.where(~text.normalized_tokens(col).eqNullSafe(text.sentiment_tokens(text.normalize(col)))).count() == 0
    assert rows.where(~text.normalized_tokens(col).eqNullSafe(text.sentiment_tokens(col))).count() > 0


def test_fitting_and_embedding_read_messages_once(make_messages, spark):
    rows = retrieval.index_rows(make_messages([("a", i, "u", f"one word{i % 3} KYA nahı {'x' * (i % 2)}") for i in range(30)]))
    reads = spark.sparkContext.accumulator(0)

    def counted(message: str) -> str:
        reads.add(1)
        return message

    again = rows.withColumn("message", F.udf(counted)("message"))
    vectors, model = retrieval.fit_and_embed(again, ["chat_id", "seq"])
    got = {r.seq: r.embedding for r in vectors.collect()}
    assert vectors.columns == ["chat_id", "seq", "embedding"] and reads.value == 30
    for other in (model, retrieval.fit_embedding(rows)):
        assert {r.seq: r.embedding for r in retrieval.embed(rows, other).collect()} == got
