"""Nearest neighbours, context, citations and the question-and-answer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck as D
from catalog import views as V
from catalog.registry import query
from parlance.functions import text
from parlance.operators import answers, prompts, retrieval
from parlance.plans import jobs
from parlance.sources import store

_HIT = "question_id, rank, chat_id, seq, message_id"


def _hits(spark, sf, **options):
    return retrieval.retrieve(V.questions(spark, sf), V.index(spark, sf), 5, **options)


@query(
    "nearest_messages",
    """SELECT question_id, place AS rank, chat_id, seq, message_id, "user", message, round(distance, 6) AS distance,
      round(1 / (1 + distance), 6) AS similarity FROM ranked WHERE place <= 10""",
)
def nearest_messages(spark, sf):
    found = retrieval.retrieve_similar(V.questions(spark, sf), V.index(spark, sf), 10)
    return found.drop("date")


@query("nearest_messages_blocked", f"SELECT {_HIT.replace('rank', 'place AS rank')} FROM ranked WHERE place <= 10")
def nearest_messages_blocked(spark, sf):
    # Four blocks of questions, whatever their number.
    asked = V.questions(spark, sf)
    quarter = max(1, (asked.count() + 3) // 4) * (64 * 8 + 64)
    found = retrieval.retrieve_similar(asked, V.index(spark, sf), 10, broadcast_bytes=quarter)
    return found.select("question_id", "rank", "chat_id", "seq", "message_id")


@query("nearest_messages_by_pivots", f"SELECT {_HIT.replace('rank', 'place AS rank')} FROM ranked WHERE place <= 10")
def nearest_messages_by_pivots(spark, sf):
    # Blocks of an eighth of the questions: more than are scanned one by one.
    asked = V.questions(spark, sf)
    eighth = max(1, asked.count() // 8) * (64 * 8 + 64)
    found = retrieval.retrieve_similar(asked, V.index(spark, sf), 10, broadcast_bytes=eighth)
    return found.select("question_id", "rank", "chat_id", "seq", "message_id")


@query("retrieved_messages", f"SELECT {_HIT}, round(similarity, 6) AS similarity FROM hits")
def retrieved_messages(spark, sf):
    return _hits(spark, sf).select("question_id", "rank", "chat_id", "seq", "message_id", "similarity")


@query(
    "retrieved_messages_prefiltered",
    """SELECT question_id, rank, chat_id, seq, message_id FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chat_id, seq) AS rank FROM distances
      WHERE trim(question) <> '' AND date >= start_day AND date < end_day) WHERE rank <= 5""",
)
def retrieved_messages_prefiltered(spark, sf):
    return _hits(spark, sf, prefilter=True).select("question_id", "rank", "chat_id", "seq", "message_id")


@query(
    "retrieved_messages_inclusive",
    """SELECT question_id, rank, message_id FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chat_id, seq) AS rank FROM ranked
      WHERE place <= 10 AND trim(question) <> '' AND date >= start_day AND date < end_day + 1) WHERE rank <= 5""",
)
def retrieved_messages_inclusive(spark, sf):
    return _hits(spark, sf, end_inclusive=True).select("question_id", "rank", "message_id")


@query(
    "indexed_in_range",
    "SELECT chat_id, seq, message_id FROM index_rows WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-24'",
)
def indexed_in_range(spark, sf):
    found = retrieval.retrieve_by_date_range(V.index(spark, sf), "2024-01-05", "2024-01-24")
    return found.select("chat_id", "seq", "message_id")


@query(
    "indexed_of_user",
    "SELECT chat_id, seq, message_id FROM index_rows WHERE \"user\" = 'user_3' ORDER BY chat_id, seq LIMIT 100",
)
def indexed_of_user(spark, sf):
    return retrieval.retrieve_by_user(V.index(spark, sf), "user_3").select("chat_id", "seq", "message_id")


@query("message_positions", "SELECT chat_id, seq, pos FROM placed")
def message_positions(spark, sf):
    return retrieval.positioned(V.index(spark, sf)).select("chat_id", "seq", "pos")


@query(
    "message_context",
    """SELECT h.message_id AS hit_id, n.chat_id, n.seq, n.message_id, n."user", n.pos
    FROM placed h JOIN placed n ON n.chat_id = h.chat_id AND n.pos BETWEEN h.pos - 3 AND h.pos + 3""",
)
def message_context(spark, sf):
    index = V.index(spark, sf)
    found = retrieval.context(index.select("message_id"), index, 3)
    return found.select("hit_id", "chat_id", "seq", "message_id", "user", "pos")


@query("context_union", "SELECT question_id, rank, pos, chat_id, seq, message_id FROM context")
def context_union(spark, sf):
    found = retrieval.context_union(_hits(spark, sf), V.index(spark, sf))
    return found.select("question_id", "rank", "pos", "chat_id", "seq", "message_id")


@query(
    "citations",
    """SELECT question_id, rank AS id, "user", message, strftime(date, '%Y-%m-%dT%H:%M:%S') AS timestamp,
      round_even(similarity, 3) AS score FROM hits""",
)
def citations(spark, sf):
    return retrieval.citations(_hits(spark, sf)).select("question_id", F.inline("citations"))


@query(
    "confidence",
    """SELECT question_id, round(least(avg(similarity) FILTER (rank <= 3) / 2, 1.0), 6) AS confidence_raw,
      count(*) AS sources_count FROM hits GROUP BY question_id""",
)
def confidence(spark, sf):
    return retrieval.confidence(_hits(spark, sf)).drop("confidence")


_LINE = """"user" || ' (' || strftime(date, '%Y-%m-%dT%H:%M:%S') || '): ' || message"""
_BEFORE, _BETWEEN, _AFTER = (
    part.split("}")[-1].replace("'", "''") for part in prompts.QUESTION.split("{")
)


@query(
    "question_prompts",
    f"""SELECT question_id, '{_BEFORE}' || string_agg({_LINE}, chr(10) ORDER BY rank, pos, message_id) || '{_BETWEEN}'
      || any_value(question) || '{_AFTER}' AS prompt, count(*) AS context_messages
    FROM context JOIN questions USING (question_id) GROUP BY question_id""",
)
def question_prompts(spark, sf):
    hits = _hits(spark, sf)
    return prompts.question_prompts(V.questions(spark, sf), retrieval.context_union(hits, V.index(spark, sf)))


_ANSWERS = f"""
    SELECT question_id, outcome, CASE outcome WHEN 'blank' THEN {{blank}} WHEN 'nothing_found' THEN {{nothing}}
      WHEN 'error' THEN {{error}} ELSE raw END AS answer,
      CASE WHEN outcome IN ('blank', 'nothing_found') THEN 0 ELSE n END AS sources_count,
      CASE WHEN outcome IN ('blank', 'nothing_found') THEN 0 ELSE least(n, 10) END AS citations,
      CASE outcome WHEN 'answered' THEN round_even(c, 2) WHEN 'error' THEN 0.5 ELSE 0.0 END AS confidence
    FROM (SELECT question_id, raw, n, c, CASE WHEN trim(question) = '' THEN 'blank' WHEN n IS NULL THEN 'nothing_found'
        WHEN raw IS NULL OR starts_with(raw, '[Error') THEN 'error' ELSE 'answered' END AS outcome
      FROM questions LEFT JOIN replies USING (question_id) LEFT JOIN (
        SELECT question_id, count(*) AS n, least(avg(similarity) FILTER (rank <= 3) / 2, 1.0) AS c FROM hits
        GROUP BY question_id) USING (question_id))""".format(
    **{
        name: "'" + reply.replace("'", "''") + "'"
        for name, reply in (
            ("blank", answers.BLANK_QUESTION), ("nothing", answers.NOTHING_FOUND), ("error", answers.NO_ANSWER)
        )
    }
)


@query("answer_table", _ANSWERS)
def answer_table(spark, sf):
    table = answers.answer_table(V.questions(spark, sf), _hits(spark, sf), V.replies(spark, sf))
    return table.withColumn("citations", F.size("citations"))


@query(
    "index_stats",
    "SELECT chat_id, count(*) AS total_vectors, max(len(embedding)) AS dimension FROM index_rows GROUP BY chat_id",
)
def index_stats(spark, sf):
    return retrieval.index_stats(V.index(spark, sf))


@query(
    "stored_index_stats",
    "SELECT chat_id, count(*) AS total_vectors, 64 AS dimension FROM index_rows GROUP BY chat_id",
)
def stored_index_stats(spark, sf):
    """The same after two batches, from the stored index's manifest."""
    path, rows = V.scratch(spark), V.index(spark, sf)
    store.append_index(rows.where(F.col("seq") % 2 == 0), path)
    store.append_index(rows, path)
    return store.stored_stats(spark, path)


@query(
    "hashed_embeddings",
    f"""SELECT chat_id, seq, 384 AS dimension, CASE WHEN len({D.tokens('message')}) > 0 THEN 1.0 ELSE 0.0 END AS norm
    FROM indexable""",
)
def hashed_embeddings(spark, sf):
    rows = retrieval.index_rows(V.messages(spark, sf))
    vectors, _ = retrieval.fit_and_embed(rows, ["chat_id", "seq"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select("chat_id", "seq", F.size("embedding").alias("dimension"), F.round(norm, 3).alias("norm"))


@query(
    "questions_answered",
    f"""SELECT chat_id || ' ' || seq AS question_id, 1.0 AS best_similarity, 'answer to ' || chat_id || ' ' || seq AS answer,
      contains(message, chr(10)) IS NOT NULL AS has_prompt, 'answered' AS outcome
    FROM indexable WHERE seq % 50 = 0 AND len({D.tokens('message')}) > 0""",
)
def questions_answered(spark, sf):
    """Messages to index, index to hits, hits to prompts, replies to answers; each question repeats a stored message."""
    messages = V.messages(spark, sf)
    path = V.scratch(spark)
    index = jobs.build_index(messages, path)
    name = F.concat_ws(" ", "chat_id", F.col("seq").cast("string"))
    with_words = F.size(text.sentiment_tokens(F.col("message"))) > 0
    nobound = F.lit(None).cast("date")
    questions = (
        retrieval.index_rows(messages)
        .where((F.col("seq") % 50 == 0) & with_words)
        .select(name.alias("question_id"), F.col("message").alias("question"), nobound.alias("start"), nobound.alias("end"))
    )
    hits_path = V.scratch(spark)
    jobs.ask(questions, path, 3).write.parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    prompts_of = jobs.prompt_batch(questions, hits, index)
    replies = prompts_of.where(F.col("prompt") != "").select("question_id", F.concat(F.lit("answer to "), "question_id").alias("raw"))
    best = hits.groupBy("question_id").agg(F.round(F.max("similarity"), 6).alias("best_similarity"))
    table = jobs.answer_batch(questions, hits, replies).join(best, "question_id")
    shown = prompts_of.select("question_id", F.col("prompt").isNotNull().alias("has_prompt"))
    return table.join(shown, "question_id").select("question_id", "best_similarity", "answer", "has_prompt", "outcome")
