"""Sources, derived columns and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import duck as D
from catalog import views as V
from catalog.registry import query
from parlance.functions import calendar, text
from parlance.operators import enrich, filters, retrieval
from parlance.schema import FALLBACK_STOPWORDS
from parlance.sources import store, stopwords, transcripts

KEY = ["chat_id", "seq"]


# Sources and sinks

_PART = "chat_id || '/' || (seq // 1000)"
_Q3 = D.strip(f"regexp_replace(message, {D.re2(D.P.LATER_SENDER)}, ' \\1 ', 'g')")


@query(
    "transcript_records",
    f"""SELECT {_PART} AS chat_id, row_number() OVER (PARTITION BY {_PART} ORDER BY date, seq) - 1 AS seq,
      strftime(date, '%Y-%m-%d %H:%M:%S') AS date, "user", {_Q3} AS message FROM chat""",
)
def transcript_records(spark, sf):
    return transcripts.split_records(V.transcript_parts(spark, sf)).drop("header")


_SPLITS = {"lines": "128MB", "lines, small splits": "20000"}


@query(
    "transcript_files",
    f"""SELECT reader, replace({_PART}, '/', '_') AS chat_id, row_number() OVER (PARTITION BY reader, {_PART} ORDER BY date, seq) - 1 AS seq,
      strftime(date, '%Y-%m-%d %H:%M:%S') AS date, "user", {_Q3} AS message
    FROM chat CROSS JOIN (VALUES ('whole'), {', '.join(f"({D.q(name)})" for name in _SPLITS)}) AS r(reader)""",
)
def transcript_files(spark, sf):
    """The chats as files, read whole and by lines with two split sizes: the same rows and numbers each time."""
    folder = V.transcript_folder(spark, sf)
    columns = ["chat_id", "seq", "date", "user", "message"]
    found = transcripts.accepted(transcripts.read_transcripts(spark, folder)).select(F.lit("whole").alias("reader"), *columns)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    for name, size in _SPLITS.items():
        path = V.scratch(spark)
        spark.conf.set(key, size)
        try:
            by_lines = transcripts.accepted(transcripts.read_transcripts(spark, folder, whole_file_bytes=1000, piece_records=100))
            by_lines.select(F.lit(name).alias("reader"), *columns).write.parquet(path)
        finally:
            spark.conf.set(key, before)
        found = found.unionByName(spark.read.parquet(path))
    return found


@query(
    "transcript_messages",
    f"""SELECT count(*) AS messages, count(DISTINCT "user") AS users, CAST(sum(length({_Q3})) AS BIGINT) AS characters,
      strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last, {_PART} AS chat_id
    FROM chat GROUP BY ALL""",
)
def transcript_messages(spark, sf):
    parsed = transcripts.accepted(transcripts.split_records(V.transcript_parts(spark, sf)))
    return parsed.groupBy("chat_id").agg(
        F.count("*").alias("messages"),
        F.count_distinct("user").alias("users"),
        F.sum("message_length").alias("characters"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )


@query(
    "transcript_rejects",
    f"""SELECT chat_id, seq, "user", {_Q3} AS message,
      '31/2/2024, ' || (event_hour % 12 + 1) || ':07 pm - ' AS header
    FROM (SELECT *, hour(date) AS event_hour FROM chat) WHERE "user" <> 'group_notification' AND {_Q3} <> ''""",
)
def transcript_rejects(spark, sf):
    """Every message under a day that there isn't, as a text of its own."""
    own = V.chat(spark, sf).where(F.col("user") != "group_notification")
    header = F.concat(F.lit("31/2/2024, "), (F.hour("date") % 12 + 1).cast("string"), F.lit(":07 pm - "))
    texts = own.select(
        F.concat_ws(" ", "chat_id", F.col("seq").cast("string")).alias("chat_id"),
        F.concat(header, "user", F.lit(": "), "message").alias("value"),
    )
    rejected = transcripts.rejected(transcripts.split_records(texts)).where("message <> ''")
    parts = F.split("chat_id", " ")
    return rejected.select(parts[0].alias("chat_id"), parts[1].cast("long").alias("seq"), "user", "message", "header")


@query(
    "chat_names",
    r"""SELECT doc_id,
      regexp_replace(replace(replace(source || ' ' || lang || '-' || text || '.txt', '.txt', ''), ' ', '_'),
        '[^\p{L}\p{N}_-]', '', 'g') AS chat_id,
      coalesce(nullif(trim(regexp_replace(replace('_' || text, ' ', '_'), '[^\p{L}\p{N}_-]', '', 'g'), '_-'), ''),
        'chat') AS folder
    FROM documents""",
)
def chat_names(spark, sf):
    documents = V.table(spark, sf, "documents")
    name = F.concat("source", F.lit(" "), "lang", F.lit("-"), "text", F.lit(".txt"))
    folder = F.concat(F.lit("_"), "text", F.lit(".txt"))
    return documents.select(
        "doc_id", text.chat_name(name).alias("chat_id"), text.chat_name(folder, trim_edges=True).alias("folder")
    )


@query("message_ids", "SELECT chat_id, seq, sha256(chat_id || ':' || seq) AS message_id FROM chat")
def message_ids(spark, sf):
    return V.chat(spark, sf).select(*KEY, enrich.message_id(F.col("chat_id"), F.col("seq")).alias("message_id"))


_STORED = """SELECT chat_id, seq, message_id, "user", message, strftime(only_date, '%Y-%m-%d') AS only_date, period, language
    FROM messages"""


@query("stored_messages", _STORED)
def stored_messages(spark, sf):
    path = V.scratch(spark)
    store.write_messages(V.messages(spark, sf), path)
    columns = ["chat_id", "seq", "message_id", "user", "message", "only_date", "period", "language"]
    return store.read_table(spark, path).select(*columns)


@query(
    "stored_index",
    """SELECT chat_id, seq, message_id, "user", message, pos, len(embedding) AS dimension FROM placed""",
)
def stored_index(spark, sf):
    path = V.scratch(spark)
    rows = V.index(spark, sf)
    # Writing the same chats twice leaves one copy.
    for _ in range(2):
        store.write_index(rows, path)
    read = store.read_index(spark, path)
    return read.select("chat_id", "seq", "message_id", "user", "message", "pos", F.size("embedding").alias("dimension"))


@query("appended_index", "SELECT chat_id, seq, message_id, pos FROM placed")
def appended_index(spark, sf):
    path = V.scratch(spark)
    rows = V.index(spark, sf)
    # The first call finds nothing and creates the index.
    store.append_index(rows.where(F.col("user") != "user_3"), path)
    store.append_index(rows, path)
    return store.read_index(spark, path).select("chat_id", "seq", "message_id", "pos")


@query(
    "stopword_table",
    f"SELECT DISTINCT word FROM (SELECT unnest({D.words('lower(text)')}) AS word FROM conversations)",
)
def stopword_table(spark, sf):
    return V.stopword_lines(spark, sf)


@query(
    "stopword_table_cased",
    f"SELECT DISTINCT word FROM (SELECT unnest({D.words('text')}) AS word FROM conversations)",
)
def stopword_table_cased(spark, sf):
    lines = V.table(spark, sf, "conversations").select(F.col("text").alias("value"))
    return stopwords.stopwords_from_text(lines, lower=False)


@query(
    "stopword_files",
    f"""SELECT DISTINCT 'union' AS list, word FROM (SELECT unnest({D.words('lower(text)')}) AS word FROM conversations)
    UNION ALL SELECT DISTINCT 'single', word FROM (SELECT unnest({D.words('lower(text)')}) AS word FROM conversations WHERE conv_id % 2 = 0)
    UNION ALL SELECT 'fallback', unnest([{D.sql_list(FALLBACK_STOPWORDS)}])""",
)
def stopword_files(spark, sf):
    """Two lists and a missing one; one list alone; the fallback for a missing one."""
    paths = [V.scratch(spark) for _ in range(3)]
    turns = V.table(spark, sf, "conversations")
    for rest, path in enumerate(paths[:2]):
        turns.where(F.col("conv_id") % 2 == rest).select("text").write.text(path)
    found = {
        "union": stopwords.load_stopwords(spark, [paths[0], paths[2], paths[1]]),
        "single": stopwords.load_stopwords_or_fallback(spark, paths[0]),
        "fallback": stopwords.load_stopwords_or_fallback(spark, paths[2]),
    }
    return reduce(DataFrame.unionByName, [words.select(F.lit(name).alias("list"), "word") for name, words in found.items()])


# Derived columns


@query("system_flags", "SELECT chat_id, seq, is_system_message FROM messages")
def system_flags(spark, sf):
    return V.messages(spark, sf).select(*KEY, "is_system_message")


@query(
    "calendar_columns",
    """SELECT chat_id, seq, strftime(only_date, '%Y-%m-%d') AS only_date, year, month_num, month, day, day_name, hour, minute
    FROM messages""",
)
def calendar_columns(spark, sf):
    names = ["only_date", "year", "month_num", "month", "day", "day_name", "hour", "minute"]
    return V.messages(spark, sf).select(*KEY, *names)


@query("hour_buckets", "SELECT chat_id, seq, period FROM messages")
def hour_buckets(spark, sf):
    return V.messages(spark, sf).select(*KEY, "period")


@query("languages", "SELECT chat_id, seq, language FROM messages")
def languages(spark, sf):
    return V.messages(spark, sf).select(*KEY, "language")


@query("message_lengths", "SELECT chat_id, seq, message_length FROM messages")
def message_lengths(spark, sf):
    return V.messages(spark, sf).select(*KEY, "message_length")


def _normalized(x: str) -> str:
    for word in D.S.TRANSLITERATED_WORDS:
        pattern = D.q(rf"(^|[^\p{{L}}\p{{N}}_])(?i:{word})($|[^\p{{L}}\p{{N}}_])")
        for _ in range(2):
            x = f"regexp_replace({x}, {pattern}, '\\1{word}\\2', 'g')"
    return x


@query("normalized_text", f"SELECT chat_id, seq, {_normalized('message')} AS normalized FROM chat")
def normalized_text(spark, sf):
    return V.chat(spark, sf).select(*KEY, text.normalize(F.col("message")).alias("normalized"))


@query(
    "cleaned_text",
    f"""SELECT chat_id, seq, {D.clean('message')} AS cleaned,
      regexp_replace({D.clean('message')}, {D.re2(D.P.WS + '+')}, ' ', 'g') AS collapsed FROM chat""",
)
def cleaned_text(spark, sf):
    message = F.col("message")
    return V.chat(spark, sf).select(
        *KEY, text.clean(message).alias("cleaned"), text.clean(message, collapse=True).alias("collapsed")
    )


@query("month_labels", "SELECT DISTINCT year, month, month || '-' || year AS label FROM messages")
def month_labels(spark, sf):
    label = calendar.month_label(F.col("month"), F.col("year"))
    return V.messages(spark, sf).select("year", "month", label.alias("label")).distinct()


@query(
    "word_tokens",
    f"""SELECT chat_id, seq, len({D.words('message')}) AS words, array_to_string({D.words('message')}, '|') AS tokens
    FROM documents_as_messages""",
)
def word_tokens(spark, sf):
    tokens = text.words(F.col("message"))
    return V.document_messages(spark, sf).select(
        *KEY, F.size(tokens).alias("words"), F.array_join(tokens, "|").alias("tokens")
    )


@query(
    "url_counts",
    f"""SELECT seq, len({D.urls('message')}) AS links, array_to_string({D.urls('message')}, ' ') AS urls
    FROM (SELECT page_id AS seq, html AS message FROM pages UNION ALL SELECT seq, message FROM chat)""",
)
def url_counts(spark, sf):
    both = V.page_messages(spark, sf).select("seq", "message").unionByName(V.chat(spark, sf).select("seq", "message"))
    message = F.col("message")
    return both.select("seq", text.url_count(message).alias("links"), F.array_join(text.urls(message), " ").alias("urls"))


@query("emoji_lists", f"SELECT chat_id, seq, array_to_string({D.emojis('message')}, '') AS emojis FROM chat")
def emoji_lists(spark, sf):
    return V.chat(spark, sf).select(*KEY, F.array_join(text.emojis(F.col("message")), "").alias("emojis"))


@query(
    "index_metadata",
    """SELECT chat_id, seq, message_id, "user", strftime(date, '%Y-%m-%dT%H:%M:%S') AS date,
      strftime(only_date, '%Y-%m-%d') AS only_date, language, message, message_length, hour, day_name FROM indexable""",
)
def index_metadata(spark, sf):
    return retrieval.index_metadata(retrieval.index_rows(V.messages(spark, sf)))


# Filters: each returns the keys it keeps


def _keys(name: str, condition: str, keep) -> None:
    @query(name, f"SELECT chat_id, seq FROM messages WHERE {condition}")
    def run(spark, sf):
        return keep(V.messages(spark, sf)).select(*KEY)


_keys("messages_of_user", "\"user\" = 'user_7'", filters.for_user("user_7"))
_keys("messages_of_everyone", "TRUE", filters.for_user())
_keys("without_notifications", "\"user\" <> 'group_notification'", filters.without_notifications)
_keys("media_messages", "message = '<Media omitted>'", lambda df: df.where(filters.is_media()))
_keys("media_messages_newline", "message = '<Media omitted>' || chr(10)", lambda df: df.where(filters.is_media("<Media omitted>\n")))
_keys("without_media", "message <> '<Media omitted>'", filters.without_media())
_keys("without_blank", f"{D.strip('message')} <> ''", filters.without_blank())
_keys("without_system", "NOT is_system_message", filters.without_system)
_keys(
    "between_dates",
    "only_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'",
    filters.between_dates("2024-01-05", "2024-01-24"),
)
for _name, _days in D.S.PRESET_DAYS.items():
    _keys(
        _name.lower().replace(" ", "_"),
        f"only_date BETWEEN DATE '2024-01-20' - {_days} AND DATE '2024-01-20'",
        filters.preset(_name, "2024-01-20"),
    )


@query(
    "all_time_range",
    "SELECT strftime(min(only_date), '%Y-%m-%d') AS first, strftime(max(only_date), '%Y-%m-%d') AS last FROM messages",
)
def all_time_range(spark, sf):
    messages = V.messages(spark, sf)
    first, last = filters.preset_ranges("2024-01-20", messages)["All Time"]
    return messages.groupBy().agg(F.count("*").alias("n")).select(first.alias("first"), last.alias("last"))


_keys(
    "retrieval_range",
    "date >= DATE '2024-01-05' AND date < DATE '2024-01-24'",
    lambda df: retrieval.retrieve_by_date_range(df, "2024-01-05", "2024-01-24"),
)
_keys(
    "retrieval_range_inclusive",
    "date >= DATE '2024-01-05' AND date < DATE '2024-01-25'",
    lambda df: retrieval.retrieve_by_date_range(df, "2024-01-05", "2024-01-24", end_inclusive=True),
)
_keys(
    "indexable_messages",
    f"\"user\" <> 'group_notification' AND message <> '<Media omitted>' AND {D.strip('message')} <> ''",
    filters.indexable,
)
