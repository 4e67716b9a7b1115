"""Counts, timelines, rankings, words, emojis and response times."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import duck as D
from catalog import views as V
from catalog.registry import query
from parlance.operators import activity, dashboard, response, words
from parlance.schema import PERIODS

_DAY = "strftime(only_date, '%Y-%m-%d') AS only_date"
CHAT = ["chat_id"]
# The oracle drops plain numbers in a second step.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


@query(
    "chat_overview",
    """SELECT chat_id, count(*) AS messages, count(DISTINCT "user") FILTER ("user" <> 'group_notification') AS users
    FROM messages GROUP BY chat_id""",
)
def chat_overview(spark, sf):
    return activity.overview(V.messages(spark, sf), CHAT)


def _stats(counted: str, group: str = "", where: str = "TRUE") -> str:
    columns = f"{group}, " if group else ""
    return f"""SELECT {columns}count(*) FILTER ({counted}) AS messages,
      CAST(coalesce(sum(len({D.words('message')})) FILTER ({counted}), 0) AS BIGINT) AS words,
      count(*) FILTER (message = '<Media omitted>') AS media,
      CAST(coalesce(sum(len({D.urls('message')})), 0) AS BIGINT) AS links
    FROM messages WHERE {where} GROUP BY ALL"""


_COUNTED = f"\"user\" <> 'group_notification' AND {D.strip('message')} <> '' AND NOT is_system_message"


@query("key_metrics", _stats(_COUNTED))
def key_metrics(spark, sf):
    return activity.key_metrics(V.messages(spark, sf))


@query("key_metrics_of_user", _stats(_COUNTED, where="\"user\" = 'user_7'"))
def key_metrics_of_user(spark, sf):
    return activity.key_metrics(V.messages(spark, sf), "user_7")


@query("key_metrics_by_chat", _stats(_COUNTED, "chat_id"))
def key_metrics_by_chat(spark, sf):
    return activity.key_metrics(V.messages(spark, sf), by=CHAT)


@query("basic_stats", _stats("TRUE"))
def basic_stats(spark, sf):
    return activity.basic_stats(V.messages(spark, sf))


@query("basic_stats_by_chat", _stats("TRUE", "chat_id"))
def basic_stats_by_chat(spark, sf):
    return activity.basic_stats(V.messages(spark, sf), by=CHAT)


@query("user_list", 'SELECT DISTINCT "user" FROM people')
def user_list(spark, sf):
    return activity.users(V.messages(spark, sf))


def _monthly(source: str, where: str = "TRUE", group: str = "") -> str:
    columns = f"{group}, " if group else ""
    return f"""SELECT {columns}year, month_num, month, count(*) AS messages, month || '-' || year AS time FROM {source}
    WHERE {where} GROUP BY {columns}year, month_num, month"""


@query("monthly_timeline", _monthly("messages"))
def monthly_timeline(spark, sf):
    return activity.monthly_timeline(V.messages(spark, sf))


@query("monthly_timeline_of_user", _monthly("messages", "\"user\" = 'user_7'"))
def monthly_timeline_of_user(spark, sf):
    return activity.monthly_timeline(V.messages(spark, sf), "user_7")


_ORDERS = """(SELECT o_orderpriority AS chat_id, year(o_orderdate) AS year, month(o_orderdate) AS month_num,
    monthname(o_orderdate) AS month FROM orders)"""


@query("monthly_timeline_orders", _monthly(_ORDERS, group="chat_id"))
def monthly_timeline_orders(spark, sf):
    return activity.monthly_timeline(V.order_messages(spark, sf), by=CHAT)


@query("daily_timeline", f"SELECT {_DAY}, count(*) AS messages FROM messages GROUP BY ALL")
def daily_timeline(spark, sf):
    return activity.daily_timeline(V.messages(spark, sf))


@query("daily_timeline_by_chat", f"SELECT chat_id, {_DAY}, count(*) AS messages FROM messages GROUP BY ALL")
def daily_timeline_by_chat(spark, sf):
    return activity.daily_timeline(V.messages(spark, sf), by=CHAT)


@query(
    "daily_counts_between",
    f"""SELECT {_DAY}, count(*) AS messages FROM messages
    WHERE only_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24' GROUP BY ALL""",
)
def daily_counts_between(spark, sf):
    return activity.daily_counts_between(V.messages(spark, sf), "2024-01-05", "2024-01-24")


@query("weekday_activity", "SELECT day_name, count(*) AS messages FROM messages GROUP BY ALL")
def weekday_activity(spark, sf):
    return activity.weekday_activity(V.messages(spark, sf))


@query("month_activity", "SELECT month, count(*) AS messages FROM messages GROUP BY ALL")
def month_activity(spark, sf):
    return activity.month_activity(V.messages(spark, sf))


@query("activity_cells", "SELECT chat_id, day_name, period, count(*) AS messages FROM messages GROUP BY ALL")
def activity_cells(spark, sf):
    return activity.activity_cells(V.messages(spark, sf), by=CHAT)


_GRID = ", ".join(f"count(*) FILTER (period = '{p}') AS \"{p}\"" for p in PERIODS)


@query("activity_heatmap", f"SELECT day_name, {_GRID} FROM messages GROUP BY day_name")
def activity_heatmap(spark, sf):
    return activity.activity_heatmap(V.messages(spark, sf))


_TOP = """SELECT *, row_number() OVER ({part}ORDER BY messages DESC, "user") AS rank
    FROM (SELECT {cols}"user", count(*) AS messages FROM {source} GROUP BY ALL)"""


def _top(n: int, source: str, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    inner = _TOP.format(part=part, cols=f"{group}, " if group else "", source=source)
    return f"SELECT * FROM ({inner}) WHERE rank <= {n}"


@query("busiest_users", _top(5, "messages"))
def busiest_users(spark, sf):
    return activity.busiest_users(V.messages(spark, sf))


@query("busiest_users_by_chat", _top(5, "messages", "chat_id"))
def busiest_users_by_chat(spark, sf):
    return activity.busiest_users(V.messages(spark, sf), by=CHAT)


@query(
    "user_share",
    """SELECT "user" AS name, count(*) AS messages, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent,
      round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100, 2) AS percent_shown
    FROM messages GROUP BY "user" """,
)
def user_share(spark, sf):
    return activity.user_share(V.messages(spark, sf))


@query(
    "user_share_by_chat",
    """SELECT chat_id, "user" AS name, count(*) AS messages,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY chat_id), 6) AS percent,
      round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY chat_id) * 100, 2) AS percent_shown
    FROM messages GROUP BY chat_id, "user" """,
)
def user_share_by_chat(spark, sf):
    return activity.user_share(V.messages(spark, sf), CHAT)


@query(
    "top_user_share",
    f"""SELECT "user", messages, round(messages * 100.0 / sum(messages) OVER (), 6) AS percent,
      round_even(CAST(messages AS DOUBLE) / sum(messages) OVER () * 100, 2) AS percent_shown
    FROM ({_top(10, 'people')})""",
)
def top_user_share(spark, sf):
    return activity.top_user_share(V.messages(spark, sf))


@query(
    "user_daily_stats",
    """SELECT CAST(sum(n) AS BIGINT) AS total_messages, round(avg(n), 6) AS daily_average, max(n) AS peak_day, min(n) AS quiet_day
    FROM (SELECT only_date, count(*) AS n FROM messages WHERE "user" = 'user_7' GROUP BY only_date)""",
)
def user_daily_stats(spark, sf):
    return activity.user_daily_stats(V.messages(spark, sf), "user_7")


@query(
    "talkativeness",
    f"""SELECT "user", count(*) AS messages,
      round(count(*) / greatest(1, date_diff('day', min(only_date), max(only_date)) + 1), 6) AS avg_daily,
      CAST(sum(len({D.words('message')})) AS BIGINT) AS words FROM people GROUP BY "user" """,
)
def talkativeness(spark, sf):
    return activity.talkativeness(V.messages(spark, sf))


@query(
    "top_user_trend",
    f"""SELECT "user", {_DAY}, count(*) AS messages FROM people
    WHERE "user" IN (SELECT "user" FROM ({_top(3, 'people')})) GROUP BY ALL""",
)
def top_user_trend(spark, sf):
    return activity.top_user_trend(V.messages(spark, sf))


# Words and emojis


def _common(source: str, cleaned: bool, where: str = "TRUE", group: str = "", n: int = 20) -> str:
    message = D.clean("lower(message)") if cleaned else "lower(message)"
    kept = "length(word) > 2 AND word NOT IN (SELECT word FROM stopwords)"
    if cleaned:
        kept += " AND NOT starts_with(word, 'http') AND NOT starts_with(word, '<')"
    cols = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT * FROM (
      SELECT {cols}word, frequency, row_number() OVER ({part}ORDER BY frequency DESC, first_seen, word) AS rank FROM (
        SELECT {cols}word, count(*) AS frequency, min((seq, place)) AS first_seen FROM (
          SELECT {cols}seq, unnest(tokens) AS word, unnest(range(len(tokens))) AS place
          FROM (SELECT {cols}seq, {D.words(message)} AS tokens FROM {source} WHERE {where}))
        WHERE {kept} GROUP BY ALL)) WHERE rank <= {n}"""


@query("common_words", _common("people", True))
def common_words(spark, sf):
    return words.common_words(V.messages(spark, sf), V.stopwords(spark, sf))


@query("common_words_by_chat", _common("people", True, group="chat_id"))
def common_words_by_chat(spark, sf):
    return words.common_words(V.messages(spark, sf), V.stopwords(spark, sf), by=CHAT)


@query("common_words_plain", _common("people", False, "message <> '<Media omitted>'"))
def common_words_plain(spark, sf):
    return words.common_words(V.messages(spark, sf), V.stopwords(spark, sf), clean=False, drop_media=True)


@query("common_words_media_kept", _common("people", False, "message <> '<Media omitted>' || chr(10)"))
def common_words_media_kept(spark, sf):
    return words.common_words(
        V.messages(spark, sf), V.stopwords(spark, sf), clean=False, drop_media=True, media_marker="<Media omitted>\n"
    )


@query("common_words_documents", _common("documents_as_messages", True, n=50))
def common_words_documents(spark, sf):
    return words.common_words(V.document_messages(spark, sf), V.stopwords(spark, sf), n=50)


_CLOUD = f"""SELECT term, count(*) AS frequency FROM (
      SELECT regexp_replace(unnest(regexp_extract_all(lower({D.clean('message')}), {D.q(TERM)})), '''s\\z', '') AS term
      FROM people WHERE message <> '<Media omitted>')
    WHERE NOT regexp_full_match(term, '\\p{{Nd}}*') AND term NOT IN (SELECT word FROM stopwords) GROUP BY term"""


@query("term_weights", f"SELECT *, round(frequency / max(frequency) OVER (), 6) AS weight FROM ({_CLOUD})")
def term_weights(spark, sf):
    return words.term_weights(V.messages(spark, sf), V.stopwords(spark, sf))


_EMOJIS = f"""SELECT emoji, count(*) AS frequency, min((seq, place)) AS first_seen FROM (
      SELECT seq, unnest(found) AS emoji, unnest(range(len(found))) AS place
      FROM (SELECT seq, {D.emojis('message')} AS found FROM messages)) GROUP BY emoji"""


@query("emoji_counts", f"SELECT emoji, frequency FROM ({_EMOJIS})")
def emoji_counts(spark, sf):
    return words.emoji_counts(V.messages(spark, sf))


@query(
    "top_emojis",
    f"""SELECT emoji, frequency, rank, round(frequency / sum(frequency) OVER (), 6) AS share FROM (
      SELECT *, row_number() OVER (ORDER BY frequency DESC, first_seen) AS rank FROM ({_EMOJIS})) WHERE rank <= 10""",
)
def top_emojis(spark, sf):
    return words.top_emojis(V.messages(spark, sf))


# Response times

_PAIRS = """SELECT chat_id, seq, "user", previous_user, date_diff('second', previous_date, date) / 60 AS minutes FROM (
      SELECT *, lag("user") OVER w AS previous_user, lag(date) OVER w AS previous_date FROM messages
      WINDOW w AS (PARTITION BY chat_id ORDER BY date, seq))
    WHERE previous_user <> "user" AND previous_user <> 'group_notification'"""


@query("response_pairs", f"SELECT * REPLACE (round(minutes, 6) AS minutes) FROM ({_PAIRS})")
def response_pairs(spark, sf):
    return response.response_pairs(V.messages(spark, sf))


_STATS = """SELECT {cols}"user", round(avg(minutes), 6) AS mean_minutes, round(median(minutes), 6) AS median_minutes,
      count(*) AS responses FROM ({pairs}) GROUP BY {cols}"user" """


@query("response_stats", _STATS.format(cols="", pairs=_PAIRS))
def response_stats(spark, sf):
    return response.response_stats(V.messages(spark, sf))


@query("response_stats_by_chat", _STATS.format(cols="chat_id, ", pairs=_PAIRS))
def response_stats_by_chat(spark, sf):
    return response.response_stats(V.messages(spark, sf), CHAT)


_PART = """CASE WHEN grouping("user") = 0 AND grouping(only_date) = 0 THEN 'user_days' WHEN grouping("user") = 0 THEN 'users'
      WHEN grouping(only_date) = 0 THEN 'days' WHEN grouping(year) = 0 THEN 'months' WHEN grouping(period) = 0 THEN 'cells'
      WHEN grouping(day_name) = 0 THEN 'weekdays' WHEN grouping(month) = 0 THEN 'month_names' ELSE 'all' END AS part"""


@query(
    "dashboard_totals",
    f"""SELECT chat_id, {_PART}, "user", {_DAY}, year, month_num, month, day_name, period, count(*) AS messages,
      CAST(coalesce(sum(len({D.words('message')})), 0) AS BIGINT) AS words, count(*) FILTER ({_COUNTED}) AS counted_messages,
      CAST(coalesce(sum(len({D.words('message')})) FILTER ({_COUNTED}), 0) AS BIGINT) AS counted_words,
      count(*) FILTER (message = '<Media omitted>') AS media, CAST(coalesce(sum(len({D.urls('message')})), 0) AS BIGINT) AS links,
      strftime(min(sent_on), '%Y-%m-%d') AS first_day, strftime(max(sent_on), '%Y-%m-%d') AS last_day
    FROM (SELECT *, only_date AS sent_on FROM messages) GROUP BY GROUPING SETS ((chat_id), (chat_id, "user"), (chat_id, only_date),
      (chat_id, year, month_num, month), (chat_id, day_name), (chat_id, month), (chat_id, day_name, period), (chat_id, "user", only_date))""",
)
def dashboard_totals(spark, sf):
    found = dashboard.totals(V.messages(spark, sf), by=CHAT)
    return found.withColumns({day: F.date_format(day, "yyyy-MM-dd") for day in ("only_date", "first_day", "last_day")})


@query(
    "dashboard_user_share",
    """SELECT chat_id, "user" AS name, count(*) AS messages,
      round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY chat_id), 6) AS percent,
      round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY chat_id) * 100, 2) AS percent_shown
    FROM messages GROUP BY chat_id, "user" """,
)
def dashboard_user_share(spark, sf):
    return dashboard.tables(dashboard.totals(V.messages(spark, sf), by=CHAT), by=CHAT)["user_share"]
