"""The same inputs as SQL for the oracle engine: common table expressions put in front of every oracle query."""

from __future__ import annotations

from parlance import schema as S
from parlance.functions import patterns as P


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WHITE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def re2(pattern: str) -> str:
    """The pattern as this engine's regular expressions say it: no Unicode switch, no look-ahead, no anchor to the last match."""
    for java, plain in (
        (r"(?U:[\s\x{1C}-\x{1F}])", f"[{_WHITE}]"),
        (r"(?U:[^\s\x{1C}-\x{1F}])", f"[^{_WHITE}]"),
        (r"""(?U:[^\s\x{1C}-\x{1F}<>"])""", f'[^{_WHITE}<>"]'),
        (r"(?=[\x{A9}\x{AE}\x{203C}-\x{1FAFF}])", ""),
        (r"\G", ""),
        (r"(?<![\p{L}\p{N}@_-])", ""),
        ("++", "+"),
    ):
        pattern = pattern.replace(java, plain)
    return q(pattern)


def strip(x: str) -> str:
    return f"trim({x}, {q(P.WHITE_CHARS)})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {re2(P.WS + '+')}), lambda w: w <> '')"


def tokens(x: str) -> str:
    letters = q(r"[^\p{L}\p{N}']+")
    reduced = f"list_transform({words(f'lower({x})')}, lambda t: regexp_replace(t, {letters}, '', 'g'))"
    return f"list_filter({reduced}, lambda t: t <> '')"


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {re2(P.MEDIA)}, '', 'g'), {re2(P.LINKS)}, '', 'g')"


def urls(x: str) -> str:
    found = f"regexp_extract_all({x}, {re2(P.URL_CANDIDATE)})"
    return (
        f"list_filter({found}, lambda u: regexp_matches(u, {re2(P.URL_SCHEME)}) OR "
        f"list_contains([{', '.join(q(d) for d in P.TOP_LEVEL_DOMAINS)}], lower(regexp_extract(u, {re2(P.URL_LABEL)}, 1))))"
    )


def emojis(x: str) -> str:
    return f"regexp_extract_all({x}, {re2(P.EMOJI)})"


def sql_list(values) -> str:
    return ", ".join(q(v) for v in values)


_PHRASES = " OR ".join(
    f"contains(lower({side}), {q(phrase)})" for phrase in S.SYSTEM_PHRASES for side in ("message", '"user"')
)

VIEWS = {
    "chat": """
    SELECT event_type AS chat_id, event_id AS seq, 'm' || event_id AS message_id, date_trunc('minute', ts) AS date,
      CASE WHEN event_id % 41 = 0 THEN 'group_notification' ELSE 'user_' || user_id END AS "user",
      CASE WHEN event_id % 41 = 0 THEN 'Someone created group' WHEN event_id % 23 = 0 THEN '<Media omitted>'
        WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN 'see http://example.com/' || event_id || ' now'
        WHEN event_id % 37 = 0 THEN text || ' 😀' || substring('😀🎉😂👍🙏🔥😊😍😢🚀🌟🍕🎂🐱', CAST(event_id // 37 % 14 + 1 AS INTEGER), 1)
        WHEN event_id % 86 = 0 THEN 'আমি ভালো' WHEN event_id % 43 = 0 THEN 'আমি ভালো ok' WHEN event_id % 94 = 0 THEN 'नमस्ते ji'
        WHEN event_id % 47 = 0 THEN 'नमस्ते' WHEN event_id % 53 = 0 THEN 'I LEFT, Kya yaar'
        WHEN event_id % 59 = 0 THEN 'note: one: two' ELSE text END AS message
    FROM events CROSS JOIN (SELECT max(conv_id) + 1 AS n FROM conversations)
    JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) t ON t.conv_id = event_id % n
    JOIN conversations c ON c.conv_id = event_id % n AND c.turn = (event_id // n) % turns""",
    "messages": f"""
    SELECT *, (lower("user") IN ({sql_list(S.SYSTEM_USERS)}) OR {_PHRASES}) AS is_system_message,
      CAST(date AS DATE) AS only_date, year(date) AS year, month(date) AS month_num, monthname(date) AS month,
      day(date) AS day, dayname(date) AS day_name, hour(date) AS hour, minute(date) AS minute,
      CASE WHEN hour(date) = 23 THEN '23-00' WHEN hour(date) = 0 THEN '00-1'
        ELSE hour(date) || '-' || (hour(date) + 1) END AS period,
      CASE WHEN regexp_matches(message, {re2(P.BENGALI)})
          THEN CASE WHEN regexp_matches(message, {re2(P.LATIN)}) THEN 'benglish' ELSE 'bengali' END
        WHEN regexp_matches(message, {re2(P.DEVANAGARI)})
          THEN CASE WHEN regexp_matches(message, {re2(P.LATIN)}) THEN 'hinglish' ELSE 'hindi' END
        ELSE 'english' END AS language,
      length(message) AS message_length
    FROM chat""",
    "people": """SELECT * FROM messages WHERE "user" <> 'group_notification'""",
    "indexable": f"""
    SELECT * FROM people WHERE message <> '<Media omitted>' AND {strip('message')} <> ''""",
    "in_range": """
    SELECT * FROM people WHERE only_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'
      AND message NOT IN ('<Media omitted>', '')""",
    "stopwords": f"""
    SELECT word FROM (SELECT unnest(list_distinct({words('lower(text)')})) AS word FROM conversations)
    GROUP BY word HAVING count(*) > (SELECT count(*) * 0.1 FROM conversations)""",
    "lexicon": f"""
    SELECT token, CASE length(token) % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS polarity,
      list_extract([{sql_list(S.EMOTIONS)}], length(token) % 7 + 1) AS emotion
    FROM (SELECT DISTINCT unnest({tokens('text')}) AS token FROM conversations)""",
    "hits_of_tokens": f"""
    SELECT chat_id, seq, "user", polarity, emotion
    FROM (SELECT *, unnest({tokens('message')}) AS token FROM in_range) JOIN lexicon USING (token)""",
    "scores": """
    SELECT chat_id, seq, sum(polarity) AS score FROM hits_of_tokens GROUP BY ALL""",
    "index_rows": """
    SELECT CAST(label AS VARCHAR) AS chat_id, vec_id AS seq, 'v' || vec_id AS message_id, 'user_' || vec_id % 7 AS "user",
      TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 30 AS INTEGER)) + to_hours(vec_id % 24) AS date,
      'message ' || vec_id AS message, embedding
    FROM embeddings""",
    "questions": """
    SELECT vec_id AS question_id,
      CASE WHEN n % 5 = 4 THEN '  ' ELSE 'question ' || vec_id END AS question, embedding,
      DATE '2024-01-01' + n % 5 AS start_day,
      DATE '2024-01-01' + n % 5 + CASE WHEN n % 5 = 3 THEN 0 ELSE 20 END AS end_day
    FROM (SELECT *, CAST(vec_id // 50 AS INTEGER) AS n FROM embeddings WHERE vec_id % 50 = 0)""",
    "replies": """
    SELECT question_id, CASE WHEN question_id % 3 = 1 THEN '[Error: quota' ELSE 'answer ' || question_id END AS raw
    FROM questions WHERE question_id % 3 <> 2""",
    "distances": """
    SELECT q.question_id, q.question, q.start_day, q.end_day, i.* EXCLUDE (embedding),
      list_sum(list_transform(list_zip(q.embedding, i.embedding),
        lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
    FROM questions q CROSS JOIN index_rows i""",
    "ranked": """
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chat_id, seq) AS place FROM distances""",
    "retrieved": """
    SELECT *, 1 / (1 + distance) AS similarity,
      row_number() OVER (PARTITION BY question_id ORDER BY distance, chat_id, seq) AS rank
    FROM ranked WHERE place <= 10 AND trim(question) <> '' AND date >= start_day AND date < end_day""",
    "hits": "SELECT * FROM retrieved WHERE rank <= 5",
    "placed": "SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS pos FROM index_rows",
    "around": """
    SELECT h.question_id, h.rank, h.message_id AS hit_id, n.*
    FROM hits h JOIN placed p USING (message_id)
    JOIN placed n ON n.chat_id = p.chat_id AND n.pos BETWEEN p.pos - 10 AND p.pos + 10""",
    "context": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, message_id ORDER BY rank, pos) AS nth FROM around)
    WHERE nth = 1""",
    "model_replies": """
    SELECT response_id, kind, CASE (conv_id + turn) % 8 WHEN 0 THEN plain WHEN 1 THEN '```json' || chr(10) || plain || chr(10) || '```'
      WHEN 2 THEN '```' || chr(10) || plain || chr(10) || '```' WHEN 3 THEN 'Here it is:' || chr(10) || plain || chr(10) || 'Done.'
      WHEN 4 THEN plain || ' and ' || plain WHEN 5 THEN left(plain, 60) WHEN 6 THEN '' ELSE '[Error: quota' END AS raw
    FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS response_id,
      CASE WHEN turn % 2 = 0 THEN 'sentiment' ELSE 'topics' END AS kind,
      CASE WHEN turn % 2 = 0 THEN
        '{"overall_sentiment": {"positive": 0.' || conv_id % 10 || ', "neutral": 0.25, "negative": 0.125}, "emotions": {"joy": 0.'
        || turn % 10 || ', "anger": 0.0}, "primary_emotion": "joy", "insights": "conv ' || conv_id || '"}'
      ELSE '{"topics": [{"topic_name": "T' || conv_id || '", "description": "about ' || turn
        || '", "participants": ["a", "b"], "message_count": ' || (conv_id + turn)
        || ', "sentiment": {"positive": 0.5, "neutral": 0.25, "negative": 0.25}, "key_keywords": ["k' || conv_id
        || '", "z"]}, {"name": "N' || turn || '", "keywords": ["w' || turn || '"]}], "insights": "sum ' || conv_id || '"}'
      END AS plain FROM conversations)""",
    "spans": r"""
    SELECT *, nullif(regexp_extract(raw, '(?s)\{.*\}', 0), '') AS span FROM model_replies""",
    "parsed": "SELECT *, CASE WHEN json_valid(span) THEN span END AS doc FROM spans",
    "documents_as_messages": "SELECT source AS chat_id, doc_id AS seq, lang AS \"user\", text AS message FROM documents",
}


def oracle(body: str) -> str:
    """The query with the views it needs in front."""
    needed: list[str] = []
    names = list(VIEWS)
    wanted = {body}
    # Later views may use earlier ones: go backwards and keep what is mentioned.
    for name in reversed(names):
        if any(_mentions(text, name) for text in wanted):
            needed.append(name)
            wanted.add(VIEWS[name])
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names if name in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None
