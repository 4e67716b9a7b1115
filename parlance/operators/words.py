"""Word, term and emoji frequencies.

Ties between equally frequent words go to the one seen first. The place a word was first seen is carried as one
long (sequence number, then place in the message), which keeps the count a hash aggregation that
combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import text
from parlance.operators import filters
from parlance.operators.ordering import first_n, with_total

By = Sequence[str]
#: Bits of a place in its message, and of a sequence number; both together are one long.
_AT_BITS, _SEQ_BITS = 23, 40


def _counts(messages: DataFrame, tokens: Column, name: str, by: By, wanted: Column | None = None) -> DataFrame:
    """Count per token and place of its first occurrence; tokens is an array column.

    Sequence numbers from 2^40 and messages from 2^23 tokens on have no such place and stop the job.
    """
    places = messages.select(*by, "seq", F.posexplode(tokens).alias("_at", name))
    kept = places if wanted is None else places.where(wanted)
    outside = (F.col("seq") < 0) | (F.col("seq") >= 1 << _SEQ_BITS) | (F.col("_at") >= 1 << _AT_BITS)
    place = F.shiftleft(F.col("seq").cast("long"), _AT_BITS).bitwiseOR(F.col("_at").cast("long"))
    first = F.when(outside, F.raise_error(F.lit("sequence number or message too large")).cast("long")).otherwise(place)
    return kept.groupBy(*by, name).agg(F.count("*").alias("frequency"), F.min(first).alias("first_seen"))


def _most_common(counts: DataFrame, name: str, n: int, by: By) -> DataFrame:
    ranked = first_n(counts, n, [F.desc("frequency"), F.col("first_seen"), F.col(name)], by)
    return ranked.select(*by, name, "frequency", "rank")


def _without(counts: DataFrame, name: str, stopwords: DataFrame | None) -> DataFrame:
    """Anti-join after counting: the counts are already spread by word, so stop words need no broadcast."""
    if stopwords is None:
        return counts
    return counts.join(stopwords.select(F.col("word").alias(name)), name, "left_anti")


def word_counts(
    messages: DataFrame,
    stopwords: DataFrame | None = None,
    user: str = S.OVERALL,
    by: By = (),
    clean: bool = True,
    drop_media: bool = False,
    media_marker: str = S.MEDIA_MARKER,
    min_length: int = 3,
) -> DataFrame:
    """Count of every word that is long enough and no stop word."""
    chosen = messages.transform(filters.for_user(user)).transform(filters.without_notifications)
    if drop_media:
        chosen = chosen.transform(filters.without_media(media_marker))
    lowered = F.lower(F.col("message"))
    tokens = text.words(text.clean(lowered) if clean else lowered)

    word = F.col("word")
    wanted = F.length(word) >= min_length
    if clean:
        wanted = wanted & ~word.startswith("http") & ~word.startswith("<")
    return _without(_counts(chosen, tokens, "word", by, wanted), "word", stopwords)


def common_words(messages: DataFrame, stopwords: DataFrame | None = None, n: int = 20, by: By = (), **options) -> DataFrame:
    """The n most frequent words; options as for word_counts.

    clean=True is the page's rule (links and media markers removed); clean=False, drop_media=True is the plain
    rule without link removal.
    """
    return _most_common(word_counts(messages, stopwords, by=by, **options), "word", n, by)


def term_weights(messages: DataFrame, stopwords: DataFrame | None = None, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Word-cloud table: term frequency, and frequency relative to the most frequent term."""
    chosen = (
        messages.transform(filters.for_user(user))
        .transform(filters.without_notifications)
        .transform(filters.without_media())
    )
    found = chosen.select(*by, F.explode(text.terms(text.clean(F.col("message")))).alias("_found"))
    found = found.select(*by, text.term_of(F.col("_found")).alias("term"))
    counts = _without(found.groupBy(*by, "term").agg(F.count("*").alias("frequency")), "term", stopwords)
    weighted = with_total(counts, F.max("frequency"), "_largest", by)
    return weighted.select(*by, "term", "frequency", (F.col("frequency") / F.col("_largest")).alias("weight"))


def emoji_counts(messages: DataFrame, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """Every emoji with its count, most frequent first."""
    chosen = messages.transform(filters.for_user(user))
    counts = _counts(chosen, text.emojis(F.col("message")), "emoji", by)
    return counts.orderBy(*by, F.desc("frequency"), "first_seen").select(*by, "emoji", "frequency")


def top_emojis(messages: DataFrame, n: int = 10, user: str = S.OVERALL, by: By = ()) -> DataFrame:
    """The n most frequent emojis with each one's share of those n."""
    chosen = messages.transform(filters.for_user(user))
    top = _most_common(_counts(chosen, text.emojis(F.col("message")), "emoji", by), "emoji", n, by)
    shared = with_total(top, F.sum("frequency"), "_all", by)
    return shared.select(*by, "emoji", "frequency", "rank", (F.col("frequency") / F.col("_all")).alias("share"))
