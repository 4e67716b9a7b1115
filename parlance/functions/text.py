"""Column expressions over message text. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import schema as S
from parlance.functions import patterns as P


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(text, F.lit(P.WHITE_CHARS))


def words(text: Column) -> Column:
    """Tokens between runs of white space; no empty tokens."""
    return F.array_remove(F.split(text, f"{P.WS}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def language(text: Column) -> Column:
    """Script-based label; Bengali is looked for first."""
    latin = text.rlike(P.LATIN)
    return (
        F.when(~text.rlike(P.INDIC), "english")
        .when(text.rlike(P.BENGALI), F.when(latin, "benglish").otherwise("bengali"))
        .when(text.rlike(P.DEVANAGARI), F.when(latin, "hinglish").otherwise("hindi"))
        .otherwise("english")
    )


def normalize(text: Column) -> Column:
    """Fold the listed transliterated words to lower case; leave everything else alone."""

    def whole_word(word: str) -> str:
        initials = "".join(sorted({w[0] for w in word.split("|")}))
        return f"(?iu)(?<!{P.WORD})(?=[{initials}])(?:{word})(?!{P.WORD})"

    folded = reduce(
        lambda column, word: F.regexp_replace(column, whole_word(word), word), S.TRANSLITERATED_WORDS, text
    )
    # One test spares most rows the thirteen replacements.
    return F.when(text.rlike(whole_word("|".join(S.TRANSLITERATED_WORDS))), folded).otherwise(text)


def clean(text: Column, collapse: bool = False) -> Column:
    """Remove media markers and links; optionally turn white-space runs into one space."""
    bare = F.when(text.contains("<"), F.regexp_replace(text, P.MEDIA, "")).otherwise(text)
    linked = text.contains("http") | text.contains("www") | text.contains("<")
    cleaned = F.when(linked, F.regexp_replace(bare, P.LINKS, "")).otherwise(bare)
    return F.regexp_replace(cleaned, f"{P.WS}+", " ") if collapse else cleaned


def urls(text: Column, domains: Sequence[str] | str = P.TOP_LEVEL_DOMAINS) -> Column:
    """Links in the text: with a scheme, with www, or a bare domain under one of the top-level domains (or a|b|c).

    Labels are looked up in a hash set, so a list of the whole registry costs no more than a short one.
    """
    found = F.regexp_extract_all(text, F.lit(P.URL_CANDIDATE), F.lit(0))
    known = [d.lower() for d in (domains.split("|") if isinstance(domains, str) else domains)]
    return F.filter(found, lambda u: u.rlike(P.URL_SCHEME) | F.lower(F.regexp_extract(u, P.URL_LABEL, 1)).isin(known))


def url_count(text: Column, domains: Sequence[str] | str = P.TOP_LEVEL_DOMAINS) -> Column:
    return F.when(text.rlike(P.URL_HINT), F.size(urls(text, domains))).otherwise(0).cast("long")


def emojis(text: Column) -> Column:
    """Every emoji code point, in order; parts of a sequence count one by one."""
    return F.regexp_extract_all(text, F.lit(P.EMOJI), F.lit(0))


def terms(text: Column) -> Column:
    """Word-cloud terms: lower case, no plain numbers. A possessive ending is still there, see term_of."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))


def term_of(found: Column) -> Column:
    """The term without a possessive ending."""
    return F.when(found.endswith("'s"), F.substring(found, 1, F.length(found) - 2)).otherwise(found)


def sentiment_tokens(text: Column) -> Column:
    """Lower-case white-space tokens reduced to letters, digits and apostrophes."""
    return words(F.regexp_replace(F.lower(text), P.NOT_TOKEN, ""))


def normalized_tokens(text: Column) -> Column:
    """sentiment_tokens(normalize(text)), without the folding where lower case gives the same: all letters of the folded
    words but i and k (dotted and dotless i, the Kelvin sign) have one upper case only."""
    special = text.contains("İ") | text.contains("ı") | text.contains("\u212a")
    return sentiment_tokens(F.when(special, normalize(text)).otherwise(text))


def chat_name(file_name: Column, trim_edges: bool = False) -> Column:
    """Chat id from an export's file name; with trim_edges, also without edge _ and -, and never empty."""
    name = F.replace(F.replace(file_name, F.lit(".txt"), F.lit("")), F.lit(" "), F.lit("_"))
    name = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")
    if not trim_edges:
        return name
    return F.coalesce(F.nullif(F.btrim(name, F.lit("_-")), F.lit("")), F.lit("chat"))
