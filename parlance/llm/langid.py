"""Operator 9: language ID of words and spans.

Training counts hashed character n-grams (1 to 5 letters with word bounds, and the whole word) per language, in Spark,
over a bounded sample of labelled rows (`PER_LANGUAGE` rows of each language, lowest hash of their id first), and the
scripts in which each language is written. A word is scored for every language whose scripts hold it (all languages
where none does): the mean log probability of its n-grams, scaled by its length. Viterbi over the words of a text, with
a penalty for every switch of language, labels spans. The language with the most letters in its spans is the
prediction, its share of all letters weighted by the model's certainty is the score.

A text that is null or has no letter is `und` with score 0. With no labelled row at all, every text is `und`. Repeated
rows get the same label; ids, sources and labels are no inputs of a prediction. Prediction has no shuffle; a task holds one
Arrow batch and a bounded table of word scores. The model has `BUCKETS` times languages numbers, whatever the data; with more
than 128 languages it has fewer buckets, so that it stays within `MODEL_BYTES` (or `FEWEST_BUCKETS` for each language). More
than `MOST_LANGUAGES` different labels raise: a column of so many values holds no languages.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.llm.shared import append_columns, slices

#: Bound of the sample: labelled rows of each language that the model is fitted on.
PER_LANGUAGE = 1500
#: Width of the hashed n-gram table; the model's bytes and its narrowest table, reached with very many languages.
BUCKETS = 1 << 17
MODEL_BYTES, FEWEST_BUCKETS = 64 << 20, 1 << 10
#: Labels beyond this number are no languages.
MOST_LANGUAGES = 1 << 14
#: From so many languages on, a step of Viterbi's is one numpy operation.
MANY_LANGUAGES = 16
#: Longest n-gram; penalty of a switch between words, in nats.
LONGEST, SWITCH = 5, 12.0
#: Word scores held by a task before they are dropped and made anew.
WORDS_HELD = 150_000
#: Bytes of text scored at once.
LOT_BYTES = 512 << 10

#: First and last code points of scripts, by Unicode block (fixed values).
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_STARTS = np.array(sorted(a for _, a, _ in SCRIPTS))
_ENDS = np.array([b for _, b in sorted((a, b) for _, a, b in SCRIPTS)])
_KINDS = np.array([SCRIPT_NAMES.index(n) for _, n in sorted((a, n) for n, a, _ in SCRIPTS)])
#: Combining marks (accents and vowel signs) of the basic plane, where all scripts below lie: part of the word before them.
_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c))[0] == "M")
_MARK = re.compile(f"[{_MARKS}]")
#: Runs of letters (and of the few numerals that are no digits), without and with marks.
_WORD, _MARKED_WORD = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_WORD if text.isascii() or not _MARK.search(text) else _MARKED_WORD).findall(text)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Script number of each code point."""
    at = np.searchsorted(_STARTS, points, side="right") - 1
    inside = (at >= 0) & (points <= _ENDS[at])
    return np.where(inside, _KINDS[at], len(SCRIPT_NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of the words, the words' scripts (by their first letter) and letters."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    joined = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(joined)
    starts = np.concatenate([[1], 2 + np.cumsum(lengths[:-1] + 1) - 1])
    word = np.zeros(n, dtype=np.int64)
    word[starts[1:] - 1] = 1
    word = np.cumsum(word)
    blank = joined == 32
    buckets, owners = [], []
    key = np.zeros(n, dtype=np.uint64)
    crossed = np.zeros(n, dtype=bool)
    for size in range(1, LONGEST + 1):
        m = n - size + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + joined[size - 1 :] + np.uint64(1)
        if size > 2:
            # A blank inside would join two words.
            crossed = crossed[:m] | blank[size - 2 : size - 2 + m]
        use = ~crossed[:m] if size > 1 else ~blank[:m]
        mixed = key[use] ^ np.uint64(size)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
        # A gram that begins with a blank belongs to the word after it.
        place = np.flatnonzero(use)
        owners.append(word[np.where(blank[place] & (size > 1), np.minimum(place + 1, n - 1), place)])
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words], dtype=np.uint64)
    buckets.append(whole)
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    return np.concatenate(buckets).astype(np.int64), np.minimum(owner, len(words) - 1), scripts_of(joined[starts].astype(np.int64)), lengths


class Model:
    """Log probabilities of n-grams per language, and the scripts of each language."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray):
        self.languages, self.table, self.scripts = languages, table, scripts

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word: for each language the mean log probability of the n-grams times the root of the letters."""
        bucket, owner, script, lengths = grams(words)
        bucket %= len(self.table)
        sums = np.zeros((len(words), len(self.languages)))
        for language in range(len(self.languages)):
            sums[:, language] = np.bincount(owner, weights=self.table[bucket, language], minlength=len(words))
        number = np.maximum(1, np.bincount(owner, minlength=len(words)))
        sums *= (np.sqrt(lengths) * 2 / number)[:, None]
        allowed = self.scripts[:, script].T
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, sums, sums.min(axis=1, keepdims=True) - 50.0).astype(np.float32)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word (a row of scores each) under a penalty for every switch; ties: the first.

    A single language is the best path for sure if no stretch of words gains more than the penalty in another one, as
    every stretch in another language costs a switch at least. That is tested first, for all words at once.
    """
    n = len(scores)
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    gains = np.cumsum(scores.astype(np.float64) - scores[:, [best]], axis=0)
    floor = np.minimum(np.minimum.accumulate(gains, axis=0), 0.0)
    low = np.vstack([np.zeros((1, scores.shape[1])), floor[:-1]])
    if (gains - low).max() <= switch:
        return np.full(n, best, dtype=np.int64)
    return (_path if scores.shape[1] < MANY_LANGUAGES else _wide_path)(scores, switch)


def _path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best path by plain numbers, which is faster for few languages."""
    rows = scores.tolist()
    values, tops, floors = [rows[0]], [0], [0.0]
    value = rows[0]
    for row in rows[1:]:
        most = max(value)
        floor = most - switch
        tops.append(value.index(most))
        floors.append(floor)
        value = [(v if v >= floor else floor) + x for v, x in zip(value, row)]
        values.append(value)
    now = value.index(max(value))
    path = np.empty(len(rows), dtype=np.int64)
    path[-1] = now
    for i in range(len(rows) - 1, 0, -1):
        if values[i - 1][now] < floors[i]:
            now = tops[i]
        path[i - 1] = now
    return path


def _wide_path(scores: np.ndarray, switch: float) -> np.ndarray:
    n, count = scores.shape
    back = np.empty((n, count), dtype=np.int16)
    own = np.arange(count)
    value = scores[0].astype(np.float64)
    for i in range(1, n):
        top = int(value.argmax())
        stay = value >= value[top] - switch
        back[i] = np.where(stay, own, top)
        value = np.where(stay, value, value[top] - switch) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(value.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def train(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from all rows with a language: every language found is learned, each from a bounded sample."""
    labelled = rows.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"))
    # A bound on the hash under which somewhat more than the wanted number of a language's rows lies: counts first, one
    # for each language, then a filter, then the exact number.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} different labels: these are no languages")
    if not counts:
        return Model([], np.zeros((1, 0)), np.zeros((0, len(SCRIPT_NAMES)), dtype=bool))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * per_language / n))])
    place = (F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string")), 12).cast("double")) / float(1 << 52)
    languages = sorted(counts)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    picked = rows.where(F.col(lang).isNotNull()).where(place <= F.element_at(share, F.col(lang).cast("string")))
    picked = picked.select(F.element_at(number, F.col(lang).cast("string")).alias("lang"), F.col(text).alias("text"), place.alias("place"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    sample = picked.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "text")

    # Counts of buckets, then of scripts, in one array for each language.
    buckets = BUCKETS
    while buckets > FEWEST_BUCKETS and 4 * buckets * len(languages) > MODEL_BYTES:
        buckets //= 2
    width = buckets + len(SCRIPT_NAMES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, np.ndarray] = {}
        for frame in batches:
            for which, text in zip(frame["lang"], frame["text"]):
                counted = tables.setdefault(which, np.zeros(width, dtype=np.int64))
                words = words_of(text or "")
                if words:
                    bucket, _, script, lengths = grams(words)
                    counted[:buckets] += np.bincount(bucket % buckets, minlength=buckets)
                    counted[buckets:] += np.bincount(script, weights=lengths, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for which, counted in tables.items():
            at = np.flatnonzero(counted)
            yield pd.DataFrame({"lang": which, "at": at, "n": counted[at]})

    summed = sample.repartition(F.xxhash64("text")).mapInPandas(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    # At most `width` rows for a language.
    found = summed.toArrow()
    counted = np.zeros((width, len(languages)))
    counted[found["at"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    table, scripts = counted[:buckets], counted[buckets:].T
    probability = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * buckets))
    written = scripts >= np.maximum(1, 0.01 * scripts.sum(axis=1, keepdims=True))
    return Model(languages, probability.astype(np.float32), written)


class WordScores:
    """Scores and letters of the words met, by number; dropped and made anew beyond `WORDS_HELD` words."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.drop()

    def drop(self) -> None:
        self.number.clear()
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(0)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.number) > WORDS_HELD:
            self.drop()
        new = list(set().union(*texts).difference(self.number))
        if new and self.model.languages:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.scores(new)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), dtype=np.float64, count=len(new))])


def label(words: list[str], known: WordScores) -> tuple[str, float, list[tuple[int, str]]]:
    """(language, score, spans) of a text by its words, all known; a span is (words, language)."""
    languages = known.model.languages
    if not languages or not any(c.isalpha() for w in words for c in w):
        return "und", 0.0, []
    rows = np.fromiter(map(known.number.__getitem__, words), dtype=np.int64, count=len(words))
    scores = known.scores[rows]
    path = viterbi(scores)
    total = scores.sum(axis=0, dtype=np.float64)
    if (path == path[0]).all():
        best, share, spans = int(path[0]), 1.0, [(len(words), languages[path[0]])]
    else:
        letters = known.letters[rows]
        shares = np.bincount(path, weights=letters, minlength=len(languages)) / letters.sum()
        best = int(shares.argmax())
        share = float(shares[best])
        ends = np.flatnonzero(np.append(np.diff(path) != 0, True))
        spans = [(int(n), languages[path[e]]) for n, e in zip(np.diff(ends, prepend=-1), ends)]
    certain = 1.0 / np.exp(np.clip(total - total[best], None, 0.0)).sum() if total[best] == total.max() else 0.5
    return languages[best], float(share * certain), spans


def identify(df: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """df with lang_pred string, score double and lang_spans array<struct<words int, lang string>> (replaced if present).

    With `drop_text` the text doesn't come back.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.schema.fieldNames().index(text)
    spans = T.ArrayType(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())]))
    span_type = pa.list_(pa.struct([("words", pa.int32()), ("lang", pa.string())]))

    def make(batches: Iterator[pa.RecordBatch]):
        known = WordScores(shared.value)
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            texts = [words_of(t) if t else [] for t in batch.column(place).to_pylist()]
            known.learn(texts)
            out = [label(words, known) for words in texts]
            yield batch, [
                pa.array([x[0] for x in out], pa.string()),
                pa.array([x[1] for x in out], pa.float64()),
                pa.array([[{"words": n, "lang": name} for n, name in x[2]] for x in out], span_type),
            ]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", spans)]
    return append_columns(df, fields, make, [text] if drop_text else [])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of the number of folds (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
