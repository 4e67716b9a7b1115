"""Operator 3: document fingerprints as bottom-k sketches of shingle hashes.

A sketch holds the `k` smallest distinct hashes of a text's shingles of five words (words are runs of other characters than
[\\x20\\x09-\\x0D], compared as they are; fewer words: the whole sequence; none: the sketch is empty). The smallest k of two
sketches' union is the sketch of the texts' union, so sketches merge across parts of a text or of a corpus. From two
sketches resemblance is the share of the union's k smallest that both hold, containment follows from resemblance and the
estimated counts, and the distinct count of a full sketch is (k - 1) over the k-th smallest hash as a share of the range.

As text, a sketch is base64 of its ascending hashes (big-endian, 8 bytes each). Equal texts have equal sketches. Two empty
sketches resemble each other fully, an empty and another one not at all. A null text counts as empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.llm.shared import append_columns, keep, slices, small_side

K, WORDS = 128, 5
#: Bytes of text sketched at once.
LOT_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """ODD ** 0 .. ODD ** n, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _ODD, dtype=np.uint64)]), dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of the shingles of each text, in place order; all texts are worked on as one array of bytes."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    n = len(data)
    if not n:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    inside = ~_BLANK[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # Word hash: a polynomial of its bytes, from prefix sums (all modulo 2 ** 64), shifted to the word's start and mixed.
    up = _powers(n)
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    down = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
    word = _mixed((prefix[ends] - prefix[starts]) * down[starts])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at = np.searchsorted(starts, bounds)
    out = []
    rolled = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for j in range(words):
        rolled = rolled * _ODD + word[j : j + len(rolled)]
    rolled = _mixed(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(rolled[a : b - words + 1])
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for j in range(a, b):
                whole = whole * _ODD + word[j : j + 1]
            out.append(_mixed(whole + np.uint64(b - a)))
        else:
            out.append(word[:0])
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 4 * k:
        # Repeats could leave fewer than k distinct ones among the first; then all are sorted.
        part = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(hashes)[:k]


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpacked(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), dtype=">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the sketched sets."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    return float((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def sketches(texts: list[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    return [bottom(h, k) for h in shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts], words)]


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """df with the sketch of each text and n_shingles double, the estimated distinct count."""
    place = df.schema.fieldNames().index(text)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            found = sketches([t or "" for t in batch.column(place).to_pylist()], k, words)
            yield batch, [pa.array([packed(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())]

    return append_columns(df, [T.StructField(name, T.StringType()), T.StructField("n_shingles", T.DoubleType())], make)


def merge_by(df: DataFrame, by: list[str], name: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each value of `by`: hashes meet by value, and only the k smallest of a group and task are sent on."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(F.unbase64(name)) / 8) - 1, F.lit(-1))), lambda i: F.hex(F.substring(F.unbase64(name), (i * 8 + 1).cast("int"), F.lit(8))))
    raw = F.when(F.length(F.unbase64(name)) >= 8, pieces).otherwise(F.array().cast("array<string>"))
    rows = df.select(*by, F.explode_outer(raw).alias("__h")).distinct()
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("__h").asc_nulls_last()))).where(F.col("__n") <= k)
    # At most k hashes for a group.
    joined = F.array_join(F.array_sort(F.collect_list("__h")), "")
    return ranked.groupBy(*by).agg(F.base64(F.unhex(joined)).alias(name))


def _code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def against_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending doc_id (null ids first, equal ids by their texts' hashes; after the last: the first).
    Documents are dealt into ranges of doc_id; the first document of each range is also sent to the range before it, so a
    text is shuffled once and no task sees more than its range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # Ends of the ranges: as many numbers as there are partitions.
    cuts = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [] if parts > 1 else []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        # The number of cuts below an id, by halving: an expression of logarithmic depth.
        bucket = _below(F.col("id"), cuts, 0, len(cuts))
    dealt = rows.withColumn("part", bucket)
    firsts = keep(dealt.groupBy("part").agg(F.min(F.struct("id", "tie")).alias("first")), "firsts")
    numbered = firsts.select("part", "first.id", "first.tie", F.lag("part").over(Window.orderBy("part")).alias("before"), F.max("part").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    lead = numbered.select("part", F.col("id").alias("first_id"), F.col("tie").alias("first_tie"), F.coalesce("before", "last").alias("to"))
    joined = dealt.join(small_side(keep(lead, "leads"), 40), "part")
    head = (F.col("id") == F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    own = F.struct("part", F.lit(False).alias("halo"))
    sent = joined.withColumn("__to", F.explode(F.when(head, F.array(own, F.struct(F.col("to").alias("part"), F.lit(True).alias("halo")))).otherwise(F.array(own))))
    shuffled = sent.select("__to.part", "__to.halo", "id", "tie", "doc_id", "text").repartition(parts, "part").sortWithinPartitions("part", "halo", "id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (part, doc_id, text, sketch) of the row whose next one is not yet known
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            columns = [batch.column(i).to_pylist() for i in (0, 1, 4, 5)]
            found = sketches(columns[3], k, words)
            pairs = []
            for part, halo, ident, own_text, sketch in zip(*columns, found):
                if waiting is not None and waiting[0] == part:
                    pairs.append((waiting, own_text, sketch))
                    waiting = None
                if not halo:
                    waiting = (part, ident, own_text, sketch)
            if pairs:
                yield finish(pairs)

    def finish(pairs) -> pa.RecordBatch:
        from hashlib import sha256

        edited = []
        for (_, _, own_text, _), next_text, _ in pairs:
            m = len(own_text) // 4
            edited.append(own_text[: len(own_text) - m] + next_text[:m])
        new = sketches(edited, k, words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0][1] for p in pairs], pa.int64()),
                pa.array([len(p[0][2]) for p in pairs], pa.int64()),
                pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([packed(p[0][3]) for p in pairs]),
                pa.array([packed(x) for x in new]),
                pa.array([resemblance(p[0][3], x, k) for p, x in zip(pairs, new)], pa.float64()),
                pa.array([resemblance(p[0][3], p[2], k) for p in pairs], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return shuffled.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _below(value: Column, cuts: list[int], start: int, end: int) -> Column:
    """How many of the sorted cuts lie below a value, given that it is between start and end."""
    if start == end:
        return F.lit(start)
    middle = (start + end) // 2
    return F.when(value > F.lit(cuts[middle]), _below(value, cuts, middle + 1, end)).otherwise(_below(value, cuts, start, middle))
