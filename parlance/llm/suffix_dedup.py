"""Operator 5: removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when it lies in a string of `length` bytes that also starts earlier: in a document before it (smaller
doc_id, then smaller hash of the text) or in the same one further left. Strings are judged on the input and never cross
documents. Rows equal in id and text count as one document. Nulls count as empty; a null id is the smallest.

1. Every window of `length` bytes belongs to one anchor: the leftmost of its grams of `GRAM` bytes with the least hash. Equal
   windows have equal anchors, so they can only meet under the same gram. A run of windows with one anchor is a
   stretch; a task sends (gram, stretch, place) hashes, each equal stretch once: later ones of the task are repeats.
2. Under a gram, stretches that are equal to an earlier one are repeats as a whole. If different stretches share the gram,
   their first ones are candidates: some of their windows may be equal.
3. Candidates get their bytes from the documents and meet by gram. A task sorts the window starts of whole gram groups
   into suffix order, and with longest common prefixes of neighbours derives the longest previous factor of each from the
   previous and next smaller position. A window with a previous factor of the full length is a repeat.
   The windows of a gram with over `HOT` candidates are dealt by their own hash instead, so that no group is gathered:
   these groups hold equal windows, of which a task needs to hold the first only.
4. Repeats are gathered by document, united into spans and cut out.

A task holds one slice of texts (1), one gram's candidates of at most `HOT` or `BLOCK` windows (3), one document (4).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.shared import append_columns, keep, slices, small_side
from pyspark.sql import types as T

LENGTH, GRAM = 100, 32
#: Candidates of a gram from which on its windows are dealt by their own hash.
HOT = 20_000
#: Windows sorted together in a task, and bytes of text whose anchors are found together.
BLOCK, LOT_BYTES = 200_000, 3 << 20
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE_BITS = 24
#: Windows of one stretch: at most length - gram + 1.
_WINDOW_BITS = 23
_NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of substrings of a byte array, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        one = np.ones(1, dtype=np.uint64)
        up = np.cumprod(np.concatenate([one, np.full(max(0, n - 1), _BASE, dtype=np.uint64)]), dtype=np.uint64)[:n]
        self.down = np.cumprod(np.concatenate([one, np.full(n, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])

    def of(self, starts, ends) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, gram hash, stretch hash) of every run of windows with one anchor."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if n >= 1 << _PLACE_BITS:
        # A single long text: stretches are found in overlapping lots and those at the cuts are split, not lost.
        raise ValueError("a slice of texts is too long")
    hashes = Hashes(data)
    m = n - gram + 1
    grams = _mixed((hashes.sums[gram:] - hashes.sums[:m]) * hashes.down[:m])
    # The least hash of a window, its leftmost place in the low bits; by doubling.
    key = grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(m, dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    anchor = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= ends[owner]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    mine = anchor[at]
    first = np.concatenate([[True], (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)])
    starts = at[first]
    counts = np.diff(np.append(np.flatnonzero(first), len(at)))
    text = owner[starts]
    return text, starts - (ends - sizes)[text], counts, grams[mine[first]], hashes.of(starts, starts + counts - 1 + length)


def long_stretches(text: bytes, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """The same for one text beyond a slice's size, in pieces that overlap by length - 1 bytes."""
    step = 1 << (_PLACE_BITS - 2)
    out = []
    for a in range(0, max(1, len(text) - length + 1), step):
        t, s, n, g, h = stretches([text[a : a + step + length - 1]], length, gram)
        out.append((t, s + a, n, g, h))
    return out


def _places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, stretch, id, tie, place): place holds start, windows in _WINDOW_BITS, and repeat (an equal stretch lies before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            lots, now, size = [], [], 0
            for i, t in enumerate(texts):
                if len(t) >= 1 << (_PLACE_BITS - 2):
                    lots += [(np.full(len(x[0]), i), *x[1:]) for x in long_stretches(t, length, gram)]
                    continue
                if size + len(t) >= 1 << (_PLACE_BITS - 1):
                    x = stretches([texts[j] for j in now], length, gram)
                    lots.append((np.array(now, dtype=np.int64)[x[0]], *x[1:]))
                    now, size = [], 0
                now.append(i)
                size += len(t)
            if now:
                x = stretches([texts[j] for j in now], length, gram)
                lots.append((np.array(now, dtype=np.int64)[x[0]], *x[1:]))
            text, start, windows, grams, hashes = (np.concatenate(x) for x in zip(*lots)) if lots else (np.zeros(0, dtype=np.int64),) * 5
            if not len(text):
                continue
            own_id, own_tie = ids[text], ties[text]
            order = np.lexsort((start, own_tie, own_id, hashes, grams))
            grams, hashes, own_id, own_tie, start, windows = (x[order] for x in (grams, hashes, own_id, own_tie, start, windows))
            same = np.concatenate([[False], (grams[1:] == grams[:-1]) & (hashes[1:] == hashes[:-1])])
            twin = np.concatenate([[False], same[1:] & (own_id[1:] == own_id[:-1]) & (own_tie[1:] == own_tie[:-1]) & (start[1:] == start[:-1])])
            # Twins come from rows equal in id and text; one of them is sent.
            use = ~twin
            grams, hashes, own_id, own_tie, start, windows, same = (x[use] for x in (grams, hashes, own_id, own_tie, start, windows, same))
            grams, hashes = grams.view(np.int64).copy(), hashes.view(np.int64).copy()
            # Repeats are decided: they are dealt evenly, under a key of their own.
            away = _mixed((own_id[same].astype(np.uint64) << np.uint64(20)) ^ start[same].astype(np.uint64) ^ own_tie[same].astype(np.uint64)).view(np.int64)
            grams[same], hashes[same] = away, away
            place = start << (_WINDOW_BITS + 1) | windows << 1 | same
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams, hashes, own_id, own_tie, place)], names=["gram", "stretch", "id", "tie", "place"])

    return docs.select("id", "tie", "text").mapInArrow(run, "gram long, stretch long, id long, tie long, place long")


def longest_previous(order: list[int], common: list[int]) -> list[int]:
    """LPF of each position from the suffix order and the common prefixes of neighbours in it.

    While the order is read, a stack holds positions that grow upwards: what lies below one is its previous smaller
    position, what removes it the next smaller one; common prefixes are carried as minima.
    """
    out = [0] * len(order)
    stack: list[tuple[int, int]] = []
    for position, shared in zip([*order, -1], [0, *common, 0]):
        while stack and position < stack[-1][0]:
            below, its = stack.pop()
            out[below] = max(its, shared)
            shared = min(its, shared)
        stack.append((position, shared))
    return out


def repeated_windows(windows: np.ndarray) -> np.ndarray:
    """For rows of equal length (uint8), in position order: whether an equal row lies before."""
    n, length = windows.shape
    if n < 2:
        return np.zeros(n, dtype=bool)
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    ordered = windows[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return np.array(longest_previous(order.tolist(), common.tolist())) >= length


def _repeats(candidates: DataFrame, length: int) -> DataFrame:
    """(id, tie, start, end) of bytes in repeated windows, from rows (key, apart, id, tie, start, bytes) in key order."""
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (key, apart, id, tie, start, bytes)
        held, first_of_last = 0, 0

        def solve(part: list[tuple]) -> tuple[pa.RecordBatch | None, np.ndarray]:
            windows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(r[5], dtype=np.uint8), length) for r in part]
            counts = np.array([len(w) for w in windows])
            repeat = repeated_windows(np.concatenate(windows)) if len(windows) else np.zeros(0, dtype=bool)
            row = np.repeat(np.arange(len(part)), counts)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.flatnonzero(repeat)
            if not len(at):
                return None, repeat
            new = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (inner[at][1:] != inner[at][:-1] + 1)])
            firsts, lasts = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
            which = row[firsts]
            base = np.array([r[4] for r in part], dtype=np.int64)[which]
            columns = [np.array([r[2] for r in part], dtype=np.int64)[which], np.array([r[3] for r in part], dtype=np.int64)[which], base + inner[firsts], base + inner[lasts] + length]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema), repeat

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if rows and r[0] == rows[-1][0] and r[2:5] == rows[-1][2:5]:
                    continue  # a twin
                if not rows or r[0] != rows[-1][0]:
                    first_of_last = len(rows)
                    if held >= BLOCK:
                        out, _ = solve(rows)
                        if out is not None:
                            yield out
                        rows, held, first_of_last = [], 0, 0
                elif held >= BLOCK and r[1]:
                    # Within a group of single windows: those that repeat nothing stand for all so far.
                    out, repeat = solve(rows)
                    if out is not None:
                        yield out
                    rows = [x for x, again in zip(rows[first_of_last:], repeat[len(repeat) - (len(rows) - first_of_last) :]) if not again]
                    held, first_of_last = len(rows), 0
                rows.append(r)
                held += len(r[5]) - length + 1
        out, _ = solve(rows)
        if out is not None:
            yield out

    return candidates.mapInArrow(run, "id long, tie long, start long, end long")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans long, spans array<struct<start, end>>, kept binary), one row per document."""
    gram = min(GRAM, max(1, length // 3))
    if not 1 <= length < 1 << _WINDOW_BITS:
        raise ValueError(f"length must be at least 1 and below {1 << _WINDOW_BITS}")
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    twice = df.select(ident.alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    # Ties are needed only where ids repeat; else they are a constant.
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if twice else F.lit(0).cast("long")
    docs = df.select(ident.alias("id"), tie.alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))

    dealt = _places(docs, length, gram).repartition("gram")
    again = (F.col("place").bitwiseAND(1) == 1) | (F.rank().over(Window.partitionBy("gram", "stretch").orderBy("id", "tie", F.shiftright("place", _WINDOW_BITS + 1))) > 1)
    judged = dealt.withColumn("again", again)
    order = Window.partitionBy("gram").orderBy("stretch")
    firsts = judged.where("not again")
    shared = firsts.withColumn("beside", F.lag("gram").over(order).isNotNull() | F.lead("gram").over(order).isNotNull()).where("beside").drop("beside")
    found = keep(judged.where("again").unionByName(shared).select("gram", "id", "tie", F.shiftright("place", _WINDOW_BITS + 1).alias("start"), F.shiftright("place", 1).bitwiseAND((1 << _WINDOW_BITS) - 1).alias("windows"), "again"), "stretches")

    candidates = found.where("not again")
    hot = keep(candidates.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("gram").alias("hot_gram")), "hot")
    marked = candidates.join(small_side(hot, 8), F.col("gram") == F.col("hot_gram"), "left")
    # As many as the document has stretches.
    wanted = marked.groupBy("id", "tie").agg(F.collect_list(F.struct("gram", "start", "windows", F.col("hot_gram").isNotNull().alias("apart"))).alias("wanted"))
    cut = _bytes_of(docs.join(wanted, ["id", "tie"]), length)
    grouped = cut.repartition("key").sortWithinPartitions("key", "id", "tie", "start")
    parts = _repeats(grouped, length)

    whole = found.where("again").select("id", "tie", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    spans = whole.unionByName(parts).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return _cut_out(docs.join(spans, ["id", "tie"], "left"))


def _bytes_of(rows: DataFrame, length: int) -> DataFrame:
    """(key, apart, id, tie, start, bytes) of wanted stretches; those of hot grams as single windows by their hash."""
    at = [rows.schema.fieldNames().index(c) for c in ("id", "tie", "text", "wanted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            out: list[tuple] = []
            for ident, tie, text, wanted in zip(*(batch.column(i).to_pylist() for i in at)):
                data = text.encode("utf-8", "surrogatepass")
                hashes = Hashes(np.frombuffer(data, dtype=np.uint8)) if any(w["apart"] for w in wanted) else None
                for w in wanted:
                    a, n = w["start"], w["windows"]
                    if w["apart"]:
                        starts = np.arange(a, a + n)
                        for s, key in zip(starts.tolist(), hashes.of(starts, starts + length).view(np.int64).tolist()):
                            out.append((key, True, ident, tie, s, data[s : s + length]))
                    else:
                        out.append((w["gram"], False, ident, tie, a, data[a : a + n - 1 + length]))
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "apart", "id", "tie", "start", "bytes"])

    return rows.mapInArrow(run, "key long, apart boolean, id long, tie long, start long, bytes binary")


def _cut_out(rows: DataFrame) -> DataFrame:
    names = rows.schema.fieldNames()
    text_at, found_at = names.index("text"), names.index("found")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            out = []
            for text, found in zip(batch.column(text_at).to_pylist(), batch.column(found_at).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for s in merged for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(merged), [{"start": a, "end": b} for a, b in merged], kept))
            columns = list(zip(*out)) if out else [[]] * 5
            yield batch, [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary()))]

    return append_columns(rows, fields, make).select("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")
