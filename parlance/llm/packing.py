"""Operator 12: packing of documents into sequences by exact-complement hashing, then best fit.

Documents become pieces of at most `size` tokens. How many pieces there are of each length is all that the plan needs: at
most `size` numbers, whatever the data. The plan opens sequences with the longest length left and looks up which one, two
or three lengths fill the gap exactly, in a table addressed by length and in an index of how many pairs make each sum;
a combination is consumed as often as the counts allow. What no combination completes goes on by best fit, the longest
piece that fits a gap first, and a gap that has become exactly fillable on the way is completed so. A step uses up a
length or closes its sequences, so the plan has a size bounded by `size`, not by the rows.

Pieces get a rank among those of their length: counted inside each task that writes them, plus the sums of the tasks
before it. The plan gives every interval of ranks its sequences and offset, so no length, however frequent, is gathered.

Null texts count as empty; an empty text has only its end id. Null doc_ids are kept. Repeated rows are packed each on
their own. An empty table gives no rows. Other columns of the input are not read. The pieces are written once, so a lost
executor repeats tasks, not ranks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.shared import by_bytes, give_back, keep, small_side

#: Tokens of a sequence, and the id that ends a document.
SIZE, END_ID = 1024, 2
#: Bytes of text encoded between two batches of output.
BLOCK_BYTES = 4 << 20


class Encoder:
    """A tokenizer file applied to texts, as the tokenizers library does without adding special tokens.

    Byte-level BPE files whose ids follow the order of their merges are applied by the faster of two public libraries
    that give the same ids; texts that hold an added token's string, and other files, go to the file's own library.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        spec = json.loads(content)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        plain = plain and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        plain = plain and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or [])
        if not plain:
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        shown = {chr(256 + i if b is None else b): byte for i, b, byte in _shown_bytes()}
        ranks = {bytes([shown[c] for c in token]): number for token, number in model["vocab"].items() if number < 256 + len(pairs)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or (self.added and self.added.search(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _shown_bytes() -> Iterator[tuple[int, int | None, int]]:
    """(number among the unprintable, own code point or None, byte): printable bytes are shown as they are."""
    hidden = 0
    for byte in range(256):
        printable = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte
        yield hidden, byte if printable else None, byte
        hidden += not printable


@lru_cache(1)
def encoder_of(content: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(content)


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Pieces of the documents, written to the shared folder: doc_id, piece, start, length, ids_crc32, the task (`part`)
    and the rank among the task's pieces of that length, and with `ids` the ids (array<int>).

    A document of more than `size` tokens, end id included, is cut; its first piece takes what the full ones leave.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for block in by_bytes(batches, BLOCK_BYTES):
            for batch in block:
                rows: list[tuple] = []
                values: list[bytes] = []
                for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    packed = np.array([*encoder.ids(content.as_py() or ""), end_id], dtype="<u4").tobytes()
                    total = len(packed) // 4
                    at, which = 0, 0
                    end = total % size or size if total > size else total
                    while at < total:
                        own = packed[4 * at : 4 * end]
                        length = end - at
                        rows.append((number, which, at, length, zlib.crc32(own), part, int(seen[length])))
                        if ids:
                            values.append(own)
                        seen[length] += 1
                        at, end, which = end, end + size, which + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in values])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), dtype="<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES + ["ids"] * ids)
        give_back()

    return keep(given.mapInArrow(run, _SCHEMA + ", ids array<int>" * ids), "pieces")


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class Complements:
    """How many pieces of each length are left, and which sums one, two or three of them make."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, dtype=np.int64)
        for length, number in counts.items():
            self.left[length] = number
        #: Pairs of different lengths, both at hand, by their sum; two of one length are looked up by themselves.
        self.pairs = np.zeros(2 * size + 1, dtype=np.int64)
        there = np.flatnonzero(self.left)
        for i, length in enumerate(there.tolist()):
            self.pairs[length + there[i + 1 :]] += 1

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times
        for length in set(lengths):
            if not self.left[length]:
                there = np.flatnonzero(self.left)
                self.pairs[length + there] -= 1
                # Lengths that are used up at the same time have lost their common pair once only.
                gone = [x for x in set(lengths) if x < length and not self.left[x]]
                for other in gone:
                    self.pairs[length + other] -= 1

    def often(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths of that sum, the longest first."""
        if total < 2 or total >= len(self.pairs):
            return None
        if self.pairs[total] > 0:
            longest = np.arange(min(total - 1, self.size), total // 2, -1)
            fits = (self.left[longest] > 0) & (self.left[total - longest] > 0)
            if fits.any():
                a = int(longest[fits.argmax()])
                return a, total - a
        half = total // 2
        return (half, half) if total == 2 * half and self.left[half] >= 2 else None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly, fewest first, then the longest."""
        if gap <= self.size and self.left[gap] > 0:
            return (gap,)
        two = self.pair(gap)
        if two:
            return two
        first = np.arange(min(gap - 2, self.size), 0, -1)
        rest = gap - first
        halves = np.where(rest % 2 == 0, self.left[np.minimum(rest // 2, self.size)], 0)
        hopeful = first[(self.left[first] > 0) & ((self.pairs[rest] > 0) | (halves >= 2))]
        for a in hopeful.tolist():
            # The pair must do without the piece taken first, where that is the only one of its length.
            self.left[a] -= 1
            two = self.pair(gap - a)
            self.left[a] += 1
            if two and self.often((a, *two)) > 0:
                return a, *two
        return None

    def longest(self, most: int) -> int | None:
        there = np.flatnonzero(self.left[: most + 1])
        return int(there[-1]) if len(there) else None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) and how many sequences have each; every piece is used once."""
    if any(not 0 < length <= size for length in counts):
        raise ValueError(f"pieces must have 1 to {size} tokens")
    index = Complements(counts, size)
    out: list[tuple[tuple[int, ...], int]] = []
    full = int(index.left[size])
    if full:
        out.append(((size,), full))
        index.take((size,), full)
    # Exact complements of every length, longest first.
    for length in range(size - 1, 0, -1):
        while index.left[length] > 0:
            index.left[length] -= 1
            rest = index.filling(size - length)
            index.left[length] += 1
            whole = (length, *rest) if rest else None
            times = index.often(whole) if whole else 0
            if not times:
                break
            out.append((whole, times))
            index.take(whole, times)
    # Best fit of what is left: one sequence is filled until nothing fits, and repeated as often as the counts allow.
    while index.longest(size) is not None:
        pattern: tuple[int, ...] = ()
        gap = size
        while gap:
            more = index.filling(gap) if pattern else None
            if more is None:
                best = index.longest(gap)
                if best is None:
                    break
                more = (best,)
            for length in more:
                index.left[length] -= 1
            pattern += more
            gap -= sum(more)
        for length in pattern:
            index.left[length] += 1
        times = index.often(pattern)
        out.append((pattern, times))
        index.take(pattern, times)
    return out


class Places:
    """Where the plan puts the piece of each rank: for a length, intervals of ranks with first sequence and offset."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], size: int):
        used = np.zeros(size + 1, dtype=np.int64)
        slots: list[tuple[int, int, int, int]] = []
        sequence = 0
        for lengths, times in patterns:
            offset = 0
            for length in lengths:
                slots.append((length, int(used[length]), sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        self.sequences = sequence
        table = np.array(slots, dtype=np.int64).reshape(-1, 4)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.rank, self.sequence, self.offset = (np.ascontiguousarray(table[:, i]) for i in (1, 2, 3))
        self.first = np.searchsorted(table[:, 0], np.arange(size + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        slot = np.empty(len(length), dtype=np.int64)
        for which in np.unique(length).tolist():
            own = length == which
            a, b = self.first[which], self.first[which + 1]
            slot[own] = a + np.searchsorted(self.rank[a:b], rank[own], side="right") - 1
        return self.sequence[slot] + rank - self.rank[slot], self.offset[slot]


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Written pieces with sequence_id and offset, both long, in place of part and rank."""
    by_task = keep(found.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # At most `size` rows.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = found.sparkSession.sparkContext.broadcast(Places(plan(counts, size), size))
    # One row for each task and length.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.join(small_side(keep(before, "piece-ranks"), 24), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            own = {name: batch.column(batch.schema.get_field_index(name)) for name in [*names, "rank"]}
            sequence, offset = places.find(own["length"].to_numpy(), own["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([own[n] for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, with `ids` also its ids."""
    return place(pieces(df, tokenizer, size, end_id, doc_id, text, ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, and the pieces' doc_ids and offsets.

    A group has at most as many rows as a sequence has tokens.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("pieces")
    return packed.groupBy("sequence_id").agg(ordered).select(
        "sequence_id", F.flatten("pieces.ids").alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.offset").alias("offsets")
    )
