"""Operator 13: product codes of vectors, with nearest codebook entries found by Orchard's search.

Components become the integers floor(scale * x), and a vector is cut into equal consecutive parts, each with its own
codebook. Codebooks start as the parts of the smallest vec_ids; a round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and puts each entry at the componentwise floor of its parts' mean.

Orchard's search: for every entry the others are listed by their distance from it. A search holds a current entry, walks
its list, jumps to the list of any entry found nearer (or as near with a lower index), skips entries visited before, and
stops at a list place beyond twice the current distance, as by the triangle inequality nothing later can be as near. All
is integer arithmetic, so the result is exact. The searches of a batch advance together, a step of each at a time.

A vector that is null or holds a null or non-finite component is left out, also one that has another number of components
than most (ties: more) or no component. Null vec_ids come last in the order; rows with equal vec_ids are each coded, and
ordered by their vector where the codebooks start. Null labels count as one label. Fewer vectors than entries give fewer
entries; no vector gives no rows. Other columns are not read. A number of components that can't be cut into equal parts, and
components beyond 2^24 after scaling, raise.

The table is read once for every round and once for the codes, without a shuffle of vectors: a task sends the sums of its
parts, at most parts times entries rows. Codebooks (the driver's, sent with the tasks) have that size too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import give_back, keep, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are below this, so that squared distances fit in 64 bits.
LARGEST = 1 << 24
#: Searches that advance together.
BATCH = 1 << 14


class Codebook:
    """The entries of one part position, with each entry's list of the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        count = len(entries)
        between = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(between, axis=1, kind="stable")
        #: Four times the squared distances in list order (twice a distance, squared), after the end beyond any distance.
        self.gaps = np.hstack([np.take_along_axis(between, self.order, axis=1), np.full((count, 1), np.iinfo(np.int64).max)])
        self.order = np.hstack([self.order, np.zeros((count, 1), dtype=np.int64)])
        #: Entries by their first component, for a near entry to start from.
        self.by_first = np.argsort(self.entries[:, 0], kind="stable")
        self.firsts = self.entries[self.by_first, 0]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each query; ties: the lowest index."""
        n, count = len(queries), len(self.entries)
        near = np.minimum(np.searchsorted(self.firsts, queries[:, 0]), count - 1)
        best = self.by_first[near]
        least = ((queries - self.entries[best]) ** 2).sum(axis=1)
        visited = np.zeros((n, count), dtype=bool)
        visited[np.arange(n), best] = True
        # The state of the searches that go on; `place` is the next place of the current entry's list.
        going = np.arange(n)
        place = np.zeros(n, dtype=np.int64)
        while len(going):
            current = best[going]
            on = self.gaps[current, place] <= 4 * least[going]
            if not on.all():
                going, place, current = going[on], place[on], current[on]
            candidate = self.order[current, place]
            new = ~visited[going, candidate]
            place += 1
            if not new.any():
                continue
            who, which = going[new], candidate[new]
            visited[who, which] = True
            distance = ((queries[who] - self.entries[which]) ** 2).sum(axis=1)
            better = (distance < least[who]) | ((distance == least[who]) & (which < best[who]))
            moved = who[better]
            best[moved], least[moved] = which[better], distance[better]
            jumped = np.flatnonzero(new)[better]
            place[jumped] = 0
        return best, least


def whole_numbers(batch: pa.RecordBatch, column: str, dims: int, scale: int) -> np.ndarray:
    """The vectors of a batch, all of `dims` finite components, as a matrix of integers."""
    lists = batch.column(batch.schema.get_field_index(column))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return scaled.astype(np.int64).reshape(-1, dims)


def kept_vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding array<double>, label) of the vectors that are coded, and their number of components."""
    given = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = given.where(finite & (F.size("embedding") > 0))
    sizes = good.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    return good.where(F.size("embedding") == dims), dims


def starts(vectors: DataFrame, dims: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """First codebooks: the parts of the vectors with the smallest vec_ids (at most `entries` rows reach the driver)."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    rows = [whole_numbers(batch, "embedding", dims, scale) for batch in first.to_batches()]
    matrix = np.concatenate(rows) if rows else np.zeros((0, dims), dtype=np.int64)
    return list(np.split(matrix, parts, axis=1))


def assigned(batch: pa.RecordBatch, books: list[Codebook], dims: int, scale: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, integer vectors, nearest entries of every part position) of the batch, lot by lot."""
    for at in range(0, batch.num_rows, BATCH):
        matrix = whole_numbers(batch.slice(at, BATCH), "embedding", dims, scale)
        width = dims // len(books)
        yield at, matrix, [book.nearest(np.ascontiguousarray(matrix[:, i * width : (i + 1) * width])) for i, book in enumerate(books)]


def improve(vectors: DataFrame, books: list[np.ndarray], dims: int, scale: int) -> list[np.ndarray]:
    """One round: the books with every used entry at the floor of its parts' mean."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        sums = [np.zeros((len(b), width + 1), dtype=np.int64) for b in shared.value]
        for batch in batches:
            for _, matrix, found in assigned(batch, own, dims, scale):
                for i, (best, _) in enumerate(found):
                    np.add.at(sums[i], best, np.hstack([matrix[:, i * width : (i + 1) * width], np.ones((len(best), 1), dtype=np.int64)]))
        for i, table in enumerate(sums):
            used = np.flatnonzero(table[:, -1])
            entry, place = np.repeat(used, width + 1), np.tile(np.arange(width + 1), len(used))
            columns = [np.full(len(entry), i), entry, place, table[used].reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total"])
        give_back()

    tables = vectors.select("embedding").mapInArrow(run, "part long, entry long, place long, total long")
    # One row for each number of the codebooks, and a count for each entry.
    totals = tables.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
    better = [np.array(b) for b in books]
    sums = {(p, e, k): n for p, e, k, n in zip(*(totals.column(c).to_pylist() for c in ("part", "entry", "place", "total")))}
    for (part, entry, place), total in sums.items():
        if place < width:
            better[part][entry, place] = total // sums[part, entry, width]
    return better


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, joined by commas: by part, entry, and position within the part."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def learn(vectors: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of vectors of `dims` finite components."""
    if not dims:
        return []
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    books = starts(vectors, dims, parts, entries, scale)
    for _ in range(rounds if len(books[0]) else 0):
        books = improve(vectors, books, dims, scale)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], dims: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (binary, one byte for each part) and error (long) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    kept = [vectors.schema["vec_id"], vectors.schema["label"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(own)), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for at, matrix, found in assigned(batch, own, dims, scale):
                for i, (best, least) in enumerate(found):
                    codes[at : at + len(matrix), i] = best
                    errors[at : at + len(matrix)] += least
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], names=["vec_id", "label", "code", "error"])
        give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return vectors.mapInArrow(run, f"{schema}, code binary, error long")


def compress(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of every vector that is coded; the codebooks). At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    vectors, dims = kept_vectors(df, vec_id, embedding, label)
    books = learn(vectors, dims, parts, entries, rounds, scale)
    coded = keep(encode(vectors, books, dims, scale), "codes")
    sums = keep(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "code-errors")
    joined = coded.join(small_side(sums, 64), F.col("label").eqNullSafe(F.col("__label")))
    return joined.drop("__label"), books


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes with `approximate` (array<double>): the vector that a code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    place = lambda i: F.conv(F.substring(F.hex("code"), 2 * i + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximate", F.concat(*[F.get(F.get(table, F.lit(i)), place(i)) for i in range(len(books))]))
