"""Operator 7: SimHash near-dedup found by Golay-code fuzzy keys.

A document's 64-bit fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints link at two
or fewer differing bits. The 64 bits are three segments of 22, 21 and 21 bits, each read as a 23-bit word. By the
pigeonhole principle two or fewer errors leave, for one of the ordered pairs (1,2), (2,3), (3,1), the first segment without
and the second with at most one error. The perfect binary Golay code (23, 12, 7) puts each word within distance 3 of one
code word; a word's keys are the indices of code words within distance 4 (one to six of them). Two words that differ in
one bit share the nearer one's centre, so a key (pair, exact segment, code word index) meets every link. Candidates of
a key are verified on all 64 bits.

Only distinct fingerprints take part. Within one key no list of pairs is made: the task links each fingerprint of the
group to its neighbours (pairwise tests for small groups, lookups of all words within two bits for larger ones, so the
work grows in proportion to the group) and sends on a spanning forest. Components are found by alternating large-star
and small-star steps, checkpointed in the shared folder.

Nulls and texts without words have fingerprint zero and link like any other. A task holds the distinct fingerprints of
one key at a time (8 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.shared import append_columns, in_one, keep, slices, small_side

#: First bit and length of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RADIUS = 2
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
#: From so many distinct fingerprints of a key on, neighbours are looked up instead of compared in pairs.
PAIRWISE = 2048
#: Bytes of text fingerprinted at once.
LOT_BYTES = 2 << 20


def fingerprint_of(text: str | None, words: int) -> int:
    """SimHash over XXH64 (seed 42) of word shingles, repeats included; no words: 0."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    if len(tokens) > words:
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])]
    else:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    values = np.array(hashes, dtype=">u8")
    ones = np.unpackbits(values.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values)).view(">u8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, name: str = "simhash") -> DataFrame:
    """df with the SimHash of `text` as a long (its bits)."""
    place = df.schema.fieldNames().index(text)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, LOT_BYTES)):
            values = np.array([fingerprint_of(t, words) for t in batch.column(place).to_pylist()], dtype=np.uint64)
            yield batch, [pa.array(values.view(np.int64))]

    return append_columns(df, [T.StructField(name, T.LongType())], make)


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome table, error pattern of each syndrome, weight-7 code words): nearest code words by syndrome decoding."""
    remainders = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):
        remainders ^= np.where(remainders >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    syndrome = remainders.astype(np.uint16)
    errors = np.zeros(1 << 11, dtype=np.uint32)
    units = [1 << i for i in range(23)]
    for a in [0, *units]:
        for b in [0, *units]:
            for c in [0, *units]:
                pattern = a | b | c
                errors[syndrome[pattern]] = pattern
    codewords = np.flatnonzero(syndrome == 0).astype(np.uint32)
    return syndrome, errors, codewords[np.bitwise_count(codewords) == 7]


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index) of every code word within distance 4 of each 23-bit word; an index is its 12 information bits."""
    syndrome, errors, sevens = golay_tables()
    words = words.astype(np.uint32)
    error = errors[syndrome[words]]
    centre = words ^ error
    places, found = [np.arange(len(words))], [centre]
    # A code word at distance 4 exists only around words at distance 3 from their centre: centre plus a code word of
    # weight 7 that holds all three error bits.
    outer = np.flatnonzero(np.bitwise_count(error) == 3)
    if len(outer):
        kinds, inverse = np.unique(error[outer], return_inverse=True)
        for lot in range(0, len(kinds), 4096):
            part = kinds[lot : lot + 4096]
            rows, columns = np.nonzero((sevens[None, :] & part[:, None]) == part[:, None])
            counts = np.bincount(rows, minlength=len(part))
            starts = np.concatenate([[0], np.cumsum(counts)])
            mine = np.flatnonzero((inverse >= lot) & (inverse < lot + 4096))
            repeat = counts[inverse[mine] - lot]
            within = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            picked = columns[np.repeat(starts[inverse[mine] - lot], repeat) + within]
            places.append(np.repeat(outer[mine], repeat))
            found.append(np.repeat(centre[outer[mine]], repeat) ^ sevens[picked])
    return np.concatenate(places), np.concatenate(found) >> np.uint32(11)


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(key, simhash): the keys of each distinct fingerprint, three families of one to six."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [(values >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
            for family in range(3):
                exact, fuzzy = parts[family], parts[(family + 1) % 3]
                places, index = golay_keys(fuzzy)
                key = exact[places] << np.uint64(14) | index.astype(np.uint64) << np.uint64(2) | np.uint64(family)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(values[places].view(np.int64))], names=["key", "simhash"])

    return prints.select("simhash").mapInArrow(run, "key long, simhash long")


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of distinct 64-bit values linked at `radius` or fewer differing bits."""
    n = len(values)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []

    def link(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                edges.append((int(values[i]), int(values[j])))

    if n <= PAIRWISE:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)
            if len(near):
                link(i, near + i + 1)
        return edges
    ordered = np.sort(values)
    values = ordered
    bits = [np.uint64(1 << i) for i in range(64)]
    masks = bits + [a | b for k, a in enumerate(bits) for b in bits[:k]] if radius == 2 else bits
    for mask in masks:
        wanted = ordered ^ mask
        at = np.minimum(np.searchsorted(ordered, wanted), n - 1)
        for i in np.flatnonzero((ordered[at] == wanted) & (at > np.arange(n))).tolist():
            link(i, at[i : i + 1])
    return edges


def links(keys: DataFrame) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, a spanning forest for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def flush():
            group = np.unique(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
            return forest(group) if len(group) > 1 else []

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            ends = np.append(starts[1:], len(key))
            edges = []
            # Groups of one row that begin and end in this batch have no link.
            for s, e in zip(starts.tolist(), ends.tolist()):
                if key[s] != held_key:
                    edges += flush()
                    held_key, held = key[s], []
                    if e - s == 1 and e < len(key):
                        continue
                held.append(values[s:e])
            if edges:
                pairs = np.array(edges, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        edges = flush()
        if edges:
            pairs = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    several = keys.repartition("key").sortWithinPartitions("key")
    return several.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches; nodes without a link are left out.

    Alternating large-star and small-star: every step replaces links by links to smaller nodes and never makes more
    than there are, until nothing changes. Steps are kept in the shared folder.
    """
    current = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = current.union(current.select(F.col("b"), F.col("a")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: all greater neighbours of a node link to its smallest neighbour (or to itself).
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).distinct()
        current = keep(small, name)
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = state


_NO_ID = -(1 << 63)


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, text_hash, simhash, component_id): one row per document; component_id is the smallest doc_id reachable.

    A null id counts as larger than all others. Repeated rows get the same component.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    prints = keep(fingerprints(own, "text", words).drop("text"), "simhash")
    distinct = keep(prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(links(fuzzy_keys(distinct)))
    return label_components(prints, distinct, roots).select("doc_id", "text_hash", "simhash", "component_id")


def label_components(prints: DataFrame, distinct: DataFrame, roots: DataFrame, node: str = "simhash") -> DataFrame:
    """prints with component_id: the smallest doc_id of all nodes of the component. `distinct` is (node, first_id)."""
    linked = distinct.join(roots.withColumnRenamed("node", node), node, "left")
    linked = linked.withColumn("root", F.coalesce("root", node))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = keep(linked.join(least, "root").select(node, "component_id"), "labels")
    return prints.join(labels, node)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One document of each component stays (the smallest doc_id; of repeated rows one); the columns of df, whatever
    their names. A null id counts as larger than all others; a null text as one without words."""
    found = near_components(df, doc_id, text, words).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    found = keep(found.select("id", "text_hash", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "components")
    pair = ["id", "text_hash"]
    dropped = keep(found.where("not stays").select(pair).distinct(), "dropped")
    repeated = keep(found.where("stays").groupBy(pair).agg(F.count("*").alias("n")).where("n > 1").select(pair), "repeated")
    rows = in_one(df, doc=doc_id, body=text).select("__row", F.coalesce(F.col("doc").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("body").alias("text_hash"))
    rows = rows.join(small_side(dropped, 16), pair, "left_anti")
    few = small_side(repeated, 16)
    # Of repeated rows the first written one stays; they are numbered by the tasks that write them.
    again = keep(rows.join(few, pair, "left_semi").withColumn("number", F.monotonically_increasing_id()), "repeated-rows")
    first = keep(again.groupBy(pair).agg(F.min("number").alias("number")), "first-rows")
    one = again.join(small_side(first, 24), [*pair, "number"], "left_semi")
    return rows.join(few, pair, "left_anti").select("__row.*").unionByName(one.select("__row.*"))
