"""Operator 8: exact dedup by an exchange of Golomb-coded fingerprints.

1. Every task hashes its documents and sends each owner (a range of the hash) its distinct hashes, sorted, as Golomb
   codes of their gaps. A hash that the task has more than once is marked in a bitmap beside them.
2. Owners decode what all tasks sent and answer each with a bitmap: one bit per hash, set where it has copies.
3. Only suspects, rows whose hash has a set bit, are shuffled; they are grouped by their bytes, so equal hashes of
   different texts are told apart.

Texts are equal when identical after deleting blanks ([\\x20\\x09-\\x0D]); null counts as empty. Of equal texts the one
with the most code points stays, then the smallest doc_id (a null id is the largest). Of repeated rows with the same id
and length one stays: they are written out, and the first written one is taken. An owner holds its share of the distinct hashes of each task; a hot text is one hash per
task, and one row per task where suspects are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import BLANKS, in_one, keep, small_side

_TEXT, _HASH, _SHA = "__text", "__hash", "__sha"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct unsigned 64-bit values as Golomb codes of their gaps, parameter 2^bits: (bits, code).

    The code is the unary quotients' stream (a one ends each), then the remainders' stream of `bits` bits each.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / len(values)
    bits = int(min(63, max(0, np.floor(np.log2(max(1.0, 0.69 * mean))))))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    return bits, np.packbits(unary).tobytes() + np.packbits(rest.reshape(-1)).tobytes()


def golomb_decode(bits: int, code: bytes, n: int) -> np.ndarray:
    """The n values of a code."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    remainder_bytes = (n * bits + 7) // 8
    split = len(code) - remainder_bytes
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, dtype=np.uint8, count=split)))[:n]
    quotients = (np.diff(ones, prepend=-1) - 1).astype(np.uint64)
    rest = np.unpackbits(np.frombuffer(code, dtype=np.uint8, offset=split), count=n * bits).reshape(n, bits).astype(np.uint64)
    remainders = (rest << np.arange(bits, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(bits)) + remainders, dtype=np.uint64)


def sent_fingerprints(hashes: DataFrame, owners: int) -> DataFrame:
    """One row per task and owner: (owner, block, n, bits, code, own): the task's distinct hashes for that owner.

    `own` is a bitmap of the hashes that occur more than once in the task itself.
    """
    # An owner's range starts at owner * width; values are sent as distances from it.
    width = (1 << 64) // owners + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        cuts = np.searchsorted(values, np.array([i * width for i in range(1, owners)], dtype=np.uint64))
        rows = []
        for owner, (part, n) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts))):
            if len(part):
                bits, code = golomb_encode(part - np.uint64(owner * width))
                rows.append((owner, block, len(part), bits, code, np.packbits(n > 1).tobytes()))
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["owner", "block", "n", "bits", "code", "own"]), preserve_index=False)

    return hashes.mapInArrow(run, "owner long, block long, n long, bits long, code binary, own binary")


def answered(sent: DataFrame, owners: int) -> DataFrame:
    """(owner, block, copies): per task and owner a bitmap of the sent hashes that occur more than once anywhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in batches:
            for row in frame.itertuples(index=False):
                held.setdefault(row.owner, []).append(row)
        for owner, rows in held.items():
            lists = [golomb_decode(r.bits, r.code, r.n) for r in rows]
            own = [np.unpackbits(np.frombuffer(r.own, dtype=np.uint8), count=r.n).astype(bool) for r in rows]
            values, n = np.unique(np.concatenate(lists), return_counts=True)
            many = np.union1d(values[n > 1], np.concatenate([v[o] for v, o in zip(lists, own)]))
            maps = [np.packbits(np.isin(v, many)).tobytes() for v in lists]
            yield pd.DataFrame({"owner": owner, "block": [r.block for r in rows], "copies": maps})

    return sent.repartition(owners, "owner").mapInPandas(run, "owner long, block long, copies binary")


def suspect_hashes(sent: DataFrame, answers: DataFrame, owners: int) -> DataFrame:
    """Distinct hashes with a set bit: each task's codes beside the bitmap that came back."""
    width = (1 << 64) // owners + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [
                (golomb_decode(r.bits, r.code, r.n) + np.uint64(r.owner * width))[np.unpackbits(np.frombuffer(r.copies, dtype=np.uint8), count=r.n).astype(bool)].view(np.int64)
                for r in frame.itertuples(index=False)
            ]
            if found:
                yield pd.DataFrame({_HASH: np.concatenate(found)})

    joined = sent.select("owner", "block", "n", "bits", "code").join(answers, ["owner", "block"])
    return joined.mapInPandas(run, f"{_HASH} long").distinct()


def group_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with keep_id, group_size long, kept boolean, text_sha256 string (columns of these names are replaced)."""
    spark = df.sparkSession
    packed = in_one(df.drop("keep_id", "group_size", "kept", "text_sha256"), __doc=doc_id, __body=text)
    rows = packed.select("__row", F.col("__doc").cast("long").alias("__id"), F.coalesce("__body", F.lit("")).alias("__whole"))
    bare = F.translate("__whole", BLANKS, "")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))

    sent = keep(sent_fingerprints(rows.select(F.xxhash64(bare).alias(_HASH)), owners), "sent")
    suspects = keep(suspect_hashes(sent, answered(sent, owners), owners), "suspects")

    # Suspects' texts meet by their bytes; equal ones collapse in each task before they are sent.
    texts = rows.select("__id", F.length("__whole").alias("__chars"), bare.alias(_TEXT), F.xxhash64(bare).alias(_HASH))
    order = F.struct((-F.col("__chars")).alias("a"), F.col("__id").isNull().alias("b"), F.col("__id").alias("c"))
    verified = (
        texts.join(small_side(suspects, 16), _HASH)
        .select(_TEXT, order.alias("__order"))
        .groupBy(_TEXT)
        .agg(F.min("__order").alias("__best"), F.count("*").alias("__size"))
        .where("__size > 1")
        .select(F.sha2(_TEXT, 256).alias(_SHA), (-F.col("__best.a")).alias("__chars_kept"), F.col("__best.c").alias("__id_kept"), "__size")
    )
    groups = keep(verified, "groups")

    marked = rows.select("__row", "__id", F.length("__whole").alias("__chars"), F.sha2(bare, 256).alias("text_sha256"))
    joined = marked.join(small_side(groups, 120), marked["text_sha256"] == groups[_SHA], "left")
    best = (F.col("__chars") == F.col("__chars_kept")) & F.col("__id").eqNullSafe(F.col("__id_kept"))
    decided = joined.select(
        "__row",
        "__id",
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__id_kept")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__size").isNull() | best).alias("kept"),
        "text_sha256",
    )
    return _one_of_repeated(decided).select("__row.*", "keep_id", "group_size", "kept", "text_sha256")


def _one_of_repeated(decided: DataFrame) -> DataFrame:
    """Rows of one id that would all be kept for one text: the first written one stays kept."""
    repeated = keep(decided.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("__id").alias("__again")), "repeated-ids")
    if not repeated.head(1):
        return decided
    doubtful = F.col("kept") & (F.col("group_size") > 1)
    ids = small_side(repeated, 16)
    same = F.col("__id").eqNullSafe(F.col("__again"))
    again = keep(decided.where(doubtful).join(ids, same, "left_semi").withColumn("__number", F.monotonically_increasing_id()), "repeated-rows")
    first = keep(again.groupBy("text_sha256").agg(F.min("__number").alias("__first")), "first-rows")
    one = again.join(small_side(first, 100), "text_sha256").withColumn("kept", F.col("__number") == F.col("__first"))
    sure = decided.where(~doubtful).unionByName(decided.where(doubtful).join(ids, same, "left_anti"))
    return sure.unionByName(one.drop("__number", "__first"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, all others dropped; the columns of df, whatever their names."""
    found = group_copies(in_one(df, __doc_id=doc_id, __text=text), "__doc_id", "__text")
    return found.where("kept").select("__row.*")
