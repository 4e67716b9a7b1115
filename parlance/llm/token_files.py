"""Operator 2: token ids in Parquet files that can be read in part.

Documents are dealt into ranges of doc_id, tokenised, and written in ascending order as one row each: doc_id, n_tokens,
part, place in the part, and the ids as a list column. The writer is Spark's own: ids are dictionary encoded (a page falls back to plain or,
with `encoding="delta"`, ids are packed as deltas), row groups and pages have set sizes, and pages carry an index, so a read of
metadata leaves the ids' pages alone and a filter on doc_id reads only pages that can hold it.

Nulls count as empty texts, so their row has only the end id. Null ids come first; rows of equal id follow each other. Starts are sums over the files' small columns: one sum for each part, added to a
running sum within the part, so no task sees all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.llm.shared import append_columns, by_bytes, scratch

#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Bytes of text whose distinct words are tokenised together; distinct chunks held between blocks and tasks.
BLOCK_BYTES, WORDS_HELD = 16 << 20, 400_000


class Words:
    """A tokenizer file applied to distinct pieces: its normaliser, its splitting pattern and its model, each once for a
    piece, with the ids held for the next text. A text that holds the string of an added token is encoded whole, as there
    the string becomes that token's id."""

    def __init__(self, content: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        spec = json.loads(content)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in steps]
        #: Pieces may be taken apart here only for this chain of steps; any other file is applied to whole texts.
        self.divisible = kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and not (spec.get("truncation") or spec.get("padding"))
        #: Added tokens are recognised in the text as it stands; those of normalised text need whole texts.
        added = spec.get("added_tokens") or []
        self.divisible = self.divisible and not any(t["normalized"] for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if self.divisible else None
        self.model = self.whole.model
        #: Ids of pieces and of whole chunks, made when asked for first; dropped and made anew beyond a number of chunks.
        self.ids = Made(self.piece)
        self.known = Made(self.chunk)
        self.known[""] = b""

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the splitting pattern, by the model."""
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece)])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without blanks or line ends."""
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            normal = chunk.lower()
            # Plain words with or without a closing mark need no pattern.
            if normal.isalpha():
                return self.ids[normal]
            if normal[-1] in _CLOSING and normal[:-1].isalpha():
                return self.ids[normal[:-1]] + self.ids[normal[-1]]
        else:
            normal = self.whole.normalizer.normalize_str(chunk)
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(normal)))

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library itself."""
        return [np.array(e.ids, dtype="<i4").tobytes() for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.divisible:
            return self.encode_whole(texts)
        if len(self.known) > WORDS_HELD:
            self.known.clear()
            self.ids.clear()
            self.known[""] = b""
        out = []
        for text in texts:
            if self.added and self.added.search(text):
                out += self.encode_whole([text])
            else:
                out.append(b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))))
        return out


class Made(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


#: How byte-level tokenizers show bytes: printable ones as themselves, the rest as the code points from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}
#: Marks that the pattern takes alone after letters.
_CLOSING = frozenset(".,;:!?")
#: Basic Latin and the Latin letters that upper and lower case map one to one (no combining marks).
_PLAIN = re.compile("[\x21-\x7e¡-įĲ-ňŊ-ž]*")


@lru_cache(1)
def words_of(content: str) -> Words:
    """One for each Python worker: what it has learned of words serves the next task too."""
    return Words(content)


def tokenise(df: DataFrame, tokenizer: str, text: str = "text", end_id: int = 1, name: str = "token_ids") -> DataFrame:
    """df with the ids of `text` (array<int>, end id included) and n_tokens long; `tokenizer` is the file's content."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    place = df.schema.fieldNames().index(text)
    end = int(end_id).to_bytes(4, "little")

    def make(batches: Iterator[pa.RecordBatch]):
        words = words_of(shared.value)
        for block in by_bytes(batches, BLOCK_BYTES):
            done = words.encode([t or "" for batch in block for t in batch.column(place).to_pylist()])
            at = 0
            for batch in block:
                own = [x + end for x in done[at : at + batch.num_rows]]
                at += batch.num_rows
                counts = np.array([len(x) // 4 for x in own], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), dtype="<i4")))
                yield batch, [lists, pa.array(counts)]

    return append_columns(df, [T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())], make)


def write(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, encoding: str = "dictionary", parts: int | None = None) -> None:
    """Files of (doc_id, n_tokens, part, place in the part, token_ids) in ascending doc_id order, below `path`."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = plain.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    coded = tokenise(ordered, tokenizer, "text", end_id).select("doc_id", "n_tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "token_ids")
    (
        coded.write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2" if encoding == "delta" else "v1")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("compression", "zstd")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id long, n_tokens long, part int, place long, token_ids array<int>"
    return spark.read.schema(schema).parquet(path)


def placed(files: DataFrame, counts: DataFrame) -> DataFrame:
    """files with start long: the ids of all documents before a row. `counts` is the files' (part, n_tokens)."""
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    # One row for each part: as many as there are files.
    sums = counts.groupBy("part").agg(F.sum("n_tokens").alias("__sum"))
    before = sums.select("part", (F.sum("__sum").over(Window.orderBy("part")) - F.col("__sum")).alias("__before"))
    inside = files.withColumn("__own", own - F.col("n_tokens"))
    return inside.join(before, "part").withColumn("start", F.col("__before") + F.col("__own")).drop("__before", "__own")


def checksums(files: DataFrame, name: str = "ids_crc32") -> DataFrame:
    """files with the crc32 of each row's ids as little-endian unsigned 32-bit integers, in place of the ids."""
    place = files.schema.fieldNames().index("token_ids")

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(place)
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            offsets = lists.offsets.to_numpy()
            yield batch, [pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())]

    return append_columns(files, [T.StructField(name, T.LongType())], make).drop("token_ids")


def new_path(spark: SparkSession) -> str:
    return scratch(spark, "token-files")
