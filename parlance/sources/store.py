"""Parquet tables of messages and index rows that grow by batches, and the two report exports.

A table is a folder of batches, which are never changed, and a manifest. A write puts its rows into a new batch, reads back
where they are, and then adds the batch to the manifest: a row for each file and chat in it with the number of rows, the
least and the greatest seq and whether the chat's earlier batches still count (`append`) or not (`replace`), and a row for
the batch with its columns. A batch without that last row was not finished and is not read; the next write replaces it.

A write of one chat so costs that chat, whatever else is stored. Readers merge: rows of a chat that a later batch replaced
are left out, and where none was replaced the batches are read as they are. One chat is read from the files that the
manifest names for it. `compact` gathers all that counts in one batch, `vacuum` removes the files that no longer count.
One writer at a time; readers see finished batches only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.ordering import number_rows
from parlance.operators.retrieval import positioned
from parlance.sources.shared import own_shuffles

#: Chats, or files, that are named one by one in a read; more of them are found by a join, or by reading all batches.
NAMED = 1000
#: Rows of a chat list that may be broadcast (counted first).
BROADCAST_ROWS = 500_000
_MANIFEST = "chat_id string, file string, n long, min_seq long, max_seq long, kind string, dimension int, columns string, batch int"


class Batch(NamedTuple):
    """A finished batch: its number, its columns, the length of its vectors (if any), whether it voids all before it."""

    number: int
    columns: T.StructType
    dimension: int | None
    clears: bool


def _found(read) -> DataFrame | None:
    """What a read gives; None where nothing is stored."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    return _found(lambda: spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"))


def batches(spark: SparkSession, path: str) -> list[Batch]:
    """The finished batches that may still count, in order; a row for each reaches the driver."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return []
    rows = manifest.where(F.col("chat_id").isNull() & F.col("kind").isin("batch", "clear")).orderBy("batch").collect()
    known = [Batch(r["batch"], T.StructType.fromJson(json.loads(r["columns"])), r["dimension"], r["kind"] == "clear") for r in rows]
    cleared = [i for i, b in enumerate(known) if b.clears]
    return known[cleared[-1] :] if cleared else known


def _stored(spark: SparkSession, path: str) -> list[Batch]:
    known = batches(spark, path)
    if not known:
        raise FileNotFoundError(f"no table is stored at {path}")
    return known


def _columns(known: list[Batch]) -> T.StructType:
    """The columns of all batches; a batch that lacks one has nulls there."""
    fields: dict[str, T.StructField] = {}
    for batch in known:
        fields |= {f.name: f for f in batch.columns.fields if f.name not in fields}
    return T.StructType(list(fields.values()))


def placed_chats(spark: SparkSession, path: str, known: list[Batch] | None = None) -> DataFrame:
    """The manifest's rows of chats that are not voided: batch, chat_id, file, n, min_seq, max_seq, and whether they count.

    Within a chat the batches from its last replacement on count. A chat has a row for each of its files.
    """
    known = batches(spark, path) if known is None else known
    if not known:
        return spark.createDataFrame([], "batch int, chat_id string, file string, n long, min_seq long, max_seq long, counts boolean")
    rows = _manifest(spark, path).where(F.col("file").isNotNull() & (F.col("batch") >= known[0].number) & (F.col("batch") <= known[-1].number))
    last = F.max(F.when(F.col("kind") == "replace", F.col("batch"))).over(W.partitionBy("chat_id"))
    rows = rows.where(F.col("batch").isin([b.number for b in known])) if len(known) <= NAMED else rows
    return rows.select("batch", "chat_id", "file", "n", "min_seq", "max_seq", (F.col("batch") >= F.coalesce(last, F.lit(0))).alias("counts"))


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def read_table(spark: SparkSession, path: str, chat_id: str | None = None) -> DataFrame:
    """A stored table, or one chat of it, of which only its own files are read."""
    known = _stored(spark, path)
    columns = _columns(known)
    placed = placed_chats(spark, path, known)
    names = columns.names
    if chat_id is not None:
        # Files of one chat.
        files = placed.where((F.col("chat_id") == chat_id) & F.col("counts")).select("batch", "file").distinct().collect()
        paths = [f"{path}/rows/batch={r['batch']}/{r['file']}" for r in files]
        found = spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)
        return found.where(F.col("chat_id") == chat_id)
    rows = _batch_rows(spark, path, known, columns)
    replaced = placed.where(~F.col("counts")).select(F.col("batch").alias("_batch"), "chat_id").distinct()
    number = replaced.count()
    if number:
        rows = rows.join(_sized(replaced, number), ["_batch", "chat_id"], "left_anti")
    return rows.select(*names)


def _batch_rows(spark: SparkSession, path: str, known: list[Batch], columns: T.StructType) -> DataFrame:
    """All rows of the batches, with the number of their batch."""
    folders = [f"{path}/rows/batch={b.number}" for b in known]
    with_batch = T.StructType([*columns.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(with_batch).option("basePath", f"{path}/rows").parquet(*folders).withColumnRenamed("batch", "_batch")


def _add_batch(
    table: DataFrame,
    path: str,
    kinds: DataFrame | str,
    dimension: int | None = None,
    clears: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write rows as a new batch and add it to the manifest. `kinds`: append or replace, for all chats or by chat_id.

    `finish` adds columns to the rows of a file row by row, after they were moved and sorted.

    The rebalance hint splits large chats and gathers small ones, so file sizes stay even; files are sorted by chat and
    have a Bloom filter of the chats, so a read of one chat skips other row groups.
    """
    spark = table.sparkSession
    known = batches(spark, path)
    number = known[-1].number + 1 if known else 1
    folder = f"{path}/rows/batch={number}"
    table = table.hint("rebalance", "chat_id").sortWithinPartitions("chat_id", "seq")
    table = finish(table) if finish else table
    with own_shuffles(spark):
        table.write.mode("overwrite").option("parquet.bloom.filter.enabled#chat_id", "true").parquet(folder)
    written = spark.read.schema(table.schema).parquet(folder)
    found = written.groupBy("chat_id", F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), F.min("seq").cast("long").alias("min_seq"), F.max("seq").cast("long").alias("max_seq")
    )
    found = found.withColumn("kind", F.lit(kinds)) if isinstance(kinds, str) else found.join(kinds, "chat_id")
    own = spark.createDataFrame([("clear" if clears else "batch", dimension, table.schema.json())], "kind string, dimension int, columns string")
    rows = found.withColumn("chat_id", F.col("chat_id").cast("string")).unionByName(own, allowMissingColumns=True)
    names = [f.strip().split(" ")[0] for f in _MANIFEST.split(",")][:-1]
    rows.select(names).hint("rebalance").write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")


def write_messages(messages: DataFrame, path: str) -> None:
    """Replace the stored rows of the chats in the table; other chats stay, and nothing of them is read or written."""
    _add_batch(messages, path, "replace")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at a path, in any file system that Spark reads."""
    try:
        spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def checked_vectors(index: DataFrame, dimension: int | None = None) -> DataFrame:
    """The index; a row without a vector, with one of another length or with a non-finite element stops the job.

    Without a dimension, the length of one of the index's vectors is the rule.
    """
    if dimension is None:
        first = index.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
        dimension = first[0] if first else 0
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = vector.isNull() | (F.size(vector) != dimension) | ~finite
    complaint = F.raise_error(F.concat(F.lit("no valid vector for message "), F.col("message_id")))
    return index.withColumn("embedding", F.when(bad, complaint.cast("array<float>")).otherwise(vector))


def _dimension(index: DataFrame) -> int:
    """Length of one of the vectors, 0 where there is none."""
    first = index.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    return first[0] if first else 0


def write_index(index: DataFrame, path: str, dimension: int | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replace the stored rows of the chats in the index; positions are stored with them.

    With `embed`, which adds the `embedding` row by row, vectors are made where they are written and never shuffled.
    """
    if embed is None:
        dimension = _dimension(index) if dimension is None else dimension
        _add_batch(positioned(checked_vectors(index, dimension)), path, "replace", dimension)
        return
    dimension = _dimension(embed(index)) if dimension is None else dimension

    def with_vectors(rows: DataFrame) -> DataFrame:
        found = checked_vectors(embed(rows), dimension)
        return found.select(*[c for c in found.columns if c != "pos"], "pos")

    _add_batch(positioned(index), path, "replace", dimension, finish=with_vectors)


def append_index(index: DataFrame, path: str, dimension: int | None = None) -> None:
    """Add rows whose message id is not stored yet in their chat; where nothing is stored, create the index.

    Of rows with the same id the one with the smallest seq counts. Ids are compared with those of the same chats only, read
    from the files that hold these chats, without vectors. A chat whose new rows follow its stored ones goes on with its
    next position, and nothing stored is read or written again. Where a new row stands before a stored one, the positions
    after it change: such a chat, and only such a one, is written anew.
    """
    spark = index.sparkSession
    known = batches(spark, path)
    if dimension is None:
        dimension = next((b.dimension for b in reversed(known) if b.dimension), None) or _dimension(index)
    once = F.row_number().over(W.partitionBy("chat_id", "message_id").orderBy("seq"))
    checked = checked_vectors(index.drop("pos"), dimension).withColumn("_once", once).where(F.col("_once") == 1).drop("_once")
    if not known:
        _add_batch(number_rows(checked), path, "replace", dimension)
        return
    # The new rows are needed several times and may be dear to make: they are set aside once.
    aside = f"{path}/aside"
    checked.write.mode("overwrite").parquet(aside)
    given = spark.read.schema(checked.schema).parquet(aside)
    touched = given.select("chat_id").distinct()
    placed = placed_chats(spark, path, known).where("counts").withColumn("chat_id", F.col("chat_id").cast(given.schema["chat_id"].dataType))
    stored = _rows_of(spark, path, known, placed, touched)
    new = given if stored is None else given.join(stored.select("chat_id", "message_id"), ["chat_id", "message_id"], "left_anti")
    ends = placed.join(touched, "chat_id", "left_semi").groupBy("chat_id").agg(F.sum("n").alias("_stored"), F.max("max_seq").alias("_last"))
    firsts = new.groupBy("chat_id").agg(F.min("seq").alias("_first")).join(ends, "chat_id", "left")
    late = F.coalesce(F.col("_first") > F.col("_last"), F.lit(True))
    places = firsts.select("chat_id", F.coalesce("_stored", F.lit(0)).alias("_base"), F.when(late, "append").otherwise("replace").alias("kind"))
    # A row for each chat of the batch.
    places_path = f"{path}/aside-chats"
    places.write.mode("overwrite").parquet(places_path)
    places = spark.read.schema(places.schema).parquet(places_path)
    sized = _sized(places, places.count())
    marked = new.join(sized, "chat_id")
    following = number_rows(marked.where("kind = 'append'")).withColumn("pos", F.col("pos") + F.col("_base"))
    table = following.drop("_base", "kind")
    if stored is not None and places.where("kind = 'replace'").head(1):
        mixed = marked.where("kind = 'replace'").drop("_base", "kind")
        old = stored.drop("pos").join(_sized(places.where("kind = 'replace'").select("chat_id"), places.count()), "chat_id", "left_semi")
        table = table.unionByName(number_rows(mixed.unionByName(old, allowMissingColumns=True)), allowMissingColumns=True)
    _add_batch(table, path, places.select("chat_id", "kind"), dimension)
    _remove(spark, aside, places_path)


def _rows_of(spark: SparkSession, path: str, known: list[Batch], placed: DataFrame, chats: DataFrame) -> DataFrame | None:
    """The rows that count of some chats, read from their files where these are few; None where there are none."""
    own = placed.join(chats, "chat_id", "left_semi").select("batch", "file").distinct().limit(NAMED + 1).collect()
    if not own:
        return None
    columns = _columns(known)
    if len(own) <= NAMED:
        paths = [f"{path}/rows/batch={r['batch']}/{r['file']}" for r in own]
        with_batch = T.StructType([*columns.fields, T.StructField("batch", T.IntegerType())])
        rows = spark.read.schema(with_batch).option("basePath", f"{path}/rows").parquet(*paths).withColumnRenamed("batch", "_batch")
    else:
        rows = _batch_rows(spark, path, known, columns)
    # A chat may have lines in the same files that a later batch replaced.
    live = placed.join(chats, "chat_id", "left_semi").select(F.col("batch").alias("_batch"), "chat_id").distinct()
    return rows.join(_sized(live, live.count()), ["_batch", "chat_id"], "left_semi").drop("_batch")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index with each row's position in its chat."""
    return read_table(spark, path)


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """chat_id, total_vectors and dimension of a stored index, from the manifest alone: no row of the index is read."""
    known = batches(spark, path)
    dimension = next((b.dimension for b in reversed(known) if b.dimension is not None), None)
    placed = placed_chats(spark, path, known).where("counts")
    return placed.groupBy("chat_id").agg(F.sum("n").alias("total_vectors")).withColumn("dimension", F.lit(dimension).cast("int"))


def clear_index(spark: SparkSession, path: str) -> None:
    """Leave an empty table with the same columns: a batch without rows that voids all before it."""
    known = _stored(spark, path)
    _add_batch(spark.createDataFrame([], _columns(known)), path, "replace", known[-1].dimension, clears=True)


def compact(spark: SparkSession, path: str) -> None:
    """Gather all rows that count in one new batch, which voids the others; `vacuum` then removes those."""
    known = _stored(spark, path)
    dimension = next((b.dimension for b in reversed(known) if b.dimension is not None), None)
    _add_batch(read_table(spark, path), path, "replace", dimension, clears=True)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove batches of which no row counts. Readers that began before may still need them: run it when none does."""
    known = _stored(spark, path)
    counting = {r["batch"] for r in placed_chats(spark, path, known).where("counts").select("batch").distinct().collect()}
    every = [r["batch"] for r in _manifest(spark, path).where("file IS NULL").select("batch").distinct().collect()]
    dead = [n for n in every if n not in counting and n < known[0].number]
    _remove(spark, *[f"{path}/{kind}/batch={n}" for n in dead for kind in ("rows", "manifest")])


def _remove(spark: SparkSession, *paths: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def write_topics_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_report(reports: DataFrame, path: str) -> None:
    """Report texts as text files."""
    reports.select("report").write.mode("overwrite").text(path)
