"""Exact nearest neighbours by squared Euclidean distance, as a scan over the vector table.

Every task multiplies its vectors with a block of questions and keeps only the k best rows per question, so the
shuffle carries k rows per task and question instead of all pairs. Distances that decide are recomputed in double
precision by direct subtraction; ties go to the smaller (chat_id, seq).

Many questions (over MAP_BLOCKS blocks) never reach the driver: rows and questions meet in cells around pivots. A row
belongs to the cell of its nearest pivot, at that radius; a question goes to the cells that may hold one of its k nearest
rows by the triangle inequality, and rows that no question's reach touches are skipped before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.ordering import first_n
from parlance.sources.shared import keep

BROADCAST_BYTES = 64 << 20
HIT_BYTES = 128
MERGE_SALTS = 32
# So many blocks of questions are sent to map-only scans of the index; more are partitioned by pivots.
MAP_BLOCKS = 4
PIVOTS = 32
# Bytes of index vectors that meet a block of questions in one task.
SPLIT_BYTES = 32 << 20
# Radii are counted in bins of a quarter of a power of two, from 2**-16 to 2**16.
RADIUS_BINS = 128
_CELLS = 1 << 22


def _question_bytes() -> Column:
    return F.sum(F.size("_vector").cast("long") * 8 + 64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _of_length(rows: pa.Table, width: int) -> pa.Table:
    """The rows with a vector; one of another length than the questions' stops the job and is named."""
    usable = rows.filter(pc.is_valid(rows.column("embedding")))
    wrong = usable.filter(pc.not_equal(pc.list_value_length(usable.column("embedding")), width))
    if len(wrong):
        first = wrong.slice(0, 1).to_pylist()[0]
        raise ValueError(f"vector of {len(first['embedding'])} elements, not {width}: chat {first['chat_id']!r}, seq {first['seq']}")
    return usable


def _micros(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Times as microseconds; missing ones as the smallest number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


class _Best:
    """The k best rows per question seen so far in one task."""

    def __init__(self, questions: pa.Table, k: int, filtered: bool, kth: np.ndarray | None = None):
        self.ids = questions.column("question_id").combine_chunks()
        self.vectors = _matrix(questions.column("_vector"))
        self.norms = (self.vectors**2).sum(axis=1)
        self.k = k
        # Squared distances within which the k nearest rows lie.
        self.kth = np.full(len(self.ids), np.inf) if kth is None else kth
        self.bounds = None
        if filtered:
            stop = _micros(questions.column("_stop"))
            open_end = stop == np.iinfo(np.int64).min
            self.bounds = (_micros(questions.column("_start")), np.where(open_end, np.iinfo(np.int64).max, stop))
        self.hits: pa.Table | None = None

    def add(self, rows: pa.Table) -> None:
        usable = _of_length(rows, self.vectors.shape[1])
        step = max(64, _CELLS // max(1, len(self.ids)))
        for at in range(0, len(usable), step):
            self._add_block(usable.slice(at, step))

    def _add_block(self, rows: pa.Table) -> None:
        vectors = _matrix(rows.column("embedding"))
        # A vector with an element that is no number has no distance and is never a neighbour.
        finite = np.isfinite(vectors).all(axis=1)
        if not finite.all():
            rows, vectors = rows.filter(pa.array(finite)), vectors[finite]
        if not len(rows):
            return
        squares = (vectors**2).sum(axis=1)
        rough = self.norms[:, None] + squares[None, :] - 2.0 * (self.vectors @ vectors.T)
        if self.bounds is not None:
            dates = _micros(rows.column("date"))
            outside = (dates < self.bounds[0][:, None]) | (dates >= self.bounds[1][:, None])
            rough[outside] = np.inf
        # Rounding of the product form stays far below this slack: true distances lie within it around the rough ones,
        # and a neighbour's lower bound is at most the k-th least upper bound.
        slack = 1e-9 * (self.norms[:, None] + squares[None, :])
        limit = self.kth
        if len(rows) > self.k:
            limit = np.minimum(limit, np.partition(rough + slack, self.k - 1, axis=1)[:, self.k - 1])
        question, row = np.nonzero((rough - slack <= limit[:, None]) & np.isfinite(rough))
        if not len(question):
            return
        exact = np.empty(len(question))
        step = max(64, _CELLS // vectors.shape[1])
        for at in range(0, len(question), step):
            part = slice(at, at + step)
            exact[part] = ((self.vectors[question[part]] - vectors[row[part]]) ** 2).sum(axis=1)
        found = (
            rows.drop_columns(["embedding"])
            .take(pa.array(row))
            .append_column("_question", pa.array(question))
            .append_column("distance", pa.array(exact))
        )
        self._merge(found)

    def _merge(self, found: pa.Table) -> None:
        merged = found if self.hits is None else pa.concat_tables([self.hits, found])
        keys = [(name, "ascending") for name in ("_question", "distance", "chat_id", "seq")]
        merged = merged.take(pc.sort_indices(merged, sort_keys=keys))
        question = merged.column("_question").to_numpy()
        place = np.arange(len(question)) - np.searchsorted(question, question)
        self.hits = merged.filter(pa.array(place < self.k)).combine_chunks()
        full = place == self.k - 1
        self.kth[question[full]] = np.minimum(self.kth[question[full]], merged.column("distance").to_numpy()[full])

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.hits is None:
            return
        ids = self.ids.take(self.hits.column("_question").combine_chunks())
        table = self.hits.append_column("question_id", ids).select(schema.names).cast(schema)
        yield from table.to_batches()


def _scan(questions: pa.Table, index: DataFrame, k: int, filtered: bool, output: T.StructType) -> DataFrame:
    """One pass over the index with a broadcast block of questions."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(output)
    shared = index.sparkSession.sparkContext.broadcast(questions)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(shared.value):
            return
        best = _Best(shared.value, k, filtered)
        for batch in batches:
            best.add(pa.Table.from_batches([batch]))
        yield from best.batches(schema)

    return index.mapInArrow(task, output)


def _question_blocks(asked: DataFrame, blocks: int) -> Iterator[pa.Table]:
    """The questions in blocks by a hash of their ids, one at a time."""
    place = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    for block in range(blocks):
        yield asked.where(place == block).toArrow()


def _by_scans(asked: DataFrame, blocks: int, index: DataFrame, k: int, filtered: bool, output: T.StructType) -> DataFrame:
    """The k best rows of each question in each task, by one scan of the index for each block of questions."""
    scans = [_scan(block, index, k, filtered, output) for block in _question_blocks(asked, max(1, blocks))]
    return reduce(DataFrame.unionByName, scans)


def _known_rows(rows: DataFrame, wanted: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The rows whose keys may be among the wanted ones, told by their hashes, so that others need not be shuffled for a join.

    The distinct hashes, eight bytes each, go with the tasks; over the limit, all rows are returned.
    """
    hashes = wanted.select(F.xxhash64(*keys).alias("hash")).distinct()
    if hashes.count() * 8 > limit:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column(0).to_numpy()))

    @F.pandas_udf("boolean")
    def known(hash_: pd.Series) -> pd.Series:
        found, given = sent.value, hash_.to_numpy()
        if not len(found):
            return pd.Series(np.zeros(len(given), dtype=bool))
        return pd.Series(found[np.minimum(np.searchsorted(found, given), len(found) - 1)] == given)

    return rows.where(known(F.xxhash64(*keys)))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all pivots, by direct subtraction."""
    out = np.empty((len(vectors), len(pivots)))
    for i, pivot in enumerate(pivots):
        out[:, i] = np.sqrt(((vectors - pivot) ** 2).sum(axis=1))
    return out


def _slack(reach: np.ndarray) -> np.ndarray:
    """A bound on the rounding of a sum of distances, added to what it is compared with."""
    return 1e-9 * (1.0 + np.abs(reach))


class Cells:
    """What is known of the cells: counts and largest radii of their bins. At most PIVOTS * RADIUS_BINS numbers."""

    def __init__(self, pivots: np.ndarray, bins: list):
        self.pivots = pivots
        self.bin_cell = np.array([r["_cell"] for r in bins], dtype=np.int64)
        self.bin_count = np.array([r["n"] for r in bins], dtype=np.int64)
        self.bin_most = np.array([r["most"] for r in bins])
        self.count = np.zeros(len(pivots), dtype=np.int64)
        np.add.at(self.count, self.bin_cell, self.bin_count)
        self.least, self.most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        np.minimum.at(self.least, self.bin_cell, np.array([r["least"] for r in bins]))
        np.maximum.at(self.most, self.bin_cell, self.bin_most)

    def within(self, away: np.ndarray, k: int) -> np.ndarray:
        """For each question at these distances from the pivots: a distance within which k rows lie."""
        if self.count.sum() < k:
            return np.full(len(away), np.inf)
        bound = away[:, self.bin_cell] + self.bin_most
        order = np.argsort(bound, axis=1)
        enough = (np.cumsum(self.bin_count[order], axis=1) >= k).argmax(axis=1)
        rows = np.arange(len(away))
        limit = bound[rows, order[rows, enough]]
        return limit + _slack(limit)

    def reached(self, away: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, cell) of all cells that can hold a row within a question's limit."""
        nearer = np.maximum(away - self.most, self.least - away)
        return np.nonzero((nearer - _slack(away) <= limit[:, None]) & (self.count > 0))


def _placed(index: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The index rows with a finite vector, with `_cell` (nearest pivot) and `_radius` (distance to it)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    output = T.StructType([*index.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_radius", T.DoubleType())])
    schema = to_arrow_schema(output)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _of_length(pa.Table.from_batches([batch]), pivots.shape[1])
            if not len(rows):
                continue
            vectors = _matrix(rows.column("embedding"))
            finite = np.isfinite(vectors).all(axis=1)
            rows, away = rows.filter(pa.array(finite)), _distances(vectors[finite], pivots)
            cell = away.argmin(axis=1)
            radius = away[np.arange(len(cell)), cell]
            done = rows.append_column("_cell", pa.array(cell.astype(np.int32))).append_column("_radius", pa.array(radius))
            yield from done.cast(schema).to_batches()

    return index.mapInArrow(task, output)


def _reaching(asked: DataFrame, cells: Cells, k: int, filtered: bool) -> DataFrame:
    """A row for each question and cell that it reaches, with `_away` from the pivot and `_limit` (infinite with dates)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    added = [T.StructField("_cell", T.IntegerType()), T.StructField("_away", T.DoubleType()), T.StructField("_limit", T.DoubleType())]
    output = T.StructType([*asked.schema.fields, *added])
    schema = to_arrow_schema(output)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _distances(_matrix(batch.column("_vector")), cells.pivots)
            # Rows outside a question's dates don't count, so they give no limit.
            limit = np.full(len(away), np.inf) if filtered else cells.within(away, k)
            question, cell = cells.reached(away, limit)
            found = pa.Table.from_batches([batch]).take(pa.array(question)).append_column("_cell", pa.array(cell.astype(np.int32)))
            found = found.append_column("_away", pa.array(away[question, cell])).append_column("_limit", pa.array(limit[question]))
            yield from found.cast(schema).to_batches()

    return asked.mapInArrow(task, output)


def meeting(
    asked: DataFrame, index: DataFrame, k: int, filtered: bool, block_bytes: int, pivots: int = PIVOTS, split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame] | None:
    """(questions, index rows) dealt to `_cell`, `_split` and `_block` so that each question meets all its candidates.

    Hot cells are split: a split holds about split_bytes of rows, a block block_bytes of questions. Pivots are vectors
    of the smallest key hashes; they decide the work, not the result. None where there is no question or no row.
    """
    first = asked.select(F.size("_vector").alias("width")).first()
    if first is None:
        return None
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = index.where((F.size("embedding") == first.width) & finite)
    chosen = usable.orderBy(F.xxhash64("chat_id", "seq"), "chat_id", "seq").limit(pivots).select("embedding").toArrow()
    if not len(chosen):
        return None
    around = _matrix(chosen.column("embedding"))
    placed = _placed(index, around)
    log = F.when(F.col("_radius") > 0, F.floor(F.log2("_radius") * 4)).otherwise(-RADIUS_BINS)
    place = F.greatest(F.lit(-RADIUS_BINS // 2), F.least(F.lit(RADIUS_BINS // 2 - 1), log)).alias("_bin")
    sums = [F.count("*").alias("n"), F.min("_radius").alias("least"), F.max("_radius").alias("most")]
    cells = Cells(around, placed.groupBy("_cell", place).agg(*sums).collect())

    # One row for each cell that is reached: the radii in reach, and into how many parts its rows and questions go.
    going = _reaching(asked, cells, k, filtered)
    width = first.width * 8 + 64
    reach = [F.min(F.col("_away") - F.col("_limit")).alias("low"), F.max(F.col("_away") + F.col("_limit")).alias("high")]
    parts = []
    for r in going.groupBy("_cell").agg(F.count("*").alias("n"), *reach, F.max("_away").alias("far")).collect():
        rounding = float(_slack(np.float64(r.far + cells.most[r._cell])))
        splits = -(-int(cells.count[r._cell]) * width // split_bytes)
        parts.append((r._cell, r.low - rounding, r.high + rounding, max(1, splits), max(1, -(-r.n * width // block_bytes))))
    known = F.broadcast(index.sparkSession.createDataFrame(parts, "_cell int, _low double, _high double, _splits int, _blocks int"))

    rows = placed.join(known, "_cell").where(F.col("_radius").between(F.col("_low"), F.col("_high")))
    rows = rows.withColumn("_split", F.pmod(F.xxhash64("chat_id", "seq"), F.col("_splits")).cast("int"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = going.join(known, "_cell").withColumn("_block", F.pmod(F.xxhash64("question_id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    return dealt.drop("_low", "_high", "_splits", "_blocks", "_away"), rows.drop("_low", "_high", "_splits", "_blocks", "_radius")


def _by_pivots(asked: DataFrame, index: DataFrame, k: int, filtered: bool, output: T.StructType, block_bytes: int) -> DataFrame:
    """The k best rows of each question in each cell and split that it reaches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(output)
    names = index.columns
    met = meeting(asked, index, k, filtered, block_bytes)
    if met is None:
        return index.sparkSession.createDataFrame([], output)

    def task(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(questions) or not len(rows):
            return schema.empty_table()
        limit = questions.column("_limit").to_numpy()
        best = _Best(questions, k, filtered, limit**2 * (1 + 1e-9))
        best.add(rows.select(names))
        return pa.Table.from_batches(best.batches(schema), schema)

    keys = ("_cell", "_split", "_block")
    return met[0].groupBy(*keys).cogroup(met[1].groupBy(*keys)).applyInArrow(task, output)


def _with_digest(rows: DataFrame, column: str, names: list[str], width: int) -> DataFrame:
    """The named columns and `_digest` of the rows' vectors, equal where the vectors are; rows with a finite vector only."""
    from pyspark.sql.pandas.types import to_arrow_schema

    output = T.StructType([*[rows.schema[n] for n in names], T.StructField("_digest", T.BinaryType())])
    schema = to_arrow_schema(output)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if column == "embedding":
                table = _of_length(table, width)
            if not len(table):
                continue
            vectors = _matrix(table.column(column)) + 0.0  # a zero has one sign
            finite = np.isfinite(vectors).all(axis=1)
            digests = [blake2b(v.tobytes(), digest_size=16).digest() for v in vectors[finite]]
            table = table.filter(pa.array(finite)).select(names).append_column("_digest", pa.array(digests, pa.binary()))
            yield from table.cast(schema).to_batches()

    return rows.mapInArrow(task, output)


def _equal_rows(asked: DataFrame, index: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The hits of questions that have k rows of their own vector, and the other questions.

    Nothing is nearer than an equal vector, so those questions need no search. Vectors meet by a digest.
    """
    width = asked.select(F.size("_vector").alias("width")).first().width
    named = keep(_with_digest(asked, "_vector", asked.columns, width), "nearest-questions")
    wanted = named.select("_digest").distinct()
    equal = _with_digest(index, "embedding", ["chat_id", "seq"], width).join(wanted, "_digest", "left_semi")
    first = keep(first_n(equal, k, [F.col("chat_id"), F.col("seq")], ["_digest"]), "nearest-equal")
    enough = first.where(F.col("rank") == k).select("_digest")
    of_enough = first.join(enough, "_digest", "left_semi")
    hits = named.select("question_id", "_digest").join(of_enough, "_digest").select("question_id", "chat_id", "seq", F.lit(0.0).alias("distance"))
    return hits, named.join(enough, "_digest", "left_anti").select(*asked.columns)


def nearest(
    questions: DataFrame,
    index: DataFrame,
    k: int,
    within: tuple[str, str] | None = None,
    end_inclusive: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k nearest index rows of every question: question_id, index columns, distance, rank.

    questions: question_id, embedding, and the two date columns named by `within` when the search itself is
    limited to a date range. index: any columns with chat_id, seq, embedding (and date); chat_id and seq name a row.
    k is capped by what there is. Vectors with non-finite elements are never neighbours, and a question with one finds
    none; vectors of different lengths raise.

    The questions' size is read first. Up to broadcast_bytes they are sent to every task; up to MAP_BLOCKS times as many
    are sent in blocks of that size, one map-only scan for each, so the index is not shuffled. More questions stay off the
    driver: those with k rows of their own vector (single precision, no dates) are answered by equality, which nothing beats,
    the others, if still too many for those scans, meet the index rows in reach by cells around pivots (see `meeting`), with
    the same hits. Only keys, dates and vectors pass through Python; the other columns are joined to the hits, at most k for
    a question, after rows that are no hit were left out by the hashes of their keys.
    """
    columns = [F.col("question_id").alias("question_id"), F.col("embedding").alias("_vector")]
    if within:
        start, end = (F.col(c) for c in within)
        stop = F.date_add(end, 1) if end_inclusive else end
        columns += [start.cast("timestamp_ntz").alias("_start"), stop.cast("timestamp_ntz").alias("_stop")]
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = questions.where(F.col("embedding").isNotNull() & finite).select(*columns)

    scanned = index.select("chat_id", "seq", "embedding", *(["date"] if within else []))
    fields = {f.name: f for f in index.schema.fields}
    output = T.StructType(
        [asked.schema["question_id"], fields["chat_id"], fields["seq"], T.StructField("distance", T.DoubleType())]
    )
    size, asking = asked.agg(_question_bytes(), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // broadcast_bytes))
    if blocks > MAP_BLOCKS:
        # Differences of doubles can be too small for their squares.
        kinds = [t.elementType for t in (asked.schema["_vector"].dataType, scanned.schema["embedding"].dataType)]
        if not within and kinds == [T.FloatType(), T.FloatType()]:
            equal, rest = _equal_rows(asked, scanned, k)
            left = -(-(rest.agg(_question_bytes()).first()[0] or 0) // broadcast_bytes)
            # Few of them go to the index's tasks, unless the index is so small that moving it costs nothing.
            if left <= MAP_BLOCKS and scanned.count() * size > SPLIT_BYTES * asking:
                others = _by_scans(rest, left, scanned, k, False, output)
            else:
                others = _by_pivots(rest, scanned, k, False, output, broadcast_bytes)
            found = equal.unionByName(others)
        else:
            found = _by_pivots(asked, scanned, k, bool(within), output, broadcast_bytes)
    else:
        found = _by_scans(asked, blocks, scanned, k, bool(within), output)

    order = [F.col("distance"), F.col("chat_id"), F.col("seq")]
    salt = F.pmod(F.xxhash64("chat_id", "seq"), F.lit(MERGE_SALTS))
    partial = W.partitionBy("question_id", salt).orderBy(*order)
    final = W.partitionBy("question_id").orderBy(*order)
    hits = (
        found.withColumn("rank", F.row_number().over(partial))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
    )
    others = [c for c in index.columns if c not in ("embedding", "chat_id", "seq")]
    if not others:
        return hits
    named = index.select("chat_id", "seq", *others)
    # At most k rows for a question, whose number was counted above.
    bounded = F.broadcast(hits) if asking * k * HIT_BYTES <= broadcast_bytes else hits
    if blocks > MAP_BLOCKS:
        bounded = keep(hits, "nearest-hits")
        named = _known_rows(named, bounded, ["chat_id", "seq"], broadcast_bytes)
    named = named.join(bounded, ["chat_id", "seq"])
    return named.select("question_id", *[c for c in index.columns if c != "embedding"], "distance", "rank")
