"""The retrieval index and the ways to read it: by question, date range, user and context window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import schema as S
from parlance.functions import calendar, text
from parlance.operators import filters
from parlance.operators.nearest import nearest
from parlance.operators.ordering import STRIPE_ROWS, first_n, number_rows
from parlance.sources.shared import keep

if TYPE_CHECKING:
    from pyspark.ml import PipelineModel

ENCODE_BATCH = 32
OVER_FETCH = 2
CONTEXT_ROWS = 10
CITATIONS = 10
BROADCAST_ROWS = 500_000


def index_rows(messages: DataFrame) -> DataFrame:
    """Indexable messages with the columns the index keeps."""
    return messages.transform(filters.indexable).select("chat_id", "seq", *S.INDEX_COLUMNS)


def index_metadata(rows: DataFrame) -> DataFrame:
    """The index columns with dates as ISO strings."""
    return rows.withColumns(
        {
            "date": calendar.iso(F.col("date")),
            "only_date": F.date_format("only_date", "yyyy-MM-dd"),
        }
    )


def fit_embedding(rows: DataFrame, features: int = 384) -> PipelineModel:
    """The built-in embedding, fitted on messages: hashed term counts weighted by rarity, of unit length.

    It holds one weight for each of its `features`. Fit it once and keep it (`model.save(path)`, `load_embedding`):
    messages of later batches and questions have to be embedded by the same weights to be comparable.
    """
    from pyspark.ml import Pipeline

    return Pipeline(stages=_embedding_stages(features)).fit(_with_tokens(rows.select("message"), "message"))


def _embedding_stages(features: int) -> list:
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    return [
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]


def fit_and_embed(rows: DataFrame, columns: Sequence[str], features: int = 384) -> tuple[DataFrame, PipelineModel]:
    """The columns of the rows with the embedding of their messages, and the model, fitted on them.

    As fit_embedding and embed, but the messages are read and cut into words once: the columns and the counts of the
    hashed words are written to the shared folder.
    """
    from pyspark.ml import Pipeline, PipelineModel

    first, *later = _embedding_stages(features)
    tokens = _with_tokens(rows.withColumn("message", F.coalesce("message", F.lit(""))), "message")
    counts = keep(first.transform(tokens).select(*columns, "_counts"), "embedding-counts")
    fitted = Pipeline(stages=later).fit(counts)
    return _embedding_of(fitted.transform(counts)), PipelineModel([first, *fitted.stages])


def load_embedding(path: str) -> PipelineModel:
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def _with_tokens(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("_tokens", text.normalized_tokens(F.col(column)))


def embed(rows: DataFrame, model: PipelineModel, column: str = "message") -> DataFrame:
    """rows with the embedding of a text column. An empty text, or one of unknown words, gets the zero vector."""
    return _embedding_of(model.transform(_with_tokens(rows.withColumn(column, F.coalesce(F.col(column), F.lit(""))), column)))


def _embedding_of(unit: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = unit.withColumn("embedding", vector_to_array("_unit", "float32"))
    return vectors.drop("_tokens", "_counts", "_weights", "_unit")


def embed_questions(questions: DataFrame, model: PipelineModel) -> DataFrame:
    """Questions (question_id, question and any others) with embeddings by the index's model."""
    return embed(questions, model, "question")


def embed_with(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Embedding by a model of the caller's. load() runs once per task and returns texts -> matrix."""
    source = rows.withColumn("_text", F.coalesce(text.normalize(F.col("message")), F.lit("")))
    output = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            texts = batch.pop("_text").tolist()
            vectors = []
            for at in range(0, len(texts), ENCODE_BATCH):
                part = texts[at : at + ENCODE_BATCH]
                encoded = np.asarray(encode(part), dtype=np.float32)
                blank = np.array([not t for t in part])
                vectors.extend(np.where(blank[:, None], np.float32(0), encoded))
            yield batch.assign(embedding=vectors)

    return source.mapInPandas(task, output)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def retrieve_similar(questions: DataFrame, index: DataFrame, k: int = 5, **options) -> DataFrame:
    """The k nearest rows of each question with their similarity."""
    return nearest(questions, index, k, **options).withColumn("similarity", similarity(F.col("distance")))


def retrieve(
    questions: DataFrame, index: DataFrame, k: int = 50, prefilter: bool = False, end_inclusive: bool = False, **options
) -> DataFrame:
    """The k best rows of each question inside its date range.

    questions: question_id, question, embedding, start, end; a blank question finds nothing and a null bound does
    not restrict. As a rule twice k rows are fetched and the range applied to those, so fewer than k may be left;
    with prefilter the range limits the search itself.
    """
    asked = questions.where(text.strip(F.col("question")) != "")
    if prefilter:
        return retrieve_similar(asked, index, k, within=("start", "end"), end_inclusive=end_inclusive, **options)
    fetched = retrieve_similar(asked, index, OVER_FETCH * k, **options)
    ranges = asked.select("question_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = filters.in_retrieval_range(F.col("date"), F.col("_start"), F.col("_end"), end_inclusive)
    kept = fetched.join(ranges, "question_id").where(inside).drop("_start", "_end", "rank")
    return first_n(kept, k, [F.col("distance"), F.col("chat_id"), F.col("seq")], ["question_id"])


def retrieve_by_date_range(index: DataFrame, start: str | date, end: str | date, end_inclusive: bool = False) -> DataFrame:
    """Every indexed message from the start day up to, but by default not including, the end day."""
    first, last = (F.lit(str(d)).cast("date") for d in (start, end))
    return index.where(filters.in_retrieval_range(F.col("date"), first, last, end_inclusive))


def retrieve_by_user(index: DataFrame, user: str, k: int = 100) -> DataFrame:
    """A user's first k indexed messages."""
    return index.where(F.col("user") == user).orderBy("chat_id", "seq").limit(k)


def positioned(index: DataFrame, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """The index with each row's position in its chat; an index that has positions is returned as it is."""
    return index if "pos" in index.columns else number_rows(index, stripe_rows=stripe_rows)


def context(
    hits: DataFrame,
    index: DataFrame,
    size: int = 3,
    keys: Sequence[str] = (),
    stripe_rows: int = STRIPE_ROWS,
    measure: bool = False,
) -> DataFrame:
    """The rows from `size` before to `size` after each hit, in the indexed table.

    hits: message_id and the columns in keys, which are kept. Unknown ids find nothing. Hits of a positioned index
    know their place already; others are located by id. Either way the neighbouring positions meet the index on
    (chat_id, pos), an equality join. With measure the hits are counted first (store them before): few ones are
    broadcast, so that the index is not shuffled.
    """
    count = hits.count() if measure else None
    rows = positioned(index.drop("embedding"), stripe_rows)
    kept = [*keys, F.col("message_id").alias("hit_id")]
    if {"chat_id", "pos"} <= set(hits.columns):
        placed = hits.select(*kept, "chat_id", F.col("pos").alias("_pos"))
    else:
        places = rows.select(F.col("message_id").alias("hit_id"), "chat_id", F.col("pos").alias("_pos"))
        asked = hits.select(*kept)
        placed = (F.broadcast(asked) if _is_small(count, 1) else asked).join(places, "hit_id")
    around = F.sequence(F.col("_pos") - size, F.col("_pos") + size)
    wanted = placed.select(*keys, "hit_id", "chat_id", F.explode(around).alias("pos"))
    return (F.broadcast(wanted) if _is_small(count, 2 * size + 1) else wanted).join(rows, ["chat_id", "pos"])


def _is_small(hits: int | None, rows_each: int) -> bool:
    return hits is not None and hits * rows_each <= BROADCAST_ROWS


def context_union(
    hits: DataFrame,
    index: DataFrame,
    size: int = CONTEXT_ROWS,
    stripe_rows: int = STRIPE_ROWS,
    measure: bool = False,
) -> DataFrame:
    """Per question the messages around its hits, each once, in order of first appearance.

    Hits come in rank order and bring their window in chat order; a hit without a window stands for itself.
    """
    rows = context(hits, index, size, ["question_id", "rank"], stripe_rows, measure)
    kept = [c for c in ("chat_id", "seq", "message_id", "user", "date", "message")]
    alone = hits.join(rows.select("question_id", F.col("hit_id").alias("message_id")), ["question_id", "message_id"], "left_anti")
    offered = rows.select("question_id", "rank", "pos", *kept).unionByName(
        alone.select("question_id", "rank", F.lit(0).cast("long").alias("pos"), *kept)
    )
    # Dealt by question once, for this and what is made of a question's rows.
    first = offered.repartition("question_id").groupBy("question_id", "message_id").agg(
        F.min(F.struct("rank", "pos")).alias("place"),
        *[F.any_value(c).alias(c) for c in kept if c != "message_id"],
    )
    return first.select("question_id", *kept, F.col("place.rank").alias("rank"), F.col("place.pos").alias("pos"))


def _citation_list(n: int) -> Column:
    one = F.struct(
        F.col("rank").alias("id"),
        "user",
        "message",
        calendar.iso(F.col("date")).alias("timestamp"),
        F.bround("similarity", 3).alias("score"),
    )
    return F.sort_array(F.collect_list(F.when(F.col("rank") <= n, one)))


def _confidence() -> Column:
    best = F.avg(F.when(F.col("rank") <= 3, F.col("similarity")))
    return F.least(best / 2, F.lit(1.0))


def citations(hits: DataFrame, n: int = CITATIONS) -> DataFrame:
    """question_id and its first n hits as an ordered array of numbered citations."""
    return hits.groupBy("question_id").agg(_citation_list(n).alias("citations"))


def confidence(hits: DataFrame) -> DataFrame:
    """question_id, half the mean similarity of its three best hits (at most 1), and the number of hits."""
    return hits.groupBy("question_id").agg(
        _confidence().alias("confidence_raw"),
        F.bround(_confidence(), 2).alias("confidence"),
        F.count("*").alias("sources_count"),
    )


def hit_summary(hits: DataFrame, n: int = CITATIONS) -> DataFrame:
    """Citations, confidence and number of hits of each question, from one pass over the hits."""
    return hits.groupBy("question_id").agg(
        _citation_list(n).alias("citations"),
        F.bround(_confidence(), 2).alias("confidence"),
        F.count("*").alias("sources_count"),
    )


def index_stats(index: DataFrame, by: Sequence[str] = ("chat_id",)) -> DataFrame:
    return index.groupBy(*by).agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"))
