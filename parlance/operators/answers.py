"""The question-and-answer result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.operators.retrieval import hit_summary

# The replies of the three outcomes without an answer.
BLANK_QUESTION = "Please ask a valid question."
NOTHING_FOUND = "I couldn't find relevant information in the specified date range."
NO_ANSWER = "Unable to generate answer due to an error. Please try again."
ERROR_PREFIX = "[Error"
ERROR_CONFIDENCE = 0.5


def answer_table(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: answer, citations, confidence, sources_count, outcome.

    answers: question_id, raw - what came back for the question's prompt. A question with hits but no row there
    counts as failed.
    """
    blank = F.coalesce(text.strip(F.col("question")) == "", F.lit(True))
    nothing = F.col("sources_count").isNull()
    failed = F.coalesce(F.col("raw").startswith(ERROR_PREFIX), F.lit(True))
    outcome = F.when(blank, "blank").when(nothing, "nothing_found").when(failed, "error").otherwise("answered")
    joined = (
        questions.select("question_id", "question")
        .join(hit_summary(hits), "question_id", "left")
        .join(answers.select("question_id", "raw"), "question_id", "left")
        .withColumn("outcome", outcome)
    )
    found = F.col("outcome").isin("error", "answered")
    no_citations = F.array().cast(joined.schema["citations"].dataType)
    return joined.select(
        "question_id",
        F.when(F.col("outcome") == "blank", BLANK_QUESTION)
        .when(F.col("outcome") == "nothing_found", NOTHING_FOUND)
        .when(F.col("outcome") == "error", NO_ANSWER)
        .otherwise(F.col("raw"))
        .alias("answer"),
        F.when(found, F.col("citations")).otherwise(no_citations).alias("citations"),
        F.when(F.col("outcome") == "answered", F.col("confidence"))
        .when(F.col("outcome") == "error", ERROR_CONFIDENCE)
        .otherwise(0.0)
        .alias("confidence"),
        F.when(found, F.col("sources_count")).otherwise(0).alias("sources_count"),
        "outcome",
    )
