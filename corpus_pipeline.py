"""A corpus from raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but
the last return the columns of ``documents``. What a stage returns is written
as Parquet in the shared folder and read again as the next stage's input, so a
lost executor never replays an earlier stage.

Defined results, for every stage: an empty table gives an empty one; columns that
the stage does not need pass through whatever their names. What nulls, ties and
repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, language_id, mixing, near_duplicates, quality
from folio.llm.common import bucket, columns, free, saved, table
from folio.llm.queries import QUALITY_CUT


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules score below the cut.

    A null text is scored as an empty one. Repeated rows score alike, so all stay
    or all go; a score that ties with the cut stays. Rows with a null doc_id are
    scored but never learned from.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))))
    score = free(docs, "quality_score")
    return quality.score(docs, model, score).where(F.col(score) >= QUALITY_CUT).select(*columns(docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without text or without any letter.

    With one learned language or more all others get one of those, also a text in
    an unlearned language or of random letters: op4 knows no other rejection.
    Without a learned language all are dropped. Repeated rows stay or go together;
    which language wins a tie does not matter here.
    """
    known = docs.where(~F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)))
    language, score = free(docs, "language_found"), free(docs, "language_score")
    found = language_id.identify(docs, language_id.fit(known), (language, score))
    return found.where(F.col(language) != language_id.UNKNOWN).select(*columns(docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each class of near duplicates.

    Null doc_ids come last; rows that tie on doc_id and text are one document, of
    which one row stays. Documents without words, null texts too, are near to
    nothing and all stay.
    """
    return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null texts hold nothing and stay; null items are in nothing. Repeated rows stay
    or go together.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, numbered by ``copy``.

    Null texts have no words and are drawn like others; a null source is a source of
    its own. Rows that repeat a doc_id draw alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL expresses none of the first four stages' models and searches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
