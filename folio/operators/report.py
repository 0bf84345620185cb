"""Per-document reports of labelled blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["text", "confidence", "reasoning", "original_line_indices"]
LISTS = {"questions": "question", "answers": "answer", "metadata": "metadata", "unknown": "unknown"}


def statistics(labelled: DataFrame, lines: DataFrame) -> DataFrame:
    """Six counts per document; ``lines`` are the input lines (doc_id, line)."""
    totals = lines.groupBy("doc_id").agg(F.count("*").alias("total_original_lines"))
    counts = labelled.groupBy("doc_id").agg(
        F.count("*").alias("total_merged_blocks"), *[F.count_if(F.col("label") == own).alias(f"{name}_count") for name, own in LISTS.items()]
    )
    names = ["total_merged_blocks", *[f"{name}_count" for name in LISTS]]
    return totals.join(counts, "doc_id", "left").select("doc_id", "total_original_lines", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def document_report(labelled: DataFrame, lines: DataFrame, model: str = "patterns", method: str = "zero-shot-llm", timestamp: str | None = None) -> DataFrame:
    """One row per document: four lists of entries in block order, and statistics."""
    entry = F.struct("text", "confidence", "reasoning", F.col("line_indices").alias("original_line_indices"))
    drop = lambda rows: F.transform(F.array_sort(rows), lambda r: r["entry"])
    lists = labelled.groupBy("doc_id").agg(
        *[drop(F.collect_list(F.when(F.col("label") == own, F.struct("block_id", entry.alias("entry"))))).alias(name) for name, own in LISTS.items()]
    )
    counts = statistics(labelled, lines)
    stats = F.struct(*[c for c in counts.columns if c != "doc_id"]).alias("statistics")
    return (
        counts.select("doc_id", stats)
        .join(lists, "doc_id", "left")
        .select("doc_id", *LISTS, "statistics", F.lit(model).alias("model"), F.lit(method).alias("method"), F.lit(timestamp).cast("string").alias("timestamp"))
    )


def shortened(text, limit: int = 80):
    """Text cut for display."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def top_entries(labelled: DataFrame, label: str = "question", n: int = 3) -> DataFrame:
    """The first n blocks of a label in each document, cut for display."""
    order = Window.partitionBy("doc_id").orderBy("block_id")
    ranked = labelled.where(F.col("label") == label).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= n).select("doc_id", "place", shortened(F.col("text")).alias("text"))


def summary(report: DataFrame) -> DataFrame:
    """What the console summary shows: five counts and the first questions and answers."""
    first = lambda name: F.transform(F.slice(name, 1, 3), lambda e: shortened(e["text"]))
    counts = ["total_original_lines", "total_merged_blocks", "questions_count", "answers_count", "metadata_count"]
    return report.select("doc_id", *[F.col(f"statistics.{c}").alias(c) for c in counts], first("questions").alias("sample_questions"), first("answers").alias("sample_answers"))
