"""Segments, chunks and line statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import preprocess, split_sentences
from ..functions.patterns import count_chars, rstrip, token_count
from ..functions.predicates import line_type


def segments(docs: DataFrame, min_length: int = 10, aggressive: bool = False, cleaned: bool = False) -> DataFrame:
    """Sentences of at least ``min_length`` characters; ids number all sentences from 1."""
    text = F.col("text") if cleaned else preprocess(F.col("text"), aggressive)
    parts = docs.select(F.col("doc_id").alias("document_id"), text.alias("text")).select("document_id", F.posexplode(split_sentences(F.col("text"))).alias("at", "text"))
    kind = F.when(rstrip(F.col("text")).endswith("?"), "question").otherwise("statement")
    return parts.where(F.length("text") >= min_length).select(
        "document_id",
        (F.col("at") + 1).cast("long").alias("id"),
        "text",
        count_chars(F.col("text")).alias("char_count"),
        token_count(F.col("text")).alias("word_count"),
        kind.alias("likely_type"),
    )


def chunks(docs: DataFrame, max_length: int = 512, overlap: int = 50) -> DataFrame:
    """Overlapping windows of characters; a text that fits is one chunk, also the empty one."""
    if overlap >= max_length:
        raise ValueError("overlap must be smaller than max_length, else chunking never ends")
    step = max_length - overlap
    n = F.length("text")
    starts = F.when(n <= max_length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)))
    out = docs.where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("chunk_idx", "start"))
    return out.select(
        "doc_id",
        F.col("chunk_idx").cast("long").alias("chunk_idx"),
        F.col("start").cast("long").alias("start"),
        F.substring("text", F.col("start") + 1, F.lit(max_length)).alias("chunk"),
    )


def line_statistics(lines: DataFrame) -> DataFrame:
    """Counts of lines by their heuristic type, per document."""
    kind = line_type(F.col("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("total_lines"),
        F.count_if(kind == "question").alias("likely_questions"),
        F.count_if(kind == "answer").alias("likely_answers"),
        F.count_if(kind == "unknown").alias("other"),
    )


def length_profile(lines: DataFrame, samples: int = 5) -> DataFrame:
    """Count, mean, least and most length of each document's lines, and its first lines."""
    first = Window.partitionBy("doc_id").orderBy("line_idx")
    length = count_chars(F.col("line"))
    ranked = lines.withColumn("at", F.row_number().over(first))
    return ranked.groupBy("doc_id").agg(
        F.count("*").alias("total_lines"),
        F.avg(length).alias("avg_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= samples, F.struct("at", "line")))), lambda r: r["line"]), "\n").alias("samples"),
    )
