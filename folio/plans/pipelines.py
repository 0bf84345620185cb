"""Whole dataflows: documents to labelled reports and training rows."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, TextOptions, setup_logging
from ..functions.clean import preprocess
from ..functions.patterns import strip
from ..operators import label, lines, merge, report, segments
from ..sinks import files as sinks
from ..sources import files as sources


def classify(input_lines: DataFrame, mode: str = "zero-shot", merge_lines: bool = True, reply_fn=None, use_patterns: bool = True, chat: bool = False) -> DataFrame:
    """Labelled blocks of ordered lines (doc_id, line_idx, line)."""
    if mode == "few-shot":
        bare = input_lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
        split = lines.split_qa_markers(bare)
        blocks = merge.few_shot_blocks(split) if merge_lines else merge.single_blocks(split)
    else:
        blocks = merge.zero_shot_blocks(input_lines) if merge_lines else merge.single_blocks(input_lines)
    return label.label_blocks(blocks, mode, reply_fn, use_patterns, chat)


def classify_documents(input_lines: DataFrame, mode: str = "zero-shot", merge_lines: bool = True, reply_fn=None, timestamp: str | None = None, model: str = "patterns") -> DataFrame:
    """Reports of all documents of ordered lines."""
    labelled = classify(input_lines, mode, merge_lines, reply_fn)
    counted = input_lines.where(strip(F.col("line")) != "") if mode == "few-shot" else input_lines
    method = "zero-shot-llm" if mode == "zero-shot" else "few-shot-llm-with-merging" if merge_lines else "few-shot-llm"
    return report.document_report(labelled, counted, model, method, timestamp)


def classify_texts(spark: SparkSession, path: str, output: str | None = None, reply_fn=None, folders: bool = False) -> DataFrame:
    """Text files to reports, written below ``output`` if given."""
    return _reported(sources.read_texts(spark, path), output, reply_fn, folders)


def read_and_classify(
    spark: SparkSession, path: str | list[str], ocr_fn, output: str | None = None, render_fn=None, max_pages: int | None = None, reply_fn=None, folders: bool = False
) -> DataFrame:
    """PDF or image files through recognition to reports.

    What was recognised is kept before anything else reads it, as Parquet below
    ``output`` (or in the checkpoint folder, or else in the executors' storage), so
    that the model sees each page once.
    """
    from ..sources import ocr

    found = ocr.extract(sources.read_files(spark, path), ocr_fn, render_fn or ocr.render_pdf, max_pages)
    docs = found.withColumn("name", sources.stem(F.col("path")))
    if output:
        docs.write.mode("overwrite").parquet(f"{output}/recognised")
        docs = spark.read.schema(docs.schema).parquet(f"{output}/recognised")
        sinks.write_texts(docs, f"{output}/extracted", folders)
    else:
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.persist()
    return _reported(docs, output, reply_fn, folders)


def _reported(docs: DataFrame, output: str | None, reply_fn, folders: bool) -> DataFrame:
    made = classify_documents(lines.to_lines(docs), reply_fn=reply_fn, timestamp=datetime.now().isoformat())
    named = made.join(docs.select("doc_id", "name"), "doc_id")
    if output:
        sinks.write_reports(named, output, folders)
    return named


def lines_and_statistics(
    docs: DataFrame, output_jsonl: str | None = None, merge_breaks: bool = True, fix_duplicate: bool = False, remove_boxes: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(lines, statistics) of recognised Markdown, the lines written as JSONL if asked."""
    found = merge.document_lines(docs, merge_breaks, fix_duplicate, remove_boxes)
    if output_jsonl:
        sinks.write_jsonl(found, output_jsonl)
    return found, segments.line_statistics(found)


def full_text_pipeline(docs: DataFrame, output_jsonl: str | None = None, output_csv: str | None = None, options: TextOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Optional correction, then lines and statistics, and segments as CSV."""
    options = options or TextOptions()
    if options.aggressive_ocr_correction:
        docs = docs.withColumn("text", preprocess(F.col("text"), True))
    out = lines_and_statistics(docs, output_jsonl, options.merge_page_breaks, options.fix_duplicate, options.remove_bounding_boxes)
    if output_csv:
        text_to_csv(docs, output_csv)
    return out


def text_to_jsonl(docs: DataFrame, output: str, options: TextOptions | None = None) -> DataFrame:
    """Recognised texts (doc_id, text) to JSONL rows to be labelled, in one call; gives their statistics."""
    return full_text_pipeline(docs, output_jsonl=output, options=options)[1]


def text_to_csv(docs: DataFrame, output: str, include_metadata: bool = True) -> DataFrame:
    """Texts (doc_id, text) to CSV rows of their segments, in one call; gives the segments."""
    made = segments.segments(docs)
    sinks.write_csv(made, output, include_metadata)
    return made


def named_function(name: str) -> Callable:
    """``module:function``, imported."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


#: Texts that show what the rules do.
SAMPLES = [
    "Q1. Why does ice float on water?", "Ans: Because it is less dense.", "Name: A. Reader  Roll: 7", "--- PAGE 4 ---",
    "Storage Layer: one bucket for each region", "Section B: Long answers", "and it cools from the top.", "Define latent heat.",
]


def samples(spark: SparkSession) -> DataFrame:
    """The samples with their labels by both sets of rules."""
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(SAMPLES)], "at int, text string")
    both = {mode.replace("-", "_"): F.coalesce(label.P.pattern_label(F.col("text"), label.RULES[mode]), F.lit("unknown")) for mode in label.RULES}
    return rows.select("at", "text", *[column.alias(name) for name, column in both.items()])


def main(arguments: list[str] | None = None) -> int:
    """Command line: classify text files (``--text``), or files that need recognition."""
    parser = argparse.ArgumentParser(prog="folio", description="Label the text of documents as question, answer or metadata.")
    parser.add_argument("input", nargs="?", help="PDF or image files, read by --ocr; by default those of the folder paths.raw_data")
    parser.add_argument("--text", "-t", help="text files")
    parser.add_argument("--ocr", help="recognition function, as module:function(image bytes, prompt) -> text")
    parser.add_argument("--reply", help="labelling model for what no rule labels, as module:function(texts) -> replies")
    parser.add_argument("--max-pages", type=int)
    parser.add_argument("--output", "-o", help="output folder (paths.outputs)")
    parser.add_argument("--config", "-c", help="YAML settings")
    parser.add_argument("--rows", action="store_true", help="few files of rows instead of a folder for each document")
    parser.add_argument("--samples", action="store_true", help="label eight built-in texts and end")
    given = parser.parse_args(arguments)
    config = Config(given.config)
    if not (given.text or given.input or given.ocr or given.samples):
        parser.print_help()
        return 1
    if given.input and not given.ocr:
        parser.error("files other than text need a recognition function: --ocr module:function")
    log = setup_logging(config.get("paths.logs", "logs"))
    spark = SparkSession.builder.appName("folio").getOrCreate()
    if given.samples:
        samples(spark).show(truncate=False)
        return 0
    output = given.output or config.get("paths.outputs", "outputs")
    reply_fn = named_function(given.reply) if given.reply else None
    if given.text:
        made = classify_texts(spark, given.text, output, reply_fn, not given.rows)
    else:
        found = given.input or config.get("paths.raw_data", "data/raw")
        made = read_and_classify(spark, found, named_function(given.ocr), output, max_pages=given.max_pages, reply_fn=reply_fn, folders=not given.rows)
    report.summary(made).show(truncate=False)
    log.info("written below %s", output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
