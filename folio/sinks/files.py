"""Writers. Rows carry their document's name; a folder for each document is an option.

Folders suit some thousands of documents. With more, a job makes as many files as
documents for each output, so rows in few files are the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(docs: DataFrame, path: str, folders: bool = False) -> None:
    """Extracted texts: JSON rows (name, text), or a text file in a folder per document name."""
    rows = docs.select("name", "text").write.mode("overwrite")
    if folders:
        rows.partitionBy("name").option("lineSep", "\n").text(path)
    else:
        rows.json(path)


def report_json(report: DataFrame) -> DataFrame:
    """Reports as indented JSON that keeps null fields."""
    body = F.to_json(F.struct(*[c for c in report.columns if c not in ("doc_id", "name")]), {"pretty": "true", "ignoreNullFields": "false"})
    return report.select(*[c for c in ("doc_id", "name") if c in report.columns], body.alias("json"))


def write_reports(report: DataFrame, path: str, folders: bool = False) -> None:
    """Reports, questions and answers of each document, as three outputs.

    As rows: JSON of each report, and (key, at, text) of each entry. In folders: an
    indented JSON file, and text files with an empty line after each entry.
    """
    key = "name" if "name" in report.columns else "doc_id"
    report = report.persist()  # three outputs, made once
    try:
        if folders:
            report_json(report).select(key, F.col("json").alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/results")
        else:
            report.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
        for name in ("questions", "answers"):
            entries = report.select(key, F.posexplode(f"{name}.text").alias("at", "text"))
            if folders:
                ordered = entries.repartition(key).sortWithinPartitions(key, "at").select(key, F.col("text").alias("value"))
                ordered.write.mode("overwrite").partitionBy(key).option("lineSep", "\n\n").text(f"{path}/{name}")
            else:
                entries.write.mode("overwrite").json(f"{path}/{name}")
    finally:
        report.unpersist()


def training_rows(lines: DataFrame) -> DataFrame:
    """Rows to be labelled: the text and an empty label."""
    return lines.select(F.col("line").alias("text"), F.lit("").alias("label"))


def write_jsonl(lines: DataFrame, path: str) -> None:
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_idx")
    training_rows(ordered).write.mode("overwrite").json(path)


def write_csv(segments: DataFrame, path: str, include_metadata: bool = True) -> None:
    """Segments as CSV with a header and doubled quotes; nothing is written without rows."""
    columns = ["document_id", "id", "text", "char_count", "word_count", "likely_type"] if include_metadata else ["text"]
    if segments.isEmpty():
        return
    ordered = segments.repartition("document_id").sortWithinPartitions("document_id", "id").select(*columns)
    options = {"header": True, "escape": '"', "lineSep": "\r\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.mode("overwrite").options(**options).csv(path)
