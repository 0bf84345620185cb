"""Documents to ordered lines, and rewrites of lines that keep the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_text, minimal_clean
from ..functions.patterns import java, strip

#: Marks of questions and answers inside a line, in order.
SPLITS = [r"\s+(Q\s*\d*[\.\:\-]?\s+)", r"\s+(Q\s+[A-Z])", r"\s+(Ans\s*[\.\:\-]?\s*)", r"\s+(Answer\s*\d*[\.\:\-]?\s*)"]
MARKER = r"^(---\s*PAGE\s*\d+\s*---)\s*(.+)$"


def numbered(rows: DataFrame, *order: str) -> Column:
    """Position from 0 inside a document."""
    return (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("long")


def to_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_idx, line): stripped lines that are not blank, numbered from 0.

    Lines are counted inside each row's array, so that no shuffle is needed.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda s: s != "")
    exploded = docs.select("doc_id", F.posexplode(lines).alias("line_idx", "line"))
    return exploded.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "line")


def markdown_lines(docs: DataFrame, remove_boxes: bool = True) -> DataFrame:
    """Lines of recognised Markdown: clean the text, split, clean each line, drop blanks."""
    text = clean_text(F.col("text"), remove_boxes)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: minimal_clean(s)), lambda s: s != "")
    exploded = docs.select("doc_id", F.posexplode(lines).alias("line_idx", "line"))
    return exploded.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "line")


def _rewritten(lines: DataFrame, pieces: Column) -> DataFrame:
    parts = lines.select("doc_id", F.col("line_idx").alias("source_line_idx"), F.posexplode(F.filter(pieces, lambda s: s != "")).alias("k", "line"))
    return parts.select("doc_id", numbered(parts, "source_line_idx", "k").alias("line_idx"), "line", "source_line_idx")


def split_page_markers(lines: DataFrame) -> DataFrame:
    """A page marker and what follows it on its line become two lines."""
    bare = strip(F.col("line"))
    rule = java(MARKER, ignore_case=True)
    parts = F.array(F.regexp_extract(bare, rule, 1), strip(F.regexp_extract(bare, rule, 2)))
    return _rewritten(lines, F.when(bare.rlike(rule), parts).otherwise(F.array(bare)))


def split_qa_markers(lines: DataFrame) -> DataFrame:
    """A line goes apart at the first of the inner marks that it has, once."""
    bare = strip(F.col("line"))
    out = F.array(bare)
    for rule in reversed(SPLITS):
        # A mark begins where its white space does.
        mark = java(r"(?<!\s)" + rule, True)
        wrapped = f"(?s)^(.*?)({mark}.*)$"
        parts = F.array(strip(F.regexp_extract(bare, wrapped, 1)), strip(F.regexp_extract(bare, wrapped, 2)))
        out = F.when(bare.rlike(mark), parts).otherwise(out)
    return _rewritten(lines, out)
