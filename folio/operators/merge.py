"""Merging lines into blocks and pages into texts.

Block merging depends only on a line and the one before it: gaps and islands by
``lag`` and a running sum, over one shuffle by document. The page merges are
folds that look at what they have gathered, so they fold an array per document.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.clean import clean_text, preprocess
from ..functions.patterns import java, lstrip, rstrip, strip
from .lines import markdown_lines, split_page_markers

#: Lines that a fold gathers before they join what it has.
AT_ONCE = 256


def _blocks(lines: DataFrame, boundary) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    before = lines.withColumn("before", F.lag("line").over(order))
    begins = F.when(F.col("before").isNull() | boundary(F.col("line"), F.col("before")), 1).otherwise(0)
    placed = before.withColumn("block_id", (F.sum(begins).over(order) - 1).cast("long"))
    gathered = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return (
        placed.groupBy("doc_id", "block_id")
        .agg(gathered.alias("rows"))
        .select(
            "doc_id",
            "block_id",
            F.array_join(F.transform("rows", lambda r: r["line"]), " ").alias("text"),
            F.transform("rows", lambda r: r["line_idx"]).alias("line_indices"),
        )
    )


def zero_shot_blocks(lines: DataFrame) -> DataFrame:
    """Blocks after page markers are split off; indices refer to the split lines."""
    return _blocks(split_page_markers(lines), lambda line, before: P.zero_shot_start(line) | ~P.zero_shot_continues(line, before))


def few_shot_blocks(lines: DataFrame) -> DataFrame:
    """Blocks with lines that stand alone; a block never begins by continuing one of those."""

    def boundary(line, before):
        return P.few_shot_standalone(line) | P.few_shot_standalone(before) | P.few_shot_start(line) | ~P.few_shot_continues(line, before)

    return _blocks(lines, boundary)


def single_blocks(lines: DataFrame) -> DataFrame:
    """Each line that is not blank as its own block."""
    return lines.where(strip(F.col("line")) != "").select("doc_id", F.col("line_idx").alias("block_id"), F.col("line").alias("text"), F.array("line_idx").alias("line_indices"))


def merge_page_breaks(lines: DataFrame, fix_duplicate: bool = False, look_ahead: int = 4) -> DataFrame:
    """Join lines that a page break cut apart, and drop page markers.

    By default a line that was joined across a marker comes out once more, as the
    rule that this follows counts joined lines only; ``fix_duplicate`` counts the
    markers too. One pass over each document's lines suffices, since every step
    moves forward.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    line = strip(F.col("line"))
    known = lines.select(
        "doc_id",
        "line_idx",
        line.alias("line"),
        ((line == "") | P.is_page_marker(line)).alias("skip"),
        P.any_of(line, P.LINE_OPENINGS).alias("opens"),
        P.line_type(line).alias("kind"),
        P.is_incomplete(line).alias("open"),
    )
    ahead = F.collect_list(F.struct("line", "skip", "opens", "kind", "open")).over(order.rowsBetween(1, look_ahead))
    seen = known.select("*", F.row_number().over(order).alias("at"), ahead.alias("ahead"))
    start = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("joined"), F.lit(0).alias("used"), F.lit(0).alias("n"))

    def step(state, following):
        clash = (F.col("kind") != "unknown") & (following["kind"] != "unknown") & (F.col("kind") != following["kind"])
        stop = following["opens"] | clash
        n = state["n"] + 1
        same = F.struct(state["done"].alias("done"), state["joined"].alias("joined"), state["used"].alias("used"), n.alias("n"))
        end = F.struct(F.lit(True).alias("done"), state["joined"].alias("joined"), state["used"].alias("used"), n.alias("n"))
        more = F.struct((~following["open"]).alias("done"), F.array_append(state["joined"], following["line"]).alias("joined"), n.alias("used"), n.alias("n"))
        return F.when(state["done"] | following["skip"], same).when(stop, end).otherwise(more)

    ran = seen.withColumn("ran", F.when(F.col("open") & ~F.col("skip"), F.aggregate("ahead", start, step)))
    joined = F.coalesce(F.col("ran.joined"), F.array().cast("array<string>"))
    passed = F.coalesce(F.col("ran.used"), F.lit(0)) if fix_duplicate else F.size(joined)
    steps = ran.select(
        "doc_id",
        "at",
        (F.col("at") + F.when(F.col("skip"), 0).otherwise(passed) + 1).alias("next"),
        F.when(~F.col("skip"), F.array_join(F.concat(F.array("line"), joined), " ")).alias("out"),
    )
    rows = F.array_sort(F.collect_list(F.struct("at", "next", "out")))
    none = F.array().cast("array<string>")

    def walk(state, row):
        out = F.when(row["out"].isNull(), state["out"]).otherwise(F.array_append(state["out"], row["out"]))
        return F.when(row["at"] == state["cursor"], F.struct(row["next"].alias("cursor"), out.alias("out"))).otherwise(state)

    def walk_some(state, some):
        # Each step copies what it adds to, so lines are gathered by the few hundred.
        ran = F.array(F.aggregate(some, F.struct(state["cursor"].alias("cursor"), none.alias("out")), walk))
        return F.transform(ran, lambda r: F.struct(r["cursor"].alias("cursor"), F.array_append(state["parts"], r["out"]).alias("parts")))[0]

    pieces = F.transform(F.sequence(F.lit(0), F.size("rows") - 1, F.lit(AT_ONCE)), lambda i: F.slice("rows", i + 1, AT_ONCE))
    origin = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<array<string>>").alias("parts"))
    merged = steps.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.flatten(F.aggregate(pieces, origin, walk_some)["parts"]).alias("lines"))
    out = merged.select("doc_id", F.posexplode("lines").alias("line_idx", "line"))
    return out.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "line")


def document_lines(docs: DataFrame, merge_breaks: bool = True, fix_duplicate: bool = False, remove_boxes: bool = True) -> DataFrame:
    """Lines of recognised Markdown, joined across page breaks if asked."""
    lines = markdown_lines(docs, remove_boxes)
    return merge_page_breaks(lines, fix_duplicate) if merge_breaks else lines


def fold_pages(pages: Column) -> Column:
    """An array of page texts merged where a page goes on in the next."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("current"))

    def step(state, page):
        joined = F.concat(rstrip(state["current"]), F.lit(" "), lstrip(page))
        closed = F.struct(F.array_append(state["out"], state["current"]).alias("out"), page.alias("current"))
        return (
            F.when(state["current"].isNull(), F.struct(state["out"].alias("out"), page.alias("current")))
            .when(P.continues_page(state["current"], page), F.struct(state["out"].alias("out"), joined.alias("current")))
            .otherwise(closed)
        )

    return F.aggregate(pages, start, step, lambda s: F.when(s["current"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["current"])))


def merge_qa_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, part, text): pages merged where an item is split across them."""
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    folded = gathered.select("doc_id", fold_pages(F.transform("pages", lambda p: p["text"])).alias("parts"))
    out = folded.select("doc_id", F.posexplode("parts").alias("part", "text"))
    return out.select("doc_id", F.col("part").cast("long").alias("part"), "text")


def preprocess_pages(docs: DataFrame, aggressive: bool = True) -> DataFrame:
    """Page-aware preprocessing: split at separators, merge split items, clean each part."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), java(P.PAGE_SEPARATOR)), strip), lambda s: s != "")
    exploded = docs.select("doc_id", F.posexplode_outer(fold_pages(parts)).alias("part", "text"))
    cleaned = exploded.select("doc_id", "part", preprocess(F.col("text"), aggressive).alias("text"))
    gathered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("part", "text"))))
    return cleaned.groupBy("doc_id").agg(F.array_join(F.transform(gathered, lambda p: p["text"]), "\n\n").alias("text"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts, which Spark has no function for."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def merge_similar_pages(pages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, part, text): pages merged where they resemble each other at the seam or go on.

    The comparison needs the text gathered so far, and the ratio has no native
    form, so each document's pages are folded in Arrow batches.
    """

    def goes_on(current: str, page: str) -> bool:
        # The loose signs are cheap and decide most pages; the ratio comes last.
        if current.endswith(("-", "contin", "cont.")) or not current.endswith((".", "!", "?")) or page[:1].islower():
            return True
        return SequenceMatcher(None, current[-200:], page[:200]).ratio() > threshold

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[str] = []
        for page in rows.sort_values("page_no")["text"].fillna(""):
            if out and goes_on(out[-1], page):
                out[-1] = out[-1].rstrip("-") + ("" if out[-1].endswith("-") else " ") + page
            else:
                out.append(page)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "part": range(len(out)), "text": out})

    return pages.select("doc_id", "page_no", "text").groupBy("doc_id").applyInPandas(fold, "doc_id long, part long, text string")


def process_pages(pages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Clean all pages, then merge them by similarity."""
    return merge_similar_pages(pages.withColumn("text", clean_text(F.col("text"))), threshold)
