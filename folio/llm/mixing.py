"""Mixing sources to target weights.

Words per source give a target per source; target over size is the source's
repetition rate. A document is emitted ``floor(rate)`` times, plus one copy with a
chance of exactly the rate's fraction, drawn by hashes: of the document for its
place among documents of like size, and of the source for where its draw begins.

Independent draws miss the targets of small sources badly, so a source's draws are
systematic: its documents are counted through from small to large, and the running
count times the fraction, plus the source's offset, says by the integers it passes
how many documents of each size class are taken. In a class those of the smallest
hashes are taken. So a document's chance is the fraction, as the offset is evenly
spread, and the words taken come within about one document of the target. Classes
are an eighth of a power of two wide; sources times classes bound the plan's size.

Defined results: a null or empty text has size 0 and is emitted like any other.
A null source is a source of its own, sorted last. Rows that repeat a doc_id with
the same size draw alike; a null doc_id draws like the text "null". An empty table
gives an empty result. Extra columns pass through, but for one named ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free, others, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a draw, and how many of the first ones name its bucket.
DRAW_BITS, BUCKET_BITS = 60, 12


def words(text):
    """Runs of characters other than the six ASCII white-space ones."""
    marked = F.regexp_replace(text, WORD, "#")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_key(source):
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def drawn(doc_id):
    """A document's hash, evenly spread over ``DRAW_BITS`` bits."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def size_class(size):
    """Sizes below 8 alone, others by their highest four bits; larger sizes have larger classes."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size.cast("int")).otherwise(8 * bits + F.call_function("shiftright", size, bits - 4).cast("int") % 8)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, source key, size class and draw of each document."""
    sized = docs.select("doc_id", words(F.col("text")).alias("size"), source_key(F.col("source")).alias("source_key"))
    return sized.withColumns({"size_class": size_class(F.col("size")), "draw": drawn(F.col("doc_id"))})


def plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source_key, size_class, source_size, target, repeats, cut``: of a source's
    documents of a size class, those with a draw up to the cut get the extra copy.

    Weights repeat over the sources in code-point order, null last. Targets
    fill up by weight to ``share`` of all words and stop at ``most`` times
    their source's size: the level L with sum(min(most * size, L * weight)) =
    share * total, which resharing the excess until none is above ends in. Were
    the k sources that fill first capped, the others would share at some level;
    the level sought is the largest of these over all k.
    The windows without partition run over the table of sources.
    """
    stratum = ["source_key", "size_class"]
    counted = sizes.groupBy(*stratum).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    by_source = counted.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source_key") == "n", "source_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("fill", most * F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("fill", F.col("source_key") == "n", "source_key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    levels = ranked.withColumn(
        "level",
        (share * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.col("source_key").cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)
    targets = (
        levels.withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
        .select("source_key", "source_size", "target", F.floor(rate).cast("int").alias("repeats"), (rate - F.floor(rate)).alias("fraction"), offset.alias("offset"))
    )
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source_key").orderBy("size_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = lambda n: F.floor(n * F.col("fraction") + F.col("offset"))
    strata = (
        counted.join(targets, "source_key")
        .withColumn("ahead", ahead)
        .select(*stratum, "source_size", "target", "repeats", (passed(F.col("ahead") + F.col("n")) - passed(F.col("ahead"))).alias("take"))
    )
    # The cut of a stratum is its take-th smallest draw: first the bucket that holds it, then its place in there.
    bucket = F.shiftright("draw", DRAW_BITS - BUCKET_BITS).cast("int").alias("bucket")
    running = Window.partitionBy(*stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    holding = (
        sizes.groupBy(*stratum, bucket)
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .join(strata.where("take > 0").select(*stratum, "take"), stratum)
        .where("upto >= take and upto - n < take")
        .select(*stratum, "bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("place"))
    )
    place = F.row_number().over(Window.partitionBy(*stratum, "bucket").orderBy("draw"))
    cuts = sizes.select(*stratum, bucket, "draw").join(holding, [*stratum, "bucket"]).withColumn("at", place).where("at = place").select(*stratum, F.col("draw").alias("cut"))
    return strata.drop("take").join(cuts, stratum, "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))


def copies(draw: str = "draw", repeats: str = "repeats", cut: str = "cut"):
    """Copies of a document that has its draw and its stratum's plan in these columns."""
    return F.col(repeats) + (F.col(draw) <= F.col(cut)).cast("int")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes of each document."""
    sizes = saved(measured(docs), "mix-sizes")
    planned = saved(plan(sizes), "mix-plan")
    return sizes.join(planned, ["source_key", "size_class"]).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` once per copy, with ``copy`` from 0."""
    planned = saved(plan(saved(measured(docs), "mix-sizes")), "mix-plan")
    key, size, kind, draw, repeats, cut = (free(docs, name) for name in ("source_key", "size", "size_class", "draw", "repeats", "cut"))
    named = planned.select(*[F.col(was).alias(name) for was, name in (("source_key", key), ("size_class", kind), ("repeats", repeats), ("cut", cut))])
    n = copies(draw, repeats, cut)
    return (
        docs.withColumns({key: source_key(F.col("source")), size: words(F.col("text")), draw: drawn(F.col("doc_id"))})
        .withColumn(kind, size_class(F.col(size)))
        .join(named, [key, kind])
        .where(n > 0)
        .select(*columns(others(docs, ["copy"])), F.explode(F.sequence(F.lit(0), n - 1)).alias("copy"))
    )
