"""Scans of text, PDF and image files, and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import count_chars, strip, token_count
from ..functions.predicates import SEPARATOR_COUNT


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def source_type(path: Column, content: Column | None = None) -> Column:
    """pdf or image by the path; without one pil_image if there are bytes of an image, else unknown."""
    held = F.lit(False) if content is None else content.isNotNull()
    return F.when(path.isNull(), F.when(held, "pil_image").otherwise("unknown")).when(is_pdf(path), "pdf").otherwise("image")


def in_memory(images: DataFrame) -> DataFrame:
    """Rows as ``read_files`` gives them of ``doc_id, content``: bytes of images that have no path."""
    path = F.lit(None).cast("string")
    return images.select(path.alias("path"), "doc_id", source_type(path, F.col("content")).alias("source_type"), "content")


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole UTF-8 text files: path, doc_id (a hash of the path), name and text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), stem(F.col("path")).alias("name"), "text")


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Binary files with their source type; ``source_ord`` keeps the order of a list of paths."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    out = files.select("path", F.xxhash64("path").alias("doc_id"), source_type(F.col("path")).alias("source_type"), "content")
    if isinstance(path, str):
        return out
    return in_order(spark, out, path)


def in_order(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """Add ``source_ord``: the place in ``paths`` of a file, or of the folder it lies in (a name that is given twice counts first)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    first: dict[str, int] = {}
    for i, one in enumerate(paths):
        named = jvm.org.apache.hadoop.fs.Path(one)
        first.setdefault(named.getFileSystem(conf).makeQualified(named).toString(), i)
    given = F.broadcast(spark.createDataFrame(list(first.items()), "given string, place int"))
    own, folder = given.toDF("own", "own_place"), given.toDF("folder", "folder_place")
    placed = files.join(own, files["path"] == own["own"], "left").join(folder, F.regexp_extract("path", "^(.*)/[^/]*$", 1) == folder["folder"], "left")
    return placed.select(*files.columns, F.coalesce("own_place", "folder_place").alias("source_ord"))


def assembled() -> Column:
    """Aggregate of ``page_no, text``: pages that have content under their separators, in page order."""
    shown = F.when(strip(F.col("text")) != "", F.struct("page_no", "text"))
    line = lambda r: F.concat(F.lit("--- PAGE "), r["page_no"].cast("string"), F.lit(" ---\n"), strip(r["text"]))
    return F.array_join(F.transform(F.array_sort(F.collect_list(shown)), line), "\n\n")


def assemble(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document, assembled."""
    return pages.groupBy("doc_id").agg(assembled().alias("text"))


def with_content_flag(pages: DataFrame) -> DataFrame:
    return pages.withColumn("has_content", F.coalesce(strip(F.col("text")) != "", F.lit(False)))


def first_pages(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first pages; none or 0 keeps all."""
    return pages.where(F.col("page_no") <= max_pages) if max_pages else pages


def extraction_metadata(text: Column, paged: Column | bool = True) -> Column:
    """pages, extraction_success, char_count and word_count of an extracted text."""
    counted = F.greatest(F.size(F.regexp_extract_all(text, F.lit(SEPARATOR_COUNT), F.lit(0))), F.lit(1)).cast("long")
    counted = F.when(paged if isinstance(paged, Column) else F.lit(paged), counted).otherwise(F.lit(1).cast("long"))
    return F.struct(
        counted.alias("pages"), (strip(text) != "").alias("extraction_success"), count_chars(text).alias("char_count"), token_count(text).alias("word_count")
    )
