"""Recognition of page images through pluggable functions.

Models and image libraries are optional: ``render_fn(bytes) -> iterator of page
images`` and ``ocr_fn(bytes, prompt) -> text`` are injected; the defaults load
their libraries lazily, once per worker process.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import markdown_cleanup
from .files import assembled, extraction_metadata, is_pdf, with_content_flag

READ_PROMPT = "Transcribe all text of this image. Keep its structure, line breaks and formatting. Output the text only."
DESCRIBE_PROMPT = "Describe this image in detail."
#: Enhancement factors for handwriting, applied in this order; render scales.
ENHANCE = (("Contrast", 1.3), ("Sharpness", 1.5), ("Brightness", 1.05))
ZOOM, FALLBACK_DPI = 2.0, 200

OcrFunction = Callable[[bytes, str], str]

_LOADED: dict[str, Callable] = {}


def once_per_worker(load: Callable[[], Callable]) -> Callable:
    """A function that calls what ``load`` gives; that is loaded at the first call in each worker process.

    ``load`` is known by its module and name, so it should be a function of a module
    that workers can import; models and their device are chosen in there.
    """
    name = f"{load.__module__}.{load.__qualname__}"

    def call(*arguments):
        if name not in _LOADED:
            _LOADED[name] = load()
        return _LOADED[name](*arguments)

    return call


@cache
def _pdf_library():
    try:
        import fitz
    except ImportError:
        return None
    return fitz


def render_pdf(content: bytes) -> Iterator[bytes]:
    """PNG of each page, by the first PDF library that is installed."""
    fitz = _pdf_library()
    if fitz is not None:
        with fitz.open(stream=content, filetype="pdf") as doc:
            for page in doc:
                yield page.get_pixmap(matrix=fitz.Matrix(ZOOM, ZOOM)).tobytes("png")
        return
    from pdf2image import convert_from_bytes

    for image in convert_from_bytes(content, dpi=FALLBACK_DPI):
        held = io.BytesIO()
        image.convert("RGB").save(held, "PNG")
        yield held.getvalue()


def enhance(image: bytes) -> bytes:
    """Contrast, sharpness and brightness for handwriting; the original if that fails."""
    try:
        from PIL import Image, ImageEnhance

        picture = Image.open(io.BytesIO(image)).convert("RGB")
        for kind, factor in ENHANCE:
            picture = getattr(ImageEnhance, kind)(picture).enhance(factor)
        held = io.BytesIO()
        picture.save(held, "PNG")
        return held.getvalue()
    except Exception:  # any failure of an optional library keeps the image
        return image


def page_images(files: DataFrame, render_fn: Callable[[bytes], Iterable[bytes]] = render_pdf, max_pages: int | None = None) -> DataFrame:
    """(doc_id, page_no, image, pdf): PDFs page by page, images as one page.

    Bytes without a path are an image. Rendering stops at ``max_pages``; a PDF that
    cannot be read has no pages.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                number = 0
                try:
                    for image in render_fn(row.content) if row.pdf else [row.content]:
                        number += 1
                        if max_pages and number > max_pages:
                            break
                        yield pd.DataFrame({"doc_id": [row.doc_id], "page_no": [number], "image": [image], "pdf": [row.pdf]})
                except Exception:  # unreadable files give what was read so far
                    continue

    flagged = files.where("content is not null").select("doc_id", "content", F.coalesce(is_pdf(F.col("path")), F.lit(False)).alias("pdf"))
    return flagged.mapInPandas(pages, "doc_id long, page_no long, image binary, pdf boolean")


def recognise(pages: DataFrame, ocr_fn: OcrFunction, prompt: str | Column = READ_PROMPT, handwriting: bool = True) -> DataFrame:
    """``pages`` with (text, has_content, error) in place of the image: its text, cleaned; "" on failure."""

    @F.pandas_udf("struct<text:string,error:string>")
    def read(images: pd.Series, prompts: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for image, asked in zip(images, prompts, strict=True):
            try:
                texts.append(ocr_fn(enhance(image) if handwriting else image, asked) or "")
                errors.append(None)
            except Exception as problem:  # recognition never stops a job
                texts.append("")
                errors.append(str(problem))
        return pd.DataFrame({"text": texts, "error": errors})

    kept = [c for c in pages.columns if c != "image"]
    # Through a generator, so that what reads the text later never runs the model again.
    asked = read("image", prompt if isinstance(prompt, Column) else F.lit(prompt))
    ran = pages.withColumn("ran", asked).select(*kept, F.inline(F.array("ran")))
    return with_content_flag(ran.withColumn("text", markdown_cleanup(F.col("text")))).select(*kept, "text", "has_content", "error")


def describe(pages: DataFrame, ocr_fn: OcrFunction) -> DataFrame:
    """A description of each image, without enhancement."""
    return recognise(pages, ocr_fn, DESCRIBE_PROMPT, handwriting=False)


def extract(files: DataFrame, ocr_fn: OcrFunction, render_fn=render_pdf, max_pages: int | None = None, prompt: str | None = None) -> DataFrame:
    """One row per file: text, and metadata with source type, path, pages and counts.

    Each file is rendered once and each page recognised once; images are never
    shuffled. A prompt of one's own is used for images only, not for PDFs.
    """
    asked = F.when(F.col("pdf"), READ_PROMPT).otherwise(prompt or READ_PROMPT)
    read = recognise(page_images(files, render_fn, max_pages), ocr_fn, asked)
    texts = read.groupBy("doc_id").agg(F.when(F.max("pdf"), assembled()).otherwise(F.max("text")).alias("text"))
    out = files.drop("content").join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    found = extraction_metadata(F.col("text"), is_pdf(F.col("path")))
    fields = ["pages", "extraction_success", "char_count", "word_count"]
    whole = F.struct("source_type", F.col("path").alias("source_path"), *[found[f].alias(f) for f in fields])
    return out.select("doc_id", "path", "text", whole.alias("metadata"))


def extract_and_preprocess(files: DataFrame, ocr_fn: OcrFunction, **options) -> DataFrame:
    """Raw and preprocessed text of each file."""
    from ..functions.clean import preprocess

    return extract(files, ocr_fn, **options).select("doc_id", F.col("text").alias("raw"), preprocess(F.col("text")).alias("clean"))
