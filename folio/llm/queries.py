"""Thin queries that apply the operators to the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, top_k, toxicity
from .common import bucket, table
from .decontaminate import find_leaks
from .html_text import extract_pages
from .mixing import mix_report
from .near_duplicates import near_report
from .url_filter import judge_urls
from .warc import round_trip

#: (host, path, verdict) of the listed URLs.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


QUALITY_CUT = 0.3


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page and its length.

    A null or empty page has an empty text of length 0; repeated rows come out each;
    an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_pages(pages).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and flag of each category of the chain for each document.

    Null and empty texts get the intercepts' probabilities; repeated rows the same
    ones; null labels are not learned from; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.predict(docs, toxicity.fit(docs, labels, ["toxic"])).drop("text")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document and the numbers of its links.

    A document without words is a class of its own; copies are linked; a null
    doc_id takes part; an empty table gives no rows.
    """
    return near_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, learned from two thirds of the labelled ones.

    ``und`` where the text is null or has no letter; ties go to the language that
    sorts first; a null doc_id is not held out; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, containment) of each document that holds a benchmark item.

    Null and empty texts and items hold nothing; items of equal text and repeated
    documents are reported each; empty tables give no rows.
    """
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.containment")


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20, its whole text being the query.

    Null texts and those without words are neither found nor find anything; ties go
    to the smaller doc_id; repeated documents count each; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return top_k.search(docs, queries)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for each document, learned from four fifths of the labelled ones.

    A null text counts as empty and is scored too; a null doc_id is not held out;
    repeated rows score alike; an empty table gives no rows.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fit(docs, labels.where(~held_out))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload, digest and kind of each page's record, read back from the archive.

    A null html is an empty payload; of equal payloads the smallest page_id is the
    response; an empty table gives no rows.
    """
    read = round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of each page's url.

    A null url, or one without ``://``, has an empty host and path and is allowed;
    repeated rows are judged alike; an empty table gives no rows.
    """
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each document, its source's size and target, and the words the mix takes of it.

    Null texts have size 0; a null source is a source; repeated rows are taken alike;
    an empty table gives no rows.
    """
    return mix_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_top_k_search": op8_top_k_search,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op5_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                          CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, p.payload_digest,
               CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_page THEN first_page END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op6_url_filter": """
        WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
             ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        u AS (SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)), '') AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        j AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
              FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS sk,
                          CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS draw FROM documents),
        s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY sk = 'n', sk) - 1) % 3 + 1] AS weight FROM s),
        f AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS fill FROM w),
        l AS (SELECT *, CAST((CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
                 - 2 * coalesce(sum(source_size) OVER (ORDER BY fill, sk = 'n', sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
                 / sum(weight) OVER (ORDER BY fill, sk = 'n', sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
        m AS (SELECT max(level) AS level FROM l),
        t AS (SELECT sk, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(m.level * weight, 0)) AS target FROM f, m),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate,
                     CAST('0x' || substr(md5(sk), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS start FROM t),
        c AS (SELECT *, CASE WHEN size < 8 THEN size ELSE 8 * length(bin(size)) + (size >> (length(bin(size)) - 4)) % 8 END AS class FROM d),
        k AS (SELECT *, rank() OVER (PARTITION BY sk, class ORDER BY draw) AS place, count(*) OVER (PARTITION BY sk ORDER BY class) AS upto,
                     count(*) OVER (PARTITION BY sk, class) AS n FROM c)
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN place <= floor(upto * (rate - floor(rate)) + start) - floor((upto - n) * (rate - floor(rate)) + start) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM k JOIN r ON k.sk = r.sk""",
}
