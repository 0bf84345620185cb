"""Queries over the standard tables, and the same rows in DuckDB SQL.

``conversations`` stands in for scanned exams: roles become question, answer and
page marks, commas become line breaks, and some turns carry page marks inside or
lines of every kind that the rules know. Both engines build these lines alike.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TextOptions
from ..functions import clean
from ..functions import predicates as P
from ..functions.patterns import count_chars, starts_lower, strip, token_count
from ..operators import label, lines, merge, report, segments
from ..sinks import files as sinks
from ..sources import files as sources
from ..sources import ocr
from . import pipelines

EXTRA = [
    "Name: A. Student", "5 of 10", "12/11/2024 morning", "Chapter 1 begins", "(a) first part", "1) Particles move", "2. What is heat",
    "so it is. Q2. What follows", "this is so Ans: yes it is", "the answer is clear", "DOMS", "x x x", "Long Answer type Questions", "Section A:",
    "Fig 3 shows a cell", "12", ".....", "Application Layer: queues", "Q What now", "Solution: five", "A1. yes", "Due Date: soon", "www.example.com",
    "23BEC1025 roll", "A short one", "What is it that happened here?", "Questionnaire of", "the page number", "Page No. 7", "Total Marks 20",
]


def exam_sql(newline: str, explode: str) -> str:
    """The exam lines in either dialect."""
    extra = ", ".join(f"{newline}, '{line}'" for line in EXTRA)
    return f"""
    b AS (SELECT conv_id, turn, role,
            CASE WHEN turn % 3 = 2 THEN replace(text, ', ', concat(',', {newline}, 'Page ', turn + 1, {newline}))
                 WHEN turn % 4 = 0 AND text LIKE '%.' THEN concat(substr(text, 1, length(text) - 1), '?')
                 ELSE replace(text, ', ', concat(',', {newline})) END AS body FROM conversations),
    t AS (SELECT conv_id, turn,
            CASE WHEN role = 'user' THEN concat('Q', turn + 1, ': ', body) WHEN role = 'assistant' THEN concat('Ans: ', body)
                 ELSE concat('--- PAGE ', turn + 1, ' --- ', body) END AS tx FROM b),
    x AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN concat(tx, {extra}) ELSE tx END AS tx FROM t),
    {explode},
    exam AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS BIGINT) AS line_idx,
               trim(ln) AS line FROM e WHERE trim(ln) <> '')"""


SPARK_EXAM = exam_sql("char(10)", "e AS (SELECT conv_id, turn, k, ln FROM x LATERAL VIEW posexplode(split(tx, char(10))) z AS k, ln)")
DUCK_EXAM = exam_sql("chr(10)", "e AS (SELECT conv_id, turn, unnest(string_split(tx, chr(10))) AS ln, unnest(range(len(string_split(tx, chr(10))))) AS k FROM x)")
PAGES_SQL = """
    SELECT conv_id AS doc_id, CAST(turn + 1 AS BIGINT) AS page_no,
           CASE WHEN turn % 2 = 0 AND text LIKE '%,%' THEN regexp_extract(text, '(?s)^(.*,)', 1)
                ELSE concat(lower(substr(text, 1, 1)), substr(text, 2)) END AS text FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def exam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = SPARK_EXAM.replace("FROM conversations", "FROM {conversations}")
    return spark.sql(f"WITH {source} SELECT * FROM exam", conversations=table(spark, sf_dir, "conversations"))


def exam_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, sf_dir, "conversations"))


def fake_reply(texts: list[str]) -> list[str]:
    """Stands in for a model: the label depends on the length of the text."""
    return [("Question.", "an answer", "metadata", "hard to say")[len(t) % 4] for t in texts]


def joined(column: str):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",").alias(column)


def on_exam(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(exam_lines(spark, sf_dir))


def on_documents(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(documents(spark, sf_dir))


def rewritten(rewrite, before=lambda text: text):
    return on_documents(lambda docs: docs.select("doc_id", rewrite(before(F.col("text"))).alias("text")))


def flagged(**columns):
    return on_exam(lambda found: found.select("doc_id", "line_idx", *[make(F.col("line")).alias(name) for name, make in columns.items()]))


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources.assemble(exam_pages(spark, sf_dir))
    return texts.select("doc_id", sources.extraction_metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text"))
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text")
    return pages.union(docs).select("id", "kind", clean.markdown_cleanup(F.col("text")).alias("text"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    reply = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("<think>an answer?</think> "), F.col("role"), F.lit(" question")))
        .when(F.col("turn") % 5 == 1, F.lit(" Answer "))
        .when(F.col("turn") % 5 == 2, F.lit("metadata, I think, not an answer"))
        .when(F.col("turn") % 5 == 3, F.lit("Question about an answer"))
        .otherwise(text)
    )
    parsed = label.parse_zero_shot_reply(F.col("reply"))
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", reply.alias("reply"))
        .select("conv_id", "turn", label.parse_few_shot_reply(F.col("reply")).alias("few_shot"), parsed["label"].alias("zero_shot"), parsed["confidence"].alias("confidence"))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    few, zero = label.few_shot_messages(F.col("text")), label.zero_shot_messages(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", few.alias("few"), zero.alias("zero"))
    flat = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\n")
    return rows.select("conv_id", "turn", F.size("few").cast("long").alias("n_few"), F.md5(flat("few").cast("binary")).alias("few_md5"), F.md5(flat("zero").cast("binary")).alias("zero_md5"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = exam_pages(spark, sf_dir)
    following = pages.select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.col("text").alias("following"))
    pairs = pages.join(following, ["doc_id", "page_no"])
    ratio = merge.similarity(F.substring("text", -200, 200), F.substring("following", 1, 200))
    return pairs.select("doc_id", "page_no", "text", "following", ratio.alias("ratio")).select(
        "doc_id", "page_no", "ratio", P.resembles_or_continues(F.col("text"), F.col("following"), F.col("ratio")).alias("merges"), P.continues_page(F.col("text"), F.col("following")).alias("goes_on")
    )


def separated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.preprocess_pages(sources.assemble(exam_pages(spark, sf_dir)))


def annotated(text):
    return F.concat(F.lit("<|ref|>a<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>  "), text, F.lit("\n\n\n\n<|grounding|>end"))


def broken(text):
    return F.replace(F.concat(F.lit("Teh tbe  wiht WHCIH that   is, i  am and I have. "), text), F.lit(" the "), F.lit(" teh "))


def spaced(text):
    return F.replace(text, F.lit(", "), F.lit(' ,"x "'))


def hyphened(text):
    return F.replace(text, F.lit("tion "), F.lit("ti-\n on\n\n\n"))


def full_report(found: DataFrame) -> DataFrame:
    """Every entry of every list, as one line each, in order."""
    made = pipelines.classify_documents(found)
    line = lambda e: F.concat_ws("|", e["text"], e["confidence"].cast("string"), e["reasoning"], F.array_join(e["original_line_indices"].cast("array<string>"), ","))
    lists = [F.array_join(F.transform(name, line), "\n").alias(name) for name in report.LISTS]
    return made.select("doc_id", *lists, F.col("statistics.total_merged_blocks").alias("total_merged_blocks"), "model", "method")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share, deleted when the JVM ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folio-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{named.rstrip('/')}/folio/{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sources.assemble(exam_pages(spark, sf_dir))
    return texts.select("doc_id", F.concat(F.lit("exam "), F.col("doc_id").cast("string")).alias("name"), "text")


def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_texts(assembled(spark, sf_dir), path)
    return spark.read.schema("name string, text string").json(path)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file for each document, and read as whole files."""
    path = scratch(spark)
    sinks.write_texts(assembled(spark, sf_dir), path, folders=True)
    read = sources.read_texts(spark, f"{path}/*/*.txt")
    return read.select(F.url_decode(F.regexp_extract("path", "name=([^/]*)/", 1)).alias("name"), F.col("name").startswith("part-").alias("is_part"), F.regexp_replace("text", r"\n\z", "").alias("text"))


def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_reports(pipelines.classify_documents(exam_lines(spark, sf_dir)), path)
    entries = [spark.read.schema("doc_id long, at long, text string").json(f"{path}/{name}").withColumn("kind", F.lit(name)) for name in ("questions", "answers")]
    return entries[0].union(entries[1])


def written_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    pipelines.text_to_jsonl(documents(spark, sf_dir).select("doc_id", annotated(F.col("text")).alias("text")), path, TextOptions(merge_page_breaks=False))
    return spark.read.schema("text string, label string").json(path)


def written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_csv(segments.segments(documents(spark, sf_dir), cleaned=True), path)
    kinds = "document_id long, id long, text string, char_count long, word_count long, likely_type string"
    return spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def split_pages(content: bytes) -> list[bytes]:
    """Stands in for a PDF library: pages between form feeds."""
    return content.split(b"\f")


def read_page(image: bytes, prompt: str) -> str:
    """Stands in for a recognition model: the image is its text, in bold."""
    return f"# {image.decode()}"


def recognised(max_pages: int | None):
    """Exams as PDFs, images and bytes without a path, through rendering, recognition and assembly."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = exam_pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
        texts = F.transform("pages", lambda r: r["text"])
        pdf = F.col("doc_id") % 3 == 0
        path = F.when(pdf, F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".PDF"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".png")))
        content = F.encode(F.when(pdf, F.array_join(texts, "\f")).otherwise(texts[0]), "UTF-8")
        held = pages.select(path.alias("path"), "doc_id", content.alias("content"))
        files = held.select("path", "doc_id", sources.source_type(F.col("path"), F.col("content")).alias("source_type"), "content")
        found = ocr.extract(files, read_page, split_pages, max_pages)
        return found.select("doc_id", "path", "text", "metadata.source_type", "metadata.pages", "metadata.extraction_success", "metadata.char_count", "metadata.word_count")

    return run


def summaries(found: DataFrame) -> DataFrame:
    made = report.summary(pipelines.classify_documents(found))
    return made.select("doc_id", "total_original_lines", "total_merged_blocks", "questions_count", *[F.array_join(f"sample_{n}", "\n").alias(f"sample_{n}") for n in ("questions", "answers")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_lines": on_documents(lines.to_lines),
    "markdown_lines": on_documents(lambda docs: lines.markdown_lines(docs.select("doc_id", annotated(F.col("text")).alias("text")))),
    "line_flags": flagged(is_marker=P.is_page_marker, is_incomplete=P.is_incomplete, kind=P.line_type),
    "pattern_labels": flagged(zero_shot=P.zero_shot_label, few_shot=P.few_shot_label, is_short=P.too_short),
    "block_flags": flagged(zero_shot_start=P.zero_shot_start, few_shot_start=P.few_shot_start, standalone=P.few_shot_standalone, starts_lower=starts_lower),
    "split_page_markers": on_exam(lambda found: lines.split_page_markers(found).drop("source_line_idx")),
    "split_qa_markers": on_exam(lambda found: lines.split_qa_markers(found).drop("source_line_idx")),
    "zs_blocks": on_exam(lambda found: merge.zero_shot_blocks(found).select("doc_id", "block_id", "text", joined("line_indices"))),
    "fs_blocks": on_exam(lambda found: merge.few_shot_blocks(lines.split_qa_markers(found)).select("doc_id", "block_id", "text", joined("line_indices"))),
    "zs_report_stats": on_exam(lambda found: report.statistics(pipelines.classify(found), found)),
    "fs_report_stats": on_exam(lambda found: report.statistics(pipelines.classify(found, "few-shot"), found)),
    "zs_unmerged_stats": on_exam(lambda found: report.statistics(pipelines.classify(found, merge_lines=False), found)),
    "zs_model_labels": on_exam(lambda found: pipelines.classify(found, reply_fn=fake_reply).select("doc_id", "block_id", "label", "confidence", "reasoning")),
    "fs_model_labels": on_exam(lambda found: pipelines.classify(found, "few-shot", reply_fn=fake_reply).select("doc_id", "block_id", "label", "confidence", "reasoning")),
    "document_reports": on_exam(full_report),
    "top_questions": on_exam(lambda found: report.top_entries(pipelines.classify(found))),
    "page_break_merge": on_exam(merge.merge_page_breaks),
    "page_break_merge_fixed": on_exam(lambda found: merge.merge_page_breaks(found, fix_duplicate=True)),
    "line_stats": on_exam(segments.line_statistics),
    "length_profile": on_documents(lambda docs: segments.length_profile(lines.to_lines(docs))),
    "jsonl_rows": on_documents(lambda docs: sinks.training_rows(lines.to_lines(docs))),
    "markdown_cleanup": markdown,
    "strip_annotations": rewritten(clean.strip_annotations, annotated),
    "minimal_clean": rewritten(clean.minimal_clean, annotated),
    "clean_text": rewritten(clean.clean_text, annotated),
    "fix_line_breaks": rewritten(clean.fix_line_breaks, hyphened),
    "fix_spacing": rewritten(clean.fix_spacing, spaced),
    "word_corrections": rewritten(clean.word_corrections, broken),
    "character_corrections": rewritten(clean.character_corrections),
    "remove_noise": rewritten(clean.remove_noise),
    "capitalize": rewritten(lambda text: clean.capitalize_sentences(text, one_letter=True)),  # as its SQL has it
    "normalize_unicode": rewritten(clean.normalize_unicode),
    "preprocess": rewritten(lambda text: clean.preprocess(text, True)),
    "sentences": on_documents(lambda docs: docs.select("doc_id", F.posexplode(clean.split_sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")),
    "segments": on_documents(lambda docs: segments.segments(docs, cleaned=True)),
    "preprocessed_segments": on_documents(segments.segments),
    "chunks": on_documents(segments.chunks),
    "doc_metadata": doc_metadata,
    "qa_page_merge": lambda spark, sf_dir: merge.merge_qa_pages(exam_pages(spark, sf_dir)),
    "similarity_page_merge": lambda spark, sf_dir: merge.process_pages(exam_pages(spark, sf_dir)),
    "page_similarity": similarities,
    "page_aware_preprocess": separated_pages,
    "written_texts": written_texts,
    "text_files": text_files,
    "written_reports": written_reports,
    "written_jsonl": written_jsonl,
    "written_csv": written_csv,
    "recognised_files": recognised(None),
    "recognised_first_pages": recognised(2),
    "report_summaries": on_exam(summaries),
    "recognised_line_counts": on_documents(lambda docs: pipelines.lines_and_statistics(docs.select("doc_id", annotated(F.col("text")).alias("text")), merge_breaks=False)[1]),
    "chat_messages": messages,
    "parse_reply": replies,
    "text_shape": on_documents(lambda docs: docs.select("doc_id", count_chars(F.col("text")).alias("chars"), token_count(F.col("text")).alias("tokens"), report.shortened(strip(F.col("text"))).alias("shown"))),
}

# ---------------------------------------------------------------- DuckDB side


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(column: str, rules: list[str], ignore_case: bool = True) -> str:
    flags = "(?i)" if ignore_case else ""
    rules = [r.replace("]*+", "]*") for r in rules]  # DuckDB never steps back
    return f"regexp_matches({column}, {quoted(flags + '|'.join(f'(?:{r})' for r in rules))})"


def stripped(expression: str) -> str:
    return f"regexp_replace({expression}, '^\\s+|\\s+$', '', 'g')"


def labelled(column: str, rules: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {found(column, own)} THEN '{name}'" for name, own in rules.items()) + " END"


def regexes(expression: str, *steps: tuple[str, str]) -> str:
    for rule, by in steps:
        expression = f"regexp_replace({expression}, {quoted(rule)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    return expression


def kind_sql(column: str) -> str:
    return f"CASE WHEN {found(column, P.QUESTION_OPENINGS)} OR contains({column}, '?') THEN 'question' WHEN {found(column, P.ANSWER_OPENINGS)} THEN 'answer' ELSE 'unknown' END"


def marker_sql(column: str) -> str:
    parts = [found(f"lower({column})", [r"^page\s*\d+"]), f"(regexp_matches({column}, '^\\d+$') AND length({column}) <= 4)"]
    parts += [found(column, [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}", r"^[-=_.]{3,}$"], False)]
    parts += [f"contains(lower({column}), {quoted(p)})" for p in P.FURNITURE]
    parts += [found(f"lower({column})", [r"^(chapter|unit|section|part|appendix)\s*\d*[:\s]"])]
    return "(" + " OR ".join(parts) + ")"


def incomplete_sql(column: str) -> str:
    last = f"regexp_replace(regexp_extract(lower({column}), '(\\S+)$', 1), '[.,;:]+$', '')"
    words = ", ".join(map(quoted, P.OPEN_ENDINGS))
    return f"""CASE WHEN {column} = '' THEN false WHEN regexp_matches({column}, '[.!?":)\\]]$') THEN false ELSE {last} IN ({words}) OR ends_with({column}, ',') END"""


LOWER = r"regexp_matches(line, '^\p{Ll}')"
ZS_START = found("line", P.ZERO_SHOT_STARTS)
FS_START = f"({found('line', P.FEW_SHOT_STARTS)} OR (ends_with(line, '?') AND length(line) > 20))"


def alone_sql(column: str) -> str:
    return f"((length({column}) < 12 AND NOT regexp_matches({column}, '[?,]$')) OR {found(column, P.STANDALONE)})"


ZS_GOES_ON = rf"""CASE WHEN regexp_matches(before, '(?i)^---\s*PAGE\s*\d+\s*---$') THEN false
    WHEN regexp_matches(before, '[.?!]$') THEN length(line) < 50 AND {LOWER} WHEN {LOWER} THEN true
    ELSE length(line) < 30 AND NOT {ZS_START} END"""
FS_GOES_ON = rf"""CASE WHEN {LOWER} THEN true WHEN regexp_matches(before, '[.!?]$') THEN false
    ELSE regexp_replace(regexp_extract(lower(line), '^(\S+)', 1), '[.,;:]+$', '') IN ({", ".join(map(quoted, P.CONTINUATIONS))}) END"""


def renumbered(parts: str) -> str:
    return f"""p AS (SELECT doc_id, line_idx, unnest({parts}) AS ln, unnest(range(len({parts}))) AS k FROM exam),
    split AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, k) - 1 AS BIGINT) AS line_idx, ln AS line FROM p)"""


MARKED = r"(?i)^(---\s*PAGE\s*\d+\s*---)\s*(.+)$"
PAGE_SPLIT = renumbered(f"CASE WHEN regexp_matches(line, '{MARKED}') THEN [regexp_extract(line, '{MARKED}', 1), trim(regexp_extract(line, '{MARKED}', 2))] ELSE [line] END")


def qa_parts() -> str:
    out = "CASE "
    for rule in lines.SPLITS:
        whole = f"(?is)^(.*?)({rule}.*)$"
        cut = f"[trim(regexp_extract(line, {quoted(whole)}, 1)), trim(regexp_extract(line, {quoted(whole)}, 2))]"
        out += f"WHEN {found('line', [rule])} THEN list_filter({cut}, lambda s: s <> '') "
    return out + "ELSE [line] END"


QA_SPLIT = renumbered(qa_parts())


def blocks_sql(split: str, boundary: str) -> str:
    return f"""{DUCK_EXAM}, {split},
    g AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_idx) AS before FROM split),
    s AS (SELECT *, CASE WHEN before IS NULL OR {boundary} THEN 1 ELSE 0 END AS begins FROM g),
    n AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS BIGINT) AS block_id FROM s),
    blocks AS (SELECT doc_id, block_id, string_agg(line, ' ' ORDER BY line_idx) AS text,
                 string_agg(CAST(line_idx AS VARCHAR), ',' ORDER BY line_idx) AS line_indices FROM n GROUP BY 1, 2)"""


ZS_BLOCKS = blocks_sql(PAGE_SPLIT, f"{ZS_START} OR NOT ({ZS_GOES_ON})")
FS_BLOCKS = blocks_sql(QA_SPLIT, f"{alone_sql('line')} OR {alone_sql('before')} OR {FS_START} OR NOT ({FS_GOES_ON})")
SINGLE = f"{DUCK_EXAM}, blocks AS (SELECT doc_id, line_idx AS block_id, line AS text FROM exam)"


def label_sql(rules: dict[str, list[str]]) -> str:
    return f"labels AS (SELECT *, length(trim(text)) < 2 AS short, CASE WHEN length(trim(text)) >= 2 THEN {labelled('text', rules)} END AS pattern FROM blocks)"


def stats_sql(blocks: str, rules: dict[str, list[str]]) -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (coalesce(pattern, 'unknown') = '{own}') AS BIGINT) AS {name}_count" for name, own in report.LISTS.items())
    names = ", ".join(f"coalesce({n}, 0) AS {n}" for n in ["total_merged_blocks", *[f"{x}_count" for x in report.LISTS]])
    return f"""WITH {blocks}, {label_sql(rules)},
    c AS (SELECT doc_id, count(*) AS total_merged_blocks, {counts} FROM labels GROUP BY 1),
    totals AS (SELECT doc_id, count(*) AS total_original_lines FROM exam GROUP BY 1)
    SELECT totals.doc_id, total_original_lines, {names} FROM totals LEFT JOIN c ON totals.doc_id = c.doc_id"""


def model_sql(blocks: str, rules: dict[str, list[str]], few: bool) -> str:
    replied = "['question', 'answer', 'metadata', 'unknown'][length(text) % 4 + 1]"
    sure = "CAST(CASE WHEN length(text) % 4 = 3 THEN 0.3 ELSE 0.9 END AS DOUBLE)" if few else "CAST(CASE WHEN length(text) % 4 = 3 THEN 0.5 ELSE 0.9 END AS DOUBLE)"
    why = f"'LLM classified as ' || {replied}" if few else f"CASE WHEN length(text) % 4 = 3 THEN 'LLM response unclear: hard to say' ELSE 'LLM classified as ' || {replied} END"
    return f"""WITH {blocks}, {label_sql(rules)}
    SELECT doc_id, block_id, CASE WHEN short THEN 'unknown' ELSE coalesce(pattern, {replied}) END AS label,
      CASE WHEN short THEN CAST(0 AS DOUBLE) WHEN pattern IS NOT NULL THEN CAST(0.98 AS DOUBLE) ELSE {sure} END AS confidence,
      CASE WHEN short THEN 'Text too short or empty' WHEN pattern IS NOT NULL THEN 'Pattern matched: ' || pattern ELSE {why} END AS reasoning FROM labels"""


def doc_lines_sql(text: str = "text", each: str = stripped("s")) -> str:
    return f"""l AS (SELECT doc_id, list_filter(list_transform(string_split({text}, chr(10)), lambda s: {each}), lambda s: s <> '') AS a FROM documents),
    lines AS (SELECT doc_id, CAST(unnest(range(len(a))) AS BIGINT) AS line_idx, unnest(a) AS line FROM l)"""


ANNOTATED = "('<|ref|>a<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || '<|grounding|>end')"
BROKEN = "replace('Teh tbe  wiht WHCIH that   is, i  am and I have. ' || text, ' the ', ' teh ')"


def unannotated(text: str) -> str:
    return regexes(text, (r"<\|ref\|>.*?<\|/ref\|><\|det\|>\[\[.*?\]\]<\|/det\|>\s*", ""), (r"<\|[^|]+\|>", ""))


def minimal(text: str) -> str:
    return stripped(regexes(f"replace({text}, chr(0), '')", (" +", " "), (r"\n{3,}", "\n\n")))


def markdown_sql(text: str) -> str:
    return stripped(regexes(f"coalesce({text}, '')", *[("(?m)" * multiline + rule, by) for rule, by, multiline in clean.MARKDOWN]))


SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
    sentences AS (SELECT doc_id, CAST(unnest(range(len(a))) AS BIGINT) AS pos, unnest(a) AS sentence FROM s)"""
TOKENS = "CAST(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')) AS BIGINT)"
REPLY = """r AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '<think>an answer?</think> ' || role || ' question' WHEN 1 THEN ' Answer '
      WHEN 2 THEN 'metadata, I think, not an answer' WHEN 3 THEN 'Question about an answer' ELSE text END AS reply FROM conversations),
    b AS (SELECT *, lower(trim(reply)) AS low, trim(regexp_replace(lower(trim(reply)), '(?s)<think>.*?</think>', '', 'g')) AS bare FROM r)"""


def contained(column: str) -> str:
    return f"CASE WHEN contains({column}, 'question') THEN 'question' WHEN contains({column}, 'answer') THEN 'answer' WHEN contains({column}, 'metadata') THEN 'metadata' ELSE 'unknown' END"


def examples_sql() -> str:
    said = "".join(f"user=Text: '{text}'\nassistant={name}\n" for text, name in label.EXAMPLES)
    return f"{quoted(f'system={label.INSTRUCTION}{chr(10)}{said}user=Text: ' + chr(39))} || text || ''''"


def lone(letter: str, by: str, text: str) -> str:
    """A letter between characters that are no word's; twice, as neighbours share them."""
    step = (rf"(^|[^\p{{L}}\p{{N}}_]){letter}($|[^\p{{L}}\p{{N}}_])", rf"\1{by}\2")
    return regexes(text, step, step)


NOISE = r"""regexp_matches(c, '[^\p{L}\p{N}_\s.,!?;:''"()-]') AND NOT regexp_matches(coalesce(a[i - 1], ''), '[\p{L}\p{N}_]') AND NOT regexp_matches(coalesce(a[i + 1], ''), '[\p{L}\p{N}_]')"""
LINE_LIST = f"list_filter(list_transform(string_split({{0}}, chr(10)), lambda s: {stripped('s')}), lambda s: s <> '')"


def page_breaks_sql(passed: str) -> str:
    """The walk over lines: each open line looks up to four lines ahead; then a cursor goes from line to line."""
    taken = "NOT f.skip AND NOT f.opens AND NOT (w.kind <> 'unknown' AND f.kind <> 'unknown' AND w.kind <> f.kind)"
    return f"""WITH RECURSIVE {DUCK_EXAM},
    k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS pos, line, line = '' OR {marker_sql('line')} AS skip,
                 {found('line', P.LINE_OPENINGS)} AS opens, {kind_sql('line')} AS kind, {incomplete_sql('line')} AS unfinished FROM exam),
    w AS (SELECT doc_id, pos, kind, line AS text, 0 AS n, 0 AS used, 0 AS joined, skip, skip OR NOT unfinished AS done FROM k
          UNION ALL
          SELECT w.doc_id, w.pos, w.kind, CASE WHEN {taken} THEN w.text || ' ' || f.line ELSE w.text END, w.n + 1, CASE WHEN {taken} THEN w.n + 1 ELSE w.used END,
                 w.joined + CASE WHEN {taken} THEN 1 ELSE 0 END, w.skip, CASE WHEN f.skip THEN false WHEN {taken} THEN NOT f.unfinished ELSE true END
          FROM w JOIN k f ON f.doc_id = w.doc_id AND f.pos = w.pos + w.n + 1 WHERE NOT w.done AND w.n < 4),
    s AS (SELECT doc_id, pos, skip, arg_max(text, n) AS text, pos + 1 + arg_max({passed}, n) AS following FROM w GROUP BY 1, 2, 3),
    c AS (SELECT DISTINCT doc_id, CAST(1 AS BIGINT) AS pos FROM k UNION ALL SELECT s.doc_id, s.following FROM c JOIN s ON s.doc_id = c.doc_id AND s.pos = c.pos)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s.pos) - 1 AS BIGINT) AS line_idx, text AS line FROM c JOIN s USING (doc_id, pos) WHERE NOT skip"""


def pages_merged_sql() -> str:
    last, first = f"{LINE_LIST.format('f.current')}[-1]", f"{LINE_LIST.format('o.text')}[1]"
    return f"""WITH RECURSIVE pg AS ({PAGES_SQL}), o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i, text FROM pg),
    f AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS part, text AS current FROM o WHERE i = 1
          UNION ALL
          SELECT doc_id, i, part + CASE WHEN goes_on THEN 0 ELSE 1 END,
                 CASE WHEN goes_on THEN {regexes('current', (r'\s+$', ''))} || ' ' || {regexes('text', (r'^\s+', ''))} ELSE text END
          FROM (SELECT *, coalesce({incomplete_sql('last')} AND NOT {found('first', P.PAGE_OPENINGS)} AND regexp_matches(first, '^\\p{{Ll}}')
                                   AND {kind_sql('last')} || '>' || {kind_sql('first')} NOT IN ('question>answer', 'answer>question'), false) AS goes_on
                FROM (SELECT o.doc_id, o.i, f.part, f.current, o.text, {last} AS last, {first} AS first FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)))
    SELECT doc_id, part, arg_max(current, i) AS text FROM f GROUP BY 1, 2"""


ASSEMBLED = f"""pg AS ({PAGES_SQL}),
    d AS (SELECT doc_id, coalesce(string_agg('--- PAGE ' || page_no || ' ---' || chr(10) || {stripped('text')}, chr(10) || chr(10) ORDER BY page_no) FILTER ({stripped('text')} <> ''), '') AS t FROM pg GROUP BY 1)"""


def recognised_sql(max_pages: str) -> str:
    return f"""WITH pg AS ({PAGES_SQL}), r AS (SELECT doc_id, page_no, {markdown_sql("'# ' || text")} AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS i FROM pg),
    n AS (SELECT doc_id, doc_id % 3 AS kind, string_agg('--- PAGE ' || i || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY i) FILTER (text <> '' AND i <= {max_pages}) AS pdf, max(text) FILTER (i = 1) AS image,
                 count(*) FILTER (text <> '' AND i <= {max_pages}) AS held FROM r GROUP BY 1),
    t AS (SELECT doc_id, kind, held, coalesce(CASE WHEN kind = 0 THEN pdf ELSE image END, '') AS text FROM n)
    SELECT doc_id, CASE kind WHEN 0 THEN 'in/' || doc_id || '.PDF' WHEN 1 THEN 'in/' || doc_id || '.png' END AS path, text,
           ['pdf', 'image', 'pil_image'][kind + 1] AS source_type, CAST(CASE WHEN kind = 0 THEN greatest(held, 1) ELSE 1 END AS BIGINT) AS pages,
           text <> '' AS extraction_success, length(text) AS char_count, {TOKENS.format('text')} AS word_count FROM t"""


def entries_sql() -> str:
    kept = ", ".join(f"coalesce(string_agg(text || '|' || sure || '|' || why || '|' || line_indices, chr(10) ORDER BY block_id) FILTER (label = '{own}'), '') AS {name}" for name, own in report.LISTS.items())
    return f"""WITH {ZS_BLOCKS}, {label_sql(P.ZERO_SHOT)},
        entries AS (SELECT *, coalesce(pattern, 'unknown') AS label, CASE WHEN pattern IS NULL THEN '0.0' ELSE '0.98' END AS sure,
                     CASE WHEN short THEN 'Text too short or empty' WHEN pattern IS NOT NULL THEN 'Pattern matched: ' || pattern ELSE 'No pattern match and LLM disabled' END AS why FROM labels)
        SELECT doc_id, {kept}, count(*) AS total_merged_blocks, 'patterns' AS model, 'zero-shot-llm' AS method FROM entries GROUP BY 1"""


ORACLE_SQL: dict[str, str] = {
    "document_reports": entries_sql(),
    "page_break_merge": page_breaks_sql("CASE WHEN skip THEN 0 ELSE joined END"),
    "page_break_merge_fixed": page_breaks_sql("CASE WHEN skip THEN 0 ELSE used END"),
    "qa_page_merge": pages_merged_sql(),
    "capitalize": rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)([a-z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS a FROM documents)
        SELECT doc_id, {lone('i', 'I', "array_to_string(list_transform(a, lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), '')")} AS text FROM t""",
    "character_corrections": f"""SELECT doc_id, {regexes(lone('l', 'I', 'text'), ('0([a-zA-Z])', 'O$1'), ('([a-zA-Z])0', '$1o'), ('rn', 'm'), ('vv', 'w'), (r'\|', 'I'), ('`', "'"))} AS text FROM documents""",
    "remove_noise": rf"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM documents),
        n AS (SELECT doc_id, array_to_string(list_filter(a, lambda c, i: NOT ({NOISE})), '') AS x FROM c)
        SELECT doc_id, {regexes('x', *[(rf'[{c}]{{2,}}', c) for c in '.,!?;:'], (r'\s[~`^*#@$%&]\s', ' '))} AS text FROM n""",
    "written_texts": f"WITH {ASSEMBLED} SELECT 'exam ' || doc_id AS name, t AS text FROM d",
    "text_files": f"WITH {ASSEMBLED} SELECT 'exam ' || doc_id AS name, true AS is_part, t AS text FROM d",
    "written_reports": f"""WITH {ZS_BLOCKS}, {label_sql(P.ZERO_SHOT)}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id, pattern ORDER BY block_id) - 1 AS at, text, pattern || 's' AS kind FROM labels WHERE pattern IN ('question', 'answer')""",
    "written_jsonl": f"WITH {doc_lines_sql(minimal(unannotated(ANNOTATED)), minimal('s'))} SELECT line AS text, '' AS label FROM lines",
    "written_csv": f"""WITH {SENTENCES} SELECT doc_id AS document_id, pos + 1 AS id, sentence AS text, length(sentence) AS char_count, {TOKENS.format('sentence')} AS word_count,
        CASE WHEN ends_with(sentence, '?') THEN 'question' ELSE 'statement' END AS likely_type FROM sentences WHERE length(sentence) >= 10""",
    "recognised_files": recognised_sql("100000"),
    "recognised_first_pages": recognised_sql("2"),
    "report_summaries": f"""WITH st AS ({stats_sql(ZS_BLOCKS, P.ZERO_SHOT)}), {ZS_BLOCKS}, {label_sql(P.ZERO_SHOT)},
        k AS (SELECT doc_id, pattern, row_number() OVER (PARTITION BY doc_id, pattern ORDER BY block_id) AS place, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text FROM labels),
        firsts AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY place) FILTER (pattern = 'question' AND place <= 3) AS q, string_agg(text, chr(10) ORDER BY place) FILTER (pattern = 'answer' AND place <= 3) AS a FROM k GROUP BY 1)
        SELECT st.doc_id, total_original_lines, total_merged_blocks, questions_count, coalesce(q, '') AS sample_questions, coalesce(a, '') AS sample_answers FROM st LEFT JOIN firsts ON st.doc_id = firsts.doc_id""",
    "recognised_line_counts": f"""WITH {doc_lines_sql(minimal(unannotated(ANNOTATED)), minimal('s'))}, k AS (SELECT doc_id, {kind_sql('line')} AS kind FROM lines)
        SELECT doc_id, count(*) AS total_lines, count(*) FILTER (kind = 'question') AS likely_questions, count(*) FILTER (kind = 'answer') AS likely_answers,
               count(*) FILTER (kind = 'unknown') AS other FROM k GROUP BY 1""",
    "doc_lines": f"WITH {doc_lines_sql()} SELECT * FROM lines",
    "markdown_lines": f"WITH {doc_lines_sql(minimal(unannotated(ANNOTATED)), minimal('s'))} SELECT * FROM lines",
    "line_flags": f"WITH {DUCK_EXAM} SELECT doc_id, line_idx, {marker_sql('line')} AS is_marker, {incomplete_sql('line')} AS is_incomplete, {kind_sql('line')} AS kind FROM exam",
    "pattern_labels": f"WITH {DUCK_EXAM} SELECT doc_id, line_idx, {labelled('line', P.ZERO_SHOT)} AS zero_shot, {labelled('line', P.FEW_SHOT)} AS few_shot, length(line) < 2 AS is_short FROM exam",
    "block_flags": f"WITH {DUCK_EXAM} SELECT doc_id, line_idx, {ZS_START} AS zero_shot_start, {FS_START} AS few_shot_start, {alone_sql('line')} AS standalone, {LOWER} AS starts_lower FROM exam",
    "split_page_markers": f"WITH {DUCK_EXAM}, {PAGE_SPLIT} SELECT * FROM split",
    "split_qa_markers": f"WITH {DUCK_EXAM}, {QA_SPLIT} SELECT * FROM split",
    "zs_blocks": f"WITH {ZS_BLOCKS} SELECT * FROM blocks",
    "fs_blocks": f"WITH {FS_BLOCKS} SELECT * FROM blocks",
    "zs_report_stats": stats_sql(ZS_BLOCKS, P.ZERO_SHOT),
    "fs_report_stats": stats_sql(FS_BLOCKS, P.FEW_SHOT),
    "zs_unmerged_stats": stats_sql(SINGLE, P.ZERO_SHOT),
    "zs_model_labels": model_sql(ZS_BLOCKS, P.ZERO_SHOT, False),
    "fs_model_labels": model_sql(FS_BLOCKS, P.FEW_SHOT, True),
    "top_questions": f"""WITH {ZS_BLOCKS}, {label_sql(P.ZERO_SHOT)},
        k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS place, text FROM labels WHERE pattern = 'question')
        SELECT doc_id, place, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS text FROM k WHERE place <= 3""",
    "line_stats": f"""WITH {DUCK_EXAM}, k AS (SELECT doc_id, {kind_sql('line')} AS kind FROM exam)
        SELECT doc_id, count(*) AS total_lines, count(*) FILTER (kind = 'question') AS likely_questions, count(*) FILTER (kind = 'answer') AS likely_answers,
               count(*) FILTER (kind = 'unknown') AS other FROM k GROUP BY 1""",
    "length_profile": f"""WITH {doc_lines_sql()}
        SELECT doc_id, count(*) AS total_lines, avg(length(line)) AS avg_length, min(length(line)) AS min_length, max(length(line)) AS max_length,
               string_agg(line, chr(10) ORDER BY line_idx) FILTER (line_idx < 5) AS samples FROM lines GROUP BY 1""",
    "jsonl_rows": f"WITH {doc_lines_sql()} SELECT line AS text, '' AS label FROM lines",
    "markdown_cleanup": f"SELECT page_id AS id, 'page' AS kind, {markdown_sql('html')} AS text FROM pages UNION ALL SELECT doc_id, 'document', {markdown_sql('text')} FROM documents",
    "strip_annotations": f"SELECT doc_id, {unannotated(ANNOTATED)} AS text FROM documents",
    "minimal_clean": f"SELECT doc_id, {minimal(ANNOTATED)} AS text FROM documents",
    "clean_text": f"SELECT doc_id, {minimal(unannotated(ANNOTATED))} AS text FROM documents",
    "fix_line_breaks": f"""SELECT doc_id, replace(replace({regexes("replace(text, 'tion ', concat('ti-', chr(10), ' on', chr(10), chr(10), chr(10)))", (r'\n{2,}', '<<PARA>>'), (r'-\s*\n\s*', ''))}, chr(10), ' '), '<<PARA>>', concat(chr(10), chr(10))) AS text FROM documents""",
    "fix_spacing": f"""WITH t AS (SELECT doc_id, {regexes("replace(text, ', ', ' ,\"x \"')", (' {2,}', ' '), (r'\s+([.,!?;:])', '$1'), ('([.,!?;:])([A-Za-z])', '$1 $2'), (r'"\s+', '"'), (r'\s+"', '"'))} AS x FROM documents)
        SELECT doc_id, array_to_string(list_transform(string_split(x, chr(10)), lambda s: {stripped('s')}), chr(10)) AS text FROM t""",
    "word_corrections": f"SELECT doc_id, {regexes(BROKEN, *[('(?i)' + rule, by) for rule, by in clean.WORDS])} AS text FROM documents",
    "sentences": f"WITH {SENTENCES} SELECT * FROM sentences",
    "segments": f"""WITH {SENTENCES} SELECT doc_id AS document_id, pos + 1 AS id, sentence AS text, length(sentence) AS char_count, {TOKENS.format('sentence')} AS word_count,
        CASE WHEN ends_with(sentence, '?') THEN 'question' ELSE 'statement' END AS likely_type FROM sentences WHERE length(sentence) >= 10""",
    "chunks": """WITH w AS (SELECT doc_id, text, CASE WHEN length(text) <= 512 THEN [0] ELSE range(0, length(text), 462) END AS starts FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, text, CAST(unnest(range(len(starts))) AS BIGINT) AS chunk_idx, CAST(unnest(starts) AS BIGINT) AS start FROM w)
        SELECT doc_id, chunk_idx, start, substr(text, start + 1, 512) AS chunk FROM k""",
    "doc_metadata": f"""WITH pg AS ({PAGES_SQL}),
        d AS (SELECT doc_id, coalesce(string_agg('--- PAGE ' || page_no || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) FILTER ({stripped('text')} <> ''), '') AS t FROM pg GROUP BY 1)
        SELECT doc_id, CAST(greatest(len(regexp_extract_all(t, '{P.PAGE_SEPARATOR}')), 1) AS BIGINT) AS pages, {stripped('t')} <> '' AS extraction_success,
               length(t) AS char_count, {TOKENS.format('t')} AS word_count FROM d""",
    "chat_messages": f"""SELECT conv_id, turn, CAST(18 AS BIGINT) AS n_few, md5({examples_sql()}) AS few_md5,
        md5({quoted(f'system={label.INSTRUCTION}{chr(10)}user=Classify this text:{chr(10)}{chr(10)}')} || text) AS zero_md5 FROM conversations""",
    "parse_reply": f"""WITH {REPLY} SELECT conv_id, turn,
        CASE WHEN bare IN ('question', 'answer', 'metadata') THEN bare
             WHEN regexp_extract(bare, '^(\\S+)', 1) IN ('question', 'answer', 'metadata') THEN regexp_extract(bare, '^(\\S+)', 1) ELSE {contained('bare')} END AS few_shot,
        {contained('low')} AS zero_shot, CAST(CASE WHEN {contained('low')} = 'unknown' THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence FROM b""",
    "text_shape": f"""SELECT doc_id, length(text) AS chars, {TOKENS.format('text')} AS tokens,
        CASE WHEN length({stripped('text')}) > 80 THEN substr({stripped('text')}, 1, 80) || '...' ELSE {stripped('text')} END AS shown FROM documents""",
}
