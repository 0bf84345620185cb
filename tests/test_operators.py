"""Line, block, page and segment operators against plain Python walks."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folio.functions import predicates as P
from folio.operators import label, lines, merge, report, segments
from folio.plans import pipelines

POOL = [
    "the cat and", "ran to the", "home again.", "Page 4", "Q. why is it", "Ans: since", "What now?", "and so on,", "A dog", "12", "more of,",
    "It ended.", "lower start here", "Chapter 2 x", "DOMS", "1) point", "Application Layer: x", "short", "this continues the", "",
]


def flags(spark, texts):
    """The predicates of each text, as the operators see them."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    made = rows.select(
        "t", P.is_page_marker(t).alias("marker"), P.is_incomplete(t).alias("open"), P.line_type(t).alias("kind"), P.any_of(t, P.LINE_OPENINGS).alias("opens"),
        P.few_shot_standalone(t).alias("alone"), P.few_shot_start(t).alias("start"),
    )
    return {r["t"]: r.asDict() for r in made.collect()}


def walk_page_breaks(rows, known, fixed):
    out, i = [], 0
    while i < len(rows):
        line = rows[i]
        if not line or known[line]["marker"]:
            i += 1
            continue
        joined, used = [], 0
        if known[line]["open"]:
            for ahead in range(1, 5):
                if i + ahead >= len(rows):
                    break
                other = rows[i + ahead]
                if not other or known[other]["marker"]:
                    continue
                kinds = {known[line]["kind"], known[other]["kind"]}
                if known[other]["opens"] or ("unknown" not in kinds and len(kinds) == 2):
                    break
                joined.append(other)
                used = ahead
                if not known[other]["open"]:
                    break
        out.append(" ".join([line, *joined]))
        i += 1 + (used if fixed else len(joined))
    return out


@pytest.mark.parametrize("fixed", [False, True])
def test_page_break_merge_follows_a_plain_walk(spark, lines_of, fixed):
    rng = random.Random(4)
    documents = [[rng.choice(POOL) for _ in range(rng.randint(1, 14))] for _ in range(60)]
    known = flags(spark, POOL)
    got = merge.merge_page_breaks(lines_of(*documents), fixed).orderBy("doc_id", "line_idx").collect()
    for d, rows in enumerate(documents):
        assert [r["line"] for r in got if r["doc_id"] == d] == walk_page_breaks(rows, known, fixed)


def test_line_joined_across_a_marker_comes_twice_unless_fixed(lines_of):
    found = lines_of(["it is the", "Page 2", "end."])
    both = [[r["line"] for r in merge.merge_page_breaks(found, fixed).orderBy("line_idx").collect()] for fixed in (False, True)]
    assert both == [["it is the end.", "end."], ["it is the end."]]


def test_few_shot_blocks_follow_a_plain_walk(spark, lines_of):
    rng = random.Random(5)
    pool = [p for p in POOL if p]
    documents = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(50)]
    known = flags(spark, pool)

    def goes_on(line, before):
        first = line.split()[0].lower().rstrip(".,;:")
        if before and before[-1] in ".!?" and not line[0].islower():
            return False
        return line[0].islower() or first in P.CONTINUATIONS

    got = merge.few_shot_blocks(lines_of(*documents)).orderBy("doc_id", "block_id").collect()
    for d, rows in enumerate(documents):
        blocks, current = [], []
        for i, line in enumerate(rows):
            if known[line]["alone"]:
                blocks += [current] if current else []
                blocks.append([i])
                current = []
            elif known[line]["start"] or not current or not goes_on(line, rows[current[-1]]):
                blocks += [current] if current else []
                current = [i]
            else:
                current.append(i)
        blocks += [current] if current else []
        mine = [r for r in got if r["doc_id"] == d]
        assert [r["line_indices"] for r in mine] == blocks
        assert [r["text"] for r in mine] == [" ".join(rows[i] for i in b) for b in blocks]


def test_blocks_partition_the_lines_whatever_the_partitions(spark, lines_of):
    found = lines_of(["Q1: what is", "the cat.", "--- PAGE 2 --- rest of it", "Ans: it"], ["one"])
    a = merge.zero_shot_blocks(found).orderBy("doc_id", "block_id").collect()
    b = merge.zero_shot_blocks(found.repartition(7, "line")).orderBy("doc_id", "block_id").collect()
    assert a == b
    assert sorted(i for r in a if r["doc_id"] == 0 for i in r["line_indices"]) == list(range(5))


def test_splits(lines_of):
    found = lines_of(["--- PAGE 2 --- d) Who", "so. Q2. What now", "the answer is clear", "plain"])
    pages = [r["line"] for r in lines.split_page_markers(found).orderBy("line_idx").collect()]
    assert pages == ["--- PAGE 2 ---", "d) Who", "so. Q2. What now", "the answer is clear", "plain"]
    marks = [r["line"] for r in lines.split_qa_markers(found).orderBy("line_idx").collect()]
    assert marks == ["--- PAGE 2 --- d) Who", "so.", "Q2. What now", "the", "answer is clear", "plain"]


def test_page_merges(spark):
    pages = spark.createDataFrame(
        [(1, 1, "it is the"), (1, 2, "end of\nit and"), (1, 3, "Q. new"), (2, 1, "Done."), (2, 2, "Other."), (3, 1, "cut-"), (3, 2, "off.")], "doc_id long, page_no long, text string"
    )
    qa = {(r["doc_id"], r["part"]): r["text"] for r in merge.merge_qa_pages(pages).collect()}
    assert qa == {(1, 0): "it is the end of\nit and", (1, 1): "Q. new", (2, 0): "Done.", (2, 1): "Other.", (3, 0): "cut-", (3, 1): "off."}
    similar = {(r["doc_id"], r["part"]): r["text"] for r in merge.process_pages(pages).collect()}
    assert similar == {(1, 0): "it is the end of\nit and Q. new", (2, 0): "Done.", (2, 1): "Other.", (3, 0): "cutoff."}


def test_similarity_is_the_standard_ratio(spark):
    pairs = [("abcd" * 60, "bcda" * 60), ("", "x"), ("same", "same"), (None, "x")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in rows.select("i", merge.similarity("a", "b").alias("s")).orderBy("i").collect()]
    assert got == [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x" * 512), (3, "ab" * 485), (4, None), (5, "\U0001f600" * 513)], "doc_id long, text string")
    got = segments.chunks(docs).orderBy("doc_id", "chunk_idx").collect()
    assert [(r["doc_id"], r["start"], len(r["chunk"])) for r in got] == [(1, 0, 0), (2, 0, 512), (3, 0, 512), (3, 462, 508), (3, 924, 46), (5, 0, 512), (5, 462, 51)]
    with pytest.raises(ValueError, match="overlap"):
        segments.chunks(docs, 50, 50)


def test_segments_number_all_sentences(spark):
    docs = spark.createDataFrame([(7, "Hi. This is a longer one. Is this a question?")], "doc_id long, text string")
    got = segments.segments(docs).orderBy("id").collect()
    assert [(r["id"], r["word_count"], r["likely_type"]) for r in got] == [(2, 5, "statement"), (3, 4, "question")]


def test_page_aware_preprocessing(spark):
    docs = spark.createDataFrame([(1, "--- PAGE 1 ---\nit is the\n\n--- PAGE 2 ---\nend."), (2, "no marks"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in merge.preprocess_pages(docs, False).collect()}
    assert got == {1: "It is the end.", 2: "No marks", 3: ""}


def test_model_sees_each_open_text_once(spark, lines_of, tmp_path):
    seen = tmp_path / "seen"

    def reply(texts):
        with seen.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return ["question" for _ in texts]

    blocks = merge.single_blocks(lines_of(["open text here", "Ans: known", "open text here", "x"], ["open text here", "other open"]))
    got = label.label_blocks(blocks, "few-shot", reply).orderBy("doc_id", "block_id").collect()
    assert [(r["label"], r["confidence"]) for r in got] == [("question", 0.9), ("answer", 0.98), ("question", 0.9), ("unknown", 0.0), ("question", 0.9), ("question", 0.9)]
    assert sorted(seen.read_text().split("\n")) == ["", "open text here", "other open"]


def test_replies(column):
    texts = ["question", "Answer.", "<think>question</think> metadata", "neither", "", "metadata then answer"]
    assert column(label.parse_few_shot_reply, texts) == ["question", "answer", "metadata", "unknown", "unknown", "metadata"]
    assert [r["label"] for r in column(label.parse_zero_shot_reply, texts)] == ["question", "answer", "question", "unknown", "unknown", "answer"]


def test_messages(column):
    few, zero = column(label.few_shot_messages, ["t"])[0], column(label.zero_shot_messages, ["t"])[0]
    assert (len(few), few[0]["role"], few[-1]["content"]) == (18, "system", "Text: 't'")
    assert [m["content"] for m in zero] == [label.INSTRUCTION, "Classify this text:\n\nt"]


def test_report_counts_add_up(lines_of):
    found = lines_of(["Q1: what is it?", "Ans: this.", "Page 3", "Something else is here to read."])
    made = pipelines.classify_documents(found, timestamp="2024").collect()[0]
    s = made["statistics"]
    assert s["total_merged_blocks"] == s["questions_count"] + s["answers_count"] + s["metadata_count"] + s["unknown_count"]
    assert (s["total_original_lines"], made["questions"][0]["text"], made["method"], made["timestamp"]) == (4, "Q1: what is it?", "zero-shot-llm", "2024")
    shown = report.summary(pipelines.classify_documents(found)).collect()[0]
    assert shown["sample_answers"] == ["Ans: this. Page 3"] or shown["sample_answers"] == ["Ans: this."]
