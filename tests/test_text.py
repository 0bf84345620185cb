"""Cleaning and predicates against small expectations worked out by hand."""

import re
import unicodedata

import pytest

from folio.functions import clean
from folio.functions import predicates as P
from folio.functions.patterns import java, starts_lower, strip, token_count


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (strip, "\x1c  a b \n", "a b"),
        (clean.markdown_cleanup, "![x](y)text <b>bold</b> ![]", "text bold"),
        (clean.markdown_cleanup, "a < b > c", "a c"),
        (clean.markdown_cleanup, "a_b_c", "abc"),
        (clean.markdown_cleanup, "* one\n* two", "one\n two"),
        (clean.markdown_cleanup, "# Head\n\n\n\n1. What\n1) Kept", "Head\nWhat\n1) Kept"),
        (clean.markdown_cleanup, "```python\ncode```", "code"),
        (clean.markdown_cleanup, "[name](link) and \\# mark", "name and # mark"),
        (clean.markdown_cleanup, "x\n-----\ny", "x\n\ny"),
        (clean.markdown_cleanup, None, ""),
        (clean.strip_annotations, "<|ref|>a<|/ref|><|det|>[[1]]<|/det|>  kept<|x|>", "kept"),
        (clean.minimal_clean, " a\0  b\n\n\n\nc ", "a b\n\nc"),
        (clean.minimal_clean, None, ""),
        (clean.normalize_unicode, "cafe\u0301 \u2013 x\u00a0y\u2026\u200bz\u2028w", "cafe\u0301 - x y...z\nw"),
        (clean.normalize_unicode, "“curly”", "“curly”"),
        (clean.fix_line_breaks, "exam-\n  ple one\ntwo\n\n\nthree", "example one two\n\nthree"),
        (clean.fix_line_breaks, "a<<PARA>>b", "a\n\nb"),
        (clean.fix_spacing, 'a  b ,c.com " q "', 'a b, c. com"q"'),
        (clean.character_corrections, "l saw 0ne f00d learn vv|`", "I saw One foOd leam wI'"),
        (clean.word_corrections, "Teh TBE wiht whcih that   is I  am", "the the with which that is I am"),
        (clean.remove_noise, "a # b ... c!! d#e", "a  b . c! d#e"),
        (clean.capitalize_sentences, "one. two! i am? ét", "One. Two! I am? ét"),
        (clean.capitalize_sentences, "", ""),
        (clean.preprocess, "  ", ""),
        (clean.preprocess, "see homepage 3\n--- break", "See home break"),
    ],
)
def test_rewrites(column, function, text, expected):
    assert column(function, [text]) == [expected]


def test_kelvin_sign_folds_and_fullwidth_digit_counts(column):
    assert column(lambda t: t.rlike(java(r"^k\d$", True)), ["K1", "k٣", "kx"]) == [True, True, False]


def test_words_leave_out_combining_marks(column):
    assert column(lambda t: t.rlike(java(r"^\w+$")), ["abc_1", "e\u0301"]) == [True, False]
    assert [bool(re.match(r"^\w+$", t)) for t in ["abc_1", "e\u0301"]] == [True, False]


def test_cleaning_twice_changes_nothing(column):
    texts = ["  a  b\n\n\n\n c\t", " x", "\n\n"]
    once = column(clean.minimal_clean, texts)
    assert column(clean.minimal_clean, once) == once


def test_page_markers(column):
    yes = ["Page 3", "12", "1/2/24 x", "2024-01-02", "-----", "configure it", "Chapter 1: x", "Part of it"]
    no = ["--- PAGE 1 ---", "12345", " 1/2", "A line.", "xpage 3"]
    assert column(P.is_page_marker, yes + no) == [True] * len(yes) + [False] * len(no)


def test_incomplete_sentences(column):
    yes, no = ["this is the", "a, b,", "the cat and,"], ["", "Done.", "no stop", "(x)", "12"]
    assert column(P.is_incomplete, yes + no) == [True] * len(yes) + [False] * len(no)


def test_line_types(column):
    texts = ["Q. x", "Q1: x", "Is it? yes", "Ans: b", "A cat", "1. q", "plain"]
    assert column(P.line_type, texts) == ["question", "unknown", "question", "answer", "answer", "question", "unknown"]


def test_labels(column):
    texts = ["Questionnaire", "When he came", "What is x?", "ab", "Answers vary", "(a) part", "5 of 10", "x x x", "Due to rain", "nothing here"]
    assert column(P.zero_shot_label, texts) == ["question", None, "question", "metadata", "answer", None, "metadata", None, "metadata", None]
    assert column(P.few_shot_label, texts) == ["question", "question", "question", "metadata", "answer", "question", "metadata", "metadata", "metadata", None]


def test_page_predicates(spark):
    from pyspark.sql import functions as F

    rows = [("it is the", "end of it.", True), ("Done.", "and more", False), ("it is the", "Q2 new", False), ("it is the", "a cat", False), ("it is the", "The end", False), ("", "x", False)]
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, e boolean")
    got = found.select("i", P.continues_page(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()
    assert [r["g"] for r in got] == [r[2] for r in rows]


def test_counts(column):
    assert column(token_count, ["a  b c", "", " "]) == [3, 0, 0]
    assert column(starts_lower, ["a", "A", "é", ""]) == [True, False, True, False]


def test_decomposition_is_the_standard_one(column):
    texts = ["ﬁn Ångström ①", None]
    assert column(clean.decompose, texts) == [unicodedata.normalize("NFKD", texts[0]), None]


def test_sentences(column):
    assert column(clean.split_sentences, ["One. Two!  Three? four", ""]) == [["One.", "Two!", "Three? four".split(" ")[0], "four"], []]


def test_very_long_lines_meet_every_rule(column):
    """A megabyte of what each rule is likely to step over again and again."""
    size = 1 << 20
    lines = ["x " * (size // 2) + "y", "a" + " " * size + "b", " " * size, "x" * size, "Q" + " " * size + "z", "1" * size, "-" * size + "z", "a " * (size // 2), "so\t" + "\n" * 2_000 + "on"]
    for make in (P.is_page_marker, P.is_incomplete, P.zero_shot_start, P.few_shot_start, P.few_shot_standalone):
        assert len(column(make, lines)) == len(lines)
    assert column(P.few_shot_label, lines)[0] is None
    assert column(P.few_shot_label, ["x " * (size // 2) + "o", "x" * size, "x x\to  ", "x o xx", "o"]) == ["metadata"] * 3 + [None] * 2
    for make in (P.line_type, P.zero_shot_label, clean.fix_spacing, clean.word_corrections, clean.capitalize_sentences, clean.remove_noise, strip):
        assert len(column(make, lines)) == len(lines)
    assert column(strip, ["a" + " " * size + "b" + " " * size, " " * size])[1] == ""


def test_capitals_after_any_white_space(column):
    assert column(clean.capitalize_sentences, [" a. b", "a.   b!\n\nc? d", "i am. " + " " * 100 + "so i do", "e.g. 5. X.y", "", "ß. ß"]) == [
        " a. B", "A.   B!\n\nC? D", "I am. " + " " * 100 + "So I do", "E.g. 5. X.y", "", "SS. ß",
    ]
