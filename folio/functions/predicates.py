"""Predicates and types of lines, as boolean or string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import any_of, java, matches, replace, rstrip, starts_lower, strip, tokens

#: Parts of a line that mark it as page furniture.
FURNITURE = [
    "total pages", "extracted on", "extracted text", "pdf:", "fig", "figure", "image of", "diagram",
    "not to be republished", "rationalised", "© ncert",
]
#: Last words that leave a sentence open.
OPEN_ENDINGS = """a an the of in to from with at by for on and or but because as since when if is are was were be been
    being has have had do does did will would shall should may might can could which that who whom whose where""".split()
#: Openings of questions and answers by which lines are typed.
QUESTION_OPENINGS = [r"^q[\s\.\(]", r"^ques[\s\.]", r"^question[\s\.]", r"^\d+\.\s*[qQ]"]
ANSWER_OPENINGS = [r"^ans[\s\.\:]", r"^answer[\s\.\:]", r"^a[\s\.\:]", r"^a\d+[\s\.]"]
#: Openings that keep a line, or a page, from joining what is before it.
LINE_OPENINGS = [r"^(q[\s\.\(]|ques[\s\.]|question[\s\.]|ans[\s\.\:]|answer[\s\.\:]|a[\s\.\:]|a\d+[\s\.])"]
PAGE_OPENINGS = [r"^(q[\s\.\(\d]|ques[\s\.]|question[\s\.]|ans[\s\.\:]|answer[\s\.\:]|a[\s\.\:]|\d+[\s\.\)]+[qQaA])"]

#: Zero-shot labelling rules, tried in this order of labels.
ZERO_SHOT = {
    "question": [r"^Q\s*[\d\-\.:]+", r"^Ques[\s\-\.:]", r"^Question\s*[\d\-\.:]*", r"^(What|Why|How|Who|Where|When|Which)\s+.+\?$"],
    "answer": [r"^Ans\s*[\-\.:]+", r"^Answer\s*[\-\.:]*", r"^Solution[\s\-\.:]*"],
    "metadata": [
        r"^---\s*PAGE\s*\d+\s*---", r"^Page\s*(No\.?|Number)?", r"^\d+\s*(of|/)\s*\d+$", r"^(Name|Roll|ID|Student)\s*[:.]",
        r"^\d{2}[A-Z]{2,3}\d{4,}", r"^(Date|Due|Submitted)[\s:]*", r"^[A-Z]{2,5}$", r"^(www\.|http|@)",
    ],
}
#: Few-shot labelling rules, tried in this order of labels. The rule of
#: lone x's is written so that it takes no step back, however long the line.
FEW_SHOT = {
    "question": [
        r"^Q\s*[\d\-\.:]+", r"^Q\s+[A-Z][a-z]", r"^Ques[\s\-\.:]", r"^Question\s*[\d\-\.:]*", r"^\(\s*[a-z]\s*\)", r"^\d+\s*[\.\)]\s*[A-Z]",
        r"^(What|Why|How|Who|Where|When|Which|Explain|Describe|Define|Determine|Differentiate)\s",
    ],
    "answer": [r"^Ans\s", r"^Ans[\-\.:]+", r"^Answer\s*[\d\-\.:]*", r"^Solution[\s\-\.:]*", r"^A[\s]*[\d]+[\s\-\.:]+"],
    "metadata": [
        r"^---\s*PAGE\s*\d+\s*---", r"^Page\s*(No\.?|Number)?", r"^\d+\s*(of|/)\s*\d+$", r"^(Section|Part)\s*[A-Z]\s*[:.]?\s*$",
        r"^(Section|Part)\s*[A-Z]\s*[:.-]", r"^(Name|Roll|ID|Student)\s*[:.]", r"^\d{2}[A-Z]{2,3}\d{4,}", r"^(Date|Due|Submitted)[\s:]*",
        r"^Total\s*(Marks|Points)", r"^[A-Z]{2,5}$", r"^x[x\s]*+o?\s*$", r"^[xo]\s+[xo]\s+[xo]$",
        r"^(Short|Long|Very Short|Medium)\s+(Answer\s+)?(type\s+)?Questions?\s*$",
    ],
}
#: Starts of blocks and lines that stand alone.
ZERO_SHOT_STARTS = [r"^Q\s*[\d\-\.\:]", r"^Ques[\s\-\.\:]", r"^Question\s*\d*", r"^Ans[\s\-\.\:]", r"^Answer[\s\-\.\:]", r"^---\s*PAGE", r"^\([a-z]\)", r"^\d+\s*[\.\)]"]
FEW_SHOT_STARTS = [
    r"^Q\s*[\d\-\.\:\(]", r"^Q\s+[A-Z]", r"^Ques[\s\-\.\:]", r"^Question\s*[\d\-\.\:]*", r"^Ans\s", r"^Ans[\.\:\-]+", r"^Answer[\s\-\.\:]*",
    r"^Solution[\s\-\.\:]*", r"^---\s*PAGE", r"^\d+\s*[\.\)]\s+[A-Z]", r"^[A-Z][a-z]+\s+Layer:",
]
STANDALONE = [r"^[A-Z]{2,6}$", r"^Page\s*(No|Number)?\.?", r"^\d+\s*(of|/)\s*\d+$", r"^(Name|Roll|ID)[\s\:]+", r"^\d{2}[A-Z]{2,3}\d{4,}", r"^---.*---$"]
CONTINUATIONS = "the and or but which that this these those for with from to in on at by".split()


def is_page_marker(text: Column) -> Column:
    """Page numbers, dates at the very start, rules, furniture and section headings."""
    bare = strip(text)
    low = F.lower(bare)
    out = matches(low, r"^page\s*\d+") | (matches(bare, r"^\d+$") & (F.length(bare) <= 4))
    out = out | any_of(text, [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}"], ignore_case=False)
    out = out | matches(bare, r"^[-=_.]{3,}$")
    for part in FURNITURE:
        out = out | low.contains(part)
    return out | matches(low, r"^(chapter|unit|section|part|appendix)\s*\d*[:\s]")


def is_incomplete(text: Column) -> Column:
    """Whether a sentence was cut off: an open last word, or a comma at the end."""
    bare = strip(text)
    last_word = replace(F.lower(F.element_at(tokens(bare), -1)), r"[.,;:]+\z", "")
    return (
        F.when(bare == "", False)
        .when(bare.rlike(r'[.!?":)\]]\z'), False)
        .otherwise(last_word.isin(OPEN_ENDINGS) | bare.endswith(","))
    )


def line_type(text: Column) -> Column:
    bare = strip(text)
    question = any_of(bare, QUESTION_OPENINGS) | bare.contains("?")
    return F.when(question, "question").when(any_of(bare, ANSWER_OPENINGS), "answer").otherwise("unknown")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def continues_page(page: Column, following: Column) -> Column:
    """Whether a page goes on in the following one: cut off, and not a new item."""
    last, first = F.try_element_at(_lines(page), F.lit(-1)), F.try_element_at(_lines(following), F.lit(1))
    kinds = F.concat(line_type(last), F.lit(">"), line_type(first))
    joined = is_incomplete(last) & ~any_of(first, PAGE_OPENINGS) & ~kinds.isin("question>answer", "answer>question") & starts_lower(first)
    return F.coalesce(joined, F.lit(False))


def resembles_or_continues(page: Column, following: Column, similarity: Column, threshold: float = 0.8) -> Column:
    """Similar at the seam, or one of the loose signs of continuation."""
    hints = page.rlike(r"(-|contin|cont\.)\z") | ~F.coalesce(page.rlike(r"[.!?]\z"), F.lit(False)) | starts_lower(following)
    return (similarity > threshold) | hints


def pattern_label(text: Column, rules: dict[str, list[str]]) -> Column:
    """The first label with a rule that fits, else null."""
    bare = strip(text)
    out = F.lit(None).cast("string")
    for label, own in reversed(rules.items()):
        out = F.when(any_of(bare, own), label).otherwise(out)
    return out


def zero_shot_label(text: Column) -> Column:
    return pattern_label(text, ZERO_SHOT)


def few_shot_label(text: Column) -> Column:
    return pattern_label(text, FEW_SHOT)


def too_short(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < 2


def zero_shot_start(line: Column) -> Column:
    return any_of(strip(line), ZERO_SHOT_STARTS)


def zero_shot_continues(line: Column, before: Column) -> Column:
    bare = strip(line)
    short = F.length(bare)
    return (
        F.when(matches(strip(before), r"^---\s*PAGE\s*\d+\s*---$", True), False)
        .when(rstrip(before).rlike(r"[.?!]\z"), (short < 50) & starts_lower(bare))
        .when(starts_lower(bare), True)
        .otherwise((short < 30) & ~zero_shot_start(bare))
    )


def few_shot_start(line: Column) -> Column:
    bare = strip(line)
    return any_of(bare, FEW_SHOT_STARTS) | (bare.endswith("?") & (F.length(bare) > 20))


def few_shot_standalone(line: Column) -> Column:
    bare = strip(line)
    return ((F.length(bare) < 12) & ~bare.rlike(r"[?,]\z")) | any_of(bare, STANDALONE)


def few_shot_continues(line: Column, before: Column) -> Column:
    bare = strip(line)
    first = F.regexp_replace(F.lower(F.element_at(tokens(bare), 1)), r"[.,;:]+\z", "")
    closed = rstrip(before).rlike(r"[.!?]\z")
    return F.when(starts_lower(bare), True).when(closed, False).otherwise(first.isin(CONTINUATIONS))


#: A page separator in a text, and a line that begins with one.
PAGE_SEPARATOR = r"---\s*PAGE\s*\d+\s*---"
SEPARATOR_COUNT = java(PAGE_SEPARATOR)
