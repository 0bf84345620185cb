"""Labelling blocks: rules first, a pluggable model for what they leave open."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.patterns import java, replace, strip, tokens

LABELS = ("question", "answer", "metadata")
RULES = {"zero-shot": P.ZERO_SHOT, "few-shot": P.FEW_SHOT}
#: The examples that few-shot messages show, in order.
EXAMPLES = [
    ("Ques-1: You are the lead architect for a popular e-commerce platform. The business has announced a massive 'flash sale' event that is expected to increase website traffic by 10x.", "question"),
    ("What are the key components needed to handle 10x traffic increase during flash sales?", "question"),
    ("Differentiate b/w mitosis & meiosis.", "question"),
    ("Determine the difference b/w North & South?", "question"),
    ("Ans-2: Scalable and cost-effective AWS architecture for Media upload includes S3, CloudFront, and Lambda.", "answer"),
    ("At North is north & south is south.", "answer"),
    ("Application Layer: Amazon ECS or EKS containers behind an Application Load Balancer provide horizontal scaling.", "answer"),
    ("When Valli saw the dead cow by the roadside, she was deeply saddened and felt a pang of disappointment.", "answer"),
]
#: Our own instruction; give another one to match a particular model.
INSTRUCTION = "Sort each text from a scanned exam paper into one class: question, answer or metadata. Reply with that one word."


def zero_shot_messages(text: Column, instruction: str = INSTRUCTION) -> Column:
    """Chat messages: the instruction, then the text."""
    return F.array(_message("system", F.lit(instruction)), _message("user", F.concat(F.lit("Classify this text:\n\n"), text)))


def few_shot_messages(text: Column, instruction: str = INSTRUCTION, examples: list[tuple[str, str]] = EXAMPLES) -> Column:
    """Chat messages: the instruction, an exchange per example, then the text."""
    quoted = lambda t: F.concat(F.lit("Text: '"), t, F.lit("'"))
    shown = [m for said, label in examples for m in (_message("user", quoted(F.lit(said))), _message("assistant", F.lit(label)))]
    return F.array(_message("system", F.lit(instruction)), *shown, _message("user", quoted(text)))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _contained(reply: Column) -> Column:
    return F.when(reply.contains("question"), "question").when(reply.contains("answer"), "answer").when(reply.contains("metadata"), "metadata")


def parse_few_shot_reply(reply: Column) -> Column:
    """Label of a reply: exact, else its first word, else a label inside it, else unknown."""
    low = F.lower(strip(reply))
    bare = F.when(low.contains("<think>"), strip(replace(low, r"(?s)<think>.*?</think>", ""))).otherwise(low)
    first = F.try_element_at(tokens(bare), F.lit(1))
    return F.when(bare.isin(*LABELS), bare).when(first.isin(*LABELS), first).otherwise(F.coalesce(_contained(bare), F.lit("unknown")))


def parse_zero_shot_reply(reply: Column) -> Column:
    """(label, confidence, reasoning) of a reply."""
    low = F.lower(strip(reply))
    label = _contained(low)
    return F.struct(
        F.coalesce(label, F.lit("unknown")).alias("label"),
        F.when(label.isNotNull(), F.lit(0.9)).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(label.isNotNull(), F.concat(F.lit("LLM classified as "), label)).otherwise(F.concat(F.lit("LLM response unclear: "), low)).alias("reasoning"),
    )


def label_blocks(
    blocks: DataFrame,
    mode: str = "zero-shot",
    reply_fn: Callable[[list], list[str]] | None = None,
    use_patterns: bool = True,
    chat: bool = False,
) -> DataFrame:
    """Add ``label, confidence, reasoning`` to blocks (column ``text``).

    Rules decide natively. If ``reply_fn`` is given, each different text that
    they leave open is sent to it once, in Arrow batches; a Python function inside
    CASE would run for every row, so open texts are filtered out, made distinct,
    answered and joined back. With ``chat`` it gets each text's messages, lists of
    role and content, instead of the text. Without it such texts are unknown.
    """
    rules = RULES[mode]
    short = P.too_short(F.col("text"))
    pattern = P.pattern_label(F.col("text"), rules) if use_patterns else F.lit(None).cast("string")
    found = blocks.withColumn("short", short).withColumn("pattern", F.when(~F.col("short"), pattern))
    known = F.col("short") | F.col("pattern").isNotNull()
    label, confidence = F.coalesce("pattern", F.lit("unknown")), F.when(F.col("pattern").isNotNull(), F.lit(0.98)).otherwise(F.lit(0.0))
    reasoning = (
        F.when(F.col("short"), "Text too short or empty")
        .when(F.col("pattern").isNotNull(), F.concat(F.lit("Pattern matched: "), F.col("pattern")))
        .otherwise("No pattern match and LLM disabled")
    )
    if reply_fn is None:
        return found.select(*blocks.columns, label.alias("label"), confidence.alias("confidence"), reasoning.alias("reasoning"))

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(reply_fn([json.loads(t) for t in texts] if chat else texts.tolist()), dtype=object)

    messages = zero_shot_messages if mode == "zero-shot" else few_shot_messages
    sent = F.to_json(messages(F.col("text"))) if chat else F.col("text")
    replies = found.where(~known).select("text").distinct().withColumn("reply", ask(sent))
    joined = found.withColumn("asked", F.when(~known, F.col("text"))).join(replies.withColumnRenamed("text", "asked"), "asked", "left")
    if mode == "zero-shot":
        parsed = parse_zero_shot_reply(F.col("reply"))
    else:
        own = parse_few_shot_reply(F.col("reply"))
        sure = F.when(own != "unknown", F.lit(0.9)).otherwise(F.lit(0.3))
        parsed = F.struct(own.alias("label"), sure.alias("confidence"), F.concat(F.lit("LLM classified as "), own).alias("reasoning"))
    answered = joined.withColumn("parsed", F.when(~known, parsed))
    return answered.select(
        *blocks.columns,
        F.when(known, label).otherwise(F.col("parsed.label")).alias("label"),
        F.when(known, confidence).otherwise(F.col("parsed.confidence")).alias("confidence"),
        F.when(known, reasoning).otherwise(F.col("parsed.reasoning")).alias("reasoning"),
    )


#: Flags a reply that carries reasoning, which parsing drops.
THINKING = java(r"(?s)<think>.*?</think>")
