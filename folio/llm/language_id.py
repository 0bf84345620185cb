"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
greedily into the longest phrases that occur in a language's sample; with c
phrases over N characters and a sample of n characters, c * log2(n) / N
estimates the bits per character that the text costs in that language. The
language of the lowest figure wins.

Texts are lower-cased and runs of anything but letters become one space. The
whole text is parsed, in blocks of ``BLOCK`` characters that each begin a new
phrase, so that NumPy can parse all blocks of a batch in step.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Ties go to the language that sorts first. With one learned language the score of
any text with a letter is 1. Without any learned language all are ``und``. Extra
columns pass through; repeated rows get the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, saved
from .textcode import flat

BLOCK = 512
CELLS = 16_000_000
UNKNOWN = "und"

@cache
def letter_codes() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            low = ch.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, and where each text begins (with the end)."""
    codes, starts = flat(texts)
    low = letter_codes()[codes]
    keep = low != 32
    after = np.zeros(len(low), bool)
    after[1:] = keep[:-1]
    inner = starts[:-1][starts[:-1] < len(low)]
    after[inner] = False
    keep |= after  # the first separator after a letter stays, as a space
    ends = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], ends[starts]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for code in codes:
        made = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = made
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if size[at] + 1 == size[to]:
                link[made] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
                link[to] = link[made] = copy
        last = made
    return moves


@dataclass(frozen=True)
class Automaton:
    """Dense table: row of a state, column of a letter, entry (next row offset) * 2 + (1 if a new phrase begins)."""

    table: np.ndarray
    symbols: np.ndarray
    width: int
    bits: float

    @classmethod
    def of(cls, sample: np.ndarray) -> Automaton:
        letters = np.unique(sample)
        width = len(letters) + 1  # column 0: a letter that the sample lacks
        moves = suffix_automaton((np.searchsorted(letters, sample) + 1).tolist())
        table = np.zeros((len(moves), width), np.int32)
        restart = np.zeros(width, np.int32)
        for code, to in moves[0].items():
            restart[code] = to * width
        for state, row in enumerate(moves):
            line = restart * 2 + 1
            for code, to in row.items():
                line[code] = to * width * 2
            table[state] = line
        # The start state has no phrase open: what it reads begins one.
        table[0] = restart * 2 + 1
        symbols = np.zeros(0x110000, np.uint8 if width < 256 else np.uint32)
        symbols[letters] = np.arange(1, width)
        return cls(table.ravel(), symbols, width, float(np.log2(max(2, len(sample)))))


def phrases(model: Automaton, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Phrases of each text under one automaton."""
    lengths = np.diff(starts)
    blocks = -(-lengths // BLOCK)
    text_of = np.repeat(np.arange(len(lengths)), blocks)
    first = np.cumsum(blocks) - blocks
    begin = np.repeat(starts[:-1], blocks) + (np.arange(len(text_of)) - np.repeat(first, blocks)) * BLOCK
    size = np.minimum(begin + BLOCK, np.repeat(starts[1:], blocks)) - begin
    order = np.argsort(-size, kind="stable")
    begin, size, text_of = begin[order], size[order], text_of[order]
    symbol = model.symbols[codes]
    state, count = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
    # How many blocks are longer than t, for each step t.
    active = np.searchsorted(-size, -np.arange(BLOCK), side="left")
    table = model.table
    for t in range(int(size[0]) if len(size) else 0):
        n = active[t]
        at = state[:n]
        at += symbol[begin[:n] + t]
        step = table.take(at)
        count[:n] += step & 1
        np.right_shift(step, 1, out=at)
    return np.bincount(text_of, weights=count, minlength=len(lengths))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    automata: list[Automaton]

    def predict(self, texts: list[str | None]) -> list[list]:
        codes, starts = normalised(texts)
        has_letter = np.diff(starts) > 0
        if not self.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
        cost = np.stack([phrases(m, codes, starts) * m.bits for m in self.automata])
        cost = np.where(has_letter, cost, 1.0)
        best = np.argmin(cost, axis=0)
        ordered = np.sort(cost, axis=0)
        score = 1 - ordered[0] / ordered[1] if len(cost) > 1 else np.ones(len(texts))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)]
        return [names, np.where(has_letter, score, 0.0).tolist()]


def fit(labelled: DataFrame, sample_chars: int = 24_000, sample_docs: int = 200, total_chars: int = 2_000_000) -> LanguageModel:
    """Learn from ``text, lang`` (and ``doc_id``, which only orders the sample).

    A bounded sample of texts with a letter: of each language about ``sample_docs``
    different texts (all, if there are no more) are drawn by a hash of the text,
    each once however many copies it has, and of these whole texts are taken until
    ``sample_chars`` letters are reached. What is still missing then comes from the
    beginnings of longer texts. Every labelled language is learned, however rare; of
    many languages each gets its share of ``total_chars`` (500 letters at least), and
    a language of very many letters as much as ``CELLS`` entries of a table hold.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    different = known.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    part = F.when(F.col("n") <= sample_docs, F.lit((1 << 63) - 1)).otherwise(F.expr(f"{(1 << 63) - 1}L div n") * sample_docs)
    # One row for each language; there is an automaton for each in every worker anyway.
    shares = saved(different.select("lang", F.greatest("least", part).alias("share")), "language-shares")
    sample_chars = max(500, min(sample_chars, total_chars // max(1, shares.count())))
    begun = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, 4 * sample_chars)
    drawn = known.join(F.broadcast(shares), "lang").where("h <= share").select("lang", "h", begun.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = sorted((r["lang"], r["h"], r["text"]) for r in drawn.collect())
    parts: dict[str, list[np.ndarray]] = {}
    seen: set[tuple[str, bytes]] = set()
    for spare in (False, True):
        for lang, _, text in rows:
            got = sum(map(len, parts.get(lang, [])))
            if got >= sample_chars:
                continue
            codes, _ = normalised([text])
            key = (lang, codes.tobytes())
            if len(codes) and (len(codes) > sample_chars) == spare and key not in seen:
                seen.add(key)
                parts.setdefault(lang, []).append(codes[: sample_chars - got] if spare else codes)
    languages = sorted(parts)
    gap = np.array([32], np.uint32)
    return LanguageModel(languages, [Automaton.of(bounded(np.concatenate([x for p in parts[la] for x in (p, gap)]))) for la in languages])


def bounded(sample: np.ndarray) -> np.ndarray:
    """As much of a sample as its automaton's table has room for (two states a letter at most)."""
    most = max(256, CELLS // (2 * (len(np.unique(sample)) + 1)))
    return sample[:most]


def identify(docs: DataFrame, model: LanguageModel, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and its score (1 - best cost / second cost) to each row, in
    place of columns of those names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = T.StructType([T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.DoubleType())])
    return add_columns(docs, ["text"], kinds, lambda texts: shared.value.predict(texts))
