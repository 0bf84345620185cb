"""Benchmark decontamination: size-partitioned MinHash containment search.

A document leaks a benchmark item if it holds at least ``threshold`` of the
item's set of five-word shingles. Short items inside long documents have a tiny
Jaccard similarity with the whole, so items are partitioned by size: for the
items of 2^c to 2^(c+1)-1 shingles, documents are read through windows of
2^(c+2) shingles that overlap by half. An item then lies wholly in some window,
their Jaccard similarity is at least 0.8 / 4.2, and one equal value among
``HASHES`` MinHash values makes a candidate; at that similarity all values
differ with a chance of about 1e-6. Each candidate is verified against the
shingle set of the whole document, so that also scattered passages count.

Defined results: null and empty texts and items leak nothing. An item of one to
four words has one shingle, all its words; it is searched among all runs of as
many words of each document. Items of equal text are all reported.
Repeated documents are reported each. Whole texts are searched, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, columns, free, saved
from .textcode import SHINGLE, hash_parameters, minhash, shingle_sets, shingles, words

HASHES = 64
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))


@dataclass
class SizeClass:
    """Items of one size class: for each hash function their sorted minima and a bit table over the low 16 bits."""

    block: int
    minima: np.ndarray  # (HASHES, items), sorted
    items: np.ndarray  # (HASHES, items), in the order of the minima
    table: np.ndarray  # (HASHES, 65536) of bool


@dataclass
class ItemIndex:
    ids: list[list[int | None]]
    sets: list[np.ndarray]
    classes: list[SizeClass]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by words of an item, fewer than a shingle's: sorted fingerprints and items
    threshold: float

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], threshold: float) -> ItemIndex:
        known: dict[bytes, int] = {}
        ids, sets = [], []
        few: dict[int, dict[int, int]] = {}
        texts = [text for _, text in rows]
        for (item, text), found, n in zip(rows, shingle_sets(texts), np.diff(words(texts)[1]).tolist(), strict=True):
            if not n:
                continue
            if n < SHINGLE:
                at = few.setdefault(n, {}).setdefault(int(shingles([text], n)[0][0]), len(sets))
                if at == len(sets):
                    sets.append(found)
                    ids.append([])
                ids[at].append(item)
                continue
            at = known.setdefault(found.tobytes(), len(sets))
            if at == len(sets):
                sets.append(found)
                ids.append([])
            ids[at].append(item)
        classes = []
        size = np.array([int(len(s)).bit_length() - 1 for s in sets], np.int64)
        size[np.array([at for found in few.values() for at in found.values()], np.int64)] = -1
        for c in np.unique(size[size >= 0]):
            members = np.flatnonzero(size == c)
            at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in members])])
            values = minhash(np.concatenate([sets[i] for i in members]), at, HASHES).T
            order = np.argsort(values, axis=1, kind="stable")
            table = np.zeros((HASHES, 1 << 16), bool)
            for k in range(HASHES):
                table[k, values[k] & 0xFFFF] = True
            classes.append(SizeClass(2 << int(c), np.take_along_axis(values, order, 1), members[order], table))
        short = {}
        for n, found in few.items():
            values = np.array(sorted(found), np.uint64)
            short[n] = values, np.array([found[int(v)] for v in values], np.int64)
        return cls(ids, sets, sorted(classes, key=lambda x: x.block), short, threshold)

    def candidates(self, found: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with an equal MinHash value in some window."""
        count = np.diff(at)
        pairs: set[tuple[int, int]] = set()
        if not self.classes or not len(found):
            return pairs
        a, b = hash_parameters(HASHES)
        low = (found >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(low)
        layout = []
        for c in self.classes:
            blocks = -(-count // c.block)
            doc = np.repeat(np.arange(len(count)), blocks)
            first = np.cumsum(blocks) - blocks
            begin = np.repeat(at[:-1], blocks) + (np.arange(len(doc)) - np.repeat(first, blocks)) * c.block
            layout.append((doc, begin, np.append(doc[1:] == doc[:-1], False)))
        for k in range(HASHES):
            np.multiply(low, a[k], out=value)
            value += b[k]
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            finer, finer_begin = value, None
            for c, (doc, begin, joined) in zip(self.classes, layout, strict=True):
                # Blocks of a class are unions of blocks of the finer class.
                places = begin if finer_begin is None else np.searchsorted(finer_begin, begin)
                smallest = np.minimum.reduceat(finer, places)
                finer, finer_begin = smallest, begin
                window = smallest.copy()
                both = np.flatnonzero(joined)
                window[both] = np.minimum(smallest[both], smallest[both + 1])
                hit = np.flatnonzero(c.table[k].take(window & np.uint32(0xFFFF)))
                if not len(hit):
                    continue
                lo = np.searchsorted(c.minima[k], window[hit], "left")
                hi = np.searchsorted(c.minima[k], window[hit], "right")
                for w, x, y in zip(hit[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                    pairs.update((int(doc[w]), int(i)) for i in c.items[k, x:y])
        return pairs

    def short_leaks(self, texts: list[str | None]) -> set[tuple[int, int]]:
        """(document, item) pairs where the document holds all words of a short item, one after another."""
        pairs: set[tuple[int, int]] = set()
        for n, (values, items) in self.short.items():
            found, at = shingles(texts, n)
            place = np.minimum(np.searchsorted(values, found), len(values) - 1)
            hit = np.flatnonzero(values[place] == found)
            doc = np.searchsorted(at, hit, "right") - 1
            pairs.update(zip(doc.tolist(), items[place[hit]].tolist(), strict=True))
        return pairs

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        found, at = shingles(texts)
        out: list[list[dict]] = [[] for _ in texts]
        whole: dict[int, np.ndarray] = {}
        short = self.short_leaks(texts)
        for doc, item in sorted(self.candidates(found, at) | short):
            if (doc, item) in short:
                out[doc] += [{"item_id": i, "containment": 1.0} for i in self.ids[item]]
                continue
            if doc not in whole:
                whole = {doc: np.unique(found[at[doc] : at[doc + 1]])}
            own, text = self.sets[item], whole[doc]
            place = np.minimum(np.searchsorted(text, own), len(text) - 1)
            share = np.count_nonzero(text[place] == own) / len(own)
            if share >= self.threshold - 1e-12:
                out[doc] += [{"item_id": i, "containment": float(share)} for i in self.ids[item]]
        return out


def item_blocks(items: DataFrame, threshold: float, most_items: int, most_chars: int):
    """Item indexes of bounded size, one after another."""
    known = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-size["n"] // most_items), -(-(size["chars"] or 0) // most_chars))
    for b in range(blocks):
        mine = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield ItemIndex.of(sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=str), threshold)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, most_items: int = 20_000, most_chars: int = 32_000_000, name: str = "leaks") -> DataFrame:
    """Add an array of (item_id, containment) to each row of ``docs``.

    Items are broadcast in blocks of about ``most_items`` and ``most_chars``. More of
    them mean more passes over the documents, each written before the next, so that
    a task holds the index of one block only.
    """
    out, spare = docs, free(docs, name + "_more")
    for number, index in enumerate(item_blocks(items, threshold, most_items, most_chars)):
        if number:
            out = saved(out, "leaks")
        shared = docs.sparkSession.sparkContext.broadcast(index)
        column = name if number == 0 else spare
        out = add_columns(out, ["text"], T.StructType([T.StructField(column, LEAKS)]), lambda texts, shared=shared: [shared.value.leaks(texts)])
        if number:
            out = out.withColumn(name, F.concat(name, spare)).drop(spare)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that leak no item."""
    name = free(docs, "leaks")
    return find_leaks(docs, items, threshold, name=name).where(F.size(name) == 0).select(*columns(docs.columns))
