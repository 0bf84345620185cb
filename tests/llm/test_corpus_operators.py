"""WARC, near-duplicate, decontamination, search, mixing and pipeline on small inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import common, components, decontaminate, mixing, near_duplicates, top_k, warc
from folio.llm.textcode import shingle_sets

RNG = np.random.default_rng(7)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, pool=None):
    return " ".join((pool or WORDS)[i] for i in RNG.integers(0, len(pool or WORDS), n))


def changed(text, every):
    return " ".join("zz" + w if i % every == every - 1 else w for i, w in enumerate(text.split()))


def shingled(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


# ------------------------------------------------------------------------ WARC


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + prose(30_000) + "</p>"
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 60), (7, "a\r\nb", "é" * 60), (None, "n", big), (1, "again", big), (8, "u", "x" * 99), (9, "u", "x" * 99)]
    pages = spark.createDataFrame([(*r, "junk") for r in rows], "page_id long, url string, html string, record string")
    base = common.scratch_path(spark, "test-warc")
    index = warc.write_archive(pages, base, shard_bytes=50_000)
    got = warc.read_records(index, base).collect()
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        mine = [r for r in got if r["page_id"] == page and r["payload_digest"] == hashlib.sha256(data).hexdigest()]
        twins = [p for p, _, h in rows if h == html and p is not None]
        again = len(data) >= 100 and page != min(twins)
        assert mine
        for r in mine:
            assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(data), "revisit" if again else "response", min(twins) if again else None)
            assert r["payload"] == (None if again else data)
    one = warc.read_records(index.where("url = 'http://a/1'"), base).collect()
    assert [r["url"] for r in one] == ["http://a/1"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_files_are_plain_gzip(spark):
    import gzip
    from pathlib import Path

    base = common.scratch_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, "u", prose(40)) for i in range(20)], "page_id long, url string, html string")
    warc.write_archive(pages, base)
    files = list(Path(base.removeprefix("file:")).glob("shard=*/part-*"))
    assert b"".join(gzip.decompress(f.read_bytes()) for f in files).count(b"WARC/1.1\r\n") == 20


@pytest.mark.parametrize(("chunk", "step"), [(7, 3), (64, 1000), (1 << 20, 1 << 15)])
def test_records_are_found_in_any_pieces(chunk, step):
    import io

    made = [warc.gzip_member(warc.make_record(i or None, f"u{i}", "d" * 64, None, bytes(range(256)) * (40 * i))) + warc.EMPTY_MEMBER for i in range(4)]
    found = list(warc.members(io.BytesIO(b"".join(made)), chunk, step))
    assert [(o, n) for o, n, _ in found] == [(sum(map(len, made[:i])), len(made[i])) for i in range(4)]
    assert [warc.header(h)["WARC-Target-URI"] for _, _, h in found] == ["u0", "u1", "u2", "u3"]
    assert list(warc.members(io.BytesIO(b""), chunk, step)) == []
    for cut in (40, 5):
        with pytest.raises(ValueError, match="within a record"):
            list(warc.members(io.BytesIO(made[1][:-cut]), chunk, step))


# ------------------------------------------------------------- near duplicates


def duplicate_table():
    rows, texts = [], []
    for group in range(12):
        base = prose(60 + 15 * group)
        texts += [base, base, changed(base, 97), changed(base, 31), changed(base, 12), base.upper() + "!!"]
    chain = prose(120)
    for step in range(8):
        chain = chain.replace(chain.split()[step * 13], f"q{step}")
        texts.append(chain)
    texts += ["a b c", "A  b, c", "one", "", None, None, "...", prose(20_000)]
    rows = [(int(i), t, "x", "y") for i, t in zip(RNG.permutation(len(texts)) + 100, texts, strict=True)]
    return rows


def expected_classes(rows, threshold=0.8):
    sets = [shingled(t) for _, t, *_ in rows]
    links, root = Counter(), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    smallest = {}
    for i, row in enumerate(rows):
        smallest[top(i)] = min(smallest.get(top(i), row[0]), row[0])
    return {row[0]: (smallest[top(i)], links[i]) for i, row in enumerate(rows)}


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    """With blocks of 4, groups are spread over pairs of blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = duplicate_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, node string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_report(docs).collect()}
    assert got == expected_classes(rows)


def test_links_to_empty_blocks_are_not_counted_again(spark, monkeypatch):
    """With blocks of 1, as many blocks as texts, some of them get none."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 1)
    rows = duplicate_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, node string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.near_report(docs).collect()}
    assert got == expected_classes(rows)


@pytest.mark.parametrize("small_rows", [100, 0])
def test_rows_that_share_a_doc_id_bring_one_text_per_node(spark, small_rows):
    texts = [prose(30) for _ in range(40)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)] * 3 + [(8, texts[0]), (None, None), (7, "")]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    ids = near_duplicates.fingerprint_list(texts)
    reps = spark.createDataFrame([(n, None if i % 2 else 7) for i, n in enumerate(ids)], "id long, first_id long")
    got = near_duplicates.node_texts(base, reps, small_rows).collect()
    assert sorted((r["id"], r["text"]) for r in got) == sorted(zip(ids, texts, strict=True))
    near = near_duplicates.near_report(base.union(spark.createDataFrame([(None, changed(t, 29)) for t in texts], base.schema)))
    assert near.where("n_text_links = 1 and n_links in (1, 2, 3, 4, 5)").count() == len(rows) - 2 + len(texts)


def test_one_row_of_each_class_stays(spark):
    rows = duplicate_table()
    rows += [rows[0], (rows[0][0], "quite another text of the same number", "x", "y"), (None, prose(30), "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Node string, head string")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    sets = [shingled(r["text"]) for r in got]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    heads = {c for c, _ in expected_classes(rows[:-3]).values()}
    assert heads <= {r["doc_id"] for r in got}
    assert sum(r["text"] is None or not shingled(r["text"]) for r in got) == 4
    assert sum(r["doc_id"] is None for r in got) == 1
    assert near_duplicates.keep_one(docs.limit(0)).count() == 0
    assert near_duplicates.near_report(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_pruning_keeps_likely_pairs():
    need = near_duplicates.fewest_equal(0.8)
    assert len(need) == near_duplicates.HASHES // near_duplicates.STEP
    assert all(a < b for a, b in zip(need, need[1:], strict=False))
    assert need[-1] < 0.8 * near_duplicates.HASHES


def test_same_word_gives_the_same_shingle_anywhere():
    a, b = shingle_sets(["x y z v w", "pre " * 50 + "x y z v w"])
    assert a[0] in b


# ------------------------------------------------------------- decontamination


def test_leaks_match_all_pairs(spark, monkeypatch):
    items = [(i, prose(n)) for i, n in enumerate([5, 9, 20, 33, 64, 120, 300])]
    items += [(20, items[2][1]), (21, None), (22, ""), (23, "two words"), (None, items[3][1])]
    docs = []
    for i, (_, text) in enumerate(items):
        if text and len(text.split()) > 4:
            half = len(text.split()) // 2
            docs += [prose(700) + " " + text + " " + prose(300), changed(text, 40) + " " + prose(50)]
            docs.append(" ".join(text.split()[:half]) + " " + prose(400) + " " + " ".join(text.split()[half:]))
            docs.append(" ".join(text.split()[:half]))
    docs += [None, "", "Two, words", prose(50), prose(30_000) + " " + items[4][1], docs[0]]
    table = spark.createDataFrame([(i, d, "x", "y") for i, d in enumerate(docs)], "doc_id long, text string, Leaks string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    for i, d in enumerate(docs):
        for item, text in items:
            own = shingled(text)
            share = len(own & shingled(d)) / len(own) if own else 0
            if share >= 0.8:
                expected[i, item] = share
    for most in (20_000, 3):
        found = decontaminate.find_leaks(table, bench, most_items=most).select("doc_id", F.explode("leaks").alias("leak"))
        got = {(r["doc_id"], r["leak"]["item_id"]): r["leak"]["containment"] for r in found.collect()}
        assert got == pytest.approx(expected)
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in expected}
    assert decontaminate.clean(table, bench.limit(0)).count() == len(docs)
    assert decontaminate.clean(table.limit(0), bench).count() == 0


def test_short_items_are_found_inside_longer_documents(spark):
    items = [(1, "Zebra"), (2, "green, zebra"), (3, "a big green zebra"), (4, "zebra"), (5, "green zebra sat on the old mat"), (6, "...")]
    docs = [(1, f"{prose(900)} a big GREEN zebra {prose(900)}"), (2, "green zebra"), (3, f"{prose(50)} zebra green {prose(50)}"), (4, "green zebras"), (5, "big green"), (6, "zebra"), (7, ""), (8, None)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(table, bench).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").collect()
    assert all(r["containment"] == 1 for r in found)
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4), (3, 1), (3, 4), (6, 1), (6, 4)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(table, bench).collect()) == [4, 5, 7, 8]


# ---------------------------------------------------------------------- search


def search_slowly(docs, queries, k):
    bags = [(i, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q, text in queries:
        found = []
        for i, bag in bags:
            score = 0.0
            for w in set(re.findall(r"[^\W_]+", (text or "").lower())) & set(bag):
                idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                score += idf * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
            if score > 0:
                found.append((-round(score, 7), math.inf if i is None else i))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("size", [16_384, 50])
def test_search_matches_brute_force(spark, size):
    often = [f"o{i}" for i in range(12)]
    docs = [(i, prose(int(RNG.integers(5, 40))) + " " + prose(20, often)) for i in range(400)]
    docs += [(500 + i, docs[i][1]) for i in range(30)] + [(600, None), (601, ""), (602, "onlyhere"), (None, docs[0][1]), (603, prose(9_000))]
    queries = [(q, docs[q][1]) for q in (0, 20, 40, 33)] + [(900, "absent"), (901, None), (902, "o1 o2"), (903, "onlyhere o3"), (0, docs[0][1])]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    asked = spark.createDataFrame(queries, "query_id long, text string")
    rows = top_k.search(table, asked, 10, shard_docs=size).orderBy("query_id", "rank").collect()
    expected = search_slowly(docs, queries, 10)
    for q, best in expected.items():
        mine = [r for r in rows if r["query_id"] == q]
        assert [math.inf if r["doc_id"] is None else r["doc_id"] for r in mine] == [i for _, i in best]
        assert [r["score"] for r in mine] == pytest.approx([-s for s, _ in best], abs=1e-6)
    several = top_k.search(table, asked, 10, most_chars=200).orderBy("query_id", "rank").collect()
    assert several == rows
    assert top_k.search(table.limit(0), asked).count() == 0
    assert top_k.search(table, asked.limit(0)).count() == 0


def test_search_skips_postings_and_loses_nothing():
    """On words as frequent as in texts, more than half of the queries' postings are never read."""
    rng = np.random.default_rng(11)
    shares = 1 / np.arange(1, 8_001)
    texts = [" ".join(f"t{w}" for w in rng.choice(8_000, int(rng.integers(60, 200)), p=shares / shares.sum())) for _ in range(2_500)]
    mean = sum(len(t.split()) for t in texts) / len(texts)
    rows = [top_k.packed([top_k.Piece.of(list(range(a, a + 500)), texts[a : a + 500])]) for a in range(0, 2_500, 500)]
    df = Counter(w for t in texts for w in set(t.split()))
    words = sorted(df)
    number = {w: int(top_k.words([w])[0][0]) for w in words}
    vocabulary = np.array(sorted(number.values()), np.uint64)
    idf = np.zeros(len(words))
    for w in words:
        idf[np.searchsorted(vocabulary, np.uint64(number[w]))] = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
    asked = [np.unique([np.searchsorted(vocabulary, np.uint64(number[w])) for w in set(texts[q].split())]) for q in range(0, 2_500, 100)]
    block = top_k.QueryBlock(0, np.arange(len(asked)), np.cumsum([0, *map(len, asked)]), np.concatenate(asked).astype(np.int32), vocabulary, idf, np.zeros((len(asked), 5)))
    shards = [top_k.Shard([row], mean) for row in rows]
    found = {}
    for number_, shard in enumerate(shards):
        query, doc, score = shard.search(block, 5)
        for q, d, s in zip(query.tolist(), doc.tolist(), score.tolist(), strict=True):
            found.setdefault(q, []).append((-s, int(shard.ids[shard.id_begin[d]])))
    expected = search_slowly(list(enumerate(texts)), [(q, texts[100 * q]) for q in range(len(asked))], 5)
    for q, best in expected.items():
        mine = sorted((round(s, 7), i) for s, i in found[q])[:5]
        assert [i for _, i in mine] == [i for _, i in best]
    later = shards[1:]  # the first shard begins without a threshold
    assert sum(s.walked for s in later) < 0.5 * sum(s.listed for s in later)


def test_search_gathers_few_postings_of_frequent_words():
    """More queries than go together, on two vocabularies: what is gathered one by one is the rare words' and a few candidates'."""
    rng = np.random.default_rng(12)
    shares = 1 / np.arange(1, 2_001)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in rng.choice(2_000, 120, p=shares / shares.sum())) for i in range(2_000)]
    rows = [top_k.packed([top_k.Piece.of(list(range(a, a + 1_000)), texts[a : a + 1_000])]) for a in (0, 1_000)]
    df = Counter(w for t in texts for w in set(t.split()))
    number = {w: int(top_k.words([w])[0][0]) for w in df}
    vocabulary = np.array(sorted(number.values()), np.uint64)
    place = {w: int(np.searchsorted(vocabulary, np.uint64(n))) for w, n in number.items()}
    idf = np.zeros(len(df))
    for w, n in df.items():
        idf[place[w]] = math.log(1 + (len(texts) - n + 0.5) / (n + 0.5))
    asked = [np.unique([place[w] for w in set(t.split())]) for t in texts[::20]]
    block = top_k.QueryBlock(0, np.arange(len(asked)), np.cumsum([0, *map(len, asked)]), np.concatenate(asked), vocabulary, idf, np.zeros((len(asked), 5)))
    shards, found = [top_k.Shard([row], 120.0) for row in rows], {}
    for shard in shards:
        for q, d, s in zip(*(x.tolist() for x in shard.search(block, 5)), strict=True):
            found.setdefault(q, []).append((round(-s, 7), int(shard.ids[shard.id_begin[d]])))
    for q, best in search_slowly(list(enumerate(texts)), list(enumerate(texts[::20])), 5).items():
        assert sorted(found[q])[:5] == [(pytest.approx(s, abs=2e-7), i) for s, i in best]
    assert shards[1].gathered < 0.35 * shards[1].listed


def test_search_of_many_copies_and_the_largest_id(spark):
    same = "alpha beta gamma"
    docs = [((1 << 63) - 1 - i, same) for i in range(40)] + [(None, same), (3, "alpha"), (4, "delta")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, same), (2, same), ((1 << 63) - 1, "gamma alpha")], "query_id long, text string")
    rows = top_k.search(table, asked, 4).orderBy("query_id", "rank").collect()
    smallest = sorted(i for i, _ in docs if i is not None and i > 9)[:4]
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(q, d) for q in (1, 2, (1 << 63) - 1) for d in smallest]
    few = top_k.search(table.where("doc_id is null or doc_id = 3"), asked.limit(1), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in few] == [None, 3]


# ---------------------------------------------------------------------- mixing


def targets_slowly(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def mixed_table(spark):
    rows = []
    for i in range(3000):
        source = (None, "a", "b", "", "Z", "é", "hot", "hot", "hot")[i % 9]
        rows.append((i, "w " * int(RNG.integers(1, 200)), source, "k", "c"))
    rows += [(None, "x y", "a", "k", "c"), (5000, None, "lonely", "k", "c"), (5001, "", "b", "k", "c"), (7, "w w", "hot", "k", "c"), (7, "w w", "hot", "k", "c"), (8, "a b\x0bc\td", "a", "k", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, source_key string, Copy string")


def test_mix_meets_its_targets(spark):
    rows, docs = mixed_table(spark)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = targets_slowly(sizes)
    by_size = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by_size[r["source_size"]] = r["target"]
        taken[r["source_size"]] += r["taken"]
    for source, size in sizes.items():
        assert by_size[size] == pytest.approx(expected[source])
        assert abs(taken[size] - expected[source]) <= 200
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))


def test_each_document_draws_with_its_sources_fraction(spark):
    """Over many seeds (names of the source) a document is taken as often as the fraction says, and totals stay near the target."""
    sizes = [1 + (7 * i) % 40 for i in range(60)]
    rows = [(i, "w " * n, f"{seed:03}") for seed in range(150) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame([(1000 * int(s) + i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    taken, rates = Counter(), {}
    for r in got:
        taken[r["doc_id"] // 1000] += r["taken"]
        rates[r["doc_id"] // 1000] = r["target"] / r["source_size"]
    extra = Counter()
    for r in got:
        rate = rates[r["doc_id"] // 1000]
        extra[r["doc_id"] % 1000] += r["taken"] // r["size"] - int(rate) - (rate - int(rate))
    for seed, rate in rates.items():
        assert abs(taken[seed] - rate * sum(sizes)) <= 1.5 * max(sizes)
    # Each sum over 150 seeds of what was drawn less what was due has a spread of at most 6.2.
    assert max(abs(x) for x in extra.values()) < 4 * 6.2


def test_mix_emits_the_copies_that_the_report_counts(spark):
    _, docs = mixed_table(spark)
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "source_key", "copy"]
    words = out.select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert words == mixing.mix_report(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.max("copy")).first()[0] <= 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix_report(docs.limit(0)).count() == 0


# -------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    common_words = [f"v{c}{d}" for c in "aeiou" for d in "bcdfghklmnprst"]
    good = [prose(120, common_words) + "." for _ in range(60)]
    bad = [" ".join(w + "###" for w in prose(80, common_words).split()) for _ in range(40)]
    texts = good + bad + [good[0], changed(good[1], 50), None, "", "123 456", prose(50, common_words) + " " + " ".join(WORDS[:30])]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, leaks string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 60), 0) for i in range(100)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(WORDS[:30])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = common.saved(stage(spark, current, str(tmp_path)), name)
        assert current.columns == docs.columns
        kept.append({r["doc_id"] for r in current.collect()})
    assert not kept[0] & set(range(60, 100)) and set(range(60)) <= kept[0]
    assert not kept[1] & {102, 103, 104} and set(range(60)) <= kept[1]
    assert kept[1] - kept[2] <= {100, 101} and {100, 101} & kept[1] == kept[1] - kept[2]
    assert kept[2] - kept[3] == {105} & kept[2]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in mixed.collect()} <= kept[3]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    empty = current.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
