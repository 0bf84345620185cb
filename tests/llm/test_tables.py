"""Near copies, leaks and main texts of whole tables and made pages, against plain walks."""

import html
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from folio.llm import queries
from folio.llm.html_text import extract

DATA = os.environ.get("FOLIO_TEST_TABLES", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def shingled(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


@needs_tables
def test_no_link_of_the_table_is_lost(spark):
    """Every document's links, counted over all pairs that share a shingle; so recall is 1."""
    docs = [(r["doc_id"], shingled(r["text"])) for r in table("documents")]
    holders = defaultdict(list)
    for at, (_, own) in enumerate(docs):
        for shingle in own:
            holders[shingle].append(at)
    links, root = Counter(), list(range(len(docs)))
    common = Counter()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                common[a, b] += 1

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if n >= 0.8 * (len(docs[a][1]) + len(docs[b][1]) - n) - 1e-9:
            links[docs[a][0]] += 1
            links[docs[b][0]] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert sum(links.values()) > 100
    smallest = defaultdict(lambda: 1 << 62)
    for at, (i, _) in enumerate(docs):
        smallest[top(at)] = min(smallest[top(at)], i)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in queries.op3_ngram_jaccard_join(spark, DATA).collect()}
    assert got == {i: (links[i], smallest[top(at)]) for at, (i, _) in enumerate(docs)}


@needs_tables
def test_no_leak_of_the_table_is_lost(spark):
    """Containment of every item in every document; so recall is 1."""
    items = [(r["item_id"], shingled(r["text"])) for r in table("benchmark")]
    expected = {}
    for r in table("documents"):
        own = shingled(r["text"])
        for item, wanted in items:
            if wanted and len(wanted & own) >= 0.8 * len(wanted) - 1e-9:
                expected[r["doc_id"], item] = len(wanted & own) / len(wanted)
    assert expected
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in queries.op7_decontamination(spark, DATA).collect()}
    assert got == pytest.approx(expected)


RNG = np.random.default_rng(21)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "rt", "l") for c in ("a", "o", "ein", "ish")]
#: What stands around an article, in the ways that pages name it.
AROUND = [
    "<nav><ul><li><a href=/>{0}</a></li><li><a href=/x>{1}</a></li></ul></nav>", "<header><h1><a href=/>{0}</a></h1><p>{1}</p></header>", "<div class='site-footer'><p>{0}</p><p>{1}</p></div>",
    "<footer><p>{0} <a href=#>{1}</a></p></footer>", "<aside><h3>{0}</h3><p>{1}</p></aside>", "<div id=sidebar><p>{0}</p></div>", "<div class='cookie-notice'>{0} <button>{1}</button></div>",
    "<form action=/s><label>{0}</label><input name=q></form>", "<script>var x = '<p>{0}</p>';</script>", "<style>p {{ color: red }}</style>", "<div class=ad>{0}</div>", "<div class='menu main'><a href=1>{0}</a> <a href=2>{1}</a></div>",
]
INSIDE = ["<div class=ad>{0}</div>", "<!-- {0} -->", "<script>{0}</script>", "<div class='related-posts'><a href=1>{0}</a></div>", "<aside>{0}</aside>", "<form><p>{0}</p></form>"]
AFTER = ["<div class=comments><h3>Comments</h3><p>{0}</p><p>{1}</p></div>", "<section id=comments><p>{0}</p></section>", "<h3>3 Comments</h3><div><p>{0}</p></div>"]


def said(n):
    return " ".join(WORDS[i] for i in RNG.integers(0, len(WORDS), n)).capitalize()


def paragraph():
    return ", ".join(said(int(RNG.integers(5, 12))) for _ in range(int(RNG.integers(2, 6)))) + "."


def noise(choice):
    return choice[int(RNG.integers(len(choice)))].format(said(3), said(6))


def made_page(body):
    """A page and the text of its article."""
    wanted, inner = [said(5)], []
    inner.append(f"<h1>{wanted[0]}</h1>")
    for _ in range(int(RNG.integers(3, 9))):
        kind = int(RNG.integers(6))
        if kind == 0:
            wanted.append(said(3))
            inner.append(f"<h2 class=title>{wanted[-1]}</h2>")
        elif kind == 1:
            some = [said(6) for _ in range(3)]
            wanted += some
            inner.append("<ul>" + "".join(f"<li>{x}" for x in some) + "</ul>")
        elif kind == 2:
            inner.append(noise(INSIDE))
        text = paragraph() + " a < b & cé"
        wanted.append(text)
        shown = html.escape(text).replace("é", "&eacute;").replace(" ", "\n  ", 1)
        words = shown.split(" ")
        words[2] = f"<span class='comment-free'><a class=related href=/y>{words[2]}</a></span>"
        inner.append(f"<p class='social-history'>{' '.join(words)}</p>")
    after = noise(AFTER) if RNG.random() < 0.4 else ""
    before, behind = ["".join(noise(AROUND) for _ in range(int(RNG.integers(0, 4)))) for _ in range(2)]
    page = f"<!DOCTYPE html><html><head><title>{said(2)}</title></head><body>{before}{body.format(''.join(inner) + after)}{behind}</body></html>"
    return page, "\n".join(" ".join(t.split()) for t in wanted)


@pytest.mark.parametrize("body", ["<article>{0}</article>", "<main><article class=post>{0}</article></main>", "<div class=content>{0}</div>", "<div class='layout no-sidebar'><div id=main>{0}</div></div>", "<div><div>{0}</div></div>"])
def test_articles_come_out_whole_and_alone(body):
    for _ in range(40):
        page, wanted = made_page(body)
        assert extract(page) == wanted, page
