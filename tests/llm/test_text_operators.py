"""HTML, language, quality, toxicity and URL operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import html_text, language_id, quality, toxicity, url_filter

EN = "the cat sat on the mat and the dog ran to the house with a stick that was there "
DE = "der hund lief in das haus und die katze sass auf der matte mit einem stock "
LONG = EN * 4000


# ------------------------------------------------------------------------ HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("a < b and c &amp;lt; d", "a < b and c &lt; d"),
        ("<p>one<p>two <b>bold</b><br>more", "one\ntwo bold more"),
        ("<nav>x</nav><article><h1>T</h1><p>a&nbsp; b\n c</p><aside>no</aside><form>f</form></article><footer>z</footer>", "T\na b c"),
        ("<div id=content><p>Hello, my friend, here.</p><p>More, of it.</p><div class='comments'><p>bad, bad, bad</p></div></div><div id=sidebar><p>x, y</p></div>", "Hello, my friend, here.\nMore, of it."),
        ("<script>var t='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<ul><li>one<li>two</ul><p>three, four</p>", "one\ntwo\nthree, four"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>cut <a href='x", "cut"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        ("<article><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>text</p></article>", "text"),
        ("</p></div>stray</b>", "stray"),
        ("<p>deep" + "<div>" * 3000 + "x", "deep\nx"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


ARTICLE = "<h1>T</h1><p>One, of the article, here.</p><p>Two, of it.</p>"
ARTICLE_TEXT = "T\nOne, of the article, here.\nTwo, of it."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content-sidebar-wrap"><main><article>{ARTICLE}</article></main></div>',
        f'<div class="sidebar-wrap"><main><article>{ARTICLE}</article></main><div class=sidebar><p>no</p></div></div>',
        f'<div class="layout no-sidebar">{ARTICLE}</div>',
        f'<div class="page has-menu"><div class=menu><p>no</p></div><div>{ARTICLE}</div></div>',
        f'<body><div class="page menu">{ARTICLE}<div class="comments"><p>no, no</p></div></div><div class=ad>no</div></body>',
        f'<main><div class="widget">{ARTICLE}</div><div class="comments"><p>no</p></div></main>',
        f'<div class="promo">{ARTICLE}</div>',
        f'<span class="menu page"><article>{ARTICLE}</article></span><p>no</p>',
        f'<article>{ARTICLE}<div class="related"><article>no</article></div></article>',
    ],
)
def test_names_of_wrappers_do_not_hide_the_article(page):
    assert html_text.extract(page) == ARTICLE_TEXT


def test_names_leave_more_than_a_title():
    text = "word, " * 60
    assert html_text.extract(f"<main><h1>T</h1><div class=promo><p>{text}</p></div></main>") == "T\n" + text.strip()
    assert html_text.extract("<main><h1>T</h1><div class=ad><p>no</p></div></main>") == "T"


TEN = "".join(f"<p>Line {i}, of the article, of some length.</p>" for i in range(10))
TEN_TEXT = "\n".join(f"Line {i}, of the article, of some length." for i in range(10))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><section>{TEN}</section><section><p>Short.</p></section></div>", TEN_TEXT + "\nShort."),
        (f"<div><section>{TEN}</section><h3>H</h3><ul><li>one<li>two</ul><ol><li>three</ol></div>", TEN_TEXT + "\nH\none\ntwo\nthree"),
        (f"<div><section>{TEN}</section><table><tr><td>a<td>b</table><figure><figcaption>f</figcaption></figure><dl><dt>t<dd>d</dl><div>box</div></div>", TEN_TEXT + "\na\nb\nf\nt\nd\nbox"),
        (f"<div>Before <section>{TEN}</section> after</div>", f"Before\n{TEN_TEXT}\nafter"),
        (f"<body><div><div><section>{TEN}</section></div><div><section><p>Short.</p></section></div></div></body>", TEN_TEXT + "\nShort."),
        (f"<div id=a><div><div><section>{TEN}</section><section><p>Short.</p></section></div><div><section>{TEN}</section></div></div></div>", f"{TEN_TEXT}\nShort.\n{TEN_TEXT}"),
        (f"<body><div><section>{TEN}</section><div class=sidebar><p>no</p></div><ul><li><a>no</a></ul></div><div><a>no</a> no</div><footer>no</footer></body>", TEN_TEXT),
    ],
)
def test_parts_of_the_article_beside_the_best_stay(page, text):
    assert html_text.extract(page) == text


def test_pages_keep_other_columns_and_replace_outputs(spark):
    pages = spark.createDataFrame([(1, None, "old"), (1, "<p>é😀</p>", "old"), (None, "<p>" + LONG + "</p>", "old")], "page_id long, html string, Text string")
    got = html_text.extract_pages(pages)
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 2, len(LONG.strip())]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# -------------------------------------------------------------------- language


def slow_phrases(text: str, sample: str) -> int:
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count += 1
        i += n
    return count


def test_parsing_counts_the_longest_phrases():
    sample, texts = EN * 2 + "xyzzy", [EN[3:], "qqq the dog", "a", "zyx the the cat ran", ("dog house qq " * 90)]
    model = language_id.Automaton.of(language_id.normalised([sample])[0])
    codes, starts = language_id.normalised(texts)
    plain = "".join(map(chr, codes))
    shown = "".join(map(chr, language_id.normalised([sample])[0]))
    expected = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        expected.append(sum(slow_phrases(plain[i : min(i + language_id.BLOCK, b)], shown) for i in range(a, b, language_id.BLOCK)))
    assert language_id.phrases(model, codes, starts).tolist() == expected


def test_languages(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "x") for i in range(8)] + [(9, None, "en", "x"), (9, "cat", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    tests = spark.createDataFrame([(1, "THE DOG RAN"), (2, None), (3, "12 !?"), (4, ""), (5, LONG), (None, "die katze"), (5, LONG)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in language_id.identify(tests, model).collect()), key=str)
    assert [(d, la) for d, la, _ in got] == [(0, "de"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    assert all(0 <= s <= 1 for _, _, s in got) and {s for d, _, s in got if d in (2, 3, 4)} == {0.0}
    assert "score" in language_id.identify(docs, model).columns
    empty = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(tests, empty).collect()} == {"und"}


def test_every_labelled_language_is_learned(spark):
    """Seventy languages of a few texts each, one of them written with thousands of letters."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(70):
        letters = [chr(97 + (k + j) % 26) for j in range(4)] + [chr(0x400 + 2 * k), chr(0x4E00 + k)]
        words = ["".join(letters[i] for i in rng.integers(0, 6, 5)) for _ in range(40)]
        rows += [(100 * k + i, " ".join(words[j] for j in rng.integers(0, 40, 30)), f"l{k:02}") for i in range(3)]
    rows += [(9000, "".join(chr(0x4E00 + i % 9000) for i in range(20_000)), "wide")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    assert len(model.languages) == 71 and max(len(a.table) for a in model.automata) <= language_id.CELLS * 1.01
    got = language_id.identify(labelled, model)
    assert got.where("lang = lang_pred").count() >= 0.95 * len(rows)
    assert len(language_id.fit(labelled, total_chars=70_000).languages) == 71


def test_copies_and_long_texts_are_learned(spark):
    few = [f"{DE} {w}" for w in ("eins", "zwei", "drei", "vier")]
    copies = spark.range(20_000).selectExpr("id AS doc_id", "element_at(array(%s), cast(id %% 4 AS int) + 1) AS text" % ", ".join(f"'{t}'" for t in few), "'de' AS lang")
    rows = [(1, LONG, "en"), (2, "7" * 200_000 + " " + "le chat noir dort sur la table " * 9000, "fr"), (3, "12 !?", "xx")]
    model = language_id.fit(copies.union(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert model.languages == ["de", "en", "fr"]
    # Each different text once, with a gap after it; of a long text 24,000 letters.
    letters = [sum(len(language_id.normalised([t])[0]) + 1 for t in few), 24_001, 24_001]
    assert [m.bits for m in model.automata] == pytest.approx(np.log2(letters))


# --------------------------------------------------------------------- quality


def good_and_bad(spark, n=240):
    rng = np.random.default_rng(1)
    words = EN.split()
    rows = []
    for i in range(n):
        said = [words[j] for j in rng.integers(0, len(words), 30)]
        rows.append((i, " ".join(said) + "." if i % 3 else " ".join(w + "###" for w in said), int(i % 3 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")


def test_quality_rules_and_their_columns_agree(spark):
    docs, labels = good_and_bad(spark)
    model = quality.fit(docs, labels)
    assert model.rules
    scored = quality.score(docs, model)
    stats = quality.statistics(docs).toPandas().sort_values("doc_id")
    by_hand = model.scores(stats[[f"__q_{s}" for s in quality.STATISTICS]].to_numpy())
    assert np.allclose(by_hand, scored.toPandas().sort_values("doc_id")["score"])
    wrong = scored.join(labels, "doc_id").where((F.col("score") >= 0.3) != (F.col("quality") == 1)).count()
    assert wrong == 0


def test_quality_edge_cases(spark):
    docs, labels = good_and_bad(spark)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, LONG, 3)], "doc_id long, text string, Score int")
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "score"]
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.fit(docs, labels.limit(0)).intercept == 0
    one = quality.fit(docs, labels.where("quality = 1"))
    assert not one.rules and one.intercept > 0
    assert quality.score(docs.limit(0), model).count() == 0


def test_rules_are_paths_and_their_weights_the_lasso_optimum():
    rng = np.random.default_rng(4)
    x = np.zeros((600, len(quality.STATISTICS)))
    x[:, :3] = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7) ^ (rng.random(600) < 0.05)).astype(float)
    penalty = 0.004
    model = quality.fit_rules(x, y, trees=6, penalty=penalty, steps=6000)
    assert 0 < len(model.rules) < 60
    assert all(1 <= len(rule) <= 3 for rule in model.rules)
    # Optimal: for a rule that is kept the slope of the loss is the penalty against its sign, and the intercept's is zero.
    wrong = model.scores(x) - y
    for rule, weight in zip(model.rules, model.weights, strict=True):
        assert (quality.holds(rule, x) * wrong).mean() == pytest.approx(-np.sign(weight) * penalty, abs=2e-4)
    assert wrong.mean() == pytest.approx(0, abs=2e-4)
    # Every rule is a path of a tree that plain recursion over all cuts grows too.
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    assert all(min(abs(cuts[at] - threshold)) < 1e-12 for rule in model.rules for at, _, threshold in rule)


def gain_slowly(x, cuts, grad, hess, least):
    best = (0.0, None, None)
    for at in range(x.shape[1]):
        for cut in cuts[at]:
            below = x[:, at] <= cut
            if least <= below.sum() <= len(x) - least:
                g, h = grad[below].sum(), hess[below].sum()
                gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - grad.sum() ** 2 / (hess.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, at, cut)
    return best[1:]


def test_trees_split_where_the_gain_is_largest():
    rng = np.random.default_rng(8)
    x = rng.random((200, 3))
    grad, hess = (x[:, 1] > 0.4) - 0.5 + 0.1 * rng.random(200), np.full(200, 0.25)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 12)[1:-1])) for j in range(3)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes = quality.grow(x, binned, cuts, grad, hess, 2, 5)
    for rule, rows, step, leaf in nodes:
        assert sorted(rows) == sorted(np.flatnonzero(quality.holds(rule, x)))
        assert step == pytest.approx(-grad[rows].sum() / (hess[rows].sum() + 1))
        children = [r for r, *_ in nodes if len(r) == len(rule) + 1 and r[: len(rule)] == rule]
        assert leaf == (not children)
        if children:
            at, _, cut = children[0][-1]
            assert (at, cut) == gain_slowly(x[rows], cuts, grad[rows], hess[rows], 5)


def test_no_filter_computes_the_statistics(spark):
    """A filter on the score holds no regular expression, however many rules there are."""
    docs = spark.createDataFrame([(1, "a b c.", "x"), (2, None, "y")], "doc_id long, text string, score string")
    for n in (1, 40):
        model = quality.RuleModel(0.1, [((i % 11, True, float(i)),) for i in range(n)], [0.1] * n)
        kept = quality.score(docs, model).where("score >= 0.3")
        assert kept.count() == 2
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert filters and not any("regexp" in line for line in filters)
        assert plan.count("regexp_replace") <= 8


# -------------------------------------------------------------------- toxicity


def test_toxicity_chain(spark):
    rng = np.random.default_rng(2)
    words = EN.split()
    rows = []
    for i in range(300):
        said = [words[j] for j in rng.integers(0, len(words), 20)] + (["grumbly"] if i % 4 == 0 else []) + (["blargosaurus" + "abc"[i % 3]] if i % 8 == 0 else [])
        rows.append((i, " ".join(said), int(i % 8 == 0), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(None, 1, 1), (5, None, 0)], "doc_id long, rough int, toxic int")
    chain = toxicity.fit(docs, labels, ["rough", "toxic"])
    assert len(chain.models[1].weights) == len(chain.vocabulary) + 1
    got = toxicity.predict(docs, chain).join(labels, "doc_id").dropna()
    assert got.where("is_rough <> rough or is_toxic <> toxic").count() == 0
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, LONG + " grumbly", "x"), (3, LONG, "x")], "doc_id long, text string, P_TOXIC string")
    found = toxicity.predict(odd, chain)
    assert [c.lower() for c in found.columns].count("p_toxic") == 1
    assert {(r["doc_id"], r["is_toxic"]) for r in found.collect()} == {(None, 0), (1, 0), (2, 1), (3, 0)}
    none = toxicity.fit(docs, labels.limit(0), ["toxic"])
    assert toxicity.predict(docs.limit(0), none).count() == 0


def dense(rows, columns, n, width):
    x = np.zeros((n, width))
    x[rows, columns] = 1
    return x


def test_a_link_reaches_the_optimum_and_sees_others_out_of_fold(monkeypatch):
    rng = np.random.default_rng(5)
    n, width = 240, 12
    x = rng.random((n, width)) < 0.3
    rows, columns = np.nonzero(x)
    first = (x[:, 0] | (rng.random(n) < 0.2)).astype(float)
    second = (x[:, 0] & x[:, 1] | (rng.random(n) < 0.1)).astype(float)
    fold = np.arange(n) % 4
    # The slope of the penalised loss is zero at the fitted weights.
    earlier = rng.random((n, 1))
    model = toxicity.fit_linear(rows, columns, n, width, earlier, first)
    all_ = np.column_stack([dense(rows, columns, n, width), earlier - 0.5])
    p = 1 / (1 + np.exp(-(all_ @ model.weights + model.intercept)))
    assert np.abs(all_.T @ (p - first) / n + 1e-5 * model.weights).max() < 1e-3 and abs((p - first).mean()) < 1e-3
    # What the second link learns from are predictions of models that did not see the row's fold.
    seen = []
    plain = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda *a, **k: seen.append(a) or plain(*a, **k))
    toxicity.fit_chain(["a", "b"], {str(i): i for i in range(width)}, rows, columns, [first, second], fold)
    whole = [a for a in seen if a[2] == n]
    assert [a[4].shape[1] for a in whole] == [0, 1]
    design = dense(rows, columns, n, width)
    for k in range(4):
        test = fold == k
        r, c = np.nonzero(design[~test])
        own = plain(r, c, int((~test).sum()), width, np.zeros((int((~test).sum()), 0)), first[~test])
        expected = 1 / (1 + np.exp(-(design[test] @ own.weights + own.intercept)))
        assert whole[1][4][test, 0] == pytest.approx(expected, abs=1e-9)


def test_severe_cases_are_the_clearer_half():
    # Two words speak for the category: word 1 only in positives, word 0 also elsewhere.
    y = np.array([1, 1, 1, 1, 0, 0, 0, 0, 0, 0.0])
    rows, columns = np.array([0, 1, 2, 3, 4]), np.array([0, 0, 1, 1, 0])
    assert toxicity.severe(rows, columns, 2, y).tolist() == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert toxicity.severe(rows[:0], columns[:0], 2, np.zeros(3)).tolist() == [0, 0, 0]


# ------------------------------------------------------------------------- URL

RULES = [("com", "/en/", "block"), ("Example.com", "/en/7", "allow"), ("net", "", "block"), (None, "/", "block"), ("x.org", "/a", "block"), ("x.org", "/a", "allow")]


def judge_slowly(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h.lower() + p, v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, key=lambda r: (len(r[0]), r[0], r[1]), default=(None, "allow"))
    return host, path, *best


URLS = [
    "http://A.example.com/en/7?x", "https://b.com/en/8#y", "http://notexample.com/en/7", "x.net/a", "http://x.net", "HTTP://X.NET?/en/", "http://q.x.org/ab://c",
    None, "", "://", "http://É.com/en/é", "http://com/en/", "http://x.org/A", "http://u@b.net:80/", "http://a..com/en/1", "a\nb://c.net/\n?",
]


@pytest.mark.parametrize("inline", [True, False])
def test_urls_follow_a_plain_walk(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_BLOCKS", 1024 if inline else 0)
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS + URLS)], "page_id long, url string, Rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: judge_slowly(u) for i, u in enumerate(URLS + URLS)}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-500 // 16)
    bloom = url_filter.build_filter(keys, blocks)
    asked = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("block", url_filter.block_of(F.col("key"), blocks)).join(bloom, "block")
    for i, mask in enumerate(url_filter.masks(F.col("key"))):
        asked = asked.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    assert asked.where("id < 500").count() == 500
    assert asked.where("id >= 500").count() < 200
