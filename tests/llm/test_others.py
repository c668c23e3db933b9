"""Operators on pages, conversations and labels, and the pipeline."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, classifier, html_extract, mixing, queries, url_filter

ARTICLE = "<p>First  paragraph of\n the &amp; article, long enough to count.</p><ul><li>An item<li>Another one</ul><p>Last &eacute; words here"


def page(body, around=True):
    menu = "<nav><a href=/>Home</a></nav><div class='sidebar left'>Side words</div>" if around else ""
    return f"<html><head><title>T</title><script>var a='</p><article>';</script></head><body>{menu}{body}<div id=comments><p>A reader says much more than the article ever did, really</p></div><footer>Foot</footer></body></html>"


def test_html_extract(spark):
    expected = "Title\nFirst paragraph of the & article, long enough to count.\nAn item\nAnother one\nLast é words here"
    rows = [
        (1, "http://a.org/1", page(f"<article><h1>Title</h1>{ARTICLE}</article>")),
        (2, "http://a.org/2", page(f"<div class='story post-17'><h1>Title</h1>{ARTICLE}</div>")),
        (3, None, page(f"<main><header><h1>Title</h1></header>{ARTICLE}</main>", False)),
        (4, "no scheme", None),
        (5, "http://a.org/5", ""),
        (None, "http://b.org", "<p>loose &lt;text&gt; <b>bold</b> x<br>y"),
        (1, "http://a.org/1", page(f"<article><h1>Title</h1>{ARTICLE}</article>")),
        (6, "http://a.org/6", "<form><p>sign up</p></form><!-- open comment"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, winner string, votes long")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.html_extract(df).collect()]
    texts = dict((k, t) for k, t, _ in got)
    assert len(got) == 8 and all(n == len(t) for _, t, n in got)
    assert texts[1] == texts[2] == texts[3] == expected
    assert texts[4] == texts[5] == texts[6] == "" and texts[None] == "loose <text> bold x y"
    assert html_extract.html_extract(df.limit(0)).collect() == []


def test_html_votes_win_over_a_page(spark):
    rows = [(k, "http://h.org/", f"<body><div class='c{k}'><p>{'words of the article ' * 9}</p></div><div class=other><p><a href=/>{'rest ' * 9}</a></p></div></body>") for k in range(9)]
    rows.append((9, "http://h.org/x", f"<body><div class=c5><p>short story</p></div><div class=other><p>{'long rest of it ' * 40}</p></div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.html_extract(df).collect()}[9] == "short story"


def test_html_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op1_html_extract(spark, sf_dir).collect()}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?p>|</?h1>", inner)]
        assert got[p.page_id] == "\n".join(x for x in parts if x)


def test_url_rules(spark):
    urls = [
        ("HTTP://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("x://com/", "com", "/", "com/", "allow"),
        ("x://com", "com", "", None, None),
        ("http://notcom/", "notcom", "/", None, None),
        ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
        ("http://É.NET/fr/", "É.net", "/fr/", "net/fr/", "block"),
        ("http://a.com/b://c", "a.com", "/b://c", "com/", "allow"),
        ("no scheme", "", "", None, None),
        ("http://?q", "", "", None, None),
        (None, "", "", None, None),
    ]
    df = spark.createDataFrame([(k, u[0], "c") for k, u in enumerate(urls)] + [(None, None, "c")], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_filter.url_filter(df.limit(0)).collect() == []


def test_url_model_separates(spark):
    rows = [(f"news{k}.org/story/of-the-day-{k}", 1) for k in range(400)] + [(f"x{k}.biz/win-cash-{k * 7}", 0) for k in range(400)]
    trained = url_filter.train(spark.createDataFrame(rows, "url string, accepted int"))
    assert trained.accuracy > 0.95


def test_classifier_held_out(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    fitted = classifier.fit(docs, labels, classifier.Setup(held_out=5))
    assert fitted.accuracy > 0.85 and fitted.thresholds[0] < fitted.thresholds[1]
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    got = {r.doc_id: r for r in classifier.classify(docs, fitted).collect()}
    assert len(got) == docs.count()
    assert sum(got[k].kept for k in toxic) <= 0.1 * len(toxic)
    assert all(0 <= r.expected_grade <= 2 and r.p_good <= r.p_not_toxic for r in got.values())


def test_classifier_fit_by_brute_force():
    """The fit's weights and thresholds minimise the weighted likelihood, written out here by its definition."""
    rng, n, bits = np.random.default_rng(3), 240, 5
    sizes = rng.integers(0, 6, n)
    cells = np.concatenate([rng.choice(1 << bits, k, replace=False) for k in sizes])
    dense = rng.normal(size=(n, 2))
    latent = dense @ [1.5, -0.5] + np.bincount(np.repeat(np.arange(n), sizes), cells < 8, n) + rng.logistic(size=n)
    grades = (latent > 0).astype(int) + (latent > 1.5)
    setup = classifier.Setup(bits=bits, rounds=3000, rate=0.01, decay=1e-2)
    weights, thresholds = classifier.fit_arrays(cells, sizes, dense, grades, setup)
    assert thresholds[0] < thresholds[1]
    x = np.zeros((n, (1 << bits) + 2))
    np.add.at(x, (np.repeat(np.arange(n), sizes), cells), 1)
    x[:, 1 << bits :] = dense

    def loss(w, cuts):
        total = 0.0
        for row, g in zip(x, grades, strict=True):
            below = [0.0, *(1 / (1 + math.exp(row @ w - c)) for c in cuts), 1.0]
            total -= math.log(below[g + 1] - below[g]) / (3 * (grades == g).sum())
        return total + setup.decay / 2 * (w @ w)

    best = loss(weights.astype(float), thresholds)
    assert best < loss(np.zeros_like(weights, float), thresholds)
    for k in [*rng.choice(1 << bits, 6, replace=False), 32, 33]:  # no step along a weight or a threshold is better
        for step in (-0.02, 0.02):
            moved = weights.astype(float)
            moved[k] += step
            assert loss(moved, thresholds) > best - 1e-6
    for k in range(2):
        for step in (-0.02, 0.02):
            assert loss(weights.astype(float), thresholds + step * (np.arange(2) == k)) > best - 1e-6


def test_classifier_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.p_good is None for r in classifier.quality_classifier(docs, none).collect())
    some = spark.createDataFrame([(0, 1, 0), (1, None, 1), (2, 0, None), (2, 1, 0), (None, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert classifier.quality_classifier(docs, some).count() == docs.count()
    assert classifier.quality_classifier(no_docs, some).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "back \\ slash \\\\ <\\| <|", "", None, "line\nbreak\n", "a" * 900, "é<|\\n|>", "<\\n|"]
    rows = [(1, k, ["user", "assistant"][k % 2], odd[k]) for k in range(8)]
    rows += [(2, k, "system" if k == 0 else ["user", "assistant"][k % 2], f"turn {k} " * (k % 9 + 1)) for k in range(60)]
    rows += [(3, 0, "system", "only"), (4, 0, None, "no role"), (5, 0, "rö\nle<|\\", "x"), (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (None, None, "assistant", "t")]
    df = spark.createDataFrame([(*r, "extra", 7) for r in rows], "conv_id long, turn long, role string, text string, window string, place long")
    for budget in (chat.Budget(), chat.Budget(160, 40, 20), chat.Budget(30, 10, 10)):
        windows = chat.chat_windows(df, budget)
        got = {r.conv_id: r for r in chat.digests(windows).collect()}
        for conv in {r[0] for r in rows}:
            own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
            said = "".join(t for role, t in own if role == "assistant")
            r = got[conv]
            assert r.n_turns == len(own)
            assert r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for a, t in own))
            assert (r.loss_chars, r.loss_sha256) == (len(said), sha(said))
        assert sum(len(w.formatted) for w in windows.collect()) == sum(r.formatted_chars for r in got.values())
    assert chat.digests(chat.chat_windows(df.limit(0))).collect() == []


def test_chat_budget_and_history(spark):
    rows = [(1, k, "system" if k == 0 else "assistant", f"{k:04d} " + "w" * 35) for k in range(50)]
    budget = chat.Budget(200, 45, 20)
    windows = sorted(chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget).collect(), key=lambda w: w.window)
    assert len(windows) > 5 and all(w.n_tokens <= budget.window for w in windows)
    for w in windows[1:]:
        assert w.formatted.startswith("<|im_start|>system\n") and w.n_repeated > 1
    learned = [w.formatted[s.start : s.end] for w in windows for s in w.loss_spans]
    assert learned == [r[3] for r in rows[1:]]


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.chat_windows(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf_dir, no_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        counts.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    ids = docs.select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(ids, ids[1:], strict=False))
    empty = no_docs.select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []


ODD = "doc_id long, text string, lang string, source string, n_chars long, part string, copies string, _id string, _nth string, row string, key string"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()


def test_pipeline_rows_are_decided_for_themselves(spark, sf_dir):
    """Each stage against brute force on null and repeated ids, under column names that the stages use themselves."""
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    a, b, leak = prose(60), prose(70), f"{prose(30)} {item} {prose(30)}"
    near = a.replace(" ", " changed ", 1)
    tags = ("p", "c", "i", "n", "r", "k")
    rows = [(3, a), (7, near), (None, a), (7, b), (7, prose(50)), (None, prose(40)), (None, prose(45)), (9, None), (9, ""), (None, None), (4, leak), (None, leak), (5, prose(80)), (5, prose(90))]
    rows = [(k, t, "en", "s" if k else None, None, *tags) for k, t in rows]
    rows += [rows[3], rows[9], (8, b, "en", "s", None, *tags)]
    docs = spark.createDataFrame(rows, ODD)
    ident = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found)
    stages = dict(corpus_pipeline.STAGES)

    left = stages["near_duplicates"](spark, docs, sf_dir)
    assert left.columns == docs.columns
    distinct = list(dict.fromkeys(rows))
    sets = [shingles(r[1]) for r in distinct]
    group = list(range(len(distinct)))
    for x in range(len(distinct)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, distinct, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    assert ident(left.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in best.values())

    clean = stages["decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert ident(clean.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows if r[1] != leak)

    taken = stages["mixing"](spark, docs, sf_dir)
    assert taken.columns == docs.columns
    plan = mixing.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = taken.collect()
    assert sum(words(r.text) for r in got) == sum(r.taken for r in plan)
    assert len(got) == sum(r.copies + (r.part > 0) for r in plan)
    whole = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in whole or any(k == r.doc_id and (t or "").startswith(r.text) for k, t in whole) for r in got)

    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} <= {r[1] for r in rows}
    rest = docs
    for _, stage in corpus_pipeline.STAGES[1:]:
        rest = stage(spark, rest, sf_dir)
    assert rest.count() == stages["mixing"](spark, stages["decontamination"](spark, left, sf_dir), sf_dir).count()


def test_url_scores_are_exact(spark):
    """More n-grams than any fixed table of counters has room for."""
    rng, model = random.Random(5), url_filter.Model()
    rows = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-/") for _ in range(40)), k % 2) for k in range(9000)]
    urls = spark.createDataFrame(rows, "url string, accepted int")
    trained = url_filter.train(urls, model)
    seen = [r.url for r in urls.where(F.pmod(F.xxhash64("url"), F.lit(model.held_out)) != 0).collect()]
    n, label = Counter(), dict(rows)
    for u in seen:
        padded = "\0" * model.order + u
        for i in range(len(u)):
            for k in range(model.order + 1):
                context = padded[i + model.order - k : i + model.order]
                n[label[u], k, context] += 1
                n[label[u], k, context, u[i]] += 1
    asked = [seen[0], seen[7], rows[3][0], "unseen.org/é", "a", ""]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(asked)], "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.scored(frame, trained.counts, model).collect()}
    for at, u in enumerate(asked):
        total, b = 0.0, u.encode().decode("latin-1")
        padded = "\0" * model.order + b
        for i in range(len(b)):
            p = [1 / 256, 1 / 256]
            for k in range(model.order + 1):
                context = padded[i + model.order - k : i + model.order]
                p = [(n[c, k, context, b[i]] + model.weight * p[c]) / (n[c, k, context] + model.weight) for c in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        assert abs(got[at] - total / max(len(b), 1)) < 1e-9, u


def test_html_linked_headline_and_lists_stay(spark):
    words = "running words of the story " * 12
    body = "<article><h1><a href=/x>A headline of some forty characters, linked</a></h1>" + "".join(f"<p>{words}{k}</p>" for k in range(4))
    body += "<h2>Part</h2><ul><li>item</li></ul><blockquote>quote</blockquote><table><tr><td>cell</td></tr></table><pre>code</pre></article>"
    rows = [(k, "http://l.org/", page(body)) for k in range(5)]
    rows += [(5, "http://m.org/", page("<div class=c><h1><a href=/>Linked</a></h1>" + f"<div class=t>{words}</div>" * 3 + "<ul><li><a href=/>more of it</a></ul></div>"))]
    got = {r.page_id: r.text.split("\n") for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k][0].startswith("A headline") and got[k][-5:] == ["Part", "item", "quote", "cell", "code"] and len(got[k]) == 10
    assert got[5][0] == "Linked" and got[5][-1] == "more of it" and len(got[5]) == 5


def test_html_named_wrappers_are_read_by_what_they_hold(spark):
    words = "running words of the story " * 8
    article = f"<h1>Head</h1><p>{words}</p><p>{words}</p>"
    wrappers = ["class='content has-sidebar'", "class='layout no-nav'", "id='search-result'", "class='legal-news'", "class='page-with-sidebar'"]
    rows = [(k, f"http://w{k}.org/", page(f"<div {w}>{article}<div class='share'><p>Share it with many friends</p></div></div>")) for k, w in enumerate(wrappers)]
    rows += [(5, "http://w5.org/", page(f"<div class='legal-news'><p>{words}</p><p>{words}</p></div>", False))]
    rows += [(6, "http://w6.org/", page(f"<div class=widget><h1>Site</h1></div><article>{article}</article>"))]
    got = {r.page_id: r.text.split("\n") for r in html_extract.html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = ["Head", words.strip(), words.strip()]
    assert [got[k] for k in range(5)] == [whole] * 5
    assert got[5] == whole[1:] and got[6] == whole


def test_html_named_inline_elements_do_not_cut_a_paragraph():
    found = html_extract.parse("<body><p>one <span class=ad>buy</span> two<span class=share>x</span>, three</p></body>").blocks
    assert [b[1] for b in found] == ["one two, three"]


def one_page(html):
    return [b[1] for b in html_extract.parse(html).blocks]


def test_html_broken_quotes_leave_no_markup():
    assert one_page("<p>Hello world.</p><a href='x>link</a><p>Second para.</p>") == ["Hello world.", "link", "Second para."]
    assert one_page('<p class="a>one</p><p title=\'b>two</p><p>three 5 < 6 <3') == ["one", "two", "three 5 < 6 <3"]
    assert one_page('<p title="a > b" data-x=\'<i>no</i>\'>yes</p><p don\'t>we</p><p>can\'t "stop"') == ["yes", "we", 'can\'t "stop"']
    assert one_page('<p title="the hidden gem">kept</p><p hidden>gone</p><p>end<a href="open') == ["kept", "end"]


def test_html_words_in_the_class_of_a_paragraph():
    words = "<p>running words of the story, many of them</p>" * 3
    found = one_page(f'<article>{words}<p class="hidden-gem">A gem of a place.</p><p id="search">How to search.</p><h2 class="comments-on-life">Life</h2><p class="ad">Buy</p></article>')
    assert found[3:] == ["A gem of a place.", "How to search.", "Life"]


@pytest.mark.parametrize(
    "html",
    [
        "<div>x" * 100_000,
        "<b>x" * 100_000,
        "<a b " * 100_000 + '"',
        "<p class='" * 50_001,
        "<div class=sidebar>x" * 50_000,
        "<p>" + "<span class=ad>x</span>y" * 50_000,
        "</div></b></p>" * 50_000,
        "<td>x<p>y" * 50_000,
        "<h2>a" * 50_000 + "<article>" * 1000,
        "<p>" + "word " * 2_000_000,
        "<a href='x>" * 30_000 + "<p>t",
    ],
    ids=range(11),
)
def test_html_time_is_linear(html):
    started = time.perf_counter()
    page = html_extract.parse(html)
    html_extract.scores(page)
    html_extract.path_ids(page)
    assert time.perf_counter() - started < 8
