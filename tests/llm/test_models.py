import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import html, lm, toxicity, urls

from .conftest import odd_rows


def test_lm_against_brute_force(odd, monkeypatch, nothing):
    fitted = {}
    plain = lm.fit_weights
    monkeypatch.setattr(lm, "fit_weights", lambda *a, **k: fitted.setdefault("w", plain(*a, **k)))
    monkeypatch.setattr(lm, "OWNER", 3000)
    rows = lm.score_documents(odd, chunk_tokens=500).collect()
    docs = [(d, (t or "").encode().lower().split()) for d, t, *_ in odd_rows()]
    part = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10
    word, context, pair = Counter(), Counter(), Counter()
    for d, w in docs:
        if part(d):
            word.update([*w, "END"])
            context.update(["START", *w])
            pair.update(zip(["START", *w], [*w, "END"]))
    n, v = sum(word.values()), len(word)
    want = Counter()
    for d, w in docs:
        tokens, before = [*w, "END"], ["START", *w]
        base = sum(math.log10((word[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        score = 0.0
        for h, t in zip(before, tokens):
            c = context[h]
            w0, w1, w2 = fitted["w"][0 if c == 0 else min(int(math.log2(c)) + 1, lm.BUCKETS)]
            score += math.log10(w0 / (v + 1) + w1 * word[t] / n + (w2 * pair[h, t] / c if c else 0))
        want[d, part(d) == 0, len(tokens), sum(word[t] > 0 for t in tokens), n, round(base, 6), round(score, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert got == want
    for weights in fitted["w"]:
        assert sum(weights) == pytest.approx(1)
    assert lm.score_documents(nothing).count() == 0


def test_lm_weights_rise_in_likelihood(spark):
    rows = [(5, 8, 4, 10), (50, 8, 0, 3), (1, 0, 0, 2), (0, 16, 0, 1), (7, 16, 9, 5)]
    triples = spark.createDataFrame(rows, "word long, context long, pair long, times long")

    def loss(rounds):
        w = lm.fit_weights(triples, 1000, 99, rounds)
        total = 0.0
        for a, c, p, k in rows:
            w0, w1, w2 = w[0 if c == 0 else int(math.log2(c)) + 1]
            total += k * math.log(w0 / 100 + w1 * a / 1000 + (w2 * p / c if c else 0))
        return total

    assert loss(1) <= loss(3) <= loss(10)


def test_toxicity_chain(spark, nothing):
    rude = ["vilest", "vilely", "rottenish"]
    rows = [(i, f"calm word number{i % 7} goes here" + (f" you {rude[i % 3]} thing" if i % 5 == 0 else "")) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "calm you VILEST, thing"), (1003, "calm goes here"), (None, "calm word"), (1003, "calm goes here")]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(300)] + [(5, None, 1), (None, 1, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.labelled(labels), toxicity.CHAIN).collect()
    assert len(got) == len(rows)
    flagged = {r.doc_id for r in got if r.toxic}
    assert flagged == {i for i in range(400) if i % 5 == 0} | {1002}
    kept = toxicity.drop_toxic(docs, toxicity.labelled(labels), toxicity.CHAIN)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(flagged)
    none = toxicity.score_toxicity(docs, toxicity.labelled(labels.where("false")), toxicity.CHAIN).collect()
    assert not any(r.toxic for r in none)
    assert toxicity.score_toxicity(nothing, toxicity.labelled(labels), toxicity.CHAIN).count() == 0


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>Head</p></header><div class=cookie-notice>Cookies</div>
<nav><a href=x>Menu</a></nav><aside><p>Side {long}</p></aside><main><article class="post"><header><h1>Title &amp; more</h1></header>
<p>First&nbsp;para <a href=y>link</a><br>goes  on<p>Second <b>bold</b> <script>var a="<p>no</p>";</script>end<!-- <p>no</p> -->
<ul><li>one<li>two</ul><div class='ad'>Buy</div><form><p>Email</p><input name=q></form><div style="display:none">no</div>
<section class="comments"><p>nice {long}</p></section></article></main><footer>&copy; x</footer></body>"""


def test_main_text():
    tree = html.train_tree()
    assert all(html.classify(tree, r[:-1]) == r[-1] for r in html.LABELLED)
    text = html.main_text(PAGE.format(long="word " * 60), tree)
    assert text == "Title & more\nFirst para link goes on\nSecond bold end\none\ntwo"
    assert html.main_text("", tree) == html.main_text("<p", tree) == html.main_text("<div><script>x</div>", tree) == ""
    long = "<article>" + "<p>many words in here</p>" * 20_000
    assert html.main_text(long, tree).count("\n") == 19_999


def test_extract_pages(spark):
    rows = [(1, "u", "<article><p>Text</p></article>", 3), (2, None, None, 4), (None, "u", "", 5), (1, "u", "<article><p>Text</p></article>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in html.extract_main_text(pages).collect())
    assert got == [("1", "u", "Text", 4), ("1", "u", "Text", 4), ("2", "", "", 0), ("None", "u", "", 0)]
    assert html.extract_main_text(pages.where("false")).count() == 0


URLS = {
    "HTTP://A.Example.NET/en/1?x=//": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://a.example.net/fr/1#f": ("a.example.net", "/fr/1", "net/", "block"),
    "http://a.example.net": ("a.example.net", "", None, "allow"),
    "http://myexample.com/de/": ("myexample.com", "/de/", None, "allow"),
    "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
    "x://b.org/fr/://y": ("b.org", "/fr/://y", "org/fr/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "http://bad.shop.io/buy/x": ("bad.shop.io", "/buy/x", None, "block"),
    "http://good.shop.io/buy/x": ("good.shop.io", "/buy/x", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_url_rules(spark):
    labelled = [(f"http://bad.shop.io/buy/{i}", 1) for i in range(40)] + [(f"http://ok{i % 5}.shop.io/buy/{i}", 0) for i in range(90)]
    labelled += [(f"http://bad.shop.io/about/{i}", 0) for i in range(60)] + [(None, 1), ("http://z.io/", None)]
    known = spark.createDataFrame(labelled, "url string, bad int")
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), 1)], "page_id long, url string, rule int")
    got = urls.judge_urls(pages, known).collect()
    assert len(got) == len(URLS) + 1
    want = list(URLS.values())
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id], r
    rules = urls.mine_rules(known).collect()
    assert rules and all({"path:buy"} < set(r.tokens) for r in rules)
    assert urls.judge_urls(pages, known.where("false")).where("verdict = 'block' AND rule IS NULL").count() == 0
    assert urls.judge_urls(pages.where("false"), known).count() == 0


def test_labels_reach_pages_by_document_number(spark):
    pages = spark.createDataFrame([("http://a.b/en/12?p=1",), ("http://a.b/en/13.html",), ("http://a.b/en/14/",), ("http://a.b/x",), (None,)], "url string")
    labels = spark.createDataFrame([(12, 1, 0), (13, 0, 0), (14, 1, 1), (14, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.bad for r in urls.labelled_urls(pages, labels).collect()}
    assert got == {"http://a.b/en/12?p=1": 0, "http://a.b/en/13.html": 1, "http://a.b/en/14/": 1}


def test_fit_holds_its_features_once(monkeypatch):
    """Counting and looking up the features takes memory for a block of them, not several times all."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 5000, 2500)).astype("<i4") for _ in range(600)]
    ys = rng.integers(0, 2, (600, 2)).astype("i4")
    table = pa.table({"ids": [d.tobytes() for d in docs], "doc_id": list(range(600)), "y0": ys[:, 0], "y1": ys[:, 1]})
    monkeypatch.setattr(toxicity, "FEATURES", 20)
    whole = toxicity._fit(2)((), table)
    monkeypatch.setattr(toxicity, "BLOCK", 20_000, raising=False)
    tracemalloc.start()
    made = toxicity._fit(2)((), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == whole and len(made["features"][0]) == 20
    assert peak < table["ids"].nbytes
