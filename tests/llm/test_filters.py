"""Quality rules, decontamination, secrets, main text, URL rules and toxicity on small fixtures."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialspark.llm import decontaminate, extract, kernels, quality, secrets, toxicity, urls
from trialspark.llm.common import prepare

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    met = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if met[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_counts_match_brute_force(spark, corpus, nothing):
    docs, rows = corpus
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judged(docs.withColumn("kept", F.lit("clash")).withColumn("stratum", F.lit(7)), labels, carry=True).collect()
    want = Counter()
    for r in rows:
        n, chars, symbols, lines, again = counts(r[1])
        failed = n < 50 or 100 * again > 50 * n
        want[(r[0], n, chars, symbols, lines, again, failed, not failed)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert {r.stratum for r in got} == {7}
    assert quality.judged(nothing, labels).collect() == []


def test_quality_cutoffs_are_proven(spark):
    """Shouting texts are bad; a quarter of the good ones carry a few symbols. Only the first is cut, and null or odd labels do not count."""
    good = [(i, " ".join(f"word{i}x{j}" + ("#" if i % 4 == 0 and j % 3 == 0 else "") for j in range(60))) for i in range(1500)]
    bad = [(5000 + i, " ".join(f"WORD{i}X{j}!!" for j in range(60))) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, None), (None, 1), (8, 0)]
    out = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept for r in out if r.doc_id < 5000)
    assert not any(r.kept for r in out if r.doc_id >= 5000)


@pytest.mark.parametrize("k,n,p", [(0, 500, 0.01), (3, 1000, 0.01), (30, 5000, 0.01), (0, 3, 0.2), (9, 1000, 0.01), (40, 900, 0.01)])
def test_binomial_tail(spark, k, n, p):
    exact = math.fsum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(exact, rel=1e-9)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps"), (2, "short item"), (3, None), (4, " .. "), (None, "nameless item here"), (5, "short item"),
         (6, "über 12 straße")]


def hits(text, items):
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    w, hit, names = low(text), set(), set()
    for name, item in items:
        own = low(item)
        for k in range(max(1, len(own) - 9)) if own else ():
            run = own[k:k + 10]
            for i in range(len(w) - len(run) + 1):
                if w[i:i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    names |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontamination_matches_brute_force(spark, block_bytes):
    texts = [None, "", "...", "nothing to see", "SHORT-item; short item short", "x THE quick, brown fox jumps over the lazy dog and THEN it sleeps y", "a nameless item here",
             "quick brown fox jumps over the lazy dog and", "so: über, 12  STRAßE! Über 12 straße", "über 12 straße " * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, items string").repartition(3)
    got = decontaminate.contamination(docs, spark.createDataFrame(ITEMS, "item_id int, text string"), block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == hits(texts[r.doc_id], ITEMS), texts[r.doc_id][:80]
    spans = next(r.spans for r in got if r.doc_id == 8)
    assert [texts[8][a:b] for a, b in spans] == ["über, 12  STRAßE"]
    empty = decontaminate.contamination(docs, spark.createDataFrame([], "item_id int, text string")).collect()
    assert {r.n_hit for r in empty} == {0}
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id int, text string")).collect() == []


@pytest.mark.parametrize("most", [1, 25, 60, 1000])
def test_pieces_of_a_large_item_hold_its_windows(most):
    data = " ".join(f"w{i % 17}" for i in range(90)).encode()
    cut = decontaminate.pieces(data, 10, most)
    assert [x for p in cut for x in decontaminate.windows_of(p.split(), 10)] == decontaminate.windows_of(data.split(), 10)
    assert decontaminate.pieces(b"few words", 10, 3) == [b"few words"] and decontaminate.pieces(b"", 10, 3) == [b""]
    assert all(len(p) <= max(most, 39) for p in cut)


def test_secrets_and_ledger(spark, tmp_path):
    prepare(spark)
    long_ = "é " * 200_000 + "AKIA" + "Z9" * 8
    texts = [None, "", "Token: token: abcdefgh", "api_key='a1b2c3'; SECRET = \"short\" paſsword=notascii", "x" + "0123456789abcdef" * 3 + "g deadbeef", "AKIA1234", long_, "AKIA" + "A" * 16]
    versions = spark.createDataFrame([(f"p{i}", t, "clash") for i, t in enumerate([*texts, texts[3]])], "path string, text string, spans string")
    ledger = str(tmp_path / "ledger")
    got = {r.path: [tuple(s) for s in r.spans] for r in secrets.scanned(versions, ledger).collect()}
    assert got["p0"] == got["p1"] == got["p5"] == []
    assert got["p2"] == []  # the value "token" is short, and what follows it has no name left
    assert got["p3"] == got["p8"] == [("assign", 0, 15)]
    assert got["p4"] == [("hex", 1, 49)]
    assert got["p6"] == [("access", 400_000, 400_020)]
    assert got["p7"] == [("access", 0, 20)]
    seen = spark.read.parquet(ledger).count()
    assert seen == 7  # null and empty are one blob, repeated texts are one
    again = secrets.scanned(versions.union(spark.createDataFrame([("new", "token=fresh123", "")], versions.schema)), ledger).collect()
    assert spark.read.parquet(ledger).count() == seen + 1 and len(again) == 10
    secrets.scanned(versions, ledger, version="2").collect()
    assert spark.read.parquet(ledger).where("rules = '2'").count() == seen
    assert secrets.scanned(versions.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=wrap><article><h1>Title &amp; more</h1><p><b>First   para
one<br>two.<p>Second <i>para</i>graph &eacute;<p>To.</p><div class="ad">Buy now</div><form>Name <input></form><ul><li>item one<li>item two</ul>
<table><tr><td>cell</table><pre>a
 b</pre></article><aside>Related</aside><section id="comments"><p>Reader says a lot of things here, in a very long comment that is dense text.</p></section></div>
<footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\nFirst para one two.\nSecond paragraph é\nTo.\nitem one\nitem two\ncell\na b"
    plain = "<div class=menu><a>a</a><a>b</a></div><div><p>" + "Long text of a page without any article tag. " * 5 + "</p><p>End.</p></div><div><a>x</a></div>"
    pages = spark.createDataFrame([(1, PAGE, "c"), (2, None, "c"), (3, "", "c"), (4, "just text", "c"), (5, plain, "c"), (6, "<p>" * 3000 + "deep" + "<b>" * 3000, "c"), (1, PAGE, "c")],
                                  "page_id int, html string, main_text string")
    got = [(r.page_id, r.main_text) for r in extract.extracted(pages).collect()]
    assert got.count((1, want)) == 2
    texts = dict(got)
    assert texts[2] == texts[3] == "" and texts[4] == "just text" and texts[6] == "deep"
    assert texts[5].split("\n")[-1] == "End." and texts[5].startswith("Long text")
    assert extract.extracted(pages.limit(0)).collect() == []


PROSE = "A sentence of the body that has many words and hardly a tag. " * 4


@pytest.mark.parametrize("page", [
    '<div class="content with-sidebar"><article>{0}{1}</article><div class="sidebar"><p>gone</p></div></div>',
    '<div class="widget Blog"><div class="post">{0}{1}</div></div><div class="widget"><p>gone</p></div>',
    '<div class="widget"><article>{0}</article></div><div class="widget"><article>{1}</article></div><div class="site-footer">gone</div>',
    '<article>{0}{1}</article><div class="related"><article>gone</article></div><div id="comments"><p>gone</p></div>'])
def test_marks_do_not_take_the_article(page):
    texts = ["One " + PROSE.strip(), "Two " + PROSE.strip()]
    assert extract.main_text("<body>" + page.format(*[f"<p>{t}</p>" for t in texts]) + "</body>").split("\n") == texts


@pytest.mark.parametrize("page", [
    '<div class="lead">{0}</div><div class="body">{1}{2}{3}{4}</div><div class="footer">gone</div>',
    '<nav><a>gone</a></nav><article>{0}{1}</article><article>{2}{3}{4}</article>',
    '<div>{0}</div><article>{1}{2}{3}{4}</article><div><a>gone</a><a>gone</a></div>'])
def test_every_dense_region_is_kept(page):
    texts = [f"Part {i} " + PROSE.strip() for i in range(5)]
    assert extract.main_text("<body>" + page.format(*[f"<p>{t}</p>" for t in texts]) + "</body>").split("\n") == texts


def test_headline_beside_the_body_is_kept():
    page = f"<body><h1>Headline</h1><div class=body>{f'<p>{PROSE}</p>' * 4}</div></body>"
    assert extract.main_text(page).split("\n") == ["Headline"] + [PROSE.strip()] * 4


def test_url_rules(spark):
    prepare(spark)
    cases = {"https://WWW.Example.com/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
             "http://example.com": ("example.com", "", None, "allow"), "http://x.net/fr/#a": ("x.net", "/fr/", "net/fr/", "block"), "ftp://a.com/x#y": ("a.com", "/x", "com/", "allow"),
             "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
             "http://bad.org/x": ("bad.org", "/x", None, "block"), "http://sub.bad.org/x": ("sub.bad.org", "/x", None, "block"), "http://good.org/": ("good.org", "/", None, "allow"),
             "http://unknown.xyz/": ("unknown.xyz", "/", None, "allow")}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id int, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 60 + [("good.org", 1)] * 60 + [("good.org", None)], "host string, good int")
    got = {r.page_id: r for r in urls.judged(pages, outcomes).collect()}
    for i, (url, want) in enumerate(cases.items()):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == want, url
    none = urls.judged(pages, outcomes.limit(0)).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"} and len(none) == len(cases)
    assert urls.judged(pages.limit(0), outcomes).collect() == []


def test_toxicity_learns_sentences(spark):
    prepare(spark)
    calm = "the sea is calm and wide. people walk home! bread is warm"
    docs = [(i, f"{calm} {i}. more of it {i % 7}" + (". you utter blockhead there" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (1002, "?!"), (None, calm)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (None, 1)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string")
    got = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    texts = dict(docs)
    for r in held:
        assert [texts[r.doc_id][a:b] for a, b in r.offending] == (["you utter blockhead there"] if r.predicted else [])
    assert {r.score for r in got if r.doc_id in (1000, 1001, 1002)} == {0.0}
    untaught = toxicity.toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.predicted for r in untaught} == {0}


def test_toxicity_learns_from_whole_texts(spark):
    """The telling sentence stands after 24,000 characters of every toxic text."""
    prepare(spark)
    calm = "the sea is calm and wide. people walk home! bread is warm. " * 420
    docs = [(i, calm + (f"you utter blockhead there {i}" if i % 4 == 0 else f"more of it {i}")) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.toxicity(frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)


def plain_toxicity(text, weights, bias):
    """Noisy-or over the sentences of different score, word by word; and the code points of offending sentences."""
    def spread(x):
        for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * k % 2 ** 64
        return x ^ x >> 33

    def number(data, extra):
        return spread((sum((b + 1) * pow(kernels.BASES[0], i, 2 ** 64) for i, b in enumerate(data)) + extra) % 2 ** 64) % (toxicity.DIMENSIONS // 2)

    scores, spans = set(), []
    for sentence in re.finditer(r"[^.!?\n]+", text or ""):
        words = list(re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", sentence[0]))
        if not words:
            continue
        z = bias
        for w in words:
            data = re.sub("[A-Z]", lambda m: m[0].lower(), w[0]).encode()
            z += float(weights[number(data, len(data))]) + float(weights[number(data[:toxicity.BEGINNING], 0) + toxicity.DIMENSIONS // 2])
        scores.add(round(z, 9))
        if z >= 0:
            spans.append([sentence.start() + words[0].start(), sentence.start() + words[-1].end()])
    clean = 1.0
    for z in scores:
        clean *= min(1.0, (1 + math.exp(bias)) / (1 + math.exp(z)))
    return 1 - clean, spans


def test_toxicity_scores_match_a_plain_noisy_or(spark):
    prepare(spark)
    calm = "the sea is calm and wide. people walk home! bread is warm"
    docs = [(i, f"{calm} {i}" + (f". Ünd you utter blockhead thére {i}! 的 blockhead, you" if i % 4 == 0 else f". you are kind {i}")) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, ".!?\n"), (1003, "blockhead"), (1004, "YOU UTTER BLOCKHEAD?" * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.trained(frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int"), F.lit(True))
    texts = dict(docs)
    for r in toxicity.scored(frame, model).collect():
        score, spans = plain_toxicity(texts[r.doc_id], *model)
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.offending == spans
    assert plain_toxicity(texts[0], *model)[1]


def test_length_does_not_make_a_text_toxic(spark):
    """Repeated texts keep their score, and sentences that tell nothing change none."""
    prepare(spark)
    calm = "the sea is calm and wide. people walk home! bread is warm"
    docs = [(i, f"{calm} {i}. " + (f"you utter blockhead there {i}" if i % 4 == 0 else f"more of it {i}")) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.trained(frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int"), F.lit(True))
    once, often, longer = (toxicity.scored(frame.select("doc_id", F.expr(e).alias("text")), model).select("doc_id", "score").collect()
                           for e in ("text", "repeat(text || '\n', 50)", r"text || '\n' || array_join(transform(sequence(1, 400), k -> 'unheard ' || (7000 + k) || '.'), ' ')"))
    assert dict(map(tuple, often)) == pytest.approx(dict(map(tuple, once)), abs=1e-9)
    assert dict(map(tuple, longer)) == pytest.approx(dict(map(tuple, once)), abs=1e-9)
    assert all((score >= 0.5) == (i % 4 == 0) for i, score in once)


@pytest.mark.parametrize("inside,kept", [
    ("<p hidden>Held back.</p>", ["Held back."]), ('<p aria-hidden="true">One <b style="display:none">two</b></p>', ["One two"]),
    ("<p>Formula <math><mi>E</mi> = <mi>m</mi></math> ends.</p>", ["Formula E = m ends."]), ("<p>Press <button>Start</button> now.</p>", ["Press Start now."]),
    ("<p>A <label>tag</label>, a <svg><text>drawing</text></svg>, an <object>object</object> and a <canvas>canvas</canvas>.</p>", ["A tag, a drawing, an object and a canvas."]),
    ("<header><h2>Part two</h2><p>By the author</p></header>", ["Part two", "By the author"]),
    ('<section id="discussion"><h2>Discussion</h2><p>{0}</p><p>{0}</p></section>', ["Discussion", "{0}", "{0}"]),
    ('<div class="widget"><p>{0}</p></div>', ["{0}"]), ('<div class="header"><p>{0}</p></div>', ["{0}"]),
    ('<div class="widget"><ul><li><a href=x>gone</a></li><li><a href=y>gone</a></li></ul></div>', []), ('<div class="related"><a>gone</a><a>gone</a></div>', []),
    ('<section id="discussion"><h3>Discussion</h3><div class="comment"><p>{0}</p></div><div class="comment"><p>{0}</p></div></section>', []),
    ('<div id="comments"><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p></div>', []), ("<footer>gone</footer><aside>gone</aside><form><button>gone</button><label>gone</label></form>", []),
    ("<nav><a>gone</a></nav><style>p {{}}</style><script>gone()</script>", [])])
def test_only_what_is_no_text_of_the_article_goes(inside, kept):
    """The same element may be the article's or boilerplate; inside the article its text decides where its name does not."""
    lead, end = "Lead " + PROSE.strip(), "End " + PROSE.strip()
    page = f'<body><header><a>gone</a></header><button>gone</button><p hidden>gone</p><article><h1>Title</h1><p>{lead}</p>{inside.format(PROSE)}<p>{end}</p></article><footer>gone</footer></body>'
    assert extract.main_text(page).split("\n") == ["Title", lead, *[k.format(PROSE.strip()) for k in kept], end]


def test_ratios_smoothing_and_threshold_match_a_plain_form():
    """Characters a tag, a Gaussian over neighbouring lines, and the midpoint of two clusters, in plain Python."""
    import numpy as np

    lines = [("a" * n, tags, False, 0, 0, False, False) for n, tags in [(5, 4), (9, 3), (240, 2), (180, 2), (8, 5), (300, 1), (4, 4), (6, 6)]]
    ratio = [len(x[0]) / max(1, x[1]) for x in lines]
    weight = {k: math.exp(-k * k / 2) for k in range(-3, 4)}
    smooth = [sum(weight[k] * ratio[i + k] for k in weight if 0 <= i + k < len(ratio)) / sum(weight.values()) for i in range(len(ratio))]
    cut = sum(smooth) / len(smooth)
    for _ in range(50):
        high, low = [x for x in smooth if x > cut], [x for x in smooth if x <= cut]
        cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
    got = extract.dense_from(np, lines, np.ones(len(lines), bool), 1.0)
    assert list(got[0]) == pytest.approx(ratio) and list(got[1]) == pytest.approx(smooth)
    assert got[2] == pytest.approx(min(cut, sum(x for x in smooth if x >= cut) / len([x for x in smooth if x >= cut]) / 3))
