"""Operators 3 to 6 and 8."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import op03_license_scan as op3
from quillframe.llm import op04_html_extraction as op4
from quillframe.llm import op05_url_filters as op5
from quillframe.llm import op06_lm_scoring as op6
from quillframe.llm import op08_media_columns as op8

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    starts, labels = [], set()
    for phrase, label in op3.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences_against_brute_force(frame, odd_rows):
    rows = odd_rows + [(30, "MIT License. mit licence, the mit-license"), (31, "GNU General\nPublic (License) apache license apache license"), (32, "cc by cc by sa"), (33, "license " * 3000 + "apache license"), (34, "gnu general public"), (35, "by cc by by")]
    got = op3.scan_licenses(frame(rows, clash=True)).collect()
    want = sorted((str(i), licence(t)) for i, t in rows)
    assert sorted((str(r["doc_id"]), (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert "cc-by-sa" in next(r["labels"] for r in got if r["doc_id"] == 32)
    assert op3.scan_licenses(frame([])).count() == 0


def test_own_licence_templates(frame):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    got = {r["doc_id"]: r for r in op3.scan_licenses(frame([(1, text), (2, text.replace("hereby", "gladly")), (3, "Licensed under the Apache License, Version 2.0")])).collect()}
    assert got[1]["labels"] == "mit-text" and got[1]["score"] == 1.0 and got[2]["labels"] == "" and got[3]["labels"] == "apache,apache-2.0"


def own_licences(rows):
    """Labels and scores by trying each template at each place of each text."""
    split = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP)) for k, (_, t) in enumerate(rows)}
    idf = lambda w: math.log((len(rows) + 1) / (sum(w in s for s in split.values()) + 1)) + 1
    out = {}
    for k, w in split.items():
        labels, best = set(licence(rows[k][1])[4].split(",")) - {""}, 0.0
        for label, text, key in op3.TEMPLATES:
            parts, total = text.split(), sum(idf(x) for x in text.split() if x != "*")
            at = next(i for i in range(len(parts)) if parts[i : i + len(key.split())] == key.split())
            for start in range(-len(parts), len(w)):
                got = lambda i: w[start + i] if 0 <= start + i < len(w) else None  # noqa: B023, E731
                if [got(i) for i in range(at, at + len(key.split()))] == key.split():
                    share = min(round(sum(idf(x) for i, x in enumerate(parts) if x != "*" and got(i) == x) / total, 9), 1.0)
                    best = max(best, share)
                    labels |= {label} if share >= op3.MIN_SCORE else set()
        out[k] = (",".join(sorted(labels)), 1.0 if licence(rows[k][1])[1] else best)
    return out


def test_own_labels_against_brute_force(frame, odd_rows):
    """Every template whole, with each word altered, left out or doubled, cut at both ends, beside others; words that tie in IDF."""
    mit = "Permission is {} granted free of charge to any person obtaining a copy"
    rows = [*odd_rows, (300, mit.format("xxx") + " ; and elsewhere hereby granted free"), (301, mit.format("hereby"))]
    for label, text, _ in op3.TEMPLATES:
        w = text.replace("*", "some").split()
        rows += [(0, " ".join(w)), (0, " ".join(["and", *w, "gnu", *w[1:]])), (0, " ".join(w[:-1])), (0, " ".join(w * 3))]
        for k in range(len(w)):
            rows += [(0, " ".join([*w[:k], "xxx", *w[k + 1 :]])), (0, " ".join(w[:k] + w[k + 1 :])), (0, " ".join([*w[: k + 1], w[k], *w[k + 1 :]]))]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: (r["labels"], pytest.approx(r["score"], abs=2e-9)) for r in op3.scan_licenses(frame(rows)).collect()}
    assert own_licences(rows) == got
    assert got[len(odd_rows)][0] == "" and got[len(odd_rows) + 1][0] == "mit-text"


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header>Site head</header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b> part,
 going  on.<br><p>Second &lt;p&gt; paragraph with a <a href=x>link</a> in it and some more words.</p><ul><li>item one<li>item two</ul><form>Name <input></form>
<p>Third &eacute;t&#233;.</p></article><aside>Side</aside><section id="comments"><p>A reader says a lot of things here.</p></section><footer>&copy; foot</footer>"""


def test_main_text():
    assert op4.main_text(PAGE).split("\n") == ["Head & line", "First bold part, going on.", "Second <p> paragraph with a link in it and some more words.", "item one", "item two", "Third été."]
    assert op4.main_text(PAGE + "</body></html>") == op4.main_text(PAGE)


def test_main_text_keeps_what_lies_beside_the_core(words):
    """A title, short paragraphs and bare text of the article, but no blocks of links."""
    long, short = [words(200, k) for k in range(3)], [words(30, 10 + k) for k in range(3)]
    paragraphs = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    page = f"<body><article><h1>A title of the text</h1><section>{paragraphs(short)}</section>bare words<div>{paragraphs(long)}</div><ul><li><a href=x>more</a><li><a href=y>others</a></ul></article></body>"
    assert op4.main_text(page).split("\n") == ["A title of the text", *short, "bare words", *long]


def test_main_text_after_markup_that_cut_pages():
    """Unclosed dropped spans, self-closing pictures, and wrappers whose class only sounds like a menu."""
    tail = "<p>Second text, with words.</p><p>Third text.</p>"
    rest = ["Second text, with words.", "Third text."]
    assert op4.main_text(f'<article><p>First text.<span class="share">x</p>{tail}</article>').split("\n") == ["First text.", *rest]
    assert op4.main_text(f'<article><p>First <span class="share">x <b>y</b></span>text.</p>{tail}</article>').split("\n") == ["First text.", *rest]
    for picture in ('<svg class="icon"/>', "<math />", "<svg/>", "<svg><title>z</title></svg>"):
        assert op4.main_text(f"<article><p>First text.{picture}</p>{tail}<svg><text>z</text></svg></article>").split("\n") == ["First text.", *rest]
    for name in ("has-sidebar", "no-comments", "content-with-sidebar", "page-sidebar", "form widget"):
        assert op4.main_text(f'<body><div class="{name}"><article>{tail}</article><div class="sidebar">Aside</div></div></body>').split("\n") == rest
    nested = f'<div class="form"><div class="widget"><h1>Title</h1>{tail}</div></div>'
    assert op4.main_text(nested).split("\n") == ["Title", *rest]
    comments = f'<article>{tail}</article><div class="comments"><p>{"A long reply. " * 20}</p></div>'
    assert op4.main_text(comments).split("\n") == rest


WRAPPERS = ["has-sidebar", "content no-sidebar", "with-ads", "related-content", "form-wrapper", "share-page", "page-header-fixed menu-open", "search-results", "comments-open", "sidebar", "widget ad"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_no_name_around_an_article_drops_it(name):
    """A declared name on each element around the article, as class and id, with and without article elements, beside menus and comments."""
    body = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {k} of the article has quite a few words in it, as they do.</p>" for k in range(6))
    want = ["Title here", *(f"Paragraph {k} of the article has quite a few words in it, as they do." for k in range(6))]
    rest = '<div class="sidebar">Side words.</div><div class="comments"><article><p>A reply.</p></article></div><div class="footer">Foot</div>'
    for article in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
        for page in (f'<div class="{name}">{article}</div>{rest}', f'<section id="{name}"><div class="{name}"><div class="{name}">{article}</div></div></section>{rest}', f'<body class="{name}"><nav>Menu</nav><div class="{name}">{article}{rest}</div></body>'):
            assert op4.main_text(page).split("\n") == want, page[:90]


def test_text_elements_of_an_article_stay():
    """Paragraphs, inline elements and formulas, whatever words are in their class names; whole names still say what they are."""
    p = "<p>Words before and after it, in a paragraph.</p>"
    page = f'<article><header><h1>Title</h1></header>{p}<p class="notice-board">A board of notices.</p>{p}<p>Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> be <span class="share-price">9 euros</span>.</p>{p}<p class="ad">Buy</p><div class="cookie-notice">We use cookies</div></article>'
    words = "Words before and after it, in a paragraph."
    assert op4.main_text(page).split("\n") == ["Title", words, "A board of notices.", words, "Let x = 1 be 9 euros.", words]
    assert op4.main_text("<header><h1>Site</h1></header><h1>Title</h1>" + p).split("\n") == ["Title", words]


def test_main_text_against_a_tree_of_the_standard_parser(words):
    """Generated pages with menus, adverts and comments around and inside the article: html.parser's tree, less what was generated as such."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        """Texts of p, h1, h2 and li elements, unless an open element is marked as something else."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.texts = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("data-not") == "1"))
            if tag in ("p", "h1", "h2", "li"):
                self.texts.append("")

        def handle_endtag(self, tag):
            while self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if any(t in ("p", "h1", "h2", "li") for t, _ in self.open) and not any(other for _, other in self.open):
                self.texts[-1] += data

    rng = np.random.default_rng(5)
    other = ['<div class="ad" data-not="1"><p>{}</p></div>', '<aside data-not="1"><p>{}</p></aside>', '<div class="share-buttons" data-not="1"><p>{}</p></div>', '<form data-not="1"><p>{}</p></form>', '<div role="navigation" data-not="1"><ul><li><a href="/x">{}</a></li></ul></div>']
    for k in range(120):
        some = lambda n, k=k: words(int(rng.integers(n, 4 * n)), int(rng.integers(10**6)))
        inner = [f"<h1>{some(3)}</h1>"]
        for _ in range(int(rng.integers(3, 12))):
            kind = int(rng.integers(8))
            inner.append(str(rng.choice(other)).format(some(2)) if kind == 0 else f"<h2>{some(2)}</h2>" if kind == 1 else f"<ul><li>{some(4)}</li><li>{some(4)} &amp; <b>{some(1)}</b></li></ul>" if kind == 2 else f"<section><p>{some(9)}</p></section>" if kind == 3 else f'<p>{some(12)} <a href="#">{some(1)}</a>\n {some(6)}</p>')
        tag = ("article", "main", 'div class="post"', "div")[k % 4]
        article = f"<{tag}>{''.join(inner)}</{tag.split()[0]}>"
        if k % 5 == 0:
            article = f'<form id="page" method="post"><input type="hidden">{article}</form>'
        for _ in range(k % 4):
            article = f'<div class="{rng.choice(WRAPPERS)}">{article}</div>'
        page = f'<html><body><nav data-not="1"><ul><li><a href="/">{some(2)}</a></li></ul></nav>{article}<div class="sidebar" data-not="1"><p>{some(6)}</p></div><section id="comments" data-not="1"><p>{some(4 + 40 * (k % 3 == 0))}</p></section><footer data-not="1"><p>{some(3)}</p></footer></body></html>'
        tree = Tree()
        tree.feed(page)
        assert op4.main_text(page).split("\n") == [" ".join(t.split()) for t in tree.texts if t.split()], k


P = "<p>" + "word " * 79 + "word</p>"
LINE = P[3:-4]


@pytest.mark.parametrize(("page", "blocks"), [
    (f"<body><form id=x><div><h1>Title</h1>{P * 3}</div></form></body>", ["Title", *[LINE] * 3]),
    (f"<div class=post><h1>Title</h1><div>{P * 3}</div><p>Short line.</p></div>", ["Title", *[LINE] * 3, "Short line."]),
    (f"<div><div><h2>A</h2>{P * 4}</div><div><h2>B</h2><p>one</p><p>two</p>three</div></div>", ["A", *[LINE] * 4, "B", "one", "two", "three"]),
    (f"<div><header><h1>Title of Story</h1></header><div>{P * 3}</div></div>", ["Title of Story", *[LINE] * 3]),
    (f'<div class=main><h1>T</h1><div class="search-results">{P}</div><div class="alert-history">{P}</div><div class="share-price">{P}</div></div>', ["T", *[LINE] * 3]),
    (f"<article><p>Press <button>OK</button> now, <select><option>a</select>then</p>{P}</article>", ["Press now, then", LINE]),
    # What has to go still goes.
    (f'<div class=main><h1>T</h1><div class="cookie-notice">{P}</div><div class="comment-list">{P}</div>{P}<div class="share-buttons">x</div></div>', ["T", LINE]),
    (f"<div id=page><header><h1>Site</h1><nav><a href=x>a</a></nav></header><div><h2>Title</h2>{P * 2}</div></div>", ["Title", LINE, LINE]),
    (f"<div id=page><header><h1>Site</h1></header><div><h1>Title</h1>{P * 2}</div></div>", ["Title", LINE, LINE]),
    (f"<body><form><input><p>Search here</p></form><div><h1>T</h1>{P * 2}</div></body>", ["T", LINE, LINE]),
])
def test_pages_without_an_article(page, blocks):
    assert op4.main_text(page).split("\n") == blocks


def test_densities_against_recursion(words):
    """Each node's counts from its whole subtree, the formula as it is written, and the first node with the largest sum of child densities."""
    rng = np.random.default_rng(9)

    def piece(depth):
        kind, some = int(rng.integers(7)), words(int(rng.integers(1, 30)), int(rng.integers(10**6)))
        if kind < 2 or depth > 4:
            return f"<p>{some} <b>{some[:9]}</b></p>"
        if kind == 2:
            return f'<p>{some}<a href="#">{some[:20]}</a></p>'
        if kind == 3:
            return f'<ul><li><a href="#">{some[:12]}</a></li><li>{some[:7]}</li></ul>'
        return f"<{'div section'.split()[kind % 2]}>{''.join(piece(depth + 1) for _ in range(int(rng.integers(1, 5))))}</{'div section'.split()[kind % 2]}>"

    for _ in range(60):
        page = "".join(piece(0) for _ in range(int(rng.integers(1, 6))))
        nodes, blocks = op4.parse(page)
        own = [(n.chars, n.link_chars, n.tags, n.link_tags) for n in nodes]
        op4.unwrapped(nodes, blocks)
        op4.score(nodes)

        def counts(n):
            parts = [counts(c) for c in n.children]
            return tuple(x + sum(p[k] for p in parts) + (len(n.children) if k == 2 else 0) for k, x in enumerate(own[n.order]))  # noqa: B023

        body = counts(nodes[0])
        density = []
        for n in nodes:
            c, lc, t, lt = counts(n)
            if not c:
                density.append(0.0)
                continue
            base = math.log(c / max(c - lc, 1) * lc + body[1] / max(body[0], 1) * c + math.e)
            density.append(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / (max(math.log(base), 1e-3) if base > 1 + 1e-9 else 1) if c * max(t, 1) > max(lc, 1) * max(lt, 1) else 0.0)
        assert [n.density for n in nodes] == pytest.approx(density)
        sums = [sum(density[c.order] for c in n.children) for n in nodes]
        text, most = op4.main_text(page).split("\n"), max(sums)
        core = nodes[next(k for k, s in enumerate(sums) if s == pytest.approx(most))] if most > 0 else nodes[0]

        def all_blocks(n):
            return sorted([*n.blocks, *(k for c in n.children for k in all_blocks(c))])

        assert {blocks[k] for k in all_blocks(core)} <= set(text)


@pytest.mark.parametrize("page", [None, "", "   ", "<html><body></body></html>", "<p", "<!-- open", "<script>x", "<nav>only</nav>", "</p></div></article>"])
def test_pages_without_text(page):
    assert op4.main_text(page) == ""


def test_odd_pages(spark):
    assert op4.main_text("bare text") == "bare text"
    assert op4.main_text("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    long = "<article>" + "".join(f"<p>Paragraph number {i} has words.</p>" for i in range(20_000)) + "</article>"
    assert op4.main_text(long).count("\n") == 19_999
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [r["text"] for r in op4.extract_main_text(df).orderBy("page_id").collect()] == ["", op4.main_text(PAGE), op4.main_text(PAGE)]
    assert op4.extract_main_text(df.limit(0)).count() == 0
    clash = df.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))
    assert [r["text"] for r in op4.extract_main_text(clash).orderBy("page_id").collect()] == ["", op4.main_text(PAGE), op4.main_text(PAGE)]
    assert op4.extract_main_text(clash, column="main").select("text").distinct().collect()[0]["text"] == "x"


URLS = ["http://example.com/en/1", "http://www.Example.COM/en/1", "https://a.b.example.com/en/x?y#z", "http://example.com/de/", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/", "http://notexample.com/en/", "http://example.com", "http://example.com?x=/en/", "nothing", None, "://example.com/en/", "ftp://u@h.net/es/a://b", "http://a.com/" + "p/" * 5000, ("http://" + "a." * 3000 + "com/en/")]


def judged(url, rules=op5.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UP)
    fits = [(len(h + p), len(h), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[4] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("rules", [op5.RULES, [], [("block", "com", "/e"), ("allow", "example.com", ""), ("block", "b.example.com", "/en/x")]])
def test_urls_against_brute_force(spark, rules):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, host string")
    got = op5.judge_urls(df, rules).collect()
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(str((i, *judged(u, rules))) for i, u in rows)
    assert op5.judge_urls(df.limit(0), rules).count() == 0


def test_language_model_against_brute_force(frame, odd_rows, words):
    docs = odd_rows + [(i, words(60, i % 5)) for i in range(40, 60)]
    df = frame(docs, clash=True)
    train = df.filter("doc_id % 3 <> 0")
    counts = Counter()
    for i, t in docs:
        if i is not None and i % 3:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = op6.score_texts(df, train).collect()
    assert len(got) == len(docs)
    want = []
    for i, t in docs:
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((str(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 4)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert op6.score_texts(df.limit(0), train.limit(0)).count() == 0
    assert op6.score_texts(df, train.limit(0)).count() == len(docs)


def class_of(word, frequent):
    return frequent.index(word) if word in frequent else op6.suffix_class(word)


@pytest.mark.parametrize("head", [op6.HEAD, 40])
def test_model_scores_against_brute_force(frame, odd_rows, words, monkeypatch, head):
    """Each token's class by a softmax over all classes, and its share of the class; with most words in the head, and with most beyond it."""
    monkeypatch.setattr(op6, "HEAD", head)
    monkeypatch.setattr(op6, "STEPS", 3)
    docs = odd_rows + [(i, words(60, i % 5)) for i in range(40, 60)] + [(61, "x" * 80 + "end rare " + "x" * 80 + "end")]
    df = frame(docs, clash=True)
    model, counts = op6.fit(df.filter("doc_id % 3 <> 0"))
    seen, n_train = Counter(), 0
    for i, t in docs:
        if i is not None and i % 3:
            seen.update(op6.tokens(t))
            n_train += 1
    ranked = sorted(seen, key=lambda w: (-seen[w], w))
    cut = seen[ranked[head]] if len(ranked) > head else 0  # words of one octave of counts are in the head together
    frequent = [w for w in model.head[: op6.WORDS]]
    assert frequent == [w for w in ranked if w in set(model.head)][: op6.WORDS] and all(seen[w] > cut for w in model.head)
    by_class = {}
    for w, c in seen.items():
        by_class.setdefault(class_of(w, frequent), []).append(c)
    want = []
    for i, t in docs:
        found, ids = op6.tokens(t), [op6.START, op6.START]
        total = 0.0
        for w in [*found, None]:
            k = op6.END if w is None else class_of(w, frequent)
            logits = (model.by_first[ids[-1]].astype(float) + model.by_second[ids[-2]]) * math.log(10)
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / math.log(10)
            if op6.WORDS <= k < op6.END:
                total += math.log10((seen[w] + 1) / (sum(by_class.get(k, [])) + len(by_class.get(k, [])) + 1))
            ids.append(k)
        want.append((str(i), len(found) + 1, round(total / (len(found) + 1), 3)))
    got = op6.score_with(df, model, counts).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"] / r["n_tokens"], 3)) for r in got) == sorted(want)
    for k in range(op6.WORDS, op6.END):  # shares of a class, with room for one unseen word, add up to 1
        assert sum(c + 1 for c in by_class.get(k, [])) + 1 == pytest.approx(10 ** model.below[k])


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    unigram = rng.random(op6.CLASSES) + 0.1
    unigram /= unigram.sum()
    p = op6.Parameters.start(unigram)
    ids = np.array([op6.START, op6.START, 5, 6, 5, 9, op6.END, op6.START, op6.START, 6, op6.END], np.uint16)

    def loss(flat):
        q = op6.Parameters.of_flat(flat)
        noise = np.minimum(np.searchsorted(np.cumsum(unigram), np.random.default_rng(1).random(op6.SHARED) * unigram.sum()), op6.CLASSES - 1)
        out = 0.0
        for k in range(2, len(ids)):
            if ids[k] != op6.START:
                h = q.r[ids[k - 1]] @ q.c1 + q.r[ids[k - 2]] @ q.c2
                s = lambda w: h @ q.q[w] + q.b[w] - math.log(op6.NOISE * unigram[w])  # noqa: B023, E731
                out += math.log1p(math.exp(-s(ids[k]))) + op6.NOISE / op6.SHARED * sum(math.log1p(math.exp(s(w))) for w in noise)
        return out

    got, n = op6.gradient(ids, p, unigram, 1)
    assert n == 7
    flat, size = p.flat(), op6.CLASSES * op6.DIMENSIONS
    for k in [5 * op6.DIMENSIONS + 3, 6 * op6.DIMENSIONS, op6.START * op6.DIMENSIONS + 1, size + 9 * op6.DIMENSIONS + 2, size + 5 * op6.DIMENSIONS, 2 * size + 7, 2 * size + op6.DIMENSIONS**2 + 40, len(flat) - op6.CLASSES + 5]:
        step = np.zeros_like(flat)
        step[k] = 1e-4
        assert got[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-4, rel=2e-3, abs=1e-4)


def test_model_is_normalised_and_learns_order(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(60)]

    def chain():
        at, out = int(rng.integers(60)), []
        for _ in range(80):
            out.append(vocabulary[at])
            at = (at * 7 + int(rng.integers(3))) % 60
        return " ".join(out)

    df = spark.createDataFrame([(k, chain()) for k in range(400)], "doc_id long, text string")
    model, counts = op6.fit(df.filter("doc_id < 350"))
    for a, b in ((op6.START, op6.START), (3, 8), (700, 1100)):
        assert (10 ** (model.by_first[a].astype(float) + model.by_second[b] - model.norm[a, b])).sum() == pytest.approx(1, abs=1e-4)
    r = op6.score_with(df.filter("doc_id >= 350"), model, counts).selectExpr("sum(score) as own", "sum(base_score) as base").first()
    assert r["own"] > 0.9 * r["base"]


def features_of(samples):
    """The feature text by plain loops."""
    n = len(samples)
    mean = sum(samples) / n
    shares = [c / n for c in Counter(samples).values()]
    columns = [sum(samples[k::64]) / (n // 64) for k in range(64)]
    bits = int("".join("1" if c > mean else "0" for c in columns), 2)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in samples) / n)
    return f"rows={n // 64} mean={mean:.3f} std={deviation:.3f} entropy={abs(sum(p * math.log2(p) for p in shares)):.4f} hash={bits:016x}"


def test_media_round_trip(frame, odd_rows):
    rows = odd_rows + [(49, "first <b> & line\n\n  second &amp; one\n<img src=\"media:aa\">\rthird\n"), (50, "x" * 64), (51, "x" * 65), (52, "\0" * 3), (53, "x" * 64)] + [(60 + k, "the same text") for k in range(150)]
    docs = frame(rows, clash=True)
    got = op8.text_media(docs).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        samples = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        medium, lines = op8.encode(raw), [" ".join(line.split()) for line in (t or "").split("\n") if line.split()]
        assert op8.decode(medium) == (len(raw), samples)
        want.append((str(i), len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), features_of(samples), min(len(lines), 1), len(lines) + 1, len(lines), hashlib.sha256("".join(hashlib.sha256(x.encode()).hexdigest() for x in lines).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *(r[c] for c in op8.COLUMNS[1:])) for r in got) == sorted(want)
    items = op8.interleave(op8.pages_of(docs).select("key", "html"), op8.media_features(op8.store_texts(docs)), "key")
    assert items.filter("kind = 'media'").count() == 2 * len(rows) and items.filter("kind = 'media' and n_bytes is null").count() == 0
    texts = {}
    for r in items.filter("kind = 'text'").collect():
        texts.setdefault(r["key"], []).append((r["pos"], r["text"]))
    kept = sorted(" / ".join(x for _, x in sorted(v)) for v in texts.values())
    assert kept == sorted(" / ".join(" ".join(line.split()) for line in t.split("\n") if line.split()) for _, t in rows if t and t.split())
    assert op8.text_media(frame([])).count() == 0


def test_frequent_references_are_all_resolved(spark):
    """One medium named by most references, beside others, missing ones and null ids."""
    pages = spark.createDataFrame([(k if k % 9 else None, f'<p>a</p><img src="media:aa"><img src="media:m{k % 7}">') for k in range(400)], "doc_id long, html string")
    media = spark.createDataFrame([("aa", 5), *((f"m{k}", k) for k in range(5))], "digest string, size int")
    got = op8.interleave(pages, media)
    assert got.count() == 1200 and got.filter("ref = 'media:aa' and size = 5 and pos = 1").count() == 400
    assert got.filter("pos = 2 and size is null").count() == sum(k % 7 > 4 for k in range(400))


def test_sequences_keep_positions_and_captions(spark):
    page = '<p>Before <b>it</b></p><figure><img src="media:aa"><img src="media:bb"><figcaption>Both &amp; all</figcaption></figure>after<img src=http://x/y.png>end'
    assert op8.sequence(page) == [(0, "text", "Before it", None, None), (1, "media", None, "media:aa", "Both & all"), (2, "media", None, "media:bb", "Both & all"), (3, "text", "after", None, None), (4, "media", None, "http://x/y.png", None), (5, "text", "end", None, None)]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, html string")
    media = spark.createDataFrame([("aa", 5), ("aa", 5), ("cc", 6)], "digest string, size int")
    got = op8.interleave(pages, media).orderBy("doc_id", "pos").collect()
    assert [(r["pos"], r["size"]) for r in got] == [(0, None), (1, 5), (2, None), (3, None), (4, None), (5, None)]


def test_model_doesnt_depend_on_how_texts_are_stored(spark, frame, words):
    """Other files, orders and tasks: the same rows of training text, gradients and scores."""
    texts = frame([(k, words(20 + 7 * (k % 30), k % 25)) for k in range(120)] + [(None, words(30, 3)), (5, None), (5, None)])
    train = texts.filter("doc_id is null or doc_id % 7 <> 2")
    scores = []
    for docs, part in ((texts.coalesce(1), train.coalesce(1)), (texts.repartition(7), train.repartition(6))):
        scores.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"], r["base_score"]) for r in op6.score_texts(docs, part).collect()))
    for a, b in zip(*scores):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 * a[1] and abs(a[3] - b[3]) < 1e-9 * a[1]
