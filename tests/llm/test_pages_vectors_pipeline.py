import re
from collections import Counter
from html.parser import HTMLParser
from math import log

import numpy as np
import pytest

import corpus_pipeline
from helixmill.llm import components, html_text, quality, topk
from .helpers import awkward, docs, prose
from .test_text_operators import brute_base, brute_links, brute_repeats, edits

PAGE = "page_id bigint, url string, html string, text string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_main_text(pages(spark, rows)).collect()}


def site(body, k=0):
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        f'<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home {k}</a></li></ul></nav><!-- c --><div class="ad">Buy {k}</div>'
        f'{body}<aside>Side {k}</aside><section class="comments"><p>First! {k}</p></section><form>Mail <input> now</form><footer>&copy; me</footer></body></html>'
    )


def test_main_text(spark):
    one = site("<article><h1>Title &amp; more</h1><p>Some  <b>bold</b>\n text.<br>Next<p>Second &lt;p&gt;</p><ul><li>a<li>b</ul><script>no()</script><div class='share'>Share</div></article>")
    rows = [(1, "http://h.example/1", one), (2, None, None), (3, "nonsense", ""), (4, "http://h.example/4", "<p>Plain</p>"), (5, "http://h.example/5", "no markup &eacute;"), (5, "http://h.example/5", "no markup &eacute;"), (6, "http://h.example/6", "<article><p>open"), (None, "http://h.example/7", "<main>m</main>out")]
    got = html_text.extract_main_text(pages(spark, rows)).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Title & more\n\nSome bold text. Next\n\nSecond <p>\n\na\n\nb\n\nShare"
    assert (text[2], text[3], text[4], text[5], text[6], text[None]) == ("", "", "Plain", "no markup é", "open", "m")
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_main_text(pages(spark, [])).count() == 0


def test_style_tree_cuts_what_repeats(spark):
    """A block that stands on every page of a host goes; the same words on another host stay."""
    rows = [(k, f"https://one.example/{k}", f"<body><div class='x7'>We use biscuits on this site.</div><div class='body'><p>{prose(30, k)}</p><p>{prose(20, 50 + k)}</p></div></body>") for k in range(8)]
    rows += [(20, "https://two.example/", "<body><div class='x7'>We use biscuits on this site.</div><div class='body'><p>Own text.</p></div></body>")]
    text = texts(spark, rows)
    assert all("biscuits" not in text[k] and text[k] == f"{prose(30, k)}\n\n{prose(20, 50 + k)}" for k in range(8))
    assert text[20] == "We use biscuits on this site.\n\nOwn text."


def test_style_tree_cuts_what_repeats_in_a_section(spark):
    """Boilerplate of a section goes however many other sections a host has, outside articles and in marked elements inside."""
    frame = lambda mark: f"<div class='{mark}'>Words of section {mark}.</div>"
    mark = lambda k: "abcdefgh"[k % 8] * 3
    rows = [(k, f"https://one.example/{k}", f"<body>{frame(mark(k))}<div class='body'><p>{prose(30, k)}</p></div></body>") for k in range(40)]
    rows += [(100 + k, f"https://two.example/{k}", f"<body><article><p>{prose(30, k)}</p>{frame(mark(k))}<div class='{mark(k)}2'>{prose(9, k)}</div></article></body>") for k in range(40)]
    text = texts(spark, rows * 2)
    assert all(text[k] == prose(30, k) and text[100 + k] == f"{prose(30, k)}\n\n{prose(9, k)}" for k in range(40))


def test_other_layouts(spark):
    wrapped = (
        '<body class="home has-sidebar"><div id="page"><div class="siteHeader">Brand</div><div class="with sidebar"><main><h1 class="entry-title">Head</h1>'
        '<div class="entry-content"><p>One.</p><div class="cookieBar cookie">Accept</div><blockquote>Two.</blockquote><pre>a\n b</pre><table><tr><td>x</td><td>y</td></tr></table>'
        '<figure><img alt="no"><figcaption>Cap</figcaption></figure></div></main><div id="comments"><article class="comment">Rude</article></div></div>'
        '<div role="contentinfo">Imprint</div><noscript>no</noscript><template>t</template></div></body>'
    )
    loose = '<div class="post"><h2>Head</h2>Lead <span hidden>x</span>text<p>P</p></div><div class="topbar">Top</div><ul class="nav-list"><li>n</li></ul><p>End'
    text = texts(spark, [(1, "http://a.example/1", wrapped), (2, "http://b.example/1", loose)])
    assert text[1] == "Head\n\nOne.\n\nAccept\n\nTwo.\n\na b\n\nx\n\ny\n\nCap"
    assert text[2].replace("\n\n", "|") in ("Head|Lead|text|P|Top|n|End", "Head|Lead text|P|Top|n|End")


def test_copies_keep_their_article(spark):
    rows = [(k, f"https://one.example/{k}", site(f"<article><h1>Same</h1><p>{prose(40, 1)}</p><p>Part {k % 2}</p></article>", k)) for k in range(12)]
    text = texts(spark, rows)
    assert all(text[k] == f"Same\n\n{prose(40, 1)}\n\nPart {k % 2}" for k in range(12))


def test_long_and_broken_pages(spark):
    long = "<article>" + "".join(f"<p>{prose(50, k)}</p>" for k in range(400)) + "</article>"
    text = texts(spark, [(1, "http://a.example", long), (2, "http://a.example", "<div" * 3000), (3, "http://a.example", "<a <b <c>text</c> < 3 & 4")])
    assert text[1] == "\n\n".join(prose(50, k) for k in range(400)) and "3 & 4" in text[3]


def test_names_do_not_cut_article_text(spark):
    page = '<article><div class="article-header"><h1>Title of it</h1><p>Body</p><div class="legal-analysis"><p>A</p></div><div class="side-by-side"><p>B</p></div><p id="search-results">C</p></div></article>'
    got = texts(spark, [(k, f"http://a.example/{k}", page.replace("Body", prose(20, k))) for k in range(9)] + [(99, "http://b.example", page)])
    assert got[99] == "Title of it\n\nBody\n\nA\n\nB\n\nC" and all(prose(20, k) in got[k] for k in range(9))


NAMES = ("discussion", "related", "menu", "recommended", "share", "zzz", "comments", "ad", "sidebar", "cookie-notice", "consent", "login", "promotion", "nav", "footer", "search", "related-posts")


def test_names_never_cut_what_a_page_has_for_itself(spark):
    """Own paragraphs of an article stay under any name, on one page and on many."""
    one = "<article><h1>T</h1><section class='{0}'><p>{1}</p></section><div id='{0}'><div>{2}</div></div></article>"
    rows = [(i, f"http://{name}.example/", one.format(name, prose(12, i), prose(9, 500 + i))) for i, name in enumerate(NAMES)]
    rows += [(100 + 12 * i + k, f"http://many-{name}.example/{k}", one.format(name, prose(12, 1000 + 12 * i + k), prose(9, 2000 + 12 * i + k))) for i, name in enumerate(NAMES) for k in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == f"T\n\n{prose(12, i)}\n\n{prose(9, 500 + i)}" for i in range(len(NAMES)))
    assert all(got[100 + j].endswith(f"{prose(12, 1000 + j)}\n\n{prose(9, 2000 + j)}") for j in range(12 * len(NAMES)))


def test_names_are_a_prior(spark):
    """Outside of articles a sure name goes once it can be judged, a vague one if its content repeats; before that either only if it repeats."""
    notes = lambda k: f"<div class='comments'>{prose(9, 300 + k)}</div>"
    rows = [(k, f"http://a.example/{k}", f"<body><div class='q'><p>{prose(30, k)}</p>{notes(k)}<p class='notice'>{prose(9, 600 + k)}</p></div></body>") for k in range(12)]
    rows += [(60, "http://b.example/", f"<body><div class='q'><p>one</p>{notes(1)}<div class='notice'>two</div></div></body>")]
    rows += [(70, "http://c.example/", "<article><p>one</p><div class='notice'>two</div></article>"), (71, "http://c.example/2", "<div id='comments'><article><p>three</p></article></div>"), (72, "http://c.example/3", "<div id='comments'>four</div>")]
    rows += [(80 + k, f"http://d.example/{k}", f"<div class='q'><p>{prose(9, k)}</p></div><div class='sponsor'>Buy</div><div class='notice'>Rules</div>") for k in range(2)]
    # In an article: what half of the pages share goes under a name and stays without one.
    rows += [(100 + k, f"http://e.example/{k}", f"<article><p>{prose(9, k)}</p><div class='share'>Tell {k // 6}</div><div class='x'>Told {k // 6}</div></article>") for k in range(12)]
    got = texts(spark, rows)
    assert all(got[k] == f"{prose(30, k)}\n\n{prose(9, 600 + k)}" for k in range(12))
    assert got[60] == f"one\n\n{prose(9, 301)}\n\ntwo"
    assert (got[70], got[71], got[72]) == ("one\n\ntwo", "three", "four")
    assert got[80] == prose(9, 0) and got[81] == prose(9, 1)
    assert all("Tell" not in got[100 + k] for k in range(12))


def mixed_site():
    """Layouts whose names mean nothing; boilerplate stands outside and inside the article."""
    rows = []
    for k in range(30):
        x = f"<div class='x1'><ul><li>Home</li><li>Shop {k % 2}</li></ul></div><div class='x2'><h1>{prose(4, 900 + k)}</h1>" + "".join(f"<p>{prose(15, 40 * k + j)}</p>" for j in range(1 + k % 4))
        rows.append((k, f"http://n.example/{k}", f"<body>{x}<div class='x3'>All rights {('kept', 'held')[k % 7 == 0]}.</div></div><div class='x4'><p>Made by hand</p></div></body>"))
        rows.append((100 + k, f"http://m.example/{k}", f"<article><h1>{prose(5, k)}</h1><p>{prose(20, k)}</p><div class='y'><p>Read our rules.</p></div><section><p>{prose(9, 70 + k)}</p></section></article>"))
    return rows


def test_results_come_from_the_tree(spark):
    rows = mixed_site()
    off = {r.page_id: r.text for r in html_text.extract_main_text(pages(spark, rows), html_text.SiteParams(tree=False)).collect()}
    for params in (html_text.SiteParams(), html_text.SiteParams(broadcast_nodes=0)):
        on = {r.page_id: r.text for r in html_text.extract_main_text(pages(spark, rows * 2), params).collect()}
        for k in range(30):
            assert on[k] == "\n\n".join([prose(4, 900 + k), *(prose(15, 40 * k + j) for j in range(1 + k % 4))])
            assert on[100 + k] == f"{prose(5, k)}\n\n{prose(20, k)}\n\n{prose(9, 70 + k)}"
    assert all(off[k] != on[k] for k in on) and "Made by hand" in off[3] and "Read our rules." in off[103]


class Nodes(HTMLParser):
    """A page's style nodes, texts and child sequences, from Python's own parser; for well-formed pages of block elements."""

    def __init__(self, html):
        super().__init__()
        self.stack, self.seen, self.texts, self.shapes, self.children, self.blocks = [()], set(), set(), set(), [[]], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        name = ".".join([tag, *(v for _, v in attrs)])
        if tag != "body":
            self.children[-1].append(name)
            self.stack.append((*self.stack[-1], name))
            self.seen.add(self.stack[-1])
            self.children.append([])

    def handle_endtag(self, tag):
        if tag != "body":
            inner = self.children.pop()
            if inner:
                self.shapes.add((self.stack[-1], tuple(inner)))
            self.stack.pop()

    def handle_data(self, data):
        self.texts.add((self.stack[-1], data))
        self.blocks.append((self.stack[-1], data))


def brute_tree(htmls):
    """(pages, importance) of every style node of a host, by plain counting."""
    read, want = [Nodes(h) for h in htmls], {}
    for node in {n for r in read for n in r.seen}:
        m = sum(node in r.seen for r in read)
        counts = [Counter(v for r in read for n, v in part(r) if n == node) for part in (lambda r: r.texts, lambda r: r.shapes)]
        content = 1 - sum(log(n) for n in counts[0].values()) / len(counts[0]) / log(m) if counts[0] and m > 1 else 0
        shares = [n / sum(counts[1].values()) for n in counts[1].values()]
        weight = 0.9 ** len(shares)
        want[node] = (m, (1 - weight) * -sum(p * log(p) for p in shares) / log(m) + weight * content if m > 2 else 1.0)
    return want


def brute_texts(htmls):
    """Main texts of a host's pages without articles or names that say anything: blocks not under a branch of low importance."""
    tree = brute_tree(htmls)
    branch = {node: max(x for other, (_, x) in tree.items() if other[: len(node)] == node) for node in tree}
    return ["\n\n".join(text for node, text in Nodes(h).blocks if all(branch[node[:i]] >= 0.3 for i in range(1, len(node) + 1))) for h in htmls]


def test_importances_against_brute_force(spark):
    """The same entropies from plain counting over each page's own elements."""
    rows = [r for r in mixed_site() if r[0] < 100]
    want = brute_tree([html for _, _, html in rows])
    frame = pages(spark, rows).select("url", "html")
    got = sorted((r.m, round(r.importance, 9)) for r in html_text.importances(html_text.style_rows(frame)).where("size(chain) > 0").collect())
    assert got == sorted((m, round(x, 9)) for m, x in want.values()) and len({x for _, x in want.values()}) >= 5


def test_texts_against_a_brute_force_tree(spark):
    """On sites where only the tree decides, random ones included, each page's text is what plain counting leaves."""
    import random

    rng, rows = random.Random(11), [r for r in mixed_site() if r[0] < 100]
    for site_id in range(6):
        names = [rng.choice("abcdefghijklmnopqrst") * 3 for _ in range(8)]
        for k in range(15):
            parts = []
            for i, name in enumerate(names):
                said = prose(6, 100 * i + k % 2 if i < 3 else rng.choice((i, 100 * i + k % rng.choice((2, 5)), 10_000 * (site_id + 1) + 100 * i + k)))
                parts.append(f"<div class='{name}'><p>{said}</p>" + (f"<div class='in{i}'>{prose(4, k % 3 if i % 2 else 5000 + 20 * site_id + k)}</div>" if rng.random() < 0.7 else "") + "</div>")
            rng.shuffle(parts)
            rows.append((1000 + 20 * site_id + k, f"http://r{site_id}.example/{k}", f"<body>{''.join(parts)}</body>"))
    got, hosts = texts(spark, rows), {}
    for page_id, url, html in rows:
        hosts.setdefault(html_text.page_host(url), []).append((page_id, html))
    changed = 0
    for members in hosts.values():
        for (page_id, html), want in zip(members, brute_texts([h for _, h in members])):
            assert got[page_id] == want
            changed += want != "\n\n".join(t for _, t in Nodes(html).blocks)
    assert changed > 60


def test_deep_and_broken_pages():
    from time import perf_counter

    for html in ("<p>x</p>" + "<div>" * 100_000 + "x", "<div><b>" * 50_000 + "x", "<li>x<b>" * 50_000, "<p>x</i>" * 50_000, "<div>" * 50_000 + "x" + "</p></span>" * 50_000, 'x<a "' * 100_001, "x" + "<a " * 100_000 + '"', "<table><tr><td>x" * 20_000):
        began = perf_counter()
        assert len(html_text.main_text(html_text.parse(html), frozenset())) and perf_counter() - began < 20


# 10. Top-k.

VECTOR = "vec_id bigint, embedding array<float>, label int, block string, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "b", "x") for i, v in rows], VECTOR)


def brute_top(rows, k=5):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for q, a in sorted({i: a for i, a in sorted(good, key=lambda r: r[1], reverse=True)}.items()):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_top_k(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype(float).tolist()) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, [0.5, -2.0]), (3, rows[9][1]), (100, [9.0])]
    got = topk.top_k(vectors(spark, rows), topk.TopKParams(block=block, group=3))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows)


def test_reading_stops_early():
    """Unit vectors of 64 dimensions without structure: no query reads the lists to their end, and with floors most stop far before."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    z = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    queries, ids = z[:60], np.arange(6000)
    scores = z @ queries.T
    scores[np.arange(60), np.arange(60)] = -np.inf
    params, alone, helped = topk.TopKParams(), [], []
    found = topk.aggregate(ids[:2000], z[:2000], ids[:60], queries, np.full(60, -np.inf), params, alone)
    floors = np.array([min(s for q, _, s in found if q == k) for k in range(60)], float)
    later = [topk.aggregate(ids[a : a + 2000], z[a : a + 2000], ids[:60], queries, floors, params, helped) for a in (2000, 4000)]
    assert len(alone) == 60 and max(alone) < 1 and np.mean(alone) < 0.95 and np.mean(helped) < 0.85
    for k in range(60):
        best = sorted((-s, i) for part in (found, *later) for q, i, s in part if q == k)[:5]
        assert best == sorted((-s, i) for i, s in enumerate(scores[:, k]))[:5]



def test_top_k_of_few(spark):
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])])).count() == 0
    got = topk.top_k(vectors(spark, [(0, [1.0]), (1, [-1.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, -65536)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = np.floor(rng.normal(size=(60, 6)) * 256), np.floor(rng.normal(size=(4, 6)) * 256)
    lists, at = topk.Lists(x), np.array([0, 3, 5, 59])
    for depth in (1, 5, 30, 60):
        low, high = lists.bounds(at, depth, q)
        assert (low <= x[at] @ q.T).all() and (x[at] @ q.T <= high).all()
    assert (low == high).all()


def test_floors_cross_blocks():
    """With a floor a cell keeps what reaches it, and looks closely at little else."""
    rng = np.random.default_rng(9)
    x, q = np.floor(rng.normal(size=(2000, 8)) * 256), np.floor(rng.normal(size=(5, 8)) * 256)
    ids, exact = np.arange(2000), x @ q.T
    floors = np.sort(exact, axis=0)[-3]
    found = topk.aggregate(ids, x, np.arange(5000, 5005), q, floors, topk.TopKParams())
    for c in range(5):
        mine = [(i, s) for query, i, s in found if query == 5000 + c]
        assert {i for i, s in mine if s >= floors[c]} == set(np.flatnonzero(exact[:, c] >= floors[c])) and all(s == exact[i, c] for i, s in mine)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (50, [1.0, 2.0]), (1, [3.0, 1e17]), (2, [-1e308, 5.0]), (3, [2.5, -1.0]), (4, [1e30, 0.0]), (5, [7.0, 7.0]), (6, [-3.0, 4.0]), (7, [1e9, 1e9]), (8, [0.1, 0.2])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, topk.TopKParams(block=4)).collect())
    whole = {i: [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want


# Components.


def test_components_with_hot_nodes(spark, monkeypatch):
    from helixmill.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    links = [(1000 + i, i % 3) for i in range(60)] + [(i, i + 1) for i in range(2000, 2030)] + [(3000, 3000 + i) for i in range(1, 40)]
    got = dict((r.node, r.root) for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{x: x for x in range(3)}, **{1000 + i: i % 3 for i in range(60)}, **dict.fromkeys(range(2000, 2031), 2000), **dict.fromkeys(range(3000, 3040), 3000)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (301, 300)] + [(500, i) for i in range(501, 540)]
    got = dict((r.node, r.root) for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 300: 300, 301: 300, **dict.fromkeys(range(500, 540), 500)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# The pipeline against brute force on a small fixture.


def corpus():
    rows = [(i, prose(120, i)) for i in range(60)]
    rows += [(100 + i, edits(prose(120, i), 1, i)) for i in range(10)] + [(200, prose(120, 3)), (201, prose(120, 3))]
    rows += [(300 + i, " ".join(prose(80, 70 + i).split() + prose(60, 999).split())) for i in range(5)]
    rows += [(400 + i, " ".join(f"{w.upper()}!!" for w in prose(60, 900 + i).split())) for i in range(30)]
    return rows + [(500, prose(60, 800) + " password = hunter2222 end"), (501, prose(60, 800).upper())]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(not t.isupper()), 0) for i, t in rows]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    frame, held = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        held.append(frame.collect())
    assert all(len(r) == 5 for s in held[:-1] for r in s)
    trees = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = [(i, t) for i, t in rows if trees.score(quality.matrix([t]))[0] >= 0.7]
    assert sorted((r.doc_id, r.text) for r in held[0]) == sorted(good) and {i for i, _ in good} == {i for i, t in rows if not t.isupper()}
    sets, links = brute_links(good)
    keep, seen = [], set()
    for i, t in sorted(good):
        if sets[t] in seen:
            continue
        keep.append((i, t))
        todo = [sets[t]]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += links[s]
    assert sorted((r.doc_id, r.text) for r in held[1]) == keep
    want = {i: (removed, digest) for i, _, removed, digest in brute_repeats(keep)}
    from hashlib import sha256

    assert {r.doc_id for r in held[2]} == set(want)
    for r in held[2]:
        removed, digest = want[r.doc_id]
        assert sha256(r.text.encode()).hexdigest() == digest if removed else r.text == dict(keep)[r.doc_id]
    assert sum(x for x, _ in want.values()) >= 4 * 60
    for a, b in zip(sorted(held[2]), sorted(held[3])):
        masked = a.text
        for start, _, end in reversed(brute_base(a.text)):  # spans of the fixture don't overlap
            masked = f"{masked[:start]}[SECRET]{masked[end:]}"
        assert b.text == masked and b.n_chars == len(b.text)
    assert any("[SECRET]" in r.text for r in held[3])
    assert sorted((r.doc_id, r.n_tokens) for r in held[4]) == sorted((r.doc_id, len(r.text.split())) for r in held[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in held[4])


def kept_texts(rows):
    """What the substring stage leaves of rows (doc_id, text), by brute force on windows of 50 words."""
    split, first = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows], {}
    rank = lambda i: float("inf") if i is None else i
    for i, _, w in split:
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, t, w in split:
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < rank(i) for p in range(s, s + 50)}
        left = [x for p, x in enumerate(w) if p not in gone]
        if left or not gone:
            out.append((i, " ".join(left) if gone else t))
    return Counter(out)


def test_stages_take_awkward_documents(spark, tmp_path):
    """Row by row: what each stage makes of null, empty, repeated and long texts, and of an empty table."""
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows, folder = awkward(), str(tmp_path)
    pairs = lambda frame: Counter((r.doc_id, r.text) for r in frame.collect())
    given = docs(spark, rows)
    assert pairs(corpus_pipeline.repeated_passages(spark, given, folder)) == kept_texts(rows)
    assert Counter(map(tuple, corpus_pipeline.secrets(spark, given, folder).collect())) == Counter(rows)
    packed = corpus_pipeline.packing(spark, given, folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed) and all(r.pad_to >= r.n_tokens for r in packed)
    accepted = Counter((r.doc_id, r.predicted) for r in quality.classify(given, spark.read.parquet(f"{folder}/labels.parquet")).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.quality(spark, given, folder).collect()) == Counter({i: n for (i, p), n in accepted.items() if p}) == Counter()
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs(spark, []), folder)
        assert empty.count() == 0 and (stage is corpus_pipeline.packing or empty.schema.simpleString() == docs(spark, []).schema.simpleString())
    clash = docs(spark, rows, clashing=True).drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, clash, folder)
        assert (stage is corpus_pipeline.packing or out.columns == clash.columns) and Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in stage(spark, given, folder).collect())


@pytest.mark.parametrize("hot", [1000, 20])
def test_stages_take_many_repeated_rows(spark, tmp_path, monkeypatch, hot):
    """Hundreds of rows of one text without an id beside an earlier holder: whole results, and no array that grows with the copies."""
    from helixmill.llm import common, substring_dedup

    monkeypatch.setattr(common, "HOT", hot)
    text = prose(400, 1)
    rows = [(5, prose(60, 2) + " " + text)] + [(None, text + " tail")] * 300 + [(7, prose(80, 3))] * 200 + [(8, prose(80, 3) + " " + prose(70, 4)), (None, None), (None, None)]
    given, folder = docs(spark, rows), str(tmp_path)
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, given, folder).collect()) == kept_texts(rows)
    found = substring_dedup.repeats(substring_dedup._keyed(given), substring_dedup.RepeatParams()).collect()
    assert found and max(len(r.codes) for r in found) < 60
    near = corpus_pipeline.near_copies(spark, given, folder).collect()
    assert Counter(r.doc_id for r in near) == Counter([5, 7, 8, None])


def test_near_copies_keeps_one_of_each_class(spark, tmp_path):
    """Unrelated texts without an id, or with one id between them, are classes of their own."""
    rows = [(None, prose(120, i)) for i in range(8)] + [(None, edits(prose(120, i), 1, i)) for i in range(4)] + [(None, prose(120, 7))] * 3
    rows += [(9, prose(120, 20 + i)) for i in range(3)] + [(8, edits(prose(120, 20), 1, 1)), (10, prose(120, 21)), (None, prose(120, 22)), (11, prose(120, 0))]
    rows += [(None, None), (None, ""), (12, " ")]
    sets, links = brute_links([(i, t or "") for i, t in rows])
    classes, seen = [], set()
    for s in sets.values():
        todo, found = [s], set()
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                found.add(s)
                todo += links[s]
        if found:
            classes.append(found)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs(spark, rows), str(tmp_path)).collect()]
    assert len(kept) == len(classes) == 12 and set(kept) <= set(rows)
    for members in classes:
        mine = [i for i, t in kept if sets[t or ""] in members]
        ids = [i for i, t in rows if sets[t or ""] in members and i is not None]
        assert mine == [min(ids, default=None)]
