import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import html_extract as hx
from siltstone.llm import toxicity as tox

ARTICLE = "One two three four five six seven eight nine ten eleven twelve."
CASES = [
    (f"<article><h1>Title</h1><p>{ARTICLE}<br>again</article>", f"Title {ARTICLE} again"),
    (f"<nav><ul><li><a href=x>Menu</a></ul></nav><main><p>{ARTICLE}</main><footer>foot</footer>", ARTICLE),
    (f"<header>Site name</header><article><header><h1>T</h1></header><p>{ARTICLE}</p><aside>side</aside><footer>tags</footer></article>", f"T {ARTICLE}"),
    (f"<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x</p><div class='cookie-notice'>We use cookies</div><form>Mail <input> <button>Go</button></form><p>{ARTICLE}</article>", f"a <b> &amp; é x {ARTICLE}"),
    (f"<script>var t='</p>';</script><style>p{{}}</style><article>x{ARTICLE}<!-- no --><section id=comments><p>{ARTICLE}</section></article>", f"x{ARTICLE}"),
    (f"<div class='ad'>{ARTICLE}</div><div id='content'><p>{ARTICLE}</p></div><div class='sidebar'><p>{ARTICLE}</div>", ARTICLE),
    (f"<article><p>{ARTICLE}<div hidden>no</div><div style='display: none'>no</div><p>1 < 2 & 3 > 2", f"{ARTICLE} 1 < 2 & 3 > 2"),
    ("<article><p><b>Short", "Short"),
    ("<article><p>cut <a hr", "cut"),
    (f'<div class="site-content has-sidebar"><article><p>{ARTICLE}</article><div class="sidebar">x y z</div></div>', ARTICLE),
    (f'<div id="content" class="no-sidebar"><main><p>{ARTICLE}</main></div>', ARTICLE),
    (f'<div class="content-sidebar-wrap"><article><p>{ARTICLE}</article><div class="sidebar-left">x y z</div></div>', ARTICLE),
    (f'<form id="aspnetForm"><div><article>{ARTICLE}</article></div></form>', ARTICLE),
    (f'<form id="aspnetForm"><div><p>{ARTICLE} {ARTICLE}<p>{ARTICLE} {ARTICLE}</div><div class="menu-top"><a href=x>One</a></div></form>', " ".join([ARTICLE] * 4)),
    (f'<article><p>{ARTICLE}<section class="user-feedback"><p>{ARTICLE}</section></article>', ARTICLE),
    (f'<article><p>{ARTICLE}</article><section><article class="comment"><p>{ARTICLE}</article></section>', ARTICLE),
    (f"<article><p>{ARTICLE}</p><div><a href=1><div>Seven other things you would like today</div></a><a href=2><div>Another long teaser that leads somewhere else</div></a></div></article>", ARTICLE),
    (f"<nav><a href=x>Menu</a></nav><article><h1><a href=y>A linked title here</a></h1><p>{ARTICLE} {ARTICLE}</article>", f"A linked title here {ARTICLE} {ARTICLE}"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("<script>never closed <p>x", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert hx.main_text(page or "") == want


def test_pages(spark):
    rows = [(i, f"u{i}", p, 1) for i, (p, _) in enumerate(CASES)] + [(None, None, CASES[0][0], 1), (99, "long", "<article><p>" + "w " * 400_000, 1)]
    out = hx.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows) and all(by[i].text == want and by[i].n_chars == len(want) for i, (_, want) in enumerate(CASES))
    assert by[99].n_chars == 799_999 and by[None].text == CASES[0][1]
    assert hx.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string, text int")).count() == 0


def test_tree_fits_its_table():
    table = np.array(hx.LABELLED)
    assert np.mean([hx.classify(hx.default_tree(), r[:-1]) == r[-1] for r in table]) >= 0.95


def test_tree_reads_the_neighbours():
    used = set()

    def walk(t):
        if isinstance(t, tuple):
            used.add(hx.FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(hx.default_tree())
    assert {"words", "links", "in_main", "around"} <= used and used & {"links_before", "words_before"} and used & {"links_after", "words_after"}


def test_pages_of_a_table():
    """Whole pages against their article element by another parser; then the same pages with all elements renamed, judged by words and links alone."""
    import os
    import re
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.text = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.text.append(" " if tag in hx.BLOCK or tag == "br" else "")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.text.append(" " if tag in hx.BLOCK else "")

        def handle_data(self, data):
            self.text.append(data if self.inside else "")

    got = want = both = 0
    for page in pq.read_table(path, columns=["html"])["html"].to_pylist():
        parser = Article()
        parser.feed(page or "")
        article = " ".join("".join(parser.text).split())
        assert hx.main_text(page or "") == article
        plain = re.sub(r"<(/?)(?:nav|article|footer|ul)(?=[ >])", r"<\1div", page or "").replace(' class="ad"', "")
        bare, words = hx.main_text(plain).split(), article.split()
        got, want = got + len(bare), want + len(words)
        both += sum((__import__("collections").Counter(bare) & __import__("collections").Counter(words)).values())
    assert both / got > 0.9 and both / want > 0.9, (both / got, both / want)


def test_hostile_markup_ends():
    for page in ("<" * 50_000, "<a href='" * 20_000, "<p " + "x=\"" * 20_000, "<div>" * 20_000 + "x", "&" * 50_000):
        hx.main_text(page)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = rnd.random() < 0.2
        sentences = [[rnd.choice(words) for _ in range(rnd.randrange(3, 12))] for _ in range(rnd.randrange(1, 30))]
        if toxic:
            rnd.choice(sentences).append(rnd.choice(["blortish", "blortest", "grumf"]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic != (rnd.random() < 0.02)), int(toxic)))
    return rows


def test_learns_and_locates(spark):
    rows = corpus(1_500, 8)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(None, 1), (3, None), (999_999, 1)], "doc_id bigint, toxic int")
    model = tox.train(docs, labels)
    truth = {i: (y, t) for i, t, _, y in rows}
    out = tox.score_texts(docs, model).withColumn("held", tox.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert 200 < len(held) < 400
    assert np.mean([(r["__score"] >= 0.5) == truth[r.doc_id][0] for r in held]) > 0.97
    for r in out:
        if r["__score"] >= 0.5 and truth[r.doc_id][0]:
            bad = [r.text[x.start : x.end] for x in r["__sentences"]]
            assert bad and all("blort" in b or "grumf" in b for b in bad) and not any("." in b for b in bad)
        else:
            assert not r["__sentences"] or r["__score"] >= 0.5
    same = tox.train(docs.repartition(7), labels.repartition(3))
    assert same == model


def test_odd_inputs(spark):
    model = tox.Model({"bad": 20.0}, tox.PLAIN, 0.001)
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "so bad."), (4, "fine. " * 100_000), (5, "x" * 500_000)], "doc_id bigint, text string")
    scores = {r.doc_id: r["__score"] for r in tox.score_texts(docs, model).collect()}
    assert scores[1] == scores[2] == pytest.approx(0.001) and scores[None] > 0.9 and scores[4] < 0.5 and scores[5] < 0.5
    assert tox.score_texts(docs.limit(0), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert tox.train(docs, none).weights == {}


def test_more_than_400_features_and_repeated_rows(spark):
    """Each of 600 toxic words stands in twenty of the fitted documents; all are learned. A labelled document that repeats is one."""
    words = [f"q{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(600)]
    assert len(set(words)) == 600
    ids = [i for i in range(11_000) if __import__("zlib").crc32(str(i).encode()) % 5][:7_900]
    rows = [(i, "some plain words here. You " + ". ".join(words[(k * j + k // 600) % 600] for j in (1, 7, 11, 13)) + " there", 1) if k < 3_000 else (i, "some plain words here. You and me there", 0) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(rows[0][0], "zz again")] * 3, "doc_id bigint, text string")
    model = tox.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    assert len(set(words) & set(model.weights)) == 600
    got = tox.score_texts(spark.createDataFrame([(1, f"İ plain. Oh {words[500]}! And {words[3]}.", 2, 3)], "doc_id bigint, text string, __score int, __text int"), model).first()
    assert got["__text"] == 3 and [(x.start, x.end) for x in got["__sentences"]] == [(8, 15), (16, 24)]


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", tox.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
