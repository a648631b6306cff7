"""Pages as their authors write them: names that hold an article, sections called like site furniture, pages without an article element."""

import pytest

from siltstone.llm import html_extract as hx

S = ["Rain fell on the valley for nine days before the river rose.", "Farmers moved their cattle to the higher fields in good time.", "Nobody in the village could remember such a flood in spring.", "When the water fell again the meadows were covered with silt."]
P = " ".join(S)
Q = " ".join(reversed(S))

KEPT = [
    (f'<div class="mt-4 hidden md:block"><article><p>{P}</p></article></div>', P),
    (f'<article><p title="the hidden gem">{P}</p><p>See <span title="a hidden gem">the old mill</span> there.</p></article>', f"{P} See the old mill there."),
    (f'<article class="hentry comments-closed"><p>{P}</p></article>', P),
    (f'<div class="post comments-open"><article><p>{P}</p></article></div>', P),
    (f'<article><p>{P}</p><section id="discussion"><h2>Discussion</h2><p>{Q}</p></section></article>', f"{P} Discussion {Q}"),
    (f'<article><p>{P}</p><section id="notice"><h2>Notice</h2><p>{Q}</p></section></article>', f"{P} Notice {Q}"),
    (f'<div role="main"><section id="navigation"><h1>Navigation</h1><p>{P}</p><section id="menu"><h2>Menu</h2><p>{Q}</p></section></section></div>', f"Navigation {P} Menu {Q}"),
    (f'<article><p>{P}</p><h2>References</h2><ol><li><a href="a">On floods and their causes</a></li><li><a href="b">The silt of rivers</a></li><li><a href="c">Valleys, a survey of their making</a></li></ol></article>', f"{P} References On floods and their causes The silt of rivers Valleys, a survey of their making"),
    (f"<article><p>{P}</p><blockquote><p>{S[0]}</p><footer>An old farmer</footer></blockquote><footer>Posted on Monday</footer></article>", f"{P} {S[0]} An old farmer"),
    ("<h1>Short title</h1><p>One short line.</p>", "Short title One short line."),
    (f'<div style="display:none"><article><p>{P}</p></article></div>', P),
    (f'<div class="elementor-widget widget"><p>{P}</p><p>{Q}</p></div><div class="widget">Archive of May</div>', f"{P} {Q}"),
]
DROPPED = [
    (f'<article><p>{P}</p><div hidden>secret words</div><div aria-hidden="true">more secret</div><p style="color:red; display : none">gone</p></article>', P),
    (f'<article><p>{P}</p><section id="comments"><h2>Comments</h2><article><p>{Q} {Q}</p></article><article class="comment"><p>{Q}</p></article></section></article>', P),
    (f'<article><p>{P}</p></article><div class="comments-area"><article class="comment-body"><p>{Q} {Q} {Q}</p></article></div>', P),
    (f'<article class="comment"><p>{Q}</p></article><article><p>{P}</p></article>', P),
    (f'<main><div class="notice">We have moved</div><p>{P}</p><section class="discussion"><p>{S[0]}</p></section></main>', P),
    (f'<nav id="navigation"><a href="a">Home</a></nav><article><p>{P}</p></article><footer><p>{S[0]}</p></footer>', P),
]


@pytest.mark.parametrize("page,want", KEPT + DROPPED)
def test_shapes(page, want):
    assert hx.main_text(page) == want


def pages_without_article():
    """Kept apart from the labelled table: layouts of divs, of tables and of a manual, with furniture around their texts."""
    texts = [[P, Q], [P, S[1], Q, S[2] + " " + S[3]], [S[0] + " " + S[2], Q, P, P], [Q]]
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Shop now", "About us"))
    for k, body in enumerate(texts * 3):
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        title = f"<h1>The flood of year {k}</h1>"
        inside = f"The flood of year {k} " + " ".join(body)
        if k % 3 == 0:
            yield f'<ul class="top-nav">{links}</ul><div id="wrap"><div class="entry">{title}{paragraphs}</div><div class="sidebar"><h3>More</h3><ul>{links}</ul></div></div><div id="foot-copyright"><a href="c">Contact</a> 2024</div>', inside
        elif k % 3 == 1:
            yield f"<table><tr><td><ul>{links}</ul></td><td>{title}{paragraphs}</td></tr><tr><td><a href=i>Imprint</a> <a href=p>Privacy</a></td></tr></table>", inside
        else:
            yield f'<div class="toc"><ul>{links}</ul></div><div class="document"><div class="section">{title}{paragraphs}</div></div><div role="search"><form><input> Search</form></div><div class="cookie-banner">{S[0]} <a href=y>Yes</a></div>', inside


def test_pages_without_an_article_element():
    got = want = both = 0
    for page, text in pages_without_article():
        a, b = hx.main_text(page).split(), text.split()
        counts = {w: b.count(w) for w in b}
        both += sum(min(a.count(w), n) for w, n in counts.items())
        got, want = got + len(a), want + len(b)
    print("precision", both / got, "recall", both / want)
    assert both / got > 0.95 and both / want > 0.95
