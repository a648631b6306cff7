"""Main text of web pages: flat text blocks, classified by a decision tree over their and their neighbours' words and links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)

# HTML elements by what they do to text.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "option", "object", "canvas")
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
AROUND = frozenset("nav footer aside menu dialog button fieldset".split())
#: Words in class, id or role of an element that mark it as not belonging to the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog discussion feedback footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion reactions related replies respond responses search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Of these, what no element that holds the article is called; the first few not even where they are the heading of a section.
READERS = frozenset("comment comments disqus feedback reactions replies respond responses".split())
STRICT = frozenset("comment comments disqus".split())
#: Compound names with one of these say what a page has beside the element, or how it stands: has-sidebar, comments-open.
BESIDE = frozenset("has no not with without and open closed enabled disabled allowed status on off".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "around", "item")
#: A small labelled table of blocks, made by hand: the FEATURES of a block, then 1 if it belongs to the main text.
LABELLED = (
    # inside article or main, nothing around it
    (1, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0, 1), (3, 0.0, 6, 1.0, 80, 0.0, 1, 0, 0, 1), (8, 0.0, 12, 0.0, 120, 0.0, 1, 0, 0, 1), (12, 0.1, 30, 0.0, 3, 0.0, 1, 0, 0, 1), (25, 0.0, 8, 0.0, 60, 0.1, 1, 0, 0, 1),
    (60, 0.05, 25, 0.0, 90, 0.0, 1, 0, 0, 1), (200, 0.0, 2, 0.0, 0, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 1), (40, 0.3, 50, 0.0, 10, 0.9, 1, 0, 0, 1), (1, 0.0, 200, 0.0, 5, 1.0, 1, 0, 0, 1),
    (15, 0.2, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (5, 0.4, 60, 0.0, 60, 0.0, 1, 0, 0, 1), (2, 0.5, 40, 0.0, 30, 0.0, 1, 0, 0, 1), (1, 1.0, 60, 0.0, 45, 0.0, 1, 0, 0, 1), (4, 1.0, 25, 0.1, 70, 0.0, 1, 0, 0, 1),
    # teasers and link lists inside article or main: links among links
    (8, 1.0, 8, 1.0, 8, 1.0, 1, 0, 0, 0), (14, 1.0, 12, 1.0, 11, 1.0, 1, 0, 0, 0), (6, 1.0, 90, 0.0, 7, 1.0, 1, 0, 0, 0), (9, 1.0, 9, 1.0, 80, 0.0, 1, 0, 0, 0), (7, 1.0, 10, 1.0, 0, 0.0, 1, 0, 0, 0),
    (12, 0.9, 40, 0.0, 10, 0.9, 1, 0, 0, 0), (10, 0.9, 9, 1.0, 60, 0.1, 1, 0, 0, 0), (5, 1.0, 6, 0.9, 4, 1.0, 1, 0, 0, 0), (6, 1.0, 0, 0.0, 60, 0.0, 1, 0, 0, 1), (9, 1.0, 0, 0.0, 25, 0.1, 1, 0, 0, 1),
    (3, 1.0, 70, 0.0, 0, 0.0, 1, 0, 0, 1), (7, 0.9, 40, 0.1, 50, 0.0, 1, 0, 0, 1), (11, 0.3, 9, 1.0, 8, 1.0, 1, 0, 0, 1), (20, 0.0, 6, 1.0, 7, 1.0, 1, 0, 0, 1),
    # short ends of an article
    (7, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (5, 0.0, 14, 0.0, 0, 0.0, 1, 0, 0, 1), (8, 0.0, 12, 0.0, 2, 1.0, 1, 0, 0, 1), (6, 0.2, 30, 0.0, 2, 0.0, 1, 0, 0, 1), (4, 0.0, 1, 0.0, 3, 0.0, 1, 0, 0, 1), (9, 0.1, 20, 0.0, 3, 1.0, 1, 0, 0, 1),
    # navigation, adverts, notices, forms, sidebars, footers, comments, wherever they stand
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0), (12, 0.0, 5, 1.0, 40, 0.0, 0, 1, 0, 0), (40, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (30, 0.1, 80, 0.0, 0, 0.0, 0, 1, 0, 0),
    (8, 0.5, 90, 0.0, 0, 0.0, 0, 1, 0, 0), (120, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0, 0), (25, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0, 0), (3, 1.0, 40, 0.0, 60, 0.0, 1, 1, 0, 0), (60, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0, 0),
    (1, 0.0, 120, 0.0, 60, 0.0, 1, 1, 0, 0), (5, 0.2, 0, 0.0, 12, 0.0, 0, 1, 0, 0), (200, 0.0, 10, 0.0, 10, 0.0, 1, 1, 0, 0), (15, 0.9, 15, 0.9, 15, 0.9, 0, 1, 0, 0), (2, 0.0, 2, 0.0, 90, 0.0, 0, 1, 0, 0),
    # pages without such elements: long blocks with few links, and short ones between them
    (60, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (45, 0.05, 60, 0.0, 80, 0.0, 0, 0, 0, 1), (120, 0.1, 5, 0.0, 1, 1.0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 1), (20, 0.0, 6, 0.0, 90, 0.0, 0, 0, 0, 1),
    (7, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (4, 0.0, 3, 1.0, 70, 0.0, 0, 0, 0, 1), (9, 0.1, 25, 0.0, 50, 0.0, 0, 0, 0, 1), (3, 0.0, 80, 0.0, 35, 0.0, 0, 0, 0, 1), (35, 0.2, 10, 0.0, 30, 0.0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 2, 0.0, 0, 0, 0, 0), (25, 0.8, 4, 1.0, 20, 0.9, 0, 0, 0, 0),
    (50, 0.9, 10, 0.9, 30, 0.8, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (8, 0.5, 40, 0.0, 3, 0.6, 0, 0, 0, 0), (4, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 0), (14, 0.7, 60, 0.0, 60, 0.0, 0, 0, 0, 0),
    (8, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0), (7, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0), (6, 0.0, 30, 0.0, 1, 0.0, 0, 0, 0, 0), (9, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 1), (13, 0.0, 14, 0.0, 0, 0.0, 0, 0, 0, 1),
    # list items: what an article links to belongs to it, lists of links elsewhere don't
    (6, 1.0, 1, 0.0, 4, 1.0, 1, 0, 1, 1), (4, 1.0, 6, 1.0, 7, 1.0, 1, 0, 1, 1), (7, 1.0, 4, 1.0, 0, 0.0, 1, 0, 1, 1), (9, 0.9, 60, 0.0, 8, 1.0, 1, 0, 1, 1), (14, 1.0, 12, 1.0, 20, 0.0, 1, 0, 1, 1), (3, 1.0, 3, 1.0, 3, 1.0, 1, 0, 1, 1), (20, 0.0, 15, 0.0, 12, 0.1, 1, 0, 1, 1),
    (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 1, 0), (5, 1.0, 60, 0.0, 6, 1.0, 0, 0, 1, 0), (7, 1.0, 5, 1.0, 0, 0.0, 0, 0, 1, 0), (30, 0.05, 40, 0.0, 25, 0.0, 0, 0, 1, 1), (3, 1.0, 4, 1.0, 3, 1.0, 1, 1, 1, 0), (8, 0.5, 6, 1.0, 40, 0.0, 0, 1, 1, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2):
    """A binary tree by Gini impurity: (feature, threshold, left, right), or a class at a leaf. Ties take the first feature and the lowest threshold."""
    share = labels.mean()
    if depth == 0 or share in (0, 1) or len(labels) < 2 * least:
        return int(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= cut
            if least <= left.sum() <= len(labels) - least:
                gini = sum(part.size * part.mean() * (1 - part.mean()) for part in (labels[left], labels[~left]))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, float(cut), left)
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    _, f, cut, left = best
    return f, cut, grow(rows[left], labels[left], depth - 1, least), grow(rows[~left], labels[~left], depth - 1, least)


@cache
def default_tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


#: Marks of elements that aren't the article's: by readers' names and by being hidden, by a whole name, by a part of a name or as a form.
FIRM, WHOLE, LOOSE = 1, 2, 3
#: Share of the article's words from which on a mark is the name of a wrapper.
WRAPS = {WHOLE: 0.8, LOOSE: 0.5}


def attributes(attrs: str) -> dict[str, str]:
    """The first value of each attribute, references decoded; the empty text where it has none."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower()))


def _mark(tag: str, given: dict[str, str]) -> tuple[int, str]:
    """The kind of mark that an element has by its attributes, 0 for none, and the name of a section that its heading may explain."""
    found, heading = (LOOSE if tag == "form" else 0), ""
    if not given or tag in ("html", "body"):
        return found, heading
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or INVISIBLE.search(given.get("style", "")):
        return FIRM, heading
    for attribute in ("class", "role", "id"):
        for name in given.get(attribute, "").lower().split():
            parts = set(re.split(r"[^a-z0-9]+", name))
            if parts & BESIDE and not parts <= NAMES:
                continue
            kind = FIRM if parts & READERS else 0 if tag in MAIN else WHOLE if name in NAMES else LOOSE if parts & NAMES else 0
            if kind and (not found or kind < found):
                found = kind
                heading = slug(name) if tag == "section" and attribute == "id" and not parts & STRICT else ""
    return found, heading


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """The text blocks of a page in order: text, words, words in links, in article or main, around it, in a list item. White space is folded, references are decoded.

    A mark counts for nothing if all of the page's article and main elements begin within it, or if a section's own heading says its name. Nor
    does one by a name if most of the article's words, or where there is none of all words that could be, stand in it: it is a wrapper's then.
    """
    out: list[tuple[str, int, int, bool, bool, bool, tuple[int, ...]]] = []
    kinds: list[int] = []  # of the marks met, by number
    named: dict[int, str] = {}  # names that the first block of a section may explain
    void: set[int] = set()
    mains: list[frozenset[int]] = []  # marks that hold the outermost article and main elements
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # tag, in main, hard, numbers of marks
    state: tuple[bool, bool, tuple[int, ...]] = (False, False, ())
    link = -1  # elements open where the current link began
    text: list[str] = []
    words = linked = items = quotes = 0

    def add(raw: str) -> None:
        nonlocal words, linked
        if raw:
            text.append(raw)
            n = len(raw.split())
            words += n
            linked += n * (link >= 0)

    def close() -> None:
        nonlocal words, linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                for k in [k for k in state[2] if k in named]:
                    if stack[-1][0] in HEADINGS and slug(t) == named[k]:
                        void.add(k)
                    del named[k]
                out.append((t, max(words, 1), linked, state[0], state[1], items > 0, state[2]))
        text.clear()
        words = linked = 0

    def enter(tag: str, attrs: str) -> None:
        nonlocal state, items, quotes
        stack.append((tag, *state))
        main, hard, marks = state
        given = attributes(attrs) if attrs else {}
        own = tag in MAIN or given.get("role", "").strip().lower() == "main"
        if own and not main and not hard:
            mains.append(frozenset(marks))
        hard = hard or tag in AROUND and not (tag == "footer" and quotes) or tag == "header" and not main
        kind, heading = _mark(tag, given)
        if kind:
            kinds.append(kind)
            marks = (*marks, len(kinds) - 1)
            if heading:
                named[len(kinds) - 1] = heading
        items += tag == "li"
        quotes += tag == "blockquote"
        state = main or own, hard, marks

    def leave() -> str:
        nonlocal state, link, items, quotes
        tag, *rest = stack.pop()
        state = tuple(rest)
        items -= tag == "li"
        quotes -= tag == "blockquote"
        if len(stack) < link:
            link = -1
        return tag

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m["end"]), m["attrs"] or ""
        if tag in RAW:
            if not ends and not attrs.endswith("/"):
                stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            link = -1 if ends or "href" not in attrs.lower() else len(stack)
            continue
        if tag not in BLOCK:
            if not ends and tag not in VOID and attrs and not attrs.endswith("/") and (tag in AROUND or _mark(tag, attributes(attrs))[0]):
                close()
                enter(tag, attrs)
            elif ends and stack and stack[-1][0] == tag:
                close()
                leave()
            continue
        close()
        if tag in VOID:
            continue
        # A paragraph ends where the next block begins; so do list items, rows and cells at their like.
        if stack and (stack[-1][0] == "p" or tag == stack[-1][0] and tag in ("li", "tr", "td", "th", "dt", "dd")) and not (ends and tag == "p"):
            leave()
        if ends:
            if any(x[0] == tag for x in stack):
                while leave() != tag:
                    pass
        else:
            enter(tag, attrs)
    close()
    if mains:
        void |= frozenset.intersection(*mains)
    held = [hard or any(kinds[k] == FIRM and k not in void for k in marks) for *_, hard, _, marks in out]
    could = [not h for h in held]
    if any(c and b[3] for b, c in zip(out, could)):
        could = [c and b[3] for b, c in zip(out, could)]
    total, inside = 0, [0] * len(kinds)
    for (_, n, *_, marks), c in zip(out, could):
        total += n * c
        for k in marks:
            inside[k] += n * c
    void |= {k for k, kind in enumerate(kinds) if kind in WRAPS and inside[k] > WRAPS[kind] * total}
    return [(t, n, a, main, h or any(k not in void for k in marks), item) for (t, n, a, main, _, item, marks), h in zip(out, held)]


def main_text(page: str, tree=None) -> str:
    """The blocks that the tree takes, joined; a block's neighbours are the nearest ones that are around the article, or not, as it is.

    A page without article or main element none of whose blocks the tree takes is a short one: what isn't around, nor mostly links, is its text.
    """
    tree = default_tree() if tree is None else tree
    found = blocks(page)
    shape = [(n, min(1.0, a / n)) for _, n, a, *_ in found]
    before, after = [(0, 0.0)] * len(found), [(0, 0.0)] * len(found)
    last: dict[bool, int] = {}
    for i, (*_, around, _) in enumerate(found):
        if around in last:
            before[i] = shape[last[around]]
            after[last[around]] = shape[i]
        last[around] = i
    taken = [classify(tree, (*shape[i], *before[i], *after[i], *b[3:])) for i, b in enumerate(found)]
    if not any(taken) and not any(b[3] for b in found):
        taken = [not b[4] and shape[i][1] < 0.5 for i, b in enumerate(found)]
    return " ".join(b[0] for b, t in zip(found, taken) if t)


def _extract(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("__html")
        texts = [main_text(t.as_py() or "", tree) for t in batch.column(at)]
        rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != "__html"]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(n for _, n in rest), "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled=LABELLED) -> DataFrame:
    """One row for each page: id, url, text (its main text), n_chars (its code points).

    A page becomes flat text blocks; the tree, grown from the labelled table, judges each by its words and link density, those
    of the blocks before and after, and whether it stands in an article or main element or in something around it by its
    element or name: menus, headers and footers of the site, sidebars, notices, adverts, forms, reader comments. Scripts, styles, titles and comments of the markup are no text.
    In a block white space is one space; blocks are joined by one space. Null, empty or textless pages give the empty
    string. Rows don't meet: no exchange, any length, repeated rows stay, other columns aren't read.
    """
    table = np.array(labelled, float)
    tree = grow(table[:, :-1], table[:, -1])
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(partial(_extract, tree=tree), f"{schema}, text string, n_chars bigint")
