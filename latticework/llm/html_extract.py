"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements and runs of text. Every node has a hidden label, content or not. Node potentials
come from discrete features (tag, words of class / id / role, length, links, punctuation), parent-child potentials from
label transitions. Sum-product messages go up from the leaves and down from the root; a run of text belongs to the main
text if its content marginal is at least `CUT`.

Training: pages that mark their main text with one <article>, <main> or role="main" label their own nodes; everything
inside is content, but for nested menus, headers of the page, forms, adverts and comments. Each page counts twice, once with
those tags read as plain <div>, so that the model also learns from the other features. Counts are aggregated in Spark over
about `FIT_PAGES` labelled pages, chosen by hash (a documented bound); only the word lists of class, id and role have pseudo-counts of weight.

Text: character references decoded, white space inside a block made one space, blocks joined by an empty line.

Defined results: a null or empty page gives an empty text; text outside any element belongs to the root; without labelled pages only the word lists
speak, so that text without them is left out; pages of any length and depth are parsed whole, in time linear in their tags; an empty table gives no
rows; repeated rows and null ids give a row each; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

FIT_PAGES = 2_000
CUT = 0.5

# Kinds of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "math", "canvas", "object")
CLOSES = {  # an open element of the first kind ends when one of these begins
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
CLOSED_BY = {name: [own for own, names in CLOSES.items() if name in names] for names_ in CLOSES.values() for name in names_}
SCOPE = frozenset("ul ol dl table select nav div section article main aside body html form".split())
# Words in class, id or role that speak for or against main text.
AGAINST = frozenset(
    "ad ads adv advert advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar "
    "footer foot bottom copyright legal sidebar side aside rail widget related recommended trending popular notice notices alert cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login register form search share sharing social comment comments commentlist reply replies respond discussion disqus tags pagination pager meta byline".split()
)
FOR = frozenset("article content main post entry story body text maintext articlebody prose page-content".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}

#: Largest absolute log odds of a feature of each group: what one corpus has by chance must not rule.
MOST = {"kw": 8.0, "tag": 3.0, "run": 2.5, "links": 3.0, "stop": 1.5, "mark": 3.0}

#: Pseudo-counts of the two word lists (content, other): they stand for words of class, id and role that the fitting pages lack. Tags,
#: lengths, links and marks have none: what they say is learned.
PRIOR = {"kw:against": (0.05, 300), "kw:for": (200, 2)}

#: Kinds of nodes and pseudo-counts of their labels, by the parent's label: a run of text follows its element, a paragraph
#: its box, a box may differ, a marked element decides for itself.
LEAFY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead caption pre blockquote figure figcaption address summary".split())
AGAINST_TAGS = frozenset("nav aside footer header form button select fieldset dialog menu head".split())
KINDS = ("run", "leaf", "box", "marked", "against")
MOVES = {"run": ((20, 0.1), (0.1, 20)), "leaf": ((20, 0.5), (0.5, 20)), "box": ((20, 2), (2, 20)), "marked": ((5, 15), (1, 20)), "against": ((20, 0.02), (20, 0.2))}


class Page:
    """Nodes in page order: parent, features; for text runs, their text."""

    __slots__ = ("parent", "tag", "kw", "text", "links")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.kw: list[str] = [""]
        self.text: list[str | None] = [None]
        self.links: list[float] = [0.0]


def _keyword(attrs: str) -> str:
    if "=" not in attrs:
        return ""
    words = [w.lower() for m in ATTR.finditer(attrs) for w in WORDS.findall(m[1] or m[2] or m[3] or "")]
    if any(w in AGAINST for w in words):
        return "against"
    return "for" if any(w in FOR for w in words) else ""


def parse(source: str) -> Page:
    """The tree of a page; never fails on broken markup."""
    page, stack = Page(), [0]
    places: dict[str, list[int]] = {}  # places in the stack of each open tag, and of those that end a scope
    scopes: list[int] = []
    run: list[str] = []
    linked = in_link = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            own = page.tag[stack.pop()]
            places[own].pop()
            if own in SCOPE:
                scopes.pop()

    def flush() -> None:
        nonlocal linked
        if run:
            whole = "".join(run)
            text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if text:
                page.parent.append(stack[-1])
                page.tag.append("#text")
                page.kw.append("")
                page.text.append(text)
                page.links.append(linked / max(len(whole), 1))
            run.clear()
            linked = 0

    pos, n = 0, len(source)
    while pos < n:
        m = TAG.search(source, pos)
        chunk = source[pos : m.start()] if m else source[pos:]
        if chunk:
            run.append(chunk)
            if in_link:
                linked += len(chunk)
        if not m:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                run.append(" ")
            continue
        flush()
        in_link = 0
        tags = page.tag
        if closing:
            if places.get(name):
                cut(places[name][-1])
            continue
        if name in ENDS:
            if not m[0].endswith("/>"):
                end = ENDS[name].search(source, pos)
                pos = end.end() if end else n
            continue
        if tags[stack[-1]] == "p":
            cut(len(stack) - 1)
        nearest = max((places[x][-1] for x in CLOSED_BY.get(name, ()) if places.get(x)), default=0)
        if nearest and nearest >= (scopes[-1] if scopes else 0):
            cut(nearest)
        if name in VOID:
            continue
        page.parent.append(stack[-1])
        page.tag.append(name)
        page.kw.append(_keyword(m[3]))
        page.text.append(None)
        page.links.append(0.0)
        places.setdefault(name, []).append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append(len(page.tag) - 1)
    flush()
    # share of linked text in every element
    size, own = [len(t or "") for t in page.text], [x * len(t or "") for x, t in zip(page.links, page.text)]
    for k in range(len(size) - 1, 0, -1):
        size[page.parent[k]] += size[k]
        own[page.parent[k]] += own[k]
    page.links = [x / n if n else 0.0 for x, n in zip(own, size)]
    return page


def features(page: Page, k: int, plain: bool = False) -> list[str]:
    """Discrete features of a node. plain: the tags that mark main text count as <div>."""
    tag = page.tag[k]
    if tag == "#text":
        text, links = page.text[k], page.links[k]
        n = len(text)
        size = "s" if n < 25 else "m" if n < 80 else "l" if n < 250 else "x"
        return ["run:" + size, "links:" + ("none" if links == 0 else "some" if links < 0.5 else "most"), "stop:" + ("yes" if text[-1] in ".!?…:\"”" else "no"), "mark:" + ("yes" if "©" in text or "|" in text[:3] else "no")]
    kw = page.kw[k]
    if plain and tag in ("article", "main"):
        tag, kw = "div", ""
    if page.links[k] > 0.5:
        tag += "/links"
    return ["tag:" + tag, "kw:" + kw] if kw else ["tag:" + tag]


def kind_of(page: Page, k: int, plain: bool = False) -> int:
    tag, kw = page.tag[k], page.kw[k]
    if tag == "#text":
        return 0
    if kw == "against" or tag in AGAINST_TAGS:
        return 4
    if not plain and (kw == "for" or tag in ("article", "main")):
        return 3
    return 1 if tag in LEAFY else 2


def labels(page: Page) -> list[int] | None:
    """1 for content, by the page's own mark of its main text; None if it has none or several."""
    marks = [k for k, t in enumerate(page.tag) if t == "article"] or [k for k, t in enumerate(page.tag) if t == "main"]
    if len(marks) != 1:
        return None
    inside = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        out = page.tag[k] in ("nav", "aside", "footer", "form", "button") or page.kw[k] == "against"
        inside[k] = 0 if out else 1 if k == marks[0] else inside[page.parent[k]]
    return inside


def counts_of(page: Page) -> Counter:
    """Counts of (kind, value, label) from a labelled page; empty from others."""
    out: Counter = Counter()
    own = labels(page)
    if own:
        for k, y in enumerate(own):
            for plain in (False, True):
                for f in features(page, k, plain):
                    out["f", f, y] += 1
                if k:
                    out["t", f"{kind_of(page, k, plain)}{own[page.parent[k]]}", y] += 1
    return out


def _through(odds: float, t00: float, t01: float, t10: float, t11: float) -> float:
    """Log odds of one end of a link from those of the other: log of (t10 + t11 e**odds) / (t00 + t01 e**odds)."""
    if odds > 0:
        e = exp(-min(odds, 700.0))
        return log((t10 * e + t11) / (t00 * e + t01))
    e = exp(max(odds, -700.0))
    return log((t10 + t11 * e) / (t00 + t01 * e))


class Model:
    """Log potentials of features and of parent-child labels."""

    def __init__(self, rows: list[tuple[str, str, int, float]]):
        seen: dict[str, list[float]] = {f: [b, a] for f, (a, b) in PRIOR.items()}
        move = [[list(map(float, row)) for row in MOVES[kind]] for kind in KINDS]
        for kind, value, y, n in rows:
            if kind == "f":
                seen.setdefault(value, [0.5, 0.5])[y] += n
            else:
                move[int(value[0])][int(value[1])][y] += n
        groups: dict[str, list[float]] = {}
        for f, c in seen.items():
            own = groups.setdefault(f.split(":")[0], [0.0, 0.0])
            own[0] += c[0]
            own[1] += c[1]
        self.odds = {}
        for f, c in seen.items():
            own = groups[f.split(":")[0]]
            value = log((c[1] + 0.5) / (own[1] + 1)) - log((c[0] + 0.5) / (own[0] + 1))
            most = MOST[f.split(":")[0]]
            self.odds[f] = max(-most, min(most, value))
        self.move = [[x / sum(row) for row in own for x in row] for own in move]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node by sum-product messages, up and then down the tree."""
        n, parent, odds = len(page.tag), page.parent, self.odds
        moves = [self.move[kind_of(page, k)] for k in range(n)]
        # log odds throughout: messages add up, so neither the number of children nor their order matters
        up, sent, out = [0.0] * n, [0.0] * n, [0.0] * n
        for k in range(n):
            s = 0.0
            for f in features(page, k):
                s += odds.get(f, 0.0)
            up[k] = max(-30.0, min(30.0, s))
        for k in range(n - 1, 0, -1):
            t00, t01, t10, t11 = moves[k]
            sent[k] = _through(up[k], t00, t01, t10, t11)
            up[parent[k]] += sent[k]
        # what the rest of the tree says about the node; the root holds everything
        down = [0.0] * n
        down[0] = log(0.01)
        for k in range(n):
            if k:
                t00, t01, t10, t11 = moves[k]
                down[k] = _through(down[parent[k]] + up[parent[k]] - sent[k], t00, t10, t01, t11)
            both = down[k] + up[k]
            out[k] = 1 / (1 + exp(min(-both, 700.0)))
        return out

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        return "\n\n".join(t for t, p in zip(page.text, self.marginals(page)) if t is not None and p >= CUT)


def fit(pages: DataFrame, html_col: str = "html") -> Model:
    """Fit on pages that mark their main text; counting runs in Spark."""
    n = pages.count()
    share = min(1.0, FIT_PAGES / max(n, 1))
    chosen = pages.select(F.col(html_col).alias("html")).where(F.pmod(F.xxhash64("html", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in it:
            for source in b.column(0).to_pylist():
                if source:
                    total.update(counts_of(parse(source)))
        rows = [(*k, float(v)) for k, v in total.items()]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], ["kind", "value", "label", "n"])

    counts = chosen.mapInArrow(batches, "kind string, value string, label int, n double").groupBy("kind", "value", "label").agg(F.sum("n").alias("n"))
    return Model([(r.kind, r.value, r.label, r.n) for r in counts.collect()])


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_as: str = "text") -> DataFrame:
    """The input without its html, with the main text; text_as gets `_` added until it is free."""
    names = [c for c in pages.columns if c != html_col]
    text_as = free_name(names, text_as)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            texts = [m.extract(x) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], [*names, text_as])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names] + [f"`{text_as}` string"])
    return pages.select(*names, html_col).mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
