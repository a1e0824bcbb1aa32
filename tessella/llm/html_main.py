"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements with runs of inline text. Each block
has features of its subtree (text and link density), its attribute words, its
depth and its siblings; gradient-boosted trees give the log odds that it
belongs to the article. A node can be kept only under kept ancestors, and the
labelling with the greatest total log odds under that rule is found bottom-up.
The trees are trained, once a process, on pages that a generator writes with
known main text.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tessella.llm.common import map_rows, revived

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>""", re.S)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a browser skips to the closing tag, or to the end of the page. The others of RAW end with what holds them.
ENDLESS = frozenset("script style textarea title noscript iframe xmp noframes".split())
FOREIGN = ("svg", "math")
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table body html div section article main aside nav form".split())
DROPPED = frozenset("head script style noscript template svg iframe select button textarea option datalist canvas object math".split())
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "body", "figure", "dialog")
# Words of class, id and role, in groups that mean the same.
WORDS = {
    "content": "article content entry main post story text body prose copy",
    "menu": "nav navbar menu breadcrumb breadcrumbs navigation toc pagination pager tabs links skip",
    "head": "header masthead topbar banner brand logo hero site",
    "foot": "footer bottom copyright legal colophon credits foot",
    "side": "sidebar aside side rail widget related recommended more teaser promo popular trending complementary",
    "notice": "cookie consent notice alert gdpr modal popup overlay privacy warning dialog toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promoted banner-ad adsense dfp outbrain taboola",
    "comment": "comment comments reply replies respond disqus discussion thread reviews feedback",
    "form": "form search login signup subscribe newsletter register input contact",
    "share": "share social sharing follow meta byline author tags tag date",
}
GROUP = {w: i for i, ws in enumerate(WORDS.values()) for w in ws.split()}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
ADVERT = 1 << GROUP["advert"]
LISTS = ("ul", "ol", "dl", "table", "select")
MARK = "data-main"  # on the blocks of generated pages that belong to the article
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "depth", "groups", "hidden", "items", "size", "links", "nodes", "inside", "blocks", "words", "stops", "index", "rank", "marked")

    def __init__(self, tag: str, parent: Node | None, groups: int = 0, hidden: bool = False):
        self.tag, self.parent, self.groups, self.hidden = tag, parent, groups, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.items: list = []  # child nodes and lists of text pieces in page order
        self.inside = (parent.inside | parent.groups) if parent else 0
        self.rank = 0
        self.marked = False
        if parent:
            parent.items.append(self)


def attributes(raw: str) -> tuple[int, bool]:
    groups, hidden = 0, False
    for m in ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            for w in SPLIT.split(value if value.islower() else re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()):
                if w in GROUP:
                    groups |= 1 << GROUP[w]
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden" or value.lower() == "true":
            hidden = True
    return groups, hidden


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order; the first is the root. Malformed mark-up is repaired as browsers mostly do.

    Inline elements are no nodes; one that is hidden or named as an advert is
    left out up to its end, or to that of the block around it.
    """
    root = Node("html", None)
    nodes, path, at, link = [root], [root], 0, 0
    opened: dict[str, list[int]] = {}  # where in the path each tag is open
    unclosed: set[str] = set()
    muted: list = []  # an inline element that is left out, and how often its tag is open

    def text(piece: str) -> None:
        if piece and not muted:
            items = path[-1].items
            if not items or isinstance(items[-1], Node):
                items.append([])
            items[-1].append((piece, link > 0))

    def cut(depth: int) -> None:
        """Closes the path from this depth on."""
        while len(path) > depth:
            opened[path.pop().tag].pop()

    def deepest(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if tag in RAW and not closing and not raw.endswith("/") and tag not in unclosed:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end or tag in ENDLESS:
                at = end.end() if end else len(page)
                continue
            unclosed.add(tag)
        if tag in INLINE:
            if muted and tag == muted[0]:
                muted[1] += -1 if closing else 1
                if not muted[1]:
                    muted = []
            elif not muted and not closing and raw and tag not in VOID and not raw.endswith("/"):
                groups, hidden = attributes(raw)
                if hidden or groups & ADVERT:
                    muted = [tag, 1]
                    continue
            if tag == "a":
                link = max(0, link + (-1 if closing else 1)) if closing else 1
            elif tag == "br":
                text(" ")
            continue
        muted = []
        if closing:
            if opened.get(tag):
                cut(opened[tag][-1])
                link = 0
            continue
        link = 0
        if tag == "html":
            continue
        if tag in CLOSES_P and (near := deepest(("p", *FOREIGN))) > deepest(SCOPE):
            cut(near)
        if tag in SAME:
            low = deepest(LISTS)
            if ends := [places[i] for t in SAME[tag] if (places := opened.get(t)) and (i := bisect_right(places, low)) < len(places)]:
                cut(min(ends))
        if tag in VOID:
            if tag == "hr":
                path[-1].items.append([])  # a new block begins
            continue
        groups, hidden = attributes(raw)
        node = Node(tag, path[-1], groups, hidden)
        node.marked = MARK in (m[3] or "")
        nodes.append(node)
        if not raw.endswith("/") or tag not in ("div", "p", "section"):
            opened.setdefault(tag, []).append(len(path))
            path.append(node)
    if at < len(page):
        text(page[at:])
    return nodes


def measure(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    for i, n in enumerate(nodes):
        n.index, n.size, n.links, n.nodes, n.blocks, n.words, n.stops = i, 0, 0, 1, [], 0, 0
        for k, item in enumerate(n.items):
            if not isinstance(item, Node):
                block = SPACES.sub(" ", entities.unescape("".join(p for p, _ in item))).strip()
                n.items[k] = block
                if block:
                    n.size += len(block)
                    n.links += min(len(block), sum(len(p.strip()) for p, a in item if a))
                    n.words += block.count(" ") + 1
                    n.stops += block.count(".") + block.count(",")
    own = [n.size for n in nodes]
    for n in reversed(nodes):
        if p := n.parent:
            p.size += n.size
            p.links += n.links
            p.nodes += n.nodes
            p.words += n.words
            p.stops += n.stops
    whole = max(1, nodes[0].size)
    rows = np.zeros((len(nodes), 20 + len(TAGS) + 2 * len(WORDS)), np.float32)
    tags: dict[int, Counter] = {}  # of the children, by their parent
    under = [0] * len(nodes)  # bits of the kinds of ancestors
    kinds = {"nav": 1, "header": 2, "footer": 4, "aside": 8, "form": 16, "article": 32, "main": 64, "li": 128}
    for i, n in enumerate(nodes):
        p = n.parent
        if p and p.index not in tags:
            kin = [x for x in p.items if isinstance(x, Node)]
            for r, x in enumerate(kin):
                x.rank = r + 1
            p.rank = p.rank or 1
            tags[p.index] = Counter(x.tag for x in kin)
        same = tags[p.index] if p else Counter([n.tag])
        siblings = same.total()
        under[i] = (under[p.index] | kinds.get(p.tag, 0)) if p else 0
        alike = same[n.tag]
        others = p.size - n.size if p else 0
        u = under[i]
        row = [n.size, own[i], n.links / max(1, n.size), n.size / n.nodes, n.words, n.stops / max(1, n.words), n.depth, siblings, alike, (n.rank or 1) / siblings, others / max(1, siblings - 1), p.links / max(1, p.size) if p else 0, n.size / whole, n.nodes, *(float(bool(u & b)) for b in (1, 2, 4, 8, 16, 32 | 64))]
        rows[i, :20] = row
        if n.tag in TAGS:
            rows[i, 20 + TAGS.index(n.tag)] = 1
        for g in range(len(WORDS)):
            rows[i, 20 + len(TAGS) + g] = n.groups >> g & 1
            rows[i, 20 + len(TAGS) + len(WORDS) + g] = n.inside >> g & 1
    return rows


class Trees:
    """Boosted trees of a fixed depth for a 0/1 target under logistic loss, over features cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25):
        self.depth = depth
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24), method="lower")) for j in range(x.shape[1])]
        bins = self._bins(x)
        n, f, b = len(x), x.shape[1], 26
        self.start = float(np.log((y * weight).sum() / ((1 - y) * weight).sum()))
        score, self.trees = np.full(n, self.start), []
        offset = np.arange(f) * b
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-4) * weight
            leaf, feature, cut = np.zeros(n, np.int64), np.zeros(2**depth, np.int64), np.full(2**depth, b)
            for d in range(depth):
                m = 2**d
                at = (leaf[:, None] * (f * b) + offset + bins).ravel()
                sg = np.bincount(at, np.repeat(g, f), m * f * b).reshape(m, f, b).cumsum(2)
                sh = np.bincount(at, np.repeat(h, f), m * f * b).reshape(m, f, b).cumsum(2)
                tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sh < 2) | (th - sh < 2)] = 0
                best = gain.reshape(m, -1).argmax(1)
                feature[m - 1 : 2 * m - 1] = best // b
                cut[m - 1 : 2 * m - 1] = np.where(gain.reshape(m, -1).max(1) > 1e-6, best % b, b)
                node = leaf + m - 1
                leaf = 2 * leaf + (bins[np.arange(n), feature[node]] > cut[node])
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins, at, score = self._bins(x), np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                node = leaf + 2**d - 1
                leaf = 2 * leaf + (bins[at, feature[node]] > cut[node])
            score += value[leaf]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Keeps the nodes of greatest total log odds such that every kept node's ancestors are kept."""
    gain = [0.0] * len(nodes)
    for n in reversed(nodes):
        mine = -1e9 if n.tag in DROPPED or n.hidden else float(odds[n.index])
        gain[n.index] += mine  # the children have added theirs
        if n.parent and gain[n.index] > 0:
            gain[n.parent.index] += gain[n.index]
    keep = [False] * len(nodes)
    for n in nodes:
        keep[n.index] = gain[n.index] > 0 and (n.parent is None or keep[n.parent.index])
    return keep


def blocks(nodes: list[Node], keep: list[bool]) -> str:
    """Text of the kept nodes in page order, a line for each block."""
    out: list[str] = []
    stack = [iter(nodes[0].items)] if keep[0] else []
    while stack:
        for item in stack[-1]:
            if isinstance(item, Node):
                if keep[item.index]:
                    stack.append(iter(item.items))
                    break
            elif item:
                out.append(item)
        else:
            stack.pop()
    return "\n".join(out)


def sample_page(rng: random.Random) -> str:
    """A page of invented words; the blocks of the article carry the mark data-main."""
    syllables = "ka lo mi ren tus vor ande pli que shi ber gon ath ure ost ine eda".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose(a: int, b: int) -> str:
        return " ".join(words(3, 14).capitalize() + rng.choice([".", ".", ",", "."]) for _ in range(rng.randint(a, b)))

    def named(tag: str, group: str, inner: str, bare: float = 0.2) -> str:
        c = "" if rng.random() < bare else f' {rng.choice(["class", "id", "class"])}="{rng.choice(["", word() + "-", "site-"])}{rng.choice(WORDS[group].split())}{rng.choice(["", " " + word(), "-" + word()])}"'
        return f"<{tag}{c}>{inner}</{tag}>"

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"

    def p(text: str, mark: str = "") -> str:
        return f"<p{mark}>{text}" + rng.choice(["</p>", "</p>", "</p>", ""])

    main = f" {MARK}=1"
    box = lambda t, g, x: named(rng.choice([t, "div", t]), g, x, 0.0 if t == "div" else 0.3)
    nav = lambda: box("nav", "menu", links(3, 12))
    ad = lambda: named(rng.choice(["div", "aside", "section"]), "advert", rng.choice([words(2, 8), p(prose(1, 2)), f'<a href="#">{words(2, 7)}</a>']), 0)
    side = lambda: box("aside", "side", f"<h3>{words(1, 3)}</h3>" + rng.choice([links(2, 8), p(prose(1, 3)), p(words(3, 9)) + links(2, 4)]))
    notice = lambda: named(rng.choice(["div", "section", "dialog"]), "notice", rng.choice([p(prose(1, 2)), prose(1, 2) + f"<button>{word()}</button>"]), 0)
    form = lambda: named("form", "form", f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>" + rng.choice(["", p(prose(1, 1)), f"<select><option>{word()}<option>{word()}</select>"]), 0.4)
    share = lambda: named("div", "share", rng.choice([links(2, 5), words(2, 5)]), 0)

    def comments() -> str:
        each = "".join(rng.choice([named("div", "comment", p(prose(1, 4)), 0), named("li", "comment", p(words(1, 2)) + p(prose(1, 4)), 0.3), p(prose(1, 4))]) for _ in range(rng.randint(1, 7)))
        return named(rng.choice(["section", "div", "ol"]), "comment", rng.choice(["", f"<h2>{words(1, 2)}</h2>"]) + each + rng.choice(["", form()]), 0)

    head = box("header", "head", rng.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(1, 5)}</p>", f'<a href="/">{word()}</a>', ""]) + rng.choice([nav(), form(), ""]))
    body = [f"<h1{main}>{words(3, 12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 14)):
        r = rng.random()
        if r < 0.72:
            body.append(p(rng.choice([prose(1, 9), prose(1, 9), words(1, 4), f"<b>{prose(1, 2)}<br>", prose(1, 3) + f' <a href="#">{words(1, 3)}</a> ' + prose(1, 2)]), main))
        elif r < 0.8:
            body.append(f"<h2{main}>{words(1, 6)}</h2>")
        elif r < 0.85:
            body.append(f"<ul{main}>" + "".join(f"<li{main}>{words(3, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif r < 0.88:
            body.append(f"<blockquote{main}><p{main}>{prose(1, 3)}</p></blockquote>")
        elif r < 0.91:
            body.append(f"<table{main}>" + "".join(f"<tr{main}><td{main}>{words(1, 3)}</td><td{main}>{words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>")
        elif r < 0.93:
            body.append(f"<pre{main}>{words(3, 20)}</pre>")
        else:
            body.append(rng.choice([ad, side, share, form, notice])())
    wrap = rng.choice(["article", "main", "div", "section", "article"])
    c = "" if wrap in ("article", "main") and rng.random() < 0.6 else f' class="{rng.choice(["", word() + "-"])}{rng.choice(WORDS["content"].split())}"'
    inner = "".join(body) + (share() if rng.random() < 0.2 else "") + (comments() if rng.random() < 0.15 else "")
    article = f"<{wrap}{c}{main}>{inner}</{wrap}>"
    if rng.random() < 0.3:
        article = f'<div class="{rng.choice(["container", "wrapper", "content", "page"])}"{main}>{article}{side() if rng.random() < 0.4 else ""}</div>'
    top = [x() for x in (lambda: head, nav, ad, notice, form) if rng.random() < 0.5]
    rng.shuffle(top)
    low = [x() for x in (comments, side, ad, nav, notice, form) if rng.random() < 0.35]
    rng.shuffle(low)
    foot = box("footer", "foot", rng.choice([p(prose(1, 2)), links(2, 6), "&copy; " + words(2, 5) + " &middot; " + prose(1, 2)])) if rng.random() < 0.85 else ""
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var a='<p>';</script></head><body>{''.join(top)}{article}{''.join(low)}{foot}</body></html>"


@lru_cache(maxsize=4)
def trained(pages: int = 700, seed: int = 11) -> Trees:
    """Trees fitted to the nodes of generated pages."""
    rng, xs, ys, ws = random.Random(seed), [], [], []
    for _ in range(pages):
        nodes = parse(sample_page(rng))
        xs.append(measure(nodes))
        ys.append(np.array([n.marked or n.parent is None or n.tag == "body" for n in nodes], float))
        ws.append(np.array([1 + np.log1p(n.size) / 4 for n in nodes]))
    return Trees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def main_text(page: str | None, trees: Trees) -> str:
    return main_texts([page], trees)[0]


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; a null or blank page has none."""
    parsed = [parse(p or "") for p in pages]
    rows = [measure(nodes) for nodes in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for nodes in parsed:
        out.append(blocks(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of page_id, url, html.

    Null and empty pages give an empty text. Repeated rows each have their
    result; an empty table gives no rows; further columns are not read.
    """
    model = df.sparkSession.sparkContext.broadcast(vars(trained()))  # fifty small trees

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        trees = revived(Trees, model.value)
        for b in batches:
            for k in range(0, len(b["page_id"]), 256):
                texts = main_texts(b["html"][k : k + 256], trees)
                yield {"page_id": b["page_id"][k : k + 256], "url": b["url"][k : k + 256], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(df.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
