"""Main-text extraction with a tree-structured graphical model over the DOM.

A page is parsed into a tree of elements.  Each element has a hidden label:

    0 neutral    holds both content and page furniture (html, body, wrappers)
    1 content    part of the article
    2 furniture  menus, headers, footers, sidebars, notices, adverts, forms,
                 scripts, styles, reader comments

The joint probability is a product of node potentials (how well the element's
features fit a label) and parent-child potentials.  Sum-product messages go up
the tree once and down once; they give every element's exact marginal.  Text
belongs to the nearest block element and is kept where content is the likelier
label of that block.

Potentials are counts with additive smoothing over labelled pages
(``LABELLED``; ``train`` takes any other list).  A label is written on an
element as ``data-y`` and holds for its descendants until another one.

Defined results: null or empty html gives an empty text; text outside any
block belongs to its nearest ancestor; unclosed and stray tags follow the
usual HTML recovery (a block start closes an open ``p``).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_LABELS = 3
CONTENT = 1

# Fixed values of HTML: element kinds.
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
RAW = set("script style textarea title noscript template iframe svg".split())
BLOCK = set("""html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table
thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form
fieldset address details summary hr dialog menu script style title noscript template iframe svg
textarea select option button label""".split())
CLOSES_P = BLOCK - set("button label option select textarea script style title noscript template iframe svg".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}
TAG_GROUPS = {
    "script": "script style noscript template iframe svg title head meta link",
    "nav": "nav menu", "aside": "aside dialog", "header": "header", "footer": "footer address",
    "form": "form fieldset label button select option textarea input", "article": "article",
    "main": "main", "wrap": "div section html body #root", "para": "p blockquote pre",
    "head": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "figure": "figure figcaption details summary",
}
TAG_GROUP = {t: g for g, tags in TAG_GROUPS.items() for t in tags.split()}
#: groups that also share one pooled feature, so that rare ones learn from the others
POOLED = {"nav", "aside", "footer", "form", "script"}
#: words looked for in class, id and role
WORD_GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip",
    "side": "sidebar side widget related recommended recommend trending popular rail complementary more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adslot",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall signup dialog",
    "comment": "comment comments reply replies respond discussion disqus thread reader readers",
    "foot": "footer foot copyright legal credits contentinfo bottom",
    "top": "header masthead branding logo site",
    "form": "form search login input contact",
    "share": "share sharing social tags meta byline toc author",
    "body": "article content post entry story main body text prose articlebody",
}
WORD_GROUP = {w: g for g, words in WORD_GROUPS.items() for w in words.split()}

# a quote opens a quoted value only behind "="; elsewhere it is a character like any other
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|data-y|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


class Page:
    """Elements in page order: tag, parent, words of class/id/role, label;
    ``pieces`` are (element, text, elements so far) in page order."""

    def __init__(self):
        self.tag, self.parent, self.words, self.label = ["#root"], [-1], [()], [None]
        self.pieces: list[tuple[int, str, int]] = []

    def add(self, node: int, text: str) -> None:
        self.pieces.append((node, text, len(self.tag)))


def parse(source: str) -> Page:
    page = Page()
    stack = [0]
    at = 0
    size = len(source)
    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            page.add(stack[-1], source[at:])
            break
        if m.start() > at:
            page.add(stack[-1], source[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group(0).startswith("<![CDATA["):
                page.add(stack[-1], m.group(0)[9:-3])
            continue
        tag = m.group(2).lower()
        if m.group(1):
            _close(page, stack, tag)
            continue
        if tag == "br":
            page.add(stack[-1], " ")
            continue
        if tag in CLOSES_P:
            _close_open_p(page, stack)
        if tag in CLOSES_SAME:
            _close_same(page, stack, tag)
        attrs = m.group(3) or ""
        words, label = [], None
        if attrs:
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name == "data-y":
                    label = int(value) if value in ("0", "1", "2") else None
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    words.append("hidden")
                else:
                    words += WORDS.findall(value.lower())
        page.tag.append(tag)
        page.parent.append(stack[-1])
        page.words.append(tuple(words))
        page.label.append(label)
        node = len(page.tag) - 1
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if end is None and tag in ("title", "noscript", "template", "svg"):
                stack.append(node)
                continue
            page.add(node, source[at:end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    return page


def _close(page: Page, stack: list[int], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if page.tag[stack[k]] == tag:
            del stack[k:]
            return
        # an inline end tag does not reach out of its block; no end tag leaves a table cell's article
        if tag not in BLOCK and page.tag[stack[k]] in BLOCK:
            return


def _close_open_p(page: Page, stack: list[int]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        tag = page.tag[stack[k]]
        if tag == "p":
            del stack[k:]
            return
        if tag in BLOCK:
            return


def _close_same(page: Page, stack: list[int], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        here = page.tag[stack[k]]
        if here in CLOSES_SAME[tag]:
            del stack[k:]
            return
        if here in SCOPE[tag]:
            return


def features(page: Page) -> list[list[str]]:
    """Feature names of each element: tag group, word groups, and for elements
    with text its amount and the share of it inside links."""
    n = len(page.tag)
    chars, linked = [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[page.parent[i]]
    for node, text, _ in page.pieces:
        size = len(text.strip())
        chars[node] += size
        if in_link[node]:
            linked[node] += size
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        kind = TAG_GROUP.get(page.tag[i], "inline")
        f = ["tag=" + kind]
        groups = {WORD_GROUP[w] for w in page.words[i] if w in WORD_GROUP}
        if "hidden" in page.words[i]:
            groups.add("hidden")
        f += ["word=" + g for g in sorted(groups)]
        if groups - {"body"}:
            f.append("word=any furniture")
        if kind in POOLED:
            f.append("tag=any furniture")
        if chars[i]:
            f.append("links=" + ("none" if not linked[i] else "some" if linked[i] < 0.5 * chars[i] else "most"))
        else:
            f.append("links=empty")
        out.append(f)
    return out


class TreeModel:
    """Log potentials: ``node[label][feature]`` and ``edge[parent][child]``."""

    def __init__(self, node, other, edge, root):
        self.node, self.other, self.edge, self.root = node, other, edge, root

    def node_potentials(self, names: list[str]) -> tuple[float, ...]:
        out = [0.0] * N_LABELS
        for name in names:
            for y in range(N_LABELS):
                out[y] += self.node[y].get(name, self.other[y])
        top = max(out)
        return tuple(math.exp(x - top) for x in out)

    def marginals(self, page: Page) -> list[tuple[float, ...]]:
        """Sum-product: messages from the leaves to the root, then back."""
        n = len(page.tag)
        cache: dict[tuple[str, ...], tuple[float, ...]] = {}
        phi = []
        for f in features(page):
            key = tuple(f)
            if key not in cache:
                cache[key] = self.node_potentials(f)
            phi.append(cache[key])
        labels = range(N_LABELS)
        edge = self.edge
        up = [list(p) for p in phi]          # belief from below, normalised
        message = [None] * n                 # child to parent
        for i in range(n - 1, 0, -1):
            b = up[i]
            total = b[0] + b[1] + b[2]
            m = [sum(edge[y][z] * b[z] for z in labels) / total for y in labels]
            message[i] = m
            p = up[page.parent[i]]
            for y in labels:
                p[y] *= m[y]
            top = max(p)
            if top < 1e-100:
                for y in labels:
                    p[y] /= top
        out: list[tuple[float, ...]] = [()] * n
        down = [self.root] * n
        for i in range(n):
            if i:
                par, m = out[page.parent[i]], message[i]
                cavity = [par[y] / m[y] for y in labels]  # parent's belief without this child
                down[i] = [sum(cavity[y] * edge[y][z] for y in labels) for z in labels]
            b = [up[i][y] * down[i][y] for y in labels]
            total = b[0] + b[1] + b[2]
            out[i] = tuple(x / total for x in b)
        return out


def train(labelled_pages: list[str], smooth_node: float = 0.05, smooth_edge: float = 0.02) -> TreeModel:
    """Maximum likelihood with additive smoothing from pages with ``data-y``."""
    seen = [defaultdict(float) for _ in range(N_LABELS)]
    total = [0.0] * N_LABELS
    edge = [[smooth_edge] * N_LABELS for _ in range(N_LABELS)]
    names = set()
    for source in labelled_pages:
        page = parse(source)
        label = [0] * len(page.tag)
        for i, f in enumerate(features(page)):
            y = page.label[i]
            label[i] = y if y is not None else (label[page.parent[i]] if i else 0)
            total[label[i]] += 1
            for name in f:
                seen[label[i]][name] += 1
                names.add(name)
            if i:
                edge[label[page.parent[i]]][label[i]] += 1
    node = [{k: math.log((seen[y][k] + smooth_node) / (total[y] + 2 * smooth_node)) for k in names}
            for y in range(N_LABELS)]
    other = [math.log(smooth_node / (total[y] + 2 * smooth_node)) for y in range(N_LABELS)]
    edge = [[x / sum(row) for x in row] for row in edge]
    return TreeModel(node, other, edge, [0.9, 0.05, 0.05])


_P = "<p>Some words of the story, long enough to be read.</p>"
_MENU = "<ul><li><a href=x>Home</a></li><li><a href=x>News</a></li><li><a href=x>About us</a></li></ul>"
_HEAD = "<head data-y=2><meta charset=utf-8><title>t</title><style>p{}</style><script>f()</script><link rel=x></head>"
_STORY = f"<h1>Headline</h1>{_P}<p><b>Lead</b> text with <a href=x>one link</a> inside it.</p><h2>Part</h2>{_P}" \
         f"<ul><li>first point of the list</li><li>second point</li></ul><blockquote><p>quoted words</p></blockquote>{_P}"
#: Labelled pages, written for this module: usual layouts with every kind of furniture named above.
LABELLED = [
    f"<html data-y=0>{_HEAD}<body><nav data-y=2>{_MENU}</nav><div class=ad data-y=2>Buy this now.</div>"
    f"<article data-y=1>{_STORY}</article><footer data-y=2>&copy; site, all rights. <a href=x>Terms</a></footer></body></html>",
    f"<html data-y=0>{_HEAD}<body><header data-y=2><a href=x>Site</a><p>A site of news</p><nav>{_MENU}</nav></header>"
    f"<div class=cookie-notice data-y=2><p>We use cookies.</p><button>Accept</button></div><main><article data-y=1>{_STORY}"
    f"<div class='share social' data-y=2><a href=x>Share</a></div></article><section id=comments class=comments data-y=2>"
    f"<h3>Comments</h3><div class=comment><p>I do not agree with this text at all.</p></div><div class=comment><p>Nice.</p>"
    f"<form><label>Reply</label><textarea>x</textarea><button>Send</button></form></div></section></main>"
    f"<aside class=sidebar data-y=2><h3>Related</h3>{_MENU}<p>More of the same.</p></aside><footer data-y=2><p>Imprint</p></footer></body></html>",
    f"<html data-y=0>{_HEAD}<body><div id=header class=site-header data-y=2><div class=logo><a href=x>Logo</a></div>"
    f"<div class=menu>{_MENU}</div></div><div id=wrapper><div class='breadcrumbs' data-y=2><a href=x>Home</a> <a href=x>News</a></div>"
    f"<div class=post-content data-y=1>{_STORY}<div class=advertisement data-y=2><p>Sponsored words</p></div>{_P}"
    f"<table><tr><th>Year</th><td>Value</td></tr><tr><td>one</td><td>two</td></tr></table></div>"
    f"<div class=sidebar data-y=2><div class=widget><h4>Popular</h4>{_MENU}<p>Try our letter.</p></div></div></div>"
    f"<div class='newsletter signup' data-y=2><form><input><button>Subscribe</button></form></div><div id=footer data-y=2><p>Contact and legal</p></div></body></html>",
    f"<html data-y=0>{_HEAD}<body><header class=masthead data-y=2><h1>Daily</h1></header><div class=container><div class=row>"
    f"<section class=article-body data-y=1>{_STORY}<figure><figcaption>What it shows</figcaption></figure><pre>code words</pre></section>"
    f"<aside data-y=2><p>Advert text</p></aside></div></div><form class=search data-y=2><label>Find</label><input></form>"
    f"<div class=alert role=alert data-y=2><p>Notice: the site moves.</p></div><div class=reader-comments data-y=2><ul><li><p>First comment text.</p></li></ul></div>"
    f"<footer class=footer data-y=2>{_MENU}<p>Copyright</p></footer></body></html>",
    f"<html data-y=0>{_HEAD}<body><nav data-y=2>{_MENU}</nav><main data-y=1><header><h1>Title</h1></header><section>{_P}{_P}</section><section><h2>More</h2>{_P}</section>"
    f"<dl><dt>term</dt><dd>meaning</dd></dl></main><div class=related data-y=2><h3>Read next</h3>{_MENU}</div><div class=banner data-y=2><p>Promo</p></div>"
    f"<div id=consent class=modal data-y=2><p>Your privacy.</p></div><footer data-y=2><p>End</p></footer></body></html>",
    f"<html data-y=0>{_HEAD}<body><nav data-y=2>{_MENU}</nav><article data-y=1><h1>Title</h1>{_P}<script data-y=2>f()</script>"
    f"<form data-y=2><p>Vote</p><input><button>Send</button></form>{_P}<style data-y=2>p{{}}</style><div class=ad data-y=2>Ad words</div>{_P}"
    f"<div><p>Text in a wrapper</p></div><div class=note>A note of the author</div></article><footer data-y=2>End</footer></body></html>",
    f"<html data-y=0>{_HEAD}<body><article class=post data-y=1><p>Only one line.</p><script data-y=2>f()</script><noscript data-y=2>x</noscript>"
    f"<form data-y=2><label>Mail</label><input></form></article><article class=entry data-y=1><p>Short.</p><div class=promo data-y=2><a href=x>Buy</a></div></article></body></html>",
    f"<html data-y=0><body><h1 data-y=1>Bare page</h1><p data-y=1>text of it</p><p data-y=1>and more</p></body></html>",
    f"<html data-y=0><body><div><div><div data-y=1>{_P}{_P}</div></div></div></body></html>",
    f"<html data-y=0>{_HEAD}<body><article data-y=1><header><h1>Title</h1></header>{_P}{_P}<aside data-y=2><p>Box</p></aside><nav data-y=2>{_MENU}</nav>"
    f"<section class=comments data-y=2><article class=comment><p>reply words</p></article></section><footer data-y=2><p>Tags</p></footer></article></body></html>",
]


def block_texts(source: str | None, model: TreeModel) -> list[str]:
    """Texts of the content blocks in page order."""
    if not source:
        return []
    page = parse(source)
    marginal = model.marginals(page)
    block = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        block[i] = i if page.tag[i] in BLOCK else block[page.parent[i]]
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append(text)
        parts.clear()

    current, before = None, 0
    for node, text, count in page.pieces:
        b = block[node]
        if b != current or any(block[k] == k for k in range(before, count)):
            flush()
        current, before = b, count
        m = marginal[b]
        if m[CONTENT] >= max(m[0], m[2]):
            parts.append(text)
    flush()
    return out


def _run(model: TreeModel):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                        ("n_blocks", pa.int64())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                blocks = [block_texts(x, model) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(["\n".join(b) for b in blocks], pa.string()),
                     pa.array([len(b) for b in blocks], pa.int64())], schema=schema)

    return run


def extract_pages(pages: DataFrame, labelled_pages: list[str] = LABELLED) -> DataFrame:
    """page_id, url, text, n_blocks: the main text of every page."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string")).mapInArrow(
        _run(train(labelled_pages)), "page_id long, url string, text string, n_blocks long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
