"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Every node is content, a frame around
content, or something else; the model has a prior for the root, the probability of a node's state given its parent's, and
the probability of each observed trait (tag, hint words of class, id and role, length of
own text, share of links, sentence signs) given the state. Messages go up and then
down the tree (sum-product), which gives the exact marginal of every node; blocks of
nodes with a marginal of one half or more are the text.

All tables are counts over labelled pages: pages of the corpus that mark their text
with one ``article`` element (a bounded sample), and generated pages in usual layouts
without such a mark, whose labels are known.

Text in scripts, styles, forms, the head and embedded objects is never read. The head
ends at its first text or body element, any other of these at the end of its parent.
Defined cases: null and empty pages have the empty text; markup that breaks off ends
the page; unclosed and stray tags are tolerated; equal pages have equal texts.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from schemaloom.llm.arrow import add_columns, as_text

#: Expected number of corpus pages that the tables are counted on, and of generated ones.
SAMPLE_PAGES = 2_000
GENERATED_PAGES = 400
SMOOTHING = 0.5

#: Elements that start a block, by their role in HTML.
BLOCKS = frozenset("""html body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
    table thead tbody tfoot tr td th caption pre blockquote figure figcaption address details summary center hr fieldset""".split())
#: Elements whose text is no running text.
SKIPPED = frozenset("script style noscript template head svg math iframe object form textarea select button canvas audio video title".split())
#: Elements that are raw text up to their end tag, and those that a head may hold.
RAW = frozenset("script style textarea title noscript iframe template".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta title script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements beyond which an implied end does not reach.
SCOPES = frozenset("html body div article section main aside nav header footer ul ol dl table td th blockquote details figure".split())

#: Words in class, id and role that hint at what a block is.
AWAY = frozenset("""nav navbar navigation menu menubar header masthead banner footer foot sidebar side aside rail comment comments reply replies
    disqus ad ads adv advert advertisement sponsor sponsored promo promotion cookie cookies consent notice alert popup modal overlay
    newsletter subscribe signup login search searchform form share sharing social related recommended more widget breadcrumb breadcrumbs
    pager pagination tags toolbar legal copyright contentinfo complementary dialog gdpr outbrain taboola""".split())
HERE = frozenset("article content main post entry story body text articlebody maincontent page prose blog".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_TAIL = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HINT = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Block elements in page order."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hint: list[str] = field(default_factory=list)
    #: Known state (generated pages): 0, 1 or None where the parent's holds.
    mark: list[int | None] = field(default_factory=list)
    #: (node, text, characters inside links) in page order.
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _hint(attributes: str) -> tuple[str, int | None]:
    words, mark = set(), None
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "data-y":
            mark = int(value) if value in ("0", "1") else None
        else:
            words.update(_HINT.findall(value))
    return ("away" if words & AWAY else "here" if words & HERE else "other" if words else "none"), mark


def parse(source: str | None, marked: bool = True) -> Page:
    """Tolerant reading of block structure and text; of marks only where ``marked`` (generated pages)."""
    page = Page()
    stack: list[int] = []
    pieces: list[str] = []
    linked, in_link = 0, False

    def open_node(tag: str, attributes: str) -> None:
        hint, mark = _hint(attributes) if attributes else ("none", None)
        if tag in ("nav", "aside", "footer"):
            hint = "away"
        elif tag in ("main", "article") and hint != "away":
            hint = "here"
        page.parent.append(stack[-1] if stack else -1)
        page.tag.append(tag)
        page.hint.append(hint)
        page.mark.append(mark if marked else None)
        stack.append(len(page.tag) - 1)

    def close_run() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.runs.append((stack[-1], text, linked))
            pieces.clear()
        linked, in_link = 0, False

    def end(tags: set[str]) -> None:
        """Close the nearest open element of the kinds, if it is in scope."""
        for k in range(len(stack) - 1, 0, -1):
            name = page.tag[stack[k]]
            if name in tags:
                del stack[k:]
                return
            if name in SCOPES:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def raw_end(name: str, at: int) -> int:
        stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
        return stop.end() if stop else len(source)

    open_node("html", "")
    source = _TAIL.sub("", source or "")
    at, skip = 0, ""
    inside: list[str] = []  # open elements in the skipped one
    while m := _TAG.search(source, at):
        name = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if skip == "head" and (source[at:m.start()].strip() or (name and name not in IN_HEAD and (not closing or name == "body"))):
            skip = ""
        if not skip:
            add(source[at:m.start()])
        at = m.end()
        if not name:
            continue
        if skip and closing:
            if name in inside:
                while inside.pop() != name:
                    pass
                continue
            if name == skip:
                skip = ""
                continue
            # a form ends an open paragraph, so that it is no parent
            if name not in BLOCKS or (name == "p" and skip == "form") or all(page.tag[k] != name for k in stack[1:]):
                continue
            skip = ""
        elif skip:
            if name in RAW and not (attributes.endswith("/") and (skip in ("svg", "math") or {"svg", "math"} & set(inside))):
                at = raw_end(name, at)
            elif name == skip and name in ("button", "select"):  # ends the open one
                inside.clear()
                skip = name if name == "button" else ""
            elif (name in BLOCKS and name != "hr") or (name in SKIPPED and name not in RAW and name not in ("form", "head") and not attributes.endswith("/")):
                inside.append(name)
            continue
        if name in SKIPPED and not closing:
            if name == "form" or name in BLOCKS:
                close_run()
            if attributes.endswith("/") and name == "svg":
                continue
            if name in RAW:
                at = raw_end(name, at)
            else:
                skip = name
                inside.clear()
        elif name in BLOCKS:
            close_run()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] == name:
                        del stack[k:]
                        break
            elif name != "html":
                if name in ENDS:
                    end(ENDS[name])
                else:
                    end({"p"})
                if name != "hr":
                    open_node(name, attributes)
        elif name == "a":
            in_link = not closing
        elif name == "br":
            pieces.append(" ")
    if not skip or (skip == "head" and source[at:].strip()):
        add(source[at:])
    close_run()
    return page


#: States of a node.
OTHER, CONTENT, FRAME = 0, 1, 2
STATES = 3


# --- traits and labels ------------------------------------------------------------
TRAITS = ("tag", "hint", "size", "links", "signs")


def traits(page: Page) -> list[tuple[str, str, str, str, str]]:
    """Observed traits of every node; those of text are of the node's own runs."""
    sizes, links, signs = [0] * len(page.tag), [0] * len(page.tag), [0] * len(page.tag)
    for node, text, linked in page.runs:
        sizes[node] += len(text)
        links[node] += linked
        signs[node] += sum(map(text.count, ".,;:!?"))
    out = []
    for tag, hint, n, k, s in zip(page.tag, page.hint, sizes, links, signs):
        size = "0" if n == 0 else "20" if n <= 20 else "80" if n <= 80 else "250" if n <= 250 else "more"
        share = "none" if n == 0 else "0" if k == 0 else "some" if 2 * k < n else "most"
        out.append((tag, hint, size, share, "none" if n == 0 else "0" if s == 0 else "1" if s == 1 else "more"))
    return out


def states(page: Page, content: list[bool]) -> list[int]:
    """States of the nodes: content, above content, or neither."""
    out = [CONTENT if c else OTHER for c in content]
    for node in range(len(out) - 1, 0, -1):
        above = page.parent[node]
        if out[node] != OTHER and out[above] == OTHER:
            out[above] = FRAME
    return out


def labels_by_mark(page: Page) -> list[int]:
    content: list[bool] = []
    for parent, mark in zip(page.parent, page.mark):
        content.append(bool(mark) if mark is not None else parent >= 0 and content[parent])
    return states(page, content)


def labels_by_article(page: Page) -> list[int] | None:
    """Content is what lies in the only article, but not in elements of other use inside; None without one article."""
    if page.tag.count("article") != 1:
        return None
    content: list[bool] = []
    for parent, tag, hint in zip(page.parent, page.tag, page.hint):
        inside = tag == "article" or (parent >= 0 and content[parent])
        content.append(inside and tag not in ("nav", "aside", "footer") and hint != "away")
    return states(page, content)


def generated_page(rng: random.Random) -> str:
    """A page in one of the usual layouts; ``data-y`` marks where content begins (1) and ends (0)."""
    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(2, 9))) for _ in range(n))

    def sentences(n):
        return " ".join(f"{words(rng.randint(3, 14)).capitalize()}{rng.choice([', ' + words(4), ''])}." for _ in range(n))

    def paragraphs(n, low=1, high=6):
        return "".join(f"<p>{sentences(rng.randint(low, high))}</p>" for _ in range(n))

    def links(n):
        return "<ul>" + "".join(f'<li><a href="#">{words(rng.randint(1, 4))}</a></li>' for _ in range(n)) + "</ul>"

    head = f"<h1>{words(6).capitalize()}</h1>"
    inner = rng.choice([head, f"<header>{head}<p>{words(4)}</p></header>", ""]) + paragraphs(rng.randint(2, 8))
    if rng.random() < 0.6:
        inner += f"<h2>{words(3)}</h2>" + paragraphs(2) + rng.choice(["", f"<ul><li>{sentences(1)}</li><li>{words(5)}</li></ul>", f"<ol><li>{words(6)}</li><li>{words(3)}</li><li>{words(9)}</li></ol>", f"<blockquote>{sentences(2)}</blockquote>", f"<table><tr><td>{words(2)}</td><td>{words(3)}</td></tr></table>"])
    if rng.random() < 0.3:
        inner += f'<div class="{rng.choice(["ad", "promo", "share", "related", "newsletter"])}" data-y="0">{sentences(1)}{rng.choice(["", links(3)])}</div>'
    inner += paragraphs(rng.randint(0, 3))
    opening, closing = rng.choice([
        ('<div class="content" data-y="1">', "</div>"), ('<div id="main-content" data-y="1">', "</div>"), ('<div class="post-body entry" data-y="1">', "</div>"),
        ('<main data-y="1">', "</main>"), ('<article data-y="1">', "</article>"), ('<main><article data-y="1">', "</article></main>"),
        ('<section class="story" data-y="1">', "</section>"), ('<div class="x7" data-y="1">', "</div>"), ('<div data-y="1">', "</div>"),
        ('<table><tr><td data-y="1">', "</td></tr></table>"),
    ])
    before = [
        f"<nav>{links(rng.randint(3, 8))}</nav>", f'<header class="site-header"><p>{words(3)}</p>{links(4)}</header>', f'<div class="menu">{links(6)}</div>',
        f'<div class="cookie-notice">{sentences(rng.randint(1, 3))}</div>', f'<div class="ad">{sentences(1)}</div>', f'<div id="banner"><p>{sentences(1)}</p></div>',
        f'<p class="breadcrumb"><a href="#">{words(1)}</a> <a href="#">{words(2)}</a></p>', f'<div class="alert notice"><p>{sentences(2)}</p></div>',
    ]
    after = [
        f"<footer>&copy; {words(5)}. {sentences(rng.randint(0, 2))}</footer>", f'<div class="footer"><p>{sentences(1)}</p>{links(4)}</div>',
        f'<aside><h3>{words(2)}</h3>{paragraphs(rng.randint(1, 2), 1, 2)}{links(4)}</aside>', f'<div class="sidebar"><h3>{words(2)}</h3><p>{sentences(2)}</p>{links(5)}</div>',
        f'<section id="comments"><h2>{words(2)}</h2>' + "".join(f'<div class="comment"><p>{sentences(rng.randint(1, 4))}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>",
        f'<ol class="commentlist">' + "".join(f"<li><p>{words(1)}</p><p>{sentences(rng.randint(1, 3))}</p></li>" for _ in range(rng.randint(1, 4))) + "</ol>",
        f'<div class="related">{links(5)}</div>', f'<div class="ads"><p>{sentences(1)}</p></div>', f'<div class="newsletter"><p>{sentences(1)}</p></div>',
    ]
    rng.shuffle(before), rng.shuffle(after)
    return "<html><body>" + "".join(before[:rng.randint(0, 4)]) + opening + inner + closing + "".join(after[:rng.randint(0, 4)]) + "</body></html>"


# --- model ------------------------------------------------------------------------
@dataclass
class Model:
    root: np.ndarray
    #: Log probability of a child's state given its parent's: [parent, child].
    step: np.ndarray
    #: Log probabilities of trait values: {(trait, value): [state]}; unseen values say nothing.
    seen: dict[tuple[str, str], np.ndarray]


def count_page(page: Page, labels: list[int], into: dict[tuple[str, str, int], float]) -> None:
    def add(*key):
        into[key] = into.get(key, 0) + 1

    for node, (parent, values) in enumerate(zip(page.parent, traits(page))):
        add("root", "", labels[node]) if parent < 0 else add("step", str(labels[parent]), labels[node])
        for trait, value in zip(TRAITS, values):
            add(trait, value, labels[node])


def model_of(counts: dict[tuple[str, str, int], float]) -> Model:
    table: dict[str, dict[str, np.ndarray]] = {}
    for (kind, value, state), n in counts.items():
        table.setdefault(kind, {}).setdefault(value, np.zeros(STATES))[state] += n

    def log_share(rows: np.ndarray, axis: int) -> np.ndarray:
        rows = rows + SMOOTHING
        return np.log(rows / rows.sum(axis=axis, keepdims=True))

    step = np.stack([table.get("step", {}).get(str(s), np.zeros(STATES)) for s in range(STATES)])
    seen = {}
    for trait in TRAITS:
        values = table.get(trait, {})
        if values:
            for value, row in zip(values, log_share(np.stack(list(values.values())), 0)):
                seen[trait, value] = row
    return Model(log_share(table.get("root", {}).get("", np.zeros(STATES)), 0), log_share(step, 1), seen)


def fit(pages: DataFrame, source: str = "html", sample_pages: int = SAMPLE_PAGES, generated: int = GENERATED_PAGES, seed: int = 7) -> Model:
    """Tables from generated pages and from about ``sample_pages`` corpus pages with one article."""
    rows = as_text(pages.select(F.col(source).alias("html")), "html").where("html is not null")
    total = rows.count()
    share = min(1.0, sample_pages / total) if total else 0.0
    sample = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(frames):
        counts: dict[tuple[str, str, int], float] = {}
        for frame in frames:
            for source in frame["html"]:
                page = parse(source, False)
                if labels := labels_by_article(page):
                    count_page(page, labels, counts)
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "value", "state", "n"]).astype({"state": "int64", "n": "float64"})

    found = sample.mapInPandas(count, "kind string, value string, state long, n double").groupBy("kind", "value", "state").agg(F.sum("n").alias("n"))
    counts = {(r["kind"], r["value"], r["state"]): r["n"] for r in found.collect()}  # one row per trait value
    rng = random.Random(seed)
    own: dict[tuple[str, str, int], float] = {}
    for _ in range(generated):
        page = parse(generated_page(rng))
        count_page(page, labels_by_mark(page), own)
    # both kinds of pages weigh the same, whatever their number
    scale = max(1.0, sum(own.values())) / max(1.0, sum(counts.values()))
    for key, n in counts.items():
        own[key] = own.get(key, 0) + n * scale
    return model_of(own)


def marginals(pages: list[Page], model: Model) -> list[np.ndarray]:
    """Probability of content of every node of every page."""
    if not pages:
        return []
    sizes = [len(p.tag) for p in pages]
    shift = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.array(p.parent) + s * (np.array(p.parent) >= 0) for p, s in zip(pages, shift)])
    depth = np.zeros(len(parent), np.int64)
    for i, q in enumerate(parent.tolist()):
        if q >= 0:
            depth[i] = depth[q] + 1
    nothing = np.zeros(STATES)
    own = np.array([sum((model.seen.get((t, v), nothing) for t, v in zip(TRAITS, values)), nothing) for p in pages for values in traits(p)])
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    up, message = own.copy(), np.zeros_like(own)
    for nodes in levels[:0:-1]:  # what each node tells its parent about the parent's state
        message[nodes] = np.logaddexp.reduce(model.step[None] + up[nodes, None, :], axis=2)
        np.add.at(up, parent[nodes], message[nodes])
    belief = up.copy()
    belief[levels[0]] += model.root
    for nodes in levels[1:]:  # the parent's belief without this child's message, through the step
        rest = belief[parent[nodes]] - message[nodes]
        belief[nodes] = up[nodes] + np.logaddexp.reduce(rest[:, :, None] + model.step[None], axis=1)
        belief[nodes] -= belief[nodes].max(axis=1, keepdims=True)
    shares = np.exp(belief - belief.max(axis=1, keepdims=True))
    return np.split(shares[:, CONTENT] / shares.sum(axis=1), shift[1:-1])


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    pages = [parse(s, False) for s in sources]
    return ["\n".join(text for node, text, _ in p.runs if m[node] >= 0.5) for p, m in zip(pages, marginals(pages, model))]


def extract(pages: DataFrame, model: Model, source: str = "html", text: str = "text") -> DataFrame:
    """Append the main text of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    return add_columns(pages, source, [(text, StringType())], lambda: lambda sources: [main_texts(sources, held.value)])
