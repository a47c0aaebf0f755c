"""HTML main-text extraction by a tree-structured graphical model.

A page is parsed to a tree of block elements whose leaves are text segments (text between block boundaries, inline
markup taken out, white space turned into single spaces, references decoded). Every node is a binary variable, content
or not, with a unary potential from its features (tag, words in class, id and role, depth, length, punctuation and
link share of segments) and a pairwise potential with its parent (own tables for element-element and
element-segment edges). Sum-product messages upward and then downward give each node's exact content marginal;
the text is the segments with a marginal of one half and more, in page order.

Potentials are trained by gradient ascent on the exact likelihood of labelled pages: observed less expected counts, the
latter from the same message passing. The given tables hold no page labels, so training pages are made here by
make_page(): varied layouts of known parts, each labelled content or not as it is written. Training takes PAGES such
pages on the driver and doesn't depend on the input.

Defined cases: null or empty html has empty text; scripts, styles, comments, <noscript>, head, templates and other raw or hidden
elements yield no segments; unclosed and stray tags are repaired by the stack; <br> is white space; equal rows are
rows of their own; an empty table gives no rows; long pages are processed whole, in batches of BATCH_NODES nodes, and parsed in
time in proportion to their length. Markup is read by the HTML standard's states: quotes count only where a value begins (a
quoted value may hold >; one that is never closed ends at the next >), a comment without an end and raw text without an end
tag go on to the end of the page, as does a tag without >; an embedded element (EMBEDDED) without an end tag is
just left out; elements over MAX_DEPTH deep become siblings there. Columns of any name are kept, but for text."""

from __future__ import annotations

import html as entities
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

PAGES, STEPS, RATE, DECAY, SEED, BATCH_NODES, MAX_DEPTH = 700, 150, 0.08, 1e-4, 11, 20000, 512

#: HTML elements by kind (fixed values).
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title iframe noembed noframes xmp noscript".split())
EMBEDDED = set("template svg math object canvas audio video button datalist".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the given one ends if they are innermost (fixed values).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead"}}
#: Features of tags and of words in class, id and role (fixed values).
TAGS = "article main section div p h1 h2 h3 ul ol li blockquote pre table td figure figcaption nav header footer aside form body html dl address".split()
HINTS = {
    "ad": "ad ads adv advert advertisement banner sponsor sponsored promo promotion commercial".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs skip topbar toolbar".split(),
    "head": "header masthead logo site-title branding".split(),
    "foot": "footer foot copyright legal colophon credits".split(),
    "side": "sidebar side aside widget related recommended trending popular more".split(),
    "reader": "comment comments reply replies discussion disqus respond feedback reviews".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall".split(),
    "form": "form search login register contact".split(),
    "share": "share sharing social follow tags tag meta byline".split(),
    "body": "article content main post entry story text body page-content maincontent".split(),
}
WORD_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words}
#: Tags that tell what is in them; pages without any, and without hints, have features of their own, from UNMARKED on.
TELLING_TAGS = set("article main section nav header footer aside form".split())
UNMARKED, N_FEATURES = len(TAGS) + len(HINTS), len(TAGS) + len(HINTS) + 9 + 14

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|)|["'])*+)>""")
#: For what follows a tag whose values' quotes swallow every > up to the end of the page.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
SPLIT = re.compile(r"[^a-z]+")


class Markup:
    """The tags of a page from left to right, each part of it looked at a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.tag, self.absent = source, TAG, set()
        self.last = source.rfind(">")

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Where markup begins and ends, from at on, and the tag if it is one; text may go on over what isn't."""
        source, n = self.source, len(self.source)
        while (at := source.find("<", at)) >= 0:
            c = source[at + 1 : at + 2]
            if c in ("!", "?") or c == "/" and not source[at + 2 : at + 3].isalpha():
                if source.startswith("<!--", at):
                    end = at + 4 if source.startswith(("<!-->", "<!--->"), at) else self._find("-->", at + 4) + 2
                    return at, self._find(">", end) + 1, None
                return at, self._find(">", at) + 1, None
            if c.isascii() and c.isalpha() or c == "/":
                m = self.tag.match(source, at) if at < self.last else None
                if not m and at < self.last:
                    self.tag = LOOSE
                    m = LOOSE.match(source, at)
                return (at, m.end(), m) if m else (at, n, None)
            at += 1
        return n, n, None

    def _find(self, what: str, at: int) -> int:
        """Where what is, else the end of the page; what was not found once isn't looked for again."""
        found = -1 if what in self.absent else self.source.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found if found >= 0 else len(self.source)

    def closed(self, tag: str, at: int) -> int:
        """Behind the next end tag of this name, or -1."""
        if tag not in self.absent:
            if m := re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*+>", re.I).search(self.source, at):
                return m.end()
            self.absent.add(tag)
        return -1


@dataclass
class Page:
    """parent: of each node, before it in order; text: of each segment by node. feats: rows of N_FEATURES."""

    parent: list[int]
    depth: list[int]
    feats: list[np.ndarray]
    text: dict[int, str]
    marks: list[str]


def _hints(attrs: str) -> tuple[list[int], bool, str]:
    found, hidden, mark, seen = [], False, "", set()
    for name, value in ATTR.findall(attrs):
        name = name.lower()
        if name in seen:  # the first one counts
            continue
        seen.add(name)
        value = (value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name in ("class", "id", "role"):
            mark += " " + value
            found += [WORD_HINT[w] for w in {*SPLIT.split(value), *value.split()} if w in WORD_HINT]
    return found, hidden, mark


def _element(tag: str, attrs: str, depth: int) -> tuple[np.ndarray, bool, str]:
    v = np.zeros(N_FEATURES, np.float32)
    if tag in TAGS:
        v[TAGS.index(tag)] = 1
    found, hidden, mark = _hints(attrs)
    v[[len(TAGS) + k for k in found]] = 1
    v[UNMARKED + 8] = not found and tag in ("div", "section", "td")
    v[-1], v[-2] = 1, min(depth, 10) / 10
    return v, hidden, mark


def _segment(text: str, link: int, tag: str) -> np.ndarray:
    v = np.zeros(N_FEATURES, np.float32)
    n, at = len(text), N_FEATURES - 14
    words = text.count(" ") + 1
    v[at], v[at + 1], v[at + 2], v[at + 3] = n < 25, 25 <= n < 80, 80 <= n < 200, n >= 200
    v[at + 4], v[at + 5] = link / max(1, n), link >= 0.8 * n
    v[at + 6], v[at + 7] = text[-1] in ".!?…:;\"”»)", "·" in text or "©" in text
    v[at + 8], v[at + 9] = sum(text.count(c) for c in ",.;") / words, min(words, 60) / 60
    v[at + 10], v[at + 11] = tag in ("p", "h1", "h2", "h3", "blockquote", "pre"), 1
    return v


def parse(source: str, known: dict | None = None) -> Page:
    """known: features of elements seen before, shared by the pages of a batch."""
    known = {} if known is None else known
    page = Page([-1], [0], [_element("html", "", 0)[0]], {}, [""])
    stack, held, at, link, in_link, skip = [("html", 0)], [], 0, 0, 0, 0
    opened, markup, n, telling = Counter(), Markup(source), len(source), False

    def flush() -> None:
        nonlocal held, link
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text and not skip:
            tag, up = stack[-1]
            page.text[len(page.parent)] = text
            page.feats.append(_segment(text, link, tag))
            page.parent.append(up)
            page.depth.append(page.depth[up] + 1)
            page.marks.append("")
        held, link = [], 0

    def pop() -> None:
        nonlocal skip
        opened[stack.pop()[0]] -= 1
        if skip and len(stack) < skip:
            skip = 0

    while at < n:
        begin, end, m = markup.next(at)
        piece = source[at:begin]
        if piece:
            held.append(piece)
            link += len(piece) if in_link else 0
        at = end
        tag = m[2].lower() if m else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                flush()
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                in_link = 0
            elif tag == "head" and skip and opened["head"]:
                flush()
                while stack[-1][0] != "head":
                    pop()
                pop()
            continue
        if tag in RAW or tag in EMBEDDED:
            if not m[3].rstrip().endswith("/"):
                end = markup.closed(tag, at)
                at = end if end >= 0 else n if tag in RAW else at
            held.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag == "br" or tag in ("img", "input", "wbr"):
            held.append(" " if tag != "wbr" else "")
        elif tag in ("html", "body") and len(stack) > 1 and tag == stack[-1][0] or tag == "html":
            continue
        elif tag in BLOCKS or tag == "head":
            flush()
            in_link = 0
            if skip and stack[-1][0] == "head" and tag != "head":  # a head that isn't closed ends at the body
                pop()
            if stack[-1][0] == "p":
                pop()
            while len(stack) > 1 and stack[-1][0] in ENDS.get(tag, ()):
                pop()
            if tag == "hr":
                continue
            up = stack[-1][1]
            up = up if page.depth[up] < MAX_DEPTH else page.parent[up]
            what = tag, m[3], min(page.depth[up] + 1, 10)
            if what not in known:
                known[what] = _element(*what)
            v, hidden, mark = known[what]
            telling = telling or tag in TELLING_TAGS or bool(v[len(TAGS) : UNMARKED].any())
            page.parent.append(up)
            page.depth.append(page.depth[up] + 1)
            page.feats.append(v)
            page.marks.append(mark)
            stack.append((tag, len(page.parent) - 1))
            opened[tag] += 1
            if (hidden or tag == "head") and not skip:
                skip = len(stack)
    flush()
    if not telling:
        page.feats = [_unmarked(v, page.text.get(i), i) for i, v in enumerate(page.feats)]
    return page


def _unmarked(v: np.ndarray, text: str | None, i: int) -> np.ndarray:
    """A node's features on a page that marks nothing: what a segment's text says counts for more there."""
    v, tail = v.copy(), N_FEATURES - 14
    if text is None:
        v[UNMARKED] = 1
        v[UNMARKED + 1] = i == 0
    else:
        v[UNMARKED + 2] = 1
        v[UNMARKED + 3] = v[tail + 2] or v[tail + 3]
        v[UNMARKED + 4] = v[tail + 1]
        v[UNMARKED + 5] = v[tail + 4]
        v[UNMARKED + 6] = v[tail + 6]
        v[UNMARKED + 7] = v[tail + 7]
    return v


@dataclass
class Forest:
    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]


def forest(pages: list[Page]) -> Forest:
    shift, parent, depth, kind = 0, [], [], []
    for p in pages:
        parent += [q + shift if q >= 0 else -1 for q in p.parent]
        depth += p.depth
        kind += [int(i in p.text) for i in range(len(p.parent))]
        shift += len(p.parent)
    depth = np.array(depth)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    return Forest(np.stack([v for p in pages for v in p.feats]), np.array(parent), np.array(kind), levels)


def marginals(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content marginals, and for each node the joint table with its parent (nodes x parent x own), by sum-product in
    logs: messages rise level by level, then fall. unary: features x 2 kinds; pair: kind x parent x own."""
    up = np.zeros((len(f.parent), 2))
    score = np.einsum("nf,nf->n", f.x, unary.T[f.kind])
    up[:, 1] = score
    message = np.zeros_like(up)
    table = pair[f.kind]
    for level in f.levels[:0:-1]:
        message[level] = np.logaddexp.reduce(table[level] + up[level][:, None, :], axis=2)
        np.add.at(up, f.parent[level], message[level])
    full = up.copy()
    joint = np.zeros((len(f.parent), 2, 2))
    for level in f.levels[1:]:
        outside = full[f.parent[level]] - message[level]
        both = table[level] + up[level][:, None, :] + outside[:, :, None]
        full[level] = np.logaddexp.reduce(both, axis=1)
        both -= both.max((1, 2), keepdims=True)
        e = np.exp(both)
        joint[level] = e / e.sum((1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -50, 50))), joint, full


def fit(pages: list[Page], labels: list[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    f, y = forest(pages), np.concatenate(labels).astype(int)
    unary, pair = np.zeros((N_FEATURES, 2)), np.zeros((2, 2, 2))
    inner = np.concatenate(f.levels[1:])
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    state = [np.zeros_like(unary), np.zeros_like(pair)]
    for _ in range(steps):
        p, joint, _ = marginals(f, unary, pair)
        g_unary = np.stack([(f.x * ((y - p) * (f.kind == k))[:, None]).sum(0) for k in (0, 1)], 1) / len(pages) - DECAY * unary
        want = np.zeros((2, 2, 2))
        np.add.at(want, f.kind[inner], joint[inner])
        g_pair = (seen - want) / len(pages) - DECAY * pair
        for w, g, s in ((unary, g_unary, state[0]), (pair, g_pair, state[1])):
            s += g * g
            w += RATE * 5 * g / (np.sqrt(s) + 1e-8)
    return unary, pair


MARK = "data-y"


#: Attributes and tags that tell what an element is for (pages of the plain style lack them).
TELLING = re.compile(r' (?:class|id|role)="[^"]*"'), re.compile(r"(</?)(?:article|main|section|nav|header|footer|aside|form)(?=[ >])")


def make_page(rng: random.Random) -> str:
    """A page whose block elements carry the label of the text in them as data-y. Most mark their parts by tags or classes. Plain
    ones have div for these, so that only text, links and places tell; bare ones are text in the body, or text alone."""
    style = rng.choices(["marked", "plain", "bare"], [60, 22, 18])[0]
    letters = "etaoinshrdlucmfwypvbgk" + rng.choice(["", "éèçàù", "äöüß", "ñóíá"])
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(60)]

    def text(low: int, high: int) -> str:
        words, out = [rng.choice(vocab) for _ in range(rng.randint(low, high))], ""
        for i, w in enumerate(words):
            end = i == len(words) - 1
            mark = rng.choice([".", ".", ".", "!", "?"]) if end or rng.random() < 0.08 else "," if rng.random() < 0.06 else ""
            out += (w.capitalize() if i == 0 or out.endswith((". ", "! ", "? ")) else w) + mark + ("" if end else " ")
            if rng.random() < 0.02:
                out += rng.choice(["&amp; ", "<b>", "<i>x</i> ", "<br>", "&nbsp;"])
        if noise == "marks":
            out = "".join(c + (rng.choice(marks) + " " if c == " " and rng.random() < rate else "") for c in out)
        elif noise == "upper":
            out = out.upper()
        elif noise == "few words":
            out = " ".join(rng.choice(vocab[:4]) for _ in out.split(" "))
        return out

    # Some pages are of odd text throughout: any punctuation between words, capitals, few words.
    noise, rate = rng.choice([None] * 12 + ["marks", "marks", "upper", "few words"]), rng.uniform(0.1, 1)
    marks = ["".join(rng.choices(string.punctuation.replace("<", "").replace("&", ""), k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))]
    title = lambda: text(2, 10).rstrip(".!?")
    el = lambda tag, y, body, mark="": f'<{tag}{f" {mark}" if mark else ""} {MARK}="{y}">{body}' + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")
    cls = lambda *names: f'{rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
    links = lambda n, y=0: el("ul", y, "".join(el("li", y, f'<a href="/x">{title() if rng.random() < .3 else rng.choice(vocab)}</a>') for _ in range(n)))
    junk = {
        "nav": lambda: el(*rng.choice([("nav", 0, links(rng.randint(3, 9))), ("div", 0, links(rng.randint(3, 9)), cls(*HINTS["menu"]))])),
        "header": lambda: el("header", 0, el("div", 0, title(), cls(*HINTS["head"])) + (links(4) if rng.random() < 0.5 else "") + (el("h1", 0, title()) if rng.random() < 0.3 else "")),
        "ad": lambda: el(rng.choice(["div", "aside", "section"]), 0, rng.choice([text(3, 25), el("p", 0, text(3, 25)), text(2, 8) + "\n" + title()]), cls(*HINTS["ad"])),
        "aside": lambda: el(*rng.choice([("aside", 0), ("div", 0)]), el("h3", 0, title()) + rng.choice([links(5), el("p", 0, text(5, 30))]), cls(*HINTS["side"])),
        "notice": lambda: el(rng.choice(["div", "section"]), 0, rng.choice([text(5, 25), el("p", 0, text(5, 25))]), cls(*HINTS["notice"])),
        "form": lambda: el("form", 0, rng.choice([text(1, 6), el("p", 0, text(2, 12))]) + "<input name=q><button>Go</button>", cls(*HINTS["form"]) if rng.random() < 0.5 else ""),
        "share": lambda: el("div", 0, rng.choice([text(1, 4), links(3)]), cls(*HINTS["share"])),
    }
    footer = lambda: el("footer", 0, rng.choice(["&copy; ", ""]) + "www." + rng.choice(vocab) + ".example &middot; " + text(2, 14)) if rng.random() < 0.8 else el("div", 0, text(4, 20), cls(*HINTS["foot"]))
    comments = lambda: el("section" if rng.random() < 0.5 else "div", 0, el("h3", 0, title()) + "".join(el("div", 0, el("p", 0, text(4, 40)), cls("comment", "reply") if rng.random() < 0.5 else "") for _ in range(rng.randint(1, 4))), cls(*HINTS["reader"]))

    def body_part() -> str:
        r = rng.random()
        if r < 0.74:
            return el("p", 1, text(1, 8) if rng.random() < 0.3 else text(10, 120))
        if r < 0.80:
            return el(rng.choice(["h2", "h3"]), 1, title())
        if r < 0.86:
            return el(rng.choice(["ul", "ol"]), 1, "".join(el("li", 1, text(2, 20)) for _ in range(rng.randint(1, 5))))
        if r < 0.90:
            return el("blockquote", 1, rng.choice([text(4, 40), el("p", 1, text(4, 40))]))
        if r < 0.92:
            return el("table", 1, el("tr", 1, "".join(el("td", 1, text(1, 4)) for _ in range(3))))
        if r < 0.94:
            return el("pre", 1, text(4, 30))
        return junk[rng.choice(["ad", "share", "aside", "notice", "form"] if style == "marked" else ["share"])]()

    if style == "bare":
        lines = [text(8, 120) for _ in range(rng.choice([1, 1, 2, 3, 4, 6]))]
        inner = rng.choice(["<br><br>", "\n\n", " ", "<br>"]).join(lines)
        return inner if rng.random() < 0.4 else f'<html><head><title>{title()}</title></head><body {MARK}="1">{inner}</body></html>'
    parts = [body_part() for _ in range(rng.randint(1, 9))]
    if rng.random() < 0.9:
        parts.insert(0, el("h1", 1, title()))
    # An article's own header and footer aren't of its text.
    if style == "marked" and rng.random() < 0.35:
        parts.append(el("footer", 0, rng.choice([lambda: "tags: " + ", ".join(rng.choices(vocab, k=rng.randint(1, 5))), lambda: el("p", 0, text(2, 14)), lambda: text(2, 20), lambda: links(3)])()))
    if style == "marked" and rng.random() < 0.3:
        parts.insert(0, el("header", 0, rng.choice([text(2, 8), el("p", 0, text(2, 12)), el("p", 0, title()), el("div", 0, title(), cls(*HINTS["share"]))])))
    if rng.random() < 0.3:
        parts = [el("div", 1, "".join(parts), cls("content", "text", "entry", "body") if rng.random() < 0.5 else "")]
    article = el(*rng.choice([("article", 1), ("article", 1), ("main", 1), ("div", 1), ("section", 1)]), "".join(parts), "")
    if article.startswith(("<div", "<section")) and rng.random() < 0.6:
        article = article.replace(f' {MARK}="1"', f' {cls(*HINTS["body"])} {MARK}="1"', 1)
    if style == "plain":  # only such junk as its text gives away
        before = [junk[k]() for k in rng.sample(["nav", "header"], rng.randint(0, 2))]
        after = [junk[k]() for k in rng.sample(["nav", "share"], rng.randint(0, 2))] + ([el("footer", 0, "&copy; " + text(2, 8))] if rng.random() < 0.6 else [])
        if rng.random() < 0.5:  # paragraphs, too
            article = re.sub(r"(</?)p(?=[ >])", r"\1div", re.sub(rf'<p {MARK}="(.)">([^<]*)(?=<(?:p|div|h[123]|ul|ol|blockquote|table|pre|section|aside|footer|form)\b|$)', rf'<p {MARK}="\1">\2</p>', article))
    else:
        before = [junk[k]() for k in rng.sample(["nav", "header", "ad", "notice", "aside", "form"], rng.randint(1, 4))]
        after = [junk[k]() for k in rng.sample(["nav", "ad", "aside", "notice", "share", "form"], rng.randint(0, 3))] + ([comments()] if rng.random() < 0.4 else []) + [footer()]
    inner = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        inner = el("div", 0, inner, cls("wrapper", "page", "container"))
    if style == "plain":
        inner = TELLING[1].sub(r"\1div", TELLING[0].sub("", inner))
    return f'<!DOCTYPE html><html><head><title>{title()}</title><style>p{{}}</style></head><body {MARK}="0">{inner}</body></html>'


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """The parsed page, the labels taken off; a segment's label is its element's."""
    marked: list[int] = []
    stripped = re.sub(rf' ?{MARK}="([01])"', lambda m: (marked.append(int(m[1])), "")[1], source)
    page, y, tags, has_head = parse(stripped), [], iter(marked), "<head>" in source
    for i, p in enumerate(page.parent):
        # The root (content if the page is text alone) and the head come first and carry no label.
        y.append(y[p] if i in page.text else int(not marked) if i == 0 else 0 if i == 1 and has_head else next(tags))
    return page, np.array(y)


@lru_cache(1)
def model(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    made = [labelled(make_page(rng)) for _ in range(pages)]
    return fit([p for p, _ in made], [y for _, y in made])


def extract(sources: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[str]:
    out: list[str] = []
    held: list[Page] = []
    size, known = 0, {}

    def done() -> None:
        nonlocal held, size
        if held:
            p, at = marginals(forest(held), *weights)[0], 0
            for page in held:
                out.append("\n".join(t for i, t in page.text.items() if p[at + i] >= 0.5))
                at += len(page.parent)
        held, size = [], 0

    for s in sources:
        held.append(parse(s, known))
        size += len(held[-1].parent)
        if size >= BATCH_NODES:
            done()
    done()
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text; a column of that name is replaced."""
    weights = model()
    cols = [c for c in pages.columns if c != "text"]
    at = cols.index("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract([x or "" for x in b.column(at).to_pylist()], weights)
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], [*cols, "text"])

    slim = pages.select(*cols)
    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes)
    return common.in_arrow(slim, work, f"{kinds}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
