"""HTML as flat node arrays in document order, and the features of its nodes.

A page is read once, tag by tag, with the end tags that HTML lets authors leave out. Nodes are the block
elements and, below them, the runs of inline content between their boundaries; each knows its parent
and where its subtree ends, so every sum over a subtree is a difference of running sums.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

# Element names of the HTML standard by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Never text of a page, whatever stands in them.
SILENT = frozenset("head script style textarea title iframe noembed noframes xmp template noscript object svg canvas audio video select datalist button".split())
#: Elements that an open one of the second kind ends, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
TAGS = "run nav header footer aside article main form section div p h1 h2 h3 ul ol li table td blockquote pre figure body".split()

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]+|=)*)>?", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Nodes in document order: parent and end of the subtree, kind, attribute tokens; of runs also text and characters in links."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def attribute_tokens(text: str) -> tuple[str, ...]:
    """Words of class, id, role and label in lower case, split at marks and capitals; `hidden` for what is not shown."""
    found: list[str] = []
    for name, *values in ATTRIBUTE.findall(text):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "style":
            found += ["hidden"] if HIDING.search(value) else []
        elif name == "hidden":
            found.append("hidden")
        else:
            found += [p.lower() for p in PART.findall(html.unescape(value)) if len(p) > 1]
    return tuple(dict.fromkeys(found))


def parse(source: str) -> Page:
    """The nodes of a page of any shape: wrong nesting, missing ends and stray marks are taken as browsers roughly do."""
    page = Page()
    names: list[str] = []  # open elements
    places: list[int] = []  # their nodes; -1 for inline ones
    blocks: list[int] = []  # open block nodes
    silent = 0  # open elements that are never text
    links = 0
    buffer: list[str] = []
    in_link = 0

    def add(tag: str, tokens: tuple[str, ...]) -> int:
        page.parent.append(blocks[-1] if blocks else -1)
        page.end.append(0)
        page.tag.append(tag)
        page.tokens.append(tokens)
        page.text.append("")
        page.linked.append(0)
        return len(page.tag) - 1

    def flush() -> None:
        nonlocal in_link
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                at = add("run", ())
                page.text[at], page.linked[at], page.end[at] = text, min(in_link, len(text)), at + 1
            in_link = 0

    def pop() -> None:
        nonlocal silent, links
        name, place = names.pop(), places.pop()
        if place >= 0:
            flush()
            blocks.pop()
            page.end[place] = len(page.tag)
        silent -= name in SILENT
        links -= name == "a"

    def close(wanted, limits) -> None:
        """Ends the innermost open element of those wanted, and all within it, unless a limit stands before."""
        for i in range(len(names) - 1, -1, -1):
            if names[i] in wanted:
                while len(names) > i:
                    pop()
                return
            if names[i] in limits:
                return

    def words(a: int, b: int) -> None:
        nonlocal in_link
        if b > a and not silent:
            text = html.unescape(source[a:b]) if "&" in source[a:b] else source[a:b]
            buffer.append(text)
            if links:
                in_link += len(text.strip())

    root = add("body", ())
    blocks.append(root)
    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            words(at, len(source))
            break
        words(at, m.start())
        at = m.end()
        ended, name = m[1], m[2]
        if ended:
            ended = ended.lower()
            if ended == "br":
                buffer.append(" ")
            elif ended in INLINE:
                for i in range(len(names) - 1, -1, -1):  # an inline end tag ends nothing beyond its block
                    if names[i] == ended:
                        while len(names) > i:
                            pop()
                        break
                    if places[i] >= 0:
                        break
            elif ended in names:
                close({ended}, () if ended in ("table", "body", "html") else {"table"} if ended not in ("tr", "td", "th", "tbody", "thead", "tfoot") else {"table"} - {ended})
        elif name:
            name = name.lower()
            if name in ("html", "body"):
                if name == "body":
                    close({"head"}, ())
                    page.tokens[root] = attribute_tokens(m[3]) or page.tokens[root]
                continue
            if name == "br" or name == "wbr":
                buffer.append(" " if name == "br" else "")
                continue
            if name in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object", "caption"})
            if name in ENDS:
                close(*ENDS[name])
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            inline = name in INLINE or silent or name in SILENT and name not in ("head", "form")
            if inline:
                places.append(-1)
            else:
                flush()
                places.append(add(name, attribute_tokens(m[3]) if m[3] else ()))
                blocks.append(places[-1])
            names.append(name)
            silent += name in SILENT
            links += name == "a"
            if m[0].endswith("/>") and name in ("svg", "iframe", "script"):
                pop()
            elif name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = stop.start() if stop else len(source)
    while names:
        pop()
    flush()
    page.end[root] = len(page.tag)
    return page


COLUMNS = [
    "depth", "place", "siblings", "children", "nodes", "chars", "share", "before", "links", "density", "run_mean", "marks", "sentences", "digits", "copyright", "own_low", "own_high", "over_low", "over_high", "over_near",
    "previous_chars", "next_chars", "previous_links", "next_links", "parent_chars", "parent_links", "parent_mean", "of_parent", "runs", "paragraphs", "inner_low", "inner_high", "longest",
    *(f"is_{t}" for t in TAGS), *(f"in_{t}" for t in ("nav", "header", "footer", "aside", "article", "main", "form", "li", "td", "p")),
]
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
BIT = {c[3:]: 1 << i for i, c in enumerate(c for c in COLUMNS if c.startswith("in_"))}
MARKS, STOPS = re.compile(r"[,;:.!?]"), re.compile(r"[.!?]")


def features(pages: list[Page], token_scores: dict[str, float]) -> np.ndarray:
    """A row of COLUMNS for each node of some pages: tag, depth and place among siblings, tokens' scores (own, of ancestors, inside), and what the subtree holds."""
    sizes = [len(p.tag) for p in pages]
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    tags, texts, parents, n = [t for p in pages for t in p.tag], [t for p in pages for t in p.text], [q + s if q >= 0 else -1 for p, s in zip(pages, starts.tolist()) for q in p.parent], sum(sizes)
    if not n:
        return np.zeros((0, len(COLUMNS)), np.float32)
    root = np.repeat(starts, sizes)
    end = np.array([e for p in pages for e in p.end]) + root
    index, parent = np.arange(n), np.array(parents)
    parent = np.where(parent < 0, index, parent)
    chars = np.array([len(t) for t in texts], float)
    marks, stops, digits, rights = (np.array(x, float) for x in zip(*((len(MARKS.findall(t)), len(STOPS.findall(t)), sum(map(t.count, "0123456789")), "\u00a9" in t) if t else (0, 0, 0, False) for t in texts)))
    own = [[token_scores.get(k, 0.0) for k in t] if t else () for p in pages for t in p.tokens]
    low, high = [min(0.0, *x) if x else 0.0 for x in own], [max(0.0, *x) if x else 0.0 for x in own]
    over_low, over_high, over_near, depth, within = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    place, kids, latest, previous, following = [0] * n, [0] * n, [-1] * n, [-1] * n, [-1] * n
    inner_low, inner_high, longest = [0.0] * n, [0.0] * n, [len(t) for t in texts]
    for i, p in enumerate(parents):
        if p < 0:
            continue
        over_low[i], over_high[i], depth[i] = min(over_low[p], low[p]), max(over_high[p], high[p]), depth[p] + 1
        over_near[i] = low[p] + high[p] or over_near[p]
        within[i] = within[p] | BIT.get(tags[p], 0)
        place[i] = kids[p]
        kids[p] += 1
        if (b := latest[p]) >= 0:
            previous[i], following[b] = b, i
        latest[p] = i
    for i in range(n - 1, -1, -1):
        if (p := parents[i]) >= 0:
            inner_low[p], inner_high[p], longest[p] = min(inner_low[p], inner_low[i], low[i]), max(inner_high[p], inner_high[i], high[i]), max(longest[p], longest[i])
    total = lambda x: (c := np.concatenate(([0.0], np.cumsum(x))))[end] - c[index]
    held, linked, runs, held_marks = total(chars), total(np.array([x for p in pages for x in p.linked], float)), total([t == "run" for t in tags]), total(marks)
    passed = np.concatenate(([0.0], np.cumsum(chars)))
    previous, following, kids = np.array(previous), np.array(following), np.array(kids, float)
    whole, links, mean, nodes = np.maximum(held[root], 1.0), linked / np.maximum(held, 1), held / np.maximum(runs, 1), (end - index).astype(float)
    at = lambda x, which: np.where(which >= 0, x[which], -1.0)
    numbers = [
        depth, np.array(place) / np.maximum(kids[parent], 1), kids[parent], kids, nodes, np.log1p(held), held / whole, (passed[index] - passed[root]) / whole, links, held / nodes, np.log1p(mean),
        held_marks / np.maximum(held, 1), total(stops), total(digits) / np.maximum(held, 1), total(rights), low, high, over_low, over_high, over_near,
        np.log1p(np.maximum(at(held, previous), 0)), np.log1p(np.maximum(at(held, following), 0)), at(links, previous), at(links, following), np.log1p(held[parent]), links[parent], np.log1p(mean[parent]), held / np.maximum(held[parent], 1),
        runs, total([t == "p" for t in tags]), inner_low, inner_high, np.log1p(longest),
    ]
    out = np.zeros((n, len(COLUMNS)), np.float32)
    for j, x in enumerate(numbers):
        out[:, j] = x
    kind = np.array([TAG_NUMBER.get(t, -1) for t in tags])
    known = np.flatnonzero(kind >= 0)
    out[known, len(numbers) + kind[known]] = 1
    out[:, len(numbers) + len(TAGS) :] = (np.array(within)[:, None] >> np.arange(len(BIT))) & 1
    return out
