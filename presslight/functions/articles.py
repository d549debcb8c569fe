"""Article texts by scores over the element tree (UD-01).

A small helper turns a page into flat arrays: elements in document order with the end of their subtree, and pieces of text between them.
It gives the text of each extraction method; which of them a page keeps is decided by Spark's functions on the cleaned texts: the basic
one if its quality is good, else the best of the others by score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean_text, quality_of

# Elements that are never text, frames of a page, and elements that have no end.
SILENT = {"script", "style", "noscript", "iframe", "svg"}
FRAMES = {"nav", "header", "footer"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
# What class names of adverts and of side parts hold.
AD_PARTS = ("ad", "banner", "cookie")
SIDE_PARTS = ("nav", "menu", "sidebar", "related", "recommended", "recent")
# Containers of articles, best first: (element or None, class or None, itemprop or None).
CONTAINERS = [("article", None, None), ("main", None, None), ("div", "article", None), ("div", "post", None), ("div", "entry", None), ("div", "content", None), ("div", None, "articleBody"), ("div", "article-content", None), (None, "post-content", None), (None, "entry-content", None)]
# Words of a text that is a list of links, and of lines that are.
LIST_WORDS = ("recent posts", "related articles", "categories", "tags", "share this", "follow us")
LINE_WORDS = ("recent posts", "related articles", "categories", "tags")
FRAME, AD, SIDE = 1, 2, 4
METHODS = ("title_based", "density_based", "filtered_text", "longest_block")


class _Tree(HTMLParser):
    """tag, classes, itemprop, parent, end, marks (of itself and what is above) and first and last piece of each element; pieces with their marks."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.classes, self.prop, self.parent, self.end, self.marks, self.first, self.last = [], [], [], [], [], [], [], []
        self.pieces: list[tuple[str, int]] = []
        self._open: list[int] = []
        self._silent = 0
        self.feed(source)
        self.close()
        while self._open:
            self._pop()
        self.by_tag: dict[str, list[int]] = {}
        for i, t in enumerate(self.tag):
            self.by_tag.setdefault(t, []).append(i)

    def _pop(self) -> None:
        i = self._open.pop()
        self.end[i], self.last[i] = len(self.tag), len(self.pieces)
        self._silent -= self.tag[i] in SILENT

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        if tag == "p":
            self.handle_endtag("p")
        classes = (a.get("class") or "").split()
        low = [c.lower() for c in classes]
        marks = (FRAME if tag in FRAMES else 0) | (AD if any(p in c for c in low for p in AD_PARTS) else 0) | (SIDE if tag == "aside" or any(p in c for c in low for p in SIDE_PARTS) else 0)
        above = self._open[-1] if self._open else -1
        for column, x in ((self.tag, tag), (self.classes, classes), (self.prop, a.get("itemprop")), (self.parent, above), (self.end, 0), (self.marks, marks | (self.marks[above] if above >= 0 else 0)), (self.first, len(self.pieces)), (self.last, 0)):
            column.append(x)
        self._open.append(len(self.tag) - 1)
        self._silent += tag in SILENT

    def handle_endtag(self, tag):
        if any(self.tag[i] == tag for i in self._open):
            while self.tag[self._open[-1]] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self._silent:
            self.pieces.append((data, self.marks[self._open[-1]] if self._open else 0))


class _View:
    """The tree without elements of some marks."""

    def __init__(self, tree: _Tree, without: int):
        self.t, self.without = tree, without

    def all(self, *tags: str, within: int | None = None) -> list[int]:
        """Elements of these names that are not left out, in document order, below an element."""
        found: list[int] = []
        for tag in tags:
            places = self.t.by_tag.get(tag, [])
            if within is not None:
                places = places[bisect_left(places, within + 1) : bisect_left(places, self.t.end[within])]
            found += [i for i in places if not self.t.marks[i] & self.without]
        return sorted(found)

    def pieces(self, i: int | None) -> list[str]:
        part = self.t.pieces if i is None else self.t.pieces[self.t.first[i] : self.t.last[i]]
        return [p for p, marks in part if not marks & self.without]

    def whole(self, i: int | None) -> str:
        return "".join(self.pieces(i)).strip()

    def dense(self, i: int | None) -> str:
        """The text without white space around its pieces."""
        return "".join(p.strip() for p in self.pieces(i))

    def h1(self) -> int | None:
        return next(iter(self.all("h1")), None)

    def children_after(self, i: int) -> Iterator[int]:
        """The next siblings of an element."""
        j, stop = self.t.end[i], self.t.end[self.t.parent[i]] if self.t.parent[i] >= 0 else len(self.t.tag)
        while j < stop:
            if not self.t.marks[j] & self.without:
                yield j
            j = self.t.end[j]

    def above(self, i: int) -> Iterator[int]:
        while (i := self.t.parent[i]) >= 0:
            yield i

    def paragraphs(self, within: int | None, title: str = "") -> str:
        """The title and the paragraphs of more than 20 characters."""
        texts = (self.whole(p) for p in self.all("p", within=within))
        return "\n\n".join([*([title] if title else []), *(t for t in texts if len(t) > 20)])


def content_score(view: _View, i: int, title: str) -> float:
    """How likely an element holds the article: its paragraphs, length, title and sentences; less for lists and many links; 0 for short ones."""
    text = view.dense(i)
    if len(text) < 200:
        return 0.0
    low, stops = text.lower(), text.count(".")
    score = 2 * len(view.all("p", within=i)) + min(len(text) / 500, 10) + 5 * (title.lower() in low) - 3 * sum(w in low for w in LIST_WORDS)
    score += min(stops / 10, 5) if stops > 10 else 0
    score -= 5 if len(view.all("a", within=i)) > 20 else 0
    return max(score, 0.0)


def _likely_area(view: _View) -> int | None:
    """The best by score of: what is around the h1, what follows it, and any div of five paragraphs or more. The first of equals."""
    h1 = view.h1()
    if h1 is None:
        return None
    title, count = view.whole(h1), lambda i: len(view.all("p", within=i))
    around = []
    for i in list(view.above(h1))[:4]:
        if view.t.tag[i] in ("html", "body"):
            break
        around.append(i)
    after = [i for _, i in zip(range(10), view.children_after(h1)) if view.t.tag[i] in ("div", "section", "article")]
    found = [i for i in around if count(i) >= 3] + [i for i in after if count(i) >= 2] + [i for i in view.all("div") if count(i) >= 5]
    return max(found, key=lambda i: content_score(view, i, title), default=None)


def _basic(view: _View) -> str:
    """Title and paragraphs of the first kind of container that the page has (its largest), else of the likely area, else of the body; without any, the longest divs."""
    area = None
    for tag, cls, prop in CONTAINERS:
        found = [i for i in (view.all(tag) if tag else view.all(*view.t.by_tag)) if (cls is None or cls in view.t.classes[i]) and (prop is None or view.t.prop[i] == prop)]
        if found:
            area = max(found, key=lambda i: len(view.dense(i)))
            break
    if area is None:
        area = _likely_area(view)
    if area is None:
        area = next(iter(view.all("body")), None)
    h1 = view.h1()
    text = view.paragraphs(area, view.whole(h1) if h1 is not None else "")
    if not text:
        divs = [d for i in view.all("div", within=area) if len(d := view.dense(i)) > 100]
        text = "\n\n".join(sorted(divs, key=len, reverse=True)[:5])
    return text


def _near_title(view: _View, topic: list[str]) -> str:
    h1 = view.h1()
    if h1 is None or (topic and not any(w in view.whole(h1).lower() for w in topic)):
        return ""
    found = [i for i in view.children_after(h1) if view.t.tag[i] in ("div", "section", "article") and len(view.dense(i)) > 500][:3]
    around = [i for i in list(view.above(h1))[:3] if view.t.tag[i] in ("article", "main", "div") and len(view.all("p", within=i)) >= 3]
    most = max(found + around[:1], key=lambda i: len(view.all("p", within=i)), default=None)
    return view.paragraphs(most, view.whole(h1)) if most is not None and view.all("p", within=most) else ""


def _densest(view: _View) -> str:
    best, most = None, 0.0
    for i in view.all("div", "section", "article", "main"):
        lengths = [len(view.dense(p)) for p in view.all("p", within=i)]
        score = len(lengths) * min(sum(lengths) / len(lengths) / 100, 3) if len(lengths) >= 3 else 0
        if score > most:
            best, most = i, score
    h1 = view.h1()
    return view.paragraphs(best, view.whole(h1) if h1 is not None else "") if best is not None else ""


def _filtered(view: _View, topic: list[str]) -> str:
    """The title and the first 50 lines that are long enough, those of the topic from 30 characters on."""
    lines = [x for p in view.pieces(None) for x in map(str.strip, p.split("\n")) if len(x) >= 30 and not any(w in x.lower() for w in LINE_WORDS)]
    kept = [x for x in lines if (any(w in x.lower() for w in topic) or len(x) > 100 if topic else len(x) > 50)]
    h1 = view.h1()
    return ((view.whole(h1) + "\n\n") if h1 is not None else "") + "\n\n".join(kept[:50])


def _longest(view: _View) -> str:
    best = max(view.all("p", "div", "section", "article"), key=lambda i: len(view.dense(i)), default=None)
    if best is None or len(view.dense(best)) <= 500:
        return ""
    h1 = view.h1()
    return ((view.whole(h1) + "\n\n") if h1 is not None else "") + view.dense(best)


def _texts(source: str | None, topic: str | None) -> tuple[str, ...]:
    """Title, and the text of the basic and of each other method."""
    tree = _Tree(source or "")
    words = (topic or "").lower().split()
    basic, open_, filtered = _View(tree, FRAME | AD), _View(tree, 0), _View(tree, FRAME | SIDE)
    h1 = open_.h1()
    title = open_.whole(h1) if h1 is not None else next((open_.whole(i) for i in open_.all("title")), "")
    return title, _basic(basic), _near_title(open_, words), _densest(open_), _filtered(filtered, words), _longest(open_)


def chosen_article(df: DataFrame, topic: Column, url: Column | None) -> DataFrame:
    """text, method and quality from basic and the columns of METHODS: basic if it is good; else the best of the others if that is good; else the longer of the two.

    A text of a method under 200 characters does not count; of equal scores the first stays.
    """
    words = F.filter(F.split(F.lower(F.coalesce(topic, F.lit(""))), r"\s+"), lambda w: w != "")

    def judged(s: Column) -> Column:
        return F.struct(s["order"].alias("order"), s["method"].alias("method"), s["text"].alias("text"), quality_of(s["text"], topic, url).alias("quality"))

    def scored(s: Column) -> Column:
        text = s["text"]
        stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
        points = F.least(F.length(text) / 1000, F.lit(5.0)) + 2 * F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) + F.when(stops > 10, 2).otherwise(0) + F.when(s["quality"] == "good", 0).otherwise(-5)
        return F.struct(F.when(F.length(text) >= 200, points).alias("score"), *(s[f].alias(f) for f in ("order", "method", "text", "quality")))

    # one expression for the texts of all methods, exploded from an array of one element so that it is not worked out again for each of its parts
    texts = F.array(*(F.struct(F.lit(-k).alias("order"), F.lit(m).alias("method"), clean_text(F.col(m)).alias("text")) for k, m in enumerate(("basic", *METHODS))))
    df = df.withColumn("_all", F.explode(F.array(F.transform(F.transform(texts, judged), scored))))
    df = df.withColumns({"_own": F.get("_all", F.lit(0)), "_best": F.array_max(F.filter(F.slice("_all", 2, len(METHODS)), lambda s: s["score"] > 0))})
    other = F.coalesce((F.col("_own.quality") != "good") & ((F.col("_best.quality") == "good") | (F.length("_best.text") > F.length("_own.text"))), F.lit(False))
    pick = lambda c: F.when(other, F.col(f"_best.{c}")).otherwise(F.col(f"_own.{c}"))
    return df.withColumns({c: pick(c) for c in ("text", "method", "quality")}).drop("basic", "_all", "_own", "_best", *METHODS)


def extract_articles(pages: DataFrame, topic: Column | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, title, text, method, quality (good or why not), n_chars; the topic, if any, is what a page should speak of.

    A null or empty page has empty texts. Paragraphs end where the next one begins.
    """
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, u, t, *_texts(h, t)) for i, u, h, t in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["topic"])]
            yield pd.DataFrame(rows, columns=["page_id", "url", "topic", "title", "basic", *METHODS])

    wanted = (F.lit(None) if topic is None else topic).cast("string")
    schema = "page_id long, url string, topic string, title string, basic string, " + ", ".join(f"{m} string" for m in METHODS)
    texts = pages.select("page_id", "url", "html", wanted.alias("topic")).mapInPandas(made, schema)
    out = chosen_article(texts, F.col("topic"), F.col("url"))
    return out.select("page_id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), "text", "method", "quality", F.length("text").alias("n_chars"))
