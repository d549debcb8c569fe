"""Main text of HTML pages by gradient-boosted trees over DOM-node features.

The trees give each node the log-odds that its subtree holds main text. They are trained here, on
pages laid out by the grammar below, in which every run of text is marked; the grammar varies tags,
class words, nesting, order, lengths and missing end tags, and leaves either tags or class words
out at random, so that no single one is enough. The model is the same whatever table it is used on, so a
page's text does not depend on the other pages.

Decoding goes through the tree once: a node may stay only under one that stays, and of all such choices the
one with the largest sum of log-odds is taken, so a menu's items can't stay when the menu goes,
nor the article go when its paragraphs outweigh it.
"""

from __future__ import annotations

import html
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .dom import COLUMNS, Page, features, parse

#: Pages laid out for training, trees, their depth, the step of each and the bins of a feature.
LAID_OUT, TREES, DEPTH, STEP, BINS = 400, 50, 4, 0.3, 32
#: A node's log-odds are held to this, so that no single one decides over a large subtree.
MOST = 6.0

# Fixed values of the layout grammar: class words, in natural order.
MAIN_WORDS = "article content main post entry story body text copy article-body post-content entry-content main-content story-body articleBody blog-post page-content prose markdown news-text".split()
WRAP_WORDS = "container wrapper wrap page site row col inner layout grid outer root app shell columns".split()
MENU_WORDS = "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav tabs pagination pager toc links site-nav".split()
HEAD_WORDS = "header masthead site-header top-bar logo branding banner-top page-header".split()
FOOT_WORDS = "footer site-footer bottom copyright colophon legal footer-links".split()
SIDE_WORDS = "sidebar side aside widget related recommended popular trending most-read rail secondary more-stories tags author-box".split()
AD_WORDS = "ad ads advert advertisement sponsor sponsored promo banner adsense ad-slot advertorial".split()
NOTICE_WORDS = "cookie consent notice alert gdpr popup modal overlay notification message paywall subscribe newsletter disclaimer".split()
FORM_WORDS = "form search login signup newsletter-form contact-form search-box".split()
COMMENT_WORDS = "comment comments comment-list commentlist responses discussion replies disqus reader-comments comment-body".split()
SHARE_WORDS = "share social sharing share-buttons social-links follow".split()


class Layout:
    """Writes one page and marks its runs: `html` and `marks`, 1 for each run of main text in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.marks: list[int] = []
        letters = [chr(c) for c in self.r.choice((range(97, 123), range(0x430, 0x450), [*range(97, 123), 0xE9, 0xFC, 0xF1]))]
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 11))) for _ in range(300)]
        self.named, self.tagged = self.r.random() < 0.9, self.r.random() < 0.8  # class words and tags that say what they hold
        self.within = False  # the article: what is not of it is told there by a tag or a word
        self.loose = self.r.random() < 0.4  # leaves end tags out
        self.page()

    def some(self, low: int, high: int) -> str:
        n = round(math.exp(self.r.uniform(math.log(low), math.log(high))))
        words = self.r.choices(self.words, k=n)
        marks = self.r.choices(["", ",", "."], [8, 1, 1], k=n)
        text = " ".join(w + m for w, m in zip(words, marks)).capitalize()
        return text + self.r.choice([".", ".", "", "!", "?"])

    def run(self, text: str, main: bool) -> str:
        self.marks.append(int(main))
        return html.escape(text)

    def attributes(self, words: list[str], chance: float = 0.9) -> str:
        if not self.within and (not self.named or self.r.random() > chance):
            return self.r.choice(["", f' class="{self.r.choice(WRAP_WORDS)}"', f' class="c{self.r.randrange(99)}"'])
        word = self.r.choice(words)
        more = f" {self.r.choice(words)}" if self.r.random() < 0.2 else ""
        return self.r.choice([f' class="{word}{more}"', f" id={word}", f' class="{word}" data-x="1"', f" class='{self.r.choice(['x', 'box', 'block', 'clearfix'])} {word}{more}'"])

    def open(self, kinds: list[str], words: list[str]) -> str:
        """Opens an element that its tag or its class words tell, and returns its end tag."""
        tag = self.r.choice(kinds) if self.tagged and self.r.random() < 0.8 else self.r.choice(["div", "div", "div", "section"])
        self.out.append(f"<{tag}{self.attributes(words, 0.95 if tag in ('div', 'section') else 0.5)}>")
        return f"</{tag}>"

    def block(self, tag: str, text: str, main: bool, link: bool = False) -> None:
        inner = self.run(text, main)
        if link:
            inner = f'<a href="/{self.r.randrange(999)}">{inner}</a>'
        elif main and self.r.random() < 0.3 and " " in inner:
            a, b = inner.split(" ", 1)
            inner = self.r.choice([f"<b>{a}</b> {b}", f'{a} <a href="#">{b}</a>' if len(b) < 40 else f"{a} <em>{b}</em>", f"<span>{a}</span> {b}", f"<b>{a} {b}<br>"])
        end = "" if self.loose and tag in ("p", "li", "td", "dd", "dt") and self.r.random() < 0.6 else f"</{tag}>"
        self.out.append(f"<{tag}>{inner}{end}")

    def items(self, main: bool, link: bool, low: int, high: int, most: int) -> None:
        tag = self.r.choice(["ul", "ul", "ol"])
        self.out.append(f"<{tag}>")
        for _ in range(self.r.randint(1, most)):
            self.block("li", self.some(low, high), main, link)
        self.out.append(f"</{tag}>")

    def menu(self) -> None:
        end = self.open(["nav"], MENU_WORDS)
        if self.r.random() < 0.7:
            self.items(False, True, 1, 4, 12)
        else:
            for _ in range(self.r.randint(2, 9)):
                self.out.append(f'<a href="/x">{html.escape(self.some(1, 3))}</a>{self.r.choice([" | ", " ", " &middot; "])}')
            self.marks.append(0)
        self.out.append(end)

    def header(self) -> None:
        end = self.open(["header"], HEAD_WORDS)
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(["div", "h1", "p", "h2"]), self.some(1, 9), False, self.r.random() < 0.5)
        if self.r.random() < 0.4:
            self.menu()
        self.out.append(end)

    def footer(self) -> None:
        end = self.open(["footer"], FOOT_WORDS)
        for _ in range(self.r.randint(0, 3)):
            self.r.choice([lambda: self.items(False, True, 1, 4, 8), lambda: self.block("p", self.some(3, 60), False), self.menu])()
        self.block(self.r.choice(["p", "div", "p"]), self.r.choice(["© ", "Copyright © ", ""]) + self.some(2, 30), False)
        self.out.append(end)

    def side(self) -> None:
        end = self.open(["aside"], SIDE_WORDS)
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(["h3", "h4", "h2", "p"]), self.some(1, 5), False)
            self.r.choice([lambda: self.items(False, True, 2, 12, 8), lambda: self.block("p", self.some(4, 70), False), lambda: self.items(False, False, 1, 12, 5)])()
        self.out.append(end)

    def advert(self) -> None:
        end = self.open(["div", "div", "aside"] if self.r.random() < 0.9 else ["p"], AD_WORDS)
        if self.r.random() < 0.6:
            self.out.append(self.run(self.some(3, 50), False))
        else:
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.some(3, 60), False, self.r.random() < 0.4)
        self.out.append(end)

    def notice(self) -> None:
        end = self.open(["dialog", "div", "aside", "section"], NOTICE_WORDS)
        if self.r.random() < 0.5:
            self.out.append(self.run(self.some(5, 50), False))
        else:
            for _ in range(self.r.randint(1, 3)):
                self.block(self.r.choice(["p", "p", "h3", "div"]), self.some(4, 60), False)
            if self.r.random() < 0.5:
                self.out.append("<button>OK</button>")
        self.out.append(end)

    def form(self) -> None:
        end = "</form>"
        self.out.append(f"<form{self.attributes(FORM_WORDS)}>")
        for _ in range(self.r.randint(1, 4)):
            self.block(self.r.choice(["p", "div", "h3"]), self.some(1, 15), False)
            self.out.append("<input name=q><select><option>a<option>b</select><textarea>t</textarea>")
        self.out.append(end)

    def comments(self) -> None:
        end = self.open(["section", "div", "section", "ol"], COMMENT_WORDS)
        item = "li" if end == "</ol>" else self.r.choice(["div", "div", "p", "article" if self.within or self.named else "div"])
        if item != "li" and self.r.random() < 0.6:
            self.block("h3", self.some(1, 4), False)
        for _ in range(self.r.randint(1, 8)):
            if item == "p":
                self.block("p", self.some(3, 120), False)
                continue
            self.out.append(f"<{item}{self.attributes(COMMENT_WORDS, 1.0 if item == 'article' else 0.7)}>")
            if self.r.random() < 0.6:
                self.block(self.r.choice(["div", "div", "h4"]), self.some(1, 3), False)
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.some(2, 120), False)
            self.out.append(f"</{item}>")
        self.out.append(end)

    def share(self) -> None:
        end = self.open(["div", "ul"], SHARE_WORDS)
        self.marks += [0] * (n := self.r.randint(1, 5)) if end == "</ul>" else [0]
        self.out.append("".join(f"<li><a href=x>{self.some(1, 2)}</a></li>" for _ in range(n)) if end == "</ul>" else " ".join(f"<a href=x>{self.some(1, 2)}</a>" for _ in range(4)))
        self.out.append(end)

    def passage(self) -> None:
        """One part of the article."""
        kind = self.r.random()
        if kind < 0.76:
            self.block("p" if self.r.random() < 0.95 else "div", self.some(1, 300), True)
        elif kind < 0.84:
            self.block(self.r.choice(["h2", "h3"]), self.some(1, 10), True)
        elif kind < 0.89:
            self.items(True, self.r.random() < 0.15, 2, 40, 8)
        elif kind < 0.92:
            self.out.append("<blockquote>")
            self.block("p", self.some(4, 80), True)
            self.out.append("</blockquote>")
        elif kind < 0.94:
            self.block("pre", self.some(3, 60), True)
        elif kind < 0.97:
            self.out.append("<table>")
            for _ in range(self.r.randint(1, 4)):
                self.out.append("<tr>")
                for _ in range(3):
                    self.block("td", self.some(1, 8), True)
            self.out.append("</table>")
        else:
            self.out.append("<figure><img src=a.png>")
            self.block("figcaption", self.some(3, 25), True)
            self.out.append("</figure>")

    def article(self) -> None:
        end = self.open(["article", "article", "main", "td", "section"], MAIN_WORDS)
        cell, self.within = end == "</td>", True
        if cell:
            self.out.insert(-1, "<table><tr>")
        titled = self.r.random() < 0.85
        if titled and self.r.random() < 0.25:
            self.out.append("<header>")
            self.block("h1", self.some(2, 20), True)
            self.out.append("</header>")
        elif titled:
            self.block(self.r.choice(["h1", "h1", "h2"]), self.some(2, 20), True)
        if self.r.random() < 0.2:
            self.block("p", self.some(1, 6), True)
        inner = self.r.random() < 0.25
        if inner:
            self.out.append(f"<div{self.attributes(MAIN_WORDS)}>")
        for i in range(round(math.exp(self.r.uniform(0, math.log(40))))):
            if i and self.r.random() < 0.07:
                self.r.choice([self.advert, self.side, self.share, self.form, self.notice])()
            self.passage()
        if inner:
            self.out.append("</div>")
        for chance, part in ((0.1, self.share), (0.08, self.form), (0.15, self.comments), (0.1, self.side)):
            if self.r.random() < chance:
                part()
        self.within = False
        self.out.append("</table>" if cell else end)

    def page(self) -> None:
        r = self.r
        head = "" if r.random() < 0.05 else f"<head><meta charset=utf-8><title>{self.some(1, 12)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        self.out.append(f"<!DOCTYPE html><html>{head}<body{r.choice(['', '', ' class=page'])}>")
        ends = []
        for _ in range(r.randint(0, 3)):
            tag = "form" if r.random() < 0.03 else "div"
            self.out.append(f"<{tag}{self.attributes(WRAP_WORDS)}>")
            ends.append(f"</{tag}>")
        before = [(0.5, self.header), (0.7, self.menu), (0.3, self.notice), (0.35, self.advert), (0.15, self.form), (0.2, self.side)]
        after = [(0.35, self.side), (0.35, self.comments), (0.25, self.advert), (0.2, self.share), (0.15, self.form), (0.2, self.notice), (0.3, self.menu)]
        if r.random() < 0.4:
            r.shuffle(before)
        r.shuffle(after)
        for chance, part in before:
            if r.random() < chance:
                self.out.append("<!-- x -->")
                part()
        if r.random() < 0.95:
            self.article()
        for chance, part in after:
            if r.random() < chance:
                part()
        if r.random() < 0.8:
            self.footer()
        self.out += ends if r.random() < 0.9 else []
        self.out.append("</body></html>" if r.random() < 0.9 else "")
        self.html = "".join(self.out)


def labelled(page: Page, marks: list[int]) -> np.ndarray:
    """1 for each node whose subtree holds main text, from the marks of the runs in page order."""
    y = np.zeros(len(page.tag))
    left = iter(marks)
    for i, t in enumerate(page.tag):
        if t == "run":
            y[i] = next(left)
    for i in range(len(y) - 1, 0, -1):
        y[page.parent[i]] = max(y[page.parent[i]], y[i])
    return y


@dataclass
class Model:
    """Scores of attribute tokens and complete trees: feature and threshold of each inner node, value of each leaf."""

    tokens: dict[str, float]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x)) * x.shape[1]
        flat = np.ascontiguousarray(x).ravel()
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (flat[rows + f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Trees of logistic loss by Newton steps over binned features, grown level by level."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    score, inner = np.full(n, base), 2**DEPTH - 1
    features_, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = weight * (y - p), weight * p * (1 - p)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best, split = np.full(wide, 1e-6), [(-1, 0)] * wide
            local = (at - first) * BINS
            g_all, h_all = np.bincount(at - first, gradient, wide), np.bincount(at - first, curve, wide)
            whole = g_all**2 / (h_all + 1)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                g = np.bincount(local + binned[:, j], gradient, wide * BINS).reshape(wide, BINS).cumsum(axis=1)[:, : len(cuts[j])]
                h = np.bincount(local + binned[:, j], curve, wide * BINS).reshape(wide, BINS).cumsum(axis=1)[:, : len(cuts[j])]
                gain = g**2 / (h + 1) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + 1) - whole[:, None]
                gain[(h < 1) | (h_all[:, None] - h < 1)] = -1
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(wide), k] > best):
                    best[i], split[i] = gain[i, k[i]], (j, int(k[i]))
            right = np.zeros(n, np.int64)
            for i, (j, k) in enumerate(split):
                if j >= 0:
                    f[first + i], t[first + i] = j, cuts[j][k]
                    mine = at == first + i
                    right[mine] = binned[mine, j] > k
            at = 2 * at + 1 + right
        leaf = at - inner
        v = STEP * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1)
        score += v[leaf]
        features_.append(f), thresholds.append(t), values.append(v)
    return np.array(features_), np.array(thresholds), np.array(values), base


def fit(pages: int = LAID_OUT) -> Model:
    """The model of so many laid-out pages: a bounded sample, the same at every call."""
    laid = [(parse(x.html), x.marks) for x in map(Layout, range(pages))]
    labels = [labelled(*x) for x in laid]
    seen, main = Counter(), Counter()
    for (page, _), y in zip(laid, labels):
        for tokens, mark in zip(page.tokens, y):
            seen.update(tokens)
            if mark:
                main.update(tokens)
    tokens = {k: math.log((main[k] + 0.5) / (n - main[k] + 0.5)) for k, n in seen.items() if n >= 5}
    x = features([page for page, _ in laid], tokens)
    weight = np.concatenate([np.full(len(y), 1 / math.sqrt(len(y))) for y in labels])  # long pages don't drown short ones
    return Model(tokens, *boosted(x, np.concatenate(labels), weight / weight.mean()))


def kept_runs(page: Page, log_odds: np.ndarray) -> list[int]:
    """The runs that stay in the best choice in which every node that stays has a parent that stays."""
    n = len(page.tag)
    score = np.clip(log_odds, -MOST, MOST).tolist()
    for i in range(n - 1, 0, -1):  # score: of the best choice in the subtree, if the node stays
        if score[i] > 0:
            score[page.parent[i]] += score[i]
    stays = [score[0] > 0] + [False] * (n - 1)
    for i in range(1, n):
        stays[i] = stays[page.parent[i]] and score[i] > 0
    return [i for i in range(n) if stays[i] and page.tag[i] == "run"]


def extract_main_text(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """pages with `text`: the main text, its blocks joined by an empty line.

    Character references are decoded; white space, no-break spaces included, becomes one space inside a block; block elements
    bound blocks, <br> does not. A null, empty or textless page gives an empty text. Rows are taken one by one, so repeated rows, ties and pages of
    any length need no care, and other columns pass unless they are called `text`. An empty table stays empty.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for sources in batches:
            parsed = [parse(s) for s in sources]
            odds = m.log_odds(features(parsed, m.tokens))
            out, at = [], 0
            for p in parsed:
                out.append("\n\n".join(p.text[i] for i in kept_runs(p, odds[at : at + len(p.tag)])))
                at += len(p.tag)
            yield pd.Series(out, dtype=object)

    return pages.withColumn("text", text_of(text_or_empty(html_col)))


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages, fit()).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
