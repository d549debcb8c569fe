"""Articles, links, bylines and dates of HTML pages with the standard library's parser, in mapInArrow (UD, SF-22, SF-36)."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without text of the article, and elements that never close.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"article", "main", "section", "div", "body"}
#: Marks of likely articles, best first: parts of the href, then elements and classes around the link.
LIKELY_HREFS = ("/review", "/test", "/drive", "/first", "/road", "/blog/post/")
LIKELY_PLACES = ("article", ".post", ".entry", ".article", "h1", "h2", "h3", ".headline", ".title", ".blog-post", ".post-title", ".entry-title")
NO_ARTICLE = ("/category/", "/tag/", "/author/", "/search", "/page/", ".jpg", ".png", ".pdf")
VIDEO = ("youtube.com", "youtu.be", "tiktok.com", "instagram.com")
AD = re.compile(r"\b(ad|ads|advert|sidebar|cookie|comment|share|promo)\b", re.I)


class _Page(HTMLParser):
    """Collects title, h1, paragraphs with their container, links, meta tags and times."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.paragraphs, self.links, self.meta, self.times, self.json_ld, self.bylines = "", "", [], [], {}, [], [], []
        self._stack: list[tuple[str, bool, int]] = []
        self._places: list[set[str]] = []
        self._skip, self._block, self._blocks, self._text, self._into, self._link, self._by = 0, 0, 0, None, None, None, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or "", a.get("content", ""))
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        if tag in VOID:
            return
        mark = f"{a.get('class', '')} {a.get('id', '')}"
        skip = tag in SKIPPED or (tag in BLOCKS and bool(AD.search(mark)))
        if tag == "p":
            self._close_p()
        self._stack.append((tag, skip, self._block))
        self._places.append({tag, *("." + c for c in a.get("class", "").split())})
        self._skip += skip
        if tag in BLOCKS:
            self._blocks += 1
            self._block = self._blocks
        if tag == "script" and "ld+json" in a.get("type", ""):
            self._into = ("json", [])
        elif tag in ("title", "h1"):
            self._into = (tag, [])
        elif tag == "p" and not self._skip:
            self._text = []
        elif tag == "a" and a.get("href"):
            self._link = (a["href"], [], self._rank(a["href"]))
        if re.search(r"\b(byline|author)\b", mark, re.I):
            self._by = (len(self._stack), [])

    def _rank(self, href: str) -> int:
        """How early a link of an index page is likely to be an article."""
        for k, part in enumerate(LIKELY_HREFS):
            if part in href:
                return k
        around = set().union(*self._places[:-1])
        return len(LIKELY_HREFS) + next((k for k, place in enumerate(LIKELY_PLACES) if place in around), len(LIKELY_PLACES))

    def _close_p(self):
        if self._text is not None:
            text = re.sub(r"\s+", " ", "".join(self._text)).strip()
            if len(text) > 20:
                self.paragraphs.append((self._block, text))
            self._text = None

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self._stack):
            return
        while self._stack:
            t, skip, block = self._stack.pop()
            self._places.pop()
            if t == "p":
                self._close_p()
            if self._by and len(self._stack) < self._by[0]:
                self.bylines.append("".join(self._by[1]))
                self._by = None
            self._skip -= skip
            self._block = block
            if t == "a" and self._link:
                self.links.append((self._link[0], re.sub(r"\s+", " ", "".join(self._link[1])).strip(), self._link[2]))
                self._link = None
            if self._into and t in ("title", "h1", "script"):
                kind, parts = self._into
                if kind == "json":
                    self.json_ld.append("".join(parts))
                elif not getattr(self, kind):
                    setattr(self, kind, re.sub(r"\s+", " ", "".join(parts)).strip())
                self._into = None
            if t == tag:
                break

    def handle_data(self, data):
        if self._into:
            self._into[1].append(data)
        if self._text is not None and not self._skip:
            self._text.append(data)
        if self._link:
            self._link[1].append(data)
        if self._by:
            self._by[1].append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close_p()
    return page


#: Pages of a batch that are taken at once; a worker holds no more pages and rows of them as Python objects.
SLICE = 128
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def by_page(pages: DataFrame, cols: list[str], rows_of: Callable[..., Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """The rows that rows_of(*cols) gives for each page; fields are their names and types."""
    schema = pa.schema([(name, _TYPES[t]) for name, t in fields.items()])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = [r for page in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)) for r in rows_of(*page)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return pages.select(*cols).mapInArrow(made, ", ".join(f"{name} {t}" for name, t in fields.items()))


def _links(url: str | None, html: str | None) -> list[tuple[str, str, str]]:
    """Distinct absolute links with anchor text and category, likely articles first, each as where it is likeliest."""
    own, seen = urlsplit(url or "").netloc.lower(), {}
    for k, (href, text, rank) in enumerate(parse(html).links):
        try:
            to = urljoin(url or "", href)
            parts = urlsplit(to)
        except ValueError:
            continue
        if parts.scheme in ("http", "https") and (to not in seen or rank < seen[to][0]):
            host, path = parts.netloc.lower(), parts.path.lower()
            if own and (host == own or host.endswith("." + own)):
                kind = "listing" if any(x in path for x in NO_ARTICLE) else "article"
            else:
                kind = "video" if any(v in host for v in VIDEO) else "external"
            seen[to] = (rank, k, text, kind)
    return [(to, text, kind) for to, (_, _, text, kind) in sorted(seen.items(), key=lambda x: x[1][:2])]


def extract_links(pages: DataFrame, n: int = 100) -> DataFrame:
    """The first n article links of each page, absolute and distinct, with anchor text: on its domain, no listings or files, likely articles first."""

    def rows(i, url, html):
        articles = [x for x in _links(url, html) if x[2] == "article"]
        return [(i, k + 1, *x) for k, x in enumerate(articles[:n])]

    return by_page(pages, ["page_id", "url", "html"], rows, {"page_id": "long", "position": "int", "link": "string", "anchor": "string", "category": "string"})


def link_counts(pages: DataFrame) -> DataFrame:
    """How many distinct links of each category (article, listing, video, external) each page has, all of them."""

    def rows(i, url, html):
        return [(i, kind, n) for kind, n in Counter(kind for _, _, kind in _links(url, html)).items()]

    return by_page(pages, ["page_id", "url", "html"], rows, {"page_id": "long", "category": "string", "links": "long"})


def extract_bylines(pages: DataFrame) -> DataFrame:
    """page_id and byline: from an author mark or meta tag, else from a line "By Name"."""

    def rows(i, html):
        page = parse(html)
        found = [page.meta.get("author", ""), *page.bylines, *(m[1] for _, t in page.paragraphs if (m := re.match(r"By ([A-Z][\w.'-]+(?: [A-Z][\w.'-]+){1,2})", t)))]
        names = [re.sub(r"(?i)^\s*by\s+", "", re.sub(r"\s+", " ", f)).strip() for f in found]
        return [(i, next((x for x in names if 2 < len(x) < 60), None))]

    return by_page(pages, ["page_id", "html"], rows, {"page_id": "long", "byline": "string"})


def page_date(pages: DataFrame, as_of: str) -> DataFrame:
    """The first sound date of each page: JSON-LD, meta tags, time elements, text; from 10 years before as_of to 30 days after."""
    from .dates import parse_date

    def rows(i, html):
        page, found = parse(html), []
        for text in page.json_ld:
            try:
                data = json.loads(text)
            except ValueError:
                continue
            found += [d[k] for d in (data if isinstance(data, list) else [data]) if isinstance(d, dict) for k in ("datePublished", "dateCreated") if isinstance(d.get(k), str)]
        found += [page.meta[k] for k in ("article:published_time", "og:published_time", "date", "pubdate") if k in page.meta]
        found += page.times + [m[0] for _, t in page.paragraphs for m in [re.search(r"\b[A-Z][a-z]+ \d{1,2}, \d{4}\b|\b\d{4}-\d{2}-\d{2}\b", t)] if m]
        return [(i, found)]

    dates = by_page(pages, ["page_id", "html"], rows, {"page_id": "long", "found": "array<string>"}).select("page_id", F.posexplode_outer("found").alias("rank", "raw"))
    day = parse_date(F.col("raw"))
    now = F.lit(as_of).cast("date")
    sound = F.when(day.between(F.add_months(now, -120), F.date_add(now, 30)), day)
    return dates.withColumn("_d", sound).groupBy("page_id").agg(F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("rank"))).alias("page_date"))


SCRIPT = re.compile(r"<script\b[^>]*>(.*?)(?:</script|\Z)", re.I | re.S)
ASSIGNED = re.compile(r"(?:\bwindow\.\w+|\bvar \w+|\b__NEXT_DATA__)\s*=\s*(?=\{)")
NESTING = re.compile(r'"(?:\\.|[^"\\])*"|[{}]', re.S)


def _no_constant(name: str):
    raise ValueError(name)


def _states(html: str | None) -> Iterator[tuple[int, str]]:
    """Position and text of the objects that parse, with commas before a closing bracket dropped where that is needed."""
    position = 0
    for script in SCRIPT.findall(html or ""):
        at = 0
        while found := ASSIGNED.search(script, at):
            at, depth, text = found.end(), 0, None
            for part in NESTING.finditer(script, at):
                depth += {"{": 1, "}": -1}.get(part[0], 0)
                if not depth:
                    text = script[at : part.end()]
                    break
            for t in () if text is None else (text, re.sub(r",(\s*[}\]])", r"\1", text)):
                try:
                    json.loads(t, parse_constant=_no_constant)
                except (ValueError, RecursionError):
                    continue
                yield position, t
                at += len(text)
                break
            position += 1


def embedded_json(pages: DataFrame) -> DataFrame:
    """State objects that scripts assign (window.X = {..}, var X, __NEXT_DATA__), as JSON text that parses; position counts a page's assignments."""

    def rows(i, html):
        return [(i, k, t) for k, t in _states(html)]

    return by_page(pages, ["page_id", "html"], rows, {"page_id": "long", "position": "int", "json": "string"})


_ITEM = "struct<title: string, link: array<struct<_VALUE: string, _href: string>>, description: string, summary: string, content: string>"
#: RSS (items in the channel, or beside it) and Atom (entries) under one schema; names with a prefix are other names.
_FEED = "channel struct<item: array<{0}>>, item array<{0}>, entry array<{0}>, _broken string"


def parse_feeds(feeds: DataFrame, item: str = _ITEM) -> DataFrame:
    """feeds(page_id, xml) -> page_id, kind (rss, atom), items and, for documents without any, reject_reason (empty, broken, no_items).

    A document is parsed whole or not at all; namespaces, attributes and CDATA are the parser's care. Each is parsed once: what is told of it
    is exploded from an array of one element, through which no filter on it is pushed (a filter would parse anew for every field it names).
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "attributePrefix": "_", "valueTag": "_VALUE"}
    blank = F.coalesce(F.trim("xml"), F.lit("")) == ""
    some = lambda c: F.when(F.size(c) > 0, c)

    def told(d: Column) -> Column:
        rss, atom = F.coalesce(some(d["channel"]["item"]), some(d["item"])), some(d["entry"])
        reason = F.when(blank, "empty").when(d["_broken"].isNotNull() | d.isNull(), "broken").when(rss.isNull() & atom.isNull(), "no_items")
        kind = F.when(rss.isNotNull(), "rss").otherwise("atom")
        return F.struct(F.when(reason.isNull(), kind).alias("kind"), F.when(reason.isNull(), F.coalesce(rss, atom)).alias("items"), reason.alias("reject_reason"))

    # text before the root, such as a byte order mark, is not the document's
    document = F.when(~blank, F.from_xml(F.regexp_replace("xml", r"^[^<]+", ""), _FEED.format(item), options))
    return feeds.select("page_id", F.explode(F.transform(F.array(document), told)).alias("_d")).select("page_id", "_d.kind", "_d.items", "_d.reject_reason")


def feed_items(feeds: DataFrame, term: str) -> DataFrame:
    """Items of RSS and Atom documents (page_id, xml) whose title or description holds a term: page_id, kind, position, title, link, description.

    The description is the item's own, else its summary, else its content; the link its first one's address, else its text.
    """
    items = parse_feeds(feeds).select("page_id", "kind", F.posexplode("items").alias("position", "_i"))
    link = F.get("_i.link", F.lit(0))
    items = items.select(
        "page_id", "kind", "position", F.trim(F.coalesce("_i.title", F.lit(""))).alias("title"), F.trim(F.coalesce(F.nullif(link["_href"], F.lit("")), link["_VALUE"])).alias("link"),
        F.trim(F.coalesce("_i.description", "_i.summary", "_i.content", F.lit(""))).alias("description"),
    )
    return items.filter(F.contains(F.lower("title"), F.lit(term.lower())) | F.contains(F.lower("description"), F.lit(term.lower())))


def feed_rejects(feeds: DataFrame) -> DataFrame:
    """Documents that gave no items, with the reason; of items only their number matters, so no more than titles is converted."""
    return parse_feeds(feeds, "struct<title: string>").filter("reject_reason IS NOT NULL").select("page_id", "reject_reason")


# Words by which features fall into categories (the first that fits), features found by pattern, and attributes by lexicon.
CATEGORIES = {
    "performance": ["engine", "turbo", "hp", "torque", "transmission", "awd", "4wd", "speed"],
    "technology": ["display", "screen", "connect", "wireless", "smart", "digital", "tech"],
    "safety": ["safety", "airbag", "collision", "brake", "assist", "monitor", "alert"],
    "design": ["design", "style", "interior", "exterior", "seat", "wheel", "color"],
    "comfort": ["comfort", "quiet", "smooth", "climate", "heated", "cooled", "massage"],
    "utility": ["cargo", "space", "towing", "storage", "capacity", "versatile"],
}
FEATURES = {
    "performance": [r"(\d+(?:\.\d+)?[- ]?(?:liter|L|turbo|hp|horsepower|lb-ft|torque))", r"((?:manual|automatic|AWD|all-wheel|4WD) (?:transmission|drive))", r"((?:sport|dynamic|performance) (?:mode|tuned|suspension))"],
    "technology": [r"(\d+(?:\.\d+)?[- ]?inch (?:display|screen|infotainment))", r"((?:wireless|Android|Apple|CarPlay|smartphone) (?:integration|connectivity))", r"((?:adaptive|smart|advanced) (?:cruise|safety|driver))"],
    "design": [r"((?:panoramic|power|sliding) (?:moonroof|sunroof|roof))", r"((?:LED|adaptive|signature) (?:headlights|lighting|lights))", r"((?:leather|premium|sport) (?:seats|interior|trim))"],
}
ATTRIBUTES = {
    "premium": ["premium", "luxury", "upscale", "refined"],
    "sporty": ["sporty", "dynamic", "athletic", "performance"],
    "practical": ["practical", "versatile", "functional", "capable"],
    "innovative": ["innovative", "advanced", "cutting-edge", "modern"],
    "reliable": ["reliable", "dependable", "quality", "durable"],
}
BULLET = r"^\s*(?:\d+\.|[-*•])\s*"


def _listed(heading: str):
    """The bullets that follow the first line with the heading, up to another line."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda l: l.rlike(heading)), True)
    rest = F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.size(lines))).otherwise(F.slice(lines, 1, 0))
    end = F.array_position(F.transform(rest, lambda l: ~l.rlike(BULLET + r"\S")), True)
    return F.transform(F.slice(rest, 1, F.when(end > 0, end.cast("int") - 1).otherwise(F.size(rest))), lambda l: F.trim(F.regexp_replace(l, BULLET, "")))


def parse_oem_text(docs: DataFrame, default_year: int, n: int = 10) -> DataFrame:
    """doc_id, year, positioning (first sentence), the first n features with category and priority: the bullets of KEY VALUES or FEATURES, then those found by pattern."""
    year = F.coalesce(F.nullif(F.regexp_extract("text", r"\b(20[0-3]\d)\b", 1), F.lit("")).try_cast("int"), F.lit(default_year))
    first = F.trim(F.regexp_extract("text", r"(?s)^(.*?[.!?])(?:\s|$)", 1))

    def category(feature):
        kind = F.lit("other")
        for name, words in reversed(CATEGORIES.items()):
            kind = F.when(F.lower(feature).rlike("|".join(words)), name).otherwise(kind)
        return kind

    def matches(kind, pattern):
        return F.transform(F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(1)), lambda f: F.struct(f.alias("feature"), F.lit(kind).alias("category"), F.lit("secondary").alias("priority")))

    ddl = "array<struct<feature: string, category: string, priority: string>>"
    listed = F.transform(_listed(r"(?i)KEY (?:VALUES|FEATURES)"), lambda f, i: F.struct(f.alias("feature"), category(f).alias("category"), F.when(i < 3, "primary").otherwise("secondary").alias("priority"))).cast(ddl)
    found = F.concat(*(matches(k, p) for k, patterns in FEATURES.items() for p in patterns)).cast(ddl)
    known = lambda a, x: F.exists(a, lambda f: F.contains(F.lower(x["feature"]), F.lower(f["feature"])))
    features = F.aggregate(found, F.slice(listed, 1, n), lambda a, x: F.when((F.size(a) >= n) | known(a, x), a).otherwise(F.concat(a, F.array(x))))
    rows = docs.select("doc_id", year.alias("year"), first.alias("positioning"), features.alias("_f")).select("doc_id", "year", "positioning", F.posexplode_outer("_f").alias("_p", "_f"))
    return rows.select("doc_id", "year", "positioning", "_f.feature", "_f.category", "_f.priority", (F.col("_p") + 1).alias("position"))


def parse_oem_messages(docs: DataFrame) -> DataFrame:
    """doc_id, target_audience, purchase_reasons (in order of priority), brand_attributes and competitors of each text."""
    part = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    audience = F.coalesce(part(r"(?i)(?:CUSTOMER|TARGET|BUYER).*?(?:PROFILE|AUDIENCE)[:\s]*([^\n]+)"), part(r"(?i)(?:designed for|targeted at|appeals to)\s+([^.]+)"))
    attributes = F.array_compact(F.array(*(F.when(F.lower("text").rlike("|".join(words)), name) for name, words in ATTRIBUTES.items())))
    named = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (r"(?i)(?:compared to|versus|vs\.?|against)\s+(?:the\s+)?([A-Z]\w+\s+[A-Z]\w+)", r"(?i)(?:competes with|competitors?(?:\s+include)?)[:\s]+([^.]+)")))
    competitors = F.array_distinct(F.flatten(F.transform(named, lambda m: F.regexp_extract_all(m, F.lit(r"([A-Z]\w+\s+[A-Z0-9\-]+)"), F.lit(1)))))
    return docs.select("doc_id", audience.alias("target_audience"), F.transform(_listed("(?i)PURCHASE REASONS"), F.lower).alias("purchase_reasons"), attributes.alias("brand_attributes"), competitors.alias("competitors"))


def split_models(docs: DataFrame, models: list[str], min_len: int = 500) -> DataFrame:
    """Sections of texts with more than one of the models: from each model's first mention to the next one's, of some length."""
    marks = F.array_sort(F.filter(F.array(*(F.struct(F.instr(F.lower("text"), m.lower()).alias("at"), F.lit(m).alias("model")) for m in models)), lambda s: s["at"] > 0))
    many = docs.withColumn("_m", marks).filter(F.size("_m") > 1)
    cut = many.select("doc_id", "text", "_m", F.posexplode("_m").alias("_p", "_s"))
    end = F.coalesce(F.try_element_at("_m", F.col("_p") + 2)["at"], F.length("text") + 1)
    return cut.select("doc_id", F.col("_s.model").alias("model"), F.substring("text", F.col("_s.at"), end - F.col("_s.at")).alias("section")).filter(F.length("section") > min_len)
