"""Golden pages for every way an article's text is found, and the given pages by a plain rule."""

import html
import re

import pytest
from conftest import SF

from presslight.functions import articles as A
from pyspark.sql import functions as F

WORDS = "The seats are firm and the ride is quiet on long roads with little wind to hear in it. "
P = f"<p>{WORDS}</p>"
LONG = WORDS * 4


def texts(source, topic=None):
    return dict(zip(("title", "basic", *A.METHODS), A._texts(source, topic)))


def plain(text):
    return " ".join(text.split())


@pytest.mark.parametrize("source, kept", [
    (f"<article><p>{WORDS}</p></article><article><h1>T</h1>{P * 3}</article><div class=post>{P * 9}</div>", 3),  # the largest of the first kind
    (f"<main>{P * 2}</main><div class=post>{P * 9}</div>", 2),
    (f'<div itemprop="articleBody">{P * 2}</div><p>{WORDS}</p>', 2),
    (f"<section class='x post-content'>{P * 4}</section>{P}", 4),
    (f"<div id=o><div id=i><h1>T</h1>{P * 3}</div></div><div>{P}</div>", 3),  # around the h1
    (f"<h1>T</h1><div>{P * 2}</div><div>Other</div>", 2),  # after it
    (f"<i><h1>T</h1></i><div>{P * 5}<br>{WORDS}</div><div>{P * 6}</div>", 6),  # anywhere on the page
    (f"<body><h1>T</h1>{P * 2}<p>short</p></body>", 2),  # the body
])
def test_container_of_the_basic_text(source, kept):
    assert texts(source)["basic"].count("The seats") == kept


def test_what_the_basic_text_leaves_out():
    source = f"<nav>{P}</nav><header>{P}</header><footer>{P}</footer><div class='xAdx'>{P}</div><p class=cookie-bar>{WORDS}</p><script>var p = '<p>';</script><article><h1> T\n1 </h1>{P}<p>tiny</p></article>"
    found = texts(source)
    assert plain(found["basic"]) == plain(f"T 1 {WORDS}") and plain(found["title"]) == "T 1"
    assert plain(texts(f"<article><div>{LONG}</div><div>no</div><div><div>{LONG}x</div></div></article>")["basic"]) == plain(f"{LONG}x {LONG}x {LONG}")  # without paragraphs: divs, longest first


def test_other_methods():
    near = texts(f"<section><h1>Kona test</h1><div>{P * 7}</div><div>{LONG * 2}</div></section>", "Kona")
    assert near["title_based"].count("The seats") == 7 and texts(f"<h1>Kona</h1><div>{P * 7}</div>", "Rio")["title_based"] == ""
    assert texts(f"<div>{P * 2}</div>")["density_based"] == "" and texts(f"<div>{P * 3}<section>{P * 3}</section></div>")["density_based"].count("The seats") == 6
    lines = f"<aside>{LONG}</aside><div class='mainMenu'>{LONG}</div><div>short</div><p>{WORDS}</p><p>a line with the tags of fifty characters or more in it</p><p>a Kona of only thirty-five letters</p>"
    assert plain(texts(lines)["filtered_text"]) == plain(WORDS) and "Kona" in texts(lines, "kona")["filtered_text"] and "seats" not in texts(lines, "kona")["filtered_text"]
    assert texts(f"<p>{LONG * 2}</p>")["longest_block"] == (LONG * 2).strip() and texts(f"<p>{WORDS}</p>")["longest_block"] == ""


def test_score_of_a_container():
    score = lambda s, title="none": A.content_score(A._View(A._Tree(f"<div>{s}</div>"), 0), 0, title)
    text = "Words of a sentence. " * 30
    assert score("short") == 0 and score(f"<p>{text}</p>") == pytest.approx(2 + len(text.strip()) / 500 + 3)
    assert score(f"<p>{text}</p>", "A SENTENCE") == pytest.approx(score(f"<p>{text}</p>") + 5)
    long = (text * 4).strip()
    assert score(long + " follow us, share this") == pytest.approx(score(long) - 6 + 22 / 500) and score(long + "<a>x</a>" * 21) == pytest.approx(score(long) - 5 + 21 / 500)


def test_choice_between_methods(spark):
    long, poor = LONG * 3, "recent posts and related posts " * 9
    rows = [
        (1, long, "", "", "", ""), (2, "tiny", long, LONG, "", ""), (3, "tiny", "", poor, poor + "x", ""), (4, poor * 2, "", poor, "", ""), (5, "tiny", "no", "", "", ""), (6, None, None, None, None, None), (7, "tiny", LONG, LONG, LONG, LONG),
    ]
    df = spark.createDataFrame(rows, "id int, basic string, title_based string, density_based string, filtered_text string, longest_block string")
    found = {r["id"]: (r["method"], r["quality"]) for r in A.chosen_article(df, F.lit(None).cast("string"), None).collect()}
    assert found == {1: ("basic", "good"), 2: ("title_based", "good"), 3: ("basic", "too_short"), 4: ("basic", "sidebar"), 5: ("basic", "too_short"), 6: ("basic", "too_short"), 7: ("title_based", "good")}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "</div></p><p>" + "<div>" * 400), (4, "u", "x" * 300_000), (4, "u", "x" * 300_000)]
    found = A.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 5 and all(r["n_chars"] == len(r["text"]) and r["quality"] for r in found)
    assert A.extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """Each holds one article, whose title and paragraphs of more than 20 characters make the text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = A.extract_articles(pages).collect()
    assert len(rows) == len(sources)
    boiler = re.compile("accept all cookies|privacy policy|terms of service|advertisement|subscribe now", re.I)
    for r in rows:
        inside = re.search(r"<article><h1>(.*?)</h1>(.*)</article>", sources[r["page_id"]], re.S)
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?p>", inside[2])]
        text = " ".join([html.unescape(inside[1]), *(b for b in blocks if len(b.strip()) > 20)])
        assert (r["text"], r["method"]) == (boiler.sub("", plain(text)).strip(), "basic") or r["quality"] != "good"


def test_texts_are_judged_by_one_expression(spark):
    plan = A.extract_articles(spark.createDataFrame([(1, "http://a/b", "<p>x</p>")], "page_id long, url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("recommended for you") == 1
