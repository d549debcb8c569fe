"""Main text: golden pages of the parser, held-out layouts, the decoding's best choice by brute force, the given pages, odd rows."""

import html
import itertools
import re

import numpy as np
import pytest
from conftest import SF

from presslight.llm import dom, htmltext


@pytest.fixture(scope="module")
def model():
    return htmltext.fit()


def runs(source):
    page = dom.parse(source)
    assert all(p < i < e <= len(page.tag) for i, (p, e) in enumerate(zip(page.parent, page.end)))
    return [t for t, kind in zip(page.text, page.tag) if kind == "run"]


def test_parser_on_golden_pages():
    assert runs("<p>a <b>b</b>\n\tc<p>d &amp; e&nbsp;&#233;<br>f</p>g") == ["a b c", "d & e é f", "g"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert runs("<script>var t='</p>'; x<y</script>a<!-- <p>b --><style>p{}</style>c<title>t</title>") == ["ac"]
    assert runs("1 < 2 and 3 > 2 <3 </> &notanentity; <a href='x>y'>z</a>") == ["1 < 2 and 3 > 2 <3 </> ¬anentity; z"]
    assert runs("<script>never ends <p>x") == [] and runs("") == [] and runs("<div>") == [] and runs("</p></div>x") == ["x"]
    assert runs("<div " + "a" * 100_000 + "='\"x>y") == ["y"]
    assert runs("<div>" * 3000 + "deep") == ["deep"]
    assert dom.attribute_tokens(' class="post-content mainBody" id=x1 hidden style="display: none"') == ("post", "content", "main", "body", "hidden")


def test_held_out_layouts(model):
    right = kept = main = exact = 0
    for seed in range(50_000, 50_200):
        laid = htmltext.Layout(seed)
        page = dom.parse(laid.html)
        found = set(htmltext.kept_runs(page, model.log_odds(dom.features([page], model.tokens))))
        places = [i for i, t in enumerate(page.tag) if t == "run"]
        assert len(places) == len(laid.marks)
        wanted = {i for i, m in zip(places, laid.marks) if m}
        right, kept, main, exact = right + len(found & wanted), kept + len(found), main + len(wanted), exact + (found == wanted)
    assert right / kept > 0.97 and right / main > 0.94 and exact >= 160


def test_features_do_not_depend_on_the_batch(model):
    pages = [dom.parse(htmltext.Layout(s).html) for s in (1, 2, 3)] + [dom.parse("")]
    alone = np.concatenate([dom.features([p], model.tokens) for p in pages])
    assert np.array_equal(dom.features(pages, model.tokens), alone)


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 10))
        page = dom.Page(parent=[-1, *(int(rng.integers(0, i)) for i in range(1, n))], tag=["run"] * n)
        odds = rng.normal(0, 3, n).round(2)
        held = np.clip(odds, -htmltext.MOST, htmltext.MOST)
        sound = [c for c in itertools.product((0, 1), repeat=n) if all(not c[i] or i == 0 or c[page.parent[i]] for i in range(n))]
        best = max(sum(x * y for x, y in zip(c, held)) for c in sound)
        found = htmltext.kept_runs(page, odds)
        assert tuple(int(i in found) for i in range(n)) in sound and sum(held[found]) == pytest.approx(best)


def test_given_pages(spark):
    """Each given page holds its text in one <article> of headings and paragraphs."""
    rows = htmltext.op11_html_extraction(spark, SF).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(sources)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.S)[1]
        blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>", inside))
        text = "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert (r["text"], r["n_chars"]) == (text, len(text))


def test_odd_rows_and_empty_table(spark, model):
    words = "word " * 200_000
    rows = [(1, None, 5), (1, None, 5), (2, "", 6), (3, "plain words only", 7), (None, f"<article><p>{words}<p>end</article><nav><a>x</a></nav>", 8), (4, "<nav><ul><li><a href=x>Menu</a></ul></nav>", 9)]
    df = spark.createDataFrame(rows, "page_id long, html string, depth int")
    found = htmltext.extract_main_text(df, model).collect()
    assert len(found) == 6 and [(r["page_id"], r["depth"]) for r in found] == [(a, c) for a, _, c in rows]
    texts = [r["text"] for r in found]
    assert texts[:3] == ["", "", ""] and texts[4] == f"{words.strip()}\n\nend" and texts[5] == ""
    assert htmltext.extract_main_text(df.limit(0), model).collect() == []
