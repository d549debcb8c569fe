import datetime as dt

import pytest
from pyspark.sql import functions as F

from presslight.functions import dates as D
from presslight.functions import pages as P
from presslight.functions import scores as S
from presslight.functions import text as T
from presslight.functions import urls as U
from presslight.operators import joins as J
from presslight.operators import monitor as M
from presslight.operators import queues as Q
from presslight.operators import state as St
from presslight.operators import windows as X
from presslight.sources import readers as R


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "published, start, platform, url, expected",
    [
        ("2025-06-01", "2025-05-01", "web", None, "ok"),
        ("2025-04-02", "2025-05-01", "web", None, "ok"),
        ("2025-03-01", "2025-05-01", "web", None, "before_window"),
        ("2025-12-15", "2025-05-01", "web", None, "future"),
        ("2025-06-20", "2024-05-01", "web", None, "after_window"),
        ("2022-06-01", "2022-05-01", "web", None, "too_old"),
        (None, "2025-05-01", "youtube", "https://youtu.be/abcdef", "ok_undated"),
        (None, "2025-05-01", "tiktok", "https://t.com/2020/x", "old_url"),
        (None, "2025-05-01", "youtube", "https://t.com/2022/x", "ok_undated"),
        (None, "2025-05-01", "youtube", "https://Archive.org/x", "old_url"),
        (None, "2025-05-01", "instagram", None, "ok_undated"),
        (None, "2025-05-01", "web", "https://a.com/2020/x", "old_url"),
        (None, "2025-05-01", "web", "https://a.com/x", "undated"),
        (None, "2025-05-01", "radio", None, "unknown_type"),
    ],
)
def test_date_window(spark, published, start, platform, url, expected):
    df = spark.createDataFrame([(published and dt.date.fromisoformat(published), dt.date.fromisoformat(start), platform, url)], "published date, start_date date, platform string, url string")
    row = D.date_acceptance(df, "2025-07-01").first()
    assert (row["reason"], row["accepted"]) == (expected, expected.startswith("ok"))


@pytest.mark.parametrize(
    "model, base, trim",
    [("MX-5 Miata Club RF", "MX-5 Miata", "Club RF"), ("Camry XLE", "Camry", "XLE"), ("F-150 Raptor Crew Cab", "F-150", "Raptor Crew Cab"), ("Civic", "Civic", None), ("Accord QX", "Accord", "QX"), ("", "", None)],
)
def test_trims(spark, model, base, trim):
    row = S.split_trim(spark.createDataFrame([(model,)], "model string")).first()
    assert (row["base_model"], row["trim_level"]) == (base, trim)


@pytest.mark.parametrize(
    "make, model, base, trim",
    [("Mazda", "MX-5 Miata RF", "MX-5 Miata", "RF"), ("mazda", "MX-5", "MX-5 Miata", "MX-5"), ("Mazda", "MX-5 Miata", "MX-5 Miata", None), ("Mazda", "CX-90 Premium Plus", "CX-90", "Premium Plus"), ("Mazda", "CX-5", "CX-5", None), ("Honda", "Accord EX-L", "Accord", "EX-L"), ("Ford", "Bronco Sport Big Bend", "Bronco Sport Big Bend", None), ("Ford", "Bronco Big Bend", "Bronco", "Big Bend"), ("Kia", "EV6 GT-L", "EV6", "GT-L"), ("Honda", "Sport", "Sport", None)],
)
def test_trims_of_makes(spark, make, model, base, trim):
    row = S.split_trim(spark.createDataFrame([(make, model)], "make string, model string"), make=F.col("make")).first()
    assert (row["base_model"], row["trim_level"]) == (base, trim)


@pytest.mark.parametrize(
    "url, make, model, author, points",
    [
        ("https://a.com/2025/mazda-cx-5-review", "Mazda", "CX-5", None, 160),
        ("https://a.com/mazda-cx-90-drive", "Mazda", "CX-5", None, 0),
        ("https://a.com/mazda-cx-50-drive", "Mazda", "CX-5", None, 130),
        ("https://a.com/honda/civic-road-test-by-lee", "Honda", "Civic", "Ann Lee", 110),
        ("https://a.com/toyota-or-civic", "Honda", "Civic", "", 0),
        ("https://a.com/bmw-honda-civic", "Honda", "Civic", None, 20),
        (None, "Honda", "Civic", None, 0),
    ],
)
def test_url_points(spark, url, make, model, author, points):
    assert S.score_url(spark.createDataFrame([(url, make, model, author)], "url string, make string, model string, author string")).first()["url_score"] == points


@pytest.mark.parametrize(
    "url, article, old",
    [
        ("https://a.com/2025/05/civic-review", True, False),
        ("https://a.com/2023/05/civic-review", True, True),
        ("https://a.com/2022-civic-review", True, True),
        ("https://a.com/civic-review-2021-limited", True, True),
        ("https://a.com/1999-in-cars", True, True),
        ("https://a.com/2025/a/2019-b", True, True),
        ("https://a.com/Search?q=civic", False, False),
        ("https://a.com/tags/civic", False, False),
        ("https://a.com/x/photo.PNG", False, False),
        ("https://a.com/login?next=/feed", True, False),
        ("", False, False),
        (None, False, False),
    ],
)
def test_article_and_old_urls(spark, url, article, old):
    row = spark.createDataFrame([(url,)], "url string").select(U.is_article_url(F.col("url")).alias("article"), U.is_old_url(F.col("url"), "2025-07-01").alias("old")).first()
    assert (row["article"], row["old"]) == (article, old)


def test_text_verdicts(spark):
    long = "The new car drives well on every road that we tried, and its seats held us for hours. " * 4
    rows = [
        (long, "VW Jetta", "https://a.com/x", "off_topic"),
        (long + "A Jetta.", "VW Jetta", "https://a.com/x", "good"),
        (long, "Car", "https://a.com/x", "good"),
        (long[:150], "", "https://a.com/x", "too_short"),
        (long[:150], "", "https://www.spotlightepnews.com/x", "good"),
        (long + "Recent posts. Follow us.", "", "https://a.com/x", "sidebar"),
        (long + "Next page last: NextPageLast, email more more: EmailMoreMore", "", "https://a.com/x", "navigation"),
        ("A short line of a menu, no more\n" * 9, "", "https://a.com/x", "fragmented"),
        (None, "", "https://a.com/x", "too_short"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, topic string, url string, expected string")
    for r in T.content_quality(df, "text", F.col("topic"), F.col("url")).collect():
        assert r["quality_verdict"] == r["expected"], r
    said = spark.createDataFrame([("Read \u00a0 more.\n\nPrivacy Policy Good  car ADVERTISEMENT",)], "t string").select(T.clean_text(F.col("t")).alias("t")).first()
    assert said["t"] == "Read more.  Good car"


@pytest.mark.parametrize(
    "text, language",
    [
        ("el coche de la prensa no es nuevo", "en"),
        ("el coche de la prensa no es nuevo y se conduce bien en la ciudad", "es"),
        ("Tous les jours il est bon d'avoir raison avec le temps et à propos", "fr"),
        ("The quick brown fox jumps over that lazy dog with much joy today", "en"),
        ("\u0633\u064a\u0627\u0631\u0629 " * 12, "ar"),
        ("x" * 2000 + " el coche de la prensa no es nuevo y se conduce bien", "en"),
        (None, "en"),
    ],
)
def test_languages(spark, text, language):
    assert spark.createDataFrame([(text,)], "t string").select(T.detect_language(F.col("t")).alias("l")).first()["l"] == language


@pytest.mark.parametrize(
    "title, model, expected",
    [("2025 hyundai kona limited", "kona limited awd", True), ("the 2025 honda accord touring is a blissful hybrid sedan", "accord hybrid touring", True), ("the mazda cx-50 2.5 turbo review", "cx-50 turbo", True), ("the mazda cx-5 review", "cx-50", False), ("a boat", "civic", False)],
)
def test_title_match(spark, title, model, expected):
    assert S.title_match(spark.createDataFrame([(title, model)], "title string, model string")).first()["matched"] is expected


def test_model_variations(spark):
    rows = {r["variation"] for r in S.model_variations(spark.createDataFrame([("Lexus", "ES 350")], "make string, model string")).collect()}
    assert {"es 350", "es350", "es-350", "lexus es 350", "lexus es350"} <= rows


def test_relative_dates(spark):
    at = lambda text: one(spark, D.parse_relative_date(F.lit(text), "2025-07-10"))
    assert at("3 days ago") == dt.datetime(2025, 7, 7)
    assert at("a week ago") == dt.datetime(2025, 7, 3)
    assert at("Premiered 2 months ago") == dt.datetime(2025, 5, 11)
    assert at("yesterday") == dt.datetime(2025, 7, 9, 12)
    assert at("soon") is None


def test_urls(spark):
    assert one(spark, U.domain(F.lit("https://WWW.Site.com:80/a"))) == "site.com"
    assert one(spark, U.media_id(F.lit("https://youtu.be/abc_def-1"))) == "abc_def-1"
    assert one(spark, U.media_id(F.lit("https://a.com/"))) is None
    assert one(spark, U.is_index_url(F.lit("https://a.com/reviews/")))
    assert not one(spark, U.is_index_url(F.lit("https://a.com/cars/2024-kona-review")))
    assert one(spark, D.date_from_url(F.lit("https://a.com/2024/03/09/x"), "2025-01-01")) == dt.date(2024, 3, 9)
    assert one(spark, D.date_from_url(F.lit("https://a.com/2031/x/"), "2025-01-01")) is None
    assert one(spark, D.date_from_url(F.lit("https://a.com/2024/13/45/x"), "2025-01-01")) == dt.date(2024, 1, 1)


def test_text(spark):
    assert one(spark, T.mentions(F.lit("aaa"), F.lit(""))) == 0
    assert one(spark, T.mentions(F.lit("cx-5 and cx-50"), F.lit("cx-5"))) == 2
    assert one(spark, T.sentence_cut(F.lit("One two. Three four."), 10)) == "One two."
    assert one(spark, T.engagement_rate(F.lit(1), F.lit(1), F.lit(1), F.lit(0))) == 0
    df = spark.createDataFrame([("x ```json\n{\"a\": 1,}\n``` y",), ("no json",), (None,)], "t string")
    assert [r["repaired"] and r["repaired"]["a"] for r in T.repair_json(df, "t", "a int").collect()] == [1, None, None]


def test_social_score(spark):
    df = spark.createDataFrame([("Mazda", "CX-5", "Mazda CX-5 review", "look #mazda #cx-5 #cx5", "the mazda cx-5"), ("Mazda", "CX-5", None, None, None)], "make string, model string, title string, description string, transcript string")
    good, bad = S.social_score(df).collect()
    assert good["social_score"] >= 60 and good["confidence"] == "high"
    assert bad["social_score"] == 0 and bad["confidence"] == "none"


HTML = """<html><head><title>T</title><meta name="author" content="Pat Doe"><script type="application/ld+json">{"datePublished": "2025-02-03"}</script></head>
<body><nav><p>A navigation paragraph that is long enough</p></nav><div class="ad"><p>Buy this product now, it is very cheap</p></div>
<article><h1>Head</h1><p>First paragraph of the article, long enough.</p><p>Second paragraph <a href="/next">next</a> of the article.</p></article></body>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", HTML), (2, None, None), (3, "https://a.com/y", "plain <b>words</b>")], "page_id long, url string, html string")
    assert [(r["link"], r["anchor"], r["category"]) for r in P.extract_links(pages).collect()] == [("https://a.com/next", "next", "article")]
    assert {r["page_id"]: r["byline"] for r in P.extract_bylines(pages).collect()} == {1: "Pat Doe", 2: None, 3: None}
    assert {r["page_id"]: r["page_date"] for r in P.page_date(pages, "2025-07-01").collect()} == {1: dt.date(2025, 2, 3), 2: None, 3: None}


def test_articles_after_many_links(spark):
    menu = "".join(f'<a href="https://other{k}.com/">o</a>' for k in range(150)) + '<a href="https://youtu.be/abc">v</a><a href="/tag/x">t</a><a href="/a.PDF">f</a>'
    plain = "".join(f'<a href="/p{k}">p</a>' for k in range(120))
    html = f'<body>{menu}{plain}<h2><a href="/p119">P 119</a></h2><a href="https://blog.a.com/review/kona">Kona</a><div class="big post"><a href="/kona">K</a></div></body>'
    pages = spark.createDataFrame([(1, "https://a.com/index", html)], "page_id long, url string, html string")
    got = [(r["position"], r["link"], r["anchor"]) for r in P.extract_links(pages).orderBy("position").collect()]
    assert got[:3] == [(1, "https://blog.a.com/review/kona", "Kona"), (2, "https://a.com/kona", "K"), (3, "https://a.com/p119", "P 119")]
    assert len(got) == 100 and got[3:] == [(k + 4, f"https://a.com/p{k}", "p") for k in range(97)]
    assert {r["category"]: r["links"] for r in P.link_counts(pages).collect()} == {"external": 150, "video": 1, "listing": 2, "article": 122}


OEM = "The 2025 CX-50 is a crossover. Designed for active families. It competes with Honda CR-V and Toyota RAV4.\nPURCHASE REASONS:\n" + "".join(f"- Reason {k}\n" for k in range(12)) + """Text
KEY FEATURES:
1. Turbo engine
- Heated seats
• 10.25-inch display
- Cargo space
None of these: premium, durable. It has a panoramic moonroof and a 10.25-inch display."""


def test_oem_text(spark):
    docs = spark.createDataFrame([(1, OEM), (2, "Plain."), (3, None)], "doc_id long, text string")
    rows = P.parse_oem_text(docs, 2024).orderBy("doc_id", "position").collect()
    assert [(r["position"], r["feature"], r["category"], r["priority"]) for r in rows if r["doc_id"] == 1] == [
        (1, "Turbo engine", "performance", "primary"), (2, "Heated seats", "design", "primary"), (3, "10.25-inch display", "technology", "primary"),
        (4, "Cargo space", "utility", "secondary"), (5, "panoramic moonroof", "design", "secondary"),
    ]
    assert [(r["doc_id"], r["year"], r["feature"]) for r in rows if r["doc_id"] != 1] == [(2, 2024, None), (3, 2024, None)]
    got = P.parse_oem_messages(docs).orderBy("doc_id").first()
    assert (got["target_audience"], got["purchase_reasons"]) == ("active families", [f"reason {k}" for k in range(12)])
    assert (got["brand_attributes"], got["competitors"]) == (["premium", "reliable"], ["Honda CR-V", "Toyota RAV4"])


def test_post_totals_and_shares(spark):
    posts = spark.createDataFrame([("x", "TikTok", 10, 1, 1, 0), ("x", "TikTok", 20, 2, 0, 0), ("y", "YouTube", None, 0, 0, 5), ("z", None, 2, 1, 0, 0)], "creator string, platform string, impressions long, engagements long, likes long, comments long")
    assert tuple(M.post_totals(posts).first()) == (4, 32, 4, 1, 5, 8.0, 1.0)
    assert tuple(M.post_totals(posts.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)
    assert [tuple(r) for r in M.post_shares(posts, "platform").collect()] == [("TikTok", 2, 50.0), ("Unknown", 1, 25.0), ("YouTube", 1, 25.0)]
    assert [tuple(r) for r in M.post_shares(posts, "creator", 1).collect()] == [("x", 2, 50.0)]


def test_embedded_states(spark):
    texts = [
        '<script>window.__INITIAL_STATE__ = {"a": {"b": "}; </b>"}}; boot();</script><p>x</p><script>window.B = {"c": 1};</script>',
        '<script id="n">__NEXT_DATA__ = {"d": [1, 2,], "e": 3,}\n;run({})</script>',
        '<script>window.C = {no: json}; var x = {"f": "window.D = {}"}; window.E = {"g": NaN}; window.F = {"open": 1</script>',
        "<p>none</p>",
        None,
    ]
    got = P.embedded_json(spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, '{"a": {"b": "}; </b>"}}'), (0, 1, '{"c": 1}'), (1, 0, '{"d": [1, 2], "e": 3}'), (2, 1, '{"f": "window.D = {}"}')]


def test_merge_and_best(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k long, v string, n int")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 1)], "k long, v string, n int")
    assert sorted(map(tuple, J.merge_by_key(base, new, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
    assert X.keep_best(base, ["v"], [F.asc("k")]).count() == 2
    assert X.skip_limit(base, ["k"], 5).count() == 2 and X.skip_limit(base, ["k"], 1).count() == 1
    assert Q.filter_loans(base.withColumn("office", F.lit("x")).withColumn("start_date", F.lit(None).cast("date")), office="All offices", date_from="2020-01-01").count() == 0


def test_attempts(spark):
    tracking = spark.createDataFrame([(1, "searching", dt.date(2025, 1, 1), 2, None)], "wo_number long, status string, last_attempt_date date, attempt_count int, retry_after date")
    tries = spark.createDataFrame([(1, "timeout", dt.date(2025, 1, 2)), (1, "success", dt.date(2025, 1, 3)), (2, "no_content", dt.date(2025, 1, 3))], "wo_number long, result string, at date")
    rows = {r["wo_number"]: r for r in St.apply_attempts(tracking, tries).collect()}
    assert (rows[1]["status"], rows[1]["attempt_count"], rows[1]["retry_after"]) == ("found", 4, None)
    assert (rows[2]["status"], rows[2]["attempt_count"], rows[2]["retry_after"]) == ("searching", 1, dt.date(2025, 1, 7))


def test_encoding_of_whole_files(spark, tmp_path):
    row = "1,plain words of a row\n"
    many = "id,name\n" + row * ((1 << 20) // len(row) + 1)
    (tmp_path / "late.csv").write_bytes((many + "2,café\n").encode("latin1"))
    ascii_part = "id,name\n" + row * 40000
    cut = ascii_part + "2," + "x" * ((1 << 20) - len(ascii_part) - 3) + "é\n3,é\n"
    (tmp_path / "cut.csv").write_bytes(cut.encode())
    assert cut.encode()[: 1 << 20][-1:] == "é".encode()[:1]
    for file, encoding, found in (("late", "latin1", {"café"}), ("cut", "utf-8", {"é"})):
        path = f"file://{tmp_path}/{file}.csv"
        assert R.encoding_of(spark, path) == encoding
        rows = R.read_csv_any_encoding(spark, path).filter("id <> '1' AND length(name) < 9").collect()
        assert {r["name"] for r in rows} == found


def test_required_columns(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿WO #,Model,Links\n\"1,024\",Kona,http://a.com\n")
    with pytest.raises(ValueError, match="Make"):
        R.read_loans(spark, f"file://{tmp_path}/l.csv")
    (tmp_path / "m.csv").write_text("﻿WO #, Make ,Model,Links\n\"1,024\",Hyundai,Kona,http://a.com\n")
    row = R.read_loans(spark, f"file://{tmp_path}/m.csv").first()
    assert (row["wo_number"], row["make"], row["model"], row["links"]) == ("1024", "Hyundai", "Kona", "http://a.com")


@pytest.mark.parametrize("title, snippet, model, author, score", [
    ("2025 Kona N Review", "https://a.com/review/kona 2 days ago", "Kona N", None, 200 + 100 + 50 + 10),
    ("Kona", "", "Kona N Line", "", -50), ("Kona N first drive and road test", "x", "Kona N Line Ultimate", None, -50 + 100), ("a b c", "", "a b c d", None, 30), ("a b c d", "", 'a "b c d"', None, 100),
    ("By Doe", "doe", None, "Pat Doe", 75), ("x", "by pat", None, "Pat Doe", 50), ("Kona MSRP", "compare specifications", None, None, -450), ("x", "Related posts. More stories", None, None, -100),
    ("Jetta beats Mustang and BMW", "", "Jetta", None, 100 - 400), ("x", "y" * 201, None, None, 15), (None, None, None, None, 0), (None, None, "Kona", "Doe", -50),
])
def test_search_result_points(spark, title, snippet, model, author, score):
    df = spark.createDataFrame([(title, snippet, model, author)], "title string, snippet string, model string, author string")
    assert S.score_search_results(df).first()["search_score"] == score


def test_job_durations_and_totals(spark):
    runs = spark.createDataFrame(
        [("a", "completed", 10, 6, 3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 2, 5), "u"), ("b", "failed", 5, None, 9, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 7), None), ("c", "running", None, None, None, dt.datetime(2024, 1, 1), None, "u"), ("d", "queued", 1, 0, 0, None, None, None), ("e", "other", 1, 0, 0, None, None, "v")],
        "run_id string, run_status string, total_records int, successful_finds int, failed_attempts int, start_time timestamp, end_time timestamp, created_by string",
    )
    found = {r["run_id"]: tuple(r)[2:] for r in M.job_durations(runs).collect()}
    assert found == {"a": (10, 6, 3, 1, 3, "2h 5m", "u"), "b": (5, 0, 9, 0, 9, "7s", "System"), "c": (0, 0, 0, 0, 0, "Running", "u"), "d": (1, 0, 0, 1, 0, "Queued", "System"), "e": (1, 0, 0, 1, 0, "N/A", "v")}
    totals = {r["run_status"]: tuple(r)[1:] for r in M.job_totals(runs).collect()}
    assert totals["all"] == (5, 3, 50.0) and totals["completed"] == (1, 1, 100.0) and totals["running"] == (1, 1, 0.0) and len(totals) == 6


def test_post_breakdown(spark):
    posts = spark.createDataFrame([("A", "x", 10, 1), ("A", None, None, 3), (None, "x", 20, None)], "platform string, creator string, impressions long, engagements long")
    found = {(r["level"], r["name"]): tuple(r)[2:] for r in M.post_breakdown(posts).collect()}
    assert found == {("all", ""): (3, 30, 4, 10.0, 1.3333, 100.0), ("platform", "A"): (2, 10, 4, 5.0, 2.0, 66.67), ("platform", "Unknown"): (1, 20, 0, 20.0, 0.0, 33.33), ("creator", "x"): (2, 30, 1, 15.0, 0.5, 66.67), ("creator", "Unknown"): (1, 0, 3, 0.0, 3.0, 33.33)}


def test_pullthrough_of_all_kinds(spark):
    from presslight.operators import sentiment as Se

    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    intended = make([("A", "feature", "Cargo room"), ("A", "feature", "moonroof"), ("A", "attribute", "Bold"), ("A", "driver", "price/deal"), ("A", "driver", "range"), ("B", "feature", "x"), ("A", "driver", "")], "make string, kind string, item string")
    said = make([("A", 1, "feature", "big trunk space"), ("A", 1, "feature", "Moonroof glass"), ("A", 1, "attribute", "trunk space"), ("A", 1, "driver", "real affordability"), ("A", 2, "attribute", "a bold one"), ("A", 2, "driver", None), ("B", 3, "driver", "affordability")], "make string, review int, kind string, item string")
    reviews = make([("A", 1), ("A", 2), ("B", 3), ("B", 3)], "make string, review int")
    synonyms = make([("feature", "cargo", "cargo"), ("feature", "cargo", "trunk space")], "kind string, group string, term string")
    found = {(r["review"], r["kind"]): tuple(r)[3:] for r in Se.pullthrough_kinds(intended, said, reviews, synonyms).collect()}
    assert found == {
        (1, "feature"): (2, 2, 100.0), (1, "attribute"): (1, 0, 0.0), (1, "driver"): (2, 1, 50.0), (1, "overall"): (5, 3, 50.0), (2, "feature"): (2, 0, 0.0), (2, "attribute"): (1, 1, 100.0), (2, "driver"): (2, 0, 0.0), (2, "overall"): (5, 1, 33.3333),
        (3, "feature"): (1, 0, 0.0), (3, "attribute"): (0, 0, 0.0), (3, "driver"): (0, 0, 0.0), (3, "overall"): (1, 0, 0.0),
    }


@pytest.mark.parametrize("details, urls", [
    (None, "No URLs processed"), ("", "No URLs processed"), (" ; x: http://a", "No URLs found"), ("https://a.com/x:8: gone; http://b.com ;ftp://c; https://d.com/?q=a: b: c", "https://a.com/x:8\nhttp://b.com\nhttps://d.com/?q=a"),
])
def test_searched_urls(spark, details, urls):
    assert spark.createDataFrame([(details,)], "d string").select(U.searched_urls(F.col("d"))).first()[0] == urls


def test_outlets_are_looked_up_by_host(spark):
    outlets = spark.createDataFrame(
        [(1, 7, "Seven", "http://a.com"), (1, 3, "Three", "http://www.A.com/x"), (1, 2, "Two", "http://b.a.com"), (1, 9, None, "http://c.com"), (1, 5, "None", "no url"), (2, 1, "Other", "http://z.com"), (None, 1, "Nobody's", "http://a.com")],
        "person_id int, outlet_id int, outlet_name string, outlet_url string",
    )
    urls = [(1, "http://a.com/1"), (1, "http://x.b.a.com"), (1, "http://ba.com"), (1, "http://c.com"), (1, None), (1, "http://a.com/1"), (2, "http://a.com"), (3, "http://a.com"), (None, "http://a.com"), (None, None)]
    out = U.authorised_urls(spark.createDataFrame(urls, "person_id int, url string"), outlets)
    not_from, missing = "Not from authorized outlets", "Person not in mapping"
    expected = [(1, "http://a.com/1", True, "Three")] * 2 + [(1, "http://x.b.a.com", True, "Two"), (1, "http://ba.com", False, not_from), (1, "http://c.com", True, not_from), (1, None, False, not_from), (2, "http://a.com", False, not_from)]
    expected += [(3, "http://a.com", True, missing), (None, "http://a.com", True, "No person_id provided"), (None, None, True, "No person_id provided")]
    assert sorted(map(repr, map(tuple, out.select("person_id", "url", "allowed", "reason").collect()))) == sorted(map(repr, expected))
    # a person's outlets are never held together, so that a row costs no look at each of them
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_text_of_a_link_is_made_once(spark):
    links = spark.createDataFrame([(1, "Mazda", "CX-5 Sport", "http://a.com/mazda/cx_5-sport/"), (2, "Mazda", "CX-5 Sport", "http://a.com/other"), (3, "Mazda", "CX-5 Sport", None)], "id int, make string, model string, url string")
    out = S.link_tier_score(links, S.model_variations(links))
    assert "_text" not in out.columns and {r["id"]: r["tier_score"] for r in out.collect()} == {1: 1000, 2: 0, 3: 0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


@pytest.mark.parametrize("name", ["aggregate_features", "aggregate_attributes", "aggregate_drivers"])
def test_sentiment_documents_are_parsed_once(spark, name):
    from presslight.operators import sentiment as Se

    clips = spark.createDataFrame([("{}",), ("broken",), (None,)], "sentiment_json string")
    df = getattr(Se, name)(clips)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 and df.count() == 0


def test_pullthrough_of_a_model(spark):
    from presslight.operators import sentiment as Se

    i = [("A", "feature", " Cold plate", 2), ("A", "feature", "old", 1), ("A", "feature", "gear", 3), ("A", "attribute", "bold", 1), ("A", "attribute", "Bold look", 2), ("A", "driver", "price", 1), ("B", "driver", "price", 1), ("C", "feature", "x", 1)]
    intended = spark.createDataFrame(i, "make string, kind string, item string, position int")
    s = [
        ("A", n, "overall", None, sentiment) for n, sentiment in ((1, "Positive"), (2, "neutral"), (2, "negative"), (3, None), (4, "mixed"), (5, "positive"), (6, "positive"), (7, "neutral"), (8, "neutral"), (9, "x"), (10, "positive"))
    ] + [
        ("A", 1, "feature", "the cold plate", "positive"), ("A", 1, "feature", "cold", "negative"), ("A", 2, "feature", "GEAR ", None), ("A", 3, "feature", "gears", "neutral"), ("A", 4, "feature", "", "positive"), ("A", 4, "feature", None, "positive"),
        ("A", 4, "attribute", "a bold look", "REINFORCED"), ("A", 5, "attribute", "bold", "challenged"), ("A", 5, "driver", "Price", "negative"), ("A", 5, "driver", "price of it", None), ("D", 1, "overall", None, "positive"),
        ("B", 7, "overall", None, "negative"), ("B", 7, "driver", "low price", "Positive"),
    ]
    # a row of its review for each, arrays empty or null where it says nothing
    row = lambda make, n, kind, item, sentiment: (make, n, sentiment, *[None] * 3) if kind == "overall" else (make, n, None, *([(item, sentiment)] if kind == x else [] for x in Se.KINDS))
    items = "array<struct<item: string, sentiment: string>>"
    reviews = spark.createDataFrame([row(*x) for x in s], f"make string, review int, sentiment string, features {items}, attributes {items}, drivers {items}")
    found = lambda i: {r["make"]: r.asDict() for r in Se.pullthrough_model(i, reviews).collect()}
    rows = found(intended)
    assert set(rows) == {"A", "B", "C"}
    # cold touches two intended features and counts for the first in their list; gear is said in two reviews of ten, old in one
    assert rows["A"] == {"make": "A", "n_reviews": 10, "features_pct": 66.6667, "consistency_pct": 33.3333, "attributes_pct": 100.0, "drivers_pct": 0.0, "positive_pct": 40.0, "neutral_pct": 20.0, "negative_pct": 10.0, "alignment_pct": 55.556}
    assert rows["B"] == {"make": "B", "n_reviews": 1, "features_pct": 0.0, "consistency_pct": 0.0, "attributes_pct": 0.0, "drivers_pct": 100.0, "positive_pct": 0.0, "neutral_pct": 0.0, "negative_pct": 100.0, "alignment_pct": 33.333}
    assert rows["C"]["n_reviews"] == rows["C"]["features_pct"] == rows["C"]["positive_pct"] == 0
    other = found(intended.withColumn("position", -F.col("position")))["A"]  # the cold plate before old: old is not said
    assert other["features_pct"] == 66.6667 and other["consistency_pct"] == 33.3333
    assert found(intended.drop("position"))["A"] == other


def test_pullthrough_counts_all_that_is_said(spark):
    from conftest import SF

    from presslight.plans import registry

    # every candidate says something, whatever its relevance and price, so all of a make's names are mentioned
    found = registry.QUERIES["AG-14"](spark, SF).agg(F.min("features_pct"), F.min("attributes_pct"), F.min(F.col("positive_pct") + F.col("neutral_pct") + F.col("negative_pct"))).first()
    assert found[0] == 100.0 and found[1] > 80.0 and found[2] > 99.999
