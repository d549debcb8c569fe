"""SC, SK, UD queries and the flagship: files written from the bound tables and read again, and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import articles as A
from ...functions import dates as D
from ...functions import pages as P
from ...functions import text as T
from ...functions.scores import pre_relevance
from ...operators import monitor as M
from ...operators import state as St
from ...operators.windows import best_clip
from ...sources import readers as R
from ...sources import writers as Wr
from ...sources.scratch import scratch
from ...sources.versions import VersionedTables
from ..bindings import AS_OF, bind, duck
from ..registry import QUERIES, SQL, query


def _path(df, name):
    return scratch(df.sparkSession, name)


def _loan_rows(l):
    return l.select(F.format_number("wo_number", 0).alias("WO #"), F.col("office").alias(" Make "), F.col("contact").alias("Model"), F.when(F.col("wo_number") % 2 == 0, F.upper("contact")).alias("Model Short Name"), F.concat(F.lit("http://a.com/"), "wo_number").alias("Links"))


@query("SC-01", "b_loan", sql="SELECT CAST(wo_number AS STRING) AS wo_number, office AS make, CASE WHEN wo_number % 2 = 0 THEN upper(contact) ELSE contact END AS model, concat('http://a.com/', wo_number) AS links FROM b_loan")
def _sc01(l):
    _loan_rows(l).write.option("header", True).csv(path := _path(l, "loans"))
    return R.read_loans(l.sparkSession, path).select("wo_number", "make", "model", "links")


@query("SC-02", "b_loan", sql="SELECT wo_number, concat('é', contact) AS contact FROM b_loan")
def _sc02(l):
    l.select("wo_number", F.concat(F.lit("é"), "contact").alias("contact")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path := _path(l, "latin"))
    return R.read_csv_any_encoding(l.sparkSession, path).select(F.col("wo_number").cast("long").alias("wo_number"), "contact")


@query("SC-03", "b_loan", sql="SELECT 'good' AS kind, CAST(wo_number AS STRING) AS wo FROM b_loan WHERE wo_number % 10 <> 0 UNION ALL SELECT 'bad', concat('broken,', wo_number) FROM b_loan WHERE wo_number % 10 = 0")
def _sc03(l):
    good = F.concat_ws(",", *(F.lit(c) for c in "abcd"), F.col("wo_number").cast("string"), *(F.lit(c) for c in "efghijk"))
    l.select(F.when(F.col("wo_number") % 10 != 0, good).otherwise(F.concat(F.lit("broken,"), "wo_number"))).write.text(path := _path(l, "feed"))
    rows, bad = R.read_loans_feed(l.sparkSession, path)
    return rows.select(F.lit("good").alias("kind"), F.col("`WO #`").alias("wo")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("line").alias("wo")))


@query("SC-04", "b_outlet", sql="SELECT person_id, reporter_name, outlet_id, outlet_name, outlet_url, impressions FROM b_outlet")
def _sc04(o):
    o.select("person_id", "reporter_name", "outlet_id", "outlet_name", "outlet_url", "impressions").write.csv(path := _path(o, "outlets"))
    return R.read_outlets(o.sparkSession, path)


@query("SC-05", "b_outlet", sql="SELECT concat('site', outlet_id, '.com') AS domain, outlet_name AS name FROM b_outlet WHERE outlet_id % 3 <> 0")
def _sc05(o):
    o.select(F.concat(F.lit("WWW.Site"), "outlet_id", F.lit(".com")).alias("domain"), F.col("outlet_name").alias("name"), (F.col("outlet_id") % 3 != 0).alias("active")).write.option("header", True).csv(path := _path(o, "sources"))
    return R.read_media_sources(o.sparkSession, path).select("domain", "name")


_NODE = "struct<id: string, contentUrl: string, network: string, contentType: string, creator: struct<fullName: string, primarySocialUsername: string>, account: struct<socialUsername: string>, publishedAt: string, text: string, combinedMetrics: struct<combinedImpressions: struct<value: long>, combinedEngagements: struct<value: long>, combinedLikes: struct<value: long>>, organicMetrics: struct<likes: long, comments: long>, thumbnailURL: string>"


def _posts(e):
    """Pages of posts in JSON, a page per worker."""
    node = F.struct(
        F.col("event_id").cast("string").alias("id"), F.lit("TikTok").alias("network"), F.struct(F.lit(None).cast("string").alias("fullName"), F.concat(F.lit("u"), "worker_id").alias("primarySocialUsername")).alias("creator"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("publishedAt"), F.concat(F.lit("a  b\n"), "level").alias("text"), F.struct(F.struct((F.col("event_id") % 1000).alias("value")).alias("combinedImpressions")).alias("combinedMetrics"),
        F.struct((F.col("event_id") % 7).alias("likes")).alias("organicMetrics"),
    )
    pages = e.groupBy("worker_id").agg(F.collect_list(F.struct(node.alias("node"))).alias("edges")).select(F.struct(F.struct("edges").alias("getPosts")).alias("data"))
    pages.write.json(path := _path(e, "posts"))
    return R.flatten_pages(e.sparkSession.read.schema(f"data struct<getPosts: struct<edges: array<struct<node: {_NODE}>>>>").json(path))


query("SC-06", "b_event", sql="SELECT CAST(event_id AS STRING) AS id, event_id % 1000 AS impressions FROM b_event")(lambda e: _posts(e).select("node.id", F.col("node.combinedMetrics.combinedImpressions.value").alias("impressions")))
query("SF-31", "b_event", sql="SELECT CAST(event_id AS STRING) AS post_id, concat('u', worker_id) AS creator_name, strftime(ts, '%Y-%m-%d') AS date, event_id % 1000 AS impressions, 0::BIGINT AS engagements, event_id % 7 AS likes, 0::BIGINT AS comments FROM b_event")(
    lambda e: T.flatten_post(_posts(e)).select("post_id", "creator_name", "date", "impressions", "engagements", "likes", "comments")
)


@query("SC-07", "b_clip", sql="SELECT wo_number, sentiment AS overall FROM b_clip WHERE sentiment IS NOT NULL")
def _sc07(c):
    c.filter("sentiment IS NOT NULL").select("wo_number", F.struct(F.struct(F.col("sentiment").alias("overall")).alias("sentiment_classification")).alias("doc")).write.json(path := _path(c, "sentiment"))
    read = c.sparkSession.read.schema("wo_number long, doc struct<sentiment_classification: struct<overall: string>>").json(path)
    return read.select("wo_number", "doc.sentiment_classification.overall")


@query("SC-08", "b_run", sql="SELECT 'object' AS kind, 'posts' AS keys, false AS large, true AS candidate, count(*) AS files FROM b_run")
def _sc08(r):
    r.select(F.to_json(F.struct(F.col("run_id").alias("posts"))), F.col("run_id").alias("part")).repartitionByRange("part").write.partitionBy("part").text(path := _path(r, "profile"))
    return R.profile_json_files(r.sparkSession, path + "/*").groupBy("kind", "keys", "large", "candidate").agg(F.count("*").alias("files"))


def _again(df, path, schema):
    return df.sparkSession.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query("SK-01", "b_clip", sql="SELECT wo_number, make, model, clip_url, relevance, sentiment, published_date, status FROM b_clip")
def _sk01(c):
    Wr.write_results_csv(c, path := _path(c, "results"))
    return _again(c, path, "wo_number long, make string, model string, clip_url string, relevance int, sentiment string, published_date date, status string")


@query("SK-02", "b_clip", sql="SELECT wo_number, make, model, 'low, \"relevance\"' AS reason, clip_url AS url_details FROM b_clip WHERE relevance < 3")
def _sk02(c):
    Wr.write_rejects_csv(c.filter("relevance < 3").select("wo_number", "make", "model", F.lit('low, "relevance"').alias("reason"), F.col("clip_url").alias("url_details")), path := _path(c, "rejects"))
    return _again(c, path, "wo_number long, make string, model string, reason string, url_details string")


@query("SK-03", "b_event", sql="SELECT CAST(event_id AS STRING) AS post_id, strftime(ts, '%Y-%m-%d') AS date, concat('a b ', level) AS caption FROM b_event")
def _sk03(e):
    Wr.write_posts_csv(T.flatten_post(_posts(e)), path := _path(e, "posts-csv"))
    return _again(e, path, "post_id string, post_url string, platform string, creator_name string, date string, caption string, impressions long").select("post_id", "date", "caption")


@query("SK-04", "b_clip", sql="SELECT wo_number AS work_order, contact AS byline, clip_url AS link, outlet_id AS publication, relevance AS relevance_score, sentiment FROM b_clip WHERE status = 'approved'")
def _sk04(c):
    Wr.export_clips_json(c.filter("status = 'approved'"), path := _path(c, "export"))
    return c.sparkSession.read.schema("work_order long, byline string, link string, publication long, relevance_score int, sentiment string").json(path)


@query("SK-05", "b_clip", sql="SELECT wo_number, make FROM b_clip WHERE relevance = 10 UNION ALL SELECT wo_number, make FROM b_clip WHERE relevance = 10")
def _sk05(c):
    rows = c.filter("relevance = 10").select("wo_number", "make")
    for fmt in ("csv", "json"):
        Wr.export_filtered(rows, _f := _path(c, fmt), fmt)
        rows_again = (_again(c, _f, "wo_number long, make string") if fmt == "csv" else rows_again.unionByName(c.sparkSession.read.schema("wo_number long, make string").json(_f)))
    return rows_again


@query("SK-06", "b_clip", sql="SELECT wo_number, CASE WHEN stage = 'rejected' THEN 'rejected' ELSE status END AS status FROM b_clip")
def _sk06(c):
    tables = VersionedTables(c.sparkSession, _path(c, "clips"))
    tables.publish(lambda old: {"clips": c.select("wo_number", "status")})
    Wr.upsert_version(tables, "clips", c.filter("stage = 'rejected'").select("wo_number", F.lit("rejected").alias("status")), ["wo_number"])
    tables.expire(keep=1)
    return tables.read("clips")


def _with_states(p):
    """The whole pages, with a state before the end of the head, statements after it, and a script whose object is no JSON."""
    name = F.when(F.col("page_id") % 2 == 0, "window.__INITIAL_STATE__").otherwise("__NEXT_DATA__")
    script = F.concat(F.lit("<script>"), name, F.lit(' = {"page": '), "page_id", F.lit("}; boot({});</script><script>window.B = {b: 1}; boot();</script>"))
    at = F.instr("html", "</head>")
    return p.select("page_id", F.concat(F.substring("html", F.lit(1), at - 1), script, F.substring("html", at, F.length("html"))).alias("html"))


query("UD-01", "pages")(lambda p: A.extract_articles(p))
query("UD-02", "pages")(lambda p: P.extract_links(p))
query("UD-02b", "pages")(lambda p: P.link_counts(p))
query("UD-03", "pages")(lambda p: P.extract_bylines(p))
query("SF-22", "pages")(lambda p: P.page_date(p, AS_OF))
query("SF-36", "pages", sql="SELECT page_id, 0 AS position, concat('{\"page\": ', page_id, '}') AS json FROM pages")(
    lambda p: P.embedded_json(_with_states(p))
)


def _feeds(c):
    """A feed for each work order: RSS for even ones, Atom for odd ones, cut short for every 17th, without items for every 13th, none for every 11th."""
    rss = F.concat(F.lit("<item><media:title>other</media:title><title><![CDATA["), "model", F.lit(" &]]></title><atom:link href='http://self'/><link>http://site"), "outlet_id", F.lit("</link><description>"), "trim", F.lit("</description></item>"))
    atom = F.concat(F.lit('<entry><title type="html">'), "model", F.lit(' &amp;</title><link rel="alternate" href="http://site'), "outlet_id", F.lit('"/><link href="http://other"/><summary>'), "trim", F.lit("</summary><content>c</content></entry>"))
    item = F.when(F.col("wo_number") % 2 == 0, rss).otherwise(atom)
    by = c.select(F.col("wo_number").alias("page_id"), item.alias("item")).groupBy("page_id").agg(F.concat_ws("", F.collect_list("item")).alias("all"))
    p = F.col("page_id")
    items = F.when(p % 13 == 0, "").otherwise(F.col("all"))
    whole = F.when(p % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:media="http://m" xmlns:atom="http://a"><channel><title>t</title>'), items, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), items, F.lit("</feed>")))
    return by.select("page_id", F.when(p % 11 == 0, None).when(p % 17 == 0, F.substring(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole).alias("xml"))


_WHOLE = "wo_number % 11 <> 0 AND wo_number % 17 <> 0 AND wo_number % 13 <> 0"
query("UD-04", "b_cand", sql=f"SELECT wo_number AS page_id, CASE WHEN wo_number % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind, concat(model, ' &') AS title, concat('http://site', outlet_id) AS link, trim AS description FROM b_cand WHERE {_WHOLE} AND (contains(lower(model), 'widget') OR contains(lower(trim), 'widget'))")(
    lambda c: P.feed_items(_feeds(c), "Widget").drop("position")
)
query("UD-04b", "b_cand", sql=f"SELECT DISTINCT wo_number AS page_id, CASE WHEN wo_number % 11 = 0 THEN 'empty' WHEN wo_number % 17 = 0 THEN 'broken' ELSE 'no_items' END AS reject_reason FROM b_cand WHERE NOT ({_WHOLE})")(
    lambda c: P.feed_rejects(_feeds(c))
)
query("SF-45", "documents")(lambda d: P.parse_oem_text(d, 2024))
query("SF-45b", "documents")(lambda d: P.parse_oem_messages(d))
query("SF-46", "documents", sql="SELECT doc_id, 'license' AS model, substr(text, l, CASE WHEN m > l THEN m - l ELSE length(text) + 1 - l END) AS section FROM (SELECT doc_id, text, instr(lower(text), 'license') AS l, instr(lower(text), 'moron') AS m FROM documents) WHERE l > 0 AND m > 0 AND length(substr(text, l, CASE WHEN m > l THEN m - l ELSE length(text) + 1 - l END)) > 5 UNION ALL SELECT doc_id, 'moron', substr(text, m, CASE WHEN l > m THEN l - m ELSE length(text) + 1 - m END) FROM (SELECT doc_id, text, instr(lower(text), 'license') AS l, instr(lower(text), 'moron') AS m FROM documents) WHERE l > 0 AND m > 0 AND length(substr(text, m, CASE WHEN l > m THEN l - m ELSE length(text) + 1 - m END)) > 5")(
    lambda d: P.split_models(d, ["license", "moron"], 5)
)
query("SF-33", "b_event", sql="SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id % 9 END IGNORE NULLS) OVER (PARTITION BY worker_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::INTEGER AS attempt, CASE WHEN event_type = 'view' THEN concat('q ', event_id) END AS query, CASE WHEN event_type = 'error' THEN event_id % 5 END::INTEGER AS found FROM b_event")(
    lambda e: T.parse_search_log(
        e.select("event_id", F.col("worker_id").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "click", F.concat(F.lit("INFO Attempt "), F.col("event_id") % 9)).when(F.col("event_type") == "view", F.concat(F.lit("Query: q "), "event_id")).when(F.col("event_type") == "error", F.concat(F.lit("found "), F.col("event_id") % 5, F.lit(" results"))).otherwise("-").alias("line"))
    ).select("event_id", "attempt", "query", "found")
)


def entry_best_clips(spark, sf_dir):
    """Candidates in their loan's window -> best clip per work order -> outcomes -> success rate per run."""
    loans, clips = bind(spark, sf_dir, "b_loan"), bind(spark, sf_dir, "b_cand")
    inside = D.date_acceptance(clips.join(loans.select("wo_number", "start_date"), "wo_number").withColumn("platform", F.lit("web")), AS_OF, max_age_days=2000).filter("accepted")
    outcomes = St.loan_outcomes(loans, best_clip(inside)).join(loans.select("wo_number", F.date_format("start_date", "yyyy-MM").alias("run_id")), "wo_number")
    by = outcomes.groupBy("run_id").agg(F.count("*").alias("loans"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("stored", "failed", "not_found")))
    return by.withColumn("success_rate", F.round(100.0 * F.col("stored") / F.col("loans"), 1).cast("double"))


QUERIES["entry_best_clips"] = entry_best_clips
SQL["entry_best_clips"] = duck(f"""WITH c AS (SELECT c.*, row_number() OVER (PARTITION BY c.wo_number ORDER BY relevance DESC, published DESC, url_pos, part_id, outlet_id, price) AS rn FROM b_cand c JOIN b_loan l ON c.wo_number = l.wo_number
    WHERE published BETWEEN start_date - 30 AND start_date + 180 AND date_diff('day', published, DATE '{AS_OF}') BETWEEN -7 AND 2000)
    SELECT strftime(start_date, '%Y-%m') AS run_id, count(*) AS loans, count(*) FILTER (relevance >= 5) AS stored, count(*) FILTER (relevance < 5) AS failed, count(*) FILTER (relevance IS NULL) AS not_found, round(100.0 * count(*) FILTER (relevance >= 5) / count(*), 1)::DOUBLE AS success_rate
    FROM b_loan l LEFT JOIN (SELECT * FROM c WHERE rn = 1) b ON l.wo_number = b.wo_number GROUP BY 1""")
