"""SF and PF queries over texts, URLs, dates and names of the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import dates as D
from ...functions import scores as S
from ...functions import text as T
from ...functions import urls as U
from ..bindings import AS_OF
from ..registry import query

K = ["wo_number", "url_pos", "part_id", "price"]
k = ", ".join(K)


def lit_list(words, col):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


query(
    "SF-01", "b_cand",
    sql=f"""SELECT {k}, n AS pos, CASE n WHEN 1 THEN url WHEN 2 THEN concat('http://x.com/', trim) END AS found FROM b_cand, (SELECT unnest([1, 2]) AS n) WHERE n = 1 OR relevance % 2 = 0""",
)(
    lambda c: U.explode_urls(
        c.select("wo_number", F.col("url_pos").alias("k_pos"), "part_id", "price", F.when(F.col("relevance") % 2 == 0, F.concat(F.lit('"'), "url", F.lit('" , '), F.lit("http://x.com/"), "trim", F.lit(",, http://intra/1"))).otherwise(F.concat("url", F.lit("; http://intra/2"))).alias("links")), "links", "http://intra"
    ).select("wo_number", F.col("url_pos").alias("pos"), F.col("k_pos").alias("url_pos"), "part_id", "price", F.col("url").alias("found"))
)
query("SF-02", "part", sql="SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS search_model FROM part")(
    lambda p: T.with_search_model(p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("model_short"), F.col("p_name").alias("model_full"))).select("p_partkey", "search_model")
)
query("SF-03", "b_loan", sql="SELECT wo_number AS k, CASE WHEN wo_number % 5 = 0 THEN NULL ELSE CAST(wo_number AS STRING) END AS wo FROM b_loan")(
    lambda l: T.clean_ids(l.select(F.col("wo_number").alias("k"), F.when(F.col("wo_number") % 5 == 0, F.lit("NaN")).otherwise(F.format_number("wo_number", 0)).alias("wo")), ["wo"])
)
query("SF-04", "pages", sql=r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain, concat(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', ''), ':mazda:cx-5') AS cache_key FROM pages")(
    lambda p: p.select("page_id", U.domain(F.col("url")).alias("domain"), U.cache_key(F.col("url"), F.lit("Mazda"), F.lit("CX-5")).alias("cache_key"))
)
query("SF-05", "pages", sql="SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'instagram' ELSE 'web' END AS platform FROM pages")(
    lambda p: p.select("page_id", U.platform(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("https://youtu.be/", "https://www.TikTok.com/", "https://instagram.com/", "https://a.org/"))), (F.col("page_id") % 4 + 1).cast("int")), F.col("page_id").cast("string"))).alias("platform"))
)
query("SF-06", "pages", sql="SELECT page_id, CASE WHEN page_id % 4 < 3 THEN concat('vid_', lpad(CAST(page_id AS STRING), 6, '0')) END AS media_id FROM pages")(
    lambda p: p.select("page_id", U.media_id(F.concat(F.element_at(F.array(*(F.lit(x) for x in ("https://www.youtube.com/watch?a=1&v=", "https://youtu.be/", "https://www.youtube.com/embed/", "https://a.org/"))), (F.col("page_id") % 4 + 1).cast("int")), F.lit("vid_"), F.lpad(F.col("page_id").cast("string"), 6, "0"))).alias("media_id"))
)
query("SF-07", "b_cand", sql=f"SELECT {k}, CASE WHEN contains(url, 'site1') THEN replace(url, 'site1', 'new1') WHEN contains(url, 'site2') THEN replace(url, 'site2', 'new2') ELSE url END AS actual_url FROM b_cand")(
    lambda c: U.rewrite_urls(c, [("site1", "new1"), ("site2", "new2")]).select(*K, "actual_url")
)
_PATH = r"regexp_replace(regexp_extract(lower(u), '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g')"
query(
    "PF-14", "b_cand",
    sql=f"""SELECT {k}, (p IN ({', '.join(f"'{x}'" for x in U.INDEX_PATHS)}) OR {' OR '.join(f"ends_with(p, '/{x}')" for x in U.INDEX_PATHS[1:])}) OR ({lit_list(U.LISTING_PARTS, 'p')} AND NOT {lit_list(U.ARTICLE_MARKS, 'p')}) AS is_index
    FROM (SELECT {k}, {_PATH} AS p FROM (SELECT *, CASE relevance % 4 WHEN 0 THEN url WHEN 1 THEN 'https://a.com/blog/' WHEN 2 THEN concat('https://a.com/x/category/', model) ELSE concat('https://a.com/x/news/review-', trim) END AS u FROM b_cand))""",
)(
    lambda c: c.select(*K, U.is_index_url(F.when(F.col("relevance") % 4 == 0, F.col("url")).when(F.col("relevance") % 4 == 1, F.lit("https://a.com/blog/")).when(F.col("relevance") % 4 == 2, F.concat(F.lit("https://a.com/x/category/"), "model")).otherwise(F.concat(F.lit("https://a.com/x/news/review-"), "trim"))).alias("is_index"))
)
query("PF-15", "pages", sql=r"""SELECT page_id, coalesce(url <> '' AND NOT regexp_matches(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/search|/category|/tag|/author|/page/|/index|/sitemap|/feed|\.pdf|\.jpg|\.png|\.gif'), false) AS is_article FROM pages""")(
    lambda p: p.select("page_id", U.is_article_url(F.col("url")).alias("is_article"))
)
query("PF-16", "b_cand", sql=f"SELECT {k}, coalesce(year(published) < 2002, false) AS is_old FROM b_cand")(
    lambda c: c.select(*K, U.is_old_url(F.col("url"), "2003-06-01").alias("is_old"))
)
query("PF-17", "pages", sql=f"SELECT page_id, (length(html) > 50000 AND length(html) % 1500 < 1000) OR ((p IN ({', '.join(repr(x) for x in U.INDEX_PATHS)}) OR {' OR '.join(f'ends_with(p, {chr(39)}/{x}{chr(39)})' for x in U.INDEX_PATHS[1:])} OR ({lit_list(U.LISTING_PARTS, 'p')} AND NOT {lit_list(U.ARTICLE_MARKS, 'p')})) AND length(html) % 1500 < 0.02 * length(html)) AS is_index FROM (SELECT *, {_PATH.replace('lower(u)', 'lower(url)')} AS p FROM pages)")(
    lambda p: p.select("page_id", U.is_index_page(F.col("url"), F.length("html"), F.length("html") % 1500).alias("is_index"))
)
query("PF-18", "documents", sql="SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'moron') OR contains(lower(concat_ws(' ', text, source)), 'license')")(lambda d: U.on_topic(d, ["text", "source"], ["MORON", "License"]).select("doc_id"))
query(
    "PF-13", "b_cand", "b_outlet",
    sql=f"""WITH u AS (SELECT {k}, outlet_id % 30 AS person_id, concat('site', CAST(outlet_id AS STRING), '.com') AS host FROM b_cand), o AS (SELECT person_id, outlet_id, outlet_name, replace(outlet_url, 'http://', '') AS h FROM b_outlet)
    SELECT u.wo_number, u.url_pos, u.part_id, u.price, NOT EXISTS (SELECT 1 FROM o WHERE o.person_id = u.person_id) OR m.n IS NOT NULL AS allowed,
    CASE WHEN NOT EXISTS (SELECT 1 FROM o WHERE o.person_id = u.person_id) THEN 'Person not in mapping' ELSE coalesce(m.n, 'Not from authorized outlets') END AS reason
    FROM u LEFT JOIN (SELECT person_id, h, arg_min(outlet_name, outlet_id) AS n FROM o GROUP BY 1, 2) m ON m.person_id = u.person_id AND (m.h = u.host OR ends_with(u.host, concat('.', m.h)))""",
)(lambda c, o: U.authorised_urls(c.select(*K, "url", (F.col("outlet_id") % 30).alias("person_id")), o).select(*K, "allowed", "reason"))
query(
    "SF-20", "b_cand", "b_loan",
    sql=f"""SELECT c.wo_number, url_pos, part_id, price, reason, reason = 'ok' AS accepted FROM (SELECT c.*, CASE WHEN date_diff('day', c.published, DATE '{AS_OF}') < -7 THEN 'future' WHEN date_diff('day', c.published, DATE '{AS_OF}') > 1500 THEN 'too_old'
    WHEN c.published < l.start_date - 30 THEN 'before_window' WHEN c.published > l.start_date + 180 THEN 'after_window' ELSE 'ok' END AS reason FROM b_cand c JOIN b_loan l ON c.wo_number = l.wo_number) c""",
)(lambda c, l: D.date_acceptance(c.join(l.select("wo_number", "start_date"), "wo_number").withColumn("platform", F.lit("web")), AS_OF, max_age_days=1500).select(*K, "reason", "accepted"))
query("SF-21", "b_cand", sql=f"SELECT {k}, CASE WHEN year(published) >= 2000 THEN make_date(year(published), 1, 1) END AS url_date FROM b_cand")(lambda c: c.select(*K, D.date_from_url(F.col("url"), AS_OF).alias("url_date")))
query("SF-23", "b_loan", sql="SELECT wo_number, start_date AS parsed FROM b_loan")(
    lambda l: l.select("wo_number", D.parse_date(F.when(F.col("wo_number") % 3 == 0, F.concat(F.lit("Published: "), F.date_format("start_date", "MMMM d, yyyy"))).when(F.col("wo_number") % 3 == 1, F.date_format("start_date", "MM/dd/yyyy")).otherwise(F.date_format("start_date", "yyyy-MM-dd'T'HH:mm:ss"))).alias("parsed"))
)
query("SF-24", "b_loan", sql="SELECT wo_number, CASE WHEN wo_number % 4 = 3 THEN TIMESTAMP '2001-07-31 12:00:00' ELSE TIMESTAMP '2001-08-01 00:00:00' - to_seconds((wo_number % 50) * CASE wo_number % 4 WHEN 0 THEN 86400 WHEN 1 THEN 2592000 ELSE 3600 END) END AS at FROM b_loan")(
    lambda l: l.select("wo_number", D.parse_relative_date(F.when(F.col("wo_number") % 4 == 3, F.lit("Yesterday")).otherwise(F.concat(F.lit("Streamed "), (F.col("wo_number") % 50).cast("string"), F.element_at(F.array(F.lit(" days ago"), F.lit(" months ago"), F.lit(" hours ago")), F.least((F.col("wo_number") % 4 + 1).cast("int"), F.lit(3))))), AS_OF).cast("timestamp_ntz").alias("at"))
)
query("SF-25", "b_loan", sql="SELECT wo_number, CASE WHEN s >= 86400 THEN concat(s // 86400, 'd ', s % 86400 // 3600, 'h') WHEN s >= 3600 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm') WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s, 's') END AS duration, CASE WHEN wo_number % 10 > 0 THEN floor(s * (10 - wo_number % 10) / (wo_number % 10))::BIGINT END AS eta FROM (SELECT wo_number, wo_number * 7 AS s FROM b_loan)")(
    lambda l: l.select("wo_number", D.duration_text(F.col("wo_number") * 7).alias("duration"), D.eta(F.col("wo_number") % 10, F.lit(10), F.col("wo_number") * 7).alias("eta"))
)
query("SF-26", "b_clip", sql=f"SELECT wo_number, coalesce(CAST(coalesce(CASE WHEN wo_number % 2 = 0 THEN published_date END, CASE WHEN year(published_date) >= 2000 THEN make_date(year(published_date), 1, 1) END, CASE WHEN date_diff('day', processed_date, DATE '{AS_OF}') <= 30 THEN processed_date END) AS STRING), '—') AS shown_date FROM b_clip")(
    lambda c: D.published_date_fallback(c.select("wo_number", F.when(F.col("wo_number") % 2 == 0, F.col("published_date")).alias("published_date"), "processed_date", F.col("clip_url").alias("url")), AS_OF).select("wo_number", "shown_date")
)
query("SF-27", "b_loan", sql="SELECT wo_number, CASE wo_number % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'strong' WHEN 2 THEN 'partial' ELSE 'delegated' END AS attribution FROM b_loan")(
    lambda l: l.select("wo_number", T.attribution(F.concat(F.lit("Jane "), "contact"), F.when(F.col("wo_number") % 4 == 1, F.concat(F.lit("Dr.  Jane "), F.upper("contact"))).when(F.col("wo_number") % 4 == 2, F.concat(F.lit("Joe "), "contact")).when(F.col("wo_number") % 4 == 3, F.lit("Staff Writer"))).alias("attribution"))
)
query("SF-28", "b_loan", sql="SELECT wo_number, CASE wo_number % 3 WHEN 0 THEN 'A Writer' ELSE contact END AS shown_byline FROM b_loan")(
    lambda l: T.choose_byline(l.withColumn("byline", F.element_at(F.array(F.lit(" A Writer"), F.lit("N/A"), F.lit("Posted: May Author: X")), (F.col("wo_number") % 3 + 1).cast("int")))).select("wo_number", "shown_byline")
)
query("SF-29", "b_cand", sql=f"SELECT {k}, concat(lower(split_part(model, ' ', 1)), ',', lower(trim)) AS tags, concat('Look ', make) AS rest FROM b_cand")(
    lambda c: c.withColumn("d", F.concat(F.lit("Look "), "make", F.lit(" #"), F.split_part("model", F.lit(" "), F.lit(1)), F.lit(" #"), F.upper("trim"))).select(*K, F.concat_ws(",", F.filter(T.hashtags(F.col("d")), lambda x: ~x.rlike(r"^\d+$"))).alias("tags"), T.without_hashtags(F.regexp_replace("d", r"Brand#", "Brand@")).alias("rest0"), F.concat(F.lit("Look "), "make").alias("rest")).drop("rest0")
)
query("SF-30", "b_cand", sql=f"SELECT {k}, CASE WHEN url_pos - 1 > 0 THEN round((relevance + 2 + 1)::DOUBLE / (url_pos - 1), 3) ELSE 0 END AS rate FROM b_cand")(lambda c: c.select(*K, T.engagement_rate(F.col("relevance"), F.lit(2), F.lit(1), F.col("url_pos") - 1).alias("rate")))
query("SF-32", "b_cand", sql=f"SELECT {k}, relevance AS score, model AS name FROM b_cand")(
    lambda c: T.repair_json(c.withColumn("answer", F.concat(F.lit('Sure! ```json\n{"score": '), F.col("relevance").cast("string"), F.lit(', "name": "'), "model", F.lit('",}\n``` done'))), "answer", "score int, name string").select(*K, "repaired.score", "repaired.name")
)
query("SF-34c", "b_cand", sql=f"SELECT {k}, sentiment AS classification, 2 AS features_count, 1 AS attributes_count, 0 AS drivers_count FROM b_cand")(
    lambda c: T.sentiment_columns(c.withColumn("sentiment_json", F.to_json(F.struct(F.struct(F.col("sentiment").alias("overall")).alias("sentiment_classification"), F.array("model", "trim").alias("key_features_mentioned"), F.array("trim").alias("brand_attributes_identified"))))).select(*K, "classification", "features_count", "attributes_count", "drivers_count")
)
query("SF-37", "b_cand", sql=f"SELECT {k}, url AS source_url FROM b_cand")(
    lambda c: U.first_source_url(c.withColumn("original_urls", F.when(F.col("relevance") % 2 == 0, F.to_json(F.array("url", F.lit("b")))).otherwise(F.concat("url", F.lit(";b"))))).select(*K, "source_url")
)
_DETAILS = "CASE relevance % 4 WHEN 0 THEN concat(url, ': too old (', trim, '); ', 'http://x.com/', trim, ' ; note: http://y.com') WHEN 1 THEN concat('no page of ', model) WHEN 2 THEN concat(' ', url, ';', url, ': off: topic;') END"
query(
    "SF-37b", "b_cand",
    sql=f"SELECT {k}, CASE relevance % 4 WHEN 0 THEN concat(url, chr(10), 'http://x.com/', trim) WHEN 1 THEN 'No URLs found' WHEN 2 THEN concat(url, chr(10), url) ELSE 'No URLs processed' END AS searched FROM b_cand",
)(lambda c: c.select(*K, U.searched_urls(F.expr(_DETAILS)).alias("searched")))
query("SF-38", "documents", sql=r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t-\r\x1c-\x20\x{85}\p{Z}]+', ' ', 'g'), '(?i)(accept all cookies|privacy policy|terms of service|advertisement|subscribe now)', '', 'g')) AS cleaned FROM documents")(lambda d: d.select("doc_id", T.clean_text(F.col("text")).alias("cleaned")))
_MARKS = ["recent posts", "related posts", "you may also like", "more stories", "categories:", "tags:", "share this:", "follow us", "subscribe", "advertisement", "sponsored content", "continue reading", "popular articles", "trending now", "recommended for you"]
_BARE = r"regexp_replace({0}, '^[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"
query(
    "SF-39", "documents",
    sql=f"""SELECT doc_id, CASE WHEN text IS NULL OR length({_BARE.format('text')}) < 200 THEN 'too_short' WHEN {' + '.join(f"contains(lower(text), '{m}')::INT" for m in _MARKS)} >= 2 THEN 'sidebar' WHEN NOT (contains(lower(text), 'qu') OR contains(lower(text), 'the')) THEN 'off_topic'
    WHEN len(l) > 5 AND len(list_filter(l, lambda x: length(x) < 50)) > 0.7 * len(l) THEN 'fragmented' ELSE 'good' END AS quality_verdict FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_BARE.format('x')}), lambda x: x <> '') AS l FROM documents)""",
)(lambda d: T.content_quality(d, "text", F.lit("QU the")).select("doc_id", "quality_verdict"))
_N = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) // {1})"
query("SF-40", "documents", sql=f"SELECT doc_id, CASE WHEN {_N.format('ing', 3)} >= 2 AND contains(lower(text), 'the') THEN 'specific' WHEN {_N.format('ing', 3)} >= 1 THEN 'mention' ELSE 'generic' END AS specificity FROM documents")(lambda d: T.content_specificity(d, "text", F.lit("The"), F.lit("Ing")).select("doc_id", "specificity"))
query("SF-41", "documents", sql="SELECT doc_id, concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substr(text, s, 600), CASE WHEN length(text) >= s + 600 THEN '...' ELSE '' END) AS part FROM (SELECT doc_id, text, greatest(instr(lower(text), 'moron') - 200, 1) AS s FROM documents)")(lambda d: d.select("doc_id", T.excerpt(F.col("text"), F.lit("Moron"), 200, 600).alias("part")))
query("SF-42", "documents", sql="SELECT doc_id, array_to_string(list_filter([CASE WHEN instr(lower(text), 'license') > 0 THEN substr(text, instr(lower(text), 'license'), 50) END, CASE WHEN instr(lower(text), 'moron') > 0 THEN substr(text, instr(lower(text), 'moron'), 50) END], lambda x: x IS NOT NULL), '|') AS sections FROM documents")(
    lambda d: d.select("doc_id", F.array_join(T.marketing_sections(F.col("text"), ["License", "Moron"], 50), "|").alias("sections"))
)
query("SF-43", "conversations", sql=r"SELECT conv_id, trim(regexp_replace(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text), '\s+', ' ', 'g')) AS transcript FROM conversations GROUP BY 1")(lambda c: T.assemble_transcript(c, "conv_id", "turn"))
_ES, _FR = ["el ", "la ", "de ", "que ", "y ", "en ", "un ", "es ", "se ", "no "], ["le ", "de ", "et ", "à ", "un ", "il ", "être ", "et ", "en ", "avoir "]
_sum = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words)
query("SF-44", "documents", sql=f"SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 50 THEN 'en' WHEN length(t) - length(regexp_replace(t, '[\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > 0.1 * length(t) THEN 'ar' WHEN {_sum(_ES)} >= 3 THEN 'es' WHEN {_sum(_FR)} >= 3 THEN 'fr' ELSE 'en' END AS language FROM (SELECT doc_id, text, lower(substr(text, 1, 2000)) AS t FROM documents)")(lambda d: d.select("doc_id", T.detect_language(F.col("text")).alias("language")))
query("SF-47", "b_loan", sql="SELECT wo_number, start_date AS stored FROM b_loan")(lambda l: l.select("wo_number", D.to_storage_date(F.when(F.col("wo_number") % 2 == 0, F.concat(F.col("start_date").cast("string"), F.lit("T10:00:00Z"))).otherwise(F.col("start_date").cast("string"))).alias("stored")))
query("SF-48", "b_clip", sql="SELECT wo_number, CASE status WHEN 'approved' THEN 'Approved' WHEN 'pending_review' THEN 'In review' ELSE status END AS label FROM b_clip")(lambda c: T.display_labels(c, {"approved": "Approved", "pending_review": "In review"}, "status").select("wo_number", "label"))
query("SF-49", "b_clip", sql="SELECT wo_number, coalesce(published_date BETWEEN start_date AND start_date + 90, false) AS inside FROM b_clip")(lambda c: c.select("wo_number", D.in_forward_window(F.col("published_date"), F.col("start_date"), 90).alias("inside")))
query("SF-50", "b_clip", sql="SELECT wo_number, relevance FROM b_clip WHERE relevance >= 8")(lambda c: S.high_quality(c).select("wo_number", "relevance"))

_AT = lambda n: f"list_contains(known, lower(array_to_string(w[i : i + {n}], ' ')))"
query(
    "SF-08", "part",
    sql=f"""WITH m AS (SELECT p_partkey, concat(p_name, CASE p_size % 3 WHEN 0 THEN ' Grand Touring AWD' WHEN 1 THEN ' XLT' ELSE ' of late' END) AS model FROM part),
    s AS (SELECT *, string_split(model, ' ') AS w, [{', '.join(f"'{t.lower()}'" for t in S.TRIMS)}] AS known FROM m),
    f AS (SELECT *, coalesce(list_filter(range(1, len(w) + 1), lambda i: {_AT(0)} OR {_AT(1)} OR {_AT(2)})[1], CASE WHEN len(w[-1]) <= 4 AND upper(w[-1]) = w[-1] AND lower(w[-1]) <> w[-1] AND len(w) > 1 THEN len(w) END) AS i FROM s)
    SELECT p_partkey, CASE WHEN i > 1 THEN array_to_string(w[1 : i - 1], ' ') ELSE model END AS base_model, CASE WHEN i > 1 THEN array_to_string(w[i :], ' ') END AS trim_level FROM f""",
)(
    lambda p: S.split_trim(p.withColumn("model", F.concat("p_name", F.lit(" "), F.when(F.col("p_size") % 3 == 0, "Grand Touring AWD").when(F.col("p_size") % 3 == 1, "XLT").otherwise("of late")))).select("p_partkey", "base_model", "trim_level")
)


def _vehicles(p):
    return p.select(F.col("p_brand").alias("make"), F.col("p_name").alias("model"))


query("SF-09", "part")(lambda p: S.model_variations(_vehicles(p)))
query("SF-11", "b_cand", "part")(lambda c, p: S.link_tier_score(c.select(*K, "make", "model", "url"), S.model_variations(_vehicles(p))).select(*K, "tier_score"))
query("TK-02", "b_cand", "part")(lambda c, p: S.top_links(c.select(*K, "make", "model", "url"), S.model_variations(_vehicles(p)), ["make"], 10))
query("SF-12", "b_cand", sql=f"SELECT {k}, relevance % 3 <> 2 AS matched FROM b_cand")(
    lambda c: S.title_match(c.withColumn("title", F.when(F.col("relevance") % 3 == 0, F.concat(F.lit("The "), "model", F.lit(" tested"))).when(F.col("relevance") % 3 == 1, F.upper("model")).otherwise(F.lit("nothing of it")))).select(*K, "matched")
)
query(
    "SF-13", "documents",
    sql=f"""SELECT doc_id, CASE WHEN length(text) >= 100 THEN round(least(least({_N.format('the', 3)} * 0.5, 3.0) + least({_N.format('er', 2)} * 1.0, 4.0) + CASE WHEN contains(t, 'the er') OR contains(t, 'the-er') OR contains(t, 'theer') THEN 2.0 ELSE 0 END
    + ({' + '.join(f"contains(t, '{w}')::INT" for w in S.REVIEW_WORDS)}) * 0.2 + least(({' + '.join(f"contains(t, '{w}')::INT" for w in S.AUTO_WORDS)}) * 0.1, 1.0) + CASE WHEN {lit_list(S.YEARS, 't')} THEN 0.5 ELSE 0 END, 10.0), 4)::DOUBLE ELSE 0 END AS pre_relevance FROM (SELECT *, lower(text) AS t FROM documents)""",
)(lambda d: S.pre_relevance(d, "text", F.lit("The"), F.lit("er")).select("doc_id", F.col("pre_relevance").cast("double").alias("pre_relevance")))
query(
    "SF-14", "documents",
    sql=f"""SELECT doc_id, r AS lex_relevance, m AS lex_sentiment, CASE m WHEN 'positive' THEN least(8, greatest(6, r)) WHEN 'negative' THEN least(4, greatest(2, r)) ELSE least(7, greatest(4, r)) END AS overall_score, r >= 5 AS brand_alignment FROM (
    SELECT doc_id, least(10, greatest(0, ({_N.format('moron', 5)} + {_N.format('scum', 4)}) * 2))::INT AS r, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS m
    FROM (SELECT *, {' + '.join(f"contains(lower(text), '{w}')::INT" for w in S.POSITIVE)} AS g, {' + '.join(f"contains(lower(text), '{w}')::INT" for w in S.NEGATIVE)} AS b FROM documents))""",
)(lambda d: S.lexicon_analysis(d, "text", F.lit("moron"), F.lit("scum")).select("doc_id", "lex_relevance", "lex_sentiment", "overall_score", "brand_alignment"))
query("SF-15", "b_cand")(lambda c: S.social_score(c.select(*K, "make", "model", F.concat("make", F.lit(" "), "model").alias("title"), F.concat(F.lit("ride #"), F.replace("model", F.lit(" "), F.lit(""))).alias("description"), F.col("url").alias("transcript"))).select(*K, "social_score", "confidence"))
query("SF-16", "documents")(lambda d: S.validate_social(d, F.lit("the"), F.col("n_chars") / 20).select("doc_id", "validation", "flags", "valid"))
#: Title and snippet by part, outlet and relevance: whole, half or no model, author, address, marks of lists and templates, length.
_FOUND_TITLE = "concat(CASE part_id % 3 WHEN 0 THEN upper(model) WHEN 1 THEN split_part(model, ' ', 1) ELSE 'Jetta and Mustang' END, CASE relevance % 4 WHEN 0 THEN ' Review 2025' WHEN 1 THEN ' First Drive by Pat Doe' WHEN 2 THEN ' MSRP' ELSE '' END)"
_FOUND_SNIPPET = "concat(url, CASE outlet_id % 4 WHEN 0 THEN ' /road-test 3 days ago' WHEN 1 THEN ' by doe. Recent posts, more stories' WHEN 2 THEN repeat(' long words', 20) ELSE ' Compare specifications' END)"
_ASKED = "CASE WHEN url_pos % 5 = 0 THEN 'VW \"Jetta\"' WHEN url_pos % 7 <> 0 THEN model END"
query(
    "SF-17", "b_cand",
    sql=f"""SELECT {k}, 200 * (contains(s, '/review') OR contains(s, '/first-test') OR contains(s, '/road-test'))::INT + CASE WHEN w IS NULL THEN 0 WHEN hits = len(w) THEN 100 WHEN hits >= 0.7 * len(w) THEN 30 ELSE -50 END
    + CASE WHEN contains(t, 'pat') OR contains(t, 'doe') THEN 75 WHEN contains(s, 'pat') OR contains(s, 'doe') THEN 50 ELSE 0 END
    + 50 * (contains(t, 'review')::INT + contains(t, 'first test')::INT + contains(t, 'first drive')::INT + contains(t, 'test drive')::INT + contains(t, 'road test')::INT)
    - 150 * len(list_filter(['expert insights, pricing, and trims', 'pricing and trims', 'msrp', 'specifications', 'compare', 'top competitors'], lambda m: contains(t, m) OR contains(s, m)))
    - 50 * len(list_filter(['related posts', 'recent posts', 'you may also like', 'more stories', 'other articles', 'similar content'], lambda m: contains(s, m)))
    - CASE WHEN list_contains(w, 'jetta') THEN 200 * len(list_filter(['dodge', 'charger', 'camaro', 'mustang', 'bmw', 'lexus'], lambda m: contains(t, m))) ELSE 0 END
    + 10 * (contains(s, 'days ago') OR contains(t, '2025'))::INT + 15 * (length(s) > 200)::INT AS search_score
    FROM (SELECT *, len(list_filter(w, lambda x: contains(t, x))) AS hits FROM (SELECT *, lower({_FOUND_TITLE}) AS t, lower({_FOUND_SNIPPET}) AS s, string_split(replace(lower({_ASKED}), '"', ''), ' ') AS w FROM b_cand))""",
)(
    lambda c: S.score_search_results(c.select(*K, F.expr(_FOUND_TITLE).alias("title"), F.expr(_FOUND_SNIPPET).alias("snippet"), F.expr(_ASKED).alias("model"), F.lit("Pat Doe").alias("author"))).select(*K, "search_score")
)
query(
    "SF-18", "b_cand",
    sql=f"""SELECT {k}, greatest(30 * contains(u, lower(make))::INT + CASE WHEN contains(m, '-') THEN 100 ELSE 40 END * contains(u, m)::INT + 20 * (contains(u, 'review') OR contains(u, 'test'))::INT + 10 * (contains(u, '2025') OR contains(u, '2024'))::INT, 0) AS url_score
    FROM (SELECT *, lower(url) AS u, replace(lower(model), ' ', '-') AS m FROM b_cand)""",
)(lambda c: S.score_url(c).select(*K, "url_score"))
query("SF-19", "documents", sql="SELECT doc_id, CASE WHEN length(text) < 100 THEN 0 WHEN contains(lower(text), 'thing') AND contains('a thing', 'thing') AND length(text) >= 1000 THEN 8 END AS shortcut FROM documents")(
    lambda d: S.title_shortcut(d.withColumns({"title": F.lit("A Thing"), "model": F.lit("Thing")})).select("doc_id", "shortcut")
)
