"""The pipeline's entities as plain projections of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Reference times for the bound data.
AS_OF, EVENTS_AS_OF = "2001-08-01", "2024-01-31 00:00:00"

BINDINGS = {
    "b_loan": """SELECT o_orderkey AS wo_number, o_custkey AS person_id, c_name AS contact, n_name AS office,
        CAST(o_orderdate AS DATE) AS start_date FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "b_cand": """SELECT l_orderkey AS wo_number, l_linenumber AS url_pos, p_brand AS make, p_name AS model, p_type AS trim,
        CAST(floor(l_quantity) AS INT) % 11 AS relevance, CAST(l_shipdate AS DATE) AS published, l_suppkey AS outlet_id, l_partkey AS part_id,
        l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS line_status,
        CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS sentiment,
        concat('https://www.site', CAST(l_suppkey AS STRING), '.com/', CAST(year(l_shipdate) AS STRING), '/',
               lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '/', replace(p_name, ' ', '-'), '-review') AS url
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "b_best": """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY wo_number
        ORDER BY relevance DESC, published DESC, url_pos, part_id, outlet_id, price) AS rn FROM {b_cand} c) r WHERE rn = 1""",
    "b_clip": """SELECT o_orderkey AS wo_number, concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS run_id,
        c_name AS contact, o_custkey AS person_id, n_name AS office, make, model, trim, url AS clip_url, relevance, published AS published_date,
        published AS processed_date, outlet_id, sentiment, CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS impressions,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending_review' ELSE 'no_content_found' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'found' WHEN '2' THEN 'sentiment_analyzed' WHEN '3' THEN 'exported' WHEN '4' THEN 'rejected' ELSE 'approved' END AS stage,
        CASE WHEN relevance >= 5 THEN published END AS analysed, CASE relevance % 3 WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' END AS version
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey LEFT JOIN {b_best} b ON b.wo_number = o_orderkey""",
    "b_run": """SELECT concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS run_id,
        concat('run ', CAST(year(o_orderdate) AS STRING)) AS run_name, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time, count(*) AS total_records,
        sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS successful_finds, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS failed_attempts,
        CASE month(min(o_orderdate)) % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS run_status,
        concat('user', CAST(month(min(o_orderdate)) % 3 AS STRING)) AS created_by
        FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)""",
    "b_outlet": """SELECT s_nationkey AS person_id, concat('Reporter ', n_name) AS reporter_name, s_suppkey AS outlet_id, s_name AS outlet_name,
        concat('http://site', CAST(s_suppkey AS STRING), '.com') AS outlet_url, CAST(floor(abs(s_acctbal)) AS BIGINT) AS impressions FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "b_track": """SELECT o_orderkey AS wo_number, CASE o_orderstatus WHEN 'F' THEN 'found' ELSE 'searching' END AS status,
        CAST(o_orderdate AS DATE) AS last_attempt_date, CAST(o_custkey % 5 AS INT) AS attempt_count,
        CASE WHEN o_orderstatus <> 'F' AND o_custkey % 2 = 0 THEN DATE '2001-07-25' + CAST(o_custkey % 14 AS INT) END AS retry_after
        FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "b_event": """SELECT event_id, ts, user_id AS worker_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level,
        event_type, value, props AS metadata FROM {events}""",
    "b_intent": "SELECT DISTINCT p_brand AS make, split_part(p_name, ' ', 2) AS feature FROM {part}",
    "b_feature": "SELECT wo_number, make, model, published, model AS feature, sentiment, line_status AS quote, url_pos FROM {b_cand}",
}


#: Tables that grow and are joined by their key in a binding. Files say little of their rows (names repeat), so the size of
#: the file must not decide that all rows are sent to the driver and every task.
DEALT = {("b_cand", "part"), ("b_loan", "customer"), ("b_clip", "customer")}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver or one of BINDINGS over them."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    dealt = lambda n, df: df.hint("shuffle_hash") if (name, n) in DEALT else df
    return spark.sql(BINDINGS[name], **{n: dealt(n, bind(spark, sf_dir, n)) for n in _names(BINDINGS[name])})


def duck(sql: str) -> str:
    """SQL over names of BINDINGS as SQL over the driver's tables."""
    needed: list[str] = []

    def need(name: str) -> None:
        for n in _names(BINDINGS[name]):
            if n in BINDINGS:
                need(n)
        if name not in needed:
            needed.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', BINDINGS[n])})" for n in needed)
    sql = sql.strip()
    if not ctes:
        return sql
    return f"WITH {ctes}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {ctes} {sql}"
