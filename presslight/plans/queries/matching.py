"""Queries of names in texts by the inverted index (SF-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import matching as M
from ..registry import query

_MODEL = "concat(p_name, CASE p_size % 4 WHEN 0 THEN ' XLE V6' WHEN 1 THEN ' Sport' WHEN 2 THEN '' ELSE ' Mk2 Hybrid' END)"
_TEXT = "concat(url, CASE part_id % 3 WHEN 0 THEN ' in Sport dress' WHEN 1 THEN ' with V 6' ELSE '' END)"
_TRIMS = "['base', 'sport', 'touring', 'limited', 'premium', 'ltd', 's', 't', 'se', 'le', 'xle', 'sr', 'sr5', 'lx', 'ex', 'si', 'type', 'gt', 'st', 'rs']"


def _spelled(n: str) -> str:
    """The spellings of a lower-case name in DuckDB's SQL, for names without misheard or shortened words."""
    plain = f"[{n}, replace({n}, '-', ''), replace({n}, '-', ' '), replace({n}, ' ', ''), replace({n}, ' ', '-'), regexp_replace({n}, '([a-z])([0-9])', '\\1 \\2', 'g'), regexp_replace({n}, '([a-z])\\s+([0-9])', '\\1\\2', 'g')]"
    return f"list_distinct(list_concat({plain}, list_transform(list_filter(string_split({n}, ' '), lambda w: regexp_matches(w, '^[a-z]{{3,}}$')), lambda w: replace({n}, w, concat(left(w, -1), '-', right(w, 1))))))"


query(
    "SF-10", "b_cand", "part",
    sql=f"""WITH v AS (SELECT DISTINCT p_brand AS make, {_MODEL} AS model FROM part),
    w AS (SELECT *, string_split(lower(model), ' ') AS words FROM v),
    c AS (SELECT *, coalesce(list_position(list_transform(words, lambda w: list_contains({_TRIMS}, w) OR regexp_matches(w, '[0-9]')), true), len(words) + 1) AS cut FROM w),
    b AS (SELECT make, model, array_to_string(words[:cut - 1], ' ') AS base, words[cut:] AS trim, lower(model) AS low FROM c),
    s AS (SELECT make, model, len(trim) > 0 AS trimmed, {_spelled('low')} AS full_, {_spelled('base')} AS base_, flatten(list_transform(list_filter(trim, lambda t: length(t) > 2), lambda t: {_spelled('t')})) AS trim_ FROM b),
    t AS (SELECT DISTINCT make, {_TEXT} AS doc_id, lower({_TEXT}) AS low FROM b_cand)
    SELECT t.doc_id, t.make, s.model FROM t JOIN s ON s.make = t.make
    WHERE len(list_filter(full_, lambda x: contains(low, x))) > 0
       OR (len(list_filter(base_, lambda x: contains(low, x))) > 0 AND (NOT trimmed OR len(list_filter(trim_, lambda x: contains(low, x))) > 0))""",
)(lambda c, p: M.fuzzy_model_match(c.select("make", F.expr(_TEXT).alias("text")), p.select(F.col("p_brand").alias("make"), F.expr(_MODEL).alias("model"))))

_MAKE = "CASE p_brand WHEN 'Brand#1' THEN 'Ford' WHEN 'Brand#2' THEN 'Volkswagen' WHEN 'Brand#3' THEN 'Mercedes-Benz' ELSE p_brand END"
_SAID = f"concat(p_name, CASE p_size % 4 WHEN 0 THEN ' by FoMoCo' WHEN 1 THEN ' by VW, not V.W., and Brand#7' WHEN 2 THEN ' from the Benz family' ELSE concat(' of ', {_MAKE}) END)"
query(
    "SF-10b", "part",
    sql=f"""WITH m AS (SELECT DISTINCT {_MAKE} AS make FROM part),
    n AS (SELECT make, unnest(list_concat([lower(make)], CASE make WHEN 'Ford' THEN ['fomoco'] WHEN 'Volkswagen' THEN ['vw', 'volkswagon', 'v.w.'] WHEN 'Mercedes-Benz' THEN ['mercedes', 'benz', 'mb', 'merc'] ELSE [] END)) AS term FROM m)
    SELECT DISTINCT p_partkey AS doc_id, make FROM part JOIN n ON contains(lower({_SAID}), term)""",
)(lambda p: M.makes_named(p.select(F.col("p_partkey").alias("doc_id"), F.expr(_SAID).alias("text")), p.select(F.expr(_MAKE).alias("make"))))
