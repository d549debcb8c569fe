"""Answers of a language model as documents: repaired, recovered field by field, or put aside with a reason (SF-32)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aspects of an answer, and what stands for fields that can't be found.
ASPECTS = {"performance": "Performance", "exterior_design": "Design", "interior_comfort": "Interior", "technology": "Technology", "value": "Value"}
SUMMARY = "Comprehensive analysis completed using enhanced parsing techniques."
RECOMMENDATION = "Detailed analysis available - review aspect scores for complete evaluation."
PROS, CONS = ["Positive aspects identified in analysis"], ["Areas for improvement noted"]
NO_SCORE, NO_ASPECT = 5, 7


def _once(text: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(text), f), 1)


def _cleaned(text: Column) -> Column:
    """The fenced block, else what the outer braces hold, else all; without trailing commas and control characters."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    inner = F.when(text.rlike(r"```(?:json)?[\s\S]*?```"), fenced).when(outer != "", outer).otherwise(text)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r",\s*([}\]])", "$1"), r"[\x00-\x1f\x7f-\x9f]", ""))


def _fields(text: Column) -> Column:
    """A document of the fields that patterns find in a broken answer; null without a relevance score."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    number = lambda pattern: found(pattern).try_cast("int")
    quoted = lambda name: F.replace(found(rf'"{name}"\s*:\s*"([^"]+(?:\\.[^"]*)*)"'), F.lit('\\"'), F.lit('"'))
    listed = lambda name, default: F.coalesce(F.regexp_extract_all(found(rf'"{name}"\s*:\s*\[([^\]]+)\]'), F.lit(r'"([^"]+)"'), F.lit(1)), F.array(*map(F.lit, default)))
    aspects = F.struct(*(
        F.struct(
            F.coalesce(number(rf'"{a}"\s*:[^}}]*"score"\s*:\s*(\d+)'), F.lit(NO_ASPECT)).alias("score"),
            F.coalesce(F.replace(found(rf'"{a}"\s*:[^}}]*"note"\s*:\s*"([^"]+(?:\\.[^"]*)*)"'), F.lit('\\"'), F.lit('"')), F.lit(f"{name} analysis completed")).alias("note"),
        ).alias(a)
        for a, name in ASPECTS.items()
    ))
    relevance, brand = number(r'"relevance_score"\s*:\s*(\d+)'), found(r'"brand_alignment"\s*:\s*(true|false)')
    document = F.struct(
        relevance.alias("relevance_score"), number(r'"overall_score"\s*:\s*(\d+)').alias("overall_score"), F.coalesce(found(r'"overall_sentiment"\s*:\s*"([^"]+)"'), F.lit("neutral")).alias("overall_sentiment"),
        F.coalesce(brand == "true", F.lit(True)).alias("brand_alignment"), F.coalesce(quoted("summary"), F.lit(SUMMARY)).alias("summary"), F.coalesce(quoted("recommendation"), F.lit(RECOMMENDATION)).alias("recommendation"),
        aspects.alias("aspects"), listed("pros", PROS).alias("pros"), listed("cons", CONS).alias("cons"),
    )
    return F.when(relevance.isNotNull(), F.try_parse_json(F.to_json(document)))


def parse_answers(df: DataFrame, col: str) -> DataFrame:
    """df with `answer` (variant), `how` (clean, commas, fields), `overall_score` and, where there is no answer, `reject_reason` (empty, no_object, broken).

    An answer must be an object. It is tried as cleaned, with wrongly escaped quotes mended, with commas set between objects and lists, and at last
    by its fields. A missing score is the rounded mean of the aspects' scores (half to even), 5 without any.
    """
    text = F.col(col)
    mended = lambda c: F.replace(c, F.lit('\\"'), F.lit('"'))
    commas = lambda c: F.regexp_replace(F.regexp_replace(c, r"\}\s*\{", "},{"), r"\]\s*\[", "],[")
    parsed = lambda c: F.when(F.startswith(c, F.lit("{")), F.try_parse_json(c))
    differs = lambda c, f: F.when(F.startswith(c, F.lit("{")), F.nullif(f(c), c))  # noqa: E731  a text that failed once is not tried again
    _tried = lambda how, answer: F.when(answer.isNotNull(), F.struct(F.lit(how).alias("how"), answer.alias("answer")))

    def tries(clean: Column) -> Column:
        as_it_stands = _once(parsed(clean), lambda v: _tried("clean", v))
        with_quotes = _once(differs(clean, mended), lambda m: _once(parsed(m), lambda v: _tried("clean", v)))
        with_commas = _once(mended(clean), lambda m: _once(differs(m, commas), lambda c: _once(parsed(c), lambda v: _tried("commas", v))))
        by_fields = F.when(F.contains(text, F.lit("relevance_score")), _once(_fields(text), lambda v: _tried("fields", v)))
        return F.coalesce(as_it_stands, with_quotes, with_commas, by_fields)

    # exploded from an array of one element, through which no filter on the answer is pushed (it would parse anew for every name of it)
    df = df.withColumn("_t", F.explode(F.transform(F.transform(F.array(text), _cleaned), tries)))
    df = df.withColumns({
        "answer": F.col("_t.answer"), "how": F.col("_t.how"),
        "reject_reason": F.when(F.col("_t").isNull(), F.when(~F.coalesce(text, F.lit("")).rlike(r"\S"), "empty").when(~F.contains(text, F.lit("{")), "no_object").otherwise("broken")),
    })
    each = F.transform(F.map_values(F.try_variant_get("answer", "$.aspects", "map<string,variant>")), lambda a: F.try_variant_get(a, "$.score", "double"))
    mean = _once(F.filter(each, lambda s: s.isNotNull()), lambda scores: F.when(F.size(scores) > 0, F.bround(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores))))
    overall = F.coalesce(F.try_variant_get("answer", "$.overall_score", "double"), mean, F.lit(float(NO_SCORE)))
    return df.withColumn("overall_score", F.when(F.col("answer").isNotNull(), overall)).drop("_t")


def answers_and_rejects(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with an answer, and those put aside with the reason and their text as it came."""
    out = parse_answers(df, col)
    return out.filter("answer IS NOT NULL").drop("reject_reason"), out.filter("answer IS NULL").drop("answer", "how", "overall_score")
