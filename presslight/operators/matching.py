"""Names in texts by an inverted index of their spellings (SF-10).

A spelling stands in a text only if each of its grams does. So every spelling is filed under one of its grams, the one that
the fewest other spellings have, and meets the texts that hold this gram by an equi-join; what met is then verified. No text
meets a spelling of which it holds nothing. Grams run over spaces and hyphens too, so that few spellings share their rarest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Characters of a gram; a spelling is filed under grams of the largest size that it has. Few sizes, as each is a pass over a text.
SIZES = (1, 2, 3, 6)
#: Up to so many terms, they and their index are sent to every task; more of them meet the texts by shuffles.
SENT = 200_000

# What a model's name is misheard as.
MISHEARD = {"emira": ["amir", "amira", "amera"], "cayenne": ["cayenne", "cayene", "cayen"], "macan": ["makan", "macann"], "giulia": ["julia", "guilia"]}
# Words of a name and what they are shortened to or stand for.
SHORT_FOR = {"spec": "special", "special": "spec", "perf": "performance"}
# Words with which a trim begins.
TRIM_WORDS = ["base", "sport", "touring", "limited", "premium", "ltd", "s", "t", "se", "le", "xle", "sr", "sr5", "lx", "ex", "si", "type", "gt", "st", "rs"]
# Other names of makes.
MAKE_NAMES = {
    "volkswagen": ["vw", "volkswagon", "v.w."], "mercedes-benz": ["mercedes", "benz", "mb", "merc"], "bmw": ["bimmer", "beemer", "bayerische"], "chevrolet": ["chevy", "chev"], "general motors": ["gm", "gmc"], "ford": ["fomoco"],
    "mazda": ["zoom-zoom"], "subaru": ["subie", "scooby"], "mitsubishi": ["mitsu"], "alfa romeo": ["alfa"], "land rover": ["landy"], "rolls-royce": ["rolls", "rr"],
}


def _exchanged(words: Column, word: str, other: str) -> Column:
    return F.transform(words, lambda w: F.when(w == word, other).otherwise(w))


def spellings(name: Column) -> Column:
    """Distinct ways to write a name in lower case: with spaces, hyphens or neither, numbers set off or joined, a hyphen before a word's last letter, short and misheard words."""
    n = F.lower(name)
    words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
    coded = F.transform(F.filter(words, lambda w: w.rlike(r"^\p{L}{3,}$")), lambda w: F.replace(n, w, F.concat(F.left(w, F.length(w) - 1), F.lit("-"), F.right(w, F.lit(1)))))
    forms = [n, F.replace(n, F.lit("-"), F.lit("")), F.replace(n, F.lit("-"), F.lit(" ")), F.replace(n, F.lit(" "), F.lit("")), F.replace(n, F.lit(" "), F.lit("-"))]
    forms += [F.regexp_replace(n, "([a-zA-Z])([0-9])", "$1 $2"), F.regexp_replace(n, r"([a-zA-Z])\s+([0-9])", "$1$2")]
    forms += [F.when(F.contains(n, F.lit(heard)), F.replace(n, F.lit(heard), F.lit(other))) for heard, others in MISHEARD.items() for other in others]
    forms += [F.when(F.array_contains(words, word), F.array_join(_exchanged(words, word, other), " ")) for word, other in SHORT_FOR.items()]
    return F.filter(F.array_distinct(F.concat(F.array_compact(F.array(*forms)), coded)), lambda s: s != "")


def components(model: Column) -> tuple[Column, Column]:
    """The base model and the words of its trim: all from the first trim word, or word with a digit, on; a name that begins with one is its own base."""
    words = F.filter(F.split(F.lower(model), r"\s+"), lambda w: w != "")
    begins = F.transform(words, lambda w: w.isin(TRIM_WORDS) | w.rlike("[0-9]"))
    at = F.array_position(begins, True)
    cut = F.when(at > 0, at).otherwise(F.size(words) + 1).cast("int")
    base = F.when(cut > 1, F.array_join(F.slice(words, F.lit(1), cut - 1), " ")).otherwise(F.lower(model))
    return base, F.slice(words, cut, F.greatest(F.size(words) - cut + 1, F.lit(0)))


def model_terms(vehicles: DataFrame) -> DataFrame:
    """vehicles(make, model) -> make, model, role (full, base), term, whether the model has a trim, and with its base the spellings of the trim's words: what is looked for. A trim word counts from three characters on."""
    base, trim = components(F.col("model"))
    v = vehicles.select("make", "model").dropna().distinct().withColumns({"_base": base, "_trim": trim})
    v = v.withColumn("_trims", F.array_distinct(F.flatten(F.transform(F.filter("_trim", lambda t: F.length(t) > 2), spellings))))
    looked = F.array(
        F.when((F.size("_trim") > 0) | (F.col("_base") != F.lower("model")), F.struct(F.lit("full").alias("role"), spellings(F.col("model")).alias("terms"), F.array().cast("array<string>").alias("trims"))),  # else the base is the name
        F.struct(F.lit("base").alias("role"), spellings(F.col("_base")).alias("terms"), F.col("_trims").alias("trims")),
    )
    v = v.select("make", "model", (F.size("_trim") > 0).alias("trimmed"), F.explode(F.array_compact(looked)).alias("x"))
    return v.select("make", "model", "trimmed", F.col("x.role").alias("role"), F.col("x.trims").alias("trims"), F.explode("x.terms").alias("term"))


def make_terms(makes: DataFrame) -> DataFrame:
    """makes(make) -> make, term: the make and its other names."""
    known = F.create_map(*(x for make, names in MAKE_NAMES.items() for x in (F.lit(make), F.array(*map(F.lit, names)))))
    lower = F.lower("make")
    return makes.select("make").dropna().distinct().select("make", F.explode(F.array_distinct(F.concat(F.array(lower), F.coalesce(F.try_element_at(known, lower), F.array().cast("array<string>"))))).alias("term"))


def _grams(text: Column, places: Sequence[str]) -> Column:
    """The text's overlapping grams that fit a pattern for each place; in one pass, as substring would count from the text's start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({''.join(places)}))."), F.lit(1))


def _patterns(index: DataFrame) -> list[list[str]]:
    """For each size of the index's grams and each place in them a pattern of the characters that stand there; beyond ASCII any does, so that this is small."""
    chars = index.select(F.length("gram").alias("n"), F.posexplode(F.split("gram", ""))).select("n", "pos", F.when(F.col("col") < "\x80", F.col("col")).alias("c")).distinct().collect()
    there: dict[tuple[int, int], set[str]] = {}
    for n, pos, c in chars:
        there.setdefault((n, pos), set()).add(r"\x{80}-\x{10ffff}" if c is None else f"\\x{ord(c):02x}")
    return [["[" + "".join(sorted(there[n, i])) + "]" for i in range(n)] for n in SIZES if (n, 0) in there]


def index_of(terms: DataFrame) -> DataFrame:
    """terms(term) -> term, gram: each term under its gram, of the largest size it has, that the fewest terms have (ties: the first)."""
    t = terms.select("term").distinct()
    by_size = reduce(lambda shorter, n: F.when(F.length("term") >= n, _grams(F.col("term"), "." * n)).otherwise(shorter), SIZES, F.array().cast("array<string>"))
    filed = t.select("term", F.explode(F.array_distinct(by_size)).alias("gram"))
    shared = filed.groupBy("gram").agg(F.count("*").alias("n"))
    return filed.join(shared, "gram").groupBy("term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def texts_with(texts: DataFrame, terms: DataFrame, text: str = "text", on: Sequence[str] = ()) -> DataFrame:
    """texts x terms(term, ..) -> the pairs whose term is contained in the lower-case text and whose columns `on` are equal, as texts' and terms' columns.

    Texts are taken one by one: repeated rows give repeated pairs. Null texts and empty terms hold and match nothing. The grams of a
    text that no term is filed under meet nothing, and those with an ASCII character that no such gram has there are not even made. The terms
    are written once, so that their number says how they meet the texts; while they are sent, the texts stay where they are, however many grams they have.
    """
    terms = kept(terms.filter("term <> ''"), "terms")
    index = kept(index_of(terms), "index")
    met_by = "broadcast" if terms.count() <= SENT else "merge"
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *(_grams(F.col("_low"), places) for places in _patterns(index))))
    # empty for null: a filter of nulls would be pushed to where the texts are made, and make each twice
    met = texts.withColumn("_low", F.coalesce(F.lower(text), F.lit(""))).withColumn("_gram", F.explode(grams)).join(index.select(F.col("gram").alias("_gram"), F.col("term").alias("_term")).hint(met_by), "_gram")
    held = met.filter(F.contains("_low", F.col("_term"))).drop("_gram", "_low")
    return held.join(terms.withColumnRenamed("term", "_term").hint(met_by), ["_term", *on]).withColumnRenamed("_term", "term")


def fuzzy_model_match(docs: DataFrame, vehicles: DataFrame, threshold: float = 0.6) -> DataFrame:
    """docs(doc_id, make, text), vehicles(make, model) -> doc_id, make, model of the vehicles of their make that the texts speak of.

    A vehicle matches by any spelling of its name; or by one of its base model, if it has no trim, or one of a trim's words is there too, or
    threshold is 0.5 or less. Rows of one doc_id count as one text; without that column a text is its own doc_id.
    """
    # what a text holds is told apart where the text is
    if "doc_id" in docs.columns:
        said = docs.select("doc_id", "make", "text").repartition("doc_id", "make").groupBy("doc_id", "make").agg(F.collect_set(F.lower("text")).alias("_said")).withColumn("text", F.explode("_said"))
    else:
        said = docs.select("make", "text").repartition("text", "make").distinct().select(F.col("text").alias("doc_id"), "make", "text", F.array(F.lower("text")).alias("_said"))
    held = texts_with(said, model_terms(vehicles), on=["make"])
    # a trim's words stand in texts of many models, so they are looked for only where the base is
    trim_said = F.exists("trims", lambda t: F.exists("_said", lambda s: F.contains(s, t)))
    return held.filter((F.col("role") == "full") | ~F.col("trimmed") | F.lit(threshold <= 0.5) | trim_said).select("doc_id", "make", "model").distinct()


def makes_named(docs: DataFrame, makes: DataFrame) -> DataFrame:
    """docs(doc_id, text), makes(make) -> doc_id, make for every make that a text names, by whatever name."""
    return texts_with(docs.select("doc_id", "text").repartition("doc_id"), make_terms(makes)).select("doc_id", "make").distinct()
