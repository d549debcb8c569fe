"""Phrase collocations by marginalising the longest windows.

Every word of a piece opens one window: the word and its lead columns, the next three words, padded at the
piece's end. Only these longest windows are counted; ROLLUP sums them to the counts of their shorter
prefixes, so no pass of its own counts pairs or triples.

A phrase of LEAST occurrences consists of words, and of pairs of neighbours, that occur as often, so a window is padded
from the first pair on that does not. Which words and pairs do is kept in two bit tables of a fixed size, sent to every
task: a slot that several share lets more through, never less, and the counts stay exact. The pair table comes from
hashed pairs alone, and no count is taken from it.

Words travel as 64-bit hashes; two frequent words of a language with equal hashes would count as one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, written

#: Occurrences of a candidate, its longest length in words, the percentage of a longer candidate that drops it, and phrases reported a language.
LEAST, LONGEST, PERCENT, TOP = 30, 4, 80, 2000
#: Bits of a table: 16 MB, whatever the corpus.
TABLE_BITS = 1 << 27
#: Bits of a pair's hash (the pair table needs no more), and bytes of input that one task counts windows of: frequent windows stand in every part, so larger parts send fewer rows.
PAIR_BITS, PART_BYTES = 40, 64 << 20
#: The seed of Spark's xxhash64, so that both sides agree on a word's hash.
SEED = 42
#: Tokens of a text and of a run of texts that are held at once; words a worker remembers the hashes of.
SLICE, RUN, REMEMBERED = 1 << 20, 1 << 20, 1 << 18
#: Lower-cases A-Z, turns tabs to spaces and the marks that end a piece to line feeds.
BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(text: str) -> Iterator[bytes]:
    """The translated text in slices that end where a piece ends."""
    plain, at = text.encode().translate(BYTES), 0
    while len(plain) - at > SLICE:
        cut = plain.find(b"\n", at + SLICE)
        if cut < 0:
            break
        yield plain[at : cut + 1]
        at = cut + 1
    yield plain[at:]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) -> (lang, word, n), a row for each word of a run of texts."""

    def flushed() -> pd.DataFrame:
        rows = [(lang, w.decode(), n) for lang, c in counts.items() for w, n in c.items() if w]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    held = 0
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            for part in _slices(text):
                words = part.replace(b"\n", b" ").split(b" ")
                counts.setdefault(lang, Counter()).update(words)
                held += len(words)
            if held > 4 * RUN:
                yield flushed()
                held = 0
    yield flushed()


class _Hashes(dict):
    """Hashes of words as they come; 0 ends a piece, 1 is no word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.update({b"\n": 0, b"": 1})
        if word in (b"\n", b""):
            return self.setdefault(word, 0 if word else 1)
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, text) -> the hashes of a run of texts of one language, with a 0 after each piece."""
    known = _Hashes()
    held: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            for part in _slices(text):
                ids = np.fromiter(map(known.__getitem__, (part + b"\n").replace(b"\n", b" \n ").split(b" ")), np.uint64)
                held.setdefault(lang, []).append(ids[ids != 1])
                sizes[lang] += len(held[lang][-1])
            if sizes[lang] > RUN:
                yield lang, np.concatenate(held.pop(lang))
                sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, np.concatenate(parts)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _pairs(a: np.ndarray, b: np.ndarray, lang: str) -> np.ndarray:
    return _mixed(_mixed(a ^ _salt(lang)) + b)


def _slots(x: np.ndarray) -> np.ndarray:
    return x >> np.uint64(64 - (TABLE_BITS - 1).bit_length())


def bit_table(hashes: DataFrame) -> bytes:
    """hashes(h long) -> the table of their slots: one row of 4 KB for each 32768 bits comes to the driver, 16 MB in all."""
    bits = (TABLE_BITS - 1).bit_length()
    slot = F.shiftrightunsigned("h", 64 - bits) + 1  # buckets and their bits count from 1
    rows = hashes.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    table = bytearray(TABLE_BITS // 8)
    for r in rows:
        table[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
    return bytes(table)


def _holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    s = _slots(hashes)
    return (table[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _frequent_words(table: np.ndarray, lang: str, ids: np.ndarray) -> np.ndarray:
    """ids with 0 for the words that are not frequent: nothing frequent goes on over them."""
    return np.where(_holds(table, _mixed(ids ^ _salt(lang))) & (ids > 1), ids, np.uint64(0))


def pair_rows(words) -> Callable:
    """Counts of the hashed neighbours that are both frequent words, for the pair table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(words.value, np.uint8)
        for lang, ids in _hashed(batches):
            ids = _frequent_words(table, lang, ids)
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            h, n = np.unique(_pairs(ids[:-1][both], ids[1:][both], lang) >> np.uint64(64 - PAIR_BITS), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    return rows


def window_rows(words, pairs) -> Callable:
    """Counts of the longest windows, from two words on: w1 to w4, 0 where padded."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, pair_table = np.frombuffer(words.value, np.uint8), np.frombuffer(pairs.value, np.uint8)
        for lang, ids in _hashed(batches):
            ids = np.concatenate((_frequent_words(table, lang, ids), np.zeros(LONGEST, np.uint64)))
            goes_on = (ids[:-1] > 0) & (ids[1:] > 0)
            goes_on[goes_on] = _holds(pair_table, _pairs(ids[:-1][goes_on], ids[1:][goes_on], lang))
            at = np.flatnonzero(goes_on[: len(goes_on) - LONGEST + 2])
            columns, live = [ids[at]], np.ones(len(at), bool)
            for k in range(1, LONGEST):  # the lead columns
                live = live & goes_on[at + k - 1]
                columns.append(np.where(live, ids[at + k], np.uint64(0)))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(at), bool)
            if len(at):
                new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            starts = np.flatnonzero(new)
            yield pd.DataFrame({"lang": lang, **{f"w{k + 1}": c[starts].view(np.int64) for k, c in enumerate(columns)}, "n": np.diff(np.append(starts, len(at)))})

    return rows


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs(lang, text) -> words(lang, word, h, n) and phrases(lang, w1, w2, w3, w4, n) that occur `least` times or more.

    A row of words with null word holds the language's number of words; shorter phrases end in zeros. Null lang counts as
    `und`, null text as empty; repeated rows count each time, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    counted = rows.mapInPandas(_word_counts, "lang string, word string, n long")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).select("lang", "word", F.xxhash64("word").alias("h"), "n"), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("h"), "n")
    frequent = words.filter(F.col("n") >= least)

    def salted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            salts = np.array([_salt(lang) for lang in pdf["lang"]], np.uint64)
            yield pd.DataFrame({"h": _mixed(pdf["h"].to_numpy(np.int64).view(np.uint64) ^ salts).view(np.int64)})

    send = spark.sparkContext.broadcast
    word_table = send(bit_table(frequent.select("lang", "h").mapInPandas(salted, "h long")))
    pairs = rows.mapInPandas(pair_rows(word_table), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    pair_table = send(bit_table(pairs.select(F.shiftleft("h", 64 - PAIR_BITS).alias("h"))))
    parts, split = rows.rdd.getNumPartitions(), spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    size = int(split) if split.isdigit() else int(split[:-1]) << {"k": 10, "m": 20, "g": 30}[split[-1]]
    together = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-parts * size // max(size, PART_BYTES))))
    windows = together.mapInPandas(window_rows(word_table, pair_table), "lang string, w1 long, w2 long, w3 long, w4 long, n long")
    summed = spark.sql(
        """SELECT lang, w1, w2, coalesce(w3, 0) AS w3, coalesce(w4, 0) AS w4, n
           FROM (SELECT lang, w1, w2, w3, w4, sum(n) AS n FROM {windows} GROUP BY lang, w1, w2, ROLLUP (w3, w4))
           WHERE n >= {least} AND NOT (w3 <=> 0) AND NOT (w4 <=> 0)""",  # null: summed away; 0: padded
        windows=windows,
        least=int(least),
    )
    return frequent.unionByName(total), written(summed, "phrases")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """docs(lang, text) -> each language's `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Words, pieces and counts are as in phrases(). A candidate is cut where 2000000 * a / (l + r) is least (ties: the
    shortest first part); one whose words lie within a longer candidate that has `percent` of its occurrences or more is dropped.
    Order: score and a descending, phrase in the order of its UTF-8 bytes.
    """
    words, found = phrases(docs, least)
    keys = ["w1", "w2", "w3", "w4"]
    length = F.when(F.col("w4") != 0, 4).when(F.col("w3") != 0, 3).otherwise(2)
    zero = F.lit(0).cast("long")
    candidates = found.select("lang", *keys, F.col("n").alias("a"), F.array(*keys).alias("w"), length.alias("length"))
    known = found.select("lang", *keys, F.col("n").alias("f")).unionByName(words.filter("word IS NOT NULL").select("lang", F.col("h").alias("w1"), *(zero.alias(k) for k in keys[1:]), F.col("n").alias("f")))

    def part(first, count) -> list:
        """Columns p1 to p4 of the words from `first` on, padded."""
        return [F.when(count >= i, F.get("w", first + i - 2)).otherwise(zero).alias(f"p{i}") for i in range(1, 5)]

    p = ["p1", "p2", "p3", "p4"]
    parts = known.toDF("lang", *p, "f")
    # every cut asks for two parts, in one join
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    asked = cuts.select("lang", *keys, "length", "a", "k", F.lit(True).alias("left"), *part(F.lit(1), F.col("k"))).unionByName(
        cuts.select("lang", *keys, "length", "a", "k", F.lit(False).alias("left"), *part(F.col("k") + 1, F.col("length") - F.col("k")))
    )
    sides = asked.join(parts, ["lang", *p]).groupBy("lang", *keys, "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("CAST((2000000BD * CAST(a AS DECIMAL(20))) div (CAST(l AS DECIMAL(20)) + r) AS BIGINT)")
    best = sides.withColumn("score", score).groupBy("lang", *keys, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # longer candidates name the shorter ones that they hold
    inner = candidates.filter("length > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    covered = inner.select("lang", *part(F.col("at"), F.col("size")), "a").groupBy("lang", *p).agg(F.max("a").alias("longer")).toDF("lang", *keys, "longer")
    kept = best.join(covered, ["lang", *keys], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20)") * 100 < F.col("a").cast("decimal(20)") * percent))

    # ties at the edge stay until their phrases are known
    ahead = kept.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a")))).filter(F.col("place") <= top)
    ahead = ahead.select("lang", *keys, "a", "cut")
    spelled = (
        ahead.select("lang", *keys, F.posexplode(F.array(*keys)).alias("i", "h"))
        .filter("h <> 0")
        .join(words.filter("word IS NOT NULL").select("lang", "h", "word"), ["lang", "h"])
        .groupBy("lang", *keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    named = ahead.join(spelled, ["lang", *keys]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank).filter(F.col("rank") <= top)
    sizes = words.filter("word IS NULL").select("lang", "n")
    return named.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS piece_id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT piece_id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
y AS (SELECT lang, x AS w1, lead(x, 1) OVER z AS w2, lead(x, 2) OVER z AS w3, lead(x, 3) OVER z AS w4 FROM o WINDOW z AS (PARTITION BY piece_id ORDER BY i)),
j AS (SELECT lang, w1 AS w, 1 AS k, count(*) AS f FROM y GROUP BY ALL HAVING f >= 30
      UNION ALL SELECT lang, concat_ws(' ', w1, w2), 2, count(*) AS f FROM y WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 30
      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 3, count(*) AS f FROM y WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 30
      UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4), 4, count(*) AS f FROM y WHERE w4 IS NOT NULL GROUP BY ALL HAVING f >= 30),
g AS (SELECT concat(lang, chr(10), w) AS key, lang, string_split(w, ' ') AS w, k, f FROM j),
c AS (SELECT lang, w, k AS len, f AS a FROM g WHERE k >= 2),
x AS (SELECT *, unnest(range(1, len)) AS k FROM c),
z AS (SELECT *, concat(lang, chr(10), array_to_string(w[:k], ' ')) AS left_key, concat(lang, chr(10), array_to_string(w[k + 1:], ' ')) AS right_key FROM x),
s AS (SELECT z.lang, z.w, z.a, z.k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score FROM z JOIN g l ON l.key = left_key JOIN g r ON r.key = right_key),
b AS (SELECT lang, w, a, unnest(arg_min({'l': l, 'r': r, 'score': score}, (score, k))) FROM s GROUP BY lang, w, a),
v AS (SELECT lang, w[i:i + z - 1] AS w, max(a) AS longer FROM c, (VALUES (1), (2), (3)) y(i), (VALUES (2), (3)) t(z) WHERE z < len AND i + z - 1 <= len GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.w = b.w WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
f AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase, a, l, r, score FROM e)
SELECT f.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM f JOIN n ON n.lang = f.lang WHERE rank <= 2000
"""
