"""Quality rules by distribution divergence: Jensen-Shannon distances of a document's character classes and
common words from its language's reference, with guards on length. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, words_of, written

#: Windows of so many words (a power of two) that occur twice or more are repeats.
REPEAT = 8
#: Common words in a language's reference; parts into which a language's words are dealt for their first ranking.
COMMON, PARTS = 20, 16
#: References are broadcast up to so many languages, and joined by a shuffle beyond.
BROADCAST_LANGUAGES = 4096
#: Below so many words a histogram says little, and the base rules alone decide.
GUARD_WORDS = 50
#: Distances (0 to 1) from which a document fails.
MAX_CLASS, MAX_COMMON = 0.25, 0.37
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other")
POINTS = ".,;:!?'\"()-"


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the row itself, and what both the references and the verdicts need; each step is one projection."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("*", F.length("t").alias("n"), F.regexp_replace("t", "\\p{L}+", "").alias("rest"), F.regexp_replace(F.lower("t"), "[^\\p{L}]+", " ").alias("letters"))

    # each class is taken out of what the others left, the most frequent first, so that later ones read little
    last, taken = "rest", []
    for name, chars in (("space", SPACES), ("point", POINTS), ("digit", "0123456789"), ("symbol", SYMBOLS)):
        rows = rows.withColumn(f"no_{name}", F.translate(last, chars, ""))
        taken.append((F.length(last) - F.length(f"no_{name}")).cast("long").alias(name))
        last = f"no_{name}"
    rows = rows.select("*", (F.col("n") - F.length("rest")).alias("n_letters"), (F.col("n") - F.length(F.regexp_replace("t", "\\p{Lu}+", ""))).alias("upper"), *taken)
    rows = rows.withColumn("lower", F.col("n_letters") - F.col("upper")).withColumn("other", F.col("n") - F.col("n_letters") - F.col("digit") - F.col("space") - F.col("point") - F.col("symbol"))
    return rows.select("doc_id", "lang", "t", "row", "n", "letters", "space", "symbol", F.array(*(F.col(c).cast("double") for c in CLASSES)).alias("classes"))


def references(docs: DataFrame) -> DataFrame:
    """lang, ref_classes, common array<string>, ref_common: a row for each language, written with '=' before its name, and one with
    lang '' for all documents. Shares of the common words; the last one is that of all other words."""
    rows = _columns(docs).withColumn("lang", F.concat(F.lit("="), "lang"))
    # each row counts for its language and for the reference of all
    classes = rows.groupBy("lang").agg(*(F.sum(F.col("classes")[k]).alias(c) for k, c in enumerate(CLASSES)))
    words = rows.select("lang", F.explode(F.split("letters", " ")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("k"))
    classes, words = written(classes, "classes"), written(words, "words")
    all_classes = classes.select(F.lit("").alias("lang"), *CLASSES).groupBy("lang").agg(*(F.sum(c).alias(c) for c in CLASSES))
    all_words = words.groupBy(F.lit("").alias("lang"), "w").agg(F.sum("k").alias("k"))
    classes = classes.where("lang IS NOT NULL").unionByName(all_classes)
    words = words.where("lang IS NOT NULL").unionByName(all_words)
    # ranked within parts first, so that a frequent language's words are no single task's; the rank's bound is
    # pushed below each shuffle
    ranked = words.withColumn("part", F.pmod(F.hash("w"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("k"), "w"))).where(F.col("r") <= COMMON)
    common = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "k"))).alias("c")).join(words.groupBy("lang").agg(F.sum("k").alias("total")), "lang")
    known = F.transform("c", lambda x: x["k"] / F.col("total"))
    common = common.select("lang", F.transform("c", lambda x: x["w"]).alias("common"), known.alias("known"))
    common = common.select("lang", "common", F.concat("known", F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("known", F.lit(0.0), lambda a, x: a + x)))).alias("ref_common"))
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    shares = classes.select("lang", F.array(*(F.try_divide(F.col(c), total) for c in CLASSES)).alias("ref_classes"))
    return written(shares.join(common, "lang", "left"), "references")


def _distance(p, q):
    """Column: Jensen-Shannon distance, base 2, of two arrays of shares."""

    def term(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda a, x: a + x)))


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the column words: words inside windows of REPEAT words that occur twice or more."""
    rows = rows.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    # windows double: a hash of two neighbours of half the width
    wins, width = F.col("wh"), 1
    while width < REPEAT:
        rows = rows.withColumn("wins", F.zip_with(F.slice(wins, F.lit(1), F.greatest(F.size(wins) - width, F.lit(0))), F.slice(wins, width + 1, F.size(wins)), lambda a, b: F.xxhash64(a, b)))
        wins, width = F.col("wins"), 2 * width
    placed = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # most texts repeat nothing, and are not sorted
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct(wins)) < F.size(wins), placed))
    s = F.col("placed")
    twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    rows = rows.withColumn("starts", F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    p = F.col("starts")
    covered = F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(REPEAT), F.coalesce(F.get(p, k + 1) - v, F.lit(REPEAT)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("wh", "wins", "placed", "starts")


def quality(docs: DataFrame, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON, whole: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang, ...): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, common_distance, and with whole the row itself as struct row.

    A document is compared with the reference of its lang, or with that of all documents where lang is null. The distances are null, and base_failed alone decides, below GUARD_WORDS words. A null text
    counts as empty: no words, base_failed. The references count all documents; repeated rows count again.
    """
    ref = references(docs)
    rows = _columns(docs)
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select("doc_id", "lang", "row", "n", "letters", "space", "symbol", "classes", words_of(F.col("t")).alias("words"), lines.alias("lines"))
    rows = rows.select("doc_id", "lang", "row", "letters", "classes", "words", F.size("words").cast("long").alias("n_words"), (F.col("n") - F.col("space")).cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    rows = _repeated(rows).drop("words")
    rows = rows.withColumn("lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    # the list is made before the join: after it, it would be made again for each word
    listed = ref.withColumn("listed", F.array_join("common", ","))
    rows = rows.join(F.broadcast(listed) if ref.count() <= BROADCAST_LANGUAGES else listed.hint("merge"), "lang", "left")
    # one character for each word: its place among the common ones, or the one for all others
    words = F.trim("letters")
    code = F.when(words != "", F.array_join(F.transform(F.split(words, " "), lambda w: F.chr(F.find_in_set(w, F.col("listed")) + 64)), "")).otherwise("")
    rows = rows.withColumn("code", F.when((F.col("n_words") >= GUARD_WORDS) & F.col("common").isNotNull(), code))
    size = F.length("code")
    hits = F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: F.try_divide(size - F.length(F.replace(F.col("code"), F.chr(k + 64), F.lit(""))), size))
    rows = rows.withColumn("hits", F.when(size > 0, hits))
    hits = F.concat("hits", F.array(1 - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)))
    total = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)
    long = F.col("n_words") >= GUARD_WORDS
    rows = rows.withColumn("class_distance", F.when(long, _distance(F.transform("classes", lambda x: F.try_divide(x, total)), F.col("ref_classes")))).withColumn("common_distance", F.when(long & F.col("hits").isNotNull(), _distance(hits, F.col("ref_common"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) >= max_class) | (F.coalesce("common_distance", F.lit(0.0)) >= max_common)
    # written, for a reader's filter pushed into the rules would evaluate them many times over
    return written(rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "common_distance", *(["row"] if whole else [])), "verdicts")


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Each row has its own verdict, whatever its doc_id."""
    return quality(docs, whole=True).where("kept").select("row.*")
