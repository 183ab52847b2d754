"""Benchmark decontamination by spaced seeds (Ma et al. 2002), on words.

A word is a run of letters and digits, in lower case. Each mask keeps some of a few neighbouring words
and ignores the others, so that a hash of the kept ones still meets after substitutions. The masks
reach every overlap that counts: wherever the words that may differ stand, one fits between them. Hashes of the
documents are joined with those of the benchmark; each meeting fixes how item and document lie
against each other, and the words that agree in that place are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Fixed masks: 1 keeps a word, 0 ignores it. Every choice of 3 of 13 words that differ, and of as many as SHARE allows
#: in items of SPAN to 12 words, leaves a place for one of them (the tests go through all).
MASKS = ("11101", "100111", "1101001")
#: Words of an item at least.
SPAN = 8
#: An overlap counts when at least SHARE of the words agree in some WINDOW words in a row (all of a shorter item).
WINDOW, SHARE = 13, 0.75
#: Up to this many benchmark hashes (24 bytes each) are sent to every task.
BROADCAST = 1 << 20


def _word_hashes(text):
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    return F.transform(F.filter(F.split(clean, " ", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """keep, pos, h: the masks' hashes at each place of an array column where they fit.

    Neighbouring words are zipped and exploded first, so that hashing is generated code on plain columns.
    """
    near = F.arrays_zip(*(F.slice(words, k + 1, F.size(words)) for k in range(max(map(len, MASKS)))))
    rows = rows.select(*keep, F.posexplode(near).alias("pos", "z")).where(F.col("z")[str(min(map(len, MASKS)) - 1)].isNotNull())
    masked = [F.when(F.col("z")[str(len(m) - 1)].isNotNull(), F.xxhash64(F.lit(n), *(F.col("z")[str(k)] for k, bit in enumerate(m) if bit == "1"))) for n, m in enumerate(MASKS)]
    return rows.select(*keep, "pos", F.explode(F.array(*masked)).alias("h")).where(F.col("h").isNotNull())


def _agree(doc_words, item_words, shift):
    """Column: 1 for each word k of the item that agrees with the document's word shift + k, else 0."""
    return F.transform(item_words, lambda w, k: F.when(F.get(doc_words, shift + k) == w, 1).otherwise(0))


def matches(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, th, item_id: each pair of a document and an item that overlap. docs: doc_id, text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _word_hashes(F.col("text").cast("string")).alias("iw")).dropDuplicates()
    items = written(items.where(F.size("iw") >= SPAN), "items")
    seeds = _seeds(items, "iw", "item_id").withColumnRenamed("pos", "ipos")

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), _word_hashes(F.col("text")).alias("dw"))
    spread = _seeds(rows, "dw", "doc_id", "th")
    # a benchmark of proven size goes to every task; a larger one is joined with a shuffle
    known = seeds.select("h", "item_id", "ipos")
    known = F.broadcast(known) if known.limit(broadcast + 1).count() <= broadcast else known.hint("merge")
    pairs = spread.join(known, "h").select("doc_id", "th", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    pairs = pairs.join(items, "item_id").withColumnsRenamed({"doc_id": "d", "th": "t"})
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = texts.join(pairs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    # the row numbers keep the optimizer from computing what stands before them once for each element
    row = F.monotonically_increasing_id()
    met = texts.select("doc_id", "th", "item_id", "iw", "shift", _word_hashes(F.col("text")).alias("dw"), row.alias("r1"))
    met = met.select("doc_id", "th", "item_id", "iw", "r1", _agree(F.col("dw"), F.col("iw"), F.col("shift")).alias("same"), row.alias("r2"))
    width = F.least(F.size("iw"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("iw") - width + 1)
    best = F.array_max(F.transform(starts, lambda k: F.aggregate(F.slice("same", k, width), F.lit(0), lambda a, x: a + x)))
    return met.where((F.col("r1") >= 0) & (F.col("r2") >= 0) & (best >= F.ceil(width * SHARE))).select("doc_id", "th", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, th, contaminated, n_items, items (array of item_ids, ascending) for each row of docs.

    Items of fewer than SPAN words are no evidence and match nothing. Null and empty texts are clean. Rows
    equal in doc_id and text get the same result; equal items with two item_ids are both named.
    th is the text's xxhash64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = matches(docs, benchmark, broadcast).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    rows = rows.join(found.hint("merge"), rows["doc_id"].eqNullSafe(found["d"]) & (rows["th"] == found["t"]), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return rows.select("doc_id", "th", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that overlap an item of the benchmark.

    Null and empty texts stay, as does everything if the benchmark is empty; repeated rows stay or go together.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d, t = free_name(docs, "d"), free_name(docs, "t")
    found = matches(plain, benchmark).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    return docs.join(found.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "left_anti")


#: The overlap rule alone, without seeds.
SQL = f"""
WITH t AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS iw FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT * FROM t WHERE len(iw) >= {SPAN}),
d AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS dw FROM documents),
iw AS (SELECT item_id, unnest(iw) AS w, generate_subscripts(iw, 1) AS ip FROM i),
dw AS (SELECT doc_id, unnest(dw) AS w, generate_subscripts(dw, 1) AS dp FROM d),
c AS (SELECT doc_id, item_id, dp - ip AS shift FROM iw JOIN dw USING (w) GROUP BY ALL HAVING count(*) >= 5),
s AS (SELECT c.doc_id, c.item_id, [CASE WHEN c.shift + k >= 1 AND d.dw[c.shift + k] = i.iw[k] THEN 1 ELSE 0 END for k in generate_series(1, len(i.iw))] AS same FROM c JOIN i USING (item_id) JOIN d USING (doc_id)),
m AS (SELECT DISTINCT doc_id, item_id FROM s WHERE len(list_filter(generate_series(1, greatest(1, len(same) - {WINDOW - 1})), lambda k: list_sum(same[k:k + {WINDOW - 1}]) >= ceil(least(len(same), {WINDOW}) * {SHARE}))) > 0),
g AS (SELECT doc_id, count(*) AS n, list_sort(list(item_id)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(array_to_string(items, ','), '') AS items FROM documents LEFT JOIN g USING (doc_id)
"""
