"""Line dedup by winnowing over line hashes (Schleimer et al. 2003), with windows measured in words.

Blank lines are left out of the sequence of line hashes. From each line, the shortest window of following
lines with `min_words` words or more is one winnowing window, and so is the shortest one that ends
in each line. The smallest hash of a window is its fingerprint. Two texts that share a run of lines
with min_words words or more share all windows inside it and so their fingerprints: that guarantee is
what lets windows whose fingerprint stands at a single place of the corpus be dropped. Where it stands
at more, the match is extended to the window's lines on either side; windows that stood earlier in the
corpus are deleted, and as forward and backward windows overlap, all of a repeated run goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, written

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, h, nw of each distinct document's lines that have a word."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.btrim("line", F.lit(SPACES))
    rows = rows.select("doc_id", "th", "pos", line.alias("line")).where(F.length("line") > 0)
    rows = rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", SPACE_RUN, -1)).alias("nw"))
    # rows equal in doc_id and text are one document
    return rows.groupBy("doc_id", "th", "pos").agg(F.first("h").alias("h"), F.first("nw").cast("long").alias("nw"))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, first, last, fp, fpos, wh: the winnowing windows of each document."""
    doc = Window.partitionBy("doc_id", "th")
    rows = _lines(docs).withColumn("e", F.sum("nw").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("b", F.col("e") - F.col("nw"))
    ahead = doc.orderBy("b").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("e").rangeBetween(-(min_words - 1), 0)

    def over(frame):
        return F.struct(F.min(F.struct("h", "pos")).over(frame).alias("fp"), F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), F.sum("nw").over(frame).alias("words"), F.collect_list("h").over(frame).alias("hs"))

    both = rows.select("doc_id", "th", over(ahead).alias("ahead"), over(behind).alias("behind"))
    both = both.select("doc_id", "th", F.explode(F.array("ahead", "behind")).alias("w")).where(F.col("w.words") >= min_words)
    return both.select("doc_id", "th", "w.first", "w.last", F.col("w.fp.h").alias("fp"), F.col("w.fp.pos").alias("fpos"), F.xxhash64("w.hs").alias("wh"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, runs array<struct<first, last>>: what goes, for documents where anything goes."""
    found = written(windows(docs, min_words), "windows")
    place = F.struct("doc_id", "th", "fpos")
    again = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z")).where(~F.col("a").eqNullSafe(F.col("z"))).select("fp")
    joined = written(found.join(again.hint("merge"), "fp", "left_semi"), "joined")
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", "th", "first", "last")
    earliest = joined.groupBy("wh").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = joined.join(earliest.hint("merge"), "wh").where(place > F.col("earliest"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_lines, n_removed: the documents without later repeats of runs of lines.

    Earlier means a smaller doc_id (null doc_ids first), then the text's hash, then the line. Lines are equal
    if they are without the spaces around them. Runs of fewer than min_words words stay, wherever
    they repeat. Blank lines inside a deleted run go with it. Null texts stay null with 0 lines, an empty
    text has one; rows equal in doc_id and text are one document, and get the same result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeated_runs(docs.where(F.col("text").isNotNull()), min_words).withColumnsRenamed({"doc_id": "d", "th": "t"})
    rows = docs.withColumn("th", F.xxhash64("text"))
    rows = rows.join(runs.hint("merge"), rows["doc_id"].eqNullSafe(runs["d"]) & (rows["th"] == runs["t"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    rows = rows.select("doc_id", "text", lines.alias("lines"), F.when(F.col("runs").isNotNull(), kept).alias("kept"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    return rows.select("doc_id", F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"), n.cast("long").alias("n_lines"), F.when(F.col("kept").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"))


SQL = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
w AS (SELECT doc_id, pos, line, len(string_split_regex(line, '[\\x20\\x09-\\x0D]+')) AS nw FROM n WHERE line <> ''),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e FROM w),
b AS (SELECT *, e - nw AS b FROM c),
f AS (SELECT doc_id, min(pos) OVER x AS first, max(pos) OVER x AS last, sum(nw) OVER x AS words, string_agg(line, chr(10)) OVER x AS body FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
 UNION ALL SELECT doc_id, min(pos) OVER x, max(pos) OVER x, sum(nw) OVER x, string_agg(line, chr(10)) OVER x FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
o AS (SELECT doc_id, first, last, min((doc_id, first, last)) OVER (PARTITION BY body) AS earliest FROM f WHERE words >= {MIN_WORDS}),
r AS (SELECT DISTINCT doc_id, first, last FROM o WHERE (doc_id, first, last) > earliest),
g AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first AND r.last),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5 FROM k
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
