"""Token counts: pieces are counted once for each distinct pre-token and joined to each document's
pre-token frequencies; ids of whole documents are never made.

The distinct pre-tokens are split by how often they occur. Those above a cutoff, at most `HOT` of them
whatever the input's size, go to every task; the rest are joined with a shuffle. By construction no
pre-token of the rest holds more than 1/HOT of all occurrences, so that join has no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .tokens import Pieces

#: Pre-tokens sent to each task: about 20 MB in a Python worker.
HOT = 1 << 17
#: Distinct pre-tokens a task holds before it passes on what it has counted.
HELD = 400_000


def _count_pretokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = Pieces.load(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column("text"):
                seen.update(pieces.of(text.as_py())[0])
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    return lean(run)


def _measure(path: str):
    def run(batches):
        pieces = Pieces.load(path)
        for batch in batches:
            ids = pieces.ids(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array([len(x) for x in ids], pa.int64())], ["piece", "n", "k"])

    return lean(run)


def _per_document(path: str, hot: dict[str, int]):
    def run(batches):
        from pyspark import TaskContext

        pieces, row = Pieces.load(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                words, found = pieces.of(text)
                freq = Counter(words)
                known = sum(map(int.__mul__, map(hot.get, freq, _zeros()), freq.values()))
                # the key of a document's own row matches no pre-token and is spread over the tasks
                out.append((row, doc, len((text or "").encode()), known + len(found), f"\x00{row % 4093}", 0))
                out += [(row, doc, 0, 0, w, n) for w, n in freq.items() if w not in hot]
                row += 1
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return lean(run)


def _zeros():
    while True:
        yield 0


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "doc_id", "n_bytes", "known", "piece", "freq"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text, ...).

    path: a tokenizers JSON file whose added tokens are plain strings; these count one token each where
    they stand in a text. No begin or end token, no truncation. Null and empty texts have 0 bytes and
    0 tokens; repeated doc_ids and null doc_ids keep a row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = rows.select("text").mapInArrow(_count_pretokens(path), "piece string, n long")
    vocab = seen.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_measure(path), "piece string, n long, k long")
    vocab = written(vocab, "pretokens")

    # 8 classes to each doubling: at most a few hundred rows, whatever the vocabulary
    level = F.floor(F.log2("n") * 8)
    total, cutoff = 0, None
    for r in sorted(vocab.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):
        total += r["count"]
        if total > HOT:
            break
        cutoff = r["l"]
    is_hot = F.lit(False) if cutoff is None else level >= cutoff
    hot = {r["piece"]: r["k"] for r in vocab.where(is_hot).select("piece", "k").collect()}

    each = rows.mapInArrow(_per_document(path, hot), "row long, doc_id long, n_bytes long, known long, piece string, freq long")
    rest = vocab.where(~is_hot).select("piece", "k")
    # a single equi-join; the whole vocabulary's rest is never broadcast
    summed = each.join(rest.hint("merge"), "piece", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("known") + F.col("freq") * F.coalesce("k", F.lit(0))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
