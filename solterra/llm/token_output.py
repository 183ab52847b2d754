"""Token-id output: a static range asymmetric numeral system (rANS, Duda 2013) over shared frequencies.

A store is a folder with two Parquet tables, so that Spark's committer makes each file whole or absent:
`table` (token, freq) and `frames` (part, block, start_in_part, n_tokens, n_docs, frame). A frame is
self-contained bytes: header, document index, checkpoints and 24-bit words. Frames are independent
of each other; inside a frame, token i belongs to lane i mod LANES, and every EVERY steps the states
of all lanes and the place in the word stream are kept, so that each segment decodes by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, lean, remove, scratch
from .tokens import Pieces

MAGIC = b"RNS2"
LANES = 2048
EVERY = 64
#: Tokens after which a frame is closed, at a document's end.
TARGET = 1 << 19
SCALE = 20
#: States lie from 2**LOW_BITS to 2**(LOW_BITS + WORD_BITS).
LOW_BITS, WORD_BITS = 28, 24
HEAD = "<4sBxHIIIIII"  # magic, scale, lanes, every, tokens, docs, words, crc of ids, crc of the body


def normalised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Integer frequencies that sum to 2**scale; every token that occurs has one at least."""
    counts = np.asarray(counts, dtype=np.float64)
    if not counts.sum():
        return np.zeros(len(counts), np.int64)
    total = 1 << scale
    if np.count_nonzero(counts) > total:
        raise ValueError("more tokens than slots")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (total / counts.sum()))), 0).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    k = 0
    while (gap := total - int(freq.sum())) != 0:
        i = order[k % len(order)]
        if gap > 0:
            freq[i] += gap if k == 0 else 1
        elif freq[i] > 1:
            freq[i] -= min(-gap, int(freq[i]) - 1, max(1, int(freq[i]) // 64))
        k += 1
    return freq


class Coder:
    """Encodes and decodes blocks of ids with one frequency table.

    States stay below 2**52 and words have 24 bits, so that a quotient of float64 is exact once rounded down
    and one word at most leaves or enters for each token.
    """

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = scale, np.asarray(freq, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, dtype=np.int64))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States at each checkpoint (segments x lanes), word offset of each, and the words."""
        n, steps = len(ids), -(-len(ids) // LANES)
        f, c = self.freq[ids].astype(float), self.start[ids].astype(float)
        if n and not f.all():
            raise ValueError("a token without frequency")
        most, grown, word = f * 2.0 ** (LOW_BITS + WORD_BITS - self.scale), 2.0**self.scale - f, 2.0**WORD_BITS
        x = np.full(LANES, 2.0**LOW_BITS)
        states, out, sizes = [], [], np.zeros(steps, np.int64)
        for s in range(steps - 1, -1, -1):
            a, b = s * LANES, min(n, (s + 1) * LANES)
            v = x[: b - a]
            full = np.flatnonzero(v >= most[a:b])
            if len(full):
                old = v[full]
                new = np.floor(old / word)
                out.append((old - new * word).astype(np.uint32))
                sizes[s] = len(full)
                v[full] = new
            v += np.floor(v / f[a:b]) * grown[a:b]
            v += c[a:b]
            if s % EVERY == 0:
                states.append(x.astype(np.uint64))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])[: steps or 1 : EVERY] if steps else np.zeros(0)
        return np.array(states[::-1], np.uint64).reshape(-1, LANES), np.asarray(offsets, np.uint32), words

    def decode(self, n: int, states: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
        """All segments at once; states and offsets may also be those of a run of segments, n its tokens."""
        segments = len(states)
        if not n:
            return np.zeros(0, np.uint32)
        x = states.astype(np.uint64)
        at = offsets.astype(np.int64)
        words = np.concatenate([words, np.zeros(1, np.uint32)]).astype(np.uint64)
        ids = np.zeros((segments, EVERY, LANES), np.uint32)
        mask, shift, word = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(WORD_BITS)
        steps, tail = -(-n // LANES), n % LANES or LANES
        for s in range(min(EVERY, steps)):
            live = segments if (segments - 1) * EVERY + s < steps else segments - 1
            v = x[:live]
            low = v & mask
            sym = self.slot[low]
            ids[:live, s] = sym
            v[:] = self.freq[sym] * (v >> shift) + low - self.start[sym]
            need = v < np.uint64(1 << LOW_BITS)
            if live == segments and (segments - 1) * EVERY + s == steps - 1:
                need[-1, tail:] = False  # these lanes have no token in the last step
            took = need.sum(axis=1)
            if took.any():
                rank = np.cumsum(need, axis=1) - 1 + at[:live, None]
                v[need] = (v[need] << word) | words[rank[need]]
                at[:live] += took
        return ids.reshape(-1)[:n]


def pack(coder: Coder, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    states, offsets, words = coder.encode(ids)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    body = index + states.astype("<u8").tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u4").view("u1").reshape(-1, 4)[:, :3].tobytes()
    return struct.pack(HEAD, MAGIC, coder.scale, LANES, EVERY, len(ids), len(doc_ids), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpack(coder: Coder, frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a frame; both checksums are verified."""
    magic, scale, lanes, every, n, docs, n_words, crc_ids, crc_body = struct.unpack_from(HEAD, frame)
    body = memoryview(frame)[struct.calcsize(HEAD) :]
    if magic != MAGIC or (scale, lanes, every) != (coder.scale, LANES, EVERY) or zlib.crc32(body) != crc_body:
        raise ValueError("damaged frame")
    segments = -(-n // (LANES * EVERY))
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, count, at)
        at += got.nbytes
        return got

    keys, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    states, offsets, words = take("<u8", segments * LANES).reshape(-1, LANES), take("<u4", segments), take("u1", 3 * n_words).reshape(-1, 3)
    words = words[:, 0] | words[:, 1].astype(np.uint32) << 8 | words[:, 2].astype(np.uint32) << 16
    ids = coder.decode(n, states, offsets, words)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("decoded ids differ from those encoded")
    return [None if z else int(k) for k, z in zip(keys, nulls)], lengths, ids


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, row = Pieces.load(path), TaskContext.get().partitionId() << 40
        end = np.array([end_id], pieces.dtype).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [pieces.encode(t.as_py()) + end for t in part.column("text")]
                at = pa.array(range(row, row + len(ids)), pa.int64())
                row += len(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), at, pa.array(ids, pa.binary())], ["doc_id", "th", "row", "ids"])

    return lean(run)


def _histogram(dtype: str):
    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                more = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(lo, 500).to_pylist()), dtype), minlength=len(total))
                more[: len(total)] += total
                total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

    return lean(run)


def _frames(dtype: str, freq: np.ndarray):
    def run(batches):
        from pyspark import TaskContext

        coder, part, width = Coder(freq), TaskContext.get().partitionId(), np.dtype(dtype).itemsize
        block, start = 0, 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def out():
            nonlocal block, start, keys, held, size
            ids = np.frombuffer(b"".join(held), dtype).astype(np.uint32)
            lengths = [len(h) // width for h in held]
            row = pa.RecordBatch.from_pylist([{"part": part, "block": block, "start_in_part": start, "n_tokens": len(ids), "n_docs": len(keys), "frame": pack(coder, keys, lengths, ids)}], FRAME)
            block, start, keys, held, size = block + 1, start + len(ids), [], [], 0
            return row

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                keys.append(doc)
                held.append(ids.as_py())
                size += len(held[-1]) // width
                if size >= TARGET:
                    yield out()
        if keys:
            yield out()

    return lean(run)


FRAME = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("frame", pa.binary())])


def _read(freq: np.ndarray, offsets: dict[int, int]):
    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for r in range(batch.num_rows):
                part, start = batch.column("part")[r].as_py(), batch.column("start_in_part")[r].as_py()
                keys, lengths, ids = unpack(coder, batch.column("frame")[r].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                begin = offsets[part] + start + ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begin, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array([batch.column("block")[r].as_py()] * len(keys), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "block"])

    return lean(run)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int) -> None:
    """Writes the store: ids of every whole text (null: empty) with end_id after each, in ascending doc_id.

    Null doc_ids come first; rows with the same doc_id stand in order of their text's xxhash64. Each text is
    encoded once, into a table of ids; the frequency table counts every token of it. The driver gets one row for each
    token of the vocabulary at most.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    coded = tables.written(rows.mapInArrow(_encode(path, end_id), "doc_id long, th long, row long, ids binary"), "ids")
    dtype = Pieces.load(path).dtype
    counted = coded.select("ids").mapInArrow(_histogram(dtype), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r["token"] for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    freq = normalised(counts)
    used = np.flatnonzero(freq)
    spark.createDataFrame(list(zip(used.tolist(), freq[used].tolist())), "token long, freq long").coalesce(1).write.parquet(f"{out}/table")
    # rows of one doc_id, or of none, may lie in several parts
    ordered = coded.repartitionByRange("doc_id", "th", "row").sortWithinPartitions("doc_id", "th", "row").select("doc_id", "ids")
    ordered.mapInArrow(_frames(dtype, freq), "part long, block long, start_in_part long, n_tokens long, n_docs long, frame binary").write.parquet(f"{out}/frames")
    remove(spark, tables.path)


def read_frequencies(spark: SparkSession, out: str) -> np.ndarray:
    rows = spark.read.schema("token long, freq long").parquet(f"{out}/table").collect()
    freq = np.zeros(max([0, *(r["token"] for r in rows)]) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["freq"]
    return freq


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, block of each document, decoded from the store's frames.

    start counts the ids of all documents before; per-part totals, one row a file, are summed by the driver.
    """
    frames = spark.read.schema("part long, block long, start_in_part long, n_tokens long, n_docs long, frame binary").parquet(f"{out}/frames")
    total, offsets = 0, {}
    for r in sorted(frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        offsets[r["part"]] = total
        total += r["n"]
    return frames.select("part", "block", "start_in_part", "frame").mapInArrow(_read(read_frequencies(spark, out), offsets), "doc_id long, start long, n_tokens long, ids_crc32 long, part long, block long")


def token_output(docs: DataFrame, path: str, end_id: int, out: str | None = None) -> DataFrame:
    """write_tokens, then read_tokens. out: the store's folder (a new one in the scratch folder if None)."""
    out = out or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, end_id)
    return read_tokens(docs.sparkSession, out)
