"""Language identification by rank-order profiles (Cavnar and Trenkle 1994)."""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Length of a profile, and languages compared at a time.
PROFILE, BLOCK = 400, 256
#: Characters whose n-grams are numbered at a time, and n-grams that a task keeps numbered.
CHUNK, KEPT = 1 << 16, 1_000_000
#: Bits of the slots that find most numbers, and sums that a task keeps before it hands them on.
SLOTS, SUMS = 18, 1_000_000
UNKNOWN = "und"


def held_out(doc_id):
    """Column: crc32 of the doc_id as text, mod 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else that of `_`, which ends words."""
    return np.array([c if chr(c).isalpha() else ord("_") for c in range(0x110000)], np.int64)


def _key(gram: str) -> int:
    """An n-gram as a number: 21 bits for each of its one to three characters."""
    return functools.reduce(lambda k, c: k << 21 | ord(c), gram, 0)


def _grams(keys: np.ndarray) -> list[str]:
    chars = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype(np.uint32)
    chars = np.take_along_axis(chars, np.argsort(chars == 0, axis=1, kind="stable"), axis=1)
    return np.ascontiguousarray(chars).view("U3").ravel().tolist()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their numbers of times, added up over all parts."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return keys, total


class Grams:
    """Numbers n-grams from 1 on, the first ones those given. Words are runs of letters; their n-grams are their letters, and
    the pairs and triples of characters of the word between two `_`."""

    def __init__(self, first: Iterable[str] = ()):
        self.first = list(first)
        self._reset()

    def _reset(self) -> None:
        self.number = {0: 0}
        self.keys, self._crc = np.zeros(1, np.int64), np.zeros(0, np.int64)
        # a slot has one of the keys that hash to it; the others are looked up in number
        self.slot_key, self.slot_number = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
        self._add([_key(g) for g in self.first])

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).view(np.int64)

    def _add(self, keys: list[int]) -> None:
        new = np.array(keys, np.int64)
        numbers = np.arange(len(self), len(self) + len(new))
        self.number.update(zip(keys, numbers.tolist()))
        self.keys = np.concatenate([self.keys, new])
        slot = self._slot(new)
        free = self.slot_key[slot] == 0
        free[slot == 0] = False  # that of 0, no n-gram
        slot, at = np.unique(slot[free], return_index=True)
        self.slot_key[slot], self.slot_number[slot] = new[free][at], numbers[free][at]

    def crc(self) -> np.ndarray:
        """crc32 of each n-gram, by number."""
        new = self.keys[len(self._crc) :]
        if len(new):
            self._crc = np.concatenate([self._crc, np.array([zlib.crc32(g.encode()) for g in _grams(new)], np.int64)])
        return self._crc

    def _at(self, text: str) -> np.ndarray:
        """Numbers of the letter, pair and triple at each character of text but its first and last: the letter itself, it with the
        next one, it between its neighbours. 0 where there is none."""
        x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = x != ord("_")
        here, follows = letter[1:-1], letter[2:]
        keys = np.empty((3, len(x) - 2), np.int64)
        keys[0] = x[1:-1]
        np.bitwise_or(x[1:-1] << 21, x[2:], out=keys[1])
        np.bitwise_or(x[:-2] << 42, keys[1], out=keys[2])
        keys[0] *= here
        keys[1] *= here | follows
        keys[2] *= here
        slot = self._slot(keys)
        out = self.slot_number[slot]
        row, col = np.nonzero(self.slot_key[slot] != keys)
        if len(row):
            other, of = np.unique(keys[row, col], return_inverse=True)
            other = other.tolist()
            self._add([k for k in other if k not in self.number])
            out[row, col] = np.array([self.number[k] for k in other], np.int64)[of]
        return out

    def _sums(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(numbers) * 4 < len(self):
            at, count = np.unique(numbers, return_counts=True)
        else:
            count = np.bincount(numbers)
            at = np.flatnonzero(count)
            count = count[at]
        return (at[1:], count[1:]) if len(at) and at[0] == 0 else (at, count)

    def counts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its n-grams, ascending, and how often each occurs. The numbers hold until the next text."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) >= CHUNK:
                yield from self._held(held)
                held, size = [], 0
            held.append(text)
            size += len(text) + 1
        yield from self._held(held)

    def _held(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(self) > KEPT:
            self._reset()
        around = "\n\n" + "\n".join(texts) + "\n"
        if len(texts) == 1 and len(around) > CHUNK + 2:  # a long text, CHUNK places at a time
            count = np.zeros(0, np.int64)
            for a in range(0, len(around) - 2, CHUNK):
                more = np.bincount(self._at(around[a : a + CHUNK + 2]).ravel(), minlength=len(self))
                more[: len(count)] += count
                count = more
            at = np.flatnonzero(count[1:]) + 1
            yield at, count[at]
            return
        numbers, a = self._at(around), 0
        for text in texts:
            yield self._sums(numbers[:, a : a + len(text) + 1].ravel())
            a += len(text) + 1


def _lowered(texts: pa.Array) -> Iterator[str]:
    return ((text.as_py() or "").lower() for text in texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    made = 0

    def out():
        for lang, parts in sums.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(_grams(keys), pa.string()), pa.array(n)], ["lang", "gram", "n"])
        sums.clear()

    def add(lang, texts):
        nonlocal made
        # a line's end is no letter, so that many texts are counted as one
        for at, count in grams.counts(["\n".join(texts)]):
            sums[lang].append((grams.keys[at], count))
            made += len(at)
        if made > SUMS:
            sums.update({lang: [_merged(parts)] for lang, parts in sums.items()})
            made = sum(len(keys) for [(keys, _)] in sums.values())
            if made > SUMS // 2:
                yield from out()
                made = 0

    for batch in batches:
        held, size = defaultdict(list), defaultdict(int)
        for lang, text in zip(batch.column("lang").to_pylist(), _lowered(batch.column("text"))):
            held[lang].append(text)
            size[lang] += len(text)
            if size[lang] > 16 * CHUNK:
                yield from add(lang, held.pop(lang))
                del size[lang]
        for lang, texts in held.items():
            yield from add(lang, texts)
    yield from out()


def learn(docs: DataFrame) -> DataFrame:
    """lang, r, gram: each language's most frequent n-grams, from all rows of docs(text, lang) with a lang that is
    not null. Ties go to the n-gram that is first in order. A language without a letter has no rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = rows.select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    return written(ranked.select("lang", "r", "gram"), "profiles")


def profile_blocks(learned: DataFrame) -> Iterator[dict[str, list[str]]]:
    """The profiles of all languages, in order of their names, BLOCK languages at a time."""
    langs = sorted(r["lang"] for r in learned.select("lang").distinct().collect())
    for k in range(0, len(langs), BLOCK):
        block = langs[k : k + BLOCK]
        profiles: dict[str, list[str]] = {lang: [] for lang in block}
        for r in sorted(learned.where(F.col("lang").isin(block)).collect(), key=lambda r: (r["lang"], r["r"])):
            profiles[r["lang"]].append(r["gram"])
        yield profiles


def _predict(profiles: dict[str, list[str]], last: bool):
    """Predictions by these profiles where they beat those of the blocks before; the last block leaves the text out."""
    langs = list(profiles)

    def run(batches):
        own = list(dict.fromkeys(g for lang in langs for g in profiles[lang]))
        number = {g: k for k, g in enumerate(own, 1)}
        # place in each profile by number; column 0 stands for every n-gram in none of them
        place = np.full((len(langs), len(own) + 1), -1, np.int32)
        for k, lang in enumerate(langs):
            place[k, [number[g] for g in profiles[lang]]] = np.arange(len(profiles[lang]))
        grams = Grams(own)

        def nearest(at, c):
            if len(at) > PROFILE:  # those that can be among the first, ties at the end included
                least = np.partition(c, len(c) - PROFILE)[len(c) - PROFILE]
                at, c = at[c >= least], c[c >= least]
            at = at[np.lexsort((grams.keys[at], grams.crc()[at], -c))][:PROFILE]
            where = place[:, np.where(at <= len(own), at, 0)]
            out = np.where(where < 0, PROFILE, np.abs(where - np.arange(len(at), dtype=np.int32))).sum(axis=1)
            best = int(np.argmin(out))
            return best, 1.0 - float(out[best]) / (PROFILE * len(at))

        for batch in batches:
            pred, score = batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()
            for row, (at, c) in enumerate(grams.counts(_lowered(batch.column("text")) if langs else ())):
                if len(at):
                    best, near = nearest(at, c)
                    if near > score[row] or (pred[row] == UNKNOWN and score[row] == 0.0):
                        pred[row], score[row] = langs[best], near
            kept = ["doc_id", "held_out"] if last else ["doc_id", "held_out", "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang, ...).

    Profiles of all languages are learned from rows that are not held out and have a lang; their names reach the
    driver, and their profiles, a block at a time. A document's most frequent n-grams,
    in order, are compared with each profile: the distance is the sum of the differences in rank, PROFILE for
    an n-gram that the profile lacks; the smallest wins, at a tie the first name. Equally frequent n-grams of a document are
    in order of their crc32, then of their code points. score is 1 less the
    distance as a share of the largest possible one. Null texts and texts without a letter are
    'und' with score 0, as is every text if nothing could be learned. Repeated rows keep a row each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    blocks = list(profile_blocks(learn(rows.where(~F.col("held_out")).select("text", "lang")))) or [{}]
    rows = rows.select("doc_id", "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for k, profiles in enumerate(blocks):
        last = k + 1 == len(blocks)
        rows = rows.mapInArrow(_predict(profiles, last), f"doc_id long, held_out boolean, {'' if last else 'text string, '}lang_pred string, score double")
    return rows
