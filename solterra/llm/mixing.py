"""Mixing by soft membership: a classifier gives each document's share in each domain, and projected gradient
least squares fits rates, none negative, whose expected domain token totals match the targets.

A document's gradient is divided by its tokens (a diagonal scaling, under which the projection on the
orthant stays the same), so a rate depends on the shares alone: after steps g_1 .. g_k it is the
sequence of max(0, r - share . g). A pass needs only the steps so far; no state is kept for a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, written

#: Labelled documents the classifier is fitted on at most, those with the smallest hashes of their doc_id.
SAMPLE = 6000
STEPS = 60
#: A feature is a word or its first k letters; one of fewer than LEAST fitted documents says nothing about others.
BEGINNINGS, LEAST = (3, 4, 5, 6), 5
#: Features for each domain and weight decay, of which cross-validation takes a pair.
CHOICES = [(n, decay) for n in (32, 128, 512) for decay in (1e-4, 1e-3)]
FOLDS, FIT_STEPS = 5, 150


def _hashes(word: str) -> list[int]:
    """A word's features. It stands for itself without the signs around it."""
    import xxhash

    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    word = word[a:b] or word
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:k], k) for k in BEGINNINGS if len(word) > k)]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = []
        for t in batch.column("text"):
            found = {h for w in set((t.as_py() or "").lower().split()) for h in _hashes(w)}
            got.append(np.sort(np.fromiter(found, "<u4", len(found))).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(got, pa.binary())], ["domain", "x"])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


class _Labelled:
    """Documents as sets of features, with their domains' numbers."""

    def __init__(self, xs: list[np.ndarray], y: np.ndarray, k: int):
        self.y, self.k = y, k
        self.row = np.repeat(np.arange(len(xs), dtype=np.int32), [len(x) for x in xs])
        self.known, at = np.unique(np.concatenate(xs), return_inverse=True)
        self.at = at.astype(np.int32)
        # copies have the same outermost hashes and stand in one fold
        self.fold = np.array([(int(x[0]) * 31 + int(x[-1])) % FOLDS if len(x) else 0 for x in xs])

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """features x domains: the chosen documents that have the feature."""
        return np.stack([np.bincount(self.at[(rows & (self.y == c))[self.row]], minlength=len(self.known)) for c in range(self.k)], axis=1).astype(float)

    def select(self, counts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
        """The features that tell a domain from the others best by the likelihood ratio, at most so many for each domain."""
        able = np.flatnonzero(counts.sum(axis=1) >= LEAST)
        n, total = counts[able].sum(axis=1), sizes.sum()
        chosen = []
        for c, size in enumerate(sizes):
            both = counts[able, c]
            g = np.zeros(len(able))
            for seen, a, b in ((both, n, size), (n - both, n, total - size), (size - both, total - n, size), (total - n - size + both, total - n, total - size)):
                g += seen * np.log(np.maximum(seen, 1e-9) / np.maximum(a * b / total, 1e-9))
            chosen.append(able[np.argsort(-g, kind="stable")[:most]])
        return np.unique(np.concatenate(chosen))

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        place = np.full(len(self.known), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        to = place[self.at]
        out = np.zeros((len(self.y), len(chosen) + 1), np.float32)
        out[self.row[to >= 0], to[to >= 0]] = 1
        out[:, -1] = 1
        return out

    def fitted(self, x: np.ndarray, y: np.ndarray, decay: float) -> np.ndarray:
        w = np.zeros((x.shape[1], self.k), np.float32)
        m, v, target = np.zeros_like(w), np.zeros_like(w), np.eye(self.k, dtype=np.float32)[y]
        shrink = np.full((len(w), 1), decay, np.float32)
        shrink[-1] = 0
        for k in range(1, FIT_STEPS + 1):
            g = x.T @ ((_softmax(x @ w) - target) / len(x)) + shrink * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return w

    def best(self) -> tuple[int, float]:
        """The choice with the least log loss on documents that its fit did not see."""
        loss = dict.fromkeys(CHOICES, 0.0)
        every = self.counts(np.ones(len(self.y), bool))
        for f in np.unique(self.fold):
            out = self.fold == f
            seen, sizes = every - self.counts(out), np.bincount(self.y[~out], minlength=self.k).astype(float)
            for most in dict.fromkeys(n for n, _ in CHOICES):
                if out.all():
                    break
                x = self.matrix(self.select(seen, sizes, most))
                for choice in (c for c in CHOICES if c[0] == most):
                    p = _softmax(x[out] @ self.fitted(x[~out], self.y[~out], choice[1]))
                    loss[choice] -= np.log(np.maximum(p[np.arange(len(p)), self.y[out]], 1e-9)).sum()
        return min(CHOICES, key=lambda c: loss[c])


def fit(docs: DataFrame, labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, features and weights (domains x features + 1) of a softmax regression on the features that occur.

    labelled: doc_id, domain; rows with a null in either say nothing, and of several domains of a doc_id the first by
    name holds. Fitted on SAMPLE labelled documents at most; the number of features and the
    weight decay are those of CHOICES that do best on held-out ones.
    """
    names = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = names.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    got = sorted((r["domain"], bytes(r["x"])) for r in rows.select("domain", "text").mapInArrow(_vectors, "domain string, x binary").collect())
    domains = sorted({d for d, _ in got})
    if len(domains) < 2:
        return domains, np.zeros(0, np.uint32), np.zeros((len(domains), 1))
    y = np.array([domains.index(d) for d, _ in got])
    seen = _Labelled([np.frombuffer(x, "<u4") for _, x in got], y, len(domains))
    most, decay = seen.best()
    chosen = seen.select(seen.counts(np.ones(len(y), bool)), np.bincount(y).astype(float), most)
    w = seen.fitted(seen.matrix(chosen), y, decay)
    return domains, seen.known[chosen], w.T.astype(float)


def _scorer(known: np.ndarray, w: np.ndarray):
    """A function of a text: its shares and its words."""
    # the features of words already met stay in the worker while the fit is the same
    met, at = kept("words", hash((known.tobytes(), w.tobytes())), dict), {int(h): k for k, h in enumerate(known)}

    def of(text: str | None) -> tuple[np.ndarray, int]:
        words = (text or "").lower().split()
        if len(met) > 400_000:
            met.clear()
        found = {len(known)}
        for word in set(words):
            if word not in met:
                met[word] = tuple(at[h] for h in _hashes(word) if h in at)
            found.update(met[word])
        z = w[:, sorted(found)].sum(axis=1)
        p = np.exp(z - z.max())
        return p / p.sum(), len(words)

    return of


def _shares(known: np.ndarray, w: np.ndarray, steps: list[np.ndarray] | None, copies: bool):
    """shares and tokens of each row; with copies, whole rows, whose numbers are their rates on the average."""

    def run(batches):
        import xxhash

        score = _scorer(known, w)
        for batch in batches:
            tokens, share = [], []
            for text in batch.column("text"):
                p, n = score(text.as_py())
                share.append(p)
                tokens.append(n)
            p = np.array(share).reshape(len(tokens), len(w))
            if copies:
                drawn = [xxhash.xxh64_intdigest(f"{d.as_py()} {t.as_py()}".encode("utf-8", "surrogatepass")) >> 11 for d, t in zip(batch.column("doc_id"), batch.column("text"))]
                times = np.floor(rates(p, steps) + np.array(drawn, float) / 2.0**53).astype(int)
                yield batch.take(pa.array(np.repeat(np.arange(len(tokens)), times)))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "shares"])

    return lean(run)


def rates(shares: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(shares))
    for g in steps:
        np.maximum(0, r - shares @ g, out=r)
    return r


def _totals(k: int, steps: list[np.ndarray], moments: bool):
    def run(batches):
        total = np.zeros(k * k if moments else k)
        for batch in batches:
            p = batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n = batch.column("n_tokens").to_numpy()
            total += (p.T @ (p * n[:, None])).ravel() if moments else (rates(p, steps) * n) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["k", "x"])

    return run


def _sum(shares: DataFrame, k: int, steps: list[np.ndarray], moments: bool = False) -> np.ndarray:
    out = np.zeros(k * k if moments else k)
    for r in shares.select("n_tokens", "shares").mapInArrow(_totals(k, steps, moments), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out.reshape(k, k) if moments else out


def descend(shares: DataFrame, domains: list[str], targets: dict[str, float | None]) -> list[np.ndarray]:
    """The steps, from rates of 1. targets: each domain's share of all tokens now; None or absent: as much as it has."""
    k = len(domains)
    now = _sum(shares, k, [])
    if not now.sum():
        return []
    want = np.array([now[c] if targets.get(d) is None else targets[d] * now.sum() for c, d in enumerate(domains)])
    # errors count relative to a domain's tokens, which keeps the problem's eigenvalues within 1 of each other
    weight = 1 / np.maximum(now, 1e-9 * now.sum())
    root, total = np.sqrt(weight), now.sum()
    eta = 1 / np.linalg.eigvalsh(root[:, None] * _sum(shares, k, [], True) * root).max()
    steps: list[np.ndarray] = []
    for _ in range(STEPS):
        gap = now - want
        if np.abs(gap).max() < 1e-5 * total:
            break
        steps.append(eta * weight * gap)
        now = _sum(shares, k, steps)
    return steps


def _rated(k: int, steps: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            p = batch.column("shares").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "shares")), pa.array(rates(p, steps), pa.float64())], ["doc_id", "n_tokens", "shares", "rate"])

    return run


def _prepared(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | None]):
    domains, known, w = fit(docs, labelled)
    if not domains:
        domains, w = ["all"], np.zeros((1, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = written(rows.mapInArrow(_shares(known, w, None, False), "doc_id long, n_tokens long, shares array<double>"), "shares")
    return domains, known, w, shares, descend(shares, domains, targets)


def mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | None]) -> DataFrame:
    """doc_id, n_tokens (words), rate, domain (the likeliest), share (its posterior) for each row of docs.

    labelled: doc_id, domain. Null and empty texts have 0 tokens and the classifier's prior; without labels all
    documents are in one domain and keep rate 1. Rows with equal texts get equal rates.
    """
    domains, _, _, shares, steps = _prepared(docs, labelled, targets)
    best = F.array_max("shares")
    name = F.element_at(F.array(*map(F.lit, domains)), F.array_position("shares", best).cast("int"))
    return shares.mapInArrow(_rated(len(domains), steps), "doc_id long, n_tokens long, shares array<double>, rate double").select("doc_id", "n_tokens", F.round("rate", 9).alias("rate"), name.alias("domain"), F.round(best, 9).alias("share"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float | None]) -> DataFrame:
    """docs, all columns, each row as often as its rate says (0: gone).

    A fraction is a chance, drawn by a hash of doc_id and text, so that the targets hold on the average; rows equal in both get the same.
    Null and empty texts have the classifier's prior; an empty table stays empty, and without labels every row stays.
    """
    _, known, w, _, steps = _prepared(docs, labelled, targets)
    return docs.mapInArrow(_shares(known, w, steps, True), docs.schema)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from labels(doc_id, quality, toxic): toxic, else high or low by quality; rows without are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())
