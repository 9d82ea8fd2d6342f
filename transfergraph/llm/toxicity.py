"""Operator 8, toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams, and beginnings of words."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_rows, table

BITS = 20
#: The model is fitted on so many labelled rows at most, those with the smallest seeded hash of doc_id.
FIT_ROWS = 12_000
_spaced = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


#: Beginnings of words of so many bytes are features too: compounds and inflections of one stem share them, so a language with few labelled rows has enough evidence.
PREFIXES = (4, 5, 6, 7, 8)


def features(text: bytes | None) -> np.ndarray:
    """Hashed places of the words, word pairs, pairs with one word between, and beginnings of distinct words, without ASCII case and punctuation."""
    words = (text or b"").lower().translate(_spaced).split()
    h = np.fromiter(map(xxh64_intdigest, words, repeat(8)), np.uint64, len(words))
    odd = np.uint64(0x9E3779B97F4A7C15)
    two = h[:-1] * odd + h[1:]
    skip = (h[:-2] * odd + h[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    starts = {w[:k] for w in set(words) for k in PREFIXES if len(w) > k}
    begin = np.fromiter(map(xxh64_intdigest, starts, repeat(9)), np.uint64, len(starts))
    return ((np.concatenate((h, two, skip, begin)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_ftrl(rows: list[tuple[np.ndarray, float]], alpha: float = 1.0, beta: float = 1.0, l1: float | None = None, l2: float = 0.01, epochs: int = 4, seed: int = 42) -> tuple[np.ndarray, float]:
    """(weights, bias) from (distinct features, label) rows: per-coordinate rates, L1 keeps a coordinate at 0 until its evidence is over l1.

    By default l1 grows with the square root of the rows, as the noise of a coordinate's evidence does: 22.5 at FIT_ROWS.
    """
    l1 = 22.5 * (len(rows) / FIT_ROWS) ** 0.5 if l1 is None else l1
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb, nb = 0.0, 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + np.sqrt(nx)) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] += g - step * w
            n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), -zb / ((beta + nb**0.5) / alpha)


def held_out(column: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether the row is outside the fit; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias), places being those of the weights that are not 0.

    labels: doc_id, toxic. Only rows outside held_out() are used; of a document with several labels the largest; null labels and
    texts and labels without a doc_id are left out. Whole texts are read; only their distinct places reach the driver, as packed 32-bit
    numbers. Rows that are alike count each; the order of fitting goes by a hash of id and text. No labelled row: no weights, and a bias of 0.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_rows)
    got = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text")).join(sample, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), F.col("y").cast("double"), "text")
    found = map_rows(got, [F.col("h"), F.col("y"), F.col("text")], lambda h, y, t: (h, y, np.unique(features(t)).astype(np.int32).tobytes()), "h long, y double, at binary")
    rows = sorted(((r.h, np.frombuffer(r.at, np.int32), r.y) for r in found.toLocalIterator()), key=lambda r: r[0])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.float32), 0.0
    w, b = fit_ftrl([(x, y) for _, x, y in rows])
    at = np.flatnonzero(w)
    return at, w[at], float(b)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; a null or empty one has the score of the bias alone. Broadcast: 2^20 weights at most.

    Rows are scored one by one, so repeated rows, ties and null ids need no rule; an empty table gives no rows; columns beyond doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: dict[int, np.ndarray] = {}

    def of_row(doc_id: int | None, text: bytes | None) -> tuple:
        at, weights, bias = sent.value
        if not dense:
            dense[0] = np.zeros(1 << BITS, np.float32)
            dense[0][at] = weights
        x = features(text)
        x = np.unique(x[dense[0][x] != 0])
        p = float(1 / (1 + np.exp(-np.clip(dense[0][x].sum(dtype=np.float64) + bias, -35, 35))))
        return doc_id, p, int(p >= threshold)

    return map_rows(docs, [F.col("doc_id"), F.col("text").cast("binary")], of_row, "doc_id long, score double, predicted int")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
