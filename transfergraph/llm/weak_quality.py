"""Operator 7, quality classifier: heuristic labellers are weighed by expectation-maximisation, their posterior trains a hashed linear scorer."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..plans.cut import materialise
from .common import map_rows, table, text_hash
from .quality_rules import BLANKS, judge

LOW, HIGH, NONE = 0, 1, 2
#: Fixed values: (labeller, low if the number is at or below / above, high if at or above / below); see numbers_of().
LABELLERS = (
    ("words", "less", 20, 80),
    ("symbols_per_word", "more", 0.2, 0.05),
    ("repeated_words", "more", 0.5, 0.15),
    ("lost_lines", "more", 0.5, 0.1),
    ("capitals", "more", 0.4, 0.15),
    ("lines_that_end", "less", 0.3, 0.8),
    ("distinct_words", "less", 0.15, 0.4),
    ("repeated_lines", "more", 0.3, 0.05),
    ("exclamations", "more", 0.3, 0.05),
)
BITS = 18
#: The scorer is fitted on so many rows at most, those with the smallest seeded hash of the text.
FIT_ROWS = 6000


def numbers_of(text: str | None) -> list[float]:
    text = text or ""
    n, chars, symbols, dup, repeats, _, _, n_lines, _, left, _ = judge(text)
    words, lines = text.encode().split(), [x for x in (y.strip(BLANKS) for y in text.split("\n")) if x]
    letters = sum(map(str.isalpha, text))
    some, here = max(n, 1), max(len(lines), 1)
    return [
        n, symbols / some, repeats / some, 1 - left / max(chars, 1), sum(map(str.isupper, text)) / max(letters, 1), sum(x[-1] in ".!?:;\"'”)" for x in lines) / here,
        len(set(words)) / some**0.8, dup / here, sum(w.endswith(b"!") for w in words) / some,
    ]


def votes_of(text: str | None) -> int:
    """The labellers' votes, LOW, HIGH or NONE each, as the digits of a number in base 3."""
    out = 0
    for x, (_, side, low, high) in zip(numbers_of(text), LABELLERS, strict=True):
        vote = (LOW if x < low else HIGH if x >= high else NONE) if side == "less" else (LOW if x > low else HIGH if x <= high else NONE)
        out = out * 3 + vote
    return out


def digits(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)


def expect(pattern: np.ndarray, count: np.ndarray, rounds: int = 200, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of HIGH for each pattern, table[label, labeller, vote] of vote probabilities, share of HIGH).

    Votes are taken as independent given the true label. Starts from the majority of each pattern; `prior` smooths each table.
    """
    v = digits(pattern)
    q = np.clip(((v == HIGH).sum(axis=1) + 0.5) / ((v != NONE).sum(axis=1) + 1), 0.05, 0.95)
    table_, share = np.zeros((2, v.shape[1], 3)), 0.5
    for _ in range(rounds):
        for label, weight in ((LOW, (1 - q) * count), (HIGH, q * count)):
            for vote in (LOW, HIGH, NONE):
                table_[label, :, vote] = ((v == vote) * weight[:, None]).sum(axis=0) + prior
        table_ /= table_.sum(axis=2, keepdims=True)
        share = ((q * count).sum() + prior) / (count.sum() + 2 * prior)
        like = [np.log(table_[label][np.arange(v.shape[1]), v]).sum(axis=1) for label in (LOW, HIGH)]
        new = 1 / (1 + np.exp(np.clip(np.log(1 - share) - np.log(share) + like[0] - like[1], -50, 50)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return q, table_, float(share)


_shape = bytes(97 if chr(c).islower() and c < 128 or c > 127 else 65 if chr(c).isupper() and c < 128 else 48 if 48 <= c < 58 else c for c in range(256))


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values of unit length): words, shapes of word ends, pairs of those, and words that repeat the one before."""
    words = (text or b"").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    word = np.fromiter(map(xxh64_intdigest, words, repeat(1)), np.uint64, len(words))
    ends = [w[-3:] for w in (text or b"").translate(_shape).split()]
    shape = np.fromiter(map(xxh64_intdigest, ends, repeat(2)), np.uint64, len(words))
    pair = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]
    again = np.where(word[1:] == word[:-1], np.uint64(11), np.uint64(13))
    at = (np.concatenate((word, shape, pair, again)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    place, n = np.unique(at.astype(np.int64), return_counts=True)
    x = np.sqrt(n)
    return place, x / np.sqrt((x * x).sum())


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5, l2: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression on soft labels, with a rate of its own for each coordinate."""
    w, g2, b, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -35, 35))) - y
            each = g * x + l2 * w[at]
            g2[at] += each * each
            gb += g * g
            w[at] -= rate * each / np.sqrt(g2[at])
            b -= rate * g / gb**0.5
    return w.astype(np.float32), b


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """(doc_id, score, kept) of every row; score is the linear scorer's, kept is score >= threshold.

    The labellers vote on every whole text; the number of rows with each pattern of votes, of which there are 3^9 at most, is all that
    reaches the driver for the estimate. The scorer is fitted on the whole texts of a bounded sample, of which only the distinct places
    (2^18 a row at most) reach the driver, and then applied to every whole text. Null and empty
    texts have votes and a score like any; repeated rows each give a row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    votes = materialise(map_rows(docs, [F.col("doc_id"), text_hash().alias("h"), F.col("text")], lambda i, h, t: (i, h, votes_of(t)), "doc_id long, h long, votes int"))
    patterns = votes.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    pattern, count = np.array([r.votes for r in patterns], np.int64), np.array([r.n for r in patterns], np.float64)
    posterior = expect(pattern, count)[0] if len(pattern) else np.empty(0)
    known = dict(zip(pattern.tolist(), posterior.tolist(), strict=True))
    first = votes.groupBy("h").agg(F.min("votes").alias("votes")).orderBy(F.xxhash64(F.lit(seed), "h"), "h").limit(fit_rows)
    sample = docs.select(text_hash().alias("h"), F.col("text").cast("binary").alias("text")).where("text is not null").join(first, "h").dropDuplicates(["h"])

    def places(h: int, votes: int, text: bytes) -> tuple:
        at, x = features(text)
        return h, votes, at.astype(np.int32).tobytes(), x.tobytes()

    found = map_rows(sample, [F.col("h"), F.col("votes"), F.col("text")], places, "h long, votes int, at binary, x binary")
    rows = sorted(((r.h, np.frombuffer(r.at, np.int32), np.frombuffer(r.x), known[r.votes]) for r in found.toLocalIterator()), key=lambda r: r[0])
    sent = spark.sparkContext.broadcast(fit_scorer([r[1:] for r in rows]))

    def of_row(doc_id: int | None, text: bytes | None) -> tuple:
        w, b = sent.value
        at, x = features(text)
        p = float(1 / (1 + np.exp(-np.clip(w[at] @ x + b, -35, 35))))
        return doc_id, p, p >= threshold

    return map_rows(docs, [F.col("doc_id"), F.col("text").cast("binary")], of_row, "doc_id long, score double, kept boolean")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
