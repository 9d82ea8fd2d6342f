"""Operator 6, language ID: a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, table

WINDOW = 256
WIDTHS, FILTERS, EMBED = (3, 4, 5), 24, 8
#: The network is fitted on so many windows of each language at most, one from each of the rows with the smallest seeded hash.
FIT_ROWS = 1500
#: Windows of all languages together, at most: with over 200 languages each gets fewer than FIT_ROWS. The driver holds 256 bytes of each.
FIT_WINDOWS = 300_000
#: Each of so many tasks finds a language's smallest hashes, so no task sorts a whole language.
PARTS = 16
#: Windows that go through the network together.
BATCH = 64
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    tables: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(languages: list[str], seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return Network(
            languages, r.normal(0, 0.5, (256, EMBED)).astype(np.float32), {w: r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(n, np.float32), r.normal(0, (1 / n) ** 0.5, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
        )

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(windows, filters) after rectified max pooling, and for each width where each maximum is."""
        e = self.embed[windows]
        tops, places = [], []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            wide = np.lib.stride_tricks.as_strided(e, (len(e), n, w * EMBED), e.strides)
            y = (np.ascontiguousarray(wide).reshape(-1, w * EMBED) @ self.filters[w]).reshape(len(e), n, FILTERS)
            at = y.argmax(axis=1)
            tops.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0])
            places.append(at)
        return np.maximum(np.concatenate(tops, axis=1) + self.bias, 0), places

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        e, tops = self.embed[windows], []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            wide = np.lib.stride_tricks.as_strided(e, (len(e), n, w * EMBED), e.strides)
            y = (np.ascontiguousarray(wide).reshape(-1, w * EMBED) @ self.filters[w]).reshape(len(e), n, FILTERS)
            while y.shape[1] > 1:  # halving is faster than max(axis=1) for so few filters
                half = (y.shape[1] + 1) // 2
                y = np.maximum(y[:, :half], y[:, -half:])
            tops.append(y[:, 0])
        return _softmax(np.maximum(np.concatenate(tops, axis=1) + self.bias, 0) @ self.out + self.out_bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean cross entropy of windows x with languages y; a maximum passes its gradient to the bytes of its own place alone."""
        h, places = self.pooled(x)
        p = _softmax(h @ self.out + self.out_bias)
        p[np.arange(len(x)), y] -= 1
        d = p / len(x)
        g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(self.embed)}
        dh = (d @ self.out.T) * (h > 0)
        g["bias"] = dh.sum(axis=0)
        for i, w in enumerate(WIDTHS):
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            bytes_at = np.take_along_axis(x[:, None, :], places[i][:, :, None] + np.arange(w), 2)  # batch, filter, width
            g[w] = np.einsum("bf,bfe->ef", part, self.embed[bytes_at].reshape(len(x), FILTERS, w * EMBED))
            back = part[:, :, None] * self.filters[w].T
            np.add.at(g["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
        return g

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int) -> None:
        """Adam on the cross entropy, batch by batch."""
        names = ["embed", *WIDTHS, "bias", "out", "out_bias"]
        get = lambda k: self.filters[k] if k in self.filters else getattr(self, k)
        m, v, t = {k: np.zeros_like(get(k)) for k in names}, {k: np.zeros_like(get(k)) for k in names}, 0
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for k in range(0, len(order), BATCH):
                b = order[k : k + BATCH]
                g = self.gradients(windows[b], y[b])
                t += 1
                for name in names:
                    m[name] += 0.1 * (g[name] - m[name])
                    v[name] += 0.001 * (g[name] ** 2 - v[name])
                    get(name)[...] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text in windows of WINDOW bytes; the last ends with the text, a short text is filled up with spaces."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= WINDOW:
        return np.concatenate((raw, np.full(WINDOW - len(raw), 32, np.uint8)))[None]
    n = len(raw) // WINDOW
    out = raw[: n * WINDOW].reshape(n, WINDOW)
    return out if len(raw) == n * WINDOW else np.concatenate((out, raw[None, -WINDOW:]))


def fit(docs: DataFrame, train_rows, fit_rows: int = FIT_ROWS, epochs: int = 6, rate: float = 3e-3, seed: int = 42) -> Network | None:
    """A network for the languages of the rows where train_rows holds; null texts, texts without bytes and null lang are left out; None if no row is left.

    Every language is learned. The sample is bounded: fit_rows rows of a language, or an equal share of FIT_WINDOWS if that is less (over
    FIT_WINDOWS / PARTS languages are refused), and one window of each, at a place that a hash picks. Rows that are alike count once; ties of
    the hash go by doc_id.
    """
    rows = docs.where(train_rows & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(FIT_WINDOWS // PARTS + 1).collect())
    if not languages:
        return None
    if len(languages) > FIT_WINDOWS // PARTS:
        raise ValueError(f"over {FIT_WINDOWS // PARTS} languages")
    each = min(fit_rows, FIT_WINDOWS // len(languages)) // PARTS + 1
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))
    near = rows.withColumn("part", F.pmod("h", F.lit(PARTS))).select("lang", "part", "h", "doc_id").withColumn("n", rank).where(F.col("n") <= each).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("lang").alias("l"))
    size = F.octet_length("text")
    start = F.pmod(F.shiftright("h", 8), F.greatest(size - WINDOW + 1, F.lit(1))) + 1
    piece = F.expr("substring(cast(text as binary), int(start), 256)")
    # near has FIT_WINDOWS + PARTS * languages rows of three values at most
    sample = rows.join(F.broadcast(near), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("lang") == F.col("l")), "left_semi")
    got = sample.withColumn("start", start).select("lang", piece.alias("piece"), "h").distinct().collect()
    got.sort(key=lambda r: (r.h, r.lang, bytes(r.piece)))
    number = {x: k for k, x in enumerate(languages)}
    net = Network.fresh(languages, seed)
    net.train(np.concatenate([windows_of(bytes(r.piece)) for r in got]), np.array([number[r.lang] for r in got]), epochs, rate, seed)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the whole text: the mean of its windows' log probabilities decides, score is its softmax.

    `und` with score 0 if the text is null or has no letter or nothing was learned. Of languages that tie the first by name is taken.
    Rows are read one by one, so repeated rows and null ids need no rule; an empty table gives no rows; columns beyond doc_id and text are
    not read. The network that is broadcast grows with the number of languages only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def of_row(doc_id: int | None, text: bytes | None) -> tuple:
        net = sent.value
        if net is None or not text or not LETTER.search(text.decode("utf-8", "replace")):
            return doc_id, "und", 0.0
        x, total = windows_of(text), np.zeros(len(net.languages))
        for k in range(0, len(x), BATCH):
            total += np.log(net.probabilities(x[k : k + BATCH]) + 1e-9).sum(axis=0)
        p = _softmax((total / len(x))[None])[0]
        return doc_id, net.languages[int(p.argmax())], float(p.max())

    return map_rows(docs, [F.col("doc_id"), F.col("text").cast("binary")], of_row, "doc_id long, lang_pred string, score double")


def held_out(parts: int = 3, part: int = 1):
    """Whether the row is outside the fit; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
