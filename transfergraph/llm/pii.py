"""Operator 11, personal data: fixed patterns, and spans of a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, pa_schema, slices, table
from .pii_labelled import LABELLED

KINDS = ("email", "ip", "card", "phone")
#: O, then a beginning and an inside label for each kind.
LABELS = ("O", *(f"{b}-{kind}" for kind in KINDS for b in "BI"))
#: Labelled sentences that are fitted at most; the least sentence_ids.
FIT_ROWS = 5000
#: Words whose scores are held at a time, and words that a task remembers.
CHUNK, CACHE = 200_000, 400_000
#: Words on either side that a label sees.
REACH = 2

WORDS = re.compile(WORD)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: each @ is looked at once, with the run of characters that ends before it."""
    end, at = 0, text.find("@")
    low = 0
    while at >= 0:
        run = text[max(low, end) : at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        low, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in FOUR.finditer(text) if _octets(m.group().split("."))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in DIALLED.finditer(text) if 8 <= len(NO_DIGIT.sub("", m.group())) <= 15]
    return out


# what a word looks like

LEFT, RIGHT = "\"'<>|*#&%$!?,;:{}=~`", "\"'<>|*#&%$!?,;:.{}=~`"
RUNS = re.compile(r"[^\W\d_]+|[0-9]+|(.)\1*", re.S)


def core(word: str) -> tuple[int, int]:
    """The part of a word without the marks around it."""
    start = len(word) - len(word.lstrip(LEFT))
    return start, max(start, len(word.rstrip(RIGHT)))


def shape(word: str) -> tuple[str, ...]:
    """Features of one word: runs of letters and digits, marks between them, case, lengths, numbers of digits, and what checks its digits pass."""
    low, high = core(word)
    inner = word[low:high]
    if inner.isalpha():
        case = "low" if inner.islower() else "upper" if inner.isupper() else "title" if inner.istitle() else "mixed"
        return "s=a", f"c={case}", f"l={min(len(inner), 7)}", f"w={inner.lower()[:12]}"
    runs = ["d" if m.group()[0] in "0123456789" else "a" if m.group()[0].isalpha() else m.group()[0] for m in RUNS.finditer(inner[:4096])]
    digits = NO_DIGIT.sub("", inner)
    lengths = [len(d) for d in NO_DIGIT.split(inner) if d]
    n = len(digits)
    out = [f"s={''.join(runs[:9])}", f"n={n if n <= 4 else '5-7' if n < 8 else '8-12' if n < 13 else '13-15' if n < 16 else '16-19' if n < 20 else '20+'}", f"l={min(len(inner), 16) // 4}", f"w={inner.lower()[:12]}"]
    if lengths:
        out += [f"r={min(max(lengths), 5)}", f"f={min(lengths[0], 5)}", f"k={min(len(lengths), 5)}"]
    if 13 <= n <= 19 and luhn(digits):
        out.append("luhn")
    if len(lengths) == 4 and max(lengths) <= 3 and _octets([d for d in NO_DIGIT.split(inner) if d]):
        out.append("octets")
    if "@" in inner:
        out.append("@")
    if inner.count(":") > 1 and all(c in "0123456789abcdefABCDEF:" for c in inner):
        out.append("hex:")
    if n and any(c.isalpha() for c in inner):
        out.append("mixed")
    return tuple(out)


# the field


@dataclass(frozen=True)
class Field:
    """weights: (2 * REACH + 1, features, labels), one table for each neighbour's place; places: feature -> row; steps: (labels, labels)."""

    places: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def known(self, word: str) -> tuple[int, ...]:
        return tuple(sorted(self.places[f] for f in shape(word) if f in self.places))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(scores: np.ndarray, mask: np.ndarray, labels: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels (sentences, words), and its gradients by the scores and the steps. A sentence stands between two words labelled O."""
    rows, width, k = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + steps[0]
    for t in range(1, width):
        new = scores[:, t] + _log_sum(ahead[:, t - 1][:, :, None] + steps[None], 1)
        ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1] + steps[:, 0], 1)
    back[:, -1] = steps[:, 0]
    for t in range(width - 2, -1, -1):
        new = _log_sum(steps[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None], new, back[:, t + 1])
    seen = np.eye(k)[labels] * mask[:, :, None]
    by_score = seen - np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    last = mask.sum(axis=1) - 1
    at_end = labels[np.arange(rows), last]
    by_step = np.zeros_like(steps)
    np.add.at(by_step[0], labels[:, 0], 1)
    np.add.at(by_step[:, 0], at_end, 1)
    by_step[0] -= np.exp(ahead[:, 0] + back[:, 0] - total[:, None]).sum(axis=0)
    by_step[:, 0] -= np.exp(ahead[:, -1] + steps[:, 0] - total[:, None]).sum(axis=0)
    value = (scores * seen).sum() + steps[0, labels[:, 0]].sum() + steps[at_end, 0].sum() - total.sum()
    for t in range(1, width):
        on = mask[:, t]
        np.add.at(by_step, (labels[on, t - 1], labels[on, t]), 1)
        pair = ahead[on, t - 1][:, :, None] + steps[None] + (scores[on, t] + back[on, t])[:, None, :] - total[on][:, None, None]
        by_step -= np.exp(pair).sum(axis=0)
        value += steps[labels[on, t - 1], labels[on, t]].sum()
    return float(value), by_score, by_step


def fit_field(sentences: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 250, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all sentences at once. Word features are kept if two sentences have them."""
    texts = [(WORDS.findall(text), _labels(text, spans)) for text, spans in sentences]
    texts = [t for t in texts if t[0]]
    found = Counter(f for words, _ in texts for f in {f for w in words for f in shape(w)})
    places = {f: k for k, f in enumerate(sorted(f for f, n in found.items() if n >= (2 if f.startswith("w=") else 1)))}
    if not texts:
        return Field({}, np.zeros((2 * REACH + 1, 0, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    width, n, k = max(len(w) for w, _ in texts), len(texts), len(LABELS)
    mask, labels = np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    x = np.zeros((2 * REACH + 1, n, width, len(places)), np.float32)
    for i, (words, tags) in enumerate(texts):
        mask[i, : len(words)], labels[i, : len(words)] = True, tags
        for t, w in enumerate(words):
            for f in shape(w):
                if f in places:
                    for d in range(-REACH, REACH + 1):
                        if 0 <= t - d < len(words):
                            x[d + REACH, i, t - d, places[f]] = 1
    flat = x.transpose(1, 2, 0, 3).reshape(n * width, -1)
    params = np.zeros(flat.shape[1] * k + k * k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, steps = params[: -k * k].reshape(-1, k).astype(np.float32), params[-k * k :].reshape(k, k)
        _, by_score, by_step = likelihood((flat @ weights).reshape(n, width, k).astype(np.float64), mask, labels, steps)
        up = np.concatenate(((flat.T @ by_score.reshape(n * width, k).astype(np.float32)).reshape(-1), by_step.reshape(-1))) - l2 * params
        m, v = 0.9 * m + 0.1 * up, 0.99 * v + 0.01 * up * up
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = params[: -k * k].reshape(2 * REACH + 1, len(places), k)
    return Field(places, weights, params[-k * k :].reshape(k, k))


def _labels(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    out = []
    for m in WORDS.finditer(text):
        tag = 0
        for kind, a, b in spans:
            if m.start() < b and a < m.end():
                tag = 2 * KINDS.index(kind) + (1 if a >= m.start() else 2)
        out.append(tag)
    return out


def open_words(lead: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Which words can be other than O in a best path; exact, as no word is left out that is.

    lead: by how much the best other label beats O at each word, transitions aside. A run of other labels that is worth its place gains at
    least nothing over a run of O: the sum of its leads, of the best step inside a run for each, and of the best steps in and out. So
    a word is open if the greatest such sum over the runs through it is not negative.
    """
    inside = steps[1:, 1:].max() - steps[0, 0]
    ends = steps[0, 1:].max() + steps[1:, 0].max() - 2 * steps[0, 0] - inside
    gain = np.concatenate(([0.0], np.cumsum(lead + inside)))
    to_here = gain[1:] - np.minimum.accumulate(gain[:-1])
    from_here = np.maximum.accumulate(gain[:0:-1])[::-1] - gain[:-1]
    return to_here + from_here - (lead + inside) + ends >= -1e-6


def viterbi(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels (sequences, words) of padded sequences that stand between two words labelled O."""
    n, width, _ = scores.shape
    best = [scores[:, 0] + steps[0]]
    for t in range(1, width):
        new = (best[-1][:, :, None] + steps[None]).max(axis=1) + scores[:, t]
        best.append(np.where((t < lengths)[:, None], new, best[-1]))
    now = (best[-1] + steps[:, 0]).argmax(axis=1)
    out = np.zeros((n, width), np.int64)
    for t in range(width - 1, -1, -1):
        on = t < lengths
        out[on, t] = now[on]
        if t:
            now = np.where(on, (best[t - 1] + steps[:, now].T).argmax(axis=1), now)
    return out


class Decoder:
    """Viterbi over documents in batches. Each distinct word's scores for every place are looked up by number.

    Only runs of open_words() are walked, run by run, many at once and sorted by length; the others are O in every best path.
    """

    def __init__(self, field: Field):
        self.field, self.ids, self.words, self.plain = field, {(): 0}, {}, {}
        self.tables = np.zeros((2 * REACH + 1, 1, len(LABELS)), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        seen, places = self.words, self.field.places
        if len(seen) > CACHE:
            seen.clear()
        added: list[tuple[int, ...]] = []
        for w in [w for w in set(words) if w not in seen]:
            low, high = core(w)
            inner = w[low:high]
            key = None
            if inner.isalpha():  # words that no sentence holds differ by case and length alone
                said = f"w={inner.lower()[:12]}"
                key = (inner.islower(), inner.isupper(), inner.istitle(), min(len(inner), 7), said if said in places else "")
                if key in self.plain:
                    seen[w] = self.plain[key]
                    continue
            at = self.field.known(w)
            if at not in self.ids:
                self.ids[at] = len(self.ids)
                added.append(at)
            seen[w] = self.ids[at]
            if key:
                self.plain[key] = seen[w]
        if added:
            rows = np.stack([self.field.weights[:, list(at)].sum(axis=1) for at in added], axis=1)
            self.tables = np.concatenate((self.tables, rows.astype(np.float32)), axis=1)
        return np.fromiter(map(seen.__getitem__, words), np.int32, len(words))

    def _scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum(self.tables[d + REACH, ids[at + d]] for d in range(-REACH, REACH + 1)).astype(np.float64)

    def labels(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its words that are not O, ascending, and their labels."""
        gap = np.zeros(REACH, np.int32)
        parts, starts, n = [gap], [], REACH
        for words in texts:
            starts.append(n)
            parts += [self.numbers(words), gap]
            n += len(words) + REACH
        ids = np.concatenate(parts)
        lead = np.full(n, -1e4)
        for a in range(REACH, n - REACH, CHUNK):
            scores = self._scores(ids, np.arange(a, min(a + CHUNK, n - REACH)))
            lead[a : a + len(scores)] = (scores[:, 1:] - scores[:, :1]).max(axis=1)
        inside = np.zeros(n, bool)
        for s, words in zip(starts, texts, strict=True):
            inside[s : s + len(words)] = True
        lead[~inside] = -1e4
        at = np.flatnonzero(open_words(lead, self.field.steps) & inside)
        tags = self._walk(at, self._scores(ids, at))
        on = tags > 0
        at, tags = at[on], tags[on]
        edges = np.searchsorted(at, starts + [n])
        return [(at[a:b] - s, tags[a:b]) for s, a, b in zip(starts, edges[:-1], edges[1:], strict=True)]

    def _walk(self, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        tags = np.zeros(len(at), np.int64)
        if not len(at):
            return tags
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
        size = np.diff(np.append(first, len(at)))
        order = np.argsort(size, kind="stable")
        k = 0
        while k < len(order):
            widest, j = 0, k
            while j < len(order) and (j == k or (j - k + 1) * size[order[j]] <= CHUNK):
                widest, j = size[order[j]], j + 1
            group = order[k:j]
            cells = first[group][:, None] + np.arange(widest)[None]
            inside = np.arange(widest)[None] < size[group][:, None]
            found = viterbi(scores[np.where(inside, cells, first[group][:, None])], self.field.steps, size[group])
            tags[cells[inside]] = found[inside]
            k = j
        return tags


WORD_AT, WORD_DOT = r"(?:at|arobase|arroba)", r"(?:dot|punkt|point|punto)"
#: An address as people write it out: an at and at least one dot, as marks, words in brackets or words.
SPELT = re.compile(rf"[\w.%+-]+(?:\s*[\[(]{WORD_DOT}[\])]\s*[\w-]+|\s{WORD_DOT}\s[\w-]+)*(?:\s*@\s*|\s*[\[(]{WORD_AT}[\])]\s*|\s{WORD_AT}\s)[\w-]+(?:\.[\w-]+|\s*[\[(]{WORD_DOT}[\])]\s*[\w-]+|\s{WORD_DOT}\s[\w-]+)+", re.I)
#: No address is longer.
LONGEST = 254
POINTS = re.compile(r"\s*[\[(]?\s*(?:\.|dot)\s*[\])]?\s*", re.I)


def passes(kind: str, said: str) -> bool:
    """Whether a span of the field can be what it is called: digits that add up, octets, an at and a dot."""
    if len(said) > LONGEST:
        return False
    digits = NO_DIGIT.sub("", said)
    if kind == "email":
        return bool(SPELT.fullmatch(said))
    if kind == "ip":
        parts = POINTS.split(said)
        return (len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts) and _octets(parts)) or (said.count(":") > 1 and all(c in "0123456789abcdefABCDEF:" for c in said))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in said)


def field_spans(text: str, at: np.ndarray, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the labelled words, without the marks around them; an inside label that follows none of its kind begins a span."""
    if not len(at):
        return []
    runs: list[tuple[str, int, int]] = []
    before = -2
    for t, tag in zip(at.tolist(), tags.tolist(), strict=True):
        kind = KINDS[(tag - 1) // 2]
        if runs and t == before + 1 and tag % 2 == 0 and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1], t)
        else:
            runs.append((kind, t, t))
        before = t
    wanted = {t for _, a, b in runs for t in (a, b)}
    where = {t: m for t, m in enumerate(WORDS.finditer(text)) if t in wanted}
    out = []
    for kind, a, b in runs:
        start, end = where[a].start() + core(where[a].group())[0], where[b].start() + core(where[b].group())[1]
        if start < end and passes(kind, text[start:end]):
            out.append((kind, start, end))
    return out


def joined(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans and those of the field that overlap none of them, by kind and start."""
    held = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in held]
    reach = np.maximum.accumulate([b for _, b in held]) if held else []

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b))
        return k == 0 or reach[k - 1] <= a

    return sorted([*base, *(s for s in added if free(s[1], s[2]))], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def drawn(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


# the Spark side

MARK = re.compile(r"\{(%s):([^{}]*)\}" % "|".join(KINDS))


def labelled_table(spark: SparkSession) -> DataFrame:
    """(sentence_id, text, spans array<struct<kind, start, end>>): the sentences of pii_labelled.py."""
    rows = []
    for k, line in enumerate(LABELLED):
        text, spans, at = "", [], 0
        for m in MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
            text, at = text + m.group(2), m.end()
        rows.append((k, text + line[at:], spans))
    return spark.createDataFrame(rows, "sentence_id long, text string, spans array<struct<kind: string, start: int, end: int>>")


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Field:
    """The field of a labelled table; of more than fit_rows sentences the least sentence_ids count. Null texts and unknown kinds are left out; no sentence: a field that finds nothing."""
    rows = labelled.where("text IS NOT NULL").orderBy("sentence_id", "text").limit(fit_rows).collect()
    return fit_field([(r.text, [(s.kind, s.start, s.end) for s in r.spans or [] if s.kind in KINDS]) for r in rows])


FOUND = "doc_id long, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, spans): the spans of the fixed patterns, and those with what the field adds, in code points of the whole text.

    One pass without a shuffle; the field is a few thousand numbers. A null text is empty and has no spans; repeated rows, ties and null ids
    need no rule as rows are read one by one; a very long text is scored CHUNK words at a time; an empty table gives no rows; columns beyond
    doc_id and text are not read.
    """
    fields = pa_schema(docs.sparkSession, FOUND)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def found(ids: list, texts: list[str], decoder: Decoder) -> pa.RecordBatch:
        base = [base_spans(t) for t in texts]
        tags = decoder.labels([WORDS.findall(t) for t in texts])
        spans = [joined(b, field_spans(t, *at)) for b, t, at in zip(base, texts, tags, strict=True)]
        lists = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in column] for column in (base, spans)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, f.type) for x, f in zip(lists, list(fields)[1:], strict=True))], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for part in slices(batch):
                ids, texts, held = [], [], 0
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text or "")
                    held += len(texts[-1])
                    if held > 5 * CHUNK:
                        yield found(ids, texts, decoder)
                        ids, texts, held = [], [], 0
                if ids:
                    yield found(ids, texts, decoder)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all `documents`: counts of the fixed patterns, a digest of their spans, all spans, and how many the field adds."""
    out = find_personal_data(table(spark, sf_dir, "documents"), fit(labelled_table(spark)))

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select("doc_id", *map(of, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
