"""Operator 9, benchmark decontamination: rare gapped 2-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import DOCUMENT_COLUMNS, pa_schema, slices, table

#: A seed is two words at one of these distances, in the item as in the text.
STEPS = (1, 2)
#: Items of fewer words must be found whole (all words, in order and together), those of one or two words as a whole line: by chance they align half anywhere.
SHORT, SHORTEST = 8, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are sent to the tasks in blocks of at most so many bytes; each block is matched with all documents.
BLOCK_BYTES = 8 << 20
#: Letters and digits stay, other ASCII characters part words.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text without case and ASCII punctuation."""
    words = (text or b"").lower().translate(_SPACED).split()
    return np.fromiter(map(xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def pairs(words: np.ndarray, step: int) -> np.ndarray:
    """A number for each two words at a distance of step."""
    first, second = words[: max(0, len(words) - step)], words[step:]
    out = first * np.uint64(0x9E3779B97F4A7C15) + second
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def needed(length: int, score: float) -> int:
    """How many seeds an alignment of that share of a full score has at least.

    With m words matched and mismatches and gaps that cost c, 2 m - c is score * 2 length or more, and m is at most length. Of the m - 1 steps from
    one matched word to the next those that cost 2 or more number c / 2 at most; every other step costs nothing (both words follow each other on both
    sides) or 1 (one word is between them on one side or both), so it is a seed. There are m - 1 - c / 2 of them or more: score * length - 1.
    """
    return max(1, int(np.ceil(score * length - 1e-9)) - 1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best Smith-Waterman score of two word sequences and where it ends in passage (exclusive); linear gaps."""
    at = np.arange(len(passage) + 1, dtype=np.int64)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new - GAP * at) + GAP * at  # gaps along the passage, of any length at once
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Quick:
    """Tells most numbers that are not in a sorted array from their upper bits."""

    def __init__(self, keys: np.ndarray):
        bits = int(np.clip(np.ceil(np.log2(16 * len(keys) + 1)), 16, 26))
        self.shift, self.there = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.there[keys >> self.shift] = True

    def may_hold(self, numbers: np.ndarray) -> np.ndarray:
        return self.there[numbers >> self.shift]


class Matcher:
    """The items of one block: their words, the seeds sorted for lookup, how many of them each item needs, and the shortest items as lines."""

    def __init__(self, ids: list, words: list[np.ndarray], scores: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], needs: np.ndarray, lines: dict[tuple, list[int]]):
        self.ids, self.words, self.scores, self.needs, self.lines = ids, words, scores, needs, lines
        self.seeds, self.item = seeds
        self.quick = Quick(self.seeds)

    def hits(self, text: bytes | None) -> list[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, last word) of the best passage for each item that reaches its score of a full match."""
        words = plain_words(text)
        return [*self._passages(words), *(self._lines(text) if self.lines and len(words) else [])]

    def _passages(self, words: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        found_at, found_item = [], []
        for step in STEPS:
            key = pairs(words, step)
            at = np.flatnonzero(self.quick.may_hold(key))
            low, high = np.searchsorted(self.seeds, key[at]), np.searchsorted(self.seeds, key[at], side="right")
            n = high - low
            found_at.append(np.repeat(at, n))
            found_item.append(self.item[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        at, item = np.concatenate(found_at), np.concatenate(found_item)
        if not len(at):
            return []
        often = np.bincount(item, minlength=len(self.words)) >= self.needs
        at, item = at[often[item]], item[often[item]]
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        out = []
        for k in np.split(np.arange(len(item)), np.flatnonzero(item[1:] != item[:-1]) + 1) if len(item) else []:
            hit = self._best(words, int(item[k[0]]), np.unique(at[k]))
            if hit:
                out.append(hit)
        return out

    def _best(self, words: np.ndarray, item: int, at: np.ndarray) -> tuple[int, float, int, int, int] | None:
        """The best alignment of an item, which lies where as many seeds as it needs begin within its longest span."""
        target, need = self.words[item], int(self.needs[item])
        if len(at) < need:  # seeds were counted, here they are told apart by where they begin
            return None
        span = int(len(target) * (3 - 2 * self.scores[item])) + 1
        dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
        if not len(dense):
            return None
        low, high = np.maximum(at[dense] - span, 0), at[dense + need - 1] + span + 1
        best = (0.0, 0, 0, 0)
        for part in np.split(np.arange(len(low)), np.flatnonzero(low[1:] > high[:-1]) + 1):
            start, stop = int(low[part[0]]), int(high[part[-1]])
            score, end = align(target, words[start:stop])
            if score / (MATCH * len(target)) > best[0]:
                best = (score / (MATCH * len(target)), int(((at >= start) & (at < stop)).sum()), start, start + end)
        if best[0] < self.scores[item]:
            return None
        first = best[3] - align(target[::-1], words[best[2] : best[3]][::-1])[1]
        return item, best[0], best[1], first, best[3] - 1

    def _lines(self, text: bytes) -> Iterator[tuple[int, float, int, int, int]]:
        before, found = 0, {}
        for line in text.split(b"\n"):
            words = plain_words(line)
            if len(words) < SHORTEST:
                for item in self.lines.get(tuple(words.tolist()), []):
                    found.setdefault(item, (item, 1.0, 0, before, before + len(words) - 1))
            before += len(words)
        yield from found.values()


def _scan(docs: DataFrame, columns: list, matcher: object, rows: Callable, schema: str) -> DataFrame:
    """rows(matcher, batch part) for each part of each batch; columns[0] is the text as binary."""
    fields = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if got := rows(matcher.value, part):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*got, strict=True), fields, strict=True)], schema=fields)

    return docs.select(*columns).mapInArrow(run, schema)


def pair_documents(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each two words of `wanted` (sorted) are, at any of the STEPS: counted in each task, then summed; as many numbers as `wanted` come back."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = sent.value, np.zeros(len(sent.value), np.int64)
        quick = Quick(keys)
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0):
                    words = plain_words(text.as_py())
                    key = np.concatenate([pairs(words, step) for step in STEPS])
                    key = key[quick.may_hold(key)]
                    if len(key):
                        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        seen[np.unique(k[keys[k] == key])] += 1
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(seen[k], pa.int64())], names=["k", "n"])

    out = np.zeros(len(wanted), np.int64)
    for k, n in docs.select(F.col("text").cast("binary")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def matchers(docs: DataFrame, items: DataFrame, min_score: float) -> Iterator[object]:
    """A broadcast Matcher for each block of items; items without a word are in none."""
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", F.col("text").cast("binary")).where("text is not null").collect()
        words = [plain_words(r.text) for r in own]
        ids, words = [r.item_id for r, w in zip(own, words, strict=True) if len(w)], [w for w in words if len(w)]
        if not words:
            continue
        lines: dict[tuple, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) < SHORTEST:
                lines.setdefault(tuple(w.tolist()), []).append(i)
        scores = np.array([1.0 if len(w) < SHORT else min_score for w in words])
        needs = np.array([needed(len(w), s) for w, s in zip(words, scores, strict=True)])
        each = [np.concatenate([pairs(w, step) for step in STEPS]) if len(w) >= SHORTEST else np.empty(0, np.uint64) for w in words]
        wanted = np.unique(np.concatenate(each))
        times = pair_documents(docs, wanted) if len(wanted) else np.empty(0, np.int64)
        key, item = [], []
        for i, g in enumerate(each):
            common = needs[i] // 2  # that many of the commonest are no seeds, and as many fewer are needed
            rare = np.argsort(times[np.searchsorted(wanted, g)], kind="stable")[: len(g) - common]
            needs[i] -= common
            key.append(g[rare])
            item.append(np.full(len(rare), i))
        key, item = np.concatenate(key), np.concatenate(item)
        order = np.argsort(key, kind="stable")
        yield spark.sparkContext.broadcast(Matcher(ids, words, scores, (key[order], item[order]), needs, lines))


def leaks(docs: DataFrame, items: DataFrame, min_score: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, last_word): the best passage of each document for each item that it leaks.

    Words are compared without case and punctuation. score is the alignment's score over that of the whole item: 1 for a copy, about
    1 - 1.5 e with a share e of words replaced. No passage that reaches min_score is missed: needed() says how many seeds (two words at a distance
    of one or two on either side) it holds at least, and of an item's seeds only the ones found in the most documents are left out, half as
    many as that; so a passage that very many documents share still has seeds. Only where that many begin within a passage's longest
    span are texts aligned. min_score times an item's words should be 2 or more. Items of three to seven words must be found whole, those of
    one or two words as a whole line of the text.
    Null texts and items have no words and leak nothing; repeated rows each give their rows. Of passages with the same score the first is
    reported. Texts of any length are searched as a whole. Empty tables of either side give no rows; columns beyond doc_id and text, or item_id and
    text, are not read.
    Documents are read twice, once to count and once to align, and never shuffled; a block of items is broadcast.
    """
    out = None
    for m in matchers(docs, items, min_score):
        rows = lambda m, part: [(i, m.ids[k], *rest) for text, i in zip(part.column(0), part.column(1), strict=True) for k, *rest in m.hits(text.as_py()) for i in [i.as_py()]]
        found = _scan(docs, [F.col("text").cast("binary"), "doc_id"], m, rows, "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")


def clean_documents(docs: DataFrame, items: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of docs (their five columns) that leak no item; nulls, repeated rows, short items and empty tables are as in leaks()."""
    out = docs.select(*DOCUMENT_COLUMNS)
    schema = out.schema
    for m in matchers(docs, items, min_score):

        def run(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    text = part.column("text").cast(pa.binary())
                    yield part.filter(pa.array([not m.value.hits(t.as_py()) for t in text], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents columns of each row that leaks no item of the benchmark.

    Rows are judged one by one, so null, repeated and shared ids and repeated rows need no rule; a null text leaks nothing and stays; an
    empty table of documents gives no rows, an empty benchmark keeps all; columns beyond those of documents are dropped.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))
