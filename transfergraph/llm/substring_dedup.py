"""Operator 5, substring dedup: passages that repeat across documents, by an FM-index for each shard of candidate passages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..plans.cut import drop, materialise
from ..plans.hot import join_counted
from .common import map_rows, pa_schema, slices, table, text_hash
from .fm_index import FMIndex

WINDOW = 50
#: Two equal windows have the same least hash of an ANCHOR-word n-gram, which says where both are sent.
ANCHOR = 24
#: A run of windows with the same anchor is cut into segments of at most so many windows.
SEGMENT_WINDOWS = 64
#: Words in a shard, about.
SHARD_WORDS = 750_000
#: Of a key with more distinct segments than this each distinct window is a passage of its own.
KEY_SEGMENTS = 10_000
BASE, ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 4096), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD)
    return x ^ (x >> np.uint64(29))


def prefix(words: list[bytes], seed: int = 5) -> np.ndarray:
    h = np.fromiter(map(xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, len(h)), dtype=np.uint64)))


def hashes(p: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of word sequences, from the running sum p of hash * BASE ^ position."""
    return mixed((p[start + length] - p[start]) * powers(INVERSE, len(p))[start])


def segments_of(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(key, segment hash, first window, windows): runs of windows whose least anchor hash is the same, which is the key."""
    n = len(words) - window + 1
    p = prefix(words)
    anchor = min(ANCHOR, window)
    span = window - anchor + 1
    least, s = hashes(p, np.arange(n + span - 1), anchor), 1
    while 2 * s <= span:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    least = np.minimum(least[:n], least[span - s : span - s + n])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    number = np.diff(np.append(first, n))
    if number.max() > SEGMENT_WINDOWS:
        parts = -(-number // SEGMENT_WINDOWS)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, number = np.repeat(first, parts) + k * SEGMENT_WINDOWS, np.minimum(np.repeat(number, parts) - k * SEGMENT_WINDOWS, SEGMENT_WINDOWS)
    return least[first].view(np.int64), hashes(p, first, number + window - 1).view(np.int64), first.astype(np.int32), number.astype(np.int32)


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc, text_hash, key, seg, first, number) of every row with a doc_id."""
    names = ["doc", "text_hash", "key", "seg", "first", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500):
                out = []
                for doc, h, text in zip(*(part.column(k) for k in range(3)), strict=True):
                    words = text.as_py().split()
                    if len(words) >= window:
                        got = segments_of(words, window)
                        out.append((np.full(len(got[0]), doc.as_py()), np.full(len(got[0]), h.as_py()), *got))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", text_hash(), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc long, text_hash long, key long, seg long, first int, number int")


#: A passage: where it is sent, what it is (key and seg), windows in it, a document with it, below which document its windows are sought, its words.
PASSAGE = "key long, seg long, number int, doc long, below long, words binary"


def _rows_of(batches: Iterator[pa.RecordBatch], rows_of_text: Callable[[int, int, list[bytes], list[dict]], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of doc, text_hash, text, wanted."""
    for batch in batches:
        for part in slices(batch, 200):
            rows = [x for doc, h, text, want in zip(*(part.column(k) for k in range(4)), strict=True) for x in rows_of_text(doc.as_py(), h.as_py(), text.as_py().split(), want.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _passages(doc: int, h: int, words: list[bytes], wanted: list[dict], window: int) -> Iterator[tuple]:
    for w in wanted:
        at, n = w["first"], w["number"]
        yield w["key"], w["seg"], n, doc, w["below"], b" ".join(words[at : at + n + window - 1])


def _windows(doc: int, h: int, words: list[bytes], wanted: list[dict], window: int) -> Iterator[tuple]:
    """Each window of the wanted segments: two hashes of it, its segment, its place there, the document and its place in it."""
    p, q = prefix(words), prefix(words, 11)
    for w in wanted:
        at = np.arange(w["first"], w["first"] + w["number"])
        for k, x, y in zip(range(len(at)), hashes(p, at, window).view(np.int64).tolist(), hashes(q, at, window).view(np.int64).tolist(), strict=True):
            yield x, y, w["key"], w["seg"], k, doc, h, w["first"] + k


def least_before(passages: list[np.ndarray], keys: np.ndarray, docs: np.ndarray, below: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each passage (documents, found): of each of its windows a document under `below` that has it as well, and whether there is one.

    Passages of a key are ranked by document. For each bit of the rank, the highest first, an index is built of those without the bit, and those with
    it that agree in the higher bits are streamed through it: each passage meets all of lower rank, each pair once, and none meets itself. What is found is
    the least document of all passages in that index with the window. A passage whose windows are all found has nothing that one of lower rank has not,
    so it takes no more part. `below` is a passage's own document, or one more than the least document of an equal passage.
    """
    order = np.lexsort((docs, keys))
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    rank, group = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
    rank[order] = np.arange(len(k)) - first[group[order]]
    number = np.array([len(x) for x in passages]) - window + 1
    out = [(np.zeros(n, np.int64), np.zeros(n, bool)) for n in number.tolist()]
    alive = np.ones(len(passages), bool)
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        side = rank >> bit & 1
        block = np.unique(np.stack((group, rank >> bit + 1)), axis=1, return_inverse=True)[1].reshape(-1)
        sides = [np.bincount(block[alive & (side == x)], minlength=len(passages)) > 0 for x in (0, 1)]
        both = alive & (sides[0] & sides[1])[block]
        held, streamed = np.flatnonzero(both & (side == 0)), np.flatnonzero(both & (side == 1))
        if not len(held):
            continue
        names, text = np.unique(np.concatenate([np.append(passages[x], 0) for x in held]), return_inverse=True)  # a passage ends with 0
        index = FMIndex(text.astype(np.int64), window)
        least = index.least(np.repeat(docs[held], number[held] + window))
        words = np.concatenate([passages[x] for x in streamed])
        place = np.minimum(np.searchsorted(names, words), len(names) - 1)
        length = number[streamed] + window - 1
        start = np.cumsum(length) - length
        matched, low = index.matching_statistics(np.where(names[place] == words, place, -1), start, number[streamed])
        for x, a, n in zip(streamed.tolist(), (start + window - 1).tolist(), number[streamed].tolist(), strict=True):
            (docs_of, found), doc = out[x], least[low[a : a + n]]
            new = ~found & (matched[a : a + n] == window) & (doc < below[x])
            docs_of[new] = doc[new]
            found |= new
            alive[x] = not found.all()
    return out


def _search_shard(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Search the passages of a shard in one another. Out: key, seg, least (of each window a document with it, as small as its own documents need, or null if it is in none)."""
    ids: dict[bytes, int] = {}
    rows, passages = [], []
    for batch in batches:
        for *row, words in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            rows.append(row)
            passages.append(np.array([ids.setdefault(w, len(ids) + 1) for w in words.split(b" ")], np.int32))
    if not rows:
        return
    del ids
    keys, docs, below = (np.array([r[k] for r in rows], np.int64) for k in (0, 3, 4))
    merged: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for row, (least, found) in zip(rows, least_before(passages, keys, docs, below, window), strict=True):
        if (had := merged.get((row[0], row[1]))) is not None:
            least = np.where(found & had[1], np.minimum(least, had[0]), np.where(found, least, had[0]))
            found = found | had[1]
        merged[row[0], row[1]] = least, found
    lengths = [len(x) for x, _ in merged.values()]
    values = pa.array(np.concatenate([x for x, _ in merged.values()]), mask=~np.concatenate([x for _, x in merged.values()]))
    columns = [*(pa.array([x[k] for x in merged], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), values)]
    yield pa.RecordBatch.from_arrays(columns, names=["key", "seg", "least"])


def ends_of(df: DataFrame, keys: list[str], place: str, count: str) -> DataFrame:
    """Equal passages folded to two rows at most: one of the least document, sought below it, and one of the greatest, if that is another, which stands for all but the least."""
    row = F.struct("doc", "text_hash", F.col(place).alias("first"))
    ends = df.groupBy(*keys).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count("*").alias(count))
    one = lambda x, below: F.struct(F.col(f"{x}.doc").alias("doc"), F.col(f"{x}.text_hash").alias("text_hash"), F.col(f"{x}.first").alias("first"), below.alias("below"))
    both = F.array_compact(F.array(one("a", F.col("a.doc")), F.when(F.col("a.doc") < F.col("b.doc"), one("b", F.col("a.doc") + 1))))
    return ends.select(*keys, count, both.alias("ends"))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, text. Both joins with texts read it by the same null-safe keys, so that Spark shuffles the texts once and reuses the exchange."""
    return docs.select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("text"))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, starts array<int>, ends array<int>): for each row with any, runs of windows (first, last) that also start in a document with a smaller doc_id.

    A window is `window` words (33 to 64), compared as they are. Every window is sent by its anchor: equal windows have equal anchors, so segments
    whose anchor is found in one document alone can't repeat and stay where they are. Of the others equal ones are folded to the passages of the
    least and of the greatest document that have them before their words are shuffled. In its shard each is streamed through indexes of other
    passages of its key, never of itself, and the intervals whose matching statistics reach the window are joined back to every document that has the segment.
    Nothing is sampled or capped: of a key of very many segments each distinct window is a passage of its own, folded first, and joins on keys
    and segments that a great share of the rows have meet a bounded broadcast.

    An empty table, null and empty texts and texts of fewer words than the window give no row. A very long text is one row of a task; its segments go
    to their shards one by one. Repeated rows, and several texts of one doc_id, are one document. Other columns of docs are not read, so their names may clash with ours.
    """
    if not 33 <= window <= 64:
        raise ValueError("window is from 33 to 64")
    spark = docs.sparkSession
    every = materialise(segments(docs, window))
    shared = every.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n")
    some = materialise(join_counted(every, shared, ["key"], "n"))
    drop(every)
    distinct = materialise(ends_of(some, ["key", "seg", "number"], "first", "n"))
    many = materialise(distinct.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > KEY_SEGMENTS))
    passage = ["key", "seg", "number", F.inline("ends")]
    plain = (distinct if many.isEmpty() else distinct.join(many.select("key"), "key", "left_anti")).select(*passage)
    if not many.isEmpty():
        split = join_counted(distinct, many, ["key"], "c").select(*passage)
        schema = pa_schema(spark, WINDOWS)
        every_window = _with_texts(docs, split).mapInArrow(lambda b: _rows_of(b, lambda *x: _windows(*x, window), schema), WINDOWS)
        every_window = materialise(every_window)
        folded = materialise(ends_of(every_window, ["w1", "w2"], "place", "c"))
        plain = plain.unionByName(folded.select(F.col("w1").alias("key"), F.col("w2").alias("seg"), F.lit(1).alias("number"), F.inline("ends")))
    words = plain.agg(F.coalesce(F.sum(F.col("number") + window), F.lit(0))).first()[0]
    shards = max(1, -(-int(words) // SHARD_WORDS))
    schema_ = pa_schema(spark, PASSAGE)
    passages = _with_texts(docs, plain).mapInArrow(lambda b: _rows_of(b, lambda *x: _passages(*x, window), schema_), PASSAGE)
    found = passages.repartition(shards, "key").mapInArrow(lambda b: _search_shard(b, window), "key long, seg long, least array<long>")
    if not many.isEmpty():
        found = materialise(found)
        one = folded.select("w1", "w2", "c").join(found.select(F.col("key").alias("w1"), F.col("seg").alias("w2"), F.col("least")[0].alias("first_doc")), ["w1", "w2"])
        of_windows = join_counted(every_window, one, ["w1", "w2"], "c")
        whole = of_windows.groupBy("key", "seg").agg(F.sort_array(F.collect_set(F.struct("off", "first_doc"))).alias("x")).select("key", "seg", F.col("x.first_doc").alias("least"))
        found = found.unionByName(whole)  # rows of single windows have no segment to meet
    counted = found.join(distinct.select("key", "seg", "n"), ["key", "seg"])
    runs = join_counted(some.select("doc", "text_hash", "key", "seg", "first"), counted, ["key", "seg"], "n").where("exists(least, x -> x < doc)")
    runs = runs.withColumn("hit", F.expr("transform(least, x -> coalesce(x < doc, false))")).withColumn("n", F.size("least") - 1)
    runs = runs.withColumn("starts", F.expr("transform(filter(sequence(0, n), j -> hit[j] and (j = 0 or not hit[j - 1])), j -> first + j)"))
    runs = runs.withColumn("ends", F.expr("transform(filter(sequence(0, n), j -> hit[j] and (j = n or not hit[j + 1])), j -> first + j)"))
    return runs.groupBy(F.col("doc").alias("doc_id"), "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


WINDOWS = "w1 long, w2 long, key long, seg long, off int, doc long, text_hash long, place int"


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text_hash, text, wanted): the segments wanted of each row beside its text."""
    each = wanted.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("key", "seg", "first", "number", "below")).alias("wanted"))
    return texts_of(docs).join(each, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("text_hash"))).select("doc", "text_hash", "text", "wanted")


def cut_out(text: bytes | None, starts: list[int] | None, ends: list[int] | None, window: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space)."""
    words = (text or b"").split()
    if not starts:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.array(starts), 1)
    np.add.at(edge, np.array(ends) + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, clean) of every row; with digest, kept_sha256 in place of clean.

    Words covered by a window that also starts in a document with a smaller doc_id go; windows are judged on the input. A null text has no
    words. Rows without a doc_id lose nothing and take nothing from others; rows of one doc_id are one document with several texts.
    """
    found = repeats(docs, window).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "starts", "ends")
    joined = texts_of(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_hash")), "left")

    def of_row(doc_id: int | None, text: bytes | None, starts: list | None, ends: list | None) -> tuple:
        n, removed, kept = cut_out(text, starts, ends, window)
        return doc_id, n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()

    return map_rows(joined, [F.col(x) for x in ("doc_id", "text", "starts", "ends")], of_row, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'clean'} string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM d WHERE len(ws) >= 50),
h AS (SELECT r, doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS w FROM p),
hit AS (SELECT r, s FROM (SELECT r, doc_id, s, min(doc_id) OVER (PARTITION BY w) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT DISTINCT r, s + k AS pos FROM hit, generate_series(0, 49) t(k)),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS t FROM word LEFT JOIN gone g USING (r, pos) WHERE g.r IS NULL GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
