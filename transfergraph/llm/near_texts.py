"""Near-duplicate texts of a stated Jaccard similarity: SimHash groups and MinHash bands give candidates, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.cut import drop, materialise
from ..plans.hot import join_counted
from .common import DOCUMENT_COLUMNS, slices, text_hash
from .simhash import fold, near_links, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares no band with probability (1 - s^8)^36: 0.0013 at 0.8, 0.00002 at 0.85.
BANDS, BAND_ROWS = 36, 8
HASHES = BANDS * BAND_ROWS
#: Standard deviations below what the similarity asked for leads to at which a pair's share of equal 4-bit MinHash values rules it out (a chance of 0.0002).
SLACK = 3.5
#: Shingles that are permuted at a time, so that a very long text takes bounded memory.
SHINGLES_AT_ONCE = 256
#: Rounds of comparing each bucket's members with one of them, before the pairs that are left.
STAR_ROUNDS = 2
_random = np.random.default_rng(42)
_odd = _random.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_add = _random.integers(0, 1 << 32, HASHES, np.uint32)
_space = np.empty((SHINGLES_AT_ONCE, HASHES), np.uint32)
_mix = _random.integers(0, 1 << 63, BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles without case; fewer words make one shingle, none no shingle."""
    return np.unique(shingle_hashes(text, size))


def minhash(found: np.ndarray) -> np.ndarray:
    """HASHES least values of the shingles under multiply-add permutations of 32 bits; all ones for no shingle."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), SHINGLES_AT_ONCE):
        part = x[k : k + SHINGLES_AT_ONCE, None]
        turned = np.multiply(part, _odd, out=_space[: len(part)])
        turned += _add
        np.minimum(least, turned.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values; texts without words share all of them."""
    key = (least.astype(np.uint64).reshape(BANDS, BAND_ROWS) * _mix).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def code(least: np.ndarray) -> np.ndarray:
    """The low four bits of each MinHash value, 16 to a 64-bit integer."""
    return ((least & np.uint32(15)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(x: str, y: str, similarity: float) -> Column:
    """Whether two codes agree often enough for the similarity; values that differ agree in four bits one time in 16."""
    agree = similarity + (1 - similarity) / 16
    most = HASHES * (1 - agree) + SLACK * (HASHES * agree * (1 - agree)) ** 0.5
    pairs = f"zip_with({x}, {y}, (a, b) -> (a ^ b) | shiftrightunsigned(a ^ b, 2))"
    differ = f"aggregate({pairs}, 0, (n, d) -> n + bit_count((d | shiftrightunsigned(d, 1)) & 1229782938247303441L))"
    return F.expr(differ) <= F.lit(most)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of h, text: h, fp, size, bands, code, once for each h of a task."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 500):
            h, rows = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    every = shingle_hashes(text.as_py(), SHINGLE)
                    found = np.unique(every)
                    least = minhash(found)
                    h.append(key)
                    rows.append((fold(every), len(found), bands(least), code(least)))
            if h:
                fp, size, *lists = zip(*rows, strict=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * len(x[0])), pa.array(np.concatenate(x))) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), *lists], names=["h", "fp", "size", "bands", "code"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 500):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["h", "found"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(x) + len(y)
            common = both - len(np.union1d(x, y))
            keep.append(common >= similarity * (both - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))


def _both_ends(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both ends. A node of very many pairs is left to the skew join of adaptive execution, which splits its pairs."""
    x, y = (of.select(F.col("h").alias(end), F.col(column).alias(as_)) for end, as_ in (("src", "x"), ("dst", "y")))
    return pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y")


def _simhash_pairs(signed: DataFrame) -> DataFrame:
    """(src, dst) that span the groups of texts whose fingerprints are linked in the trie self-join, at three bits or fewer."""
    same = materialise(signed.select("h", "fp").distinct())
    first = materialise(same.groupBy("fp").agg(F.min("h").alias("first"), F.count("*").alias("n")))
    equal = join_counted(same, first.where("n > 1"), ["fp"], "n").select(F.col("h").alias("src"), F.col("first").alias("dst"))
    links = near_links(first.select("fp"))
    ends = links.join(first.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(first.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    return equal.unionByName(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h, component) of every text that is linked to another one: components of the pairs of similarity or more on five-word shingles.

    h is the text's hash, component the least of its component. Equal texts are one node. Candidates are the groups that the SimHash
    trie links and, for what three bits don't see, the texts that share a band of MinHash values: in each bucket all are compared with
    the member that shares the most, in a second round with another one; pairs of a bucket that are not in one component then
    are all compared by their codes, within the join. A candidate whose codes differ too much is out; the exact shingle sets decide the rest.
    Texts without words are linked with each other. An empty table gives no rows; only doc_id-free columns are read, so ids may be null or repeat.
    """
    signed = materialise(docs.select(text_hash().alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(_signed, "h long, fp long, size int, bands array<long>, code array<long>"))
    entries = signed.select("h", "size", F.explode("bands").alias("band"))
    shared = materialise(entries.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("band", "n"))
    entries = materialise(join_counted(entries, shared.withColumn("rows", F.col("n")), ["band"], "rows", rows=signed.count() * BANDS, write=False).distinct())
    weight = entries.groupBy("h").agg(F.sum("n").alias("weight"))
    by_simhash = materialise(_simhash_pairs(signed))
    nodes = entries.select("h").unionByName(by_simhash.select(F.col("src").alias("h"))).unionByName(by_simhash.select(F.col("dst").alias("h"))).distinct()
    codes = materialise(signed.select("h", "code").join(nodes, "h", "left_semi").groupBy("h").agg(F.first("code").alias("code")))
    links = checked = sets = groups = None
    now = entries.withColumn("component", F.col("h"))
    for k in range(STAR_ROUNDS + 1):
        a, b = (now.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("h", "size", "component"))) for x in "ab")
        if k < STAR_ROUNDS:
            order = F.struct(*([F.col("weight")] if k == 0 else []), F.xxhash64("h", F.lit(k)).alias("o"), "h", "size", "component")
            a = (now.join(weight, "h") if k == 0 else now).groupBy("band").agg(F.max(order).alias("at"), F.count("*").alias("n")).select("band", "n", *(F.col(f"at.{c}").alias(f"{c}_a") for c in ("h", "size", "component")))
        close = F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")
        if k == STAR_ROUNDS:
            a, b = (x.join(codes.select(F.col("h").alias(f"h_{c}"), F.col("code").alias(f"code_{c}")), f"h_{c}") for x, c in ((a, "a"), (b, "b")))
            close = close & (F.col("h_a") < F.col("h_b")) & alike("code_a", "code_b", similarity)
        pairs = join_counted(b, a, ["band"], "n") if k < STAR_ROUNDS else a.join(b, "band")
        pairs = pairs.where((F.col("component_a") != F.col("component_b")) & close)
        pairs = pairs.select(F.col("h_a").alias("src"), F.col("h_b").alias("dst"))
        pairs = pairs.unionByName(by_simhash) if k == 0 else pairs
        pairs = pairs.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        pairs = materialise(pairs if checked is None else pairs.join(checked, ["src", "dst"], "left_anti"))
        checked = pairs if checked is None else checked.unionByName(pairs)
        likely = materialise(_both_ends(pairs, codes, "code").where(alike("x", "y", similarity)).select("src", "dst"))
        if likely.isEmpty():
            found = likely
        else:
            wanted = likely.select(F.col("src").alias("h")).unionByName(likely.select(F.col("dst").alias("h"))).distinct()
            new = wanted if sets is None else wanted.join(sets.select("h"), "h", "left_anti")
            more = materialise(_texts(docs, new).mapInArrow(_sets, "h long, found binary"))
            sets = more if sets is None else sets.unionByName(more)
            found = materialise(_both_ends(likely, sets, "found").mapInArrow(lambda batches: _similar(batches, similarity), "src long, dst long"))
        if groups is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            groups = materialise(connected_components(links).select(F.col("node").alias("h"), "component"))
        if k < STAR_ROUNDS:
            joined = (entries if k == 0 else now.drop("component")).join(groups, "h", "left").withColumn("component", F.coalesce("component", "h"))
            several = joined.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
            now = materialise(joined.join(several, "band"))
            if now.isEmpty():
                break
    drop(signed)
    return groups


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, text) once for each wanted h. Texts of many copies meet a bounded broadcast and are folded within each task before they are shuffled."""
    rows = docs.select(text_hash().alias("h"), F.col("text").cast("binary").alias("text"))
    copies = rows.groupBy("h").agg(F.count("*").alias("n")).join(wanted, "h")
    return join_counted(rows, copies, ["h"], "n").groupBy("h").agg(F.first("text").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents columns of one row of each component of similar texts (near_texts): one with its smallest doc_id, or if none has one with the least text hash.

    Null doc_ids and doc_ids that repeat are told apart by the text's hash; rows that are alike in doc_id and text are copies, of which
    the first by source and lang stays. Null texts and texts without words are one component. An empty table gives no rows; other columns are dropped.
    """
    rows = docs.select(*DOCUMENT_COLUMNS).withColumn("_hash", text_hash()).withColumn("_key", F.xxhash64("doc_id", "_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_doc"), F.col("_hash").alias("_at"))
    each = rows.groupBy(F.col("_hash").alias("h")).agg(F.min(order).alias("at"))
    first = each.join(near_texts(docs), "h", "left").groupBy(F.coalesce("component", "h")).agg(F.min("at").alias("at"))
    first = first.select("at._doc", "at._at", F.xxhash64("at._doc", "at._at").alias("_key"))
    kept = rows.join(first, "_key").where(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_at")))
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("source", "lang")))
    return once.where("_n = 1").select(*DOCUMENT_COLUMNS)
