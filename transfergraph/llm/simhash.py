"""Operator 3, SimHash near-dedup: fingerprints within a few bits are found by a binary trie that is joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..plans.components import connected_components
from ..plans.cut import materialise
from ..plans.hot import join_counted
from .common import map_rows, table, text_hash

#: Shingles that are counted at a time: bounded memory for a very long text, and sums that fit a byte.
SHINGLES_AT_ONCE = 255
#: A block's group of more fingerprints than this is dealt out over several tasks.
GROUP_LIMIT = 500_000
#: Node pairs of the trie join that are looked at together.
PAIRS_AT_ONCE = 1 << 17
LOW48 = np.uint64((1 << 48) - 1)


def shingle_hashes(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles without case, repeats included; fewer words make one shingle, none no shingle."""
    words = (text or b"").lower().split()
    if len(words) < words_in_shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    n = len(words) - words_in_shingle + 1
    parts = [words[k : k + n] for k in range(words_in_shingle)]
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*parts, strict=True)), repeat(seed)), np.uint64, n)


def fold(hashed: np.ndarray) -> int:
    """The SimHash as a signed 64-bit integer: a bit is 1 if set in over half of the hashes; of none it is 0."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashed), SHINGLES_AT_ONCE):
        counts += np.unpackbits(hashed[k : k + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    return fold(shingle_hashes(text, words_in_shingle, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    return map_rows(docs, [F.col("doc_id"), text_hash().alias("h"), F.col("text").cast("binary")], lambda i, h, t: (i, h, fingerprint(t)), "doc_id long, text_hash long, fp long")


def trie_links(keys: np.ndarray, starts: list[tuple[np.ndarray, ...]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every set of keys connected at `bits` or fewer differing bits: arrays of positions in keys.

    keys: sorted distinct unsigned integers, read as a binary trie whose nodes are ranges of positions. starts: (a_low, a_high, b_low,
    b_high) arrays of node pairs to begin with. Two nodes are walked down together, the one with the higher branching bit first; the
    bits above it in which they differ have been spent, and a pair that has spent more than `bits` is pruned. So is a pair of nodes
    whose keys are all linked with one another already, which keeps dense groups from being compared pair by pair.
    """
    label = np.arange(len(keys))
    changes = np.arange(len(keys))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [tuple(x[k : k + PAIRS_AT_ONCE] for x in s) for s in starts for k in range(0, len(s[0]), PAIRS_AT_ONCE)]
    one = np.uint64(1)
    while todo:
        al, ah, bl, bh = todo.pop()
        live = (label[al] != label[bl]) | (changes[al] != changes[ah - 1]) | (changes[bl] != changes[bh - 1])
        al, ah, bl, bh = al[live], ah[live], bl[live], bh[live]
        if not len(al):
            continue
        pa_, pb = _branch(keys, al, ah), _branch(keys, bl, bh)
        top = np.maximum(pa_, pb)
        spent = np.bitwise_count((keys[al] ^ keys[bl]) >> (top + 1).astype(np.uint64))
        ok = spent <= bits
        al, ah, bl, bh, pa_, pb, top = (x[ok] for x in (al, ah, bl, bh, pa_, pb, top))
        leaf = top < 0
        u, v = al[leaf], bl[leaf]
        if len(u := u[k := u != v]):
            v = v[k]
            found.append((u, v))
            label = _united(label, u, v)
            changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        inner = ~leaf
        al, ah, bl, bh, pa_, pb, top = (x[inner] for x in (al, ah, bl, bh, pa_, pb, top))
        if not len(al):
            continue
        own = (al == bl) & (ah == bh)
        at = np.where(pa_ >= pb, al, bl)
        bit = one << top.astype(np.uint64)
        cut = np.searchsorted(keys, (keys[at] & ~(bit - one)) | bit)
        cut = np.minimum(np.maximum(cut, at + 1), np.where(pa_ >= pb, ah, bh))
        a, b = (pa_ >= pb) & ~own, (pa_ < pb) & ~own
        cross = [(al[a], cut[a], bl[a], bh[a]), (cut[a], ah[a], bl[a], bh[a]), (al[b], ah[b], bl[b], cut[b]), (al[b], ah[b], cut[b], bh[b]), (al[own], cut[own], cut[own], ah[own])]
        same = [(al[own], cut[own], al[own], cut[own]), (cut[own], ah[own], cut[own], ah[own])]
        for group in (cross, same):
            joined = tuple(np.concatenate(x) for x in zip(*group, strict=True))
            todo += [tuple(x[k : k + PAIRS_AT_ONCE] for x in joined) for k in range(0, len(joined[0]), PAIRS_AT_ONCE)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every = np.flatnonzero(label != np.arange(len(keys)))
    return every, label[every]


def _branch(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest bit in which the keys of each node differ; -1 for one key."""
    x = keys[low] ^ keys[high - 1]
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    return np.bitwise_count(x).astype(np.int64) - 1


def _united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least position of each linked set) after linking u with v."""
    label = label.copy()
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (up := label[label])).any():
            label = up


def _links_of_cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each cell of this partition. In: cell, side, rot (the fingerprint with the cell's block in front), fp."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    cell, side, rot, fp = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(4))
    rot = rot.view(np.uint64) & LOW48
    order = np.lexsort((rot, cell))
    cell, side, rot, fp = cell[order], side[order], rot[order], fp[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    bounds = np.append(first, len(cell))
    for k in range(0, len(first), 65536):  # the front 16 bits, alike within a cell, make room for the cell's number
        lo, hi = bounds[k], bounds[min(k + 65536, len(first))]
        low, high = bounds[k : k + 65536][: len(first) - k] - lo, bounds[k + 1 : k + 65537] - lo
        number = np.repeat(np.arange(len(low), dtype=np.uint64), high - low)
        keys = (number << np.uint64(48)) | rot[lo:hi]
        ones = np.concatenate(([0], np.cumsum(side[lo:hi])))
        middle = high - (ones[high] - ones[low])
        two = (middle > low) & (middle < high)
        alone = ~two & (high - low > 1)
        starts = [(low[alone], high[alone], low[alone], high[alone]), (low[two], middle[two], middle[two], high[two])]
        u, v = trie_links(keys, starts, bits)
        yield pa.RecordBatch.from_arrays([pa.array(fp[lo:hi][u], pa.int64()), pa.array(fp[lo:hi][v], pa.int64())], names=["src", "dst"])


def near_links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(src, dst): pairs of fingerprints that connect whatever is connected at `bits` <= 3 or fewer differing bits.

    Two such fingerprints agree in one of four 16-bit blocks, so each block in turn leads a trie: a fingerprint goes to four cells.
    A cell of more than GROUP_LIMIT fingerprints is split by its next bits into pairs of branches that differ in at most `bits` of
    them; no pair is lost and no task gets the whole group.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits is from 0 to 3: more than three may touch all four blocks")
    turned = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)) if i else F.col("fp")).alias("rot")) for i in range(4)))).alias("x"))
    turned = turned.select("fp", "x.rot", (F.col("x.i") * 65536 + F.shiftrightunsigned("x.rot", 48)).alias("block"))
    sizes = turned.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_LIMIT)
    depth = sizes.select("block", F.least(F.lit(12), F.ceil(F.log2(F.col("n") / GROUP_LIMIT)) + 2).cast("int").alias("depth"))
    dealt = turned.join(depth, "block", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    own = F.expr(f"shiftrightunsigned(rot, 48 - depth) & (shiftleft(1L, depth) - 1)")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr(f"transform(filter(sequence(0L, shiftleft(1L, depth) - 1), m -> bit_count(m) <= {bits}), m -> own ^ m)")))
    cell = (F.col("block") * 4096 + F.least("own", "other")) * 4096 + F.greatest("own", "other")
    cells = dealt.select(cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rot", "fp")
    return cells.repartition("cell").mapInArrow(lambda batches: _links_of_cells(batches, bits), "src long, dst long")


def near_duplicates(docs: DataFrame, bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of every row; component_id is the smallest doc_id linked to it, directly or through others.

    component is the least fingerprint of the component and names it; component_id does not, as doc_ids may be null or repeat.

    Texts that are null or have no words have fingerprint 0 and are linked to each other like any. Rows with the same doc_id or none
    are rows of their own; component_id is null only if no row of the component has a doc_id. An empty table gives no rows.
    Fingerprints are made distinct first, so a large group of equal texts is one node; fingerprints and components with a great share
    of the rows meet a bounded broadcast instead of a shuffle.
    """
    signed = materialise(fingerprints(docs))
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    groups = connected_components(near_links(distinct.select("fp"), bits))
    named = materialise(distinct.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", "component"))
    linked = named.where("component is not null")
    whole = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    ids = join_counted(linked, whole, ["component"], "fps").select("fp", "n", "component", "component_id")
    ids = ids.unionByName(named.where("component is null").select("fp", "n", F.col("fp").alias("component"), F.col("least").alias("component_id")))
    return join_counted(signed, ids, ["fp"], "n").select("doc_id", "text_hash", "fp", "component", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
