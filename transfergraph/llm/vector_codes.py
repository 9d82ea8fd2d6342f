"""Operator 12, vector code compression: a product quantiser on integer components whose distances are shared along a trie of parts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import materialise
from ..plans.hot import join_counted
from .common import pa_schema, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts make one trie.
BLOCK = 16_384


def _limit(dims: int) -> int:
    """Scaled components stop here on either side, so that the squared distances of a whole vector add up within a long."""
    return math.isqrt(2**62 // max(dims, 1)) // 2


def whole_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, x array<long>) of the rows that can be coded, and their number of components.

    Rows go whose vector is null, holds a null or non-finite component, or has not as many components as the valid vector of the least
    vec_id. x is floor(scale * component), held within _limit(). Raises ValueError if the components do not divide into `parts`.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", _finite)
    rows = vectors.select("vec_id", "label", "embedding").where(F.coalesce(good, F.lit(False)))
    first = rows.select("vec_id", F.size("embedding").alias("n")).orderBy(F.asc_nulls_last("vec_id"), "n").limit(1).collect()
    dims = first[0].n if first else 0
    if dims % parts:
        raise ValueError(f"{dims} components are not {parts} equal parts")
    top = float(_limit(dims))
    scaled = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-top)), F.lit(top))).cast("long"))
    return rows.where(F.size("embedding") == dims).select("vec_id", "label", scaled.alias("x")), dims


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (ties to the lower index) and their squared distance.

    x: distinct rows in lexicographic order, which is a trie read depth first. Where rows branch at a dimension, each child gets the
    vector of its parent's distances to all entries plus its own dimension's share; so a prefix is worked out once for all rows below
    it. Children of a single row leave the walk together: their remaining dimensions are added in arrays. A leaf takes the argmin.
    """
    n, dims = x.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def leaf(rows: np.ndarray, far: np.ndarray) -> None:
        code[rows] = far.argmin(axis=1)
        error[rows] = far[np.arange(len(rows)), code[rows]]

    stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n else []
    while stack:
        low, high, depth, far = stack.pop()
        if depth == dims:  # parts without dimensions
            leaf(np.arange(low, high), np.repeat(far[None, :], high - low, axis=0))
            continue
        column = x[low:high, depth]
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1]))) + low
        ends = np.append(starts[1:], high)
        below = far[None, :] + (x[starts, depth][:, None] - entries[None, :, depth]) ** 2
        single = ends - starts == 1
        alone = starts[single]
        if len(alone):
            rest = below[single]
            for d in range(depth + 1, dims):
                rest += (x[alone, d][:, None] - entries[None, :, d]) ** 2
            leaf(alone, rest)
        stack += [(a, b, depth + 1, below[k]) for k, (a, b) in reversed(list(enumerate(zip(starts, ends, strict=True)))) if b - a > 1]
    return code, error


def _trie(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and each row's place among them."""
    if not part.shape[1]:
        return part[:1], np.zeros(len(part), np.int64)
    order = np.lexsort(part.T[::-1])
    ranked = part[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    place = np.empty(len(part), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)


SUMS = "part int, entry int, n long, sums array<long>"


def _part_sums(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """Per part and entry: how many parts are assigned to it and their componentwise sum. Each block sends 16 x 64 rows at most."""
    fields, parts = pa_schema(rows.sparkSession, SUMS), len(books)
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, x in _blocks(batches, dims):
            for p in range(parts):
                distinct, place = _trie(x[:, p * width : (p + 1) * width])
                code, _ = nearest(distinct, books[p])
                weight = np.bincount(place, minlength=len(distinct))
                np.add.at(count[p], code, weight)
                np.add.at(total[p], code, distinct * weight[:, None])
        at = np.argwhere(count > 0)
        columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0], pa.int64()), pa.array(total[count > 0].tolist(), fields[3].type)]
        yield pa.RecordBatch.from_arrays(columns, schema=fields)

    sums = rows.select("x").mapInArrow(run, SUMS)
    spread = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    return sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *spread)


def fit_books(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries or fewer, components): the parts of the least vec_ids, moved `rounds` times to the floor of the mean of what they attract.

    The driver gets `entries` vectors to begin with and parts x entries sums a round, whatever the number of rows. Rows of one vec_id
    (or without one, which come last) are taken in the order of their components.
    """
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) and dims else 0):
        for r in _part_sums(rows, books, dims).collect():
            books[r.part, r.entry] = [int(r[f"s{d}"]) // r.n for d in range(dims // parts)]
    return books


def books_sha256(books: np.ndarray) -> str:
    """Of all integer components by part, entry and position, in decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, code binary, error): a byte a part and the squared distance of the whole vector, in one pass without a shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"
    fields, parts = pa_schema(rows.sparkSession, schema), len(books)
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dims):
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                distinct, place = _trie(x[:, p * width : (p + 1) * width])
                code, far = nearest(distinct, books[p])
                codes[:, p] = code[place]
                error += far[place]
            made = [batch.column(0).cast(fields[0].type), batch.column(1).cast(fields[1].type), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, schema=fields)

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error) of every vector that whole_vectors() keeps, and the codebooks.

    vectors: vec_id, embedding array of numbers, label; other columns are not read. The vectors are read once to begin with, once a
    round and once to be coded, and never shuffled: each task builds the tries of its own blocks and a round sends on its sums alone.
    Repeated rows weigh as often as they are there; equal vectors get equal codes; components beyond what a long can square are held at
    a bound (see _limit); a table without valid vectors gives no rows. At most 256 entries, as a code is a byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows, dims = whole_vectors(vectors, parts, scale)
    books = fit_books(rows, dims, parts, entries, rounds)
    return encode(rows, books, dims), books


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """coded with the column `decoded` array<double>: the entries that a vector's code names, at the middle of their steps."""
    parts = len(books)
    entries = F.array(*[F.array(*[F.array(*[F.lit((float(v) + 0.5) / scale) for v in entry]) for entry in book]) for book in books])
    named = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.get(F.get(entries, p), F.conv(F.substring(F.hex("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    return coded.withColumn("decoded", F.flatten(named))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings`, their errors and the errors summed over each label.

    Rows without a label are one label. Sums are formed before they are joined back, and labels with a great share of all rows meet a
    bounded broadcast, so a hot label is spread over all tasks.
    """
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    rows = materialise(coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit(0)).alias("_label")))
    labels = rows.groupBy("_none", "_label").agg(F.count("*").alias("_rows"), F.sum("error").alias("label_error"))
    return join_counted(rows, labels, ["_none", "_label"], "_rows").select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """Distances of all distinct parts to all entries, a common table a step."""
    steps = ["""
kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
parts AS MATERIALIZED (
    SELECT r, vec_id, p, list_transform(embedding[p * (len(embedding) // 16) + 1 : (p + 1) * (len(embedding) // 16)], lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
    FROM kept, range(16) AS t(p)),
least AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
distinct_parts AS MATERIALIZED (SELECT p, x, count(*) AS n FROM parts GROUP BY p, x),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN least USING (r))"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""
code{k} AS MATERIALIZED (
    SELECT p, x, n, min_by(e, (far, e)) AS e, min(far) AS far
    FROM (SELECT d.p, d.x, d.n, b.e, list_sum(list_transform(list_zip(d.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM distinct_parts d JOIN book{k} b USING (p))
    GROUP BY p, x, n)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(sum(x[i] * n) AS DOUBLE) AS s, sum(n) AS n FROM code{k}, range(1, 5) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return f"""WITH {",".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM parts JOIN code{rounds} USING (p, x) GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), sha
"""


#: For vectors of 64 components, which the tables hold.
ORACLE = _oracle()
