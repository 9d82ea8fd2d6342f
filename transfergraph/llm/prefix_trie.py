"""Operator 13, conversation prefix trie: built by cutting at half depth, totals grafted upward (a van Emde Boas recursion, one level of it a round)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import drop, materialise
from ..plans.hot import join_counted
from .common import WORD, pa_schema, table

#: Conversations are listed for their digest in runs of so many ids.
RUN = 1 << 16

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, items array<struct<key binary, words int>>) of each conversation, a turn's key being 128 bits of the SHA-256 of role and text.

    Turns go by turn (null first), equal ones by role and by key, and repeated rows are turns too. A null role or text is empty; rows without a conv_id belong to
    no conversation and are left out. Only keys are shuffled, never texts; a conversation is one row of 16 bytes and a number a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    ranked = turns.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ranked.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("items"))


def share_openings(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """sequences whose first h items are those of conversation c - c % every (none if there is no such one); h = crc32(decimal c) % most.

    c % every has the sign of c. A conversation lends its opening to fewer than 2 * every others, so no key of the join is hot.
    """
    openings = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_from"), F.slice("items", 1, most - 1).alias("_opening"))
    joined = sequences.withColumn("_from", F.col("conv_id") - F.col("conv_id") % every).join(openings, "_from", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    opening = F.coalesce(F.slice("_opening", F.lit(1), h), F.slice("items", 1, 0))
    return joined.select("conv_id", F.concat(opening, _from_on(F.col("items"), h)).alias("items"))


def _from_on(items: Column, n: Column) -> Column:
    """items without the first n."""
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def _names(items: Column, *more: Column) -> list[Column]:
    """Two 64-bit hashes that together name a sequence of keys (below a root)."""
    keys = F.transform(items, lambda t: t["key"])
    return [F.xxhash64(*more, keys).alias("k"), F.xxhash64(F.lit(1), keys, *more).alias("g")]


def _distinct(sequences: DataFrame) -> DataFrame:
    """(conv_id, s, n, items): s is the least conversation of the same items; that one alone has items, and the number n of its copies."""
    named = materialise(sequences.select("conv_id", "items", *_names(F.col("items"))))
    least = materialise(named.groupBy("k", "g").agg(F.min("conv_id").alias("s"), F.count("*").alias("n"), F.count("*").alias("rows")))
    joined = join_counted(named, least, ["k", "g"], "rows", rows=least.agg(F.sum("rows")).first()[0] or 0, write=False)
    first = F.col("conv_id") == F.col("s")
    out = materialise(joined.select("conv_id", "s", F.when(first, F.col("n")).alias("n"), F.when(first, F.col("items")).alias("items")))
    drop(named)
    drop(least)
    return out


def _sha256(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], schema=fields)

    for batch in batches:
        for s, ids in zip(batch.column(0), batch.column(1), strict=True):
            if now is None or s.as_py() != now:
                if now is not None:
                    yield done()
                now, digest = s.as_py(), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if now is not None:
        yield done()


def _digests(members: DataFrame) -> DataFrame:
    """(s, ends_sha256): the digest of the ascending conversations of each distinct sequence.

    Ids are joined to runs of RUN at most before they are dealt by s, and a digest is fed run by run; so a sequence with a third of all
    conversations is one row in RUN of them in its task, and one run in memory.
    """
    at = F.floor(F.col("conv_id") / RUN)
    runs = members.groupBy("s", at.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    fields = pa_schema(members.sparkSession, "s long, ends_sha256 string")
    dealt = runs.repartition("s").sortWithinPartitions("s", "run").select("s", "ids")
    return dealt.mapInArrow(lambda batches: _sha256(batches, fields), "s long, ends_sha256 string")


def _cut(problems: DataFrame, w: int) -> tuple[DataFrame, DataFrame]:
    """One round of the recursion for all subproblems of depth 2w at once: (subproblems of depth w, sequences that end at a cut).

    problems: (s, n, a, r, items): sequence s below the node named r at depth a, in items of depths a+1 to a+2w; sequences of one r
    differ. The first w items of those that reach the cut get a name, the least s that has them. The upper trie holds each name once,
    and the sequences that end above the cut; the lower forest holds what is left, below its name as the root.
    """
    full = problems.where(F.size("items") >= w)
    full = full.select("*", *_names(F.slice("items", 1, w), F.col("a"), F.col("r")))
    names = materialise(full.groupBy("k", "g").agg(F.min("s").alias("name"), F.count("*").alias("rows")))
    named = materialise(join_counted(full, names, ["k", "g"], "rows", rows=names.agg(F.sum("rows")).first()[0] or 0, write=False))
    upper = problems.where(F.size("items") < w).unionByName(named.where("s = name").select("s", "n", "a", "r", F.slice("items", 1, w).alias("items")))
    lower = named.where(F.size("items") > w).select("s", "n", (F.col("a") + w).alias("a"), F.col("name").alias("r"), _from_on(F.col("items"), F.lit(w)).alias("items"))
    ends = materialise(named.where(F.size("items") == w).select("s", "n", F.col("name").alias("node"), (F.col("a") + w).alias("depth")))
    below = materialise(upper.unionByName(lower))
    for t in (names, named, problems):
        drop(t)
    return below, ends


def _graft(totals: DataFrame, paths: DataFrame, w: int) -> tuple[DataFrame, DataFrame]:
    """Totals within tries of depth 2w, and paths of 2w nodes, from those of depth w: each lower forest is added to the nodes above its cut.

    totals: (node, depth, parent, n, leaves, saved), sums over the part of a node's subtree that lies in its own trie of depth w. paths:
    (node, depth, root, path array<struct<node, words>>) of each node at the bottom of such a trie: the nodes from its top down to it, with
    the words from there to the bottom, and the node above. n conversations more below the cut are n more in every node of its path.
    """
    forests = totals.where((F.col("depth") - 1) % (2 * w) == w).groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(*[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    above = forests.join(paths.drop("root"), ["node", "depth"]).select("depth", "n", "leaves", "saved", F.posexplode("path").alias("i", "p"))
    added = above.select(F.col("p.node").alias("node"), (F.col("depth") - w + 1 + F.col("i")).alias("depth"), F.lit(None).cast("long").alias("parent"), "n", "leaves", (F.col("saved") + F.col("n") * F.col("p.words")).alias("saved"))
    sums = totals.unionByName(added).groupBy("node", "depth").agg(F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("n", "leaves", "saved")])
    grown = materialise(sums)
    low = paths.where(F.col("depth") % (2 * w) == 0)
    top = paths.where(F.col("depth") % (2 * w) == w).select(F.col("node").alias("root"), (F.col("depth") + w).alias("depth"), F.col("root").alias("top"), F.col("path").alias("upper"))
    longer = F.concat(F.transform("upper", lambda p: F.struct(p["node"].alias("node"), (p["words"] + F.element_at("path", 1)["words"]).alias("words"))), F.col("path"))
    doubled = materialise(low.join(top, ["root", "depth"]).select("node", "depth", F.col("top").alias("root"), longer.alias("path")))
    drop(totals)
    drop(paths)
    return grown, doubled


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id unique, items array<struct<key, words>>): see NODES for the columns.

    Equal sequences are folded to one first. Then the sequences are cut at half depth: each cut prefix gets a name, the upper trie is
    built of distinct prefixes and the lower forests of what is below each, both with all other subproblems of their depth in one join and
    aggregation; after log2(depth) rounds every row is one node. Totals go the other way: each lower forest is grafted to the path of its
    cut, depths doubling. So rounds grow with the logarithm of the longest conversation, rows with the items of distinct sequences.
    A prefix that a third of all sequences share is a hot key of the join with its name and meets a bounded broadcast; sums are
    combined before they are shuffled. Sequences without items end at the root; no sequences give no rows.
    """
    spark = sequences.sparkSession
    convs = _distinct(sequences)
    size = convs.agg(F.min("conv_id"), F.count("*"), F.max(F.size("items"))).first()
    if not size[1]:
        return spark.createDataFrame([], NODES)
    root, count, longest = size
    digests = materialise(_digests(convs.select("conv_id", "s")))
    whole = convs.where("items IS NOT NULL").select("s", "n", F.lit(0).cast("long").alias("a"), F.lit(root).cast("long").alias("r"), "items")
    problems, ends = whole.where(F.size("items") > 0), [whole.where(F.size("items") == 0).select("s", "n", F.col("r").alias("node"), F.col("a").alias("depth"))]
    widths = [1 << k for k in range(longest.bit_length())]
    for w in reversed(widths):
        problems, at_cut = _cut(problems, w)
        ends.append(at_cut)
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    last = materialise(last.join(digests, "s").select("node", "depth", F.col("n").alias("ends"), "ends_sha256"))
    items = F.element_at("items", 1)
    nodes = problems.select(F.col("s").alias("node"), (F.col("a") + 1).alias("depth"), F.col("r").alias("parent"), items["words"].cast("long").alias("words")) if widths else None
    if nodes is None:
        nodes = spark.createDataFrame([], "node long, depth long, parent long, words long")
    children = nodes.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, ["node", "depth"], "left").join(last, ["node", "depth"], "left").fillna(0, ["n_children", "ends"]))
    leaf = (F.col("n_children") == 0).cast("long")
    totals = nodes.select("node", "depth", "parent", F.col("ends").alias("n"), leaf.alias("leaves"), ((F.col("ends") - 1) * F.col("words")).alias("saved"))
    paths = nodes.select("node", "depth", F.col("parent").alias("root"), F.array(F.struct("node", "words")).alias("path"))
    for w in widths:
        totals, paths = _graft(totals, paths, w)
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.join(totals.drop("parent"), ["node", "depth"]).select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
    top = totals.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    at_root = last.where("depth = 0").agg(F.coalesce(F.max("ends_sha256"), F.lit(none)).alias("ends_sha256"))
    top = top.crossJoin(F.broadcast(at_root)).select(  # one row each
        F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return out.unionByName(top)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all `conversations`, rebuilt so that conversations of twenty ids share openings of up to three turns.

    Null and repeated turns, null texts and roles and rows without a conv_id are as in turn_sequences; an empty table gives no rows.
    """
    own = materialise(turn_sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie(share_openings(own))


ORACLE = r"""
WITH turns AS MATERIALIZED (
    SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS p
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS key,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
tab AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab),
convs AS MATERIALIZED (
    SELECT c, c - c % 20 AS lender,
           xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id AS c FROM turns), tab),
rebuilt AS (SELECT c, 0 AS part, p, key, words FROM convs JOIN turns ON conv_id = lender WHERE p <= h UNION ALL SELECT c, 1, p, key, words FROM convs JOIN turns ON conv_id = c WHERE p > h),
steps AS (SELECT c, row_number() OVER w AS depth, string_agg(key, '') OVER w AS pre, words FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, p)
          UNION ALL SELECT c, 0, '', 0 FROM convs),
last AS (SELECT c, max(length(pre)) AS size FROM steps GROUP BY c),
nodes AS MATERIALIZED (
    SELECT pre, depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = length(pre)), '')) AS ends_sha256
    FROM steps JOIN last USING (c) GROUP BY pre, depth),
links AS MATERIALIZED (SELECT a.pre, a.depth, p.conv_id AS parent_conv_id, p.pre AS up FROM nodes a LEFT JOIN nodes p ON p.pre = a.pre[1 : 32 * (a.depth - 1)] AND p.depth = a.depth - 1),
children AS (SELECT up AS pre, count(*) AS n_children FROM links WHERE up IS NOT NULL GROUP BY up),
ancestors AS (SELECT n.pre[1 : 32 * d] AS pre, (n_convs - 1) * words AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
              FROM nodes n LEFT JOIN children c ON c.pre = n.pre, range(0, n.depth + 1) AS t(d)),
sums AS (SELECT pre, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM ancestors GROUP BY pre)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN links USING (pre, depth) JOIN sums USING (pre) LEFT JOIN children USING (pre)
"""
