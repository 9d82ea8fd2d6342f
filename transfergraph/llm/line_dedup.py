"""Operator 10, line dedup: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import materialise
from ..plans.hot import join_counted
from .common import DOCUMENT_COLUMNS, table, text_hash

#: Stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, drop array<int>): for each row that loses lines, their 0-based positions in ascending order.

    A line is dropped if its key has at least min_chars code points and is found in at least min_docs documents, unless the
    document has the largest doc_id that holds the key. Rows with a null doc_id count as one document below all others.
    Only 96-bit hashes of long enough lines are shuffled, never the text. Distinct (key, document) pairs are formed before keys are
    counted, so that a key of a third of all documents is spread over all tasks; the rows of such keys then meet a bounded broadcast.
    """
    split = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), text_hash().alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    ).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    lines = materialise(split.where(F.char_length("key") >= min_chars).select("doc", "text_hash", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g")))
    pairs = lines.groupBy("h", "g", "doc").agg(F.count("*").alias("c"))
    often = pairs.groupBy("h", "g").agg(F.sum("c").alias("rows"), F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("h", "g", "rows", "last")
    gone = join_counted(lines, often, ["h", "g"], "rows").where("doc <> last")
    return gone.groupBy(F.nullif("doc", F.lit(-(2**63))).alias("doc_id"), "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default doc_id) with lines array<string>, kept array<string> and new text `clean`.

    A null or empty text is one empty line. Rows that are repeated as a whole each get the same result; of texts that share a doc_id each
    keeps or loses its own lines, and they count as one document. A long text is many rows of the shuffle, never one. An empty table gives
    no rows; columns beyond doc_id, text and keep are not read.
    """
    names = ["doc_id"] if keep is None else keep
    drops = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("drop").alias("_drop"))
    rows = docs.select(*dict.fromkeys([*names, "doc_id", "text"]), text_hash().alias("_row_hash"))
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row_hash") == F.col("_hash")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = joined.withColumn("_lines", lines).withColumn("_keep", F.when(F.col("_drop").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform("_keep", lambda i: F.element_at("_lines", i + 1)), "\n"))
    return left.select(*names, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("clean"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents columns of every row, without its dropped lines and with n_chars counted anew.

    No row goes: a text that loses all lines stays as an empty one, a null text becomes an empty one. Null and repeated ids, repeated rows
    and empty tables are as in dedup_lines; columns beyond those of documents are dropped.
    """
    out = dedup_lines(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.char_length("clean").cast("long").alias("n_chars")).select(*DOCUMENT_COLUMNS)


ORACLE = r"""
WITH rows_ AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
