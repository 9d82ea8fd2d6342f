"""Writers; each task writes its own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import filter_edges_min_volume

NODE_COLUMNS = {"address": "address", "nodeType": "node_type", "balance": "balance", "degree": "degree", "riskScore": "risk_score"}
EDGE_COLUMNS = {"source": "from_address", "target": "to_address", "volume": "total_volume", "count": "transfer_count", "edgeType": "edge_type"}


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(n) for n, c in names.items()))


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """path/nodes and path/edges with headers; all values quoted, quotes doubled."""
    for name, df in (("nodes", _named(nodes, NODE_COLUMNS)), ("edges", _named(edges, EDGE_COLUMNS))):
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/{name}")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def xml_text(c: Column) -> Column:
    out = c.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): 1 for nodes, 2 for edges."""
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), xml_text(F.col(c)), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("address")), F.lit('">'), F.coalesce(data("balance", "balance"), F.lit("")), F.coalesce(data("riskScore", "risk_score"), F.lit("")), F.lit("</node>")).alias("line"))
    e = edges.select(
        F.lit(2).alias("part"),
        F.concat(F.lit('<edge source="'), xml_text(F.col("from_address")), F.lit('" target="'), xml_text(F.col("to_address")), F.lit('">'), data("value", "total_volume"), data("transferCount", "transfer_count"), F.lit("</edge>")).alias("line"),
    )
    return n.unionByName(e)


def gexf_rows(nodes: DataFrame, edges: DataFrame, min_volume: int = 0, types: list[str] | None = None) -> DataFrame:
    """(part, line) for nodes of the given types and edges of min_volume or more between them."""
    n = nodes if types is None else nodes.where(F.coalesce("node_type", F.lit("regular")).isin(types))
    ends = n.select("address")
    e = filter_edges_min_volume(edges, min_volume).join(ends.withColumnRenamed("address", "from_address"), "from_address", "left_semi").join(ends.withColumnRenamed("address", "to_address"), "to_address", "left_semi")
    a = n.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("address")), F.lit('" label="'), xml_text(F.coalesce("display", "address")), F.lit('"/>')).alias("line"))
    b = e.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("from_address")), F.lit('" target="'), xml_text(F.col("to_address")), F.lit('" weight="'), F.col("total_volume").cast("string"), F.lit('"/>')).alias("line"))
    return a.unionByName(b)


#: Heads and tails of the two formats.
HEAD = {"graphml": '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "gexf": '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'}


def write_xml(rows: DataFrame, path: str, fmt: str) -> None:
    """path/part=0 .. 3: head, nodes, edges, tail, to be put together in this order. Nodes and edges are written by as many tasks as hold them."""
    spark = rows.sparkSession
    wrap = (("<nodes>", "</nodes><edges>", "</edges>") if fmt == "gexf" else ("", "", ""))
    fixed = [(0, HEAD[fmt] + wrap[0]), (1.5, wrap[1]), (3, f"{wrap[2]}</graph></{fmt}>")]
    rows.select(F.col("part").cast("double").alias("part"), "line").unionByName(spark.createDataFrame([(float(k), x) for k, x in fixed if x], "part double, line string")).write.mode("overwrite").partitionBy("part").text(path)


EXPORTS = {
    "accounts": ["address", "display", "balance", "risk_score", "node_type"], "transfers": ["hash", "block_number", "timestamp", "from_address", "to_address", "value", "success"],
    "patterns": ["address", "pattern_type", "confidence", "severity"],
}


def export_select(df: DataFrame, kind: str, filters: list[Column] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows that pass all filters with the fields asked for, or the kind's own."""
    for f in filters or []:
        df = df.where(f)
    return df.select(*(fields or EXPORTS[kind]))


def write_partitioned_monthly(transfers: DataFrame, path: str) -> None:
    t = transfers.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    t.repartition("year", "month", F.pmod(F.xxhash64("hash"), F.lit(16))).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def archive_before(spark, path: str, year: int, month: int) -> DataFrame:
    """The rows from a month on; whole partitions are pruned."""
    return spark.read.parquet(path).where((F.col("year") > year) | ((F.col("year") == year) & (F.col("month") >= month)))


def score_report(scores: DataFrame, as_of: str) -> DataFrame:
    """One JSON document per pair: scores, interpretation and time."""
    parts = F.struct(*(F.col(f"{k}_score").alias(k) for k in ("volume", "frequency", "temporal", "network", "risk")), F.col("strength").alias("total"))
    return scores.select(F.to_json(F.struct(F.col("from_address").alias("from"), F.col("to_address").alias("to"), parts.alias("scores"), "interpretation", F.lit(as_of).alias("timestamp"))).alias("value"))


def write_score_report(scores: DataFrame, as_of: str, path: str) -> None:
    score_report(scores, as_of).write.mode("overwrite").text(path)
