"""Anomalies of balances and activity. balances: address, timestamp, hash, direction, balance (see windows.balance_events)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, days_between, micros
from .filters import ladder
from .sets import undirected_view
from .topk import topk
from .windows import inter_transfer_gaps, iqr_outliers, rolling, sessionise

US = 1_000_000


def top(limit: float, x: Column) -> Column:
    return F.least(F.lit(float(limit)), x)


def balance_anomalies(balances: DataFrame, z_limit: float = 3.0, change_limit: float = 0.5, rate_limit: float = 10.0, history: int = 100, at_least: int = 5, threshold: float = 0.3) -> DataFrame:
    """Events that four tests judge: z over the history before, quartile fences, relative change, change over the mean change; score is the share that fail."""
    before = Window.partitionBy("address").orderBy("_us", "hash", "direction").rowsBetween(-history, -1)
    order = Window.partitionBy("address").orderBy("_us", "hash", "direction")
    b = iqr_outliers(balances, history, at_least).withColumn("_us", micros("timestamp"))
    b = b.withColumn("_last", F.lag("balance").over(order)).withColumn("_change", F.abs(F.col("balance") - F.col("_last")))
    b = b.withColumns({"_n": F.count("balance").over(before), "_mean": F.avg("balance").over(before), "_sd": F.stddev_pop("balance").over(before), "_typical": F.avg("_change").over(before)})
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    tests = {
        "by_z": yes((F.col("_sd") > 0) & (F.abs(F.col("balance") - F.col("_mean")) > z_limit * F.col("_sd"))), "by_fence": yes(F.col("outlier")),
        "by_change": yes((F.col("_last") != 0) & (F.col("_change") > change_limit * F.abs("_last"))), "by_rate": yes((F.col("_typical") > 0) & (F.col("_change") > rate_limit * F.col("_typical"))),
    }
    b = b.withColumns(tests).where(F.col("_n") >= at_least).withColumn("score", (F.col("by_z") + F.col("by_fence") + F.col("by_change") + F.col("by_rate")) / 4)
    return b.where(F.col("score") > threshold).select("address", "hash", "direction", *tests, "score")


def transfer_features(transfers: DataFrame, degrees: DataFrame) -> DataFrame:
    """hash and six numbers per transfer: amount in units, hour, weekday from Sunday 0, gap to the sender's previous, receiver's degree, deviation from the sender's mean."""
    mean = transfers.groupBy("from_address").agg(F.avg(F.col("value").cast("double") / 1e12).alias("_mean"))
    t = inter_transfer_gaps(transfers).join(mean, "from_address").join(degrees.select(F.col("address").alias("to_address"), "degree"), "to_address", "left")
    amount = F.col("value").cast("double") / 1e12
    return t.select("hash", amount.alias("amount"), F.hour("timestamp").alias("hour"), (F.dayofweek("timestamp") - 1).alias("weekday"), F.coalesce("gap_before", F.lit(0.0)).alias("gap"), F.coalesce("degree", F.lit(0)).alias("degree"), (amount - F.col("_mean")).alias("deviation"))


def _grow(x: np.ndarray, r: np.random.Generator, depth: int) -> dict:
    if depth == 0 or len(x) <= 1:
        return {"n": len(x)}
    k = int(r.integers(x.shape[1]))
    low, high = x[:, k].min(), x[:, k].max()
    if low == high:
        return {"n": len(x)}
    at = float(r.uniform(low, high))
    left = x[:, k] < at
    return {"k": k, "at": at, "left": _grow(x[left], r, depth - 1), "right": _grow(x[~left], r, depth - 1)}


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points: 2 (ln(n - 1) + gamma) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


def _depths(node: dict, x: np.ndarray, depth: int, out: np.ndarray, at: np.ndarray) -> None:
    if "k" not in node:
        out[at] += depth + _expected(node["n"])
        return
    left = x[at, node["k"]] < node["at"]
    _depths(node["left"], x, depth + 1, out, at[left])
    _depths(node["right"], x, depth + 1, out, at[~left])


def isolation_forest(features: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, max_depth: int = 10, seed: int = 42, threshold: float = 0.6) -> DataFrame:
    """(key, score, outlier): 2^(-mean depth / expected depth) over random trees.

    Each tree has its own hashed sample of about `sample` rows, dealt to its own task and fitted there; the forest, of a size that
    trees and sample bound, is broadcast, and rows are scored where they are.
    """
    import json

    n = features.count()
    if not n:
        return features.select(key, F.lit(0.0).alias("score"), F.lit(False).alias("outlier"))
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    picks = features.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < min(1.0, sample / n))).alias("tree"), key, *columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        t = int(pdf["tree"].iloc[0])
        return pd.DataFrame({"tree": [t], "model": [json.dumps(_grow(pdf[columns].to_numpy(float), np.random.default_rng([seed, t]), max_depth))]})

    models = picks.groupBy("tree").applyInPandas(fit, "tree int, model string").orderBy("tree").collect()
    forest = features.sparkSession.sparkContext.broadcast([json.loads(m.model) for m in models])
    kind = dict(features.dtypes)[key]
    typical = float(_expected(min(sample, n)))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for tree in forest.value:
                _depths(tree, x, 0, total, np.arange(len(x)))
            yield pd.DataFrame({key: pdf[key], "score": 2 ** (-(total / max(1, len(forest.value))) / typical) if typical else np.zeros(len(pdf))})

    out = features.select(key, *columns).mapInPandas(score, f"{key} {kind}, score double")
    return out.withColumn("outlier", F.col("score") > threshold)


def sequence_anomaly(transfers: DataFrame, n: int = 10, change: float = 0.5, trend: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """Transfers at which the sender's last n differ from the n before: mean amount, mean gap, slope; score is the share of the three over their limits."""
    w = Window.partitionBy("from_address").orderBy("_us", "hash")
    now = w.rowsBetween(-(n - 1), 0)
    t = inter_transfer_gaps(transfers).withColumn("_us", micros("timestamp")).withColumn("_x", F.col("value").cast("double") / 1e12).withColumn("_i", F.row_number().over(w).cast("double"))
    t = t.withColumns({"_a": F.avg("_x").over(now), "_g": F.avg("gap_before").over(now), "_s": F.regr_slope("_x", "_i").over(now)})
    t = t.withColumns({"_a0": F.lag("_a", n).over(w), "_g0": F.lag("_g", n).over(w)}).where(F.col("_i") >= 2 * n)
    far = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) > change * F.abs(F.col(y)), F.lit(False)).cast("int")
    slope = F.coalesce(F.abs(F.col("_s")) > trend * F.abs(F.col("_a")), F.lit(False)).cast("int")
    t = t.withColumns({"by_amount": far("_a", "_a0"), "by_gap": far("_g", "_g0"), "by_trend": slope}).withColumn("score", (F.col("by_amount") + F.col("by_gap") + F.col("by_trend")) / 3)
    return t.where(F.col("score") > threshold).select("hash", "from_address", "by_amount", "by_gap", "by_trend", "score")


def _activity(transfers: DataFrame) -> DataFrame:
    return undirected_view(transfers).withColumn("_us", micros("timestamp"))


def rates(transfers: DataFrame, seconds: int) -> DataFrame:
    """Each event with n, volume and distinct partners of the window that ends with it, and the means of these over the address's events before the window."""
    v = rolling(_activity(transfers), (seconds,)).withColumnsRenamed({f"n_{seconds}": "n", f"partners_{seconds}": "partners"}).withColumn("volume", F.col(f"volume_{seconds}").cast("double") / 1e12)
    past = Window.partitionBy("address").orderBy("_us").rangeBetween(Window.unboundedPreceding, -seconds * US - 1)
    return v.withColumns({"n_before": F.avg("n").over(past), "volume_before": F.avg("volume").over(past), "volume_sd": F.stddev_pop("volume").over(past), "partners_before": F.avg("partners").over(past), "events_before": F.count("*").over(past)})


def burst_count(transfers: DataFrame, seconds: int = 900, multiple: float = 3.0, at_least: int = 3) -> DataFrame:
    r = rates(transfers, seconds).where((F.col("events_before") >= at_least) & (F.col("n") > multiple * F.col("n_before")))
    return r.select("address", "hash", "direction", (F.col("n") / F.col("n_before")).alias("ratio"))


def burst_volume(transfers: DataFrame, seconds: int = 3600, sigmas: float = 3.0, at_least: int = 3) -> DataFrame:
    r = rates(transfers, seconds).where((F.col("events_before") >= at_least) & (F.col("volume") > F.col("volume_before") + sigmas * F.col("volume_sd")))
    return r.select("address", "hash", "direction", "volume")


def burst_fee(transfers: DataFrame, fee: Column, seconds: int = 900, history: int = 100, multiple: float = 5.0, at_least: int = 5) -> DataFrame:
    """Events whose mean fee of the last seconds is `multiple` times that of the history rows before."""
    v = _activity(transfers.withColumn("_fee", fee))
    recent = Window.partitionBy("address").orderBy("_us").rangeBetween(-seconds * US, 0)
    past = Window.partitionBy("address").orderBy("_us", "hash", "direction").rowsBetween(-history, -1)
    v = v.withColumns({"_now": F.avg("_fee").over(recent), "_past": F.avg("_fee").over(past), "_n": F.count("_fee").over(past)})
    return v.where((F.col("_n") >= at_least) & (F.col("_now") > multiple * F.col("_past"))).select("address", "hash", "direction", (F.col("_now") / F.col("_past")).alias("ratio"))


def burst_counterparty(transfers: DataFrame, seconds: int = 3600, multiple: float = 3.0, at_least: int = 3) -> DataFrame:
    r = rates(transfers, seconds).where((F.col("events_before") >= at_least) & (F.col("partners") > multiple * F.col("partners_before")))
    return r.select("address", "hash", "direction", (F.col("partners") / F.col("partners_before")).alias("ratio"))


def burst_crosschain(calls: DataFrame, seconds: int = 1800, multiple: float = 4.0, when_new: float = 5.0) -> DataFrame:
    """Calls of a cross-chain module whose rate bursts: address, timestamp, module, destination come in; ratio and a histogram of destinations go out."""
    x = calls.where((F.col("module") == "xcm") | F.col("call").contains("xcm")).withColumn("_us", micros("timestamp"))
    recent = Window.partitionBy("address").orderBy("_us").rangeBetween(-seconds * US, 0)
    past = Window.partitionBy("address").orderBy("_us").rangeBetween(Window.unboundedPreceding, -seconds * US - 1)
    x = x.withColumn("_n", F.count("*").over(recent)).withColumn("_p", F.avg("_n").over(past))
    hot = x.where(F.when(F.col("_p").isNull(), F.col("_n") > when_new).otherwise(F.col("_n") > multiple * F.col("_p")))
    most = hot.groupBy("address").agg(F.max("_n").alias("most"), F.count("*").alias("events"))
    where = x.groupBy("address", "destination").count().groupBy("address").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("destination", "count")))).alias("destinations"))
    return most.join(where, "address")


def aggregate_bursts(bursts: DataFrame) -> DataFrame:
    """Bursts of an address within an hour as one: mean confidence * 1.5, at most 0.95, and a severity by the mean of severities (1 to 4)."""
    hour = F.floor(micros("timestamp") / (3600 * US))
    g = bursts.groupBy("address", hour.alias("window")).agg(F.count("*").alias("bursts"), F.countDistinct("kind").alias("kinds"), top(0.95, F.avg("confidence") * 1.5).alias("confidence"), F.avg("severity").alias("_s"))
    return g.withColumn("severity", ladder(F.col("_s"), [(3.5, "critical"), (2.5, "high"), (1.5, "medium")], "low")).drop("_s")


DORMANCY = [(365, "extreme"), (180, "deep"), (90, "moderate"), (30, "light")]


def dormancy(transfers: DataFrame, as_of: DataFrame, steps: list[tuple[float, str]] | None = None) -> DataFrame:
    """Days since an address was last active, a level, and what it did: transfers, mean amount, active days."""
    at = as_of.select(F.col(as_of.columns[0]).alias("as_of"))
    g = undirected_view(transfers).groupBy("address").agg(F.max("timestamp").alias("_last"), F.count("*").alias("n"), F.avg(F.col("value").cast("double") / 1e12).alias("mean_amount"), F.countDistinct(F.to_date("timestamp")).alias("active_days"))
    g = g.crossJoin(F.broadcast(at)).withColumn("dormant_days", days_between("_last", "as_of"))  # one row
    return g.withColumn("level", ladder(F.col("dormant_days"), steps or DORMANCY, "active")).drop("_last", "as_of")


def awakening(transfers: DataFrame, gap_days: float = 30, fan_out: int = 3) -> DataFrame:
    """Sessions that follow a gap: what they are (liquidation, distribution, consolidation, testing), volume against the time before, and timing.

    A liquidation sends over 80 % of what it moves to one or two accounts; a distribution sends to fan_out or more; a consolidation
    receives more than it sends; the rest are tests. Confidence 0.5 + 0.2 for volume over the past mean + 0.2 for regular gaps.
    """
    s = sessionise(undirected_view(transfers), ["address"], gap_days * DAY, ["hash", "direction"])
    w = Window.partitionBy("address").orderBy("_us", "hash", "direction")
    s = s.withColumn("_us", micros("timestamp")).withColumn("_gap", (F.col("_us") - F.lag("_us").over(w)) / US).withColumn("_x", F.col("value").cast("double") / 1e12)
    out = F.col("direction") == "out"
    # the gap that opens a session is its first row's, and not one of its own gaps
    first = F.min_by("_gap", F.struct("_us", "hash", "direction"))
    # sums run in order of time: grouping alone adds up in any order, and the last bit decides how ties are rounded
    so_far = Window.partitionBy("address", "session").orderBy("_us", "hash", "direction").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumns({"_sent": F.sum(F.when(out, F.col("_x")).otherwise(0.0)).over(so_far), "_received": F.sum(F.when(~out, F.col("_x")).otherwise(0.0)).over(so_far), "_gaps": F.sum("_gap").over(so_far)})
    last = F.max_by(F.struct("_sent", "_received", "_gaps"), F.struct("_us", "hash", "direction"))
    g = s.groupBy("address", "session").agg(
        F.count("*").alias("n"), last.alias("_last"), F.countDistinct(F.when(out, F.col("other"))).alias("destinations"), (first / DAY).alias("dormant_days"),
        first.alias("_g0"), F.min("timestamp").alias("start"),
    ).withColumns({"sent": F.col("_last._sent"), "received": F.col("_last._received"), "_gs": F.col("_last._gaps")})
    past = Window.partitionBy("address").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_all", F.col("sent") + F.col("received")).withColumn("_past", F.sum("_all").over(past) / F.sum("n").over(past)).where("session > 1")
    kind = F.when((F.col("sent") > 0.8 * F.col("_all")) & (F.col("destinations") <= 2), "liquidation").when(F.col("destinations") >= fan_out, "distribution").when(F.col("received") > F.col("sent"), "consolidation").otherwise("testing")
    g = g.withColumn("kind", kind).withColumn("volume_factor", F.col("_all") / F.col("n") / F.col("_past")).withColumn("mean_gap", F.when(F.col("n") > 1, (F.col("_gs") - F.col("_g0")) / (F.col("n") - 1)))
    confidence = 0.5 + F.when(F.col("volume_factor") > 1, 0.2).otherwise(0.0) + F.when(F.col("mean_gap") < 60, 0.2).otherwise(0.0)
    return g.select("address", "session", "n", "sent", "received", "destinations", "dormant_days", "kind", "volume_factor", "mean_gap", confidence.alias("confidence"))


def destination_profile(transfers: DataFrame, accounts: DataFrame, new_days: float = 7, high_risk: float = 70) -> DataFrame:
    """Per sender: distinct destinations that are exchanges, mixers, new at first contact, or of high risk; flagged with over three in all."""
    d = transfers.groupBy("from_address", "to_address").agg(F.min("timestamp").alias("_first")).join(accounts.select(F.col("address").alias("to_address"), "node_type", "created_at", "risk_score"), "to_address", "left")
    yes = lambda c: F.count(F.when(c, 1))
    g = d.groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("destinations"), yes(F.col("node_type") == "exchange").alias("exchanges"), yes(F.col("node_type") == "mixer").alias("mixers"), yes(days_between("created_at", "_first") < new_days).alias("new"), yes(F.col("risk_score") > high_risk).alias("high_risk"))
    return g.withColumn("flag", F.col("exchanges") + F.col("mixers") + F.col("new") + F.col("high_risk") > 3)


def consolidate_circles(cycles: DataFrame) -> DataFrame:
    """The best cycle confidence of each origin: 0.7 + 0.05 per edge beyond two + log10(bottleneck in units) / 20, at most 0.95."""
    units = F.col("bottleneck").cast("double") / 1e12
    c = top(0.95, 0.7 + 0.05 * (F.col("length") - 2) + F.when(units > 1, F.log10(units) / 20).otherwise(0.0))
    return cycles.groupBy(F.col("seed").alias("address")).agg(F.count("*").alias("cycles"), F.max(c).alias("confidence"))


def split_merge_flows(transfers: DataFrame, window_seconds: int = 86400, tolerance: float = 0.1, at_least: int = 2) -> DataFrame:
    """(origin, destination, vias, sent, merged): amounts that leave one account by two or more others and meet again at one, within the window and the tolerance."""
    from .joins import sequential_transfers

    s = sequential_transfers(transfers, window_seconds, None).where("from1 <> to2 and from1 <> to1 and to1 <> to2")
    # each transfer counts once on its leg of a route, whatever the number of pairs that it forms
    route = [F.col("from1").alias("origin"), F.col("to2").alias("destination"), F.col("to1").alias("via")]
    leg = lambda k: s.select(*route, F.lit(k).alias("leg"), F.col(f"hash{k}").alias("hash"), F.col(f"value{k}").alias("value"))
    x = F.col("value").cast("double") / 1e12
    legs = leg(1).unionByName(leg(2)).distinct()
    total = lambda k: F.sum(F.when(F.col("leg") == k, x))
    g = legs.groupBy("origin", "destination").agg(F.countDistinct("via").alias("vias"), total(1).alias("sent"), total(2).alias("merged"))
    return g.where((F.col("vias") >= at_least) & (F.abs(F.col("sent") - F.col("merged")) <= tolerance * F.col("sent")))


def similar_addresses(degrees: DataFrame, seeds: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(seed, other, similarity): 1 - mean relative difference of in-degree, out-degree and both volumes, for a query set of seeds.

    A mean difference below 1 - threshold needs a degree difference below 4 (1 - threshold) of the larger, so accounts are blocked by
    the logarithm of their degree and a seed looks only into its own block and the near ones.
    """
    import math

    step = math.log(1 / (1 - 4 * (1 - threshold))) if 4 * (1 - threshold) < 1 else None
    v = lambda c: F.col(c).cast("double")
    d = degrees.select("address", v("in_degree").alias("a"), v("out_degree").alias("b"), v("total_volume_in").alias("c"), v("total_volume_out").alias("d")).withColumn("_k", F.floor(F.log1p(F.col("a")) / (step or 100)))
    left = d.join(seeds.select("address").distinct(), "address").select(F.col("address").alias("seed"), *(F.col(x).alias(f"{x}1") for x in "abcd"), F.explode(F.sequence(F.col("_k") - 2, F.col("_k") + 2)).alias("_k"))
    diff = lambda x: F.when(F.greatest(F.col(x), F.col(f"{x}1")) > 0, F.abs(F.col(x) - F.col(f"{x}1")) / F.greatest(F.col(x), F.col(f"{x}1"))).otherwise(0.0)
    j = left.join(d, "_k").where("seed <> address")
    return j.select("seed", F.col("address").alias("other"), (1 - (diff("a") + diff("b") + diff("c") + diff("d")) / 4).alias("similarity")).where(F.col("similarity") >= threshold)


def timed_circles(periodic: DataFrame) -> DataFrame:
    return periodic.withColumn("confidence", top(0.9, 0.5 + F.col("n") / 20))


def account_features(statistics: DataFrame) -> DataFrame:
    """Numbers of an account in comparable ranges: transfers / 1e4, partners / 1e3, log10 of volume / 10, share received."""
    return statistics.select("address", (F.col("n_total") / 1e4).alias("f1"), (F.col("unique_counterparties") / 1e3).alias("f2"), (F.log10(1 + F.col("total_volume").cast("double") / 1e12) / 10).alias("f3"), (F.col("n_in") / F.col("n_total")).alias("f4"))


def account_clusters(features: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """(address, cluster) by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("address", F.col("prediction").alias("cluster"))


def reconstruction_outliers(features: DataFrame, columns: list[str], components: int = 2, share: float = 0.95) -> DataFrame:
    """(address, error, outlier): what principal components leave unexplained, against its own 95th percentile."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="_raw").transform(features)
    x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(x).transform(x)
    model = PCA(k=components, inputCol="_x", outputCol="_p").fit(x)
    from pyspark.ml.functions import vector_to_array

    pc = model.pc.toArray()  # columns x components
    p = model.transform(x).select("address", vector_to_array("_x").alias("x"), vector_to_array("_p").alias("p"))
    back = [sum((F.col("p")[j] * float(pc[i, j]) for j in range(components)), F.lit(0.0)) for i in range(len(columns))]
    e = p.select("address", F.sqrt(sum(((F.col("x")[i] - back[i]) * (F.col("x")[i] - back[i]) for i in range(len(columns))), F.lit(0.0))).alias("error"))
    limit = e.agg(F.percentile_approx("error", share, 10000).alias("_limit"))
    return e.crossJoin(F.broadcast(limit)).select("address", "error", (F.col("error") > F.col("_limit")).alias("outlier"))  # one row


def newest(transfers: DataFrame, n: int = 10) -> DataFrame:
    return topk(transfers, ["from_address"], [F.col("timestamp").desc(), F.col("hash")], n)
