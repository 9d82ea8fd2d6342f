"""The alert pipeline: one schema, deduplication, filters, correlation, priority. alerts: id, type, address, timestamp, confidence, severity (1 to 4), value, metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import c_exp, c_log10, c_power, normal_cdf
from ..functions.times import days_between, micros
from ..plans.ranges import as_of
from .filters import ladder

US = 1_000_000
LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def top(limit: float, x: Column) -> Column:
    return F.least(F.lit(float(limit)), x)


def severity_number(name: Column) -> Column:
    return F.coalesce(*(F.when(name == k, n) for k, n in LEVELS.items()))


def severity_name(number: Column) -> Column:
    return ladder(number, [(4, "critical"), (3, "high"), (2, "medium")], "low")


def format_alerts(detections: DataFrame) -> DataFrame:
    """Detections in the common schema; without a severity, over 0.8 confidence is high, over 0.5 medium."""
    inferred = F.when(F.col("confidence") > 0.8, 3).when(F.col("confidence") > 0.5, 2).otherwise(1)
    return detections.select(
        F.sha2(F.concat_ws("|", "pattern_type", "address", micros("detected_at").cast("string")), 256).alias("id"), F.col("pattern_type").alias("type"), "address", F.col("detected_at").alias("timestamp"), "confidence",
        F.coalesce(severity_number(F.col("severity")), inferred).alias("severity"), "value", "metadata",
    )


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts of one type, address and minute as one: count, first and last seen, confidence 10 % up per repeat, at most 0.95."""
    minute = F.floor(micros("timestamp") / (60 * US))
    g = alerts.groupBy("type", "address", minute.alias("minute")).agg(
        F.min("id").alias("id"), F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.max("confidence").alias("_c"), F.max("severity").alias("severity"), F.sum("value").alias("value")
    )
    return g.withColumn("confidence", F.when(F.col("count") > 1, top(0.95, F.col("_c") * c_power(1.1, F.col("count") - 1))).otherwise(F.col("_c"))).drop("_c")


def whitelist_filter(alerts: DataFrame, whitelist: DataFrame, accounts: DataFrame) -> DataFrame:
    """Without whitelisted addresses; those of exchanges lose one severity and 30 % of confidence."""
    j = alerts.join(whitelist.select("address"), "address", "left_anti").join(accounts.select("address", "node_type"), "address", "left")
    exchange = F.coalesce(F.col("node_type") == "exchange", F.lit(False))
    return j.withColumn("severity", F.when(exchange, F.greatest(F.lit(1), F.col("severity") - 1)).otherwise(F.col("severity"))).withColumn("confidence", F.when(exchange, F.col("confidence") * 0.7).otherwise(F.col("confidence"))).drop("node_type")


def known_pattern_filter(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Without alerts whose type and a metadata flag of their own are in rules (type, flag), a table of a few rows. Alerts of one id are told apart: an id is made of type, address and time alone."""
    known = rules.groupBy("type").agg(F.collect_set("flag").alias("_known"))
    flagged = F.exists("_known", lambda flag: F.coalesce(F.col("metadata")[flag] == "true", F.lit(False)))
    return alerts.join(F.broadcast(known), "type", "left").where(~F.coalesce(flagged, F.lit(False))).drop("_known")


def context_filter(alerts: DataFrame, drop: list[str], discount: dict[str, float]) -> DataFrame:
    """Without alerts that carry a flag of `drop`; each flag of `discount` multiplies the confidence."""
    on = lambda f: F.coalesce(F.col("metadata")[f] == "true", F.lit(False))
    out = alerts
    for f in drop:
        out = out.where(~on(f))
    for f, factor in discount.items():
        out = out.withColumn("confidence", F.when(on(f), F.col("confidence") * factor).otherwise(F.col("confidence")))
    return out


def significance_filter(alerts: DataFrame, at_least: int = 30, p_limit: float = 0.05, keep_significant: bool = False) -> DataFrame:
    """Tests each value against its type's values (at_least of them). As written it drops significant alerts (p below the limit); keep_significant turns that round."""
    base = alerts.groupBy("type").agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    j = alerts.join(base, "type").withColumn("p", F.when((F.col("_n") >= at_least) & (F.col("_s") > 0), 2 * (1 - normal_cdf(F.abs((F.col("value") - F.col("_m")) / F.col("_s"))))))
    keep = F.col("p") < p_limit if keep_significant else F.col("p") >= p_limit
    return j.where(F.col("p").isNull() | keep).drop("_n", "_m", "_s")


def heuristic_filter(alerts: DataFrame) -> DataFrame:
    """score 0.5 + 0.2 confidence + 0.15 severity / 3 + 0.1 for a value + 0.1 for metadata + up to 0.15 for repeats; over 0.7 confidence gains 10 %, over 0.3 it loses 20 %, the rest goes."""
    repeats = F.coalesce(F.col("count"), F.lit(1)) if "count" in alerts.columns else F.lit(1)
    told = F.when(F.col("value") > 0, 0.1).otherwise(0.0) + F.when(F.coalesce(F.size("metadata"), F.lit(0)) > 0, 0.1).otherwise(0.0)
    score = 0.5 + 0.2 * F.col("confidence") + 0.15 * F.least(F.col("severity"), F.lit(3)) / 3 + told + top(0.15, 0.05 * (repeats - 1))
    a = alerts.withColumn("score", score)
    return a.where(F.col("score") > 0.3).withColumn("confidence", F.when(F.col("score") > 0.7, top(0.95, F.col("confidence") * 1.1)).otherwise(F.col("confidence") * 0.8))


def correlate_alerts(alerts: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Groups anchored at their first alert: (address, start, end, n, types, severity, confidence, strength).

    Whether an alert opens a group depends on where the last one opened, a fold that no window frame expresses: alerts stream in
    sorted order through pandas, with the open group as the only state.
    """
    names = ["address", "start_us", "end_us", "n", "types", "severity", "confidence"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list | None = None
        for pdf in parts:
            done = []
            for address, us, kind, severity, confidence in pdf.itertuples(index=False):
                if open_ and open_[0] == address and us - open_[1] <= window_seconds * US:
                    open_[2], open_[3], open_[5], open_[6] = us, open_[3] + 1, max(open_[5], severity), open_[6] + confidence
                    open_[4].add(kind)
                else:
                    if open_:
                        done.append([*open_[:4], ",".join(sorted(open_[4])), *open_[5:]])
                    open_ = [address, us, us, 1, {kind}, severity, confidence]
            if done:
                yield pd.DataFrame(done, columns=names)
        if open_:
            yield pd.DataFrame([[*open_[:4], ",".join(sorted(open_[4])), *open_[5:]]], columns=names)

    rows = alerts.select("address", micros("timestamp").alias("us"), "type", F.col("severity").cast("int").alias("severity"), "confidence").repartition("address").sortWithinPartitions("address", "us", "type", "confidence")
    g = rows.mapInPandas(run, "address string, start_us long, end_us long, n long, types string, severity int, confidence double")
    kinds = F.size(F.split("types", ","))
    return g.withColumn("confidence", F.when(F.col("n") > 1, top(0.95, F.col("confidence") / F.col("n") * 1.2)).otherwise(F.col("confidence"))).withColumn("strength", top(1, 0.3 * kinds + 0.1 * F.col("n")))


def detector_accuracy(feedback: DataFrame, at_least: int = 10) -> DataFrame:
    """Share of true positives of each type; 0.5 with fewer than at_least reports."""
    g = feedback.groupBy("type").agg(F.count("*").alias("n"), F.count(F.when(F.col("true_positive"), 1)).alias("tp"))
    return g.select("type", "n", F.when(F.col("n") >= at_least, F.col("tp") / F.col("n")).otherwise(0.5).alias("accuracy"))


def priority_score(alerts: DataFrame, accuracy: DataFrame, as_of: DataFrame) -> DataFrame:
    """0.25 confidence + 0.20 severity / 4 + 0.20 impact + 0.15 recency + 0.10 repeats + 0.10 accuracy; 1.2 times for critical, 0.8 for low.

    Exponential and logarithm are the C library's, as ranks tell priorities apart to the last bit.
    """
    at = as_of.select(F.col(as_of.columns[0]).alias("as_of"))
    a = alerts.join(accuracy.select("type", "accuracy"), "type", "left").crossJoin(F.broadcast(at))  # one row
    impact = top(1, c_log10(1 + F.coalesce("value", F.lit(0.0))) / 3)
    recency = c_exp(-days_between("last_seen", "as_of"))
    s = 0.25 * F.col("confidence") + F.col("severity") * 2 / 10 / 4 + 0.2 * impact + 0.15 * recency + 0.1 * top(1, F.col("count") / 10) + 0.1 * F.coalesce("accuracy", F.lit(0.5))
    factor = F.when(F.col("severity") == 4, 1.2).when(F.col("severity") == 1, 0.8).otherwise(1.0)
    return a.withColumn("priority", s * factor).drop("as_of", "accuracy")


def with_correlated(alerts: DataFrame, window_seconds: int = 300) -> DataFrame:
    """alerts with `correlated`, the number of other alerts in their group of correlate_alerts(): groups of an address do not overlap, so an alert's is the last to begin."""
    groups = correlate_alerts(alerts, window_seconds).select("address", "start_us", "n")
    placed = as_of(alerts.withColumn("_us", micros("timestamp")), groups, "_us", "start_us", "n", 86_400 * US, ["address"])
    return placed.withColumn("correlated", F.coalesce(F.col("n") - 1, F.lit(0))).drop("n", "_us")


def priority_of_correlated(
    alerts: DataFrame, accuracy: DataFrame, accounts: DataFrame, as_of_time: DataFrame, boosted: tuple[str, ...] = ("COORDINATED_ACTIVITY", "MIXING_PATTERNS"), systemic: tuple[str, ...] = (),
    known: str = "known_pattern", price: float = 5.0, rich: float = 1e15,
) -> DataFrame:
    """alerts (with `correlated`) and their priority, at most 1.

    0.25 confidence + 0.20 severity (low 0.33, medium 0.67, else 1) + 0.20 impact + 0.15 recency + 0.10 correlation + 0.10 accuracy of the type (0.5 if
    unknown). Impact is the greater of value x price in millions and 0.8 for a systemic type; recency 1, 0.8, 0.6, 0.4 or 0.2 for an age under 1, 6,
    24, 72 hours or more; correlation 0.5 and a tenth for each correlated alert. Then 1.2 times for boosted types, 1.15 for an account with a
    balance over `rich`, 0.8 if the metadata flag `known` is set, 1.1 between 2 and 5 o'clock. Null values count as 0, unknown accounts as not rich.
    """
    at = as_of_time.select(F.col(as_of_time.columns[0]).alias("as_of"))
    a = alerts.join(accuracy.select("type", "accuracy"), "type", "left").join(accounts.select("address", F.col("balance").cast("double").alias("_balance")), "address", "left")
    a = a.crossJoin(F.broadcast(at))  # one row
    hours = days_between("timestamp", "as_of") * 24
    recency = F.when(hours < 1, 1.0).when(hours < 6, 0.8).when(hours < 24, 0.6).when(hours < 72, 0.4).otherwise(0.2)
    severity = F.when(F.col("severity") == 1, 0.33).when(F.col("severity") == 2, 0.67).otherwise(1.0)
    impact = F.greatest(top(1, F.coalesce("value", F.lit(0.0)) * price / 1e6), F.when(F.col("type").isin(*systemic), 0.8).otherwise(0.0))
    confidence = top(1, F.greatest(F.col("confidence"), F.lit(0.0)))
    score = 0.25 * confidence + 0.2 * severity + 0.2 * impact + 0.15 * recency + 0.1 * top(1, 0.5 + F.col("correlated") / 10) + 0.1 * F.coalesce("accuracy", F.lit(0.5))
    yes = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(1.0)
    factor = yes(F.col("type").isin(*boosted), 1.2) * yes(F.col("_balance") > rich, 1.15) * yes(F.col("metadata")[known] == "true", 0.8) * yes(F.hour("timestamp").between(2, 5), 1.1)
    return a.withColumn("priority", top(1, score * factor)).drop("as_of", "accuracy", "_balance")


def priority_levels(scored: DataFrame, shares: tuple[float, float, float] = (0.05, 0.2, 0.5)) -> DataFrame:
    """Rank by priority and critical, high, medium or low by the top shares; ranks come from a histogram, equal priorities share one."""
    from .aggregates import prefix_of_values

    h = prefix_of_values(scored, "priority")
    n = h.agg(F.sum("n").alias("_all"))
    r = h.crossJoin(F.broadcast(n)).select(F.col("value").alias("priority"), (F.col("_all") - F.col("before") - F.col("n") + 1).alias("rank"), "_all")  # one row
    share = (F.col("rank") - 1) / F.col("_all")
    return scored.join(r, "priority").withColumn("level", F.when(share < shares[0], "critical").when(share < shares[1], "high").when(share < shares[2], "medium").otherwise("low")).drop("_all")


def priority_summary(leveled: DataFrame) -> DataFrame:
    return leveled.groupBy("level", "type").agg(F.count("*").alias("n"), F.avg("priority").alias("mean_priority"), F.max("priority").alias("top_priority"))


def reduction_report(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(position, stage, alerts, kept): rows after each stage and their share of the first."""
    out = None
    for k, (name, df) in enumerate(stages):
        c = df.agg(F.count("*").alias("alerts")).select(F.lit(k).alias("position"), F.lit(name).alias("stage"), "alerts")
        out = c if out is None else out.unionByName(c)
    first = F.max(F.when(F.col("position") == 0, F.col("alerts"))).over(Window.partitionBy())  # a row per stage
    return out.withColumn("kept", F.when(first > 0, F.col("alerts") / first))


def run_pipeline(detections: DataFrame, whitelist: DataFrame, accounts: DataFrame, rules: DataFrame, feedback: DataFrame, as_of: DataFrame) -> DataFrame:
    """Detections to ranked alerts."""
    a = format_alerts(detections)
    a = context_filter(known_pattern_filter(whitelist_filter(a, whitelist, accounts), rules), ["maintenance"], {"routine": 0.8})
    a = heuristic_filter(significance_filter(a))
    return priority_levels(priority_score(dedup_alerts(a), detector_accuracy(feedback), as_of))
