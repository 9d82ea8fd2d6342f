"""Window operators: ranks by histogram, gaps, sessions, rolling and outlier measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros
from ..plans.cut import materialise
from .aggregates import prefix_of_values
from .sets import undirected_view

US = 1_000_000


def strict_rank_fraction(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the share of rows that have a strictly smaller value (nulls: null), from a histogram rather than a global window."""
    h = prefix_of_values(df, column)
    n = h.agg(F.sum("n").alias("_all"))
    ranks = h.crossJoin(F.broadcast(n)).select(F.col("value").alias(column), (F.col("before") / F.col("_all")).alias(name))  # one row
    return df.join(ranks, column, "left")


def percent_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with (rank - 1) / (rows - 1), as percent_rank() over all rows gives."""
    h = prefix_of_values(df, column)
    n = h.agg(F.sum("n").alias("_all"))
    ranks = h.crossJoin(F.broadcast(n)).select(F.col("value").alias(column), F.when(F.col("_all") > 1, F.col("before") / (F.col("_all") - 1)).otherwise(0.0).alias(name))  # one row
    return df.join(ranks, column, "left")


def inter_transfer_gaps(transfers: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Each transfer with the seconds since the sender's previous one and until the next."""
    w = Window.partitionBy(*(key or ["from_address"])).orderBy("_us", "hash")
    t = transfers.withColumn("_us", micros("timestamp"))
    return t.withColumn("gap_before", (F.col("_us") - F.lag("_us").over(w)) / US).withColumn("gap_after", (F.lead("_us").over(w) - F.col("_us")) / US).drop("_us")


def periodic_pairs(transfers: DataFrame, max_variation: float = 0.2, max_interval: float | None = None, at_least: int = 3) -> DataFrame:
    """Pairs with at_least transfers whose gaps vary little: mean and standard deviation of the gaps."""
    g = inter_transfer_gaps(transfers, ["from_address", "to_address"]).groupBy("from_address", "to_address").agg(F.count("*").alias("n"), F.avg("gap_before").alias("mean_gap"), F.stddev_samp("gap_before").alias("stddev_gap"))
    out = g.where((F.col("n") >= at_least) & (F.col("stddev_gap") < max_variation * F.col("mean_gap")))
    return out if max_interval is None else out.where(F.col("mean_gap") <= max_interval)


def rank_per_parent(edges: DataFrame) -> DataFrame:
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("from_address").orderBy(F.col("total_volume").desc(), "to_address")))


def node_rankings(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A rank (1 is highest, ties share it) and a percentile per column, and hub (degree rank to 20), connector (to 50) or peripheral."""
    out = metrics
    for c in columns:
        h = prefix_of_values(metrics, c)
        n = h.agg(F.sum("n").alias("_all"))
        ranks = h.crossJoin(F.broadcast(n)).select(F.col("value").alias(c), (F.col("_all") - F.col("before") - F.col("n") + 1).alias(f"{c}_rank"), (100 * F.col("before") / F.col("_all")).alias(f"{c}_percentile"))  # one row
        out = out.join(ranks, c)
    first = F.col(f"{columns[0]}_rank")
    return out.withColumn("category", F.when(first <= 20, "hub").when(first <= 50, "connector").otherwise("peripheral"))


def sessionise(events: DataFrame, key: list[str], gap_seconds: float, order: list[str]) -> DataFrame:
    """events with a session number per key: a new one begins after a gap of more than gap_seconds."""
    w = Window.partitionBy(*key).orderBy("_us", *order)
    e = events.withColumn("_us", micros("timestamp"))
    new = (F.col("_us") - F.lag("_us").over(w) > int(gap_seconds * US)) | F.lag("_us").over(w).isNull()
    return e.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_us", "_new")


def sessions(transfers: DataFrame, gap_seconds: float = 300, key: str = "from_address") -> DataFrame:
    s = sessionise(transfers, [key], gap_seconds, ["hash"])
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.sum("value").cast("decimal(38,0)").alias("volume"))


def _changes(windows: tuple[int, ...], width: int) -> str:
    """What an event does to the running figures of its block: it comes (live rows are those of the block itself), leaves each window, and yields to its partner's next event."""
    start = f"_block * {width}"

    def change(when: str, at: str, live: str, amounts: dict[str, str]) -> str:
        figures = []
        for w in windows:
            n, volume, partners = (amounts.get(f"{c}_{w}", "0") for c in ("n", "volume", "partners"))
            figures.append(f"'n_{w}', cast({n} as long), 'volume_{w}', cast({volume} as decimal(38,0)), 'partners_{w}', cast({partners} as long)")
        return f"if({when}, named_struct('_at', {at}, '_live', {live}, {', '.join(figures)}), null)"

    comes, rest = {}, []
    gone = {w: f"(_us + {w * US + 1})" for w in windows}
    for w in windows:
        alive = f"{gone[w]} > {start}"  # else it left before the block began
        yields = f"coalesce(_next < {gone[w]}, false)"
        comes |= {f"n_{w}": f"if({alive}, 1, 0)", f"volume_{w}": f"if({alive}, value, 0)", f"partners_{w}": f"if({alive}, 1, 0)"}
        leaves = {f"n_{w}": "-1", f"volume_{w}": "-value", f"partners_{w}": f"if({yields}, 0, -1)"}
        rest.append(change(f"{alive} and {gone[w]} < {start} + {width}", gone[w], "false", leaves))
        rest.append(change(f"{alive} and {yields} and _next < {start} + {width}", "_next", "false", {f"partners_{w}": "-1"}))
    return f"array({change(f'{gone[max(windows)]} > {start}', '_us', f'_us >= {start}', comes)}, {', '.join(rest)})"


def rolling(events: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """events (address, other, _us, value, ...) with n_w, volume_w and partners_w of the w seconds that end with each event, ties included.

    Time is cut into blocks as long as the longest window, and an event goes to its own block and, as what is carried in, to the next
    one; no window ends later. So an address, however busy, is spread over its blocks, and one shuffle by (address, block) serves all.
    Within a block what an event adds it takes away again when it leaves the window or, for the partner, when the next event with that partner
    takes over: every figure is a running sum over the changes, and no window's rows are read again for each event.
    """
    width = max(windows) * US
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: few bytes make many changes, so AQE should not merge tasks
    block = F.floor(F.col("_us") / width)
    dealt = events.withColumn("_block", F.explode(F.array(block, block + 1))).repartition(parts, "address", "_block")
    seen = dealt.withColumn("_next", F.lead("_us").over(Window.partitionBy("address", "_block", "other").orderBy("_us")))
    row = ", ".join(c for c in events.columns if c != "address")
    rows = seen.selectExpr("address", "_block", f"struct({row}) as _row", f"explode({_changes(windows, width)}) as _c").where("_c is not null")
    flat = rows.selectExpr("address", "_block", "if(_c._live, _row, null) as _row", "_c.*")
    until = "over (partition by address, _block order by _at range between unbounded preceding and current row)"
    sums = [f"cast(sum({c}_{w}) {until} as {kind}) as {c}_{w}" for w in windows for c, kind in (("n", "long"), ("volume", "decimal(38,0)"), ("partners", "long"))]
    return flat.selectExpr("address", "_live", "_row", *sums).where("_live").selectExpr("address", "_row.*", *(f"{c}_{w}" for w in windows for c in ("n", "volume", "partners")))


def rolling_activity(transfers: DataFrame, windows: tuple[int, ...] = (300, 900, 3600)) -> DataFrame:
    """For each event of an address the count, volume and distinct counterparties of the window that ends with it."""
    return rolling(undirected_view(transfers).withColumn("_us", micros("timestamp")), windows).drop("_us")


def balance_events(transfers: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """(address, timestamp, hash, balance): the running balance after each transfer, starting from 0; a transfer to oneself is two rows.

    A running sum in two levels: totals of each (address, block of time) are carried to the blocks that follow, and rows are summed within their block
    only, so a busy address is spread over its blocks.
    """
    v = undirected_view(transfers).withColumn("_us", micros("timestamp")).withColumn("_block", F.floor(F.col("_us") / (block_seconds * US)))
    signed = F.when(F.col("direction") == "in", F.col("value")).otherwise(-F.col("value"))
    inside = Window.partitionBy("address", "_block").orderBy("_us", "hash", "direction").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("address").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = v.groupBy("address", "_block").agg(F.sum(signed).cast("decimal(38,0)").alias("_total"))
    carried = totals.select("address", "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("decimal(38,0)").alias("_carried"))
    running = v.withColumn("_running", F.sum(signed).over(inside).cast("decimal(38,0)")).join(carried, ["address", "_block"])
    balance = (F.col("_running") + F.col("_carried")).cast("decimal(38,0)").cast("double") / 1e12
    return running.select("address", "timestamp", "hash", "direction", balance.alias("balance"))


def balance_profile(balances: DataFrame, alpha: float = 0.1, history: int = 100, block_seconds: int = 86_400, chunk: int = 1_024) -> DataFrame:
    """Per address: number of events, exponential moving average and deviation of the balance, mean absolute change, last balance, size of the kept history.

    The averages are folds over the events in order: average = alpha x + (1 - alpha) average, from the first balance, and the same for the
    distance of x from the new average, from 0. A run of events is an affine map (a, b) of the average before it, and maps compose. So an address's events are
    numbered (counts of its blocks of time are carried on, rows are numbered within a block) and cut into chunks, each folded to its map; the maps
    of an address are composed by a scan whose lags double; then each chunk is folded again from the average that it starts with. The deviation is linear in
    its start, so chunks add up, each weighted by the events after it. An address meets in one task only as maps, one row of a few numbers per
    chunk; one of no more than `chunk` events is the plain fold.
    """
    keep = 1.0 - alpha
    inside = Window.partitionBy("address", "_block").orderBy("_us", "hash", "direction")
    b = balances.withColumn("_us", micros("timestamp")).withColumn("_block", F.floor(F.col("_us") / (block_seconds * US)))
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("address").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier")
    counts = b.groupBy("address", "_block").count().select("address", "_block", earlier)
    placed = b.withColumn("_n", F.row_number().over(inside)).join(counts, ["address", "_block"]).withColumn("_i", F.col("_earlier") + F.col("_n") - 1)
    rows = placed.groupBy("address", F.floor(F.col("_i") / chunk).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_i", "balance"))).alias("x"))
    rows = rows.select("address", "_part", F.col("x.balance").alias("x"))
    fold = f"aggregate(x, cast(0 as double), (e, v) -> {alpha!r}D * v + {keep!r}D * e) as b"
    change = "aggregate(x, named_struct('last', x[0], 'sum', cast(0 as double)), (s, v) -> named_struct('last', v, 'sum', s.sum + abs(v - s.last)), s -> s.sum) as change"
    chunks = materialise(rows.selectExpr("address", "_part", "x", "cast(size(x) as long) as m", f"pow({keep!r}D, size(x)) as a", fold, change))
    parts = int(chunks.agg(F.coalesce(F.max("_part") + 1, F.lit(0))).first()[0])
    forward, back = Window.partitionBy("address").orderBy("_part"), Window.partitionBy("address").orderBy(F.col("_part").desc())
    maps = chunks.select("address", "_part", "m", "a", "b", "change", F.col("x")[0].alias("first"), F.lag(F.element_at("x", -1)).over(forward).alias("last"))
    maps = maps.withColumn("start", F.first("first").over(forward)).withColumn("change", F.col("change") + F.coalesce(F.abs(F.col("first") - F.col("last")), F.lit(0.0)))
    for k in range((parts - 1).bit_length() if parts else 0):
        maps = maps.withColumn("_a", F.coalesce(F.lag("a", 1 << k).over(forward), F.lit(1.0))).withColumn("_b", F.coalesce(F.lag("b", 1 << k).over(forward), F.lit(0.0)))
        maps = maps.withColumns({"a": F.col("a") * F.col("_a"), "b": F.col("a") * F.col("_b") + F.col("b")})
    before = F.coalesce(F.lag("a").over(forward) * F.col("start") + F.lag("b").over(forward), F.col("start"))
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    maps = maps.select("address", "_part", F.coalesce("last", "first").alias("last"), before.alias("before"), sum_of("m", forward).alias("had"), sum_of("change", forward).alias("changed"), sum_of("m", back).alias("after"))
    average = f"({alpha!r}D * v + {keep!r}D * s.ema)"
    start = "named_struct('ema', before, 'deviation', cast(0 as double), 'mean', changed / greatest(had - 1, 1), 'last', last, 'n', had)"
    step = (
        f"named_struct('ema', if(s.n = 0, v, {average}), 'deviation', if(s.n = 0, cast(0 as double), {alpha!r}D * abs(v - {average}) + {keep!r}D * s.deviation), "
        "'mean', if(s.n = 0, cast(0 as double), s.mean + (abs(v - s.last) - s.mean) / s.n), 'last', v, 'n', s.n + 1)"
    )
    done = chunks.select("address", "_part", "x").join(maps, ["address", "_part"]).withColumn("s", F.expr(f"aggregate(x, {start}, (s, v) -> {step})"))
    last = F.max_by(F.struct("s.ema", "s.mean", "s.last", "s.n"), "_part").alias("last")
    out = done.groupBy("address").agg(last, F.sum(F.col("s.deviation") * F.pow(F.lit(keep), F.col("after"))).alias("deviation"))
    return out.select("address", "last.n", "last.ema", "deviation", F.col("last.mean").alias("mean_change"), F.col("last.last").alias("last_balance"), F.least("last.n", F.lit(history).cast("long")).alias("kept"))


def history_before(key: str, rows: int) -> Window:
    return Window.partitionBy(key).orderBy("_us", "hash", "direction").rowsBetween(-rows, -1)


def median_of(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    at = lambda k: F.element_at(sorted_array, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def robust_zscore(balances: DataFrame, history: int = 30, at_least: int = 5, limit: float = 3.5) -> DataFrame:
    """Each event with 0.6745 (x - median) / MAD over the history before it, and whether that is beyond the limit."""
    b = balances.withColumn("_us", micros("timestamp")).withColumn("_h", F.array_sort(F.collect_list("balance").over(history_before("address", history))))
    # explode of one value keeps the optimizer from writing the sorted arrays out once for every use of median and mad
    b = b.withColumn("median", F.explode(F.array(median_of(F.col("_h"))))).withColumn("mad", F.explode(F.array(median_of(F.array_sort(F.transform("_h", lambda x: F.abs(x - F.col("median"))))))))
    z = F.when((F.size("_h") >= at_least) & (F.col("mad") > 0), 0.6745 * (F.col("balance") - F.col("median")) / F.col("mad"))
    return b.withColumn("z", z).withColumn("outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_us", "_h")


def iqr_outliers(balances: DataFrame, history: int = 100, at_least: int = 5) -> DataFrame:
    """Each event with the quartiles (by index floor) of the history before it and whether it is beyond 1.5 IQR."""
    b = balances.withColumn("_us", micros("timestamp")).withColumn("_h", F.array_sort(F.collect_list("balance").over(history_before("address", history))))
    q = lambda p: F.when(F.size("_h") >= at_least, F.element_at("_h", (F.floor(F.size("_h") * p) + 1).cast("int")))
    b = b.withColumn("q1", q(0.25)).withColumn("q3", q(0.75))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return b.withColumn("outlier", F.coalesce((F.col("balance") < F.col("q1") - spread) | (F.col("balance") > F.col("q3") + spread), F.lit(False))).drop("_us", "_h")


def linear_trend(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Least-squares slope of value over its position (from 0) in each key, and slope over the first value."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_x", (F.row_number().over(w) - 1).cast("double")).withColumn("_y", F.col(value).cast("double"))
    return d.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.min_by("_y", "_x").alias("first")).withColumn("relative", F.when(F.col("first") != 0, F.col("slope") / F.col("first")))


def periodicity(transfers: DataFrame) -> DataFrame:
    """Per sender 1 - min(1, mean |gap - mean| / mean): 1 is perfectly regular."""
    g = inter_transfer_gaps(transfers).where("gap_before is not null").select("from_address", "gap_before")
    mean = g.groupBy("from_address").agg(F.avg("gap_before").alias("mean"), F.count("*").alias("n"))
    both = g.join(mean, "from_address")
    out = both.groupBy("from_address").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.avg(F.abs(F.col("gap_before") - F.col("mean"))).alias("spread"))
    return out.select("from_address", "n", F.when(F.col("mean") > 0, 1 - F.least(F.col("spread") / F.col("mean"), F.lit(1.0))).otherwise(0.0).alias("periodicity"))


def uniformity(df: DataFrame, key: str, value: str) -> DataFrame:
    """max(0, 1 - population deviation / mean); 0 without values or with mean 0."""
    x = F.col(value).cast("double")
    g = df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(value).alias("n"))
    return g.select(key, "n", F.when((F.col("n") > 0) & (F.col("mean") != 0), F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean"))).otherwise(0.0).alias("uniformity"))
