"""Rolling windows by blocks of time: a busy address against brute force, and its plan."""

import datetime
import random
import re
from decimal import Decimal

import pytest

from transfergraph.operators import windows as W

START = datetime.datetime(2024, 1, 1)


def events(spark, n, seed):
    """Half of all transfers are those of one address; times tie and lie on the ends of windows."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        at = START + datetime.timedelta(seconds=r.choice([0, 60, 300, 600, 900]) + 300 * r.randrange(40), microseconds=r.choice([0, 0, 1]))
        a, b = ("hot", f"a{r.randrange(6)}") if r.random() < 0.5 else (f"a{r.randrange(6)}", f"a{r.randrange(6)}")
        rows.append((f"h{k}", at, a, b, Decimal(r.randint(0, 10**20))))
    return rows, spark.createDataFrame(rows, "hash string, timestamp timestamp, from_address string, to_address string, value decimal(38,0)").repartition(5)


def test_rolling_of_a_busy_address(spark):
    rows, transfers = events(spark, 600, 1)
    windows = (300, 900, 3600)
    both = [(a, b, at, v, h, "out") for h, at, a, b, v in rows] + [(b, a, at, v, h, "in") for h, at, a, b, v in rows]
    want = {}
    for a, _, at, _, h, way in both:
        for w in windows:
            seen = [x for x in both if x[0] == a and datetime.timedelta(0) <= at - x[2] <= datetime.timedelta(seconds=w)]
            want[a, h, way, w] = (len(seen), sum(x[3] for x in seen), len({x[1] for x in seen}))
    got = W.rolling_activity(transfers, windows).collect()
    assert len(got) == len(both)
    assert {(r.address, r.hash, r.direction, w): (r[f"n_{w}"], r[f"volume_{w}"], r[f"partners_{w}"]) for r in got for w in windows} == want


def test_no_window_over_an_address_alone(spark):
    _, transfers = events(spark, 20, 2)
    plan = W.rolling_activity(transfers)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"windowspecdefinition\((address#\d+, \w+)", plan)
    assert keys and all("_block" in k for k in keys)
    assert len(re.findall(r"Exchange hashpartitioning\(address", plan)) == 1, "one shuffle serves all windows"


def test_rolling_of_nothing(spark):
    _, transfers = events(spark, 1, 3)
    assert W.rolling_activity(transfers.where("false")).count() == 0


def folded(balances, alpha):
    """The definition, event by event."""
    state = {}
    for r in sorted(balances, key=lambda r: (r.address, r.timestamp, r.hash, r.direction)):
        if r.address not in state:
            state[r.address] = (1, r.balance, 0.0, 0.0, r.balance)
            continue
        n, ema, dev, change, last = state[r.address]
        ema = alpha * r.balance + (1 - alpha) * ema
        state[r.address] = (n + 1, ema, alpha * abs(r.balance - ema) + (1 - alpha) * dev, change + (abs(r.balance - last) - change) / n, r.balance)
    return state


@pytest.mark.parametrize("alpha, block_seconds, chunk", [(0.1, 900, 7), (0.1, 86_400, 1_024), (0.6, 60, 1), (1.0, 3_600, 5)])
def test_profile_is_the_fold(spark, alpha, block_seconds, chunk):
    rows, transfers = events(spark, 400, 4)
    balances = W.balance_events(transfers, block_seconds).collect()
    running, total = {}, {}
    both = sorted([(a, at, h, "out", -v) for h, at, a, b, v in rows] + [(b, at, h, "in", v) for h, at, a, b, v in rows])
    for a, at, h, way, v in both:
        total[a] = total.get(a, 0) + v
        running[a, h, way] = float(total[a]) / 1e12
    assert {(r.address, r.hash, r.direction): r.balance for r in balances} == pytest.approx(running, rel=1e-12)
    want = folded(balances, alpha)
    got = W.balance_profile(W.balance_events(transfers, block_seconds), alpha, 100, block_seconds, chunk).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n, r.ema, r.deviation, r.mean_change, r.last_balance) == pytest.approx(want[r.address], rel=1e-9, abs=1e-9) and r.kept == min(r.n, 100)


def test_profile_plan(spark):
    _, transfers = events(spark, 20, 5)
    plan = W.balance_profile(W.balance_events(transfers))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    events_plan = W.balance_events(transfers)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"windowspecdefinition\(address#\d+, _block#\d+L?, _us", events_plan), "rows are ordered within blocks"
    assert not re.findall(r"windowspecdefinition\(address#\d+, _us", events_plan)
    assert W.balance_profile(W.balance_events(transfers.where("false"))).count() == 0
