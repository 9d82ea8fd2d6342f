"""Streams that stop and go on over the same folder."""

import shutil
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from transfergraph.operators.aggregates import build_edges
from transfergraph.streaming import jobs

SCHEMA = "hash string, block_number long, timestamp timestamp, from_address string, to_address string, value decimal(38,0), success boolean"


def _land(spark, folder, name, numbers):
    start = datetime(2024, 1, 1)
    rows = [(f"h{k}", k, start + timedelta(minutes=k), f"a{k % 7}", f"a{k * k % 5}", Decimal(100 + k), True) for k in numbers]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _moved(spark, folder, land):
    """The files of the folders in `folder`, moved into the landing folder as single files."""
    land.mkdir(exist_ok=True)
    for k, f in enumerate(sorted(folder.glob("*/*.parquet"))):
        shutil.move(f, land / f"{f.parent.name}-{k}.parquet")


def _all(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def _stream(spark, land):
    return jobs.read_stream(spark, str(land), "*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)


@pytest.mark.parametrize("fold_every", [1, 3])
def test_edges_go_on_where_they_stopped(spark, tmp_path, fold_every):
    made, land, folder = tmp_path / "made", tmp_path / "land", str(tmp_path / "state")
    for part in range(3):
        _land(spark, made, f"p{part}", range(part * 40, part * 40 + 40))
    _moved(spark, made, land)
    jobs.edges_snapshot(_stream(spark, land), folder, fold_every)
    for part in range(3, 8):
        _land(spark, made, f"p{part}", range(part * 40, part * 40 + 40))
    _moved(spark, made, land)
    got = jobs.edges_snapshot(_stream(spark, land), folder, fold_every)
    assert _all(got) == _all(build_edges(spark.read.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(land))))
    again = jobs.edges_snapshot(_stream(spark, land), folder, fold_every)  # nothing is new
    assert _all(again) == _all(got)


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    made, land, folder = tmp_path / "made", tmp_path / "land", tmp_path / "state"
    for part in range(4):
        _land(spark, made, f"p{part}", range(part * 30, part * 30 + 30))
    _moved(spark, made, land)
    want = _all(jobs.edges_snapshot(_stream(spark, land), str(folder), 2))
    last = max(int(f.name) for f in (folder / "checkpoint" / "commits").iterdir() if f.name.isdigit())
    for f in (folder / "checkpoint" / "commits").iterdir():
        if f.name in (str(last), f".{last}.crc"):
            f.unlink()  # as if the driver had stopped after the batch's writes
    assert _all(jobs.edges_snapshot(_stream(spark, land), str(folder), 2)) == want


def test_rows_of_all_runs(spark, tmp_path):
    made, land, folder = tmp_path / "made", tmp_path / "land", str(tmp_path / "state")
    _land(spark, made, "p0", range(20))
    _moved(spark, made, land)
    assert jobs.run_to_table(jobs.dedup(_stream(spark, land)), folder=folder).count() == 20
    _land(spark, made, "p1", range(10, 40))
    _moved(spark, made, land)
    out = jobs.run_to_table(jobs.dedup(_stream(spark, land)), folder=folder)
    assert out.count() == 40 and out.select(F.countDistinct("hash")).first()[0] == 40


def test_no_files(spark, tmp_path):
    (tmp_path / "land").mkdir()
    assert jobs.edges_snapshot(_stream(spark, tmp_path / "land"), str(tmp_path / "state")).count() == 0


def _bursty(spark, folder, name, numbers):
    """Two bursts of transfers a week apart for each of seven accounts, in no order."""
    start = datetime(2024, 1, 1)
    rows = [(f"h{k}", k, start + timedelta(days=7 * (k % 5), seconds=37 * k, hours=k % 3), f"a{k % 7}", f"b{k * k % 5}", Decimal((100 + k) * 10**12), True) for k in numbers]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_awakenings_equal_the_batch_after_a_restart(spark, tmp_path):
    from transfergraph.operators.anomalies import awakening
    from transfergraph.streaming.awakening import awakenings

    made, land, folder = tmp_path / "made", tmp_path / "land", str(tmp_path / "state")
    for part in range(2):
        _bursty(spark, made, f"p{part}", [k for k in range(70) if k % 5 == part])
    _moved(spark, made, land)
    late = "1 day"
    jobs.run_to_table(awakenings(_stream(spark, land), 3.0, late=late), folder=folder)
    for part in range(2, 5):
        _bursty(spark, made, f"p{part}", [k for k in range(70) if k % 5 == part])
    _bursty(spark, made, "q", [10_000 * 5 + 4])  # a transfer three weeks on, so that the watermark passes all sessions before
    _moved(spark, made, land)
    got = jobs.run_to_table(awakenings(_stream(spark, land), 3.0, late=late), folder=folder)
    every = spark.read.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(land))
    want = awakening(every, 3.0)
    figures = lambda df: {(r.address, r.session): (r.n, r.destinations, r.kind, *(x if x is None else round(x, 6) for x in (r.sent, r.received, r.dormant_days, r.volume_factor, r.mean_gap, r.confidence))) for r in df.collect()}
    batch, stream = figures(want), figures(got)
    last = {a: max(s for b, s in batch if b == a) for a, _ in batch}
    assert len(stream) == got.count() and set(stream) <= set(batch)
    assert all(v == batch[k] for k, v in stream.items())
    assert {k for k in batch if k[1] < last[k[0]]} <= set(stream), "every session but an address's last is closed by a later row at the latest"


def test_late_rows_are_counted(spark, tmp_path):
    from transfergraph.streaming.late import counting_late_rows, late_rows

    made, land, folder, counts = tmp_path / "made", tmp_path / "land", str(tmp_path / "state"), str(tmp_path / "late")
    _land(spark, made, "p0", range(0, 600))
    _moved(spark, made, land)
    with counting_late_rows(spark, counts):
        jobs.run_to_table(jobs.dedup(_stream(spark, land)), folder=folder)
        _land(spark, made, "p1", [1000, 1001, 1002])  # seven hours on
        _moved(spark, made, land)
        jobs.run_to_table(jobs.dedup(_stream(spark, land)), folder=folder)
        _land(spark, made, "p2", [*range(2000, 2003), *range(30, 37)])  # seven of them over an hour before the watermark
        _moved(spark, made, land)
        out = jobs.run_to_table(jobs.dedup(_stream(spark, land)), folder=folder)
    assert out.count() == 606
    assert [r.dropped for r in late_rows(spark, counts).collect()] == [7]


def test_no_late_rows(spark, tmp_path):
    from transfergraph.streaming.late import counting_late_rows

    with counting_late_rows(spark, str(tmp_path / "late")):
        pass
    assert not (tmp_path / "late").exists()


def test_strength_follows_the_stream(spark, tmp_path):
    """After each run the scores are those of all rows so far for the edges that the last batch touched, and those of their own last batch for the others."""
    from transfergraph.operators import metrics, scoring
    from transfergraph.streaming.rescoring import rescore_strength

    made, land, folder = tmp_path / "made", tmp_path / "land", str(tmp_path / "state")
    names = [f"a{k}" for k in range(7)]
    accounts = spark.createDataFrame([(a, Decimal(500 * k), datetime(2023, 12, 20 + k)) for k, a in enumerate(names)], "address string, balance decimal(38,0), created_at timestamp")
    ranks = spark.createDataFrame([(a, 0.1 + k / 100) for k, a in enumerate(names)], "address string, pagerank double")
    as_of = spark.createDataFrame([(datetime(2024, 1, 3),)], "as_of timestamp")
    want = {}
    for part, numbers in enumerate([range(40), [3, 40, 41, 42, 59], [3, 5, 100]]):
        _land(spark, made, f"p{part}", numbers)
        _moved(spark, made, land)
        got = rescore_strength(_stream(spark, land), accounts, ranks, as_of, folder, fold_every=2)
        t = spark.read.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(land))
        e = build_edges(t)
        full = scoring.strength_score(scoring.volume_score(e, accounts), scoring.frequency_score(e, t), scoring.temporal_score(t, as_of), scoring.network_score(e, metrics.degree_centrality(e), ranks), scoring.risk_score(t, accounts))
        now = {(r.from_address, r.to_address): (r.strength, round(r.adjusted, 6)) for r in full.collect()}
        want |= {(f"a{k % 7}", f"a{k * k % 5}"): now[f"a{k % 7}", f"a{k * k % 5}"] for k in numbers}
        assert {(r.from_address, r.to_address): (r.strength, round(r.adjusted, 6)) for r in got.collect()} == want
