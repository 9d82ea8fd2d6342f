"""The awakening's state, driven without a stream: how many messages a call makes, and what is kept."""

import json
from types import SimpleNamespace

from pyspark.sql import Row

from transfergraph.streaming.awakening import DAY, ROW, US, Awakening


class _State:
    """A list or value that counts what it is asked; timers alike."""

    def __init__(self, calls):
        self.calls, self.kept = calls, None

    def get(self):
        self.calls.append("get")
        return iter(self.kept or []) if isinstance(self.kept, list) else self.kept

    def put(self, x):
        self.calls.append("put")
        self.kept = list(x)

    def appendList(self, x):
        self.calls.append("append")
        self.kept = [*(self.kept or []), *x]

    def clear(self):
        self.calls.append("clear")
        self.kept = []

    def update(self, x):
        self.calls.append("update")
        self.kept = x


def _made(gap=2):
    calls, timers = [], set()
    handle = SimpleNamespace(getListState=lambda *_: _State(calls), getValueState=lambda *_: _State(calls), registerTimer=lambda t: (calls.append("timer"), timers.add(t)), deleteTimer=lambda t: (calls.append("timer"), timers.remove(t)))
    a = Awakening(gap, 3)
    a.init(handle)

    def go(events, passed):
        calls.clear()
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed // 1000)
        due = [t for t in timers if t * 1000 <= passed]
        rows = [Row(us=us, hash=f"h{us}", direction="out", other=other, x=1.0) for us, other in events]
        out = list(a.handleInputRows(("me",), iter(rows), at)) if rows else []
        for t in due if not rows else []:
            out += a.handleExpiredTimer(("me",), at, None)
            timers.discard(t)
        return out

    return a, calls, timers, go


def test_a_call_makes_a_few_messages_whatever_its_events():
    a, calls, timers, go = _made()
    day = DAY * US
    events = [(k * 1_000_000, f"b{k % 700}") for k in range(1, 2001)] + [(10 * day + k * 1_000_000, f"c{k % 9}") for k in range(1500)]
    assert go(events, 0) == [] and len(calls) <= 4 and len(timers) == 1  # all wait
    assert go([], 5 * day) == [] and len(calls) <= 8, "2,000 events of the first session taken in a few messages"
    out = go([], 20 * day)
    assert len(calls) <= 10
    assert [(r.session, r.n, r.destinations, r.kind, r.volume_factor) for r in out] == [(2, 1500, 9, "distribution", 1.0)]
    assert not timers and not a.waiting.kept


def test_accounts_of_an_open_session_are_kept_about_once():
    a, calls, timers, go = _made()
    kept = lambda: sum(len(json.loads(r)) for (r,) in a.sent_to.kept or [])
    for k in range(60):
        go([(k * 100_000_000 + j, f"b{j}") for j in range(100)], (k + 1) * 100_000_000)
        assert kept() <= 2 * 100 + ROW and len(calls) <= 8
    assert len(timers) == 1
    go([(100 * DAY * US, "z")], 101 * DAY * US)  # the second session
    go([(200 * DAY * US, "y"), (200 * DAY * US + 1, "z")], 210 * DAY * US)
    assert a.open.kept[0] == 3 and kept() == 0
