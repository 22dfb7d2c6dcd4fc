"""Connection tables and heartbeats: late, lost and repeated packets, any batching."""

import random
from collections import OrderedDict

import pandas as pd
import pytest

from tests.test_affinity import Handle, Now
from wirefold.streaming import connections as C
from wirefold.streaming.stateful import replayed

S = C.SECOND


def table(events, idle, most, end):
    """The table by its rules, events in time order."""
    open_, out = OrderedDict(), []

    def sweep(us):
        for key, e in sorted(open_.items(), key=lambda x: (x[1][1], x[0])):
            if us > e[1] + idle:
                out.append((*key, *open_.pop(key), "expired", e[1] + idle))

    for us, event, *key, n in sorted(events):
        sweep(us)
        key = tuple(key)
        if event == 0 and key not in open_:
            if len(open_) >= most:
                old, e = open_.popitem(last=False)
                out.append((*old, *e, "evicted", us))
            open_[key] = [us, us, "syn_seen", 0]
        elif event and key in open_:
            e = open_[key]
            e[1] = us
            if event == 1:
                e[3] += n
            if event == 2:
                e[2] = "banner_captured"
            if event == 3:
                e[2] = "closed"
                out.append((*key, *open_.pop(key), "closed", us))
    sweep(end)
    return [tuple(x) for x in out]


def run(processor, rows, rng, delay):
    """Rows in random batches; the watermark follows ``delay`` seconds behind."""
    h, out, at, high = Handle(), [], 0, 0
    processor.init(h)
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * (delay - 1) * S)

    def wake(us):
        while due := [t for t in h.timers if t * 1000 <= us]:
            h.timers -= set(due)
            for part in processor.handleExpiredTimer(("x",), Now(us // 1000), None):
                out.extend(part.itertuples(index=False, name=None))

    while at < len(mixed):
        batch = mixed[at : (at := at + rng.choice([1, 7, 30]))]
        list(processor.handleInputRows(("x",), iter([pd.DataFrame(batch, columns=processor.columns)]), None))
        high = max(high, max(r[0] for r in batch))
        wake(high - delay * S)
    for us in (high, high + 50 * S, high + 10_000 * S):
        wake(us)
    assert not processor.waiting.exists() and not processor.kept.exists() and not h.timers
    return [r[1:] for r in out]


@pytest.mark.parametrize("seed, most", [(1, 1000), (2, 3), (3, 1), (4, 8)])
def test_table_in_any_batching(seed, most):
    rng, us, events = random.Random(seed), 0, []
    for _ in range(300):
        us += rng.choice([0, 1, 2, 9, 60]) * S
        events.append((us, rng.choice([0, 0, 0, 1, 1, 2, 3]), f"10.0.0.{rng.randrange(4)}", rng.randrange(2), rng.choice([22, 80]), rng.randrange(100)))
    events += events[5:9]  # packets sent twice
    want = table(events, 30 * S, most, 10**12)
    assert run(C.Connections(30 * S, most), events, rng, 20) == want
    assert {w[-2] for w in want} >= ({"expired", "evicted"} if most < 5 else {"expired", "closed"})


@pytest.mark.parametrize("seed", [1, 2])
def test_heartbeats(seed):
    rng, us, beats = random.Random(seed), 0, []
    for _ in range(100):
        us += rng.choice([0, 30, 60, 90, 91, 400]) * S
        beats.append((us,))
    want = []
    for i, (at,) in enumerate(beats):
        if not i or at > beats[i - 1][0] + 90 * S:
            want.append((at, "sensor_connect"))
        if i == len(beats) - 1 or beats[i + 1][0] > at + 90 * S:
            want.append((at + 90 * S, "sensor_disconnect"))
    assert run(C.Heartbeats(90 * S), beats, rng, 100) == want


def test_streams(spark):
    base = 10**12
    kind = "server string, us long, event int, client string, client_port int, server_port int, bytes long"
    rows = [("s", base + 9 * S, 2, "c", 1, 22, None), ("s", base, 0, "c", 1, 22, 0), ("s", base + 5 * S, 1, "c", 1, 22, 7), ("s", base + 2 * S, 1, "lost", 1, 22, 7), ("s", base + 10 * S, 3, "c", 1, 22, 0)]
    rows += [("t", base, 0, "d", 1, 80, None), (None, base, 0, "d", 1, 80, None), ("t", None, 0, "d", 1, 80, None)]
    frames = [spark.createDataFrame(p, kind) for p in (rows[::2], rows[1::2], [("end", 3 * base, 1, "", 0, 0, 0)])]
    got = sorted(map(tuple, replayed(frames, lambda s: C.connections(s, lateness="1 hour")).collect()))
    assert got == [("s", "c", 1, 22, base, base + 10 * S, "closed", 7, "closed", base + 10 * S), ("t", "d", 1, 80, base, base, "syn_seen", 0, "expired", base + 30 * S)]
    beats = [spark.createDataFrame(p, "sensor string, us long") for p in ([("a", base)], [("a", base + 200 * S), (None, base)], [("end", 3 * base)])]
    got = sorted(map(tuple, replayed(beats, C.sensor_events).where("sensor = 'a'").collect()))
    assert got == [("a", base, "sensor_connect"), ("a", base + 90 * S, "sensor_disconnect"), ("a", base + 200 * S, "sensor_connect"), ("a", base + 290 * S, "sensor_disconnect")]
