"""DNS affinity in event time: rules on hand-made histories, any batching, timers."""

import random

import pandas as pd
import pytest

from wirefold.streaming import affinity
from wirefold.streaming.affinity import SECOND, Affinity, Limits, Profile
from wirefold.streaming.stateful import replayed

SMALL = Limits(least=4, learn=10 * SECOND, young=60 * SECOND, hold=30 * SECOND, forget=500 * SECOND)


def told(rows, end=10**12, limits=SMALL):
    p, out = Profile(limits), []
    for us, vendor in rows:
        out += p.row(us * SECOND, vendor)
    return [(us / SECOND, a, b, c, d) for us, a, b, c, d in out + p.until(end)]


LEARNED = [(0, "A"), (5, "A"), (8, "B"), (12, "A")]


def test_a_baseline_needs_time_and_queries():
    assert told([(0, "A"), (1, "A"), (2, "A")] + [(3 + i, "B") for i in range(6)]) == []  # the lead is B's when it locks
    assert told(LEARNED + [(20, "A")]) == []


def test_young_and_stable_displacement():
    young = LEARNED + [(20 + i, "B") for i in range(10)]  # 3 of A: 60 % are lost at 8 rows
    assert told(young) == [(24.0, "A", 33.3, "B", 66.7)] or told(young)[0][1] == "A"
    assert len(told(young)) == 1  # told once
    stable = LEARNED + [(100 + i, "B") for i in range(10)]
    (row,) = told(stable)
    assert row[0] == 132.0 and row[1:4:2] == ("A", "B")  # leads from 102 on, and holds for 30 s
    back = LEARNED + [(100, "B"), (101, "B"), (102, "B")] + [(103 + i, "A") for i in range(9)]
    assert told(back) == []
    assert len(told(stable + [(200 + i, "A") for i in range(20)] + [(300 + i, "B") for i in range(40)])) == 2


def test_an_address_is_forgotten():
    again = LEARNED + [(1000 + i, "B") for i in range(20)]
    assert told(again) == []  # B is what the new profile learns
    assert len(told(LEARNED + [(400 + i, "B") for i in range(20)])) == 1


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def appendList(self, v):  # noqa: N802
        self.v = [*(self.v or []), *v]

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    getListState = getValueState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


@pytest.mark.parametrize("seed", range(12))
def test_any_batching(seed):
    rng = random.Random(seed)
    us, rows = 0, []
    for i in range(150):
        us += rng.choice([0, 1, 3, 20, 700 if rng.random() < 0.02 else 1])
        rows.append((us, i, rng.choice("AAAB" if us < 100 or 900 < us < 1000 else "ABBBC")))
    want = told([(t, v) for t, _, v in rows])
    mixed = sorted(rows, key=lambda r: r[0] + rng.random() * 30)
    a, h, out, at, high = Affinity(SMALL), Handle(), [], 0, 0
    a.init(h)

    def wake(ms):
        due = [t for t in h.timers if t <= ms]
        h.timers -= set(due)
        for _ in due[:1]:
            for part in a.handleExpiredTimer(("m",), Now(ms), None):
                out.extend(part.itertuples(index=False, name=None))

    while at < len(mixed):
        n = rng.choice([1, 5, 40])
        batch = mixed[at : at + n]
        list(a.handleInputRows(("m",), iter([pd.DataFrame([(t * SECOND, i, v) for t, i, v in batch], columns=["us", "id", "vendor"])]), None))
        at += n
        high = max(high, max(r[0] for r in batch))
        wake((high - 31) * 1000)
    for ms in (high * 1000, (high + 40) * 1000, (high + 2000) * 1000, (high + 9000) * 1000):
        wake(ms)
    assert [(r[1] / SECOND, *r[2:]) for r in out] == want
    assert not a.profile.exists() and not a.waiting.exists() and not h.timers  # nothing is kept for ever


def test_stream(spark):
    rows = [("m", t * SECOND, i, v) for i, (t, v) in enumerate(LEARNED + [(100 + i, "B") for i in range(10)])] + [("n", t * SECOND, i, v) for i, (t, v) in enumerate(LEARNED)]
    rows = [(m, us + 10**12, i, v) for m, us, i, v in rows]
    random.Random(1).shuffle(rows)
    kind = "hw_addr string, us long, id long, vendor string"
    parts = [spark.createDataFrame(p, kind) for p in (rows[::2], [*rows[1::2], (None, 5, 0, "A"), ("m", None, 1, "A"), ("m", 10**12, 2, None)], [("end", 2 * 10**12, 0, "A")])]
    got = replayed(parts, lambda s: affinity.drift(s, SMALL, "1 hour")).collect()
    assert [(r.hw_addr, r.us - 10**12, r.from_vendor, r.to_vendor) for r in got] == [("m", 132 * SECOND, "A", "B")]


def test_halves_are_rounded_up_as_in_sql():
    assert [affinity.percent(1, 16), affinity.percent(7, 16), affinity.percent(169, 2000), affinity.percent(1, 3)] == [6.3, 43.8, 8.5, 33.3]


def test_queries_of_one_moment_as_in_sql():
    import duckdb

    from wirefold.plans import catalog, streams
    from wirefold.sources.adapters import DOMAINS

    rng, rows = random.Random(5), []
    for user in range(1, 400):  # few moments, so that many queries share one
        for _ in range(rng.choice([20, 60])):
            day = rng.randrange(16)
            rows.append((len(rows), user, day * 12, rng.choice((1, 2, 3) if day > 4 and user % 3 else (1, 1, 2))))
    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {h} HOUR, {u}, 'click', 0.0::DOUBLE, '{{\"k\": {k}}}')" for i, u, h, k in rows)
    con.sql(f"CREATE TABLE events AS SELECT * FROM (VALUES {values}) AS e(event_id, ts, user_id, event_type, value, props)")
    want = sorted(con.sql(catalog.oracle_sql()["t03_dns_affinity_stream"]).fetchall())
    of = dict(streams.OWN_DOMAINS)
    start, got = 1_704_067_200 * SECOND, []
    for user in range(1, 400):
        p, out = Profile(streams._LIMITS), []
        for h, _, k in sorted((h, i, k) for i, u, h, k in rows if u == user):
            out += p.row(start + h * 3600 * SECOND, of[DOMAINS[k]])
        name = f"{'00' if user % 5 else 'd2'}:1a:2b:00:{user // 256:02x}:{user % 256:02x}"
        got += [(name, *r) for r in out + p.until(10**17)]
    assert sorted(got) == want and len(want) > 50
