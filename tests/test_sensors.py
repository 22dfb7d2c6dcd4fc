"""Sensor frames from messages cut, mixed and repeated in any way."""

import random
import struct

import pandas as pd
import pytest

from wirefold.streaming import sensors
from wirefold.streaming.sensors import Sensor, replayed_frames


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

    def clear(self):
        self.v = None


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Value()

    getListState = getValueState  # noqa: N815


def frames(seed, n):
    rng = random.Random(seed)
    return [(1_700_000_000_000_000 + i * 1000, rng.randrange(3), bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 90])))) for i in range(n)]


def encoded(rows):
    return b"".join(struct.pack(">IqI", len(f), us * 1000, i) + f for us, i, f in rows)


def messages(rng, data, most=40):
    out, at = [], 0
    while at < len(data):
        size = rng.randint(0, most)
        out.append((len(out), data[at : at + size]))
        at += size
    return out


def run(batches, wait=64):
    s = Sensor(0, wait, None)
    s.init(Handle())
    out = []
    for batch in batches:
        if batch:
            for part in s.handleInputRows(("a",), iter([pd.DataFrame(batch, columns=["seq", "body"])]), None):
                out += [tuple(None if x is pd.NA else x for x in r) for r in part.itertuples(index=False, name=None)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_order_and_batching(seed):
    rng = random.Random(seed)
    rows = frames(seed, 80)
    sent = messages(rng, encoded(rows))
    mixed = sorted(sent, key=lambda m: m[0] + rng.random() * 20)  # early and late ones
    mixed += rng.sample(sent, 5)  # repeats
    batches, at = [], 0
    while at < len(mixed):
        n = rng.choice([1, 3, 50])
        batches.append(mixed[at : at + n])
        at += n
    got = run(batches)
    assert [(us, i, f) for _, _, us, i, f, _ in got] == rows and [g[1] for g in got] == list(range(80)) and not any(g[5] for g in got)


def test_a_missing_message_costs_its_frames_only():
    rng = random.Random(9)
    rows = frames(9, 200)
    sent = messages(rng, encoded(rows))
    gone = len(sent) // 2
    kept = [m for m in sent if m[0] != gone]
    for size in (1, 7, 1000):
        got = run([kept[a : a + size] for a in range(0, len(kept), size)], wait=8)
        assert [g[5] for g in got if g[5]] == [f"messages {gone} to {gone} are missing"]
        found = [(us, i, f) for _, _, us, i, f, b in got if b is None]
        assert set(found) <= set(rows) and len(found) >= 190


def test_rubbish_is_passed():
    rows = frames(4, 60)
    data = encoded(rows[:30]) + b"\xff" * 50 + encoded(rows[30:])
    got = run([[(0, data)]])
    assert [g[5] for g in got if g[5]] == ["not a frame header"]
    assert [(us, i, f) for _, _, us, i, f, b in got if b is None] == rows


def test_stream(spark):
    rng = random.Random(1)
    rows, parts = {}, [[], [], []]
    for name in ("a", "b", "c"):
        rows[name] = frames(ord(name), 50)
        for seq, body in messages(rng, encoded(rows[name])):
            parts[rng.randrange(3)].append((name, seq, body))
    parts[1] += [(None, 0, b"x"), ("a", None, b"x"), *parts[0][:3]]
    got = replayed_frames([spark.createDataFrame(p, "sensor string, seq long, body binary") for p in parts], files=2, wait=10_000).collect()
    for name, want in rows.items():
        mine = sorted((r.n, r.us, r.interface, bytes(r.frame)) for r in got if r.sensor == name)
        assert [m[1:] for m in mine] == want and [m[0] for m in mine] == list(range(50))
    assert len(got) == 150 and not any(r.broken for r in got)
    assert sensors.HEADER == 16
