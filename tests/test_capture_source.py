"""Capture files in byte ranges: the same rows for any split, broken records counted."""

import io
import random
import struct

import pyarrow as pa
import pytest

from wirefold.sources import capture_source as S
from wirefold.sources.capture import write_pcap


def frames(seed, n, most=200):
    rng = random.Random(seed)
    return [(1_700_000_000_000_000 + i * 1_000 + rng.randrange(999), bytes(rng.randrange(256) for _ in range(rng.randint(1, most)))) for i in range(n)]


def pcapng(rows, order="<", unit=9):
    block = lambda kind, body: struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    pad = lambda x: x + b"\0" * (-len(x) % 4)
    out = block(S.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(S.INTERFACE, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHB3x", 9, 1, unit) + struct.pack(order + "HH", 0, 0))
    for us, frame in rows:
        ticks = us * 10**unit // 10**6
        out += block(S.ENHANCED, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + pad(frame))
    return out + block(5, b"\0" * 12)


def big_endian(rows):
    return struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(">IIII", us // 10**6, us % 10**6 * 1000, len(f), len(f)) + f for us, f in rows)


def read(data, split):
    """All rows of a file in ranges of ``split`` bytes, each by a reader of its own."""
    out = []
    for a in range(0, len(data), split):
        form = S.opened(pa.BufferReader(data), len(data))
        for position, size, broken in S.records(form, a, min(len(data), a + split)):
            got = None if broken else form.row(position, size)
            if broken or got:
                out.append((position, broken, *(got or (None, None, None))))
    return out


@pytest.fixture
def small(monkeypatch):
    """Short longest records, so that small files have ranges far from their start."""
    monkeypatch.setattr(S, "LONGEST", 300)
    monkeypatch.setattr(S, "LONGEST_BLOCK", 400)
    monkeypatch.setattr(S.Classic, "longest", 300)
    monkeypatch.setattr(S.Blocks, "longest", 400)


@pytest.mark.parametrize("make", [write_pcap, big_endian, pcapng, lambda r: pcapng(r, ">", 6)])
def test_any_split_gives_the_same_rows(small, make):
    rows = frames(1, 200)
    data = make(rows)
    whole = [(p, b, us, 0, f) for (p, b, us, i, f) in read(data, len(data))]
    assert [(us, f) for _, b, us, _, f in whole] == rows and not any(b for _, b, *_ in whole)
    for split in (37, 500, 1001, 4096, 20_000):
        assert read(data, split) == read(data, len(data))


def test_captures_inside_frames(small):
    """Frames that carry captures themselves, up to their very end."""
    rng = random.Random(3)
    rows = []
    for us, frame in frames(2, 150, 40):
        inner = write_pcap([(us + 7, frame), (us + 9, frame)])[rng.choice([0, 24]) :]
        rows.append((us, (frame if rng.random() < 0.5 else b"") + inner[: 290 - len(frame)]))
    data = write_pcap(rows)
    assert [(us, f) for _, _, us, _, f in read(data, len(data))] == rows
    for split in (61, 700, 3000):
        assert read(data, split) == read(data, len(data))


@pytest.mark.parametrize("make", [write_pcap, pcapng])
def test_broken_records_are_told_and_passed(small, make):
    rng = random.Random(4)
    rows = frames(5, 300)
    data = bytearray(make(rows))
    form = S.opened(pa.BufferReader(bytes(data)), len(data))
    spots = [p for p, n, _ in S.records(form, 0, len(data)) if n > 60]
    for p in (spots[40], spots[41], spots[150]):
        data[p + 4 : p + 12] = bytes(rng.randrange(200, 256) for _ in range(8))
    data = bytes(data[: len(data) - 17])  # and the last record is cut off
    whole = read(data, len(data))
    broken = [p for p, b, *_ in whole if b]
    assert spots[40] in broken and spots[150] in broken and whole[-1][1].startswith("cut off")
    kept = {f for _, b, _, _, f in whole if not b}
    assert len(kept - {f for _, f in rows}) == 0 and len(kept) >= 290
    for split in (97, 2000, 5000):
        assert read(data, split) == whole


def test_source(spark, tmp_path):
    S.register(spark)
    some = {f"{name}": frames(i, 400) for i, name in enumerate(["a.pcap", "b.cap"])}
    for name, rows in some.items():
        (tmp_path / name).write_bytes(write_pcap(rows))
    (tmp_path / "c.pcapng").write_bytes(pcapng(frames(9, 50)))
    (tmp_path / "d.pcap").write_bytes(b"no capture")
    (tmp_path / "e.pcap").write_bytes(b"")
    (tmp_path / "f.txt").write_bytes(write_pcap(frames(1, 5)))
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = spark.read.format("capture").option("splitBytes", 10_000).load(path).collect()
        assert sorted((r.us, r.frame) for r in got if r.broken is None) == sorted([*some["a.pcap"], *some["b.cap"], *frames(9, 50)])
        assert [r.file.endswith("d.pcap") for r in got if r.broken] == [True]
    one = spark.read.format("capture").load(f"{tmp_path}/*.cap")
    assert one.count() == 400 and one.columns == ["file", "position", "us", "interface", "frame", "broken"]
    assert spark.read.format("capture").load(f"{tmp_path}/e.pcap").collect() == []
    with pytest.raises(Exception, match="larger than"):
        spark.read.format("capture").option("maxFileBytes", 10).load(str(tmp_path)).collect()


def test_header_only():
    data = write_pcap([])
    form = S.opened(io.BytesIO(data) if False else pa.BufferReader(data), len(data))
    assert list(S.records(form, 0, len(data))) == []
