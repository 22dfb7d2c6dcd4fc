"""JSON arrays over several ranges against the json module."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.sources import json_array as J


def cut(data, split, tmp_path):
    """Elements of a file's ranges, states chained as the driver does."""
    file = tmp_path / "x.json"
    file.write_bytes(data)
    out, depth, escaped, inside = [], 0, False, False
    for a in range(0, len(data), split):
        end = min(len(data), a + split)
        out += [json.loads(t) for _, t in J._elements({"file": str(file), "size": len(data), "start": a, "end": end, "depth": depth, "escaped": escaped, "inside": inside}) if t.strip()]
        step, _, escaped, inside = J.marks(data[a:end], escaped, inside)
        depth += int(step.sum())
    return out


VALUE = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(alphabet='a"\\[]{},é \n/', max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='k"\\]', max_size=3), v, max_size=3), max_leaves=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUE, max_size=7), st.integers(1, 40), st.sampled_from([None, 1]), st.booleans())
def test_any_range_size(tmp_path_factory, values, split, indent, plain):
    data = json.dumps(values, indent=indent, ensure_ascii=plain).encode()
    assert cut(data, split, tmp_path_factory.mktemp("a")) == values


def test_elements_longer_than_what_is_read_at_once(tmp_path, monkeypatch):
    monkeypatch.setattr(J, "MORE", 7)
    values = ["x" * 100, {"a": ['"' * 50, "\\" * 33]}, 5, [], "é" * 60]
    for split in (1, 9, 50, 1000):
        assert cut(json.dumps(values, ensure_ascii=False).encode(), split, tmp_path) == values


def test_spark(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"id": i, "name": rng.choice(['a"b', "c,]", "\\", "é{"]) * rng.randint(0, 9), "tags": list(range(rng.randrange(4)))} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:1500]))
    (tmp_path / "b.json").write_text(json.dumps(rows[1500:], indent=2) + "\n")
    (tmp_path / "c.json").write_text(" [ ] ")
    (tmp_path / "d.json").write_text('[1, "x", {"id": "no number"}, {"id": 7777}]')
    (tmp_path / "e.json").write_text("")
    kind = "id long, name string, tags array<int>"
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = J.read_array(spark, path, kind, split=997)
        assert sorted((r.id, r.name, r.tags) for r in got.where("name IS NOT NULL").collect()) == [(r["id"], r["name"], r["tags"]) for r in rows]
        assert [r.id for r in got.where("name IS NULL").collect()] == [7777]
    one = J.array_elements(spark, f"{tmp_path}/d.json")
    assert [r.value for r in one.orderBy("position").collect()] == ["1", '"x"', '{"id": "no number"}', '{"id": 7777}']
    assert J.array_elements(spark, f"{tmp_path}/e.json").collect() == []
    with pytest.raises(Exception):  # noqa: B017
        J.array_elements(spark, f"{tmp_path}/none.json").collect()
