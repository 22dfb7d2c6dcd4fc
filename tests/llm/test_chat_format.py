from itertools import product

import numpy as np

from wirefold.llm.chat_format import ROLES, fit, format_transcripts, parse, read_chat, render, train, transcripts, viterbi

TURNS = "conv_id long, turn long, role string, text string"


def example(n=60):
    rows = []
    for c in range(n):
        talk = ([("system", "Be kind.")] if c % 4 == 0 else []) + [("user", f"what is {c}?"), ("assistant", "A long answer. " * (8 + c % 5) + "\nmore of it " * 6)] * (1 + c % 3)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(talk)]
    return rows


def model():
    by = {}
    for c, _, r, t in example():
        by.setdefault(c, []).append((ROLES.index(r), t.splitlines()))
    return fit(list(by.values()))


def test_viterbi_against_all_paths():
    m, rng = model(), np.random.default_rng(1)
    for _ in range(20):
        kinds, sizes, ends = rng.integers(0, 4, 4), rng.integers(0, 11, 4), rng.integers(0, 4, 4)
        emit = m.marker[:, kinds] * bool(kinds.any()) + m.length[:, sizes] + m.ending[:, ends]
        score = lambda p: m.start[p[0]] + sum(emit[s, t] for t, s in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(score(viterbi(m, kinds, sizes, ends)) - max(map(score, product(range(6), repeat=4)))) < 1e-9


def test_markers_and_rendering():
    m = model()
    assert parse(m, None) == [] and parse(m, " \n\n") == []
    got = parse(m, "User: what is it?\n\n### Assistant:\nA long answer.\nmore of it\n[user] and why?\nAI: because")
    assert [r for r, _ in got] == ["user", "assistant", "user", "assistant"]
    assert got[1][1] == "A long answer.\nmore of it"
    assert render(got[:1]) == "<|user|>\nwhat is it?\n<|end|>\n"


def test_roles_of_a_table(spark):
    rows = example() + [(1000, None, None, None), (1001, 0, "user", ""), (1002, 0, "user", "hi"), (1002, 0, "user", "hi")] + [(2000, i, ROLES[1 + i % 2], "user text?" if i % 2 == 0 else "answer " * 30) for i in range(600)]
    frame = spark.createDataFrame(rows, TURNS)
    out = format_transcripts(transcripts(frame), train(frame)).collect()
    assert {r.conv_id for r in out} == {r[0] for r in rows}
    assert sorted(r.part for r in out if r.conv_id == 2000) == [0, 1, 2]
    marked = [r for r in out if r.conv_id < 1000]
    assert np.mean([r.roles == r.truth for r in marked]) > 0.9
    none = spark.createDataFrame([], TURNS)
    assert format_transcripts(transcripts(none), train(none)).collect() == []


def test_content_is_kept():
    m = model()
    text = "User: what is it?\nAssistant: Take this:\n\nA: int = 1\nQ: str\u2028x\n\n  end of it\n"
    got = parse(m, text)
    assert got[0] == ("user", "what is it?")
    # Nothing goes but blank lines between turns and the markers turns begin with.
    kept = "".join("".join(t.split()) for _, t in got)
    assert kept.endswith("str" + "x" + "endofit") and "int=1" in kept
    assert len("".join(text.split())) - len(kept) in (len("User:Assistant:"), len("User:Assistant:A:"), len("User:Assistant:Q:"), len("User:Assistant:A:Q:"))
    inside = parse(m, "Assistant: " + "A long answer. " * 8 + "\n" + "more of it\n" * 3 + "x = [user]\nUser\nnames: A, B")
    assert "x = [user]" in "\n".join(t for _, t in inside)


def test_rendering_can_be_read_back():
    odd = [("user", "<|end|>\n<|user|>\nhi"), ("assistant", "\\<|end|>"), ("system", ""), ("user", "a\n\nb\x0bc\u2028d\n")]
    assert read_chat(render(odd)) == odd
    assert render([("user", "x\n<|end|>\n<|user|>\ny")]) != render([("user", "x"), ("user", "y")])
