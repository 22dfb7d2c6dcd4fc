"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is a text of lines.  Each line gives discrete features: the kind
of speaker marker it starts with, its length, whether it ends in a question
mark, and whether a blank line precedes.  States are (role, begin) and (role,
inside); Viterbi finds the likeliest state sequence under the rule that a
turn's lines follow its beginning.  Turns are then rendered canonically.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, mapped
from .textvec import complete_groups

ROLES = ["system", "user", "assistant"]
#: Turns of one conversation that are parsed together; longer conversations
#: are parsed in blocks of so many turns.
BLOCK_TURNS = 256
#: Labelled turns the model is fitted on (bound of the sample).
TRAIN_TURNS = 50_000

# Speaker markers by role.
MARKERS = {
    "system": ["system", "sys", "instruction", "instructions", "context"],
    "user": ["user", "human", "question", "q", "customer", "me", "prompter", "usuario", "benutzer", "utilisateur"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model", "response", "asistente", "assistent"],
}
_KIND = {m: i + 1 for i, r in enumerate(ROLES) for m in MARKERS[r]}
_MARKER = re.compile(r"^\s*(?:[#>*\-]+\s*|<\|?|\[)?\s*(?:im_start\|>)?\s*([^\W\d_]+)\s*(?:\*\*)?\s*(?:\|?>|\]|[:：]|$)\s*(?:\*\*)?\s*", re.IGNORECASE)
_LENGTHS = np.array([1, 20, 40, 80, 120, 180, 260, 400, 700, 1200])


def features(line: str, blank_before: bool) -> tuple[int, int, int, str]:
    """(marker kind, length class, ending class) and the line without its marker.

    Marker kind 0: none; 1 to 3: a role's marker.
    """
    kind, rest = 0, line
    m = _MARKER.match(line)
    if m and (kind := _KIND.get(m[1].lower(), 0)):
        rest = line[m.end() :]
    ending = (2 if rest.rstrip().endswith("?") else 0) + blank_before
    return kind, int(np.searchsorted(_LENGTHS, len(rest), side="right")), ending, rest


@dataclass
class Model:
    """Log probabilities; state 2 * role is a turn's first line, 2 * role + 1 a later one."""

    start: np.ndarray
    move: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    ending: np.ndarray


def fit(sequences: list[list[tuple[int, list[str]]]], marker_noise: float = 0.02) -> Model:
    """Count transitions and emissions over conversations of (role, lines).

    A turn table has no markers before its turns, so the marker emissions of
    first lines are a prior (their role's marker or none).  How often later
    lines look like markers, or follow a blank line, is counted.
    """
    s = 2 * len(ROLES)
    start, move = np.full(s, 0.05), np.full((s, s), 0.05)
    length, ending = np.full((s, len(_LENGTHS) + 1), 0.5), np.full((s, 4), 0.5)
    marker = np.tile(100 * np.array([1 - marker_noise] + [marker_noise / len(ROLES)] * len(ROLES)), (s, 1))
    for turns in sequences:
        last = None
        for role, lines in turns:
            for i, line in enumerate(lines):
                if not line.strip():
                    continue
                state = 2 * role + (i > 0)
                kind, size, end, _ = features(line, i > 0 and not lines[i - 1].strip())
                length[state, size] += 1
                if i:
                    ending[state, end] += 1
                    marker[state, kind] += 1
                else:  # what stands before a turn depends on the transcript's layout
                    ending[state, end] += 0.5
                    ending[state, end + 1] += 0.5
                if last is None:
                    start[state] += 1
                else:
                    move[last, state] += 1
                last = state
    for role in range(len(ROLES)):
        start[2 * role + 1] = 1e-9
        for state in range(s):
            if state // 2 != role:
                move[state, 2 * role + 1] = 1e-9  # a later line needs its own turn's beginning
    for role in range(len(ROLES)):
        marker[2 * role] = marker_noise / len(ROLES)
        marker[2 * role, 0], marker[2 * role, role + 1] = 0.5, 0.5 - marker_noise
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(log(start), log(move), log(marker), log(length), log(ending))


def viterbi(model: Model, kinds: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Likeliest state sequence (ties: the lower state)."""
    emit = model.length[:, sizes] + model.ending[:, ends]
    if kinds.any():  # in a transcript without any marker their absence tells nothing
        emit = emit + model.marker[:, kinds]
    n = emit.shape[1]
    if not n:
        return np.empty(0, np.int64)
    back = np.zeros((n, len(model.start)), np.int8)
    score = model.start + emit[:, 0]
    for t in range(1, n):
        step = score[:, None] + model.move
        back[t] = step.argmax(0)
        score = step.max(0) + emit[:, t]
    path = np.empty(n, np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def parse(model: Model, transcript: str | None) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript.

    Blank lines between turns only separate, those inside a turn stay.  A
    marker leaves the text only where a turn of its role begins; anywhere else
    the line is content as it stands.  Lines end at line feeds only.
    """
    rows: list[tuple] = []  # marker kind, length, ending, rest, line, lines above that are content if no turn begins
    above: list[str] = []
    alone = 0
    for line in (transcript or "").split("\n"):
        if not line.strip():
            above.append(line)
            continue
        kind, size, end, rest = features(line, bool(above) and not above[-1].strip())
        if kind and not rest.strip() and not alone:
            alone, above = kind, [*above, line]  # a marker on a line of its own belongs to the next line
            continue
        if alone and not kind:
            kind, rest = alone, line
        rows.append((kind, size, end, rest, line, above))
        above, alone = [], 0
    if alone:
        rows.append((alone, 0, 0, "", next(x for x in above[::-1] if x.strip()), []))
    if not rows:
        return []
    kinds, sizes, ends = (np.array([r[i] for r in rows]) for i in range(3))
    turns: list[tuple[str, list[str]]] = []
    for state, (kind, _, _, rest, line, above) in zip(viterbi(model, kinds, sizes, ends), rows):
        begins = state % 2 == 0 or not turns
        if begins:
            turns.append((ROLES[state // 2], []))
        if begins and kind == state // 2 + 1:
            turns[-1][1].extend([rest] if rest.strip() else [])
        elif begins:
            turns[-1][1].extend([*(x for x in above if x.strip()), line])
        else:
            turns[-1][1].extend([*above, line])
    return [(role, "\n".join(lines)) for role, lines in turns]


#: Lines that the canonical form would take for its own marks.
_MARK = re.compile(rf"\\*<\|({'|'.join(ROLES)}|end)\|>$")


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: ``<|role|>``, the text and ``<|end|>``, a line each.

    Lines of the text that look like such a mark get a backslash in front.
    """
    escaped = lambda text: "\n".join("\\" + x if _MARK.fullmatch(x) else x for x in text.split("\n"))
    return "".join(f"<|{role}|>\n{escaped(text)}\n<|end|>\n" for role, text in turns)


def read_chat(chat: str) -> list[tuple[str, str]]:
    """The turns of a canonical form: the inverse of ``render``."""
    turns: list[tuple[str, str]] = []
    role, lines = None, []
    for line in chat.split("\n"):
        m = _MARK.fullmatch(line)
        if m and not line.startswith("\\"):
            if m[1] == "end":
                turns.append((role, "\n".join(lines)))
            role, lines = m[1], []
        else:
            lines.append(line[1:] if m else line)
    return turns


def train(conversations: DataFrame, train_turns: int = TRAIN_TURNS) -> Model:
    """Fit on conversations of at most ``train_turns`` labelled turns, by a hash of conv_id."""
    known = conversations.where(F.col("role").isin(ROLES) & F.col("text").isNotNull() & F.col("conv_id").isNotNull())
    rows = known.select("conv_id", "turn", "role", "text").orderBy(F.xxhash64("conv_id"), "conv_id", "turn").limit(train_turns).collect()
    by: dict = {}
    for r in rows:
        lines = r.text.strip("\n").split("\n")
        if r.text.strip():
            by.setdefault(r.conv_id, []).append((ROLES.index(r.role), lines))
    return fit(list(by.values()))


def format_transcripts(transcripts: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds roles (array), n_turns and chat (canonical text) to every transcript row.

    A null or blank transcript has no turns and an empty chat.  Lines of any
    length and transcripts of any number of lines are parsed whole; repeated
    rows get the same; ties go to the earlier role in ROLES; input columns of
    the added names are replaced; an empty table stays empty.
    """
    names = [c for c in transcripts.columns if c not in ("roles", "n_turns", "chat")]
    schema = extended(transcripts.select(*names).schema, "roles array<string>, n_turns int, chat string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [parse(model, t) for t in batch.column(column).to_pylist()]
            new = [pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([len(t) for t in turns], pa.int32()), pa.array([render(t) for t in turns], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "roles", "n_turns", "chat"])

    return mapped(transcripts.select(*names), rows, schema)


#: How a raw transcript marks its speakers, by style; the last style marks none.
STYLES = [("System: ", "User: ", "Assistant: "), ("### Instruction:\n", "### Human:\n", "### Assistant:\n"), ("[SYS] ", "Q: ", "A: "), ("", "", "")]


def transcripts(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Raw transcripts of a turn table: conv_id, part, text, truth (roles).

    The style depends on conv_id; turns are ordered by turn, then role and
    text.  Conversations longer than ``block_turns`` turns give several parts,
    so no conversation is ever held whole; a null text is an empty turn, which
    leaves no line, and is absent from ``truth`` as a blank one is.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), "text")
    rows = rows.withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / block_turns).cast("long"))
    keys = ["key", "part"]
    rows = rows.withColumn("key", F.xxhash64("conv_id")).repartition("conv_id", "part").sortWithinPartitions("key", "part", "turn", "role", "text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in complete_groups(batches, keys):
            conv, part, role, text, style = (table[c].to_pylist() for c in ("conv_id", "part", "role", "text", "key"))
            cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                lines, truth = [], []
                for r, t in zip(role[a:b], text[a:b]):
                    if t and t.strip():
                        marks = dict(zip(ROLES, STYLES[style[a] % len(STYLES)]))
                        lines.append(marks.get(r, "") + t)
                        truth.append(r)
                out.append((conv[a], part[a], "\n".join(lines), truth))
            columns = list(zip(*out))
            types = [table.schema.field("conv_id").type, pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "text", "truth"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return mapped(rows, join, f"conv_id {kind}, part long, text string, truth array<string>")
