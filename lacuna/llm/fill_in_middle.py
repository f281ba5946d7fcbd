"""Fill-in-the-middle examples: a text is cut at two unit boundaries and its parts are put in another order between sentinels.

One scan of a table-driven automaton over the UTF-8 bytes does all of the reading. Its state holds how many continuation
bytes are due, whether a unit begins, and the longest end of what was read that begins a sentinel; a transition can begin a
code point, begin a unit or complete a sentinel. The scan counts these transitions for each text, which gives the number of
units, of code points and of sentinels; a second pass over the recorded transitions locates the bytes at which the chosen
units end. As a state depends on a few bytes alone, texts are laid in lanes of equal length that start so many bytes early,
and all lanes step at once in numpy; the table is built from the sentinels, so others can be given.

A unit is a line with its newline, or what follows the last newline. A text without a unit, or with a sentinel in it, stays
plain, as does the share that `fim_percent` leaves out.

Rows: a null text is empty, so plain; a null doc_id draws as the word `null`; repeated rows get the same result; an empty
table gives no row; columns of the documents stay and those that are added replace columns of the same name. Memory follows
an Arrow batch (24 MB) or, for a longer text, that text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, batches, utf8

#: What a transition does.
POINT, UNIT, SENTINEL = 1, 2, 4
LANE = 512
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Fim:
    """Draws and sentinels. The percentages are of all texts that can be cut, and of those for the order suffix, prefix."""

    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def sentinels(self) -> tuple[bytes, ...]:
        return tuple(s.encode() for s in (self.prefix, self.suffix, self.middle))

    def __post_init__(self) -> None:
        found = self.sentinels()
        overlap = any(s[k:] == t[: len(s) - k] for s in found for t in found for k in range(1, len(s)))
        if overlap or not all(found) or any(b"\n" in s for s in found) or any(s in t for i, s in enumerate(found) for j, t in enumerate(found) if i != j):
            raise ValueError("no sentinel may be empty, hold a newline or another, or end with what another or itself begins with")


class Automaton:
    """Next state and action by state and byte class; class 0 separates texts and leads back to the first state."""

    def __init__(self, sentinels: tuple[bytes, ...]) -> None:
        heads = sorted({s[:k] for s in sentinels for k in range(len(s))})
        special = sorted({*b"\n", *b"".join(sentinels)})
        symbols = [bytes([b]) for b in special]
        self.of_byte = np.zeros(256, np.uint8)
        groups = [(0x00, 0x7F, 0), (0x80, 0xBF, -1), (0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xFF, 3)]
        kinds: list[tuple[bytes | None, int]] = [(None, 0)]  # the separator
        for lo, hi, more in groups:
            kinds.append((b"", more))
            self.of_byte[lo : hi + 1] = len(kinds) - 1
        for b, symbol in zip(special, symbols, strict=True):
            kinds.append((symbol, next(more for lo, hi, more in groups if lo <= b <= hi)))
            self.of_byte[b] = len(kinds) - 1
        first = (0, True, b"")
        states, table, actions = {first: 0}, [], []
        todo = [first]
        for due, fresh, head in todo:  # grows while it is read
            nexts, acts = [], []
            for symbol, more in kinds:
                if symbol is None:
                    to, act = first, 0
                else:
                    seen = head + symbol if symbol else b""
                    done = any(seen.endswith(s) for s in sentinels)
                    seen = next((seen[k:] for k in range(len(seen) + 1) if seen[k:] in heads), b"") if not done else b""
                    goes_on = more < 0 and due > 0
                    to = (due - 1 if goes_on else max(more, 0), symbol == b"\n", seen)
                    act = (0 if goes_on else POINT) | UNIT * fresh | SENTINEL * done
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                nexts.append(states[to])
                acts.append(act)
            table.append(nexts)
            actions.append(acts)
        self.n_classes = len(kinds)
        self.next, self.action = np.array(table, np.uint8), np.array(actions, np.uint8)
        self.warm = max(4, *(len(s) for s in sentinels))

    def actions(self, classes: np.ndarray) -> np.ndarray:
        """What the transition at each byte does, for a stream that begins in the first state."""
        n, warm, width = len(classes), self.warm, self.n_classes
        lanes = -(-n // LANE)
        padded = np.zeros(warm + lanes * LANE, np.uint8)
        padded[warm : warm + n] = classes
        grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, warm + LANE)[::LANE].T)
        out = np.empty((LANE, lanes), np.uint8)
        flat_next, flat_action = (self.next.astype(np.int32) * width).ravel(), self.action.ravel()
        state = np.zeros(lanes, np.int32)  # states times the number of classes
        for step in range(warm + LANE):
            at = state + grid[step]
            if step >= warm:
                out[step - warm] = flat_action[at]
            state = flat_next[at]
        return out.T.ravel()[:n]


@cache
def automaton(sentinels: tuple[bytes, ...]) -> Automaton:
    return Automaton(sentinels)


def scan(texts: list[bytes], sentinels: tuple[bytes, ...]):
    """(bytes of all texts with a separator behind each, start of each, end of each, counts of units and sentinels, actions)."""
    machine = automaton(sentinels)
    data = b"\n".join([*texts, b""])
    raw = np.frombuffer(data, np.uint8)
    end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
    classes = machine.of_byte[raw]
    classes[end] = 0
    actions = machine.actions(classes)
    count = lambda bit: np.add.reduceat((actions & bit) > 0, start, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return data, start, end, count(UNIT), count(SENTINEL), actions


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from seed and id."""
    return tuple(int(x) for x in np.frombuffer(hashlib.sha256(f"{seed}:{key}".encode()).digest(), ">u4", 4))


_ADDED = (("fim_units", "long", pa.int64()), ("fim_form", "string", pa.string()), ("fim_prefix_chars", "long", pa.int64()), ("fim_middle_chars", "long", pa.int64()), ("fim_text", "string", pa.large_string()))


def examples(keys: list[str], texts: list[bytes], fim: Fim) -> list[list]:
    """Columns of _ADDED for texts and the ids that their draws come from."""
    marks = fim.sentinels()
    data, start, end, units, sentinels, actions = scan(texts, marks)
    unit_at = np.flatnonzero(actions & UNIT)
    before = np.cumsum(units) - units
    drawn = [draws(fim.seed, k) for k in keys]
    form, cuts = [], np.zeros((len(texts), 2), np.int64)
    for i, (h1, h2, h3, h4) in enumerate(drawn):
        n = int(units[i])
        if n == 0 or sentinels[i] or h3 % 100 >= fim.fim_percent:
            form.append(PLAIN)
            continue
        form.append(SPM if h4 % 100 < fim.spm_percent else PSM)
        cuts[i] = sorted((h1 % (n + 1), h2 % (n + 1)))
    # the second pass: the byte at which so many units have ended
    place = (before[:, None] + cuts).ravel()
    at = np.where(cuts.ravel() < np.repeat(units, 2), np.append(unit_at, 0)[np.minimum(place, len(unit_at))], np.repeat(end, 2)).reshape(-1, 2)
    chosen = np.flatnonzero([f != PLAIN for f in form])
    edges = np.stack([start[chosen], at[chosen, 0], at[chosen, 1]], axis=1)
    sizes = np.zeros((0, 2), np.int64)
    if len(chosen):  # code points that begin between the edges; an empty stretch would give its first byte's
        sizes = np.add.reduceat(actions & POINT, edges.ravel(), dtype=np.int64).reshape(-1, 3)[:, :2] * (np.diff(edges, axis=1) > 0)
    out: list = [t.decode("utf-8", "surrogatepass") for t in texts]
    prefix_chars, middle_chars = [None] * len(texts), [None] * len(texts)
    for row, i in enumerate(chosen.tolist()):
        a, b, c = edges[row].tolist()
        prefix, middle, suffix = data[a:b], data[b:c], data[c : end[i]]
        parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if form[i] == SPM else (marks[0], prefix, marks[1], suffix, marks[2], middle)
        out[i] = b"".join(parts).decode("utf-8", "surrogatepass")
        prefix_chars[i], middle_chars[i] = sizes[row].tolist()
    return [units.tolist(), form, prefix_chars, middle_chars, out]


def fill_in_middle(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """The documents with fim_units, fim_form (plain, psm or spm), fim_prefix_chars and fim_middle_chars (null if plain) and
    fim_text."""
    arrow_limits(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c.lower() not in {name for name, _, _ in _ADDED}])
    names, at = docs.columns, docs.columns.index("text")
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_fim_key"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = utf8(batch.column(at).to_pylist())
            keys = batch.column(len(names)).to_pylist()
            for lo, hi in batches(texts):
                added = [pa.array(c, kind) for c, (_, _, kind) in zip(examples(keys[lo:hi], texts[lo:hi], fim), _ADDED, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(names)]), *added], names=[*names, *(name for name, _, _ in _ADDED)])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{name} {kind}" for name, kind, _ in _ADDED)])
    return keyed.mapInArrow(run, fields)


def restored(text: Column, form: Column, fim: Fim = Fim()) -> Column:
    """The text before its parts were put in order. No sentinel can arise between the parts, so each occurs once."""
    def between(opening: str, closing: str | None) -> Column:
        rest = F.substring_index(text, opening, -1)
        return rest if closing is None else F.substring_index(rest, closing, 1)

    psm = F.concat(between(fim.prefix, fim.suffix), between(fim.middle, None), between(fim.suffix, fim.middle))
    spm = F.concat(between(fim.prefix, fim.middle), between(fim.middle, None), between(fim.suffix, fim.prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(text)
