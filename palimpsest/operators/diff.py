"""Edit scripts between token sequences: the one operator that Spark's expressions cannot say.

Minimal scripts by the greedy O(ND) algorithm, deletes before inserts.  It holds a step's frontier per edit, so beyond
MAX_EDITS differences a stretch gets its minimal script by halving instead: memory is linear in the two lengths, time their
product over 64 (some 0.2 s for 20,000 tokens a side).  Only which of several minimal scripts is found depends on that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.cleanup import cleaned
from palimpsest.shipping import ship

MAX_EDITS = 400
Script = list[tuple[str, int]]


def _greedy(a: Sequence, b: Sequence, most: int) -> list[str] | None:
    """One letter a step (=, -, +), or nothing beyond `most` edits."""
    n, m = len(a), len(b)
    reach = {1: 0}
    history = []
    for d in range(min(most, n + m) + 1):
        history.append(dict(reach))
        for k in range(-d, d + 1, 2):
            # down is an insert (k + 1), right a delete (k - 1)
            x = reach[k + 1] if k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return _walked(history, n, m)
    return None


def _walked(history: list[dict], n: int, m: int) -> list[str]:
    steps: list[str] = []
    x, y = n, m
    for d in range(len(history) - 1, -1, -1):
        reach, k = history[d], x - y
        down = k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)
        px = reach[k + 1] if down else reach[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > px and y > py and (d == 0 or x > (px if down else px + 1)):
            steps.append("=")
            x, y = x - 1, y - 1
        if d:
            steps.append("+" if down else "-")
            x, y = px, py
    return steps[::-1]


def _common(a: Sequence, b: Sequence) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b: a bit a token of b, a sum a token of a."""
    places: dict = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    masks = {}
    for t in set(a) & places.keys():
        bits = np.zeros(len(b), np.uint8)
        bits[places[t]] = 1
        masks[t] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = row = (1 << len(b)) - 1
    for t in a:
        if t in masks:
            met = row & masks[t]
            row = ((row + met) | (row - met)) & full
    bits = np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8)
    return np.r_[0, np.cumsum(np.unpackbits(bits, bitorder="little")[: len(b)] == 0)]


def _halved(a: Sequence, b: Sequence) -> list[str]:
    """A minimal script: b is cut where the halves of a have most in common with its sides."""
    if not a or not b:
        return ["-"] * len(a) + ["+"] * len(b)
    if len(a) == 1:
        at = next((j for j, t in enumerate(b) if t == a[0]), -1)
        return ["-"] + ["+"] * len(b) if at < 0 else ["+"] * at + ["="] + ["+"] * (len(b) - at - 1)
    half = len(a) // 2
    cut = int(np.argmax(_common(a[:half], b) + _common(a[half:][::-1], b[::-1])[::-1]))
    return _halved(a[:half], b[:cut]) + _halved(a[half:], b[cut:])


def _only_own(a: Sequence, b: Sequence) -> list[str] | None:
    """The script, in linear time, of sequences that agree in all tokens that both have: there is one minimal set of kept tokens."""
    both = set(a) & set(b)
    if [t for t in a if t in both] != [t for t in b if t in both]:
        return None
    steps: list[str] = []
    j = 0
    for t in a:
        if t in both:
            while b[j] not in both:
                steps.append("+")
                j += 1
            steps.append("=")
            j += 1
        else:
            steps.append("-")
    return steps + ["+"] * (len(b) - j)


def _within(long: Sequence, short: Sequence, other: str) -> list[str] | None:
    """The script that _greedy() finds, in linear time, if the short sequence is the long one without some of its tokens."""
    steps: list[str] = []
    j, n = 0, len(short)
    for t in long:
        if j < n and t == short[j]:
            steps.append("=")
            j += 1
        else:
            steps.append(other)
    return steps if j == n else None


def middle_steps(a: Sequence, b: Sequence) -> list[str]:
    """A minimal script, one letter a step."""
    found = _within(a, b, "-") if len(a) > len(b) else _within(b, a, "+")
    if found is None:
        found = _greedy(a, b, MAX_EDITS)
    return _halved(a, b) if found is None else found


def _steps(a: Sequence, b: Sequence) -> list[str]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        middle = ["-"] * len(x) + ["+"] * len(y)
    elif (middle := _only_own(x, y)) is None:
        middle = middle_steps(x, y)
    return ["="] * head + middle + ["="] * tail


def edit_script(a: Sequence, b: Sequence, cleanup: str | None = None) -> Script:
    """Run lengths; within a changed run deletes come before inserts.  cleanup: as cleanup.cleaned() does it, then not minimal."""
    script: Script = []
    for same, run in groupby(_steps(a, b), key="=".__eq__):
        steps = list(run)
        minus = 0 if same else steps.count("-")
        counts = (("=", len(steps)),) if same else (("-", minus), ("+", len(steps) - minus))
        script += [(op, n) for op, n in counts if n]
    return cleaned(script, a, b, cleanup)


def placements(script: Script) -> list[tuple[int, int]]:
    """(anchor, slot) of each token of the second sequence.

    Slot 0 is the base token's own cell.  In a changed run the last deletes pair with the first inserts; further
    inserts follow the base token before them in slots 1, 2, ...; those before the first base token have anchor -1 and
    slots that count up to -1, so that they stand against it from the left.
    """
    out: list[tuple[int, int]] = []
    base = 0
    i = 0
    while i < len(script):
        op, n = script[i]
        if op == "=":
            out += [(base + j, 0) for j in range(n)]
            base += n
            i += 1
            continue
        minus = n if op == "-" else 0
        plus = n if op == "+" else script[i + 1][1] if i + 1 < len(script) and script[i + 1][0] == "+" else 0
        i += 1 if op == "+" or not plus else 2
        pairs = min(minus, plus)
        base += minus
        out += [(base - pairs + j, 0) for j in range(pairs)]
        extra = plus - pairs
        out += [(base - 1, j + 1) for j in range(extra)] if base else [(-1, j - extra) for j in range(extra)]
    return out


def placed_cells(base: Sequence[str], norms: Sequence[str], tokens: Sequence[str], cleanup: str | None = None) -> list[list]:
    """A witness's tokens with their places, as columns: anchor, slot, start, end, incr, text.

    A token of empty norm takes no part: it joins the cell before it, or the first.
    """
    a, b = [x for x in base if x != ""], [x for x in norms if x != ""]
    at = [i for i, x in enumerate(base) if x != ""]
    spots = iter(placements([("=", len(a))] if a == b else edit_script(a, b, cleanup)))
    if "" not in norms:
        # nothing joins: places are sums of lengths
        found = list(spots)
        ends = list(accumulate(map(len, tokens)))
        anchors = [at[x] if x >= 0 else -1 for x, _ in found]
        return [anchors, [y for _, y in found], [0, *ends[:-1]] if ends else [], ends, [1] * len(ends), list(tokens)]
    out: list[list] = [[] for _ in range(6)]
    anchors, slots, starts, ends, incrs, texts = out
    start, waiting = 0, ""
    for norm, token in zip(norms, tokens, strict=True):
        end = start + len(token)
        if norm != "":
            anchor, slot = next(spots)
            anchors.append(at[anchor] if anchor >= 0 else -1)
            slots.append(slot)
            starts.append(start - len(waiting))
            ends.append(end)
            incrs.append(1)
            texts.append(waiting + token)
            waiting = ""
        elif texts:
            ends[-1], texts[-1] = end, texts[-1] + token
        else:
            waiting += token
        start = end
    if waiting:
        for column, x in zip(out, (-1, -1, 0, start, 0, waiting), strict=True):
            column.append(x)
    return out


_CELL = "array<struct<anchor:int,slot:int,start:int,end:int,incr:int,text:string>>"


CELL_NAMES = ["anchor", "slot", "start", "end", "incr", "text"]


def cell_lists(found: list[list[list]]) -> pa.ListArray:
    """The columns that placed_cells() gives for each row, as a list of cells a row."""
    flat = [pa.array([x for f in found for x in f[k]], pa.string() if name == "text" else pa.int32()) for k, name in enumerate(CELL_NAMES)]
    offsets = np.cumsum([0, *(len(f[5]) for f in found)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, CELL_NAMES))


def _placed(cleanup: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [placed_cells(*x, cleanup) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cell_lists(found)], ["collation_id", "witness_id", "cells"])

    return run


def _scripted(cleanup: str | None):
    kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"op": op, "n": n} for op, n in edit_script(a, b, cleanup)] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["collation_id", "witness_id", "script"])

    return run


def _pairs(arrays: DataFrame) -> DataFrame:
    base = arrays.where("witness_id = 0").select("collation_id", F.col("norms").alias("base"))
    return arrays.join(base, "collation_id")


def edit_scripts(arrays: DataFrame, cleanup: str | None = None) -> DataFrame:
    """collation_id, witness_id, script: of each witness of arrays(collation_id, witness_id, norms) against witness 0."""
    ship(arrays.sparkSession)
    kinds = dict(arrays.dtypes)
    pairs = _pairs(arrays).where("witness_id > 0").select("collation_id", "witness_id", "base", "norms")
    return pairs.mapInArrow(_scripted(cleanup), f"collation_id {kinds['collation_id']}, witness_id {kinds['witness_id']}, script array<struct<op:string,n:int>>")


def place(arrays: DataFrame, cleanup: str | None = None) -> DataFrame:
    """collation_id, witness_id, anchor, slot, start, end, incr, text: cells of arrays(collation_id, witness_id, norms, tokens)."""
    ship(arrays.sparkSession)
    kinds = dict(arrays.dtypes)
    pairs = _pairs(arrays).select("collation_id", "witness_id", "base", "norms", "tokens")
    rows = pairs.mapInArrow(_placed(cleanup), f"collation_id {kinds['collation_id']}, witness_id {kinds['witness_id']}, cells {_CELL}")
    return rows.select("collation_id", "witness_id", F.inline("cells"))
