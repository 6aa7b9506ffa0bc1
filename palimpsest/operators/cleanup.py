"""Cleaning of edit scripts: small agreements that are chance, or cost more than they save, become part of a change.

A script is taken as changes (tokens deleted, tokens inserted) with agreements between them.  Both modes go through the
changes once, with those done on a stack, so an agreement is asked again when a neighbour has grown.

* semantic: an agreement no longer than the larger side of both its neighbours goes.  Then what a change deletes at its
  end and inserts at its start (or the other way round) is an agreement again, if it is half of either side; and a
  single insertion or deletion that may stand at several places stands where both its edges are at signs rather than
  words.
* efficiency: an agreement shorter than COST tokens goes if both neighbours delete and insert, one shorter than half of
  that if three of the four do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

COST = 4
Script = list[tuple[str, int]]
Change = tuple[int, int]


def _taken_apart(script: Script) -> tuple[list[int], list[Change]]:
    """Agreements and the changes between them; the first and last agreement may be of no token."""
    same, changes = [0], []
    for op, n in script:
        if op == "=":
            if len(same) == len(changes) + 1:
                same[-1] += n
            else:
                same.append(n)
            continue
        if len(same) > len(changes):
            changes.append((0, 0))
        minus, plus = changes[-1]
        changes[-1] = (minus + n, plus) if op == "-" else (minus, plus + n)
    if len(same) == len(changes):
        same.append(0)
    return same, changes


def _put_together(same: Sequence[int], changes: Sequence[Change]) -> Script:
    out: Script = []
    for n, (minus, plus) in zip(same, [*changes, (0, 0)], strict=True):
        for op, k in (("=", n), ("-", minus), ("+", plus)):
            if k:
                out.append((op, k))
    return out


def _swallowed(same: list[int], changes: list[Change], goes: Callable[[int, Change, Change], bool]) -> tuple[list[int], list[Change]]:
    kept, done = [same[0]], []
    for n, change in zip(same[1:], changes, strict=True):
        while done and goes(kept[-1], done[-1], change):
            (minus, plus), both = done.pop(), kept.pop()
            change = (minus + both + change[0], plus + both + change[1])
        done.append(change)
        kept.append(n)
    return kept, done


def _overlap(left: Sequence, right: Sequence) -> int:
    """Length of the longest end of left that starts right."""
    size = min(len(left), len(right))
    if not size:
        return 0
    right = right[:size]
    back = [0] * size
    k = 0
    for i in range(1, size):
        while k and right[i] != right[k]:
            k = back[k - 1]
        k += right[i] == right[k]
        back[i] = k
    k = 0
    for token in left[-size:]:
        while k and (k == size or token != right[k]):
            k = back[k - 1]
        k += token == right[k]
    return k


def _overlaps(script: Script, a: Sequence, b: Sequence) -> Script:
    """Changes with an agreement between the end of one side and the start of the other are cut there."""
    same, changes = _taken_apart(script)
    out: Script = [("=", same[0])] if same[0] else []
    i = j = same[0]
    for (minus, plus), n in zip(changes, same[1:], strict=True):
        gone, new = a[i : i + minus], b[j : j + plus]
        ahead, behind = _overlap(gone, new), _overlap(new, gone)
        best = max(ahead, behind)
        if best and (2 * best >= minus or 2 * best >= plus):
            first = (("-", minus - best), ("=", best), ("+", plus - best)) if ahead >= behind else (("+", plus - best), ("=", best), ("-", minus - best))
        else:
            first = (("-", minus), ("+", plus))
        out += [x for x in (*first, ("=", n)) if x[1]]
        i, j = i + minus + n, j + plus + n
    return out


def _edge(tokens: Sequence[str], at: int) -> int:
    """How good a place before tokens[at] is to begin or end a change."""
    if at in (0, len(tokens)):
        return 2
    return int(not any(c.isalnum() for c in tokens[at - 1]))


def _shifted(script: Script, a: Sequence[str], b: Sequence[str]) -> Script:
    same, changes = _taken_apart(script)
    i, j = same[0], same[0]
    for k, (minus, plus) in enumerate(changes):
        if not (minus and plus) and same[k] and same[k + 1]:
            text, at, size = (a, i, minus) if minus else (b, j, plus)
            least = 0
            # a text that begins with an agreement goes on doing so
            while least < same[k] - (k == 0) and text[at - least - 1] == text[at - least - 1 + size]:
                least += 1
            most = 0
            while most < same[k + 1] and text[at + most] == text[at + most + size]:
                most += 1
            # of equally good places the last
            move = max(range(-least, most + 1), key=lambda d: (_edge(text, at + d) + _edge(text, at + d + size), d))
            same[k], same[k + 1] = same[k] + move, same[k + 1] - move
            i, j = i + move, j + move
        i, j = i + minus + same[k + 1], j + plus + same[k + 1]
    return _put_together(same, changes)


def _joined(script: Script) -> Script:
    """No two changes, or agreements, beside each other; deletes before inserts."""
    return _put_together(*_taken_apart(script))


def cleaned(script: Script, a: Sequence[str], b: Sequence[str], mode: str | None) -> Script:
    """The script of a and b, cleaned as `mode` says: None, "semantic" or "efficiency"."""
    if mode is None or len(script) < 2:
        return script
    if mode == "semantic":
        script = _put_together(*_swallowed(*_taken_apart(script), lambda n, p, q: 0 < n <= min(max(p), max(q))))
        return _joined(_shifted(_joined(_overlaps(script, a, b)), a, b))
    if mode == "efficiency":
        sides = lambda p, q: sum(x > 0 for x in (*p, *q))
        return _put_together(*_swallowed(*_taken_apart(script), lambda n, p, q: n < COST and sides(p, q) == 4 or 2 * n < COST and sides(p, q) == 3))
    raise ValueError(f"no such cleanup: {mode}")
