"""Readings of aligned cells: comparison keys, display syllables, note texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.options import A_CHUNG, OMITTED, TSHEG, Options

#: Between parts; it is a blank to no one, and dropped from cells.
_BREAK = "\x01"


def comparison_key(cell: Column, o: Options) -> Column:
    """The cell without what is no difference; where shads count, | and / are one."""
    gone = o.ignored + (o.shads if o.ignore_shad else "")
    if not o.ignore_shad and o.pipe_as_shad:
        cell = F.translate(cell, "|", "/")
    return F.translate(cell, gone, "")


def syllables(cell: Column, o: Options) -> Column:
    """Display syllables; a bare a-chung joins the one before it, or the first."""
    # what is ignored goes from the whole, but for what parts syllables, of which none is left in them
    gone = (o.shads if o.ignore_shad else "") + "".join(c for c in o.ignored + _BREAK if c not in o.separators and not c.isspace())
    parts = F.filter(F.split(F.translate(F.coalesce(cell, F.lit("")), gone, ""), o.separator_regex, -1), lambda p: p != "")
    # a part that is nothing but a-chungs loses the break before it, and the first part the break after it
    row = F.regexp_replace(F.array_join(parts, _BREAK), f"{_BREAK}([{A_CHUNG}]+)(?={_BREAK}|\\z)", "$1")
    row = F.regexp_replace(row, f"^([{A_CHUNG}]+){_BREAK}", "$1")
    joined = F.when(row == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(row, _BREAK, -1))
    some = reduce(or_, (F.contains(cell, F.lit(c)) for c in A_CHUNG))
    return F.when(some, joined).otherwise(parts)


def common_prefix(readings: Column) -> Column:
    """How many leading syllables all readings (array of arrays) share."""
    least = F.array_min(F.transform(readings, F.size))
    steps = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i) & F.forall(readings, lambda r: F.get(r, i) == F.get(F.get(readings, F.lit(0)), i)), i + 1).otherwise(n))


def trimmed(readings: Column) -> Column:
    """Readings without the syllables that all share at the start, then at the end.  readings: a computed column."""
    pre = common_prefix(readings)
    cut = F.transform(readings, lambda r: F.slice(r, pre + 1, F.size(r) - pre))
    suf = common_prefix(F.transform(cut, F.reverse))
    return F.transform(cut, lambda r: F.slice(r, F.lit(1), F.size(r) - suf))


def display(reading: Column) -> Column:
    tibetan = F.array_join(reading, " ").rlike("[ༀ-࿿]")
    return F.when(F.size(reading) == 0, OMITTED).when(tibetan, F.array_join(reading, TSHEG)).otherwise(F.array_join(reading, " "))


def note_text(labels: Column, keys: Column, displays: Column, positive: bool) -> Column:
    """Note of a row: base siglum (and those that agree, if positive), lemma], variants grouped by their display.

    The arrays are by witness, the base first.
    """
    rows = F.arrays_zip(labels.alias("label"), keys.alias("key"), displays.alias("shown"))
    base_key, lemma = F.get(keys, F.lit(0)), F.get(displays, F.lit(0))
    others = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    variants = F.filter(others, lambda x: x["key"] != base_key)
    groups = F.transform(
        F.array_distinct(F.transform(variants, lambda x: x["shown"])),
        lambda shown: F.concat(F.array_join(F.transform(F.filter(variants, lambda x: x["shown"] == shown), lambda x: x["label"]), ", "), F.lit(" "), shown),
    )
    agree = F.transform(F.filter(others, lambda x: x["key"] == base_key), lambda x: x["label"])
    names = F.concat(F.array(F.get(labels, F.lit(0))), agree) if positive else F.array(F.get(labels, F.lit(0)))
    text = F.concat(F.array_join(names, ", "), F.lit(" "), lemma, F.lit("] "), F.array_join(groups, "; "))
    return F.when(F.size(variants) > 0, text).otherwise("")
