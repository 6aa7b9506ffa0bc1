"""Cleaning of texts before a collation, with offsets kept: folio tags, hit counts, pattern filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = r"\[[^\[\]\n]{1,40}\]"
_MAP = "array<struct<pos:int,diff:int>>"
# Code points that no text has by definition; they go round replacements while these are measured.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"


def strip_tags(text: Column) -> Column:
    """Every folio tag becomes one space."""
    return F.regexp_replace(text, TAG, " ")


def milestones(text: Column) -> Column:
    """Array of (offset in the stripped text, tag)."""
    tags, gaps = F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.split(text, TAG, -1)
    none = F.expr("cast(array() as array<struct<offset:int,tag:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.aggregate(
        F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(tags)).alias("gap"), tags.alias("tag")), start,
        lambda s, x: F.struct((s["at"] + x["gap"] + 1).alias("at"), F.concat(s["found"], F.array(F.struct((s["at"] + x["gap"]).alias("offset"), x["tag"].alias("tag")))).alias("found")),
    )["found"]


def hits(text: Column) -> dict[str, Column]:
    """What cleaning would touch: counts of tags, underscores, pipes and head marks."""

    def count(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    return {"tags": F.regexp_count(text, F.lit(TAG)), "underscores": count("_"), "pipes": count("|"), "head_marks": count("@#!")}


def preview(text: Column) -> Column:
    """The counts above zero as one line."""
    names = {"tags": "folio/page tags [..]", "underscores": "underscores _", "pipes": "pipes |", "head_marks": "head marks @ # !"}
    parts = [F.when(n > 0, F.concat(F.lit(f"{names[k]}: "), n.cast("string"))) for k, n in hits(text).items()]
    line = F.concat_ws(", ", *parts)
    return F.when(line == "", "nothing to clean").otherwise(line)


def apply_pattern(text: Column, pattern: str, replacement: str | Callable[[Column], Column]) -> Column:
    """(text, map): matches of pattern replaced, and the offset map back to the input.

    Matches must not be empty; what is around them may be looked at.  replacement may name groups ($1), or be a function of
    the match (Column to Column).
    A shorter replacement leaves one map entry after it, a longer one an entry for each further character.
    A text with U+FDD0 or U+FDD1, which are no characters, has its matches replaced one by one, without what is around.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if callable(replacement):
        put = F.transform(found, replacement)
    else:
        # each replacement as it is in the whole text, where lookaround and groups see what they should
        marked = F.regexp_replace(text, pattern, _OPEN + replacement + _CLOSE)
        each = F.regexp_extract_all(marked, F.lit(f"(?s){_OPEN}(.*?){_CLOSE}"), F.lit(1))
        put = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), F.transform(found, lambda m: F.regexp_replace(m, pattern, replacement))).otherwise(each)
    whole = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), put.alias("put")), lambda x: F.concat(x["gap"], x["put"])), ""), F.element_at(gaps, -1))
    gap = F.slice(F.transform(gaps, F.length), 1, F.size(found))
    map_ = _entries(gap, F.transform(found, F.length), F.transform(put, F.length))
    return F.struct((whole if callable(replacement) else F.regexp_replace(text, pattern, replacement)).alias("text"), map_.alias("map"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("diff", T.IntegerType())])))
def _entries(gap: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    """A text's map from the lengths of what is between its matches, of the matches and of what replaces them; running sums, not steps."""
    places, diffs, counts = [], [], []
    for i in range(len(gap)):
        if not gap[i].is_valid:
            counts.append(0)
            continue
        g, o, n = (x[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (gap, old, new))
        end, diff = np.cumsum(g + n), np.cumsum(o - n)
        more = np.where(n < o, 1, np.maximum(n - o, 0))
        which = np.repeat(np.arange(len(g)), more)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more)
        shrinks = (n < o)[which]
        places.append(np.where(shrinks, end[which], end[which] - n[which] + o[which] + nth))
        diffs.append(np.where(shrinks, diff[which], diff[which] - o[which] + n[which] - nth - 1))
        counts.append(len(which))
    flat = [pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)) for x in (places, diffs)]
    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["pos", "diff"]))


def corrected(position: Column, offset_map: Column) -> Column:
    """The position before the filter: that of the last map entry at or before it, moved."""
    return position + F.coalesce(F.try_element_at(F.filter(offset_map, lambda p: p["pos"] <= position), F.lit(-1))["diff"], F.lit(0))


#: What a filter may be: a pattern and its replacement, or a function from a text to (text, map) as apply_pattern() gives them.
Filter = tuple[str, str | Callable[[Column], Column]] | Callable[[Column], Column]


def translate_filter(matching: str, replace: str) -> Callable[[Column], Column]:
    """A filter that replaces or (beyond the end of replace) drops single characters."""
    gone = matching[len(replace) :]
    if not gone:
        return lambda text: F.struct(F.translate(text, matching, replace).alias("text"), F.expr(f"cast(array() as {_MAP})").alias("map"))
    dropped = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in gone) + "]"
    kept = matching[: len(replace)]

    def run(text: Column) -> Column:
        found = apply_pattern(text, dropped, "")
        return F.struct(F.translate(found["text"], kept, replace).alias("text"), found["map"].alias("map"))

    return run


def filter_chain(df, text: str, patterns: list[Filter], out: str = "filtered", maps: str = "maps"):
    """df with the filtered text and the array of its maps, first filter first."""
    at, names = F.col(text), []
    for i, one in enumerate(patterns):
        df = df.withColumn(f"_f{i}", one(at) if callable(one) else apply_pattern(at, *one))
        at = F.col(f"_f{i}.text")
        names.append(f"_f{i}")
    found = F.array(*(F.col(f"{n}.map") for n in names)) if names else F.expr(f"cast(array() as array<{_MAP}>)")
    return df.withColumns({out: at, maps: found}).drop(*names)


def corrected_chain(position: Column, maps: Column) -> Column:
    """The position in the text before the first filter."""
    return F.aggregate(F.reverse(maps), position, lambda at, m: corrected(at, m))


def moved(positions: np.ndarray, maps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """As corrected_chain(), for all positions of a text at once: a binary search a position and map.

    maps: places and differences of each filter, first filter first.
    """
    for places, diffs in reversed(maps):
        if len(places):
            at = np.searchsorted(places, positions, side="right") - 1
            positions = positions + np.where(at >= 0, diffs[np.maximum(at, 0)], 0)
    return positions


def corrected_rows(rows: DataFrame, maps: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...], name: str = "maps") -> DataFrame:
    """rows with columns moved to before the filters of their text: maps(keys, name) has the maps of each text, a row each.

    Positions and map entries go by in one order, and each position takes the last entry at or before it: time is that of
    sorting both, whatever their number.  A null position, or one of a text without maps, stays.
    """
    filters = maps.select(*keys, F.posexplode(name).alias("_stage", "_m")).select(*keys, "_stage", F.inline("_m")).select(*keys, "_stage", F.col("pos").alias("_at"), F.col("diff").alias("_diff"))
    stages = maps.agg(F.max(F.size(name))).first()[0] or 0
    held = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in keys)))
    for column in columns:
        held = held.withColumn(f"_{column}", F.col(f"_row.{column}"))
    held = held.select(*keys, "_row", *(f"_{c}" for c in columns))
    kinds = {f.name: f.dataType for f in held.schema}
    for stage in reversed(range(stages)):
        some = filters.where(F.col("_stage") == stage)
        for column in columns:
            at = f"_{column}"
            entries = some.select(*keys, *(F.lit(None).cast(kinds[c]).alias(c) for c in held.columns if c not in keys), F.col("_at"), F.lit(0).alias("_kind"), "_diff")
            both = held.select(*held.columns, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_diff")).unionByName(entries)
            upto = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            both = both.withColumn("_last", F.last("_diff", ignorenulls=True).over(upto)).where("_kind = 1")
            held = both.withColumn(at, F.col(at) + F.coalesce("_last", F.lit(0))).select(*held.columns)
    return held.select(*(F.col(c) if c in keys else F.col(f"_{c}").alias(c) if c in columns else F.col("_row").getField(c).alias(c) for c in rows.columns))
