"""Critical apparatus of merged rows: differences, notes, numbers, anchors, milestones."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from palimpsest.functions.readings import comparison_key, display, note_text, syllables
from palimpsest.operators import held
from palimpsest.operators import ordered as streams
from palimpsest.operators.align import reattach_achung, witness_segments
from palimpsest.options import A_CHUNG, COLORS, Options
from palimpsest.shipping import ship


def reading_rows(wide: DataFrame, o: Options) -> DataFrame:
    """collation_id, row_id, segs: the cell texts of each row by witness, lone a-chungs moved on."""
    moved = witness_segments(wide).withColumn("segs", reattach_achung(F.col("segs"), o))
    cells = moved.select("collation_id", "witness_id", F.posexplode("segs").alias("row_id", "seg"))
    rows = cells.groupBy("collation_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("witness_id", F.coalesce("seg", F.lit("")).alias("seg")))).alias("r"))
    return rows.select("collation_id", "row_id", F.transform("r", lambda x: x["seg"]).alias("segs"))


def _reattached(o: Options):
    """reattach_achung() of texts' cells, one text after the other; nothing where no cell ends so."""
    lone = re.compile("(?s)(|.*[" + re.escape(o.separators + o.shads) + "])([" + A_CHUNG + "]+)")

    def moved(segs: list[str]) -> list[str]:
        out, waiting, at = list(segs), "", -1
        for i, cell in enumerate(segs):
            if cell:
                whole = waiting + cell
                found = lone.fullmatch(whole)
                out[i], waiting = found.groups() if found else (whole, "")
                at = i
        if waiting:
            out[at] += waiting
        return out

    def texts(cells: pa.StringArray, sizes: np.ndarray) -> pa.StringArray | None:
        if not pc.any(pc.match_substring_regex(cells, "[" + A_CHUNG + "]$")).as_py():
            return None
        own, at = cells.to_pylist(), 0
        for n in sizes.tolist():
            own[at : at + n] = moved(own[at : at + n])
            at += n
        return pa.array(own, pa.string())

    return texts


def held_rows(met: DataFrame, o: Options) -> DataFrame:
    """As reading_rows(), of align.met(), in order, with its other columns in each collation's first row, labels where texts are not alike, and where the base ends."""
    ship(met.sparkSession)
    others = [c for c in met.columns if c not in ("collation_id", "of", "tokens", "words", "norms", "labels")]
    rows = met.select("collation_id", "of", "tokens", "words", "norms", "labels", *others)
    row = [T.StructField("row_id", T.IntegerType()), T.StructField("segs", T.ArrayType(T.StringType())), T.StructField("alike", T.BooleanType()), T.StructField("base_end", T.IntegerType())]
    kind = T.StructType([met.schema["collation_id"], *row, T.StructField("labels", met.schema["labels"].dataType), *(T.StructField(c, met.schema[c].dataType) for c in others)])
    return rows.mapInArrow(held.read(kind.names, _reattached(o)), kind)


def _shared(readings: list[list[str]]) -> int:
    """How many leading syllables all readings share."""
    n = 0
    while all(len(r) > n and r[n] == readings[0][n] for r in readings):
        n += 1
    return n


@F.arrow_udf(from_arrow_type(pa.list_(pa.list_(pa.string()))))
def _trimmed(lists: pa.Array) -> pa.Array:
    """readings.trimmed() of each row's readings, where there are such."""
    rows, at, readings = _held(lists)
    sylls = readings.flatten()
    ends = np.r_[0, np.cumsum(readings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    none = ends[1:] == ends[:-1]
    some = np.ones(len(lists), bool)
    some[rows[none]] = False
    shared = np.zeros(len(lists), bool)
    codes = sylls.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    if len(codes):
        for end in (np.minimum(ends[:-1], len(codes) - 1), np.maximum(ends[1:] - 1, 0)):
            own = codes[end]
            apart = np.zeros(len(lists), bool)
            apart[rows[own != own[at[rows]]]] = True
            shared |= ~apart
    # most readings have no syllable at either end that all share
    which = np.flatnonzero(some & shared & (np.bincount(rows, minlength=len(lists)) > 0))
    if not len(which):
        return lists
    out: list[list[list[str]]] = []
    for own in lists.take(pa.array(which)).to_pylist():
        pre = _shared(own)
        own = [r[pre:] for r in own]
        suf = _shared([r[::-1] for r in own])
        out.append([r[: len(r) - suf] for r in own])
    put = np.arange(len(lists))
    put[which] = len(lists) + np.arange(len(which))
    return pa.concat_arrays([lists, pa.array(out, lists.type)]).take(pa.array(put))


def _held(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of each reading, the first reading of each row, and the readings."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes, lists.flatten()


def siglum(witnesses: DataFrame) -> Column:
    return F.col("siglum") if "siglum" in witnesses.columns else F.concat(F.lit("W"), (F.col("witness_id") + 1).cast("string"))


def labels(witnesses: DataFrame) -> DataFrame:
    """collation_id, labels: sigla by witness; W1, W2, ... without a column siglum."""
    rows = witnesses.groupBy("collation_id").agg(F.array_sort(F.collect_list(F.struct("witness_id", siglum(witnesses).alias("s")))).alias("r"))
    return rows.select("collation_id", F.transform("r", lambda x: x["s"]).alias("labels"))


def _char_class(chars: str) -> str:
    return "[" + "".join(re.escape(c) if c.isascii() and not c.isalnum() else c for c in chars) + "]"


def anchor_cut(seg: Column, lemma_is_shad: Column, o: Options) -> Column:
    """Where in the base cell a note's mark stands: before trailing blanks, shads and ignored characters.

    A note on a shad keeps its mark after the shad; a cell of nothing else has it before trailing blanks.
    """
    blanks = F.length(F.regexp_replace(seg, r"(?U)\s+\z", ""))
    bare = F.length(F.regexp_replace(seg, rf"(?U)(?:\s|{_char_class(o.shads + o.ignored)})+\z", ""))
    cut = F.when(lemma_is_shad, blanks).otherwise(bare)
    return F.when(cut == 0, blanks).otherwise(cut)


def _alike(rows: DataFrame) -> Column:
    """Rows of which it is known that all texts are equal: most, and those need no keys but one."""
    return F.coalesce("alike", F.lit(False)) if "alike" in rows.columns else F.lit(False)


def _differs(rows: DataFrame, o: Options) -> Column:
    keys = F.transform("segs", lambda x: comparison_key(x, o))
    return F.when(_alike(rows), False).otherwise(F.exists(keys, lambda k: k != comparison_key(F.get("segs", F.lit(0)), o)))


def _shown(rows: DataFrame, o: Options) -> DataFrame:
    """rows(segs, labels, differs) with keys, lemma and note."""
    same = F.transform("segs", lambda _: comparison_key(F.get("segs", F.lit(0)), o))
    rows = rows.withColumn("keys", F.when(_alike(rows), same).otherwise(F.transform("segs", lambda x: comparison_key(x, o))))
    # most rows agree: only those that differ are split and trimmed
    rows = rows.withColumn("sylls", F.when(F.col("differs"), F.transform("segs", lambda x: syllables(x, o))))
    rows = rows.withColumn("shown", F.when(F.col("differs"), F.transform(_trimmed("sylls"), display)))
    note = F.when(F.col("differs"), note_text(F.col("labels"), F.col("keys"), F.col("shown"), o.positive))
    return rows.withColumns({"note": note, "lemma": F.when(F.col("differs"), F.get("shown", F.lit(0)))}).drop("sylls")


def _cut(o: Options) -> Column:
    base = F.get("segs", F.lit(0))
    shad = F.coalesce(F.col("lemma").rlike(rf"(?U)^(?:\s|{_char_class(o.shads)})+$"), F.lit(False))
    return F.when(F.col("differs") & (base != ""), anchor_cut(base, shad, o))


def apparatus(rows: DataFrame, sigla: DataFrame | None, o: Options, ordered: bool = False) -> DataFrame:
    """rows with keys, differs, note_no, lemma, note, color, shaded and marked (by witness), base_start, base_end, cut.

    Numbers run over the differing rows of a collation, which all have a note; null elsewhere.  Without sigla, rows have labels.
    ordered: as operators.ordered says.
    """
    ship(rows.sparkSession)
    rows = rows if sigla is None else rows.join(sigla, "collation_id")
    base = F.get("segs", F.lit(0))
    rows = rows.withColumn("differs", _differs(rows, o))
    rows = rows.withColumn("labels", F.when(F.col("differs"), F.col("labels")))
    # rows of held_rows() know where their base ends
    sums = {"note_no": F.col("differs").cast("int")} | ({} if "base_end" in rows.columns else {"base_end": F.length(base)})
    rows = _shown(streams.running(rows, sums, ordered), o)
    rows = rows.withColumn("note_no", F.when(F.col("differs"), F.col("note_no")))
    color = F.when(F.col("differs"), F.element_at(F.array(*map(F.lit, COLORS)), (F.col("note_no") - 1) % len(COLORS) + 1))
    base_key = F.get("keys", F.lit(0))
    apart = F.transform("keys", lambda k, i: F.when(i == 0, F.col("differs")).otherwise((k != base_key) | (base_key == "") & F.col("differs")))
    apart = F.when(_alike(rows), F.transform("segs", lambda _: F.lit(False))).otherwise(apart)
    rows = rows.withColumns({"color": color, "apart": apart, "base_start": F.col("base_end") - F.length(base)})
    shaded = F.zip_with("apart", "keys", lambda a, k: a & (k != ""))
    marked = F.zip_with("apart", "segs", lambda a, s: a & (s != ""))
    return rows.withColumns({"shaded": shaded, "marked": marked, "cut": _cut(o)}).drop("apart", "labels", "shown", "alike")


def note_list(rows: DataFrame, sigla: DataFrame | None, o: Options, ordered: bool = False) -> DataFrame:
    """notes() of apparatus(): rows that do not differ go before anything is numbered."""
    ship(rows.sparkSession)
    rows = rows if sigla is None else rows.join(sigla, "collation_id")
    some = rows.where(_differs(rows, o)).select("collation_id", "row_id", "segs", "labels")
    return notes(_shown(streams.running(some, {"note_no": F.lit(1)}, ordered).withColumn("differs", F.lit(True)), o))


def notes(found: DataFrame) -> DataFrame:
    """collation_id, row_id, note_no, lemma, note: the note list."""
    return found.where("differs").select("collation_id", "row_id", "note_no", "lemma", "note")


def stone_rows(rows: DataFrame, milestones: DataFrame) -> DataFrame:
    """collation_id, offset, tag, row_id, at: the row that each of milestones(collation_id, offset, tag) falls into, and where in it.

    rows: collation_id, row_id, base_start.  Rows and stones go by in one order of places, and a stone takes the last row that
    begins at its place or before; so what lies beyond the text's end is the last row's.
    """
    starts = rows.select("collation_id", F.col("base_start").alias("_at"), F.lit(0).alias("_kind"), "row_id", F.lit(None).cast("string").alias("tag"))
    stones = milestones.select("collation_id", F.col("offset").cast("int").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("row_id"), "tag")
    upto = Window.partitionBy("collation_id").orderBy("_at", "_kind", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("row_id", F.col("_at").alias("start"))), ignorenulls=True).over(upto)
    met = starts.unionByName(stones).withColumn("_row", last).where("_kind = 1 and _row is not null")
    return met.select("collation_id", F.col("_at").alias("offset"), "tag", "_row.row_id", (F.col("_at") - F.col("_row.start")).alias("at"))


def golden_puts(found: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """collation_id, row_id, base, puts: what stands in each row of the base text, in order, as an array of (at, kind, put).

    kind 0: a note's mark, put is its number; kind 1: a milestone, of milestones(collation_id, offset, tag).  A milestone
    belongs to the cell its offset falls into, what is left to the end; at a note's place it follows the mark.
    """
    rows = found.select("collation_id", "row_id", F.get("segs", F.lit(0)).alias("base"), "base_start", "note_no", F.coalesce("cut", F.length(F.get("segs", F.lit(0)))).alias("cut"))
    mark = F.when(F.col("note_no").isNotNull(), F.array(F.struct(F.col("cut").alias("at"), F.lit(0).alias("kind"), F.col("note_no").cast("string").alias("put")))).otherwise(F.expr("cast(array() as array<struct<at:int,kind:int,put:string>>)"))
    rows = rows.withColumn("puts", mark)
    if milestones is not None:
        held = stone_rows(rows, milestones).select("collation_id", "row_id", F.struct("at", F.lit(1).alias("kind"), "offset", F.col("tag").alias("put")).alias("stone"))
        held = held.groupBy("collation_id", "row_id").agg(F.array_sort(F.collect_list("stone")).alias("stones"))
        none = F.expr("cast(array() as array<struct<at:int,kind:int,offset:int,put:string>>)")
        rows = rows.join(held, ["collation_id", "row_id"], "left").withColumn("stones", F.coalesce("stones", none))
        # stones of one place keep their order; a mark goes before them
        placed = F.transform("stones", lambda x: F.struct(x["at"].cast("int").alias("at"), x["kind"].alias("kind"), x["put"].alias("put")))
        numbered = F.transform(F.concat("puts", placed), lambda x, i: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), i.alias("i"), x["put"].alias("put")))
        rows = rows.withColumn("puts", F.transform(F.array_sort(numbered), lambda x: F.struct(x["at"].alias("at"), x["kind"].alias("kind"), x["put"].alias("put"))))
    return rows.select("collation_id", "row_id", "base", "puts")


def golden_pieces(rows: DataFrame, text: Callable[[Column], Column], put: Callable[[Column, Column], Column]) -> DataFrame:
    """collation_id, row_id, piece of rows as golden_puts() gives them: text(stretch) and put(kind, put), in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    base = F.col("base")

    def step(s: Column, x: Column) -> Column:
        at = F.least(x["at"], F.length(base))
        return F.struct(F.concat(s["out"], text(F.substring(base, s["at"] + 1, at - s["at"])), put(x["kind"], x["put"])).alias("out"), at.alias("at"))

    piece = F.aggregate("puts", start, step, lambda s: F.concat(s["out"], text(F.substring(base, s["at"] + 1, F.length(base)))))
    return rows.select("collation_id", "row_id", piece.alias("piece"))


def golden_held(rows: DataFrame, o: Options) -> DataFrame:
    """As golden() of apparatus(), of held_rows() with a column stones: the milestones (offset, tag) of a collation in its first row."""
    rows = _shown(rows.withColumn("differs", _differs(rows, o)), o)
    base = F.get("segs", F.lit(0))
    # marks are numbered as they go by
    return streams.marked(rows.select("collation_id", "row_id", base.alias("base"), F.when(F.col("differs"), F.coalesce(_cut(o), F.length(base))).alias("cut"), "stones"))


def golden(found: DataFrame, milestones: DataFrame | None = None) -> DataFrame:
    """collation_id, golden: the base text with [^n] where notes stand, and milestones(collation_id, offset, tag) put back."""
    rows = golden_pieces(golden_puts(found, milestones), lambda t: t, lambda kind, put: F.when(kind == 0, F.concat(F.lit("[^"), put, F.lit("]"))).otherwise(put))
    texts = rows.groupBy("collation_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "piece"))).alias("r"))
    return texts.select("collation_id", F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("golden"))
