"""Star alignment: every witness against witness 0 of its collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from palimpsest.functions.tokens import GENERIC, generic_norm, token_array
from palimpsest.operators import held
from palimpsest.operators.anchored import place_long, segments
from palimpsest.operators.cells import VOTED
from palimpsest.operators.diff import place
from palimpsest.operators.layout import layout, wide_rows
from palimpsest.operators.merge import merge_rows
from palimpsest.options import A_CHUNG, Options
from palimpsest.shipping import ship
from palimpsest.tables import small, written

#: Collations of so many characters, all witnesses together, are aligned and merged where they meet; larger ones by rows.
TOGETHER = 1 << 21


def token_arrays(witnesses: DataFrame, pattern: str = GENERIC, norm=generic_norm, vocabulary=None) -> DataFrame:
    """collation_id, witness_id, tokens, norms.

    norm is an expression over a token.  vocabulary (DataFrame(token) -> DataFrame(token, norm)), if given, is asked instead,
    once for each distinct token of all witnesses: for norms that are costly, or a join.
    """
    rows = witnesses.select("collation_id", F.col("witness_id").cast("int").alias("witness_id"), token_array(F.col("text"), pattern).alias("tokens"))
    if vocabulary is None:
        return rows.withColumn("norms", F.transform("tokens", norm))
    rows = written(rows, "tokens")
    each = rows.select("collation_id", "witness_id", F.posexplode("tokens").alias("pos", "token"))
    normed = each.join(vocabulary(each.select("token").distinct()), "token")
    norms = normed.groupBy("collation_id", "witness_id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("n"))
    joined = rows.join(norms, ["collation_id", "witness_id"], "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.select("collation_id", "witness_id", "tokens", F.coalesce(F.transform("n", lambda x: x["norm"]), none).alias("norms"))


def align(witnesses: DataFrame, pattern: str = GENERIC, norm=generic_norm, merged: bool = True, vocabulary=None, aligner=place, cleanup: str | None = None, together: int | None = None) -> DataFrame:
    """collation_id, row_id, cells (array over witnesses): merged rows, or with gaps as null if not merged.

    witnesses: collation_id, witness_id (0 is the base, without holes), text.  Any number of witnesses.  A collation
    without witness 0 has no rows; one whose texts are all empty has none either.  Each witness's cells, put together,
    are its text.
    vocabulary: see token_arrays().  aligner: from token arrays to placed cells, as operators.diff.place() does it
    (operators.anchored.place_long() for texts too long for one task).  cleanup: None, "semantic" or "efficiency", for
    scripts as operators.cleanup describes.
    Witnesses of equal text are aligned once: edit scripts, rows and the merge see the distinct texts of a collation.
    Texts of a collation of at most `together` (TOGETHER) characters meet in one row, and are not moved after that; a larger
    one's go by rows over many tasks, as all do with a vocabulary or another aligner.
    """
    ship(witnesses.sparkSession)
    # a tokenizer that is a function in Python goes over columns, not within arrays
    native = vocabulary is None and not callable(pattern)
    if native and aligner is place_long:
        rows = written(long_segments(witnesses, pattern, norm, merged, cleanup), "segments")
        before = F.sum(F.size("rows")).over(Window.partitionBy("collation_id").orderBy("segment")) - F.size("rows")
        rows = rows.join(rows.select("collation_id", "segment", before.cast("int").alias("before")), ["collation_id", "segment"])
        found = rows.select("collation_id", "before", F.posexplode("rows").alias("at", "cells"))
        return found.select("collation_id", (F.col("before") + F.col("at")).alias("row_id"), "cells")
    if not native or aligner is not place:
        return _by_rows(witnesses, pattern, norm, merged, vocabulary, aligner, cleanup)
    few, large = parted(witnesses, together)
    whole = _in_tasks(few, pattern, norm, merged, cleanup)
    return whole if large is None else whole.unionByName(_by_rows(large, pattern, norm, merged, vocabulary, aligner, cleanup))


def parted(witnesses: DataFrame, together: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Witnesses of collations that fit a task, and those of larger ones, if there are any.

    Where witnesses have a column chars, it says how long a text is at most, so that texts which cost are not made for this.
    """
    size = F.col("chars") if "chars" in witnesses.columns else F.length(F.coalesce("text", F.lit("")))
    sizes = witnesses.groupBy("collation_id").agg(F.sum(size.cast("long")).alias("size"))
    large = written(sizes.where(F.col("size") > (TOGETHER if together is None else together)).select("collation_id"), "large")
    if large.isEmpty():
        return witnesses, None
    return tuple(witnesses.join(small(large), "collation_id", how) for how in ("left_anti", "left_semi"))


def met(witnesses: DataFrame, pattern: str = GENERIC, norm=generic_norm, base: tuple[str, ...] = (), each: tuple[str, ...] = ()) -> DataFrame:
    """collation_id, of, tokens, words, norms: a row a collation that fits a task, with the tokens of its distinct texts, and which text each witness has.

    Texts meet by collation once, and what follows by collation moves nothing.  words, norms: the distinct tokens, which alone are
    normalised.  base: columns of witnesses, of which the base's values are kept; each: those of which all witnesses' are, as arrays.
    """
    ship(witnesses.sparkSession)
    one = F.struct(F.col("witness_id").cast("int").alias("w"), F.coalesce("text", F.lit("")).alias("text"), *base, *each)
    rows = witnesses.groupBy("collation_id").agg(F.array_sort(F.collect_list(one)).alias("w")).where(F.get("w", F.lit(0))["w"] == 0)
    kept = [*(F.col("w")[c].alias(c) for c in each), *(F.get("w", F.lit(0))[c].alias(c) for c in base)]
    rows = rows.withColumn("texts", F.array_distinct(F.transform("w", lambda x: x["text"])))
    of = F.transform("w", lambda x: (F.array_position(F.col("texts"), x["text"]) - 1).cast("int"))
    rows = rows.select("collation_id", of.alias("of"), *kept, F.transform("texts", lambda x: token_array(x, pattern)).alias("tokens"))
    return _worded(rows, norm)


def _worded(rows: DataFrame, norm) -> DataFrame:
    """rows(collation_id, of, tokens, others) with words, the distinct tokens, and their norms."""
    others = [c for c in rows.columns if c not in ("collation_id", "of", "tokens")]
    rows = rows.withColumn("words", F.array_distinct(F.flatten("tokens")))
    return rows.select("collation_id", "of", "tokens", "words", F.transform("words", norm).alias("norms"), *others)


def expanded(found: DataFrame, merged: bool = True, cleanup: str | None = None) -> DataFrame:
    """collation_id, row_id, cells by witness, in order, of met()."""
    rows = found.select("collation_id", "of", "tokens", "words", "norms")
    kind = T.StructType([found.schema["collation_id"], T.StructField("row_id", T.IntegerType()), T.StructField("cells", T.ArrayType(from_arrow_type(held.CELL)))])
    return rows.mapInArrow(held.aligned(merged, cleanup, kind.names), kind)


def voted(found: DataFrame) -> DataFrame:
    """collation_id, row_id, voted, differs, groups, in order, of met(): serialize.voted_rows() of its rows weighed by count."""
    rows = found.select("collation_id", "of", "tokens", "words", "norms")
    kind = T.StructType([found.schema["collation_id"], T.StructField("row_id", T.IntegerType()), *from_arrow_type(VOTED).fields])
    return rows.mapInArrow(held.voted(kind.names), kind)


def _in_tasks(witnesses: DataFrame, pattern, norm, merged: bool, cleanup: str | None) -> DataFrame:
    """align() of collations that fit a task: texts meet by collation once, and each becomes its rows there, in order."""
    return expanded(met(witnesses, pattern, norm), merged, cleanup)


def _by_rows(witnesses: DataFrame, pattern, norm, merged: bool, vocabulary, aligner, cleanup: str | None) -> DataFrame:
    """align() of collations of any size."""
    texts, members = distinct_texts(witnesses)
    placed = written(aligner(token_arrays(texts, pattern, norm, vocabulary), **({"cleanup": cleanup} if cleanup else {})), "cells")  # edit scripts are computed once; the layout reads their cells twice
    n = members.select("collation_id", (F.array_max("of") + 1).alias("n"))
    wide = wide_rows(layout(placed), n)
    rows = (merge_rows(wide) if merged else wide).join(members, "collation_id")
    return rows.select("collation_id", "row_id", F.transform("of", lambda d: F.get("cells", d)).alias("cells"))


def long_segments(witnesses: DataFrame, pattern: str = GENERIC, norm=generic_norm, merged: bool = True, cleanup: str | None = None) -> DataFrame:
    """collation_id, segment, rows (lists of cells by witness), in order: collations of any size, aligned as by place_long().

    Collations of a base and one other text at most are cut where they meet, and rows stay in their stretch; others, whose texts have
    no cuts in common, go by rows, and each row is a segment.
    """
    texts, members = distinct_texts(witnesses)
    two = F.array_max("of") < 2
    rows = texts.join(members.where(two), "collation_id").groupBy("collation_id").agg(F.array_sort(F.collect_list(F.struct("witness_id", "text"))).alias("w"), F.first("of").alias("of"))
    # the filter keeps all; without it the optimizer takes what follows for a part of the aggregation
    rows = rows.where(F.size("w") > 0).select("collation_id", "of", F.transform("w", lambda x: token_array(x["text"], pattern)).alias("tokens"))
    found = segments(_worded(rows, norm), merged, cleanup)
    if members.where(~two).isEmpty():
        return found
    large = witnesses.join(members.where(~two).select("collation_id"), "collation_id", "left_semi")
    rest = _by_rows(large, pattern, norm, merged, None, place_long, cleanup)
    return found.unionByName(rest.select("collation_id", F.col("row_id").alias("segment"), F.array("cells").alias("rows")))


def distinct_texts(witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of each collation as witnesses, in order of their first one, and collation_id, of: which text each witness has.

    Collations without witness 0 are left out.
    """
    groups = witnesses.groupBy("collation_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.array_sort(F.collect_list(F.col("witness_id").cast("int"))).alias("ids"))
    groups = written(groups.withColumn("first", F.get("ids", F.lit(0))), "texts")
    # numbered over short rows; the texts join their numbers by hash
    rank = (F.row_number().over(Window.partitionBy("collation_id").orderBy("first")) - 1).cast("int")
    numbers = groups.select("collation_id", "first", "ids").withColumn("d", rank)
    each = F.flatten(F.collect_list(F.transform("ids", lambda w: F.struct(w.alias("w"), F.col("d").alias("d")))))
    members = numbers.groupBy("collation_id").agg(F.array_sort(each).alias("of"), F.min("first").alias("base")).where("base = 0")
    members = written(members.select("collation_id", F.transform("of", lambda x: x["d"]).alias("of")), "members")
    texts = groups.select("collation_id", "first", "text").join(numbers.select("collation_id", "first", "d"), ["collation_id", "first"])
    return texts.select("collation_id", F.col("d").alias("witness_id"), "text"), members


def witness_segments(wide: DataFrame) -> DataFrame:
    """collation_id, witness_id, segs: each witness's cell texts in row order, gaps null."""
    cells = wide.select("collation_id", "row_id", F.posexplode("cells").alias("witness_id", "c"))
    rows = cells.groupBy("collation_id", "witness_id").agg(F.array_sort(F.collect_list(F.struct("row_id", F.col("c.text").alias("text")))).alias("r"))
    return rows.select("collation_id", "witness_id", F.transform("r", lambda x: x["text"]).alias("segs"))


def reattach_achung(segs: Column, o: Options) -> Column:
    """An array of cells in which a lone a-chung at a cell's end moves to the next cell that is not empty.

    Lone: a separator, a shad or nothing stands before it.  What the cells make together stays as it is.
    """
    chung = "[" + A_CHUNG + "]"
    before = "".join("\\" + c if c in "/|\\-[]^" else c for c in o.separators + o.shads)
    lone = f"(?s)^(|.*[{before}])({chung}+)\\z"
    # left to right: `held` waits for the next cell that is not empty; `at` is where it came from
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("held"), F.lit(-1).alias("at"))

    def step(s: Column, cell: Column) -> Column:
        empty = F.coalesce(cell, F.lit("")) == ""
        whole = F.concat(s["held"], cell)
        moves = whole.rlike(lone)
        rest = F.when(moves, F.regexp_extract(whole, lone, 1)).otherwise(whole)
        run = F.when(moves, F.regexp_extract(whole, lone, 2)).otherwise("")
        return F.when(empty, F.struct(F.concat(s["done"], F.array(cell)).alias("done"), s["held"].alias("held"), s["at"].alias("at"))).otherwise(
            F.struct(F.concat(s["done"], F.array(rest)).alias("done"), run.alias("held"), F.size(s["done"]).alias("at"))
        )

    # what found no further cell goes back to where it was
    moved = F.aggregate(segs, start, step, lambda s: F.transform(s["done"], lambda x, i: F.when((s["held"] != "") & (i == s["at"]), F.concat(x, s["held"])).otherwise(x)))
    # the scan copies what it has done, so texts without an a-chung at a cell's end are left alone
    return F.when(F.exists(segs, lambda c: F.coalesce(c, F.lit("")).rlike(f"{chung}\\z")), moved).otherwise(segs)
