"""The two whole pipelines: an apparatus of notes, and a voted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import preprocess, tibetan
from palimpsest.functions.tokens import GENERIC, TIBETAN, generic_norm
from palimpsest.operators import apparatus as app
from palimpsest.operators.align import align, expanded, met, parted, voted
from palimpsest.operators.annotations import confidence_layer, confidence_min
from palimpsest.operators.layout import long_rows
from palimpsest.operators.ordered import in_order
from palimpsest.operators.serialize import voted_rows
from palimpsest.operators.weigh import Weigher, count_weight, weigh, weigh_rows
from palimpsest.options import Options
from palimpsest.tables import written


def prepare(witnesses: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Witnesses with cleaned texts, and the milestones of their bases (collation_id, offset, tag)."""
    text = preprocess.strip_tags(F.col("text")) if o.strip_tags else F.col("text")
    stones = witnesses.where("witness_id = 0").select("collation_id", F.inline(preprocess.milestones(F.col("text"))))
    if not (o.strip_tags and o.keep_milestones):
        stones = stones.limit(0)
    return witnesses.withColumn("text", text), stones


def _readings(witnesses: DataFrame, o: Options, together: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of collations that fit a task, in order, with the stones of each in its first row, and those of larger ones."""
    cleaned, _ = prepare(witnesses, o)
    none = F.expr("cast(array() as array<struct<offset:int,tag:string>>)")
    stones = preprocess.milestones(F.col("text")) if o.strip_tags and o.keep_milestones else none
    siglum = app.siglum(witnesses)
    few, large = parted(witnesses.withColumns({"stones": F.when(F.col("witness_id") == 0, stones), "labels": siglum, "text": preprocess.strip_tags(F.col("text")) if o.strip_tags else F.col("text")}), together)
    found = app.held_rows(met(few, GENERIC, generic_norm, base=("stones",), each=("labels",)), o)
    if large is None:
        return found, None
    return found, app.reading_rows(align(cleaned.join(large.select("collation_id").distinct(), "collation_id", "left_semi"), GENERIC, generic_norm), o)


def apparatus(witnesses: DataFrame, o: Options = Options(), together: int | None = None) -> DataFrame:  # noqa: B008
    """Every row of every collation with its note, as operators.apparatus.apparatus() describes."""
    rows, large = _readings(witnesses, o, together)
    found = app.apparatus(rows.drop("stones"), None, o, ordered=True)
    return found if large is None else found.unionByName(app.apparatus(large, app.labels(witnesses), o))


def note_list(witnesses: DataFrame, o: Options = Options(), together: int | None = None) -> DataFrame:  # noqa: B008
    """The notes of apparatus()."""
    rows, large = _readings(witnesses, o, together)
    found = app.note_list(rows, None, o, ordered=True)
    return found if large is None else found.unionByName(app.note_list(large, app.labels(witnesses), o))


def golden_text(witnesses: DataFrame, o: Options = Options(), together: int | None = None) -> DataFrame:  # noqa: B008
    rows, large = _readings(witnesses, o, together)
    texts = app.golden_held(rows, o)
    return texts if large is None else texts.unionByName(app.golden(app.apparatus(large, app.labels(witnesses), o), prepare(witnesses, o)[1]))


def tibetan_norm(token):
    return tibetan.pre_diff(tibetan.always(token))


def common_spelling(
    witnesses: DataFrame, patterns: list[tuple[str, str]] = (), weighers: list[Weigher] | None = None, bo: bool = True,
    substitutions: DataFrame | None = None, keep_eol: bool = True, old: bool = False, semantic: bool = True,
) -> DataFrame:
    """Weighted cells of the merged matrix: filter chain, tokens, alignment, weights (by count, unless others are given).

    start and end are those in the text before the filters.  bo: Tibetan tokens, normalised once a distinct token, with
    the user's substitutions (form, lemma), and as keep_eol, old (spellings) and semantic (affixes, substitutions) say.
    """
    filtered = preprocess.filter_chain(witnesses, "text", list(patterns), out="_filtered", maps="_maps")
    texts = filtered.select("collation_id", "witness_id", F.col("_filtered").alias("text"))
    wide = align(texts, TIBETAN, vocabulary=lambda v: tibetan.normalize_vocabulary(v, substitutions, keep_eol, old, semantic)) if bo else align(texts)
    cells = long_rows(wide)
    if patterns:
        maps = filtered.select("collation_id", F.col("witness_id").cast("int").alias("witness_id"), "_maps")
        cells = preprocess.corrected_rows(cells, maps, ("start", "end"), ("collation_id", "witness_id"), "_maps")
    return weigh(cells, weighers or [Weigher(count_weight())])


def spelling_rows(witnesses: DataFrame, together: int | None = None) -> DataFrame:
    """The matrix of common_spelling(bo=False) without patterns, weighed by count, as rows of operators.weigh.weigh_rows() in order."""
    few, large = parted(witnesses, together)
    wide = expanded(met(few))
    return weigh_rows(wide if large is None else wide.unionByName(in_order(align(large, together=0))))


def spelling_votes(witnesses: DataFrame, together: int | None = None) -> DataFrame:
    """serialize.voted_rows() of spelling_rows(), in order; collations that fit a task are voted where their rows are told."""
    few, large = parted(witnesses, together)
    found = voted(met(few))
    return found if large is None else found.unionByName(voted_rows(weigh_rows(in_order(align(large, together=0)))))


def collate_texts(spark: SparkSession, texts: dict[str, str], pattern: str = GENERIC, norm=generic_norm) -> DataFrame:
    """Aligned rows of a few texts by name, a column each, before the merge (gaps null); the first text is the base."""
    names = list(texts)
    frame = spark.createDataFrame([(0, i, texts[n]) for i, n in enumerate(names)], "collation_id long, witness_id int, text string")
    wide = align(frame, pattern, norm, merged=False)
    return wide.select("row_id", *(F.get("cells", F.lit(i))["text"].alias(n) for i, n in enumerate(names))).orderBy("row_id")


def merge_scans(witnesses: DataFrame, confidences: DataFrame, pattern: str = TIBETAN, norm=tibetan_norm) -> tuple[DataFrame, DataFrame]:
    """Base texts and annotation layers voted from scans of one text.

    confidences: collation_id, witness_id, start, confidence (0 to 1), of spans of each witness's text.  A reading weighs
    by count, scaled by the least confidence of its span; the voted text keeps that confidence.
    """
    cells = written(long_rows(align(witnesses, pattern, norm)), "scan-cells")
    known = confidence_min(cells, confidences)
    weighted = weigh(known, [Weigher(count_weight()), Weigher(F.col("confidence"), relative=True)])
    best = F.max(F.struct(F.coalesce("weight", F.lit(0)).alias("w"), (-F.col("witness_id")).alias("n"), F.coalesce("text", F.lit("")).alias("t"), F.col("confidence").alias("c"))).alias("b")
    voted = weighted.groupBy("collation_id", "row_id").agg(best)
    return confidence_layer(voted.select("collation_id", "row_id", F.col("b.t").alias("voted"), F.col("b.c").alias("confidence"), F.lit(None).cast("string").alias("page")))
