"""Serialised votes: plain text, csv entries, markdown and inline notes.

weighted, everywhere, is long cells with weights or the rows of operators.weigh.weigh_rows(); rows that are dealt by collation
already are not dealt again.  ordered, everywhere, is as operators.ordered says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import cells
from palimpsest.operators.ordered import joined, numbered, running
from palimpsest.operators.weigh import vote, weighed_cells
from palimpsest.shipping import ship


def plain_text(weighted: DataFrame, ordered: bool = False) -> DataFrame:
    """collation_id, voted_text."""
    return joined(vote(weighted), {"voted_text": F.col("voted")}, ordered)


def csv_entries(weighted: DataFrame) -> DataFrame:
    """collation_id, row_id, witness_id, entry: text_weight_, in brackets for the winner; a gap weighs 0."""
    ship(weighted.sparkSession)
    rows = weighed_cells(weighted).withColumn("top", cells.best("cells")["top"])

    def entry(c: Column) -> Column:
        body = F.concat(F.coalesce(c["text"], F.lit("")), F.lit("_"), F.coalesce(c["weight"], F.lit(0)).cast("string"), F.lit("_"))
        return F.when(c["witness_id"] == F.col("top"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)

    return rows.select("collation_id", "row_id", F.inline_outer(F.transform("cells", lambda c: F.struct(c["witness_id"].alias("witness_id"), entry(c).alias("entry"))))).where("witness_id is not null")


def csv_lines(weighted: DataFrame) -> DataFrame:
    """collation_id, row_id, line: a csv line a row, fields quoted where they need it."""
    quoted = F.when(F.col("entry").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace("entry", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("entry"))
    rows = csv_entries(weighted).groupBy("collation_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("witness_id", quoted.alias("q")))).alias("r"))
    return rows.select("collation_id", "row_id", F.array_join(F.transform("r", lambda x: x["q"]), ",").alias("line"))


def voted_rows(weighted: DataFrame, versions: DataFrame | None = None, codes: dict[str, str] | None = None) -> DataFrame:
    """collation_id, row_id, voted, differs, groups: readings in order of first witness, with the codes that have each.

    codes: version name -> code, of the versions to serialise (versions: collation_id, witness_id, name); without any,
    all witnesses, as V1, V2, ...
    """
    ship(weighted.sparkSession)
    rows = weighed_cells(weighted)
    if codes:
        table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
        known = versions.select("collation_id", F.struct(F.col("witness_id").cast("int"), F.try_element_at(table, F.col("name"))).alias("c")).groupBy("collation_id").agg(F.map_from_entries(F.collect_list("c")).alias("codes"))
        rows = rows.join(known, "collation_id", "left")
        own = F.transform("cells", lambda c: F.try_element_at("codes", c["witness_id"].cast("int")))
        found = cells.voted_by("cells", own)
    else:
        found = cells.voted("cells")
    return rows.select("collation_id", "row_id", found.alias("v")).select("collation_id", "row_id", "v.*")


def _note(rows: DataFrame) -> DataFrame:
    parts = F.transform("groups", lambda g: F.concat(F.array_join(g["codes"], ","), F.lit(": "), g["reading"], F.lit(";")))
    return rows.select("collation_id", "row_id", "voted", "differs", F.when(F.col("differs"), F.concat("voted", F.lit("]"), F.array_join(parts, " "))).alias("note"))


def md_notes(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """collation_id, row_id, n, note: one for each differing row, agreeing versions included."""
    noted = _note(rows.where("differs")).select("collation_id", "row_id", "note")
    return running(noted, {"n": F.lit(1)}, ordered).select("collation_id", "row_id", "n", "note")


def markdown(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """collation_id, md: the voted text with note marks, a blank line, the notes."""
    def where(text: str | Column) -> Column:
        return F.when(F.col("differs"), text)

    body = F.concat("voted", F.coalesce(where("[^"), F.lit("")))
    line = F.coalesce(where("[^"), F.lit(""))
    texts = numbered(_note(rows), F.col("differs"), {"b": (body, where("]")), "l": (line, where(F.concat(F.lit("]: "), "note", F.lit("\n"))))}, ordered)
    return texts.select("collation_id", F.concat("b", F.lit("\n\n"), "l").alias("md"))


def single_syllable(text: Column) -> Column:
    """Is there one part between tshegs?"""
    return F.size(F.filter(F.split(text, "་", -1), lambda x: x != "")) == 1


def _inline_note() -> Column:
    others = F.filter("groups", lambda g: g["reading"] != F.col("voted"))
    return F.when(F.col("differs") & (F.size(others) > 0), F.concat(F.lit("<"), F.array_join(F.transform(others, lambda g: F.concat(F.array_join(g["codes"], ""), g["reading"])), ""), F.lit(">")))


def hfml_notes(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """rows with note (<CODEreading...>, without readings equal to the vote; null if none is left) and its number n."""
    noted = running(rows.withColumn("note", _inline_note()), {"n": F.col("note").isNotNull().cast("int")}, ordered)
    return noted.withColumn("n", F.when(F.col("note").isNotNull(), F.col("n")))


def hfml(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """collation_id, hfml: the voted text with numbered inline notes; a reading of more syllables than one begins with a colon."""
    noted = rows.select("collation_id", "row_id", "voted", _inline_note().alias("note"))
    there = F.col("note").isNotNull()
    piece = F.when(there, F.concat(F.when(single_syllable(F.col("voted")), "").otherwise(":"), "voted", F.lit("("))).otherwise(F.col("voted"))
    return numbered(noted, there, {"hfml": (piece, F.concat(F.lit(") "), "note"))}, ordered)
