"""Secret scan: spans of credentials, told apart by how many owners hold them.  DataFrame functions only.

Base kinds (fixed patterns) are found in every text.  Two further kinds are candidates only: provider keys and
mixed-case high-entropy tokens.  Every value's SHA-256 is counted over the whole corpus by distinct repository and
owner; a candidate is added as a span if a single owner holds it, in however many repositories (live-looking), while a
value that several owners hold is an example that has been copied.  Base spans stay either way.

Values are hashed where they are found: no table that is written holds one.  Spans are rows as soon as they are found,
so a text of many costs no more a span than one of few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, named, numbered, row_key

# The base kinds, in order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of capitals and digits of 20 or more: its first AKIA leaves the longest rest
HEX = r"[0-9a-f]{24,}"
# Candidate kinds of the method.
PROVIDER = r"(?:gh[pousr]_|sk_live_|rk_live_|xox[abprs]-|glpat-|hf_|npm_)[A-Za-z0-9_-]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{24,}"

KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("provider", PROVIDER), ("mixed", MIXED)]
BASE = 3
SALTS = 16
_RUN = 256


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once; an expression inside a lambda would be worked out at each of its calls."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _upto(sizes: Column) -> Column:
    """Running sums of an array of int (a computed value), each without its own: in runs of _RUN, so that nothing grows with the square."""
    none = F.expr("cast(array() as array<int>)")

    def scan(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("sums"))
        return F.aggregate(x, first, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))["sums"]

    def joined(runs: Column) -> Column:
        return F.flatten(F.zip_with(runs, scan(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda x, y: x + y)), F.lit(0)), scan))

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / _RUN).cast("int") - 1), lambda i: F.slice(sizes, i * _RUN + 1, F.lit(_RUN)))
    return F.when(F.size(sizes) <= _RUN, scan(sizes, F.lit(0))).otherwise(_let(runs, joined))


def _found(text: Column, kind: int, name: str, pattern: str) -> Column:
    """Array of (start, kind, end, name, sha256) of the pattern's matches in code points; the failing ones are dropped.

    Matches are never empty, so the text is gap, match, gap, match, ..., gap: positions are sums of their lengths.
    """
    fits = {"assign": lambda x: F.length(x) >= 6, "mixed": lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")}.get(name, lambda x: F.lit(True))

    def row(hit: Column, at: Column) -> Column:
        value = F.regexp_extract(hit, pattern, 2) if name == "assign" else hit
        return F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(hit)).alias("end"), F.lit(name).alias("name"), F.when(fits(value), F.sha2(value, 256)).alias("sha256"))

    def rows(v: Column) -> Column:
        gap = F.slice(v["gap"], 1, F.size(v["hits"]))
        sums = _let(F.zip_with(gap, v["hits"], lambda g, m: g + F.length(m)), _upto)
        return F.zip_with(v["hits"], F.zip_with(sums, gap, lambda s, g: s + g), row)

    pieces = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), F.filter(_let(pieces, rows), lambda x: x["sha256"].isNotNull())).otherwise(F.expr(f"cast(array() as {_SPANS})"))


_SPANS = "array<struct<start:int,kind:int,end:int,name:string,sha256:string>>"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _meets(kinds: Column, row: str) -> Column:
    """Does the span overlap another of those kinds in its text?  Over rows of spans."""
    # both frames grow with the row, the second in the order from the end: a frame that shrinks would be summed up anew for each row
    rows = Window.partitionBy(row).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(kinds, F.col("end"))).over(rows.orderBy("start"))
    after = F.min(F.when(kinds, F.col("start"))).over(rows.orderBy(F.col("start").desc()))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, base array, added array, n_live long, n_copied long.

    base and added hold (start, kind, end, name, sha256 of the value), by start and kind.  n_live counts a row's spans,
    candidates included, whose value one owner alone holds, n_copied those that more owners hold: each is one or the other.
    repository: the column that names it, for ownership(); without one, each document is its own.
    Null text: as empty, no spans.  Null owner or repository: one owner or repository of that name.  Repeated rows:
    one result each; they count once as a repository.  Other columns, of any name, are left out.  No rows: none.
    """
    return _told(*_counted(docs, doc_id, text, owner, repository))


def ownership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """sha256, owners, repositories (long): how many distinct ones hold each value, base kinds and candidates alike."""
    return _counted(docs, doc_id, text, owner, repository)[2]


def _counted(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without a span, spans, and how many owners and repositories hold each value."""
    docs, row = numbered(docs)
    repo = named(repository) if repository else named(doc_id)
    body = F.coalesce(named(text), F.lit(""))
    found = [_found(F.col("body"), k, name, pattern) for k, (name, pattern) in enumerate(KINDS)]
    scanned = docs.select(named(doc_id).alias("doc_id"), named(row).alias("row"), row_key(named(owner)).alias("owner"), row_key(repo).alias("repo"), body.alias("body"))
    scanned = materialize(scanned.select("doc_id", "row", "owner", "repo", F.concat(*found).alias("spans")), "secrets")
    spans = scanned.where(F.size("spans") > 0).select("doc_id", "row", "owner", "repo", F.inline("spans"))
    spans = spans.withColumn("meets", _meets(F.col("kind") < BASE, "row")).where((F.col("kind") < BASE) | ~F.col("meets"))
    spans = spans.withColumn("meets", _meets(F.col("kind") == BASE, "row")).where((F.col("kind") <= BASE) | ~F.col("meets")).drop("meets")
    spans = materialize(spans, "spans")
    # one row per value, owner and repository before any count, so a value that a third of the corpus holds is spread out
    each = spans.select("sha256", "owner", "repo").distinct().groupBy("sha256", "owner").agg(F.count(F.lit(1)).alias("repos"))
    known = materialize(each.groupBy("sha256").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories")), "ownership")
    return scanned.where(F.size("spans") == 0), spans, known


def _told(without: DataFrame, spans: DataFrame, known: DataFrame) -> DataFrame:
    # the verdicts return by salted value, so that a hot value's spans are dealt to many tasks
    salted = known.select("sha256", "owners").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["sha256", "salt"])
    span = F.struct("start", "kind", "end", "name", "sha256")
    base, live = F.col("kind") < BASE, F.col("owners") == 1
    told = asked.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(F.when(~base & live, span))).alias("added"),
        F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_copied"))
    none = F.expr(f"cast(array() as {_SPANS})")
    rest = without.select("doc_id", none.alias("base"), none.alias("added"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return told.select("doc_id", "base", "added", "n_live", "n_copied").unionByName(rest)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what scan_secrets() returns."""

    def of_kind(name: str) -> Column:
        return F.size(F.filter("base", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")

    count = [of_kind(name) for name, _ in KINDS[:BASE]]
    return found.select(
        "doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_live", "n_copied")
