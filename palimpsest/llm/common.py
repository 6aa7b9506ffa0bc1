"""Helpers that several corpus operators share: scratch tables, row keys, components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.tables import discard, scratch_path  # noqa: F401
from palimpsest.tables import written as materialize

#: A word, wherever a contract speaks of words (fixed pattern).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores put before it, whichever df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """df, to be broadcast if the files of this table of materialize() hold at most limit / 4 bytes.

    Decoded rows of numbers and short texts take about four times what their compressed files do.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if 4 * size <= limit else df


def numbered(docs: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """docs with a column that tells any two rows apart, equal ones too, and its name, which no other column has.

    The column is the hash of the row's file and its number there, which every scan of the same files finds again; rows
    that come from no file are written first.
    """
    name = fresh(docs, name)

    def placed(df: DataFrame) -> DataFrame:
        # asked for as metadata, it is the file's even where a column has the same name
        at = df.metadataColumn("_metadata")
        return df.select("*", F.struct(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("i")).alias(name))

    try:
        return placed(docs), name
    except AnalysisException:
        return placed(materialize(docs, "rows")), name


def prefix_sums(sums: DataFrame, block: str, value: str, by: str | None = None) -> DataFrame:
    """sums, a row for each block (and by), with before: the sum of value over earlier blocks.

    Blocks are added up in runs of 1024, then the runs, so that no task sorts all blocks.
    """
    own = [by] if by else []
    sums = sums.withColumn("_run", F.shiftright(block, 10))
    runs = sums.groupBy(*own, "_run").agg(F.sum(value).alias("_words"))
    earlier = Window.partitionBy(*own).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"_{c}") for c in own), F.col("_run").alias("_at"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_early"))
    within = Window.partitionBy(*own, "_run").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col("_run") == F.col("_at"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own)]
    sums = sums.join(runs, same)
    return sums.withColumn("before", F.col("before") + F.col("_early")).drop("_run", "_at", "_early", *(f"_{c}" for c in own))


def row_key(*cols: str | Column) -> Column:
    """A 128-bit key of the values, nulls told apart from texts; equal rows get equal keys."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), F.coalesce(c.cast("string"), F.lit(""))]
    return F.concat_ws(":", F.hex(F.xxhash64(F.lit(1), *parts)), F.hex(F.xxhash64(F.lit(2), *parts)))


def remainder(doc_id: str | Column, by: int = 4) -> Column:
    """crc32 of the id as text, modulo by (null where the id is null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % by


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Least node of each component.  edges(a long, b long) -> (node, component), nodes with an edge only.

    Each round hooks every root to its least neighbour, halves the pointer chains until they are flat, and
    contracts the edges to roots.  The roots of a component at least halve in a round, so there are as many
    rounds as the logarithm of the largest component; nothing but counts reaches the driver.  Where components are left
    after max_rounds, an error is raised.  Nodes are unsigned where the caller maps them so; order here is that of long.
    """
    live = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    whole = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        up = live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        hooks = materialize(up.unionByName(live.select(F.col("b").alias("node"), F.col("b").alias("parent"))).groupBy("node").agg(F.min("parent").alias("parent")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            # a star's hub is the parent of all its nodes: its one row goes to where they are
            far = hooks.where("node <> parent").join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
            flat = materialize(far.unionByName(hooks.where("node = parent").withColumn("moved", F.lit(False))), "flat")
            discard(hooks)
            hooks, still = flat, flat.where("moved").isEmpty()
            if still:
                break
        flat = hooks.select("node", "parent")
        if whole is None:
            whole = materialize(flat, "whole")
        else:
            step = flat.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            last, whole = whole, materialize(whole.join(step, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")), "whole")
            discard(last)
        to = flat.withColumnRenamed("node", "a").withColumnRenamed("parent", "ra")
        tb = flat.withColumnRenamed("node", "b").withColumnRenamed("parent", "rb")
        last, live = live, materialize(live.join(to, "a").join(tb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        discard(last, hooks)
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
    discard(live)
    if whole is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return whole.select("node", F.col("parent").alias("component"))
