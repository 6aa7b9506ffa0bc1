"""Tokens: patterns that tile a text, as arrays or as a table with offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.preprocess import moved
from palimpsest.shipping import ship

# A word with the blanks after it, or what is between words.
GENERIC = r"(?U)\w+\s*|\W+"
TIBETAN = r"(?U)\w+[\s་༌࿒]*|\W+"
AT_ONCE = 128


def token_array(text: Column, pattern: str | Callable[[Column], Column] = GENERIC) -> Column:
    """All tokens in order; together they are the text.

    pattern: a regular expression whose matches tile any text, or a function from a text to its tokens, such as
    longest_match() gives; both are to lose nothing of the text.
    """
    whole = F.coalesce(text, F.lit(""))
    return pattern(whole) if callable(pattern) else F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))


class Trie:
    """A set of words, by their characters, for the longest that a text has at a place."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            if word:
                node[""] = True

    def tokens(self, text: str, after: str = "") -> list[str]:
        """The text cut into the longest words of the set, each with the characters of `after` that follow it; what is between them are tokens too."""
        out: list[str] = []
        at = start = 0
        size = len(text)
        while at < size:
            node, i, end = self.root, at, -1
            while i < size and (node := node.get(text[i])) is not None:
                i += 1
                if "" in node:
                    end = i
            if end < 0:
                at += 1
                continue
            if start < at:
                out.append(text[start:at])
            while end < size and text[end] in after:
                end += 1
            out.append(text[at:end])
            at = start = end
        if start < size:
            out.append(text[start:])
        return out


def longest_match(words: Iterable[str], after: str = " \t\n་༌࿒") -> Callable[[Column], Column]:
    """A tokenizer for token_array(), tokens() and align(): the longest of the words at each place, in Arrow batches.

    The words go to the executors with the function, so they are a list of a bounded size (syllables, say), not a corpus's.
    """
    held = Trie(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: held.tokens(text or "", after))

    return cut


def generic_norm(token: Column) -> Column:
    """Lower case, without the blanks at the end."""
    return F.regexp_replace(F.lower(token), r"(?U)\s+$", "")


def _placed(mapped: bool):
    """Starts and ends of the tokens beside them, as running sums of their lengths; moved by the row's maps if it has such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at once: numbers of a batch's tokens take many times what its texts do
        for batch in (x.slice(at, AT_ONCE) for x in batches for at in range(0, x.num_rows, AT_ONCE)):
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.utf8_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.r_[0, np.cumsum(counts)]
            upto = np.r_[0, np.cumsum(sizes)]
            ends = upto[1:] - np.repeat(upto[first[:-1]], counts)
            starts = ends - sizes
            if mapped:
                maps = batch.column(batch.num_columns - 2)
                for i in range(batch.num_rows):
                    own = [] if maps[i].as_py() is None else [(m.values.field(0).to_numpy(), m.values.field(1).to_numpy()) for m in maps[i].values]
                    span = slice(first[i], first[i + 1])
                    starts[span], ends[span] = moved(starts[span], own), moved(ends[span], own)
            columns = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "starts", "ends"])

    return run


def placed_tokens(witnesses: DataFrame, pattern: str = GENERIC, keep: tuple[str, ...] = ("collation_id", "witness_id"), text: str = "text", maps: str | None = None) -> DataFrame:
    """The columns to keep, tokens, starts, ends: a row a text, with arrays over its tokens, as tokens() has them."""
    ship(witnesses.sparkSession)
    rows = witnesses.select(*keep, *([maps] if maps else []), token_array(F.col(text), pattern).alias("tokens"))
    added = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
    return rows.mapInArrow(_placed(maps is not None), T.StructType([*rows.schema.fields, *added])).select(*keep, "tokens", "starts", "ends")


def tokens(witnesses: DataFrame, pattern: str = GENERIC, norm=generic_norm, keys: tuple[str, ...] = ("collation_id", "witness_id"), text: str = "text", maps: str | None = None) -> DataFrame:
    """keys, pos, start, end, incr, token, norm: a row a token, offsets in code points.

    A token whose norm is empty has increment 0.  Offsets are running sums, since the tokens tile the text.
    maps: the column of offset maps that preprocess.filter_chain() gives; start and end are then those before the filters,
    found by binary search in the maps.  pattern: as token_array() takes it.
    """
    rows = placed_tokens(witnesses, pattern, keys, text, maps).select(*keys, F.posexplode(F.arrays_zip("tokens", "starts", "ends")).alias("pos", "x"))
    rows = rows.select(*keys, "pos", F.col("x.tokens").alias("token"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end")).withColumn("norm", norm(F.col("token")))
    return rows.select(*keys, "pos", "start", "end", F.when(F.col("norm") == "", 0).otherwise(1).alias("incr"), "token", "norm")


def normalized_vocabulary(token_table: DataFrame, normalize) -> DataFrame:
    """token, norm: normalize (DataFrame(token) -> DataFrame(token, norm)) sees each distinct token once."""
    return normalize(token_table.select("token").distinct())


def encode(token_table: DataFrame, key: str = "collation_id", first: int = 1) -> DataFrame:
    """key, norm, code: dense codes from `first`, in order of norms; the empty norm has code 0."""
    vocabulary = token_table.select(key, "norm").distinct().where("norm <> ''")
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("norm"))
    return vocabulary.select(key, "norm", (rank + (first - 1)).alias("code"))


def decode(codes: DataFrame, vocabulary: DataFrame, key: str = "collation_id") -> DataFrame:
    """codes(key, code, any others) with norm, as encode() numbered it; code 0 is the empty norm, an unknown code has null."""
    known = vocabulary.select(F.col(key).alias("_key"), F.col("code").alias("_code"), "norm")
    found = codes.join(known, (F.col(key) == F.col("_key")) & (F.col("code") == F.col("_code")), "left").drop("_key", "_code")
    return found.withColumn("norm", F.when(F.col("code") == 0, "").otherwise(F.col("norm")))
