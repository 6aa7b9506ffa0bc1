"""Multilingual mixture inference: EM over n-gram likelihoods, language set by penalised likelihood.

A document is a mixture of languages, each a smoothed distribution over hashed letter trigrams.  EM estimates the
proportions; languages are added to the set while the likelihood gains more than a penalty per language (BIC).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import named, numbered, remainder
from palimpsest.shipping import ship

BUCKETS = 1 << 15
CHUNK = 1 << 16
SLICES = 50


@cache
def _alphabet() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's trigrams around a letter, all else being one blank, and their counts; CHUNK characters at a time."""
    low = f" {(text or '').lower()} "
    if len(low) <= CHUNK + 2:
        return np.unique(_buckets(low), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(low) - 2, CHUNK):
        total += np.bincount(_buckets(low[at : at + CHUNK + 2]), minlength=BUCKETS)
    return np.flatnonzero(total), total[total > 0]


def _buckets(low: str) -> np.ndarray:
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _alphabet()[points]
    points[~letter] = 32
    x = (points[:-2] * 0x9E3779B1 ^ points[1:-1] * 0x85EBCA77 ^ points[2:] * 0xC2B2AE3D)[letter[1:-1]]
    x = (x ^ x >> 17) * 0x27D4EB2F
    return (x >> 15) % BUCKETS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bucket, n = trigrams(text)
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += n
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at])], ["lang", "bucket", "n"])


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_a_language: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages, and likelihoods as buckets x languages.

    Learned from at most rows_a_language rows of each language: of SLICES slices of the ids' hash, the rows of least hash
    in each.  The limit holds before the shuffle too, whatever ids repeat, and a language's slices are dealt to many tasks.
    """
    ship(docs.sparkSession)
    docs, row = numbered(docs)
    labelled = docs.where(named(lang).isNotNull() & named(text).isNotNull() & named(doc_id).isNotNull())
    ids = labelled.select(named(row).alias("row"), named(doc_id).alias("id"), named(lang).alias("lang")).withColumn("h", F.xxhash64("id"))
    first = Window.partitionBy("lang", F.pmod("h", F.lit(SLICES))).orderBy("h", "id", "row")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(1, rows_a_language // SLICES)).select("row")
    chosen = labelled.select(named(row).alias("row"), named(lang).alias("lang"), named(text).alias("text")).join(F.broadcast(ids), "row", "left_semi")
    rows = chosen.select("lang", "text").mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        counts[rows["bucket"].to_numpy(), np.searchsorted(np.array(langs), np.array(rows["lang"].to_pylist()))] = rows["n"].to_numpy()
    counts += 0.1
    return langs, counts / counts.sum(0, keepdims=True)


def proportions(like: np.ndarray, counts: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """EM: mixture weights of the columns, and the log-likelihood."""
    k = like.shape[1]
    weights = np.full(k, 1 / k)
    total = counts.sum()
    if k > 1:
        for _ in range(rounds):
            weights = weights * (like.T @ (counts / (like @ weights))) / total
            weights /= weights.sum()
    return weights, float(counts @ np.log(like @ weights))


def mixture(like: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The language set of least penalised likelihood, reached by adding languages in order of their share, with shares."""
    everywhere, _ = proportions(like, counts)
    order = np.argsort(-everywhere, kind="stable")
    single = counts @ np.log(like)
    chosen = [int(single.argmax())]
    share, best = np.ones(1), float(single.max())
    penalty = 0.5 * np.log(max(2.0, counts.sum())) + 2.0
    for new in order:
        if everywhere[new] < 0.02:
            break
        if new in chosen:
            continue
        weights, value = proportions(like[:, [*chosen, new]], counts)
        if value - best <= penalty:
            break
        chosen, share, best = [*chosen, int(new)], weights, value
    return dict(zip(chosen, map(float, share), strict=True))


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, likelihood = model.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            told, scores, mixed = [], [], []
            for text in batch.column(1).to_pylist():
                bucket, counts = trigrams(text) if text and langs else (np.zeros(0, int), np.zeros(0, int))
                if not len(bucket):
                    told.append("und")
                    scores.append(0.0)
                    mixed.append([])
                    continue
                found = mixture(likelihood[bucket], counts.astype(float))
                top = max(found, key=lambda x: (found[x], -x))
                told.append(langs[top])
                scores.append(min(1.0, max(0.0, found[top])))
                mixed.append([{"lang": langs[x], "share": y} for x, y in sorted(found.items(), key=lambda p: -p[1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, kind)], ["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred string, score double (its share), mixture array of (lang, share).

    Only the text is read.  Null text, a text without a letter, or a model of no language: und, score 0, no mixture.
    Null ids and repeated rows: a row each.  Other columns, of any name, are left out.  No rows: none.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(_predicted(held), schema)


def held_out_query(docs: DataFrame, rows_a_language: int = 500) -> DataFrame:
    """Learn from documents whose id's crc32 is not 2 modulo 4, predict all."""
    model = learn(docs.where(remainder("doc_id") != 2), rows_a_language=rows_a_language)
    found = identify(docs, model)
    held = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("mixture").cast("long").alias("n_languages"))
