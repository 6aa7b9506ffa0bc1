"""Quality classifier: a sparse rule ensemble.

Small boosted trees over text statistics give conjunctive rules (one per tree path); lasso logistic regression over the
rules leaves few of them with weights; the sum of weighted rules is compiled into one Spark column expression, so
scoring is a projection over native statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import named, remainder

BLANKS = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Two projections: counts first, ratios over them next."""
    return {
        "_chars": F.length(text).cast("double"),
        "_words": F.filter(F.split(text, BLANKS), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
        "_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "_upper": F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "")),
        "_digits": F.length(text) - F.length(F.translate(text, "0123456789", "")),
        "_bangs": F.length(text) - F.length(F.translate(text, "!?", "")),
        "_stops": F.length(text) - F.length(F.translate(text, ".,;:", "")),
        "_links": F.length(text) - F.length(F.translate(text, "/@=_{}[]\\~^", "")),
    }


def ratios() -> dict[str, Column]:
    c = F.col
    n, chars = F.greatest(F.size("_words"), F.lit(1)), F.greatest(c("_chars"), F.lit(1.0))
    following = F.zip_with(F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), lambda a, b: F.when(a == b, 1).otherwise(0))
    return {
        "log_words": F.log1p(F.size("_words").cast("double")),
        "word_length": c("_chars") / n,
        "distinct_words": F.size(F.array_distinct("_words")) / n,
        "repeats": F.aggregate(following, F.lit(0), lambda x, y: x + y) / n,
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "line_words": F.size("_words") / F.greatest(F.size("_lines"), F.lit(1)),
        "symbols": c("_symbols") / n,
        "upper": c("_upper") / chars,
        "digits": c("_digits") / chars,
        "bangs": c("_bangs") / n,
        "stops": c("_stops") / n,
        "links": c("_links") / chars,
    }


FEATURES = (
    "log_words", "word_length", "distinct_words", "repeats", "distinct_lines", "line_words",
    "symbols", "upper", "digits", "bangs", "stops", "links")


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(any columns but those named here) with the feature columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(statistics(body)).withColumns(ratios())


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold)


@dataclass(frozen=True)
class Ensemble:
    """intercept and (rule, weight): the log-odds of label 1."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Over the feature columns: 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for feature, above, at in rule:
                test = F.col(FEATURES[feature]) > at if above else F.col(FEATURES[feature]) <= at
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, features: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Paths to every node of a regression tree on gradients, and its output."""
    rules: list[Rule] = []
    out = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows], hess[rows]
        if path:
            rules.append(path)
        best = (1e-6, None)
        if len(path) < depth:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f in features:
                b = bins[rows, f]
                k = len(cuts[f])
                n, gs, hs = (np.cumsum(np.bincount(b, w, k + 1))[:k] for w in (None, g, h))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(n < least) | (len(rows) - n < least)] = -1
                if k and gain.max() > best[0]:
                    best = (gain.max(), (int(f), int(gain.argmax())))
        if best[1] is None:
            out[rows] = g.sum() / (h.sum() + 1)
            return
        f, k = best[1]
        low = bins[rows, f] <= k
        grow(rows[low], (*path, (f, False, float(cuts[f][k]))))
        grow(rows[~low], (*path, (f, True, float(cuts[f][k]))))

    grow(np.arange(len(grad)), ())
    return rules, out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, above, at in rule:
        on &= x[:, f] > at if above else x[:, f] <= at
    return on


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> Ensemble:
    """x: rows x FEATURES; y: 0 or 1.  One class only, no row, or rows that no rule tells apart: a constant (the share of 1, smoothed)."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Ensemble(base, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64), method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    log_odds, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-log_odds))
        features = np.sort(rng.choice(x.shape[1], size=max(4, x.shape[1] // 2), replace=False))
        paths, step = _tree(bins, cuts, y - p, p * (1 - p), depth, max(5, len(y) // 500), features)
        log_odds += 0.5 * step
        rules |= dict.fromkeys(paths)
    columns, kept, seen = [], [], set()
    for rule in rules:
        on = holds(rule, x)
        if 0 < on.mean() < 1 and (print_ := on.tobytes()) not in seen:
            seen.add(print_)
            columns.append(on)
            kept.append(rule)
    if not kept:
        return Ensemble(base, ())
    a = np.stack(columns, 1).astype(np.float32)
    mean = a.mean(0)
    scale = np.sqrt(mean * (1 - mean)) + 0.05
    z = (a - mean) / scale
    # accelerated proximal gradient; the step is the inverse of the loss's curvature
    v = rng.normal(size=z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(z @ v) ** 2) / len(y) + 0.25)
    w, b, mw, mb, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(z @ mw + mb)))
        gw, gb = z.T @ (p - y) / len(y), float((p - y).mean())
        new = mw - rate * gw
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, nt = mb - rate * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return Ensemble(float(b - (w * mean / scale).sum()), tuple((r, float(c / s)) for r, c, s in zip(kept, w, scale, strict=True) if abs(c) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Ensemble:
    """Fit on at most max_rows labelled documents, those whose ids have the least hashes.  Null labels and ids are left out."""
    known = labels.select(named(doc_id).alias("_id"), named(label).alias("_y")).where("_id is not null and _y is not null")
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(named(doc_id).alias("_id"), named(text).alias("_text")).join(F.broadcast(chosen), "_id")
    # rows of one id beyond max_rows in all would come from repeated documents; they are cut by the same order
    data = with_features(rows, "_text").select("_id", "_y", *FEATURES).orderBy(F.xxhash64("_id"), "_id", "_y", *FEATURES).limit(max_rows).toPandas()
    return fit(data[list(FEATURES)].to_numpy(float), data["_y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name` double (0 to 1, higher: label 1 likelier), which replaces one of that name.

    Null text scores as empty; null ids and repeated rows: a row each; all columns, of any name, stay.  No rows: none.
    """
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != name]
    held = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("_row"), named(text).alias("_text"))
    return with_features(held, "_text").select(*columns, model.score().alias(name))


def held_out_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Learn from labels whose id's crc32 is not 2 modulo 4, score all documents."""
    model = train(docs, labels.where(remainder("doc_id") != 2))
    found = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
