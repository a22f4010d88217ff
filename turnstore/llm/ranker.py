"""Quality classifier by Bradley-Terry pairwise ranking (operator 1).

A document's strength is a linear function of measures of its whole text. That a good document is preferred to a bad
one has the probability sigmoid(difference of their strengths); the weights are learned by logistic loss on the
feature differences of such pairs. The threshold is the quantile of the strengths of the learned-from documents at
the share of bad ones among them, and strengths are moved so that it lies at THRESHOLD.

Measures are SQL functions; the driver sees the measures of at most SAMPLE labelled documents, a few numbers each.

Defined cases: null and empty texts have measures of zero and get a score as any other; without a good and a bad
labelled document every score is 0.5; of contradictory labels of one document the worse counts; repeated rows
get equal scores; an empty table gives an empty result; the input's other columns stay, but columns called score or
predicted are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import SPACE_CLASS, every, held_out, share_of, text_or_empty, unused

#: Most labelled documents that the ranking is learned from, and most preference pairs.
SAMPLE, PAIRS = 20_000, 100_000
#: Score of the quantile that parts the classes.
THRESHOLD = 0.3
RIDGE = 1e-3


def features(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with the array of measures of each whole text, none of which grows with its length without bound, and that column's name."""
    own = every(docs)
    text = text_or_empty(F.col(text_col))
    words = F.array_remove(F.split(F.lower(text), f"[{SPACE_CLASS}]+"), "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    parts = {
        "n": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "letters": count(r"\p{L}"),
        "upper": count(r"\p{Lu}"),
        "marks": count("[#*$%&|<>]"),
        "loud": count("!"),
        "digits": count("[0-9]"),
        "stops": count("[.,;:?]"),
    }
    *names, out = unused(docs, *parts, "x")
    n, distinct, letters, upper, marks, loud, digits, stops = map(F.col, names)
    stale = per(n - distinct, n)
    rates = [
        per(marks, n), F.least(per(marks, n) * 5, F.lit(1.0)), per(upper, letters), (per(upper, letters) > 0.5).cast("double"),
        F.least(per(loud, n), F.lit(2.0)), per(digits, n), F.least(per(stops, n), F.lit(2.0)),
        stale, F.pow(stale, F.lit(4)), F.log1p(n) / 10, stale * F.log1p(n) / 10, per(letters, n) / 10,
    ]
    counted = docs.withColumns(dict(zip(names, parts.values())))
    return counted.select(*own, F.array(*(r.cast("double") for r in rates)).alias(out)), out


def learn(x: np.ndarray, good: np.ndarray, seed: int = 7) -> dict:
    """Weights, scale and threshold from measures and labels."""
    if not (good.any() and (~good).any()):
        return {"mean": np.zeros(x.shape[1] if x.ndim == 2 else 0), "weights": np.zeros(x.shape[1] if x.ndim == 2 else 0), "shift": 0.0}
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    n = min(PAIRS, int(good.sum()) * int((~good).sum()))
    d = z[rng.choice(np.flatnonzero(good), n)] - z[rng.choice(np.flatnonzero(~good), n)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method; the pairs' outcome is always 1
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / n + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    strengths = np.sort(z @ w)
    k = min(max(int((~good).sum()), 1), len(strengths) - 1)
    cut = (strengths[k - 1] + strengths[k]) / 2
    return {"mean": mean, "weights": w / scale, "shift": math.log(THRESHOLD / (1 - THRESHOLD)) - cut}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Learn from labelled rows outside the held-out fold, the SAMPLE of least hash if there are more."""
    known = labels.where("quality is not null").groupBy(F.col(id_col).alias("known")).agg(F.min("quality").alias("good"))
    known = known.where(~held_out(F.col("known")))
    chosen = known.where(share_of(F.xxhash64("known", F.lit("share")), SAMPLE, known.count())).orderBy(F.xxhash64("known"), "known").limit(SAMPLE)
    # bounded: SAMPLE ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("known"))
    rows, x = features(texts)
    rows = rows.select("id", F.col(x).alias("x"), "good").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    return learn(np.array([r["x"] for r in rows]), np.array([r["good"] > 0 for r in rows], bool))


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on)."""
    df, x = features(docs, text_col)
    strength = F.lit(float(model["shift"]))
    for k, (m, w) in enumerate(zip(model["mean"].tolist(), model["weights"].tolist())):
        strength = strength + (F.col(x)[k] - m) * w
    df = df.withColumn("score", 1 / (1 + F.exp(-strength)))
    return df.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(x)
