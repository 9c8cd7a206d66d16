"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a linear model; negatives are never labelled. The
risk of the negatives is what the unlabelled texts have beyond their positive share:

    risk = prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)])

With the logistic loss the unclipped risk is convex, so Newton steps find its minimum in a few
passes; where the second term falls below zero the non-negative risk counts, steps are halved
until it no longer rises, and the best weights seen are returned. The class prior is estimated
from how the scores of positives and of unlabelled texts are distributed.

Every pass is one Spark job over all learning rows that sums a fixed number of terms per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare, stored
from crawlspark.llm.quality_rules import COUNTS, count

PASSES = 8
RIDGE = 1e-2
BINS = 400
CLIP = 4.0
DECISION = 0.3

# byte classes: lower, upper, digit, blank, newline, sentence mark, other symbol, non-ASCII
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_SHARES = 64
WIDTH = _SHARES + 9


def features(text: str | None) -> np.ndarray:
    """Numbers that describe the form of a whole text, not its words; zeros for a null or empty text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[raw]
    out[:_SHARES] = np.sqrt(np.bincount(kind[:-1] * 8 + kind[1:], minlength=_SHARES) / max(1, len(raw) - 1))
    c = dict(zip(COUNTS, count(text)))
    words, lines = max(1, c["n_words"]), max(1, c["n_lines"])
    out[_SHARES:] = (
        np.log1p(c["n_words"]), np.log1p(c["word_chars"] / words), np.sqrt(c["n_symbols"] / words),
        c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_open_lines"] / lines,
        np.log(words / max(1, c["n_distinct"])), np.sqrt(c["n_top"] / words), np.log1p(c["n_words"] / lines))
    return out


def _summed(rows: DataFrame, terms, size: int) -> np.ndarray:
    """Sum over all rows of `terms(x, positive)`, a vector of `size` per batch: one job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)
                total += terms(x.astype(np.float64), batch.column(1).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "v"])

    out = np.zeros(size)
    summed = rows.select("x", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    for r in summed.collect():  # `size` numbers at most
        out[r.i] = r.v
    return out


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised, clipped, with a constant in front."""
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def _newton_terms(mean, scale, w):
    d = WIDTH + 1
    upper = np.triu_indices(d)

    def terms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = _scaled(x, mean, scale)
        g = z @ w
        p, u = positive == 1, positive == 0
        s = _sigmoid(g[u])
        soft = np.logaddexp(0, g)
        h = (z[u] * (s * (1 - s))[:, None]).T @ z[u]
        return np.concatenate([
            [p.sum(), u.sum(), g[p].sum(), soft[p].sum(), soft[u].sum()],
            z[p].sum(axis=0), (_sigmoid(g[p])[:, None] * z[p]).sum(axis=0), s @ z[u], h[upper]])

    return terms, 5 + 3 * d + len(upper[0])


def risk(prior: float, sums: np.ndarray) -> tuple[float, float]:
    """(non-negative risk, negative part before clipping) from the sums of one pass."""
    n_p, n_u, g_p, soft_p, soft_u = sums[:5]
    negative = soft_u / n_u - prior * soft_p / n_p
    return prior * (soft_p - g_p) / n_p + max(0.0, negative), negative


def minimise(rows: DataFrame, prior: float, mean, scale, w: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of the smallest non-negative risk found in at most `passes` passes."""
    d = WIDTH + 1
    best, best_risk, step = w, np.inf, None
    trial, size = w, 1.0
    for _ in range(passes):
        terms, length = _newton_terms(mean, scale, trial)
        sums = _summed(rows, terms, length)
        ridge = RIDGE / 2 * float(trial[1:] @ trial[1:])
        now, negative = risk(prior, sums)
        now += ridge
        if now > best_risk:  # too long a step: halve it
            size /= 2
            if size < 1 / 8:
                break
            trial = best - size * step
            continue
        done = best_risk - now < 1e-6 * max(1.0, abs(now))
        best, best_risk, size = trial, now, 1.0
        if done:
            break
        n_p, n_u = sums[0], sums[1]
        at_p, pulled_p, pulled_u = (sums[5 + k * d: 5 + (k + 1) * d] for k in range(3))
        grad = prior * (pulled_p - at_p) / n_p
        if negative > 0:
            grad = grad + pulled_u / n_u - prior * pulled_p / n_p
        hess = np.zeros((d, d))
        hess[np.triu_indices(d)] = sums[5 + 3 * d:] / n_u
        hess = hess + np.triu(hess, 1).T
        keep = np.r_[0.0, np.full(d - 1, RIDGE)]
        step = np.linalg.solve(hess + np.diag(keep + 1e-6), grad + keep * best)
        trial = best - step
    return best


def class_prior(rows: DataFrame, mean, scale, w: np.ndarray) -> float:
    """Share of positives among the unlabelled, from one pass over all scores.

    Where scores are highest nearly all texts are positive, so there the unlabelled are `prior`
    times as frequent as the positives. The smallest such ratio over the upper tails is taken, each
    with a margin for the size of its tail.
    """
    def terms(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((_sigmoid(_scaled(x, mean, scale) @ w) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at[positive == c], minlength=BINS) for c in (1, 0)]).astype(float)

    sums = _summed(rows, terms, 2 * BINS)
    p, u = np.cumsum(sums[:BINS][::-1]), np.cumsum(sums[BINS:][::-1])
    q_p, q_u = p / p[-1], u / u[-1]
    margin = np.sqrt(1 / p[-1]) + np.sqrt(1 / u[-1])
    ok = q_p > 0.05
    bound = (q_u[ok] + margin) / q_p[ok]
    return float(np.clip(q_u[ok][np.argmin(bound)] / q_p[ok][np.argmin(bound)], 0.01, 0.99))


class Model:
    def __init__(self, prior, mean, scale, weights):
        self.prior, self.mean, self.scale, self.weights = prior, mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_scaled(x.astype(np.float64), self.mean, self.scale) @ self.weights)


def fit(rows: DataFrame) -> Model | None:
    """rows: x, positive (1 trusted, 0 unlabelled, others unused). None without both kinds."""
    rows = rows.filter("positive in (0, 1)")

    def moments(x, positive):
        u = positive == 0
        return np.concatenate([[(positive == 1).sum(), u.sum()], x[u].sum(axis=0), (x[u] ** 2).sum(axis=0)])

    sums = _summed(rows, moments, 2 + 2 * WIDTH)
    if not sums[0] or not sums[1]:
        return None
    mean = sums[2: 2 + WIDTH] / sums[1]
    deviation = np.sqrt(np.maximum(sums[2 + WIDTH:] / sums[1] - mean ** 2, 0))
    scale = np.where(deviation > 1e-4, deviation, 1.0)
    # positives against unlabelled at an even prior ranks texts well enough to see the prior
    w = minimise(rows, 0.5, mean, scale, np.zeros(WIDTH + 1), passes=5)
    prior = class_prior(rows, mean, scale, w)
    return Model(prior, mean, scale, minimise(rows, prior, mean, scale, w))


def classify(docs: DataFrame, positives: DataFrame, learn: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """doc_id, score, prior of every document.

    docs: doc_id, text. positives, unlabelled: doc_id of trusted and of unlabelled documents; learn:
    doc_id that may be learned from. Other columns are not looked at. Repeated rows are each scored;
    null and empty texts get the score of their (zero) features; without positives or unlabelled
    rows every score is 0.5. A document with several label rows is positive if it is in `positives`.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    kinds = (
        learn.select("doc_id").distinct()
        .join(positives.select("doc_id", F.lit(1).alias("p")).distinct(), "doc_id", "left")
        .join(unlabelled.select("doc_id", F.lit(0).alias("u")).distinct(), "doc_id", "left")
        .select("doc_id", F.coalesce("p", "u").alias("positive")).filter("positive is not null"))
    rows = stored(
        docs.select("doc_id", described(F.col("text").cast("string")).alias("x"))
        .join(kinds, "doc_id", "left").select("doc_id", "x", F.coalesce("positive", F.lit(-1)).alias("positive")), "features")
    model = fit(rows)
    prior = float(model.prior) if model else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)
                score = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score), pa.array(np.full(len(x), prior))], names=["doc_id", "score", "prior"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double, prior double")
