"""A quality classifier learned from trusted positives and unlabelled text with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import in_small_batches, map_batches

THRESHOLD = 0.3
#: Shares and means of a text, and places for its hashed runs of three bytes.
SHAPES, HASHED = 20, 256
FEATURES = SHAPES + HASHED
#: Rows that are learned from, at most.
POSITIVES, UNLABELLED = 4_000, 12_000


def features(text: str | None) -> np.ndarray:
    """How a text is written, and the root shares of its runs of three bytes by their hashes; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES, np.float32)
    if raw:
        out[:SHAPES] = _shape(raw)
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        runs = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(24)
        out[SHAPES:] = np.sqrt(np.bincount(runs, minlength=HASHED) / max(1, len(runs)))
    return out


def _shape(raw: bytes) -> tuple[float, ...]:
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    at = lambda chars: sum(int(counts[ord(c)]) for c in chars)
    n, w = len(raw), max(1, len(words))
    distinct = len(set(words))
    triples = set(zip(words, words[1:], words[2:]))
    return (
        1.0,
        np.log1p(n),
        np.sqrt(counts[65:91].sum() / max(1, letters)),
        np.sqrt(at("!?") / n),
        np.sqrt(at("*$#%&@^~+=") / n),
        np.sqrt(at("|<>{}[]\\/_") / n),
        np.sqrt(at("0123456789") / n),
        np.sqrt(at(".,;:") / n),
        np.sqrt(at("'\"-()") / n),
        np.sqrt(letters / n),
        np.sqrt(counts[:32].sum() / n),
        np.log1p(n / w),
        distinct / w,
        len(triples) / max(1, w - 2),
        np.log1p(len(words)) * (1 - distinct / w),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(w / max(1, len(lines))),
        sum(not x.isascii() for x in words) / w,
        sum(len(x) == 1 for x in words) / w,
        sum(x.isupper() and len(x) > 1 for x in words) / w,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk of outputs on positives and on unlabelled rows, with the logistic loss.

    The non-negative risk is the first plus the second, or plus 0 where that is below 0.
    """
    loss = lambda z: float(np.logaddexp(0, z).mean())  # noqa: E731  of the label -1
    return prior * loss(-positive), loss(unlabelled) - prior * loss(positive)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the outputs of a classifier of the two that saw neither.

    Above any threshold the unlabelled rows hold at least the prior times the positives' part; where no
    negatives are left, the ratio of both parts comes down to the prior. The least upper bound of that ratio
    over thresholds is taken, with one standard deviation each way for the rows' numbers.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = np.array([(positive >= t).mean() for t in cuts])
    u = np.array([(unlabelled >= t).mean() for t in cuts])
    slack = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(((u + slack) / np.maximum(p, 1e-9)).min(), 0.01, 0.99))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """estimated_prior() with a classifier of positives against unlabelled rows, learned on one half and read on the other, both ways."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        model = fit(positive[half::2], unlabelled[half::2], 0.5, steps=300, unbiased=False)
        z = lambda x: np.log(predict(model, x) / (1 - predict(model, x)))
        found.append(estimated_prior(z(positive[1 - half :: 2]), z(unlabelled[1 - half :: 2])))
    return sum(found) / 2


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-3, unbiased: bool = True) -> Model:
    """Minimise the non-negative unbiased risk of a logistic model by gradient steps.

    With class prior p and the logistic loss, the risk is p E+[loss(g, 1)] + max(0, Eu[loss(g, -1)] - p E+[loss(g, -1)]).
    When the second part falls below zero the step goes up its gradient, as the non-negative estimator has it.
    Without `unbiased` unlabelled rows count as negative. Without positives or unlabelled rows the model scores
    every text by the prior.
    """
    prior = float(min(max(prior, 0.01), 0.99))
    n = FEATURES
    if not len(positive) or not len(unlabelled):
        w = np.zeros(n + 1)
        w[-1] = np.log(prior / (1 - prior))
        return Model(np.zeros(n), np.ones(n), w, prior)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-9] = 1.0
    one = lambda x: np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = one(positive), one(unlabelled)
    w = np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        wrong = prior * -(p.T @ (1 - sigmoid(gp))) / len(p)
        rest = u.T @ sigmoid(gu) / len(u) - unbiased * prior * (p.T @ sigmoid(gp)) / len(p)
        grad = (wrong + rest if not unbiased or risk(gp, gu, prior)[1] >= 0 else -rest) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples (by a hash of id and text): trusted positives, and documents at large, their labels unread.

    Positives are drawn from the label table by id, at most `positives` of them; the unlabelled rows from all
    documents that may be learned from. The class prior is estimated from these two. Texts are scanned once for
    both and not shuffled; the driver gets feature rows only.
    """
    place = lambda *c: F.pmod(F.xxhash64(F.lit(5), *c), F.lit(1 << 30)) / F.lit(float(1 << 30))
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(place("doc_id"), "doc_id").limit(positives)
    rows = docs.where(learn).select("doc_id", "text")
    share = 1.1 * unlabelled / max(1, rows.count())
    # At most `positives` ids.
    marked = rows.join(F.broadcast(trusted.withColumn("_good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"), place("doc_id", "text").alias("place"))
    some = marked.where(F.col("good") | (F.col("place") < share)).select("text", "good", "place", (F.col("place") < share).alias("web"))

    def each(batches: Iterator[list[list]]) -> Iterator[list]:
        for texts, good, at, web in batches:
            yield [good, web, at, [features(t).tobytes() for t in texts]]

    found = map_batches(some, ["text", "good", "place", "web"], each, "good boolean, web boolean, place double, x binary")
    # A repeated id can stand for many rows; the bounds hold for rows.
    top = lambda c, most: [r["x"] for r in found.where(c).orderBy("place", "x").limit(most).collect()]
    p, u = (np.array([np.frombuffer(x, np.float32) for x in top(c, most)], np.float64).reshape(-1, FEATURES) for c, most in (("good", positives), ("web", unlabelled)))
    return fit(p, u, prior_of(p, u))


def _scores(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, np.array([features(t) for t in texts], np.float64).reshape(-1, FEATURES)))

    return score


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The given columns, score (0 to 1) and predicted (1 if the score reaches the threshold) for every whole text.

    Null and empty texts get the score of an empty text; repeated rows and null ids are rows like others, an empty
    table gives no rows. Columns named score or predicted are replaced.
    """
    found = in_small_batches(docs).withColumn("score", _scores(model)("text"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; columns as given, whatever their names."""
    return in_small_batches(docs).where(_scores(model)("text") >= threshold)
