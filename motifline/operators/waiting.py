"""Waiting-time distributions: the probability that a pattern's next match ends k events from now, and forecasts from it."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.operators.markov import MarkovChain

METHODS = ("classify-nextk", "classify-win", "argmax", "smart-scan", "full-scan", "fixed-spread")
CLASSIFICATION = ("classify-nextk", "classify-win")


@dataclass(frozen=True)
class Forecast:
    """The match will end within [start, end] events from now. ``positive`` is of use in classification only."""

    start: int = -1
    end: int = -1
    middle: float = -1.0
    prob: float = -1.0
    positive: bool = True

    @property
    def valid(self) -> bool:
        return self.start >= 0


def full_order(chain: MarkovChain, horizon: int, finals: bool = False) -> dict[int, np.ndarray]:
    """For each state p[k - 1] = P(first final state after k events). States without moves have zeros.

    From a non-final state ξ N^(k-1) (I - N) 1; from a final one, if asked for, the first event may lead back to a
    final state, and from then on it is the same.
    """
    n, _, back, stay = chain.blocks()
    leave = 1 - n.sum(axis=1)
    names, ends = chain.non_finals, sorted(chain.finals)
    out = {s: np.zeros(horizon) for s in (*names, *(ends if finals else ()))}
    now = leave
    steps = []
    for _ in range(horizon):
        steps.append(now)
        now = n @ now
    steps = np.maximum(np.array(steps), 0)
    for k, s in enumerate(names):
        if chain.matrix[s].any():
            out[s] = steps[:, k].copy()
    if finals:
        for k, s in enumerate(ends):
            if chain.matrix[s].any():
                out[s] = np.maximum(np.r_[stay[k].sum(), steps[: horizon - 1] @ back[k]], 0)
    return out


def expected(p: np.ndarray) -> float:
    return float((np.arange(1, len(p) + 1) * p).sum()) if p.any() else -1.0


def middle(p: np.ndarray, a: int, b: int) -> float:
    """Expectation given that the match falls in [a, b]."""
    if a <= 0:
        return 0.0
    part, k = p[a - 1 : b], np.arange(a, b + 1)
    return float((k * part).sum() / part.sum()) if part.sum() > 0 else (a + b) / 2


def forecast_of(p: np.ndarray, method: str, threshold: float, spread: int, center: int = 1) -> Forecast:
    """A forecast from one distribution; an invalid one if no interval meets the demands."""
    horizon = len(p)
    if not 0 <= threshold <= 1 or not 0 <= spread <= horizon:
        raise ValueError("expected 0 <= threshold <= 1 and 0 <= spread <= horizon")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if not p.any():
        return Forecast()
    if method == "classify-nextk":
        prob = float(p[:spread].sum())
        return Forecast(1, spread, middle(p, 1, spread), prob, prob >= threshold)
    if method == "classify-win":
        a, b = max(1, center - spread // 2), center + spread // 2
        prob = float(p[a - 1 : b].sum())
        return Forecast(a, b, middle(p, a, min(b, horizon)), prob, prob >= threshold)
    if method == "argmax":
        a = b = int(np.argmax(p)) + 1
        prob = float(p[a - 1])
        top = a
        while prob < threshold and (a > 1 or b < horizon):
            if a > 1:
                a -= 1
                prob += float(p[a - 1])
            if b < horizon:
                b += 1
                prob += float(p[b - 1])
        return Forecast(a, b, float(top), prob) if b - a <= spread else Forecast()
    if method == "fixed-spread":
        if spread >= horizon:
            raise ValueError("fixed-spread needs a spread below the horizon")
        sums = np.convolve(p, np.ones(spread + 1), "valid")
        k = int(np.argmax(sums))
        return Forecast(k + 1, k + 1 + spread, middle(p, k + 1, k + 1 + spread), float(sums[k])) if sums[k] > threshold else Forecast()
    if method == "full-scan":
        total = np.r_[0.0, np.cumsum(p)]
        for width in range(1, horizon + 1):
            sums = total[width:] - total[:-width]
            k = int(np.argmax(sums))
            if sums[k] >= threshold and sums[k] > 0:
                return Forecast(k + 1, k + width, middle(p, k + 1, k + width), float(sums[k])) if width - 1 <= spread else Forecast()
        return Forecast()
    # smart-scan: two pointers; of the shortest intervals that reach the threshold the likeliest
    best, prob, a, b, inside = (1, horizon), 0.0, 1, 0, 0.0
    while True:
        while inside < threshold and b < horizon or b < a:
            b += 1
            if b > horizon:
                break
            inside += float(p[b - 1])
        if b > horizon or inside < threshold:
            break
        while a < b and inside - float(p[a - 1]) >= threshold:
            inside -= float(p[a - 1])
            a += 1
        width = best[1] - best[0]
        if b - a < width or b - a == width and inside > prob:
            best, prob = (a, b), inside
        if b == horizon:
            break
        inside -= float(p[a - 1])
        a += 1
    return Forecast(*best, middle(p, *best), prob) if best[1] - best[0] <= spread else Forecast()


def table(distributions: dict, method: str = "smart-scan", threshold: float = 0.5, spread: int = 200, centers: dict | None = None) -> dict:
    """A forecast for each state."""
    return {s: forecast_of(p, method, threshold, spread, max(1, (centers or {}).get(s) or 1)) for s, p in distributions.items()}


def next_table(chain: MarkovChain, threshold: float = 0.5) -> dict:
    """Will the very next event end a match?"""
    ends = sorted(chain.finals)
    probs = {s: float(chain.matrix[s, ends].sum()) for s in range(len(chain.matrix))}
    return {s: Forecast(1, 1, 1.0, p, p >= threshold) for s, p in probs.items()}


def random_table(states, horizon: int, seed: int = 0) -> dict:
    """Random intervals up to the horizon: a baseline."""
    rng, out = random.Random(seed), {}
    for s in states:
        a = rng.randint(1, horizon)
        b = rng.randint(a, horizon)
        out[s] = Forecast(a, b, (a + b) / 2, rng.random(), rng.random() < 0.5)
    return out


def gaussian(mean: float, deviation: float, horizon: int) -> np.ndarray:
    """Whole numbers of events with a normal distribution's probability around each."""
    if deviation <= 0:
        out = np.zeros(horizon)
        k = round(mean)
        if 1 <= k <= horizon:
            out[k - 1] = 1.0
        return out
    cdf = lambda x: 0.5 * (1 + math.erf((x - mean) / (deviation * math.sqrt(2))))
    return np.array([cdf(k + 0.5) - cdf(k - 0.5) for k in range(1, horizon + 1)])


def remaining_times(labels: DataFrame) -> DataFrame:
    """(state, mean, deviation): events from each state to the next detection in its partition."""
    from pyspark.sql import Window

    later = Window.partitionBy("part").orderBy(F.desc("counter")).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.last(F.when(F.col("detected"), F.col("counter")), ignorenulls=True).over(later) - F.col("counter")
    return labels.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("state").agg(F.avg("gap").alias("mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("deviation"), F.count("*").alias("n"))


def mean_based(times: DataFrame, horizon: int) -> dict[int, np.ndarray]:
    """Gaussian waiting times; one row for each state comes to the driver."""
    return {r["state"]: gaussian(r["mean"], r["deviation"], horizon) for r in times.collect()}
