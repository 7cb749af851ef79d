"""Hidden Markov models of a pattern: automaton states hidden behind symbols, fitted on labelled streams by counting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class HiddenMarkov:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    def filter(self, symbols) -> np.ndarray:
        """Belief over states after a sequence of symbols."""
        belief = self.start.copy()
        for k, s in enumerate(symbols):
            belief = (belief if k == 0 else belief @ self.moves) * self.emits[:, s]
            belief = belief / belief.sum() if belief.sum() else np.full(len(belief), 1 / len(belief))
        return belief

    def waiting(self, symbols, finals, horizon: int) -> np.ndarray:
        """Waiting times for a first final state given the observations."""
        belief, ends, out = self.filter(symbols), sorted(finals), np.zeros(horizon)
        for k in range(horizon):
            belief = belief @ self.moves
            out[k] = belief[ends].sum()
            belief = belief.copy()
            belief[ends] = 0
        return out


def fit(labels: DataFrame, n_states: int, n_symbols: int, smooth: float = 1e-6) -> HiddenMarkov:
    """Relative frequencies; states squared plus states times symbols counts come to the driver."""
    start, moves, emits = np.full(n_states, smooth), np.full((n_states, n_states), smooth), np.full((n_states, n_symbols), smooth)
    for r in labels.groupBy("state", "symbol").agg(F.count("*").alias("n")).collect():
        emits[r["state"], r["symbol"]] += r["n"]
    nxt = F.lead("state").over(Window.partitionBy("part").orderBy("counter"))
    for r in labels.select("state", nxt.alias("next")).where("next IS NOT NULL").groupBy("state", "next").agg(F.count("*").alias("n")).collect():
        moves[r["state"], r["next"]] += r["n"]
    for r in labels.where("counter = 1").groupBy("state").agg(F.count("*").alias("n")).collect():
        start[r["state"]] += r["n"]
    return HiddenMarkov(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
