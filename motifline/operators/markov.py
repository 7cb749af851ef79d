"""Full-order Markov models of a pattern's automaton, learned by counting moves."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifline.operators.recognize import label
from motifline.plans.compiled import CompiledPattern


def transition_counts(df: DataFrame, c: CompiledPattern, chunks: int = 0) -> DataFrame:
    """(before, state, n, prob): moves over all partitions; the first move of a partition starts in the start state."""
    counts = label(df, c, chunks).groupBy("before", "state").agg(F.count("*").alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


@dataclass
class MarkovChain:
    """Transition probabilities between all states; rows of states that were never left are zero."""

    matrix: np.ndarray
    finals: frozenset
    start: int = 0

    @property
    def non_finals(self) -> list[int]:
        return [s for s in range(len(self.matrix)) if s not in self.finals]

    def check(self, tolerance: float = 0.05) -> list[int]:
        """Rows that neither sum to one nor are zero."""
        sums = self.matrix.sum(axis=1)
        return np.flatnonzero((sums != 0) & (np.abs(sums - 1) > tolerance)).tolist()

    def blocks(self):
        """The matrix with non-final states before final ones, as N, N→F, F→N, F→F."""
        n, f = self.non_finals, sorted(self.finals)
        m = self.matrix
        return m[np.ix_(n, n)], m[np.ix_(n, f)], m[np.ix_(f, n)], m[np.ix_(f, f)]

    def to_json(self) -> str:
        return json.dumps({"version": 1, "matrix": self.matrix.tolist(), "finals": sorted(self.finals), "start": self.start})

    @staticmethod
    def from_json(text: str) -> MarkovChain:
        d = json.loads(text)
        return MarkovChain(np.array(d["matrix"], float), frozenset(d["finals"]), d["start"])


def learn_markov(df: DataFrame, c: CompiledPattern, chunks: int = 0) -> MarkovChain:
    """Maximum likelihood. Only one count for each pair of states comes to the driver."""
    m = np.zeros((c.dfa.n, c.dfa.n))
    for r in transition_counts(df, c, chunks).collect():
        m[r["before"], r["state"]] = r["n"]
    sums = m.sum(axis=1, keepdims=True)
    return MarkovChain(np.divide(m, sums, out=np.zeros_like(m), where=sums > 0), c.dfa.finals, c.dfa.start)


def chain_of(c: CompiledPattern, probability) -> MarkovChain:
    """A chain from known symbol probabilities: a sequence of one for each symbol, or for a disambiguated automaton a
    function of a state's past (a tuple of symbols, latest last) that gives such a sequence."""
    dfa = c.dfa
    m = np.zeros((dfa.n, dfa.n))
    for s in range(dfa.n):
        p = probability(dfa.history[s] if dfa.history else ()) if callable(probability) else probability
        for k, t in enumerate(dfa.table[s].tolist()):
            m[s, t] += p[k]
    return MarkovChain(m, dfa.finals, dfa.start)


def ranking_score(chain: MarkovChain, counts: np.ndarray, method: str = "modified") -> float:
    """Mean rank of the states that were in fact moved to, among those the chain holds likely; lower is better.

    ``standard``: ties share the best rank; ``modified``: the worst.
    """
    total = weighted = 0.0
    for s, row in enumerate(counts):
        p = chain.matrix[s]
        for t in np.flatnonzero(row):
            rank = int((p > p[t]).sum()) + 1 if method == "standard" else int((p >= p[t]).sum())
            total, weighted = total + row[t], weighted + row[t] * rank
    return weighted / total if total else 0.0


def best_order(df: DataFrame, c: CompiledPattern, most: int = 2, folds: int = 10, method: str = "modified") -> tuple[int, list[float]]:
    """The order whose chains, trained on all but one block of the stream in turn, rank that block's moves best."""
    total = df.count()
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts", "id"))) if total < 1_000_000 else _numbered(df)
    scores = []
    for order in range(most + 1):
        own, each = c.with_order(order), []
        for k in range(folds):
            lo, hi = total * k // folds, total * (k + 1) // folds
            inside = (F.col("_row") > lo) & (F.col("_row") <= hi)
            chain = learn_markov(numbered.where(~inside).drop("_row"), own)
            counts = np.zeros((own.dfa.n, own.dfa.n))
            for r in transition_counts(numbered.where(inside).drop("_row"), own).collect():
                counts[r["before"], r["state"]] = r["n"]
            each.append(ranking_score(chain, counts, method))
        scores.append(sum(each) / len(each))
    return int(np.argmin(scores)), scores


def _numbered(df: DataFrame) -> DataFrame:
    """Row numbers in stream order without sorting in one task: ranks within ranges of time plus the ranges' sizes."""
    bounds = sorted(set(df.approxQuantile("ts", [k / 64 for k in range(1, 64)], 0.001)))
    chunk = F.lit(0)
    for b in bounds:
        chunk = chunk + (F.col("ts") >= F.lit(b)).cast("int")
    df = df.withColumn("_chunk", chunk)
    sizes = {r["_chunk"]: r["n"] for r in df.groupBy("_chunk").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_chunk"))
    return df.withColumn("_row", offset + F.row_number().over(Window.partitionBy("_chunk").orderBy("ts", "id"))).drop("_chunk")
