"""Variable-order Markov models: counted contexts, prediction suffix trees, suffix automata, and their products with a pattern.

Contexts are tuples of symbols, the most recent first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifline.operators.markov import MarkovChain
from motifline.operators.recognize import label
from motifline.plans.automaton import Dfa
from motifline.plans.compiled import CompiledPattern


# --- counting -----------------------------------------------------------------------------------------------------
def count_contexts(symbols: DataFrame, order: int, full_only: bool = False) -> DataFrame:
    """(context array<int>, n) of all contexts of up to order + 1 symbols. symbols: part, counter (or ts and id), symbol.

    One window pass gives each event the symbols before it; contexts are counted with partial aggregation.
    ``full_only``: events with fewer symbols before them add nothing.
    """
    keys = ["counter"] if "counter" in symbols.columns else ["ts", "id"]
    w = Window.partitionBy("part").orderBy(*keys)
    past = F.array_compact(F.array(*[F.lag("symbol", k).over(w) if k else F.col("symbol") for k in range(order + 1)]))
    rows = symbols.select(past.alias("_past"))
    if full_only:
        rows = rows.where(F.size("_past") == order + 1)
    each = F.transform(F.sequence(F.lit(1), F.size("_past")), lambda k: F.slice("_past", 1, k))
    return rows.select(F.explode(each).alias("context")).groupBy("context").agg(F.count("*").alias("n"))


def conditional(contexts: DataFrame) -> DataFrame:
    """(context, symbol, n, prob): next-symbol distributions after each context, normalised over the symbols seen."""
    rows = contexts.select(F.slice("context", 2, F.greatest(F.size("context") - 1, F.lit(0))).alias("before"), F.element_at("context", 1).alias("symbol"), "n")
    return rows.select(F.col("before").alias("context"), "symbol", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("before"))).alias("prob"))


@dataclass
class Counts:
    """Contexts with their counts, as the driver needs them to grow a tree; contexts rarer than a tree's threshold may be left out."""

    n: dict[tuple, int]
    symbols: list[int]

    def __post_init__(self):
        self.total = sum(v for k, v in self.n.items() if len(k) == 1)

    def prob(self, word: tuple) -> float:
        room = self.total - len(word) + 1
        return self.n.get(tuple(word), 0) / room if room > 0 else 0.0

    def after(self, symbol: int, context: tuple) -> float:
        base = self.n.get(tuple(context), 0) if context else self.total
        return self.n.get((symbol, *context), 0) / base if base else 0.0

    def distribution(self, context: tuple) -> np.ndarray:
        p = np.array([self.n.get((s, *context), 0) for s in self.symbols], float)
        return p / p.sum() if p.sum() else np.full(len(p), 1 / len(p))


def learn_counts(df: DataFrame, c: CompiledPattern, order: int, least: float = 0.0) -> Counts:
    """Counts of a training stream. Contexts below ``least`` of all events stay out of the driver: no tree with that
    symbol threshold can use them."""
    labels = label(df, c)
    found = count_contexts(labels.select("part", "counter", "symbol"), order)
    if least > 0:
        found = found.where(F.col("n") >= F.lit(least * labels.count() * 0.5) - order)
    return Counts({tuple(r["context"]): r["n"] for r in found.collect()}, list(range(len(c.alphabet.masks))))


# --- prediction suffix trees --------------------------------------------------------------------------------------
@dataclass
class SuffixTree:
    """Next-symbol distributions by context; contains every shorter context of each of its contexts."""

    nodes: dict[tuple, np.ndarray]
    symbols: list[int]

    @property
    def order(self) -> int:
        return max(map(len, self.nodes))

    def longest(self, past: tuple) -> tuple:
        """The longest context in the tree that ``past`` begins with."""
        for n in range(min(len(past), self.order), -1, -1):
            if past[:n] in self.nodes:
                return past[:n]
        return ()

    def distribution(self, past: tuple) -> np.ndarray:
        return self.nodes[self.longest(past)]

    def leaves(self) -> list[tuple]:
        inner = {k[:-1] for k in self.nodes if k}
        return [k for k in self.nodes if k not in inner]

    def sequence_prob(self, word) -> float:
        out, past = 1.0, ()
        for s in word:
            out *= float(self.distribution(past)[self.symbols.index(s)])
            past = (s, *past)[: self.order]
        return out

    def log_loss(self, word) -> float:
        total, past = 0.0, ()
        for s in word:
            total -= float(np.log2(self.distribution(past)[self.symbols.index(s)]))
            past = (s, *past)[: self.order]
        return total / len(word) if len(word) else 0.0

    def to_json(self) -> str:
        return json.dumps({"version": 1, "symbols": self.symbols, "nodes": [[list(k), v.tolist()] for k, v in self.nodes.items()]})

    @staticmethod
    def from_json(text: str) -> SuffixTree:
        d = json.loads(text)
        return SuffixTree({tuple(k): np.array(v) for k, v in d["nodes"]}, d["symbols"])


def learn_tree(counts: Counts, order: int, p_min: float = 0.001, alpha: float = 0.0, gamma: float = 0.001, r: float = 1.05, learner: str = "variant", missing: bool = False) -> SuffixTree:
    """Contexts that occur often enough and predict some symbol differently from the context without its oldest symbol.

    ``variant``: the ratio of the two predictions is at least r or at most 1 / r; ``original``: it is above r.
    """
    if gamma * len(counts.symbols) > 1:
        raise ValueError("gamma is too large for the alphabet")
    least = (1 + alpha) * gamma
    keep = {()}

    def telling(context: tuple) -> bool:
        for s in counts.symbols:
            p = counts.after(s, context)
            shorter = counts.after(s, context[:-1]) if len(context) > 1 else counts.prob((s,))
            if p >= least and shorter > 0:
                ratio = p / shorter
                if ratio > r if learner == "original" else (ratio >= r or ratio <= 1 / r):
                    return True
        return False

    todo = [(s,) for s in counts.symbols if counts.prob((s,)) >= p_min]
    while todo:
        context = todo.pop()
        if telling(context):
            keep |= {context[:k] for k in range(1, len(context) + 1)}
        if len(context) < order:
            todo += [(*context, s) for s in counts.symbols if counts.prob((*context, s)) >= p_min]
    if missing:
        inner = {k[:-1] for k in keep if k} | {()}
        keep |= {(*k, s) for k in inner for s in counts.symbols}
    nodes = {}
    for k in sorted(keep, key=len):
        raw = counts.distribution(k) if counts.n.get(k, 0) or not k else None
        p = raw if raw is not None else nodes[k[:-1]]
        nodes[k] = p * (1 - len(p) * gamma) + gamma if raw is not None else p
    return SuffixTree(nodes, counts.symbols)


def log_loss(symbols: DataFrame, tree: SuffixTree) -> DataFrame:
    """(log_loss, n): mean -log2 of each symbol's probability given its past, by a join on the longest context.

    The tree's rows are joined by context and symbol; each event brings its pasts of every length, longest first.
    """
    spark = symbols.sparkSession
    rows = [(list(k), s, float(p[i])) for k, p in tree.nodes.items() for i, s in enumerate(tree.symbols)]
    known = spark.createDataFrame(rows, "context array<int>, symbol int, p double")
    keys = ["counter"] if "counter" in symbols.columns else ["ts", "id"]
    w = Window.partitionBy("part").orderBy(*keys)
    past = F.array_compact(F.array(*[F.lag("symbol", k).over(w) for k in range(1, tree.order + 1)])) if tree.order else F.array().cast("array<int>")
    each = symbols.select("part", *keys, "symbol", past.alias("_past"))
    each = each.withColumn("context", F.explode(F.transform(F.sequence(F.lit(0), F.size("_past")), lambda k: F.slice("_past", 1, k))))
    joined = each.join(F.broadcast(known) if len(rows) <= 200_000 else known, ["context", "symbol"])
    best = joined.groupBy("part", *keys).agg(F.max(F.struct(F.size("context").alias("len"), "p")).alias("_best"))
    return best.agg(F.avg(-F.log2("_best.p")).alias("log_loss"), F.count("*").alias("n"))


# --- suffix automata ----------------------------------------------------------------------------------------------
@dataclass
class SuffixAutomaton:
    """A suffix tree with enough contexts added that each state and symbol fix the next state."""

    states: list[tuple]
    moves: np.ndarray
    probs: np.ndarray
    symbols: list[int] = field(default_factory=list)

    def sequence_prob(self, word, state: int = 0) -> float:
        out = 1.0
        for s in word:
            k = self.symbols.index(s)
            out, state = out * float(self.probs[state, k]), int(self.moves[state, k])
        return out

    def sample(self, n: int, rng: np.random.Generator, state: int = 0) -> list[int]:
        out = []
        for _ in range(n):
            k = int(rng.choice(len(self.symbols), p=self.probs[state] / self.probs[state].sum()))
            out.append(self.symbols[k])
            state = int(self.moves[state, k])
        return out


def to_automaton(tree: SuffixTree) -> SuffixAutomaton:
    states = {k[i:] for k in tree.nodes for i in range(len(k) + 1)}
    states |= {k[:n] for k in states for n in range(len(k) + 1)}
    order = sorted(states, key=lambda k: (len(k), k))
    index = {k: i for i, k in enumerate(order)}

    def move(k: tuple, s: int) -> int:
        past = (s, *k)
        while past not in index:
            past = past[:-1]
        return index[past]

    moves = np.array([[move(k, s) for s in tree.symbols] for k in order], np.int32)
    return SuffixAutomaton(order, moves, np.array([tree.distribution(k) for k in order]), list(tree.symbols))


def embed(automaton: SuffixAutomaton, dfa: Dfa) -> tuple[MarkovChain, dict[tuple[int, int], int]]:
    """The product with a pattern's automaton as a Markov chain, and its states by (context state, pattern state)."""
    first = (0, dfa.start)
    index, todo, rows = {first: 0}, [first], {}
    for now in todo:
        row: dict[int, float] = {}
        for k in range(len(automaton.symbols)):
            nxt = (int(automaton.moves[now[0], k]), int(dfa.table[now[1], automaton.symbols[k]]))
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row[index[nxt]] = row.get(index[nxt], 0.0) + float(automaton.probs[now[0], k])
        rows[index[now]] = row
    m = np.zeros((len(index), len(index)))
    for s, row in rows.items():
        for t, p in row.items():
            m[s, t] = p
    return MarkovChain(m, frozenset(k for (_, q), k in index.items() if q in dfa.finals)), index


# --- products of tree and pattern, without an automaton -----------------------------------------------------------
def waiting(tree: SuffixTree, dfa: Dfa, context: tuple, state: int, horizon: int, cutoff: float = 0.001, merge: bool = False) -> np.ndarray:
    """Waiting times from a context and a pattern state, expanding paths whose probability is above ``cutoff``.

    ``merge`` adds up paths that meet in one place before they are held against the cutoff.
    """
    out = np.zeros(horizon)
    now = [((context, state), 1.0)]
    for t in range(horizon):
        fresh: list = []
        for (past, q), p in now:
            probs = tree.distribution(past)
            for k, s in enumerate(tree.symbols):
                target, mass = int(dfa.table[q, s]), p * float(probs[k])
                if target in dfa.finals:
                    out[t] += mass
                else:
                    fresh.append(((tree.longest((s, *past)), target), mass))
        if merge:
            summed: dict = {}
            for where, mass in fresh:
                summed[where] = summed.get(where, 0.0) + mass
            fresh = list(summed.items())
        now = [x for x in fresh if x[1] > cutoff]
        if not now:
            break
    return out


def exhaustive(tree: SuffixTree, dfa: Dfa, context: tuple, state: int, horizon: int) -> np.ndarray:
    """The same without a cutoff, path by path: for tests."""
    return waiting(tree, dfa, context, state, horizon, cutoff=0.0)


def label_contexts(df: DataFrame, c: CompiledPattern, tree: SuffixTree) -> DataFrame:
    """``label`` with the tree's longest context of each event's past (the event included), as ``context``."""
    w = Window.partitionBy("part").orderBy("counter")
    rows = label(df, c)
    past = F.array_compact(F.array(*[F.lag("symbol", k).over(w) if k else F.col("symbol") for k in range(tree.order)])) if tree.order else F.array().cast("array<int>")
    known = F.array(*[F.lit("," + ",".join(map(str, k)) if k else "") for k in sorted(tree.nodes, key=len, reverse=True)])
    text = F.concat_ws(",", F.lit(""), F.transform("_past", lambda s: s.cast("string")))
    found = F.element_at(F.filter(known, lambda k: (F.concat(text, F.lit(","))).startswith(F.concat(k, F.lit(",")))), 1)
    return rows.withColumn("_past", past).withColumn("context", found).drop("_past")
