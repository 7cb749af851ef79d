"""Models and forecasts against published or hand-computed values. No Spark."""

import itertools
from collections import Counter

import numpy as np
import pytest

from motifline.operators import suffix_trees as st
from motifline.operators import waiting as wt
from motifline.operators.hidden import HiddenMarkov
from motifline.operators.markov import MarkovChain, chain_of
from motifline.plans.compiled import compile_one

EXCLUSIVE = "~(IsEventTypePredicate(A),IsEventTypePredicate(B))"


def counts_of(word, order):
    n = Counter()
    for i in range(len(word)):
        past = tuple(reversed(word[max(0, i - order) : i + 1]))
        for k in range(1, len(past) + 1):
            n[past[:k]] += 1
    return st.Counts(dict(n), sorted(set(word)))


def test_published_suffix_tree():
    """ABRACADABRA, as in Begleiter et al. (2004), figure 5."""
    word = ["ABCDR".index(x) for x in "ABRACADABRA"]
    tree = st.learn_tree(counts_of(word, 12), 12, 0.001, 0.01, 0.001, 1.05)
    a, b, c, d, r = range(5)
    want = {
        (): [0.45, 0.183, 0.092, 0.092, 0.183], (a,): [0.001, 0.498, 0.25, 0.25, 0.001], (b,): [0.001, 0.001, 0.001, 0.001, 0.996], (c,): [0.996, 0.001, 0.001, 0.001, 0.001],
        (d,): [0.996, 0.001, 0.001, 0.001, 0.001], (r,): [0.996, 0.001, 0.001, 0.001, 0.001], (a, c): [0.001, 0.001, 0.001, 0.996, 0.001], (a, d): [0.001, 0.996, 0.001, 0.001, 0.001],
        (a, r): [0.001, 0.001, 0.996, 0.001, 0.001],
    }
    assert set(tree.nodes) == set(want)
    for k, p in want.items():
        assert np.allclose(tree.nodes[k], p, atol=0.005)


def test_suffix_automaton_gives_the_trees_probabilities():
    rng = np.random.default_rng(1)
    word = rng.integers(0, 3, 400).tolist()
    for i in range(2, 400):
        if word[i - 2] == 1:
            word[i] = 2
    tree = st.learn_tree(counts_of(word, 3), 3)
    auto = st.to_automaton(tree)
    for w in itertools.product(range(3), repeat=5):
        assert abs(tree.sequence_prob(w) - auto.sequence_prob(w)) < 1e-12
    back = st.SuffixTree.from_json(tree.to_json())
    assert back.log_loss(word[:50]) == tree.log_loss(word[:50])
    assert len(auto.sample(20, rng)) == 20


def simulated(c, p, horizon):
    """Waiting times from the start state by all words."""
    dfa, out = c.dfa, np.zeros(horizon)
    now = {dfa.start: 1.0}
    for k in range(horizon):
        nxt = {}
        for s, mass in now.items():
            for sym, q in enumerate(p):
                t = int(dfa.table[s, sym])
                if t in dfa.finals:
                    out[k] += mass * q
                else:
                    nxt[t] = nxt.get(t, 0) + mass * q
        now = nxt
    return out


def test_full_order_waiting_times():
    c = compile_one(";(IsEventTypePredicate(A),IsEventTypePredicate(B))", EXCLUSIVE)
    p = [0.2, 0.5, 0.3]
    chain = chain_of(c, p)
    assert not chain.check()
    got = wt.full_order(chain, 12, finals=True)
    assert np.allclose(got[c.dfa.start], simulated(c, p, 12))
    final = next(iter(c.dfa.finals))
    assert np.allclose(got[final], got[c.dfa.start])  # after a match everything begins anew
    empty = MarkovChain(np.zeros((2, 2)), frozenset({1}))
    assert not wt.full_order(empty, 5)[0].any()
    assert MarkovChain.from_json(chain.to_json()).finals == chain.finals


def test_variable_order_waiting_times():
    c = compile_one(";(IsEventTypePredicate(A),IsEventTypePredicate(B))", EXCLUSIVE)
    word = np.random.default_rng(2).integers(0, 3, 300).tolist()
    tree = st.learn_tree(counts_of(word, 2), 2)
    all_paths = st.exhaustive(tree, c.dfa, (1,), c.dfa.start, 7)
    assert np.allclose(st.waiting(tree, c.dfa, (1,), c.dfa.start, 7, 0.0, merge=True), all_paths)
    assert np.allclose(st.waiting(tree, c.dfa, (1,), c.dfa.start, 7, 0.0005), all_paths, atol=0.05)
    chain, index = st.embed(st.to_automaton(tree), c.dfa)
    state = index[(0, c.dfa.start)]
    assert np.allclose(wt.full_order(chain, 7)[state], st.exhaustive(tree, c.dfa, (), c.dfa.start, 7))


P = np.array([0.0, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.0])


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.45, 0.8, 1.0])
def test_smart_scan_is_full_scan(threshold):
    rng = np.random.default_rng(int(threshold * 100))
    for p in [P, *(rng.dirichlet(np.ones(12)) * 0.999 for _ in range(30))]:
        a, b = (wt.forecast_of(p, m, threshold, len(p)) for m in ("smart-scan", "full-scan"))
        if b.valid:
            assert (a.start, a.end) == (b.start, b.end) and abs(a.prob - b.prob) < 1e-9


def test_forecast_methods():
    f = wt.forecast_of(P, "smart-scan", 0.3, 9)
    assert (f.start, f.end, f.prob) == (3, 3, 0.3)
    f = wt.forecast_of(P, "classify-nextk", 0.5, 3)
    assert (f.start, f.end, f.positive) == (1, 3, True) and abs(f.middle - (2 * 0.2 + 3 * 0.3) / 0.5) < 1e-12
    f = wt.forecast_of(P, "argmax", 0.5, 9)
    assert (f.start, f.end) == (2, 4) and f.middle == 3
    f = wt.forecast_of(P, "fixed-spread", 0.5, 2)
    assert (f.start, f.end) == (2, 4)
    assert not wt.forecast_of(P, "smart-scan", 0.9, 2).valid
    f = wt.forecast_of(P * 0.1, "smart-scan", 0.9, 9)  # never reached: the whole horizon, with nothing to say for it
    assert (f.start, f.end, f.prob) == (1, 10, 0.0)
    assert wt.forecast_of(P, "classify-win", 0.5, 2, 3).start == 2
    assert abs(wt.expected(P) - sum((k + 1) * x for k, x in enumerate(P))) < 1e-12
    with pytest.raises(ValueError):
        wt.forecast_of(P, "smart-scan", 1.5, 3)
    assert wt.random_table([1, 2], 10, 3) == wt.random_table([1, 2], 10, 3)


def test_hidden_model_filters():
    m = HiddenMarkov(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.8, 0.2], [0.3, 0.7]]))
    assert np.allclose(m.filter([0]), [0.4 / 0.55, 0.15 / 0.55])
    w = m.waiting([0], {1}, 3)
    b = m.filter([0])
    assert abs(w[0] - (b @ m.moves)[1]) < 1e-12 and w[1] > 0
