"""Automata against the recursive definition of acceptance, on random patterns and all short words."""

import itertools
import random

import pytest

from motifline.plans import ast, automaton, parser
from motifline.plans.compiled import compile_one, from_json, from_table, from_xml, keywords

TYPES = "ABC"
EXCLUSIVE = ast.Declarations((frozenset(ast.Atom("IsEventTypePredicate", (t,)) for t in TYPES),))


def event(t):
    return ast.Event(ast.Atom("IsEventTypePredicate", (t,)))


def random_formula(rng, depth, ops="seq alt star any next not"):
    if depth == 0:
        return event(rng.choice(TYPES))
    op = rng.choice(ops.split())
    sub = lambda: random_formula(rng, depth - 1, ops)
    if op == "seq":
        return ast.Seq((sub(), sub()))
    if op == "alt":
        return ast.Alt((sub(), sub()))
    if op == "star":
        return ast.Star(sub())
    if op == "not":
        return ast.Not(sub())
    return (ast.SkipAny if op == "any" else ast.SkipNext)(rng.choice([ast.Seq((sub(), sub())), ast.Star(sub())]))


def is_type(sentence, symbol, regs):
    return sentence.args[0] == symbol


def accepted(formula, word):
    return ast.accepts(formula, list(word), is_type)


def masks(alphabet, word):
    return [1 << alphabet.index[a] if (a := ast.Atom("IsEventTypePredicate", (t,))) in alphabet.index else 0 for t in word]


@pytest.mark.parametrize("seed", range(40))
def test_all_forms_accept_what_the_definition_does(seed):
    rng = random.Random(seed)
    formula = random_formula(rng, 2)
    rewritten = ast.rewrite(formula)
    alphabet = automaton.Alphabet([rewritten], EXCLUSIVE)
    nfa = automaton.thompson(rewritten, alphabet)
    lean, dfa = automaton.without_empty(nfa), automaton.determinize(nfa, alphabet)
    for n in range(5):
        for word in itertools.product(TYPES, repeat=n):
            m = masks(alphabet, word)
            want = accepted(formula, word)
            assert nfa.accepts(m, alphabet.index) == want
            assert lean.accepts(m, alphabet.index) == want
            assert dfa.accepts([alphabet.masks.index(x) for x in m]) == want


@pytest.mark.parametrize("seed", range(15))
def test_disambiguation_keeps_the_language_and_fixes_the_past(seed):
    rng = random.Random(seed)
    rewritten = ast.rewrite(random_formula(rng, 2, "seq alt star any"))
    alphabet = automaton.Alphabet([rewritten], EXCLUSIVE)
    plain = automaton.determinize(automaton.streaming(automaton.thompson(rewritten, alphabet)), alphabet)
    for order in (1, 2):
        split = automaton.disambiguate(plain, order)
        assert automaton.is_unambiguous(split, order)
        for word in itertools.product(range(len(alphabet.masks)), repeat=4):
            assert plain.accepts(word) == split.accepts(word)


def test_strict_matches_are_among_skipping_ones():
    rng = random.Random(3)
    for _ in range(20):
        f = random_formula(rng, 1, "seq star")
        for n in range(5):
            for word in itertools.product(TYPES, repeat=n):
                if accepted(f, word):
                    assert accepted(ast.SkipAny(f), word)
                if accepted(ast.SkipNext(f), word):
                    assert accepted(ast.SkipAny(f), word)


def test_examples_of_selection():
    star = ast.Star(event("A"))
    assert not accepted(star, "ABA") and accepted(ast.SkipAny(star), "ABA")
    pairs = ast.Star(ast.Seq((event("A"), event("B"))))
    assert not accepted(pairs, "ABCAB") and accepted(ast.SkipAny(pairs), "ABCAB")


def test_minterms_agree():
    atoms = [ast.Atom("P", (k,)) for k in range(5)]
    exclusives = [frozenset(atoms[:2]), frozenset(atoms[1:4])]
    assert ast.minterms(atoms, exclusives) == ast.minterms_by_product(atoms, exclusives)
    assert ast.entails(ast.Both((atoms[0], atoms[4])), atoms[4])
    assert not ast.satisfiable(ast.Both((atoms[0], atoms[1])), exclusives)


def test_count_policies():
    c = compile_one(";(IsEventTypePredicate(A),IsEventTypePredicate(A))", "", "nonoverlap")
    o = compile_one(";(IsEventTypePredicate(A),IsEventTypePredicate(A))", "", "overlap")
    hits = lambda x, word: [s in x.dfa.finals for s in x.dfa.run(word)]
    assert hits(c, [1, 1, 1, 1]) == [False, True, False, True]
    assert hits(o, [1, 1, 1, 1]) == [False, True, True, True]


def test_distances():
    c = compile_one(";(IsEventTypePredicate(A),IsEventTypePredicate(B),IsEventTypePredicate(C))", "~(IsEventTypePredicate(A),IsEventTypePredicate(B),IsEventTypePredicate(C))")
    assert automaton.distances(c.dfa)[c.dfa.start] == 3
    assert automaton.remaining(c.dfa)[c.dfa.start] == 1.0


@pytest.mark.parametrize(
    "text",
    [
        ";(IsEventTypePredicate(A),IsEventTypePredicate(B)){order:2}{window:2}",
        '#(;(^(IsEventTypePredicate(SELL),EQStr(name,INTC))["x"],^(IsEventTypePredicate(BUY),GTAttr(price,"x")))){window:500}{windowType:time}',
        "+(*(GT(speed,1.5)),!(-LT(speed,.5))){partitionBy:mmsi}",
        ";(DistanceBetweenPredicate(-4.47530,48.38273,5.0,6.0),@(;(IsEventTypePredicate(A),TruePredicate())))",
    ],
)
def test_parsing_round_trip(text):
    one = parser.parse(text)[0]
    assert parser.parse(str(one))[0] == one


@pytest.mark.parametrize("text", [";(A(x))", "GT(speed,1", 'GTAttr(speed,"x")', ";(P()[\"x\"],P()[\"x\"])", "P(){window:-1}", "P(){partitionBy:Abc}", "P() Q()", "P(){order:1}{order:2}"])
def test_bad_patterns_are_refused(text):
    with pytest.raises(parser.PatternError):
        parser.parse(text)


def test_patterns_and_declarations_of_a_file():
    assert len(parser.parse("P() & ;(P(),Q())")) == 2
    d = parser.parse_declarations("~(P(),Q()),\n+(R(1.0),S(a)),\n~(P(),R(1.0))")
    assert len(d.exclusives) == 2 and len(d.extras) == 2


def test_registers_may_be_declared_after_use():
    assert parser.parse(';(EQAttr(a,"x"),P()["x"])')


def test_json_round_trip():
    c = compile_one("@(;(IsEventTypePredicate(A),IsEventTypePredicate(B))){order:1}{partitionBy:who}", "~(IsEventTypePredicate(A),IsEventTypePredicate(B))", "overlap")
    back = from_json(c.to_json())
    assert (back.dfa.table == c.dfa.table).all() and back.pattern == c.pattern and back.dfa.finals == c.dfa.finals


def test_classical_automata():
    k = keywords([["A", "B"], ["B", "C", "A"]])
    types = [a.args[0] for a in k.alphabet.atoms]
    word = "ABCABXAB"
    hits = [s in k.dfa.finals for s in k.dfa.run([types.index(t) if t in types else len(types) for t in word])]
    assert hits == [any(word[: i + 1].endswith(w) for w in ("AB", "BCA")) for i in range(len(word))]
    again = from_json(k.to_json())
    assert (again.dfa.table == k.dfa.table).all()
    t = from_table(["A"], [[1], [1]], 0, [1], policy="overlap")
    assert [s in t.dfa.finals for s in t.dfa.run([0, 1, 0])] == [True, False, True]
    f = from_xml("<concat><symbol>A</symbol><star><union><symbol>B</symbol><symbol>C</symbol></union></star></concat>")
    assert accepted(f, "ABCB") and not accepted(f, "BA")
