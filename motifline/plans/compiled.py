"""A pattern made ready to run, in any of its automaton forms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from motifline.plans import ast, automaton, parser

VERSION = 1


@dataclass
class CompiledPattern:
    """``dfa`` labels streams and feeds the probabilistic models; ``nfa`` enumerates matches."""

    pattern: ast.Pattern
    declarations: ast.Declarations = ast.Declarations()
    policy: str = "nonoverlap"
    pattern_id: int = 0
    select: bool = True  # False: selection policies are not applied, patterns that have some are refused
    _table: automaton.Dfa | None = field(default=None, repr=False)

    def __post_init__(self):
        if not self.select and ast.strict(self.pattern.formula) != self.pattern.formula:
            raise ValueError("the pattern has selection policies")

    @cached_property
    def formula(self):
        return ast.rewrite(self.pattern.formula)

    @cached_property
    def alphabet(self) -> automaton.Alphabet:
        return automaton.Alphabet([self.formula], self.declarations)

    @cached_property
    def nfa(self) -> automaton.Nfa:
        """Streaming, without ε-moves; registers allowed."""
        if len({e.store for e in ast.events(self.formula) if e.store}) > 26:
            raise ValueError("too many registers")
        return automaton.without_empty(automaton.streaming(automaton.thompson(self.formula, self.alphabet)))

    @cached_property
    def dfa(self) -> automaton.Dfa:
        """Streaming, with the count policy, disambiguated to the pattern's order."""
        if self._table is not None:
            return automaton.disambiguate(automaton.count_policy(self._table, self.policy), self.pattern.order)
        if self.alphabet.dynamic or any(e.store for e in ast.events(self.formula)):
            raise ValueError("a pattern with registers has no deterministic automaton; enumerate its matches")
        whole = automaton.determinize(automaton.streaming(automaton.thompson(self.formula, self.alphabet)), self.alphabet)
        return automaton.disambiguate(automaton.count_policy(whole, self.policy), self.pattern.order)

    def with_order(self, order: int) -> CompiledPattern:
        p = self.pattern
        return CompiledPattern(ast.Pattern(p.formula, order, p.partition_by, p.window, p.window_type), self.declarations, self.policy, self.pattern_id, self.select, self._table)

    def to_json(self) -> str:
        out = {"version": VERSION, "pattern": str(self.pattern), "policy": self.policy, "pattern_id": self.pattern_id, "select": self.select}
        out["exclusives"] = ["~(" + ",".join(sorted(map(str, e))) + ")" for e in self.declarations.exclusives]
        out["extras"] = [str(x) for x in self.declarations.extras]
        if self._table is not None:
            out["table"] = {"rows": self._table.table.tolist(), "start": self._table.start, "finals": sorted(self._table.finals), "symbols": [str(a) for a in self.alphabet.atoms]}
        return json.dumps(out)


def compile_pattern(text, declarations: str | ast.Declarations = "", policy: str = "nonoverlap", select: bool = True) -> list[CompiledPattern]:
    """Patterns of a text, or of one that is parsed or built already."""
    known = parser.parse_declarations(declarations) if isinstance(declarations, str) else declarations
    found = parser.parse(text) if isinstance(text, str) else [text] if isinstance(text, ast.Pattern) else list(text)
    return [CompiledPattern(p, known, policy, k, select) for k, p in enumerate(found)]


def compile_one(text, declarations="", policy: str = "nonoverlap", select: bool = True) -> CompiledPattern:
    out = compile_pattern(text, declarations, policy, select)
    if len(out) != 1:
        raise ValueError(f"expected one pattern, found {len(out)}")
    return out[0]


class TypeAlphabet(automaton.Alphabet):
    """One symbol for each event type and a last one for all others."""

    def __init__(self, types: list[str]):
        atoms = [ast.Atom("IsEventTypePredicate", (t,)) for t in types]
        super().__init__([ast.Event(ast.Either(tuple(atoms)))], ast.Declarations((frozenset(atoms),)))

    @property
    def masks(self) -> list[int]:
        return [*(1 << k for k in range(len(self.atoms))), 0]


def from_table(types: list[str], rows, start: int, finals, order: int = 0, partition_by: str | None = None, policy: str = "overlap") -> CompiledPattern:
    """A deterministic automaton given as a table over event types (classical automata). A row may have one more
    column, for all other types; without it they lead to the start state."""
    table = np.asarray(rows, np.int32)
    if table.shape[1] == len(types):
        table = np.hstack([table, np.full((len(table), 1), start, np.int32)])
    if table.shape[1] != len(types) + 1 or table.min() < 0 or table.max() >= len(table):
        raise ValueError("the table doesn't fit the types or its own states")
    out = CompiledPattern(ast.Pattern(ast.Alt(tuple(ast.Event(ast.Atom("IsEventTypePredicate", (t,))) for t in types)), order, partition_by), policy=policy, _table=automaton.Dfa(table, start, frozenset(finals)))
    out.__dict__["alphabet"] = TypeAlphabet(types)
    return out


def keywords(words: list[list[str]], **options) -> CompiledPattern:
    """An automaton that detects any of several words of event types (Aho and Corasick's construction)."""
    if not words or not all(words):
        raise ValueError("expected words of one type or more")
    types = sorted({t for w in words for t in w})
    children, ends, parents = [{}], set(), [()]
    for w in words:
        at = 0
        for t in w:
            if t not in children[at]:
                children.append({})
                parents.append((*parents[at], t))
                children[at][t] = len(children) - 1
            at = children[at][t]
        ends.add(at)
    known = {p: k for k, p in enumerate(parents)}

    def longest(p: tuple) -> int:
        while p not in known:
            p = p[1:]
        return known[p]

    finals = {k for k, p in enumerate(parents) if any(p[i:] in known and known[p[i:]] in ends for i in range(len(p) + 1) if p[i:])}
    rows = [[longest((*p, t)) for t in types] + [0] for p in parents]
    return from_table(types, rows, 0, finals, **options)


def from_json(text: str) -> CompiledPattern:
    d = json.loads(text)
    if d["version"] != VERSION:
        raise ValueError(f"version {d['version']} is unknown")
    known = parser.parse_declarations(",".join(d["exclusives"] + [f"+({x})" for x in d["extras"]]))
    if "table" in d:
        t = d["table"]
        types = [s[len("IsEventTypePredicate(") : -1] for s in t["symbols"]]
        p = parser.parse(d["pattern"])[0]
        out = from_table(types, t["rows"], t["start"], t["finals"], p.order, p.partition_by, d["policy"])
        out.pattern_id = d["pattern_id"]
        return out
    return CompiledPattern(parser.parse(d["pattern"])[0], known, d["policy"], d["pattern_id"], d["select"])


# --- builders for regular expressions over symbols ---------------------------------------------------------------
def symbol(event_type: str) -> ast.Event:
    return ast.Event(ast.Atom("IsEventTypePredicate", (event_type,)))


def concat(*parts) -> ast.Seq:
    return ast.Seq(tuple(symbol(p) if isinstance(p, str) else p for p in parts))


def union(*parts) -> ast.Alt:
    return ast.Alt(tuple(symbol(p) if isinstance(p, str) else p for p in parts))


def star(part) -> ast.Star:
    return ast.Star(symbol(part) if isinstance(part, str) else part)


def from_xml(text: str):
    """A regular expression of nested <concat>, <union>, <star> and <symbol> elements."""
    import xml.etree.ElementTree as ET

    def build(e):
        kind = e.tag.lower()
        if kind == "symbol":
            return symbol(e.attrib.get("value") or (e.text or "").strip())
        parts = [build(c) for c in e]
        if kind == "star":
            return star(parts[0])
        if kind in ("concat", "union"):
            return (concat if kind == "concat" else union)(*parts)
        raise parser.PatternError(f"unknown element {e.tag}")

    return build(ET.fromstring(text))
