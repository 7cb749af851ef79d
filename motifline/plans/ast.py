"""Patterns as trees: boolean sentences over predicates, and regular expressions over sentences."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product


# --- sentences -------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Atom:
    """A predicate by name; arguments are numbers, constants and attributes (str), or registers (Ref)."""

    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"


@dataclass(frozen=True)
class Ref:
    register: str

    def __str__(self) -> str:
        return f'"{self.register}"'


@dataclass(frozen=True)
class Truth:
    def __str__(self) -> str:
        return "TruePredicate()"


@dataclass(frozen=True)
class Both:
    parts: tuple

    def __str__(self) -> str:
        return f"^({','.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Either:
    parts: tuple

    def __str__(self) -> str:
        return f"|({','.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Inverse:
    part: object

    def __str__(self) -> str:
        return f"-{self.part}"


@dataclass(frozen=True)
class OneOf:
    """True for the listed valuations of all atoms: what complementing an automaton makes."""

    masks: frozenset

    def __str__(self) -> str:
        return f"in{sorted(self.masks)}"


def atoms(sentence) -> list[Atom]:
    if isinstance(sentence, Atom):
        return [sentence]
    if isinstance(sentence, (Both, Either)):
        return [a for p in sentence.parts for a in atoms(p)]
    return atoms(sentence.part) if isinstance(sentence, Inverse) else []


def holds(sentence, mask: int, index: dict[Atom, int]) -> bool:
    """Is the sentence true when bit ``index[a]`` of ``mask`` tells whether atom a is?"""
    if isinstance(sentence, Atom):
        return bool(mask >> index[sentence] & 1)
    if isinstance(sentence, Both):
        return all(holds(p, mask, index) for p in sentence.parts)
    if isinstance(sentence, Either):
        return any(holds(p, mask, index) for p in sentence.parts)
    if isinstance(sentence, Inverse):
        return not holds(sentence.part, mask, index)
    if isinstance(sentence, OneOf):
        return mask in sentence.masks
    return True


def minterms(found: list[Atom], exclusives: list[frozenset] = ()) -> list[int]:
    """The valuations of the atoms, as masks, in which no two atoms of an exclusive set are true."""
    index = {a: k for k, a in enumerate(found)}
    groups = [[1 << index[a] for a in e if a in index] for e in exclusives]
    return [m for m in range(1 << len(found)) if all(sum(bool(m & b) for b in g) < 2 for g in groups)]


def minterms_by_product(found: list[Atom], exclusives: list[frozenset] = ()) -> list[int]:
    """The same, built as products of the free atoms' valuations and one choice (or none) from each exclusive set."""
    index = {a: k for k, a in enumerate(found)}
    sets = [[a for a in e if a in index] for e in exclusives]
    bound = {a for e in sets for a in e}
    choices = [[0, 1 << index[a]] for a in found if a not in bound] + [[0, *(1 << index[a] for a in e)] for e in sets]
    out = set()
    for picked in product(*choices):
        mask = 0
        for bits in picked:
            mask |= bits
        if all(sum(mask >> index[a] & 1 for a in e) < 2 for e in sets):
            out.add(mask)
    return sorted(out)


def satisfiable(sentence, exclusives: list[frozenset] = ()) -> bool:
    found = list(dict.fromkeys(atoms(sentence)))
    index = {a: k for k, a in enumerate(found)}
    return any(holds(sentence, m, index) for m in minterms(found, exclusives))


def entails(a, b, exclusives: list[frozenset] = ()) -> bool:
    return not satisfiable(Both((a, Inverse(b))), exclusives)


# --- formulas --------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Event:
    """An event that satisfies a sentence; ``store`` names the register that keeps it."""

    sentence: object
    store: str | None = None

    def __str__(self) -> str:
        return f"{self.sentence}" + (f'["{self.store}"]' if self.store else "")


@dataclass(frozen=True)
class Seq:
    parts: tuple

    def __str__(self) -> str:
        return f";({','.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Alt:
    parts: tuple

    def __str__(self) -> str:
        return f"+({','.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Star:
    part: object

    def __str__(self) -> str:
        return f"*({self.part})"


@dataclass(frozen=True)
class Not:
    part: object

    def __str__(self) -> str:
        return f"!({self.part})"


@dataclass(frozen=True)
class SkipAny:
    part: object

    def __str__(self) -> str:
        return f"#({self.part})"


@dataclass(frozen=True)
class SkipNext:
    part: object

    def __str__(self) -> str:
        return f"@({self.part})"


@dataclass(frozen=True)
class Skipped:
    """Any number of events that don't join the match."""


@dataclass(frozen=True)
class Empty:
    """No event."""


def strict(formula):
    """The same without selection policies."""
    if isinstance(formula, (SkipAny, SkipNext)):
        return strict(formula.part)
    if isinstance(formula, (Seq, Alt)):
        return type(formula)(tuple(map(strict, formula.parts)))
    return type(formula)(strict(formula.part)) if isinstance(formula, (Star, Not)) else formula


def rewrite(formula):
    """Selection policies in terms of the other operators. A policy acts on the sequence or iteration right below it;
    what is below that is contiguous."""
    if isinstance(formula, (SkipAny, SkipNext)):
        inner = strict(formula.part)

        def gap(after):
            return Skipped() if isinstance(formula, SkipAny) else Not(Seq((Skipped(), after, Skipped())))

        if isinstance(inner, Seq):
            out = [inner.parts[0]]
            for p in inner.parts[1:]:
                out += [gap(p), p]
            return Seq(tuple(out))
        if isinstance(inner, Star):
            return Alt((Seq((inner.part, Star(Seq((gap(inner.part), inner.part))))), Empty()))
        return inner
    if isinstance(formula, (Seq, Alt)):
        return type(formula)(tuple(map(rewrite, formula.parts)))
    return type(formula)(rewrite(formula.part)) if isinstance(formula, (Star, Not)) else formula


def events(formula) -> list[Event]:
    if isinstance(formula, Event):
        return [formula]
    if isinstance(formula, (Seq, Alt)):
        return [e for p in formula.parts for e in events(p)]
    return events(formula.part) if hasattr(formula, "part") else []


@dataclass(frozen=True)
class Pattern:
    """A formula with its clauses."""

    formula: object
    order: int = 0
    partition_by: str | None = None
    window: int = 0
    window_type: str = "count"

    def __str__(self) -> str:
        out = f"{self.formula}" + "{order:%d}" % self.order
        out += "{partitionBy:%s}" % self.partition_by if self.partition_by else ""
        return out + "{window:%d}{windowType:%s}" % (self.window, self.window_type)


@dataclass(frozen=True)
class Declarations:
    """Sets of predicates of which at most one is true, and predicates to tell apart beyond the pattern's own."""

    exclusives: tuple = ()
    extras: tuple = ()


# --- acceptance, by definition ---------------------------------------------------------------------------------
def accepts(formula, word: list, test, valuation: dict | None = None) -> bool:
    """Does the whole word belong to the formula's language? ``test(sentence, event, valuation)`` judges one event.

    Splits the word in every way, so it serves as a reference for short words only.
    """
    return any(end == len(word) for end, _ in _ends(rewrite(formula), word, 0, test, valuation or {}))


def _ends(f, word, at, test, regs):
    if isinstance(f, Event):
        if at < len(word) and test(f.sentence, word[at], regs):
            yield at + 1, (regs | {f.store: word[at]} if f.store else regs)
    elif isinstance(f, Empty):
        yield at, regs
    elif isinstance(f, Skipped):
        for end in range(at, len(word) + 1):
            yield end, regs
    elif isinstance(f, Seq):
        if len(f.parts) == 1:
            yield from _ends(f.parts[0], word, at, test, regs)
        else:
            for mid, r in _ends(f.parts[0], word, at, test, regs):
                yield from _ends(Seq(f.parts[1:]), word, mid, test, r)
    elif isinstance(f, Alt):
        for p in f.parts:
            yield from _ends(p, word, at, test, regs)
    elif isinstance(f, Star):
        yield at, regs
        for mid, r in _ends(f.part, word, at, test, regs):
            if mid > at:
                yield from _ends(f, word, mid, test, r)
    elif isinstance(f, Not):
        for end in range(at, len(word) + 1):
            if not any(e == end - at for e, _ in _ends(f.part, word[at:end], 0, test, regs)):
                yield end, regs
    else:
        raise TypeError(f)
