"""Predicates by name. A predicate is a function of an event and its arguments; new ones are added by ``@predicate``.

The event gives an attribute as a number (``num``) or as text (``text``). In a plan these are columns; in a run that
compares with a register they are Python values, so the same function serves both if it keeps to operators.
A predicate on a missing attribute is false, or an error where the caller asks for ``strict``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from motifline.functions import geo
from motifline.plans import ast

BUILT_IN_NAMES = {"Id": "id", "EventType": "event_type", "Timestamp": "ts"}


@dataclass(frozen=True)
class Predicate:
    name: str
    n_args: int
    test: Callable
    reads: Callable  # of the arguments: the attributes


REGISTRY: dict[str, Predicate] = {}
AREAS: dict[str, tuple] = {"BrestPort": geo.BREST_PORT}


def predicate(name: str, n_args: int, reads: Callable = lambda *args: [a for a in args[:1] if isinstance(a, str)]):
    """Register ``test(event, *args) -> bool column`` under ``name``."""

    def add(test: Callable) -> Callable:
        REGISTRY[name] = Predicate(name, n_args, test, reads)
        return test

    return add


def add_area(name: str, polygon) -> None:
    """An area for HeadingTowardsPredicate: (longitude, latitude) vertices in order."""
    AREAS[name] = tuple(map(tuple, polygon))


def find(atom: ast.Atom) -> Predicate:
    found = REGISTRY.get(atom.name)
    if found is None:
        raise ValueError(f"unknown predicate {atom.name}")
    if len(atom.args) != found.n_args:
        raise ValueError(f"{atom.name} takes {found.n_args} arguments, not {len(atom.args)}")
    return found


class Columns:
    """An event as columns of a DataFrame, possibly of one side of a join."""

    def __init__(self, get: Callable[[str], Column] = F.col):
        self.get = get

    def num(self, name: str) -> Column:
        return self.get(BUILT_IN_NAMES.get(name, name)).cast("double")

    def text(self, name: str) -> Column:
        return self.get(BUILT_IN_NAMES.get(name, name)).cast("string")


class Values:
    """An event as a mapping; missing values raise TypeError in comparisons, which counts as false."""

    def __init__(self, values: dict):
        self.values = values

    def num(self, name: str):
        x = self.values.get(BUILT_IN_NAMES.get(name, name))
        return None if x is None else float(x)

    def text(self, name: str):
        x = self.values.get(BUILT_IN_NAMES.get(name, name))
        return None if x is None else str(x)


def column(atom: ast.Atom, event: Columns, stored: dict[str, Columns] | None = None, strict: bool = False) -> Column:
    found = find(atom)
    args = [(stored or {})[a.register] if isinstance(a, ast.Ref) else a for a in atom.args]
    out = found.test(event, *args)
    if strict:
        return F.when(out.isNull(), F.raise_error(F.lit(f"{atom} on a missing attribute")).cast("boolean")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def sentence_column(sentence, event: Columns, stored: dict[str, Columns] | None = None, strict: bool = False) -> Column:
    if isinstance(sentence, ast.Atom):
        return column(sentence, event, stored, strict)
    if isinstance(sentence, (ast.Both, ast.Either)):
        parts = [sentence_column(p, event, stored, strict) for p in sentence.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(sentence, ast.Both) else out | p
        return out
    if isinstance(sentence, ast.Inverse):
        return ~sentence_column(sentence.part, event, stored, strict)
    if isinstance(sentence, ast.Truth):
        return F.lit(True)
    raise TypeError(sentence)


def value(atom: ast.Atom, event: Values, stored: dict[str, Values]) -> bool:
    """An atom on Python values; false if a register is unset or an attribute missing."""
    args = []
    for a in atom.args:
        if isinstance(a, ast.Ref):
            if a.register not in stored:
                return False
            a = stored[a.register]
        args.append(a)
    try:
        return bool(find(atom).test(event, *args))
    except TypeError:
        return False


def same(a, b):
    """Equality that a missing value fails, for columns and Python values alike."""
    if isinstance(a, Column) or isinstance(b, Column):
        return a == b
    return a is not None and b is not None and a == b


predicate("IsEventTypePredicate", 1, lambda t: ["event_type"])(lambda e, t: e.text("event_type") == t)
predicate("EQ", 2)(lambda e, a, c: e.num(a) == c)
predicate("GT", 2)(lambda e, a, c: e.num(a) > c)
predicate("GTE", 2)(lambda e, a, c: e.num(a) >= c)
predicate("LT", 2)(lambda e, a, c: e.num(a) < c)
predicate("LTE", 2)(lambda e, a, c: e.num(a) <= c)
predicate("BT", 3)(lambda e, a, lo, hi: (e.num(a) >= lo) & (e.num(a) < hi))  # half open
predicate("EQStr", 2)(lambda e, a, c: e.text(a) == c)
predicate("EQAttr", 2)(lambda e, a, r: same(e.num(a), r.num(a)))
predicate("EQAttrStr", 2)(lambda e, a, r: same(e.text(a), r.text(a)))
predicate("GTAttr", 2)(lambda e, a, r: e.num(a) > r.num(a))
predicate("LTAttr", 2)(lambda e, a, r: e.num(a) < r.num(a))
predicate("EpsilonPredicate", 0, lambda: [])(lambda e: F.lit(True))

POSITION = lambda *args: ["lon", "lat"]


def _away(e, lon: float, lat: float):
    return geo.haversine_km(e.num("lon"), e.num("lat"), F.lit(lon), F.lit(lat))


predicate("WithinCirclePredicate", 3, POSITION)(lambda e, lon, lat, r: _away(e, lon, lat) < r)
predicate("OutsideCirclePredicate", 3, POSITION)(lambda e, lon, lat, r: ~(_away(e, lon, lat) < r))
predicate("DistanceBetweenPredicate", 4, POSITION)(lambda e, lon, lat, r1, r2: (_away(e, lon, lat) > r1) & (_away(e, lon, lat) < r2))


@predicate("HeadingTowardsPredicate", 1, lambda area: ["lon", "lat", "speed", "heading"])
def heading_towards(e, area: str):
    """Does the way of the next hour meet the area?"""
    if area not in AREAS:
        raise ValueError(f"unknown area {area}; add_area() makes one")
    lon, lat = e.num("lon"), e.num("lat")
    to = geo.projected(lon, lat, 1.0, e.num("speed"), e.num("heading"))
    return geo.segment_meets(lon, lat, *to, AREAS[area])
