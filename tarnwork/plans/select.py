"""Selection language: resid, resname, name, chain, protein, water, all, and, or, not, parentheses, around, point, sphzone.

``not`` binds before ``and`` before ``or``.  Plain terms become column predicates; ``around r (sel)``, ``sphzone r (sel)``
and ``point x y z r`` become semi-joins on the grid.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import is_protein, is_water
from ..operators.spatial import KEYS, near_any

_TOKEN = re.compile(r"[()]|[^\s()]+")
_WORDS = {"and", "or", "not", "resid", "resname", "name", "chain", "protein", "water", "all", "around", "sphzone", "point"}


def parse(text: str):
    """A tree of tuples: ('or', a, b), ('and', a, b), ('not', a), ('resid', values), ('around', r, a) and so on."""
    tokens, at = _TOKEN.findall(text.replace("#", " ")), 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"selection ends too early: {text!r}")
        at += 1
        return tokens[at - 1]

    def either():
        left = both()
        while peek() == "or":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = one()
        while peek() == "and":
            take()
            left = ("and", left, one())
        return left

    def one():
        t = take()
        if t == "not":
            return ("not", one())
        if t == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"a parenthesis is not closed: {text!r}")
            return inner
        if t in ("protein", "water", "all"):
            return (t,)
        if t in ("resid", "resname", "name", "chain"):
            values = []
            while peek() is not None and peek() not in _WORDS | {"(", ")"}:
                values.append(take())
            if not values:
                raise ValueError(f"{t} needs a value: {text!r}")
            return (t, tuple(values))
        if t in ("around", "sphzone"):
            return (t, float(take()), one())
        if t == "point":
            return (t, *(float(take()) for _ in range(4)))
        raise ValueError(f"unknown word {t!r} in selection {text!r}")

    tree = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in selection {text!r}")
    return tree


def _spatial(tree) -> bool:
    return tree[0] in ("around", "sphzone", "point") or any(_spatial(x) for x in tree[1:] if isinstance(x, tuple) and x and isinstance(x[0], str) and x[0] in _WORDS)


def predicate(tree) -> Column:
    kind = tree[0]
    if kind in ("and", "or"):
        a, b = predicate(tree[1]), predicate(tree[2])
        return a & b if kind == "and" else a | b
    if kind == "not":
        return ~predicate(tree[1])
    if kind == "all":
        return F.lit(True)
    if kind == "protein":
        return is_protein(F.col("resname"))
    if kind == "water":
        return is_water(F.col("resname"))
    if kind == "resid":
        terms = []
        for v in tree[1]:
            low, _, high = v.replace(":", "-").partition("-")
            terms.append(F.col("resid").between(int(low), int(high or low)))
        return reduce(Column.__or__, terms)
    if kind in ("resname", "name", "chain"):
        like = lambda v: F.col(kind).like(v.replace("_", r"\_").replace("*", "%"))
        return reduce(Column.__or__, (like(v) for v in tree[1]))
    raise ValueError(f"{kind} is no plain term")


def select(atoms: DataFrame, text: str) -> DataFrame:
    """The atoms that a selection names."""
    return _apply(atoms, parse(text))


def _apply(atoms: DataFrame, tree) -> DataFrame:
    if not _spatial(tree):
        return atoms.where(predicate(tree))
    kind, on = tree[0], [*KEYS, "atom_index"]
    if kind == "and":
        return _apply(atoms, tree[1]).join(_apply(atoms, tree[2]).select(*on), on, "left_semi")
    if kind == "or":
        return _apply(atoms, tree[1]).unionByName(_apply(atoms, tree[2])).dropDuplicates(on)
    if kind == "not":
        return atoms.join(_apply(atoms, tree[1]).select(*on), on, "left_anti")
    if kind == "point":
        spot = atoms.select(*KEYS).distinct().select(*KEYS, *(F.lit(v).alias(a) for a, v in zip("xyz", tree[1:4], strict=True)))
        return near_any(atoms, spot, tree[4], KEYS)
    inner = _apply(atoms, tree[2])
    if kind == "sphzone":
        return near_any(atoms, inner.groupBy(*KEYS).agg(*(F.avg(a).alias(a) for a in "xyz")), tree[1], KEYS)
    return near_any(atoms, inner, tree[1], KEYS).join(inner.select(*on), on, "left_anti")


def rewrite_resids(text: str, mapping: dict[int, int]) -> str:
    """The selection with residue numbers replaced, as an alignment translates them; all else stays."""

    def swap(match: re.Match) -> str:
        return match[1] + re.sub(r"\d+", lambda n: str(mapping.get(int(n[0]), int(n[0]))), match[2])

    return re.sub(r"(\bresid\s+)((?:\d+(?:[-:]\d+)?\s*)+)", swap, text)
