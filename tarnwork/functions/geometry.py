"""Column expressions on points: distances, periodic distances, angles, rigid motions, masses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Atomic masses by element.
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "P": 30.974, "S": 32.06}
Point = tuple[Column, Column, Column]


def point(prefix: str = "") -> Point:
    return tuple(F.col(f"{prefix}{a}") for a in "xyz")


def sub(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def image(d: Column, length: float) -> Column:
    """The shortest of the differences that periodic images of an orthorhombic box give."""
    return d - F.lit(length) * F.round(d / F.lit(length))


def squared(a: Point, b: Point, box: tuple[float, float, float] | None = None) -> Column:
    d = sub(a, b)
    if box:
        d = tuple(image(x, length) for x, length in zip(d, box, strict=True))
    return dot(d, d)


def distance(a: Point, b: Point, box: tuple[float, float, float] | None = None) -> Column:
    return F.sqrt(squared(a, b, box))


def angle(u: Point, v: Point) -> Column:
    """Degrees between two vectors; null where one is null or zero.  The cosine is kept in [-1, 1]."""
    size = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / size)))))


def angle_at(vertex: Point, a: Point, b: Point) -> Column:
    """Degrees at ``vertex`` between the directions to a and b."""
    return angle(sub(a, vertex), sub(b, vertex))


def rigid(p: Point, r: list[list[float]], t: list[float]) -> Point:
    """p times the transpose of r, plus t."""
    return tuple(sum((p[k] * F.lit(float(r[i][k])) for k in range(3)), F.lit(0.0)) + F.lit(float(t[i])) for i in range(3))


def mass(element: Column) -> Column:
    """Mass of an element; that of carbon where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in MASSES.items() for x in pair])
    return F.coalesce(F.element_at(table, element), F.lit(MASSES["C"]))
