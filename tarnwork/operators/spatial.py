"""Radius joins on a grid.

Space is cut in cells as wide as the cutoff; one side stands in its cell, the other is put in its cell and the 26 around
it, and the sides meet by an equi-join on (key, cell) with the distance as a residual condition.  So the join is
partitioned by cell, never a product, and a structure of any size spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import MASSES, distance, mass, point, squared

KEYS = ("structure_id", "frame_idx")
_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _cell(axis: str, width: float, wrap: int | None = None, shift: Column | int = 0) -> Column:
    c = F.floor(F.col(axis) / F.lit(width)).cast("long") + shift
    return F.pmod(c, F.lit(wrap)) if wrap else c


def radius_join(
    left: DataFrame,
    right: DataFrame,
    cutoff: float,
    k: int | None = None,
    keys: tuple[str, ...] = KEYS,
    id_col: str = "atom_index",
    closed: bool = False,
    box: tuple[float, float, float] | None = None,
) -> DataFrame:
    """(keys, l, r, distance): structs of both rows for every pair nearer than ``cutoff`` (or as near, if ``closed``).

    ``k`` keeps, for each left row, its k nearest right rows; equal distances go by id.  Joined with itself, a row is its
    own nearest and takes one of the k.  ``box`` makes distances periodic.
    """
    wraps: list[int | None] = [None] * 3
    widths = [float(cutoff)] * 3
    if box:
        wraps = [max(1, int(length // cutoff)) for length in box]
        widths = [length / n for length, n in zip(box, wraps, strict=True)]
    around = F.array(*(F.struct(*(F.lit(v).alias(f"s{a}") for a, v in zip("xyz", t, strict=True))) for t in _AROUND))
    cells = lambda shift: [_cell(a, w, n, shift(a)).alias(f"_c{a}") for a, w, n in zip("xyz", widths, wraps, strict=True)]
    one = left.select(*keys, F.struct(*left.columns).alias("l"), *cells(lambda a: 0))
    two = right.withColumn("_s", F.explode(around)).select(*keys, F.struct(*right.columns).alias("r"), *cells(lambda a: F.col(f"_s.s{a}"))).distinct() if box else right.withColumn("_s", F.explode(around)).select(*keys, F.struct(*right.columns).alias("r"), *cells(lambda a: F.col(f"_s.s{a}")))
    d2 = squared(point("l."), point("r."), box)
    near = d2 <= F.lit(cutoff * cutoff) if closed else d2 < F.lit(cutoff * cutoff)
    found = one.join(two, [*keys, "_cx", "_cy", "_cz"]).where(near).select(*keys, "l", "r", F.sqrt(d2).alias("distance"))
    if k is None:
        return found
    nearest = Window.partitionBy(*keys, f"l.{id_col}").orderBy("distance", f"r.{id_col}")
    return found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k).drop("_n")


def near_any(rows: DataFrame, points: DataFrame, cutoff: float, keys: tuple[str, ...] = (), closed: bool = True) -> DataFrame:
    """Rows within ``cutoff`` of a point: a semi-join on the grid, all columns kept."""
    widths = [float(cutoff)] * 3
    around = F.array(*(F.struct(*(F.lit(v).alias(f"s{a}") for a, v in zip("xyz", t, strict=True))) for t in _AROUND))
    spread = points.withColumn("_s", F.explode(around)).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(F.col(a).alias(f"_p{a}") for a in "xyz"), *(_cell(a, w, None, F.col(f"_s.s{a}")).alias(f"_c{a}") for a, w in zip("xyz", widths, strict=True)))
    on = [_cell(a, w) == F.col(f"_c{a}") for a, w in zip("xyz", widths, strict=True)] + [rows[c] == F.col(f"_k{i}") for i, c in enumerate(keys)]
    d2 = squared(tuple(rows[a] for a in "xyz"), tuple(F.col(f"_p{a}") for a in "xyz"))
    near = d2 <= F.lit(cutoff * cutoff) if closed else d2 < F.lit(cutoff * cutoff)
    for c in on:
        near = near & c
    return rows.join(spread, near, "left_semi")


def centre_of_mass(atoms: DataFrame, keys: tuple[str, ...] = KEYS, element: str = "element") -> DataFrame:
    """(keys, x, y, z): mass-weighted centres."""
    m = mass(F.col(element))
    return atoms.groupBy(*keys).agg(*((F.sum(m * F.col(a)) / F.sum(m)).alias(a) for a in "xyz"))


def active_region(sites: DataFrame, reference: DataFrame, radius: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sites in the active region: protein atoms of a reference residue or within the radius, and whole waters of which
    any atom is within it.  ``reference``: rows of sites, or points; ``mol_id`` tells which atoms are one molecule."""
    close = near_any(sites, reference.select(*keys, "x", "y", "z"), radius, keys)
    waters = close.where("category = 'WAT'").select(*keys, "mol_id").distinct()
    protein = close.where("category = 'PROTEIN'")
    found = protein.unionByName(sites.where("category = 'WAT'").join(waters, [*keys, "mol_id"], "left_semi").select(*protein.columns))
    if "resid" in reference.columns:
        by = [*keys, *(c for c in ("chain", "resid") if c in reference.columns and c in sites.columns)]
        own = reference.select(*by).distinct()
        same = [sites[c].eqNullSafe(own[c]) for c in by]
        found = found.unionByName(sites.where("category = 'PROTEIN'").join(own, same, "left_semi").select(*protein.columns))
    return found.dropDuplicates([*keys, "category", "atom_index"])


def near_protein(waters: DataFrame, protein: DataFrame, margin: float = 0.5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Waters in the sphere about the protein's centre of mass that holds it, plus a margin."""
    centre = centre_of_mass(protein, keys).select(*keys, *(F.col(a).alias(f"_{a}") for a in "xyz"))
    apart = distance(point(), point("_"))
    radius = protein.join(centre, list(keys)).groupBy(*keys).agg((F.max(apart) + margin).alias("_r"))
    return waters.join(centre.join(radius, list(keys)), list(keys)).where(apart <= F.col("_r")).drop("_x", "_y", "_z", "_r")


__all__ = ["KEYS", "MASSES", "active_region", "centre_of_mass", "near_any", "near_protein", "radius_join"]
