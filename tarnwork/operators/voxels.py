"""Water density on a grid, and its hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: molecules per cubic angstrom of TIP3P water at 300 K.
BULK = 0.0329


def voxels(points: DataFrame, delta: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), n_frames: int = 1, bulk: float = BULK) -> DataFrame:
    """(ix, iy, iz, n, density): density relative to bulk water."""
    cell = [F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(delta))).cast("long").alias(f"i{a}") for a, o in zip("xyz", origin, strict=True)]
    return points.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("density", F.col("n") / F.lit(n_frames * delta**3 * bulk))


def hotspots(grid: DataFrame, threshold: float = 1.5, delta: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Voxels that equal the maximum of the 27 about them and exceed the threshold; absent voxels are 0."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    around = grid.withColumn("_s", F.explode(steps)).select((F.col("ix") + F.col("_s.a")).alias("ix"), (F.col("iy") + F.col("_s.b")).alias("iy"), (F.col("iz") + F.col("_s.c")).alias("iz"), F.col("density").alias("d"))
    best = around.groupBy("ix", "iy", "iz").agg(F.max("d").alias("best"))
    found = grid.join(best, ["ix", "iy", "iz"]).where((F.col("density") == F.col("best")) & (F.col("density") > threshold))
    return found.select("ix", "iy", "iz", "density", *((F.lit(float(o)) + F.col(f"i{a}") * delta).alias(a) for a, o in zip("xyz", origin, strict=True)))
