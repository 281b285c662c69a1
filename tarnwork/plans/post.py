"""Analyses of finished runs: histograms, residue scores, densities, clusters, commonality, conservation, angles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, conserve, voxels


def histogram_metrics(metrics: DataFrame, names: tuple[str, ...] = ("density", "cpl", "entropy", "water_water", "water_protein"), bins: int = 15, by_run: bool = False) -> DataFrame:
    """(metric[, run_name], bin, low, n, density) of each metric."""
    keys = ("metric", "run_name") if by_run else ("metric",)
    long = metrics.select(*(["run_name"] if by_run else []), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))).alias("m")).select(*(["run_name"] if by_run else []), "m.*")
    return conserve.histogram(long, "value", bins, keys)


METRICS = ("density", "cpl", "entropy", "water_water", "water_protein")


def metrics(tables: dict[str, DataFrame], pooled: list[str] | bool | None = None) -> DataFrame:
    """(run_name, structure_id, frame_idx, the five metrics) of finished runs, null where a run lacks one.

    Runs that ``pooled`` lists count as one, "pooled"; true pools all, other runs stay apart.
    """
    keys = ["run_name", "structure_id", "frame_idx"]
    out = None
    for name, columns in (("density", ["density"]), ("cpl", ["cpl"]), ("entropy", ["entropy"]), ("interaction_counts", ["water_water", "water_protein"])):
        if name in tables:
            some = tables[name].select(*keys, *columns)
            out = some if out is None else out.join(some, keys, "full")
    for c in METRICS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    one = F.lit(True) if pooled is True else F.col("run_name").isin(*pooled) if pooled else F.lit(False)
    return out.withColumn("run_name", F.when(one, "pooled").otherwise(F.col("run_name"))).select(*keys, *METRICS)


def densities(points: DataFrame, n_frames: int, delta: float = 1.0, threshold: float = 1.5) -> tuple[DataFrame, DataFrame]:
    grid = voxels.voxels(points, delta, n_frames=n_frames)
    return grid, voxels.hotspots(grid, threshold, delta)


def concatenated_clusters(points: DataFrame, method: str = "hdbscan", eps: float | None = None, min_samples: int = 10) -> DataFrame:
    labels = cluster.cluster(points, method, eps=eps, min_samples=min_samples)
    return cluster.centers(labels.join(points, "id"))


def conservation(waters: DataFrame, centers: DataFrame, mode: str = "centers", cutoff: float = 1.0) -> dict[str, DataFrame]:
    """Scores by which centres, their connections, or both are coloured."""
    if mode not in ("all", "centers", "connections"):
        raise ValueError("mode is all, centers or connections")
    out = {}
    if mode in ("all", "centers"):
        out["centers"] = conserve.scaled(conserve.occupancy(waters, centers, cutoff), "n")
    if mode in ("all", "connections"):
        out["connections"] = conserve.scaled(conserve.conserved_interactions(waters, centers, cutoff), "n")
    return out
