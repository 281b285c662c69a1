"""Conservation across structures: commonality with cluster centres, occupancy, interactions, angle clusters, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import by_group
from .spatial import near_any, radius_join


def _frame(waters: DataFrame) -> list[str]:
    """The columns that tell one frame of one structure of one run."""
    return [c for c in ("run_name", "structure_id", "frame_idx") if c in waters.columns]


def commonality(waters: DataFrame, centers: DataFrame, near: float = 1.5, inner: float = 2.0, outer: float = 6.0) -> DataFrame:
    """(run_name, structure_id, frame_idx as far as the waters have them, score, unique_waters): the sum over waters near a centre of 1 / (1 + crowd), over the number of centres.

    A water's crowd are the waters of its own frame at more than ``inner`` and less than ``outer``.  Structures with no
    water near a centre score 0.
    """
    keys = _frame(waters)
    w = waters.select(*keys, F.col("atom_index").alias("id"), "x", "y", "z")
    crowd = radius_join(w, w, outer, keys=tuple(keys), id_col="id").where(F.col("distance") > inner).groupBy(*keys, F.col("l.id").alias("id")).agg(F.count("*").alias("crowd"))
    at = near_any(w, centers.select("x", "y", "z"), near, closed=False).join(crowd, [*keys, "id"], "left").select(*keys, "id", (1 / (F.coalesce("crowd", F.lit(0)) + 1)).alias("v"))
    found = at.groupBy(*keys).agg(F.sum("v").alias("s"), F.count("*").alias("hits"))
    every = w.groupBy(*keys).agg(F.count("*").alias("n"))
    number = centers.agg(F.count("*").alias("n_centers"))
    out = every.join(found, keys, "left").join(F.broadcast(number))  # one row
    return out.select(*keys, (F.coalesce("s", F.lit(0.0)) / F.col("n_centers")).alias("score"), (F.col("n") - F.coalesce("hits", F.lit(0))).alias("unique_waters"))


def occupancy(waters: DataFrame, centers: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """(label, n): waters of all structures within the cutoff of each centre, 0 included."""
    w = waters.select("structure_id", "atom_index", "x", "y", "z").withColumn("_k", F.lit(0))
    c = centers.select("label", "x", "y", "z").withColumn("_k", F.lit(0))
    hits = radius_join(w, c, cutoff, keys=("_k",), closed=True).groupBy(F.col("r.label").alias("label")).agg(F.count("*").alias("n"))
    return centers.select("label").join(hits, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def scaled(rows: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Min-max scaling of a column over all rows; a constant column gives 0.  The extremes are one row, joined."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(ends)).withColumn(out, value).drop("_lo", "_hi")


def clustered_network(centers: DataFrame, cutoff: float = 2.0, max_neighbors: int = 10) -> DataFrame:
    """(src, dst): connections between cluster centres, as between waters."""
    c = centers.select(F.col("label").alias("atom_index"), "x", "y", "z").withColumn("_k", F.lit(0))
    return radius_join(c, c, cutoff, max_neighbors, keys=("_k",)).where("l.atom_index < r.atom_index").select(F.col("l.atom_index").alias("src"), F.col("r.atom_index").alias("dst"), "distance")


def conserved_interactions(waters: DataFrame, centers: DataFrame, cutoff: float = 1.0, connect: float = 2.0) -> DataFrame:
    """(src, dst, n): in how many frames both ends of a centre-centre connection are occupied."""
    frame = F.struct(*_frame(waters)).alias("frame")
    w = waters.select(frame, "atom_index", "x", "y", "z").withColumn("_k", F.lit(0))
    c = centers.select("label", "x", "y", "z").withColumn("_k", F.lit(0))
    held = radius_join(w, c, cutoff, keys=("_k",), closed=True).select(F.col("l.frame").alias("frame"), F.col("r.label").alias("label")).distinct()
    net = clustered_network(centers, connect)
    both = net.join(held.withColumnRenamed("label", "src"), "src").join(held.withColumnRenamed("label", "dst"), ["frame", "dst"]).groupBy("src", "dst").agg(F.count_distinct("frame").alias("n"))
    return net.join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("n"))


def angle_clusters(rows: DataFrame, min_rows: int = 4, min_cluster_size: int = 3) -> DataFrame:
    """(msa_resid, label, angle1, angle2, n, nearest_id) of clusters of (angle1, angle2) for each alignment column."""
    enough = rows.groupBy("msa_resid").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows).select("msa_resid")
    some = rows.join(enough, "msa_resid", "left_semi")
    labels = by_group(some, "hdbscan", ("msa_resid",), ("angle1", "angle2"), min_cluster_size=min_cluster_size)
    at = labels.where("label >= 0").join(some.select("msa_resid", "id", "angle1", "angle2"), ["msa_resid", "id"])
    mean = at.groupBy("msa_resid", "label").agg(F.avg("angle1").alias("a"), F.avg("angle2").alias("b"), F.count("*").alias("n"))
    apart = (F.col("angle1") - F.col("a")) ** 2 + (F.col("angle2") - F.col("b")) ** 2
    near = at.join(mean, ["msa_resid", "label"]).groupBy("msa_resid", "label").agg(F.min_by("id", F.struct(apart, "id")).alias("nearest_id"))
    return mean.join(near, ["msa_resid", "label"]).select("msa_resid", "label", F.col("a").alias("angle1"), F.col("b").alias("angle2"), "n", "nearest_id")


def _bucket(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the maximum falls in the last one."""
    return F.when(high > low, F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def histogram(rows: DataFrame, column: str, bins: int = 15, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, low, n, density) of a numeric column: densities times bin widths add up to 1."""
    rows = rows.where(F.col(column).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.count("*").alias("_n"))
    at = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends))  # one row
    lo, hi = F.col("_lo"), F.col("_hi")
    width = (hi - lo) / bins
    out = at.groupBy(*keys, _bucket(F.col(column), lo, hi, bins).alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    return out.select(*keys, "bin", (lo + F.col("bin") * width).alias("low"), "n", F.when(width > 0, F.col("n") / (F.col("_n") * width)).alias("density"))


def histogram2d(rows: DataFrame, x: str, y: str, bins: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.groupBy(*keys).agg(*(f(c).alias(n) for f, c, n in ((F.min, x, "_xl"), (F.max, x, "_xh"), (F.min, y, "_yl"), (F.max, y, "_yh"))))
    at = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends))  # one row
    return at.groupBy(*keys, _bucket(F.col(x), F.col("_xl"), F.col("_xh"), bins).alias("bin_x"), _bucket(F.col(y), F.col("_yl"), F.col("_yh"), bins).alias("bin_y")).agg(F.count("*").alias("n"), F.log(F.count("*")).alias("log_n"))


def residue_scores(per_frame: DataFrame, n_frames: int | DataFrame, cutoff: float = 0.0) -> DataFrame:
    """(residue, score, mean_waters): interactions per frame, and waters at once in frames that have any.

    ``n_frames`` is a number, or a table of one row and column that has it.
    """
    out = per_frame.groupBy("residue").agg(F.sum("n").alias("score"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_waters"))
    if isinstance(n_frames, DataFrame):
        out = out.join(F.broadcast(n_frames.toDF("_frames")))  # one row
    else:
        out = out.withColumn("_frames", F.lit(n_frames))
    return out.withColumn("score", F.col("score") / F.col("_frames")).where(F.col("score") > cutoff).drop("_frames")


def angle_ranges(rows: DataFrame, pad: float = 0.1) -> DataFrame:
    """Ranges of both angles, widened by a tenth, and the sorted alignment columns."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("angle1", "angle2") for f, n in ((F.min, "min"), (F.max, "max"))]
    out = rows.agg(*ends, F.sort_array(F.collect_set("msa_resid")).alias("msa_resids"))
    for c in ("angle1", "angle2"):
        room = (F.col(f"max_{c}") - F.col(f"min_{c}")) * pad
        out = out.withColumn(f"low_{c}", F.col(f"min_{c}") - room).withColumn(f"high_{c}", F.col(f"max_{c}") + room)
    return out


def two_angles(pairs: DataFrame, ref1=(0.0, 10.0, 0.0), ref2=(10.0, 0.0, 10.0)) -> DataFrame:
    """Adds angle1, angle2 to rows with protein px, py, pz and water wx, wy, wz: at the water, between the protein atom and each reference point."""
    from ..functions.geometry import angle, sub

    if tuple(ref1) == tuple(ref2):
        raise ValueError("the two references must differ")
    p, w = tuple(F.col(f"p{a}") for a in "xyz"), tuple(F.col(f"w{a}") for a in "xyz")
    for k, ref in ((1, ref1), (2, ref2)):
        r = tuple(F.lit(float(v)) for v in ref)
        pairs = pairs.withColumn(f"angle{k}", angle(sub(p, w), sub(r, w)))
    return pairs


