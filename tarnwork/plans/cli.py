"""Command line: run a configuration, or analyse finished runs."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conserve, sequence
from ..sources import readers, sinks, trajectories
from . import pipeline, post
from .config import Config, parse_analysis, parse_inputs


def _atoms(spark: SparkSession, config: Config) -> DataFrame:
    """Atoms of a run: a trajectory's frames, a dynamic run's own file, or all structures of the folder."""
    inside = lambda name: name if "/" in name else f"{config.structure_directory.rstrip('/')}/{name}"
    if config.structure_type == "dynamic" and config.trajectory_file:
        return trajectories.trajectory(spark, inside(config.topology_file), inside(config.trajectory_file))
    if config.structure_type == "dynamic" and config.topology_file:
        name = inside(config.topology_file)
        return (readers.gro if name.lower().endswith(".gro") else readers.pdb)(spark, name)
    return readers.pdb(spark, config.structure_directory)


def run_inputs(spark: SparkSession, text: str, name: str, out: str = "tarnwork_output") -> dict:
    config = parse_inputs(text)
    atoms = _atoms(spark, config)
    msa = None
    if config.msa_indexing and config.alignment_file:
        aligned = readers.pir(spark, config.alignment_file)
        own = sequence.match_names(aligned, atoms)
        msa = sequence.msa_index(aligned.join(own, "name").select("structure_id", "sequence"))
    tables = pipeline.analyze(atoms, config, msa)
    for table, df in tables.items():
        sinks.save_results(df, out, table, name)
    if config.classify_water:
        sinks.save_csv(tables["classification"], f"{out}/{name}_classification")
    if config.cluster_coordinates:
        sinks.save_centers(tables["centers"], f"{out}/{name}_centers")
    if config.wants("save_coordinates"):
        sinks.save_pml(tables["connections"], f"{out}/{name}_network_pml")
        sinks.save_graph(tables["nodes"], tables["connections"], f"{out}/{name}_network_pdb")
    return tables


def _saved(spark: SparkSession, out: str) -> dict:
    """The result tables that runs have left."""
    found = {}
    for table in ("density", "cpl", "entropy", "interaction_counts"):
        try:
            found[table] = readers.results(spark, out, table)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def run_analysis(spark: SparkSession, text: str, out: str = "tarnwork_output") -> dict:
    flags = parse_analysis(text)
    found = {}
    if flags.get("histogram_metrics"):
        pooled = flags.get("concatenate")
        pooled = pooled if isinstance(pooled, (bool, list)) or not pooled else [pooled]
        found["histograms"] = post.histogram_metrics(post.metrics(_saved(spark, out), pooled), by_run=True)
    if flags.get("residue_interactions"):
        rows = readers.results(spark, out, "per_residue")
        frames = readers.results(spark, out, "nodes").agg(F.count_distinct("run_name", "structure_id", "frame_idx"))
        found["residues"] = conserve.residue_scores(rows, frames, float(flags.get("interaction_cutoff") or 0.0)).orderBy(F.col("residue").cast("int"))
    waters = lambda: readers.results(spark, out, "nodes").where("category = 'WAT'")
    if flags.get("calculate_densities"):
        frames = max(1, waters().select("run_name", "structure_id", "frame_idx").distinct().count())
        found["density"], found["hotspots"] = post.densities(waters(), frames)
        sinks.save_hotspots(found["hotspots"], f"{out}/analysis/hotspots_pdb")
        low, high = ([f(f"i{a}").alias(f"{n}{a}") for a in "xyz"] for n, f in (("l", F.min), ("h", F.max)))
        box = found["density"].agg(*low, *high).first()  # six numbers
        if box["lx"] is not None:
            moved = found["density"].select(*((F.col(f"i{a}") - box[f"l{a}"]).alias(f"i{a}") for a in "xyz"), "density")
            sinks.save_dx(moved, f"{out}/analysis/density_dx", tuple(box[f"h{a}"] - box[f"l{a}"] + 1 for a in "xyz"), tuple(float(box[f"l{a}"]) for a in "xyz"))
    if flags.get("cluster_concatenated"):
        points = waters().select(F.shiftrightunsigned(F.xxhash64("run_name", "structure_id", "frame_idx", "atom_index"), 1).alias("id"), "x", "y", "z")
        found["centers"] = post.concatenated_clusters(points, str(flags.get("cluster_method") or "hdbscan"), flags.get("eps"), int(flags.get("min_samples") or 10))
    if flags.get("calculate_commonality"):
        found["commonality"] = conserve.commonality(waters(), readers.results(spark, out, "centers"))
    if flags.get("color_by_conservation"):
        centers = readers.results(spark, out, "centers")
        coloured = post.conservation(waters(), centers, str(flags["color_by_conservation"]))
        found |= {f"conserved_{k}": v for k, v in coloured.items()}
        if "centers" in coloured:
            sinks.save_centers(coloured["centers"].join(centers.select("label", "x", "y", "z"), "label"), f"{out}/analysis/conserved_centers_pdb", "scaled")
        if "connections" in coloured:
            ends = [centers.select(F.col("label").alias(end), *(F.col(a).alias(f"{a}{k}") for a in "xyz")) for k, end in ((1, "src"), (2, "dst"))]
            sinks.save_scored_pml(coloured["connections"].join(ends[0], "src").join(ends[1], "dst"), f"{out}/analysis/conserved_connections_pml")
    if flags.get("classify_waters"):
        found["angles"] = conserve.histogram2d(readers.results(spark, out, "classification").withColumn("msa_resid", F.coalesce("msa_resid", "resid")), "angle1", "angle2", keys=("msa_resid",))
    return found


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tarnwork")
    parser.add_argument("--input", help="configuration of a run")
    parser.add_argument("--analysis", help="configuration of a post-analysis")
    parser.add_argument("--name", default="run")
    parser.add_argument("--output", default="tarnwork_output")
    args = parser.parse_args(argv)
    if not args.input and not args.analysis:
        parser.error("give --input or --analysis")
    spark = SparkSession.builder.appName("tarnwork").getOrCreate()
    if args.input:
        with open(args.input) as f:
            run_inputs(spark, f.read(), args.name, args.output)
    if args.analysis:
        with open(args.analysis) as f:
            for table, df in run_analysis(spark, f.read(), args.output).items():
                df.write.mode("overwrite").parquet(f"{args.output}/analysis/{table}")


if __name__ == "__main__":
    main()
