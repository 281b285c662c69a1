"""Writers: Parquet results, CSV, PDB, XYZ, FASTA, PIR, OpenDX, and scripts for a molecule viewer.

Text formats are rows (part, line number, text) written in order, one file a part; parts are single structures or
cluster tables, which is what these formats hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, table: str, run_name: str) -> None:
    """A run of the same name is replaced; other runs stay."""
    df.withColumn("run_name", F.lit(run_name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(f"{path.rstrip('/')}/{table}")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _text(rows: DataFrame, path: str, header: list[str] = (), footer: list[str] = ()) -> None:
    """``rows``: (part, n, value)."""
    spark = rows.sparkSession
    parts = rows.select("part").distinct()
    extra = [(-len(header) + k, v) for k, v in enumerate(header)] + [(2**40 + k, v) for k, v in enumerate(footer)]
    if extra:
        rows = rows.unionByName(parts.join(F.broadcast(spark.createDataFrame(extra, "n long, value string"))).select("part", "n", "value"))  # header and footer lines
    rows.repartition("part").sortWithinPartitions("part", "n").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def _numbered(df: DataFrame, part: str | None, order: tuple[str, ...]) -> DataFrame:
    key = F.col(part).cast("string") if part else F.lit("all")
    df = df.withColumn("part", key)
    return df.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))


def pdb_line(record: str = "ATOM"):
    """Fixed columns of a PDB atom from serial, name, resname, chain, resid, x, y, z, occupancy, b_factor."""
    return F.format_string(f"{record:<6}%5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", *(F.col(c) for c in ("serial", "name4", "resname", "chain", "resid", "x", "y", "z", "occupancy", "b_factor", "element")))


def save_centers(centers: DataFrame, path: str, b_factor: str | None = None) -> None:
    """Cluster centres as oxygens of dummy waters; resid is the label, or the place where that
    has more than four digits; the B-factor a score."""
    rows = _numbered(centers, None, ("label",)).select(
        "part", "n", (F.col("n") - 1).cast("int").alias("serial"), F.lit(" O").alias("name4"), F.lit("HOH").alias("resname"), F.lit("A").alias("chain"), F.when(F.col("label").between(0, 9999), F.col("label")).otherwise((F.col("n") - 1) % 10_000).cast("int").alias("resid"), "x", "y", "z",
        F.lit(1.0).alias("occupancy"), (F.col(b_factor).cast("double") if b_factor else F.lit(0.0)).alias("b_factor"), F.lit("O").alias("element"),
    )
    _text(rows.select("part", "n", pdb_line().alias("value")), path, footer=["END"])


def save_hotspots(hotspots: DataFrame, path: str) -> None:
    """Hotspots of a density grid as oxygens of dummy waters; the B-factor is the density."""
    rows = hotspots.withColumn("_order", -F.col("density"))
    rows = _numbered(rows, None, ("_order", "ix", "iy", "iz")).withColumn("label", F.col("n"))
    save_centers(rows.drop("part", "n"), path, "density")


def save_atoms(atoms: DataFrame, path: str, chain: str | None = None) -> None:
    """Atoms as PDB files, a file a structure; with ``chain`` only that chain and whatever isn't protein."""
    from ..functions.residues import is_protein

    if chain:
        atoms = atoms.where((F.col("chain") == chain) | ~is_protein(F.col("resname")))
    rows = _numbered(atoms, "structure_id", ("frame_idx", "atom_index")).withColumn("name4", F.concat(F.lit(" "), F.col("name")))
    for c, v in (("occupancy", 1.0), ("b_factor", 0.0)):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v))
    rows = rows.withColumn("serial", F.col("n").cast("int"))
    _text(rows.select("part", "n", pdb_line().alias("value")), path, footer=["END"])


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The nodes on active-region edges, as PDB."""
    on = edges.where("site_status = 'active_region'")
    ends = on.select("structure_id", "frame_idx", F.col("src").alias("atom_index")).union(on.select("structure_id", "frame_idx", F.col("dst").alias("atom_index"))).distinct()
    rows = nodes.join(ends, ["structure_id", "frame_idx", "atom_index"], "left_semi")
    save_atoms(rows.withColumn("resname", F.when(F.col("category") == "WAT", "HOH").otherwise("UNK")).withColumn("chain", F.lit("A")).withColumn("element", F.substring("name", 1, 1)), path)


def save_xyz(points: DataFrame, path: str, part: str | None = None) -> None:
    rows = _numbered(points, part, ("atom_index",))
    lines = rows.select("part", "n", F.format_string("%s\t%.3f %.3f %.3f", F.col("name"), F.col("x"), F.col("y"), F.col("z")).alias("value"))
    head = rows.groupBy("part").agg(F.count("*").cast("string").alias("value")).select("part", F.lit(-2).cast("long").alias("n"), "value")
    _text(lines.unionByName(head).unionByName(head.select("part", F.lit(-1).cast("long").alias("n"), F.lit("points").alias("value"))), path)


def save_fasta(sequences: DataFrame, path: str) -> None:
    rows = sequences.select(F.col("structure_id").alias("part"), F.posexplode(F.array(F.concat(F.lit(">"), "structure_id"), "sequence")).alias("n", "value"))
    _text(rows.withColumn("n", F.col("n").cast("long")), path)


def save_pir(aligned: DataFrame, path: str) -> None:
    rows = _numbered(aligned, None, ("structure_id",)).select("part", "n", F.concat(F.lit(">P1;"), "structure_id", F.lit("\nsequence:"), "structure_id", F.lit("::::::::\n"), "sequence", F.lit("*")).alias("value"))
    _text(rows, path)


def save_dx(grid: DataFrame, path: str, shape: tuple[int, int, int], origin=(0.0, 0.0, 0.0), delta: float = 1.0) -> None:
    """A dense OpenDX grid; absent voxels are 0."""
    nx, ny, nz = shape
    spark = grid.sparkSession
    flat = (F.col("ix") * ny + F.col("iy")) * nz + F.col("iz")
    rows = spark.range(nx * ny * nz).join(grid.select(flat.alias("id"), "density"), "id", "left").select(F.lit("all").alias("part"), F.col("id").alias("n"), F.format_string("%.6g", F.coalesce("density", F.lit(0.0))).alias("value"))
    head = [f"object 1 class gridpositions counts {nx} {ny} {nz}", "origin " + " ".join(f"{v:g}" for v in origin), f"delta {delta:g} 0 0", f"delta 0 {delta:g} 0", f"delta 0 0 {delta:g}", f"object 2 class gridconnections counts {nx} {ny} {nz}", f"object 3 class array type double rank 0 items {nx * ny * nz} data follows"]
    _text(rows, path, header=head, footer=['attribute "dep" string "positions"'])


def save_pml(edges: DataFrame, path: str) -> None:
    """A viewer script per structure: a dashed line a connection, spheres at its ends, one group."""
    rows = _numbered(edges, "structure_id", ("src", "dst"))
    active = F.col("site_status") == "active_region"
    value = F.format_string("distance Interaction%d, id %d, id %d\nset dash_color, %s, Interaction%d\nshow spheres, id %d+%d", F.col("n"), F.col("src"), F.col("dst"), F.when(active, "red").otherwise("blue"), F.col("n"), F.col("src"), F.col("dst"))
    _text(rows.select("part", "n", value.alias("value")), path, footer=["set dash_gap, 0", "set sphere_scale, 0.2", "hide labels", "group WaterNetwork, Interaction*"])


def save_scored_pml(pairs: DataFrame, path: str, score: str = "scaled") -> None:
    """Centre-centre connections coloured from blue (0) to red (1) by a scaled score; needs x1..z2."""
    rows = _numbered(pairs, None, (score, "src", "dst"))
    red = F.col(score)
    ends = [F.format_string("pseudoatom P%d%s, pos=[%.3f, %.3f, %.3f]", F.col("n"), F.lit(s), *(F.col(f"{a}{k}") for a in "xyz")) for s, k in (("a", 1), ("b", 2))]
    line = F.format_string("distance C%d, P%da, P%db\nset_color c%d, [%.3f, 0.000, %.3f]\nset dash_color, c%d, C%d", *([F.col("n")] * 4), red, 1 - red, F.col("n"), F.col("n"))
    _text(rows.select("part", "n", F.concat_ws("\n", *ends, line).alias("value")), path, footer=["group Conserved, C* P*"])


def save_angle_pml(clusters: DataFrame, path: str) -> None:
    """Pseudoatoms at the nearest water of each angle cluster, coloured by count; needs x, y, z, n, msa_resid, label."""
    rows = _numbered(clusters.withColumnRenamed("n", "members"), None, ("members", "msa_resid", "label"))
    top = F.max("members").over(Window.partitionBy("part"))
    share = F.col("members") / top
    value = F.format_string("pseudoatom A%d_%d, pos=[%.3f, %.3f, %.3f]\nset_color a%d, [%.3f, 0.000, %.3f]\ncolor a%d, A%d_%d", F.col("msa_resid"), F.col("label"), F.col("x"), F.col("y"), F.col("z"), F.col("n"), share, 1 - share, F.col("n"), F.col("msa_resid"), F.col("label"))
    _text(rows.select("part", "n", value.alias("value")), path, footer=["group Angles, A*"])
