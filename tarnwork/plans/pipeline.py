"""From atoms to networks and metrics: one lazy plan, keyed by structure and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.residues import is_polar, is_protein, is_water
from ..operators import cluster, conserve, graph, network, sequence, spatial
from ..operators.spatial import KEYS
from .config import Config
from .select import select


def sites(atoms: DataFrame, config: Config, msa: DataFrame | None = None) -> DataFrame:
    """Waters (first oxygen and two hydrogens a residue) and polar protein atoms, with hydrogens if asked for."""
    water = is_water(F.col("resname"), config.water_name)
    protein = is_protein(F.col("resname"))
    # A residue is a molecule; where the reader does not number them, chain and number tell it.
    if "mol_id" not in atoms.columns:
        residue = [c for c in ("chain", "resid", "icode") if c in atoms.columns]
        atoms = atoms.withColumn("mol_id", F.min("atom_index").over(Window.partitionBy(*KEYS, *residue)).cast("long"))
    if "chain" not in atoms.columns:
        atoms = atoms.withColumn("chain", F.lit(None).cast("string"))
    custom = atoms.where("false").select(*KEYS, "atom_index")
    if config.custom_selection:
        custom = select(atoms, config.custom_selection).select(*KEYS, "atom_index")
    w = atoms.where(water & F.col("name").rlike("[HO]"))
    kind = F.when(F.col("name").startswith("O"), "O").when(F.col("name").contains("H"), "H")
    rank = F.row_number().over(Window.partitionBy(*KEYS, "mol_id", "kind").orderBy("atom_index"))
    w = w.withColumn("kind", kind).where("kind is not null").withColumn("rank", rank)
    role = F.when((F.col("kind") == "O") & (F.col("rank") == 1), "O").when((F.col("kind") == "H") & (F.col("rank") <= 2), F.concat(F.lit("H"), "rank"))
    columns = [*KEYS, "atom_index", "mol_id", "role", "category", "name", "chain", "resid", F.lit(None).cast("int").alias("msa_resid"), "x", "y", "z"]
    w = w.withColumn("role", role).where("role is not null").withColumn("category", F.lit("WAT")).select(*columns)
    if not config.include_hydrogens and not config.directed:
        w = w.where("role = 'O'")
    if config.network_type == "water-water":
        return w
    body = atoms.where(protein).unionByName(atoms.join(custom, [*KEYS, "atom_index"], "left_semi")).dropDuplicates([*KEYS, "atom_index"])
    polar = body.where(is_polar(F.col("name")))
    p = polar
    if config.include_hydrogens or config.directed:
        h = body.where(F.col("name").rlike("^[0-9]*H"))
        heavy = polar.select(*KEYS, "mol_id", *(F.col(a).alias(f"_{a}") for a in "xyz"))
        near = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in "xyz"), F.lit(0.0)) < 1.2**2
        p = polar.unionByName(h.join(heavy, [*KEYS, "mol_id"]).where(near).select(*h.columns).distinct())
    p = p.withColumn("role", F.lit("PROT")).withColumn("category", F.lit("PROTEIN")).select(*columns)
    if msa is not None:
        p = sequence.attach_msa(p, msa).select(*w.columns)
    return w.unionByName(p)


def build(atoms: DataFrame, config: Config, msa: DataFrame | None = None) -> dict[str, DataFrame]:
    """sites, nodes, connections, edges of a run."""
    config.check()
    s = sites(atoms, config, msa)
    active = None
    if config.active_region_reference:
        reference = select(atoms, config.active_region_reference)
        if config.active_region_com:
            reference = spatial.centre_of_mass(reference)
        active = spatial.active_region(s, reference, config.active_region_radius)
    only = config.network_type == "water-water"
    if config.directed:
        c = network.directed(s, config.max_distance, config.max_neighbors, config.angle_criteria, only, reverse=config.structure_type == "dynamic")
        c = network.with_status(c, s, active) if active is not None else c
    else:
        c = network.undirected(s, config.max_distance, config.max_neighbors, only, active, config.active_region_only)
    n = network.nodes(s, only)
    if config.active_region_only and active is not None:
        n = n.join(active.select(*KEYS, "category", "atom_index"), [*KEYS, "category", "atom_index"], "left_semi")
    return {"sites": s, "nodes": n.withColumn("id", F.col("atom_index")), "connections": c, "edges": network.edges(c)} | ({"active": active} if active is not None else {})


def analyze(atoms: DataFrame, config: Config, msa: DataFrame | None = None) -> dict[str, DataFrame]:
    """Networks and the metrics that the configuration asks for; what isn't asked for is never planned."""
    out = build(atoms, config, msa)
    n, e = out["nodes"].select(*KEYS, "id"), network.subgraph(out["edges"], config.selection)
    if config.selection != "all":
        n = e.select(*KEYS, F.col("src").alias("id")).union(e.select(*KEYS, F.col("dst").alias("id"))).distinct()
    if config.wants("density"):
        out["density"] = graph.density(n, e)
    if config.wants("interaction_counts"):
        out["interaction_counts"] = graph.interaction_counts(out["edges"])
    if config.wants("per_residue_interactions"):
        out["per_residue"] = graph.per_residue(e, out["sites"], by="msa_resid" if msa is not None else "resid")
    if config.wants("graph_entropy"):
        out["entropy"] = graph.entropy(n, e)
    if config.wants("clustering_coefficient"):
        out["clustering"] = (graph.directed_clustering if config.directed else graph.clustering)(n, e)
    if config.wants("connected_components"):
        out["components"] = graph.component_sizes(graph.components(n, e))
    if config.wants("characteristic_path_length"):
        out["cpl"] = graph.characteristic_path_length(n, e)
    if config.analysis_conditions.get("shortest_path"):
        out["shortest_path"] = graph.shortest_path(e, n, directed=config.directed)
    if config.wants("save_coordinates"):
        out["coordinates"] = graph.coordinates(out["nodes"], config.selection, out.get("active"), water_only=True)
    if config.classify_water:
        out["classification"] = classify(out, config)
    if config.cluster_coordinates:
        points = out["nodes"].where("category = 'WAT'").select(F.shiftrightunsigned(F.xxhash64(*KEYS, "id"), 1).alias("id"), "x", "y", "z")
        labels = cluster.cluster(points, config.clustering_method, eps=config.eps, min_samples=config.min_cluster_samples)
        out["centers"] = cluster.centers(labels.join(points, "id"))
    return out


def classify(run: dict[str, DataFrame], config: Config) -> DataFrame:
    """Two-angle rows of the water-protein connections."""
    s = run["sites"]
    c = run["connections"].where("connection_type = 'WAT-PROT'")
    at = s.select(*KEYS, "atom_index", "category", "resid", "msa_resid", "name", "x", "y", "z")
    ends = [at.select(*KEYS, F.col("atom_index").alias(end), *(F.col(k).alias(f"{end}_{k}") for k in ("category", "resid", "msa_resid", "name", "x", "y", "z"))) for end in ("src", "dst")]
    rows = c.select(*KEYS, "src", "dst", "classification").join(ends[0], [*KEYS, "src"]).join(ends[1], [*KEYS, "dst"])
    first = F.col("src_category") == "PROTEIN"
    pick = lambda k, p: F.when(first if p else ~first, F.col(f"src_{k}")).otherwise(F.col(f"dst_{k}"))
    rows = rows.select(*KEYS, pick("resid", True).alias("resid"), pick("msa_resid", True).alias("msa_resid"), "src", "dst", pick("name", True).alias("protein_atom"), "classification", *(pick(a, True).alias(f"p{a}") for a in "xyz"), *(pick(a, False).alias(f"w{a}") for a in "xyz"))
    return conserve.two_angles(rows, config.classification_reference1, config.classification_reference2)
