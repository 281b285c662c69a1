"""Connections between water oxygens, hydrogens and polar protein atoms, and the graphs they make.

Sites: structure_id, frame_idx, atom_index, mol_id (the residue, of which there is one in a frame), role (O, H1, H2, PROT),
category (WAT, PROTEIN), name, chain (may be absent), resid, msa_resid, x, y, z.  A connection is a row (src, dst, atom_name, connection_type, site_status, classification, distance,
angle); edges are distinct (src, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, angle_at, point, squared, sub
from ..functions.residues import backbone, backbone_donor, is_heavy
from ..plans.staging import numbered
from .spatial import KEYS, radius_join

COLUMNS = (*KEYS, "src", "dst", "atom_name", "connection_type", "site_status", "classification", "distance", "angle")


def first_oxygens(sites: DataFrame) -> DataFrame:
    """One oxygen for each water: the first by index."""
    first = Window.partitionBy(*KEYS, "mol_id").orderBy("atom_index")
    return sites.where("category = 'WAT' and role = 'O'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _shaped(rows: DataFrame) -> DataFrame:
    have = {"site_status": F.lit("None"), "classification": F.lit(None).cast("string"), "angle": F.lit(None).cast("double")}
    return rows.select(*(F.col(c) if c in rows.columns else have[c].alias(c) for c in COLUMNS))


def water_water(sites: DataFrame, cutoff: float = 3.3, max_neighbors: int = 10, box=None) -> DataFrame:
    """src < dst with dst among the nearest ``max_neighbors`` of src, src itself being one of them."""
    o = first_oxygens(sites)
    near = radius_join(o, o, cutoff, max_neighbors, box=box).where("l.atom_index < r.atom_index")
    return _shaped(near.select(*KEYS, F.col("l.atom_index").alias("src"), F.col("r.atom_index").alias("dst"), F.col("l.name").alias("atom_name"), F.lit("WAT-WAT").alias("connection_type"), "distance"))


def water_protein(sites: DataFrame, cutoff: float = 3.3, max_neighbors: int = 10, box=None) -> DataFrame:
    """Protein atom to water, among each water's nearest ``max_neighbors`` protein atoms."""
    near = radius_join(first_oxygens(sites), sites.where("category = 'PROTEIN'"), cutoff, max_neighbors, box=box)
    return _shaped(
        near.select(
            *KEYS, F.col("r.atom_index").alias("src"), F.col("l.atom_index").alias("dst"), F.col("r.name").alias("atom_name"), F.lit("WAT-PROT").alias("connection_type"), backbone(F.col("r.name")).alias("classification"), "distance"
        )
    )


def _residue(sites: DataFrame) -> tuple[DataFrame, list[str]]:
    """Sites with a chain, and the columns that tell a residue."""
    chain = F.coalesce("chain", F.lit("")) if "chain" in sites.columns else F.lit("")
    return sites.withColumn("chain", chain), [*KEYS, "category", "chain", "resid"]


def with_status(connections: DataFrame, sites: DataFrame, active: DataFrame) -> DataFrame:
    """site_status: active_region if an end's residue (category, chain and resid) is in the active region."""
    who, by = _residue(sites)
    marked = _residue(active)[0].select(*by).distinct().withColumn("_on", F.lit(True))
    state = who.join(marked, by, "left").select(*KEYS, "atom_index", F.coalesce("_on", F.lit(False)).alias("_on"))
    out = connections.drop("site_status")
    for end in ("src", "dst"):
        out = out.join(state.withColumnRenamed("atom_index", end).withColumnRenamed("_on", f"_{end}"), [*KEYS, end], "left")
    status = F.when(F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False)), "active_region").otherwise("not_active_region")
    return _shaped(out.withColumn("site_status", status).drop("_src", "_dst"))


def undirected(sites: DataFrame, cutoff: float = 3.3, max_neighbors: int = 10, water_only: bool = False, active: DataFrame | None = None, active_only: bool = False, box=None) -> DataFrame:
    if max_neighbors < 2:
        raise ValueError("max_neighbors must be at least 2: an atom is its own nearest neighbour")
    if active is not None and active_only:
        sites, by = _residue(sites)
        sites = sites.join(_residue(active)[0].select(*by).distinct(), by, "left_semi")
    found = water_water(sites, cutoff, max_neighbors, box)
    if not water_only:
        found = found.unionByName(water_protein(sites, cutoff, max_neighbors, box))
    return with_status(found, sites, active) if active is not None else found


def _oxygen_of(sites: DataFrame) -> DataFrame:
    o = first_oxygens(sites)
    return o.select(*KEYS, "mol_id", F.col("atom_index").alias("o_index"), *(F.col(a).alias(f"o{a}") for a in "xyz"))


def donor_heavy(hydrogens: DataFrame, heavy: DataFrame) -> DataFrame:
    """Each hydrogen's nearest heavy atom in its residue, as columns dx, dy, dz."""
    h = heavy.select(*KEYS, "mol_id", *(F.col(a).alias(f"d{a}") for a in "xyz"), F.col("atom_index").alias("_d"))
    near = hydrogens.join(h, [*KEYS, "mol_id"]).withColumn("_at", F.struct(((F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2 + (F.col("z") - F.col("dz")) ** 2).alias("d"), "_d"))
    best = near.groupBy(*KEYS, "atom_index").agg(F.min_by(F.struct("dx", "dy", "dz"), "_at").alias("_b")).select(*KEYS, "atom_index", "_b.*")
    return hydrogens.join(best, [*KEYS, "atom_index"], "left")


def directed(sites: DataFrame, cutoff: float = 2.5, max_neighbors: int = 10, angle_criteria: float | None = None, water_only: bool = False, reverse: bool = False, box=None) -> DataFrame:
    """Hydrogen-bond donor to acceptor; a water's node is its oxygen.

    ``reverse`` probes from oxygens to hydrogens as well, and adds what that finds.  With ``angle_criteria`` a connection
    needs an angle of so many degrees.
    """
    oxygens = _oxygen_of(sites)
    water_h = sites.where("category = 'WAT' and role in ('H1', 'H2')").join(oxygens, [*KEYS, "mol_id"])
    water_o = first_oxygens(sites)
    parts = []
    near = radius_join(water_h, water_o, cutoff, max_neighbors, box=box)
    if reverse:
        near = near.unionByName(radius_join(water_o, water_h, cutoff, max_neighbors, box=box).select(*KEYS, F.col("r").alias("l"), F.col("l").alias("r"), "distance"))
    donor = tuple(F.col(f"l.o{a}") for a in "xyz")
    pairs = near.where(F.col("l.mol_id") != F.col("r.mol_id")) if reverse else near.where((F.col("l.mol_id") != F.col("r.mol_id")) & (F.col("l.o_index") < F.col("r.atom_index")))
    parts.append(
        pairs.select(
            *KEYS, F.col("l.o_index").alias("src"), F.col("r.atom_index").alias("dst"), F.col("l.name").alias("atom_name"), F.lit("WAT-WAT").alias("connection_type"), F.lit(None).cast("string").alias("classification"), "distance", angle_at(point("l."), point("r."), donor).alias("angle")
        )
    )
    if not water_only:
        protein = sites.where("category = 'PROTEIN'")
        heavy, hydrogens = protein.where(is_heavy(F.col("name"))), protein.where(~is_heavy(F.col("name")) & F.col("name").contains("H"))
        near = radius_join(donor_heavy(hydrogens, heavy), water_o, cutoff, max_neighbors, box=box)
        parts.append(
            near.select(
                *KEYS, F.col("l.atom_index").alias("src"), F.col("r.atom_index").alias("dst"), F.col("l.name").alias("atom_name"), F.lit("WAT-PROT").alias("connection_type"), backbone_donor(F.col("l.name")).alias("classification"), "distance",
                angle_at(point("l."), point("r."), tuple(F.col(f"l.d{a}") for a in "xyz")).alias("angle"),
            )
        )
        near = radius_join(water_h, heavy, cutoff, max_neighbors, box=box)
        # This angle is taken between the directions heavy to oxygen and oxygen to hydrogen.
        parts.append(
            near.select(
                *KEYS, F.col("l.o_index").alias("src"), F.col("r.atom_index").alias("dst"), F.col("r.name").alias("atom_name"), F.lit("WAT-PROT").alias("connection_type"), backbone(F.col("r.name")).alias("classification"), "distance",
                angle(sub(point("r."), donor), sub(donor, point("l."))).alias("angle"),
            )
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if angle_criteria is not None:
        found = found.where(F.col("angle") >= angle_criteria)
    return _shaped(found.dropDuplicates([*KEYS, "src", "dst", "distance"]) if reverse else found)


def water_distances(connections: DataFrame, sites: DataFrame, by: str = "resid", box=None) -> DataFrame:
    """(keys, residue, distances): for each water-protein connection the least distance between the protein atom and any of
    the water's atoms, ascending, by residue (``by``: resid or msa_resid)."""
    at = lambda p: tuple(F.col(f"{p}{a}") for a in "xyz")
    protein = sites.where("category = 'PROTEIN'").select(*KEYS, F.col("atom_index").alias("p"), F.col(by).alias("residue"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    water = sites.where("category = 'WAT'").select(*KEYS, "mol_id", *(F.col(a).alias(f"w{a}") for a in "xyz"))
    ends = connections.where("connection_type = 'WAT-PROT'").select(*KEYS, "src", "dst").distinct()
    pairs = ends.select(*KEYS, F.col("src").alias("p"), F.col("dst").alias("w")).union(ends.select(*KEYS, F.col("dst").alias("p"), F.col("src").alias("w")))
    oxygen = first_oxygens(sites).select(*KEYS, F.col("atom_index").alias("w"), "mol_id")
    met = pairs.join(protein, [*KEYS, "p"]).join(oxygen, [*KEYS, "w"]).join(water, [*KEYS, "mol_id"])
    least = met.groupBy(*KEYS, "residue", "p", "w").agg(F.min(F.sqrt(squared(at("p"), at("w"), box))).alias("d"))
    return least.groupBy(*KEYS, "residue").agg(F.sort_array(F.collect_list("d")).alias("distances"))


def edges(connections: DataFrame) -> DataFrame:
    """Distinct (src, dst) with the attributes of the nearest of their connections."""
    rest = [c for c in connections.columns if c not in (*KEYS, "src", "dst")]
    return connections.groupBy(*KEYS, "src", "dst").agg(F.min_by(F.struct(*rest), F.struct("distance", "connection_type", "atom_name")).alias("_e")).select(*KEYS, "src", "dst", "_e.*")


def nodes(sites: DataFrame, water_only: bool = False) -> DataFrame:
    """A node for each water oxygen and, unless ``water_only``, each protein atom."""
    water = first_oxygens(sites)
    return water if water_only else water.unionByName(sites.where("category = 'PROTEIN'"))


def subgraph(connections: DataFrame, selection: str = "all") -> DataFrame:
    """Edges of a selection: all, active_region or not_active_region."""
    if selection not in ("all", "active_region", "not_active_region"):
        raise ValueError(f"unknown selection {selection!r}")
    return connections if selection == "all" else connections.where(F.col("site_status") == selection)


def disjoint_union(graphs: list[DataFrame]) -> DataFrame:
    """One table of several node tables, numbered through from 0."""
    rows = graphs[0].withColumn("graph", F.lit(0))
    for k, g in enumerate(graphs[1:], 1):
        rows = rows.unionByName(g.withColumn("graph", F.lit(k)))
    return numbered(rows, "node", "graph", *KEYS, "atom_index")
