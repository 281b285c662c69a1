"""Readers, runs and post-analyses, end to end on small files."""

import itertools

import numpy as np
import pytest

from tarnwork.operators import graph, network, sequence
from tarnwork.plans import cli, pipeline, post
from tarnwork.plans.config import parse_inputs
from tarnwork.plans.staging import numbered
from tarnwork.sources import readers, sinks


def line(serial, name, resname, chain, resid, x, y, z, element):
    return f"HETATM{serial:>5}  {name:<3} {resname} {chain}{resid:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           {element}"


def test_waters_of_two_chains(spark, tmp_path):
    """Chains A and B number their waters alike: all four stand, with three connections along the line."""
    rows = [line(k, "O", "HOH", chain, resid, 2.5 * k, 0, 0, "O") for k, (chain, resid) in enumerate(itertools.product("AB", (301, 302)))]
    (tmp_path / "two.pdb").write_text("\n".join(rows) + "\nEND\n")
    out = pipeline.analyze(readers.pdb(spark, str(tmp_path)), parse_inputs("network_type: water-water\nmax_distance: 3.0\nall: on"))
    assert out["nodes"].count() == 4 and out["edges"].count() == 3
    assert {(r["chain"], r["resid"]) for r in out["nodes"].collect()} == set(itertools.product("AB", (301, 302)))


def test_serials_that_do_not_ascend(spark, tmp_path):
    """Beyond 99,999 serials are stars or start again: atoms are then told by their place."""
    rows = [line(1, "O", "HOH", "A", 1, 0, 0, 0, "O"), line(1, "O", "HOH", "A", 2, 2.5, 0, 0, "O"), line(3, "O", "HOH", "A", 1, 5, 0, 0, "O").replace("    3", "*****", 1)]
    (tmp_path / "w.x.pdb").write_text("\n".join(rows) + "\n")
    got = sorted((r["atom_index"], r["mol_id"], r["serial"], r["structure_id"]) for r in readers.pdb(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, "w.x"), (2, 2, 1, "w.x"), (3, 3, None, "w.x")]


def test_frames_of_gro(spark, tmp_path):
    frame = "t= {}\n    2\n    1SOL     OW    1   {}.126   0.624   0.679\n    2SOL     OW    2   1.275   0.053   0.622\n   1.82060   1.82060   1.82060\n"
    (tmp_path / "md.gro").write_text(frame.format(0, 0) + frame.format(1, 1))
    rows = {(r["frame_idx"], r["atom_index"]): (r["x"], r["mol_id"]) for r in readers.gro(spark, str(tmp_path)).collect()}
    assert {k: (round(x, 3), m) for k, (x, m) in rows.items()} == {(0, 1): (1.26, 1), (0, 2): (12.75, 2), (1, 1): (11.26, 1), (1, 2): (12.75, 2)}


def test_packed_coordinates(spark):
    df = spark.createDataFrame([("[1.0 -2.5  3e1]",), (None,)], "c string").select(readers.packed("c").alias("c"))
    assert [r["c"] for r in df.collect()] == [[1.0, -2.5, 30.0], None]


def test_path_lengths_of_dealt_components(spark):
    rng = np.random.default_rng(6)
    links = {tuple(sorted(map(int, p))) for p in rng.integers(0, 150, (190, 2)) if p[0] != p[1]}
    n = spark.createDataFrame([("s", i) for i in range(150)], "k string, id long")
    e = spark.createDataFrame([("s", *p) for p in links], "k string, src long, dst long")
    d = np.full((150, 150), np.inf)
    for a, b in links:
        d[a, b] = d[b, a] = 1
    np.fill_diagonal(d, 0)
    for k in range(150):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    label = graph.components(n, e, ("k",))
    for sources in (512, 64, 7):
        got = {r["component"]: r["total"] for r in graph._path_totals(e, label, ("k",), sources).collect()}
        assert got == {c: int(d[np.isfinite(d[c])][:, np.isfinite(d[c])].sum()) for c in got} and len(got) > 1
    with pytest.raises(RuntimeError):
        graph.components(n, spark.createDataFrame([("s", i, i + 1) for i in range(149)], "k string, src long, dst long"), ("k",), rounds=1)


def test_names_and_numbers(spark):
    names = spark.createDataFrame([("1ABC_prepared",), ("1ABC",), ("zz_2XYZ_A",)], "name string")
    found = sequence.match_names(names, spark.createDataFrame([("1ABC",), ("2XYZ_first",), ("3NOT",)], "structure_id string")).collect()
    assert {r["structure_id"]: r["name"] for r in found} == {"1ABC": "1ABC", "2XYZ_first": "zz_2XYZ_A"}
    with pytest.raises(ValueError):
        sequence.match_names(names, names.withColumnRenamed("name", "structure_id"), most=2)
    rows = numbered(spark.range(1000).repartition(7), "n", "id").collect()
    assert all(r["id"] == r["n"] for r in rows) and len(rows) == 1000


def test_unknown_keys_are_told():
    with pytest.warns(UserWarning, match="max_distanse"):
        parse_inputs("max_distanse: 3.0")


def test_water_distances(spark):
    """A water's nearest atom counts, be it a hydrogen."""
    kind = "structure_id string, frame_idx int, atom_index long, mol_id long, role string, category string, name string, resid int, msa_resid int, x double, y double, z double"
    rows = [("s", 0, 1, 1, "PROT", "PROTEIN", "N", 5, 9, 0.0, 0.0, 0.0), ("s", 0, 2, 2, "O", "WAT", "O", 7, None, 3.0, 0.0, 0.0), ("s", 0, 3, 2, "H1", "WAT", "H1", 7, None, 2.0, 0.0, 0.0), ("s", 0, 4, 2, "H2", "WAT", "H2", 7, None, 3.0, 1.0, 0.0)]
    s = spark.createDataFrame(rows, kind)
    got = network.water_distances(network.water_protein(s, 3.3), s, "msa_resid").collect()
    assert [(r["residue"], r["distances"]) for r in got] == [(9, [2.0])]


def test_runs_and_their_analysis(spark, tmp_path):
    """Two runs, then every analysis."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rng = np.random.default_rng(2)
    base = rng.uniform(0, 8, (30, 3))
    for k in range(2):
        xyz = base + rng.normal(0, 0.1, base.shape)
        waters = [line(i + 1, "O", "HOH", "A", i + 1, *p, "O") for i, p in enumerate(xyz)]
        protein = [line(100 + i, "N", "ALA", "B", 1 + i, *(p + 1.0), "N").replace("HETATM", "ATOM  ") for i, p in enumerate(base[:6])]
        (folder / f"s{k}.pdb").write_text("\n".join(waters + protein) + "\nEND\n")
    text = f"structure_directory: {folder}\nmax_distance: 3.5\nall: on\ncluster_coordinates: on\nclustering_method: dbscan\neps: 0.8\nmin_cluster_samples: 2\nclassify_water: on"
    for name in ("a", "b"):
        tables = cli.run_inputs(spark, text, name, out)
    nodes = readers.results(spark, out, "nodes")
    assert nodes.count() == 2 * tables["nodes"].count() and nodes.where("category = 'WAT'").count() == 2 * 60
    flags = "histogram_metrics: on\nconcatenate: a, a\nresidue_interactions: on\ncalculate_densities: on\ncluster_concatenated: on\ncluster_method: dbscan\neps: 0.8\nmin_samples: 2\ncalculate_commonality: on\ncolor_by_conservation: all\nclassify_waters: on"
    found = cli.run_analysis(spark, flags, out)
    shown = {(r["metric"], r["run_name"]) for r in found["histograms"].select("metric", "run_name").distinct().collect()}
    assert shown == set(itertools.product(post.METRICS, ("pooled", "b")))
    score = found["commonality"].collect()
    assert len(score) == 4 and all(0 < r["score"] <= 1 for r in score)
    density = found["density"].agg({"n": "sum"}).first()[0]
    assert density == 120
    grid = readers.dx(spark, f"{out}/analysis/density_dx/part=all/*.txt")
    assert grid.count() == found["density"].count()
    counts = {k: found[k].count() for k in ("residues", "hotspots", "centers", "conserved_centers", "conserved_connections", "angles")}
    assert all(counts.values()), counts
    spots = "".join(r["value"] for r in spark.read.text(f"{out}/analysis/hotspots_pdb").collect())
    assert spots.count("HOH") == found["hotspots"].count()


def test_results_of_other_runs_stay(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "v int")
    for name, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.save_results(one.selectExpr(f"explode(sequence(1, {n})) AS v"), str(tmp_path), "t", name)
    got = {r["run_name"]: r["count"] for r in readers.results(spark, str(tmp_path), "t").groupBy("run_name").count().collect()}
    assert got == {"a": 3, "b": 2}
