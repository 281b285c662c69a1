"""Networks and metrics against values known for two small sets of waters, and operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import cluster, conserve, graph, network, sequence, spatial
from tarnwork.operators.spatial import KEYS
from tarnwork.plans.config import parse_analysis, parse_inputs, read_pairs
from tarnwork.plans.select import parse, rewrite_resids, select
from tarnwork.plans import pipeline
from tarnwork.sources import readers, sinks

EIGHT = {1: (-0.049, -2.524, 0.110), 4: (3.009, -2.734, 0.124), 7: (6.063, -2.713, 0.252), 10: (8.879, -2.397, -0.345), 13: (11.738, -1.545, -0.807), 16: (0.117, 3.792, 0.196), 19: (2.928, 4.989, -0.005), 22: (4.498, 2.397, -0.513)}


def pdb_text(points, resname="HOH", name="O"):
    rows = [f"HETATM{i:>5}  {name:<3} {resname} A{k * 3:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           O" for k, (i, (x, y, z)) in enumerate(points.items(), 1)]
    return "\n".join([*rows, "END"]) + "\n"


@pytest.fixture(scope="session")
def eight(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdb")
    (folder / "waters.pdb").write_text(pdb_text(EIGHT))
    return readers.pdb(spark, str(folder))


@pytest.mark.parametrize(("cutoff", "n_edges", "density", "sizes", "cpl", "entropy"), [(3.0, 1, 0.035714, [2, 1, 1, 1, 1, 1, 1], 0.142857, 0.811278), (3.8, 6, 0.214286, [5, 3], 1.666667, 1.0), (5.5, 9, 0.321429, [8], 2.142857, 1.905639)])
def test_eight_waters(eight, cutoff, n_edges, density, sizes, cpl, entropy):
    config = parse_inputs(f"network_type: water-water\nmax_distance: {cutoff}\nmax_neighbors: 10\nall: on")
    out = pipeline.analyze(eight, config)
    assert out["nodes"].count() == 8
    d = out["density"].first()
    assert d["n_edges"] == n_edges and d["density"] == pytest.approx(density, abs=1e-6)
    assert sorted((r["size"] for r in out["components"].collect()), reverse=True) == sizes
    assert out["cpl"].first()["cpl"] == pytest.approx(cpl, abs=1e-6)
    assert out["entropy"].first()["entropy"] == pytest.approx(entropy, abs=1e-6)
    if cutoff == 5.5:
        c = {r["id"]: r["clustering"] for r in out["clustering"].collect()}
        assert all(c[i] == pytest.approx(1 / 3) for i in (4, 7, 22)) and c[16] == c[19] == 1 and c[1] == 0


def points(spark, n, seed, size=5.0, grid=False):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, size, (n, 3))
    if grid:
        xyz = np.round(xyz)  # points on cell borders, pairs exactly at the cutoff
    rows = [("s", 0, i, i, "O", "WAT", "O", i, None, *map(float, p)) for i, p in enumerate(xyz)]
    kind = "structure_id string, frame_idx int, atom_index long, mol_id long, role string, category string, name string, resid int, msa_resid int, x double, y double, z double"
    return xyz, spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("grid", [False, True])
def test_radius_join(spark, grid):
    xyz, df = points(spark, 60, 3, grid=grid)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    got = {(r["l"]["atom_index"], r["r"]["atom_index"]) for r in spatial.radius_join(df, df, 1.0).collect()}
    assert got == {tuple(p) for p in np.argwhere(((xyz[:, None] - xyz[None]) ** 2).sum(-1) < 1.0)}
    got = {(r["l"]["atom_index"], r["r"]["atom_index"]) for r in spatial.radius_join(df, df, 2.0, 3).collect()}
    assert got == {(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (d[i, j], j))[:3] if d[i, j] < 2.0}
    box = (5.0, 5.0, 5.0)
    diff = xyz[:, None] - xyz[None]
    diff -= 5.0 * np.round(diff / 5.0)
    got = {(r["l"]["atom_index"], r["r"]["atom_index"]) for r in spatial.radius_join(df, df, 1.3, box=box).collect()}
    assert got == {tuple(p) for p in np.argwhere((diff**2).sum(-1) < 1.3**2)}


def test_cap_is_one_sided(spark):
    xyz, df = points(spark, 40, 5, 3.0)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(40) for j in np.argsort(d[i])[:3] if i < j and d[i, j] < 2}
    assert {(r["src"], r["dst"]) for r in network.water_water(df, 2.0, 3).collect()} == want
    with pytest.raises(ValueError):
        network.undirected(df, max_neighbors=1)


def test_paths_and_directed(spark):
    n = spark.createDataFrame([("s", i) for i in range(6)], "k string, id long")
    e = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 0, 3), ("s", 3, 2), ("s", 4, 5)], "k string, src long, dst long")
    found = {(r["src"], r["dst"]): r["path"] for r in graph.shortest_path(e, n, keys=("k",)).collect()}
    assert found[0, 2] == [0, 1, 2] and found[4, 5] == [4, 5] and (0, 4) not in found and found[2, 0] == [2, 1, 0]
    one = graph.shortest_path(e, n, 2, None, ("k",), directed=True).collect()
    assert [r["path"] for r in one] == [[2]]
    assert {r["id"]: r["component"] for r in graph.components(n, e, ("k",)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}


def random_graph(spark):
    """Nodes and edges of two keys: a hub, isolated nodes, small sets, edge ends that are no nodes, repeated and own edges."""
    rng = np.random.default_rng(7)
    e = {("s", int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 90, (150, 2))} | {("s", 600, 3 * k) for k in range(20)} | {("t", k, k + 1) for k in range(70)} | {("t", 500, 501)}
    n = [("s", 3 * k) for k in range(210)] + [("t", k) for k in range(71) if k != 40] + [("t", 500), ("t", 501), ("t", 501)]
    return n, sorted(e), spark.createDataFrame(n, "k string, id long"), spark.createDataFrame(sorted(e) + sorted(e)[:9], "k string, src long, dst long")


def walks(n, e, directed):
    """(key, src, dst) -> path with the smallest predecessor at each step, by a search from each node."""
    near = {}
    for k, a, b in e:
        if a != b:
            near.setdefault((k, a), set()).add(b)
            if not directed:
                near.setdefault((k, b), set()).add(a)
    out = {}
    for k, i in set(n):
        paths, front = {i: [i]}, [i]
        while front:
            before = {}
            for u in sorted(front, reverse=True):
                before |= {v: u for v in near.get((k, u), ()) if v not in paths}
            paths |= {v: [*paths[u], v] for v, u in before.items()}
            front = list(before)
        out |= {(k, i, v): p for v, p in paths.items()}
    return out


@pytest.mark.parametrize("directed", [False, True])
def test_lengths_of_all_pairs(spark, monkeypatch, directed):
    n, e, nodes, edges = random_graph(spark)
    want = walks(n, e, directed)
    staged, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: staged.append(1) or stage(df))
    found = graph._searches(nodes, edges, ("k",), directed, sources=64).collect()
    rows = graph.distances(nodes, edges, ("k",), directed).collect()
    # A path of 70 steps doesn't take a staged join each.
    assert len(staged) < 40
    for got in (found, rows):
        assert len(got) == len(want)
        assert {(r["k"], r["src"], r["dst"]): (r["d"], r["prev"]) for r in got} == {x: (len(p) - 1, p[-2] if len(p) > 1 else None) for x, p in want.items()}
    some = graph.distances(nodes, edges, ("k",), directed, nodes.where("id in (600, 501)")).collect()
    assert {(r["k"], r["src"], r["dst"]): r["d"] for r in some} == {x: len(p) - 1 for x, p in want.items() if x[1] in (600, 501)}


@pytest.mark.parametrize("directed", [False, True])
def test_paths_of_all_pairs(spark, monkeypatch, directed):
    n, e, nodes, edges = random_graph(spark)
    want = walks(n, e, directed)
    staged, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df: staged.append(1) or stage(df))
    got = graph.shortest_path(edges, nodes, keys=("k",), directed=directed).collect()
    assert len(staged) < 20 and len(got) == len(want) and {(r["k"], r["src"], r["dst"]): r["path"] for r in got} == want
    for options in ({"target": 9}, {"source": 600}) if directed else ({}, {"source": 600, "target": 12}):
        got = graph.shortest_path(edges, nodes, keys=("k",), directed=directed, separator="-", **options).collect()
        wanted = {x: "-".join(map(str, p)) for x, p in want.items() if options.get("source", x[1]) == x[1] and options.get("target", x[2]) == x[2]}
        assert len(got) == len(wanted) and {(r["k"], r["src"], r["dst"]): r["path"] for r in got} == wanted
    got = graph.shortest_path(edges, nodes, target=9, keys=("k",), directed=directed).collect()
    assert {(r["k"], r["src"], r["dst"]): r["path"] for r in got} == {x: p for x, p in want.items() if x[2] == 9}


def test_paths_lie_next_to_those_they_prolong(spark):
    """Source by source and depth first, as Parquet takes them at a fraction of the bytes that they have level by level."""
    n = [("s", 10007 + 13 * k) for k in range(400)]
    e = [("s", n[a][1], n[b][1]) for a in range(400) for b in (a + 1, a + 20) if b < 400 and (b - a > 1 or b % 20)]
    nodes, edges = spark.createDataFrame(n, "k string, id long"), spark.createDataFrame(e, "k string, src long, dst long")
    rows = [(r["src"], r["dst"], r["path"]) for r in graph.shortest_path(edges, nodes, keys=("k",), separator="-").where("src <> dst").collect()]
    want = {x[1:]: "-".join(map(str, p)) for x, p in walks(n, e, False).items() if len(p) > 1}
    assert len(rows) == len(want) and {(a, b): p for a, b, p in rows} == want
    last = ""
    for a, _, path in rows:
        parent = path.rpartition("-")[0]
        assert parent == str(a) or last == parent or last.startswith(f"{parent}-")
        last = path


def test_empty_inputs(spark):
    _, df = points(spark, 0, 1)
    edges = network.edges(network.undirected(df))
    nodes = network.nodes(df).withColumn("id", F.col("atom_index"))
    assert graph.density(nodes, edges).count() == graph.entropy(nodes, edges).count() == graph.components(nodes, edges).count() == 0
    assert cluster.dbscan(df, 1.0, 3, id_col="atom_index").count() == 0


def test_clusterings():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 10)] + [[[50.0, 50, 50]]])
    for labels in (cluster.hdbscan_labels(x, 5), cluster.optics_labels(x, 5, 1.0)):
        assert labels[-1] == -1 and len(set(labels[:-1])) == 3
        assert all(len(set(labels[k : k + 20])) == 1 for k in (0, 20, 40))


def prim(x, k):
    """The spanning tree by comparing all points at each step."""
    n = len(x)
    core = np.array([np.sort(np.sqrt(((x - p) ** 2).sum(1)))[min(k, n) - 1] for p in x])
    best, link, done, at, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        closer = ~done & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.where(done, np.inf, best).argmin())
        out.append((link[at], at, best[at]))
    return sorted(out, key=lambda e: (e[2], e[0], e[1]))


@pytest.mark.parametrize("columns", [1, 2, 3, 5])
def test_spanning_tree(columns):
    rng = np.random.default_rng(columns)
    shape = (150, columns)
    sets = [rng.normal(0, 3, shape), rng.integers(0, 4, shape), rng.normal(0, 0.1, shape) + 1000 * rng.integers(0, 3, (150, 1)), np.ones(shape), np.round(rng.standard_cauchy(shape), 1), rng.normal(0, 3, shape)[:2]]
    for x in sets:
        for k in (1, 3, 10):
            assert cluster._tree(x.astype(float), k).tolist() == [list(map(float, e)) for e in prim(x.astype(float), k)]


def test_hdbscan_of_many_points(monkeypatch):
    x = np.round(np.random.default_rng(1).uniform(0, 180, (20_000, 2)), 4)
    compared, near = [0], cluster._near_pairs

    def counted(*args):
        for found in near(*args):
            compared[0] += len(found[0])
            yield found

    monkeypatch.setattr(cluster, "_near_pairs", counted)
    labels = cluster.hdbscan_labels(x, 3)
    assert 0 < compared[0] < 100 * len(x) and labels.max() > 1000
    # Points without a place are noise and change nothing else.
    some = cluster.hdbscan_labels(np.vstack([x[:500], [[np.nan, 1.0], [np.inf, 2.0]]]), 3)
    assert some[-2:].tolist() == [-1, -1] and (some[:-2] == cluster.hdbscan_labels(x[:500], 3)).all()


def test_selection(spark, eight):
    assert parse("not resid 3 and name O* or protein") == ("or", ("and", ("not", ("resid", ("3",))), ("name", ("O*",))), ("protein",))
    assert {r["serial"] for r in select(eight, "resid 3 6-9").collect()} == {1, 4, 7}
    assert {r["serial"] for r in select(eight, "around 3.2 (resid 3)").collect()} == {4}
    assert {r["serial"] for r in select(eight, "point 0 4 0 1.0 or resid 24").collect()} == {16, 22}
    assert rewrite_resids("resid 12 and name CA", {12: 15}) == "resid 15 and name CA"
    for bad in ("resid", "foo 3", "(resid 3", "resid 3 )"):
        with pytest.raises(ValueError):
            parse(bad)


def test_config():
    assert read_pairs("a: 1 ; x\n\n; c\nb:two") == [("a", "1"), ("b", "two")]
    c = parse_inputs("max_neighbors: 5\nactive_site_reference: resid#35\ndensity: on\n\ngraph_entropy: off")
    assert c.max_neighbors == 5 and c.active_region_reference == "resid 35" and c.wants("density") and not c.wants("graph_entropy")
    with pytest.raises(ValueError):
        parse_inputs("max_neighbors: 1")
    assert parse_analysis("a: x,y\nconcatemate: on") == {"a": ["x", "y"], "concatenate": True}


def test_sequences(spark):
    a = spark.createDataFrame([("p", "A-CD-"), ("q", "AB-DE")], "structure_id string, sequence string")
    ix = sequence.msa_index(a)
    assert [(r["seq_pos"], r["msa_col"]) for r in ix.where("structure_id = 'p'").orderBy("seq_pos").collect()] == [(1, 1), (2, 3), (3, 4)]
    got = {(r["structure_id"], r["ref_resid"]): r["resid"] for r in sequence.translate(ix, "p", spark.createDataFrame([(2,)], "resid int")).collect()}
    assert got == {("p", 2): 2, ("q", 2): 2}
    s = sequence.similarity(spark.createDataFrame([("ABCD", "ABD"), ("", "")], "a string, b string")).collect()
    assert [r["similarity"] for r in s] == [3 / 4, 0.0]
    assert sequence.align_to_first(["ACD", "AD"]) == ["ACD", "A-D"]


def test_superposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 3))
    q = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    rows = [("a", i, "CA", *map(float, p)) for i, p in enumerate(x)] + [("b", i, "CA", *map(float, p)) for i, p in enumerate(x @ q.T + [1, 2, 3])]
    atoms = spark.createDataFrame(rows, "structure_id string, resid int, name string, x double, y double, z double")
    moved = sequence.transform(atoms, sequence.superpose(atoms, "a")).where("structure_id = 'b'").orderBy("resid").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in moved], x, atol=1e-9)


def test_files(spark, tmp_path, eight):
    two = pdb_text(EIGHT).replace("END\n", "")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "t.pdb").write_text(f"MODEL 1\n{two}ENDMDL\nMODEL 2\n{two}ENDMDL\n")
    assert {r["frame_idx"]: r["count"] for r in readers.pdb(spark, str(tmp_path / "m")).groupBy("frame_idx").count().collect()} == {0: 8, 1: 8}
    (tmp_path / "f.fa").write_text(">a\nAC\nD\n>b\nEF\n")
    assert [(r["name"], r["sequence"]) for r in readers.fasta(spark, str(tmp_path / "f.fa")).collect()] == [("a", "ACD"), ("b", "EF")]
    (tmp_path / "p.pir").write_text(">P1;a\nsequence:a\nA-C\nD*\n>P1;b\nx\nAB*\n")
    assert {r["name"]: r["sequence"] for r in readers.pir(spark, str(tmp_path / "p.pir")).collect()} == {"a": "A-CD", "b": "AB"}
    (tmp_path / "s.txt").write_text("ALA 1 H\nGLY 2 L\n")
    assert readers.secondary_structure(spark, str(tmp_path / "s.txt")).count() == 2
    grid = spark.createDataFrame([(0, 1, 1, 2.5), (1, 0, 0, 3.0)], "ix long, iy long, iz long, density double")
    sinks.save_dx(grid, str(tmp_path / "dx"), (2, 2, 2))
    back = {(r["ix"], r["iy"], r["iz"]): r["density"] for r in readers.dx(spark, str(tmp_path / "dx" / "part=all" / "*.txt")).collect()}
    assert back == {(0, 1, 1): 2.5, (1, 0, 0): 3.0}
    sinks.save_atoms(eight, str(tmp_path / "out"))
    again = readers.pdb(spark, str(tmp_path / "out" / "part=waters" / "*.txt"))
    assert sorted((r["x"], r["y"], r["z"]) for r in again.collect()) == sorted(EIGHT.values())
    centers = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.5)], "label int, x double, y double, z double, s double")
    sinks.save_centers(centers, str(tmp_path / "cen"), "s")
    assert "1.000   2.000   3.000  1.00  0.50" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "cen")).collect())


def test_conservation_of_nothing(spark):
    _, df = points(spark, 10, 2)
    far = spark.createDataFrame([(0, 99.0, 99.0, 99.0)], "label int, x double, y double, z double")
    r = conserve.commonality(df, far).first()
    assert r["score"] == 0.0 and r["unique_waters"] == 10
    assert conserve.scaled(conserve.occupancy(df, far), "n").first()["scaled"] == 0.0


def test_streamed_frames(spark, tmp_path):
    from tarnwork.streaming import frames

    _, df = points(spark, 30, 4)
    df.write.parquet(str(tmp_path / "in"))
    stream = frames.read_sites(spark, str(tmp_path / "in"), df.schema)
    frames.frame_metrics(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2.0).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n_nodes")).first()[0]
    assert got == 30 and not math.isnan(got) and KEYS


def test_every_query_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
