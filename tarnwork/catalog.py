"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .operators import cluster, conserve, graph, network, sequence, spatial, voxels
from .plans import adapters as a
from .plans import pipeline
from .plans.config import Config
from .plans.select import select
from .plans.staging import stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROT = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
BOX = (6.0, 6.0, 6.0)
SID = ("structure_id",)

S = """s AS (SELECT label AS structure_id, vec_id AS atom_index, vec_id // 8 AS resid, 'WAT' AS category, 'O' AS name,
  embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"""
R = """s AS (SELECT label AS structure_id, vec_id AS atom_index, vec_id // 8 AS resid, CASE WHEN vec_id % 4 = 0 THEN 'PROTEIN' ELSE 'WAT' END AS category,
  CASE WHEN vec_id % 4 = 0 THEN ['N', 'O', 'OG', 'ND1'][(vec_id // 4 % 4 + 1)::INT] ELSE 'O' END AS name,
  embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"""
D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"


def _pairs(name: str, left: str, right: str, cutoff: float, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.structure_id, a.atom_index AS u, b.atom_index AS v, b.name AS vname, b.resid AS vresid, a.resid AS uresid, sqrt({D2}) AS d,
  row_number() OVER (PARTITION BY a.structure_id, a.atom_index ORDER BY sqrt({D2}), b.atom_index) AS n
  FROM s a JOIN s b ON a.structure_id = b.structure_id AND {D2} < {cutoff * cutoff} WHERE a.category = '{left}' AND b.category = '{right}') WHERE n <= {k})"""


WW = _pairs("w", "WAT", "WAT", 1.0, 10)
E_ = "e AS (SELECT structure_id, u AS src, v AS dst, d FROM w WHERE u < v)"
B_ = "b AS (SELECT structure_id, src, dst FROM e UNION SELECT structure_id, dst, src FROM e)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _net(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes and staged edges of the water network that the graph queries share."""
    s = a.sites(spark, sf_dir)
    return s.select("structure_id", F.col("atom_index").alias("id")), stage(network.edges(network.water_water(s, 1.0, k)))


@query(f"WITH {S}, {_pairs('w', 'WAT', 'WAT', 1.0, 3)} SELECT structure_id, u AS src, v AS dst, round(d, 6) AS distance FROM w WHERE u < v")
def ww_connections(spark, sf_dir):
    return network.water_water(a.sites(spark, sf_dir), 1.0, 3).select("structure_id", "src", "dst", F.round("distance", 6).alias("distance"))


WP = _pairs("p", "WAT", "PROTEIN", 1.2, 4)


@query(f"WITH {R}, {WP} SELECT structure_id, v AS src, u AS dst, vname AS atom_name, CASE WHEN vname IN ('O', 'N') THEN 'backbone' ELSE 'side-chain' END AS classification, round(d, 6) AS distance FROM p")
def wp_connections_backbone(spark, sf_dir):
    return network.water_protein(a.sites(spark, sf_dir, True), 1.2, 4).select("structure_id", "src", "dst", "atom_name", "classification", F.round("distance", 6).alias("distance"))


@query(f"""WITH {R}, r AS (SELECT * FROM s WHERE category = 'PROTEIN' AND resid % 5 = 0)
SELECT structure_id, atom_index, category FROM s a WHERE EXISTS (SELECT 1 FROM r b WHERE a.structure_id = b.structure_id AND {D2} <= 1.44)
OR a.category = 'PROTEIN' AND EXISTS (SELECT 1 FROM r b WHERE a.structure_id = b.structure_id AND a.resid = b.resid)""")
def active_region_sites(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    return spatial.active_region(s, s.where("category = 'PROTEIN' and resid % 5 = 0"), 1.2).select("structure_id", "atom_index", "category")


@query(f"""WITH {R}, m AS (SELECT *, CASE substr(name, 1, 1) WHEN 'N' THEN 14.007 ELSE 15.999 END AS w FROM s WHERE category = 'PROTEIN'),
b AS (SELECT structure_id, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z FROM m GROUP BY 1)
SELECT a.structure_id, a.atom_index, a.category FROM s a JOIN b ON a.structure_id = b.structure_id WHERE {D2} <= 1.5 ** 2""")
def active_region_com(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    centre = spatial.centre_of_mass(s.where("category = 'PROTEIN'").withColumn("element", F.substring("name", 1, 1)))
    return spatial.active_region(s, centre, 1.5).select("structure_id", "atom_index", "category")


@query(f"""WITH {R}, {WP}, r AS (SELECT * FROM s WHERE category = 'PROTEIN' AND resid % 5 = 0),
act AS (SELECT DISTINCT structure_id, category, resid FROM s a WHERE EXISTS (SELECT 1 FROM r b WHERE a.structure_id = b.structure_id AND {D2} <= 1.44)
OR a.category = 'PROTEIN' AND EXISTS (SELECT 1 FROM r b WHERE a.structure_id = b.structure_id AND a.resid = b.resid))
SELECT structure_id, v AS src, u AS dst, CASE WHEN EXISTS (SELECT 1 FROM act WHERE act.structure_id = p.structure_id AND (act.category = 'PROTEIN' AND act.resid = vresid OR act.category = 'WAT' AND act.resid = uresid))
  THEN 'active_region' ELSE 'not_active_region' END AS site_status FROM p""")
def site_status_connections(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    active = spatial.active_region(s, s.where("category = 'PROTEIN' and resid % 5 = 0"), 1.2)
    return network.with_status(network.water_protein(s, 1.2, 4), s, active).select("structure_id", "src", "dst", "site_status")


_MI = " + ".join(f"(a.{c} - b.{c} - 6.0 * round((a.{c} - b.{c}) / 6.0)) ** 2" for c in "xyz")


@query(f"WITH {S} SELECT a.structure_id, a.atom_index AS src, b.atom_index AS dst, round(sqrt({_MI}), 6) AS distance FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.atom_index < b.atom_index WHERE {_MI} < 1.0")
def min_image_distance(spark, sf_dir):
    s = a.sites(spark, sf_dir)
    return spatial.radius_join(s, s, 1.0, box=BOX).where("l.atom_index < r.atom_index").select("structure_id", F.col("l.atom_index").alias("src"), F.col("r.atom_index").alias("dst"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {R}, {_pairs('w', 'WAT', 'WAT', 1.2, 10)}, {_pairs('p', 'WAT', 'PROTEIN', 1.2, 10)}, c AS (SELECT structure_id, 1 AS ww, 0 AS wp FROM w WHERE u < v UNION ALL SELECT structure_id, 0, 1 FROM p)
SELECT structure_id, sum(ww)::BIGINT AS water_water, sum(wp)::BIGINT AS water_protein FROM c GROUP BY 1""")
def interaction_counts(spark, sf_dir):
    return graph.interaction_counts(network.edges(network.undirected(a.sites(spark, sf_dir, True), 1.2)), SID)


@query(f"WITH {R}, {_pairs('p', 'WAT', 'PROTEIN', 1.2, 10)} SELECT structure_id, vresid AS residue, count(*) AS n FROM p WHERE vresid <> 0 GROUP BY 1, 2")
def per_residue_interactions(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    return graph.per_residue(network.edges(network.water_protein(s, 1.2)), s, SID)


@query(f"""WITH {S}, {WW}, {E_}, n AS (SELECT structure_id, count(*) AS n_nodes FROM s GROUP BY 1), m AS (SELECT structure_id, count(*) AS n_edges FROM e GROUP BY 1)
SELECT structure_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(coalesce(n_edges, 0) / nullif(n_nodes * (n_nodes - 1) / 2, 0), 6) AS density FROM n LEFT JOIN m USING (structure_id)""")
def graph_density(spark, sf_dir):
    return graph.density(*_net(spark, sf_dir), SID).withColumn("density", F.round("density", 6))


DEG = "dg AS (SELECT s.structure_id, s.atom_index AS id, count(b.dst) AS degree FROM s LEFT JOIN b ON b.structure_id = s.structure_id AND b.src = s.atom_index GROUP BY 1, 2)"


@query(f"""WITH {S}, {WW}, {E_}, {B_}, {DEG}, h AS (SELECT structure_id, degree, count(*) AS c FROM dg GROUP BY 1, 2), p AS (SELECT structure_id, c / sum(c) OVER (PARTITION BY structure_id) AS p FROM h)
SELECT structure_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def degree_entropy(spark, sf_dir):
    return graph.entropy(*_net(spark, sf_dir), SID).withColumn("entropy", F.round("entropy", 6))


@query(f"""WITH {S}, {WW}, {E_}, {B_}, {DEG}, t AS (SELECT x.structure_id, x.src AS id, count(*) AS t FROM b x JOIN b y ON x.structure_id = y.structure_id AND x.src = y.src AND x.dst < y.dst
  JOIN b z ON z.structure_id = x.structure_id AND z.src = x.dst AND z.dst = y.dst GROUP BY 1, 2)
SELECT structure_id, id, round(CASE WHEN degree > 1 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN t USING (structure_id, id)""")
def clustering_coefficient(spark, sf_dir):
    return graph.clustering(*_net(spark, sf_dir), SID).withColumn("clustering", F.round("clustering", 6))


CC = """c(structure_id, id, low) AS (SELECT structure_id, atom_index, atom_index FROM s UNION SELECT c.structure_id, b.dst, c.low FROM c JOIN b ON b.structure_id = c.structure_id AND b.src = c.id WHERE c.low < b.dst),
m AS (SELECT structure_id, id, min(low) AS component FROM c GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {S}, {WW}, {E_}, {B_}, {CC} SELECT structure_id, component, count(*) AS size FROM m GROUP BY 1, 2")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.components(*_net(spark, sf_dir), SID), SID)


BFS = """p(structure_id, src, dst, d) USING KEY (structure_id, src, dst) AS (SELECT structure_id, atom_index, atom_index, 0 FROM s UNION
SELECT DISTINCT p.structure_id, p.src, b.dst, p.d + 1 FROM p JOIN b ON b.structure_id = p.structure_id AND b.src = p.dst
WHERE NOT EXISTS (SELECT 1 FROM recurring.p r WHERE r.structure_id = p.structure_id AND r.src = p.src AND r.dst = b.dst))"""


@query(f"""WITH RECURSIVE {S}, {WW}, {E_}, {B_}, {BFS}, {CC}, z AS (SELECT structure_id, component, count(*) AS size FROM m GROUP BY 1, 2),
t AS (SELECT p.structure_id, m.component, sum(d) AS total FROM p JOIN m ON m.structure_id = p.structure_id AND m.id = p.src GROUP BY 1, 2)
SELECT structure_id, round(avg(CASE WHEN size > 1 THEN total / (size * (size - 1)) ELSE 0 END), 6) AS cpl FROM z JOIN t USING (structure_id, component) GROUP BY 1""")
def characteristic_path_length(spark, sf_dir):
    n, e = _net(spark, sf_dir)
    return graph.characteristic_path_length(n, e, SID).withColumn("cpl", F.round("cpl", 6))


@query(f"WITH RECURSIVE {S}, {WW}, {E_}, {B_}, {BFS} SELECT structure_id, src, dst, d FROM p")
def shortest_path_lengths(spark, sf_dir):
    return graph.distances(*_net(spark, sf_dir), SID).drop("prev")


@query(f"""WITH RECURSIVE {S}, {WW}, {E_}, {B_}, {BFS}, v AS (SELECT p.structure_id, p.src, p.dst, min(q.dst) AS prev FROM p JOIN b ON b.structure_id = p.structure_id AND b.dst = p.dst
  JOIN p q ON q.structure_id = p.structure_id AND q.src = p.src AND q.dst = b.src AND q.d = p.d - 1 GROUP BY 1, 2, 3),
r(structure_id, src, dst, cur, path) AS (SELECT structure_id, src, dst, dst, dst::VARCHAR FROM p UNION ALL
  SELECT r.structure_id, r.src, r.dst, v.prev, v.prev || '-' || r.path FROM r JOIN v ON v.structure_id = r.structure_id AND v.src = r.src AND v.dst = r.cur)
SELECT structure_id, src, dst, path FROM r WHERE cur = src""")
def shortest_paths(spark, sf_dir):
    n, e = _net(spark, sf_dir)
    return graph.shortest_path(e, n, keys=SID, separator="-").select("structure_id", "src", "dst", "path")


@query(f"""WITH RECURSIVE {S}, {WW}, {E_}, {B_}, {BFS}, {CC}, z AS (SELECT structure_id, component, count(*) AS size FROM m GROUP BY 1, 2),
t AS (SELECT p.structure_id, m.component, sum(d) AS total FROM p JOIN m ON m.structure_id = p.structure_id AND m.id = p.src GROUP BY 1, 2)
SELECT structure_id, round(arg_max(CASE WHEN size > 1 THEN total / (size * (size - 1)) ELSE 0 END, size * 1000000000 - component), 6) AS cpl FROM z JOIN t USING (structure_id, component) GROUP BY 1""")
def largest_component_path_length(spark, sf_dir):
    n, e = _net(spark, sf_dir)
    return graph.characteristic_path_length(n, e, SID, largest_only=True).withColumn("cpl", F.round("cpl", 6))


@query(f"""WITH {S}, {WW}, {E_}, a AS (SELECT structure_id, src, dst FROM e UNION SELECT structure_id, dst, src FROM e WHERE (src + dst) % 3 = 0),
m AS (SELECT structure_id, src, dst, count(*) AS m FROM (SELECT structure_id, src, dst FROM a UNION ALL SELECT structure_id, dst, src FROM a) GROUP BY 1, 2, 3),
d AS (SELECT structure_id, src AS id, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM m GROUP BY 1, 2),
t AS (SELECT x.structure_id, x.src AS id, sum(x.m * y.m * z.m) AS t FROM m x JOIN m y ON x.structure_id = y.structure_id AND x.src = y.src AND x.dst < y.dst
  JOIN m z ON z.structure_id = x.structure_id AND z.src = x.dst AND z.dst = y.dst GROUP BY 1, 2)
SELECT s.structure_id, s.atom_index AS id, round(CASE WHEN d * (d - 1) - 2 * r > 0 THEN coalesce(t, 0) / (d * (d - 1) - 2 * r) ELSE 0 END, 6) AS clustering
FROM s LEFT JOIN d ON d.structure_id = s.structure_id AND d.id = s.atom_index LEFT JOIN t ON t.structure_id = s.structure_id AND t.id = s.atom_index""")
def directed_clustering_coefficient(spark, sf_dir):
    n, e = _net(spark, sf_dir)
    back = e.where((F.col("src") + F.col("dst")) % 3 == 0).select("structure_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.directed_clustering(n, e.select("structure_id", "src", "dst").union(back), SID).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH {R}, m AS (SELECT *, CASE substr(name, 1, 1) WHEN 'N' THEN 14.007 ELSE 15.999 END AS w FROM s WHERE category = 'PROTEIN'),
b AS (SELECT structure_id, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * z) / sum(w) AS z FROM m GROUP BY 1),
r AS (SELECT a.structure_id, max(sqrt({D2})) - 0.5 AS r FROM m a JOIN b ON a.structure_id = b.structure_id GROUP BY 1)
SELECT a.structure_id, a.atom_index FROM s a JOIN b ON a.structure_id = b.structure_id JOIN r ON r.structure_id = a.structure_id WHERE a.category = 'WAT' AND sqrt({D2}) <= r""")
def near_protein_waters(spark, sf_dir):
    s = a.sites(spark, sf_dir, True).withColumn("element", F.substring("name", 1, 1))
    return spatial.near_protein(s.where("category = 'WAT'"), s.where("category = 'PROTEIN'"), -0.5, SID).select("structure_id", "atom_index")


@query(f"""WITH {R}, {WP}, act AS (SELECT DISTINCT structure_id, category, resid FROM s a WHERE a.category = 'PROTEIN' AND a.resid % 5 = 0)
SELECT structure_id, v AS src, u AS dst FROM p WHERE EXISTS (SELECT 1 FROM act WHERE act.structure_id = p.structure_id AND act.resid = vresid)""")
def active_subgraph(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    marked = network.with_status(network.water_protein(s, 1.2, 4), s, s.where("category = 'PROTEIN' and resid % 5 = 0"))
    return network.subgraph(marked, "active_region").select("structure_id", "src", "dst")


@query(f"""WITH {R}, r AS (SELECT * FROM s WHERE category = 'PROTEIN' AND resid % 5 = 0)
SELECT structure_id, atom_index, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s a WHERE category = 'WAT' AND EXISTS (SELECT 1 FROM r b WHERE a.structure_id = b.structure_id AND {D2} <= 1.44)""")
def active_coordinates(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    active = spatial.active_region(s, s.where("category = 'PROTEIN' and resid % 5 = 0"), 1.2)
    return graph.coordinates(network.nodes(s), "active_region", active).select("structure_id", "atom_index", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"""WITH {R}, {_pairs('p', 'WAT', 'PROTEIN', 1.2, 4)}, q AS (SELECT p.structure_id, vresid AS residue, v, u, least(d, sqrt((b.x - a.x - 0.3) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), sqrt((b.x - a.x) ** 2 + (b.y - a.y - 0.3) ** 2 + (b.z - a.z) ** 2)) AS d
  FROM p JOIN s a ON a.structure_id = p.structure_id AND a.atom_index = u JOIN s b ON b.structure_id = p.structure_id AND b.atom_index = v)
SELECT structure_id, residue, count(*) AS n, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest FROM q GROUP BY 1, 2""")
def water_distances(spark, sf_dir):
    s = a.with_hydrogens(a.sites(spark, sf_dir, True))
    found = network.water_distances(network.water_protein(s, 1.2, 4), s)
    return found.select("structure_id", "residue", F.size("distances").cast("long").alias("n"), F.round(F.array_min("distances"), 6).alias("nearest"), F.round(F.array_max("distances"), 6).alias("farthest"))


CEN = "cen AS (SELECT structure_id AS label, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM s GROUP BY 1)"


def _centers(spark, sf_dir):
    return cluster.centers(a.sites(spark, sf_dir).withColumn("label", F.col("structure_id")))


@query(f"WITH {S}, {CEN} SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n FROM cen")
def cluster_centers(spark, sf_dir):
    return _centers(spark, sf_dir).select("label", *(F.round(c, 6).alias(c) for c in "xyz"), "n")


@query(f"""WITH RECURSIVE {S}, nb AS (SELECT a.structure_id, a.atom_index AS src, b.atom_index AS dst FROM s a JOIN s b ON a.structure_id = b.structure_id WHERE {D2} <= 0.64),
co AS (SELECT structure_id, src AS id FROM nb GROUP BY 1, 2 HAVING count(*) >= 3), b AS (SELECT nb.* FROM nb JOIN co x ON x.structure_id = nb.structure_id AND x.id = src JOIN co y ON y.structure_id = nb.structure_id AND y.id = dst),
c(structure_id, id, low) AS (SELECT structure_id, id, id FROM co UNION SELECT c.structure_id, b.dst, c.low FROM c JOIN b ON b.structure_id = c.structure_id AND b.src = c.id WHERE c.low < b.dst),
m AS (SELECT structure_id, id, min(low) AS component FROM c GROUP BY 1, 2), bo AS (SELECT nb.structure_id, src AS id, min(component) AS border FROM nb JOIN m ON m.structure_id = nb.structure_id AND m.id = dst GROUP BY 1, 2)
SELECT s.structure_id, s.atom_index AS id, coalesce(component, border, -1) AS label FROM s LEFT JOIN m ON m.structure_id = s.structure_id AND m.id = atom_index LEFT JOIN bo ON bo.structure_id = s.structure_id AND bo.id = atom_index""")
def dbscan_labels(spark, sf_dir):
    return cluster.dbscan(a.sites(spark, sf_dir), 0.8, 3, SID, "atom_index")


@query(f"""WITH {S}, {CEN}, cr AS (SELECT a.structure_id, a.atom_index, count(*) AS crowd FROM s a JOIN s b ON a.structure_id = b.structure_id AND {D2} < 36 AND sqrt({D2}) > 2 GROUP BY 1, 2),
h AS (SELECT a.structure_id, a.atom_index FROM s a WHERE EXISTS (SELECT 1 FROM cen b WHERE {D2} < 2.25))
SELECT s.structure_id, round(coalesce(sum(CASE WHEN h.atom_index IS NOT NULL THEN 1 / (coalesce(crowd, 0) + 1) END), 0) / (SELECT count(*) FROM cen), 6) AS score, count(*) - count(h.atom_index) AS unique_waters
FROM s LEFT JOIN h USING (structure_id, atom_index) LEFT JOIN cr USING (structure_id, atom_index) GROUP BY 1""")
def commonality(spark, sf_dir):
    return conserve.commonality(a.sites(spark, sf_dir), _centers(spark, sf_dir)).select("structure_id", F.round("score", 6).alias("score"), "unique_waters")


@query(f"""WITH {S}, {CEN}, o AS (SELECT b.label, count(a.atom_index) AS n FROM cen b LEFT JOIN s a ON {D2} <= 1 GROUP BY 1)
SELECT label, n, round(coalesce((n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0), 0), 6) AS scaled FROM o""")
def cluster_occupancy_scaled(spark, sf_dir):
    return conserve.scaled(conserve.occupancy(a.sites(spark, sf_dir), _centers(spark, sf_dir)), "n").withColumn("scaled", F.round("scaled", 6))


@query(f"""WITH {S}, {CEN}, net AS (SELECT a.label AS src, b.label AS dst FROM cen a JOIN cen b ON a.label < b.label AND {D2} < 4), h AS (SELECT DISTINCT a.structure_id, b.label FROM s a JOIN cen b ON {D2} <= 1)
SELECT src, dst, count(DISTINCT y.structure_id) AS n FROM net LEFT JOIN h x ON x.label = src LEFT JOIN h y ON y.label = dst AND y.structure_id = x.structure_id GROUP BY 1, 2""")
def conserved_interactions(spark, sf_dir):
    return conserve.conserved_interactions(a.sites(spark, sf_dir), stage(_centers(spark, sf_dir)), connect=2.0)


def _sql_angle(u: tuple[str, ...], v: tuple[str, ...]) -> str:
    dot = lambda p, q: "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(p, q, strict=True)) + ")"
    return f"degrees(acos(greatest(-1, least(1, {dot(u, v)} / (sqrt({dot(u, u)}) * sqrt({dot(v, v)}))))))"


def _diff(p: str, q: str) -> tuple[str, ...]:
    return tuple(f"{p}.{c} - {q}.{c}" for c in "xyz")


_REF = [_sql_angle(_diff("q", "t"), tuple(f"{r} - t.{c}" for r, c in zip(ref, "xyz", strict=True))) for ref in ((0.0, 10.0, 0.0), (10.0, 0.0, 10.0))]


@query(f"""WITH {R}, {_pairs('p', 'WAT', 'PROTEIN', 1.2, 10)} SELECT p.structure_id, v AS src, u AS dst, round({_REF[0]}, 4) AS angle1, round({_REF[1]}, 4) AS angle2 FROM p JOIN s q ON q.atom_index = v JOIN s t ON t.atom_index = u""")
def two_angle_classification(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    c = network.water_protein(s, 1.2).select("structure_id", "src", "dst")
    for end, p in (("src", "p"), ("dst", "w")):
        c = c.join(s.select("structure_id", F.col("atom_index").alias(end), *(F.col(x).alias(f"{p}{x}") for x in "xyz")), ["structure_id", end])
    return conserve.two_angles(c).select("structure_id", "src", "dst", F.round("angle1", 4).alias("angle1"), F.round("angle2", 4).alias("angle2"))


_H = "h AS (SELECT structure_id, atom_index AS don, x + 0.3 AS x, y, z, 1 AS k FROM s UNION ALL SELECT structure_id, atom_index, x, y + 0.3, z, 2 FROM s)"
_AT = _sql_angle(_diff("b", "a"), _diff("o", "a"))


@query(f"""WITH {S}, {_H}, n AS (SELECT a.structure_id, a.don AS src, b.atom_index AS dst, 'H' || a.k AS atom_name, sqrt({D2}) AS d, {_AT} AS angle,
  row_number() OVER (PARTITION BY a.structure_id, a.don, a.k ORDER BY sqrt({D2}), b.atom_index) AS r FROM h a JOIN s b ON a.structure_id = b.structure_id AND {D2} < 1 JOIN s o ON o.atom_index = a.don)
SELECT structure_id, src, dst, atom_name, round(d, 6) AS distance, round(angle, 4) AS angle FROM n WHERE r <= 10 AND src < dst AND angle >= 120""")
def hbond_angle_filter(spark, sf_dir):
    found = network.directed(a.with_hydrogens(a.sites(spark, sf_dir)), 1.0, 10, 120.0, water_only=True)
    return found.select("structure_id", "src", "dst", "atom_name", F.round("distance", 6).alias("distance"), F.round("angle", 4).alias("angle"))


_HP = "h AS (SELECT structure_id, atom_index AS don, x + 0.3 AS x, y, z, 1 AS k FROM s WHERE category = 'WAT' UNION ALL SELECT structure_id, atom_index, x, y + 0.3, z, 2 FROM s WHERE category = 'WAT')"
_HA = _sql_angle(_diff("b", "o"), _diff("o", "a"))


@query(f"""WITH {R}, {_HP}, n AS (SELECT a.structure_id, a.don AS src, b.atom_index AS dst, a.k, b.name AS atom_name, sqrt({D2}) AS d, {_HA} AS angle,
  row_number() OVER (PARTITION BY a.structure_id, a.don, a.k ORDER BY sqrt({D2}), b.atom_index) AS r FROM h a JOIN s b ON a.structure_id = b.structure_id AND b.category = 'PROTEIN' AND {D2} < 1 JOIN s o ON o.atom_index = a.don)
SELECT structure_id, src, dst, atom_name, CASE WHEN atom_name IN ('O', 'N') THEN 'backbone' ELSE 'side-chain' END AS classification, round(d, 6) AS distance, round(angle, 4) AS angle FROM n WHERE r <= 10""")
def water_hydrogen_to_protein(spark, sf_dir):
    found = network.directed(a.with_hydrogens(a.sites(spark, sf_dir, True)), 1.0, 10).where("connection_type = 'WAT-PROT'")
    return found.select("structure_id", "src", "dst", "atom_name", "classification", F.round("distance", 6).alias("distance"), F.round("angle", 4).alias("angle"))


@query(f"""WITH {R}, {_HP}, n AS (SELECT a.structure_id, a.don AS src, b.atom_index AS dst, a.k, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.structure_id, a.don, a.k ORDER BY sqrt({D2}), b.atom_index) AS r
  FROM h a JOIN s b ON a.structure_id = b.structure_id AND b.category = 'WAT' AND {D2} < 1), m AS (SELECT b.structure_id, a.don AS src, b.atom_index AS dst, a.k, sqrt({D2}) AS d,
  row_number() OVER (PARTITION BY b.structure_id, b.atom_index ORDER BY sqrt({D2}), a.don * 10 + 1000000000 + a.k) AS r FROM h a JOIN s b ON a.structure_id = b.structure_id AND b.category = 'WAT' AND {D2} < 1),
u AS (SELECT structure_id, src, dst, d FROM n WHERE r <= 2 UNION SELECT structure_id, src, dst, d FROM m WHERE r <= 2)
SELECT structure_id, src, dst, round(min(d), 6) AS distance FROM u WHERE src <> dst GROUP BY 1, 2, 3""")
def directed_both_ways(spark, sf_dir):
    found = network.directed(a.with_hydrogens(a.sites(spark, sf_dir, True)), 1.0, 2, water_only=True, reverse=True)
    return network.edges(found).select("structure_id", "src", "dst", F.round("distance", 6).alias("distance"))


@query(f"""WITH {R}, {_pairs('p', 'WAT', 'PROTEIN', 1.2, 10)}, q AS (SELECT v % 16 AS msa_resid, {_REF[0]} AS a, {_REF[1]} AS b FROM p JOIN s q ON q.atom_index = v JOIN s t ON t.atom_index = u)
SELECT round(min(a) - (max(a) - min(a)) * 0.1, 4) AS low1, round(max(a) + (max(a) - min(a)) * 0.1, 4) AS high1, round(min(b) - (max(b) - min(b)) * 0.1, 4) AS low2, round(max(b) + (max(b) - min(b)) * 0.1, 4) AS high2,
  (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT msa_resid AS r FROM q)) AS msa_resids FROM q""")
def angle_ranges(spark, sf_dir):
    s = a.sites(spark, sf_dir, True)
    c = network.water_protein(s, 1.2).select("structure_id", "src", "dst")
    for end, p in (("src", "p"), ("dst", "w")):
        c = c.join(s.select("structure_id", F.col("atom_index").alias(end), *(F.col(x).alias(f"{p}{x}") for x in "xyz")), ["structure_id", end])
    out = conserve.angle_ranges(conserve.two_angles(c).withColumn("msa_resid", F.col("src") % 16))
    return out.select(*(F.round(f"{n}_angle{k}", 4).alias(f"{n}{k}") for k in (1, 2) for n in ("low", "high")), F.array_join("msa_resids", ",").alias("msa_resids"))


@query(f"WITH {S} SELECT structure_id, atom_index, round(-y + 1.0, 6) AS x, round(x + 2.0, 6) AS y, round(z + 3.0, 6) AS z FROM s")
def rigid_transform(spark, sf_dir):
    s = a.sites(spark, sf_dir)
    return s.select("structure_id", "atom_index", *(F.round(v, 6).alias(c) for v, c in zip(g.rigid(g.point(), ROT, [1.0, 2.0, 3.0]), "xyz", strict=True)))


@query("""WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS c FROM orders)
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 15)), 14)::BIGINT AS bin, round(lo + bin * ((hi - lo) / 15), 4) AS low, count(*) AS n, round(count(*) / (c * ((hi - lo) / 15)), 10) AS density FROM orders, r GROUP BY bin, lo, hi, c""")
def hist_1d(spark, sf_dir):
    return conserve.histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice").select("bin", F.round("low", 4).alias("low"), "n", F.round("density", 10).alias("density"))


@query(f"""WITH {S}, r AS (SELECT structure_id, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM s GROUP BY 1)
SELECT structure_id, least(floor((x - xl) / ((xh - xl) / 5)), 4)::BIGINT AS bin_x, least(floor((y - yl) / ((yh - yl) / 5)), 4)::BIGINT AS bin_y, count(*) AS n, round(ln(count(*)), 6) AS log_n FROM s JOIN r USING (structure_id) GROUP BY 1, 2, 3""")
def hist_2d(spark, sf_dir):
    return conserve.histogram2d(a.sites(spark, sf_dir), "x", "y", 5, SID).withColumn("log_n", F.round("log_n", 6))


@query("""WITH f AS (SELECT DISTINCT day(ts) AS frame_idx, user_id, event_type FROM events), n AS (SELECT frame_idx, user_id AS residue, count(*) AS n FROM f GROUP BY 1, 2)
SELECT residue, round(sum(n) / (SELECT count(DISTINCT frame_idx) FROM f), 6) AS score, round(avg(n), 6) AS mean_waters FROM n GROUP BY 1 HAVING score > 1.0""")
def residue_score(spark, sf_dir):
    f = a.frames(spark, sf_dir)
    n = f.groupBy("frame_idx", F.col("user_id").alias("residue")).agg(F.count("*").alias("n"))
    frames = f.agg(F.count_distinct("frame_idx"))
    return conserve.residue_scores(n, frames, 1.0).select("residue", F.round("score", 6).alias("score"), F.round("mean_waters", 6).alias("mean_waters"))


@query("""WITH f AS (SELECT DISTINCT day(ts) AS frame_idx, user_id, event_type FROM events), e AS (SELECT frame_idx, count(*) AS n_edges, count(*) FILTER (event_type = 'click') AS water_water, count(*) FILTER (event_type <> 'click') AS water_protein FROM f GROUP BY 1),
n AS (SELECT frame_idx, count(DISTINCT user_id) + count(DISTINCT event_type) AS n_nodes FROM f GROUP BY 1), d AS (SELECT frame_idx, id, count(*) AS k FROM (SELECT frame_idx, 'u' || user_id AS id FROM f UNION ALL SELECT frame_idx, 't' || event_type FROM f) GROUP BY 1, 2),
h AS (SELECT frame_idx, k, count(*) AS c FROM d GROUP BY 1, 2), p AS (SELECT frame_idx, c / sum(c) OVER (PARTITION BY frame_idx) AS p FROM h), t AS (SELECT frame_idx, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1)
SELECT frame_idx, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1) / 2), 6) AS density, entropy, water_water, water_protein FROM n JOIN e USING (frame_idx) JOIN t USING (frame_idx)""")
def frame_metrics(spark, sf_dir):
    f = a.frames(spark, sf_dir)
    e = f.select("frame_idx", F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("t"), "event_type").alias("dst"), F.when(F.col("event_type") == "click", "WAT-WAT").otherwise("WAT-PROT").alias("connection_type"))
    n = e.select("frame_idx", F.col("src").alias("id")).union(e.select("frame_idx", F.col("dst").alias("id"))).distinct()
    k = ("frame_idx",)
    out = graph.density(n, e, k).join(graph.entropy(n, e, k), "frame_idx").join(graph.interaction_counts(e, k), "frame_idx")
    return out.withColumn("density", F.round("density", 6)).withColumn("entropy", F.round("entropy", 6))


VOX = "g AS (SELECT floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iy, floor(z)::BIGINT AS iz, count(*) AS n, count(*) / 0.0329 AS density FROM s GROUP BY 1, 2, 3)"


@query(f"WITH {S}, {VOX} SELECT ix, iy, iz, n, round(density, 6) AS density FROM g")
def density_voxels(spark, sf_dir):
    return voxels.voxels(a.sites(spark, sf_dir)).withColumn("density", F.round("density", 6))


@query(f"""WITH {S}, {VOX} SELECT p.ix, p.iy, p.iz, round(p.density, 6) AS density, p.ix::DOUBLE AS x, p.iy::DOUBLE AS y, p.iz::DOUBLE AS z FROM g p JOIN g q ON abs(p.ix - q.ix) <= 1 AND abs(p.iy - q.iy) <= 1 AND abs(p.iz - q.iz) <= 1
GROUP BY p.ix, p.iy, p.iz, p.density HAVING p.density = max(q.density) AND p.density > 100""")
def density_hotspots(spark, sf_dir):
    return voxels.hotspots(voxels.voxels(a.sites(spark, sf_dir)), 100.0).withColumn("density", F.round("density", 6))


MSA = """q AS (SELECT p_partkey AS structure_id, replace(p_type, ' ', '-') AS sq FROM part), ch AS (SELECT structure_id, unnest(range(1, len(sq) + 1)) AS msa_col, sq FROM q),
ix AS (SELECT structure_id, row_number() OVER (PARTITION BY structure_id ORDER BY msa_col) AS seq_pos, msa_col FROM ch WHERE sq[msa_col] <> '-')"""


@query(f"WITH {MSA} SELECT structure_id, seq_pos, msa_col FROM ix")
def msa_index(spark, sf_dir):
    return sequence.msa_index(a.sequences(spark, sf_dir))


@query(f"""WITH {MSA}, w AS (SELECT seq_pos AS ref_resid, msa_col AS want FROM ix WHERE structure_id = (SELECT min(structure_id) FROM ix) AND seq_pos IN (3, 8, 12))
SELECT structure_id, ref_resid, arg_min(seq_pos, abs(msa_col - want) * 1000 + seq_pos) AS resid FROM ix, w GROUP BY 1, 2""")
def msa_translate(spark, sf_dir):
    ix = sequence.msa_index(a.sequences(spark, sf_dir))
    return sequence.translate(ix, ix.agg(F.min("structure_id").alias("structure_id")), spark.createDataFrame([(3,), (8,), (12,)], "resid int"))


@query("SELECT l_orderkey AS structure_id, string_agg('ARNDCQEGHI'[(l_partkey % 10 + 1)::INT], '' ORDER BY l_linenumber, 'ARNDCQEGHI'[(l_partkey % 10 + 1)::INT]) AS sequence FROM lineitem GROUP BY 1")
def fasta_from_atoms(spark, sf_dir):
    return sequence.fasta_from_atoms(a.atoms(spark, sf_dir))


@query("""WITH t AS (SELECT l_orderkey AS structure_id, l_linenumber AS resid, 'ARNDCQEGHI'[(l_partkey % 10 + 1)::INT] AS c FROM lineitem)
SELECT structure_id, resid FROM t WHERE (c IN ('A', 'R') AND NOT resid BETWEEN 2 AND 3) OR (c = 'G' AND resid = 2)""")
def selection_language(spark, sf_dir):
    return select(a.atoms(spark, sf_dir), "resname ALA ARG and not resid 2-3 or resname GLY and resid 2").select("structure_id", "resid")


@query("""WITH w AS (SELECT l_suppkey AS structure_id, l_returnflag AS chain, l_orderkey AS resid, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS atom_index FROM lineitem)
SELECT structure_id, chain, resid, min(atom_index) AS atom_index FROM w GROUP BY 1, 2, 3""")
def first_oxygens_of_chains(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    atoms = l.select(
        F.col("l_suppkey").alias("structure_id"), F.lit(0).alias("frame_idx"), F.col("l_returnflag").alias("chain"), F.col("l_orderkey").alias("resid"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("atom_index"),
        F.lit("HOH").alias("resname"), F.lit("O").alias("name"), F.col("l_quantity").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )
    found = pipeline.build(atoms, Config(network_type="water-water"))["nodes"]
    return found.select("structure_id", "chain", "resid", "atom_index")


@query(f"WITH {S}, v AS (SELECT 0 AS graph, structure_id, atom_index FROM s WHERE structure_id < 5 UNION ALL SELECT 1, structure_id, atom_index FROM s WHERE structure_id >= 5) SELECT graph, structure_id, atom_index, row_number() OVER (ORDER BY graph, structure_id, atom_index) - 1 AS node FROM v")
def disjoint_union(spark, sf_dir):
    s = a.sites(spark, sf_dir)
    return network.disjoint_union([s.where("structure_id < 5"), s.where("structure_id >= 5")]).select("graph", "structure_id", "atom_index", "node")


@query()
def hdbscan_labels(spark, sf_dir):
    return cluster.by_group(a.sites(spark, sf_dir), "hdbscan", SID, id_col="atom_index", min_cluster_size=4)


@query()
def optics_labels(spark, sf_dir):
    return cluster.by_group(a.sites(spark, sf_dir), "optics", SID, id_col="atom_index", min_samples=4, max_eps=1.0)


@query()
def hdbscan_angles(spark, sf_dir):
    angles = two_angle_classification(spark, sf_dir)
    return conserve.angle_clusters(angles.select((F.col("src") % 16).alias("msa_resid"), F.xxhash64("structure_id", "src", "dst").alias("id"), "angle1", "angle2"))


@query()
def seq_similarity(spark, sf_dir):
    s = a.sequences(spark, sf_dir)
    pairs = s.select(F.col("structure_id").alias("i"), F.col("sequence").alias("a")).join(s.select((F.col("structure_id") - 1).alias("i"), F.col("sequence").alias("b")), "i")
    return sequence.similarity(pairs)


@query()
def kabsch_superposition(spark, sf_dir):
    s = a.sites(spark, sf_dir).withColumn("resid", F.row_number().over(network.Window.partitionBy("structure_id").orderBy("atom_index"))).withColumn("name", F.lit("CA"))
    return sequence.superpose(s, 0)
