"""Graph metrics per structure and frame.  Graphs are tables: nodes (keys, id) and edges (keys, src, dst)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .spatial import KEYS


def _both(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    e = edges.where("src <> dst").select(*keys, "src", "dst")
    return e.union(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def density(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """edges / (nodes * (nodes - 1) / 2), alike for directed graphs; null below two nodes."""
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy(*keys).agg(F.count("*").alias("n_edges"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return n.join(e, list(keys), "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).withColumn("density", F.when(pairs > 0, F.col("n_edges") / pairs))


def interaction_counts(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return edges.groupBy(*keys).agg(*(F.count_if(F.col("connection_type") == t).alias(c) for t, c in (("WAT-WAT", "water_water"), ("WAT-PROT", "water_protein"))))


def per_residue(edges: DataFrame, sites: DataFrame, keys: tuple[str, ...] = KEYS, by: str = "resid") -> DataFrame:
    """Water-protein edges of each residue (``by``: resid or msa_resid); 0 and null residues are left out."""
    protein = sites.where("category = 'PROTEIN'").select(*keys, F.col("atom_index"), F.col(by).alias("residue")).where("residue is not null and residue <> 0")
    e = edges.where("connection_type = 'WAT-PROT'")
    ends = e.select(*keys, F.col("src").alias("atom_index")).union(e.select(*keys, F.col("dst").alias("atom_index")))
    return ends.join(protein, [*keys, "atom_index"]).groupBy(*keys, "residue").agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """In plus out degree of every node, 0 for isolated ones."""
    ends = edges.select(*keys, F.col("src").alias("id")).unionAll(edges.select(*keys, F.col("dst").alias("id")))
    d = ends.groupBy(*keys, "id").agg(F.count("*").alias("degree"))
    return nodes.join(d, [*keys, "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def entropy(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Shannon entropy in bits of the degree distribution."""
    counts = degrees(nodes, edges, keys).groupBy(*keys, "degree").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def clustering(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """2 T / (k (k - 1)) of every node of an undirected graph, 0 below two neighbours.

    Triangles come from edges oriented from the lower to the higher degree, so a hub's neighbours don't all pair.
    """
    both = stage(_both(edges, keys))
    k = stage(both.groupBy(*keys, "src").agg(F.count("*").alias("k")))
    rank = lambda end, name: k.select(*keys, F.col("src").alias(end), F.struct("k", F.col("src").alias("v")).alias(name))
    up = both.join(rank("src", "a"), [*keys, "src"]).join(rank("dst", "b"), [*keys, "dst"]).where("a < b").select(*keys, "src", "dst", "b")
    up = stage(up)
    wedge = up.select(*keys, "src", F.col("dst").alias("u"), F.col("b").alias("ru")).join(up.select(*keys, "src", F.col("dst").alias("w"), F.col("b").alias("rw")), [*keys, "src"]).where("ru < rw")
    closed = wedge.join(up.select(*keys, F.col("src").alias("u"), F.col("dst").alias("w")), [*keys, "u", "w"])
    corners = closed.select(*keys, F.explode(F.array("src", "u", "w")).alias("id"))
    t = corners.groupBy(*keys, "id").agg(F.count("*").alias("t"))
    out = nodes.join(k.withColumnRenamed("src", "id"), [*keys, "id"], "left").join(t, [*keys, "id"], "left")
    value = F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0))
    return out.select(*keys, "id", F.coalesce(value, F.lit(0.0)).alias("clustering"))


def directed_clustering(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Directed clustering: directed triangles through a node over twice (d (d - 1) - 2 reciprocal), d in plus out degree."""
    e = edges.where("src <> dst").select(*keys, "src", "dst").distinct()
    e = stage(e)
    w = _both(e, keys).join(e.withColumn("_f", F.lit(1)), [*keys, "src", "dst"], "left").join(
        e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_g")), [*keys, "src", "dst"], "left"
    ).select(*keys, "src", "dst", (F.coalesce("_f", F.lit(0)) + F.coalesce("_g", F.lit(0))).alias("m"))
    w = stage(w)
    a = w.select(*keys, F.col("src").alias("id"), F.col("dst").alias("u"), F.col("m").alias("m1"))
    b = w.select(*keys, F.col("src").alias("id"), F.col("dst").alias("v"), F.col("m").alias("m2"))
    c = w.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"), F.col("m").alias("m3"))
    tri = a.join(b, [*keys, "id"]).where("u < v").join(c, [*keys, "u", "v"]).groupBy(*keys, "id").agg(F.sum(F.col("m1") * F.col("m2") * F.col("m3")).alias("t"))
    d = w.groupBy(*keys, "src").agg(F.sum("m").alias("d"), F.count_if(F.col("m") == 2).alias("r")).withColumnRenamed("src", "id")
    room = F.col("d") * (F.col("d") - 1) - 2 * F.col("r")
    out = nodes.join(d, [*keys, "id"], "left").join(tri, [*keys, "id"], "left")
    return out.select(*keys, "id", F.coalesce(F.when(room > 0, F.coalesce("t", F.lit(0)) / room), F.lit(0.0)).alias("clustering"))


def components(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, rounds: int = 64) -> DataFrame:
    """(keys, id, component): weakly connected components, named by their smallest node.

    Labels take the least of their neighbours', then that label's own label (pointer jumping), so rounds are about the
    logarithm of the longest path; every round is staged.
    """
    both = stage(_both(edges, keys))
    label = stage(nodes.select(*keys, "id").distinct().withColumn("component", F.col("id")))
    while rounds:
        near = both.join(label.select(*keys, F.col("id").alias("dst"), F.col("component").alias("c")), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id")).agg(F.min("c").alias("c"))
        step = label.join(near, [*keys, "id"], "left").select(*keys, "id", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(*keys, F.col("id").alias("component"), F.col("component").alias("j"))
        step = stage(step.join(jump, [*keys, "component"], "left").select(*keys, "id", F.least("component", F.coalesce("j", "component")).alias("component"), "was"))
        label, rounds = step.drop("was"), rounds - 1
        if step.where("component <> was").isEmpty():
            return label
    raise RuntimeError("components are not finished in the rounds allowed")


def component_sizes(labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return labels.groupBy(*keys, "component").agg(F.count("*").alias("size"))


def distances(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, directed: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """(keys, src, dst, d, prev): shortest path lengths from ``sources`` (all nodes), the start included with d = 0.

    Breadth first; prev is the smallest predecessor, which makes paths deterministic.  From all nodes, tasks search
    (:func:`_searches`); from ``sources`` each round extends the last round's frontier by a join.
    """
    if sources is None:
        return _searches(nodes, edges, keys, directed)
    e = edges.where("src <> dst").select(*keys, "src", "dst").distinct() if directed else _both(edges, keys)
    e = stage(e.select(*keys, F.col("src").alias("mid"), F.col("dst").alias("to")))
    start = sources.select(*keys, "id").distinct()
    seen = stage(start.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("d"), F.lit(None).cast(start.schema["id"].dataType).alias("prev")))
    frontier, found, d = seen, [seen], 0
    while True:
        d += 1
        reached = frontier.select(*keys, "src", F.col("dst").alias("mid")).join(e, [*keys, "mid"]).groupBy(*keys, "src", F.col("to").alias("dst")).agg(F.min("mid").alias("prev"))
        # Undirected, a new node can't stand two or more rounds back; directed, it can stand in any.
        known = reduce(DataFrame.unionAll, found if directed else found[-2:]).select(*keys, "src", "dst")
        frontier = stage(reached.join(known, [*keys, "src", "dst"], "left_anti").select(*keys, "src", "dst", F.lit(d).alias("d"), "prev"))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionAll, found)


def _levels(src: np.ndarray, dst: np.ndarray, own: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level the (lane, node, smallest predecessor) that searches from nodes ``own``, a lane each, newly reach.

    The searches advance together as bits of machine words.  ``src`` ascends within the edges to one ``dst``, so an
    edge's bits that no edge before it had tell what it is the smallest predecessor of.
    """
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    degree = np.diff(np.r_[first, len(dst)])
    by_degree = np.argsort(-degree, kind="stable")
    first, degree = first[by_degree], degree[by_degree]
    ends, deeper = dst[first], np.searchsorted(-degree, -np.arange(degree[0]), "left")
    lane = np.arange(len(own))
    front = np.zeros((n, -(-len(own) // 64)), np.uint64)
    front[own, lane // 64] = np.uint64(1) << (lane % 64).astype(np.uint64)
    left = ~front[ends]  # what each node with edges to it still waits for
    while True:
        after, found = np.zeros_like(front), []
        for k, m in enumerate(deeper):
            edge = first[:m] + k
            hit = front[src[edge]] & left[:m]
            left[:m] ^= hit
            after[ends[:m]] |= hit
            at, word = np.nonzero(hit)
            which, bit = np.nonzero(np.unpackbits(hit[at, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            at = at[which]
            found.append((word[which] * 64 + bit, ends[at], src[edge[at]]))
        reached = tuple(np.concatenate(column) for column in zip(*found, strict=True))
        # Bits beyond the last lane are never set.
        if not len(reached[0]):
            return
        yield reached
        front = after


def _depth_first(levels: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], own: np.ndarray, n: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (lane, offsets, nodes): the paths that :func:`_levels` tells, lane by lane, each next to the one it prolongs.

    Neighbouring rows then differ in their last nodes alone, which is what Parquet's codecs make small.  Only paths to
    ``wanted`` nodes are given.
    """
    # Spots in a table of lanes by nodes; four bytes where that suffices.
    kind = np.int32 if len(own) * n < 1 << 31 else np.int64
    roots = (np.arange(len(own)) * n + own).astype(kind)
    steps, size = [(roots, roots, None)], np.ones(len(own) * n, np.int32)
    for lane, node, before in levels:
        lane = lane.astype(kind) * kind(n)
        parent = lane + before.astype(kind)
        by_parent = np.argsort(parent, kind="stable")
        parent = parent[by_parent]
        steps.append(((lane + node.astype(kind))[by_parent], parent, np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])))
    for spot, parent, first in steps[:0:-1]:
        size[parent[first]] += np.add.reduceat(size[spot], first)
    # A path stands after the one it prolongs and after all that prolong its earlier siblings.
    at = np.zeros(len(size), kind)
    at[roots] = np.cumsum(size[roots]) - size[roots]
    total = int(size[roots].sum())
    order, depth = np.empty(total, kind), np.empty(total, np.int32)
    for step, (spot, parent, first) in enumerate(steps):
        if step:
            earlier = np.cumsum(size[spot], dtype=kind) - size[spot]
            at[spot] = at[parent] + kind(1) + earlier - np.repeat(earlier[first], np.diff(np.r_[first, len(spot)]))
        where = at[spot]
        order[where], depth[where] = spot, step
    del steps, size, at
    lane, node = np.divmod(order, kind(n))
    # Of the rows up to one, the last of each smaller depth are its ancestors.
    columns = np.arange(depth.max() + 1, dtype=np.int32)
    last = np.zeros(len(columns), kind)
    rows = max(1, min(1 << 14, (1 << 21) // len(columns)))
    for a in range(0, total, rows):
        deep = depth[a : a + rows]
        above = np.zeros((len(deep), len(columns)), kind)
        above[0] = last
        above[np.arange(len(deep)), deep] = np.arange(a, a + len(deep))
        np.maximum.accumulate(above, axis=0, out=above)
        last = above[-1].copy()
        keep = deep > 0
        if wanted is not None:
            keep &= wanted[node[a : a + rows]]
        if keep.any():
            deep = deep[keep]
            yield lane[a : a + rows][keep], np.r_[0, np.cumsum(deep + 1)].astype(np.int32), node[above[keep][columns <= deep[:, None]]]


def _searches(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...], directed: bool = False, paths: bool = False, separator: str | None = None, target: int | None = None, sources: int = 512) -> DataFrame:
    """Shortest paths from all nodes: (keys, src, dst, d, prev), or with ``paths`` (keys, src, dst, path).

    A task has a component's edges and ``sources`` of its nodes (fewer, down to 64, in components of over 8,000).  Lengths
    are given level by level, so it holds two levels; paths source by source and depth first, from predecessors that it holds.
    A path is a list of ids, or with ``separator`` their text; only paths to ``target`` are given where there is one.
    """
    e = edges.where("src <> dst").select(*keys, "src", "dst").distinct() if directed else _both(edges, keys)
    e = stage(e)
    start = stage(nodes.select(*keys, "id").distinct())
    kind = start.schema["id"].dataType
    ends = e.select(*keys, F.col("src").alias("id")).union(e.select(*keys, F.col("dst").alias("id")))
    label = components(start.union(ends).distinct(), e, keys)
    # A node to start from is an edge to itself.
    loops = start.join(label, [*keys, "id"]).select(*keys, "component", F.col("id").alias("src"), F.col("id").alias("dst"))
    inside = e.join(label.withColumnRenamed("id", "src"), [*keys, "src"]).select(*keys, "component", "src", "dst")
    busy = inside.select(*keys, "component").distinct()
    deals = loops.join(busy, [*keys, "component"], "left_semi").groupBy(*keys, "component").agg(F.count("*").alias("size"))
    lanes = F.least(F.lit(sources), F.greatest(F.lit(64), F.floor(F.lit(8000 * sources) / F.col("size")))).cast("int")
    deals = deals.withColumn("lanes", lanes).select(*keys, "component", "lanes", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.col("lanes")).cast("int"))).alias("deal"))
    on = [*keys, "component", "lanes", "deal"]
    rows = inside.union(loops).join(deals, [*keys, "component"]).select(*on, "src", "dst")
    # The number of tasks is given: a deal is little to read and much to do.
    rows = rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    n_keys = len(keys)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
        type_ = src.type
        names, at = np.unique(np.r_[src.to_numpy(zero_copy_only=False), dst.to_numpy(zero_copy_only=False)], return_inverse=True)
        src, dst = at.reshape(2, -1)
        loop = src == dst
        own = np.sort(src[loop])[key[-1].as_py() * key[-2].as_py() :][: key[-2].as_py()]
        order = np.lexsort((src[~loop], dst[~loop]))
        names = pa.array(names, type_)
        texts = names.cast(pa.string()) if separator is not None else None

        def batch(n, lane, *columns):
            columns = [*(pa.repeat(k, n) for k in key[:n_keys]), names.take(pa.array(own[lane])), *columns]
            return pa.RecordBatch.from_arrays(columns, names=out_names)

        levels = _levels(src[~loop][order], dst[~loop][order], own, len(names))
        if not paths:
            for step, (lane, node, before) in enumerate(levels, 1):
                for a in range(0, len(node), 1 << 16):
                    at_node = node[a : a + (1 << 16)]
                    yield batch(len(at_node), lane[a : a + (1 << 16)], names.take(pa.array(at_node)), pa.repeat(pa.scalar(step, pa.int32()), len(at_node)), names.take(pa.array(before[a : a + (1 << 16)])))
            return
        wanted = None if target is None else pc.equal(names, pa.scalar(target, type_)).to_numpy(zero_copy_only=False)
        for lane, offsets, nodes_on in _depth_first(levels, own, len(names), wanted):
            way = pa.ListArray.from_arrays(pa.array(offsets), (names if texts is None else texts).take(pa.array(nodes_on)))
            yield batch(len(lane), lane, names.take(pa.array(nodes_on[offsets[1:] - 1])), way if texts is None else pc.binary_join(way, separator))

    id_type = kind.simpleString()
    tail = {"path": "string" if separator is not None else f"array<{id_type}>"} if paths else {"d": "int", "prev": id_type}
    types = {c: start.schema[c].dataType.simpleString() for c in keys} | {"src": id_type, "dst": id_type} | tail
    out_names = list(types)
    found = rows.groupBy(*on).applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()))
    i = F.col("id")
    if target is not None:
        start = start.where(i == target)
    own = (i.cast("string") if separator is not None else F.array(i),) if paths else (F.lit(0), F.lit(None).cast(kind))
    return start.select(*keys, i.alias("src"), i.alias("dst"), *(c.alias(name) for c, name in zip(own, tail, strict=True))).unionAll(found)


def _path_totals(edges: DataFrame, label: DataFrame, keys: tuple[str, ...], sources: int = 512) -> DataFrame:
    """(keys, component, total): the sum of all shortest path lengths within each component.

    A task has a component's edges and ``sources`` of its nodes, whose searches advance together as bits of machine words;
    only sums leave it, never a row a pair.  Large components are dealt to several tasks.
    """
    import pandas as pd

    both = _both(edges, keys).join(label.select(*keys, F.col("id").alias("src"), "component"), [*keys, "src"])
    deals = component_sizes(label, keys).where("size > 1").select(*keys, "component", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / sources).cast("int"))).alias("deal"))
    on = [*keys, "component", "deal"]
    rows = both.join(deals, [*keys, "component"]).select(*on, "src", "dst")

    def run(group):
        names, at = np.unique(group[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        at = at.reshape(-1, 2)
        src, dst = at[np.argsort(at[:, 1], kind="stable")].T
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        own = np.arange(len(names))[int(group["deal"].iloc[0]) * sources :][:sources]
        front = np.zeros((len(names), -(-len(own) // 64)), np.uint64)
        lane = np.arange(len(own))
        front[own, lane // 64] = np.uint64(1) << (lane % 64).astype(np.uint64)
        seen, total, step = front.copy(), 0, 0
        while front.any():
            step += 1
            reached = np.zeros_like(front)
            reached[dst[first]] = np.bitwise_or.reduceat(front[src], first, axis=0)
            front = reached & ~seen
            seen |= front
            total += step * int(np.bitwise_count(front).sum())
        return pd.DataFrame({**{c: group[c].iloc[:1].to_numpy() for c in on}, "total": [total]})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in on)
    return rows.groupBy(*on).applyInPandas(run, f"{kinds}, total long").groupBy(*keys, "component").agg(F.sum("total").alias("total"))


def characteristic_path_length(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = KEYS, exclude_single_points: bool = False, largest_only: bool = False) -> DataFrame:
    """Mean over components of their mean shortest path; single nodes count as 0 unless excluded.  (keys, cpl)"""
    label = components(nodes, edges, keys)
    size = component_sizes(label, keys)
    total = _path_totals(edges, label, keys)
    each = size.join(total, [*keys, "component"], "left").withColumn("mean", F.when(F.col("size") > 1, F.col("total") / (F.col("size") * (F.col("size") - 1))).otherwise(F.lit(0.0)))
    if exclude_single_points:
        each = each.where("size > 1")
    if largest_only:
        return each.groupBy(*keys).agg(F.max_by("mean", F.struct("size", -F.col("component"))).alias("cpl"))
    return each.groupBy(*keys).agg(F.avg("mean").alias("cpl"))


def shortest_path(edges: DataFrame, nodes: DataFrame, source: int | None = None, target: int | None = None, keys: tuple[str, ...] = KEYS, directed: bool = False, separator: str | None = None) -> DataFrame:
    """(keys, src, dst, path): node lists of shortest paths, for all pairs, one source, one target, or one pair.

    With ``separator`` a path is the text of its ids, joined.
    """
    if source is None:
        return _searches(nodes, edges, keys, directed, True, separator, target)
    starts = nodes.where(F.col("id") == source)
    d = stage(distances(nodes, edges, keys, directed, starts))
    rows = d.where(F.col("dst") == target) if target is not None else d
    rows = rows.select(*keys, "src", "dst", "prev", F.array("dst").alias("path"))
    back = d.select(*keys, "src", F.col("dst").alias("prev"), F.col("prev").alias("before"))
    while True:
        rows = stage(rows)
        if rows.where("prev is not null").isEmpty():
            rows = rows.drop("prev")
            return rows if separator is None else rows.withColumn("path", F.array_join("path", separator))
        rows = rows.join(back, [*keys, "src", "prev"], "left").select(*keys, "src", "dst", F.col("before").alias("prev"), F.when(F.col("prev").isNotNull(), F.concat(F.array("prev"), "path")).otherwise(F.col("path")).alias("path"))


def coordinates(nodes: DataFrame, selection: str = "all", active: DataFrame | None = None, water_only: bool = True) -> DataFrame:
    rows = nodes.where("category = 'WAT'") if water_only else nodes
    if selection != "all" and active is not None:
        rows = rows.join(active.select(*KEYS, "category", "atom_index"), [*KEYS, "category", "atom_index"], "left_semi")
    return rows.select(*KEYS, "atom_index", "x", "y", "z")
