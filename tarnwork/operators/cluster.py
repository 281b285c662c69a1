"""Clusters of points: DBSCAN as joins; HDBSCAN and OPTICS, sequential by nature, in numpy per group."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .graph import components
from .spatial import radius_join


def dbscan(points: DataFrame, eps: float, min_samples: int = 10, keys: tuple[str, ...] = (), id_col: str = "id") -> DataFrame:
    """(keys, id, label): label is the smallest core id of the cluster, -1 for noise.  A point counts among its neighbours.

    A border point joins the cluster with the smallest label among its core neighbours.
    """
    if eps is None or eps <= 0:
        raise ValueError("eps must be positive")
    p = points.select(*keys, F.col(id_col).alias("id"), "x", "y", "z").withColumn("_k", F.lit(0))
    on = (*keys, "_k")
    near = radius_join(p, p, eps, keys=on, id_col="id", closed=True).select(*on, F.col("l.id").alias("src"), F.col("r.id").alias("dst"))
    near = stage(near)
    core = near.groupBy(*on, "src").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(*on, F.col("src").alias("id"))
    among = near.join(core.withColumnRenamed("id", "src"), [*on, "src"], "left_semi").join(core.withColumnRenamed("id", "dst"), [*on, "dst"], "left_semi")
    label = components(core, among, on)
    reach = near.join(label.select(*on, F.col("id").alias("dst"), "component"), [*on, "dst"]).groupBy(*on, F.col("src").alias("id")).agg(F.min("component").alias("border"))
    out = p.join(label, [*on, "id"], "left").join(reach, [*on, "id"], "left")
    return out.select(*keys, "id", F.coalesce("component", "border", F.lit(-1)).alias("label"))


def centers(labelled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean position and size of each cluster; noise is left out."""
    return labelled.where("label >= 0").groupBy(*keys, "label").agg(*(F.avg(a).alias(a) for a in "xyz"), F.count("*").alias("n"))


def _cells(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Each point's cell as a number, and by how much it grows along each axis; told by at most the first three columns.

    Cells are at least as wide as ``r``, and no more than 2 ** 20 along an axis.
    """
    x = x[:, :3]
    low = x.min(0)
    cell = np.floor((x - low) / np.maximum(r * (1 + 1e-9), (x.max(0) - low) / (1 << 20))).astype(np.int64) + 1
    scale = np.cumprod(np.r_[1, (cell.max(0) + 2)[:0:-1]])[::-1]
    return cell @ scale, scale


def _spacing(x: np.ndarray) -> float:
    """A radius whose cells hold few points each, where points stand densest as well."""
    span = (x.max(0) - x.min(0))[:3]
    wide = span[span > 0]
    if not len(wide):
        return 1.0
    r = float(np.exp(np.log(wide / len(x) ** (1 / len(wide))).mean()))
    while r > wide.max() / (1 << 20) and (np.unique(_cells(x, r)[0], return_counts=True)[1].astype(float) ** 2).sum() > 16 * len(x):
        r /= 2
    return r


def _near_pairs(x: np.ndarray, ask: np.ndarray, r: float, step: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all pairs not farther apart than ``r`` with i in ``ask``, i itself included, some i at a time."""
    key, scale = _cells(x, r)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    # Cells next to each other on the last axis have following keys, so three of them are one range.
    shifts = np.array(list(itertools.product((-1, 0, 1), repeat=len(scale) - 1)), np.int64).reshape(3 ** (len(scale) - 1), -1) @ scale[:-1]
    lo = ranked.searchsorted((key[ask][:, None] + shifts - 1).ravel())
    sizes = ranked.searchsorted((key[ask][:, None] + shifts + 1).ravel(), "right") - lo
    who, ends = np.repeat(ask, len(shifts)), np.cumsum(sizes)
    each = len(shifts)
    at = 0
    while at < len(who):
        # Whole points, so that one's pairs come together.
        to = max(int(ends.searchsorted((ends[at - 1] if at else 0) + step)) // each * each, at + each)
        n = sizes[at:to]
        i = np.repeat(who[at:to], n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)]
        d = np.sqrt(((x[i] - x[j]) ** 2).sum(1))
        k = np.flatnonzero(d <= r)
        yield i[k], j[k], d[k]
        at = to


def _core(x: np.ndarray, copies: np.ndarray, k: int, r: float) -> np.ndarray:
    """Distance to the k-th nearest, a point itself and its copies included, by radii that double where they held too few."""
    core, ask = np.zeros(len(x)), np.flatnonzero(copies < k)
    while len(ask):
        for i, j, d in _near_pairs(x, ask, r):
            at = np.lexsort((d, i))
            i, d, n = i[at], d[at], np.cumsum(copies[j[at]])
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            before = np.repeat(np.r_[0, n[start[1:] - 1]], np.diff(np.r_[start, len(i)]))
            reached = np.flatnonzero(n - before >= k)
            first = reached[np.r_[True, i[reached][1:] != i[reached][:-1]]] if len(reached) else reached
            core[i[first]] = d[first]
        ask, r = ask[core[ask] == 0], 2 * r
    return core


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the labelled sets that edges (a, b) connect are made one."""
    a, b = label[a], label[b]
    while len(a):
        high, low = np.maximum(a, b), np.minimum(a, b)
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        label, a, b = root[label], root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return label


def _links(x: np.ndarray, core: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, mutual reachability distance) among which are all that any minimum spanning tree may have.

    By growing radii: an edge of a tree that is longer than a radius connects sets that shorter edges don't, so each
    radius is asked only of points outside the largest set, and only pairs of different sets are kept.  A radius that
    would keep many pairs a point is brought nearer to the one before.
    """
    label, found, done, most = np.arange(len(x)), [], 0.0, max(1 << 21, 16 * len(x))
    while label.any():
        sizes = np.bincount(label)
        largest = sizes.argmax() if done else -1
        some, held = [], 0
        for i, j, d in _near_pairs(x, np.flatnonzero(label != largest), r):
            w = np.maximum(np.maximum(d, core[i]), core[j])
            # Pairs of two points that are both asked come twice.
            k = np.flatnonzero((w <= r) & (label[i] != label[j]) & ((label[j] == largest) | (i < j)))
            some.append((i[k], j[k], w[k]))
            held += len(k)
            if held > most and r - done > 1e-6 * r:
                break
        else:
            found += some
            for i, j, _ in some:
                label = _merge(label, i, j)
            done, r = r, 2 * r
            continue
        r = done + (r - done) / 2
    return tuple(np.concatenate([f[c] for f in found] or [np.zeros(0, int if c < 2 else float)]) for c in range(3))


def _tree(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum spanning tree of mutual reachability distances, by Prim's method: rows (a, b, distance), ascending.

    Of several points as near, the one with the least number comes next, from the first that was as near.  Copies of a
    point are one place; the method goes along the places' links in a heap instead of comparing all points at each step.
    """
    places, first, place, copies = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    place, k = place.ravel(), min(k, len(x))
    r = _spacing(places)
    core = _core(places, copies, k, r)
    a, b, w = _links(places, core, max(r, float(np.median(core))))
    ends = np.r_[a, b]
    order = np.argsort(ends, kind="stable")
    to, weight, bounds = np.r_[b, a][order], np.r_[w, w][order], np.searchsorted(ends[order], np.arange(len(places) + 1))
    members = np.split(np.argsort(place, kind="stable"), np.cumsum(copies)[:-1]) if len(places) < len(x) else None
    best, link, seen, out = np.full(len(places), np.inf), np.zeros(len(places), int), np.zeros(len(places), bool), []
    heap: list[tuple[float, int, int]] = []
    at = 0
    while True:
        here = place[at]
        if not seen[here]:
            seen[here] = True
            if copies[here] > 1:
                via = at if core[here] < best[here] else link[here]
                for other in members[here][1:].tolist():
                    heapq.heappush(heap, (float(core[here]), other, int(via)))
            lo, hi = bounds[here], bounds[here + 1]
            near, d = to[lo:hi], weight[lo:hi]
            closer = ~seen[near] & (d < best[near])
            near, d = near[closer], d[closer]
            best[near], link[near] = d, at
            for entry in zip(d.tolist(), first[near].tolist(), itertools.repeat(at)):
                heapq.heappush(heap, entry)
        # A place is reached once, each of its copies once.
        while heap and heap[0][1] == first[place[heap[0][1]]] and seen[place[heap[0][1]]]:
            heapq.heappop(heap)
        if not heap:
            break
        d, at, before = heapq.heappop(heap)
        out.append((before, at, d))
    return np.array(sorted(out, key=lambda e: (e[2], e[0], e[1])), float).reshape(-1, 3)


def hdbscan_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, epsilon: float = 0.0) -> np.ndarray:
    """Labels from 0, -1 for noise: single linkage on mutual reachability, condensed, chosen by excess of mass."""
    x = np.asarray(x, float)
    n, fine = len(x), np.isfinite(x).all(1)
    if not fine.all():  # at no distance to any other
        out = np.full(n, -1)
        out[fine] = hdbscan_labels(x[fine], min_cluster_size, min_samples, epsilon)
        return out
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    tree = _tree(x, min_samples or min_cluster_size)
    parent, size, children = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (a, b, d) in enumerate(tree):
        i, j, new = find(int(a)), find(int(b)), n + step
        parent[i] = parent[j] = new
        size[new] = size[i] + size[j]
        children[new] = (i, j, d)

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(children[v][:2])
        return out

    # Condensed tree: cluster -> birth, stability, children clusters, points.
    root = 2 * n - 2
    birth, stable, below, node_of = {root: 0.0}, {root: 0.0}, {root: []}, {root: root}
    stack = [(root, root)]
    fallen: dict[int, list[int]] = {root: []}
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        i, j, d = children[node]
        lam = 1 / d if d > 0 else np.inf
        big = [c for c in (i, j) if size[c] >= min_cluster_size]
        gain = min(lam, 1e12) - birth[cluster]
        if len(big) == 2:
            stable[cluster] += gain * size[node]
            for c in big:
                birth[c], stable[c], below[c], fallen[c], node_of[c] = min(lam, 1e12), 0.0, [], [], c
                below[cluster].append(c)
                stack.append((c, c))
        else:
            lost = [c for c in (i, j) if c not in big]
            stable[cluster] += gain * sum(size[c] for c in lost)
            if big:
                stack.append((big[0], cluster))
    chosen: set[int] = set()
    value: dict[int, float] = {}
    best: set[int] = set()
    for c in sorted(birth, key=lambda c: c):  # children have smaller numbers than parents
        inner = sum(value[b] for b in below[c])
        if c != root and (not below[c] or stable[c] >= inner):
            value[c] = stable[c]
            best.add(c)
        else:
            value[c] = inner
    pending = [root]
    while pending:  # the outermost that outweigh what is below them
        c = pending.pop()
        if c in best:
            chosen.add(c)
        else:
            pending.extend(below[c])
    if epsilon > 0:  # clusters born nearer than epsilon give way to the ancestor that isn't
        up = {b: c for c in below for b in below[c]}
        raised = set()
        for c in chosen:
            while c in up and up[c] != root and 1 / max(birth[c], 1e-12) < epsilon:
                c = up[c]
            raised.add(c)
        chosen = {c for c in raised if not any(a in raised for a in _above(c, up))}
    out = np.full(n, -1)
    for k, c in enumerate(sorted(chosen, key=lambda c: min(leaves(c)))):
        out[leaves(c)] = k
    return out


def _above(c: int, up: dict[int, int]) -> list[int]:
    out = []
    while c in up:
        c = up[c]
        out.append(c)
    return out


def _reachability(x: np.ndarray, min_samples: int, max_eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of visits, and by point: distance at which it was reached, from which point, and core distance."""
    n = len(x)
    dist = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    core = np.array([np.partition(dist(i), min_samples - 1)[min_samples - 1] if n >= min_samples else np.inf for i in range(n)])
    core[core > max_eps] = np.inf
    reach, origin, done, order = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), []
    while len(order) < n:
        # Of those waiting the nearest, where none waits the first that is left.
        at = int(np.where(done, np.inf, reach).argmin())
        if done[at] or not np.isfinite(reach[at]):
            at = int(done.argmin())
        done[at] = True
        order.append(at)
        if np.isfinite(core[at]):
            d = dist(at)
            new = np.maximum(d, core[at])
            better = ~done & (d <= max_eps) & (new < reach)
            reach[better], origin[better] = new[better], at
    return np.array(order, int), reach, origin, core


def _steep_end(steep: np.ndarray, against: np.ndarray, start: int, patience: int) -> int:
    """The last steep place of the area that begins at ``start``: none goes against it, at most ``patience`` in a row aren't steep."""
    end, idle = start, 0
    for at in range(start, len(steep)):
        if steep[at]:
            end, idle = at, 0
        elif against[at] or idle == patience:
            break
        else:
            idle += 1
    return end


def _valleys(plot: np.ndarray, source: np.ndarray, xi: float, min_samples: int, min_size: int) -> list[tuple[int, int]]:
    """First and last place of each cluster in a reachability plot, inner ones before outer ones.

    A cluster lies between an area that falls steeply (by a share ``xi`` from one place to the next) and one that rises so,
    and is lower than both its ends.  ``source`` is the place from which a place was reached: a cluster's last places go
    that were reached from outside and stand higher than its first.
    """
    plot = np.append(plot, np.inf)
    keep = 1 - xi
    here, after = plot[:-1], plot[1:]
    fall, rise = (here > after), (here < after)
    steep_fall, steep_rise = fall & (after <= here * keep), rise & (here <= after * keep)
    falls: list[list] = []  # first place, last place, highest place since
    found, at, high = [], 0, 0.0
    for start in np.flatnonzero(steep_fall | steep_rise):
        if start < at:
            continue
        high = max(high, plot[at : start + 1].max())
        falls = [[a, b, max(top, high)] for a, b, top in falls if high <= plot[a] * keep] if np.isfinite(high) else []
        if steep_fall[start]:
            end = _steep_end(steep_fall, rise, start, min_samples)
            falls.append([start, end, 0.0])
            at = end + 1
            high = plot[at]
            continue
        end = _steep_end(steep_rise, fall, start, min_samples)
        at = end + 1
        high = plot[at]
        here_found = []
        for a, b, top in falls:
            if plot[at] * keep < top:
                continue
            first, last = a, end
            if plot[a] * keep >= plot[at]:  # falls from higher than it rises to: begins where the fall is as low
                while plot[first + 1] > plot[at] and first < b:
                    first += 1
            elif plot[at] * keep >= plot[a]:  # rises higher: ends where the rise is as high
                while last > start and plot[last - 1] > plot[a]:
                    last -= 1
            while last > first and plot[first] <= plot[last] and not first <= source[last] <= last:
                last -= 1
            if last > first and last - first + 1 >= min_size and first <= b and last >= start:
                here_found.append((int(first), int(last)))
        found += here_found[::-1]
    return found


def optics_labels(x: np.ndarray, min_samples: int = 5, max_eps: float = np.inf, cut: float | None = None, xi: float | None = None, min_cluster_size: int | None = None) -> np.ndarray:
    """Labels from 0, -1 for noise, of the OPTICS plot: with ``xi`` its innermost valleys, else the plot cut at ``cut``.

    ``cut`` is ``max_eps`` by default, or twice the median core distance where that has no bound.
    """
    n = len(x)
    if not n:
        return np.zeros(0, int)
    if xi is not None and not 0 < xi < 1:
        raise ValueError("xi lies between 0 and 1")
    order, reach, origin, core = _reachability(np.asarray(x, float), min_samples, max_eps)
    out, label = np.full(n, -1), -1
    if xi is not None:
        place = np.empty(n, int)
        place[order] = np.arange(n)
        source = np.where(origin[order] < 0, -1, place[origin[order]])
        for first, last in _valleys(reach[order], source, xi, min_samples, min_cluster_size or min_samples):
            members = order[first : last + 1]
            if (out[members] < 0).all():
                label += 1
                out[members] = label
        return out
    known = core[np.isfinite(core)]
    if cut is None:
        cut = max_eps if np.isfinite(max_eps) else np.median(known) * 2 if len(known) else 0
    for i in order:
        if reach[i] > cut:
            if core[i] <= cut:
                label += 1
                out[i] = label
        else:
            out[i] = label
    return out


def by_group(points: DataFrame, method: str, keys: tuple[str, ...], columns: tuple[str, ...] = ("x", "y", "z"), id_col: str = "id", **options) -> DataFrame:
    """(keys, id, label) by hdbscan or optics; each group is one task's work, in memory."""
    run = {"hdbscan": hdbscan_labels, "optics": optics_labels}.get(method)
    if run is None:
        raise ValueError(f"unknown clustering method {method!r}; there are dbscan, hdbscan and optics")
    rows = points.select(*keys, F.col(id_col).alias("id"), *(F.col(c).cast("double") for c in columns))

    def label(group):
        group = group.sort_values("id", kind="stable")
        group["label"] = run(group[list(columns)].to_numpy(), **options).astype("int64")
        return group[[*keys, "id", "label"]]

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, "id"))
    return rows.groupBy(*keys).applyInPandas(label, f"{types}, label long")


def cluster(points: DataFrame, method: str = "hdbscan", keys: tuple[str, ...] = (), eps: float | None = None, min_samples: int = 10, **options) -> DataFrame:
    """Labels by any method; without keys all points are one group."""
    if method == "dbscan":
        return dbscan(points, eps, min_samples, keys)
    if method == "optics":
        # Clusters are the plot's valleys; eps, which would cut it, says nothing of them.
        options = {"xi": 0.05} | options | {"min_samples": min_samples}
    elif method == "hdbscan":
        options |= {"min_cluster_size": min_samples} | ({"epsilon": eps} if eps else {})
    else:
        raise ValueError(f"unknown clustering method {method!r}; there are dbscan, hdbscan and optics")
    on = keys or ("_all",)
    rows = points if keys else points.withColumn("_all", F.lit(0))
    out = by_group(rows, method, on, **options)
    return out if keys else out.drop("_all")
