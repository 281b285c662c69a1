"""Near duplicates among embeddings with spherical-cap filters.

Filter directions form a structured random product code: a rotated vector is cut in two, each half has K random unit
directions, and every pair of them is a filter.  A vector passes the filters whose inner product with it reaches a
threshold; they are list-decoded from the 2K inner products of the halves, K * K filters are never looked at.  Vectors
that pass a common filter are candidates and are verified.

For n vectors of d components a filter lets a share p of random directions pass: 12/n, or more where two vectors of the
sought cosine would both pass a filter that one of them passes with a chance below ``MEET``.  Threshold and chance come
from the measure of caps on the sphere, which in few dimensions is far from the normal distribution's.  K is such that a
vector passes about ``passes`` filters, dealt over three independent codes, whatever n and d are.  A vector whose halves
are of unlike length passes few; it is given its best filters instead, half of the mean at least.  So practically no
link is missed (recall is measured in the tests).  Where filters would compare as many pairs as there are (few vectors,
or few components), all vectors of one length pass one common filter, and the result is exact.

Vectors travel to their filters in half precision.  What the rounding leaves undecided is verified in double precision.

Two vectors may meet in many filters, but their link is told once.  A vector carries its ``HEADS`` first filters in a hashed
order; the first that stands among the heads of both tells the link: its task adds it to the counts of both and keeps only
links that span what they join.  So groups of near copies leave counts and trees, not pairs.  Pairs without a common head
(few) and undecided ones are written as rows and made distinct.

Equal vectors are one class before any filter, so copies cost nothing.  A filter that more than ``chunk`` classes pass
is compared chunk with chunk by several tasks.  Vectors that are null, zero, hold null or non-finite components, or lack
an id link with nothing; vectors of different length don't link.  Null ids are kept, with themselves as component.  Rows
that repeat an id and its vector are one vector, reported each; of one id's different vectors each links by itself, and
the id counts once with either.  Columns other than id and vector are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage
from .components import components


#: Independent codes: a pair that one is unlucky with meets in another.
CODES = 3
#: Filters that each vector carries along, to tell where a link is counted.
HEADS = 12
#: Least chance that of two vectors at the sought cosine one passes a filter that the other passes.
MEET = 0.3
#: Vectors of fewer components are compared pair by pair: the product code fits them badly.
EXACT = 8


@lru_cache(8)
def _code(d: int, k: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the directions of both halves, from a fixed seed."""
    rng = np.random.default_rng([d, k, number])
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    halves = []
    for wide in (d // 2, d - d // 2):
        c = rng.standard_normal((k, wide))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return q, *halves


def decode(x: np.ndarray, k: int, threshold: float, number: int = 0, least: int = 0) -> list[np.ndarray]:
    """The filters, numbered i * k + j, that each unit row of ``x`` passes; its ``least`` best ones if it passes fewer."""
    q, one, two = _code(x.shape[1], k, number)
    y = x @ q.T
    half = x.shape[1] // 2
    s, t = y[:, :half] @ one.T / math.sqrt(2), y[:, half:] @ two.T / math.sqrt(2)
    out = []
    for a, b, low in zip(s, t, threshold - t.max(1), strict=True):
        i = np.flatnonzero(a >= low)
        f = np.zeros(0, np.int64)
        if len(i):
            j = np.flatnonzero(b >= threshold - a[i].max())
            u, v = np.nonzero(a[i][:, None] + b[j][None, :] >= threshold)
            f = i[u] * k + j[v]
        out.append(f if len(f) >= least else _best(a, b, k, least))
    return out


def _best(a: np.ndarray, b: np.ndarray, k: int, least: int) -> np.ndarray:
    """The filters of the largest sums; they join directions that are among the ``least`` best of either half."""
    i, j = (np.argsort(-x, kind="stable")[:least] for x in (a, b))
    sums = (a[i][:, None] + b[j][None, :]).ravel()
    u, v = np.divmod(np.argsort(-sums, kind="stable")[:least], len(j))
    return i[u] * k + j[v]


@lru_cache(64)
def _caps(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of random directions in d > 1 dimensions within each of a fixed direction."""
    angle = np.linspace(0, math.pi, 20_001)
    density = np.sin(angle).clip(0) ** (d - 2)
    share = np.append(0.0, np.cumsum(density[1:] + density[:-1]))
    return angle, share / share[-1]


def _meet(d: int, widest: float, cosine: float) -> float:
    """The chance that a vector is within the angle ``widest`` of a direction, if one at this cosine from it is; d > 2."""
    angle = np.linspace(0, widest, 2001)[1:]
    weight = (np.sin(angle) / math.sin(min(widest, math.pi / 2))) ** (d - 2)
    need = (math.cos(widest) - cosine * np.cos(angle)) / (math.sqrt(max(1e-12, 1 - cosine * cosine)) * np.sin(angle))
    return float(weight @ np.interp(np.arccos(need.clip(-1, 1)), *_caps(d - 1)) / weight.sum())


@lru_cache(1024)
def settings(n: int, d: int, passes: float, cosine: float = 0.95) -> tuple[int, float] | None:
    """K and the threshold of one code for n vectors of d components; None if all pairs are no more than filters would compare."""
    if d < EXACT:
        return None
    angle, share = _caps(d)
    low, high = float(np.interp(12 / max(24, n), share, angle)), math.pi / 2
    if _meet(d, low, cosine) < MEET:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (low, middle) if _meet(d, middle, cosine) >= MEET else (middle, high)
        low = high
    p = float(np.interp(low, angle, share))
    if 2 * CODES * passes * p >= 1:
        return None
    return max(8, math.ceil(math.sqrt(passes / p))), math.cos(low)


def filters(x: np.ndarray, n: int, passes: float, cosine: float = 0.95) -> list[np.ndarray]:
    """The filters of all codes that each unit row of ``x`` passes, of n vectors of its length."""
    d = x.shape[1]
    found = settings(n, d, passes / CODES, cosine)
    if found is None:
        return [np.array([d << 44])] * len(x)
    lists = [decode(x, *found, c, math.ceil(passes / CODES / 2)) for c in range(CODES)]
    return [np.concatenate([(c << 60) + (d << 44) + g for c, g in enumerate(f)]) for f in zip(*lists, strict=True)]


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slack(d: int) -> float:
    """By how much, at most, an inner product of unit vectors in half precision, summed in single precision, may be off."""
    half = 2.0**-11 + math.sqrt(d) * 2.0**-25
    return 2 * half + half * half + (d + 8) * 2.0**-23


def _heads(found: np.ndarray) -> bytes:
    """The first filters in a hashed order, filled up with -1."""
    order = np.argsort(found.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:HEADS]
    return np.append(found[order], np.full(HEADS - len(order), -1)).astype("<i8").tobytes()


def _told_at(heads: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the first head that both have, -1 if there is none."""
    out = np.full(len(i), -1, np.int64)
    for k in range(0, len(i), 20_000):
        a, b = heads[i[k : k + 20_000]], heads[j[k : k + 20_000]]
        common = (a[:, :, None] == b[:, None, :]).any(2) & (a >= 0)
        first = common.argmax(1)
        out[k : k + 20_000] = np.where(common.any(1), a[np.arange(len(a)), first], -1)
    return out


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of n rows those that a search keeps, which join the same rows."""
    if len(i) < 2:
        return i, j
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    unseen, out = np.ones(n, bool), []
    for start in np.unique(i):
        if not unseen[start]:
            continue
        unseen[start], waiting = False, [start]
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(linked[at] & unseen)
            unseen[new] = False
            out.extend((at, x) for x in new)
            waiting.extend(new)
    a, b = np.array(out).T
    return a, b


def _links(classes: DataFrame, n: dict[int, int], cosine: float, passes: float, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of classes whose vectors reach the cosine: links (a, b) that join all of them, counts (a, n) of the vectors beyond
    a's class, and pairs (a, b), a < b, that these counts leave out; ``n`` has the number of classes of each vector length."""
    import pyarrow as pa

    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            found: list = [None] * len(rows)
            by: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by.setdefault(len(r), []).append(i)
            packed, heads = [None] * len(rows), [None] * len(rows)
            for d, at in by.items():
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    x = _units(np.array([rows[i] for i in part]))
                    for i, v, f in zip(part, x.astype(np.float16), filters(x, n[d], passes, cosine), strict=True):
                        found[i], packed[i], heads[i] = f, v.tobytes(), _heads(f)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary()), pa.array(heads, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["rep", "members", "unit", "heads", "filters"]
            )

    passed = stage(classes.select("rep", "vector", "members").mapInArrow(run, f"rep {kind}, members long, unit binary, heads binary, filters array<long>"), "filters")
    rows = passed.select("rep", "members", "unit", "heads", F.explode("filters").alias("filter"))
    counts = passed.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / chunk))
    counts = stage(counts, "counts")
    work = counts.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    bins = max(1, math.ceil(work / 20_000))
    # Only filters of several chunks are joined, so that vectors are shuffled once: to the tasks that compare them.
    several = stage(counts.where("parts > 1").select("filter", "parts"), "several")
    met = rows.join(several, "filter", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("rep", "members", "unit", "heads", "filter", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), (F.col("own") <= F.col("other")).alias("first"))
    met = met.withColumn("bin", F.pmod(F.xxhash64("filter", "u", "v"), F.lit(bins)))

    def compare(rows):
        import pandas as pd

        rows = rows.sort_values(["filter", "u", "v"], kind="stable")
        key = rows[["filter", "u", "v"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        reps, first = rows["rep"].to_numpy(), rows["first"].to_numpy()
        units = rows["unit"].to_numpy()
        members = rows["members"].to_numpy()
        heads = np.frombuffer(b"".join(rows["heads"]), "<i8").reshape(-1, HEADS)
        beyond = np.zeros(len(rows), np.int64)
        out: list[tuple] = []
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(key)], strict=True):
            if hi - lo < 2:
                continue
            x = np.frombuffer(b"".join(units[lo:hi]), np.float16).reshape(hi - lo, -1).astype(np.float32)
            products, slack = x @ x.T, _slack(x.shape[1])
            i, j = np.nonzero(products >= cosine - slack)
            keep = (i < j) & (reps[lo + i] != reps[lo + j])
            if key[lo, 1] != key[lo, 2]:
                keep &= first[lo + i] != first[lo + j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            sure, told = products[i, j] >= cosine + slack, _told_at(heads[lo:hi], i, j)
            here = sure & (told == key[lo, 0])
            for p, q in ((i, j), (j, i)):
                np.add.at(beyond, lo + p[here], members[lo + q[here]])
            for what, (p, q) in (("link", _spanning(hi - lo, i[here], j[here])), ("sure", (i[sure & (told < 0)], j[sure & (told < 0)])), ("doubt", (i[~sure], j[~sure]))):
                out.append((reps[lo + p], reps[lo + q], np.full(len(p), what, object), np.zeros(len(p), np.int64)))
        some = np.flatnonzero(beyond)
        out.append((reps[some], reps[some], np.full(len(some), "count", object), beyond[some]))
        a, b, what, number = (np.concatenate(c) for c in zip(*out, strict=True))
        told = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "what": what, "n": number})
        return told.groupby(["a", "b", "what"], as_index=False)["n"].sum()

    told = stage(met.groupBy("bin").applyInPandas(compare, f"a {kind}, b {kind}, what string, n long"), "told")
    counts = told.where("what = 'count'").groupBy("a").agg(F.sum("n").alias("n"))
    near = told.where("what in ('sure', 'doubt')").groupBy("a", "b").agg(F.max(F.col("what") == "sure").alias("sure"))
    doubtful = near.where("not sure").select("a", "b")
    for side in "ab":
        doubtful = doubtful.join(classes.select(F.col("rep").alias(side), F.col("vector").alias(f"v{side}")), side)

    def verify(batches):
        for batch in batches:
            u, v = (batch.column(k).to_pylist() for k in (2, 3))
            reached = [float(np.dot(*_units(np.array(p)))) >= cosine for p in zip(u, v, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(reached, pa.bool_()))

    verified = doubtful.select("a", "b", "va", "vb").mapInArrow(verify, f"a {kind}, b {kind}")
    pairs = stage(near.where("sure").select("a", "b").union(verified.distinct()), "pairs")  # ids may repeat
    return told.where("what = 'link'").select("a", "b").union(pairs), counts, pairs


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, passes: float = 110, chunk: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: direct links, smallest id reachable, whether that is its own."""
    ship(vectors.sparkSession)
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound, v).alias("vector"))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("members"))
    classes = stage(classes, "classes")
    n = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    links, counts, pairs = _links(classes, n, cosine, passes, chunk)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.groupBy("rep").agg(F.sum("members").alias("members"))
    beyond = both.join(sizes.withColumnRenamed("rep", "b"), "b").select("a", F.col("members").alias("n")).union(counts)
    beyond = beyond.groupBy("a").agg(F.sum("n").alias("beyond"))
    where = components(links)
    facts = classes.join(beyond, classes["rep"] == beyond["a"], "left").join(where, F.col("rep") == where["id"], "left")
    facts = facts.select("vector", (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(facts, "vector", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
