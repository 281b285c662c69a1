"""MinHash near-dedup with tensored banding.

A document's set is its distinct word shingles.  Two collections of ``side`` bands, of ``rows`` min-hashes each, are
computed; table (i, j) is keyed by band i of the first collection and band j of the second.  So side * side tables of
2 * rows hashes cost 2 * side * rows min-hashes instead of side * side * 2 * rows.  Two documents are candidates if they
share a band in both collections: at similarity s with probability (1 - (1 - s^rows)^side)^2, which is 0.9993 at 0.8
and over 0.9999 at 0.85 for 12 bands of 3.

Documents with one and the same set are one class, represented by its smallest id.  Two classes share a table's key only
if they share both its bands, so bands that one class alone has are dropped before table keys are formed.  Within a
table's bucket classes are verified on their full sets against a leader (against further ones where ``leaders`` says so); of what
is then still apart within a bucket, the pairs that an exact prefix filter leaves are verified (see
:func:`_apart`).  So a group of near copies costs its size, not its square, and no link between components is lost: pairs
left out are already connected or too different.  Sets are verified in Spark expressions; a leader's set is sent once for
each 64 members.

Words: runs of characters other than ASCII blanks, A-Z in lower case.  A document with fewer words than a shingle has its
whole sequence as one; one without words (null or empty text) has an empty set and links with nothing.  Shingles are
64-bit hashes.  Rows that repeat an id are each reported, with the component of their own text's class; a class of
several texts of one id links as that id.  Long texts are hashed whole.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, ship, sliced, stage
from .components import components

SIDE, ROWS = 12, 3
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _randoms(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTES = _randoms(11, 256)
_BASE = int(_randoms(12, 1)[0] | np.uint64(1))
_BACK = pow(_BASE, -1, 1 << 64)
_SCALE, _SHIFT = _randoms(13, 2 * SIDE * ROWS) | np.uint64(1), _randoms(14, 2 * SIDE * ROWS)
#: ASCII: capitals to small letters.  Blanks are space and 9 to 13.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(4)
def _power(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2^bits powers of the base and of its inverse, modulo 2^64."""
    out = []
    for b in (_BASE, _BACK):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(max(16, len(raw).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
    words = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    if len(words) < k:
        return np.array([_chain([words[i : i + 1] for i in range(len(words))], len(words))[0]], np.uint64)
    return np.unique(_chain([words[i : len(words) - k + 1 + i] for i in range(k)], k))


def _chain(parts: list[np.ndarray], k: int) -> np.ndarray:
    out = np.full(len(parts[0]), k, np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """The hashes of the 2 * SIDE bands of a set that isn't empty."""
    best = np.empty(len(_SCALE), np.uint64)
    for k in range(0, len(_SCALE), 12):
        part = found[None, :] * _SCALE[k : k + 12, None] + _SHIFT[k : k + 12, None]
        best[k : k + 12] = (part ^ (part >> np.uint64(32))).min(1)
    out = np.arange(2 * SIDE, dtype=np.uint64)
    for row in best.reshape(2 * SIDE, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def _texts(batch, column: int):
    """The texts as bytes; copies of few rows' texts exist at once, not of a whole Arrow batch's."""
    import pyarrow as pa

    for at in range(0, batch.num_rows, 64):
        yield from batch.column(column).slice(at, 64).cast(pa.binary()).to_pylist()


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_shingles, f1, f2, bands): th is a hash of the text; f1 and f2 stand for the whole set; bands is null for an empty one."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, 2):
            n, f1, f2, b = [], [], [], []
            for text in _texts(batch, 2):
                found = shingles(text or b"", k)
                n.append(len(found))
                if len(found):
                    f1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(np.bitwise_xor.reduce(mixed(found + _MIX1)).view(np.int64)))
                    b.append(bands(found))
                else:
                    f1.append(None), f2.append(None), b.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(b, pa.list_(pa.int64()))],
                names=["id", "th", "n_shingles", "f1", "f2", "bands"],
            )
        _power.cache_clear()

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, th long, n_shingles long, f1 long, f2 long, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of (id, text), in batches of bounded size."""
    import pyarrow as pa

    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        def told(ids, found):
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

        for batch in batches:
            ids, found, held = [], [], 0
            for i, text in enumerate(_texts(batch, 1)):
                x = shingles(text or b"", k)
                if not len(x):
                    continue
                ids.append(i), found.append(x.view(np.int64))
                held += len(x)
                if held > 1_000_000:
                    yield told(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield told(ids, found)
        _power.cache_clear()

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, size: int = 64) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    Pairs are dealt by a and, where it has more than ``size`` of them, by a share of its b; each deal gets the set of a once.
    """
    parts = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / size).alias("parts")), "parts")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    dealt = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    leaders = parts.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    leaders = leaders.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = F.size(F.array_intersect("x", "y"))
    met = dealt.join(leaders, ["a", "part"]).select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return met.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def _apart(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts that may reach the similarity, by an exact prefix filter.

    Two sets of x and y shingles that reach it share at least w = percent (x + y) / (100 + percent) of them.  With all
    shingles in one order, the first x - w + 1 of one and the first y - w + 1 of the other then have one in common.  The
    order is by how many of these documents have a shingle, rarest first; so far copies of one text, which differ by
    words of their own, don't all meet.
    """
    here = rest.select("rep", "n", "part").distinct()
    tokens = sets.join(here.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("shingles").alias("token"))
    tokens = stage(tokens, "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    # n - ceil(n percent / 100) + 1 is the most that any partner leaves.
    first = tokens.join(counts, "token").withColumn("pos", place).join(here, F.col("id") == F.col("rep"))
    first = first.where((F.col("df") > 1) & (F.col("pos") <= F.floor(F.col("n") * (100 - percent) / 100) + 1))
    first = stage(first.select("token", "rep", "n", "part", "pos"), "first")
    left, right = (first.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "part", "pos"))) for x in "ab")
    w = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    fits = (F.col("pos_a") <= F.col("n_a") - w + 1) & (F.col("pos_b") <= F.col("n_b") - w + 1)
    pairs = left.join(right, "token").where((F.col("rep_a") < F.col("rep_b")) & (F.col("part_a") != F.col("part_b")) & fits)
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leaders: int = 1) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    component_id is the smallest id reachable by links of similarity ``percent`` or more, the row's own included; kept is
    true where they are the same.  Null ids link with nothing and are kept.
    """
    found = _components(docs, k, percent, id_col, text_col, leaders)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, leaders: int) -> DataFrame:
    """(id, th, n_shingles, component_id, kept) of every row."""
    sketched = stage(sketch(docs, k, id_col, text_col), "sketches")
    named = sketched.where("id is not null and f1 is not null")
    classes = stage(named.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min("n_shingles").alias("n")), "classes")
    members, lead = _buckets(classes)
    inside = stage(members.select(F.col("rep").alias("id")).distinct(), "inside")
    texts = among(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), inside, "id")
    sets = stage(_sets(texts, k).distinct(), "sets")
    similar = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    where = None
    now = stage(members.join(lead, "key").select("key", "rep", "n", "lead", F.col("rep").alias("part")), "members")
    for step in range(leaders + 1):
        if step < leaders:
            pairs = now.where((F.col("part") != F.col("lead.part")) & similar(F.col("n"), F.col("lead.n"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        else:
            pairs = _apart(now, sets, percent)
        links = _verified(stage(pairs.distinct(), "pairs"), sets, percent)
        where = components(links if where is None else links.union(where))
        if step < leaders:
            # What is left: buckets whose members a link has not joined yet, with another leader.
            now = now.select("key", "rep", "n").join(where.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component_id", "rep").alias("part"))
            order = F.struct(F.xxhash64(F.lit(step), F.col("rep")).alias("order"), "rep", "n", "part")
            lead = now.groupBy("key").agg(F.min(order).alias("lead"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key", "lead")
            now = stage(now.join(lead, "key"), "rest")
    return _report(sketched, classes, where)


def _buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, rep, n, degree) of every class and table, as far as its bands are shared, and (key, lead) of buckets with several classes.

    The class that meets most others leads: the text that copies were made from meets more of them than they meet each
    other.  Counts, minima and maxima are summed before each shuffle, so no key gathers.
    """
    bands = classes.select("rep", "n", F.posexplode("bands").alias("slot", "band")).withColumn("band", F.xxhash64("slot", "band"))
    counts = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = bands.join(counts, "band").groupBy("rep").agg(F.max("n").alias("n"), F.sum("size").alias("degree"), F.collect_set(F.struct("slot", "band")).alias("bands"))
    side = lambda test: F.transform(F.filter("bands", lambda b: test(b["slot"])), lambda b: b["band"])
    shared = shared.select("rep", "n", "degree", side(lambda i: i < SIDE).alias("left"), side(lambda i: i >= SIDE).alias("right"))
    shared = stage(shared.where("size(left) > 0 and size(right) > 0"), "shared")
    members = shared.select("rep", "n", "degree", "right", F.explode("left").alias("one")).select("rep", "n", "degree", "one", F.explode("right").alias("two"))
    members = members.select(F.xxhash64("one", "two").alias("key"), "rep", "n", "degree")
    order = F.struct((-F.col("degree")).alias("order"), "rep", "n", F.col("rep").alias("part"))
    lead = members.groupBy("key").agg(F.min(order).alias("lead"), F.min("rep").alias("p"), F.max("rep").alias("q")).where("p < q").select("key", "lead")
    return members, lead


def _report(sketched: DataFrame, classes: DataFrame, where: DataFrame) -> DataFrame:
    of = classes.join(where, classes["rep"] == where["id"], "left").select("f1", "f2", F.coalesce("component_id", "rep").alias("_c"))
    out = sketched.select("id", "th", "n_shingles", "f1", "f2").join(of, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_c", "id"))
    return out.select("id", "th", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leaders: int = 1) -> DataFrame:
    """The documents, all columns, of which one of each group stays: the one with the smallest id.

    Of rows that agree in id and text one stays; rows of one id whose texts have different sets are different documents.
    Rows without an id stay.
    """
    found = _components(docs, k, percent, id_col, text_col, leaders).where("id is not null")
    kept = stage(found.groupBy("id", "th").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "gone")
    rows = docs.withColumn("_th", F.xxhash64(text_col))
    known = kept.select(F.col("id").alias("_id"), F.col("th").alias("_known"), "kept")
    match = lambda t: (rows[id_col] == t["_id"]) & (rows["_th"] == t["_known"])
    out = rows.join(known, match(known), "left_anti")
    several = known.where("kept")
    if not several.isEmpty():
        out = out.union(rows.join(several, match(several), "left_semi").dropDuplicates([id_col, "_th"]))
    return out.drop("_th")
