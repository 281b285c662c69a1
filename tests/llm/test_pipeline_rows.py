"""All rows of the pipeline's run against a plain Python run of its five stages, on tables with every edge."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from tarnwork.llm import mixing, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def toxic(text, lexicon):
    """A naive matcher: every pattern is searched for at every place."""
    folded = toxicity.fold(text or "")
    best = {}
    for term, weight in lexicon.terms.items():
        at = folded.find(term)
        while at >= 0:
            best[at] = max(best.get(at, 0.0), weight)
            at = folded.find(term, at + 1)
    for phrase in lexicon.exceptions:
        phrase = f" {' '.join(toxicity.fold(phrase).split())} "
        at = folded.find(phrase)
        while at >= 0:
            best = {k: w for k, w in best.items() if not at <= k < at + len(phrase) - 1}
            at = folded.find(phrase, at + 1)
    total = sum(best.values())
    n = len((text or "").split())
    x = (float(bool(best)), total / (1 + total / 20), total / np.sqrt(1 + n / 100))
    z = lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], x, strict=True))
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def close(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(rows):
    """Rows (id, text, source); rows that repeat id and text are one document."""
    order = sorted({r[:2] for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
    seen, by, left = set(), collections.defaultdict(list), {}
    for r in order:
        lines = r[1].split("\n")
        stay = []
        for line in lines:
            s = line.strip(" \t\x0b\x0c\r")
            gone = len(s) >= 10 and (s in seen or len(s) >= 20 and any(close(s, o) for n in (-1, 0, 1) for o in by[len(s) + n]))
            if len(s) >= 10 and s not in seen:
                seen.add(s)
                if len(s) >= 20:
                    by[len(s)].append(s)
            if not gone:
                stay.append(line)
        left[r] = ("\n".join(stay), len(lines) - len(stay))
    out = []
    for i, t, s in rows:
        text, n = left.get((i, t), (t, 0))
        if n == 0 or WORD.search(text):
            out.append((i, text, s))
    return out


def near_dedup(rows, k=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {(i, t): shingles(t) for i, t, _ in rows if i is not None}
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = list(sets)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            u, v = sets[a], sets[b]
            if u and v and 100 * min(len(u), len(v)) >= 80 * max(len(u), len(v)) and 100 * len(u & v) >= 80 * len(u | v):
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    seen, out = set(), []
    for r in rows:
        if r[0] is None or find(r[0]) == r[0] and r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


def mix(rows):
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: float((3, 1, 2)[k % 3]) for k, s in enumerate(names)}
    cap, budget, target, free = {s: 2.0 * size[s] for s in names}, 1.5 * sum(size.values()), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap[s]}
        target |= {s: cap[s] if s in over else level * weight[s] for s in over or free}
        free -= over or free
    out = []
    for s in names:
        hashed = collections.defaultdict(list)
        for r in rows:
            if r[2] == s:
                hashed[int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)].append(r)
        goal = round(target[s], 6)
        whole = int(goal // size[s]) if size[s] else 0
        rest, upto, more = goal - whole * size[s], 0, set()
        if rest > 0:
            for h in sorted(hashed):
                own = sum(len(WORD.findall(r[1] or "")) for r in hashed[h])
                if upto + own > rest and not upto + own - rest < rest - upto:
                    break
                more.add(h)
                upto += own
                if upto > rest:
                    break
        for h, group in hashed.items():
            out += group * min(2, whole + (h in more))
    return out


def tables(spark, path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = docs[0][1]
    extra = [
        (None, base, "en", "s1", None), (None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, "en", "s1", 0), (-3, "  \n\t", None, "s1", 4),
        (-4, "word " * 4000, "en", "s2", 20000), (-5, "aé" * 3000 + "\n" + base, "en", "s2", 6001), (-6, base + " more words here", "en", "s2", 1), (-7, "one", "en", "s3", 3), (-7, "one", "en", "s3", 3),
        (-8, "\n".join(["this line stands here twice over", "this line stands here twice ovr", "short one", "short one"]), None, "s3", 1), (-9, docs[1][1].replace("the", "a", 1), "en", None, 1), docs[2], docs[2],
        (-10, "the same id, one text of two that differ in all but the id itself", "en", "s1", 1), (-10, "and here is the other text, which has no words in common with that", "en", "s2", 1),
    ]
    rude = [(5000 + i, f"some zorgle of number {i} stands here\nand " + " ".join(docs[i][1].split()[:30]), "en", f"s{i % 3}", 1) for i in range(80)]
    spark.createDataFrame(docs + extra + rude, KIND).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.union(spark.createDataFrame([(r[0], None, 1) for r in rude[:60]], labels.schema)).write.parquet(f"{path}/labels.parquet")
    return path


def test_all_rows_of_the_pipeline(spark, tmp_path):
    import tiktoken

    sf = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [r for r in rows if toxic(r[1], lexicon) < 0.5]
    assert 0 < len(clean) < len(rows)
    lined = line_dedup(clean)
    single = near_dedup(lined)
    assert len(single) < len(lined) <= len(clean)
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((i, hashlib.sha256(",".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest()) for i, t, _ in mix(single))
    got = collections.Counter((r["doc_id"], r["ids_sha256"]) for r in pipeline.run(spark, sf).collect())
    assert got == want


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_are_left_out(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.limit(20).select("*", *(F.lit("x").alias(c) for c in ("score", "copies", "size", "id", "key", "line", "kept", "goal", "_h", "toxic", "predicted")))
    for _, step in pipeline.STAGES[:-1]:
        assert step(spark, wide, SF).columns == docs.columns


def test_naive_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    own = toxicity.Lexicon({" tra": 2.0, " trash ": 4.0, " idiot ": 5.0, " s": 0.5, " st": 1.0}, curve=(-3.0, 2.0, 0.5, 0.5))
    extra = spark.createDataFrame([(1, "tr4sh can trash 1d10t stst trash can trash"), (2, None), (3, "")], "doc_id long, text string")
    for lexicon, table in ((toxicity.learn(docs, labels), docs), (own, docs), (own, extra)):
        text = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in toxicity.score(table, lexicon).collect():
            assert r["score"] == pytest.approx(toxic(text[r["doc_id"]], lexicon), abs=1e-12)


def test_mixing_of_ids_in_two_sources(spark):
    """Rows that share an id in sources of different budgets each get the copies of their own."""
    rows = [(1, "a b c", "a"), (1, "d e f g", "b"), (2, "x", "b"), (3, "y z", "c")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], KIND)
    got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.apply(docs).collect())
    assert got == collections.Counter(mix(rows))
