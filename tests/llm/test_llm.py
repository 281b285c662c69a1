"""Document operators against brute force, exact round trips and held-out accuracy, on small tables with every edge."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import bpe, capfilter, licenses, linededup, minhash, mixing, pii, quality, rangecoder, tokenfile, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, id string"
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from it all again today"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names operators use."""
    texts = [(1, BASE), (2, BASE), (2, BASE), (3, BASE + " x"), (4, ""), (5, None), (6, "  \n\t "), (None, BASE), (7, "ab" * 20000), (8, "word " * 5000), (9, "Ünï çôdé 日本 \U0001f600 " * 3), (10, None), (11, "one")]
    rows = [(i, t, None if i == 3 else "en", None if i in (1, 5) else f"s{(i or 0) % 3}", None, "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def components_of(n, links):
    parent = {i: i for i in n}

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_empty_tables(spark, edge):
    none = edge.where("false")
    assert quality.quality(none).count() == pii.find(none).count() == mixing.mix(none).count() == linededup.dedup(none).count() == minhash.near_duplicates(none).count() == 0
    assert bpe.tokenize(none, tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == licenses.scan(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    assert capfilter.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out()).select("predicted", "toxic").collect()
    truth = collections.Counter((r["predicted"], r["toxic"]) for r in rows)
    assert truth[0, 0] / (truth[0, 0] + truth[1, 0]) > 0.95 and truth[1, 1] >= truth[0, 1]


def test_toxicity_folds(edge):
    lex = toxicity.Lexicon({" idiot ": 5.0, " trash ": 4.0}, curve=(-3.0, 4.0, 0.5, 0.5))
    for text in ("an 1d10t", "an IDIOT!", "an іdiot", "trash"):
        assert lex.score(lex.features(text)) > 0.5, text
    for text in ("", "idiotic", "a trash can"):
        assert lex.score(lex.features(text)) < 0.5, text
    rows = toxicity.score(edge, lex).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_quality(docs, edge):
    import re

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(repeated)

    for table in (docs, edge):
        for r in quality.quality(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["kept"] and r["base_failed"])


def test_mixing(docs, edge):
    for table in (docs, edge):
        rows = mixing.mix(table).join(table.select("doc_id", "source").distinct(), "doc_id").collect()
        size, target, taken = {}, {}, collections.Counter()
        for r in rows:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            size[r["source"]], target[r["source"]] = r["source_size"], r["target"]
            taken[r["source"]] += r["taken"]
        if table is docs:
            assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()), rel=1e-6)
            longest = max(r["size"] for r in rows)
            assert all(abs(taken[s] - target[s]) <= longest for s in target)
        assert all(target[s] <= 2 * size[s] + 1e-6 for s in target)
        again = mixing.mix(table.repartition(3)).collect()
        assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(table).collect())


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 100)], "source string, source_size long")
    # Weights 3, 1, 2 of 315: a stops at 20, the rest by 1 to 2.
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx(295 / 3) and got[None] == pytest.approx(590 / 3)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    x = np.vstack([base, base + 0.15 * rng.normal(size=base.shape), base[:3] * 7, base[:1]])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0, None]), (None, [1.0] * 24), (1004, [])]
    got = {r["vec_id"]: r for r in capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in np.argwhere(u @ u.T >= 0.95) if i < j]
    comp = components_of(range(len(x)), links)
    for i in range(len(x)):
        assert got[i]["n_links"] == sum(i in p for p in links) and got[i]["component_id"] == comp[i] and got[i]["kept"] == (comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, None))


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark, edge):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(4):
            line = list(" ".join(rng.choice(words, 5)))
            for _ in range(rng.integers(0, 3)):
                k = rng.integers(0, len(line))
                line[k : k + 1] = list(rng.choice(["", "q", "qq"], 1)[0])
            lines.append("".join(line))
        rows.append((i, "\n".join(lines + lines[:1] + ["short"])))
    rows = [(i, t) for i, t in rows] + [(100 + i, rows[0][1].replace("a", "b", i)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    seen = []
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            s = line.strip()
            gone = len(s) >= 10 and any(s == o or len(s) >= 20 and len(o) >= 20 and edit_at_most_one(s, o) for o in seen)
            if len(s) >= 10:
                seen.append(s)
            if not gone:
                kept.append(line)
        assert got[i] == "\n".join(kept), i
    out = linededup.dedup(edge)
    assert out.count() == edge.count() and set(edge.columns) <= set(out.columns)


def test_range_coder():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 511, 512, 513, 20000):
        for top, bits in ((3, 16), (65536, 16), (1_000_000, 20)):
            ids = rng.integers(0, top, n)
            assert (rangecoder.unpack(rangecoder.pack(ids, bits)) == ids).all()
    packed = bytearray(rangecoder.pack(rng.integers(0, 100, 3000)))
    packed[-40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.unpack(bytes(packed))
    assert len(rangecoder.pack(np.tile(np.arange(40), 500))) < 8000


def test_range_coder_mixes_its_predictions(docs):
    """On real ids, and on two blocks of them, less than the order-0 entropy of the whole; on ids without any structure, hardly more."""
    encoder = tokenfile.WordEncoder(tokenizers.path("word_bpe_49k.json"))
    ids = np.concatenate(encoder.encode([t or "" for _, t in texts_of(docs)])).astype(np.int64)
    whole = np.tile(ids, 1 + 200_000 // len(ids))[:200_000]
    share = np.bincount(whole) / len(whole)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    packed = rangecoder.pack(whole)
    assert 8 * len(packed) / len(whole) < entropy and (rangecoder.unpack(packed) == whole).all()
    noise = np.random.default_rng(1).integers(0, 256, 200_000)
    assert 8 * len(rangecoder.pack(noise)) / len(noise) < 8.4
    two = np.tile(whole, 6)
    assert len(two) > rangecoder.BLOCK
    packed = rangecoder.pack(two)
    assert (rangecoder.unpack(packed) == two).all()
    with pytest.raises(ValueError):
        rangecoder.unpack(packed[:-5])


def test_range_coder_room(docs):
    """Joint arrays and ages by counts save time, not adaptation: real ids take less room than the 7.875 bits before, and rare or unseen ids are found."""
    encoder = tokenfile.WordEncoder(tokenizers.path("word_bpe_49k.json"))
    ids = np.concatenate(encoder.encode([t or "" for _, t in sorted(texts_of(docs))])).astype(np.int64)
    packed = rangecoder.pack(ids)
    assert 8 * len(packed) / len(ids) < 7.87 and (rangecoder.unpack(packed) == ids).all()
    rare = np.tile([0, 7], 150_000)
    rare[::1000] = np.random.default_rng(2).integers(0, 1_000_000, 300)
    assert (rangecoder.unpack(rangecoder.pack(rare, 20)) == rare).all()
    # Lanes and steps where blocks end unevenly, all ids alike, and only the largest.
    for n in (rangecoder.LANES * rangecoder.STEPS - 1, 257 * 300 + 1):
        for some in (np.zeros(n, np.int64), np.full(n, 65535), np.arange(n) % 3):
            assert (rangecoder.unpack(rangecoder.pack(some)) == some).all()


def test_letters_of_every_byte():
    """Each Latin-1 letter, alone and within words, as the library itself has it."""
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library, letters = Tokenizer.from_file(path), [chr(k) for k in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))]
    words = [*letters, *(f"{a}{b}" for a in letters for b in "aZ\u00e0\u00cd\u00df"), "".join(letters)]
    got = tokenfile.WordEncoder(path).encode(words)
    assert [x.tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_token_file(spark, docs, edge, tmp_path):
    """Also strings of special tokens, which the library takes for those tokens."""
    from tokenizers import Tokenizer

    marked = edge.limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit("a <|endoftext|> b<|startoftext|>c <|endoftext"))
    edge = edge.union(marked)

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for k, table in enumerate((docs, edge)):
        tokenfile.write(table, str(tmp_path / f"t{k}"), path)
        got = tokenfile.read(spark, str(tmp_path / f"t{k}")).orderBy("start").collect()
        order = sorted(texts_of(table), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        at = 0
        for r, (i, t) in zip(got, order, strict=True):
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    tokenfile.write(edge.where("false"), str(tmp_path / "none"), path)
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(docs, edge, k):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    for table in (docs, edge.where("doc_id is not null")):
        sets = {i: shingles(t) for i, t in texts_of(table)}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        comp = components_of(sets, links)
        for r in minhash.near_duplicates(table, k).collect():
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert [r["kept"] for r in minhash.near_duplicates(edge, k).where("doc_id is null").collect()] == [True]


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_pii(spark, docs, edge):
    import re

    extra = spark.createDataFrame(
        [(50, "a.b@c.de_x@y.z é 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 4111 1111-1111 1111 +1 (555) 555-7713. +12"), (51, "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00"), (52, "1" * 20000 + "x" * 30000 + "@" + "." * 1000)],
        "doc_id long, text string",
    )
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for table in (docs, edge, extra):
        text = dict(texts_of(table))
        for r in pii.find(table).collect():
            t = text[r["doc_id"]] or ""
            want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules.values()) if r["doc_id"] != 52 or k in (1, 3) for m in re.finditer(p, t) if ok(m[0]))
            assert [(x["start"], x["ord"], x["end"]) for x in r["pii"] if x["ord"] < 4] == want
    found = {r["doc_id"]: [x["kind"] for x in r["pii"]] for r in pii.find(extra).collect()}
    assert found[51].count("iban") == 1


def test_licenses(docs, edge):
    import re

    base = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for table in (docs, edge):
        text = dict(texts_of(table))
        for r in licenses.scan(table).collect():
            t = re.sub("[A-Z]", lambda m: m[0].lower(), text[r["doc_id"]] or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
            places = sorted((i, label) for p, label in base.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    index = licenses.Index()
    assert [x for _, x, _ in index.scan("x y. This is licensed under the GNU General Public License, version 3. z")[2]] == ["gpl-3.0"]
    assert [x for _, x, _ in index.scan("MIT License.")[2]] == ["mit"] and index.scan("apache of the plains")[2] == []


def test_bpe(docs, edge):
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (docs, edge):
        text = dict(texts_of(table))
        for r in bpe.tokenize(table, path).collect():
            ids = library.encode_ordinary(text[r["doc_id"]] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_components(spark):
    from tarnwork.llm.components import components

    rng = np.random.default_rng(3)
    links = [tuple(map(int, p)) for p in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({i for p in links for i in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "mixing", "byte-level bpe"]
    now = docs
    for _, step in p.STAGES[:-1]:
        out = step(spark, now, SF)
        assert out.columns == docs.columns and 0 < out.count()
        now = out
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, lexicon).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in p.drop_toxic(spark, docs, SF).collect()} == clean
    last = {r["doc_id"] for r in p.run(spark, SF).collect()}
    assert last <= clean
    assert F


def test_bpe_with_a_small_cache(docs):
    """A cache that overflows again and again changes nothing."""
    encoder = bpe.Encoder(bpe.load(tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks, tokenizers.PATTERN, cache=50)
    whole = bpe.load(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [t for _, t in texts_of(docs)][:40]
    for k in range(0, 40, 3):
        part = texts[k : k + 3]
        assert list(encoder.encode(part)) == list(whole.encode(part))


def test_word_encoder_equals_the_library():
    """Words of both paths: plain letters with signs behind them, and what only the library's normaliser can treat."""
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["", " ", "a\0b", "é́x É Ünï. ÿŸ ÀÖ×÷ ß ẞ İ", "don't we're 'S it's. x' O'Ve,", "<|endoftext|> a<|endoftext|>!", "1a2 b3. (x) ...a -- a-b a.b", "\u00a0x\u2003y \u200bz", "ﬁ ① Σας ΣΑΣ", "a\u0301 b", "日本 語。", "\U0001f600!! x", "é" * 3000 + "." * 5000]
    encoder = tokenfile.WordEncoder(path, cache=8)  # overflows again and again
    for t in texts + texts:
        assert encoder.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in tokenfile.WordEncoder(path).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n,d", [(500, 4), (10**5, 8), (10**4, 16), (10**6, 16), (10**6, 32), (10**6, 33), (10**6, 64), (10**7, 64), (10**9, 64)])
def test_cap_filters_keep_recall_and_work(n, d):
    """Pairs at cosine 0.95 with the settings of n vectors: the work a vector stays as given, and no pair is lost."""
    rng = np.random.default_rng(d)
    x, z = rng.standard_normal((2, 300, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    fx, fy = capfilter.filters(x, n, 110), capfilter.filters(y, n, 110)
    assert all(set(a.tolist()) & set(b.tolist()) for a, b in zip(fx, fy, strict=True))
    if capfilter.settings(n, d, 110 / capfilter.CODES):
        assert 90 < np.mean([len(f) for f in fx]) < 150 and min(map(len, fx)) >= 55


@pytest.mark.parametrize("d", [4, 16])
def test_embeddings_of_few_components(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((4000 if d > 4 else 700, d))
    x[1::2] = x[::2] / np.linalg.norm(x[::2], axis=1, keepdims=True) + 0.33 * x[1::2] / np.linalg.norm(x[1::2], axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in capfilter.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


NOTICES = {
    "Apache License Version 2.0, January 2004": "apache-2.0",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "lgpl",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "agpl",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl-3.0",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "gpl-2.0",
    "Mozilla Public License Version 2.0": "mpl-2.0",
    "CC0 1.0 Universal": "cc0",
    "Creative Commons Attribution 4.0": "cc-by",
    "BSD 3-Clause License": "bsd",
    "BSD 2-Clause License": "bsd",
    "ISC License": "isc",
    "MIT License": "mit",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0",
}


def test_licenses_at_the_start_of_a_text(docs):
    for index in (licenses.Index(), licenses.build(docs)):
        for text, label in NOTICES.items():
            for before in ("", "one ", "one two three ", "one two three four five six seven eight nine ten "):
                found = index.scan(before + text)[2]
                assert [x for _, x, _ in found] == [label], (before, text)
        assert [x for _, x, _ in index.scan("of the apache license, version 2.0. " + "x " * 20 + "Apache License, Version 2.0")[2]] == ["apache-2.0"] * 2
        assert index.scan("the general public may enter; a license in version 3 is 2 0 for all")[2] == []


def test_line_dedup_of_short_and_of_huge_lines(spark, tmp_path):
    from tarnwork.llm import queries

    texts = [(1, "yes\n\nno"), (2, "yes\n\nnot"), (3, "no\nyes\nyes!")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_removed"], r["text_sha256"]) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in [(1, 0, "yes\n\nno"), (2, 1, "\nnot"), (3, 2, "yes!")]}
    # The tail of a deletion variant is whole: middles that differ only beyond 1,000,000 characters stay apart.
    lines = spark.range(1).select(F.concat(F.repeat(F.lit("ab"), 600_000), F.lit("x")).alias("a"), F.concat(F.repeat(F.lit("ab"), 600_000), F.lit("y")).alias("b"))
    first = lambda c: F.concat(F.left(c, F.lit(0)), linededup._tail(c, F.lit(1)))
    row = lines.select(F.length(first(F.col("a"))).alias("n"), (first(F.col("a")) == first(F.col("b"))).alias("same")).first()
    assert (row["n"], row["same"]) == (1_200_000, False)


def test_toxicity_of_a_rare_class(spark):
    """At 1% toxic rows a term of lift over 12 is judged, though far more clean rows have it."""
    rows = [(i, ("zorgle " if (i % 300 if i % 100 == 0 else i % 23 == 0) else "") + "plain words here", int(i % 100 == 0)) for i in range(6000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert any(t.startswith(" zor") for t in toxicity.learn(docs, labels).terms)


def test_iban_before_other_words(spark):
    """An account number ends where its country's length says, whatever capitals or numbers follow."""
    texts = {1: "DE89 3704 0044 0532 0130 00 EUR 20", 2: "DE89370400440532013000 BIC COBADEFF", 3: "iban GB82 WEST 1234 5698 7654 32, NO93 8601 1117 947 NOK 5", 4: "XX89 3704 0044 0532 0130 00", 5: "DE88 3704 0044 0532 0130 00", 6: "ADE89370400440532013000"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: [x["value"].replace(" ", "") for x in r["pii"] if x["kind"] == "iban"] for r in pii.find(table).collect()}
    assert got == {1: ["DE89370400440532013000"], 2: ["DE89370400440532013000"], 3: ["GB82WEST12345698765432", "NO9386011117947"], 4: [], 5: [], 6: []}
    text = pii.redact(table, text_col="text").where("doc_id = 1").first()["text"]
    assert text == "[iban] EUR 20"


def test_pii_of_the_method(spark):
    """Spans of the kinds beyond the base, their scores, and redaction."""
    texts = {1: "my ssn is 123-45-6789 and 000-12-3456, 900-12-3456", 2: "api_key = 'abcdef0123456789ABCDEF' token:short password: sixteencharacters", 3: "call +44 20 7946 0958 now", 4: None}
    rows = {r["doc_id"]: r["pii"] for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [(x["kind"], x["value"], x["score"]) for x in rows[1] if x["ord"] > 3] == [("ssn", "123-45-6789", 0.6)]
    assert [(x["kind"], x["value"]) for x in rows[2] if x["ord"] > 3] == [("secret", "abcdef0123456789ABCDEF"), ("secret", "sixteencharacters")]
    assert [(x["kind"], x["score"]) for x in rows[3]] == [("phone", 0.8)] and rows[4] == []


def brute_licenses(text, index):
    """Labels by reading the window at every offset that a naive count of votes allows."""
    ws, out = licenses.words(text), set()
    for t in index.templates:
        toks, need = licenses.words(t.text), [licenses.words(p) for p in t.mandatory]
        rare = sorted({w for w in toks if w in ws}, key=lambda w: (-index.idf[w], w))[: index.anchors]
        votes = {(j - i, w) for w in rare for i, x in enumerate(toks) if x == w for j, y in enumerate(ws) if y == w}
        starts = {o for low, _ in votes for o, _ in votes if low <= o <= low + index.reach and sum(index.idf[w] for w in {w for p, w in votes if low <= p <= low + index.reach}) >= index.share * sum(index.idf[w] for w in rare) - 1e-9}
        for start in starts if rare else ():
            lo, hi = max(0, start - index.reach), max(0, start + len(toks) + index.reach)
            if not all(any(ws[i : i + len(p)] == p for i in range(lo, hi - len(p) + 1)) for p in need):
                continue
            near = {w for i, w in enumerate(toks) if any(j < len(ws) and ws[j] == w for j in range(max(lo, start + i - index.reach), min(hi, start + i + index.reach + 1)))}
            if sum(index.idf[w] for w in near) / sum(index.idf[w] for w in set(toks)) >= (index.share if len(need) > 1 else index.share / 2):
                out.add(t.label)
    return out


def test_licenses_equal_brute_force(docs):
    texts = [t or "" for _, t in texts_of(docs)][:60]
    notices = [t.text for t in licenses.TEMPLATES]
    rng = np.random.default_rng(8)
    for k, n in enumerate(notices):
        w = n.split()
        cut = " ".join(x for x in w if rng.random() > 0.15)
        texts += [f"some words before {n} and after", f"{cut} {notices[k - 1]}", " ".join(w[2:]), f"license {n} license license"]
    for index in (licenses.Index(), licenses.build(docs)):
        found = [({x for _, x, _ in index.scan(t)[2]}, brute_licenses(t, index)) for t in texts]
        assert [a for a, _ in found] == [b for _, b in found] and sum(map(bool, (a for a, _ in found))) > 100


def test_bpe_of_long_runs():
    """Runs beyond the matrices' width are merged with a heap, to the library's ids."""
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.load(path)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    texts = ["a" * 5000, " " * 3000, "".join(rng.choice(list("abcdefghijklmnop"), 4000)), "ab" * 1000 + "é" * 700, "日本語" * 400, "x" * 513, "x" * 512]
    for t, found in zip(texts, encoder.encode(texts), strict=True):
        assert [i for ids, _ in found for i in ids] == library.encode_ordinary(t)


def test_near_duplicates_of_repeated_rows(spark):
    """dedup leaves one of the rows that agree in id and text, all without an id, and both of an id's different texts."""
    rows = [(2, BASE, "a"), (2, BASE, "b"), (3, BASE, "a"), (None, BASE, "a"), (None, BASE, "a"), (4, "one two three four five six", "a"), (4, "seven eight nine ten eleven twelve", "a"), (5, None, "a"), (6, "", "a")]
    kept = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["doc_id"] != 5) == sorted([("2", BASE), ("None", BASE), ("None", BASE), ("4", rows[5][1]), ("4", rows[6][1]), ("6", "")])
    assert sum(r["doc_id"] == 5 for r in kept) == 1


def test_slices_of_batches():
    import pyarrow as pa

    from tarnwork.llm.common import sliced

    texts = ["a" * n for n in (3, 9, 0, 1, 1, 1, 1, 1, 20, 2)] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = [s.column(0).to_pylist() for s in sliced([batch, batch.slice(2, 3)], 0, rows=4, size=10)]
    assert [t for s in got for t in s] == texts + texts[2:5]
    assert all(len(s) <= 4 and (len(s) == 1 or sum(len(t or "") for t in s) <= 10) for s in got)


def test_components_say_when_rounds_do_not_suffice(spark):
    from tarnwork.llm.components import components

    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), rounds=1)


def test_embeddings_of_dense_groups(spark):
    """Groups of near copies over several chunks, with cap filters: links counted once each, components whole."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((40, 24))
    x = np.vstack([b + rng.uniform(0.05, 0.3) * rng.standard_normal((100, 24)) for b in base])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert capfilter.settings(len(x), 24, 110 / capfilter.CODES)
    near = u @ u.T >= 0.95
    table = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())] + [(len(x), x[0].tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in capfilter.near_duplicates(table, chunk=32).collect()}
    want = near.sum(1) - 1 + near[0]
    missed = sum(int(want[i]) - got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= want[i] for i in range(len(x))) and missed <= 1e-4 * want.sum()
    comp = components_of(range(len(x) + 1), [(int(i), int(j)) for i, j in np.argwhere(near) if i < j] + [(0, len(x))])
    assert sum(got[i]["component_id"] != comp[i] for i in comp) <= 2
