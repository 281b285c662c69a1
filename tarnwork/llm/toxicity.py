"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

* Folding: compatibility forms (NFKC), lower case, Cyrillic and Greek look-alikes to Latin, digits and signs that stand
  for letters (1d10t, p4thetic) to those letters, every other sign to a blank.
* Lexicon: word starts and whole words, with log-odds weights, learned from labelled rows (:func:`learn`) or given.
* Exceptions: phrases in which a term is harmless; a match inside one does not count.
* Normalised by length: the sum of the weights is divided by the square root of a document's length in hundreds of
  words; presence, sum and density feed a logistic curve.

Null and empty texts have no match and get the score of no match.  Repeated rows give repeated results.  The scan is a
map over rows, whole texts however long: no shuffle, memory bounded by a slice of an Arrow batch and the lexicon.  Columns
other than id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡαβεηικνορτυχω", "abekmhopctyxijsdgabenikvoptuxw", strict=True))
STANDINS = dict(zip("013457@$", "oieastas", strict=True))

#: Harmless phrases of common terms, used whatever the labels say.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "clown shoes")


#: The least evidence of a term, and the part of it that an extension of a term must have.
EVIDENCE, SLACK = 13.0, 0.8


class _Fold(dict):
    """Translation table for str.translate, filled as characters turn up: letters stay, the rest become blanks."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = out = LOOKALIKES.get(ch) or STANDINS.get(ch) or (ch if ch.isalpha() else " ")
        return out


_FOLD = _Fold()
_ASCII = str.maketrans({chr(c): _FOLD[c] for c in range(128)})


def fold(text: str) -> str:
    """Folded text between blanks, so that a pattern beginning with a blank is anchored at a word's start."""
    if text.isascii():
        return f" {text.lower().translate(_ASCII)} "
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


@dataclass
class Lexicon:
    """terms: pattern to weight; a pattern starts with a blank, and ends with one if it is a whole word."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: bias, presence, sum of weights, density
    curve: tuple[float, float, float, float] = (-3.0, 2.0, 1.0, 0.5)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self):
        import ahocorasick

        if self._machine is None:
            found = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                found.add_word(term, (len(term), float(weight), False))
            for phrase in self.exceptions:
                folded = f" {' '.join(fold(phrase).split())} "
                found.add_word(folded, (len(folded), 0.0, True))
            found.make_automaton()
            self._machine = found
        return self._machine

    def features(self, text: str) -> tuple[float, float, float, int]:
        """Presence, sum of weights (saturating, ever more slowly, towards 20), density, number of matched words."""
        folded = fold(text)
        if not len(self.terms):
            return 0.0, 0.0, 0.0, 0
        best: dict[int, float] = {}
        shields: list[tuple[int, int]] = []
        for end, (length, weight, exception) in self.machine().iter(folded):
            start = end - length + 1
            if exception:
                shields.append((start, end))
            elif weight > best.get(start, 0.0):  # of the patterns at one word, the heaviest
                best[start] = weight
        for a, b in shields:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        total = sum(best.values())
        words = len(text.split())
        return float(bool(best)), total / (1 + total / 20), total / math.sqrt(1 + words / 100), len(best)

    def score(self, x: tuple) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], x, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_matches) of every row."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in sliced(batches, 1):
            found = [lexicon.features(t or "") for t in batch.column(1).to_pylist()]
            scores = [lexicon.score(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x[3] for x in found], pa.int64())],
                names=[id_col, "score", "predicted", "n_matches"],
            )

    return docs.select(id_col, text_col).mapInArrow(scan, f"{id_col} {kind}, score double, predicted int, n_matches long")


def held_out(id_col: str = "doc_id"):
    """True where no label may be learned from: crc32 of the id as text is divisible by 5; a null id counts so too."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _candidates(text: str, shortest: int = 3, longest: int = 9) -> set[str]:
    out: set[str] = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> tuple[DataFrame, float]:
    """(text, toxic) and the logarithm of how much oftener clean rows were chosen than toxic ones; of a bounded sample of the labelled rows outside the held-out fifth, expected ``per_class`` rows a class.

    Rows are chosen by a hash of the id at a rate that the class counts give, so the sample is the same at each run and
    its size does not grow with the corpus.  An id labelled twice counts with its larger label.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    part = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("toxic") == label, min(1.0, per_class / n)).otherwise(rate)
    chosen = known.where(part < rate)
    rates = [min(1.0, per_class / sizes[label]) if sizes.get(label) else 1.0 for label in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # bounded by per_class
    return rows, math.log(rates[0] / rates[1])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 6000, min_docs: int = 4) -> Lexicon:
    """A lexicon from labelled rows.  ``per_class`` bounds the sample; see :func:`training_rows`.

    Term counts are summed on the executors and only terms far likelier in one class come to the driver.  With no
    labelled rows, or only one class, the lexicon is empty and scores are the bias.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    rows, chosen = training_rows(docs, labels, per_class)
    longest = 1_000_000

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            for label, counts in seen.items():
                items = list(counts.items())
                counts.clear()
                for k in range(0, len(items), 50_000):
                    part = items[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in part]), pa.array([label] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["term", "toxic", "n"]
                    )

        for batch in sliced(batches, 0):
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[int(label > 0)][""] += 1
                seen[int(label > 0)].update(_candidates(text or ""))
                if len(seen[0]) + len(seen[1]) > longest:
                    yield from flush()
        yield from flush()

    counts = rows.mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    # Class sizes come first, so that terms are dropped by their rates, whatever the classes' shares.
    found = {r["bad"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}  # two rows
    sizes = found.get(True, 0), found.get(False, 0)
    if min(sizes) == 0:
        return Lexicon({}, curve=(-4.0, 0.0, 0.0, 0.0))
    rate = sizes[0] / sum(sizes)
    bad, good = F.col("bad"), F.col("good")
    told = bad * F.log(bad / ((bad + good) * rate)) + F.when(good > 0, good * F.log(good / ((bad + good) * (1 - rate)))).otherwise(0.0)
    # A few hundred terms come to the driver, of a sample that per_class bounds.
    kept = counts.where((F.col("term") != "") & (bad >= min_docs) & may_matter(bad, good, *sizes) & (told >= SLACK * EVIDENCE)).collect()
    terms = choose([(r["term"], r["bad"], r["good"]) for r in kept], *sizes)
    lexicon = Lexicon(terms)

    def feature(batches):
        for batch in sliced(batches, 0):
            got = [lexicon.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in got], pa.float64()) for k in range(3)), batch.column(1).cast(pa.int32())], names=["a", "b", "c", "y"])

    table = np.array([tuple(r) for r in rows.mapInArrow(feature, "a double, b double, c double, y int").collect()], float)  # bounded by per_class
    bias, *rest = fit_curve(table[:, :3], (table[:, 3] > 0).astype(float))
    lexicon.curve = (bias + chosen, *rest)  # back to the shares that the labelled rows have
    return lexicon


def may_matter(bad, good, bad_docs: int, good_docs: int):
    """Whether the smoothed rates differ eightfold; :func:`choose` demands tenfold, and looks at extensions of its terms that have nine tenths of their toxic documents."""
    return (bad + 0.5) * (good_docs + 1) >= (good + 0.5) * (8 * (bad_docs + 1))


def choose(found: list[tuple[str, int, int]], bad_docs: int, good_docs: int, least: float = 2.3, evidence: float = EVIDENCE) -> dict[str, float]:
    """Terms whose smoothed log-odds exceed ``least``, and whose share of toxic documents chance would give with a
    probability below about exp(-``evidence``): of some 10^5 candidates none should be there by luck.

    A word start gives way to an extension that covers nine tenths of its toxic documents ("tra" to "trash"); of what
    is left, a longer pattern stays beside its own start only where it is clearly heavier.
    """
    weights: dict[str, float] = {}
    support = {term: bad for term, bad, _ in found}
    extended: dict[str, int] = {}
    for term, bad, _ in found:
        for k in range(2, len(term)):
            extended[term[:k]] = max(extended.get(term[:k], 0), bad)
    for term, bad, good in found:
        if extended.get(term, 0) >= 0.9 * support[term]:
            continue
        odds = math.log((bad + 0.5) / (bad_docs + 1)) - math.log((good + 0.5) / (good_docs + 1))
        if odds >= least and _evidence(bad, good, bad_docs / (bad_docs + good_docs)) >= evidence:
            weights[term] = odds
    out: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        shorter = [out[p] for p in (term[:k] for k in range(2, len(term))) if p in out]
        if not shorter or weights[term] > max(shorter) + 1.0:
            out[term] = weights[term]
    return dict(sorted(out.items()))


def _evidence(bad: int, good: int, rate: float) -> float:
    """Documents times the divergence of their toxic share from the overall rate."""
    n = bad + good
    out = bad * math.log(bad / n / rate)
    return out + (good * math.log(good / n / (1 - rate)) if good else 0.0)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(4)
    penalty = np.diag([1e-3, ridge, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


