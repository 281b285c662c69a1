"""Sequences and alignments: residue sequences, alignment columns, translation of residues, similarity, superposition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import one_letter


def fasta_from_atoms(atoms: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """(structure_id, sequence) from the CA atoms in residue order."""
    ca = atoms.where("name = 'CA' and record = 'ATOM'").select("structure_id", "resid", "atom_index", one_letter(F.col("resname"), custom).alias("c"))
    rows = ca.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("resid", "atom_index", "c"))).alias("r"))
    return rows.select("structure_id", F.array_join(F.transform("r", lambda x: x["c"]), "").alias("sequence"))


def msa_index(aligned: DataFrame) -> DataFrame:
    """(structure_id, seq_pos, msa_col): both from 1; gaps are '-'."""
    rank = F.filter(F.transform(F.split("sequence", ""), lambda c, i: F.when(c != "-", i + 1)), lambda i: i.isNotNull())
    return aligned.select("structure_id", F.posexplode(rank).alias("p", "msa_col")).select("structure_id", (F.col("p") + 1).alias("seq_pos"), "msa_col")


def attach_msa(sites: DataFrame, index: DataFrame) -> DataFrame:
    return sites.drop("msa_resid").join(index.select("structure_id", F.col("seq_pos").alias("resid"), F.col("msa_col").alias("msa_resid")), ["structure_id", "resid"], "left")


def translate(index: DataFrame, reference: str | DataFrame, resids: DataFrame, most: int = 10_000) -> DataFrame:
    """(structure_id, ref_resid, resid): the residue whose alignment column is nearest to the reference residue's, the first of equals.

    ``reference`` is a structure, or a table of one row that names it.  ``resids`` are residues that a selection names: at
    most ``most``, counted, since every residue of every structure is held against each of them.
    """
    if resids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} residues to translate")
    own = index.join(F.broadcast(reference), "structure_id", "left_semi") if isinstance(reference, DataFrame) else index.where(F.col("structure_id") == reference)
    want = own.join(resids.select(F.col("resid").alias("seq_pos")), "seq_pos").select(F.col("seq_pos").alias("ref_resid"), F.col("msa_col").alias("want"))
    both = index.join(F.broadcast(want))
    return both.groupBy("structure_id", "ref_resid").agg(F.min_by("seq_pos", F.struct(F.abs(F.col("msa_col") - F.col("want")), "seq_pos")).alias("resid"))


def match_names(names: DataFrame, structures: DataFrame, most: int = 10_000) -> DataFrame:
    """(structure_id, name): of the names in an alignment the one that belongs to each structure.

    An equal name counts first, then one that holds what stands before the structure's first '_', then before its first
    '.'; of several the shortest, then the first.  Names are those of one alignment: at most ``most``, counted.
    """
    if names.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} names")
    s, n = structures.select("structure_id").distinct(), names.select("name").distinct()
    told = [F.col("name") == F.col("structure_id"), *(F.contains("name", F.split_part("structure_id", F.lit(mark), F.lit(1))) for mark in "_.")]
    both = s.join(F.broadcast(n), told[0] | told[1] | told[2])
    rank = F.struct(*(~t for t in told), F.length("name"), F.col("name"))
    return both.groupBy("structure_id").agg(F.min_by("name", rank).alias("name"))


def similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity to rows (a, b) of sequences: matches of a global alignment without penalties over its length, gaps only."""

    def lcs(a: str, b: str) -> int:
        row = np.zeros(len(b) + 1, int)
        y = np.frombuffer(b.encode("utf-32-le"), "<u4")
        for ch in a:
            hit = np.where(y == ord(ch), row[:-1] + 1, 0)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
        return int(row[-1])

    def run(batches):
        for frame in batches:
            found = []
            for a, b in zip(frame["a"].fillna(""), frame["b"].fillna(""), strict=True):
                m = lcs(a, b)
                length = len(a) + len(b) - m
                found.append(m / length if length else 0.0)
            yield frame.assign(similarity=found)

    return pairs.mapInPandas(run, pairs.schema.simpleString()[7:-1].replace(":", " ") + ", similarity double")


def kabsch(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R, t that carry the rows of ``a`` to those of ``b`` with least squares: a @ R.T + t."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    d = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    return r, cb - r @ ca


def superpose(atoms: DataFrame, reference: str) -> DataFrame:
    """(structure_id, r, t): the motion that carries each structure's CA atoms to the reference's, matched by residue.

    Sums of products are aggregated in Spark; only 16 numbers a structure reach Python.
    """
    ca = atoms.where("name = 'CA'").select("structure_id", "resid", "x", "y", "z").dropDuplicates(["structure_id", "resid"])
    ref = ca.where(F.col("structure_id") == reference).select("resid", *(F.col(c).alias(f"r{c}") for c in "xyz"))
    sums = [F.sum(c).alias(f"s_{c}") for c in ("x", "y", "z", "rx", "ry", "rz")]
    products = [F.sum(F.col(p) * F.col(f"r{q}")).alias(f"p_{p}{q}") for p in "xyz" for q in "xyz"]
    table = ca.join(ref, "resid").groupBy("structure_id").agg(F.count("*").alias("n"), *sums, *products)

    def run(batches):
        for f in batches:
            rs, ts = [], []
            for row in f.itertuples(index=False):
                ca_, cb = np.array([row.s_x, row.s_y, row.s_z]) / row.n, np.array([row.s_rx, row.s_ry, row.s_rz]) / row.n
                h = np.array([[getattr(row, f"p_{p}{q}") for q in "xyz"] for p in "xyz"]) - row.n * np.outer(ca_, cb)
                u, _, vt = np.linalg.svd(h)
                r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
                rs.append(r.tolist())
                ts.append((cb - r @ ca_).tolist())
            yield f[["structure_id"]].assign(r=rs, t=ts)

    kind = atoms.schema["structure_id"].dataType.simpleString()
    return table.mapInPandas(run, f"structure_id {kind}, r array<array<double>>, t array<double>")


def transform(atoms: DataFrame, motions: DataFrame) -> DataFrame:
    """Atoms moved by their structure's motion; structures without one stay."""
    rows = atoms.join(motions, "structure_id", "left")
    p = [F.col(a) for a in "xyz"]
    moved = [sum((p[k] * F.get(F.get("r", F.lit(i)), F.lit(k)) for k in range(3)), F.lit(0.0)) + F.get("t", F.lit(i)) for i in range(3)]
    return rows.select(*(c for c in atoms.columns if c not in "xyz"), *(F.coalesce(m, c).alias(a) for m, c, a in zip(moved, p, "xyz", strict=True)))


def align_to_first(sequences: list[str], gap: float = -1.0, match: float = 1.0, mismatch: float = 0.0) -> list[str]:
    """A star alignment on the first sequence by Needleman-Wunsch; a plain substitute for profile aligners, not their equal."""
    centre = sequences[0]
    inserts: list[dict[int, str]] = []
    rows: list[list[str]] = []
    for s in sequences:
        n, m = len(centre), len(s)
        score = np.zeros((n + 1, m + 1))
        score[:, 0], score[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                score[i, j] = max(score[i - 1, j - 1] + (match if centre[i - 1] == s[j - 1] else mismatch), score[i - 1, j] + gap, score[i, j - 1] + gap)
        i, j, row, extra = n, m, ["-"] * n, {}
        while i or j:
            if i and j and score[i, j] == score[i - 1, j - 1] + (match if centre[i - 1] == s[j - 1] else mismatch):
                row[i - 1] = s[j - 1]
                i, j = i - 1, j - 1
            elif i and score[i, j] == score[i - 1, j] + gap:
                i -= 1
            else:
                extra[i] = s[j - 1] + extra.get(i, "")
                j -= 1
        rows.append(row)
        inserts.append(extra)
    widths = [max(len(e.get(i, "")) for e in inserts) for i in range(len(centre) + 1)]
    return ["".join(e.get(i, "").ljust(w, "-") + (r[i] if i < len(centre) else "") for i, w in enumerate(widths)) for e, r in zip(inserts, rows, strict=True)]


def suggest_references(ca: DataFrame, secondary: DataFrame, cutoff: float, n: int) -> DataFrame:
    """Pairs of residues outside loops whose CA atoms are farther apart than the cutoff, the farthest first (top ``n``)."""
    firm = ca.join(secondary.where("ss <> 'L'").select("resid"), "resid", "left_semi").select("resid", "x", "y", "z")
    left, right = (firm.select(F.col("resid").alias(f"resid_{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz")) for k in "ab")
    d = F.sqrt(sum(((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz"), F.lit(0.0)))
    return left.join(right, F.col("resid_a") < F.col("resid_b")).withColumn("distance", d).where(F.col("distance") > cutoff).orderBy(F.desc("distance"), "resid_a", "resid_b").limit(n).select("resid_a", "resid_b", "distance")
