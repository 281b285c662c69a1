"""Byte-level BPE, encoded in length-bucketed padded numpy matrices.

A text is split by the pattern; every match is encoded by itself.  Distinct matches of a batch are put in matrices by
length, a row a match, a column a byte.  Each round every row merges its leftmost pair of least rank: ranks of all
neighbouring pairs stand in a second matrix, looked up in an open-addressing hash table when a pair forms; a merge drops
one column from each row, so the matrices stay rectangular; rows with no pair left to merge are set aside.

Memory is bounded by an Arrow batch and by the cache of matches, which is emptied when full.  Null texts are empty.
Runs without a break of more than ``LONG`` bytes would cost their length squared in a matrix; they are merged one by one
with a heap of pairs, to the same ids.  Rows that repeat an id, and repeated rows, are each encoded; columns other than
id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced

NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)
#: Bytes of the longest row that is merged in a matrix.
LONG = 512


class PairTable:
    """(left id, right id) to the id of their concatenation, which is its rank; linear probing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(todo)
        merged = merged.astype(np.int32)
        while len(todo):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = todo[free]  # of several that want one slot, the last stays
            placed = self.keys[at] == todo
            self.values[at[placed]] = merged[placed]
            todo, at, merged = todo[~placed], (at[~placed] + 1) & (len(self.keys) - 1), merged[~placed]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        alive = np.arange(len(key))
        while len(alive):
            held = self.keys[at]
            hit = held == key[alive]
            out[alive[hit]] = self.values[at[hit]]
            more = ~hit & (held != _EMPTY)
            alive, at = alive[more], (at[more] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Encoder:
    """Ranks of a byte-level vocabulary: token bytes to id, lower merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 220_000):
        import regex

        self.ranks, self.cache_size, self.cache = ranks, cache, {}
        self.split = regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.vocab[k] = token
        self.decimal = [b"%d" % k for k in range(len(self.vocab))]
        self.numbers = list(range(len(self.vocab)))  # one object an id, however many cached matches have it
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(found, np.int64).reshape(-1, 3).T)

    def merge(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, ids) in rectangular pieces, of a matrix whose rows are byte ids of one length."""
        rows, done = np.arange(len(ids)), []
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = rank.argmin(1)  # the leftmost of equals
            best = rank[np.arange(len(rank)), at]
            stop = best == NONE
            if stop.any():
                done.append((rows[stop], ids[stop]))
                rows, ids, rank, at, best = rows[~stop], ids[~stop], rank[~stop], at[~stop], best[~stop]
                if not len(rows):
                    return done
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            # Of width - 1 pairs one goes; the pairs on both sides of the merged token are looked up anew.
            keep = np.ones((n, width - 1), bool)
            keep[line, np.minimum(at, width - 2)] = False
            rank = rank[keep].reshape(n, width - 2)
            left = at > 0
            rank[line[left], at[left] - 1] = self.pairs.find(ids[line[left], at[left] - 1], ids[line[left], at[left]])
            right = at < width - 2
            rank[line[right], at[right]] = self.pairs.find(ids[line[right], at[right]], ids[line[right], at[right] + 1])
        done.append((rows, ids))
        return done

    def merge_long(self, raw: bytes) -> list[int]:
        """The ids of one long row: pairs leave a heap by rank, then by place, unless a merge beside them has changed them."""
        ids = self.bytes[np.frombuffer(raw, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            j = after[i]
            if j < len(ids):
                pair = ids[i], ids[j]
                if pair not in known:
                    known[pair] = int(self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair] != NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def learn(self, matches: list[str], cells: int = 2_000_000) -> None:
        """Encode matches that the cache lacks, at most ``cells`` matrix cells at once."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            raw = m.encode("utf-8", "surrogatepass")
            if (k := self.ranks.get(raw)) is not None:
                self.cache[m] = ((k,), self.decimal[k])
            else:
                by.setdefault(len(raw), []).append((m, raw))
        for length in [n for n in by if n > LONG]:
            for m, raw in by.pop(length):
                row = self.merge_long(raw)
                self.cache[m] = (tuple(map(self.numbers.__getitem__, row)), b",".join(map(self.decimal.__getitem__, row)))
        for length, group in by.items():
            step = max(1, cells // length)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                raw = np.frombuffer(b"".join(x[1] for x in part), np.uint8).reshape(len(part), length)
                for rows, ids in self.merge(self.bytes[raw]):
                    for r, row in zip(rows.tolist(), ids.tolist(), strict=True):
                        self.cache[part[r][0]] = (tuple(map(self.numbers.__getitem__, row)), b",".join(map(self.decimal.__getitem__, row)))

    def encode(self, texts: list[str]):
        """For each text a list with, for every match, its ids and their decimal form."""
        split = [self.split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(new) > self.cache_size:
            self.cache.clear()
            new = set(chain.from_iterable(split))
        self.learn(list(new))
        for matches in split:
            yield list(map(self.cache.__getitem__, matches))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(2)
def load(path: str, pattern: str | None = None) -> Encoder:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern or public_tokenizers.PATTERN)


def tokenize(docs: DataFrame, path: str, pattern: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; ids are little-endian 32-bit words."""
    import pyarrow as pa

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    first, second = itemgetter(0), itemgetter(1)

    def run(batches):
        encoder = load(path, pattern)
        for part in sliced(batches, 1):
            counts, shas, plain, packed = [], [], [], []
            for found in encoder.encode([t or "" for t in part.column(1).to_pylist()]):
                ids = list(chain.from_iterable(map(first, found)))
                counts.append(len(ids))
                shas.append(hashlib.sha256(b",".join(map(second, found))).hexdigest())
                plain.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    packed.append(np.array(ids, "<u4").tobytes())
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
