"""Adaptive context-mixing range coder for token ids: every id is coded by a mixture of order-0 to order-2 predictions.

A block's ids are dealt to lanes, runs of neighbouring ids that advance in step, so that numpy works on all lanes at once;
all lanes of a block share one model, which each step's ids update together.  The probability of an id is a sum:

* order 2: the id that prevails after the two ids before, if it is this one, with a share of its own;
* order 1: likewise each of the ``ONE`` ids that prevail after the id before;
* order 0: what is left of the whole, dealt by the frequencies of the ids of the block so far, none of them zero.  They are
  summed again when an eighth more ids are known.

The shares are the mixing weights.  They adapt: the share of a prediction is how often predictions of like confidence
have held so far, among the cases that no earlier one has told.  The sum gives each id one interval of the range coder.

A block starts from nothing, has a checksum, and the directory says where it lies, so blocks can be decoded alone.
Integers, and doubles where they are exact, so files read the same on every machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TWS4"
#: Ids of a block, ids of a lane where there are enough, and lanes at most.
BLOCK, STEPS, LANES = 1 << 20, 256, 4096
#: Predictions of order 1; the update is written for two.
ONE = 2
_WHOLE = 28  # bits of the mixture
_BASE = 22  # bits of the order-0 frequencies
_COARSE = 7  # bits of a slot of them, in which the decoder looks first
_TWO_BITS = 18
#: The largest shares of each prediction, of 65536, so that a 64th of the whole and more is left for order 0.
_MOST = [58982, 39321, 26214]
_U = np.uint64
_32, _W = _U(32), _U(_WHOLE)
_LOW = _U(0xFFFFFFFF)
# The hash of two ids, of which 27 bits matter.
_MIX1, _MIX2, _9, _SLOTS = np.uint32(2654435761), np.uint32(40503), np.uint32(9), np.uint32((1 << _TWO_BITS) - 1)
_ONE32 = _U(1 << 32)


#: Small classes of counts from 0 to 255: the first few apart, then ever wider.
_CLASS = np.array([k if k < 5 else min(15, 2 * k.bit_length() + (k >> k.bit_length() - 2 & 1) - 2) for k in range(256)], np.int64)
#: Where a class's shares lie.
_AGE = (_CLASS << 9).astype(np.int32)


class _Model:
    """What all lanes of a block have learned.  Where lanes of one step change the same entry, the last one's change stays."""

    def __init__(self, lanes: int, size: int, decodes: bool = False):
        self.size, self.decodes = size, decodes
        self.counts, self.seen, self.known = np.zeros(size, np.int32), 0, 0
        # Frequencies are doubles below 1; their products with 28 bits have 50 bits at most, so they are exact.
        self.plain = np.arange(size + 1) / (1 << _BASE)
        # An entry is an id above nine bits of how firmly it prevails, 255 at most; -1 is none, which no share goes to.
        # Those of order 2 come first, then the two of order 1.
        self.table = np.full((1 << _TWO_BITS) + ONE * size, -1, np.int32)
        # Cases and hits of each prediction, by confidence; shares, by what a look into the entries finds.
        self.tries = np.full((ONE + 1, 256), 32, np.int64)
        self.hits = np.full((ONE + 1, 256), 1, np.int64)
        self.shares = np.zeros((ONE + 1, 16, 512), np.int32)
        self.now, self.prev1, self.prev2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def learn(self) -> None:
        """Frequencies from all that was counted so far."""
        self.known = self.seen
        scale = (((1 << _BASE) - self.size) << 20) // max(1, self.seen)
        used = np.concatenate([[-1], np.flatnonzero(self.counts != 0), [self.size]])
        sums = np.zeros(len(used) - 1, np.int64)
        np.cumsum(self.counts.take(used[1:-1]).astype(np.int64) * scale >> 20, out=sums[1:])
        # An id is as wide as its scaled count and one, so between used ids all are one wide.
        self.base = np.repeat(sums / (1 << _BASE), used[1:] - used[:-1])
        self.base += self.plain
        self.ends = self.base[1:]
        if self.decodes:
            # Used ids, where they begin and where they last are, after a first that stands for none.
            self.used = used[:-1]
            self.begins, self.lasts = np.append(0, self.used[1:] + sums[:-1]), self.used + sums
            # The last of them that begins at or before each multiple of a slot's width.
            slots = np.append(self.begins + ((1 << _COARSE) - 1) >> _COARSE, (1 << _BASE - _COARSE) + 2)
            self.coarse = np.repeat(np.arange(len(sums), dtype=np.int32), slots[1:] - slots[:-1])

    def predict(self, n: int, step: int) -> None:
        self.learns = step % max(1, step >> 2) == 0
        if self.learns:
            shares = np.minimum((self.hits << 16) // self.tries, np.array(_MOST)[:, None])
            self.shares[:, :, :256] = shares.reshape(-1, 16, 16)[:, :, _CLASS]
            # Frequencies change little until an eighth more ids are known.
            if 8 * (self.seen - self.known) >= self.seen:
                self.learn()
        p1, p2, ids = self.prev1[:n], self.prev2[:n], self.now[:n]
        self.at = np.empty((ONE + 1, n), np.int64)
        self.at[0] = (p2 * _MIX2 + p1 * _MIX1 >> _9) & _SLOTS
        for j in range(ONE):
            np.add(ids, (1 << _TWO_BITS) + j * self.size, out=self.at[j + 1])
        self.age = np.minimum(self.counts.take(ids, mode="wrap"), 255)
        self.entries = self.table.take(self.at, mode="wrap")
        self.firm = self.entries & 511
        self.ids = self.entries >> 9
        self.weights = np.empty((ONE + 1, n), np.int32)
        w = self.shares[0, 0].take(self.firm[0], mode="wrap")
        np.left_shift(w, _WHOLE - 16, out=self.weights[0])
        left = (1 << _WHOLE) - self.weights[0]
        marks = self.firm[1:] + _AGE.take(self.age, mode="wrap")
        others = self.ids[1:] != self.ids[0]
        for j in range(ONE):
            # 15 bits of what is left times 16 bits of a share.
            w = self.shares[j + 1].take(marks[j], mode="wrap")
            w *= left >> _WHOLE - 15
            w >>= 31 - _WHOLE
            np.multiply(w, others[j], out=self.weights[j + 1])
            left -= self.weights[j + 1]
        self.left = left.astype(np.float64)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an id's interval starts and how wide it is, of the whole."""
        self.now = ids.astype(np.int64)
        start, end = (self.left * self.base.take(self.now, mode="wrap")).astype(np.int32), (self.left * self.ends.take(self.now, mode="wrap")).astype(np.int32)
        end -= start
        self.hit = self.ids == ids
        less, same = self.weights * (self.ids < ids), self.weights * self.hit
        for j in range(ONE + 1):
            start += less[j]
            end += same[j]
        return start.astype(_U), end.astype(_U)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose intervals the values lie.  Predictions are taken out of the whole in turn."""
        # Where there is no prediction, -1 wraps to an empty interval at the end.
        at = self.ids.astype(np.int64)
        starts = (self.left * self.base.take(at, mode="wrap")).astype(np.int32)
        ends = (self.left * self.ends.take(at, mode="wrap")).astype(np.int32)
        ends += self.weights
        rest, told, found = value, np.zeros(len(value), np.int32), np.zeros(len(value), bool)
        for i, (c, w, start, end) in enumerate(zip(self.ids, self.weights, starts, ends, strict=True)):
            for j in range(i + 1, ONE + 1):
                up = self.weights[j] * (self.ids[j] < c)
                start += up
                end += up
            beyond = rest >= end
            within = (rest >= start) & ~(beyond | found)
            told += c * within
            found |= within
            rest = rest - w * beyond
        open_ = np.flatnonzero(~found)
        # Below 2 to the 50th over below 2 to the 28th: as doubles they round to the same whole number.
        at = rest.take(open_).astype(np.float64)
        at += 1
        at *= 1 << _BASE
        at -= 1
        at = (at / self.left.take(open_)).astype(np.int64)
        slot = np.minimum(at >> _COARSE, len(self.coarse) - 2)
        plain = self.coarse.take(slot, mode="wrap")
        # Where used ids begin within the slot, they are searched; ids behind a used one are one wide.
        k = np.flatnonzero(plain != self.coarse[1:].take(slot, mode="wrap"))
        plain[k] = self.begins.searchsorted(at.take(k), "right") - 1
        at -= self.lasts.take(plain, mode="wrap")
        told[open_] = np.minimum(self.used.take(plain, mode="wrap") + np.maximum(at, 0), self.size - 1)
        return told

    def update(self, n: int, ids: np.ndarray) -> None:
        """Learn the ids of a step, of which ``interval`` was asked before."""
        np.add.at(self.counts, self.now, np.int32(1))
        self.seen += n
        hit = self.hit
        if self.learns:
            open_, age = np.ones(n, bool), _CLASS.take(self.age) << 4
            for j in range(ONE + 1):
                # Bins beyond 512 are for those that an earlier prediction told, or that this one says nothing of.
                mark = _CLASS.take(self.firm[j], mode="clip") + (age if j else 0)
                bins = np.bincount(mark + (hit[j] << 8) + (~(open_ & (self.weights[j] > 0)) << 9), minlength=1024)
                self.tries[j] += bins[:256] + bins[256:512]
                self.hits[j] += bins[256:512]
                open_ &= ~hit[j]
        # An entry that holds is firmer by one, else less firm; at nothing, and where there is none, it gives way.
        strong = self.firm + 1 & 511
        # Order 2 loses wherever it fails, of order 1 the less firm entry, and only where neither holds.
        lost = ~hit
        second = strong[2] < strong[1]
        missed = lost[1] & lost[2]
        np.logical_and(missed, second, out=lost[2])
        np.logical_and(missed, ~second, out=lost[1])
        held = self.entries + (hit.view(np.int8) - lost.view(np.int8))
        np.minimum(held, self.entries | 255, out=held)
        lost &= strong < 2
        held += ((ids << 9) - held) * lost
        self.table[self.at.ravel()] = held.ravel()
        self.prev1, self.prev2 = ids.view(np.uint32), self.prev1[:n]


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and lanes that are full at the last step, of a block of n ids."""
    lanes = max(1, min(LANES, n // STEPS))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _shrink(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and range of the lanes that give a word, with the range cut where a carry is in doubt, then moved up."""
    k = np.flatnonzero((a ^ (a + b - _U(1))) > _LOW)
    if len(k):
        b[k] = _ONE32 - (a.take(k) & _LOW)
    return a << _32, b << _32


def _turn(rows: np.ndarray, columns: np.ndarray) -> None:
    """Write rows as columns, some at a time so that both stay in the processor's cache."""
    for k in range(0, len(rows), 32):
        columns[:, k : k + 32] = rows[k : k + 32].T


def encode_block(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (32 bits) of all lanes in turn, and each lane's number of them."""
    lanes, steps, full = _shape(len(ids))
    # The first lanes are one id longer than the others.
    table = np.empty((steps, lanes), np.int32)
    _turn(ids[: full * steps].reshape(full, steps), table[:, :full])
    _turn(ids[full * steps :].reshape(lanes - full, steps - 1), table[: steps - 1, full:])
    m = _Model(lanes, size)
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    lane, words = [], []
    for t in range(steps):
        n = lanes if t < steps - 1 else full
        sym = table[t, :n]
        m.predict(n, t)
        start, width = m.interval(sym)
        a, b = low[:n], rng[:n]
        b >>= _W
        a += b * start
        b *= width
        m.update(n, sym)
        k = np.flatnonzero(b < _ONE32)
        if len(k):
            some = low.take(k)
            lane.append(k.astype(np.uint16))
            words.append((some >> _32).astype(np.uint32))
            low[k], rng[k] = _shrink(some, rng.take(k))
    lane = np.concatenate([*lane, np.arange(lanes, dtype=np.uint16)])
    words = np.concatenate([*words, ((low + (rng - _U(1))) >> _32).astype(np.uint32)])
    return words.take(lane.argsort(kind="stable")), np.bincount(lane, minlength=lanes)


def decode_block(words: np.ndarray, counts: np.ndarray, n_ids: int, size: int) -> np.ndarray:
    """The ids, from the words of all lanes in turn and each lane's number of them."""
    lanes, steps, full = _shape(n_ids)
    # A zero follows a lane's words, for the one that is read beyond them.
    end = np.cumsum(counts + 1)
    pos = end - counts - 1
    padded = np.zeros(end[-1], np.uint32)
    padded[np.arange(len(words)) + np.repeat(np.arange(lanes), counts)] = words

    def word(k):
        """The next word of lanes k."""
        at = pos.take(k)
        pos[k] = at + 1
        return padded.take(at).astype(_U)

    every = np.arange(lanes)
    code = (word(every) << _32) | word(every)
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    m = _Model(lanes, size, decodes=True)
    out = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        n = lanes if t < steps - 1 else full
        m.predict(n, t)
        a, b = low[:n], rng[:n]
        b >>= _W
        sym = m.find(np.minimum((code[:n] - a) // b, _U((1 << _WHOLE) - 1)).astype(np.int32))
        out[t, :n] = sym
        start, width = m.interval(sym)
        a += b * start
        b *= width
        m.update(n, sym)
        k = np.flatnonzero(b < _ONE32)
        if len(k):
            code[k] = (code.take(k) << _32) | word(k)
            low[k], rng[k] = _shrink(low.take(k), rng.take(k))
    ids = np.empty(n_ids, np.int32)
    _turn(out[:, :full], ids[: full * steps].reshape(full, steps))
    _turn(out[: steps - 1, full:], ids[full * steps :].reshape(lanes - full, steps - 1))
    return ids


def _blocks(n: int) -> np.ndarray:
    """Bounds of blocks of like size."""
    return np.linspace(0, n, -(-n // BLOCK) + 1).astype(np.int64) if n else np.zeros(1, np.int64)


def pack(ids: np.ndarray, id_bits: int = 16) -> bytes:
    """A segment: header; for each block its ids, lanes, words and the CRC-32 of its ids; then its lanes' counts, and words."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top > 1 << min(id_bits, 20):
        raise ValueError("an id needs more bits than id_bits, or than 20")
    bounds, body = _blocks(len(ids)), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words, counts = encode_block(ids[a:b], top)
        check = zlib.crc32(np.ascontiguousarray(ids[a:b], "<u4"))
        body.append(struct.pack("<IIII", b - a, len(counts), len(words), check) + counts.astype("<u2").tobytes() + words.astype("<u4").tobytes())
    return b"".join([MAGIC, struct.pack("<QII", len(ids), top, len(body)), *body])


def unpack(data: bytes) -> np.ndarray:
    """The ids; raises ValueError where a block fails its checksum."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, top, blocks = struct.unpack_from("<QII", data, 4)
    at, found = 20, [np.zeros(0, np.int32)]
    for k in range(blocks):
        size, lanes, words, check = struct.unpack_from("<IIII", data, at)
        at += 16
        try:
            counts = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
            ids = decode_block(np.frombuffer(data, "<u4", words, at + 2 * lanes), counts, size, top)
        except (ValueError, IndexError) as e:
            raise ValueError(f"block {k} is damaged") from e
        if zlib.crc32(np.ascontiguousarray(ids, "<u4")) != check:
            raise ValueError(f"block {k} is damaged")
        found.append(ids)
        at += 2 * lanes + 4 * words
    if sum(map(len, found)) != n:
        raise ValueError("blocks are missing")
    return np.concatenate(found)
