"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``BLOCK`` ids. Every block starts from the same empty model and has
its own checksum, so a block can be read alone. A block is cut into lanes of about ``LANE`` ids, each
with an interval of its own, that share the block's model: a step codes one id of every lane, and
the model then learns from all of them.

The model predicts whole ids by three orders:

* order 0: adaptive frequencies of the ids seen in the block, worked out anew at the steps of
  ``refresh_steps``, with a share kept for ids not seen before;
* order 1 and order 2: tables indexed by hashes of the last one and two ids name a candidate
  and a confidence; how often a candidate of each confidence was right in this block is counted.

For each id the chance that the candidate (of order 2, else of order 1) is right is mixed in
the logistic domain from all three: its order-0 frequency and the counted chances of both
confidences, with weights learned as the lane goes. The answer is coded with that chance. After a
miss the id is coded by its order-0 frequency among all ids but the candidate, or, if new to the
block, by the kept share and then evenly over the vocabulary.

All arithmetic is on integers, so any machine reads what another has written. The lanes of all
blocks of a segment are coded side by side, as numpy vectors.

Segment: magic, ids, blocks, vocabulary, lanes (little-endian 32-bit words), then for every block
the CRC-32 of its words, for every lane its number of words, then the words of all lanes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

MAGIC = 0x33434D54
#: Ids of a block and of a lane.
BLOCK, LANE = 1 << 18, 512
#: Entries of a block's order-1 and order-2 tables.
TABLE1, TABLE2 = 1 << 15, 1 << 17
#: Order-0 frequencies are whole parts of this; a block has at most half as many distinct ids.
PARTS = 1 << 19
TOP, MASK = np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
B4, B5, B16, B20, B32 = (np.uint64(x) for x in (4, 5, 16, 20, 32))
LOW20, ZERO, ALL = np.uint64((1 << 20) - 1), np.uint64(0), np.uint64(PARTS)
SPREAD = 2047
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-z / 256)))))
                   for z in range(-SPREAD, SPREAD + 1)], np.int32)
STRETCH = np.array([max(-SPREAD, min(SPREAD, round(256 * math.log((p + 0.5) / (4095.5 - p)))))
                    for p in range(4096)], np.int32)


def refresh_steps(length: int) -> set[int]:
    """Steps before which order-0 frequencies are worked out anew: a third further on each time, 256 at most."""
    out, t = set(), 1
    while t < length:
        out.add(t)
        t += min(256, max(1, t // 3))
    return out


class Lanes:
    """The lanes of a segment of ``total`` ids: longest first, so that those still going are the first ones."""

    def __init__(self, total: int):
        sizes = [BLOCK] * (total // BLOCK) + [total % BLOCK] * (total % BLOCK > 0)
        self.sizes, self.block, self.length = sizes, [], []
        for b, size in enumerate(sizes):
            n = max(1, size // LANE)
            step = -(-size // n)
            own = [min(step, size - at) for at in range(0, size, step)]
            self.length += own
            self.block += [b] * len(own)
        self.length, self.block = np.array(self.length, np.int64), np.array(self.block, np.int64)
        self.first = np.cumsum(self.length) - self.length
        # a tail's lanes may be longer than those of whole blocks
        self.order = np.argsort(-self.length, kind="stable")
        self.steps = int(self.length.max(initial=0))
        sorted_length = self.length[self.order]
        self.live = np.searchsorted(-sorted_length, -np.arange(self.steps), side="left").tolist()

    def table(self, ids: np.ndarray) -> np.ndarray:
        """(step, lane) of a segment's ids; 0 where a lane has ended."""
        out = np.zeros((self.steps, len(self.order)), np.int32)
        for lane, n, at, length in self.stretches():
            out[:length, lane:lane + n] = ids[at:at + n * length].reshape(n, length).T
        return out

    def ids(self, table: np.ndarray, total: int) -> np.ndarray:
        out = np.zeros(total, np.int32)
        for lane, n, at, length in self.stretches():
            out[at:at + n * length].reshape(n, length)[:] = table[:length, lane:lane + n].T
        return out

    def stretches(self) -> list[tuple[int, int, int, int]]:
        """(first column, lanes, first id, length) of lanes of one length that follow each other in both orders."""
        order, length = self.order, self.length[self.order]
        cut = np.flatnonzero(np.append(True, (np.diff(order) != 1) | (np.diff(length) != 0)))
        return [(a, z - a, int(self.first[order[a]]), int(length[a]))
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(order)])]


class Model:
    """The models of all blocks of a segment.

    ``zero`` holds an id's order-0 logit (raised by 2,048, from bit 40), the place where its part of the
    frequencies starts (from bit 20) and the size of this part in one word.
    """

    def __init__(self, lanes: Lanes, vocabulary: int, reads: bool):
        n, blocks = len(lanes.order), len(lanes.sizes)
        self.block = lanes.block[lanes.order]
        self.vocabulary, self.blocks, self.reads = vocabulary, blocks, reads
        self.at1, self.at2, self.at0 = self.block * TABLE1, self.block * TABLE2, self.block * (vocabulary + 1)
        self.table1, self.table2 = np.zeros(blocks * TABLE1, np.int32), np.zeros(blocks * TABLE2, np.int32)
        self.right, self.asked = np.zeros((2, blocks, 16), np.int64), np.zeros((2, blocks, 16), np.int64)
        self.context = self.block * 16
        self.weights = [np.full(n, x, np.int32) for x in (3000, 22000, 44000)]
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.seen = np.zeros((blocks, vocabulary), np.int64)
        self.known, self.total = [0] * blocks, [0] * blocks
        self.zero = np.full(blocks * (vocabulary + 1), int(STRETCH[0]) + 2048 << 40, np.uint64)
        self.zero[vocabulary::vocabulary + 1] += np.uint64(PARTS)   # all is new
        kind = np.uint16 if vocabulary < 1 << 16 else np.int32
        self.symbol = np.full(blocks * PARTS if reads else 0, vocabulary, kind)

    def refresh(self, ids: np.ndarray, live: int) -> None:
        """Order-0 frequencies after further steps of ``ids`` (those of lanes that have ended since count not)."""
        v = self.vocabulary
        at = ids[:, :live] + (self.block[:live] * v)
        counts = np.bincount(at.reshape(-1), minlength=self.blocks * v).reshape(self.blocks, v)
        for b in np.unique(self.block[:live]).tolist():
            seen = self.seen[b]
            seen += counts[b]
            known = np.flatnonzero(seen > 0)
            parts = seen.take(known)
            total = int(parts.sum())
            fresh, more = len(known) - self.known[b], total - self.total[b]
            self.known[b], self.total[b] = len(known), total
            kept = min(PARTS * (fresh + 1) // (2 * (more + 2)), (PARTS - len(known)) // 2)
            parts *= PARTS - len(known) - max(1, kept)
            parts //= total
            parts += 1
            stop = np.cumsum(parts)
            own = self.zero[b * (v + 1):(b + 1) * (v + 1)]
            own[known] = (STRETCH.take(parts >> 7, mode="clip") + 2048 << 40) + (stop - parts << 20) + parts
            used = int(stop[-1]) if len(stop) else 0
            own[v] = (used << 20) + PARTS - used
            if self.reads:
                symbol = self.symbol[b * PARTS:(b + 1) * PARTS]
                symbol[:used] = np.repeat(known.astype(symbol.dtype), parts)
                symbol[used:] = v

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Candidates of the first ``n`` lanes, their chances in 65,536ths, their places and parts of order 0."""
        last = self.last[:n]
        self.i1 = (last * 40503 >> 3 & TABLE1 - 1) + self.at1[:n]
        self.i2 = (last * 30011 + self.before[:n] * 12289 >> 2 & TABLE2 - 1) + self.at2[:n]
        self.a, self.b = a, b = self.table1.take(self.i1, mode="clip"), self.table2.take(self.i2, mode="clip")
        self.k1, self.k2, self.g1, self.g2 = k1, k2, g1, g2 = a & 7, b & 7, a >> 3, b >> 3
        two, same = k2 > 0, g1 == g2
        guess = np.where(two, g2, g1)
        self.c = (k1 << 1 | (same | ~two)) + self.context[:n], (k2 << 1 | (same | two)) + self.context[:n]
        counted = STRETCH.take((self.right * 4096 + 1024) // (self.asked + 4), mode="clip").reshape(2, -1)
        own = self.zero.take(self.at0[:n] + guess, mode="clip")
        self.s = ((own >> np.uint64(40)).astype(np.int32) - 2048,
                  *[x.take(c, mode="clip") for x, c in zip(counted, self.c)])
        z = sum(w[:n] * s >> 16 for w, s in zip(self.weights, self.s))
        self.p = SQUASH.take(z + SPREAD, mode="clip")
        return guess, self.p.astype(np.uint64) << B4, own >> B20 & LOW20, own & LOW20

    def places(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and parts of order 0 of ``ids`` of the first ``n`` lanes."""
        found = self.zero.take(self.at0[:n] + ids, mode="clip")
        return found >> B20 & LOW20, found & LOW20

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        n = len(ids)
        err = hit * np.int32(4095) - self.p
        for w, s in zip(self.weights, self.s):
            w[:n] += s * err + 16384 >> 15
        for i, c in enumerate(self.c):  # how often each context was asked and right
            told = np.bincount((c << 1) + hit, minlength=self.blocks * 32).reshape(-1, 16, 2)
            self.right[i] += told[..., 1]
            self.asked[i] += told[..., 0] + told[..., 1]
        fresh = ids << 3 | 1
        for table, i, entry, g, k in ((self.table1, self.i1, self.a, self.g1, self.k1),
                                      (self.table2, self.i2, self.b, self.g2, self.k2)):
            up = k + 1
            table[i] = np.where(g == ids, entry + (1 - (up >> 3)), np.where(k > 1, entry - (up >> 1), fresh))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def narrow(low: np.ndarray, width: np.ndarray, hit: np.ndarray, part: np.ndarray, unit: np.ndarray,
           start: np.ndarray, share: np.ndarray) -> None:
    """Intervals of a step: ``part`` after a hit, else those of the id behind it."""
    low += np.where(hit, ZERO, part + unit * start)
    width[:] = np.where(hit, part, unit * share)


def settle(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which intervals are narrower than a word and give off one, and the words. An interval is as
    wide as a word again after that, as a step leaves some width to every outcome."""
    small = width < TOP
    across = (low ^ (low + width)) >= TOP
    across &= small
    some = np.flatnonzero(across)
    if len(some):  # the word is not settled yet: narrow the interval until it is
        width[some] = (ZERO - low[some]) & MASK
    word = low >> B32
    shift = small.astype(np.uint64) << B5
    low <<= shift
    width <<= shift
    return small, word


def intervals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends and widths of the intervals of ``n`` lanes."""
    return np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A segment that holds ``ids`` (each below ``vocabulary``)."""
    vocabulary = max(1, vocabulary)
    lanes = Lanes(len(ids))
    n = len(lanes.order)
    head = np.array([MAGIC, len(ids), len(lanes.sizes), vocabulary, n], "<u4").tobytes()
    if not n:
        return head
    table = lanes.table(ids)
    words, owners = [], []

    def sent(small: np.ndarray, word: np.ndarray, lane: np.ndarray | None = None) -> None:
        some = np.flatnonzero(small)
        words.append(word.take(some).astype(np.uint32))
        owners.append(some if lane is None else lane.take(some))

    model, (lows, widths), again, done = Model(lanes, vocabulary, False), intervals(n), refresh_steps(lanes.steps), 0
    for t, live in enumerate(lanes.live):
        if t in again:
            model.refresh(table[done:t], live)
            done = t
        x, low, width = table[t, :live], lows[:live], widths[:live]
        guess, chance, own_start, own_share = model.predict(live)
        hit = guess == x
        start, share = model.places(x, live)
        new = np.flatnonzero((share == 0) & ~hit)
        if len(new):
            seen = model.zero.take(model.at0[new] + vocabulary)
            start[new], share[new] = seen >> B20 & LOW20, seen & LOW20
        part = (width >> B16) * chance
        unit = (width - part) // (ALL - own_share)
        start -= own_share * (start > own_start)
        narrow(low, width, hit, part, unit, start, share)
        sent(*settle(low, width))
        if len(new):
            unit = width[new] // np.uint64(vocabulary)
            own = low[new] + unit * x[new].astype(np.uint64)
            sent(*settle(own, unit), new)
            low[new], width[new] = own, unit
        model.update(x, hit)
    for word in (lows >> B32, lows & MASK):
        sent(np.ones(n, bool), word)
    # the words of every lane, in the order in which they were sent
    owner = lanes.order[np.concatenate(owners)]
    owner = owner.astype(np.uint16 if n <= 1 << 16 else np.uint32)
    flat = np.concatenate(words)[np.argsort(owner, kind="stable")].astype("<u4")
    used = np.bincount(owner, minlength=n)
    ends = np.cumsum(np.bincount(lanes.block, used).astype(np.int64))
    sums = [zlib.crc32(flat[a:z]) for a, z in zip([0, *ends[:-1]], ends)]
    return b"".join([head, np.array(sums, "<u4").tobytes(), used.astype("<u4").tobytes(), flat.tobytes()])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment; a damaged block raises an error that names it."""
    if len(data) < 20 or np.frombuffer(data, "<u4", 1)[0] != MAGIC:
        raise ValueError("not a segment of token ids")
    _, total, blocks, vocabulary, n = np.frombuffer(data, "<u4", 5).tolist()
    if not n:
        return np.zeros(0, np.int32)
    lanes = Lanes(total)
    if (len(lanes.sizes), len(lanes.order)) != (blocks, n):
        raise ValueError("not a segment of token ids")
    sums = np.frombuffer(data, "<u4", blocks, 20)
    used = np.frombuffer(data, "<u4", n, 20 + 4 * blocks).astype(np.int64)
    words = np.frombuffer(data, "<u4", -1, 20 + 4 * (blocks + n))
    ends = np.cumsum(np.bincount(lanes.block, used).astype(np.int64))
    for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends)):
        if zlib.crc32(words[a:z]) != sums[i]:
            raise ValueError(f"block {i} of {blocks} is damaged")
    words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(np.uint64)
    first = (np.cumsum(used) - used)[lanes.order]
    code, place = (words[first] << B32) | words[first + 1], first + 2
    model, (lows, widths), again, done = Model(lanes, vocabulary, True), intervals(n), refresh_steps(lanes.steps), 0
    found = np.zeros((lanes.steps, n), np.int32)
    symbols = model.block * PARTS

    def read(some: np.ndarray) -> None:
        at = place.take(some)
        code[some] = code.take(some) << B32 | words.take(at)
        place[some] = at + 1

    for t, live in enumerate(lanes.live):
        if t in again:
            model.refresh(found[done:t], live)
            done = t
        low, width = lows[:live], widths[:live]
        guess, chance, own_start, own_share = model.predict(live)
        part = (width >> B16) * chance
        inside = code[:live] - low
        hit = inside < part
        rest = ALL - own_share
        unit = (width - part) // rest
        value = np.minimum((inside - part) // unit, rest - np.uint64(1))  # without meaning after a hit
        value += own_share * (value >= own_start)
        x = model.symbol.take(symbols[:live] + value.view(np.int64), mode="clip").astype(np.int32)
        start, share = model.places(x, live)
        start -= own_share * (start > own_start)
        narrow(low, width, hit, part, unit, start, share)
        small, _ = settle(low, width)
        read(np.flatnonzero(small))
        x = np.where(hit, guess, x)
        new = np.flatnonzero(x == vocabulary)
        if len(new):
            unit = width[new] // np.uint64(vocabulary)
            x[new] = np.minimum((code[new] - low[new]) // unit, np.uint64(vocabulary - 1))
            own = low[new] + unit * x[new].astype(np.uint64)
            small, _ = settle(own, unit)
            low[new], width[new] = own, unit
            read(new[small])
        model.update(x, hit)
        found[t, :live] = x
    return lanes.ids(found, total)
