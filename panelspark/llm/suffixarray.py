"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy vectors.

The steps are those of induced sorting: classify suffixes as smaller or larger than the one
after them, sort the leftmost smaller ones by the strings between them, name these strings,
sort the shorter text of names if names repeat, and induce the order of all suffixes from it.
Induction runs bucket by bucket: all of a bucket's entries are followed by their predecessors
at once. A text of names with a large alphabet is sorted by doubling ranks instead.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is sorted bucket by bucket.
BUCKETS = 1024


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last one, the sentinel, is)."""
    step = np.sign(text[1:] - text[:-1]).astype(np.int8)
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def induce(text: np.ndarray, smaller: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes from that of the leftmost smaller ones (``first``)."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    stops = np.cumsum(counts)
    starts = stops - counts
    out = np.zeros(n, np.int64)
    short = text.astype(np.int16)  # names are few: small keys are read and sorted faster
    before = np.empty(n, np.int16)
    before[0] = -1
    before[1:] = np.where(smaller[:-1], np.int16(-1), short[:-1])
    seeds = first[np.argsort(short[first], kind="stable")]
    seed_stops = np.cumsum(np.bincount(text[first], minlength=size))
    seed_starts = np.concatenate([[0], seed_stops[:-1]])
    head = starts.copy()
    used = np.flatnonzero(counts)

    for c in used.tolist():
        at = starts[c]
        while at < head[c]:  # larger suffixes of the bucket that precede each other
            stop = head[c]
            entry = out[at:stop]
            own = entry[before[entry] == c] - 1
            out[stop:stop + len(own)] = own
            at, head[c] = stop, stop + len(own)
        entry = np.concatenate([out[starts[c]:head[c]], seeds[seed_starts[c]:seed_stops[c]]])
        put(out, entry, before[entry], c + 1, head, 1)

    before[1:] = np.where(smaller[:-1], short[:-1], np.int16(size))
    before[0] = size
    tail = stops.copy()
    out[0] = n - 1
    tail[text[n - 1]] = 0
    for c in used[::-1].tolist():
        if c == text[n - 1]:
            continue
        stop = stops[c]
        while tail[c] < stop:  # smaller suffixes of the bucket that precede each other, from its end
            at = tail[c]
            entry = out[at:stop][::-1]
            own = entry[before[entry] == c] - 1
            out[at - len(own):at] = own[::-1]
            stop, tail[c] = at, at - len(own)
        entry = np.concatenate([out[tail[c]:stops[c]][::-1], out[starts[c]:head[c]][::-1]])
        bucket = before[entry]
        put(out, entry, np.where(bucket < c, bucket, np.int16(-1)), 0, tail, -1)
    return out


def put(out: np.ndarray, entry: np.ndarray, bucket: np.ndarray, least: int, ends: np.ndarray, step: int) -> None:
    """Append the predecessors of ``entry`` to their buckets, in order, where these are at least ``least``."""
    keep = bucket >= least
    if not keep.any():
        return
    bucket, place = bucket[keep], entry[keep] - 1
    order = np.argsort(bucket, kind="stable")
    bucket, place = bucket[order], place[order]
    n = np.bincount(bucket, minlength=len(ends))
    rank = np.arange(len(bucket)) - (np.cumsum(n) - n)[bucket]
    if step > 0:
        out[ends[bucket] + rank] = place
    else:
        out[ends[bucket] - 1 - rank] = place
    ends += step * n


def names_of(text: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names, in text order, of the strings from each leftmost smaller suffix to the next."""
    length = np.append(np.diff(leftmost) + 1, 1)
    place = np.searchsorted(leftmost, order)
    size = length[place]
    a, b = order[:-1], order[1:]
    differ = size[:-1] != size[1:]
    left = np.flatnonzero(~differ)
    k = 0
    while len(left):
        same = text[a[left] + k] == text[b[left] + k]
        differ[left[~same]] = True
        k += 1
        left = left[same & (k < size[left])]
    names = np.empty(len(leftmost), np.int64)
    names[place] = np.concatenate([[0], np.cumsum(differ)])
    return names


def by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array by sorting pairs of ranks of twice the length each time."""
    n, k = len(text), 1
    rank = text.astype(np.int64) if text.max() < n else np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key)  # equal keys get one rank, in whatever order they are
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last is 0 and smaller than all others."""
    text = text.astype(np.int64)
    size = int(text.max()) + 1
    if len(text) < 3 or size > BUCKETS:
        return by_doubling(text)
    smaller = smaller_than_next(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = induce(text, smaller, leftmost, size)
    mark = np.zeros(len(text), bool)
    mark[leftmost] = True
    order = order[mark[order]]
    names = names_of(text, leftmost, order)
    if names.max() + 1 < len(names):
        order = leftmost[suffix_array(names)]
    return induce(text, smaller, order, size)


def previous_suffixes(order: np.ndarray) -> np.ndarray:
    """By text position: the suffix before it in ``order`` (the last position for the first one)."""
    previous = np.empty(len(order), np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = len(order) - 1
    return previous


def by_fours(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit symbols with room for ``most`` more, and four of them from every position as one word."""
    padded = np.concatenate([text.astype("<u2"), np.zeros(most + 4, "<u2")])
    return padded, np.ndarray((len(text) + most + 1,), "<u8", padded, 0, (2,))


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By text position: common prefix with the suffix before it in ``order``, counted up to ``most``.

    ``text`` holds 16-bit symbols; four of them are compared at a time, then single ones.
    """
    previous = previous_suffixes(order)
    padded, words = by_fours(text, most)
    out = np.zeros(len(text), np.int64)
    left = np.flatnonzero(np.arange(len(text)) != order[0])
    for k in range(0, most // 4 * 4, 4):
        left = left[words[left + k] == words[previous[left] + k]]
        out[left] = k + 4
    left = np.flatnonzero(np.arange(len(text)) != order[0])
    for _ in range(3):
        left = left[out[left] < most]
        left = left[padded[left + out[left]] == padded[previous[left] + out[left]]]
        out[left] += 1
    return out


def reaches(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By text position: is the common prefix with the suffix before it in ``order`` at least ``length``?"""
    previous = previous_suffixes(order)
    padded, words = by_fours(text, length)
    left = np.flatnonzero(np.arange(len(text)) != order[0])
    if length < 4:
        for k in range(length):
            left = left[padded[left + k] == padded[previous[left] + k]]
    else:  # the last four symbols first, as neighbours that fall short mostly differ there
        for k in (length - 4, *range(0, length - 4, 4)):
            left = left[words[left + k] == words[previous[left] + k]]
    out = np.zeros(len(text), bool)
    out[left] = True
    return out
