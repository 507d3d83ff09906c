"""Suffix-array dedup: bytes covered by a long string that a smaller document also holds.

No suffix of the whole corpus is shuffled. Texts are dealt over groups of some ``GROUP_BYTES`` by a hash,
in one exchange that all steps read. Every start of a ``length``-byte string belongs to an
anchor, the smallest hash among the ``gram``-byte strings inside it; consecutive starts with one
anchor are a run. Equal strings have equal anchors, so

1. anchors are counted over the corpus (packed by anchor; a group tells each of its anchors once, and
   whether several of its texts hold it) and those of two different texts are told to the groups that
   hold them. An anchor of many different runs, as at both ends of a passage in many contexts, is split: each
   string of its runs is a run by itself, with a hash of the string as its anchor;
2. the bytes of the remaining runs are gathered by anchor, a group's equal runs once with the smallest id.
   Each shard sorts the suffixes of the runs of anchors that have several different runs by
   induced sorting; a permuted common prefix of ``length`` bytes joins strings into classes, and
   each class gets its smallest id;
3. a group is told, once for each of its different runs and by its place among them, which starts a
   smaller document holds, so what it sends and gets does not grow with the texts that share a passage;
4. it finds its runs anew, merges the intervals of each text and drops the bytes.

Texts that are equal as a whole are settled first (all bytes go but those of the smallest id), so
groups of copies of any size do not enter the steps above.

Defined results: a missing or empty text is empty; a text shorter than ``length`` loses nothing;
rows without an id keep all bytes and remove none elsewhere; rows that share an id do not
remove each other's bytes; rows that repeat get equal results; an empty table gives an empty
result; other columns are not read. Runs are told apart by 95-bit and whole texts by 128-bit hashes;
strings are compared byte by byte. A task holds one group (a longer text, or all repetitions of one row,
beyond that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_batches, heavy_join, mix64, pieces
from panelspark.llm.suffixarray import reaches, suffix_array
from panelspark.session import materialize

ROLL = np.uint64(0x9E3779B97F4A7C15)
ANCHOR_BITS = 48
#: Bounds of what a task holds: text of a group (there are ``LEAST_GROUPS`` at least), text behind a
#: bucket of anchors (those of runs hold a quarter), anchors before they are packed, bytes that are sorted at once.
GROUP_BYTES = 16 << 20
LEAST_GROUPS = 48
TEXT_BYTES_PER_BUCKET = 32 << 20
FLUSH_RUNS = 1_200_000
FLUSH_TEXTS = 1 << 16
#: Bytes of texts that are hashed side by side (a longer text alone); their vectors stay in a core's cache.
HASHED_BYTES = 64 << 10
SORTED_BYTES = 150_000
#: An anchor that more than a ``WIDE_PART``-th of a stretch's texts hold (and ``WIDE_TEXTS`` at least)
#: has its texts listed apart. An anchor of more than ``SPLIT_RUNS`` different runs, counted in
#: stretches where it has more than ``FEW_RUNS``, is split by the strings of its runs.
WIDE_PART = 32
WIDE_TEXTS = 64
FEW_RUNS = 4
SPLIT_RUNS = 4000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position (``gram`` is at least 8)."""
    n = max(0, len(data) - gram + 1)
    out = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 7, 8), gram - 8] if gram % 8 else range(0, gram, 8):
        out += np.ndarray((n,), "<u8", data, at, (1,))
        out *= ROLL
        out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[:len(x) - (width - k)], x[width - k:]) if k < width else x


def side_by_side(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, stop, bytes, where each text starts in them and the last one ends) of stretches
    of about ``HASHED_BYTES`` of binary values without nulls."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else []
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + HASHED_BYTES, side="right")) - 1)
        yield first, stop, np.frombuffer(texts.buffers()[2], np.uint8)[at[first]:at[stop]], at[first:stop + 1] - at[first]
        first = stop


def runs_of(data: np.ndarray, edges: np.ndarray, length: int, gram: int):
    """(hashes, anchor, first start, starts, text) of the runs of texts that lie one after the other in
    ``data``, text i from edges[i] to edges[i + 1]; each has at least ``length`` bytes.

    Anchors are mixed once more, as the smallest hashes crowd the lowest buckets.
    """
    hashes = gram_hashes(data, gram)
    least = sliding_min(hashes, length - gram + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[edges[:-1]] = True
    new[edges[1:-1] - length + 1] = True  # strings from here on reach into the next text
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(least)))
    text = np.searchsorted(edges, start, side="right") - 1
    inside = start + length <= edges[text + 1]
    start, n, text = start[inside], n[inside], text[inside]
    return hashes, mix64(least[start]) >> np.uint64(64 - ANCHOR_BITS), start, n, text


def marked_anchors(data: np.ndarray, edges: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of texts, each with 16 bits that tell its different runs apart, and whose they are."""
    hashes, anchor, start, n, text = runs_of(data, edges, length, gram)
    sums = np.append(np.uint64(0), np.cumsum(hashes, dtype=np.uint64))
    mark = mix64(sums[start + n + length - gram] - sums[start]) >> np.uint64(ANCHOR_BITS)
    return anchor << np.uint64(64 - ANCHOR_BITS) | mark, text


def different(x: np.ndarray) -> np.ndarray:
    """The different values in ascending order."""
    x = np.sort(x)
    return x[group_starts(x)[0]]


def bucket_edges(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in ascending anchors."""
    limits = -(-(np.arange(buckets + 1, dtype=object) << ANCHOR_BITS) // buckets)
    return np.searchsorted(anchors, np.array([int(x) for x in limits], np.uint64))


def planes(x: np.ndarray, n: int) -> bytes:
    """The lower ``n`` bytes of ascending integers, byte by byte, which compresses well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(n, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :n] = part.T
    return out.view("<u8").reshape(-1)


def group_starts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of every group of equal values in ascending ones."""
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(a)))


def packed_anchors(batches, buckets: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(bucket, anchors, tokens, holders, several, varied): the distinct anchors of stretches of ``batches``
    (text, token), the tokens of their texts and for each anchor which of these it is and whether several
    of its texts hold it (a bit each), and the marked anchors of those that have several different runs.

    An anchor that a large part of a stretch's tokens hold sends its smallest and largest token to
    its bucket; all its tokens go to a bucket beyond ``buckets``, another one for each stretch.
    """
    found, pairs, owners, tokens, held, n_texts = [], [], [], [], 0, 0
    shift = np.uint64(64 - ANCHOR_BITS)
    low = np.uint64((1 << (64 - ANCHOR_BITS)) - 1)

    def flush():
        names, which = np.unique(np.concatenate(tokens), return_inverse=True)
        # anchor and token in one integer: a stretch has at most 2^16 texts
        both = np.sort(np.concatenate(pairs) | which.astype(np.uint64)[np.concatenate(owners)])
        first, size = group_starts(both)
        a, t, more = both[first] >> shift, (both[first] & low).astype(np.uint16), size > 1
        first, size = group_starts(a)
        wide = np.repeat(size > max(WIDE_TEXTS, n_texts // WIDE_PART), size)
        end = np.zeros(len(a), bool)
        end[first] = end[first + size - 1] = True
        rows = []

        def put(bucket, a, t, more, varied):
            some, of = np.unique(t, return_inverse=True)
            rows.append((bucket, planes(a, 6), names[some].tobytes(), of.astype(np.uint16).tobytes(),
                         np.packbits(more).tobytes(), varied))

        if wide.any():
            put(buckets + int(mix64(names[:1].view(np.uint64))[0] % np.uint64(buckets)), a[wide], t[wide], more[wide], b"")
        a, t, more = (x[~wide | end] for x in (a, t, more))
        varied = different(np.concatenate(found))
        runs = group_starts(varied >> shift)[1]
        varied = varied[np.repeat(runs > FEW_RUNS, runs)]
        edges, bounds = bucket_edges(a, buckets), bucket_edges(varied >> shift, buckets)
        for b, (x, z, p, q) in enumerate(zip(edges, edges[1:], bounds, bounds[1:])):
            if x < z:
                put(b, a[x:z], t[x:z], more[x:z], planes(varied[p:q], 8))
        names_, kinds = ["bucket", "anchors", "tokens", "holders", "several", "varied"], [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names_)

    for batch in pieces(batches):
        token = batch.column("token").to_numpy()
        for first, stop, data, edges in side_by_side(batch.column("text")):
            if held >= FLUSH_RUNS or n_texts + stop - first > FLUSH_TEXTS:
                yield flush()
                found, pairs, owners, tokens, held, n_texts = [], [], [], [], 0, 0
            marked, text = marked_anchors(data, edges, length, gram)
            own = different(marked & ~low | text.astype(np.uint64))
            found.append(marked)
            pairs.append(own & ~low)
            owners.append((own & low).astype(np.int64) + n_texts)
            tokens.append(token[first:stop])
            held += len(marked)
            n_texts += stop - first
    if held:
        yield flush()


ANCHORS = "bucket int, anchors binary, tokens binary, holders binary, several binary, varied binary"


def anchor_rows(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """:func:`packed_anchors` of rows (text, token)."""
    return texts.mapInArrow(lambda batches: packed_anchors(batches, buckets, length, gram), ANCHORS)


def held_by_several(found: pa.Table, buckets: int, split_runs: int) -> tuple[np.ndarray, ...]:
    """(anchor, token, tokens of the anchor) of a bucket's anchors that different texts hold, and of these
    the anchors that are to be split. For the anchors of many texts, which are told in whole, the number is the largest."""
    a = np.concatenate([from_planes(x, 6) for x in found.column("anchors").to_pylist()])
    t = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(of, np.uint16)] for x, of in zip(
        found.column("tokens").to_pylist(), found.column("holders").to_pylist())])
    if found.column("bucket")[0].as_py() >= buckets:
        return a, t, np.full(len(a), 1 << 62), a[:0]
    more = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(of) // 2) for x, of in zip(
        found.column("several").to_pylist(), found.column("holders").to_pylist())])
    order = np.lexsort((t, a))
    a, t, more = a[order], t[order], more[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])))
    a, t, more = a[first], t[first], np.maximum.reduceat(more, first)
    first, n = group_starts(a)
    shared = np.repeat((n > 1) | (np.maximum.reduceat(more, first) > 0), n)
    varied = np.concatenate([from_planes(x, 8) for x in found.column("varied").to_pylist()])
    varied = np.unique(varied) >> np.uint64(64 - ANCHOR_BITS)
    first, runs = group_starts(varied)
    return a[shared], t[shared], np.repeat(n, n)[shared], varied[first[runs > split_runs]]


def shared_anchors(packed: DataFrame, buckets: int, hot_texts: int, split_runs: int) -> DataFrame:
    """(token, anchor): anchors that different texts hold; those of more than ``hot_texts`` tokens as
    -1 - anchor. Anchors that are to be split have a row without a token."""

    def run(found: pa.Table) -> pa.Table:
        a, t, n, split = held_by_several(found, buckets, split_runs)
        a = np.where(n > hot_texts, -1 - a.astype(np.int64), a.astype(np.int64))
        return pa.table({"token": pa.concat_arrays([pa.array(t), pa.nulls(len(split), pa.int64())]),
                         "anchor": pa.array(np.append(a, split.astype(np.int64)))})

    return packed.groupBy("bucket").applyInArrow(run, "token long, anchor long")


def told_anchors(packed: DataFrame, buckets: int, split_runs: int) -> DataFrame:
    """(group, anchors, split): of :func:`packed_anchors` whose tokens are groups, the anchors of a bucket that
    different texts hold, once for each group that holds some, and which of these are to be split."""

    def run(found: pa.Table) -> pa.Table:
        a, t, _, split = held_by_several(found, buckets, split_runs)
        order = np.argsort(t, kind="stable")
        a, t = a[order], t[order]
        first, size = group_starts(t)
        lists = [a[x:x + n] for x, n in zip(first, size)]
        return pa.table({"group": pa.array(t[first].astype(np.int32)), "anchors": pa.array([planes(x, 6) for x in lists], pa.binary()),
                         "split": pa.array([planes(np.intersect1d(x, split), 6) for x in lists], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "group int, anchors binary, split binary")


def shared_runs(text: bytes, anchors, split: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, is it told as one of many texts, start, stop) of the runs of one text, as :func:`listed_runs`."""
    listed = np.array(anchors, np.int64)
    known = np.unique(np.where(listed < 0, -1 - listed, listed))
    anchor, start, stop, _ = listed_runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]), known, split, length, gram)
    return anchor, np.isin(-1 - anchor, listed), start, stop


def listed_runs(data: np.ndarray, edges: np.ndarray, known: np.ndarray, split: np.ndarray,
                length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, start, stop, text) of the runs whose anchor is ``known`` (ascending); stop is the end of their bytes.

    Runs of the anchors in ``split`` (ascending) become one run for each of their strings, with a
    hash of the string as its anchor: equal strings still meet, and only they do.
    """
    hashes, anchor, start, n, text = runs_of(data, edges, length, gram)
    anchor = anchor.astype(np.int64)
    keep = np.flatnonzero(among(anchor, known))
    anchor, start, n, text = anchor[keep], start[keep], n[keep], text[keep]
    cut = among(anchor, split)
    if cut.any():
        size = n[cut]
        at = np.arange(size.sum()) + np.repeat(start[cut] - (np.cumsum(size) - size), size)
        own = np.zeros(len(at), np.uint64)
        for k in [*range(0, length - gram, gram), length - gram]:
            own = mix64(own * ROLL + hashes[at + k])
        anchor = np.append(anchor[~cut], (own >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64))
        text = np.append(text[~cut], np.repeat(text[cut], size))
        start, n = np.append(start[~cut], at), np.append(n[~cut], np.ones(len(at), np.int64))
    return anchor, start, start + n + length - 1, text


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ascending ``known`` ones."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def own_texts(texts: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of a group's different texts that are no copies, in the order of ids and hashes, and which
    of these each of its rows is, -1 for a copy. The rows of ``told`` with an id are the copies."""
    copies = told.filter(pc.is_valid(told.column("id")))
    n = len(copies)
    i, r = (np.concatenate([copies.column(c).to_numpy(), texts.column(c).to_numpy()]) for c in ("id", "row"))
    order = np.lexsort((np.arange(len(i)) >= n, r, i))
    i, r = i[order], r[order]
    new = np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))[:len(i)]
    live = order[new] >= n
    of = np.empty(len(i), np.int64)
    of[order] = np.where(live, np.cumsum(live) - 1, -1)[np.cumsum(new) - 1]
    return order[new][live] - n, of[n:]


def taken(texts: pa.Table, places: np.ndarray) -> pa.LargeBinaryArray:
    """The texts at ``places``, one after the other."""
    held = texts.column("text").cast(pa.large_binary()).combine_chunks()
    return (held.chunk(0) if isinstance(held, pa.ChunkedArray) else held).take(pa.array(places))


def group_anchors(texts: pa.Table, told: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """:func:`packed_anchors` of a group, whose number is the token."""
    held = taken(texts, own_texts(texts, told)[0])
    token = pa.array(np.full(len(held), texts.column("group")[0].as_py(), np.int64))
    found = packed_anchors([pa.record_batch([held, token], ["text", "token"])], buckets, length, gram)
    return pa.Table.from_batches(found, pa.schema([("bucket", pa.int32()), *[
        (c, pa.binary()) for c in ("anchors", "tokens", "holders", "several", "varied")]]))


#: Two odd bases of polynomial hashes modulo 2^64, and their inverses.
BASES = [(x, pow(x, -1, 1 << 64)) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


class Powers:
    """Powers of the bases, kept as far as they were needed."""

    def __init__(self):
        self.held = np.ones((4, 1), np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        if self.held.shape[1] < n:
            size = 1 << n.bit_length()
            steps = np.array([x for pair in BASES for x in pair], np.uint64)[:, None].repeat(size, axis=1)
            steps[:, 0] = 1
            self.held = np.multiply.accumulate(steps, axis=1, out=steps)
        return self.held


def run_keys(data: bytes | np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, powers: Powers):
    """95 bits (a 64-bit and a 31-bit integer) that depend on the bytes of a run and its anchor alone."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    table = powers.up_to(len(x) + 1)
    salt = mix64(anchor.astype(np.uint64) * ROLL + (stop - start).astype(np.uint64))
    out = []
    for up, down in (table[:2], table[2:]):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:len(x)], dtype=np.uint64)])
        out.append(mix64((sums[stop] - sums[start]) * down[start] + salt))
    return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def unpacked(lists: pa.ChunkedArray) -> np.ndarray:
    """The different anchors of lists, ascending."""
    found = [from_planes(x, 6) for x in lists.drop_null().to_pylist()]
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def zipped(*parts: bytes) -> bytes:
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unzipped(data: bytes, *columns: tuple[int, int]) -> list[np.ndarray]:
    """The columns of (values, bytes a value) of planes one after the other."""
    ends = np.cumsum([n * width for n, width in columns])
    data = pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
    return [from_planes(data[z - n * width:z], width).view(np.int64) for z, (n, width) in zip(ends.tolist(), columns)]


def distinct_runs(held: pa.LargeBinaryArray, known: np.ndarray, split: np.ndarray, length: int, gram: int):
    """(anchor, start, stop, text) of the shared runs of texts, counted from the first text's beginning, equal ones
    together and by ascending anchors, and where each different run begins among them."""
    powers = Powers()
    found, at = [tuple(np.zeros(0, np.int64) for _ in range(6))], 0
    for first, _, data, edges in side_by_side(held):
        anchor, start, stop, text = listed_runs(data, edges, known, split, length, gram)
        found.append((anchor, *run_keys(data, start, stop, anchor, powers), start + at, stop + at, text + first))
        at += len(data)
    anchor, key, small, start, stop, text = map(np.concatenate, zip(*found))
    order = np.lexsort((key, anchor))  # texts stay in order
    anchor, key, small, start, stop, text = (x[order] for x in (anchor, key, small, start, stop, text))
    new = np.append(True, (key[1:] != key[:-1]) | (small[1:] != small[:-1]) | (anchor[1:] != anchor[:-1]))[:len(key)]
    return anchor, start, stop, text, np.flatnonzero(new)


def values_of(held: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text starts in them and the last one ends."""
    at = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
    data = held.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0]:at[-1]], at - at[0]


REQUEST = "bucket int, group int, n int, runs binary, size long, data binary, anchors binary, split binary"


def group_runs(texts: pa.Table, told: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """(bucket, group, n, runs, size, data, anchors, split): bytes of the different shared runs of a group, each with its
    anchor, its smallest id, its size and whether it has several ids; and what the group has been told, which a bucket sends
    back with its answers."""
    kinds = [("bucket", pa.int32()), ("group", pa.int32()), ("n", pa.int32()), ("runs", pa.binary()), ("size", pa.int64()),
             *[(c, pa.binary()) for c in ("data", "anchors", "split")]]
    rows = []
    known, split = unpacked(told.column("anchors")), unpacked(told.column("split"))
    if len(known):
        group = texts.column("group")[0].as_py()
        own = own_texts(texts, told)[0]
        held, ids = taken(texts, own), texts.column("id").to_numpy()[own]
        anchor, start, stop, text, first = distinct_runs(held, known, split, length, gram)
        last = np.append(first[1:], len(anchor))[:len(first)] - 1
        least = ids[text[first]]
        many = least != ids[text[last]]  # texts are in the order of ids
        anchor, start, stop = anchor[first], start[first], stop[first]
        values = memoryview(values_of(held)[0])
        edges = bucket_edges(anchor.astype(np.uint64), buckets)
        for b, (x, z) in enumerate(zip(edges, edges[1:])):
            if x < z:
                data = b"".join([values[p:q] for p, q in zip(start[x:z].tolist(), stop[x:z].tolist())])
                runs = zipped(planes(anchor[x:z], 6), planes(least[x:z], 8), planes((stop - start)[x:z], 4), planes(many[x:z], 1))
                rows.append((b, group, z - x, runs, len(data), zipped(data), None, None))
        rows.append((group % buckets, group, 0, None, 0, None, planes(known, 6), planes(split, 6)))
    return pa.table([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def smallest_ids(data: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: np.ndarray,
                 length: int) -> tuple[np.ndarray, ...]:
    """(spans per run, firsts, lasts, ids): starts first..last of a run whose strings have ``id`` as
    the smallest holder, for all runs one after the other. Runs are stretches of ``data``."""
    sizes = stop - start + 1
    ends = np.cumsum(sizes)
    text = np.ones(int(ends[-1]) + 1, np.uint16)  # 1 between runs
    text[-1] = 0
    place = np.arange(int(ends[-1]))
    inside = np.ones(int(ends[-1]), bool)
    inside[ends - 1] = False
    text[:-1][inside] = data[(place + np.repeat(start - (ends - sizes), sizes))[inside]].astype(np.uint16) + 2
    order = suffix_array(text)
    same = reaches(text, order, length)[order]
    owner = np.append(np.repeat(np.arange(len(sizes)), sizes), 0)
    first = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[owner[order]], first)
    by_place = np.empty(len(text), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.append(first, len(text))))
    # the starts of every run, and where the smallest holder changes among them
    n = sizes - length
    run = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    own = by_place[np.repeat(ends - sizes, n) + at]
    cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (run[1:] != run[:-1])))
    return np.bincount(run[cut], minlength=len(sizes)), at[cut], at[np.append(cut[1:] - 1, len(run) - 1)], own[cut]


ANSWER = "group int, bucket int, spans binary, size int, anchors binary, split binary"


def bucket_answers(found: pa.Table, length: int) -> pa.Table:
    """(group, bucket, spans, size, anchors, split): of the runs that a group has sent to a bucket, by their places, those in which
    a document loses, with the starts' smallest holders. What a group has been told goes back as it is."""
    names = ["group", "bucket", "spans", "size", "anchors", "split"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    told = pc.is_valid(found.column("anchors"))
    back, found = found.filter(told), found.filter(pc.invert(told))
    back = pa.table([back.column(c) if c in back.column_names and c != "size" else pa.nulls(len(back), kind)
                     for c, kind in zip(names, kinds)], names)
    if not len(found):
        return back
    groups, count, sizes = (found.column(c).to_numpy() for c in ("group", "n", "size"))
    data = [pa.decompress(d, decompressed_size=n, codec="zstd", asbytes=True)
            for n, d in zip(sizes.tolist(), found.column("data").to_pylist())]
    parts = [unzipped(x, (n, 6), (n, 8), (n, 4), (n, 1)) for n, x in zip(count.tolist(), found.column("runs").to_pylist())]
    powers = Powers()
    stops = [np.cumsum(z) for _, _, z, _ in parts]
    keys = [run_keys(d, z - n, z, a, powers) for d, z, (a, _, n, _) in zip(data, stops, parts)]
    key, small = map(np.concatenate, zip(*keys))
    anchor, ids, size, many = map(np.concatenate, zip(*parts))
    stop = np.cumsum(size)
    start = stop - size
    data = np.frombuffer(b"".join(data), np.uint8)
    # equal runs together, by ascending anchors
    order = np.lexsort((ids, small, key, anchor))
    key, small, anchor, ids, many, start, stop = (x[order] for x in (key, small, anchor, ids, many > 0, start, stop))
    at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (small[1:] != small[:-1]) | (anchor[1:] != anchor[:-1])))
    same = np.diff(np.append(at, len(key)))
    own, own_many, sent = ids, many, order
    anchor, start, stop, ids = anchor[at], start[at], stop[at], ids[at]
    first, size = group_starts(anchor)
    # the only run of its anchor shares its strings with no other: its holder is theirs
    alone = np.flatnonzero(np.repeat(size, size) == 1)
    spans = [(np.ones(len(alone), np.int64), 0 * alone, stop[alone] - start[alone] - length, ids[alone])]
    runs = [alone]
    weight = np.append(0, np.cumsum(stop - start))
    x = 0
    several = first[size > 1]
    ends = several + size[size > 1]
    while x < len(several):  # whole anchors are sorted together
        z = x
        held = []
        total = 0
        while z < len(several) and (z == x or total < SORTED_BYTES):
            held.append(np.arange(several[z], ends[z]))
            total += int(weight[ends[z]] - weight[several[z]])
            z += 1
        some = np.concatenate(held)
        spans.append(smallest_ids(data, start[some], stop[some], ids[some], length))
        runs.append(some)
        x = z
    n, firsts, lasts, least = map(np.concatenate, zip(*spans))
    n_of, from_of = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    runs = np.concatenate(runs)
    n_of[runs], from_of[runs] = n, np.cumsum(n) - n
    # a copy of the spans for each group that sent the run, where one of its documents may lose by them
    kind = np.repeat(np.arange(len(at)), same)
    sender = np.repeat(np.arange(len(own)), n_of[kind])
    span = np.arange(len(sender)) - np.repeat(np.cumsum(n_of[kind]) - n_of[kind], n_of[kind]) + from_of[kind][sender]
    loses = own_many[sender] | (least[span] < own[sender])
    sender, span = sender[loses], span[loses]
    begun = np.cumsum(count) - count
    order = np.argsort(sent[sender], kind="stable")
    place, span = sent[sender][order], span[order]
    row = np.searchsorted(begun, place, side="right") - 1
    rows = []
    for q, size in zip(*group_starts(row)):
        r, x = int(row[q]), span[q:q + size]
        rows.append((groups[r], found.column("bucket")[0].as_py(), zipped(
            planes(place[q:q + size] - begun[r], 4), planes(firsts[x], 4), planes((lasts - firsts)[x], 4),
            planes(least[x], 8)), int(size), None, None))
    return pa.concat_tables([back, pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)])


def group_texts(texts: pa.Table, told: pa.Table, buckets: int, length: int, gram: int) -> pa.Table:
    """(id, n_bytes, n_removed, n_spans, kept) of a group's rows, by the answers to what it has sent."""
    own, of = own_texts(texts, told)
    held, ids = taken(texts, own), texts.column("id").to_numpy()[own]
    data, at = values_of(held)
    edge = np.zeros(len(data) + 1, np.int32)
    answers = told.filter(pc.is_valid(told.column("spans")))
    if len(answers):
        known, split = unpacked(told.column("anchors")), unpacked(told.column("split"))
        anchor, start, _, text, begun = distinct_runs(held, known, split, length, gram)
        same = np.diff(np.append(begun, len(anchor)))
        edges = bucket_edges(anchor[begun].astype(np.uint64), buckets)
        for bucket, n, spans in zip(*[answers.column(c).to_pylist() for c in ("bucket", "size", "spans")]):
            place, first, size, least = unzipped(spans, (n, 4), (n, 4), (n, 4), (n, 8))
            run = edges[bucket] + place
            span = np.repeat(np.arange(n), same[run])
            each = np.arange(len(span)) - np.repeat(np.cumsum(same[run]) - same[run], same[run]) + begun[run][span]
            loses = least[span] < ids[text[each]]
            span, each = span[loses], each[loses]
            x = start[each] + first[span]
            np.add.at(edge, x, 1)
            np.add.at(edge, x + size[span] + length, -1)
    drop = np.cumsum(edge, out=edge)[:-1] > 0
    begins = drop.copy()
    begins[1:] &= ~drop[:-1]
    begins[at[:-1]] = drop[at[:-1]]
    gone, spans = (np.add.reduceat(x, at[:-1], dtype=np.int64) if len(own) else at[:0] for x in (drop, begins))
    size = np.diff(at)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [
        None, pa.py_buffer(np.append(0, np.cumsum(size - gone)).astype(np.int64)), pa.py_buffer(data[~drop])])
    copy = of < 0
    n_bytes = pc.binary_length(texts.column("text")).to_numpy().astype(np.int64)
    of_own = lambda x, other: np.where(copy, other, np.append(x, 0)[of])
    kept = pc.fill_null(kept.take(pa.array(of, mask=copy)), b"")
    return pa.table({"id": texts.column("id"), "n_bytes": pa.array(n_bytes), "n_removed": pa.array(of_own(gone, n_bytes)),
                     "n_spans": pa.array(of_own(spans, 1)),
                     "kept": pa.chunked_array([kept.slice(x, 1000).cast(pa.binary()) for x in range(0, len(kept), 1000)], pa.binary())})


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                     gram: int = 16, split_runs: int = SPLIT_RUNS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every text without each byte that is covered by a
    ``length``-byte string which also starts in a text of a smaller id. Ids are integers;
    ``kept`` is binary, as a cut may fall inside a character."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = F.octet_length("text").cast("long")
    in_question = F.col("id").isNotNull() & (size >= length)
    long_rows = rows.withColumn("row", F.xxhash64("text")).where(in_question)

    slim = materialize(long_rows.select("id", "row", F.xxhash64(F.lit(5), F.col("text")).alias("row2"),
                                        size.alias("size")).distinct(), "texts")
    same = materialize(slim.groupBy("row", "row2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "distinct-texts")
    total = same.agg(F.sum("n"), F.sum("size"), F.sum(F.col("n") * F.col("size"))).first()
    buckets = max(1, -(-(total[1] or 0) // TEXT_BYTES_PER_BUCKET))
    groups = max(LEAST_GROUPS, -(-(total[2] or 0) // GROUP_BYTES))
    group = F.pmod(F.xxhash64("id", "row"), F.lit(groups)).cast("int").alias("group")
    known = heavy_join(slim.drop("size"), same, ["row", "row2"], "n", total[0] or 0)
    copies = materialize(known.where(F.col("id") > F.col("first")).select(group, "id", "row").distinct(), "copies")

    # the texts are shuffled once; the same exchange serves all three uses below
    texts = long_rows.select(group, "id", "row", "text").groupBy("group")
    copies = copies.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (
        ("bucket", "int"), ("spans", "binary"), ("size", "int"), ("anchors", "binary"), ("split", "binary"))])
    asked = lambda told: texts.cogroup(told.unionByName(copies.select(told.columns)).groupBy("group"))
    told = lambda df, *names: df.select("group", *names, F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("row"))
    packed = texts.cogroup(copies.groupBy("group")).applyInArrow(
        lambda x, y: group_anchors(x, y, buckets, length, gram), ANCHORS)
    anchors = told_anchors(packed, buckets, split_runs)
    sent = asked(told(anchors, "anchors", "split")).applyInArrow(
        lambda x, y: group_runs(x, y, 4 * buckets, length, gram), REQUEST)
    answers = sent.groupBy("bucket").applyInArrow(lambda found: bucket_answers(found, length), ANSWER)
    out = asked(told(answers, "bucket", "spans", "size", "anchors", "split")).applyInArrow(
        lambda x, y: group_texts(x, y, 4 * buckets, length, gram), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    rest = rows.where(~in_question).select("id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
                                           F.col("text").alias("kept"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
