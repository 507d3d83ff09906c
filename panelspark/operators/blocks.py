"""Block-sparse document-term matrix.

The matrix (documents x terms) is cut into blocks of ``rows`` documents by ``cols`` terms. A block
is one row (row_block, col_block, rows, starts, cols, vals): the block's non-empty rows in
order, where the entries of each begin (one more start closes the last), and the columns and
values of all entries, row after row. Numbers in a block count from its corner.

A block holds at most ``rows * cols`` entries, whatever a document or a term holds in all: a long
document is cut over column blocks and a frequent term over row blocks, so no task gathers
either whole. Entries are exchanged once: parts of rows of blocks (``PART_CELLS`` cells at most) are dealt over
``BUCKETS`` by a hash, a task sorts stretches of entries and sends those of a bucket as one compressed value, and
blocks are made bucket by bucket as numpy vectors.

Products gather the entries of a stretch of blocks by block of the axis that a dense operand runs along,
again as one compressed value each, and add up per batch before results are exchanged. A dense operand
is one array for each block of that axis. Arrays that more than a ``HEAVY``-th of all
blocks meet (the frequent terms) are fewer than ``HEAVY`` and are broadcast; the others are joined
by shuffle, and none meets many blocks.

Words are counted in stretches as well (:func:`packed_counts`): a word is sent once a stretch to get its
number, not once a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 1000
#: Bounds of what a task holds: cells of a part of a row of blocks, shares of all entries, entries of a stretch when
#: blocks are made and when they are multiplied, tokens of a stretch and bytes of its words.
PART_CELLS = 1 << 22
BUCKETS = 1 << 13
ENTRIES = 300_000
FACTORS = 500_000
TOKENS = 1_500_000
TOKEN_BYTES = 48 << 20


@dataclass(frozen=True)
class BlockShape:
    rows: int = 256
    cols: int = 4096

    def __post_init__(self):
        if self.rows < 1 or self.cols < 1:
            raise ValueError("a block has at least one row and one column")


def _tidy(run: Callable) -> Callable:
    """``run`` over batches, after which freed memory goes back to the system: Python workers stay for later stages, as
    many as a task has steps in Python, and would hold what their largest stretch took."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return tidied


def squeezed(*columns: np.ndarray) -> bytes:
    """Vectors of as many 64-bit numbers as one compressed value: bytes of the same weight lie together."""
    columns = [np.ascontiguousarray(x).view("<u8") for x in columns]
    widths = [max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1 for x in columns]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for x, w in zip(columns, widths)]
    return len(columns[0]).to_bytes(8, "little") + bytes(widths) + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def loosened(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The vectors of :func:`squeezed`, read as these kinds."""
    n, widths = int.from_bytes(data[:8], "little"), list(data[8:8 + len(kinds)])
    planes = pa.decompress(data[8 + len(kinds):], decompressed_size=n * sum(widths), codec="zstd", asbytes=True)
    out, at = [], 0
    for w, kind in zip(widths, kinds):
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(planes, np.uint8, n * w, at).reshape(w, n).T
        out.append(x.reshape(-1).view(kind))
        at += n * w
    return out


def _stretches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The columns of ``batches`` in stretches of about ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= size:
            whole, held, n = [np.concatenate(x) for x in zip(*held)], [], 0
            yield whole
            del whole
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _ordered(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns sorted by all but the last, whose values are added up where the others agree."""
    order = np.lexsort(columns[-2::-1])
    columns = [c[order] for c in columns]
    at = _changes(*columns[:-1])
    return [*[c[at] for c in columns[:-1]], np.add.reduceat(columns[-1], at) if len(at) else columns[-1]]


def to_blocks(entries: DataFrame, shape: BlockShape = BlockShape(), row: str = "doc_index",
              col: str = "term_index", value: str = "n") -> DataFrame:
    """Blocks of coordinate entries (0-based ``row`` and ``col``); entries of one cell are added up,
    and entries without a row, column or value are left out."""
    e = entries.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(value).isNotNull()).select(
        F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    height, cols = shape.rows, shape.cols
    cells = height * cols
    wide = max(1, PART_CELLS // cells)

    def send(batches):
        for r, c, v in _stretches(batches, ENTRIES):
            row_block, col_block = r // height, c // cols
            place = col_block * cells + (r - row_block * height) * cols + (c - col_block * cols)
            mixed = (row_block * 0x9E3779B1 + col_block // wide).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            del r, c, col_block
            bucket, row_block, place, v = _ordered((mixed >> np.uint64(32)).astype(np.int64) % BUCKETS, row_block, place, v)
            step, line = np.diff(place, prepend=0), _changes(bucket, row_block)
            step[line] = place[line]
            first = _changes(bucket)
            packed = [squeezed(np.diff(row_block[x:z], prepend=0), step[x:z], v[x:z])
                      for x, z in zip(first, [*first[1:], len(bucket)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def pack(batches):
        for packed in _gathered(batches):
            pieces = []
            for row_block, step, v in (loosened(x, np.int64, np.int64, np.float64) for x in packed):
                row_block, place = np.cumsum(row_block), np.cumsum(step)
                line = _changes(row_block)
                place -= np.repeat(place[line] - step[line], np.diff(np.append(line, len(place))))
                pieces.append((row_block, place, v))
            row_block, place, v = map(np.concatenate, zip(*pieces))
            if len(pieces) > 1:
                row_block, place, v = _ordered(row_block, place, v)
            col_block, at = place // cells, place % cells
            first = _changes(row_block, col_block)
            lines = _changes(row_block, col_block, at // cols)
            line_off = np.append(np.searchsorted(lines, first), len(lines))
            off, n = np.append(first, len(at)), len(first)
            own = np.repeat(np.arange(n), np.diff(line_off))
            starts = np.zeros(len(lines) + n, np.int32)
            starts[np.arange(len(lines)) + own] = lines - first[own]
            starts[line_off[1:] + np.arange(n)] = np.diff(off)
            lists = [(line_off, (at // cols)[lines].astype(np.int32)), (line_off + np.arange(n + 1), starts),
                     (off, (at % cols).astype(np.int32)), (off, v)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_block[first]), pa.array(col_block[first]),
                 *[pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x)) for o, x in lists]],
                ["row_block", "col_block", "rows", "starts", "cols", "vals"])

    sent = e.mapInArrow(_tidy(send), "bucket long, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(
        _tidy(pack), "row_block long, col_block long, rows array<int>, starts array<int>, cols array<int>, vals array<double>")


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """The values of every key of rows (key, value) sorted by key."""
    key, held = None, []
    for batch in batches:
        for own, value in zip(*[c.to_pylist() for c in batch.columns]):
            if own != key and held:
                yield held
                held = []
            key = own
            held.append(value)
    if held:
        yield held


def packed_counts(tokens: DataFrame, doc: str = "doc_id", term: str = "word") -> DataFrame:
    """(stretch, docs, terms, cells): rows (doc, term) counted in stretches of tasks. ``docs`` and ``terms`` are the
    different documents and terms of a stretch in ascending order (a missing document first), ``cells`` its counts. Terms of
    a missing document are listed, not counted. A document that lies in several stretches has a count in each."""
    kind = tokens.schema[doc].dataType.simpleString()

    def run(batches):
        held, n, size, stretch = [], 0, 0, TaskContext.get().partitionId() << 32

        def flush():
            docs, terms = (pa.chunked_array(x).combine_chunks().dictionary_encode() for x in zip(*held))
            names = terms.dictionary.cast(pa.binary())
            places, ranks = [], []
            for values in (docs.dictionary, names):
                order = pc.sort_indices(values).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                places.append(pa.array(order))
                ranks.append(rank)
            known = docs.indices.is_valid().to_numpy(zero_copy_only=False)
            d, t = (x.indices.drop_null() if x is docs else x.indices.filter(pa.array(known)) for x in (docs, terms))
            cells, count = np.unique(ranks[0][d.to_numpy()] * len(names) + ranks[1][t.to_numpy()], return_counts=True)
            listed = docs.dictionary.take(places[0])
            if not known.all():
                listed = pa.concat_arrays([pa.nulls(1, listed.type), listed])
            return pa.RecordBatch.from_arrays(
                [pa.array([stretch]), pa.array([listed.to_pylist()], pa.list_(listed.type)),
                 pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), terms.dictionary.take(places[1])),
                 pa.array([squeezed(np.diff(cells, prepend=0), count.astype(np.int64))], pa.binary())],
                ["stretch", "docs", "terms", "cells"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.columns)
            n, size = n + batch.num_rows, size + batch.column(1).nbytes
            if n >= TOKENS or size >= TOKEN_BYTES:
                yield flush()
                held, n, size, stretch = [], 0, 0, stretch + 1
        if held:
            yield flush()

    return tokens.select(doc, term).mapInArrow(_tidy(run), f"stretch long, docs array<{kind}>, terms array<string>, cells binary")


def counted_entries(counts: DataFrame, docs: DataFrame, terms: DataFrame, doc: str = "doc_id", term: str = "word",
                    row: str = "doc_index", col: str = "term_index", value: str = "n") -> DataFrame:
    """Coordinate entries of written :func:`packed_counts`, by tables of the numbers of documents and terms. Numbers
    rise as documents and terms do, so a stretch needs to be told them in order only."""

    def told(names: str, name: str, numbers: DataFrame, number: str) -> DataFrame:
        asked = counts.select("stretch", F.explode(names).alias(name))
        return asked.join(numbers.hint("shuffle_hash"), name).groupBy("stretch").agg(F.sort_array(F.collect_list(number)).alias(names))

    def run(batches):
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            for i, (d, t) in enumerate(zip(batch.column("docs"), batch.column("terms"))):
                at, n = loosened(cells[i], np.int64, np.int64)
                d, t = d.values.to_numpy(), t.values.to_numpy()
                d_of, t_of = np.divmod(np.cumsum(at), len(t))
                for x in range(0, len(n), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d[d_of[x:x + 100_000]]), pa.array(t[t_of[x:x + 100_000]]), pa.array(n[x:x + 100_000])], [row, col, value])

    j = counts.select("stretch", "cells").join(told("docs", doc, docs, row), "stretch").join(told("terms", term, terms, col), "stretch")
    return j.select("cells", "docs", "terms").mapInArrow(_tidy(run), f"{row} long, {col} long, {value} long")


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted column of keys changes, its beginning included."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted ``batches`` anew, in stretches that cut no group of the first ``keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        last = _changes(*cols[:keys])[-1]
        if last:
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
    if held is not None:
        yield held


def from_blocks(blocks: DataFrame, shape: BlockShape = BlockShape(), row: str = "doc_index",
                col: str = "term_index", value: str = "n") -> DataFrame:
    """Coordinate entries of a matrix of blocks."""
    lines = F.transform("rows", lambda r, i: F.struct(r.alias("r"), _cut("cols", i).alias("c"), _cut("vals", i).alias("v")))
    out = blocks.select("row_block", "col_block", F.inline(lines)).select(
        "row_block", "col_block", "r", F.inline(F.arrays_zip("c", "v")))
    return out.select((F.col("row_block") * shape.rows + F.col("r")).alias(row),
                      (F.col("col_block") * shape.cols + F.col("c")).alias(col), F.col("v").alias(value))


def _cut(name: str, i: Column) -> Column:
    """The entries of a block's ``i``-th non-empty row."""
    start = F.get("starts", i)
    return F.slice(name, start + 1, F.get("starts", i + 1) - start)


def block_stats(blocks: DataFrame) -> DataFrame:
    """(row_block, col_block, n_rows, nnz, total) of every block."""
    return blocks.select("row_block", "col_block", F.size("rows").cast("bigint").alias("n_rows"),
                         F.size("vals").cast("bigint").alias("nnz"),
                         F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("total"))


def row_sums(blocks: DataFrame, shape: BlockShape = BlockShape(), out: str = "total", row: str = "doc_index") -> DataFrame:
    """(row, out): sum of every non-empty row."""
    own = F.transform("rows", lambda r, i: F.struct(r.alias("r"), F.aggregate(
        _cut("vals", i), F.lit(0.0), lambda a, v: a + v).alias("v")))
    lines = blocks.select("row_block", F.inline(own))
    return lines.groupBy((F.col("row_block") * shape.rows + F.col("r")).alias(row)).agg(F.sum("v").alias(out))


def col_sums(blocks: DataFrame, shape: BlockShape = BlockShape(), out: str = "total", col: str = "term_index") -> DataFrame:
    """(col, out): sum of every non-empty column."""
    cells = blocks.select("col_block", F.inline(F.arrays_zip("cols", "vals")))
    return cells.groupBy((F.col("col_block") * shape.cols + F.col("cols")).alias(col)).agg(F.sum("vals").alias(out))


def dense_blocks(vector: DataFrame, index: str, weights: str, width: int, k: int) -> DataFrame:
    """(block, w): rows (index, weights array of ``k``) as one array of ``width * k`` weights, index by index, for each
    block of the axis; an index or weight that is not there is zero. Each index occurs once."""
    part = [F.coalesce(F.get(weights, F.lit(q)).cast("double"), F.lit(0.0)).alias(f"w{q}") for q in range(k)]
    v = vector.where(F.col(index).isNotNull()).select(
        F.floor(F.col(index) / width).alias("block"), F.pmod(F.col(index), F.lit(width)).cast("int").alias("i"), *part)

    def fill(batches):
        for block, i, *w in _whole_groups(batches, 1):
            if len(_changes(block, i)) < len(i):
                raise ValueError("an index of a dense operand occurs twice")
            first = _changes(block)
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i)))) * width + i
            out = np.zeros((len(first) * width, k))
            out[place] = np.stack(w, axis=1)
            off = np.arange(len(first) + 1, dtype=np.int32) * (width * k)
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.ListArray.from_arrays(
                pa.array(off), pa.array(out.reshape(-1)))], ["block", "w"])

    return v.repartition("block").sortWithinPartitions("block", "i").mapInArrow(_tidy(fill), "block long, w array<double>")


def _product(blocks: DataFrame, dense: DataFrame, axis: str, k: int, shape: BlockShape, name: str, out: str) -> DataFrame:
    """(name, out array of ``k``): sums over the entries of ``blocks`` times the weights of their place on ``axis``, by
    their index on the other one. Blocks are read three times, so they should be a written table."""
    count = blocks.groupBy(axis).agg(F.count(F.lit(1)).alias("_n"))
    least = blocks.count() // HEAVY
    heavy = count.where(F.col("_n") > least).select(F.col(axis).alias("block"))
    by_col = axis == "col_block"
    width = shape.cols if by_col else shape.rows

    def send(batches):
        for block, cell, v in _stretches((_coordinates(b, shape, by_col) for b in batches), FACTORS):
            block, cell, v = _ordered(block, cell, v)
            first = _changes(block)
            packed = [squeezed(np.diff(cell[x:z], prepend=0), v[x:z]) for x, z in zip(first, [*first[1:], len(block)])]
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(packed, pa.binary())], ["block", "packed"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (w_off, w), = _lists(batch, "w")
            parts = [loosened(x, np.int64, np.float64) for x in batch.column("packed").to_pylist()]
            size = [len(v) for _, v in parts]
            i, place = np.divmod(np.concatenate([np.cumsum(cell) for cell, _ in parts]), width)
            at = place * k + np.repeat(w_off[:-1], size)
            v = np.concatenate([v for _, v in parts])
            order = np.argsort(i, kind="stable")
            i, at, v = i[order], at[order], v[order]
            first = _changes(i)
            yield pa.RecordBatch.from_arrays([pa.array(i[first]), *[pa.array(np.add.reduceat(v * w[at + q], first))
                                                                    for q in range(k)]], ["i", *[f"y{q}" for q in range(k)]])

    dealt = blocks.withColumn("block", F.col(axis))
    sent = lambda how: dealt.join(F.broadcast(heavy), "block", how).select(
        "row_block", "col_block", "rows", "starts", "cols", "vals").mapInArrow(_tidy(send), "block long, packed binary")
    some = dense.join(F.broadcast(heavy), "block", "left_semi")
    j = sent("left_semi").join(F.broadcast(some), "block").unionByName(sent("left_anti").join(dense, "block"))
    return _added(j.select("packed", "w").mapInArrow(_tidy(run), _parts(k)), name, k, out)


def _lists(batch: pa.RecordBatch, *names: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offsets, values) of list columns."""
    of = [batch.column(name) for name in names]
    return [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in of]


def _coordinates(batch: pa.RecordBatch, shape: BlockShape, by_col: bool) -> pa.RecordBatch:
    """Of all entries of a batch of blocks: the block of one axis, the index on the other one and the place in the block as
    one number, and the value, as (block, cell, v)."""
    (row_off, rows), (start_off, starts), (off, cols), (_, vals) = _lists(batch, "rows", "starts", "cols", "vals")
    own = np.repeat(np.arange(batch.num_rows), np.diff(row_off))
    first = starts[start_off[0] + np.arange(len(own)) + own] + off[own] - off[0]
    rows, cols, vals = rows[row_off[0]:row_off[-1]], cols[off[0]:off[-1]], vals[off[0]:off[-1]]
    line = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(vals))))
    row_block, col_block = (batch.column(c).to_numpy()[own] for c in ("row_block", "col_block"))
    if by_col:
        block, cell = col_block[line], ((row_block * shape.rows + rows) * shape.cols)[line] + cols
    else:
        block, cell = row_block[line], (col_block[line] * shape.cols + cols) * shape.rows + rows[line]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (block, cell, vals)], ["block", "cell", "v"])


def _added(parts: DataFrame, name: str, k: int, out: str) -> DataFrame:
    """``k`` sums of the columns ``y`` of every index."""
    sums = parts.groupBy(F.col("i").alias(name)).agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(k)])
    return sums.select(name, F.array(*[f"y{j}" for j in range(k)]).alias(out))


def _parts(k: int) -> str:
    return "i long, " + ", ".join(f"y{j} double" for j in range(k))


def multiply(blocks: DataFrame, vectors: DataFrame, k: int, shape: BlockShape = BlockShape(), index: str = "term_index",
             weights: str = "w", out: str = "y", row: str = "doc_index") -> DataFrame:
    """(row, out array of ``k``): the matrix times ``k`` dense columns, given as rows (index, array of ``k``).

    Rows whose terms have no weight at all, and empty rows, are not in the result where no block meets
    a weight; all others are, zeros included.
    """
    return _product(blocks, dense_blocks(vectors, index, weights, shape.cols, k), "col_block", k, shape, row, out)


def multiply_transposed(blocks: DataFrame, vectors: DataFrame, k: int, shape: BlockShape = BlockShape(),
                        index: str = "doc_index", weights: str = "w", out: str = "y", col: str = "term_index") -> DataFrame:
    """(col, out array of ``k``): the transposed matrix times ``k`` dense columns over the documents."""
    return _product(blocks, dense_blocks(vectors, index, weights, shape.rows, k), "row_block", k, shape, col, out)
