"""Token-ID output: documents as token ids in compressed, checksummed binary segments.

Documents are dealt to tasks by ranges of their id and sorted. A task tokenises them and packs
their ids, an end id after each document, into segments of about ``SEGMENT_IDS`` ids; a segment
holds whole documents and is coded by :mod:`rangecoder`. Segments are the rows of a Parquet
dataset (part, segment, n_ids, doc_ids, sizes, data), so Spark's writer commits them: a lost
executor's task runs again and leaves no half-written file. A document's place is the number of
ids in all earlier segments, a prefix sum over parts and over the segments of a part.

The tokenizer is read on the driver and sent to the tasks. Its words are remembered by a Python
worker from task to task, within a bound: texts are cut at ASCII white space, which no token of
this kind crosses, and words of letters at their closing marks, so that a distinct word is
encoded once while it is remembered.

Defined results: a missing or empty text is the end id alone; documents without an id come
first; documents that share an id follow each other in the order of their texts' hashes; rows
that repeat are written as often; an empty table gives no segment; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import rangecoder
from panelspark.llm.common import bounded_batches, pieces

#: Ids of a segment; the last one of a task has up to twice as many, so that none but that of a small task is short.
SEGMENT_IDS = 1 << 21
#: Bytes of text that are split into words at once.
STRETCH_BYTES = 6 << 20
#: Marks that close a word. No token of letters holds one, and none of them begins a clitic or a special token.
MARKS = ".,;:!?#$%&*+-/=@\\^_`~()[]{}\""
#: A letter that normalisation leaves alone, and the marks that close its word.
CLOSED = r"[a-z\x{df}-\x{f6}\x{f8}-\x{ff}][" + re.escape(MARKS) + "]+$"
#: Words that are remembered.
CACHE_WORDS = 300_000
#: Words that are encoded together, and words that the tokenizer holds results of at once.
JOINED, APART = 20_000, 2000


def copied(source: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``source`` one after the other."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    place = np.repeat((start - (stop - size)).astype(kind), size)
    place += np.arange(total, dtype=kind)
    return source.take(place)


class Words:
    """Token ids of whole texts, each distinct word encoded once while it is remembered.

    A word of letters is encoded apart from the marks that close it. Words of letters only are
    encoded together, joined by blanks, and told apart by the tokens that end a word; should their
    number differ from that of the words, and for words of any other kind, every word is encoded
    on its own. At most ``CACHE_WORDS`` words and those of one stretch are remembered; then those
    that no later stretch asked for are forgotten.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.again = np.zeros(0, bool)
        self.ids, self.stops = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def trim(self) -> None:
        """Forget the words that were asked for by one stretch only, or all if these are few."""
        keep = self.again
        if 2 * np.count_nonzero(keep) > CACHE_WORDS:
            return self.clear()
        start, size = self.stops[:-1][keep], np.diff(self.stops)[keep]
        self.known, self.again = self.known.filter(pa.array(keep)), np.zeros(len(size), bool)
        self.ids, self.stops = copied(self.ids, start, size), np.append(0, np.cumsum(size))

    def joined(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of every word) of stretches of words of letters."""
        text = [" ".join(words)] if len(words) > 1 else words
        ids = np.array(self.tokenizer.encode_batch_fast(text, add_special_tokens=False)[0].ids, np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(words) == 1:
            return [(ids, np.array([len(ids)]))]
        if len(stops) == len(words) and stops[-1] == len(ids):
            return [(ids, np.diff(stops, prepend=0))]
        half = len(words) // 2
        return self.joined(words[:half]) + self.joined(words[half:])

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of every word)."""
        plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        found = []
        some = words.filter(pa.array(plain)).to_pylist()
        for at in range(0, len(some), JOINED):
            found += self.joined(some[at:at + JOINED])
        some = words.filter(pa.array(~plain)).to_pylist()
        for at in range(0, len(some), APART):  # a result takes a kilobyte or more
            codes = [x.ids for x in self.tokenizer.encode_batch_fast(some[at:at + APART], add_special_tokens=False)]
            found.append((np.fromiter(chain.from_iterable(codes), np.int32), np.array([len(x) for x in codes])))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, size = map(np.concatenate, zip(*found))
        # back into the order of the words
        place = np.argsort(np.append(np.flatnonzero(plain), np.flatnonzero(~plain)))
        return copied(ids, (np.cumsum(size) - size)[place], size[place]), size[place]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of ``words`` among those remembered; new ones are encoded."""
        coded = words.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known).to_numpy(zero_copy_only=False)
        new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        place = np.where(new, 0, place).astype(np.int64)
        self.again[place[~new]] = True
        place[new] = len(self.known) + np.arange(np.count_nonzero(new))
        fresh = coded.dictionary.filter(pa.array(new))
        ids, size = self.codes(fresh)
        self.known = pa.concat_arrays([self.known, fresh])
        self.again = np.append(self.again, np.zeros(len(fresh), bool))
        self.stops = np.append(self.stops, len(self.ids) + np.cumsum(size))
        self.ids = np.append(self.ids, ids)
        return place[coded.indices.to_numpy()]

    def encode(self, texts: list[bytes] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with an end id after each, ids of every text)."""
        if len(self.known) > CACHE_WORDS:
            self.trim()
        text = pc.fill_null(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts, b"").cast(pa.string())
        # special tokens are told from others by their case
        text = pc.if_else(pc.match_substring(text, "<|"), text, pc.ascii_lower(text))
        lists = pc.ascii_split_whitespace(text)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        stem = pc.utf8_rtrim(distinct, MARKS)
        closed = pc.and_(pc.match_substring_regex(distinct, CLOSED), pc.utf8_is_alpha(stem))
        stem, cut = pc.if_else(closed, stem, distinct), np.flatnonzero(closed.to_numpy(zero_copy_only=False))
        size = pc.utf8_length(stem).to_numpy()[cut].tolist()
        marks = [w[n:] for w, n in zip(distinct.take(pa.array(cut)).to_pylist(), size)]
        place = self.numbers(pa.concat_arrays([stem, pa.array(marks, pa.string())]))
        # the ids of every distinct word: those of its letters, then those of its marks; at last the end id
        n = len(distinct)
        start, size = np.zeros((n + 1, 2), np.int64), np.zeros((n + 1, 2), np.int64)
        sizes = np.diff(self.stops)
        start[:n, 0], size[:n, 0] = self.stops[place[:n]], sizes[place[:n]]
        start[cut, 1], size[cut, 1] = self.stops[place[n:]], sizes[place[n:]]
        start[n, 0], size[n, 0] = len(self.ids), 1
        table = copied(np.append(self.ids, np.int32(end)), start.reshape(-1), size.reshape(-1))
        size = size.sum(axis=1)
        # every word's ids are copied from where they are, and the end id after the last word of a text
        last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        word = np.insert(coded.indices.to_numpy().astype(np.int64), last, n)
        out = copied(table, (np.cumsum(size) - size)[word], size[word])
        return out, np.diff(np.cumsum(size[word])[last + np.arange(len(last))], prepend=0)


@lru_cache(maxsize=1)
def words_of(tokenizer: str) -> Words:
    """The words of a tokenizer, remembered by a Python worker for all tasks that it runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(Tokenizer.from_str(tokenizer))


def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in stretches of about ``STRETCH_BYTES`` of text."""
    held, size = [], 0
    for piece in pieces(batches):
        held.append(piece)
        size += (pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0) + 16 * piece.num_rows
        if size >= STRETCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1) -> None:
    """Write the ids of every text of ``docs`` to ``path`` in ascending order of the document's id."""
    bounded_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    tie = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), tie.alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        words = words_of(shared.value)
        vocabulary = max(len(words.ends), end_id + 1)
        part, segment = TaskContext.get().partitionId(), 0
        ids, sizes, names = np.zeros(0, np.int32), np.zeros(0, np.int64), pa.nulls(0)

        def pack(docs: int, total: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([total], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), names.slice(0, docs)),
                 pa.array([sizes[:docs]], pa.list_(pa.int64())),
                 pa.array([rangecoder.encode(ids[:total], vocabulary)], pa.binary())],
                ["part", "segment", "n_ids", "doc_ids", "sizes", "data"])

        for batch in stretches(batches):
            found, n = words.encode(batch.column("text"), end_id)
            ids, sizes = np.append(ids, found), np.append(sizes, n)
            names = pa.concat_arrays([names, batch.column("id")]) if len(names) else batch.column("id")
            while len(ids) >= 2 * SEGMENT_IDS:  # a segment ends with the document that fills it
                after = np.cumsum(sizes)
                docs = int(np.searchsorted(after, SEGMENT_IDS)) + 1
                yield pack(docs, int(after[docs - 1]))
                ids, sizes, names, segment = ids[after[docs - 1]:], sizes[docs:], names.slice(docs), segment + 1
        if len(sizes):
            yield pack(len(sizes), len(ids))

    rows.mapInArrow(run, f"part int, segment int, n_ids long, doc_ids array<{kind}>, sizes array<long>, data binary"
                    ).write.mode("overwrite").parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, segment, start): ids before each segment."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    return segments.select("part", "segment", inside.alias("at")).join(parts, "part").select(
        "part", "segment", (F.col("base") + F.col("at")).cast("long").alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids as little-endian 32-bit words) of every document of a dataset."""
    return _read(spark, path, "ids", "binary", lambda x: x.astype("<u4").tobytes())


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): as :func:`read_tokens`, with the checksum of the ids in place of them."""
    return _read(spark, path, "ids_crc32", "long", lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, name: str, kind: str, value) -> DataFrame:
    segments = spark.read.parquet(path)
    starts = segment_starts(segments.select("part", "segment", "n_ids"))
    rows = segments.select("part", "segment", "doc_ids", "sizes", "data")
    id_kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = rangecoder.decode(one.column("data")[0].as_py())
                doc_ids = one.column("doc_ids").flatten()
                sizes = one.column("sizes").flatten().to_numpy()
                stops = np.cumsum(sizes)
                if len(ids) != (stops[-1] if len(stops) else 0):
                    raise ValueError("a segment's ids and its documents differ")
                out = [value(ids[a:z]) for a, z in zip(stops - sizes, stops)]
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.column("part")[0].as_py()] * n, pa.int32()),
                     pa.array([one.column("segment")[0].as_py()] * n, pa.int32()), doc_ids,
                     pa.array(stops - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(out, pa.binary() if kind == "binary" else pa.int64())],
                    ["part", "segment", "id", "at", "n_tokens", name])

    found = rows.mapInArrow(run, f"part int, segment int, id {id_kind}, at long, n_tokens long, {name} {kind}")
    return found.join(starts, ["part", "segment"]).select(
        "id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", name)
