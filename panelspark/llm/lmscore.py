"""LM scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training documents are gathered from the whole corpus. A
count c is quantised to the level 1 + floor(log2 c), and the n-gram is put into a Bloom
filter once for every level up to its own; a probe goes up the levels until one is missing,
so an error can only raise a count. The filter is cut into blocks by hash; a block is filled
by the task that has summed its counts. Scoring tasks get the blocks by broadcast.

    p1(w)        = (c(w) + 1) / (N + V + 1)
    p(w | prev)  = (c(prev, w) + k p1(w)) / (c(prev) + k),   k = 1 + r c(prev)

with r the share of distinct pairs among all pairs. A document is its lower-cased words and
one end mark; the end mark also stands before the first word.

Sizes that reach the driver or every task have stated bounds. The exact counts of the base
score are taken from the ``head_words`` most frequent words by broadcast, all others by a
join, where no key is frequent. Filters of more than ``max_filter_bytes`` are broadcast in
parts, one pass over the documents for each; the levels found are then put together by
document.

Defined results: a missing text is empty, which is one end mark; rows without an id are
training rows; rows that repeat count and are scored one by one; without training rows all
counts are 0; an empty table gives an empty result; other columns are not read. Words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from panelspark.llm.common import CACHE_WORDS, WordHashes, bounded_batches, mix64, pieces, texts_of
from panelspark.session import materialize

END = b" "  # no word is blank
PAIR = np.uint64(0x9E3779B97F4A7C15)
LEVEL_STEPS = np.arange(66, dtype=np.uint64) * PAIR
TEXT_BYTES_PER_BLOCK = 32 << 20
FLUSH_TOKENS = 4_000_000
PROBES = 5
OTHERS = ArrayType(StructType([StructField("h", LongType()), StructField("n", LongType())]))
BITS_PER_ENTRY = 9


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7 (never without an id)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def tokens_of(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch and the tokens per text, end marks included."""
    flat, sizes = [], []
    for t in texts:
        words = t.lower().split()
        flat += words
        flat.append(END)
        sizes.append(len(words) + 1)
    return known.of(flat), np.array(sizes, np.int64)


def pairs_of(tokens: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """Hash of every token with the one before it (an end mark before the first)."""
    before = np.concatenate([np.array([end], np.uint64), tokens[:-1]])
    return mix64(before * PAIR + mix64(tokens))


def levels(counts: np.ndarray) -> np.ndarray:
    return (np.frexp(counts.astype(np.float64))[1]).astype(np.uint8)


def level_counts() -> np.ndarray:
    """Count that a level stands for: the middle of its range, level 0 is a count of 0."""
    j = np.arange(65, dtype=np.float64)
    return np.where(j == 0, 0, (np.exp2(j - 1) + np.exp2(j) - 1) / 2)


def summed(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([*parts, np.zeros(0, np.uint64)])
    n = np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def count_ngrams(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, size, keys, counts): n-grams of a stretch of a task's documents, packed by block."""

    def run(batches):
        known = WordHashes()
        end = known[END]
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        waiting = 0

        def flush():
            out = {"block": [], "size": [], "keys": [], "counts": []}
            for size, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                edges = np.searchsorted(block_of(keys, blocks), np.arange(blocks + 1))
                for b in range(blocks):
                    a, z = edges[b], edges[b + 1]
                    if a < z:
                        out["block"].append(b)
                        out["size"].append(size)
                        out["keys"].append(keys[a:z].tobytes())
                        out["counts"].append(n[a:z].astype(np.uint32).tobytes())
                parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(out["block"], pa.int32()), pa.array(out["size"], pa.int32()),
                 pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], list(out))

        for batch in pieces(batches):
            tokens, _ = tokens_of(texts_of(batch), known)
            held[1].append(tokens)
            held[2].append(pairs_of(tokens, end))
            waiting += len(tokens)
            if waiting >= FLUSH_TOKENS:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()

    return texts.mapInArrow(run, "block int, size int, keys binary, counts binary")


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of every key; blocks ascend with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def probe_bit(base: np.ndarray, i: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit number of probe ``i`` of entries with hash ``base`` in blocks of ``bits`` bits."""
    step = (base >> np.uint64(32)) | np.uint64(1)
    low = (base + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)
    return (low * np.asarray(bits).astype(np.uint64)) >> np.uint64(32)


def block_filter(table: pa.Table) -> pa.Table:
    """The filter of a block's n-grams and the exact counts of its words, from their packed parts."""
    size = np.array(table.column("size").to_pylist())
    blobs = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64))
             for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    exact = {s: summed(*map(list, zip(*[b for b, x in zip(blobs, size) if x == s]))) if (size == s).any()
             else summed([], []) for s in (1, 2)}
    keys = np.concatenate([exact[1][0], exact[2][0]])
    level = levels(np.concatenate([exact[1][1], exact[2][1]]))
    bits = max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 64) * 64)
    table_bits = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        base = mix64(keys[level >= j] + LEVEL_STEPS[j])
        for i in range(PROBES):
            table_bits[probe_bit(base, i, bits)] = True
    return pa.table({
        "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
        "bits": pa.array([np.packbits(table_bits).tobytes()], pa.binary()),
        "words": pa.array([exact[1][0].tobytes()], pa.binary()),
        "counts": pa.array([exact[1][1].tobytes()], pa.binary()),
        "tokens": pa.array([int(exact[1][1].sum())], pa.int64()),
        "types": pa.array([len(exact[1][0])], pa.int64()),
        "pair_types": pa.array([len(exact[2][0])], pa.int64())})


def fill_blocks(ngrams: DataFrame) -> DataFrame:
    """(block, bits, words, counts, tokens, types, pair_types) of every block."""
    return ngrams.groupBy("block").applyInArrow(
        block_filter, "block int, bits binary, words binary, counts binary, tokens long, types long, pair_types long")


def word_counts(blocks: DataFrame) -> DataFrame:
    """(h, c): exact count of every word."""

    def run(batches):
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["h", "c"])

    return blocks.select("words", "counts").mapInArrow(run, "h long, c long")


class Filter:
    """Some blocks of the filter, as one array; n-grams of other blocks have level 0."""

    def __init__(self, blocks: int, rows: list[tuple[int, bytes]]):
        self.blocks = blocks
        self.bits, self.start = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
        at = 0
        for b, data in rows:
            self.bits[b], self.start[b] = 8 * len(data), at
            at += 8 * len(data)
        self.data = np.frombuffer(b"".join(d for _, d in rows) or b"\0", np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        block = block_of(keys, self.blocks).astype(np.int64)
        left = np.flatnonzero(self.bits[block] > 0)
        level = 0
        while len(left):
            level += 1
            size, start, own = self.bits[block[left]], self.start[block[left]], keys[left]
            base = mix64(own + LEVEL_STEPS[level])
            for i in range(PROBES):
                at = probe_bit(base, i, size).astype(np.int64) + start
                hit = (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                left, size, start, base = left[hit], size[hit], start[hit], base[hit]
            out[left] = level
        return out


def score_levels(words: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, end_level: int, model: dict) -> np.ndarray:
    """log10 probability of every text from the levels of its tokens and pairs."""
    value = level_counts()
    c1, c2 = value[words], value[pairs]
    before = np.concatenate([[value[end_level]], c1[:-1]]) if len(c1) else c1
    p1 = (c1 + 1) / (model["tokens"] + model["types"] + 1)
    k = 1 + model["new_pairs"] * before
    p = (np.minimum(c2, before) + k * p1) / (before + k)
    return np.add.reduceat(np.log10(p), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def learn(texts: DataFrame) -> tuple[DataFrame, dict]:
    """Blocks of the filter (written to the shared folder) and the model's totals."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // TEXT_BYTES_PER_BLOCK))
    table = materialize(fill_blocks(count_ngrams(texts.select("text"), blocks)), "blocks")
    got = table.agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "pair_types")],
                    F.sum(F.octet_length("bits")).alias("bytes")).first()
    model = {k: got[k] or 0 for k in ("tokens", "types", "pair_types", "bytes")}
    return table, model | {"blocks": blocks, "new_pairs": model["pair_types"] / max(1, model["tokens"])}


def filter_parts(table: DataFrame, model: dict, max_filter_bytes: int) -> list:
    """The filter as broadcasts of at most ``max_filter_bytes`` (one block at least)."""
    parts, room = [[]], 0
    for b, size in sorted(table.select("block", F.octet_length("bits")).collect()):
        if parts[-1] and room + size > max_filter_bytes:
            parts.append([])
            room = 0
        parts[-1].append(b)
        room += size
    spark = table.sparkSession
    out = []
    for own in parts:
        some = table.where(F.col("block").between(own[0], own[-1])) if own else table.limit(0)
        rows = [(r.block, bytes(r.bits)) for r in some.select("block", "bits").toLocalIterator()]  # a file at a time
        out.append(spark.sparkContext.broadcast(Filter(model["blocks"], sorted(rows))))
    return out


def head_counts(counts: DataFrame, head_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the most frequent words."""
    table = counts.orderBy(F.desc("c"), "h").limit(head_words).toArrow()
    h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], table.column("c").to_numpy()[order]


class KnownWords:
    """Numbers for the words of one task, with what the model says of each."""

    def __init__(self, head: tuple[np.ndarray, np.ndarray], held: Filter | None):
        self.head, self.filter = head, held
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.count, self.level = array("Q"), array("q"), array("B")
        self.learn([END])

    def learn(self, words: list[bytes]) -> None:
        at = len(self.number)
        self.number.update(zip(words, range(at, at + len(words))))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        keys, counts = self.head
        c = np.zeros(len(h), np.int64)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            c = np.where(keys[place] == h, counts[place], 0)
        self.hash.frombytes(h.tobytes())
        self.count.frombytes(c.tobytes())
        self.level.frombytes((self.filter.levels(h) if self.filter else np.zeros(len(h), np.uint8)).tobytes())

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of some texts and the tokens per text."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        flat, sizes = [], []
        for t in texts:
            words = t.lower().split()
            flat += words
            flat.append(END)
            sizes.append(len(words) + 1)
        self.learn([w for w in set(flat) if w not in self.number])
        return np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.array(sizes, np.int64)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, exact count (0 outside the head) and level of every number."""
        return np.array(self.hash, np.uint64), np.array(self.count, np.int64), np.array(self.level, np.uint8)


def base_part(number: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, model: dict):
    """Per text: known head tokens, base score without its other words; those words with their numbers."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    c = counts[number]
    base = np.bincount(owner, np.log10(counts + 1.0)[number], len(sizes)) - sizes * math.log10(
        model["tokens"] + model["types"] + 1)
    n_known = np.bincount(owner, c > 0, len(sizes)).astype(np.int64)
    rest = np.flatnonzero(c == 0)
    pair, n = np.unique(owner[rest] * len(words) + number[rest], return_counts=True)
    cut = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(words)).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(
        [pa.array(words[pair % len(words)].view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"]))
    return n_known, base, others


def score_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head_words: int = 1 << 18,
                 max_filter_bytes: int = 256 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                       held_out(F.col(id_col)).alias("held_out"))
    table, model = learn(rows.where(~F.col("held_out")).select("text"))
    counts = word_counts(table)
    head = head_counts(counts, head_words)
    shared = spark.sparkContext.broadcast((head, model))
    parts = filter_parts(table, model, max_filter_bytes)
    whole = len(parts) == 1
    if not whole:  # the passes are put together by row, so rows get a number that stays
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    names = [c for c in rows.columns if c != "text"]
    kept = rows.drop("text").schema

    def score(part):
        def run(batches):
            head, model = shared.value
            held = part.value if part else None
            known = KnownWords(head, held)
            for batch in pieces(batches):
                number, sizes = known.of(texts_of(batch))
                words, counts, level = known.columns()
                n_known, base, others = base_part(number, sizes, words, counts, model)
                scores = np.zeros(len(sizes))
                if held:
                    pairs = held.levels(pairs_of(words[number], words[0]))
                    scores = score_levels(level[number], pairs, sizes, level[0], model)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(sizes), pa.array(n_known), pa.array(base),
                     others, pa.array(scores)], [*names, "n_tokens", "n_known", "base", "others", "score"])
        return run

    def level_rows(part):
        def run(batches):
            known = KnownWords(shared.value[0], part.value)
            for batch in pieces(batches):
                number, sizes = known.of(texts_of(batch))
                words, _, level = known.columns()
                at = np.concatenate([[0], np.cumsum(sizes)])
                cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), cut(level[number]),
                     cut(part.value.levels(pairs_of(words[number], words[0]))),
                     pa.array(np.full(len(sizes), level[0], np.int32))], ["row", "words", "pairs", "end"])
        return run

    def put_together(found: pa.Table) -> pa.Table:
        most = lambda c: np.max([np.frombuffer(x, np.uint8) for x in found.column(c).to_pylist()], axis=0)
        words, pairs = most("words"), most("pairs")
        end = max(found.column("end").to_pylist())
        got = score_levels(words, pairs, np.array([len(words)]), end, shared.value[1])
        return pa.table({"row": found.column("row")[:1], "score": pa.array(got)})

    out = kept.add("n_tokens", "long").add("n_known", "long").add("base", "double").add(
        "others", OTHERS).add("score", "double")
    scored = rows.mapInArrow(score(parts[0] if whole else None), out)
    if whole:
        scored = scored.withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    if not whole:
        passes = [rows.select("row", "text").mapInArrow(level_rows(p), "row long, words binary, pairs binary, end int")
                  for p in parts]
        together = passes[0]
        for more in passes[1:]:
            together = together.union(more)
        scored = scored.drop("score").join(
            together.groupBy("row").applyInArrow(put_together, "row long, score double"), "row")

    rare = scored.select("row", F.inline("others")).join(tail_counts(counts, head), "h").groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score")


def tail_counts(counts: DataFrame, head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Counts of the words outside the head: below its last place in the order (count, hash)."""
    keys, n = head
    if not len(keys):
        return counts
    least = int(n.min())
    last = int(keys.view(np.int64)[n == least].max())
    return counts.where((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last)))
