"""Benchmark decontamination: words of documents inside passages of a benchmark.

Benchmark items are cut into windows of ``n`` normalised words (a shorter item is one window).
Windows are hashed, and blocks of at most ``max_windows`` (window, item) pairs are broadcast.
A task hashes the words of a whole batch of documents at once, rolls the hashes over every
window length in use, looks them up through a bit table and a sorted array, and verifies each
hit against the window's words. A benchmark of more pairs is scanned block by block.

A word is a run of a-z, 0-9 and any character beyond ASCII, after A-Z is lower-cased.

Defined results: a missing or empty text has no words and no hits; an item without words
has no window; a missing item id is left out of the item list but its window still counts;
documents that repeat get equal rows; an empty table on either side gives no hits; other
columns are not read, or travel inside one struct, so that no name can clash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from panelspark.llm.common import WordHashes, bounded_batches, pieces, texts_of
from panelspark.session import materialize

WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
#: Every byte to its normalised form: letters lower-cased, bytes outside words blank.
NORMAL = bytes(x if x in WORD_BYTES else 32 for x in bytes(range(256)).lower())
ROLL = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 22
SPANS = "array<struct<start:int,stop:int>>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words (empty if there are fewer)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * ROLL + hashes[j:j + size]
    return out ^ (out >> np.uint64(29))


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (h, n, words, item) of every window of the benchmark."""

    def cut(batches):
        known = WordHashes()
        for batch in batches:
            out = {"h": [], "n": [], "words": [], "item": []}
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch)):
                words = normal_words(text)
                size = min(n, len(words))
                if not size:
                    continue
                keys = rolled(known.of(words), size).view(np.int64).tolist()
                out["h"] += keys
                out["n"] += [size] * len(keys)
                out["words"] += [b" ".join(words[i:i + size]) for i in range(len(keys))]
                out["item"] += [item] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["h"], pa.int64()), pa.array(out["n"], pa.int32()),
                 pa.array(out["words"], pa.binary()), pa.array(out["item"], pa.string())], list(out))

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return items.mapInArrow(cut, "h long, n int, words binary, item string").distinct()


def covered(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, stop)."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist())):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def scanner(block):
    """A mapInArrow function that finds the windows of one broadcast block."""

    def scan(batches):
        windows: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for h, n, words, item in block.value:
            windows.setdefault(n, {}).setdefault(h, {}).setdefault(words, []).append(item)
        index = {}
        for n, by_hash in windows.items():
            keys = np.sort(np.fromiter(by_hash, np.int64, len(by_hash)).view(np.uint64))
            table = np.zeros(1 << TABLE_BITS, bool)
            table[keys >> np.uint64(64 - TABLE_BITS)] = True
            index[n] = keys, table
        known = WordHashes()
        for batch in pieces(batches):
            docs = [normal_words(t) for t in texts_of(batch)]
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            ends = np.cumsum(sizes)
            words = [w for d in docs for w in d]
            hashes = known.of(words)
            spans: list[list] = [[] for _ in docs]
            items: list[set] = [set() for _ in docs]
            for n, (keys, table) in index.items():
                rolls = rolled(hashes, n)
                at = np.flatnonzero(table[rolls >> np.uint64(64 - TABLE_BITS)])
                place = np.minimum(np.searchsorted(keys, rolls[at]), len(keys) - 1)
                at = at[keys[place] == rolls[at]]
                owner = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[owner] if len(at) else np.zeros(0, bool)
                for i, d in zip(at[inside].tolist(), owner[inside].tolist()):
                    found = windows[n][int(rolls[i:i + 1].view(np.int64)[0])].get(b" ".join(words[i:i + n]))
                    if found is not None:
                        start = i - int(ends[d] - sizes[d])
                        spans[d].append((start, start + n))
                        items[d].update(x for x in found if x is not None)
            merged = [covered(*np.array(s, np.int64).T) if s else [] for s in spans]
            columns = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes),
                 pa.array([[{"start": a, "stop": b} for a, b in s] for s in merged],
                          pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*names, "n_words", "spans", "items"])

    return scan


def find_passages(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", n: int = 10,
                  max_windows: int = 1_000_000, carry: bool = False) -> DataFrame:
    """(id, n_words, n_hit, spans, items): words of each document inside benchmark windows.

    ``spans`` are maximal runs of hit words as word positions [start, stop); ``items`` are
    the ids of the items whose windows occur, sorted as strings. With ``carry`` the whole
    row comes along as the struct ``doc``.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    windows = materialize(item_windows(benchmark, n, item_col, item_text_col), "windows")
    blocks = max(1, -(-windows.count() // max_windows))
    doc = [F.struct(*docs.columns).alias("doc")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), *doc)
    if blocks > 1:  # the passes are put together by row, so rows get a number that stays
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = []
    for k in range(blocks):
        part = windows.where(F.pmod(F.col("h"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        schema = StructType([f for f in rows.schema if f.name != "text"]).add("n_words", "long").add(
            "spans", DataType.fromDDL(SPANS)).add("items", DataType.fromDDL("array<string>"))
        found.append(rows.mapInArrow(scanner(block), schema))
    out = found[0]
    if blocks > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("row").agg(
            *[F.first(c).alias(c) for c in ("id", "n_words", "doc") if c in out.columns],
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("row")
        out = out.withColumn("spans", merged_spans(F.col("spans")))
    hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"]).cast("long")
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items",
                      *[c for c in ("doc",) if c in out.columns])


def merged_spans(spans):
    """Maximal runs of sorted spans."""
    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (s["start"] <= last["stop"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
                      ).otherwise(F.concat(done, F.array(s))).cast(SPANS)

    return F.aggregate(spans, F.array().cast(SPANS), add)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of every span."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    out, done = [], 0
    for start, stop in spans:
        out.append(text[done:at[start][0]])
        done = at[stop - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold benchmark passages, or without the passages
    (``remove="spans"``); all columns stay."""
    found = find_passages(docs, benchmark, id_col=id_col, text_col=text_col, carry=True, **options)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select("doc.*")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None or not len(s) else
            cut_words(t.encode(), [(x["start"], x["stop"]) for x in s]).decode()
            for t, s in zip(texts, spans)], dtype=object)

    clean = F.when(F.size("spans") > 0, cut(F.col(f"doc.{text_col}"), F.col("spans"))).otherwise(F.col(f"doc.{text_col}"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"doc.{c}") for c in docs.columns])
