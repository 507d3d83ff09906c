"""Helpers shared by the operators: column expressions and vectorised word hashing.

White space is the six ASCII characters space, tab, line feed, vertical tab, form feed and
carriage return; a word is a maximal run of anything else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Entries kept in a task's word cache before it is emptied.
CACHE_WORDS = 1_000_000


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python tasks in batches of at most ``rows`` rows (a session setting): long
    texts then need little memory on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with only the named columns in the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z, every other character stays (``lower`` alone would change more)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_words(c: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, remembered for the words of one task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that a task takes in hand at once (a longer text alone).
PIECE_BYTES = 2 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in stretches of about ``PIECE_BYTES`` of text, which bounds the
    words held at once."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + PIECE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch, column: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as bytes; a missing one is empty."""
    return [t or b"" for t in batch.column(column).to_pylist()]


def random_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of their id (the same ones on every run)."""
    place = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 32))
    near = df.where(place < (1 << 32) * min(1.0, 2 * rows / max(1, df.count())))  # else every task sends as many rows
    return near.orderBy(place, *df.columns).limit(rows)


def heavy_join(rows: DataFrame, table: DataFrame, on: list[str], n_col: str, total: int,
               heavy_keys: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row per key and its number of rows.

    Keys of more than a ``heavy_keys``-th of ``total`` rows are fewer than ``heavy_keys``, so
    they are broadcast; all other keys are shuffled, and none of them is large. ``rows`` is
    read twice, so it should be a written table.
    """
    least = max(1, total // heavy_keys)
    heavy, light = table.where(F.col(n_col) > least), table.where(F.col(n_col) <= least)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], spread: str, salts: int = 32,
                how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``table`` that has one row per key.

    The table is repeated ``salts`` times and rows are dealt to the copies by a hash of
    ``spread``, so a key that holds a third of all rows meets the table in many tasks. The
    copies are never broadcast, as their size is not seen in that of the table.
    """
    many = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(many.hint("merge"), [*on, "_salt"], how).drop("_salt")


def keyed_join(rows: DataFrame, table: DataFrame, on: list[str], spread: str, how: str = "inner",
               most_rows: int = 100_000) -> DataFrame:
    """Join with a written ``table`` of one row per key: broadcast where it has at most
    ``most_rows`` rows, else by :func:`salted_join`."""
    if table.limit(most_rows + 1).count() <= most_rows:
        return rows.join(F.broadcast(table), on, how)
    return salted_join(rows, table, on, spread, how=how)
