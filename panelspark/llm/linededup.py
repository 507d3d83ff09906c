"""Line dedup: lines that several documents share stay only in the first of them.

Lines are exploded with their positions and hashed (128 bits); only hashes are shuffled.
Documents per hash are counted after a distinct per document, lines whose count reaches
the threshold are matched with their hash, and the positions to drop go back to the
documents, whose remaining lines are joined in order.

Defined results: a missing or empty text is one empty line; rows without an id neither
count nor lose lines; rows that share an id count as one document and each is rebuilt on
its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import BLANK, ascii_lower, heavy_join
from panelspark.session import materialize


def line_key(line: Column) -> Column:
    """A line's identity: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(id, n_lines, n_dropped, text): every text without the lines it shares with a smaller id.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    loses all its lines except those of the smallest id holding it.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # a row is known by its id and its text's hash: rows equal in both have equal results
    base = base.withColumn("_row", F.xxhash64("_text"))
    split = F.split("_text", "\n")

    lines = (base.where(F.col("_id").isNotNull())
             .select("_id", "_row", F.posexplode(split).alias("_pos", "_line"))
             .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
             .where(F.char_length("_key") >= min_chars)
             .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"),
                     F.xxhash64(F.lit(7), F.col("_key")).alias("_h2")))
    lines = materialize(lines, "lines")
    shared = (lines.select("_h1", "_h2", "_id").distinct()
              .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
              .where(F.col("_n") >= min_docs))
    shared = materialize(shared, "shared-lines")
    drops = (heavy_join(lines, shared, ["_h1", "_h2"], "_n", lines.count()).where(F.col("_id") > F.col("_first"))
             .groupBy("_id", "_row").agg(F.sort_array(F.collect_set("_pos")).alias("_drop")))
    # one flag per line up to the last dropped one, so that a line is looked up by position
    gap = F.transform("_drop", lambda p, i: F.concat(
        F.array_repeat(F.lit(True), p - F.when(i > 0, F.get("_drop", i - 1)).otherwise(-1) - 1),
        F.array(F.lit(False))))
    drops = drops.select("_id", "_row", F.size("_drop").cast("long").alias("_dropped"),
                         F.flatten(gap).alias("_keep"))
    kept = F.filter(split, lambda _, i: F.coalesce(F.get("_keep", i), F.lit(True)))
    return base.join(drops, ["_id", "_row"], "left").select(
        F.col("_id").alias(id_col), F.size(split).cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("_keep").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("text"))
