"""Mixing sources to target weights.

Every document gets a random key that is a hash of its id, so reruns agree. The key space
is cut into equal ranges; ranges of one source hold about ``rows_per_range`` documents
whatever the size of the source, so a source with a third of all documents is spread like
any other. Word counts are summed within ranges, over blocks of ranges and over the blocks
of a source: three short prefix sums add up to each document's place in its source's random
order, and the source is cut where its budget ends, after whole epochs if the budget is
larger than the source.

Defined results: a missing text has no words and is never taken; a missing source is a
source of its own, ranked last; a missing id takes part with a fixed key; rows that repeat
count one by one; an empty table gives an empty mix; columns beyond those named are kept
as they are (the operator's own are replaced if they clash: size, source_size, target,
taken, copies).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, n_words
from panelspark.operators.relational import sequence_number
from panelspark.session import materialize

KEY_BITS = 60
BLOCK_BITS = 10
OUT = ["size", "source_size", "target", "taken", "copies"]


def random_key(c: Column) -> Column:
    """60 random bits that depend on the value alone (the first 15 hex digits of its MD5)."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """Words to take from each source: ``target`` for rows of (total, weight, ...).

    Targets are proportional to the weights and add up to ``share`` of all words. A target
    above ``max_repeats`` times its source stops there and what it leaves is shared again by
    weight, until none is above. Only the level (words per unit of weight) is on the driver;
    each step is one aggregate over the sources.
    """
    cap = F.col("total") * F.lit(float(max_repeats))
    grand = (sources.agg(F.sum("total")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while grand:
        over = cap < F.lit(level) * F.col("weight")
        n, held, free = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (grand - held) / free, (n if level else -1)
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: Sequence[float] | Mapping[str, float] = (5, 2, 1),
                share: float = 1.0, max_repeats: float = 3.0, rows_per_range: int = 256,
                keep_text: bool = True) -> DataFrame:
    """Add size, source_size, target, taken (words, repeats counted) and copies to every row.

    ``weights`` are dealt to the sources in code point order, again and again, or given by
    source (a source that is not listed gets none).
    """
    rows = docs.drop(*[c for c in OUT if c in docs.columns])
    own = rows.columns if keep_text else [c for c in rows.columns if c != text_col]
    rows = rows.withColumns({
        "size": n_words(F.col(text_col)),
        "_src": F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))),
        "_key": random_key(F.col(id_col)),
        "_tie": F.xxhash64(F.col(text_col)),
    })
    rows = materialize(rows.select(*own, "size", "_src", "_key", "_tie"), "mix-rows")

    bits = max(0, math.ceil(math.log2(max(1, rows.count() / rows_per_range))))
    rows = rows.withColumn("_range", F.shiftright("_key", KEY_BITS - bits))
    ranges = rows.groupBy("_src", "_range").agg(F.sum("size").alias("n")).withColumn(
        "_block", F.shiftright("_range", BLOCK_BITS))
    ranges = materialize(ranges, "mix-ranges")
    blocks = ranges.groupBy("_src", "_block").agg(F.sum("n").alias("n"))

    sources = materialize(blocks.groupBy("_src").agg(F.sum("n").alias("total")), "mix-sources")
    if isinstance(weights, Mapping):
        listed = {f"0{k}" if k is not None else "1": float(w) for k, w in weights.items()}
        pairs = F.create_map(*[F.lit(x) for kv in listed.items() for x in kv])
        sources = sources.withColumn("weight", F.coalesce(F.try_element_at(pairs, "_src"), F.lit(0.0)))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        sources = sequence_number(sources, ["_src"], "_rank").withColumn(
            "weight", F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int"))).drop("_rank")
    sources = source_targets(materialize(sources, "mix-weights"), share, max_repeats)

    def before(c: str, over: list[str], by: str) -> Column:
        w = Window.partitionBy(*over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    blocks = blocks.withColumn("_at_block", before("n", ["_src"], "_block")).drop("n")
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("total") > 0, F.floor(budget / F.col("total"))).otherwise(0)
    starts = (ranges.withColumn("_at_range", before("n", ["_src", "_block"], "_range"))
              .join(blocks, ["_src", "_block"]).join(sources, "_src")
              .select("_src", "_range", (F.col("_at_block") + F.col("_at_range")).alias("_start"),
                      F.col("total").alias("source_size"), "target", epochs.cast("long").alias("_epochs"),
                      (budget - epochs * F.col("total")).cast("long").alias("_rest")))

    inside = Window.partitionBy("_src", "_range").orderBy("_key", F.col(id_col), "_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["_src", "_range"])
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start") - F.col("_at")))
    return placed.select(
        *own, "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + last).cast("long").alias("taken"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(
            F.col("_epochs") + F.when(last > 0, 1).otherwise(0)).cast("long").alias("copies"))


def emit_mix(mixed: DataFrame, text_col: str = "text", epoch_col: str = "epoch") -> DataFrame:
    """The mix itself: one row per copy. The copy in which a source's budget ends holds the
    words up to it, joined by single spaces; all others are whole."""
    left = F.col("taken") - (F.col(epoch_col) - 1) * F.col("size")
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")
    return (mixed.where(F.col("copies") > 0)
            .withColumn(epoch_col, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .withColumn(text_col, F.when(left < F.col("size"), cut).otherwise(F.col(text_col))))
