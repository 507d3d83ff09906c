"""Filter interaction audit by contingency tensor contractions.

Every document is a cell of a 2x2x...x2 tensor, one axis per filter (0 passes, 1 fails). Spark
counts the cells of each part in three layers: documents, good ones, toxic ones. A cascade step
asks for one sum over the tensor: along each axis it selects pass (filters applied before), fail
(the step's own filter) or all (filters still to come). One ``einsum`` of the tensor with such
selectors gives every step of every order of the filters at once.

The five filters of :func:`failures` are few words (A), repeated words (B), capitals (C), symbols
(D) and copies of a text of a smaller id (E); :func:`contract` takes any number of filters.

Sizes: texts are judged in stretches of about 2 MB (a longer text alone); copies meet by the
SHA-256 of the text, counted before the shuffle, and digests of more than a thousandth of all
rows are joined by broadcast (fewer than a thousand). A part's tensor has 2^k cells.

Defined results: a missing text is empty; a missing part is the empty string, and so the same
part as an empty one; a row without an id comes after all ids, so it is a copy if any row with
an id has its text; rows that repeat an id are all counted and are no copies of each other; a
document is good or toxic if any of its label rows says so; labels that are missing, and labels
of unknown ids, say nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_batches, heavy_join, pieces, texts_of
from panelspark.session import materialize

FILTERS = "ABCDE"
SYMBOL = re.compile(rb"[#$%&*|]")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def judge(text: bytes) -> int:
    """Failures of the filters that read the text alone, as bits: A 16, B 8, C 4, D 2."""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    capitals = np.count_nonzero((data >= 65) & (data <= 90))
    chars = len(data) - np.count_nonzero((data & 0xC0) == 0x80)
    return (16 * (len(words) < 200) + 8 * (100 * len(set(words)) < 50 * len(words))
            + 4 * (100 * capitals > 3 * chars) + 2 * bool(SYMBOL.search(text)))


def judge_batches(batches):
    for batch in pieces(batches):
        texts = texts_of(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("part"), pa.array([judge(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["id", "part", "fails", "digest"])


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails) of every row; ``fails`` has a bit for each of ``FILTERS``, A the highest."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("binary").alias("text"))
    schema = rows.select("id", "part").schema.add("fails", "integer").add("digest", "binary")
    judged = materialize(rows.mapInArrow(judge_batches, schema), "judged")
    texts = materialize(judged.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    found = heavy_join(judged, texts, ["digest"], "n", judged.count())
    copy = F.when(F.col("id").isNull(), F.col("first").isNotNull()).otherwise(F.col("id") > F.col("first"))
    return found.select("id", "part", (F.col("fails") + copy.cast("int")).alias("fails"))


def cells(failed: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): documents of every filled cell. ``failed`` is read twice."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    said = labels.select(F.col(id_col).alias("id"), "quality", "toxic").groupBy("id").agg(flag("quality"), flag("toxic"))
    said = said.where("quality + toxic > 0")
    zero = F.lit(0).cast("long")
    counted = failed.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"))
    flagged = failed.join(said, "id").groupBy("part", "fails").agg(F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))
    both = counted.select("*", zero.alias("good"), zero.alias("toxic")).unionByName(
        flagged.select("part", "fails", zero.alias("n"), "good", "toxic"))
    return both.groupBy("part", "fails").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def selectors(k: int, orders: list) -> dict[str, np.ndarray]:
    """For each kind of count an array [order and step, axis, outcome] of zeros and ones."""
    ok, bad, any_ = (1, 0), (0, 1), (1, 1)
    rows = [(order[:s], order[s]) for order in orders for s in range(k)]
    pick = lambda f: np.array([[f(axis, before, own) for axis in range(k)] for before, own in rows], np.int64)
    return {
        "kept": pick(lambda a, before, own: ok if a == own or a in before else any_),
        "removed": pick(lambda a, before, own: bad if a == own else ok if a in before else any_),
        "fails": pick(lambda a, before, own: bad if a == own else any_),
        "unique_fails": pick(lambda a, before, own: bad if a == own else ok),
    }


def contract(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every order of ``filters`` and every step, from (part, fails, n, good, toxic)."""
    k = len(filters)
    orders = list(permutations(range(k)))
    own = np.array([i for order in orders for i in order])
    asked = selectors(k, orders)
    names = ["".join(filters[i] for i in order) for order in orders]

    def run(key, table):
        tensor = np.zeros((3, 1 << k), np.int64)
        for layer, c in enumerate(("n", "good", "toxic")):
            np.add.at(tensor[layer], table.column("fails").to_numpy(), table.column(c).to_numpy())
        tensor = tensor.reshape(3, *[2] * k)
        axes = [x for a in range(k) for x in (a, [1, 2 + a])]

        def total(kind):   # sum over cells of tensor[layer, a, b, ...] * s[row, a] * s[row, b] * ...
            parts = [asked[kind][:, x] if i % 2 == 0 else x for i, x in enumerate(axes)]
            return np.einsum(tensor, [0, *range(2, 2 + k)], *parts, [0, 1])

        removed, fails = total("removed"), total("fails")
        shapley = np.zeros(k, np.int64)
        np.add.at(shapley, own, removed[0])
        out = {"kept": total("kept")[0], "removed": removed[0], "redundant": (fails - removed)[0],
               "unique_fails": total("unique_fails")[0], "good_lost": removed[1], "toxic_lost": removed[2],
               "shapley": shapley[own]}
        return pa.table({"part": pa.array([key[0].as_py()] * len(own), pa.string()),
                         "filter_order": pa.array([n for n in names for _ in range(k)]),
                         "step": pa.array(list(range(1, k + 1)) * len(orders), pa.int32()),
                         **{c: pa.array(out[c]) for c in COUNTS}})

    return counted.groupBy("part").applyInArrow(
        run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """The audit of the five filters: 600 rows for each part of ``docs``."""
    failed = materialize(failures(docs, id_col=id_col, text_col=text_col, part_col=part_col), "failures")
    return contract(cells(failed, labels, id_col=id_col))
