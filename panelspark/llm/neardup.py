"""MinHash near-dedup with circulant permutations.

A document is the set of its distinct word shingles. One permutation scatters shingles over
a universe of 2^20 cells, a second one ranks the cells; shifting the second circularly by
k = 0, 1, 2, ... gives all signature coordinates, so a shingle's ranks under all of them are
one slice of one array and a signature is the minimum of slices. Bands of coordinates are
hashed; documents that share a band are candidates, and links are confirmed on full sets.

Exact copies of a set are one vertex. A bucket of more than ``SMALL`` candidates never emits its
pairs: in every round each vertex meets one leader of one bucket that still holds several
components; verified links merge components, and buckets whose members are connected drop out.
What is left after the rounds is compared in blocks of sets, within tasks, which put out links
only. So no link between candidates is lost, whatever the size of a group.

With 64 bands of 7 coordinates a pair of similarity 0.8 fails to become a candidate with
probability 3e-7, one of similarity 0.05 becomes one with probability 5e-8.

Defined results: a missing or empty text, or one without words, has an empty set and is
linked with nothing; a text of fewer words than a shingle is one shingle; rows without an id
have no component and are kept; rows that share an id are told apart by their texts; rows
that repeat are one vertex; an empty table gives an empty result; columns travel in one
struct, so no name can clash. Sets are compared by 64-bit hashes of their shingles, vertices
are 64-bit hashes of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WordHashes, bounded_batches, heavy_join, keyed_join, mix64, pieces, salted_join, texts_of
from panelspark.llm.components import components
from panelspark.operators.relational import sequence_number
from panelspark.session import materialize

UNIVERSE_BITS = 20
ROLL = np.uint64(0x9E3779B97F4A7C15)
SLICE_ROWS = 1024
SMALL = 8
BLOCK_SETS = 256


def shingles(text: bytes, words_per_shingle: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    hashes = known.of(text.lower().split())
    size = min(words_per_shingle, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(size))  # a short text is no shingle of a longer one
    for j in range(size):
        out = mix64(out * ROLL + hashes[j:j + n])
    return np.unique(out)


def circulant_slices(coordinates: int, seed: int) -> np.ndarray:
    """Row i: ranks of cell i under every circular shift of one permutation of the universe."""
    order = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    around = np.concatenate([order[len(order) - coordinates + 1:], order])
    return np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(found: np.ndarray, slices: np.ndarray) -> np.ndarray:
    cells = np.unique(mix64(found) >> np.uint64(64 - UNIVERSE_BITS))
    out = slices[cells[:SLICE_ROWS]].min(axis=0)
    for at in range(SLICE_ROWS, len(cells), SLICE_ROWS):
        out = np.minimum(out, slices[cells[at:at + SLICE_ROWS]].min(axis=0))
    return out


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(bands, -1).astype(np.uint64)
    out = mix64(np.arange(1, bands + 1, dtype=np.uint64) * ROLL)
    for j in range(parts.shape[1]):
        out = mix64(out ^ (parts[:, j] + ROLL))
    return out.view(np.int64)


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def sketch(rows: DataFrame, words_per_shingle: int, bands: int, per_band: int, seed: int) -> DataFrame:
    """(id, row, n, set, bands) of rows of (id, row, text)."""

    def run(batches):
        known, slices = WordHashes(), circulant_slices(bands * per_band, seed)
        for batch in pieces(batches):
            n, ids, keys = [], [], []
            for text in texts_of(batch):
                found = shingles(text, words_per_shingle, known)
                n.append(len(found))
                ids.append(set_id(found) if len(found) else None)
                keys.append(band_hashes(signature(found, slices), bands) if len(found) else found.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate([*keys, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "row", "n", "set", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row long, n long, `set` long, bands array<long>")


def candidate_sets(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """(set, shingles as bytes) of rows of (text, set); a row whose text makes another set is left out."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            ids, blobs = [], []
            for text, want in zip(texts_of(batch), batch.column("set").to_pylist()):
                found = shingles(text, words_per_shingle, known)
                if set_id(found) == want:
                    ids.append(want)
                    blobs.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())],
                                             ["set", "shingles"])

    return rows.mapInArrow(run, "`set` long, shingles binary").dropDuplicates(["set"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    held = (pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b"))
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def leader_pairs(now: DataFrame, turn: int) -> DataFrame:
    """(set, n, other, m): every set with this round's leader of one of its buckets, where that
    bucket holds several components and the two are of different ones. ``now`` is (set, n, label,
    bands), a row a set; the bucket is picked by a hash, so a set brings one row to the join."""
    rank = F.xxhash64(F.lit(turn), F.col("set"))
    lead = now.select("set", "n", "label", F.explode("bands").alias("band")).groupBy("band").agg(
        F.min(F.struct(rank.alias("r"), "set", "n", "label")).alias("lead"),
        F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "lead")
    pick = F.array_min(F.transform("bands", lambda b: F.struct(F.xxhash64(F.lit(turn), F.col("set"), b).alias("r"), b.alias("band"))))
    met = salted_join(now.select("set", "n", "label", pick["band"].alias("band")), lead, ["band"], "set", salts=8)
    return met.where(F.col("label") != F.col("lead.label")).select(
        "set", "n", F.col("lead.set").alias("other"), F.col("lead.n").alias("m"))


def alike_in_size(percent: int, n: str = "n", m: str = "m"):
    """Whether sets of ``n`` and ``m`` elements can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def block_links(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked components among the members of buckets that hold several components.

    Buckets that share members make a family. A family is cut into blocks of ``BLOCK_SETS``
    members, sorted by component, and blocks are compared pair by pair, each pair in one task:
    intersections of all their sets are one matrix product over the shingles they share. Pairs
    of blocks of one and the same component are left out, and so are those whose sizes are too
    far apart. Only links between components are put out.
    """
    now = now.select("set", "n", "label", F.explode("bands").alias("band"))
    open_ = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        "lo < hi").select("band", "lo")
    held = materialize(salted_join(now, open_, ["band"], "set", salts=8).select("set", "n", "label", "lo").distinct(),
                       "open-members")
    families = components(held.where("label != lo").select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct())
    held = held.select("set", "n", "label").distinct().join(
        families.select(F.col("v").alias("label"), F.col("label").alias("family")), "label")
    held = sequence_number(held, ["label", "n", "set"], "at", group=["family"])
    held = held.withColumn("block", F.floor((F.col("at") - 1) / BLOCK_SETS))
    blocks = held.join(sets, "set").groupBy("family", "block").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.collect_list("label").alias("labels"), F.collect_list("shingles").alias("held"))
    blocks = materialize(blocks, "blocks")
    side = lambda x: blocks.select("family", *[F.col(c).alias(c + x) for c in ("block", "lo", "hi", "least", "most")])
    pairs = side("_a").join(side("_b"), "family").where(
        (F.col("block_a") <= F.col("block_b"))
        & ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
        & (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a")))
    full = lambda x: blocks.select("family", *[F.col(c).alias(c + x) for c in ("block", "labels", "held")])
    pairs = (pairs.select("family", "block_a", "block_b").join(full("_a"), ["family", "block_a"])
             .join(full("_b"), ["family", "block_b"]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in ("labels_a", "held_a", "labels_b", "held_b")}
                a, b = np.array(one["labels_a"]), np.array(one["labels_b"])
                hit = similar_pairs(*[[np.frombuffer(x, np.uint64) for x in one[c]] for c in ("held_a", "held_b")], percent)
                rows, cols = np.nonzero(hit & (a[:, None] != b[None, :]))
                found = np.unique(np.stack([a[rows], b[cols]], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return pairs.select("labels_a", "held_a", "labels_b", "held_b").mapInArrow(run, "a long, b long")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix: is set i of ``left`` similar enough to set j of ``right``."""
    size_a, size_b = (np.array(list(map(len, x)), np.int64) for x in (left, right))
    all_a, all_b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), size_a), np.repeat(np.arange(len(right)), size_b)
    common = np.intersect1d(all_a, all_b)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), 4096):
        part = common[at:at + 4096]
        sides = []
        for values, rows, n in ((all_a, row_a, len(left)), (all_b, row_b, len(right))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            own = part[place] == values
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[own], place[own]] = 1
            sides.append(matrix)
        both += sides[0] @ sides[1].T
    both = np.rint(both).astype(np.int64)
    return 100 * both >= percent * (size_a[:, None] + size_b[None, :] - both)


def links(rows: DataFrame, vertices: DataFrame, words_per_shingle: int, percent: int, rounds: int) -> DataFrame:
    """(set, label): components of the sets that are linked with another.

    ``rows`` are (id, text), ``vertices`` (set, n, id, bands) with one row per distinct set.
    """
    spread = vertices.select("set", "n", F.explode("bands").alias("band"))
    shared = materialize(spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared-bands")
    members = heavy_join(spread, shared, ["band"], "size", vertices.agg(F.sum(F.size("bands"))).first()[0] or 0)
    members = materialize(members, "members")
    picked = members.select("set").distinct().join(vertices.select("set", "id"), "set")
    sets = materialize(candidate_sets(rows.join(picked, "id").select("text", "set"), words_per_shingle), "sets")
    state = materialize(members.select("set", F.col("set").alias("label")).distinct(), "state")

    def merged(state: DataFrame, edges: DataFrame) -> DataFrame:
        """``state`` after joining the components (a, b) of ``edges``."""
        if not edges.limit(1).count():
            return state
        to = components(edges).select(F.col("v").alias("label"), F.col("label").alias("to"))
        return materialize(state.join(to, "label", "left").select("set", F.coalesce("to", "label").alias("label")), "state")

    def compared(state: DataFrame, pairs: DataFrame) -> DataFrame:
        new = materialize(confirmed(pairs, sets, percent), "links")
        of = lambda side: state.select(F.col("set").alias(side), F.col("label").alias("l" + side))
        return merged(state, new.join(of("a"), "a").join(of("b"), "b").where("la != lb").select(
            F.col("la").alias("a"), F.col("lb").alias("b")))

    # small buckets: every pair, which is at most SMALL - 1 for a member
    small = members.where(F.col("size") <= SMALL)
    other = small.select("band", F.col("set").alias("other"), F.col("n").alias("m"))
    pairs = small.join(other, "band").where(F.col("set") < F.col("other")).where(alike_in_size(percent)).select(
        F.col("set").alias("a"), F.col("other").alias("b")).distinct()
    state = compared(state, materialize(pairs, "pairs"))

    # large ones: a member meets one leader a round, then what is left is compared in blocks
    # the buckets of a set are one array, so labels are joined to one row a set
    large = materialize(members.where(F.col("size") > SMALL).groupBy("set", "n").agg(
        F.collect_set("band").alias("bands")), "large")
    for turn in range(rounds):
        met = leader_pairs(large.join(state, "set"), turn).where(alike_in_size(percent))
        pairs = materialize(met.select(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b")).distinct(), "pairs")
        if not pairs.limit(1).count():
            break
        state = compared(state, pairs)
    return merged(state, materialize(block_links(large.join(state, "set"), sets, percent), "block-links"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5,
                    percent: int = 80, bands: int = 64, per_band: int = 7, rounds: int = 4, seed: int = 3) -> DataFrame:
    """(id, n_shingles, component_id, kept, row): one row per row of ``docs``; ``row`` is the
    hash (xxhash64) of its text's bytes.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    marks = materialize(sketch(rows.withColumn("row", F.xxhash64("text")), words_per_shingle, bands, per_band, seed),
                        "sketch")
    some = marks.where("id IS NOT NULL AND n > 0")
    first = materialize(some.groupBy("set", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "sets-first")
    vertices = some.select("set", "n", "id", "bands").join(first.drop("rows"), ["set", "n", "id"]).dropDuplicates(["set"])
    vertices = materialize(vertices, "vertices")
    labels = links(rows.where("id IS NOT NULL"), vertices, words_per_shingle, percent, rounds)

    named = first.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"), F.sum("rows").alias("size"))
    least = materialize(least.where("size > 1"), "components")
    of = keyed_join(named, least, ["label"], "set").select("set", "component_id")
    out = keyed_join(marks, materialize(of, "component"), ["set"], "id", how="left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "row")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of linked documents, that of the smallest id. Rows that
    repeat id and text are one document; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("id"), "row").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("row"),
                       F.struct(*docs.columns).alias("doc"))
    named = rows.where(F.col("id").isNotNull()).join(gone, ["id", "row"], "left_anti").dropDuplicates(["id", "row"])
    return named.select("doc.*").unionByName(rows.where(F.col("id").isNull()).select("doc.*"))
