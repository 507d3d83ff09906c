"""Quality classifier: document evidence combined with host and path posteriors.

Two logistic models (quality, toxicity) over hashed words and a few shape features are fitted
on a bounded sample of labelled rows (``sample_rows``; the only part that does not read all
rows). Every document is then scored. The mean probability (of quality, and of toxicity) of
each path, host and of the whole table are hierarchical empirical Bayes estimates: a path is
shrunk towards its host and a host towards the global mean by pseudo-counts fitted to the
variance between groups, so a sparse site stays near the prior. A document's log odds are its
own evidence moved by the difference between its path's posterior and the global mean; both
verdicts are made so.

A host is the ``host_col`` of a row, a path the pair of host and ``path_col``.

Defined results: a missing text is empty and is judged on its shape features; a missing host
or path is a group of its own; labels of absent documents and labels that are missing are
ignored; a table without labels gives even odds, which are kept; rows that repeat are judged
alike; an empty table gives an empty result; a document is kept unless it is more likely
bad than good or more likely toxic than not; columns are carried in one struct, so no name
can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WordHashes, bounded_batches, keyed_join, pieces, random_sample, texts_of
from panelspark.session import materialize

FEATURE_BITS = 18
SHAPES = 64
SYMBOL_BYTES = np.zeros(256, bool)
SYMBOL_BYTES[list(b"#*$%&|<>")] = True
MEASURES = ("quality", "toxic")
EDGES = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6])


def shape_bins(text: bytes, words: list[bytes]) -> list[int]:
    """Binned shares of symbols, repeated words, repeated word pairs and mean word length."""
    n = max(1, len(words))
    symbols = int(SYMBOL_BYTES[np.frombuffer(text, np.uint8)].sum()) / n
    distinct = len(set(words)) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    values = (symbols, 1 - pairs, max(0.0, 0.5 - distinct), min(1.0, len(words) / 50))
    return [8 * k + int(np.searchsorted(EDGES, v, side="right")) - 1 for k, v in enumerate(values)]


def features(text: bytes, known: WordHashes) -> np.ndarray:
    """Distinct feature numbers of a text: shapes first, then hashed words without end punctuation."""
    words = text.lower().split()
    bare = {w.strip(b".,;:!?\"'()") for w in words}
    bare.discard(b"")
    hashed = known.of(list(bare)) >> np.uint64(64 - FEATURE_BITS)
    return np.unique(np.concatenate([np.array(shape_bins(text, words), np.int64),
                                     hashed.astype(np.int64) + SHAPES]))


def labelled_features(docs: DataFrame) -> DataFrame:
    """(id, quality, toxic, features as bytes) of labelled rows."""

    kept = ["id", "quality", "toxic"]

    def run(batches):
        known = WordHashes()
        for batch in batches:
            found = [features(t, known).astype(np.int32).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(found, pa.binary())], [*kept, "features"])

    return docs.mapInArrow(run, docs.select(*kept).schema.add("features", "binary"))


def telling(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, least_z: float = 4.0) -> np.ndarray:
    """Features whose share of rows differs between the classes by ``least_z`` standard errors,
    and all shapes."""
    size = SHAPES + (1 << FEATURE_BITS)
    one, all_ = np.bincount(flat, y[owner], size), np.bincount(flat, minlength=size)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    p1, p0, p = one / n1, (all_ - one) / n0, np.clip(all_ / len(y), 1 / len(y), 1 - 1 / len(y))
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    keep = (np.abs(z) >= least_z) & (all_ >= 5)
    keep[:SHAPES] = True
    return keep


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, passes: int = 80, l2: float = 1e-6,
                 seed: int = 5) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic model on sets of features that tell the
    classes apart, by AdaGrad; either class counts half, so that a rare one is not overlooked."""
    size = SHAPES + (1 << FEATURE_BITS)
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-6)
    if not len(rows):
        return w
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    keep = telling(flat, owner, y)[flat]
    flat, sizes = flat[keep], np.bincount(owner[keep], minlength=len(rows))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.random.default_rng(seed)
    n = len(rows)
    cost = np.where(y > 0, n / 2 / max(1.0, y.sum()), n / 2 / max(1.0, n - y.sum()))
    for _ in range(passes):
        for part in np.array_split(order.permutation(n), max(1, n // 64)):
            cols = np.concatenate([flat[starts[i]:starts[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), sizes[part])
            z = np.bincount(own, w[cols], len(part)) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * cost[part]
            uniq, inverse = np.unique(cols, return_inverse=True)
            grad = np.bincount(inverse, err[own], len(uniq)) / len(part) + l2 * w[uniq]
            g2[uniq] += grad * grad
            w[uniq] -= 0.5 * grad / np.sqrt(g2[uniq])
            g2[-1] += err.mean() ** 2
            w[-1] -= 0.5 * err.mean() / math.sqrt(g2[-1])
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sample_rows: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """(quality, toxicity) weights from at most ``sample_rows`` labelled rows, chosen by a hash of
    their id; the sample's ids and labels are small enough to be broadcast by that bound."""
    chosen = random_sample(labels.select(F.col(id_col).alias("id"), "quality", "toxic").dropna(), "id", sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sample = labelled_features(rows.join(F.broadcast(chosen), "id").select(
        "id", "text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")))
    # rows that repeat an id must not take the sample over its bound, nor depend on a run's order
    found = sample.distinct().orderBy(F.xxhash64("id", "features"), "features", "quality", "toxic").limit(
        2 * sample_rows).collect()
    found.sort(key=lambda r: (r.features, r.quality, r.toxic))
    x = [np.frombuffer(r.features, np.int32) for r in found]
    return tuple(fit_logistic(x, np.array([r[c] for r in found], float)) for c in ("quality", "toxic"))


def score_documents(rows: DataFrame, models: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Replace the column ``text`` (binary) by the log odds ``z_quality`` and ``z_toxic``."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        quality, toxic = shared.value
        known = WordHashes()
        for batch in pieces(batches):
            x = [features(t, known) for t in texts_of(batch)]
            z = [[float(w[f].sum() + w[-1]) for f in x] for w in (quality, toxic)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(pa.array, z)],
                                             [*keep, "z_quality", "z_toxic"])

    schema = rows.drop("text").schema.add("z_quality", "double").add("z_toxic", "double")
    return rows.mapInArrow(run, schema)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def shrink(groups: DataFrame, of: str, prior: Column, out: str) -> DataFrame:
    """Posterior mean of the measure ``of`` in every group: (sum + k * prior) / (n + k).

    k makes the prior's variance equal to the variance between groups that sampling does not
    explain (moments of the group means); a single group, or no such variance, shrinks fully.
    """
    s, q = F.col(f"s_{of}"), F.col(f"q_{of}")
    mean, m = s / F.col("n"), prior
    stat = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * m).alias("pm"),
        F.sum(F.col("n") * (mean - m) * (mean - m)).alias("between"),
        F.sum(F.greatest(q - s * mean, F.lit(0.0))).alias("within")).first()
    k = 1e6
    if stat["n"] and stat["g"] > 1 and stat["n"] > stat["g"]:
        noise = stat["within"] / (stat["n"] - stat["g"])
        spread = (stat["between"] - noise * stat["g"]) / stat["n"]
        p = stat["pm"] / stat["n"]
        if spread > 0:
            k = min(1e6, max(1.0, p * (1 - p) / spread - 1))
    return groups.withColumn(out, (s + k * m) / (F.col("n") + k))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """((host, path, <measure>_host, <measure>_path), global mean of each measure) from rows of
    (host, path, quality, toxic), the two measures being probabilities."""
    paths = materialize(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c)).alias(f"s_{c}") for c in MEASURES],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in MEASURES]), "paths")
    sums = ["n", *[f"{x}_{c}" for x in "sq" for c in MEASURES]]
    total = paths.agg(*[F.sum(c).alias(c) for c in sums]).first()
    overall = {c: total[f"s_{c}"] / total["n"] if total["n"] else 0.5 for c in MEASURES}
    hosts = materialize(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in sums]), "hosts")
    for c in MEASURES:
        hosts = shrink(hosts, c, F.lit(overall[c]), f"{c}_host")
    hosts = materialize(hosts.drop(*sums), "host-posteriors")
    paths = materialize(keyed_join(paths, hosts, ["host"], "path"), "path-priors")
    for c in MEASURES:
        paths = shrink(paths, c, F.col(f"{c}_host"), f"{c}_path")
    return paths.drop(*sums), overall


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang", sample_rows: int = 8000,
             carry: bool = False) -> DataFrame:
    """(id, evidence, host_posterior, path_posterior, p_quality, p_toxic, toxic_evidence,
    toxic_host_posterior, toxic_path_posterior, kept) of every row.

    ``evidence`` is the document's own log odds of quality, ``toxic_evidence`` of toxicity. With ``carry`` the whole row comes
    along as the struct ``doc``.
    """
    bounded_batches(docs.sparkSession)
    models = fit(docs, labels, id_col, text_col, sample_rows)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    doc = [F.struct(*docs.columns).alias("doc")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                       key(host_col).alias("host"), key(path_col).alias("path"), *doc)
    scored = materialize(score_documents(rows, models), "scored")
    sites, overall = site_posteriors(scored.select("host", "path", *[sigmoid(F.col(f"z_{c}")).alias(c) for c in MEASURES]))
    joined = keyed_join(scored, materialize(sites, "sites"), ["host", "path"], "id")
    moved = [sigmoid(F.col(f"z_{c}") + logit(F.col(f"{c}_path")) - logit(F.lit(overall[c]))).alias(f"p_{c}")
             for c in MEASURES]
    out = joined.select(
        F.col("id").alias(id_col), F.col("z_quality").alias("evidence"),
        F.col("quality_host").alias("host_posterior"), F.col("quality_path").alias("path_posterior"), *moved,
        F.col("z_toxic").alias("toxic_evidence"), F.col("toxic_host").alias("toxic_host_posterior"),
        F.col("toxic_path").alias("toxic_path_posterior"), *[c for c in ("doc",) if carry])
    return out.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5))
