"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled; neighbouring words vote through learned transitions, so texts
that change language in their course are labelled piece by piece. A word (a run of letters,
lower-cased) scores each language by

* affixes: its first and last one to four letters,
* n-grams: all runs of one to three letters,
* lexicon: in how many training texts of each language it occurs, as the log posterior of the
  language, weighted by how often the word is seen at all.

Forward-backward gives the probability of each language at each word; a text's prediction is
the language with the largest sum of these probabilities, weighted by letters, and its score
that sum's share of all letters.

Learning. The lexicon is counted over all training texts, in ``LEXICON_SLOTS`` slots by hash
(words that share a slot share its counts). Weights are fitted on a bounded sample: about
``sample_texts`` texts of each language, chosen by a hash of the text, ``WINDOWS`` windows of
``WINDOW_WORDS`` words of each, evenly spaced over it. The windows are cut into pieces and chained
across languages, so that the transitions see changes. ``SHARDS`` tasks climb the gradient of the
conditional likelihood on their share, the mean of their weights starts the next round. The
lexicon of a training word leaves out the word's own text.

Sizes: the model has (buckets + slots) x languages numbers, is broadcast, and a shard's weights
come to the driver; nothing else does. Texts are read in stretches of about 2 MB (a longer text
alone); forward-backward cuts a stretch into blocks, so a very long text costs no more a word.

Defined results: a text that is missing or has no letter is ``und`` with score 0, and so is
every text if nothing was learned; texts whose language is missing are not learned from; of
languages with equal sums the first by code point is taken; rows that repeat are judged one by
one; rows without an id are never held out; an empty table gives an empty result; other columns
are not read. Languages are few: the forward-backward pass costs their square a word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from panelspark.llm.common import bounded_batches, pieces
from panelspark.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
LEXICON_SLOTS = 1 << 18
LEVELS = 6                 # how often a word is seen: 0, 1, 2-3, 4-7, 8-15, 16 or more texts
WINDOWS, WINDOW_WORDS = 2, 24
SEQUENCE, BATCH = 48, 32
SHARDS, ROUNDS, EPOCHS = 6, 3, 2
CACHE_WORDS = 200_000
BLOCK = 128


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (never without an id)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; runs without an alphabetic character are no words."""
    return [w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def slot_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % LEXICON_SLOTS


# ---------------------------------------------------------------- features


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every affix and n-gram feature of ``words``."""
    sizes = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    first, last = np.zeros(len(chars), bool), np.zeros(len(chars), bool)
    first[starts], last[starts + sizes - 1] = True, True
    who, what = [], []

    def put(mask, h, kind):
        mixed = (h ^ np.uint64(kind * 0x9E3779B1)) * np.uint64(0xFF51AFD7ED558CCD)
        who.append(of[:len(h)][mask])
        what.append((mixed[mask] >> np.uint64(40)) % np.uint64(BUCKETS))

    h = np.zeros(len(chars), np.uint64)
    for n in range(1, 5):
        reach = len(chars) - n + 1
        if reach <= 0:
            break
        h = h[:reach] * np.uint64(0x100000001B3) + chars[n - 1:] + np.uint64(1)
        inside = of[:reach] == of[n - 1:]
        if n <= 3:
            put(inside, h, n)
        put(inside & first[:reach], h, 10 + n)
        put(inside & last[n - 1:], h, 20 + n)
    return np.concatenate(who), np.concatenate(what).astype(np.int64)


@dataclass
class Model:
    """Languages by code point; weights of buckets, of lexicon levels, of starts and transitions;
    the lexicon's texts per slot and language."""

    langs: list[str]
    buckets: np.ndarray
    levels: np.ndarray
    start: np.ndarray
    move: np.ndarray
    lexicon: np.ndarray

    @staticmethod
    def blank(langs: list[str], lexicon: np.ndarray) -> "Model":
        k = len(langs)
        return Model(langs, np.zeros((BUCKETS, k)), np.full(LEVELS, 0.5), np.zeros(k), np.zeros((k, k)), lexicon)

    def weights(self) -> list[np.ndarray]:
        return [self.buckets, self.levels, self.start, self.move]

    def evidence(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log posterior of the languages, level) for rows of texts per language."""
        total = seen.sum(axis=1)
        post = np.log((seen + 0.1) / (total + 0.1 * len(self.langs))[:, None])
        return post - post.mean(axis=1, keepdims=True), np.minimum(
            np.ceil(np.log2(np.maximum(total, 0) + 1)).astype(int), LEVELS - 1)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the languages for each word, whatever its neighbours."""
        out = np.zeros((len(words), len(self.langs)))
        if words:
            who, what = features(words)
            for j in range(len(self.langs)):
                out[:, j] = np.bincount(who, self.buckets[what, j], len(words))
            post, level = self.evidence(self.lexicon[[slot_of(w) for w in words]].astype(float))
            out += post * self.levels[level][:, None]
        return out


# ---------------------------------------------------------------- forward-backward


def posteriors(scores: np.ndarray, starts: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of every label at every position of chains laid end to end.

    ``scores`` are the emissions of all positions, ``starts`` the first position of each chain. The
    positions are cut into blocks of ``BLOCK``. The product of a block's step matrices carries the
    forward message over the block (the backward one likewise), so the blocks' first messages
    need one small product each, and all blocks are then filled in side by side.
    """
    n, k = scores.shape
    if not n:
        return scores
    lanes = -(-n // BLOCK)
    e = np.ones((lanes * BLOCK, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = e.reshape(lanes, BLOCK, k)
    begins = np.zeros(lanes * BLOCK, bool)
    begins[starts] = True
    begins[n:] = True
    begins = begins.reshape(lanes, BLOCK)
    fresh = np.exp(start - start.max())
    step = np.exp(move - move.max())
    reset = np.broadcast_to(fresh, (k, k))

    def matrices(t):      # the message before position t, times this, is the message after it
        return np.where(begins[:, t, None, None], reset, step) * e[:, t, None, :]

    whole = np.broadcast_to(np.eye(k), (lanes, k, k))
    for t in range(BLOCK):
        whole = whole @ matrices(t)
        whole = whole / whole.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.ones((lanes, k)) / k, np.ones((lanes, k)) / k
    for i in range(1, lanes):
        v = ahead[i - 1] @ whole[i - 1]
        ahead[i] = v / v.sum()
    for i in range(lanes - 1, 0, -1):
        v = whole[i] @ behind[i]
        behind[i - 1] = v / v.sum()
    forward = np.empty((lanes, BLOCK, k))
    a = ahead
    for t in range(BLOCK):
        a = np.where(begins[:, t, None], fresh, a @ step) * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    b = behind
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= b
        v = e[:, t] * b
        b = np.where(begins[:, t, None], 1.0, v @ step.T)
        b = b / b.sum(axis=1, keepdims=True)
    out = forward.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def expectations(scores: np.ndarray, start: np.ndarray, move: np.ndarray):
    """(label probabilities, pairs of neighbouring labels summed, log normaliser) of chains of one
    length, ``scores`` being [chain, position, label]."""
    b, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, step = np.exp(scores - top), np.exp(move)
    forward, scale = np.empty((b, t, k)), np.empty((b, t))
    for i in range(t):
        a = (np.exp(start) if i == 0 else forward[:, i - 1] @ step) * e[:, i]
        scale[:, i] = a.sum(axis=1)
        forward[:, i] = a / scale[:, i, None]
    back, pairs = np.ones((b, k)), np.zeros((k, k))
    labels = np.empty((b, t, k))
    for i in range(t - 1, -1, -1):
        labels[:, i] = forward[:, i] * back
        if i:
            v = e[:, i] * back / scale[:, i, None]
            pairs += (forward[:, i - 1].T @ v) * step
            back = v @ step.T
    return labels, pairs, float(np.log(scale).sum() + top.sum())


# ---------------------------------------------------------------- learning


def count_words(langs: list[str]):
    """Rows (slot, language number, texts) of a task: in how many texts words of a slot occur."""
    number = {name: i for i, name in enumerate(langs)}

    def run(batches):
        counts = None
        for batch in pieces(batches):
            counts = np.zeros((LEXICON_SLOTS, len(langs)), np.int64) if counts is None else counts
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                slots = np.unique(np.array([slot_of(w) for w in set(words_of(text))], np.int64))
                counts[slots, number[lang]] += 1
        if counts is not None:
            slot, lang = np.nonzero(counts)
            for a in range(0, len(slot), 100_000):
                s, j = slot[a:a + 100_000], lang[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(j), pa.array(counts[s, j])], ["slot", "lang", "n"])

    return run


def cut_windows(batches):
    """Rows (lang, place, words) of evenly spaced windows of the texts."""
    for batch in pieces(batches):
        out = []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words = words_of(text)
            slack = max(0, len(words) - WINDOW_WORDS)
            for i in range(WINDOWS if slack else 1):
                own = words[slack * i // max(1, WINDOWS - 1):][:WINDOW_WORDS]
                if own:
                    joined = " ".join(own)
                    out.append((lang, xxhash.xxh3_64_intdigest(joined.encode("utf-8", "surrogatepass")) >> 1, joined))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.string())], ["lang", "place", "words"])


def chains(windows: list[tuple[int, list[str]]], rng) -> tuple[list[str], np.ndarray]:
    """Words and labels of pieces of the windows in random order, a whole number of sequences."""
    parts = []
    for lang, words in windows:
        while words:
            n = int(rng.geometric(1 / 12))
            parts.append((lang, words[:n]))
            words = words[n:]
    flat, labels = [], []
    for i in rng.permutation(len(parts)):
        flat += parts[i][1]
        labels += [parts[i][0]] * len(parts[i][1])
    n = -(-len(flat) // SEQUENCE) * SEQUENCE     # the last sequence is filled up from the first
    at = np.arange(n) % max(1, len(flat))
    return [flat[i] for i in at], np.array(labels, np.int64)[at]


def climb(model: Model, windows: list[tuple[int, list[str]]], seed: int) -> int:
    """Adagrad steps on the conditional likelihood of a shard's chains; returns its words."""
    rng, rate, l2 = np.random.default_rng(seed), 0.2, 1e-6
    k, squares, done = len(model.langs), [np.full(w.shape, 1e-8) for w in model.weights()], 0
    for _ in range(EPOCHS):
        words, labels = chains(windows, rng)
        for a in range(0, len(words), SEQUENCE * BATCH):
            own, y = words[a:a + SEQUENCE * BATCH], labels[a:a + SEQUENCE * BATCH]
            who, what = features(own)
            seen = model.lexicon[[slot_of(w) for w in own]].astype(float)
            seen[np.arange(len(own)), y] = np.maximum(0, seen[np.arange(len(own)), y] - 1)
            post, level = model.evidence(seen)
            scores = post * model.levels[level][:, None]
            for j in range(k):
                scores[:, j] += np.bincount(who, model.buckets[what, j], len(own))
            found, pairs, _ = expectations(scores.reshape(-1, SEQUENCE, k), model.start, model.move)
            miss = -found.reshape(-1, k)
            miss[np.arange(len(own)), y] += 1
            chain = y.reshape(-1, SEQUENCE)
            gold = np.zeros((k, k))
            np.add.at(gold, (chain[:, :-1].ravel(), chain[:, 1:].ravel()), 1)
            n = len(own)
            touched, at = np.unique(what, return_inverse=True)
            bucket = np.stack([np.bincount(at, miss[who, j], len(touched)) for j in range(k)], axis=1) / n
            bucket -= l2 * model.buckets[touched]
            squares[0][touched] += bucket * bucket
            model.buckets[touched] += rate * bucket / np.sqrt(squares[0][touched])
            for w, s, g in ((model.levels, squares[1], np.bincount(level, (miss * post).sum(axis=1), LEVELS) / n),
                            (model.start, squares[2], miss.reshape(-1, SEQUENCE, k)[:, 0].sum(axis=0) / n),
                            (model.move, squares[3], (gold - pairs) / n)):
                s += g * g
                w += rate * g / np.sqrt(s)
            done += n
    return done


def pack(model: Model) -> bytes:
    return np.concatenate([w.ravel() for w in model.weights()]).astype(np.float32).tobytes()


def unpack(data: np.ndarray, model: Model) -> Model:
    parts, at = [], 0
    for w in model.weights():
        parts.append(data[at:at + w.size].reshape(w.shape).astype(float))
        at += w.size
    return Model(model.langs, *parts, model.lexicon)


def learn(texts: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_texts: int = 2000) -> Model | None:
    """A model of the languages of ``texts``; None if no text has a language."""
    spark = texts.sparkSession
    bounded_batches(spark)
    rows = texts.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    counted = rows.mapInArrow(count_words(langs), "slot long, lang long, n long").groupBy("slot", "lang").agg(
        F.sum("n").alias("n")).toArrow()
    lexicon = np.zeros((LEXICON_SLOTS, len(langs)), np.float32)
    lexicon[counted["slot"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    # about as many texts of every language, chosen by a hash; copies of a text are chosen together
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, float(sample_texts) / sizes[n])])[F.col("lang")]
    place = F.pmod(F.xxhash64(F.lit(12), "text"), F.lit(1 << 32)) / float(1 << 32)
    windows = rows.where(place < share).mapInArrow(cut_windows, "lang string, place long, words string")
    windows = windows.groupBy("lang", "place", "words").count().drop("count")   # a window that repeats counts once
    windows = materialize(windows.withColumn("shard", F.pmod("place", F.lit(SHARDS))), "windows")
    model = Model.blank(langs, lexicon)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(key, table):
            start = shared.value
            own = Model(start.langs, *[w.copy() for w in start.weights()], start.lexicon)
            number = {name: i for i, name in enumerate(own.langs)}
            found = sorted(zip(table["lang"].to_pylist(), table["place"].to_pylist(), table["words"].to_pylist()))
            n = climb(own, [(number[lang], words.split(" ")) for lang, _, words in found],
                      1000 * turn + key[0].as_py())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()),
                             "weights": pa.array([pack(own)], pa.binary())})

        found = windows.groupBy("shard").applyInArrow(run, "shard long, n long, weights binary").collect()
        found.sort(key=lambda r: r.shard)
        total = sum(r.n for r in found)
        if not total:
            break
        mean = sum(np.frombuffer(r.weights, np.float32).astype(float) * (r.n / total) for r in found)
        model = unpack(mean, model)
    return model


# ---------------------------------------------------------------- prediction


class Scorer(dict):
    """Word to its row in a table of emissions, for the words of one task."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((0, len(model.langs)))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.table = self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            at = len(self.table)
            self.table = np.concatenate([self.table, self.model.emissions(new)])
            self.update(zip(new, range(at, at + len(new))))
        return self.table[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def spans_of(labels: np.ndarray, starts: np.ndarray, langs: list[str]) -> list[list[dict]]:
    """Runs of equal labels of every chain as (lang, first word, word after the last)."""
    out = []
    for a, z in zip(starts, [*starts[1:], len(labels)]):
        own = labels[a:z]
        cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        out.append([{"lang": langs[own[s]], "start": s, "stop": e} for s, e in zip(cut, cut[1:])])
    return out


def identify(texts: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text",
             with_spans: bool = False) -> DataFrame:
    """(id, lang_pred, score) of every row, and with ``with_spans`` the runs of words of one
    language, by word numbers: array of (lang, start, stop)."""
    bounded_batches(texts.sparkSession)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        model = shared.value
        scorer = model and Scorer(model)
        for batch in pieces(batches):
            words = [words_of(t) if model else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            filled = np.flatnonzero(sizes)
            names, score, spans = ["und"] * len(words), np.zeros(len(words)), [[] for _ in words]
            if len(filled):
                flat = [w for own in words for w in own]
                starts = (np.cumsum(sizes) - sizes)[filled]
                p = posteriors(scorer.of(flat), starts, model.start, model.move)
                letters = np.fromiter(map(len, flat), float, len(flat))
                sums = np.add.reduceat(p * letters[:, None], starts, axis=0)
                best = sums.argmax(axis=1)
                score[filled] = np.clip(sums[np.arange(len(best)), best] / sums.sum(axis=1), 0, 1)
                for i, j in zip(filled, best):
                    names[i] = model.langs[j]
                if with_spans:
                    for i, s in zip(filled, spans_of(p.argmax(axis=1), starts, model.langs)):
                        spans[i] = s
            extra = [pa.array(spans, kind)] if with_spans else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), pa.array(score), *extra],
                                             ["id", "lang_pred", "score", *["spans"][:len(extra)]])

    schema = rows.select("id").schema.add("lang_pred", "string").add("score", "double")
    if with_spans:
        schema = schema.add("spans", ArrayType(StructType().add("lang", "string").add("start", "long").add("stop", "long")))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
