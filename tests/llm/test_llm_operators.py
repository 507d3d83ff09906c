"""Every operator against its plain Python version, on awkward rows, on a small table and on none."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from llm_paths import SF
from pyspark.sql import functions as F

from panelspark.llm import chat, decontam, linededup, lmscore, mixing, neardup, quality, rules, suffixdedup
from panelspark.llm.common import WordHashes
from panelspark.llm.queries import QUERIES


def multiset(rows):
    return Counter(map(tuple, rows))


# ---------------------------------------------------------------- mixing


def check_mix(found, rows):
    want = Counter((r["doc_id"], *w[:2], round(w[2], 4)) for r, w in zip(rows, brute.mix(rows)))
    assert Counter((r.doc_id, r["size"], r.source_size, round(r["target"], 4)) for r in found) == want
    taken, target = Counter(), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mix(awkward, rows, none, spark, sf_rows):
    found = mixing.mix_sources(awkward, rows_per_range=4)
    assert found.columns == [c for c in awkward.columns if c not in mixing.OUT] + mixing.OUT
    found = found.collect()
    check_mix(found, rows)
    again = mixing.mix_sources(awkward.repartition(3), rows_per_range=50).collect()
    key = lambda r: (r.doc_id, r.text, r.source, r.taken, r.copies)
    assert multiset(map(key, found)) == multiset(map(key, again))
    check_mix(mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect(), sf_rows)
    assert mixing.mix_sources(none).collect() == []


def test_mix_by_name_and_emitted(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 5 else "b") for i in range(10)], "doc_id int, text string, source string")
    mixed = mixing.mix_sources(docs, weights={"a": 2.3, "b": 0.7}, share=1.0)
    got = {r.source: r.s for r in mixed.groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    assert abs(got["a"] - 76) <= 1 and abs(got["b"] - 23) <= 1
    copies = mixing.emit_mix(mixed).withColumn("n", F.size(F.split(F.trim("text"), " +")))
    emitted = {r.source: r.s for r in copies.groupBy("source").agg(F.sum("n").alias("s")).collect()}
    assert emitted == got
    assert mixing.mix_sources(docs, weights={"a": 1.0}).where("source = 'b' AND taken > 0").count() == 0


# ---------------------------------------------------------------- line dedup


def test_lines(awkward, rows, none, spark, sf_rows):
    key = lambda r: (r.doc_id, r.n_lines, r.n_dropped, r.text)
    assert multiset(map(key, linededup.dedup_lines(awkward).collect())) == multiset(brute.lines(rows))
    three = linededup.dedup_lines(awkward, min_docs=3, min_chars=4).collect()
    assert multiset(map(key, three)) == multiset(brute.lines(rows, 4, 3))
    found = linededup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert multiset(map(key, found)) == multiset(brute.lines(sf_rows))
    assert linededup.dedup_lines(none).collect() == []


# ---------------------------------------------------------------- LM scoring


def check_scores(found, rows):
    want = {}
    for w in brute.base_scores(rows):
        want.setdefault((w[0], w[2], w[3]), []).append(w)
    assert len(found) == len(rows)
    for r in found:
        w = want[r.doc_id, r.n_tokens, r.n_known][0]
        assert (r.held_out, r.train_tokens) == (w[1], w[4])
        assert r.base_score == pytest.approx(w[5], abs=1e-6)
        assert r.score <= 0


@pytest.mark.parametrize("options", [{}, {"head_words": 5}, {"max_filter_bytes": 1}])
def test_scores(awkward, rows, options, monkeypatch):
    if "max_filter_bytes" in options:  # several blocks, one pass for each
        monkeypatch.setattr(lmscore, "TEXT_BYTES_PER_BLOCK", 1 << 15)
    found = lmscore.score_corpus(awkward, **options).collect()
    check_scores(found, rows)


def test_scores_in_passes_are_the_same(awkward, monkeypatch):
    monkeypatch.setattr(lmscore, "TEXT_BYTES_PER_BLOCK", 1 << 15)
    key = lambda r: (r.doc_id, r.n_tokens, round(r.score, 6))
    whole = lmscore.score_corpus(awkward).collect()
    parts = lmscore.score_corpus(awkward, max_filter_bytes=1).collect()
    assert multiset(map(key, whole)) == multiset(map(key, parts))


def test_scores_of_a_table(spark, sf_rows, none):
    found = lmscore.score_corpus(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check_scores(found, sf_rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # pairs tell more than words
    assert lmscore.score_corpus(none).collect() == []


def test_filter_counts():
    import numpy as np

    keys = lmscore.mix64(np.arange(5000, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 3000, 5000)
    level = lmscore.levels(counts)
    assert level[counts == 1].tolist() == [1] * int((counts == 1).sum()) and lmscore.levels(np.array([2, 3, 4])).tolist() == [2, 2, 3]
    # what a task fills is what a probe finds, but for rare errors upwards
    import pyarrow as pa

    table = pa.table({"block": pa.array([0, 0], pa.int32()), "size": pa.array([1, 2], pa.int32()),
                      "keys": pa.array([np.sort(keys).tobytes(), b""], pa.binary()),
                      "counts": pa.array([counts[np.argsort(keys)].astype(np.uint32).tobytes(), b""], pa.binary())})
    row = lmscore.block_filter(table).to_pylist()[0]
    found = lmscore.Filter(1, [(0, row["bits"])]).levels(keys)
    assert (found >= level).all() and (found > level).mean() < 0.05
    other = lmscore.Filter(1, [(0, row["bits"])]).levels(lmscore.mix64(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)))
    assert (other > 0).mean() < 0.05


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(awkward, rows, size):
    found = neardup.near_duplicates(awkward, words_per_shingle=size).collect()
    want = brute.near_components(rows, size)
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in found) == multiset(want)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_near_duplicates_rest(awkward, rows):
    """Without rounds everything is left to the exact comparison of the rest."""
    found = neardup.near_duplicates(awkward, words_per_shingle=2, rounds=0).collect()
    want = brute.near_components(rows, 2)
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in found) == multiset(want)


def test_near_duplicates_of_a_table(spark, sf_rows, none):
    found = neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), words_per_shingle=2).collect()
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in found) == multiset(brute.near_components(sf_rows, 2))
    assert neardup.near_duplicates(none).collect() == []


def test_keep_one(awkward, rows, none):
    kept = neardup.keep_one(awkward, words_per_shingle=5)
    assert kept.columns == awkward.columns
    found = kept.collect()
    ids = Counter(r.doc_id for r in found)
    want = {(d, c) for d, _, c in brute.near_components(rows, 5)}
    assert {d for d in ids if d is not None} == {d for d, c in want if d is not None and d == c}
    assert ids[None] == 2 and ids[6] == 2  # repeated rows are one, another text of that id stays
    assert neardup.keep_one(none).collect() == []


# ---------------------------------------------------------------- suffix dedup


def test_substrings(awkward, rows, none, spark, sf_rows):
    key = lambda r: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
    assert multiset(map(key, suffixdedup.dedup_substrings(awkward).collect())) == multiset(brute.substrings(rows))
    short = suffixdedup.dedup_substrings(awkward, length=20, gram=8).collect()
    assert multiset(map(key, short)) == multiset(brute.substrings(rows, 20))
    found = suffixdedup.dedup_substrings(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert multiset(map(key, found)) == multiset(brute.substrings(sf_rows))
    assert suffixdedup.dedup_substrings(none).collect() == []


def in_contexts(n):
    """Texts that share a passage, each within words of its own; some hold a part of it only."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    return [" ".join([word(), word(), word(), passage[7 * (i % 3):len(passage) - 5 * (i % 4)], word(), word(), word()])
            for i in range(n)]


def test_substrings_of_a_passage_in_many_contexts(spark, awkward, rows):
    key = lambda r: tuple(r[:4]) + (bytes(r[4]),)
    texts = in_contexts(300)
    table = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = multiset(brute.substrings(table))
    assert multiset(map(key, suffixdedup.dedup_substrings(docs).collect())) == want
    assert multiset(map(key, suffixdedup.dedup_substrings(docs, split_runs=20).collect())) == want
    found = suffixdedup.dedup_substrings(awkward, split_runs=5).collect()
    assert multiset(map(key, found)) == multiset(brute.substrings(rows))


def test_texts_whose_hashes_agree_in_31_bits(spark):
    """Two texts that share a string with nobody else are compared whatever their hashes share."""
    passage = "the quick brown fox jumps over the lazy dog and then some more words follow it here "
    for pair in ((222690, 296546), (222690, 222691)):
        table = [{"doc_id": i, "text": f"{passage}{n}"} for i, n in enumerate(pair)]
        found = suffixdedup.dedup_substrings(spark.createDataFrame(table, "doc_id long, text string"))
        assert multiset((*r[:4], bytes(r[4])) for r in found.collect()) == multiset(brute.substrings(table))
        assert found.where("n_removed > 0").count() == 1


def test_no_anchor_gathers_the_runs_of_all_texts(spark):
    texts = in_contexts(1200)
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, token long")
    docs = docs.select(F.col("text").cast("binary").alias("text"), "token").repartition(2)
    packed = suffixdedup.anchor_rows(docs, 8, 50, 16)
    told = Counter(a for r in packed.where("bucket < 8").collect() for a in suffixdedup.from_planes(r.anchors, 6).tolist())
    assert max(told.values()) <= 100  # 1,200 texts hold the passage
    rows = suffixdedup.shared_anchors(packed, 8, 1000, 100).collect()
    split = np.array(sorted(r.anchor for r in rows if r.token is None))
    listed = {}
    for r in rows:
        if r.token is not None:
            listed.setdefault(r.token, set()).add(r.anchor)
    groups, shared = {}, {}
    for t, text in enumerate(t.encode() for t in texts):
        for a, _, start, stop in zip(*suffixdedup.shared_runs(text, sorted(listed[t]), split, 50, 16)):
            groups.setdefault(a, set()).add(text[start:stop])
            shared.setdefault(a, set()).add(t)
    assert max(map(len, shared.values())) > 600  # the passage is there
    assert max(map(len, groups.values())) <= 100


def test_substrings_in_few_and_many_groups(awkward, rows, monkeypatch):
    """Texts of one group and of as many as there are texts, anchors and runs in one bucket and in many."""
    key = lambda r: tuple(r[:4]) + (bytes(r[4]),)
    for groups, size in ((1, 1 << 30), (300, 300)):
        monkeypatch.setattr(suffixdedup, "LEAST_GROUPS", groups)
        monkeypatch.setattr(suffixdedup, "GROUP_BYTES", 1 << 30)
        monkeypatch.setattr(suffixdedup, "TEXT_BYTES_PER_BUCKET", size * 20)
        assert multiset(map(key, suffixdedup.dedup_substrings(awkward).collect())) == multiset(brute.substrings(rows))


def test_no_row_is_sent_for_a_run_or_a_token(awkward):
    """Texts are exchanged once, by their group; what goes between groups and buckets is packed."""
    plan = suffixdedup.dedup_substrings(awkward)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"group", "bucket"}
    assert "SortMergeJoin" not in plan and "Generate" not in plan


def test_what_a_group_tells_does_not_grow_with_buckets_or_copies():
    texts = [t.encode() for t in in_contexts(400)]
    table = pa.table({"group": pa.array([3] * 500, pa.int32()), "id": pa.array(range(500)),
                      "row": pa.array([i % 400 for i in range(500)]),
                      "text": pa.array([texts[i % 400] for i in range(500)], pa.binary())})
    copies = table.slice(400).select(["id", "row"])
    texts = [np.frombuffer(t, np.uint8) for t in texts]
    held = Counter(a for t in texts for a in set(suffixdedup.runs_of(t, np.array([0, len(t)]), 50, 16)[1].tolist()))
    own, of = suffixdedup.own_texts(table, copies)
    assert own.tolist() == list(range(400)) and of.tolist() == [*range(400), *[-1] * 100]
    told = {}
    for buckets in (1, 64):
        found = suffixdedup.group_anchors(table, copies, buckets, 50, 16)
        told[buckets] = sum(len(x) for c in ("anchors", "tokens", "holders", "several") for x in found.column(c).to_pylist())
        anchors = np.concatenate([suffixdedup.from_planes(x, 6) for x in found.column("anchors").to_pylist()])
        assert len(anchors) == len(set(anchors.tolist())) > 400
        # several texts hold these, and only this group does
        a, t, n, _ = map(np.concatenate, zip(*[suffixdedup.held_by_several(found.slice(i, 1), buckets, 4000)
                                               for i in range(len(found))]))
        assert set(t.tolist()) == {3} and set(n.tolist()) == {1} and set(a.tolist()) == {x for x, k in held.items() if k > 1}
    assert told[64] < told[1] + 64 * 10 and told[1] < 9 * len(anchors)


# ---------------------------------------------------------------- quality classifier


def test_classifier_finds_poor_and_toxic_documents(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = quality.classify(docs, labels.where(~part)).join(labels.where(part), "doc_id")
    got = {(r.quality, r.toxic, r.kept): r.n for r in found.groupBy("quality", "toxic", "kept").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n = lambda keep, of: sum(v for k, v in got.items() if of(k) and k[2] == keep)
    clean, bad = (lambda k: k[:2] == (1, 0)), (lambda k: k[:2] != (1, 0))
    assert n(True, clean) >= 0.98 * (n(True, clean) + n(False, clean))
    assert n(False, bad) >= 0.93 * (n(True, bad) + n(False, bad))


def test_classifier_on_awkward_rows(awkward, rows, none, spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (None, 1, 0), (31, None, 1), (-5, 1, 1), (30, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    found = quality.classify(awkward, labels, carry=True)
    got = found.collect()
    assert len(got) == len(rows) and all(r.kept is not None for r in got)
    assert found.select("doc.*").columns == awkward.columns
    assert quality.classify(none, labels).collect() == []
    assert all(r.kept for r in quality.classify(awkward, labels.limit(0)).collect())


def assert_judged_like_plain_python(docs, labels):
    """Posteriors, probabilities and verdicts of both measures from the documents' own log odds."""
    found = quality.classify(docs, labels, carry=True).collect()
    sites = [(r.doc.source, r.doc.lang) for r in found]
    good = brute.site_probabilities([(*s, r.evidence) for s, r in zip(sites, found)])
    toxic = brute.site_probabilities([(*s, r.toxic_evidence) for s, r in zip(sites, found)])
    for r, g, t in zip(found, good, toxic):
        assert (r.host_posterior, r.path_posterior, r.p_quality) == pytest.approx(g, abs=1e-9)
        assert (r.toxic_host_posterior, r.toxic_path_posterior, r.p_toxic) == pytest.approx(t, abs=1e-9)
        if min(abs(g[2] - 0.5), abs(t[2] - 0.5)) > 1e-9:
            assert r.kept == (g[2] >= 0.5 and t[2] <= 0.5)
    return found


def test_classifier_equals_plain_posteriors(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = assert_judged_like_plain_python(docs, labels)
    models = quality.fit(docs, labels)
    for r in found:
        f = quality.features((r.doc.text or "").encode(), WordHashes())
        assert [w[f].sum() + w[-1] for w in models] == pytest.approx([r.evidence, r.toxic_evidence], abs=1e-9)


def test_classifier_equals_plain_posteriors_on_awkward_rows(awkward, spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(1000, 1060)],
                                   "doc_id long, quality int, toxic int")
    assert_judged_like_plain_python(awkward, labels)


def test_a_toxic_site_moves_weak_evidence(spark):
    """Equal log odds are judged by the site's share of toxic documents; a lone document hardly moves."""
    data = [("bad", "x", 0.9, 0.9)] * 60 + [("good", "x", 0.9, 0.05)] * 300 + [("lone", "x", 0.9, 0.9)]
    found, overall = quality.site_posteriors(
        spark.createDataFrame(data, "host string, path string, quality double, toxic double"))
    got = {r.host: r for r in found.collect()}
    assert got["bad"].toxic_path > 0.8 > 0.1 > got["good"].toxic_path
    assert overall["toxic"] < got["lone"].toxic_path < got["bad"].toxic_path
    assert all(r.quality_path == pytest.approx(0.9) for r in got.values())


def test_sample_of_repeated_ids_is_the_same_on_every_run(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} and word{i * 7}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    one, two = (quality.fit(docs.repartition(n, "text"), labels, sample_rows=20) for n in (3, 11))
    assert all((a == b).all() for a, b in zip(one, two))


# ---------------------------------------------------------------- quality rules


def test_rules(awkward, rows, none):
    found = rules.judged_stats(awkward).collect()
    want = multiset((r["doc_id"], *brute.text_stats(r["text"])) for r in rows)
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    verdict = {(r.doc_id, r.text): r.failed_rule is None for r in found}
    lazy = rules.failed_rule(awkward).collect()
    assert {(r.doc_id, r.text): r.failed_rule is None for r in lazy} == verdict
    assert rules.judged_stats(none).collect() == []


def test_cascade_order_changes_no_verdict(awkward):
    own = rules.default_rules(rules.lazy_stats(F.col("text")))
    names = list(own)
    got = awkward.select(*[rules.cascade(own, order).isNull().alias(f"k{i}") for i, order in enumerate(
        (names, names[::-1], names[3:] + names[:3]))]).collect()
    assert all(r.k0 == r.k1 == r.k2 for r in got)
    assert rules.by_rejection_per_cost([("a", 2.0, 0.1), ("b", 0.1, 0.1), ("c", 0.1, 0.0)]) == ["b", "a", "c"]


def test_verdicts_by_hand(spark, awkward, rows):
    def passes(text):
        text = text or ""
        n, chars, symbols, dup, repeated = brute.text_stats(text)
        kinds = len({w for w in re.split(r"[\x20\x09-\x0D]+", text) if w})
        lines = text.split("\n")
        left = sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\Z", x)) for x in lines)
        return not (n < 10 or 100 * repeated > 20 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > n
                    or 10 * dup > 3 * len(lines) and dup > 1 or 10 * kinds < min(n, 1000) or len(set(text)) < 8
                    or 10 * left > 3 * len(lines) and left > 1)

    some = spark.createDataFrame([
        (1, "one two three four five six seven eight nine ten ..."), (2, "one two three four ...\nfive six seven \u2026 \nand eight nine ten"),
        (3, " ".join(["ab ba", "aab bba aba"] * 1 + ["abb baa bab abab"] * 1 + ["a b"])), (4, " ".join(f"w{i}" for i in range(5000))),
        (5, " ".join("abcdefgh"[i % 8] * (1 + i // 8 % 2) for i in range(40))), (6, None)], "doc_id long, text string")
    for docs, given in ((awkward, {(r["doc_id"], r["text"]) for r in rows}), (some, {(r.doc_id, r.text) for r in some.collect()})):
        found = {(r.doc_id, r.text): r.failed_rule is None for r in rules.judged_stats(docs).collect()}
        assert found == {k: passes(k[1]) for k in given}


def test_rejected_rows_skip_dear_rules(spark, monkeypatch):
    """A statistic that may not be computed for a row that an earlier rule rejects."""
    docs = spark.createDataFrame([(i, "too short" if i % 2 else " ".join(f"word{j}" for j in range(12))) for i in range(100)],
                                 "doc_id long, text string")
    monkeypatch.setitem(rules.DEAR, "guard", lambda text: F.when(
        text == "too short", F.raise_error(F.lit("computed")).cast("long")).otherwise(F.length(text).cast("long")))
    own = rules.base_rules(rules.held_stats(F.col("text"))) | {"guard": rules.held_stats(F.col("text"))["guard"] > 1000}
    held = docs.withColumns({k: f(F.col("text")) for k, f in rules.STATS.items()})
    found = held.withColumn("f", rules.cascade(own, ["few_words", "repeats", "guard"])).groupBy("f").count().collect()
    assert {r.f: r["count"] for r in found} == {"few_words": 50, None: 50}
    with pytest.raises(Exception, match="computed"):
        held.withColumn("f", rules.cascade(own, ["guard", "few_words", "repeats"])).collect()


# ---------------------------------------------------------------- chat


TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi ann 🙂"), (1, 3, "ann", None),
    (1, 3, "ann", "tie"), (1, 3, "ann", "tie"), (1, None, "carl", "first"), (2, 0, None, "who"), (2, 1, "", "nobody"),
    (2, 2, "user", ""), (3, 0, "system", "alone"), (None, 5, "ann", "lost"), (None, 6, "bob", "é" * 3000),
] + [(9, i, ["user", "assistant", "ann"][i % 3], f"turn {i}") for i in range(700)]


def test_chat(spark):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS],
                                  "conv_id long, turn long, role string, text string, at string, part int").repartition(4)
    found = chat.perspectives(turns).collect()
    want = brute.views([dict(zip(("conv_id", "turn", "role", "text"), t)) for t in TURNS])
    assert multiset((r.conv_id, r.speaker, r.part, r.n_turns, r.n_own, r.text, tuple(map(tuple, r["mask"]))) for r in found) == multiset(want)
    for r in found:
        for a, z in r["mask"]:
            assert r.text[:a].endswith("<|assistant|>\n") and r.text[a:z].endswith("<|end|>")
    assert chat.perspectives(turns.limit(0)).collect() == []


# ---------------------------------------------------------------- decontamination


ITEMS = [(1, "alpha Beta gamma straße"), (2, None), (3, ""), (None, "one two"), (10, "the of"), (11, "... !!"),
         (12, " ".join(f"edit{i}" for i in range(30)))]


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_passages(spark, awkward, rows, sf_rows, most):
    own = [" ".join((next(r["text"] for r in rows if r["doc_id"] == 30)).split()[5:25]), "x " * 30]
    items = spark.createDataFrame(ITEMS + [(20, own[0]), (21, own[1])], "item_id int, text string")
    found = decontam.find_passages(awkward, items, max_windows=most).collect()
    want = brute.passages(rows, [r.asDict() for r in items.collect()])
    assert multiset((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == multiset(
        (*w[:3], tuple(w[3])) for w in want)


def test_decontaminate(spark, awkward, rows, none):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    clean = decontam.decontaminate(awkward, items)
    assert clean.columns == awkward.columns
    want = [w[0] for w in brute.passages(rows, [r.asDict() for r in items.collect()]) if not w[2]]
    assert Counter(r.doc_id for r in clean.collect()) == Counter(want)
    cut = decontam.decontaminate(awkward, items, remove="spans")
    assert cut.count() == len(rows)
    left = decontam.find_passages(cut, items.where("item_id = 10")).where("n_hit > 0")
    assert left.count() <= decontam.find_passages(awkward, items.where("item_id = 10")).where("n_hit > 0").count()
    assert decontam.decontaminate(none, items).collect() == []
    assert decontam.decontaminate(awkward, items.limit(0)).count() == len(rows)


def test_cut_words():
    assert decontam.cut_words(b"One, two three; four", [(1, 3)]) == b"One, ; four"
    assert decontam.cut_words(b"a b c", [(0, 1), (2, 3)]) == b" b "


# ---------------------------------------------------------------- registered queries


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
