"""Token-ID output: exact round trips of the coder, the words and whole datasets."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_paths import SF_MID
from tokenizers import Tokenizer

from panelspark.llm import rangecoder, tokenbin

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("block", [rangecoder.BLOCK, 4096])
@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 4097, 10_000])
@pytest.mark.parametrize("kind", ["random", "skewed", "equal", "cycle", "large"])
def test_coder_round_trip(n, kind, block, monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", block)
    r = np.random.default_rng(n)
    ids = {"random": r.integers(0, 49408, n), "skewed": r.zipf(1.5, n) % 49408, "equal": np.full(n, 49407),
           "cycle": np.arange(n) % 7, "large": r.integers(0, 300_000, n)}[kind].astype(np.int32)
    data = rangecoder.encode(ids, 300_000 if kind == "large" else 49408)
    assert (rangecoder.decode(data) == ids).all()
    if kind in ("equal", "cycle") and n >= 2048:
        assert len(data) < 0.2 * 2 * n


def test_blocks_are_read_alone(monkeypatch):
    """A block's words do not depend on the blocks before it."""
    monkeypatch.setattr(rangecoder, "BLOCK", 4096)
    r = np.random.default_rng(1)
    ids = (r.zipf(1.3, 3 * 4096) % 49408).astype(np.int32)
    other = ids.copy()
    other[:4096] = r.integers(0, 49408, 4096)
    size = len(rangecoder.encode(ids[4096:], 49408)) - 20 - 4 * (2 + 2 * 8)   # words of the last two blocks
    assert rangecoder.encode(ids, 49408)[-size:] == rangecoder.encode(other, 49408)[-size:]


def test_size_of_a_corpus():
    """Below a static order-0 code of all ids (8.36 bits an id), and well below deflate."""
    table = pq.read_table(f"{SF_MID}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    words = tokenbin.Words(Tokenizer.from_file(FILE))
    ids, _ = words.encode([(t or "").encode() for t in table.column("text").to_pylist()], 1)
    data = rangecoder.encode(ids, 49408)
    assert 8 * len(data) < 8.3 * len(ids)
    assert len(data) < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (rangecoder.decode(data) == ids).all()


def test_coder_finds_damage(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 2048)
    data = bytearray(rangecoder.encode(np.arange(5000, dtype=np.int32), 49408))
    data[-9] ^= 4
    with pytest.raises(ValueError, match="block 2 of 3"):
        rangecoder.decode(bytes(data))
    with pytest.raises(ValueError, match="not a segment"):
        rangecoder.decode(b"\0" * 64)


def test_words_are_the_tokenizers(rows):
    tokenizer = Tokenizer.from_file(FILE)
    texts = [r["text"] or "" for r in rows]
    words = tokenbin.Words(tokenizer)
    for part in (texts[:10], texts[10:], texts):
        ids, sizes = words.encode([t.encode() for t in part], 1)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in part]
        assert sizes.tolist() == list(map(len, want))
        assert ids.tolist() == [i for w in want for i in w]


class Counted:
    """A tokenizer that counts the words it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def get_vocab(self, **options):
        return self.tokenizer.get_vocab(**options)

    def __getattr__(self, name):
        def call(texts, **options):
            self.asked += [w for t in ([texts] if isinstance(texts, str) else texts) for w in t.split()]
            return getattr(self.tokenizer, name)(texts, **options)
        return call


def test_words_are_encoded_once():
    """A word is encoded once whatever marks close it, and for all tasks of a worker."""
    counted = Counted(Tokenizer.from_file(FILE))
    words = tokenbin.Words(counted)
    words.encode([b"The caf\xc3\xa9, the caf\xc3\xa9###", b"(the) caf\xc3\xa9. the"], 1)
    words.encode([b"the. caf\xc3\xa9!"], 1)
    assert sorted(counted.asked) == sorted(["the", "café", ",", "###", "(the)", ".", "!"])
    json = Tokenizer.from_file(FILE).to_str()
    assert tokenbin.words_of(json) is tokenbin.words_of(json)


def test_few_results_are_held_at_once():
    """What a task holds of the tokenizer's results, and of its texts, is bounded whatever its words are."""
    tokenizer, calls = Tokenizer.from_file(FILE), []

    class Counted:
        get_vocab = tokenizer.get_vocab

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **options)

    texts = [" ".join(f"w{i}x" for i in range(at, at + 1000)).encode() for at in range(0, 9000, 1000)]
    ids, sizes = tokenbin.Words(Counted()).encode(texts, 1)
    assert sum(calls) >= 9000 and max(calls) <= 2000
    want = [[*tokenizer.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    batch = pa.RecordBatch.from_pydict({"text": [b"x" * 4000] * 5000})
    found = [b.num_rows for b in tokenbin.stretches([batch])]
    assert sum(found) == 5000 and max(found) * 4000 <= 8 << 20


def test_words_of_any_kind_and_a_bound(monkeypatch):
    monkeypatch.setattr(tokenbin, "CACHE_WORDS", 2000)
    r = random.Random(3)
    bits = ["the", "É", "é", "İ", "ñó", "ß", "क़", "़", "'s", "'", "<|endoftext|>", "<|EndOfText|>", "<|", ".",
            ",", "###", "=", "\u0338", "\u0307", "\x1c", "\x85", " ", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "1",
            "Ω", "日本", "🙂", "Σ", "ΟΔΟΣ", "ﬁ", "가", "ᄀ", "ᅡ", "\x00", "_", "…", "ǅ", "ÿ", "÷", "×"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(4000)]
    tokenizer = Tokenizer.from_file(FILE)
    words = tokenbin.Words(tokenizer)
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        ids, sizes = words.encode([t.encode() for t in some], 1)
        want = [e.ids + [1] for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert len(words.known) < 2000 + 5 * 500 * 7
    assert words.known.unique() == words.known


def test_no_short_segment_at_the_end(spark, sf_rows, tmp_dir, monkeypatch):
    monkeypatch.setattr(tokenbin, "SEGMENT_IDS", 20_000)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in sf_rows], "doc_id long, text string")
    tokenbin.write_tokens(docs, f"{tmp_dir}/s", FILE)
    parts = {}
    for r in spark.read.parquet(f"{tmp_dir}/s").select("part", "n_ids").collect():
        parts.setdefault(r.part, []).append(r.n_ids)
    assert any(len(n) > 1 for n in parts.values())
    assert all(min(n) >= 20_000 for n in parts.values() if len(n) > 1)
    found = tokenbin.read_checksums(spark, f"{tmp_dir}/s").collect()
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected(sf_rows)


def expected(rows):
    tokenizer = Tokenizer.from_file(FILE)
    out, at = {}, 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        out[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_table(spark, sf_rows, tmp_dir, monkeypatch):
    monkeypatch.setattr(tokenbin, "SEGMENT_IDS", 20_000)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in sf_rows], "doc_id long, text string")
    tokenbin.write_tokens(docs.repartition(6), f"{tmp_dir}/t", FILE)
    found = tokenbin.read_checksums(spark, f"{tmp_dir}/t").collect()
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected(sf_rows)
    whole = {r.id: r for r in tokenbin.read_tokens(spark, f"{tmp_dir}/t").collect()}
    for r in found:
        assert zlib.crc32(bytes(whole[r.id].ids)) == r.ids_crc32 and len(whole[r.id].ids) == 4 * r.n_tokens


def test_awkward(spark, awkward, rows, none, tmp_dir):
    tokenbin.write_tokens(awkward, f"{tmp_dir}/a", FILE)
    found = sorted(tokenbin.read_tokens(spark, f"{tmp_dir}/a").collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    ids = [r.id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    tokenizer = Tokenizer.from_file(FILE)
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0,
                   tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in rows)
    assert sorted((r.id is not None, r.id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
    tokenbin.write_tokens(none, f"{tmp_dir}/n", FILE)
    assert tokenbin.read_checksums(spark, f"{tmp_dir}/n").collect() == []
