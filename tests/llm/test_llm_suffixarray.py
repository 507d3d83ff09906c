import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import suffixdedup
from panelspark.llm.suffixarray import by_doubling, permuted_prefixes, reaches, suffix_array


def sorted_suffixes(text):
    text = text.tolist()
    return sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("letters", [1, 2, 3, 26, 2000])
def test_against_sorting(letters):
    r = np.random.default_rng(letters)
    for n in [*range(1, 25), 100, 400]:
        text = np.append(r.integers(1, letters + 1, n), 0)
        order = suffix_array(text)
        assert order.tolist() == sorted_suffixes(text)
        assert by_doubling(text).tolist() == order.tolist()
        got = permuted_prefixes(text, order, 11)
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert got[b] == min(k, 11)


def test_recursion_on_repeats():
    text = np.append(np.tile(np.frombuffer(b"the cat sat on the mat. ", np.uint8).astype(int) + 2, 40), 0)
    assert suffix_array(text).tolist() == sorted_suffixes(text)


def test_stable_sorts_are_by_radix(monkeypatch):
    """numpy sorts 16-bit keys by radix; wider ones only where their order among equals is free."""
    kinds, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **options: (kinds.append((x.dtype.itemsize, options.get("kind"))),
                                                             sort(x, **options))[1])
    r = np.random.default_rng(4)
    text = np.append(r.integers(1, 250, 6000), 0)
    order = suffix_array(text)
    assert order.tolist() == sorted_suffixes(text) == by_doubling(text).tolist()
    assert (8, None) in kinds and all(size == 2 for size, kind in kinds if kind == "stable")


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_reaches_against_prefixes(letters):
    r = np.random.default_rng(letters)
    for n in [*range(1, 25), 400]:
        text = np.append(r.integers(1, letters + 1, n), 0)
        order = suffix_array(text)
        for length in (1, 2, 3, 4, 7, 8, 11, 50):
            assert reaches(text, order, length).tolist() == (permuted_prefixes(text, order, length) >= length).tolist()


def some_texts():
    r = np.random.default_rng(4)
    return [bytes(r.integers(97, 101, n).astype(np.uint8)) for n in [50, 51, 50, 4000, 200_000, 50, *[300] * 2000]]


def test_texts_side_by_side_have_the_runs_of_each_alone(monkeypatch):
    """Texts are hashed in few calls, and no run reaches into the next text."""
    texts, calls, plain = some_texts(), [], suffixdedup.gram_hashes
    alone = [(i, *r) for i, t in enumerate(texts) for r in zip(*[x.tolist() for x in suffixdedup.runs_of(
        np.frombuffer(t, np.uint8), np.array([0, len(t)]), 50, 16)[1:4]])]
    monkeypatch.setattr(suffixdedup, "gram_hashes", lambda *x: calls.append(1) or plain(*x))
    found = []
    for first, stop, data, edges in suffixdedup.side_by_side(pa.array([b"", *texts], pa.binary())[1:]):
        assert data.tobytes() == b"".join(texts[first:stop])
        _, anchor, start, n, text = suffixdedup.runs_of(data, edges, 50, 16)
        found += zip((text + first).tolist(), anchor.tolist(), (start - edges[text]).tolist(), n.tolist())
    assert found == alone and len(calls) < 20
    assert sum(n for *_, n in found) == sum(len(t) - 49 for t in texts)


def test_buckets_of_anchors_are_even():
    for _, _, data, edges in suffixdedup.side_by_side(pa.array(some_texts()[4:5], pa.binary())):
        anchors = np.unique(suffixdedup.runs_of(data, edges, 50, 16)[1])
        size = np.diff(suffixdedup.bucket_edges(anchors, 16))
        assert len(anchors) > 5000 and size.min() > 0.5 * size.mean() and size.max() < 2 * size.mean()
