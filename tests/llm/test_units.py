"""Parts of the operators that need no Spark."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import katz, media, neardup, packing, quality, substrings
from llm.common import Words, runs_of, windows

TEXTS = ["", "one", "two words", " lead and  trail ", "tab\tnew\nline\x0bv\x0cf\rcr", "nbsp\u00a0stays é", None, "a " * 50]


def test_words():
    w = Words(pa.array(TEXTS))
    found = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[d], w.first[d + 1])] for d in range(len(TEXTS))]
    assert found == [(t or "").encode().split() for t in TEXTS]
    assert len(set(Words(pa.array(["x y", "y x"])).hashes().tolist())) == 2


def test_runs():
    """Equal runs have equal hashes, others different ones; also where a polynomial modulo 2^64 is known to fail."""
    v = np.arange(50, dtype=np.uint64) % 7
    for size in (1, 2, 3, 5, 8, 20):
        r = runs_of(v, size, 3)
        assert len(r) == 51 - size and len(set(r.tolist())) == 7 and r[0] == r[7]
    assert len(runs_of(v, 51, 3)) == 0
    thue = np.array([bin(i).count("1") % 2 for i in range(4096)], dtype=np.uint64)
    a, b = runs_of(thue, 2048, 3)[[0, 2048]]
    assert a != b


def test_span_hashes():
    data = np.frombuffer(b"abc abcdefgh abcdefghi abcdefghj abc " + b"x" * 100 + b" " + b"x" * 100 + b" " + b"x" * 101, np.uint8)
    w = Words(pa.array([data.tobytes().decode()]))
    h = w.hashes().tolist()
    assert h[0] == h[4] and h[5] == h[6] and len(set(h)) == 6 and not set(h) & set(w.hashes(2).tolist())
    t = "ab " * 5 + "é" * 40
    both = Words(pa.array([t, "zz " + t]))
    assert both.hashes()[: both.count[0]].tolist() == both.hashes()[both.count[0] + 1 :].tolist()


def test_long_texts_are_cut_in_stretches(monkeypatch):
    from llm import common

    whole = [Words(pa.array(TEXTS)).__dict__, quality.statistics(pa.array(TEXTS))]
    monkeypatch.setattr(common, "STRETCH", 3)
    monkeypatch.setattr(quality, "STRETCH", 3)
    cut = [Words(pa.array(TEXTS)).__dict__, quality.statistics(pa.array(TEXTS))]
    assert all(np.array_equal(whole[0][k], cut[0][k]) for k in whole[0]) and np.array_equal(whole[1], cut[1])


def test_windows_stay_within_documents():
    w = Words(pa.array(["a b c", "d e", "f g h i"]))
    start, _ = windows(w, w.hashes(), 3)
    assert start.tolist() == [0, 5, 6]


def test_memory_of_a_very_long_text():
    """20 MB in one text: what the operators hold besides it is bounded."""
    import tracemalloc

    from llm.tokens import encoder

    text = " ".join(f"w{i * 7919 % 100_003}" for i in range(2_900_000))
    texts = pa.array([text])
    e = encoder()

    def signed():
        neardup.dart_minhash(*neardup.shingles(texts), 125)

    def anchored():
        w = Words(texts)
        h = w.hashes()
        for part in substrings.parts_of(w, 19):
            substrings.anchors(part, h[part.a : part.b])

    for run, most in ((lambda: quality.statistics(texts), 350), (signed, 350), (anchored, 350), (lambda: e.encode([text[:4_000_000]]), 150)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, (run, peak)


def test_parts_of_long_documents(monkeypatch):
    """Each window of a document that is parsed in stretches has an anchor that equal windows share, as in one piece."""
    monkeypatch.setattr(substrings, "STRETCH", 16)
    text = " ".join("abcabdacbd"[i * i % 10] for i in range(300))
    w = Words(pa.array([text, text[20:150], "x y"]))
    h = w.hashes()
    places = collections.defaultdict(set)
    for part in substrings.parts_of(w, 5):
        at, name, lo, hi = substrings.anchors(part, h[part.a : part.b], window=6, phrase=3)
        for p in range(max(0, part.b - part.a - 5)):
            covering = frozenset((int(a - p), int(n)) for a, n, x, y in zip(at, name, lo, hi) if x <= p <= y and p <= a and a + 3 <= p + 6)
            places[tuple(h[part.a + p : part.a + p + 6].tolist())].add(covering)
    for found in places.values():
        assert frozenset.intersection(*found)


# ---- tokens ---------------------------------------------------------------------------------------------------------


@given(st.lists(st.text(max_size=60) | st.text(alphabet="abcéßÉ,.'!?<|>0 \n", max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoder_equals_the_library(texts):
    from llm.tokens import encoder

    e = encoder()
    assert [x.tolist() for x in e.encode(texts)] == [e.full.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_on_special_strings():
    from llm.tokens import encoder

    e = encoder()
    texts = ["Σίσυφος ΣΣ don't we're İstanbul a\u00a0b\u0085c <|endoftext|>x <|startoftext|> \x1c １２ ½ ǅ ẞ it'S Ÿ µ ª", "e\u0301 \u0301x", "soft\u00adhyphen"]
    assert [x.tolist() for x in e.encode(texts)] == [e.full.encode(t, add_special_tokens=False).ids for t in texts]


# ---- recompression --------------------------------------------------------------------------------------------------

SMALL = st.lists(st.lists(st.sampled_from("abc"), max_size=60).map(" ".join), min_size=1, max_size=5)


@given(SMALL)
@settings(max_examples=150, deadline=None)
def test_equal_contexts_make_equal_symbols(texts):
    """A symbol whose context lies within a stretch is there in every equal stretch, at every level."""
    w = Words(pa.array(texts))
    h = w.hashes()
    for s in substrings.parse(w, h):
        known = {(int(a), int(b)) for a, b in zip(s.start, s.end)}
        for a, b, lo, hi, d in zip(s.start, s.end, s.lo, s.hi, s.doc):
            if lo < w.first[d] or hi > w.first[d + 1]:
                continue
            span = h[lo:hi].tolist()
            for other in range(len(h) - len(span) + 1):
                same_doc = w.doc[other] == w.doc[other + len(span) - 1]
                if same_doc and h[other : other + len(span)].tolist() == span:
                    assert (other + a - lo, other + b - lo) in known


@given(SMALL)
@settings(max_examples=100, deadline=None)
def test_equal_windows_have_equal_anchors(texts):
    w = Words(pa.array(texts))
    h = w.hashes()
    at, name, lo, hi = substrings.anchors(w, h, window=6, phrase=3)
    places = collections.defaultdict(set)
    for d in range(len(texts)):
        for p in range(w.first[d], w.first[d + 1] - 5):
            covering = frozenset((int(a - p), int(n)) for a, n, x, y in zip(at, name, lo, hi) if x <= p <= y and p <= a and a + 3 <= p + 6)
            places[tuple(h[p : p + 6].tolist())].add(covering)
    for found in places.values():
        assert frozenset.intersection(*found)  # one anchor, at least, in all equal windows


# ---- near-duplicates ------------------------------------------------------------------------------------------------


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    k = 4000
    for n, shared in ((40, 30), (300, 100), (3, 2)):
        elements = rng.integers(1, 1 << 62, n + (n - shared)).astype(np.uint64)
        a, b = elements[:n], elements[n - shared :]
        sig = neardup.dart_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), k)
        assert abs((sig[0] == sig[1]).mean() - shared / (2 * n - shared)) < 0.04
    weights = np.array([5.0, 1.0, 0.5, 2.0, 3.0, 0.5])  # of x: e1 5, e2 1, e3 .5; of y: e1 2, e2 3, e3 .5
    e = rng.integers(1, 1 << 62, 3).astype(np.uint64)
    sig = neardup.dart_minhash(np.concatenate([e, e]), np.array([0, 3, 6]), k, weights)
    assert abs((sig[0] == sig[1]).mean() - 3.5 / 8.5) < 0.04


def test_signatures_fill_every_coordinate():
    sig = neardup.dart_minhash(np.arange(1, 4, dtype=np.uint64), np.array([0, 1, 1, 3]), 125)
    assert (sig[[0, 2]] != 0).all() and (sig[1] == 0).all()


def test_sketches_bound_what_sets_do_not_share():
    """Never more differing bits than elements that only one set has; and most where these are few."""
    rng = np.random.default_rng(6)
    for own in (0, 1, 5, 40, 300):
        common, a, b = (rng.integers(1, 1 << 62, k).astype(np.uint64) for k in (200, own, own))
        x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
        s = neardup.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        differ = sum(bin(int(v)).count("1") for v in (s[0] ^ s[1]).view(np.uint64))
        assert differ <= 2 * own and (own > 40 or differ >= 1.4 * own)


def test_shingles():
    elements, first = neardup.shingles(pa.array(["a b c d e f", "a b c d e", "a b", "", "a b c d e f a b c d e"]))
    assert np.diff(first).tolist() == [2, 1, 1, 0, 7 - 1]
    assert elements[first[1]] in elements[: first[1]]


# ---- packing --------------------------------------------------------------------------------------------------------

LENGTHS = st.lists(st.integers(1, 64), min_size=1, max_size=80)


@given(LENGTHS)
@settings(max_examples=60, deadline=None)
def test_packings_hold_everything_once(lengths):
    n = np.array(lengths)
    for bins in (packing.best_fit_decreasing(n, 64), packing.evolve(n, 64, 1)):
        assert sorted(i for b in bins for i in b) == list(range(len(n)))
        assert max(n[b].sum() for b in bins) <= 64
    assert len(packing.evolve(n, 64, 1)) <= len(packing.best_fit(np.argsort(-n, kind="stable"), n, 64))


@given(LENGTHS)
@settings(max_examples=40, deadline=None)
def test_segment_tree_is_best_fit(lengths):
    n = np.array(lengths)
    assert len(packing.best_fit_decreasing(n, 64)) == len(packing.best_fit(np.argsort(-n, kind="stable"), n, 64))


def test_crossover_keeps_every_document():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 60, 200)
    a, b = packing.best_fit(np.argsort(-n), n, 64), packing.best_fit(rng.permutation(200), n, 64)
    child = packing.crossover(a, b, n, 64, rng)
    assert sorted(i for g in child for i in g) == list(range(200)) and max(n[g].sum() for g in child) <= 64


def test_capacity_tree():
    t = packing.CapacityTree(10)
    for c in (3, 7, 10):
        t.push(c, c)
    assert [t.least(x) for x in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    t.pop(10)
    assert t.least(8) == -1


# ---- media ----------------------------------------------------------------------------------------------------------


@given(st.binary(max_size=60_000))
@settings(max_examples=40, deadline=None)
def test_chunks_are_the_medium(data):
    parts = media.chunks(media.wrap(data))
    assert b"".join(parts) == media.wrap(data) and all(len(p) <= media.MOST for p in parts)
    assert media.samples(media.wrap(data))[: len(data)] == data


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(32, 127, 200_000, dtype=np.uint8).tobytes()
    a, b = set(media.chunks(body)), set(media.chunks(b"some bytes before" + body))
    assert len(a & b) > 0.9 * len(a)


# ---- quality --------------------------------------------------------------------------------------------------------


def test_isotonic():
    knots, rates = quality.isotonic(np.arange(6), np.array([0, 2, 1, 1, 3, 4.0]), np.array([4, 4, 4, 4, 4, 4.0]))
    assert (np.diff(rates) > 0).all() and rates[0] == 0 and rates[-1] == 1
    assert math.isclose(rates[1], 4 / 12)


def test_random_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, quality.N_STATS))
    m = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), None, np.zeros(1), np.zeros(1))
    z = m.features(x)[:, 1:]
    width = np.sqrt(quality.N_STATS) * 1.5
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * width**2))
    assert np.abs(z @ z.T - exact).max() < 0.25 and np.abs(z @ z.T - exact).mean() < 0.06


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array(["", None, "a b", "!!!", "\0\x01", "é" * 1000]))
    assert x.shape == (6, quality.N_STATS) and np.isfinite(x).all() and (x[0] == x[1]).all()


# ---- Katz -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [[0, 50, 20, 12, 8, 6, 4], [0, 3, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0], [0, 5, 9, 30, 1, 1, 1]])
def test_discounts(n):
    d = katz.discounts(np.array(n))
    assert len(d) == katz.K + 1 and (d[1:] > 0).all() and (d[1:] <= 1).all()
