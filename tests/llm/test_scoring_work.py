"""The faster forms in which `op1_scoring` trains and scores, against plain ones."""

import numpy as np
import pytest

from auctionlake.llm import scoring


@pytest.mark.parametrize("n", [0, 1, 127, 128, 256, 300, 1000])
def test_products_by_pieces(n):
    rng = np.random.default_rng(n)
    a, b = rng.standard_normal((n, 33)), rng.standard_normal((n, 40))
    assert np.allclose(scoring.product(a, b), a.T @ b) and scoring.product(a, b).shape == (33, 40)


def test_steps_are_adams():
    rng = np.random.default_rng(1)
    one, two, g = rng.standard_normal(9), rng.random(9), rng.standard_normal(9)
    first, second = one + 0.1 * (g - one), two + 0.01 * (g * g - two)
    want = 0.02 * (first / (1 - 0.9**3)) / (np.sqrt(second / (1 - 0.99**3)) + 1e-8)
    assert np.allclose(scoring.adam(one, two, g, 3, 0.02), want) and np.allclose(one, first) and np.allclose(two, second)


def test_chances_far_apart_are_not_cut():
    model = scoring.start(np.arange(1600)[::-1] + 1)
    w = model.weights
    w["c"] = np.linspace(-150, 150, scoring.SETS + scoring.BINS).astype(np.float32)
    w["d"] = np.tile(np.linspace(120, -120, scoring.SIZE), (scoring.SETS, 1)).astype(np.float32)
    y, r = np.arange(1600), np.zeros((1600, scoring.HIDDEN), np.float32)
    log = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    inside = log(w["d"][0].astype(float))
    want = log(w["c"].astype(float))[model.classes] + np.where(model.classes < scoring.SETS, inside[model.slots], model.inside)
    assert np.allclose(scoring.chances(model, r, y), want, rtol=1e-5, atol=1e-3)


def test_training_ids_text_by_text():
    rng, end = np.random.default_rng(3), 70_000
    for _ in range(200):
        lengths = rng.integers(0, 5, rng.integers(0, 6))
        held, sizes = rng.random(len(lengths)) < 0.4, np.r_[0, rng.integers(0, 4, 5)]
        codes, subs = rng.integers(1, 6, lengths.sum()), rng.integers(0, 50, sizes.sum()).astype("<u2")
        word = np.split(subs, np.cumsum(sizes)[:-1])
        want = []
        for out, text in zip(held, np.split(codes, np.cumsum(lengths)[:-1]), strict=False):
            if not out:
                want += [*[end] * (scoring.BEFORE + 1), *(int(x) for c in text for x in word[c]), end]
        assert scoring.training_ids(held, lengths, codes, sizes, subs, end).tolist() == want


def test_words_are_numbered_as_they_come():
    words = scoring.numbered()
    assert list(map(words.__getitem__, [b"b", b"a", b"b", b"c"])) == [1, 2, 1, 3] and list(words) == [b"", b"b", b"a", b"c"]
