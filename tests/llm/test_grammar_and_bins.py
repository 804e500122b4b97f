"""The grammar beyond 16 bits, and the packing heuristic against a plain form of it."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatix.llm import packing, token_store
from verbatix.llm.packing import Limits


@settings(max_examples=60, deadline=None)
@given(vocabulary=st.sampled_from([100, 65_500, 65_536, 70_000, 1 << 20, (1 << 32) - 5_000]), seed=st.integers(0, 2**32), kinds=st.integers(1, 30), size=st.integers(0, 3_000))
def test_grammar_of_any_vocabulary(vocabulary, seed, kinds, size):
    rng = np.random.default_rng(seed)
    words = [rng.integers(max(0, vocabulary - 90), vocabulary, rng.integers(1, 6)) for _ in range(kinds)]
    ids = np.concatenate([np.zeros(0, np.int64), *(words[k] for k in rng.integers(0, kinds, size // 3))])
    rules, lengths, symbols = token_store.grammar(ids, vocabulary)
    flat = symbols.astype(np.int64)
    while (inner := flat >= vocabulary).any():
        flat = np.concatenate([rules[x - vocabulary].astype(np.int64) if x >= vocabulary else [x] for x in flat.tolist()])
    assert flat.tolist() == ids.tolist()
    pairs = {}
    for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
        pairs[a, b] = pairs.get((a, b), 0) + (a != b)
    assert max(pairs.values(), default=0) < token_store.LEAST


def test_grammar_goes_on_beyond_16_bits():
    rng = np.random.default_rng(5)
    pairs = rng.permutation(40_000)[: 2 * 18_000].reshape(-1, 2)
    ids = np.tile(pairs, (6, 1))
    rng.shuffle(ids)
    rules, lengths, symbols = token_store.grammar(ids.ravel(), 50_257)
    assert len(rules) >= 18_000 and len(symbols) <= 6 * 18_000
    assert token_store.expand(symbols.astype(np.int64), rules, lengths, 50_257).tolist() == ids.ravel().tolist()
    for vocabulary in (100, 100_277):
        rules, _, symbols = token_store.grammar(np.tile(np.arange(50), 400), vocabulary)
        assert len(rules) == 199 and len(symbols) == 9


def plain_bins(sizes, losses, limits):
    """Each step looks at every example."""
    room, begin, bins = (limits.tokens, limits.segments, limits.loss_tokens), [0] * len(sizes), []

    def reach(i, tokens, loss):
        return min(sizes[i], begin[i] + tokens, max(begin[i], sizes[i] - losses[i]) + loss)

    for i in range(len(sizes)):
        if sizes[i] >= limits.tokens or losses[i] >= limits.loss_tokens:
            while begin[i] < sizes[i] and ((stop := reach(i, limits.tokens, limits.loss_tokens)) - begin[i] == limits.tokens or stop < sizes[i]):
                bins.append([(i, begin[i], stop)])
                begin[i] = stop
    order = sorted((i for i in range(len(sizes)) if begin[i] < sizes[i]), key=lambda i: begin[i] - sizes[i])
    need = lambda i: (sizes[i] - begin[i], 1, min(sizes[i] - begin[i], losses[i]))
    while order:
        left, pieces, i = list(room), [], order[0]
        while True:
            stop = reach(i, left[0], left[2])
            pieces.append((i, begin[i], stop))
            left = [left[0] - (stop - begin[i]), left[1] - 1, left[2] - max(0, stop - max(begin[i], sizes[i] - losses[i]))]
            begin[i] = stop
            order = [j for j in order if begin[j] < sizes[j]]
            if min(left) < 1 or not order:
                break
            fit = [j for j in order if all(n <= x for n, x in zip(need(j), left, strict=True))]
            dot = lambda j: sum((n / r) * (x / r) for n, x, r in zip(need(j), left, room, strict=True))
            i = max(fit, key=dot) if fit else max(order, key=lambda j: need(j)[0])  # the first one of equal ones
            if not fit and reach(i, left[0], left[2]) == begin[i]:
                break
        bins.append(pieces)
    return bins


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 30), Limits(20, 512, 3), Limits(16, 2, 16)])
def test_bins_are_those_of_the_plain_heuristic(limits):
    rng = random.Random(8)
    for most in (1, 3, 12, 40, 300):
        for _ in range(12):
            sizes = [rng.randint(0, most) for _ in range(rng.randint(0, 60))]
            losses = [rng.randint(0, s) for s in sizes] if rng.random() < 0.6 else list(sizes)
            got = packing.plan_bins(np.array(sizes, np.int64), np.array(losses, np.int64), limits)
            assert got == plain_bins(sizes, losses, limits)


def test_many_short_examples_take_little_time():
    for size in (1, 3):
        began = time.perf_counter()
        assert len(packing.plan_bins(np.full(8_192, size), np.full(8_192, size), Limits())) == 16
        assert time.perf_counter() - began < 1.0
