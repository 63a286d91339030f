"""The language model against plain Kneser-Ney, and its size with many labels."""

import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from confab.llm import language

ORDER = 4


def plain(texts, vocabulary):
    """Interpolated Kneser-Ney of characters with dictionaries: (context, symbol) to a probability. texts: tuples of symbols."""
    counts = {ORDER: Counter()}
    for t in texts:
        padded = (0,) * (ORDER - 1) + t
        for i in range(ORDER - 1, len(padded)):
            counts[ORDER][padded[i - ORDER + 1 : i + 1]] += 1
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    totals, kinds = {n: Counter() for n in counts}, {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            totals[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(context, symbol, n=ORDER):
        if n == 0:
            return 1 / (vocabulary + 1)
        own = context[len(context) - n + 1 :]
        back = p(context, symbol, n - 1)
        if not totals[n][own]:
            return back
        return max(counts[n][(*own, symbol)] - discount[n], 0) / totals[n][own] + discount[n] * kinds[n][own] / totals[n][own] * back

    return p


def prose(rng, n, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    return " ".join(rng.choice(words) for _ in range(n))


def as_symbols(text):
    """Lower-cased letters; anything between two letters, and at the end, is one boundary."""
    out = []
    for c in text:
        s = ord(c.lower()[0]) if c.isalpha() else 0
        if s or (out and out[-1]):
            out.append(s)
    return tuple(out)


def fitted(texts):
    counts = {}
    for lang, own in texts.items():
        counts[lang] = np.unique(language.symbols(own)[0], return_counts=True)
    return language.fit(counts)


def test_probabilities_are_those_of_plain_kneser_ney():
    rng = random.Random(1)
    texts = {"aa": [prose(rng, 60, "abcdé") for _ in range(5)], "bb": [prose(rng, 50, "abxyz") for _ in range(4)], "cc": ["q"]}
    vocabulary = len({s for own in texts.values() for t in own for s in as_symbols(t)})
    model = fitted(texts)
    plains = {lang: plain([as_symbols(t) for t in own], vocabulary) for lang, own in texts.items()}
    tests = ["".join(rng.choice("abcdéxyzq  !ж") for _ in range(60)) for _ in range(20)] + ["a", "жжж", "abc abd"]
    total, size, has = model.bits(tests)
    for i, t in enumerate(tests):
        symbols = (0,) * (ORDER - 1) + as_symbols(t)
        assert size[i] == len(symbols) - ORDER + 1
        for k, lang in enumerate(model.languages):
            want = -sum(math.log2(plains[lang](symbols[j - ORDER + 1 : j], symbols[j])) for j in range(ORDER - 1, len(symbols)))
            assert total[i, k] == pytest.approx(want, rel=1e-6, abs=1e-4)


def test_blocks_of_grams_add_up(monkeypatch):
    rng = random.Random(2)
    model = fitted({x: [prose(rng, 80, letters)] for x, letters in (("a", "abcd"), ("b", "cdef"), ("c", "efgh"))})
    tests = [prose(rng, 30, "abcdefgh") for _ in range(7)] + [""]
    whole = model.bits(tests)[0]
    monkeypatch.setattr(language, "CELLS", 50)
    assert model.bits(tests)[0] == pytest.approx(whole, rel=1e-9)


def test_size_follows_the_entries_of_the_labels():
    """Labels that share no n-grams: twenty times the labels are twenty times the model, not four hundred."""
    rng = np.random.default_rng(3)

    def size(labels):
        counts = defaultdict(tuple)
        for i in range(labels):
            keys = np.unique(rng.integers(1, 200, (20_000, 4)).astype(np.uint64) @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.uint64) + np.uint64(i * 200))
            counts[f"l{i:03}"] = (keys, np.ones(len(keys), np.int64))
        return len(pickle.dumps(language.fit(counts)))

    small, large = size(5), size(100)
    assert large < 22 * small and large < 250e6
