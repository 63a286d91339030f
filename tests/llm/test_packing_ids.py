"""Ids of parts: words in lines, signs by themselves, and what a worker keeps of them."""

from __future__ import annotations

import public_tokenizers

from confab.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, (World)! it's don't 'twas O'Neil's — über... straße ÀÇÑ! \"ñoño\" a1b2 x_y x-y e.g. §3 µm ª º × ÷ œuvre naïve",
    "été café! क़क़ İstanbul ΑΣ Σ я, ф.я a b a\u0085b a\tb a\r\nb ​ x​y ≮ ≠ <a̸>",
    "", " ", "...", "a" * 3000, "!" * 50 + "a" + "?" * 50, "## [x](http://a.b/c?d=e) `k` {l} ~m~ |n| n^2 </w> a</w> <|endoftext|>", "<|ENDOFTEXT|> X", "Ärger <|STARTOFTEXT|>.", "é" * 300,
]


def test_ids_are_those_of_whole_texts():
    ids = packing.Ids(PATH)
    assert ids.words and ids.parts
    plain = ids.encoded(TEXTS)
    assert ids(TEXTS) == plain
    ids = packing.Ids(PATH, 8)
    assert [ids([t])[0] for t in TEXTS * 2] == plain * 2


def test_frequent_words_stay_when_rare_ones_fill_the_cache(monkeypatch):
    ids = packing.Ids(PATH, 100)
    made = []
    inner = ids.by_words
    monkeypatch.setattr(ids, "by_words", lambda parts: made.extend(parts) or inner(parts))
    for i in range(50):
        ids(["often seen " + " ".join(f"w{i}x{j}" for j in range(20))])
        assert len(ids.known) + len(ids.older) <= 2 * (50 + 22) + 2
    assert made.count("often") == 1 and made.count("seen") == 1
