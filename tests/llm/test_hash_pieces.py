"""Words are hashed some bytes at a time: the same hashes, and little memory."""

import tracemalloc

import numpy as np

from gleaner.llm import hashing


def test_pieces(monkeypatch):
    texts = ["one two  three\tfour " * 50, None, "x" * 300 + " y", "Ü ß 世界 " * 40]
    want = hashing.spaced_words(texts)
    monkeypatch.setattr(hashing, "PIECE", 64)
    for x, y in zip(want, hashing.spaced_words(texts), strict=True):
        assert np.array_equal(x, y)


def test_memory():
    text = [("w" * 63 + " ") * 50_000]
    hashing.spaced_words(text)
    tracemalloc.start()
    hashing.spaced_words(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # 1 MB of text at once: 22 MB
