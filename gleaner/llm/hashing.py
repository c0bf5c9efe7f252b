"""Hashes of words, made for many texts at once in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Characters or bytes that are hashed at once; longer texts are taken in such pieces, cut between words.
PIECE = 1 << 16
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_NOT_WORD = re.compile(r"[\W_]")
_WORD = re.compile(r"[^\W_]+")
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_alnum: np.ndarray | None = None


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x94D049BB133111EB)) ^ (x >> np.uint64(17))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0..n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(PIECE + 4096, n + 1)
        bases = [np.full(size, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
        for b in bases:
            b[0] = 1
        _powers = tuple(np.multiply.accumulate(b) for b in bases)
    return _powers


def runs(code: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of the runs of places where `inside` holds, by what `code` has there."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(code))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    return start, end, mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64), 77)


def spaced_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words of each text): A-Z lower-cased, words end at the six ASCII space characters."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.empty(0, np.int64)
    blob, hashes, places, at = b" ".join(raw), [], [], 0
    while at < len(blob):
        found = _SPACE.search(blob, at + PIECE)
        stop = found.end() if found else len(blob)
        code = np.frombuffer(blob, np.uint8, stop - at, at)
        start, _, h = runs(code, ~SPACES[code])
        hashes.append(h)
        places.append(start + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(ends, np.concatenate(places), "right")
    return np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def alnum() -> np.ndarray:
    global _alnum
    if _alnum is None:
        _alnum = np.zeros(0x110000, bool)
        for run in _WORD.finditer("".join(map(chr, range(0x110000)))):
            _alnum[run.start() : run.end()] = True
    return _alnum


def line_words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, line, length) of each word of the lines of texts, letters and digits of what is lower-cased.

    Lines are numbered on through all texts, a null text being one empty line. Yields a part at a time.
    """
    blob, at, line = "\n".join((t or "").lower() for t in texts), 0, 0
    while at < len(blob):
        found = _NOT_WORD.search(blob, at + PIECE)
        stop = found.start() if found else len(blob)
        stop = max(stop, at + 1)
        code = np.frombuffer(blob[at:stop].encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end, h = runs(code, alnum()[code])
        breaks = np.flatnonzero(code == 10)
        yield h, line + np.searchsorted(breaks, start), end - start
        at, line = stop, line + len(breaks)
