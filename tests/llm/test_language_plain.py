"""Language identification against the same model in plain Python, one document and one number after another."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from gleaner.llm import langid

TEXTS = {
    "en": ["the cat sat on the mat", "where is the house of the king", "they were there with the others", "this is what she thought"],
    "fr": ["le chat est sur la table", "où est la maison du roi", "elles étaient là avec les autres", "c'est ce qu'elle pensait"],
    "de": ["die Katze sitzt auf dem Tisch", "wo ist das Haus des Königs", "sie waren dort mit den anderen", "das ist was sie dachte"],
}


@cache
def hashed(gram: str) -> int:
    h = 0
    for k, c in enumerate(gram):
        h = (h + ord(c) + k + 1) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - langid.BITS)


@cache
def grams(text: str | None) -> Counter:
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return Counter(hashed((" " + w)[i : i + k].ljust(k)) for w in words for i in range(len(w) + 1) for k in langid.ORDERS)


def softmax(z: list[float]) -> list[float]:
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain(rows: list[tuple]) -> dict[int, tuple[str, float]]:
    """doc_id to (language, score), learned from the rows that identify() may learn from."""
    known = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 for r in known}
    counts = {r[0]: grams(r[1]) for r in known}
    some = [r for r in known if counts[r[0]]]
    df = Counter(g for r in some for g in counts[r[0]])
    idf = lambda g: math.log((1 + len(some)) / (1 + df[g])) + 1
    fit = sorted((r for r in some if fold[r[0]] < 2), key=lambda r: (r[2], r[0]))
    languages = sorted({r[2] for r in fit})
    share = lambda c: {g: float(np.float32(n / sum(c.values()))) for g, n in c.items()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(g, c: int) -> float:
        pull = math.copysign(max(abs(z[g, c]) - langid.L1, 0), z[g, c])
        return -pull / ((langid.BETA + math.sqrt(n[g, c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for r in order.permutation(len(fit)):
            x = {g: langid.SCALE * s * idf(g) for g, s in sorted(share(counts[fit[r][0]]).items())} | {"bias": 1.0}
            w = {(g, c): weight(g, c) for g in x for c in range(len(languages))}
            p = softmax([sum(v * w[g, c] for g, v in x.items()) for c in range(len(languages))])
            for c, name in enumerate(languages):
                for g, v in x.items():
                    d = v * (p[c] - (name == fit[r][2]))
                    z[g, c] += d - (math.sqrt(n[g, c] + d * d) - math.sqrt(n[g, c])) / langid.ALPHA * w[g, c]
                    n[g, c] += d * d

    def logits(text) -> list[float]:
        c = grams(text)
        return [weight("bias", k) + langid.SCALE * sum(m / sum(c.values()) * idf(g) * weight(g, k) for g, m in c.items()) for k in range(len(languages))]

    held = [(logits(r[1]), languages.index(r[2])) for r in some if fold[r[0]] == 3 and r[2] in languages]
    t = 1.0
    if held:
        steps = [math.log(0.05) + i * math.log(400) / 2000 for i in range(2001)]
        t = math.exp(min(steps, key=lambda s: -sum(math.log(softmax([v / math.exp(s) for v in zs])[y] + 1e-12) for zs, y in held)))
    out = {}
    for i, text, *_ in rows:
        if not grams(text):
            out[i] = ("und", 0.0)
            continue
        p = softmax([v / t for v in logits(text)])
        out[i] = (languages[p.index(max(p))], max(p))
    return out


def test_plain_model(spark):
    rows = [(i * 10 + k, f"{t}, {i}!" + " x" * (i % 3), lang) for k, (lang, ts) in enumerate(TEXTS.items()) for i, t in enumerate(ts * 2)]
    rows += [(900, "le chat _ the cat", "en"), (901, "die Katze", "fr"), (902, None, "en"), (903, "12 ?!", "de"), (904, "", None), (905, "maison du roi, " * (langid.PIECE // 10), None), (906, "ÉTÉ İ ß", "fr"), (None, "the end", "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=5e-3), (r, lang, score)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_repeated_ids(spark):
    """Rows that repeat an id are each predicted by their own text, and repeats of whole rows change nothing."""
    rows = [(i * 10 + k, t, lang) for k, (lang, ts) in enumerate(TEXTS.items()) for i, t in enumerate(ts * 2)]
    other = [(7_000, "le chat est sur la table", None), (7_000, "the cat sat on the mat", None), (7_000, "the cat sat on the mat", None)]
    got = langid.identify(spark.createDataFrame(rows + other, "doc_id long, text string, lang string")).where("doc_id = 7000").collect()
    assert sorted(r["lang_pred"] for r in got) == ["en", "en", "fr"]
