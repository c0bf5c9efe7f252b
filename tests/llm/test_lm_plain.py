"""The scores of the recurrent model against one plain step after another, document by document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import langid, lm, recurrent

END = object()


def split(text: str | None) -> list:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), END]


def log_softmax(a: np.ndarray, i: int) -> float:
    return float(a[i] - a.max() - math.log(np.exp(a - a.max()).sum()))


def network(w: recurrent.Weights, tokens: list[int]) -> float:
    """Natural log-probability of a document's tokens: a gated unit from a state of zeros, then class and word."""
    p = {k: v.astype(float) for k, v in w.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    k = recurrent.HIDDEN
    h, before, total = np.zeros(k), w.size, 0.0
    for t in tokens:
        x, g = p["embed"][before], h @ p["u"]
        r, z = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
        h = (1 - z) * h + z * np.tanh(x[2 * k :] + r * g[2 * k :])
        c = next(i for i in range(len(w.cuts) - 1) if w.cuts[i] <= t < w.cuts[i + 1])
        own = slice(w.cuts[c], w.cuts[c + 1])
        total += log_softmax(h @ p["class_w"] + p["class_b"], c) + log_softmax(p["word_w"][own] @ h + p["word_b"][own], t - w.cuts[c])
        before = t
    return total


def plain(texts: list, learned: list, w: recurrent.Weights, head: int) -> list[float]:
    counts = Counter(t for x in learned for t in split(x))
    n, v = sum(counts.values()), len(counts)
    name = {t: int(lm.keys([t])[0][0].astype(np.int64)) for t in counts if t is not END}
    ranked = sorted(name, key=lambda t: (-counts[t], name[t]))[:head]
    known = 1 + len(ranked)
    other = n - counts[END] - sum(counts[t] for t in ranked)
    number = {END: recurrent.END} | {t: i + 2 for i, t in enumerate(ranked)}
    rest = other + 0.1 * max(1, v + 1 - known)
    return [network(w, [number.get(t, recurrent.REST) for t in split(x)]) / math.log(10) + sum(math.log10((counts[t] + 0.1) / rest) for t in split(x) if t not in number) for x in texts]


@pytest.mark.parametrize(("head", "counted"), [(5, 1000), (40, 1000), (5, 12)])
def test_plain_score(spark, monkeypatch, head, counted):
    """Trained weights; words tie in their counts, also at the edge of the head; tails that are joined; windows that a text outlasts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "The"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i // 3 + 1) for i in range(len(words))], k=rng.randrange(1, 30))) for _ in range(60)]
    texts += [None, "", " \t\n", "unknown Words here", "w1 w2 " * 400, "w0", "w0"]
    rows = [*enumerate(texts), (None, "w1 w2")]
    made = []
    averaged = lm._averaged

    def kept(sharded, weights):
        made.append(averaged(sharded, weights))
        return made[-1]

    monkeypatch.setattr(lm, "_averaged", kept)
    held = langid.fold("doc_id", 10) == 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(df, held, ~held, head=head, counted=counted).collect()
    learned = [t for (i, t), r in zip(rows, df.select((~held).alias("x")).collect(), strict=True) if r["x"]]
    want = dict(zip([i for i, _ in rows], plain([t for _, t in rows], learned, made[-1], head), strict=True))
    assert len(got) == len(rows) and len(made) == lm.ROUNDS
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-4, abs=1e-3), r
