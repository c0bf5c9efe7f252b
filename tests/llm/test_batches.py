"""Slices of Arrow batches by bytes of text."""

from __future__ import annotations

import random

import pyarrow as pa

from gleaner.llm.shared import by_bytes


def test_slices_hold_every_row_once():
    rng = random.Random(4)
    for texts in ([], [None], [""], [None, "", "x" * 90], ["é" * rng.randint(0, 30) if rng.random() > 0.2 else None for _ in range(300)]):
        for column in (pa.array(texts, pa.string()), pa.array([None, *texts, "z"], pa.large_string())[1:-1]):
            cuts = list(by_bytes(column, 50))
            assert [t for c in cuts for t in column[c].to_pylist()] == texts
            assert all(c.stop > c.start for c in cuts)
            # the last row of a slice is the one that passes the bound
            assert all(sum(len((t or "").encode()) + 1 for t in texts[c.start : c.stop - 1]) <= 50 for c in cuts)
