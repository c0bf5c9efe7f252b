"""Many phrases looked for at once: one automaton, one pass of a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.folding import ascii_key_of


def automaton(rules: Sequence[Sequence[str]]):
    """An Aho-Corasick automaton over the folded phrases of all rules; a phrase of several rules stands for the first."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, phrases in enumerate(rules):
        for p in phrases:
            if (key := ascii_key_of(p)) and key not in found:
                found.add_word(key, i)
    found.make_automaton()
    return found


def first_of(machine, key: str) -> int | None:
    """The lowest number of the rules whose phrases are in key, wherever they stand."""
    best: int | None = None
    if len(machine):
        for _, i in machine.iter(key):
            if best is None or i < best:
                best = i
                if not i:
                    break
    return best


def first_rule(text: Column, rules: Sequence[Sequence[str]]) -> Column:
    """The number of the first rule one of whose phrases is in the ascii_key of a text, from 0; null for none and for a null text.

    Phrases are parts of the key, not bounded by words. A text is folded and read in one Arrow stage, whatever the number of rules.
    """

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(rules)
        for texts in batches:
            yield pd.Series([None if t is None else first_of(machine, ascii_key_of(t)) for t in texts], dtype="Int32")

    return run(text)
