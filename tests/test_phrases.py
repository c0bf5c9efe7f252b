"""One automaton against a test of each rule by itself; folds against their definition."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from gleaner.functions import phrases
from gleaner.functions.folding import _unmarked, ascii_key_of, phrase_key_of
from gleaner.operators.taxonomy import SOFTWARE_RULES

R = random.Random(9)


def test_folds():
    letters = "abzAZ09 -_'\t\n\x00éÉßœŒİıﬁ①²中\U0001f600́À"
    for _ in range(3000):
        t = "".join(R.choice(letters) for _ in range(R.randint(0, 12)))
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        assert ascii_key_of(t) == re.sub("[^a-z0-9]+", " ", plain.lower()).strip()
        assert phrase_key_of(t) == re.sub("[^a-z0-9]+", " ", _unmarked(t.casefold())).strip()


def test_first_rule(spark):
    rules = [("b c", "é"), ("abc", "c"), ("a", "b c"), ("", "zz zz"), ("zz",)]
    machine = phrases.automaton(rules)
    for _ in range(3000):
        key = " ".join("".join(R.choice("abcez") for _ in range(R.randint(1, 3))) for _ in range(R.randint(0, 4)))
        want = next((i for i, r in enumerate(rules) if any(ascii_key_of(p) and ascii_key_of(p) in key for p in r)), None)
        assert phrases.first_of(machine, key) == want
    x = spark.createDataFrame([(0, None), (1, ""), (2, "Abc"), (3, "É!"), (4, "zz--ZZ"), (5, "y" * 100_000 + " b, C")], "i int, t string")
    assert [r[0] for r in x.orderBy("i").select(phrases.first_rule(F.col("t"), rules)).collect()] == [None, None, 1, 0, 3, 0]
    assert [r[0] for r in x.orderBy("i").select(phrases.first_rule(F.col("t"), [])).collect()] == [None] * 6
    assert phrases.first_of(phrases.automaton([p for *_, p in SOFTWARE_RULES]), "annuler une facture puis un no show") == 0
