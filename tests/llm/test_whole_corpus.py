"""Order min-hash, the Merkle manifest and spelling variants against brute force, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle, ordermin, spelling

R = random.Random(11)
NAMES = "t string, w string, own string, h string, part string, guard string, hash string, place string, size string, word string, n string, list string, row string, b string, key string"
LONG = " ".join(R.choice(["Reservation", "reservation", "reservatoin", "Clôture", "cloture", "chambre", "NULL", "été"]) for _ in range(20_000))


def rows(n: int) -> list[tuple]:
    out = [(i, None if i % 11 == 5 else f"Room {i % 7} " * (i % 13), ["en", "fr", None, "", "été"][min(i % 9, 4)], None if i % 5 == 0 else f"s{i % 3}", None if i % 4 == 1 else i) for i in range(n)]
    return out + [(3, "Twice", "en", "s", 5), (3, "Twice", "en", "s", 5), (3, "Other", "en", "s", 5), (None, "No id", "fr", None, None), (None, None, None, None, None), (n + 5, LONG, "en", "s", len(LONG))]


def frame(spark, data):
    extra = ("x",) * (NAMES.count(",") + 1)
    return spark.createDataFrame([(*r, *extra) for r in data], "doc_id long, text string, lang string, source string, n_chars int, " + NAMES).repartition(3)


def H(*x: str) -> str:
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 8 : i - i % 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level, at = [H(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def plain_manifest(data: list[tuple]) -> list[tuple]:
    def digest(r, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    langs = sorted({r[2] for r in data}, key=lambda x: (x is not None, (x or "").encode()))
    per = {x: sorted(((r, digest(r, r[1])) for r in data if r[2] == x), key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1])) for x in langs}
    subs = {x: tree([h for _, h in per[x]]) for x in langs}
    root, tops = tree([subs[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for (r, h), path in zip(per[x], subs[x][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = digest(r, low(r[1])) if bad else h
            for a, b in path + top:
                f = H(a, f, b)
            out.append((r[0], h, subs[x][0], root, H(*(s for p in path + top for s in p)), f, f == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "height"), [(0, 1), (40, 1), (700, 1), (700, 2)])
def test_merkle(spark, n, height):
    data = rows(n)
    got = merkle.manifest(frame(spark, data), altered={"text": merkle.lower_cased()}, where=merkle.every_third(), height=height)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(data)


def test_merkle_edges(spark):
    docs = frame(spark, rows(5))
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("n_chars = 2")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == H("") and one["verified"]
    assert merkle.manifest(docs).where("NOT verified").count() == 0  # nothing altered


def test_multiproof():
    """Any leaves with the nodes that missing() names give the root and each leaf's path; one node less doesn't."""
    for size in (1, 7, 8, 9, 65, 300):
        leaves = [H(str(i)) for i in range(size)]
        root, paths = tree(leaves)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        for _ in range(5):
            own = sorted(R.sample(range(size), R.randint(1, size)))
            need = merkle.missing(np.array(own), size)
            assert len(set(need)) == len(need)
            part = merkle.Part({i: leaves[i] for i in own}, size, [(v, i, levels[v][i]) for v, i in need])
            assert part.root == root and all(part.path(i) == paths[i] and merkle.fold(leaves[i], part.path(i)) == root for i in own)
            if need:
                with pytest.raises(KeyError):
                    merkle.Part({i: leaves[i] for i in own}, size, [(v, i, levels[v][i]) for v, i in need[1:]])


def plain_variants(data: list[tuple], one_in: int = 31) -> dict[str, tuple]:
    counts: Counter = Counter()
    for r in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % one_in == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    links = {a: [b for b in n if near(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(links[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 10 * n[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return {a: (form[a], root(a), n[a], len(links[a]), n.get(form[a])) for a in n}


@pytest.mark.parametrize("frequent", [3, 40, 20_000])
def test_spelling(spark, frequent):
    words = ["reservation", "clôturer", "cloturer", "aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "international", "àéîõüçñ", "abcdefg", "×÷×÷×÷×"]

    def typo(w):
        k = R.randrange(len(w))
        return R.choice([w[:k] + w[k + 1 :], w[:k] + R.choice("aeé") + w[k:], w[:k] + R.choice("aeé") + w[k + 1 :]])

    data = []
    for i in range(150):
        some = [R.choice(words[: 1 + i % len(words)]) for _ in range(30)] + [typo(R.choice(words)) for _ in range(6)] + [typo(typo(R.choice(words))) for _ in range(3)]
        data.append((i, "-".join(R.choice([w, w.upper() if w.isascii() else w]) for w in some), "en", "s", 0))
    data += [*rows(12), data[3], (500, "chained " * 2000 + "chaned " * 150 + "chane " * 14 + "chainedy " * 160 + "chainedyy " * 12, "en", "s", 0)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(spark, data), frequent=frequent).collect()}
    want = plain_variants(data)
    assert got == want
    assert any(f is not None and r != f for f, r, *_ in want.values())  # a way of two steps


def test_spelling_edges(spark):
    docs = frame(spark, rows(3))
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("text IS NULL")).count() == 0
    giant = "x" * 4000
    found = spelling.variants(frame(spark, [(1, f"{giant} {giant} {giant}x {giant}x", "en", "s", 0)]), one_in=0).collect()
    assert sorted((len(r["word"]), r["n"], r["n_near"]) for r in found) == [(4000, 2, 1), (4001, 2, 1)]


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """A word has up to 32 lists, but Spark sizes them as one row: a table below its limit may hold more than the driver's memory."""
    plans, write = [], spelling.materialize

    def planned(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, **b)

    monkeypatch.setattr(spelling, "materialize", planned)
    text = "reservation reservation reservations reservations clôturer clôturer cloturer cloturer"
    found = spelling.variants(spark.createDataFrame([(i, text) for i in range(9)], "doc_id long, text string"), one_in=0)
    assert {(r["word"], r["n"], r["n_near"]) for r in found.collect()} == {("reservation", 18, 1), ("reservations", 18, 1), ("clôturer", 18, 1), ("cloturer", 18, 1)}
    assert sum(p.count("SortMergeJoin") for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_spared():
    """Words one edit apart meet in a list, whatever the dictionary."""
    for _ in range(3000):
        w = "".join(R.choice("abc") for _ in range(R.randint(7, 12)))
        longer = frozenset(x for x in {w[i : i + q] for q in (3, 4) for i in range(len(w))} | {"aaa", "abc", "\x02\x02a", "c\x03\x03"} if R.random() < 0.5)
        k, c = R.randrange(len(w)), R.choice("abcd")
        same, more = w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]
        assert spelling.spared(w, longer)[0] & spelling.spared(same, longer)[0]
        assert spelling.spared(w, longer)[1] & spelling.spared(more, longer)[0]


def plain_fingerprint(text: str) -> list[int]:
    """As the module defines it, element by element."""
    h = [int(x) for x in ordermin.kmers(text)]
    if len(h) < ordermin.TAKEN:
        tuples = [h + [0] * (ordermin.TAKEN - len(h))] * ordermin.SKETCHES
    else:
        seen: Counter = Counter()
        elements = []
        for x in h:
            elements.append(int(ordermin.mixed(np.array([(x + seen[x] * 0x9E3779B97F4A7C15) % 2**64], np.uint64), 3)[0]) >> 32)
            seen[x] += 1
        tuples = []
        for m in ordermin._MULTIPLIERS.tolist():
            least = sorted(range(len(h)), key=lambda i: (elements[i] * m % 2**32, i))[: ordermin.TAKEN]
            tuples.append([h[i] for i in sorted(least)])
    out = np.arange(ordermin.SKETCHES, dtype=np.uint64)
    for c in range(ordermin.TAKEN):
        out = ordermin.mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.array([t[c] for t in tuples], np.uint64), 11 + c)
    return (out >> np.uint64(32)).tolist()


def test_fingerprint():
    for text in ("", "a", "abcdefg", "abcdefgh", "abcdefghi", "x" * 3000, "ab" * 2500, "Ünï—\U0001f600" * 40, LONG[:9000]):
        assert ordermin.fingerprint(text).tolist() == plain_fingerprint(text)
    first, other = ("".join(R.choices("abcdefghijklmnop", k=3000)) for _ in range(2))
    a, swapped = ordermin.fingerprint(first + other), ordermin.fingerprint(other + first)
    assert ordermin.likeness(a, ordermin.fingerprint(first + other)) == 1
    assert ordermin.likeness(a, swapped) < 0.85  # nearly the same k-mers, in another order
    assert ordermin.likeness(a, ordermin.fingerprint((first + other)[:-60])) > ordermin.likeness(a, ordermin.fingerprint((first + other)[:-2000]))


@pytest.mark.parametrize("chars", [2000, 8_000_000])
def test_edited(spark, monkeypatch, chars):
    monkeypatch.setattr(ordermin, "PART_CHARS", chars)
    data = [r for r in rows(60) if r[0] != 3] + [(3, "Twice over and over", "en", "s", 5)] * 2 + [(70 + i, LONG[i * 900 : i * 900 + 40 * i], "en", "s", 5) for i in range(20)]
    ids = [r for r in data if r[0] is not None]
    got = sorted(map(tuple, ordermin.edited_fingerprints(frame(spark, ids)).collect()), key=str)
    order = sorted(((r[0], r[1] or "") for r in ids), key=lambda x: x[0])
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        e = t[: len(t) - k] + u[:k]
        a, b, c = map(ordermin.fingerprint, (t, e, u))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), ordermin.text_of(a), ordermin.text_of(b), ordermin.likeness(a, b), ordermin.likeness(a, c)))
    assert got == sorted(want, key=str)
    found = ordermin.edited_fingerprints(frame(spark, data)).collect()
    assert len(found) == len(data) and sum(r["doc_id"] is None for r in found) == 2
    own = {tuple(r) for r in ordermin.fingerprints(frame(spark, data)).collect()}
    assert own == {(r["doc_id"], r["fingerprint"]) for r in found}


def test_edited_edges(spark):
    docs = frame(spark, [(4, "only one text here", "en", "s", 1)])
    assert ordermin.edited_fingerprints(docs.limit(0)).count() == 0
    one = ordermin.edited_fingerprints(docs).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == H("only one text " + "only")
    assert ordermin.edited_fingerprints(frame(spark, [(1, None, "en", "s", 1), (2, "", "en", "s", 1)])).agg(F.min("near_edited"), F.min("near_next")).first() == (1, 1)
