"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

The encoding of a text by merges is the one path of pieces through it in which every two neighbours,
encoded together, stay those two pieces. With the score 0 for such neighbours and minus infinity for
others it is the best path in the max-plus semiring, and it can be found in parts: a part of a text
turns each state at its left end (the last piece before, and how far it reaches in) into states at its
right end. These transfer matrices are combined associatively; then each part knows the states at both
its ends and is backtraced by itself.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import by_size, materialize, whole_groups

#: Characters of a part of a giant document; documents up to this length are one part.
PART = 1 << 16
CACHED_WORDS, CACHED_CHARS = 150_000, 64
SPACE = "▁"
#: A state: (text of the last piece, characters of it that lie beyond the boundary).
State = tuple[str, int]
START: State = ("", 0)


class Pieces:
    """A SentencePiece merge model without normalisation rules, as used on parts of texts."""

    def __init__(self, file: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model without normalisation rules is needed")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        model.normalizer_spec.add_dummy_prefix = False
        self.inner = SentencePieceProcessor(model_proto=model.SerializeToString())
        kind = pb.ModelProto.SentencePiece.Type
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.bytes_of = [bytes([int(p.piece[1:-1], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else p.piece.encode() for p in model.pieces]
        self.reach = max(map(len, self.id_of))
        # a cut between two characters is safe if no piece holds them side by side
        self.pairs = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        inside = any(SPACE in p.lstrip(SPACE) for p in self.id_of) or any("\n" in p and len(p) > 1 for p in self.id_of)
        self.words = re.compile(r"(?s).+" if inside else rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        return (self.prefix + text).replace(" ", SPACE) if text else ""

    def encode_normal(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of normalised texts, each of whose words is encoded once and remembered."""
        split = [self.words.findall(x) for x in texts]
        words = {w for ws in split for w in ws}
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        for i in range(0, len(new), 8192):
            for w, ids in zip(new[i : i + 8192], self.inner.encode(new[i : i + 8192], num_threads=1), strict=True):
                known[w] = np.array(ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def fit(self, a: str, b: str) -> bool:
        """Whether the neighbours a and b, encoded together, stay these two."""
        if not a or a[-1] + b[0] not in self.pairs:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) > CACHED_WORDS:
                self.fits.clear()
            self.fits[a, b] = self.inner.encode(a + b) == [self.id_of[a], self.id_of[b]] if a in self.id_of and b in self.id_of else True
        return self.fits[a, b]

    def starts(self, text: str, at: int) -> Iterator[str]:
        """The pieces that begin at a place of the text; a character that is in none stands for its bytes."""
        yield text[at]
        for n in range(2, min(self.reach, len(text) - at) + 1):
            if text[at + n - 2 : at + n] not in self.pairs:
                return
            if (p := text[at : at + n]) in self.id_of and self.whole(p):
                yield p

    def whole(self, piece: str) -> bool:
        """Whether a piece, encoded by itself, is that piece."""
        if (piece, "") not in self.fits:
            self.fits[piece, ""] = self.inner.encode(piece) == [self.id_of[piece]]
        return self.fits[piece, ""]

    def paths(self, text: str, end: int, left: State) -> dict[int, list[str]]:
        """From left, the last piece that ends at each place: place -> [piece], with those beyond `end` too."""
        last: dict[int, str] = {left[1]: left[0]}
        for i in range(left[1], min(end, len(text))):
            if (before := last.get(i)) is None:
                continue
            for p in self.starts(text, i):
                if i + len(p) not in last and self.fit(before, p):
                    last[i + len(p)] = p
        return {i: [p] for i, p in last.items()}

    def _cut(self, text: str, a: int, b: int, step: int) -> int | None:
        """The first safe cut of text strictly between a and b, from the side that step says."""
        places = range(a + 1, b) if step > 0 else range(b - 1, a, -1)
        return next((i for i in places if text[i - 1 : i + 1] not in self.pairs), None)

    def transfer(self, text: str, end: int, lefts: list[State]) -> dict[State, list[State]]:
        """The right states that each left state leads to; text goes on beyond the part's end by `reach`."""
        head, tail = self._cut(text, 0, end, 1), self._cut(text, 0, end, -1)
        if tail is not None and tail > self.reach:
            ends = self.paths(text[tail:], end - tail, START)
            rights = self._rights(ends, end - tail)
            return {x: rights for x in lefts if x[1] > head or head in self.paths(text[:head], head, x)}
        return {x: self._rights(self.paths(text, end, x), end) for x in lefts}

    @staticmethod
    def _rights(ends: dict[int, list[str]], end: int) -> list[State]:
        return [(p, i - end) for i, ps in sorted(ends.items()) for p in ps if i >= end and (i == end or i - len(p) < end)]

    def lefts(self, text: str, at: int) -> list[State]:
        """All states at the place `at` of a text that the text before it and after it allow."""
        if not at:
            return [START]
        out = []
        for i in range(max(0, at - self.reach), at):
            out += [(p, i + len(p) - at) for p in self.starts(text, i) if i + len(p) >= at]
        return out

    def backtrace(self, text: str, end: int, left: State, right: State) -> list[int]:
        """The ids of the pieces that begin in the part, between the states at its two ends."""
        def walk(text: str, first: State, goal: int, piece: str | None) -> list[str]:
            last = {i: ps[0] for i, ps in self.paths(text, goal if piece is None else goal - len(piece) + 1, first).items()}
            out, i = [], goal
            while i > first[1]:
                out.append(last[i])
                i -= len(last[i])
            return out[::-1]

        goal = end + right[1]
        head, tail = self._cut(text, 0, end, 1), self._cut(text, 0, end, -1)
        if tail is None or tail <= self.reach or head <= left[1]:
            return [x for p in walk(text, left, goal, right[0]) for x in self._ids(p)]
        ids = [x for p in walk(text[:head], left, head, None) for x in self._ids(p)]
        ids += np.frombuffer(self.encode_normal([text[head:tail]])[0], "<u4").tolist()
        return ids + [x for p in walk(text[tail:], START, goal - tail, right[0]) for x in self._ids(p)]

    def _ids(self, piece: str) -> list[int]:
        return [self.id_of[piece]] if piece in self.id_of else self.inner.encode(piece)


_models: dict[str, Pieces] = {}


def pieces(file: str) -> Pieces:
    if file not in _models:
        _models[file] = Pieces(file)
    return _models[file]


def product(a: dict[State, list[State]], b: dict[State, list[State]]) -> dict[State, list[State]]:
    """The transfer matrix of two neighbouring parts: the max-plus product, with sets of reachable states as rows."""
    return {x: sorted({r for m in ms for r in b.get(m, ())}) for x, ms in a.items()}


def between(a: dict[State, list[State]], b: dict[State, list[State]], left: State, right: State) -> list[State]:
    """The states between two neighbouring parts on the paths from left to right; one, as the path is unique."""
    return [m for m in a.get(left, ()) if right in b.get(m, ())]


def _written(m: dict[State, list[State]]) -> str:
    return json.dumps([[x, m[x]] for x in m])


def _read(m: str) -> dict[State, list[State]]:
    return {tuple(x): [tuple(r) for r in rs] for x, rs in json.loads(m)}


def encode(docs: DataFrame, model_file: str, text_col: str = "text", part: int = PART) -> DataFrame:
    """docs without text_col, with `pieces`: the ids as array<int>, equal to SentencePiece's own.

    Null and empty texts have no pieces. Rows are returned one for one, repeated ones too; a column
    `pieces` of docs is replaced, all others are kept. Documents above `part` characters are cut into parts
    that any task can take; shorter ones are encoded where they are read.
    """
    long = _is_long(text_col, part)
    return _short(docs.where(~long), model_file, text_col).unionByName(_giant(docs.where(long), model_file, text_col, part))


def _is_long(text_col: str, part: int) -> Column:
    return F.coalesce(F.length(text_col), F.lit(0)) > part


def _short(docs: DataFrame, model_file: str, text_col: str) -> DataFrame:
    names = [c for c in docs.columns if c not in (text_col, "pieces")]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for batch in batches:
            for rows in by_size(batch[text_col].tolist()):
                some = batch.iloc[rows]
                ids = coder.encode_normal([coder.normal(x or "") for x in some[text_col]])
                yield some[names].assign(pieces=pd.Series([np.frombuffer(x, "<i4") for x in ids], index=some.index, dtype=object))

    return docs.mapInPandas(whole, docs.select(*names).schema.add("pieces", T.ArrayType(T.IntegerType())))


def _giant(docs: DataFrame, model_file: str, text_col: str, part: int) -> DataFrame:
    names = [c for c in docs.columns if c not in (text_col, "pieces")]
    scanned = _scan(docs.select(F.col(text_col).alias("text")).distinct(), model_file, part)
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n"))
    return rows.join(scanned, ["h", "n"], "left").select("row.*", F.coalesce("pieces", F.array().cast("array<int>")).alias("pieces"))


def _scan(texts: DataFrame, model_file: str, part: int) -> DataFrame:
    """(h, n, pieces) of long texts: parts and their transfer matrices, products up a tree, states down it, backtraces.

    A level of the tree joins each two neighbouring nodes, so a text of p parts takes about log2(p) levels,
    in each of which its nodes are spread over tasks. Should the state between two parts not be the only
    one, the text is encoded whole.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for batch in batches:
            for h, n, text in zip(batch["h"], batch["n"], batch["text"], strict=True):
                x, r = coder.normal(text), coder.reach
                for k, i in enumerate(range(0, len(x), part)):
                    yield pd.DataFrame({"h": [h], "n": [n], "k": [k], "before": [x[max(0, i - r) : i]], "own": [x[i : i + part]], "after": [x[i + part : i + part + r]]})

    texts = texts.select(F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text")
    parts = texts.mapInPandas(cut, "h long, n int, k int, before string, own string, after string").repartition("h", "k")

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for b in batches:
            found = [_written(coder.transfer(own + after, len(own), coder.lefts(before + own + after, len(before)))) for before, own, after in zip(b["before"], b["own"], b["after"], strict=True)]
            yield b[["h", "n", "k"]].assign(m=found)

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in whole_groups(batches, ["h", "n", "up"]):
            ends, ms = np.append(starts[1:], len(x)), x["m"].tolist()
            yield pd.DataFrame({"h": x["h"].iloc[starts], "n": x["n"].iloc[starts], "k": x["up"].iloc[starts], "m": [ms[a] if b - a == 1 else _written(product(_read(ms[a]), _read(ms[a + 1]))) for a, b in zip(starts, ends, strict=True)]})

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [[s for s in _read(m).get(START, ()) if s[1] == 0] for m in b["m"]]
            yield b[["h", "n", "k"]].assign(left=json.dumps(START), right=[json.dumps(e[0] if e else START) for e in ends], sure=[len(e) == 1 for e in ends])

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in whole_groups(batches, ["h", "n", "up"]):
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                r = x.iloc[a]
                if b - a == 1:
                    rows.append((r["h"], r["n"], r["k"], r["left"], r["right"], r["sure"]))
                    continue
                mid = between(_read(r["m"]), _read(x.iloc[a + 1]["m"]), tuple(json.loads(r["left"])), tuple(json.loads(r["right"])))
                middle, sure = json.dumps(mid[0] if mid else START), bool(r["sure"]) and len(mid) == 1
                rows += [(r["h"], r["n"], r["k"], r["left"], middle, sure), (r["h"], r["n"], r["k"] + 1, middle, r["right"], sure)]
            yield pd.DataFrame(rows, columns=["h", "n", "k", "left", "right", "sure"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for b in batches:
            ids = [
                coder.backtrace(own + after, len(own), tuple(json.loads(a)), tuple(json.loads(z)))
                for own, after, a, z in zip(b["own"], b["after"], b["left"], b["right"], strict=True)
            ]
            yield b[["h", "n", "k"]].assign(ids=pd.Series([np.array(x, np.int32) for x in ids], index=b.index, dtype=object))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for b in batches:
            yield b[["h", "n"]].assign(pieces=pd.Series([np.frombuffer(coder.encode_normal([coder.normal(x)])[0], "<i4") for x in b["text"]], index=b.index, dtype=object))

    def paired(df: DataFrame) -> DataFrame:
        return df.repartition("h", "n", "up").sortWithinPartitions("h", "n", "up", "k")

    levels = [materialize(parts.mapInPandas(matrix, "h long, n int, k int, m string"), "matrices")]
    last = levels[0].agg(F.max("k")).first()[0] or 0
    while last:
        levels.append(materialize(paired(levels[-1].withColumn("up", F.expr("k div 2").cast("int"))).mapInPandas(up, "h long, n int, k int, m string"), "matrices"))
        last //= 2
    states = levels.pop().mapInPandas(root, "h long, n int, k int, left string, right string, sure boolean")
    for m in reversed(levels):
        children = m.withColumn("up", F.expr("k div 2").cast("int")).join(states.withColumnRenamed("k", "up"), ["h", "n", "up"])
        states = materialize(paired(children).mapInPandas(down, "h long, n int, k int, left string, right string, sure boolean"), "states")
    unsure = states.where("NOT sure").select("h", "n").distinct()
    traced = parts.join(states.join(unsure, ["h", "n"], "left_anti"), ["h", "n", "k"]).mapInPandas(trace, "h long, n int, k int, ids array<int>")
    traced = traced.groupBy("h", "n").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("pieces"))
    return traced.unionByName(texts.join(unsure, ["h", "n"], "left_semi").mapInPandas(whole, "h long, n int, pieces array<int>"))


def decode(rows: DataFrame, model_file: str, pieces_col: str = "pieces", to: str = "text") -> DataFrame:
    """rows with the text of their pieces in the column `to`; null for null pieces."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = pieces(model_file)
        for b in batches:
            yield pd.Series([None if x is None else coder.decode(np.asarray(x).tolist()) for x in b], dtype=object)

    return rows.withColumn(to, run(F.col(pieces_col)))


def round_trip(spark: SparkSession, docs: DataFrame, model_file: str, part: int = PART) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, text_sha256) of every row of docs(doc_id, text).

    The digest of the text is that of what the ids alone decode to; null and empty texts have no pieces and
    the same digest. Repeated rows are returned each. Encoding, decoding and digests of a document are made
    in one pass over it, so that a task needs one Python worker.
    """
    import hashlib

    kind = "doc_id long, n_pieces long, pieces_crc32 long, text_sha256 string"

    def digests(coder: Pieces, doc_ids: pd.Series, ids: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": doc_ids.to_numpy(), "n_pieces": [len(x) for x in ids], "pieces_crc32": [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids],
            "text_sha256": pd.Series([hashlib.sha256(coder.decode(x.tolist()).encode()).hexdigest() for x in ids], dtype=object),
        })

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for batch in batches:
            for rows in by_size(batch["text"].tolist()):
                some = batch.iloc[rows]
                ids = coder.encode_normal([coder.normal(x or "") for x in some["text"]])
                yield digests(coder, some["doc_id"], [np.frombuffer(x, "<u4") for x in ids])

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces(model_file)
        for batch in batches:
            yield digests(coder, batch["doc_id"], [np.asarray(x) for x in batch["pieces"]])

    docs, long = docs.select("doc_id", "text"), _is_long("text", part)
    giants = _giant(docs.where(long), model_file, "text", part)
    return docs.where(~long).mapInPandas(short, kind).unionByName(giants.mapInPandas(later, kind))
