"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

The weights are trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample
of labelled documents; document frequencies are counted over all of them; a temperature is fitted last.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import by_bytes

BITS, ORDERS = 16, (1, 2, 3)
#: Characters that are turned into n-grams at once; longer texts are summed over such pieces.
PIECE = 1 << 17
#: Documents of each language that fit the weights, and that fit the temperature.
FIT_DOCS, CALIBRATE_DOCS = 600, 200
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 1e-4, 1e-3, 20.0
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]")  # never a letter

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(document positions, hashed n-grams by order, start of each in them) for runs of the texts.

    Letters are lower-cased and each run of other characters is one space before the next word. An n-gram
    ends with the word it began in, the rest being spaces, so it depends on nothing beyond its word. A
    document without a letter does not occur. A document longer than PIECE occurs once for each of its
    pieces, which are cut between words; their n-grams together are those of the whole.
    """
    own, some, n = [], [], 0
    for d, text in enumerate(texts):
        text, i = (text or "").lower(), 0
        while i < len(text):
            found = _OTHER.search(text, i + PIECE)
            j = found.end() if found else len(text)
            own.append(d)
            some.append(text[i:j])
            n, i = n + j - i, j
            if n >= PIECE:
                yield from _grams(own, some)
                own, some, n = [], [], 0
    yield from _grams(own, some)


def _grams(own: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    if not own:
        return
    code = np.frombuffer("".join(f" {x}" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in texts])
    letter = letters()[code]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the character before a word
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    kept = np.concatenate(([0], np.cumsum(keep)))[ends]
    starts = np.concatenate(([0], kept[:-1]))
    some = kept > starts
    if not some.any():
        return
    n, space = len(code), np.uint64(32)
    code = np.concatenate((code, np.full(max(ORDERS), space)))
    hashed, h, over = [], np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(max(ORDERS)):
        at = code[k : n + k]
        over |= (at == space) & (k > 0)
        h = (h + np.where(over, space, at) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            hashed.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
    yield np.array(own)[some], hashed, starts[some]


@dataclass
class Model:
    """values: weight times inverse document frequency, by n-gram and language."""

    languages: list[str]
    values: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, number of n-grams) of each text; none for a text without a letter."""
        total, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        columns = [np.ascontiguousarray(self.values[:, c]) for c in range(len(self.languages))]
        for own, hashed, starts in pieces(texts):
            np.add.at(total, own, np.diff(np.append(starts, len(hashed[0]))) * len(hashed))
            for g in hashed:
                for c, v in enumerate(columns):
                    np.add.at(sums[:, c], own, np.add.reduceat(v[g], starts))
        return self.bias + SCALE * sums / np.maximum(total, 1)[:, None], total

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        z, total = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        names = np.array([*self.languages, UNDETERMINED], object)
        return pd.DataFrame({"lang_pred": names[np.where(total > 0, best, len(self.languages))], "score": np.where(total > 0, p[np.arange(len(p)), best], 0.0)})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) from rows of (feature numbers, values, class), by FTRL-proximal."""
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def _document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Over all rows: the documents with each n-gram, and the documents with any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for some in by_bytes(batch.column(0)):
                seen: dict[int, np.ndarray] = {}
                for own, hashed, starts in pieces(batch.column(0)[some].to_pylist()):
                    bounds = np.append(starts, len(hashed[0]))
                    for k, d in enumerate(own):
                        mark = seen.setdefault(int(d), np.zeros(1 << BITS, bool)) if k in (0, len(own) - 1) else np.zeros(1 << BITS, bool)
                        for g in hashed:
                            mark[g[bounds[k] : bounds[k + 1]]] = True
                        if k not in (0, len(own) - 1):  # only these can go on in another piece
                            df[np.flatnonzero(mark)] += 1
                            n += 1
                for mark in seen.values():
                    df[np.flatnonzero(mark)] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["j", "n"])

    # tasks as the cluster has cores, not as the input has blocks: each gives a row for each n-gram
    few = docs.select(F.col(text_col).alias("text")).coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    total = few.mapInArrow(count, "j int, n long").groupBy("j").agg(F.sum("n").alias("n"))
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in total.toLocalIterator():  # 2**BITS + 1 rows at most
        if r["j"] < 0:
            n = r["n"]
        else:
            df[r["j"]] = r["n"]
    return df, n


def _sample(docs: DataFrame, counts: dict[str, int], most: int, salt: int) -> DataFrame:
    """About `most` documents of each language at most, picked by a hash of id and text; repeated rows count once."""
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])
    own = F.xxhash64("doc_id", "text", F.lit(salt))
    return docs.where(F.pmod(own, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).withColumn("own", own).dropDuplicates(["own", "lang"]).drop("own")


def _features(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, n-gram numbers, shares) of the documents of a bounded sample that have a letter."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                tf = np.zeros(1 << BITS)
                for _, hashed, _ in pieces([r.text]):
                    for g in hashed:
                        tf += np.bincount(g, minlength=1 << BITS)
                at = np.flatnonzero(tf)
                if len(at):
                    yield pd.DataFrame({"doc_id": [r.doc_id], "lang": [r.lang], "at": [at.astype(np.int32)], "share": [(tf[at] / tf.sum()).astype(np.float32)]})

    found = docs.mapInPandas(count, "doc_id long, lang string, at array<int>, share array<float>").collect()
    return [(r["lang"], np.array(r["at"]), np.array(r["share"])) for r in sorted(found, key=lambda r: (r["lang"], r["doc_id"], len(r["at"])))]


def train(docs: DataFrame, fit: Column, calibrate: Column, fit_docs: int = FIT_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model | None:
    """A model from docs(doc_id, text, lang); None where no labelled text has a letter.

    Document frequencies come from all rows of docs with a text and a lang. The weights are fitted to
    about fit_docs rows of each language where fit holds, the temperature to about calibrate_docs where
    calibrate holds; these two bounds are the only sampling.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {(r["lang"], r["f"]): r["n"] for r in docs.groupBy("lang", fit.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    of_fit = {lang: n for (lang, f), n in sorted(counts.items(), key=str) if f}
    if not of_fit:
        return None
    df, n = _document_frequencies(docs, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = _features(_sample(docs.where(fit), of_fit, fit_docs, 1))
    if not rows:
        return None
    languages = sorted({lang for lang, _, _ in rows})
    w, bias = ftrl([(at, SCALE * share * idf[at], languages.index(lang)) for lang, at, share in rows], len(languages))
    model = Model(languages, w * idf[:, None], bias)
    held = {lang: n for (lang, f), n in sorted(counts.items(), key=str) if not f and lang in languages}
    rows = _features(_sample(docs.where(calibrate), held, calibrate_docs, 2)) if held else []
    rows = [r for r in rows if r[0] in languages]
    if rows:
        z = np.array([bias + SCALE * (share @ model.values[at]) for _, at, share in rows])
        y = np.array([languages.index(lang) for lang, _, _ in rows])
        model.temperature = _temperature(z, y)
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature that gives the labels y the highest likelihood, by golden-section search."""

    def loss(t: float) -> float:
        return -float(np.log(softmax(z / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); `und` and 0 for null texts and texts without a letter.

    Without a model, every row is `und`. Columns of docs of these two names are replaced, others are kept.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS values a language

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # texts come alone, and only what is made of them goes back: the rows stay in Spark
        for batch in batches:
            lang, score = [], []
            for some in by_bytes(batch):
                p = shared.value.predict(batch[some].to_pylist())
                lang += p["lang_pred"].tolist()
                score.append(p["score"].to_numpy(np.float64))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    made = kept.select("*", run.asNondeterministic()(F.col(text_col)).alias("lang_pred"))  # once a row, whatever is asked of it
    return made.select(*kept.columns, F.col("lang_pred.lang_pred"), F.col("lang_pred.score"))


def fold(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score; docs has the columns doc_id, text and lang.

    Rows of fold 2 of 4 (crc32 of the id), and rows with a null id, are held out from all learning;
    folds 0 and 1 fit the weights and fold 3 the temperature. Only the text enters a prediction. Every row
    is returned, repeated ids too, each with the prediction of its own text; rows that repeat id, text and
    lang are learned from once. Columns held_out, lang_pred and score of docs are replaced, all others kept.
    Texts of any length are summed over pieces, to the same n-grams.
    """
    f = fold("doc_id", 4)
    held = F.coalesce(f == 2, F.lit(True))
    model = train(docs.select("doc_id", "text", "lang").where(~held), f < 2, f == 3)
    return predict(docs.withColumn("held_out", held), model)
