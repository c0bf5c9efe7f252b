"""Token-id output: flat unsigned integer shards with 64-bit document offsets.

A shard is two files. `part-NNNNN.ids` holds the ids of its documents one after another as
little-endian unsigned integers; `part-NNNNN.off` holds, as little-endian unsigned 64-bit integers, the
position of each document's first id and, last, the number of ids. `shards.parquet` lists the shards
with their counts and their bases: the ids and documents that lie before them, as prefix sums.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import by_size, scratch

#: Words whose ids a Python worker remembers, the longest word it remembers, and the words encoded as one text.
CACHED_WORDS, CACHED_CHARS, GROUP = 1_200_000, 64, 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def read_array(path: str, dtype: str) -> np.ndarray:
    """The whole file, memory-mapped where it is on a local or mounted disk."""
    store, at = _open(path)
    if store.type_name == "local":
        return np.memmap(at, dtype, "r") if Path(at).stat().st_size else np.empty(0, dtype)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def _write(path: str, data: Iterator[bytes]) -> None:
    """A reader sees the whole file or none: a try of its own name is written, then renamed."""
    store, at = _open(path)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for x in data:
            f.write(x)
    store.move(own, at)


class Encoder:
    """Encodes with a tokenizer file that parts words at spaces and letters from other characters.

    It must be so that a text's ids are those of its space-parted pieces one after another, that `.`,
    `,` and `!` after a letter and before a space are a piece of their own, and that ASCII text is
    lower-cased; ids that end a word end with `</w>`. Then each piece is encoded once and remembered; the memory is emptied when it is full.
    """

    def __init__(self, file: str, width: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(file), f"<u{width}"
        self.known: dict[str, bytes] = {"": b""}
        self.last = np.zeros(1 << 8 * min(width, 3), bool)  # of an id: whether it ends a word
        self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True

    @staticmethod
    def parts(word: str) -> tuple[str, str]:
        """A word as it is encoded, without the marks that end it, and those marks."""
        stem = word.rstrip(".,!")
        if not stem or not stem[-1].isalpha():
            stem = word
        tail = word[len(stem) :]
        return (stem.lower() if stem.isascii() and "<|" not in stem else stem), tail  # special tokens are matched as they are

    def _encode(self, words: list[str]) -> None:
        """Remember the ids of words that hold no space."""
        plain = [w for w in words if w.isalpha()]  # one piece each, so each ends with the id of a word's end
        other = [w for w in words if not w.isalpha()]
        known, code = self.known, self.dtype
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, code)
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                if len(ends) != len(group):
                    other += group
                    continue
                data, width, a = ids.tobytes(), ids.itemsize, 0
                for w, b in zip(group, ends, strict=True):
                    known[w] = data[a * width : b * width]
                    a = b
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, code).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of little-endian unsigned integers."""
        split = [x.replace("\n", " ").split(" ") for x in texts]
        words = set(chain.from_iterable(split))
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + 2 * len(new) > CACHED_WORDS:
            known = self.known = {"": b""}
            new = list(words)
        parts = [self.parts(w) for w in new]
        self._encode([x for x in {x for p in parts for x in p} if x not in known])
        for w, (stem, tail) in zip(new, parts, strict=True):
            known[w] = known[stem] + known[tail]
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w, (stem, _) in zip(new, parts, strict=True):
            if len(w) > CACHED_CHARS:
                known.pop(w)
                known.pop(stem, None)
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(file: str, width: int) -> Encoder:
    if (file, width) not in _encoders:
        _encoders[file, width] = Encoder(file, width)
    return _encoders[file, width]


def write_token_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode every row of docs into shards under path, ordered by id, and return the list of shards.

    Null texts count as empty; each document ends with end_id. Rows are ordered by id, then text, nulls
    first, so rows that repeat an id have a defined order and no single id has to fit one shard. width
    is the bytes of an id: 2 for vocabularies up to 65,536, else 4. An empty table gives no shards.
    A task that is run again writes the same names with the same bytes. Other columns of docs are not read, whatever
    their names.
    """
    spark = docs.sparkSession
    store, at = _open(path)
    store.create_dir(at, recursive=True)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = TaskContext.get().partitionId()
        coder, offsets, n = encoder(tokenizer_file, width), [np.zeros(1, np.uint64)], 0
        base, end = f"{path}/part-{k:05d}", end_id.to_bytes(width, "little")
        keys: list[pd.Series] = []

        def ids() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for rows in by_size(batch["text"].tolist(), 1 << 22):
                    part = batch.iloc[rows]
                    encoded = [x + end for x in coder.ids([x or "" for x in part["text"]])]
                    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // width
                    ends = np.cumsum(lengths)
                    offsets.append((n + ends).astype(np.uint64))
                    keys.append(part["doc_id"])
                    n += int(lengths.sum())
                    yield b"".join(encoded)

        _write(f"{base}.ids", ids())
        count = sum(map(len, keys))
        if not count:
            empty, at = _open(f"{base}.ids")
            empty.delete_file(at)
            return
        _write(f"{base}.off", iter([np.concatenate(offsets).tobytes()]))
        import pyarrow as pa
        import pyarrow.parquet as pq

        sink = pa.BufferOutputStream()
        pq.write_table(pa.table({"doc_id": pa.array(pd.concat(keys, ignore_index=True).astype("Int64"), pa.int64())}), sink)
        _write(f"{base}.keys.parquet", iter([sink.getvalue().to_pybytes()]))
        yield pd.DataFrame({"shard": [k], "base": [base], "n_docs": [count], "n_ids": [n]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    found = rows.mapInPandas(shard, "shard int, base string, n_docs long, n_ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = f"{path}/listed.parquet"
    found.write.parquet(listed)
    shards = spark.read.parquet(listed)  # a row for each shard
    shards = shards.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in (("n_docs", "docs_before"), ("n_ids", "ids_before"))])
    shards.write.parquet(f"{path}/shards.parquet")
    return spark.read.parquet(f"{path}/shards.parquet")


def read_token_shards(shards: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of the given shards.

    start: ids of all documents before it; ids_crc32: the unsigned crc32 of its ids as little-endian
    unsigned 32-bit integers.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for s in batch.itertuples():
                ids, off = read_array(f"{s.base}.ids", f"<u{width}"), read_array(f"{s.base}.off", "<u8").astype(np.int64)
                store, at = _open(f"{s.base}.keys.parquet")
                with store.open_input_file(at) as f:
                    keys = pq.read_table(pa.BufferReader(f.read()))["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                assert len(keys) == s.n_docs and off[-1] == s.n_ids == len(ids)
                for i in range(0, len(keys), 4096):
                    j = min(i + 4096, len(keys))
                    part = np.asarray(ids[off[i] : off[j]]).astype("<u4")
                    at_ids = off[i : j + 1] - off[i]
                    yield pd.DataFrame({
                        "doc_id": keys.iloc[i:j].to_numpy(dtype=object, na_value=None), "start": s.ids_before + off[i:j], "n_tokens": np.diff(off[i : j + 1]),
                        "ids_crc32": [zlib.crc32(part[a:b]) for a, b in zip(at_ids[:-1], at_ids[1:], strict=True)],
                    })

    n = max(1, shards.count())  # a row for each shard
    return shards.repartitionByRange(n, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    return read_token_shards(write_token_shards(docs, path or scratch(spark, "tokens"), tokenizer_file, end_id))
