"""A corpus pipeline: documents in, encoded documents out, in five stages.

Each stage takes all that its predecessor kept. The first four drop or shorten documents and return the
columns of `documents`; the last returns the encoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid, lines, pieces, simhash
from gleaner.llm.shared import discard, materialize, table


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns that no stage reads under names of their own, and each column's name there."""
    names = {c: c if c in ("doc_id", "text", "lang") else f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names


def _back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(there).alias(c) for c, there in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or whose most probable language has a score below a half, go.

    Where no labelled document can be learned from, all documents with a letter stay. Null and empty texts
    have no letter. Each row is judged by its own text, repeated ids too.
    """
    own, names = _apart(docs)
    unsure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") < 0.5)
    return _back(langid.identify(own).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & ~unsure), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated line stays once; documents that are left without a letter or digit go. n_chars is counted anew."""
    own, names = _apart(docs)
    out = lines.deduplicate_lines(own, bands=lines.BANDS).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return _back(out.withColumn(names["n_chars"], F.length("text").cast("long")), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: that of the smallest id, nulls last, then of the smallest text hash.

    A document is told by its id and text: rows that repeat both are one, rows of one id with other texts
    are not.
    """
    own, names = _apart(docs)
    own = own.withColumn("text_hash", F.xxhash64("text"))
    found = simhash.near_duplicates(own, also=("text_hash",))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kept = found.groupBy("class").agg(F.min(first).alias("best")).select(F.col("best.doc_id").alias("k_id"), F.col("best.text_hash").alias("k_hash"))
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")), "left_semi")
    return _back(out.dropDuplicates(["doc_id", "text_hash"]), names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each by its own text, whatever its id."""
    own, names = _apart(docs)
    own = own.withColumn("text_hash", F.xxhash64("text"))
    found = decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark"), with_hash=True).where("contaminated")
    gone = found.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    return _back(own.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left_anti"), names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces_crc32, text_sha256) of each document that is left."""
    import public_tokenizers

    return pieces.round_trip(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]

ORACLE_SQL = None  # SQL can't express language identification, SimHash or the encoding


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # what the stage before wrote; never the table itself
        docs = made
    return docs
