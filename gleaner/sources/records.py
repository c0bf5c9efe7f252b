"""Record sources and sinks: question files, cards, evaluation sets, suggestions; versioned tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import stable_id
from gleaner.sources.snapshot import put

FAQ = (
    "question string, answer string, source_id string, topic string, subtopic string, authority string, status string, url string, source_path string, "
    "version string, last_reviewed string, language string, screenshot string, screenshots array<string>"
)
CARD = (
    "id string, title string, domain string, category string, subcategory string, situation string, procedure array<string>, exceptions array<string>, "
    "escalation array<string>, status string, language string, last_reviewed string, review_questions array<string>"
)


def faq_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, violations) of lines(file, line_number, value): one question and its answer each.

    A line that is no JSON object, or that lacks a question or an answer, is a violation with its place.
    """
    x = lines.where(F.trim("value") != "").withColumn("j", F.from_json("value", FAQ))
    absent = lambda c: F.coalesce(F.trim(F.col(f"j.{c}")), F.lit("")) == ""
    problem = F.when(F.col("j").isNull(), "json").when(absent("question"), "question").when(absent("answer"), "answer")
    x = x.withColumn("problem", problem)
    bad = x.where("problem IS NOT NULL").select("file", "line_number", "problem")
    stem = F.regexp_replace("file", r"^.*/|\.[^.]*$", "")
    question, answer = F.trim("j.question"), F.trim("j.answer")
    good = x.where("problem IS NULL").select(
        F.coalesce("j.source_id", stable_id(stem, question)).alias("source_id"), question.alias("title"),
        F.concat(F.lit("Question : "), question, F.lit("\n\nReponse : "), answer).alias("content"), F.lit("qa").alias("source_type"),
        F.coalesce("j.topic", F.lit("general")).alias("topic"), "j.subtopic", F.coalesce("j.authority", F.lit("official")).alias("authority"),
        F.coalesce("j.status", F.lit("review_required")).alias("status"), F.coalesce("j.language", F.lit("fr")).alias("language"), "j.url",
    )
    return good, bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) of the lines of text files; a file is read as one row and split inside it."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "value")).select("file", (F.col("i") + 1).alias("line_number"), "value")


def faq_identity(manifest_id: Column, file: Column) -> Column:
    name = F.regexp_replace(file, r"^.*/", "")
    return F.coalesce(manifest_id, F.nullif(F.regexp_extract(name, r"^(\d+)-", 1), F.lit("")), F.regexp_replace(name, r"\.[^.]*$", ""))


def faq_pages(pages: DataFrame) -> DataFrame:
    """(file, content) from pages(file, page, text): pages in order, each after its number; blank last ones are dropped."""
    full = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page", F.trim("text").alias("t")))))
    parts = F.transform(full, lambda p: F.concat(F.lit("[Page "), p["page"], F.lit("]\n"), p["t"]))
    return pages.groupBy("file").agg(F.array_join(parts, "\n\n").alias("content"))


def cards(files: DataFrame) -> DataFrame:
    """Cards from files(rel_path, text) of YAML; names that begin with _ are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            yield pd.DataFrame({"rel_path": b["rel_path"], "value": pd.Series([json.dumps(yaml.safe_load(t), default=str) for t in b["text"]], index=b.index, dtype=object)})

    own = files.where(~F.element_at(F.split("rel_path", "/"), -1).startswith("_")).select("rel_path", "text")
    return own.mapInPandas(run, "rel_path string, value string").select("rel_path", F.from_json("value", CARD).alias("c")).select("rel_path", "c.*")


def card_violations(cards: DataFrame) -> DataFrame:
    ready = F.col("status").isin("review_required", "verified")
    tests = {
        "domain": F.col("domain") != "hotel", "procedure": ready & (F.coalesce(F.size("procedure"), F.lit(0)) <= 0),
        "open_questions": (F.col("status") == "verified") & (F.coalesce(F.size("review_questions"), F.lit(0)) > 0),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return cards.select("id", F.explode(found).alias("violation"))


def card_content() -> Column:
    """A card's text: its situation, numbered procedure, and bullets of exceptions and escalation, where there are any."""
    steps = F.transform("procedure", lambda s, i: F.concat(i + 1, F.lit(". "), s))
    bullets = lambda c: F.transform(c, lambda s: F.concat(F.lit("- "), s))
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), bullets(c))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("Situation : "), "situation"), F.lit("Procedure :"))
    return F.array_join(F.concat(head, steps, part("Exceptions :", "exceptions"), part("Escalade :", "escalation")), "\n")


def suggestions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin("proposal_only", "error"))


def faq_recovery(expected: DataFrame, recovered: DataFrame) -> DataFrame:
    """Counts over expected(key, status) and recovered(key): manifest entries, downloads, recoveries, errors left."""
    x = expected.groupBy("key").agg(F.max("status").alias("status")).join(recovered.select("key").distinct().withColumn("_r", F.lit(True)), "key", "left")
    got = F.col("_r").isNotNull()
    return x.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.count_if(got).alias("recovered"), F.count_if((F.col("status") == "error") & ~got).alias("errors"))


def publish(df: DataFrame, path: str) -> str:
    """Write df as a new version under path and point `current` at it; readers never see half a table."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    put(df.sparkSession, f"{path}/current", version.encode())
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")
