"""The canonical document: schema and row constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = (
    "id string, content string, title string, breadcrumb string, domain string, topic string, subtopic string, source_type string, "
    "source_id string, authority string, source_category string, url string, source_path string, page_start int, page_end int, "
    "status string, language string, version string, last_reviewed string, validation_method string, validation_batch_id string, "
    "validation_model string, content_hash string, parent_document_id string, chunk_index int, chunk_count int, "
    "timestamp_start double, timestamp_end double, screenshot string, screenshots array<string>, software string, hotel_id string"
)
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
DOCUMENT = T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in _DDL.split(", "))])

#: Allowed values of the enumerated fields.
ENUMS = {
    "domain": ("software", "hotel"),
    "source_type": ("official_doc", "qa", "video", "internal_sop"),
    "authority": ("official", "verified_internal", "community"),
    "status": ("draft", "review_required", "verified", "deprecated"),
    "language": ("fr", "en"),
    "validation_method": ("human_individual", "batch_sampled", "automatic"),
}
REQUIRED = ("id", "content", "domain", "topic", "source_type", "source_id", "authority")


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the columns of DOCUMENT; those that are missing are null, status and language defaulted."""
    cols = {f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType) for f in DOCUMENT.fields}
    cols["status"] = F.coalesce(cols["status"], F.lit("draft"))
    cols["language"] = F.coalesce(cols["language"], F.lit("fr"))
    cols["screenshots"] = F.coalesce(cols["screenshots"], F.array().cast("array<string>"))
    return df.select(*[c.alias(n) for n, c in cols.items()])


def constraints() -> dict[str, Column]:
    """For each constraint of a document a test that holds where it is violated."""
    out = {f"required:{c}": F.col(c).isNull() for c in REQUIRED}
    out |= {f"enum:{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in ENUMS.items()}
    p0, p1 = F.col("page_start"), F.col("page_end")
    parts = [F.col(c).isNull() for c in ("parent_document_id", "chunk_index", "chunk_count")]
    none, some = parts[0] & parts[1] & parts[2], parts[0] | parts[1] | parts[2]
    return out | {
        "content:empty": F.col("content") == "",
        "pages:positive": (p0 < 1) | (p1 < 1),
        "pages:end_without_start": p1.isNotNull() & p0.isNull(),
        "pages:order": p1 < p0,
        "chunk:all_or_none": some & ~none,
        "chunk:positive": (F.col("chunk_index") < 1) | (F.col("chunk_count") < 1),
        "chunk:index": F.col("chunk_index") > F.col("chunk_count"),
    }


def violations(df: DataFrame, tests: dict[str, Column] | None = None, key: str = "id") -> DataFrame:
    """(key, violation): a row for each constraint that a row of df violates."""
    tests = constraints() if tests is None else tests
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return df.select(key, F.explode(found).alias("violation"))


def strict(df: DataFrame, tests: dict[str, Column] | None = None, key: str = "id") -> DataFrame:
    """df, or an error that names some of the violations."""
    some = violations(df, tests, key).limit(5).collect()
    if some:
        raise ValueError("invalid rows: " + "; ".join(f"{r[0]}: {r[1]}" for r in some))
    return df
