"""Text sources: headings, sections and block packing without leaving the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import stable_id
from gleaner.operators.corpus import pack

MARKDOWN = r"^#{1,6}\s+(.*?)\s*#*\s*$"
BLOCK_LIMIT = 2000


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(rel_path, suffix, text) of the files below root; no rows where root does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "rel_path string, suffix string, text string")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    rel = F.regexp_replace(full, "^.*?" + root.removeprefix("file://").rstrip("/").replace(".", r"\.") + "/", "")
    return raw.select(rel.alias("rel_path"), F.lower(F.regexp_extract(full, r"(\.[^./]*)$", 1)).alias("suffix"), F.col("value").alias("text"))


def sections(docs: DataFrame, heading: str = MARKDOWN, key: str = "source_id", text: str = "text") -> DataFrame:
    """(key, section, heading, blocks): the lines of each section, where a line of the pattern starts a new one.

    The heading is the pattern's first group. Lines before the first heading are section 0. A document is
    split inside its own row, so nothing is shuffled and no order has to be restored.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    name = lambda x: F.regexp_extract(x, heading, 1)
    start = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("blocks"))
    one = lambda h, b: F.struct(h.cast("string").alias("heading"), b.alias("blocks"))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = one(last["heading"], F.array_append(last["blocks"], x))
        return F.when(x.rlike(heading), F.array_append(acc, one(name(x), F.array().cast("array<string>")))).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown))

    return docs.select(key, F.posexplode(F.aggregate(lines, F.array(start), add)).alias("section", "x")).select(key, "section", "x.heading", "x.blocks").where(F.size("blocks") > 0)


def section_lines(docs: DataFrame, heading: str, key: str = "source_id", text: str = "text") -> DataFrame:
    """(key, pos, heading, line): each line that is no heading, under the last heading before it."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").rlike(heading)
    return lines.withColumns({"heading": F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w), "_h": is_heading}).where("NOT _h").drop("_h")


def documents(parts: DataFrame, most: int = BLOCK_LIMIT, key: str = "source_id") -> DataFrame:
    """Sections packed into documents of at most `most` characters; a block is never cut."""
    out = parts.select(key, "section", "heading", F.posexplode_outer(pack(F.col("blocks"), most, "\n")).alias("i", "content")).where("content IS NOT NULL")
    where = F.concat_ws("::", F.coalesce("heading", F.lit("")), F.concat(F.lit("part "), F.col("i") + 1))
    return out.withColumns({"id": stable_id(F.col(key), F.concat(F.col("section"), F.lit(":"), where)), "breadcrumb": F.concat_ws(" > ", key, "heading"), "part": F.col("i") + 1}).drop("i")


def with_manifest(found: DataFrame, manifest: DataFrame, language: str = "fr") -> DataFrame:
    """Files with their manifest's metadata, or the defaults: source_id, authority, status, language."""
    x = found.join(manifest, "rel_path", "left")
    stem = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    return x.withColumns({
        "source_id": F.coalesce("source_id", stem), "authority": F.coalesce("authority", F.lit("official")),
        "status": F.coalesce("status", F.lit("review_required")), "language": F.coalesce("language", F.lit(language)),
    })
