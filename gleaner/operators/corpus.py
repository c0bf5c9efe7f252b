"""Normalisation, deduplication, chunking and their reports."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.folding import ascii_key, ascii_key_of, chunk_hash, clean_lines, clean_lines_of
from gleaner.functions.phrases import first_rule
from gleaner.functions.text import portable_path, stable_id
from gleaner.operators.taxonomy import HOTEL_SUBTOPICS, SOFTWARE_RULES, TAXONOMY

#: Ranks of authorities and of states.
AUTHORITY = {"community": 1, "verified_internal": 2, "official": 3}
STATUS = {"draft": 0, "review_required": 1, "deprecated": 2, "verified": 3}
LIMITS = {"official_doc": 2400, "internal_sop": 3200}


def ranked(c: str, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(c)]


def content_hash(content: Column) -> Column:
    return F.sha2(ascii_key(content), 256)


def in_taxonomy(domain: Column, topic: Column, subtopic: Column | None = None) -> Column:
    out = F.lit(False)
    for d, topics in TAXONOMY.items():
        for t, subs in topics.items():
            here = (domain == d) & (topic == t)
            out = out | (here if subtopic is None else here & (subtopic.isin(*subs) if subs else F.lit(False)))
    return F.coalesce(out, F.lit(False))


def software_rules(text: Column) -> Column:
    """struct(topic, subtopic) of the first rule one of whose phrases is in the text's ascii_key; null for none."""
    made = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(s).cast("string").alias("subtopic")) for t, s, _ in SOFTWARE_RULES])
    return F.get(made, first_rule(text, [phrases for *_, phrases in SOFTWARE_RULES]))


def classify(df: DataFrame) -> DataFrame:
    """topic and subtopic set by the taxonomy rules of the domain; unknown hotel topics become null.

    Rules are tried on a software document's names first, then on its text, unless a topic of the
    taxonomy is given.
    """
    identity = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "breadcrumb", "source_id", "source_category", "topic", "subtopic")])
    known, fine = in_taxonomy(F.col("domain"), F.col("topic")), in_taxonomy(F.col("domain"), F.col("topic"), F.col("subtopic"))
    own = F.struct(F.col("topic"), F.when(fine, F.col("subtopic")).alias("subtopic"))
    table = F.create_map(*[x for k, (t, s) in HOTEL_SUBTOPICS.items() for x in (F.lit(k), F.struct(F.lit(t).alias("topic"), F.lit(s).alias("subtopic")))])
    general = F.struct(F.when(known, F.col("topic")).otherwise("general").alias("topic"), F.lit(None).cast("string").alias("subtopic"))
    keep = known & ((F.col("source_type") != "video") | (F.col("topic") != "general"))
    named = software_rules(F.when(F.col("domain") == "software", identity))
    undecided = (F.col("domain") == "software") & named.isNull() & ~F.coalesce(keep, F.lit(False))
    software = F.coalesce(named, F.when(keep, own), software_rules(F.when(undecided, F.col("content"))), general)
    hotel = F.coalesce(table[F.col("subtopic")], F.when(known, own))
    made = df.select(F.struct("*").alias("row"), F.when(F.col("domain") == "software", software).otherwise(hotel).alias("made"))
    return made.select("row.*", "made").withColumns({"topic": F.col("made.topic"), "subtopic": F.col("made.subtopic")}).drop("made")


@F.pandas_udf(T.StringType())
def _trail(values: pd.Series) -> pd.Series:
    def one(parts) -> str:
        kept: dict[str, str] = {}
        for v in parts:
            if text := clean_lines_of(v or ""):
                kept.setdefault(ascii_key_of(text), text)
        return " > ".join(kept.values())

    return values.map(one)


def breadcrumb(*values: Column, trail: Column | None = None) -> Column:
    """The values joined by ` > `, without blanks and without repeats of an ascii_key; trail is a joined one before the last value."""
    parts = F.array(*values)
    if trail is not None:
        steps = F.when(F.coalesce(trail, F.lit("")) != "", F.split(trail, r"\s*>\s*")).otherwise(F.array().cast("array<string>"))
        parts = F.concat(F.array(*values[:-1]), steps, F.array(values[-1]))
    return _trail(parts)


def source_category(df: DataFrame) -> Column:
    """What the source calls a document's subject, from its own topics before they are set anew."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    both = F.concat_ws("/", blank("topic"), blank("subtopic"))
    rest = F.when(F.col("domain") == "hotel", both).otherwise(F.nullif(both, F.lit("")))
    return F.when(blank("source_category").isNotNull(), F.col("source_category")).when((F.col("domain") == "software") & (F.col("source_type") == "video"), F.col("topic")).when(
        (F.col("source_type") == "qa") & blank("subtopic").isNotNull(), F.col("subtopic")).otherwise(rest)


def normalization_errors(df: DataFrame) -> DataFrame:
    """(id, error) of the documents that can't be normalised: empty, with a replacement character, of unknown hotel topic."""
    df = _with_fields(df)
    content = clean_lines(F.col("content"))
    topic = classify(df.withColumn("content", content)).select("id", "content", "domain", "topic")
    error = F.when(F.coalesce("content", F.lit("")) == "", "empty").when(F.contains("content", F.lit("\ufffd")), "replacement_character").when((F.col("domain") != "software") & F.col("topic").isNull(), "taxonomy")
    return topic.select("id", error.alias("error")).where("error IS NOT NULL")


def _with_fields(df: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in ("breadcrumb", "source_category", "source_path", "software", "hotel_id", "screenshot") if c not in df.columns}
    if "screenshots" not in df.columns:
        absent["screenshots"] = F.array().cast("array<string>")
    return df.withColumns(absent)


def normalize(df: DataFrame, root: str = "hotel software", hotel: str = "hotel", folder: str = "/data", software: str = "pms") -> DataFrame:
    """Cleaned content and title, taxonomy, breadcrumb, source category, portable paths, software, hotel and content hash.

    Documents with an error, as normalization_errors() lists them, are left out.
    """
    df = _with_fields(df)
    df = df.withColumns({"source_category": source_category(df), "content": clean_lines(F.col("content")), "title": clean_lines(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("source_id"))), "_named": F.coalesce(F.col("title"), F.lit("")) != ""})
    df = df.where((F.col("content") != "") & ~F.contains(F.col("content"), F.lit("\ufffd")))
    df = classify(df).where((F.col("domain") == "software") | F.col("topic").isNotNull())
    top = F.when(F.col("domain") == "software", F.coalesce("software", F.lit(root))).otherwise(F.coalesce("hotel_id", F.lit(hotel)))
    path = lambda c: F.nullif(portable_path(c, folder), F.lit(""))
    more = F.array_compact(F.transform(F.coalesce("screenshots", F.array().cast("array<string>")), lambda x: path(x)))
    first = path(F.col("screenshot"))
    shots = F.when(F.coalesce(F.array_contains(more, first), F.lit(True)), more).otherwise(F.concat(F.array(first), more))  # one that is there stays in its place
    return df.withColumns({
        "breadcrumb": breadcrumb(top, F.col("topic"), F.col("subtopic"), F.when(F.col("_named"), F.col("title")), trail=F.col("breadcrumb")), "content_hash": content_hash(F.col("content")),
        "source_path": path(F.col("source_path")), "screenshot": path(F.col("screenshot")), "screenshots": F.array_distinct(shots),
        "software": F.when(F.col("domain") == "software", F.coalesce("software", F.lit(software))).otherwise(F.col("software")),
        "hotel_id": F.when(F.col("domain") == "hotel", F.coalesce("hotel_id", F.lit(hotel))).otherwise(F.col("hotel_id")),
    }).drop("_named")


def deduplicate(df: DataFrame, hash_col: str = "content_hash", on_conflict: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(kept documents, (dropped_id, kept_id, content_hash)): one document of each id, then of each domain and hash.

    The highest authority wins, then status, source type and id. One id with two hashes is an error when
    the result is read; with on_conflict="list" such ids are left out, and id_conflicts() names them.
    Hashes are computed once; only ids, hashes and ranks are shuffled to find the winners, by aggregates
    with map-side combining, so a hash that very many documents share needs no task of its own. Texts are
    joined last, by id.
    """
    rank = F.struct(ranked("authority", AUTHORITY).alias("a"), ranked("status", STATUS).alias("s"), F.col("source_type").alias("t"), F.col("domain").alias("d"))
    slim = df.select(F.col("id").alias("kept_id"), F.col(hash_col).alias("h"), rank.alias("r"))
    by_id = slim.groupBy("kept_id").agg(F.max("r").alias("r"), F.min("h").alias("h"), F.max("h").alias("other"))
    clash = F.col("h") != F.col("other")
    if on_conflict == "raise":
        by_id = by_id.withColumn("h", F.when(clash, F.raise_error(F.concat(F.lit("one id with two contents: "), "kept_id")).cast("string")).otherwise(F.col("h")))
    else:
        by_id = by_id.where(F.coalesce(~clash, F.lit(True)))
    best = by_id.groupBy(F.col("r.d").alias("d"), "h").agg(F.max(F.struct("r.a", "r.s", "r.t", F.col("kept_id").alias("i"))).alias("best"))
    ranked_ids = by_id.join(best.select(F.col("d").alias("b_d"), F.col("h").alias("b_h"), F.col("best.i").alias("best")), F.col("r.d").eqNullSafe(F.col("b_d")) & F.col("h").eqNullSafe(F.col("b_h")))
    trace = ranked_ids.where("kept_id <> best").select(F.col("kept_id").alias("dropped_id"), F.col("best").alias("kept_id"), F.col("h").alias("content_hash"))
    winners = ranked_ids.where("kept_id = best").select("kept_id", F.col("h").alias(hash_col), F.col("r").alias("_r"))
    kept = df.drop(hash_col).join(winners, (F.col("id") == F.col("kept_id")) & rank.eqNullSafe(F.col("_r"))).drop("kept_id", "_r")
    one = Window.partitionBy("id").orderBy(F.xxhash64(*[F.col(c) for c in df.columns]))  # of rows of one id, hash and rank the same one, whatever their order
    kept = kept.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.select(*df.columns), trace


def id_conflicts(df: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    return df.groupBy("id").agg(F.min(hash_col).alias("a"), F.max(hash_col).alias("b")).where("a <> b").select("id")


def packed(parts: Sequence[str], most: int, glue: str) -> list[str]:
    """Neighbouring parts joined greedily while the result has at most `most` characters; a longer part stays whole.

    With the sums of the lengths up to each part, the end of a run is found by binary search from its start,
    so each result costs one search and one join.
    """
    n = len(glue)
    ends = list(accumulate(len(p) + n for p in parts))
    out, i, before = [], 0, 0
    while i < len(ends):
        j = max(i + 1, bisect_right(ends, before + most + n, i))
        out.append(glue.join(parts[i:j]))
        i, before = j, ends[j - 1]
    return out


def pack(parts: Column, most: int, glue: str) -> Column:
    """packed() of an array of texts; null of null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: packed(list(x), most, glue), na_action="ignore")

    return run(parts)


def _split_sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?;:])\s+"), lambda s: s != "")


def sentences(text: Column, most: int) -> Column:
    return pack(_split_sentences(text), most, " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _packed_paragraphs(rows: pd.Series, limits: pd.Series) -> pd.Series:
    def one(paragraphs, most: int) -> list[str]:
        return packed([f for p in paragraphs for f in packed(list(p), most, " ")], most, "\n\n")

    return pd.Series([None if x is None else one(x, int(m)) for x, m in zip(rows, limits, strict=True)], dtype=object)


def structural_parts(content: Column, most: Column) -> Column:
    """Paragraphs packed to `most` characters, longer ones by their sentences before; null of null, an empty array of blank text."""
    paragraphs = F.filter(F.transform(F.split(content, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return _packed_paragraphs(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(_split_sentences(p))), most)


def chunk(df: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Chunks of documents by their type's limit; other types, and what fits, stay whole under their id.

    Only texts that are split cross over to Python. A chunk's row carries neither its document's text nor the
    other chunks, so the rows of a document take as much room as the document.
    """
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("source_type")]
    made = structural_parts(F.when(F.length("content") > most, F.col("content")), most)
    parts = df.withColumn("_parts", F.when(F.size(made) > 0, made).otherwise(F.array("content")))
    rest = [c for c in df.columns if c != "content"]
    out = parts.select(*rest, F.size("_parts").alias("_n"), "_parts").select(*rest, "_n", F.posexplode_outer("_parts").alias("_i", "content"))  # outer: no filter is inferred that packs a second time
    split = F.col("_n") > 1
    cols = {
        "parent_document_id": F.col("id"), "chunk_index": (F.col("_i") + 1).cast("int"), "chunk_count": F.col("_n"), "content_hash": chunk_hash(F.col("content")),
        "id": F.when(split, stable_id(F.col("source_id"), F.concat(F.col("id"), F.lit(":chunk:"), F.col("_i") + 1))).otherwise(F.col("id")),
    }
    if "breadcrumb" in df.columns:
        cols["breadcrumb"] = F.when(split, F.concat("breadcrumb", F.lit(" > partie "), F.col("_i") + 1, F.lit("/"), F.col("_n"))).otherwise(F.col("breadcrumb"))
    made = out.withColumns(cols)
    return made.select(*df.columns, *[c for c in made.columns if c not in df.columns and c not in ("_i", "_n")])


def nearest_rank(df: DataFrame, value: str, ratios: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Elements at floor((n - 1) * ratio) of the sorted values, from counts of the distinct values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    c = counts.withColumns({"_upto": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    at = {k: F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") - 1) * r) + 1, F.col(value))).alias(k) for k, r in ratios.items()}
    return c.groupBy(*by).agg(*at.values())


def counts_report(df: DataFrame) -> DataFrame:
    """(dimension, key, n): counts by domain, source type, status, authority, and topic within a domain."""
    dims = {"domain": F.col("domain"), "source_type": F.col("source_type"), "status": F.col("status"), "authority": F.col("authority"), "topic": F.concat_ws("/", "domain", "topic")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("key")) for k, v in dims.items()]))
    return df.select(pairs.alias("x")).groupBy("x.dimension", "x.key").agg(F.count(F.lit(1)).alias("n"))


def authority_errors(df: DataFrame) -> DataFrame:
    kind, a = F.col("source_type"), F.col("authority")
    fine = F.when(kind.isin("official_doc", "video"), a == "official").when(kind == "internal_sop", a == "verified_internal").when(kind == "qa", a.isin("official", "verified_internal", "community")).otherwise(F.lit(True))
    return df.where(~fine).select("id", "source_type", "authority")


#: Fields that every document, one of a domain, and a video must have.
BASE_FIELDS = ("id", "content", "title", "breadcrumb", "domain", "topic", "source_type", "source_id", "authority", "status", "language", "source_path", "content_hash")
SOFTWARE_FIELDS, HOTEL_FIELDS, VIDEO_FIELDS = ("software",), ("hotel_id", "last_reviewed"), ("timestamp_start", "timestamp_end", "screenshot")


def missing_metadata(df: DataFrame, fields: tuple[str, ...] = BASE_FIELDS, by_kind: bool = True) -> DataFrame:
    """(id, missing): the fields that are null or empty, in order; by_kind adds those of the domain and of videos."""
    blank = lambda c: (F.col(c).isNull() | (F.col(c).cast("string") == "")) if c in df.columns else F.lit(True)
    tests = [(c, F.lit(True)) for c in fields]
    if by_kind:
        software = F.col("domain") == "software"
        tests += [(c, software) for c in SOFTWARE_FIELDS] + [(c, ~software) for c in HOTEL_FIELDS] + [(c, F.col("source_type") == "video") for c in VIDEO_FIELDS]
    gone = F.array_compact(F.array(*[F.when(needed & blank(c), F.lit(c)) for c, needed in tests]))
    return df.select("id", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


def normalization_report(inputs: DataFrame, outputs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: inputs, outputs, duplicates, texts that cleaning changed, violations of each kind, and whether chunking may start."""
    changed = inputs.agg(F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("content") != clean_lines(F.col("content"))).alias("texts_changed"))
    taxonomy = ~in_taxonomy(F.col("domain"), F.col("topic")) | (F.col("subtopic").isNotNull() & ~in_taxonomy(F.col("domain"), F.col("topic"), F.col("subtopic")))
    made = outputs.agg(F.count(F.lit(1)).alias("outputs"), F.count_if(F.col("content") == "").alias("empty_content"), F.count_if(taxonomy).alias("taxonomy_errors"))
    parts = [changed, made, duplicates.agg(F.count(F.lit(1)).alias("duplicates_removed")), missing_metadata(outputs).agg(F.count(F.lit(1)).alias("missing_metadata")), authority_errors(outputs).agg(F.count(F.lit(1)).alias("authority_errors"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("ready_for_chunking", F.col("empty_content") + F.col("missing_metadata") + F.col("taxonomy_errors") + F.col("authority_errors") == 0)


def chunk_report(documents: DataFrame, chunks: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(source_type, documents, chunks, split_documents, long_chunks, broken_qa, lost): per type, long ones being over its limit.

    A question's chunk must be whole, with both its labels; a type is lost where it has fewer chunks than
    documents. Order statistics of sizes are nearest_rank()'s.
    """
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("source_type")], F.lit(1 << 30))
    whole = (F.col("chunk_count") == 1) & F.contains("content", F.lit("Question :")) & F.contains("content", F.lit("Reponse :"))
    c = chunks.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.when(F.col("chunk_count") > 1, F.col("parent_document_id"))).alias("split_documents"),
        F.count_if(F.length("content") > most).alias("long_chunks"), F.count_if((F.col("source_type") == "qa") & ~whole).alias("broken_qa"))
    d = documents.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"))
    x = d.join(c, "source_type", "full").na.fill(0)
    return x.select("source_type", "documents", "chunks", "split_documents", "long_chunks", "broken_qa", (F.col("chunks") < F.col("documents")).alias("lost"))


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
