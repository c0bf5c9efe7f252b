"""Queries of the sources: HTML pages, headed text, question files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.registry import query, scratch, table
from gleaner.sources import corpus, folder, html, records, text
from gleaner.sources.snapshot import put

SHORT = "^.{1,40}$"


@query()
def sc7_html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, PR5, CH1: pages to packed documents."""
    parts = html.html_sections(table(spark, sf_dir, "pages"))
    return text.documents(parts, key="page_id").select("page_id", "section", "heading", "part", "id", F.length("content").alias("n_chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, regexp_matches(line, '^.{1,40}$') AS is_h, last_value(CASE WHEN regexp_matches(line, '^.{1,40}$') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, heading, line FROM h WHERE NOT is_h""")
def sc8_headed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8, SC9, WI12: short lines as headings."""
    return text.section_lines(table(spark, sf_dir, "documents"), SHORT, "doc_id")


@query("""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'question' WHEN trim(text) = '' THEN 'answer' ELSE 'fine' END AS outcome FROM conversations""")
def sc15_faq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SC16: turns as lines of a question file; a system turn gives a line without a question."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.when(F.col("role") != "system", F.concat(F.lit("q"), "turn")).alias("question"), F.col("text").alias("answer"), F.concat_ws(":", "conv_id", "turn").alias("source_id")))
    good, bad = records.faq_lines(c.select(F.concat_ws(":", "conv_id", "turn").alias("file"), F.lit(1).alias("line_number"), line.alias("value")))
    both = good.select(F.col("source_id").alias("k"), F.lit("fine").alias("outcome")).unionByName(bad.select(F.col("file").alias("k"), F.col("problem").alias("outcome")))
    return both.select(F.split_part("k", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id"), F.split_part("k", F.lit(":"), F.lit(2)).cast("bigint").alias("turn"), "outcome")


@query("SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def sc19_faq_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18, SC19: turns as the pages of a file."""
    c = table(spark, sf_dir, "conversations")
    return records.faq_pages(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), "text")).withColumnRenamed("file", "conv_id")


@query("""
WITH e AS (SELECT DISTINCT doc_id AS key, CASE WHEN quality = 1 THEN 'downloaded' ELSE 'error' END AS status FROM labels), r AS (SELECT DISTINCT doc_id AS key FROM documents WHERE n_chars > 500)
SELECT count(*) AS expected, CAST(count_if(status = 'downloaded') AS BIGINT) AS downloaded, CAST(count_if(r.key IS NOT NULL) AS BIGINT) AS recovered, CAST(count_if(status = 'error' AND r.key IS NULL) AS BIGINT) AS errors FROM e LEFT JOIN r ON e.key = r.key""")
def ag19_faq_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19, JO3."""
    e = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "downloaded").otherwise("error").alias("status"))
    return records.faq_recovery(e, table(spark, sf_dir, "documents").where("n_chars > 500").select(F.col("doc_id").alias("key")))


@query("SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_blocks FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def sc10_plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, SC13: documents as plain text files, a block for each line."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return corpus.plain_sections(d).select(F.col("source_id").alias("doc_id"), F.size("blocks").alias("n_blocks"))


@query("""
WITH f AS (SELECT page_id, replace(url, 'http://', '') AS rel_path FROM pages), m AS (SELECT rel_path, 'id' || page_id AS source_id, CASE WHEN page_id % 4 = 0 THEN 'verified' END AS status FROM f WHERE page_id % 2 = 0)
SELECT f.page_id, coalesce(m.source_id, regexp_replace(f.rel_path, '\\.[^./]*$', '')) AS source_id, 'official' AS authority, coalesce(m.status, 'review_required') AS status, 'fr' AS language FROM f LEFT JOIN m USING (rel_path)""")
def sc6_manifest_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4 to SC6, SC14, JO1: pages as files, every other one in a manifest."""
    f = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("http://"), F.lit("")).alias("rel_path"))
    m = f.where("page_id % 2 = 0").select("rel_path", F.concat(F.lit("id"), "page_id").alias("source_id"), F.lit(None).cast("string").alias("authority"), F.when(F.col("page_id") % 4 == 0, "verified").alias("status"), F.lit(None).cast("string").alias("language"))
    return text.with_manifest(f, m).select("page_id", "source_id", "authority", "status", "language")


_TRAILS = ("Facture d'acompte", "Les réservations > planning", "No show", "Rapport > statistique", "Chambres & ménage", "Profil client", "Droits", "Paramétrage général", "")
_LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in _TRAILS) + "]"


@query(f"""
WITH k AS (SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(split_part(text, chr(10), 1) || ' ' || ({_LIST})[doc_id % {len(_TRAILS)} + 1]), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g') AS k FROM documents)
SELECT doc_id, CASE {' '.join("WHEN " + ' OR '.join(f"contains(k, '{w}')" for w in words) + f" THEN '{t}'" for t, words in corpus.SECTION_TOPICS)} ELSE 'general' END AS topic FROM k""")
def tx29_section_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX7, TX29: first lines with headings added."""
    pick = F.element_at(F.array(*map(F.lit, _TRAILS)), (F.col("doc_id") % len(_TRAILS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.section_topic(F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" "), pick)).alias("topic"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\r\\f\\v]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def tx4_squeezed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.functions.folding import squeeze_blanks

    return table(spark, sf_dir, "documents").select("doc_id", squeeze_blanks(F.col("text")).alias("text"))


PAGE = "WITH p AS (SELECT conv_id, turn, 'FAQ logiciel de gestion hôtelière' || chr(10) || chr(10) || text || chr(10) || 'Page ' || turn || ' / 9' || chr(10) AS raw, text FROM conversations)"


@query(f"""{PAGE}, l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS l FROM p)
SELECT conv_id, turn, trim(regexp_replace(array_to_string(l, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS page FROM l""")
def tx5_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX5: turns between a page's header and its number."""
    raw = F.concat(F.lit("FAQ logiciel de gestion hôtelière\n\n"), "text", F.lit("\nPage "), "turn", F.lit(" / 9\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", corpus.clean_page(raw).alias("page"))


@query()
def tx21_repeated_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX6, TX21: pages that begin with their question, or with most of it."""
    c = table(spark, sf_dir, "conversations")
    question = F.split_part("text", F.lit("."), F.lit(1))
    page = F.concat(F.when(F.col("turn") % 2 == 0, question).otherwise(F.lit("Other heading")), F.lit("\n\n"), "text")
    return c.select("conv_id", "turn", corpus.without_question(page, question).alias("page"))


@query("""
WITH f AS (SELECT page_id, 'd' || page_id % 7 AS dir, CASE WHEN page_id % 3 = 0 THEN page_id || '-name.pdf' ELSE 'name' || page_id || '.pdf' END AS filename FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'm' || page_id WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'name' || page_id END AS source_id, CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN 'verified' ELSE 'review_required' END AS status FROM f""")
def sc20_question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19 to SC21, JO2: pages as question files, every fifth in its folder's manifest."""
    n = F.col("page_id")
    f = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d"), n % 7).alias("dir"), F.when(n % 3 == 0, F.concat("page_id", F.lit("-name.pdf"))).otherwise(F.concat(F.lit("name"), "page_id", F.lit(".pdf"))).alias("filename"))
    m = f.where("page_id % 5 = 0").select("dir", "filename", F.concat(F.lit("m"), "page_id").alias("manifest_id"), F.lit("q").alias("question"), F.when(n % 2 == 0, "downloaded").otherwise("error").alias("status"))
    return corpus.with_question(f, m).select("page_id", "source_id", "status")


@query("SELECT 'd' || conv_id % 3 AS dir, role AS filename, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def sc17_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_names(table(spark, sf_dir, "conversations").select(F.concat(F.lit("d"), F.col("conv_id") % 3).alias("dir"), F.col("role").alias("filename")))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as card files: their turns by role are the situation, procedure and exceptions."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"), of("system").alias("s"))
    n = F.col("conv_id")
    card = F.struct(F.concat(F.lit("card"), n).alias("id"), F.concat(F.lit("Card "), n).alias("title"), F.when(n % 4 == 0, "software").otherwise("hotel").alias("domain"), F.lit("payments").alias("category"), F.when(n % 3 == 0, "refund").alias("subcategory"),
                    F.concat_ws(" ", "u").alias("situation"), F.col("a").alias("procedure"), F.col("s").alias("exceptions"), F.when(n % 2 == 0, "verified").otherwise("review_required").alias("status"), F.lit("fr").alias("language"), F.when(n % 5 == 0, F.array(F.lit("why?"))).alias("review_questions"))
    return records.cards(g.select(F.concat(F.when(n % 6 == 0, "_").otherwise(""), F.lit("c"), n, F.lit(".yaml")).alias("rel_path"), F.to_json(card).alias("text")))


CARDS = """
WITH c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS u, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS a, coalesce(list(text ORDER BY turn) FILTER (role = 'system'), []) AS s FROM conversations GROUP BY conv_id)
"""


@query(f"""{CARDS}
SELECT substring(sha1('card' || conv_id || '::card'), 1, 16) AS id, array_to_string(list_concat(['Situation : ' || u, 'Procedure :'], list_transform(a, lambda x, i: i || '. ' || x), CASE WHEN len(s) > 0 THEN list_concat(['Exceptions :'], list_transform(s, lambda x: '- ' || x)) ELSE [] END), chr(10)) AS content,
  'payments > ' || CASE WHEN conv_id % 3 = 0 THEN 'refund' ELSE 'Card ' || conv_id END || ' > Card ' || conv_id AS breadcrumb FROM c WHERE conv_id % 6 <> 0""")
def pr3_card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR3, SC22: cards to documents."""
    return corpus.card_documents(_cards(spark, sf_dir)).select("id", "content", "breadcrumb")


@query(f"""{CARDS}
SELECT 'card' || conv_id AS id, unnest(list_filter([CASE WHEN conv_id % 4 = 0 THEN 'domain' END, CASE WHEN len(a) = 0 THEN 'procedure' END, CASE WHEN conv_id % 2 = 0 AND conv_id % 5 = 0 THEN 'open_questions' END], lambda x: x IS NOT NULL)) AS violation FROM c WHERE conv_id % 6 <> 0""")
def fi5_card_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.card_violations(_cards(spark, sf_dir))


@query("""
WITH s AS (SELECT source, count(*) AS documents, count(DISTINCT doc_id) AS ids FROM documents GROUP BY source)
SELECT source, documents, CAST(coalesce(v, 0) AS BIGINT) AS verified, CAST(greatest(0, 120 - documents) AS BIGINT) AS missing FROM s LEFT JOIN (SELECT source, count(*) AS v FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) GROUP BY source) USING (source)""")
def ag18_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: of each source what there is, what is verified, and what is missing of an expected number."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    d = table(spark, sf_dir, "documents").join(good, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("good").alias("verified"))
    return d.withColumn("missing", F.greatest(F.lit(0), 120 - F.col("documents")))


@query("SELECT source_type, count(*) AS n FROM (SELECT 'qa' AS source_type FROM conversations UNION ALL SELECT 'official_doc' FROM pages UNION ALL SELECT 'video' FROM events UNION ALL SELECT 'internal_sop' FROM documents) GROUP BY source_type")
def so1_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SC3, SO1: four sources in one schema."""
    part = lambda name, kind, key, content: table(spark, sf_dir, name).select(F.concat(F.lit(kind), key).alias("id"), F.col(content).alias("content"), F.lit(kind).alias("source_type"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("qa"), "conv_id", F.lit(":"), "turn").alias("id"), F.col("text").alias("content"), F.lit("qa").alias("source_type"))
    return corpus.load_all(c, part("pages", "official_doc", "page_id", "html"), part("events", "video", "event_id", "props"), part("documents", "internal_sop", "doc_id", "text")).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT source, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents)
SELECT source, CAST(1 AS BIGINT) AS listed, CAST(sum(n) AS BIGINT) AS n_lines FROM d GROUP BY source HAVING sum(n) > 0""")
def sc4_folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4 to SC6, SC14: documents written as text files of their sources, the first file of each in a manifest, read as a folder and parsed."""
    root = scratch(spark, "folder")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 1000).text(root)
    first: dict[str, str] = {}
    for path in folder.paths(root):  # names of files, not their texts
        first.setdefault(path.partition("/")[0], path)
    put(spark, f"{root}/_sources.yaml", json.dumps({"sources": {p: {"source_id": s, "status": "verified"} for s, p in first.items()}}).encode())
    found = folder.read_folder(spark, root)
    lines = corpus.parse_files(found.select(F.struct("rel_path", "status").alias("source_id"), "suffix", "text"))
    own = lines.select(F.nullif(F.regexp_extract("source_id.rel_path", "^source=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("source"), (F.col("source_id.status") == "verified").alias("v"), F.size("blocks").alias("n"))
    return own.groupBy("source").agg(F.count_if("v").alias("listed"), F.sum("n").alias("n_lines"))
