"""Queries on the canonical corpus: folding, normalisation, deduplication, chunking and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schema
from gleaner.functions import folding, text
from gleaner.operators import corpus
from gleaner.operators.taxonomy import SOFTWARE_RULES
from gleaner.plans.canon import CANON, KEY, canonical
from gleaner.plans.registry import query, scratch, table

ASCII = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]+', '', 'g')"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SS = "strip_accents(replace(lower({0}), 'ß', 'ss'))"


@query(f"SELECT doc_id, {KEY.replace('content', 'text')} AS key, trim(regexp_replace({SS.format('text')}, '[^a-z0-9]+', ' ', 'g')) AS phrase_key, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS question_fold FROM documents")
def tx_fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1, TX8, TX10, TX16."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", folding.ascii_key(c).alias("key"), folding.phrase_key(c).alias("phrase_key"), folding.question_fold(c).alias("question_fold"))


@query(f"""
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all({SS.format('text')}, '[a-z0-9]+'), lambda t: len(t) >= 2 AND NOT list_contains({_list(folding.TITLE_STOP)}, t)))) AS n_lexical,
  len(list_distinct(list_filter(regexp_extract_all({SS.format('text')}, '[a-z0-9]+'), lambda t: len(t) >= 3 AND NOT list_contains({_list(folding.CALIBRATION_STOP)}, t)))) AS n_calibration,
  len(list_distinct(list_filter(regexp_extract_all({SS.format('text')}, '[a-z]+'), lambda t: len(t) >= 4 AND NOT list_contains({_list(folding.LABEL_STOP)}, t)))) AS n_semantic,
  CASE WHEN s = '' THEN 'video' ELSE s END AS slug
FROM (SELECT *, substring(lower(regexp_replace(regexp_replace({ASCII.format('text')}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 64) AS s FROM documents)""")
def tx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX9, TX11, TX13, TX15."""
    c = F.col("text")
    size = lambda f: F.size(f(c)).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", size(folding.title_tokens).alias("n_lexical"), size(folding.calibration_tokens).alias("n_calibration"), size(folding.label_tokens).alias("n_semantic"), folding.slug(c).alias("slug"))


@query("""
SELECT doc_id, substring(sha1(source || '::' || CAST(doc_id AS VARCHAR)), 1, 16) AS stable_id, sha256(trim(replace(lower(text), 'ß', 'ss'))) AS chunk_hash,
  lpad(CAST(n_chars // 60 AS VARCHAR), CAST(greatest(2, len(CAST(n_chars // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS clock,
  greatest(100, least(5000, 1000000 // greatest(n_chars, 1))) AS pixels
FROM documents""")
def f_ids_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F6, F7, TX3."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.stable_id(F.col("source"), F.col("doc_id")).alias("stable_id"), folding.chunk_hash(F.col("text")).alias("chunk_hash"), text.clock(F.col("n_chars")).alias("clock"), text.pixel_budget(F.col("n_chars"), 1_000_000, 100, 5000).cast("bigint").alias("pixels"))


TAXONOMY_SQL = " OR ".join(f"(domain = '{d}' AND topic = '{t}')" for d, ts in corpus.TAXONOMY.items() for t in ts)
SUBTOPIC_SQL = "(" + (" OR ".join(f"(domain = '{d}' AND topic = '{t}' AND subtopic = '{x}')" for d, ts in corpus.TAXONOMY.items() for t, subs in ts.items() for x in subs) or "false") + ")"
CLEAN = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\f\\v]+', ' ', 'g'))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


@query(f"SELECT doc_id, {CLEAN} AS content, len({CLEAN}) AS n FROM documents")
def tx2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = folding.clean_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("content"), F.length(c).cast("bigint").alias("n"))


def _rules_sql(key: str) -> str:
    from unicodedata import normalize

    fold = lambda p: " ".join("".join(c if c.isalnum() else " " for c in normalize("NFKD", p).encode("ascii", "ignore").decode().lower()).split())
    whens = " ".join("WHEN " + " OR ".join(f"contains({key}, '{fold(p)}')" for p in phrases) + f" THEN '{t}/{s or ''}'" for t, s, phrases in SOFTWARE_RULES)
    return f"CASE {whens} END"


@query(f"WITH k AS (SELECT doc_id, {KEY.replace('content', 'text')} AS key FROM documents) SELECT doc_id, {_rules_sql('key')} AS rule FROM k")
def tx27_software_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = corpus.software_rules(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(r.isNotNull(), F.concat(r["topic"], F.lit("/"), F.coalesce(r["subtopic"], F.lit("")))).alias("rule"))


@query()
def pr6_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR6, PR7, TX27, TX28: the whole of one document's normalisation."""
    return corpus.normalize(canonical(spark, sf_dir)).select("id", "doc_id", "title", "topic", "subtopic", "breadcrumb", "content_hash")


# rows of one id repeat, some with another authority
DEDUP = f"""
twice AS (SELECT * FROM canon UNION ALL SELECT * REPLACE ('community' AS authority) FROM canon WHERE doc_id % 3 = 0 UNION ALL SELECT * FROM canon WHERE doc_id % 5 = 0),
h AS (SELECT *, sha256({KEY}) AS content_hash, CASE authority WHEN 'community' THEN 1 WHEN 'verified_internal' THEN 2 ELSE 3 END AS a, CASE status WHEN 'draft' THEN 0 WHEN 'review_required' THEN 1 WHEN 'deprecated' THEN 2 ELSE 3 END AS s FROM twice),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a DESC, s DESC, source_type DESC) AS first FROM h) WHERE first = 1),
r AS (SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS kept_id FROM u WINDOW w AS (PARTITION BY domain, content_hash ORDER BY a DESC, s DESC, source_type DESC, id DESC))
"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = canonical(spark, sf_dir)
    c = c.unionByName(c.where("doc_id % 3 = 0").withColumn("authority", F.lit("community"))).unionByName(c.where("doc_id % 5 = 0"))
    return c.withColumn("content_hash", corpus.content_hash(F.col("content")))


@query(f"WITH {CANON}, {DEDUP} SELECT id, doc_id, domain, authority, status, content_hash FROM r WHERE rn = 1")
def ag1_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG2: rows of one id first, then of one domain and content."""
    return corpus.deduplicate(_hashed(spark, sf_dir))[0].select("id", "doc_id", "domain", "authority", "status", "content_hash")


@query(f"WITH {CANON}, {DEDUP} SELECT id AS dropped_id, kept_id, content_hash FROM r WHERE rn > 1")
def ag1_dedup_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.deduplicate(_hashed(spark, sf_dir))[1]


@query(f"WITH {CANON}, x AS (SELECT *, CASE WHEN n_chars % 7 = 0 THEN content || ' x' ELSE content END AS c FROM canon) SELECT source_id AS id FROM x GROUP BY source_id HAVING count(DISTINCT sha256({KEY.replace('content', 'c')})) > 1")
def ag1_id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: ids with two contents, a source taken for an id."""
    c = canonical(spark, sf_dir).withColumn("content", F.when(F.col("n_chars") % 7 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
    return corpus.id_conflicts(c.select(F.col("source_id").alias("id"), corpus.content_hash(F.col("content")).alias("content_hash")))


@query(f"""
WITH {CANON}, x AS (SELECT unnest([{{'dimension': 'domain', 'key': domain}}, {{'dimension': 'source_type', 'key': source_type}}, {{'dimension': 'status', 'key': status}},
  {{'dimension': 'authority', 'key': authority}}, {{'dimension': 'topic', 'key': domain || '/' || topic}}]) AS x FROM canon)
SELECT x.dimension AS dimension, x.key AS key, count(*) AS n FROM x GROUP BY ALL""")
def ag3_counts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.counts_report(canonical(spark, sf_dir))


@query(f"WITH {CANON}, a AS (SELECT id, source_type, CASE WHEN status = 'deprecated' THEN 'community' ELSE authority END AS authority FROM canon) SELECT * FROM a WHERE source_type IN ('official_doc', 'video') AND authority <> 'official' OR source_type = 'internal_sop' AND authority <> 'verified_internal'")
def fi7_authority_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI7, with deprecated documents marked as the community's."""
    c = canonical(spark, sf_dir)
    return corpus.authority_errors(c.withColumn("authority", F.when(F.col("status") == "deprecated", "community").otherwise(F.col("authority"))))


_HAVE = {"id", "content", "title", "domain", "topic", "source_type", "source_id", "authority", "status", "language"}
_BLANK = lambda c: f"coalesce(CAST({c} AS VARCHAR), '') = ''" if c in _HAVE else "true"
_NEEDED = [(c, "true") for c in corpus.BASE_FIELDS] + [(c, "domain = 'software'") for c in corpus.SOFTWARE_FIELDS] + [(c, "domain <> 'software'") for c in corpus.HOTEL_FIELDS] + [(c, "source_type = 'video'") for c in corpus.VIDEO_FIELDS]


@query(f"WITH {CANON} SELECT * FROM (SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN {t} AND {_BLANK(c)} THEN '{c}' END" for c, t in _NEEDED)}], lambda x: x IS NOT NULL), ',') AS missing FROM canon) WHERE missing <> ''")
def fi8_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI8, FI11: the thirteen base fields, and those of the domain and of videos."""
    return corpus.missing_metadata(canonical(spark, sf_dir))


@query(f"""
WITH {CANON}, t AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN content || chr(65533) ELSE content END AS c FROM canon)
SELECT * FROM (SELECT id, CASE WHEN trim(c, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN contains(c, chr(65533)) THEN 'replacement_character'
  WHEN domain = 'hotel' AND topic NOT IN ({', '.join(f"'{t}'" for t in corpus.TAXONOMY['hotel'])}) AND coalesce(subtopic, '') NOT IN ({', '.join(f"'{t}'" for t in corpus.HOTEL_SUBTOPICS)}) THEN 'taxonomy' END AS error FROM t) WHERE error IS NOT NULL""")
def pr6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR6, TX28: documents that can't be normalised; some are emptied or damaged here."""
    c = canonical(spark, sf_dir)
    c = c.withColumn("content", F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("\ufffd"))).otherwise(F.col("content")))
    return corpus.normalization_errors(c)


@query(f"WITH {CANON} SELECT id, CASE WHEN domain = 'software' AND source_type = 'video' THEN topic WHEN source_type = 'qa' AND subtopic IS NOT NULL THEN subtopic ELSE concat_ws('/', topic, subtopic) END AS source_category FROM canon")
def pr8_source_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = canonical(spark, sf_dir).withColumn("source_category", F.lit(None).cast("string"))
    return c.select("id", corpus.source_category(c).alias("source_category"))


@query("SELECT page_id, regexp_replace(replace(url, 'http://', CASE WHEN page_id % 2 = 0 THEN '/srv/data/' ELSE 'http://' END), '^/srv/data/', '') AS path FROM pages")
def pr9_portable_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR9: addresses as paths, every other one below a root."""
    under = F.when(F.col("page_id") % 2 == 0, "/srv/data/").otherwise("http://")
    return table(spark, sf_dir, "pages").select("page_id", text.portable_path(F.replace("url", F.lit("http://"), under), "/srv/data").alias("path"))


@query(f"""
WITH {CANON}, {DEDUP}, o AS (SELECT * FROM r WHERE rn = 1)
SELECT (SELECT count(*) FROM twice) AS inputs, (SELECT count_if(content <> {CLEAN.replace('text', 'content')})::BIGINT FROM twice) AS texts_changed, count(*) AS outputs, count_if(content = '')::BIGINT AS empty_content,
  count_if(NOT (({TAXONOMY_SQL}) AND (subtopic IS NULL OR {SUBTOPIC_SQL})))::BIGINT AS taxonomy_errors, (SELECT count(*) FROM r WHERE rn > 1) AS duplicates_removed, count(*) AS missing_metadata,
  count_if(source_type IN ('official_doc', 'video') AND authority <> 'official' OR source_type = 'internal_sop' AND authority <> 'verified_internal')::BIGINT AS authority_errors, false AS ready_for_chunking FROM o""")
def ag3_normalization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3: every document lacks some field here."""
    h = _hashed(spark, sf_dir)
    kept, trace = corpus.deduplicate(h)
    return corpus.normalization_report(h.drop("content_hash"), kept, trace)


@query(f"WITH {CANON} SELECT source_id AS id, count(*) AS n FROM canon GROUP BY source_id HAVING count(*) > 1")
def ag4_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_ids(canonical(spark, sf_dir).select(F.col("source_id").alias("id")))


@query(f"""
SELECT page_id, CASE WHEN s = '' THEN 'video' ELSE s END || '-' || substring(sha1(url), 1, 10) AS video_id,
  'https://portal.example.org/faq?' || url AS portal,
  split_part(replace(url, 'http://', ''), '/', 1) AS category
FROM (SELECT *, substring(lower(regexp_replace(regexp_replace({ASCII.format("regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '')")}, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 64) AS s FROM pages)""")
def f3_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, TX15, TX33: names made of the addresses of pages."""
    from gleaner.operators.steps import path_category

    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.video_id(u).alias("video_id"), text.portal_url(F.lit("https://portal.example.org/faq"), u).alias("portal"), path_category(F.replace(u, F.lit("http://"), F.lit(""))).alias("category"))


@query("SELECT event_id, CASE WHEN date_trunc('day', t) = t THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS iso FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE ts END AS t FROM events)")
def f5_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.iso_date(F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))).alias("iso"))


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{text.URL_NAMESPACE}') || encode({name}))"
    return f"(SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) FROM (SELECT {h} AS h))"


@query(f"SELECT page_id, {_uuid_sql('url')} AS uuid FROM pages")
def f2_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.uuid5(F.col("url")).alias("uuid"))


_DIRECTIONS = ("à gauche", "À droite", "en haut", "bas", "")
_WORDS = "[" + ", ".join(f"'{x}'" for x in _DIRECTIONS) + "]"


@query(f"""
WITH d AS (SELECT doc_id, text || ' ' || ({_WORDS})[doc_id % 5 + 1] AS a, split_part(text, chr(10), 1) || ' ' || ({_WORDS})[doc_id % 3 + 1] AS b FROM documents),
w AS (SELECT doc_id, a, regexp_extract_all({SS.format('a')}, '[a-z]+') AS x, regexp_extract_all({SS.format('b')}, '[a-z]+') AS y FROM d),
n AS (SELECT doc_id, a, list_sort(list_distinct(list_filter(list_transform(x, lambda t: {{DIRECTION}}), lambda t: t IS NOT NULL))) AS p, list_distinct(list_filter(list_transform(list_concat(x, y), lambda t: {{DIRECTION}}), lambda t: t IS NOT NULL)) AS q FROM w)
SELECT doc_id, array_to_string(p, ',') AS directions, list_contains(q, 'left') AND list_contains(q, 'right') OR list_contains(q, 'top') AND list_contains(q, 'bottom') AS opposing, lower(regexp_replace({ASCII.format('a')}, '\\s+', ' ', 'g')) AS key FROM n""".replace("{DIRECTION}", "CASE WHEN t IN ('gauche', 'left') THEN 'left' WHEN t IN ('droite', 'right') THEN 'right' WHEN t IN ('haut', 'top', 'superieur', 'superieure') THEN 'top' WHEN t IN ('bas', 'bottom', 'inferieur', 'inferieure') THEN 'bottom' WHEN t IN ('centre', 'milieu', 'center') THEN 'center' END"))
def tx14_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX12, TX14, TX24: texts with a direction added."""
    from gleaner.operators.review import opposing

    pick = lambda n: F.element_at(F.array(*map(F.lit, _DIRECTIONS)), (F.col("doc_id") % n + 1).cast("int"))
    a, b = F.concat("text", F.lit(" "), pick(5)), F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" "), pick(3))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(folding.spatial_terms(a), ",").alias("directions"), opposing(a, b).alias("opposing"), folding.keyframe_key(a).alias("key"))


@query(f"WITH {CANON} SELECT id, 'enum:language' AS violation FROM canon WHERE language NOT IN ('fr', 'en') UNION ALL SELECT id, 'content:empty' FROM canon WHERE content = ''")
def fi4_document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI4, D1: the constraints of the canonical schema."""
    return schema.violations(schema.conform(canonical(spark, sf_dir)))


TAX = " OR ".join(f"(domain = 'software' AND topic = '{t}')" for t in ("general", "reservations", "payments", "billing")) + " OR " + " OR ".join(f"(domain = 'hotel' AND topic = '{t}')" for t in ("guest_journey", "reservations", "payments"))


@query(f"WITH {CANON} SELECT domain, topic, count(*) AS n, CAST(sum(CASE WHEN {TAX} THEN 0 ELSE 1 END) AS BIGINT) AS unknown FROM canon GROUP BY domain, topic")
def jo4_taxonomy_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI9, JO4."""
    c = canonical(spark, sf_dir)
    return c.groupBy("domain", "topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(~corpus.in_taxonomy(F.col("domain"), F.col("topic"))).alias("unknown"))


# chunks as recursive walks: over the sentences of long paragraphs, then over the fragments of a document
CHUNKS = f"""{CANON},
limited AS (SELECT *, CASE source_type WHEN 'official_doc' THEN 2400 WHEN 'internal_sop' THEN 3200 END AS most FROM canon),
para AS (SELECT id, most, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM (
  SELECT id, most, list_filter(list_transform(string_split(regexp_replace(content, '\\n\\s*\\n', chr(2), 'g'), chr(2)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM limited WHERE len(content) > most)),
sent AS (SELECT id, most, k, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (
  SELECT id, most, k, CASE WHEN len(p) <= most THEN [p] ELSE list_filter(string_split(regexp_replace(trim(p), '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') END AS s FROM para)),
w1 AS (
  SELECT id, most, k, i, s, 1 AS part, CAST(len(s) AS BIGINT) AS size FROM sent WHERE i = 1
  UNION ALL
  SELECT n.id, n.most, n.k, n.i, n.s, CASE WHEN size + 1 + len(n.s) > n.most THEN part + 1 ELSE part END, CASE WHEN size + 1 + len(n.s) > n.most THEN len(n.s) ELSE size + 1 + len(n.s) END
  FROM w1 JOIN sent n ON n.id = w1.id AND n.k = w1.k AND n.i = w1.i + 1),
frag AS (SELECT id, most, f, row_number() OVER (PARTITION BY id ORDER BY k, part) AS j FROM (SELECT id, most, k, part, string_agg(s, ' ' ORDER BY i) AS f FROM w1 GROUP BY ALL)),
w2 AS (
  SELECT id, most, j, f, 1 AS part, CAST(len(f) AS BIGINT) AS size FROM frag WHERE j = 1
  UNION ALL
  SELECT n.id, n.most, n.j, n.f, CASE WHEN size + 2 + len(n.f) > n.most THEN part + 1 ELSE part END, CASE WHEN size + 2 + len(n.f) > n.most THEN len(n.f) ELSE size + 2 + len(n.f) END
  FROM w2 JOIN frag n ON n.id = w2.id AND n.j = w2.j + 1),
parts AS (SELECT id, part, string_agg(f, chr(10) || chr(10) ORDER BY j) AS text, count(*) OVER (PARTITION BY id) AS parts FROM w2 GROUP BY id, part),
chunks AS (
  SELECT CASE WHEN parts > 1 THEN substring(sha1(source_id || '::' || c.id || ':chunk:' || part), 1, 16) ELSE c.id END AS id, c.id AS parent_document_id, source_type, CAST(coalesce(part, 1) AS INTEGER) AS chunk_index,
    CAST(coalesce(parts, 1) AS INTEGER) AS chunk_count, coalesce(p.text, content) AS content FROM limited c LEFT JOIN parts p ON p.id = c.id)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT id, parent_document_id, chunk_index, chunk_count, CAST(len(content) AS INTEGER) AS n_chars, sha256(regexp_replace(replace(lower(content), 'ß', 'ss'), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM chunks")
def ch3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH2 to CH5."""
    return corpus.chunk(canonical(spark, sf_dir)).select("id", "parent_document_id", "chunk_index", "chunk_count", F.length("content").alias("n_chars"), "content_hash")


@query(f"""WITH RECURSIVE {CHUNKS}, c AS (
  SELECT source_type, count(*) AS chunks, count(DISTINCT CASE WHEN chunk_count > 1 THEN parent_document_id END) AS split_documents, count_if(len(content) > CASE source_type WHEN 'official_doc' THEN 2400 WHEN 'internal_sop' THEN 3200 ELSE 1 << 30 END)::BIGINT AS long_chunks,
    count_if(source_type = 'qa' AND NOT (chunk_count = 1 AND contains(content, 'Question :') AND contains(content, 'Reponse :')))::BIGINT AS broken_qa FROM chunks GROUP BY source_type)
SELECT source_type, d.documents, c.chunks, c.split_documents, c.long_chunks, c.broken_qa, c.chunks < d.documents AS lost FROM (SELECT source_type, count(*) AS documents FROM canon GROUP BY source_type) d JOIN c USING (source_type)""")
def ag4_chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, FI12."""
    c = canonical(spark, sf_dir)
    return corpus.chunk_report(c, corpus.chunk(c))


# a recursive walk over the sentences, one by one, as the packing is defined
@query(f"""
WITH RECURSIVE {CANON},
big AS (SELECT id, list_filter(string_split(regexp_replace(trim(content), '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM canon WHERE source_type = 'official_doc' AND len(content) > 2400 AND NOT regexp_matches(content, '\\n\\s*\\n')),
walk AS (
  SELECT id, s, 1 AS i, 1 AS part, CAST(len(s[1]) AS BIGINT) AS size FROM big WHERE len(s) > 0
  UNION ALL
  SELECT id, s, i + 1, CASE WHEN size + 1 + len(s[i + 1]) > 2400 THEN part + 1 ELSE part END, CASE WHEN size + 1 + len(s[i + 1]) > 2400 THEN len(s[i + 1]) ELSE size + 1 + len(s[i + 1]) END
  FROM walk WHERE i < len(s))
SELECT id, CAST(part AS INTEGER) AS part, max(size) AS size FROM walk GROUP BY id, part""")
def ch2_sentence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH2: official documents without blank lines that exceed the limit, packed by sentences."""
    c = canonical(spark, sf_dir).where((F.col("source_type") == "official_doc") & (F.length("content") > 2400) & ~F.col("content").rlike(r"\n\s*\n"))
    return c.select("id", F.posexplode_outer(corpus.sentences(F.col("content"), 2400)).alias("i", "p")).where("p IS NOT NULL").select("id", (F.col("i") + 1).cast("int").alias("part"), F.length("p").cast("bigint").alias("size"))


@query(f"""
WITH {CANON}, r AS (SELECT source_type, n_chars, row_number() OVER (PARTITION BY source_type ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY source_type) AS n FROM canon)
SELECT source_type, min(CASE WHEN rn = 1 THEN n_chars END) AS p0, min(CASE WHEN rn = CAST(floor((n - 1) * 0.5) AS BIGINT) + 1 THEN n_chars END) AS p50,
  min(CASE WHEN rn = CAST(floor((n - 1) * 0.9) AS BIGINT) + 1 THEN n_chars END) AS p90, min(CASE WHEN rn = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1 THEN n_chars END) AS p95, max(n_chars) AS p100
FROM r GROUP BY source_type""")
def ag5_size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, AG5: exact order statistics of sizes by type."""
    return corpus.nearest_rank(canonical(spark, sf_dir), "n_chars", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}, ("source_type",))


@query(f"WITH {CANON} SELECT source_type, count(*) AS documents, count(DISTINCT source_id) AS sources, CAST(count_if(status = 'verified') AS BIGINT) AS verified, CAST(count_if(len(content) > 2400) AS BIGINT) AS long FROM canon GROUP BY source_type")
def ag18_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6, AG17, AG18."""
    return canonical(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.length("content") > 2400).alias("long"))


CLOCK_SQL = "lpad(CAST(n_chars // 60 AS VARCHAR), CAST(greatest(2, len(CAST(n_chars // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0')"


@query(f"""
WITH {CANON}, c AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN topic || ' > ' || source_id END AS trail, CASE WHEN title <> '' THEN title ELSE source_id END AS name FROM canon)
SELECT id, concat_ws(chr(10) || chr(10), coalesce(trail, nullif(title, '')), content) AS embed,
  CASE WHEN source_type = 'video' THEN 'Tutoriel pms - ' || name || ' (' || {CLOCK_SQL} || ')' WHEN source_type = 'internal_sop' THEN 'Procedure interne - ' || name
  ELSE trim('Documentation pms - ' || name || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' (p. ' || n_chars || ')' ELSE ' (p. ' || n_chars || '-' || (n_chars + 2) || ')' END) END AS citation FROM c""")
def pr1_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR1, PR2: the trail before the title; videos with a time, documents with no page, one or several."""
    from gleaner.operators.answers import citation

    n = F.col("n_chars").cast("int")
    c = canonical(spark, sf_dir).withColumns({
        "breadcrumb": F.when(F.col("doc_id") % 2 == 0, F.concat("topic", F.lit(" > "), "source_id")), "software": F.lit("pms"), "timestamp_start": F.col("n_chars").cast("double"),
        "page_start": F.when(F.col("doc_id") % 3 != 0, n), "page_end": F.when(F.col("doc_id") % 3 == 2, n + 2),
    })
    return c.select("id", F.concat_ws("\n\n", F.coalesce("breadcrumb", F.nullif(F.col("title"), F.lit(""))), "content").alias("embed"), citation(F.struct(*c.columns)).alias("citation"))


@query(f"WITH {CANON} SELECT status, count(*) AS n FROM canon GROUP BY status UNION ALL SELECT 'total', count(*) FROM canon")
def ag17_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17, AG20: the total and the counts by status."""
    return canonical(spark, sf_dir).rollup("status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


@query(f"WITH {CANON}, v AS (SELECT * FROM canon WHERE status = 'verified') SELECT id, 'insert' AS change FROM v WHERE n_chars % 3 = 0 UNION ALL SELECT id, 'keep' FROM v WHERE n_chars % 3 <> 0 UNION ALL SELECT id, 'delete' FROM canon WHERE status <> 'verified' AND n_chars % 3 <> 0")
def sk6_index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, SK6, SO2, FI1: verified documents against an index that holds some documents of any status."""
    from gleaner.operators.index import sync_plan

    c = canonical(spark, sf_dir)
    return sync_plan(c.where(F.col("n_chars") % 3 != 0).select("id"), c.where("status = 'verified'").select("id"))


@query(f"""
WITH {CANON},
old AS (SELECT id, sha256(CASE WHEN n_chars % 5 = 0 THEN 'former ' || coalesce(content, '') ELSE content END) AS h FROM canon WHERE n_chars % 3 <> 0 AND status IN ('verified', 'review_required')),
new AS (SELECT id, sha256(content) AS h FROM canon WHERE status = 'verified')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' WHEN o.h IS DISTINCT FROM n.h THEN 'update' ELSE 'keep' END AS change, n.h AS content_sha256
FROM old o FULL JOIN new n ON o.id = n.id""")
def sk5_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, SK6: an index that is loaded twice, first with some documents, of which some had another text or were verified then; each key's change and what the index holds."""
    from gleaner.operators.index import changes, row_hash
    from gleaner.sources.snapshot import Index

    c = canonical(spark, sf_dir)
    former = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("former "), F.coalesce("content", F.lit("")))).otherwise(F.col("content"))
    first = c.where((F.col("n_chars") % 3 != 0) & F.col("status").isin("verified", "review_required")).withColumns({"content": former, "status": F.lit("verified")})
    index = Index(spark, scratch(spark, "index"))
    index.load(first, F.col("status") == "verified")
    stored = index.read()
    plan = changes(stored.select("id", row_hash(stored.columns).alias("content_hash")), c.withColumn("content_hash", row_hash(c.columns)), "id", F.col("status") == "verified")
    index.load(c, F.col("status") == "verified")
    held = index.read().select("id", F.sha2("content", 256).alias("content_sha256"))
    return plan.join(held, "id", "left").select("id", "change", "content_sha256")
