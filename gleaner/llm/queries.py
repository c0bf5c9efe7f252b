"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid, lines, lm, merkle, ordermin, passages, pieces, shards, simhash, spelling, tokens, topk
from gleaner.llm.shared import scratch, table

END_OF_TEXT = 1
ARRIVALS = 16


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_output(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_OF_TEXT)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches by source, are compacted, and are read back by the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch(spark, "shards"), target_bytes=32 << 20)
    store.append(docs, F.pmod(F.xxhash64("source"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    rows = store.read()
    rows = docs.limit(0) if rows is None else rows
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = langid.fold("doc_id", 10)
    held = F.coalesce(f == 0, F.lit(True))
    return lm.score(table(spark, sf_dir, "documents"), held, ~held)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate_lines(table(spark, sf_dir, "documents"), bands=lines.BANDS)
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": merkle.lower_cased()}, where=merkle.every_third())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_decontamination, op3_sharding, op4_simhash, op5_substring_dedup, op6_language_id, op7_lm_scoring, op8_sentencepiece, op9_line_dedup, op10_top_k, op11_order_minhash, op12_merkle_manifest, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op3_sharding": OP3, "op10_top_k": OP10, "op12_merkle_manifest": OP12, "op13_spelling_variants": OP13}


OP2 = r"""
WITH d AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
i AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS key
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM k),
x AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT x.r, x.n, x.s, k.item_id FROM x JOIN k ON x.n = k.n AND x.key = k.key),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, n, s FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  coalesce(its.items_sha256, sha256('')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r
"""

OP10 = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
q AS (SELECT DISTINCT vec_id AS query_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, v.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.query_id AND len(v.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: The table of the crc32 (polynomial 0xEDB88320, reflected) as a list, and the crc32 of the bytes of {text}.
CRC_TABLE = """
steps(b, k, x) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM steps WHERE k = 8)"""
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({text})), lambda p: CAST('0x' || substring(hex(encode({text})), 2 * p + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc.t[CAST(xor(c & 255, b) + 1 AS INTEGER)])), 4294967295)"""

_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
OP12 = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({_FIELDS.format(text="text")}) AS leaf,
    CASE WHEN {CRC.format(text="CAST(doc_id AS VARCHAR)")} % 3 = 0
      THEN sha256({_FIELDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS altered
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS size FROM leaves),
nodes(t, level, i, h, size) AS (
  SELECT t, 0, i, leaf, size FROM placed
  UNION ALL
  SELECT t, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM nodes WHERE size > 1 GROUP BY t, level, i // 8, size),
tops AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS size FROM nodes WHERE size = 1),
uppers(level, i, h, size) AS (
  SELECT 0, i, h, size FROM tops
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (size + 7) // 8 FROM uppers WHERE size > 1 GROUP BY level, i // 8, size),
every AS (SELECT * FROM nodes WHERE size > 1 UNION ALL SELECT 'top', level, i, h, size FROM uppers WHERE size > 1),
sides AS (
  SELECT t, level, i, size,
    coalesce(string_agg(h, '') OVER (PARTITION BY t, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(h, '') OVER (PARTITION BY t, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post
  FROM every),
inner_fold(r, level, i, h, proof) AS (
  SELECT r, 0, i, coalesce(altered, leaf), '' FROM placed
  UNION ALL
  SELECT f.r, f.level + 1, f.i // 8, sha256(s.pre || f.h || s.post), f.proof || s.pre || s.post
  FROM inner_fold f JOIN placed p ON f.r = p.r JOIN sides s ON s.t = p.t AND s.level = f.level AND s.i = f.i),
top_fold(r, level, i, h, proof) AS (
  SELECT p.r, 0, u.i, f.h, f.proof
  FROM placed p JOIN tops u ON p.t = u.t JOIN (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM inner_fold GROUP BY r) f ON f.r = p.r
  UNION ALL
  SELECT f.r, f.level + 1, f.i // 8, sha256(s.pre || f.h || s.post), f.proof || s.pre || s.post
  FROM top_fold f JOIN sides s ON s.t = 'top' AND s.level = f.level AND s.i = f.i),
done AS (SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM top_fold GROUP BY r)
SELECT p.doc_id, p.leaf, u.h AS subroot, x.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = x.h AS verified
FROM placed p JOIN tops u ON p.t = u.t JOIN done d ON p.r = d.r, (SELECT h FROM uppers WHERE size = 1) x
"""

OP13 = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, c, {CRC.format(text="(id || ':' || w)")} AS h FROM runs, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
holes AS (SELECT word, n, left(word, p - 1) AS a, substring(word, p + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
shorter AS (SELECT DISTINCT h.word, h.n, v.word AS other, v.n AS m FROM holes h JOIN v ON v.word = h.a || h.b),
pairs AS (
  SELECT DISTINCT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT word, other, m FROM shorter UNION ALL SELECT other, word, n FROM shorter),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT p.word, min(p.other) AS other, any_value(k.m) AS m FROM pairs p JOIN near k ON p.word = k.word AND p.m = k.m GROUP BY p.word),
forms AS (
  SELECT v.word, v.n, CASE WHEN b.m >= 10 * v.n THEN b.other END AS form, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n, coalesce(k.n_near, 0) AS n_near
  FROM v LEFT JOIN near k ON v.word = k.word LEFT JOIN best b ON v.word = b.word),
ways(word, stop) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.stop = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.stop AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN ways w ON f.word = w.word JOIN forms e ON w.stop = e.word WHERE e.form IS NULL
"""

OP3 = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
