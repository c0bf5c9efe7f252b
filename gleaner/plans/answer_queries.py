"""Queries of planning and answering; conversations give the questions, documents the recorded texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import answers, planner
from gleaner.operators import vocabulary as v
from gleaner.plans.canon import CANON, canonical
from gleaner.plans.registry import query, table


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations")
def wi6_last_user_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.last_user_question(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "previous")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 4")
def wi7_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.recent(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", "text")


#: Questions put together from the vocabulary, so that every rule of the planner is met.
PHRASES = (
    "Comment ajouter un extra dans le logiciel ?", "Est-ce qu'un client peut payer par carte bleue ?", "Et ensuite, comment le faire ?", "Un passant agressif est à la réception",
    "Quel bouton pour le check-in ?", "Avons-nous le droit de facturer la caution ?", "Combien coûte la chambre et comment la réserver ?", "Le bruit dans la chambre voisine",
    "Quelle est la différence entre un acompte et une caution ?", "La clim de la chambre est en panne", "Envoyer un lien de paiement au client", "Chèques vacances acceptés ?", "",
)
_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"


def _terms(terms: tuple[str, ...]) -> str:
    # one class for both ends, as RE2 looks neither ahead nor behind
    return "regexp_matches(f, '(^|[^\\p{L}\\p{N}_])(" + "|".join(t[:-1] if t.endswith("*") else t + "($|[^\\p{L}\\p{N}_])" for t in terms) + ")')"


def _word(p: str) -> str:
    return f"regexp_matches(f, '(^|[^\\p{{L}}\\p{{N}}_])({p})($|[^\\p{{L}}\\p{{N}}_])')"


_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
PLAN = f"""
WITH p AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations),
q AS (SELECT conv_id, turn, previous, trim(regexp_replace(({_LIST})[(conv_id + turn) % {len(PHRASES)} + 1] || ' ' || text, '\\s+', ' ', 'g')) AS original FROM p WHERE role = 'user'),
h AS (SELECT *, coalesce(previous <> '', false) AND {_word(v.REFERENCES.replace('(?:', '(')).replace('matches(f,', f'matches({_FOLD.format("original")},')} AS used_history FROM q),
s AS (SELECT *, CASE WHEN used_history THEN 'Demande précédente : ' || previous || chr(10) || 'Demande actuelle : ' || original ELSE original END AS standalone FROM h),
f AS (SELECT *, {_FOLD.format('standalone')} AS f FROM s),
b AS (SELECT *, {_terms(v.SOFTWARE_TERMS)} AS sw, {_terms(v.HOTEL_TERMS)} AS ho, {_terms(v.POLICY_TERMS)} AS po, {_word(v.BOTH_STEPS)} AS st, {_terms(v.SENSITIVE_TERMS)} AS sensitive, {_terms(v.SUPPORT_TERMS)} AS sup,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {_word(p)} THEN '" + x.replace("'", "''") + "' END" for p, x in v.ALIASES)}], lambda x: x IS NOT NULL), '; ') AS aliases,
  {_word('comment')} AND NOT {_word(v.DIFFERENCE)} OR regexp_matches(f, '{"|".join(v.PROCEDURE_TERMS)}') AS proc,
  {_word(v.OUTSIDER)} AND NOT {_word(v.NOISE)} AS outsider FROM f),
r AS (SELECT *, CASE WHEN po AND st THEN 'both' WHEN sw AND ho AND (po OR used_history OR st) THEN 'both' WHEN sw AND po THEN 'both' WHEN sw THEN 'software' WHEN ho OR po THEN 'hotel' ELSE 'both' END AS route FROM b)
SELECT conv_id, turn, used_history, route, nullif(route, 'both') AS domain_filter, sensitive, sensitive AND sup AS explicit_support_required, aliases,
  route IN ('software', 'both') AND proc AS procedural_detail, CASE WHEN route IN ('software', 'both') AND proc THEN 5 END AS max_chunks_per_source, CASE WHEN outsider THEN 'noise' ELSE '' END AS excluded
FROM r
"""


@query(PLAN)
def qp1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QP1 to QP8, TX25: user turns, each after a phrase that some rule of the planner names."""
    turns = planner.last_user_question(table(spark, sf_dir, "conversations")).where("role = 'user'")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    p = planner.plan(turns.withColumn("question", F.concat(phrase, F.lit(" "), F.col("text"))))
    return p.select(
        "conv_id", "turn", "used_history", "route", "domain_filter", "sensitive", "explicit_support_required", F.array_join("aliases", "; ").alias("aliases"),
        "procedural_detail", "max_chunks_per_source", F.array_join("excluded_subtopics", ",").alias("excluded"),
    )


_ABSTAINS = "'" + answers.ABSTENTION.replace("'", "''") + "'"
RECORDED = f"SELECT doc_id, doc_id % 4 AS n_hits, CASE doc_id % 5 WHEN 0 THEN 'Réponse : ' || text || ' [1]' WHEN 1 THEN '1. ' || text || ' [2]' || chr(10) || '2. ' || text WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'Je ne trouve pas.' ELSE 'Bonjour. ' || {_ABSTAINS} END WHEN 3 THEN text ELSE text || ' [3] [1].' END AS answer FROM documents"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as recorded answers, with citations and abstentions."""
    t, k = F.col("text"), F.col("doc_id") % 5
    a = (
        F.when(k == 0, F.concat(F.lit("Réponse : "), t, F.lit(" [1]"))).when(k == 1, F.concat(F.lit("1. "), t, F.lit(" [2]\n2. "), t)).when(k == 2, F.when(F.col("doc_id") % 3 == 0, "Je ne trouve pas.").otherwise(F.lit(f"Bonjour. {answers.ABSTENTION}")))
        .when(k == 3, t).otherwise(F.concat(t, F.lit(" [3] [1].")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("n_hits"), a.alias("answer"))


@query(f"""
WITH a AS ({RECORDED}),
c AS (SELECT *, regexp_replace(ltrim(answer), '^(?i)(answer|réponse|reponse)\\s*:\\s*', '') AS raw FROM a),
t AS (SELECT *, CASE WHEN n_hits = 1 AND NOT contains(raw, {_ABSTAINS}) THEN CASE WHEN regexp_matches(one, '\\[1\\]\\s*[.!?]?\\s*$') THEN one ELSE rtrim(one) || ' [1]' END ELSE raw END AS text FROM (SELECT *, regexp_replace(raw, '\\[\\d+\\]', '[1]', 'g') AS one FROM c)),
n AS (SELECT *, list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: coalesce(TRY_CAST(x AS INTEGER), -1)) AS cs, contains(text, {_ABSTAINS}) AS abst,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*\\d+[.)]\\s+\\S') AND NOT regexp_matches(l, '\\[\\d+\\]'))) > 0 AS bare FROM t)
SELECT doc_id, text, bare AS steps_without_source, array_to_string(list_sort(list_distinct(cs)), ',') AS cited,
  CASE WHEN n_hits = 0 THEN 'no_hits' WHEN abst THEN 'abstain' WHEN NOT (len(cs) > 0 AND len(list_filter(cs, lambda i: i < 1 OR i > n_hits)) = 0 AND NOT bare) THEN 'invalid_citation' ELSE 'supported' END AS decision
FROM n""")
def qp12_answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QP12, FI23, FI24, TX22, TX23, TX38 to TX40."""
    return answers.gate(_recorded(spark, sf_dir)).select("doc_id", "text", "steps_without_source", F.concat_ws(",", F.transform("cited", lambda i: i.cast("string"))).alias("cited"), "decision")


@query("SELECT event_id, regexp_extract(p, '(?s)\\{.*\\}', 0) AS object FROM (SELECT event_id, 'output: ' || props || ' end' AS p FROM events)")
def tx35_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.json_object(F.concat(F.lit("output: "), F.col("props"), F.lit(" end"))).alias("object"))


@query("""
WITH q AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS minutes FROM events)
SELECT event_id, CAST(minutes AS INTEGER) AS minutes, CAST(CASE WHEN minutes > 660 AND minutes <= 780 THEN ceil((minutes - 660) / 60.0) * 15 WHEN minutes > 780 AND minutes <= 1020 THEN 30 + ceil((minutes - 780) / 60.0) * 20 END AS BIGINT) AS fee FROM q""")
def f8_late_checkout_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: questions about leaving at the time of an event."""
    e = table(spark, sf_dir, "events")
    q = F.format_string("Un départ à %dh%02d est-il possible ?", F.hour("ts"), F.minute("ts"))
    return answers.fee(e.select("event_id", q.alias("question"))).select("event_id", "minutes", "fee")


ASKED = ("Quelle est la différence ?", "Comment traiter un no-show ?", "La clim est en panne, comment changer le client de chambre ?", "Comment facturer ?", "Un petit-déjeuner à 6h30 ?")
_ASKED = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in ASKED) + "]"
HITS = f"""
{CANON}, hits AS (
  SELECT doc_id // 8 AS query_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS rank, doc_id, source_id, source_type, domain, content,
    CASE WHEN doc_id % 3 = 0 THEN 'Le no-show : ' || title WHEN doc_id % 5 = 0 THEN 'Déplacer ' || title ELSE title END AS title,
    ({_ASKED})[(doc_id // 8) % {len(ASKED)} + 1] AS question, (['software', 'both', 'hotel'])[(doc_id // 8) % 3 + 1] AS route, (doc_id // 8) % 4 <> 0 AS procedural FROM canon)
"""


@query(f"""
WITH {HITS},
w AS (SELECT *, first_value(source_id) OVER r AS f, first_value(source_type) OVER r AS ft, arg_min(source_id, rank) FILTER (domain = 'software') OVER g AS s,
  arg_max(source_id, {{'q': (source_type = 'qa')::INTEGER, 'n': len(content), 'r': -rank}}) FILTER (domain = 'software' AND regexp_matches(title || chr(1) || content, '(?i)no[ -]?show')) OVER g AS n,
  arg_max(source_id, {{'n': len(content), 'r': -rank}}) FILTER (domain = 'software' AND regexp_matches(title, '(?i)(^|[^\\p{{L}}])d[ée]plac')) OVER g AS m
  FROM hits WINDOW g AS (PARTITION BY query_id), r AS (PARTITION BY query_id ORDER BY rank)),
c AS (SELECT *, coalesce(CASE WHEN regexp_matches(question, '(?i)clim|changer le client de chambre') THEN m END, CASE WHEN regexp_matches(question, '(?i)no[ -]?show') THEN n END, s) AS chosen FROM w)
SELECT query_id, doc_id, source_id FROM c WHERE CASE WHEN route = 'software' AND (procedural OR question LIKE '%différence%' AND ft = 'qa') THEN source_id = f
  WHEN route = 'both' AND procedural AND s IS NOT NULL THEN domain = 'hotel' OR source_id = chosen ELSE true END""")
def qp9_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.focus(_hits(spark, sf_dir)).select("query_id", "doc_id", "source_id")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents to a question, some with titles that the rules of focus look for."""
    from pyspark.sql import Window

    q = F.floor(F.col("doc_id") / 8)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("query_id") % len(xs) + 1).cast("int"))
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Le no-show : "), "title")).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Déplacer "), "title")).otherwise(F.col("title"))
    c = canonical(spark, sf_dir).withColumns({"query_id": q, "title": title})
    return c.withColumns({"rank": F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")), "question": pick(ASKED), "route": pick(("software", "both", "hotel")), "procedural": F.col("query_id") % 4 != 0})


CONTEXTS = "SELECT query_id, string_agg('[' || rank || '] ' || title || chr(10) || CASE WHEN topic <> 'general' THEN topic || chr(10) ELSE '' END || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN (SELECT doc_id, topic FROM canon) USING (doc_id) GROUP BY query_id"


@query(f"WITH {HITS} {CONTEXTS}")
def pr10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context(_hits(spark, sf_dir).withColumns({"citation": F.col("title"), "breadcrumb": F.when(F.col("topic") != "general", F.col("topic"))}))


_TEXTS = {
    "route": "Route : ", "sensitive": "Sensitive", "explicit": "Explicit", "procedural": "One procedure", "both": "Both sides", "short": "Short", "constraints": "CONSTRAINTS", "excerpts": "EXCERPTS",
    "question": "Question : ", "reminders": "REMINDERS", "nothing": "Nothing found.", "yes": "yes", "no": "no", "guardrail": "Must hold: ", "last": "Keep what is proved.", "draft": "DRAFT", "checks": "CHECKS",
    "fee": "fee of {fee}", "room_move": "hotel [{hotel}], software [{software}]", "no_show": "hotel [{hotel}] and software [{software}]",
}


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question with its context, plan and guardrail."""
    h = _hits(spark, sf_dir).withColumns({"citation": F.col("title"), "breadcrumb": F.when(F.col("topic") != "general", F.col("topic"))})
    per = h.groupBy("query_id").agg(F.first("question").alias("question"), F.first("route").alias("route"), F.first("procedural").alias("procedural"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id", "domain", "content"))), lambda x: F.struct(x["source_id"], x["domain"], x["content"])).alias("hits"))
    x = per.join(answers.context(h), "query_id").withColumns({"sensitive": F.col("query_id") % 2 == 0, "explicit": F.col("query_id") % 5 == 0})
    return x.withColumn("guardrail", answers.guardrails(F.col("question"), F.col("hits"), _TEXTS))


MESSAGES = f"""
{HITS}, cx AS ({CONTEXTS}),
q AS (SELECT query_id, any_value(question) AS question, any_value(route) AS route, any_value(procedural) AS procedural, min(rank) FILTER (domain = 'hotel') AS ho, min(rank) FILTER (domain = 'software') AS so FROM hits GROUP BY query_id),
m AS (SELECT q.*, context, query_id % 2 = 0 AS sensitive, query_id % 5 = 0 AS explicit, CASE WHEN question LIKE '%no-show%' AND ho IS NOT NULL AND so IS NOT NULL THEN 'hotel [' || ho || '] and software [' || so || ']' END AS guardrail FROM q JOIN cx USING (query_id))
"""


@query(f"""
WITH {MESSAGES}
SELECT query_id, guardrail, 'CONSTRAINTS' || chr(10) || '- ' || concat_ws(chr(10) || '- ', 'Route : ' || route, CASE WHEN sensitive THEN 'Sensitive' END, CASE WHEN explicit THEN 'Explicit' END) || chr(10) || chr(10) || 'EXCERPTS' || chr(10) || chr(10) || context ||
  chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question : ' || question || chr(10) || chr(10) || 'REMINDERS' || chr(10) || '- ' || concat_ws(chr(10) || '- ', CASE WHEN procedural THEN 'One procedure' END, CASE WHEN route = 'both' THEN 'Both sides' END, guardrail, CASE WHEN NOT procedural THEN 'Short' END) AS message FROM m""")
def pr11_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR11, F9: the message of each question; the words of it are a parameter."""
    x = _asked(spark, sf_dir)
    plan = {k: F.col(k) for k in ("route", "sensitive", "explicit", "procedural")}
    return x.select("query_id", "guardrail", answers.user_message(F.col("question"), F.col("context"), plan, _TEXTS, F.col("guardrail")).alias("message"))


@query(f"""
WITH {MESSAGES}
SELECT query_id, 'Sensitive' || CASE WHEN sensitive THEN 'yes' ELSE 'no' END || chr(10) || 'Explicit' || CASE WHEN explicit THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || 'EXCERPTS' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  'Question : ' || chr(10) || question || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'DRAFT' || chr(10) || upper(question) || chr(10) || chr(10) || 'CHECKS' || chr(10) || '- ' ||
  concat_ws(chr(10) || '- ', CASE WHEN procedural THEN 'One procedure' END, CASE WHEN route = 'both' THEN 'Both sides' END, 'Must hold: ' || guardrail, 'Keep what is proved.') AS message FROM m""")
def pr12_verification_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _asked(spark, sf_dir)
    plan = {k: F.col(k) for k in ("route", "sensitive", "explicit", "procedural")}
    return x.select("query_id", answers.verification_message(F.col("question"), F.col("context"), F.upper("question"), plan, _TEXTS, F.col("guardrail")).alias("message"))


# a question's hits under other names, so that both conflicts are met
@query(f"""
WITH {HITS}, h AS (SELECT query_id, CASE WHEN query_id % 4 = 1 THEN 'Liste des départs' ELSE question END AS question, CASE WHEN rank = 1 THEN (['hotel-services-001', 'software-faq-118'])[query_id % 2 + 1] ELSE source_id END AS source_id, CASE WHEN rank = 1 AND query_id % 3 = 0 THEN 'La liste des arrivées' ELSE content END AS content FROM hits)
SELECT query_id, CASE WHEN any_value(question) = 'Liste des départs' AND count_if(source_id = 'software-faq-118' AND regexp_matches(content, '(?i)liste des arriv[ée]es')) > 0 THEN 'document_conflict' WHEN any_value(question) LIKE '%6h30%' AND count_if(source_id = 'hotel-services-001') > 0 THEN 'unsupported_time' END AS reason FROM h GROUP BY query_id""")
def fi25_conflict_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI25, QP10: early abstentions."""
    first, q = F.col("rank") == 1, F.col("query_id")
    h = _hits(spark, sf_dir).withColumns({
        "question": F.when(q % 4 == 1, "Liste des départs").otherwise(F.col("question")), "source_id": F.when(first, F.when(q % 2 == 0, "hotel-services-001").otherwise("software-faq-118")).otherwise(F.col("source_id")),
        "content": F.when(first & (q % 3 == 0), "La liste des arrivées").otherwise(F.col("content")),
    })
    per = h.groupBy("query_id").agg(F.first("question").alias("question"), F.collect_list(F.struct("source_id", "content")).alias("hits"))
    return per.select("query_id", answers.conflict_reason(F.col("question"), F.col("hits")).alias("reason"))


# recorded outputs of a verifier: tags, JSON, and such as have no form
_RAW = {
    "first": "CASE doc_id % 6 WHEN 0 THEN '<decision>SUPPORTED</decision><answer>' || line || ' [1]</answer><sources>1, 2</sources>' WHEN 1 THEN '<decision>abstain</decision>' WHEN 2 THEN 'no form: ' || line WHEN 3 THEN '<decision>supported</decision><answer>' || line || '</answer><sources>2</sources>' WHEN 4 THEN '<decision>supported</decision><answer>' || line || ' [9]</answer>' ELSE 'x {\"decision\": \"supported\", \"answer\": \"all fine\", \"sources\": [1, \"2\"]} y' END",
    "review": "CASE WHEN doc_id % 4 = 1 THEN '<decision>supported</decision><answer>' || line || ' [1]</answer>' ELSE 'none' END",
    "retry": "CASE WHEN doc_id % 5 < 3 THEN 'none' ELSE '<decision>abstain</decision>' END",
    "decide": "CASE WHEN doc_id % 3 = 2 THEN '<decision>supported</decision><sources>1</sources>' ELSE 'none' END",
}


@query(f"""
WITH l AS (SELECT doc_id, doc_id % 3 + 1 AS n_hits, replace(split_part(text, chr(10), 1), '"', '') AS line FROM documents),
r AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _RAW.items())}, line || ' [1]' AS draft FROM l),
p AS (SELECT *, doc_id % 6 AS k,
  CASE doc_id % 6 WHEN 0 THEN CASE WHEN n_hits >= 2 THEN 'supported' ELSE 'invalid_format' END WHEN 1 THEN 'abstain' WHEN 2 THEN 'invalid_format' WHEN 3 THEN CASE WHEN n_hits >= 2 AND trim(line) <> '' THEN 'supported' ELSE 'invalid_format' END WHEN 4 THEN 'invalid_format' ELSE CASE WHEN n_hits >= 2 THEN 'supported' ELSE 'invalid_format' END END AS d1,
  CASE WHEN doc_id % 4 = 1 THEN 'supported' ELSE 'invalid_format' END AS d2, CASE WHEN doc_id % 5 < 3 THEN 'invalid_format' ELSE 'abstain' END AS d3, CASE WHEN doc_id % 3 = 2 THEN 'supported_decision_only' ELSE 'invalid_format' END AS d4 FROM r)
SELECT doc_id, CASE WHEN d1 = 'abstain' AND n_hits > 1 AND d2 <> 'invalid_format' THEN d2 WHEN d1 <> 'invalid_format' THEN d1 WHEN d3 <> 'invalid_format' THEN d3 ELSE d4 END AS decision,
  CAST(CASE WHEN d1 = 'abstain' AND n_hits > 1 THEN 2 WHEN d1 <> 'invalid_format' THEN 1 WHEN d3 <> 'invalid_format' THEN 2 ELSE 3 END AS INTEGER) AS calls FROM p""")
def qp11_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QP11, TX36, TX37: a verifier's recorded outputs, in the order in which they would be asked for."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).alias("n_hits"), F.replace(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit('"'), F.lit("")).alias("line"))
    r = d.withColumns({k: F.expr(v.replace('\\"', '"')) for k, v in _RAW.items()}).withColumn("draft", F.concat("line", F.lit(" [1]")))
    return answers.verify(r).select("doc_id", "decision", "calls")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^(generic_software|software)-faq-\\d+$') THEN 'faq-' || regexp_extract(s, '(\\d+)$', 1) WHEN contains(s, 'lexique-hotelier-') THEN substring(s, strpos(s, 'lexique-hotelier-')) ELSE s END AS identity FROM (SELECT conv_id, turn, (['software-faq-', 'generic_software-faq-', 'old/lexique-hotelier-', 'other-'])[turn % 4 + 1] || conv_id AS s FROM conversations)")
def tx34_source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("software-faq-", "generic_software-faq-", "old/lexique-hotelier-", "other-"))), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.source_identity(F.concat(names, "conv_id")).alias("identity"))


@query("SELECT count_if(NOT a AND b)::BIGINT AS improved, count_if(a AND NOT b)::BIGINT AS regressed, count_if(a = b)::BIGINT AS unchanged FROM (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels)")
def jo18_report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO18, AG24, AG26: the two labels as the outcomes of two runs."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return answers.deltas(marks.select("id", F.col("a").alias("passed")), marks.select("id", F.col("b").alias("passed")))


@query("""
WITH g AS (SELECT conv_id, list_distinct(list(role)) AS found FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST((NOT list_contains(found, 'system'))::INTEGER + (NOT (list_contains(found, 'user') OR list_contains(found, 'assistant')))::INTEGER AS INTEGER) AS missing FROM g""")
def jo20_required_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO20, SO4: roles as the sources that an answer found."""
    groups = F.array(F.array(F.lit("system")), F.array(F.lit("user"), F.lit("assistant")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("found"))
    return c.select("conv_id", F.size(answers.missing_groups(groups, F.col("found"))).alias("missing"))


PHRASE = "trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
REGRESSION = f"""
WITH n AS (SELECT doc_id, text, lang, doc_id % 5 AS k, doc_id % 7 AS j, CAST(substring(source, 4, 10) AS INTEGER) AS n, doc_id // 4 AS g FROM documents),
runs AS (SELECT g, list_distinct(list('software-faq-' || n)) AS sources, list_distinct(list(CASE WHEN n % 2 = 0 THEN 'software' ELSE 'hotel' END)) AS domains FROM n GROUP BY g),
c AS (
  SELECT n.*, sources, domains, k <> 0 AS asked, CASE WHEN n % 2 = 0 THEN 'software' ELSE 'hotel' END AS domain,
    {PHRASE.format("coalesce(text, '')")} AS key, {PHRASE.format("split_part(coalesce(text, ''), ' ', 2) || '!'")} AS must, {PHRASE.format("'-' || split_part(coalesce(text, ''), ' ', 3)")} AS never
  FROM n JOIN runs USING (g)),
f AS (
  SELECT *, CASE WHEN asked AND NOT list_contains(sources, 'software-faq-' || (n + j % 2)) THEN 'expected_source' END AS f1,
    CASE WHEN asked AND NOT list_contains(sources, 'software-faq-' || (n + 1)) THEN 'source_groups:software-faq-' || (n + 1) || '+none' END AS f2,
    CASE WHEN asked AND NOT list_contains(domains, 'hotel') THEN 'domains:hotel' END AS f3 FROM c)
SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN lang <> 'en' AND domain = 'software' OR lang = 'en' AND domain <> 'software' THEN 'route:' || CASE WHEN lang = 'en' THEN 'software' ELSE 'hotel' END END, f1, f2, f3], lambda x: x IS NOT NULL), ';') AS retrieval,
  array_to_string(list_filter([CASE WHEN asked AND j = 3 THEN 'abstained' WHEN NOT asked AND j <> 3 THEN 'answered' END, CASE WHEN asked AND j = 2 THEN 'citation' END, f1, f2, f3,
    CASE WHEN asked AND list_contains(sources, 'software-faq-' || (n + 2)) THEN 'forbidden_sources:software-faq-' || (n + 2) END,
    CASE WHEN NOT contains(key, must) OR k = 3 AND NOT contains(key, 'never said') THEN 'phrases_absent:' || array_to_string(list_filter([CASE WHEN NOT contains(key, must) THEN must END, CASE WHEN k = 3 AND NOT contains(key, 'never said') THEN 'never said' END], lambda x: x IS NOT NULL), '|') END,
    CASE WHEN j = 4 AND contains(key, never) THEN 'phrases_forbidden:' || never END], lambda x: x IS NOT NULL), ';') AS answer
FROM f"""


@query(REGRESSION)
def regression_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression checks of recorded runs: documents are answers, the sources of four neighbours are what was found and cited, a source's number decides its domain."""
    from gleaner.operators import evaluation

    n = F.substring("source", 4, 10).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", n.alias("n"), (F.col("doc_id") % 5).alias("k"), (F.col("doc_id") % 7).alias("j"), F.expr("doc_id div 4").alias("g"))
    faq = lambda c: F.concat(F.lit("software-faq-"), c.cast("string"))
    domain = F.when(F.col("n") % 2 == 0, "software").otherwise("hotel")
    runs = d.groupBy("g").agg(F.collect_set(faq(F.col("n"))).alias("sources"), F.collect_set(domain).alias("domains"))
    word = lambda i: F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(i))
    cases = d.select(
        F.col("doc_id").alias("id"), (F.col("k") != 0).alias("answerable"), domain.alias("expected_route"), F.array(F.concat(F.lit("generic_"), faq(F.col("n") + F.col("j") % 2))).alias("expected_sources"),
        F.array(F.array(faq(F.col("n") + 1), F.lit("none")), F.array().cast("array<string>")).alias("required_groups"), F.array(F.lit("hotel")).alias("expected_domains"), F.array(F.concat(F.lit("generic_"), faq(F.col("n") + 2))).alias("forbidden_sources"),
        F.array_compact(F.array(F.concat(word(2), F.lit("!")), F.when(F.col("k") == 3, "NEVER, said"))).alias("required_phrases"), F.when(F.col("j") == 4, F.array(F.concat(F.lit("-"), word(3)))).alias("forbidden_phrases"))
    x = d.join(runs, "g")
    retrieved = x.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "software").otherwise("hotel").alias("route"), "sources", "domains")
    given = x.select(F.col("doc_id").alias("id"), "text", (F.col("j") == 3).alias("abstained"), (F.col("j") != 2).alias("citations_valid"), F.col("sources").alias("cited_sources"), F.col("domains").alias("cited_domains"))
    a = evaluation.retrieval_regressions(cases, retrieved).select("id", F.array_join("failures", ";").alias("retrieval"))
    b = evaluation.answer_regressions(cases, given).select("id", F.array_join("failures", ";").alias("answer"))
    return a.join(b, "id")
