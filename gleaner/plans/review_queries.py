"""Queries of guards, reviews and evaluation sets; order lines are steps, conversation turns give spoken and written texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import calibration_tokens, label_tokens
from gleaner.functions.text import same_prefix, token_f1
from gleaner.operators import evaluation, review, steps
from gleaner.plans.canon import CANON, canonical
from gleaner.plans.registry import query, scratch, table
from gleaner.plans.step_queries import STEPS, _steps
from gleaner.streaming import resumable

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
CAL = "('avec', 'cette', 'dans', 'depuis', 'ensuite', 'etape', 'faire', 'pour', 'sous', 'vous')"
LABEL = "('avec', 'dans', 'pour', 'sous', 'texte', 'bouton', 'champ', 'selectionnes')"
SS = "strip_accents(replace(lower({0}), 'ß', 'ss'))"
ASCII = "lower(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]+', '', 'g'), '\\s+', ' ', 'g'))"
TOKENS = "list_distinct(list_filter(regexp_extract_all(" + SS + ", '[a-z0-9]+'), lambda t: len(t) >= 3 AND t NOT IN " + CAL + "))"
F1 = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect({0}, {1})) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the text of the next one and the one after, as versions of it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return c.withColumns({"b": F.coalesce(F.lead("text").over(w), F.lit("")), "g": F.coalesce(F.lead("text", 2).over(w), F.col("text"))}).select("conv_id", "turn", F.col("text").alias("a"), "b", "g")


TURNS = "turns AS (SELECT conv_id, turn, text AS a, coalesce(lead(text) OVER w, '') AS b, coalesce(lead(text, 2) OVER w, text) AS g FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"""
WITH {TURNS}, t AS (SELECT conv_id, turn, {TOKENS.format('a')} AS x, {TOKENS.format('b')} AS y, list_distinct(list_filter(regexp_extract_all({SS.format('a')}, '[a-z]+'), lambda t: len(t) >= 4 AND t NOT IN {LABEL})) AS p, list_distinct(list_filter(regexp_extract_all({SS.format('b')}, '[a-z]+'), lambda t: len(t) >= 4 AND t NOT IN {LABEL})) AS q FROM turns)
SELECT conv_id, turn, round({F1.format('x', 'y')}, 6) AS f1, len(list_intersect(list_transform(p, lambda t: substring(t, 1, 5)), list_transform(q, lambda t: substring(t, 1, 5)))) > 0 AS alike FROM t""")
def tx19_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX11, TX13, TX18, TX19, SO6: a turn and the next one."""
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.round(token_f1(calibration_tokens(F.col("a")), calibration_tokens(F.col("b"))), 6).alias("f1"), F.coalesce(same_prefix(label_tokens(F.col("a")), label_tokens(F.col("b"))), F.lit(False)).alias("alike"))


FLAGS = (
    "aucune information contradictoire ou manquante", "Conflict between audio and screen", "unsupported_action_target", "unsupported_action_type", "missing exact ui label", "capture d'écran manquante", "capture d'écran floue",
    "libellé incertain", "information incomplète", "autre remarque",
)
FLAG_SQL = (
    "CASE WHEN k = 'aucune information contradictoire ou manquante' THEN 'no_issue' WHEN regexp_matches(k, 'conflict|contradic|discrepancy') THEN 'audio_visual_conflict' WHEN contains(k, 'unsupported action target') THEN 'unsupported_action_target' "
    "WHEN contains(k, 'unsupported action type') THEN 'unsupported_action_type' WHEN contains(k, 'missing exact ui label') THEN 'missing_ui_label' WHEN contains(k, 'capture') AND contains(k, 'manquant') THEN 'missing_visual_evidence' "
    "WHEN contains(k, 'incertain') THEN 'visual_uncertainty' WHEN regexp_matches(k, 'manquant|incomplet|missing') THEN 'missing_information' ELSE 'other_quality_warning' END"
)
RECORDS = f"""
{STEPS}, rec AS (
  SELECT st.video_id, st.step_number, timestamp_start, timestamp_start + quantity AS timestamp_end, ({_list(FLAGS)})[CAST(st.video_id % 7 + st.step_number AS INTEGER) % {len(FLAGS)} + 1] AS flag1, ({_list(FLAGS)})[CAST(quantity AS INTEGER) % {len(FLAGS)} + 1] AS flag2, quantity,
    (['click', 'none', 'type', 'open'])[CAST(quantity AS INTEGER) % 4 + 1] AS action_type, CASE WHEN linestatus = 'O' THEN 'target ' || quantity END AS action_target, CASE WHEN quantity > 45 THEN '' ELSE 'do ' || st.video_id END AS instruction,
    'f' || CAST(quantity AS INTEGER) AS frame, CASE WHEN st.flag = 'N' THEN 'verified' ELSE 'review_required' END AS status, discount > 0.05 AS confident, timestamp_start + 40 AS duration FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY video_id, step_number ORDER BY quantity DESC, discount DESC, tax DESC, timestamp_start DESC) = 1) AS st)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, w = F.col("quantity").cast("int"), Window.partitionBy("video_id", "step_number").orderBy(*[F.desc(c) for c in ("quantity", "discount", "tax", "timestamp_start")])
    return _steps(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n = 1").select(
        "video_id", "step_number", "timestamp_start", (F.col("timestamp_start") + F.col("quantity")).alias("timestamp_end"), F.array(pick(FLAGS, (F.col("video_id") % 7 + F.col("step_number")).cast("int")), pick(FLAGS, q)).alias("quality_flags"),
        pick(("click", "none", "type", "open"), q).alias("action_type"), F.when(F.col("linestatus") == "O", F.concat(F.lit("target "), "quantity")).alias("action_target"),
        F.when(F.col("quantity") > 45, "").otherwise(F.concat(F.lit("do "), "video_id")).alias("instruction"), F.array(F.concat(F.lit("f"), q)).alias("frames"), F.when(F.col("flag") == "N", "verified").otherwise("review_required").alias("status"),
        (F.col("discount") > 0.05).alias("confident"), (F.col("timestamp_start") + 40).alias("duration"), "quantity",
    )


FOUND = f"""
{RECORDS}, k AS (SELECT f AS flag, {FLAG_SQL} AS kind FROM (SELECT f, trim(regexp_replace(strip_accents(lower(f)), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT unnest({_list(FLAGS)}) AS f))),
fi AS (SELECT rec.*, a.kind AS k1, b.kind AS k2, quantity > 48 AS gone, action_type IN ('click', 'type') AND action_target IS NULL AS no_target, timestamp_end > duration + 1 AS late FROM rec JOIN k a ON a.flag = flag1 JOIN k b ON b.flag = flag2),
ri AS (SELECT *, array_to_string(list_sort(list_distinct([k1, k2])), ',') AS categories, CAST(gone::INTEGER + no_target::INTEGER + (instruction = '')::INTEGER + late::INTEGER + CASE WHEN flag1 = flag2 THEN 1 ELSE 2 END AS INTEGER) AS n_issues,
  CASE WHEN gone THEN 'critical' WHEN status = 'verified' THEN 'low' WHEN no_target OR late OR k1 IN ('audio_visual_conflict', 'unsupported_action_target') OR k2 IN ('audio_visual_conflict', 'unsupported_action_target') THEN 'high' ELSE 'medium' END AS risk FROM fi)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return steps.findings(r, r.where("quantity <= 48").select(F.explode("frames").alias("path")))


@query(f"WITH {FOUND} SELECT video_id, step_number, categories, n_issues, risk FROM ri")
def tx30_step_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX30, TX31, TX32: issues, flag categories and risks; frames of quantities above 48 do not exist."""
    return _found(spark, sf_dir).select("video_id", "step_number", F.array_join("flag_categories", ",").alias("categories"), F.size("issues").alias("n_issues"), "risk")


@query(f"""
WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE risk WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, len(string_split(categories, ',')) DESC, step_number, timestamp_start) AS n FROM ri WHERE status = 'review_required')
SELECT video_id, step_number, risk, categories FROM r WHERE n = 1""")
def wi10_priority_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI10: of each video the step to look at first."""
    return evaluation.priority_steps(_found(spark, sf_dir)).select("video_id", "step_number", "risk", F.array_join("flag_categories", ",").alias("categories"))


@query(f"WITH {RECORDS} SELECT video_id, count_if(status = 'draft')::BIGINT AS draft, count_if(status = 'review_required')::BIGINT AS review_required, count_if(status = 'verified')::BIGINT AS verified, count_if(status = 'deprecated')::BIGINT AS deprecated, count(*) AS flagged FROM rec GROUP BY video_id")
def ag16_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.status_counts(_records(spark, sf_dir))


@query(f"WITH {RECORDS}, m AS (SELECT DISTINCT o_orderkey AS video_id, o_orderkey % 5 AS category FROM orders WHERE o_orderkey % 10 <> 3), v AS (SELECT DISTINCT video_id FROM rec WHERE video_id % 4 <> 1) SELECT coalesce(m.video_id, v.video_id) AS video_id, CASE WHEN m.video_id IS NULL THEN 'not_in_manifest' WHEN v.video_id IS NULL THEN 'not_processed' ELSE 'both' END AS place, category FROM m FULL JOIN v ON m.video_id = v.video_id")
def jo22_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO21, JO22: orders as the manifest of videos, some of which were processed."""
    m = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 5).alias("category")).distinct()
    return evaluation.manifest_differences(m, _records(spark, sf_dir).where("video_id % 4 <> 1").select("video_id").distinct(), "video_id")


SPOKEN = ("Cliquez sur le bouton Valider", "La date du 12", "Voici le planning", "")
LABELS = ("Valider", "12", "14/05", "bouton rouge", "")
SCREENS = f"""
screens AS (SELECT event_id, ({_list(SPOKEN)})[event_id % 4 + 1] AS spoken, ({_list(LABELS)})[event_id % 5 + 1] AS ui_element, event_type AS location, CASE WHEN event_id % 3 = 0 THEN 'click' WHEN event_id % 3 = 1 THEN 'none' END AS action_type,
  CASE WHEN event_id % 7 = 0 THEN 'L''utilisateur va cliquer' ELSE props END AS visual_description, event_id % 2 = 0 AS confident, CASE WHEN event_id % 11 = 0 THEN 'before' END AS uncertainty_reason FROM events)
"""


def _screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", pick(SPOKEN, n).alias("spoken"), pick(LABELS, n).alias("ui_element"), F.col("event_type").alias("location"), F.when(n % 3 == 0, "click").when(n % 3 == 1, "none").alias("action_type"), F.col("props").alias("expected_result"),
        F.when(n % 7 == 0, "L'utilisateur va cliquer").otherwise(F.col("props")).alias("visual_description"), (n % 2 == 0).alias("confident"), F.when(n % 11 == 0, "before").alias("uncertainty_reason"), F.lit("s").alias("screen_name"),
    )


# which label fits which phrase is written out: (phrase, label) pairs that share a word's first five letters
@query(f"""
WITH {SCREENS}, t AS (SELECT *, event_id % 7 = 0 AS d, ui_element LIKE 'bouton%' AS gen, ui_element IN ('12', '14/05') AND NOT (ui_element = '12' AND contains(spoken, '12')) AND NOT regexp_matches(spoken, '(?i)date') AS dat,
  ui_element <> '' AND NOT (ui_element = 'Valider' AND contains(spoken, 'Valider')) AND NOT (ui_element = 'bouton rouge' AND false) AS lab, coalesce(action_type = 'click', false) AND NOT contains(spoken, 'Cliquez') AS act FROM screens),
u AS (SELECT *, lab AND NOT dat AS lab2, d OR gen OR dat OR (lab AND NOT dat) OR act AS unsure FROM t)
SELECT event_id, CASE WHEN NOT (dat OR lab2) THEN ui_element END AS ui_element, CASE WHEN NOT (dat OR lab2) THEN location END AS location, CASE WHEN act THEN 'none' ELSE action_type END AS action_type, CASE WHEN NOT d THEN visual_description END AS visual_description, confident AND NOT unsure AS confident,
  CASE WHEN unsure THEN concat_ws('; ', uncertainty_reason, {', '.join(f"CASE WHEN {c} THEN '" + review.UNSURE_REASONS[k].replace("'", "''") + "' END" for k, c in (('description', 'd'), ('generic', 'gen'), ('date', 'dat'), ('label', 'lab2'), ('action', 'act')))}) ELSE uncertainty_reason END AS uncertainty_reason FROM u""")
def fi15_semantic_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI14, FI15, X9: guards over recorded descriptions of screens."""
    return review.semantic_guard(_screens(spark, sf_dir)).select("event_id", "ui_element", "location", "action_type", "visual_description", "confident", "uncertainty_reason")


PLACES = ("en haut à gauche", "à droite", "")


@query(f"""
WITH {SCREENS}, d AS (SELECT *, ({_list(PLACES)})[event_id % 3 + 1] AS place, ({_list(PLACES)})[event_id % 5 % 3 + 1] AS seen, event_id % 4 <> 3 AS bt, event_id % 6 <> 5 AS aft FROM screens),
t AS (SELECT *, ui_element <> '' AND NOT (ui_element = 'Valider' AND contains(spoken, 'Valider')) AS bad, coalesce(action_type = 'click', false) AND NOT contains(spoken, 'Cliquez') AS act FROM d),
p AS (SELECT *, CASE WHEN NOT bad THEN nullif(place, '') END AS kept FROM t),
c AS (SELECT *, coalesce(seen <> '' AND (contains(kept, 'gauche') AND contains(seen, 'droite') OR contains(kept, 'droite') AND contains(seen, 'gauche')), false) AS conflict, seen = '' AND kept IS NOT NULL AS unseen FROM p)
SELECT event_id, CASE WHEN NOT bad THEN ui_element END AS action_target, CASE WHEN act THEN 'none' ELSE action_type END AS action_type, CASE WHEN bt OR aft THEN CASE WHEN seen <> '' AND (kept IS NULL OR conflict) THEN seen WHEN NOT unseen THEN kept END END AS action_location,
  array_to_string(list_sort(list_filter([CASE WHEN bad THEN 'unsupported_action_target' END, CASE WHEN act THEN 'unsupported_action_type' END, CASE WHEN conflict THEN 'audio_visual_location_conflict' END, CASE WHEN unseen THEN 'missing_visual_location' END], lambda x: x IS NOT NULL)), ',') AS flags, confident AND bt AND aft AS confident FROM c""")
def fi16_guard_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    d = _screens(spark, sf_dir).withColumns({
        "action_target": F.col("ui_element"), "action_location": pick(PLACES, n), "visual_location": pick(PLACES, n % 5), "before_trusted": n % 4 != 3, "after_trusted": n % 6 != 5, "labels": F.lit(""), "instruction": F.lit("x"),
        "before_state": F.lit("b"), "after_state": F.lit("a"), "quality_flags": F.array().cast("array<string>"),
    }).withColumn("any_trusted", F.col("before_trusted") | F.col("after_trusted"))
    return review.guard_draft(d).select("event_id", "action_target", "action_type", "action_location", F.array_join("quality_flags", ",").alias("flags"), "confident")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS b, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 = 0 END AS a, event_id % 3 <> 0 AND event_id % 7 = 0 AS l FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN b IS NULL THEN 'missing_before_frame' END, CASE WHEN a IS NULL THEN 'missing_after_frame' END, CASE WHEN NOT b THEN 'uncertain_before_visual' END, CASE WHEN NOT a THEN 'uncertain_after_visual' END, CASE WHEN NOT l THEN 'missing_exact_ui_label' END], lambda x: x IS NOT NULL), ',') AS flags,
  coalesce(b AND a AND l, false) AS confident FROM e""")
def fi17_automatic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    frame = lambda there, sure, label: F.when(there, F.struct(sure.alias("confident"), F.when(label, "x").alias("ui_element")))
    e = table(spark, sf_dir, "events").select("event_id", frame(n % 3 != 0, n % 2 == 0, n % 7 == 0).alias("b"), frame(n % 4 != 0, n % 5 == 0, F.lit(False)).alias("a"))
    e = e.withColumn("f", review.automatic_flags(F.col("b"), F.col("a")))
    return e.select("event_id", F.array_join("f", ",").alias("flags"), review.final_confidence(F.col("b.confident"), F.col("a.confident"), F.col("f")).alias("confident"))


@query("""
WITH d AS (SELECT event_id, [event_id % 5, event_id % 3, event_id % 5, 9] AS r, CASE WHEN event_id % 2 = 0 THEN event_id % 6 END AS result, 4 AS n, event_id % 3 = 0 AS c FROM events),
k AS (SELECT *, CASE WHEN result BETWEEN 1 AND 4 THEN result END AS res, list_filter([r[1], CASE WHEN r[2] <> r[1] THEN r[2] END], lambda i: i BETWEEN 1 AND 4) AS rel FROM d),
m AS (SELECT *, CASE WHEN res IS NOT NULL AND NOT list_contains(rel, res) THEN list_append(rel, res) ELSE rel END AS al FROM k),
f AS (SELECT *, list_filter(al, lambda i: res IS NULL OR i <> res) AS others FROM m)
SELECT event_id, array_to_string(al, ',') AS relevant, 'p' || others[1] AS before, array_to_string(list_transform(others[2:], lambda i: 'p' || i), ',') AS supporting, 'p' || res AS after, c AND len(al) > 0 AND event_id % 4 <> 0 AS confident FROM f""")
def fi18_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI18, PR16: frames of a draft in range, each once; which come before, after and beside."""
    n = F.col("event_id").cast("int")
    d = table(spark, sf_dir, "events").select(
        "event_id", F.array(n % 5, n % 3, n % 5, F.lit(9)).alias("relevant"), F.when(n % 2 == 0, n % 6).alias("result"), F.lit(4).alias("n_frames"), (n % 3 == 0).alias("confident"),
        F.when(n % 4 == 0, F.array(F.lit(" flag "), F.lit(""))).otherwise(F.array(F.lit(" "))).alias("quality_flags"), F.array(*[F.lit(f"p{i}") for i in range(1, 5)]).alias("frames"))
    d = review.normal_draft(d)
    x = review.draft_frames(F.col("relevant"), F.col("result"), F.col("frames"))
    return d.select("event_id", F.array_join(F.transform("relevant", lambda i: i.cast("string")), ",").alias("relevant"), x["before"].alias("before"), F.array_join(x["supporting"], ",").alias("supporting"), x["after"].alias("after"), "confident")


@query("SELECT conv_id, min(text) FILTER (turn = t) AS before, max(text) FILTER (turn = u) AS after, string_agg(text, '|' ORDER BY turn) FILTER (role = 'system') AS supporting FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS t, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS u FROM conversations) GROUP BY conv_id")
def pr19_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR18, PR19: the turns of a conversation as the frames of an item, by role."""
    role = F.when(F.col("role") == "user", "avant").when(F.col("role") == "assistant", "apres").otherwise("support-1")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("source")))), lambda x: F.struct(x["role"], x["source"])).alias("shots"))
    x = review.review_frames(F.col("shots"))
    return c.select("conv_id", x["before"].alias("before"), x["after"].alias("after"), F.when(F.size(x["supporting"]) > 0, F.array_join(x["supporting"], "|")).alias("supporting"))


METRIC = "SELECT conv_id, turn, '{0}' AS metric, {1} AS baseline, {2} AS proposal FROM v"


@query(f"""
WITH {TURNS}, v AS (SELECT *, {TOKENS.format('a')} AS ta, {TOKENS.format('b')} AS tb, {TOKENS.format('g')} AS tg, [a, b] AS sa, [b] AS sb, [g, a] AS sg FROM turns),
m AS ({' UNION ALL '.join(METRIC.format(f + '_token_f1', F1.format('ta', 'tg'), F1.format('tb', 'tg')) for f in ('instruction', 'action_target', 'action_location', 'screen_before', 'visual_description', 'after_state'))}
  UNION ALL {METRIC.format('action_type_exact', '(a = g)::INTEGER::DOUBLE', '(b = g)::INTEGER::DOUBLE')} UNION ALL {METRIC.format('screenshot_after_exact', '(a = g)::INTEGER::DOUBLE', '(b = g)::INTEGER::DOUBLE')}
  UNION ALL {METRIC.format('after_state_presence_exact', "((a = '') = (g = ''))::INTEGER::DOUBLE", "((b = '') = (g = ''))::INTEGER::DOUBLE")}
  UNION ALL {METRIC.format('evidence_frame_f1', "CASE WHEN a = g THEN 1.0::DOUBLE ELSE 0.0 END", "CASE WHEN b = g THEN 1.0::DOUBLE ELSE 0.0 END")})
SELECT metric, round(avg(baseline), 4) AS baseline, round(avg(proposal), 4) AS proposal, round(avg(proposal) - avg(baseline), 4) AS delta, count(*) AS n FROM m GROUP BY metric""")
def ag22_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, AG23, TX20, JO17: a turn and the next one measured against the one after."""
    step = lambda c: F.struct(*[F.col(c).alias(f) for f in ("instruction", "action_type", "action_target", "action_location", "screen_before", "screen_after", "visual_description", "screenshot_after")], F.lit(None).cast("string").alias("screenshot_before"), F.array().cast("array<string>").alias("supporting_screenshots"))
    items = _turns(spark, sf_dir).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("step_number"), step("a").alias("original"), step("b").alias("proposal"), step("g").alias("gold"))
    return steps.calibration_summary(review.comparison(items))


@query(f"WITH {STEPS}, a AS (SELECT mode || flag AS metric, avg(quantity) AS v FROM st WHERE step_number % 2 = 0 GROUP BY 1), b AS (SELECT mode || flag AS metric, avg(quantity) AS v FROM st WHERE step_number % 2 = 1 GROUP BY 1) SELECT a.metric, round(a.v, 4) AS first, round(b.v, 4) AS second, round(b.v - a.v, 4) AS delta FROM a JOIN b USING (metric)")
def jo19_two_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir).select(F.concat("mode", "flag").alias("metric"), "quantity", "step_number")
    of = lambda r: s.where(F.col("step_number") % 2 == r).groupBy("metric").agg(F.avg("quantity").alias("value"))
    return evaluation.metric_deltas(of(0), of(1))


BATCH = f"""
{RECORDS}, st2 AS (SELECT * FROM rec WHERE status = 'review_required'), p AS (SELECT video_id, step_number, 'new' AS action_type FROM rec WHERE step_number % 2 = 0),
x AS (SELECT DISTINCT video_id, step_number FROM rec WHERE quantity > 45), r AS (SELECT DISTINCT video_id, step_number FROM rec WHERE quantity < 5),
v AS (SELECT s.video_id, s.step_number, coalesce(p.action_type, s.action_type) AS action_type, p.video_id IS NOT NULL AS calibrated, CASE WHEN r.video_id IS NULL THEN s.frame END AS screenshot_after FROM st2 s ANTI JOIN x USING (video_id, step_number) LEFT JOIN p ON p.video_id = s.video_id AND p.step_number = s.step_number LEFT JOIN r ON r.video_id = s.video_id AND r.step_number = s.step_number)
"""


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = _records(spark, sf_dir).withColumns({
        "action_location": F.lit(None).cast("string"), "screen_before": F.lit(None).cast("string"), "visual_description": F.lit("seen"), "screenshot_after": F.col("frames")[0], "supporting_screenshots": F.array().cast("array<string>")})
    p = r.where("step_number % 2 = 0").select("video_id", "step_number", F.lit("new").alias("action_type"), "action_target", "action_location", "screen_before", "visual_description", F.lit("m").alias("model"))
    x = r.where("quantity > 45").select("video_id", "step_number").distinct()
    v = review.validate_batch(r, p, x, r.where("quantity < 5").select("video_id", "step_number"), "reviewer", "2024-01-01", "b1")
    return v, x, r


@query(f"WITH {BATCH} SELECT video_id, step_number, action_type, calibrated, screenshot_after, 'verified' AS status FROM v")
def pr22_validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR17, PR22, JO12, JO14: steps under review verified as one batch."""
    return _batch(spark, sf_dir)[0].select("video_id", "step_number", "action_type", "calibrated", "screenshot_after", "status")


@query(f"WITH {RECORDS} SELECT video_id, step_number, 'model' AS action_type, instruction, confident FROM rec WHERE step_number % 2 = 0")
def pr17_measured_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR17: a proposal's measured fields, the rest from the original."""
    r = _records(spark, sf_dir)
    p = r.where("step_number % 2 = 0").withColumns({"action_type": F.lit("model"), "instruction": F.lit("model"), "confident": F.lit(False)})
    return review.measured_policy(p, r, ("action_type",), ("instruction", "confident")).select("video_id", "step_number", "action_type", "instruction", "confident")


@query(f"WITH {BATCH} SELECT (SELECT count(*) FROM rec WHERE step_number = 1) AS sample, (SELECT count_if(quantity > 3)::BIGINT FROM rec WHERE step_number = 1) AS correct, (SELECT count_if(quantity <= 3)::BIGINT FROM rec WHERE step_number = 1) AS minor_corrections, count(*) AS eligible, count_if(calibrated)::BIGINT AS calibrated, count_if(NOT calibrated)::BIGINT AS kept_original, (SELECT count(*) FROM x) AS pending_exceptions FROM v")
def ag21_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x, r = _batch(spark, sf_dir)
    results = r.where("step_number = 1").select(F.when(F.col("quantity") > 3, "correct").otherwise("incorrect").alias("decision"))
    return review.batch_report(results, v, x)


@query(f"WITH {RECORDS}, k AS (SELECT DISTINCT video_id, step_number FROM rec WHERE quantity < 4) SELECT video_id, step_number, CASE WHEN i THEN 'severity' ELSE 'resolution' END AS problem FROM (SELECT video_id, step_number, step_number % 2 = 0 AS i FROM k) WHERE i OR step_number % 3 = 0")
def fi21_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI21: a resolution for each incorrect step, some of them not minor and some unknown."""
    k = _records(spark, sf_dir).where("quantity < 4").select("video_id", "step_number").distinct()
    even = F.col("step_number") % 2 == 0
    r = k.withColumns({"severity": F.when(even, "major").otherwise("minor"), "resolution": F.when(~even & (F.col("step_number") % 3 == 0), "other").otherwise("prefer_original_primary_evidence")})
    return review.resolutions_errors(k, r, ("prefer_original_primary_evidence",))


@query(f"WITH {STEPS} SELECT mode AS video_id, step_number, count(*) AS n FROM st GROUP BY mode, step_number HAVING count(*) > 1")
def fi22_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.repeated_keys(_steps(spark, sf_dir).select(F.col("mode").alias("video_id"), "step_number"))


@query(f"""
WITH {RECORDS}, u AS (SELECT video_id, step_number, CASE WHEN quantity > 40 THEN 'other' ELSE 'verified' END AS status, CASE WHEN quantity > 10 THEN 'me' ELSE ' ' END AS reviewer, quantity > 30 AS override FROM rec WHERE step_number = 2)
SELECT video_id, step_number, unnest(list_filter([CASE WHEN status = 'other' THEN 'status' END, CASE WHEN status = 'verified' AND trim(reviewer) = '' THEN 'reviewer' END, CASE WHEN status = 'verified' AND NOT override THEN 'flagged' END], lambda x: x IS NOT NULL)) AS problem FROM u
UNION ALL SELECT -video_id, step_number, unnest(['unknown_step', 'reviewer']) FROM rec WHERE step_number = 3 AND video_id > 0""")
def fi19_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    q = F.col("quantity")
    u = r.where("step_number = 2").select("video_id", "step_number", F.when(q > 40, "other").otherwise("verified").alias("status"), F.when(q > 10, "me").otherwise(" ").alias("reviewer"), (q > 30).alias("override"))
    stray = r.where("step_number = 3 AND video_id > 0").select((-F.col("video_id")).alias("video_id"), "step_number", F.lit("verified").alias("status"), F.lit(None).cast("string").alias("reviewer"), F.lit(True).alias("override"))
    return review.update_errors(r.select("video_id", "step_number", "quality_flags").dropDuplicates(["video_id", "step_number"]), u.unionByName(stray))


@query(f"WITH {RECORDS} SELECT video_id, step_number, CASE WHEN step_number > 5 THEN 'step' WHEN quantity <= 20 THEN 'suggestion' END AS error FROM rec WHERE quantity > 10")
def jo16_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO16, SC30: a sample with the suggestions and steps that there are."""
    r = _records(spark, sf_dir)
    status = F.when(F.col("quantity") > 30, "proposal_only").when(F.col("quantity") > 20, "error").otherwise("skipped")
    return review.review_sample(r.where("quantity > 10").select("video_id", "step_number"), r.withColumn("status", status), r.where("step_number <= 5")).select("video_id", "step_number", "error")


@query(f"""
WITH c AS (SELECT conv_id AS video_id, turn AS segment, text, contains({ASCII}, 'thanst') OR contains({ASCII}, 'reea') AS hit FROM conversations), a AS (SELECT *, max(hit) OVER (PARTITION BY video_id) AS any_hit FROM c)
SELECT video_id, segment FROM a WHERE hit OR NOT any_hit""")
def fi13_action_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment"), "text")
    return review.action_segments(c, ("Thanst", "reea")).select("video_id", "segment")


CUES = ("the", "of", "in")


@query(f"""
WITH RECURSIVE w AS (SELECT conv_id, turn, string_split({ASCII}, ' ') AS w FROM conversations),
k AS (SELECT conv_id, turn, w, 1 AS i, []::VARCHAR[] AS seen, []::INTEGER[] AS places FROM w
  UNION ALL SELECT conv_id, turn, w, i + 1, CASE WHEN cue IS NULL THEN seen ELSE list_append(seen, cue) END, CASE WHEN cue IS NULL THEN places ELSE list_append(places, CAST(i - 1 AS INTEGER)) END
  FROM (SELECT *, list_filter({_list(CUES)}, lambda c: contains(w[i], c) AND NOT list_contains(seen, c))[1] AS cue FROM k WHERE i <= len(w)))
SELECT conv_id, turn, array_to_string(places, ',') AS positions, array_to_string(seen, ',') AS cues FROM k WHERE i = len(w) + 1 AND len(seen) >= 2""")
def ag11_cue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: the words of a turn, one a second, as those of a phrase."""
    from gleaner.functions.folding import keyframe_key

    words = F.transform(F.split(keyframe_key(F.col("text")), " "), lambda t, i: F.struct(t.alias("text"), i.cast("double").alias("start"), (i + 1).cast("double").alias("end")))
    m = review.cue_matches(F.col("w"), CUES, F.lit(1000.0), F.lit(0.0), least=2)
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("m", m).where(F.size("m") > 0)
    return x.select("conv_id", "turn", F.array_join(F.transform("m", lambda x: x["position"].cast("string")), ",").alias("positions"), F.array_join(F.transform("m", lambda x: x["cue"]), ",").alias("cues"))


@query(f"""
WITH c AS (SELECT conv_id, turn, list_sort({TOKENS.format('text')}) AS w FROM conversations),
sets AS (SELECT w, list((conv_id, turn) ORDER BY conv_id DESC, turn DESC)[:4] AS keys FROM c GROUP BY w),
words AS (SELECT w AS s, unnest(w) AS x FROM sets),
pairs AS (SELECT a.s AS s, b.s AS t, 2.0::DOUBLE * count(*) / (len(a.s) + len(b.s)) AS f1 FROM words a JOIN words b ON a.x = b.x GROUP BY a.s, b.s),
near AS (SELECT s, f1, unnest(keys) AS k FROM pairs JOIN sets ON t = w),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f1 DESC, k DESC) AS r FROM near) WHERE r <= 4),
top AS (SELECT conv_id, turn, w FROM c ORDER BY conv_id DESC, turn DESC LIMIT 4),
bare AS (SELECT conv_id, turn, w FROM c WHERE len(w) = 0 ORDER BY conv_id DESC, turn DESC LIMIT 4),
found AS (
  SELECT c.conv_id, c.turn, k[1] AS r_video, k[2] AS r_step, f1 FROM c JOIN best ON c.w = best.s
  UNION ALL SELECT c.conv_id, c.turn, x.conv_id, x.turn, CASE WHEN len(c.w) = 0 AND len(x.w) = 0 THEN 1.0 ELSE 0.0 END FROM c, (SELECT * FROM top UNION SELECT * FROM bare) x),
g AS (SELECT conv_id, turn, r_video, r_step, max(f1) AS f1 FROM found WHERE conv_id <> r_video OR turn <> r_step GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY f1 DESC, r_video DESC, r_step DESC) AS rank FROM g)
SELECT conv_id AS video_id, turn AS step_number, r_video, r_step, round(f1, 6) AS f1, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def tk5_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK5: the three turns most like each turn."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("step_number"), calibration_tokens(F.col("text")).alias("tokens"))
    return review.nearest_examples(c, c).withColumn("f1", F.round("f1", 6))


@query(f"""
WITH {RECORDS}, v AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_start, step_number) AS n FROM rec WHERE status = 'verified')
SELECT substring(sha1(video_id || '::step' || n), 1, 16) AS id, instruction || CASE WHEN action_target IS NOT NULL THEN chr(10) || 'Action : ' || action_type || ' sur ' || action_target ELSE '' END AS content, 'proc > etape ' || n AS breadcrumb, frame AS screenshot FROM v""")
def sk7_export_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7, SK14, PR4, PR18, AG20, TK10: the documents of verified steps."""
    none = F.lit(None).cast("string")
    r = _records(spark, sf_dir).withColumns({
        "procedure": F.lit("proc"), "video_title": none, "action_location": none, "screen_before": none, "screen_after": none, "visual_description": none, "screenshot_before": F.col("frames")[0], "supporting_screenshots": F.col("frames"), "screenshot_after": none})
    return review.export_verified(r).select("id", "content", "breadcrumb", "screenshot")


@query(f"WITH {RECORDS} SELECT CAST(video_id AS VARCHAR) || ':' || step_number AS id, unnest(list_filter([CASE WHEN timestamp_end - 45 < timestamp_start THEN 'interval' END, CASE WHEN status = 'verified' AND quantity > 20 THEN 'review' END], lambda x: x IS NOT NULL)) AS violation FROM rec")
def fi6_step_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner import schema

    r = _records(spark, sf_dir).withColumns({"id": F.concat_ws(":", "video_id", "step_number"), "timestamp_end": F.col("timestamp_end") - 45, "reviewed_by": F.when(F.col("quantity") <= 20, "me"), "reviewed_at": F.lit("2024-01-01")})
    return schema.violations(r, review.step_constraints())


@query(f"WITH {RECORDS} SELECT video_id, step_number, array_to_string(list_filter([CASE WHEN quantity > 45 THEN 'instruction' END, CASE WHEN step_number % 2 = 0 THEN 'action_type' END, CASE WHEN action_target IS NULL THEN 'action_target' END], lambda x: x IS NOT NULL), ',') AS changed FROM rec")
def pr21_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    before = {f: F.col(f) for f in ("instruction", "action_type", "action_target")}
    after = {"instruction": F.when(F.col("instruction") == "", "new").otherwise(F.col("instruction")), "action_type": F.when(F.col("step_number") % 2 == 0, "new").otherwise(F.col("action_type")), "action_target": F.coalesce("action_target", F.lit("new"))}
    return r.select("video_id", "step_number", F.array_join(steps.changed_fields(before, after), ",").alias("changed"))


@query()
def pr20_proposal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR20: of sorted compact JSON; checked in the tests."""
    return _records(spark, sf_dir).select("video_id", "step_number", steps.proposal_hash(["action_type", "action_target", "instruction", "confident", "quality_flags"]).alias("proposal_hash"))


@query("""
WITH s AS (SELECT segment, v, a, event_id FROM (SELECT event_id, user_id AS segment, event_id % 3 = 0 AS v, event_id % 4 <> 0 AS a FROM events)),
j AS (SELECT e.event_id, e.user_id, u.user_id IS NULL AS missing FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id % 5 <> 0) u ON u.user_id = e.user_id)
SELECT user_id AS segment, count(*) AS frames, count_if(missing)::BIGINT AS without_segment FROM j GROUP BY user_id""")
def jo11_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO11, SC28: frames and the segments that they name, with those that do not exist."""
    e = table(spark, sf_dir, "events")
    segments = e.where("event_type = 'view' AND user_id % 5 <> 0").select(F.col("user_id").alias("segment")).distinct()
    x = evaluation.with_segments(e.select(F.col("user_id").alias("segment"), "event_id"), segments)
    return x.groupBy("segment").agg(F.count(F.lit(1)).alias("frames"), F.count_if("missing").alias("without_segment"))


@query("""
WITH g AS (SELECT user_id AS video_id, event_id AS segment, value AS t, (['Cliquez sur Valider', 'Voici'])[event_id % 2 + 1] AS spoken FROM events WHERE event_id % 3 <> 0)
SELECT video_id, segment, CAST(row_number() OVER (PARTITION BY video_id ORDER BY t, segment) AS INTEGER) AS step_number, CASE WHEN segment % 2 = 0 THEN 'Valider' END AS action_target, array_to_string(list_filter([CASE WHEN true THEN 'missing_after_frame' END, CASE WHEN segment % 2 = 1 THEN 'unsupported_action_target' END, CASE WHEN segment % 2 = 1 THEN 'unsupported_action_type' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""")
def ch6_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CH6, WI4: groups of frames and their drafts to numbered steps, with guards and flags."""
    n = F.col("segment")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("segment"), F.col("value").alias("t"))
    screen = F.struct(F.lit(True).alias("confident"), F.lit("Autre").alias("ui_element"), F.lit("").alias("location"))
    groups = e.select("video_id", "segment", "t", pick(("Cliquez sur Valider", "Voici"), n).alias("spoken"), screen.alias("before"), F.when(F.lit(False), screen).alias("after"))
    none = F.lit(None).cast("string")
    drafts = e.where("segment % 3 <> 0").select("video_id", "segment", F.lit("Valider").alias("action_target"), F.lit("click").alias("action_type"), none.alias("action_location"), F.lit("x").alias("instruction"), none.alias("visual_description"), none.alias("before_state"), none.alias("after_state"), F.lit(True).alias("confident"), F.array().cast("array<string>").alias("quality_flags"))
    return review.assemble(groups, drafts).select("video_id", "segment", "step_number", "action_target", F.array_join("quality_flags", ",").alias("flags"))


# evaluation sets: first turns are questions, sources are those of the documents
EVAL = f"""
{CANON}, cases AS (SELECT conv_id AS id, CASE WHEN conv_id % 9 = 0 THEN ' ' WHEN conv_id % 7 = 0 THEN 'SAME question' ELSE 'q' || text END AS question, (['software', 'hotel', 'other'])[conv_id % 3 + 1] AS category, (['direct', 'paraphrase', 'odd'])[conv_id % 4 % 3 + 1] AS question_type,
  CASE WHEN conv_id % 5 = 0 THEN [] ELSE ['src' || (conv_id % 20)] END AS expected, conv_id % 6 <> 0 AS answerable FROM conversations WHERE turn = 0)
"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    q = F.when(n % 9 == 0, " ").when(n % 7 == 0, "SAME question").otherwise(F.concat(F.lit("q"), "text"))
    return table(spark, sf_dir, "conversations").where("turn = 0").select(
        n.alias("id"), q.alias("question"), pick(("software", "hotel", "other"), n).alias("category"), pick(("direct", "paraphrase", "odd"), n % 4).alias("question_type"),
        F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), n % 20))).alias("expected"), (n % 6 != 0).alias("answerable"))


@query(f"""
WITH {EVAL}, d AS (SELECT source_id, list(DISTINCT domain) AS domains FROM canon GROUP BY source_id),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY id) AS dup FROM cases)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN trim(question) = '' THEN 'question_absent' WHEN dup > 1 THEN 'question_repeated' END, CASE WHEN category = 'other' THEN 'category' END, CASE WHEN question_type = 'odd' THEN 'question_type' END, CASE WHEN answerable <> (len(expected) > 0) THEN 'answerable' END,
  CASE WHEN len(expected) > 0 AND d.source_id IS NULL THEN 'source_absent:' || expected[1] END, CASE WHEN d.source_id IS NOT NULL AND NOT list_contains(domains, category) THEN 'source_domain:' || expected[1] END], lambda x: x IS NOT NULL)), ',') AS errors FROM n LEFT JOIN d ON d.source_id = expected[1]""")
def fi26_dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI26, JO5: the errors of each case of an evaluation set."""
    sources = canonical(spark, sf_dir).select("source_id", "domain").distinct()
    return evaluation.audit(_cases(spark, sf_dir), sources).select("id", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query(f"""
WITH {EVAL}
SELECT count(*) AS questions, count_if(category = 'software')::BIGINT AS software, count_if(category = 'hotel')::BIGINT AS hotel, count_if(len(expected) > 0)::BIGINT AS answerable, count_if(len(expected) = 0)::BIGINT AS unanswerable, (SELECT count(DISTINCT x) FROM (SELECT unnest(expected) AS x FROM cases)) AS unique_sources, false AS balanced FROM cases""")
def ag9_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.profile(_cases(spark, sf_dir))


@query("SELECT CASE WHEN turn % 5 = 0 THEN NULL ELSE conv_id % 100 END AS id, CASE WHEN turn % 5 = 0 THEN 'absent' ELSE 'repeated' END AS problem, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1 OR id IS NULL")
def fi27_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 5 != 0, F.col("conv_id") % 100).alias("id"))
    return evaluation.id_errors(c)


@query("""
WITH j AS (SELECT conv_id * 10 + turn AS id, CASE WHEN turn % 4 <> 3 THEN CASE WHEN role = 'user' THEN 'pass' ELSE 'fail' END END AS verdict, len(text) % 5 AS score, len(text) AS tokens FROM conversations)
SELECT count(*) AS expected, count(verdict) AS completed, count_if(verdict IS NULL)::BIGINT AS errors, count_if(verdict = 'pass')::BIGINT AS passed, round(coalesce(avg(score) FILTER (verdict IS NOT NULL), 0), 3) AS mean_score, CAST(sum(tokens) FILTER (verdict IS NOT NULL) AS BIGINT) AS prompt_tokens FROM j""")
def ag25_judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    verdict = F.when(F.col("turn") % 4 != 3, F.when(F.col("role") == "user", "pass").otherwise("fail"))
    return evaluation.judge_summary(table(spark, sf_dir, "conversations").select(verdict.alias("verdict"), (n % 5).alias("score"), n.alias("prompt_tokens")))


@query("SELECT conv_id, turn, turn % 3 = 0 AS again FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, true FROM conversations WHERE turn % 2 = 1 AND false")
def jo24_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO24, TK8: even turns are to be judged, those divisible by three have been."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    x = evaluation.resume(c.where("turn % 2 = 0"), c.where("turn % 3 = 0").withColumn("verdict", F.lit("pass")), ("conv_id", "turn"))
    return x.select("conv_id", "turn", F.col("verdict").isNotNull().alias("again"))


@query("SELECT conv_id, turn, max(len(text)) AS score FROM conversations GROUP BY conv_id, turn")
def jo24_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO24, TK8: every turn judged once by a stage that keeps a checkpoint; its files are dealt over four batches and the stage is started twice."""
    root = scratch(spark, "resumable")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(8, "conv_id", "turn").write.parquet(f"{root}/items")
    files = len(spark.read.parquet(f"{root}/items").inputFiles())
    judge = lambda d: d.select("conv_id", "turn", F.length("text").cast("bigint").alias("score"))
    for _ in range(2):  # the second start finds nothing to do
        out = resumable.run(spark, f"{root}/items", "conv_id bigint, turn bigint, text string", judge, f"{root}/out", ("conv_id", "turn"), files_per_batch=-(-files // 4))
    return out


CHECKS = """
runs AS (SELECT conv_id AS id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS answer, conv_id % 4 = 0 AS abstained, conv_id % 5 = 0 AS expect_abstention, conv_id % 3 <> 0 AS citations_valid, conv_id % 7 <> 0 AS hotel, conv_id % 2 = 0 AS need_video, conv_id % 6 = 0 AS video, conv_id % 12 = 0 AS evidence FROM conversations GROUP BY conv_id),
failed AS (SELECT id, list_filter([CASE WHEN expect_abstention AND NOT abstained THEN 'abstention' END, CASE WHEN NOT expect_abstention AND abstained THEN 'abstained' END, CASE WHEN NOT expect_abstention AND NOT citations_valid THEN 'citation' END, CASE WHEN NOT expect_abstention AND NOT hotel THEN 'domains:hotel' END,
  CASE WHEN NOT expect_abstention AND NOT contains(answer, 'the') THEN 'text' END, CASE WHEN need_video AND NOT video THEN 'video' WHEN need_video AND NOT evidence THEN 'video_evidence' END], lambda x: x IS NOT NULL) AS f FROM runs)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer"))
    return c.withColumns({
        "abstained": n % 4 == 0, "expect_abstention": n % 5 == 0, "citations_valid": n % 3 != 0, "cited_domains": F.when(n % 7 != 0, F.array(F.lit("hotel"))).otherwise(F.array(F.lit("software"))), "expected_domains": F.array(F.lit("hotel")),
        "expected_text": F.lit("the"), "require_video": n % 2 == 0, "videos": (n % 6 == 0).cast("int"), "videos_with_evidence": (n % 12 == 0).cast("int")})


@query(f"WITH {CHECKS} SELECT id, array_to_string(f, ',') AS failures FROM failed")
def fi28_release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.release_failures(_runs(spark, sf_dir)).select("id", F.array_join("failures", ",").alias("failures"))


@query(f"WITH {CHECKS} SELECT count_if(len(f) = 0)::BIGINT AS passed, count(*) AS total, count_if(len(f) > 0) = 0 AS all_passed FROM failed")
def ag27_release_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24, AG27."""
    return evaluation.totals(evaluation.release_failures(_runs(spark, sf_dir)).select((F.size("failures") == 0).alias("passed")))
