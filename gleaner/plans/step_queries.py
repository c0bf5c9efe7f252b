"""Queries on step records; order lines stand for a video's steps, events for timed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators import steps
from gleaner.plans.registry import query, table

STEPS = """
st AS (SELECT l_orderkey AS video_id, l_linenumber AS step_number, epoch(l_shipdate) / 86400.0 AS timestamp_start, l_returnflag AS flag, l_shipmode AS mode, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_linestatus AS linestatus,
    CASE WHEN l_orderkey % 5 = 0 THEN 9 ELSE max(l_linenumber) OVER (PARTITION BY l_orderkey) END AS total_steps
  FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 'left' ELSE 'right' END AS l_shipmode FROM lineitem)),
f AS (SELECT video_id, step_number, flag, timestamp_start, mode, tax, CASE WHEN quantity > 49 THEN 1 ELSE 0 END AS missing_assets,
  CASE WHEN quantity > 49 OR tax > 0.079 AND discount > 0.09 THEN 'critical' WHEN linestatus = 'F' AND flag = 'N' THEN 'low' WHEN flag = 'R' THEN 'high' WHEN flag = 'A' THEN 'medium' ELSE 'low' END AS risk FROM st)
"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    most = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return x.select(
        F.when(F.col("l_orderkey") % 5 == 0, 9).otherwise(most).alias("total_steps"), F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("step_number"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400e6).alias("timestamp_start"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_partkey") % 3 == 0, "left").otherwise("right").alias("mode"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("linestatus"),
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    status = F.when((F.col("linestatus") == "F") & (F.col("flag") == "N"), "verified").otherwise("draft")
    gone = F.col("quantity") > 49
    return s.withColumns({"missing_assets": gone.cast("int"), "risk": steps.risk(gone, (F.col("tax") > 0.079) & (F.col("discount") > 0.09), F.col("flag") == "R", F.col("flag") == "A", status)})


@query(f"WITH {STEPS} SELECT video_id, step_number, risk, missing_assets FROM f")
def tx31_step_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX31, TX32."""
    return _findings(spark, sf_dir).select("video_id", "step_number", "risk", "missing_assets")


AUDIT = f"""
{STEPS},
q AS (SELECT *, row_number() OVER w AS n, lag(timestamp_start) OVER w AS p, count(*) OVER (PARTITION BY video_id) AS c FROM st WHERE tax <= 0.079 WINDOW w AS (PARTITION BY video_id ORDER BY step_number, timestamp_start)),
i AS (SELECT video_id, array_to_string(list_filter([CASE WHEN bool_or(n <> step_number) THEN 'non_contiguous_step_numbers' END, CASE WHEN bool_or(timestamp_start < p) THEN 'non_monotonic_timestamps' END, CASE WHEN bool_or(total_steps <> c) THEN 'inconsistent_total_steps' END], lambda x: x IS NOT NULL), ',') AS sequence_issues FROM q GROUP BY video_id),
a AS (SELECT video_id, count(*) AS steps, count_if(risk = 'critical') AS critical, CAST(count_if(risk = 'high') AS BIGINT) AS high, CAST(count_if(risk = 'medium') AS BIGINT) AS medium, CAST(count_if(risk = 'low') AS BIGINT) AS low, CAST(sum(missing_assets) AS BIGINT) AS missing_assets FROM f WHERE tax <= 0.079 GROUP BY video_id),
bad AS (SELECT video_id, count(*) AS invalid FROM f WHERE tax > 0.079 GROUP BY video_id),
au AS (
  SELECT video_id, coalesce(steps, 0) AS steps, CAST(coalesce(critical, 0) + coalesce(invalid, 0) AS BIGINT) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(missing_assets, 0) AS missing_assets,
    coalesce(invalid, 0) AS invalid, coalesce(sequence_issues, '') AS sequence_issues,
    CAST(100 * coalesce(critical, 0) + 10 * coalesce(high, 0) + 3 * coalesce(medium, 0) + 20 * coalesce(missing_assets, 0) + 100 * coalesce(invalid, 0) + 25 * CASE WHEN coalesce(sequence_issues, '') = '' THEN 0 ELSE 1 + len(regexp_extract_all(sequence_issues, ',')) END AS BIGINT) AS risk_score
  FROM a FULL JOIN bad USING (video_id) LEFT JOIN i USING (video_id))
"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose tax is above 0.079 stand for those that the schema refuses."""
    refused = F.col("tax") > 0.079
    bad = _steps(spark, sf_dir).where(refused).groupBy("video_id").agg(F.count(F.lit(1)).alias("invalid"))
    return steps.audit(_findings(spark, sf_dir).where(~refused), steps.sequence_issues(_steps(spark, sf_dir).where(~refused), ("step_number", "timestamp_start")), bad)


@query(f"WITH {AUDIT} SELECT * FROM au")
def ag13_video_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG14, WI8."""
    return _audit(spark, sf_dir).withColumn("sequence_issues", F.array_join("sequence_issues", ","))


@query(f"""
WITH {AUDIT},
more AS (SELECT l_orderkey AS video_id, CAST(sum(l_quantity) AS DOUBLE) AS duration, count_if(l_linestatus = 'O') AS open FROM lineitem GROUP BY 1),
c AS (SELECT *, video_id % 4 AS category FROM au JOIN more USING (video_id) WHERE open > 0),
m AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY risk_score DESC, steps DESC, video_id DESC) AS b FROM c),
e AS (SELECT (SELECT video_id FROM c ORDER BY duration DESC, video_id LIMIT 1) AS l, (SELECT video_id FROM c ORDER BY duration, video_id LIMIT 1) AS s, (SELECT video_id FROM c ORDER BY steps DESC, video_id LIMIT 1) AS t),
k AS (SELECT m.*, critical > 0 OR missing_assets > 0 OR b = 1 OR video_id IN (l, s, t) AS forced FROM m, e),
r AS (SELECT *, row_number() OVER (PARTITION BY forced ORDER BY risk_score DESC, steps DESC, video_id DESC) AS r FROM k)
SELECT video_id, forced FROM r WHERE forced OR r <= 500 - (SELECT count(*) FROM k WHERE forced)""")
def tk6_recommended_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK6, WI9: of videos with steps under review the critical ones and those that lack files, the riskiest by category and the extremes, then by risk."""
    more = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.sum("l_quantity").cast("double").alias("duration"), F.count_if(F.col("l_linestatus") == "O").alias("review_required"))
    return steps.recommended(_audit(spark, sf_dir).join(more, "video_id").withColumn("category", F.col("video_id") % 4), 500)


@query(f"""
WITH {STEPS}, x AS (SELECT video_id, step_number, risk, md5('s1:' || risk || ':' || video_id) AS v, md5('s1:' || video_id || ':' || step_number) AS s FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY risk, video_id ORDER BY s) AS turn FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY turn, v, s) AS rank FROM t)
SELECT video_id, step_number, risk, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE risk WHEN 'high' THEN 20 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 ELSE 0 END""")
def tk7_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.stratified_sample(_findings(spark, sf_dir).select("video_id", "step_number", "risk"), {"high": 20, "medium": 20, "low": 10}, "s1")


@query(f"WITH {STEPS} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_start, step_number, flag) AS INTEGER) AS step_number, CAST(count(*) OVER (PARTITION BY video_id) AS INTEGER) AS total_steps, flag FROM st")
def wi4_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.renumber(_steps(spark, sf_dir), ("flag",)).select("video_id", "step_number", "total_steps", "flag")


@query(f"WITH {STEPS} SELECT flag || '/' || mode AS flag, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, min(video_id * 10 + step_number), flag || '/' || mode) AS INTEGER) AS rank FROM st GROUP BY 1")
def ag15_flag_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15: ties by first appearance."""
    return steps.flag_frequencies(_steps(spark, sf_dir).select(F.concat("flag", F.lit("/"), "mode").alias("flag"), (F.col("video_id") * 10 + F.col("step_number")).alias("at")), "at")


@query(f"WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY video_id, step_number) AS n FROM f WHERE risk = 'critical') SELECT video_id, step_number, risk, CAST((n - 1) // 10 + 1 AS INTEGER) AS lot FROM r")
def sk12_review_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12, SK13: critical steps in lots of ten."""
    return steps.lots(_findings(spark, sf_dir).where("risk = 'critical'").select("video_id", "step_number", "risk"), 10)


FRAMES = "fr AS (SELECT user_id AS segment, epoch_us(ts) / 1e6 AS t, event_id AS frame_id, CASE event_type WHEN 'view' THEN 'before' WHEN 'click' THEN 'after' ELSE 'scene' END AS moment FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    moment = F.when(F.col("event_type") == "view", "before").when(F.col("event_type") == "click", "after").otherwise("scene")
    return e.select(F.col("user_id").alias("segment"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("frame_id"), moment.alias("moment"))


@query(f"""
WITH RECURSIVE {FRAMES},
o AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY t, frame_id) AS n FROM fr),
k AS (SELECT segment, n, t, frame_id FROM o WHERE n = 1
  UNION ALL SELECT segment, n, t, frame_id FROM (SELECT o.*, row_number() OVER (PARTITION BY o.segment ORDER BY o.n) AS r FROM k JOIN o ON o.segment = k.segment AND o.n > k.n AND o.t - k.t >= 36000 - 1e-9) WHERE r = 1)
SELECT segment, frame_id FROM k""")
def ag12_thin_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, JO10, CH7: frames of a segment at least ten hours after the last kept one."""
    return steps.thin(_frames(spark, sf_dir), 36000.0)


@query(f"WITH {FRAMES} SELECT segment, arg_max(frame_id, {{'t': t, 'f': frame_id}}) FILTER (moment = 'before') AS before, arg_max(frame_id, {{'t': t, 'f': frame_id}}) FILTER (moment = 'after') AS after, coalesce(string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY t, frame_id) FILTER (moment = 'scene'), '') AS scenes FROM fr GROUP BY segment HAVING count_if(moment <> 'scene') > 0")
def ag10_frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.frame_groups(_frames(spark, sf_dir)).withColumn("scenes", F.array_join(F.transform("scenes", lambda x: x.cast("string")), ","))


@query(f"""
WITH {FRAMES}, c AS (SELECT * FROM fr WHERE moment = 'scene'), s AS (SELECT * FROM fr WHERE moment = 'before')
SELECT c.segment AS video_id, c.frame_id AS cut_id, arg_min(s.frame_id, {{'d': abs(c.t - s.t), 'f': s.frame_id}}) AS segment FROM c LEFT JOIN s ON s.segment = c.segment GROUP BY 1, 2""")
def jo9_nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO9: each scene frame and the nearest `before` frame of its segment."""
    f = _frames(spark, sf_dir)
    cuts = f.where("moment = 'scene'").select(F.col("segment").alias("video_id"), F.col("frame_id").alias("cut_id"), "t")
    return steps.nearest_segment(cuts, f.where("moment = 'before'").select(F.col("segment").alias("video_id"), F.col("frame_id").alias("segment"), F.col("t").alias("center")))


@query("SELECT event_id, greatest(0, least(greatest(0, t - 2), greatest(0, d - 0.05))) AS before_t, CASE WHEN least(greatest(0, t + 3), greatest(0, d - 0.05)) - least(greatest(0, t - 2), greatest(0, d - 0.05)) >= 4 THEN least(greatest(0, t + 3), greatest(0, d - 0.05)) END AS after_t FROM (SELECT event_id, value AS t, hour(ts) * 10.0::DOUBLE + minute(ts) AS d FROM events)")
def wi11_frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI11: the value of an event as a step's time, its hour and minute as a duration."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("t"), (F.hour("ts") * 10.0 + F.minute("ts")).alias("duration"))
    return steps.frame_times(e, 2.0, 3.0, 4.0).select("event_id", "before_t", "after_t")


@query("""
WITH d AS (SELECT user_id AS video_id, event_id AS position, CASE WHEN event_id % 3 = 0 THEN event_type END AS status, CASE WHEN event_id % 5 = 0 THEN value END AS score FROM events)
SELECT video_id, arg_max(status, position) FILTER (status IS NOT NULL) AS status, arg_max(score, position) FILTER (score IS NOT NULL) AS score FROM d GROUP BY video_id""")
def jo15_replay_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO15: events as partial decisions on their user, in the order of their ids."""
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("score"))
    return steps.replay(d, ("status", "score"), ("video_id",))


@query(f"WITH {STEPS}, c AS (SELECT video_id, step_number, CASE WHEN flag = 'R' THEN 'X' END AS flag FROM st WHERE mode = 'left') SELECT st.video_id, st.step_number, coalesce(c.flag, st.flag) AS flag FROM st LEFT JOIN c USING (video_id, step_number)")
def jo13_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO12, JO13, JO14."""
    s = _steps(spark, sf_dir).select("video_id", "step_number", "flag", "mode")
    c = s.where("mode = 'left'").withColumn("flag", F.when(F.col("flag") == "R", "X"))
    return steps.write_back(s, c, ("flag",)).select("video_id", "step_number", "flag")


@query(f"""
WITH {STEPS}, m AS (SELECT * FROM f WHERE mode = 'left'),
r AS (SELECT video_id, step_number, CASE WHEN flag = 'A' THEN 'low' ELSE risk END AS risk, CASE WHEN step_number = 3 THEN 'x' ELSE 'h' END AS h, CASE flag WHEN 'R' THEN 'incorrect' WHEN 'A' THEN 'correct' ELSE 'unsure' END AS decision FROM f WHERE mode = 'left' AND step_number < 6 OR step_number = 7),
j AS (SELECT coalesce(m.video_id, r.video_id) AS video_id, coalesce(m.step_number, r.step_number) AS step_number, m.video_id IS NOT NULL AS im, r.video_id IS NOT NULL AS ir, m.risk AS mr, r.risk AS rr, h, decision FROM m FULL JOIN r ON m.video_id = r.video_id AND m.step_number = r.step_number)
SELECT video_id, step_number, unnest(list_filter([CASE WHEN NOT ir THEN 'missing' END, CASE WHEN NOT im THEN 'unexpected' END, CASE WHEN im AND ir AND h <> 'h' THEN 'hash' END, CASE WHEN im AND ir AND mr <> rr THEN 'risk' END, CASE WHEN im AND ir AND decision NOT IN ('correct', 'incorrect') THEN 'decision' END, CASE WHEN im AND ir AND decision = 'incorrect' THEN 'note' END], lambda x: x IS NOT NULL)) AS problem FROM j""")
def fi20_review_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI20, FI21, SO5, JO21."""
    f = _findings(spark, sf_dir)
    m = f.where("mode = 'left'").withColumn("proposal_hash", F.lit("h"))
    r = f.where("mode = 'left' AND step_number < 6 OR step_number = 7").select(
        "video_id", "step_number", F.when(F.col("flag") == "A", "low").otherwise(F.col("risk")).alias("risk"), F.when(F.col("step_number") == 3, "x").otherwise("h").alias("proposal_hash"),
        F.when(F.col("flag") == "R", "incorrect").when(F.col("flag") == "A", "correct").otherwise("unsure").alias("decision"), F.lit("").alias("note"))
    return steps.check_results(m, r)


@query(f"WITH {STEPS}, m AS (SELECT flag || mode AS metric, CAST(quantity AS DOUBLE) AS baseline, CAST(quantity + 1000 * discount AS DOUBLE) AS proposal FROM st) SELECT metric, round(avg(baseline), 4) AS baseline, round(avg(proposal), 4) AS proposal, round(avg(proposal) - avg(baseline), 4) AS delta, count(*) AS n FROM m GROUP BY metric")
def ag23_calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23."""
    s = _steps(spark, sf_dir)
    return steps.calibration_summary(s.select(F.concat("flag", "mode").alias("metric"), F.col("quantity").alias("baseline"), (F.col("quantity") + 1000 * F.col("discount")).alias("proposal")))
