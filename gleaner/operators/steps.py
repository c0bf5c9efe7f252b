"""Records of procedural steps: frames and transcripts, audits, sampling, human review and its write-back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import phrase_key

KEY = ("video_id", "step_number")
RISKS = {"critical": 100, "high": 10, "medium": 3, "low": 0}


def thin(frames: DataFrame, gap: float, by: str = "segment", t: str = "t", tie: str = "frame_id") -> DataFrame:
    """Frames that lie at least `gap` after the last kept frame of their segment, in time order.

    A task reads its segments sorted and remembers the last kept time alone, however long a segment is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, last = None, 0.0
        for b in batches:
            at, kept = b["t"].to_numpy(), []
            ends = np.append(np.flatnonzero(np.diff(pd.factorize(b["by"])[0])) + 1, len(b)) if len(b) else []
            start = 0
            for end in ends:
                own = b["by"].iloc[start]
                i = start if own != segment else start + int(np.searchsorted(at[start:end], last + gap - 1e-9))
                while i < end:
                    kept.append(i)
                    last = at[i]
                    i = i + 1 + int(np.searchsorted(at[i + 1 : end], last + gap - 1e-9))
                segment, start = own, end
            yield b.iloc[kept][["by", "tie"]]

    rows = frames.select(F.col(by).alias("by"), F.col(t).cast("double").alias("t"), F.col(tie).cast("bigint").alias("tie"))
    kind = f"by {frames.schema[by].dataType.simpleString()}, tie long"
    return rows.repartition("by").sortWithinPartitions("by", "t", "tie").mapInPandas(run, kind).select(F.col("by").alias(by), F.col("tie").alias(tie))


def nearest_segment(cuts: DataFrame, segments: DataFrame, by: str = "video_id") -> DataFrame:
    """cuts(by, cut_id, t) with the segment of segments(by, segment, center) nearest in time, ties to the lowest.

    Both are ordered in one pass by video and time; the neighbours before and after are the candidates,
    so no pair of a cut and another segment is formed.
    """
    c = cuts.select(by, "t", "cut_id", F.lit(None).cast("bigint").alias("segment"))
    s = segments.select(by, F.col("center").alias("t"), F.lit(None).cast("bigint").alias("cut_id"), F.col("segment").cast("bigint").alias("segment"))
    # of segments with one centre the lowest is the only candidate
    s = s.groupBy(by, "t").agg(F.min("segment").alias("segment")).select(by, "t", F.lit(None).cast("bigint").alias("cut_id"), "segment")
    own = F.when(F.col("segment").isNotNull(), F.struct("t", "segment"))
    back = Window.partitionBy(by).orderBy("t", F.col("segment").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("t", F.col("segment").isNotNull().cast("int")).rowsBetween(0, Window.unboundedFollowing)
    x = c.unionByName(s).withColumns({"_b": F.last(own, ignorenulls=True).over(back), "_a": F.first(own, ignorenulls=True).over(ahead)})
    far = lambda p: F.struct(F.abs(F.col("t") - p["t"]).alias("d"), p["segment"].alias("s"))
    near = F.array_min(F.array_compact(F.array(F.when(F.col("_b").isNotNull(), far(F.col("_b"))), F.when(F.col("_a").isNotNull(), far(F.col("_a"))))))
    return x.where("cut_id IS NOT NULL").select(by, "cut_id", near["s"].alias("segment"))


def frame_groups(frames: DataFrame) -> DataFrame:
    """Per segment the last `before` and `after` frame and the list of others in order; segments with neither are dropped."""
    at = F.struct("t", "frame_id")
    last = lambda m: F.max(F.when(F.col("moment") == m, at))["frame_id"]
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("moment").isin("scene", "detail"), at))), lambda x: x["frame_id"])
    g = frames.groupBy("segment").agg(last("before").alias("before"), last("after").alias("after"), others.alias("scenes"))
    return g.where("before IS NOT NULL OR after IS NOT NULL")


def frame_times(steps: DataFrame, before: float, after: float, least: float) -> DataFrame:
    """before_t and after_t around a step, inside [0, duration - 0.05]; after_t only if far enough from before_t."""
    end = F.greatest(F.lit(0.0), F.col("duration") - 0.05)
    b, a = F.least(F.greatest(F.lit(0.0), F.col("t") - before), end), F.least(F.greatest(F.lit(0.0), F.col("t") + after), end)
    return steps.withColumns({"before_t": b, "after_t": F.when(a - b >= least, a)})


def renumber(steps: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """step_number and total_steps anew, by start, old number and, where these repeat, the columns `ties`."""
    w = Window.partitionBy("video_id")
    return steps.withColumns({"total_steps": F.count(F.lit(1)).over(w).cast("int"), "step_number": F.row_number().over(w.orderBy("timestamp_start", "step_number", *ties))})


def sequence_issues(steps: DataFrame, order: tuple[str, ...] = ("position",)) -> DataFrame:
    """(video_id, sequence_issues): the kinds of issue of each video's steps in file order, each kind once however often it occurs.

    non_contiguous_step_numbers: they aren't 1, 2, 3 and so on; non_monotonic_timestamps: a start lies before the one
    above it; inconsistent_total_steps: a total_steps, if there is that column, isn't their number.
    """
    video = Window.partitionBy("video_id")
    w = video.orderBy(*order)
    x = steps.withColumns({"_n": F.row_number().over(w), "_p": F.lag("timestamp_start").over(w)})
    kinds = {"non_contiguous_step_numbers": F.max(F.col("_n") != F.col("step_number")), "non_monotonic_timestamps": F.max(F.col("timestamp_start") < F.col("_p"))}
    if "total_steps" in steps.columns:
        kinds["inconsistent_total_steps"] = (F.min("total_steps") != F.count(F.lit(1))) | (F.max("total_steps") != F.count(F.lit(1)))
    return x.groupBy("video_id").agg(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in kinds.items()])).alias("sequence_issues"))


def risk(missing_asset: Column, invalid: Column, conflict: Column, uncertain: Column, status: Column) -> Column:
    return (
        F.when(missing_asset | invalid, "critical").when(status.isin("verified", "deprecated"), "low").when(conflict, "high").when(uncertain, "medium").otherwise("low")
    )


def findings(steps: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """steps with issues (sorted), missing_assets, flag_categories (sorted) and risk.

    steps has frames (array), instruction, perhaps spoken_instruction, action_type, action_target, timestamp_end, duration, status,
    confident and quality_flags (array); assets(path) are the files that exist, all of them if it is None.
    """
    rows = steps
    if assets is not None:
        known = assets.select(F.col("path").alias("_f")).distinct()
        there = steps.select(*KEY, F.explode("frames").alias("_f")).join(known, "_f", "left_anti").groupBy(*KEY).agg(F.array_sort(F.collect_set("_f")).alias("_gone"))
        rows = steps.join(there, list(KEY), "left")
    else:
        rows = steps.withColumn("_gone", F.lit(None).cast("array<string>"))
    gone = F.coalesce("_gone", F.array().cast("array<string>"))
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    said = [c for c in ("instruction", "spoken_instruction") if c in steps.columns]
    broken = F.contains(F.concat(*[F.coalesce(c, F.lit("")) for c in said]), F.lit("\ufffd"))
    none, target, late = F.size("frames") == 0, F.col("action_type").isin(*TARGET_ACTIONS) & blank("action_target"), F.coalesce(F.col("timestamp_end") > F.col("duration") + 1.0, F.lit(False))
    issues = F.concat(
        F.transform(gone, lambda x: F.concat(F.lit("missing_asset:"), x)), F.transform(flags, lambda x: F.concat(F.lit("quality_flag:"), x)),
        F.array_compact(F.array(F.when(none, "no_screenshot"), F.when(target, "missing_action_target"), F.when(blank("instruction"), "empty_instruction"), F.when(broken, "invalid_replacement_character"), F.when(late, "timestamp_outside_video"))),
    )
    # flags are categorised by themselves: a fold of each different one, not of each step's
    kinds = rows.select(F.explode(flags).alias("flag")).distinct().withColumn("kind", flag_category(F.col("flag")))
    own = rows.select(*KEY, F.explode(flags).alias("flag")).join(kinds, "flag").groupBy(*KEY).agg(F.array_sort(F.collect_set("kind")).alias("flag_categories"))
    x = rows.join(own, list(KEY), "left").withColumns({"flag_categories": F.coalesce("flag_categories", F.array().cast("array<string>")), "issues": F.array_sort(F.array_distinct(issues)), "missing_assets": F.size(gone)})
    conflict = none | target | late | F.arrays_overlap("flag_categories", F.array(F.lit("audio_visual_conflict"), F.lit("unsupported_action_target")))
    unsure = ~F.col("confident") | (F.size(F.array_except("flag_categories", F.array(F.lit("no_issue")))) > 0) | (F.size("issues") > 0)
    return x.withColumn("risk", risk(F.col("missing_assets") > 0, broken, conflict, unsure, F.col("status"))).drop("_gone")


#: Actions that need a target, and the words of each class of flags, in order of precedence.
TARGET_ACTIONS = ("click", "type", "select", "hover")
NO_ISSUE = ("aucune information contradictoire ou manquante", "aucune information manquante ou contradictoire")
FLAG_CLASSES = (
    ("audio_visual_conflict", ("conflict", "contradic", "discrepancy", "ne correspond pas", "aucune correspondance", "sans correspondance")),
    ("unsupported_action_target", ("unsupported action target",)),
    ("unsupported_action_type", ("unsupported action type",)),
    ("missing_ui_label", ("missing exact ui label", "libelle exact", "libelle visible", "action target inconnu", "unclear action target", "information manquante action target")),
    ("missing_visual_evidence", ("capture", "screenshot", "preuve visuelle", "description visuelle", "visual description", "ecran", "frame", "image")),
    ("visual_uncertainty", ("uncertain", "incertain", "incertitude", "confident false", "hypothese", "deduit", "inferred")),
    ("missing_information", ("aucun", "aucune", "absence", "missing", "manquant", "incomplet", "non specifie", "non visible")),
)
LACK = ("aucun", "aucune", "absence", "missing", "manquant", "non fourni", "pas visible", "inexist", "null")


def flag_category(flag: Column) -> Column:
    """The first class of FLAG_CLASSES of which a flag holds a word; evidence is missing only if the flag says so too."""
    key = phrase_key(flag)
    out = F.when(key.isin(*NO_ISSUE), "no_issue")
    for name, words in FLAG_CLASSES:
        test = key.rlike("|".join(words))
        out = out.when(test & key.rlike("|".join(LACK)) if name == "missing_visual_evidence" else test, name)
    return out.otherwise("other_quality_warning")


def path_category(path: Column, default: str = "sans_categorie") -> Column:
    """The first part of a relative path."""
    return F.coalesce(F.nullif(F.split_part(F.coalesce(path, F.lit("")), F.lit("/"), F.lit(1)), F.lit("")), F.lit(default))


def audit(findings: DataFrame, issues: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Per video the steps of each risk, its kinds of sequence issue, and the risk score.

    findings(video_id, risk, missing_assets) are the steps that the schema allows, issues the sequence_issues() of these, invalid(video_id, invalid)
    the number of others, which are critical. A video may have invalid steps alone.
    """
    counts = findings.groupBy("video_id").agg(F.count(F.lit(1)).alias("steps"), *[F.count_if(F.col("risk") == r).alias(r) for r in RISKS], F.sum("missing_assets").alias("missing_assets"))
    x = counts.join(issues, "video_id", "left")
    x = x.withColumn("invalid", F.lit(0)) if invalid is None else x.join(invalid.select("video_id", "invalid"), "video_id", "full")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("steps", *RISKS, "missing_assets", "invalid")}
    x = x.withColumns(zero | {"sequence_issues": F.coalesce("sequence_issues", F.array().cast("array<string>"))})
    score = sum((F.col(r) * n for r, n in RISKS.items()), F.lit(0)) + 20 * F.col("missing_assets") + 100 * F.col("invalid") + 25 * F.size("sequence_issues")
    return x.select("video_id", "steps", (F.col("critical") + F.col("invalid")).alias("critical"), *[r for r in RISKS if r != "critical"], "missing_assets", "invalid", "sequence_issues", score.cast("bigint").alias("risk_score"))


def status_counts(steps: DataFrame) -> DataFrame:
    """Per video the steps of each status, and those with flags."""
    known = ("draft", "review_required", "verified", "deprecated")
    return steps.groupBy("video_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in known], F.count_if(F.size("quality_flags") > 0).alias("flagged"))


def flag_frequencies(flags: DataFrame, order: str | None = None) -> DataFrame:
    """(flag, n, rank), the most frequent first; ties by first appearance in the column `order`, or by name."""
    seen = F.min(order) if order else F.min("flag")
    n = flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), seen.alias("_o"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_o", "flag"))).drop("_o")  # a row for each flag


def stratified_sample(findings: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per risk its quota of steps, one of each video in turn; the same seed gives the same sample.

    Videos and steps are ordered by an MD5 of the seed and their key. Each task keeps the largest quota of
    a risk before anything of it is shuffled.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), "risk", F.col("video_id").cast("string")))
    step = F.md5(F.concat_ws(":", F.lit(seed), F.col("video_id").cast("string"), F.col("step_number").cast("string")))
    turn = F.row_number().over(Window.partitionBy("risk", "video_id").orderBy("_s"))
    most = F.create_map(*[F.lit(y) for kv in quotas.items() for y in kv])[F.col("risk")]
    x = findings.where(F.col("risk").isin(*quotas)).withColumns({"_v": key, "_s": step}).withColumn("_turn", turn)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("risk").orderBy("_turn", "_v", "_s"))).where(F.col("rank") <= max(quotas.values()))
    return x.where(F.col("rank") <= most).drop("_v", "_s", "_turn")


def recommended(audits: DataFrame, most: int = 16) -> DataFrame:
    """(video_id, forced) of the videos to review, of those with steps under review.

    audits(video_id, category, steps, duration, critical, missing_assets, risk_score, review_required). Forced are all with critical steps or
    missing assets, the riskiest of each category, the longest and the shortest, and that of most steps; where fewer than `most`
    are, the riskiest of the rest follow. Equal risk goes by steps and then the larger id, the extremes by the smaller id.
    """
    x = audits.where("review_required > 0").withColumn("_o", F.struct("risk_score", "steps", "video_id"))
    ends = x.agg(*[F.min(F.struct(c, "video_id"))["video_id"] for c in (-F.col("duration"), F.col("duration"), -F.col("steps"))]).first()  # three ids
    best = x.groupBy("category").agg(F.max("_o")["video_id"].alias("video_id")).select("video_id", F.lit(True).alias("_b"))
    must = (F.col("critical") > 0) | (F.col("missing_assets") > 0) | F.coalesce("_b", F.lit(False)) | F.coalesce(F.col("video_id").isin(*[v for v in ends if v is not None]), F.lit(False))
    x = x.join(best, "video_id", "left").withColumn("forced", must)
    rest = x.where("NOT forced").orderBy(F.desc("_o")).limit(max(0, most - x.where("forced").count()))
    return x.where("forced").select("video_id", "forced").unionByName(rest.select("video_id", "forced"))


def replay(decisions: DataFrame, fields: tuple[str, ...], key: tuple[str, ...] = KEY, order: str = "position") -> DataFrame:
    """Decisions applied in order: of each field the value of the last decision that sets it."""
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return decisions.groupBy(*key).agg(*last)


def write_back(rows: DataFrame, changes: DataFrame, fields: tuple[str, ...], key: tuple[str, ...] = KEY) -> DataFrame:
    """rows with the fields that changes sets; changes for keys that rows has not are for the caller to reject."""
    c = changes.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    return rows.join(c, list(key), "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def check_results(manifest: DataFrame, results: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, problem): keys that only one side has, other hashes or risks, unknown decisions, notes that are missing."""
    m = manifest.select(*key, F.col("risk").alias("m_risk"), F.col("proposal_hash").alias("m_hash"), F.lit(True).alias("_m"))
    x = m.join(results.withColumn("_r", F.lit(True)), list(key), "full")
    both = F.col("_m") & F.col("_r")
    problem = F.array_compact(F.array(
        F.when(F.col("_r").isNull(), "missing"), F.when(F.col("_m").isNull(), "unexpected"),
        F.when(both & (F.col("proposal_hash") != F.col("m_hash")), "hash"), F.when(both & (F.col("risk") != F.col("m_risk")), "risk"),
        F.when(both & ~F.col("decision").isin("correct", "incorrect"), "decision"),
        F.when(both & (F.col("decision") == "incorrect") & (F.coalesce(F.trim("note"), F.lit("")) == ""), "note"),
    ))
    return x.select(*key, F.explode(problem).alias("problem"))


def proposal_hash(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, no blanks, and nulls, other letters than ASCII as they are."""
    # to_json leaves nulls out, so each value is written by itself
    parts = [F.concat(F.lit(f'"{f}":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.when(F.col(f).isNull(), "null").otherwise("")) for f in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in before]))


def lots(rows: DataFrame, size: int, key: tuple[str, ...] = KEY, by: str = "risk", ranges: int = 256) -> DataFrame:
    """rows with the number of their lot of `size` rows, by the order of the key inside each value of `by`.

    The first column of the key, a number, is cut into ranges of about equal numbers of rows; rows are
    numbered inside their range and the sums of the ranges before are added, so no value of `by` needs a
    task of its own.
    """
    cuts = sorted(set(rows.approxQuantile(key[0], [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    at = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key[0])))
    x = rows.withColumn("_range", at)
    n = x.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))  # `ranges` rows a value
    before = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), "_before")
    x = x.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*key)) + F.col("_before")
    return x.withColumn("lot", F.floor((place - 1) / size).cast("int") + 1).drop("_by", "_r", "_before", "_range")


def calibration_summary(metrics: DataFrame) -> DataFrame:
    """Per metric(metric, baseline, proposal) both means and their difference, rounded from the unrounded means."""
    b, p = F.avg("baseline"), F.avg("proposal")
    return metrics.groupBy("metric").agg(F.round(b, 4).alias("baseline"), F.round(p, 4).alias("proposal"), F.round(p - b, 4).alias("delta"), F.count(F.lit(1)).alias("n"))
