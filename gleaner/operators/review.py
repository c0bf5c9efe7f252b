"""Drafts and reviews of steps: guards over recorded model outputs, measured policy, batch validation, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import calibration_tokens, keyframe_key, label_tokens, spatial_terms
from gleaner.functions.text import same_prefix, stable_id, token_f1
from gleaner.operators.set_search import nearest_sets
from gleaner.operators.steps import KEY

# Patterns of what a screen description or a spoken phrase may say.
ACTION_DESCRIPTION = r"(?i)\b(?:cliquez?|saisissez?|selectionnez?|sélectionnez?|l'utilisateur|va |permet de|pour modifier|pour ouvrir)\b"
GENERIC_LABEL = r"(?i)^(?:le |la |un |une |l')?(?:bouton|date|icone|icône|reservation existante|réservation existante)\b"
DATE_LABEL = r"^\d{1,2}(?:[/.-]\d{1,4}){0,2}$"
DATE_CUE = r"(?i)\b(?:date|jour|arrivee|arrivée|depart|départ)\b"
EXPLICIT_ACTION = (
    r"(?i)\b(?:cliquez|cliquer|selectionnez|sélectionnez|selectionner|sélectionner|saisissez|saisir|tapez|taper|ouvrez|ouvrir|appuyez|appuyer|survolez|survoler|choisissez|choisir|rendez-vous|"
    r"allez|modifiez|modifier|annulez|annuler|supprimez|supprimer|transferez|transférez|transferer|transférer|ajoutez|ajouter|affichez|afficher)\b"
)
UNSURE_REASONS = {
    "description": "description d'action au lieu d'un etat visible", "generic": "element UI reformule au lieu d'un libelle exact", "date": "date visible sans rapport avec la cible prononcee",
    "label": "libelle visible sans correspondance avec la phrase prononcee", "action": "aucune action explicite dans la phrase prononcee",
}
SCREEN_FIELDS = ("screen_name", "ui_element", "location", "action_type", "expected_result", "visual_description")
MEASURED, RESTORED = ("action_type", "action_target", "action_location", "screen_before", "visual_description"), ("instruction", "screen_after", "screenshot_before", "supporting_screenshots", "screenshot_after", "confident", "quality_flags")

blank = lambda c: F.coalesce(c, F.lit("")) == ""


def action_segments(segments: DataFrame, cues: tuple[str, ...], text: str = "text") -> DataFrame:
    """Of each video the segments that name an action; all of them if none does."""
    key = keyframe_key(F.col(text))
    hit = F.lit(False)
    for cue in cues:
        hit = hit | F.contains(key, keyframe_key(F.lit(cue)))
    x = segments.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    some = x.groupBy("video_id").agg(F.max("_hit").alias("_any"))
    return x.join(some, "video_id").where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def cue_matches(words: Column, cues: tuple[str, ...], duration: Column, start: Column, least: int = 3, most: int = 6, delay: float = 0.15) -> Column:
    """The details that a phrase shows one after another: array of struct(position, cue, t), at most `most`.

    words is an array of struct(text, start, end) in order, its texts folded. Each timed word takes the
    first cue in it that no word before has taken; fewer than `least` matches are none.
    """
    empty = F.array().cast("array<struct<position:int,cue:string,t:double>>")
    listed = F.array(*map(F.lit, cues))

    def add(acc: Column, w: Column) -> Column:
        taken = F.transform(acc["found"], lambda x: x["cue"])
        cue = F.try_element_at(F.filter(listed, lambda c: F.contains(w["text"], c) & ~F.array_contains(taken, c)), F.lit(1))
        t = F.least(F.greatest(F.lit(0.0), duration - 0.05), F.greatest(start, (w["start"] + w["end"]) / 2 + delay))
        hit = w["start"].isNotNull() & w["end"].isNotNull() & cue.isNotNull()
        one = F.struct(acc["at"].alias("position"), cue.alias("cue"), t.alias("t"))
        return F.struct((acc["at"] + 1).alias("at"), F.when(hit, F.array_append(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(words, F.struct(F.lit(0).alias("at"), empty.alias("found")), add, lambda acc: acc["found"])
    return F.when(F.size(found) >= least, F.slice(found, 1, most)).otherwise(empty)


def trusted(analysis: Column) -> Column:
    """An analysis of a screen, its six statements null unless it is confident."""
    sure = F.coalesce(analysis["confident"], F.lit(False))
    for f in SCREEN_FIELDS:
        analysis = analysis.withField(f, F.when(sure, analysis[f]))
    return analysis


def semantic_guard(rows: DataFrame, spoken: str = "spoken") -> DataFrame:
    """rows(spoken, ui_element, location, action_type, expected_result, visual_description, confident, uncertainty_reason) without what no visible fact supports.

    The expected result always goes; every rule that applies leaves its reason, and any takes the confidence.
    """
    said, element = F.coalesce(F.col(spoken), F.lit("")), F.coalesce("ui_element", F.lit(""))
    acted = F.coalesce(F.col("visual_description").rlike(ACTION_DESCRIPTION), F.lit(False))
    digits = F.regexp_replace(F.trim(element), r"([.\-/])", r"\\$1")
    near = F.expr("regexp_like(_said, concat('(?<![0-9])', _digits, '(?![0-9])'))")
    x = rows.withColumns({"_said": said, "_digits": digits})
    generic = (element != "") & element.rlike(GENERIC_LABEL)
    date = (element != "") & F.trim(element).rlike(DATE_LABEL) & ~near & ~said.rlike(DATE_CUE)
    label = (element != "") & ~date & ~F.coalesce(same_prefix(label_tokens(element), label_tokens(said), 5), F.lit(False))
    idle = F.col("action_type").isNotNull() & (F.col("action_type") != "none") & ~said.rlike(EXPLICIT_ACTION)
    tests = {"description": acted, "generic": generic, "date": date, "label": label, "action": idle}
    x = x.withColumns({f"_{k}": v for k, v in tests.items()})
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(UNSURE_REASONS[k])) for k in tests]))
    unsure, gone = F.size(reasons) > 0, F.col("_date") | F.col("_label")
    out = x.withColumns({
        "uncertainty_reason": F.when(unsure, F.substring(F.array_join(F.concat(F.array_compact(F.array(F.nullif("uncertainty_reason", F.lit("")))), reasons), "; "), 1, 500)).otherwise(F.col("uncertainty_reason")),
        "confident": F.col("confident") & ~unsure, "expected_result": F.lit(None).cast("string"), "visual_description": F.when(~F.col("_description"), F.col("visual_description")),
        "ui_element": F.when(~gone, F.col("ui_element")), "location": F.when(~gone, F.col("location")), "action_type": F.when(F.col("_action"), "none").otherwise(F.col("action_type")),
    })
    return out.drop("_said", "_digits", *[f"_{k}" for k in tests])


def opposing(a: Column, b: Column) -> Column:
    """Whether two texts together name both of a pair of directions."""
    both = F.array_union(spatial_terms(a), spatial_terms(b))
    has = lambda x, y: F.array_contains(both, x) & F.array_contains(both, y)
    return has("left", "right") | has("top", "bottom")


def guard_draft(drafts: DataFrame) -> DataFrame:
    """Drafts of steps without what the spoken text and trusted screens do not support; each removal leaves a flag.

    drafts has spoken, before_trusted, after_trusted, any_trusted, labels (what the trusted screens name),
    visual_location (the first one that they give), and the draft's fields.
    """
    said, evidence = F.coalesce("spoken", F.lit("")), F.concat_ws(" ", F.coalesce("spoken", F.lit("")), F.coalesce("labels", F.lit("")))
    target = ~blank(F.col("action_target")) & ~F.coalesce(same_prefix(label_tokens(F.col("action_target")), label_tokens(evidence), 5), F.lit(False))
    kind = F.col("action_type").isNotNull() & (F.col("action_type") != "none") & ~said.rlike(EXPLICIT_ACTION)
    x = drafts.withColumns({"_target": target, "_kind": kind}).withColumn("_place", F.when(~F.col("_target"), F.nullif("action_location", F.lit(""))))
    seen = ~blank(F.col("visual_location"))
    conflict, unseen = seen & F.col("_place").isNotNull() & opposing(F.col("_place"), F.col("visual_location")), ~seen & F.col("_place").isNotNull()
    x = x.withColumns({"_conflict": F.coalesce(conflict, F.lit(False)), "_unseen": F.coalesce(unseen, F.lit(False))})
    flags = F.array(F.when(F.col("_target"), "unsupported_action_target"), F.when(F.col("_kind"), "unsupported_action_type"), F.when(F.col("_conflict"), "audio_visual_location_conflict"), F.when(F.col("_unseen"), "missing_visual_location"))
    place = F.when(seen & (F.col("_place").isNull() | F.col("_conflict")), F.col("visual_location")).when(~F.col("_unseen"), F.col("_place"))
    out = x.withColumns({
        "quality_flags": F.array_sort(F.array_distinct(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array_compact(flags)))),
        "instruction": F.when(F.col("_target"), F.trim(said)).otherwise(F.col("instruction")), "action_target": F.when(~F.col("_target"), F.col("action_target")),
        "action_type": F.when(F.col("_kind"), "none").otherwise(F.col("action_type")), "action_location": F.when(F.col("any_trusted"), place), "visual_description": F.when(F.col("any_trusted"), F.col("visual_description")),
        "before_state": F.when(F.col("before_trusted"), F.col("before_state")), "after_state": F.when(F.col("after_trusted"), F.col("after_state")), "confident": F.col("confident") & F.col("before_trusted") & F.col("after_trusted"),
    })
    return out.drop("_target", "_kind", "_place", "_conflict", "_unseen")


def automatic_flags(before: Column, after: Column) -> Column:
    """Flags of the screens before and after a step, struct(confident, ui_element) or null for none."""
    no_label = blank(before["ui_element"]) & blank(after["ui_element"])
    return F.array_compact(F.array(
        F.when(before.isNull(), "missing_before_frame"), F.when(after.isNull(), "missing_after_frame"), F.when(before.isNotNull() & ~F.coalesce(before["confident"], F.lit(False)), "uncertain_before_visual"),
        F.when(after.isNotNull() & ~F.coalesce(after["confident"], F.lit(False)), "uncertain_after_visual"), F.when(no_label, "missing_exact_ui_label"),
    ))


def final_confidence(draft: Column, visual: Column, flags: Column) -> Column:
    return F.coalesce(draft & visual & (F.size(flags) == 0), F.lit(False))


def assemble(groups: DataFrame, drafts: DataFrame) -> DataFrame:
    """Guarded steps, renumbered, from groups(video_id, segment, t, spoken, before, after) and drafts(video_id, segment, ...); a group without a draft is left out."""
    x = groups.join(drafts, ["video_id", "segment"])
    sure = lambda c: F.coalesce(F.col(c)["confident"], F.lit(False))
    x = x.withColumns({
        "before_trusted": sure("before"), "after_trusted": sure("after"), "any_trusted": sure("before") | sure("after"),
        "labels": F.concat_ws(" ", F.when(sure("before"), F.col("before.ui_element")), F.when(sure("after"), F.col("after.ui_element"))),
        "visual_location": F.coalesce(F.when(sure("before"), F.nullif("before.location", F.lit(""))), F.when(sure("after"), F.nullif("after.location", F.lit("")))),
    })
    x = guard_draft(x).withColumn("quality_flags", F.array_sort(F.array_union("quality_flags", automatic_flags(F.col("before"), F.col("after")))))
    x = x.withColumn("confident", final_confidence(F.col("confident"), F.col("any_trusted"), F.col("quality_flags")))
    w = Window.partitionBy("video_id")
    return x.withColumns({"step_number": F.row_number().over(w.orderBy("t", "segment")), "total_steps": F.count(F.lit(1)).over(w).cast("int")})


def frame_paths(before: Column, supporting: Column, after: Column) -> Column:
    """The frames of a step in order, each once."""
    some = F.concat(F.array(before), F.coalesce(supporting, F.array().cast("array<string>")), F.array(after))
    return F.array_distinct(F.filter(some, lambda x: ~blank(x)))


def step_document(steps: DataFrame) -> DataFrame:
    """Canonical documents of steps: what to do, the screens before and after, the evidence and its frames."""
    act = F.concat(F.lit("Action : "), F.coalesce(F.nullif("action_type", F.lit("")), F.lit("action")), F.lit(" sur "), "action_target")
    act = F.when(~blank(F.col("action_target")), F.concat(act, F.when(~blank(F.col("action_location")), F.concat(F.lit(" ("), "action_location", F.lit(")"))).otherwise("")))
    line = lambda name, c: F.when(~blank(F.col(c)), F.concat(F.lit(name), F.col(c)))
    shots = frame_paths(F.col("screenshot_before"), F.col("supporting_screenshots"), F.col("screenshot_after"))
    return steps.select(
        stable_id(F.col("video_id"), F.concat(F.lit("step"), "step_number")).alias("id"),
        F.concat_ws("\n", "instruction", act, line("Ecran de depart : ", "screen_before"), line("Resultat : ", "screen_after"), line("Preuve visuelle : ", "visual_description")).alias("content"),
        F.coalesce(F.nullif("video_title", F.lit("")), "procedure").alias("title"), F.concat("procedure", F.lit(" > etape "), "step_number").alias("breadcrumb"), F.lit("software").alias("domain"), F.col("procedure").alias("topic"),
        F.lit("video").alias("source_type"), F.col("video_id").cast("string").alias("source_id"), F.lit("official").alias("authority"), "status", "timestamp_start", "timestamp_end",
        F.try_element_at(shots, F.lit(1)).alias("screenshot"), shots.alias("screenshots"),
    )


def step_constraints() -> dict[str, Column]:
    """For each constraint of a step a test that holds where it is violated."""
    unsigned = blank(F.col("reviewed_by").cast("string")) | blank(F.col("reviewed_at").cast("string"))
    return {"interval": (F.col("timestamp_start") < 0) | (F.col("timestamp_end") < F.col("timestamp_start")), "review": (F.col("status") == "verified") & unsigned}


def normal_draft(drafts: DataFrame) -> DataFrame:
    """drafts(relevant array<int>, result int, n_frames, quality_flags, confident) with frames in range, each once, the result among them."""
    inside = lambda i: (i >= 1) & (i <= F.col("n_frames"))
    result = F.when(inside(F.col("result")), F.col("result"))
    x = drafts.withColumns({"relevant": F.array_distinct(F.filter("relevant", inside)), "result": result})
    x = x.withColumn("relevant", F.when(F.col("result").isNotNull() & ~F.array_contains("relevant", F.col("result")), F.array_append("relevant", F.col("result"))).otherwise(F.col("relevant")))
    flags = F.array_sort(F.array_distinct(F.filter(F.transform("quality_flags", lambda f: F.trim(f)), lambda f: f != "")))
    return x.withColumn("quality_flags", flags).withColumn("confident", F.col("confident") & (F.size("relevant") > 0) & (F.size("quality_flags") == 0))


def draft_frames(relevant: Column, result: Column, frames: Column) -> Column:
    """struct(before, supporting, after): of a draft's frames the first that is no result, the rest, and the result."""
    after = F.when(result.isNotNull(), F.try_element_at(frames, result))
    rest = F.filter(F.transform(relevant, lambda i: F.try_element_at(frames, i)), lambda p: after.isNull() | (p != after))
    return F.struct(F.try_element_at(rest, F.lit(1)).alias("before"), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))).alias("supporting"), after.alias("after"))


def review_frames(screenshots: Column) -> Column:
    """struct(before, after, supporting) of a review item's screenshots(role, source), by role; of two of one role the first."""
    of = lambda role: F.try_element_at(F.filter(screenshots, lambda s: s["role"] == role), F.lit(1))["source"]
    return F.struct(of("avant").alias("before"), of("apres").alias("after"), F.transform(F.filter(screenshots, lambda s: s["role"].startswith("support-")), lambda s: s["source"]).alias("supporting"))


def measured_policy(proposals: DataFrame, originals: DataFrame, measured: tuple[str, ...] = MEASURED, restored: tuple[str, ...] = RESTORED, key: tuple[str, ...] = KEY) -> DataFrame:
    """The proposals' measured fields with all others restored from the originals."""
    return proposals.select(*key, *measured).join(originals.select(*key, *restored), list(key))


def nearest_examples(steps: DataFrame, references: DataFrame, k: int = 3) -> DataFrame:
    """(video_id, step_number, r_video, r_step, f1, rank): the k references whose words are most like a step's, itself left out.

    steps and references(video_id, step_number, tokens); equal ones go by the higher key, and where fewer than k are alike those of
    the highest keys fill up.
    """
    return nearest_sets(steps, references, k, KEY).withColumnsRenamed({"r_video_id": "r_video", "r_step_number": "r_step"})


def comparison(items: DataFrame) -> DataFrame:
    """(key, metric, baseline, proposal): the ten measures of items(original, proposal, gold), structs of a step's fields."""
    o, p, g = (F.col(c) for c in ("original", "proposal", "gold"))
    text = lambda x, f: token_f1(calibration_tokens(x[f]), calibration_tokens(g[f]))
    same = lambda x, f: x[f].eqNullSafe(g[f]).cast("double")
    there = lambda x: (blank(x["screen_after"]) == blank(g["screen_after"])).cast("double")
    shots = lambda x: frame_paths(x["screenshot_before"], x["supporting_screenshots"], x["screenshot_after"])
    measures = {f"{f}_token_f1": (lambda x, f=f: text(x, f)) for f in ("instruction", "action_target", "action_location", "screen_before", "visual_description")}
    measures |= {
        "action_type_exact": lambda x: same(x, "action_type"), "evidence_frame_f1": lambda x: token_f1(shots(x), shots(g)), "screenshot_after_exact": lambda x: same(x, "screenshot_after"),
        "after_state_presence_exact": there, "after_state_token_f1": lambda x: text(x, "screen_after"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), f(o).alias("baseline"), f(p).alias("proposal")) for n, f in measures.items()])
    return items.select(*KEY, F.explode(rows).alias("x")).select(*KEY, "x.*")


def resolutions_errors(incorrect: DataFrame, resolutions: DataFrame, known: tuple[str, ...], key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, problem): incorrect keys without a resolution, foreign or repeated ones, such as are not minor or unknown."""
    n = resolutions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max("severity").alias("severity"), F.max("resolution").alias("resolution"))
    x = incorrect.select(*key).distinct().withColumn("_i", F.lit(True)).join(n, list(key), "full")
    problem = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_i").isNull(), "unexpected"), F.when(F.col("_n") > 1, "repeated"),
        F.when(F.col("_n").isNotNull() & ~F.col("severity").eqNullSafe(F.lit("minor")), "severity"), F.when(F.col("_n").isNotNull() & ~F.coalesce(F.col("resolution").isin(*known), F.lit(False)), "resolution"),
    ))
    return x.select(*key, F.explode(problem).alias("problem"))


def repeated_keys(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate_batch(steps: DataFrame, proposals: DataFrame, exceptions: DataFrame, resolutions: DataFrame, reviewer: str, reviewed_at: str, batch: str, fields: tuple[str, ...] = MEASURED, key: tuple[str, ...] = KEY) -> DataFrame:
    """Steps under review, without those of exceptions, verified as one batch: proposals' fields applied, minor issues resolved.

    A resolved step keeps its original description and first frame; its last frame becomes a supporting one.
    """
    todo = steps.where("status = 'review_required'").join(exceptions.select(*key).distinct(), list(key), "left_anti")
    p = proposals.select(*key, *[F.col(f).alias(f"_p_{f}") for f in fields], F.col("model").alias("validation_model"), F.lit(True).alias("_p"))
    x = todo.join(p, list(key), "left").join(resolutions.select(*key, F.lit(True).alias("_r")).distinct(), list(key), "left")
    resolved, taken = F.col("_r").isNotNull(), F.col("_p").isNotNull()
    shots = F.coalesce("supporting_screenshots", F.array().cast("array<string>"))
    moved = F.when(~blank(F.col("screenshot_after")) & ~F.array_contains(shots, F.col("screenshot_after")), F.array_append(shots, F.col("screenshot_after"))).otherwise(shots)
    kept = {f: F.when(taken & ~(resolved & F.lit(f == "visual_description")), F.col(f"_p_{f}")).otherwise(F.col(f)) for f in fields}
    x = x.withColumns(kept | {"supporting_screenshots": F.when(resolved, moved).otherwise(F.col("supporting_screenshots")), "screenshot_after": F.when(~resolved, F.col("screenshot_after")), "calibrated": taken})
    return x.withColumns({"status": F.lit("verified"), "reviewed_by": F.lit(reviewer), "reviewed_at": F.lit(reviewed_at), "validation_method": F.lit("batch_sampled"), "validation_batch_id": F.lit(batch)}).drop("_p", "_r", *[f"_p_{f}" for f in fields])


def batch_report(results: DataFrame, validated: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: the sample's size, correct and incorrect ones, and what became of the population."""
    a = results.agg(F.count(F.lit(1)).alias("sample"), F.count_if(F.col("decision") == "correct").alias("correct"), F.count_if(F.col("decision") == "incorrect").alias("minor_corrections"))
    b = validated.agg(F.count(F.lit(1)).alias("eligible"), F.count_if("calibrated").alias("calibrated"), F.count_if(~F.col("calibrated")).alias("kept_original"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(exceptions.agg(F.count(F.lit(1)).alias("pending_exceptions"))))  # one row each


def update_errors(steps: DataFrame, updates: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, problem) of updates(status, reviewer, override): unknown steps and states, verified without a reviewer, flagged without an override."""
    x = updates.join(steps.select(*key, F.size("quality_flags").alias("_f")).withColumn("_s", F.lit(True)), list(key), "left")
    verified = F.col("status") == "verified"
    problem = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "unknown_step"), F.when(~F.coalesce(F.col("status").isin("draft", "review_required", "verified", "deprecated"), F.lit(False)), "status"),
        F.when(verified & blank(F.trim("reviewer")), "reviewer"), F.when(verified & (F.col("_f") > 0) & ~F.coalesce("override", F.lit(False)), "flagged"),
    ))
    return x.select(*key, F.explode(problem).alias("problem"))


def review_sample(sample: DataFrame, suggestions: DataFrame, steps: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The sampled steps with their suggestions; those whose step is missing have the error `step`, without a suggestion `suggestion`."""
    s = steps.select(*key, F.col("instruction").alias("original_instruction"), F.lit(True).alias("_s"))
    p = suggestions.where(F.col("status").isin("proposal_only", "error")).select(*key, F.col("instruction").alias("proposed_instruction"), F.lit(True).alias("_p"))
    x = sample.join(s, list(key), "left").join(p, list(key), "left")
    return x.withColumn("error", F.when(F.col("_s").isNull(), "step").when(F.col("_p").isNull(), "suggestion")).drop("_s", "_p")


def export_verified(steps: DataFrame) -> DataFrame:
    """The documents of verified steps, renumbered inside their video by start and number, ordered by source, start and id."""
    w = Window.partitionBy("video_id")
    x = steps.where("status = 'verified'").withColumns({"_n": F.row_number().over(w.orderBy("timestamp_start", "step_number")), "total_steps": F.count(F.lit(1)).over(w).cast("int")})
    return step_document(x.withColumn("step_number", F.col("_n")).drop("_n")).orderBy("source_id", "timestamp_start", "id")

