"""Post-processing of recorded answers: citations, verifier outputs, guardrails, focus and final gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import citations_valid, cited, clock, json_object, late_checkout_fee, question_time, single_source, uncited_steps

#: Fixed value: the sentence by which an answer abstains, looked for as it stands.
ABSTENTION = "Je ne dispose pas d'une information verifiee dans la base de connaissances permettant de repondre a cette question."


def abstained(answer: Column) -> Column:
    return F.contains(F.coalesce(answer, F.lit("")), F.lit(ABSTENTION))


def clean_prefix(answer: Column) -> Column:
    return F.regexp_replace(F.ltrim(answer), r"(?i)^(?:answer|réponse|reponse)\s*:\s*", "")


def _parsed(decision: Column, body: Column, declared: Column, n_hits: Column) -> Column:
    """struct(text, decision) of a verifier's decision, its answer and the sources that it declares."""
    text, own = clean_prefix(body), cited(body)
    sources = F.when(F.size(declared) > 0, declared).otherwise(own)
    wrong = (F.coalesce(F.trim(body), F.lit("")) == "") | (F.size(sources) == 0) | F.exists(F.concat(sources, own), lambda i: (i < 1) | (i > n_hits)) | uncited_steps(body)
    marks = F.array_join(F.transform(sources, lambda i: F.concat(F.lit("["), i, F.lit("]"))), " ")
    attached = F.when(F.size(own) > 0, text).otherwise(F.concat(F.rtrim(text), F.lit(" "), marks, F.lit("\n\nSources\n"), marks))
    made = lambda t, d: F.struct(t.alias("text"), F.lit(d).alias("decision"))
    return F.when(decision == "abstain", made(F.lit(None).cast("string"), "abstain")).when((decision != "supported") | wrong, made(F.lit(None).cast("string"), "invalid_format")).otherwise(made(attached, "supported"))


def _numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def tagged_decision(output: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(output, F.lit("")), r"(?i)<decision>\s*(supported|abstain)\s*</decision>", 1))


def parse_verifier(output: Column, n_hits: Column) -> Column:
    """struct(text, decision) of a verifier's output: tags first, then a JSON object, fenced or not.

    supported needs an answer whose cited and declared sources are among the hits and whose numbered
    steps have citations of their own; declared sources are attached to a text that cites none. The text
    is null for abstain and invalid_format.
    """
    raw = F.coalesce(output, F.lit(""))
    decision = tagged_decision(raw)
    body = F.regexp_extract(raw, r"(?is)<answer>\s*(.*?)\s*</answer>", 1)
    json = F.from_json(json_object(raw), "decision string, answer string, sources array<string>")
    listed = F.transform(F.filter(F.coalesce(json["sources"], F.array().cast("array<string>")), lambda x: x.rlike(r"^\s*\d+\s*$")), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(-1)))
    tagged = _parsed(decision, body, _numbers(F.regexp_extract(raw, r"(?is)<sources>\s*(.*?)\s*</sources>", 1)), n_hits)
    loose = _parsed(F.coalesce(F.lower(F.trim(json["decision"])), F.lit("")), F.coalesce(json["answer"], F.lit("")), listed, n_hits)
    return F.when(decision != "", tagged).otherwise(loose)


def parse_decision(output: Column, draft: Column, n_hits: Column) -> Column:
    """struct(text, decision) where a verifier only decides on a draft: both must name sources among the hits."""
    decision, declared, own = tagged_decision(output), _numbers(F.regexp_extract(F.coalesce(output, F.lit("")), r"(?is)<sources>\s*(.*?)\s*</sources>", 1)), cited(draft)
    wrong = (F.size(declared) == 0) | (F.size(own) == 0) | F.exists(F.concat(declared, own), lambda i: (i < 1) | (i > n_hits)) | uncited_steps(draft)
    made = lambda t, d: F.struct(t.alias("text"), F.lit(d).alias("decision"))
    none = F.lit(None).cast("string")
    return F.when(decision == "abstain", made(none, "abstain")).when((decision != "supported") | wrong, made(none, "invalid_format")).otherwise(made(clean_prefix(draft), "supported_decision_only"))


def verify(runs: DataFrame) -> DataFrame:
    """runs(draft, n_hits, first, review, retry, decide) with what its recorded outputs come to: text, decision, calls.

    An abstention over a draft that is cited as it must be is reviewed once, if there is more than one
    hit; an output without form is asked for again, then for a decision alone. A review without form
    leaves the abstention.
    """
    n = F.col("n_hits")
    out = runs.withColumns({k: parse_verifier(F.col(c), n) for k, c in (("_1", "first"), ("_2", "review"), ("_3", "retry"))}).withColumn("_4", parse_decision(F.col("decide"), F.col("draft"), n))
    own = cited(F.col("draft"))
    sound = ~abstained(F.col("draft")) & (F.size(own) > 0) & F.forall(own, lambda i: (i >= 1) & (i <= n)) & ~uncited_steps(F.col("draft"))
    again = (F.col("_1.decision") == "abstain") & (n > 1) & sound
    fine = lambda k: F.col(f"{k}.decision") != "invalid_format"
    made = F.when(again & fine("_2"), F.col("_2")).when(fine("_1"), F.col("_1")).when(fine("_3"), F.col("_3")).otherwise(F.col("_4"))
    calls = F.when(again, 2).when(fine("_1"), 1).when(fine("_3"), 2).otherwise(3)
    return out.withColumns({"text": made["text"], "decision": made["decision"], "calls": calls}).drop("_1", "_2", "_3", "_4")


def conflict_reason(question: Column, hits: Column) -> Column:
    """Why hits(source_id, content) can't prove a question though they are near it; null if they may."""
    # fixed values: the two sources and what the questions that they don't answer speak of
    arrivals = F.exists(hits, lambda h: (h["source_id"] == "software-faq-118") & h["content"].rlike(r"(?i)liste des arriv[ée]es"))
    early = F.exists(hits, lambda h: h["source_id"] == "hotel-services-001")
    hour = F.regexp_extract(question, r"(?i)(?<!\d)(\d{1,2})\s*h(?:\s*(\d{1,2}))?", 1).try_cast("int")
    minute = F.coalesce(F.regexp_extract(question, r"(?i)(?<!\d)(\d{1,2})\s*h(?:\s*(\d{1,2}))?", 2).try_cast("int"), F.lit(0))
    return F.when(question.rlike(r"(?i)\b(?:departures|liste des départs)\b") & arrivals, "document_conflict").when(
        question.rlike(r"(?i)petit[ -]?d[ée]jeuner|breakfast") & early & (hour * 60 + minute < 420), "unsupported_time")


def guardrails(question: Column, hits: Column, texts: dict[str, str]) -> Column:
    """The reminders that a question and its hits(source_id, domain) call for, a line each; null for none.

    texts has `fee`, with {fee}, `room_move` and `no_show`, with {hotel} and {software} for the places of
    the hits that prove the two sides; a reminder needs both.
    """
    at = lambda test: F.array_position(F.transform(hits, lambda h: F.when(test(h), 1).otherwise(0)), 1)
    filled = lambda text, names: F.concat(*[names[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", text))])
    charge = late_checkout_fee(question_time(question))
    out = [F.when(question.rlike(r"(?i)d[ée]part|check[ -]?out") & charge.isNotNull(), filled(texts["fee"], {"fee": charge.cast("string")}))]
    sides = {
        # fixed values: the sources of the two sides of a move during a stay
        "room_move": (r"(?is)\bclim(?:atisation)?.*changer\s+le\s+client\s+de\s+chambre\b", at(lambda h: h["source_id"] == "hotel-reservations-005"), at(lambda h: h["source_id"] == "software-faq-128")),
        "no_show": (r"(?i)\bno[ -]?show\b", at(lambda h: h["domain"] == "hotel"), at(lambda h: h["domain"] == "software")),
    }
    for name, (pattern, hotel, software) in sides.items():
        out.append(F.when(question.rlike(pattern) & (hotel > 0) & (software > 0), filled(texts[name], {"hotel": hotel.cast("string"), "software": software.cast("string")})))
    return F.nullif(F.concat_ws("\n", *out), F.lit(""))


def citation(d: Column) -> Column:
    """The line that names a document: a video with its time, an internal procedure, or documentation with its pages."""
    name = F.coalesce(F.nullif(d["title"], F.lit("")), d["source_id"])
    software = F.coalesce(d["software"], F.lit(""))
    page = F.when((d["page_end"].isNull()) | (d["page_end"] == d["page_start"]), F.concat(F.lit(" (p. "), d["page_start"], F.lit(")"))).otherwise(F.concat(F.lit(" (p. "), d["page_start"], F.lit("-"), d["page_end"], F.lit(")")))
    return (
        F.when((d["source_type"] == "video") & d["timestamp_start"].isNotNull(), F.concat(F.lit("Tutoriel "), software, F.lit(" - "), name, F.lit(" ("), clock(d["timestamp_start"]), F.lit(")")))
        .when(d["source_type"] == "internal_sop", F.concat(F.lit("Procedure interne - "), name))
        .otherwise(F.trim(F.concat(F.lit("Documentation "), software, F.lit(" - "), name, F.coalesce(page, F.lit("")))))
    )


def user_message(question: Column, context_: Column, plan: dict[str, Column], texts: dict[str, str], guardrail: Column) -> Column:
    """The message that asks for an answer: constraints of the plan, excerpts, the question, reminders.

    plan has route, sensitive, explicit and procedural; texts the words for each, with {route} and
    {question} where they stand.
    """
    bullets = lambda *xs: F.concat(F.lit("\n- "), F.array_join(F.array_compact(F.array(*xs)), "\n- "))
    asks = [F.concat(F.lit(texts["route"]), plan["route"]), F.when(plan["sensitive"], texts["sensitive"]), F.when(plan["explicit"], texts["explicit"])]
    reminders = [F.when(plan["procedural"], texts["procedural"]), F.when(plan["route"] == "both", texts["both"]), guardrail, F.when(~plan["procedural"], texts["short"])]
    full = F.concat(F.lit(texts["constraints"]), bullets(*asks), F.lit("\n\n" + texts["excerpts"] + "\n\n"), context_, F.lit("\n\n---\n\n" + texts["question"]), question, F.lit("\n\n" + texts["reminders"]), bullets(*reminders))
    return F.when(context_.isNull(), F.concat(F.lit(texts["question"]), question, F.lit("\n\n" + texts["nothing"]))).otherwise(full)


def verification_message(question: Column, context_: Column, draft: Column, plan: dict[str, Column], texts: dict[str, str], guardrail: Column) -> Column:
    """The message that asks for a check of a draft: risks, excerpts, question, draft, final checks."""
    yes = lambda c: F.when(c, texts["yes"]).otherwise(texts["no"])
    checks = F.array_compact(F.array(F.when(plan["procedural"], texts["procedural"]), F.when(plan["route"] == "both", texts["both"]), F.when(guardrail.isNotNull(), F.concat(F.lit(texts["guardrail"]), guardrail)), F.lit(texts["last"])))
    return F.concat(
        F.lit(texts["sensitive"]), yes(plan["sensitive"]), F.lit("\n" + texts["explicit"]), yes(plan["explicit"]), F.lit("\n\n" + texts["excerpts"] + "\n\n"), context_,
        F.lit("\n\n---\n\n" + texts["question"] + "\n"), question, F.lit("\n\n---\n\n" + texts["draft"] + "\n"), draft, F.lit("\n\n" + texts["checks"] + "\n- "), F.array_join(checks, "\n- "))


def gate(answers: DataFrame) -> DataFrame:
    """answers(answer, n_hits) with what the final gate makes of each: decision, text, and the numbers it cites.

    No hits or an abstention abstain; a single hit repairs the citations; what then is not cited as it
    must be is rejected.
    """
    a = answers.withColumn("_raw", clean_prefix(F.col("answer")))
    a = a.withColumn("text", F.when((F.col("n_hits") == 1) & ~abstained(F.col("_raw")), single_source(F.col("_raw"))).otherwise(F.col("_raw")))
    out = abstained(F.col("text"))
    fine = citations_valid(F.col("text"), F.col("n_hits"), out)
    decision = F.when(F.col("n_hits") == 0, "no_hits").when(out, "abstain").when(~fine, "invalid_citation").otherwise("supported")
    return a.withColumns({"decision": decision, "cited": F.array_sort(F.array_distinct(cited(F.col("text")))), "steps_without_source": uncited_steps(F.col("text"))}).drop("_raw")


def fee(questions: DataFrame, question: str = "question") -> DataFrame:
    t = question_time(F.col(question))
    return questions.withColumns({"minutes": t, "fee": late_checkout_fee(t)})


def focus(hits: DataFrame) -> DataFrame:
    """hits(query_id, rank, source_id, source_type, domain, title, content, question, route, procedural) that a coherent answer may use.

    A software procedure keeps its best hit's source; a software question about a difference keeps it if
    it is a question document; a mixed procedure keeps the hotel's hits and one software source: the
    best, for a no-show the longest that speaks of it, question documents first, and for a move of rooms
    the longest whose title says so. All others keep all hits.
    """
    w = Window.partitionBy("query_id")
    software = F.col("domain") == "software"
    first = F.min(F.struct("rank", "source_id", "source_type")).over(w)
    no_show = software & (F.col("title").rlike(r"(?i)no[ -]?show") | F.col("content").rlike(r"(?i)no[ -]?show"))
    size = F.length("content")
    best = lambda test, *by: F.max(F.when(test, F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], (-F.col("rank")).alias("r"), F.col("source_id").alias("s")))).over(w)["s"]
    asks = lambda pattern: F.col("question").rlike(pattern)
    x = hits.withColumns({
        "_f": first, "_s": F.min(F.when(software, F.struct("rank", "source_id"))).over(w)["source_id"], "_n": best(no_show, (F.col("source_type") == "qa").cast("int"), size),
        "_m": best(software & F.col("title").rlike(r"(?i)\bd[ée]plac"), size),
    })
    chosen = F.coalesce(F.when(asks(r"(?i)\b(?:clim(?:atisation)?|changer\s+le\s+client\s+de\s+chambre)\b"), F.col("_m")), F.when(asks(r"(?i)\bno[ -]?show\b"), F.col("_n")), F.col("_s"))
    one = (F.col("route") == "software") & (F.col("procedural") | (asks(r"(?i)\b(?:difference|différence)\b") & (F.col("_f.source_type") == "qa")))
    mixed = (F.col("route") == "both") & F.col("procedural") & F.col("_s").isNotNull()
    keep = F.when(one, F.col("source_id") == F.col("_f.source_id")).when(mixed, (F.col("domain") == "hotel") | (F.col("source_id") == chosen)).otherwise(F.lit(True))
    return x.where(keep).drop("_f", "_s", "_n", "_m")


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): numbered blocks of each question's hits(rank, citation, breadcrumb, content), by rank."""
    head = F.concat_ws("\n", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("citation")), F.nullif(F.col("breadcrumb"), F.lit("")), F.regexp_replace("content", r"(?i)\[\s*page\s+(\d+)\s*\]", "(page $1)"))
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("b")))).alias("x"))
    return packed.select("query_id", F.array_join(F.transform("x", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def missing_groups(groups: Column, found: Column) -> Column:
    """The groups of sources of which none was found."""
    return F.filter(groups, lambda g: ~F.arrays_overlap(g, found))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """improved, regressed and unchanged cases of two reports(id, passed), over the ids of both."""
    x = before.select("id", F.col("passed").alias("a")).join(after.select("id", F.col("passed").alias("b")), "id")
    return x.agg(F.count_if(~F.col("a") & F.col("b")).alias("improved"), F.count_if(F.col("a") & ~F.col("b")).alias("regressed"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"))
