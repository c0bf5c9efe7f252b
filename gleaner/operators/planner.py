"""Query planning: a batch of questions with their history becomes a table of plans, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import question_fold, squeeze, strip
from gleaner.functions.text import has_term
from gleaner.operators import vocabulary as v


def last_user_question(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with `previous`: the last user text that is not blank before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when((F.col("role") == "user") & (strip(F.col("text")) != ""), strip(F.col("text")))
    return turns.withColumn("previous", F.last(own, ignorenulls=True).over(w))


def recent(turns: DataFrame, exchanges: int) -> DataFrame:
    """The last 2 x exchanges user and assistant turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    talk = turns.where(F.col("role").isin("user", "assistant"))
    return talk.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * exchanges).drop("_r")


def _word(c: Column, pattern: str) -> Column:
    return c.rlike(rf"(?U)\b(?:{pattern})\b")


def route(folded: Column, used_history: Column) -> Column:
    software, hotel, policy = (has_term(folded, t) for t in (v.SOFTWARE_TERMS, v.HOTEL_TERMS, v.POLICY_TERMS))
    steps = _word(folded, v.BOTH_STEPS)
    return (
        F.when(policy & steps, "both").when(software & hotel & (policy | used_history | steps), "both").when(software & policy, "both")
        .when(software, "software").when(hotel | policy, "hotel").otherwise("both")
    )


def plan(questions: DataFrame) -> DataFrame:
    """questions(question, previous, ...) with the columns of their plans."""
    q = questions.withColumn("original_question", squeeze(F.col("question")))
    q = q.withColumn("used_history", F.coalesce(F.col("previous") != "", F.lit(False)) & _word(question_fold(F.col("original_question")), v.REFERENCES))
    again = F.concat(F.lit(v.PREVIOUS), F.col("previous"), F.lit("\n" + v.CURRENT), F.col("original_question"))
    q = q.withColumn("standalone_question", F.when(F.col("used_history"), again).otherwise(F.col("original_question")))
    q = q.withColumn("_f", question_fold(F.col("standalone_question")))
    f = F.col("_f")
    aliases = F.array_compact(F.array(*[F.when(_word(f, p), F.lit(x)) for p, x in v.ALIASES]))
    q = q.withColumns({"aliases": aliases, "route": route(f, F.col("used_history")), "sensitive": has_term(f, v.SENSITIVE_TERMS)})
    how = _word(f, "comment") & ~_word(f, v.DIFFERENCE)
    named = f.rlike("|".join(v.PROCEDURE_TERMS))
    q = q.withColumns({
        "retrieval_query": F.when(F.size("aliases") > 0, F.concat("standalone_question", F.lit("\n" + v.EQUIVALENTS), F.array_join("aliases", "; "))).otherwise(F.col("standalone_question")),
        "domain_filter": F.when(F.col("route") != "both", F.col("route")),
        "explicit_support_required": F.col("sensitive") & has_term(f, v.SUPPORT_TERMS),
        "procedural_detail": F.col("route").isin("software", "both") & (how | named),
        "excluded_subtopics": F.when(_word(f, v.OUTSIDER) & ~_word(f, v.NOISE), F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>")),
    })
    return q.withColumn("max_chunks_per_source", F.when(F.col("procedural_detail"), 5)).drop("_f")
