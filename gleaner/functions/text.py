"""Ids, hashes, similarity and parsing as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.folding import slug

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_id(source: Column, key: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of `source::key`."""
    return F.substring(F.sha1(F.concat_ws("::", source, key.cast("string"))), 1, 16)


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def video_id(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(slug(name), F.lit("-"), F.substring(F.sha1(path), 1, 10))


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def pixel_budget(frames: Column, total: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(total) / F.greatest(frames, F.lit(1))).cast("int")))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0)
        .otherwise(2.0 * both / (F.size(a) + F.size(b)))
    )


def same_prefix(a: Column, b: Column, n: int = 5) -> Column:
    """Whether any two tokens have the same first n characters, or are the same if they are shorter."""
    heads = lambda x: F.transform(x, lambda t: F.substring(t, 1, n))
    return F.arrays_overlap(heads(a), heads(b))


def has_term(c: Column, terms: tuple[str, ...]) -> Column:
    """Whole words; a trailing * allows any ending."""
    alternatives = "|".join(_quoted(t[:-1]) if t.endswith("*") else rf"{_quoted(t)}(?![\p{{L}}\p{{N}}_])" for t in terms)
    return c.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})")


def _quoted(term: str) -> str:
    return "".join(x if x.isalnum() or x == " " else "\\" + x for x in term)


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def cited(answer: Column) -> Column:
    """The numbers n of all [n], in order; -1 for one that no integer holds."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def uncited_steps(answer: Column) -> Column:
    """Whether a numbered line has no [n] of its own."""
    lines = F.filter(F.split(answer, "\n"), lambda x: x.rlike(r"^\s*\d+[.)]\s+\S"))
    return F.exists(lines, lambda x: ~x.rlike(r"\[\d+\]"))


def citations_valid(answer: Column, hits: Column, abstained: Column) -> Column:
    n = cited(answer)
    return abstained | ((F.size(n) > 0) & F.forall(n, lambda i: (i >= 1) & (i <= hits)) & ~uncited_steps(answer))


def single_source(answer: Column) -> Column:
    """Every [n] becomes [1]; one is added to a body that does not end with one."""
    out = F.regexp_replace(answer, r"\[\d+\]", "[1]")
    return F.when(out.rlike(r"\[1\]\s*[.!?]?\s*$"), out).otherwise(F.concat(F.rtrim(out), F.lit(" [1]")))


def json_object(c: Column) -> Column:
    """From the first { to the last }; empty if there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def question_time(question: Column) -> Column:
    """Minutes of the first time written like 14h30 or 14h."""
    h = F.regexp_extract(F.lower(question), r"(\d{1,2})\s*h\s*(\d{2})?", 1)
    m = F.regexp_extract(F.lower(question), r"(\d{1,2})\s*h\s*(\d{2})?", 2)
    return F.when(h == "", None).otherwise(h.try_cast("int") * 60 + F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0)))


def late_checkout_fee(minutes: Column) -> Column:
    """15 for each started hour after 11:00 up to 13:00; then 30 and 20 for each started hour up to 17:00."""
    return (
        F.when((minutes > 660) & (minutes <= 780), F.ceil((minutes - 660) / 60) * 15)
        .when((minutes > 780) & (minutes <= 1020), 30 + F.ceil((minutes - 780) / 60) * 20).cast("bigint")
    )


def portable_path(c: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^" + _quoted(root.rstrip("/")) + "/", "")


def portal_url(base: Column, query: Column) -> Column:
    return F.concat(base, F.lit("?"), query)


def iso_date(c: Column) -> Column:
    """The ISO form of a date or timestamp; a time of midnight is a date alone."""
    t = c.cast("timestamp")
    return F.when(F.date_trunc("day", t) == t, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))


def source_identity(source_id: Column) -> Column:
    """One name for a source that was renamed: its question's number, or what follows the mark of the lexicon."""
    faq = F.regexp_extract(source_id, r"^(?:generic_software|software)-faq-(\d+)$", 1)
    at = F.locate("lexique-hotelier-", source_id)  # fixed value
    return F.when(faq != "", F.concat(F.lit("faq-"), faq)).when(at > 0, F.substr(source_id, at)).otherwise(source_id)
