"""Ticket text as column expressions: everything here runs inside the JVM."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv

WORDS = r"[\p{L}\p{N}_]{2,}"


def model_text(channel: Column, product: Column, subject: Column, body: Column) -> Column:
    return F.concat(F.lit("CHANNEL_"), channel, F.lit(" PRODUCT_"), F.replace(product, F.lit(" "), F.lit("_")), F.lit(" "),
                    F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def ticket_text() -> Column:
    return model_text(F.col("channel"), F.col("product"), F.col("subject"), F.col("body"))


def lcs_length(word: Column, target: str) -> Column:
    """Longest common subsequence with a short literal, one row of the table per character of `word`."""
    chars = F.array(*[F.lit(ch) for ch in target])
    m = len(target)

    def step(row: Column, ch: Column) -> Column:
        grown = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.greatest(
            F.get(row, j), F.when(j > 0, F.get(row, j - 1)).otherwise(0) + (F.get(chars, j) == ch).cast("int")))
        return F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: F.array_max(F.slice(grown, 1, j)))

    letters = F.filter(F.split(word, ""), lambda x: x != "")
    final = F.aggregate(letters, F.array(*[F.lit(0)] * m), step)
    return F.element_at(final, m)


def lcs_ratio(word: Column, target: str) -> Column:
    """0..100: share of characters kept when only insertions and deletions are counted."""
    return 200.0 * lcs_length(word, target) / (F.length(word) + len(target))


def severity(body: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL with typing errors forgiven; UNK if unreadable, NONE if no tag."""
    word = F.lower(F.regexp_extract(body, fv.SEVERITY_PATTERN, 1))
    scores = [lcs_ratio(word, lvl) for lvl in fv.SEVERITY_LEVELS]
    best = F.greatest(*scores)
    hit = F.coalesce(*[F.when(s == best, lvl.upper()) for s, lvl in zip(scores, fv.SEVERITY_LEVELS)])
    return F.when(word == "", "NONE").when(best >= fv.SEVERITY_CUTOFF, hit).otherwise("UNK")


def body_content(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), fv.SEVERITY_PREFIX, ""))


def normalise_sentence(s: Column, products: list[str] = ()) -> Column:
    s = F.lower(s)
    for p in sorted(products, key=len, reverse=True):
        s = F.replace(s, F.lit(p.lower()), F.lit("<product>"))
    for pattern, token in ((fv.EMAIL_PATTERN, "<email>"), (fv.ID_PATTERN, "<id>"), (fv.USER_PATTERN, "<user>"),
                           (fv.NUMBER_PATTERN, "<num>")):
        s = F.regexp_replace(s, "(?U)" + pattern, token)
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.btrim(s, F.lit(fv.STRIP_CHARACTERS))


def sentences(body: Column, products: list[str] = ()) -> Column:
    parts = F.split(body, fv.SENTENCE_SPLIT)
    return F.filter(F.transform(parts, lambda x: normalise_sentence(x, products)), lambda x: x != "")


def expand_slang(body: Column) -> Column:
    s = F.lower(body)
    for pattern, word in fv.SLANG:
        s = F.regexp_replace(s, "(?U)" + pattern, word)
    return F.regexp_replace(s, r"(?U)\s+", " ")


def squeeze(text: Column) -> Column:
    """The lookup key of a name: single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def one_hot(value: Column, vocabulary: list[str]) -> Column:
    """0/1 per vocabulary entry; all zero for an unseen or missing value."""
    return F.array(*[F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary])


# ---------------------------------------------------------------- counterfactual edits

def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\](){}*+?^$|])", r"\\\1", text)


def phrase_pattern(phrases: list[str], *raw: str) -> str:
    """Any of the phrases, the closing full stop optional, case ignored."""
    return "(?i)" + "|".join([f"(?:{_quote(p.rstrip('.'))}\\.?)" for p in phrases] + [f"(?:{r})" for r in raw])


def match_case(sample: Column, text: str) -> Column:
    return F.when(sample == F.lower(sample), text.lower()).otherwise(text)


def replace_first(body: Column, pattern: str, text: str) -> Column:
    """The body with the first hit replaced; missing when nothing matches."""
    hit = F.regexp_substr(body, F.lit(pattern))
    at = F.regexp_instr(body, F.lit(pattern))
    return F.when(hit.isNotNull(), F.concat(F.substring(body, F.lit(1), at - 1), match_case(hit, text),
                                            F.substring(body, at + F.length(hit), F.length(body))))


def append_if_absent(body: Column, pattern: str, text: str) -> Column:
    return F.when(~body.rlike("(?i)" + pattern), F.concat(F.rtrim(body), F.lit(" "), match_case(body, text)))


def edit(name: str, body: Column) -> Column:
    """One of the named edits; missing where it does not apply."""
    if name == "scope_up":
        return replace_first(body, phrase_pattern(fv.LOW_SCOPE), fv.EDIT_TEXT[name])
    if name == "scope_down":
        return replace_first(body, phrase_pattern(fv.HIGH_SCOPE), fv.EDIT_TEXT[name])
    if name == "environment_down":
        return replace_first(body, phrase_pattern(fv.PRODUCTION, fv.PRODUCTION_PATTERN), fv.EDIT_TEXT[name])
    if name in fv.EDIT_ABSENT:
        return append_if_absent(body, fv.EDIT_ABSENT[name], fv.EDIT_TEXT[name])
    level = F.lower(F.regexp_extract(body, fv.TAG_PATTERN, 1))
    tag = "[Customer-selected severity: {}]"
    swap = lambda to: F.concat(
        F.substring(body, F.lit(1), F.regexp_instr(body, F.lit(fv.TAG_PATTERN)) - 1), F.lit(tag.format(to)),
        F.substring(body, F.regexp_instr(body, F.lit(fv.TAG_PATTERN)) + F.length(F.regexp_substr(body, F.lit(fv.TAG_PATTERN))),
                    F.length(body)))
    if name == "tag_low_to_critical":
        return F.when(level.startswith("lo"), swap("Critical"))
    if name == "tag_critical_to_low":
        return F.when(level.startswith("cri"), swap("Low"))
    if name == "tag_add_critical":
        return F.when(~body.rlike(fv.TAG_PATTERN), F.concat(F.lit(tag.format("Critical") + " "), body))
    raise KeyError(name)


EDITS = ["scope_up", "scope_down", "environment_down", "workaround", "tone_only", "tag_low_to_critical",
         "tag_critical_to_low", "tag_add_critical", "urgency_claim"]
