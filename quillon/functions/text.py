"""Scalar text expressions: classification, titles, fact and decision extraction. All JVM-side.

Lengths and costs count UTF-8 bytes. Truncated text is cut by characters, so that it stays
valid UTF-8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.schemas import CONSTRAINT_WORDS, DECISION_LINE, DECISION_RECORD, LASTING_ERRORS, LEXICON, STANDALONE, TRANSIENT_ERRORS

CAP = 16


def token_count(text: Column) -> Column:
    """Bytes over four, rounded down (F1)."""
    return F.shiftright(F.octet_length(F.coalesce(text, F.lit(""))).cast("long"), 2)


def message_tokens(messages: Column) -> Column:
    """Tokens of array<struct<role, content>>: 3 more for each message and for the request (F2)."""
    return F.aggregate(messages, F.lit(3).cast("long"), lambda s, m: s + token_count(m["role"]) + token_count(m["content"]) + 3)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def contains_any(text: Column, words) -> Column:
    """Any of the words as a substring, in lower case."""
    return any_of([F.lower(text).contains(w.lower()) for w in words])


def classify(event_type: Column, payload: Column, constraint_words=CONSTRAINT_WORDS) -> Column:
    """Node type of an event."""
    return (
        F.when(event_type == "user_prompt", F.when(F.coalesce(contains_any(payload, constraint_words), F.lit(False)), "constraint").otherwise("goal"))
        .when(event_type == "tool_call", "attempt")
        .when(event_type == "tool_result", "tool_result")
        .when(event_type == "llm_response", "decision")
        .when(event_type.isin("error", "retry"), "issue")
        .otherwise("background")
    )


def truncate(text: Column, n: int) -> Column:
    """Texts of more than n bytes: the first n characters and three dots."""
    return F.when(F.octet_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def title(event_type: Column, payload: Column) -> Column:
    return F.concat(F.lit("["), event_type, F.lit("] "), truncate(payload, 80))


def summary(payload: Column) -> Column:
    return truncate(payload, 500)


def embedding_payload(title_: Column, summary_: Column, payload: Column) -> Column:
    """What a node is embedded by (P5)."""
    t, s = F.nullif(title_, F.lit("")), F.nullif(summary_, F.lit(""))
    return F.coalesce(F.concat(t, F.lit(": "), s), s, t, payload)


def event_type_of_role(role: Column) -> Column:
    return F.when(role == "assistant", "llm_response").otherwise("user_prompt")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dedupe(items: Column, cap: int = CAP) -> Column:
    """Trimmed, no empties, first spelling of what is equal but for case, at most cap."""
    clean = F.filter(F.transform(items, trimmed), lambda x: x != "")
    kept = F.aggregate(clean, F.array().cast("array<string>"), lambda got, x: F.when(F.exists(got, lambda y: F.lower(y) == F.lower(x)), got).otherwise(F.concat(got, F.array(x))))
    return F.slice(kept, 1, cap)


def lexicon_refs(text: Column, lexicon=LEXICON, standalone=STANDALONE) -> Column:
    """Names of the lexicon in their own spelling, then standalone tokens as first written."""
    names = F.filter(F.array(*(F.lit(x) for x in lexicon)), lambda x: F.contains(F.lower(text), F.lower(x)))
    alone = F.array(*(F.regexp_extract(text, rf"(?i)(?<![A-Za-z0-9_])({x})(?![A-Za-z0-9_])", 1) for x in standalone))
    return F.concat(names, F.filter(alone, lambda x: x != ""))


def user_facts(text: Column, lexicon=LEXICON, standalone=STANDALONE) -> Column:
    """Decision lines, names on each line, then all decision-record numbers."""

    def of_line(line: Column) -> Column:
        line = trimmed(line)
        found = F.regexp_extract(line, DECISION_LINE, 1)
        return F.concat(F.when((F.lower(line).startswith("decision")) & (found != ""), F.array(found)).otherwise(F.array().cast("array<string>")), lexicon_refs(line, lexicon, standalone))

    return dedupe(F.concat(F.flatten(F.transform(F.split(text, "\n"), of_line)), F.regexp_extract_all(text, F.lit(DECISION_RECORD), 1)))


def first_sentence(text: Column) -> Column:
    """Up to the first line's end, or the first full stop after more than 30 bytes; at most 220 characters."""
    whole = trimmed(text)
    line = F.regexp_extract(whole, r"^([^\n]*)\n", 1)
    has_line = whole.contains("\n")
    # what full stops before a space or the end close, joined until it is long enough
    closed = F.split(whole, r"\.(?=[ \n]|\z)")
    closed = F.slice(closed, 1, F.size(closed) - 1)

    def join(a: Column, x: Column) -> Column:
        joined = F.when(a["done"], a["text"]).when(a["first"], x).otherwise(F.concat(a["text"], F.lit("."), x))
        return F.struct(joined.alias("text"), (a["done"] | (F.octet_length(trimmed(joined)) > 30)).alias("done"), F.lit(False).alias("first"))

    found = F.aggregate(closed, F.struct(F.lit("").alias("text"), F.lit(False).alias("done"), F.lit(True).alias("first")), join)
    stop = F.when(found["done"], trimmed(found["text"])).otherwise(whole)
    return F.left(F.when(has_line, trimmed(line)).otherwise(stop), F.lit(220))


def assistant_decisions(text: Column) -> Column:
    """What lines that start with "noted" say, else the first sentence."""

    def of_line(line: Column) -> Column:
        rest = F.when(line.contains(":"), F.substring(line, F.position(F.lit(":"), line) + 1, F.length(line))).when(F.lower(line).startswith("noted -"), F.substring(line, F.lit(8), F.length(line))).otherwise(line)
        return trimmed(rest)

    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: F.lower(x).startswith("noted"))
    found = F.filter(F.transform(lines, of_line), lambda x: (x != "") & (F.lower(x) != "noted"))
    return dedupe(F.when(F.size(found) > 0, found).otherwise(F.array(first_sentence(text))))


def extract(event_type: Column, payload: Column, lexicon=LEXICON, standalone=STANDALONE) -> tuple[Column, Column]:
    """(facts, decisions) of an event."""
    none = F.array().cast("array<string>")
    blank = F.coalesce(trimmed(payload) == "", F.lit(True))
    facts = F.when(blank, none).when(event_type == "user_prompt", user_facts(payload, lexicon, standalone)).otherwise(dedupe(lexicon_refs(payload, lexicon, standalone)))
    return facts, F.when(~blank & (event_type == "llm_response"), assistant_decisions(payload)).otherwise(none)


def facts_prefix(facts: Column) -> Column:
    """Verbatim facts before a summary."""
    return F.when(F.size(facts) > 0, F.concat(F.lit("Verified facts (verbatim): "), F.array_join(facts, ", "), F.lit("\n\n"))).otherwise("")


def entities_line(text: Column) -> tuple[Column, Column]:
    """(body, names) of a text whose last line starts with ENTITIES:."""
    whole = trimmed(text)
    lines = F.split(whole, "\n")
    last = trimmed(F.element_at(lines, -1))
    has = F.lower(last).startswith("entities:")
    body = trimmed(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    names = dedupe(F.split(F.substring(last, F.lit(10), F.length(last)), ","))
    return F.when(has, body).otherwise(whole), F.when(has, names).otherwise(F.array().cast("array<string>"))


def prompt_hash(text: Column) -> Column:
    return F.when(text == "", "empty").otherwise(F.left(F.sha2(text, 256), F.lit(16)))


def encoding_for_model(model: Column) -> Column:
    """Vocabulary of a model's name."""
    return F.when((model == "") | model.rlike("^(gpt-4o|gpt-5|o1|o3|o4)"), "o200k_base").otherwise("cl100k_base")


def is_transient(message: Column) -> Column:
    """Whether a failed call may be tried again; false without a message."""
    has = lambda words: any_of([F.contains(message, F.lit(w)) for w in words])
    return F.coalesce(has(TRANSIENT_ERRORS) & ~has(LASTING_ERRORS), F.lit(False))


def is_reasoning_model(model: Column) -> Column:
    return model.rlike("^(o1|o3|gpt-5)")


def preview(text: Column, n: int) -> Column:
    """The first n characters and how many more there are."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("... ("), (F.length(text) - n).cast("string"), F.lit(" more)"))).otherwise(text)
