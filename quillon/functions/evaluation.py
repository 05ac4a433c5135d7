"""Answer scoring: matches, abstentions, information per token and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import trimmed

# Phrases by which an answer declines to recall.
ABSTAIN_PHRASES = (
    "i don't have that", "i don't have a ", "i don't have any", "i do not have that", "i do not have a ",
    "don't have that decision", "do not have that decision", "not in the context", "not in the provided context",
    "not in our context", "not in the conversation", "isn't specified", "is not specified", "wasn't specified",
    "was not specified", "not specified in", "not captured", "isn't captured", "is not captured", "not recorded",
    "no decision recorded", "no decision was made", "no decision has been made", "i don't see that", "i don't see a ",
    "i don't see any", "i don't recall", "i do not recall", "not mentioned", "wasn't mentioned", "was not mentioned",
    "can you confirm", "could you confirm", "did we choose", "did we agree", "if we still need to choose",
    "if we haven't decided", "we haven't decided", "haven't picked", "haven't agreed",
)
# Quotation marks and what they are taken for.
QUOTES = "‘’‚‛“”„"
PLAIN_QUOTES = "''''\"\"\""


def ipt(score: Column, tokens: Column) -> Column:
    """Score per thousand prompt tokens; 0 without tokens."""
    return F.when(tokens > 0, score * 1000.0 / F.nullif(tokens, F.lit(0))).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / F.nullif(whole, F.lit(0))).otherwise(0.0)


def verdict(quality_delta: Column, ipt_delta: Column) -> Column:
    """The first that holds."""
    d, i = quality_delta, ipt_delta
    return F.when((d >= -0.5) & (i > 0), "win").when((d < -0.5) & (i > 0), "win-star").when((d > 0.5) & (i < 0), "baseline-win").when(d < -1.0, "loss").otherwise("tie")


def abstains(response: Column) -> Column:
    low = F.lower(F.translate(response, QUOTES, PLAIN_QUOTES))
    return F.exists(F.array(*(F.lit(p) for p in ABSTAIN_PHRASES)), lambda p: F.contains(low, p))


def match_any(response: Column, expected: Column) -> Column:
    return F.when(F.exists(expected, lambda x: (x != "") & F.contains(F.lower(response), F.lower(x))), 5.0).otherwise(0.0)


def match_exact(response: Column, expected: Column) -> Column:
    return F.when(F.exists(expected, lambda x: F.contains(F.lower(trimmed(response)), F.lower(trimmed(x)))), 5.0).otherwise(0.0)


def match_all(response: Column, expected: Column) -> Column:
    n = F.size(expected)
    hits = F.size(F.filter(expected, lambda x: F.contains(F.lower(response), F.lower(x))))
    return F.when(n == 0, 5.0).otherwise(hits * 5.0 / F.nullif(n, F.lit(0)))


def match_regex(response: Column, expected: Column) -> Column:
    """5 for the first pattern that matches, whatever the case."""
    return F.when(F.exists(expected, lambda x: F.call_function("rlike", response, F.concat(F.lit("(?i)"), x))), 5.0).otherwise(0.0)


def match_numeric(response: Column, value: Column, tolerance: Column) -> Column:
    got = F.regexp_extract(response, r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    return F.when(F.abs(got - value) <= F.abs(value * tolerance), 5.0).otherwise(0.0)


def score(match_type: Column, response: Column, expected: Column, value: Column, tolerance: Column, error: Column) -> Column:
    """0 for errors, unknown kinds and blank answers, -1 for the judge; an abstention is worth 0."""
    raw = (
        F.when(match_type == "regex", match_regex(response, expected))
        .when(match_type == "exact", match_exact(response, expected))
        .when(match_type == "contains_all", match_all(response, expected))
        .when(match_type == "contains_any", match_any(response, expected))
        .when(match_type == "numeric", match_numeric(response, value, tolerance))
        .otherwise(0.0)
    )
    held = F.when((raw > 0) & abstains(response), 0.0).otherwise(raw)
    return F.when(F.coalesce(error, F.lit("")) != "", 0.0).when(match_type == "judge", -1.0).when(trimmed(response) == "", 0.0).otherwise(held)


def judge_reply(reply: Column) -> Column:
    """Score of the reply's outermost braces, between 0 and 5; null where there is none."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    found = F.get_json_object(body, "$.score").try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), found)))


def cached_tokens(usage: Column) -> Column:
    return F.coalesce(F.get_json_object(usage, "$.usage.prompt_tokens_details.cached_tokens").try_cast("long"), F.lit(0).cast("long"))


def takeaway(full: Column, managed: Column) -> Column:
    """One of four lines on which side recalled."""
    return F.when(full & managed, "both recalled").when(managed, "managed recalled, full history dropped it").when(full, "full history recalled, managed missed").otherwise("neither recalled")
