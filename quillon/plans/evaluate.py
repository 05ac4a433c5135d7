"""Comparison of strategies: pairs, verdicts, aggregates, latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.evaluation import ipt, percent, verdict
from quillon.operators.selection import exact_percentiles
from quillon.schemas import STRATEGIES, STRATEGY_ALIASES

MOST_STRATEGIES = 100


def pairs(scored: DataFrame, reference: str) -> DataFrame:
    """Each candidate's answer beside the reference's on the same probe.

    scored: scenario_id, probe_id, strategy, score, tokens."""
    side = lambda df, s: df.select("scenario_id", "probe_id", F.col("strategy").alias(f"strategy_{s}"), F.col("score").alias(f"score_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    joined = side(scored.where(F.col("strategy") == reference), "ref").join(side(scored.where(F.col("strategy") != reference), "cand"), ["scenario_id", "probe_id"])
    joined = joined.withColumns({"ipt_ref": ipt(F.col("score_ref"), F.col("tokens_ref")), "ipt_cand": ipt(F.col("score_cand"), F.col("tokens_cand"))})
    joined = joined.withColumns(
        {
            "ipt_delta": F.col("ipt_cand") - F.col("ipt_ref"),
            "ipt_delta_pct": percent(F.col("ipt_cand") - F.col("ipt_ref"), F.col("ipt_ref")),
            "quality_delta": F.col("score_cand") - F.col("score_ref"),
            "token_reduction_pct": percent(F.col("tokens_ref") - F.col("tokens_cand"), F.col("tokens_ref")),
        }
    )
    return joined.withColumn("verdict", verdict(F.col("quality_delta"), F.col("ipt_delta")))


def aggregate_pairs(rows: DataFrame) -> DataFrame:
    """Verdict counts, means and regressions; the IPT change is a ratio of means."""
    out = rows.agg(
        F.count("*").alias("pairs"),
        *(F.count_if(F.col("verdict") == v).alias(n) for v, n in (("win", "wins"), ("win-star", "wins_star"), ("tie", "ties"), ("loss", "losses"), ("baseline-win", "baseline_wins"))),
        F.avg("score_ref").alias("quality_ref"),
        F.avg("score_cand").alias("quality_cand"),
        F.avg("token_reduction_pct").alias("token_reduction_pct"),
        F.avg("ipt_ref").alias("ipt_ref"),
        F.avg("ipt_cand").alias("ipt_cand"),
        F.count_if(F.col("quality_delta") < -1.0).alias("regressions"),
    )
    return out.withColumn("quality_delta", F.col("quality_cand") - F.col("quality_ref")).withColumn("ipt_delta_pct", percent(F.col("ipt_cand") - F.col("ipt_ref"), F.col("ipt_ref")))


def report(rows: DataFrame) -> DataFrame:
    """Pairs in a report's order: scenario, probe, strategy."""
    return rows.orderBy("scenario_id", "probe_id", "strategy_cand")


def aggregate_strategies(scored: DataFrame, reference: str) -> DataFrame:
    """Means of each strategy and its change against the reference's means (A12). The reference side is one row."""
    means = scored.groupBy("strategy").agg(F.count("*").alias("probes"), F.avg("score").alias("quality"), F.avg("tokens").alias("prompt_tokens"), F.avg(ipt(F.col("score"), F.col("tokens"))).alias("ipt"))
    ref = means.where(F.col("strategy") == reference).select(F.col("quality").alias("rq"), F.col("prompt_tokens").alias("rt"), F.col("ipt").alias("ri"))
    both = means.join(F.broadcast(ref), F.lit(True), "left")  # one row by construction
    other = F.col("strategy") != reference
    return both.select(
        "strategy",
        "probes",
        "quality",
        "prompt_tokens",
        "ipt",
        F.when(other & F.col("rq").isNotNull(), F.col("quality") - F.col("rq")).otherwise(0.0).alias("quality_delta"),
        F.when(other, percent(F.col("rt") - F.col("prompt_tokens"), F.col("rt"))).otherwise(0.0).alias("token_reduction_pct"),
        F.when(other, percent(F.col("ipt") - F.col("ri"), F.col("ri"))).otherwise(0.0).alias("ipt_delta_pct"),
    )


def chosen_strategies(asked: DataFrame, by: list[str]) -> DataFrame:
    """by, strategy, place, is_reference of asked (by, place, name): each once, in the order asked, the first as reference.

    Names are taken as written, aliases by their strategy; blank names are passed over, and a
    name that is none of them raises an error."""
    names = STRATEGY_ALIASES | {x: x for x in STRATEGIES}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.trim("name")]
    rows = asked.where(F.trim("name") != "")
    strategy = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown strategy "), "name")).cast("string"))
    rows = rows.select(*by, "place", strategy.alias("strategy")).groupBy(*by, "strategy").agg(F.min("place").alias("place"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("place", "strategy"))
    return rows.withColumn("place", place).withColumn("is_reference", F.col("place") == 1)


def scenario_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario_id", "pipeline").agg(F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.sum("latency_ms").cast("long").alias("latency_ms"))


def percentiles(rows: DataFrame, value: Column, by: list[str], drop_first: int = 0, iteration: str | None = None, error: str | None = None) -> DataFrame:
    """Interpolated p50, p95, p99 after the first iterations and failed rows are dropped."""
    if iteration:
        rows = rows.where(F.col(iteration) >= drop_first)
    if error:
        rows = rows.where(F.coalesce(F.col(error), F.lit("")) == "")
    return exact_percentiles(rows, value, by, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def grid(scenarios: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every probe of every scenario with every strategy; strategies are a short fixed list."""
    names = [r["strategy"] for r in strategies.select("strategy").distinct().limit(MOST_STRATEGIES + 1).collect()]
    if len(names) > MOST_STRATEGIES:
        raise ValueError(f"a grid has at most {MOST_STRATEGIES} strategies")
    return scenarios.withColumn("strategy", F.explode(F.array(*(F.lit(n) for n in names)).cast("array<string>")))


def prompt_stability(turns: DataFrame) -> DataFrame:
    """Byte-stable turns and cached tokens of each session."""
    same = F.lag("prompt").over(Window.partitionBy("session_id").orderBy("turn_number")) == F.col("prompt")
    return turns.withColumn("same", F.coalesce(same, F.lit(False))).groupBy("session_id").agg(F.sum("compiled_tokens").cast("long").alias("compiled"), F.sum("cached_tokens").cast("long").alias("cached"), F.sum(F.when(F.col("turn_number") > 1, F.col("cached_tokens")).otherwise(0)).cast("long").alias("cached_later"), F.count_if("same").alias("stable_turns"))


def prefix_chains(block: int = 64) -> Column:
    """For each block of the column prompt, of `block` characters, a hash of itself and all before it.

    Two prompts have equal chains at a place only if they are equal up to the end of that block."""
    n = F.length("prompt")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda i: F.substring("prompt", i * block + 1, F.lit(block)))
    none = F.array().cast("array<bigint>")
    chain = F.aggregate(blocks, none, lambda held, b: F.concat(held, F.array(F.xxhash64(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0)), b))))
    return F.when(n > 0, chain).otherwise(none)


def prompt_cache(turns: DataFrame, block: int = 64, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """What a cache of prompt prefixes would have spared (A19, W7) of turns (session_id, turn_number, prompt), one row a session (or for each value of `by`).

    blocks of all prompts; kept: those of the stable prefix, the longest that a prompt has in
    common with the turn before; seen: those of the longest prefix that any earlier turn had;
    stable_turns: prompts equal to the one before. Turns are numbered without gaps.

    Only blocks after the stable prefix become rows. Where a chain first stands it is such a row,
    so that an earlier turn has it if it was kept or if it is not the first of these rows."""
    by_turn = Window.partitionBy(*by).orderBy("turn_number")
    rows = turns.select(*by, "turn_number", prefix_chains(block).alias("chains"), F.sha2("prompt", 256).alias("whole"))
    before = F.coalesce(F.lag("chains").over(by_turn), F.array().cast("array<bigint>"))
    rows = rows.withColumns({"before": before, "same": F.coalesce(F.lag("whole").over(by_turn) == F.col("whole"), F.lit(False))})
    common = F.size(F.filter(F.zip_with("chains", "before", lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x))
    rows = rows.select(*by, "same", F.size("chains").alias("n"), common.alias("common"), F.slice("chains", common + 1, F.greatest(F.size("chains") - common, F.lit(0))).alias("fresh"))
    # in one pass over the prompts: a row for each turn, which has its counts, and one for each fresh block
    turn = F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("chain"))
    fresh = F.transform("fresh", lambda x, i: F.struct((i + F.col("common")).alias("place"), x.alias("chain")))
    rows = rows.select(*by, F.when(F.col("same"), 1).otherwise(0).alias("same"), "n", "common", F.explode(F.concat(F.array(turn), fresh)).alias("b"))
    own = F.col("b.place") < 0
    counted = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0)).alias(c)
    found = rows.groupBy(*by, "b").agg(F.count("*").alias("times"), *(counted(c) for c in ("n", "common", "same")))
    own = F.col("b.place") < 0
    total = lambda c: F.sum(c).cast("long")
    again = F.sum(F.when(own, 0).otherwise(F.col("times") - 1)).cast("long")
    return found.groupBy(*by).agg(F.sum(F.when(own, F.col("times")).otherwise(0)).cast("long").alias("turns"), total("n").alias("blocks"), total("common").alias("kept"), (total("common") + again).alias("seen"), total("same").alias("stable_turns"))
