"""Tokens and costs by stage, turn and conversation.  usage: ns, turn, stage, model_key, input, cached, output;
rates: model_key, input_rate, cached_rate, output_rate, each for a million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_costs(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """A cost for each usage row: uncached input, cached input and output at their rates; no rate, no cost."""
    j = usage.join(rates, "model_key", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input", "cached", "output")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("input_rate", "cached_rate", "output_rate")}
    j = j.withColumns(zero)
    million = F.lit(1e6)
    cost = F.greatest(F.col("input") - F.col("cached"), F.lit(0)) / million * F.col("input_rate") + F.col("cached") / million * F.col("cached_rate") + F.col("output") / million * F.col("output_rate")
    return j.select("ns", "turn", "stage", "model_key", "input", "cached", "output", F.round(cost, 10).alias("cost"))


def cost_parts(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage with cost_prompt, cost_cached, cost_completion and cost_total, each rounded to ten decimals by itself, and
    cost, what the stage is charged: of the embedding stage the prompt alone.  No rate, no cost."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input", "cached", "output")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("input_rate", "cached_rate", "output_rate")}
    j = usage.join(rates, "model_key", "left").withColumns(zero)
    million, embedding = F.lit(1e6), F.col("stage") == "embedding"
    prompt = F.when(embedding, F.col("input")).otherwise(F.greatest(F.col("input") - F.col("cached"), F.lit(0))) / million * F.col("input_rate")
    cached, completion = F.col("cached") / million * F.col("cached_rate"), F.col("output") / million * F.col("output_rate")
    parts = {"cost_prompt": F.round(prompt, 10), "cost_cached": F.round(cached, 10), "cost_completion": F.round(completion, 10), "cost_total": F.round(prompt + cached + completion, 10)}
    out = j.withColumns(parts).withColumn("cost", F.when(embedding, F.col("cost_prompt")).otherwise(F.col("cost_total")))
    return out.select("ns", "turn", "stage", "model_key", "input", "cached", "output", *parts, "cost")


def turn_split(costs: DataFrame) -> DataFrame:
    """(ns, turn, embedding, llm_input, llm_output, tokens, cost): all stages of a turn, so that two inference passes add
    up.  Cached and reasoning tokens are part of input and output and aren't added again."""
    emb = F.col("stage") == "embedding"
    g = costs.groupBy("ns", "turn").agg(F.sum(F.when(emb, F.col("input")).otherwise(0)).alias("embedding"), F.sum(F.when(emb, 0).otherwise(F.col("input"))).alias("llm_input"), F.sum(F.when(emb, 0).otherwise(F.col("output"))).alias("llm_output"), F.round(F.sum("cost"), 10).alias("cost"))
    return g.select("ns", "turn", "embedding", "llm_input", "llm_output", (F.col("embedding") + F.col("llm_input") + F.col("llm_output")).alias("tokens"), "cost")


def conversation_totals(turns: DataFrame) -> DataFrame:
    """The sums of turn_split for each conversation, from partial sums."""
    return turns.groupBy("ns").agg(*(F.sum(c).alias(c) for c in ("embedding", "llm_input", "llm_output", "tokens")), F.round(F.sum("cost"), 8).alias("cost"))


def turn_totals(costs: DataFrame) -> DataFrame:
    return costs.groupBy("ns", "turn").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum(F.when(F.col("stage") == "embedding", F.col("input")).otherwise(0)).alias("embedding"), F.round(F.sum("cost"), 10).alias("cost"))


def running_totals(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("ns").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("ns", "turn", F.sum(F.col("input") + F.col("output")).over(w).alias("tokens"), F.round(F.sum("cost").over(w), 10).alias("cost"))


def estimate(chunks: DataFrame, group: str, order: str, text: str, cap: int, rate: float) -> DataFrame:
    """(group, planned, tokens, cost): what embedding the first `cap` chunks of each document would take."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = chunks.where(F.col(group).isNotNull()).withColumn("_r", rank).where(F.col("_r") <= cap)
    tok = F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))
    return first.groupBy(group).agg(F.count(F.lit(1)).alias("planned"), F.sum(tok).cast("bigint").alias("tokens")).withColumn("cost", F.round(F.col("tokens") * rate / 1e6, 8))


def batch_summary(items: DataFrame) -> DataFrame:
    """items: status, planned, indexed, tokens, cost."""
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum(F.coalesce("indexed", "planned", F.lit(0))).alias("chunks"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"))
