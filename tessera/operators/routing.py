"""Model routing: fallback chains, executors, advisors, budgets, costs and prices.

Which side of a join is broadcast is left to Spark, which goes by measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def fallback_chain(models: DataFrame, requested: DataFrame) -> DataFrame:
    """requested, name, pos: other models of the requested one's tier or below, by tier downwards; ties in table order (ord).

    The result holds a row for each pair, so both are small dimensions here; where only the best
    member is wanted, resolve_executor finds it without the chain.
    """
    want = requested.join(models.select(F.col("name").alias("requested"), F.col("tier").alias("_t")), "requested", "left")
    out = models.join(want, (F.col("tier") <= F.coalesce("_t", F.lit(0))) & (F.col("name") != F.col("requested")))
    w = Window.partitionBy("requested").orderBy(F.desc("tier"), "ord")
    return out.select("requested", "name", "tier", F.row_number().over(w).alias("pos"))


def resolve_executor(models: DataFrame, requested: DataFrame, available: DataFrame, gpu: bool, local_only: bool) -> DataFrame:
    """requested, executor: the model itself if it is available and fits, else the first such one of its chain; null if none does.

    The chain isn't built: one row a tier holds its first usable model, and a running maximum over
    the tiers gives the best one at or below each. An unknown model has tier 0.
    """
    fits = models.join(available.select("name").distinct(), "name", "left_semi").where((F.lit(gpu) | ~F.col("requires_gpu")) & (F.lit(not local_only) | F.col("is_local")))
    want = requested.join(models.select(F.col("name").alias("requested"), "tier"), "requested", "left").select("requested", F.coalesce("tier", F.lit(0)).alias("tier"))
    best = fits.groupBy("tier").agg(F.min_by("name", "ord").alias("best"))
    tiers = want.select("tier").unionByName(best.select("tier")).distinct().join(best, "tier", "left")
    below = tiers.select("tier", F.last("best", ignorenulls=True).over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)).alias("below"))
    own = want.join(fits.select(F.col("name").alias("requested"), F.lit(True).alias("own")), "requested", "left").join(below, "tier")
    return own.select("requested", F.when(F.col("own"), F.col("requested")).otherwise(F.col("below")).alias("executor"))


def resolve_advisors(wanted: DataFrame, advisors: DataFrame, air_gapped: bool) -> DataFrame:
    """wanted (id, primary, fallback, chain): advisor, and the chain's usable members; air-gapped, unknown members count as networked."""
    known = advisors.select("name", "requires_network")
    usable = known.where(~F.col("requires_network")) if air_gapped else known
    look = lambda c: usable.select(F.col("name").alias(c), F.col("name").alias(f"_{c}"))
    out = wanted.join(look("primary"), "primary", "left").join(look("fallback"), "fallback", "left")
    links = wanted.select("id", F.posexplode("chain").alias("pos", "name"))
    kept = links.join(usable, "name", "left_semi") if air_gapped else links
    chains = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("usable_chain"))
    out = out.join(chains, "id", "left").withColumn("usable_chain", F.coalesce("usable_chain", F.array().cast("array<string>")))
    return out.select("id", F.coalesce("_primary", "_fallback", F.get("usable_chain", F.lit(0))).alias("advisor"), "usable_chain")


def budget(profile: Column, user: Column, air_gapped: Column) -> Column:
    """None without network; else the smaller of those that are set."""
    return F.when(~air_gapped, F.least(profile, user))


def priced(calls: DataFrame, prices: DataFrame, per: float = 1000.0) -> DataFrame:
    """calls (model, tokens_in, tokens_out) with usd; unknown models cost nothing. The price's unit is a parameter."""
    out = calls.join(prices.select("model", "usd_in", "usd_out"), "model", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumn("usd", (F.col("tokens_in") * zero("usd_in") + F.col("tokens_out") * zero("usd_out")) / per).drop("usd_in", "usd_out")


def estimated_cost(prompt: Column, tokens_out: Column, usd_in: Column, usd_out: Column, per: float = 1000.0) -> Column:
    return (token_estimate(prompt) * usd_in + tokens_out * usd_out) / per


def check_plan(plans: DataFrame) -> DataFrame:
    """Plans with the rules they break: air-gapped ones have no budget, consensus needs two debate models, a chain isn't of length 1."""
    faults = F.array_compact(F.array(
        F.when(F.col("air_gapped") & F.col("budget").isNotNull(), F.lit("budget without network")),
        F.when(F.col("consensus") & (F.size("debate_models") < 2), F.lit("consensus without debate models")),
        F.when(F.size("chain") == 1, F.lit("chain of one")),
    ))
    return plans.withColumn("faults", faults)


def overlay(defaults: dict, user: dict | None) -> dict:
    """Profiles with a user's settings laid over them, profile by profile, one level deep."""
    out = {k: dict(v) for k, v in defaults.items()}
    for name, values in (user or {}).items():
        if isinstance(values, dict):
            out[name] = {**out.get(name, {}), **values}
    return out


def first_answer(answers: DataFrame, order: str = "priority", default: int = 50) -> DataFrame:
    """Per id the first answer that is not empty, by priority (default 50) and then name; where all are empty, the last one asked."""
    place = F.struct(F.coalesce(F.col(order), F.lit(default)), F.col("name"))
    whole = F.struct(*answers.columns)
    picked = answers.groupBy("id").agg(F.min_by(F.when(~F.col("empty"), whole), F.when(~F.col("empty"), place)).alias("_a"), F.max_by(whole, place).alias("_b"))
    return picked.select(F.coalesce("_a", "_b").alias("_a")).select("_a.*")


def cascade(answers: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Per id the first non-empty answer of enabled, triggered advisors in chain order; below 0.3 confidence only networked ones are asked."""
    asked = answers.where(F.col("enabled") & F.col("triggered") & (F.col("requires_network") | (F.col(confidence) >= 0.3)))
    w = Window.partitionBy("id").orderBy("pos")
    return asked.where(~F.col("empty")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
