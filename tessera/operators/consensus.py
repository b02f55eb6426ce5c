"""Votes on hypotheses: weights, weighted consensus, rounds, ratios and the skeptic's say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_weight


def vote_weights(votes: DataFrame, weights: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """votes with weight: the override, else the table's, else what the model's name says. weights, overrides: model, weight (small)."""
    out = votes.drop("weight").join(weights.withColumnRenamed("weight", "_t"), "model", "left")
    out = out.join(overrides.withColumnRenamed("weight", "_o"), "model", "left") if overrides is not None else out.withColumn("_o", F.lit(None).cast("double"))
    return out.withColumn("weight", F.coalesce("_o", "_t", name_weight(F.col("model")))).drop("_o", "_t")


def fill_votes(models: DataFrame, hypotheses: DataFrame, votes: DataFrame) -> DataFrame:
    """A vote of every model on every hypothesis; missing ones are false, with confidence 0. The product is the result itself."""
    grid = hypotheses.select("hypothesis").crossJoin(models.select("model").distinct())
    out = grid.join(votes, ["hypothesis", "model"], "left")
    return out.select("hypothesis", "model", F.coalesce("verdict", F.lit(False)).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reasoning", F.lit("not_evaluated")).alias("reasoning"))


def neutral(votes: DataFrame) -> DataFrame:
    """Failed analyses count as votes of false with confidence 0 at full weight."""
    bad = F.col("error").isNotNull()
    return votes.withColumn("verdict", F.when(bad, F.lit(False)).otherwise(F.col("verdict"))).withColumn("confidence", F.when(bad, F.lit(0.0)).otherwise(F.col("confidence")))


def gathered(votes: DataFrame) -> DataFrame:
    """Votes of models that answered, and how many voted on each hypothesis."""
    good = votes.where("error IS NULL")
    return good.join(good.groupBy("hypothesis").agg(F.countDistinct("model").alias("voters")), "hypothesis")


def status(w: Column, r: Column, threshold: float) -> Column:
    return F.when(w >= threshold, "confirmed").when((r < 0.3) & (w < 0.4), "rejected").otherwise("undecided")


def consensus(votes: DataFrame, threshold: float = 0.75, key: str = "hypothesis") -> DataFrame:
    """key, weighted (share of the weight that says yes), ratio (share of the votes), status."""
    yes = F.when(F.col("verdict"), F.col("weight")).otherwise(0.0)
    out = votes.groupBy(key).agg((F.sum(yes) / F.sum("weight")).alias("weighted"), F.avg(F.col("verdict").cast("double")).alias("ratio"))
    return out.withColumn("status", status(F.col("weighted"), F.col("ratio"), threshold))


def consensus_mean(votes: DataFrame, hypotheses: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row: means over all hypotheses; those without votes count in the denominator."""
    n = F.greatest(F.count("*"), F.lit(1))
    return hypotheses.select("hypothesis").join(consensus(votes, threshold), "hypothesis", "left").agg((F.coalesce(F.sum("weighted"), F.lit(0.0)) / n).alias("weighted"), (F.coalesce(F.sum("ratio"), F.lit(0.0)) / n).alias("ratio"))


def threshold_for(models: DataFrame, frontier: Sequence[str], override: float | None = None) -> float:
    """0.60 with a frontier model among the voters, else 0.75, unless the caller insists."""
    return override if override is not None else 0.60 if not models.where(F.col("model").isin(*frontier)).isEmpty() else 0.75


def short_key(hypothesis: Column) -> Column:
    return F.replace(F.substring(hypothesis, 1, 60), F.lit("\n"), F.lit(" "))


def plain_ratio(votes: DataFrame, threshold: float = 0.67) -> DataFrame:
    """key (60 characters; equal ones merge), ratio of yes votes to voters, confirmed. 2 of 3 is below 0.67."""
    out = votes.groupBy(short_key(F.col("hypothesis")).alias("key")).agg(F.sum(F.col("verdict").cast("int")).alias("yes"), F.countDistinct("model").alias("voters"))
    return out.select("key", (F.col("yes") / F.col("voters")).alias("ratio"), (F.col("yes") / F.col("voters") >= threshold).alias("confirmed"))


def rounds(votes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """round, weighted, reached: the mean weighted share after each round (votes add up), up to the first round that reaches the threshold."""
    per = votes.groupBy("hypothesis", "round").agg(F.sum(F.when(F.col("verdict"), F.col("weight")).otherwise(0.0)).alias("yes"), F.sum("weight").alias("all"))
    w = Window.partitionBy("hypothesis").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    share = per.withColumn("share", F.sum("yes").over(w) / F.sum("all").over(w)).groupBy("round").agg(F.avg("share").alias("weighted"))
    reached = share.withColumn("reached", F.col("weighted") >= threshold)
    first = reached.where("reached").agg(F.min("round").alias("first"))
    return reached.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("round") <= F.col("first"))).drop("first")


def skeptic(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confirmed hypotheses that the skeptic denies become rejected."""
    out = results.join(verdicts.select("hypothesis", F.col("verdict").alias("_v")), "hypothesis", "left")
    return out.withColumn("status", F.when((F.col("status") == "confirmed") & (F.col("_v") == F.lit(False)), "rejected").otherwise(F.col("status"))).drop("_v")


def hypothesis_confidence(votes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Mean confidence of those who say yes, else the weighted share."""
    yes = votes.groupBy("hypothesis").agg(F.avg(F.when(F.col("verdict"), F.col("confidence"))).alias("_c"))
    return consensus(votes, threshold).join(yes, "hypothesis").select("hypothesis", F.coalesce("_c", "weighted").alias("confidence"))


def verdict_summary(votes: DataFrame, threshold: float = 0.75) -> DataFrame:
    names = votes.where("verdict").groupBy("hypothesis").agg(F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("by"))
    out = consensus(votes, threshold).where("status <> 'undecided'").join(names, "hypothesis", "left")
    return out.select("hypothesis", "status", F.concat(F.upper("status"), F.lit(": "), F.substring("hypothesis", 1, 100), F.lit(" ["), F.coalesce("by", F.lit("")), F.lit("]")).alias("line"))


def by_position(verdicts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """verdicts (idx from 1, verdict, ord) matched to hypotheses (pos from 1, hypothesis); a repeated idx: the last."""
    last = verdicts.groupBy("idx").agg(F.max_by("verdict", "ord").alias("verdict"))
    return hypotheses.join(last, hypotheses["pos"] == last["idx"]).select("hypothesis", "verdict")


def new_hypotheses(rows: DataFrame, blacklist: DataFrame | None = None, top: int = 10, width: int = 200) -> DataFrame:
    """The first distinct hypotheses by ord, cut to width, without blacklisted ones."""
    out = rows.groupBy("hypothesis").agg(F.min("ord").alias("ord"))
    out = out.join(blacklist.select("hypothesis"), "hypothesis", "left_anti") if blacklist is not None else out
    return out.orderBy("ord").limit(top).select("ord", F.substring("hypothesis", 1, width).alias("hypothesis"))


def tool_choice(suggested: Column, available: Column, most: int = 2) -> tuple[Column, Column]:
    """Suggested tools that exist (at most `most`), and those that don't."""
    return F.slice(F.array_intersect(suggested, available), 1, most), F.array_except(suggested, available)


def with_confirmed(findings: DataFrame, confirmed: DataFrame) -> DataFrame:
    """findings plus a row (hypothesis, verified) for each one that the votes confirm; columns that one side lacks are null."""
    return findings.unionByName(confirmed.select("hypothesis", F.lit(True).alias("verified")), allowMissingColumns=True)


def dead_ends(blacklist: Column, tried: Column) -> Column:
    """Both, each entry once, in order of first appearance."""
    return F.array_union(blacklist, tried)


def distinct_tools(failures: DataFrame, key: str = "session", tool: str = "tool", order: str = "seq") -> DataFrame:
    """key, tools: the tools that failed, each once, in order of their first failure."""
    first = failures.groupBy(key, tool).agg(F.min(order).alias("_n"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", tool))), lambda t: t[tool]).alias("tools"))
