"""Metrics over call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in ms.
BUCKETS = (100, 500, 1000, 5000)


def tool_metrics(calls: DataFrame, key: str = "name") -> DataFrame:
    """key, calls, successes, success_rate (4 places), avg_ms: every call counts once."""
    ok = F.count_if("success")
    return calls.groupBy(key).agg(F.count("*").alias("calls"), ok.alias("successes"), F.round(ok / F.greatest(F.count("*"), F.lit(1)), 4).alias("success_rate"), F.avg("latency_ms").alias("avg_ms"))


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("total"), F.count_if(F.col("error_type") == "timeout").alias("timeouts"), F.count_if(~F.col("success") & ~F.col("error_type").eqNullSafe("timeout")).alias("errors"))


def recent(calls: DataFrame, now: Column, seconds: int = 300, ts: str = "ts", key: str = "name") -> DataFrame:
    """key, calls, avg_ms of the last seconds before now; the latency of successes over all calls."""
    rows = calls.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.groupBy(key).agg(F.count("*").alias("calls"), (F.sum(F.when(F.col("success"), F.col("latency_ms")).otherwise(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_ms"))


def latency_histogram(calls: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """bucket, calls: five buckets, empty ones too."""
    names = [f"[{a},{b})" for a, b in zip((0, *BUCKETS), (*BUCKETS, "inf"))]
    which = F.lit(names[-1])
    for name, top in reversed(list(zip(names, BUCKETS))):
        which = F.when(F.col(latency) < top, F.lit(name)).otherwise(which)
    counts = calls.groupBy(which.alias("bucket")).agg(F.count("*").alias("n"))
    every = calls.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("calls"))


def session_metrics(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session").agg(F.count("*").alias("steps"), F.countDistinct("action").alias("actions"), F.count_if(F.lower("observation").rlike("error|fail|timeout|crash")).alias("errors"), F.avg("confidence").alias("avg_confidence"))


def health(calls: DataFrame, disabled: DataFrame) -> DataFrame:
    """name, active, and the calls so far: a cascade's state."""
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.count_if("success").alias("successes")).join(disabled.select("name", F.lit(False).alias("_d")), "name", "left").select("name", "calls", "successes", F.coalesce("_d", F.lit(True)).alias("active"))


def token_metrics(runs: DataFrame, key: str = "model") -> DataFrame:
    ms, out = F.sum("ms"), F.sum("tokens_out")
    return runs.groupBy(key).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), out.alias("tokens_out"), F.round(F.avg("ms"), 1).alias("avg_ms"), F.when(ms > 0, out / (ms / 1000)).otherwise(0.0).alias("tokens_per_s"))


def advisor_metrics(calls: DataFrame, key: str = "name") -> DataFrame:
    """key, calls, errors, total_ms and avg_ms (one place)."""
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.round(F.sum("latency_ms"), 1).alias("total_ms"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"))


def cascade_summary(tries: DataFrame, key: str = "id") -> DataFrame:
    """key, path, attempted, failures, winner and total_ms (whole milliseconds) of each cascade. tries: key, pos, name, ms, error, answered.

    A try that failed has an error; the path names all tries in order; the winner is the last one if it answered.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", F.floor("ms").cast("long").alias("ms"), "error", "answered")))
    out = tries.groupBy(key).agg(rows.alias("r"))
    last = F.element_at("r", -1)
    return out.select(
        key, F.transform("r", lambda t: t["name"]).alias("path"), F.size("r").alias("attempted"), F.transform(F.filter("r", lambda t: t["error"].isNotNull()), lambda t: F.concat_ws(": ", t["name"], t["error"])).alias("failures"),
        F.when(last["answered"], last["name"]).alias("winner"), F.aggregate("r", F.lit(0).cast("long"), lambda a, t: a + t["ms"]).alias("total_ms"),
    )


def chain_state(calls: DataFrame, disabled: DataFrame) -> DataFrame:
    """One row: chain length, active members and the names of disabled ones."""
    return health(calls, disabled).agg(F.count("*").alias("chain_length"), F.count_if("active").alias("active"), F.array_sort(F.collect_list(F.when(~F.col("active"), F.col("name")))).alias("disabled"))
