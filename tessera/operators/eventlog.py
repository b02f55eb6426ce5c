"""Per-key state over event logs: failure streaks, circuits, running cost, windows, triggers and escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def failure_streak(events: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """Adds streak: failures in a row up to the row, by key; a success resets it, other keys don't."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.when(failed, 1).otherwise(0)
    marked = events.withColumn("_bad", bad).withColumn("_isle", F.sum(1 - F.col("_bad")).over(w))
    run = Window.partitionBy(*keys, "_isle").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum("_bad").over(run)).drop("_bad", "_isle")


def loops(events: DataFrame, keys: list[str], order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """keys, max_streak, looped: the flag stays set once a streak reaches the limit."""
    return failure_streak(events, keys, order, failed).groupBy(*keys).agg(F.max("streak").alias("max_streak"), (F.max("streak") >= limit).alias("looped"))


def circuit(events: DataFrame, keys: list[str], order: list[str], failed: Column, ts: str = "ts", limit: int = 5, rest_s: int = 60) -> DataFrame:
    """Adds state: closed, open (limit failures in a row), or half_open (open, and over rest_s since the failure before)."""
    out = failure_streak(events, keys, order, failed)
    w = Window.partitionBy(*keys).orderBy(*order)
    before, last = F.coalesce(F.lag("streak").over(w), F.lit(0)), F.lag(ts).over(w)
    idle = F.col(ts).cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return out.withColumn("state", F.when(before < limit, "closed").when(idle > rest_s, "half_open").otherwise("open"))


def running_total(events: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    return events.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_n(events: DataFrame, keys: list[str], order: list[str], n: int = 6, verbose: int = 2) -> DataFrame:
    """The last n rows of each key; the last `verbose` of them are marked."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).withColumn("verbose", F.col("back") <= verbose)


def essential_first(events: DataFrame, keys: list[str], order: list[str], essential: Column, n: int = 6) -> DataFrame:
    """History cut to n rows a key, essential ones before newer ones (the documented intent)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_e"), *[F.desc(c) for c in order])
    return events.withColumn("_e", essential).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_e", "_n")


def last_value(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def disabled_after(events: DataFrame, keys: list[str], order: list[str], kind: str, limit: int = 2) -> DataFrame:
    """Adds disabled: from the first timeout at which timeouts and recoverable errors so far reach the limit, or the first critical error."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    k = F.col(kind)
    so_far = F.sum(F.when(k.isin("timeout", "recoverable"), 1).otherwise(0)).over(w)
    hit = F.when((k == "critical") | ((k == "timeout") & (so_far >= limit)), 1).otherwise(0)
    return events.withColumn("_hit", hit).withColumn("disabled", F.max("_hit").over(w) == 1).drop("_hit")


def cost_by_file(costs: DataFrame) -> DataFrame:
    """session, file, usd; file is null for the session's total."""
    return costs.rollup("session", "file").agg(F.sum("usd").alias("usd")).where("session IS NOT NULL")


def attribute_cost(steps: DataFrame, costs: DataFrame) -> DataFrame:
    """costs with file: where it is missing, that of the session's last step before, if that step read a file."""
    log = steps.select("session", "seq", F.lit(0).alias("kind"), "action", "file", F.lit(None).cast("double").alias("usd")).unionByName(costs.select("session", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("action"), "file", "usd"))
    w = Window.partitionBy("session").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    step = F.last(F.when(F.col("kind") == 0, F.struct("action", "file")), ignorenulls=True).over(w)
    out = log.withColumn("_s", step).where("kind = 1")
    return out.select("session", "seq", F.coalesce("file", F.when(F.col("_s")["action"] == "read_file", F.col("_s")["file"])).alias("file"), "usd")


def ordered_sum(rows: DataFrame, keys: list[str], value: str, *more: Column, order: str = "seq") -> DataFrame:
    """keys, value summed by key, and more aggregates. Doubles are added in the order of order and value, one by one.

    So a sum near a limit is the same however rows are dealt to tasks. Without an order column rows go by value.
    """
    w = Window.partitionBy(*keys).orderBy(*[c for c in (order, value) if c in rows.columns])
    so_far = rows.withColumns({"_n": F.row_number().over(w), "_sum": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return so_far.groupBy(*keys).agg(F.max_by("_sum", "_n").alias(value), *more)


def exact_sum(rows: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """keys, value summed by key, and more aggregates. Doubles are added as the decimals they are written as, to 18 places.

    So 0.1 + 0.2 + 0.3 is 0.6 in any order, and equal costs are equal. A key with a value or sum that
    decimals don't hold (1e20 and more, infinite, NaN) gets the sum of the doubles.
    """
    exact = F.col(value).try_cast("decimal(38,18)")
    total = F.when(F.count(value) == F.count(exact), F.try_sum(exact).cast("double"))
    return rows.groupBy(*keys).agg(F.coalesce(total, F.sum(value)).alias(value), *more)


def costly_files(costs: DataFrame, least: float = 0.5) -> DataFrame:
    return ordered_sum(costs.where("file IS NOT NULL"), ["session", "file"], "usd").where(F.col("usd") >= least).orderBy(F.desc("usd"), "session", "file")


def cost_escalation(costs: DataFrame, confirmed: DataFrame, limit: float = 2.0, total: float = 10.0, sums=ordered_sum) -> DataFrame:
    """session, file, reason: the first costly file that no confirmed observation names in its first 50 characters, else a costly session without one. sums: ordered_sum or exact_sum."""
    limit = limit or 2.0
    files = sums(costs.where("file IS NOT NULL"), ["session", "file"], "usd", F.min("seq").alias("first")).where(F.col("usd") > limit)
    heads = confirmed.select(F.col("session").alias("_s"), F.substring("observation", 1, 50).alias("_o"))
    open_ = files.join(heads, (F.col("session") == F.col("_s")) & F.contains("_o", "file"), "left_anti")
    by_file = open_.groupBy("session").agg(F.min_by("file", "first").alias("file")).withColumn("reason", F.lit("file"))
    totals = sums(costs, ["session"], "usd").where(F.col("usd") > total).join(confirmed.select("session"), "session", "left_anti").join(by_file.select("session"), "session", "left_anti")
    return by_file.unionByName(totals.select("session", F.lit(None).cast("string").alias("file"), F.lit("total").alias("reason")))


#: Rests that one chunk of a key's steps is long.
CHUNK = 1024


def cooldown(events: DataFrame, keys: list[str], seq: str, wants: str, rest: int = 5) -> DataFrame:
    """Adds escalates: a row that wants to and comes at least `rest` after the last one that did. seq holds whole numbers; a row without one never escalates.

    Each decision depends on the one before, but a chunk of a key's steps depends on what came before it by a
    number below `rest` only: how far into the chunk the last escalation still holds. So each chunk
    tells, for every such number, its last escalation; a key's chunks are then chained, one step a
    chunk; and each chunk, which now knows its number, names its escalations. A key of many rows is spread over tasks.
    Of rows with one key and number, one escalates: the first by a hash of what it holds.
    """
    if rest < 1:
        return events.withColumn("escalates", F.coalesce(F.col(wants), F.lit(False)))
    width = rest * CHUNK
    named = {"_k": F.struct(*keys), "_s": F.col(seq).cast("long")}  # structs with equal nulls are equal
    steps = events.where(F.col(wants)).select(*[c.alias(n) for n, c in named.items()]).where("_s IS NOT NULL")
    chunks = cut(steps.groupBy("_k", F.floor(F.col("_s") / width).alias("_c")).agg(F.array_sort(F.collect_set("_s")).alias("_a")))
    begin = lambda c, o: c * width + o - rest  # noqa: E731  # the last escalation before a chunk, as far as the chunk can tell
    ends = F.transform(F.sequence(F.lit(0), F.lit(rest - 1)), lambda o: F.aggregate("_a", begin(F.col("_c"), o), lambda a, s: F.when(s - a >= rest, s).otherwise(a)))
    chains = chunks.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_c", ends.alias("_e")))).alias("_f"))

    def follow(a: Column, f: Column) -> Column:
        o = F.greatest(F.coalesce(a["last"] + rest - f["_c"] * width, F.lit(0)), F.lit(0)).cast("int")
        end = F.get(f["_e"], o)
        return F.struct(F.when(end == begin(f["_c"], o), a["last"]).otherwise(end).alias("last"), F.array_append(a["at"], F.struct(f["_c"].alias("_c"), begin(f["_c"], o).alias("_b"))).alias("at"))

    at = F.aggregate("_f", F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<_c:bigint,_b:bigint>>").alias("at")), follow)["at"]
    known = chains.select("_k", F.explode(at).alias("_p")).select("_k", "_p._c", "_p._b")
    pick = lambda a, s: F.when(s - a["last"] >= rest, F.struct(s.alias("last"), F.array_append(a["out"], s).alias("out"))).otherwise(a)
    picks = F.aggregate("_a", F.struct(F.col("_b").alias("last"), F.array().cast("array<bigint>").alias("out")), pick)["out"]
    chosen = cut(chunks.join(known, ["_k", "_c"]).select("_k", F.explode(picks).alias("_s")).withColumn("_hit", F.lit(True)))
    first = F.row_number().over(Window.partitionBy("_k", "_s", "_w").orderBy(F.xxhash64(*events.columns))) == 1
    out = events.withColumns(named | {"_w": F.coalesce(F.col(wants), F.lit(False))}).join(chosen.hint("merge"), ["_k", "_s"], "left")
    return out.withColumn("escalates", F.col("_w") & F.coalesce("_hit", F.lit(False)) & first).select(*events.columns, "escalates")


def wants_escalation(confidence: Column, errors: Column, steps: Column, hypotheses: Column, threshold: Column, late: int = 15, most: int = 3) -> Column:
    """An agent's condition, before the cool-down: low confidence, late without hypotheses, or over `most` errors. A null confidence is not low."""
    return F.coalesce(confidence < threshold, F.lit(False)) | ((hypotheses == 0) & (steps > late)) | (errors > most)


def local_trigger(confidence: Column, errors: Column, steps: Column, hypotheses: Column, blacklist: Column, low: float = 0.55, most: int = 4, late: int = 18) -> Column:
    """Low confidence, many errors, or late without a hypothesis that isn't blacklisted (both are arrays)."""
    novel = F.size(F.array_except(hypotheses, blacklist))
    return F.coalesce(confidence < low, F.lit(False)) | (errors >= most) | ((steps > late) & (novel == 0))


def rule_trigger(confidence: Column, errors: Column, steps: Column, hypotheses: Column, low: float = 0.5, most: int = 3, late: int = 15) -> Column:
    """Low confidence, many errors, or late without hypotheses; a null confidence is not low."""
    return F.coalesce(confidence < low, F.lit(False)) | (errors >= most) | ((steps > late) & (hypotheses == 0))


# The advice that rules give.
LOW_ADVICE = ("Confidence low (", "). Broaden search: try IPC boundaries and adjacent modules.")
ERROR_ADVICE = ("Model has ", " parse errors. Simplify prompt or reduce grammar complexity.")
STALLED_ADVICE = "No hypotheses after many steps. Focus on allocators, GC roots, and IPC serialization."
NO_ADVICE = "Rules check passed."


def rule_advice(confidence: Column, errors: Column, steps: Column, hypotheses: Column, low: float = 0.5, most: int = 3, late: int = 15) -> tuple[Column, Column]:
    """The advice of the rules that hold, and a new threshold (null: as it is) if confidence is low."""
    bad = F.coalesce(confidence < low, F.lit(False))
    text = F.concat_ws(
        " ", F.when(bad, F.concat(F.lit(LOW_ADVICE[0]), F.format_string("%.2f", confidence), F.lit(LOW_ADVICE[1]))),
        F.when(errors >= most, F.concat(F.lit(ERROR_ADVICE[0]), errors.cast("string"), F.lit(ERROR_ADVICE[1]))), F.when((steps > late) & (hypotheses == 0), F.lit(STALLED_ADVICE)),
    )
    return F.when(text == "", F.lit(NO_ADVICE)).otherwise(text), F.when(bad, F.lit(max(0.4, low - 0.1)))


def cloud_trigger(ready: Column, confidence: Column, local_asked: Column, errors: Column, steps: Column, hypotheses: Column) -> Column:
    """A low confidence that no local advisor has seen vetoes, whatever else holds."""
    low = F.coalesce(confidence < 0.45, F.lit(False))
    return ready & ~(low & ~local_asked) & (low | (errors >= 3) | ((steps > 20) & (hypotheses == 0)))


def escalate_further(confirmed: Column, confidence: Column, hypotheses: Column, errors: Column, level: Column) -> Column:
    return (confirmed == 0) & ((F.coalesce(confidence, F.lit(0.0)) < 0.5) | (hypotheses == 0) | (errors > 5)) & (level < 4)


def level_threshold(level: Column) -> Column:
    return F.when(level == 1, 0.65).when(level == 2, 0.60).when(level == 3, 0.55).when(level == 4, 0.50).otherwise(0.60)


def clamp_level(level: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), level))


# The advice in place of an advisor that failed, and the threshold that comes with the cloud's.
FALLBACK_ADVICE = (
    "Simplify actions. Use explicit parameters. Avoid nested tool calls.",
    "Switch to rag_search with CVE patterns. Try different file directories.",
    "Continue current strategy with reduced confidence threshold.",
)
CLOUD_FALLBACK = "Cloud advisor unavailable. Continue with local reasoning. Focus on memory-unsafe patterns and recent file changes."
CLOUD_FALLBACK_THRESHOLD = 0.55


def fallback_text(errors: Column, hypotheses: Column) -> Column:
    """By over three errors, no hypotheses, else."""
    many, none, other = FALLBACK_ADVICE
    return F.when(errors > 3, F.lit(many)).when(hypotheses == 0, F.lit(none)).otherwise(F.lit(other))


def within_budget(calls: Column, most_calls: int, spent: Column, cost_in: Column, cost_out: Column, most: float) -> Column:
    return (calls < most_calls) & (spent + 2 * cost_in + cost_out <= most)


def over_budget(spent: Column, estimate: Column, most: Column) -> Column:
    """The message of a call that its budget forbids, else null; a null budget forbids nothing."""
    text = F.format_string("Budget $%.2f would be exceeded (used: $%.4f, est: $%.4f)", most, spent, estimate)
    return F.when(spent + estimate > most, text)


def tool_outputs(steps: DataFrame, most: int = 800, n: int = 5) -> DataFrame:
    """session, text: of the last n steps those with an observation, newest first cut to half of what is left, written oldest first."""
    w = Window.partitionBy("session").orderBy(F.desc("step_num"))
    rows = steps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    seen = F.when(F.coalesce("observation", F.lit("")) != "", F.struct("_n", "observation"))
    lists = rows.groupBy("session").agg(F.array_sort(F.collect_list(seen)).alias("rows"))

    def add(a: Column, r: Column) -> Column:
        mark = F.when(F.lower(r["observation"]).rlike("error|fail|timeout|crash"), F.lit("[FAIL] ")).otherwise("[OK] ")
        line = F.substring(F.concat(mark, r["observation"]), F.lit(1), F.floor(a["left"] / 2).cast("int"))
        return F.struct(F.array_append(a["lines"], line).alias("lines"), (a["left"] - F.length(line)).alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(most).alias("left"))
    lines = F.aggregate("rows", start, add)["lines"]
    return lists.select("session", F.when(F.size("rows") == 0, F.lit("No tool outputs yet.")).otherwise(F.array_join(F.reverse(lines), "\n")).alias("text"))


def error_counter(events: DataFrame, keys: list[str], order: list[str], failed: Column, reset: Column) -> DataFrame:
    """Adds errors: failures since the last reset, by key; rows that are neither leave the count as it is."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("_f", F.when(failed, 1).otherwise(0)).withColumn("_i", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    run = Window.partitionBy(*keys, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("errors", F.sum("_f").over(run) - F.when(reset & failed, 1).otherwise(0)).drop("_f", "_i")


def mark_last(events: DataFrame, keys: list[str], order: list[str], flag: str, marked: DataFrame) -> DataFrame:
    """Sets flag on the newest row of each key that marked (keys) names."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    out = events.withColumn("_n", F.row_number().over(w)).join(marked.select(*keys).distinct().withColumn("_m", F.lit(True)), keys, "left")
    return out.withColumn(flag, F.col(flag) | F.coalesce(F.col("_m") & (F.col("_n") == 1), F.lit(False))).drop("_n", "_m")


def summary(events: DataFrame, costs: DataFrame, sums=ordered_sum) -> DataFrame:
    """session, report: steps, errors, cost and the three most expensive files of 0.5 or more. sums: ordered_sum or exact_sum."""
    w = Window.partitionBy("session").orderBy(F.desc("usd"), "file")
    top = sums(costs.where("file IS NOT NULL"), ["session", "file"], "usd").where("usd >= 0.5").withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    files = top.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "file", "usd"))), lambda f: F.format_string("%s ($%.2f)", f["file"], f["usd"])), ", ").alias("files"))
    total = sums(costs, ["session"], "usd")
    steps = events.groupBy("session").agg(F.count("*").alias("steps"), F.count_if(F.lower("observation").rlike("error|fail|timeout|crash")).alias("errors"))
    out = steps.join(total, "session", "left").join(files, "session", "left")
    return out.select("session", F.format_string("%d steps, %d errors, $%.2f; %s", "steps", "errors", F.coalesce("usd", F.lit(0.0)), F.coalesce("files", F.lit("no costly file"))).alias("report"))
