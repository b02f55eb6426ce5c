"""Parsing what analysis tools leave behind: scan reports, sanitizer output, debugger sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = "STRUCT<physicalLocation: STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT, startColumn: INT>>>"
REPORT = (
    "runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<rules: ARRAY<STRUCT<id: STRING, defaultConfiguration: STRUCT<level: STRING>>>>>,"
    f" results: ARRAY<STRUCT<ruleId: STRING, message: STRUCT<text: STRING>, locations: ARRAY<{_PLACE}>,"
    f" codeFlows: ARRAY<STRUCT<threadFlows: ARRAY<STRUCT<locations: ARRAY<STRUCT<location: {_PLACE}>>>>>>>>>>"
)


def _place(p: Column) -> Column:
    """file, line, column of a location, with defaults."""
    at = p["physicalLocation"]
    return F.struct(F.coalesce(at["artifactLocation"]["uri"], F.lit("?")).alias("file"), F.coalesce(at["region"]["startLine"], F.lit(0)).alias("line"), F.coalesce(at["region"]["startColumn"], F.lit(0)).alias("column"))


def scan_findings(reports: DataFrame, limit: int = 50, flow: bool = True, path: str = "path", col: str = "json") -> DataFrame:
    """path, run, pos, rule_id, message, file, line, severity, flow_steps.

    The limit holds per run and before results without a location go. A rule named twice: the last
    one. Consecutive equal flow steps become one. Text that is no report gives no rows.
    """
    runs = reports.select(path, F.from_json(col, REPORT).alias("r")).select(path, F.posexplode("r.runs").alias("run", "r"))
    rows = runs.select(path, "run", F.col("r.tool.driver.rules").alias("rules"), F.posexplode(F.slice("r.results", 1, limit)).alias("pos", "x")).where(F.size("x.locations") > 0)
    same = F.filter("rules", lambda rule: rule["id"] == F.coalesce(F.col("x.ruleId"), F.lit("unknown")))
    level = F.when(F.size(same) > 0, F.element_at(same, F.when(F.size(same) > 0, F.lit(-1)).otherwise(F.lit(1)))["defaultConfiguration"]["level"])
    first = F.col("x.locations")[0]["physicalLocation"]
    none = F.array().cast("array<struct<file:string,line:int,column:int>>")
    threads = F.flatten(F.transform("x.codeFlows", lambda f: f["threadFlows"]))
    steps = F.transform(F.flatten(F.transform(threads, lambda t: t["locations"])), lambda e: _place(e["location"]))
    out = rows.withColumn("_s", F.coalesce(steps, none) if flow else none)
    steps = F.filter("_s", lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(F.col("_s"), i - 1)))
    return out.select(
        path, "run", "pos", F.coalesce("x.ruleId", F.lit("unknown")).alias("rule_id"), F.coalesce("x.message.text", F.lit("")).alias("message"), F.coalesce(first["artifactLocation"]["uri"], F.lit("unknown")).alias("file"),
        F.coalesce(first["region"]["startLine"], F.lit(0)).alias("line"), F.coalesce(level, F.lit("warning")).alias("severity"), F.slice(steps, 1, 10).alias("flow_steps"),
    )


# Crash types, tried in this order.
CRASH_TYPES = ("heap-use-after-free", "heap-buffer-overflow", "stack-buffer-overflow", "global-buffer-overflow", "use-after-poison", "container-overflow", "double-free", "alloc-dealloc-mismatch")
#: Line ends that count: \n, \r\n, \r and the separators of Unicode.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def sanitizer_crashes(logs: DataFrame, path: str = "path", col: str = "text") -> DataFrame:
    """path, crash_type, stack (20 frames at most, up to the first blank line behind one), fault_address. Logs without a crash give no row."""
    kind = F.coalesce(*[F.when(F.col(col).rlike(rf"==\d+==ERROR: AddressSanitizer: {c}"), F.lit(c)) for c in CRASH_TYPES])
    rows = logs.select(path, col, kind.alias("crash_type"), F.split(col, LINES).alias("_l")).where("crash_type IS NOT NULL")
    frame = lambda x: x.rlike(r"^\s+#\d+ ")
    place = F.transform("_l", lambda x, i: F.struct(frame(x).alias("f"), (F.trim(x) == "").alias("b"), i.alias("i")))
    rows = rows.withColumn("_first", F.array_min(F.transform(F.filter(place, lambda p: p["f"]), lambda p: p["i"])))
    rows = rows.withColumn("_end", F.coalesce(F.array_min(F.transform(F.filter(place, lambda p: p["b"] & (p["i"] > F.col("_first"))), lambda p: p["i"])), F.size("_l")))
    stack = F.when(F.col("_first").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.filter("_l", lambda x, i: frame(x) & (i < F.col("_end"))), lambda x: F.trim(x)))
    address = F.regexp_extract(col, r"0x[0-9a-fA-F]{8,16}", 0)
    return rows.select(path, "crash_type", F.slice(stack, 1, 20).alias("stack"), F.when(address != "", address).alias("fault_address"))


def unique_crashes(crashes: DataFrame) -> DataFrame:
    """crash_type, top frame, crashes: one row for crashes alike."""
    return crashes.groupBy("crash_type", F.get("stack", F.lit(0)).alias("top_frame")).agg(F.count("*").alias("crashes"))


def address_entropy(text: Column) -> Column:
    """Share of distinct first 8 digits among addresses times 32; null with fewer than five."""
    all_ = F.regexp_extract_all(text, F.lit(r"0x([0-9a-fA-F]{8,16})"), F.lit(1))
    return F.when(F.size(all_) >= 5, F.round(F.size(F.array_distinct(F.transform(all_, lambda a: F.substring(a, 1, 8)))) / F.size(all_) * 32, 2))


# The patterns of a debugger's lines, and what two of its marks look for and say.
FRAME, SIGNALS, MAPPING, REGISTER, FAULT = r"^#\d", "sigsegv|sigabrt|sigill|sigfpe|sigbus", r"^0x[0-9a-fA-F]+-0x[0-9a-fA-F]+", r"(?i)^([a-z][a-z0-9]{1,4})\s+(0x[0-9a-f]+)", r"at (0x[0-9a-fA-F]+)"
PATTERN, PATTERN_SAYS = "(?i)0x41414141|0x61616161|0x42424242", "Repeating pattern detected (AAAA/aaaa/BBBB) — possible buffer overflow control"
CORRUPTION, CORRUPTION_SAYS = "(?i)heap.use.after.free|double.free|heap.buffer.overflow", "AddressSanitizer: memory corruption detected"


def debugger_sessions(logs: DataFrame, path: str = "path", col: str = "text") -> DataFrame:
    """path, stack, signal_info, fault_address, registers (last value), memory_maps, findings (100 at most), aslr_entropy.

    A line that starts with # and a digit is a frame and nothing else.
    """
    lines = F.transform(F.split(col, LINES), lambda x: F.trim(x))
    rows = logs.select(path, col, lines.alias("_l"))
    is_frame = lambda x: x.rlike(FRAME)
    is_signal = lambda x: ~is_frame(x) & F.lower(x).contains("signal") & F.lower(x).rlike(SIGNALS)
    is_map = lambda x: ~is_frame(x) & x.rlike(MAPPING)
    regs = F.transform(F.filter("_l", lambda x: ~is_frame(x) & x.rlike(REGISTER)), lambda x: F.struct(F.regexp_extract(x, REGISTER, 1).alias("k"), F.regexp_extract(x, REGISTER, 2).alias("v")))
    rows = rows.withColumn("_r", regs).withColumn("_s", F.filter("_l", is_signal))
    last = F.filter("_r", lambda r, i: ~F.exists(F.slice("_r", i + 2, F.greatest(F.size("_r"), F.lit(1))), lambda q: q["k"] == r["k"]))
    at = F.filter(F.transform("_s", lambda s: F.regexp_extract(s, FAULT, 1)), lambda a: a != "")
    found = F.flatten(F.transform("_l", lambda x: F.array_compact(F.array(
        F.when(is_frame(x), F.struct(F.lit("stack_frame").alias("type"), F.substring(x, 1, 200).alias("raw"))), F.when(is_signal(x), F.struct(F.lit("signal").alias("type"), x.alias("raw"))),
        F.when(is_map(x), F.struct(F.lit("memory_map").alias("type"), F.substring(x, 1, 150).alias("raw"))),
    ))))
    marks = F.array_compact(F.array(
        F.when(F.col(col).rlike(PATTERN), F.struct(F.lit("exploit_pattern").alias("type"), F.lit(PATTERN_SAYS).alias("raw"))),
        F.when(F.col(col).rlike(CORRUPTION), F.struct(F.lit("asan_signal").alias("type"), F.lit(CORRUPTION_SAYS).alias("raw"))),
    ))
    return rows.select(
        path, F.filter("_l", is_frame).alias("stack"), F.try_element_at("_s", F.lit(-1)).alias("signal_info"), F.try_element_at(at, F.lit(-1)).alias("fault_address"), F.map_from_entries(last).alias("registers"),
        F.filter("_l", is_map).alias("memory_maps"), F.slice(F.concat(found, marks), 1, 100).alias("findings"), address_entropy(F.col(col)).alias("aslr_entropy"),
    )
