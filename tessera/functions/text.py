"""Scalar text functions: privacy scrubbing, truncation, hashing, lenient parsing, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

# Patterns and replacements of the scrubbing rules. Those under "cloud" are known in a form that has lost
# its escapes; they stand here as they were meant.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
SCRUB_RULES: dict[str, list[tuple[str, str]]] = {
    "git": [
        (r"/home/[^/\s]+", "/workspace"),
        (r"/Users/[^/\s]+", "/workspace"),
        (r"C:\\Users\\[^\\]+", r"C:\\workspace"),
        (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
        (r"\b([0-9a-f]{7})[0-9a-f]{33}\b", "$1…"),
    ],
    "scan": [
        (r"(?i)/home/[^/\s]+", "/home/user"),
        (r"(?i)/Users/[^/\s]+", "/Users/user"),
        (r"(?i)C:\\Users\\[^\\\s]+", r"C:\\Users\\user"),
        (IPV4, "x.x.x.x"),
        (r"\b[\w\.-]+@[\w\.-]+\.\w+\b", "user@example.com"),
        (r"sk-[a-zA-Z0-9]{20,}", "sk-***"),
    ],
    "fuzz": [
        (r"(?i)/home/[^/\s]+", "/workspace"),
        (r"(?i)/Users/[^/\s]+", "/workspace"),
        (r"(?i)C:\\Users\\[^\\]+", r"C:\\workspace"),
        (IPV4, "x.x.x.x"),
    ],
    "debugger": [
        (r"(?i)/home/[^/\s]+", "/home/user"),
        (r"(?i)/Users/[^/\s]+", "/Users/user"),
        (r"(?i)C:\\Users\\[^\\\s]+", r"C:\\Users\\user"),
        (IPV4, "x.x.x.x"),
    ],
    "cloud": [
        (r"(?i)/home/[^/\s]+/[^/\s]+", "/workspace"),
        (r"(?i)/Users/[^/\s]+/[^/\s]+", "/workspace"),
        (r"(?i)[A-Z]:\\(?:[^\\\s]+\\)+[^\\\s]+", r"C:\\workspace"),
        (r"(?i)/opt/[^/\s]+/[^/\s]+", "/opt/app"),
        (r"(?i)/var/[^/\s]+/[^/\s]+", "/var/app"),
        (IPV4, "x.x.x.x"),
        (EMAIL, "user@example.com"),
        (r"(?i)AKIA[0-9A-Z]{16}", "AKIA...REDACTED"),
    ],
    "remote": [
        (r"(?i)/home/[^/\s]+", "/workspace"),
        (r"(?i)/Users/[^/\s]+", "/workspace"),
        (r"(?i)C:\\Users\\[^\\\s]+", r"C:\\workspace"),
        (EMAIL, "[EMAIL]"),
        (r"sk-[A-Za-z0-9]{40,}", "[API_KEY]"),
        (r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    ],
}


def scrub(text: Column, rules: str = "git") -> Column:
    for pattern, new in SCRUB_RULES[rules]:
        text = F.regexp_replace(text, pattern, new)
    return text


def truncate(text: Column, n: int, marker: str = "... [TRUNCATED]") -> Column:
    """The first n characters, with a marker where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def middle_cut(text: Column, head: int, tail: int, marker: str = " ... ") -> Column:
    return F.when(F.length(text) > head + tail, F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def sha_prefix(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def action_signature(name: Column, args: Column) -> Column:
    """name:json of a map's entries, sorted by key."""
    return F.concat_ws(":", name, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))))


def normal_path(path: Column) -> Column:
    """A path without `.` parts, repeated slashes and a trailing slash; `..` parts are resolved by a fold over its parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.startswith(path, F.lit("/"))

    def fold(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (p == "..") & last.isNotNull() & (last != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "..") & rooted, done).otherwise(F.array_append(done, p))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")
    return F.when(rooted, F.concat(F.lit("/"), folded)).when(folded == "", F.lit(".")).otherwise(folded)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def clamp(x: Column, low: float, high: float) -> Column:
    """A number from text, kept within bounds; null if it is none."""
    x = x.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def token_estimate(text: Column, per: int = 4) -> Column:
    return F.floor(F.length(text) / per).cast("long")


# Memory multipliers by quantisation marker, in the order in which they are tried.
RAM_MULTIPLIERS = (("Q2", 1.1), ("Q3", 1.15), ("Q4", 1.2), ("Q5", 1.25), ("Q6", 1.3), ("Q8", 1.5), ("F16", 2.1), ("F32", 4.0))


def ram_estimate(name: Column, size: Column, default: float = 1.5) -> Column:
    out = F.lit(default)
    for marker, factor in reversed(RAM_MULTIPLIERS):
        out = F.when(F.contains(F.upper(name), F.lit(marker)), F.lit(factor)).otherwise(out)
    return size * out


def backoff(attempt: Column, base: float, most: float, jitter: Column | None = None) -> Column:
    """min(base * 2^(attempt - 1), most), plus half of it times jitter (0 to 1) where given."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return delay if jitter is None else delay + delay * 0.5 * jitter


def lenient_json(raw: Column) -> Column:
    """The text from the first { to the last }, null where it doesn't parse."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


# Keywords of the error classes, tried in this order.
CRITICAL = ("auth", "api key", "unauthorized", "401", "403", "not found", "model unavailable", "connection refused")
TRANSIENT = ("timeout", "rate limit", "429", "503", "connection reset", "temporarily", "congestion")
ESSENTIAL = ("VULN_CONFIRMED", "CRITICAL_PATH", "heap-use-after-free", "AddressSanitizer", "stack-buffer-overflow")
CONFIRMS = ("VULN_CONFIRMED", "AddressSanitizer", "heap-use-after-free", "stack-buffer-overflow", "SEGFAULT", "CRASH", "UAF")
ERROR_WORDS = ("error", "fail", "timeout", "crash")
SYSTEM_ERRORS = ("TimeoutError", "ConnectionError", "OSError", "RuntimeError")


def any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words).replace(".", r"\."))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return F.when(any_of(low, CRITICAL), F.lit("CRITICAL")).when(any_of(low, TRANSIENT), F.lit("TRANSIENT")).otherwise(F.lit("RECOVERABLE"))


def is_error(observation: Column) -> Column:
    return any_of(F.lower(observation), ERROR_WORDS)


def is_essential(observation: Column) -> Column:
    return any_of(observation, ESSENTIAL)


def confirms(observation: Column) -> Column:
    return any_of(observation, CONFIRMS)


def is_system_error(kind: Column) -> Column:
    return kind.isin(*SYSTEM_ERRORS)


def name_weight(model: Column) -> Column:
    """Weight from the size in a model's name; the order of the tests matters (405b holds 5b, not 8b)."""
    low = F.lower(model)
    return F.when(low.rlike("70b|405b"), 1.25).when(low.rlike("32b|34b"), 1.10).when(low.contains("13b"), 0.90).when(low.rlike("8b|7b"), 0.75).otherwise(1.0)


def critique(text: Column, confidence: Column) -> tuple[Column, Column]:
    """New confidence and whether more evidence is asked for; the first matching phrase counts ("unlikely" holds "likely")."""
    low = F.lower(text)
    wrong, more, right = low.rlike("false positive|not reachable"), low.rlike("needs more evidence|insufficient"), low.rlike("confirmed|likely")
    return F.when(wrong, confidence * 0.3).when(more, confidence).when(right, F.least(confidence + 0.1, F.lit(0.95))).otherwise(confidence), ~wrong & more


def json_safe(x: Column, kind: DataType) -> Column:
    """A value that JSON can hold, at every depth: NaN as null, what JSON has no form for as text, map keys as text."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(x), x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: json_safe(e, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("key"), json_safe(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[json_safe(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x if isinstance(kind, (StringType, BooleanType, IntegralType, NullType)) else x.cast("string")


def parse_verdict(raw: Column) -> Column:
    return F.coalesce(F.contains(F.lower(raw), F.lit("true")), F.lit(False))


# The actions a step may name.
ACTIONS = ("codeql_query", "gdb_analyze", "fuzzer_run", "git_blame", "read_file", "rag_search", "FINISH", "NO_ACTION")


def parse_action(raw: Column) -> Column:
    """A step's action, thought and confidence from loose JSON; else the first action named in the text (0.3), else NO_ACTION (0.1)."""
    j = F.from_json(lenient_json(raw), "action string, thought string, confidence string")
    named = F.lit("NO_ACTION")
    for a in reversed(ACTIONS[:-1]):
        named = F.when(raw.contains(a), F.lit(a)).otherwise(named)
    return F.when(j.isNotNull(), F.struct(F.coalesce(j["action"], F.lit("NO_ACTION")).alias("action"), F.coalesce(j["thought"], F.lit("")).alias("thought"), F.coalesce(j["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"))).otherwise(
        F.struct(named.alias("action"), F.lit("").alias("thought"), F.when(named == "NO_ACTION", 0.1).otherwise(0.3).alias("confidence"))
    )


def parse_advice(raw: Column, hypotheses: int = 3, tools: int = 2) -> Column:
    """Advice from loose JSON: critique (500 characters), plan (600), hypotheses, tools and a threshold within 0.3 and 0.8."""
    j = F.from_json(lenient_json(raw), "critique string, plan string, hypotheses array<string>, tools array<string>, threshold string")
    return F.struct(
        F.substring(j["critique"], 1, 500).alias("critique"), F.substring(j["plan"], 1, 600).alias("plan"), F.slice(F.coalesce(j["hypotheses"], F.array().cast("array<string>")), 1, hypotheses).alias("hypotheses"),
        F.slice(F.coalesce(j["tools"], F.array().cast("array<string>")), 1, tools).alias("tools"), clamp(j["threshold"], 0.3, 0.8).alias("threshold"),
    )


def is_empty_advice(advice: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return blank(advice["critique"]) & blank(advice["plan"]) & (F.size(advice["hypotheses"]) == 0) & (F.size(advice["tools"]) == 0) & advice["threshold"].isNull()


# Debugger commands by preset, and query suites by bundle.
PRESETS = {
    "backtrace": "bt full", "registers": "info registers", "all_registers": "info all-registers", "stack": "info stack", "frame": "info frame", "locals": "info locals", "args": "info args", "threads": "info threads", "disas": "disas",
    "full_analysis": "bt full; info registers; info frame; info locals; info proc mappings", "memory_maps": "info proc mappings",
}
BUNDLES = {
    "security-extended": "codeql/cpp-queries:Security/CWE", "security-and-quality": "codeql/cpp-queries:Security and Quality", "buffer-overflow": "codeql/cpp-queries:Security/CWE/CWE-119",
    "use-after-free": "codeql/cpp-queries:Security/CWE/CWE-416", "sql-injection": "codeql/cpp-queries:Security/CWE/CWE-089", "command-injection": "codeql/cpp-queries:Security/CWE/CWE-078",
}


def look_up(name: Column, table: dict[str, str]) -> Column:
    """The table's value, or the name itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), name)


# The texts around a result.
ISSUES, ITEMS, SUCCESS, CHARS, FAILED = ("[OK] Found ", " potential issues"), ("[OK] Found ", " items"), "[OK] Success", ("... [", " chars total]"), ("[ERROR:", "]: ")


def format_for_llm(success: Column, error: Column, output: Column, findings: Column, count: Column, most: int = 1000) -> Column:
    """A tool's result as text: what was found, then the output's start. findings and count are null where the result has none."""
    around = lambda texts, c: F.concat(F.lit(texts[0]), c, F.lit(texts[1]))
    head = F.coalesce(around(ISSUES, findings.cast("string")), around(ITEMS, count.cast("string")), F.lit(SUCCESS))
    more = F.when(F.length(output) > most, around(CHARS, F.length(output).cast("string"))).otherwise("")
    shown = F.substring(output, 1, most)
    return F.when(success, F.concat(head, F.lit("\n"), shown, more)).otherwise(F.concat(around(FAILED, F.coalesce(error, F.lit("None"))), shown))
