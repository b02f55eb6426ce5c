"""Queries over sessions, advice, votes and calls, with their SQL. Events are steps; a user is a session."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consensus as C
from ..operators import eventlog as E
from ..operators import hotspots as H
from ..operators import metrics as M
from ..operators import routing as RT
from .catalogue import CHURN, VOTES, T, calls, churn_and_authors, failed, query, votes

#: Contexts of an agent: confidence (null now and then), errors, steps, number of hypotheses.
CTX = "x AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 97) / 100.0::DOUBLE END AS conf, CAST(user_id % 6 AS INTEGER) AS errors, CAST(event_id % 30 AS INTEGER) AS steps, CAST(user_id % 4 AS INTEGER) AS hyps FROM events)"


def contexts(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    return T(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(i % 11 != 0, (i % 97).cast("double") / 100).alias("conf"), (u % 6).cast("int").alias("errors"), (i % 30).cast("int").alias("steps"), (u % 4).cast("int").alias("hyps"),
    )


def pick(words, n):
    """One of some words, by a number."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def pick_sql(words, n):
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][CAST({n} % {len(words)} + 1 AS INTEGER)]"


COLS = ("conf", "errors", "steps", "hyps")


@query(f"""WITH {CTX} SELECT event_id, CASE WHEN t = '' THEN 'Rules check passed.' ELSE t END AS advice, CASE WHEN conf < 0.5 THEN 0.4::DOUBLE END AS threshold FROM (SELECT *, concat_ws(' ',
CASE WHEN conf < 0.5 THEN 'Confidence low (' || printf('%.2f', conf) || '). Broaden search: try IPC boundaries and adjacent modules.' END,
CASE WHEN errors >= 3 THEN 'Model has ' || errors || ' parse errors. Simplify prompt or reduce grammar complexity.' END,
CASE WHEN steps > 15 AND hyps = 0 THEN 'No hypotheses after many steps. Focus on allocators, GC roots, and IPC serialization.' END) AS t FROM x)""")
def rule_advice(spark, sf):
    text, threshold = E.rule_advice(*map(F.col, COLS))
    return contexts(spark, sf).select("event_id", text.alias("advice"), threshold.alias("threshold"))


@query(f"""WITH {CTX} SELECT event_id, CASE WHEN errors > 3 THEN 'Simplify actions. Use explicit parameters. Avoid nested tool calls.' WHEN hyps = 0 THEN 'Switch to rag_search with CVE patterns. Try different file directories.'
ELSE 'Continue current strategy with reduced confidence threshold.' END AS advice, 'Cloud advisor unavailable. Continue with local reasoning. Focus on memory-unsafe patterns and recent file changes.' AS cloud, 0.55::DOUBLE AS cloud_threshold FROM x""")
def fallback_advice(spark, sf):
    return contexts(spark, sf).select("event_id", E.fallback_text(F.col("errors"), F.col("hyps")).alias("advice"), F.lit(E.CLOUD_FALLBACK).alias("cloud"), F.lit(E.CLOUD_FALLBACK_THRESHOLD).alias("cloud_threshold"))


@query("SELECT event_id, CAST(greatest(1, least(4, user_id % 9 - 2)) AS INTEGER) AS level FROM events")
def escalation_level(spark, sf):
    return T(spark, sf, "events").select("event_id", E.clamp_level((F.col("user_id") % 9 - 2).cast("int")).alias("level"))


@query(f"""WITH {CTX} SELECT event_id, coalesce(conf < 0.55, false) OR errors >= 4 OR (steps > 18 AND len(list_filter(range(0, hyps), lambda h: h >= event_id % 3)) = 0) AS triggered FROM x""")
def local_trigger(spark, sf):
    named = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("h"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    c = contexts(spark, sf)
    return c.select("event_id", E.local_trigger(F.col("conf"), F.col("errors"), F.col("steps"), named(F.col("hyps")), named((F.col("event_id") % 3).cast("int"))).alias("triggered"))


@query(f"""WITH {CTX} SELECT event_id, event_id % 13 <> 0 AND NOT (coalesce(conf < 0.45, false) AND user_id % 2 = 1) AND (coalesce(conf < 0.45, false) OR errors >= 3 OR (steps > 20 AND hyps = 0)) AS triggered FROM x""")
def cloud_trigger(spark, sf):
    return contexts(spark, sf).select("event_id", E.cloud_trigger(F.col("event_id") % 13 != 0, F.col("conf"), F.col("user_id") % 2 == 0, F.col("errors"), F.col("steps"), F.col("hyps")).alias("triggered"))


@query(f"""WITH RECURSIVE {CTX}, w AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, coalesce(conf < 0.2, false) OR (hyps = 0 AND steps > 15) OR errors > 4 AS wants FROM x),
n AS (SELECT a.user_id, a.seq, min(b.seq) AS nxt FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.wants AND b.seq >= a.seq + 5 WHERE a.wants GROUP BY 1, 2),
g AS (SELECT user_id, min(seq) AS seq FROM w WHERE wants GROUP BY 1 UNION ALL SELECT n.user_id, n.nxt FROM g JOIN n USING (user_id, seq) WHERE n.nxt IS NOT NULL)
SELECT w.event_id, w.wants, g.seq IS NOT NULL AS escalates FROM w LEFT JOIN g USING (user_id, seq)""")
def agent_escalation(spark, sf):
    c = contexts(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    wants = E.wants_escalation(F.col("conf"), F.col("errors"), F.col("steps"), F.col("hyps"), F.lit(0.2), most=4)
    return E.cooldown(c.select("event_id", "user_id", "seq", wants.alias("wants")), ["user_id"], "seq", "wants").select("event_id", "wants", "escalates")


@query("""SELECT event_id, user_id % 7 < 5 AND (event_id % 1000) / 100.0::DOUBLE + 2 * 0.5 + 0.25 <= 8 AS proceeds,
CASE WHEN (event_id % 1000) / 100.0::DOUBLE + (user_id % 50) / 100.0::DOUBLE > 5 THEN printf('Budget $%.2f would be exceeded (used: $%.4f, est: $%.4f)', 5.0::DOUBLE, (event_id % 1000) / 100.0::DOUBLE, (user_id % 50) / 100.0::DOUBLE) END AS refusal FROM events""")
def call_budget(spark, sf):
    spent, estimate = (F.col("event_id") % 1000).cast("double") / 100, (F.col("user_id") % 50).cast("double") / 100
    return T(spark, sf, "events").select("event_id", E.within_budget(F.col("user_id") % 7, 5, spent, F.lit(0.5), F.lit(0.25), 8.0).alias("proceeds"), E.over_budget(spent, estimate, F.lit(5.0)).alias("refusal"))


CRITIQUES = ("This is a False Positive, not confirmed", "the path is not reachable", "Needs more evidence, likely", "insufficient", "confirmed", "unlikely", "no opinion")


@query(f"""WITH t AS (SELECT event_id, lower({pick_sql(CRITIQUES, 'event_id')}) AS t, (event_id % 97) / 100.0::DOUBLE AS c FROM events)
SELECT event_id, round(CASE WHEN regexp_matches(t, 'false positive|not reachable') THEN c * 0.3 WHEN regexp_matches(t, 'needs more evidence|insufficient') THEN c WHEN regexp_matches(t, 'confirmed|likely') THEN least(c + 0.1, 0.95) ELSE c END, 4) AS confidence,
NOT regexp_matches(t, 'false positive|not reachable') AND regexp_matches(t, 'needs more evidence|insufficient') AS more FROM t""")
def critique_rules(spark, sf):
    confidence, more = X.critique(pick(CRITIQUES, F.col("event_id")), (F.col("event_id") % 97).cast("double") / 100)
    return T(spark, sf, "events").select("event_id", F.round(confidence, 4).alias("confidence"), more.alias("more"))


SEEN = ("all well", "VULN_CONFIRMED in a.c", "an uaf", "UAF in b.c", "CRASH at 0x1", "crash at 0x1", "heap-use-after-free", "SEGFAULT")
ERRORS = ("TimeoutError", "ValueError", "OSError", "ConnectionError", "KeyError", "RuntimeError")
VERDICTS = ("true", "Untrue", "FALSE", "It is TRUE", "yes")


@query(f"SELECT event_id, regexp_matches({pick_sql(SEEN, 'event_id')}, 'VULN_CONFIRMED|AddressSanitizer|heap-use-after-free|stack-buffer-overflow|SEGFAULT|CRASH|UAF') AS confirms FROM events")
def observation_confirms(spark, sf):
    return T(spark, sf, "events").select("event_id", X.confirms(pick(SEEN, F.col("event_id"))).alias("confirms"))


@query(f"SELECT event_id, {pick_sql(ERRORS, 'event_id')} IN ('TimeoutError', 'ConnectionError', 'OSError', 'RuntimeError') AS system FROM events")
def system_errors(spark, sf):
    return T(spark, sf, "events").select("event_id", X.is_system_error(pick(ERRORS, F.col("event_id"))).alias("system"))


@query(f"SELECT event_id, event_id % 17 <> 0 AND contains(lower({pick_sql(VERDICTS, 'event_id')}), 'true') AS verdict FROM events")
def verdict_parse(spark, sf):
    raw = F.when(F.col("event_id") % 17 != 0, pick(VERDICTS, F.col("event_id")))
    return T(spark, sf, "events").select("event_id", X.parse_verdict(raw).alias("verdict"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE substr(text, 1, 500) END AS critique, CASE WHEN turn % 5 = 4 THEN NULL ELSE substr(text || text, 1, 600) END AS plan, CASE WHEN turn % 5 = 4 THEN '' ELSE 'h0,h1,h2' END AS hypotheses, CASE WHEN turn % 5 = 4 THEN '' ELSE 'grep,read_file' END AS tools,
CASE WHEN turn % 5 <> 4 THEN greatest(0.3, least(0.8, conv_id % 11 / 10.0::DOUBLE)) END AS threshold FROM conversations""")
def advice_parse(spark, sf):
    t, none = F.col("text"), F.col("turn") % 5 == 4
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    body = F.to_json(F.struct(t.alias("critique"), F.concat(t, t).alias("plan"), words("h0", "h1", "h2", "h3").alias("hypotheses"), words("grep", "read_file", "find").alias("tools"), ((F.col("conv_id") % 11).cast("double") / 10).alias("threshold")))
    raw = F.when(none, F.lit("no advice {broken")).otherwise(F.concat(F.lit("Sure. "), body, F.lit(" Done.")))
    a = T(spark, sf, "conversations").select("conv_id", "turn", X.parse_advice(raw).alias("a"))
    return a.select("conv_id", "turn", "a.critique", "a.plan", F.array_join("a.hypotheses", ",").alias("hypotheses"), F.array_join("a.tools", ",").alias("tools"), "a.threshold")


@query("SELECT event_id, event_id % 7 NOT IN (1, 2, 3, 4, 5) AS empty FROM events")
def empty_advice(spark, sf):
    k = F.col("event_id") % 7
    some = lambda n, v: F.when(k == n, v)
    none = F.array().cast("array<string>")
    advice = F.struct(some(1, F.lit("c")).alias("critique"), F.when(k == 2, F.lit("p")).otherwise("").alias("plan"), F.when(k == 3, F.array(F.lit("h"))).otherwise(none).alias("hypotheses"), F.when(k == 4, F.array(F.lit("t"))).otherwise(none).alias("tools"), some(5, F.lit(0.5)).alias("threshold"))
    return T(spark, sf, "events").select("event_id", X.is_empty_advice(advice).alias("empty"))


MODELS = ("Llama-3-70B", "llama-405b", "Qwen-32b", "yi-34B", "llama-13b", "mistral-7b", "phi", "gemma-8B")


@query(f"""WITH m AS (SELECT p_partkey, lower({pick_sql(MODELS, 'p_partkey')}) AS m FROM part) SELECT p_partkey, CASE WHEN regexp_matches(m, '70b|405b') THEN 1.25::DOUBLE WHEN regexp_matches(m, '32b|34b') THEN 1.10 WHEN contains(m, '13b') THEN 0.90 WHEN regexp_matches(m, '8b|7b') THEN 0.75 ELSE 1.0 END AS weight FROM m""")
def name_weight(spark, sf):
    return T(spark, sf, "part").select("p_partkey", X.name_weight(pick(MODELS, F.col("p_partkey"))).alias("weight"))


NAMES = ("backtrace", "locals", "x/4i $pc", "threads")


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bt full' WHEN 1 THEN 'info locals' WHEN 2 THEN 'x/4i $pc' ELSE 'info threads' END AS command, CASE p_partkey % 2 WHEN 0 THEN 'codeql/cpp-queries:Security/CWE/CWE-416' ELSE 'own/suite.ql' END AS suite FROM part")
def presets(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select("p_partkey", X.look_up(pick(NAMES, k), X.PRESETS).alias("command"), X.look_up(pick(("use-after-free", "own/suite.ql"), k), X.BUNDLES).alias("suite"))


@query("""SELECT event_id, event_type || ':{"file":"f' || (user_id % 5) || '","line":"' || event_id || '"}' AS signature FROM events""")
def action_signature(spark, sf):
    args = F.create_map(F.lit("line"), F.col("event_id").cast("string"), F.lit("file"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")))
    return T(spark, sf, "events").select("event_id", X.action_signature(F.col("event_type"), args).alias("signature"))


def _cuts(n: int) -> str:
    out = "800 AS l0"
    for i in range(1, n + 1):
        out += f", substr(s{i}, 1, l{i - 1} // 2) AS c{i}, l{i - 1} - coalesce(length(c{i}), 0) AS l{i}"
    return out


@query(f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, CASE WHEN turn % 4 <> 3 AND text <> '' THEN CASE WHEN regexp_matches(lower(text), 'error|fail|timeout|crash') THEN '[FAIL] ' ELSE '[OK] ' END || text END AS s FROM conversations),
p AS (SELECT conv_id, {", ".join(f"max(CASE WHEN n = {i} THEN s END) AS s{i}" for i in range(1, 6))} FROM r GROUP BY 1), q AS (SELECT conv_id, {_cuts(5)} FROM p)
SELECT CAST(conv_id AS VARCHAR) AS session, CASE WHEN c1 IS NULL AND c2 IS NULL AND c3 IS NULL AND c4 IS NULL AND c5 IS NULL THEN 'No tool outputs yet.' ELSE concat_ws(chr(10), c5, c4, c3, c2, c1) END AS text FROM q""")
def tool_outputs(spark, sf):
    c = T(spark, sf, "conversations")
    return E.tool_outputs(c.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("step_num"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("observation")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[ERROR:timeout]: ' || substr(text, 1, 1000) ELSE CASE doc_id % 3 WHEN 0 THEN '[OK] Found ' || doc_id || ' potential issues' WHEN 1 THEN '[OK] Found ' || doc_id || ' items' ELSE '[OK] Success' END
|| chr(10) || substr(text, 1, 1000) || CASE WHEN length(text) > 1000 THEN '... [' || length(text) || ' chars total]' ELSE '' END END AS shown FROM documents""")
def result_text(spark, sf):
    k = F.col("doc_id")
    return T(spark, sf, "documents").select("doc_id", X.format_for_llm(k % 5 != 0, F.lit("timeout"), F.col("text"), F.when(k % 3 == 0, k), F.when(k % 3 == 1, k)).alias("shown"))


@query(f"""WITH {CHURN}, best AS (SELECT file FROM ch ORDER BY changes DESC, file LIMIT 15), au AS (SELECT file, count(DISTINCT author) AS n FROM f JOIN c USING (sha) JOIN best USING (file) GROUP BY file),
s AS (SELECT ch.file, changes, coalesce(n, 0) AS authors FROM ch LEFT JOIN au USING (file) WHERE changes >= 2), t AS (SELECT *, round(changes * (1 + sqrt(authors)), 1) AS score, CASE WHEN changes > 10 AND authors > 3 THEN 'CRITICAL' WHEN changes > 5 AND authors > 2 THEN 'HIGH' WHEN changes > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s ORDER BY score DESC, file LIMIT 10)
SELECT printf('%-45s %6s %5s %8s %6s', 'File', 'Churn', 'Auth', 'Risk', 'Score') || chr(10) || repeat('-', 72) || chr(10) || string_agg(printf('%-45s %6d %5d %8s %6.1f', file, changes, authors, risk, score), chr(10) ORDER BY score DESC, file)
|| chr(10) || chr(10) || 'Churn = commits touching the file in the analysis window.' || chr(10) || 'Score = churn × (1 + √authors)  (coordination complexity).' || chr(10) || 'CRITICAL (>10 churn, >3 authors) → audit before fuzzing.' AS text FROM t""")
def hotspot_table(spark, sf):
    return H.table(H.hotspots(*churn_and_authors(spark, sf)))


@query("SELECT user_id AS session, array_to_string(list(event_type ORDER BY n), ',') AS tools FROM (SELECT user_id, event_type, min(event_id) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def failed_tools(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.col("event_id").alias("seq"))
    return C.distinct_tools(e).withColumn("tools", F.array_join("tools", ","))


@query("SELECT event_type AS name, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(floor(value)), 1) AS total_ms, round(sum(floor(value)) / count(*), 1) AS avg_ms FROM events GROUP BY 1")
def advisor_metrics(spark, sf):
    return M.advisor_metrics(calls(spark, sf).withColumn("latency_ms", F.floor("latency_ms").cast("double")))


@query("""WITH g AS (SELECT user_id AS id, list(event_type ORDER BY event_id) AS path, list(event_type ORDER BY event_id) FILTER (event_type = 'error') AS bad, CAST(sum(floor(value)) AS BIGINT) AS total_ms, arg_max(event_type, event_id) AS final FROM events GROUP BY 1)
SELECT id, array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS attempted, coalesce(array_to_string(list_transform(bad, lambda x: x || ': timeout'), ','), '') AS failures, CASE WHEN final = 'purchase' THEN final END AS winner, total_ms FROM g""")
def cascade_summary(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.col("value").alias("ms"), F.when(failed(), F.lit("timeout")).alias("error"), (F.col("event_type") == "purchase").alias("answered"))
    return M.cascade_summary(e).withColumns({"path": F.array_join("path", ">"), "failures": F.array_join("failures", ",")})


@query("SELECT count(DISTINCT event_type) AS chain_length, count(DISTINCT event_type) FILTER (event_type NOT IN ('error', 'view')) AS active, 'error,view' AS disabled FROM events")
def chain_state(spark, sf):
    c = calls(spark, sf)
    return M.chain_state(c, c.where("name IN ('error', 'view')").select("name").distinct()).withColumn("disabled", F.array_join("disabled", ","))


@query("""SELECT 'with' AS voters, CASE WHEN count(*) FILTER (event_type IN ('view', 'none')) > 0 THEN 0.6::DOUBLE ELSE 0.75 END AS threshold FROM events UNION ALL SELECT 'without', CASE WHEN count(*) FILTER (event_type IN ('none')) > 0 THEN 0.6 ELSE 0.75 END FROM events UNION ALL SELECT 'override', 0.9""")
def vote_threshold(spark, sf):
    m = T(spark, sf, "events").select(F.col("event_type").alias("model")).distinct()
    rows = [("with", C.threshold_for(m, ("view", "none"))), ("without", C.threshold_for(m, ("none",))), ("override", C.threshold_for(m, (), 0.9))]
    return spark.createDataFrame(rows, "voters string, threshold double")


def answered(spark, sf):
    return votes(spark, sf).withColumn("error", F.when(F.col("model") == "error", F.lit("timeout")))


@query(f"WITH {VOTES}, n AS (SELECT h, count(DISTINCT m) AS voters FROM v WHERE m <> 'error' GROUP BY h) SELECT h AS hypothesis, m AS model, yes AS verdict, voters, count(*) AS n FROM v JOIN n USING (h) WHERE m <> 'error' GROUP BY ALL")
def gathered_votes(spark, sf):
    return C.gathered(answered(spark, sf)).groupBy("hypothesis", "model", "verdict", "voters").agg(F.count("*").alias("n"))


@query(f"WITH {VOTES} SELECT h AS hypothesis, round(sum(CASE WHEN yes AND m <> 'error' THEN w ELSE 0 END) / sum(w), 4) AS weighted, round(avg(CASE WHEN m = 'error' THEN 0 ELSE c END), 4) AS confidence FROM v GROUP BY h")
def neutral_votes(spark, sf):
    v = C.neutral(answered(spark, sf))
    mean = v.groupBy("hypothesis").agg(F.round(F.avg("confidence"), 4).alias("confidence"))
    return C.consensus(v).select("hypothesis", F.round("weighted", 4).alias("weighted")).join(mean, "hypothesis")


@query("WITH l AS (SELECT user_id % 40 AS idx, arg_max(value >= 245, event_id) AS verdict FROM events GROUP BY 1) SELECT n_name AS hypothesis, verdict FROM nation JOIN l ON idx = n_nationkey + 1")
def votes_by_position(spark, sf):
    v = T(spark, sf, "events").select((F.col("user_id") % 40).alias("idx"), (F.col("value") >= 245).alias("verdict"), F.col("event_id").alias("ord"))
    return C.by_position(v, T(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("pos"), F.col("n_name").alias("hypothesis")))


@query("""WITH b AS (SELECT event_id, ['t' || (event_id % 4), 't' || (user_id % 6), 't' || (event_id % 9)] AS s FROM events)
SELECT event_id, array_to_string((list_filter(s, lambda x, i: x IN ('t0', 't1', 't2', 't3') AND list_position(s, x) = i))[1:2], ',') AS known, array_to_string(list_filter(s, lambda x, i: x NOT IN ('t0', 't1', 't2', 't3') AND list_position(s, x) = i), ',') AS unknown FROM b""")
def tool_choice(spark, sf):
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    said = F.array(name(F.col("event_id") % 4), name(F.col("user_id") % 6), name(F.col("event_id") % 9))
    known, unknown = C.tool_choice(said, F.array(*[F.lit(f"t{i}") for i in range(4)]))
    return T(spark, sf, "events").select("event_id", F.array_join(known, ",").alias("known"), F.array_join(unknown, ",").alias("unknown"))


ADVISORS = "v AS (SELECT 's' || s_suppkey AS name, s_suppkey % 3 = 0 AS net FROM supplier), u AS (SELECT name FROM v WHERE NOT net)"


@query(f"""WITH {ADVISORS}, w AS (SELECT p_partkey AS id, 's' || (p_partkey % 40) AS primary_, 's' || (p_partkey % 7) AS fallback_, ['s' || (p_partkey % 9), 'x', 's' || (p_partkey % 4)] AS chain FROM part),
l AS (SELECT id, unnest(chain) AS name, unnest([1, 2, 3]) AS pos FROM w), g AS (SELECT id, list(name ORDER BY pos) AS kept FROM l WHERE name IN (SELECT name FROM u) GROUP BY 1)
SELECT w.id, coalesce(p.name, f.name, g.kept[1]) AS advisor, coalesce(array_to_string(g.kept, ','), '') AS usable_chain FROM w LEFT JOIN u p ON p.name = primary_ LEFT JOIN u f ON f.name = fallback_ LEFT JOIN g USING (id)""")
def advisor_choice(spark, sf):
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k = F.col("p_partkey")
    wanted = T(spark, sf, "part").select(k.alias("id"), name(k % 40).alias("primary"), name(k % 7).alias("fallback"), F.array(name(k % 9), F.lit("x"), name(k % 4)).alias("chain"))
    known = T(spark, sf, "supplier").select(name(F.col("s_suppkey")).alias("name"), (F.col("s_suppkey") % 3 == 0).alias("requires_network"))
    return RT.resolve_advisors(wanted, known, air_gapped=True).withColumn("usable_chain", F.array_join("usable_chain", ","))


@query("""WITH a AS (SELECT user_id AS id, event_type AS name, event_id AS pos, event_type = 'view' AS net, (user_id % 10) / 10.0::DOUBLE AS conf, event_type <> 'error' AS enabled, value > 100 AS triggered, value < 250 AS empty FROM events),
r AS (SELECT id, name, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM a WHERE enabled AND triggered AND NOT empty AND (net OR conf >= 0.3)) SELECT id, name, pos FROM r WHERE n = 1""")
def cascade_answer(spark, sf):
    v = F.col("value")
    a = T(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"), (F.col("event_type") == "view").alias("requires_network"),
        ((F.col("user_id") % 10).cast("double") / 10).alias("confidence"), (~failed()).alias("enabled"), (v > 100).alias("triggered"), (v < 250).alias("empty"),
    )
    return RT.cascade(a).select("id", "name", "pos")


@query(f"WITH {VOTES} SELECT CAST(h AS VARCHAR) AS hypothesis, CAST(NULL AS VARCHAR) AS description, true AS verified FROM v GROUP BY h HAVING sum(CASE WHEN yes THEN 1 ELSE 0 END) / count(DISTINCT m) >= 0.67 UNION ALL SELECT n_name, n_name || ' found', NULL FROM nation")
def confirmed_findings(spark, sf):
    found = T(spark, sf, "nation").select(F.col("n_name").alias("hypothesis"), F.concat("n_name", F.lit(" found")).alias("description"))
    ratio = C.plain_ratio(votes(spark, sf).withColumn("hypothesis", F.col("hypothesis").cast("string")))
    return C.with_confirmed(found, ratio.where("confirmed").withColumnRenamed("key", "hypothesis"))


@query("""WITH b AS (SELECT event_id, ['h' || (event_id % 3), 'h' || (user_id % 4), 'h' || (event_id % 5), 'h' || (event_id % 3)] AS s FROM events) SELECT event_id, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS ends FROM b""")
def dead_ends(spark, sf):
    name = lambda c: F.concat(F.lit("h"), c.cast("string"))
    i, u = F.col("event_id"), F.col("user_id")
    return T(spark, sf, "events").select("event_id", F.array_join(C.dead_ends(F.array(name(i % 3), name(u % 4)), F.array(name(i % 5), name(i % 3))), ",").alias("ends"))
