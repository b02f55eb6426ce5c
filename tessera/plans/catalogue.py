"""All queries of the engine and their SQL. Tables play roles: events are calls and votes, orders and lineitem commits, documents texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consensus as C
from ..operators import eventlog as E
from ..operators import graph as G
from ..operators import hotspots as H
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import routing as RT
from ..operators import vector as V
from ..sources import files as SRC
from ..sources.shared import scratch
from ..streaming import steps as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ERR = "(event_type = 'error')"


def failed():
    return F.col("event_type") == "error"


def calls(spark, sf):
    e = T(spark, sf, "events")
    return e.select(F.col("event_type").alias("name"), "ts", "event_id", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.when(failed(), F.lit("timeout")).alias("error_type"))


# ---- vectors

DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
COS = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})"


@query(f"SELECT a.vec_id, round({COS}, 4) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {COS} DESC, a.vec_id LIMIT 10")
def vector_topk(spark, sf):
    e = T(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return V.similarity_search(e, q, 10).select("vec_id", F.round("score", 4).alias("score"))


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vector_topk_batch(spark, sf):
    e = T(spark, sf, "embeddings")
    out = V.batch_search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)
    return out.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(f"SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / {NORM.format('a')}, 4) AS total, round({NORM.format('a')}, 4) AS length FROM embeddings a")
def vector_normalize(spark, sf):
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.aggregate(V.normalise(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


HEX = "(strpos('0123456789abcdef', substr(sha256({0}), (i % 64) + 1, 1)) - 1) / 15.0::DOUBLE - 0.5::DOUBLE"


@query(f"SELECT doc_id, round(list_sum(list_transform(range(0, 384), lambda i: ({HEX.format('text')}) * (i + 1))), 4) AS fold FROM documents")
def hash_embedding(spark, sf):
    v = V.hash_embedding(F.col("text"))
    fold = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return T(spark, sf, "documents").select("doc_id", F.round(fold, 4).alias("fold"))


VEC = f"list_transform(range(0, 64), lambda i: {HEX.format('{0}')})"
SIM = "list_sum(list_transform(range(1, 65), lambda i: v[i] * q[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x)))"


@query(f"""WITH q AS (SELECT {VEC.format("'use after free'")} AS q),
i AS (SELECT doc_id::VARCHAR AS id, text, {SIM} AS score FROM (SELECT doc_id, text, {VEC.format('text')} AS v FROM documents), q),
c AS (SELECT 'ctx_' || item_id AS id, text, {SIM} AS score FROM (SELECT item_id, text, {VEC.format('text')} AS v FROM benchmark), q),
ci AS (SELECT * FROM c WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 5), ii AS (SELECT * FROM i ORDER BY score DESC, id LIMIT 24),
u AS (SELECT id, text, least(score + 0.05, 1.0) AS score, 0 AS src FROM ci UNION ALL SELECT id, text, score, 1 FROM ii),
m AS (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY src, score DESC, id) AS n FROM u),
t AS (SELECT * FROM m WHERE n = 1 ORDER BY score DESC, id LIMIT 8)
SELECT id, substr(text, 1, 500) AS text, round(score, 4) AS score, src FROM t WHERE score >= 0.2 AND length(text) >= 20""")
def rag_search(spark, sf):
    docs, ctx = T(spark, sf, "documents"), T(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return R.rag_search(docs, ctx, "use after free", 8, 0.2)


WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"


@query(rf"""SELECT DISTINCT k AS keyword, doc_id AS pointer FROM (SELECT doc_id, unnest(list_filter(({WORDS})[1:3], lambda w: length(w) > 3)) AS k FROM documents)""")
def evidence_index(spark, sf):
    return R.evidence_index(T(spark, sf, "documents").select(F.col("doc_id").alias("pointer"), F.col("text").alias("fragment")))


@query(rf"""SELECT doc_id AS pointer, n_chars FROM documents WHERE list_contains(list_filter(({WORDS})[1:3], lambda w: length(w) > 3), 'that')""")
def evidence_find(spark, sf):
    d, path = T(spark, sf, "documents"), scratch(spark, "evidence")
    said = d.select(F.col("doc_id").alias("pointer"), F.col("text").alias("fragment"))
    R.put_evidence(said.where("pointer % 2 = 0"), path)
    R.put_evidence(said.where("pointer % 2 = 1"), path, 1)
    return R.find_evidence(spark, path, "That", "long").join(d.select(F.col("doc_id").alias("pointer"), "n_chars"), "pointer").select("pointer", "n_chars")


# ---- texts


def _scrub_sql(rules: str) -> str:
    out = "text"
    for p, r in X.SCRUB_RULES[rules]:
        flags = "gi" if p.startswith("(?i)") else "g"
        new = r.replace("$1", "\\1") if "$1" in r else r.replace("\\\\", "\\").replace("\\", "\\\\")
        out = f"regexp_replace({out}, '{p.removeprefix('(?i)')}', '{new}', '{flags}')"
    return f"SELECT doc_id, md5({out}) AS scrubbed FROM documents"


def _scrub(rules):
    def f(spark, sf):
        return T(spark, sf, "documents").select("doc_id", F.md5(X.scrub(F.col("text"), rules)).alias("scrubbed"))

    f.__name__ = f"scrub_{rules}"
    query(_scrub_sql(rules))(f)


for _r in X.SCRUB_RULES:
    _scrub(_r)


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [TRUNCATED]' ELSE text END AS head,
CASE WHEN length(text) > 100 THEN left(text, 60) || ' ... ' || right(text, 40) ELSE text END AS middle, length(text) // 4 AS tokens FROM documents""")
def truncation(spark, sf):
    t = F.col("text")
    return T(spark, sf, "documents").select("doc_id", X.truncate(t, 200).alias("head"), X.middle_cut(t, 60, 40).alias("middle"), X.token_estimate(t).alias("tokens"))


@query("SELECT doc_id, substr(sha256(source || ':' || doc_id), 1, 12) AS key12, substr(sha256(text), 1, 32) AS key32 FROM documents")
def checkpoint_keys(spark, sf):
    return T(spark, sf, "documents").select("doc_id", X.sha_prefix(F.concat_ws(":", "source", "doc_id"), 12).alias("key12"), X.sha_prefix(F.col("text"), 32).alias("key32"))


@query("""WITH m AS (SELECT p_partkey, p_name || ' ' || ['Q2', 'Q4', 'Q5', 'Q8', 'F16', 'none'][(p_partkey % 6) + 1] AS name, p_retailprice AS size FROM part)
SELECT p_partkey, round(size * CASE WHEN upper(name) LIKE '%Q2%' THEN 1.1 WHEN upper(name) LIKE '%Q3%' THEN 1.15 WHEN upper(name) LIKE '%Q4%' THEN 1.2 WHEN upper(name) LIKE '%Q5%' THEN 1.25
WHEN upper(name) LIKE '%Q6%' THEN 1.3 WHEN upper(name) LIKE '%Q8%' THEN 1.5 WHEN upper(name) LIKE '%F16%' THEN 2.1 WHEN upper(name) LIKE '%F32%' THEN 4.0 ELSE 1.5 END, 3) AS ram FROM m""")
def ram_estimate(spark, sf):
    quant = F.element_at(F.array(*[F.lit(x) for x in ("Q2", "Q4", "Q5", "Q8", "F16", "none")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return T(spark, sf, "part").select("p_partkey", F.round(X.ram_estimate(F.concat_ws(" ", "p_name", quant), F.col("p_retailprice")), 3).alias("ram"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'error|fail|timeout|crash') AS is_error, regexp_matches(text, 'VULN_CONFIRMED|CRITICAL_PATH|heap-use-after-free|AddressSanitizer|stack-buffer-overflow') AS essential,
CASE WHEN regexp_matches(lower(text), 'auth|api key|unauthorized|401|403|not found|model unavailable|connection refused') THEN 'CRITICAL'
WHEN regexp_matches(lower(text), 'timeout|rate limit|429|503|connection reset|temporarily|congestion') THEN 'TRANSIENT' ELSE 'RECOVERABLE' END AS class FROM conversations""")
def observation_flags(spark, sf):
    t = F.col("text")
    return T(spark, sf, "conversations").select("conv_id", "turn", X.is_error(t).alias("is_error"), X.is_essential(t).alias("essential"), X.error_class(t).alias("class"))


@query("""WITH s AS (SELECT event_id, '/src/./' || event_type || '//' || (user_id % 7) || '.c' AS p FROM events)
SELECT event_id, replace(replace(p, '/./', '/'), '//', '/') AS path, regexp_extract(p, '([0-9]+)\\.c$', 1) AS stem FROM s""".replace("\\\\", "\\"))
def normal_paths(spark, sf):
    p = F.concat(F.lit("/src/./"), "event_type", F.lit("//"), (F.col("user_id") % 7).cast("string"), F.lit(".c"))
    return T(spark, sf, "events").select("event_id", X.normal_path(p).alias("path"), X.stem(p).alias("stem"))


@query("SELECT event_id, greatest(0.3, least(0.8, value / 300)) AS clamped, least(0.5 * power(2.0, user_id % 8), 20.0) AS delay FROM events")
def clamp_and_backoff(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", X.clamp((F.col("value") / 300).cast("string"), 0.3, 0.8).alias("clamped"), X.backoff(F.col("user_id") % 8 + 1, 0.5, 20.0).alias("delay"))


@query("""SELECT event_id, event_type AS action, round(value / 1000, 6) AS confidence FROM events""")
def action_parse(spark, sf):
    e = T(spark, sf, "events")
    raw = F.concat(F.lit("thinking... "), F.to_json(F.struct(F.col("event_type").alias("action"), (F.col("value") / 1000).alias("confidence"))), F.lit(" done"))
    return e.select("event_id", X.parse_action(raw).alias("a")).select("event_id", "a.action", F.round("a.confidence", 6).alias("confidence"))


# ---- history: lineitem are files of commits, orders are commits


def commits(spark, sf):
    return T(spark, sf, "orders").select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("o_orderpriority").alias("subject"), F.col("o_orderdate").alias("ts"))


def commit_files(spark, sf):
    return T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("src/f"), (F.col("l_partkey") % 60).cast("string"), F.lit(".c")).alias("file"))


COMMITS = "c AS (SELECT o_orderkey AS sha, 'a' || (o_custkey % 40) AS author, o_orderpriority AS subject, o_orderdate AS ts FROM orders), f AS (SELECT l_orderkey AS sha, 'src/f' || (l_partkey % 60) || '.c' AS file FROM lineitem)"
CHURN = COMMITS + ", n AS (SELECT sha FROM c ORDER BY ts DESC, sha LIMIT 100), ch AS (SELECT file, count(*) AS changes FROM f JOIN n USING (sha) GROUP BY file)"


@query(f"WITH {COMMITS} SELECT sha, author, subject FROM c WHERE regexp_matches(author, '^a1') AND regexp_matches(subject, 'HIGH|URGENT') ORDER BY ts DESC, sha LIMIT 25")
def commit_log(spark, sf):
    return H.commit_log(commits(spark, sf), 25, author="^a1", grep="HIGH|URGENT").select("sha", "author", "subject")


@query(f"WITH {CHURN} SELECT file, changes FROM ch")
def churn_by_file(spark, sf):
    return H.churn(commits(spark, sf), commit_files(spark, sf))


def churn_and_authors(spark, sf):
    c, f = commits(spark, sf), commit_files(spark, sf)
    return H.churn(c, f), f.join(c, "sha").select("file", "author")


@query(f"""WITH {CHURN}, best AS (SELECT file FROM ch ORDER BY changes DESC, file LIMIT 15),
au AS (SELECT file, count(DISTINCT author) AS n, array_to_string((list_sort(list_distinct(list(author))))[1:3], ',') AS top FROM f JOIN c USING (sha) JOIN best USING (file) GROUP BY file),
s AS (SELECT ch.file, changes, coalesce(n, 0) AS authors, coalesce(top, '') AS top FROM ch LEFT JOIN au USING (file) WHERE changes >= 2)
SELECT file, changes, authors, round(changes * (1 + sqrt(authors)), 1) AS score, CASE WHEN changes > 10 AND authors > 3 THEN 'CRITICAL' WHEN changes > 5 AND authors > 2 THEN 'HIGH' WHEN changes > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, top
FROM s ORDER BY round(changes * (1 + sqrt(authors)), 1) DESC, file LIMIT 10""")
def hotspots(spark, sf):
    out = H.hotspots(*churn_and_authors(spark, sf))
    return out.select("file", "changes", "authors", "score", "risk", F.array_join("top_authors", ",").alias("top"))


@query(f"WITH {COMMITS} SELECT file, array_to_string((list_sort(list_distinct(list(author))))[1:10], ',') AS authors FROM f JOIN c USING (sha) GROUP BY file")
def top_authors(spark, sf):
    return H.authors_of(commit_files(spark, sf).join(commits(spark, sf), "sha"), ["file"], F.col("author")).select("file", F.array_join("authors", ",").alias("authors"))


@query(f"WITH {COMMITS} SELECT count(DISTINCT file) AS files FROM f WHERE file LIKE '%.c'")
def files_scanned(spark, sf):
    return commit_files(spark, sf).where(H.has_extension(F.col("file"))).agg(F.countDistinct("file").alias("files"))


@query(f"WITH {COMMITS} SELECT CAST(sha AS VARCHAR) AS sha, author, subject FROM c")
def log_parse(spark, sf):
    line = F.concat_ws("|", F.col("sha").cast("string"), "author", F.concat("author", F.lit("@example.org")), "subject")
    return H.parse_log(commits(spark, sf).select(line.alias("value"))).select("sha", "author", "subject")


# ---- call metrics: events are calls


@query(f"SELECT event_type AS name, count(*) AS calls, count(*) FILTER (NOT {ERR}) AS successes, round(count(*) FILTER (NOT {ERR}) / count(*), 4) AS success_rate, round(avg(value), 4) AS avg_ms FROM events GROUP BY 1")
def tool_metrics(spark, sf):
    return M.tool_metrics(calls(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 4))


@query(f"SELECT count(*) AS total, count(*) FILTER ({ERR}) AS timeouts, 0::BIGINT AS errors FROM events")
def tool_totals(spark, sf):
    return M.totals(calls(spark, sf))


@query("""SELECT b.bucket, count(e.value) AS calls FROM (VALUES ('[0,100)', 0, 100), ('[100,500)', 100, 500), ('[500,1000)', 500, 1000), ('[1000,5000)', 1000, 5000), ('[5000,inf)', 5000, 1e18)) b(bucket, lo, hi)
LEFT JOIN events e ON e.value >= b.lo AND e.value < b.hi GROUP BY 1""")
def latency_histogram(spark, sf):
    return M.latency_histogram(calls(spark, sf))


@query(f"SELECT event_type AS name, count(*) AS calls, round(sum(CASE WHEN {ERR} THEN 0 ELSE value END) / count(*), 4) AS avg_ms FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND GROUP BY 1")
def recent_window(spark, sf):
    c = calls(spark, sf)
    now = c.agg(F.max("ts")).first()[0]
    return M.recent(c, F.lit(now).cast("timestamp_ntz"), 86400).withColumn("avg_ms", F.round("avg_ms", 4))


@query(f"SELECT user_id AS session, count(*) AS steps, count(DISTINCT event_type) AS actions, count(*) FILTER ({ERR}) AS errors, round(avg(value), 4) AS avg_confidence FROM events GROUP BY 1")
def session_metrics(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("action"), F.col("event_type").alias("observation"), F.col("value").alias("confidence"))
    return M.session_metrics(e).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query("SELECT l_shipdate IS NOT NULL AS shipped, l_returnflag AS model, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens_in, CAST(sum(l_linenumber) AS BIGINT) AS tokens_out, round(avg(l_tax), 1) AS avg_ms, round(sum(l_linenumber) / (sum(l_tax) / 1000), 2) AS tokens_per_s FROM lineitem GROUP BY ALL")
def token_metrics(spark, sf):
    r = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("tokens_in"), F.col("l_linenumber").alias("tokens_out"), F.col("l_tax").alias("ms"))
    return M.token_metrics(r).select(F.lit(True).alias("shipped"), "model", "calls", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), "avg_ms", F.round("tokens_per_s", 2).alias("tokens_per_s"))


# ---- event logs: a user is a session, in order of ts and event_id

O = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
STREAK = f"""s0 AS (SELECT *, CASE WHEN {ERR} THEN 1 ELSE 0 END AS bad, sum(CASE WHEN {ERR} THEN 0 ELSE 1 END) OVER {O} AS isle FROM events),
s AS (SELECT *, CAST(sum(bad) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM s0)"""


@query(f"WITH {STREAK} SELECT event_id, streak FROM s")
def failure_streak(spark, sf):
    return E.failure_streak(T(spark, sf, "events"), ["user_id"], ["ts", "event_id"], failed()).select("event_id", "streak")


@query(f"WITH {STREAK} SELECT user_id, max(streak) AS max_streak, max(streak) >= 3 AS looped FROM s GROUP BY 1")
def loop_flag(spark, sf):
    return E.loops(T(spark, sf, "events"), ["user_id"], ["ts", "event_id"], failed())


@query(f"""WITH {STREAK}, w AS (SELECT event_id, coalesce(lag(streak) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS idle FROM s)
SELECT event_id, CASE WHEN before < 2 THEN 'closed' WHEN idle > 7200 THEN 'half_open' ELSE 'open' END AS state FROM w""")
def circuit_state(spark, sf):
    return E.circuit(T(spark, sf, "events"), ["user_id"], ["ts", "event_id"], failed(), limit=2, rest_s=7200).select("event_id", "state")


@query(f"SELECT event_id, round(sum(value) OVER {O}, 3) AS running FROM events")
def running_cost(spark, sf):
    return E.running_total(T(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("running", 3).alias("running"))


@query("SELECT user_id AS session, event_type AS file, round(sum(value), 3) AS usd FROM events GROUP BY ROLLUP (user_id, event_type) HAVING user_id IS NOT NULL")
def cost_by_file(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.col("value").alias("usd"))
    return E.cost_by_file(e).withColumn("usd", F.round("usd", 3))


@query("SELECT user_id AS session, event_type AS file, round(sum(value), 3) AS usd FROM events GROUP BY 1, 2 HAVING sum(value) >= 800")
def costly_files(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.col("value").alias("usd"), F.col("event_id").alias("seq"))
    return E.costly_files(e, 800).withColumn("usd", F.round("usd", 3))


@query("""WITH f AS (SELECT user_id AS session, event_type AS file, sum(value) AS usd, min(event_id) AS first FROM events GROUP BY 1, 2 HAVING sum(value) > 900),
o AS (SELECT * FROM f WHERE NOT (session % 3 = 0 AND file IN ('click', 'view'))), b AS (SELECT session, arg_min(file, first) AS file FROM o GROUP BY 1),
t AS (SELECT user_id AS session FROM events GROUP BY 1 HAVING sum(value) > 3000)
SELECT session, file, 'file' AS reason FROM b UNION ALL SELECT session, NULL, 'total' FROM t WHERE session % 3 <> 0 AND session NOT IN (SELECT session FROM b)""")
def cost_escalation(spark, sf):
    """Observations of every third session name two files within their first 50 characters, and a third one after them."""
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.col("value").alias("usd"), F.col("event_id").alias("seq"))
    sure = e.where("session % 3 = 0").select("session").distinct().withColumn("observation", F.lit("VULN_CONFIRMED in click and view handlers, " + 20 * "." + " purchase"))
    return E.cost_escalation(e, sure, 900, 3000, E.exact_sum)


@query("""WITH x AS (SELECT event_id, user_id, ts, value, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM events)
SELECT user_id AS session, event_id AS seq, CASE WHEN step = 'view' THEN 'f_view' END AS file, value AS usd FROM x JOIN events USING (event_id, user_id, ts, value) WHERE event_type = 'error'""")
def cost_attribution(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "event_type", F.col("value").alias("usd"))
    steps = e.where("event_type <> 'error'").select("session", "seq", F.when(F.col("event_type") == "view", "read_file").otherwise(F.col("event_type")).alias("action"), F.concat(F.lit("f_"), "event_type").alias("file"))
    return E.attribute_cost(steps, e.where("event_type = 'error'").select("session", "seq", F.lit(None).cast("string").alias("file"), "usd"))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, CAST(back AS INTEGER) AS back, back <= 2 AS verbose FROM r WHERE back <= 6")
def history_window(spark, sf):
    return E.last_n(T(spark, sf, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "back", "verbose")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) > 1000) DESC, turn DESC) AS n FROM conversations) SELECT conv_id, turn FROM r WHERE n <= 4")
def essential_steps(spark, sf):
    return E.essential_first(T(spark, sf, "conversations"), ["conv_id"], ["turn"], F.length("text") > 1000, 4).select("conv_id", "turn")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_confidence(spark, sf):
    return E.last_value(T(spark, sf, "events"), ["user_id"], "event_id", "value")


@query(f"""WITH k AS (SELECT *, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'view' AND value > 480 THEN 'critical' WHEN event_type = 'signup' THEN 'recoverable' ELSE 'ok' END AS kind FROM events),
c AS (SELECT *, sum(CASE WHEN kind IN ('timeout', 'recoverable') THEN 1 ELSE 0 END) OVER {O} AS n FROM k)
SELECT event_id, max(CASE WHEN kind = 'critical' OR (kind = 'timeout' AND n >= 2) THEN 1 ELSE 0 END) OVER {O} = 1 AS disabled FROM c""")
def cascade_disabled(spark, sf):
    e = T(spark, sf, "events")
    kind = F.when(failed(), "timeout").when((F.col("event_type") == "view") & (F.col("value") > 480), "critical").when(F.col("event_type") == "signup", "recoverable").otherwise("ok")
    return E.disabled_after(e.withColumn("kind", kind), ["user_id"], ["ts", "event_id"], "kind").select("event_id", "disabled")


@query("""SELECT event_id, value / 500 < 0.5 OR user_id % 6 >= 3 OR (event_id % 30 > 15 AND user_id % 4 = 0) AS rule,
(user_id % 5 = 0) AND (value / 500 < 0.5 OR event_id % 4 = 0 OR user_id % 6 > 5) AND user_id % 4 < 4 AS further, CASE user_id % 5 WHEN 1 THEN 0.65::DOUBLE WHEN 2 THEN 0.60 WHEN 3 THEN 0.55 WHEN 4 THEN 0.50 ELSE 0.60 END AS threshold FROM events""")
def triggers(spark, sf):
    u, c, i = F.col("user_id"), F.col("value") / 500, F.col("event_id")
    return T(spark, sf, "events").select(
        "event_id", E.rule_trigger(c, u % 6, i % 30, u % 4).alias("rule"), E.escalate_further(u % 5, c, i % 4, u % 6, u % 4).alias("further"), E.level_threshold(u % 5).alias("threshold"),
    )


@query("""WITH RECURSIVE w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value < 150 AS wants FROM events),
n AS (SELECT a.user_id, a.seq, min(b.seq) AS nxt FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.wants AND b.seq >= a.seq + 5 WHERE a.wants GROUP BY 1, 2),
g AS (SELECT user_id, min(seq) AS seq FROM w WHERE wants GROUP BY 1 UNION ALL SELECT n.user_id, n.nxt FROM g JOIN n USING (user_id, seq) WHERE n.nxt IS NOT NULL)
SELECT w.user_id, w.event_id, CAST(w.seq AS INTEGER) AS seq, w.wants, g.seq IS NOT NULL AS escalates FROM w LEFT JOIN g USING (user_id, seq)""")
def escalation_cooldown(spark, sf):
    e = T(spark, sf, "events").withColumn("wants", F.col("value") < 150)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return E.cooldown(e.select("user_id", "event_id", seq.alias("seq"), "wants"), ["user_id"], "seq", "wants")


@query(f"""WITH x AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER {O} AS isle, CASE WHEN {ERR} THEN 1 ELSE 0 END AS bad FROM events)
SELECT event_id, CAST(sum(bad) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM x""")
def error_counter(spark, sf):
    return E.error_counter(T(spark, sf, "events"), ["user_id"], ["ts", "event_id"], failed(), F.col("event_type") == "purchase").select("event_id", "errors")


@query("""SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 3 = 0 AS essential FROM conversations""")
def mark_last_step(spark, sf):
    c = T(spark, sf, "conversations").select("conv_id", "turn").withColumn("essential", F.lit(False))
    return E.mark_last(c, ["conv_id"], ["turn"], "essential", c.where("conv_id % 3 = 0").select("conv_id"))


@query(f"""WITH f AS (SELECT user_id AS session, event_type AS file, sum(value) AS usd FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY usd DESC, file) AS n FROM f WHERE usd >= 0.5),
t AS (SELECT session, string_agg(printf('%s ($%.2f)', file, usd), ', ' ORDER BY n) AS files FROM r WHERE n <= 3 GROUP BY 1), s AS (SELECT user_id AS session, count(*) AS steps, count(*) FILTER ({ERR}) AS errors, sum(value) AS usd FROM events GROUP BY 1)
SELECT session, printf('%d steps, %d errors, $%.2f; %s', steps, errors, usd, coalesce(files, 'no costly file')) AS report FROM s LEFT JOIN t USING (session)""")
def session_report(spark, sf):
    e = T(spark, sf, "events")
    return E.summary(e.select(F.col("user_id").alias("session"), F.col("event_type").alias("observation")), e.select(F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.col("value").alias("usd")), E.exact_sum)


# ---- votes: user_id is a hypothesis, event_type a model

VOTES = "v AS (SELECT user_id AS h, event_type AS m, value >= 245 AS yes, CASE event_type WHEN 'view' THEN 1.25 WHEN 'click' THEN 0.9 ELSE 1.0 END AS w, value / 500 AS c FROM events)"
CONS = VOTES + ", c AS (SELECT h, sum(CASE WHEN yes THEN w ELSE 0 END) / sum(w) AS weighted, avg(CASE WHEN yes THEN 1.0 ELSE 0.0 END) AS ratio FROM v GROUP BY h)"
STATUS = "CASE WHEN weighted >= 0.55 THEN 'confirmed' WHEN ratio < 0.3 AND weighted < 0.4 THEN 'rejected' ELSE 'undecided' END"


def votes(spark, sf):
    e = T(spark, sf, "events").select(F.col("user_id").alias("hypothesis"), F.col("event_type").alias("model"), (F.col("value") >= 245).alias("verdict"), (F.col("value") / 500).alias("confidence"), "event_id")
    return C.vote_weights(e, spark.createDataFrame([("view", 1.25), ("click", 0.9)], "model string, weight double"))


@query(f"WITH {CONS} SELECT h AS hypothesis, round(weighted, 4) AS weighted, round(ratio, 4) AS ratio, {STATUS} AS status FROM c")
def consensus(spark, sf):
    return C.consensus(votes(spark, sf), 0.55).withColumns({"weighted": F.round("weighted", 4), "ratio": F.round("ratio", 4)})


@query(f"WITH {CONS} SELECT round(sum(weighted) / (count(*) + 25), 6) AS weighted, round(sum(ratio) / (count(*) + 25), 6) AS ratio FROM c")
def consensus_mean(spark, sf):
    """All hypotheses that have votes, and one a nation that has none."""
    v = votes(spark, sf)
    named = v.select("hypothesis").distinct().unionByName(T(spark, sf, "nation").select((-1 - F.col("n_nationkey")).alias("hypothesis")))
    out = C.consensus_mean(v, named, 0.55)
    return out.withColumns({"weighted": F.round("weighted", 6), "ratio": F.round("ratio", 6)})


@query(f"WITH {VOTES} SELECT CAST(h AS VARCHAR) AS key, round(sum(CASE WHEN yes THEN 1 ELSE 0 END) / count(DISTINCT m), 4) AS ratio, sum(CASE WHEN yes THEN 1 ELSE 0 END) / count(DISTINCT m) >= 0.67 AS confirmed FROM v GROUP BY h")
def swarm_ratio(spark, sf):
    return C.plain_ratio(votes(spark, sf).withColumn("hypothesis", F.col("hypothesis").cast("string"))).withColumn("ratio", F.round("ratio", 4))


@query(f"WITH {CONS} SELECT h AS hypothesis, CASE WHEN {STATUS} = 'confirmed' AND h % 3 = 0 THEN 'rejected' ELSE {STATUS} END AS status FROM c")
def skeptic_override(spark, sf):
    v = votes(spark, sf)
    return C.skeptic(C.consensus(v, 0.55), v.select("hypothesis").distinct().withColumn("verdict", F.col("hypothesis") % 3 != 0)).select("hypothesis", "status")


@query(f"""WITH {VOTES}, r AS (SELECT h, (h + CAST(c * 500 AS BIGINT)) % 3 AS round, yes, w FROM v), p AS (SELECT h, round, sum(CASE WHEN yes THEN w ELSE 0 END) AS y, sum(w) AS a FROM r GROUP BY 1, 2),
s AS (SELECT round, sum(y) OVER (PARTITION BY h ORDER BY round) / sum(a) OVER (PARTITION BY h ORDER BY round) AS share FROM p), g AS (SELECT round, avg(share) AS weighted FROM s GROUP BY 1), f AS (SELECT min(round) AS first FROM g WHERE weighted >= 0.75)
SELECT round, round(weighted, 4) AS weighted, weighted >= 0.75 AS reached FROM g, f WHERE first IS NULL OR round <= first""")
def debate_rounds(spark, sf):
    v = votes(spark, sf).withColumn("round", (F.col("hypothesis") + F.round(F.col("confidence") * 500).cast("long")) % 3)
    return C.rounds(v).withColumn("weighted", F.round("weighted", 4))


@query(f"WITH {CONS}, y AS (SELECT h, avg(c) AS m FROM v WHERE yes GROUP BY h) SELECT c.h AS hypothesis, round(coalesce(m, weighted), 4) AS confidence FROM c LEFT JOIN y USING (h)")
def hypothesis_confidence(spark, sf):
    return C.hypothesis_confidence(votes(spark, sf)).withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH {CONS}, n AS (SELECT h, string_agg(DISTINCT m, ', ' ORDER BY m) AS said FROM v WHERE yes GROUP BY h), s AS (SELECT h, {STATUS} AS status FROM c)
SELECT s.h AS hypothesis, status, upper(status) || ': ' || s.h || ' [' || coalesce(said, '') || ']' AS line FROM s LEFT JOIN n USING (h) WHERE status <> 'undecided'""")
def verdict_summary(spark, sf):
    return C.verdict_summary(votes(spark, sf), 0.55)


@query(f"WITH {VOTES}, g AS (SELECT * FROM (SELECT DISTINCT h FROM v), (SELECT DISTINCT m FROM v)), l AS (SELECT h, m, bool_or(yes) AS yes FROM v GROUP BY 1, 2) SELECT g.h AS hypothesis, g.m AS model, coalesce(yes, false) AS verdict, CASE WHEN yes IS NULL THEN 'not_evaluated' ELSE 'ok' END AS reasoning FROM g LEFT JOIN l USING (h, m)")
def vote_fill(spark, sf):
    v = votes(spark, sf).groupBy("hypothesis", "model").agg(F.max("verdict").alias("verdict"), F.max("confidence").alias("confidence"), F.lit("ok").alias("reasoning"))
    return C.fill_votes(v.select("model"), v.select("hypothesis").distinct(), v).drop("confidence")


@query("""WITH d AS (SELECT text, min(doc_id) AS ord FROM documents GROUP BY text), b AS (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT ord, substr(text, 1, 200) AS hypothesis FROM d WHERE text NOT IN (SELECT text FROM b) ORDER BY ord LIMIT 10""")
def dedup_hypotheses(spark, sf):
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("hypothesis"))
    bad = d.join(T(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("ord")), "ord").select("hypothesis")
    return C.new_hypotheses(d, bad)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blacklist_antijoin(spark, sf):
    return T(spark, sf, "documents").join(T(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


# ---- routing: parts are models (tier is p_size), and so are nations (tier is the region) where pairs are the result

MODELS = "m AS (SELECT 'm' || p_partkey AS name, p_size AS tier, p_partkey AS ord, p_partkey % 2 = 0 AS is_local, p_partkey % 3 = 0 AS requires_gpu FROM part)"


def models(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.col("p_size").alias("tier"), k.alias("ord"), (k % 2 == 0).alias("is_local"), (k % 3 == 0).alias("requires_gpu"))


@query("WITH m AS (SELECT n_name AS name, n_regionkey AS tier, n_nationkey AS ord FROM nation) SELECT r.name AS requested, m.name, CAST(row_number() OVER (PARTITION BY r.name ORDER BY m.tier DESC, m.ord) AS INTEGER) AS pos FROM m r JOIN m ON m.tier <= r.tier AND m.name <> r.name")
def fallback_chain(spark, sf):
    m = T(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("tier"), F.col("n_nationkey").alias("ord"))
    return RT.fallback_chain(m, m.select(F.col("name").alias("requested"))).select("requested", "name", "pos")


@query(f"""WITH {MODELS}, f AS (SELECT * FROM m WHERE NOT requires_gpu AND is_local AND ord % 5 <> 0), b AS (SELECT tier, arg_min(name, ord) AS best FROM f GROUP BY 1), t AS (SELECT DISTINCT tier FROM m),
x AS (SELECT t.tier, arg_max(best, b.tier) AS below FROM t LEFT JOIN b ON b.tier <= t.tier GROUP BY 1) SELECT m.name AS requested, CASE WHEN f.name IS NOT NULL THEN m.name ELSE below END AS executor FROM m LEFT JOIN f USING (name) JOIN x ON x.tier = m.tier""")
def resolve_executor(spark, sf):
    m = models(spark, sf)
    return RT.resolve_executor(m, m.select(F.col("name").alias("requested")), m.where("ord % 5 <> 0"), gpu=False, local_only=True)


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE least(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END, 1000.0) END AS budget FROM part")
def budget(spark, sf):
    k = F.col("p_partkey")
    return T(spark, sf, "part").select("p_partkey", RT.budget(F.when(k % 3 != 0, F.col("p_retailprice")), F.lit(1000.0), k % 4 == 0).alias("budget"))


@query("SELECT l_returnflag AS model, round(sum((l_quantity * CASE l_returnflag WHEN 'A' THEN 2.5 WHEN 'N' THEN 0.15 ELSE 0 END + l_linenumber * CASE l_returnflag WHEN 'A' THEN 10.0 WHEN 'N' THEN 0.6 ELSE 0 END) / 1000), 3) AS usd FROM lineitem GROUP BY 1")
def token_cost(spark, sf):
    c = T(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("tokens_in"), F.col("l_linenumber").alias("tokens_out"))
    return RT.priced(c, spark.createDataFrame([("A", 2.5, 10.0), ("N", 0.15, 0.6)], "model string, usd_in double, usd_out double")).groupBy("model").agg(F.round(F.sum("usd"), 3).alias("usd"))


@query("""WITH a AS (SELECT user_id AS id, event_type AS name, avg(value) >= 60 AS said FROM events WHERE event_type <> 'click' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY said DESC, CASE WHEN said THEN 1 ELSE -1 END * CASE name WHEN 'view' THEN 10 WHEN 'error' THEN 20 ELSE 50 END, CASE WHEN said THEN name END, name DESC) AS n FROM a) SELECT id, name, NOT said AS empty FROM r WHERE n = 1""")
def priority_answer(spark, sf):
    e = T(spark, sf, "events").where("event_type <> 'click'").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), "value")
    a = E.exact_sum(e, ["id", "name"], "value", F.count("value").alias("n")).select("id", "name", (F.col("value") / F.col("n") < 60).alias("empty"))
    a = a.withColumn("priority", F.when(F.col("name") == "view", 10).when(F.col("name") == "error", 20))
    return RT.first_answer(a).select("id", "name", "empty")


# ---- graphs: region > nation > supplier and customer, and some suppliers > another nation

TREE = """e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || s_suppkey, 'n' || ((s_nationkey + 1) % 25) FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


def tree(spark, sf):
    n, s = T(spark, sf, "nation"), T(spark, sf, "supplier")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = n.select(name("r", F.col("n_regionkey")).alias("source"), name("n", F.col("n_nationkey")).alias("target"))
    e = e.unionByName(s.select(name("n", F.col("s_nationkey")).alias("source"), name("s", F.col("s_suppkey")).alias("target")))
    c = T(spark, sf, "customer")
    e = e.unionByName(c.select(name("n", F.col("c_nationkey")).alias("source"), name("c", F.col("c_custkey")).alias("target")))
    e = e.unionByName(s.where("s_suppkey % 10 = 0").select(name("s", F.col("s_suppkey")).alias("source"), name("n", (F.col("s_nationkey") + 1) % 25).alias("target"))).distinct()
    nodes = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    kind = F.substring("id", 1, 1)
    nodes = nodes.select("id", kind.alias("type"), F.when(kind == "r", 0.9).when(kind == "n", 0.75).otherwise(0.3).alias("risk"), (F.when(kind == "r", 0).when(kind == "n", 100).when(kind == "s", 1000).otherwise(1_000_000_000) + F.substring("id", 2, 20).cast("long")).alias("ord"))
    return nodes, e.withColumns({"type": F.lit("contains"), "weight": F.lit(1.0)})


@query(f"WITH {TREE} SELECT substr(id, 1, 1) AS type, count(*) AS nodes FROM (SELECT source AS id FROM e UNION SELECT target FROM e) GROUP BY 1")
def node_types(spark, sf):
    return G.node_types(tree(spark, sf)[0])


@query(f"WITH {TREE}, i AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT (SELECT count(*) FROM i) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_counts(spark, sf):
    return G.counts(*tree(spark, sf))


@query(f"""WITH RECURSIVE {TREE}, d AS (SELECT 'r0' AS node, 0 AS h UNION SELECT e.target, h + 1 FROM d JOIN e ON e.source = node WHERE h < 16), m AS (SELECT node, min(h) AS h FROM d GROUP BY 1),
g AS (SELECT e.* FROM e JOIN m a ON a.node = source JOIN m b ON b.node = target AND b.h = a.h + 1), p AS (SELECT ['r0'] AS path UNION ALL SELECT list_append(path, g.target) FROM p JOIN g ON g.source = path[-1]),
r AS (SELECT path, row_number() OVER (PARTITION BY path[-1] ORDER BY path) AS n FROM p WHERE path[-1] IN ('n1', 'n2', 's1', 's2', 's3', 's4', 's5', 'c7')) SELECT 'r0' AS src, path[-1] AS dst, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM r WHERE n <= 5""")
def shortest_paths(spark, sf):
    pairs = spark.createDataFrame([("r0", d) for d in ("n1", "n2", "s1", "s2", "s3", "s4", "s5", "c7")], "src string, dst string")
    return G.shortest_paths(tree(spark, sf)[1], pairs).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH RECURSIVE {TREE}, i AS (SELECT id, CASE substr(id, 1, 1) WHEN 'r' THEN 0.9::DOUBLE WHEN 'n' THEN 0.75 ELSE 0.3 END AS risk, id NOT IN (SELECT source FROM e) AS dangling FROM (SELECT source AS id FROM e UNION SELECT target FROM e)),
s AS (SELECT id, risk / (SELECT sum(risk) FROM i) AS p, dangling FROM i), w AS (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS w FROM e UNION ALL SELECT id, id, 0 FROM s),
k AS (SELECT id, 0 AS n, 1.0::DOUBLE / (SELECT count(*) FROM s) AS rank FROM s
UNION ALL SELECT t.id, min(a.n) + 1, 0.85 * (sum(a.rank * w) + max(a.lost) * max(t.p)) + 0.15 * max(t.p) FROM (SELECT k.id, n, rank, sum(CASE WHEN dangling THEN rank ELSE 0 END) OVER () AS lost FROM k JOIN s ON s.id = k.id WHERE n < 40) a JOIN w ON w.source = a.id JOIN s t ON t.id = w.target GROUP BY t.id)
SELECT id, round(rank, 6) AS rank FROM k WHERE n = 40""")
def pagerank(spark, sf):
    """To convergence; its SQL takes forty rounds, after which nothing changes at six places."""
    return G.pagerank(*tree(spark, sf), tolerance=1e-9).withColumn("rank", F.round("rank", 6))


LINKS = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)"""


@query(f"WITH {LINKS} SELECT 'page:' || page_id AS source, href AS target, count(*) AS weight FROM l GROUP BY ALL")
def link_edges(spark, sf):
    return G.link_edges(T(spark, sf, "pages"))


def sources(spark, sf):
    k, n = F.col("p_partkey"), F.regexp_replace("p_name", "[^A-Za-z0-9_]", "_")
    lines = F.concat(F.lit("static int "), n, F.lit("(int a) {\n  if (a) {\n    return helper(a);\n  }\n}\nvoid decl_"), k.cast("string"), F.lit("(void);\n"))
    js = F.concat(F.lit("function "), n, F.lit("(x) {\nconst f"), k.cast("string"), F.lit(" = (y) => y;\nwhile (x) {\n}\n"))
    return T(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string"), F.when(k % 2 == 0, ".c").otherwise(".js")).alias("path"), F.when(k % 2 == 0, lines).otherwise(js).alias("content"))


@query("""WITH p AS (SELECT p_partkey AS k, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS n FROM part WHERE p_partkey % 2 = 0)
SELECT 'p' || k || '.c' AS path, n AS name, 1 AS line_no FROM p UNION ALL SELECT 'p' || k || '.c', 'helper', 3 FROM p UNION ALL SELECT 'p' || k || '.c', 'decl_' || k, 6 FROM p""")
def functions_cpp(spark, sf):
    return G.functions_cpp(sources(spark, sf).where("path LIKE '%.c'")).select("path", "name", "line_no")


@query("""WITH p AS (SELECT p_partkey AS k, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS n FROM part WHERE p_partkey % 2 = 1)
SELECT 'p' || k || '.js' AS path, n AS name, 1 AS line_no FROM p UNION ALL SELECT 'p' || k || '.js', n, 1 FROM p UNION ALL SELECT 'p' || k || '.js', 'f' || k, 2 FROM p""")
def functions_js(spark, sf):
    return G.functions_js(sources(spark, sf).where("path LIKE '%.js'")).select("path", "name", "line_no")


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'file' AS type, count(*) AS nodes FROM p UNION ALL SELECT 'function', sum(CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END)::BIGINT FROM p""")
def graph_build(spark, sf):
    return G.node_types(G.build(sources(spark, sf))[0])


# ---- reports made from table columns, then parsed back


#: Users whose runs one report holds.
RUNS = 32


def scan_reports(spark, sf):
    """A run a user, RUNS of them a report, one file each: all their events as results, of more steps than are kept for every tenth event."""
    e = T(spark, sf, "events")
    place = lambda n: F.struct(F.struct(F.struct(F.concat(F.lit("src/"), "event_type", F.lit(".c")).alias("uri")).alias("artifactLocation"), F.struct(n.cast("int").alias("startLine"), F.lit(1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    step = lambda n: F.struct(place(n).alias("location"))
    u, k = F.col("user_id"), F.col("event_id")
    steps = F.when(k % 10 == 0, F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: step(F.floor(i / 2)))).otherwise(F.array(step(u), step(u), step(u + 1)))
    result = F.struct(F.concat(F.lit("rule"), (k % 3).cast("string")).alias("ruleId"), F.struct(F.col("event_type").alias("text")).alias("message"), F.when(k % 5 == 0, F.filter(F.array(place(k)), lambda x: F.lit(False))).otherwise(F.array(place(k))).alias("locations"),
                      F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows"))).alias("codeFlows"))
    rules = F.array(*[F.struct(F.lit(f"rule{i}").alias("id"), F.struct(F.lit(s).alias("level")).alias("defaultConfiguration")) for i, s in ((0, "error"), (1, "note"), (1, "error"))])
    results = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), result.alias("r")))), lambda x: x["r"])
    run = F.struct(F.struct(F.struct(rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    folder = scratch(spark, "reports")
    runs = e.groupBy("user_id").agg(F.to_json(run).alias("run")).groupBy(F.floor(F.col("user_id") / RUNS)).agg(F.array_join(F.collect_list("run"), ",").alias("runs"))
    runs.select(F.concat(F.lit('{"runs":['), "runs", F.lit("]}"))).write.option("maxRecordsPerFile", 1).text(folder)
    return SRC.reports(spark, folder)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_id AS line, 'rule' || (event_id % 3) AS rule_id, event_type AS message, 'src/' || event_type || '.c' AS file, CAST(n - 1 AS INTEGER) AS pos, CASE event_id % 3 WHEN 2 THEN 'warning' ELSE 'error' END AS severity,
CASE WHEN event_id % 10 = 0 THEN 10 ELSE 2 END AS steps FROM n WHERE event_id % 5 <> 0 AND n <= 50""")
def sarif_findings(spark, sf):
    """Read from a folder of reports: 50 results a run at most, before those without a place go, and ten steps."""
    return L.scan_findings(scan_reports(spark, sf)).select(F.col("line").cast("long").alias("line"), "rule_id", "message", "file", "pos", "severity", F.size("flow_steps").alias("steps"))


def crash_logs(spark, sf):
    k = F.element_at(F.array(*[F.lit(c) for c in (*L.CRASH_TYPES, "leak")]), (F.col("event_id") % 9 + 1).cast("int"))
    text = F.format_string("==%d==ERROR: AddressSanitizer: %s on address 0x%016x at pc\n    #0 0x1 in %s a.c:1\n    #1 0x2 in main b.c:2\nnote\n\n    #2 0x3 in later c.c:3\n", "event_id", k, "event_id", "event_type")
    return T(spark, sf, "events").select(F.col("event_id").alias("path"), text.alias("text"))


@query("""SELECT event_id AS path, ['heap-use-after-free', 'heap-buffer-overflow', 'stack-buffer-overflow', 'global-buffer-overflow', 'use-after-poison', 'container-overflow', 'double-free', 'alloc-dealloc-mismatch'][(event_id % 9) + 1] AS crash_type,
'#0 0x1 in ' || event_type || ' a.c:1;#1 0x2 in main b.c:2' AS stack, printf('0x%016x', event_id) AS fault_address FROM events WHERE event_id % 9 < 8""")
def asan_parse(spark, sf):
    return L.sanitizer_crashes(crash_logs(spark, sf)).withColumn("stack", F.array_join("stack", ";"))


@query("""SELECT ['heap-use-after-free', 'heap-buffer-overflow', 'stack-buffer-overflow', 'global-buffer-overflow', 'use-after-poison', 'container-overflow', 'double-free', 'alloc-dealloc-mismatch'][(event_id % 9) + 1] AS crash_type, '#0 0x1 in ' || event_type || ' a.c:1' AS top_frame, count(*) AS crashes FROM events WHERE event_id % 9 < 8 GROUP BY ALL""")
def unique_crashes(spark, sf):
    return L.unique_crashes(L.sanitizer_crashes(crash_logs(spark, sf)))


def sessions(spark, sf):
    text = F.format_string("#0  0x%016x in f_%s ()\n#1  main\nProgram received signal SIGSEGV at 0x%x\nrax            0x%x  1\nrax 0xff\n0x0000555500000000-0x0000555500001000 r-xp\n0x41414141\n", "event_id", "event_type", "event_id", "user_id")
    return T(spark, sf, "events").select(F.col("event_id").alias("path"), text.alias("text"))


@query("SELECT event_id AS path, 2 AS frames, 'Program received signal SIGSEGV at ' || printf('0x%x', event_id) AS signal_info, printf('0x%x', event_id) AS fault_address, '0xff' AS rax, 1 AS maps, 5 AS findings FROM events")
def gdb_parse(spark, sf):
    return L.debugger_sessions(sessions(spark, sf)).select("path", F.size("stack").alias("frames"), "signal_info", "fault_address", F.col("registers")["rax"].alias("rax"), F.size("memory_maps").alias("maps"), F.size("findings").alias("findings"))


@query("SELECT user_id, CASE WHEN count(*) >= 5 THEN round(count(DISTINCT printf('%08x', event_id % 3)) / count(*) * 32, 2) END AS entropy FROM events GROUP BY 1")
def aslr_entropy(spark, sf):
    line = F.format_string("0x%08x%08x", F.col("event_id") % 3, "event_id")
    return T(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.collect_list(line), "\n").alias("text")).select("user_id", L.address_entropy(F.col("text")).alias("entropy"))


# ---- streams


@query(f"WITH {STREAK} SELECT user_id, event_id, streak FROM s")
def stream_streak(spark, sf):
    return S.drain(S.streaks(S.stream_table(spark, sf, "events.parquet"), "user_id", failed()))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf):
    return S.window_counts(T(spark, sf, "events"), ["event_type"], "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


from . import graphs as _graphs  # noqa: E402, F401 (these add their queries)
from . import sessions as _sessions  # noqa: E402, F401
from . import stores as _stores  # noqa: E402, F401
