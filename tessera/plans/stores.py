"""Queries over sources, sinks, models, registries and streams, with their SQL. Files are made in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hotspots as H
from ..operators import logs as L
from ..sources import files as S
from ..sources.shared import put_files, scratch
from ..streaming import steps as ST
from . import registry as P
from .catalogue import ERR, STREAK, T, failed, query

# ---- files


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'deep/' ELSE '' END || 'n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.c' ELSE '.js' END AS path, 'name ' || n_name || chr(10) || 'é' AS content FROM nation WHERE n_nationkey % 5 <> 4")
def source_tree(spark, sf):
    rows = T(spark, sf, "nation").collect()  # 25 rows: one file each
    end = lambda k: ".txt" if k % 5 == 4 else ".c" if k % 2 == 0 else ".js"
    files = {f"{'deep/' if r['n_regionkey'] == 0 else ''}n{r['n_nationkey']}{end(r['n_nationkey'])}": f"name {r['n_name']}\né" for r in rows}
    return S.source_tree(spark, put_files(spark, scratch(spark, "tree"), files))


@query("""WITH f AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'id%3A' || printf('%06d', n_nationkey) || ',src' WHEN 1 THEN 'crash-' || n_nationkey WHEN 2 THEN 'fuzz' || n_nationkey || '.log' ELSE 'id%3A' || printf('%06d', n_nationkey) || '.README' END AS name FROM nation UNION ALL SELECT 'README.txt')
SELECT 'afl' AS layout, name FROM f WHERE starts_with(name, 'id') AND NOT contains(name, 'README') UNION ALL SELECT 'libfuzzer', name FROM f WHERE name <> 'README.txt' AND NOT ends_with(name, '.log')""")
def crash_files(spark, sf):
    rows = T(spark, sf, "nation").collect()  # 25 rows: one file each
    kinds = (lambda k: f"id%3A{k:06d},src", lambda k: f"crash-{k}", lambda k: f"fuzz{k}.log", lambda k: f"id%3A{k:06d}.README")
    folder = put_files(spark, scratch(spark, "crashes"), {"README.txt": "x"} | {kinds[r["n_nationkey"] % 4](r["n_nationkey"]): r["n_name"] for r in rows})
    name = F.url_decode(F.regexp_extract("path", "([^/]+)$", 1))
    rows = [S.crash_files(spark, folder, k).select(F.lit(k).alias("layout"), F.regexp_replace(name, ":", "%3A").alias("name")) for k in ("afl", "libfuzzer")]
    return rows[0].unionByName(rows[1])


@query("""SELECT 'n' || n_nationkey || '.log' AS name, ['heap-use-after-free', 'heap-buffer-overflow', 'stack-buffer-overflow', 'global-buffer-overflow', 'use-after-poison', 'container-overflow', 'double-free', 'alloc-dealloc-mismatch'][(n_nationkey % 9) + 1] AS crash_type,
'#0 0x1 in ' || n_name || ' a.c:1' AS stack, printf('0x%016x', n_nationkey) AS fault_address FROM nation WHERE n_nationkey % 9 < 8""")
def crash_reports(spark, sf):
    rows = T(spark, sf, "nation").collect()  # 25 rows: one log each
    kinds = (*L.CRASH_TYPES, "leak")
    logs = {f"n{r['n_nationkey']}.log": f"=={r['n_nationkey']}==ERROR: AddressSanitizer: {kinds[r['n_nationkey'] % 9]} on address 0x{r['n_nationkey']:016x}\n    #0 0x1 in {r['n_name']} a.c:1\n\nend\n" for r in rows}
    out = S.crash_reports(spark, put_files(spark, scratch(spark, "logs"), logs))
    return out.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "crash_type", F.array_join("stack", ";").alias("stack"), "fault_address")


@query("""SELECT n_name AS name, '{"depth": ' || n_nationkey || ', "local": ' || CASE WHEN n_regionkey = 0 THEN 'true' ELSE 'false' END || CASE WHEN n_nationkey % 2 = 0 THEN ', "tools": ["grep"]}' ELSE '}' END AS settings FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 = 0
UNION ALL SELECT n_name, '{"depth": ' || n_nationkey || ', "tools": ["grep"]}' FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 UNION ALL SELECT n_name, '{"depth": 5, "local": ' || CASE WHEN n_regionkey = 0 THEN 'true' ELSE 'false' END || '}' FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 = 0""")
def profile_overlay(spark, sf):
    """Defaults of every third nation, laid over by a YAML file that names every second."""
    rows = T(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    text = "capabilities:\n" + "".join(f"  {r['n_name']}:\n    depth: {r['n_nationkey']}\n    tools: [grep]\n" for r in rows if r["n_nationkey"] % 2 == 0)
    folder = put_files(spark, scratch(spark, "profiles"), {"caps.yaml": text})
    return S.read_profiles(spark, f"{folder}/caps.yaml", {r["n_name"]: {"depth": 5, "local": r["n_regionkey"] == 0} for r in rows if r["n_nationkey"] % 3 == 0})


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{}' ELSE '{"v":' || CAST(event_id AS DOUBLE) || '}' END AS one, '[' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(event_id AS DOUBLE)::VARCHAR END || ',1.0]' AS many, '{"1":"' || strftime(ts::DATE, '%Y-%m-%d') || '"}' AS named FROM events""")
def json_safe(spark, sf):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("event_id").cast("double"))
    e = T(spark, sf, "events").select("event_id", F.struct(x.alias("v")).alias("one"), F.array(x, F.lit(1.0)).alias("many"), F.create_map(F.lit(1), F.col("ts").cast("date")).alias("named"))
    safe = [F.to_json(X.json_safe(F.col(c), e.schema[c].dataType)).alias(c) for c in ("one", "many", "named")]
    return e.select("event_id", *safe)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END, 3) + 0.0 AS total FROM embeddings")
def vector_store(spark, sf):
    path, e = scratch(spark, "vectors"), T(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    S.add_vectors(e.withColumn("ord", F.lit(0)), path)
    S.add_vectors(e.where("vec_id % 10 = 0").select("vec_id", F.transform("embedding", lambda x: x * 2).alias("embedding"), F.lit(1).alias("ord")), path)
    return S.read_vectors(spark, path, "vec_id long, embedding array<double>, ord int").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total")).withColumn("total", F.col("total") + 0.0)


@query("SELECT 'saved' AS state, CAST(n_nationkey + 100 AS BIGINT) AS k, n_name AS v FROM nation WHERE n_nationkey < 5")
def state_store(spark, sf):
    folder, n = scratch(spark, "states"), T(spark, sf, "nation").select(F.lit("saved").alias("state"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    S.save_state(n, folder, "/src/a.c")
    S.save_state(n.where("k < 5").withColumn("k", F.col("k") + 100), folder, "/src/a.c")  # the later one replaces the earlier
    schema = "state string, k long, v string"
    return S.load_state(spark, folder, "/src/a.c", schema).unionByName(S.load_state(spark, folder, "/src/never.c", schema))


@query("SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS resumes FROM conversations WHERE turn > 0 AND turn % 5 = 0")
def checkpoint_steps(spark, sf):
    """Saved after the first turns, and again when all are there; then read back."""
    steps, folder = T(spark, sf, "conversations").select("conv_id", "turn"), scratch(spark, "saved")
    S.checkpoint_steps(steps.where("turn < 7"), folder, key="conv_id", order="turn")
    S.checkpoint_steps(steps, folder, key="conv_id", order="turn")
    return S.resume_steps(spark, folder, "conv_id long, turn long", "conv_id", "turn").where("turn > 0 AND turn % 5 = 0")


@query("""SELECT 'steps' AS part, count(*) AS n, CAST(sum(turn) AS DOUBLE) AS total FROM conversations UNION ALL SELECT 'costs', count(*), round(sum(value), 2) FROM events UNION ALL SELECT 'evidence', count(*), CAST(sum(n_nationkey) AS DOUBLE) FROM nation
UNION ALL SELECT 'blacklist', count(*), CAST(sum(r_regionkey) AS DOUBLE) FROM region UNION ALL SELECT 'keyword:' || lower(n_name), n_nationkey, NULL FROM nation WHERE n_nationkey < 3""")
def session_store(spark, sf):
    folder, t = scratch(spark, "session"), lambda n: T(spark, sf, n)
    evidence = t("nation").select(F.col("n_nationkey").alias("total"), F.array(F.lower("n_name")).alias("keywords"))
    S.write_session({"steps": t("conversations").select(F.col("turn").alias("total")), "costs": t("events").select(F.col("value").alias("total")), "evidence": evidence, "blacklist": t("region").select(F.col("r_regionkey").alias("total"))}, folder)
    got = S.read_session(spark, folder)
    out = got["evidence"].where("total < 3").select(F.concat(F.lit("keyword:"), F.col("keywords")[0]).alias("part"), F.col("total").cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    for name, df in got.items():
        out = out.unionByName(df.agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).cast("double").alias("total")).withColumn("part", F.lit(name)))
    return out


BLAME = "b AS (SELECT 'src/f' || (l_partkey % 60) || '.c' AS file, l_linenumber AS line, 'a' || (o_custkey % 40) AS author, l_orderkey AS sha FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def blamed(spark, sf):
    return T(spark, sf, "lineitem").join(T(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("src/f"), (F.col("l_partkey") % 60).cast("string"), F.lit(".c")).alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("a"), (F.col("o_custkey") % 40).cast("string")).alias("author"), F.col("l_orderkey").alias("sha")
    )


@query(f"WITH {BLAME} SELECT 'file' AS scope, line, author, sha FROM b WHERE file = 'src/f7.c' UNION ALL SELECT 'line', line, author, sha FROM b WHERE file = 'src/f8.c' AND line = 2")
def blame_lines(spark, sf):
    b = blamed(spark, sf)
    return H.blame(b, "src/f7.c").withColumn("scope", F.lit("file")).unionByName(H.blame(b, "src/f8.c", 2).withColumn("scope", F.lit("line"))).select("scope", "line", "author", "sha")


@query(f"WITH {BLAME} SELECT array_to_string((list_sort(list_distinct(list(author))))[1:10], ',') AS authors FROM b WHERE file = 'src/f7.c'")
def blame_authors(spark, sf):
    lines = H.blame(blamed(spark, sf), "src/f7.c").select(F.explode(F.array(F.concat(F.lit("author "), "author"), F.lit("author-mail <x@example.org>"), F.concat(F.lit("\t"), F.col("sha").cast("string")))).alias("value"))
    return H.blame_authors(lines).withColumn("authors", F.array_join("authors", ","))


# ---- models


class Letters:
    """A back end for tests: counts a to z; texts that begin with "De" fail."""

    name, usd_in, usd_out = "letters", 0.5, 0.0

    def run(self, texts):
        for t in texts:
            yield ValueError("no such language") if t.startswith("De") else [float(t.count(chr(c))) for c in range(97, 123)]


COUNTS = "list_transform(range(97, 123), lambda c: CAST(length(text) - length(replace(text, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"


@query(f"SELECT doc_id, CASE WHEN text NOT LIKE 'De%' THEN list_sum({COUNTS}) END AS letters, CASE WHEN text NOT LIKE 'De%' THEN ({COUNTS})[5] END AS e, CASE WHEN text LIKE 'De%' THEN 'no such language' END AS error FROM documents")
def embed_texts(spark, sf):
    """A third of the documents first, into a cache; then all of them, of which the others only are sent."""
    docs, cache = T(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "vectors")
    P.embed(docs.where("doc_id % 3 = 0"), Letters(), cache=cache, most=10_000_000)
    out = P.embed(docs, Letters(), cache=cache, most=10_000_000)
    return out.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("letters"), F.get("embedding", F.lit(4)).alias("e"), "error")


class Judge:
    """A back end for tests: whether a text says so."""

    name, usd_in, usd_out = "judge", 2.0, 0.0

    def run(self, texts):
        return ["error" in t.lower() for t in texts]


@query("SELECT conv_id, turn, contains(lower(text), 'error') AS answer, length(text) // 4 AS tokens_in, round((length(text) // 4) * 2.0 / 1000, 6) AS usd FROM conversations")
def model_answers(spark, sf):
    out = P.with_model(T(spark, sf, "conversations").select("conv_id", "turn", "text"), Judge(), "boolean")
    return out.select("conv_id", "turn", "answer", "tokens_in", F.round("usd", 6).alias("usd"))


@query("SELECT event_id, round(value * 3 + user_id % 2, 4) AS scored FROM events")
def called_function(spark, sf):
    P.register_function(spark, "tessera_scored", "v DOUBLE, k BIGINT", "DOUBLE", "v * 3 + k % 2")
    return T(spark, sf, "events").selectExpr("event_id", "round(tessera_scored(value, user_id), 4) AS scored")


class Streaks:
    """A tool for SQL: the longest run of failures of a partition."""

    def __init__(self):
        self.user, self.now, self.most = None, 0, 0

    def eval(self, row):
        self.user = row["user_id"]
        self.now = self.now + 1 if row["event_type"] == "error" else 0
        self.most = max(self.most, self.now)

    def terminate(self):
        yield self.user, self.most


class Jumps:
    """A tool for SQL: the rows whose value is more than twice the one before."""

    def __init__(self):
        self.last = None

    def eval(self, row):
        if self.last is not None and row["value"] > 2 * self.last:
            yield row["user_id"], row["event_id"]
        self.last = row["value"]


@query(f"""WITH {STREAK}, m AS (SELECT user_id, max(streak) AS streak FROM s GROUP BY 1), v AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events),
j AS (SELECT user_id, count(*) AS jumps FROM v WHERE value > 2 * last GROUP BY 1) SELECT user_id, streak, coalesce(jumps, 0) AS jumps FROM m LEFT JOIN j USING (user_id)""")
def sql_tools(spark, sf):
    r = P.Registry()
    r.register_table_function(spark, "tessera_streaks", Streaks, "user_id long, streak long")
    r.register_table_function(spark, "tessera_jumps", Jumps, "user_id long, event_id long")
    return spark.sql("""SELECT s.user_id, streak, coalesce(jumps, 0) AS jumps FROM tessera_streaks(TABLE({e}) PARTITION BY user_id ORDER BY (ts, event_id)) s
        LEFT JOIN (SELECT user_id, count(*) AS jumps FROM tessera_jumps(TABLE({e}) PARTITION BY user_id ORDER BY (ts, event_id)) GROUP BY user_id) j ON j.user_id = s.user_id""", e=T(spark, sf, "events"))


# ---- registries


@query("""WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT 0 AS ord, 'by_type' AS name, true AS success, '{"event_type":"' || event_type || '","n":' || n || '}' AS output, NULL AS error FROM t UNION ALL SELECT 1, 'nothing', false, NULL, 'unknown tool'
UNION ALL SELECT 2, 'offline', false, NULL, 'tool is not available' UNION ALL SELECT 3, 'broken', false, NULL, 'failed' UNION ALL SELECT 4, 'by_type', true, '{"eve', NULL FROM t""")
def dispatch(spark, sf):
    e = T(spark, sf, "events")
    r = P.Registry()
    r.register_many({"by_type": lambda: e.groupBy("event_type").agg(F.count("*").alias("n")), "broken": lambda: e.select(F.raise_error(F.lit("boom")).alias("x"))})
    r.register("offline", lambda: e, lambda: False)
    calls = [(n, (), {}) for n in ("by_type", "nothing", "offline", "broken")]
    rows = r.run_all(spark, calls, timeout=600).withColumn("error", F.when(F.contains("error", F.lit("boom")) | (F.col("name") == "broken"), F.lit("failed")).otherwise(F.col("error")))
    return rows.unionByName(r.run(spark, "by_type", cap=5).withColumn("ord", F.lit(4)))


@query("""WITH n AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1), c AS (SELECT r_regionkey AS k, lower(r_name) AS name, n FROM region JOIN n ON k = r_regionkey) SELECT name, '{"n":' || n || '}' AS output, true AS success FROM c WHERE k <> 2
UNION ALL SELECT name, 'unknown tool', false FROM c WHERE k = 2 UNION ALL SELECT 'names', string_agg(name, ',' ORDER BY name), true FROM c WHERE k <> 2 UNION ALL SELECT 'chain', string_agg(name, ',' ORDER BY k DESC), true FROM c WHERE k <> 2""")
def registry_names(spark, sf):
    """A tool a region, that counts its nations; one is taken out again; each falls back on the region before, and the first on the last."""
    regions, n = T(spark, sf, "region").orderBy("r_regionkey").collect(), T(spark, sf, "nation")  # 5 rows
    r, names = P.Registry(), [x["r_name"].lower() for x in regions]
    for k, name in enumerate(names):
        r.register(name, lambda k=k: n.where(F.col("n_regionkey") == k).agg(F.count("*").alias("n")))
    r.unregister(names[2])
    r.default = names[-1]
    out = r.run_all(spark, [(name, (), {}) for name in names]).select("name", F.coalesce("output", "error").alias("output"), "success")
    rows = [("names", ",".join(r.names()), True), ("chain", ",".join(r.chain(r.default, dict(zip(names, [names[-1], *names])))), True)]
    return out.unionByName(spark.createDataFrame(rows, "name string, output string, success boolean"))


def advisors():
    said = lambda plan: F.struct(F.lit(None).cast("string").alias("critique"), plan.alias("plan"), F.array().cast("array<string>").alias("hypotheses"), F.array().cast("array<string>").alias("tools"), F.lit(None).cast("double").alias("threshold"))
    m = P.Advisors(fallbacks={"rules": "local", "local": "cloud", "cloud": "rules"})
    m.register(P.Advisor("rules", F.col("event_type") == "error", said(F.concat(F.lit("retry "), F.col("event_id").cast("string"))), priority=10))
    m.register(P.Advisor("local", F.col("value") < 200, said(F.when(F.col("value") > 50, F.lit("look again"))), priority=30))
    m.register(P.Advisor("cloud", F.lit(True), said(F.when(F.col("user_id") % 2 == 0, F.lit("ask"))), priority=20, requires_network=True))
    return m


RULES = f"CASE WHEN {ERR} THEN 'retry ' || event_id END AS rules, CASE WHEN value < 200 AND value > 50 THEN 'look again' END AS local, CASE WHEN user_id % 2 = 0 THEN 'ask' END AS cloud"


@query(f"WITH a AS (SELECT event_id, {RULES} FROM events) SELECT event_id, CASE WHEN rules IS NOT NULL THEN 'rules' WHEN local IS NOT NULL THEN 'local' WHEN cloud IS NOT NULL THEN 'cloud' END AS advisor, coalesce(rules, local, cloud) AS plan, CASE WHEN rules IS NOT NULL THEN 'rules' WHEN cloud IS NOT NULL THEN 'cloud' WHEN local IS NOT NULL THEN 'local' END AS by_priority FROM a")
def advisor_chain(spark, sf):
    m = advisors()
    out = m.first(T(spark, sf, "events")).select("event_id", "value", "user_id", "event_type", F.col("advisor").alias("chain_advisor"), F.col("advice.plan").alias("plan"))
    return m.first(out, m.by_priority()).select("event_id", F.col("chain_advisor").alias("advisor"), "plan", F.col("advisor").alias("by_priority"))


@query(f"WITH a AS (SELECT event_id, {RULES} FROM events) SELECT event_id, 'rules' AS advisor, rules AS plan FROM a WHERE rules IS NOT NULL UNION ALL SELECT event_id, 'local', local FROM a WHERE local IS NOT NULL UNION ALL SELECT event_id, 'cloud', cloud FROM a WHERE cloud IS NOT NULL")
def advisor_parallel(spark, sf):
    return advisors().every(T(spark, sf, "events")).select("event_id", "advisor", F.col("advice.plan").alias("plan"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length FROM embeddings")
def lazy_entry(spark, sf):
    import tessera

    return T(spark, sf, "embeddings").select("vec_id", F.round(tessera.vector.norm(F.col("embedding")), 4).alias("length"))  # loaded on first use


# ---- streams


def staged(spark, sf, *parts):
    """A folder of event files, one for each condition, written one after the other."""
    folder = scratch(spark, "events")
    for p in parts:
        T(spark, sf, "events").where(p).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query(f"WITH {STREAK} SELECT user_id, event_id, streak FROM s")
def stream_resume(spark, sf):
    """The stream is stopped after the first half of the events and started again, with the same folder, when the second half has come."""
    half = T(spark, sf, "events").agg(F.percentile_approx("ts", 0.5)).first()[0]
    at, folder = F.lit(half).cast("timestamp_ntz"), staged(spark, sf, F.col("ts") <= F.lit(half).cast("timestamp_ntz"))
    out = scratch(spark, "stream")
    run = lambda: ST.drain(ST.streaks(spark.readStream.schema(T(spark, sf, "events").schema).parquet(folder), "user_id", failed()), folder=out)
    run()
    T(spark, sf, "events").where(F.col("ts") > at).coalesce(1).write.mode("append").parquet(folder)
    return run()


@query("""WITH m AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS k, text FROM conversations),
q AS (SELECT conv_id, turn * 3 + k AS seq, CASE k WHEN 0 THEN CASE turn % 4 WHEN 3 THEN 'clear' WHEN 1 THEN 'guide' ELSE 'put' END WHEN 1 THEN CASE turn % 3 WHEN 0 THEN 'has' ELSE 'peek' END ELSE CASE turn % 3 WHEN 2 THEN 'consume' WHEN 1 THEN 'guidance' ELSE 'has' END END AS kind, text FROM m),
w AS (SELECT *, arg_max(CASE kind WHEN 'put' THEN text ELSE '' END, seq) FILTER (kind IN ('put', 'clear', 'consume')) OVER o AS said, arg_max(kind, seq) FILTER (kind IN ('put', 'clear', 'consume')) OVER o AS last, arg_max(substr(text, 1, 1000), seq) FILTER (kind = 'guide') OVER o AS guide
  FROM q WINDOW o AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(conv_id AS VARCHAR) AS session, seq, kind, CASE kind WHEN 'has' THEN CASE WHEN last = 'put' THEN 'true' ELSE 'false' END WHEN 'guidance' THEN coalesce(guide, '') ELSE said END AS answer
FROM w WHERE kind IN ('has', 'guidance') OR (kind IN ('peek', 'consume') AND last = 'put')""")
def stream_mailbox(spark, sf):
    """Each turn puts, guides or clears, then asks, then asks or consumes. Its whole text comes with the first message only, since questions have none."""
    t, k = F.col("turn"), F.col("k")
    first, second = F.when(t % 4 == 3, "clear").when(t % 4 == 1, "guide").otherwise("put"), F.when(t % 3 == 0, "has").otherwise("peek")
    third = F.when(t % 3 == 2, "consume").when(t % 3 == 1, "guidance").otherwise("has")
    rows = ST.stream_table(spark, sf, "conversations.parquet").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    m = rows.select(F.col("conv_id").cast("string").alias("session"), (t * 3 + k).alias("seq"), F.when(k == 0, first).when(k == 1, second).otherwise(third).alias("kind"), F.when(k == 0, F.col("text")).alias("text"))
    return ST.drain(ST.mailbox(m))


@query("WITH r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, array_to_string(list(CAST(value AS DECIMAL(18, 2)) ORDER BY event_id), ',') AS kept FROM r WHERE n <= 20 GROUP BY 1")
def stream_last_rows(spark, sf):
    out = ST.drain_updates(ST.last_rows(ST.stream_table(spark, sf, "events.parquet"), "user_id", "event_id", "value", 20), ["user_id"])
    return out.select("user_id", F.array_join(F.transform("kept", lambda x: x.cast("decimal(18,2)").cast("string")), ",").alias("kept"))


@query(f"""WITH {STREAK}, c AS (SELECT user_id, ts, event_id, bad, CASE WHEN bad = 0 THEN 'closed' WHEN streak >= 2 THEN 'open' END AS state FROM s),
f AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'closed') AS now FROM c),
l AS (SELECT *, lag(now, 1, 'closed') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM f),
a AS (SELECT user_id, now AS state FROM l WHERE now <> before UNION ALL SELECT user_id, 'half_open' FROM l WHERE back = 1 AND now = 'open' AND epoch_ms(ts) + 3600000 < (SELECT epoch_ms(max(ts)) FROM events) - 600000) SELECT user_id, state, count(*) AS n FROM a GROUP BY ALL""")
def stream_circuits(spark, sf):
    """Timers run by event time: a circuit that is open for an hour, as far as the watermark has come, half-opens."""
    rows = ST.drain(ST.circuits(ST.stream_table(spark, sf, "events.parquet"), "user_id", failed(), limit=2, rest_ms=3_600_000, late="10 minutes"))
    return rows.groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts, INTERVAL 1 HOUR)]) AS start FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT event_type, start, count(*) AS n FROM w, m WHERE start + INTERVAL 2 HOUR <= mark GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    """Windows of two hours, one an hour, that the watermark has closed."""
    out = ST.drain(ST.window_counts(ST.stream_table(spark, sf, "events.parquet"), ["event_type"], "2 hours", "1 hour"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
