"""Queries over graphs, retrieval and evidence, with their SQL. Regions, nations, suppliers and customers make a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..sources import files as S
from ..sources.shared import scratch
from ..sources.stored import read_store
from .catalogue import TREE, T, query, tree

RISKS = "i AS (SELECT id, CASE substr(id, 1, 1) WHEN 'r' THEN 0.9::DOUBLE WHEN 'n' THEN 0.75 ELSE 0.3 END AS risk, CASE substr(id, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 100 WHEN 's' THEN 1000 ELSE 1000000000 END + CAST(substr(id, 2) AS BIGINT) AS ord FROM (SELECT source AS id FROM e UNION SELECT target FROM e))"


@query("SELECT 'n' || n_nationkey AS id, 'v' || (n_nationkey % 3) AS label, 3 AS ord FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT 'n' || n_nationkey, 'v' || (n_nationkey % 3), 1 FROM nation WHERE n_nationkey % 3 <> 2")
def node_upserts(spark, sf):
    k = F.col("n_nationkey")
    put = lambda ord_, label: T(spark, sf, "nation").select(F.concat(F.lit("n"), k.cast("string")).alias("id"), label.alias("label"), F.lit(ord_).alias("ord"))
    own = F.concat(F.lit("v"), (k % 3).cast("string"))
    path = scratch(spark, "nodes")
    G.put_nodes(put(1, own).unionByName(put(0, F.lit("old"))), path)
    G.put_nodes(put(0, F.lit("late")).unionByName(put(3, own).where("id IN ('n2', 'n5', 'n8', 'n11', 'n14', 'n17', 'n20', 'n23')")), path)
    return read_store(spark, path, "id string, label string, ord int")


@query("SELECT l_orderkey AS source, l_partkey AS target, 'contains' AS type, arg_max(l_quantity, l_linenumber)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2")
def edge_upserts(spark, sf):
    e = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("contains").alias("type"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_linenumber").alias("ord"))
    path = scratch(spark, "edges")
    G.put_edges(e.where("ord < 4"), path)
    G.put_edges(e.where("ord > 2"), path)
    return read_store(spark, path, "source long, target long, type string, weight double")


@query(f"WITH {TREE} SELECT 'edge' AS kind, target, type, 1.0::DOUBLE AS weight FROM (SELECT target, 'contains' AS type FROM e WHERE source = 'n3') UNION ALL SELECT 'neighbour', target, NULL, NULL FROM (SELECT DISTINCT target FROM e WHERE source = 'n4')")
def outgoing_edges(spark, sf):
    e = tree(spark, sf)[1]
    edges = G.outgoing(e, "n3").select(F.lit("edge").alias("kind"), "target", "type", "weight")
    return edges.unionByName(G.neighbours(e, "n4").withColumn("kind", F.lit("neighbour")), allowMissingColumns=True)


HYP = "h AS (SELECT 'h' || (s_suppkey % 20) AS id, 'n' || (s_suppkey % 30) AS node, (s_suppkey % 10) / 10.0::DOUBLE AS risk FROM supplier)"


def hypotheses(spark, sf):
    k = F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return T(spark, sf, "supplier").select(name("h", k % 20).alias("id"), name("n", k % 30).alias("node"), ((k % 10).cast("double") / 10).alias("risk"))


@query(f"""WITH {TREE}, {RISKS}, {HYP}, l AS (SELECT node, max(risk * 0.7) AS r FROM h GROUP BY 1) SELECT i.id, substr(i.id, 1, 1) AS type, round(greatest(risk, coalesce(r, 0)), 6) AS risk FROM i LEFT JOIN l ON l.node = i.id
UNION ALL SELECT id, 'hypothesis', round(max(risk), 6) FROM h GROUP BY 1""")
def hypothesis_nodes(spark, sf):
    return G.add_hypotheses(*tree(spark, sf), hypotheses(spark, sf))[0].select("id", "type", F.round("risk", 6).alias("risk"))


@query(f"WITH {TREE}, {RISKS}, {HYP} SELECT h.id AS source, node AS target, 'hypothesis_link' AS type, h.risk AS weight FROM h JOIN i ON i.id = node")
def hypothesis_edges(spark, sf):
    return G.add_hypotheses(*tree(spark, sf), hypotheses(spark, sf))[1].where("type = 'hypothesis_link'").select("source", "target", "type", "weight")


def crash_graph(spark, sf):
    k = F.col("p_partkey")
    nodes = T(spark, sf, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.lit("function").alias("type"), F.concat(F.lit("fn_"), k.cast("string"), F.lit("_"), "p_name").alias("label"), F.lit(0.5).alias("risk"), k.alias("ord"))
    edges = spark.createDataFrame([], "source string, target string, type string, weight double")
    names = F.array(F.concat(F.lit("_"), F.col("n_nationkey").cast("string"), F.lit("_")), F.col("n_nationkey").cast("string"), F.lit("nowhere"), F.lit("main_loop"))
    frame = F.transform(F.sequence(F.lit(0), F.col("n_nationkey")), lambda i: F.concat(F.lit("#"), i.cast("string"), F.lit(" in "), "n_name"))
    crashes = T(spark, sf, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), names.alias("functions"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("kind "), F.col("n_regionkey").cast("string"))).alias("crash_type"), frame.alias("stack_trace"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("0x"), F.hex("n_nationkey"))).alias("fault_address"))
    return G.add_crashes(nodes, edges, crashes)


CRASH = """p AS (SELECT 'f' || p_partkey AS id, 'fn_' || p_partkey || '_' || p_name AS label, p_partkey AS ord FROM part), c AS (SELECT 'c' || n_nationkey AS crash, unnest(['_' || n_nationkey || '_', CAST(n_nationkey AS VARCHAR), 'nowhere', 'main_loop']) AS name FROM nation),
m AS (SELECT name, arg_min(id, ord) AS node FROM p JOIN (SELECT DISTINCT name FROM c) n ON contains(label, name) GROUP BY 1), x AS (SELECT DISTINCT crash, node FROM c JOIN m USING (name))"""


@query(f"WITH {CRASH} SELECT node AS source, crash AS target, 'crash_link' AS type, 1.0::DOUBLE AS weight FROM x")
def crash_edges(spark, sf):
    return crash_graph(spark, sf)[1]


@query(f"""WITH {CRASH} SELECT id, 'function' AS type, label, CASE WHEN id IN (SELECT node FROM x) THEN 0.85::DOUBLE ELSE 0.5 END AS risk, NULL AS kind, NULL AS frames, NULL AS address FROM p UNION ALL
SELECT 'c' || n_nationkey, 'crash', 'Crash: ' || CASE WHEN n_regionkey > 0 THEN 'kind ' || n_regionkey ELSE 'unknown' END, 0.9, CASE WHEN n_regionkey > 0 THEN 'kind ' || n_regionkey ELSE 'unknown' END,
'["' || array_to_string(list_transform(range(0, least(n_nationkey + 1, 10)), lambda i: '#' || i || ' in ' || n_name), '","') || '"]', CASE WHEN n_nationkey % 2 = 0 THEN '0x' || hex(n_nationkey) END FROM nation""")
def crash_nodes(spark, sf):
    note = lambda k: F.try_element_at("metadata", F.lit(k))
    return crash_graph(spark, sf)[0].select("id", "type", "label", "risk", note("crash_type").alias("kind"), note("stack_trace").alias("frames"), note("fault_address").alias("address"))


@query(f"WITH {TREE}, {RISKS} SELECT id, risk FROM i ORDER BY risk DESC, ord LIMIT 10")
def top_risk(spark, sf):
    return G.top_risk(tree(spark, sf)[0]).select("id", "risk")


@query(f"""WITH RECURSIVE {TREE}, p AS (SELECT 'r' || r_regionkey AS src, ['r' || r_regionkey] AS path, 0 AS hops FROM region UNION ALL SELECT src, list_append(path, e.target), hops + 1 FROM p JOIN e ON e.source = path[-1] WHERE NOT list_contains(path, e.target)),
t AS (SELECT src, path[-1] AS dst, path, hops FROM p WHERE path[-1] IN ('n0', 'n1', 'n2', 's1', 's2', 's3', 'c5')), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS n FROM t) SELECT src, dst, array_to_string(path, '>') AS path, hops FROM r WHERE n <= 5""")
def simple_paths(spark, sf):
    pairs = spark.createDataFrame([(f"r{r}", d) for r in range(5) for d in ("n0", "n1", "n2", "s1", "s2", "s3", "c5")], "src string, dst string")
    return G.simple_paths(tree(spark, sf)[1], pairs).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH RECURSIVE {TREE}, {RISKS}, k AS (SELECT id, ord FROM i WHERE risk >= 0.7 ORDER BY ord LIMIT 50), p AS (SELECT id AS src, [id] AS path FROM k UNION ALL SELECT src, list_append(path, e.target) FROM p JOIN e ON e.source = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, e.target)),
q AS (SELECT src, path[-1] AS dst, path, row_number() OVER (PARTITION BY src, path[-1] ORDER BY len(path), path) AS n FROM p), t AS (SELECT src, dst, path, a.ord AS oa, b.ord AS ob FROM q JOIN k a ON a.id = src JOIN k b ON b.id = dst AND a.ord < b.ord WHERE n = 1 ORDER BY oa, ob LIMIT 20)
SELECT src, dst, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM t""")
def high_risk_paths(spark, sf):
    return G.high_risk_paths(*tree(spark, sf), threshold=0.7).withColumn("path", F.array_join("path", ">"))


def risky(spark, sf):
    n = tree(spark, sf)[0]
    return n.withColumns({"label": F.col("id"), "file": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("src/a."), "id", F.lit(".c"))), "line": F.when(F.col("ord") % 4 == 0, F.col("ord").cast("int"))})


GRAPH_EVIDENCE = f"""WITH {TREE}, {RISKS}, g AS (SELECT 'graph:' || id AS pointer, substr(id, 1, 1) || ' ''' || id || ''' risk=' || printf('%.2f', risk) || ' file=' || CASE WHEN ord % 2 = 0 THEN 'src/a.' || id || '.c' ELSE 'None' END || ':' || CASE WHEN ord % 4 = 0 THEN CAST(ord AS VARCHAR) ELSE 'None' END AS fragment,
CASE WHEN ord % 2 = 0 THEN substr(id, 1, 1) || ',a.' || id ELSE substr(id, 1, 1) END AS keywords FROM i WHERE risk >= 0.75)"""


@query(f"{GRAPH_EVIDENCE} SELECT * FROM g")
def graph_evidence(spark, sf):
    return R.graph_evidence(risky(spark, sf)).withColumn("keywords", F.array_join("keywords", ","))


@query(f"{GRAPH_EVIDENCE} SELECT count(DISTINCT pointer) AS fragments, (SELECT count(DISTINCT k) FROM (SELECT unnest(string_split(keywords, ',')) AS k FROM g)) AS keywords FROM g")
def evidence_counts(spark, sf):
    return R.evidence_counts(R.graph_evidence(risky(spark, sf)))


def documented(spark, sf):
    nodes, edges = tree(spark, sf)
    nodes = nodes.where("type IN ('r', 'n')").select("id", "type", F.col("id").alias("label"), F.lit(None).cast("string").alias("file"), F.col("ord").cast("int").alias("line"), F.when(F.col("type") == "r", F.lit(float("nan"))).otherwise(F.col("risk")).alias("risk"), F.create_map(F.lit("ord"), F.col("ord").cast("string")).alias("metadata"))
    edges = edges.where("target LIKE 'n%' AND source LIKE 'r%'").withColumn("metadata", F.create_map(F.lit("to"), F.col("target")))
    return nodes, edges


@query(f"""WITH {TREE}, {RISKS} SELECT 'node' AS kind, id AS a, CAST(NULL AS VARCHAR) AS b, CASE WHEN id LIKE 'r%' THEN 0.0::DOUBLE ELSE risk END AS weight, CAST(ord AS INTEGER) AS line, CAST(ord AS VARCHAR) AS note FROM i WHERE id LIKE 'r%' OR id LIKE 'n%'
UNION ALL SELECT 'edge', source, target, 1.0, -1, target FROM e WHERE source LIKE 'r%' AND target LIKE 'n%'""")
def graph_document(spark, sf):
    path = scratch(spark, "graph")
    S.write_graph(*documented(spark, sf), path)
    nodes, edges = S.read_graph(spark, path)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.col("risk").alias("weight"), "line", F.col("metadata")["ord"].alias("note"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "weight", F.lit(-1).alias("line"), F.col("metadata")["to"].alias("note")))


@query(f"""WITH {TREE}, {RISKS}, k AS (SELECT unnest([['node', 'type', 'string'], ['node', 'label', 'string'], ['node', 'file', 'string'], ['node', 'line', 'int'], ['node', 'risk', 'double'], ['edge', 'type', 'string'], ['edge', 'weight', 'double']]) AS k)
SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">', '</graph>', '</graphml>']) AS value UNION ALL SELECT '<key id="' || k[1] || '-' || k[2] || '" for="' || k[1] || '" attr.name="' || k[2] || '" attr.type="' || k[3] || '"/>' FROM k
UNION ALL SELECT '<node id="' || id || '"><data key="node-type">' || substr(id, 1, 1) || '</data><data key="node-label">&lt;' || id || '&gt;</data>' || CASE WHEN ord % 2 = 0 THEN '<data key="node-file">src/a.' || id || '.c</data>' ELSE '' END || CASE WHEN ord % 4 = 0 THEN '<data key="node-line">' || ord || '</data>' ELSE '' END || '<data key="node-risk">' || risk || '</data></node>' FROM i
UNION ALL SELECT '<edge source="' || source || '" target="' || target || '"><data key="edge-type">contains</data><data key="edge-weight">1.0</data></edge>' FROM e""")
def graphml(spark, sf):
    return S.graphml_lines(risky(spark, sf).withColumn("label", F.concat(F.lit("<"), "id", F.lit(">"))), tree(spark, sf)[1])


@query("""WITH h AS (SELECT vec_id, 1.0::DOUBLE / (vec_id + 1) AS score FROM embeddings) SELECT vec_id, coalesce(text, '') AS text, coalesce(source, 'none') AS source FROM h LEFT JOIN documents ON doc_id = vec_id""")
def hit_texts(spark, sf):
    hits = T(spark, sf, "embeddings").select("vec_id", (F.lit(1.0) / (F.col("vec_id") + 1)).alias("score"))
    texts = T(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    return R.with_texts(hits, texts).select("vec_id", "text", F.coalesce(F.try_element_at("metadata", F.lit("source")), F.lit("none")).alias("source"))


HEX = "(strpos('0123456789abcdef', substr(sha256({0}), (i % 64) + 1, 1)) - 1) / 15.0::DOUBLE - 0.5::DOUBLE"
VEC = f"list_transform(range(0, 64), lambda i: {HEX.format('{0}')})"
SIM = "list_sum(list_transform(range(1, 65), lambda i: v[i] * q[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x)))"
SAID = "t AS (SELECT n_nationkey AS ord, n_name AS text FROM nation UNION ALL SELECT 25 + item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE 'item ' || item_id END FROM benchmark)"


def said(spark, sf):
    b = T(spark, sf, "benchmark")
    found = b.select(F.col("item_id").alias("ord"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("hypothesis"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("description"))
    return R.context_texts(T(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("hypothesis")), found)


@query(f"""WITH q AS (SELECT {VEC.format("'use after free'")} AS q), {SAID}, s AS (SELECT 'ctx_' || ord AS id, text, {SIM} AS score FROM (SELECT ord, text, {VEC.format('text')} AS v FROM t), q) SELECT id, text, round(score, 4) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, id LIMIT 5""")
def context_hits(spark, sf):
    return R.context_hits(said(spark, sf), "use after free", 0.1).select("id", "text", F.round("score", 4).alias("score"))


@query(f"""WITH q AS (SELECT {VEC.format("'use after free'")} AS q), s AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, text, {SIM} AS score FROM (SELECT doc_id, source, text, {VEC.format('text')} AS v FROM documents), q), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM s ORDER BY score DESC, id LIMIT 5)
SELECT '### RAG Search Results for: use after free' || chr(10) || chr(10) || string_agg(printf('%d. [score=%.3f] [id=%s] [src=%s]', n, score, id, source) || chr(10) || '   ' || substr(text, 1, 400) || CASE WHEN length(text) > 400 THEN '...' ELSE '' END || chr(10), chr(10) ORDER BY n) AS text FROM b""")
def hit_listing(spark, sf):
    d = T(spark, sf, "documents")
    best = R.scored(d, "use after free", "doc_id", "text").orderBy(F.desc("score"), "id").limit(5)
    return R.listing(best.join(d.select(F.col("doc_id").cast("string").alias("id"), "source"), "id"), "use after free")
