"""Paths, containment and ranks against plain Python on random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import paths as P


def random_graph(seed, n=14, m=30):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


def all_simple(edges, src, dst, longest=99):
    out, found = defaultdict(set), []
    for a, b in edges:
        out[a].add(b)
    todo = deque([[src]])
    while todo:
        p = todo.popleft()
        if p[-1] == dst:
            found.append(p)
        elif len(p) <= longest:
            todo.extend([*p, x] for x in out[p[-1]] if x not in p)
    return sorted(found, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_a_plain_search(spark, seed):
    edges = random_graph(seed)
    pairs = [(f"n{a}", f"n{b}") for a in range(5) for b in range(0, 14, 2)]
    e = spark.createDataFrame([*edges, edges[0], (None, "n1"), ("n1", None)], "source string, target string").withColumn("path", F.lit(1))
    p = spark.createDataFrame([*pairs, pairs[1], (None, "n1"), ("n1", None), ("n1", "gone")], "src string, dst string")
    groups = lambda df: {k: [r["path"] for r in sorted(df.where((F.col("src") == k[0]) & (F.col("dst") == k[1])).collect(), key=lambda r: (r["hops"], r["path"]))] for k in {(r["src"], r["dst"]) for r in df.select("src", "dst").distinct().collect()}}
    shortest, simple, capped = defaultdict(list), defaultdict(list), defaultdict(list)
    for got, df in ((shortest, P.shortest_paths(e, p, most=2)), (simple, P.simple_paths(e, p, most=4)), (capped, P.simple_paths(e, p, most=4, depth=3))):
        for r in df.collect():
            assert r["hops"] == len(r["path"]) - 1
            got[r["src"], r["dst"]].append(r["path"])
    for a, b in pairs:
        want = all_simple(edges, a, b)
        assert sorted(shortest[a, b]) == [w for w in want if len(w) == len(want[0])][:2] if want else not shortest[a, b]
        assert sorted(simple[a, b], key=lambda w: (len(w), w)) == want[:4]
        assert sorted(capped[a, b], key=lambda w: (len(w), w)) == [w for w in want if len(w) <= 4][:4]
    assert P.shortest_paths(e.limit(0), p).where("src <> dst").isEmpty() and P.simple_paths(e, p.limit(0)).isEmpty() and groups(P.shortest_paths(e, p.limit(0))) == {}


def test_many_paths_stay_few_rows(spark):
    """A ladder of 30 steps has 2**30 shortest paths."""
    edges = spark.createDataFrame([(f"{a}{i}", f"{b}{i + 1}") for i in range(30) for a in "uv" for b in "uv"], "source string, target string")
    got = P.shortest_paths(edges, spark.createDataFrame([("u0", "u30")], "src string, dst string"), most=3).collect()
    assert sorted(r["path"][-3] + r["path"][-2] for r in got) == ["u28u29", "u28v29", "v28u29"]


def test_many_simple_paths_stay_few_rows(spark):
    """The same ladder, whose prefixes can't all be kept, with a step back in its middle that no simple path takes."""
    steps = [(f"{a}{i}", f"{b}{i + 1}") for i in range(30) for a in "uv" for b in "uv"]
    edges = spark.createDataFrame([*steps, ("u15", "u14")], "source string, target string")
    got = P.simple_paths(edges, spark.createDataFrame([("u0", "u30"), ("u0", "u1")], "src string, dst string"), most=3).collect()
    ladder = [[f"u{i}" for i in range(28)] + [x, y, "u30"] for x, y in (("u28", "u29"), ("u28", "v29"), ("v28", "u29"))]
    assert sorted(r["path"] for r in got if r["dst"] == "u30") == ladder and [r["path"] for r in got if r["dst"] == "u1"] == [["u0", "u1"]]


def test_first_label_that_holds_a_name(spark):
    r = random.Random(3)
    labels = [(f"f{i}", "fn_" + "".join(r.choice("abc_") for _ in range(r.randint(0, 9))), r.randrange(500)) for i in range(700)] + [("null", None, 0), ("short", "a", 3), ("é", "fn_é日本", 9)]
    names = ["fn_", "a", "_a", "abc", "fn_a", "ab_c", "zzz", "b", "日", "é日本", "fn_aabbccaabb"] + [x[1] for x in r.sample(labels[:700], 40)]
    df = spark.createDataFrame(labels, "node string, label string, ord long").repartition(4)
    got = {x["name"]: x["node"] for x in G.first_containing(df, spark.createDataFrame([(n,) for n in [*names, "fn_"]], "name string")).collect()}
    want = {n: min(((o, i) for i, t, o in labels if t and n in t), default=(0, None))[1] for n in names}
    assert got == {k: v for k, v in want.items() if v}
    assert G.first_containing(df.limit(0), spark.createDataFrame([("abc",)], "name string")).isEmpty()


def test_one_prefix_of_all_labels_is_no_hot_key(spark):
    labels = spark.range(40_000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("node"), F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("label"), F.col("id").alias("ord"))
    names = spark.createDataFrame([("fn_",), ("fn_39999",), ("fn_1",)], "name string")
    assert {x["name"]: x["node"] for x in G.first_containing(labels, names).collect()} == {"fn_": "f0", "fn_39999": "f39999", "fn_1": "f1"}
    plan = G.first_containing(labels, names)._jdf.queryExecution().toString()
    assert "gram" in plan and "part" in plan


def test_crash_nodes(spark):
    nodes = spark.createDataFrame([("f1", "function", "parse", 0.5, 1)], "id string, type string, label string, risk double, ord long")
    edges = spark.createDataFrame([], "source string, target string, type string, weight double")
    crashes = spark.createDataFrame([("c1", ["parse"], "heap", [f"#{i}" for i in range(12)], "0x1"), ("c2", None, None, None, None), ("c1", ["parse"], "zz", None, None)], "id string, functions array<string>, crash_type string, stack_trace array<string>, fault_address string")
    got = {r["id"]: r for r in G.add_crashes(nodes, edges, crashes)[0].collect()}
    assert len(got) == 3 and got["c1"]["label"] == "Crash: heap" and got["c1"]["metadata"]["fault_address"] == "0x1" and got["c1"]["metadata"]["stack_trace"].count("#") == 10
    assert got["c2"]["label"] == "Crash: unknown" and got["c2"]["metadata"] == {"crash_type": "unknown", "stack_trace": "[]"}


def test_ranks_against_power_iteration(spark):
    edges = [(a, b) for a, b in random_graph(5, 20, 40)] + [("n1", "n2")]
    nodes = [(f"n{i}", (i % 4) / 4) for i in range(25)]
    ids, risk = [f"n{i}" for i in range(25)], dict(nodes)
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    p, rank = {i: risk[i] / sum(risk.values()) for i in ids}, {i: 1 / 25 for i in ids}
    for _ in range(200):
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.85 * (sum(rank[j] / len(out[j]) for j in ids if i in out[j]) + lost * p[i]) + 0.15 * p[i] for i in ids}
    e = spark.createDataFrame([(a, b, "t", 1.0) for a, b in edges], "source string, target string, type string, weight double")
    got = {r["id"]: r["rank"] for r in G.pagerank(spark.createDataFrame(nodes, "id string, risk double"), e, most=200, tolerance=1e-12).collect()}
    assert got == pytest.approx(rank, abs=1e-9)
    none = spark.createDataFrame(nodes, "id string, risk double").withColumn("risk", F.lit(0.0))
    assert {round(r["rank"], 6) for r in G.pagerank(none, e.limit(0)).collect()} == {0.04} and G.pagerank(none.limit(0), e.limit(0)).isEmpty()


def test_a_round_shuffles_contributions_only(spark):
    from tessera.sources.shared import dealt

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with dealt(spark) as put:
            e = put(spark.range(1000).selectExpr("cast(id % 100 as string) source", "cast(id % 77 as string) target", "1.0D w"), "source")
            x = put(spark.range(100).selectExpr("cast(id as string) id", "1.0D x", "1.0D p"), "id")
            flow = x.join(e, x["id"] == e["source"]).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("in"))
            plan = x.select("id", "p").join(flow, "id", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
