"""Code graphs: building, upserts, risk, PageRank and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import cut, dealt
from ..sources.stored import merge_into
from .logs import LINES
from .paths import shortest_paths, simple_paths  # noqa: F401 (the second is taken from here)

# Names that are no functions, the patterns of functions, and the extensions read.
CPP_KEYWORDS = ("if", "else", "while", "for", "switch", "case", "return", "try", "catch", "throw", "new", "delete", "do", "goto", "static_assert", "sizeof", "alignof", "decltype", "auto")
JS_KEYWORDS = ("if", "else", "while", "for", "switch", "return", "try", "catch", "throw", "new", "delete", "do", "await")
CPP_FUNCTION = r"^\s*(?:[\w:<>*&]+\s+)+(\w+)\s*\([^;)]{0,200}\)\s*(?:const\s*)?(?:override\s*)?[{;]"
JS_FUNCTIONS = (r"\bfunction\s+(\w+)\s*\(", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", r"\b(?:async\s+)?(\w+)\s*\([^)]{0,100}\)\s*\{")
CPP_EXTENSIONS = (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx")
JS_EXTENSIONS = (".js", ".mjs", ".cjs")
EXTENSIONS = (*CPP_EXTENSIONS, *JS_EXTENSIONS, ".rs", ".py", ".idl", ".ipdl", ".ipdlh")


def _numbered(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", LINES)).alias("pos", "line"))


def functions_cpp(files: DataFrame) -> DataFrame:
    """path, name, line, signature of functions defined or declared at the start of a line. files: path, content."""
    name = F.regexp_extract("line", CPP_FUNCTION, 1)
    return _numbered(files).select("path", name.alias("name"), (F.col("pos") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 200).alias("signature")).where((F.col("name") != "") & ~F.col("name").isin(*CPP_KEYWORDS))


def functions_js(files: DataFrame) -> DataFrame:
    """As above for scripts: of each of three patterns the first name in a line that is no keyword, so up to three rows a line."""
    found = [F.get(F.filter(F.regexp_extract_all("line", F.lit(p), F.lit(1)), lambda n: ~n.isin(*JS_KEYWORDS)), F.lit(0)) for p in JS_FUNCTIONS]
    rows = _numbered(files).withColumn("name", F.explode(F.array_compact(F.array(*found))))
    return rows.select("path", "name", (F.col("pos") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 200).alias("signature"))


def _ends(path, extensions):
    return F.exists(F.array(*[F.lit(e) for e in extensions]), lambda e: F.endswith(path, e))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, counts. Files have risk 0.3, functions 0.5; of functions with one name in a file the last line counts. counts.functions_found counts every occurrence."""
    files = files.where(_ends(F.col("path"), EXTENSIONS))
    found = functions_cpp(files.where(_ends(F.col("path"), CPP_EXTENSIONS))).unionByName(functions_js(files.where(_ends(F.col("path"), JS_EXTENSIONS))))
    names = found.groupBy("path", "name").agg(F.max("line_no").alias("line"))
    file_id, func_id = F.concat(F.lit("file:"), "path"), F.concat(F.lit("func:"), "path", F.lit(":"), "name")
    nodes = files.select(file_id.alias("id"), F.lit("file").alias("type"), F.col("path").alias("label"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(0.3).alias("risk")).unionByName(
        names.select(func_id.alias("id"), F.lit("function").alias("type"), F.col("name").alias("label"), F.col("path").alias("file"), "line", F.lit(0.5).alias("risk"))
    )
    edges = names.select(file_id.alias("source"), func_id.alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    return nodes, edges, found.agg(F.count("*").alias("functions_found"))


def put_nodes(nodes: DataFrame, path: str, order: str = "ord") -> int:
    """Upsert nodes into a store by id; see merge_into()."""
    return merge_into(nodes, path, ["id"], order)


def put_edges(edges: DataFrame, path: str, order: str = "ord") -> int:
    """Upsert edges into a store by source, target and type. They lie in parts by source, so outgoing edges are in one."""
    return merge_into(edges, path, ["source", "target", "type"], order, within=["source"])


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source") == node).select("target").distinct()


def add_hypotheses(nodes: DataFrame, edges: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hypotheses: id, node, risk. Adds their nodes and edges to existing nodes, whose risk rises to 0.7 of theirs at least."""
    links = hypotheses.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    lift = links.groupBy("node").agg(F.max(F.col("risk") * 0.7).alias("_r"))
    raised = nodes.join(lift, nodes["id"] == lift["node"], "left").withColumn("risk", F.greatest("risk", F.coalesce("_r", F.lit(0.0)))).select(*nodes.columns)
    made = hypotheses.groupBy("id").agg(F.max("risk").alias("risk")).select("id", F.lit("hypothesis").alias("type"), F.col("id").alias("label"), "risk")
    new = links.select(F.col("id").alias("source"), F.col("node").alias("target"), F.lit("hypothesis_link").alias("type"), F.col("risk").alias("weight"))
    return raised.unionByName(made, allowMissingColumns=True), edges.unionByName(new, allowMissingColumns=True)


#: Characters of a gram, and labels with one gram that one key holds, about.
GRAM, SHARE = 3, 4096


def _grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    return F.array_distinct(F.transform(F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(n))))


def first_containing(labels: DataFrame, names: DataFrame) -> DataFrame:
    """name, node: for each name (distinct, not empty) the first node (by ord, then node) whose label holds it. labels: node, label, ord.

    A name meets only labels that hold its rarest run of GRAM characters: how many labels hold each
    run is counted first, for runs that names ask for. Labels with a run that is not rare enough are
    dealt to several keys by their node. A run that no label holds ends its names. Names shorter than
    a run are runs themselves: of those each has one first label, found by one aggregation.
    """
    names, best = cut(names.select("name").distinct()), F.min_by("node", F.struct("ord", "node")).alias("node")
    runs = lambda n: labels.select("node", "label", "ord", F.explode(_grams(F.col("label"), n)).alias("gram"))
    asked = cut(names.where(F.length("name") >= GRAM).select("name", F.explode(_grams(F.col("name"), GRAM)).alias("gram")))
    held = cut(runs(GRAM).join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")))
    rare = asked.join(held, "gram", "left").groupBy("name").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("least > 0")
    rare = cut(rare.select("name", "gram", F.ceil(F.col("least") / SHARE).cast("int").alias("parts")))
    dealt = runs(GRAM).join(rare.select("gram", "parts").distinct(), "gram").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    wanted = rare.select("name", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = dealt.join(wanted, ["gram", "part"]).where(F.contains("label", "name")).groupBy("name").agg(best)
    for n in sorted(r[0] for r in names.where(F.length("name") < GRAM).select(F.length("name")).distinct().collect()):
        short = names.where(F.length("name") == n).select(F.col("name").alias("gram"))
        out = out.unionByName(runs(n).join(short, "gram", "left_semi").groupBy(F.col("gram").alias("name")).agg(best))
    return out


def add_crashes(nodes: DataFrame, edges: DataFrame, crashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """crashes: id, functions and, if known, crash_type, stack_trace (an array) and fault_address.

    Each named function's first node (by ord) whose label holds the name gets an edge to the crash
    and risk 0.85 at least. A crash becomes a node with its type as label, and in its metadata the
    type, the first ten frames (a JSON array) and the address. Of rows with one id the first by what they
    hold makes the node; null and empty names match nothing.
    """
    names = crashes.select(F.col("id").alias("crash"), F.explode("functions").alias("name")).where("name <> ''").distinct()
    funcs = nodes.where("type = 'function'").select(F.col("id").alias("node"), "label", "ord")
    match = first_containing(funcs, names)
    hits = cut(names.join(match, "name").select("crash", "node").distinct())
    raised = nodes.join(hits.select(F.col("node").alias("id")).distinct().withColumn("_h", F.lit(0.85)), "id", "left").withColumn("risk", F.greatest("risk", F.coalesce("_h", F.lit(0.0)))).select(*nodes.columns)
    has = lambda c, kind: F.col(c) if c in crashes.columns else F.lit(None).cast(kind)
    kind, frames = F.coalesce(has("crash_type", "string"), F.lit("unknown")), F.coalesce(has("stack_trace", "array<string>"), F.array().cast("array<string>"))
    known = F.map_filter(F.create_map(F.lit("crash_type"), kind, F.lit("stack_trace"), F.to_json(F.slice(frames, 1, 10)), F.lit("fault_address"), has("fault_address", "string")), lambda _, v: v.isNotNull())
    made = crashes.select("id", F.struct(F.concat(F.lit("Crash: "), kind).alias("label"), F.map_entries(known).alias("m")).alias("c")).groupBy("id").agg(F.min("c").alias("c"))
    made = made.select("id", F.lit("crash").alias("type"), F.col("c.label").alias("label"), F.lit(0.9).alias("risk"), F.map_from_entries("c.m").alias("metadata"))
    new = hits.select(F.col("node").alias("source"), F.col("crash").alias("target"), F.lit("crash_link").alias("type"), F.lit(1.0).alias("weight"))
    return raised.unionByName(made, allowMissingColumns=True), edges.unionByName(new, allowMissingColumns=True)


def top_risk(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("risk"), "ord").limit(n)


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("nodes"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


#: Rounds of PageRank between two written tables.
ROUNDS = 10


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, rank: PageRank personalised by risk; dangling mass goes by the personalisation too.

    Parallel edges count once, with the last type's weight. Endpoints that no node declares take
    part with no personalisation. What comes back by the personalisation, from dangling nodes or by the damping, is a
    multiple of it, so the ranks are those of x = p + damping * A x, made to sum up to one. That
    sum only grows, and the rounds (`most` at most) end when ROUNDS of them add less than the tolerance.

    Edges are dealt into buckets by source once, nodes and x by id, so a round shuffles
    contributions only.
    """
    spark = nodes.sparkSession
    e = edges.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(F.max_by("weight", "type").alias("w"))
    e = cut(e)
    e = e.join(e.groupBy("source").agg(F.sum("w").alias("all")), "source").select("source", "target", (F.col("w") / F.col("all")).alias("w"))
    ids = nodes.select("id", "risk").unionByName(e.select(F.col("source").alias("id"), F.lit(0.0).alias("risk"))).unionByName(e.select(F.col("target").alias("id"), F.lit(0.0).alias("risk")))
    ids = cut(ids.groupBy("id").agg(F.max("risk").alias("risk")))
    total, n = ids.agg(F.sum("risk"), F.count("*")).first()
    p = F.col("risk") / F.lit(total) if total and total > 0 else F.lit(1.0 / max(n, 1))
    with dealt(spark) as put:
        e = put(e, "source")
        base = put(ids.select("id", p.alias("p")), "id")
        x, before = base.select("id", F.col("p").alias("x")), 1.0
        for _ in range(-(-most // ROUNDS)):
            for _ in range(ROUNDS):
                flow = x.join(e, x["id"] == e["source"]).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("in"))
                x = base.join(flow, "id", "left").select("id", (F.col("p") + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("x"))
            seen = Observation()
            x = put(x.observe(seen, F.sum("x").alias("sum")), "id")
            now = seen.get.get("sum") or x.agg(F.sum("x")).first()[0] or 0.0
            if now - before <= tolerance * now:
                break
            before = now
        return cut(x.select("id", (F.col("x") / F.lit(now or 1.0)).alias("rank")))


def high_risk_paths(nodes: DataFrame, edges: DataFrame, threshold: float = 0.7, longest: int = 5, sources: int = 50, most: int = 20) -> DataFrame:
    """One shortest path for each pair of the first `sources` risky nodes (by ord, earlier one first), of `longest` nodes at most; `most` rows."""
    risky = nodes.where(F.col("risk") >= threshold).orderBy("ord").limit(sources).select("id", "ord")
    pairs = risky.alias("a").join(F.broadcast(risky).alias("b"), F.col("a.ord") < F.col("b.ord")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.ord").alias("oa"), F.col("b.ord").alias("ob"))
    paths = shortest_paths(edges, pairs, depth=longest - 1, most=1)
    return paths.join(pairs, ["src", "dst"]).orderBy("oa", "ob").limit(most).select("src", "dst", "path", "hops")


def link_edges(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """source (page:<id>), target, weight: the links of pages, with how often each occurs."""
    found = F.explode(F.regexp_extract_all(html_col, F.lit('href="([^"]+)"'), F.lit(1)))
    rows = pages.select(F.concat(F.lit("page:"), F.col(id_col).cast("string")).alias("source"), found.alias("target"))
    return rows.groupBy("source", "target").agg(F.count("*").alias("weight"))
