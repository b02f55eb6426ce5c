"""Reading and writing: source trees, graphs, vectors, sessions, checkpoints, crash folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sha_prefix
from ..operators.graph import EXTENSIONS
from ..operators.logs import sanitizer_crashes
from ..operators.routing import overlay
from .shared import path_in
from .stored import load_version, merge_into, read_store, save_version


def source_tree(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """path (below root), content of all files with these extensions; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.exists(F.array(*[F.lit(e) for e in extensions]), lambda e: F.endswith(F.col("path"), e))
    inside = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(len("/" + root.split(":", 1)[-1].strip("/")) + 2), F.lit(1_000_000))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    return files.where(wanted).select(inside.alias("path"), text.alias("content"))


def reports(spark: SparkSession, path: str, name: str = "json") -> DataFrame:
    """path and whole text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(name))


def crash_files(spark: SparkSession, folder: str, layout: str = "afl") -> DataFrame:
    """path of crash inputs: `id:` files (afl), or all but README.txt and *.log (libfuzzer)."""
    names = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    if layout == "afl":
        return names.where(F.col("name").rlike("^id(:|%3A)") & ~F.contains("name", F.lit("README"))).select("path")
    return names.where((F.col("name") != "README.txt") & ~F.endswith("name", F.lit(".log"))).select("path")


def crash_reports(spark: SparkSession, folder: str) -> DataFrame:
    """path, crash_type, stack, fault_address of the sanitizer logs in a folder."""
    return sanitizer_crashes(reports(spark, folder, "text"))


_NODE = "struct<type:string,label:string,file:string,line:int,risk:double,metadata:map<string,string>>"
_GRAPH = f"version int, nodes map<string,{_NODE}>, edges array<struct<source:string,target:string,type:string,weight:double,metadata:map<string,string>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph document; a missing risk is 0, a missing weight 1."""
    doc = reports(spark, path).select(F.from_json("json", _GRAPH).alias("g"))
    nodes = doc.select(F.explode("g.nodes").alias("id", "n")).select("id", "n.type", "n.label", "n.file", "n.line", F.coalesce("n.risk", F.lit(0.0)).alias("risk"), "n.metadata")
    edges = doc.select(F.explode("g.edges").alias("e")).select("e.source", "e.target", "e.type", F.coalesce("e.weight", F.lit(1.0)).alias("weight"), "e.metadata")
    return nodes, edges


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """json: the whole graph as one document. One document is one row, so this is for graphs that fit one; larger ones are kept as tables."""
    safe = F.when(~F.isnan("risk"), F.col("risk"))
    none = F.create_map().cast("map<string,string>")
    note = lambda df: (F.coalesce("metadata", none) if "metadata" in df.columns else none).alias("metadata")
    entry = F.struct(F.col("id").alias("key"), F.struct("type", "label", "file", "line", safe.alias("risk"), note(nodes)).alias("value"))
    order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    n = nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(entry), order)).alias("nodes"), F.count("*").alias("nn"))
    by = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    rows = F.array_sort(F.collect_list(F.struct(F.struct("source", "target", "type").alias("k"), F.struct("source", "target", "type", "weight", note(edges)).alias("v"))), by)
    e = edges.agg(F.transform(rows, lambda r: r["v"]).alias("edges"), F.count("*").alias("ne"))
    doc = F.struct(F.lit(1).alias("version"), "nodes", "edges", F.struct(F.col("nn").alias("node_count"), F.col("ne").alias("edge_count")).alias("metrics"))
    return n.crossJoin(e).select(F.to_json(doc).alias("json"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_document(nodes, edges).write.mode("overwrite").text(path)


#: Attributes of a GraphML document: for what, name, type.
GRAPHML = (("node", "type", "string"), ("node", "label", "string"), ("node", "file", "string"), ("node", "line", "int"), ("node", "risk", "double"), ("edge", "type", "string"), ("edge", "weight", "double"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: GraphML, a line a row, in order. Attributes that are null, or that the tables lack, are left out."""
    spark = nodes.sparkSession
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{what}-{name}" for="{what}" attr.name="{name}" attr.type="{kind}"/>' for what, name, kind in GRAPHML), '<graph edgedefault="directed">']
    fixed = spark.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")], "part int, ord string, value string")

    def data(df: DataFrame, what: str):
        put = lambda n: F.coalesce(F.concat(F.lit(f'<data key="{what}-{n}">'), esc(F.col(n)), F.lit("</data>")), F.lit(""))
        return F.concat(F.lit(""), *[put(n) for w, n, _ in GRAPHML if w == what and n in df.columns])

    named = lambda c: esc(F.coalesce(F.col(c), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit('<node id="'), named("id"), F.lit('">'), data(nodes, "node"), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source", "target", "type").alias("ord"), F.concat(F.lit('<edge source="'), named("source"), F.lit('" target="'), named("target"), F.lit('">'), data(edges, "edge"), F.lit("</edge>")).alias("value"))
    return fixed.unionByName(n).unionByName(e).orderBy("part", "ord").select("value")


def add_vectors(vectors: DataFrame, path: str, order: str = "ord") -> int:
    """Upsert vectors (vec_id, embedding, an order and more) into a store; see merge_into()."""
    return merge_into(vectors, path, ["vec_id"], order)


def read_vectors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One vector an id, the last one added: a plain scan, which was settled when it was written."""
    return read_store(spark, path, schema)


def checkpoint_key(target):
    return sha_prefix(target, 12)


def _of(folder: str, target: str) -> str:
    import hashlib

    return f"{folder}/{hashlib.sha256(target.encode()).hexdigest()[:12]}"


def save_state(df: DataFrame, folder: str, target: str) -> int:
    """A new version of a target's state, committed as a whole; the folder's name is the start of the target's SHA-256."""
    return save_version(df, _of(folder, target))


def load_state(spark: SparkSession, folder: str, target: str, schema: str) -> DataFrame:
    """The last committed state of a target, an empty table if there is none. What can't be read raises."""
    return load_version(spark, _of(folder, target), schema)


def profiles(spark: SparkSession, settings: dict) -> DataFrame:
    """name, settings (JSON) of routing profiles as a small table."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in settings.items()], "name string, settings string")


def read_profiles(spark: SparkSession, path: str, defaults: dict) -> DataFrame:
    """Profiles as a small table: the defaults, with what a YAML file has under `capabilities` laid over them; the defaults alone if there is no such file or it is no YAML map."""
    import yaml

    place, store = path_in(spark, path)
    text = reports(spark, path, "text").first() if store.exists(place) else None
    try:
        user = (yaml.safe_load(text["text"]) or {}).get("capabilities", {}) if text else {}
    except (yaml.YAMLError, AttributeError):
        user = {}
    return profiles(spark, overlay(defaults, user))


#: Tables of a session. Keywords of evidence are kept as they were given.
SESSION = ("steps", "evidence", "costs", "hypotheses", "blacklist", "failed_tools", "confirmed", "critiques", "state")


def write_session(parts: dict[str, DataFrame], folder: str) -> None:
    """The named tables of a session (SESSION has the names); a session may lack some."""
    for name, df in parts.items():
        if name not in SESSION:
            raise ValueError(f"{name} is no part of a session")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_session(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that were written, by name."""
    out = {}
    for name in SESSION:
        place, store = path_in(spark, f"{folder}/{name}")
        if store.exists(place):  # a session may lack a part; one that is there but can't be read raises
            out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def checkpoint_steps(steps: DataFrame, folder: str, every: int = 5, key: str = "session", order: str = "step_num") -> int:
    """Save every session up to its last `every`-th step as one version; sessions with fewer steps save none. Returns its number.

    A session that was saved before and has no new mark stays as it was saved.
    """
    spark = steps.sparkSession
    marks = steps.where((F.col(order) > 0) & (F.col(order) % every == 0)).groupBy(F.col(key).alias("_k")).agg(F.max(order).alias("_m"))
    now = steps.join(marks, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) <= F.col("_m"))).select(*steps.columns)
    before = load_version(spark, folder, steps.schema)
    gone = before.join(marks.select("_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    return save_version(now.unionByName(gone), folder)


def resume_steps(spark: SparkSession, folder: str, schema: str, key: str = "session", order: str = "step_num") -> DataFrame:
    """The saved steps plus resumes: whether a session goes on after that one."""
    saved = load_version(spark, folder, schema)
    last = F.max(order).over(Window.partitionBy(key))
    return saved.withColumn("resumes", F.coalesce(F.col(order) == last, F.lit(False)))
