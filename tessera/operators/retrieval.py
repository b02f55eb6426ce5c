"""Retrieval: context candidates, merge-ranking, and the evidence store with its keyword index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stem
from ..sources.stored import merge_into, read_store
from .vector import dot, hash_embedding, normalise


def scored(texts: DataFrame, query: str, id_col: str, text_col: str, dim: int = 384) -> DataFrame:
    """id, text, score: cosine similarity of hash embeddings to the query's.

    They repeat every 64 places, so the similarity of one period is that of any number of whole ones.
    """
    dim = 64 if dim % 64 == 0 else dim
    q = normalise(hash_embedding(F.lit(query), dim))
    return texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), dot(normalise(hash_embedding(F.col(text_col), dim)), q).alias("score"))


def context_hits(context: DataFrame, query: str, min_score: float, top: int = 5) -> DataFrame:
    """Of session texts (ord, text) those at least min_score similar, the best `top`, as ctx_<ord>."""
    hits = scored(context, query, "ord", "text").where(F.col("score") >= min_score)
    return hits.orderBy(F.desc("score"), "id").limit(top).withColumn("id", F.concat(F.lit("ctx_"), "id"))


def merge_hits(context: DataFrame, index: DataFrame, top_k: int, boost: float = 0.05) -> DataFrame:
    """Union of both; context hits gain `boost` and win over index hits with the same first 100 characters."""
    ctx = context.withColumn("score", F.least(F.col("score") + boost, F.lit(1.0))).withColumn("src", F.lit(0))
    both = ctx.unionByName(index.withColumn("src", F.lit(1))).withColumn("key", F.substring("text", 1, 100))
    w = Window.partitionBy("key").orderBy("src", F.desc("score"), "id")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").orderBy(F.desc("score"), "id").limit(top_k).drop("n", "key")


def rag_search(index: DataFrame, context: DataFrame, query: str, top_k: int = 8, min_score: float = 0.65, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (500 characters), score (4 places), src. The index gives 3 * top_k; score and length are tested after the top-k, so fewer may come back."""
    if not query.strip():
        raise ValueError("empty query")
    hits = scored(index, query, id_col, text_col).orderBy(F.desc("score"), "id").limit(3 * top_k)
    merged = merge_hits(context_hits(context, query, min_score), hits, top_k)
    return merged.where((F.col("score") >= min_score) & (F.length("text") >= 20)).select("id", F.substring("text", 1, 500).alias("text"), F.round("score", 4).alias("score"), "src")


def default_keywords(fragment: Column) -> Column:
    """Of the first three lower-cased words those longer than three characters."""
    words = F.filter(F.split(F.lower(fragment), r"\s+"), lambda w: w != "")
    return F.filter(F.slice(words, 1, 3), lambda w: F.length(w) > 3)


def evidence_index(evidence: DataFrame) -> DataFrame:
    """keyword, pointer: explicit keywords (lower-cased) or the default ones."""
    given = F.transform("keywords", lambda k: F.lower(k)) if "keywords" in evidence.columns else F.lit(None).cast("array<string>")
    words = F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(default_keywords(F.col("fragment")))
    return evidence.select(F.explode(words).alias("keyword"), "pointer").distinct()


_POSTING, _FRAGMENT = "keyword string, pointer {0}, ord long", "pointer {0}, fragment string, ord long"


def put_evidence(evidence: DataFrame, path: str, ord_: int = 0) -> None:
    """Add evidence (pointer, fragment and, if given, keywords) to a store: its fragments, and postings that lie in parts by keyword. Texts are in the first only.

    A pointer that comes again with a higher ord_ replaces its fragment, and its new keywords are
    added to those that it has. Of rows with one pointer in one call the last fragment counts.
    """
    at = F.lit(ord_).cast("long").alias("ord")
    postings = evidence_index(evidence).where("pointer IS NOT NULL").select("keyword", "pointer", at)
    merge_into(evidence.select("pointer", "fragment", at), f"{path}/fragments", ["pointer"], "ord", ties=("fragment",))
    merge_into(postings, f"{path}/postings", ["keyword", "pointer"], "ord", within=["keyword"])


def find_evidence(spark: SparkSession, path: str, keyword: str, pointer: str = "string") -> DataFrame:
    """pointer, fragment of a keyword's postings (pointer: the type of pointers): of these only the part that may hold the keyword is read."""
    hits = read_store(spark, f"{path}/postings", _POSTING.format(pointer), keyword=keyword.lower()).select("pointer")
    return hits.join(read_store(spark, f"{path}/fragments", _FRAGMENT.format(pointer)).select("pointer", "fragment"), "pointer")


def get_evidence(spark: SparkSession, path: str, pointer) -> DataFrame:
    """pointer, fragment of one pointer, from its part alone."""
    return read_store(spark, f"{path}/fragments", _FRAGMENT.format("long" if isinstance(pointer, int) else "string"), pointer=pointer).select("pointer", "fragment")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """One row: fragments and distinct keywords."""
    return evidence.agg(F.countDistinct("pointer").alias("fragments")).crossJoin(evidence_index(evidence).agg(F.countDistinct("keyword").alias("keywords")))


def graph_evidence(nodes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Evidence rows (pointer, fragment, keywords) of risky nodes."""
    keywords = F.when(F.col("file").isNotNull(), F.array("type", stem(F.col("file")))).otherwise(F.array("type"))
    text = F.concat(F.col("type"), F.lit(" '"), F.col("label"), F.lit("' risk="), F.format_string("%.2f", "risk"), F.lit(" file="), F.coalesce("file", F.lit("None")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("None")))
    return nodes.where(F.col("risk") >= threshold).select(F.concat(F.lit("graph:"), "id").alias("pointer"), text.alias("fragment"), keywords.alias("keywords"))


def with_texts(hits: DataFrame, texts: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """hits with text and metadata of their ids; unknown ids get an empty text and map. hits are few (a top-k), texts are not."""
    out = hits.join(texts.select(id_col, "text", "metadata"), id_col, "left")
    return out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


# The texts of a listing.
HEAD, LINE, NOTHING = "### RAG Search Results for: {0}\n\n", "%d. [score=%.3f] [id=%s] [src=%s]\n   ", "No relevant results found for query: {0}"


def listing(hits: DataFrame, query: str) -> DataFrame:
    """text: the hits (id, text, score, source) as a numbered list, best first. hits are few (a top-k)."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "source", "text")))
    short = lambda t: F.concat(F.substring(t, 1, 400), F.when(F.length(t) > 400, "...").otherwise(""))
    line = lambda r, i: F.concat(F.format_string(LINE, i + 1, -r["s"], r["id"], r["source"]), short(r["text"]), F.lit("\n"))
    head = F.lit(HEAD.format(query))
    return hits.agg(F.when(F.count("*") == 0, F.lit(NOTHING.format(query))).otherwise(F.concat(head, F.array_join(F.transform(rows, line), "\n"))).alias("text"))


def context_texts(hypotheses: DataFrame, confirmed: DataFrame) -> DataFrame:
    """ord, text of a session: its hypotheses, then what confirmed findings say (hypothesis, else description). Both have ord, from 0."""
    before = hypotheses.agg(F.count("*").alias("_n"))
    said = confirmed.crossJoin(F.broadcast(before)).select((F.col("ord") + F.col("_n")).alias("ord"), F.coalesce("hypothesis", "description").alias("text"))
    return hypotheses.select("ord", F.col("hypothesis").alias("text")).unionByName(said.where("text IS NOT NULL"))
