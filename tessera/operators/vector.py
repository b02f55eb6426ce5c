"""Vectors: hash embeddings, normalisation, inner products and exact top-k search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one broadcast may hold; more are searched block by block.
QUERY_BLOCK = 4096
#: Scores that a task holds at once: some 8 MB, and a few times that to pick from.
CELLS = 1 << 20


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is a slot, a column put into a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Digits of the text's SHA-256, repeated to dim places and scaled to -0.5 .. 0.5."""
    digits = lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(d, i + 1, F.lit(1)), 16, 10).cast("double") / 15 - 0.5)
    repeated = lambda v: F.slice(F.flatten(F.array_repeat(v, -(-dim // 64))), 1, dim)
    return repeated(let(F.sha2(text, 256), digits))


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length, summed as doubles."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order: upserts and re-added ids."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def similarity_search(index: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k ids with the largest cosine similarity to one query (a literal in the plan): a scan and a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(normalise(F.col(vec_col)), normalise(q))
    return index.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def batch_search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Top k for each row of queries (query_id, query), exactly.

    Null vectors are left out on both sides. A shorter vector counts as filled up with zeros.

    Queries go to the tasks in blocks of QUERY_BLOCK rows; each task scores its vectors against
    a block with matrix products of CELLS scores and passes on its own k best a query, so what is shuffled is
    k rows a query and task, and what a task holds is bounded, whatever the index holds.
    """
    queries, index = queries.where("query IS NOT NULL"), index.where(F.col(vec_col).isNotNull())
    total, out = queries.count(), None
    blocks = max(1, -(-total // QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = _block(index.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), part.collect(), k)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def filled(values, lengths, np):
    """Rows that lie end to end as a matrix, filled up with zeros."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out


def _block(index: DataFrame, queries: list, k: int) -> DataFrame:
    ids, vectors = [r["query_id"] for r in queries], [[float(x) for x in r["query"]] for r in queries]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        q = filled(np.array([x for v in vectors for x in v], np.float64), np.array([len(v) for v in vectors], np.int64), np)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        at, best_s, best_i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # the k best a query so far, in order
        bound, width = np.full(len(ids), -np.inf), max(1, CELLS // max(1, len(ids)))
        for x in batches:
            for at_row in range(0, x.num_rows if len(ids) else 0, width):
                part = x.slice(at_row, width)
                v = filled(np.asarray(part.column(1).flatten().fill_null(0.0)), np.diff(np.asarray(part.column(1).offsets)), np)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                d = min(q.shape[1], v.shape[1])
                s = q[:, :d] @ (v / np.where(n > 0, n, 1))[:, :d].T
                s = np.where(np.isnan(s), -np.inf, s)
                low = np.maximum(bound, np.partition(s, -k, axis=1)[:, -k]) if k < s.shape[1] else bound
                row, col = np.nonzero(s >= low[:, None])
                at, best_s, best_i = np.concatenate((at, row)), np.concatenate((best_s, s[row, col])), np.concatenate((best_i, np.asarray(part.column(0))[col]))
                order = np.lexsort((best_i, -best_s, at))
                first = np.searchsorted(at[order], np.arange(len(ids)))
                order = order[np.arange(len(order)) - first[at[order]] < k]
                at, best_s, best_i = at[order], best_s[order], best_i[order]
                ends = np.searchsorted(at, np.arange(len(ids)), side="right")
                full = np.diff(ends, prepend=0) >= k
                bound[full] = best_s[ends[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[at]), pa.array(best_i), pa.array(np.where(np.isneginf(best_s), np.nan, best_s))], names=["query_id", "id", "score"])

    return index.mapInArrow(run, "query_id long, id long, score double")
