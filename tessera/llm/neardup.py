"""Operator 3, near-duplicate documents by MinHash with sequential Bayesian verification.

A document's set holds its distinct 5-word shingles (ASCII letters lower-cased, words split at
ASCII white space). Documents whose sets are equal are collapsed first, so groups of copies of
any size cost one row a copy. Banded signatures name candidates; their signatures are compared
BATCH hashes at a time and a pair is pruned as soon as the posterior probability of a similarity
of the threshold or more falls below MISS; the pairs left are verified exactly on their full
sets of words. Bands: 24 of 6 hashes, which miss a pair with similarity 0.85 with probability
1.2e-5 and find lower ones far less often.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, grams, mix, only, slices, text_buffer, words
from .linking import binary_matrix, components, exact_links, link_groups, pruning_table

SHINGLE = 5
ROWS, BANDS = 6, 24
HASHES = ROWS * BANDS
BATCH = 24
MISS = 1e-5
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each row, sorted in each row, and their offsets (n + 1)."""
    _, _, h, first = words(LOWER[buf], offsets)
    n_words, n = np.diff(first), len(first) - 1
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    row = np.repeat(np.arange(n), count)
    value = np.empty(int(count.sum()), np.uint64)
    at = np.concatenate(([0], np.cumsum(count)))
    long_ = np.repeat(n_words >= k, count)
    if long_.any():
        all_grams = grams(h, k)
        value[long_] = all_grams[(np.arange(len(value)) - np.repeat(at[:-1] - first[:-1], count))[long_]]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        value[at[i]] = grams(h[first[i] : first[i + 1]], int(n_words[i]))[0] ^ np.uint64(n_words[i])
    order = np.lexsort((value, row))
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=n) if len(value) else np.zeros(n, np.int64)
    return value[new], np.concatenate(([0], np.cumsum(distinct))).astype(np.int64)


def minhashes(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signatures of the rows that have values: (rows, len(a)) uint32."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    x, starts = (values >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
    out = np.empty((len(a), len(full)), np.uint32)
    buffer = np.empty_like(x)
    for i in range(len(a)):
        np.bitwise_xor(x, b[i], out=buffer)
        np.multiply(buffer, a[i], out=buffer)
        out[i] = np.minimum.reduceat(buffer, starts) if len(full) else 0
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One int64 key for each band of each signature; the band's number is part of it."""
    bands = sig.shape[1] // rows
    part = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + part[:, :, r])
    return key.view(np.int64)


def _sign(batches):
    import pyarrow as pa

    for x in batches:
        buf, offsets = text_buffer(x.column(1))
        for lo, hi in slices(offsets):
            values, at = shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            n = np.diff(at)
            full = np.flatnonzero(n > 0)
            sig = minhashes(values, at, _A, _B)
            digest = np.zeros((2, hi - lo), np.int64)
            if len(full):
                digest[0, full] = np.add.reduceat(mix(values), at[:-1][full]).view(np.int64)
                digest[1, full] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full]).view(np.int64)
            empty = n == 0
            low = LOWER[buf[offsets[lo] : offsets[hi]]].tobytes()
            whole = [hashlib.blake2b(low[a:b], digest_size=16).digest() for a, b in zip((offsets[lo:hi] - offsets[lo]).tolist(), (offsets[lo + 1 : hi + 1] - offsets[lo]).tolist())]
            raw = iter(sig)
            sigs = pa.array([None if e else next(raw).tobytes() for e in empty], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1]), pa.array(whole, pa.binary()), sigs], names=["id", "n", "d0", "d1", "raw", "sig"])


def word_shingles(text: str, k: int = SHINGLE) -> frozenset:
    """The exact set of a text, for verification."""
    w = _split(text)
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)])


def _split(text: str) -> list[bytes]:
    # bytes.split() splits at exactly the six ASCII white-space bytes, bytes.lower() folds A-Z only
    return text.encode("utf-8").lower().split()


def hashed_sets(texts: list[str]) -> list[np.ndarray]:
    parts = [(t or "").encode("utf-8") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    values, at = shingle_sets(np.frombuffer(b"".join(parts), np.uint8), offsets)
    return [values[a:b] for a, b in zip(at, at[1:])]


def _linked(base: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """Of rows (id, text) a table with id and n (shingles), the roots of ids in components of several (id, root), and whether an id has several texts: then the roots don't hold."""
    signed = cut(base.mapInArrow(_sign, "id long, n long, d0 long, d1 long, raw binary, sig binary"))
    sets = signed.where("n > 0 AND id IS NOT NULL")
    if not sets.groupBy("id").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").isEmpty():
        return signed.select("id", "n"), signed.select("id", F.col("id").alias("root")), True
    known = base.where("id IS NOT NULL")
    # copies: equal texts (A-Z folded) by 128 bits of a cryptographic hash; texts whose sets have equal sizes and hashes
    # are confirmed on the sets. The groups are written first: their joins then have plain exchanges on both sides
    texts = cut(sets.groupBy("n", "d0", "d1", "raw").agg(F.min("id").alias("t"), F.count("*").alias("c")))
    same = cut(sets.select("id", "n", "d0", "d1", "raw").join(texts.where("c > 1").hint("merge"), ["n", "d0", "d1", "raw"]).where("id <> t").select("id", "t").distinct())
    groups = cut(texts.groupBy("n", "d0", "d1").agg(F.min("t").alias("u"), F.countDistinct("t").alias("c")).where("c > 1").drop("c"))
    alike = texts.join(groups.hint("merge"), ["n", "d0", "d1"]).where("t <> u").select("u", F.col("t").alias("v")).distinct()
    alike = cut(alike)
    ends = alike.select(F.col("u").alias("id")).unionByName(alike.select(F.col("v").alias("id"))).distinct()
    alike = cut(exact_links(alike, only(known, cut(ends), "id"), word_shingles, 100)) if not alike.isEmpty() else alike
    copies = same.join(alike.select(F.col("v").alias("t"), "u").hint("merge"), "t", "left").select("id", F.coalesce("u", "t").alias("rep"))
    copies = cut(copies.unionByName(alike.select(F.col("v").alias("id"), F.col("u").alias("rep"))).distinct())
    reps = sets.join(copies.select("id").distinct().hint("merge"), "id", "left_anti")
    signatures = reps.select("id", "sig", (F.col("n") * 8).alias("w")).dropDuplicates(["id"])
    keys = lambda sig: band_keys(sig, ROWS)
    found = link_groups(signatures, lambda col: keys(binary_matrix(col)), lambda ids: only(known, ids, "id"), word_shingles, hashed_sets, percent, pruning_table(HASHES, BATCH, percent / 100, MISS), BATCH, sets.count(), BANDS)
    roots = copies.join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root")).unionByName(found)
    roots = roots.groupBy("id").agg(F.min("root").alias("root"))
    return signed.select("id", "n"), roots, False


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union of the shingle sets. Null and empty texts, and
    those of white space only, have no shingles and no links. Fewer than five words make one
    shingle. component_id is the smallest id reachable; a null id is its own component and kept.
    Rows that repeat an id share its component, whatever their texts: where an id has several, rows are
    linked by numbers of their own first, and ids by their rows then. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, roots, several = _linked(base, percent)
    if several:
        own = F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())
        base = cut(base.select(F.col("id").alias("doc"), own.alias("id"), "text"))
        of = base.where("id IS NOT NULL").select("id", "doc")
        rows, roots, _ = _linked(base.select("id", "text"), percent)
        rows = rows.join(of.hint("merge"), "id", "left").select(F.col("doc").alias("id"), "n")
        joined = roots.join(of.hint("merge"), "id").select("doc", F.col("root").alias("id")).join(of.withColumnRenamed("doc", "v").hint("merge"), "id")
        roots = components(joined.select(F.col("doc").alias("u"), "v"))
    out = rows.join(roots.hint("merge"), "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: The query at 85 percent, from all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_ FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_),
c AS (SELECT doc_id, min(to_) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
