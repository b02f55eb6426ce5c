"""Operator 13, a Merkle manifest of a dataset: roots, and a proof for every row.

The rows of a group, in order, are the leaves of its tree, and the groups' roots, in order, those of
the tree above. Leaves fall into aligned blocks of 2**HEIGHT. A block's successive authentication
paths come from a fractal traversal (Jakobsson, Leighton, Micali and Szydlo, 2003): of each level
of subtrees the one that holds the leaf exists, and the next one is desired; two steps a leaf on its
stack complete it in time. So beside its leaves a block needs few nodes, not the whole tree. The
blocks' roots are the leaves of the next tier, by the same code, until one node is left of a group;
what a block lacks at the top, its upper proof, is joined to its rows by the block.

No task sees more than a block: ranks are places in ranges of rows plus the counts of ranges before.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StructField, StructType

from .common import attach, cut

#: Levels of a block, and of a subtree of the traversal.
HEIGHT, SUB = 12, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = ArrayType(StructType([StructField("left", BooleanType()), StructField("digest", BinaryType())]))


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(fields: dict[str, Column] | None = None) -> Column:
    """Lowercase hex SHA-256 of a row: of every field its byte count and value, or a dash. fields replaces columns of FIELDS."""
    return F.sha2(F.concat(*[field((fields or {}).get(c, F.col(c))) for c in FIELDS]), 256)


def parent(*children: bytes) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def _grow(leaves: list[bytes], counts: list[int], index: int, bottom: int, top: int, kept: dict):
    """Builds the subtree with this index below level top by a stack, a leaf or a hash a step; its nodes from level bottom on are kept. Returns its root."""
    stack, first, node = [], index << top, b""
    for i in range(first, min(first + (1 << top), counts[0])):
        level, j, node = 0, i, leaves[i]
        if not bottom:
            kept[0, i] = node
        yield
        while level < top:
            if j & 1:
                node = parent(stack.pop(), node)
            elif j == counts[level] - 1:
                node = parent(node)
            else:
                break
            level, j = level + 1, j >> 1
            if bottom <= level < top:
                kept[level, j] = node
            yield
        if level < top:
            stack.append(node)
    return node


def _finish(steps) -> bytes:
    while True:
        try:
            next(steps)
        except StopIteration as end:
            return end.value


def traverse(leaves: list[bytes], height: int, sub: int = SUB):
    """First the root of a tree with these leaves and levels, then for one leaf after the other its siblings from the leaf up (None where a node is alone)."""
    counts = [len(leaves)]
    for _ in range(height):
        counts.append(-(-counts[-1] // 2))
    levels = [(b, min(b + sub, height)) for b in range(0, height, sub)]
    existing, desired, root = [], [], leaves[0]
    for bottom, top in levels:
        kept: dict = {}
        root = _finish(_grow(leaves, counts, 0, bottom, top, kept))
        existing.append(kept)
        desired.append(None)
    yield root

    def wish(at: int, index: int) -> None:
        bottom, top = levels[at]
        kept: dict = {}
        desired[at] = (kept, _grow(leaves, counts, index, bottom, top, kept)) if index < counts[top] else None

    for at in range(len(levels)):
        wish(at, 1)
    for i in range(len(leaves)):
        path = []
        for (bottom, top), kept in zip(levels, existing):
            for level in range(bottom, top):
                other = (i >> level) ^ 1
                path.append(kept[level, other] if other < counts[level] else None)
        yield path
        for at, (_, top) in enumerate(levels):
            if desired[at]:
                next(desired[at][1], None)
                next(desired[at][1], None)
                if not (i + 1) & ((1 << top) - 1):
                    _finish(desired[at][1])
                    existing[at] = desired[at][0]
                    wish(at, ((i + 1) >> top) + 1)


def _block(levels: int):
    """For applyInArrow: a block's rows (g, pos, total, digest and more, in any order) plus path and, at its first leaf, top: the block's root."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("pos")
        height = min(levels, (table.column("total")[0].as_py() - 1).bit_length())
        steps = traverse(table.column("digest").to_pylist(), height)
        root = next(steps)
        flat = [d for path in steps for d in path]
        place = np.repeat(table.column("pos").to_numpy(), height)
        left = (place >> np.tile(np.arange(height), table.num_rows)) & 1 == 1
        digests = pa.array(flat, pa.binary())
        items = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), digests], names=["left", "digest"], mask=digests.is_null())
        path = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * height), items)
        return table.append_column("path", path).append_column("top", pa.array([root] + [None] * (table.num_rows - 1), pa.binary()))

    return run


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows plus pos (from 0 in each g, by order) and total (rows of g)."""
    at = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    at = cut(at.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    runs = at.groupBy("g", "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))  # a row a range and group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("g", "_p", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("g")).alias("total")))
    return attach(at, runs, ["g", "_p"], F.octet_length("g") + 24, "inner").withColumn("pos", F.col("_shift") + F.col("_i")).drop("_p", "_i", "_shift")


def _proved(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (g, pos, total, digest and more) plus path, up to the root of g, and root."""
    named = nodes.withColumn("block", F.shiftright("pos", height))
    schema = StructType([*named.schema.fields, StructField("path", PATH), StructField("top", BinaryType())])
    own = cut(named.groupBy("g", "block").applyInArrow(_block(height), schema))
    tops = own.where("top IS NOT NULL").select("g", F.col("block").alias("pos"), F.shiftright(F.col("total") + ((1 << height) - 1), height).alias("total"), F.col("top").alias("digest"))
    if tops.where("total > 1").isEmpty():
        upper = tops.select("g", F.col("pos").alias("block"), F.array().cast(PATH).alias("_up"), F.col("digest").alias("root"))
    else:
        upper = _proved(tops, height).select("g", F.col("pos").alias("block"), F.col("path").alias("_up"), "root")
    upper = cut(upper)
    out = attach(own.drop("top"), upper, ["g", "block"], F.octet_length("g") + 48 + 40 * F.size("_up"), "inner")
    return out.withColumn("path", F.concat("path", "_up")).drop("_up", "block")


def manifest(rows: DataFrame, group_col: str = "lang", order_col: str = "doc_id", leaf_col: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """rows (with hex digests in leaf_col) plus subroot, root and path: from the leaf up to root, every level's sibling and its side, null where a node is alone.

    Groups come in the order of their UTF-8 bytes, null first. Rows of a group come by order_col,
    null first, and then by their digest: equal rows are exchangeable. An empty table gives no rows.
    height: levels of a block. Other columns of rows are carried along; those with the three names are replaced.
    """
    kept = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    base = cut(rows.select(F.struct(*kept).alias("row"), F.when(F.col(group_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string"))).alias("g"), F.col(order_col).alias("_by"), F.unhex(leaf_col).alias("digest"), F.monotonically_increasing_id().alias("_row")))
    own = cut(_proved(_placed(base, "_by", "digest", "_row").drop("_by", "_row"), height))
    subroots = own.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
    above = _proved(_placed(subroots, "name"), height).select(F.col("name").alias("g"), F.col("path").alias("_up"), F.col("root").alias("_root"))
    out = attach(own, cut(above), ["g"], F.octet_length("g") + 48 + 40 * F.size("_up"), "inner")
    hex_ = lambda c: F.lower(F.hex(c))
    return out.select("row.*", hex_("root").alias("subroot"), hex_("_root").alias("root"), F.concat("path", "_up").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path of manifest() lead to."""
    digest = lambda s: F.lower(F.hex(s["digest"]))
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.when(s["digest"].isNull(), node).when(s["left"], F.concat(digest(s), node)).otherwise(F.concat(node, digest(s))), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the hex digests of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.filter(path, lambda s: s["digest"].isNotNull()), lambda s: F.lower(F.hex(s["digest"]))), ""), 256)


def manifest_digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 7 divides the id's CRC-32, the proof is tried on a row whose n_chars is one more."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf_hash().alias("leaf"), F.when(tampered, leaf_hash({"n_chars": F.col("n_chars") + 1})).alias("other"))
    out = manifest(rows).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The query, level by level: a table of all nodes, siblings by their places. CRC-32 by its table, which is made from the polynomial.
SQL = """
WITH RECURSIVE bits AS (SELECT i::UBIGINT AS b, i::UBIGINT AS v, 0 AS n FROM range(256) t(i)
UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY b) AS c FROM bits WHERE n = 8),
f AS (SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS z,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda a, h: xor(a >> 8, c[((xor(a, h) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS crc FROM documents, tab),
s AS (SELECT doc_id, lang, sha256(a || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
  CASE WHEN crc % 7 = 0 THEN sha256(a || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || z) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM s),
t AS (SELECT lang, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM p
  UNION ALL SELECT lang, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(m) + 1) // 2 FROM t WHERE m > 1 GROUP BY lang, lv, pos // 2),
u AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE m = 1),
r AS (SELECT 0 AS lv, pos, subroot AS h, count(*) OVER () AS m FROM u
  UNION ALL SELECT lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(m) + 1) // 2 FROM r WHERE m > 1 GROUP BY lv, pos // 2),
x AS (SELECT p.lang, p.pos, t.lv, CASE WHEN o.h IS NULL THEN '' WHEN o.pos < t.pos THEN 'L' || o.h ELSE 'R' || o.h END AS e
  FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos >> t.lv AND t.m > 1 LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM t.lang AND o.lv = t.lv AND o.pos = xor(t.pos, 1)),
y AS (SELECT lang, pos, list(e ORDER BY lv) AS es FROM x GROUP BY ALL),
v AS (SELECT u.pos, list(CASE WHEN o.h IS NULL THEN '' WHEN o.pos < r.pos THEN 'L' || o.h ELSE 'R' || o.h END ORDER BY r.lv) AS es
  FROM u JOIN r ON r.pos = u.pos >> r.lv AND r.m > 1 LEFT JOIN r o ON o.lv = r.lv AND o.pos = xor(r.pos, 1) GROUP BY u.pos),
w AS (SELECT p.doc_id, p.leaf, u.subroot, (SELECT h FROM r WHERE m = 1) AS root, coalesce(p.other, p.leaf) AS tried, list_concat(coalesce(y.es, []), coalesce(v.es, [])) AS es
  FROM p JOIN u ON u.lang IS NOT DISTINCT FROM p.lang LEFT JOIN y ON y.lang IS NOT DISTINCT FROM p.lang AND y.pos = p.pos LEFT JOIN v ON v.pos = u.pos),
z AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(es, lambda e: e[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(tried, es), lambda a, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || a WHEN e[1] = 'R' THEN a || e[2:] ELSE a END)) AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM z
"""
