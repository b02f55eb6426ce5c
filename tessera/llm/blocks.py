"""Operator 2, exact dedup by deterministic block naming (DataFrame functions only).

Every normalised text is cut into blocks of `block_chars` code points. Equal blocks get one
integer name: the distinct blocks are sorted inside each hash range and numbered. Adjacent
names are then paired and named in the same way, level by level, until one name is left of a
document; documents have equal texts exactly when they end at the same level with the same
name. No name depends on a hash alone: where two different blocks share the 64-bit join key,
those keys are joined by their text.

Texts are read, normalised and cut once, into a table of blocks. Only one shuffle carries text (the
distinct blocks, combined before it); everything else moves a few integers a block. A block that very many documents share is combined before the shuffle,
and the join back to its occurrences is one that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other. Of rows with equal texts
    the one with the smallest id stays (null ids last); of repeated rows with that id, one. An
    empty table gives no rows. Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    parts = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    cells = base.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), parts.alias("parts"))
    cells = cells.select("doc_id", "sha", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "block")).withColumn("key", key(F.col("block")))
    cells = cut(cells)  # texts are normalised, hashed and cut into blocks once; what follows reads the columns that it needs
    names = cut(cells.select("key", "block").distinct().sortWithinPartitions("key", "block").select("key", F.monotonically_increasing_id().alias("name")))
    shared = cut(names.groupBy("key").count().where("count > 1").select("key"))
    at = cells.groupBy("doc_id", "sha", "n", "pos", "key").agg(F.count("*").alias("copies"))
    if shared.isEmpty():
        level = at.join(names.hint("merge"), "key").select("doc_id", "sha", "copies", "n", "pos", "name")
    else:  # different blocks with one key: those are told apart by their text
        odd = cells.join(shared, "key", "left_semi")
        odd_names = odd.select("key", "block").distinct().sortWithinPartitions("key", "block").select("key", "block", (-1 - F.monotonically_increasing_id()).alias("name"))
        odd_at = odd.groupBy("doc_id", "sha", "n", "pos", "key", "block").agg(F.count("*").alias("copies"))
        level = (
            at.join(shared, "key", "left_anti").join(names.hint("merge"), "key").select("doc_id", "sha", "copies", "n", "pos", "name")
            .unionByName(odd_at.join(odd_names, ["key", "block"]).select("doc_id", "sha", "copies", "n", "pos", "name"))
        )
    level = cut(level)
    ended, depth = [], 0
    while True:
        ended.append(level.where("n = 1").select("doc_id", "sha", "copies", F.lit(depth).alias("depth"), "name"))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("doc_id", "sha", "copies", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"), F.count("*").alias("sides")
        )
        pairs = pairs.withColumn("right", F.when(F.col("sides") == 2, F.col("right")).otherwise(F.lit(-(1 << 62)))).drop("sides")
        # written first: a join with an aggregate of the same stage can't be split where many copies share a pair
        named = cut(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()))
        level = cut(pairs.join(named.hint("merge"), ["left", "right"]).select("doc_id", "sha", "copies", F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name"))
        depth += 1
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    groups = cut(whole.groupBy("depth", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    rows = whole.join(groups.hint("merge"), ["depth", "name"])
    rows = rows.select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""
