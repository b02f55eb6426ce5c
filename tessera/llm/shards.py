"""Operator 7, sharding by proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked; rank / size of the source is
their place in the whole, so any run of places holds every source in proportion. Shards are
equal runs: counts differ by one at most (law `rows`).

Ranks are taken without putting a source, or all rows, into one task: rows fall into cells by
their hash, cells are counted and summed up, and only rows of one cell are sorted together.
Cells are made to hold CELL rows on average, so their number grows with the input. Rows carry
sizes and checksums here, never their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEED = 29
CELL = 2048


def _offsets(cells: DataFrame, within: list[str]) -> DataFrame:
    """Adds before: rows in smaller cells. Two levels, so that no task sums up more than the square root of the cells."""
    up = Window.partitionBy(*within, "_top").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = cells.groupBy(*within, "_top").agg(F.sum("_n").alias("_n"))
    before = tops.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    named = cells.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    for i, c in enumerate(within):
        before = before.withColumnRenamed(c, f"_w{i}")
    same = F.lit(True)
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    out = named.join(before.withColumnRenamed("_top", "_t"), same & (F.col("_top") == F.col("_t")))
    return out.select(*within, "_cell", (F.col("_before") + F.col("_base")).alias("_before"))


def stratified_shards(rows: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", tie: Column | None = None) -> DataFrame:
    """rows plus shard (0 to shards - 1) and slot (from 0, without gaps, in every shard).

    A null source is a source of its own. Rows with one id are ordered by `tie` and else by all
    they hold, so equal rows are exchangeable. Fewer rows than shards leave some shards empty
    and give the others one row each; an empty table gives no rows.
    """
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    base = cut(rows.withColumn("_h", h).withColumn("_tie", tie if tie is not None else F.xxhash64(*rows.columns)))
    n = base.count()
    cells = max(1, -(-n // CELL))
    roots = max(1, int(cells**0.5))
    place = F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    base = base.withColumn("_cell", F.floor(place * cells).cast("long"))
    counts = base.groupBy(source_col, "_cell").agg(F.count("*").alias("_n")).withColumn("_top", F.floor(F.col("_cell") / roots))
    sizes = base.groupBy(source_col).agg(F.count("*").alias("_size"))
    offsets = _offsets(counts, [source_col]).withColumnsRenamed({source_col: "_s", "_cell": "_c"})
    # a source and a cell hold few rows: the hot source is spread over all cells
    ranked = base.withColumn("_in", F.row_number().over(Window.partitionBy(source_col, "_cell").orderBy("_h", F.col(id_col).asc_nulls_last(), "_tie")))
    ranked = ranked.join(offsets, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))).drop("_s", "_c")
    ranked = ranked.join(sizes.withColumnRenamed(source_col, "_s"), F.col(source_col).eqNullSafe(F.col("_s"))).drop("_s")
    ranked = ranked.withColumn("_f", (F.col("_before") + F.col("_in") - 0.5) / F.col("_size"))
    ranked = cut(ranked.drop("_in", "_before", "_cell").withColumn("_cell", F.least(F.floor(F.col("_f") * cells), F.lit(cells - 1)).cast("long")))
    counts = ranked.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_top", F.floor(F.col("_cell") / roots))
    offsets = _offsets(counts.withColumn("_all", F.lit(0)), ["_all"]).select(F.col("_cell").alias("_c"), "_before")
    ranked = ranked.withColumn("_in", F.row_number().over(Window.partitionBy("_cell").orderBy("_f", F.col(source_col).asc_nulls_first(), "_h", F.col(id_col).asc_nulls_last(), "_tie")))
    ranked = ranked.join(offsets, F.col("_cell") == F.col("_c")).withColumn("_g", F.col("_before") + F.col("_in") - 1)
    # shard s takes the places from ceil(s * n / shards) on
    ranked = ranked.withColumn("shard", F.floor(F.col("_g") * shards / F.lit(max(n, 1))).cast("int"))
    return ranked.withColumn("slot", (F.col("_g") - F.ceil(F.col("shard") * F.lit(n) / F.lit(shards))).cast("long")).select(*rows.columns, "shard", "slot")


def shard_table(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes plus 1; null texts have none), text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = stratified_shards(rows, shards, seed, tie=F.col("text_crc32"))
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' columns, shard and slot, text included; columns of docs with those two names are replaced.

    Places are found for ids, sources and hashes of the rows; the rows themselves are shuffled
    once, to meet their place. Equal rows are numbered, so that each takes one.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    keyed = docs.withColumn("_row", F.xxhash64(*docs.columns))
    w = Window.partitionBy("_row").orderBy("_row")
    places = stratified_shards(keyed.select(id_col, source_col, "_row"), shards, seed, id_col, source_col, tie=F.col("_row"))
    places = places.select("_row", "shard", "slot", F.row_number().over(Window.partitionBy("_row").orderBy("shard", "slot")).alias("_i"))
    return keyed.withColumn("_i", F.row_number().over(w)).join(places.hint("merge"), ["_row", "_i"]).select(*docs.columns, "shard", "slot")


#: The query over shard_table(), with CRC-32 by its table, which is made from the polynomial.
SQL = f"""
WITH RECURSIVE bits AS (SELECT i::UBIGINT AS b, i::UBIGINT AS v, 0 AS n FROM range(256) t(i)
UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
tab AS (SELECT list(v ORDER BY b) AS c FROM bits WHERE n = 8),
d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, source, octet_length(encode(t)) + 1 AS size, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::UBIGINT)),
  lambda a, h: xor(a >> 8, c[((xor(a, h) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) END::BIGINT AS crc, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM d, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS LAST, crc) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f, count(*) OVER () AS n FROM x),
g AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS LAST, crc) - 1 AS g FROM f)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (g * 8 // n)::INTEGER AS shard, (g - ((g * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g
"""
