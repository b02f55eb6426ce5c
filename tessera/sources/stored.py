"""Tables that are kept between runs: versions that are committed as a whole, and stores that changes are merged into by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import cut, path_in, put_files, read_text

#: Parts of a store that is made anew: an upsert rewrites those that it touches.
PARTS = 64
_COMMITS = "_commits"


# ---- versions


def _committed(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Numbers and folders of the committed versions, in order. A pointer that isn't whole is none."""
    place, store = path_in(spark, f"{folder}/{_COMMITS}")
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place)]
    found = [(int(n), read_text(spark, f"{folder}/{_COMMITS}/{n}")) for n in names if n.isdigit()]
    return sorted((n, text.strip()) for n, text in found if text.endswith("\n"))


def write_version(df: DataFrame, folder: str) -> str:
    """Write df beside the versions of a folder, without committing it."""
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return name


def commit(spark: SparkSession, folder: str, name: str, keep: int = 2) -> int:
    """Make what write_version() wrote the current version, by the rename of one small file. All but the last `keep` versions go."""
    mark = f"_next-{uuid.uuid4().hex}"
    put_files(spark, f"{folder}/{_COMMITS}", {mark: f"{name}\n"})
    before = _committed(spark, folder)
    n = before[-1][0] + 1 if before else 1
    here, store = path_in(spark, f"{folder}/{_COMMITS}/{mark}")
    while True:
        there, _ = path_in(spark, f"{folder}/{_COMMITS}/{n:012d}")
        if not store.exists(there) and store.rename(here, there):
            break
        n += 1  # another writer was first: this version comes after it
    for old, gone in [*before, (n, name)][:-keep]:
        for path in (f"{folder}/{_COMMITS}/{old:012d}", f"{folder}/{gone}"):  # the pointer first, so that no reader is led to what is gone
            store.delete(path_in(spark, path)[0], True)
    return n


def save_version(df: DataFrame, folder: str, keep: int = 2) -> int:
    """The number of the new version. Until it is committed, and if that never happens, readers see the one before."""
    return commit(df.sparkSession, folder, write_version(df, folder), keep)


def load_version(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The last committed version; an empty table if there is none. Other failures are raised."""
    known = _committed(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/{known[-1][1]}") if known else spark.createDataFrame([], schema)


# ---- stores


def _part(columns: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def _with_part(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_part", IntegerType())])


def _parts(spark: SparkSession, path: str) -> int | None:
    place, store = path_in(spark, f"{path}/_parts")
    return int(read_text(spark, f"{path}/_parts")) if store.exists(place) else None


def merge_into(changes: DataFrame, path: str, keys: list[str], order: str, parts: int = PARTS, within: list[str] | None = None, keep_old: bool = False, ties: tuple[str, ...] = ()) -> int:
    """Upsert changes into a store: one row a key, the last by order (in ties the later change; with keep_old the row that is there stays). Returns the parts that were rewritten.

    The store lies in parts by a hash of `within` (of the keys by default; some of them), and only
    parts that changes fall into are read and overwritten. Null keys are keys. One writer at a
    time; a part is overwritten as a whole. Rows that are equal in key and order count once: the one with the largest ties, if named.
    Rows move once: they are dealt by part, which also brings rows of one key together.
    """
    spark, within = changes.sparkSession, within or keys
    known = _parts(spark, path)
    if known is None:
        put_files(spark, path, {"_parts": f"{parts}"})
    parts = known or parts
    new = cut(changes.withColumns({"_part": _part(within, parts), "_new": F.lit(not keep_old)}))
    touched = [r[0] for r in new.select("_part").distinct().collect()]  # numbers below parts
    if not touched:
        return 0
    rows, kept = new, known is not None and stored_files(spark, path)
    if kept:
        old = spark.read.schema(_with_part(changes.schema)).parquet(path).where(F.col("_part").isin(touched))
        rows = new.unionByName(old.withColumn("_new", F.lit(keep_old)))
    rank = [F.col("_new").desc()] if keep_old else [F.col(order).desc_nulls_last(), F.col("_new").desc()]
    w = Window.partitionBy("_part", *keys).orderBy(*rank, F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties])
    merged = rows.repartition(len(touched), "_part").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")
    if kept:
        merged = cut(merged)  # the store can't be read while it is overwritten
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return len(touched)


def stored_files(spark: SparkSession, path: str) -> bool:
    place, store = path_in(spark, path)
    return store.exists(place) and any(s.isDirectory() and s.getPath().getName().startswith("_part=") for s in store.listStatus(place))


def read_store(spark: SparkSession, path: str, schema: str | StructType, **values) -> DataFrame:
    """A store's rows, an empty table if there is none. values of the columns that deal it into parts: only their part is read."""
    if not stored_files(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(_with_part(spark.createDataFrame([], schema).schema)).parquet(path)
    if values:
        spot = spark.range(1).select(_part([F.lit(v) for v in values.values()], _parts(spark, path))).first()[0]
        rows = rows.where(F.col("_part") == spot)
        for c, v in values.items():
            rows = rows.where(F.col(c) == v)
    return rows.drop("_part")
