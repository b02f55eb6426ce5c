"""The shared folder, and tables in it that cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written table that one task reads at most, beyond one task a core.
TASK_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def path_in(spark: SparkSession, path: str):
    """A path and the store that holds it, of any kind that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver's JVM ends, or by drop_tables()."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    place, store = path_in(spark, folder)
    store.mkdirs(place)
    store.deleteOnExit(place)  # takes folders that exist only
    _written.append(folder)
    return f"{folder}/data"


#: Spark then drops an execution's shuffle files when it ends, and not only when the driver's JVM comes to collect garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freed(spark: SparkSession):
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


#: For columns of hashes, which neither a dictionary nor compression makes smaller.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame, free: bool = False, plain: bool = False) -> DataFrame:
    """Write df to a table in the shared folder and read it again, which cuts its lineage.

    Unlike checkpoint(), that runs the plan once rather than twice, and later reads take the
    columns they need only. The table survives lost executors, so with free, for steps that shuffle
    much, the plan's shuffle files are dropped as soon as it is written. That costs a message to
    every executor for each shuffle, so steps that shuffle little leave theirs to Spark's cleaner.
    plain: for tables of hashes, written as they are.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    with _freed(spark) if free else contextlib.nullcontext():
        df.write.options(**(_PLAIN if plain else {})).parquet(path)
    place, store = path_in(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    # many small files would make many tasks, each with a file a shuffle partition: one task a core, or a TASK_BYTES
    return out.coalesce(max(spark.sparkContext.defaultParallelism, -(-store.getContentSummary(place).getLength() // TASK_BYTES)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(), and the rows that were written, which are counted on their way."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get.get("rows")
    return out, out.count() if rows is None else rows


@contextlib.contextmanager
def dealt(spark: SparkSession):
    """Gives put(df, column): df as a table in the shared folder, in as many buckets by that column as shuffles have partitions.

    Joins by such columns read the buckets as they are, without an exchange. The tables' names, not their
    files, go at the end: what is still wanted then must have been written elsewhere.
    """
    names: list[str] = []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(df: DataFrame, column: str) -> DataFrame:
        names.append(f"tessera_{uuid.uuid4().hex}")
        df.write.bucketBy(parts, column).option("path", scratch(spark, "dealt")).saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield put
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_tables(spark: SparkSession) -> int:
    """Delete all that scratch() and cut() have made so far in this driver; DataFrames that read it end. For drivers that live long, between queries."""
    n = len(_written)
    while _written:
        place, store = path_in(spark, _written.pop())
        store.delete(place, True)
        store.cancelDeleteOnExit(place)
    return n


def put_files(spark: SparkSession, folder: str, texts: dict[str, str]) -> str:
    """Write a few small named files below a folder of any store that Spark reaches."""
    for name, text in texts.items():
        place, store = path_in(spark, f"{folder}/{name}")
        out = store.create(place, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
    return folder


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    place, store = path_in(spark, path)
    source = store.open(place)
    try:
        return bytes(source.readAllBytes()).decode("utf-8")
    finally:
        source.close()
