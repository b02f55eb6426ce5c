"""Operator 9, mixing sources to target weights by Poisson replication (DataFrame functions only).

A source with n documents and target weight w gets the repetition rate w * total / n. Each
document's count inverts the Poisson distribution with that mean at a uniform number hashed
from the seed and the document's id, so it does not depend on partitioning or on other rows.
Documents are exploded by their counts and ordered by a second hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 17
#: A rate is split into equal parts of at most this mean, whose counts add up (exp(-rate) stays a normal number).
PART = 16.0
#: Largest count of one part. Beyond it lies less than 2**-53 of a Poisson distribution with mean PART.
TOP = 96


def uniform(*of) -> Column:
    """A number in [0, 1) from 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in of])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, *of) -> Column:
    """Counts with mean `rate` by inversion at hash-seeded uniform numbers."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")

    def one(k: Column) -> Column:
        mean, u = rate / parts, uniform(*of, k)
        walk = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(TOP), F.ceil(mean * 4 + 32).cast("int"))),
            F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("n")),
            lambda a, i: F.struct((a["p"] * mean / i).alias("p"), (a["below"] + a["p"] * mean / i).alias("below"), (a["n"] + F.when(u >= a["below"], 1).otherwise(0)).alias("n")),
        )
        return walk["n"]

    return F.when(rate.isNull() | (rate <= 0), F.lit(0)).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, b: a + b))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' columns (each row as often as its count says) plus copy_no (from 1) and mix_key, in order of mix_key.

    weights: target share of each source, null's under None; sources it doesn't name get none.
    Without weights every source gets the same share. total: rows wanted, by default as many as
    there are. A null source is a source of its own; a null id counts as one id; repeated rows
    with one id get equal counts. Empty tables give no rows. Columns of docs keep their names;
    those named copy_no or mix_key are replaced.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source_col).alias("_s")).agg(F.count("*").alias("_n"))
    if weights is None:
        sizes = cut(sizes)
        share = sizes.withColumn("_w", F.lit(1.0) / sizes.count() if sizes.count() else F.lit(0.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_g string, _w double")
        share = cut(sizes.join(given, F.col("_s").eqNullSafe(F.col("_g"))).select("_s", "_n", "_w"))
    all_rows = F.lit(float(total)) if total is not None else F.lit(float(share.agg(F.sum("_n")).first()[0] or 0))
    weight = float(share.agg(F.sum("_w")).first()[0] or 1.0)
    rates = share.select("_s", (F.col("_w") / weight * all_rows / F.col("_n")).alias("_rate"))
    # one row a source: broadcast only while that is a small table; else the join may split the hot source
    small = share.limit(100_001).count() <= 100_000
    keep = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    out = docs.select(*keep).join(F.broadcast(rates) if small else rates.hint("merge"), F.col(source_col).eqNullSafe(F.col("_s")))
    out = out.withColumn("_k", poisson(F.col("_rate"), F.lit(seed), F.col(id_col))).where("_k > 0")
    out = out.select(*keep, F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("copy_no"))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy_no").cast("string"))))
    # the key is uniform, so ranges of it need no sample of the rows (which would run all of the above twice)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("mix_key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = out.withColumn("_part", F.floor(place * parts).cast("int")).repartitionById(parts, F.col("_part"))
    return out.drop("_part").sortWithinPartitions("mix_key")


SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM s)) / (SELECT sum(w) FROM (SELECT 1.0::DOUBLE / (SELECT count(*) FROM s) AS w FROM s)) * (SELECT sum(n) FROM s)::DOUBLE / n AS rate FROM s),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS below FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM c WHERE k < {TOP}),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}|' || doc_id::VARCHAR || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u, text FROM documents),
k AS (SELECT u.doc_id, u.text, u.source, count(*) AS k FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND u.u >= c.below GROUP BY ALL)
SELECT doc_id, text, source, CAST(i AS INTEGER) AS copy_no, md5('order{SEED}|' || doc_id::VARCHAR || '|' || i::VARCHAR) AS mix_key FROM (SELECT doc_id, text, source, unnest(range(1, k + 1)) AS i FROM k)
"""
