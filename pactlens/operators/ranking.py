"""Exact ranks inside groups that may be few and huge (three sources, six labels).

A plain window would put a whole group into one task.  Here a group is cut into buckets by the leading hex digits of a
seeded md5; buckets are ordered like the md5 itself, so rank = rows in earlier buckets + rank inside the bucket.  The
bucket counts form a small table (groups x 16**digits rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def bucket_digits(spark: SparkSession) -> int:
    """Hex digits that give at least four buckets per shuffle partition, and 4,096 at the least."""
    wanted, digits = 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 3
    while 16**digits < wanted:
        digits += 1
    return digits


def seeded_hash(seed: int, *keys: Column) -> Column:
    """md5 over the seed and the key columns: an order that looks random, is fixed by the seed and survives retries."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def seeded_rank(
    df: DataFrame,
    group: str,
    keys: list[str],
    seed: int,
    rank: str = "rn",
    total: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Adds the 1-based rank of each row in its group under the seeded order, and the group size if ``total`` is named.

    ``keys`` must be unique inside a group: then the hash spreads the group evenly over the buckets.  A null group fails
    the job: the join below would drop its rows in silence.
    """
    missing = F.raise_error(F.lit(f"{group} must not be null")).cast(df.schema[group].dataType)
    given = df.withColumn(group, F.coalesce(F.col(group), missing))
    hashed = given.withColumn("_h", seeded_hash(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, digits or bucket_digits(df.sparkSession)))
    counts = hashed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(group)))
    inside = Window.partitionBy(group, "_b").orderBy("_h", *keys)
    local = hashed.withColumn("_local", F.row_number().over(inside))
    # The window already put the rows where this join wants them: only the bucket counts move.
    joined = local.join(offsets.drop("_n"), [group, "_b"])
    return joined.withColumn(rank, (F.col("_before") + F.col("_local")).cast("bigint")).drop(
        "_h", "_b", "_before", "_local"
    )
