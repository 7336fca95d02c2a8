"""What several operators share: intermediate tables in the shared folder, graph components, small text helpers."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.session import scratch_path

# The white space that separates words in every contract: space and \t \n \x0b \f \r.
WORD_BREAKS = "\x20\x09-\x0d"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost executor costs nothing before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stored`, of no others, once no later step reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's context cleaner delete the shuffle files of finished steps now instead of at some later collection."""
    for _ in range(2):  # the driver's Python lets go first, then its JVM, then the cleaner works beside us
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that any further columns of a table cannot clash with the operators' own."""
    return df.select(*(df[n] for n in names))


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps: ``(node, root)``, root = smallest node.

    ``edges`` holds two bigint columns in any direction; loops, repeated and null edges are allowed and mean nothing.
    Only nodes that are not their own root come back.  Each round is a group and a join on nodes (a star of any size
    combines in the group, its join is left to the skew handling of adaptive execution) and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.  Nothing is collected but a checksum.
    """
    a, b = F.col(left), F.col(right)
    now = stored(edges.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).where("v > x AND m < v").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m"))
        small = large.join(low, F.col("v") == F.col("x")).where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        now = stored(small.unionByName(low.select(F.col("m").alias("u"), F.col("x").alias("v"))).distinct(), "edges")
