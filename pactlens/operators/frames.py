"""General steps over tables: a stored intermediate, and columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and what reads it twice computes it once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` dealt evenly to as many tasks as run at once or as shuffles have, or to ``tasks``.

    A table whose files hold few row groups is read by as few tasks, whatever the number of cores; where rows are costly
    (rules, features, scores) one shuffle of the columns that are read pays off.
    """
    spark = df.sparkSession
    parts = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that a later filter reads instead of repeating their expressions.

    A filter over a projection is moved below it with the expressions copied in, so costly ones would run twice; it is not
    moved below a generator of one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
