"""Running values over ordered rows of groups of any size: a segmented scan.

Rows are sorted by ranges, numbered, and cut into segments of so many consecutive rows, whatever groups they belong to.
Windows run inside a segment only.  One row per segment and group sums the segment up; those rows are scanned in turn, and
what they carry is joined back.  So neither a group nor a key of it is ever one task, and a group costs one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SEGMENT_BITS = 16  # a segment has 65,536 rows at most


def in_segments(rows: DataFrame, *order: str, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Adds ``row``, which rises with ``order``, and ``segment``; ``order`` starts with the group.

    ``order`` must be unique, or what hangs on the order of equal rows is open.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("row", segment_bits))


def upto(group: str, last: int) -> WindowSpec:
    """The rows of a group inside a segment up to ``last`` rows behind the current one."""
    return Window.partitionBy(group, "segment").orderBy("row").rowsBetween(Window.unboundedPreceding, last)


def last_event(event: str) -> Column:
    """Aggregate: the last value of ``event`` that is not null."""
    return F.max_by(event, F.when(F.col(event).isNotNull(), F.col("row")))


def carried(summary: DataFrame, group: str, *steps: dict[str, Column]) -> DataFrame:
    """``group, segment`` and what each segment inherits from the group's earlier ones.

    ``steps`` name aggregates over the rows of earlier segments; a later step may use an earlier one's results.  Only
    segments that do not open their group come back: a segment border cuts one group, so these are fewer than segments,
    however many groups there are.
    """
    earlier = Window.partitionBy(group).orderBy("segment")
    out = summary.withColumn("_nth", F.row_number().over(earlier))
    for step in steps:
        out = out.withColumns({n: c.over(earlier.rowsBetween(Window.unboundedPreceding, -1)) for n, c in step.items()})
    return out.filter("_nth > 1").select(group, "segment", *(n for step in steps for n in step))
