"""Sample, dataset and metrics files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlens import schemas, vocab
from pactlens.operators.dataset import union_sources
from pactlens.operators.frames import stored
from pactlens.operators.scan import SEGMENT_BITS


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``text, label, confidence``; bad JSON or a missing text fails the job, a null label is allowed.

    A missing or null confidence becomes the default.  Blank lines give no row.
    """
    raw = spark.read.schema(schemas.SAMPLES).option("mode", "FAILFAST").json(path)
    text = F.when(F.col("text").isNull(), F.raise_error(F.lit("sample without text"))).otherwise(F.col("text"))
    confidence = F.coalesce("confidence", F.lit(vocab.DEFAULT_CONFIDENCE))
    return raw.select(text.alias("text"), "label", confidence.alias("confidence"))


def read_sources(spark: SparkSession, folder: str, files: list[tuple[str, str]] = vocab.SOURCES) -> DataFrame:
    """The sample files of a folder in one table, each stamped with its source; a missing file is left out."""
    tagged = {}
    for name, source in files:
        try:
            tagged[source] = read_samples(spark, f"{folder.rstrip('/')}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not tagged:
        return spark.createDataFrame([], schemas.SAMPLES)
    return union_sources(tagged)


def write_samples(samples: DataFrame, path: str) -> None:
    """One JSON object per line; null labels are written, not dropped."""
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_dataset(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The dataset CSV.  Texts may hold quotes and newlines; ``multi_line=False`` lets Spark split files
    without newlines in texts, ``read_large_dataset`` any."""
    reader = spark.read.schema(schemas.DATASET).option("header", True).option("escape", '"')
    return reader.option("multiLine", multi_line).csv(path)


def read_large_dataset(spark: SparkSession, path: str, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The dataset CSV with quotes and newlines in its texts, read in as many tasks as Spark cuts the files into.

    Physical lines are read at any split.  A line opens a record when the quotes before it in its file are even in number;
    the lines of a record are joined and parsed as one.  The first record of each file is its header.  One pass counts the
    quotes of each split, the next joins the records inside the splits, where they stand, 2 ** ``segment_bits`` lines
    at a time.  Only what a split has before its first record and its last record, which may go on, are sorted.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes.cast("bigint")).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.sum("quotes").over(earlier)).filter("before % 2 = 1")
    inside = stored(before.select("file", "block", F.lit(True).alias("inside")), "csv-splits")  # splits that begin in a record
    known = lines.join(F.broadcast(inside), ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))

    def pieces(edges: bool) -> DataFrame:
        return known.mapInArrow(partial(_records, lines_at_once=1 << segment_bits, edges=edges), schemas.CSV_EDGES if edges else schemas.CSV_RECORDS)

    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces(edges=True).withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "line"))), lambda p: p["line"])
    cut = placed.groupBy("file", "record").agg(F.array_join(parts, "\n").alias("line"), F.bool_or("header").alias("header"))
    whole = pieces(edges=False).unionByName(cut.select("line", "header"))
    data = whole.filter(~F.col("header") & (F.trim("line", F.lit("\r ")) != ""))
    parsed = F.from_csv(F.rtrim("line", F.lit("\r")), schemas.DATASET, {"escape": '"', "mode": "FAILFAST"})
    return data.select(parsed.alias("r")).select("r.*")


def _records(batches: Iterator[pa.RecordBatch], lines_at_once: int, edges: bool) -> Iterator[pa.RecordBatch]:
    """The records of ``value, file, block, inside``, lines in the order of their splits.

    With ``edges`` a split's lines before its first record and its last record, without them the records between.  A line
    in which a record ends opens the next one, so the state between batches is the open record and whether it is quoted.
    """
    at, odd, nth, opened, held = None, 0, 0, False, []

    def given(lines: pa.Array, first: int, opens: bool) -> pa.RecordBatch:
        numbers = np.arange(first, first + len(lines))
        found = {"line": lines.cast(pa.string()), "header": pa.array((numbers == 0) & (opens and at[1] == 0))}
        if edges:
            found |= {"file": pa.repeat(at[0], len(lines)), "block": pa.repeat(at[1], len(lines)), "nth": pa.array(numbers), "opens": pa.repeat(opens, len(lines))}
        return pa.RecordBatch.from_pydict(found)

    def last() -> Iterator[pa.RecordBatch]:
        if edges and held:
            yield given(_joined(pa.concat_arrays(held), [0]), nth, opened)

    for batch in batches:
        for begin in range(0, batch.num_rows, lines_at_once):
            part = batch.slice(begin, lines_at_once)
            changes = [pc.not_equal(part[c].slice(1), part[c].slice(0, part.num_rows - 1)) for c in ("file", "block")]
            bounds = np.flatnonzero(pc.or_(*changes).to_numpy(zero_copy_only=False)) + 1
            for low, high in zip([0, *bounds], [*bounds, part.num_rows]):
                rows = part.slice(low, high - low)
                split = (rows["file"][0].as_py(), rows["block"][0].as_py())
                if split != at:
                    yield from last()
                    at, odd, nth, opened, held = split, int(rows["inside"][0].as_py()), 0, False, []
                values = rows["value"]
                quotes = np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False), dtype=np.int64)
                odds = np.concatenate(([odd], (odd + quotes) % 2))
                openers, odd = np.flatnonzero(odds[:-1] == 0), int(odds[-1])
                if not len(openers):
                    held.append(values)
                    continue
                if openers[0]:
                    held.append(values.slice(0, int(openers[0])))
                if held:
                    if edges != opened:
                        yield given(_joined(pa.concat_arrays(held), [0]), nth, opened)
                    nth += 1
                if not edges and len(openers) > 1:
                    yield given(_joined(values.slice(0, int(openers[-1])), openers[:-1]), nth, True)
                nth += len(openers) - 1
                opened, held = True, [values.slice(int(openers[-1]))]
    yield from last()


def _joined(lines: pa.Array, starts: Sequence[int]) -> pa.Array:
    """The lines from each of ``starts`` to the next one, joined by newlines."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(lines)], pa.int32()), lines), "\n")


def training_rows(dataset: DataFrame) -> DataFrame:
    """The two columns training needs."""
    return dataset.select("text", "label")


def write_dataset(dataset: DataFrame, path: str) -> None:
    """Dataset CSV with header and quoted fields (UTF-8 without byte-order mark).

    CSV has no null of its own: an empty text reads back as null, as it does in any reader of the format.
    """
    writer = dataset.select(*vocab.DATASET_COLUMNS).write.mode("overwrite").option("header", True)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)  # texts stay whole
    writer.option("quoteAll", True).option("escape", '"').csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per value of ``split``."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_metrics(document: DataFrame, path: str) -> None:
    """The one-row metrics document as JSON."""
    document.coalesce(1).write.mode("overwrite").json(path)
