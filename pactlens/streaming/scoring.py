"""Scoring as a stream, by rules or by a stored model: new clause files in, results out.  Stateless, so no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pactlens.operators import forest
from pactlens.operators.frames import spread


def clause_stream(spark: SparkSession, folder: str, schema: str | StructType, fmt: str = "json") -> DataFrame:
    """The files that arrive in a folder."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def start_scoring(
    clauses: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Applies the batch scoring function to the stream and writes each result once; stops when the folder is read."""
    return (
        score(clauses)
        .writeStream.format(fmt)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batch(scored: DataFrame, output: str, batch_id: int) -> None:
    """The results of one batch in a folder of its own: a batch that is replayed replaces what it wrote before."""
    scored.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")


def start_model_scoring(clauses: DataFrame, model_path: str, output: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Scores the stream with a stored model, batch by batch, and stops when the folder is read.

    The model is loaded once per query; a batch number decides where results go, so no replay writes anything twice.  A
    batch of few files or row groups is dealt to all cores.
    """
    tasks = clauses.sparkSession.sparkContext.defaultParallelism
    model = forest.load_model(model_path)

    def score(batch: DataFrame, batch_id: int) -> None:
        write_batch(forest.score_clauses(spread(batch, tasks), model, text), output, batch_id)

    writer = clauses.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
