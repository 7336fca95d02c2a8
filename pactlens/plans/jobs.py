"""Whole jobs, from files to files: what a batch user starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import text
from pactlens.operators import dataset, documents, forest, metrics, report
from pactlens.sources import files, samples


def parse_pages(pages: DataFrame, output: str) -> None:
    """Pages of contract files to labelled samples, written as JSON lines."""
    samples.write_samples(documents.contract_samples(documents.marked_page_lines(pages)).drop("file", "clause_no"), output)


def parse_folder(spark: SparkSession, folder: str, output: str) -> None:
    """The DOCX contracts of a folder to labelled samples; damaged files give no samples.

    PDF contents come in as a pages table (``parse_pages``).
    """
    found = files.list_contracts(spark, folder)
    docx = found.filter(F.lower(text.base_name(F.col("file"))).endswith(".docx"))
    lines = files.docx_lines(files.docx_parts(docx))
    samples.write_samples(documents.contract_samples(lines).drop("file", "clause_no"), output)


def merge_sources(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """The sample files of a folder, interleaved and numbered, written as the dataset CSV; returns the statistics."""
    samples.write_dataset(dataset.interleave_copies(samples.read_sources(spark, folder)), output)
    return dataset.merge_statistics(samples.read_dataset(spark, output))


def train_baseline(
    spark: SparkSession,
    dataset_path: str,
    model_path: str,
    metrics_path: str,
    trees: int = vocab.FOREST_TREES,
    depth: int = vocab.FOREST_DEPTH,
) -> None:
    """Trains on 80 % of the valid rows of a dataset, writes the model and the metrics of the other 20 %."""
    rows = samples.read_dataset(spark, dataset_path)
    dataset.check_columns(rows)
    parts = dataset.split(dataset.valid_rows(rows), {"train": 0.8, "test": 0.2})
    model = forest.train(parts.filter(F.col("split") == "train"), trees=trees, depth=depth)
    forest.save_model(model, model_path)
    tested = forest.predict(parts.filter(F.col("split") == "test"), model)
    pairs = tested.select(F.col("label").alias("y"), F.col("prediction").alias("p"))
    samples.write_metrics(metrics.metrics_document(pairs), metrics_path)


def report_files(pages: DataFrame, model_path: str, output: str) -> None:
    """Pages to scored clauses to report texts, and one summary row per contract as JSON.

    The scored clauses are stored once and read by both, so the model runs a single time.
    """
    scored_path = f"{output}/clauses"
    forest.score_files(pages, forest.load_model(model_path)).write.mode("overwrite").parquet(scored_path)
    scored = pages.sparkSession.read.parquet(scored_path).withColumnRenamed("clause", "text")
    report.write_report(report.report_lines(scored, "file", "pos"), f"{output}/text")
    report.summarize_risks(scored).write.mode("overwrite").json(f"{output}/summary")
