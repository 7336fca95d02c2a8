"""Random forest over TF-IDF vectors: training, cross-validation, scoring, model store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import rules, scores
from pactlens.functions import text as text_functions
from pactlens.operators import metrics
from pactlens.operators.dataset import folds, with_balanced_weight
from pactlens.operators.documents import page_lines, split_sentences
from pactlens.operators.features import fit_vocabulary, fold_term_counts, fold_vocabulary, vectorizer, with_terms
from pactlens.operators.frames import spread, stored


def train(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    trees: int = vocab.FOREST_TREES,
    depth: int = vocab.FOREST_DEPTH,
    seed: int = vocab.SPLIT_SEED,
) -> PipelineModel:
    """Fits features and forest on labelled rows; classes are weighted against their frequency.

    The rows are stored once; the vocabulary, the weights and the forest each pass over them.
    """
    rows = stored(_training_rows(df, text, label), "training-rows")
    return _fit(rows, fit_vocabulary(rows), trees, depth, seed)


def _training_rows(df: DataFrame, text: str, label: str, *keys: str) -> DataFrame:
    """Terms and label, spread evenly: every tree level is another pass over these rows, so one shuffle pays off."""
    narrow = df.select(*keys, F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    return with_terms(spread(narrow)).drop("text")


def _fit(rows: DataFrame, vocabulary: DataFrame, trees: int, depth: int, seed: int) -> PipelineModel:
    """The vectors are stored: before the first tree level the forest passes over them three times (metadata, splits, bins)."""
    features = vectorizer(vocabulary)
    vectors = features.transform(with_balanced_weight(rows)).select("features", "label", "weight")
    weighted = stored(vectors, "training-vectors")
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        weightCol="weight",
        seed=seed,
        maxMemoryInMB=1024,
    ).fit(weighted)
    return PipelineModel(stages=[*features.stages, forest])


def predict(df: DataFrame, model: PipelineModel, text: str = "text", gate: Column | None = None) -> DataFrame:
    """Adds ``prediction INT`` and ``probability ARRAY<DOUBLE>``; rows outside the gate are not tokenized."""
    wanted = F.col(text) if gate is None else F.when(gate, F.col(text)).otherwise("")
    with_scored = with_terms(df.withColumn("_scored", wanted), "_scored")
    return _apply(with_scored, model).select(*df.columns, "prediction", "probability")


def _apply(terms: DataFrame, model: PipelineModel) -> DataFrame:
    scored = model.transform(terms).withColumn("probability", vector_to_array("probability"))
    return scored.withColumn("prediction", scores.argmax(F.col("probability")))


def score_clauses(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """The result record per clause; a text that is no contract clause is rejected with a message.

    Accepted and rejected rows share one narrow projection.
    """
    gate = rules.is_contract_clause(F.col(text))
    flagged = df.withColumn("rejected", ~F.coalesce(gate, F.lit(False)))
    predicted = predict(flagged, model, text, gate=~F.col("rejected"))
    rejected = F.col("rejected")
    label = F.when(rejected, F.lit(vocab.REJECTED[0])).otherwise(F.col("prediction"))
    return prediction_record(predicted.withColumn("risk_label_id", label), [c for c in df.columns if c != text], text)


def prediction_record(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Record columns from ``risk_label_id``, ``probability`` and ``rejected``."""
    label, rejected = F.col("risk_label_id"), F.col("rejected")
    return df.select(
        *keys,
        F.col(text).alias("text"),
        scores.risk_type(label).alias("risk_type"),
        "risk_label_id",
        F.when(rejected, 0.0).otherwise(scores.confidence(F.col("probability"), label)).alias("confidence"),
        scores.risk_level(label).alias("risk_level"),
        F.when(rejected, F.array().cast("array<double>")).otherwise(F.col("probability")).alias("confidence_array"),
        "rejected",
        F.when(rejected, vocab.REJECT_MESSAGE).alias("message"),
    )


def response(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The six fields a caller sees; an empty text gives an error row instead."""
    trimmed = text_functions.strip(F.coalesce(F.col(text), F.lit("")))
    empty = trimmed == ""

    def unless_empty(name: str) -> Column:
        return F.when(~empty, F.col(name)).alias(name)

    return df.select(
        *keys,
        F.when(~empty, trimmed).alias("text"),
        *[unless_empty(c) for c in ("risk_type", "risk_label_id", "risk_level", "confidence", "confidence_array")],
        F.when(empty, "文本为空").alias("error"),
    )


def score_files(pages: DataFrame, model: PipelineModel) -> DataFrame:
    """Pages to scored clauses ``file, pos, piece, …``."""
    return score_lines(page_lines(pages), model)


def score_lines(lines: DataFrame, model: PipelineModel) -> DataFrame:
    """Cleaned lines ``file, pos, line`` of files of any format to scored clauses ``file, pos, piece, …``.

    Contract only in the reference: clean, split into sentences, score each.  A newline ends a sentence, so lines are
    split one by one and no file is put together.
    """
    sentences = split_sentences(lines.select("file", "pos", "line"), "line")
    return score_clauses(sentences, model, "clause").withColumnRenamed("text", "clause")


def cross_validate(
    df: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    k: int = 5,
    trees: int = vocab.FOREST_TREES,
    depth: int = vocab.FOREST_DEPTH,
) -> DataFrame:
    """``fold, macro_f1`` for k stratified folds.

    Features are fitted again per fold, so no test row leaks into them; the terms of all folds are counted in one pass, and a
    fold's vocabulary is what is left without its own counts.
    """
    numbered = folds(df.select(key, text, label), k, label, [key])
    rows = stored(_training_rows(numbered, text, label, "fold"), "training-rows")
    counts = stored(fold_term_counts(rows, k), "fold-terms")
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    results = []
    for fold in range(k):
        vocabulary = fold_vocabulary(counts, sizes, fold)
        model = _fit(rows.filter(F.col("fold") != fold), vocabulary, trees, depth, vocab.SPLIT_SEED)
        tested = _apply(rows.filter(F.col("fold") == fold), model)
        pairs = tested.select(F.col("label").cast("int").alias("y"), F.col("prediction").alias("p"))
        results.append((fold, metrics.overall(pairs).first()["f1"]))
    return df.sparkSession.createDataFrame(results, "fold INT, macro_f1 DOUBLE")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
