"""Classification metrics, all of them from the confusion counts: one pass over the rows, then K x K numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlens import vocab
from pactlens.functions import scores


def _counted(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The only pass over the rows: at most K x K counts."""
    return df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """``y, p, n`` over every pair of the labels that occur on either side.

    The few counts become one map, and the grid is opened from the label array next to it, so nothing is read twice.
    """
    pair = F.struct(F.col("y"), F.col("p"))
    packed = _counted(df, truth, predicted).agg(
        F.map_from_entries(F.collect_list(F.struct(pair.alias("k"), "n"))).alias("counts"),
        F.array_union(F.collect_set("y"), F.collect_set("p")).alias("labels"),
    )
    grid = packed.select("counts", "labels", F.explode("labels").alias("y")).select(
        "counts", "y", F.explode("labels").alias("p")
    )
    return grid.select("y", "p", F.coalesce(F.try_element_at("counts", pair), F.lit(0)).alias("n"))


def normalized_confusion(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """``y, p, share`` of the true row; null where a label never is the truth."""
    row = F.sum("n").over(Window.partitionBy("y"))
    return confusion(df, truth, predicted).select("y", "p", F.try_divide("n", row).alias("share"))


def per_class(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """``label, precision, recall, f1, support``; an undefined value is 0."""
    both = F.array(
        F.struct(F.col("y").alias("label"), F.lit(True).alias("is_truth")),
        F.struct(F.col("p").alias("label"), F.lit(False).alias("is_truth")),
    )
    sides = _counted(df, truth, predicted).select(
        "n", (F.col("y") == F.col("p")).alias("hit"), F.explode(both).alias("side")
    )
    n = F.col("n")
    counts = sides.groupBy(F.col("side.label").alias("label")).agg(
        F.sum(F.when(F.col("side.is_truth") & F.col("hit"), n).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side.is_truth"), n).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("side.is_truth"), n).otherwise(0)).alias("predicted"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        "label",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )


def overall(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One row: accuracy and the macro averages over the union of labels."""
    return per_class(df, truth, predicted).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.avg("precision").alias("precision"),
    )


def report(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """Report rows ``name, precision, recall, f1, support``: one per label, then macro avg, weighted avg, accuracy."""
    classes = per_class(df, truth, predicted)
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")]
    one_row = classes.agg(
        F.collect_list(
            F.struct(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
        ).alias("named"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *weighted,
        (F.sum("tp") / F.sum("support")).alias("acc"),
        F.sum("support").alias("support"),
    )
    averages = F.array(
        _row("macro avg", "m_precision", "m_recall", "m_f1"),
        _row("weighted avg", "w_precision", "w_recall", "w_f1"),
        _row("accuracy", "acc", "acc", "acc"),
    )
    return one_row.select(F.inline(F.concat("named", averages)))


def _row(name: str, precision: str, recall: str, f1: str):
    return F.struct(
        F.lit(name).alias("name"),
        F.col(precision).alias("precision"),
        F.col(recall).alias("recall"),
        F.col(f1).alias("f1"),
        F.col("support").alias("support"),
    )


def recall_gate(
    df: DataFrame, labels: tuple[int, ...] = vocab.HIGH_RISK_LABELS, least: float = vocab.HIGH_RISK_RECALL
) -> DataFrame:
    """Recall of the high-risk labels, whether each reaches the bound, and whether all do."""
    rows = per_class(df).filter(F.col("label").isin(*labels))
    passed = F.col("recall") >= least
    both = Window.partitionBy(F.lit(1))  # a row per high-risk label
    return rows.select("label", "recall", passed.alias("passed"), F.every(passed).over(both).alias("all_passed"))


def metrics_document(df: DataFrame, truth: str = "y", predicted: str = "p") -> DataFrame:
    """One nested row for the JSON sink: macro_f1, accuracy, macro_avg, per_class (digit labels only)."""
    rows = report(df, truth, predicted)
    values = F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    return rows.agg(
        F.max(F.when(F.col("name") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("name") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max_by(values, F.when(F.col("name") == "macro avg", 1)).alias("macro_avg"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(F.col("name").rlike(r"\A\p{Nd}+\z"), F.struct("name", values.alias("v")))))
        ).alias("per_class"),
    )


def focal_loss(df: DataFrame, weights: DataFrame, gamma: float = vocab.FOCAL_GAMMA) -> DataFrame:
    """Mean focal loss over rows ``y, logits``; ``weights`` is ``label, alpha`` with one row per class."""
    alpha = weights.select(F.col("label").alias("_label"), "alpha")
    term = scores.focal_term(F.col("logits"), F.col("y"), F.col("alpha"), gamma)
    return df.join(F.broadcast(alpha), F.col("y") == F.col("_label")).agg(F.avg(term).alias("loss"))
