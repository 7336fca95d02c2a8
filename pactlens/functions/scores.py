"""Column functions over labels and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import vocab


def _lookup(label: Column, position: int) -> Column:
    rows = [*vocab.LABELS, vocab.REJECTED]
    pairs = [part for row in rows for part in (F.lit(row[0]), F.lit(row[position]))]
    return F.try_element_at(F.create_map(*pairs), label.cast("int"))


def risk_type(label: Column) -> Column:
    return _lookup(label, 1)


def risk_level(label: Column) -> Column:
    return _lookup(label, 2)


def prompt(label: Column) -> Column:
    """The generation request of a label; another label fails the job."""
    pairs = [part for k, v in vocab.PROMPTS.items() for part in (F.lit(k), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), label.cast("int"))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no prompt for label "), F.coalesce(label.cast("string"), F.lit("NULL"))))).otherwise(found)


def argmax(values: Column) -> Column:
    """Position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(values: Column, label: Column) -> Column:
    return F.round(F.try_element_at(values, label + 1), 4)


def percent(prob: Column) -> Column:
    return F.when((prob > 0) & (prob <= 1), prob * 100).otherwise(prob)


def ranked_labels(values: Column, least: float = vocab.RANKED_PERCENT) -> Column:
    """``ARRAY<STRUCT<label, percent>>`` of the labels that reach ``least`` percent, the largest first, ties by label.

    Sorted inside the row: no shuffle.
    """
    entries = F.transform(values, lambda p, i: F.struct((-percent(p)).alias("minus"), i.alias("label")))
    kept = F.array_sort(F.filter(entries, lambda e: e["minus"] <= -least))
    return F.transform(kept, lambda e: F.struct(e["label"].alias("label"), (-e["minus"]).alias("percent")))


def log_softmax_at(logits: Column, target: Column) -> Column:
    """log p of the target class, shifted by the maximum so that exp cannot overflow."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.element_at(logits, target + 1) - top - F.log(total)


def focal_term(logits: Column, target: Column, alpha: Column, gamma: float = vocab.FOCAL_GAMMA) -> Column:
    log_p = log_softmax_at(logits, target)
    return alpha * F.pow(1 - F.exp(log_p), F.lit(float(gamma))) * -log_p
