"""Weak labels: texts labelled by the tiered rules and routed by confidence to their sinks, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pactlens.functions import rules
from pactlens.operators.frames import once

SOURCE = "weak"
ROUTES = ("accept", "review", "drop")


def weak_labels(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``label, confidence, matched_rules, route, source``.

    Contract only in the reference.  A null text has no hit and is dropped like any other text without one.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    labelled = once(texts, {"_tier": rules.tier_label(value)})
    return labelled.select(*texts.columns, "_tier.label", "_tier.confidence", "_tier.matched_rules").withColumns(
        {"route": rules.route(F.col("confidence")), "source": F.lit(SOURCE)}
    )


def write_weak_labels(labelled: DataFrame, path: str) -> dict[str, int]:
    """One folder of JSON lines per route, ``route=accept`` and so on; returns how many rows went to each.

    The counts are observed while the rows are written: nothing is read or labelled twice.
    """
    seen = Observation("routes")
    counted = labelled.observe(seen, *(F.count_if(F.col("route") == r).alias(r) for r in ROUTES))
    counted.write.mode("overwrite").partitionBy("route").option("ignoreNullFields", "false").json(path)
    return {r: seen.get[r] for r in ROUTES}


def read_weak_labels(labelled_like: DataFrame, path: str) -> DataFrame:
    """What ``write_weak_labels`` wrote, all routes; ``labelled_like`` gives the schema."""
    return labelled_like.sparkSession.read.schema(labelled_like.schema).json(path).select(*labelled_like.columns)
