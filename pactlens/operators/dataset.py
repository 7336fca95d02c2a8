"""The labelled dataset: interleaving, splits, checks, statistics, class weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlens import vocab
from pactlens.functions import rules, scores, text
from pactlens.operators.ranking import seeded_rank

SOURCE_ORDER = [name for _, name in vocab.SOURCES]


def label_table(spark: SparkSession) -> DataFrame:
    """The six labels and the rejection row; a local relation of seven rows."""
    return spark.createDataFrame([*vocab.LABELS, vocab.REJECTED], "label_id INT, risk_type STRING, risk_level STRING")


def with_label_names(df: DataFrame, label: str) -> DataFrame:
    """Label name and level for every row; the seven-row dictionary is broadcast."""
    names = label_table(df.sparkSession)
    return df.join(F.broadcast(names), F.col(label) == F.col("label_id"), "left").drop("label_id")


def union_sources(tagged: dict[str, DataFrame]) -> DataFrame:
    """One table from several sample tables, each stamped with its source name."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in tagged.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def interleave(
    samples: DataFrame, keys: list[str], order: list[str] = SOURCE_ORDER, seed: int = vocab.SPLIT_SEED
) -> DataFrame:
    """Shuffled inside each source, then one row per source in turn; adds ``id`` from 1.

    The id needs no global sort: a row of rank r in its source comes after every source's first r-1 rows and after the
    r-th rows of the sources ranked before or equal to its own.  ``keys`` must be unique inside a source.  A source that
    ``order`` does not name, or none, fails the job: a row is never dropped in silence.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown source "), F.coalesce("source", F.lit("null"))))
    known = samples.withColumn("source", F.when(F.col("source").isin(order), F.col("source")).otherwise(unknown.cast("string")))
    ranked = seeded_rank(known, "source", keys, seed)
    # The source sizes: one row, read as a scalar subquery.
    sizes = known.agg(F.array(*[F.count_if(F.col("source") == s) for s in order]).alias("sizes")).scalar()
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))

    def taken(i: int) -> Column:
        n = F.element_at(sizes, F.lit(i))
        return F.least(n, F.col("rn") - 1) + ((F.lit(i) <= place) & (n >= F.col("rn"))).cast("bigint")

    before = reduce(lambda a, b: a + b, [taken(i) for i in range(1, len(order) + 1)])
    return ranked.withColumn("id", before).drop("rn")


def interleave_copies(
    samples: DataFrame, order: list[str] = SOURCE_ORDER, seed: int = vocab.SPLIT_SEED, step: int = 100_000
) -> DataFrame:
    """``interleave`` for tables without a unique key, such as JSON lines.

    Equal rows are counted first, so copies cost one row per task in the shuffle; the copies get numbers, in steps of
    ``step`` so that no task writes out one huge group, and the numbers complete the key.
    """
    columns = ["text", "label", "confidence", "source"]
    counted = samples.select(*columns).groupBy(*columns).agg(F.count("*").alias("_n"))
    steps = counted.withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(step).cast("bigint"))))
    spread = steps.repartition(*columns, "_from")
    until = F.least(F.col("_n"), F.col("_from") + step - 1)
    numbered = spread.withColumn("_copy", F.explode(F.sequence("_from", until))).drop("_n", "_from")
    return interleave(numbered, ["text", "label", "confidence", "_copy"], order, seed).drop("_copy")


def train_share(n: Column, share: float) -> Column:
    """How many of n rows a share takes, rounded half up."""
    return F.floor(n * F.lit(share) + 0.5)


def split(
    df: DataFrame,
    cuts: dict[str, float],
    label: str = "label",
    keys: list[str] | None = None,
    seed: int = vocab.SPLIT_SEED,
) -> DataFrame:
    """Adds ``split``: every label is cut at the same exact shares, e.g. ``{"train": .8, "val": .1, "test": .1}``."""
    ranked = seeded_rank(df, label, keys or ["id"], seed, rank="_rank", total="_total")
    names = list(cuts)
    reached, column = 0.0, None
    for name in names[:-1]:
        reached = round(reached + cuts[name], 9)
        test = F.col("_rank") <= train_share(F.col("_total"), reached)
        column = F.when(test, name) if column is None else column.when(test, name)
    return ranked.withColumn("split", column.otherwise(names[-1])).drop("_rank", "_total")


def folds(
    df: DataFrame, k: int = 5, label: str = "label", keys: list[str] | None = None, seed: int = vocab.SPLIT_SEED
) -> DataFrame:
    """Adds ``fold`` 0..k-1 with equal label shares."""
    ranked = seeded_rank(df, label, keys or ["id"], seed, rank="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def valid_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is one of the six ids, cast to INT."""
    return df.filter(rules.valid_label(F.col(label))).withColumn(label, F.col(label).try_cast("int"))


def invalid_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """The side table of rows that cannot be trained on."""
    return df.filter(~rules.valid_label(F.col(label)))


def check_columns(df: DataFrame) -> bool:
    """True when the column set is the dataset's; otherwise ValueError."""
    if set(df.columns) != set(vocab.DATASET_COLUMNS):
        raise ValueError(f"missing or extra columns: {sorted(set(df.columns) ^ set(vocab.DATASET_COLUMNS))}")
    return True


def quality_report(df: DataFrame) -> DataFrame:
    """One row of counts: rows, null texts, labels and confidences out of range, ids that occur more than once.

    Ids are counted by (id) first: partial counts leave each task, and a hot id is one row.
    """
    bad_confidence = ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    per_id = df.groupBy("id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("text").isNull()).alias("null_text"),
        F.count_if(~rules.valid_label(F.col("label").cast("string"))).alias("bad_label"),
        F.count_if(bad_confidence).alias("bad_confidence"),
    )
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("null_text", "bad_label", "bad_confidence")]
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        *totals,
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
    )


def check_synthetic(df: DataFrame) -> DataFrame:
    """Usable generated rows, the lowest id of each text after trimming.

    Contract only in the reference.  A minimum per text combines before the shuffle, unlike a row number.
    """
    usable = df.filter(rules.synthetic_ok(F.col("text"), F.col("label"))).withColumn("text", text.strip(F.col("text")))
    rest = F.struct("id", "label", "source", "confidence")
    first = usable.groupBy("text").agg(F.min_by(rest, "id").alias("first"))
    return first.select("first.id", "text", "first.label", "first.source", "first.confidence")


def merge_statistics(df: DataFrame) -> DataFrame:
    """Total, count per label and count per source in one scan; ``kind`` tells which, so a null label stays a label."""
    by_label, by_source = F.grouping("label") == 0, F.grouping("source") == 0
    counted = df.groupingSets([["label"], ["source"], []], "label", "source").agg(
        F.count("*").alias("n"),
        F.when(by_label, "label").when(by_source, "source").otherwise("total").alias("kind"),
    )
    return counted.select("kind", F.coalesce("label", "source").alias("name"), "n").orderBy(
        "kind", F.col("name").asc_nulls_last()
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label of the system, zero for a label without rows.  Six rows."""
    counts = df.groupBy(F.col(label).cast("int").alias("_label")).agg(F.count("*").alias("n"))
    names = label_table(df.sparkSession).filter(F.col("label_id") >= 0).select(F.col("label_id").alias("label"))
    return names.join(counts, F.col("label") == F.col("_label"), "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def inverse_weights(df: DataFrame, label: str = "label", strict: bool = True) -> DataFrame:
    """``label, n, alpha``: (1/n) over the sum of 1/n, times the number of labels.

    A label of the system without rows fails the job when ``strict``; otherwise the labels present are weighted.
    """
    counts = label_counts(df, label)
    if strict:
        missing = F.raise_error(F.concat(F.lit("no rows for label "), F.col("label").cast("string")))
        counts = counts.withColumn("n", F.when(F.col("n") == 0, missing.cast("bigint")).otherwise(F.col("n")))
    else:
        counts = counts.filter(F.col("n") > 0)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inverse = 1 / F.col("n")
    alpha = inverse / F.sum(inverse).over(everything) * F.count("*").over(everything)
    return counts.select("label", "n", alpha.alias("alpha"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight``: all rows over (labels present times rows of the label)."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def with_balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` to every row.  The table joined has one row per label id, at most six after ``valid_rows``."""
    weights = balanced_weights(df, label).select(F.col("label").alias("_label"), "weight")
    return df.join(F.broadcast(weights), F.col(label) == F.col("_label")).drop("_label")


def deficit_plan(df: DataFrame, target: int = vocab.SYNTHETIC_TARGET, label: str = "label") -> DataFrame:
    """``label, n, target, missing``: rows still to be generated per label, the remainder going to the lowest ids."""
    counts = label_counts(df, label)
    share, rest = divmod(target, vocab.NUM_LABELS)
    wanted = F.lit(share) + (F.col("label") < rest).cast("int")
    planned = counts.withColumn("target", wanted.cast("bigint"))
    return planned.withColumn("missing", F.greatest(F.col("target") - F.col("n"), F.lit(0)))


def generation_requests(df: DataFrame, target: int = vocab.SYNTHETIC_TARGET, label: str = "label") -> DataFrame:
    """The deficit plan with the prompt of each label that still lacks rows."""
    plan = deficit_plan(df, target, label).filter(F.col("missing") > 0)
    return plan.withColumn("prompt", scores.prompt(F.col("label")))
