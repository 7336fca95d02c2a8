"""TF-IDF: a relational fit, a narrow vector transform, and a long form for inspection."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions.tokens import long_tokens, pairs_after
from pactlens.operators.frames import once


def with_terms(df: DataFrame, text: str = "text", terms: str = "terms") -> DataFrame:
    """Adds the array of one- and two-word terms of a text."""
    words = df.withColumn("_words", long_tokens(F.col(text)))
    return words.withColumn(terms, pairs_after(F.col("_words"))).drop("_words")


def _occurrences(df: DataFrame, terms: str, *keys: str) -> DataFrame:
    """``keys, term, tf, df``: a row is opened twice, with all its terms for tf and with its distinct terms for df."""
    views = F.array(
        F.struct(F.col(terms).alias("terms"), F.lit(1).alias("tf"), F.lit(0).alias("df")),
        F.struct(F.array_distinct(terms).alias("terms"), F.lit(0).alias("tf"), F.lit(1).alias("df")),
    )
    return df.select(*keys, F.inline(views)).select(*keys, F.explode("terms").alias("term"), "tf", "df")


def term_counts(df: DataFrame, terms: str = "terms") -> DataFrame:
    """``term, tf, df`` over the corpus.

    Occurrences and documents are counted in one pass.  Nothing is grouped by (row, term), so what is shuffled is one
    partial count per term and task.
    """
    return _occurrences(df, terms).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fold_term_counts(df: DataFrame, k: int, terms: str = "terms", fold: str = "fold") -> DataFrame:
    """``term, tf ARRAY<BIGINT>, df ARRAY<BIGINT>``: the counts of every fold, in the same single pass."""
    opened = _occurrences(df, terms, fold)
    each = {c: [F.sum(F.when(F.col(fold) == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(k)] for c in ("tf", "df")}
    counted = opened.groupBy("term").agg(*each["tf"], *each["df"])
    return counted.select("term", *(F.array(*(f"{c}{i}" for i in range(k))).alias(c) for c in ("tf", "df")))


def fold_vocabulary(
    counts: DataFrame, sizes: dict[int, int], fold: int, max_features: int = vocab.MAX_FEATURES, max_df: float = vocab.MAX_DF
) -> DataFrame:
    """``term, tf, df, idf`` of the rows outside ``fold``: the counts of :func:`fold_term_counts` less the fold's own."""

    def rest(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x) - F.get(c, F.lit(fold))

    outside = counts.select("term", rest("tf").alias("tf"), rest("df").alias("df")).filter(F.col("df") > 0)
    return _frequent(outside, F.lit(sum(n for f, n in sizes.items() if f != fold)), max_features, max_df)


def fit_vocabulary(
    df: DataFrame, terms: str = "terms", max_features: int = vocab.MAX_FEATURES, max_df: float = vocab.MAX_DF
) -> DataFrame:
    """``term, tf, df, idf``: terms in at most ``max_df`` of the rows, the most frequent ``max_features`` of them.

    idf is ln((1+n)/(1+df)) + 1.  Equal frequencies are cut in term order.
    """
    return _frequent(term_counts(df, terms), df.agg(F.count("*").alias("n")).scalar(), max_features, max_df)


def _frequent(counts: DataFrame, n: Column, max_features: int, max_df: float) -> DataFrame:
    top = counts.filter(F.col("df") <= n * F.lit(max_df)).orderBy(F.desc("tf"), "term").limit(max_features)
    return top.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def sparse_vectors(df: DataFrame, vocabulary: DataFrame, terms: str = "terms") -> DataFrame:
    """Adds ``entries ARRAY<STRUCT<place INT, tf DOUBLE, value DOUBLE>>``: the known terms of a row, by their place in the vocabulary.

    ``value`` is the TF-IDF weight in a vector of unit length.  The vector stages count inside the row, so no token is
    shuffled; their sparse form is opened as it is.
    """
    return _with_entries(df, _by_place(vocabulary).collect(), terms)


def _with_entries(df: DataFrame, rows: list[Row], terms: str) -> DataFrame:
    counts, features = (F.unwrap_udt(c) for c in ("_counts", "_features"))
    entries = F.arrays_zip(counts["indices"].alias("place"), counts["values"].alias("tf"), features["values"].alias("value"))
    known = df.withColumn("_terms", F.coalesce(terms, F.array().cast("array<string>")))  # the stages take no null
    counted = _stages(rows, "_terms", "_features").transform(known)
    return once(counted, {"entries": entries}).select(*df.columns, "entries")  # who opens or filters them would count twice


def transform_long(df: DataFrame, vocabulary: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``key, term, tf, tfidf`` with rows of unit length: a narrow transform; the driver holds the vocabulary's terms only.

    The vocabulary is collected once, as it may be a count over the whole corpus that is not stored.
    """
    rows = _by_place(vocabulary).collect()
    names = df.sparkSession.createDataFrame([(place, r.term) for place, r in enumerate(rows)], "place INT, term STRING")
    entries = _with_entries(df, rows, terms).select(key, F.inline("entries")).join(F.broadcast(names), "place")
    return entries.select(key, "term", F.col("tf").cast("bigint").alias("tf"), F.col("value").alias("tfidf"))


def _by_place(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.orderBy(F.desc("tf"), "term").select("term", "idf")


def vectorizer(vocabulary: DataFrame, terms: str = "terms", output: str = "features") -> PipelineModel:
    """Terms to unit-length TF-IDF vectors, a narrow transform.  The driver holds the ``max_features`` terms only."""
    return _stages(_by_place(vocabulary).collect(), terms, output)


def _stages(rows: list[Row], terms: str, output: str) -> PipelineModel:
    counts = CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=terms, outputCol="_counts")
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="_counts", outputCol="_scaled"
    )
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=output)
    return PipelineModel(stages=[counts, scaled, unit])
