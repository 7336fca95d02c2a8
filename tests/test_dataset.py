"""Interleaving, splits, weights, metrics, retrieval."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pactlens.functions import scores
from pactlens.operators import dataset, features, knowledge, metrics, report, retrieval


def samples(spark, sizes, repeat=1):
    rows = [(f"{s}{i // repeat}", None if i % 4 == 0 else str(i % 3), 0.5, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "text STRING, label STRING, confidence DOUBLE, source STRING")


def in_turn(sizes):
    """Source order by taking one of each in turn."""
    left, order = dict(sizes), []
    while any(left.values()):
        for s in dataset.SOURCE_ORDER:
            if left.get(s):
                left[s] -= 1
                order.append(s)
    return order


@pytest.mark.parametrize("sizes", [
    {"bid": 3, "court_judge": 1, "synthetic": 2}, {"bid": 40, "court_judge": 0, "synthetic": 7}, {"court_judge": 5},
    {"bid": 1, "court_judge": 30, "synthetic": 30},
])
def test_interleave(spark, sizes):
    rows = samples(spark, sizes)
    for merged in (dataset.interleave(rows, ["text"]), dataset.interleave_copies(rows)):
        got = merged.orderBy("id").collect()
        assert [r.id for r in got] == list(range(1, sum(sizes.values()) + 1))
        assert [r.source for r in got] == in_turn(sizes)
        assert sorted((r.text, str(r.label)) for r in got) == sorted((r.text, str(r.label)) for r in rows.collect())


def test_interleave_keeps_copies(spark):
    sizes = {"bid": 30, "synthetic": 12}
    rows = samples(spark, sizes, repeat=10).withColumn("label", F.lit("1"))
    got = dataset.interleave_copies(rows, step=3).orderBy("id").collect()
    assert [r.source for r in got] == in_turn(sizes)
    assert collections.Counter(r.text for r in got) == collections.Counter(r.text for r in rows.collect())


def test_interleave_is_fixed_by_its_seed(spark):
    rows = samples(spark, {"bid": 50, "synthetic": 50})
    first = [tuple(r) for r in dataset.interleave(rows, ["text"]).orderBy("id").collect()]
    again = [tuple(r) for r in dataset.interleave(rows.repartition(7), ["text"]).orderBy("id").collect()]
    other = [tuple(r) for r in dataset.interleave(rows, ["text"], seed=1).orderBy("id").collect()]
    assert first == again != other


def test_split_shares_are_exact(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).when(F.col("id") < 987, 1).otherwise(2).alias("label"))
    got = dataset.split(rows, {"train": 0.8, "val": 0.1, "test": 0.1})
    counts = {(r.label, r.split): r.n for r in got.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label, n in ((0, 600), (1, 387), (2, 13)):
        train, upto = math.floor(n * 0.8 + 0.5), math.floor(n * 0.9 + 0.5)
        assert (counts[label, "train"], counts[label, "val"], counts[label, "test"]) == (train, upto - train, n - upto)
    folded = dataset.folds(rows).groupBy("label", "fold").count().collect()
    by_label = collections.defaultdict(list)
    for r in folded:
        by_label[r.label].append(r["count"])
    assert all(len(c) == 5 and max(c) - min(c) <= 1 for c in by_label.values())


def weights_of(spark, counts):
    return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "label INT")


def test_weights(spark):
    rows = weights_of(spark, {0: 4, 1: 2, 2: 1})
    alpha = {r.label: round(r.alpha, 6) for r in dataset.inverse_weights(rows, strict=False).collect()}
    assert alpha == {0: 0.428571, 1: 0.857143, 2: 1.714286}
    balanced = {r.label: round(r.weight, 6) for r in dataset.balanced_weights(rows).collect()}
    assert balanced == {0: 0.583333, 1: 1.166667, 2: 2.333333}
    with pytest.raises(PySparkException, match="no rows for label"):
        dataset.inverse_weights(rows).collect()


def test_metrics(spark):
    pairs = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0])), "y INT, p INT")
    total = metrics.overall(pairs).first()
    assert [round(total[c], 6) for c in ("accuracy", "precision", "recall", "f1")] == [0.6, 0.388889, 0.5, 0.433333]
    rows = {r.label: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.support) for r in metrics.per_class(pairs).collect()}
    assert rows == {0: (0.5, 0.5, 0.5, 2), 1: (0.666667, 1.0, 0.8, 2), 2: (0.0, 0.0, 0.0, 1)}
    grid = {(r.y, r.p): r.n for r in metrics.confusion(pairs).collect()}
    assert len(grid) == 9 and grid[2, 0] == 1 and grid[2, 2] == 0
    document = metrics.metrics_document(pairs).first()
    assert set(document.per_class) == {"0", "1", "2"} and round(document.macro_f1, 6) == 0.433333


def test_normalized_confusion_of_a_label_never_true(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 0)], "y INT, p INT")
    shares = {(r.y, r.p): r.share for r in metrics.normalized_confusion(pairs).collect()}
    assert shares == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): None, (1, 1): None}


def test_recall_gate(spark):
    pairs = spark.createDataFrame([(1, 1)] * 23 + [(1, 0)] * 2 + [(5, 5)] * 9 + [(5, 1)], "y INT, p INT")
    got = {r.label: (r.passed, r.all_passed) for r in metrics.recall_gate(pairs).collect()}
    assert got == {1: (True, False), 5: (False, False)}


def test_focal_loss(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0])], "y INT, logits ARRAY<DOUBLE>")
    alpha = spark.createDataFrame([(0, 1.0)], "label INT, alpha DOUBLE")
    assert round(metrics.focal_loss(rows, alpha, 1.0).first().loss, 6) == 0.346574


def test_scores(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.35, 0.3, 0.35, 0.0],), ([0.2] * 4 + [0.1] * 2,)], "p ARRAY<DOUBLE>")
    got = df.select(scores.argmax(F.col("p")).alias("a"), scores.ranked_labels(F.col("p")).alias("r")).collect()
    assert [r.a for r in got] == [0, 0, 0]
    assert [[x.label for x in r.r] for r in got] == [[0, 1], [0, 2, 1], []]


def test_prompt_refuses_other_labels(spark):
    assert spark.range(6).select(scores.prompt(F.col("id")).alias("p")).distinct().count() == 6
    with pytest.raises(PySparkException, match="no prompt"):
        spark.range(6, 7).select(scores.prompt(F.col("id"))).collect()


def test_columns_and_quality(spark):
    rows = samples(spark, {"bid": 8}).withColumn("id", F.lit(1))
    assert dataset.check_columns(rows)
    with pytest.raises(ValueError):
        dataset.check_columns(rows.drop("id"))
    got = dataset.quality_report(rows).first()
    assert (got.n_rows, got.null_text, got.bad_label, got.repeated_ids) == (8, 0, 2, 1)


def test_retrieval_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    chunks, queries = rng.normal(size=(300, 8)), rng.normal(size=(11, 8))
    chunks[7] = 0
    odd = [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7)]
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(chunks)), *odd], "chunk_id BIGINT, vec ARRAY<DOUBLE>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id BIGINT, vec ARRAY<DOUBLE>")
    norm = np.linalg.norm(chunks, axis=1)
    score = queries @ chunks.T / np.where(norm == 0, 1, norm) / np.linalg.norm(queries, axis=1)[:, None]
    best = {(q, r + 1): int(c) for q in range(11) for r, c in enumerate(np.argsort(-score[q], kind="stable")[:3])}
    for block in (2048, 4):
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", block)
        got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.retrieve(table, asked, 3, block).collect()}
        assert got == best


def knowledge_rows():
    """Documents on a few topics, with copies and odd ones, and queries that share words with some, one or none."""
    rng = random.Random(6)
    topics = [[f"{t}{w}" for w in "alpha beta gamma delta epsilon zeta".split()] for t in "abcdefgh"]
    docs = []
    for i in range(120):
        words = topics[i % 8] + ["common", "shared"]
        docs.append((i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12)))))
    docs += [(200, docs[3][1]), (201, None), (202, ""), (203, "unique words here")]
    asked = [(i, " ".join(rng.choice(topics[i % 8] + topics[(i + 3) % 8] + ["common"]) for _ in range(rng.randint(1, 6)))) for i in range(25)]
    return docs, [*asked, (100, "nothing known"), (101, None), (102, "unique words"), (103, "common")]


def test_few_chunks_leave_a_block(spark):
    """Of the chunks of a block that share a term with a query only the k best go on, repeated ids count as one chunk."""
    texts = [(n // 3 if n < 9 else n, f"付款 验收 {'发票 ' * (n % 5)}合同{n % 7}") for n in range(70)]
    index = knowledge.build_index(spark.createDataFrame(texts, "chunk_id BIGINT, text STRING"), max_df=1.0, block_bits=2)
    assert index.postings.groupBy("chunk_id").agg(F.countDistinct("block").alias("n")).filter("n > 1").isEmpty()
    asked = knowledge.query_terms(index, spark.createDataFrame([(i, f"付款 发票 合同{i}") for i in range(6)], "query_id BIGINT, text STRING"))
    pairs = asked.select("query_id").distinct().crossJoin(index.postings.select("block").distinct())
    met = asked.withColumnRenamed("weight", "own").join(index.postings, "place").groupBy("query_id", "block", "chunk_id").agg(F.round(F.sum(F.col("own") * F.col("weight")), 9).alias("score")).collect()
    expected = set()
    for pair in {(r.query_id, r.block) for r in met}:
        own = sorted((-r.score, r.chunk_id) for r in met if (r.query_id, r.block) == pair)[:2]
        expected |= {(pair[0], chunk, -score) for score, chunk in own}
    for at_once in (4096, 2):
        knowledge.QUERIES_AT_ONCE, before = at_once, knowledge.QUERIES_AT_ONCE
        try:
            got = knowledge._block_scores(asked, index, pairs, 2).collect()
        finally:
            knowledge.QUERIES_AT_ONCE = before
        assert len(got) == len(expected) < len(met) and set(map(tuple, got)) == expected


@pytest.mark.parametrize("block_bits, k", [(10, 3), (3, 3), (0, 1), (4, 50)])
def test_knowledge_retrieval_equals_brute_force(spark, block_bits, k):
    docs, asked = knowledge_rows()
    chunks = knowledge.knowledge_chunks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4), "doc_id")
    queries = spark.createDataFrame(asked, "query_id BIGINT, text STRING")
    index = knowledge.build_index(chunks, block_bits=block_bits)
    vocabulary = index.vocabulary

    def unit(rows, key):
        long = features.transform_long(features.with_terms(rows.filter("text IS NOT NULL")), vocabulary, key).collect()
        out = {}
        for r in long:
            out.setdefault(r[key], {})[r.term] = r.tfidf
        return out

    have, want = unit(chunks, "chunk_id"), {}
    for q, weights in unit(queries, "query_id").items():
        scored = {c: round(sum(w * v[t] for t, w in weights.items() if t in v), 9) for c, v in have.items() if weights.keys() & v.keys()}
        for rank, c in enumerate(sorted(scored, key=lambda c: (-scored[c], c))[:k]):
            want[q, rank + 1] = (c, pytest.approx(scored[c], abs=2e-9))
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in knowledge.retrieve(index, queries, k).collect()}
    assert got == want and len({q for q, _ in got}) >= 27
    if block_bits == 3:  # most blocks are never scored
        terms = knowledge.query_terms(index, queries)
        left = knowledge.surviving_blocks(terms, index, knowledge.thresholds(terms, index, k)).count()
        assert left < 0.5 * index.peaks.select("block").distinct().count() * len(asked)


def test_fold_vocabularies_by_subtraction(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), " ".join(rng.choice(["ab", "cd", "ef", "gh", "only" + str(i)]) for _ in range(6))) for i in range(60)]
    table = features.with_terms(spark.createDataFrame(rows, "id INT, fold INT, text STRING"))
    counts = features.fold_term_counts(table, 3)
    sizes = {f: sum(r[1] == f for r in rows) for f in range(3)}
    for fold in range(3):
        got = features.fold_vocabulary(counts, sizes, fold, max_features=20)
        fitted = features.fit_vocabulary(table.filter(F.col("fold") != fold), max_features=20)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fitted.collect()))


def test_unknown_sources_and_labels_fail_instead_of_vanishing(spark):
    rows = spark.createDataFrame([(1, "bid", "0"), (2, "other", "0"), (3, None, None)], "id BIGINT, source STRING, label STRING")
    for bad in (rows.filter("id < 3"), rows.filter("id <> 2")):
        with pytest.raises(PySparkException, match="unknown source"):
            dataset.interleave(bad, ["id"]).collect()
    for ranked in (dataset.folds(rows), dataset.split(rows, {"train": 0.8, "test": 0.2})):
        with pytest.raises(PySparkException, match="must not be null"):
            ranked.collect()


def test_vector_and_long_form_agree(spark):
    texts = ["乙方付款后验收", "甲方付款给乙方", "验收合格 abc abc", "付"]
    rows = features.with_terms(spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING"))
    vocabulary = features.fit_vocabulary(rows, max_features=8)
    names = [r.term for r in vocabulary.orderBy(F.desc("tf"), "term").collect()]
    long = {(r.id, r.term): round(r.tfidf, 9) for r in features.transform_long(rows, vocabulary, "id").collect()}
    vectors = features.vectorizer(vocabulary).transform(rows).collect()
    wide = {(r.id, names[i]): round(float(x), 9) for r in vectors for i, x in zip(r.features.indices, r.features.values)}
    assert long == wide and len(names) == 8


def test_interleaved_rank_spreads_one_hot_group(spark):
    """A group of all rows is ranked in many tasks: no window partition holds more than its share of buckets."""
    from pactlens.operators.ranking import seeded_hash

    rows = spark.range(20000).withColumn("b", F.substring(seeded_hash(42, F.col("id")), 1, 3))
    assert rows.groupBy("b").count().agg(F.max("count")).first()[0] < 30


def test_summary_counts_rejected_apart(spark):
    rows = spark.createDataFrame([("a", -1), ("a", 1), ("a", 5), ("a", 5), ("b", 0)], "file STRING, risk_label_id INT")
    got = {r.file: (r.total, r.risk_distribution, r.high_risk_count, r.rejected) for r in report.summarize_risks(rows).collect()}
    assert got == {"a": (3, {1: 1, 5: 2}, 3, 1), "b": (1, {0: 1}, 0, 0)}


def test_deficit_remainder(spark):
    plan = dataset.deficit_plan(weights_of(spark, {0: 5, 3: 1}), 14).orderBy("label").collect()
    assert [(r.target, r.missing) for r in plan] == [(3, 0), (3, 3), (2, 2), (2, 1), (2, 2), (2, 2)]


def test_vector_entries_are_computed_once(spark):
    """Opening the entries, or filtering by their number, neither reads the texts nor counts their terms again."""
    rows = features.with_terms(spark.range(4).select("id", F.concat(F.lit("乙方付款 abc"), F.col("id").cast("string")).alias("text")))
    vocabulary = features.fit_vocabulary(rows)
    opened = features.transform_long(rows, vocabulary, "id")
    filtered = features.sparse_vectors(rows, vocabulary).filter(F.size("entries") > 0).select("id")
    for df in (opened, filtered):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # words and pairs
