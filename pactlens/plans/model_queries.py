"""Registered queries: metrics, probabilities, features, forest, retrieval, reports, stream."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import rules, scores
from pactlens.functions import text as text_functions
from pactlens.operators import dataset, documents, features, forest, frames, knowledge, metrics, report, retrieval
from pactlens.plans import fixtures
from pactlens.plans import oracle_sql as o
from pactlens.plans.registry import register
from pactlens.plans.views import clause_projection, contract_pages, cte, probabilities, table, view
from pactlens.session import scratch_path
from pactlens.sources import files as sources
from pactlens.sources import samples as files
from pactlens.streaming import scoring


def _pairs(spark, sf_dir):
    return view(spark, sf_dir, "clause_src").select("y", "p")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_CONFUSION = (
    f"{cte('clause_src')}, l AS (SELECT DISTINCT y AS label FROM clause_src UNION SELECT DISTINCT p FROM clause_src), "
    "cm AS (SELECT a.label AS y, b.label AS p, count(s.id) AS n FROM l a CROSS JOIN l b LEFT JOIN clause_src s "
    "ON s.y = a.label AND s.p = b.label GROUP BY 1, 2)"
)
_CLASSES = (
    f"{_CONFUSION}, k AS (SELECT label, (SELECT sum(n) FROM cm WHERE y = label AND p = label)::DOUBLE AS tp, "
    "(SELECT sum(n) FROM cm WHERE y = label)::DOUBLE AS t, (SELECT sum(n) FROM cm WHERE p = label)::DOUBLE AS s FROM l), "
    "m AS (SELECT label, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS precision, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS recall, "
    "CASE WHEN t + s > 0 THEN 2 * tp / (t + s) ELSE 0 END AS f1, CAST(t AS BIGINT) AS support FROM k), "
    "acc AS (SELECT avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END) AS a FROM clause_src)"
)


@register("h5_confusion", f"{_CONFUSION} SELECT * FROM cm")
def h5_confusion(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir))


@register("h6_normalized_confusion", f"{_CONFUSION} SELECT y, p, round(n::DOUBLE / sum(n) OVER (PARTITION BY y), 6) AS share FROM cm")
def h6_normalized_confusion(spark, sf_dir):
    return _rounded(metrics.normalized_confusion(_pairs(spark, sf_dir)), "share")


@register(
    "h7_overall_metrics",
    f"{_CLASSES} SELECT round((SELECT a FROM acc), 6) AS accuracy, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, "
    "round(avg(precision), 6) AS precision FROM m",
)
def h7_overall_metrics(spark, sf_dir):
    return _rounded(metrics.overall(_pairs(spark, sf_dir)), "accuracy", "recall", "f1", "precision")


@register(
    "h8_class_metrics",
    f"{_CLASSES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM m",
)
def h8_class_metrics(spark, sf_dir):
    return _rounded(metrics.per_class(_pairs(spark, sf_dir)).drop("tp"), "precision", "recall", "f1")


_AVERAGES = (
    "SELECT 'macro avg' AS name, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, CAST(sum(support) AS BIGINT) AS support FROM m "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m "
    "UNION ALL SELECT 'accuracy', a, a, a, (SELECT CAST(sum(support) AS BIGINT) FROM m) FROM acc "
    "UNION ALL SELECT CAST(label AS VARCHAR), precision, recall, f1, support FROM m"
)


@register(
    "h9_report_averages",
    f"{_CLASSES} SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({_AVERAGES})",
)
def h9_report_averages(spark, sf_dir):
    return _rounded(metrics.report(_pairs(spark, sf_dir)), "precision", "recall", "f1")


@register(
    "h10_recall_gate",
    f"{_CLASSES} SELECT label, round(recall, 6) AS recall, recall >= 0.92 AS passed, bool_and(recall >= 0.92) OVER () AS all_passed "
    "FROM m WHERE label IN (1, 5)",
)
def h10_recall_gate(spark, sf_dir):
    return _rounded(metrics.recall_gate(_pairs(spark, sf_dir)), "recall")


@register(
    "a11_metrics_document",
    f"{_CLASSES}, w AS (SELECT avg(precision) AS p, avg(recall) AS r, avg(f1) AS f, CAST(sum(support) AS BIGINT) AS s FROM m) "
    "SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ("
    "SELECT CAST(label AS VARCHAR) AS name, precision, recall, f1, support FROM m UNION ALL SELECT 'macro_avg', p, r, f, s FROM w UNION ALL "
    "SELECT 'macro_f1', NULL, NULL, f, NULL FROM w UNION ALL SELECT 'accuracy', NULL, NULL, a, NULL FROM acc)",
)
def a11_metrics_document(spark, sf_dir):
    """The nested document, written, read back and opened into one row per member."""
    path = scratch_path(spark, "metrics")
    files.write_metrics(metrics.metrics_document(_pairs(spark, sf_dir)), path)
    values = "STRUCT<precision: DOUBLE, recall: DOUBLE, `f1-score`: DOUBLE, support: BIGINT>"
    schema = f"macro_f1 DOUBLE, accuracy DOUBLE, macro_avg {values}, per_class MAP<STRING, {values}>"
    read = spark.read.schema(schema).json(path)

    def single(name: str):
        nothing = F.lit(None).cast("double")
        return F.struct(nothing.alias("precision"), nothing.alias("recall"), F.col(name).alias("f1-score"), F.lit(None).cast("bigint").alias("support"))

    members = F.map_concat("per_class", F.create_map(F.lit("macro_avg"), F.col("macro_avg"), F.lit("macro_f1"), single("macro_f1"), F.lit("accuracy"), single("accuracy")))
    opened = read.select(F.explode(members).alias("name", "v"))
    return _rounded(opened.select("name", "v.precision", "v.recall", F.col("v.f1-score").alias("f1"), "v.support"), "precision", "recall", "f1")


_ALPHA = (
    "w AS (SELECT y AS label, 1.0::DOUBLE / count(*) AS inv FROM probabilities GROUP BY y), "
    "a AS (SELECT label, inv / (SELECT sum(inv) FROM w) * 6 AS alpha FROM w)"
)


@register(
    "h11_focal_loss",
    f"{cte('probabilities')}, {_ALPHA} SELECT round(avg(alpha * pow(1 - probability[y + 1], 1) * -ln(probability[y + 1])), 6) AS loss "
    "FROM probabilities JOIN a ON label = y",
)
def h11_focal_loss(spark, sf_dir):
    rows = probabilities(spark, sf_dir)
    return _rounded(metrics.focal_loss(rows, dataset.inverse_weights(rows, "y")), "loss")


@register("b15_argmax", f"{cte('probabilities')} SELECT vec_id, list_position(probability, list_max(probability)) - 1 AS label FROM probabilities")
def b15_argmax(spark, sf_dir):
    return probabilities(spark, sf_dir).select("vec_id", scores.argmax(F.col("probability")).alias("label"))


@register("b14_confidence", f"{cte('probabilities')} SELECT vec_id, round(list_max(probability), 4) AS confidence FROM probabilities")
def b14_confidence(spark, sf_dir):
    p = F.col("probability")
    return probabilities(spark, sf_dir).select("vec_id", scores.confidence(p, scores.argmax(p)).alias("confidence"))


@register(
    "b19_percent",
    f"{cte('probabilities')} SELECT vec_id, CAST(k - 1 AS INT) AS label, round(CASE WHEN x > 0 AND x <= 1 THEN x * 100 ELSE x END, 6) AS percent FROM "
    "(SELECT vec_id, unnest(logits) AS x, generate_subscripts(logits, 1) AS k FROM probabilities)",
)
def b19_percent(spark, sf_dir):
    rows = probabilities(spark, sf_dir).select("vec_id", F.posexplode("logits").alias("label", "x"))
    return rows.select("vec_id", "label", F.round(scores.percent(F.col("x")), 6).alias("percent"))


@register(
    "i1_ranked_probabilities",
    f"{cte('probabilities')} SELECT vec_id, label, round(percent, 6) AS percent, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY percent DESC, label) "
    "AS INT) AS rank FROM (SELECT vec_id, CAST(k - 1 AS INT) AS label, x * 100 AS percent FROM (SELECT vec_id, unnest(probability) AS x, "
    "generate_subscripts(probability, 1) AS k FROM probabilities)) WHERE percent >= 30",
)
def i1_ranked_probabilities(spark, sf_dir):
    ranked = scores.ranked_labels(F.col("probability"))
    rows = probabilities(spark, sf_dir).select("vec_id", F.posexplode(ranked).alias("k", "r"))
    return rows.select("vec_id", "r.label", F.round("r.percent", 6).alias("percent"), (F.col("k") + 1).alias("rank"))


def _rule_predictions(spark, sf_dir, even=False):
    """Predictions of the rules in the shape of a scored table; review, discard and no label count as rejected."""
    clauses = view(spark, sf_dir, "clause_src", even).select("file", "id", "text", "confidence")
    label = F.coalesce(rules.strict_label(F.col("text")).try_cast("int"), F.lit(-1))
    named = frames.once(clauses, {"risk_label_id": label})
    return named.withColumns(
        {"risk_type": scores.risk_type(F.col("risk_label_id")), "risk_level": scores.risk_level(F.col("risk_label_id"))}
    )


_RULE_PREDICTIONS = (
    f"{cte('clause_src')}, pr AS (SELECT file, id, text, confidence, label_id, risk_type, risk_level FROM clause_src JOIN "
    f"({o.strict_labels('clause_src')}) USING (text) JOIN {o.labels_dim()} ON label_id = coalesce(TRY_CAST(label AS INT), -1))"
)


@register(
    "h12_risk_summary",
    f"{_RULE_PREDICTIONS} SELECT file, CAST(sum(CASE WHEN label_id >= 0 THEN n ELSE 0 END) AS BIGINT) AS total, "
    "string_agg(CASE WHEN label_id >= 0 THEN label_id || ':' || n END, ',' ORDER BY label_id) AS distribution, "
    "CAST(sum(CASE WHEN label_id IN (1, 5) THEN n ELSE 0 END) AS BIGINT) AS high_risk_count, "
    "CAST(sum(CASE WHEN label_id < 0 THEN n ELSE 0 END) AS BIGINT) AS rejected FROM "
    "(SELECT file, label_id, count(*) AS n FROM pr GROUP BY file, label_id) GROUP BY file",
)
def h12_risk_summary(spark, sf_dir):
    summary = report.summarize_risks(_rule_predictions(spark, sf_dir))
    entries = F.transform(
        F.map_entries("risk_distribution"),
        lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")),
    )
    return summary.select("file", "total", F.array_join(entries, ",").alias("distribution"), "high_risk_count", "rejected")


_ADVICE = o.values(list(report.ADVICE.items()), "v(k, advice)")
_REPORT = (
    f"{_RULE_PREDICTIONS}, n AS (SELECT file, label_id, risk_type, count(*) AS n FROM pr GROUP BY ALL), "
    "t AS (SELECT file, count(*) FILTER (label_id >= 0) AS total FROM pr GROUP BY file) "
    "SELECT file, 1 AS section, 0 AS place, '# ' || file || ' 条款数 ' || total AS line FROM t UNION ALL "
    "SELECT file, 2, id, '- ' || risk_level || ' ' || risk_type || ' ' || text FROM pr WHERE label_id > 0 UNION ALL "
    "SELECT file, 4, id, '- ' || risk_level || ' ' || risk_type || ' ' || text FROM pr WHERE label_id IN (1, 5) UNION ALL "
    "SELECT file, 3, label_id, '- ' || risk_type || ' ' || n || ' ' || (n * 1000 // total) // 10 || '.' || (n * 1000 // total) % 10 || '%' "
    "FROM n JOIN t USING (file) WHERE label_id >= 0 UNION ALL "
    f"SELECT file, 5, label_id, '- ' || risk_type || ' ' || advice FROM n JOIN {_ADVICE} ON k = label_id WHERE label_id > 0"
)


@register("j6_risk_report", _REPORT)
def j6_risk_report(spark, sf_dir):
    """Labelled once, stored, and read by both halves of the report."""
    return report.report_lines(frames.stored(_rule_predictions(spark, sf_dir, even=True), "predictions"), "file", "id")


_JSON_REPORT = (
    f"{_RULE_PREDICTIONS}, n AS (SELECT file, label_id, risk_type, count(*) AS n FROM pr GROUP BY ALL), "
    "t AS (SELECT file, count(*) FILTER (label_id >= 0) AS total, count(*) FILTER (label_id < 0) AS rejected, count(*) FILTER (label_id > 0) AS risks, "
    "count(*) FILTER (label_id IN (1, 5)) AS high, count(DISTINCT label_id) FILTER (label_id >= 0) AS labels, count(DISTINCT label_id) FILTER (label_id > 0) AS bad "
    "FROM pr GROUP BY file) "
    "SELECT file, 1 AS section, 0 AS place, '{\"file\":\"' || file || '\",\"total\":' || total || ',\"rejected\":' || rejected AS line FROM t UNION ALL "
    "SELECT file, 2, -1, ',\"risks\":{\"count\":' || risks FROM t UNION ALL "
    "SELECT file, 2, id, ',\"' || id || '\":' || to_json({'text': text, 'risk_type': risk_type, 'risk_level': risk_level, 'confidence': confidence, "
    "'explanation': NULL::VARCHAR})::VARCHAR FROM pr WHERE label_id > 0 UNION ALL "
    "SELECT file, 3, -1, '},\"distribution\":{\"count\":' || labels FROM t UNION ALL "
    "SELECT file, 3, label_id, ',\"' || label_id || '\":' || to_json({'name': risk_type, 'n': n, 'share': (n * 1000 // total) // 10 || '.' || (n * 1000 // total) % 10 || '%'})::VARCHAR "
    "FROM n JOIN t USING (file) WHERE label_id >= 0 UNION ALL "
    "SELECT file, 4, -1, '},\"warnings\":{\"count\":' || high FROM t UNION ALL "
    "SELECT file, 4, id, ',\"' || id || '\":' || to_json({'text': text, 'risk_type': risk_type})::VARCHAR FROM pr WHERE label_id IN (1, 5) UNION ALL "
    "SELECT file, 5, -1, '},\"advice\":{\"count\":' || bad FROM t UNION ALL "
    f"SELECT file, 5, label_id, ',\"' || label_id || '\":' || to_json({{'name': risk_type, 'advice': advice}})::VARCHAR FROM n JOIN {_ADVICE} ON k = label_id WHERE label_id > 0 "
    "UNION ALL SELECT file, 6, 0, '}}' FROM t"
)


@register("j6_json_report", _JSON_REPORT)
def j6_json_report(spark, sf_dir):
    return report.json_report_lines(frames.stored(_rule_predictions(spark, sf_dir, even=True), "predictions"), "file", "id")


@register(
    "j6_risk_items",
    f"{_RULE_PREDICTIONS} SELECT file, id, text, risk_type, risk_level, confidence, label_id IN (1, 5) AS warning, "
    "CAST(NULL AS VARCHAR) AS explanation FROM pr WHERE label_id > 0",
)
def j6_risk_items(spark, sf_dir):
    return report.risk_items(_rule_predictions(spark, sf_dir), "file", "id")


_KNOWN = f"(length(text) >= 5 AND {o.any_of('text', vocab.CONTRACT_WORDS)})"


@register(
    "b16_response",
    f"{cte('clause_src')} SELECT id, CASE WHEN t <> '' THEN t END AS text, CASE WHEN t <> '' THEN risk_type END AS risk_type, "
    "CASE WHEN t <> '' THEN risk_level END AS risk_level, CASE WHEN t <> '' THEN y END AS risk_label_id, CASE WHEN t <> '' THEN confs[y + 1] END AS confidence, "
    "CASE WHEN t <> '' THEN confs END AS confidence_array, CASE WHEN t = '' THEN '文本为空' END AS error FROM "
    f"(SELECT id, y, {o.strip('txt')} AS t, [0.1, 0.2, 0.1, 0.3, 0.2, 0.1]::DOUBLE[] AS confs FROM (SELECT id, y, CASE WHEN p = 2 THEN ' ' || chr(10) ELSE '  ' || text || '　' END AS txt "
    f"FROM clause_src)) JOIN {o.labels_dim()} ON label_id = y",
)
def b16_response(spark, sf_dir):
    clauses = view(spark, sf_dir, "clause_src").select(
        "id",
        F.expr("CASE WHEN p = 2 THEN ' ' || chr(10) ELSE '  ' || text || '　' END").alias("text"),
        F.col("y").alias("risk_label_id"),
        F.lit(False).alias("rejected"),
        F.expr("array(0.1D, 0.2D, 0.1D, 0.3D, 0.2D, 0.1D)").alias("probability"),
    )
    return forest.response(forest.prediction_record(clauses, ["id"]), ["id"])


_DOC_GRAMS = f"g AS (SELECT * FROM ({o.gram_rows('documents', 'doc_id')}) WHERE term IS NOT NULL)"
_DOC_VOCABULARY = (
    f"{_DOC_GRAMS}, n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g "
    "GROUP BY term HAVING count(DISTINCT doc_id) <= (SELECT n FROM n) * CAST(0.95 AS DOUBLE) ORDER BY tf DESC, term LIMIT 5000), "
    "voc AS (SELECT term, tf, df, ln((1 + (SELECT n FROM n))::DOUBLE / (1 + df)) + 1 AS idf FROM v)"
)


def _terms(spark, sf_dir):
    return features.with_terms(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "terms")


@register("j1_vocabulary", f"WITH {_DOC_VOCABULARY} SELECT term, tf, df, round(idf, 6) AS idf FROM voc")
def j1_vocabulary(spark, sf_dir):
    return _rounded(features.fit_vocabulary(_terms(spark, sf_dir)), "idf")


@register("i3_top_terms", f"WITH {_DOC_GRAMS} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY term ORDER BY tf DESC, term LIMIT 100")
def i3_top_terms(spark, sf_dir):
    return features.fit_vocabulary(_terms(spark, sf_dir), max_features=100, max_df=1.0).drop("idf")


@register(
    "j1_tfidf",
    f"WITH {_DOC_VOCABULARY}, r AS (SELECT doc_id, term, count(*) AS tf, count(*) * any_value(idf) AS raw FROM g JOIN "
    "voc USING (term) GROUP BY doc_id, term) SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM r",
)
def j1_tfidf(spark, sf_dir):
    rows = _terms(spark, sf_dir)
    return _rounded(features.transform_long(rows, features.fit_vocabulary(rows), "doc_id"), "tfidf")


@register(
    "j1_vectors",
    f"WITH {_DOC_VOCABULARY}, r AS (SELECT doc_id, term, count(*) * any_value(idf) AS raw FROM g JOIN voc USING (term) GROUP BY doc_id, term) "
    "SELECT doc_id, CAST(count(raw) AS INT) AS n_terms, coalesce(round(max(raw) / sqrt(sum(raw * raw)), 6), 0) AS top FROM documents "
    "LEFT JOIN r USING (doc_id) GROUP BY doc_id",
)
def j1_vectors(spark, sf_dir):
    """The narrow vector form: how many terms a document has, and its largest weight."""
    rows = _terms(spark, sf_dir)
    vectors = features.vectorizer(features.fit_vocabulary(rows)).transform(rows)
    weights = vectors.select("doc_id", vector_to_array("features").alias("w"))
    return weights.select(
        "doc_id", F.size(F.array_remove("w", F.lit(0.0))).alias("n_terms"), F.round(F.array_max("w"), 6).alias("top")
    )


@register(
    "i2_retrieval",
    "WITH q AS (SELECT label, list(m ORDER BY k) AS vec FROM (SELECT label, k, avg(x::DOUBLE) AS m FROM (SELECT label, "
    "unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k) GROUP BY label), "
    "s AS (SELECT CAST(q.label AS BIGINT) AS query_id, vec_id AS chunk_id, list_cosine_similarity(vec, list_transform(embedding, lambda x: x::DOUBLE)) AS score "
    "FROM q CROSS JOIN embeddings) SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 3",
)
def i2_retrieval(spark, sf_dir):
    """The mean vector of every label as the query."""
    vectors = table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    sorted_means = F.array_sort(F.collect_list(F.struct("k", "m")))
    queries = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(sorted_means, lambda s: s["m"]).alias("vec"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return _rounded(retrieval.retrieve(chunks, queries), "score")


_CHUNKS = (
    "ch AS (SELECT CAST(doc_id * 16777216 + piece AS BIGINT) AS chunk_id, clause AS text FROM (SELECT doc_id, piece, "
    f"{o.strip('raw')} AS clause FROM (SELECT doc_id, unnest(string_split_regex(text, '{vocab.SENTENCE_SEPARATOR}')) AS raw, "
    f"generate_subscripts(string_split_regex(text, '{vocab.SENTENCE_SEPARATOR}'), 1) - 1 AS piece FROM documents)) WHERE length(clause) >= 5)"
)


@register(
    "i2_knowledge",
    f"WITH {_CHUNKS}, g AS (SELECT * FROM ({o.gram_rows('ch', 'chunk_id')}) WHERE term IS NOT NULL), n AS (SELECT count(*) AS n FROM ch), "
    "voc AS (SELECT term, ln((1 + (SELECT n FROM n))::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df "
    "FROM g GROUP BY term HAVING count(DISTINCT chunk_id) <= (SELECT n FROM n) * CAST(0.95 AS DOUBLE) ORDER BY tf DESC, term LIMIT 5000)), "
    "w AS (SELECT chunk_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) AS weight FROM (SELECT chunk_id, term, count(*) * any_value(idf) AS raw "
    "FROM g JOIN voc USING (term) GROUP BY chunk_id, term)), "
    f"qg AS (SELECT * FROM ({o.gram_rows('benchmark', 'item_id')}) WHERE term IS NOT NULL), "
    "q AS (SELECT item_id AS query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS asked FROM (SELECT item_id, term, count(*) * any_value(idf) AS raw "
    "FROM qg JOIN voc USING (term) GROUP BY item_id, term)), "
    "s AS (SELECT query_id, chunk_id, round(sum(asked * weight), 9) AS score FROM q JOIN w USING (term) GROUP BY query_id, chunk_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) "
    "SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 3",
)
def i2_knowledge(spark, sf_dir):
    """The three chunks of all documents nearest to each benchmark text: chunks, vectors, index, retrieval."""
    index = knowledge.build_index(knowledge.knowledge_chunks(table(spark, sf_dir, "documents"), "doc_id"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _rounded(knowledge.retrieve(index, asked), "score")


def _training(spark, sf_dir):
    """Clauses with the strict label as truth, which is computed once although the valid ones are picked by it."""
    clauses = view(spark, sf_dir, "clause_src", even=True).select("id", "text")
    return dataset.valid_rows(frames.once(clauses, {"label": rules.strict_label(F.col("text"))}))


_LABELLED = (
    f"{cte('clause_src')}, l AS (SELECT id, clause_src.text, label FROM clause_src JOIN ({o.strict_labels('clause_src')}) USING (text) "
    "WHERE label IN ('0', '1', '2', '3', '4', '5')), r AS (SELECT id, text, label, row_number() OVER (PARTITION BY label ORDER BY "
    "md5('42|' || CAST(id AS VARCHAR)), id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM l)"
)
LEAST_F1 = 0.8  # of the forest on rows it has not seen; what exactly it learns is not SQL's to say
_SMALL = {"trees": 10, "depth": 8}  # where the check is on everything but the forest's opinion


def _floor(f1) -> F.Column:
    return (F.col(f1) >= LEAST_F1).alias("reaches_floor")


@register(
    "j2_forest",
    f"{_LABELLED}, t AS (SELECT label, count(*) AS support FROM r WHERE rk > floor(n * CAST(0.8 AS DOUBLE) + 0.5) GROUP BY label) "
    "SELECT label AS name, support, true AS reaches_floor FROM t UNION ALL "
    "SELECT unnest(['macro avg', 'weighted avg', 'accuracy']), (SELECT CAST(sum(support) AS BIGINT) FROM t), true",
)
def j2_forest(spark, sf_dir):
    """Trained on 80 %, measured on the rest: the tested rows of every label, and whether its f1 reaches the floor."""
    rows = frames.stored(dataset.split(_training(spark, sf_dir), {"train": 0.8, "test": 0.2}), "split-rows")
    model = forest.train(rows.filter("split = 'train'"))
    tested = forest.predict(rows.filter("split = 'test'"), model)
    measured = metrics.report(tested.select(F.col("label").alias("y"), F.col("prediction").alias("p")))
    return measured.select("name", "support", _floor("f1"))


@register("j3_cross_validation", "SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS fold, true AS reaches_floor")
def j3_cross_validation(spark, sf_dir):
    return forest.cross_validate(_training(spark, sf_dir), "id").select("fold", _floor("macro_f1"))


@register(
    "j3_fold_vocabularies",
    f"{_LABELLED}, c AS (SELECT id, text, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r), "
    f"g AS (SELECT * FROM ({o.gram_rows('c', 'id')}) WHERE term IS NOT NULL), f AS (SELECT unnest([0, 1, 2, 3, 4]) AS out), "
    "n AS (SELECT out, count(*) AS n FROM f JOIN c ON fold <> out GROUP BY out), "
    "v AS (SELECT out, term, count(*) AS tf, count(DISTINCT id) AS df FROM f JOIN (SELECT g.*, fold FROM g JOIN c USING (id)) ON fold <> out GROUP BY out, term), "
    "k AS (SELECT v.*, n, row_number() OVER (PARTITION BY out ORDER BY tf DESC, term) AS place FROM v JOIN n USING (out) WHERE df <= n * CAST(0.95 AS DOUBLE)) "
    "SELECT CAST(out AS INTEGER) AS fold, term, tf, df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf FROM k WHERE place <= 5000",
)
def j3_fold_vocabularies(spark, sf_dir):
    """The vocabulary that each fold's model is fitted with: all folds counted once, a fold's own counts taken off."""
    rows = frames.stored(features.with_terms(dataset.folds(_training(spark, sf_dir))).select("fold", "terms"), "fold-rows")
    counts = frames.stored(features.fold_term_counts(rows, 5), "fold-terms")
    sizes = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    found = [features.fold_vocabulary(counts, sizes, i).select(F.lit(i).alias("fold"), "term", "tf", "df", "idf") for i in range(5)]
    return _rounded(reduce(lambda a, b: a.unionByName(b), found), "idf")


_GATED = f"{cte('clause_src')} SELECT id, NOT {_KNOWN} AS rejected, CASE WHEN NOT {_KNOWN} THEN '{vocab.REJECT_MESSAGE}' END AS message, true AS sound FROM clause_src"


def _sound() -> F.Column:
    """Whether a scored row agrees with itself: label, names and confidence follow from the probabilities, or it is a rejection."""
    array, label = F.col("confidence_array"), F.col("risk_label_id")
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    scored = (
        (F.size(array) == vocab.NUM_LABELS) & (F.abs(total - 1) < 1e-9) & (label == scores.argmax(array))
        & (F.abs(F.col("confidence") - F.array_max(array)) <= 5e-5 + 1e-9)
    )
    turned_down = (label == vocab.REJECTED[0]) & (F.col("confidence") == 0) & (F.size(array) == 0)
    named = F.col("risk_type").eqNullSafe(scores.risk_type(label)) & F.col("risk_level").eqNullSafe(scores.risk_level(label))
    return (F.when(F.col("rejected"), turned_down).otherwise(scored) & named).alias("sound")


@register("j4_batch_scoring", _GATED)
def j4_batch_scoring(spark, sf_dir):
    """The model goes through the store before it scores, as it would between two jobs."""
    path = scratch_path(spark, "forest")
    forest.save_model(forest.train(_training(spark, sf_dir)), path)
    scored = forest.score_clauses(view(spark, sf_dir, "clause_src", even=True).select("id", "text"), forest.load_model(path))
    return scored.select("id", "rejected", "message", _sound())


@register("a12_model_store", f"{cte('clause_src')} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM clause_src")
def a12_model_store(spark, sf_dir):
    """Every clause scored by a model and by what its store gives back."""
    path = scratch_path(spark, "forest")
    model = forest.train(_training(spark, sf_dir), **_SMALL)
    forest.save_model(model, path)
    first = forest.predict(view(spark, sf_dir, "clause_src", even=True).select("text"), model).withColumnsRenamed({"prediction": "p", "probability": "q"})
    both = forest.predict(first, forest.load_model(path))
    return both.agg(F.count("*").alias("n"), F.count_if((F.col("p") != F.col("prediction")) | (F.col("q") != F.col("probability"))).alias("n_different"))


# The parts of the readable DOCX files by place, and the lines of all readable files.
_PARTS = (
    f"{cte('files_src')}, d AS (SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS pos, line FROM files_src "
    f"WHERE kind IN ('docx', 'table') AND {o.strip('line')} <> ''), s AS (SELECT name, kind, count(*) AS n FROM d GROUP BY name, kind), "
    "b AS (SELECT name, n AS pos, '合计' || chr(9) || '件数' AS line FROM s UNION ALL SELECT name, n + 1, '备注' || chr(9) || '付款验收' FROM s WHERE kind = 'docx')"
)
_FILE_LINES = (
    f"{_PARTS}, x AS (SELECT name, string_agg(line, chr(10) ORDER BY pos) AS text FROM files_src WHERE kind IN ('utf-8', 'gbk') GROUP BY name), "
    "y AS (SELECT name, pos, line FROM d UNION ALL SELECT name, pos, line FROM b), "
    f"z AS (SELECT name, pos * 4294967296 AS pos, line FROM ({o.cleaned_lines('y', 'name, pos', 'line')}) UNION ALL "
    f"SELECT name, row_number() OVER (PARTITION BY name ORDER BY n) - 1, line FROM ({o.cleaned_lines('x', 'name')}))"
)


def _named(df):
    return df.withColumn("file", text_functions.base_name(F.col("file")))


@register(
    "a4_contract_folder",
    f"{cte('files_src')} SELECT DISTINCT name AS file FROM files_src WHERE (name LIKE '%.docx' OR name LIKE '%.pdf') AND name NOT LIKE '第一册%'",
)
def a4_contract_folder(spark, sf_dir):
    return _named(sources.list_contracts(spark, fixtures.write_contract_files(spark, sf_dir)).select("file"))


@register(
    "a5_docx_text",
    f"{_PARTS} SELECT name AS file, CAST(pos AS INTEGER) AS pos, 'paragraph' AS kind, {o.strip('line')} AS text FROM d WHERE name LIKE '%.docx' AND name NOT LIKE '第一册%' "
    "UNION ALL SELECT name, CAST(pos AS INTEGER), 'table', line FROM b WHERE name LIKE '%.docx' AND name NOT LIKE '第一册%'",
)
def a5_docx_text(spark, sf_dir):
    """Paragraphs and table rows of the contracts of a folder, up to where a table is damaged."""
    found = sources.list_contracts(spark, fixtures.write_contract_files(spark, sf_dir))
    return _named(sources.parsed_text(sources.decoded_files(found)))


@register(
    "a5_docx_lines",
    f"{_PARTS} SELECT name AS file, CAST(pos * 4294967296 AS BIGINT) AS pos, line FROM ({o.cleaned_lines('d', 'name, pos', 'line')}) "
    "WHERE name LIKE '%.docx' AND name NOT LIKE '第一册%'",
)
def a5_docx_lines(spark, sf_dir):
    """The cleaned paragraphs: a number with blanks around it stays, one without goes."""
    found = sources.list_contracts(spark, fixtures.write_contract_files(spark, sf_dir))
    return _named(sources.docx_lines(sources.decoded_files(found)))


@register(
    "a5_failed_files",
    f"{cte('files_src')} SELECT DISTINCT name AS file, CASE kind WHEN 'pdf' THEN 'no decoder for .pdf' ELSE 'damaged' END AS error FROM files_src WHERE kind IN ('pdf', 'broken')",
)
def a5_failed_files(spark, sf_dir):
    """The side table of contracts that could not be read."""
    found = sources.list_contracts(spark, fixtures.write_contract_files(spark, sf_dir))
    failed = _named(sources.failed_files(sources.decoded_files(found)))
    return failed.withColumn("error", F.when(F.col("error").startswith("BadZipFile"), "damaged").otherwise(F.col("error")))


@register(
    "j5_file_scoring",
    f"{_FILE_LINES}, p AS (SELECT name AS file, pos, unnest(string_split_regex(line, '{vocab.SENTENCE_SEPARATOR}')) AS raw, "
    f"generate_subscripts(string_split_regex(line, '{vocab.SENTENCE_SEPARATOR}'), 1) - 1 AS piece FROM z), "
    f"t AS (SELECT file, CAST(pos AS BIGINT) AS pos, CAST(piece AS INTEGER) AS piece, {o.strip('raw')} AS text FROM p) "
    f"SELECT file, pos, piece, text AS clause, NOT {_KNOWN} AS rejected, true AS sound FROM t WHERE length(text) >= 5",
)
def j5_file_scoring(spark, sf_dir):
    """DOCX and TXT files of a folder, decoded in one scan, to scored sentences."""
    model = forest.train(_training(spark, sf_dir), **_SMALL)
    parts = sources.decoded_files(sources.list_files(spark, fixtures.write_contract_files(spark, sf_dir)))
    scored = forest.score_lines(sources.file_lines(parts, tables=True), model)
    return _named(scored.select("file", "pos", "piece", "clause", "rejected", _sound()))


@register("j7_stream_scores", _GATED)
def j7_stream_scores(spark, sf_dir):
    """Order lines arrive as files, a stored model scores them batch by batch."""
    output = scratch_path(spark, "stream-scores")
    forest.save_model(forest.train(_training(spark, sf_dir), **_SMALL), f"{output}-model")
    schema = table(spark, sf_dir, "lineitem").schema
    clauses = clause_projection(scoring.clause_stream(spark, f"{sf_dir}/lineitem.parque[t]", schema, "parquet")).select("id", "text")
    scoring.start_model_scoring(clauses, f"{output}-model", output, f"{output}-checkpoint").awaitTermination()
    return spark.read.parquet(output).select("id", "rejected", "message", _sound())


@register(
    "j7_stream_labels",
    f"{cte('clause_src')} SELECT id, label FROM clause_src JOIN ({o.strict_labels('clause_src')}) USING (text)",
)
def j7_stream_labels(spark, sf_dir):
    """Order lines arrive as files and leave as labelled clauses."""
    output = scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "lineitem").schema
    # A glob, because a stream takes a folder or a pattern but no single file.
    clauses = clause_projection(scoring.clause_stream(spark, f"{sf_dir}/lineitem.parque[t]", schema, "parquet"))
    query = scoring.start_scoring(
        clauses,
        lambda df: df.select("id", rules.strict_label(F.col("text")).alias("label")),
        output,
        f"{output}-checkpoint",
    )
    query.awaitTermination()
    return spark.read.schema("id BIGINT, label STRING").parquet(output)
