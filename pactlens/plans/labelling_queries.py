"""Registered queries: rule labels, predicates over clauses, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import rules, scores, text
from pactlens.operators import weak_labels
from pactlens.plans import oracle_sql as o
from pactlens.plans.registry import register
from pactlens.plans.views import cte, table, view
from pactlens.session import scratch_path

# A small pack for the Latin documents of the test tables: packs are parameters.
LATIN = rules.RulePack(
    positive={1: ["the", "et "], 2: ["que", "ión"], 3: ["sch", "ung"], 4: ["ment", "tion"], 5: ["qu'", "ß"]},
    negative={1: ["und "], 2: ["ción que"], 3: ["der "], 4: ["mente"], 5: ["xyz"]},
    sections=["license", "http"],
    business=["e", "a"],
    band=(1, 1_000_000),
)


def _clauses(spark, sf_dir):
    return view(spark, sf_dir, "clause_src")


_CLEANED = o.squeeze(o.page_marks(o.repeats(o.placeholders(o.noise_symbols("text")))))


@register(
    "f1_label_counts",
    f"{cte('clause_src')}, cl AS (SELECT id, {_CLEANED} AS text FROM clause_src) "
    f"SELECT label, risk_type, risk_level, count(*) AS n FROM cl JOIN ({o.strict_labels('cl')}) USING (text) "
    f"LEFT JOIN {o.labels_dim()} ON CAST(label_id AS VARCHAR) = label GROUP BY label, risk_type, risk_level",
)
def f1_label_counts(spark, sf_dir):
    """Clean, label, count, name."""
    cleaned = _clauses(spark, sf_dir).select(text.clean_text(F.col("text")).alias("text"))
    counted = cleaned.groupBy(rules.strict_label(F.col("text")).alias("label")).agg(F.count("*").alias("n"))
    number = F.col("label").try_cast("int")
    return counted.select("label", scores.risk_type(number).alias("risk_type"), scores.risk_level(number).alias("risk_level"), "n")


@register(
    "f1_strict_labels",
    f"{cte('clause_src')} SELECT id, label FROM clause_src JOIN ({o.strict_labels('clause_src')}) USING (text)",
)
def f1_strict_labels(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.strict_label(F.col("text")).alias("label"))


@register(
    "f1_latin_labels",
    "SELECT doc_id, decision AS label FROM documents JOIN "
    f"({o.decided('(SELECT DISTINCT text FROM documents)', LATIN)}) USING (text)",
)
def f1_latin_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.decide(F.col("text"), LATIN).alias("label"))


@register(
    "f2_base_labels",
    f"{cte('clause_src')} SELECT id, label FROM clause_src JOIN ({o.base_labels('clause_src')}) USING (text)",
)
def f2_base_labels(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.base_label(F.col("text")).alias("label"))


_ALL_PHRASES = [p for label in sorted(vocab.STRICT_POSITIVE) for p in vocab.STRICT_POSITIVE[label]]


@register(
    "f3_matched_rules",
    f"{cte('clause_src')} SELECT id, coalesce(string_agg(DISTINCT phrase, '|' ORDER BY phrase), '') AS matched FROM clause_src "
    f"LEFT JOIN {o.values([(p,) for p in dict.fromkeys(_ALL_PHRASES)], 'r(phrase)')} ON contains(text, phrase) GROUP BY id",
)
def f3_matched_rules(spark, sf_dir):
    found = rules.matched_phrases(F.col("text"), _ALL_PHRASES)
    return _clauses(spark, sf_dir).select("id", F.array_join(found, "|").alias("matched"))


_TIERS = [(label, tier, p) for label, tiers in vocab.TIERED_KEYWORDS.items() for tier, ps in tiers.items() for p in ps]
_TIER_LABELS = (
    "SELECT t.text, coalesce(arg_max(label, score), 0) AS label, coalesce(arg_max(confidence, score), CAST(0.5 AS DOUBLE)) AS confidence, "
    "coalesce(arg_max(matched, score), '') AS matched FROM (SELECT DISTINCT text FROM clause_src) t LEFT JOIN "
    "(SELECT text, label, CAST(CASE WHEN bool_or(tier = 'high') THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence, "
    "string_agg(phrase, '|' ORDER BY phrase) AS matched, "
    "(CASE WHEN bool_or(tier = 'high') THEN 1000 ELSE 0 END) + count(*) * 10 - list_position([5, 1, 2, 3, 4], label) AS score "
    f"FROM (SELECT DISTINCT text FROM clause_src) JOIN {o.values(_TIERS, 'r(label, tier, phrase)')} ON contains(text, phrase) "
    "GROUP BY text, label) USING (text) GROUP BY t.text"
)


@register(
    "f4_tier_labels",
    f"{cte('clause_src')} SELECT id, label, confidence, matched FROM (SELECT id, text FROM clause_src) JOIN ({_TIER_LABELS}) USING (text)",
)
def f4_tier_labels(spark, sf_dir):
    tiered = _clauses(spark, sf_dir).select("id", rules.tier_label(F.col("text")).alias("t"))
    return tiered.select("id", "t.label", "t.confidence", F.array_join("t.matched_rules", "|").alias("matched"))


@register(
    "f5_weak_routes",
    f"{cte('clause_src')} SELECT id, label, confidence, CASE WHEN confidence >= 0.85 THEN 'accept' WHEN confidence >= 0.6 "
    f"THEN 'review' ELSE 'drop' END AS route, 'weak' AS source FROM (SELECT id, text FROM clause_src) JOIN ({_TIER_LABELS}) USING (text)",
)
def f5_weak_routes(spark, sf_dir):
    tiered = _clauses(spark, sf_dir).select("id", rules.tier_label(F.col("text")).alias("t"))
    return tiered.select(
        "id", "t.label", "t.confidence", rules.route(F.col("t.confidence")).alias("route"), F.lit("weak").alias("source")
    )


_ROUTED = "CASE WHEN confidence >= 0.85 THEN 'accept' WHEN confidence >= 0.6 THEN 'review' ELSE 'drop' END"


def _weak(spark, sf_dir):
    return weak_labels.weak_labels(_clauses(spark, sf_dir).select("id", "text"))


@register(
    "f5_weak_labels",
    f"{cte('clause_src')} SELECT id, text, label, confidence, matched, {_ROUTED} AS route, 'weak' AS source FROM (SELECT id, text FROM clause_src) JOIN ({_TIER_LABELS}) USING (text)",
)
def f5_weak_labels(spark, sf_dir):
    """What stands in the three sinks."""
    path = scratch_path(spark, "weak")
    labelled = _weak(spark, sf_dir)
    weak_labels.write_weak_labels(labelled, path)
    read = weak_labels.read_weak_labels(labelled, path)
    return read.select("id", "text", "label", "confidence", F.array_join("matched_rules", "|").alias("matched"), "route", "source")


@register(
    "f5_weak_counts",
    f"{cte('clause_src')}, w AS (SELECT {_ROUTED} AS route FROM (SELECT text FROM clause_src) JOIN ({_TIER_LABELS}) USING (text)) "
    "SELECT r.route, (SELECT count(*) FROM w WHERE w.route = r.route) AS n FROM (SELECT unnest(['accept', 'review', 'drop']) AS route) r",
)
def f5_weak_counts(spark, sf_dir):
    """The counts observed while the sinks were written."""
    counts = weak_labels.write_weak_labels(_weak(spark, sf_dir), scratch_path(spark, "weak"))
    return spark.createDataFrame(list(counts.items()), "route STRING, n BIGINT")


@register(
    "f5_route_bands",
    f"{cte('clause_src')} SELECT CASE WHEN confidence >= 0.85 THEN 'accept' WHEN confidence >= 0.6 THEN 'review' ELSE 'drop' END "
    "AS route, count(*) AS n FROM clause_src GROUP BY 1",
)
def f5_route_bands(spark, sf_dir):
    routed = _clauses(spark, sf_dir).select(rules.route(F.col("confidence")).alias("route"))
    return routed.groupBy("route").agg(F.count("*").alias("n"))


@register("c4_discard_reason", f"{cte('clause_src')} SELECT id, {o.strict_reason('text')} AS reason FROM clause_src")
def c4_discard_reason(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.strict_discard_reason(F.col("text")).alias("reason"))


@register(
    "c5_in_business",
    f"{cte('clause_src')} SELECT id, {o.any_of('text', vocab.STRICT_BUSINESS)} AS in_business FROM clause_src",
)
def c5_in_business(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.in_business(F.col("text")).alias("in_business"))


@register("c6_base_scope", f"{cte('clause_src')} SELECT id, {o.base_scope('text')} AS scope FROM clause_src")
def c6_base_scope(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.base_scope(F.col("text")).alias("scope"))


@register(
    "c8_contract_gate",
    f"{cte('clause_src')} SELECT id, length(text) >= 5 AND {o.any_of('text', vocab.CONTRACT_WORDS)} AS accepted FROM clause_src",
)
def c8_contract_gate(spark, sf_dir):
    return _clauses(spark, sf_dir).select("id", rules.is_contract_clause(F.col("text")).alias("accepted"))
