"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import re

import oracle
import pytest

import __spark_entry__ as entry
from pactlens.plans import catalog, model_queries

QUERIES, ORACLES = catalog.queries(), catalog.oracles()  # tests/llm has those of the optional subpackage
# Queries whose plan has a Python worker or was built by training: file contents, the matrix product, forests.
OTHERS = {"a6_txt_files", "i2_retrieval", "j2_forest", "j3_cross_validation", "j4_batch_scoring", "j5_file_scoring"}
# Row-wise operators: one narrow stage, no shuffle, no Python worker.
NARROW = (
    "b1_clean_documents b1_clean_html b2_noise_symbols b3_placeholders b4_repeats b5_page_marks b6_squeeze b7_short_noise "
    "b8_file_name b9_host_referer b10_header_extension b11_byte_extension b12_file_names b13_label_names b16_response "
    "b17_tokens b18_prompts b20_stamped_samples b21_label_cast c1_keep_paragraph c2_noise_line c4_discard_reason c5_in_business "
    "c6_base_scope c7_clause_band c8_contract_gate c9_valid_labels d2_suffix_rules e1_lines e5_clauses e6_sentences "
    "f1_strict_labels f2_base_labels f3_matched_rules f4_tier_labels f5_weak_routes j6_risk_items i1_ranked_probabilities"
).split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, tiny, name):
    assert oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], tiny) is None


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_queries_stay_narrow(spark, tiny, name):
    text = plan(QUERIES[name](spark, tiny))
    assert not re.search(r"Exchange|Python|Pandas|Join|Window", text), text


@pytest.mark.parametrize("name", sorted(set(ORACLES) - OTHERS))
def test_no_python_and_no_cross_join(spark, tiny, name):
    if name.startswith(("a", "e10", "j7")):
        pytest.skip("writes files first")
    assert not re.search(r"Python|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, tiny)))


@pytest.mark.parametrize("name", ["f1_strict_labels", "f2_base_labels", "f4_tier_labels", "c8_contract_gate", "b1_clean_text", "j6_risk_report", "j6_risk_items", "j6_json_report", "e5_contract_clauses"])
def test_generated_code_compiles(spark, tiny, name):
    """No stage falls back to interpretation because its code is too long."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, tiny).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_training_rows_are_labelled_once(spark, tiny):
    """The label that picks the rows is not computed again for those picked, and its stage does not fall back either."""
    rows = model_queries._training(spark, tiny)
    assert plan(rows).count("RLIKE") < 25
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("name", ["j6_json_report", "j6_risk_report"])
def test_reports_label_in_all_tasks(spark, tiny, name, monkeypatch):
    """The given table is one row group, hence one task; the rules run in as many as there are cores."""
    given = []
    stored = model_queries.frames.stored
    monkeypatch.setattr(model_queries.frames, "stored", lambda df, name: given.append(df) or stored(df, name))
    QUERIES[name](spark, tiny)
    assert given[0].rdd.getNumPartitions() >= 8
    assert model_queries._training(spark, tiny).rdd.getNumPartitions() >= 8


def test_rules_run_once_in_the_report(spark, tiny):
    predictions = plan(model_queries._rule_predictions(spark, tiny))
    assert 5 < predictions.count("RLIKE") < 20 and "RLIKE" not in plan(QUERIES["j6_risk_report"](spark, tiny))


@pytest.mark.parametrize("name", ["e3_section_state", "e3_section_lines", "e4_joined_lines"])
def test_ordered_state_is_one_scan(spark, tiny, name):
    """The final plan reads the stored lines, and one row per segment and file beside them; no line is shuffled again."""
    df = QUERIES[name](spark, tiny)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    assert text.count("Scan parquet") == 2 and "Window" in text
    assert not re.search(r"Exchange.*line", text)


def test_columns_are_pruned_at_the_scan(spark, tiny):
    read = re.search(r"ReadSchema: struct<([^>]*)>", QUERIES["c8_contract_gate"](spark, tiny)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )).group(1)
    assert "l_shipdate" not in read and "l_tax" not in read


def test_entry(spark):
    assert entry.entry(spark).count() > 5
