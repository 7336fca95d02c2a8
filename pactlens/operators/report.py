"""Per-contract risk summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import scores

# Our own wording, one line per label.
ADVICE = {
    0: "无需处理",
    1: "明确付款时点与期限",
    2: "明确开票时间、发票类型与税费承担",
    3: "明确验收标准、期限与异议方式",
    4: "使双方违约责任对等",
    5: "仅以对公账户结算",
}


def label_distribution(predictions: DataFrame, contract: str) -> DataFrame:
    """``contract, risk_label_id, n``: partial counts per task, so a contract of any size is a handful of rows."""
    return predictions.groupBy(contract, "risk_label_id").agg(F.count("*").alias("n"))


def summarize_risks(predictions: DataFrame, contract: str = "file") -> DataFrame:
    """``contract, total, risk_distribution MAP, high_risk_count, rejected``.

    Contract only in the reference; our rule: rejected rows are counted apart and enter neither total nor map.
    """
    label, n = F.col("risk_label_id"), F.col("n")
    accepted = label >= 0
    entries = F.sort_array(F.collect_list(F.when(accepted, F.struct("risk_label_id", "n"))))
    return label_distribution(predictions, contract).groupBy(contract).agg(
        F.sum(F.when(accepted, n).otherwise(0)).alias("total"),
        F.map_from_entries(entries).alias("risk_distribution"),
        F.sum(F.when(label.isin(*vocab.HIGH_RISK_LABELS), n).otherwise(0)).alias("high_risk_count"),
        F.sum(F.when(~accepted, n).otherwise(0)).alias("rejected"),
    )


def risk_items(predictions: DataFrame, contract: str, position: str) -> DataFrame:
    """The clauses at risk, one row each, with an empty explanation (no text generator here)."""
    return predictions.filter(F.col("risk_label_id") > 0).select(
        contract,
        position,
        "text",
        "risk_type",
        "risk_level",
        "confidence",
        F.col("risk_label_id").isin(*vocab.HIGH_RISK_LABELS).alias("warning"),
        F.lit(None).cast("string").alias("explanation"),
    )


def report_lines(predictions: DataFrame, contract: str = "file", position: str = "clause_no") -> DataFrame:
    """Markdown report as rows ``contract, section, place, line``.

    Contract only in the reference.  Sections: 1 basics, 2 clauses at risk, 3 distribution with shares, 4 high-risk
    warnings, 5 advice.  A report stays rows: nothing gathers a contract into one value.  ``write_report`` sorts them.
    """
    label = F.col("risk_label_id")
    item = F.concat_ws(" ", F.lit("-"), F.col("risk_level"), F.col("risk_type"), F.col("text"))
    # A clause at risk is listed once, and once more as a warning when its label is high-risk.
    sections = F.when(label.isin(*vocab.HIGH_RISK_LABELS), F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(2)))
    clauses = predictions.filter(label > 0).select(
        contract,
        F.explode(sections).alias("section"),
        F.col(position).cast("bigint").alias("place"),
        item.alias("line"),
    )
    return summary_lines(predictions, contract).unionByName(clauses)


def summary_lines(predictions: DataFrame, contract: str) -> DataFrame:
    """Sections 1, 3 and 5: opened from one array of at most six label counts per contract."""
    counted = summarize_risks(predictions, contract).select(
        contract, "total", F.map_entries("risk_distribution").alias("counts")
    )
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])

    def line(section: int, place: Column, *words: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), place.cast("bigint").alias("place"), F.concat_ws(" ", *words).alias("line")
        )

    title = line(1, F.lit(0), F.lit("#"), F.col(contract).cast("string"), F.lit("条款数"), F.col("total").cast("string"))

    def share(e: Column) -> Column:
        return line(3, e["key"], F.lit("-"), scores.risk_type(e["key"]), e["value"].cast("string"), _share(e["value"]))

    def advise(e: Column) -> Column:
        return line(5, e["key"], F.lit("-"), scores.risk_type(e["key"]), F.element_at(advice, e["key"]))

    at_risk = F.filter("counts", lambda e: e["key"] > 0)
    lines = F.concat(F.array(title), F.transform("counts", share), F.transform(at_risk, advise))
    return counted.select(contract, F.inline(lines))


def json_report_lines(predictions: DataFrame, contract: str = "file", position: str = "clause_no") -> DataFrame:
    """The report as JSON in rows ``contract, section, place, line``: a contract's lines in order are one JSON object.

    Its members are the file and its totals, then ``risks`` and ``warnings`` by clause number, ``distribution`` and
    ``advice`` by label, each opened by a count.  Every line but an opening one begins with a comma, so no line needs to know
    its neighbours and a report stays rows.
    """
    label, place = F.col("risk_label_id"), F.col(position).cast("bigint")
    high = label.isin(*vocab.HIGH_RISK_LABELS)
    risk = F.struct("text", "risk_type", "risk_level", "confidence", F.lit(None).cast("string").alias("explanation"))
    listed = F.struct(F.lit(2).alias("section"), _member(place, risk).alias("line"))
    warned = F.struct(F.lit(4).alias("section"), _member(place, F.struct("text", "risk_type")).alias("line"))
    entries = F.when(high, F.array(listed, warned)).otherwise(F.array(listed))
    items = predictions.filter(label > 0).select(contract, place.alias("place"), F.inline(entries)).select(contract, "section", "place", "line")

    summary = summarize_risks(predictions, contract).select(contract, "total", "rejected", "high_risk_count", F.map_entries("risk_distribution").alias("counts"))
    at_risk = F.filter("counts", lambda e: e["key"] > 0)
    n_at_risk = F.aggregate(at_risk, F.lit(0).cast("bigint"), lambda n, e: n + e["value"])
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    head = F.to_json(F.struct(F.col(contract).alias("file"), "total", "rejected"))

    def row(section: int, place: Column, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), place.cast("bigint").alias("place"), line.alias("line"))

    def opening(section: int, name: str, n: Column, first: bool = False) -> Column:
        before = F.lit("" if first else "}")
        return row(section, F.lit(-1), F.concat(before, F.lit(f',"{name}":{{"count":'), n.cast("string")))

    shares = F.transform("counts", lambda e: row(3, e["key"], _member(e["key"], F.struct(scores.risk_type(e["key"]).alias("name"), e["value"].alias("n"), _share(e["value"]).alias("share")))))
    advised = F.transform(at_risk, lambda e: row(5, e["key"], _member(e["key"], F.struct(scores.risk_type(e["key"]).alias("name"), F.element_at(advice, e["key"]).alias("advice")))))
    single = F.array(
        row(1, F.lit(0), F.substring(head, F.lit(1), F.length(head) - 1)),
        opening(2, "risks", n_at_risk, first=True),
        opening(3, "distribution", F.size("counts")),
        opening(4, "warnings", F.col("high_risk_count")),
        opening(5, "advice", F.size(at_risk)),
        row(6, F.lit(0), F.lit("}}")),
    )
    return summary.select(contract, F.inline(F.concat(single, shares, advised))).unionByName(items)


def _member(key: Column, value: Column) -> Column:
    return F.concat(F.lit(',"'), key.cast("string"), F.lit('":'), F.to_json(value, {"ignoreNullFields": "false"}))


def _share(n: Column) -> Column:
    """Floor of the share in tenths of a percent: whole numbers only, so every engine prints the same digits."""
    tenths = F.floor(n * 1000 / F.col("total"))
    return F.concat_ws("", F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def write_report(lines: DataFrame, path: str, contract: str = "file") -> None:
    """Text files in which the lines of a contract stand in report order, Markdown or JSON.

    Range partitioning over (contract, section, place) lets one contract span files.
    """
    ordered = lines.repartitionByRange(contract, "section", "place").sortWithinPartitions(contract, "section", "place")
    ordered.select("line").write.mode("overwrite").text(path)
