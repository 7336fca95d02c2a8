"""Files in, files out, the stream and the model store."""

import json
import random
import zipfile
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pactlens.functions import rules, scores, web
from pactlens.operators import dataset, documents, fetch, forest, metrics, report, weak_labels
from pactlens.plans import jobs
from pactlens.sources import files, samples
from pactlens.streaming import scoring

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def paragraph(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def cell(value, extra=""):
    return f"<w:tc><w:tcPr>{extra}</w:tcPr>{paragraph(value)}</w:tc>"


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls"
    path.write_text("  http://a/x \n\n　http://b/\t\r\nhttp://a/x\n", encoding="utf-8")
    got = files.read_url_list(spark, str(path)).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, "http://a/x"), (2, "http://b/"), (3, "http://a/x")]


def test_contract_folder_and_docx(spark, tmp_path):
    table = (
        "<w:tbl><w:tr>" + cell("货物") + cell("") + cell(" 价款 ") + "</w:tr><w:tr>"
        + cell("合计", '<w:gridSpan w:val="2"/>') + cell("1") + "</w:tr></w:tbl>"
    )
    docx(tmp_path / "a.docx", paragraph(" 第一", "条 ") + paragraph("  ") + table + paragraph("☑付款。。"))
    docx(tmp_path / "empty.docx", paragraph(" "))
    docx(tmp_path / "第一册.docx", paragraph("跳过"))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "UPPER.PDF").write_bytes(b"%PDF")
    (tmp_path / "sub").mkdir()
    docx(tmp_path / "sub" / "b.docx", paragraph("深"))
    found = files.list_contracts(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.select("file").collect()) == ["a.docx", "broken.docx", "empty.docx"]
    parts = files.docx_parts(found)
    rows = {(r.file.rsplit("/", 1)[1], r.pos): (r.kind, r.text) for r in parts.collect()}
    assert rows == {
        ("a.docx", 0): ("paragraph", " 第一条 "),
        ("a.docx", 1): ("paragraph", "☑付款。。"),
        ("a.docx", 2): ("table", "货物\t价款"),
        ("a.docx", 3): ("table", "合计\t合计\t1"),
        ("broken.docx", 0): ("error", None),
        ("empty.docx", 0): ("error", None),
    }
    assert parts.filter(F.col("error").isNotNull()).count() == 2
    lines = files.docx_lines(parts).orderBy("pos").collect()
    assert [r.line for r in lines] == ["第一条", "付款。"]
    assert [r.text for r in files.parsed_text(parts).orderBy("pos").collect()] == ["第一条", "☑付款。。", "货物\t价款", "合计\t合计\t1"]


def test_docx_quirks(spark, tmp_path):
    """Blanks count before cleaning, breaks of pages are no text, and a damaged table costs its own rest only."""
    marks = '<w:p><w:r><w:t>甲</w:t><w:br w:type="page"/><w:t>乙</w:t><w:br/><w:t>丙</w:t><w:noBreakHyphen/><w:tab/><w:t>丁</w:t></w:r></w:p>'
    good, bad = f"<w:tr>{cell('前')}</w:tr>", f"<w:tr>{cell('坏', '<w:gridSpan w:val=\"x\"/>')}</w:tr>"
    body = paragraph(" 13 ") + paragraph("13") + marks + f"<w:tbl>{good}{bad}{good}</w:tbl><w:tbl>{good}</w:tbl>"
    docx(tmp_path / "a.docx", body)
    (tmp_path / "b.TXT").write_bytes("付款\r\n 验收".encode("gbk"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    parts = files.decoded_files(files.list_files(spark, str(tmp_path), "*"))
    named = {r.file.rsplit("/", 1)[1]: [] for r in parts.collect()}
    for r in parts.orderBy("file", "pos").collect():
        named[r.file.rsplit("/", 1)[1]].append((r.kind, r.text, r.error))
    assert named["a.docx"] == [("paragraph", " 13 ", None), ("paragraph", "13", None), ("paragraph", "甲乙\n丙-\t丁", None), ("table", "前", None), ("table", "前", None)]
    assert named["b.TXT"] == [("text", "付款\n 验收", None)] and named["c.pdf"] == [("error", None, "no decoder for .pdf")]
    assert [r.error for r in files.failed_files(parts).collect()] == ["no decoder for .pdf"]
    lines = [(r.file[-5:], r.pos, r.line) for r in files.file_lines(parts).orderBy("file", "pos").collect()]
    assert lines == [(".docx", 0, "13"), (".docx", 2 << 32, "甲乙"), (".docx", (2 << 32) + 1, "丙- 丁"), ("b.TXT", 0, "付款"), ("b.TXT", 1, "验收")]


def test_positions_over_several_lists(spark, tmp_path):
    for name, value in (("a.txt", "u1\n\nu2\n"), ("b.txt", ""), ("c.txt", "u3\r\nu1"), ("d.txt", " \nu4\n")):
        (tmp_path / name).write_bytes(value.encode())
    got = files.read_url_list(spark, f"{tmp_path}/*.txt").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, "u1"), (2, "u2"), (3, "u3"), (4, "u1"), (5, "u4")]


def test_txt_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("付款\r\n验收".encode())
    (tmp_path / "g.txt").write_bytes("合同验收".encode("gbk"))
    (tmp_path / "both.txt").write_bytes(bytes.fromhex("CEA5D4BC"))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xff\xff")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    got = {
        r.path.rsplit("/", 1)[1]: tuple(r.d)
        for r in raw.select("path", files.decode_txt(F.col("content")).alias("d")).collect()
    }
    assert got["u.txt"] == ("付款\n验收", "utf-8", None)
    assert got["g.txt"] == ("合同验收", "gbk", None)
    assert got["both.txt"][1] == "utf-8"
    assert got["bad.txt"] == (None, None, "unknown encoding")


def test_sample_files(spark, tmp_path):
    (tmp_path / "bid_contract_samples.jsonl").write_text(
        '{"text": "甲", "label": "1", "confidence": 0.5, "source": "x"}\n\n  \n{"text": "乙", "label": null}\n', encoding="utf-8"
    )
    (tmp_path / "syn_processed.jsonl").write_text('{"text": "丙", "label": 3}\n', encoding="utf-8")
    got = samples.read_sources(spark, str(tmp_path))
    assert sorted((r.text, r.label, r.confidence, r.source) for r in got.collect()) == [
        ("丙", "3", 0.75, "synthetic"), ("乙", None, 0.75, "bid"), ("甲", "1", 0.5, "bid"),
    ]
    for bad in ('{"text": "甲", ', '{"label": "1"}'):
        (tmp_path / "cj_processed.jsonl").write_text(bad + "\n", encoding="utf-8")
        with pytest.raises((PySparkException, Py4JJavaError)):
            samples.read_sources(spark, str(tmp_path)).collect()
    assert samples.read_sources(spark, str(tmp_path / "none")).count() == 0


def test_large_csv_is_read_in_many_tasks(spark, tmp_path):
    """Quoted texts of many lines; splits fall anywhere, also inside quotes."""
    r = random.Random(4)
    pieces = ["甲方", "\n", '"', ",", "乙方\r\n", " ", "付款", "\n\n", '""', "id,text\n"]
    rows = [(i, "x" + "".join(r.choice(pieces) for _ in range(r.choice([1, 3, 60]))) + "x", str(i % 6), "bid", i / 7) for i in range(900)]
    frame = spark.createDataFrame(rows, "id BIGINT, text STRING, label STRING, source STRING, confidence DOUBLE")
    path = str(tmp_path / "d")
    samples.write_dataset(frame.coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        for bits in (16, 4):
            assert sorted(map(tuple, samples.read_large_dataset(spark, path, bits).collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_large_csv_is_not_shuffled(spark, tmp_path):
    """Only what lies across two splits goes through an exchange, not the records inside one."""
    rows = [(i, f"{'x' * 300}\n{i}", "1", "bid", 0.5) for i in range(3000)]
    samples.write_dataset(spark.createDataFrame(rows, "id BIGINT, text STRING, label STRING, source STRING, confidence DOUBLE").coalesce(1), str(tmp_path / "d"))
    found = samples.read_large_dataset(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, found.collect())) == rows

    def heaviest(node) -> int:
        shuffles = [node.metrics().get("dataSize").get().value()] if node.nodeName() == "Exchange" else []
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        return max([*shuffles, *map(heaviest, below)], default=0)

    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    assert 0 < heaviest(plan) < 100_000  # of 900,000 characters


def test_weak_labels_go_to_three_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, "个人账户违约金"), (2, "验收标准"), (3, "无"), (4, None)], "id INT, text STRING")
    labelled = weak_labels.weak_labels(texts)
    assert weak_labels.write_weak_labels(labelled, str(tmp_path)) == {"accept": 1, "review": 1, "drop": 2}
    assert sorted(p.name for p in tmp_path.glob("route=*")) == ["route=accept", "route=drop", "route=review"]
    got = {(r.id, r.route, r.label, r.source) for r in weak_labels.read_weak_labels(labelled, str(tmp_path)).collect()}
    assert got == {(1, "accept", 5, "weak"), (2, "review", 3, "weak"), (3, "drop", 0, "weak"), (4, "drop", 0, "weak")}


def test_json_report_is_json(spark, tmp_path):
    rows = [("a", 3, 1, '付款"x"'), ("a", 9, 0, "无"), ("a", 12, 5, "账户\n"), ("a", 20, 1, "付款"), ("b", 1, 0, "无"), ("b", 2, -1, "外")]
    named = spark.createDataFrame(rows, "file STRING, clause_no BIGINT, risk_label_id INT, text STRING")
    label = F.col("risk_label_id")
    named = named.withColumns({"risk_type": scores.risk_type(label), "risk_level": scores.risk_level(label), "confidence": F.lit(0.5)})
    lines = report.json_report_lines(named)
    report.write_report(lines.filter("file = 'a'"), str(tmp_path / "a"))
    parts = sorted((tmp_path / "a").glob("part-*"))
    a = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert (a["file"], a["total"], a["rejected"], a["risks"]["count"], sorted(a["risks"])) == ("a", 4, 0, 3, ["12", "20", "3", "count"])
    assert a["risks"]["3"] == {"text": '付款"x"', "risk_type": a["distribution"]["1"]["name"], "risk_level": "高风险", "confidence": 0.5, "explanation": None}
    assert a["distribution"]["1"]["share"] == "50.0%" and a["warnings"]["count"] == 3 and a["advice"]["5"]["advice"] == report.ADVICE[5]
    b = json.loads("".join(r.line for r in lines.filter("file = 'b'").orderBy("section", "place").collect()))
    assert b["risks"] == {"count": 0} and b["total"] == 1 and b["rejected"] == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, '带"引号",逗号\n换行', "1", "bid", 0.5), (2, "", None, "synthetic", 1.0)]
    frame = spark.createDataFrame(rows, "id BIGINT, text STRING, label STRING, source STRING, confidence DOUBLE")
    path = str(tmp_path / "d")
    samples.write_dataset(frame.select(*reversed(frame.columns)), path)
    rows[1] = (2, None, *rows[1][2:])  # CSV cannot tell an empty text from null
    assert sorted(map(tuple, samples.read_dataset(spark, path).collect())) == rows
    assert samples.training_rows(frame).columns == ["text", "label"]


def test_jsonl_keeps_null_labels_and_characters(spark, tmp_path):
    samples.write_samples(spark.createDataFrame([("甲方", None)], "text STRING, label STRING"), str(tmp_path / "s"))
    line = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "s").glob("part-*")).strip()
    assert json.loads(line) == {"text": "甲方", "label": None} and "甲方" in line


def test_metrics_file(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y INT, p INT")
    samples.write_metrics(metrics.metrics_document(pairs), str(tmp_path / "m"))
    got = json.loads(next((tmp_path / "m").glob("part-*")).read_text(encoding="utf-8"))
    assert set(got) == {"macro_f1", "accuracy", "macro_avg", "per_class"} and set(got["per_class"]) == {"0", "1"}
    assert got["per_class"]["1"]["recall"] == 0.5


RESPONSES = [
    # url, content_disposition, content_type, head, extension
    ("http://a/x", 'attachment; filename="r.PDF"', "text/html", b"", ".pdf"),
    ("http://a/x", "attachment; filename*=utf-8''%E5%90%88.doc", None, b"", ".doc"),
    ("http://a/x.zip", "attachment; filename*=nothing.pdf", "application/msword; q=1", b"", ".doc"),
    ("http://a/x", "attachment; filename=a+b%2.tar.GZ; size=3", None, b"", ".gz; size=3"),
    ("http://a.b/v1.2/file?x=.doc", None, "text/html", b"", ".2/file"),
    ("http://a/d%2Exlsx;v=1.0", None, None, b"", ".xlsx"),
    ("http://a.b/x", None, None, b"%PDF-1", ".pdf"),
    ("http://a.b/x", None, None, b"PK\x03\x04", ".docx"),
    ("http://a.b/x", None, None, b"{\\rtf1", ".rtf"),
    ("http://a.b/x", "inline", None, b"%P", ".bin"),
]


def responses(spark):
    rows = [(i + 996, *r[:4], 7, None) for i, r in enumerate(RESPONSES)] + [(5, "http://z/", None, None, None, None, "Timeout")]
    return spark.createDataFrame(
        rows, "pos BIGINT, url STRING, content_disposition STRING, content_type STRING, head BINARY, size BIGINT, error STRING"
    )


def test_file_names_of_responses(spark, tmp_path):
    records = fetch.name_responses(responses(spark), "raw/").orderBy("pos").collect()
    assert (records[0].ok, records[0].file_name, records[0].local_path, records[0].size) == (False, "", "", None)
    assert [r.file_name for r in records[1:]] == [f"{i + 996}{r[4]}" for i, r in enumerate(RESPONSES)]
    assert records[1].local_path == "raw/996.pdf"
    table = fetch.name_responses(responses(spark), "raw")
    assert tuple(fetch.fetch_summary(table).first()) == (10, 1, 11)
    assert fetch.write_failed(table, str(tmp_path / "f")) and spark.read.json(str(tmp_path / "f")).count() == 1
    assert not fetch.write_failed(table.filter("ok"), str(tmp_path / "g")) and not Path(tmp_path / "g").exists()


def test_referers(spark):
    urls = ["http://download.ccgp.gov.cn/a", "https://x.ccgp.gov.cn:80/", "http://60.173.73.4:8076/a?b", "http://ccgp.gov.cn.evil/"]
    got = spark.createDataFrame([(u,) for u in urls], "url STRING").select(web.referer(F.col("url")).alias("r")).collect()
    assert [r.r for r in got] == ["https://download.ccgp.gov.cn/", "https://www.ccgp.gov.cn/", "http://60.173.73.4/", None]


def test_position_names(spark):
    got = spark.createDataFrame([(7,), (1000,)], "p BIGINT").select(web.numbered_name(F.col("p"), F.lit(".x")).alias("n"))
    assert [r.n for r in got.collect()] == ["007.x", "1000.x"]


CLAUSES = ["待财政拨款后支付合同货款给乙方单位", "全部货款汇入个人账户乙方应予以配合", "双方按照合同约定履行付款与交货义务"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(f"{CLAUSES[i % 3]}第{i}批", (1, 5, 0)[i % 3]) for i in range(90)]
    return forest.train(spark.createDataFrame(rows, "text STRING, label INT"), trees=10, depth=5)


def test_scoring_and_model_store(spark, tmp_path, model):
    forest.save_model(model, str(tmp_path / "m"))
    loaded = forest.load_model(str(tmp_path / "m"))
    asked = spark.createDataFrame([(0, CLAUSES[0]), (1, CLAUSES[1]), (2, "今天天气很好啊"), (3, "乙方付款")], "id INT, text STRING")
    rows = [r.asDict() for r in forest.score_clauses(asked, loaded).orderBy("id").collect()]
    assert rows == [r.asDict() for r in forest.score_clauses(asked, model).orderBy("id").collect()]
    assert [r["risk_label_id"] for r in rows] == [1, 5, -1, -1]
    assert [r["rejected"] for r in rows] == [False, False, True, True]
    assert rows[2]["confidence_array"] == [] and rows[2]["confidence"] == 0.0 and rows[2]["message"]
    assert rows[0]["risk_type"] == "payment_risk" and rows[0]["risk_level"] == "高风险" and rows[0]["message"] is None
    assert abs(sum(rows[0]["confidence_array"]) - 1) < 1e-9
    assert abs(rows[0]["confidence"] - rows[0]["confidence_array"][1]) <= 1e-4


def test_file_scoring_and_report(spark, tmp_path, model):
    pages = spark.createDataFrame(
        [("a.pdf", 1, f"{CLAUSES[0]}。{CLAUSES[1]}\n☑短", None), ("a.pdf", 2, f"{CLAUSES[2]}；今天天气真的很好啊", None)],
        "file STRING, page_no INT, text STRING, error STRING",
    )
    scored = forest.score_files(pages, model)
    assert sorted(r.risk_label_id for r in scored.collect()) == [-1, 0, 1, 5]
    lines = report.report_lines(scored.withColumnRenamed("clause", "text"), "file", "pos")
    got = [(r.section, r.line) for r in lines.orderBy("section", "place", "line").collect()]
    assert got[0] == (1, "# a.pdf 条款数 3") and [s for s, _ in got] == [1, 2, 2, 3, 3, 3, 4, 4, 5, 5]
    assert (3, "- payment_risk 1 33.3%") in got
    report.write_report(lines, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 10


def test_the_forest_is_fitted_on_stored_vectors(spark, monkeypatch):
    given = []
    fit = forest.RandomForestClassifier.fit
    monkeypatch.setattr(forest.RandomForestClassifier, "fit", lambda self, df: given.append(df) or fit(self, df))
    rows = [(f"{CLAUSES[i % 3]}第{i}批", (1, 5, 0)[i % 3]) for i in range(40)]
    forest.train(spark.createDataFrame(rows, "text STRING, label INT"), trees=2, depth=2)
    assert len(given) == 1 and given[0].count() == 40
    assert "UDF" not in given[0]._jdf.queryExecution().executedPlan().toString()


def test_cross_validation(spark):
    rows = spark.createDataFrame([(i, f"{CLAUSES[i % 3]}第{i}批", (1, 5, 0)[i % 3]) for i in range(60)], "id INT, text STRING, label INT")
    got = forest.cross_validate(rows, "id", k=2, trees=5, depth=4).collect()
    assert [r.fold for r in got] == [0, 1] and all(r.macro_f1 > 0.9 for r in got)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"id": i, "text": CLAUSES[i % 3] + "，另行约定" * (i % 4)} for i in range(30)]
    for part in range(3):
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part::3]), encoding="utf-8")

    def label(df):
        return df.select("id", rules.strict_label(F.col("text")).alias("label"))

    schema = "id BIGINT, text STRING"
    for _ in range(2):  # the second run finds nothing new and writes nothing twice
        query = scoring.start_scoring(
            scoring.clause_stream(spark, str(folder), schema), label, str(tmp_path / "out"), str(tmp_path / "check")
        )
        query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = label(spark.read.schema(schema).json(str(folder)))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_splits_are_written_apart(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("label"))
    samples.write_splits(dataset.split(rows, {"train": 0.8, "val": 0.1, "test": 0.1}), str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("split=*")} == {"split=train", "split=val", "split=test"}


def test_docx_lines_feed_the_document_operators(spark, tmp_path):
    docx(tmp_path / "c.docx", paragraph("第二章 政府采购合同") + paragraph("1.1待财政拨款后支付合同剩余货款给乙方单位1.2验收"))
    lines = files.docx_lines(files.docx_parts(files.list_contracts(spark, str(tmp_path))))
    got = documents.contract_samples(lines).collect()
    assert [(r.text, r.label, r.source) for r in got] == [("待财政拨款后支付合同剩余货款给乙方单位", "1", "gov_bid_file")]


def test_jobs_from_contract_folder_to_report(spark, tmp_path):
    contracts, processed = tmp_path / "contracts", tmp_path / "processed"
    contracts.mkdir()
    processed.mkdir()
    for i in range(3):
        numbered = "".join(paragraph(f"1.{k}{CLAUSES[k % 3]}第{k}批{i}") for k in range(12))
        docx(contracts / f"c{i}.docx", numbered)
    (contracts / "bad.docx").write_bytes(b"?")
    jobs.parse_folder(spark, str(contracts), str(processed / "bid_contract_samples.jsonl"))
    labels = [r.label for r in spark.read.json(str(processed / "bid_contract_samples.jsonl")).collect()]
    assert set(labels) == {"0", "1", "5"}
    more = [{"text": f"{CLAUSES[i % 3]}另{i}", "label": ("1", "5", "review")[i % 3]} for i in range(60)]
    (processed / "syn_processed.jsonl").write_text("\n".join(json.dumps(r) for r in more), encoding="utf-8")
    stats = {(r.kind, r.name): r.n for r in jobs.merge_sources(spark, str(processed), str(tmp_path / "data")).collect()}
    assert stats["total", None] == len(labels) + 60 and stats["source", "synthetic"] == 60 and stats["label", "review"] == 20
    jobs.train_baseline(spark, str(tmp_path / "data"), str(tmp_path / "model"), str(tmp_path / "metrics"), trees=10, depth=5)
    assert spark.read.json(str(tmp_path / "metrics")).first().accuracy > 0.8
    pages = spark.createDataFrame(
        [("a.pdf", 1, "。".join(CLAUSES), None)], "file STRING, page_no INT, text STRING, error STRING"
    )
    jobs.report_files(pages, str(tmp_path / "model"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first().total == 3
    assert spark.read.text(str(tmp_path / "report" / "text")).filter("value like '# a.pdf%'").count() == 1
    jobs.parse_pages(pages, str(tmp_path / "parsed"))
    assert spark.read.schema("text STRING, label STRING").json(str(tmp_path / "parsed")).count() == 1


def test_text_files_are_read_by_lines(spark, tmp_path):
    """Lines of files in either encoding, none of them read as one value."""
    texts = {
        "a.txt": "甲方\r\n乙\r方\n\n付款\n".encode(),
        "b.txt": "甲方付款\r\n\r\r\n验收".encode("gbk"),
        "c.txt": "\ufeff甲\n乙".encode(),
        "d.txt": b"ok\n\xff\xff\xff\n",
        "e.txt": b"\n",
        "f.txt": b"",
        "g.txt": b"\xef\xbb\xbf" + "甲乙\n".encode() + "丙丁戊\n".encode("gbk"),
    }
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    found = files.text_lines(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    expected = []
    for name, content in texts.items():
        text, encoding, error = files._decode_text(content)
        if not error:
            expected += [(name, encoding, line) for line in (text.removesuffix("\n").split("\n") if text else [])]
    assert sorted((r.file.rsplit("/", 1)[-1], r.encoding, r.line) for r in found.collect()) == sorted(expected)


def test_contract_files_are_written_from_sorted_lines(spark, tiny, monkeypatch):
    """No row holds the lines of a file, so a batch for Python is as small as its lines."""
    DataFrame = type(spark.range(1))
    from pactlens.plans import fixtures

    view = fixtures.view
    seen = []
    monkeypatch.setattr(fixtures, "view", lambda *a: seen.append(view(*a)) or seen[0])
    plans = []
    inner = DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda df, *a, **k: plans.append(df.schema.simpleString()) or inner(df, *a, **k))
    folder = fixtures.write_contract_files(spark, tiny)
    assert plans == ["struct<name:string,kind:string,line:string>"]
    names = {r.name for r in seen[0].select("name").distinct().collect()}
    assert {p.rsplit("/", 1)[-1] for p in map(str, Path(folder.removeprefix("file:")).iterdir())} == names
