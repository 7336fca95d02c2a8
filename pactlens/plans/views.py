"""Chinese contract tables derived from the driver's tables.

The driver's texts hold no Chinese, so clauses, contract lines, pages and HTTP responses are laid over the rows of
``lineitem`` and ``pages``.  Every fragment below is an expression that both Spark SQL and DuckDB accept; the same text
builds the Spark table and the oracle's common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.operators.frames import spread

CLAUSES = [
    "合同签订后乙方应在三十个工作日内完成全部货物的安装与调试并提交验收申请",
    "本项目尾款待财政拨款到账后由甲方一次性支付给乙方",
    "乙方承担一切税费并在交货后开票，甲方据此办理付款手续",
    "货物到达后甲方逾期未书面提出视为验收合格，乙方不再另行通知",
    "乙方每延误一天每日赔偿合同金额，甲方有权从货款中扣除违约金",
    "甲方可将本合同全部货款汇入个人账户，乙方应予以配合确认",
    "本项目待财政拨款后支付，且乙方承担一切税费并开具发票",
    "全部货款汇入个人账户且乙方承担一切税费并负责开具发票",
    "乙方付款",
    "本条款约定图纸由甲方提供，乙方付款后方可领取全部资料",
    "双方应友好协商并共同推进项目建设工作的顺利开展与落实",
    "________付款________支付________验收",
    "严禁个人账户收款，全部合同价款必须对公支付并开具发票",
    "待财政拨款到账后十个工作日内支付合同剩余款项给乙方",
    "乙方交付验收完成后180日内完成全款支付",
    "今天天气很好，我们一起去公园里散步看风景吧，路上看花",
    "所有直接间接经济损失由乙方承担，违约责任与赔偿责任另行约定，关联交易除外",
]

_PART = "CAST(l_partkey AS STRING)"
_NO = "CAST(l_linenumber AS STRING)"
# One SQL expression per kind of contract line.
LINES = [
    f"'第' || {_PART} || '章 投标人须知'",
    f"'第' || {_PART} || '章 政府采购合同'",
    f"'第' || {_PART} || '节 验收与付款'",
    "'第三章'",
    "'第四部分 投标人须知'",
    f"'第' || {_PART} || '章 合同通用条款'",
    "'政府采购项目 招标文件（第二册）'",
    "''",
    "' 13 '",
    "'12'",
    f"'☑甲方____应在验收后第' || {_PART} || '日付款。。'",
    f"'1.' || {_NO} || '乙方应当在第' || {_PART} || '批货物到达之后支付全部货款'",
    f"'（' || {_NO} || '）甲方逾期支付的金额为' || {_PART} || '.50元的违约金应当另行计算；验收合格后付款'",
    f"'技术参数见附件第' || {_PART} || '项，付款另计'",
    f"'质保金' || {_PART} || '元在质保期满后退还'",
    f"'第 ' || {_NO} || ' 页 共 ' || {_PART} || ' 页'",
    f"'日期2024-05-' || {_PART}",
    f"'  乙方　　承担第' || {_PART} || '批一切税费并在交货后开票且付款；待财政拨款到账后支付货款给乙方单位'",
    f"'金额XX元，逾期XXX日，第' || {_PART} || '号'",
    f"'2.' || {_NO} || '甲方可将本合同全部货款汇入个人账户第' || {_PART} || '号，乙方予以配合；'",
    "'编号' || chr(92) || 'abcdef 付款'",
    "' '",
    "'----'",
    f"'保证金……逾期不予退还，验收　 第' || {_PART} || '号'",
    f"'无关内容第' || {_PART} || '行'",
    f"'待财政拨款后支付第' || {_PART} || '批货款'",
]


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


_CLAUSE_TEXT = (
    _pick("l_orderkey * 7 + l_linenumber", [f"'{c}'" for c in CLAUSES])
    + " || "
    + _pick("l_linenumber", ["''", f"'，第' || {_PART} || '批'", "'，计' || CAST(l_suppkey AS STRING) || '件'"])
)

# Order line numbers repeat, so the price in cents completes the key of a row.
_ROW = "(l_orderkey * 8 + l_linenumber) * 33554432 + CAST(round(l_extendedprice * 100) AS BIGINT)"

# What GBK cannot hold of the lines above; private-use characters do not display and are written as escapes.
_NOT_GBK = "\u2611\uf0b8\uf0b9"

# view -> (table, {column: expression})
PROJECTIONS = {
    "clause_src": ("lineitem", {
        "id": _ROW,
        "file": "'contract_' || CAST(l_suppkey AS STRING) || '.pdf'",
        "text": _CLAUSE_TEXT,
        "source": "CASE WHEN l_orderkey % 10 < 6 THEN 'synthetic' WHEN l_orderkey % 10 < 9 THEN 'bid' ELSE 'court_judge' END",
        "given": "CASE WHEN l_partkey % 9 = 6 THEN 'review' WHEN l_partkey % 9 = 7 THEN 'discard' "
                 "WHEN l_partkey % 9 = 8 THEN NULL ELSE CAST(l_partkey % 9 AS STRING) END",
        "confidence": "CAST(round(l_discount * 12, 2) AS DOUBLE)",
        "y": "CAST(l_orderkey % 6 AS INT)",
        "p": "CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 6 ELSE l_orderkey % 6 END AS INT)",
    }),
    "contract_src": ("lineitem", {
        "file": "CASE WHEN l_suppkey % 20 = 0 THEN '第一册_' ELSE 'contract_' END || CAST(l_suppkey AS STRING) || "
                "CASE l_suppkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' ELSE '.docx' END",
        "page_no": "CAST(l_orderkey AS INT)",
        "n": "CAST(l_linenumber AS INT)",
        "pos": _ROW,
        "line": _pick("l_orderkey * 3 + l_linenumber * 5 + l_partkey", LINES),
    }),
    # Lines of contract files: the supplier decides about name and kind; the one in GBK is without what GBK cannot hold.
    "files_src": ("lineitem", {
        "name": _pick("l_suppkey", [f"'{stem}_' || CAST(l_suppkey AS STRING) || '{suffix}'" for stem, suffix in (
            ("合同", ".docx"), ("文本", ".txt"), ("国标", ".txt"), ("扫描", ".pdf"), ("损坏", ".docx"), ("第一册", ".docx"), ("大写", ".DOCX"), ("表格", ".docx"),
        )]),
        "kind": _pick("l_suppkey", ["'docx'", "'utf-8'", "'gbk'", "'pdf'", "'broken'", "'docx'", "'docx'", "'table'"]),
        "pos": _ROW,
        "line": f"CASE WHEN l_suppkey % 8 = 2 THEN translate({_pick('l_orderkey * 3 + l_linenumber * 5 + l_partkey', LINES)}, '{_NOT_GBK}', '') "
                f"ELSE {_pick('l_orderkey * 3 + l_linenumber * 5 + l_partkey', LINES)} END",
    }),
    "responses_src": ("pages", {
        "pos": "CAST(page_id + 1 AS BIGINT)",
        "url": _pick("page_id", [
            "url",
            "'https://download.ccgp.gov.cn/oss/a%20b/f' || CAST(page_id AS STRING) || '.PDF;v=1?x=1'",
            "'http://60.173.73.4:8076/down/' || CAST(page_id AS STRING) || '?cmd=a.b'",
            "'https://xx.ccgp.gov.cn/v1.2/file' || CAST(page_id AS STRING)",
        ]),
        "content_disposition": _pick("page_id * 3 + 1", [
            "NULL",
            "'attachment; filename=\"f' || CAST(page_id AS STRING) || '.DOC\"'",
            "'attachment; filename*=utf-8' || chr(39) || 'zh_cn' || chr(39) || '%E5%90%88%E5%90%8C.docx'",
            "'attachment; filename*=broken.pdf'",
            "'inline'",
            "'attachment; filename=a+b.tar.gz; size=9'",
            "'attachment; filename=plain'",
        ]),
        "content_type": _pick("page_id * 5 + 2", [
            "NULL", "'application/pdf'", "' Application/MSWord ; charset=utf-8'", "'text/html'", "'application/octet-stream'",
        ]),
        "magic": _pick("page_id", ["'255044462d'", "'504b030414'", "'7b5c727466'", "'d0cf11e0'", "'25'"]),
        "size": "CAST(length(html) AS BIGINT)",
        "error": "CASE WHEN page_id % 6 = 5 THEN 'Timeout: 60 s' ELSE NULL END",
    }),
    # Six logits per vector, and which label is right.
    "logits_src": ("embeddings", {
        "vec_id": "vec_id",
        "y": "CAST(vec_id % 6 AS INT)",
        **{f"x{i}": f"CAST(embedding[{{{i}}}] AS DOUBLE) * 8" for i in range(6)},
    }),
}


def _expressions(name: str, first_index: int) -> dict[str, str]:
    columns = PROJECTIONS[name][1]
    if name != "logits_src":
        return columns
    # Array positions start at 0 in Spark and at 1 in DuckDB.
    return {c: e.format(*[i + first_index for i in range(6)]) for c, e in columns.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, even: bool = False) -> DataFrame:
    """A derived table: one narrow projection over its base table, whose rows are dealt evenly to the tasks first if ``even``."""
    base = table(spark, sf_dir, PROJECTIONS[name][0])
    base = spread(base) if even else base
    return base.select(*[F.expr(e).alias(c) for c, e in _expressions(name, 0).items()])


def clause_projection(lineitem: DataFrame) -> DataFrame:
    """``clause_src`` over any table shaped like lineitem, such as a stream."""
    return lineitem.select(*[F.expr(e).alias(c) for c, e in PROJECTIONS["clause_src"][1].items()])


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, page_no, text, error``: the contract lines of eight neighbouring orders make a page."""
    lines = view(spark, sf_dir, "contract_src").withColumn("page", F.expr("CAST(floor(page_no / 8) AS INT)"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("file", "page").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text")).select(
        "file", F.col("page").alias("page_no"), "text", F.expr("CASE WHEN page % 50 = 7 AND file LIKE '%.DOCX' THEN 'bad page' END").alias("error")
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, y, logits, probability``: softmax of six logits."""
    logits = view(spark, sf_dir, "logits_src")
    xs = [F.col(f"x{i}") for i in range(6)]
    total = sum((F.exp(x) for x in xs[1:]), F.exp(xs[0]))
    return logits.withColumn("total", total).select(
        "vec_id",
        "y",
        F.array(*xs).alias("logits"),
        F.array(*[F.exp(x) / F.col("total") for x in xs]).alias("probability"),
    )


# --- the same views for the oracle ----------------------------------------------------------------------------------


def cte(*names: str) -> str:
    """``WITH`` clause that defines the derived tables for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_oracle_select(n)})" for n in names)


def _oracle_select(name: str) -> str:
    if name == "contract_pages":
        return (
            "SELECT file, page AS page_no, string_agg(line, chr(10) ORDER BY pos) AS text, "
            "CASE WHEN page % 50 = 7 AND file LIKE '%.DOCX' THEN 'bad page' END AS error FROM "
            f"(SELECT *, CAST(floor(page_no / 8) AS INT) AS page FROM ({_oracle_select('contract_src')})) GROUP BY file, page"
        )
    if name == "probabilities":
        total = " + ".join(f"exp(x{i})" for i in range(6))
        ps = ", ".join(f"exp(x{i}) / ({total})" for i in range(6))
        xs = ", ".join(f"x{i}" for i in range(6))
        return f"SELECT vec_id, y, [{xs}] AS logits, [{ps}] AS probability FROM ({_oracle_select('logits_src')})"
    columns = ", ".join(f"{e} AS {c}" for c, e in _expressions(name, 1).items())
    return f"SELECT {columns} FROM {PROJECTIONS[name][0]}"
