"""Cleaning, predicates, tokens, clauses: fixed cases and random strings."""

import random

import pytest
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import rules, text, tokens
from pactlens.operators import documents, features

CLEANED = [
    ("☑甲方____应付款。。\n第 1 页 共 3 页\n12\n 13 \n日期2024-05-01\n\n金额XX元", "甲方应付款。\n13\n日期202401\n金额元"),
    ("----\n甲　　乙", "----\n甲　乙"),
    ("a\\bcdef 付款\n\n\n下一行", "a\n下一行"),
    ("12\r\n验收  合格", "12\n验收 合格"),
    ("\x1c 付\x85款  \n\xa0\n", "付\x85款"),
    ("正文", "正文"),
    (None, ""),
    ("", ""),
]
# number, text, strict label, base label
LABELLED = [
    (1, "合同签订后乙方应在三十个工作日内完成全部货物的安装与调试并提交验收申请", "0", "0"),
    (2, "本项目尾款待财政拨款到账后由甲方一次性支付给乙方", "1", "1"),
    (3, "乙方承担一切税费并在交货后开票，甲方据此办理付款手续", "2", "0"),
    (4, "货物到达后甲方逾期未书面提出视为验收合格，乙方不再另行通知", "3", "3"),
    (5, "乙方每延误一天每日赔偿合同金额，甲方有权从货款中扣除违约金", "4", "0"),
    (6, "甲方可将本合同全部货款汇入个人账户，乙方应予以配合确认", "5", "5"),
    (7, "本项目待财政拨款后支付，且乙方承担一切税费并开具发票", "review", "1"),
    (8, "全部货款汇入个人账户且乙方承担一切税费并负责开具发票", "5", "5"),
    (9, "乙方付款", "discard", "discard"),
    (10, "本条款约定图纸由甲方提供，乙方付款后方可领取全部资料", "discard", "discard"),
    (11, "双方应友好协商并共同推进项目建设工作的顺利开展与落实", "0", None),
    (12, "________付款________支付________验收", "discard", "discard"),
    (13, "严禁个人账户收款，全部合同价款必须对公支付并开具发票", "0", "5"),
    (14, "待财政拨款到账后十个工作日内支付合同剩余款项给乙方", "0", "1"),
    (15, "乙方交付验收完成后180日内完成全款支付", "0", "0"),
]
HEADINGS = [
    "页眉", "第一章 投标人须知", "页眉", "投标保证金须付款", "第二章 政府采购合同", "乙方付款", "图纸与验收", "乙方付款", "第三章", "验收条款",
    "第四部分 投标人须知", "第五节 验收与付款", "质保金退还", "第六章 合同通用条款", "逾期违约金",
]


def one(spark, values, expression, name="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")
    return [r.o for r in df.select("i", expression(F.col(name)).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    assert one(spark, [a for a, _ in CLEANED], text.clean_text) == [b for _, b in CLEANED]


def test_clean_text_equals_line_by_line_form(spark):
    """The whole-text patterns against split / transform / filter / join over lines."""
    rng = random.Random(1)
    alphabet = "甲付第页共0123456789-- \t\r\n\n\n　\xa0。。，XX__…\\a\x1c"
    raw = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]

    def by_line(c):
        whole = text.collapse_repeats(text.drop_placeholders(text.drop_noise_symbols(c)))
        squeezed = F.transform(
            F.split(whole, "\n"),
            lambda x: text.strip(F.regexp_replace(text.drop_page_marks(x), "[ \t\r\f\x0b]+", " ")),
        )
        noise = f"\\A[{text.SPACE}{vocab.PRIVATE_USE}]{{1,4}}\\z"
        return F.array_join(F.filter(squeezed, lambda x: (x != "") & ~x.rlike(noise)), "\n")

    assert one(spark, raw, text.clean_text) == one(spark, raw, by_line)


def test_labels(spark):
    texts = [r[1] for r in LABELLED]
    assert one(spark, texts, rules.strict_label) == [r[2] for r in LABELLED]
    assert one(spark, texts, rules.base_label) == [r[3] for r in LABELLED]


def test_labels_against_phrase_by_phrase_form(spark):
    """The factored patterns against plain substring tests, on texts glued from the phrases."""
    rng = random.Random(2)
    pieces = [p for pack in (vocab.STRICT_POSITIVE, vocab.STRICT_NEGATIVE, vocab.BASE_POSITIVE) for ps in pack.values() for p in ps]
    pieces += vocab.STRICT_BUSINESS + vocab.STRICT_SECTIONS + ["甲", "乙方应", "，", "XX", "___"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(4000)]

    def expected(value, pack, inside):
        if not inside:
            return None
        hits = [
            k for k in pack.positive
            if any(p in value for p in pack.positive[k]) and not any(p in value for p in pack.negative[k])
        ]
        return "5" if 5 in hits else "review" if len(hits) > 1 else str(hits[0]) if hits else "0"

    for pack, label in ((rules.STRICT, rules.strict_label), (rules.BASE, rules.base_label)):
        got = one(spark, texts, label)
        in_scope = [g not in (None, "discard") for g in got]
        assert any(in_scope) and not all(in_scope)
        assert [g for g, ok in zip(got, in_scope) if ok] == [
            expected(t, pack, True) for t, ok in zip(texts, in_scope) if ok
        ]


def test_keyword_pattern_finds_what_substring_tests_find(spark):
    for words in (vocab.CONTRACT_WORDS, vocab.PARAGRAPH_KEEP, vocab.STRICT_POSITIVE[4], ["a.b", "a.", "(x"]):
        rng = random.Random(3)
        chars = sorted({c for w in words for c in w}) + ["z"]
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 12))) for _ in range(500)] + list(words)
        assert one(spark, texts, lambda c: text.contains_any(c, words)) == [any(w in t for w in words) for t in texts]


@pytest.mark.parametrize("value, accepted", [("乙方付款", False), ("乙方应付款", True), ("今天天气很好啊", False)])
def test_gate(spark, value, accepted):
    assert one(spark, [value], rules.is_contract_clause) == [accepted]


def test_tiers_and_routes(spark):
    got = one(spark, ["无", "验收标准", "账期顺延验收", "个人账户违约金"], rules.tier_label)
    assert [(g.label, g.confidence, g.matched_rules) for g in got] == [
        (0, 0.5, []), (3, 0.7, ["验收", "验收标准"]), (1, 0.9, ["账期", "顺延"]), (5, 0.9, ["个人账户"]),
    ]
    assert one(spark, ["0.85", "0.6", "0.5999"], lambda c: rules.route(c.cast("double"))) == ["accept", "review", "drop"]


def test_file_names(spark):
    assert one(spark, [' a/b:c*?"<>|\t.pdf ', "//"], text.clean_filename) == ["abc.pdf", "unnamed"]
    assert one(spark, ["x/第一册/a.pdf", "x/第一册.pdf"], text.skip_file) == [False, True]


def test_tokens(spark):
    assert one(spark, ["乙方付款A1 ok的é", "付", ""], tokens.tokens) == [["乙方", "方付", "付款", "a1", "ok", "的", "é"], ["付"], []]
    grams = one(spark, ["乙方付 a Bc d"], lambda c: tokens.pairs_after(tokens.long_tokens(c)))
    assert grams == [["乙方", "方付", "bc", "乙方 方付", "方付 bc"]]


def lines(spark, values, file="f.pdf"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(values)], "file STRING, pos BIGINT, line STRING")


@pytest.mark.parametrize("bits", [16, 2, 0])
def test_section_lines(spark, bits):
    table = lines(spark, HEADINGS)
    assert documents.drop_repeated_lines(table).count() == 13
    kept = documents.contract_lines(table, bits)
    assert [r.line for r in kept.orderBy("pos").collect()] == ["乙方付款", "第五节 验收与付款", "质保金退还"]
    pieces = documents.join_lines(kept, bits).orderBy("pos").collect()
    assert [(r.place, r.text) for r in pieces] == [(0, "乙方付款"), (5, "第五节 验收与付款"), (15, "质保金退还")]


def test_split_clauses(spark):
    value = (
        "1.1乙方应当在合同生效之后支付全部货款1.2短句（3）甲方逾期支付的金额为12.50元的违约金应当另行计算并支付；验收合格后付款"
    )
    got = documents.split_clauses(spark.createDataFrame([(value,)], "text STRING"))
    assert [r.clause for r in got.collect()] == ["乙方应当在合同生效之后支付全部货款"]


def test_split_sentences_defaults(spark):
    df = spark.createDataFrame([("一二三四五。短；\n六七八九十;;十一",)], "text STRING")
    for least in (None, 0):
        assert [r.clause for r in documents.split_sentences(df, min_length=least).collect()] == ["一二三四五", "六七八九十"]
    assert documents.split_sentences(df, pattern="", min_length=1).count() == 4


def whole_texts(table):
    """``file, text``: the small test files joined into one value each."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return documents.join_lines(table).groupBy("file").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("text"))


@pytest.mark.parametrize("bits", [16, 3, 0])
def test_clauses_equal_those_of_the_joined_text(spark, bits):
    """Fragments numbered over segments against joining the file and splitting it, on random documents."""
    rng = random.Random(bits)
    pieces = ["第一章 投标人须知", "第二章 政府采购合同", "第三节 杂项", "1.2", "（3）", "；", "付款", "验收合格之后", "图纸", "甲方", " ", "质保金在"]
    rows = []
    for f in range(40):
        for pos in range(rng.randint(1, 40)):
            rows.append((f"f{f}.pdf", pos, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))))
    table = documents.drop_repeated_lines(spark.createDataFrame(rows, "file STRING, pos BIGINT, line STRING"))
    band = (3, 60)
    joined = whole_texts(documents.section_lines(table, bits).filter(text.keep_paragraph(F.col("line"))))
    expected = documents.split_clauses(joined, band=band).select("file", F.col("piece").cast("bigint"), "clause")
    got = documents.contract_clauses(table, band, bits)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert got.count() > 20
    plain = documents.contract_clauses(table, band, bits, select_lines=False)
    whole = documents.split_clauses(whole_texts(table), band=band).select("file", F.col("piece").cast("bigint"), "clause")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("bits", [16, 2])
def test_section_state_equals_a_loop(spark, bits):
    rng = random.Random(5)
    kinds = {"第1章 图纸": True, "第二节": True, "第三章 其他": False, "第四章 政府采购": False, "正文": None, "第五部分 投标人须知": False}
    rows, expected = [], []
    for f in range(30):
        state = False
        for pos in range(rng.randint(1, 30)):
            line = rng.choice(list(kinds))
            state = state if kinds[line] is None else kinds[line]
            rows.append((f"f{f}", pos, line))
            expected.append((f"f{f}", pos, line, state))
    got = documents.with_section_state(spark.createDataFrame(rows, "file STRING, pos BIGINT, line STRING"), bits)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.fixture
def no_coalescing(spark):
    """Range partitions stay as many as they are asked for."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_file_over_all_partitions(spark, no_coalescing):
    """A single file and a single page: its lines spread over tasks, and state, places and clause numbers cross them."""
    rng = random.Random(9)
    pieces = ["第一章 投标人须知", "第二章 政府采购合同", "1.2", "；", "付款", "验收合格之后"]
    rows = [("f.pdf", pos, f"{pos}号" * (rng.random() < 0.9) + "".join(rng.choice(pieces) for _ in range(3))) for pos in range(3000)]
    rows = [(f, pos, line if rng.random() < 0.98 else rng.choice(pieces[:2])) for f, pos, line in rows]
    table = spark.createDataFrame(rows, "file STRING, pos BIGINT, line STRING").repartition(5)
    kept = documents.contract_lines(table)
    placed = documents.join_lines(kept)
    assert placed.select(F.spark_partition_id()).distinct().count() > 1
    lines, state, seen = [], False, set()
    for _, pos, line in rows:
        line = line.strip()
        if not line or line in seen:
            continue
        seen.add(line)
        heading = line.startswith(("第一章", "第二章"))
        state = line.startswith("第一章") if heading else state
        if not state and not (heading and "政府采购合同" in line[:10]) and any(w in line for w in vocab.PARAGRAPH_KEEP) and not any(w in line for w in vocab.PARAGRAPH_DROP):
            lines.append((pos, line))
    got = placed.orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == lines and len(lines) > 300
    joined = " ".join(x for _, x in lines)
    assert all(joined[r.place : r.place + len(r.text)] == r.text for r in got)
    whole = documents.split_clauses(spark.createDataFrame([("f.pdf", joined)], "file STRING, text STRING"), band=(3, 60))
    want = whole.select("file", F.col("piece").cast("bigint"), "clause")
    assert sorted(map(tuple, documents.contract_clauses(table, (3, 60)).collect())) == sorted(map(tuple, want.collect()))


def test_failed_files_go_in_the_scan(spark, no_coalescing):
    pages = [(f"f{i}.pdf", p, f"第{p}页 乙方应当在验收合格之后支付第{p}批全部货款；", "boom" if i == 2 and p == 30 else None) for i in range(4) for p in range(60)]
    table = spark.createDataFrame(pages, "file STRING, page_no INT, text STRING, error STRING")
    for bits in (16, 3, 0):
        got = documents.contract_samples(documents.marked_page_lines(table), segment_bits=bits)
        assert {r.file: r["count"] for r in got.groupBy("file").count().collect()} == {f"f{i}.pdf": 60 for i in (0, 1, 3)}


def test_pages(spark):
    pages = spark.createDataFrame(
        [("a", 2, "二 ", None), ("a", 1, "一", None), ("a", 3, " \n", None), ("a", 4, None, "boom"), ("b", 1, " ", None)],
        "file STRING, page_no INT, text STRING, error STRING",
    )
    def texts(df):
        found = {}
        for r in df.orderBy("file", "page_no").collect():
            found.setdefault(r.file, []).append(r.text)
        return {file: "\n".join(pieces) for file, pieces in found.items()}

    def status(clean):
        return {r.file: r.status for r in documents.file_status(pages, clean).collect()}

    assert texts(documents.assemble_pages(pages)) == {"a": "一\n二 \n\n[警告] 第4页文本抽取失败: boom\n"}
    assert status(False) == {"a": "ok", "b": "no_text"}
    # One failed page fails the reading of its file: no rows, whatever its other pages hold.
    assert texts(documents.assemble_pages(pages, clean=True)) == {} and documents.page_lines(pages).count() == 1
    assert status(True) == {"a": "failed", "b": "no_text"}
    sound = pages.filter("error IS NULL")
    assert texts(documents.assemble_pages(sound, clean=True)) == {"a": "一\n二"}
    assert {r.file: r.status for r in documents.file_status(sound, True).collect()} == {"a": "ok", "b": "no_text"}


def test_joined_texts_are_written_in_order(spark, tmp_path):
    table = lines(spark, [f"第{i}行" for i in range(500)]).repartition(7)
    documents.write_joined(documents.join_lines(table), str(tmp_path / "joined"), "pos", separator=" ")
    files = sorted((tmp_path / "joined").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "".join(f"第{i}行 " for i in range(500))


def test_repeats_and_line_breaks_are_told_before_the_long_classes(spark):
    """The patterns of the cleaning chain turn most characters down at once, and clean as before."""
    assert text._REPEATED.startswith("(?s)(.)\\1") and all(p.startswith("(?!") for p in (text._NOISE, text._LINE_BREAK))
    raw = ["a。。b!!c))", "x  \n 　\ny", "☑甲\uf0b7乙☒", "  第 3 页 共 9 页\n- 2 -\n12\n1a", "😀😀aa　　b", None]
    cleaned = ["a。b!!c)", "x\ny", "甲乙", "1a", "😀😀aa　b", ""]
    assert one(spark, raw, text.clean_text) == cleaned


def test_keyword_classes_are_short():
    """A character is compared with few others: the first-character class comes in ranges of six."""
    pattern = text.keyword_pattern([w for words in vocab.STRICT_POSITIVE.values() for w in words])
    head = pattern[4 : pattern.index("])")]
    assert head.count("&&") > 5 and all(len(part.split("]")[0]) <= 6 for part in head.split("&&[")[1:])


def test_keywords_at_the_ends_of_their_ranges(spark):
    words = [chr(c) + "x" for c in range(0x4E00, 0x4E00 + 40, 3)]
    texts = [chr(c) + "x" for c in range(0x4E00 - 2, 0x4E00 + 44)]
    assert one(spark, texts, lambda c: text.contains_any(c, words)) == [t in words for t in texts]


def test_pairs_need_no_lambda(spark):
    df = spark.createDataFrame([("a bc de fg",), ("bc",), ("",), (None,)], "t STRING")
    pairs = df.select(tokens.pairs_after(tokens.long_tokens(F.col("t"))).alias("p"))
    assert "lambda" not in pairs._jdf.queryExecution().analyzed().toString()
    assert [r.p for r in pairs.collect()] == [["bc", "de", "fg", "bc de", "de fg"], ["bc"], [], None]


def test_long_form_collects_the_vocabulary_once(spark, monkeypatch):
    """An unstored vocabulary is a pass over the corpus, so it is asked for a single time."""
    df = features.with_terms(spark.createDataFrame([(1, "ab cd ab"), (2, "cd ef"), (3, None)], "k INT, text STRING"))
    calls, inner = [], features._by_place
    monkeypatch.setattr(features, "_by_place", lambda v: calls.append(v) or inner(v))
    found = features.transform_long(df, features.fit_vocabulary(df, max_df=1.0), "k").collect()
    assert len(calls) == 1
    assert sorted((r.k, r.term, r.tf) for r in found) == [(1, "ab", 2), (1, "ab cd", 1), (1, "cd", 1), (1, "cd ab", 1), (2, "cd", 1), (2, "cd ef", 1), (2, "ef", 1)]
