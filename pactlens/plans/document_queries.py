"""Registered queries: pages, lines, section state, clauses, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import text
from pactlens.operators import documents
from pactlens.plans import oracle_sql as o
from pactlens.plans.registry import register
from pactlens.plans.views import contract_pages, cte, table, view

_D = "\\p{Nd}"
_NUMBER = f"^第[一二三四五六七八九十{_D}]+[章节篇部分]"
_SKIP = f"{_NUMBER}[{o.WS}]*({'|'.join(vocab.SECTION_SKIP)}|$)"
_KEEP = f"{_NUMBER}[{o.WS}]*({'|'.join(vocab.SECTION_KEEP)})"
_CLAUSE = f"{_D}+\\.{_D}+|（{_D}+）|；"


def _lines(spark, sf_dir):
    return view(spark, sf_dir, "contract_src").select("file", "pos", "line")


# Segments of 512 rows, so that section state and clause numbers cross their borders on test data too.
_BITS = 9


def _first_lines(table_: str) -> str:
    return (
        f"SELECT file, min(pos) AS pos, line FROM (SELECT file, pos, {o.strip('line')} AS line FROM {table_}) "
        "WHERE line <> '' GROUP BY file, line"
    )


def _stated(table_: str) -> str:
    return (
        f"SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipping FROM (SELECT *, "
        f"CASE WHEN regexp_matches(line, '{_SKIP}') THEN true WHEN regexp_matches(line, '{_NUMBER}') THEN false END AS event "
        f"FROM ({table_}))"
    )


def _section_lines(table_: str) -> str:
    return (
        f"SELECT file, pos, line FROM ({_stated(table_)}) WHERE NOT skipping AND NOT "
        f"(regexp_matches(line, '{_KEEP}') AND NOT regexp_matches(line, '{_SKIP}'))"
    )


def _relevant(table_: str) -> str:
    return (
        f"SELECT * FROM ({_section_lines(_first_lines(table_))}) WHERE NOT {o.any_of('line', vocab.PARAGRAPH_DROP)} "
        f"AND {o.any_of('line', vocab.PARAGRAPH_KEEP)}"
    )


def _joined(table_: str) -> str:
    return f"SELECT file, string_agg(line, ' ' ORDER BY pos) AS text FROM ({_relevant(table_)}) GROUP BY file"


def _clauses(texts: str, key: str, separator: str = _CLAUSE) -> str:
    pieces = f"string_split_regex(text, '{separator}')"
    return (
        f"SELECT {key}, piece, {o.strip('raw')} AS clause FROM (SELECT {key}, unnest({pieces}) AS raw, "
        f"generate_subscripts({pieces}, 1) - 1 AS piece FROM {texts})"
    )


@register(
    "e1_lines",
    "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
    "CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS pos FROM documents",
)
def e1_lines(spark, sf_dir):
    return documents.explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(
    "e2_repeated_lines",
    f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS raw, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) "
    f"SELECT file, pos, line FROM (SELECT file, CAST(pos AS BIGINT) AS pos, line, row_number() OVER (PARTITION BY file, line ORDER BY pos) AS rn "
    f"FROM (SELECT file, pos, {o.strip('raw')} AS line FROM d) WHERE line <> '') WHERE rn = 1",
)
def e2_repeated_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    lines = documents.explode_lines(docs).withColumn("pos", F.col("pos").cast("bigint"))
    return documents.drop_repeated_lines(lines)


@register("e2_contract_lines", f"{cte('contract_src')} {_first_lines('contract_src')}")
def e2_contract_lines(spark, sf_dir):
    return documents.drop_repeated_lines(_lines(spark, sf_dir))


@register(
    "e3_section_state",
    f"{cte('contract_src')} SELECT file, pos, line, skipping FROM ({_stated(_first_lines('contract_src'))})",
)
def e3_section_state(spark, sf_dir):
    return documents.with_section_state(documents.drop_repeated_lines(_lines(spark, sf_dir)), _BITS)


@register("e3_section_lines", f"{cte('contract_src')} {_section_lines(_first_lines('contract_src'))}")
def e3_section_lines(spark, sf_dir):
    return documents.section_lines(documents.drop_repeated_lines(_lines(spark, sf_dir)), _BITS)


@register(
    "e4_joined_lines",
    f"{cte('contract_src')}, r AS ({_relevant('contract_src')}), j AS (SELECT file, string_agg(line, ' ' ORDER BY pos) AS whole, "
    "list(pos ORDER BY pos) AS ps, list(line ORDER BY pos) AS ls FROM r GROUP BY file), "
    "u AS (SELECT file, whole, unnest(ps) AS pos, unnest(ls) AS line, generate_subscripts(ps, 1) AS k, ls FROM j) "
    "SELECT file, pos, CAST(k - 1 + coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS place, "
    "substr(whole, CAST(k + coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x))), 0) AS BIGINT), length(line)) AS text FROM u",
)
def e4_joined_lines(spark, sf_dir):
    """The pieces of every file's joined text; the SQL cuts them out of the whole text, one per file."""
    return documents.join_lines(documents.contract_lines(_lines(spark, sf_dir), _BITS), _BITS)


@register(
    "e5_clauses",
    f"SELECT doc_id, CAST(piece AS INT) AS piece, clause FROM ({_clauses('documents', 'doc_id')}) WHERE length(clause) BETWEEN 15 AND 130",
)
def e5_clauses(spark, sf_dir):
    return documents.split_clauses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(
    "e5_contract_clauses",
    f"{cte('contract_src')} SELECT file, clause_no, clause FROM (SELECT file, CAST(piece AS BIGINT) AS clause_no, clause FROM "
    f"({_clauses('(' + _joined('contract_src') + ')', 'file')})) WHERE length(clause) BETWEEN 15 AND 130",
)
def e5_contract_clauses(spark, sf_dir):
    return documents.contract_clauses(_lines(spark, sf_dir), segment_bits=_BITS)


@register(
    "e6_sentences",
    "SELECT doc_id, CAST(piece AS INT) AS piece, clause FROM "
    f"({_clauses('documents', 'doc_id', vocab.SENTENCE_SEPARATOR)}) WHERE length(clause) >= 5",
)
def e6_sentences(spark, sf_dir):
    return documents.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


_LATIN_STOP = "[.!?]+"


@register(
    "e6_latin_sentences",
    f"SELECT doc_id, CAST(piece AS INT) AS piece, clause FROM ({_clauses('documents', 'doc_id', _LATIN_STOP)}) WHERE length(clause) >= 20",
)
def e6_latin_sentences(spark, sf_dir):
    return documents.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _LATIN_STOP, 20)


@register(
    "c7_clause_band",
    f"{cte('clause_src')} SELECT id, text FROM clause_src WHERE length({o.strip('text')}) >= 15 AND length({o.strip('text')}) <= 130",
)
def c7_clause_band(spark, sf_dir):
    clauses = view(spark, sf_dir, "clause_src").select("id", "text")
    return clauses.filter(text.in_band(text.strip(F.col("text")), vocab.CLAUSE_BAND))


@register(
    "c3_file_skip",
    f"{cte('contract_src')} SELECT file, count(*) AS n FROM contract_src WHERE NOT "
    f"{o.any_of('file', vocab.FILE_NAME_SKIP)} GROUP BY file",
)
def c3_file_skip(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.filter(~text.skip_file(F.col("file"))).groupBy("file").agg(F.count("*").alias("n"))


_BLANK = f"{o.strip('body')} = ''"
# One failed page fails the reading of its file.
_READABLE = "(SELECT * FROM contract_pages WHERE file NOT IN (SELECT file FROM contract_pages WHERE error IS NOT NULL))"


@register(
    "a7_page_text",
    f"{cte('contract_pages')} SELECT file, page_no, body AS text FROM (SELECT file, page_no, "
    "CASE WHEN error IS NOT NULL THEN chr(10) || '[警告] 第' || CAST(page_no AS VARCHAR) || '页文本抽取失败: ' || error || chr(10) "
    f"WHEN NOT {_BLANK} THEN body END AS body FROM (SELECT *, coalesce(text, '') AS body FROM contract_pages)) WHERE body IS NOT NULL",
)
def a7_page_text(spark, sf_dir):
    return documents.assemble_pages(contract_pages(spark, sf_dir))


@register(
    "a7_page_status",
    f"{cte('contract_pages')} SELECT file, CASE WHEN count(*) FILTER (error IS NOT NULL OR NOT {_BLANK}) > 0 THEN 'ok' ELSE 'no_text' END AS status "
    "FROM (SELECT *, coalesce(text, '') AS body FROM contract_pages) GROUP BY file",
)
def a7_page_status(spark, sf_dir):
    return documents.file_status(contract_pages(spark, sf_dir))


@register(
    "a7_cleaned_page_text",
    f"{cte('contract_pages')} SELECT file, page_no, string_agg(line, chr(10) ORDER BY n) AS text FROM "
    f"({o.cleaned_lines(_READABLE, 'file, page_no')}) GROUP BY file, page_no",
)
def a7_cleaned_page_text(spark, sf_dir):
    return documents.assemble_pages(contract_pages(spark, sf_dir), clean=True)


_CLEAN_LINES = (
    "SELECT file, CAST(page_no AS BIGINT) * 4294967296 + n AS pos, line FROM "
    f"({o.cleaned_lines(_READABLE, 'file, page_no')}) WHERE NOT "
    f"{o.any_of('file', vocab.FILE_NAME_SKIP)}"
)
_SAMPLE_CLAUSES = (
    "SELECT file, CAST(piece AS BIGINT) AS clause_no, clause AS text FROM "
    f"({_clauses('(' + _joined('(' + _CLEAN_LINES + ')') + ')', 'file')}) WHERE length(clause) BETWEEN 15 AND 130"
)


@register(
    "e7_contract_samples",
    f"{cte('contract_pages')}, s AS ({_SAMPLE_CLAUSES}) SELECT s.*, label, CAST(0.75 AS DOUBLE) AS confidence, "
    f"'gov_bid_file' AS source FROM s JOIN ({o.base_labels('s')}) USING (text)",
)
def e7_contract_samples(spark, sf_dir):
    return documents.contract_samples(documents.marked_page_lines(contract_pages(spark, sf_dir)), segment_bits=_BITS)


@register(
    "b20_stamped_samples",
    f"{cte('clause_src')} SELECT id, text, CAST(0.75 AS DOUBLE) AS confidence, 'gov_bid_file' AS source FROM clause_src",
)
def b20_stamped_samples(spark, sf_dir):
    return documents.stamp_samples(view(spark, sf_dir, "clause_src").select("id", "text"))
