"""Registered queries: cleaning, line predicates, tokens, URLs and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import scores, text, tokens, web
from pactlens.operators import fetch
from pactlens.plans import oracle_sql as o
from pactlens.plans.registry import register
from pactlens.plans.views import contract_pages, cte, table, view
from pactlens.session import scratch_path
from pactlens.sources import files

EXAMPLE_REFERERS = [
    ("blog.example.com", "https://blog.example.com/"),
    ("example.com", "https://www.example.com/"),
    ("example.net", "http://example.net/"),
    ("thter.example.org", "https://thter.example.org/"),
]
_LINE_KEYS = "file, pos"


def _on_lines(name: str, spark_expression, oracle_expression: str):
    """A query that maps every contract line."""

    @register(name, f"{cte('contract_src')} SELECT {_LINE_KEYS}, {oracle_expression} AS result FROM contract_src")
    def query(spark, sf_dir):
        return view(spark, sf_dir, "contract_src").select("file", "pos", spark_expression(F.col("line")).alias("result"))


_on_lines("b2_noise_symbols", text.drop_noise_symbols, o.noise_symbols("line"))
_on_lines("b3_placeholders", text.drop_placeholders, o.placeholders("line"))
_on_lines("b4_repeats", text.collapse_repeats, o.repeats("line"))
_on_lines("b5_page_marks", text.drop_page_marks, o.page_marks("line"))
_on_lines("b6_squeeze", text.squeeze_lines, o.squeeze("line"))
_on_lines(
    "b7_short_noise",
    lambda c: text.drop_short_noise(text.squeeze_lines(c)),
    f"CASE WHEN {o.short_noise(o.squeeze('line'))} THEN '' ELSE {o.squeeze('line')} END",
)
_on_lines(
    "b8_file_name",
    lambda c: text.clean_filename(F.concat(c, F.lit(' a/b:c*?"<x>|.pdf '))),
    "CASE WHEN " + (name := o.strip("translate(line || ' a/b:c*?\"<x>|.pdf ', '\\/:*?\"<>|' || chr(13) || chr(10) || chr(9), '')"))
    + f" = '' THEN 'unnamed' ELSE {name} END",
)
_on_lines(
    "c1_keep_paragraph",
    text.keep_paragraph,
    f"NOT {o.any_of('line', vocab.PARAGRAPH_DROP)} AND {o.any_of('line', vocab.PARAGRAPH_KEEP)}",
)
_on_lines(
    "c2_noise_line",
    text.is_noise_line,
    f"length({o.strip('line')}) < 5 OR {o.short_noise(o.strip('line'))}",
)


@register(
    "b1_clean_text",
    f"{cte('contract_pages')} SELECT k.file, k.page_no, coalesce(c.cleaned, '') AS cleaned FROM contract_pages k LEFT JOIN "
    f"(SELECT file, page_no, string_agg(line, chr(10) ORDER BY n) AS cleaned FROM "
    f"({o.cleaned_lines('contract_pages', 'file, page_no')}) GROUP BY file, page_no) c USING (file, page_no)",
)
def b1_clean_text(spark, sf_dir):
    return contract_pages(spark, sf_dir).select("file", "page_no", text.clean_text(F.col("text")).alias("cleaned"))


@register(
    "b1_clean_documents",
    "SELECT k.doc_id, coalesce(c.cleaned, '') AS cleaned FROM documents k LEFT JOIN "
    "(SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS cleaned FROM "
    f"({o.cleaned_lines('documents', 'doc_id')}) GROUP BY doc_id) c USING (doc_id)",
)
def b1_clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@register(
    "b1_clean_html",
    "SELECT k.page_id, coalesce(c.cleaned, '') AS cleaned FROM pages k LEFT JOIN "
    "(SELECT page_id, string_agg(line, chr(10) ORDER BY n) AS cleaned FROM "
    f"({o.cleaned_lines('pages', 'page_id', 'html')}) GROUP BY page_id) c USING (page_id)",
)
def b1_clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@register(
    "b17_tokens",
    f"SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY n, k) AS words "
    f"FROM ({o.token_rows('documents', 'doc_id')}) GROUP BY doc_id) USING (doc_id)",
)
def b17_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens.tokens(F.col("text")), " ").alias("words"))


@register(
    "b17_tokens_chinese",
    f"{cte('clause_src')} SELECT id, string_agg(token, ' ' ORDER BY n, k) AS words FROM "
    f"({o.token_rows('clause_src', 'id')}) GROUP BY id",
)
def b17_tokens_chinese(spark, sf_dir):
    return view(spark, sf_dir, "clause_src").select("id", F.array_join(tokens.tokens(F.col("text")), " ").alias("words"))


_HOST = "regexp_extract(url, '://([^/?#:]*)', 1)"


@register(
    "b9_host_referer",
    f"SELECT page_id, host, arg_min(referer, place) AS referer FROM (SELECT page_id, {_HOST} AS host FROM pages) LEFT JOIN "
    + o.values([(i, *r) for i, r in enumerate(EXAMPLE_REFERERS)], "r(place, domain, referer)")
    + " ON suffix(host, domain) GROUP BY page_id, host",
)
def b9_host_referer(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return fetch.request_headers(pages, EXAMPLE_REFERERS).drop("url")


@register(
    "d2_suffix_rules",
    f"{cte('responses_src')} SELECT pos, arg_min(referer, place) AS referer FROM (SELECT pos, {_HOST} AS host FROM "
    "responses_src) LEFT JOIN "
    + o.values([(i, *r) for i, r in enumerate(vocab.REFERERS)], "r(place, domain, referer)")
    + " ON suffix(host, domain) GROUP BY pos",
)
def d2_suffix_rules(spark, sf_dir):
    return view(spark, sf_dir, "responses_src").select("pos", web.referer(F.col("url")).alias("referer"))


# Extension by steps; the header values of responses_src are known, the oracle still takes them apart.
_BY_NAME = """CASE
  WHEN contains(content_disposition, 'filename*=') THEN
    CASE WHEN len(string_split(trim(split_part(content_disposition, 'filename*=', 2), '"'''), '''')) >= 3
    THEN url_decode(array_to_string(string_split(trim(split_part(content_disposition, 'filename*=', 2), '"'''), '''')[3:], '''')) END
  WHEN contains(content_disposition, 'filename=') THEN url_decode(trim(split_part(content_disposition, 'filename=', 2), '"'''))
  END"""
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1)"


def _suffix(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN '.' || lower(string_split({x}, '.')[-1]) END"


_MIME = o.values(list(vocab.MIME_EXTENSIONS.items()), "m(mime, mime_ext)")
_HEADER_EXT = (
    f"SELECT s.*, coalesce({_suffix('name')}, mime_ext, {_suffix('url_decode(path)')}, '') AS header_ext FROM "
    f"(SELECT *, {_BY_NAME} AS name, {_PATH} AS path FROM responses_src) s LEFT JOIN {_MIME} "
    "ON lower(trim(split_part(coalesce(content_type, ''), ';', 1))) = mime"
)
_BYTE_EXT = (
    "CASE WHEN starts_with(magic, '25504446') THEN '.pdf' WHEN starts_with(magic, '504b0304') THEN '.docx' "
    "WHEN starts_with(magic, '7b5c727466') THEN '.rtf' ELSE '' END"
)


@register("b10_header_extension", f"{cte('responses_src')} SELECT pos, header_ext AS extension FROM ({_HEADER_EXT})")
def b10_header_extension(spark, sf_dir):
    responses = view(spark, sf_dir, "responses_src")
    extension = web.extension_from_headers(F.col("url"), F.col("content_disposition"), F.col("content_type"))
    return responses.select("pos", extension.alias("extension"))


@register("b11_byte_extension", f"{cte('responses_src')} SELECT pos, {_BYTE_EXT} AS extension FROM responses_src")
def b11_byte_extension(spark, sf_dir):
    responses = view(spark, sf_dir, "responses_src")
    return responses.select("pos", web.extension_from_bytes(F.unhex("magic")).alias("extension"))


def _records(spark, sf_dir):
    responses = view(spark, sf_dir, "responses_src").withColumn("head", F.unhex("magic"))
    return fetch.name_responses(responses, "raw/contracts")


_RECORDS = (
    "SELECT pos, url, CASE WHEN error IS NULL THEN format('{:03d}', pos) || coalesce(nullif(header_ext, ''), "
    f"nullif({_BYTE_EXT}, ''), '.bin') ELSE '' END AS file_name, error IS NULL AS ok, "
    f"CASE WHEN error IS NULL THEN size END AS size, error FROM ({_HEADER_EXT})"
)


@register(
    "b12_file_names",
    f"{cte('responses_src')} SELECT *, CASE WHEN ok THEN 'raw/contracts/' || file_name ELSE '' END AS local_path FROM ({_RECORDS})",
)
def b12_file_names(spark, sf_dir):
    return _records(spark, sf_dir)


@register(
    "h2_fetch_summary",
    f"{cte('responses_src')} SELECT count(*) FILTER (error IS NULL) AS ok_count, count(error) AS fail_count, "
    "count(*) AS total FROM responses_src",
)
def h2_fetch_summary(spark, sf_dir):
    return fetch.fetch_summary(_records(spark, sf_dir))


@register("a10_failed_fetches", f"{cte('responses_src')} SELECT pos, url, error FROM responses_src WHERE error IS NOT NULL")
def a10_failed_fetches(spark, sf_dir):
    path = scratch_path(spark, "failed")
    schema = "pos BIGINT, url STRING, error STRING"
    if not fetch.write_failed(_records(spark, sf_dir), path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


@register("a1_url_list", "SELECT row_number() OVER (ORDER BY page_id % 3, page_id) AS pos, url FROM pages WHERE trim(url) <> ''")
def a1_url_list(spark, sf_dir):
    """Three lists, numbered through."""
    path = scratch_path(spark, "urls")
    padded = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(" "), F.col("url"), F.lit("\t\n \n")).alias("value"))
    for i in range(3):
        padded.filter(F.col("page_id") % 3 == i).orderBy("page_id").select("value").coalesce(1).write.text(f"{path}/{i}")
    return files.read_url_list(spark, f"{path}/*/*.txt")


@register(
    "a6_txt_files",
    # Every written text ends with one newline more; each file part adds one last empty line, which is not a text's.
    "SELECT 'utf-8' AS encoding, unnest(string_split(text, chr(10))) AS line FROM documents",
)
def a6_txt_files(spark, sf_dir):
    path = scratch_path(spark, "txt")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return files.text_lines(spark, path).select("encoding", "line")


@register(
    "b18_prompts",
    f"{cte('clause_src')} SELECT id, prompt FROM clause_src JOIN {o.values(list(vocab.PROMPTS.items()), 'q(label, prompt)')} ON label = y",
)
def b18_prompts(spark, sf_dir):
    return view(spark, sf_dir, "clause_src").select("id", scores.prompt(F.col("y")).alias("prompt"))
