"""Files to tables: URL lists, contract folders, DOCX and TXT contents.

Spark lists and reads the files; the Python helpers below only decode the bytes of one file each.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactlens import schemas, vocab
from pactlens.functions import text
from pactlens.operators.frames import stored

ENCODINGS = ("utf-8", "gbk")  # of TXT files, in this order
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """``pos, url``: trimmed nonblank lines, numbered from 1 over all lists of ``path`` in the order of their names; repeated
    URLs stay.

    A list is one value, opened in place; the numbers of later lists start behind those of earlier ones, which takes one
    count per list and no order over the URLs.
    """
    lines = F.split(F.col("value"), "\r\n|\r|\n")
    urls = F.filter(F.transform(lines, text.strip), lambda u: u != "")
    lists = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_list"))
    opened = lists.select("_list", urls.alias("urls"))
    counts = opened.select(F.col("_list").alias("_of"), F.size("urls").cast("bigint").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_of", before.alias("_before"))
    placed = opened.join(offsets, F.col("_list") == F.col("_of")).select("_before", F.posexplode("urls").alias("p", "url"))
    return placed.select((F.col("_before") + F.col("p") + 1).cast("bigint").alias("pos"), "url")


def list_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """``file, length, content`` of the contract files directly in a folder; suffixes are case-sensitive.

    Names to skip are filtered on the path, before any content is read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", vocab.CONTRACT_GLOB).load(folder)
    return found.filter(~text.skip_file(F.col("path"))).select(F.col("path").alias("file"), "length", "content")


def list_files(spark: SparkSession, folder: str, glob: str = "*.{docx,DOCX,txt,TXT}") -> DataFrame:
    """``file, length, content`` of the files to score directly in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.col("path").alias("file"), "length", "content")


def decoded_files(files: DataFrame) -> DataFrame:
    """``file, pos, kind, text, error`` of ``file, content``: one pass over the contents, dispatched by suffix.

    A DOCX gives its nonblank paragraphs, then its table rows; a TXT gives its text; what cannot be read gives one error
    row.  Paragraphs and texts are as they stand in the file; ``parsed_text`` and ``file_lines`` clean them.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["file"], batch["content"]):
                rows = [(path, n, *row) for n, row in enumerate(_decoded(path, bytes(content)))]
                yield pd.DataFrame(rows, columns=["file", "pos", "kind", "text", "error"]).astype({"pos": "int32"})

    return files.select("file", "content").mapInPandas(parse, schemas.TEXT_PARTS)


def docx_parts(files: DataFrame) -> DataFrame:
    """:func:`decoded_files` of DOCX files whatever they are called."""
    named = F.concat("file", F.lit("#.docx")).alias("file")
    parts = decoded_files(files.select(named, "content"))
    return parts.withColumn("file", F.regexp_replace("file", r"#\.docx\z", ""))


def failed_files(parts: DataFrame) -> DataFrame:
    """``file, error``: the side table of what could not be read."""
    return parts.filter(F.col("error").isNotNull()).select("file", "error")


def parsed_text(parts: DataFrame) -> DataFrame:
    """``file, pos, kind, text``: stripped paragraphs and table rows, in reading order; blank ones and errors are left out."""
    stripped = parts.filter(F.col("error").isNull()).withColumn("text", text.strip(F.col("text")))
    return stripped.filter(F.col("text") != "").select("file", "pos", "kind", "text")


def _decoded(path: str, content: bytes) -> list[tuple]:
    """``kind, text, error`` per part of one file."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "docx":
        return _docx_rows(content)
    if suffix == "txt":
        value, _, error = _decode_text(content)
        return [("error" if error else "text", value, error)]
    return [("error", None, f"no decoder for .{suffix}")]


def _docx_rows(content: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        found = [("paragraph", _paragraph(p)) for p in body.findall(f"{_W}p")]
    except Exception as error:  # any damage makes an error row, never a failed job
        return [("error", None, f"{type(error).__name__}: {error}")]
    for table in body.findall(f"{_W}tbl"):
        try:
            for cells in _table(table):
                found.append(("table", "\t".join(c for c in cells if c)))
        except Exception:  # the rest of a damaged table goes, the file stays
            continue
    kept = [(kind, value, None) for kind, value in found if value.strip()]
    return kept or [("error", None, "no text")]


def _paragraph(node: ElementTree.Element) -> str:
    """Text of the runs of a paragraph, also of those inside hyperlinks; page and column breaks are no text."""
    marks = {f"{_W}tab": "\t", f"{_W}ptab": "\t", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}

    def mark(e: ElementTree.Element) -> str:
        if e.tag == f"{_W}br":
            return "\n" if e.get(f"{_W}type", "textWrapping") == "textWrapping" else ""
        return marks.get(e.tag, "")

    parts = []
    for child in node:
        runs = [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []
        for run in runs:
            parts += [(e.text or "") if e.tag == f"{_W}t" else mark(e) for e in run]
    return "".join(parts)


def _table(table: ElementTree.Element) -> Iterator[list[str]]:
    """Cell texts per row; a cell counts once for every column and row it spans."""
    above: list[str] = []
    for row in table.findall(f"{_W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_W}tc"):
            span = cell.find(f"{_W}tcPr/{_W}gridSpan")
            merge = cell.find(f"{_W}tcPr/{_W}vMerge")
            value = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val") != "restart" and len(cells) < len(above):
                value = above[len(cells)]
            cells += [value] * int(span.get(f"{_W}val") if span is not None else 1)
        above = cells
        yield cells


def file_lines(parts: DataFrame, tables: bool = False) -> DataFrame:
    """``file, pos, line`` for the document operators: the cleaned lines of paragraphs and texts, on request of table rows too."""
    kinds = ["paragraph", "text", *(["table"] if tables else [])]
    cleaned = parts.filter(F.col("kind").isin(kinds)).select("file", "pos", text.clean_text(F.col("text")).alias("t"))
    lines = cleaned.select("file", "pos", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    return lines.filter(F.col("line") != "").select(
        "file", F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.col("n")).alias("pos"), "line"
    )


def docx_lines(parts: DataFrame) -> DataFrame:
    """``file, pos, line``: cleaned paragraphs, no tables."""
    return file_lines(parts)


def decode_txt(content: Column, encodings: tuple[str, ...] = ENCODINGS) -> Column:
    """``STRUCT<text, encoding, error>`` by the first of the encodings that fits: utf-8 first, then gbk (of which gb2312 is a part)."""

    def decode(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode_text(bytes(c), encodings) for c in contents], columns=["text", "encoding", "error"])

    return F.pandas_udf(decode, schemas.DECODED)(content)


def text_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``file, encoding, line`` of TXT files of any size, read at any split; files in no known encoding give no rows.

    A line ends at a newline, a carriage return or both, in either encoding at bytes that are part of no other character.  So a
    file is utf-8 when all its lines are, and each is decoded by itself.  Spark's reader drops a byte-order mark, which is
    a character of the text here; a file that has one is longer than its lines.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at.alias("at"), F.col("value").cast("binary").alias("raw"))
    valid, length = F.is_valid_utf8(F.col("raw").cast("string")), F.octet_length("raw") + 1
    found = raw.groupBy("file").agg(F.min(valid).alias("utf8"), (F.sum(length) < F.max("size")).alias("marked"), F.min("at").alias("first"))
    special = stored(found.filter(~F.col("utf8") | F.col("marked")), "text-files")
    marked = F.coalesce(F.col("marked") & (F.col("at") == F.col("first")), F.lit(False))
    known = raw.join(special, "file", "left").withColumn("raw", F.when(marked, F.concat(F.lit(b"\xef\xbb\xbf"), "raw")).otherwise(F.col("raw")))
    plain = known.filter(F.coalesce("utf8", F.lit(True))).select("file", F.lit(ENCODINGS[0]).alias("encoding"), F.regexp_replace(F.col("raw").cast("string"), "\r\\z", "").alias("text"))
    if not special.filter(~F.col("utf8")).isEmpty():
        cut = F.expr("CASE WHEN endswith(raw, X'0D') THEN substring(raw, 1, octet_length(raw) - 1) ELSE raw END")
        other = known.filter(~F.coalesce("utf8", F.lit(True))).select("file", decode_txt(cut, ENCODINGS[1:]).alias("d"))
        other = stored(other.select("file", "d.*"), "text-lines")
        failed = other.filter(F.col("error").isNotNull()).select("file").distinct()
        rest = other.join(failed, "file", "left_anti").select("file", "encoding", F.translate("text", "\n", "\r").alias("text"))
        plain = plain.unionByName(rest)
    return plain.select("file", "encoding", F.explode(F.split("text", "\r")).alias("line"))


def _decode_text(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple:
    """``text, encoding, error``."""
    for encoding in encodings:
        try:
            value = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        return value.replace("\r\n", "\n").replace("\r", "\n"), encoding, None
    return None, None, "unknown encoding"
