"""Contract files laid over the driver's tables: executors write them, so their number grows with the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.plans.views import view
from pactlens.session import scratch_path

_NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TABLE = [["合计", "件数"], ["备注", "付款验收"]]  # of every DOCX; the last row of a damaged table cannot be read


def _paragraph(line: str) -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'


def docx_bytes(lines: list[str], table: list[list[str]], damaged: bool = False) -> bytes:
    """A DOCX with a paragraph per line and one table, whose last row has a column span that is no number when damaged."""
    rows = []
    for n, row in enumerate(table):
        span = '<w:tcPr><w:gridSpan w:val="x"/></w:tcPr>' if damaged and n == len(table) - 1 else ""
        rows.append("<w:tr>" + "".join(f"<w:tc>{span}{_paragraph(c)}</w:tc>" for c in row) + "</w:tr>")
    body = "".join(map(_paragraph, lines)) + f"<w:tbl>{''.join(rows)}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{_NAMESPACE}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _content(kind: str, lines: list[str]) -> bytes:
    if kind in ("docx", "table"):
        return docx_bytes(lines, TABLE, damaged=kind == "table")
    if kind == "broken":
        return docx_bytes(lines, TABLE)[:-9]
    return "\r\n".join(lines).encode("gbk" if kind == "gbk" else "utf-8")


def write_contract_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder with one file per supplier, of the kinds of ``files_src``.

    Lines come sorted by file, so a task holds the lines of one file and a batch, however many files it writes.
    """
    folder = scratch_path(spark, "contracts")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        rows = (row for batch in batches for row in zip(batch["name"], batch["kind"], batch["line"]))
        for (name, kind), of_file in groupby(rows, key=lambda row: row[:2]):
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(_content(kind, [line for _, _, line in of_file]))
            yield pd.DataFrame({"name": [name]})

    lines: DataFrame = view(spark, sf_dir, "files_src").repartition("name", "kind")
    order = [F.asc_nulls_last(c) for c in ("name", "kind", "pos", "line")]
    lines.sortWithinPartitions(*order).select("name", "kind", "line").mapInPandas(write, "name STRING").write.format("noop").mode("overwrite").save()
    return folder
