"""Tables around document download: request headers, file names, outcome summary.  No network access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import web


def request_headers(urls: DataFrame, rules: list[tuple[str, str]] = vocab.REFERERS) -> DataFrame:
    """Adds ``host`` and ``referer`` to a table with ``url``."""
    return urls.withColumns({"host": web.host(F.col("url")), "referer": web.referer(F.col("url"), rules)})


def name_responses(responses: DataFrame, folder: str) -> DataFrame:
    """Fetch records for ``pos, url, content_disposition, content_type, head, size, error``.

    The extension comes from headers, then from the first bytes, then the fallback.  Failed rows get no file name.
    """
    by_header = web.extension_from_headers(F.col("url"), F.col("content_disposition"), F.col("content_type"))
    named = responses.withColumn("_header_ext", by_header).withColumn("_byte_ext", web.extension_from_bytes(F.col("head")))
    extension = (
        F.when(F.col("_header_ext") != "", F.col("_header_ext"))
        .when(F.col("_byte_ext") != "", F.col("_byte_ext"))
        .otherwise(vocab.FALLBACK_EXTENSION)
    )
    ok = F.col("error").isNull()
    name = F.when(ok, web.numbered_name(F.col("pos"), extension)).otherwise("")
    records = named.select("pos", "url", name.alias("file_name"), ok.alias("ok"), F.when(ok, F.col("size")).alias("size"), "error")
    local = F.when(F.col("ok"), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file_name"))).otherwise("")
    return records.withColumn("local_path", local)


def fetch_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_if("ok").alias("ok_count"), F.count_if(~F.col("ok")).alias("fail_count"), F.count("*").alias("total")
    )


def write_failed(records: DataFrame, path: str) -> bool:
    """Writes the failed records as JSON, only when there are any; tells whether it did."""
    failed = records.filter(~F.col("ok"))
    if failed.isEmpty():
        return False
    failed.write.mode("overwrite").json(path)
    return True
