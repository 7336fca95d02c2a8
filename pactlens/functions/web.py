"""Column functions over URLs and HTTP response fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions.text import strip

_SCHEME = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def host(url: Column) -> Column:
    """The network location up to its first colon."""
    netloc = F.regexp_extract(url, _SCHEME + "//([^/?#]*)", 1)
    return F.substring_index(netloc, ":", 1)


def referer(url: Column, rules: list[tuple[str, str]] = vocab.REFERERS) -> Column:
    """Referer of the first rule, in list order, whose domain ends the host; null without one.

    The list is short and fixed, so it becomes a CASE inside the projection: no join at all.
    """
    h = host(url)
    return F.coalesce(*[F.when(F.endswith(h, F.lit(domain)), value) for domain, value in rules])


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves '+' and broken escapes as they are."""
    protected = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(protected)


def url_path(url: Column) -> Column:
    """The path without query, fragment and the last segment's ';' parameters."""
    path = F.regexp_extract(url, _SCHEME + "(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_extract(path, r"(?s)\A((?:.*/)?[^/;]*)", 1)


def _suffix(name: Column) -> Column:
    """Lower-cased text after the last dot, with the dot; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))))


def extension_from_headers(url: Column, disposition: Column, content_type: Column) -> Column:
    """Content-Disposition, then Content-Type, then the URL path; empty text when none tells."""
    header = F.coalesce(disposition, F.lit(""))
    encoded = F.btrim(F.substring_index(header, "filename*=", -1), F.lit("\"'"))
    plain = F.btrim(F.substring_index(header, "filename=", -1), F.lit("\"'"))
    third = F.regexp_extract(encoded, r"(?s)\A[^']*'[^']*'(.*)\z", 1)
    name = (
        F.when(F.contains(header, F.lit("filename*=")), unquote(third))
        .when(F.contains(header, F.lit("filename=")), unquote(plain))
        .otherwise("")
    )
    mime = F.lower(strip(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    by_mime = F.coalesce(*[F.when(mime == k, v) for k, v in vocab.MIME_EXTENSIONS.items()])
    return F.coalesce(_suffix(name), by_mime, _suffix(unquote(url_path(url))), F.lit(""))


def extension_from_bytes(head: Column) -> Column:
    """Extension by the first bytes; empty text when unknown."""
    tests = [F.when(F.substring(head, 1, len(m)) == F.lit(m), ext) for m, ext in vocab.MAGIC_EXTENSIONS]
    return F.coalesce(*tests, F.lit(""))


def numbered_name(position: Column, extension: Column) -> Column:
    """Position padded to three digits (longer ones stay whole), then the extension."""
    number = position.cast("string")
    return F.concat(F.when(position < 1000, F.lpad(number, 3, "0")).otherwise(number), extension)
