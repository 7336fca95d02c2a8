"""Document fingerprints: a quartile digest of hashed byte triplets, and a bounded difference score between two digests."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of

BUCKETS = 512
TRIPLET = (4, 9)  # a triplet is a byte and the ones so many places behind it; neighbours would tell the language, not the text
LENGTH_STEPS = 6  # of the length code, per doubling of the length
LENGTH_WEIGHT, LENGTH_FAR = 0.5, 24  # a length code that is LENGTH_FAR steps off, or more, costs so much of the score
BLOCK = 1 << 20  # bytes hashed at once: a text of any length takes little memory beside itself
PART_BYTES = 64 << 20  # text a task walks through in order
ROWS_PER_BATCH = 512

FINGERPRINT = "doc_id BIGINT, fingerprint STRING"
REPORT = "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
Digest = tuple[int, np.ndarray]


def triplet_counts(raw: bytes) -> np.ndarray:
    """How many triplets fall into each bucket; the text is a ring, so it has as many triplets as bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    ring = raw + (raw * (TRIPLET[-1] // max(len(raw), 1) + 1))[: TRIPLET[-1]]
    for at in range(0, len(raw), BLOCK):
        n = min(BLOCK, len(raw) - at)
        first, second, third = (np.frombuffer(ring, np.uint8, n, at + shift).astype(np.uint32) for shift in (0, *TRIPLET))
        h = (first | second << 8 | third << 16) * np.uint32(0x9E3779B1)
        h ^= h >> 15
        h *= np.uint32(0x85EBCA6B)
        counts += np.bincount((h ^ h >> 13) % BUCKETS, minlength=BUCKETS)
    return counts


def digest(raw: bytes) -> Digest:
    """The length code, and per bucket how many of the three quartiles of all bucket counts its count is above."""
    counts = triplet_counts(raw)
    marks = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return round(LENGTH_STEPS * math.log2(1 + len(raw))), (counts[:, None] > marks).sum(axis=1).astype(np.uint8)


def as_text(value: Digest) -> str:
    """Two hexadecimal digits for the length, then one for every two buckets."""
    length, codes = value
    four = codes.reshape(-1, 4)
    return f"{length:02x}" + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


def as_digest(text: str) -> Digest:
    packed = np.frombuffer(bytes.fromhex(text[2:]), np.uint8)
    return int(text[:2], 16), (packed[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.uint8).ravel()


def likeness(a: Digest, b: Digest) -> float:
    """1 for equal digests, 0 for those no nearer than chance.

    The difference is the sum over buckets of the steps between their codes, against what two digests with these numbers
    of codes differ by when the buckets have nothing to do with each other; the lengths add their part.
    """
    difference = int(np.abs(a[1].astype(np.int16) - b[1]).sum())
    left, right = (np.bincount(codes, minlength=4) for codes in (a[1], b[1]))
    chance = sum(int(left[i]) * int(right[j]) * abs(i - j) for i in range(4) for j in range(4)) / BUCKETS
    score = difference / chance if chance else 0.0
    return 1.0 - min(1.0, score + LENGTH_WEIGHT * min(abs(a[0] - b[0]), LENGTH_FAR) / LENGTH_FAR)


def char_starts(raw: bytes, at: int, n: int) -> np.ndarray:
    """Where code points start in ``n`` bytes from ``at`` on."""
    return (np.frombuffer(raw, np.uint8, n, at) & 0xC0) != 0x80


def count_chars(raw: bytes) -> int:
    return sum(int(char_starts(raw, at, min(BLOCK, len(raw) - at)).sum()) for at in range(0, len(raw), BLOCK))


def byte_of_char(raw: bytes, chars: int) -> int:
    """How many bytes the first ``chars`` code points take: all, if there are fewer."""
    for at in range(0, len(raw), BLOCK):
        starts = char_starts(raw, at, min(BLOCK, len(raw) - at))
        here = int(starts.sum())
        if chars < here:
            return at + int(np.flatnonzero(starts)[chars])
        chars -= here
    return len(raw)


def edited(raw: bytes, following: bytes) -> tuple[int, bytes]:
    """The number of code points, and the text with its last third of them replaced by as many of the ``following`` text."""
    n = count_chars(raw)
    return n, raw[: byte_of_char(raw, n - n // 3)] + following[: byte_of_char(following, n // 3)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row's whole text: one narrow step.

    Defined cases: a null text is an empty one; equal texts have equal fingerprints, repeated rows give one row each; an
    empty table gives no rows; further columns are ignored.
    """
    rows = columns_of(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(digest(raw or b"")) for raw in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return rows.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FINGERPRINT)


def _order_keys(ids: pd.Series, hashes: pd.Series) -> np.ndarray:
    """Strings of bytes that sort as (id falling, nulls last; hash)."""
    missing = ids.isna().to_numpy()
    keys = np.zeros((len(ids), 17), np.uint8)
    keys[:, 0] = missing
    numbers = ~ids.astype("Int64").fillna(-1).to_numpy(np.int64)  # falling, without overflow
    for column, values in ((1, numbers), (9, hashes.to_numpy(np.int64))):
        keys[:, column : column + 8] = (values.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return keys.view("S17").ravel()


def in_stretches(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``stretch, ahead, doc_id, raw``: the rows by falling ``doc_id``, dealt into stretches of about ``part_bytes`` of text.

    Every stretch is sorted in one partition and ends with a copy of the row that follows it (``ahead``), the last one with
    the first row of all, so each row meets its successor without a window over the table.  Rows of one id go by the
    hash of their text, then by the text; rows without an id come last.  The bounds of the stretches come from
    range-partitioned keys of 16 bytes a row; the driver gets one key per stretch, and texts move once.
    """
    raw = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(raw).alias("hash"), raw.alias("raw"))
    parts = max(1, math.ceil((rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) / part_bytes))
    order = [F.desc_nulls_last("doc_id"), F.asc("hash")]
    keys = rows.select("doc_id", "hash").repartitionByRange(parts, *order)
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.bitwise_not("doc_id").alias("i"), "hash"))
    found = keys.groupBy(F.spark_partition_id().alias("part")).agg(lowest.alias("low")).collect()
    bounds = pd.DataFrame([(None if r.low.n else ~r.low.i, r.low.hash) for r in found], columns=["id", "hash"])
    bounds = np.unique(_order_keys(bounds["id"].astype("Int64"), bounds["hash"].astype(np.int64)))
    n = max(1, len(bounds))

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The stretch of a row; for those that open it, -1 minus the stretch."""
        keys = _order_keys(ids, hashes)
        stretch = np.searchsorted(bounds, keys, side="right") - 1
        return pd.Series(np.where(bounds[stretch] == keys, -1 - stretch, stretch).astype(np.int32))

    placed = rows.withColumn("place", place("doc_id", "hash"))
    own = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    before = F.when(F.col("place") < 0, F.pmod(-2 - F.col("place"), F.lit(n)))
    targets = F.array_compact(F.array(own, before))
    dealt = placed.select("doc_id", "hash", "raw", F.posexplode(targets).alias("ahead", "stretch"))
    dealt = dealt.repartitionById(n, F.col("stretch")).sortWithinPartitions("stretch", "ahead", *order, "raw")
    return dealt.select("stretch", "ahead", "doc_id", "raw")


def report(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """:data:`REPORT` per row: its fingerprint, that of its edited text, and how alike it, that and the next row's are.

    The next row is that of the next smaller ``doc_id`` (see :func:`in_stretches` for rows of one id or none); after the
    last row comes the first.

    Defined cases: a null text is an empty one; a table of one row is its own next one; repeated rows give one row each;
    an empty table gives no rows; further columns are ignored.
    """
    names = [f.split()[0] for f in REPORT.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out = None, []
        for batch in batches:
            for stretch, ahead, doc_id, raw in zip(*(batch[c] for c in ("stretch", "ahead", "doc_id", "raw")), strict=True):
                if ahead.as_py() and waiting is None:
                    continue  # one row is enough to end a stretch
                raw = raw.as_py()
                own = digest(raw)
                if waiting is not None:
                    key, before, print_ = waiting
                    n, changed = edited(before, raw)
                    other = digest(changed)
                    out.append((key, n, hashlib.sha256(changed).hexdigest(), as_text(print_), as_text(other), likeness(print_, other), likeness(print_, own)))
                waiting = None if ahead.as_py() else (doc_id.as_py(), raw, own)
                if len(out) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return in_stretches(docs, part_bytes).mapInArrow(run, REPORT)
