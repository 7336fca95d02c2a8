"""SimHash near-duplicates: fingerprints of word shingles, pivot distance tables, components of close fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pactlens.llm.common import columns_of, components, stored

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
MAX_BITS = 2
PIVOT_BITS = 2  # reference fingerprint j has ones at bits 2j and 2j+1
AGREEING_GROUPS = 3  # groups of pivots whose coordinates two candidates share
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(raw: bytes, width: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: bit b is 1 when more than half the shingle hashes have it; repeats count."""
    words = raw.lower().split()  # bytes: lowers A-Z only, and splits at the six ASCII blanks
    n = max(len(words) - width + 1, 1 if words else 0)
    if not n:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        many = range(at, min(at + SHINGLES_AT_ONCE, n))
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in many), dtype="<u8", count=len(many))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch["text"]), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(prints.view(np.int64))], ["key", "print"])


def fingerprints(docs: DataFrame, key: F.Column) -> DataFrame:
    """``key, print`` (the 64 bits as bigint) of every whole text."""
    rows = docs.select(key.alias("key"), docs["text"])
    return rows.mapInArrow(_fingerprints, StructType([rows.schema["key"], StructField("print", LongType())]))


def pivots() -> list[int]:
    """The reference fingerprints: zero, and for each group of :data:`PIVOT_BITS` bits the one with just these set."""
    block = (1 << PIVOT_BITS) - 1
    return [0, *(block << at for at in range(0, BITS, PIVOT_BITS))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def close_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (bigint fingerprints, a < b) of all distinct fingerprints that differ in at most ``max_bits`` bits.

    Every fingerprint gets its table of Hamming distances to the :func:`pivots`.  A flipped bit moves the distance to
    the zero pivot by one and the difference to just one other pivot; so if the pivots are dealt into ``max_bits +
    AGREEING_GROUPS`` groups, two close fingerprints agree in all coordinates of AGREEING_GROUPS groups at least
    (coordinates counted from the zero pivot).  The coordinates of every such choice of groups are a join key: no pair is
    missed, and what the equal keys bring together is discarded by its largest coordinate difference before the
    fingerprints themselves are compared.  For two bits that is ten keys of about 27 bits each, so chance meetings stay
    far fewer than rows up to some ten million distinct fingerprints; one group alone (three keys of 16 bits) would bring
    a share of all pairs together at any size.  A frequent key is split by adaptive execution.
    """
    groups = max_bits + AGREEING_GROUPS
    table = [F.bit_count(F.col("print").bitwiseXOR(F.lit(_signed(p)))).alias(f"d{i}") for i, p in enumerate(pivots())]
    n = len(table) - 1
    tables = prints.select("print").where("print IS NOT NULL").distinct().select("print", F.array(*table).alias("table"))
    cuts = [n * g // groups for g in range(groups + 1)]
    steps = [F.transform(F.slice("table", 2 + cuts[g], cuts[g + 1] - cuts[g]), lambda d: d - F.col("table")[0]).alias(f"g{g}") for g in range(groups)]
    choices = [F.xxhash64(*(f"g{g}" for g in chosen)) for chosen in combinations(range(groups), AGREEING_GROUPS)]
    keyed = tables.select("print", *steps).select("print", F.posexplode(F.array(*choices)).alias("group", "cell"))
    # The table follows from the fingerprint: it is computed again behind the shuffle rather than carried through it.
    left, right = keyed.select("cell", "group", F.col("print").alias("a")), keyed.select("cell", "group", F.col("print").alias("b"))

    def distance(name: str, pivot: int) -> F.Column:
        return F.bit_count(F.col(name).bitwiseXOR(F.lit(_signed(pivot))))

    apart = F.greatest(*(F.abs(distance("a", p) - distance("b", p)) for p in pivots()))
    return (
        left.join(right, ["cell", "group"])
        .where(F.col("a") < F.col("b"))
        .where(apart <= max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``print, component_id`` for the distinct fingerprints of ``doc_id, print``.

    Documents of one fingerprint combine to their smallest id before anything is compared; ids, not fingerprints, are the
    nodes, so a component's smallest node is the answer.  An id with several fingerprints (rows that repeat it with other
    texts) links them all; usually there is none, and least and largest fingerprint of an id combine before the shuffle.
    """
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    pairs = close_pairs(prints, max_bits)
    edges = (
        pairs.join(first.select(F.col("print").alias("a"), F.col("first").alias("x")), "a")
        .join(first.select(F.col("print").alias("b"), F.col("first").alias("y")), "b")
        .select("x", "y")
    )
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low != high")
    shared = prints.join(several.select("doc_id"), "doc_id").select("print", "doc_id").distinct()
    edges = edges.unionByName(shared.join(first, "print").select(F.col("doc_id").alias("x"), F.col("first").alias("y")))
    roots = components(edges, "x", "y")
    return first.join(roots, first["first"] == roots["node"], "left").select("print", F.coalesce("root", "first").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    Defined cases: a null, empty or blank text has fingerprint zero and links like any other; rows that share a
    ``doc_id`` are one node; a row without ``doc_id`` gets the component of its fingerprint (null if only such rows have
    it); an empty table gives no rows; further columns are ignored.
    """
    prints = stored(fingerprints(columns_of(docs, "doc_id", "text"), docs["doc_id"]).withColumnRenamed("key", "doc_id"), "simhash")
    of = near_duplicates(prints)
    return prints.join(of, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose component has a row with a smaller ``doc_id``; all columns stay.

    Of rows that repeat a kept id all stay; a row without id stays only if no row of its component has one.
    """
    rows = columns_of(docs, "doc_id", "text")
    prints = stored(fingerprints(rows, rows["doc_id"]).withColumnRenamed("key", "doc_id"), "simhash")
    of = near_duplicates(prints)
    go = prints.join(of, "print").where("component_id IS NOT NULL AND NOT doc_id <=> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(go, docs["doc_id"].eqNullSafe(go["gone"]), "left_anti")
