"""Exact substring deduplication: every 50-byte string that a smaller document also has is found by suffix sorting.

Sorting all suffixes of a corpus column by column would take as many passes over it as its longest text has bytes.  So
Spark first deals the corpus into collections of short strings that can be sorted on their own: strings of 50 bytes
that are equal have equal minimizers (the smallest hash among their 16-byte grams), and a minimizer that one document
alone has cannot be in a repeated string.  Places whose bytes all around are equal are settled by that.  For the others
the bytes around each place are sent to the minimizer's collection, whose Burrows-Wheeler transform and common prefixes
are built by inserting one symbol of every string per round.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of, free_shuffles, stored

WIDTH = 50
GRAM = 16
SPREAD = WIDTH - GRAM  # a string's minimizer starts at most this many bytes behind the string
BATCH_BYTES = 4 << 20  # texts whose minimizers are found together
PART_BYTES = 16 << 20  # text whose minimizers, on average, one task of the middle steps gets
COLLECTION_ROWS = 2048  # distinct strings whose transform is built together, or one minimizer's, if those are more
HASHES = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F), 3: np.uint64(0xD6E8FEB86659FD93)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place of ``data`` on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    words = data.astype(np.uint64)
    for step in (1, 2, 4):  # doubling: 2, 4 and then 8 bytes in a word
        words = words[:-step] | (words[step:] << np.uint64(8 * step))
    mixed = (words[:n] ^ (words[:n] >> np.uint64(29))) * HASHES[1] + (words[8 : 8 + n] ^ (words[8 : 8 + n] >> np.uint64(31))) * HASHES[2]
    mixed ^= mixed >> np.uint64(32)
    mixed *= HASHES[3]
    return mixed ^ (mixed >> np.uint64(29))


def _running(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over each window of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose gram is the smallest of some WIDTH-byte string of one text, and the hashes there; of equal ones all."""
    hashes = gram_hashes(data)
    if len(data) < WIDTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least = _running(hashes, SPREAD + 1, np.minimum)
    pad = np.zeros(SPREAD, dtype=np.uint64)
    most = _running(np.concatenate([pad, least, pad]), SPREAD + 1, np.maximum)
    places = np.flatnonzero(most == hashes)
    return places, hashes[places]


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_INVERSE = np.uint64(pow(int(HASHES[1]), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the multiplier and of its inverse, up to at least n - 1; kept, and grown when a longer text comes."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((HASHES[1], _INVERSE)):
            factors = np.full(2 * n, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """64-bit hashes of the bytes [from, to) of ``data``, for each list of spans, by differences of one running sum."""
    power, inverse = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], dtype=np.uint64, out=running[1:])
    out = []
    for begin, end in spans:
        mixed = (running[end] - running[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
        mixed ^= mixed >> np.uint64(31)
        mixed *= HASHES[2]
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return out


HALF = SPREAD // 2  # of a string's bytes beyond its gram, at least so many lie on one side of it


def surroundings(data: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Hashes of all bytes that a string with its minimizer at the place can have, and 32 bits each of the gram with HALF
    bytes before it and behind it; 0 where the text ends before."""
    n = len(data)
    around, left, right = span_hashes(
        data,
        [
            (np.maximum(places - SPREAD, 0), np.minimum(places + WIDTH, n)),
            (np.maximum(places - HALF, 0), places + GRAM),
            (places, np.minimum(places + GRAM + HALF, n)),
        ],
    )
    left = np.where(places >= HALF, (left >> np.uint64(32)) | np.uint64(1), np.uint64(0))
    right = np.where(places + GRAM + HALF <= n, (right >> np.uint64(32)) | np.uint64(1), np.uint64(0))
    return [around, left.astype(np.uint32), right.astype(np.uint32)]


# --- the transform of one collection ----------------------------------------------------------------------------------


def column_transform(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: (string, start).

    ``strings`` is a matrix of bytes of which row i has ``lengths[i]``; each string ends with a mark of its own, below
    all bytes.  A round inserts one symbol of every string, from the last one forwards: the transform holds the symbol
    before each suffix so far, and a suffix extended by that symbol comes where a stable sort by symbol puts it.  The
    two columns (symbol, suffix) lie in files which a round reads and writes from front to back.
    """
    m, longest, total = len(strings), int(lengths.max(initial=0)), int(lengths.sum()) + len(strings)
    before = np.full((m, strings.shape[1] + 1), -1, dtype=np.int16)  # the symbol before each suffix; none before a whole string
    before[:, 1:] = strings
    width, before = before.shape[1], before.ravel()
    whole = np.arange(m, dtype=np.int64) * width + lengths  # the empty suffixes: string and start in one number
    kinds = {"symbol": np.int16, "suffix": np.int64}
    with tempfile.TemporaryDirectory() as folder:
        files = [{n: np.memmap(f"{folder}/{n}{turn}", dtype=kind, mode="w+", shape=(total,)) for n, kind in kinds.items()} for turn in (0, 1)]
        for file in files:
            file["suffix"][:m], file["symbol"][:m] = whole, before[whole]
        now, size = files[0], m
        for turn in range(1, longest + 1):
            old, now = files[(turn + 1) % 2], files[turn % 2]
            symbol, suffix = np.asarray(old["symbol"][:size]), np.asarray(old["suffix"][:size])
            order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol < 0) :]
            size = m + len(order)
            grown = suffix[order] - 1
            now["suffix"][m:size], now["symbol"][m:size] = grown, before[grown]
        suffix = np.array(now["suffix"][:size])
    return suffix // width, suffix % width


def first_owners(strings: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For every start of a WIDTH-byte string in every row of ``strings``, one row after the other: the smallest owner of
    a row that has the string.

    Suffixes with a common prefix of WIDTH bytes are neighbours in the transform.  Common prefixes are compared once,
    there; carrying them through the rounds took more time than all the rest.
    """
    string, start = column_transform(strings, lengths)
    whole = lengths[string] - start >= WIDTH
    string, start = string[whole], start[whole]
    sizes = np.maximum(0, lengths - WIDTH + 1)
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    if len(string):
        texts = np.lib.stride_tricks.sliding_window_view(strings, WIDTH, axis=1)[string, start]
        new = np.r_[True, (texts[1:] != texts[:-1]).any(axis=1)]
        least = np.minimum.reduceat(owners[string], np.flatnonzero(new))[np.cumsum(new) - 1]
        out[(np.cumsum(sizes) - sizes)[string] + start] = least
    return out


# --- the steps on Spark -----------------------------------------------------------------------------------------------


def _parts(values: np.ndarray, n_parts: int) -> np.ndarray:
    return ((values >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PLACES = {"hashes": np.uint64, "around": np.uint64, "left": np.uint32, "right": np.uint32, "owners": np.int64, "variants": np.int64, "places": np.int32}


def places_of_minimizers(docs: DataFrame, n_parts: int) -> DataFrame:
    """``part`` and, packed, hash, surroundings, document and place of every minimizer; a row holds those of some MB of text."""
    schema = pa.schema([("part", pa.int64()), *((name, pa.binary()) for name in PLACES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            part = _parts(columns[0], n_parts)
            order = np.argsort(part, kind="stable")
            keys, first = np.unique(part[order], return_index=True)
            return _rows(schema, keys, *([x.tobytes() for x in np.split(c[order], first[1:])] for c in columns))

        found, held = [], 0
        for batch in batches:
            for doc_id, variant, text in zip(batch["doc_id"].to_pylist(), batch["variant"].to_pylist(), batch["text"], strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                places, hashes = minimizers(data)
                found.append((hashes, *surroundings(data, places), *(np.full(len(places), x, dtype=np.int64) for x in (doc_id, variant)), places.astype(np.int32)))
                held += len(data)
                if held >= BATCH_BYTES:
                    yield packed(found)
                    found, held = [], 0
        if found:
            yield packed(found)

    columns = ", ".join(f"{name} binary" for name in PLACES)
    return docs.where(F.octet_length("text") >= WIDTH).mapInArrow(run, f"part long, {columns}")


def _several(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether each key is one that different owners have."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    several = np.minimum.reduceat(owners[order], first) != np.maximum.reduceat(owners[order], first)
    out = np.empty(len(keys), dtype=bool)
    out[order] = np.repeat(several, np.diff(np.r_[first, len(keys)]))
    return out


def shared_places(packed: DataFrame, n_parts: int) -> DataFrame:
    """``part`` (of documents) and, packed, ``owners, variants, places, sides, hashes`` of places that may lie in a string of two
    documents.

    Such a string has HALF bytes beyond the gram on one side at least, so a place that shares neither side with another
    document is dropped.  If all that is left of a minimizer has the same bytes all around, its places beyond the
    smallest document's are settled: those bytes go (``sides`` is 0).  The rest is to be sorted; ``sides`` tells which side
    is shared (1 before, 2 behind), for no more than HALF - 1 bytes count on the other.
    """
    schema = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in ("owners", "variants", "places", "sides", "hashes"))])

    def run(table: pa.Table) -> pa.Table:
        hashes, around, left, right, owners, variants, places = (np.frombuffer(b"".join(table[n].to_pylist()), dtype=kind) for n, kind in PLACES.items())
        mixed = hashes * HASHES[3]
        sides = np.zeros(len(hashes), dtype=np.uint8)
        for side, salt, bit in ((left, HASHES[1], 1), (right, HASHES[2], 2)):
            there = np.flatnonzero(side)
            if len(there):
                sides[there] |= np.uint8(bit) * _several(mixed[there] + side[there].astype(np.uint64) * salt, owners[there])
        keep = np.flatnonzero(sides)
        order = keep[np.argsort(hashes[keep], kind="stable")]
        hashes, around, owners, variants, places, sides = (c[order] for c in (hashes, around, owners, variants, places, sides))
        if not len(hashes):
            return schema.empty_table()
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        sizes = np.diff(np.r_[first, len(hashes)])
        least = np.repeat(np.minimum.reduceat(owners, first), sizes)
        opened = np.repeat(np.minimum.reduceat(around, first) != np.maximum.reduceat(around, first), sizes)
        rows = np.flatnonzero(opened | (owners > least))
        bucket = (owners[rows] ^ variants[rows]) % n_parts
        rows = rows[np.argsort(bucket, kind="stable")]
        keys, cut = np.unique(np.sort(bucket), return_index=True)
        columns = (owners, variants, places, np.where(opened, sides, 0).astype(np.uint8), hashes)
        return pa.table([keys, *([x.tobytes() for x in np.split(c[rows], cut[1:])] for c in columns)], schema=schema)

    return packed.groupBy("part").applyInArrow(run, "part long, owners binary, variants binary, places binary, sides binary, hashes binary")


def _pairs(owners: np.ndarray, variants: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (owner, variant) of sorted columns, and where each begins."""
    first = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (variants[1:] != variants[:-1])][: len(owners)])
    return owners[first], variants[first], first


def places_by_document(packed: DataFrame) -> DataFrame:
    """``doc_id, variant`` and, packed, its ``settled`` places, and ``places, sides, hashes`` of the open ones; one row each."""
    schema = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), *((n, pa.binary()) for n in ("settled", "places", "sides", "hashes"))])

    def run(table: pa.Table) -> pa.Table:
        owners, variants, places, sides, hashes = (
            np.frombuffer(b"".join(table[n].to_pylist()), dtype=k) for n, k in (("owners", np.int64), ("variants", np.int64), ("places", np.int32), ("sides", np.uint8), ("hashes", np.uint64))
        )
        order = np.lexsort((sides == 0, variants, owners))  # a document's open places, then its settled ones
        docs, texts, first = _pairs(owners[order], variants[order])
        ends = np.r_[first[1:], len(order)]
        middle = first + np.add.reduceat(sides[order] > 0, first) if len(docs) else first
        spans = list(zip(first.tolist(), middle.tolist(), ends.tolist(), strict=True))
        places, sides, hashes = places[order], sides[order], hashes[order]
        settled = [places[m:e].tobytes() for _, m, e in spans]
        return pa.table([docs, texts, settled, *([c[f:m].tobytes() for f, m, _ in spans] for c in (places, sides, hashes))], schema=schema)

    return packed.groupBy("part").applyInArrow(run, "doc_id long, variant long, settled binary, places binary, sides binary, hashes binary")


WINDOWS = {"hashes": np.uint64, "lengths": np.int32, "bytes": np.uint8, "counts": np.int32, "owners": np.int64, "variants": np.int64, "begins": np.int32}


def windows_of(docs: DataFrame, places: DataFrame, n_parts: int) -> DataFrame:
    """``part`` and, packed, the bytes around every open place with their owners; equal ones of a batch stand once."""
    schema = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in WINDOWS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: dict) -> pa.RecordBatch:
            by_part: dict[int, list] = {}
            for (value, window), owned in found.items():
                by_part.setdefault((value >> 20) % n_parts, []).append((value, window, owned))
            columns: list[list] = [list(by_part), *([] for _ in WINDOWS)]
            for rows in by_part.values():
                flat = [o for _, _, owned in rows for o in owned]
                values = [v for v, _, _ in rows], [len(w) for _, w, _ in rows], None, [len(o) for _, _, o in rows], *map(list, zip(*flat, strict=True))
                for column, found_values, kind in zip(columns[1:], values, WINDOWS.values(), strict=True):
                    column.append(b"".join(w for _, w, _ in rows) if found_values is None else np.array(found_values, dtype=kind).tobytes())
            return _rows(schema, *columns)

        found, held = {}, 0
        for batch in batches:
            for doc_id, variant, text, *own in zip(batch["doc_id"].to_pylist(), batch["variant"].to_pylist(), *(batch[c] for c in ("text", "places", "hashes", "sides")), strict=True):
                data = text.as_buffer().to_pybytes()
                places, values, sides = (np.frombuffer(x.as_buffer(), dtype=kind) for x, kind in zip(own, (np.int32, np.uint64, np.uint8), strict=True))
                begins = np.maximum(0, places - np.where(sides & 1, SPREAD, HALF - 1))
                ends = places + np.where(sides & 2, WIDTH, GRAM + HALF - 1)
                for value, begin, end in zip(values.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    found.setdefault((value, data[begin:end]), []).append((doc_id, variant, begin))
                held += len(places)
                if held >= 50_000:
                    yield packed(found)
                    found, held = {}, 0
        if found:
            yield packed(found)

    rows = docs.join(places.where("octet_length(places) > 0"), ["doc_id", "variant"]).select("doc_id", "variant", "text", "places", "hashes", "sides")
    return rows.mapInArrow(run, "part long, " + ", ".join(f"{n} binary" for n in WINDOWS))


def repeated_spans(packed: DataFrame, n_parts: int) -> DataFrame:
    """``part`` (of documents) and, packed, documents with the bytes [begin, end) that a string of a smaller one covers."""
    schema = pa.schema([("part", pa.int64()), *((n, pa.binary()) for n in ("owners", "variants", "begins", "ends"))])

    def run(table: pa.Table) -> pa.Table:
        hashes, lengths, data, counts, owners, variants, begins = (np.frombuffer(b"".join(table[n].to_pylist()), dtype=k) for n, k in WINDOWS.items())
        if not len(hashes):
            return schema.empty_table()
        # Equal windows of one minimizer become one: rows of hash, length and padded bytes are sorted as they are.
        width = SPREAD + WIDTH
        rows = np.zeros((len(hashes), 12 + width), dtype=np.uint8)
        rows[:, :8], rows[:, 8:12] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8), lengths.astype(">i4").view(np.uint8).reshape(-1, 4)
        rows[:, 12:][np.arange(width) < lengths[:, None]] = data
        _, kept, window = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        window = np.repeat(window, counts)  # the window of each owner
        least = np.full(len(kept), np.iinfo(np.int64).max)
        np.minimum.at(least, window, owners)
        strings, sizes, group = rows[kept, 12:], lengths[kept].astype(np.int64), hashes[kept]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        cuts, taken = [0], 0
        for head in np.r_[heads[1:], len(kept)].tolist():  # a minimizer's windows stay together
            if head - taken >= COLLECTION_ROWS or head == len(kept):
                cuts.append(head)
                taken = head
        first = np.concatenate([first_owners(strings[a:b], sizes[a:b], least[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        starts = np.maximum(0, sizes - WIDTH + 1)
        at = np.cumsum(starts) - starts
        n = starts[window]
        owner = np.repeat(np.arange(len(window)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone = first[at[window[owner]] + start] < owners[owner]
        owner, start = owner[gone], start[gone]
        if not len(owner):
            return schema.empty_table()
        new = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]
        runs, last = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
        docs, texts, begin, end = owners[owner[runs]], variants[owner[runs]], begins[owner[runs]] + start[runs], begins[owner[runs]] + start[last] + WIDTH
        bucket = (docs ^ texts) % n_parts
        order = np.argsort(bucket, kind="stable")
        keys, cut = np.unique(bucket[order], return_index=True)
        columns = (docs, texts, begin.astype(np.int32), end.astype(np.int32))
        return pa.table([keys, *([x.tobytes() for x in np.split(c[order], cut[1:])] for c in columns)], schema=schema)

    return packed.groupBy("part").applyInArrow(run, "part long, owners binary, variants binary, begins binary, ends binary")


def spans_by_document(packed: DataFrame) -> DataFrame:
    """``doc_id, variant, begins, ends``, packed; one row each."""
    schema = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        owners, variants, begins, ends = (np.frombuffer(b"".join(table[n].to_pylist()), dtype=k) for n, k in (("owners", np.int64), ("variants", np.int64), ("begins", np.int32), ("ends", np.int32)))
        order = np.lexsort((variants, owners))
        docs, texts, first = _pairs(owners[order], variants[order])
        return pa.table([docs, texts, *([x.tobytes() for x in np.split(c[order], first[1:])] for c in (begins, ends))], schema=schema)

    return packed.groupBy("part").applyInArrow(run, "doc_id long, variant long, begins binary, ends binary")


def with_variants(rows: DataFrame) -> DataFrame:
    """Adds ``variant``: 0 where an id has one text, else a hash of the text, so that spans find the text they belong to.

    The ids with several texts (usually none) are written to the shared folder first; by the size of that table Spark
    chooses the join.  Least and largest hash of an id combine before the shuffle.
    """
    mark = F.xxhash64("text")
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    several = stored(ids.where("low != high").select("doc_id", F.lit(True).alias("several")), "repeated-ids")
    return rows.join(several, "doc_id", "left").withColumn("variant", F.when(F.col("several"), mark).otherwise(F.lit(0))).drop("several")


def removed_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, variant, spans`` of the bytes to remove, packed, for ``doc_id, variant, text`` of :func:`with_variants`."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(8, -(-total // PART_BYTES))
    shared = shared_places(places_of_minimizers(docs, n_parts).repartition(n_parts, "part"), n_parts)
    places = stored(places_by_document(shared.repartition(n_parts, "part")), "shared-minimizers")
    free_shuffles(spark)
    spans = repeated_spans(windows_of(docs, places, n_parts).repartition(n_parts, "part"), n_parts)
    spans = stored(spans_by_document(spans.repartition(n_parts, "part")), "repeated-spans")
    free_shuffles(spark)
    both = places.select("doc_id", "variant", "settled").join(spans, ["doc_id", "variant"], "full")
    return both.select("doc_id", "variant", F.struct("settled", "begins", "ends").alias("spans"))


def _gone(size: int, own: dict | None) -> np.ndarray:
    """Which of the ``size`` bytes of a text go, by its settled places and its spans."""
    change = np.zeros(size + 1, dtype=np.int64)
    if own:
        settled, begins, ends = (np.frombuffer(own[n] or b"", dtype=np.int32) for n in ("settled", "begins", "ends"))
        np.add.at(change, np.r_[np.maximum(settled - SPREAD, 0), begins], 1)
        np.add.at(change, np.r_[np.minimum(settled + WIDTH, size), ends], -1)
    return np.cumsum(change[:-1]) > 0


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    Defined cases: a null text is empty; texts under WIDTH bytes lose nothing; rows without ``doc_id`` are no document, lose
    nothing and give nothing; of rows that share a ``doc_id`` none counts as smaller; an empty table gives no rows; further
    columns are ignored.
    """
    rows = with_variants(columns_of(docs, "doc_id", "text"))
    spans = removed_spans(rows.where("doc_id IS NOT NULL"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, own in zip(batch["text"], batch["spans"], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = _gone(len(raw), own.as_py())
                runs = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[:1].sum())
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                found.append((len(raw), int(gone.sum()), int(runs), hashlib.sha256(kept).hexdigest()))
            yield _rows(schema, batch["doc_id"].cast(pa.int64()), *(zip(*found, strict=True) if found else ([],) * 4))

    joined = rows.join(spans, ["doc_id", "variant"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the bytes that smaller documents have; ``n_chars``, if there is one, is counted again.

    As :func:`report`, but a cut never splits a character: bytes of a character that is only partly covered stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py() if text.is_valid and not own.is_valid else _cut_text(text, own) for text, own in zip(batch["text"], batch["spans"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "text"])

    others = [c for c in docs.columns if c != "text"]
    marked = with_variants(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    spans = removed_spans(marked.where("doc_id IS NOT NULL").select("doc_id", "variant", "text"))
    rows = marked.join(spans, ["doc_id", "variant"], "left").select("row", "text", "spans")
    cut = rows.mapInArrow(run, rows.select("row", "text").schema)
    n_chars = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in others else {}
    return cut.select(*("text" if c == "text" else n_chars.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _cut_text(text, own) -> str | None:
    if not text.is_valid:
        return None
    raw = text.as_buffer().to_pybytes()
    gone = _gone(len(raw), own.as_py())
    data = np.frombuffer(raw, dtype=np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, heads) if len(heads) else gone
    return data[~np.repeat(whole, np.diff(np.r_[heads, len(data)]))].tobytes().decode()
