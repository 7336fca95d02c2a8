"""Hierarchical packing of token sequences: context-size tiers, gaps filled from shorter tiers, balanced step groups."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json, as ranks
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 1
TIERS = (256, 512, 1024, 2048)
WINDOW = TIERS[-1]
STEP_TOKENS = 8 * WINDOW
POOL_TOKENS = 1 << 21  # tokens a task holds before it packs them
TEXTS_AT_ONCE = 64

PIECES = [
    ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("sequence_tokens", pa.int32()), ("padded_to", pa.int32()), ("step_group", pa.int64()),
]


def encoder(ranks_path: str = RANKS) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tier_of(tokens: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest context size that holds ``tokens``."""
    return next(t for t in tiers if tokens <= t)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of documents with these ``lengths`` once.

    Each document gives full windows and a rest, and the rest is routed to the smallest tier that holds it.  The longest
    tier is served first: a rest opens a window of its tier, and the gap behind it is filled from the shorter tiers, the
    longest rest that fits first, else by cutting the next shorter rest; what a cut leaves is routed anew.  Only the
    last tokens of a pool can leave a gap: they become sequences of powers of two, which need no padding.
    """
    sequences, queues = [], {t: deque() for t in tiers}

    def route(doc: int, start: int, length: int) -> None:
        queues[tier_of(length, tiers)].append((doc, start, length))

    for doc, length in enumerate(lengths):
        full = length - length % tiers[-1]
        sequences += [[(doc, at, tiers[-1])] for at in range(0, full, tiers[-1])]
        if length > full:
            route(doc, full, length - full)
    for place in range(len(tiers) - 1, -1, -1):
        size = tiers[place]
        while queues[size]:
            window, gap = [queues[size].popleft()], size
            gap -= window[0][2]
            while gap:
                fits = next((t for t in reversed(tiers[: place + 1]) if queues[t] and queues[t][0][2] <= gap), None)
                source = fits or next((t for t in tiers[: place + 1] if queues[t]), None)
                if source is None:
                    break
                doc, start, length = queues[source].popleft()
                taken = min(length, gap)
                window.append((doc, start, taken))
                gap -= taken
                if length > taken:
                    route(doc, start + taken, length - taken)
            sequences += [window] if not gap else powers_of_two(window)
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one unfilled window, cut into sequences whose lengths are the powers of two of their sum."""
    total, out, left = sum(p[2] for p in pieces), [], deque(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        need, sequence = total & (1 << bit), []
        while need:
            doc, start, length = left.popleft()
            taken = min(length, need)
            sequence.append((doc, start, taken))
            need -= taken
            if length > taken:
                left.appendleft((doc, start + taken, length - taken))
        if sequence:
            out.append(sequence)
    return out


def _packed(ids: list[np.ndarray], keys: pa.Array, first_sequence: int, first_step: int) -> tuple[pa.RecordBatch, int, int]:
    """The pieces of one pool; sequences are numbered from ``first_sequence``, longest first, and dealt into steps.

    Lengths are powers of two in falling order, so steps of STEP_TOKENS fill exactly, one after the other: every step
    group but a pool's last trains on the same number of tokens.
    """
    sequences = sorted(pack([len(x) for x in ids]), key=lambda s: -sum(p[2] for p in s))
    columns, docs, tokens = [[] for _ in PIECES], [], 0
    for number, sequence in enumerate(sequences):
        size, offset = sum(p[2] for p in sequence), 0
        for doc, start, length in sequence:
            docs.append(doc)
            crc = zlib.crc32(ids[doc][start : start + length])
            padded = size if size & (size - 1) == 0 else WINDOW
            for column, value in zip(columns, (start, length, crc, len(ids[doc]), first_sequence + number, offset, size, padded, first_step + tokens // STEP_TOKENS), strict=True):
                column.append(value)
            offset += length
        tokens += size
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, PIECES, strict=True)]
    batch = pa.RecordBatch.from_arrays([keys.take(pa.array(docs, pa.int64())), *arrays], ["key", *(n for n, _ in PIECES)])
    return batch, first_sequence + len(sequences), first_step + -(-tokens // STEP_TOKENS)


def packed(docs: DataFrame, key: F.Column, ranks_path: str = RANKS) -> DataFrame:
    """One row per piece: ``key`` and :data:`PIECES`.

    A narrow operator: each task tokenizes its documents and packs pools of about POOL_TOKENS tokens, so neither tokens
    nor texts are shuffled and memory is bounded by the pool and one document.  ``sequence_id`` and ``step_group`` carry
    the partition's number in their high bits and are unique over the table.

    Defined cases: a null or empty text is the end token alone; repeated rows are packed each; the string of the end-of-text
    token in a text is that token, as the tokenizer has it; an empty table gives no rows.
    """
    rows = docs.select(key.alias("key"), docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode
        sequence = step = TaskContext.get().partitionId() << 33
        ids, keys, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                for text in part["text"]:
                    tokens = encode(text.as_py(), allowed_special="all") if text.is_valid else []
                    ids.append(np.array([*tokens, END_ID], dtype="<u4"))
                    held += len(ids[-1])
                keys.append(part["key"])
                if held >= POOL_TOKENS:
                    out, sequence, step = _packed(ids, pa.concat_arrays(keys), sequence, step)
                    yield out
                    ids, keys, held = [], [], 0
        if ids:
            yield _packed(ids, pa.concat_arrays(keys), sequence, step)[0]

    ints = {pa.int64(): LongType(), pa.int32(): IntegerType()}
    return rows.mapInArrow(run, StructType([rows.schema["key"], *(StructField(n, ints[kind]) for n, kind in PIECES)]))
