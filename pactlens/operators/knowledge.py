"""Knowledge base: chunks of documents, their TF-IDF vectors in an inverted index, the best chunks for a text.

Contract only in the reference.  The index is three tables: the vocabulary, the postings (term, block, chunk, weight), and the
peaks, the largest weight of a term in a block of neighbouring chunks.  Retrieval never pairs a query with every block: a
first threshold comes from the chunks that hold the query's peaks, and only blocks whose peaks can still reach it are scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from pactlens import vocab
from pactlens.operators.documents import split_sentences
from pactlens.operators.features import fit_vocabulary, sparse_vectors, with_terms
from pactlens.operators.frames import stored
from pactlens.operators.scan import in_segments

BLOCK_BITS = 10  # a block has 1,024 neighbouring chunks at most
PIECE_BITS = 24  # of a chunk id: the number of the piece in its document
SLACK = 1e-9  # sums of products differ by their order; scores are compared and returned in steps of this size
DIGITS = 9
QUERIES_AT_ONCE = 4096  # about so many queries meet a block in one group


@dataclass(frozen=True)
class Index:
    vocabulary: DataFrame  # term, tf, df, idf, place
    postings: DataFrame  # place, block, chunk_id, weight
    peaks: DataFrame  # place, block, peak, best: the chunk that has the peak


def knowledge_chunks(documents: DataFrame, key: str, source: str = "text") -> DataFrame:
    """``chunk_id, text``: the sentences of the knowledge documents; the id is the document's with the piece behind it.

    A document without text has no chunk; one without a key, or with 2 ** 24 sentences or more, fails the job.
    """
    pieces = split_sentences(documents.select(key, source), source)
    fits = F.col(key).isNotNull() & (F.col("piece") < 1 << PIECE_BITS) & (F.abs(F.col(key)) < 1 << (62 - PIECE_BITS))
    number = F.shiftleft(F.col(key).cast("bigint"), PIECE_BITS) + F.col("piece")
    return pieces.select(F.when(fits, number).otherwise(F.raise_error(F.lit("no chunk id for this document")).cast("bigint")).alias("chunk_id"), F.col("clause").alias("text"))


def build_index(chunks: DataFrame, max_features: int = vocab.MAX_FEATURES, max_df: float = vocab.MAX_DF, block_bits: int = BLOCK_BITS) -> Index:
    """The index of ``chunk_id, text``; chunks of equal ids or null text are allowed, those without a known term are in no list."""
    terms = with_terms(chunks.filter("text IS NOT NULL").select("chunk_id", "text")).select("chunk_id", "terms")
    vocabulary = stored(fit_vocabulary(terms, max_features=max_features, max_df=max_df), "knowledge-terms")
    vectors = sparse_vectors(terms, vocabulary).select("chunk_id", "entries")
    placed = in_segments(vectors.filter(F.size("entries") > 0), "chunk_id", segment_bits=block_bits)
    block = F.min("segment").over(Window.partitionBy("chunk_id"))  # equal ids stay in one block
    entries = placed.withColumn("block", block).select("chunk_id", "block", F.inline("entries"))
    postings = stored(entries.select("place", "block", "chunk_id", F.col("value").alias("weight")), "knowledge-postings")
    top = F.max_by(F.struct("weight", "chunk_id"), F.struct("weight", -F.col("chunk_id")))
    peaks = postings.groupBy("place", "block").agg(top.alias("top")).select("place", "block", F.col("top.weight").alias("peak"), F.col("top.chunk_id").alias("best"))
    return Index(vocabulary, postings, stored(peaks, "knowledge-peaks"))


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``query_id, place, weight``: the queries' unit vectors over the index's vocabulary."""
    terms = with_terms(queries.filter("text IS NOT NULL").select("query_id", "text")).select("query_id", "terms")
    return sparse_vectors(terms, index.vocabulary).select("query_id", F.inline("entries")).select("query_id", "place", F.col("value").alias("weight"))


def _scores(asked: DataFrame, index: Index, where: DataFrame, on: list[str]) -> DataFrame:
    """``query_id, chunk_id, score`` of the chunks that ``where`` (``query_id`` and ``on``) names."""
    wanted = where.join(asked, "query_id").withColumnRenamed("weight", "asked")
    met = wanted.join(index.postings, [*on, "place"])
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), DIGITS).alias("score"))


def _block_scores(asked: DataFrame, index: Index, blocks: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score``: the k best chunks of each query in each of its ``blocks``.

    A block's postings meet all queries that look at it in one group, so of the chunks scored there only k a query leave
    it.  A block that many queries look at makes a group for every ``QUERIES_AT_ONCE`` of them.
    """
    parts = -(-asked.select("query_id").distinct().count() // QUERIES_AT_ONCE) or 1
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
    wanted = blocks.join(asked, "query_id").select("block", part, "query_id", "place", "weight")
    postings = index.postings.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    postings = postings.select(F.col("block").alias("of_block"), F.col("part").cast("bigint").alias("of_part"), "place", "chunk_id", "weight")
    schema = StructType([asked.schema["query_id"], postings.schema["chunk_id"], StructField("score", DoubleType())])
    return wanted.groupBy("block", "part").cogroup(postings.groupBy("of_block", "of_part")).applyInArrow(partial(_scored_block, k=k), schema)


def _scored_block(wanted: pa.Table, postings: pa.Table, k: int) -> pa.Table:
    """The k best chunks of one block for each query of ``wanted``; a chunk is met when it shares a term."""
    chunks, local = np.unique(postings["chunk_id"].to_numpy(), return_inverse=True)
    by_place, by_query = np.argsort(postings["place"].to_numpy(), kind="stable"), np.argsort(wanted["query_id"].to_numpy(), kind="stable")
    places, local, weights = postings["place"].to_numpy()[by_place], local[by_place], postings["weight"].to_numpy()[by_place]
    ids, asked, own = (wanted[c].to_numpy()[by_query] for c in ("query_id", "place", "weight"))
    low, high = np.searchsorted(places, asked, "left"), np.searchsorted(places, asked, "right")
    starts = [0, *np.flatnonzero(ids[1:] != ids[:-1]) + 1] if len(ids) else []
    found = []
    for begin, end in zip(starts, [*starts[1:], len(ids)]):
        sizes = high[begin:end] - low[begin:end]
        at = np.repeat(low[begin:end] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = np.bincount(local[at], np.repeat(own[begin:end], sizes) * weights[at], len(chunks))
        met = np.flatnonzero(np.bincount(local[at], minlength=len(chunks)))
        total = np.round(total[met], DIGITS)
        best = np.lexsort((met, -total))[:k]  # of equal scores the smaller chunk id
        found.append((np.full(len(best), ids[begin]), chunks[met[best]], total[best]))
    columns = map(np.concatenate, zip(*found)) if found else (ids[:0], chunks[:0], weights[:0])
    return pa.table(list(map(pa.array, columns)), names=["query_id", "chunk_id", "score"])


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def thresholds(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, least``: a score that k chunks of the query reach for sure, 0 where fewer were met.

    The chunks that hold the k largest peaks of each of the query's terms are scored in full.
    """
    order = Window.partitionBy("place").orderBy(F.desc("peak"), "block")
    used = index.peaks.join(asked.select("place").distinct(), "place", "left_semi")
    seeds = used.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    first = asked.join(seeds, "place").select("query_id", "block", F.col("best").alias("chunk_id")).distinct()
    reached = _best(_scores(asked, index, first, ["block", "chunk_id"]), k).filter(F.col("rank") == k)
    return reached.select("query_id", F.col("score").alias("least"))


def surviving_blocks(asked: DataFrame, index: Index, least: DataFrame) -> DataFrame:
    """``query_id, block``: the blocks in which some chunk may reach the query's threshold.

    A chunk that reaches it holds an essential term: the others' largest weights together stay below.  So only blocks with
    an essential term are looked at, and of them those whose peaks add up to the threshold.
    """
    known = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    most = index.peaks.groupBy("place").agg(F.max("peak").alias("most"))
    reach = F.sum(F.col("weight") * F.col("most")).over(Window.partitionBy("query_id").orderBy(F.col("weight") * F.col("most"), "place"))
    essential = known.join(most, "place").withColumn("reach", reach).filter(F.col("reach") >= F.col("least"))
    near = essential.select("query_id", "place").join(index.peaks.select("place", "block"), "place").select("query_id", "block").distinct()
    bound = near.join(known, "query_id").join(index.peaks, ["place", "block"]).groupBy("query_id", "block", "least").agg(F.sum(F.col("weight") * F.col("peak")).alias("bound"))
    return bound.filter(F.col("bound") >= F.col("least")).select("query_id", "block")


def retrieve(index: Index, queries: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the k chunks of the highest cosine for each query text, ties by chunk id.

    Scores count in steps of 1e-9.  A query without a term of the vocabulary has no result, one that shares terms with fewer
    chunks than k has fewer.
    """
    asked = stored(query_terms(index, queries), "knowledge-queries")
    least = stored(thresholds(asked, index, k), "knowledge-thresholds")
    blocks = surviving_blocks(asked, index, least)
    scored = _block_scores(asked, index, blocks, k).join(least, "query_id", "left")
    reaching = scored.filter(F.col("score") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return _best(reaching, k).select("query_id", "rank", "chunk_id", "score")
