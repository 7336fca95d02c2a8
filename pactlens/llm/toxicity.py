"""Toxicity by a factorization machine over hashed terms, which learns pairs of terms as well as single ones."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of

SLOTS_LOG2 = 20
FACTORS = 8
MAX_TRAINING_ROWS = 8_000  # the bound on labelled rows that a model is fitted on, drawn by a hash of their ids
STEMS = (4, 6)
RATE_SCALE, SMOOTHING, MOST_VALUE = 100, 20, 2.0
MIN_ROWS_WITH_TERM = 10  # terms in fewer training rows are left out
EPOCHS = 14
LEARNING_RATE = 0.08
DECAY = 0.02
FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.3
_STRIPPED = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Model:
    """Weights by slot: ``slots`` is sorted, ``w`` holds one weight and ``v`` FACTORS factors per slot."""

    bias: float
    slots: np.ndarray
    w: np.ndarray
    v: np.ndarray


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashed slots of a whole text, sorted, and the value of each.

    Terms are the ASCII-lowered words without marks at their ends, and the stems (the first STEMS bytes) of longer
    words, so that the forms of an inflected word share what is learned.  A value is the root of the term's rate, so
    that a phrase means about the same in a short and in a long text.
    """
    words = Counter(text.encode().lower().split()) if text else {}
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    forms, counts = [w.strip(_STRIPPED) for w in words], list(words.values())
    for size in STEMS:
        long = [(b"^" + w[:size], n) for w, n in zip(forms[: len(words)], counts[: len(words)], strict=True) if len(w) > size]
        forms += [stem for stem, _ in long]
        counts += [n for _, n in long]
    hashed = np.fromiter(map(zlib.crc32, forms), dtype=np.int64, count=len(forms)) & ((1 << SLOTS_LOG2) - 1)
    slots, inverse = np.unique(hashed, return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    return slots, np.minimum(np.sqrt(RATE_SCALE * total / (sum(words.values()) + SMOOTHING)), MOST_VALUE)


def _sum_by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (entries, ...) by ``rows`` (sorted)."""
    out = np.zeros((n, *values.shape[1:]), dtype=np.float64)
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


Bag = tuple[np.ndarray, np.ndarray]


def _flat(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every entry of the bags."""
    if not bags:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags]), np.concatenate([s for s, _ in bags]), np.concatenate([x for _, x in bags])


def margins(model: Model, bags: list[Bag]) -> np.ndarray:
    """The log odds of each bag: bias, weights times values, and for every pair of terms the product of their factors."""
    n = len(bags)
    rows, slots, values = _flat(bags)
    at = np.searchsorted(model.slots, slots)
    known = at < len(model.slots)
    known[known] = model.slots[at[known]] == slots[known]
    rows, at, values = rows[known], at[known], values[known]
    xv = model.v[at] * values[:, None]
    pairs = 0.5 * (_sum_by_row(xv, rows, n) ** 2 - _sum_by_row(xv * xv, rows, n)).sum(axis=1)
    return model.bias + _sum_by_row(model.w[at] * values, rows, n) + pairs


def fit(bags: list[Bag], labels: np.ndarray, seed: int = 7) -> Model:
    """A factorization machine by AdaGrad over mini-batches; the rarer class weighs up to three times as much.

    Without rows of both classes the model is its bias.
    """
    labels = np.asarray(labels, dtype=np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rows, slots, values = _flat(bags)
    frequent = np.flatnonzero(np.bincount(slots, minlength=1 << SLOTS_LOG2) >= MIN_ROWS_WITH_TERM)
    random = np.random.default_rng(seed)
    model = Model(prior, frequent, np.zeros(len(frequent)), random.normal(0, 0.01, (len(frequent), FACTORS)))
    if not 0 < share < 1 or not len(frequent):
        return Model(prior, frequent, model.w, np.zeros_like(model.v))
    places = np.full(1 << SLOTS_LOG2, -1, dtype=np.int64)
    places[frequent] = np.arange(len(frequent))
    used = places[slots] >= 0
    rows, slots, values = rows[used], places[slots[used]], values[used]
    bounds = np.searchsorted(rows, np.arange(len(bags) + 1))
    weight = np.where(labels == 1, min(3.0, (1 - share) / share), 1.0)
    seen_w, seen_v, seen_b = np.full(len(frequent), 1e-6), np.full((len(frequent), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(bags))
        for begin in range(0, len(order), 64):
            batch = order[begin : begin + 64]
            entries = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in batch])
            of, at, x = np.repeat(np.arange(len(batch)), bounds[batch + 1] - bounds[batch]), slots[entries], values[entries]
            xv = model.v[at] * x[:, None]
            total = _sum_by_row(xv, of, len(batch))
            z = model.bias + _sum_by_row(model.w[at] * x, of, len(batch)) + 0.5 * (total**2 - _sum_by_row(xv * xv, of, len(batch))).sum(axis=1)
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch])
            slot, inverse = np.unique(at, return_inverse=True)
            by_slot = np.argsort(inverse, kind="stable")
            g_w = _sum_by_row((error[of] * x)[by_slot], inverse[by_slot], len(slot)) + DECAY * len(batch) * model.w[slot]
            g_v = _sum_by_row((error[of] * x)[by_slot, None] * (total[of] - xv)[by_slot], inverse[by_slot], len(slot)) + DECAY * len(batch) * model.v[slot]
            seen_w[slot] += g_w**2
            seen_v[slot] += g_v**2
            model.w[slot] -= LEARNING_RATE * g_w / np.sqrt(seen_w[slot])
            model.v[slot] -= 0.25 * LEARNING_RATE * g_v / np.sqrt(seen_v[slot])
            seen_b += error.sum() ** 2
            model.bias -= LEARNING_RATE * error.sum() / np.sqrt(seen_b)
    return model


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled rows outside the held-out fold.

    The ids are drawn first, as the smallest of a hash; only these few go to the documents, never texts to the labels.
    A document with several labels counts as toxic if one says so; unlabelled and null rows are not drawn.
    """
    drawn = (
        columns_of(labels, "doc_id", "toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold(F.col("doc_id")) != HELD_OUT_FOLD)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = columns_of(docs, "doc_id", "text")
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")


def _fit_all(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id")
    bags = [(np.asarray(s, dtype=np.int64), np.asarray(x)) for s, x in zip(rows["slots"], rows["x"], strict=True)]
    model = fit(bags, rows["toxic"].to_numpy())
    used = (np.abs(model.w) > 1e-4) | (np.abs(model.v) > 1e-3).any(axis=1)
    weights = pd.DataFrame({"slot": model.slots[used], "w": model.w[used], "v": list(model.v[used])})
    return pd.concat([pd.DataFrame({"slot": [-1], "w": [model.bias], "v": [np.zeros(FACTORS)]}), weights], ignore_index=True)


def trained(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """The model of the bounded sample; texts become slots where they lie, one task fits, the driver gets the weights.

    Weights are at most 2 ** SLOTS_LOG2 slots, and in fact no more than the sample has frequent terms.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [terms(t) for t in batch["text"]]
            content = [zlib.crc32(s.tobytes() + x.tobytes()) for s, x in bags]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "content": content, "slots": [s for s, _ in bags], "x": [x for _, x in bags]})

    sample = training_rows(docs, labels, most).mapInPandas(hashed, "doc_id long, toxic int, content long, slots array<long>, x array<double>")
    # An id may have any number of texts; the smallest content stands for it, so that the fitting task gets ``most`` rows.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("content", "slots", "x", "toxic")).alias("row")).select("doc_id", "row.*")
    rows = sample.groupBy(F.lit("all").alias("one")).applyInPandas(_fit_all, "slot long, w double, v array<double>").toPandas()
    if not len(rows):
        return Model(-9.0, np.empty(0, dtype=np.int64), np.empty(0), np.empty((0, FACTORS)))
    rows = rows.sort_values("slot").reset_index(drop=True)
    weights = rows.iloc[1:]
    v = np.stack(weights["v"].to_list()) if len(weights) else np.empty((0, FACTORS))
    return Model(float(rows["w"][0]), weights["slot"].to_numpy(np.int64), weights["w"].to_numpy(np.float32), v.astype(np.float32))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text; one narrow pass, the weights are sent once per executor.

    Defined cases: a null or empty text scores the bias; a null ``doc_id`` is not held out; repeated rows score alike; an
    empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 128):
                bags = [terms(t.as_py()) for t in batch["text"].slice(at, 128)]
                out.append(1 / (1 + np.exp(-np.clip(margins(shared.value, bags), -30, 30))))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = columns_of(docs, "doc_id", "text")
    result = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    return result.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` by a model that learned from ``labels`` outside the held-out fold; see :func:`scored`."""
    return scored(docs, trained(docs, labels))
