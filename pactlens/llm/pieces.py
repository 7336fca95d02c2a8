"""SentencePiece encoding and decoding: a batched Viterbi in numpy over the pieces and scores of a model file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # a code point without piece scores this below the lowest score, then turns into byte pieces
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that every step of the hash can be undone
CACHED_WORDS = 300_000  # a worker's cache of segmented words is emptied before it outgrows this
PAIR_SLOTS_LOG2 = 21  # slots of a worker's cache of verdicts on pairs, 19 MB
LONG_WORD = 128  # runs without a blank that are longer advance by position, as few have their length
CHARS_AT_ONCE = 1 << 22  # texts are taken together up to this many characters, so that words come in large batches
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """The normal pieces of a model as sorted 64-bit hashes of their code points, with ids and scores."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        self.control = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        usable = []
        for i, piece in enumerate(self.texts):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif i not in self.control:
                usable.append(i)
        hashes = np.array([_hash_of(self.texts[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], np.array(usable, dtype=np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in usable], dtype=np.float64)[order]
        bounds = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.first = bounds.astype(np.int32)
        self.most_alike = int(np.diff(bounds, append=len(self.hashes)).max())
        self.begins = np.zeros(1 << 22, dtype=bool)
        self.begins[np.array([h >> 42 for i in usable for h in _prefix_hashes(self.texts[i])], dtype=np.int64)] = True
        self.longest = max(len(self.texts[i]) for i in usable)
        self.unknown_score = float(np.float32(self.scores.min() - UNKNOWN_PENALTY))
        self.lengths = np.array([len(self.texts[i]) for i in self.ids], dtype=np.int64)
        self.code_points = np.zeros((len(self.ids), self.longest), dtype=np.uint32)
        for row, i in enumerate(self.ids.tolist()):
            points = [ord(c) for c in self.texts[i]]
            self.code_points[row, : len(points)] = points
        self.score_of = {self.texts[i]: model.get_score(i) for i in usable}
        self.pair_keys = self.pair_verdicts = None  # made when a pair is asked for, which decoding never does
        self.single_verdicts: dict[tuple[int, int], bool] = {}
        self.steps: dict[tuple[int, int], list[tuple[str, float]] | None] = {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are keys, in rising order, and their places; the upper bits give the place to look from."""
        at = np.minimum(self.first[hashes >> np.uint64(44)], len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        for _ in range(1, self.most_alike):
            later = np.flatnonzero(~same & (self.hashes[at] < hashes) & (at < len(self.hashes) - 1))
            if not len(later):
                break
            at[later] += 1
            same[later] = self.hashes[at[later]] == hashes[later]
        rows = np.flatnonzero(same)
        return rows, at[rows]

    def _text_of(self, token: int) -> str:
        """The text of a token: a piece by its id, or a code point without piece, which is numbered behind the pieces."""
        return "" if token < 0 else self.texts[token] if token < len(self.texts) else chr(token - len(self.texts))

    def stable(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether merging the two tokens' text ends with just these two (or one, where -1 stands before it)."""
        if self.pair_keys is None:
            self.pair_keys = np.full(1 << PAIR_SLOTS_LOG2, -1, dtype=np.int64)
            self.pair_verdicts = np.zeros(1 << PAIR_SLOTS_LOG2, dtype=bool)
        keys = ((before.astype(np.int64) + 1) << 22) | token
        slots = (keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - PAIR_SLOTS_LOG2)
        verdicts = self.pair_verdicts[slots]
        new = np.flatnonzero(self.pair_keys[slots] != keys)
        if len(new):
            fresh, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            found = np.empty(len(fresh), dtype=bool)
            for i, key in enumerate(fresh.tolist()):
                found[i] = self._holds((key >> 22) - 1, key & ((1 << 22) - 1))
            verdicts[new] = found[inverse]
            # One pair a slot: of two that meet in one the later stays, in both arrays.
            self.pair_keys[slots[new][first]] = fresh
            self.pair_verdicts[slots[new][first]] = found
        return verdicts

    def stable_pair(self, before: int, token: int) -> bool:
        """:meth:`stable` of one pair."""
        verdict = self.single_verdicts.get((before, token))
        if verdict is None:
            if len(self.single_verdicts) >= CACHED_WORDS:
                self.single_verdicts.clear()
            verdict = self.single_verdicts[before, token] = self._holds(before, token)
        return verdict

    def _holds(self, before: int, token: int) -> bool:
        """:meth:`stable` of one pair, from the steps in which each of the two merges on its own.

        The sides merge in one order, the best score first and the left side first of equal ones, until a symbol at the end
        of the one and a symbol at the begin of the other merge across the boundary: when that scores more than what is
        next on the left and no less than what is next on the right.
        """
        right = self._steps(token, 0)
        if before < 0 or right is None:
            return right is not None
        left = self._steps(before, -1)
        if left is None:
            return False
        i = j = 0
        while True:
            (end, next_left), (begin, next_right) = left[i], right[j]
            across = self.score_of.get(end + begin, -np.inf)
            if across > next_left and across >= next_right:
                return False
            if next_left == next_right == -np.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _steps(self, token: int, place: int) -> list[tuple[str, float]] | None:
        """Per step in which a token's text merges on its own: the symbol at its end (``place`` -1) or its begin (0) and the
        score of the next merge.  None if that does not give the token."""
        if (token, place) not in self.steps:
            if len(self.steps) >= CACHED_WORDS:
                self.steps.clear()
            parts, steps = list(self._text_of(token)), []
            while parts:
                at, score = _next_merge(parts, self.score_of)
                steps.append((parts[place], score))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.steps[token, place] = steps if len(parts) == 1 else None
        return self.steps[token, place]


def _next_merge(parts: list[str], score_of: dict[str, float]) -> tuple[int, float]:
    """Which neighbours merge next and their score: the best-scored ones, of equals the leftmost; -1 if none do."""
    scores = [score_of.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
    best = max(scores, default=-np.inf)
    return (-1 if best == -np.inf else scores.index(best)), best


def _prefix_hashes(text: str) -> Iterator[int]:
    """The hashes of a text's first character, its first two and so on, up to the whole."""
    total = 0
    for c in text:
        total = ((total + ord(c) + 1) * int(MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
        yield total


def _hash_of(text: str) -> np.uint64:
    total = 0
    for total in _prefix_hashes(text):  # noqa: B007
        pass
    return np.uint64(total)


@lru_cache(maxsize=4)
def word_cache(path: str) -> dict[str, bytes]:
    """The segmented words of a Python worker, which tasks that follow each other in it share."""
    return {}


@lru_cache(maxsize=4)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def viterbi(points: np.ndarray, model: Pieces) -> list[list[int]]:
    """The segmentation of each row of ``points``: words of one length, one code point per column.

    All words advance a column at a time (long ones go through :func:`viterbi_run`).  At column ``start`` the substrings of
    the words that have a path to it are taken end by end, as long as they begin some piece; their hashes (differences of
    prefix hashes) are probed in the sorted piece keys, and a running maximum keeps the best score of each end and the
    start it came from.  A hash that hits is compared with the piece's code points.  Of equal scores the longer last piece
    wins.

    For a unigram model that is the segmentation of highest score.  A merging (BPE) model adds a condition on each
    step: the piece and the one before it must be what merging the two texts gives.  A merge never crosses a boundary
    whose two sides are stable together, so just one path meets the condition everywhere, and it is the model's own
    encoding; whether a pair is stable is found once and remembered.
    """
    return [np.frombuffer(ids, dtype=np.int32).tolist() for ids in _segmented(points, model)]


def _segmented(points: np.ndarray, model: Pieces) -> list[bytes]:
    """:func:`viterbi`, the ids of a word as bytes of 32-bit integers."""
    n, length = points.shape
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    came, token = np.zeros((length + 1, n), dtype=np.int32), np.full((length + 1, n), -1, dtype=np.int32)
    values = points.astype(np.uint64) + np.uint64(1)
    prefix = np.zeros((length + 1, n), dtype=np.uint64)
    for j in range(length):
        prefix[j + 1] = (prefix[j] + values[:, j]) * MULTIPLIER
    powers = [np.uint64(pow(int(MULTIPLIER), k, 1 << 64)) for k in range(model.longest + 1)]
    alone_token = len(model.texts) + points.astype(np.int32)
    for start in range(length):
        rows = np.flatnonzero(best[start] > -np.inf)
        for end in range(start + 1, min(length, start + model.longest) + 1):
            hashes = prefix[end, rows] - prefix[start, rows] * powers[end - start]
            begun = model.begins[hashes >> np.uint64(42)]
            reached, rows, hashes = rows, rows[begun], hashes[begun]
            hit, at = model.find(hashes)
            words = rows[hit]
            same = (model.lengths[at] == end - start) & (model.code_points[at, : end - start] == points[words, start:end]).all(axis=1)
            words, at = words[same], at[same]
            steps = [(words, model.ids[at], best[start, words] + model.scores[at])]
            if start == end - 1:
                alone = np.setdiff1d(reached, words, assume_unique=True)
                steps.append((alone, alone_token[alone, start], best[start, alone] + model.unknown_score))
            for words, tokens, score in steps:
                better = score > best[end, words]
                words, tokens, score = words[better], tokens[better], score[better]
                if model.merges and len(words):
                    good = model.stable(token[start, words], tokens)
                    words, tokens, score = words[good], tokens[good], score[good]
                best[end, words], came[end, words], token[end, words] = score, start, tokens
            if not len(rows):
                break
    return _paths(came, token, points, model)


def _paths(came: np.ndarray, token: np.ndarray, points: np.ndarray, model: Pieces) -> list[bytes]:
    """:func:`_path` of all words of one length, walked back together; those with a code point without piece go one by one."""
    n, length = points.shape
    ids, used, plain = np.zeros((n, length), dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    rows, ends = np.arange(n), np.full(n, length)
    for place in range(length - 1, -1, -1):
        taken = token[ends, rows]
        ids[rows, place] = taken
        used[rows] += 1
        plain[rows[taken >= len(model.texts)]] = False
        ends = came[ends, rows]
        rows, ends = rows[ends > 0], ends[ends > 0]
    whole, width = ids.tobytes(), 4 * length
    found = [whole[end - 4 * k : end] for end, k in zip(range(width, (n + 1) * width, width), used.tolist(), strict=True)]
    for row in np.flatnonzero(~plain).tolist():
        found[row] = np.array(_path(came[:, row], token[:, row], points[row], model), dtype=np.int32).tobytes()
    return found


def viterbi_run(points: np.ndarray, model: Pieces) -> list[int]:
    """:func:`viterbi` of one long word: the substrings of one length are probed at all places together, and only those that
    are pieces take part in the walk from place to place."""
    length = len(points)
    prefix = np.zeros(length + 1, dtype=np.uint64)
    total, factor, mask = 0, int(MULTIPLIER), (1 << 64) - 1
    for j, point in enumerate(points.tolist()):
        total = (total + point + 1) * factor & mask
        prefix[j + 1] = total
    starts, ends, tokens, scores = [], [], [], []
    for width in range(1, min(model.longest, length) + 1):
        hit, at = model.find(prefix[width:] - prefix[:-width] * np.uint64(pow(factor, width, 1 << 64)))
        same = (model.lengths[at] == width) & (model.code_points[at, :width] == points[hit[:, None] + np.arange(width)]).all(axis=1)
        hit, at = hit[same], at[same]
        found = [(hit, model.ids[at], model.scores[at])]
        if width == 1:
            alone = np.setdiff1d(np.arange(length), hit, assume_unique=True)
            found.append((alone, len(model.texts) + points[alone].astype(np.int32), np.full(len(alone), model.unknown_score)))
        for start, token, score in found:
            starts.append(start), ends.append(start + width), tokens.append(token), scores.append(score)
    start, end, token, score = map(np.concatenate, (starts, ends, tokens, scores))
    order = np.lexsort((start, end))
    best, came, last = [-np.inf] * (length + 1), np.zeros(length + 1, dtype=np.int64), [-1] * (length + 1)
    best[0] = 0.0
    for s, e, t, own in zip(*(x[order].tolist() for x in (start, end, token, score)), strict=True):
        reached = best[s] + own
        if reached > best[e] and (not model.merges or model.stable_pair(last[s], t)):
            best[e], came[e], last[e] = reached, s, t
    return _path(came, last, points, model)


def _path(came, token, points, model: Pieces) -> list[int]:
    """The ids of one word, walked back from its end; code points without piece become byte pieces."""
    ids, end = [], len(points)
    while end:
        start = int(came[end])
        if token[end] < len(model.texts):
            ids.append(int(token[end]))
        elif (model.byte_ids >= 0).all():
            ids.extend(reversed(model.byte_ids[list(chr(points[start]).encode())].tolist()))
        elif not ids or ids[-1] != model.unknown:
            ids.append(model.unknown)
        end = start
    return ids[::-1]


def encode_words(words: list[str], model: Pieces) -> dict[str, bytes]:
    """The ids (as bytes of 32-bit integers) of distinct words, batch by batch of equal length."""
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    found = {}
    for length, group in by_length.items():
        if length > LONG_WORD:
            for word in group:
                found[word] = np.array(viterbi_run(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32), model), dtype=np.int32).tobytes()
            continue
        most = max(1, (1 << 20) // (length + 1))  # rows, so that the tables of a batch stay at some tens of MB
        for i in range(0, len(group), most):
            part = group[i : i + most]
            points = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), length)
            found.update(zip(part, _segmented(points, model), strict=True))
    return found


def encode_texts(texts: list[str | None], model: Pieces, cache: dict[str, bytes]) -> list[np.ndarray]:
    """The ids of whole texts.

    Blanks become the space mark and one is put in front, as the model's normalizer has it.  No piece holds a space mark
    behind another character, so a text falls into words at its runs of marks and each distinct word is segmented once.
    """
    split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    words = set().union(*split)
    new = words.difference(cache)
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = words
    cache.update(encode_words(sorted(new), model))
    return [np.frombuffer(b"".join(map(cache.__getitem__, s)), dtype=np.int32) for s in split]


def _slices(batch: pa.RecordBatch, most: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text, one row at least."""
    sizes = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"])])
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def decode_ids(ids: list[int], model: Pieces) -> str:
    """The text of ids: pieces joined, byte pieces as UTF-8, space marks as blanks, the first blank dropped."""
    return _joined(ids, _parts_of(model))


def encoded(docs: DataFrame, key: F.Column, path: str = MODEL) -> DataFrame:
    """``key, ids``: one narrow pass; each task keeps a bounded cache of the words it has segmented.

    Defined cases: a null or empty text has no ids; repeated rows are encoded each; a space mark in a text reads as a
    blank, as the model has it; an empty table gives no rows.
    """
    rows = docs.select(key.alias("key"), docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = pieces(path), word_cache(path)
        for batch in batches:
            for part in _slices(batch):
                ids = encode_texts(part["text"].to_pylist(), model, cache)
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part["key"], lists], ["key", "ids"])

    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("ids", ArrayType(IntegerType()))]))


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``key, text`` of ``key, ids``; null ids give an empty text, null and unknown entries of a list are skipped."""
    rows = tokens.select("key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        parts = _parts_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part["ids"]
                flat = ids.flatten()
                if ids.null_count or flat.null_count or len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(parts):
                    texts = [_joined(x, parts) for x in ids.to_pylist()]
                else:
                    found = list(map(parts.__getitem__, flat.to_numpy().tolist()))
                    bounds = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
                    texts = [b"".join(found[a:b]).decode("utf-8", "replace").removeprefix(" ") for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("text", StringType())]))


def _parts_of(model: Pieces) -> list[bytes]:
    """What each id adds to a text, in UTF-8."""
    parts = [b"" if i in model.control else t.replace(SPACE, " ").encode() for i, t in enumerate(model.texts)]
    parts[model.unknown] = " ⁇ ".encode()
    for byte, i in enumerate(model.byte_ids.tolist()):
        if i >= 0:
            parts[i] = bytes([byte])
    return parts


def _joined(ids: list[int | None] | None, parts: list[bytes]) -> str:
    known = (parts[i] for i in ids or () if i is not None and 0 <= i < len(parts))
    return b"".join(known).decode("utf-8", "replace").removeprefix(" ")
