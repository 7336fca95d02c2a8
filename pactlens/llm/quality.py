"""Quality rules: base counts of a text, and its distance from the character and common-word mix of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from pactlens.llm.common import stored

# Frequent function words, the common-word bins of a language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "this", "are", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "est", "que", "pour", "par", "qui", "sur", "au", "avec", "ce"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
# Verdict: texts shorter than the guards are not judged by the histogram in question.
MIN_CHARS_JUDGED, MAX_CHAR_DISTANCE = 200, 0.25
MIN_WORDS_JUDGED, MAX_DISTANCE_SUM = 60, 0.45
CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "other ascii", "beyond ascii"]
VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
OTHER = "*"  # languages without words of their own; their references are told apart by script
# First bytes of code points beyond ASCII, up to the given one, and their script; ASCII letters are Latin.
SCRIPTS = [(0xC9, "latin"), (0xCD, None), (0xCF, "greek"), (0xD3, "cyrillic"), (0xD5, None), (0xD7, "hebrew"), (0xDF, "arabic"), (0xE0, "indic"), (0xE2, None), (0xE9, "cjk"), (0xED, "hangul"), (0xEF, None), (0xF0, "cjk")]


def _class_of_byte() -> np.ndarray:
    """The character class of each byte that begins a code point; 255 for bytes that continue one."""
    table = np.full(256, CLASSES.index("other ascii"), dtype=np.uint8)
    for name, chars in (
        ("lower", b"abcdefghijklmnopqrstuvwxyz"),
        ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("digit", b"0123456789"),
        ("space", b" \t"),
        ("line", b"\n\r"),
        ("stop", b".,"),
        ("mark", b"!?;:'\"()-"),
        ("symbol", SYMBOLS),
    ):
        table[list(chars)] = CLASSES.index(name)
    table[0x80:0xC0] = 255
    table[0xC0:] = CLASSES.index("beyond ascii")
    return table


CLASS_OF_BYTE = _class_of_byte()


def _scripts() -> dict[str, list[int]]:
    """The bytes that begin a letter of each script."""
    out = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B)]}
    first = 0xC2
    for last, script in SCRIPTS:
        if script:
            out.setdefault(script, []).extend(range(first, last + 1))
        first = last + 1
    return out


LETTERS = _scripts()


def dominant_script(raw: bytes) -> str:
    """The script of most letters of a text; Latin without any."""
    per_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    return max(LETTERS, key=lambda script: per_byte[LETTERS[script]].sum())


def _char_histogram(raw: bytes) -> np.ndarray:
    per_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lead = CLASS_OF_BYTE != 255
    return np.bincount(CLASS_OF_BYTE[lead], weights=per_byte[lead], minlength=len(CLASSES))


def _word_histogram(words: list[bytes], bins: dict[bytes, int]) -> np.ndarray:
    found = Counter(map(bins.get, words))
    missing = found.pop(None, 0)
    out = np.zeros(len(bins) + 1)
    for place, count in found.items():
        out[place] = count
    out[-1] = missing
    return out


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which occurs at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    # Equal windows get equal numbers exactly: pairs of numbers are renumbered, for widths 2, 4 and 8 (or what is left).
    ranks, have = codes, 1
    while have < width:
        step = min(have, width - have)
        pair = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        have += step
        distinct, ranks = np.unique(pair, return_inverse=True)
        if len(distinct) == len(pair):
            return 0
    counts = np.bincount(ranks)
    starts = np.flatnonzero(counts[ranks] > 1)
    if not len(starts):
        return 0
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def _duplicate_lines(raw: bytes) -> int:
    seen, repeats = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            repeats += line in seen
            seen.add(line)
    return repeats


def _bins(lang: str | None) -> dict[bytes, int]:
    return {w.encode(): i for i, w in enumerate(COMMON_WORDS.get(lang, sorted(set().union(*COMMON_WORDS.values()))))}


def _key(lang: str | None) -> str:
    return lang if lang in COMMON_WORDS else OTHER


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: its key as it came, counts and both histograms."""
    bins = {key: _bins(key) for key in (*COMMON_WORDS, OTHER)}
    for batch in batches:
        rows = []
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            words, key = raw.split(), _key(lang)
            chars = _char_histogram(raw)
            gaps = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
            rows.append((
                len(words),
                int(chars.sum()) - gaps,
                int(chars[CLASSES.index("symbol")]),
                _duplicate_lines(raw),
                repeated_words(words),
                key if key != OTHER else f"{OTHER} {dominant_script(raw)}",
                chars,
                _word_histogram(raw.lower().replace(b",", b" ").replace(b".", b" ").split(), bins[key]),
            ))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in MEASURES]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, MEASURES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["key"], *arrays], ["key", *(f.name for f in MEASURES)])


MEASURES = [
    *(pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    pa.field("reference", pa.string()),
    pa.field("char_mix", pa.list_(pa.float64())),
    pa.field("word_mix", pa.list_(pa.float64())),
]


def measured(docs: DataFrame, key: F.Column) -> DataFrame:
    """``key``, the five counts, the reference's name and both histograms of every whole text."""
    rows = docs.select(key.alias("key"), docs["lang"], docs["text"])
    counts = [StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    mixes = [StructField(n, ArrayType(DoubleType())) for n in ("char_mix", "word_mix")]
    return rows.mapInArrow(_measures, StructType([rows.schema["key"], *counts, StructField("reference", StringType()), *mixes]))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def references(measures: DataFrame) -> DataFrame:
    """One row per language: the mean mix of its ordinary texts, each text counting alike whatever its length.

    Texts that fail the base counts do not count.  Of the others the median share of every character class is taken
    first, which a third of junk hardly moves; the means are over the texts near those medians.  A language without
    such texts, whose medians lie between unlike groups, has no reference and is not judged by it.  Sums and quantile
    sketches combine inside each task; what is shuffled is one row per task, language and bin.
    """
    sound = measures.where(~base_failed())

    def shared(rows: DataFrame, column: str, share) -> DataFrame:
        total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
        return (
            rows.where(total > 0)
            .select("reference", F.posexplode(F.transform(column, lambda x: x / total)))
            .groupBy("reference", "pos")
            .agg(share("col").alias("share"))
            .groupBy("reference")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "share"))).alias("bins"))
            .select("reference", F.col("bins.share").alias(f"{column}_reference"))
        )

    medians = shared(sound, "char_mix", lambda x: F.percentile_approx(x, 0.5, 10_000))
    total = F.aggregate("char_mix_reference", F.lit(0.0), lambda a, x: a + x)
    medians = medians.select("reference", F.transform("char_mix_reference", lambda x: x / total).alias("char_mix_reference"))
    near = sound.join(F.broadcast(medians), "reference").where(divergence("char_mix", "char_mix_reference") <= MAX_CHAR_DISTANCE).drop("char_mix_reference")
    return shared(near, "char_mix", F.avg).join(shared(near, "word_mix", F.avg), "reference", "full")


def divergence(mix: str, reference: str) -> F.Column:
    """Jensen-Shannon distance (root of the divergence, base 2, 0 to 1) of two histograms; null for an empty one."""
    total = F.aggregate(mix, F.lit(0.0), lambda a, x: a + x)

    def part(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(mix, reference, lambda x, q: part(x / total, q) + part(q, x / total))
    summed = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0) & F.col(reference).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), summed / 2)))


def judged(
    measures: DataFrame,
    reference: DataFrame,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_distance_sum: float = MAX_DISTANCE_SUM,
    min_chars: int = MIN_CHARS_JUDGED,
    min_words: int = MIN_WORDS_JUDGED,
) -> DataFrame:
    """Counts, both distances, ``base_failed`` and ``kept``.

    ``reference`` has one row per language of :data:`COMMON_WORDS` and one per script for the rest at most, so it is broadcast.
    """
    long_enough = F.col("word_chars") >= min_chars
    many_words = F.col("n_words") >= min_words
    return (
        measures.join(F.broadcast(reference), "reference", "left")
        .withColumn("char_distance", divergence("char_mix", "char_mix_reference"))
        .withColumn("word_distance", divergence("word_mix", "word_mix_reference"))
        .withColumn("base_failed", base_failed())
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & ~(long_enough & (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance))
            & ~(many_words & (F.coalesce(F.col("char_distance") + F.col("word_distance"), F.lit(0.0)) > max_distance_sum)),
        )
        .drop("char_mix", "word_mix", "char_mix_reference", "word_mix_reference", "reference")
    )


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept``.

    One row per row of ``docs`` (``doc_id, text, lang``; further columns are ignored).  A text fails by the base counts,
    or by the mix of its character classes, or that and the mix of common words together, lying too far from its language's
    reference; the guards leave texts alone that are too short for a histogram to mean anything.  Defined cases: a null or empty text has no words
    and fails the base; rows that repeat are judged alike; a text of an unknown or null language is compared with
    such texts of its script; an empty table gives no rows.

    The references cover all documents.  The measures are written once to the shared folder: they are read twice, and a
    text is scanned once.
    """
    measures = stored(measured(docs, F.struct(docs["doc_id"])), "quality")
    return judged(measures, references(measures)).select("key.doc_id", *VERDICT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, in one scan and without a shuffle of texts."""
    measures = stored(measured(docs, F.struct(*(docs[c] for c in docs.columns))), "quality")
    return judged(measures, references(measures)).where("kept").select("key.*")
