"""Rule labels as column expressions: a narrow pass over clauses, no shuffle, no Python worker."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions.text import contains_any, in_band, strip


@dataclass(frozen=True)
class RulePack:
    """Phrases per label, and the words that put a clause out of scope.  A pack is a parameter, not code."""

    positive: dict[int, list[str]]
    negative: dict[int, list[str]]
    sections: list[str]
    business: list[str]
    priority: int = 5
    band: tuple[int, int] = vocab.LABEL_BAND


STRICT = RulePack(vocab.STRICT_POSITIVE, vocab.STRICT_NEGATIVE, vocab.STRICT_SECTIONS, vocab.STRICT_BUSINESS)
BASE = RulePack(vocab.BASE_POSITIVE, vocab.BASE_NEGATIVE, vocab.BASE_SECTIONS, vocab.BASE_BUSINESS)


def strict_discard_reason(text: Column, pack: RulePack = STRICT) -> Column:
    """Why a clause is discarded before labelling, or null.  The cheap tests come first."""
    placeholders = F.length(text) - F.length(F.translate(text, vocab.PLACEHOLDER_CHARS, ""))
    return (
        F.when(~in_band(text, pack.band), "length")
        .when(placeholders > F.length(text) * F.lit(vocab.PLACEHOLDER_SHARE), "placeholder")
        .when(contains_any(text, pack.sections), "section")
    )


def in_business(text: Column, pack: RulePack = STRICT) -> Column:
    return contains_any(text, pack.business)


def base_discard(text: Column, pack: RulePack = BASE) -> Column:
    """Length, section words, nothing but filler, or one placeholder at two places."""
    filler = f"\\A[{vocab.PLACEHOLDER_CHARS} ]*\\z"
    twice = f"(?s)({'|'.join(vocab.BASE_REPEATED_PLACEHOLDERS)}).*\\1"
    return ~in_band(text, pack.band) | contains_any(text, pack.sections) | text.rlike(filler) | text.rlike(twice)


def base_scope(text: Column, pack: RulePack = BASE) -> Column:
    """``discard``, ``outside`` (not a business clause) or ``label``."""
    return F.when(base_discard(text, pack), "discard").when(in_business(text, pack), "label").otherwise("outside")


def fires(text: Column, pack: RulePack, label: int) -> Column:
    """Some positive phrase and no negative one; the negatives are looked at only after a hit."""
    return contains_any(text, pack.positive[label]) & ~contains_any(text, pack.negative[label])


def decide(text: Column, pack: RulePack) -> Column:
    """The label of a clause in scope: the priority label wins, two others ask for review, none is label 0."""
    others = [label for label in sorted(pack.positive) if label != pack.priority]
    fired = F.concat(*[F.when(fires(text, pack, label), str(label)).otherwise("") for label in others])
    # Digits of the fired labels, mapped by patterns so that the tests above run once per row.
    other = F.regexp_replace(F.regexp_replace(fired, "\\A..+\\z", "review"), "\\A\\z", "0")
    # One pattern over all positives first: most clauses hit nothing and stop there.
    anything = contains_any(text, [phrase for words in pack.positive.values() for phrase in words])
    return F.when(~anything, "0").when(fires(text, pack, pack.priority), str(pack.priority)).otherwise(other)


def strict_label(text: Column, pack: RulePack = STRICT) -> Column:
    """'0'-'5', 'review' or 'discard'; a clause outside the business is discarded too."""
    out = strict_discard_reason(text, pack).isNotNull() | ~in_business(text, pack)
    return F.when(out, "discard").otherwise(decide(text, pack))


def base_label(text: Column, pack: RulePack = BASE) -> Column:
    """'0'-'5', 'review', 'discard', or null for a clause outside the business."""
    return F.when(base_discard(text, pack), "discard").when(in_business(text, pack), decide(text, pack))


def matched_phrases(text: Column, phrases: list[str]) -> Column:
    """Sorted array of the phrases found in a text."""
    return F.sort_array(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), p) for p in dict.fromkeys(phrases)])))


def tier_label(text: Column, tiers: dict[int, dict[str, list[str]]] = vocab.TIERED_KEYWORDS) -> Column:
    """``STRUCT<label INT, confidence DOUBLE, matched_rules ARRAY<STRING>>``.

    Contract only in the reference; our rule: a high phrase gives 0.9, medium ones alone 0.7, nothing gives label 0 at
    0.5.  Among labels the higher confidence wins, then more hits, then the fixed label priority.
    """
    candidates = []
    for rank, label in enumerate(vocab.LABEL_PRIORITY):
        # Most texts hit few labels: one pattern decides whether the phrases of a label are looked at one by one.
        hit = contains_any(text, [*tiers[label]["high"], *tiers[label]["medium"]])
        high = matched_phrases(text, tiers[label]["high"])
        found = F.sort_array(F.concat(high, matched_phrases(text, tiers[label]["medium"])))
        candidates.append(
            F.when(
                hit,
                F.struct(
                    F.when(F.size(high) > 0, 0.9).otherwise(0.7).alias("confidence"),
                    F.size(found).alias("hits"),
                    F.lit(-rank).alias("order"),
                    F.lit(label).alias("label"),
                    found.alias("matched_rules"),
                ),
            )
        )
    best = F.array_max(F.array(*candidates))
    return F.struct(
        F.coalesce(best["label"], F.lit(0)).alias("label"),
        F.coalesce(best["confidence"], F.lit(0.5)).alias("confidence"),
        F.coalesce(best["matched_rules"], F.array().cast("array<string>")).alias("matched_rules"),
    )


def route(confidence: Column) -> Column:
    return (
        F.when(confidence >= vocab.ROUTE_ACCEPT, "accept")
        .when(confidence >= vocab.ROUTE_REVIEW, "review")
        .otherwise("drop")
    )


def is_contract_clause(text: Column) -> Column:
    """Long enough and at least one contract word."""
    return (F.length(text) >= vocab.CONTRACT_MIN_LENGTH) & contains_any(text, vocab.CONTRACT_WORDS)


def valid_label(label: Column) -> Column:
    """True for the six label ids as text; null and other values are false."""
    return F.coalesce(label.isin(*[str(i) for i in range(vocab.NUM_LABELS)]), F.lit(False))


def synthetic_ok(text: Column, label: Column) -> Column:
    """A generated row is usable: text of the asked length and a label id of the system."""
    return F.coalesce(in_band(strip(text), vocab.SYNTHETIC_BAND), F.lit(False)) & valid_label(label)
