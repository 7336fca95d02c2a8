"""Tokens for features: character bigrams for Han runs, lower-cased words for everything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
_WORD = "[\\p{L}\\p{N}_&&[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]]"
# The lookahead captures the token, then one Han character or one whole word is passed over: pairs overlap, words do not.
_TOKEN = f"(?=({HAN}{{2}}|(?<!{HAN}){HAN}(?!{HAN})|{_WORD}+))(?:{HAN}|{_WORD}+)"
# A word is passed over by what was captured, and a plain letter is told by one comparison.
_LONG_TOKEN = f"(?=([[a-z]{_WORD}]{{2,}}|{HAN}{{2}}))(?:{HAN}|\\1)"
_PAIR = "(?=([^ ]++ [^ ]++))[^ ]++ "


def tokens(text: Column) -> Column:
    """``ARRAY<STRING>`` of tokens in text order.

    A Han run of n characters gives its n-1 bigrams (a run of one gives itself); other runs of letters and digits give
    one lower-cased word each.  One pattern does it all: no lambda over words.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1))


def long_tokens(text: Column) -> Column:
    """The tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(_LONG_TOKEN), F.lit(1))


def pairs_after(words: Column) -> Column:
    """The words, followed by each two neighbours joined with a space; words hold no spaces.

    The pairs are cut out of the joined words by one pattern: a lambda over the words took more than twice as long.
    """
    return F.concat(words, F.regexp_extract_all(F.array_join(words, " "), F.lit(_PAIR), F.lit(1)))
