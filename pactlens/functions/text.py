"""Column functions over text: cleaning, trimming, keyword tests.  All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens import vocab

# Character classes are spelled out, because Java's \s, \d and $ differ from the ones the patterns were written for.
SPACE = vocab.SPACES
SPACE_IN_LINE = SPACE.replace("\n", "")


def _ranges(chars: str) -> str:
    """The inside of a character class: neighbours above Latin-1 as one range, for a class is tried range by range."""
    codes = sorted(set(map(ord, chars)))
    runs: list[list[int]] = []
    for code in codes:
        if runs and code > 0x100 and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs)


_SPACES, _SPACES_IN_LINE = _ranges(SPACE), _ranges(SPACE_IN_LINE)
# Most characters are none of those looked for; these ranges turn them down before the longer class is tried.
_NO_LETTER = "(?![!-~\u4e00-\u9fff])"
# "." ends at \n only, hence [^\n]; a backslash takes the rest of its line with it when three or more characters follow.
_PLACEHOLDER = r"(?=[_…\\])(?:_{3,}|…{2,}|\\[^\n]{3,}|…_)"
_PLACEHOLDER_X = "X{2,}|x{2,}"
# The repeat is looked for first: few places have one, so the class is seldom tried.
_REPEATED = f"(?s)(.)\\1(?<=[{_ranges(vocab.COLLAPSING_PUNCTUATION + SPACE)}])\\1*"
_NOISE = f"{_NO_LETTER}[{_ranges(vocab.NOISE_SYMBOLS)}]"
# One alternation for the whole text: (?<!..) and (?!..) stand for line start and line end.
_PAGE_MARK = (
    "(?=[第\\-\\p{{Nd}}])(?:第[{s}]*\\p{{Nd}}+[{s}]*页[{s}]*共[{s}]*\\p{{Nd}}+[{s}]*页"
    "|-[{s}]*\\p{{Nd}}+[{s}]*-"
    "|(?<![^\n])\\p{{Nd}}+(?![^\n]))"
).format(s=_SPACES_IN_LINE)
_SHORT_NOISE = f"[{_SPACES_IN_LINE}{vocab.PRIVATE_USE}]{{1,4}}"
_LINE_BREAK = f"{_NO_LETTER}[{_SPACES_IN_LINE}]*\n[{_SPACES}]*"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends; SQL trim takes plain spaces only."""
    return F.btrim(text, F.lit(SPACE))


def keyword_pattern(words: Iterable[str]) -> str:
    """One regular expression that finds any of the words.

    Words that contain another word are left out (the shorter one already hits), shared prefixes are factored, and a
    first-character lookahead lets the matcher skip hopeless positions.  That class is cut into ranges, so that a
    character is compared with its neighbours only.
    """
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    tree: dict = {}
    for word in needed:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})

    def render(node: dict) -> str:
        arms = [_escape(ch) + render(rest) for ch, rest in node.items()]
        return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})" if arms else ""

    if len(tree) == 1:
        return render(tree)
    return f"(?=[{_cut_class(tree)}]){render(tree)}"


def _cut_class(chars: Iterable[str], size: int = 6) -> str:
    """The inside of a class of ``chars``, as ranges that each hold a few of them."""
    chars = sorted(chars)
    if len(chars) <= size:
        return "".join(map(_escape, chars))
    parts = [chars[i : i + size] for i in range(0, len(chars), size)]
    return "".join(f"[{_escape(p[0])}-{_escape(p[-1])}&&[{''.join(map(_escape, p))}]]" for p in parts)


def _escape(ch: str) -> str:
    return ch if ch.isalnum() else f"\\x{{{ord(ch):X}}}"


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where at least one of the words is a substring."""
    return text.rlike(keyword_pattern(words))


def drop_noise_symbols(text: Column) -> Column:
    return F.regexp_replace(text, _NOISE, "")


def drop_placeholders(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _PLACEHOLDER, ""), _PLACEHOLDER_X, "")


def collapse_repeats(text: Column) -> Column:
    """A run of one punctuation or white-space character becomes a single one."""
    return F.regexp_replace(text, _REPEATED, "$1")


def drop_page_marks(text: Column) -> Column:
    """Delete page marks, ``- n -`` and lines of digits only.  Works on a line as well as on a text of many lines."""
    return F.regexp_replace(text, _PAGE_MARK, "")


def squeeze_lines(text: Column) -> Column:
    """One space per run of inline white space, then trim every line and drop the empty ones."""
    squeezed = F.regexp_replace(text, "[ \t\r\f\x0b]+", " ")
    joined = F.regexp_replace(squeezed, _LINE_BREAK, "\n")
    return strip(joined)


def drop_short_noise(text: Column) -> Column:
    """Drop lines of one to four characters that are all white space or private-use symbols."""
    blanked = F.regexp_replace(text, f"(?<![^\n]){_SHORT_NOISE}(?![^\n])", "")
    return F.btrim(F.regexp_replace(blanked, "\n{2,}", "\n"), F.lit("\n"))


def clean_text(raw: Column) -> Column:
    """The whole cleaning chain; null gives the empty text.

    Lines are handled by whole-text patterns instead of split/transform/join: lambda functions over arrays leave
    codegen, these do not.
    """
    text = drop_noise_symbols(F.coalesce(raw, F.lit("")))
    text = collapse_repeats(drop_placeholders(text))
    return drop_short_noise(squeeze_lines(drop_page_marks(text)))


def clean_filename(name: Column) -> Column:
    kept = strip(F.translate(name, vocab.FILENAME_FORBIDDEN, ""))
    return F.when(kept == "", vocab.UNNAMED).otherwise(kept)


def is_noise_line(line: Column) -> Column:
    """Too short after trimming, or short-noise characters only."""
    text = strip(line)
    return (F.length(text) < 5) | text.rlike(f"\\A{_SHORT_NOISE}\\z")


def keep_paragraph(text: Column) -> Column:
    """No drop word and at least one keep word."""
    return ~contains_any(text, vocab.PARAGRAPH_DROP) & contains_any(text, vocab.PARAGRAPH_KEEP)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def skip_file(path: Column) -> Column:
    return contains_any(base_name(path), vocab.FILE_NAME_SKIP)


def in_band(text: Column, band: tuple[int, int]) -> Column:
    return F.length(text).between(*band)


def section_event(line: Column) -> Column:
    """What a line does to the skip state: true starts skipping, false ends it, null leaves it as it is.

    Skip headings are tested before keep headings, and both before the general heading.
    """
    return (
        F.when(is_skip_heading(line), True)
        .when(line.rlike(f"\\A{vocab.SECTION_NUMBER}"), False)
        .otherwise(F.lit(None).cast("boolean"))
    )


def is_skip_heading(line: Column) -> Column:
    """A skip heading; a bare section number counts as one."""
    titles = "|".join(vocab.SECTION_SKIP)
    return line.rlike(f"\\A{vocab.SECTION_NUMBER}[{SPACE}]*(?:{titles}|\\z)")


def is_keep_heading(line: Column) -> Column:
    titles = "|".join(vocab.SECTION_KEEP)
    return line.rlike(f"\\A{vocab.SECTION_NUMBER}[{SPACE}]*(?:{titles})")
