"""Documents: pages to lines, repeated lines, section state, surviving text, clauses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import vocab
from pactlens.functions import rules, text
from pactlens.operators.frames import once, stored
from pactlens.operators.scan import SEGMENT_BITS, carried, in_segments, last_event, upto

# Lines of a file are ordered by one BIGINT: page number in the upper 32 bits, line number in the lower ones.
PAGE_BITS = 32


def explode_lines(df: DataFrame, source: str = "text", pos: str = "pos", line: str = "line") -> DataFrame:
    """One row per line, numbered from 0; other columns are kept."""
    others = [c for c in df.columns if c != source]
    return df.select(*others, F.posexplode(F.split(F.col(source), "\n")).alias(pos, line))


def assemble_pages(pages: DataFrame, clean: bool = False) -> DataFrame:
    """``file, page_no, text``: the pieces of a file's text, to be read in page order with a newline between.

    Blank pages are left out.  Without ``clean`` a failed page leaves a warning piece; with it every page runs through the
    cleaning chain and a file with a failed page has no pieces at all, as its reading fails.  The text of a file stays
    rows, whatever its size; ``file_status`` tells which files have none, ``write_joined`` writes the texts.
    """
    if clean:
        pages = readable(pages)
    raw = F.coalesce(F.col("text"), F.lit(""))
    body = text.clean_text(raw) if clean else raw
    warning = F.format_string("\n[警告] 第%d页文本抽取失败: %s\n", F.col("page_no"), F.col("error"))
    piece = F.when(F.col("error").isNotNull(), warning).otherwise(body)
    pieces = pages.select("file", "page_no", "error", piece.alias("text"))
    return pieces.filter(F.col("error").isNotNull() | (text.strip(F.col("text")) != "")).drop("error")


def file_status(pages: DataFrame, clean: bool = False) -> DataFrame:
    """``file, status``: ``ok``, ``no_text`` where no page has any, and with ``clean`` ``failed`` where a page failed.

    A maximum per file, which combines before the shuffle.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    some = text.strip(text.clean_text(raw) if clean else raw) != ""
    failed = F.col("error").isNotNull()
    found = pages.groupBy("file").agg(F.max(failed).alias("failed"), F.max(some | (F.lit(not clean) & failed)).alias("some"))
    status = F.when(F.lit(clean) & F.col("failed"), "failed").when(F.col("some"), "ok").otherwise("no_text")
    return found.select("file", status.alias("status"))


def readable(pages: DataFrame) -> DataFrame:
    """The pages of files without a failed page: one that fails gives no rows.  Failed files are one row each."""
    failed = pages.filter(F.col("error").isNotNull()).select("file").distinct()
    return pages.join(failed, "file", "left_anti")


def page_lines(pages: DataFrame, clean: bool = True) -> DataFrame:
    """``file, pos, line`` straight from the pages of readable files: no file is ever assembled into one value."""
    body = text.clean_text(F.col("text")) if clean else F.col("text")
    lines = readable(pages).select("file", "page_no", F.posexplode(F.split(body, "\n")).alias("n", "line"))
    return lines.select("file", page_pos(F.col("page_no"), F.col("n")).alias("pos"), "line")


def marked_page_lines(pages: DataFrame) -> DataFrame:
    """``file, pos, line, failed``: the cleaned lines of all pages, and one row without place and line for each failed page.

    What follows drops the files with such a mark where it orders their lines, so the pages are read once.
    """
    failed = F.col("error").isNotNull()
    body = F.when(~failed, text.clean_text(F.col("text")))
    lines = pages.select("file", "page_no", failed.alias("failed"), F.posexplode_outer(F.split(body, "\n")).alias("n", "line"))
    return lines.select("file", page_pos(F.col("page_no"), F.col("n")).alias("pos"), "line", "failed")


def write_joined(pieces: DataFrame, path: str, order: str, source: str = "text", separator: str = "\n") -> None:
    """Text files in which the pieces of a file stand in order; range partitioning lets one file span several."""
    ordered = pieces.repartitionByRange("file", order).sortWithinPartitions("file", order)
    ordered.select(F.col(source).alias("value")).write.option("lineSep", separator).text(path)


def page_pos(page: Column, line: Column) -> Column:
    return F.shiftleft(page.cast("bigint"), PAGE_BITS) + line


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """Trimmed nonempty lines, each only where it first occurs in its file.

    A minimum per (file, line) instead of a row number: it combines before the shuffle, so a header repeated on a
    billion pages is one row per task.
    """
    trimmed = lines.select("file", text.strip(F.col("line")).alias("line"), "pos").filter(F.col("line") != "")
    return trimmed.groupBy("file", "line").agg(F.min("pos").alias("pos")).select("file", "pos", "line")


def wanted_lines(lines: DataFrame) -> DataFrame:
    """``file, pos, line, event, relevant, failed``: the trimmed lines that can count, each only where it first occurs in its file.

    Those are section events, relevant lines, and the marks of failed files; whether a line counts depends on the line alone,
    so all others go before the shuffle, and the patterns run once.
    """
    failed = F.col("failed") if "failed" in lines.columns else F.lit(False)
    trimmed = lines.select("file", "pos", text.strip(F.col("line")).alias("line"), failed.alias("failed"))
    line = F.col("line")
    relevant = text.keep_paragraph(line) & ~text.is_keep_heading(line)
    marked = once(trimmed.filter(F.col("failed") | (line != "")), {"event": text.section_event(line), "relevant": F.coalesce(relevant, F.lit(False))})
    counting = marked.filter(F.col("failed") | F.col("event").isNotNull() | F.col("relevant"))
    return counting.groupBy("file", "line", "event", "relevant", "failed").agg(F.min("pos").alias("pos"))


def with_section_state(lines: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Adds ``skipping``: whether the last section event at or before a line turned skipping on.

    Inside a segment the last event comes from a window, at its start from one row per segment and file.
    """
    tagged = in_segments(lines.withColumn("event", text.section_event(F.col("line"))), "file", "pos", segment_bits=segment_bits)
    inside = F.last("event", ignorenulls=True).over(upto("file", 0))
    rows = stored(tagged.withColumn("inside", inside), "section-lines")
    summary = rows.groupBy("file", "segment").agg(last_event("event").alias("event"))
    state = carried(summary, "file", {"before": F.last("event", ignorenulls=True)})
    return rows.join(state, ["file", "segment"], "left").select(
        *lines.columns, F.coalesce("inside", "before", F.lit(False)).alias("skipping")
    )


def section_lines(lines: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Lines outside skipped sections, without the skip and keep headings themselves."""
    # A skip heading turns skipping on at its own line, so only keep headings need a test of their own.
    stated = with_section_state(lines, segment_bits)
    return stated.filter(~F.col("skipping") & ~text.is_keep_heading(F.col("line"))).drop("skipping")


def _counted_lines(marked: DataFrame, segment_bits: int) -> DataFrame:
    """The lines of :func:`wanted_lines` that count, with ``segment`` and ``base``, the clause separators before each in its file.

    Which lines count depends on the section state at the start of the segment, so a segment keeps two totals: lines that
    count in any case, and lines before its first section event, which count only when the state carried in is off.  The
    mark of a failed file has no position and comes first, so it is carried like an event.
    """
    rows = in_segments(marked, "file", "pos", segment_bits=segment_bits)
    cuts = F.when(F.col("relevant"), F.size(F.split("line", vocab.CLAUSE_SEPARATOR)) - 1).otherwise(0).cast("bigint")
    rows = rows.withColumns({
        "cuts": cuts,
        "inside": F.last("event", ignorenulls=True).over(upto("file", 0)),
        "broken": F.max("failed").over(upto("file", 0)),
    })
    rows = rows.withColumns({
        "sure": F.when(F.col("inside") == F.lit(False), F.col("cuts")).otherwise(0),
        "open": F.when(F.col("inside").isNull(), F.col("cuts")).otherwise(0),
    })
    running = {f"{c}_before": F.coalesce(F.sum(c).over(upto("file", -1)), F.lit(0)) for c in ("sure", "open")}
    rows = stored(rows.withColumns(running).drop("cuts", "failed"), "contract-lines")
    summary = rows.groupBy("file", "segment").agg(
        last_event("event").alias("event"), F.sum("sure").alias("sure"), F.sum("open").alias("open"), F.max("broken").alias("broken")
    )
    skips = F.coalesce("skips", F.lit(False))
    state = carried(
        summary,
        "file",
        {"skips": F.last("event", ignorenulls=True), "broke": F.max("broken")},
        {"offset": F.sum(F.col("sure") + F.when(skips, 0).otherwise(F.col("open")))},
    )
    kept = rows.join(state, ["file", "segment"], "left").filter(
        F.col("relevant") & ~F.coalesce("inside", "skips", F.lit(False)) & ~F.col("broken") & ~F.coalesce("broke", F.lit(False))
    )
    base = F.coalesce("offset", F.lit(0)) + F.col("sure_before") + F.when(skips, 0).otherwise(F.col("open_before"))
    return kept.select("file", "segment", "pos", "line", base.alias("base"))


def contract_lines(lines: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The lines that make up the contract body: first occurrences, outside skipped sections, relevant by keyword."""
    return _counted_lines(wanted_lines(lines), segment_bits).select("file", "pos", "line")


def join_lines(lines: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``file, pos, place, text``: the lines of a file as pieces of one text, with the character each begins at.

    The joined text is the pieces in ``pos`` order with a space between; ``write_joined`` writes it, and
    ``contract_clauses`` numbers clauses over the whole file without joining it.  ``place`` is a segmented scan of lengths.
    """
    rows = in_segments(lines.select("file", "pos", "line"), "file", "pos", segment_bits=segment_bits)
    rows = rows.withColumn("size", F.length("line") + F.lit(1).cast("bigint"))
    rows = stored(rows.withColumn("inside", F.coalesce(F.sum("size").over(upto("file", -1)), F.lit(0))), "joined-lines")
    state = carried(rows.groupBy("file", "segment").agg(F.sum("size").alias("size")), "file", {"offset": F.sum("size")})
    place = F.col("inside") + F.coalesce("offset", F.lit(0))
    return rows.join(state, ["file", "segment"], "left").select("file", "pos", place.alias("place"), F.col("line").alias("text"))


def split_clauses(df: DataFrame, source: str = "text", band: tuple[int, int] | None = vocab.CLAUSE_BAND) -> DataFrame:
    """Pieces between numbering marks and full-width semicolons, trimmed, of a length in the band."""
    return _pieces(df, source, vocab.CLAUSE_SEPARATOR, lambda c: text.in_band(c, band) if band else F.lit(True))


def split_sentences(
    df: DataFrame, source: str = "text", pattern: str | None = None, min_length: int | None = None
) -> DataFrame:
    """Pieces between full stops, semicolons and newlines, trimmed, of at least ``min_length`` characters.

    Contract only in the reference.  An empty pattern or a length of 0 means the default.
    """
    least = min_length or vocab.MIN_SENTENCE
    return _pieces(df, source, pattern or vocab.SENTENCE_SEPARATOR, lambda c: F.length(c) >= least)


def _pieces(df: DataFrame, source: str, pattern: str, keep: Callable[[Column], Column]) -> DataFrame:
    others = [c for c in df.columns if c != source]
    pieces = df.select(*others, F.posexplode(F.split(F.col(source), pattern)).alias("piece", "clause"))
    return pieces.withColumn("clause", text.strip(F.col("clause"))).filter(keep(F.col("clause")))


def contract_clauses(
    lines: DataFrame,
    band: tuple[int, int] = vocab.CLAUSE_BAND,
    segment_bits: int = SEGMENT_BITS,
    select_lines: bool = True,
) -> DataFrame:
    """``file, clause_no, clause``: what splitting the joined text of a file gives, without joining it.

    With ``select_lines`` repeated lines, skipped sections and irrelevant lines are left out first, as in
    ``contract_lines``; a file with a line marked ``failed`` gives no clause.  Without, ``lines`` must be trimmed and nonempty.

    No separator spans two lines, so a clause is the run of line fragments with the same number of separators before
    them; that number is a segmented scan.
    """
    if select_lines:
        marked = wanted_lines(lines)
    else:
        marked = lines.select("file", "pos", "line", F.lit(None).cast("boolean").alias("event"), F.lit(True).alias("relevant"), F.lit(False).alias("failed"))
    counted = _counted_lines(marked, segment_bits)
    fragments = counted.select(
        "file", "segment", "pos", "base", F.posexplode(F.split("line", vocab.CLAUSE_SEPARATOR)).alias("k", "raw")
    ).select("file", "segment", "pos", (F.col("base") + F.col("k")).alias("clause_no"), text.strip(F.col("raw")).alias("f"))
    return _gather_clauses(fragments.filter(F.col("f") != ""), band)


def _gather_clauses(fragments: DataFrame, band: tuple[int, int]) -> DataFrame:
    """Clauses from ``file, segment, pos, clause_no, f``.

    Gathered first per segment; a part that is already too long there goes on as a length without text, so no group ever
    grows beyond a segment.
    """
    in_segment = fragments.groupBy("file", "segment", "clause_no").agg(
        F.sum(F.length("f")).alias("chars"),
        F.count("*").alias("n"),
        F.collect_list(F.struct("pos", "f")).alias("parts"),
    )
    small = F.when(F.col("chars") <= band[1], F.col("parts"))
    whole = in_segment.groupBy("file", "clause_no").agg(
        (F.sum("chars") + F.sum("n") - 1).alias("size"),
        F.sort_array(F.flatten(F.collect_list(small))).alias("parts"),
    )
    return whole.filter(F.col("size").between(*band)).select(
        "file", "clause_no", F.array_join(F.transform("parts", lambda p: p["f"]), " ").alias("clause")
    )


def stamp_samples(clauses: DataFrame) -> DataFrame:
    """Adds the constant confidence and source of parsed samples."""
    return clauses.withColumns(
        {"confidence": F.lit(vocab.DEFAULT_CONFIDENCE), "source": F.lit(vocab.SAMPLE_SOURCE)}
    )


def contract_samples(
    lines: DataFrame, pack: rules.RulePack = rules.BASE, segment_bits: int = SEGMENT_BITS
) -> DataFrame:
    """Cleaned lines of contract files to labelled samples ``file, clause_no, text, label, confidence, source``."""
    usable = lines.filter(~text.skip_file(F.col("file")) & known_format(F.col("file")))
    clauses = contract_clauses(usable, segment_bits=segment_bits)
    labelled = clauses.select(
        "file", "clause_no", F.col("clause").alias("text"), rules.base_label(F.col("clause"), pack).alias("label")
    )
    return stamp_samples(labelled)


def known_format(path: Column) -> Column:
    return F.lower(text.base_name(path)).rlike(r"\.(pdf|docx|doc)\z")
