"""The registered queries against their SQL and brute force, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pactlens.llm import packing, quality, queries, simhash, substrings

QUERIES = entry.queries()


def test_one_query_per_operator():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    assert oracle.compare(spark, oracle.connect(tiny), name, QUERIES[name], queries.ORACLES[name], tiny) is None


def test_every_document_comes_back(spark, tiny):
    n = spark.read.parquet(f"{tiny}/documents.parquet").count()
    for name in ("op1_sentencepiece", "op3_quality_rules", "op5_toxicity", "op6_simhash", "op9_suffix_dedup"):
        rows = QUERIES[name](spark, tiny)
        assert rows.count() == n and rows.select("doc_id").distinct().count() == n
    assert QUERIES["op1_sentencepiece"](spark, tiny).where("NOT same_text").isEmpty()


def test_suffix_query_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op9_suffix_dedup"](spark, tiny).collect()}
    seen: set[bytes] = set()
    for doc in docs:
        raw = (doc.text or "").encode()
        strings = [raw[i : i + substrings.WIDTH] for i in range(len(raw) - substrings.WIDTH + 1)]
        gone = bytearray(len(raw))
        for i, s in enumerate(strings):
            if s in seen:
                gone[i : i + substrings.WIDTH] = b"\x01" * substrings.WIDTH
        seen.update(strings)
        row = got[doc.doc_id]
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (row.n_bytes, row.n_removed, row.kept_sha256) == (len(raw), sum(gone), hashlib.sha256(kept).hexdigest())


def test_line_query_finds_copies_of_short_lines(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id IS NOT NULL").collect()
    at = defaultdict(list)
    for doc in docs:
        for i, line in enumerate((doc.text or "").split("\n")):
            at[line.strip(" \t\r\x0b\x0c").lower()].append((doc.doc_id, i))
    want = {p for norm, places in at.items() if norm and len(norm) < 30 and len(places) > 1 for p in places}
    got = {(r.doc_id, r.line_no): (r.keeper_doc, r.keeper_line) for r in QUERIES["op4_line_dedup"](spark, tiny).collect()}
    assert want and want <= set(got)
    table = spark.createDataFrame([(1, "次の文章です。\nOne"), (2, "次の文章です。\none "), (3, " \n \n")], "doc_id long, text string")
    assert [r.text for r in corpus_pipeline.distinct_lines(spark, table, tiny).orderBy("doc_id").collect()] == ["次の文章です。\nOne", "", " \n \n"]


def test_packing_query_has_little_padding(spark, tiny):
    rows = QUERIES["op8_packing"](spark, tiny).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.first("padded_to").alias("padded")).collect()
    assert sum(r.padded for r in rows) <= 1.001 * sum(r.n for r in rows)


def check_lines(before, after):
    """Kept lines are lines of the text in its order; a removed one has a similar line that stayed; no copy stays."""
    kept_lines = defaultdict(set)
    for doc, text in after.items():
        for line in (text or "").split("\n"):
            kept_lines[plain(line)].add(doc)
    parts = {line: {line[i : i + 5] for i in range(max(1, len(line) - 4))} for line in kept_lines}
    removed = 0
    for row in before:
        old, new = (row.text or "").split("\n"), (after[row.doc_id] or "").split("\n")
        rest = iter(old)
        assert new == [""] or all(any(line == other for other in rest) for line in new)
        gone = {plain(x) for x in old if plain(x)} - {plain(x) for x in new}
        removed += len(gone)
        for line in gone - kept_lines.keys():
            own = {line[i : i + 5] for i in range(max(1, len(line) - 4))}
            # A class is a chain of similar lines, so the one that stays may be a little further off.
            assert max(len(own & s) / len(own | s) for s in parts.values()) >= 0.6
    assert removed and all(len(docs) == 1 for line, docs in kept_lines.items() if line)


def plain(line):
    return line.lower().translate({ord(c): " " for c in "\t\r\x0b\x0c"}).strip(" ")


def test_chat_sql_keeps_rows_without_an_id(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (None, 5, "user", "x"), (None, 5, "user", "x"), (None, 1, None, None), (3, 0, "user", "x")]
    path = tmp_path / "t"
    path.mkdir()
    for t in oracle.TABLES:
        (path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (path / "conversations.parquet").unlink()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().astype({"conv_id": "Int64"}).to_parquet(path / "conversations.parquet")
    assert oracle.compare(spark, oracle.connect(str(path)), "op10", QUERIES["op10_chat"], queries.ORACLES["op10_chat"], str(path)) is None


def test_pipeline_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            want = {r.doc_id for r in quality.quality(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "suffix":
            left = {r.doc_id: r.text for r in docs.collect()}
            report = {r.doc_id: r for r in substrings.report(before).collect()}
            assert all(len(left[i].encode()) >= r.n_bytes - r.n_removed for i, r in report.items())
            # Cuts inside a character keep it whole; all other texts are the report's remaining bytes.
            same = [hashlib.sha256(left[i].encode()).hexdigest() == r.kept_sha256 for i, r in report.items()]
            assert all(ok or r.n_removed for ok, r in zip(same, report.values(), strict=True)) and sum(same) >= 0.9 * len(same)
        if name == "lines":
            check_lines(before.collect(), {r.doc_id: r.text for r in docs.collect()})
        if name == "simhash":
            roots = {r.doc_id: r.component_id for r in simhash.classes(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, root in roots.items() if i == root}
        if last:
            texts = {r.doc_id: r.text for r in before.collect()}
            encode = packing.encoder().encode
            for r in docs.collect():
                ids = [*encode(texts[r.doc_id] or "", allowed_special="all"), packing.END_ID]
                piece = b"".join(t.to_bytes(4, "little") for t in ids[r.start : r.start + r.length])
                assert zlib.crc32(piece) == r.ids_crc32
        kept.append(docs.select("doc_id").distinct().count())
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] and kept[3] < kept[2]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x " * 400, "en", "s", 800)]])
def test_pipeline_stages_on_odd_tables(spark, tiny, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() >= 0
