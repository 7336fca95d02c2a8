"""The operators against brute force, exact round trips and library results, and their defined cases."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactlens.llm import chat, covertree, lines, packing, pieces, quality, simhash, substrings, toxicity, warc
from pactlens.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars int, kept string, print string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls, empty, blank and long texts, copies, near copies, ties, ids that repeat, columns with clashing names."""
    base = prose(1, 120)
    near = base.replace("alpha", "alpine", 1)
    texts = [base, near, base, None, "", "   ", "short", prose(2, 400) + "\n" + base[:200], prose(3, 5000), "日本語の文章です。" * 20, "x" * 3000, prose(4, 60) + "\n\n" + prose(4, 60)]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "k", "p") for i, t in enumerate(texts)]
    return [*rows, (5, base, "en", "s", 1, "k", "p"), (5, base, "en", "s", 1, "k", "p"), (None, base, "en", None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- components -------------------------------------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500), (None, 3)]
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((up(a), up(b)))
            root[y] = x
    assert found == {n: up(n) for n in root if up(n) != n}


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.encoded(docs, F.struct("doc_id", "text"))
    for row in rows.collect():
        assert row.ids == (library.encode(row.key.text) if row.key.text else [])
    for row in pieces.decoded(rows).collect():
        assert row.text == (row.key.text or "")
    odd = ["a  b   c", " lead", "trail ", "é̀漢字😀", "<s> </s> <unk> <0x41>", "aaaaaaaaaaaaaaaa" * 9, "\t\r\n", "a▁b", "ß" * 700]
    for text in odd:
        assert pieces.encode_texts([text], pieces.pieces(), {})[0].tolist() == library.encode(text)


def test_long_runs_equal_the_library_and_the_batched_walk():
    import sentencepiece

    library, model, r = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.pieces(), random.Random(9)
    runs = ["".join(r.choice(["the", "ing", "é", "漢", "x", "aa", "Ünter", "😀", "0", "http://"]) for _ in range(n)) for n in (60, 150, 4000)]
    for run in [*runs, "a" * 3000, "ab" * 900]:
        assert pieces.encode_texts([run], model, {})[0].tolist() == library.encode(run)
        points = np.frombuffer((pieces.SPACE + run[:700]).encode("utf-32-le"), dtype=np.uint32)
        for merges in (True, False):
            model.merges = merges
            assert pieces.viterbi_run(points, model) == pieces.viterbi(points[None], model)[0]
        model.merges = True


def test_word_cache_stays_within_its_bound(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 10)
    model, cache = pieces.Pieces(), {}
    for n in range(5):
        text = " ".join(f"w{n}x{i}" for i in range(7))
        assert pieces.decode_ids(pieces.encode_texts([text], model, cache)[0].tolist(), model) == text
        assert len(cache) <= 10
    assert pieces.Pieces().pair_keys is None


def test_pairs_hold_as_merging_their_text_says():
    model, r = pieces.Pieces(), random.Random(3)

    def merged(text):
        parts = list(text)
        while True:
            found = [model.score_of.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            if max(found, default=-np.inf) == -np.inf:
                return parts
            at = found.index(max(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    short = [i for i in model.ids.tolist() if len(model.texts[i]) <= 3]
    for n in range(6000):
        left, right = (r.choice(short if n % 2 else model.ids.tolist()) for _ in range(2))
        if n % 50 == 0:
            left = len(model.texts) + ord("𝛀")
        if n % 70 == 0:
            left = -1
        pair = [model._text_of(i) for i in (left, right) if i >= 0]
        assert model._holds(left, right) == (merged("".join(pair)) == pair), pair


def test_only_substrings_that_begin_a_piece_are_probed(monkeypatch):
    model, probed = pieces.Pieces(), []
    find = pieces.Pieces.find
    monkeypatch.setattr(pieces.Pieces, "find", lambda self, hashes: probed.append(len(hashes)) or find(self, hashes))
    word = pieces.SPACE + "qzxjkvwqzx" * 5
    ids = pieces.encode_words([word], model)[word]
    starting = {t[:n] for t in model.score_of for n in range(1, len(t) + 1)}
    assert sum(probed) <= sum(word[a:b] in starting for a in range(len(word)) for b in range(a + 1, len(word) + 1)) + 10
    assert pieces.decode_ids(np.frombuffer(ids, dtype=np.int32).tolist(), model) == word[1:]


def test_viterbi_finds_the_highest_score():
    model = pieces.Pieces()
    model.merges = False
    for word in ["▁the", "▁understanding", "▁aaaa", "▁日x", "▁internationalization"]:
        best = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                score = model.score_of.get(word[start:end], model.unknown_score if start == end - 1 else -np.inf)
                best[end] = max(best[end], best[start] + score)
        ids = np.frombuffer(pieces.encode_words([word], model)[word], dtype=np.int32).tolist()
        seen = [i for i in ids if i not in set(model.byte_ids.tolist())]
        unknown = sum(c not in model.score_of for c in word)
        assert sum(model.score_of[model.texts[i]] for i in seen) + unknown * model.unknown_score == pytest.approx(best[-1])


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 40
    pages = [(3, "http://a/ b\n", long, 1), (1, "http://b", long, 1), (7, None, long, 1), (2, "http://c", "tiny", 1), (4, "http://c", "tiny", 1), (5, "u", None, 1), (None, "u", long, 1), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20, 1)]
    rows = warc.round_trip(spark, spark.createDataFrame(pages, "page_id long, url string, html string, length int")).collect()
    assert len(rows) == len(pages)
    by_id = {r.page_id: r for r in rows}
    for page_id, _, html, _ in pages:
        raw = (html or "").encode()
        row = by_id[page_id]
        assert (row.payload_bytes, row.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = page_id in (3, 7)
        assert (row.record_type, row.refers_to) == (("revisit", 1) if again else ("response", None))
    assert by_id[3].url == "http://a/%20b%0A"
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reads_selected_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", prose(i, 300)) for i in range(60)], "page_id long, url string, html string").coalesce(2)
    index = warc.write_archives(warc.record_plan(pages), str(tmp_path), archive_bytes=4000)
    assert index.select("archive").distinct().count() > 5
    got = warc.read_records(index.where("page_id % 7 = 3"), str(tmp_path), gap=100).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: prose(i, 300) for i in range(60) if i % 7 == 3}


# --- 3 ----------------------------------------------------------------------------------------------------------------


def base_counts(text: str | None) -> tuple:
    blanks = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(blanks):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_counts(docs, none, spark):
    odd = ["a b c d e f g h " * 5, "x\x0by\x0cz\x1ft\xa0u", "l1 w\nl1 w\n\n \nl1 w", "#*$ %&|<> é", "one two three four five six seven eight nine " * 2]
    rows = [(100 + i, t, "fr", "s", 1, None, None) for i, t in enumerate(odd)]
    table = docs.union(spark.createDataFrame(rows, DOCS))
    want = sorted((str(r.doc_id), *base_counts(r.text)) for r in table.collect())
    got = quality.quality(table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(none).count() == 0


def test_quality_separates_junk(spark, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    got = quality.quality(table).join(spark.read.parquet(f"{tiny}/labels.parquet"), "doc_id").where("NOT base_failed AND n_words >= 60").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.35
    assert quality.keep_good(table).columns == table.columns


def test_quality_references_withstand_junk_and_scripts(spark):
    r = random.Random(9)
    russian = "и в не на я быть он с что это по к но они мы она как то который из год человек время рука дело".split()
    clean = [(i, prose(3000 + i, 120), "en") for i in range(40)]
    junk = [(100 + i, " ".join(f"{r.randrange(10**4)} {r.choice(WORDS)}" for _ in range(60)), "en") for i in range(20)]
    mixed = [(200 + i, prose(4000 + i, 120) if i % 2 else " ".join(r.choice(russian) for _ in range(150)), None) for i in range(40)]
    kept = {x.doc_id for x in quality.quality(spark.createDataFrame(clean + junk + mixed, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == {i for i, *_ in clean + mixed}


def test_divergence_is_a_distance(spark):
    row = spark.createDataFrame([([4.0, 0.0], [1.0, 0.0], [0.0, 1.0])], "m array<double>, same array<double>, other array<double>")
    same, other = row.select(quality.divergence("m", "same"), quality.divergence("m", "other")).first()
    assert same == pytest.approx(0) and other == pytest.approx(1)


# --- 4 ----------------------------------------------------------------------------------------------------------------


def shingles(line: str) -> set[str]:
    width = lines.SHINGLE_CHARS
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def alike(a: str, b: str) -> float:
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_similar_lines_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for i in range(40):
        words = prose(1000 + i, 40).split()
        for _ in range(r.choice([1, 1, 2, 12])):
            changed = list(words)
            for _ in range(r.randrange(4)):
                changed[r.randrange(40)] = prose(r.randrange(10**6), 1)
            texts.append(" ".join(changed))
    texts += [texts[0], texts[0].upper(), "日本語の文章" * 12, "日本語の文章" * 12 + "だ", "q" * 500, "q" * 501]
    table = spark.createDataFrame([(i, "Short line\n" + t + "\n\n") for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t.lower()) for t in texts]
    root = list(range(len(texts)))

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links += 1
                a, b = sorted((up(i), up(j)))
                root[b] = a
    got = {r.doc_id: r.keeper_doc for r in lines.line_classes(table).collect()}
    want = {n: up(n) for n in range(len(texts)) if sum(up(m) == up(n) for m in range(len(texts))) > 1}
    assert links > 100 and sum(got.get(n) == k for n, k in want.items()) >= 0.97 * len(want)
    assert all(up(n) == up(k) for n, k in got.items())
    kept = {r.doc_id: r.text for r in lines.deduplicated(table).collect()}
    assert all(t.startswith("Short line\n") and t.endswith("\n\n" if n == got.get(n, n) else "line\n\n") for n, t in kept.items())


def test_similar_lines_with_a_common_opening(spark):
    """Thousands of lines that share an opening, in them pairs that are similar to each other only."""
    opening, rows, pairs = prose(50, 26), [], 150
    for i in range(500):
        tail = prose(9000 + i, 14).split()
        rows.append((i, opening + " " + " ".join(tail)))
        if i < pairs:
            rows.append((5000 + i, opening + " " + " ".join([*tail[:-1], f"other{i}"])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    close = {(a, b) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) >= 0.8 * len(s | t)}
    root = {i: i for i in sets}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in close:
        x, y = sorted((up(a), up(b)))
        root[y] = x
    classes = defaultdict(set)
    for n in root:
        classes[up(n)].add(n)
    want = {n: k for k, members in classes.items() if len(members) > 1 for n in members}
    assert len(close) >= pairs and len(want) < len(rows) / 2
    got = {r.doc_id: r.keeper_doc for r in lines.line_classes(table).collect()}
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want)


def test_similar_lines_of_any_script(spark):
    thai = "การประมวลผลข้อมูลขนาดใหญ่ต้องอาศัยการกระจายงานไปยังเครื่องจำนวนมากในเวลาเดียวกัน"
    words = prose(77, 30).split()
    typos = [w[:-1] + "z" if i in (9, 21) else w for i, w in enumerate(words)]
    url = "http://archive.example.org/library/contracts/2024/annex-b/payment-terms.html"
    pairs = [(thai, "ก" + thai), (url, url.replace("http:", "https:")), (" ".join(words), " ".join(typos)), ("Ärger über Öl " * 6, "ärger über öl " * 6 + "!")]
    assert all(alike(a.lower().strip(), b.lower().strip()) >= lines.SIMILARITY for a, b in pairs)
    table = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    assert {(r.doc_id, r.keeper_doc) for r in lines.line_classes(table).collect()} == {(n, n - n % 2) for n in range(8)}


def test_shingles_are_those_of_the_characters(spark):
    table = spark.createDataFrame([("straße 漢字 😀 end",), ("ab",), ("",), ("aaaaaaaa",)], "norm string")
    got = [len(r.s) for r in table.select(lines.shingle_set().alias("s")).collect()]
    assert got == [len(shingles(t)) for t in ("straße 漢字 😀 end", "ab", "", "aaaaaaaa")]
    long = "0123456789" * 20_000
    assert spark.createDataFrame([(long,)], "norm string").select(F.size(lines.shingle_set())).first()[0] == 10


def test_rare_shingles_leave_no_pair_out(spark):
    """Lines of a template: every similar pair of different groups meets, and few others do."""
    r = random.Random(6)
    base, rows = prose(60, 30).split(), []
    for i in range(300):
        words = list(base)
        for place in r.sample(range(30), r.choice([1, 2, 4, 6])):
            words[place] = prose(r.randrange(10**6), 1)
        rows.append((" ".join(words), i if i % 4 else 1000))
    table = spark.createDataFrame(rows, "norm string, group long").dropDuplicates(["norm"]).withColumn("doc_id", F.lit(1))
    signed = lines.distinct_lines(table.select("doc_id", F.col("norm").alias("text")), 1).select("h1", "n_shingles", "sketch")
    members = lines.stored(table.withColumn("h1", F.xxhash64("norm")).join(signed, "h1"), "members")
    text = {x.h1: (x.norm, x.group) for x in members.collect()}
    close = {(a, b) for a in text for b in text if a < b and text[a][1] != text[b][1] and alike(text[a][0], text[b][0]) >= lines.SIMILARITY}
    found = {(x.a, x.b) for x in lines.pairs_by_rare_shingles(lines.rare_shingles(members)).collect()}
    assert close and close <= found and all(text[a][1] != text[b][1] for a, b in found) and len(found) < len(text) * (len(text) - 1) / 4
    kept = {(x.a, x.b) for x in lines.compared(spark.createDataFrame(list(found), "a long, b long"), members.select("h1", "norm", F.col("n_shingles").alias("n"))).collect()}
    assert kept == close


def test_rare_shingles_send_what_lines_share(spark):
    """Shingles of one line only count for the rank and are not sent; only shared ones can bring two lines together."""
    texts = ["a common beginning of the line, then " + w * 12 for w in ("x1", "y2", "z3")]
    members = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h1 long, norm string")
    members = members.select("*", F.size(lines.shingle_set()).alias("n_shingles"), F.lit(0).cast("long").alias("sketch"), F.col("h1").alias("group"))
    sent = lines.rare_shingles(members, similarity=0.2).groupBy("shingle").count().collect()
    assert sent and all(r["count"] > 1 for r in sent)


def test_line_steps_let_their_shuffles_go(spark, monkeypatch):
    """Each step that shuffles the lines or their shingles is followed by a cleaning of what it shuffled."""
    order = []
    free, stored = lines.free_shuffles, lines.stored
    monkeypatch.setattr(lines, "free_shuffles", lambda s: order.append("free") or free(s))
    monkeypatch.setattr(lines, "stored", lambda df, name: order.append(name) or stored(df, name))
    rows = [(i, f"the same long line of text with number {i % 3}\nanother line {i}") for i in range(12)]
    lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    for step in ("lines", "line-buckets", "line-links", "line-texts", "line-shared", "line-classes"):
        at = len(order) - 1 - order[::-1].index(step)
        assert order[at + 1] == "free", step


def test_line_parities_lose_no_similar_pair(spark):
    """Bits differ in no more places than shingles do; most pairs of a template that are not similar are told apart."""
    r = random.Random(8)
    base, rows = prose(61, 60).split(), []
    for _ in range(60):
        words = list(base)
        for place in r.sample(range(60), r.choice([1, 3, 12, 20])):
            words[place] = prose(r.randrange(10**6), 1)
        rows.append(" ".join(words))
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "h1 long, norm string")
    table = texts.select("h1", F.size(lines.shingle_set()).alias("n_shingles"), F.lit(0).cast("long").alias("sketch")).join(lines.parities(texts), "h1")
    met = table.join(lines._others(table, "h1").withColumnRenamed("h1", "o"), F.col("h1") < F.col("o"))
    kept = {(x.h1, x.o) for x in met.where(lines._may_be_similar(lines.SIMILARITY, True)).collect()}
    every = {(a, b) for b in range(60) for a in range(b)}
    close = {(a, b) for a, b in every if alike(rows[a], rows[b]) >= lines.SIMILARITY}
    assert close and close <= kept and len(kept - close) < len(every - close) / 4


def test_line_tables_go_with_the_last_step(spark, monkeypatch):
    """The classes stay in the shared folder, and what the rare shingles were read from; lines, texts and pairs go."""
    made, stored = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    rows = [(i, f"the same long line of text with number {i % 3}\nanother line {i}") for i in range(12)]
    assert not lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).isEmpty()
    assert {name for name, table in made if os.path.exists(table.stored_at)} == {"line-classes", "line-shared", "line-rare"}


def test_line_copies_with_other_blanks_at_their_ends(spark):
    line = "Six short words with one ending"
    ends = ["", "\r", "\t", " \t\r", "\x0b\x0c\r", " "]
    table = spark.createDataFrame([(i, f"{e[::-1]}{line}{e}\nown line {prose(700 + i, 12)}") for i, e in enumerate(ends)], "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.keeper_doc) for r in lines.line_classes(table).collect()}
    assert got == {(i, 0, 0) for i in range(len(ends))}


def test_line_dedup_defined_cases(docs, none):
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r for r in out.where("doc_id IS NULL").collect() if r.text] != []
    assert out.where("doc_id = 2").first().text == "" and out.where("doc_id = 2").first().n_chars == 0
    assert out.where("doc_id = 3").first().text is None
    assert lines.deduplicated(none).count() == 0
    plan = lines.line_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_factorization_machine_learns_a_pair():
    r = random.Random(1)
    texts, labels = [], []
    for _ in range(1500):
        words = prose(r.randrange(10**6), 12).split()
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    bags = [toxicity.terms(t) for t in texts]
    model = toxicity.fit(bags[:1000], np.array(labels[:1000]))
    found = toxicity.margins(model, bags[1000:]) > 0
    assert np.mean(found == np.array(labels[1000:], dtype=bool)) > 0.97
    at = [int(np.searchsorted(model.slots, zlib.crc32(w) & ((1 << toxicity.SLOTS_LOG2) - 1))) for w in (b"insult", b"group")]
    assert float(model.v[at[0]] @ model.v[at[1]]) > 0.1


def test_margin_is_the_sum_over_pairs():
    r = np.random.default_rng(2)
    model = toxicity.Model(0.3, np.arange(5), r.normal(size=5), r.normal(size=(5, toxicity.FACTORS)))
    bag = (np.array([0, 2, 4, 9]), np.array([0.5, 1.0, 2.0, 7.0]))
    x = dict(zip(*map(np.ndarray.tolist, bag), strict=True))
    want = 0.3 + sum(model.w[i] * x[i] for i in (0, 2, 4)) + sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for i in (0, 2, 4) for j in (0, 2, 4) if i < j)
    assert toxicity.margins(model, [bag, (np.empty(0, dtype=np.int64), np.empty(0))])[0] == pytest.approx(want)


def test_toxicity_of_the_held_out_fold(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    flagged, toxic = got["predicted"] == 1, got["toxic"] == 1
    assert toxic[flagged].mean() > 0.9 and flagged[toxic].mean() > 0.75
    assert (got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()


def test_toxicity_defined_cases(docs, none, spark):
    labels = spark.createDataFrame([(0, None, 1), (1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score > 0.01").count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(docs, none, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = spark.createDataFrame(rows + [(200 + i, prose(i % 9, 3 + i % 4)) for i in range(60)] + [(300, "É A b"), (301, "É a B")], "doc_id long, text string")
    all_rows = table.collect()
    prints = [plain_fingerprint(r.text) for r in all_rows]
    root = list(range(len(prints)))

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(prints)):
        for j in range(i):
            same_id = all_rows[i].doc_id is not None and all_rows[i].doc_id == all_rows[j].doc_id
            if same_id or (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(up(i), up(j))] = min(up(i), up(j))
    least = defaultdict(list)
    for i, r in enumerate(all_rows):
        if r.doc_id is not None:
            least[up(i)].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{prints[i]:016x}", str(min(least[up(i)], default=None))) for i, r in enumerate(all_rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.classes(table).collect()) == want
    assert simhash.classes(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_close_pairs_of_random_fingerprints(spark):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:80]:
        for _ in range(r.randrange(4)):
            prints.add(p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.3) * (1 << r.randrange(64)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {(x.a, x.b) for x in simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "print long")).collect()}
    assert got == want and len(want) > 50


# --- 7 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dual_search_against_brute_force(seed):
    r = np.random.default_rng(seed)
    data = r.integers(-40, 40, (900, 6)) if seed < 3 else np.repeat(r.integers(-3, 3, (30, 4)), 30, axis=0)
    ids = r.permutation(len(data)).astype(np.int64)
    chosen = np.flatnonzero(ids % 5 == 0)
    best = covertree.dual_search(data[chosen], ids[chosen], data, ids, 7)
    for row, found in zip(chosen, best.found, strict=True):
        scores = data @ data[row]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[row])[:7]
        assert found == want


def test_top_k_refuses_vectors_beyond_64_bits(spark):
    far = spark.createDataFrame([(0, [1e8, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        covertree.nearest(far).collect()
    near = spark.createDataFrame([(0, [1e6, 0.0]), (1, [1e6, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.score) for r in covertree.nearest(near).collect()] == [(0, (256 * 10**6) ** 2)]


def test_top_k_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", 7)
    monkeypatch.setattr(covertree, "QUERY_BLOCK_ROWS", 3)
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], i) for i in range(30)]
    rows += [(50, [1.0, None, 0.0], 0), (100, [1.0, float("nan"), 0.0], 0), (150, None, 0), (200, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (250, [0.5, 0.5], 0), (10, rows[10][1], 1), (300, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = defaultdict(list)
    for x in covertree.nearest(table, every=10, k=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    plain = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in rows if i is not None and i < 30]
    for q in (0, 20):
        vector = dict(plain)[q]
        want = sorted((-sum(a * b for a, b in zip(v, vector, strict=True)), i) for i, v in plain if i != q)[:4]
        assert got[q] == [(i, -s) for s, i in want]
    assert not {50, 100, 150, 200, 250, 300, None} & set(got)
    assert covertree.nearest(table.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------------


def test_packing_keeps_every_token(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.RANKS.replace(".tiktoken", ".json"))
    rows = packing.packed(docs, F.struct("doc_id", "text")).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[(r.key.doc_id, r.key.text)].append(r)
    for (_, text), found in by_doc.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        copies = sum(r.start == 0 for r in found)
        assert sum(r.length for r in found) == copies * len(ids)
        for r in found:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at == found[0].sequence_tokens and found[0].padded_to in (at, 2048)
    assert packing.packed(none, none["doc_id"]).count() == 0


def test_special_token_in_a_text():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b <|endoftext|"
    assert packing.encoder().encode(text, allowed_special="all") == Tokenizer.from_file(packing.RANKS.replace(".tiktoken", ".json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_pack_covers_each_document_once(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, 100, 256, 257, 900, 2047, 2048, 2049, 7000]) + r.randrange(50) for _ in range(r.randrange(1, 120))]
    sequences = packing.pack(lengths)
    spans = defaultdict(list)
    for s in sequences:
        size = sum(p[2] for p in s)
        assert size & (size - 1) == 0 and size <= 2048
        for doc, start, length in s:
            spans[doc].append((start, length))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[doc]):
            assert start == at
            at += n
        assert at == length


# --- 9 ----------------------------------------------------------------------------------------------------------------


def brute_spans(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text in rows:
        raw, gone = (text or "").encode(), set()
        if doc_id is not None:
            smaller = b"\x00\xff".join((t or "").encode() for i, t in rows if i is not None and i < doc_id)
            for at in range(len(raw) - 49):
                if raw[at : at + 50] in smaller:
                    gone.update(range(at, at + 50))
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        out.append((str(doc_id), len(raw), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_against_brute_force(docs, none, spark):
    passage = prose(77, 30)
    more = [(400 + i, prose(500 + i, 20) + passage[i : 60 + 9 * i] + prose(600 + i, 15)) for i in range(12)] + [(420, "ab" * 90), (421, "b" + "ab" * 60), (422, "x" * 49), (423, "é" * 40), (424, "zé" + "é" * 39)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_spans(rows)
    assert substrings.report(none).count() == 0
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("doc_id = 2").first().text == ""


def test_column_transform_sorts_suffixes():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))) for _ in range(25)] + [b"", b"a", b"\x00\xff\x00"]
    lengths = np.array([len(s) for s in strings])
    matrix = np.zeros((len(strings), lengths.max()), dtype=np.uint8)
    for i, s in enumerate(strings):
        matrix[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
    string, start = substrings.column_transform(matrix, lengths)
    want = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [(int(i), int(k)) for i, k in zip(string, start, strict=True)] == [(i, k) for _, i, k in want]


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_chat_keeps_maximal_conversations(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "<|im_end|> no")]
    conversations = {1: a[:2], 2: a, 3: a[:3], 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, None)], 7: a[:1]}
    rows = [(c, t, r, x, "extra") for c, turns in conversations.items() for t, (r, x) in enumerate(turns)]
    rows += [(8, None, "user", "q", "e"), (8, None, "user", "q", "e"), (8, 1, " User ", "z" * 5000, "e"), (None, 0, "user", "lost", "e")]
    got = {r.conv_id: r for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")).collect()}
    assert set(got) == {2, 5, 6, 8, None}
    assert got[2].n_copies == 2 and got[2].n_turns == 4
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\n< |im_end|> no<|im_end|>\n"
    assert got[6].text == "<|im_start|>user\n<|im_end|>\n" and got[8].n_turns == 3
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, i, "user", f"q{i % 3}") for i in range(9)] + [(1, 0, "user", "q0"), (1, 1, "assistant", "a"), (2, 0, "user", "q1")]
    got = sorted((str(r.conv_id), r.n_turns, r.n_copies, r.text) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    turn = "<|im_start|>user\nq{}<|im_end|>\n".format
    assert got == [("1", 2, 1, turn(0) + "<|im_start|>assistant\na<|im_end|>\n"), ("None", 1, 3, turn(2)), ("None", 1, 4, turn(1))]
