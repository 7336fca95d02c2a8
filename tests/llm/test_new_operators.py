"""Fingerprints, conversation repair and whitening against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pactlens.llm import digests, queries, repair, whitening

# --- fingerprints -----------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, hash string, raw int"


def texts():
    r = random.Random(3)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod straße 漢字 ещё".split()
    rows = [(i, " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(r.choice([0, 1, 3, 40, 400])))) for i in range(60)]
    return [*rows, (70, None), (71, ""), (72, "x" * 5), (-5, rows[9][1]), (9, "another text of nine"), (9, "another text of nine"), (None, "no id"), (None, None)]


def ordered(rows):
    """Falling id, nulls last; rows of one id as the operator's hash order has them do not matter where they are equal."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("part_bytes", [1 << 30, 700])
def test_fingerprints_of_edited_texts(spark, part_bytes):
    rows = [r for r in texts() if r[0] is not None and not (r[0] == 9 and r[1] != "another text of nine")]
    table = spark.createDataFrame([(*r, "h", 1) for r in rows], DOCS).repartition(5)
    got = sorted(map(tuple, digests.report(table, part_bytes).collect()))
    want = []
    line = ordered(rows)
    for (key, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        a, b = text or "", after or ""
        m = len(a) // 3
        changed = a[: len(a) - m] + b[:m]
        d, e, f = (digests.digest(x.encode()) for x in (a, changed, b))
        want.append((key, len(a), hashlib.sha256(changed.encode()).hexdigest(), digests.as_text(d), digests.as_text(e), digests.likeness(d, e), digests.likeness(d, f)))
    assert got == sorted(want)


def test_stretches_meet_their_successors(spark):
    rows = [(*r, "h", 1) for r in texts()]
    out = digests.report(spark.createDataFrame(rows, DOCS).repartition(3), 300)
    assert out.count() == len(rows) and out.where("doc_id IS NULL").count() == 2
    alone = digests.report(spark.createDataFrame([(1, "abcdef", "h", 1)], DOCS)).first()
    assert (alone.n_chars, alone.near_next, alone.edited_sha256) == (6, 1.0, hashlib.sha256(b"abcdab").hexdigest())
    none = spark.createDataFrame([], DOCS)
    assert digests.report(none).isEmpty() and digests.fingerprints(none).isEmpty()
    prints = {r.doc_id: r.fingerprint for r in digests.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert prints[-5] == prints.get(-5) and prints[70] == prints[71] and len(set(map(len, prints.values()))) == 1


def test_digest_score_is_bounded_and_tells_edits_from_other_texts(spark, tiny):
    got = queries.QUERIES["op11_fingerprints"](spark, tiny).collect()
    assert len(got) == 200 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert sum(r.near_edited > r.near_next for r in got) >= 0.97 * len(got)
    for text in (r.fingerprint for r in got[:20]):
        assert digests.as_text(digests.as_digest(text)) == text and digests.likeness(digests.as_digest(text), digests.as_digest(text)) == 1
    assert digests.likeness(digests.digest(b""), digests.digest(b"some text")) == 0


def test_counts_do_not_depend_on_blocks(monkeypatch):
    raw = "Größe und 長さ ".encode() * 500
    whole, chars, cut = digests.triplet_counts(raw), digests.count_chars(raw), digests.byte_of_char(raw, 3001)
    monkeypatch.setattr(digests, "BLOCK", 7)
    assert (digests.triplet_counts(raw) == whole).all() and digests.count_chars(raw) == chars == len(raw.decode())
    assert digests.byte_of_char(raw, 3001) == cut == len(raw.decode()[:3001].encode())


# --- conversation repair ----------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, id int, kind string"
BLANK = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        crc = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if crc == 1:
            text = ""
        if crc == 2:
            text = "".join(c for c in text if c not in ".!?")
        if crc == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if crc == 0 else 2 if crc == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def cheapest(rows):
    """Every way row by row, with up to four inserts anywhere: least (cost, audit) per state."""
    best = {0: (0, "", [])}

    def inserted(ways):
        for _ in range(4):
            more = dict(ways)
            for at, (cost, audit, lines) in ways.items():
                role = "assistant" if at == 2 else "user"
                new = (cost + 2, audit + "I", [*lines, f"{role}:"])
                to = STEP[at, role[0]]
                more[to] = min(more.get(to, new), new, key=lambda w: w[:2])
            ways = more
        return ways

    # Inserts are tried in front of each row, together with what happens to the row, so that strings are compared whole.
    def with_inserts(at, way):
        yield at, way
        for _ in range(4):
            role = "assistant" if at == 2 else "user"
            way, at = (way[0] + 2, way[1] + "I", [*way[2], f"{role}:"]), STEP[at, role[0]]
            yield at, way

    for role, text, must_go, cut in rows:
        following = {}
        for start, begun in best.items():
            for at, (cost, audit, lines) in with_inserts(start, begun):
                ways = [(at, (cost + 3, audit + "D", lines))]
                if not must_go:
                    if (at, role[:1]) in STEP:
                        ways.append((STEP[at, role[:1]], (cost + cut, audit + "K", [*lines, f"{role}:{text}"])))
                    new = "assistant" if at == 2 else "user"
                    ways.append((STEP[at, new[0]], (cost + 2 + cut, audit + "R", [*lines, f"{new}:{text}"])))
                for to, way in ways:
                    following[to] = min(following.get(to, way), way, key=lambda w: w[:2])
        best = following
    ends = [w for start, begun in best.items() for at, w in with_inserts(start, begun) if at in (0, 3)]
    return min(ends, key=lambda w: w[:2])


def repaired(rows):
    """The contract's columns by conversation, by brute force."""
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    after = damage(rows)
    for conv in {r[0] for r in after}:
        mine = [r for r in after if r[0] == conv]
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        for _, _, role, text in mine:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(r.choice([0, 1, 2, 3, 5, 8, 13])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            role = ("user", "assistant")[turn % 2] if r.random() < 0.6 else role
            rows.append((conv, None if r.random() < 0.04 else turn + 2 * (turn > 4), role, r.choice(["Yes.", "no", "  ", "", None, "What? ", f"Text {turn}!", "straße…"])))
    rows += [(500, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"Turn {t}" + "." * (t % 3 > 0)) for t in range(150)]
    rows += [(None, t, "user", "Hello.") for t in range(12)] + [(600, 3, "user", "Twice."), (600, 3, "user", "Twice."), (601, 0, "system", "Only."), (602, None, None, None)]
    return [*rows, *[(700 + i, 0, "user", "x.") for i in range(40)]]  # some of these lose their only row


def as_rows(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("stretch_bits", [16, 3, 0])
def test_repair_against_brute_force(spark, stretch_bits):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS).repartition(4)
    assert as_rows(repair.repair(table, stretch_bits)) == repaired(rows)


def test_repair_of_the_given_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.QUERIES["op12_conversation_repair"](spark, tiny)) == repaired(rows)
    assert repair.repair(spark.createDataFrame([], TURNS)).isEmpty()


def test_crossings_equal_the_plain_search():
    """Long sequences, many ties: the states of the divide-and-conquer give the least string among the cheapest."""
    r = np.random.default_rng(2)
    for _ in range(30):
        kind = r.integers(0, len(repair.TABLES), r.integers(1, 60))
        starts = np.array([0, len(kind)])
        before, after = repair.crossings(repair.ROW_COST[kind], repair.ROW_CODE[kind], starts, np.zeros(1, int), repair.END_COST[None])
        audit = "".join(repair.EDITS[repair.ROW_CODE[k, a, b]] for k, a, b in zip(kind, before, after, strict=True)) + repair.ENDING[after[-1]]
        rows = [(("system", "user", "assistant", "tool")[k // 4], "t", bool(k % 4 // 2), k % 2) for k in kind]
        # Rows that must go are never cut short too; both flags at once cost nothing more, as they go anyway.
        assert audit == cheapest(rows)[1]


# --- whitening --------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, component int, n string"


def reference(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)) + 1_000_000
    n, s = len(x), [sum(map(int, c)) for c in x.T]
    mean = np.array([float(Fraction(v, n) - 1_000_000) for v in s]) + 0.0
    y = (x - 1_000_000) - mean
    values, basis = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    return y, values[::-1], basis[:, ::-1], deviation


def odd_vectors():
    r = np.random.default_rng(4)
    good = (r.standard_normal((300, 9)) @ r.standard_normal((9, 9))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)]
    rows += [(400, None), (401, [None] * 9), (402, [math.nan] * 9), (403, [math.inf] + [0.0] * 8), (404, [1.0] * 4), (405, []), (None, rows[3][1]), (7, rows[7][1])]
    return [(*r, 0, 1, "n") for r in rows], [r[1] for r in rows if r[1] and len(r[1]) == 9 and None not in r[1] and all(map(math.isfinite, r[1]))]


def test_whitening_against_a_library_solver(spark):
    rows, used = odd_vectors()
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), 6).collect()
    y, values, basis, deviation = reference(used)
    assert len(got) == len(used) * 6 and {r.n for r in got} == {len(used)}
    by_id = {(r.vec_id, r.component): r for r in got}
    for k in range(6):
        sign = np.sign(by_id[0, k + 1].whitened * (y[0] @ basis[:, k]))
        for i in range(300):
            row = by_id[i, k + 1]
            assert row.whitened == pytest.approx(sign * (y[i] @ basis[:, k]) / math.sqrt(values[k]), abs=1e-9) and row.deviation == deviation[i]
        assert by_id[0, k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9
    assert by_id[None, 1].whitened == by_id[3, 1].whitened and sum(r.vec_id == 7 for r in got) == 12


def test_whitening_of_the_given_table(spark, tiny):
    got = queries.QUERIES["op13_embedding_whitening"](spark, tiny).collect()
    table = spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").collect()
    _, values, _, deviation = reference([r.embedding for r in table])
    assert len(got) == 32 * len(table) and max(r.identity_error for r in got) < 1e-9
    assert {(r.vec_id, r.deviation) for r in got} == {(r.vec_id, d) for r, d in zip(table, deviation, strict=True)}
    assert {r.component: r.explained for r in got} == {k + 1: pytest.approx(values[k] / values.sum(), rel=1e-9) for k in range(32)}


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, 1, "n") for i, v in rows], VECTORS)
    assert whitening.whiten(make([])).isEmpty() and whitening.whiten(make([(1, None), (2, [])])).isEmpty()
    assert whitening.whiten(make([(1, [1.0, 2.0])] * 3)).isEmpty()  # no variance
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 10 and line[0].explained == pytest.approx(1)
    far = whitening.whiten(make([(i, [2.0**40 * (i % 3), float(i)]) for i in range(12)])).collect()
    assert len(far) == 12 and {r.deviation for r in far} == {None}  # the other variance is rounding beside this one
    with pytest.raises(Exception, match="beyond 2 \\*\\* 53"):
        whitening.whiten(make([(1, [3e30]), (2, [1.0])])).collect()


@pytest.mark.parametrize("d", [1, 2, 5, 30, 64])
def test_eigenvectors_by_spectral_division(d):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    for values in (r.random(d), np.ones(d), np.repeat([1.0, 2.0, 7.0], d)[:d], 10.0 ** -np.arange(d), np.r_[r.random((d + 1) // 2), np.zeros(d // 2)]):
        a = q * values @ q.T
        a = (a + a.T) / 2
        found, v = whitening.eigenvectors(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 and np.abs(a @ v - v * found).max() < 1e-13 * size * d
        assert (np.diff(found) <= 0).all() and np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * size * d


def test_entries_are_whole_numbers(spark):
    sums = whitening.sums(whitening.usable(spark.createDataFrame([(1, [0.5, -0.01], 0, 1, "")], VECTORS)), 2)
    assert sums == (1, [1_000_032, 999_999], [[0, 0], [0, 0]])
