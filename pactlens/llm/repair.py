"""Conversation structure repair: cheapest edits to system? (user assistant)+, by Hirschberg's divide-and-conquer.

A conversation is a sequence of steps, and a step a 4 x 4 table: the cost and the order among equal costs of the edits that
lead from one state to another.  A row is a step, and so is a whole stretch of rows; the same search meets in the middle of
both, so a conversation may span any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of, stored

STATES = 4  # nothing yet, after the system row, after a user row, after an assistant row
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 40  # no way
STRETCH_BITS = 16  # a stretch has 65,536 rows at most
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

# --- tables -----------------------------------------------------------------------------------------------------------


# What is inserted in front of a row: up to two rows, as states repeat after that.  An edit string is those inserts and what
# happens to the row; none of them begins another, so sorting them once decides every later comparison.
EDITS = sorted("I" * i + e for i in range(3) for e in "DKR")
ENDING = ["", "II", "I", ""]  # inserts behind the last row, by state


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = NEXT[state, "a" if state == 2 else "u"]
    return state


def _row_table(initial: str, must_go: bool, truncated: bool) -> tuple[np.ndarray, np.ndarray]:
    """Costs and edit codes from state to state over one row."""
    cost, code = np.full((STATES, STATES), FAR, np.int64), np.zeros((STATES, STATES), np.int64)
    for at, (number, edit) in product(range(STATES), enumerate(EDITS)):
        inserts = len(edit) - 1
        here = _inserted(at, inserts)
        if edit[-1] == "D":
            to, price = here, DELETE
        elif must_go:
            continue
        else:
            to = NEXT.get((here, initial)) if edit[-1] == "K" else NEXT[here, "a" if here == 2 else "u"]
            price = (KEEP if edit[-1] == "K" else REROLE) + TRUNCATED * truncated
        price += INSERT * inserts
        if to is not None and price < cost[at, to]:  # codes rise, so the first of equal costs is the least
            cost[at, to], code[at, to] = price, number
    return cost, code


INITIALS = ["s", "u", "a", ""]  # the last one: any other
TABLES = [_row_table(*k) for k in product(INITIALS, (False, True), (False, True))]
ROW_COST, ROW_CODE = (np.stack(t) for t in zip(*TABLES, strict=True))
END_COST = np.array([INSERT * len(e) for e in ENDING], np.int64)


# --- the search -------------------------------------------------------------------------------------------------------


def _forward(cost: np.ndarray, rank: np.ndarray, step_cost: np.ndarray, step_code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks (order of the least edit strings) of the states one step on, for many sequences at once.

    Least strings that lead to different states differ and none begins another, so ``rank`` settles every tie before the step.
    """
    key = (cost[:, :, None] + step_cost) * 256 + rank[:, :, None] * 16 + step_code
    best = key.min(axis=1)
    order = np.argsort(np.argsort(best & 255, axis=1, kind="stable"), axis=1, kind="stable")
    return np.minimum(best >> 8, FAR), order


def crossings(step_cost: np.ndarray, step_code: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each step on the cheapest, then least, path of each sequence.

    Steps (n x 4 x 4) of all sequences stand one after the other; ``starts`` has where each begins, and the end; ``first``
    is its first state, ``last`` (m x 4) what it costs to end in a state.  Hirschberg: cost vectors run forward from the
    start and backward from the end of a segment to its middle, the crossing of least sum and least rank is a state of the
    path, and both halves go on alone.  All segments of a depth advance together.  Memory is linear in the steps.
    """
    n = int(starts[-1])
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
    low, high = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    some = high > low
    low, high, first, last = low[some], high[some], first[some], last[some]
    while len(low):
        middle = (low + high + 1) // 2  # the left part has a step always
        cost = np.full((len(low), STATES), FAR, np.int64)
        cost[np.arange(len(low)), first] = 0
        rank = np.tile(np.arange(STATES), (len(low), 1))
        rest = last.copy()
        for t in range(int((middle - low).max())):
            go = np.flatnonzero(low + t < middle)
            cost[go], rank[go] = _forward(cost[go], rank[go], step_cost[low[go] + t], step_code[low[go] + t])
        for t in range(int((high - middle).max())):
            go = np.flatnonzero(high - t > middle)
            rest[go] = np.minimum((step_cost[high[go] - 1 - t] + rest[go, None, :]).min(axis=2), FAR)
        meet = ((np.minimum(cost + rest, FAR) << 3) + rank).argmin(axis=1)
        one = np.zeros_like(last) + FAR
        one[np.arange(len(low)), meet] = 0
        single = middle - low == 1
        before[low[single]], after[low[single]] = first[single], meet[single]
        left, right = ~single, high > middle
        low, high, first, last = (
            np.concatenate(pair)
            for pair in ((low[left], middle[right]), (middle[left], high[right]), (first[left], meet[right]), (one[left], last[right]))
        )
    return before, after


def stretch_tables(step_cost: np.ndarray, step_code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables of whole sequences: costs from state to state, and ranks among the states reached from one state."""
    m = len(starts) - 1
    length = starts[1:] - starts[:-1]
    cost = np.where(np.eye(STATES, dtype=bool), 0, FAR).astype(np.int64)[None].repeat(m, 0).reshape(m * STATES, STATES)
    rank = np.tile(np.arange(STATES), (m * STATES, 1))
    for t in range(int(length.max(initial=0))):
        go = np.flatnonzero(length > t)
        steps, rows = starts[go] + t, (go[:, None] * STATES + np.arange(STATES)).ravel()
        cost[rows], rank[rows] = _forward(cost[rows], rank[rows], step_cost[steps].repeat(STATES, 0), step_code[steps].repeat(STATES, 0))
    return cost.reshape(m, STATES, STATES), rank.reshape(m, STATES, STATES)


def edits_and_roles(kind: int, at: int, to: int, role: str) -> tuple[str, list[str | None]]:
    """The edits over one row, and the roles of what they leave; the row's own one is last unless it is deleted (then None)."""
    edits = EDITS[ROW_CODE[kind, at, to]]
    roles = []
    for _ in edits[:-1]:
        roles.append(ROLES["a" if at == 2 else "u"])
        at = NEXT[at, roles[-1][0]]
    return edits, [*roles, {"D": None, "K": role, "R": ROLES["a" if at == 2 else "u"]}[edits[-1]]]


# --- rows -------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the rows after the damage that ``crc32('conv_id:turn') % 20`` names; nulls are one space."""
    rows = columns_of(conversations, "conv_id", "turn", "role", "text")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def in_order(rows: DataFrame, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """The rows as a stored table with ``id``, which rises with (conversation, turn), and ``stretch``, some consecutive rows.

    Sorted by ranges, so a conversation of any length spreads over tasks; equal turns go by role and the text's md5, and rows
    equal in all of it are dealt apart by a random number.
    """
    order = ["conv_id", "turn", "role", "tie", "salt"]
    keyed = rows.withColumns({"tie": F.md5("text"), "salt": F.rand(7)})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("stretch", F.shiftright("id", stretch_bits))
    return stored(numbered.drop("tie", "salt"), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null) and ``kind``, the row's place in :data:`TABLES`.

    The first row of each (conversation, role, text) is a minimum, which combines before its shuffle, and only texts that
    occur again are joined.
    """
    text_id = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    marked = rows.select("*", *text_id)
    again = marked.groupBy("conv_id", "role", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "role", "h1", "h2")]
    joined = marked.alias("r").join(again.alias("f"), same, "left").select("r.*", "f.first")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("first") < F.col("id"), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    known = F.array(*map(F.lit, INITIALS[:-1]))
    place = F.array_position(known, initial())
    table = F.when(place > 0, place - 1).otherwise(len(INITIALS) - 1) * 4
    out = joined.withColumn("fault", fault)
    gone, cut = (F.coalesce(F.col("fault").isin(*names), F.lit(False)).cast("int") for names in (("blank", "duplicate"), ("truncated",)))
    return out.withColumn("kind", (table + 2 * gone + cut).cast("int")).drop("h1", "h2", "first")


def initial() -> Column:
    return F.substring("role", 1, 1)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows of whole ``key`` values; several small ones come together, and none is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1][key][-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal values (nulls are equal) begins, and the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    for column in columns:
        missing = column.is_null().to_numpy()
        values = column.fill_null(0).to_numpy()
        change[1:] |= (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    change[:1] = True
    return np.append(np.flatnonzero(change), n)


# --- the operator -----------------------------------------------------------------------------------------------------

STRETCH = "conv_id BIGINT, stretch BIGINT, opening STRING, closing STRING, illegal BIGINT, costs ARRAY<BIGINT>, ranks ARRAY<BIGINT>"
PLACED = "conv_id BIGINT, stretch BIGINT, at INT, closes ARRAY<BIGINT>, single BOOLEAN, cost BIGINT"
MENDED = "conv_id BIGINT, stretch BIGINT, single BOOLEAN, audit STRING, repaired STRING"
LEGAL = ("su", "ua", "au")


def stretches(rows: DataFrame) -> DataFrame:
    """:data:`STRETCH` per (stretch, conversation): its table, and its pairs of initials that follow each other illegally."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "stretch"):
            starts = _starts(table["stretch"], table["conv_id"])
            kind = table["kind"].to_numpy()
            cost, rank = stretch_tables(ROW_COST[kind], ROW_CODE[kind], starts)
            letters = table["initial"].to_pylist()
            wrong = np.array([0, *(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False))], np.int64)
            wrong[starts[:-1]] = 0
            heads = table.take(pa.array(starts[:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(heads[c].combine_chunks() for c in ("conv_id", "stretch")),
                    pa.array([letters[i] for i in starts[:-1]], pa.string()), pa.array([letters[i - 1] for i in starts[1:]], pa.string()),
                    pa.array(np.add.reduceat(wrong, starts[:-1])), pa.array(list(cost.reshape(-1, 16))), pa.array(list(rank.reshape(-1, 16))),
                ],
                [f.split()[0] for f in STRETCH.split(", ")],
            )

    kept = rows.select("id", "stretch", F.col("conv_id").cast("bigint"), "kind", initial().alias("initial"))
    return kept.repartition("stretch").sortWithinPartitions("id").drop("id").mapInArrow(run, STRETCH)


def placed(parts: DataFrame) -> DataFrame:
    """:data:`PLACED` per (stretch, conversation): the state it begins in, what its last states cost, the conversation's cost.

    A conversation's stretches are its steps here: one row for each 65,536 of its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups((_with_flat_key(b) for b in batches), "flat"):
            starts = _starts(table["conv_id"])
            cost, rank = (np.array(table[c].to_pylist(), np.int64).reshape(-1, STATES, STATES) for c in ("costs", "ranks"))
            m = len(starts) - 1
            before, after = crossings(cost, rank, starts, np.zeros(m, np.int64), np.tile(END_COST, (m, 1)))
            closes = np.full((len(after), STATES), FAR, np.int64)
            closes[np.arange(len(after)), after] = 0
            closes[starts[1:] - 1] = END_COST
            closes[starts[1:] - 1] = np.where(np.arange(STATES) == after[starts[1:] - 1, None], closes[starts[1:] - 1], FAR)
            paid = cost[np.arange(len(after)), before, after]
            total = np.add.reduceat(paid, starts[:-1]) + END_COST[after[starts[1:] - 1]]
            length = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    *(table[c].combine_chunks() for c in ("conv_id", "stretch")), pa.array(before.astype(np.int32)), pa.array(list(closes)),
                    pa.array(np.repeat(length == 1, length)), pa.array(np.repeat(total, length)),
                ],
                [f.split()[0] for f in PLACED.split(", ")],
            )

    dealt = parts.select("conv_id", "stretch", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return dealt.mapInArrow(run, PLACED)


def _with_flat_key(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds ``flat``: ``conv_id`` without nulls, for cutting only (nulls sort first, so the one neighbour they may equal is cut by its run)."""
    return batch.append_column("flat", batch["conv_id"].fill_null(-(1 << 63)))


def mended(rows: DataFrame, places: DataFrame) -> DataFrame:
    """:data:`MENDED` per (stretch, conversation): its edits, and what they leave of its rows as ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "stretch"):
            starts = _starts(table["stretch"], table["conv_id"])
            kind = table["kind"].to_numpy()
            heads = table.take(pa.array(starts[:-1]))
            closes = np.array(heads["closes"].to_pylist(), np.int64)
            before, after = crossings(ROW_COST[kind], ROW_CODE[kind], starts, heads["at"].to_numpy().astype(np.int64), closes)
            audits, repaired = [], []
            for a, b, ends in zip(starts[:-1], starts[1:], closes, strict=True):
                audit, lines = [], []
                for i in range(a, b):
                    edits, roles = edits_and_roles(kind[i], before[i], after[i], table["role"][i].as_py())
                    audit.append(edits)
                    lines += [f"{r}:" for r in roles[:-1]] + ([f"{roles[-1]}:{table['text'][i].as_py()}"] if roles[-1] is not None else [])
                state = int(after[b - 1])
                if ends[state] == END_COST[state] and END_COST[state]:  # the conversation's last stretch
                    for _ in ENDING[state]:
                        lines.append(f"{ROLES['a' if state == 2 else 'u']}:")
                        state = NEXT[state, lines[-1][0]]
                    audit.append(ENDING[int(after[b - 1])])
                audits.append("".join(audit))
                repaired.append("\n".join(lines) if lines else None)
            yield pa.RecordBatch.from_arrays(
                [*(heads[c].combine_chunks() for c in ("conv_id", "stretch", "single")), pa.array(audits, pa.string()), pa.array(repaired, pa.string())],
                [f.split()[0] for f in MENDED.split(", ")],
            )

    same = F.col("r.stretch") == F.col("p.stretch"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id"))
    joined = rows.alias("r").join(places.alias("p"), list(same)).select("id", F.col("r.conv_id").cast("bigint").alias("conv_id"), "r.stretch", "role", "text", "kind", "at", "closes", "single")
    return joined.repartition("stretch").sortWithinPartitions("id").drop("id").mapInArrow(run, MENDED)


def joined_digests(pieces: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: pieces in order; a conversation of several runs through one hash, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, state, lines = None, [], None, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["".join(audit)], pa.string()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, edits, text in zip(*(batch[c] for c in ("conv_id", "audit", "repaired")), strict=True):
                if state is None or conv.as_py() != key:
                    if state is not None:
                        yield row()
                    key, audit, state, lines = conv.as_py(), [], hashlib.sha256(), False
                audit.append(edits.as_py())
                if text.is_valid:
                    state.update((b"\n" if lines else b"") + text.as_buffer().to_pybytes())
                    lines = True
        if state is not None:
            yield row()

    alone = pieces.where("single").select("conv_id", "audit", F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
    several = pieces.where("NOT single").repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    return alone.unionByName(several.mapInArrow(run, "conv_id BIGINT, audit STRING, repaired_sha256 STRING"))


def counted(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps in the turns, and the rows of each fault."""
    turns = rows.groupBy("conv_id", "turn").agg(*(F.sum((F.coalesce("fault", F.lit("")) == f).cast("bigint")).alias(f) for f in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))


def illegal_pairs(parts: DataFrame) -> DataFrame:
    """``conv_id, illegal``: pairs inside the stretches, and between a conversation's neighbouring stretches."""
    ordered = F.array_sort(F.collect_list(F.struct("stretch", "opening", "closing")))
    both = parts.groupBy("conv_id").agg(F.sum("illegal").alias("inside"), ordered.alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.concat(F.get("s", i - 1)["closing"], F.get("s", i)["opening"]))
    between = F.when(F.size("s") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0)
    return both.select("conv_id", (F.col("inside") + between).alias("illegal"))


def repair(conversations: DataFrame, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """One row per ``conv_id`` of the table: the faults of its damaged rows, and the cheapest, then least, edits that mend them.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  A conversation is cut into
    stretches of consecutive rows; each becomes a 4 x 4 table, the tables of a conversation are searched first, then the rows
    of each stretch between the states found.  Only the audit and the running hash of a conversation, one value each, come
    together in one place.

    Defined cases: rows without ``conv_id`` are one conversation; null turns come first, rows of equal turn go by role and
    the text's md5; a role is known by its first letter, other roles can be changed or deleted only; null role and text are a space;
    repeated rows are duplicates; an empty table gives no rows; further columns are ignored.
    """
    keys = columns_of(conversations, "conv_id").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    rows = stored(with_faults(in_order(damaged(conversations), stretch_bits)), "turns-kinds")
    parts = stored(stretches(rows), "turns-stretches")
    places = stored(placed(parts), "turns-places")
    costs = places.groupBy("conv_id").agg(F.first("cost").alias("cost"))
    pieces = stored(mended(rows, places), "turns-mended")
    out = keys.alias("k")
    for n, side in enumerate((counted(rows), illegal_pairs(parts), costs, joined_digests(pieces))):
        side = side.withColumnRenamed("conv_id", f"_{n}").withColumn(f"_has{n}", F.lit(True))
        out = out.join(side, F.col("k.conv_id").eqNullSafe(F.col(f"_{n}")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("k.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
