"""Repair of the turn structure of conversations by cheapest edits.

Turns are to form ``(s?(ua)+)?`` in the first letters of their roles. Edits are Keep, Rerole to
user or assistant, Delete, and Insert of a turn without text; their costs are below. Blank and
repeated turns have to go, and a truncated one costs extra if it stays. Of all cheapest lists of
edits, the one whose letters (``audit``) come first in ASCII order is taken.

Conversations are sorted over range partitions and cut into segments of at most ``SEGMENT``
turns, so one that holds most rows is many segments. A segment is a 4 x 4 matrix of least costs
between states of the pattern; a stream over the matrices of a conversation, last segment
first, gives the cost that is left after each. Then every segment ranks its optimal arcs by
prefix doubling: by their first letter, then, with the rank of the arc that follows after that many
letters, by two, four, eight. The least arc out of each state starts the least path,
which is read out through the doubled pointers. A second stream over the segments picks the
path for the state in which the one before ended, and a last stream writes the turns.

Results in special cases: a null conversation id names a conversation of its own, null turns sort first, and a null
role or text is one space; turns of one number are sorted by role and text; a role without
letters, or with another first letter, can't be kept; repeated rows are repeated turns; a
conversation without turns has no edits; an empty table gives an empty result; other columns
are ignored. Conversations and texts may have any length; the audit is one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import attach_groups, staged

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
SEGMENT = 2048
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
LETTERS = b"\0DIKR"  # in ASCII order; none for the end of a segment
D, I, K, R = 1, 2, 3, 4

# states: nothing yet, after system, after user, after assistant
STATES = 4
FILL = np.array([2, 2, 3, 2])  # the state after a turn that an edit adds or names anew
FILL_ROLE = ("user", "user", "assistant", "user")
END_COST, END_AUDIT = (0, 2 * INSERT_COST, INSERT_COST, 0), ("", "II", "I", "")
NEVER = 1 << 40

# a turn as a number: first letter of the role (2 bits), must go, truncated
SYSTEM, USER, ASSISTANT, MUST_GO, TRUNCATED = 1, 2, 3, 4, 8
KINDS = 16
BATCH_TURNS = 60_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By kind of turn: state after Keep and its cost, cost of Rerole, and least costs from state to state."""
    after, keep, rerole = np.zeros((KINDS, STATES), np.int64), np.full((KINDS, STATES), NEVER), np.full(KINDS, NEVER)
    step = np.full((KINDS, STATES, STATES), NEVER)
    fits = {SYSTEM: {0: 1}, USER: {0: 2, 1: 2, 3: 2}, ASSISTANT: {2: 3}}
    for kind in range(KINDS):
        extra = TRUNCATED_COST if kind & TRUNCATED else 0
        if not kind & MUST_GO:
            rerole[kind] = REROLE_COST + extra
            for state, then in fits.get(kind & 3, {}).items():
                after[kind, state], keep[kind, state] = then, extra
        for state in range(STATES):
            now, paid = state, 0
            for _ in range(3):  # with up to two turns inserted before
                step[kind, state, now] = min(step[kind, state, now], paid + DELETE_COST)
                step[kind, state, after[kind, now]] = min(step[kind, state, after[kind, now]], paid + keep[kind, now])
                step[kind, state, FILL[now]] = min(step[kind, state, FILL[now]], paid + rerole[kind])
                now, paid = int(FILL[now]), paid + INSERT_COST
    return after, keep, rerole, step


KEEP_STATE, KEEP_COST, RENAME_COST, STEP = _tables()


def matrices(kinds: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Least costs from state to state through each segment; ``kinds`` has the turns of all segments in a row."""
    held, owner = STEP[kinds], np.repeat(np.arange(len(lens)), lens)
    while len(owner) and (owner[1:] == owner[:-1]).any():
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        first = np.flatnonzero(place % 2 == 0)
        paired = first[(first + 1 < len(owner)) & (owner[np.minimum(first + 1, len(owner) - 1)] == owner[first])]
        held[paired] = (held[paired][:, :, :, None] + held[paired + 1][:, None, :, :]).min(axis=2)
        held, owner = held[first], owner[first]
    out = np.full((len(lens), STATES, STATES), NEVER)
    out[:, np.arange(STATES), np.arange(STATES)] = 0
    out[owner] = held
    return out


def costs_to_go(kinds: np.ndarray, lens: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Least cost from every state before every turn, and after the last; ``left`` is the latter."""
    node = np.cumsum(lens + 1) - (lens + 1)
    first = np.cumsum(lens) - lens
    cost = np.zeros((int((lens + 1).sum()), STATES), np.int64)
    cost[node + lens] = left
    order = np.argsort(-lens, kind="stable")
    for i in range(int(lens.max(initial=0)) - 1, -1, -1):
        live = order[: np.searchsorted(-lens[order], -i, side="left")]
        kind, then = kinds[first[live] + i], cost[node[live] + i + 1]
        best = then + DELETE_COST
        best = np.minimum(best, np.take_along_axis(then, KEEP_STATE[kind], axis=1) + KEEP_COST[kind])
        best = np.minimum(best, then[:, FILL] + RENAME_COST[kind][:, None])
        after_user = np.minimum(best[:, 2], best[:, 3] + INSERT_COST)
        best[:, 3] = np.minimum(best[:, 3], best[:, 2] + INSERT_COST)
        best[:, 2] = after_user
        best[:, :2] = np.minimum(best[:, :2], after_user[:, None] + INSERT_COST)
        cost[node[live] + i] = best
    return cost


def optimal_arcs(kinds: np.ndarray, lens: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tail node, letter and head node of all arcs that keep to the least cost, sorted by tail and letter.

    A node is a state before a turn (four times its place, and the state). The nodes after a segment
    have one arc without letter, to themselves.
    """
    last = np.zeros(len(cost), bool)
    last[np.cumsum(lens + 1) - 1] = True
    here = np.flatnonzero(~last)
    now, then = cost[here], cost[here + 1]
    states = np.broadcast_to(np.arange(STATES), now.shape)
    choices = (
        (D, then + DELETE_COST, states, 1),
        (I, now[:, FILL] + INSERT_COST, np.broadcast_to(FILL, now.shape), 0),
        (K, np.take_along_axis(then, KEEP_STATE[kinds], axis=1) + KEEP_COST[kinds], KEEP_STATE[kinds], 1),
        (R, then[:, FILL] + RENAME_COST[kinds][:, None], np.broadcast_to(FILL, now.shape), 1),
    )
    ends = (np.flatnonzero(last)[:, None] * STATES + np.arange(STATES)).ravel()
    tails, letters, heads = [ends], [np.zeros(len(ends), np.int64)], [ends]
    for letter, total, state, ahead in choices:
        row, col = np.nonzero(total == now)
        tails.append(here[row] * STATES + col)
        heads.append((here[row] + ahead) * STATES + state[row, col])
        letters.append(np.full(len(row), letter, np.int64))
    tail, letter, head = np.concatenate(tails), np.concatenate(letters), np.concatenate(heads)
    order = np.lexsort((letter, tail))
    return tail[order], letter[order], head[order]


def least_paths(kinds: np.ndarray, lens: np.ndarray, left: np.ndarray) -> tuple[list[str], np.ndarray]:
    """For each segment and state before it: the least audit of a cheapest path, and the state after it.

    Results are in rows of four per segment. Segments should be of similar length.
    """
    cost = costs_to_go(kinds, lens, left)
    tail, letter, head = optimal_arcs(kinds, lens, cost)
    begin = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))  # every node has an arc
    number = np.arange(len(tail))

    def least(rank: np.ndarray) -> np.ndarray:
        """The arc of least rank out of every node."""
        return np.minimum.reduceat(rank * len(tail) + number, begin) % len(tail)

    rank, follow = letter, least(letter)[head]
    doubled = [follow]
    while letter[follow].any():
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[follow], return_inverse=True)
        follow = follow[follow]
        doubled.append(follow)
    node = np.cumsum(lens + 1) - (lens + 1)
    path = least(rank)[(node[:, None] * STATES + np.arange(STATES)).ravel()][:, None]
    for follow in doubled:
        path = np.concatenate([path, follow[path]], axis=1)
    said = np.frombuffer(LETTERS, np.uint8)[letter[path]]
    width = (said > 0).sum(axis=1)
    audits = [row[:n].tobytes().decode() for row, n in zip(said, width.tolist(), strict=True)]
    return audits, tail[path[:, -1]] % STATES


def all_least_paths(kinds: list[np.ndarray], left: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """``least_paths`` of segments of any lengths: those of similar length together, some ``BATCH_TURNS`` at a time."""
    lens = np.fromiter(map(len, kinds), np.int64, len(kinds))
    order = np.argsort(lens, kind="stable")
    size = np.ceil(np.log2(lens[order] + 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(size) | np.diff(np.cumsum(lens[order]) // BATCH_TURNS)) + 1
    audits: list[list[str]] = [[]] * len(kinds)
    states = np.zeros((len(kinds), STATES), np.int64)
    for part in np.split(order, cut):
        if len(part):
            said, after = least_paths(np.concatenate([kinds[i] for i in part]), lens[part], left[part])
            states[part] = after.reshape(-1, STATES)
            for k, i in enumerate(part.tolist()):
                audits[i] = said[k * STATES : (k + 1) * STATES]
    return audits, states


# -- tables ----------------------------------------------------------------------------------


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place and what repair has to know of a turn; written once, in order.

    Places grow along a conversation, by one from turn to turn within a segment.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumns(
        {
            "segment": F.floor(F.col("place") / SEGMENT),
            "initial": kind.cast("int"),
            "blank": trimmed == "",
            "truncated": (trimmed != "") & ~F.substring(trimmed, -1, 1).isin(*STOPS),
            "digest": F.unhex(F.sha2(named, 256)),
        }
    )
    return staged(rows, "turns")


def repeated_turns(rows: DataFrame) -> DataFrame:
    """conv_id, segment, place of turns whose role and text came before in the conversation."""
    told = rows.where(~F.col("blank")).select("conv_id", "segment", "place", "digest")
    groups = told.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return attach_groups(told, groups, ["digest"], "place", "first", "n").where("place > first").select("conv_id", "segment", "place")


def segments(rows: DataFrame) -> DataFrame:
    """A row per segment: its turns as numbers, counts of faults, and its matrix of costs."""
    mark = F.col("initial") + F.when(F.col("blank"), MUST_GO).otherwise(0) + F.when(F.col("truncated"), TRUNCATED).otherwise(0)
    marks = rows.select("conv_id", "segment", "place", mark.alias("mark"))
    again = repeated_turns(rows).withColumn("mark", F.lit(-1))
    grouped = marks.unionByName(again).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "mark"))).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _runs(pc.list_value_length(batch.column("marks")).to_numpy()):
                yield _segment_rows(batch.slice(i, j - i))

    schema = "conv_id long, segment long, first long, kinds binary, blank long, duplicate long, truncated long, illegal long, through array<long>"
    return staged(grouped.mapInArrow(run, schema), "segments")


def _segment_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat = batch.column("marks").flatten()
    place, mark = (flat.field(k).to_numpy() for k in (0, 1))
    owner = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("marks")).to_numpy())
    said = mark < 0  # sorted before the turn of the same place
    twice = np.concatenate([[False], said[:-1]])[~said]
    kinds, owner, place = mark[~said].astype(np.int64), owner[~said], place[~said]
    blank = (kinds & MUST_GO) > 0
    cut = ((kinds & TRUNCATED) > 0) & ~twice
    kinds = (kinds & 3) | np.where(blank | twice, MUST_GO, 0) | np.where(cut, TRUNCATED, 0)
    lens = np.bincount(owner, minlength=len(batch))
    begin = np.cumsum(lens) - lens
    odd = ~_legal(kinds[:-1] & 3, kinds[1:] & 3) & (owner[1:] == owner[:-1])
    raw = kinds.astype(np.uint8).tobytes()
    return pa.RecordBatch.from_pydict(
        {
            "conv_id": batch.column("conv_id"),
            "segment": batch.column("segment"),
            "first": place[begin],
            "kinds": [raw[a : a + n] for a, n in zip(begin.tolist(), lens.tolist(), strict=True)],
            "blank": np.bincount(owner[blank], minlength=len(batch)),
            "duplicate": np.bincount(owner[twice], minlength=len(batch)),
            "truncated": np.bincount(owner[cut], minlength=len(batch)),
            "illegal": np.bincount(owner[1:][odd], minlength=len(batch)),
            "through": pa.array(matrices(kinds, lens).reshape(len(batch), -1).tolist(), pa.list_(pa.int64())),
        }
    )


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return ((after == USER) & ((before == SYSTEM) | (before == ASSISTANT))) | ((before == USER) & (after == ASSISTANT))


def _runs(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold some ``BATCH_TURNS`` marks."""
    bounds = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BATCH_TURNS, side="right")) - 1)
        yield i, j
        i = j


def costs_left(found: DataFrame) -> DataFrame:
    """Segments with the cost that is left after them, the cost of the conversation, and pairs illegal across segments.

    Streams the segments of a conversation, the last one first; four numbers are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple | None = None
        left, after = list(END_COST), 0
        for batch in batches:
            lefts, costs, pairs = [], [], []
            kinds = batch.column("kinds")
            for k, (now, through) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("through").to_pylist(), strict=True)):
                codes = kinds[k].as_py()
                if conv != (now,):
                    conv, left, after = (now,), list(END_COST), 0
                pairs.append(int(after > 0 and not _legal(np.int64(codes[-1] & 3), np.int64(after - 1))))
                after = (codes[0] & 3) + 1
                lefts.append(left)
                left = [min(through[s * STATES + t] + left[t] for t in range(STATES)) for s in range(STATES)]
                costs.append(left[0])
            columns = [batch.column(c) for c in ("conv_id", "segment", "first", "kinds")]
            columns += [pa.array(lefts, pa.list_(pa.int64())), pa.array(costs, pa.int64()), pa.array(pairs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "first", "kinds", "left", "cost", "pairs"])

    ordered = found.select("conv_id", "segment", "first", "kinds", "through").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", F.col("segment").desc())
    return staged(ordered.mapInArrow(run, "conv_id long, segment long, first long, kinds binary, left array<long>, cost long, pairs long"), "left")


def paths(left: DataFrame) -> DataFrame:
    """For each segment and state before it, the least audit and the state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [np.frombuffer(k, np.uint8).astype(np.int64) for k in batch.column("kinds").to_pylist()]
            rest = np.array(batch.column("left").to_pylist(), np.int64).reshape(-1, STATES)
            audits, states = all_least_paths(kinds, rest)
            columns = [batch.column(c) for c in ("conv_id", "segment", "first")]
            columns += [pa.array(list(map(len, kinds)), pa.int64()), pa.array(audits, pa.list_(pa.string())), pa.array(states.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "first", "turns", "audits", "states"])

    # as many tasks as there are shuffle partitions: few bytes, much to compute
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = left.select("conv_id", "segment", "first", "kinds", "left").repartition(parts, "segment", "conv_id")
    return spread.mapInArrow(run, "conv_id long, segment long, first long, turns long, audits array<string>, states array<long>")


def edits(found: DataFrame) -> DataFrame:
    """conv_id, first, turns, state and audit of each segment, and of the end of each conversation.

    Streams the segments of a conversation from the first; the state is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple | None = None
        state, end = 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if conv != (row["conv_id"],):
                    if conv:
                        out.append((conv[0], end, 0, state, END_AUDIT[state]))
                    conv, state = (row["conv_id"],), 0
                out.append((conv[0], row["first"], row["turns"], state, row["audits"][state]))
                state, end = row["states"][state], row["first"] + row["turns"]
            yield _edit_rows(out)
        if conv:
            yield _edit_rows([(conv[0], end, 0, state, END_AUDIT[state])])

    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return staged(ordered.mapInArrow(run, "conv_id long, place long, turns long, state int, audit string"), "edits")


def _edit_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = ("conv_id", pa.int64()), ("place", pa.int64()), ("turns", pa.int64()), ("state", pa.int32()), ("audit", pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


_STATE_AFTER = {"s": 1, "u": 2, "a": 3}


def apply_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text of the turns that stay or are inserted.

    All turns of a conversation follow each other in one partition, in order; they are streamed.
    """
    said = found.select("conv_id", "place", F.lit(0).alias("kind"), "state", "turns", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    told = rows.select("conv_id", "place", F.lit(1).alias("kind"), F.lit(0).alias("state"), F.lit(0).cast("long").alias("turns"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    ordered = said.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state = "", 0, 0
        for batch in batches:
            conv, edit, turn, role, text = [], [], [], [], []

            def put(c, e, n, r, t, out=(conv, edit, turn, role, text)):
                for column, value in zip(out, (c, e, n, r, t), strict=True):
                    column.append(value)

            light = {c: batch.column(c).to_pylist() for c in ("conv_id", "kind", "state", "turns", "audit", "turn", "role")}
            for k, (c, kind) in enumerate(zip(light["conv_id"], light["kind"], strict=True)):
                if kind == 0:
                    audit, at, state = light["audit"][k], 0, light["state"][k]
                while at < len(audit) and audit[at] == "I" and (kind or not light["turns"][k]):
                    put(c, "I", None, FILL_ROLE[state], "")
                    state, at = int(FILL[state]), at + 1
                if kind == 0:
                    continue
                done, at = audit[at], at + 1
                if done == "K":
                    state = _STATE_AFTER[light["role"][k][0]]
                    put(c, "K", light["turn"][k], light["role"][k], batch.column("text")[k].as_py())
                elif done == "R":
                    put(c, "R", light["turn"][k], FILL_ROLE[state], batch.column("text")[k].as_py())
                    state = int(FILL[state])
            columns = [pa.array(conv, pa.int64()), pa.array(edit, pa.string()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "edit", "turn", "role", "text"])

    return ordered.mapInArrow(run, "conv_id long, edit string, turn long, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation: gaps, counts of faults, cost and audit; and the repaired turns.

    The turns are conv_id, edit, turn, role, text, in order and each conversation in one partition.
    """
    rows = ordered_turns(turns)
    parts = segments(rows)
    left = costs_left(parts)
    found = edits(paths(left))
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    faults = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum("illegal").alias("within"))
    price = F.min_by("cost", "segment").alias("cost")
    prices = left.groupBy("conv_id").agg(price, F.sum("pairs").alias("across"))
    in_order = F.sort_array(F.collect_list(F.struct("place", "audit")))
    audits = found.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x["audit"]), "").alias("audit"))
    whole = _by_conversation(gaps, faults, prices, audits)
    whole = whole.withColumn("illegal", F.col("within") + F.col("across")).drop("within", "across")
    return whole, apply_edits(rows, found)


def _by_conversation(*tables: DataFrame) -> DataFrame:
    """Tables of one row per conversation side by side; conv_id may be null."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in whole.columns if c != "conv_id"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` lines of turns as ``repair`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in batches:
            done = []
            texts = batch.column("text")
            for k, (now, role) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), strict=True)):
                if conv != (now,):
                    if conv:
                        done.append((conv[0], held.hexdigest()))
                    conv, held = (now,), hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(role.encode() + b":" + texts[k].as_py().encode())
            yield _digest_rows(done)
        if conv:
            yield _digest_rows([(conv[0], held.hexdigest())])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that a checksum of conversation and turn decides; nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), dealt.alias("_dealt")).where("_dealt <> 0")
    text = F.when(F.col("_dealt") == 1, F.lit("")).when(F.col("_dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_dealt") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def damage_and_repair(turns: DataFrame) -> DataFrame:
    """The report of every conversation of ``turns`` (conv_id, turn, role, text) after damage and repair."""
    report, repaired = repair(damage(turns))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = _by_conversation(every, report, digests(repaired))
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
