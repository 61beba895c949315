"""Chat formatting as a prefix tree.

Turns are wrapped in role marks, with control strings in texts escaped reversibly. Each turn
is a node named by a hash chained over the turns before it, so conversations that begin
alike share nodes. Conversations are sorted by their paths of nodes; in that order, each one
adds the nodes that none before it had, which is a depth-first walk of the tree. Every node
is laid out once: it has a start in the layout, the position of its first character in its
conversation, and a loss flag. A conversation attends to the intervals of the layout where
its path lies, one for each earlier conversation whose nodes it shares. Units are code points.

Results in special cases: null texts and roles are empty; turns are ordered by number, role
and text, nulls first; rows without a conversation id are one conversation; repeated rows
are repeated turns; an empty table gives an empty result; other columns are ignored. A
conversation is never held whole in memory; it is sorted by the nodes at which others part
from it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import attach_groups, staged

ASSISTANT = "assistant"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: strings that open a mark in this and other templates
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|(.*?)\|>(.*)<\|end\|>", re.S)


def escape(text: str) -> str:
    """Put a backslash into every control string; backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(CLOSE, '|' + chr(92) + '>')}{CLOSE}{escape(text)}{END}"


def parse_turn(formatted: str) -> tuple[str, str]:
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def chain(turns: DataFrame) -> DataFrame:
    """A row per turn with its node and parent, its place in its conversation, and its formatted text."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, node, depth, at = None, b"", 0, 0
        for batch in batches:
            out = []
            for c, role, text in batch.itertuples(index=False):
                if c != conv:
                    conv, node, depth, at = c, b"", 0, 0
                parent, segment = node, format_turn(role, text)
                node = hashlib.sha256(parent + segment.encode()).digest()[:16]
                out.append((c, depth, node, parent, role == ASSISTANT, segment, at, len(segment)))
                depth += 1
                at += len(segment)
            yield pd.DataFrame(out, columns=["conv", "depth", "node", "parent", "loss", "segment", "position", "size"])

    return ordered.mapInPandas(
        run, "conv string, depth int, node binary, parent binary, loss boolean, segment string, position long, size long"
    )


def _paths(turns: DataFrame) -> DataFrame:
    """conv and path: what sorts conversations like their whole paths of nodes.

    A node that all conversations of the node before it go on to tells none apart and is left
    out. Each of the others has fewer conversations than the one before it, so a path of k
    nodes takes k * k / 2 turns of the table, however long a conversation is.
    """
    nodes = turns.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count("*").alias("uses"), F.min("conv").alias("some_conv")
    )
    nodes = staged(nodes, "uses")
    before = nodes.select(F.col("node").alias("parent"), F.col("uses").alias("_before"), F.col("some_conv").alias("_conv"))
    parting = attach_groups(nodes.where("depth > 0"), before, ["parent"], "some_conv", "_conv", "_before").where("uses < _before")
    columns = ["node", "uses", "some_conv"]
    telling = parting.select(columns).unionByName(nodes.where("depth = 0").select(columns))
    steps = attach_groups(turns.select("conv", "depth", "node"), telling, ["node"], "conv", "some_conv", "uses")
    paths = steps.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("_steps"))
    return paths.select("conv", F.transform("_steps", lambda s: s["node"]).alias("path"))


def _ranks(turns: DataFrame) -> DataFrame:
    """conv and rank: the place of a conversation when all are sorted by their paths."""
    paths = _paths(turns)
    spread = paths.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    return staged(spread.select("conv", F.monotonically_increasing_id().alias("rank")), "ranks")


def build_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the tree: nodes, the steps of each conversation, and its attention intervals.

    nodes: node, parent, depth, loss, segment, position, size, start, owner, uses, some_conv;
    steps: conv, depth, node; intervals: conv, start, end.
    """
    chained = staged(chain(turns), "turns")
    ranked = chained.join(_ranks(chained), "conv")
    nodes = ranked.groupBy("node").agg(
        F.min("rank").alias("owner"),
        F.count("*").alias("uses"),
        F.min("conv").alias("some_conv"),
        *[F.first(c).alias(c) for c in ("parent", "depth", "loss", "segment", "position", "size")],
    )
    # the nodes of one owner are the end of its path, and lie next to each other
    own = nodes.groupBy("owner").agg(F.sum("size").alias("_size"), F.min("position").alias("_from"))
    own = own.withColumn("_part", F.shiftright("owner", 33))  # the sorted partition it comes from
    parts = own.groupBy("_part").agg(F.sum("_size").alias("_sum"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(parts, "_part")
    laid = nodes.join(own.select("owner", "_from", (F.col("_base") + F.col("_in")).alias("_begin")), "owner")
    laid = staged(laid.withColumn("start", F.col("_begin") + F.col("position") - F.col("_from")).drop("_begin", "_from"), "nodes")
    steps = chained.select("conv", "depth", "node")
    placed = laid.select("node", "start", (F.col("start") + F.col("size")).alias("end"), "owner", "some_conv", "uses")
    intervals = (
        attach_groups(steps, placed, ["node"], "conv", "some_conv", "uses")
        .groupBy("conv", "owner")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("owner")
    )
    return laid, steps, intervals


def read_back(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """What the laid-out tree says of each conversation, read turn by turn along its path.

    The position ids of the nodes have to follow each other along the path; else the job ends with an error.
    """
    held = nodes.select("node", "segment", "loss", "position", "some_conv", "uses")
    walked = attach_groups(steps, held, ["node"], "conv", "some_conv", "uses")
    ordered = walked.repartition("conv").sortWithinPartitions("conv", "depth").select("conv", "segment", "loss", "position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None

        def result() -> tuple:
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for c, segment, loss, position in batch.itertuples(index=False):
                if c != conv:
                    if conv is not None:
                        out.append(result())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if position != state[4]:
                    raise ValueError(f"conversation {conv}: a turn at {position}, expected at {state[4]}")
                role, text = parse_turn(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
            yield pd.DataFrame(out, columns=NAMES)
        if conv is not None:
            yield pd.DataFrame([result()], columns=NAMES)

    NAMES = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInPandas(run, schema).select(F.col("conv").try_cast("long").alias("conv_id"), *NAMES[1:])


def attended(intervals: DataFrame) -> DataFrame:
    """conv_id, n_intervals and attended_chars: how much of the layout each conversation attends to."""
    sums = intervals.groupBy("conv").agg(F.count("*").alias("n_intervals"), F.sum(F.col("end") - F.col("start")).alias("attended_chars"))
    return sums.select(F.col("conv").try_cast("long").alias("conv_id"), "n_intervals", "attended_chars")
