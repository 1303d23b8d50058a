"""Conversations as a prefix tree: shared first turns are emitted once, depth first.

A node is one turn after one sequence of earlier turns. Sorted by the chain of
turn digests on the way to it, nodes are in depth-first order, so one range
partitioning lays out the whole stream, however many conversations share a turn.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lakegraph.llm.common import arrow_types
from lakegraph.session import cut

# The markers of the template, and other control strings that texts may hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
LEARNED_ROLES = ("assistant",)
KEY_BYTES = 16

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escape(text: str) -> str:
    """Puts one backslash more after the first character of every control string, escaped or not."""
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Header, escaped text and end of a turn."""
    return f"{OPEN}{escape_role(role)}\n", escape(text), f"{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of turns")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of turns")
    return turns


class Tokens:
    """Byte-level tokens of a public vocabulary, with one id more for each marker."""

    def __init__(self, ranks: bytes, pattern: str):
        ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        first = max(ranked.values()) + 2
        self.encoding = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranked, special_tokens={OPEN: first, CLOSE: first + 1})
        self.open, self.close = first, first + 1
        self.newline = self.encoding.encode_ordinary("\n")

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and where its text begins and ends among them."""
        head, body, _ = format_turn(role, text)
        ids = [self.open, *self.encoding.encode_ordinary(head[len(OPEN):])]
        begin = len(ids)
        ids += self.encoding.encode_ordinary(body)
        end = len(ids)
        return [*ids, self.close, *self.newline], begin, end

    def text(self, ids) -> str:
        return self.encoding.decode(ids)


_loaded: dict[str, Tokens] = {}


def _tokens(ranks, pattern: str) -> Tokens:
    if pattern not in _loaded:
        _loaded[pattern] = Tokens(ranks.value, pattern)
    return _loaded[pattern]


_INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_STEP = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("path", T.BinaryType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("is_last", T.BooleanType()),
])
_LAID = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("path", T.BinaryType()),
    T.StructField("n_ending", T.LongType()), T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("loss_from", T.IntegerType()), T.StructField("loss_to", T.IntegerType()),
    T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("near", _INTERVALS), T.StructField("n_far", T.IntegerType()),
])


def steps(conversations: DataFrame) -> DataFrame:
    """One row per turn with the chain of digests that leads to it; a conversation is put together in one row first."""
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in _STEP.fields]
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = key = b""
                for i, turn in enumerate(turns):
                    said = f"{len(turn['role'])}:{turn['role']}{turn['text']}".encode()
                    key = hashlib.blake2b(key + said, digest_size=KEY_BYTES).digest()
                    path += key
                    for column, value in zip(out, (conv_id, path, turn["role"], turn["text"], i == len(turns) - 1)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow_types(_STEP.fields))], names=_STEP.names)

    return grouped.select("conv_id", "turns.role", "turns.text").select(
        "conv_id", F.arrays_zip("role", "text").alias("turns")).mapInArrow(run, _STEP)


def lay_out(nodes: DataFrame, ranks, pattern: str) -> DataFrame:
    """Tokens of all nodes in depth-first order, with offsets inside the partition.

    ``near``: intervals of the ancestors in this partition. The others, ``n_far``, are
    on the way to the partition's first node as well, as the order is by path.
    """
    def run(batches):
        tokens = _tokens(ranks, pattern)
        part, place, offset, open_nodes = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            out = [[] for _ in _LAID.fields]
            for path, role, text, n_ending in zip(*(batch.column(i).to_pylist() for i in range(4))):
                while open_nodes and not path.startswith(open_nodes[-1][0]):
                    open_nodes.pop()
                ids, begin, end = tokens.turn(role, text)
                if role not in LEARNED_ROLES:
                    begin = end = 0
                near = [{"start": a, "stop": b} for _, a, b in open_nodes]
                far = len(path) // KEY_BYTES - 1 - len(near)
                row = (part, place, path, n_ending, offset, len(ids), begin, end, ids, near, far)
                for column, value in zip(out, row):
                    column.append(value)
                open_nodes.append((path, offset, offset + len(ids)))
                offset += len(ids)
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow_types(_LAID.fields))], names=_LAID.names)

    ordered = nodes.repartitionByRange("path").sortWithinPartitions("path")
    return ordered.select("path", "role", "text", "n_ending").mapInArrow(run, _LAID)


def prefix_tree(
    conversations: DataFrame, ranks_file: str, pattern: str,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The token stream of all conversations, and where each conversation ends in it.

    Stream, one row per node: ``path``, ``start, stop`` (place of its tokens in the
    stream), ``tokens``, ``position_ids`` (depth in tokens from the first turn),
    ``ancestors`` (intervals of the stream it may attend to, besides its own tokens),
    ``loss_from, loss_to`` (the assistant's text within the tokens) and ``n_ending``.
    Ends: ``conv_id, path``.

    Rows of a conversation go by (turn, role, text); null roles and texts are empty,
    rows of null id are one conversation, repeated rows are turns of their own. A
    conversation must fit one row, a tree need not. Other columns are not read; an
    empty table gives an empty stream.
    """
    sc = conversations.sparkSession.sparkContext
    with open(ranks_file, "rb") as f:
        ranks = sc.broadcast(f.read())
    rows = conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    walked = cut(steps(rows))
    nodes = walked.groupBy("path", "role", "text").agg(F.count_if("is_last").alias("n_ending"))
    laid = cut(lay_out(nodes, ranks, pattern))
    parts = laid.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = cut(parts.select("part", F.coalesce(
        F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    placed = laid.join(bases, "part")
    # Ancestors in earlier partitions: looked up once per partition, by its first node.
    wanted = laid.where("place = 0 AND n_far > 0").select("part", "path", F.explode(F.sequence(F.lit(1), "n_far")).alias("depth"))
    wanted = wanted.select(F.col("part").alias("at"), F.expr(f"substring(path, 1, depth * {KEY_BYTES})").alias("path"))
    found = wanted.join(placed.select("path", "base", "inside", "n_tokens"), "path").select(
        "at", F.struct((F.col("base") + F.col("inside")).alias("start"), (F.col("base") + F.col("inside") + F.col("n_tokens")).alias("stop")).alias("i"))
    far = cut(found.groupBy("at").agg(F.sort_array(F.collect_list("i")).alias("far")))
    shifted = F.transform("near", lambda i: F.struct((i.start + F.col("base")).alias("start"), (i.stop + F.col("base")).alias("stop")))
    before = F.when(F.col("n_far") > 0, F.slice("far", 1, F.greatest("n_far", F.lit(1)))).otherwise(F.array().cast(_INTERVALS))
    stream = placed.join(far, placed.part == far.at, "left").select(
        "path", (F.col("base") + F.col("inside")).alias("start"), (F.col("base") + F.col("inside") + F.col("n_tokens")).alias("stop"),
        "tokens", F.concat(before, shifted).alias("ancestors"), "loss_from", "loss_to", "n_ending")
    depth = F.aggregate("ancestors", F.lit(0).cast("bigint"), lambda n, i: n + i.stop - i.start)
    stream = stream.withColumn("position_ids", F.transform("tokens", lambda t, i: (depth + i).cast("int")))
    return stream, walked.where("is_last").select("conv_id", "path")


def read_back(stream: DataFrame, ends: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Every conversation, decoded from what its last node attends to.

    ``conv_id, turns`` (roles and texts), ``loss`` (the texts under the loss mask, in
    order) and ``formatted``. Each distinct conversation is read once.
    """
    with open(ranks_file, "rb") as f:
        ranks = stream.sparkSession.sparkContext.broadcast(f.read())
    seen = F.concat("ancestors", F.array(F.struct("start", "stop")))
    stream = cut(stream.select("path", "start", "stop", "tokens", "ancestors", "loss_from", "loss_to", "n_ending"))
    wanted = stream.where("n_ending > 0").select(F.col("path").alias("leaf"), F.explode(seen).alias("i")).select("leaf", F.col("i.start").alias("start"))
    pieces = wanted.join(stream.select("start", "tokens", "loss_from", "loss_to"), "start")
    whole = pieces.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("start", "tokens", "loss_from", "loss_to"))).alias("pieces"))
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([
        T.StructField("leaf", T.BinaryType()), T.StructField("turns", T.ArrayType(turn)),
        T.StructField("loss", T.ArrayType(T.StringType())), T.StructField("formatted", T.StringType())])

    def run(batches):
        tokens = _tokens(ranks, pattern)
        for batch in batches:
            out = [[], [], [], []]
            for leaf, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                formatted = tokens.text([t for p in row for t in p["tokens"]])
                loss = [unescape(tokens.text(p["tokens"][p["loss_from"]:p["loss_to"]])) for p in row if p["loss_to"] > 0]
                turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                for column, value in zip(out, (leaf, turns, loss, formatted)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow_types(schema.fields))], names=schema.names)

    texts = cut(whole.mapInArrow(run, schema))
    return ends.join(texts, ends.path == texts.leaf).select("conv_id", "turns", "loss", "formatted")
