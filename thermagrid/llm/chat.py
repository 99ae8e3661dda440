"""Chat formatting into prefix trees: shared initial turns are emitted once, with position ids and attention spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: The marks of the template, and the strings that common chat templates give a meaning.
BEGIN, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (BEGIN, BETWEEN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
#: Conversations and characters of one packed tree at most (a longer conversation has a tree of its own).
TREE_CONVERSATIONS, TREE_CHARACTERS = 512, 1 << 17

_control = re.compile("|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)))
_escaped = re.compile(r"\\(\\?)", re.S)


def escape(text: str) -> str:
    """text with backslashes doubled and one put after the first character of each control string."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and the span of its text in it."""
    head = BEGIN + escape(role) + BETWEEN
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation.  A control string cannot occur inside what was escaped."""
    found = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, rest = part.partition(BETWEEN)
        found.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return found


TREES = (
    "tree long, text string, position array<int>, loss array<array<long>>, "
    "nodes array<struct<start:long,end:long,position:long,attends:array<array<long>>>>, leaves array<struct<conv_id:long,node:int>>"
)


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, turns): turns in order as (role, text), and a hash of each.

    Order: turn, nulls first, then role and text.  A null role or text is empty.  Each row without a conv_id is a
    conversation of its own.  A conversation's turns are gathered, as its format is one text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    named = rows.where(F.col("conv_id").isNotNull())
    whole = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: _order(a, b)).alias("t"))
    whole = whole.union(rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("t")))
    return whole.select(
        "conv_id",
        F.transform("t", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def _order(a, b):
    def by(name, more):
        x, y = a[name], b[name]
        return (
            F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(more)
        )

    return by("turn", by("role", by("text", F.lit(0))))


def trees(conversations: DataFrame, most: int = TREE_CONVERSATIONS, characters: int = TREE_CHARACTERS) -> DataFrame:
    """Packed prefix trees of conversations (conv_id, turn, role, text).

    One row for each tree: text, the tokens (characters) of all nodes depth first, each shared turn once; position,
    the position id of each token, counted along its own conversation; loss, the spans of assistant texts; nodes, in
    order, with their span, their first position and the spans they attend to beside their own, that is their
    ancestors'; leaves, the conversations and the node where each ends (repeated conversations end at one node).

    Conversations are range-partitioned and sorted by the hashes of their turns, so those that share turns are
    neighbours, and each task builds trees in one pass, closing one at ``most`` conversations or ``characters``
    characters.  A first turn that a third of all conversations share is thus spread over many trees that each hold it
    once; equal conversations are spread by conv_id.

    Null role or text: empty.  Repeated rows: repeated turns.  Empty and very long texts need no exception.  Other
    columns are ignored.  No rows: no rows.
    """
    bounded_batches(conversations.sparkSession)
    ready = stored(paths(conversations), "paths")
    sorted_ = ready.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Tree()
        for b in batches:
            for conv_id, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                own = [(t["role"], t["text"]) for t in turns]
                if tree.leaves and (len(tree.leaves) >= most or tree.size + tree.adds(own) > characters):
                    yield tree.row()
                    tree = _Tree()
                tree.add(conv_id, own)
        if tree.leaves:
            yield tree.row()

    return sorted_.select("conv_id", "turns").mapInArrow(build, TREES)


class _Tree:
    def __init__(self):
        self.size, self.pieces, self.loss, self.nodes, self.leaves = 0, [], [], [], []
        self.open: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.open)) and self.open[n][0] == turns[n]:
            n += 1
        return n

    def adds(self, turns: list[tuple[str, str]]) -> int:
        return sum(len(turn(*t)[0]) for t in turns[self.shared(turns) :])

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        n = self.shared(turns)
        del self.open[n:]
        for t in turns[n:]:
            formatted, a, b = turn(*t)
            attends, position = [], 0
            if self.open:
                above = self.nodes[self.open[-1][1]]
                attends = [*above["attends"], [above["start"], above["end"]]]
                position = above["position"] + above["end"] - above["start"]
            if t[0] == LEARNED:
                self.loss.append([self.size + a, self.size + b])
            self.open.append((t, len(self.nodes)))
            self.nodes.append({"start": self.size, "end": self.size + len(formatted), "position": position, "attends": attends})
            self.pieces.append(formatted)
            self.size += len(formatted)
        self.leaves.append({"conv_id": conv_id, "node": self.open[-1][1] if self.open else -1})

    def row(self) -> pa.RecordBatch:
        position = np.concatenate([np.arange(n["position"], n["position"] + n["end"] - n["start"], dtype=np.int32) for n in self.nodes])
        spans = pa.list_(pa.list_(pa.int64()))
        node = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("attends", spans)])
        leaf = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])
        first = self.leaves[0]["conv_id"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([first], pa.int64()),
                pa.array(["".join(self.pieces)], pa.string()),
                pa.ListArray.from_arrays(pa.array([0, len(position)], pa.int32()), pa.array(position)),
                pa.array([self.loss], spans),
                pa.array([self.nodes], pa.list_(node)),
                pa.array([self.leaves], pa.list_(leaf)),
            ],
            ["tree", "text", "position", "loss", "nodes", "leaves"],
        )


def read_back(packed: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the packed trees alone."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree in b.select(["text", "loss", "nodes", "leaves"]).to_pylist():
                text, nodes, done = tree["text"], tree["nodes"], {}
                masks = tree["loss"]
                starts = np.array([m[0] for m in masks])
                rows = []
                for leaf in tree["leaves"]:
                    if leaf["node"] not in done:
                        node = nodes[leaf["node"]]
                        spans = [*node["attends"], [node["start"], node["end"]]]
                        formatted = "".join(text[x:y] for x, y in spans)
                        turns = parse(formatted)
                        learned = []
                        for x, y in spans:
                            for k in range(*np.searchsorted(starts, (x, y))):
                                learned.append(unescape(text[masks[k][0] : masks[k][1]]))
                        all_learned = "".join(learned)
                        said = "".join(f"{r}\n{t}\n" for r, t in turns)
                        done[leaf["node"]] = (
                            len(turns),
                            digest(said.encode("utf-8", "surrogatepass")),
                            len(all_learned),
                            digest(all_learned.encode("utf-8", "surrogatepass")),
                            len(formatted),
                        )
                    rows.append((leaf["conv_id"], *done[leaf["node"]]))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                )

    return packed.mapInArrow(unpack, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
