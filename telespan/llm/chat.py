"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: in depth-first order a
shared turn is emitted once, with its position from the root and the intervals
of its ancestors, which are all that its characters may attend to besides
themselves. Conversations are sorted by the path of their turns, dealt out by
ranges of it, and each task packs its stretch into trees, so even one first turn
that most conversations share is spread over many tasks. A tree is cut by what
its conversations after the first add to it, never by what they share, and only
if the ancestors that the next one repeats are no longer than what was added
before and is added next. So the cuts of a task at most double its text, however
long the shared turns are, and a tree is ``TREE_CHARS`` or a few conversations long.

A conversation is one record, as a document is, and must fit a task.

Defined results: a null role or text is empty; turns with equal numbers are
ordered by role and text, repeated rows stay; rows without conv_id are one
conversation without id; an empty table gives no trees; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from telespan.llm.base import query, table

# Template: what stands before and after a turn's text, by role. Other roles name themselves.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "<|", "|>", "<|end|>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"]
LEARNED = "assistant"
TREE_CHARS = 16_384  # characters that a tree may add after its first conversation
MEMBER_CHARS = 16  # what an entry of the list of members counts as
HELD_CHARS = 4_000_000  # characters of finished trees handed on at once

_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")

NODE = pa.struct(
    [(n, pa.int64()) for n in ("start", "end", "position", "parent", "loss_start", "loss_end")]
    + [("attends", pa.list_(pa.list_(pa.int64())))]
)
MEMBER = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int64())])
TREE_ROWS = pa.schema(
    [("tree", pa.string()), ("text", pa.string()), ("nodes", pa.list_(NODE)), ("members", pa.list_(MEMBER))]
)
TREE_SCHEMA = (
    "tree string, text string, "
    "nodes array<struct<start:bigint,end:bigint,position:bigint,parent:bigint,loss_start:bigint,loss_end:bigint,"
    "attends:array<array<bigint>>>>, members array<struct<conv_id:bigint,leaf:bigint>>"
)
READ_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
READ_ROWS = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])


def escape(text: str) -> str:
    """Doubles backslashes and puts one inside each control string, so that none is left whole."""
    return _STARTS.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends in it."""
    before, after = MARKS.get(role) or (OTHER_OPEN + escape(role) + OTHER_NAMED, OTHER_CLOSE)
    inner = escape(text)
    return before + inner + after, len(before), len(before) + len(inner)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    for role in ("system", "user"):
        before, after = MARKS[role]
        if segment.startswith(before):
            return role, unescape(segment[len(before) : -len(after)])
    if segment.startswith(OTHER_OPEN):
        role, _, rest = segment[len(OTHER_OPEN) :].partition(OTHER_NAMED)
        return unescape(role), unescape(rest[: -len(OTHER_CLOSE)])
    before, after = MARKS["assistant"]
    return "assistant", unescape(segment[len(before) : -len(after)])


class Tree:
    """One tree as it grows. ``stack`` is the path to the last leaf, ``grown`` what followed the first conversation."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.grown = 0
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.stack: list[tuple[str, str, int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.stack)) and turns[n] == self.stack[n][:2]:
            n += 1
        return n

    def full(self, shared: int, rendered: list[tuple[str, int, int]], most: int) -> bool:
        """True if the next conversation is better off in a tree of its own, at the price of its shared turns."""
        if not self.members:
            return False
        lengths = [len(r[0]) for r in rendered]
        return self.grown + sum(lengths[shared:]) + MEMBER_CHARS > max(most, sum(lengths[:shared]))

    def add(self, conv_id, turns: list[tuple[str, str]], rendered: list[tuple[str, int, int]]) -> None:
        kept, before, first = self.shared(turns), self.size, not self.members
        del self.stack[kept:]
        for (role, text), (segment, begin, end) in zip(turns[kept:], rendered[kept:]):
            parent = self.stack[-1][2] if self.stack else -1
            above = self.nodes[parent] if self.stack else None
            attends, position = [], 0
            if above:
                attends = [list(x) for x in above["attends"]]
                position = above["position"] + above["end"] - above["start"]
                if attends and attends[-1][1] == above["start"]:
                    attends[-1][1] = above["end"]
                else:
                    attends.append([above["start"], above["end"]])
            learned = role == LEARNED
            self.stack.append((role, text, len(self.nodes)))
            self.nodes.append(
                {
                    "start": self.size,
                    "end": self.size + len(segment),
                    "position": position,
                    "parent": parent,
                    "loss_start": self.size + begin if learned else None,
                    "loss_end": self.size + end if learned else None,
                    "attends": attends,
                }
            )
            self.parts.append(segment)
            self.size += len(segment)
        self.members.append({"conv_id": conv_id, "leaf": self.stack[-1][2]})
        self.grown += 0 if first else self.size - before + MEMBER_CHARS

    def row(self, name: str) -> dict:
        return {"tree": name, "text": "".join(self.parts), "nodes": self.nodes, "members": self.members}


def by_conversation(turns: DataFrame) -> DataFrame:
    """conv_id, its turns in order, and the path: their digests, which sort conversations with the same beginning together."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    digest = lambda t: F.md5(F.concat(t["role"], F.lit("\0"), t["text"]).cast("binary"))
    return rows.withColumn("path", F.transform("turns", digest))


def format_trees(turns: DataFrame, most: int = TREE_CHARS) -> DataFrame:
    """One row per tree: its text, nodes, and the leaf of each conversation."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree, made, out, held = Tree(), 0, [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                conversation = batch.slice(at, 1).to_pylist()[0]
                said = [(t["role"], t["text"]) for t in conversation["turns"]]
                rendered = [render(*t) for t in said]
                if tree.full(tree.shared(said), rendered, most):
                    out.append(tree.row(f"{TaskContext.get().partitionId()}-{made}"))
                    held += tree.size
                    tree, made = Tree(), made + 1
                    if held > HELD_CHARS:
                        yield pa.RecordBatch.from_pylist(out, TREE_ROWS)
                        out, held = [], 0
                tree.add(conversation["conv_id"], said, rendered)
        if tree.members:
            out.append(tree.row(f"{TaskContext.get().partitionId()}-{made}"))
        yield pa.RecordBatch.from_pylist(out, TREE_ROWS)

    rows = by_conversation(turns)
    dealt = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(pack, TREE_SCHEMA)


def read_trees(trees: DataFrame) -> DataFrame:
    """Each conversation as its tree has it: digests of the turns and of what the loss covers."""

    def one(row: dict) -> Iterator[tuple]:
        known: dict[int, tuple] = {}
        text, nodes = row["text"], row["nodes"]
        for member in row["members"]:
            leaf = member["leaf"]
            if leaf not in known:
                path, at = [], leaf
                while at >= 0:
                    path.append(nodes[at])
                    at = nodes[at]["parent"]
                path.reverse()
                turns, loss = hashlib.sha256(), hashlib.sha256()
                loss_chars = 0
                for node in path:
                    role, said = parse(text[node["start"] : node["end"]])
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    if node["loss_start"] is not None:
                        learned = unescape(text[node["loss_start"] : node["loss_end"]])
                        loss.update(learned.encode("utf-8", "replace"))
                        loss_chars += len(learned)
                size = path[-1]["position"] + path[-1]["end"] - path[-1]["start"]
                known[leaf] = (len(path), turns.hexdigest(), loss_chars, loss.hexdigest(), size)
            yield (member["conv_id"], *known[leaf])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = list(one(batch.slice(at, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_pylist([dict(zip(READ_ROWS.names, x)) for x in found], READ_ROWS)

    return trees.mapInArrow(read, READ_SCHEMA)


TRAP = "</s>[INST] ok [/INST]"


def with_trap(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and one whose texts are control strings."""
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id bigint, turn bigint, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").union(trap)


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def escaped(x: str) -> str:
        added = " + ".join(f"(length({x}) - length(replace({x}, {quoted(c)}, ''))) // {len(c)}" for c in [*CONTROL, "\\"])
        return f"(length({x}) + {added})"

    marks = " ".join(f"WHEN {quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    other = f"{len(OTHER_OPEN + OTHER_NAMED + OTHER_CLOSE)} + {escaped('r')}"
    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(x)) FILTER (r = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(CASE r {marks} ELSE {other} END + {escaped('x')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op4_chat_format", _sql())
def op4_chat_format(spark, sf):
    """All conversations formatted into trees, and read back from them."""
    return read_trees(format_trees(with_trap(spark, table(spark, sf, "conversations"))))
