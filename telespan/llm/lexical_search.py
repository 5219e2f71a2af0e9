"""Ranked lexical search over a document FP-tree.

Only terms of the items count, so every document becomes a restricted vector:
the item terms it holds with their frequencies, and its length. Terms are
numbered by falling document frequency, and documents sorted by these numbers
share the paths of a trie. A trie node knows the largest tf of every term below
it, and the smallest m and doc_id. Contributions rise with tf and fall with m,
so these bound the score of every document below. The trie is walked depth
first; each item follows only the branches whose bound can still enter its best
ten, and leaves are scored exactly.

A task builds one trie after the other from bounded slices of its documents and
carries the best ten of every item on, so later slices are pruned harder. Tasks
emit ten rows an item; the ten best of these are the answer. Items are taken in
blocks of bounded size, and a block is searched in all documents.

Defined results: a null text has no terms and is no document of N; an item
without terms gives no rows; a repeated item row gives its ranking again, under
the same item_id; repeated document rows are ranked one by one; a row without
doc_id ranks after those with one at the same score; empty tables give no rows;
texts of any length are read in pieces; further columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from telespan.llm.base import documents, query, table, whole_text
from telespan.scratch import materialize

BEST = 10
BLOCK_BYTES = 500_000  # item text searched at once
TREE_DOCS, TREE_TERMS = 20_000, 2_000_000  # documents and vector entries of one trie
LEAF = 16  # documents of a leaf
PIECE = 1_000_000  # bytes of a text split at once

# Bytes of terms stay, A-Z in lower case; all others separate. Bytes over 0x7F belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

VECTOR = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
FOUND = pa.schema([("item_no", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    raw = text.encode("utf-8", "replace").translate(_TERMS)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def counts_of(text: str) -> Counter:
    found: Counter = Counter()
    for words in terms_of(text):
        found.update(words)
    return found


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document row: doc_id, number of terms, and the item terms it holds with their frequencies."""

    def restricted(batches):
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                found = counts_of(text.as_py())
                n.append(found.total())
                held = [(vocabulary[t], k) for t, k in found.items() if t in vocabulary]
                terms.append([t for t, _ in held])
                tfs.append([k for _, k in held])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return materialize(rows.mapInArrow(restricted, VECTOR), "search-vectors")


@dataclass
class Node:
    """Documents ``lo`` to ``hi`` of the sorted slice, which share a path."""

    lo: int
    hi: int
    terms: np.ndarray  # terms below, rising
    tfs: np.ndarray  # the largest tf of each
    m: int
    first_id: int
    below: list["Node"] = field(default_factory=list)


class Tree:
    """Trie of restricted vectors whose terms are numbered by falling document frequency."""

    def __init__(self, ids: np.ndarray, ms: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]):
        paths = [terms.astype(">u4").tobytes() for terms, _ in rows]
        order = sorted(range(len(rows)), key=lambda i: (paths[i], int(ms[i]), int(ids[i])))
        self.ids, self.ms = ids[order], ms[order]
        self.rows = [rows[i] for i in order]
        self.root = self._node(0, len(order)) if order else None

    def _leaf(self, lo: int, hi: int) -> Node:
        terms = np.concatenate([t for t, _ in self.rows[lo:hi]])
        tfs = np.concatenate([k for _, k in self.rows[lo:hi]])
        return self._merged(lo, hi, terms, tfs, int(self.ms[lo:hi].min()), int(self.ids[lo:hi].min()), [])

    @staticmethod
    def _merged(lo, hi, terms, tfs, m, first_id, below) -> Node:
        order = np.argsort(terms, kind="stable")
        terms, tfs = terms[order], tfs[order]
        start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, dtype=np.int64)
        most = np.maximum.reduceat(tfs, start) if len(terms) else tfs
        return Node(lo, hi, terms[start], most, m, first_id, below)

    def _node(self, lo: int, hi: int) -> Node:
        """Built bottom up from an explicit stack: paths may be longer than Python's recursion."""
        done: list[Node] = []
        todo = [(lo, hi, None)]
        while todo:
            lo, hi, parts = todo.pop()
            if parts is not None:
                below = done[-parts:]
                del done[-parts:]
                below = below[::-1]
                terms = np.concatenate([c.terms for c in below])
                tfs = np.concatenate([c.tfs for c in below])
                done.append(self._merged(lo, hi, terms, tfs, min(c.m for c in below), min(c.first_id for c in below), below))
            elif hi - lo <= LEAF:
                done.append(self._leaf(lo, hi))
            else:
                cuts = self._branches(lo, hi)
                todo.append((lo, hi, len(cuts) - 1))
                todo.extend((a, b, None) for a, b in zip(cuts, cuts[1:]))
        return done[0]

    def _branches(self, lo: int, hi: int) -> list[int]:
        """Where the next term after the shared path changes; equal paths are cut by number."""
        first, last = self.rows[lo][0], self.rows[hi - 1][0]
        both = min(len(first), len(last))
        differs = np.flatnonzero(first[:both] != last[:both])
        depth = int(differs[0]) if len(differs) else both
        if len(first) == len(last) == depth:
            return [*range(lo, hi, max(LEAF, -(-(hi - lo) // 16))), hi]
        following = [int(t[depth]) if len(t) > depth else -1 for t, _ in self.rows[lo:hi]]
        return [lo, *(lo + i for i in range(1, hi - lo) if following[i] != following[i - 1]), hi]


class Search:
    """The best documents of every item over all trees it is shown."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, best: int = BEST):
        """``items``: the terms of each item with repeats; ``weights``: w of each term."""
        self.of = np.repeat(np.arange(len(items)), [len(t) for t in items])
        self.flat = np.concatenate(items) if items else np.zeros(0, dtype=np.int64)
        self.starts = np.r_[0, np.cumsum([len(t) for t in items])].astype(np.int64)
        self.weights, self.best = weights, best
        self.top: list[list[tuple[int, int]]] = [[] for _ in items]  # (-score, doc_id), best first
        self.bound = np.zeros(len(items), dtype=np.int64)  # score of the worst kept; 0 while there is room
        self.bound_id = np.full(len(items), -1, dtype=np.int64)
        self._dense = np.zeros(len(weights), dtype=np.int64)

    def _scores(self, items: np.ndarray, flat: np.ndarray, cuts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: int) -> np.ndarray:
        tf = tfs.astype(np.int64)
        self._dense[terms] = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        out = np.add.reduceat(self._dense[flat], cuts)
        self._dense[terms] = 0
        return out

    def _flat(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[items + 1] - self.starts[items]
        cuts = np.r_[0, np.cumsum(sizes)][:-1]
        at = np.repeat(self.starts[items] - cuts, sizes) + np.arange(int(sizes.sum()))
        return self.flat[at], cuts

    def _alive(self, items: np.ndarray, reach: np.ndarray, first_id: int) -> np.ndarray:
        worst = self.bound[items]
        return (reach > worst) | ((reach == worst) & (worst > 0) & (first_id < self.bound_id[items]))

    def show(self, tree: Tree) -> None:
        everyone = np.flatnonzero(np.diff(self.starts) > 0)
        if tree.root is None or not len(everyone):
            return
        stack = [(tree.root, everyone, None)]
        while stack:
            node, items, reach = stack.pop()
            if reach is not None:  # bounds may have risen since this branch was put off
                items = items[self._alive(items, reach, node.first_id)]
            if not len(items):
                continue
            flat, cuts = self._flat(items)
            if not node.below:
                self._leaf(tree, node, items, flat, cuts)
                continue
            branches = []
            for child in node.below:
                reach = self._scores(items, flat, cuts, child.terms, child.tfs, child.m)
                alive = self._alive(items, reach, child.first_id)
                if alive.any():
                    branches.append((int(reach[alive].sum()), len(branches), child, items[alive], reach[alive]))
            # The most promising branch is walked first, so it goes on the stack last.
            stack.extend((child, some, reach) for _, _, child, some, reach in sorted(branches, key=lambda b: b[:2]))

    def _leaf(self, tree: Tree, node: Node, items: np.ndarray, flat: np.ndarray, cuts: np.ndarray) -> None:
        for i in range(node.lo, node.hi):
            terms, tfs = tree.rows[i]
            doc_id = int(tree.ids[i])
            scores = self._scores(items, flat, cuts, terms, tfs, int(tree.ms[i]))
            for k in np.flatnonzero((scores > 0) & self._alive(items, scores, doc_id)).tolist():
                item = int(items[k])
                held = self.top[item]
                bisect.insort(held, (-int(scores[k]), doc_id))
                if len(held) > self.best:
                    held.pop()
                if len(held) == self.best:
                    self.bound[item], self.bound_id[item] = -held[-1][0], held[-1][1]


NO_ID = np.iinfo(np.int64).max  # stands for a missing doc_id, which ranks last


def _searcher(items: list[np.ndarray], weights: np.ndarray, rank: np.ndarray, n_docs: int, n_terms: int, best: int):
    """``rank``: number of each vocabulary term by falling document frequency."""

    def searched(batches):
        search = Search(items, weights, best)
        ids, ms, rows, held = [], [], [], 0

        def close():
            search.show(Tree(np.array(ids, dtype=np.int64), np.array(ms, dtype=np.int64), rows))

        for batch in batches:
            for doc_id, n, terms, tfs in zip(*(batch.column(k) for k in range(4))):
                t = rank[np.array(terms.values, dtype=np.int64)]
                order = np.argsort(t)
                rows.append((t[order], np.array(tfs.values, dtype=np.int64)[order]))
                ids.append(NO_ID if doc_id.as_py() is None else doc_id.as_py())
                ms.append(25 + 75 * n.as_py() * n_docs // n_terms)
                held += len(t)
                if len(rows) >= TREE_DOCS or held >= TREE_TERMS:
                    close()
                    ids, ms, rows, held = [], [], [], 0
        if rows:
            close()
        found = [(no, None if i == NO_ID else i, -s) for no, top in enumerate(search.top) for s, i in top]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    return searched


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[tuple], best: int = BEST) -> DataFrame:
    """item_no (place in ``items``), rank, doc_id, score. ``items``: (item_id, text) of a block of bounded size."""
    vocabulary: dict[bytes, int] = {}
    wanted = [
        np.array([vocabulary.setdefault(t, len(vocabulary)) for words in terms_of(text or "") for t in words], dtype=np.int64)
        for _, text in items
    ]
    rows = vectors(docs, vocabulary)
    total = rows.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 1
    # One number per term of the block, whose size is bounded.
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for term, k in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("k")).collect():
        df[term] = k
    order = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), dtype=np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([weight(n_docs, int(df[t])) for t in order], dtype=np.int64)
    task = _searcher([rank[t] for t in wanted], weights, rank, n_docs, n_terms, best)
    held = rows.where(F.size("terms") > 0).mapInArrow(task, "item_no int, doc_id bigint, score bigint")
    by = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return held.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of every item."""
    spark = docs.sparkSession
    rows = items.select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length(whole_text()) + 16).alias("s")).first()["s"] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    if blocks > 1:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        rows = materialize(rows.repartition("block"), "search-items")
    out = None
    for k in range(blocks):
        some = (rows if blocks == 1 else rows.where(F.col("block") == k)).select("item_id", "text").collect()
        found = search_block(docs, [tuple(r) for r in some], best)
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(some)], f"item_no int, item_id {items.schema['item_id'].dataType.simpleString()}"
        )
        # The names are one block.
        made = found.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score")
        made = materialize(made, "search-found") if blocks > 1 else made
        out = made if out is None else out.unionByName(made)
    return out


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = f"""WITH items AS MATERIALIZED (
  SELECT row, item_id, t, count(*) AS times FROM (
    SELECT row, item_id, unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS t
    FROM (SELECT row_number() OVER () AS row, * FROM benchmark)) GROUP BY ALL),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS words FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
held AS MATERIALIZED (
  SELECT row, doc_id, n, t, count(*) AS tf
  FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS t FROM d) SEMI JOIN items USING (t) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY t, n_docs),
parts AS (
  SELECT row, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS part
  FROM held JOIN weights USING (t), totals),
scores AS (
  SELECT i.row, i.item_id, p.row AS doc, p.doc_id, CAST(sum(i.times * p.part) AS BIGINT) AS score
  FROM items i JOIN parts p USING (t) GROUP BY ALL HAVING sum(i.times * p.part) > 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST, doc) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}"""


@query("op13_lexical_search", _SQL)
def op13_lexical_search(spark, sf):
    """The ten best documents of every benchmark item, over all whole documents."""
    return search(documents(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark"))
