"""Near copies by Order MinHash and banded alignment.

A text is the sequence of its word k-mers (five words), each labelled with its
occurrence number. One function of the sketch takes the few labelled k-mers of
smallest hash and keeps them in text order, so two texts agree on it if they
share these k-mers in the same order, which an edit rarely breaks and a
reordering does. Texts that agree on a function are candidates; a banded
alignment of the labelled k-mers decides: aligned ones over all different ones
must be at least 0.8. A class is what such links connect.

Equal texts are one node from the start, however many there are. In a bucket
(one function's value) of at most ``SMALL`` nodes all pairs are candidates. In a
larger one all nodes are compared with its pivot, the node found in the most
and largest buckets, which is the original where there is one. Then the nodes
left outside the pivot's class are compared with all nodes of the bucket in
other classes, but for pairs that cannot be similar: what either shares with
the pivot bounds what they share with each other (Jaccard distance is a
metric), and where the parities of their k-mers by part of a hash differ, one
has a k-mer that the other has not. So no pair of different classes that may
be similar goes untested, no group is collected, and no k-mer is a row.

Defined results: a null text is empty, and all empty texts are equal; case and
white space do not count; a text of under five words is one k-mer; a row
without doc_id takes part like any other, and a class without any doc_id has a
null id; an empty table gives no rows; further columns are kept by
:func:`representatives`, and the columns it adds and drops begin with ``dup_``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from telespan.llm.base import documents, query, slices, whole_text
from telespan.scratch import materialize

K = 5
FUNCTIONS = 24
TAKEN = 3  # labelled k-mers per function
SIMILAR = 0.8
SMALL = 24
BITS = 2  # parities kept for each k-mer of a text
KEPT_TEXTS = 200  # prepared texts a task keeps

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * _STEP


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def kmers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all labelled k-mers, text by text and in order, and how many each text has."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    m = np.where(n == 0, 0, np.maximum(1, n - K + 1))
    of = np.repeat(np.arange(len(texts)), m)
    first = np.r_[0, np.cumsum(n)][:-1]
    at = first[of] + np.arange(len(of)) - np.r_[0, np.cumsum(m)][:-1][of]
    last = first[of] + n[of]
    digest = np.full(len(of), _STEP)
    padded = np.r_[flat, np.zeros(K, dtype=np.uint64)]
    for k in range(K):
        word = np.where(at + k < last, padded[np.minimum(at + k, len(padded) - 1)] + np.uint64(1), np.uint64(0))
        digest = _mixed(digest * _M2 + word)
    # Occurrence number of each k-mer within its text.
    order = np.lexsort((digest, of))
    d, o = digest[order], of[order]
    same = np.r_[False, (d[1:] == d[:-1]) & (o[1:] == o[:-1])] if len(d) else np.zeros(0, dtype=bool)
    run_start = np.maximum.accumulate(np.where(same, 0, np.arange(len(d)))) if len(d) else np.zeros(0, dtype=np.int64)
    occurrence = np.empty(len(d), dtype=np.uint64)
    occurrence[order] = (np.arange(len(d)) - run_start).astype(np.uint64)
    return np.where(occurrence > 0, _mixed(digest + occurrence * _STEP), digest), m


def sketches(texts: list[str]) -> list[np.ndarray]:
    """FUNCTIONS values per text; none for a text without words."""
    labelled, m = kmers(texts)
    of = np.repeat(np.arange(len(texts)), m)
    out = np.zeros((len(texts), FUNCTIONS), dtype=np.uint64)
    # Of a long text only hashes under a bound can be among the smallest; about 16 pass.
    bound = np.where(m > 16, 16 / np.maximum(m, 1) * 2.0**64, 2.0**64).astype(np.float64)
    limit = np.minimum(bound, 2.0**64 - 2048).astype(np.uint64)[of]
    for j in range(FUNCTIONS):
        x = _mixed(labelled + SEEDS[j])
        pick = np.flatnonzero((x <= limit) | (m[of] <= 16))
        short = np.bincount(of[pick], minlength=len(texts)) < np.minimum(TAKEN, m)
        if short.any():
            pick = np.union1d(pick, np.flatnonzero(short[of]))
        order = pick[np.lexsort((x[pick], of[pick]))]
        text = of[order]
        place = np.arange(len(order)) - np.searchsorted(text, text)
        chosen = np.sort(order[place < TAKEN])
        text = of[chosen]
        place = np.arange(len(chosen)) - np.searchsorted(text, text)
        key = np.full(len(texts), SEEDS[j])
        for r in range(TAKEN):
            here = chosen[place == r]
            key[of[here]] = _mixed(key[of[here]] * _M1 + labelled[here])
        out[:, j] = key
    return [out[i].view(np.int64) if m[i] else np.zeros(0, dtype=np.int64) for i in range(len(texts))]


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned labelled k-mers over all different ones; 0 where it cannot reach ``least``.

    Labels make the k-mers of a text differ, so the best alignment is a longest
    rising run of places. Any alignment that is good enough stays in a band
    around the diagonal as wide as the unaligned k-mers allow.
    """
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if not total or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    order = np.argsort(b, kind="stable")
    found = np.searchsorted(b, a, sorter=order)
    place = order[np.minimum(found, len(b) - 1)]
    at = np.flatnonzero(b[place] == a)
    band = total - 2 * need + 1
    at = at[np.abs(place[at] - at) <= band]
    if len(at) < need - 1e-9:
        return 0.0
    ends: list[int] = []
    for p in place[at].tolist():
        k = bisect_left(ends, p)
        if k == len(ends):
            ends.append(p)
        else:
            ends[k] = p
    found_similarity = len(ends) / (total - len(ends))
    return found_similarity if found_similarity >= least - 1e-12 else 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Shared labelled k-mers over all different ones, in any order."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def parities(labelled: np.ndarray) -> np.ndarray:
    """A bit per part of a hash: whether the part holds an odd number of these labelled k-mers.

    At least BITS parts a k-mer, a power of two. Where the bits of two texts
    differ, one of them has a k-mer that the other has not.
    """
    width = max(64, 1 << max(0, BITS * len(labelled) - 1).bit_length())
    odd = np.bincount((labelled % np.uint64(width)).astype(np.int64), minlength=width) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def apart(x: Column, y: Column) -> Column:
    """How many of these parities differ: at most the labelled k-mers that only one of the texts has.

    The wider is folded once, which is all that texts of similar sizes need.
    """
    n = F.least(F.size(x), F.size(y))
    narrow = lambda b: F.when(
        F.size(b) > n, F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, n + 1, n), lambda low, high: low.bitwiseXOR(high))
    ).otherwise(b)
    differ = F.zip_with(narrow(x), narrow(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differ, F.lit(0), lambda n, v: n + v)


def plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def node_of(text: Column) -> Column:
    """Equal texts, equal node."""
    return F.unhex(F.md5(plain(text).cast("binary")))


def _sketcher():
    @F.pandas_udf("struct<size:bigint,keys:array<bigint>>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            keys, sizes = [], []
            for part in slices(texts):
                keys += sketches(texts[part])
                sizes += [max(0, len(t.split()) - K + 1) or min(1, len(t.split())) for t in texts[part]]
            yield pd.DataFrame({"size": sizes, "keys": keys})

    return sketched


def nodes_of(docs: DataFrame) -> DataFrame:
    """One row per different text: node, size in k-mers, keys, first doc_id, number of rows."""
    text = whole_text()
    rows = docs.select("doc_id", node_of(text).alias("node"), _sketcher()(plain(text)).alias("s"))
    grouped = rows.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.any_value("s").alias("s")
    )
    return materialize(grouped.select("node", "first_id", "n_rows", "s.size", "s.keys"), "dup-nodes")


def buckets_of(nodes: DataFrame) -> DataFrame:
    """key, node, size and the number of nodes, of all buckets with more than one."""
    rows = nodes.select(F.explode("keys").alias("key"), "node", "size")
    shared = rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    return materialize(rows.join(shared, "key"), "dup-buckets")


def _fits(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-9


def _pairs(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def small_pairs(buckets: DataFrame) -> DataFrame:
    rows = buckets.where(F.col("held") <= SMALL)
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _fits(F.col("x.size"), F.col("y.size")))
    return both.select(*_pairs(F.col("x.node"), F.col("y.node"))).distinct()


def pivot_pairs(rows: DataFrame, pivots: DataFrame, once: bool = False) -> DataFrame:
    """Pairs of each pivot with the nodes of its bucket that are in other classes and may be similar to it.

    ``once``: both sides have ``keys`` and ``bits``, and a pair comes only from the first bucket that it shares.
    """
    x, y = rows.alias("x"), pivots.alias("y")
    may = (F.col("x.label") != F.col("y.label")) & _fits(F.col("x.size"), F.col("y.size"))
    beyond = F.greatest(F.col("x.near") - F.col("y.far"), F.col("y.near") - F.col("x.far"))
    may = may & (beyond <= 1 - SIMILAR + 1e-9)
    if once:
        may = may & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
        # Of all k-mers of both, similar texts have at most so many that only one of them has.
        most = (1 - SIMILAR) / (1 + SIMILAR) * (F.col("x.size") + F.col("y.size"))
        may = may & (apart(F.col("x.bits"), F.col("y.bits")) <= most + 1e-9)
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & may)
    return both.select(*_pairs(F.col("x.node"), F.col("y.node"))).distinct()


def _verifier():
    @F.pandas_udf("struct<linked:boolean,overlap:double>")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def prepared(node, text):
            found = kept.get(node)
            if found is None:
                found = kept[node] = kmers([text])[0]
                if len(kept) > KEPT_TEXTS:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(node)
            return found

        for a, b, text_a, text_b in batches:
            rows = []
            for i, j, s, t in zip(a, b, text_a, text_b):
                x, y = prepared(bytes(i), s), prepared(bytes(j), t)
                rows.append((similarity(x, y) > 0, overlap(x, y)))
            yield pd.DataFrame(rows, columns=["linked", "overlap"])

    return compared


def texts_of(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """node and text of the nodes that have candidates; copies of a text move as one row per task."""
    wanted = buckets.select("node").distinct()
    text = docs.select(node_of(whole_text()).alias("node"), plain(whole_text()).alias("text"))
    return materialize(text.join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")), "dup-texts")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with linked (their texts align well enough) and overlap."""
    pairs = materialize(pairs, "dup-pairs")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.select("a", "b", _verifier()("a", "b", "text_a", "text_b").alias("c")).select("a", "b", "c.*")


def bits_of(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """node and its parities, one row for each node of these rows."""

    @F.pandas_udf("array<bigint>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([parities(kmers([t])[0]) for t in texts])

    return texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", marked("text").alias("bits"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links connect to it. Rows only for nodes with links.

    Each step takes the smallest label around a node and then that label's own
    label, so long chains shorten fast; it ends when a step changes nothing.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, "dup-edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = materialize(labels, "dup-labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        step = nearer.join(jump, "next").select("node", F.col("label").alias("was"), F.least("next", "beyond").alias("label"))
        step = materialize(step, "dup-labels")
        changed = step.where("was != label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _distances(rows: DataFrame, pivots: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds near and far: bounds of each node's Jaccard distance from its bucket's pivot.

    They are equal where the two were compared; where sizes alone ruled that
    out, the sizes give the nearer bound.
    """
    of = pivots.select("key", F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    ends = rows.join(of, "key").withColumns(dict(zip("ab", [F.least("node", "pivot"), F.greatest("node", "pivot")])))
    known = ends.join(seen.select("a", "b", "overlap"), ["a", "b"], "left")
    itself = F.col("node") == F.col("pivot")
    by_size = 1 - F.least("size", "pivot_size") / F.greatest("size", "pivot_size", F.lit(1))
    exact = F.when(itself, 0.0).otherwise(1 - F.col("overlap"))
    return known.withColumns({"near": F.coalesce(exact, by_size), "far": F.coalesce(exact, F.lit(1.0))}).select(
        *rows.columns, "near", "far"
    )


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the label of each node that has links."""
    nodes = nodes_of(docs)
    buckets = buckets_of(nodes)
    large = buckets.where(F.col("held") > SMALL)
    texts = texts_of(docs, buckets)
    weight = large.groupBy("node").agg(F.sum("held").alias("weight"))
    large = materialize(large.join(weight, "node"), "dup-large")
    best = F.max(F.struct("weight", "node", "size")).alias("p")
    pivots = materialize(large.groupBy("key").agg(best).select("key", "p.node", "p.size"), "dup-pivots")
    free = {"label": F.col("node"), "near": F.lit(0.0), "far": F.lit(1.0)}  # nothing known yet
    as_own = lambda rows: rows.withColumns(free)
    pairs = small_pairs(buckets).union(pivot_pairs(as_own(large), as_own(pivots))).distinct()
    seen = materialize(compared(pairs, texts), "dup-compared")
    links = seen.where("linked").select("a", "b")
    labels = components(links)
    rows = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = materialize(rows, "dup-open")
    first = F.max_by("label", F.struct("weight", "node")).alias("main")
    split = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), first).where("low != high")
    rows = _distances(rows.join(split.select("key", "main"), "key"), pivots, seen)
    known = materialize(bits_of(rows, texts).join(nodes.select("node", "keys"), "node"), "dup-bits")
    rows = rows.join(known, "node")
    # Nodes outside the pivot's class.
    rest = rows.where(F.col("label") != F.col("main")).select("key", "node", "size", "label", "keys", "bits", "near", "far")
    rest = materialize(rest, "dup-rest")
    if rest.limit(1).count():
        more = compared(pivot_pairs(rows, rest, once=True), texts).where("linked").select("a", "b")
        labels = components(materialize(links.union(more), "dup-links"))
    return nodes, labels


def labelled(docs: DataFrame) -> DataFrame:
    """node, class_id (the smallest doc_id of the class), class_node and keeper (the node that stays)."""
    nodes, labels = classes(docs)
    rows = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A class without links is its node; only linked ones have to meet.
    best = rows.groupBy("label").agg(
        F.min("first_id").alias("class_id"),
        F.min(F.struct(F.col("first_id").isNull().alias("unknown"), "first_id", "node")).alias("k"),
        F.sum("n_rows").alias("class_rows"),
    )
    return rows.join(best, "label").select("node", "first_id", "class_id", F.col("k.node").alias("keeper"), "class_rows")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id; all columns."""
    keep = labelled(docs).where(F.col("node") == F.col("keeper")).select(F.col("node").alias("dup_node"), F.col("first_id").alias("dup_id"))
    rows = docs.withColumn("dup_node", node_of(whole_text())).join(keep, "dup_node")
    rows = rows.where(F.col("doc_id").eqNullSafe(F.col("dup_id")))
    # The id may stand more than once with this text.
    return rows.dropDuplicates(["dup_node"]).select(*docs.columns)


@query("op3_near_dedup")
def op3_near_dedup(spark, sf):
    """Each document's class, whether it stays, and the rows of its class."""
    docs = documents(spark, sf).select("doc_id", "text")
    found = labelled(docs)
    rows = docs.select("doc_id", node_of(whole_text()).alias("node")).join(found, "node")
    kept = (F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return rows.select("doc_id", "class_id", kept.alias("kept"), "class_rows")
