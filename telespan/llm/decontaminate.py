"""Benchmark decontamination with an Aho-Corasick automaton.

Windows of 13 consecutive item words (a shorter item is one window) go into one
automaton over normalised text; every document is scanned once, and hits are
mapped to offsets in the original text. The benchmark is a stated query set:
it is cut into blocks of at most ``BLOCK_BYTES`` of text, so what goes to the
executors at once is bounded, and each block's automaton scans all documents.

Defined results: a null text has no words; an item without words gives no
window; an item without item_id marks words as hit but is not listed; equal
items are both listed; an empty benchmark or document table gives no hits or no
rows; further columns of the documents are kept by :func:`scan`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from telespan.llm.base import documents, query, table, whole_text

WINDOW = 13
BLOCK_BYTES = 8_000_000
SHARE = 20  # contaminated: at least one word in so many is hit

# A-Z to lower case; all other ASCII but digits and a-z to a space; bytes over 127 stay.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

SCAN = StructType(
    [
        StructField("n_words", LongType()),
        StructField("hit_words", ArrayType(LongType())),
        StructField("spans", ArrayType(ArrayType(LongType()))),
        StructField("items", ArrayType(StringType())),
    ]
)


def normal(text: str) -> bytes:
    """Words between single spaces, with one space at either end."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_NORMAL).split()) + b" "


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    words = normal(text).split()
    if not words:
        return []
    count = max(1, len(words) - size + 1)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(count)]


class Automaton:
    """Patterns of one block of items. Bytes are read as Latin-1 characters, one for one."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import ahocorasick

        owners: dict[bytes, list[str]] = {}
        for item, text in items:
            for pattern in set(windows(text)):
                owners.setdefault(pattern, []).extend([] if item is None else [item])
        self.tree = ahocorasick.Automaton()
        for pattern, names in owners.items():
            self.tree.add_word(pattern.decode("latin-1"), (len(pattern), tuple(dict.fromkeys(names))))
        self.empty = not owners
        if not self.empty:
            self.tree.make_automaton()

    def scan(self, text: str) -> tuple[int, list[int], list[list[int]], list[str]]:
        """Number of words, hit words, their spans in the text (code points, end exclusive), and items."""
        plain = normal(text)
        n_words = plain.count(b" ") - 1 if len(plain) > 2 else 0
        found = [] if self.empty or not n_words else list(self.tree.iter(plain.decode("latin-1")))
        if not found:
            return n_words, [], [], []
        spaces = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
        last = np.array([at for at, _ in found])
        size = np.array([size for _, (size, _) in found])
        # Word k stands between spaces k and k + 1; a pattern begins and ends with a space.
        edges = np.zeros(n_words + 1, dtype=np.int64)
        np.add.at(edges, np.searchsorted(spaces, last - size + 1), 1)
        np.add.at(edges, np.searchsorted(spaces, last), -1)
        hit = np.flatnonzero(np.cumsum(edges)[:n_words] > 0)
        items = sorted({name for _, (_, names) in found for name in names})
        return n_words, hit.tolist(), self._offsets(text, hit), items

    @staticmethod
    def _offsets(text: str, hit: np.ndarray) -> list[list[int]]:
        """Runs of hit words as spans of the original text."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        inside = np.r_[False, np.frombuffer(_NORMAL, dtype=np.uint8)[raw] != 32, False]
        turn = np.diff(inside.astype(np.int8))
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        point = np.cumsum(np.r_[0, (raw & 0xC0) != 0x80])  # code points before each byte
        breaks = np.flatnonzero(np.diff(hit) != 1)
        first, final = hit[np.r_[0, breaks + 1]], hit[np.r_[breaks, len(hit) - 1]]
        return np.stack([point[starts[first]], point[ends[final]]], axis=1).tolist()


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> list[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size, one at a time from the cluster."""
    out: list[list[tuple[str | None, str]]] = [[]]
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), whole_text().alias("text"))
    for item, text in rows.toLocalIterator():
        if held + len(text) > most and out[-1]:
            out.append([])
            held = 0
        out[-1].append((item, text))
        held += len(text)
    return out


def _scanner(items: list[tuple[str | None, str]]):
    @F.pandas_udf(SCAN)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = Automaton(items)
        for texts in batches:
            yield pd.DataFrame([tree.scan(t) for t in texts], columns=SCAN.names)

    return scanned


def scan(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hit_words (word numbers), spans (offsets in the text) and items to the documents."""
    columns = docs.columns
    found = []
    for k, items in enumerate(blocks(benchmark, most)):
        docs = docs.withColumn(f"scan_{k}", _scanner(items)(whole_text()))
        found.append(f"scan_{k}")
    if len(found) == 1:
        return docs.select(*columns, "scan_0.*")
    # Word numbers and spans of several blocks are merged; spans may then overlap.
    merged = lambda name: F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{k}.{name}" for k in found]))))
    return docs.select(
        *columns, F.col("scan_0.n_words"), *[merged(n).alias(n) for n in ("hit_words", "spans", "items")]
    )


CONTAMINATED = f"n_hit > 0 AND {SHARE} * n_hit >= n_words"


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The scan with n_hit and contaminated."""
    out = scan(docs, benchmark).withColumn("n_hit", F.size("hit_words").cast("bigint"))
    return out.withColumn("contaminated", F.expr(CONTAMINATED))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns, whatever their names."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return judged(whole, benchmark).where("NOT contaminated").select("document.*")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL = f"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS size, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS x
  FROM (SELECT *, unnest(range(1, greatest(2, len(words) - {WINDOW - 2}))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
found AS MATERIALIZED (
  SELECT id, i, p.size, item FROM (SELECT id, size, i, array_to_string(words[i:i + size - 1], ' ') AS x FROM places) p
  JOIN windows w ON p.size = w.size AND p.x = w.x),
hits AS (SELECT id, count(DISTINCT w) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS w FROM found) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS x
          FROM (SELECT DISTINCT id, item FROM found WHERE item IS NOT NULL) GROUP BY id),
r AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, x
      FROM d LEFT JOIN hits USING (id) LEFT JOIN items USING (id))
SELECT doc_id, n_words, n_hit, n_items, sha256(coalesce(x, '')) AS items_sha256, {CONTAMINATED} AS contaminated FROM r"""


@query("op6_decontaminate", _SQL)
def op6_decontaminate(spark, sf):
    """Words hit and items found in every whole document."""
    return judged(documents(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
