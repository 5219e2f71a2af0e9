"""Token counts of a piece vocabulary by rank-synchronous merging of ragged arrays.

A text is cut before each space mark, where no piece of the vocabulary reaches
across. The different pre-tokens of a batch lie in one flat array of symbol ids
with an array of sequence numbers beside it. In each step every sequence merges
its own lowest-ranked pair, all sequences at once; sequences without a pair
leave the arrays. What survives is counted: one token per symbol, and one per
UTF-8 byte of a character that the vocabulary does not have.

Counting is per row, in batches of texts; nothing is shuffled. Counts of
pre-tokens are kept between the batches of a task, up to ``CACHE`` of them.

Defined results: a null text is empty; an empty text has no tokens; special
strings in a text are ordinary characters; equal rows get equal results; an
empty table gives no rows; further columns are ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from telespan.llm.base import documents, query, slices, whole_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = 400_000
SPACE = "▁"  # the mark of a space in pieces
_LAST_RANK = np.int64(2**62)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceVocabulary:
    """Symbols, and for each mergeable pair its rank and result, from a vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (table.is_control, table.is_unknown, table.is_byte, table.is_unused)
        pieces = {
            table.id_to_piece(i): table.get_score(i)
            for i in range(table.get_piece_size())
            if not any(kind(i) for kind in special)
        }
        # Runs of spaces share one score, below all others; they are counted apart.
        self.spaces = {len(p) for p in pieces if set(p) == {SPACE}}
        pieces = {p: s for p, s in pieces.items() if set(p) != {SPACE}} | {SPACE: 0.0}
        ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(ids)
        self.wide = self.unknown + 1
        self.char_ids = np.full(0x110000, self.unknown, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        keys, ranks, results = [], [], []
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.wide + b)
                    ranks.append(-score)
                    results.append(ids[piece])
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks)[order].astype(np.int64)
        self.results = np.array(results, dtype=np.int64)[order]
        self.space_id = ids[SPACE]
        self._runs: dict[int, int] = {0: 0}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of each pair; the last rank where there is none."""
        key = left * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _LAST_RANK), at

    def run_of_spaces(self, n: int) -> int:
        """Tokens of n spaces in a row: equal ranks, so the leftmost pair merges first."""
        if n not in self._runs:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and stack[-1] + stack[-2] in self.spaces:
                    stack[-2:] = [stack[-1] + stack[-2]]
            if len(self._runs) > 10_000:
                self._runs.clear()
            self._runs[n] = len(stack)
        return self._runs[n]

    def _merge_once(self, sym, seq, rank, place, once):
        """All sequences merge their lowest pair where it occurs; those in ``once`` only its first occurrence."""
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        of = np.cumsum(np.r_[False, seq[1:] != seq[:-1]])
        hit = (rank == lowest[of]) & (rank < _LAST_RANK)
        at = np.flatnonzero(hit)
        # Of occurrences that overlap (a a a), take every other one from the left.
        run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1 if len(at) else at
        first = np.flatnonzero(np.r_[True, np.diff(run) > 0]) if len(at) else at
        at = at[(np.arange(len(at)) - first[run]) % 2 == 0] if len(at) else at
        if once is not None and len(at):
            again = np.r_[False, seq[at[1:]] == seq[at[:-1]]]
            at = at[~(again & once[seq[at]])]
        return at, lowest, starts, of

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token. Space marks at its start are counted with their run."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym, seq = self.char_ids[codes], np.repeat(np.arange(len(words)), lengths)
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        extra = np.where(sym == self.unknown, width - 1, 0)
        out = np.bincount(seq, weights=extra, minlength=len(words)).astype(np.int64)
        done_sym, done_seq = [], []
        rank, place = self._ranks(sym, seq)
        while len(sym):
            at, lowest, starts, of = self._merge_once(sym, seq, rank, place, None)
            live = lowest < _LAST_RANK
            if not live.all():
                keep = live[of]
                done_sym.append(sym[~keep])
                done_seq.append(seq[~keep])
                sym, seq, rank, place = sym[keep], seq[keep], rank[keep], place[keep]
                continue
            step = self._apply(sym, seq, rank, place, at)
            # Merging several occurrences at once is the same as one by one unless a merge
            # makes a pair of still lower rank; such a sequence takes one merge in this step.
            several = np.bincount(seq[at], minlength=len(words)) > 1
            if several.any():
                new_low = np.full(len(words), _LAST_RANK)
                np.minimum.at(new_low, step[1], step[2])
                was = np.full(len(words), _LAST_RANK)
                was[seq[starts]] = lowest
                beside = at[:-1][(at[1:] == at[:-1] + 2) & (seq[at[1:]] == seq[at[:-1]])]
                between, _ = self.pairs(self.results[place[beside]], sym[beside + 2])
                np.minimum.at(new_low, seq[beside], between)
                once = several & (new_low < was)
                if once.any():
                    at, *_ = self._merge_once(sym, seq, rank, place, once)
                    step = self._apply(sym, seq, rank, place, at)
            sym, seq, rank, place = step
        sym, seq = np.concatenate([*done_sym, sym]), np.concatenate([*done_seq, seq])
        order = np.argsort(seq, kind="stable")
        sym, seq = sym[order], seq[order]
        out += np.bincount(seq, minlength=len(words))
        return self._spaces(sym, seq, out)

    def _ranks(self, sym, seq):
        rank = np.full(len(sym), _LAST_RANK)
        place = np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            inside = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inside], place[inside] = self.pairs(sym[inside], sym[inside + 1])
        return rank, place

    def _apply(self, sym, seq, rank, place, at):
        """Replace the pairs that start at ``at``; only ranks beside a merge are looked up again."""
        sym = sym.copy()
        sym[at] = self.results[place[at]]
        gone = np.zeros(len(sym), dtype=bool)
        gone[at + 1] = True
        stale = np.zeros(len(sym), dtype=bool)
        stale[at] = True
        keep = ~gone
        sym, seq, rank, place, stale = sym[keep], seq[keep], rank[keep], place[keep], stale[keep]
        stale[:-1] |= stale[1:]
        look = np.flatnonzero(stale)
        rank[look], place[look] = _LAST_RANK, 0
        look = look[look < len(sym) - 1]
        look = look[seq[look] == seq[look + 1]]
        rank[look], place[look] = self.pairs(sym[look], sym[look + 1])
        return sym, seq, rank, place

    def _spaces(self, sym, seq, out):
        """Count the space marks left at the start of a pre-token as runs."""
        at = np.flatnonzero(sym == self.space_id)
        if len(at):
            which, n = np.unique(seq[at], return_counts=True)
            several = n > 1
            for w, k in zip(which[several], n[several]):
                out[w] += self.run_of_spaces(int(k)) - k
        return out


PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Counter:
    """Counts texts in batches and keeps the counts of pre-tokens seen."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        cut = [self._cut(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = list(set().union(*cut) - self.known.keys())
        for begin in range(0, len(new), 50_000):
            part = new[begin : begin + 50_000]
            self.known.update(zip(part, self.vocabulary.count(part).tolist()))
        get = self.known.__getitem__
        return np.array([sum(map(get, c)) for c in cut], dtype=np.int64)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE + text).replace(" ", SPACE)
        parts = text.split(SPACE)
        if all(parts[1:]):
            return [SPACE + p for p in parts[1:]]
        return PRE_TOKEN.findall(text)


def count_tokens(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_tokens to rows that have a column text."""
    path = path or model_path()

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(PieceVocabulary(path))
        for texts in batches:
            texts = texts.tolist()
            counts = [counter.count(texts[part]) for part in slices(texts)]
            yield pd.Series(np.concatenate([*counts, np.zeros(0, dtype=np.int64)]))

    return rows.withColumn("n_tokens", tokens(whole_text()))


@query("op9_token_counts")
def op9_token_counts(spark, sf):
    """Bytes and tokens of every whole text, and whether it exceeds the limit."""
    rows = documents(spark, sf).select("doc_id", "text")
    return count_tokens(rows).select(
        "doc_id",
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
