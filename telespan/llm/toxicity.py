"""Toxic spans by a linear-chain conditional random field.

Labels are per document, so training tokens are labelled first: a word, or the
beginning of one, that stands in toxic documents and hardly in others marks its
tokens; what is neither clearly so nor clearly not stays unlabelled and gives no
gradient. A two-state chain over word and prefix features is fitted to these
tokens. Forward-backward marginals of every token of a whole text give the
offending offsets; the strongest of them and their sum, weighed on sample rows
that the chain was not fitted to, give the document's score.

The fit takes a sample of at most ``SAMPLE`` labelled rows of each class, none
longer than ``SAMPLE_CHARS``; scoring covers every document. Rows whose
crc32(doc_id) is divisible by ``FOLDS`` are never learned from.

Defined results: a null or empty text scores 0; labels that are null are no
labels; of several labels of a document the largest counts; without labels of
both classes every score is 0; equal texts get equal scores; an empty table
gives no rows; further columns of the documents are kept by :func:`score`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from telespan.llm.base import documents, query, slices, table, whole_text

FOLDS = 5
SAMPLE = 1500
SAMPLE_CHARS = 20_000
LEAST_DOCS = 2  # toxic documents of the sample a feature must stand in
MOST_FEATURES = 20_000
MARKED, UNMARKED = 3.0, 1.5  # association of a token's features, in standard deviations
LEAST_RATIO = 2.0  # log odds ratio below which an association counts for nothing, however sure it is
EPOCHS, RATE, PENALTY = 40, 0.3, 1e-4
STRONGEST = 3
WEIGHED = 4  # every so manieth sample row weighs the marginals instead of fitting the chain
RIDGE = 0.2
HEADS = np.array([-4.0, 2.5, 0.5, 0.5, 0.5, 0.2])  # constant, strongest marginals, two forms of their sum
REPORTED = 0.5  # tokens of at least this marginal are offending
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)

TAGGER_SCHEMA = "names array<string>, weights array<double>, bias double, move array<double>, heads array<double>"
SCORE_SCHEMA = "score double, spans array<array<bigint>>"


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


# ---- the chain ----


def _sum_exp(a, b):
    return np.logaddexp(a, b)


class Chain:
    """Messages of a two-state chain as log odds, for many sequences at once.

    ``move`` holds log weights of steps from state i to j. Sequences are worked on
    together, position by position, the longest first, so that those still going
    are always the first ones.
    """

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.r_[0, np.cumsum(lengths)][:-1]
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths, self.starts = lengths[self.order], starts[self.order]
        self.most = int(self.lengths[0]) if len(lengths) else 0
        # How many sequences are longer than each position.
        self.going = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.most), side="right")
        self.first = np.zeros(int(lengths.sum()), dtype=bool)
        self.first[starts[lengths > 0]] = True

    def messages(self, odds: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead, back = odds.copy(), np.zeros_like(odds)
        for t in range(1, self.most):
            at = self.starts[: self.going[t]] + t
            m = ahead[at - 1]
            ahead[at] += _sum_exp(move[0, 1], move[1, 1] + m) - _sum_exp(move[0, 0], move[1, 0] + m)
        for t in range(self.most - 1, 0, -1):
            at = self.starts[: self.going[t]] + t
            x = odds[at] + back[at]
            back[at - 1] = _sum_exp(move[1, 0], move[1, 1] + x) - _sum_exp(move[0, 0], move[0, 1] + x)
        return ahead, back

    def marginals(self, odds, move):
        ahead, back = self.messages(odds, move)
        return _sigmoid(ahead + back)

    def steps(self, odds, move, ahead, back):
        """Marginals of the four kinds of step into each position that is not a first one."""
        at = np.flatnonzero(~self.first)
        into = odds[at] + back[at]
        weights = np.stack(
            [np.full(len(at), move[0, 0]), move[0, 1] + into, ahead[at - 1] + move[1, 0], ahead[at - 1] + move[1, 1] + into]
        )
        weights = np.exp(weights - weights.max(axis=0))
        return at, weights / weights.sum(axis=0)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


# ---- fitting on the sample ----


def _distinct(texts: list[str], labels: list[int]) -> list[int]:
    """Places of texts without those that share a smallest shingle digest with an earlier one: copies would count twice."""
    import xxhash

    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        shingles = [" ".join(words[j : j + 5]).encode("utf-8", "replace") for j in range(max(1, len(words) - 4))]
        lows = {(k, min(xxhash.xxh64_intdigest(s, seed=k) for s in shingles)) for k in range(3)}
        if not lows & seen:
            out.append(i)
        seen |= lows
    return out


def _associations(docs: Iterable[set[str]], labels: np.ndarray) -> dict[str, float]:
    """Log odds ratio of each feature over its standard deviation."""
    toxic, other = Counter(), Counter()
    for found, label in zip(docs, labels):
        (toxic if label else other).update(found)
    n, m = int(labels.sum()), int((1 - labels).sum())
    out = {}
    for name, t in toxic.items():
        if t >= LEAST_DOCS:
            c = other.get(name, 0)
            ratio = math.log((t + 0.5) / (n - t + 0.5)) - math.log((c + 0.5) / (m - c + 0.5))
            sure = ratio / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
            out[name] = sure if ratio >= LEAST_RATIO else min(sure, 0.0)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MOST_FEATURES])


class Tagger:
    """Fitted weights. Small: at most MOST_FEATURES names."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, heads: np.ndarray):
        self.weights, self.bias, self.move, self.heads = weights, bias, move, heads
        self.known: dict[str, float] = {}

    def odds(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known = {}
            get = self.weights.get
            found = self.known[word] = self.bias + sum(get(f, 0.0) for f in features(word))
        return found

    def token_marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Of each word of each text, the probability that it is toxic there."""
        words = [WORD.findall(_lower(t)) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        odds = np.fromiter((self.odds(x) for w in words for x in w), dtype=float, count=int(lengths.sum()))
        marginal = Chain(lengths).marginals(odds, self.move)
        return np.split(marginal, np.cumsum(lengths)[:-1]) if len(texts) else []

    def tag(self, texts: list[str]) -> list[tuple[float, list[list[int]]]]:
        """Score and offending spans (code points, end exclusive) of each text."""
        out = []
        for text, p in zip(texts, self.token_marginals(texts)):
            hit = np.flatnonzero(p >= REPORTED)
            spans = [m.span() for m in WORD.finditer(_lower(text))] if len(hit) else []
            score = float(_sigmoid(_summary(p) @ self.heads)) if len(p) else 0.0
            out.append((score, [list(spans[i]) for i in hit]))
        return out


def _summary(p: np.ndarray) -> np.ndarray:
    """What a document's score looks at: its strongest marginals as odds, their sum, its length."""
    top = np.zeros(STRONGEST)
    best = np.clip(np.sort(p)[::-1][:STRONGEST], 1e-3, 1 - 1e-4)
    top[: len(best)] = np.maximum(0.0, 1 + np.log(best / (1 - best)) / 4)
    strong = p[p >= 0.1].sum()
    return np.r_[1.0, top, np.log1p(strong), strong / (1 + np.log1p(len(p)))]


def _weigh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards HEADS; nothing found may speak for a document."""
    w = HEADS.copy()
    penalty = np.diag(np.r_[RIDGE / 10, np.full(x.shape[1] - 1, RIDGE)])
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ (w - HEADS))
        w = w + np.clip(step, -1, 1)
        w[1:] = np.maximum(w[1:], 0.0)
    return w


def _lower(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fit(texts: list[str], labels: list[int]) -> Tagger | None:
    """None unless both classes are there."""
    keep = _distinct(texts, labels)
    apart = [i for k, i in enumerate(keep) if k % WEIGHED == 0]
    keep = [i for k, i in enumerate(keep) if k % WEIGHED]
    y = np.array([labels[i] for i in keep], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    known: dict[str, str] = {}  # one string a word, however often it stands
    tokens = [[known.setdefault(w, w) for w in WORD.findall(_lower(texts[i]))] for i in keep]
    score = _associations(({f for w in set(t) for f in features(w)} for t in tokens), y)
    names = {name: i for i, name in enumerate(score)}
    words = sorted({w for t in tokens for w in t})
    place = {w: i for i, w in enumerate(words)}
    best = np.array([max((score.get(f, -9.0) for f in features(w)), default=-9.0) for w in words])
    flat = np.fromiter((place[w] for t in tokens for w in t), dtype=np.int64)
    lengths = np.array([len(t) for t in tokens])
    toxic = np.repeat(y, lengths) == 1
    state = (toxic & (best[flat] >= MARKED)).astype(np.int64)
    sure = (~toxic) | (best[flat] >= MARKED) | (best[flat] < UNMARKED)
    # Feature matrix of the words, as (word, feature) pairs.
    pairs = [(i, names[f]) for i, w in enumerate(words) for f in features(w) if f in names]
    rows, cols = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    weights, bias = np.zeros(len(names)), -3.0
    move = np.array([[0.0, -2.0], [0.0, 0.0]])
    chain = Chain(lengths)
    pair_sure = sure[1:] & sure[:-1]
    seen = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]  # of squared gradients
    for _ in range(EPOCHS):
        by_word = bias + np.bincount(rows, weights=weights[cols], minlength=len(words))
        odds = by_word[flat]
        ahead, back = chain.messages(odds, move)
        miss = np.where(sure, state - _sigmoid(ahead + back), 0.0)
        per_word = np.bincount(flat, weights=miss, minlength=len(words))
        g_weights = np.bincount(cols, weights=per_word[rows], minlength=len(names)) - PENALTY * len(y) * weights
        g_bias = miss.sum()
        at, steps = chain.steps(odds, move, ahead, back)
        use = pair_sure[at - 1]
        g_move = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                g_move[i, j] = (((state[at - 1] == i) & (state[at] == j))[use]).sum() - steps[2 * i + j][use].sum()
        for k, g in enumerate((g_weights, g_bias, g_move)):
            seen[k] = seen[k] + g * g
        weights = weights + RATE * g_weights / np.sqrt(seen[0] + 1e-9)
        bias = bias + RATE * g_bias / math.sqrt(seen[1] + 1e-9)
        move = move + RATE * g_move / np.sqrt(seen[2] + 1e-9)
    tagger = Tagger({n: float(weights[i]) for n, i in names.items() if abs(weights[i]) > 1e-6}, float(bias), move, HEADS)
    apart_y = np.array([labels[i] for i in apart])
    if len(set(apart_y.tolist())) == 2:
        found = np.array([_summary(p) for p in tagger.token_marginals([texts[i] for i in apart])])
        tagger.heads = _weigh(found, apart_y)
    tagger.known = {}
    return tagger


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE rows of each class, by a digest of their ids and in its order; none that is held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("turn", F.md5(F.col("doc_id").cast("string").cast("binary")))
    picked = [known.where(F.col("toxic") == c).orderBy("turn").limit(SAMPLE) for c in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most twice SAMPLE rows
    rows = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id")
    rows = rows.where(F.length("text") <= SAMPLE_CHARS).orderBy("turn", "text").limit(2 * SAMPLE)
    return rows.select("text", "toxic")


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    found = sample_rows(docs, labels).collect()
    return [r["text"] for r in found], [int(r["toxic"]) for r in found]


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tagger of all rows of a partition as one row; none without both classes."""
    texts, labels = [], []
    for rows in batches:
        texts += rows["text"].tolist()
        labels += [int(x) for x in rows["toxic"]]
    found = fit(texts, labels)
    if found is not None:
        names, weights = list(found.weights), list(found.weights.values())
        row = [names, weights, found.bias, found.move.ravel().tolist(), found.heads.tolist()]
        yield pd.DataFrame([row], columns=["names", "weights", "bias", "move", "heads"])


def learn(docs: DataFrame, labels: DataFrame) -> Tagger | None:
    """Fits in the one task that a limit leaves; only the weights come to the driver."""
    found = sample_rows(docs, labels).mapInPandas(_fitted, TAGGER_SCHEMA).collect()
    if not found:
        return None
    (r,) = found
    return Tagger(dict(zip(r["names"], r["weights"])), r["bias"], np.array(r["move"]).reshape(2, 2), np.array(r["heads"]))


# ---- scoring ----


def score(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Adds toxicity.score and toxicity.spans to the documents."""

    @F.pandas_udf(SCORE_SCHEMA)
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            rows = []
            for part in slices(texts):
                rows += [(0.0, [])] * len(texts[part]) if tagger is None else tagger.tag(texts[part])
            yield pd.DataFrame(rows, columns=["score", "spans"])

    return docs.withColumn("toxicity", tagged(whole_text()))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below one half, with their columns, whatever their names."""
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return score(whole, learn(docs, labels)).where("toxicity.score < 0.5").select("document.*")


@query("op7_toxicity")
def op7_toxicity(spark, sf):
    """Score and verdict of every document; rows of the held-out fold are marked."""
    docs = documents(spark, sf).select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf, "labels"))).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.spans").alias("spans"),
    )
