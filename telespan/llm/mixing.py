"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked, with no cell over
its tokens, until their marginals meet the targets and the budget; each document
is then kept with the probability its cell was given, decided by a hash of its id
and the seed, so a rerun keeps the same documents. A target that needs more than
all tokens of its value cannot be met: the value is kept whole, the others of its
margin take the rest, and the output has the target next to the achieved share.

Defined results: null source, language or topic is a value of its own (empty
string); a text without words weighs nothing and is kept at its cell's
probability; a cell whose target exceeds its tokens is kept whole, never
repeated; equal rows share their fate; an empty table gives no rows; further
columns are kept, and the operator's own columns begin with ``mix_``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from telespan.llm.base import DOCUMENT_COLUMNS, documents, query, whole_text
from telespan.scratch import materialize

MARGINS = ["mix_source", "mix_lang", "mix_topic"]
MOST_SWEEPS = 200
TOLERANCE = 1e-4
CELLS_ON_DRIVER = 200_000
TEMPER = 0.7
BUDGET = 0.75
SEED = 17

# The first topic one of whose marks the text contains.
TOPICS = {
    "web": ["http", "www."],
    "contact": ["@"],
    "legal": ["Licensed", "Copyright", "License"],
    "code": ["{", "};", "def "],
    "table": [" | "],
    "figures": ["%", "$", "+"],
}
OTHER = "prose"


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER)
    for topic, marks in reversed(TOPICS.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks]), topic).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def tempered(cells: DataFrame, power: float = TEMPER) -> DataFrame:
    """Targets that flatten each marginal: shares in proportion to tokens to the given power."""
    out = cells
    for name in MARGINS:
        total = F.sum("tokens").over(Window.partitionBy(name))
        size = F.count("*").over(Window.partitionBy(name))
        out = out.withColumn(f"pow_{name}", F.pow(total.cast("double"), F.lit(power)))
        out = out.withColumn(f"part_{name}", F.col(f"pow_{name}") / size)
    sums = out.agg(*[F.sum(f"part_{n}").alias(f"sum_{n}") for n in MARGINS])
    out = out.crossJoin(F.broadcast(sums))  # a single row
    return out.select(
        *MARGINS, "tokens", *[(F.col(f"pow_{n}") / F.col(f"sum_{n}")).alias(f"target_{n}") for n in MARGINS]
    )


def with_targets(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Stated targets by margin and value; values without a target get none of the tokens."""
    out = cells
    for name in MARGINS:
        given = targets[name.removeprefix("mix_")]
        total = sum(given.values())
        pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(v / total))]
        out = out.withColumn(f"target_{name}", F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(0.0)))
    return out


def with_goals(cells: DataFrame, budget: float) -> DataFrame:
    """Adds goal_*: the tokens each value of a margin is to keep.

    A value whose target needs more than all its tokens keeps them all, and the others of its margin share the
    rest in proportion to their targets, so every margin keeps the same number of tokens: the budget, or all there are.
    """
    total = F.sum("tokens")
    limit = cells.agg(F.least(F.first("all_tokens") * F.lit(budget), total.cast("double")).alias("limit"))
    values = reduce(
        DataFrame.unionByName,
        [
            cells.groupBy(F.col(n).alias("value")).agg(F.max(f"target_{n}").alias("target"), total.alias("most")).withColumn("margin", F.lit(n))
            for n in MARGINS
        ],
    )
    at = Window.partitionBy("margin").orderBy(F.desc(F.col("target") / F.col("most")), "value")
    held = F.coalesce(F.sum("most").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("target").over(at.rowsBetween(0, Window.unboundedFollowing))
    values = values.crossJoin(F.broadcast(limit)).withColumn("a", (F.col("limit") - held) / left)  # a single row
    fits = F.max(F.when(F.col("a") * F.col("target") <= F.col("most"), F.col("a"))).over(Window.partitionBy("margin"))
    goals = values.select("margin", "value", F.coalesce(F.least("most", fits * F.col("target")), "most").cast("double").alias("goal"))
    goals = materialize(goals, "mix-goals")
    out = cells
    for n in MARGINS:
        of = goals.where(F.col("margin") == n).select(F.col("value").alias(n), F.col("goal").alias(f"goal_{n}"))
        out = out.join(of, n)
    return out


def rake(cells: DataFrame, sweeps: int = MOST_SWEEPS) -> DataFrame:
    """Adds p: the share of its tokens each cell keeps, the product of a factor for each margin, at most 1.

    Each step sets the factors of one margin so that its goals are met exactly under that bound: cells come in
    order of the product of their other factors, and the first ones are whole. Sweeps end when every margin
    meets its goals. The table has a row for each combination that occurs, never one for a document; up to
    CELLS_ON_DRIVER of them are fitted there, more by Spark.
    """
    cells = materialize(cells, "mix-cells")
    if cells.count() <= CELLS_ON_DRIVER:
        return _raked_on_driver(cells, sweeps)
    out = cells.withColumns({f"by_{n}": F.lit(1.0) for n in MARGINS})
    p = F.least(F.lit(1.0), reduce(lambda a, b: a * b, [F.col(f"by_{n}") for n in MARGINS]))
    for _ in range(sweeps):
        for name in MARGINS:
            others = [n for n in MARGINS if n != name]
            out = out.withColumn("w", reduce(lambda a, b: a * b, [F.col(f"by_{n}") for n in others]))
            at = Window.partitionBy(name).orderBy(F.desc("w"), *others)
            whole = F.coalesce(F.sum("tokens").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            left = F.sum(F.col("tokens") * F.col("w")).over(at.rowsBetween(0, Window.unboundedFollowing))
            out = out.withColumn("a", (F.col(f"goal_{name}") - whole) / left)
            of = Window.partitionBy(name)
            fits = F.max(F.when(F.col("a") * F.col("w") <= 1 + 1e-12, F.col("a"))).over(of)
            out = out.withColumn(f"by_{name}", F.coalesce(fits, 1 / F.min("w").over(of)))
        # The rule of the other path: after every sweep.
        out = materialize(out.drop("w", "a"), "mix-cells")
        if _off(out.withColumn("p", p)) <= TOLERANCE:
            break
    return out.withColumn("p", p)


def _raked_on_driver(cells: DataFrame, sweeps: int) -> DataFrame:
    table = cells.orderBy(*MARGINS).toPandas()
    tokens = table["tokens"].to_numpy(float)
    groups = [np.unique(table[n].to_numpy(str), return_inverse=True)[1] for n in MARGINS]
    goals = [table[f"goal_{n}"].to_numpy(float) for n in MARGINS]
    by = [np.ones(len(table)) for _ in MARGINS]
    p = np.ones(len(table))
    for _ in range(sweeps if len(table) else 0):
        for k, group in enumerate(groups):
            w = np.prod([x for i, x in enumerate(by) if i != k], axis=0)
            order = np.lexsort((-w, group))
            t, v, of = tokens[order], w[order], group[order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            whole, left = np.empty(len(t)), np.empty(len(t))
            for a, b in zip(first, [*first[1:], len(t)]):
                whole[a:b] = np.cumsum(t[a:b]) - t[a:b]
                left[a:b] = np.cumsum((t[a:b] * v[a:b])[::-1])[::-1]
            factor = (goals[k][order] - whole) / left
            fits = np.maximum.reduceat(np.where(factor * v <= 1 + 1e-12, factor, -np.inf), first)
            fits = np.where(np.isfinite(fits), fits, 1 / np.minimum.reduceat(v, first))
            by[k] = fits[group]
        p = np.minimum(1.0, np.prod(by, axis=0))
        off = max(np.abs(np.bincount(g, tokens * p)[g] - goal).max() for g, goal in zip(groups, goals))
        if off <= TOLERANCE * (tokens * p).sum():
            break
    fitted = pa.table({n: pa.array(table[n], pa.string()) for n in MARGINS} | {"p": pa.array(p)})
    return cells.join(cells.sparkSession.createDataFrame(fitted), MARGINS)


def _off(cells: DataFrame) -> float:
    """Largest distance of a margin's tokens from its goal, as a share of the budget."""
    out = cells
    for n in MARGINS:
        got = F.sum(F.col("tokens") * F.col("p")).over(Window.partitionBy(n))
        out = out.withColumn(f"off_{n}", F.abs(got - F.col(f"goal_{n}")))
    kept = F.sum(F.col("tokens") * F.col("p"))
    return out.agg(F.coalesce(F.max(F.greatest(*[f"off_{n}" for n in MARGINS])) / kept, F.lit(0.0))).first()[0]


def uniform(key: Column, seed: int) -> Column:
    """In [0, 1) from the first 32 bits of the digest of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def describe(docs: DataFrame) -> DataFrame:
    """Adds the margins, mix_tokens and the document's draw."""
    text = whole_text()
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text.cast("binary"))))
    return docs.select(
        "*",
        F.coalesce("source", F.lit("")).alias("mix_source"),
        F.coalesce("lang", F.lit("")).alias("mix_lang"),
        topic_of(text).alias("mix_topic"),
        word_count(text).alias("mix_tokens"),
        uniform(key, SEED).alias("mix_draw"),
    )


def fit(described: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """Per cell: margins, share of the sample, mix_probability, and each margin's target and share of the sample.

    ``budget`` is the share of all tokens to keep. A cell without a target is not kept.
    """
    cells = described.groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0")
    cells = materialize(cells, "mix-margins")
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    aimed = tempered(cells) if targets is None else with_targets(cells, targets)
    aimed = materialize(aimed.crossJoin(F.broadcast(total)), "mix-targets")  # a single row
    wanted = reduce(lambda a, b: a & b, [F.col(f"target_{n}") > 0 for n in MARGINS])
    fitted = rake(with_goals(aimed.where(wanted), budget)).select(*MARGINS, "tokens", "p", *[f"target_{n}" for n in MARGINS])
    rest = aimed.where(~wanted).select(*MARGINS, "tokens", F.lit(0.0).alias("p"), *[f"target_{n}" for n in MARGINS])
    out = fitted.unionByName(rest)
    kept = out.agg(F.sum(F.col("tokens") * F.col("p")).alias("kept"))
    out = out.crossJoin(F.broadcast(kept)).withColumn("share", F.try_divide(F.col("tokens") * F.col("p"), "kept"))  # a single row
    for n in MARGINS:
        out = out.withColumn(f"{n}_share", F.sum("share").over(Window.partitionBy(n)))
    return out.select(
        *MARGINS,
        "share",
        F.col("p").alias("mix_probability"),
        *[x for n in MARGINS for x in (F.col(f"target_{n}").alias(f"{n}_target"), F.col(f"{n}_share"))],
    )


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """All documents with mix_* columns; mix_kept marks the sample."""
    described = describe(docs)
    cells = fit(described, targets, budget).withColumnRenamed("share", "mix_share")
    cells = cells.select(*[F.col(n).alias(f"of_{n}") for n in MARGINS], *[c for c in cells.columns if c not in MARGINS])
    same = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"of_{n}") for n in MARGINS])
    # A cell may hold a third of all documents: the few cells go to the documents, or Spark splits the skewed join.
    out = described.join(cells, same, "left").drop(*[f"of_{n}" for n in MARGINS])
    p = F.coalesce("mix_probability", F.lit(budget))
    return out.withColumn("mix_probability", p).withColumn("mix_kept", F.col("mix_draw") < F.col("mix_probability"))


def sample(docs: DataFrame) -> DataFrame:
    """The documents kept, with their columns."""
    return mix(docs).where("mix_kept").select(*docs.columns)


def _sql() -> str:
    topic = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(t, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS.items()
    ) + f" ELSE '{OTHER}' END"
    words = r"len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))"
    out = f"""WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, {topic} AS p, CAST({words} AS BIGINT) AS tokens,
         CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(t))), 1, 8))::UBIGINT AS DOUBLE)
           / {float(2**32)} AS draw
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT s, l, p, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""
    for m in "slp":
        out += f""",
value_{m} AS (
  SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) AS w, CAST(sum(tokens) AS DOUBLE) AS most FROM cells GROUP BY ALL),
aim_{m} AS (
  SELECT *, ({BUDGET} * sum(most) OVER () - coalesce(sum(most) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(target) OVER (win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM (SELECT *, w / sum(w) OVER () AS target FROM value_{m}) WINDOW win AS (ORDER BY target / most DESC, {m})),
goal_{m} AS MATERIALIZED (
  SELECT {m}, target, coalesce(least(most, target * max(a) FILTER (a * target <= most) OVER ()), most) AS goal FROM aim_{m})"""
    # One sweep: a factor for each margin in turn, so that its goals are met under the bound of 1.
    rows = "fitting WHERE NOT done AND k < " + str(MOST_SWEEPS)
    for m in "slp":
        o = [n for n in "slp" if n != m]
        rows = f"""(SELECT * EXCLUDE (w, a) REPLACE (
      coalesce(max(a) FILTER (a * w <= 1 + 1e-12) OVER (PARTITION BY {m}), 1 / min(w) OVER (PARTITION BY {m})) AS by_{m}) FROM (
      SELECT *, (goal_{m} - coalesce(sum(tokens) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(tokens * w) OVER (win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
      FROM (SELECT *, by_{o[0]} * by_{o[1]} AS w FROM {rows}) WINDOW win AS (PARTITION BY {m} ORDER BY w DESC, {o[0]}, {o[1]})))"""
    off = ", ".join(f"abs(sum(tokens * prob) OVER (PARTITION BY {m}) - goal_{m})" for m in "slp")
    margins = {"s": "source", "l": "lang", "p": "topic"}
    shares = ", ".join(f"target_{m}, sum(share) OVER (PARTITION BY {m}) AS share_{m}" for m in "slp")
    reported = ", ".join(f"round(target_{m}, 9) AS {n}_target, round(share_{m}, 9) AS {n}_share" for m, n in margins.items())
    return out.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + f""",
start AS MATERIALIZED (
  SELECT s, l, p, CAST(tokens AS DOUBLE) AS tokens, a.goal AS goal_s, b.goal AS goal_l, c.goal AS goal_p,
         a.target AS target_s, b.target AS target_l, c.target AS target_p
  FROM cells JOIN goal_s a USING (s) JOIN goal_l b USING (l) JOIN goal_p c USING (p)),
fitting AS (
  SELECT 0 AS k, false AS done, CAST(1 AS DOUBLE) AS by_s, CAST(1 AS DOUBLE) AS by_l, CAST(1 AS DOUBLE) AS by_p,
         CAST(1 AS DOUBLE) AS prob, * FROM start
  UNION ALL
  SELECT k + 1, max(off) OVER () <= {TOLERANCE} * sum(tokens * prob) OVER () AS done, by_s, by_l, by_p, prob, * EXCLUDE (k, done, by_s, by_l, by_p, prob, off)
  FROM (SELECT *, greatest({off}) AS off FROM (SELECT * REPLACE (least(1.0, by_s * by_l * by_p) AS prob) FROM {rows}))),
fitted AS (
  SELECT s, l, p, prob, share, {shares}
  FROM (SELECT *, tokens * prob / sum(tokens * prob) OVER () AS share FROM fitting WHERE k = (SELECT max(k) FROM fitting)))
SELECT d.doc_id, d.s AS source, d.l AS lang, d.p AS topic, d.tokens, round(coalesce(share, 0), 9) AS cell_share,
       round(coalesce(prob, {BUDGET}), 7) AS probability, d.draw < coalesce(prob, {BUDGET}) AS kept, {reported}
FROM d LEFT JOIN fitted f ON d.s = f.s AND d.l = f.l AND d.p = f.p"""


@query("op2_mixing", _sql())
def op2_mixing(spark, sf):
    """Each document's cell, the cell's share of the sample, its probability, whether the sample has it, and each margin's target and achieved share."""
    return mix(documents(spark, sf).select(*DOCUMENT_COLUMNS)).select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"),
        F.round(F.coalesce("mix_share", F.lit(0.0)), 9).alias("cell_share"),
        F.round("mix_probability", 7).alias("probability"),
        F.col("mix_kept").alias("kept"),
        *[F.round(f"{n}_{k}", 9).alias(f"{n.removeprefix('mix_')}_{k}") for n in MARGINS for k in ("target", "share")],
    )
