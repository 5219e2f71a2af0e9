"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts
of vote patterns estimates how often each rule says what in good and in bad
documents; the posterior probability of *good* decides, instead of a demand that
all rules pass. There are at most ``3 ** len(RULES)`` patterns, so an iteration
reads a table that does not grow with the documents, and estimates cover every
document.

Defined results: a null or empty text has no words and fails the base rule; a
text of under 5 words has no window; equal rows get equal results; an empty
table gives no rows; further columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from telespan.llm.base import documents, query, whole_text
from telespan.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
ITERATIONS = 12
SMOOTH = 0.5

# Rules as (good if, bad if), SQL that Spark and DuckDB read alike, over the measures below.
RULES = {
    "length": ("n_words >= 20", "n_words < 10"),
    "word_length": ("word_chars BETWEEN 2.5 * n_words AND 12 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "symbols": ("100 * n_symbols <= 5 * n_words", "100 * n_symbols > 25 * n_words"),
    "marks": ("100 * n_marks <= 8 * word_chars", "100 * n_marks > 12 * word_chars"),
    "bars": ("100 * n_bars <= 2 * n_words", "100 * n_bars > 15 * n_words OR 100 * (n_symbols - n_bars) > 60 * n_words"),
    "shouting": ("100 * n_bangs <= 5 * n_words", "100 * n_bangs > 25 * n_words"),
    "capitals": ("100 * n_capitals <= 15 * word_chars", "100 * n_capitals > 40 * word_chars"),
    "lines": ("n_dup_lines = 0", "100 * n_dup_lines > 30 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    "variety": ("2 * n_distinct > n_words", "n_words >= 30 AND 4 * n_distinct < n_words"),
}
VOTES = [f"v_{name}" for name in RULES]
# Where estimation starts: votes against are rare in good documents, and a bad one draws some.
START = {"prior": 0.85, "good": {-1: 0.02, 0: 0.08, 1: 0.9}, "bad": {-1: 0.3, 0: 0.1, 1: 0.6}}
MARKS = "!#$%&()*+-/0123456789:;<=>?@[]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows found more than once; ``hashes`` has one per window, in order."""
    # Windows in order of their hash; equal neighbours are found by pairing the array with itself moved by one.
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(
        F.slice(ordered, 1, F.size(hashes) - 1),
        F.slice(ordered, 2, F.size(hashes)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(same)))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def measures(docs: DataFrame) -> DataFrame:
    """Counts per document, all within the row."""
    base = docs.select("doc_id", whole_text().alias("t"))
    base = base.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), 0))
    base = base.withColumn("n", F.size("words"))
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    base = base.withColumn(
        "hashes",
        F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0))), window)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    base = base.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0))
    return base.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        _without(F.col("t"), "!").cast("bigint").alias("n_bangs"),
        _without(F.col("t"), MARKS).cast("bigint").alias("n_marks"),
        _without(F.col("t"), "|").cast("bigint").alias("n_bars"),
        _without(F.col("t"), CAPITALS).cast("bigint").alias("n_capitals"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words"), F.col("hashes")).cast("bigint").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
    )


def votes(measured: DataFrame) -> DataFrame:
    """1, -1 or 0 for each rule."""
    return measured.select(
        "*",
        *[
            F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"v_{name}")
            for name, (good, bad) in RULES.items()
        ],
    )


def _posterior(prior, table) -> str:
    """Probability of good as SQL text; ``table`` gives P(vote | class) by class, rule and vote, as text."""

    def log_likelihood(kind):
        terms = [
            f"CASE {v} WHEN 1 THEN ln({table(kind, v, 1)}) WHEN -1 THEN ln({table(kind, v, -1)}) ELSE ln({table(kind, v, 0)}) END"
            for v in VOTES
        ]
        return " + ".join(terms)

    return f"1 / (1 + exp(ln(1 - {prior}) - ln({prior}) + ({log_likelihood('bad')}) - ({log_likelihood('good')})))"


def _sums(q: str) -> list[str]:
    """The expected counts, as SQL text with names; q is the posterior's name."""
    out = [f"sum(n * {q}) AS good", f"sum(n * (1 - {q})) AS bad"]
    for v in VOTES:
        for vote in (-1, 0, 1):
            for kind, w in (("good", q), ("bad", f"(1 - {q})")):
                out.append(f"sum(CASE WHEN {v} = {vote} THEN n * {w} ELSE 0 END) AS {_cell(kind, v, vote)}")
    return out


def _cell(kind: str, v: str, vote: int) -> str:
    return f"{kind}_{v}_{vote + 1}"


def estimate(voted: DataFrame, iterations: int = ITERATIONS) -> dict[str, float]:
    """Prior and P(vote | class), by expectation-maximisation. Each step returns one row of sums."""
    patterns = materialize(voted.groupBy(*VOTES).agg(F.count("*").alias("n")), "vote-patterns")
    p = {"prior": START["prior"]} | {
        _cell(k, v, vote): START[k][vote] for k in ("good", "bad") for v in VOTES for vote in (-1, 0, 1)
    }
    for _ in range(iterations):
        q = F.expr(_posterior(repr(p["prior"]) + "D", lambda k, v, x: repr(p[_cell(k, v, x)]) + "D"))
        s = patterns.withColumn("q", q).selectExpr(*_sums("q")).first().asDict()
        if s["good"] is None:  # no documents
            break
        p = {"prior": (s["good"] + SMOOTH) / (s["good"] + s["bad"] + 2 * SMOOTH)} | {
            _cell(k, v, vote): (s[_cell(k, v, vote)] + SMOOTH) / (s[k] + 3 * SMOOTH)
            for k in ("good", "bad")
            for v in VOTES
            for vote in (-1, 0, 1)
        }
    return p


def accuracies(p: dict[str, float]) -> dict[str, float]:
    """How often each rule is right when it votes."""
    out = {}
    for name in RULES:
        right = p["prior"] * p[_cell("good", f"v_{name}", 1)] + (1 - p["prior"]) * p[_cell("bad", f"v_{name}", -1)]
        wrong = p["prior"] * p[_cell("good", f"v_{name}", -1)] + (1 - p["prior"]) * p[_cell("bad", f"v_{name}", 1)]
        out[name] = right / (right + wrong)
    return out


BASE_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"


def judge(docs: DataFrame) -> DataFrame:
    """Measures, votes, p_good, base_failed and kept per document."""
    voted = materialize(votes(measures(docs)), "quality-votes")
    p = estimate(voted)
    good = F.expr(_posterior(repr(p["prior"]) + "D", lambda k, v, x: repr(p[_cell(k, v, x)]) + "D"))
    out = voted.withColumn("p_good", good).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def _sql() -> str:
    strip = r"regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')"
    count = lambda chars: "length(t) - length(translate(t, '" + chars + "', ''))"
    voted = ", ".join(
        f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{name}" for name, (good, bad) in RULES.items()
    )
    out = rf"""WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT id, regexp_extract_all(t, '{WORD}') AS words FROM d),
windows AS (SELECT id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS x
            FROM (SELECT id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, x) > 1),
repeats AS (SELECT id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range({WINDOW}) r(k) GROUP BY id),
lines AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
m AS MATERIALIZED (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length({strip}) AS word_chars, {count(SYMBOLS)} AS n_symbols,
         {count("!")} AS n_bangs, {count(MARKS)} AS n_marks, {count("|")} AS n_bars, {count(CAPITALS)} AS n_capitals, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_distinct(words)) AS n_distinct
  FROM d JOIN w USING (id) JOIN lines USING (id) LEFT JOIN repeats r USING (id)),
v AS MATERIALIZED (SELECT *, {voted} FROM m),
patterns AS MATERIALIZED (SELECT {', '.join(VOTES)}, count(*) AS n FROM v GROUP BY ALL),
p0 AS (SELECT CAST({START['prior']} AS DOUBLE) AS prior, """
    cells = [(k, v, x) for k in ("good", "bad") for v in VOTES for x in (-1, 0, 1)]
    out += ", ".join(f"CAST({START[k][x]} AS DOUBLE) AS {_cell(k, v, x)}" for k, v, x in cells) + ")"
    for i in range(ITERATIONS):
        out += f""",
q{i} AS (SELECT patterns.*, {_posterior('prior', _cell)} AS q FROM patterns, p{i}),
s{i} AS (SELECT {', '.join(_sums('q'))} FROM q{i}),
p{i + 1} AS MATERIALIZED (SELECT (good + {SMOOTH}) / (good + bad + {2 * SMOOTH}) AS prior, """
        out += ", ".join(f"({_cell(k, v, x)} + {SMOOTH}) / ({k} + {3 * SMOOTH}) AS {_cell(k, v, x)}" for k, v, x in cells)
        out += f" FROM s{i})"
    return out + f""",
judged AS (SELECT v.*, {_posterior('prior', _cell)} AS p_good FROM v, p{ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       NOT ({BASE_FAILED}) AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good FROM judged"""


@query("op8_quality_rules", _sql())
def op8_quality_rules(spark, sf):
    """Measures of every whole text, the base rule, and the verdict of the weighed votes."""
    return judge(documents(spark, sf)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("p_good", 6).alias("p_good"),
    )
