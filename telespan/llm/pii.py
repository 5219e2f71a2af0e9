"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds (email, ip, card, phone) are kept whenever their own check passes.
Further kinds need a score: an account number (mod 97) or a national phone
number starts low, and a validator or a word such as *tel* or *account* shortly
before it lifts it over the threshold.

All of it is column expressions. Positions come from splitting a text at its
matches: a match starts where the pieces and matches before it end. Patterns
are written so that the regex engine neither recurses per character nor tries
again inside a run it has passed.

Defined results: a null text is empty; overlapping spans of different kinds are
all reported; equal rows get equal results; an empty table gives no rows;
further columns are ignored by the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from telespan.llm.base import documents, query, whole_text

KINDS = ["email", "ip", "card", "phone"]
EXTRA = ["iban", "local_phone"]

# The base patterns, with possessive repeats and a look behind in place of retries inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+.-])(?<![0-9][ (/-])\(?0[0-9]{1,4}\)?[ /-][0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])",
}
# What the text must hold for a pattern to be tried at all.
MARKS = {"email": "@", "phone": "+"}
# Words that support a span, in any of the corpus' languages, and how far before it they may stand.
CONTEXT = {
    "email": ["mail", "contact", "write"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "karte", "tarjeta", "carte"],
    "phone": ["tel", "phone", "call", "fon"],
    "iban": ["iban", "account", "konto", "cuenta", "compte"],
    "local_phone": ["tel", "phone", "call", "fon"],
}
NEAR = 32
START = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "local_phone": 0.3}
CONFIRMED = {"card": 0.5, "iban": 0.6}
CONTEXT_GAIN = 0.3
THRESHOLD = 0.5
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match,before>> of all matches; offsets in code points, end exclusive."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    none = F.array().cast("array<struct<start:int,end:int,m:string,p:string>>")

    def step(acc, x):
        start = (acc["at"] + F.length(x["p"])).cast("int")
        end = (start + F.length(x["m"])).cast("int")
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.right(x["p"], F.lit(NEAR)).alias("p"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of the rearranged account number, letters read as 10 to 35, digit by digit group."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    chars = F.split(moved, "")

    def step(acc, c):
        code = F.ascii(c)
        digit = code < 58
        return F.pmod(F.when(digit, acc * 10 + code - 48).otherwise(acc * 100 + code - 55), F.lit(97)).cast("int")

    return F.aggregate(chars, F.lit(0), step)


def passes(kind: str, m: Column) -> Column:
    """The check a match must pass."""
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    if kind == "card":
        return F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m) == 1
    return F.lit(True)


def score(kind: str, m: Column, before: Column) -> Column:
    """Start, plus what a passed validator and a supporting word close before the span add."""
    near = reduce(lambda a, b: a | b, [F.contains(F.lower(before), F.lit(w)) for w in CONTEXT[kind]])
    total = F.lit(START[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
    if kind in CONFIRMED:
        total = total + F.when(passes(kind, m), CONFIRMED[kind]).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def _judged(kind: str) -> Column:
    scored = F.transform(
        f"pii_{kind}", lambda s: F.struct(s["start"], s["end"], s["m"], score(kind, s["m"], s["p"]).alias("score"))
    )
    if kind in KINDS:
        return F.filter(scored, lambda s: passes(kind, s["m"]))
    return F.filter(scored, lambda s: passes(kind, s["m"]) & (s["score"] >= THRESHOLD))


def detect(docs: DataFrame) -> DataFrame:
    """Adds one array<struct<start,end,m,score>> column per kind."""
    out = docs.withColumn("pii_text", whole_text())
    text = F.col("pii_text")
    none = F.array().cast("array<struct<start:int,end:int,m:string,p:string>>")
    for kind in KINDS + EXTRA:
        found = spans_of(text, PATTERNS[kind])
        mark = MARKS.get(kind)
        out = out.withColumn(f"pii_{kind}", found if mark is None else F.when(F.contains(text, F.lit(mark)), found).otherwise(none))
    for kind in KINDS + EXTRA:
        out = out.withColumn(f"pii_{kind}", _judged(kind))
    return out.drop("pii_text")


def labelled(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind and start, comma-joined."""

    def one(kind):
        label = lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(f"pii_{kind}", label)

    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def _base_sql() -> str:
    """The base kinds in DuckDB, by the plain patterns. The look-around of the other kinds has no form there."""
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digit = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digit}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST({digit}[-i] AS INT)
           ELSE CAST({digit}[-i] AS INT) * 2 - CASE WHEN {digit}[-i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"""
    check = {
        "email": "true",
        "ip": f"regexp_full_match(m, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}')",
        "card": f"length({digit}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digit}) BETWEEN 8 AND 15",
    }
    out = "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents)"
    for kind in KINDS:
        out += f""",
m_{kind} AS (SELECT id, unnest(range(1, len(ms) + 1)) AS i, ms, ps
  FROM (SELECT id, regexp_extract_all(t, '{base[kind]}') AS ms, string_split_regex(t, '{base[kind]}') AS ps FROM d) WHERE len(ms) > 0),
s_{kind} AS (
  SELECT id, m, '{kind}' AS kind, {KINDS.index(kind)} AS k, "end" - length(m) AS start, "end" FROM (
    SELECT id, ms[i] AS m, sum(length(ps[i]) + length(ms[i])) OVER (PARTITION BY id ORDER BY i) AS "end" FROM m_{kind})
  WHERE {check[kind]})"""
    spans = " UNION ALL ".join(f"SELECT id, kind, k, start, \"end\" FROM s_{k}" for k in KINDS)
    return out + f""",
base AS (SELECT id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY k, start) AS x
  FROM ({spans}) GROUP BY id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(x, '')) AS base_sha256
FROM d LEFT JOIN base USING (id)"""


BASE_SQL = _base_sql()


@query("op5_pii")
def op5_pii(spark, sf):
    """Counts, digest and list of the personal data in every whole text."""
    found = detect(documents(spark, sf).select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(labelled(KINDS), 256).alias("base_sha256"),
        labelled(KINDS + EXTRA).alias("spans"),
        *[F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in EXTRA],
    )
