"""URL filter: rules first, then trust and distrust that spread over host links.

The longest rule that fits a page's host and path decides about the page. The
share of a host's pages that rules allow is its trust as a seed, the share that
they block its distrust. Trust follows links (who a trusted host links to),
distrust runs against them (who links to a blocked host). Both are personalised
PageRank as a sum of walks: a step halts with probability 1 - DAMPING, else goes
on over one of the links; steps are added until what is left is under a
thousandth of the seeds. The same walks from every host give the scale, so a
host's score is the share of the walkers arriving there that started at judged
pages. A host is blocked when the distrusted share is at least THRESHOLD and
above the trusted one; its verdict holds for its pages without a rule.

Host edges come from the absolute links of the pages and, as subdomains
belong together, between a host and the domain it is under (both ways, domains
of at least two labels). Edges are counted once whatever the number of links.

Pages meet the values of their host by key, but for the hosts with over a
thousandth of all pages: there are under a thousand of those, and their values
are broadcast, so that no key gathers a great part of the pages in one task.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; repeated rows are judged
each, and count each for the shares; of rules equally long a block wins; an
empty table gives no rows; further columns are kept by :func:`clean` and
ignored by :func:`judge`, whose own columns are those of the query.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from telespan.llm.base import query, table
from telespan.scratch import materialize

#: Verdict and rule (host and path) of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DAMPING = 0.85
REST = 1e-3  # share of the walkers that may still be under way
STEPS = ceil(log(REST) / log(DAMPING))
THRESHOLD = 0.5
STEPS_PER_TABLE = 4
HOT = 1_000  # keys with over 1 / HOT of the rows; there are fewer than HOT
RULES_BROADCAST = 100_000
DIGITS = 9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold over 1 / HOT of the rows: fewer than HOT of them."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.join(total, F.col("n") * HOT > F.col("total"), "inner").select(key)


def spread_join(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """Join ``values`` (one row a key) to the rows; those of the few hot keys are broadcast, not shuffled."""
    few = F.broadcast(hot)
    cold = rows.join(few, key, "left_anti").join(values, key, how)
    return cold.unionByName(rows.join(few, key, "left_semi").join(F.broadcast(values.join(few, key, "left_semi")), key, how))


def parse_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """verdict, rule, host, path."""
    out = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"no rule: {verdict} {rule}")
        out.append((verdict, rule, host.lower(), slash + path))
    return out


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host and its rules, best first: those of its own name and of every domain above it."""
    given = hosts.sparkSession.createDataFrame(parse_rules(rules), "verdict string, rule string, above string, start string")
    if len(rules) <= RULES_BROADCAST:
        given = F.broadcast(given)
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = hosts.select("host", F.explode(names).alias("above")).join(given, "above")
    # Longest first; of equal ones a block, then by text.
    by = F.struct(-F.length("rule"), F.when(F.col("verdict") == "block", 0).otherwise(1), "rule", "start", "verdict")
    return rows.groupBy("host").agg(F.array_sort(F.collect_set(by)).alias("rules"))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Pages with host, path, rule and verdict (null without a rule), written once, and the hot hosts."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    names = rows.select("host")
    hot = materialize(hot_keys(names, "host"), "url-hot")
    known = host_rules(names.where("host != ''").distinct(), rules)
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    out = spread_join(rows, known, "host", hot).withColumn("fit", F.get(fits, F.lit(0)))
    out = out.withColumns({"rule": F.col("fit.rule"), "by_rule": F.col("fit.verdict")}).drop("rules", "fit")
    return materialize(out, "url-ruled"), hot


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst: links between different hosts, once each."""
    linked = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst")
    )
    links = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().union(links.select("dst").distinct()).distinct()
    parts = F.split("host", r"\.")
    above = F.array_join(F.slice(parts, 2, F.size(parts)), ".")
    under = hosts.where((F.size(parts) > 2) & ~F.col("host").rlike(r"\.[0-9]+(:[0-9]+)?$")).select("host", above.alias("above"))
    both = links.union(under.select("host", "above")).union(under.select("above", "host"))
    return both.where("src != dst AND src != '' AND dst != ''").distinct()


def steps_of(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(way, at) as key, next, share: a walker's moves with the links (way f) and against them (b).

    The moves of a key with many are dealt into copies of about 1 / HOT of all; the second table has the
    number of copies of these keys, of which there are fewer than HOT.
    """
    ways = [(F.lit("f"), "src", "dst"), (F.lit("b"), "dst", "src")]
    moves = [edges.select(F.concat(w, at).alias("key"), F.concat(w, to).alias("next")) for w, at, to in ways]
    moves = materialize(moves[0].union(moves[1]), "url-moves")
    degree = materialize(moves.groupBy("key").agg(F.count("*").alias("n")), "url-degree")
    total = F.broadcast(degree.agg(F.sum("n").alias("total")))  # one row
    hot = degree.join(total, F.col("n") * HOT > F.col("total"), "inner")
    hot = materialize(hot.select("key", F.ceil(F.col("n") * HOT / F.col("total")).cast("int").alias("copies")), "url-hot-moves")
    shares = spread_join(moves, degree.select("key", (DAMPING / F.col("n")).alias("share")), "key", hot.select("key"), "inner")
    dealt = F.pmod(F.xxhash64("next"), F.coalesce("copies", F.lit(1))).cast("int")
    shares = shares.join(F.broadcast(hot), "key", "left").withColumn("copy", dealt).drop("copies")
    return materialize(shares, "url-steps"), hot


def walks(seeds: DataFrame, steps: DataFrame, hot: DataFrame) -> DataFrame:
    """key, judged, whole: what arrives at every host, from seeds (key, judged, whole), over walks of up to STEPS steps.

    Each step moves what there is and adds the seeds again, so the last table is the sum over all lengths.
    """
    seeds, few = materialize(seeds, "url-seeds"), F.broadcast(hot)
    sums = [F.expr("sum(judged) AS judged"), F.expr("sum(whole) AS whole")]
    out = seeds
    for step in range(1, STEPS + 1):
        here = out.join(few, "key", "left").selectExpr("key", "judged", "whole", "explode(sequence(0, coalesce(copies, 1) - 1)) AS copy")
        moved = steps.join(here, ["key", "copy"]).selectExpr("next AS key", "share * judged AS judged", "share * whole AS whole")
        out = moved.union(seeds).groupBy("key").agg(*sums)
        if step % STEPS_PER_TABLE == 0 or step == STEPS:
            out = materialize(out, "url-walks")
    return out


def host_scores(pages: DataFrame, judged: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host, trust, distrust and blocked, for every host that has pages or links.

    A host that is only linked to is a seed if a rule fits its front page.
    """
    edges = materialize(host_edges(pages), "url-edges")
    counted = judged.where("host != ''").groupBy("host").agg(
        F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("f"),
        F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("b"),
    )
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    front = F.get(F.filter("rules", lambda r: F.startswith(F.lit("/"), r["start"])), F.lit(0))["verdict"]
    of_front = linked.join(host_rules(linked, rules).select("host", front.alias("verdict")), "host", "left")
    shares = [F.when(F.col("verdict") == v, 1.0).otherwise(0.0).alias(w) for w, v in (("f", "allow"), ("b", "block"))]
    nodes = counted.withColumn("seen", F.lit(1)).unionByName(of_front.select("host", *shares, F.lit(0).alias("seen")))
    nodes = nodes.groupBy("host").agg(F.max_by(F.struct("f", "b"), "seen").alias("s")).select("host", "s.*")
    seeds = nodes.select(F.inline(F.array(*[F.struct(F.concat(F.lit(w), "host").alias("key"), F.col(w).alias("judged"), F.lit(1.0).alias("whole")) for w in "fb"])))
    found = walks(seeds, *steps_of(edges))
    share = F.round(F.col("judged") / F.col("whole"), DIGITS)
    each = found.select(F.substring("key", 2, 1 << 30).alias("host"), F.substring("key", 1, 1).alias("way"), share.alias("share"))
    scores = each.groupBy("host").agg(
        F.max(F.when(F.col("way") == "f", F.col("share"))).alias("trust"),
        F.max(F.when(F.col("way") == "b", F.col("share"))).alias("distrust"),
    )
    return scores.withColumn("blocked", (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page row."""
    judged, hot = ruled(pages.select("page_id", "url"), rules)
    scores = materialize(host_scores(pages.select("url", "html"), judged, rules), "url-hosts")
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return spread_join(judged, scores, "host", hot).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust"
    )


def clean(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The page rows that are allowed, with all their columns."""
    own = pages.select("url", F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    judged, hot = ruled(own, rules)
    scores = materialize(host_scores(pages.select("url", "html"), judged.select("host", "by_rule"), rules), "url-hosts")
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    kept = spread_join(judged, scores, "host", hot).where(F.coalesce("by_rule", by_host) == "allow")
    return kept.select("page.*")


_HOST = f"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
_TARGET = _LINK.replace("'", "''")
_SQL = f"""WITH RECURSIVE given(by_rule, rule) AS (VALUES {", ".join(str(r) for r in RULES)}),
rules AS (SELECT *, split_part(rule, '/', 1) AS rhost, rule[strpos(rule, '/'):] AS start FROM given),
p AS MATERIALIZED (
  SELECT row_number() OVER () AS row, page_id, html, {_HOST} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS MATERIALIZED (
  SELECT row, page_id, host, path, rule, by_rule FROM p LEFT JOIN rules
    ON host != '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, by_rule DESC, rule) = 1),
links AS (
  SELECT DISTINCT host AS src, translate(dst, '{_UPPER}', '{_LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{_TARGET}', 1)) AS dst FROM p)),
hosts AS (SELECT host FROM p UNION SELECT dst FROM links),
under AS (
  SELECT host, host[strpos(host, '.') + 1:] AS above FROM hosts
  WHERE len(string_split(host, '.')) > 2 AND NOT regexp_matches(host, '\\.[0-9]+(:[0-9]+)?$')),
edges AS MATERIALIZED (
  SELECT * FROM (SELECT src, dst FROM links UNION SELECT host, above FROM under UNION SELECT above, host FROM under)
  WHERE src != dst AND src != '' AND dst != ''),
moves AS (SELECT 'f' AS way, src AS host, dst AS next FROM edges UNION ALL SELECT 'b', dst, src FROM edges),
steps AS MATERIALIZED (SELECT *, {DAMPING} / count(*) OVER (PARTITION BY way, host) AS share FROM moves),
counted AS (
  SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0 END) AS b
  FROM judged WHERE host != '' GROUP BY host),
front AS (
  SELECT host, by_rule FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges) LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND start IN ('', '/')
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(rule) DESC, by_rule DESC, rule) = 1),
nodes AS (
  SELECT * FROM counted UNION ALL
  SELECT host, CAST(coalesce(by_rule = 'allow', false) AS INTEGER), CAST(coalesce(by_rule = 'block', false) AS INTEGER)
  FROM front ANTI JOIN counted USING (host)),
terms(k, way, host, judged, whole) AS (
  SELECT 0, way, host, CASE way WHEN 'f' THEN f ELSE b END, CAST(1 AS DOUBLE)
  FROM nodes, (VALUES ('f'), ('b')) w(way)
  UNION ALL
  SELECT k + 1, way, next, sum(share * judged), sum(share * whole) FROM terms JOIN steps USING (way, host)
  WHERE k < {STEPS} GROUP BY k, way, next),
shares AS (SELECT host, way, round(sum(judged) / sum(whole), {DIGITS}) AS share FROM terms GROUP BY host, way),
scores AS (
  SELECT host, max(CASE way WHEN 'f' THEN share END) AS trust, max(CASE way WHEN 'b' THEN share END) AS distrust
  FROM shares GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)"""


@query("op11_link_filter", _SQL)
def op11_link_filter(spark, sf):
    """Every page's host, path, rule and verdict."""
    return judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")
