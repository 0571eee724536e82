"""URL filters: explicit rules, then a per-host tree of path templates judged by its labelled part.

1. A url's path is cut into segments.  Level by level a segment becomes a branch
   of the tree node above it: numbers, dates, hashes, long mixed codes and file
   numbers are a wildcard at once.  A url that is alone at its node is a template
   of its own, whose rest is one wildcard; so the tree is as deep as the urls
   share their paths.
2. Sibling branches whose labelled share of bad urls does not differ from their
   node's (Wilson interval) merge into one wildcard; those clearly better or
   worse stay apart as merged branches of their kind.
   Branches without labels merge among themselves.
3. A template's purity is its labelled share of good urls, smoothed towards that
   of the node above it, and so on up to the host, its parent domains and the
   whole table; templates below the limit are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .registry import register, table

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PRIOR = 0.8  # purity of a host without labels
SMOOTHING = 4.0  # labelled urls that the purity above counts as
PURITY = 0.5  # templates below are rejected
Z = 1.96
SLACK = 1e-9  # by which an interval's end must differ: rounding alone is no difference

NUMBER = r"^(\d+([._-]\w+)*|[0-9a-fA-F-]{8,})(\.[A-Za-z]{1,5})?$"
CODE = r"^[\w-]{10,}(\.[A-Za-z]{1,5})?$"  # with letters and digits


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null; of rules of one length the first."""
    fits = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        test = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, hit) if fits is None else fits.when(test, hit)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def path_templates(urls: DataFrame, z: float = Z) -> DataFrame:
    """``(host, path, good, bad, template)`` of distinct ``(host, path, good, bad)`` rows; a level of the tree a pass."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    at = urls.select("host", "path", "good", "bad", F.lit("").alias("node"))
    out, i = None, 0
    while True:
        p = F.get(parts, F.lit(i))
        clean = F.when(p.rlike(NUMBER) | p.rlike(CODE) & p.rlike("[0-9]") & p.rlike("[A-Za-z]"), F.lit("*")).otherwise(p)
        at = at.withColumn("seg", clean)
        branches = at.groupBy("host", "node", "seg").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("urls"))
        nodes = branches.groupBy("host", "node").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.sum("urls").alias("all_urls"), F.count(F.lit(1)).alias("fan"))
        known = branches.join(nodes, ["host", "node"])
        labelled, p = F.col("good") + F.col("bad"), F.col("bad") / (F.col("good") + F.col("bad"))
        middle = (p + z * z / (2 * labelled)) / (1 + z * z / labelled)
        half = z * F.sqrt(p * (1 - p) / labelled + z * z / (4 * labelled * labelled)) / (1 + z * z / labelled)
        whole = F.col("all_bad") / (F.col("all_good") + F.col("all_bad"))
        kind = F.when(F.col("all_urls") == 1, "**").when(labelled == 0, "*").when(middle - half > whole + SLACK, "*bad").when(middle + half < whole - SLACK, "*good")
        kind = kind.when(F.col("fan") > 1, "*like").otherwise(F.col("seg"))
        named = known.select("host", "node", "seg", kind.alias("branch"))
        at = at.join(named, ["host", "node", "seg"]).withColumn("node", F.concat("node", F.lit("/"), "branch"))
        done = (F.col("branch") == "**") | (F.size(parts) <= i + 1)
        at = materialise(at.select("host", "path", "good", "bad", "node", done.alias("done")), "paths")
        ended = at.filter("done").select("host", "path", "good", "bad", F.col("node").alias("template"))
        out = ended if out is None else out.unionByName(ended)
        at = at.filter("not done").drop("done")
        if at.isEmpty():
            return out
        i += 1


def judged(templates: DataFrame, prior: float = PRIOR, smoothing: float = SMOOTHING, purity: float = PURITY) -> DataFrame:
    """``(host, template, purity, method)`` of the distinct templates.

    Counts are added up for every host and node; a template's purity starts from
    the prior and is smoothed down that chain.
    """
    per = materialise(templates.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "per_template")
    nodes = F.split("template", "/")  # the first, empty one is the host itself
    above = F.transform(F.sequence(F.lit(1), F.size(nodes)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(nodes, 1, k), "/").alias("node")))
    chains = per.select("host", "template", "good", "bad", F.explode(above).alias("at")).select("host", "template", "good", "bad", "at.*")
    sums = chains.groupBy("host", "node").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    chain = F.array_sort(F.collect_list(F.struct("depth", "g", "b")))  # one entry per level
    share = F.aggregate(chain, F.lit(prior), lambda p, x: (x["g"] + smoothing * p) / (x["g"] + x["b"] + smoothing))
    per = chains.select("host", "template", "depth", "node").join(sums, ["host", "node"]).groupBy("host", "template").agg(share.alias("purity"))
    return per.withColumn("method", F.when(F.col("purity") < purity, "block").otherwise("allow"))


def filter_urls(
    pages: DataFrame, page_id: str, url: str, rules: Sequence[tuple[str, str, str]], good: Column | None = None, purity: float = PURITY
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)``, one row per row of ``pages``.

    A rule decides the urls it fits.  All others take their template's verdict.
    Labels are ``good`` (a boolean column of ``pages``, null where unknown) and,
    for urls that a rule fits, the rule's verdict.  A null url or one without
    ``://`` has an empty host and path, a template of its own.  Equal rows get
    equal verdicts; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    label = F.lit(None).cast("boolean") if good is None else good
    read = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("label"))
    read = materialise(read.withColumn("hit", rule_match(F.col("host"), F.col("path"), rules)), "urls")
    fine = F.coalesce(F.col("hit.verdict") == "allow", F.col("label"))
    urls = read.groupBy("host", "path").agg(
        F.count(F.when(fine, 1)).alias("good"),
        F.count(F.when(~fine, 1)).alias("bad"),
    )
    templates = path_templates(materialise(urls, "distinct"))
    out = read.join(templates.select("host", "path", "template"), ["host", "path"]).join(judged(templates, purity=purity), ["host", "template"])
    return out.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "method").alias("verdict"), "template", "purity"
    )


SQL_LEVELS = 8  # the SQL has no loop; the given urls share fewer levels


def _sql() -> str:
    """The same steps as SQL."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    cases = "".join(
        f" WHEN (host = {lit(h)} OR ends_with(host, {lit('.' + h)})) AND starts_with(path, {lit(p)}) THEN {lit(h + p + ' ' + v)}"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    piece = lambda i: f"CASE WHEN len(parts) > {i} THEN parts[{i + 1}] END"
    clean = lambda e: (
        f"CASE WHEN regexp_matches({e}, {lit(NUMBER)}) OR regexp_matches({e}, {lit(CODE)}) AND regexp_matches({e}, '[0-9]') AND regexp_matches({e}, '[A-Za-z]') THEN '*' ELSE {e} END"
    )
    levels = ""
    for i in range(SQL_LEVELS):
        levels += f""", a{i} AS (SELECT *, {clean('(' + piece(i) + ')')} AS seg FROM t{i}
), b{i} AS (SELECT host, node, seg, sum(good) good, sum(bad) bad, count(*) urls FROM a{i} GROUP BY ALL
), o{i} AS (SELECT host, node, sum(good) ag, sum(bad) ab, sum(urls) aurls, count(*) fan FROM b{i} GROUP BY ALL
), k{i} AS (SELECT b.*, aurls, fan, (good + bad)::DOUBLE l, CASE WHEN good + bad > 0 THEN bad / (good + bad)::DOUBLE END p,
  CASE WHEN ag + ab > 0 THEN ab / (ag + ab)::DOUBLE END whole FROM b{i} b JOIN o{i} USING (host, node)
), w{i} AS (SELECT *, (p + {Z * Z} / (2 * l)) / (1 + {Z * Z} / l) mid, {Z} * sqrt(p * (1 - p) / l + {Z * Z} / (4 * l * l)) / (1 + {Z * Z} / l) half FROM k{i}
), n{i} AS (SELECT host, node, seg, CASE WHEN aurls = 1 THEN '**' WHEN l = 0 THEN '*' WHEN mid - half > whole + {SLACK} THEN '*bad'
  WHEN mid + half < whole - {SLACK} THEN '*good' WHEN fan > 1 THEN '*like' ELSE seg END branch FROM w{i}
), e{i} AS MATERIALIZED (SELECT host, path, good, bad, parts, node || '/' || branch AS node, branch = '**' OR len(parts) <= {i + 1} AS done FROM a{i} JOIN n{i} USING (host, node, seg)
), t{i + 1} AS (SELECT host, path, good, bad, parts, node FROM e{i} WHERE NOT done)"""
    ended = " UNION ALL ".join(f"SELECT host, path, good, bad, node AS template FROM e{i} WHERE done" for i in range(SQL_LEVELS))
    return f"""
WITH h AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r AS MATERIALIZED (SELECT *, CASE {cases} END AS hit FROM h
), t0 AS (SELECT host, path, count(*) FILTER (hit LIKE '% allow') good, count(*) FILTER (hit LIKE '% block') bad,
  string_split(regexp_replace(path, '^/', ''), '/') AS parts, '' AS node FROM r GROUP BY host, path)
{levels}
, x AS MATERIALIZED ({ended}
), per AS (SELECT host, template, sum(good) good, sum(bad) bad, string_split(template, '/') nodes FROM x GROUP BY host, template
), ch AS MATERIALIZED (
  SELECT host, template, good, bad, k AS depth, host || ' ' || array_to_string(nodes[:k], '/') AS place FROM (SELECT *, unnest(range(1, len(nodes) + 1)) AS k FROM per)
), su AS (SELECT place, sum(good)::DOUBLE g, sum(bad)::DOUBLE b FROM ch GROUP BY place
), li AS (SELECT host, template, list({{'g': g, 'b': b, 'p': 0.0::DOUBLE}} ORDER BY depth) AS chain FROM ch JOIN su USING (place) GROUP BY host, template
), j AS (SELECT host, template, list_reduce(list_prepend({{'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'p': {PRIOR}::DOUBLE}}, chain),
  lambda x, y: {{'g': y.g, 'b': y.b, 'p': (y.g + {SMOOTHING}::DOUBLE * x.p) / (y.g + y.b + {SMOOTHING}::DOUBLE)}}).p AS purity FROM li)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(split_part(hit, ' ', 2), CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       template, purity
FROM r JOIN x USING (host, path) JOIN j USING (host, template)"""


@register("op9_url_filter", _sql())
def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), "page_id", "url", RULES)
