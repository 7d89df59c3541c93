"""URL filter by a tree of path templates, in DataFrame functions only.

Rules (host, path, verdict) decide where one fits: the rule's host is the url's or one of its parent domains and the
url's path starts with the rule's; the longest fitting rule wins. All other urls are judged by templates learned per
host from labelled urls:

1. The path's segments (those that aren't empty) are a branch of the host's tree. Level by level a segment becomes a
   wildcard if it has a digit or holds less than ``SHARE`` of the urls below its parent, at any depth. There are as
   many rounds as levels at which different paths of a host share a template; what is below takes no more.
2. Branches with the same parent template are alike if their share of bad labels lies within ``Z`` standard errors of
   the parent's; alike branches are merged and share their labels. A branch without labels merges with none.
3. A template's purity is its share of bad labels, smoothed by ``PRIOR`` labels of either kind in equal parts; from
   ``PURITY`` on its urls are blocked.

The tree is grown on distinct (host, path) rows with counts, so a hot host or path is pre-aggregated before any
shuffle; the result is joined back on (host, path), where Spark splits a hot key.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; repeated rows get
equal results; without labels nothing but the rules blocks; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semilog.llm.common import materialise

SHARE, Z, PRIOR, PURITY = 0.1, 1.96, 4.0, 0.8
#: (rule, verdict) of the query, in the order in which the contract names them.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, or null; of equally long ones the first."""
    fits = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = rule.partition("/")
        ok = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        fits = F.when(ok, rule) if fits is None else fits.when(ok, rule)
    return F.lit(None).cast("string") if fits is None else fits


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, labelled, bad; a row for each host and path) with ``parent`` and ``template``."""
    has_digit = lambda c: F.translate(c, "0123456789", "") != c
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = paths.select("*", F.lit("").alias("parent"), F.lit("").alias("template"), segments.alias("_rest"))
    done = []
    while True:
        ended = F.size("_rest") == 0
        done.append(rows.where(ended).drop("_rest"))
        rows = rows.where(~ended)
        if rows.isEmpty():
            return functools.reduce(DataFrame.union, done)
        rows = rows.withColumn("_segment", F.col("_rest")[0])
        held = rows.groupBy("host", "template", "_segment").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
        total = held.groupBy("host", "template").agg(F.sum("_n").alias("_all"), F.sum("_k").alias("_paths"))
        wild = has_digit(F.col("_segment")) | (F.col("_n") < SHARE * F.col("_all"))
        named = held.join(total, ["host", "template"]).select("host", "template", "_segment", F.when(wild, "*").otherwise(F.col("_segment")).alias("_name"), (F.col("_paths") == 1).alias("_alone"))
        # A path alone in its branch holds all of the branch's urls at every level below, so it ends here.
        names = F.transform("_rest", lambda s: F.when(has_digit(s), "*").otherwise(s))
        joined = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("/"), F.array_join(c, "/"))).otherwise("")
        alone = F.col("_alone")
        rows = rows.join(named, ["host", "template", "_segment"]).select(
            *paths.columns,
            F.when(alone, F.concat("template", joined(F.slice(names, 1, F.size("_rest") - 1)))).otherwise(F.col("template")).alias("parent"),
            F.when(alone, F.concat("template", joined(names))).otherwise(F.concat("template", F.lit("/"), "_name")).alias("template"),
            F.when(alone, F.slice("_rest", 1, 0)).otherwise(F.slice("_rest", 2, F.size("_rest"))).alias("_rest"),
        )
        rows = materialise(rows, f"level-{len(done)}")  # each level reads the last one three times


def purities(rows: DataFrame) -> DataFrame:
    """(host, parent, template, purity) from the rows of ``templates``."""
    own = rows.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    parent = own.groupBy("host", "parent").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
    share = F.when(F.col("_l") > 0, F.col("_b") / F.col("_l")).otherwise(0.0)
    rate = F.when(F.col("labelled") > 0, F.col("bad") / F.col("labelled")).otherwise(0.0)
    alike = (F.col("labelled") > 0) & (F.abs(rate - share) <= Z * F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1))))
    marked = own.join(parent, ["host", "parent"]).withColumn("alike", alike)
    merged = marked.where("alike").groupBy("host", "parent").agg(F.sum("labelled").alias("_ml"), F.sum("bad").alias("_mb"))
    both = marked.join(merged, ["host", "parent"], "left")
    labelled = F.when(F.col("alike"), F.col("_ml")).otherwise(F.col("labelled"))
    bad = F.when(F.col("alike"), F.col("_mb")).otherwise(F.col("bad"))
    return both.select("host", "parent", "template", ((bad + PRIOR / 2) / (labelled + PRIOR)).alias("purity"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label: Column | None = None) -> DataFrame:
    """Per row: id, host, path, rule, template, purity and verdict.

    ``label`` is 1 for bad urls, 0 for good ones and null for others; left out, urls that a rule decides are labelled
    by it.
    """
    verdicts = dict(rules)
    blocks = [r for r, v in rules if v == "block"]
    host, path = host_and_path(F.col(url_col))
    by_rule = F.when(F.col("rule").isNull(), None).when(F.col("rule").isin(blocks), 1).otherwise(0)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), *([] if label is None else [label.cast("int").alias("label")]))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows if label is not None else rows.withColumn("label", by_rule)
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    placed = templates(materialise(paths, "paths"))
    told = placed.join(purities(placed), ["host", "parent", "template"]).select("host", "path", "template", "purity")
    decided = functools.reduce(lambda c, r: c.when(F.col("rule") == r, verdicts[r]), verdicts, F.when(F.lit(False), ""))
    by_template = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return rows.join(told, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "template", "purity", decided.otherwise(by_template).alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template")


def oracle() -> str:
    """The report in DuckDB's SQL, over the view ``pages``."""
    when = " ".join(f"when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then '{r}'" for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
    blocks = ", ".join(f"'{r}'" for r, v in RULES if v == "block")
    return f"""with recursive rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
 hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
 split as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
 ruled as (select *, case {when} end as rule from split),
 labelled as (select *, case when rule is null then null when rule in ({blocks}) then 1 else 0 end as label from ruled),
 grown as (select host, path, count(*) as n, count(label) as labelled, coalesce(sum(label), 0) as bad, '' as parent, '' as template, list_filter(string_split(path, '/'), lambda s: s <> '') as rest from labelled group by host, path
  union all select host, path, n, labelled, bad, template, template || '/' || case when translate(rest[1], '0123456789', '') <> rest[1]
    or sum(n) over (partition by host, template, rest[1]) < {SHARE} * sum(n) over (partition by host, template) then '*' else rest[1] end, rest[2:] from grown where len(rest) > 0),
 deep as (select * from grown where len(rest) = 0),
 own as (select host, parent, template, sum(labelled) as labelled, sum(bad) as bad from deep group by all),
 shares as (select *, sum(labelled) over w as l, sum(bad) over w as b from own window w as (partition by host, parent)),
 alike as (select *, labelled > 0 and abs(bad / labelled - b / l) <= {Z} * sqrt((b / l) * (1 - b / l) / labelled) as alike from shares),
 purity as (select host, parent, template, case when alike then (sum(case when alike then bad end) over w + {PRIOR / 2}) / (sum(case when alike then labelled end) over w + {PRIOR})
   else (bad + {PRIOR / 2}) / (labelled + {PRIOR}) end as purity from alike window w as (partition by host, parent))
select r.page_id, r.host, r.path, r.rule, d.template,
 case when r.rule in ({blocks}) then 'block' when r.rule is not null then 'allow' when p.purity >= {PURITY} then 'block' else 'allow' end as verdict
from labelled r join deep d on r.host = d.host and r.path = d.path join purity p on p.host = d.host and p.parent = d.parent and p.template = d.template"""
