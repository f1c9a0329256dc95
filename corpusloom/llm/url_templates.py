"""URL filter by a path-template tree, in DataFrame operations only.

Explicit rules (host, path) come first: a rule fits its host and all subdomains if the path starts with the rule's; the
longest wins. Pages that a rule fits are the labelled ones. All other pages are judged by templates:

* per host, the path's segments form a tree, level by level; under each node a segment that is not well supported
  (fewer than MIN_COUNT pages or a MIN_SHARE-th of the node's) is variable and becomes a wildcard, whose pages share
  one subtree;
* supported branches with labels, ordered by their smoothed share of blocked labels, are merged with the next one
  unless the two shares differ significantly (Z2, the squared score of two proportions). A branch without labels is
  like no other and stays by itself;
* a template is rejected if it has MIN_LABELS labels of its own or more, and its purity is BLOCK_FROM or more: the
  share of blocked labels, smoothed towards that of the same template over all hosts, which is smoothed towards even
  odds. A template without that evidence is allowed.

Pages are first summed by host and path; only sums are shuffled and joined, with partial sums before each shuffle; hot
hosts and paths are joined by broadcast (common.join_unique). The tree goes as deep as some node has MIN_COUNT pages;
paths that end, or whose node has fewer, are finished and not read again. Each level is written to the shared folder,
so that the plan does not double with every level.

Edge cases: a null url or one without "://" has an empty host and path, which is a host like any other; a path without
segments has the empty template; empty segments are skipped; *, {, | and } in a segment read %2A, %7B, %7C and %7D;
without any label unmatched pages are allowed; repeated rows and ids are judged row by row; ties of rule length go to
the first rule given; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, join_unique, materialise, table

#: (verdict, host, path) of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIN_COUNT = 3
MIN_SHARE = 20
Z2 = 3.84
SMOOTH = 4.0
MIN_LABELS = 3
BLOCK_FROM = 0.55
#: A rule is an expression in the plan; longer lists would need a join.
MAX_RULES = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Verdict and rule, as a struct, of the longest rule that fits; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _safe(seg: Column) -> Column:
    for c, code in (("*", "%2A"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D")):
        seg = F.replace(seg, F.lit(c), F.lit(code))
    return seg


def branches(rows: DataFrame) -> DataFrame:
    """Name of every supported segment under its node (host, template): itself, or {a|b} of the branches it merges with."""
    child = rows.groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "nl", "nb")))
    node = child.groupBy("host", "template").agg(F.sum("n").alias("tn"))
    child = join_unique(child.where(F.col("n") >= MIN_COUNT), node, ["host", "template"]).where(F.col("n") * MIN_SHARE >= F.col("tn"))
    # at most MIN_SHARE rows a node from here on
    child = child.withColumn("own", (F.col("nb") + 1) / (F.col("nl") + 2)).withColumn("judged", F.col("nl") > 0)
    order = Window.partitionBy("host", "template", "judged").orderBy("own", "seg")
    both = (F.col("nb") + F.lag("nb").over(order) + 2) / (F.col("nl") + F.lag("nl").over(order) + 4)
    spread = both * (1 - both) * (1 / (F.col("nl") + 2) + 1 / (F.lag("nl").over(order) + 2))
    step = F.col("own") - F.lag("own").over(order)
    apart = ~F.col("judged") | F.coalesce(step * step >= Z2 * spread, F.lit(False))
    child = child.withColumn("apart", apart.cast("int")).withColumn("kin", F.sum("apart").over(order))
    merged = Window.partitionBy("host", "template", "judged", "kin")
    names = F.array_sort(F.collect_list(_safe(F.col("seg"))).over(merged))
    name = F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(names, "|"), F.lit("}")))
    return child.select("host", "template", "seg", name.alias("name"))


def templates(paths: DataFrame) -> DataFrame:
    """Template of each (host, segs) row with its sums n, nl (labelled) and nb (of these, blocked)."""
    rows = materialise(paths.withColumn("template", F.lit("")), "paths")
    done, level = rows.where(F.size("segs") == 0).select("host", "segs", "n", "nl", "nb", "template"), 0
    rows = rows.where(F.size("segs") > 0)
    read = [rows]
    while True:
        # a node of fewer pages has no supported branch below: what is left of its paths is variable
        node = rows.groupBy("host", "template").agg(F.sum("n").alias("tn"))
        large = node.where(F.col("tn") >= MIN_COUNT).select("host", "template", F.lit(True).alias("open"))
        marked = materialise(join_unique(rows, large, ["host", "template"], "left"), "nodes")
        read.append(marked)
        rest = F.concat("template", F.repeat(F.lit("/*"), F.size("segs") - level))
        done = done.unionByName(marked.where("open is null").select("host", "segs", "n", "nl", "nb", rest.alias("template")))
        rows = marked.where("open").drop("open")
        if rows.isEmpty():
            break
        rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
        named = materialise(branches(rows), "branches")
        rows = join_unique(rows, named, ["host", "template", "seg"], "left")
        rows = materialise(rows.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).drop("seg", "name"), "level")
        delete(named)
        read.append(rows)
        level += 1
        done = done.unionByName(rows.where(F.size("segs") == level))
        rows = rows.where(F.size("segs") > level)
    tree = materialise(done, "tree")
    for df in read:
        delete(df)
    return tree


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (smoothed share of blocked labels) of every row."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = first_rule(F.col("host"), F.col("path"), rules)
    segs = F.filter(F.split("path", "/", -1), lambda x: x != "")
    rows = rows.withColumn("found", found).withColumn("segs", segs)
    tree = templates(rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("found").alias("nl"), F.sum(F.when(F.col("found.verdict") == "block", 1).otherwise(0)).alias("nb")))
    local = tree.groupBy("host", "template").agg(F.sum("nl").alias("nl"), F.sum("nb").alias("nb"))
    shared = local.groupBy("template").agg(F.sum("nl").alias("gl"), F.sum("nb").alias("gb"))
    wide = (F.col("gb") + SMOOTH / 2) / (F.col("gl") + SMOOTH)
    purity = (F.col("nb") + SMOOTH * wide) / (F.col("nl") + SMOOTH)
    rejected = (F.col("nl") >= MIN_LABELS) & (purity >= BLOCK_FROM)
    shares = join_unique(local, shared, ["template"]).select("host", "template", purity.alias("purity"), rejected.alias("rejected"))
    known = materialise(join_unique(tree.select("host", "segs", "template"), shares, ["host", "template"]), "known")
    delete(tree)
    out = join_unique(rows, known, ["host", "segs"])
    verdict = F.coalesce("found.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for op2: the tree is a recursion over whole paths, whatever their depth."""
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ordered = sorted(rules, key=lambda r: -(len(r[1]) + len(r[2])))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in ordered) + " end"
    named = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered) + " end"
    safe = "replace(replace(replace(replace(seg, '*', '%2A'), '{', '%7B'), '|', '%7C'), '}', '%7D')"
    return f"""
with recursive u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
p as (select *, {rule} as rule, {named} as named, list_filter(string_split(path, '/'), lambda x: x <> '') as segs from h),
t as (
  select 0 as d, host, segs, count(*) as n, count(rule) as nl, count(*) filter (named = 'block') as nb, '' as template from p group by host, segs
  union all
  select * from (
    with r as (select *, segs[d + 1] as seg from t where len(segs) > d),
    c as (select host, template, seg, sum(n) as n, sum(nl) as nl, sum(nb) as nb from r group by all),
    s as (select *, (nb + 1)::double / (nl + 2) as own, nl > 0 as judged from (select *, sum(n) over (partition by host, template) as tn from c) where n >= {MIN_COUNT} and n * {MIN_SHARE} >= tn),
    g as (select *, lag(nb) over w as pb, lag(nl) over w as pl, lag(own) over w as po from s window w as (partition by host, template, judged order by own, seg)),
    a as (select *, case when not judged or coalesce((own - po) * (own - po) >= {Z2}::double * (((nb + pb + 2)::double / (nl + pl + 4)) * (1 - (nb + pb + 2)::double / (nl + pl + 4)) * (1::double / (nl + 2) + 1::double / (pl + 2))), false) then 1 else 0 end as apart from g),
    k as (select *, sum(apart) over (partition by host, template, judged order by own, seg) as kin from a),
    m as (select host, template, judged, kin, case when count(*) = 1 then min({safe}) else '{{' || string_agg({safe}, '|' order by {safe}) || '}}' end as name from k group by host, template, judged, kin)
    select r.d + 1, r.host, r.segs, r.n, r.nl, r.nb, r.template || '/' || coalesce(m.name, '*')
    from r left join k on r.host = k.host and r.template = k.template and r.seg = k.seg
      left join m on k.host = m.host and k.template = m.template and k.judged = m.judged and k.kin = m.kin)),
f as (select * from t where len(segs) = d),
l as (select host, template, sum(nl) as nl, sum(nb) as nb from f group by host, template),
g as (select template, sum(nl) as gl, sum(nb) as gb from l group by template),
s as (select l.host, l.template, l.nl, (l.nb + {SMOOTH}::double * ((g.gb + {SMOOTH / 2}::double) / (g.gl + {SMOOTH}::double))) / (l.nl + {SMOOTH}::double) as purity from l join g on l.template = g.template)
select p.page_id, p.host, p.path, p.rule, coalesce(p.named, case when s.nl >= {MIN_LABELS} and s.purity >= {BLOCK_FROM}::double then 'block' else 'allow' end) as verdict, f.template
from p join f on p.host = f.host and p.segs = f.segs join s on f.host = s.host and f.template = s.template"""


ORACLE = oracle()
