"""URL filters: rules, and link-graph propagation of trust and distrust for what no rule decides (operator 5).

Native: DataFrame functions only. A rule names a host (with its subdomains) and the start of a path; the longest rule
that fits a URL decides. For other URLs the host decides: trust spreads along host links by personalised PageRank from
hosts with allowed pages, distrust along reversed links from hosts with blocked pages. A seed's weight is the share of its
pages that rules allow (or block). Each mass is divided by that of a PageRank from all hosts over the same links, so a
host without links has just its own share; a host is blocked when its relative distrust is at least `threshold` and above
its relative trust.

Rows: a null URL, or one without "://", has an empty host and path and no rule, and its (empty) host has no links. Null
html has no links. Repeated rows count each time and are returned each time; extra columns are kept out of the result.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlParams:
    damping: float = 0.85
    iterations: int = 20
    threshold: float = 0.5
    write_every: int = 4
    broadcast_hosts: int = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _longest_first(rules: list[Rule]) -> list[Rule]:
    """Of rules of one length the first by name goes first."""
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def _decide(rules: list[Rule], host: Column, path: Column, value: str) -> Column:
    """The name or verdict of the longest fitting rule, else null."""
    result = F.lit(None).cast("string")
    for r in _longest_first(rules)[::-1]:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        result = F.when(fits, F.lit(getattr(r, value))).otherwise(result)
    return result


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and the number of pages of src that link to dst, between different hosts."""
    host, _ = host_and_path(F.col("url"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.select(host.alias("src"), F.explode(found).alias("dst")).where("src <> dst and src <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, links: DataFrame, p: UrlParams, scratch: Scratch) -> DataFrame:
    """hosts (host, trust, distrust: seed weights) with relative trust and distrust after propagation.

    Every step is a join of the masses with the links and a sum by host; each fourth step is written, to cut lineage. The
    steps end early where four of them have moved no mass at all.
    """
    seeds = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust")])).alias("x"))
    seeds = scratch.save(seeds.select("host", "x.kind", "x.seed"), "seeds")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    ahead = links.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    back = links.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    edges = scratch.save(ahead.unionByName(back), "edges")
    rest = 1 - p.damping
    masses = last = seeds.select("host", "kind", (F.col("seed") * rest).alias("x"), F.lit(rest).alias("base"))
    for i in range(p.iterations):
        moved = masses.join(edges, ["kind", "host"]).groupBy("kind", "to").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum(F.col("base") * F.col("w")).alias("base"))
        moved = moved.select("kind", F.col("to").alias("host"), F.col("x").alias("dx"), F.col("base").alias("db"))
        masses = seeds.join(moved, ["kind", "host"], "left").select(
            "host", "kind", (F.col("seed") * rest + p.damping * F.coalesce("dx", F.lit(0.0))).alias("x"), (F.lit(rest) + p.damping * F.coalesce("db", F.lit(0.0))).alias("base")
        )
        if i % p.write_every == p.write_every - 1:
            masses = scratch.save(masses, f"masses{i}")
            was = last.select("kind", "host", F.col("x").alias("x0"), F.col("base").alias("b0"))
            if masses.join(was, ["kind", "host"]).where("x <> x0 or base <> b0").isEmpty():
                break
            last = masses
    share = lambda k: F.sum(F.when(F.col("kind") == k, F.col("x") / F.col("base"))).alias(k)
    return masses.groupBy("host").agg(share("trust"), share("distrust"))


def url_filters(pages: DataFrame, rules: list[Rule], p: UrlParams = UrlParams(), scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict of every row of pages (page_id, url, html).

    Links and page counts are summed by host before anything else is shuffled, so one host with a third of all pages is
    one row. The pages themselves meet only the hosts that are to be blocked, broadcast when their counted number allows.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumns({"rule": _decide(rules, F.col("host"), F.col("path"), "name"), "ruled": _decide(rules, F.col("host"), F.col("path"), "verdict")})
    part = lambda v: (F.sum(F.when(F.col("ruled") == v, 1.0).otherwise(0.0)) / F.count("*"))
    own = judged.groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    links = scratch.save(host_links(pages), "links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = own.join(ends, "host", "full").fillna(0.0, ["trust", "distrust"])
    scores = spread(hosts, links, p, scratch)
    blocked = scores.where((F.col("distrust") >= p.threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("spread"))
    blocked = scratch.save(blocked, "blocked")
    blocked = F.broadcast(blocked) if blocked.count() <= p.broadcast_hosts else blocked
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))


def oracle(rules: list[Rule], p: UrlParams = UrlParams()) -> str:
    """DuckDB SQL for url_filters() over the view pages, the propagation unrolled."""
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = _longest_first(rules)
    case = lambda v: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, v)}'" for r in longest) + " END"
    low = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    link = LINK.replace("'", "''")
    steps = ["m0 AS (SELECT host, kind, seed * (1 - {d}) AS x, (1 - {d})::DOUBLE AS base FROM seeds)"]
    steps += [
        f"m{i + 1} AS MATERIALIZED (SELECT s.host, s.kind, seed * (1 - {{d}}) + {{d}} * coalesce(dx, 0) AS x, (1 - {{d}}) + {{d}} * coalesce(db, 0) AS base FROM seeds s LEFT JOIN"
        f" (SELECT kind, e.dst AS host, sum(x * w) AS dx, sum(base * w) AS db FROM m{i} JOIN edges e USING (kind, host) GROUP BY ALL) v USING (kind, host))"
        for i in range(p.iterations)
    ]
    chain = ",\n".join(steps).format(d=f"{p.damping}::DOUBLE")
    return f"""
WITH r AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {low} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
h2 AS (SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM h),
j AS (SELECT page_id, html, host, path, {case("name")} AS rule, {case("verdict")} AS ruled FROM h2),
own AS (SELECT host, avg((coalesce(ruled, '') = 'allow')::INT)::DOUBLE AS trust, avg((coalesce(ruled, '') = 'block')::INT)::DOUBLE AS distrust FROM j GROUP BY host),
found AS (SELECT DISTINCT page_id, host AS src, translate(u, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '{link}', 1)) AS u FROM j)),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND src <> '' GROUP BY ALL),
hosts AS (SELECT host, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM own FULL JOIN (SELECT src AS host FROM links UNION SELECT dst FROM links) USING (host)),
seeds AS (SELECT host, 'trust' AS kind, trust AS seed FROM hosts UNION ALL SELECT host, 'distrust', distrust FROM hosts),
edges AS (SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM links
          UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
{chain},
b AS (SELECT host FROM m{p.iterations} GROUP BY host
      HAVING sum(CASE WHEN kind = 'distrust' THEN x / base END) >= {p.threshold} AND sum(CASE WHEN kind = 'distrust' THEN x / base END) > sum(CASE WHEN kind = 'trust' THEN x / base END))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM b) THEN 'block' END, 'allow') AS verdict FROM j
"""
