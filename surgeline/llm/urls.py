"""URL filter: rules on hosts and paths, and link-graph propagation for what no rule covers.

Trust spreads along host edges from hosts in proportion to their allowed pages
(personalised PageRank), distrust against them from hosts in proportion to their
blocked pages. Edges are absolute links, the domain above a host, and what relative
links name: sites that link to the same places are neighbours by way of these.
DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgeline.llm.shared import Scratch, maybe_broadcast

#: Share of a score that moves on; most turns, and the change (of all of both scores) under which they end.
DAMPING, TURNS, STILL = 0.85, 40, 0.03
#: Edges of a host or place that go to one task.
EDGES = 100_000
#: A host is blocked whose distrust is at least this share of its trust and distrust together.
THRESHOLD = 0.55

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s<>#][^\"'\s<>]*)"


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path of the column url; both empty for a null url or one without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, parts, 2))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Of (verdict, rule) pairs such as ("block", "net/es/"), the longest that fits a host, or a domain above it, and the start of the path: a struct (n, rule, says), or null. The rules go along as one literal map."""
    by_host: dict[str, list] = {}
    for says, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append({"n": len(rule), "rule": rule, "says": says, "start": slash + rest})
    table = F.from_json(F.lit(json.dumps(by_host)), "map<string,array<struct<n:int,rule:string,says:string,start:string>>>")
    labels = F.split(host, r"\.")
    hits = F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.try_element_at(table, F.array_join(F.slice(labels, i, F.size(labels)), "."))), lambda x: x.isNotNull()))
    return F.when(host != "", F.array_max(F.filter(hits, lambda h: path.startswith(h["start"]))))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) between hosts, and between them and what their relative links name (nodes that begin with a slash); the latter, and each host with the domain above it, both ways. pages (host, path, html)."""
    links = pages.where("html is not null and host <> ''").select("host", "path", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    far = F.translate(F.regexp_extract("to", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", 1), UPPER, LOWER)
    near = F.regexp_extract("to", r"^([^?#]*)", 1)
    near = F.when(near.startswith("/"), near).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract("path", "^(.*/)", 1), F.lit("")), F.lit("/")), near))
    scheme = F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    links = links.withColumn("dst", F.when(far != "", far).when(~scheme, near)).where("dst is not null").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("w"))
    back = links.where("dst like '/%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    hosts = links.where("dst not like '/%'").select(F.col("dst").alias("h")).union(pages.where("host <> ''").select("host")).distinct()
    above = hosts.where(F.size(F.split("h", r"\.")) > 2).select("h", F.regexp_replace("h", r"^[^.]*\.", "").alias("up"))
    both = above.select(F.col("h").alias("src"), F.col("up").alias("dst")).union(above.select("up", "h")).withColumn("w", F.lit(1.0))
    return links.union(back).union(both).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """seeds (host, good, bad) to (host, trust, distrust) over edges (src, dst, w): seeds are scaled to sum to 1, and turns end when arcs scores stand still."""
    arcs = edges.select("src", "dst", "w", F.lit(True).alias("ahead")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(False)))
    totals = scratch.table(arcs.groupBy("src", "ahead").agg(F.sum("w").alias("total"), F.count("*").alias("edges")))
    # a place that very many hosts name has its edges dealt out in parts, and its scores go to each of them
    hot = scratch.table(totals.groupBy("src").agg(F.ceil(F.max("edges") / EDGES).cast("int").alias("parts")).where("parts > 1"))
    some = maybe_broadcast(hot, 200_000)
    part = lambda: F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    arcs = arcs.join(some, "src", "left").select("src", "dst", "w", "ahead", part())
    totals = totals.join(some, "src", "left").select("src", "ahead", "total", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    flow = scratch.table(arcs.join(totals, ["src", "part", "ahead"]).select("src", "part", "dst", (F.col("w") / F.col("total") * DAMPING).alias("p"), "ahead"))
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first()
    start = scratch.table(seeds.select("host", (F.col("good") / (good or 1.0)).alias("good"), (F.col("bad") / (bad or 1.0)).alias("bad")))
    restart = start.select("host", *[(F.col(c) * (1 - DAMPING)).alias(c) for c in ("good", "bad")])
    now = start
    for _ in range(TURNS):
        spread = now.join(some, F.col("host") == F.col("src"), "left").select(F.col("host").alias("src"), "good", "bad", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        moved = flow.join(spread, ["src", "part"]).select(F.col("dst").alias("host"), F.when(F.col("ahead"), F.col("good") * F.col("p")).otherwise(0.0).alias("good"), F.when(F.col("ahead"), 0.0).otherwise(F.col("bad") * F.col("p")).alias("bad"))
        after = scratch.table(moved.union(restart).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        both = after.select("host", "good", "bad").union(now.select("host", -F.col("good"), -F.col("bad"))).groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        change = both.agg(F.sum(F.abs("g") + F.abs("b"))).first()[0] or 0.0
        if now is not start:
            scratch.drop(now)
        now = after
        if change < STILL:
            break
    return now.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """Judges every page's url: (page_id, host, path, rule, verdict, trust, distrust), a row for each row of pages.

    pages (page_id, url, html). verdict is allow or block: that of the longest
    fitting rule, else block where the host's distrust is at least the threshold's
    share of its trust and distrust, else allow. A null url, or one without ://, has an
    empty host and path, no rule and the verdict allow; so has a host that neither
    score reaches. A null html has no links. Repeated rows have equal results, and
    count as pages of their own where a host's judged pages are counted. Of rules of
    one length the last by name wins. An empty table gives no rows, and without rules
    every page is allowed. Other columns are not read; urls and html are read whole.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    split = split_url(pages.select("page_id", "url", "html"))
    fit = fitting(F.col("host"), F.col("path"), rules)
    marks = split.where("host <> ''").select("host", fit["says"].alias("says"))
    seeds = scratch.table(marks.groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("good"), F.count_if(F.col("says") == "block").alias("bad")).where("good + bad > 0"))
    scores = propagate(scratch.table(host_edges(split)), seeds, scratch)
    out = split.select("page_id", "host", "path", fit.alias("fit")).join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("fit.says", F.when((distrust > 0) & (distrust >= threshold * (trust + distrust)), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "fit.rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
