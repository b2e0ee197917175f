"""URL filter: rules where they fit, else trust and distrust that spread over the link graph of hosts.

Hosts are linked by the pages' absolute links and by their relative ones (a host to itself), and by nothing else: hosts
that share a domain are strangers unless a page links them. Trust is a personalised PageRank from hosts in proportion to their pages
that a rule allows, along the links; distrust one from those that a rule blocks, against the links. A host's pages
without a rule are blocked where its distrust is above its trust times `ratio`.

Links are counted per pair of hosts before anything is joined; each few rounds the ranks are stored. Rounds go on until
every host's ranks are stable in proportion to themselves, so that the verdict of a small or far host is as sure as that
of a large one, and does not depend on the number of hosts.

Defined results: a null url, or one without ://, has an empty host and path, no rule and the verdict allow, as has a
host that neither kind reaches; a null page text has no links; repeated rows get the same result; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpworks.llm.shared import BROADCAST_KEYS, stored, table

#: The contract's rules, as verdicts by rule.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*+=\s*+[\"']?+(?:https?:)?//([^/?#\"'\s>]++)"
#: Ranks below are at the end of what a double holds exactly and settle no round.
LEAST = 1e-300
INNER = r"(?i)\bhref\s*+=\s*+[\"']?+/(?!/)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tried first
        domain, _, below = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{below}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b, n: links between hosts that pages contain, those within a host included."""
    host, _ = parts(F.col(url))
    whole = F.coalesce(F.col(html), F.lit(""))
    out = pages.select(host.alias("a"), F.transform(F.regexp_extract_all(whole, F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)).alias("to"), F.regexp_count(whole, F.lit(INNER)).alias("own")).where("a != ''")
    outer = out.select("a", F.explode("to").alias("b"), F.lit(1).cast("long").alias("n"))
    inner = out.select("a", F.col("a").alias("b"), F.col("own").cast("long").alias("n"))
    return outer.unionByName(inner).groupBy("a", "b").agg(F.sum("n").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, close: float = 1e-6, most: int | None = None, kept: int = 4) -> DataFrame:
    """host, trust, distrust: seeds has host, good and bad (counts). A host without links keeps its mass.

    Rounds start from nothing, so ranks only grow, and end when no host, however small its rank, grew by more than `close`
    of it: a host just reached grows from 0, so mass on its way to further hosts keeps the rounds going. A host's links to
    itself are solved for and not iterated. `most` caps the rounds; the default does not.
    """
    links = links.where("n > 0")
    links = stored(links, "links")
    hosts = links.select(F.explode(F.array("a", "b")).alias("host")).unionByName(seeds.select("host")).distinct()
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    of = lambda c, t: (F.coalesce(F.col(c), F.lit(0)) / F.lit(float(t or 1))).alias(c)
    base = stored(hosts.join(seeds, "host", "left").select("host", of("good", total["g"]), of("bad", total["b"])), "seeds")
    out, into = links.groupBy("a").agg(F.sum("n").alias("s")), links.groupBy("b").agg(F.sum("n").alias("s"))
    idle = lambda side, s, col: base.select("host").join(side.select(F.col(s).alias("host")), "host", "left_anti").select(F.col("host").alias("x"), F.col("host").alias("y"), *(F.lit(1.0 if c == col else 0.0).alias(c) for c in ("t", "d")))
    forth = links.join(out, "a").select(F.col("a").alias("x"), F.col("b").alias("y"), (F.col("n") / F.col("s")).alias("t"), F.lit(0.0).alias("d"))
    back = links.join(into, "b").select(F.col("b").alias("x"), F.col("a").alias("y"), F.lit(0.0).alias("t"), (F.col("n") / F.col("s")).alias("d"))
    flows = reduce(DataFrame.unionByName, [forth, back, idle(out, "a", "t"), idle(into, "b", "d")])
    flows = stored(flows.groupBy("x", "y").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "flows")
    own = flows.where("x = y").select(F.col("x").alias("host"), F.col("t").alias("own_t"), F.col("d").alias("own_d"))
    alone = lambda c: (1 - damping * F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    base = stored(base.join(own, "host", "left").select("host", "good", "bad", alone("own_t"), alone("own_d")), "base")
    flows = flows.where("x != y")
    ranks = last = base.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    turn = 0
    while most is None or turn < most:
        turn += 1
        came = flows.join(ranks, F.col("x") == F.col("host")).groupBy("y").agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        step = lambda seed, c: (((1 - damping) * F.col(seed) + damping * F.coalesce(F.col(c), F.lit(0.0))) / F.col(f"own_{c}"))
        ranks = base.join(came, F.col("host") == F.col("y"), "left").select("host", step("good", "t").alias("trust"), step("bad", "d").alias("distrust"))
        if turn % kept:
            continue
        ranks, before = stored(ranks, "ranks"), last  # compared with what was stored last, so that plans stay short
        last = ranks
        grew = lambda now, was: (F.col(now) - F.col(was) > close * F.col(was)) & (F.col(now) > LEAST)
        if ranks.join(before.select("host", F.col("trust").alias("p"), F.col("distrust").alias("q")), "host").where(grew("trust", "p") | grew("distrust", "q")).isEmpty():
            break
    return ranks


def filter_urls(pages: DataFrame, rules: dict[str, str], page_id: str = "page_id", url: str = "url", html: str = "html", ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (0 where nothing reaches it)."""
    host, path = parts(F.col(url))
    at = pages.select(F.col(page_id), host.alias("host"), path.alias("path")).withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    at = at.withColumn("told", by_rule)
    count = lambda v: F.sum(F.when(F.col("told") == v, 1).otherwise(0))
    seeds = stored(at.where("host != ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad")), "hosts")
    ranks = spread(host_links(pages, url, html), seeds)
    known = seeds.select("host").join(ranks, "host")
    known = stored(known, "known")
    if known.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    found = at.join(known, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("told", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow"))
    return found.select(page_id, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url of pages."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
