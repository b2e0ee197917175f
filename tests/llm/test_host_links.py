"""Links between hosts are those that pages contain, and verdicts follow from them alone."""

import re
from collections import Counter

from kelpworks.llm import url_filter

HREF = re.compile(r"\bhref\s*=\s*[\"']?((?:https?:)?//[^/?#\"'\s>]+|/(?!/))", re.I)


def links(rows):
    """Counter of (host, host) by a loop over the pages."""
    out = Counter()
    for _, url, html in rows:
        host = re.split(r"[/?#]", (url or "").partition("://")[2])[0].lower()
        for found in HREF.findall(html or ""):
            out[host, host if found == "/" else found.partition("//")[2].lower()] += host != ""
    return {k: n for k, n in out.items() if n}


def test_links_agree_with_a_loop_over_pages(spark, sf_dir):
    own = [(1, "http://A.b.co.uk/x", '<a href="/y"><a HREF=//c.d/e><a href="//c.d"><a href="https://a.b.co.uk/">'), (2, None, '<a href="/">'), (3, "http://e.f", None), (4, "no", '<a href="//x.y">')]
    frame = spark.createDataFrame(own, "page_id long, url string, html string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    for df in (frame, pages):
        got = {(r.a, r.b): r.n for r in url_filter.host_links(df).where("n > 0").collect()}
        assert got == links(df.collect())


def test_hosts_of_one_domain_are_strangers(spark):
    rules = {"a.blogspot.com/": "block", "good.co.uk/": "allow"}
    pages = [(1, "http://a.blogspot.com/1", ""), (2, "http://b.blogspot.com/1", ""), (3, "http://c.blogspot.com/1", '<a href="http://a.blogspot.com/">'), (4, "http://bad.co.uk/", '<a href="//a.blogspot.com">'), (5, "http://blogspot.com/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert found == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_verdicts_agree_with_ranks_of_a_loop(spark, sf_dir):
    """Both ranks by a dense iteration over the loop's links, for the whole table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = url_filter.op9_url_filter(spark, sf_dir).collect()
    told = lambda r: url_filter.RULES.get(r.rule)
    seeds = {v: Counter(r.host for r in found if r.host and told(r) == v) for v in ("allow", "block")}
    between = links(pages.collect())
    ranks = {}
    for verdict, flip in (("allow", False), ("block", True)):
        into = {(b, a) if flip else (a, b): n for (a, b), n in between.items()}
        out, total = Counter(), sum(seeds[verdict].values()) or 1
        for (a, _), n in into.items():
            out[a] += n
        rank = {h: 0.0 for h in {r.host for r in found} | {h for k in into for h in k}}
        for _ in range(400):
            new = {h: 0.15 * seeds[verdict][h] / total + (0 if out[h] else 0.85 * rank[h]) for h in rank}
            for (a, b), n in into.items():
                new[b] += 0.85 * rank[a] * n / out[a]
            rank = new
        ranks[verdict] = rank
    for r in found:
        spread = "block" if ranks["block"].get(r.host, 0) > ranks["allow"].get(r.host, 0) and r.host else "allow"
        assert r.verdict == (told(r) or spread), r
