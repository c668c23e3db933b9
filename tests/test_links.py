from pyspark.sql import functions as F

from pagemill.operators import frontier, links as K
from pagemill.operators.frontier import crawl_frontier
from pagemill.session import store_bucketed


def reasons(spark, rules, *urls, text="t"):
    df = spark.createDataFrame([(u, text) for u in urls], "url string, text string")
    return [r.reason for r in K.link_audit(df, rules).collect()]


def test_first_broken_rule_is_the_reason(spark):
    rules = K.LinkRules(
        allow=("ok",), deny=("bad",), allow_domains=("h.org",), deny_domains=("x.h.org",), restrict_text=("^t",)
    )
    urls = ["mailto:ok", "http://h.org/", "http://h.org/okbad", "http://k.org/ok", "http://x.h.org/ok",
            "http://h.org/ok.PNG", "http://a.h.org/ok.pdf"]
    want = ["scheme", "whitelist", "blacklist", "allow_domain", "deny_domain", "extension", None]
    assert reasons(spark, rules, *urls) == want
    assert reasons(spark, rules, "http://h.org/ok", text="no") == ["text"]


def test_empty_rules_allow_and_search_is_not_a_full_match(spark):
    assert reasons(spark, K.LinkRules(), "http://h/any") == [None]
    assert reasons(spark, K.LinkRules(deny=("ny$",)), "http://h/any") == ["blacklist"]


def test_domain_table_with_nulls(spark):
    urls = ["http://a.b.c/x", "http://b.c/", "http://xb.c/", "mailto:x", "http://q.R", None, "http://B.c/2"]
    links = spark.createDataFrame([(u,) for u in urls], "url string")
    domains = spark.createDataFrame([("b.c",), ("r",), ("B.C",), (None,)], "domain string")
    below = {"http://a.b.c/x", "http://b.c/", "http://q.R", "http://B.c/2"}
    assert {r.url for r in K.restrict_domains(links, domains, True).collect()} == below
    assert {r.url for r in K.restrict_domains(links, domains, False).collect()} == set(urls) - below
    none = domains.limit(0)
    assert K.restrict_domains(links, none, True).count() == 0 and K.restrict_domains(links, none, False).count() == 7


def test_robots_hosts_in_any_case(spark):
    rules = spark.createDataFrame([("A.org", False, "/de/")], "host string, allow boolean, prefix string")
    links = spark.createDataFrame([("http://a.ORG/de/1",), ("http://a.org/en",)], "url string")
    assert [r.url for r in K.robots_filter(links, rules).collect()] == ["http://a.org/en"]


def test_robots(spark):
    rules = spark.createDataFrame(
        [("h", False, "/d/"), ("h", True, "/d/1"), ("h", True, "/e"), ("h", False, "/e"), ("g", False, "/")],
        "host string, allow boolean, prefix string",
    )
    urls = ["http://h/d/2", "http://h/d/12", "http://h/e", "http://h", "http://g", "http://none/d/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in K.robots_filter(df, rules).collect()}
    assert got == {"http://h/d/12", "http://h/e", "http://h", "http://none/d/"}


def test_frontier_equals_breadth_first_search(spark, monkeypatch):
    n = 60
    url = lambda i: f"http://{'a.' if i % 2 else ''}{'s' if i % 5 else 'off'}.org/{i}"
    edges = [(i, (i * 7 + 3) % n) for i in range(n)] + [(i, (i * 11 + 5) % n) for i in range(n)]
    edges += [(0, i) for i in range(1, 40)] + [(3, 3), (3, 4), (3, 4)]
    links = spark.createDataFrame([(url(a), url(b) + "#x") for a, b in edges], "src_url string, url string")
    seeds = spark.createDataFrame(
        [("p", "s.org", url(2)), ("q", "s.org", url(2)), ("q", "s.org", url(4)), ("r", "off.org", url(0))],
        "spider string, domain string, url string",
    )
    starts = {"p": ("s.org", [2]), "q": ("s.org", [2, 4]), "r": ("off.org", [0])}
    want = set()
    for spider, (domain, layer) in starts.items():
        seen = set(layer)
        for depth in range(6):
            want |= {(spider, url(i), depth) for i in layer}
            layer = {
                b for a, b in edges if a in layer and b not in seen
                and (url(b).split("/")[2] == domain or url(b).split("/")[2].endswith("." + domain))
            }
            seen |= layer
    got = {(r.spider, r.key, r.depth) for r in crawl_frontier(seeds, links).collect()}
    assert got == want
    assert crawl_frontier(seeds, links, 1).agg(F.max("depth")).first()[0] == 1
    assert crawl_frontier(seeds, links, buckets=3).count() == len(want)
    monkeypatch.setattr(frontier, "PART_EDGES", 7)  # page 0 has its edges in several parts
    assert {(r.spider, r.key, r.depth) for r in crawl_frontier(seeds, links).collect()} == want


def test_frontier_of_several_specifications(spark):
    """Two specifications with one start URL are worked at once, each under its own key."""
    links = spark.createDataFrame([("http://h/", "http://h/a"), ("http://a.h/", "http://h/b")], "src_url string, url string")
    seeds = spark.createDataFrame(
        [("x", "h", "h", "http://h/"), ("y", "h", "h", "http://h/"), ("y", "h", "h", "http://a.h/")], "spec string, spider string, domain string, url string"
    )
    got = {(r.spec, r.key, r.depth) for r in crawl_frontier(seeds, links, keys=("spec", "spider")).collect()}
    assert got == {("x", "http://h/", 0), ("x", "http://h/a", 1), ("y", "http://h/", 0), ("y", "http://h/a", 1), ("y", "http://a.h/", 0), ("y", "http://h/b", 1)}


def test_frontier_rounds_move_only_their_delta(spark):
    """With no side small enough to broadcast, edges and visited keys are read where they lie, and nothing stays behind."""
    links = spark.range(2000).selectExpr("concat('http://h/', id % 50) as src_url", "concat('http://h/', id) as url")
    seeds = spark.createDataFrame([("p", "h", "http://h/1")], "spider string, domain string, url string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = store_bucketed(frontier.link_edges(links).withColumn("part", F.lit(0).cast("long")), "edges", ["src", "part"], n)
    rows = seeds.selectExpr("spider", "domain", "url as key")
    layers = [store_bucketed(rows, "layer", ["spider", "key"], n) for _ in range(2)]
    parts = spark.createDataFrame([], "src string, parts long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frontier.next_layer([t.rows for t in layers], edges.rows, parts, ["spider"])
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [k for k, line in enumerate(plan.split("\n")) if "FileScan" in line]
    lines = plan.split("\n")

    def dealt(at):
        """Whether the scan in this line is below an exchange of its own join side."""
        depth = lines[at].index("FileScan")
        for line in reversed(lines[:at]):
            place = len(line) - len(line.lstrip(" :+-"))
            if place >= depth:
                continue
            depth = place
            if "Exchange" in line:
                return True
            if "SortMergeJoin" in line:
                return False
        return False

    by_name = {lines[k]: dealt(k) for k in scans}
    assert sum("pagemill_edges" in x for x in by_name) == 1
    assert not [x for x, moved in by_name.items() if "pagemill_edges" in x and moved]
    visited = [moved for x, moved in by_name.items() if "pagemill_layer" in x]
    assert visited.count(False) == 2 and visited.count(True) == 1  # the last layer is asked once as the delta
    before = {t.name for t in spark.catalog.listTables()}
    assert df.count() > 0
    assert crawl_frontier(seeds, links).count() > 1
    assert {t.name for t in spark.catalog.listTables()} == before
    for t in (edges, *layers):
        t.drop()


def test_frontier_obeys_robots(spark):
    links = spark.createDataFrame(
        [("http://h/", "http://h/a"), ("http://h/a", "http://h/b"), ("http://h/", "http://h/d/x")],
        "src_url string, url string",
    )
    seeds = spark.createDataFrame(
        [("p", "h", "http://h/"), ("q", "h", "http://h/d/")], "spider string, domain string, url string"
    )
    rules = spark.createDataFrame([("h", False, "/d/")], "host string, allow boolean, prefix string")
    got = sorted((r.spider, r.key, r.depth) for r in crawl_frontier(seeds, links, robots=rules).collect())
    assert got == [("p", "http://h/", 0), ("p", "http://h/a", 1), ("p", "http://h/b", 2)]


def test_robots_wildcards(spark):
    rules = [("h", False, "/*.gif$"), ("h", True, "/pub/*.gif$"), ("h", False, "/a*b*c"), ("h", False, "/q?x=*"), ("h", True, "/q?x=1$"),
             ("h", False, "/d$"), ("h", False, ""), ("h", None, "/n"), (None, False, "/"), ("h", False, "/e\\E(*"), ("h", False, "/t"), ("h", True, "/t*")]
    gone = ["/x.gif", "/y/z.gif", "/a/b/c/d", "/abc", "/q?x=2", "/q?x=12", "/d", "/e\\E(z"]
    stay = ["/x.gif?v=1", "/pub/x.gif", "/acb", "/q?x=1", "/d/", "/n", "/e", "/e\\Ez", "/t1", "", "/A/b/c"]
    urls = spark.createDataFrame([(f"http://h{p}",) for p in gone + stay] + [(None,), ("mailto:x",)], "url string")
    table = spark.createDataFrame(rules, "host string, allow boolean, prefix string")
    assert {r.url for r in K.robots_filter(urls, table).collect()} == {f"http://h{p}" for p in stay} | {None, "mailto:x"}
    assert K.robots_filter(urls, table.limit(0)).count() == urls.count()


def test_patterns_of_a_list_do_not_break_each_other(spark):
    lists = {
        "names": (["(?<y>abc)", "(?<y>zzz)"], {"http://h/abc", "http://h/zzz"}),
        "quotes": (["\\Qzzz", "abc"], {"http://h/abc", "http://h/zzz"}),
        "back": (["(z)\\1\\1", "(a)(b)c"], {"http://h/abc", "http://h/zzz"}),
        "words": (["ab.$", "(?i)OTHER"], {"http://h/abc", "http://h/other"}),
    }
    specs = spark.createDataFrame([(k, w, []) for k, (w, _) in lists.items()], "name string, whitelist array<string>, blacklist array<string>")
    urls = ["http://h/abc", "http://h/zzz", "http://h/other"]
    found = spark.createDataFrame([(k, u, "t") for k in lists for u in urls], "spec string, url string, text string")
    got = {(r.spec, r.url) for r in K.regex_rule_join(found, specs).where("reason is null").collect()}
    assert got == {(k, u) for k, (_, kept) in lists.items() for u in kept}


def test_domains_read_their_links_once(spark, sf_dir):
    """One scan with HTML: the links are stored before their hosts are looked up."""
    found = K.extract_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    domains = spark.createDataFrame([("example.com",)], "domain string")
    kept = K.allow_deny_domains(found, domains, spark.createDataFrame([("blog.example.com",)], "domain string"))
    assert "html" not in kept._jdf.queryExecution().executedPlan().toString()
    hosts = {r.url.split("/")[2] for r in kept.select("url").distinct().collect()}
    assert hosts and all(h == "example.com" or h.endswith(".example.com") for h in hosts) and not [h for h in hosts if h.endswith("blog.example.com")]
