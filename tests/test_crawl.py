"""Crawls of a small site against the visits written down by hand."""

import pytest
from pyspark.sql import functions as F

from mdforge.operators import combine as CB
from mdforge.operators import crawl as CR
from mdforge.plans.read_pages import read_pages
from mdforge.sources.captures import classify_responses

FILL = "<p>" + "filler words " * 8 + "</p>"


def page(links):
    anchors = " ".join(f'<a href="{h}">{t}</a>' for t, h in links)
    return f"<html><body><article><h1>T</h1>{FILL}<p>{anchors}</p></article></body></html>"


SITE = {
    "http://s.com/a": page([("b", "/b"), ("c", "/c"), ("ext", "http://other.com/x")]),
    "http://s.com/b": page([("d", "/d"), ("a", "/a")]),
    "http://s.com/c": page([("d", "/d"), ("e", "/e#frag"), ("e2", "/e")]),
    "http://s.com/d": page([]),
    "http://s.com/e": page([("bad", "/bad")]),
    "http://s.com/bad": page([("loop", "http://127.0.0.1/")]),
    "http://other.com/x": page([("a", "http://s.com/a")]),
    "http://s.com/empty": "   ",
}
HOSTS = [("s.com", "93.184.216.34", 4, 0), ("other.com", "8.8.8.8", 4, 0)]


@pytest.fixture(scope="module")
def site(spark):
    caps = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id long, url string, html string")
    ha = spark.createDataFrame(HOSTS, "host string, address string, family int, pos int")
    return caps, ha


A, B, C, D, E, X = ("http://s.com/a", "http://s.com/b", "http://s.com/c", "http://s.com/d", "http://s.com/e", "http://other.com/x")


@pytest.mark.parametrize(
    ("seed", "max_pages", "same", "pages"),
    [
        (A, 3, True, [A, B, C]),  # the link to another origin is passed over
        (A, 5, False, [A, B, C, X, D]),  # b's links after a's, c's d is known by then
        (C, 10, True, [C, D, "http://s.com/e#frag", E, "http://s.com/bad"]),  # visited by spelling
        (A, 1, True, [A]),
        ("http://s.com/empty", 3, True, ["http://s.com/empty"]),
    ],
)
def test_crawl_budget_visits_in_order(spark, site, seed, max_pages, same, pages):
    caps, ha = site
    seeds = spark.createDataFrame([(seed,), (seed,)], "seed string")  # a repeated seed is one read
    got = CR.crawl_budget(seeds, caps, ha, max_pages=max_pages, same_origin_only=same).orderBy("ord").collect()
    assert [r.request_url for r in got] == pages and [r.ord for r in got] == list(range(1, len(pages) + 1))
    assert all(r.seed_error is None for r in got)


def test_refused_page_aborts_the_read(spark, site):
    caps, ha = site
    seeds = spark.createDataFrame([(A,), (B,)], "seed string")
    got = CR.crawl_budget(seeds, caps, ha, max_pages=10, same_origin_only=False)
    rows = [r for r in got.collect() if r.seed == A]
    message = "IP address is not allowed: 127.0.0.1"
    assert [(r.ord, r.markdown, r.error, r.seed_error, r.title) for r in rows] == [(1, "", message, message, None)]
    one = {r.seed: r for r in CB.read_summary(got).collect()}[A]
    assert one.text is None and one.error == message and one.failed and one.links == []
    assert {r.seed: r.markdown for r in CB.combine_pages(got).collect()}[A] == ""
    assert {r.seed: r.error for r in CB.error_report(got).collect()}[A] == message


def test_responses_are_followed_before_pages_are_read(spark, site):
    _, ha = site
    body = page([])
    caps = spark.createDataFrame(
        [(1, "http://s.com/old", 301, "/new", None, body), (2, "http://s.com/new", 200, None, "text/html", body), (3, "http://s.com/gone", 404, None, None, body),
         (4, "http://s.com/out", 302, "http://127.0.0.1/", None, body), (5, "http://s.com/nowhere", 302, "/missing", None, body)],
        "page_id long, url string, status int, location string, content_type string, html string",
    )
    req = caps.select("url", F.col("page_id").alias("ord"))
    got = {r.ord: (r.url, r.status, r.error) for r in read_pages(req, caps, ha).collect()}
    assert got[1] == ("http://s.com/new", "ok", None) and got[2] == ("http://s.com/new", "ok", None)
    assert got[3] == ("http://s.com/gone", "fetch", "HTTP 404 for http://s.com/gone")
    assert got[4] == ("http://s.com/out", "fetch", "IP address is not allowed: 127.0.0.1")
    assert got[5] == ("http://s.com/nowhere", "fetch", "No capture for http://s.com/missing")


def test_joined_pages_keep_their_own_titles(spark):
    from mdforge.operators import extract as X

    a = spark.createDataFrame([(1, "<title>A</title>")], "id long, html string").alias("a")
    b = spark.createDataFrame([(1, "<title>B</title>")], "id long, html string").alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"))
    got = X.page_metadata(X.page_metadata(both, "a.html").withColumnRenamed("title", "ta"), "b.html").first()
    assert (got.ta, got.title) == ("A", "B")


def test_crawl_depth(spark, site):
    caps, ha = site
    seeds = spark.createDataFrame([("http://s.com/a",)], "seed string")
    got = CR.crawl_depth(seeds, caps, ha, depth=1).orderBy("ord").collect()
    assert [r.request_url for r in got] == ["http://s.com/a", "http://s.com/b", "http://s.com/c"]
    assert [r.level for r in got] == [0, 1, 1]
    got0 = CR.crawl_depth(seeds, caps, ha, depth=0).collect()
    assert len(got0) == 1


def test_unsafe_link_turns_parent_into_error(spark, site):
    caps, ha = site
    seeds = spark.createDataFrame([("http://s.com/bad",)], "seed string")
    got = CR.crawl_depth(seeds, caps, ha, depth=1, same_origin_only=False).collect()
    assert len(got) == 1 and got[0].error == "IP address is not allowed: 127.0.0.1" and got[0].markdown == ""


def test_robots_and_schedule(spark):
    rules = spark.createDataFrame(
        [("s.com", "*", "disallow", "/private"), ("s.com", "*", "allow", "/private/open"), ("s.com", "*", "crawl-delay", "2"),
         ("s.com", "mdforge", "disallow", "/"), ("t.com", "*", "disallow", "/*.pdf$")],
        "host string, agent string, directive string, value string",
    )
    req = spark.createDataFrame(
        [("http://s.com/private/x", 1), ("http://s.com/private/open/y", 2), ("http://s.com/pub", 3),
         ("http://t.com/a.pdf", 4), ("http://t.com/a.pdf?x", 5), ("http://u.com/", 6)],
        "url string, ord long",
    )
    got = {r.url: r for r in CR.robots_filter(req, rules).collect()}
    assert not got["http://s.com/private/x"].robots_allowed
    assert got["http://s.com/private/open/y"].robots_allowed
    assert got["http://s.com/pub"].robots_allowed
    assert not got["http://t.com/a.pdf"].robots_allowed and got["http://t.com/a.pdf?x"].robots_allowed
    assert got["http://u.com/"].robots_allowed
    named = {r.url: r.robots_allowed for r in CR.robots_filter(req, rules, user_agent="MDForge/1.0").collect()}
    assert not named["http://s.com/pub"]
    sched = {r.url: r.start_offset for r in CR.crawl_schedule(req, rules).collect()}
    assert sched["http://s.com/private/x"] == 0 and sched["http://s.com/private/open/y"] == 2 and sched["http://s.com/pub"] == 4
    assert sched["http://t.com/a.pdf"] == 0


def test_rank_within_spans_partitions(spark):
    rows = [("k", i // 3, i % 3 * (1 << 40)) for i in range(120)] + [("j", 3, 0)]
    df = spark.createDataFrame(rows, "key string, a long, b long").repartition(5)
    got = {(r.key, r.a, r.b): r["rank"] for r in CR.rank_within(df, "key", ("a", "b")).collect()}
    assert [got[x] for x in rows[:-1]] == list(range(1, 121)) and got["j", 3, 0] == 1


HOPS = [
    ("http://s.com/ok", 200, None, "text/html"),
    ("http://s.com/r1", 301, "/r2", None), ("http://s.com/r2", 302, "http://s.com/ok", None),
    ("http://s.com/private", 302, "http://127.0.0.1/metadata", None),
    ("http://s.com/nolocation", 302, None, None), ("http://s.com/404", 404, None, "text/html"),
    ("http://s.com/pdf", 200, None, "application/pdf"), ("http://s.com/notype", 200, None, None),
] + [(f"http://s.com/c{i}", 302, f"/c{i + 1}", None) for i in range(6)] + [("http://s.com/c6", 200, None, "text/html")]


def test_redirect_chains(spark, site):
    _, ha = site
    hops = spark.createDataFrame(HOPS, "url string, status int, location string, content_type string")
    starts = ["http://s.com/ok", "http://s.com/r1", "http://s.com/private", "http://s.com/nolocation", "http://s.com/404",
              "http://s.com/pdf", "http://s.com/notype", "http://s.com/c1", "http://s.com/c0"]
    req = spark.createDataFrame([(u, i) for i, u in enumerate(starts)], "url string, ord long")
    got = {r.request_url: r for r in CR.resolve_redirects(req, hops, ha).collect()}
    assert got["http://s.com/ok"].final_url == "http://s.com/ok" and got["http://s.com/ok"].n_hops == 0
    assert got["http://s.com/r1"].final_url == "http://s.com/ok" and got["http://s.com/r1"].n_hops == 2
    assert got["http://s.com/private"].error == "IP address is not allowed: 127.0.0.1"
    assert got["http://s.com/nolocation"].error == "Redirect without Location header for http://s.com/nolocation"
    assert got["http://s.com/404"].error == "HTTP 404 for http://s.com/404"
    assert got["http://s.com/pdf"].error == "Non-HTML content type: application/pdf for http://s.com/pdf"
    assert got["http://s.com/notype"].final_url == "http://s.com/notype"
    assert got["http://s.com/c1"].final_url == "http://s.com/c6" and got["http://s.com/c1"].n_hops == 5
    assert got["http://s.com/c0"].error == "Too many redirects for http://s.com/c0"


def test_classify_order(spark):
    hops = spark.createDataFrame(HOPS, "url string, status int, location string, content_type string")
    kinds = {r.url: r.kind for r in classify_responses(hops).collect()}
    assert kinds["http://s.com/r1"] == "redirect" and kinds["http://s.com/404"] == "error" and kinds["http://s.com/notype"] == "ok"


def test_redirects_by_doubling(spark):
    """Chains of every length, cycles, branches into a hub, locations that are no URL."""
    host = "http://a.example/"
    rows = [(f"{host}{k}", 302, f"/{k + 1}", None) for k in range(12)] + [(f"{host}12", 200, None, "text/html")]
    rows += [(f"{host}c0", 301, "/c1", None), (f"{host}c1", 301, "/c0", None), (f"{host}self", 301, "/self", None)]
    rows += [(f"{host}h{k}", 302, "/12", None) for k in range(30)]
    rows += [(f"{host}out", 302, "http://10.0.0.1/", None), (f"{host}gone", 302, "/absent", None), (f"{host}e", 404, None, None)]
    hops = spark.createDataFrame(rows, "url string, status int, location string, content_type string")
    ha = spark.createDataFrame([("a.example", "93.184.216.34", 4)], "host string, address string, family int")
    nxt = {u: host + loc[1:] if loc and loc.startswith("/") else loc for u, _, loc, _ in rows}
    ok = {f"{host}12"}

    def follow(u, limit):
        n = 0
        while nxt.get(u) is not None:
            u, n = nxt[u], n + 1
            if n > limit:
                return None, limit + 1, "many"
        return (u if u in ok else None), n, None if u in ok else "error"

    for limit in (0, 1, 4, 5, 11, 12):
        got = {r.start: (r.final_url, r.n_hops, r.error) for r in CR.redirect_table(hops, ha, limit).collect()}
        for u in nxt:
            final, n, why = follow(u, limit)
            assert got[u][:2] == (final, n), (limit, u)
            assert (got[u][2] is None) == (why is None) and ((got[u][2] or "").startswith(CR.TOO_MANY) == (why == "many"))
    assert got[f"{host}out"][2] == "IP address is not allowed: 10.0.0.1" and got[f"{host}gone"][2] == "No capture for http://a.example/absent"


def test_a_level_moves_its_own_rows_only(spark):
    """The tables that levels are joined to are read bucket by bucket, without an exchange."""
    rows = [("s", f"u{k}") for k in range(500)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = CR._Seen(spark.createDataFrame(rows[:200], "seed string, request_url string"))
        seen.add(spark.createDataFrame(rows[200:300], "seed string, request_url string"))
        links = spark.createDataFrame(rows, "seed string, request_url string")
        new = seen.new(links)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(r.request_url for r in new.collect()) == sorted(u for _, u in rows[300:])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        seen.table.drop()
    assert seen.table.table not in [t.name for t in spark.catalog.listTables()]


def test_a_long_way_down(spark):
    """One link a page: as many levels as pages."""
    n = 9
    page = lambda k: f"<html><body><article><h1>Page {k}</h1><p>Some text, long enough to be an article here.</p><a href='/p{k + 1}'>on</a></article></body></html>"
    caps = spark.createDataFrame([(k, f"http://a.example/p{k}", page(k)) for k in range(n)], "page_id long, url string, html string")
    ha = spark.createDataFrame([("a.example", "93.184.216.34", 4)], "host string, address string, family int")
    seeds = spark.createDataFrame([("http://a.example/p0",), ("http://a.example/p4",)], "seed string")
    tables = CR.page_tables(caps)
    got = CR.crawl_budget(seeds, tables, ha, max_pages=8).orderBy("seed", "ord").collect()
    assert [(r.seed[-1], r.ord, r.level, r.request_url[-1], r.status) for r in got] == [("0", k + 1, k, str(k), "ok") for k in range(8)] + [("4", k + 1, k, str(k + 4), "ok" if k < 5 else "fetch") for k in range(6)]
    deep = CR.crawl_depth(seeds.limit(1), tables, ha, depth=6).orderBy("ord").collect()
    assert [r.request_url[-1] for r in deep] == [str(k) for k in range(7)]


def test_robots_rules_as_a_prefix_index(spark):
    """Many rules of one host, wild cards at every place, against the rules read one by one."""
    import random
    import re

    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "ab", "x.pdf", "q?z", "%20", "é", "$", "(["])
    value = lambda: "/" + "/".join(word() for _ in range(rng.randint(0, 3))) + rng.choice(["", "", "*", "*/b", "$", "*$", "/"])
    rules = [("h.com", rng.choice(["*", "bot", "other"]), rng.choice(["Allow", "disallow"]), value()) for _ in range(300)]
    rules += [("h.com", "*", "disallow", ""), ("h.com", "bot", "crawl-delay", "2.5"), ("h.com", "bot", "crawl-delay", "x"), ("i.com", "*", "disallow", "*"), ("j.com", "bot", "crawl-delay", "1"), (None, "*", "disallow", "/"), ("h.com", None, "disallow", "/"), ("h.com", "*", None, None)]
    paths = ["", "/", *{"/" + "/".join(word() for _ in range(rng.randint(0, 4))) for _ in range(120)}]
    urls = [f"http://{h}.com{p}" for h in "hijk" for p in paths]
    df = spark.createDataFrame([(u,) for u in [*urls, urls[5], None, "nothing"]], "url string")
    r = spark.createDataFrame(rules, "host string, agent string, directive string, value string")

    def matches(v, path):
        body = v.removesuffix("$")
        return re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + ("$" if v.endswith("$") else ""), path)

    for agent, own in (("MyBot/1", "bot"), ("reader", "*")):
        got = {x.url: (x.robots_allowed, x.crawl_delay, x.robots_rule) for x in CR.robots_filter(df, r, agent).collect()}
        for u in urls:
            host, _, path = u[7:].partition("/")
            path = ("/" + path) if "/" in u[7:] else "/"
            names = {a for h, a, _, _ in rules if h == host}
            group = [(d.lower(), v) for h, a, d, v in rules if h == host and d and a == (own if own in names else "*")]
            hit = [(len(v), d == "allow", v) for d, v in group if d in ("allow", "disallow") and v and matches(v, path)]
            delays = [float(v) for d, v in group if d == "crawl-delay" and v != "x"]
            best = max(hit, default=(0, True, None))
            assert got[u] == (best[1], max(delays, default=0.0), best[2]), u
        assert got[None] == got["nothing"] == (True, 0.0, None)
