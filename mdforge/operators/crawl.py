"""Crawls as level-synchronous loops of joins, robots rules, schedules,
redirect chains.

A crawl is breadth-first: each level is one set of Spark jobs (fetch + extract the
frontier, explode its links, anti-join everything already queued, rank what is
new). FIFO order equals the order ``(level, parent_ord, pos)`` with the first
discovery of a URL kept, so the queue never has to be materialised row by row.
Each level is written to the shared ``spark.checkpoint.dir`` so lineage stays
short and a lost executor recomputes at most one level.

Levels carry URL-sized rows only: pages are extracted once into a table of their own, a
narrow table (outcome and links of every page, no Markdown) is what the levels join, and
Markdown is attached to the result at the end.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import Bucketed, ensure_checkpoint_dir, settle
from . import policy as P
from .links import page_link_array


def rank_within(df: DataFrame, key: str, order: tuple[str, ...], out: str = "rank") -> DataFrame:
    """1-based rank by the ``order`` columns inside each ``key`` without one task per key.

    The rows are range-partitioned by key and order, so a hot key spans as many
    partitions as its rows need; ranks inside a partition are shifted by the rows the key
    has in earlier partitions, which come from a small table of counts. The partition
    numbers are settled first: a range partitioning may not be repeated alike.
    """
    staged = settle(df.repartitionByRange(key, *order).withColumn("_rk_part", F.spark_partition_id()), "ranked")
    counts = staged.groupBy(key, "_rk_part").agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(key).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_rk_off", F.coalesce(F.sum("_rk_n").over(before), F.lit(0))).drop("_rk_n")
    inside = Window.partitionBy(key, "_rk_part").orderBy(*order)
    ranked = staged.withColumn("_rk_in", F.row_number().over(inside)).join(offsets, [key, "_rk_part"])
    return ranked.withColumn(out, (F.col("_rk_in") + F.col("_rk_off")).cast("long")).drop("_rk_part", "_rk_in", "_rk_off")


# ---------------------------------------------------------------------------
# C3 robots rules, C4 schedule
# ---------------------------------------------------------------------------
def _pattern(value: Column) -> Column:
    """Robots path pattern -> anchored regex: ``*`` any run, trailing ``$`` end."""
    ends = value.endswith("$")
    body = F.regexp_replace(value, r"\$\z", "")
    quoted = F.concat(F.lit("^\\Q"), F.replace(body, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.when(ends, F.concat(quoted, F.lit("$"))).otherwise(quoted)


def own_rules(rules: DataFrame, user_agent: str) -> DataFrame:
    """(_rh, directive, value): the rules of every host that hold for an agent, once each.

    A host's rules for agents that the name contains replace its rules for ``*``.
    """
    agent, ua = F.lower(F.col("agent")), F.lit(user_agent.lower())
    named = F.coalesce((agent != "*") & ua.contains(agent), F.lit(False))
    rows = rules.select(F.lower(F.col("host")).alias("_rh"), F.lower(F.col("directive")).alias("directive"), "value", named.alias("_named"), (agent == "*").alias("_any"))
    rows = settle(rows.filter("_named or _any").distinct(), "rules")
    has = rows.groupBy("_rh").agg(F.max("_named").alias("_has"))
    return rows.join(has, "_rh").filter(F.col("_named") == F.col("_has")).select("_rh", "directive", "value").distinct()


def robots_filter(df: DataFrame, rules: DataFrame, user_agent: str = "*", url: str = "url",
                  only_where: Column | None = None) -> DataFrame:
    """Adds ``robots_allowed``, ``crawl_delay`` and ``robots_rule`` (longest match,
    allow wins ties, then the larger value; rules of the named agent replace the ``*`` group).

    Rules are an index on their literal prefixes, up to the first ``*`` or the closing ``$``.
    Every distinct path of a host asks for its own prefixes of the lengths that occur among
    the host's rules, an equality join that deals one host's rules and requests to many
    tasks; a pattern is only tried on the paths that begin with its prefix. The rows are
    settled once, as their paths are read twice.
    """
    parts = U.url_parts(F.col(url))
    path = F.concat(F.coalesce(F.nullif(F.col("_rp.path"), F.lit("")), F.lit("/")),
                    F.when(F.col("_rp.query").isNotNull(), F.concat(F.lit("?"), F.col("_rp.query"))).otherwise(F.lit("")))
    asks = F.lit(True) if only_where is None else F.coalesce(only_where, F.lit(False))
    staged = df.withColumn("_rp", parts).withColumns({"_rhost": F.col("_rp.host"), "_rpath": path, "_asks": asks}).drop("_rp")
    staged = settle(staged, "requests")
    own = settle(own_rules(rules, user_agent), "rules")
    value = F.col("value")
    prefix = F.regexp_extract(F.regexp_replace(value, r"\$\z", ""), r"^[^*]*", 0)
    matching = F.col("directive").isin("allow", "disallow") & (value != "")
    index = own.filter(matching).select(
        "_rh", prefix.alias("_prefix"), "value", (F.col("directive") == "allow").alias("allow"),
        (value.contains("*") | value.endswith("$")).alias("_wild"),
    )
    index = settle(index, "index")
    # The lengths of a host's prefixes: no more than its longest rule has characters.
    hosts = own.groupBy("_rh").agg(F.max(F.when(F.col("directive") == "crawl-delay", value.try_cast("double"))).alias("_delay"))
    lengths = index.groupBy("_rh").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = staged.filter("_asks and _rhost is not null").select(F.col("_rhost").alias("_rh"), "_rpath").distinct().join(lengths, "_rh")
    asked = asked.withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_rpath")))).drop("_lengths")
    asked = asked.select("_rh", "_rpath", F.substr("_rpath", F.lit(1), "_n").alias("_prefix"))
    hits = asked.join(index, ["_rh", "_prefix"]).filter(~F.col("_wild") | F.regexp_like(F.col("_rpath"), _pattern(value)))
    best = F.max(F.struct(F.length("value").alias("len"), "allow", "value")).alias("_best")
    best = settle(hits.groupBy("_rh", "_rpath").agg(best).select(F.col("_rh").alias("_bh"), F.col("_rpath").alias("_bp"), "_best"), "best")
    out = staged.join(best, F.col("_asks") & (F.col("_rhost") == F.col("_bh")) & (F.col("_rpath") == F.col("_bp")), "left")
    out = out.join(hosts, F.col("_asks") & (F.col("_rhost") == F.col("_rh")), "left")
    out = out.withColumns({
        "robots_allowed": F.coalesce(F.col("_best.allow"), F.lit(True)),
        "crawl_delay": F.coalesce("_delay", F.lit(0.0)),
        "robots_rule": F.col("_best.value"),
    })
    if only_where is not None:
        out = out.withColumn("robots_allowed", F.when(F.col("_asks"), F.col("robots_allowed")))
    return out.drop("_rhost", "_rpath", "_asks", "_bh", "_bp", "_best", "_rh", "_delay")


def crawl_schedule(requests: DataFrame, rules: DataFrame, user_agent: str = "*", url: str = "url",
                   order: str = "ord") -> DataFrame:
    """C4: earliest start offset (seconds) per request: (rank in host - 1) * delay."""
    hosts = requests.withColumn("host", U.url_part(F.col(url), "host"))
    ranked = rank_within(hosts, "host", (order,), out="host_rank")
    checked = robots_filter(ranked, rules, user_agent, url)
    return checked.withColumn("start_offset", (F.col("host_rank") - 1) * F.col("crawl_delay"))


# ---------------------------------------------------------------------------
# S3 redirect chains
# ---------------------------------------------------------------------------
TOO_MANY = "Too many redirects for "
NO_RESPONSE = "No capture for "
MAX_REDIRECTS = 5


def redirect_table(hops: DataFrame, host_addresses: DataFrame, max_redirects: int = MAX_REDIRECTS, key=lambda url: url,
                   host_verdicts: DataFrame | None = None) -> DataFrame:
    """Where the chain of every URL of ``hops`` ends: ``(start, final_url, n_hops, error)``.

    ``hops(url, status, location, content_type)`` holds one response per URL; of repeated
    ones the smallest counts. ``key`` maps a location to the form of ``hops.url``. Every URL
    is judged once. Chains are followed by pointer doubling: in each round a URL takes over
    how far the URL it points at has come, so rounds grow with the logarithm of the limit
    and a chain's length is no matter; one that still moves afterwards is too long, cycles
    included. A URL that many others point at is a hot key of a join of settled tables,
    which AQE splits.
    """
    from ..sources.captures import classify_response

    hops = hops.groupBy("url").agg(F.min(F.struct("status", "location", "content_type")).alias("_r")).select("url", "_r.*")
    c = classify_response(F.col("url"), F.col("status"), F.col("location"), F.col("content_type"))
    edges = hops.select("url", "location", c.alias("_c"), key(U.resolve_url(F.col("location"), F.col("url"), keep_absolute_raw=False)).alias("_next"))
    edges = settle(edges, "edges")
    to = edges.filter((F.col("_c.kind") == "redirect") & F.col("_next").isNotNull()).select(F.col("_next").alias("url"))
    nodes = edges.select("url").unionByName(to).distinct()
    judged = P.url_policy(nodes, host_addresses, url="url", host_verdicts=host_verdicts).select("url", F.col("reason").alias("_policy"))
    redirect = F.col("_c.kind") == "redirect"
    error = F.coalesce(
        F.col("_policy"),
        F.when(F.col("_c").isNull(), F.concat(F.lit(NO_RESPONSE), F.col("url"))),
        F.when(redirect & F.col("_next").isNull(), F.concat(F.lit(P.MSG_INVALID_URL), F.col("location"))),
        F.col("_c.error"),
    )
    moving = F.coalesce(redirect & error.isNull(), F.lit(False))
    chains = settle(
        judged.join(edges, "url", "left").select(
            F.col("url").alias("start"), F.when(moving, F.col("_next")).otherwise(F.col("url")).alias("at"),
            moving.cast("int").alias("n_hops"), moving.alias("moving"), error.alias("error"),
        ),
        "chains",
    )
    reach = 1
    while reach <= max_redirects:
        ends = chains.select(F.col("start").alias("_at"), F.col("at").alias("_to"), F.col("n_hops").alias("_more"), F.col("moving").alias("_moves"), F.col("error").alias("_error"))
        on = chains.filter("moving").join(ends, F.col("at") == F.col("_at"))
        on = on.select("start", F.col("_to").alias("at"), (F.col("n_hops") + F.col("_more")).alias("n_hops"), F.col("_moves").alias("moving"), F.col("_error").alias("error"))
        chains = settle(on.unionByName(chains.filter("not moving")), "chains")
        reach *= 2
    far = F.col("moving") | (F.col("n_hops") > max_redirects)
    return chains.select(
        "start",
        F.when(~far & F.col("error").isNull(), F.col("at")).alias("final_url"),
        F.when(far, F.lit(max_redirects + 1)).otherwise(F.col("n_hops")).alias("n_hops"),
        F.when(far, F.concat(F.lit(TOO_MANY), F.col("start"))).otherwise(F.col("error")).alias("error"),
    )


def resolve_redirects(requests: DataFrame, hops: DataFrame, host_addresses: DataFrame,
                      max_redirects: int = MAX_REDIRECTS, key=lambda url: url) -> DataFrame:
    """S3: follow Location up to ``max_redirects`` times, re-checking the policy on
    every hop. Output ``(ord, request_url, final_url, n_hops, error)``.

    The chains come from ``redirect_table``; a request that has no response at all is
    judged by itself.
    """
    chains = redirect_table(hops, host_addresses, max_redirects, key)
    joined = settle(requests.select("ord", F.col("url").alias("request_url")).join(chains, F.col("request_url") == F.col("start"), "left"), "requests")
    known = joined.filter(F.col("start").isNotNull()).select("ord", "request_url", "final_url", "n_hops", "error")
    lost = joined.filter(F.col("start").isNull()).select("ord", "request_url")
    judged = P.url_policy(lost.select(F.col("request_url").alias("url")).distinct(), host_addresses).select(F.col("url").alias("_u"), "reason")
    lost = lost.join(judged, F.col("request_url").eqNullSafe(F.col("_u")), "left")
    null = F.lit(None).cast("string")
    return known.unionByName(lost.select(
        "ord", "request_url", null.alias("final_url"), F.lit(0).alias("n_hops"), F.coalesce("reason", F.concat(F.lit(NO_RESPONSE), F.col("request_url"))).alias("error")))


# ---------------------------------------------------------------------------
# C1 crawl with a page budget (Markdown links, raw-URL visited set)
# ---------------------------------------------------------------------------
CRAWL_COLS = ("seed", "ord", "level", "request_url", "url", "title", "markdown", "error", "status")
# Narrow part of a page: what the levels read.
PAGE_COLS = ("_cap_key", "final_url", "gate_status", "gate_title", "gate_error")


def page_tables(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, narrow): every capture extracted once, and the same without Markdown.

    ``md_links``: links of the Markdown, resolved against the captured URL; ``links``:
    those of the page DOM. Both tables can be passed to several crawls.
    """
    from ..plans.read_pages import prepare_captures

    pages = settle(prepare_captures(captures, with_links=True), "pages")
    links = F.when(F.col("gate_markdown") != "", page_link_array(F.col("gate_markdown"), F.col("final_url")))
    return pages, settle(pages.select(*PAGE_COLS, "links", links.alias("md_links")), "links")


def _frontier(seeds: DataFrame, url) -> DataFrame:
    zero = F.lit(0).cast("long")
    return seeds.select("seed").distinct().select("seed", url.alias("request_url"), zero.alias("parent_ord"), zero.alias("pos"))


def _visits(frontier: DataFrame, counts: DataFrame | None, level: int) -> DataFrame:
    """(seed, ord, level, request_url): the frontier in queue order, numbered on."""
    ranked = rank_within(frontier, "seed", ("parent_ord", "pos"), out="_r")
    if counts is not None:
        ranked = ranked.join(counts, "seed").withColumn("_r", F.col("_r") + F.col("done"))
    return ranked.select("seed", F.col("_r").alias("ord"), F.lit(level).alias("level"), "request_url")


class _Site:
    """What the levels of a crawl join, made once: the outcome of every URL that a seed or a
    captured page names, and its links.

    ``site`` (request_url, status, error, url, title, ...) is bucketed by URL and ``edges``
    (parent, pos, request_url) by the page that links, so a level moves its own rows only.
    """

    def __init__(self, seeds: DataFrame, narrow: DataFrame, links: str, origin: str, same_origin_only: bool, key, decide_with: dict) -> None:
        from ..plans.read_pages import decide, outcomes

        spark = seeds.sparkSession
        # Links of every page that was read, those of another origin left out.
        named = narrow.select("_cap_key", "final_url", F.posexplode(F.col(links)).alias("pos", "_link"))
        urls = seeds.select(F.col("request_url").alias("url")).unionByName(named.select(key(F.col("_link")).alias("url")))
        urls = settle(urls.filter(F.col("url").isNotNull()).distinct().withColumn("ord", F.lit(0).cast("long")), "urls")
        decided = settle(decide(urls, dedupe=False, **decide_with), "decided")
        rows = outcomes(decided, narrow, tuple(dict.fromkeys((links, "links", "_cap_key")))).drop("ord", *(["md_links"] if links == "md_links" else []))
        self.site = Bucketed(spark, "site", "request_url")
        self.site.append(rows.drop("links") if links == "md_links" else rows)
        self.edges = Bucketed(spark, "edges", "parent")
        read = self.site.read().filter(F.col("status") == "ok") if links == "links" else self.site.read()
        from_pages = read.select(F.col("request_url").alias("parent"), F.col("url"), F.col("_cap_key").alias("_from"))
        edges = from_pages.join(named.drop("final_url"), F.col("_from") == F.col("_cap_key"))
        if same_origin_only:
            edges = edges.filter(U.url_origin(F.col("_link")) == U.url_origin(F.col(origin)))
        self.edges.append(edges.select("parent", F.col("pos").cast("long").alias("pos"), key(F.col("_link")).alias("request_url")))

    def drop(self) -> DataFrame:
        """Leave the catalog; the outcomes as a plain table."""
        self.edges.drop()
        return self.site.drop()


class _Seen:
    """URLs that a seed has queued, bucketed by both: a level looks its own links up in them."""

    def __init__(self, frontier: DataFrame) -> None:
        self.table = Bucketed(frontier.sparkSession, "seen", "seed", "request_url")
        self.add(frontier)

    def add(self, frontier: DataFrame) -> None:
        self.table.append(frontier.select("seed", "request_url"))

    def new(self, links: DataFrame) -> DataFrame:
        return links.join(self.table.read(), ["seed", "request_url"], "left_anti")


class _Levels:
    """The visits of a crawl, a folder for each level."""

    def __init__(self, spark) -> None:
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/visits-{uuid.uuid4().hex}"

    def add(self, visits: DataFrame, level: int) -> DataFrame:
        folder = f"{self.path}/level={level}"
        visits.drop("level").write.parquet(folder)
        return self.spark.read.schema("seed string, ord long, request_url string").parquet(folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema("seed string, ord long, request_url string, level int").parquet(self.path)


def _with_markdown(results: DataFrame, pages: DataFrame, cache: DataFrame | None) -> DataFrame:
    from ..plans.read_pages import with_cached

    md = pages.select(F.col("_cap_key").alias("_mk"), F.col("gate_markdown").alias("markdown"))
    return with_cached(results.join(md, F.col("_cap_key") == F.col("_mk"), "left"), cache)


def _decide_with(host_addresses: DataFrame, cache, robots_rules, user_agent: str, hops: DataFrame | None) -> dict:
    """What decides about URLs, hosts judged and redirect chains followed once for the crawl."""
    from ..plans.read_pages import canonical

    verdicts = settle(P.host_policy(host_addresses), "hosts")
    chains = None
    if hops is not None:
        chains = settle(redirect_table(hops.withColumn("url", canonical(F.col("url"))), host_addresses, key=canonical, host_verdicts=verdicts), "redirects")
    return dict(host_addresses=host_addresses, cache=cache, robots_rules=robots_rules, user_agent=user_agent, chains=chains, host_verdicts=verdicts)


def crawl_budget(seeds: DataFrame, captures: DataFrame | tuple[DataFrame, DataFrame], host_addresses: DataFrame, max_pages: int = 1,
                 same_origin_only: bool = True, cache: DataFrame | None = None,
                 robots_rules: DataFrame | None = None, user_agent: str = "*", hops: DataFrame | None = None) -> DataFrame:
    """Breadth-first from each distinct ``seeds.seed`` over Markdown links until
    ``max_pages`` results (failed pages count). A policy failure of any visited URL aborts
    the read of its seed: the output is then one row, without page or Markdown, whose
    ``seed_error`` (and ``error``) is the first failure's message.

    ``captures`` may be the result of ``page_tables``. A page expands from its capture, not
    from the cache. Returns ``CRAWL_COLS`` + ``seed_error``; pages in visit order 1..n.
    """
    from ..plans.read_pages import response_hops

    pages, narrow = captures if isinstance(captures, tuple) else page_tables(captures)
    if hops is None and not isinstance(captures, tuple):
        hops = response_hops(captures)
    decide_with = _decide_with(host_addresses, cache, robots_rules, user_agent, hops)
    frontier = settle(_frontier(seeds, F.col("seed")), "frontier")
    site = _Site(frontier, narrow, "md_links", "parent", same_origin_only, lambda url: url, decide_with)
    seen, levels, counts, level = _Seen(frontier), _Levels(frontier.sparkSession), None, 0
    while True:
        visits = levels.add(_visits(frontier, counts, level).filter(F.col("ord") <= max_pages), level)
        # Links only from pages that still leave room in the budget.
        parents = visits.filter(F.col("ord") < max_pages).select("seed", F.col("request_url").alias("parent"), F.col("ord").alias("parent_ord"))
        new = seen.new(parents.join(site.edges.read(), "parent").select("seed", "request_url", "parent_ord", "pos"))
        first = new.groupBy("seed", "request_url").agg(F.min(F.struct("parent_ord", "pos")).alias("_k"))
        frontier = settle(first.select("seed", "request_url", "_k.parent_ord", "_k.pos"), "frontier")
        if frontier.isEmpty():
            break
        counts = visits.groupBy("seed").agg(F.max("ord").alias("done"))
        seen.add(frontier)
        level += 1

    seen.table.drop()
    out = settle(levels.read().join(site.drop(), "request_url"), "crawl")
    # A policy failure aborts the whole read of its seed (first failure by visit order).
    failures = out.filter(F.col("status") == "policy")
    aborts = settle(failures.groupBy("seed").agg(F.min(F.struct("ord", "error")).alias("_a")).select("seed", "_a.error"), "aborts")
    null = F.lit(None).cast("string")
    aborted = aborts.select(
        "seed", F.lit(1).cast("long").alias("ord"), F.lit(0).alias("level"), F.col("seed").alias("request_url"), F.col("seed").alias("url"),
        null.alias("title"), F.lit("").alias("markdown"), "error", F.lit("policy").alias("status"), F.col("error").alias("seed_error"),
    )
    whole = _with_markdown(out.join(aborts.select("seed"), "seed", "left_anti"), pages, cache)
    return whole.select(*CRAWL_COLS, null.alias("seed_error")).unionByName(aborted)


# ---------------------------------------------------------------------------
# C2 crawl to a depth (normalised keys, DOM links, no page limit)
# ---------------------------------------------------------------------------

def crawl_depth(seeds: DataFrame, captures: DataFrame | tuple[DataFrame, DataFrame], host_addresses: DataFrame, depth: int = 0,
                same_origin_only: bool = True, cache: DataFrame | None = None,
                robots_rules: DataFrame | None = None, user_agent: str = "*", hops: DataFrame | None = None) -> DataFrame:
    """Level by level to ``depth`` with canonical URL keys and page DOM links.

    A cached page does not expand. A link that fails the policy turns its parent into
    an error row (links before it in page order are still queued). Order within a
    level is ``(parent_ord, pos)``. Returns ``CRAWL_COLS`` + ``links``, the DOM links of
    every page that was read.
    """
    from ..plans.read_pages import canonical as key
    from ..plans.read_pages import response_hops

    pages, narrow = captures if isinstance(captures, tuple) else page_tables(captures)
    if hops is None and not isinstance(captures, tuple):
        hops = response_hops(captures)
    decide_with = _decide_with(host_addresses, cache, robots_rules, user_agent, hops)
    frontier = settle(_frontier(seeds, key(F.col("seed"))), "frontier")
    site = _Site(frontier, narrow, "links", "url", same_origin_only, key, decide_with)
    # A URL that the policy refuses is one whose page was not asked for at all.
    refused = settle(site.site.read().filter(F.col("status") == "policy").select(F.col("request_url").alias("_u"), F.col("error").alias("reason")), "refused")
    seen, levels, counts, bad_links = _Seen(frontier), _Levels(frontier.sparkSession), None, []
    for level in range(depth + 1):
        visits = levels.add(_visits(frontier, counts, level), level)
        if level == depth:
            break
        parents = visits.select("seed", "ord", F.col("request_url").alias("parent"))
        queued = seen.new(parents.join(site.edges.read(), "parent").select("seed", "ord", "pos", "request_url"))
        queued = settle(queued.join(refused, F.col("request_url") == F.col("_u"), "left").drop("_u"), "queued")
        bad = queued.filter(F.col("reason").isNotNull()).groupBy("seed", "ord").agg(F.min(F.struct("pos", "reason")).alias("_b"))
        bad = settle(bad.select("seed", "ord", F.col("_b.pos").alias("bad_pos"), F.col("_b.reason").alias("bad_link")), "bad")
        bad_links.append(bad)
        keep = queued.join(bad, ["seed", "ord"], "left").filter(F.col("bad_pos").isNull() | (F.col("pos") < F.col("bad_pos")))
        first = keep.groupBy("seed", "request_url").agg(F.min(F.struct(F.col("ord").alias("parent_ord"), "pos")).alias("_k"))
        frontier = settle(first.select("seed", "request_url", "_k.parent_ord", "_k.pos"), "frontier")
        if frontier.isEmpty():
            break
        counts = visits.groupBy("seed").agg(F.max("ord").alias("done"))
        seen.add(frontier)
    seen.table.drop()
    results = levels.read().join(site.drop(), "request_url")
    if bad_links:
        results = results.join(reduce(DataFrame.unionByName, bad_links).drop("bad_pos"), ["seed", "ord"], "left")
    else:
        results = results.withColumn("bad_link", F.lit(None).cast("string"))
    out = _with_markdown(results, pages, cache)
    bad = F.col("bad_link").isNotNull()
    return out.select(
        "seed", "ord", "level", "request_url",
        F.when(bad, F.col("request_url")).otherwise(F.col("url")).alias("url"),
        F.when(~bad, F.col("title")).alias("title"),
        F.when(bad, F.lit("")).otherwise(F.col("markdown")).alias("markdown"),
        F.coalesce("bad_link", "error").alias("error"),
        F.when(bad, F.lit("link_policy")).otherwise(F.col("status")).alias("status"),
        F.when(~bad, F.col("links")).alias("links"),
    )


def robots_filter_sql(src: str, rules: str, user_agent: str = "*") -> str:
    """DuckDB twin of ``robots_filter`` for a source with ``url`` (oracle)."""
    from ..functions.regex import sql_str

    ua = sql_str(user_agent.lower())
    parts = (
        f"SELECT *, {U.url_part_sql('url', 'host')} AS _h, coalesce(nullif({U.url_part_sql('url', 'path')}, ''), '/') || "
        f"CASE WHEN {U.url_part_sql('url', 'query')} IS NOT NULL THEN '?' || {U.url_part_sql('url', 'query')} ELSE '' END AS _path, "
        f"row_number() OVER () AS _rowid FROM {src}"
    )
    rl = f"(SELECT lower(host) AS rh, lower(agent) AS agent, lower(directive) AS directive, value FROM {rules})"
    j = f"SELECT s.*, r.rh, r.agent, r.directive, r.value FROM ({parts}) s LEFT JOIN {rl} r ON s._h = r.rh"
    spec = f"(agent <> '*' AND contains({ua}, agent))"
    g = f"SELECT *, coalesce(bool_or({spec}) OVER (PARTITION BY _rowid), false) AS _has_spec FROM ({j})"
    pattern = r"""('^\Q' || replace(regexp_replace(value, '\$$', ''), '*', '\E.*\Q') || '\E' || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END)"""
    ingroup = f"(CASE WHEN _has_spec THEN {spec} ELSE agent = '*' END)"
    return f"""(SELECT * EXCLUDE (_best, _delay, _any), coalesce(_best.allow, true) AS robots_allowed,
  coalesce(_delay, 0.0) AS crawl_delay, _best.value AS robots_rule FROM (
  SELECT * EXCLUDE (rh, agent, directive, value, _has_spec, _rowid, _h, _path),
    max(CASE WHEN {ingroup} AND directive IN ('allow', 'disallow') AND value <> '' AND regexp_matches(_path, {pattern})
        THEN struct_pack(len := length(value), allow := directive = 'allow', value := value) END) OVER (PARTITION BY _rowid) AS _best,
    max(CASE WHEN {ingroup} AND directive = 'crawl-delay' THEN TRY_CAST(value AS DOUBLE) END) OVER (PARTITION BY _rowid) AS _delay,
    row_number() OVER (PARTITION BY _rowid) AS _any
  FROM ({g})) WHERE _any = 1)"""
