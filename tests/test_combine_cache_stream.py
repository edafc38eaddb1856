"""M10-M12, S5-S11 and T1-T2 on fixtures."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from mdforge.operators import combine as CB
from mdforge.session import ensure_checkpoint_dir
from mdforge.sources import cache as CA
from mdforge.sources import export as EX
from mdforge.streaming import pages as ST

RESULTS = [
    ("s1", 1, "http://a/1", "One", "# One", None),
    ("s1", 2, "http://a/2", None, "", "HTTP 404 for http://a/2"),
    ("s1", 3, "http://a/3", "Three", "# Three", None),
    ("s2", 1, "http://b/1", "B", "# B", None),
    ("s3", 1, "http://c/1", None, "", "Empty response from server"),
]
SCHEMA = "seed string, ord long, url string, title string, markdown string, error string"


def test_combine_pages(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    got = {r.seed: r.markdown for r in CB.combine_pages(df).collect()}
    assert got["s1"] == ("<!-- Source: http://a/1 -->\n# One\n<!-- Error fetching http://a/2: HTTP 404 for http://a/2 -->\n"
                         "\n\n---\n\n<!-- Source: http://a/3 -->\n# Three")
    assert got["s2"] == "<!-- Source: http://b/1 -->\n# B"
    assert got["s3"] == "<!-- Error fetching http://c/1: Empty response from server -->"


def test_error_report_and_summary(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    errs = {r.seed: r.error for r in CB.error_report(df).collect()}
    assert errs == {"s1": "Some pages had errors: http://a/2", "s2": None, "s3": "Some pages had errors: http://c/1"}
    summ = {r.seed: r for r in CB.read_summary(df).collect()}
    assert summ["s1"].title == "One" and summ["s1"].text.endswith("\n\n---\n*Note: Some pages had errors: http://a/2*")
    assert summ["s2"].text == "<!-- Source: http://b/1 -->\n# B" and summ["s2"].error is None
    assert not summ["s3"].failed  # the error comment is content, so a note is appended


def test_cache_round_trip(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    path = os.path.join(base, "cache-" + uuid.uuid4().hex)
    r0 = spark.createDataFrame([("http://a/1", "T", "old", None), ("http://a/2", "U", "x", "boom")], "url string, title string, markdown string, error string")
    r1 = spark.createDataFrame([("HTTP://A/1#f", "T2", "new", None)], "url string, title string, markdown string, error string")
    CA.cache_put(r0, path, batch=0)
    CA.cache_put(r1, path, batch=1)
    cache = CA.read_cache(spark, path)
    rows = cache.collect()
    assert len(rows) == 1 and rows[0].markdown == "new" and rows[0].title == "T2"
    st = CA.cache_status(cache).first()
    assert st.cache_files == 1 and st.cache_size == len("new") + len("T2") and st.cache_size_formatted == "0.00 MB"
    req = spark.createDataFrame([("http://a/1",), ("http://a/9",)], "url string")
    found = {r.url: (r.hit, r.cached_markdown) for r in CA.cache_lookup(req, cache).collect()}
    assert found == {"http://a/1": (True, "new"), "http://a/9": (False, None)}
    CA.cache_put(r0.withColumn("title", F.lit("A")), path)  # a put without a number is the newest
    assert CA.read_cache(spark, path).first().markdown == "old"
    out = CA.cache_clear(spark, path).first()
    assert out.status == "success" and CA.read_cache(spark, path).count() == 0
    missing = CA.read_cache(spark, path + "-absent")
    assert CA.cache_status(missing).first().cache_files == 0


def test_exports(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    both = {(r.seed, r.ord): r for r in EX.export_both(df).collect()}
    assert both[("s1", 1)].text == "\n## URL: http://a/1\n\n# One\n" and both[("s1", 1)].message is None
    assert both[("s1", 2)].message == "Error: HTTP 404 for http://a/2"
    js = {(r.seed, r.ord): r.json for r in EX.export_json(df).collect()}
    assert js[("s1", 1)] == '{"url":"http://a/1","markdown":"# One","title":"One"}'


def test_stream_once_per_url(spark):
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    src = os.path.join(base, "src-" + uuid.uuid4().hex)
    body = "<html><body><article><p>" + "word " * 20 + "</p></article></body></html>"
    batch1 = spark.createDataFrame([(1, "http://a/x", body), (2, "HTTP://A/x#f", body)], "page_id long, url string, html string")
    batch1.coalesce(1).write.parquet(src + "/b1")
    ha = spark.createDataFrame([("a", "8.8.8.8", 4, 0)], "host string, address string, family int, pos int")
    out, ck = os.path.join(base, "out-" + uuid.uuid4().hex), os.path.join(base, "ck-" + uuid.uuid4().hex)
    run = lambda ck: ST.stream_read_pages(ST.page_stream(spark, src + "/*"), out, ck, ha)
    run(ck)
    assert [(r.url_key, r.page_id) for r in ST.read_results(spark, out).collect()] == [("http://a/x", 1)]  # the lowest id
    spark.createDataFrame([(3, "http://a/x", body), (4, "http://a/y", body)], "page_id long, url string, html string") \
        .coalesce(1).write.parquet(src + "/b2")
    run(ck)
    assert sorted(r.url_key for r in ST.read_results(spark, out).collect()) == ["http://a/x", "http://a/y"]
    run(ck)
    run(ck + "-another")
    assert ST.read_results(spark, out).count() == 2
    cache = os.path.join(base, "cache-" + uuid.uuid4().hex)
    ST.stream_cache_put(ST.page_stream(spark, src + "/*"), cache, ck + "-c1", ha)
    newer = body.replace("word ", "newer ")
    spark.createDataFrame([(9, "http://a/y", newer)], "page_id long, url string, html string").coalesce(1).write.parquet(src + "-late/b")
    ST.stream_cache_put(ST.page_stream(spark, src + "-late/*"), cache, ck + "-c2", ha)  # its epochs start at 0 again
    got = {r.url: r.markdown for r in CA.read_cache(spark, cache).collect()}
    assert got["http://a/y"].startswith("newer") and got["http://a/x"].startswith("word")


def _pages_of(spark, n, title="t"):
    return spark.createDataFrame([(f"http://a.example/{k}", title, f"text {k}", None) for k in range(n)], "url string, title string, markdown string, error string")


def _cache_path(spark):
    from mdforge.session import ensure_checkpoint_dir

    return os.path.join(ensure_checkpoint_dir(spark), "cache-" + uuid.uuid4().hex)


def test_a_put_that_fails_midway_is_not_seen(spark, monkeypatch):
    path = _cache_path(spark)
    CA.cache_put(_pages_of(spark, 20, "old"), path)
    begun = CA.read_cache(spark, path)
    commit = CA._commit

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(CA, "_commit", lost)
    for broken in (lambda: CA.cache_put(_pages_of(spark, 30, "new"), path), lambda: CA.cache_clear(spark, path)):
        with pytest.raises(RuntimeError):
            broken()
        assert {(r.url, r.title) for r in CA.read_cache(spark, path).collect()} == {(f"http://a.example/{k}", "old") for k in range(20)}
    monkeypatch.setattr(CA, "_commit", commit)
    CA.cache_clear(spark, path)
    assert CA.read_cache(spark, path).count() == 0 and begun.count() == 20  # a reader that has begun goes on
    CA.cache_put(_pages_of(spark, 3), path)
    assert CA.cache_vacuum(spark, path) == 2 and CA.read_cache(spark, path).count() == 3


def test_two_writers_and_a_compaction(spark, monkeypatch):
    path = _cache_path(spark)
    CA.cache_put(_pages_of(spark, 4, "a"), path)
    seen, take = [], CA.snapshot

    def slow(spark_, path_):
        """Another writer commits between this one's look at the snapshot and its rename."""
        state = take(spark_, path_)
        if not seen:
            seen.append(1)
            CA.cache_put(_pages_of(spark, 6, "b"), path, batch=9)
        return state

    monkeypatch.setattr(CA, "snapshot", slow)
    CA.cache_put(_pages_of(spark, 2, "c"), path, batch=10)
    monkeypatch.setattr(CA, "snapshot", take)
    want = {f"http://a.example/{k}": "c" if k < 2 else "b" for k in range(6)}
    assert {r.url: r.title for r in CA.read_cache(spark, path).collect()} == want
    assert CA.next_version(spark, path) == 11
    CA.cache_compact(spark, path)
    assert len(CA.snapshot(spark, path)[1]) == 1 and {r.url: r.title for r in CA.read_cache(spark, path).collect()} == want


def test_a_lookup_reads_its_own_partitions(spark):
    path = _cache_path(spark)
    CA.cache_put(_pages_of(spark, 60), path)
    CA.cache_put(_pages_of(spark, 60, "u"), path)
    req = spark.createDataFrame([("http://a.example/7",), ("http://b.example/",), (None,)], "url string")
    out = CA.cache_lookup_at(req, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_prefix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scan = [r for r in plan.splitlines() if "FileScan" in r][0]
    assert "key_prefix" in scan
    assert {r.url: (r.hit, r.cached_title) for r in out.collect()} == {"http://a.example/7": (True, "u"), "http://b.example/": (False, None), None: (False, None)}


def test_scan_of_captures(spark):
    from mdforge.sources.captures import scan_captures

    path = _cache_path(spark)
    assert scan_captures(spark, path + "-absent").count() == 0
    assert scan_captures(spark, path + "-absent", responses=True).columns == ["page_id", "url", "html", "status", "location", "content_type"]
    spark.createDataFrame([(1, "http://a/", "<p>x", 200, "extra"), (None, None, None, None, None)], "page_id int, url string, html string, status int, other string").write.parquet(path)
    got = scan_captures(spark, path, responses=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, [type(got.first())(page_id=1, url="http://a/", html="<p>x", status=200, location=None, content_type=None), type(got.first())(page_id=None, url=None, html=None, status=None, location=None, content_type=None)]))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path + "-empty")
    assert scan_captures(spark, path + "-empty").count() == 0


def test_files_in_order(spark):
    import json

    path = _cache_path(spark)
    rows = [(f"s{k % 3}", k // 3, f"http://a/{k}", f"text {k}") for k in range(90)]
    df = spark.createDataFrame(rows, "seed string, ord int, url string, markdown string").repartition(5)
    EX.write_json_lines(df, path, rows_per_file=7)
    names = sorted(n for n in os.listdir(path.removeprefix("file:")) if n.startswith("part-"))
    lines = [open(os.path.join(path.removeprefix("file:"), n)).read().splitlines() for n in names]
    assert max(map(len, lines)) <= 7
    assert [json.loads(x)["url"] for part in lines for x in part] == [r[2] for r in sorted(rows)]


@pytest.mark.parametrize("files", (1, 3))
def test_stream_reads_a_table_of_one_file_or_a_folder(spark, files, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from mdforge.plans import catalog as K

    html = "<html><head><title>T{0}</title></head><body><article><p>" + "some words, " * 20 + "page {0}</p></article></body></html>"
    rows = [{"page_id": k, "url": f"https://h{k}.example/a", "html": html.format(k)} for k in range(6)]
    rows.append(rows[0] | {"page_id": 9})  # a second capture
    if files > 1:
        (tmp_path / "pages.parquet").mkdir()
    for f in range(files):
        to = tmp_path / "pages.parquet" if files == 1 else tmp_path / "pages.parquet" / f"part-{f}.parquet"
        pq.write_table(pa.Table.from_pylist(rows[f::files]), to)
    want = {r.url: (r.ord, r.title, r.markdown, r.status) for r in K.h8_read_pages(spark, str(tmp_path)).collect()}
    got = {r.url: (r.page_id, r.title, r.markdown, r.status) for r in K.t1_stream_read_pages(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got == want
    cached = {r.url for r in K.t2_stream_cache_put(spark, str(tmp_path)).collect()}
    assert cached == {u for u, (_, _, _, status) in want.items() if status == "ok"}


def test_stream_of_an_empty_folder_gives_an_empty_table(spark, tmp_path):
    from mdforge.plans import catalog as K

    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert K.t1_stream_read_pages(spark, str(tmp_path)).collect() == []
