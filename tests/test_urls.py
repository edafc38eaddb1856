"""U1-U5 on inline fixtures."""

from pyspark.sql import functions as F

from mdforge.functions import urls as U
from mdforge.operators import urls as UO

BASE = "https://m.example.net:8443/en/25?x=1#top"
CASES = [
    ("/a/b/../c", "https://m.example.net:8443/a/c"),
    ("x/./y", "https://m.example.net:8443/en/x/y"),
    ("../../up", "https://m.example.net:8443/up"),
    ("?q=1", "https://m.example.net:8443/en/25?q=1"),
    ("#frag", "https://m.example.net:8443/en/25?x=1#frag"),
    ("", "https://m.example.net:8443/en/25?x=1"),
    ("//Other.COM:80/p", "https://other.com:80/p"),
    ("HTTP://X.com", "http://x.com/"),
    ("mailto:a@b", "mailto:a@b"),
    ("/für", "https://m.example.net:8443/f%C3%BCr"),
    ("/a b", "https://m.example.net:8443/a%20b"),
    ("http://keep me", "http://keep me"),
    ("//", None),
]


def test_resolve(spark):
    df = spark.createDataFrame([(l, BASE) for l, _ in CASES], "l string, b string")
    got = dict(df.select("l", U.resolve_url(F.col("l"), F.col("b")).alias("r")).collect())
    assert got == dict(CASES)


def test_normalize_and_origin(spark):
    rows = [("HTTP://Ex.COM:80", "http://ex.com/", "http://ex.com"),
            ("https://ex.com:443/a/./b/../c?q#f", "https://ex.com/a/c?q", "https://ex.com"),
            ("https://ex.com:8443/", "https://ex.com:8443/", "https://ex.com:8443"),
            ("mailto:x@y", None, None),
            ("not a url", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string")
    got = {r.u: (r.n, r.o) for r in df.select("u", U.normalize_url(F.col("u")).alias("n"), U.url_origin(F.col("u")).alias("o")).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in rows}


def test_dedupe_first_wins(spark):
    df = spark.createDataFrame([("http://a/x", 3), ("HTTP://A/x#f", 1), ("http://a:80/x", 2), ("http://b/", 5)], "url string, ord long")
    out = UO.dedupe_urls(UO.normalize_urls(df), key="url_key", order="ord")
    assert sorted((r.url_key, r.ord, r.url) for r in out.collect()) == [("http://a/x", 1, "HTTP://A/x#f"), ("http://b/", 5, "http://b/")]


def test_same_origin(spark):
    df = spark.createDataFrame([("http://a/1", "http://a/x"), ("https://a/1", "http://a/x"), ("javascript:void(0)", "http://a/"),
                                ("http://a:80/z", "http://a/")], "target string, base string")
    assert sorted(r.target for r in UO.same_origin(df).collect()) == ["http://a/1", "http://a:80/z"]


def standard(spark, urls):
    from mdforge.functions import urlstandard as S

    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r.s for r in df.select(S.standard_column("u").alias("s")).collect()]


def test_standard_spellings(spark):
    pairs = {
        "  http://example.com/a \n": "http://example.com/a", "ht\ttp://exa\nmple.com": "http://example.com", "https:example.com": "https://example.com",
        "http:///host/": "http://host/", "http:\\\\host\\p\\q?a\\b#c\\d": "http://host/p/q?a\\b#c\\d", "http://ex%41mple.com/": "http://example.com/",
        "http://ｅｘａｍｐｌｅ。com/": "http://example.com/", "http://%31%32%37.0.0.1/": "http://127.0.0.1/", "http://bücher.de/": "http://xn--bcher-kva.de/",
        "http://BÜCHER.de:80/?ü": "http://xn--bcher-kva.de:80/?ü", "http://über.de": "http://xn--ber-goa.de", "http://faß.de": "http://xn--fa-hia.de",
        "http://a@b@c.com/": "http://a%40b@c.com/", "HTTP://EXAMPLE.com:8080/A": "http://example.com:8080/A", "http://[::1]:80/x": "http://[::1]:80/x",
        "http://so­ft.com": "http://soft.com", "ftp:\\\\h": "ftp://h", "http://x/a b\tc": "http://x/a bc",
        "mailto:x@y": "mailto:x@y", " a\\b ": "a\\b", "data:text/plain,a b": "data:text/plain,a b",
    }
    assert standard(spark, pairs) == list(pairs.values())
    refused = ["http://ex%2Fa.com/", "http://a＠b.com/", "http://a%ff.com/", "http://a%zz.com", "http://a b.com/", "http://a<b.com", "http:///"]
    assert standard(spark, refused) == refused[:-1] + ["http://"]
    assert standard(spark, [None, ""]) == [None, ""]


def test_punycode_equals_the_codec(spark):
    import random

    from mdforge.functions import sqltext, urlstandard as S

    rng = random.Random(4)
    labels = ["".join(rng.choice("abcz09-éüßñ日本語δπ😀漢字жłž") for _ in range(rng.randint(1, 24))) for _ in range(200)] + ["", "abc", "ü" * 60, "a-", "-é"]
    df = spark.createDataFrame([(x,) for x in labels], "u string")
    got = [r.p for r in df.selectExpr(f"{S.punycode(sqltext.col('u')).sql} AS p").collect()]
    assert got == [x.encode("punycode").decode() for x in labels]


def test_links_as_the_standard_reads_them(spark):
    from mdforge.operators import urls as UO

    base = "https://host.example/dir/page?q"
    pairs = {
        "a\\b": "https://host.example/dir/a/b", "\\\\other.example\\x": "https://other.example/x", " /a\tb ": "https://host.example/ab", "https:rel": "https://host.example/dir/rel",
        "https:/abs": "https://host.example/abs", "http:other.example/p": "http://other.example/p", "//BÜCHER.example/": "https://xn--bcher-kva.example/", "HTTPS://X.example": "https://x.example/",
        "https://As.Written/": "https://As.Written/", "mailto:a@b": "mailto:a@b", "?x\\y": "https://host.example/dir/page?x\\y", "#f": "https://host.example/dir/page?q#f",
    }
    df = spark.createDataFrame([(k, base) for k in pairs], "raw string, base string")
    got = {r.raw: r.target for r in UO.resolve_links(df).collect()}
    assert got == pairs


def test_keys_of_odd_spellings(spark):
    from mdforge.operators import urls as UO

    urls = ["http://EXAMPLE.com", " http:\\\\example.com\\", "http:example.com:80/", "http://ex%61mple.com/#x", "http://ｅxample.com/./"]
    df = spark.createDataFrame([(u,) for u in [*urls, "http://a％b.com/", "nothing", None]], "url string")
    keys = [r.url_key for r in UO.normalize_urls(df).collect()]
    assert keys[:5] == ["http://example.com/"] * 5 and keys[5:] == [None, None, None]
