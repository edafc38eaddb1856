"""M1-M4 and H5 on the link rules of the Markdown extractor."""


from mdforge.operators import links as L

MD = ('[t](http://x.com/a "title") ![alt](/img.png) [![i](/in.png)](/page) [h](#top) [m](mailto:a@b) [p](tel:1) '
      "[j](javascript:void(0)) [u](HTTP://Y.com/Z) see https://z.org/p. and [](/empty) [r](rel/x)")
BASE = "http://x.com/dir/index.html"


def test_page_links_order_and_rules(spark):
    df = spark.createDataFrame([(1, MD, BASE)], "page_id long, markdown string, url string")
    got = [r.link for r in L.page_links(df).orderBy("pos").collect()]
    assert got == [
        'http://x.com/a "title"',
        "http://x.com/img.png",
        "http://x.com/in.png",
        "javascript:void(0",  # the target stops at the first ")"
        "http://y.com/Z",
        "http://x.com/dir/rel/x",
        "http://x.com/a",
        "https://z.org/p.",
    ]


def test_link_edges_same_origin(spark):
    df = spark.createDataFrame([(1, MD, BASE)], "page_id long, markdown string, url string")
    got = [r.dst for r in L.link_edges(df).orderBy("pos").collect()]
    # A title stays in the target; the path is still a same-origin URL.
    assert got == ['http://x.com/a "title"', "http://x.com/img.png", "http://x.com/in.png", "http://x.com/dir/rel/x", "http://x.com/a"]


def test_dom_links(spark):
    html = '<a href="/a">a</a><a href="/a#x">b</a><a href="mailto:z@z">m</a><a href="/a">dup</a>'
    df = spark.createDataFrame([(1, html, "https://s.com/p")], "page_id long, html string, url string")
    assert [r.link for r in L.dom_links(df).orderBy("pos").collect()] == ["https://s.com/a", "https://s.com/a#x"]
