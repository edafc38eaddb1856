"""The reference's URL table plus range edges."""

import ipaddress

import pytest

from mdforge.functions import ip as IP
from mdforge.operators import policy as P

# (url, allowed) from the reference's policy tests, plus our own rows.
URLS = [
    ("file:///etc/passwd", False), ("ftp://example.com/", False), ("http://127.0.0.1/", False),
    ("http://2130706433/", False), ("http://10.0.0.1/", False), ("http://172.16.0.1/", False),
    ("http://192.168.0.1/", False), ("http://169.254.169.254/", False), ("http://[::1]/", False),
    ("http://[fc00::1]/", False), ("http://[fe80::1]/", False), ("http://localhost/", False),
    ("https://example.com/", True), ("http://example.com/", True),
    ("http://user:pw@example.com/", False), ("http://0x7f.1/", False), ("http://mixed.example/", False),
    ("http://[2001:db8::1]/", True), ("http://[::ffff:1.2.3.4]/", False), ("http://nowhere.example/", False),
]
HOSTS = [("localhost", "127.0.0.1", 4, 0), ("localhost", "::1", 6, 1), ("example.com", "93.184.216.34", 4, 0),
         ("mixed.example", "93.184.216.34", 4, 0), ("mixed.example", "10.1.2.3", 4, 1)]


@pytest.fixture(scope="module")
def verdicts(spark):
    ha = spark.createDataFrame(HOSTS, "host string, address string, family int, pos int")
    df = spark.createDataFrame([(u,) for u, _ in URLS], "url string")
    return {r.url: r for r in P.url_policy(df, ha).collect()}


def test_reference_table(verdicts):
    for url, allowed in URLS:
        assert verdicts[url].allowed == allowed, url


def test_messages(verdicts):
    assert verdicts["file:///etc/passwd"].reason == "URL scheme is not allowed: file:"
    assert verdicts["http://2130706433/"].reason == "IP address is not allowed: 127.0.0.1"
    assert verdicts["http://user:pw@example.com/"].reason == "URL credentials are not allowed"
    assert verdicts["http://mixed.example/"].reason == "IP address is not allowed: 10.1.2.3"
    assert verdicts["http://nowhere.example/"].rule == "unresolved"


def _blocked(addr):
    a = ipaddress.ip_address(addr)
    nets = IP.BLOCKED_V4 if a.version == 4 else IP.BLOCKED_V6
    return any(a in ipaddress.ip_network(n) for n in nets)


def test_range_edges_against_python(spark):
    rows = []
    for cidr in IP.BLOCKED_V4 + IP.BLOCKED_V6:
        net = ipaddress.ip_network(cidr)
        lo, hi = int(net.network_address), int(net.broadcast_address)
        for n in (lo, hi, lo - 1, hi + 1):
            if 0 <= n < 2 ** (32 if net.version == 4 else 128):
                rows.append((str(ipaddress.ip_address(n) if net.version == 4 else ipaddress.IPv6Address(n)), net.version))
    rows += [("2001:db8::1", 6), ("8.8.8.8", 4)]
    df = spark.createDataFrame(rows, "address string, family int")
    out = {r.address: r for r in P.address_verdicts(df).collect()}
    for addr, _ in rows:
        assert (out[addr].error is not None) == _blocked(addr), addr


def test_ipv6_parsing_rules(spark):
    df = spark.createDataFrame(
        [("fe80::1%eth0", 6), ("::ffff:8.8.8.8", 6), ("1:2:3", 6), ("1::2::3", 6), ("12345::1", 6), ("1.2.3", 4), ("1.2.3.256", 4)],
        "address string, family int",
    )
    out = {r.address: r.error for r in P.address_verdicts(df).collect()}
    assert out["fe80::1%eth0"] == "IP address is not allowed: fe80::1%eth0"
    assert out["::ffff:8.8.8.8"] is None
    assert out["1:2:3"] == "Invalid IPv6 address: 1:2:3"
    assert out["12345::1"] == "Invalid IPv6 address part: 12345"
    assert out["1.2.3"] == "Invalid IPv4 address: 1.2.3"
    assert out["1.2.3.256"] == "Invalid IPv4 address: 1.2.3.256"


def test_host_policy(spark):
    ha = spark.createDataFrame(HOSTS + [("empty.example", None, 4, 0)], "host string, address string, family int, pos int")
    out = {r.host: r for r in P.host_policy(ha).collect()}
    assert out["example.com"].error is None and out["example.com"].n_addresses == 1
    assert out["localhost"].error == "IP address is not allowed: 127.0.0.1"
    assert out["empty.example"].error == 'Hostname "empty.example" did not resolve'


def test_range_join_is_broadcast(spark):
    df = spark.createDataFrame([("8.8.8.8", 4)], "address string, family int")
    plan = P.address_verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_malformed_urls_are_invalid(spark):
    bad = [
        "http://[2606::1::2]/", "http://[2606:4700::1xyz]/", "http://[2606:4700::1%25eth0]/", "http://example.com:99999/",
        "http://example.com:abc/", "http://example.com:0x50/", "http://[1:2:3]/", "http://[::1.2.3.256]/", "http://example.com:65536/",
    ]
    good = ["http://example.com:65535/", "http://example.com:00080/x", "http://example.com:/", "http://example.com?q", "http://example.com#f",
            "http://[2606:4700::1111]:8080/a", "http://[2606:4700:0:0:0:0:1.2.3.4]/"]
    ha = spark.createDataFrame([("example.com", "93.184.216.34", 4)], "host string, address string, family int")
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    got = {r.url: r.rule for r in P.url_policy(df, ha).collect()}
    assert {u: got[u] for u in bad} == dict.fromkeys(bad, "invalid_url")
    assert {u: got[u] for u in good} == dict.fromkeys(good, "allowed")


def test_zero_padded_numbers(spark):
    ha = spark.createDataFrame([], "host string, address string, family int")
    urls = ["http://00000000000000000000177.0.0.1/", "http://0x000000000000007f.1/", "http://99999999999999999999/"]
    got = {r.url: r.rule for r in P.url_policy(spark.createDataFrame([(u,) for u in urls], "url string"), ha).collect()}
    assert got == {urls[0]: "address", urls[1]: "address", urls[2]: "invalid_url"}


def test_urls_as_the_standard_reads_them(spark):
    ha = spark.createDataFrame([("example.com", "93.184.216.34", 4), ("xn--bcher-kva.de", "93.184.216.35", 4)], "host string, address string, family int")
    allowed = ["  http://example.com/", "http://exa\nmple.com/", "https:example.com", "http:///example.com/", "http:\\\\example.com\\", "http://ex%41mple.com/", "http://ｅｘａｍｐｌｅ.com/", "http://BÜCHER.de/"]
    blocked = ["http://%31%32%37.0.0.1/", "http://１２７.0.0.1/", "http://0x7f。1/", "\thttp:\\\\127.1\\"]
    invalid = ["http://ex%2Fample.com/", "http://example.com＠x/", "http://%ff/", "http://exa mple.com/", "http://a＜b/"]
    other = {"http://a@b@example.com/": "credentials", "javascript:alert(1)": "scheme", " file:///etc/passwd": "scheme"}
    rows = [(u,) for u in [*allowed, *blocked, *invalid, *other]]
    got = {r.url: r for r in P.url_policy(spark.createDataFrame(rows, "url string"), ha).collect()}
    assert {u: got[u].rule for u in allowed} == dict.fromkeys(allowed, "allowed")
    assert {u: got[u].reason for u in blocked} == dict.fromkeys(blocked, "IP address is not allowed: 127.0.0.1")
    assert {u: got[u].rule for u in invalid} == dict.fromkeys(invalid, "invalid_url")
    assert {u: got[u].rule for u in other} == other
    assert got[invalid[0]].reason == "Invalid URL: " + invalid[0]
