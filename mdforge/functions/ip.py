"""IP address columns: IPv4 -> bigint, IPv6 -> 32-char lower hex, blocked-range table.

IPv6 values exceed every Spark numeric type (2^128 > DecimalType(38)), so they are
compared as fixed-width hex strings, which sort like the numbers they spell.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regex import let, sql_str

# ---------------------------------------------------------------------------
# Blocked networks, in the reference's order.
# ---------------------------------------------------------------------------
BLOCKED_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
BLOCKED_V6 = (
    "::/128",
    "::1/128",
    "::ffff:0:0/96",
    "64:ff9b::/96",
    "100::/64",
    "2001::/23",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
)


def _v6hex(n: int) -> str:
    return f"{n:032x}"


def blocked_range_rows() -> list[tuple[int, str, str, str]]:
    """(family, lo, hi, label); IPv4 bounds as 10-digit zero-padded decimal strings
    would also sort, but IPv4 is kept numeric in ``lo4``/``hi4`` for the range join."""
    rows = []
    for cidr in BLOCKED_V4:
        net = ipaddress.ip_network(cidr)
        rows.append((4, str(int(net.network_address)), str(int(net.broadcast_address)), cidr))
    for cidr in BLOCKED_V6:
        net = ipaddress.ip_network(cidr)
        rows.append((6, _v6hex(int(net.network_address)), _v6hex(int(net.broadcast_address)), cidr))
    return rows


RANGES_SCHEMA = T.StructType(
    [
        T.StructField("r_family", T.IntegerType(), False),
        T.StructField("r_lo", T.StringType(), False),
        T.StructField("r_hi", T.StringType(), False),
        T.StructField("r_label", T.StringType(), False),
    ]
)


_RANGES: dict = {}


def blocked_ranges(spark: SparkSession) -> DataFrame:
    """25-row constant table: safe to broadcast (its size never grows with the data)."""
    key = id(spark.sparkContext)
    if key not in _RANGES:
        _RANGES[key] = _blocked_ranges(spark)
    return _RANGES[key]


def _blocked_ranges(spark: SparkSession) -> DataFrame:
    rows = blocked_range_rows()
    df = spark.createDataFrame(rows, RANGES_SCHEMA)
    return (
        df.withColumn("r_lo4", F.when(F.col("r_family") == 4, F.col("r_lo").cast("bigint")))
        .withColumn("r_hi4", F.when(F.col("r_family") == 4, F.col("r_hi").cast("bigint")))
    )


def blocked_ranges_sql() -> str:
    vals = ", ".join(f"({f}, {sql_str(lo)}, {sql_str(hi)}, {sql_str(lbl)})" for f, lo, hi, lbl in blocked_range_rows())
    return (
        f"(SELECT r_family, r_lo, r_hi, r_label, CASE WHEN r_family = 4 THEN CAST(r_lo AS BIGINT) END AS r_lo4, "
        f"CASE WHEN r_family = 4 THEN CAST(r_hi AS BIGINT) END AS r_hi4 FROM (VALUES {vals}) t(r_family, r_lo, r_hi, r_label))"
    )


# ---------------------------------------------------------------------------
# Dotted IPv4 as the policy parses it: exactly four parts, each an integer 0..255
# (an empty part counts as 0, a 0x prefix is hex), else invalid.
# ---------------------------------------------------------------------------
V4_PART_DEC = r"^\+?[0-9]+\z"
V4_PART_HEX = r"^0[xX][0-9a-fA-F]+\z"
# A number of more digits than this (leading zeros aside) is out of every range.
MAX_DIGITS = 11
OUT_OF_RANGE = 1 << 40


def _number(digits: Column, base: int) -> Column:
    """Whole number of any length in base 8, 10 or 16; out of range beyond MAX_DIGITS."""
    sig = F.regexp_replace(digits, "^0+", "")
    value = F.conv(sig, base, 10).cast("bigint")
    return (
        F.when(F.length(sig) > MAX_DIGITS, F.lit(OUT_OF_RANGE).cast("bigint"))
        .when(sig == "", F.lit(0).cast("bigint"))
        .otherwise(value)
    )


def _number_sql(digits: str, base: int) -> str:
    sig = f"ltrim({digits}, '0')"
    if base == 8:
        # Octal digit by digit: DuckDB has no octal cast.
        value = f"list_reduce(list_transform(string_split({sig}, ''), lambda d: CAST(d AS BIGINT)), lambda a, d: a * 8 + d)"
    elif base == 16:
        value = f"TRY_CAST('0x' || {sig} AS BIGINT)"
    else:
        value = f"TRY_CAST({sig} AS BIGINT)"
    return f"(CASE WHEN length({sig}) > {MAX_DIGITS} THEN CAST({OUT_OF_RANGE} AS BIGINT) WHEN {sig} = '' THEN CAST(0 AS BIGINT) ELSE {value} END)"


def _v4_part(p: Column) -> Column:
    t = F.regexp_replace(p, r"^[ \t\n\r]+|[ \t\n\r]+\z", "")
    return (
        F.when(t == "", F.lit(0).cast("bigint"))
        .when(t.rlike(V4_PART_DEC), _number(F.regexp_replace(t, r"^\+", ""), 10))
        .when(t.rlike(V4_PART_HEX), _number(F.regexp_replace(t, "^0[xX]", ""), 16))
    )


def _v4_part_sql(p: str) -> str:
    t = f"regexp_replace({p}, {sql_str(r'^[ \t\n\r]+|[ \t\n\r]+\z')}, '', 'g')"
    return (
        f"list_transform([{t}], lambda t: CASE WHEN t = '' THEN CAST(0 AS BIGINT) "
        f"WHEN regexp_matches(t, {sql_str(V4_PART_DEC)}) THEN {_number_sql("ltrim(t, '+')", 10)} "
        f"WHEN regexp_matches(t, {sql_str(V4_PART_HEX)}) THEN {_number_sql("substr(t, 3)", 16)} END)[1]"
    )


def ipv4_number(addr: Column) -> Column:
    """Dotted quad -> bigint; null when invalid."""
    def body(vals: Column) -> Column:
        ok = (F.size(vals) == 4) & F.forall(vals, lambda v: v.isNotNull() & (v >= 0) & (v <= 255))
        return F.when(ok, F.aggregate(vals, F.lit(0).cast("bigint"), lambda acc, v: acc * 256 + v))

    return let(F.transform(F.split(addr, r"\."), _v4_part), body)


def ipv4_number_sql(e: str) -> str:
    return (
        f"list_transform([list_transform(string_split({e}, '.'), lambda p: {_v4_part_sql('p')})], lambda vals: "
        f"CASE WHEN len(vals) = 4 AND list_bool_and(list_transform(vals, lambda v: v IS NOT NULL AND v >= 0 AND v <= 255)) "
        f"THEN list_reduce(vals, lambda acc, v: acc * 256 + v, CAST(0 AS BIGINT)) END)[1]"
    )


# ---------------------------------------------------------------------------
# IPv6 as the policy parses it: split once on "::", parts read as leading hex
# digits (trailing junk ignored, so zone ids pass), each <= 0xffff.
# Result struct(hex, error).
# ---------------------------------------------------------------------------

def _v6_groups(s: Column) -> Column:
    """array<struct<raw, hex>>; hex null when the part is invalid."""
    def one(p: Column) -> Column:
        run = F.regexp_extract(p, r"^([0-9a-f]*)", 1)
        sig = F.regexp_replace(run, r"^0+", "")
        hexv = F.when((run != "") & (F.length(sig) <= 4), F.lpad(sig, 4, "0"))
        return F.struct(p.alias("raw"), hexv.alias("hex"))

    return F.when(s == "", F.array().cast("array<struct<raw:string,hex:string>>")).otherwise(
        F.transform(F.split(s, ":"), one)
    )


def ipv6_hex(addr: Column) -> Column:
    def split_groups(low: Column) -> Column:
        return let(F.split(low, "::"), lambda pieces: F.struct(
            _v6_groups(F.element_at(pieces, 1)).alias("head"),
            _v6_groups(F.when(F.size(pieces) > 1, F.element_at(pieces, 2)).otherwise(F.lit(""))).alias("tail"),
            low.alias("low"),
        ))

    return let(addr, lambda a: let(split_groups(F.lower(a)), lambda g: _v6_from_groups(a, g["low"], g["head"], g["tail"])))


def _v6_from_groups(addr: Column, low: Column, head: Column, tail: Column) -> Column:
    both = F.concat(head, tail)
    bad = F.filter(both, lambda g: g["hex"].isNull())
    has_dc = F.contains(low, F.lit("::"))
    missing = 8 - F.size(head) - F.size(tail)
    count_ok = F.when(has_dc, missing >= 1).otherwise(F.size(head) == 8)
    hexs = F.concat(
        F.array_join(F.transform(head, lambda g: g["hex"]), ""),
        F.when(has_dc, F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))).otherwise(F.lit("")),
        F.array_join(F.transform(tail, lambda g: g["hex"]), ""),
    )
    error = (
        F.when(F.size(bad) > 0, F.concat(F.lit("Invalid IPv6 address part: "), F.element_at(bad, 1)["raw"]))
        .when(~count_ok, F.concat(F.lit("Invalid IPv6 address: "), addr))
    )
    return F.struct(F.when(error.isNull(), hexs).alias("hex"), error.alias("error"))


def _v6_groups_sql(s: str) -> str:
    return (
        f"CASE WHEN {s} = '' THEN []::STRUCT(raw VARCHAR, hex VARCHAR)[] ELSE list_transform(string_split({s}, ':'), "
        f"lambda p: list_transform([regexp_extract(p, '^([0-9a-f]*)', 1)], lambda run: struct_pack(raw := p, hex := "
        f"CASE WHEN run <> '' AND length(regexp_replace(run, '^0+', '')) <= 4 THEN lpad(regexp_replace(run, '^0+', ''), 4, '0') END))[1]) END"
    )


def ipv6_hex_sql(e: str) -> str:
    head = _v6_groups_sql("pieces[1]")
    tail = _v6_groups_sql("coalesce(pieces[2], '')")
    return (
        f"list_transform([struct_pack(a := {e}, pieces := string_split(lower({e}), '::'))], lambda r: "
        f"list_transform([struct_pack(a := r.a, dc := contains(lower(r.a), '::'), h := list_transform([r.pieces], lambda pieces: {head})[1], "
        f"t := list_transform([r.pieces], lambda pieces: {tail})[1])], lambda s: "
        f"list_transform([struct_pack(s := s, bad := list_filter(s.h || s.t, lambda g: g.hex IS NULL), missing := 8 - len(s.h) - len(s.t))], lambda z: "
        f"list_transform([CASE WHEN len(z.bad) > 0 THEN 'Invalid IPv6 address part: ' || z.bad[1].raw "
        f"WHEN NOT (CASE WHEN z.s.dc THEN z.missing >= 1 ELSE len(z.s.h) = 8 END) THEN 'Invalid IPv6 address: ' || z.s.a END], lambda err: "
        f"struct_pack(hex := CASE WHEN err IS NULL THEN array_to_string(list_transform(z.s.h, lambda g: g.hex), '') || "
        f"CASE WHEN z.s.dc THEN repeat('0000', greatest(z.missing, 0)) ELSE '' END || "
        f"array_to_string(list_transform(z.s.t, lambda g: g.hex), '') END, error := err))[1])[1])[1])[1]"
    )


MAPPED_RE = r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z"


# ---------------------------------------------------------------------------
# IPv4 literal hosts in URLs (the URL standard's number forms): "2130706433",
# "0x7f.1", "0177.0.0.1" and "127.1" all mean 127.0.0.1.
# ---------------------------------------------------------------------------
HOST_NUM_LAST = r"^(?:0[xX][0-9a-fA-F]*|[0-9]+)\z"


def _url_v4_part(p: Column) -> Column:
    return (
        F.when(p.rlike(r"^0[xX][0-9a-fA-F]*\z"), _number(F.regexp_replace(p, "^0[xX]", ""), 16))
        .when(p.rlike(r"^0[0-7]+\z"), _number(p, 8))
        .when(p.rlike(r"^0[0-9]+\z"), F.lit(None).cast("bigint"))
        .when(p.rlike(r"^[0-9]+\z"), _number(p, 10))
    )


def _url_v4_part_sql(p: str) -> str:
    return (
        f"CASE WHEN regexp_matches({p}, {sql_str(r'^0[xX][0-9a-fA-F]*\z')}) THEN {_number_sql(f'substr({p}, 3)', 16)} "
        f"WHEN regexp_matches({p}, {sql_str(r'^0[0-7]+\z')}) THEN {_number_sql(p, 8)} "
        f"WHEN regexp_matches({p}, {sql_str(r'^0[0-9]+\z')}) THEN NULL "
        f"WHEN regexp_matches({p}, {sql_str(r'^[0-9]+\z')}) THEN {_number_sql(p, 10)} END"
    )


def url_host_ipv4(host: Column) -> Column:
    """struct(is_v4, number): is_v4 when the host ends in a number; number null = invalid URL."""
    def trimmed(raw: Column) -> Column:
        return F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)

    return let(let(F.split(host, r"\."), trimmed), lambda parts: let(F.transform(parts, _url_v4_part), lambda vals: _url_v4(parts, vals)))


def _url_v4(parts: Column, vals: Column) -> Column:
    is_v4 = F.element_at(parts, -1).rlike(HOST_NUM_LAST)
    n = F.size(parts)
    init = F.slice(vals, 1, F.greatest(n - 1, F.lit(0)))
    last = F.element_at(vals, -1)
    ok = (
        (n <= 4)
        & F.forall(vals, lambda v: v.isNotNull())
        & F.forall(init, lambda v: v <= 255)
        & (last < F.pow(F.lit(256), 5 - n))
    )
    num = F.aggregate(
        F.transform(init, lambda v, i: v * F.pow(F.lit(256), 3 - i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v
    ) + last
    return F.struct(is_v4.alias("is_v4"), F.when(is_v4 & ok, num).alias("num"))


def url_host_ipv4_sql(h: str) -> str:
    return (
        f"list_transform([string_split({h}, '.')], lambda raw: list_transform([CASE WHEN len(raw) > 1 AND raw[-1] = '' "
        f"THEN raw[1:len(raw) - 1] ELSE raw END], lambda parts: list_transform([list_transform(parts, lambda p: {_url_v4_part_sql('p')})], "
        f"lambda vals: struct_pack(is_v4 := regexp_matches(parts[-1], {sql_str(HOST_NUM_LAST)}), num := CASE WHEN "
        f"regexp_matches(parts[-1], {sql_str(HOST_NUM_LAST)}) AND len(parts) <= 4 AND list_bool_and(list_transform(vals, lambda v: v IS NOT NULL)) "
        f"AND list_bool_and(list_transform(vals[1:len(vals) - 1], lambda v: v <= 255)) AND vals[-1] < pow(256, 5 - len(parts)) "
        f"THEN CAST(coalesce(list_sum(list_transform(vals[1:len(vals) - 1], lambda v, i: v * CAST(pow(256, 4 - i) AS BIGINT))), 0) + vals[-1] AS BIGINT) END))[1])[1])[1]"
    )


def ipv4_dotted(num: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftright(num, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)],
    )


def ipv4_dotted_sql(e: str) -> str:
    return " || '.' || ".join(f"CAST((({e}) >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))


DOTTED_TAIL_RE = r"^(.*:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z"


def v6_literal_serialize(addr: Column) -> Column:
    """A URL's IPv6 host as the URL parser serialises it: a dotted IPv4 tail becomes
    two hex groups, so ``[::ffff:1.2.3.4]`` is judged as ``::ffff:102:304``."""
    low = F.lower(addr)
    tail = F.regexp_extract(low, DOTTED_TAIL_RE, 2)
    n = ipv4_number(tail)
    hexed = F.concat(
        F.regexp_extract(low, DOTTED_TAIL_RE, 1),
        F.format_string("%x:%x", F.shiftright(n, 16), n.bitwiseAND(65535)),
    )
    return F.when((tail != "") & n.isNotNull(), hexed).otherwise(low)


def v6_literal_serialize_sql(e: str) -> str:
    tail = f"regexp_extract(lower({e}), {sql_str(DOTTED_TAIL_RE)}, 2)"
    n = ipv4_number_sql(tail)
    return (
        f"list_transform([struct_pack(t := {tail}, n := {n})], lambda z: CASE WHEN z.t <> '' AND z.n IS NOT NULL THEN "
        f"regexp_extract(lower({e}), {sql_str(DOTTED_TAIL_RE)}, 1) || printf('%x:%x', z.n >> 16, z.n & 65535) ELSE lower({e}) END)[1]"
    )


# ---------------------------------------------------------------------------
# IPv6 hosts of URLs: the address grammar, with nothing left out or added (zone ids,
# a second "::" and stray letters make the URL invalid).
# ---------------------------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H16 = "[0-9A-Fa-f]{1,4}"
_LS32 = rf"(?:{_H16}:{_H16}|{_OCTET}(?:\.{_OCTET}){{3}})"
URL_IPV6_RE = "^(?:" + "|".join(
    [rf"(?:{_H16}:){{6}}{_LS32}"]
    + [rf"(?:(?:{_H16}:){{0,{k}}}{_H16})?::(?:{_H16}:){{{4 - k}}}{_LS32}" for k in range(5)]
    + [rf"::(?:{_H16}:){{5}}{_LS32}", rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}", rf"(?:(?:{_H16}:){{0,6}}{_H16})?::"]
) + r")\z"
