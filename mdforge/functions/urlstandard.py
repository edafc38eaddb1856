"""URLs as the URL standard reads them, rewritten in their plain spelling.

``standard`` takes what a browser's parser accepts and this package's patterns don't: white
space around a URL, tabs and newlines inside it, any number and kind of slashes after a
special scheme, backslashes in paths, several ``@``, percent-encoded and international
hosts. Its result has ``scheme://``, an ASCII host and forward slashes. A URL whose host the standard refuses is
only cleaned: its host still holds the character that later steps refuse it for.

International labels are mapped character by character (compatibility forms, full-width
forms, capitals), composed, and encoded with Punycode: folds over a host's characters, run
for hosts with other than ASCII characters only.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql.functions import expr

from . import sqltext as F
from .sqltext import Text, let, replaced

SPECIAL = "https?|wss?|ftp"
#: Already in plain spelling: nothing below changes such a URL.
PLAIN_RE = r"^(?:https?|wss?|ftp)://[a-z0-9.\-]+(?::[0-9]*)?(?:[/?#][^\x00-\x20\\]*)?\z"
#: Characters that a host can't hold once it is decoded and mapped.
FORBIDDEN_RE = "[\\x00-\\x20\"#%/:<>?@\\[\\\\\\]^`{|}\\x7f]"
REFUSED = "%"
#: Dots of other scripts, and characters that a host is read without.
DOTS_RE, IGNORED_RE = "[。．｡]", "[­​⁠﻿᠋-᠍︀-️]"


@functools.cache
def _mapping() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility mapping of single characters, and compositions of two."""
    mapped, composed = {}, {}
    for c in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).lower())
        if plain != ch and "\x01" not in plain and "\x02" not in plain:
            mapped[ch] = plain
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == ch:
                composed[pair] = ch
    return mapped, composed


def _table(entries: dict[str, str]) -> Text:
    """A map as one constant, folded when the plan is made."""
    return F.str_to_map("\x01".join(f"{k}\x02{v}" for k, v in entries.items()), "\x01", "\x02")


def _div(a, b) -> Text:
    return Text(f"({F._sql(a)} div {F._sql(b)})")


def _long(x) -> Text:
    return (x if isinstance(x, Text) else F.lit(x)).cast("bigint")


# Punycode: the parameters are those of its definition.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _digits_of(delta: Text, bias: Text) -> Text:
    """A number in the variable-length digits of Punycode."""
    digit = lambda d: F.substr(_DIGITS, (d + 1).cast("int"), 1)

    def step(state: Text, i: Text) -> Text:
        k = i * _BASE
        t = F.when(k <= bias + _T_MIN, _long(_T_MIN)).when(k >= bias + _T_MAX, _long(_T_MAX)).otherwise(k - bias)

        def one(t: Text) -> Text:
            q = state["q"]
            last = F.struct(q.alias("q"), F.concat(state["s"], digit(q)).alias("s"), F.lit(True).alias("done"))
            more = F.struct(_div(q - t, _BASE - t).alias("q"), F.concat(state["s"], digit(t + (q - t) % (_BASE - t))).alias("s"), F.lit(False).alias("done"))
            return F.when(state["done"], state).when(q < t, last).otherwise(more)

        return let(_long(t), one)

    zero = F.struct(delta.alias("q"), F.lit("").alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(_long(1), _long(13)), zero, step)["s"]


def _adapted(delta: Text, points: Text, first: Text) -> Text:
    """The bias after a number."""
    start = let(F.when(first, _div(delta, _DAMP)).otherwise(_div(delta, 2)), lambda d: d + _div(d, points))
    most = (_BASE - _T_MIN) * _T_MAX // 2
    step = lambda s, _: F.when(s["d"] > most, F.struct(_div(s["d"], _BASE - _T_MIN).alias("d"), (s["k"] + _BASE).alias("k"))).otherwise(s)
    state = F.aggregate(F.sequence(_long(1), _long(8)), F.struct(start.alias("d"), _long(0).alias("k")), step)
    return let(state, lambda s: s["k"] + _div(s["d"] * (_BASE - _T_MIN + 1), s["d"] + _SKEW))


def punycode(label: Text) -> Text:
    """A label's Punycode, without ``xn--``."""

    def encoded(points: Text) -> Text:
        plain = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        basic = _long(F.length(plain))

        def make(n, delta, bias, h, out) -> Text:
            return F.struct(*[x.alias(name) for x, name in ((n, "n"), (delta, "delta"), (bias, "bias"), (h, "h"), (out, "out"))])

        def at_point(state: Text, m: Text) -> Text:
            def at_char(s: Text, c: Text) -> Text:
                points_now = s["h"] + 1
                hit = make(s["n"], _long(0), _adapted(s["delta"], points_now, s["h"] == basic), points_now, F.concat(s["out"], _digits_of(s["delta"], s["bias"])))
                return F.when(c < m, make(s["n"], s["delta"] + 1, s["bias"], s["h"], s["out"])).when(c == m, hit).otherwise(s)

            begun = make(m, state["delta"] + (m - state["n"]) * (state["h"] + 1), state["bias"], state["h"], state["out"])
            return let(F.aggregate(points, begun, at_char), lambda s: make(m + 1, s["delta"] + 1, s["bias"], s["h"], s["out"]))

        zero = make(_long(_FIRST), _long(0), _long(_BIAS), basic, F.when(plain != "", F.concat(plain, F.lit("-"))).otherwise(F.lit("")))
        others = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= _FIRST)))
        return F.aggregate(others, zero, at_point)["out"]

    chars = F.filter(F.split(label, ""), lambda c: c != "")
    return let(F.transform(chars, lambda c: _long(F.ascii(c))), encoded)


def _mapped(host: Text) -> Text:
    """A host with other than ASCII characters as its ASCII form."""
    table, compositions = (_table(x) for x in _mapping())
    one = lambda c: F.coalesce(F.try_element_at(table, c), c)
    plain = F.array_join(F.transform(F.split(F.lower(replaced(host, ((IGNORED_RE, ""), (DOTS_RE, ".")))), ""), one), "")
    joined = lambda acc, c: F.coalesce(F.concat(F.substr(acc, 1, F.length(acc) - 1), F.try_element_at(compositions, F.concat(F.right(acc, 1), c))), F.concat(acc, c))
    composed = F.aggregate(F.split(plain, ""), F.lit(""), joined)
    label = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)
    return F.array_join(F.transform(F.split(F.lower(composed), r"\."), label), ".")


def ascii_host(host: Text) -> Text:
    """Host of a special URL: decoded, mapped, lower-cased; REFUSED if it can't be one."""
    decoded = F.when(host.contains("%"), F.coalesce(F.try_url_decode(F.replace(host, "+", "%2B")), F.lit(REFUSED))).otherwise(host)
    # U+FFFD: bytes that are no UTF-8.
    ascii_ = let(decoded, lambda d: F.when(d.contains("�"), F.lit(REFUSED)).when(d.rlike(r"[^\x00-\x7f]"), _mapped(d)).otherwise(F.lower(d)))
    checked = let(ascii_, lambda h: F.when(h.rlike(FORBIDDEN_RE), F.lit(REFUSED)).otherwise(h))
    return F.when(host.startswith("["), F.lower(host)).otherwise(checked)


def _special(u: Text) -> Text:
    """A URL of a special scheme, trimmed, in plain spelling."""
    def with_rest(rest: Text) -> Text:
        authority = F.regexp_extract(rest, r"^[^/\\?#]*", 0)

        def with_authority(a: Text) -> Text:
            tail = F.substr(rest, F.length(a) + 1)
            path = F.regexp_extract(tail, "^[^?#]*", 0)
            user = F.when(a.contains("@"), F.concat(F.replace(F.regexp_extract(a, "^(.*)@", 1), "@", "%40"), F.lit("@"))).otherwise(F.lit(""))
            place = F.regexp_replace(a, "^.*@", "")
            host = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*)", 0)
            port = F.substr(place, F.length(host) + 1)

            def with_host(h: Text) -> Text:
                scheme = F.lower(F.regexp_extract(u, "^[A-Za-z]+", 0))
                return F.when(h == REFUSED, u).otherwise(F.concat(scheme, F.lit("://"), user, h, port, F.replace(path, "\\", "/"), F.substr(tail, F.length(path) + 1)))

            return let(let(host, ascii_host), with_host)

        return let(authority, with_authority)

    return let(F.regexp_replace(u, r"^[A-Za-z]+:[/\\]*", ""), with_rest)


def standard(url: Text) -> Text:
    """A URL in plain spelling; what has no special scheme is only trimmed and cleaned."""
    clean = replaced(url, ((r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), (r"[\t\n\r]", "")))
    return let(clean, lambda u: F.when(u.rlike(PLAIN_RE), u).when(u.rlike(f"(?i)^(?:{SPECIAL}):"), _special(u)).otherwise(u))


def standard_link(link: Text, base: Text) -> Text:
    """A link as written on a page of ``base``, both special, ready to be resolved.

    A link with the base's own scheme and no two slashes is relative to it; the backslashes of
    a relative link are slashes.
    """
    clean = replaced(link, ((r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), (r"[\t\n\r]", "")))
    scheme = lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    slashes = lambda x: F.concat(F.replace(F.regexp_extract(x, "^[^?#]*", 0), "\\", "/"), F.regexp_extract(x, r"[?#](?s:.*)\z", 0))

    def body(x: Text) -> Text:
        own = scheme(x)
        rest = F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
        relative = (own != "") & (own == scheme(base)) & ~rest.rlike(r"^[/\\][/\\]")
        return (
            F.when(x.rlike(f"(?i)^(?:{SPECIAL}):") & ~relative, standard(x))
            .when(relative, slashes(rest))
            .when(own != "", x)
            .when(x.rlike(r"^[/\\][/\\]"), F.regexp_replace(standard(F.concat(F.lit("http:"), x)), "^http:", ""))
            .otherwise(slashes(x))
        )

    return let(clean, body)


def standard_column(url: str) -> Column:
    """``standard`` of a column."""
    return expr(standard(F.col(url)).sql)


def standard_link_column(link: str, base: str) -> Column:
    """``standard_link`` of two columns."""
    return expr(standard_link(F.col(link), F.col(base)).sql)
