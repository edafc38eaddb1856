"""URL column expressions: parts (U1), canonical key (U2), resolution (U4), origin.

Regex extraction rather than ``parse_url``: ``parse_url`` raises under ANSI mode and
``try_parse_url`` rejects hosts such as ``0x7f.1``. Each builder has a DuckDB twin
(``*_sql``) used by the test oracle.

Design rules (the reference's URL normaliser is external):
* scheme and host are lower-cased, the default port (80 / 443) is dropped, an empty
  path of an http(s) URL becomes ``/``, dot segments are removed, the fragment is
  dropped from the canonical key; the query is kept.
* non-ASCII characters and spaces, quotes and angle brackets in a resolved path
  are percent-encoded (UTF-8, upper-case hex), as the URL standard does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let, sql_str

URL_RE = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^:/?#]*)(?::([0-9]*))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
)
PARTS = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")
SPECIAL = ("http", "https")
DEFAULT_PORT = {"http": "80", "https": "443"}
# Hosts the URL standard rejects (space, controls and reserved delimiters).
BAD_HOST_RE = r"[\x00-\x20#/:<>?@\\^|%\[\]]"
NON_ASCII_RE = r"[^\x00-\x7F]"
SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


# ---------------------------------------------------------------------------
# U1 parts
# ---------------------------------------------------------------------------

def _part_of(u: Column, name: str) -> Column:
    raw = F.regexp_extract(u, URL_RE, PARTS.index(name) + 1)
    if name in ("scheme", "host"):
        raw = F.lower(raw)
    return F.nullif(raw, F.lit(""))


def url_part(url: Column, name: str) -> Column:
    """One part; null when the URL does not parse or the part is absent/empty."""
    return _part_of(url, name)


def url_parts(url: Column) -> Column:
    """All parts as one struct (fields named as ``PARTS``), the URL read once."""
    return let(url, lambda u: F.struct(*[_part_of(u, n).alias(n) for n in PARTS]))


def url_part_sql(e: str, name: str) -> str:
    i = PARTS.index(name) + 1
    raw = f"regexp_extract({e}, {sql_str(URL_RE)}, {i})"
    if name in ("scheme", "host"):
        raw = f"lower({raw})"
    return f"nullif({raw}, '')"


def host_unbracketed(host: Column) -> Column:
    return F.regexp_replace(host, r"^\[(.*)\]\z", "$1")


def host_unbracketed_sql(e: str) -> str:
    return f"regexp_replace({e}, {sql_str(r'^\[(.*)\]\z')}, '\\1')"


# ---------------------------------------------------------------------------
# Path helpers: dot segments and percent-encoding
# ---------------------------------------------------------------------------

def remove_dot_segments(path: Column) -> Column:
    return let(path, _remove_dot_segments)


def _remove_dot_segments(path: Column) -> Column:
    segs = F.split(path, "/")
    body = F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0)))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        body,
        empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segs, -1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def remove_dot_segments_sql(e: str) -> str:
    return (
        f"CASE WHEN contains({e}, '/.') THEN list_transform([string_split({e}, '/')], lambda segs: "
        f"'/' || array_to_string(CASE WHEN segs[-1] IN ('.', '..') THEN list_append(("
        f"list_reduce(segs[2:], lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
        f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])), '') ELSE "
        f"list_reduce(segs[2:], lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
        f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[]) END, '/'))[1] ELSE {e} END"
    )


ENCODE_STEPS = ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"))


def encode_path(path: Column) -> Column:
    return let(path, _encode_path)


def _encode_path(path: Column) -> Column:
    out = path
    for ch, enc in ENCODE_STEPS:
        out = F.replace(out, F.lit(ch), F.lit(enc))
    def enc(o: Column) -> Column:
        per_char = F.array_join(
            F.transform(F.split(o, ""), lambda ch: F.when(ch.rlike(NON_ASCII_RE), F.url_encode(ch)).otherwise(ch)), ""
        )
        return F.when(o.rlike(NON_ASCII_RE), per_char).otherwise(o)

    return let(out, enc)


def encode_path_sql(e: str) -> str:
    out = e
    for ch, enc in ENCODE_STEPS:
        out = f"replace({out}, {sql_str(ch)}, {sql_str(enc)})"
    return (
        f"list_transform([{out}], lambda o: CASE WHEN regexp_matches(o, {sql_str(NON_ASCII_RE)}) THEN "
        f"array_to_string(list_transform(string_split(o, ''), lambda ch: CASE WHEN regexp_matches(ch, "
        f"{sql_str(NON_ASCII_RE)}) THEN url_encode(ch) ELSE ch END), '') ELSE o END)[1]"
    )


# ---------------------------------------------------------------------------
# U2 canonical key
# ---------------------------------------------------------------------------

def _compose(scheme: Column, userinfo: Column, host: Column, port: Column, path: Column, query: Column) -> Column:
    default = F.when(scheme == "http", "80").when(scheme == "https", "443")
    port_part = F.when(port.isNull() | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path_fixed = F.when(scheme.isin(*SPECIAL) & ((path.isNull()) | (path == "")), F.lit("/")).otherwise(
        F.coalesce(path, F.lit(""))
    )
    return F.concat(
        scheme,
        F.lit("://"),
        F.when(userinfo.isNotNull(), F.concat(userinfo, F.lit("@"))).otherwise(F.lit("")),
        host,
        port_part,
        path_fixed,
        F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def _compose_sql(scheme: str, userinfo: str, host: str, port: str, path: str, query: str) -> str:
    default = f"(CASE WHEN {scheme} = 'http' THEN '80' WHEN {scheme} = 'https' THEN '443' END)"
    return (
        f"({scheme} || '://' || CASE WHEN {userinfo} IS NOT NULL THEN {userinfo} || '@' ELSE '' END || {host}"
        f" || CASE WHEN {port} IS NULL OR {port} = {default} THEN '' ELSE ':' || {port} END"
        f" || CASE WHEN {scheme} IN ('http', 'https') AND ({path} IS NULL OR {path} = '') THEN '/' "
        f"ELSE coalesce({path}, '') END"
        f" || CASE WHEN {query} IS NOT NULL THEN '?' || {query} ELSE '' END)"
    )


def normalize_url(url: Column) -> Column:
    """Canonical key; null when the URL does not parse as scheme://host."""

    def body(u: Column) -> Column:
        def with_parts(s: Column) -> Column:
            p = {n: s[n] for n in PARTS}
            ok = p["scheme"].isNotNull() & p["host"].isNotNull() & F.contains(u, F.lit("://"))
            path = remove_dot_segments(F.coalesce(p["path"], F.lit("")))
            return F.when(ok, _compose(p["scheme"], p["userinfo"], p["host"], p["port"], path, p["query"]))

        return let(url_parts(u), with_parts)

    return let(url, body)


def normalize_url_sql(e: str) -> str:
    p = {n: url_part_sql("u", n) for n in PARTS}
    path = remove_dot_segments_sql(f"coalesce({p['path']}, '')")
    body = _compose_sql(p["scheme"], p["userinfo"], p["host"], p["port"], path, p["query"])
    return (
        f"list_transform([{e}], lambda u: CASE WHEN {p['scheme']} IS NOT NULL AND {p['host']} IS NOT NULL "
        f"AND contains(u, '://') THEN {body} END)[1]"
    )


# ---------------------------------------------------------------------------
# U5 origin
# ---------------------------------------------------------------------------

def url_origin(url: Column) -> Column:
    """``scheme://host[:port]`` for http(s) URLs with a valid host; else null."""
    return let(url, lambda u: let(url_parts(u), lambda s: _origin(u, s["scheme"], s["host"], s["port"])))


def _origin(url: Column, scheme: Column, host: Column, port: Column) -> Column:
    good = (
        scheme.isin(*SPECIAL)
        & host.isNotNull()
        & F.contains(url, F.lit("://"))
        & ~host_unbracketed(host).rlike(BAD_HOST_RE)
    )
    default = F.when(scheme == "http", "80").otherwise("443")
    port_part = F.when(port.isNull() | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(good, F.concat(scheme, F.lit("://"), host, port_part))


def url_origin_sql(e: str) -> str:
    s, h, p = url_part_sql("u", "scheme"), url_part_sql("u", "host"), url_part_sql("u", "port")
    return (
        f"list_transform([{e}], lambda u: CASE WHEN {s} IN ('http', 'https') AND {h} IS NOT NULL AND contains(u, '://') "
        f"AND NOT regexp_matches({host_unbracketed_sql(h)}, {sql_str(BAD_HOST_RE)}) THEN {s} || '://' || {h} || "
        f"CASE WHEN {p} IS NULL OR {p} = (CASE WHEN {s} = 'http' THEN '80' ELSE '443' END) THEN '' ELSE ':' || {p} END END)[1]"
    )


# ---------------------------------------------------------------------------
# U4 resolution of a link against a base URL
# ---------------------------------------------------------------------------

def _split_ref(link: Column):
    """(path, query-with-?, fragment-with-#) of a relative reference."""
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    query = F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1)
    frag = F.regexp_extract(link, r"^[^#]*(#.*)\z", 1)
    return path, query, frag


def _split_ref_sql(e: str):
    return (
        f"regexp_extract({e}, {sql_str(r'^([^?#]*)')}, 1)",
        f"regexp_extract({e}, {sql_str(r'^[^?#]*(\?[^#]*)')}, 1)",
        f"regexp_extract({e}, {sql_str(r'^[^#]*(#.*)\z')}, 1)",
    )


def resolve_url(link: Column, base: Column, keep_absolute_raw: bool = True) -> Column:
    """U4: absolute URL of ``link`` against ``base``; null when it cannot be resolved.

    ``keep_absolute_raw`` keeps links that start with ``http://`` / ``https://``
    (case-sensitive) exactly as written, the rule of the Markdown link extractor.
    """
    def outer(r: Column) -> Column:
        return let(url_parts(r["base"]), lambda bs: let(
            F.regexp_replace(r["link"], r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), lambda lk: _resolve(lk, bs)))

    resolved = let(F.struct(link.alias("link"), base.alias("base")), outer)
    if keep_absolute_raw:
        return F.when(link.startswith("http://") | link.startswith("https://"), link).otherwise(resolved)
    return resolved


def _resolve(lk: Column, bs: Column) -> Column:
    b = {n: bs[n] for n in PARTS}
    base_ok = b["scheme"].isin(*SPECIAL) & b["host"].isNotNull()
    default = F.when(b["scheme"] == "http", "80").otherwise("443")
    authority = F.concat(
        b["scheme"],
        F.lit("://"),
        F.when(b["userinfo"].isNotNull(), F.concat(b["userinfo"], F.lit("@"))).otherwise(F.lit("")),
        b["host"],
        F.when(b["port"].isNull() | (b["port"] == default), F.lit("")).otherwise(F.concat(F.lit(":"), b["port"])),
    )
    base_path = F.coalesce(F.nullif(b["path"], F.lit("")), F.lit("/"))
    base_query = F.when(b["query"].isNotNull(), F.concat(F.lit("?"), b["query"])).otherwise(F.lit(""))
    base_dir = F.regexp_extract(base_path, r"^(.*/)", 1)

    path, query, frag = _split_ref(lk)

    def finish(p: Column, q: Column, f: Column) -> Column:
        return F.concat(authority, encode_path(remove_dot_segments(p)), encode_path(q), encode_path(f))

    has_scheme = lk.rlike(SCHEME_RE)
    link_scheme = F.lower(F.regexp_extract(lk, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    absolute_special = normalize_url(F.concat(link_scheme, F.regexp_replace(lk, SCHEME_RE, ":")))
    absolute_special_frag = F.concat(
        absolute_special, encode_path(F.regexp_extract(lk, r"^[^#]*(#.*)\z", 1))
    )
    scheme_rel = normalize_url(F.concat(b["scheme"], F.lit(":"), lk))
    scheme_rel_frag = F.concat(scheme_rel, encode_path(F.regexp_extract(lk, r"^[^#]*(#.*)\z", 1)))

    resolved = (
        F.when(~base_ok, F.lit(None).cast("string"))
        .when(has_scheme & link_scheme.isin(*SPECIAL), F.when(absolute_special.isNotNull(), absolute_special_frag))
        .when(has_scheme, F.concat(link_scheme, F.regexp_replace(lk, SCHEME_RE, ":")))
        .when(lk.startswith("//"), F.when(scheme_rel.isNotNull(), scheme_rel_frag))
        .when(lk.startswith("/"), finish(path, query, frag))
        .when(lk == "", F.concat(authority, encode_path(base_path), base_query))
        .when(lk.startswith("?"), F.concat(authority, encode_path(base_path), encode_path(query), encode_path(frag)))
        .when(lk.startswith("#"), F.concat(authority, encode_path(base_path), base_query, encode_path(frag)))
        .otherwise(finish(F.concat(base_dir, path), query, frag))
    )
    return resolved


def resolve_url_sql(link: str, base: str, keep_absolute_raw: bool = True) -> str:
    b = {n: url_part_sql("b", n) for n in PARTS}
    authority = (
        f"({b['scheme']} || '://' || CASE WHEN {b['userinfo']} IS NOT NULL THEN {b['userinfo']} || '@' ELSE '' END"
        f" || {b['host']} || CASE WHEN {b['port']} IS NULL OR {b['port']} = (CASE WHEN {b['scheme']} = 'http' "
        f"THEN '80' ELSE '443' END) THEN '' ELSE ':' || {b['port']} END)"
    )
    base_path = f"coalesce(nullif({b['path']}, ''), '/')"
    base_query = f"(CASE WHEN {b['query']} IS NOT NULL THEN '?' || {b['query']} ELSE '' END)"
    base_dir = f"regexp_extract({base_path}, '^(.*/)', 1)"
    path, query, frag = _split_ref_sql("lk")

    def finish(p: str, q: str, f: str) -> str:
        return f"({authority} || {encode_path_sql(remove_dot_segments_sql(p))} || {encode_path_sql(q)} || {encode_path_sql(f)})"

    link_scheme = f"lower(regexp_extract(lk, {sql_str(r'^([A-Za-z][A-Za-z0-9+.\-]*):')}, 1))"
    rest = f"regexp_replace(lk, {sql_str(SCHEME_RE)}, ':')"
    frag_of = f"{encode_path_sql(f'regexp_extract(lk, {sql_str(r'^[^#]*(#.*)\z')}, 1)')}"
    abs_special = normalize_url_sql(f"({link_scheme} || {rest})")
    scheme_rel = normalize_url_sql(f"({b['scheme']} || ':' || lk)")
    resolved = (
        f"CASE WHEN NOT ({b['scheme']} IN ('http', 'https') AND {b['host']} IS NOT NULL) THEN NULL "
        f"WHEN regexp_matches(lk, {sql_str(SCHEME_RE)}) AND {link_scheme} IN ('http', 'https') THEN "
        f"(CASE WHEN {abs_special} IS NOT NULL THEN {abs_special} || {frag_of} END) "
        f"WHEN regexp_matches(lk, {sql_str(SCHEME_RE)}) THEN {link_scheme} || {rest} "
        f"WHEN starts_with(lk, '//') THEN (CASE WHEN {scheme_rel} IS NOT NULL THEN {scheme_rel} || {frag_of} END) "
        f"WHEN starts_with(lk, '/') THEN {finish(path, query, frag)} "
        f"WHEN lk = '' THEN {authority} || {encode_path_sql(base_path)} || {base_query} "
        f"WHEN starts_with(lk, '?') THEN {authority} || {encode_path_sql(base_path)} || {encode_path_sql(query)} || {encode_path_sql(frag)} "
        f"WHEN starts_with(lk, '#') THEN {authority} || {encode_path_sql(base_path)} || {base_query} || {encode_path_sql(frag)} "
        f"ELSE {finish(f'({base_dir} || {path})', query, frag)} END"
    )
    body = (
        f"list_transform([struct_pack(lk := regexp_replace({link}, {sql_str(r'^[\x00-\x20]+|[\x00-\x20]+\z')}, '', 'g'), "
        f"b := {base})], lambda r: list_transform([r.lk], lambda lk: list_transform([r.b], lambda b: {resolved})[1])[1])[1]"
    )
    if keep_absolute_raw:
        return f"(CASE WHEN starts_with({link}, 'http://') OR starts_with({link}, 'https://') THEN {link} ELSE {body} END)"
    return body
