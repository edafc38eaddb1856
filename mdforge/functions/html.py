"""HTML -> article -> Markdown as Catalyst expressions (and the same steps as DuckDB SQL).

Design (the reference delegates these to an external extractor / formatter):

* ``main_content``: drop comments, scripts, styles and boilerplate blocks, then take the
  inner HTML of the element whose text scores best (``dom.best_content``); without a text
  that counts, of the first ``<article>``, else ``<main>``, else ``<body>``, else the whole
  cleaned document. Empty -> null (no article).
* ``html_text``: text content of that HTML, entities decoded, whitespace collapsed.
* ``html_to_markdown``: GFM rendered bottom-up over the element tree (``dom.rendered``):
  ATX headings, paragraphs, ``**bold**``, ``_em_``, inline code, fenced code blocks, links,
  images, ``-`` and numbered lists, ``>`` quotes, pipe tables with alignment, hard line
  breaks, ``~~strike~~``, ``[x]`` task items, ``---`` rules, nested in any depth. An inline
  element without an end tag marks nothing. Text is not Markdown-escaped.

Every step is a built-in expression (``regexp_replace``, ``split``, ``aggregate``), so
extraction runs inside the JVM on each partition with no Python worker. The SQL twins are
ordered rewrites that don't know nesting: they are right for flat articles, such as the
driver's pages have, and serve as their oracle.
"""

from __future__ import annotations

from html.entities import html5
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dom
from .regex import WS, Rx, let, rx_spark, rx_sql, sql_str, trim_ws, trim_ws_sql

# ---------------------------------------------------------------------------
# Character references. Names come from the standard library's HTML table (those that end
# in a semicolon); a no-break space becomes a space. Numeric references (&#8217; /
# &#x2019;) decode to their code point; unknown names and invalid numbers (zero,
# surrogates, beyond U+10FFFF) stay as written. One pass: ``&amp;lt;`` is ``&lt;``.
# ---------------------------------------------------------------------------
NAMED = {name: text for name, text in html5.items() if name.endswith(";")} | {"nbsp;": " "}
ENTITY = r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)"

# Blocks removed before the article is chosen (the test pages carry a script whose
# text contains "</p>", so scripts go first).
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside", "form", "iframe", "svg", "template")
AD_WORDS = "ad|ads|advert|advertisement|banner|sponsor|sponsored|promo|cookie|popup|share|social"

CLEAN_STEPS = (
    Rx(r"(?s)<!--.*?-->", ""),
    Rx(r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    Rx(r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    Rx(r"(?is)<noscript\b[^>]*>.*?</noscript\s*>", ""),
    Rx(r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    Rx(r"(?is)<title\b[^>]*>.*?</title\s*>", ""),
    *(Rx(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in BOILERPLATE_TAGS),
    Rx(rf"(?is)<div\b[^>]*\b(?:class|id)\s*=\s*\"(?:[^\"]*\s)?(?:{AD_WORDS})(?:\s[^\"]*)?\"[^>]*>.*?</div\s*>", ""),
)

# Container preference: article, then main, then body.
CONTAINERS = (
    r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)",
    r"(?is)<main\b[^>]*>(.*?)(?:</main\s*>|\z)",
    r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)",
)
DOC_REST = (Rx(r"(?is)<!doctype[^>]*>", ""), Rx(r"(?is)</?(?:html|body)\b[^>]*>", ""))

TAG = Rx(r"<[^>]*>", "")
COLLAPSE = Rx(WS + r"+", " ")

# An anchor up to its href's value: attributes before it are whole names with whole values,
# so ``data-href`` isn't taken for it.
_ATTR = r"""(?:[ \t\r\n\f/]+[^ \t\r\n\f=>"'/]+(?:[ \t\r\n\f]*=[ \t\r\n\f]*(?:"[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+))?)"""
ANCHOR = rf"""<a{_ATTR}*?[ \t\r\n\f/]+href[ \t\r\n\f]*=[ \t\r\n\f]*"""

# The steps from here to the quotes make the oracle's Markdown of flat articles in SQL; the
# engine's own comes from ``dom``. Only FINAL_STEPS serve both.
# Inline elements: links and line breaks first, then emphasis from the inside, twice.
EMPHASIS = (
    Rx(r"(?is)<(?:i|em)\b[^>]*>([^<]+)</(?:i|em)\s*>", "_{1}_"),
    Rx(r"(?is)<(?:del|s|strike)\b[^>]*>([^<]+)</(?:del|s|strike)\s*>", "~~{1}~~"),
    Rx(r"(?is)<(?:b|strong)\b[^>]*>([^<]+)</(?:b|strong)\s*>", "**{1}**"),
)
INLINE_STEPS = (
    Rx(r"(?is)<img\b[^>]*?\bsrc\s*=\s*\"([^\"]*)\"[^>]*?\balt\s*=\s*\"([^\"]*)\"[^>]*>", "![{2}]({1})"),
    Rx(r"(?is)<img\b[^>]*?\balt\s*=\s*\"([^\"]*)\"[^>]*?\bsrc\s*=\s*\"([^\"]*)\"[^>]*>", "![{1}]({2})"),
    Rx(r"(?is)<img\b[^>]*?\bsrc\s*=\s*\"([^\"]*)\"[^>]*>", "![]({1})"),
    Rx(r"(?is)<input\b[^>]*\bchecked\b[^>]*>", "[x] "),
    Rx(r"(?is)<input\b[^>]*\"checkbox\"[^>]*>", "[ ] "),
    Rx(r"(?is)<code\b[^>]*>([^<]*)</code\s*>", "`{1}`"),
    Rx(rf"""(?is){ANCHOR}"([^"]*)"[^>]*>(.*?)</a\s*>""", "[{2}]({1})"),
    Rx(rf"""(?is){ANCHOR}'([^']*)'[^>]*>(.*?)</a\s*>""", "[{2}]({1})"),
    Rx(rf"""(?is){ANCHOR}([^ \t\r\n\f"'>]+)[^>]*>(.*?)</a\s*>""", "[{2}]({1})"),
    Rx(r"(?i) ?<br\b[^>]*> ?", "\n"),
    *EMPHASIS,
    *EMPHASIS,
)

BLOCK_STEPS = (
    *(Rx(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " {1}\n\n") for n in range(1, 7)),
    Rx(r"(?i)<hr\b[^>]*>", "\n\n---\n\n"),
)

PARA_STEPS = (
    Rx(
        r"(?i)</?(?:p|div|section|article|main|header|footer|figure|figcaption|dl|dt|dd|address"
        r"|details|summary|center|tbody|thead|tfoot|caption)\b[^>]*>",
        "\n\n",
    ),
)

# Code blocks keep their whitespace: it is parked in control characters until the end.
PROTECT = (Rx("\r?\n", "\x01"), Rx(" ", "\x02"), Rx("\t", "\x03"))
UNPROTECT = (Rx("\x01", "\n"), Rx("\x02", " "), Rx("\x03", "\t"), Rx("\x05", "\\|"))

FINAL_STEPS = (
    Rx(r"[ \t]+\n", "\n"),
    Rx(r"\n[ \t]+", "\n"),
    Rx(r" {2,}", " "),
    Rx(r"\n{3,}", "\n\n"),
)


# ---------------------------------------------------------------------------
# Span rewrites: the text between an opening and a closing tag is rewritten by a
# function. ``split`` on the opening tag, then each piece is cut at its first
# closing tag; a missing closing tag runs to the end (as an HTML parser would).
# ---------------------------------------------------------------------------

def _span_sql(e: str, open_pat: str, close_pat: str, inner: Callable[[str], str]) -> str:
    inside = f"regexp_extract(p, {sql_str(r'(?s)^(.*?)' + close_pat)}, 1)"
    after = f"regexp_replace(p, {sql_str(r'(?s)^.*?' + close_pat)}, '')"
    return (
        f"array_to_string(list_transform(regexp_split_to_array({e}, {sql_str(open_pat)}), lambda p, i: "
        f"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, {sql_str(close_pat)}) "
        f"THEN {inner(inside)} || {after} ELSE {inner('p')} END), '')"
    )


# <pre> -> fenced block, whitespace protected.
PRE_OPEN, PRE_CLOSE = r"(?i)<pre\b[^>]*>", r"(?i)</pre\s*>"
PRE_INNER = (Rx(r"(?i)</?code\b[^>]*>", ""), TAG, Rx(r"^\r?\n", ""), Rx(r"\r?\n\z", ""))


def _pre_sql(x: str) -> str:
    body = rx_sql(rx_sql(x, PRE_INNER), PROTECT)
    return f"('\n\n```\x01' || {body} || '\x01```\n\n')"


# Lists: a fold over the list tags keeps the open lists as a stack of next numbers (-1: a
# bullet list). An item starts a line, indented by the markers of the lists around its own;
# an outermost list stands between blank lines. Spaces of the indent are parked like code's.
LIST_TAG = r"(?i)</?(?:ul|ol|menu|li)\b[^>]*>"
OL_START = r"""(?i)[ \t\r\n\f]start[ \t]*=[ \t]*["']?([0-9]{1,9})"""


def _lists_sql(e: str) -> str:
    tags = f"regexp_extract_all(s, {sql_str(LIST_TAG)}, 0)"
    name = "lower(regexp_extract(tag, '^</?([A-Za-z]+)', 1))"
    closes, n, opened = "starts_with(tag, '</')", "len(st.open)", "st.open"
    number = f"(CASE WHEN {n} > 0 THEN {opened}[-1] ELSE -1 END)"
    outer = f"{opened}[1:{n} - 1]"
    indent = f"coalesce(array_to_string(list_transform({outer}, lambda k: CASE WHEN k < 0 THEN '\x02\x02' ELSE '\x02\x02\x02' END), ''), '')"
    marker = f"(CASE WHEN {number} < 0 THEN '- ' ELSE CAST({number} AS VARCHAR) || '. ' END)"
    start = f"(CASE WHEN {name} = 'ol' THEN coalesce(TRY_CAST(nullif(regexp_extract(tag, {sql_str(OL_START)}, 1), '') AS INTEGER), 1) ELSE -1 END)"
    text = (
        f"CASE WHEN {name} = 'li' AND NOT {closes} THEN '\n' || {indent} || {marker} WHEN {name} = 'li' THEN '' "
        f"WHEN {closes} THEN CASE WHEN {n} > 1 THEN '' ELSE '\n\n' END ELSE CASE WHEN {n} > 0 THEN '' ELSE '\n\n' END END"
    )
    then = (
        f"CASE WHEN {name} = 'li' AND NOT {closes} AND {number} >= 0 THEN list_append({outer}, {number} + 1) WHEN {name} = 'li' THEN {opened} "
        f"WHEN {closes} THEN {outer} ELSE list_append({opened}, {start}) END"
    )
    states = f"list_transform({tags}, lambda t: struct_pack(tag := t, out := []::VARCHAR[], open := []::INTEGER[]))"
    fold = (
        f"list_reduce({states}, lambda st, x: list_transform([x.tag], lambda tag: struct_pack(tag := tag, out := list_append(st.out, {text}), open := {then}))[1], "
        f"struct_pack(tag := '', out := ['']::VARCHAR[], open := []::INTEGER[])).out"
    )
    pieces = f"regexp_split_to_array(s, {sql_str(LIST_TAG)})"
    joined = (
        f"list_transform([{fold}], lambda marks: array_to_string(list_transform({pieces}, lambda p, i: marks[i] || "
        f"CASE WHEN ends_with(marks[i], '- ') OR ends_with(marks[i], '. ') THEN regexp_replace(p, '^\\s+', '') ELSE p END), ''))[1]"
    )
    return f"list_transform([{e}], lambda s: CASE WHEN regexp_matches(s, {sql_str(LIST_TAG)}) THEN {joined} ELSE s END)[1]"


# <table> -> GFM pipe table; the first row is the header.
TABLE_OPEN, TABLE_CLOSE = r"(?i)<table\b[^>]*>", r"(?i)</table\s*>"
TR_OPEN = r"(?i)<tr\b[^>]*>"
CELL_OPEN = r"(?i)<t[hd][ >]"
ROW_STEPS = (
    Rx(r"(?is)</tr\s*>.*\z", ""),
    Rx(r"\|", "\x05"),  # a bar of the text, escaped at the end
    Rx(r"\r?\n", " "),
    Rx(r"(?i)</t[hd]\s*>", ""),
    Rx(r"(?i)</?(?:thead|tbody|tfoot|p|div)\b[^>]*>", " "),
    Rx(r"(?i)<t[hd]\b[^>]*>", "|"),
    Rx(r"[ \t\r\n]*\|[ \t\r\n]*", " | "),
    Rx(r"^ ", ""),
    Rx(r"[ \t\r\n]*\z", " |"),
)


def _table_sql(x: str) -> str:
    cells = rx_sql("r", ROW_STEPS)
    n = f"len(regexp_extract_all(r, {sql_str(CELL_OPEN)}, 0))"
    return (
        f"('\n\n' || array_to_string(list_transform(regexp_split_to_array({x}, {sql_str(TR_OPEN)}), lambda r, j: "
        f"CASE WHEN j = 1 THEN '' WHEN j = 2 THEN '\n' || {cells} || '\n|' || repeat(' --- |', {n}) "
        f"ELSE '\n' || {cells} END), '') || '\n\n')"
    )


# <blockquote> (after paragraphs became blank lines) -> every line prefixed by "> " once for
# each quote that is open; stretches inside one quote are joined by a quoted blank line.
BQ_TAG = r"(?i)</?blockquote\b[^>]*>"
GAPS = (Rx(r"\n{3,}", "\n\n"),)


def _quotes_sql(e: str) -> str:
    turns = f"list_transform(regexp_extract_all(s, {sql_str(BQ_TAG)}, 0), lambda t: [CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END])"
    depth = f"list_reduce({turns}, lambda acc, d: list_append(acc, greatest(acc[-1] + d[1], 0)), [0])"
    part = f"CASE WHEN ds[i] > 0 THEN {trim_ws_sql(rx_sql('p', GAPS))} ELSE p END"
    parts = (
        f"list_transform([{depth}], lambda ds: list_filter(list_transform(regexp_split_to_array(s, {sql_str(BQ_TAG)}), "
        f"lambda p, i: struct_pack(p := {part}, d := ds[i])), lambda x: x.d = 0 OR x.p <> ''))[1]"
    )
    lines = "list_transform(string_split(x.p, '\n'), lambda ln: CASE WHEN ln = '' THEN rtrim(repeat('> ', x.d)) ELSE repeat('> ', x.d) || ln END)"
    quoted = f"CASE WHEN x.d > 0 THEN array_to_string({lines}, '\n') ELSE x.p END"
    m = "least(x.d, ps[i - 1].d)"
    gap = f"CASE WHEN i = 1 THEN '' WHEN {m} > 0 THEN '\n' || rtrim(repeat('> ', {m})) || '\n' ELSE '\n\n' END"
    joined = f"list_transform([{parts}], lambda ps: array_to_string(list_transform(ps, lambda x, i: {gap} || {quoted}), ''))[1]"
    return f"list_transform([{e}], lambda s: CASE WHEN regexp_matches(s, {sql_str(BQ_TAG)}) THEN {joined} ELSE s END)[1]"


# ---------------------------------------------------------------------------
# Public column builders (Spark) and their SQL twins (oracle).
# ---------------------------------------------------------------------------

def _code_char(code: Column) -> Column:
    """Character of a numeric reference (``8217`` or ``x2019``); null if out of range."""
    hexa = code.startswith("x") | code.startswith("X")
    # Leading zeros go; what is longer than the largest code point is out of range.
    digits = F.regexp_replace(code, "^[xX]?0*", "")
    v = F.when(F.length(digits) <= 7, F.when(hexa, F.conv(digits, 16, 10)).otherwise(F.nullif(digits, F.lit(""))).cast("long"))
    ok = (v > 0) & (v <= 0x10FFFF) & ~v.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(v), 8, "0")), "UTF-32"))


def _named() -> Column:
    """The table of names as one constant, folded when the plan is made."""
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{t}" for n, t in NAMED.items())), F.lit("\x01"), F.lit("\x02"))


def decode_entities(c: Column) -> Column:
    """All references of a text decoded in one pass."""
    def char(ref: Column) -> Column:
        code = F.regexp_extract(ref, "^#(.*);", 1)
        return F.coalesce(F.when(ref.startswith("#"), _code_char(code)).otherwise(F.try_element_at(_named(), ref)), F.concat(F.lit("&"), ref))

    def body(s: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(s, F.lit(ENTITY), 1), char)
        parts = F.transform(F.arrays_zip(F.split(s, ENTITY).alias("p"), refs.alias("r")), lambda z: F.concat(z["p"], F.coalesce(z["r"], F.lit(""))))
        return F.array_join(parts, "")

    return let(c, lambda s: F.when(s.contains("&"), body(s)).otherwise(s))


def decode_entities_sql(e: str) -> str:
    table = f"MAP([{', '.join(map(sql_str, NAMED))}], [{', '.join(map(sql_str, NAMED.values()))}])"
    digits = "regexp_replace(r, '^#[xX]?0*|;$', '', 'g')"
    number = (
        f"list_transform([CASE WHEN length({digits}) > 7 THEN NULL WHEN starts_with(lower(r), '#x') THEN TRY_CAST('0x' || {digits} AS BIGINT) "
        f"ELSE TRY_CAST({digits} AS BIGINT) END], lambda v: CASE WHEN v > 0 AND v <= 1114111 AND NOT (v BETWEEN 55296 AND 57343) "
        f"THEN chr(CAST(v AS INTEGER)) END)[1]"
    )
    char = f"coalesce(CASE WHEN starts_with(r, '#') THEN {number} ELSE {table}[r] END, '&' || r)"
    return (
        f"list_transform([{e}], lambda s: CASE WHEN contains(s, '&') THEN array_to_string(list_transform("
        f"regexp_split_to_array(s, {sql_str(ENTITY.replace('(', '(?:', 1))}), lambda p, i: p || coalesce(list_transform(regexp_extract_all(s, "
        f"{sql_str(ENTITY)}, 1), lambda r: {char})[i], '')), '') ELSE s END)[1]"
    )


def _plain(c: Column) -> Column:
    return trim_ws(rx_spark(decode_entities(rx_spark(c, (TAG,))), (COLLAPSE,)))


def _plain_sql(e: str) -> str:
    return trim_ws_sql(rx_sql(decode_entities_sql(rx_sql(e, (TAG,))), (COLLAPSE,)))


TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
H1_RE = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"


def page_title(html: Column) -> Column:
    """H1: decoded ``<title>``; else the first ``<h1>`` text; else null."""
    filled = lambda re: let(_plain(F.regexp_extract(html, re, 1)), lambda t: F.when(t != "", t))
    return F.coalesce(filled(TITLE_RE), filled(H1_RE))


def page_title_sql(e: str) -> str:
    t = _plain_sql(f"regexp_extract({e}, {sql_str(TITLE_RE)}, 1)")
    h = _plain_sql(f"regexp_extract({e}, {sql_str(H1_RE)}, 1)")
    return f"coalesce(nullif({t}, ''), nullif({h}, ''))"


def clean_html(html: Column) -> Column:
    """Comments, scripts, styles, head and boilerplate blocks removed."""
    return rx_spark(html, CLEAN_STEPS)


def main_content(cleaned: str) -> Column:
    """H2: article HTML of a column of ``clean_html``; null when nothing is left.

    The element whose text scores best, see ``dom.best_content``; a page without a text
    that counts gives its first ``article``, else ``main``, else ``body``, else all of it.
    """
    text = F.col(cleaned)
    filled = lambda c: let(trim_ws(c), lambda t: F.when(t != "", t))
    return F.coalesce(dom.content_column(cleaned), *[filled(F.regexp_extract(text, p, 1)) for p in CONTAINERS], filled(rx_spark(text, DOC_REST)))


def main_content_sql(e: str) -> str:
    cleaned = rx_sql(e, CLEAN_STEPS)
    picks = [f"nullif({trim_ws_sql(f'regexp_extract(c, {sql_str(p)}, 1)')}, '')" for p in CONTAINERS]
    rest = f"nullif({trim_ws_sql(rx_sql('c', DOC_REST))}, '')"
    # DuckDB has no let-binding in an expression: a one-element list + lambda evaluates `cleaned` once.
    return f"list_transform([{cleaned}], lambda c: coalesce({', '.join(picks)}, {rest}))[1]"


def html_text(content: Column) -> Column:
    """Text content: tags dropped, entities decoded, whitespace collapsed and trimmed."""
    return _plain(content)


def html_text_sql(e: str) -> str:
    return _plain_sql(e)


def finished(markdown: Column) -> Column:
    """Rendered Markdown with references decoded, blank lines settled and parked characters put back."""
    return rx_spark(trim_ws(rx_spark(decode_entities(markdown), FINAL_STEPS)), dom.UNPARK)


def html_to_markdown(content: str) -> Column:
    """H3: GFM Markdown of a column of article HTML, rendered bottom-up over its element tree."""
    return finished(dom.markdown_column(content))


def html_to_markdown_sql(e: str) -> str:
    c = _span_sql(e, PRE_OPEN, PRE_CLOSE, _pre_sql)
    c = rx_sql(c, (COLLAPSE,) + INLINE_STEPS)
    c = _span_sql(c, TABLE_OPEN, TABLE_CLOSE, _table_sql)
    c = rx_sql(c, BLOCK_STEPS)
    c = rx_sql(_lists_sql(c), PARA_STEPS)
    c = _quotes_sql(c)
    c = rx_sql(decode_entities_sql(rx_sql(c, (TAG,))), FINAL_STEPS)
    return rx_sql(trim_ws_sql(c), UNPROTECT)
