"""The element tree of a page as Catalyst folds: events, scores of elements, block Markdown.

``events`` folds a page's tags with a stack of open elements into properly nested events:
end tags that HTML lets a page leave out are added (``p`` before a block, ``li`` before
``li``, cells and rows, everything at the end), end tags without an open element are
dropped. Two further folds run over the events, each with a stack of its own:

* ``best_content`` scores elements by the text inside them. Every run of text between two
  block tags counts by its length and commas for the element around it, half for the next
  one and less for up to three more; an element's score is lowered by the share of its
  text that is link text.
* ``markdown`` renders bottom-up: an element that closes turns its children's Markdown into
  its own and hands it to its parent, so emphasis, lists, quotes and cells nest at will.

All are array expressions, evaluated on the page's own partition. A fold keeps only its
stack and its output; the output array is copied as it grows, which is quadratic in the
number of a page's tags, but in references, not in text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql.functions import expr

from . import sqltext as F
from .regex import WS, WS_CHARS, Rx
from .sqltext import Text, bind, let, replaced, trimmed, where_found

VOID = ("br", "hr", "img", "input", "wbr")
INLINE = ("a", "b", "strong", "i", "em", "del", "s", "strike", "code")
LISTS, CELLS, HEADINGS = ("ul", "ol", "menu"), ("td", "th"), ("h1", "h2", "h3", "h4", "h5", "h6")
TABLE_PARTS = ("table", "caption", "thead", "tbody", "tfoot", "tr", *CELLS)
#: Elements that may hold the article, and blocks whose text counts for the element around them.
CONTAINERS = ("article", "main", "section", "div", "body", "center", "details", "figure", "address", *CELLS)
TEXT_BLOCKS = ("p", "pre", "blockquote", "li", "dd", "dt", "summary", "figcaption", "caption", *HEADINGS)
BLOCKS = tuple(dict.fromkeys((*CONTAINERS, *TEXT_BLOCKS, *LISTS, *TABLE_PARTS, "dl", "header", "footer")))

# A start tag that an open element can't contain closes it: (these names, when one of these
# opens, unless one of those has been opened since).
IMPLIED = (
    (("p",), (*BLOCKS, "hr"), ("table", "caption", *CELLS)),
    (("li",), ("li",), (*LISTS, *CELLS)),
    (("dt", "dd"), ("dt", "dd"), ("dl", *CELLS)),
    (CELLS, (*CELLS, "tr", "thead", "tbody", "tfoot"), ("table",)),
    (("tr", "caption"), ("tr", "thead", "tbody", "tfoot"), ("table",)),
    (("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot"), ("table",)),
    (("a",), ("a",), ("table", *CELLS)),
)

EVENT = "struct<k:string,id:int,parent:int,depth:int,tag:string,raw:string,text:string,at:int>"
_OPEN = "struct<id:int,tag:string>"


def _tag_re(names: tuple[str, ...]) -> str:
    """Tags of these names; a quoted attribute value may hold ``>``."""
    rest = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
    return rf"(?i)</?(?:{'|'.join(sorted(names, key=lambda x: (-len(x), x)))})(?=[\s/>]){rest}"


def trim_ws(text: Text) -> Text:
    return trimmed(text, WS_CHARS)


def _empty(kind: str) -> Text:
    return F.array().cast(f"array<{kind}>")


def _last(stack: Text, test: Callable[[Text], Text]) -> Text:
    """1-based place of the last element of a stack that passes, 0 if none does."""
    return F.coalesce(F.array_max(F.transform(stack, lambda f, i: F.when(test(f), i + 1).otherwise(F.lit(0)))), F.lit(0))


def _event(k: str, id: Text, parent: Text, depth: Text, tag: Text, raw: Text, text: Text, at: Text) -> Text:
    return F.struct(F.lit(k).alias("k"), id.cast("int").alias("id"), parent.cast("int").alias("parent"), depth.cast("int").alias("depth"), tag.alias("tag"), raw.alias("raw"), text.alias("text"), at.cast("int").alias("at"))


def events(html: Text, names: tuple[str, ...]) -> Text:
    """array<EVENT> of the elements ``names`` of a page, nested properly.

    ``k`` is ``o`` (element opens), ``c`` (closes; ``raw`` is empty if its end tag is
    missing), ``v`` (element without content) or ``t`` (text, other tags included). Elements
    are numbered from 1 in document order; ``parent`` is 0 and ``depth`` 1 at the top.
    ``at`` is the offset in the page where an element's content begins or ends.
    """
    tag_re = _tag_re(names)
    inline = tuple(x for x in names if x in INLINE)

    top = lambda stack: F.try_element_at(stack, -1)["tag"]  # noqa: E731  the usual place, looked at before the stack is searched

    def implied(stack: Text, name: Text) -> Text:
        """Place of the lowest element that a start tag closes; 0 if it closes none."""
        places = []
        for closed, by, scope in IMPLIED:
            own = _last(stack, lambda f, closed=closed: f["tag"].isin(*closed))
            fence = _last(stack, lambda f, scope=scope: f["tag"].isin(*scope))
            searched = let(own, lambda o, fence=fence: F.when(o > 0, F.when(o > fence, o)))
            places.append(F.when(name.isin(*by), F.when(top(stack).isin(*closed), F.size(stack)).otherwise(searched)))
        return F.coalesce(F.least(*places), F.lit(0))

    def ended(stack: Text, name: Text) -> Text:
        """Place of the element that an end tag closes; 0 if it closes none."""
        own = _last(stack, lambda f: f["tag"] == name)
        blocks = _last(stack, lambda f: ~f["tag"].isin(*inline)) if inline else F.lit(0)
        cells = _last(stack, lambda f: f["tag"].isin(*CELLS, "caption"))
        fence = F.when(name.isin(*inline), blocks).when(name.isin(*TABLE_PARTS), F.lit(0)).otherwise(cells) if inline else F.when(name.isin(*TABLE_PARTS), F.lit(0)).otherwise(cells)
        searched = let(own, lambda o: F.when(o > 0, F.when(o > fence, o)))
        return F.when(top(stack) == name, F.size(stack)).otherwise(F.coalesce(searched, F.lit(0)))

    def step(state: Text, token: Text) -> Text:
        stack, size, pos = state["open"], F.size(state["open"]), state["pos"]
        raw, text = token["g"], token["t"]
        above = lambda s: F.coalesce(F.element_at(s, -1)["id"], F.lit(0))
        texts = F.when(text != "", F.array(_event("t", F.lit(0), F.when(size > 0, above(stack)).otherwise(F.lit(0)), size + 1, F.lit(""), F.lit(""), text, pos))).otherwise(_empty(EVENT))

        def after(x: Text) -> Text:
            """x: struct(name, from): elements from place ``from`` on close (0: none does)."""
            name, start = x["name"], x["from"]
            end_tag, at = raw.startswith("</"), pos + F.length(text)
            closes = F.when(
                start > 0,
                F.reverse(F.transform(F.slice(stack, F.greatest(start, F.lit(1)), size), lambda f, i: _event("c", f["id"], F.lit(0), start + i, f["tag"], F.when(end_tag & (i == 0), raw).otherwise(F.lit("")), F.lit(""), at))),
            ).otherwise(_empty(EVENT))
            left = F.when(start > 0, F.slice(stack, 1, F.greatest(start - 1, F.lit(0)))).otherwise(stack)
            opens = (raw != "") & ~end_tag
            void = name.isin(*VOID)
            number = state["n"] + 1
            parent = F.when(F.size(left) > 0, above(left)).otherwise(F.lit(0))
            new = F.array(F.when(void, _event("v", number, parent, F.size(left) + 1, name, raw, F.lit(""), at)).otherwise(_event("o", number, parent, F.size(left) + 1, name, raw, F.lit(""), at + F.length(raw))))
            return F.struct(
                F.when(opens & ~void, F.concat(left, F.array(F.struct(number.cast("int").alias("id"), name.alias("tag"))))).otherwise(left).alias("open"),
                F.when(opens, number).otherwise(state["n"]).cast("int").alias("n"),
                (at + F.length(raw)).cast("int").alias("pos"),
                F.concat(state["ev"], texts, closes, F.when(opens, new).otherwise(_empty(EVENT))).alias("ev"),
            )

        def named(name: Text) -> Text:
            start = F.when(raw == "", F.when(size > 0, F.lit(1)).otherwise(F.lit(0))).when(raw.startswith("</"), ended(stack, name)).otherwise(implied(stack, name))
            return bind(F.struct(name.alias("name"), start.cast("int").alias("from")), state, after)

        return bind(F.lower(F.regexp_extract(raw, "^</?([A-Za-z0-9]+)", 1)), state, named)

    def body(s: Text) -> Text:
        tokens = F.arrays_zip(F.split(s, tag_re).alias("t"), F.concat(F.regexp_extract_all(s, F.lit(tag_re), 0), F.array(F.lit(""))).alias("g"))
        zero = F.struct(_empty(_OPEN).alias("open"), F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("pos"), _empty(EVENT).alias("ev"))
        return F.aggregate(tokens, zero, step)["ev"]

    return let(html, body)


# ---------------------------------------------------------------------------
# Scores: which element holds the article
# ---------------------------------------------------------------------------
#: Characters that a run of text needs to count, and levels above it that it counts for.
LEAST_TEXT, LEVELS = 25, 5
#: Score that an element starts with, by tag and by words in its class or id.
TAG_SCORE = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 2.0, "td": 1.0, "address": -3.0, "th": -5.0}
NAME_SCORE = 25.0
GOOD_NAMES = r"""(?i)\b(?:class|id)\s*=\s*["']?[^"'>]*(?:article|content|entry|main|post|story|body)"""
BAD_NAMES = r"""(?i)\b(?:class|id)\s*=\s*["']?[^"'>]*(?:comment|foot|related|sidebar|teaser|widget|banner|promo|share|menu|masthead)"""
#: Points that an element beside the best one needs to be taken too: a share of its points, and a least.
BESIDE_SHARE, BESIDE_LEAST = 0.2, 5.0

_FRAME = "struct<id:int,tag:string,raw:string,start:int,text:bigint,link:bigint,score:double>"
_FOUND = "struct<id:int,parent:int,tag:string,start:int,stop:int,points:double,score:double>"
_SCORED_NAMES = (*BLOCKS, "a")
#: White space that isn't a single space already.
SPACES = WS + "{2,}|[\\t\\r\\n\\f\\x0B]"
_PLAIN = (Rx(r"<[^>]*>", ""), Rx(SPACES, " "))


def _base(tag: Text, raw: Text) -> Text:
    by_tag = F.lit(0.0)
    for name, score in TAG_SCORE.items():
        by_tag = F.when(tag == name, F.lit(score)).otherwise(by_tag)
    named = F.when(raw.rlike(GOOD_NAMES), F.lit(NAME_SCORE)).otherwise(F.lit(0.0)) - F.when(raw.rlike(BAD_NAMES), F.lit(NAME_SCORE)).otherwise(F.lit(0.0))
    return by_tag + named


def element_scores(evs: Text) -> Text:
    """array<id, parent, tag, start, stop, score> of the containers that hold text, as they close."""

    def flushed(stack: Text, run: Text) -> Text:
        """The stack after a run of text: it counts for the elements around it."""
        points = F.when(run["text"] >= LEAST_TEXT, 1.0 + run["commas"] + F.least(F.floor(run["text"] / 100), F.lit(3))).otherwise(F.lit(0.0))
        n = F.size(stack)
        level0 = n - F.when((n > 0) & F.element_at(stack, -1)["tag"].isin(*TEXT_BLOCKS), F.lit(1)).otherwise(F.lit(0))

        def add(f: Text, i: Text) -> Text:
            level = level0 - 1 - i
            part = F.when(level == 0, F.lit(1.0)).when(level == 1, F.lit(0.5)).when((level > 1) & (level < LEVELS), 1.0 / (3.0 * level)).otherwise(F.lit(0.0))
            last = i == n - 1
            return F.struct(
                f["id"].alias("id"), f["tag"].alias("tag"), f["raw"].alias("raw"), f["start"].alias("start"),
                (f["text"] + F.when(last, run["text"]).otherwise(F.lit(0))).alias("text"),
                (f["link"] + F.when(last, run["link"]).otherwise(F.lit(0))).alias("link"),
                (f["score"] + part * points).alias("score"),
            )

        return F.when((run["text"] > 0) & (n > 0), F.transform(stack, add)).otherwise(stack)

    no_run = F.struct(F.lit(0).cast("bigint").alias("text"), F.lit(0).cast("bigint").alias("link"), F.lit(0).cast("bigint").alias("commas"))

    def make(open: Text, run: Text, linked: Text, found: Text) -> Text:
        return F.struct(open.alias("open"), run.alias("run"), linked.cast("int").alias("linked"), found.alias("found"))

    def step(state: Text, e: Text) -> Text:
        run, linked, found = state["run"], state["linked"], state["found"]

        def text(t: Text) -> Text:
            n = F.length(t).cast("bigint")
            more = F.struct(
                (run["text"] + n).alias("text"),
                (run["link"] + F.when(linked > 0, n).otherwise(F.lit(0))).alias("link"),
                (run["commas"] + n - F.length(F.replace(t, F.lit(","), F.lit("")))).alias("commas"),
            )
            return make(state["open"], more, linked, found)

        def close(stack: Text) -> Text:
            n = F.size(stack)
            f = F.element_at(stack, -1)
            outer = F.slice(stack, 1, n - 1)
            up = F.transform(outer, lambda g, i: F.struct(
                g["id"].alias("id"), g["tag"].alias("tag"), g["raw"].alias("raw"), g["start"].alias("start"),
                (g["text"] + F.when(i == n - 2, f["text"]).otherwise(F.lit(0))).alias("text"),
                (g["link"] + F.when(i == n - 2, f["link"]).otherwise(F.lit(0))).alias("link"),
                g["score"].alias("score"),
            ))
            plain = 1.0 - f["link"] / f["text"]
            points, score = f["score"] * plain, (f["score"] + _base(f["tag"], f["raw"])) * plain
            own = F.struct(f["id"].alias("id"), F.when(n > 1, F.try_element_at(stack, n - 1)["id"]).otherwise(F.lit(0)).alias("parent"), f["tag"].alias("tag"), f["start"].alias("start"), e["at"].alias("stop"), points.alias("points"), score.alias("score"))
            holds = f["tag"].isin(*CONTAINERS) & (f["score"] > 0)
            return make(up, no_run, linked, F.when(holds, F.concat(found, F.array(own))).otherwise(found))

        def open_(stack: Text) -> Text:
            zero = F.lit(0).cast("bigint")
            new = F.struct(e["id"].alias("id"), e["tag"].alias("tag"), e["raw"].alias("raw"), e["at"].alias("start"), zero.alias("text"), zero.alias("link"), F.lit(0.0).alias("score"))
            return make(F.concat(stack, F.array(new)), no_run, linked, found)

        return (
            F.when(e["k"] == "t", bind(where_found(trim_ws(e["text"]), _PLAIN), state, text))
            .when(e["tag"] == "a", make(state["open"], run, linked + F.when(e["k"] == "o", F.lit(1)).otherwise(F.lit(-1)), found))
            .when(e["k"] == "o", bind(flushed(state["open"], run), state, open_))
            .otherwise(bind(flushed(state["open"], run), state, close))
        )

    zero = make(_empty(_FRAME), no_run, F.lit(0), _empty(_FOUND))
    return F.aggregate(evs, zero, step)["found"]


def best_content(html: Text) -> Text:
    """Inner HTML of the element that holds the article; null if no element has a score.

    The best element is widened to the ``article`` around it, else to the ``main``. Elements
    beside it, in the same parent, come too if their points are a fifth of its own at least
    and neither their tag nor their name takes all of them away. Text outside of every container has no score.
    """

    def chosen(found: Text) -> Text:
        def best(top: Text) -> Text:
            around = F.filter(found, lambda x: (x["start"] <= top["start"]) & (x["stop"] >= top["stop"]))
            innermost = lambda tag: F.element_at(F.array_sort(F.transform(F.filter(around, lambda x: x["tag"] == tag), lambda x: F.struct((-x["start"]).alias("s"), x.alias("x")))), 1)["x"]
            inside = lambda tag: F.exists(around, lambda x: x["tag"] == tag)
            wide = F.when(inside("article"), innermost("article")).when(inside("main"), innermost("main")).otherwise(top)

            def beside(w: Text) -> Text:
                least = F.greatest(F.lit(BESIDE_LEAST), top["points"] * BESIDE_SHARE)
                own = F.filter(found, lambda x: (x["id"] == w["id"]) | ((x["parent"] == w["parent"]) & (x["points"] >= least) & (x["score"] > 0)))
                return F.array_sort(F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))

            return let(wide, beside)

        ranked = F.array_max(F.transform(found, lambda x: F.struct(x["score"].alias("score"), (-x["start"]).alias("s"), x.alias("x"))))
        return let(ranked["x"], best)

    def body(page: Text) -> Text:
        spans = let(element_scores(events(page, _SCORED_NAMES)), lambda found: F.when(F.size(found) > 0, chosen(found)))
        return let(spans, lambda s: F.when(F.size(s) > 0, F.array_join(F.transform(s, lambda x: trim_ws(F.substr(page, x["start"] + 1, x["stop"] - x["start"]))), "\n\n")))

    return let(html, body)


# ---------------------------------------------------------------------------
# Markdown, bottom-up
# ---------------------------------------------------------------------------
MARKDOWN_NAMES = (*BLOCKS, *INLINE, *VOID)
#: Characters that stand for others until the page is done: a space and a tab that stay, a
#: bar to escape, the start of a line of code, a line break, an edge between blocks, a list.
SPACE, TAB, BAR, CODE_LINE, BREAK, EDGE, LIST = "\x02", "\x03", "\x05", "\x07", "\x06", "\x0e", "\x0f"
UNPARK = (Rx(SPACE, " "), Rx(TAB, "\t"), Rx(BAR, "\\|"), Rx(CODE_LINE, ""), Rx(f"[{BREAK}{EDGE}{LIST}]", ""))
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "del": "~~", "s": "~~", "strike": "~~"}

_TEXT = (Rx(r"<[^>]*>", ""), Rx("(?i) |&nbsp;|&#160;|&#xa0;", " "), Rx(SPACES, " "))
_CODE = (Rx(r"<[^>]*>", ""), Rx("\r\n?", "\n"), Rx(" ", SPACE), Rx("\t", TAB))
# Breaks at the edges of a paragraph go; several are a new paragraph; one is a hard break.
_PARAGRAPH = (Rx(f"[ \n]*{BREAK}[ \n{BREAK}]*{BREAK}[ \n]*", "\n\n"), Rx(f" *{BREAK} *", f"{SPACE}{SPACE}\n"), Rx(" {2,}", " "))
_EDGES = f" \t\r\n{BREAK}"
_LINE = (Rx(f"[ \t\r\n{BREAK}{EDGE}{LIST}{SPACE}]+", " "),)

_PART = "struct<k:string,s:string>"
_NODE = f"struct<id:int,parent:int,depth:int,tag:string,raw:string,parts:array<{_PART}>>"
BLOCK = "struct<id:int,parent:int,depth:int,tag:string,markdown:string>"


def _attribute(raw: Text, name: str) -> Text:
    """Value of an attribute in a tag, '' without one."""
    re_ = lambda value: rf"""(?is)^<[A-Za-z0-9]+(?:"[^"]*"|'[^']*'|[^"'>])*?[\s/"']{name}\s*=\s*{value}"""
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, re_(v), 1), F.lit("")) for v in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")], F.lit(""))


def _longest_ticks(text: Text) -> Text:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), lambda x: F.length(x))), F.lit(0))


def _joined(parts: Text) -> Text:
    """Parts as one string: text as it is, blocks between edges."""
    return F.array_join(
        F.transform(parts, lambda p: F.when(p["k"] == "i", p["s"]).when(p["k"] == "l", F.concat(F.lit(EDGE + LIST), p["s"], F.lit(EDGE))).otherwise(F.concat(F.lit(EDGE), p["s"], F.lit(EDGE)))), ""
    )


def _blocks(parts: Text, tight: bool = False) -> Text:
    """Blocks and paragraphs between them, blank lines between; ``tight``: none before a list."""
    paragraph = lambda x: where_found(trimmed(x, _EDGES), _PARAGRAPH)
    whole = F.filter(F.transform(F.split(_joined(parts), EDGE), paragraph), lambda x: (x != "") & (x != LIST))
    gap = lambda x, i: F.when(i == 0, F.lit("")).when(x.startswith(LIST) & F.lit(tight), F.lit("\n")).otherwise(F.lit("\n\n"))
    return let(whole, lambda w: F.array_join(F.transform(w, lambda x, i: F.concat(gap(x, i), F.replace(x, F.lit(LIST), F.lit("")))), ""))


def _line(parts: Text) -> Text:
    """Everything on one line."""
    return trim_ws(replaced(_joined(parts), _LINE))


def _prefixed(text: Text, first: Text, rest: Text) -> Text:
    """Lines of a text: ``first`` before the first, ``rest`` before others that aren't blank."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when(i == 0, F.concat(first, x)).when(x == "", x).otherwise(F.concat(rest, x))), "\n")


def _wrapped(text: Text, before: Text, after: Text) -> Text:
    """Marks set next to the text, white space outside of them; blank text has none."""
    lead, trail = F.regexp_extract(text, f"^[ {BREAK}]*", 0), F.regexp_extract(text, f"[ {BREAK}]*\\z", 0)
    core = trimmed(text, _EDGES)
    return F.when(core == "", text).otherwise(F.concat(lead, before, core, after, trail))


def _part(k: str, s: Text) -> Text:
    return F.array(F.struct(F.lit(k).alias("k"), s.alias("s")))


def _list(node: Text) -> Text:
    """Items with their markers; what stands in a list outside of items joins the item before."""
    start = F.when(node["tag"] == "ol", F.coalesce(F.regexp_extract(_attribute(node["raw"], "start"), "^[0-9]{1,9}$", 0).try_cast("int"), F.lit(1)))

    def add(items: Text, p: Text) -> Text:
        text = trimmed(p["s"], _EDGES)
        after = F.concat(F.slice(items, 1, F.size(items) - 1), F.array(F.concat(F.element_at(items, -1), F.lit("\n"), text)))
        return F.when(p["k"] == "m", F.concat(items, F.array(p["s"]))).when(text == "", items).when(F.size(items) == 0, F.array(text)).otherwise(after)

    def marked(first: Text) -> Text:
        def item(x: Text, i: Text) -> Text:
            marker = F.when(first.isNull(), F.lit("- ")).otherwise(F.concat((first + i).cast("string"), F.lit(". ")))
            return let(marker, lambda m: _prefixed(x, m, F.repeat(F.lit(SPACE), F.length(m))))

        return F.array_join(F.transform(F.aggregate(node["parts"], _empty("string"), add), item), "\n")

    return let(start, marked)


_ALIGN = {"l": ":---", "r": "---:", "c": ":---:"}


def _cell(node: Text) -> Text:
    """A cell on one line, bars parked, with a letter for its alignment before it."""
    said = F.lower(F.coalesce(F.nullif(_attribute(node["raw"], "align"), F.lit("")), F.regexp_extract(_attribute(node["raw"], "style"), r"(?i)text-align\s*:\s*([a-z]+)", 1)))
    letter = F.when(said.isin("left", "right", "center"), F.substring(said, 1, 1)).otherwise(F.lit("n"))
    return F.concat(letter, F.replace(_line(node["parts"]), F.lit("|"), F.lit(BAR)))


def _row(node: Text) -> Text:
    """Alignment letters, an edge, and the row."""
    cells = F.filter(node["parts"], lambda p: p["k"] == "d")
    texts = F.transform(cells, lambda p: F.concat(F.lit(" "), F.substr(p["s"], F.lit(2)), F.lit(" |")))
    return F.concat(F.array_join(F.transform(cells, lambda p: F.substring(p["s"], 1, 1)), ""), F.lit(EDGE + "|"), F.array_join(texts, ""))


def _table(node: Text) -> Text:
    """Caption and other blocks first, then the rows; the first row is the header."""
    def built(rows: Text) -> Text:
        head = F.substring_index(F.element_at(rows, 1), EDGE, 1)
        letters = F.filter(F.split(head, ""), lambda x: x != "")
        rule = F.array_join(F.transform(letters, lambda x: F.concat(F.lit(" "), F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in _ALIGN.items()], F.lit("---")), F.lit(" |"))), "")
        lines = F.transform(rows, lambda x, i: F.concat(F.substring_index(x, EDGE, -1), F.when(i == 0, F.concat(F.lit("\n|"), rule)).otherwise(F.lit(""))))
        return F.array_join(lines, "\n")

    rows = F.transform(F.filter(node["parts"], lambda p: (p["k"] == "r") & ~p["s"].startswith(EDGE)), lambda p: p["s"])
    other = _blocks(F.filter(node["parts"], lambda p: p["k"] != "r"))
    table = F.when(F.size(rows) > 0, let(rows, built))
    return F.concat_ws("\n\n", F.when(other != "", other), table)


def _code_block(node: Text) -> Text:
    """A fenced block; the fence is longer than any run of backticks in it."""
    text = replaced(F.array_join(F.transform(node["parts"], lambda p: p["s"]), ""), (Rx(f"^{CODE_LINE}?\n", ""), Rx("\n\\z", "")))
    lines = let(text, lambda t: F.concat(F.lit("\n"), F.array_join(F.transform(F.split(t, "\n"), lambda x: F.concat(F.lit(CODE_LINE), x)), "\n"), F.lit("\n")))
    fence = let(_longest_ticks(text), lambda n: F.repeat(F.lit("`"), F.greatest(n + 1, F.lit(3))))
    return let(fence, lambda f: F.concat(f, lines, f))


def _closed(node: Text, outer: Text, end_tag: Text) -> Text:
    """What an element that closes gives its parent: an array of parts."""
    tag, parts = node["tag"], node["parts"]
    in_code = F.exists(outer, lambda f: f["tag"].isin("code", "pre"))
    has_blocks = F.exists(parts, lambda p: p["k"] != "i")
    text = F.array_join(F.transform(parts, lambda p: p["s"]), "")
    mark = F.coalesce(*[F.when(tag == k, F.lit(v)) for k, v in MARKS.items()])
    same = F.exists(outer, lambda f: F.coalesce(*[F.when(f["tag"] == k, F.lit(v)) for k, v in MARKS.items()], F.lit("")) == mark)
    ticks = let(text, lambda t: F.when(t == "", t).otherwise(let(F.repeat(F.lit("`"), _longest_ticks(t) + 1), lambda f: F.when(t.contains("`"), F.concat_ws(" ", f, t, f)).otherwise(F.concat(f, t, f)))))
    link = let(_attribute(node["raw"], "href"), lambda href: F.when(href == "", parts).otherwise(_part("i", F.when(text == "", F.concat(F.lit("[]("), href, F.lit(")"))).otherwise(
        _wrapped(F.when(has_blocks, _line(parts)).otherwise(text), F.lit("["), F.concat(F.lit("]("), href, F.lit(")")))))))
    block = lambda md: let(md, lambda m: F.when(m == "", _empty(_PART)).otherwise(_part("b", m)))
    parent = F.coalesce(F.element_at(outer, -1)["tag"], F.lit(""))
    heading = let(_line(parts), lambda t: F.when(t == "", t).otherwise(F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), t)))
    quote = lambda t: F.when(t == "", t).otherwise(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n"))
    return (
        # Without its end tag an inline element marks nothing.
        F.when(tag.isin(*INLINE) & (~end_tag | in_code), parts)
        .when(tag == "a", link)
        .when(tag == "code", F.when(has_blocks, parts).otherwise(_part("i", ticks)))
        .when(tag.isin(*MARKS), F.when(has_blocks | same, parts).otherwise(_part("i", _wrapped(text, mark, mark))))
        .when(tag.isin(*HEADINGS), block(heading))
        .when(tag == "li", let(_blocks(parts, True), lambda t: F.when(parent.isin(*LISTS), _part("m", t)).otherwise(_part("b", _prefixed(t, F.lit("- "), F.lit(SPACE * 2))))))
        .when(tag.isin(*LISTS), let(_list(node), lambda t: F.when(t == "", _empty(_PART)).otherwise(_part("l", t))))
        .when(tag == "blockquote", block(let(_blocks(parts), quote)))
        .when(tag == "pre", block(_code_block(node)))
        .when(tag.isin(*CELLS) & (parent == "tr"), _part("d", _cell(node)))
        .when(tag == "tr", _part("r", _row(node)))
        .when(tag.isin("thead", "tbody", "tfoot"), parts)
        .when(tag == "table", block(_table(node)))
        .otherwise(block(_blocks(parts)))
    )


def _rendered(evs: Text) -> Text:
    """struct(markdown, blocks) of a page's events."""

    def node(f: Text, parts: Text) -> Text:
        return F.struct(*[f[x].alias(x) for x in ("id", "parent", "depth", "tag", "raw")], parts.alias("parts"))

    def with_parts(stack: Text, more: Text) -> Text:
        """The stack, its last element with more parts; the others are passed on, not copied."""
        outer = F.slice(stack, 1, F.size(stack) - 1)
        return bind(F.element_at(stack, -1), stack, lambda f: F.concat(outer, F.array(node(f, F.concat(f["parts"], more)))))

    def make(open: Text, out: Text) -> Text:
        return F.struct(open.alias("open"), out.alias("out"))

    def step(state: Text, e: Text) -> Text:
        stack, out = state["open"], state["out"]
        in_pre = F.exists(stack, lambda f: f["tag"] == "pre")
        text = F.when(in_pre, replaced(e["text"], _CODE)).otherwise(where_found(e["text"], _TEXT))
        box = F.lower(_attribute(e["raw"], "type"))
        alt, src = _attribute(e["raw"], "alt"), _attribute(e["raw"], "src")
        void = (
            F.when(e["tag"] == "br", _part("i", F.when(in_pre, F.lit("\n")).otherwise(F.lit(BREAK))))
            .when(e["tag"] == "hr", _part("b", F.lit("---")))
            .when((e["tag"] == "img") & (src != ""), _part("i", F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"))))
            .when((e["tag"] == "input") & (box == "checkbox"), _part("i", F.when(e["raw"].rlike(r"(?i)[\s\"']checked\b"), F.lit("[x] ")).otherwise(F.lit("[ ] "))))
            .otherwise(_empty(_PART))
        )
        pushed = F.concat(stack, F.array(F.struct(*[e[x].alias(x) for x in ("id", "parent", "depth", "tag", "raw")], _empty(_PART).alias("parts"))))

        def popped(f: Text) -> Text:
            outer = F.slice(stack, 1, F.size(stack) - 1)

            def given(parts: Text) -> Text:
                md = F.array_join(F.transform(parts, lambda p: F.when(p["k"] == "d", F.substr(p["s"], F.lit(2))).when(p["k"] == "r", F.substring_index(p["s"], EDGE, -1)).otherwise(p["s"])), "\n\n")
                row = F.struct(f["id"].alias("id"), f["parent"].alias("parent"), f["depth"].alias("depth"), f["tag"].alias("tag"), md.alias("markdown"))
                return make(with_parts(outer, parts), F.when(f["tag"].isin(*INLINE), out).otherwise(F.concat(out, F.array(row))))

            return bind(_closed(f, outer, e["raw"] != ""), state, given)

        return (
            F.when(e["k"] == "t", make(with_parts(stack, _part("i", text)), out))
            .when(e["k"] == "o", make(pushed, out))
            .when(e["k"] == "v", make(with_parts(stack, void), out))
            .otherwise(bind(F.element_at(stack, -1), state, popped))
        )

    zero = F.lit(0).cast("int")
    root = F.struct(zero.alias("id"), zero.alias("parent"), zero.alias("depth"), F.lit("").alias("tag"), F.lit("").alias("raw"), _empty(_PART).alias("parts"))
    done = lambda s: F.struct(_blocks(F.element_at(s["open"], 1)["parts"]).alias("markdown"), s["out"].alias("blocks"))
    return F.aggregate(evs, make(F.array(root), _empty(BLOCK)), step, done)


def rendered(html: Text) -> Text:
    """struct(markdown, blocks array<BLOCK>) of an article's HTML, references not yet decoded.

    ``blocks`` holds the Markdown of every block element as it closes, children first.
    """
    return _rendered(events(html, MARKDOWN_NAMES))


# ---------------------------------------------------------------------------
# For DataFrames: columns are given by name
# ---------------------------------------------------------------------------

def content_column(html: str) -> Column:
    """``best_content`` of a column."""
    return expr(best_content(F.col(html)).sql)


def rendered_column(html: str) -> Column:
    """``rendered`` of a column."""
    return expr(rendered(F.col(html)).sql)


def markdown_column(html: str) -> Column:
    """The Markdown alone."""
    return expr(rendered(F.col(html))["markdown"].sql)
