"""M5-M9: chunking Markdown for retrieval, as folds in Catalyst.

Each chunker is one ``aggregate`` (a left fold) over the split text with a struct
state, evaluated per row inside the JVM; chunks are then exploded to rows. Rules
follow the reference chunker exactly, including its quirks:

* heading: a line of ``#``s then whitespace; a heading flushes the current chunk
  (span ends at i-1) and starts a new one from the overlap lines plus the heading;
  after every line a chunk over ``max_chars`` is flushed including that line and the
  overlap is carried with no headings; the rest is always emitted.
* overlap: whole lines from the end until their length + 1 each reaches ``overlap``.
* paragraph: split on blank lines; the size test omits the separator to be added.
* sentence: runs ending in ``.!?``; the tail after the last terminator is dropped
  unless there is no terminator at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import bind, let

DEFAULT_MAX_CHARS = 4000
DEFAULT_OVERLAP = 200
# JavaScript's \s (ASCII and Unicode spaces).
JS_SPACE = r"[ \t\n\r\f\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JS_SPACE_CHARS = " \t\n\r\f\x0b\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HEADING_RE = r"^#+" + JS_SPACE
SENTENCE_RE = r"[^.!?]+[.!?]+"
PARAGRAPH_SPLIT = r"\n\n+"

CHUNK_TYPE = "struct<content:string,headings:array<string>,start_line:int,end_line:int>"
EMPTY_STR_ARRAY = "array<string>"


def estimate_tokens(c: Column) -> Column:
    """M9: ceil(characters / 4)."""
    return F.ceil(F.length(c) / F.lit(4)).cast("int")


def _js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_SPACE_CHARS))


# ---------------------------------------------------------------------------
# M8 overlap tail
# ---------------------------------------------------------------------------

def overlap_count(lines: Column, overlap: int) -> Column:
    """Number of trailing lines the overlap keeps (0 when overlap <= 0)."""
    if overlap <= 0:
        return F.lit(0)
    init = F.struct(F.lit(0).alias("k"), F.lit(0).alias("c"), F.lit(False).alias("done"))
    st = F.aggregate(
        F.reverse(lines),
        init,
        lambda s, ln: F.when(s["done"], s).otherwise(
            F.struct(
                (s["k"] + 1).alias("k"),
                (s["c"] + F.length(ln) + 1).alias("c"),
                ((s["c"] + F.length(ln) + 1) >= overlap).alias("done"),
            )
        ),
    )
    return st["k"]


def overlap_tail(lines: Column, overlap: int) -> Column:
    """M8: the trailing lines carried into the next chunk."""
    def body(ls: Column) -> Column:
        return let(overlap_count(ls, overlap), lambda k: F.when(
            k > 0, F.slice(ls, F.size(ls) - k + 1, k)).otherwise(F.array().cast(EMPTY_STR_ARRAY)))
    return let(lines, body)


# ---------------------------------------------------------------------------
# M5 chunk by heading
# ---------------------------------------------------------------------------

def _chunk(content_lines: Column, heads: Column, start: Column, end: Column) -> Column:
    return F.struct(
        _js_trim(F.array_join(content_lines, "\n")).alias("content"),
        heads.alias("headings"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
    )


def chunk_by_heading_array(md: Column, max_chars: int = DEFAULT_MAX_CHARS, overlap: int = DEFAULT_OVERLAP) -> Column:
    """array<CHUNK_TYPE> for one Markdown text."""
    empty_s = F.array().cast(EMPTY_STR_ARRAY)
    empty_c = F.array().cast(f"array<{CHUNK_TYPE}>")
    init = F.struct(
        empty_c.alias("chunks"),
        empty_s.alias("cur"),
        F.lit(0).alias("clen"),  # sum of line lengths in cur
        empty_s.alias("heads"),
        F.lit(0).alias("start"),
    )

    def state(chunks, cur, clen, heads, start):
        return F.struct(chunks.alias("chunks"), cur.alias("cur"), clen.alias("clen"), heads.alias("heads"), start.alias("start"))

    def step(s: Column, x: Column) -> Column:
        line, i = x["line"], x["i"]
        is_head = line.rlike(HEADING_RE)

        def flush_heading(ov_k: Column) -> Column:
            ov = F.slice(s["cur"], F.size(s["cur"]) - ov_k + 1, ov_k)
            ov = F.when(ov_k > 0, ov).otherwise(empty_s)
            return state(
                F.concat(s["chunks"], F.array(_chunk(s["cur"], s["heads"], s["start"], i - 1))),
                F.concat(ov, F.array(line)),
                F.aggregate(ov, F.lit(0), lambda a, ln: a + F.length(ln)) + F.length(line),
                F.array(line),
                i - ov_k,
            )

        first = F.when(
            is_head & (F.size(s["cur"]) > 0), bind(overlap_count(s["cur"], overlap), s, flush_heading)
        ).otherwise(
            state(
                s["chunks"],
                F.concat(s["cur"], F.array(line)),
                s["clen"] + F.length(line),
                F.when(is_head, F.concat(s["heads"], F.array(line))).otherwise(s["heads"]),
                s["start"],
            )
        )

        def size_check(t: Column) -> Column:
            joined_len = t["clen"] + F.size(t["cur"]) - 1

            def flush_size(ov_k: Column) -> Column:
                ov = F.when(ov_k > 0, F.slice(t["cur"], F.size(t["cur"]) - ov_k + 1, ov_k)).otherwise(empty_s)
                return state(
                    F.concat(t["chunks"], F.array(_chunk(t["cur"], t["heads"], t["start"], i))),
                    ov,
                    F.aggregate(ov, F.lit(0), lambda a, ln: a + F.length(ln)),
                    empty_s,
                    i - ov_k + 1,
                )

            return F.when(joined_len > max_chars, bind(overlap_count(t["cur"], overlap), t, flush_size)).otherwise(t)

        return bind(first, s, size_check)

    def run(lines: Column) -> Column:
        indexed = F.transform(lines, lambda ln, i: F.struct(ln.alias("line"), i.alias("i")))

        def finish(s: Column) -> Column:
            last = _chunk(s["cur"], s["heads"], s["start"], F.size(lines) - 1)
            return F.when(F.size(s["cur"]) > 0, F.concat(s["chunks"], F.array(last))).otherwise(s["chunks"])

        return F.aggregate(indexed, init, step, finish)

    return let(F.split(F.coalesce(md, F.lit("")), "\n"), run)


# ---------------------------------------------------------------------------
# M6 / M7 greedy packing
# ---------------------------------------------------------------------------

def _pack(pieces: Column, sep: str, max_chars: int, piece_len, piece_val) -> Column:
    """Greedy packing: flush when len(joined so far) + len(piece) > max_chars.

    The joined length is carried in the state (``clen``) so each step is O(piece),
    not O(chunk): counting characters of the growing chunk at every step would make
    long documents quadratic in the chunk size.
    """
    empty = F.array().cast(EMPTY_STR_ARRAY)
    init = F.struct(empty.alias("chunks"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("clen"))

    def step(s: Column, p: Column) -> Column:
        def with_val(v: Column) -> Column:
            would = (s["clen"] + piece_len(p) > max_chars) & (s["n"] > 0)
            fresh = would | (s["n"] == 0)
            return F.struct(
                F.when(would, F.concat(s["chunks"], F.array(_js_trim(s["cur"])))).otherwise(s["chunks"]).alias("chunks"),
                F.when(fresh, v).otherwise(F.concat(s["cur"], F.lit(sep), v)).alias("cur"),
                F.when(would, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
                F.when(fresh, F.length(v)).otherwise(s["clen"] + len(sep) + F.length(v)).alias("clen"),
            )

        return bind(piece_val(p), s, with_val)

    # As the fold's own last step: an expression named several times is evaluated as often.
    return F.aggregate(pieces, init, step, lambda s: F.when(s["n"] > 0, F.concat(s["chunks"], F.array(_js_trim(s["cur"])))).otherwise(s["chunks"]))


def chunk_by_paragraph_array(md: Column, max_chars: int = DEFAULT_MAX_CHARS) -> Column:
    return _pack(F.split(F.coalesce(md, F.lit("")), PARAGRAPH_SPLIT), "\n\n", max_chars, F.length, lambda p: p)


def chunk_by_sentence_array(md: Column, max_chars: int = DEFAULT_MAX_CHARS) -> Column:
    def body(text: Column) -> Column:
        # Sentences end at a terminator, so only the prefix up to the last one is
        # searched: a long unterminated tail would otherwise be re-scanned from
        # every start position (quadratic in Java's backtracking matcher).
        upto_last = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
        found = F.regexp_extract_all(upto_last, F.lit(SENTENCE_RE), 0)
        sentences = F.when(F.size(found) > 0, found).otherwise(F.array(text))
        return _pack(sentences, " ", max_chars, F.length, _js_trim)

    return let(F.coalesce(md, F.lit("")), body)


# ---------------------------------------------------------------------------
# DataFrame operators: one row per chunk.
# ---------------------------------------------------------------------------

def _rows(df: DataFrame, keep: list[str], arr: Column) -> DataFrame:
    out = df.select(*keep, F.posexplode(arr).alias("chunk_index", "_c"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("int"))


def chunk_by_heading(df: DataFrame, text: str = "markdown", keep: tuple[str, ...] = ("page_id",),
                     max_chars: int = DEFAULT_MAX_CHARS, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """M5: (keep..., chunk_index, content, tokens, headings, start_line, end_line)."""
    out = _rows(df, list(keep), chunk_by_heading_array(F.col(text), max_chars, overlap))
    return out.select(
        *keep, "chunk_index", F.col("_c.content").alias("content"), estimate_tokens(F.col("_c.content")).alias("tokens"),
        F.col("_c.headings").alias("headings"), F.col("_c.start_line").alias("start_line"), F.col("_c.end_line").alias("end_line"),
    )


def chunk_by_paragraph(df: DataFrame, text: str = "markdown", keep: tuple[str, ...] = ("page_id",),
                       max_chars: int = DEFAULT_MAX_CHARS) -> DataFrame:
    """M6: (keep..., chunk_index, content, tokens)."""
    out = _rows(df, list(keep), chunk_by_paragraph_array(F.col(text), max_chars))
    return out.select(*keep, "chunk_index", F.col("_c").alias("content"), estimate_tokens(F.col("_c")).alias("tokens"))


def chunk_by_sentence(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                      max_chars: int = DEFAULT_MAX_CHARS) -> DataFrame:
    """M7: (keep..., chunk_index, content, tokens)."""
    out = _rows(df, list(keep), chunk_by_sentence_array(F.col(text), max_chars))
    return out.select(*keep, "chunk_index", F.col("_c").alias("content"), estimate_tokens(F.col("_c")).alias("tokens"))


def chunk(df: DataFrame, text: str, keep: tuple[str, ...], split_on: str = "heading",
          max_chars: int = DEFAULT_MAX_CHARS, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """Dispatch on ``split_on`` like the reference (unknown values fall back to heading)."""
    if split_on == "paragraph":
        return chunk_by_paragraph(df, text, keep, max_chars)
    if split_on == "sentence":
        return chunk_by_sentence(df, text, keep, max_chars)
    return chunk_by_heading(df, text, keep, max_chars, overlap)


# ---------------------------------------------------------------------------
# DuckDB twins (test oracle): the same folds with list_reduce.
# ---------------------------------------------------------------------------
from ..functions.regex import sql_str  # noqa: E402


def js_trim_sql(e: str) -> str:
    return f"regexp_replace({e}, {sql_str('^' + JS_SPACE + '+|' + JS_SPACE + r'+\z')}, '', 'g')"


def _pack_sql(pieces: str, sep: str, max_chars: int, val) -> str:
    init = "struct_pack(chunks := []::VARCHAR[], cur := '', n := 0)"
    step = (
        f"lambda s, p: CASE WHEN length(s.cur) + length(p) > {max_chars} AND s.n > 0 THEN "
        f"struct_pack(chunks := list_append(s.chunks, {js_trim_sql('s.cur')}), cur := {val('p')}, n := 1) "
        f"ELSE struct_pack(chunks := s.chunks, cur := CASE WHEN s.n = 0 THEN {val('p')} ELSE s.cur || {sql_str(sep)} || {val('p')} END, n := s.n + 1) END"
    )
    return (
        f"list_transform([list_reduce({pieces}, {step}, {init})], lambda f: "
        f"CASE WHEN f.n > 0 THEN list_append(f.chunks, {js_trim_sql('f.cur')}) ELSE f.chunks END)[1]"
    )


def chunk_by_paragraph_sql(md: str, max_chars: int = DEFAULT_MAX_CHARS) -> str:
    return _pack_sql(f"regexp_split_to_array(coalesce({md}, ''), {sql_str(PARAGRAPH_SPLIT)})", "\n\n", max_chars, lambda p: p)


def chunk_by_sentence_sql(md: str, max_chars: int = DEFAULT_MAX_CHARS) -> str:
    pieces = (
        f"list_transform([coalesce({md}, '')], lambda tx: CASE WHEN len(regexp_extract_all(tx, {sql_str(SENTENCE_RE)}, 0)) > 0 "
        f"THEN regexp_extract_all(tx, {sql_str(SENTENCE_RE)}, 0) ELSE [tx] END)[1]"
    )
    return _pack_sql(pieces, " ", max_chars, js_trim_sql)


def overlap_count_sql(lines: str, overlap: int) -> str:
    if overlap <= 0:
        return "0"
    return (
        f"list_reduce(list_reverse({lines}), lambda s, ln: CASE WHEN s.done THEN s ELSE struct_pack(k := s.k + 1, "
        f"c := s.c + length(ln) + 1, done := s.c + length(ln) + 1 >= {overlap}) END, struct_pack(k := 0, c := 0, done := false)).k"
    )


def _tail_sql(cur: str, k: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {cur}[len({cur}) - {k} + 1:] ELSE []::VARCHAR[] END)"


def chunk_by_heading_sql(md: str, max_chars: int = DEFAULT_MAX_CHARS, overlap: int = DEFAULT_OVERLAP) -> str:
    ctype = "STRUCT(content VARCHAR, headings VARCHAR[], start_line INTEGER, end_line INTEGER)"
    init = f"struct_pack(chunks := []::{ctype}[], cur := []::VARCHAR[], clen := 0, heads := []::VARCHAR[], start := 0)"

    def chunk(cur: str, heads: str, start: str, end: str) -> str:
        return (
            f"struct_pack(content := {js_trim_sql(f'array_to_string({cur}, chr(10))')}, headings := {heads}, "
            f"start_line := CAST({start} AS INTEGER), end_line := CAST({end} AS INTEGER))"
        )

    def st(chunks, cur, clen, heads, start):
        return f"struct_pack(chunks := {chunks}, cur := {cur}, clen := {clen}, heads := {heads}, start := {start})"

    ovs = _tail_sql("s.cur", "k")
    first = (
        f"CASE WHEN regexp_matches(x.line, {sql_str(HEADING_RE)}) AND len(s.cur) > 0 THEN "
        f"list_transform([{overlap_count_sql('s.cur', overlap)}], lambda k: "
        + st(
            f"list_append(s.chunks, {chunk('s.cur', 's.heads', 's.start', 'x.i - 1')})",
            f"list_append({ovs}, x.line)",
            f"coalesce(list_sum(list_transform({ovs}, lambda ln: length(ln))), 0) + length(x.line)",
            "[x.line]",
            "x.i - k",
        )
        + ")[1] ELSE "
        + st(
            "s.chunks",
            "list_append(s.cur, x.line)",
            "s.clen + length(x.line)",
            f"CASE WHEN regexp_matches(x.line, {sql_str(HEADING_RE)}) THEN list_append(s.heads, x.line) ELSE s.heads END",
            "s.start",
        )
        + " END"
    )
    ovt = _tail_sql("t.cur", "k")
    second = (
        f"list_transform([{first}], lambda t: CASE WHEN t.clen + len(t.cur) - 1 > {max_chars} THEN "
        f"list_transform([{overlap_count_sql('t.cur', overlap)}], lambda k: "
        + st(
            f"list_append(t.chunks, {chunk('t.cur', 't.heads', 't.start', 'x.i')})",
            ovt,
            f"coalesce(list_sum(list_transform({ovt}, lambda ln: length(ln))), 0)",
            "[]::VARCHAR[]",
            "x.i - k + 1",
        )
        + ")[1] ELSE t END)[1]"
    )
    return (
        f"list_transform([string_split(coalesce({md}, ''), chr(10))], lambda lines: list_transform([list_reduce("
        f"list_transform(lines, lambda ln, j: struct_pack(line := ln, i := CAST(j - 1 AS INTEGER))), lambda s, x: {second}, {init})], "
        f"lambda f: CASE WHEN len(f.cur) > 0 THEN list_append(f.chunks, {chunk('f.cur', 'f.heads', 'f.start', 'len(lines) - 1')}) "
        f"ELSE f.chunks END)[1])[1]"
    )
