"""M5-M9: properties of the cuts on random texts, and hand-made expectations."""

import math
import random
import re

from pyspark.sql import functions as F

from mdforge.operators import chunks as CH

WORDS = ["a", "bb", "ccc", "# H", "## Sub", "#nohead", "x.", "y!", "z?", "", "  ", "long" * 15, "é", "end."]
BLANK = " \t\n\r\f\x0b"


def _texts(n=150, seed=7):
    rnd = random.Random(seed)
    out = ["", "\n\n", "# only heading", "no terminator at all", "tail. after last", "\n\nleading blank"]
    for _ in range(n):
        lines = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 25))]
        out.append("\n".join(lines))
    return out


def _by_id(rows, cols):
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in got.items()}


def _tail(lines, overlap):
    """Fewest last lines that hold ``overlap`` characters with their line ends."""
    sizes = [sum(len(x) + 1 for x in lines[-k:]) for k in range(1, len(lines) + 1)]
    return next((k for k, n in enumerate(sizes, 1) if n >= overlap), len(lines))


def test_heading_chunks_are_stretches_of_lines(spark):
    limit, overlap = 40, 12
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = _by_id(CH.chunk_by_heading(df, "t", ("id",), limit, overlap).collect(), ["chunk_index", "content", "headings", "start_line", "end_line"])
    for i, t in enumerate(texts):
        lines = t.split("\n")
        is_heading = [bool(re.match(r"#+[ \t\r\f\x0b]", x)) for x in lines]
        chunks = got[i]
        assert [c[0] for c in chunks] == list(range(len(chunks)))
        assert chunks[0][3] == 0 and chunks[-1][4] == len(lines) - 1
        for k, (_, content, headings, start, end) in enumerate(chunks):
            assert content == "\n".join(lines[start : end + 1]).strip(BLANK)
            long = len("\n".join(lines[start : end + 1])) > limit
            last = k + 1 == len(chunks)
            assert last or long or is_heading[end + 1]
            fresh = 0 if k == 0 else chunks[k - 1][4] + 1  # the first line that isn't overlap
            assert headings == [x for x, h in zip(lines[fresh : end + 1], is_heading[fresh : end + 1], strict=True) if h]
            assert not any(is_heading[max(fresh, start) + 1 : end + 1])
            if not last:
                assert chunks[k + 1][3] == end + 1 - _tail(lines[start : end + 1], overlap)
            for stop in range(max(fresh, start), end):  # it could not have been cut before
                assert len("\n".join(lines[start : stop + 1])) <= limit


def _stretches(sizes, separator, limit):
    """First pieces of the stretches: a piece that doesn't fit behind others begins one."""
    starts, total = [], 0
    for k, n in enumerate(sizes):
        if not starts or (total + n > limit):
            if starts and k == starts[-1]:
                continue
            starts.append(k)
            total = n
        else:
            total += separator + n
    return starts


def test_paragraphs_are_packed_in_order(spark):
    texts = _texts(seed=11)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = _by_id(CH.chunk_by_paragraph(df, "t", ("id",), 30).collect(), ["chunk_index", "content", "tokens"])
    for i, t in enumerate(texts):
        parts = re.split(r"\n\n+", t)
        starts = _stretches([len(p) for p in parts], 2, 30)
        want = ["\n\n".join(parts[a:b]).strip(BLANK) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)]
        assert got[i] == [(k, c, math.ceil(len(c) / 4)) for k, c in enumerate(want)], t


def test_sentence_expectations(spark):
    cases = {
        "One. Two! Three?": ["One. Two! Three?"],
        "A long first one here. Second sentence here. Third.": ["A long first one here.", "Second sentence here. Third."],
        "no terminator at all, and it runs past the limit": ["no terminator at all, and it runs past the limit"],
        "tail. after last": ["tail."],
        "Wait... what?! Yes.": ["Wait... what?! Yes."],
        "": [""],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    got = _by_id(CH.chunk_by_sentence(df, "t", ("id",), 30).collect(), ["chunk_index", "content"])
    assert [[c for _, c in got[i]] for i in range(len(cases))] == list(cases.values())


def test_heading_expectations(spark):
    md = "intro\n# One\ntext\n## Two\nmore"
    df = spark.createDataFrame([(0, md)], "id long, t string")
    got = [(r.content, r.headings, r.start_line, r.end_line) for r in CH.chunk_by_heading(df, "t", ("id",), 4000, 5).orderBy("chunk_index").collect()]
    assert got == [("intro", [], 0, 0), ("intro\n# One\ntext", ["# One"], 0, 2), ("text\n## Two\nmore", ["## Two"], 2, 4)]


def test_edge_rules(spark):
    df = spark.createDataFrame([(0, "")], "id long, t string")
    assert [(r.content, r.start_line, r.end_line) for r in CH.chunk_by_heading(df, "t", ("id",)).collect()] == [("", 0, 0)]
    # An over-long line is carried whole as overlap, so the next line flushes again.
    df = spark.createDataFrame([(0, "x" * 50 + "\nshort")], "id long, t string")
    got = [(r.content, r.start_line, r.end_line) for r in CH.chunk_by_heading(df, "t", ("id",), 40, 12).orderBy("chunk_index").collect()]
    assert got == [("x" * 50, 0, 0), ("x" * 50 + "\nshort", 0, 1), ("x" * 50 + "\nshort", 0, 1)]


def test_overlap_tail_and_tokens(spark):
    df = spark.createDataFrame([(0, ["aaaa", "bb", "c"])], "id long, ls array<string>")
    r = df.select(CH.overlap_tail(F.col("ls"), 5).alias("t"), CH.overlap_tail(F.col("ls"), 0).alias("z"),
                  CH.estimate_tokens(F.lit("abcde")).alias("n")).first()
    assert r.t == ["bb", "c"]
    assert r.z == [] and r.n == 2


def test_folds_are_evaluated_once():
    # An expression that is named several times is evaluated as often: 4 and 30 aggregates before.
    for fn in (CH.chunk_by_sentence_array, CH.chunk_by_paragraph_array):
        assert str(fn(F.col("t"))).count("aggregate(") == 2  # the fold, and its step's value
    assert str(CH.chunk_by_heading_array(F.col("t"))).count("aggregate(") <= 8


def test_trim_takes_the_white_space_of_the_pattern(spark):
    texts = [f"{c}a{c}b{c}" for c in map(chr, [*range(1, 0x300), *range(0x1670, 0x1690), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF])]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " 　\n", None]], "t string")
    pattern = F.regexp_replace("t", "^" + CH.JS_SPACE + "+|" + CH.JS_SPACE + r"+\z", "")
    assert df.where(~CH._js_trim(F.col("t")).eqNullSafe(pattern)).count() == 0
