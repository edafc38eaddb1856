"""Fill-in-middle, decontamination and prefix tries against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mdforge.llm import decontaminate, fill_in_middle, prefix_trie, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def key(rows):
    return sorted(map(tuple, rows), key=str)


# -- fill-in-middle ---------------------------------------------------------------------


def brute_fim(i, text):
    t = text or ""
    x = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return i, len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return i, len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, docs, rows, no_docs):
    want = [brute_fim(i, t) for i, t, _, _ in rows]
    got = fill_in_middle.fill_in_middle(docs)
    assert key(got.collect()) == key(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert key(fill_in_middle.restored(got).collect()) == key([(i, t or "") for i, t, _, _ in rows])
    digests = fill_in_middle.digests(docs)
    assert key(digests.collect()) == key([(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t, _, _) in zip(want, rows, strict=True)])
    assert fill_in_middle.digests(no_docs).count() == 0
    marked = spark.createDataFrame([(k, f"a{m}b") for k, m in enumerate(("<P>", "<S>", "<M>", "<P", "<<S>>"))], "doc_id long, text string")
    assert {r.doc_id for r in fill_in_middle.fill_in_middle(marked).where("form = 'plain'").collect()} >= {0, 1, 2, 4}


@pytest.mark.parametrize("unit", fill_in_middle.UNITS)
@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_units_in_stretches_of_any_size(unit, block):
    rng = random.Random(block)
    texts = [None, "", " ", "\U0001f600", "x" * 90, " a  b ", *("".join(rng.choice("ab é日\U0001f600<>PSM\n ") for _ in range(rng.randint(0, 60))) for _ in range(80))]
    h = [np.array([rng.randrange(1 << 32) for _ in texts]) for _ in range(4)]
    split = (lambda t: list(t)) if unit == "char" else (lambda t: re.findall(r"^[ \n]+|[^ \n]+[ \n]*", t))
    n, form, prefix, middle, output = fill_in_middle.transform(pa.array(texts, pa.string()), h, unit, block)
    for k, t in enumerate(texts):
        parts = split(t or "")
        a, b = sorted((int(h[0][k]) % (len(parts) + 1), int(h[1][k]) % (len(parts) + 1)))
        p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        assert n[k].as_py() == len(parts)
        assert output[k].as_py() == {"plain": t or "", "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form[k].as_py()]
    assert fill_in_middle.restore(output, form).to_pylist() == [t or "" for t in texts]


# -- decontamination --------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items, width):
    found = list(WORD.finditer((text or "").translate(LOWER)))
    words = [m.group() for m in found]
    hit, ids = set(), set()
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        k = min(width, len(w))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for j in range(len(words) - k + 1):
            if tuple(words[j : j + k]) in own:
                hit.update(range(j, j + k))
                ids |= {i} - {None}
    spans = []
    for j in sorted(hit):
        a, b = (len((text or "")[: x].encode()) for x in found[j].span())
        if j - 1 in hit:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return len(words), len(hit), sorted(ids), spans


@pytest.fixture(scope="module")
def leaks(rows):
    rng = random.Random(3)
    text = {i: t for i, t, _, _ in rows}
    cut = lambda i, a, n: " ".join(text[i].split()[a : a + n])
    items = [(1, cut(0, 2, 14).upper()), (10, cut(0, 2, 14)), (2, cut(1, 0, 12).replace(" ", "--")), (3, "Höhe, 42: ja"), (4, None), (5, "!! .."), (None, cut(2, 1, 11)), (7, cut(3, 3, 10)), (7, cut(4, 0, 10)), (9, "weather")]
    docs = [*rows, (900, "Höhe 42 -- ja. Höhe,42,ja\U0001f600 x höhe 42 JA", "de", None), (901, "é" + cut(1, 0, 12), "en", "s"), (902, cut(1, 0, 12) + " " + cut(2, 1, 11) + "!", "en", "s"), (902, cut(7, 0, 9), "en", "s")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("max_words", [10_000, 0])
def test_decontamination(spark, leaks, max_words):
    docs, items = leaks
    d = spark.createDataFrame([(i, t, s, 1, "x", 0) for i, t, _, s in docs], "doc_id long, text string, source string, n_words long, items string, text_hash int").repartition(4)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = [(i, *brute_hits(t, items, 10)) for i, t, _, _ in docs]
    assert any(len(w[3]) > 1 for w in want) and any(len(w[4]) > 2 for w in want)
    got = decontaminate.scan(d, b, max_words=max_words, filter_bits=1 << 12).collect()
    assert key((r.doc_id, r.n_words, r.n_hit, r.items, [tuple(s) for s in r.spans]) for r in got) == key(want)
    clean = decontaminate.decontaminated(d, b, "documents", max_words=max_words)
    assert clean.columns == d.columns
    assert key((r.doc_id, r.text) for r in clean.collect()) == key((i, t) for (i, t, _, _), w in zip(docs, want, strict=True) if not w[2])
    cut = decontaminate.decontaminated(d, b, "spans", max_words=max_words)

    def without(text, spans):
        raw, out, at = text.encode(), b"", 0
        for x, y in spans:
            out, at = out + raw[at:x], y
        return (out + raw[at:]).decode()

    assert key((r.doc_id, r.text) for r in cut.collect()) == key((i, without(t, w[4]) if w[4] else t) for (i, t, _, _), w in zip(docs, want, strict=True))


def test_decontamination_of_empty_tables(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the of and")], "item_id long, text string")
    for words in (0, 100):
        assert decontaminate.scan(no_docs, one, max_words=words, filter_bits=1 << 10).count() == 0
    got = decontaminate.digests(docs, none)
    assert got.count() == len(rows) and got.where("contaminated or n_items > 0 or items_sha256 <> sha2('', 256)").count() == 0


def test_equal_hashes_of_different_windows():
    items = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(40)]
    windows = decontaminate.WindowSet(items, 2, mask=7)
    assert len(windows.keys) <= 8 and len(windows.widths) == 80
    words = decontaminate.Words.of(["x alpha3 beta3 alpha4", "beta5 gamma6", "Beta7 GAMMA7"])
    hit, true = windows.hits(words)
    assert hit.tolist() == [False, True, True, False, False, False, True, True]
    assert [windows.items_of(w).tolist() for _, w in true] == [[3], [7]]


# -- prefix trie ------------------------------------------------------------------------


def brute_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(t)] for c, t in talks.items()}
    members = defaultdict(list)
    whole = defaultdict(list)
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = talks.get(c - c % 20, [])[:h] + own[h:]
        whole[tuple(seq)].append(c)
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    saved = lambda n: (len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    for n in sorted(members, key=len):
        leaves, total, stack = 0, 0, [n]
        while stack:
            x = stack.pop()
            leaves += not children[x]
            total += saved(x)
            stack += children[x]
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves, total, sha(",".join(map(str, sorted(whole.get(n, [])))))))
    return out


def talk_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 130), 203, 240, 247]:
        if c in (40, 60):  # bases that are absent
            continue
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello you", "what  is\tit", "ok\n"])))
    for c in (300, 301, 302, 303, 304, 305, 306):  # copies with common beginnings
        rows += [(c, t, "user", f"turn {t} a b") for t in range(9)]
    rows += [(310, t, "user", f"long {t // 2}") for t in range(90)] + [(311, t, "user", f"long {t // 2}") for t in range(75)]
    rows += [(320, None, None, None), (320, None, "user", "first"), (320, 1, "b", "tie"), (320, 1, "a", "tie"), (320, 1, "a", "tie"), (321, 0, None, "x"), (321, 0, "x", None), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(340, 0, "user", "")] + [(c, 0, "user", "only") for c in range(341, 346)]  # shorter than what is replaced
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("band", "stretch"), [(16, 1024), (2, 4), (3, 7), (1000, 1024)])
def test_prefix_trie(spark, band, stretch):
    rows = talk_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, place int").repartition(5)
    got = prefix_trie.prefix_trie(df, band, stretch)
    assert key(got.collect()) == key(brute_trie(rows))


def test_prefix_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(None, 1, "a", "b")], [(7, 0, "user", "hi")], [(21, 0, "a", "b"), (22, 0, "a", "b")]):
        assert key(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()) == key(brute_trie(rows))


def test_pieces_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    ends = spark.range(100).select((F.col("id") % 3 * 0 + F.when(F.col("id") < 90, 1).otherwise(2)).alias("conv_id"), F.lit(4).cast("long").alias("depth"), F.col("id").alias("member"))
    got = {r.conv_id: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert got == {1: sha(",".join(map(str, range(90)))), 2: sha(",".join(map(str, range(90, 100))))}


def test_new_queries_have_sql():
    assert {"op11_fill_in_middle", "op12_decontamination", "op13_prefix_trie"} <= set(queries.ORACLE) & set(queries.QUERIES)


def test_scratch_tables_go(spark):
    from pathlib import Path

    from mdforge.llm import common, repeats

    folder = Path(common.ready(spark).replace("file:", ""))
    there = lambda name: len(list(folder.glob(f"mdforge-{name}-*")))
    kept = common.settle(spark.range(3), "scratch-kept")
    with common.scratch(spark):
        inner = common.settle(spark.range(5), "scratch-test")
        with common.scratch(spark):
            common.settle(spark.range(6), "scratch-test")
            assert there("scratch-test") == 2
        assert there("scratch-test") == 1 and inner.count() == 5
    assert there("scratch-test") == 0 and kept.count() == 3
    common.unsettle(kept)
    assert there("scratch-kept") == 0
    runs, met = there("runs"), there("met")
    docs = spark.createDataFrame([(1, "abcdefghij" * 60), (2, "x" + "abcdefghij" * 60)], "doc_id long, text string")
    assert repeats.repeat_digests(docs).where("n_removed > 0").count() == 2
    assert there("runs") == runs and there("met") == met + 1
