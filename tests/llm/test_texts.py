"""Text operators against the libraries and brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mdforge.llm import bloom_lm, common, hamming_join, langid, mixing, repeats, shingles, sp_codec, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_sentencepiece_equals_the_library(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, _, _ in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert key(map(tuple, sp_codec.encode_digests(docs, PIECES).collect())) == key(want)
    got = {r.doc_id: (r.ids, r.decoded) for r in sp_codec.encode_ids(docs, PIECES).collect()}
    assert got[1] == (lib.encode(rows[1][1]), rows[1][1])


@pytest.mark.parametrize("text", ["", " ", "   a  b ", "▁", "▁▁a", "a▁▁ b", "\x00\x01", "\t\n a\r\n", "日本語テキスト", "éé", "\U0001f600\U0001f600x", "<s></s><unk>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 5, "ﬁ ½ Σς İ ß"])
def test_sentencepiece_odd_texts(text):
    own = sp_codec.codec(PIECES)
    assert own.text(text) == own.by_library(text)


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows]
    want = [(i, len((t or "").encode()), k, k > 2048) for (i, t, _, _), k in zip(rows, n, strict=True)]
    assert key(map(tuple, token_counts.count_tokens(docs, WORDS).collect())) == key(want)
    assert key(map(tuple, token_counts.count_tokens(docs, WORDS, table_words=0).collect())) == key(want)


def test_language_id(docs, rows, no_docs):
    got = langid.identify(docs, PIECES).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    lang = {i: (t, la) for i, t, la, _ in rows}
    for r in got:
        text, real = lang[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is None:
            continue
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.doc_id < 60:
            assert r.lang_pred == real
    assert langid.identify(no_docs, PIECES).count() == 0
    assert langid.accepted(docs, PIECES).columns == docs.columns


def test_forward_sums_all_segmentations():
    pieces = {"▁": 1, "a": 2, "ab": 3, "b": 4, "▁a": 5}
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.1], [0.2]])
    lattice = langid.Lattice(pieces)
    # ▁ab: ▁|a|b, ▁|ab, ▁a|b; c is unknown
    assert math.exp(lattice.log_probability(["ab"], p)[0, 0]) == pytest.approx(0.2 * 0.15 * 0.1 + 0.2 * 0.25 + 0.2 * 0.1)
    assert math.exp(lattice.log_probability(["c"], p)[0, 0]) == pytest.approx(0.2 * 0.1)
    e = lattice.expected(["ab"], [2], p[:, 0])
    assert e[3] == pytest.approx(2 * 0.05 / 0.073)


def brute_components(rows, width, percent):
    sets = {}
    for i, t, _, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets if i is not None}
    find = lambda i: i if up[i] == i else find(up[i])
    for i in up:
        for j in up:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(sets[i] if i is not None else {*()}), None if i is None else find(i)) for i, *_ in rows], sets


def test_near_duplicates_equal_brute_force(docs, rows, no_docs):
    for width in (4, 5):
        want, _ = brute_components(rows, width, 80)
        got = hamming_join.near_duplicates(docs, width).collect()
        assert key((r.doc_id, r.component_id, r.kept) for r in got) == key((i, c, i == c) for i, _, c in want)
        assert key((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == key((i, n) for i, n, _ in want if i is not None)
    assert hamming_join.near_duplicates(no_docs).count() == 0
    left = hamming_join.one_of_each(docs)
    assert left.columns == docs.columns


def test_signature_distance_guarantee():
    rng = np.random.default_rng(3)
    n = hamming_join.CHUNKS * hamming_join.WIDTH
    for _ in range(200):
        wrong = rng.choice(n, hamming_join.DISTANCE, replace=False)
        per_chunk = np.bincount(wrong // hamming_join.WIDTH, minlength=hamming_join.CHUNKS)
        assert per_chunk.min() <= hamming_join.ERRORS


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, _, _ in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        n = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4000, 1])
def test_repeats_equal_brute_force(docs, rows, no_docs, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 1: every core is resolved by its windows
    got = repeats.repeat_digests(docs)
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == key(brute_repeats(rows, 400))
    assert repeats.repeat_digests(no_docs).count() == 0


def test_passages_of_many_words_go_from_400_bytes(spark):
    """Of passages of 51 to 60 words that two documents share, those of 400 bytes go, shorter ones stay."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 9))) for _ in range(n))
    passages = [words(60)[:n] for n in (399, 400)] + [words(n) for n in rng.integers(51, 61, 60)]
    assert all(len(p.split()) > 50 for p in passages)
    rows = [(2 * k + j, f"{words(40)} {'<['[j]}{p}{'>]'[j]} {words(40)}", None, None) for k, p in enumerate(passages) for j in range(2)]
    rows += [(1000 + k, words(120), None, None) for k in range(20)]
    got = repeats.repeat_digests(spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string"))
    removed = {r.doc_id: r.n_removed for r in got.collect()}
    assert {len(p) >= 400 for p in passages[2:]} == {True, False}
    assert removed == {i: n for i, _, n, _, _ in brute_repeats(rows, 400)}
    assert all(removed[2 * k + j] == (len(p) if len(p) >= 400 else 0) for k, p in enumerate(passages) for j in range(2))


def test_texts_without_repeats(docs, rows):
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    cut = {r.doc_id: r.text for r in left.collect()}
    assert cut[84] == "" and cut[2] == rows[2][1] and cut[80] is None


def test_stretches_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 700)
    rng = np.random.default_rng(5)
    a = "".join(rng.choice(list("abcdef"), 5000))
    rows = [(1, a, None, None), (2, "zz" + a[300:2900] + "q" + a[2900:4000], None, None), (3, "é" * 900 + a[:405], None, None)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    assert key(map(tuple, repeats.repeat_digests(d).collect())) == key(brute_repeats(rows, 400))


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, rows, no_docs):
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    got = mixing.mix_counts(docs).collect()
    assert key((r.doc_id, r.size) for r in got) == key((i, size(t)) for i, t, _, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.target, r.source_size] += r.taken
    assert {round(t, 6): n for (t, _), n in by.items()} == {round(t, 6): round(t) for s, t in target.items()}
    assert key(map(tuple, mixing.mix_counts(docs.repartition(3)).collect())) == key(map(tuple, got))
    assert mixing.mix_counts(no_docs).count() == 0


def test_curriculum_order_and_schedule(docs):
    c = mixing.curriculum(docs).collect()
    p = [r.position for r in c]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_one_source_is_taken_once(spark):
    d = spark.createDataFrame([(i, "a b c", None) for i in range(5)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_counts(d).collect()] == [3] * 5


def test_lm_scores(docs, rows, no_docs):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t, _, _ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens]
    for frequent in (bloom_lm.FREQUENT, 20):
        bloom_lm.FREQUENT = frequent
        got = bloom_lm.score(docs).collect()
        assert key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == key(want)
    assert all(r.score < 0 for r in got)
    bloom_lm.FREQUENT = 1 << 19
    assert bloom_lm.score(no_docs).count() == 0


def test_lm_scores_of_a_filter_in_slices(docs, spark, monkeypatch):
    want = key(tuple(r) for r in bloom_lm.score(docs).collect())
    monkeypatch.setattr(bloom_lm, "PACKED", 300)
    for slice_bits, probed in ((1, 1 << 24), (1 << 13, 500), (1 << 16, 1 << 24)):
        monkeypatch.setattr(bloom_lm, "PROBED", probed)
        assert key(tuple(r) for r in bloom_lm.score(docs, max_bits=0, slice_bits=slice_bits).collect()) == want


def test_lm_bundles_grow_and_send_a_slice_one_row(spark):
    """Rows for the slices are bundles times slices: a bundle goes on through the batches of a
    task, and its words and pairs go together."""
    common.ready(spark)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 997}" for k in range(40)), i, False) for i in range(2000)], "doc_id long, text string, text_hash long, held_out boolean").coalesce(1)
    packed = common.settle(bloom_lm._packed(docs), "packed")
    assert packed.count() == 1 and [sum(r.lengths) for r in packed.collect()] == [2000 * 41]
    scorer = lambda: bloom_lm.Scorer((np.empty(0, np.uint64), np.empty(0, np.int64)), 1, 1, bloom_lm.MU)
    routed = bloom_lm._routed(packed, 40, 4, scorer).collect()
    assert len(routed) == len({r.slice for r in routed}) == 10
    assert sum(r.words for r in routed) == len({w for i in range(2000) for w in ((i * k) % 997 for k in range(40))}) + 1
    keys = [bloom_lm.unsqueezed(r["keys"]) for r in routed]
    assert all((bloom_lm._range(k, 40) // 4 == r.slice).all() for r, k in zip(routed, keys, strict=True))


def test_lm_levels_of_many_keys_together(monkeypatch):
    """Keys probed at once have the levels that each has alone, and all chunks are read."""
    rng = np.random.default_rng(3)
    f = bloom_lm.Filter(rng.integers(0, 256, 7 * 1024 // 8, dtype=np.uint8) | np.uint8(0x77), 7, 1024)
    keys = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)
    monkeypatch.setattr(bloom_lm, "TOGETHER", 64)
    got = f.levels(keys)
    assert got.max() > 3 and got.tolist() == [int(f.levels(keys[i : i + 1])[0]) for i in range(len(keys))] and not len(f.levels(keys[:0]))


@pytest.mark.parametrize("segment", [1024, 2996760, (1 << 31) - 8, (1 << 33) + 8])
def test_lm_probes_are_steps_modulo_the_segment(segment):
    keys = np.random.default_rng(4).integers(0, 2**63, 200, dtype=np.uint64)
    for q, n in ((1, bloom_lm.HASHES), (3, bloom_lm.HASHES_LOW), (9, bloom_lm.HASHES_ABOVE)):
        h = [int(x) for x in bloom_lm.mix(keys + np.uint64(q * int(bloom_lm._GOLD) & (1 << 64) - 1))]
        want = [[((x & 0xFFFFFFFF) + i * (x >> 32 | 1)) % segment for x in h] for i in range(n)]
        assert [p.tolist() for p in bloom_lm.Filter.probes(keys, q, segment)] == want


def test_lm_sorted_counts_add_up():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 300, n, dtype=np.uint64) for n in (1000, 1, 50)]
    folded = [bloom_lm._counted(x) for x in parts]
    for some in (1, 3):
        keys, n = bloom_lm._added(*zip(*folded[:some], strict=True))
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == Counter(int(x) for p in parts[:some] for x in p) and (np.diff(keys.astype(np.int64)) > 0).all()


def test_words_of_a_column_equal_those_of_its_texts(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [None, "", "A b", "B", "b", "", None, " x\ty ", "日本 ÉÀß", "\n", "z" * 200, *("".join(rng.choice(list("aB \n\tß日"), n)) for n in rng.integers(0, 90, 200)), "a b " * 100, ""]
    want = [shingles.text_words(t) for t in texts]
    for block, chunk in ((1, 120), (64, 120), (1 << 17, 4 << 20)):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        for kind in (pa.string(), pa.large_string()):
            for at in (0, 3):
                words, n = shingles.column_words(pa.array(texts, kind).slice(at))
                assert n.tolist() == [len(w) for w in want[at:]] and words.tolist() == np.concatenate(want[at:]).tolist()
    words, n = shingles.column_words(pa.array([], pa.string()))
    assert not len(words) and not len(n)


def test_lm_scores_against_exact_counts(docs, rows):
    """What the filter's quantised counts and false hits change against the same smoothing of
    exact counts: under 0.04 log10 a token on average, under 0.1 in any text of 20 tokens."""
    tokens = lambda t: [*[w.lower() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")], "</s>"]
    ones, twos = Counter(), Counter()
    for i, t, _, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            w = tokens(t)
            ones.update(w)
            twos.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(ones.values()), len(ones)
    before = ones | {"<s>": ones["</s>"]}
    want = defaultdict(set)
    for i, t, _, _ in rows:
        w = tokens(t)
        p = [(twos[h, x] + bloom_lm.MU * (ones[x] + 1) / (n + v + 1)) / (before.get(h, 0) + bloom_lm.MU) for h, x in zip(["<s>", *w[:-1]], w, strict=True)]
        want[i].add((len(w), round(sum(map(math.log10, p)), 6)))
    off = [(r.n_tokens, min(abs(r.score - s) for k, s in want[r.doc_id] if k == r.n_tokens)) for r in bloom_lm.score(docs).collect()]
    assert sum(e for _, e in off) / sum(k for k, _ in off) < 0.04
    assert max(e / k for k, e in off if k >= 20) < 0.1


def test_filter_never_reads_too_little():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 5000, 3000)
    q = bloom_lm.level(counts)
    assert (np.abs(bloom_lm.count_of(q) - counts) <= 0.3 * counts + 0.5).all() and bloom_lm.count_of(np.array([0]))[0] == 0
    keys, segment = rng.integers(0, 2**63, 3000, dtype=np.uint64), 1 << 18
    bits = np.zeros(segment, bool)
    for x in range(1, int(q.max()) + 1):
        for at in bloom_lm.Filter.probes(keys[q >= x], x, segment):
            bits[at.astype(np.int64)] = True
    f = bloom_lm.Filter(np.packbits(bits, bitorder="little"), 1, segment)
    assert (f.levels(keys) >= q).all() and (f.levels(keys) == q).mean() > 0.8
    assert (f.levels(rng.integers(0, 2**63, 3000, dtype=np.uint64)) > 0).mean() < 0.2


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    words = [f"w{c}{k}" for c in "abcde" for k in "fghij"] + ["lorem", "ipsum", "dolor", "amet"]
    words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
    rows = []
    for i in range(600):
        t = list(rng.choice(words, 40))
        bad = int(i % 4 == 0)
        if bad:
            for k in rng.choice(40, 4, replace=False):
                t[k] = rng.choice(["awfulness", "horrible", "nasty"])
        rows.append((i, " ".join(t), bad))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "nasty horrible"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows if i % 2 == 0] + [(None, 1, 0), (9000, 1, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.severities(docs, labels).collect()}
    assert sum(got[i].toxic == bool(y) for i, _, y in rows) >= 0.98 * len(rows)
    assert got[9000].severity == 0 and got[9001].severity == 0 and got[None].toxic
    none = toxicity.severities(docs, labels.limit(0)).collect()
    assert len(none) == 603 and not any(r.toxic for r in none)


def test_ordinal_thresholds_share_weights():
    texts = ["mild " * 1 + "plain words here"] * 30 + ["mild severe words"] * 30 + ["plain words here too"] * 60
    grades = np.array([1] * 30 + [2] * 30 + [0] * 60)
    m = toxicity.fit_ordinal(texts, grades, 2)
    assert (np.diff(m.thresholds) > 0).all()
    s = m.above(m.rows(["plain words here too", "mild plain words here", "mild severe words"])).sum(1)
    assert s[0] < 0.5 < s[1] < 1.5 < s[2]


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    """Ids repeat with other texts: near copies of each are linked to it, others to none."""
    word = lambda k, n=60: [f"w{k}x{j}" for j in range(n)]
    near = lambda k, at: " ".join([*word(k)[:at], "changed", *word(k)[at + 1 :]])
    rows = [(1, " ".join(word(1))), (1, " ".join(word(2))), (1, " ".join(word(2))), (2, near(1, 58)), (3, near(2, 1)), (0, near(3, 0)), (3, " ".join(word(3))), (4, " ".join(word(4)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.text_hash): r.component_id for r in hamming_join.labelled(df, 5, 80).collect()}
    name = {t: h for t, h in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = {(1, name[rows[0][1]]): 1, (1, name[rows[1][1]]): 1, (2, name[rows[3][1]]): 1, (3, name[rows[4][1]]): 1, (0, name[rows[5][1]]): 0, (3, name[rows[6][1]]): 0, (4, name[rows[7][1]]): 4}
    assert got == want
    left = hamming_join.one_of_each(df).collect()
    assert key(map(tuple, left)) == key([rows[0], rows[1], rows[2], rows[5], rows[7]])


def test_unknown_languages_and_no_labels(spark, rows):
    schema = "doc_id long, text string, lang string"
    own = [(i, t, la) for i, t, la, _ in rows if i is not None and i < 60]
    strange = [(700, "привет мир, это другой язык " * 30, None), (702, "123 !", None)]
    kept = {r.doc_id for r in langid.accepted(spark.createDataFrame(own + strange, schema), PIECES).collect()}
    assert kept >= {i for i, _, _ in own} and not kept & {700, 702}
    bare = spark.createDataFrame([(i, t, None) for i, t, _ in own + strange], schema)
    assert langid.accepted(bare, PIECES).count() == len(own) + len(strange)


def test_caches_that_overflow(monkeypatch, rows):
    monkeypatch.setattr(sp_codec, "CACHE_WORDS", 7)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 7)
    monkeypatch.setattr(langid, "CACHE_WORDS", 7)
    own, counter = sp_codec.PieceCodec(PIECES), token_counts.WordCounter(WORDS, {"the": 1})
    pieces = langid.vocabulary(PIECES)
    probs = np.random.default_rng(3).random((len(pieces) + 1, 2))
    small, large = (langid.Model(["a", "b"], pieces, probs, np.array([0.5, 0.5]), True) for _ in range(2))
    for _, t, _, _ in rows:
        assert own.text(t) == own.by_library(t)
        assert counter.count(t) == len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids)
        one = small.predict([t])
        monkeypatch.setattr(langid, "CACHE_WORDS", 10**6)
        two = large.predict([t])
        monkeypatch.setattr(langid, "CACHE_WORDS", 7)
        assert one[0] == two[0] and np.allclose(one[1], two[1]) and (one[2] == two[2]).all()


def test_agenda_as_list_and_as_heap(monkeypatch):
    own = sp_codec.PieceCodec(PIECES)
    words = ["unbelievable", "a" * 30, "aaaa", "internationalization", "xyzzyxyzzy", "日本語", "▁▁▁", "▁the", "é" * 5]
    short = [own.merge(w) for w in words]
    monkeypatch.setattr(sp_codec, "SHORT_WORD", 0)
    assert [own.merge(w) for w in words] == short


def test_mixed_documents_by_rows_and_words(spark):
    """Rows that share an id or have none come one by one; a source of one long text comes; words follow the targets."""
    text = lambda n, k: " ".join(f"t{k}w{j}" for j in range(n))
    rows = [(1, text(40, 0), "a"), (1, text(40, 1), "b"), (None, text(30, 2), "a"), (None, text(30, 3), "b"), (2, text(400, 4), "c"), (3, text(5000, 5), "d"), (4, "", "a"), (5, None, "b")]
    rows += [(10 + k, text(20 + k, 10 + k), "abc"[k % 3]) for k in range(60)] + [(90, text(25, 90), "a")] * 3
    df = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, source string, position string, row int").repartition(4)
    got = mixing.mixed_documents(df).collect()
    counts = {r.row: 0 for r in df.collect()}
    for r in got:
        counts[r.row] += 1
    size = {k: len((t or "").split()) for k, (_, t, _) in enumerate(rows)}
    queue = {r.row: r for r in mixing.queue(df, same=F.col("row").cast("long")).withColumn("row", F.col("same")).collect()}
    for k, (_, t, s) in enumerate(rows):
        q = queue[k]
        left = [min(q.size, round(q.target) - e * q.source_size - q.before) for e in range(3)]
        assert counts[k] == sum(w > 0 and (2 * w >= q.size or (e == 0 and q.before == 0)) for e, w in enumerate(left)), k
    assert counts[5] >= 1 and counts[6] == counts[7] == 0
    taken = {r.doc_id: r for r in mixing.mix_counts(df).collect() if r.doc_id is not None}
    for s in "abc":
        words = sum(counts[k] * size[k] for k in counts if rows[k][2] == s)
        target = next(q.target for k, q in queue.items() if rows[k][2] == s)
        assert abs(words - target) <= 400 * 0.5 + 1
    assert all((r.position is None) == (r.taken == 0) and r.taken <= 3 * r.size for r in taken.values())


def test_equal_rows_are_mixed_as_often_as_there_are(spark):
    rows = [(7, "one two three", "a")] * 4 + [(8, "four five", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert got == Counter({7: 4, 8: 1})


def test_keys_are_counted_in_bounded_tasks(docs, rows, monkeypatch):
    plain, dealt = hamming_join.chunk_keys, []
    monkeypatch.setattr(hamming_join, "COUNTED", 10)
    monkeypatch.setattr(hamming_join, "chunk_keys", lambda reps: dealt.append((reps.rdd.getNumPartitions(), reps.count())) or plain(reps))
    got = hamming_join.near_duplicates(docs, 5).collect()
    assert any(n == -(-classes // 10) > 1 for n, classes in dealt)
    want, _ = brute_components(rows, 5, 80)
    assert key((r.doc_id, r.component_id) for r in got) == key((i, c) for i, _, c in want)


def test_readers_get_few_rows_and_workers_give_memory_back(spark, monkeypatch):
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    common.ready(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(common.BATCH_ROWS)

    class Caught:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    trimmed = []
    monkeypatch.setattr(common, "trim", lambda: trimmed.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    assert list(common.map_batches(Caught(), lambda b: b, "x long")(iter([batch]))) == [batch]
    assert trimmed
