"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdforge.llm import e8, lattice_hash, permutation_index
from mdforge.llm.collection_bwt import build, repeated_suffixes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[50] + 0.06 * rng.normal(size=(40, 16))  # a group of near copies
    x[100:130] = x[100]  # equal vectors
    x[131] = 3 * x[130]  # the same direction
    rows = [(i, x[i].tolist(), 0, "k", 0.5) for i in range(400)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (None, x[3].tolist())]
    frame = spark.createDataFrame(rows + [(i, v, None, None, None) for i, v in odd], SCHEMA).repartition(4)
    return frame, x.astype(np.float64)


def test_near_vectors_equal_brute_force(spark, table):
    frame, x = table
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    got = {r.vec_id: r for r in lattice_hash.near_vectors(frame).collect()}
    assert len(got) == 408
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1007))
    assert lattice_hash.near_vectors(frame.limit(0)).count() == 0


def test_blocks_of_a_large_component(table, monkeypatch):
    frame, _ = table
    want = {r.vec_id: tuple(r) for r in lattice_hash.near_vectors(frame).collect()}
    monkeypatch.setattr(lattice_hash, "BLOCK", 7)
    assert {r.vec_id: tuple(r) for r in lattice_hash.near_vectors(frame).collect()} == want


def test_nearest_has_recall_and_exact_scores(table):
    frame, x = table
    got = permutation_index.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 400, 20))
    recall = []
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        recall.append(len({v for v, _ in found} & set(want.tolist())) / 20)
        assert all(abs(score - s[v]) < 1e-9 for v, score in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and len(found) == 20
    assert np.mean(recall) >= 0.9
    assert permutation_index.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = permutation_index.nearest(frame.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4


def recall(spark, x, queries):
    """Mean recall by id of the 20 nearest rows, ties to the smaller id."""
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = permutation_index.nearest(frame, F.col("vec_id").isin(queries)).collect()
    by = {q: {r.vec_id for r in got if r.query_id == q} for q in queries}
    out = []
    for q in queries:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        out.append(len(by[q] & set(np.lexsort((np.arange(len(x)), -s))[:20].tolist())) / 20)
    return np.mean(out)


@pytest.mark.parametrize("noise", [0.0, 0.01, 0.1])
def test_recall_beside_a_third_of_copies(spark, noise):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 2000)] + 1.5 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:667] = x[0] + noise * x.std(0) * rng.normal(size=(667, 64))
    assert recall(spark, x, list(range(700, 2000, 26))) >= 0.93
    assert recall(spark, x, list(range(0, 667, 26))) >= (0.9 if noise else 1)


def test_e8_decodes_to_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    c = e8.decode(x)
    far = ((x - c) ** 2).sum(1)
    assert (far <= 1 + 1e-9).all()
    assert all((((x - c - v) ** 2).sum(1) >= far - 1e-9).all() for v in e8.STEPS)
    assert len(e8.STEPS) == 240 and np.allclose((e8.STEPS**2).sum(1), 2)


def test_collection_transform_equals_sorted_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strings = [rng.integers(1, rng.integers(2, 5), rng.integers(0, 12)) for _ in range(rng.integers(1, 9))]
        symbols, ends = np.concatenate(strings).astype(np.uint16), np.cumsum([len(s) for s in strings])
        suffixes = sorted(((*map(int, s[i:]), k - 100), int(s[i - 1]) if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1))
        bwt, lcp = build(symbols, ends, 200)
        assert bwt.tolist() == [b for _, b in suffixes]
        shared = lambda p, q: next((i for i, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), 0)
        assert lcp.tolist() == [0] + [shared(a, b) for (a, _), (b, _) in zip(suffixes, suffixes[1:], strict=False)]
        depth = int(rng.integers(1, 5))
        windows = [tuple(s[i : i + depth]) if i + depth <= len(s) else None for s in strings for i in range(len(s))]
        assert repeated_suffixes(symbols, ends, depth).tolist() == [w is not None and windows.count(w) > 1 for w in windows]


def test_near_vectors_of_double_columns(spark):
    """Pairs of double vectors a hair above and below the threshold."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(200):
        x, y = rng.normal(size=16), rng.normal(size=16)
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        c = 0.95 + (1e-9 if k % 2 else -1e-9)
        z = c * x + np.sqrt(1 - c * c) * y
        linked = float(x @ z / (np.linalg.norm(x) * np.linalg.norm(z)) >= 0.95)
        rows += [(2 * k, [float(v) for v in x]), (2 * k + 1, [float(v) for v in z])]
        want[2 * k] = want[2 * k + 1] = linked
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in lattice_hash.near_vectors(df).collect()}
    assert all((got[i] == got[i ^ 1]) == bool(w) for i, w in want.items())
