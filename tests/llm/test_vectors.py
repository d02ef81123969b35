"""The two vector searches against brute force."""

import numpy as np
from pyspark.sql import Row

from voxmill.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, e int"


def rows_of(vectors):
    return [Row(vec_id=i, embedding=None if v is None else [None if x is None else float(x) for x in v], rank=0, score="x", e=1) for i, v in vectors]


def cases():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[50]
    vectors = [(i, v) for i, v in enumerate(x)]
    vectors += [(300, None), (301, [float("nan")] * 16), (302, [None] * 16), (303, [0.0] * 16), (304, []), (305, [float("inf")] * 16), (None, x[0])]
    return x, [*vectors, (7, x[7])]


def brute(scores, ids, q, k):
    s = scores.copy()
    keep = ids != q
    order = np.lexsort((ids[keep], -s[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_ann_finds_all_neighbours_of_a_small_table(spark):
    x, vectors = cases()
    found = got(ann.search(spark.createDataFrame(rows_of(vectors), SCHEMA)))
    ids = np.arange(300)
    assert sorted(found) == list(range(0, 300, 20))
    for q in found:
        want = brute((x.astype(float) * x[q].astype(float)).sum(axis=1), ids, q, 20)
        assert [v for v, _ in found[q]] == [v for v, _ in want]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want])


def recall_of(found, x, k=20):
    ids = np.arange(len(x))
    hit = [len({v for v, _ in found[q]} & {v for v, _ in brute(x.astype(float) @ x[q].astype(float), ids, q, k)}) for q in found]
    return sum(hit) / (k * len(found))


def test_ann_windows_follow_the_vectors(spark, monkeypatch):
    """Clustered vectors get narrow windows, vectors without structure wide ones; both reach the recall."""
    rng = np.random.default_rng(3)
    clustered = (rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.1 * rng.normal(size=(4000, 8))).astype(np.float32)
    clustered /= np.linalg.norm(clustered, axis=1, keepdims=True)
    sphere = rng.normal(size=(4000, 48)).astype(np.float32)
    sphere /= np.linalg.norm(sphere, axis=1, keepdims=True)
    looked, measured = [], ann.measured_windows
    monkeypatch.setattr(ann, "measured_windows", lambda *a: looked.append(measured(*a)) or looked[-1])
    for x in (clustered, sphere):
        found = got(ann.search(spark.createDataFrame(rows_of(enumerate(x)), SCHEMA), block=400))
        assert len(found) == 200 and recall_of(found, x) >= 0.9
    (few, narrow), (many, wide) = looked
    assert few * (2 * narrow + 1) < 4000 / 3 and many * min(4000, 2 * wide + 1) <= 4000


def test_ann_measures_with_true_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>").repartition(3)
    pairs = ann.true_neighbours(reps, reps.where("vec_id % 50 = 0"), 7)
    want = {(q, v) for q in range(0, 500, 50) for v, _ in brute(x @ x[q], np.arange(500), q, 7)}
    assert len(pairs) == len(want) and set(pairs) == want
    assert ann.true_neighbours(reps, reps.limit(0), 7) == []


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(2 ** (bits * dims)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_topk_is_exact(spark):
    x, vectors = cases()
    found = got(topk.top_k(spark.createDataFrame(rows_of(vectors), SCHEMA)))
    e = np.floor(256 * np.vstack([x, np.zeros((1, 16))]).astype(float)).astype(np.int64)
    ids = np.array([*range(300), 303])
    assert sorted(found) == list(range(0, 300, 50))
    for q in found:
        assert found[q] == brute(e @ e[q], ids, q, 5)


def test_topk_block_needs_no_luck_with_bounds():
    rng = np.random.default_rng(1)
    c, q = rng.integers(-300, 300, (500, 30)), rng.integers(-300, 300, (20, 30))
    low = np.full(20, -(2**62))
    for one, floor in zip(q, low, strict=True):
        (best,) = topk.search_block(one[None], np.array([-1]), np.array([floor]), c, np.arange(500), 7)
        assert list(zip(best.vec_id, best.score, strict=True)) == brute(c @ one, np.arange(500), -1, 7)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty).count() == 0
    assert topk.top_k(empty).count() == 0
