"""Periodic runs against their definition."""

import hashlib
import zlib

import numpy as np
import pytest

from voxmill.llm import registry, runs


def plain_runs(words, least=24, times=3):
    """By definition: every period's longest stretches, each under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
    gone = {k for s, m, q in r for k in range(s + q, s + m)}
    from fractions import Fraction

    best = min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(r), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in r).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def texts():
    rng = np.random.default_rng(5)
    words = lambda n, k=50: [f"w{x}" for x in rng.integers(0, k, n)]
    out = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "A a " * 12, "a " * 500, "x y z " * 30]
    for q, m in ((1, 24), (2, 24), (5, 24), (7, 23), (8, 24), (9, 26), (9, 27), (40, 119), (40, 120), (40, 333)):
        part = words(q, 1000)
        out.append(" ".join(words(17) + [part[i % q] for i in range(m)] + words(11)))
    for k in (1, 2, 3):
        out += [" ".join(words(n, k)) for n in (30, 200, 900)]
    fib = ["a", "b"]
    while len(fib) < 800:
        fib += fib[: len(fib)][: 1 + len(fib) * 5 // 8]
    out.append(" ".join(fib))
    nested = (["a"] * 30 + ["b"]) * 4 + ["c"] * 24 + ["d"] + ["c"] * 60
    out.append(" ".join(nested * 3))
    out += [" ".join(words(60, 9) * 4 + words(5)) for _ in range(5)]
    return out


def test_runs_equal_their_definition():
    for text in texts():
        w = (text or "").split(" ")
        names = {x: k for k, x in enumerate(dict.fromkeys(w))}
        x = np.array([names[a] for a in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert [tuple(map(int, r[1:])) for r in runs.runs(x, np.array([0, len(x)]))] == plain_runs(w)


def test_extensions_equal_plain_comparisons(monkeypatch):
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 50):
        x = np.concatenate([[10**6], rng.integers(0, k, 700), [10**6 + 1]]).astype(np.uint64)
        x[300:500] = x[50:250]
        g = runs.recompress(x)
        assert k == 1 or len(g.symbol) < 12 * len(x)
        a, b = rng.integers(1, 701, (2, 500))
        a, b = np.concatenate([a, np.arange(50, 250)]), np.concatenate([b, np.arange(300, 500)])
        a, b = a[a != b], b[a != b]
        for forward, sign in ((True, 1), (False, -1)):
            want = []
            for i, j in zip(a, b, strict=True):
                n = 0
                while x[i + sign * n] == x[j + sign * n]:
                    n += 1
                want.append(n)
            assert runs.extension(g, a, b, forward).tolist() == want


@pytest.mark.parametrize("batch", [7, 1 << 20])
def test_batches_of_candidates_make_no_difference(batch, monkeypatch):
    monkeypatch.setattr(runs, "BATCH", batch)
    w = (["a"] * 30 + ["b"]) * 4 + ["c"] * 24
    x = np.array([ord(c) for c in w], np.uint64)
    both = np.concatenate([x, x[:40]])
    got = runs.runs(both, np.array([0, len(x), len(x), len(both)]))
    want = [(0, *r) for r in plain_runs(w)] + [(2, *r) for r in plain_runs(w[:40])]
    assert [tuple(map(int, r)) for r in got] == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_query_equals_plain_version(spark, tmp_path):
    rows = [(k, t, k) for k, t in enumerate(texts() * 3)] + [(None, "b " * 40, 0), (7, "b " * 40, 0), (7, "b " * 40, 1), (-3, "c d " * 40, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op13_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)
    assert any(r.n_runs for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_empty_documents(spark):
    assert runs.digests(runs.periodic_runs(runs.with_planted_tails(spark.createDataFrame([], "doc_id long, text string")))).count() == 0
