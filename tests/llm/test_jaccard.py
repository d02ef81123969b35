"""The n-gram Jaccard join against brute force and SQL."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

from voxmill.llm import jaccard


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t, size=3):
    w = words_of(t)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def plain(rows, percent=90):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if v == old else v for k, v in group.items()}
    return sorted(((i, len(grams(t)), group.get(i)) for i, t in rows), key=str)


def prose(rng, n, vocabulary):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed, vocabulary):
    """Families of edited copies around the threshold, common phrases, short and blank texts, repeated and null ids."""
    rng = random.Random(seed)
    rows = [(None, "a b c d"), (500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "a b"), (506, "A  B"), (507, "a b c"), (508, "é" * 5000)]
    k = 0
    for size, n in ((2, 40), (3, 100), (12, 60), (25, 120), (5, 400), (4, 30)):
        base = prose(rng, n, vocabulary)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 50))):
                w[rng.randrange(n)] = f"x{rng.random()}"
            if rng.random() < 0.3:
                w = w[rng.randint(0, n // 30) :]
            rows.append((k, " ".join(w)))
            k += 1
    phrase = prose(rng, 25, vocabulary)
    rows += [(100 + i, " ".join(phrase + prose(rng, rng.randint(0, 3), vocabulary))) for i in range(30)]
    rows += [(200 + i, " ".join(prose(rng, rng.randint(1, 60), vocabulary))) for i in range(30)]
    rows += [(7, rows[15][1]), (300, rows[20][1].upper()), (300, rows[40][1]), (300, rows[40][1]), (None, rows[20][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", 2, 3) for i, t in rows], "doc_id long, text string, n int, gram string, rep int, label int")


@pytest.mark.parametrize(("seed", "vocabulary", "block", "counters"), [(1, 10**6, 1024, 1 << 24), (2, 6, 4, 1 << 16), (3, 300, 3, 1 << 18)])
def test_joined_documents_equal_brute_force(spark, monkeypatch, seed, vocabulary, block, counters):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed, vocabulary)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined_documents(frame(spark, rows), counters=counters).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_joined_documents_equal_sql(spark):
    rows = corpus(4, 40)
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = jaccard.joined_documents(frame(spark, rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, db.sql(jaccard.ORACLE).fetchall()))


def test_no_documents(spark):
    assert jaccard.joined_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 10**6, n))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.05], rng.integers(0, 10**6, int(rng.integers(0, 4)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            px, py = (z[:p] for z, p in zip((x, y), jaccard.prefix_sizes(np.array([len(x), len(y)]), 90), strict=True))
            assert len(np.intersect1d(px, py))
