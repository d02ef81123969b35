"""The trie of conversations against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from voxmill.llm import registry, trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    out = []
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        sums[node] = (sum(sums[x][0] for x in children[node]) or 1, saved + sum(sums[x][1] for x in children[node]))
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(node))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, longest=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*rng.integers(0, 90, n).tolist(), *rng.integers(-45, 3000, n).tolist(), 2**62 + 1, 2**62 + 3, -(2**61)]:
        for t in range(int(rng.integers(1, longest))):
            rows.append((int(c), None if rng.random() < 0.1 else t, [None, "user", "assistant"][rng.integers(0, 3)], [None, "", "a b", "hello  there\tyou", "c" * 30][int(rng.integers(0, 5))]))
    rows += [(400, t, "user", "again and again" if t < 600 else f"x{t}") for t in range(700)]
    rows += [(401 + k, t, "user", "again and again") for k in range(3) for t in range(300 * k + 5)]
    return rows + [(None, 1, "user", "lost")]


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


@pytest.mark.parametrize("seed", [3, 4])
def test_trie_equals_a_plain_one(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "SEGMENT", 64)
    rows = conversations(60, seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in trie.trie_query(df).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_equals_sql(spark, tmp_path):
    rows = conversations(80, 9)
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = registry.op12_trie(spark, str(tmp_path))
    want = db.sql(trie.ORACLE)
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_no_conversations(spark):
    assert trie.trie_query(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("held", [2, 50, 10**6])
def test_queues_that_spill_lose_no_message(held):
    rng = np.random.default_rng(1)
    up = [None, *(int(rng.integers(max(0, k - 40), k)) for k in range(1, 3000))]
    depth = [0]
    for k in range(1, 3000):
        depth.append(depth[up[k]] + 1)
    want = [[1, k] for k in range(3000)]
    for k in range(2999, 0, -1):
        for n in (0, 1):
            want[up[k]][n] += want[k][n]
    order = sorted(range(3000), key=lambda k: (-depth[k], -k))
    rows = [(k, depth[k], up[k], depth[up[k]] if k else None, 1, k) for k in order]
    got = {r[0]: [r[2], r[3]] for r in trie.totals(iter(rows), held)}
    assert got == {k: w for k, w in enumerate(want)}
    if held < 100:
        q = trie.SpillingQueue(held)
        for k in range(500):
            q.push((k % 7,), (1, k))
        assert q.spills > 3 and [q.take((k,))[0] for k in range(7)] == [72] * 3 + [71] * 4


def test_totals_cross_shards(spark):
    rng = np.random.default_rng(4)
    rows, up = [(0, 0, None, 1, 2)], {0: []}
    path = {(0, 0): None}
    for k in range(1, 400):  # conversation ids far apart: nearly every parent is in another shard
        c = k * 1000
        p = list(path)[int(rng.integers(0, len(path)))]
        for d in range(p[1] + 1, p[1] + 1 + int(rng.integers(1, 4))):
            path[c, d] = p
            rows.append((c, d, p[0], 1, c + d))
            p = (c, d)
    sums = {k: [1, 2 if k == (0, 0) else k[0] + k[1]] for k in path}
    for k in sorted(path, key=lambda x: -x[1]):
        if path[k] is not None:
            for n in (0, 1):
                sums[path[k]][n] += sums[k][n]
    got = trie.subtree_totals(spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, n_leaves long, saved long"))
    assert {(r.conv_id, r.depth): [r.n_leaves, r.saved] for r in got.collect()} == sums
