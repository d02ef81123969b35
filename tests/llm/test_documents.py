"""Operators on documents: hard rows of every kind, and brute force on small tables."""

import random
import re
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from voxmill.llm import gru, lines, minhash, mixing, packing, substrings, text, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n long, h string, words int, d string, rep long, _LINE_key string, _line_doc int, _mix int, _mix_size int, lines int, bucket int, links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 5, "k", 1, "h", 2, "d", 3, "l", 4, 5, 6, 7, 8, 9) for i, t, s in rows], SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words_of(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 90)), rng.choice(["a", "b", "c", None])) for i in range(1, 60)]
    rows += [(100, base, "a"), (101, base, "a"), (102, base.upper(), "b"), (103, base + " tail", "c"), (104, "start " + base, None)]
    rows += [(110 + i, f"{prose(rng, 30)} {passage} {prose(rng, 40)}", "a") for i in range(4)]
    rows += [(200, None, None), (201, "", "a"), (202, " \n\t ", "b"), (203, "one", "a"), (204, "one", "c"), (205, "é" * 3000, "d"), (206, prose(rng, 9000), "a")]
    rows += [(7, rows[6][1], rows[6][2]), (100, base, "a"), (None, base, "a"), (None, None, None), (8, prose(rng, 70), "b")]
    rows += [(300 + i, f"line one of {i} is its own\n{'a shared line that stands in many documents ' * 2}\nthe end of {i} is here", "b") for i in range(9)]
    return rows


def test_hashes_of_words_and_shingles():
    texts = ["The cat\tsat", None, "", "the CAT sat", "É é", "a b c d e f"]
    for _, data, at in text.slices(pa.array(texts)):
        h, rows = text.word_hashes(data, at)
        s, ends = text.shingles(h, rows)
    assert np.diff(rows).tolist() == [3, 0, 0, 3, 2, 6]
    assert (h[:3] == h[3:6]).all() and h[6] != h[7]
    assert np.diff(ends).tolist() == [1, 0, 0, 1, 1, 2]
    assert s[0] == s[1] and len(set(s.tolist())) == 4


def test_slices_cover_all_rows_of_sliced_arrays():
    a = pa.array(["x" * 10, None, "yy", "z" * 30, ""]).slice(1)
    seen = [(f, len(at) - 1, bytes(d)) for f, d, at in text.slices(a, 8)]
    assert sum(n for _, n, _ in seen) == 4 and b"".join(d for *_, d in seen) == b"yy" + b"z" * 30


def plain_components(rows):
    """Smallest reachable doc_id of each doc_id; all texts of a repeated one count."""
    sets = [(i, shingle_set(t)) for i, t, _ in rows if i is not None]
    group = {i: i for i, _ in sets}
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {k: new if v == old else v for k, v in group.items()}
    return group


def test_near_duplicates_equal_brute_force(spark, hard):
    group = plain_components(hard)
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, hard)).collect()]
    want = [(i, len(shingle_set(t)), group.get(i), group.get(i) == i or i is None) for i, t, _ in hard]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_near_duplicates_of_repeated_ids(spark):
    """A document with several texts links what each of them is like, whatever their sizes and order."""
    rng = random.Random(14)
    a, b, c, d = (prose(rng, n, 10**6) for n in (60, 90, 70, 80))
    rows = [(1, a, "a"), (2, a, "a"), (2, b, "a"), (9, b + " end", "a"), (5, c, "a"), (5, c, "a"), (5, d, "b"), (7, d, "a"), (7, None, "a"), (4, c + " x", "a"), (8, prose(rng, 30, 10**6), "a"), (8, "", "a")]
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    group = plain_components(rows)
    assert group[9] == 1 and group[7] == 4
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == sorted((i, len(shingle_set(t)), group[i], group[i] == i) for i, t, _ in rows)


def test_near_duplicates_equal_sql(spark, hard):
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", hard)
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, hard)).collect()]
    assert sorted(map(str, out)) == sorted(map(str, db.sql(minhash.ORACLE).fetchall()))


def test_near_duplicates_of_hard_rows(spark, hard):
    out = minhash.near_duplicates(frame(spark, hard)).collect()
    assert len(out) == len(hard)
    assert all(r.kept for r in out if r.doc_id is None)


def test_large_buckets_lose_no_link(spark):
    # copies that are alike only through what they were made from, beside documents that share half of it
    rng = random.Random(9)
    base = prose(rng, 300, 10**6).split()
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 60):
        w = list(base)
        for _ in range(7):
            w[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(w), "a"))
    rows += [(100 + i, " ".join(base[:200]) + " " + prose(rng, 100, 10**6), "a") for i in range(40)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: shingle_set(t) for i, t, _ in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    for a, b in combinations(sets, 2):
        assert not near(a, b) or out[a] == out[b]
    assert len({out[i] for i in range(100, 140)}) == 40


def test_posterior_bounds_rise_with_what_was_compared():
    rule = minhash.least_matches(96, 16, 0.75, 1e-5)
    assert [n for n, _ in rule] == [16, 32, 48, 64, 80, 96]
    assert all(m / n <= 0.75 for n, m in rule) and rule[-1][1] > 48


def test_mix_reaches_its_targets(spark, hard):
    out = mixing.mix(frame(spark, hard)).collect()
    assert len(out) == len(hard)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r.source] += r.size
        target[r.source] = max(target.get(r.source, 0), r.target)
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    for s, n in size.items():
        # whole copies: what the largest document misses is more than the others may be able to make up for
        assert target[s] <= 3 * n + 1e-6 and abs(taken[s] - target[s]) <= max(r.size for r in out if r.source == s) / 2 + 30
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    open_ = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    assert len({round(target[s] / weights[s], 6) for s in open_}) == 1
    again = mixing.mix(frame(spark, hard).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what is above the cap is shared again among the rest, until none is."""
    order = sorted((s for s in sizes if s is not None and sizes[s]), key=lambda s: [ord(c) for c in s]) + ([None] if sizes.get(None) else [])
    weight, target = {s: weights[k % len(weights)] for k, s in enumerate(order)}, {}
    while True:
        open_ = [s for s in order if s not in target]
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**target, **share}
        target |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_plain_shares(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([3, 40, 500, 9000, 10**5]) for s in ["a", "Z", "\U0001f600", "\uffee", "é", None][: rng.randint(1, 6)]}
    stats = spark.createDataFrame([("~" if s is None else s.encode().hex().upper(), n) for s, n in sizes.items()], "key string, words long")
    out = {r.key: (r.source_size, r.target) for r in mixing.source_targets(stats).collect()}
    want = plain_targets(sizes)
    assert {k: v[1] for k, v in out.items()} == pytest.approx({"~" if s is None else s.encode().hex().upper(): t for s, t in want.items()})


def test_mix_equals_a_plain_mix(spark, hard, monkeypatch):
    """Each source's target; then the same pairs, shard by shard and level by level, one word transfer at a time."""
    import zlib
    from math import floor, log2

    monkeypatch.setattr(mixing, "SHARD", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(19)
    rows = [*hard, *((1000 + i, prose(rng, rng.choice([1, 1, 2, 30])), "bd"[i % 2]) for i in range(900))]
    sizes, units = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(words_of(t))
        units[-(2**63) if i is None else i, s, len(words_of(t))] += 1
    target = plain_targets(sizes)
    out = mixing.mix(frame(spark, rows))
    shard = {(r.d, r.size): r.h for r in spark.createDataFrame([(k[0], k[2]) for k in units], "d long, size long").distinct().selectExpr("d", "size", "xxhash64(d, size) h").collect()}
    groups, copies = defaultdict(list), {}
    key = lambda s: "~" if s is None else s.encode().hex().upper()
    classes = defaultdict(int)
    for (_, s, n), c in units.items():
        classes[s, floor(log2(n * c)) if n else -1] += 1
    most = max(classes.values())
    for (i, s, n), c in units.items():
        if not n:
            copies[i, s, n] = 1
            continue
        share, cl = target[s] / sizes[s], floor(log2(n * c))
        groups[s, cl, shard[i, n] % -(-classes[s, cl] // mixing.SHARD)].append([i, n, c, floor(share), share - floor(share)])
    level, shards = 0, -(-most // mixing.SHARD)
    while True:
        left = defaultdict(list)
        for (s, cl, sh), own in groups.items():
            draw = np.random.default_rng(zlib.crc32(f"{level}/{key(s)}/{cl}/{sh}".encode()))
            own.sort(key=lambda u: u[:3])
            own = [own[k] for k in draw.permutation(len(own))]
            luck, open_ = draw.random(len(own)), None
            for k, u in enumerate(own):
                u[4] *= u[1] * u[2]  # words
                if open_ is not None:
                    w, v = open_[1] * open_[2], u[1] * u[2]
                    up, down = min(w - open_[4], u[4]), min(open_[4], v - u[4])
                    move = up if luck[k] * (up + down) < down else -down
                    open_[4], u[4] = open_[4] + move, u[4] - move
                if open_ is None or min(open_[4], open_[1] * open_[2] - open_[4]) <= 1e-9 * open_[1] * open_[2]:
                    open_ = u
            for u in own:
                part = u[4] / (u[1] * u[2])
                if min(part, 1 - part) <= 1e-9:
                    copies[u[0], s, u[1]] = u[3] + round(part)
                else:
                    left[s, cl, sh // mixing.FAN_IN].append([*u[:4], part])
        if shards <= 1:
            break
        groups, shards, level = left, -(-shards // mixing.FAN_IN), level + 1
    last = defaultdict(list)
    for (s, _, _), own in left.items():
        last[s] += own
    for s, own in last.items():
        error = 0.0
        for i, n, c, whole, part in sorted(own, key=lambda u: (-u[1] * u[2], u[0])):
            got = min(max(round((part * n * c + error) / (n * c)), -whole), 3 - whole)
            error += (part - got) * n * c
            copies[i, s, n] = whole + got
    seen = {(-(2**63) if r.doc_id is None else r.doc_id, r.source, r.size): (r.copies, r.target, r.source_size) for r in out.collect()}
    assert {k: v[0] for k, v in seen.items()} == copies
    assert all(v[2] == sizes[k[1]] and v[1] == pytest.approx(target.get(k[1], 0)) for k, v in seen.items())
    assert level > 1


def test_pairs_keep_all_words():
    import pandas as pd

    pdf = pd.DataFrame({"doc_id": range(200), "size": np.arange(200) + 1, "rows": 1, "part": 0.37})
    out = mixing.settle(pdf.copy(), "x")
    assert ((out["part"] % 1) > 0).sum() <= 1
    assert (out["part"] * out["size"]).sum() == pytest.approx((0.37 * pdf["size"]).sum())


def test_mixed_documents_repeat_their_rows(spark, hard):
    docs = frame(spark, hard)
    copies = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(copies[i, s, len(words_of(t))] for i, t, s in hard)


def plain_best_fit(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and source not in b[1] and (cluster is None or cluster not in b[2])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= size
        bins[k][1].add(source)
        if cluster is not None:
            bins[k][2].add(cluster)
        out.append(k)
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    pieces = sorted(((rng.randint(0, 60), rng.randrange(6), rng.choice([-1, 0, 1])) for _ in range(400)), reverse=True)
    got = packing.best_fit([p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], 100)
    assert got == plain_best_fit([(s, a, c if c >= 0 else None) for s, a, c in pieces], 100)


def test_packing_keeps_all_words_and_no_conflict(spark, hard):
    out = packing.pack(frame(spark, hard), capacity=64, shard_rows=20).collect()
    used, seen, per_bin = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in out:
        used[r.bin] += r.words
        seen[r.doc_id, r.copy].append((r.start, r.words))
        per_bin[r.bin].append((r.source, r.cluster))
    assert max(used.values()) <= 64 and len(seen) == len(hard)
    assert sum(used.values()) == sum(len(words_of(t)) for _, t, _ in hard)
    for spans in seen.values():
        ends = 0
        for start, n in sorted(spans):
            assert start == ends
            ends += n
    for held in per_bin.values():
        for k in (0, 1):
            own = [h[k] for h in held if h[k] is not None]
            assert len(own) == len(set(own))


def test_packing_tells_rows_without_an_id_apart(spark):
    rows = [(None, "same words here", "x")] * 3 + [(None, f"words {n}", None) for n in range(40)] + [(7, "a b", "x"), (7, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(docs, capacity=8).collect()
    assert len({(r.doc_id, r.copy) for r in out}) == len(rows) == len(out)
    assert sorted(r.copy for r in out if r.doc_id == 7) == [1, 2]
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, packing.pack(docs.repartition(3), capacity=8).collect()), key=str)


def test_patience_alignment():
    assert lines.patience([1, 2, 3, 4], [0, 2, 3, 9, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([], [1]) == []
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 30))] for _ in range(2))
        found = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < y for p, q in zip(found, found[1:], strict=False) for x, y in zip(p, q, strict=True))


def plain_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [5, 1 << 26])
def test_parts_without_lines_that_occur_once_are_aligned(monkeypatch, cells):
    monkeypatch.setattr(lines, "CELLS", cells)
    assert lines.patience([1, 5, 5, 2], [3, 5, 5, 4]) == [(1, 1), (2, 2)]
    assert lines.patience([1, 5, 6, 5, 6, 2], [3, 5, 6, 5, 6, 4]) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    rng = random.Random(6)
    for _ in range(80):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 70))] for _ in range(2))
        found = sorted(lines.subsequence(a, b))
        assert len(found) == plain_subsequence(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < y for p, q in zip(found, found[1:], strict=False) for x, y in zip(p, q, strict=True))


def test_lines_that_stand_twice_and_thrice_are_deleted(spark, monkeypatch):
    line = "this line is long enough and stands again and again here"
    rows = [(i, "\n".join([f"the beginning of document {i} is its own", *[line] * 2, f"the end of document {i} is its own"]), "a") for i in range(300)]
    rows += [(400 + i, "\n".join(f"{w} {i} of this document" if w else "thrice: " + line for w in ("one", None, "two", None, "three", None, "four")), "a") for i in range(40)]
    aligned, align = [], lines._align
    monkeypatch.setattr(lines, "_align", lambda pairs, *rest: aligned.append(pairs.count()) or align(pairs, *rest))
    out = {r.doc_id: r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert out[0].deleted_lines == 0 and all(out[i].deleted_lines == 2 and line not in out[i].text for i in range(1, 300))
    assert out[400].deleted_lines == 0 and all(out[400 + i].deleted_lines == 3 for i in range(1, 40))
    assert sum(aligned) < 4 * len(rows)


def test_line_dedup_deletes_from_the_later_document(spark, hard):
    docs = frame(spark, hard)
    out = lines.dedup_lines(docs).collect()
    assert len(out) == len(hard)
    shared = "a shared line that stands in many documents a shared line"
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    assert shared in by_id[300][0].text
    assert all(shared not in by_id[300 + i][0].text and f"line one of {i} " in by_id[300 + i][0].text for i in range(1, 9))
    assert {r.text for r in by_id[101]} == {""} and by_id[200][0].text is None and by_id[200][0].n_lines == 0
    kept = {i: t for i, t, _ in hard if i is not None and i < 60 and i not in (7, 8)}
    assert all(by_id[i][0].text == t for i, t in kept.items())


def test_line_dedup_equals_plain_version(spark):
    rng = random.Random(8)
    pool = [f"this is the pool's line number {i} and it is long enough" for i in range(30)]
    rows = []
    for i in range(40):
        at = rng.randrange(24)
        rows.append((i, "\n".join([f"own line {i} {k} of some length" for k in range(3)] + (pool[at : at + 4] if i % 2 else [])), "a"))
    out = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    seen = set()
    for i, t, _ in rows:
        own = t.split("\n")
        assert out[i].split("\n") == [x for x in own if x not in seen]
        seen |= set(own)


def test_lines_that_cross_go_on_to_the_next_holders(spark):
    """Lines that cross in the alignment with their first holders, and blocks of frequent short lines."""
    x, y = "one line that is long enough to be deleted by itself", "another line that is long enough to be deleted too"
    rows = [(i, f"{y}\n{x}", "a") for i in range(9)] + [(20, f"own\n{x}", "a"), (21, f"{y}\nown too", "a")]
    rows += [(22, f"{x}\nwords of its own\n{y}", "a")]  # every one of the first nine leaves a line
    short = [f"short line {i} here" for i in range(3)]
    rows += [(30 + i, f"{short[i]}\nonly {i}", "a") for i in range(3)] + [(40 + i, "\n".join([f"start {i}", *short, f"end {i}"]), "a") for i in range(8)]
    rows = [(i, t + ("\n" + "fill of a first holder " * 2 + str(i) if i < 9 else ""), s) for i, t, s in rows]
    out = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert out[22] == "words of its own"
    assert out[40] == rows[[r[0] for r in rows].index(40)][1]
    assert all(out[40 + i] == f"start {i}\nend {i}" for i in range(1, 8))


def test_short_lines_of_many_holders_equal_brute_force(spark):
    """What any earlier document has of each, in blocks aligned one pair at a time; no line occurs twice in a document."""
    rng = random.Random(15)
    pool = [("x" * rng.randint(3, 16)) + f" {i}" for i in range(60)]
    docs = []
    for i in range(90):
        at = [rng.randrange(55) for _ in range(rng.randint(1, 4))]
        own = list(dict.fromkeys(x for p in at for x in pool[p : p + rng.randint(1, 7)]))
        own.insert(rng.randint(0, len(own)), f"document {i}'s line")
        docs.append(own)
    first = [[f"{pool[k]}", f"only in {k} here"] for k in range(0, 60, 6)]  # the block's lines are first held one by one
    docs = first + docs + [["begin", *pool[0:60:6], "end"] for _ in range(3)]
    out = {r.doc_id: (r.text, r.deleted_lines) for r in lines.dedup_lines(frame(spark, [(i, "\n".join(d), "a") for i, d in enumerate(docs)])).collect()}
    for i, d in enumerate(docs):
        gone = set()
        for e in docs[:i]:
            gone.update(lines.common_blocks([hash(x) for x in e], [hash(x) for x in d], [len(x) for x in d], lines.MIN_CHARS))
        assert out[i] == ("\n".join(x for k, x in enumerate(d) if k not in gone), len(gone)), i
    assert out[len(docs) - 1][0] == ""


def test_lines_are_alike_whatever_spaces_stand_around_them(spark):
    line = "17 lines of digits and words that are long enough, 10"
    texts = ["\n".join(["own", *["fill"] * i, " " * i + line + " " * (i % 2)]) for i in range(12)]
    out = {r.doc_id: r.deleted_lines for r in lines.dedup_lines(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert out[0] == 0 and all(out[i] >= 1 for i in range(1, 12))


def test_line_runs_cover_every_block():
    rng = random.Random(5)
    sizes = np.array([rng.randint(0, 9) for _ in range(40)])
    chars = np.array([rng.choice([0, 5, 11, 20, 45]) for _ in range(sizes.sum())], np.int32)
    hashes = np.array([rng.randrange(-(2**62), 2**62) for _ in chars], np.int64)
    first, last, key = lines.line_runs(hashes, chars, sizes, 40)
    runs = list(zip(first.tolist(), last.tolist(), strict=True))
    assert len(set(key.tolist())) == len(set(runs)) and all(chars[p : q + 1].sum() >= 40 for p, q in runs)
    for hi, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        for p in range(hi - n, hi):
            for q in range(p, hi):
                if chars[p : q + 1].sum() >= 40:
                    assert {x for x in range(p, q + 1) if chars[x]} <= {x for f, e in runs if p <= f and e <= q for x in range(f, e + 1)}


def test_substrings_find_every_repeated_passage(spark, hard):
    out = substrings.repeated_passages(frame(spark, hard)).collect()
    first, repeated = {}, set()
    for i, t, _ in sorted((r for r in hard if r[0] is not None and r[1]), key=lambda r: r[0]):
        w = words_of(t)
        runs = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        if any(first.get(x, i) != i for x in runs):
            repeated.add(i)
        for x in runs:
            first.setdefault(x, i)
    assert {r.doc_id for r in out} == repeated
    texts = {i: words_of(t) for i, t, _ in hard}
    for r in out:
        assert r.source_id < r.doc_id and r.end - r.start >= 50 and 100 * r.shared >= 75 * r.shingles
        x, y = (shingle_set(" ".join(w)) for w in (texts[r.doc_id][r.start : r.end], texts[r.source_id][r.source_start : r.source_end]))
        assert len(x & y) == r.shared and len(x | y) == r.shingles


def edited(rng, passage, edits):
    """The passage with words replaced, put in or left out."""
    out = list(passage)
    for _ in range(edits):
        x = rng.randrange(len(out))
        out[x : x + rng.choice([1, 1, 0])] = rng.choice([[rng.randrange(10**6, 10**9)], []])
    return out


def test_edited_passages_stay_whole():
    """Passages with evenly spread replaced words, far over the similarity, are found from end to end."""
    for n, changes in ((60, 1), (70, 1), (100, 2), (300, 8)):
        a = list(range(1000, 1000 + n))
        b = list(a)
        for x in range(changes):
            b[n * (2 * x + 1) // (2 * changes)] = 10**6 + x
        shingled = [np.array([hash(tuple(w[k : k + 5])) & 0xFFFFFFFF for k in range(len(w) - 4)], np.uint32) for w in (list(range(40)) + b + list(range(50, 90)), list(range(100, 130)) + a)]
        assert any(p[0] <= 40 and p[1] >= 40 + n - 4 for p in substrings.aligned_passages(*shingled, 46, 75)), (n, changes)


def test_passages_with_parts_in_another_order():
    p, q = np.arange(30, dtype=np.uint32), np.arange(100, 130, dtype=np.uint32)
    assert substrings.aligned_passages(np.concatenate([p, q]), np.concatenate([q, p]), 46, 75) == [(0, 60, 0, 60, 60, 60)]


def test_edited_passages_cover_brute_force():
    """Every shared shingle in two ranges of enough similarity is in a found passage, and every found passage is similar."""
    rng, width, percent, covered = random.Random(11), 12, 75, 0
    for _ in range(60):
        passage = [rng.randrange(10**6) for _ in range(rng.randint(14, 40))]
        other = [[rng.randrange(10**6, 10**9) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        words = [other[0] + passage + other[1], other[2] + edited(rng, passage, rng.randint(0, 4)) + other[3]]
        b, a = (np.array([hash(tuple(w[k : k + 3])) & 0xFFFFFFFF for k in range(len(w) - 2)], np.uint32) for w in words)
        if min(len(b), len(a)) < width:
            continue
        shared = np.zeros((len(b) + 1, len(a) + 1), int)
        shared[1:, 1:] = (b[:, None] == a).cumsum(0).cumsum(1)
        want = set()
        for lo in range(len(b) - width + 1):
            for hi in range(lo + width, len(b) + 1):
                row = shared[hi] - shared[lo]
                n = np.arange(len(a) + 1)
                both, every = row - row[:, None], (n - n[:, None]) + hi - lo
                similar = (n - n[:, None] >= width) & (100 * both >= percent * (every - both))
                if similar.any():
                    want |= {x for x in range(lo, hi) for y in np.flatnonzero(a == b[x]) if similar[: y + 1, y + 1 :].any()}
        found = substrings.aligned_passages(b, a, width, percent)
        assert all(100 * p[4] >= percent * p[5] and p[1] - p[0] >= width and p[3] - p[2] >= width for p in found)
        assert want <= {x for p in found for x in range(p[0], p[1])}
        covered += bool(want)
    assert covered > 20


def windows(rows):
    """(value, doc, centre, what stands on both sides, codes) with a reach of 40 to both sides."""
    look = [(near << 30) | codes for *_, near, codes in rows]
    columns = [*zip(*(r[:3] for r in rows), strict=True), [40] * len(rows), [40] * len(rows), look, [0] * len(rows)]
    return {k: np.array(x, t) for (k, t), x in zip(substrings.WINDOW, columns, strict=True)}


def test_blocks_of_windows_round_trip():
    rng = np.random.default_rng(1)
    w = {k: rng.integers(0, 2**31 - 1, 1000).astype(t) for k, t in substrings.WINDOW}
    w["doc"][:2] = -(2**63), 2**63 - 1
    w["value"][:2] = 2**64 - 1, 0
    back = substrings.unpacked(substrings.packed(w), 1000)
    assert all((back[k] == w[k]).all() and back[k].dtype == w[k].dtype for k in w)


def test_windows_meet_every_class_of_their_value():
    # document 1 twice, 2 twice and 3 on the same surroundings; 4 and 5 each on their own
    w, start = substrings.classes(windows([(8, 2, 30, 5, 0), (8, 1, 20, 5, 0), (8, 3, 7, 5, 0), (8, 2, 400, 5, 0), (8, 4, 9, 6, 0), (8, 5, 11, 7, 0), (12, 6, 9, 5, 0)]))
    met = np.concatenate([substrings.meetings(w, i, j, 46, 2) for i, j in substrings.partners(w, start)])
    assert {(int(m["b"]), int(m["a"]), int(m["bc"]), int(m["ac"])) for m in met} == {(2, 1, 30, 20), (2, 1, 400, 20), (3, 1, 7, 20), (4, 1, 9, 20), (5, 1, 11, 20), (5, 4, 11, 9)}


def test_very_common_values_meet_like_surroundings():
    rng = random.Random(6)
    kinds = [rng.randrange(2**30) for _ in range(400)]
    rows = [(8, 2 * i + half, 50, 1000 * i + half, code) for i, code in enumerate(kinds) for half in (0, 1)]
    w, start = substrings.classes(windows(rows))
    met = np.concatenate([substrings.meetings(w, i, j, 46, 2) for i, j in substrings.partners(w, start)])
    assert {(2 * i + 1, 2 * i) for i in range(400)} <= set(zip(met["b"].tolist(), met["a"].tolist(), strict=True))
    assert len(met) <= 3 * 16 * len(rows)


def test_hot_classes_are_linked_before_the_shuffle(spark):
    rng = random.Random(12)
    passage = prose(rng, 90, 10**6)
    rows = [(i, f"{prose(rng, 60, 10**6)} {passage} {prose(rng, 60, 10**6)}", "a") for i in range(60)]
    blocks = substrings.window_blocks(frame(spark, rows).coalesce(1).select("doc_id", "text"), 46, 5, 4, 3).collect()
    assert any(b.links for b in blocks) and len({b.bucket for b in blocks if not b.links}) == 3
    out = substrings.repeated_passages(frame(spark, rows).coalesce(1)).collect()
    assert {r.doc_id for r in out} == set(range(1, 60))
    assert all(min(r.end, 150) - max(r.start, 60) >= 85 for r in out if r.source_id == 0)


def test_groups_of_passages(spark):
    rows = [(2, 10, 70, 1, 0, 60, 50, 56), (3, 5, 65, 2, 12, 72, 50, 56), (4, 0, 60, 2, 200, 260, 50, 56), (9, 3, 70, 8, 3, 70, 60, 60), (3, 300, 400, 1, 500, 600, 90, 96)]
    found = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in substrings.NAMES))
    out = {(r.doc_id, r.start): (r.group_id, r.group_start) for r in substrings.passage_groups(found).collect()}
    assert out == {(2, 10): (1, 0), (3, 5): (1, 0), (4, 0): (2, 200), (9, 3): (8, 3), (3, 300): (1, 500)}
    assert substrings.passage_groups(found.limit(0)).count() == 0


def test_exact_runs_cover_every_repeat():
    rng = random.Random(13)
    for _ in range(400):
        kinds, width = rng.choice([2, 3, 50]), rng.choice([3, 5, 8])
        a, b = (np.array([rng.randrange(kinds) for _ in range(rng.randint(0, 60))], np.uint64) for _ in range(2))
        if min(len(a), len(b)) > 20:
            b[5:20] = a[2:17]
        lo = rng.randint(0, 5)
        own, held = b[lo:41].tolist(), {tuple(a[j : j + width].tolist()) for j in range(len(a) - width + 1)}
        want = {lo + i + x for i in range(len(own) - width + 1) if tuple(own[i : i + width]) in held for x in range(width)}
        runs = substrings.exact_runs(b, a, lo, 40, width)
        assert {x for p in runs for x in range(p[0], p[1])} == want
        assert all((b[p[0] : p[1]] == a[p[2] : p[3]]).all() and p[1] - p[0] >= width for p in runs)


def groups_of(rows):
    """Documents that found passages connect."""
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for r in rows:
        a, b = sorted((top(r.source_id), top(r.doc_id)))
        up[b] = a
    return top


@pytest.mark.parametrize(("families", "size", "words", "edits"), [(150, 2, 60, 1), (150, 2, 100, 2), (30, 10, 100, 1), (3, 100, 100, 1)])
def test_edited_passages_are_found(spark, families, size, words, edits):
    """Passages between unlike words; of the pairs that brute force calls similar, nearly all are connected."""
    rng = random.Random(words * size)
    rows, passages, pairs = [], {}, []
    for f in range(families):
        base = [rng.randrange(20_000) for _ in range(words)]
        ids = range(f * size, (f + 1) * size)
        for i in ids:
            own = list(base)
            for _ in range(edits if i % 2 or size > 2 else 0):
                own[rng.randrange(words)] = rng.randrange(10**6, 10**9)
            passages[i] = shingle_set(" ".join(map(str, own)))
            rows.append((i, " ".join([prose(rng, 80, 20_000), *map(str, own), prose(rng, 80, 20_000)]), "a"))
        pairs += [(a, b) for a, b in combinations(ids, 2) if 100 * len(passages[a] & passages[b]) >= 75 * len(passages[a] | passages[b])]
    out = substrings.repeated_passages(frame(spark, rows)).collect()
    top = groups_of([r for r in out if r.start <= 80 + words // 2 < r.end])
    assert np.mean([top(a) == top(b) for a, b in pairs]) >= 0.97
    assert len({top(i) for i in range(families * size)}) >= families
    direct = {(r.source_id, r.doc_id) for r in out}
    assert size > 2 or np.mean([p in direct for p in pairs]) >= 0.97


@pytest.mark.parametrize(("stock", "pairs", "filler"), [(40, 200, 2000), (20, 200, 2000), (8, 200, 4000), (8, 200, 0)])
def test_passages_of_stock_phrases_are_found(spark, stock, pairs, filler):
    """Text of stock phrases: brute force finds the pairs that repeat 50 words, and nearly all have a row."""
    rng = random.Random(stock + filler)
    phrases = [prose(rng, 20, 10**6) for _ in range(stock)]
    orders = rng.sample([(x, y, z) for x in range(stock) for y in range(stock) for z in range(stock)], pairs)
    rows = [(2 * n + half, f"{prose(rng, 80, 10**6)} {' '.join(phrases[x] for x in order)} {prose(rng, 80, 10**6)}", "a") for n, order in enumerate(orders) for half in (0, 1)]
    rows += [(10_000 + i, " ".join(f"{prose(rng, 40, 10**6)} {rng.choice(phrases)}" for _ in range(3)), "a") for i in range(filler)]
    holders = defaultdict(set)
    for i, t, _ in rows:
        w = t.split()
        for k in range(len(w) - 49):
            holders[hash(tuple(w[k : k + 50]))].add(i)
    repeats = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    assert len(repeats) >= pairs
    out = substrings.repeated_passages(frame(spark, rows)).collect()
    direct = {(r.source_id, r.doc_id) for r in out}
    assert np.mean([p in direct for p in repeats]) >= 0.97
    top = groups_of(out)
    assert np.mean([top(a) == top(b) for a, b in repeats]) >= 0.97


def test_edited_passages_of_stock_phrases_are_found(spark):
    """Pairs of five stock phrases, one with two words replaced, among documents that hold the phrases alone."""
    rng = random.Random(2008)
    phrases = [prose(rng, 20, 10**6).split() for _ in range(8)]
    rows = [(10_000 + i, " ".join(f"{prose(rng, 40, 10**6)} {' '.join(rng.choice(phrases))}" for _ in range(3)), "a") for i in range(1000)]
    for n in range(100):
        passage = [w for phrase in rng.sample(phrases, 5) for w in phrase]
        rows.append((2 * n, f"{prose(rng, 80, 10**6)} {' '.join(passage)} {prose(rng, 80, 10**6)}", "a"))
        for at in (rng.randrange(28, 38), rng.randrange(62, 72)):
            passage[at] = f"e{rng.randrange(10**9)}"
        rows.append((2 * n + 1, f"{prose(rng, 80, 10**6)} {' '.join(passage)} {prose(rng, 80, 10**6)}", "a"))
    top = groups_of(substrings.repeated_passages(frame(spark, rows)).collect())
    assert np.mean([top(2 * n) == top(2 * n + 1) for n in range(100)]) >= 0.97


def test_sharing_equals_brute_force():
    """Windows of one cell and unlike labels that share enough values, and no other pairs."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        m = 60
        held = [rng.integers(0, rng.choice([40, 4000]), rng.integers(5, 60)).astype(np.uint32) for _ in range(m)]
        cell, label, least = rng.integers(-2, 1, m), rng.integers(0, 20, m), rng.integers(1, 25, m).astype(np.int32)
        common = [[len(set(x.tolist()) & set(y.tolist())) for y in held] for x in held]
        want = {(i, j) for i, j in combinations(range(m), 2) if cell[i] == cell[j] and label[i] != label[j] and common[i][j] >= max(least[i], least[j])}
        found = [tuple(sorted(p)) for i, j in substrings.sharing(cell, label, least, held) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def test_blocks_of_a_value_are_all_compared(spark):
    """Blocks of few windows give what one block gives, once each."""
    rng = random.Random(17)
    phrase = prose(rng, 30, 10**6)
    rows = [(i, f"{prose(rng, 60, 10**6)} {phrase} {prose(rng, 60, 10**6)}", "a") for i in range(40)]
    texts, want = frame(spark, rows).select("doc_id", "text"), None
    width = 20
    s, ends = text.shingles(*text.word_hashes(*next(iter(text.slices(pa.array([phrase]))))[1:]), 5)
    value = int((text.mix(s[9:10]) >> np.uint64(16))[0]) & (2**48 - 4)
    for parts in (1, 7):
        crowd = spark.createDataFrame([(i, value, i, parts, 69, 40, 100) for i in range(40)], "doc_id long, value long, label long, parts int, c int, b_lo int, b_hi int")
        out = {(r.b, r.a): (r.b_lo, r.b_hi) for r in substrings.compared(texts, crowd, 5, width, 75, 4).collect()}
        assert set(out) == {(b, a) for a, b in combinations(range(40), 2)}
        want = want or out
        assert out == want


def test_blocks_of_a_value_are_connected_by_few_pairs(spark):
    """Common values give fewer pairs than windows in each pair of blocks, and lose no connection."""
    rng = random.Random(18)
    phrases = [prose(rng, 30, 10**6) for _ in range(2)]
    rows = [(i, f"{prose(rng, 60, 10**6)} {phrases[i % 2]} {phrases[0]} {prose(rng, 60, 10**6)}", "a") for i in range(40)]
    s, _ = text.shingles(*text.word_hashes(*next(iter(text.slices(pa.array([phrases[0]]))))[1:]), 5)
    value = int((text.mix(s[9:10]) >> np.uint64(16))[0]) & (2**48 - 4)
    for parts in (1, 3):
        crowd = spark.createDataFrame([(i, value, i, parts, 99, 70, 120) for i in range(40)], "doc_id long, value long, label long, parts int, c int, b_lo int, b_hi int")
        out = substrings.compared(frame(spark, rows).select("doc_id", "text"), crowd, 5, 20, 75, 4, every=False).collect()
        assert len(out) < 40 * parts * (parts + 1) / 2
        up = list(range(40))
        for r in out:
            up = [up[r.a] if x == up[r.b] else x for x in up]
        assert len(set(up)) == 1


def test_connecting_equals_brute_force():
    """The components are those of all pairs with similar passages around both centres, whatever repeats and edits there are."""
    rng = np.random.default_rng(4)
    width, linked = 20, 0
    for turn in range(20):
        base, held, centre = rng.integers(0, [30, 10**6][turn % 2], (3, 60)), [], []
        for _ in range(50):
            own = base[rng.integers(0, 3)].copy()
            own[rng.integers(0, 60, rng.integers(0, 16))] = rng.integers(10**6, 10**9)
            if rng.integers(0, 3) == 0:
                own = np.concatenate([own[30:], own[:30]])
            first = int(rng.integers(0, 20))
            held.append(own[first : 60 - int(rng.integers(0, 15))].astype(np.uint32))
            centre.append(30 - first + int(rng.integers(-1, 2)))
        centre, doc = np.array(centre), rng.integers(0, 40, 50)
        cell, label = rng.integers(0, 2, 50), rng.integers(0, 45, 50)
        least = np.array([substrings.least_shared(x, c, width, 75) for x, c in zip(held, centre, strict=True)], np.int32)

        def components(pairs):
            up = list(range(50))
            for a, b in pairs:
                up = [up[a] if x == up[b] else x for x in up]
            return up

        same = [(a, b) for a, b in combinations(range(50), 2) if cell[a] == cell[b] and label[a] == label[b] and len({doc[k] for k in range(50) if cell[k] == cell[a] and label[k] == label[a]}) > 1]
        around = lambda a, b: any(x[0] <= centre[b] < x[1] and x[2] <= centre[a] < x[3] for x in substrings.aligned_passages(held[b], held[a], width, 75))
        pairs = [(a, b) for a, b in combinations(range(50), 2) if cell[a] == cell[b] and doc[a] != doc[b] and held[a][centre[a]] == held[b][centre[b]] and (around(a, b) if doc[a] < doc[b] else around(b, a))]
        i, j = substrings.connecting(cell, label, doc, np.arange(50), centre, least, held, width, 75)
        found = components([*same, *zip(i.tolist(), j.tolist(), strict=True)])
        assert all(found[a] == found[b] for a, b in pairs)
        assert len(i) < 50 and (cell[i] == cell[j]).all() and (doc[i] != doc[j]).all()
        linked += len(pairs)
    assert linked > 100


def test_least_shared_counts_distinct_values():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s, width = rng.integers(0, rng.choice([3, 20, 10**6]), 50), 12
        c = int(rng.integers(0, 50))
        distinct = min(len(set(s[p : p + width].tolist())) for p in range(max(0, c - width + 1), min(c, 50 - width) + 1))
        assert substrings.least_shared(s, c, width, 75) == -(-75 * distinct // 100)


def test_crowded_values_meet_whatever_task_they_stand_in(spark):
    """A phrase that is crowded in some tasks and not in others; pairs of equal passages stand in different tasks."""
    rng = random.Random(31)
    phrase = prose(rng, 24, 10**6)
    pairs = [f"{prose(rng, 20, 10**6)} {phrase} {prose(rng, 20, 10**6)}" for _ in range(12)]
    text = lambda p: f"{prose(rng, 60, 10**6)} {p} {prose(rng, 60, 10**6)}"
    crowd = [(100 + i, text(phrase), "a") for i in range(60)] + [(i, text(p), "a") for i, p in enumerate(pairs)]
    few = [(1000 + i, text(p), "a") for i, p in enumerate(pairs)]
    split = frame(spark, crowd).coalesce(1).union(frame(spark, few[:6]).coalesce(1)).union(frame(spark, few[6:]).coalesce(1))
    out = {(r.source_id, r.doc_id) for r in substrings.repeated_passages(split).collect()}
    assert out == {(i, 1000 + i) for i in range(12)}


def test_runs_around_hold_every_equal_passage():
    """Two windows with an equal passage of the least length around their centres share a run."""
    rng = np.random.default_rng(5)
    for width in (46, 30, 21):
        step = substrings.step_of(width)
        for before in range(width):
            after = width - 1 - before
            own = rng.integers(0, 16, (2, 16)).astype(np.uint64)
            own[1, :8][: before // step] = own[0, :8][: before // step]
            own[1, 8:][: after // step] = own[0, 8:][: after // step]
            w = gather_of(own, before, after)
            assert any(len(start) < len(at) == 2 for at, start, _ in (substrings.runs_around(w, k, width) for k in range(substrings.STEPS + 1)))


def gather_of(nibbles, before, after):
    around = np.array([sum(int(x) << 60 - 4 * k for k, x in enumerate(row)) for row in nibbles], np.uint64)
    columns = [[4, 4], [1, 2], [100, 100], [before, before], [after, after], [0, 0], around]
    return {k: np.array(x, t) for (k, t), x in zip(substrings.WINDOW, columns, strict=True)}


def test_passages_behind_a_million_words(spark):
    rng = random.Random(21)
    passage = prose(rng, 70, 10**6)
    long_ = " ".join(f"v{i}" for i in range(2**20 + 1000))
    out = substrings.repeated_passages(frame(spark, [(1, f"{prose(rng, 20, 10**6)} {passage}", "a"), (2, f"{long_} {passage} end", "a")])).collect()
    assert {(r.doc_id, r.start, r.source_id, r.source_start) for r in out} == {(2, 2**20 + 1000, 1, 20)} and out[0].end >= 2**20 + 1070


def test_compact_windows_equal_their_definition():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 2**63, 200).astype(np.uint64)
    rows = np.array([0, 50, 53, 120, 200])
    want = set()
    for a, b in zip(rows, rows[1:], strict=False):
        for c in range(a, b):
            lo = max([i + 1 for i in range(a, c) if g[i] < g[c]], default=a)
            hi = min([i - 1 for i in range(c + 1, b) if g[i] < g[c]], default=b - 1)
            if hi - lo + 1 >= 7:
                want.add((c, lo, hi))
    assert set(zip(*(x.tolist() for x in substrings.compact_windows(g, rows, 7)), strict=True)) == want


def test_minima_of_very_long_texts():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 2**63, (1 << 20) + 5000).astype(np.uint64)
    want = np.lib.stride_tricks.sliding_window_view(g >> np.uint64(20), 46)[-6000:].argmin(1) + np.arange(len(g) - 6045, len(g) - 45)
    found = substrings.sliding_minima(g, 46)
    assert len(found) == len(g) - 45 and (found[-6000:] == want).all()


def test_toxicity_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randint(20, 200)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["nastyfool", "vilefool", "meanfool"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad), "x"))
    rows += [(1000, None, None), (1001, "", "a"), (1002, "meanfool " * 5000, "a"), (None, "a b", "a"), (3, rows[3][1], "a")]
    labels += [(None, 1, 1, "x"), (5, 1, None, "x")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")
    out = toxicity.toxicity(frame(spark, rows), marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) >= 0.9
    none = toxicity.toxicity(frame(spark, rows[:3]), marks.limit(0)).collect()
    assert [r.score for r in none] == [0.0] * 3


def test_network_gradients():
    rng = np.random.default_rng(0)
    for _, data, at in text.slices(pa.array(["you are bad people and a x", "hello there my good friend " * 20, "zz"])):
        w = gru.read_words(data, at)
    net = gru.Network.new(rng)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    _, start, size = gru.windows(w.rows)
    y = rng.integers(0, 2, len(start)).astype(float)

    def loss():
        z = net.logits(w, start, size).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    g = net.gradients(w, start, size, y)
    for k in ("hf", "hb", "xf", "xb", "a", "u", "out", "cf", "cb", "bias"):
        i = tuple(rng.integers(0, n) for n in net.params[k].shape)
        v = net.params[k][i]
        net.params[k][i] = v + 1e-2
        up = loss()
        net.params[k][i] = v - 1e-2
        down = loss()
        net.params[k][i] = v
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][i]), abs=3e-4)


def plain_logit(p, xs):
    """One window, word by word: both passes, attention, logit."""
    sig, n = lambda v: 1 / (1 + np.exp(-v)), len(xs)
    states = [np.zeros(0)] * n
    for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        h = np.zeros(gru.HIDDEN)
        for t in order:
            gx, gh = xs[t] @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"h{d}"]
            (zx, rx, nx), (zh, rh, nh) = np.split(gx, 3), np.split(gh, 3)
            z, new = sig(zx + zh), np.tanh(nx + sig(rx + rh) * nh)
            h = (1 - z) * new + z * h
            states[t] = np.concatenate([states[t], h])
    e = np.array([np.tanh(s @ p["a"]) @ p["u"] for s in states])
    weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return sum(w * s for w, s in zip(weight, states, strict=True)) @ p["out"] + p["bias"][0]


def test_scores_equal_a_plain_network(spark):
    """Every window of whole texts by plain loops: the largest logit, calibrated; blank texts the base rate."""
    rng, net = random.Random(17), gru.Network.new(np.random.default_rng(5))
    net.params["cf"] += 0.3
    net.params["bias"][:] = 0.2
    model = toxicity.Model(0.25, net, (0.4, 1.3, -0.2))
    rows = [(i, prose(rng, n), "a") for i, n in enumerate((1, 2, 15, 16, 17, 63, 64, 65, 97, 300))] + [(20, None, "a"), (21, " \n", "b"), (0, "an other text", "a")]
    out = sorted(((r.doc_id, r.windows, r.score) for r in toxicity.score(frame(spark, rows), model).collect()), key=str)
    p, want = {k: v.astype(np.float64) for k, v in net.params.items()}, []
    for i, t, _ in rows:
        words = words_of(t)
        inputs = []
        for x in words:
            for _, data, at in text.slices(pa.array([x])):
                w = gru.read_words(data, at)
            inputs.append(np.concatenate([p["word"][w.word[0]], p["char"][w.grams].mean(axis=0)]))
        starts = sorted({*range(0, max(len(words) - 64, 0), 32), max(len(words) - 64, 0)}) if words else []
        top = max((plain_logit(p, inputs[s : s + 64]) for s in starts), default=None)
        score = 0.25 if top is None else 1 / (1 + np.exp(-(0.4 + 1.3 * top - 0.2 * np.log1p(len(starts)))))
        want.append((i, len(starts), score))
    want.sort(key=str)
    assert [x[:2] for x in out] == [x[:2] for x in want] and np.allclose([x[2] for x in out], [x[2] for x in want], atol=1e-4)
    kept = [(r.doc_id, r.text) for r in toxicity.keep_clean(frame(spark, rows), model).collect()]
    scored = {(i, t): s for (i, t, _), (_, _, s) in zip(rows, sorted(want, key=lambda x: [r[0] for r in rows].index(x[0])), strict=False)}
    assert set(kept) <= set(scored) and all(r in kept for r in ((20, None), (21, " \n")))


def test_windows_overlap_and_reach_the_end():
    _, start, size = gru.windows(np.array([0, 0, 10, 210]))
    assert list(zip(start, size, strict=True)) == [(0, 10), (10, 64), (42, 64), (74, 64), (106, 64), (138, 64), (146, 64)]


def test_toxicity_of_empty_tables(spark):
    docs, labels = frame(spark, [(1, "a b c", "a"), (2, None, "b")]), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    model = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.keep_clean(docs.limit(0), model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == 2 and toxicity.keep_clean(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("run", [minhash.near_duplicates, mixing.mix, mixing.mixed_documents, packing.pack, lines.dedup_lines, substrings.repeated_passages])
def test_empty_documents(spark, run):
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, [(None, None, None)])).count() <= 1
