"""Preference formatting and URL filter against plain versions; the pipeline stage by stage; the registered SQL."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxmill.llm import chat, lines, mixing, registry, toxicity, urls

SF = Path("/root/testdata/sf0.001")


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(x) for x in r) for r in df.itertuples(index=False))


TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye"), (0, 3, "assistant", "ciao"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "what"), (1, 3, "assistant", "é"),
    (2, 0, "user", "alone"), (4, 0, None, None), (4, None, "user", "first"), (5, 0, "user", ""), (5, 0, "user", ""),
    *((i, 0, "user", f"far {i // 2}") for i in (*range(2**60, 2**60 + 8), 2**53 + 1, -1, -2, -3, -(2**53) - 1, 2**63 - 1, -(2**63))),
    (6, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "lost"), (9, 0, "assistant", "x" * 50_000),
]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, head string")


def test_preferences(spark):
    rows = chat.format_preferences(turns_of(spark, TURNS)).collect()
    out = {r.pair_id: r for r in rows}
    assert len(out) == len(rows) and set(out) == {r[0] // 2 for r in TURNS if r[0] is not None}
    assert all(out[2**59 + k].prompt_turns == 1 and out[2**59 + k].prompt == f"<|user|>\nfar {2**59 + k}<|end|>\n" for k in range(4))
    a = out[0]
    assert a.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n" and a.prompt_turns == 2
    assert a.chosen_text == "<|user|>\nbye<|end|>\n<|assistant|>\nciao<|end|>\n"
    assert [a.chosen_text[s.start : s.end] for s in a.chosen_spans] == ["ciao<|end|>"]
    assert [a.rejected_text[s.start : s.end] for s in a.rejected_spans] == ["é<|end|>"]
    assert out[1].rejected_text == "" and out[1].prompt_turns == 0 and out[1].chosen_spans == []
    assert out[2].chosen_text.startswith("<|user|>\nfirst") and out[2].rejected_text.count("<|user|>") == 2
    assert out[3].prompt_turns == 1 and out[3].chosen_text == out[3].rejected_text == ""
    assert out[4].chosen_text == "" and out[4].rejected_spans[0].end == 50_000 + 14 + 7
    assert chat.format_preferences(turns_of(spark, [])).count() == 0


def test_preferences_equal_sql_on_hard_rows(spark):
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
    assert plain(chat.preference_query(turns_of(spark, TURNS)).toPandas()) == plain(db.sql(chat.ORACLE).df())


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, host string, k int")


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net/EN/"), (3, "x://example.com/de/1"), (4, "ftp://badexample.com/de/"),
        (5, "http://b.org/fr/"), (6, None), (7, "no scheme"), (8, "http://net"), (9, "a://b://c/d"), (10, "http://x.net?/en/"), (11, ""), (11, ""), (None, "http://q.net/"),
    ]
    out = [(r.page_id, r.host, r.path, r.rule) for r in urls.judge(pages_of(spark, rows)).collect()]
    want = [
        (1, "a.example.net", "/en/x", "example.net/en/"), (2, "example.net", "/EN/", "net/"), (3, "example.com", "/de/1", "example.com/de/"), (4, "badexample.com", "/de/", None),
        (5, "b.org", "/fr/", "org/fr/"), (6, "", "", None), (7, "", "", None), (8, "net", "", None), (9, "b:", "//c/d", None), (10, "x.net", "", None), (11, "", "", None), (11, "", "", None), (None, "q.net", "/", "net/"),
    ]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(out, key=key) == sorted(want, key=key)
    assert {r.verdict for r in urls.judge(pages_of(spark, [(1, "http://u.io/"), (2, None)])).collect()} == {"allow"}
    assert urls.judge(pages_of(spark, [])).count() == 0


def test_url_scores_equal_plain_models(spark):
    rng = random.Random(0)
    rows = [(i, f"http://{rng.choice(['aa', 'bab', 'zq'])}.{rng.choice(['org/fr', 'net/x', 'example.net/en', 'com/q', 'io/a'])}/{rng.randrange(99)}") for i in range(120)]
    out = urls.judge(pages_of(spark, rows)).collect()
    text = {r.page_id: re.sub("[0-9]", "0", r.host + r.path) for r in out}
    fold = {r.s: r.f for r in spark.createDataFrame([(s,) for s in set(text.values())], "s string").selectExpr("s", "pmod(xxhash64(s), 5) f").collect()}
    said = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    counts = {c: [Counter() for _ in range(5)] for c in ("allow", "block")}
    for r in out:
        s = text[r.page_id]
        if r.rule and fold[s]:
            padded = "\x02" * 4 + s + "\x03"
            for i in range(4, len(padded)):
                for k in range(5):
                    counts[said[r.rule]][k][padded[i - k : i + 1]] += 1

    def logp(gram, c):
        p = 1 / 257
        for k in range(5):
            g = gram[4 - k :]
            own = {x: n for x, n in counts[c][k].items() if x[:-1] == g[:-1]}
            n, kinds = sum(own.values()), len(own)
            if n:
                p = (own.get(g, 0) + kinds * p) / (n + kinds)
        return math.log(p)

    cache = {}
    for r in out:
        padded = "\x02" * 4 + text[r.page_id] + "\x03"
        gs = [padded[i - 4 : i + 1] for i in range(4, len(padded))]
        for g in gs:
            if g not in cache:
                cache[g] = logp(g, "allow") - logp(g, "block")
        assert r.score == pytest.approx(sum(cache[g] for g in gs) / len(gs), abs=1e-5)
        assert r.verdict == said[r.rule] if r.rule else r.verdict in ("allow", "block")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in SF.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert plain(registry.QUERIES[name](spark, str(SF)).toPandas()) == plain(db.sql(registry.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic, repeated and mixed documents, with labels for half of them."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels, kind = [], [], {}
    for i in range(240):
        text = "\n".join(prose(rng.randint(12, 40)) for _ in range(rng.randint(2, 5)))
        kind[i] = "toxic" if i % 3 == 0 else "clean"
        if kind[i] == "toxic":
            w = text.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zzvile", "zznasty", "zzmean"]))
            text = " ".join(w)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, 1, int(kind[i] == "toxic")))
    clean = [i for i in kind if kind[i] == "clean"]
    for n, i in enumerate(clean[:10]):
        rows.append((300 + n, rows[i][1], "en", "s1", rows[i][4]))
        kind[300 + n] = "copy"
    for n, i in enumerate(clean[10:20]):
        near = rows[i][1].replace("\n", " ") + " tail"
        rows.append((400 + n, near, "en", "s2", len(near)))
        kind[400 + n] = "near"
    rows += [(500, None, "en", None, None), (501, "", None, "s0", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), kind


def test_pipeline_stages(spark, corpus):
    folder, kind = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns, names = {r.doc_id: r.text for r in docs.collect()}, docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if n < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["toxicity"]}
    clean = {i for i, k in kind.items() if k != "toxic"}
    assert len(kept & clean) >= 0.95 * len(clean) and len(kept - clean - {500, 501}) <= 4 and {500, 501} <= kept
    deduped = {r.doc_id: r for r in seen["line dedup"]}
    assert all(kind.get(i) != "copy" or before[i] != r.text for i, r in deduped.items())
    assert all(r.text == before[i] and r.n_chars == len(r.text) for i, r in deduped.items() if kind.get(i) == "clean")
    near = {r.doc_id for r in seen["minhash near-dedup"]}
    assert near <= set(deduped) and not any(kind.get(i) == "near" and (i in near) for i in range(400, 410) if [x for x in kind if kind[x] == "clean"][i - 390] in near)
    assert {i for i in deduped if kind.get(i) == "clean"} <= near
    taken = Counter(r.doc_id for r in seen["mixing sources"])
    assert set(taken) <= near and max(taken.values()) <= 3
    words = defaultdict(int)
    for r in seen["best-fit packing"]:
        words[r.bin] += r.words
    assert max(words.values()) <= 2048
    assert sum(words.values()) == sum(len((r.text or "").split()) for r in seen["mixing sources"])


def test_pipeline_on_repeated_rows(spark, corpus, tmp_path):
    """Rows that repeat a document with its text stay once; texts that share a doc_id are one document."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("doc_id in (1, 2, 4, 5, 7, 300)")
    other = docs.where("doc_id = 7").selectExpr("2L as doc_id", "concat(text, ' and a bit more') as text", "lang", "source", "n_chars")
    docs = docs.union(docs.where("doc_id < 5")).union(other).withColumns({"_mark": F.lit(1), "rows": F.lit(2), "kept": F.lit(3)})
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect())
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert got == sorted(x for x in texts if x[0] not in (300, 7))


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_equals_its_stages_by_plain_rules(spark, corpus):
    """What the stages decide is held against plain rules: toxic ones by the model's own scores, lines, groups, copies and bins by brute force."""
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if not scores[r.doc_id]}
    kept = corpus_pipeline.clean_of_toxicity(spark, docs, folder)
    assert {r.doc_id: r.text for r in kept.collect()} == texts
    left = {}
    for i in sorted(texts):
        own, gone = (texts[i] or "").split("\n"), set()
        for e in sorted(texts):
            if e < i and texts[e]:
                gone.update(lines.common_blocks([hash(x.strip(" ")) for x in texts[e].split("\n")], [hash(x.strip(" ")) for x in own], [len(x.strip(" ")) for x in own], 40))
        stay = "\n".join(x for k, x in enumerate(own) if k not in gone)
        if not gone or stay.strip(" "):
            left[i] = stay if gone else texts[i]
    kept = corpus_pipeline.without_repeated_lines(spark, kept, folder)
    assert {r.doc_id: r.text for r in kept.collect()} == left
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for i, t in left.items()}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                new, old = sorted((group[i], group[j]))
                group = {x: new if g == old else g for x, g in group.items()}
    kept = corpus_pipeline.one_of_each_group(spark, kept, folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in group.items() if i == g)
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    mixed = corpus_pipeline.mixed(spark, kept, folder)
    assert Counter(r.doc_id for r in mixed.collect()) == {i: n for i, n in copies.items() if n}
    bins = corpus_pipeline.packed(spark, mixed, folder).collect()
    taken = Counter()
    for r in bins:
        taken[r.doc_id] += r.words
    assert all(taken[i] == n * len((left[i] or "").split()) for i, n in copies.items())


def test_pipeline_runs_in_one_go(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
