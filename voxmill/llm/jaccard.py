"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

Equal sets are one class. N-grams are counted over all documents in a table of a
fixed number of counters, whose logarithms, then hashes, order every set from rare
to frequent; any order gives the same links, a good one short lists. Two sets that
link share an n-gram of their prefixes. The lists of those that share one are first
linked in chains, which joins most copies; then the members of different components
meet, each pair is verified once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.minhash import pad, running, verify
from voxmill.llm.text import mix, shingles, slices, word_hashes
from voxmill.operators.graph import connected_components
from voxmill.session import checkpoint

SIZE, PERCENT = 3, 90
COUNTERS, CHUNK = 1 << 24, 1 << 16  # counters of n-grams; those that travel together
PARTS = 32  # of a set, by the last bits of its hashes
ORDERS = 8  # of the chains, one for each remainder of an n-gram
BLOCK = 1024  # members of a list that one task chains, and that each other member meets at a time


def frequencies(texts: DataFrame, size: int, counters: int = COUNTERS) -> np.ndarray:
    """For each counter a byte: eight times the logarithm of how many documents' sets hold an n-gram of it."""
    chunks = counters // CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            for _, data, at in slices(batch.column(0)):
                s, rows = shingles(*word_hashes(data, at), size)
                sets = [np.unique(x) for x in pad(s, rows)]
                if sets:
                    np.add.at(total, (np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), 1)
        for n, part in enumerate(total.reshape(chunks, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(counts, 4 * CHUNK, "zstd", asbytes=True), np.uint32).astype(np.int64)
                sums[n] = sums[n] + part if n in sums else part
        for n, total in sums.items():
            level = np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "levels"])

    counted = texts.select("text").mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, levels binary")
    out = np.zeros((chunks, CHUNK), np.uint8)
    for n, levels in counted.collect():  # a byte for each counter, whatever the input
        out[n] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def ordered_sets(data: np.ndarray, at: np.ndarray, size: int, level: np.ndarray) -> list[np.ndarray]:
    """Each text's set of n-grams as ascending numbers, rare ones first: a byte of frequency and 56 bits of hash."""
    s, rows = shingles(*word_hashes(data, at), size)
    keys = (level[s & np.uint64(len(level) - 1)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    return [np.unique(x) for x in pad(keys, rows)]


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def fingerprints(texts: DataFrame, size: int, percent: int, level: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, parts, d1, d2) of every row; n = 0 where there are no words. k1, k2 tell sets apart; the sizes of a set's parts stand in parts and, coarser, in d1 and d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(batch.column(1)):
                sets = ordered_sets(data, at, size, level)
                n = np.array([len(x) for x in sets])
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                one, two = running(mix(flat)), running(mix(flat ^ np.uint64(0xA5A5A5A5)))
                owner = np.repeat(np.arange(len(sets)), n)
                parts = np.bincount(owner * PARTS + (flat & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS * len(sets))
                coarse = np.minimum(parts.reshape(-1, 2).sum(axis=1), 255).astype(np.uint8).reshape(len(sets), 2, 8)
                coarse = np.ascontiguousarray(coarse).view(np.int64).reshape(len(sets), 2)
                parts = np.minimum(parts, 65535).astype(np.uint16).reshape(len(sets), PARTS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)), pa.array(n, pa.int64()),
                        pa.array((one[ends[1:]] - one[ends[:-1]]).view(np.int64)), pa.array((two[ends[1:]] - two[ends[:-1]]).view(np.int64)),
                        pa.array([x[:p].tobytes() for x, p in zip(sets, prefix_sizes(n, percent), strict=True)], pa.binary()), pa.array([x.tobytes() for x in parts], pa.binary()),
                        pa.array(coarse[:, 0]), pa.array(coarse[:, 1]),
                    ],
                    names=["doc_id", "n", "k1", "k2", "prefix", "parts", "d1", "d2"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix binary, parts binary, d1 long, d2 long")


def postings(classes: DataFrame) -> DataFrame:
    """(gram, rep, n, pos): the n-grams of each class's prefix with their places in its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in grams], np.int64)
            row = pa.array(np.repeat(np.arange(len(grams)), size))
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in size]) if len(size) else np.zeros(0, np.int32)
            flat = np.concatenate(grams) if len(grams) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(row), batch.column(1).take(row), pa.array(pos)], names=["gram", "rep", "n", "pos"])

    return classes.select("rep", "n", "prefix").mapInArrow(run, "gram long, rep long, n long, pos int")


def least_shared(na: Column, nb: Column, percent: int) -> Column:
    """How many n-grams two linked sets share at least."""
    return F.ceil((na + nb) * percent / (100 + percent))


def may_link(a: str, b: str, percent: int, first: bool = False) -> Column:
    """Length filter, and positional filter of one shared n-gram: as many before it as the smaller place, none if it is to be the first, and the rest."""
    na, nb, i, j = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"pos{a}"), F.col(f"pos{b}")
    before = F.lit(0) if first else F.least(i, j)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (before + F.least(na - i, nb - j) >= least_shared(na, nb, percent))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def chains(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): each list's members with the next one, in an order by chance that the n-gram chooses (long lists in parts), and with the one that has the n-gram first."""
    member = F.struct(F.xxhash64("rep", F.pmod("gram", F.lit(ORDERS))).alias("at"), "rep", "n", "pos")
    m = lists.select("gram", "members", member.alias("m"))
    m = m.withColumn("part", F.pmod(F.col("m")["at"], F.ceil(F.col("members") / BLOCK)))
    inner = m.select("m", F.expr("lag(m) over (partition by gram, part order by m)").alias("o"))
    heads = m.where(F.col("members") > BLOCK).groupBy("gram", "part").agg(F.min("m").alias("m"))
    outer = heads.select("m", F.expr("lag(m) over (partition by gram order by part)").alias("o"))
    # a text that others are copies of has what they share at earlier places than they, behind their own new n-grams
    hub = lists.where("members > 2").groupBy("gram").agg(F.min(F.struct("pos", "rep", "n")).alias("o"))
    stars = lists.select("gram", F.struct("rep", "n", "pos").alias("m")).join(hub, "gram").where("m.rep <> o.rep")
    flat = [F.col(s)[c].alias(f"{c}{s}") for s in "mo" for c in ("rep", "n", "pos")]
    both = inner.union(outer).where("o is not null").select(*flat).union(stars.select(*flat))
    return ordered(both.where(may_link("m", "o", percent)).select(F.col("repm").alias("a"), F.col("repo").alias("b"))).distinct()


def parts_apart(x: str, y: str) -> Column:
    """By how much the sizes of 16 parts differ, a byte each in two longs; two sets differ by no less."""
    byte = lambda c, n: F.shiftright(F.col(c), 8 * n).bitwiseAND(F.lit(255))
    return sum((F.abs(byte(f"{d}{x}", n) - byte(f"{d}{y}", n)) for d in ("d1", "d2") for n in range(8)), F.lit(0).cast("long"))


def across_components(lists: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share n-grams of their prefixes and pass the filters.

    In a list that holds several components, those outside its largest one meet all
    members of other components, a block of the list at a time. A pair comes of lists
    of n-grams that can be the first that it shares, and only if the parts of both sets
    are of like sizes.
    """
    known = classes.select("rep", "d1", "d2").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    m = lists.join(known, "rep")
    sizes = m.groupBy("gram", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("gram").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    m = checkpoint(m.join(mixed, "gram").withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("other", F.col("label") != F.col("main")))
    one = m.where("other").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = one.select("gram", "block", *(F.col(c).alias(f"{c}x") for c in ("rep", "n", "pos", "label", "d1", "d2")))
    two = m.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).select("gram", "block", "other", *(F.col(c).alias(f"{c}y") for c in ("rep", "n", "pos", "label", "d1", "d2")))
    apart = (F.col("labelx") != F.col("labely")) & (~F.col("other") | (F.col("repx") < F.col("repy")))
    alike = parts_apart("x", "y") <= F.col("nx") + F.col("ny") - 2 * least_shared(F.col("nx"), F.col("ny"), percent)
    met = one.join(two, ["gram", "block"]).where(apart & may_link("x", "y", percent, first=True) & alike)
    first = F.col("repx") < F.col("repy")
    sides = [F.when(first, F.col(f"{c}{s}")).otherwise(F.col(f"{c}{t}")).alias(f"{c}{end}") for end, s, t in (("a", "x", "y"), ("b", "y", "x")) for c in ("n", "pos")]
    met = met.select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b"), *sides)
    # of the shared n-grams those up to some place are known: what follows the last of them bounds the rest
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("posa").alias("i"), F.max("posb").alias("j"))
    rest = F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)
    return counted.where(F.col("c") + rest >= least_shared(F.col("na"), F.col("nb"), percent)).select("a", "b")


def suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose sets' parts differ in size by no more than linked sets may differ in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64) for c in (2, 3))
                n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
                apart = np.abs(x - y).sum(axis=1)
                yield batch.select([0, 1]).filter(pa.array(apart <= n - 2 * -(-n * percent // (100 + percent))))

    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(end), F.col("parts").alias(f"p{end}"), F.col("n").alias(f"n{end}")), end)
    return pairs.select("a", "b", "pa", "pb", "na", "nb").mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, wanted: DataFrame, size: int, level: np.ndarray) -> DataFrame:
    """(rep, items): the whole ordered sets of the wanted (rep, holder, n, k1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for first, data, at in slices(batch.column(1)):
                sets = ordered_sets(data, at, size, level)
                own = [i for i, x in enumerate(sets) if len(x) == n[first + i] and mix(x).sum(dtype=np.uint64).view(np.int64) == k1[first + i]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)).take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["rep", "items"])

    w = wanted.select(F.col("holder").alias("doc_id"), "rep", "n", "k1")
    return texts.join(w, "doc_id").select("rep", "text", "n", "k1").mapInArrow(run, "rep long, items binary").dropDuplicates(["rep"])


def joined_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Reads doc_id and text; other columns are ignored. Texts with 100 * intersection
    >= percent * union of their sets of n-grams are linked, none is lost; the component is
    the smallest doc_id that can be reached. Fewer words than an n-gram make one n-gram;
    texts without words, null ones too, are linked with nothing. Rows that repeat a
    doc_id are one document: each keeps its own n_shingles, all links count. Rows
    without a doc_id are linked with nothing. An empty table gives no rows. ``counters``, a
    power of two of 2^16 at least, is the size of the table of frequencies, which every task holds.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    level = frequencies(texts, size, counters)
    prints = checkpoint(fingerprints(texts, size, percent, level).withColumn("rep", F.xxhash64("n", "k1", "k2")))
    known = prints.where("n > 0 and doc_id is not null").select("doc_id", "rep").distinct()
    holders = known.groupBy("rep").agg(F.min("doc_id").alias("doc_id"))
    classes = checkpoint(prints.join(holders, ["rep", "doc_id"]).dropDuplicates(["rep"]).withColumnRenamed("doc_id", "holder"))

    rows = postings(classes)
    shared = rows.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    lists = checkpoint(rows.join(shared, "gram"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(suffix_filter(pairs, classes, percent))
        wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        sets = checkpoint(full_sets(texts, classes.join(wanted, "rep", "left_semi"), size, level))
        return checkpoint(verify(pairs, sets, percent))

    tested = verified(chains(lists, percent))
    labels = checkpoint(connected_components(tested.where("linked"), "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label")))
    new = across_components(lists, labels, classes, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(new).where("linked")
    label = F.coalesce("label", "rep")
    for end in ("a", "b"):
        more = more.join(labels.select(F.col("rep").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    placed = checkpoint(known.join(labels, "rep", "left").select("doc_id", label.alias("label")).distinct())
    several = placed.groupBy("doc_id").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    own = placed.join(several, "doc_id").select(F.col("label").alias("la"), F.col("least").alias("lb"))
    joined = connected_components(more.select("la", "lb").union(own), "la", "lb").select(F.col("node").alias("label"), "component")
    placed = placed.join(joined, "label", "left").select("doc_id", F.coalesce("component", "label").alias("label")).distinct()
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = placed.join(smallest, "label").select("doc_id", "component_id")
    return prints.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT row, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w
), e AS (SELECT row, doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL
), f AS (SELECT * FROM e WHERE x IN (SELECT x FROM e GROUP BY x HAVING count(*) > 1)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.row, b.row, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (SELECT DISTINCT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.id = s.doc_id
"""
