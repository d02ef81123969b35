"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of word shingles; equal sets are one class. Bands of
signatures name candidates. A candidate pair's signatures are compared batch by
batch and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold is under the chosen miss probability. Survivors
are verified on their full sets. A bucket first links its members in a chain;
then only members of different components are compared, so a large group of
copies costs a link each and no link between different texts is lost. A large
bucket is compared block by block, where its tasks return links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.text import mix, shingles, slices, word_hashes
from voxmill.operators.graph import connected_components
from voxmill.session import checkpoint

BANDS, ROWS, BATCH = 24, 4, 16
SALTS = 64
MISS = 1e-5
SMALL, BLOCK, COLUMNS = 8, 1024, 2048


def pad(values: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def sorted_sets(s: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each row, ascending."""
    return [np.unique(x) for x in pad(s, rows)]


def signatures(s: np.ndarray, rows: np.ndarray, hashes: int) -> np.ndarray:
    """One row of ``hashes`` 32-bit minima for each non-empty row of shingles."""
    full = np.flatnonzero(np.diff(rows) > 0)
    out = np.zeros((len(rows) - 1, hashes), np.uint32)
    if not len(full):
        return out
    starts = rows[:-1][full]
    rng = np.random.default_rng(20240)
    odd = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    buffer = np.empty(len(s), np.uint64)
    for i in range(hashes):
        np.multiply(s, odd[i], out=buffer)
        buffer += add[i]
        buffer >>= np.uint64(32)
        out[full, i] = np.minimum.reduceat(buffer, starts)
    return out


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, matches needed) after each batch, with a uniform prior on similarity.

    With m of n minima equal, similarity is Beta(m + 1, n - m + 1); a pair goes on
    only if it reaches the threshold with at least the miss probability.
    """

    def tail(m: int, n: int) -> float:
        # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    out = []
    for n in range(batch, hashes + 1, batch):
        out.append((n, next(m for m in range(n + 1) if tail(m, n) >= miss)))
    return out


def fingerprints(docs: DataFrame, hashes: int, size: int) -> DataFrame:
    """(doc_id, n, k1, k2, sig) of every row; n = 0 where there are no words. k1, k2 tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(batch.column(1)):
                s, rows = shingles(*word_hashes(data, at), size)
                sets = sorted_sets(s, rows)
                flat = np.concatenate(sets) if sets else s[:0]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
                sig = signatures(flat, ends, hashes)
                total = running(mix(flat))
                other = running(mix(flat ^ np.uint64(0xA5A5A5A5)))
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.diff(ends)),
                        pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)),
                        pa.array((other[ends[1:]] - other[ends[:-1]]).view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * hashes), n, [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())]).cast(pa.binary()),
                    ],
                    names=["doc_id", "n", "k1", "k2", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, items): the sorted distinct shingle hashes of the wanted (rep, holder, n, k1)'s texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for first, data, at in slices(batch.column(1)):
                sets = sorted_sets(*shingles(*word_hashes(data, at), size))
                own = [i for i, x in enumerate(sets) if len(x) == n[first + i] and set_key(x) == k1[first + i]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)).take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["rep", "items"])

    w = wanted.select(F.col("holder").alias("doc_id"), "rep", "n", "k1")
    return docs.join(w, "doc_id").select("rep", "text", "n", "k1").mapInArrow(run, "rep long, items binary")


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values, modulo 2^64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def set_key(x: np.ndarray) -> np.int64:
    return mix(x).sum(dtype=np.uint64).view(np.int64)


def prune(pairs: DataFrame, sigs: DataFrame, rule: list[tuple[int, int]], percent: int) -> DataFrame:
    """Of (a, b), the pairs that set sizes and the posterior don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.stack([np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()]) if batch.num_rows else np.zeros((0, 0), np.uint32) for c in (2, 3))
            left = np.arange(batch.num_rows)
            done, matches = 0, np.zeros(len(left), int)
            for n, need in rule:
                matches = matches + (a[left, done:n] == b[left, done:n]).sum(axis=1) if len(left) else matches
                keep = matches >= need
                left, matches, done = left[keep], matches[keep], n
            yield batch.select([0, 1]).take(pa.array(left))

    one, two = (sigs.select(F.col("rep").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): 100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one, two = (sets.select(F.col("rep").alias(c), F.col("items").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean")


def chains(members: DataFrame) -> DataFrame:
    """(a, b): each bucket's members linked to the next by id, through salted parts and their heads."""
    part = F.pmod(F.xxhash64("rep"), F.lit(SALTS))
    m = members.withColumn("part", part)
    inner = m.select("rep", F.expr("lag(rep) over (partition by band, key, part order by rep)").alias("other"))
    heads = m.groupBy("band", "key", "part").agg(F.min("rep").alias("rep"))
    outer = heads.select("rep", F.expr("lag(rep) over (partition by band, key order by rep)").alias("other"))
    return inner.union(outer).where("other is not null").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def within_small(members: DataFrame) -> DataFrame:
    """(a, b): members of different components in buckets of SMALL members at most."""
    m = members.select("band", "key", "rep", "label")
    other = m.select("band", "key", F.col("rep").alias("b"), F.col("label").alias("other"))
    return m.withColumnRenamed("rep", "a").join(other, ["band", "key"]).where("a < b and label <> other").select("a", "b").distinct()


def likely_in_large(members: DataFrame, rule: list[tuple[int, int]], percent: int) -> DataFrame:
    """(band, key, lo, hi, part, rep, label): the members of large buckets that have a likely partner in another component.

    ``members`` has band, key, rep, label, n, sig and blocks, the number of blocks
    that its bucket is cut into; a task gets two blocks at most.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    m = members.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack([np.frombuffer(x, np.uint32) for x in pdf["sig"]])
        label, n, block = (pdf[c].to_numpy() for c in ("label", "n", "block"))
        lo, hi, likely = pdf["lo"].iat[0], pdf["hi"].iat[0], np.zeros(len(pdf), bool)
        for i in np.flatnonzero(block == lo):
            j = np.flatnonzero((label != label[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent) & (block == hi))
            done, matches = 0, np.zeros(len(j), int)
            for stop, need in rule:
                matches = matches + (sig[j, done:stop] == sig[i, done:stop]).sum(axis=1)
                j, matches, done = j[matches >= need], matches[matches >= need], stop
            likely[j] = True
            likely[i] |= len(j) > 0
        return pdf.loc[likely, ["band", "key", "lo", "hi", "block", "rep", "label"]]

    return m.groupBy("band", "key", "lo", "hi").applyInPandas(run, "band int, key long, lo long, hi long, block long, rep long, label long")


def links_in_large(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): a verified link for each pair of components that have one between two blocks of a bucket.

    Intersections of all sets of both blocks come from products of incidence
    matrices, a bounded number of shingles at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        rep, label, block = (pdf[c].to_numpy() for c in ("rep", "label", "block"))
        one, two = np.flatnonzero(block == pdf["lo"].iat[0]), np.flatnonzero(block == pdf["hi"].iat[0])
        n = np.array([len(x) for x in sets])
        _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[item] > 1
        owner, item = np.repeat(np.arange(len(sets)), n)[shared], np.unique(item[shared], return_inverse=True)[1]
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        both = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
            at = slice(*np.searchsorted(item, [lo, lo + COLUMNS]))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[at], item[at] - lo] = 1
            both += m[one] @ m[two].T
        every = n[one][:, None] + n[two][None, :] - both
        i, j = np.nonzero((100 * both >= percent * every) & (label[one][:, None] != label[two][None, :]))
        i, j = one[i], two[j]
        pairs = np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])])
        first = np.unique(pairs, axis=1, return_index=True)[1]
        i, j = i[first], j[first]
        return pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])}).astype("int64").assign(linked=True)

    return likely.join(sets, "rep").groupBy("band", "key", "lo", "hi").applyInPandas(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Reads doc_id and text; other columns are ignored. Texts with 100 * intersection
    >= percent * union of their shingle sets are linked; the component is the
    smallest doc_id that can be reached. Texts without words, null ones too, are
    linked with nothing. Rows that repeat a doc_id are one document: each keeps its
    own n_shingles, the links of all its texts count, and all share its component.
    Rows with a null doc_id are linked with nothing and kept. An empty table gives
    no rows. A pair right at the threshold misses all bands with a
    chance of (1 - s**rows)**bands, and is pruned with a chance of about ``miss``.
    """
    hashes = bands * rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = checkpoint(fingerprints(texts, hashes, size))
    # a class are the rows of one set; a document whose rows have several sets is in several classes, which it links
    known = prints.where("n > 0 and doc_id is not null").select("doc_id", "n", "k1", "k2").distinct()
    most = known.groupBy("doc_id").agg(F.max(F.struct("n", "k1", "k2")).alias("s"), F.count("*").alias("sets"))
    known = checkpoint(known.join(most, "doc_id").withColumn("main", F.col("s") == F.struct("n", "k1", "k2")).select("doc_id", "n", "k1", "k2", "main", "sets"))
    # its name is the smallest doc_id that has no larger set, else a hash: no two classes have the same
    named = F.coalesce(F.min(F.when(F.col("main"), F.col("doc_id"))), F.xxhash64("n", "k1", "k2")).alias("rep")
    classes = known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("holder"), named)
    reps = known.join(classes, ["n", "k1", "k2"]).select("doc_id", "rep", "sets")
    chosen = classes.withColumnRenamed("holder", "doc_id")
    sigs = prints.join(chosen, ["doc_id", "n", "k1", "k2"]).dropDuplicates(["rep"]).select("rep", F.col("doc_id").alias("holder"), "n", "k1", "sig")
    sigs = checkpoint(sigs)

    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    key = F.xxhash64(F.substring("sig", F.col("band") * 4 * rows + 1, F.lit(4 * rows)))
    banded = sigs.select("rep", "sig", band).select("rep", "band", key.alias("key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    members = checkpoint(banded.join(shared, ["band", "key"]))

    wanted = sigs.join(members.select("rep").distinct(), "rep", "left_semi")
    sets = checkpoint(full_sets(texts, wanted, size))
    rule = least_matches(hashes, BATCH, percent / 100, miss)
    tested = checkpoint(verify(prune(chains(members), sigs, rule, percent), sets, percent))

    labels = checkpoint(connected_components(tested.where("linked"), "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label")))
    labelled = members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # the members of buckets that hold several components
    several = labelled.groupBy("band", "key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    left = checkpoint(labelled.join(several.select("band", "key"), ["band", "key"]).select("band", "key", "rep", "label", "members"))

    small, large = left.where(F.col("members") <= SMALL), left.where(F.col("members") > SMALL)
    new = within_small(small).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = verify(prune(new, sigs, rule, percent), sets, percent)
    large = large.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).join(sigs, "rep").select("band", "key", "rep", "label", "n", "sig", "blocks")
    likely = checkpoint(likely_in_large(large, rule, percent))
    found = found.union(links_in_large(likely, sets, percent))
    more = checkpoint(found.where("linked"))
    # what was found last joins components
    for end in ("a", "b"):
        more = more.join(labels.select(F.col("rep").alias(end), F.col("label").alias(f"label_{end}")), end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    # so do the sets of one document
    label = F.coalesce("label", "rep").alias("label")
    several = reps.where("sets > 1").join(labels, "rep", "left").select("doc_id", label)
    own = several.join(several.groupBy("doc_id").agg(F.min("label").alias("least")), "doc_id").select(F.col("label").alias("label_a"), F.col("least").alias("label_b"))
    joined = connected_components(more.select("label_a", "label_b").union(own), "label_a", "label_b").select(F.col("node").alias("label"), "component")
    placed = reps.join(labels, "rep", "left").select("doc_id", label).join(joined, "label", "left").select("doc_id", F.coalesce("component", "label").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(smallest, "label").select("doc_id", "component_id").distinct()
    out = prints.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT row, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w
), e AS (SELECT row, doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL
), f AS (SELECT * FROM e WHERE x IN (SELECT x FROM e GROUP BY x HAVING count(*) > 1)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.row, b.row, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (SELECT DISTINCT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c = s.doc_id, true) AS kept
FROM s LEFT JOIN c ON c.id = s.doc_id
"""
