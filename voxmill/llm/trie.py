"""The trie of conversations' prefixes, with subtree totals by time-forward processing.

A node is named by its least conversation and its depth, so the nodes of one name's
conversation are a stretch of a path. Shards hold the nodes of 256 neighbouring
conversation ids and 256 levels. A shard is sorted by reverse level order; each node
takes what its children have sent to it out of a priority queue and sends its own
total on to its parent. What leaves a shard goes from shard root to shard root the
same way, and then down into the shards.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.text import n_words
from voxmill.operators.search import ranked
from voxmill.session import checkpoint

SEGMENT = 1024  # turns whose running hash one task makes
SHARD_BITS = 8
HELD = 1 << 18  # messages that a queue holds before it spills
IDS = 4096  # neighbouring conversation ids that are joined to a text at a time


class SpillingQueue:
    """A priority queue of (key, values). Beyond ``held`` entries all go, sorted, to a nameless file.

    The file is scratch of one task, like a sort's spill: nobody else reads it, a task that runs again makes its own.
    """

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spills, self.seen = held, [], [], 0, 0

    def push(self, key: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (key, values))
        if len(self.heap) > self.held:
            file = tempfile.TemporaryFile()
            entries = sorted(self.heap)
            for lo in range(0, len(entries), 4096):
                pickle.dump(entries[lo : lo + 4096], file)
            file.seek(0)
            self.heap, self.spills = [], self.spills + 1
            self._next(self._read(file))

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple]) -> None:
        entry = next(run, None)
        if entry is not None:
            self.seen += 1
            heapq.heappush(self.runs, (entry, self.seen, run))

    def take(self, key: tuple) -> tuple[int, int]:
        """The sums of the values sent to ``key``, which no entry is before."""
        a = b = 0
        while self.heap and self.heap[0][0] == key:
            x, y = heapq.heappop(self.heap)[1]
            a, b = a + x, b + y
        while self.runs and self.runs[0][0][0] == key:
            (_, (x, y)), _, run = heapq.heappop(self.runs)
            a, b = a + x, b + y
            self._next(run)
        return a, b


def totals(rows: Iterator[tuple], held: int = HELD) -> Iterator[tuple]:
    """(conv, depth, n_leaves, saved, is_root) of nodes in reverse level order.

    Rows are (conv, depth, parent_conv, parent_depth, n_leaves, saved), sorted by
    depth and conv, both descending; parent_depth is None where the parent is no row.
    """
    queue = SpillingQueue(held)
    for conv, depth, up, level, leaves, saved in rows:
        a, b = queue.take((-depth, -conv))
        leaves, saved = leaves + a, saved + b
        if level is not None:
            queue.push((-level, -up), (leaves, saved))
        yield conv, depth, leaves, saved, level is None


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list | None = None) -> Iterator[pa.RecordBatch]:
    kinds, held = kinds or [pa.int64()] * len(names), []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def within_shards(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved, top_conv, top_depth): totals of what lies in a node's own shard, and the shard root above it."""
    shard = [F.shiftright("conv_id", SHARD_BITS).alias("s"), F.shiftright("depth", SHARD_BITS).alias("t")]
    inside = (F.shiftright("parent_conv_id", SHARD_BITS) == F.col("s")) & (F.shiftright(F.col("depth") - 1, SHARD_BITS) == F.col("t"))
    n = nodes.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved", *shard).withColumn("level", F.when(inside, F.col("depth") - 1))
    n = n.repartition("s", "t").sortWithinPartitions("s", "t", F.desc("depth"), F.desc("conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            rows = _rows(batches, ["s", "t", "conv_id", "depth", "parent_conv_id", "level", "n_leaves", "saved"])
            for _, own in groupby(rows, key=lambda r: r[:2]):
                own = [r[2:] for r in own]  # 2^16 nodes at most
                top: dict[tuple, tuple] = {}
                for conv, depth, up, level, *_ in reversed(own):
                    top[conv, depth] = (conv, depth) if level is None else top[up, level]
                for conv, depth, leaves, saved, _ in totals(own):
                    yield conv, depth, leaves, saved, *top[conv, depth]

        yield from _batches(out(), ["conv_id", "depth", "n_leaves", "saved", "top_conv", "top_depth"])

    return n.mapInArrow(run, "conv_id long, depth long, n_leaves long, saved long, top_conv long, top_depth long")


def across_shards(roots: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved): whole totals of shard roots.

    ``roots`` has conv_id, depth, up_conv, up_depth (the shard root above; null at
    the top) and the totals of their own shards. Roots with none below them are
    summed first; only the others go through one sorted stream with a queue that spills.
    """
    parents = roots.where("up_depth is not null").select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).distinct().withColumn("inner", F.lit(True))
    marked = checkpoint(roots.join(parents, ["conv_id", "depth"], "left"))
    outer, inner = marked.where("inner is null"), marked.where("inner")
    raked = outer.where("up_depth is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("most"))
    own = inner.join(raked, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("most", F.lit(0))})
    line = own.select("conv_id", "depth", "up_conv", "up_depth", "n_leaves", "saved").repartition(1).sortWithinPartitions(F.desc("depth"), F.desc("conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches, ["conv_id", "depth", "up_conv", "up_depth", "n_leaves", "saved"])
        yield from _batches((r[:4] for r in totals(rows)), ["conv_id", "depth", "n_leaves", "saved"])

    whole = line.mapInArrow(run, "conv_id long, depth long, n_leaves long, saved long")
    return outer.select("conv_id", "depth", "n_leaves", "saved").union(whole)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved) summed over each node's subtree.

    ``nodes`` has conv_id, depth, parent_conv_id (null at the root) and both values of each node by itself.
    """
    nodes = checkpoint(nodes)
    local = checkpoint(within_shards(nodes))
    at = nodes.select("conv_id", "depth", "parent_conv_id")
    roots = local.where("conv_id = top_conv and depth = top_depth").drop("top_conv", "top_depth").join(at, ["conv_id", "depth"])
    roots = roots.withColumn("level", F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1))
    # the hot node is the parent: one row of the other side, and many of this one, which a skew join splits
    above = local.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("level"), F.col("top_conv").alias("up_conv"), F.col("top_depth").alias("up_depth"))
    roots = checkpoint(roots.join(above, ["parent_conv_id", "level"], "left"))
    whole = across_shards(roots.select("conv_id", "depth", "up_conv", "up_depth", "n_leaves", "saved"))
    sent = whole.join(roots.where("level is not null").select("conv_id", "depth", "parent_conv_id", "level"), ["conv_id", "depth"])
    sent = sent.groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("level").alias("depth")).agg(F.sum("n_leaves").alias("more"), F.sum("saved").alias("most"))
    fed = nodes.join(sent, ["conv_id", "depth"], "left")
    fed = fed.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("most", F.lit(0))})
    return within_shards(fed).select("conv_id", "depth", "n_leaves", "saved")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): SHA-256 of each node's members, ascending, with commas.

    Members of neighbouring ids are joined to texts first; a node's texts then stream through one digest.
    """
    part = F.shiftright("member", IDS.bit_length() - 1)
    texts = ends.groupBy("conv_id", "depth", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("ids"))
    texts = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (conv, depth), own in groupby(_rows(batches, ["conv_id", "depth", "ids"]), key=lambda r: r[:2]):
                digest, comma = hashlib.sha256(), b""
                for *_, ids in own:
                    digest.update(comma + ids.encode())
                    comma = b","
                yield conv, depth, digest.hexdigest()

        yield from _batches(out(), ["conv_id", "depth", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()])

    return texts.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): turns from 1 on, by turn (nulls first), role and text; nulls become empty texts.

    Places come from ranges of the whole order, so no conversation is too long for a task. Rows without a conv_id are left out.
    """
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    placed = ranked(t, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).alias("n"), "role", "text")


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, n, role, text), n from 1 on without gaps, of all ``members`` (conv_id).

    Gives conv_id (the least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. Members without turns end at the root. Members
    and turns with a null conv_id have to be left out before; no members, no rows.
    A prefix is named by two 64-bit hashes, each the running XOR of hashes of places and turns.
    """
    x = [F.xxhash64(F.lit(seed), "n", "role", "text").alias(f"x{seed}") for seed in (1, 2)]
    r = checkpoint(turns.select("conv_id", "n", n_words(F.col("text")).alias("words"), *x).withColumn("segment", F.expr("(n - 1) div " + str(SEGMENT))))
    running = Window.partitionBy("conv_id", "segment").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    whole = r.groupBy("conv_id", "segment").agg(*(F.expr(f"bit_xor(x{s})").alias(f"y{s}") for s in (1, 2)))
    whole = whole.select("conv_id", "segment", *(F.expr(f"bit_xor(y{s})").over(before).alias(f"y{s}") for s in (1, 2))).where("segment > 0")
    prefix = r.withColumns({f"p{s}": F.expr(f"bit_xor(x{s})").over(running) for s in (1, 2)}).join(whole, ["conv_id", "segment"], "left")
    prefix = prefix.withColumns({f"p{s}": F.col(f"p{s}").bitwiseXOR(F.coalesce(f"y{s}", F.lit(0).cast("long"))) for s in (1, 2)})
    up = {f"u{s}": F.col(f"p{s}").bitwiseXOR(F.col(f"x{s}")) for s in (1, 2)}
    prefix = checkpoint(prefix.withColumns(up).select("conv_id", F.col("n").alias("depth"), "words", "p1", "p2", "u1", "u2"))

    nodes = checkpoint(prefix.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("u1").alias("u1"), F.min("u2").alias("u2")))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")  # a single row
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.where("depth > 1").join(parent, ["depth", "u1", "u2"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "words")
    top = nodes.where("depth = 1").join(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))).select("conv_id", "depth", "parent_conv_id", "n_convs", "words")
    zero = F.lit(0).cast("long")
    tree = checkpoint(tree.union(top).union(root.select("conv_id", zero, F.lit(None).cast("long"), "n_convs", zero)))

    children = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = tree.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_totals(own).withColumnRenamed("saved", "saved_tokens")

    last = prefix.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("last")).select(F.col("conv_id").alias("member"), "last.*")
    ends = last.join(nodes.select("depth", "p1", "p2", "conv_id"), ["depth", "p1", "p2"]).select("conv_id", "depth", "member")
    bare = members.join(last.select(F.col("member").alias("conv_id")), "conv_id", "left_anti").select(F.col("conv_id").alias("member"))
    ends = ends.union(bare.join(F.broadcast(root.select("conv_id"))).select("conv_id", zero, "member"))
    out = tree.drop("words").join(sums, ["conv_id", "depth"]).join(digests_of_ends(ends), ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from another one."""
    return F.crc32(conv_id.cast("string")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, turns): each conversation c with the first turns of c - c % 20 in place of as many of its own."""
    own = checkpoint(numbered(turns))
    members = own.groupBy("conv_id").agg(F.max("n").alias("size"))
    members = checkpoint(members.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": borrowed(F.col("conv_id"))}))
    base = members.select(F.col("conv_id").alias("base"), F.col("size").alias("given"))
    taken = members.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"))
    rest = own.join(taken, "conv_id").where("n > h").select("conv_id", (F.col("n") - F.col("h") + F.col("taken")).alias("n"), "role", "text")
    head = own.where("n <= 3").withColumnRenamed("conv_id", "base").join(taken, "base").where("n <= h").select("conv_id", "n", "role", "text")
    return members.select("conv_id"), head.union(rest)


def trie_query(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text).

    Rows that are repeated are turns of their own; null roles and texts are empty.
    Rows without a conv_id belong to no conversation. Other columns are ignored.
    """
    return prefix_trie(*rebuilt(turns))


ORACLE = """
WITH b AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([CAST(n AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
), m AS (
  SELECT conv_id, size, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS size FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), b
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT m.*, least(m.h, coalesce(g.size, 0)) AS taken FROM m LEFT JOIN m g ON g.conv_id = m.base
), r AS (
  SELECT k.conv_id, n - h + taken AS n, role, text FROM o JOIN k ON o.conv_id = k.conv_id AND n > h
  UNION ALL SELECT k.conv_id, n, role, text FROM o JOIN k ON o.conv_id = k.base AND n <= h
), p AS (
  SELECT conv_id, n AS depth, text, string_agg(md5(length(role) || ':' || role || text), '' ORDER BY n) OVER (PARTITION BY conv_id ORDER BY n) AS path FROM r
), s AS (
  SELECT conv_id, depth, md5(path) AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM p
  UNION ALL SELECT conv_id, 0, '', 0 FROM m
), v AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM s GROUP BY 1, 2
), e AS (
  SELECT conv_id, max(depth) AS depth FROM s GROUP BY 1
), f AS (
  SELECT s.depth, s.node, sha256(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id)) AS ends FROM s JOIN e USING (conv_id, depth) GROUP BY 1, 2
), w AS (
  SELECT v.*, q.conv_id AS parent_conv_id, q.node AS up FROM v LEFT JOIN s c ON c.conv_id = v.conv_id AND c.depth = v.depth - 1 LEFT JOIN v q ON q.depth = c.depth AND q.node = c.node
), c AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM w WHERE depth > 0 GROUP BY 1, 2
), x AS (
  SELECT w.*, coalesce(c.n, 0) AS n_children FROM w LEFT JOIN c ON c.depth = w.depth AND c.node = w.node
), y AS (
  SELECT a.depth, a.node, sum((x.n_children = 0)::BIGINT) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved FROM x JOIN s a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1, 2
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, x.parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(y.n_leaves AS BIGINT) AS n_leaves, CAST(y.saved AS BIGINT) AS saved_tokens, coalesce(f.ends, sha256('')) AS ends_sha256
FROM x JOIN y ON y.depth = x.depth AND y.node = x.node LEFT JOIN f ON f.depth = x.depth AND f.node = x.node
"""
