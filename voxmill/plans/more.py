"""More operators on whole tables, and the queries of a second field whose cells grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import grid, sdf
from voxmill.functions.grid import BLOCK_KEY, CORNERS, KEY, with_block
from voxmill.operators import band, components, conditions, optimize, predicates, region, scene, search, stencil, texture
from voxmill.plans.queries import BLOCKS, FAT, DX, NODES, OFF8, ORACLE_SQL, QUERIES, THIN, V, _fat, field, offsets_sql, query, r6
from voxmill.session import checkpoint
from voxmill.sources import snapshots

NO_FORCE = "CAST(0 AS DOUBLE)"
POS = lambda c, shift=0, half=0.5: f"((CAST({c} AS DOUBLE) + {shift} + {half} - 8) * 0.02 - 0.5)"


def moved(df: DataFrame, i: int = 8, j: int = 28, k: int = 28) -> DataFrame:
    """The field in the middle of the unit domain."""
    return df.withColumns({c: (F.col(c) + n).cast("int") for c, n in zip(KEY, (i, j, k), strict=True)})


def inside(cells: DataFrame) -> DataFrame:
    """Flags: inside, and a fixed density where the count of items is divisible by 4."""
    return cells.withColumn("flags", F.when(F.col("n") % 4 == 0, grid.INSIDE | grid.FIXED_DENSITY).otherwise(grid.INSIDE).cast("long"))


@query(f"""
WITH {V}, {OFF8}, {NODES}, g AS (SELECT DISTINCT i + 2 AS i, j, k FROM f WHERE i % 3 = 0 AND j > 0 INTERSECT SELECT * FROM nodes), t AS (SELECT DISTINCT i - x AS i, j - y AS j, k - z AS k FROM g CROSS JOIN o)
SELECT i, j, k, CAST(CASE WHEN (i, j, k) IN (SELECT (i, j, k) FROM t) THEN 7 ELSE 1 END AS BIGINT) AS flags FROM f""")
def q41_node_force(spark, sf_dir):
    v = field(spark, sf_dir).withColumn("flags", F.lit(grid.INSIDE).cast("long"))
    forces = v.where("i % 3 = 0").select((F.col("i") + 2).cast("int").alias("i"), "j", "k", F.lit(0.0).alias("fx"), F.lit(-1.0).alias("fy"), F.lit(0.0).alias("fz"))
    return conditions.node_force(v, forces, region.nodes_of(v).where("j = 0"), fix=True)[1].select(*KEY, "flags")


@query(f"WITH {V}, {OFF8}, {NODES} SELECT i, j, k, {NO_FORCE} AS fx, CAST(-1 AS DOUBLE) AS fy, {NO_FORCE} AS fz FROM nodes WHERE i BETWEEN 24 AND 26 AND j BETWEEN 4 AND 6 AND k BETWEEN 3 AND 5")
def q42_box_force(spark, sf_dir):
    return conditions.load(field(spark, sf_dir), (25, 5, 4), (0.0, -27.0, 0.0), 0.05, DX)


@query(f"WITH {V}, {OFF8}, {NODES} SELECT i * 2 AS i, j, k, CAST(n % 3 AS INT) AS axis FROM f WHERE (i * 2, j, k) IN (SELECT (i, j, k) FROM nodes)")
def q43_node_boundary(spark, sf_dir):
    v = field(spark, sf_dir)
    records = v.select((F.col("i") * 2).cast("int").alias("i"), "j", "k", (F.col("n") % 3).cast("int").alias("axis"), F.lit(0.0).alias("value"))
    return conditions.node_boundary(v, records).select(*KEY, "axis")


@query(f"WITH {V}, {OFF8}, b AS (SELECT * FROM f WHERE density <> 0 AND {POS('i', 8)} BETWEEN -0.2 AND 0.3 AND {POS('j', 28)} BETWEEN -0.08 AND 0.05 AND {POS('k', 28)} BETWEEN -0.05 AND 0.2) SELECT DISTINCT i + 8 + x AS i, j + 28 + y AS j, k + 28 + z AS k, 1 AS axis FROM b CROSS JOIN o")
def q44_box_conditions(spark, sf_dir):
    return conditions.box_dirichlet(moved(field(spark, sf_dir)), (-0.2, -0.08, -0.05), (0.3, 0.05, 0.2), DX, "y").select(*KEY, "axis").distinct()


@query(f"WITH {V}, {OFF8}, {NODES} SELECT i + 8 AS i, j + 28 AS j, k + 28 AS k, {NO_FORCE} AS fx, {NO_FORCE} AS fy, CAST(2 AS DOUBLE) AS fz FROM nodes WHERE {POS('i', 8, 0)} BETWEEN -0.195 AND 0.305 AND {POS('j', 28, 0)} BETWEEN -0.075 AND 0.055 AND {POS('k', 28, 0)} BETWEEN -0.055 AND 0.205")
def q45_box_load(spark, sf_dir):
    return conditions.box_load(moved(region.nodes_of(field(spark, sf_dir))), (-0.195, -0.075, -0.055), (0.305, 0.055, 0.205), (0.0, 0.0, 2.0), DX)


@query(f"""
WITH {V}, {OFF8}, {NODES}, p AS (SELECT i + 8 AS i, j + 28 AS j, k + 28 AS k, {POS('i', 8, 0)} AS x, {POS('j', 28, 0)} AS y, {POS('k', 28, 0)} AS z FROM nodes
), h AS (SELECT *, sqrt(x * x + y * y) AS h FROM p)
SELECT i, j, k, round(-y, 6) + 0.0 AS fx, round(x, 6) + 0.0 AS fy, {NO_FORCE} AS fz FROM h WHERE h > 0.42 AND sqrt((h - 0.45) * (h - 0.45) + z * z) - 0.03 < 0""")
def q46_wheel_load(spark, sf_dir):
    return r6(conditions.wheel_load(moved(region.nodes_of(field(spark, sf_dir))), DX), "fx", "fy")


@query(f"""
WITH {V}, p AS (SELECT i + 8 AS i, j + 28 AS j, k + 28 AS k, {POS('i', 8)} AS x, {POS('j', 28)} AS y, {POS('k', 28)} AS z FROM f)
SELECT i, j, k, (x < -0.25 OR (x > 0 AND abs(y) < 0.1 AND abs(z) < 0.1))::INT::DOUBLE AS island, (sqrt(x * x + z * z) < 0.25)::INT::DOUBLE AS cylinder, (abs(sqrt(x * x + (y + 0.5) * (y + 0.5)) - 0.4) < 0.1)::INT::DOUBLE AS arch FROM p""")
def q47_presets(spark, sf_dir):
    out = moved(field(spark, sf_dir)).select(*KEY)
    for kind in ("island", "cylinder", "arch"):
        out = conditions.preset_density(out, DX, kind).withColumnRenamed("density", kind)
    return out


@query(f"WITH {V} SELECT count(*) AS cells, count(*) FILTER (n % 4 = 0) AS hard, round(sum(density), 6) AS volume FROM f")
def q48_counters(spark, sf_dir):
    return r6(region.counters(inside(field(spark, sf_dir))), "volume")


@query(f"WITH {V}, {OFF8}, {NODES} SELECT DISTINCT {BLOCKS} FROM nodes")
def q49_node_blocks(spark, sf_dir):
    return region.node_blocks(field(spark, sf_dir))


@query(f"WITH {V}, {OFF8}, {NODES}, b AS (SELECT DISTINCT {BLOCKS} FROM f) SELECT * FROM (SELECT *, {BLOCKS} FROM nodes) WHERE (bi, bj, bk) NOT IN (SELECT (bi, bj, bk) FROM b)")
def q50_outside_blocks(spark, sf_dir):
    v = field(spark, sf_dir)
    return predicates.outside_blocks(v, predicates.blocks_of(v))


@query(f"WITH {V}, b AS (SELECT DISTINCT {BLOCKS} FROM f) SELECT * FROM b WHERE bi < 1 OR bj < 1 OR bk < 1 OR bi >= 11 OR bj >= 2 OR bk >= 2")
def q51_padding(spark, sf_dir):
    return predicates.out_of_padding(predicates.blocks_of(field(spark, sf_dir)), (13, 4, 4))


@query(f"WITH {V} SELECT i, j, k, CAST(1 + CASE WHEN n % 5 <> 0 THEN 256 ELSE 0 END + CASE WHEN i = 1 THEN 512 + 2048 ELSE 0 END + CASE WHEN j = 0 THEN 1024 ELSE 0 END AS BIGINT) AS flags FROM f")
def q52_flags_from_tables(spark, sf_dir):
    v = field(spark, sf_dir).withColumns({"flags": F.lit(grid.INSIDE).cast("long"), "mu": (F.col("n") % 5).cast("double")})
    fixed = v.where("i = 1").select(*KEY, F.explode(F.array(F.lit(0), F.lit(2), F.lit(2))).alias("axis")).union(v.where("j = 0").select(*KEY, F.lit(1)))
    return predicates.dirichlet_cells(predicates.active_cells(v), fixed).select(*KEY, "flags")


@query(f"""
WITH RECURSIVE {V}, {THIN.replace("0.6", "0.45")}, {offsets_sql('o', grid.FACES)}, r AS (
  SELECT bi, bj, bk, bi AS a, bj AS b, bk AS c FROM thin UNION SELECT t.bi, t.bj, t.bk, r.a, r.b, r.c FROM r CROSS JOIN o JOIN thin t ON t.bi = r.bi + x AND t.bj = r.bj + y AND t.bk = r.bk + z
), m AS (SELECT bi, bj, bk, min((a, b, c)) AS m FROM r GROUP BY ALL), n AS (SELECT m, count(*) AS n FROM m GROUP BY m)
SELECT bi, bj, bk FROM m WHERE m IN (SELECT m FROM n WHERE n > 0.3 * (SELECT count(*) FROM m))""")
def q53_main_blocks(spark, sf_dir):
    return components.filter_blocks(field(spark, sf_dir), 0.45)[1]


@query()
def q54_filter_voxels(spark, sf_dir):
    """What a threshold leaves of the field: the thin blocks of its one main component."""
    _, thin, _ = components.threshold_and_kill(field(spark, sf_dir), 0.2)
    return r6(thin, "density_min", "density_max", "density_sum")


@query(f"WITH {V}, {OFF8} SELECT 2 * i + x AS i, 2 * j + y AS j, 2 * k + z AS k, CAST(1 AS BIGINT) AS flags, round(cbrt(density), 6) AS density FROM f CROSS JOIN o")
def q55_field_domain(spark, sf_dir):
    return r6(region.from_field(field(spark, sf_dir), 2), "density")


@query(f"WITH {V}, s AS (SELECT i + 1 AS i, j, k, greatest(least(cbrt(density * 2 - 0.9), 1), 0) AS density FROM f WHERE density * 2 - 0.9 <> 0) SELECT i, j, k, round(density, 6) + 0.0 AS density, (i, j, k) IN (SELECT (i, j, k) FROM f) AS kept FROM s")
def q56_load_density(spark, sf_dir):
    v = field(spark, sf_dir)
    stored = v.select((F.col("i") + 1).cast("int").alias("i"), "j", "k", (F.col("density") * 2 - 0.9).alias("density"))
    kept, dropped = snapshots.load_density(v, stored, penalty=0.0)
    return r6(kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False))), "density")


@query(f"WITH {V}, d AS (SELECT i, j, k, density - 0.5 AS d FROM f) SELECT i, j, k, round(CASE WHEN (SELECT min(d) FROM d) < 0 THEN abs(d) ELSE d END / (SELECT max(abs(d)) FROM d), 6) AS value FROM d")
def q57_channel(spark, sf_dir):
    return r6(stencil.channel(field(spark, sf_dir).withColumn("d", F.col("density") - 0.5), "d"), "value")


@query(f"WITH {V} SELECT i::INT AS i, j::INT AS j, k::INT AS k, round(coalesce(density, 0), 6) AS value FROM range(0, 52) a(i) CROSS JOIN range(0, 12) b(j) CROSS JOIN range(0, 9) c(k) LEFT JOIN f USING (i, j, k)")
def q58_dense(spark, sf_dir):
    return r6(region.dense(field(spark, sf_dir), (0, 0, 0), (52, 12, 9)), "value")


@query(f"WITH {V} SELECT count(*) FILTER (n % 4 = 0) AS fixed, count(*) AS cells, round(min(3 * density * density) FILTER (n % 4 <> 0), 6) AS neg_dc_min, round(max(3 * density * density) FILTER (n % 4 <> 0), 6) AS neg_dc_max FROM f")
def q59_gradient_range(spark, sf_dir):
    v = inside(field(spark, sf_dir)).withColumn("dc0", -3 * F.col("density") * F.col("density"))
    return r6(optimize.gradient_range(v, smart_oc=True), "neg_dc_min", "neg_dc_max")


@query(f"""
WITH {V}, c AS (SELECT i, j, k FROM f WHERE density >= 0.5 AND j >= 3), {offsets_sql('o', grid.FACES)}, e AS (SELECT i, j, k, x AS dx, y AS dy, z AS dz FROM c CROSS JOIN o)
SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.i = e.i + dx AND c.j = e.j + dy AND c.k = e.k + dz)""")
def q60_sliced_faces(spark, sf_dir):
    return stencil.sliced_faces(field(spark, sf_dir), 0.5, 3)


@query(f"WITH {V} SELECT i, j, k, (density >= 0.6 OR n % 4 = 0)::INT::DOUBLE AS density FROM f")
def q61_threshold_with_fixed(spark, sf_dir):
    v = inside(field(spark, sf_dir))
    return search.cut(v, 0.6, fixed=grid.has(F.col("flags"), grid.FIXED_DENSITY)).select(*KEY, "density")


@query(f"WITH {V}, p AS (SELECT i + 8 AS i, j + 28 AS j, k + 28 AS k, 1.03 * {POS('i', 8)} AS x, 1.03 * {POS('j', 28)} AS y, 1.03 * {POS('k', 28)} AS z FROM f) SELECT i, j, k, CAST(CASE WHEN greatest(abs(x) - 0.3, abs(y) - 0.07, abs(z) - 0.3) > 1e-6 THEN 5 ELSE 1 END AS BIGINT) AS flags FROM p")
def q62_make_shell(spark, sf_dir):
    v = moved(field(spark, sf_dir)).withColumn("flags", F.lit(grid.INSIDE).cast("long"))
    return conditions.make_shell(v, DX, sdf.box((0.3, 0.07, 0.3))).select(*KEY, "flags")


@query(f"WITH {V}, {OFF8}, {NODES}, p AS (SELECT i + 8 AS i, j + 28 AS j, k + 28 AS k, {POS('i', 8, 0)} AS x, {POS('j', 28, 0)} AS y, {POS('k', 28, 0)} AS z FROM nodes) SELECT i, j, k, {NO_FORCE} AS fx, CAST(-3 AS DOUBLE) AS fy, {NO_FORCE} AS fz FROM p WHERE greatest(abs(y) - 0.5, abs(sqrt(x * x + z * z) - 0.4) - 0.015) <= 1e-6")
def q63_volume_load(spark, sf_dir):
    where = sdf.cylinder()(*(grid.to_position(F.col(c), DX) for c in KEY)) <= sdf.EDGE
    return conditions.volume_load(moved(region.nodes_of(field(spark, sf_dir))), (0.0, -3.0, 0.0), where)


@query(f"WITH {V}, {OFF8}, {NODES} SELECT i, j, k, CAST(0.5 AS DOUBLE) AS u0, {NO_FORCE} AS u1, CAST(-1 AS DOUBLE) AS u2, CAST(3 AS DOUBLE) AS weight FROM nodes WHERE i >= 4 AND i < 30 AND j >= 2 AND j < 9 AND k >= 1 AND k < 7")
def q64_target_deformation(spark, sf_dir):
    return conditions.target_deformation(region.nodes_of(field(spark, sf_dir)), (4, 2, 1), (30, 9, 7), (0.5, 0.0, -1.0), 3.0)


# The field that grows: line items by part, quarter and quantity; its first axis follows the number of parts.
W = """
v AS (
  SELECT CAST(l_partkey // 20 AS INT) AS i, CAST((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS INT) AS j, CAST(floor(l_quantity / 5) AS INT) AS k, count(*) AS n
  FROM lineitem WHERE l_partkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2, 3
), f AS (SELECT i, j, k, n, n / CAST((SELECT max(n) FROM v) AS DOUBLE) AS density FROM v)
"""


def wide_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, k, n, density) of line items by part, quarter and quantity."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_quantity").dropna()
    i, k = F.expr("cast(l_partkey div 20 as int)"), F.floor(F.col("l_quantity") / 5).cast("int")
    j = ((F.year("l_shipdate") - 1992) * 4 + F.quarter("l_shipdate") - 1).cast("int")
    v = t.groupBy(i.alias("i"), j.alias("j"), k.alias("k")).agg(F.count("*").alias("n"))
    most = v.agg(F.max("n").alias("most"))  # a single row
    return v.join(F.broadcast(most)).select(*KEY, "n", (F.col("n") / F.col("most")).alias("density"))


def _on_wide_field(f):
    return lambda spark, sf_dir: f(spark, sf_dir, field=wide_field)


for _name in ("q01_voxelize", "q04_bounds", "q05_upscale", "q06_nodes", "q07_node_flags", "q08_boundary_band", "q13_thin_blocks", "q14_densest_blocks", "q15_fat_blocks", "q16_active_cells", "q17_weighted_smoothing", "q18_laplacian", "q19_box_mean", "q20_restriction", "q21_prolongation", "q22_threshold", "q23_quantize", "q24_boundary_faces"):
    _wide = _name.replace("q", "w", 1)
    QUERIES[_wide] = _on_wide_field(QUERIES[_name])
    ORACLE_SQL[_wide] = ORACLE_SQL[_name].replace(V, W)


RUNS = """
c AS ({cells}), g AS (
  SELECT i, j, k, i - row_number() OVER (PARTITION BY j, k ORDER BY i) AS s FROM c
), r AS (
  SELECT row_number() OVER (ORDER BY min(i), j, k) AS id, j, k, min(i) AS lo, max(i) AS hi, count(*) AS n FROM g GROUP BY j, k, s
), e AS (
  SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON abs(a.j - b.j) + abs(a.k - b.k) = 1 AND a.j BETWEEN b.j - 1 AND b.j + 1 AND a.k BETWEEN b.k - 1 AND b.k + 1 AND a.lo <= b.hi AND b.lo <= a.hi
), l(id, c) USING KEY (id) AS (
  SELECT id, id FROM r
  UNION
  SELECT e.b, min(l.c) FROM l JOIN e ON e.a = l.id JOIN recurring.l o ON o.id = e.b WHERE l.c < o.c GROUP BY e.b
)"""


@query(f"""WITH RECURSIVE {W}, {RUNS.format(cells="SELECT i, j, k FROM f WHERE n >= 2")}, z AS (SELECT c, CAST(sum(n) AS BIGINT) AS cells, min(CAST(lo AS BIGINT) * 1000000 + j * 1000 + k) AS first FROM l JOIN r USING (id) GROUP BY c)
SELECT ((first // 1000000 + 1048576) * 2097152 + first % 1000000 // 1000 + 1048576) * 2097152 + first % 1000 + 1048576 AS component, cells, round(cells / CAST(sum(cells) OVER () AS DOUBLE), 6) + 0.0 AS fraction FROM z""")
def w25_components(spark, sf_dir):
    """Sizes of the components of the cells with two items or more. The SQL labels runs of cells along an axis."""
    return r6(components.sizes(components.face_components(wide_field(spark, sf_dir).where("n >= 2"))), "fraction")


# A texture of 51 x 11 x 9 points, seen from the field that grows: its axes from 0 to 1 are parts, quarters and quantities.
RES, EXTENT = (51, 11, 9), (1000.0, 28.0, 11.0)


def _place(c: str, n: int, extent: float, half: str) -> str:
    return f"least(greatest(({c} + {half}) / {extent!r} * {n} - 0.5, 0.0), {n - 1}.0)"


def _sampled(cells: str, half: str) -> str:
    place = ", ".join(f"{_place(c, n, e, half)} AS p{c}" for c, n, e in zip(KEY, RES, EXTENT, strict=True))
    total = " + ".join("(" + " * ".join(f"(p{c} - floor(p{c}))" if x else f"(1 - (p{c} - floor(p{c})))" for c, x in zip(KEY, o, strict=True)) + f") * coalesce(t{n}.density, 0)" for n, o in enumerate(CORNERS))
    joins = " ".join(f"LEFT JOIN f t{n} ON t{n}.i = floor(pi) + {o[0]} AND t{n}.j = floor(pj) + {o[1]} AND t{n}.k = floor(pk) + {o[2]}" for n, o in enumerate(CORNERS))
    return f"p AS (SELECT i, j, k, {place} FROM ({cells})), s AS (SELECT p.i, p.j, p.k, {total} AS value FROM p {joins})"


W_CELLS = "SELECT CAST(l_partkey // 20 AS INT) AS i, CAST((year(l_shipdate) - 1992) * 4 + quarter(l_shipdate) - 1 AS INT) AS j, CAST(floor(l_quantity / 5) AS INT) AS k FROM lineitem WHERE l_partkey IS NOT NULL AND l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1, 2, 3"


def _at(half: float) -> tuple:
    return tuple((F.col(c) + half) / e for c, e in zip(KEY, EXTENT, strict=True))


@query(f"WITH {V}, {_sampled(W_CELLS, '0.5')} SELECT i, j, k, round(value, 6) + 0.0 AS sampled, round(value, 6) >= 0.2 AS inside FROM s")
def w65_texture(spark, sf_dir):
    """The stored field's value at the centre of each cell of the field that grows, and whether its domain holds the cell."""
    found = r6(texture.sample(wide_field(spark, sf_dir).select(*KEY), field(spark, sf_dir), RES, _at(0.5)), "sampled")
    return found.withColumn("inside", texture.inside(level=0.2, edge=0.0))


@query(f"WITH {V}, {OFF8}, {_sampled(f'SELECT DISTINCT i + x AS i, j + y AS j, k + z AS k FROM ({W_CELLS}) CROSS JOIN o', '0.0')} SELECT i, j, k, CAST(0 AS DOUBLE) AS fx, CAST(-2 AS DOUBLE) AS fy, CAST(0.5 AS DOUBLE) AS fz FROM s WHERE round(value, 6) > 0.2")
def w66_texture_load(spark, sf_dir):
    """The volume load on all nodes that lie inside a texture."""
    found = r6(texture.sample(region.nodes_of(wide_field(spark, sf_dir)), field(spark, sf_dir), RES, _at(0.0)), "sampled")
    return conditions.volume_load(found, (0.0, -2.0, 0.5), F.col("sampled") > 0.2)


def _some_fixed(cells: DataFrame) -> DataFrame:
    """Active cells, some of them fixed along an axis, a few fixed only."""
    bit = lambda c, b: F.when(c, b).otherwise(0).cast("long")
    flags = bit(F.col("n") > 1, grid.ACTIVE_CELL).bitwiseOR(bit(F.expr("pmod(i * 7 + j * 3 + k, 97) = 0"), grid.DIRICHLET_CELL[0])).bitwiseOR(bit(F.expr("pmod(i + j * 5 + k * 11, 89) = 0"), grid.DIRICHLET_CELL[2])).bitwiseOR(F.lit(1).cast("long"))
    return cells.withColumn("flags", flags)


LEVELS = f"""
c AS (SELECT i, j, k, CAST((CASE WHEN n > 1 THEN 256 ELSE 0 END) | (CASE WHEN (i * 7 + j * 3 + k) % 97 = 0 THEN 512 ELSE 0 END) | (CASE WHEN (i + j * 5 + k * 11) % 89 = 0 THEN 2048 ELSE 0 END) | 1 AS BIGINT) AS flags FROM f
), h AS (
  SELECT CAST(l AS INT) AS level, CAST(floor((i - 4) / pow(2, l)) + 4 AS INT) AS i, CAST(floor((j - 4) / pow(2, l)) + 4 AS INT) AS j, CAST(floor((k - 4) / pow(2, l)) + 4 AS INT) AS k,
    bit_or(CASE WHEN l = 0 THEN flags ELSE flags & 3840 END) AS flags
  FROM c, range(4) r(l) WHERE l = 0 OR flags & 3840 <> 0 GROUP BY 1, 2, 3, 4
), {OFF8}, {offsets_sql("a27", grid.AROUND)}, hn AS (
  SELECT level, i + x AS i, j + y AS j, k + z AS k, bit_or(flags >> 4) AS flags FROM h CROSS JOIN o GROUP BY 1, 2, 3, 4
)"""
BAND = ", ".join(
    f"m{n} AS MATERIALIZED (SELECT DISTINCT level, i + x AS i, j + y AS j, k + z AS k FROM {'hn' if n == 1 else f'b{n - 1}'} CROSS JOIN a27{' WHERE flags & 224 <> 0' if n == 1 else ''}), "
    f"b{n} AS MATERIALIZED (SELECT level, i, j, k FROM hn SEMI JOIN m{n} USING (level, i, j, k) WHERE flags & 224 = 0)"
    for n in (1, 2)
)


@query(f"WITH {W}, {LEVELS}, {BAND} SELECT hn.level, hn.i, hn.j, hn.k, hn.flags, b2.level IS NOT NULL AS band FROM hn LEFT JOIN b2 ON b2.level = hn.level AND b2.i = hn.i AND b2.j = hn.j AND b2.k = hn.k")
def w67_hierarchy_nodes(spark, sf_dir):
    """Node flags and boundary band of four levels at once."""
    nodes = checkpoint(predicates.hierarchy_nodes(predicates.hierarchy(_some_fixed(wide_field(spark, sf_dir)), 4)))
    band = predicates.hierarchy_band(nodes, 2).withColumn("band", F.lit(True))
    return nodes.join(band, ["level", *KEY], "left").withColumn("band", F.coalesce("band", F.lit(False)))


@query(f"""WITH {W}, {LEVELS}, q AS (
  SELECT level, i, j, k FROM h WHERE level = 0 UNION ALL SELECT level, i + x, j + y, k + z FROM h CROSS JOIN o WHERE level > 0 AND flags & 256 <> 0
  UNION ALL SELECT level, i + x, j + y, k + z FROM h CROSS JOIN o WHERE level > 0 AND flags & 3584 <> 0 AND x + y + z > 0
) SELECT DISTINCT level, CAST(floor(i / 4.0) AS INT) AS bi, CAST(floor(j / 4.0) AS INT) AS bj, CAST(floor(k / 4.0) AS INT) AS bk FROM q""")
def w68_hierarchy_blocks(spark, sf_dir):
    """The blocks of four levels, with upper neighbours."""
    return predicates.hierarchy_blocks(predicates.hierarchy(_some_fixed(wide_field(spark, sf_dir)), 4))


SCENE = ", ".join(f"(CAST({c} AS DOUBLE) + 0.5) / {e!r} - 0.5 AS {x}" for c, e, x in zip(KEY, EXTENT, "xyz", strict=True))


@query(f"""
WITH {V}, {_sampled(W_CELLS, '0.5')}, u AS (SELECT s.*, {SCENE}, f.n IS NOT NULL AS stored FROM s LEFT JOIN f USING (i, j, k)), q AS (
  SELECT i, j, k, x, y, z, greatest(sqrt(x * x + y * y + z * z) - 0.5, 0.4 - sqrt(x * x + y * y + z * z)) <= 1e-6 AS shell, greatest(abs(x) - 0.3, abs(y) - 0.3, abs(z) - 0.3) <= 1e-6 AS box, 0.25 - value <= 1e-6 AS dense, stored FROM u
) SELECT i, j, k, stored AND dense AS fixed, 0.0::DOUBLE AS fx, CASE WHEN shell THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS fy, CASE WHEN shell THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fz FROM q WHERE (shell OR dense) AND NOT (box AND NOT stored)""")
def w69_scene(spark, sf_dir):
    """A declared scene on the field that grows: a shell or a texture, without a box but for a stored field."""
    stored = field(spark, sf_dir)
    shell, box = scene.Shape(sdf.domain("sphere")), scene.Shape(sdf.domain("box"))
    dense, kept = scene.Texture(stored, RES, level=0.25), scene.Field(stored)
    domain = scene.difference(scene.union(shell, dense), scene.difference(box, kept))
    at = tuple((F.col(c).cast("double") + 0.5) / e - 0.5 for c, e in zip(KEY, EXTENT, strict=True))
    return scene.declared(wide_field(spark, sf_dir).select(*KEY), domain, 1.0, scene.intersection(kept, dense), shell, (0.0, -1.0, 0.5), at).fillna(0.0, ["fx", "fy", "fz"])


@query(ORACLE_SQL["q46_wheel_load"].replace("round(-y, 6) + 0.0 AS fx, round(x, 6) + 0.0 AS fy, CAST(0 AS DOUBLE) AS fz", "CAST(0 AS DOUBLE) AS fx, CAST(0 AS DOUBLE) AS fy, CAST(1 AS DOUBLE) AS fz"))
def q70_wheel_shear(spark, sf_dir):
    return conditions.wheel_load(moved(region.nodes_of(field(spark, sf_dir))), DX, shear=True)


@query(f"WITH {W} SELECT i, j, k, n, round(density, 6) + 0.0 AS density FROM f WHERE k >= 2 AND k < 4 AND density >= 0.4")
def w71_slab(spark, sf_dir):
    """A slab of the field over a threshold."""
    return r6(snapshots.in_slab(wide_field(spark, sf_dir), "z", 2, 4, 0.4), "density")


_UP = "up AS (SELECT DISTINCT bi + x AS bi, bj + y AS bj, bk + z AS bk FROM fat CROSS JOIN o INTERSECT SELECT * FROM box)"


@query(f"""WITH {W}, {FAT}, {OFF8}, {_UP}
SELECT bi, bj, bk, true AS container, (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM thin) AS thin, (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM fat) AS fat, (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM up) AS fatter FROM box""")
def w72_block_state(spark, sf_dir):
    """All sets of blocks as one table of marks."""
    v, fat_blocks, box = _fat(spark, sf_dir, wide_field)
    return band.block_state(box, band.thin(v, 0.6), fat_blocks, band.fatter(fat_blocks, box))


@query(f"WITH {W}, {FAT} SELECT i, j, k, CASE WHEN (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM fat) THEN 0.0::DOUBLE ELSE round(-3 * density * density, 6) + 0.0 END AS dc0 FROM (SELECT *, {BLOCKS} FROM f)")
def w73_clear_gradients(spark, sf_dir):
    v, fat_blocks, _ = _fat(spark, sf_dir, wide_field)
    return r6(band.clear_gradients(v.select(*KEY, (-3 * F.col("density") * F.col("density")).alias("dc0")), fat_blocks), "dc0")


LOADED = f"""
c AS (SELECT i, j, k FROM v), l AS (SELECT i + 1 AS i, j, k, greatest(least(density * 2 - 0.9, 1), 0) AS density FROM (SELECT *, n / CAST((SELECT max(n) FROM v) AS DOUBLE) AS density FROM v) WHERE density * 2 - 0.9 <> 0
), f AS (SELECT c.i, c.j, c.k, coalesce(l.density, 0) AS density FROM c LEFT JOIN l USING (i, j, k))"""


@query(f"WITH {W.rsplit(', f AS', 1)[0].rstrip()}, {LOADED}, {FAT.replace('density > 0.55', 'density > 1e-6')} SELECT bi, bj, bk, (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM thin) AS thin, (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM fat) AS fat FROM box")
def w74_loaded_bands(spark, sf_dir):
    """Stored densities, moved by a cell, in the container of the field that grows: which blocks become thin and fat."""
    v = wide_field(spark, sf_dir)
    stored = v.select((F.col("i") + 1).cast("int").alias("i"), "j", "k", (F.col("density") * 2 - 0.9).alias("density"))
    cells, thin_blocks, fat_blocks, _ = snapshots.load_density_with_bands(v, stored, minimum=0.6)
    box = with_block(cells).select(*BLOCK_KEY).distinct()
    return band.block_state(box, thin_blocks, fat_blocks, box).select(*BLOCK_KEY, "thin", "fat")
