"""The operators applied to whole tables, and the same in DuckDB's SQL.

The field: line items counted by quantity, discount and tax make at most some
thousand cells with a density; other queries go through orders and customers.
"""

from __future__ import annotations

from itertools import product
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions import grid, sdf
from voxmill.functions.grid import BLOCK_KEY, CORNERS, DIAGONALS, FACES, KEY, with_block
from voxmill.operators import band, components, conditions, elasticity, krylov, optimize, predicates, region, search, stencil

MU, LAM, DX = 0.5, 0.25, 0.02
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, k, n, density) of line items; rows with a null or a coordinate outside an int take no part."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax").dropna()
    v = t.groupBy(F.col("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), F.round(F.col("l_tax") * 100).cast("int").alias("k")).agg(F.count("*").alias("n"))
    most = v.agg(F.max("n").alias("most"))  # a single row
    return v.join(F.broadcast(most)).select(*KEY, "n", (F.col("n") / F.col("most")).alias("density"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six digits, as sums depend on their order; 0.0 for -0.0."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


V = """
v AS (
  SELECT CAST(l_quantity AS INT) AS i, CAST(round(l_discount * 100) AS INT) AS j, CAST(round(l_tax * 100) AS INT) AS k, count(*) AS n
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1, 2, 3
), f AS (SELECT i, j, k, n, n / CAST((SELECT max(n) FROM v) AS DOUBLE) AS density FROM v)
"""


def offsets_sql(name: str, offsets: list, weights: list | None = None) -> str:
    rows = ", ".join(f"({x}, {y}, {z}, {w!r})" for (x, y, z), w in zip(offsets, weights or [1.0] * len(offsets), strict=True))
    return f"{name}(x, y, z, w) AS (VALUES {rows})"


OFF8, AROUND = offsets_sql("o", CORNERS), offsets_sql("o", grid.AROUND)
NODES = "nodes AS (SELECT DISTINCT i + x AS i, j + y AS j, k + z AS k FROM f CROSS JOIN o)"
BLOCKS = "CAST(floor(i / 4.0) AS INT) AS bi, CAST(floor(j / 4.0) AS INT) AS bj, CAST(floor(k / 4.0) AS INT) AS bk"
POSITION = "i / 51.0 - 0.5 AS x, j / 11.0 - 0.5 AS y, k / 9.0 - 0.5 AS z"


@query(f"WITH {V} SELECT i, j, k, n, round(density, 6) + 0.0 AS density FROM f")
def q01_voxelize(spark, sf_dir, field=field):
    return r6(field(spark, sf_dir), "density")


@query(f"""
WITH {V}, p AS (SELECT i, j, k, CAST(i AS DOUBLE) / 51 - 0.5 AS x, CAST(j AS DOUBLE) / 11 - 0.5 AS y, CAST(k AS DOUBLE) / 9 - 0.5 AS z FROM f
), h AS (SELECT *, sqrt(x * x + y * y + z * z) AS d, sqrt(x * x + y * y) AS h FROM p)
SELECT i, j, k, greatest(d - 0.5, 0.4 - d) <= 1e-6 AS sphere, greatest(greatest(d - 0.5, 0.4 - d), y) <= 1e-6 AS half,
  greatest(abs(x) - 0.3, abs(y) - 0.3, abs(z) - 0.3) <= 1e-6 AS box,
  greatest(abs(y) - 0.5, abs(sqrt(x * x + z * z) - 0.4) - 0.015) <= 1e-6 AS cylinder,
  least(sqrt((h - 0.45) * (h - 0.45) + z * z) - 0.03, abs(h) + 4.5 * abs(z) - 0.45) <= 1e-6 AS wheel
FROM h""")
def q02_domains(spark, sf_dir):
    p = [F.col(c).cast("double") / n - 0.5 for c, n in zip(KEY, (51, 11, 9), strict=True)]
    domains = {"sphere": sdf.domain("sphere"), "half": sdf.domain("sphere", lower_only=True), "box": sdf.domain("box"), "cylinder": sdf.domain("cylinder"), "wheel": sdf.domain("wheel")}
    return field(spark, sf_dir).select(*KEY, *((d(*p) <= sdf.EDGE).alias(n) for n, d in domains.items()))


@query(f"""
WITH {V}, a AS (SELECT i, j, k, '' AS m FROM f WHERE i <= 25), b AS (SELECT * FROM a UNION ALL SELECT i + 1, j, k, m || 'x' FROM a WHERE i = 25
), c AS (SELECT * FROM b WHERE k <= 4) SELECT i, j, k, m AS mirror_axes FROM c UNION ALL SELECT i, j, k + 1, m || 'z' FROM c WHERE k = 4""")
def q03_mirror(spark, sf_dir):
    cells = field(spark, sf_dir).select(*KEY, F.lit("").alias("mirror_axes"))
    return region.mirror_clip(region.mirror_clip(cells, "x", 25), "z", 4)


@query(f"WITH {V} SELECT min(i) AS i_min, min(j) AS j_min, min(k) AS k_min, max(i) + 1 AS i_max, max(j) + 1 AS j_max, max(k) + 1 AS k_max, count(*) AS cells FROM f")
def q04_bounds(spark, sf_dir, field=field):
    return region.bounds(field(spark, sf_dir))


@query(f"""
WITH {V}, {OFF8}, fine AS (SELECT 2 * i + x AS i, 2 * j + y AS j, 2 * k + z AS k FROM f CROSS JOIN o)
SELECT a.i, a.j, a.k, round(b.density, 6) AS value FROM fine a JOIN f b ON a.i // 2 = b.i AND a.j // 2 = b.j AND (a.k + 1) // 2 = b.k""")
def q05_upscale(spark, sf_dir, field=field):
    v = field(spark, sf_dir)
    fine = grid.shifted(v.select(*((F.col(c) * 2).alias(c) for c in KEY)), CORNERS)
    return r6(region.upscale(fine, v, (0, 0, 0), 2), "value")


@query(f"WITH {V}, {OFF8}, {NODES} SELECT i, j, k FROM nodes")
def q06_nodes(spark, sf_dir, field=field):
    return region.nodes_of(field(spark, sf_dir))


def flagged(cells: DataFrame) -> DataFrame:
    flags = F.lit(grid.ACTIVE_CELL).cast("long")
    for c, n, bit in zip(KEY, (2, 3, 5), grid.DIRICHLET_CELL, strict=True):
        flags = flags.bitwiseOR(F.when(F.col(c) % n == 0, bit).otherwise(0).cast("long"))
    return cells.withColumn("flags", flags)


FLAGS = "CAST(256 + CASE WHEN i % 2 = 0 THEN 512 ELSE 0 END + CASE WHEN j % 3 = 0 THEN 1024 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2048 ELSE 0 END AS BIGINT)"


@query(f"WITH {V}, {OFF8}, c AS (SELECT i, j, k, {FLAGS} AS flags FROM f) SELECT i + x AS i, j + y AS j, k + z AS k, bit_or(flags >> 4) AS flags FROM c CROSS JOIN o GROUP BY 1, 2, 3")
def q07_node_flags(spark, sf_dir, field=field):
    return predicates.flag_nodes(flagged(field(spark, sf_dir)))


def _band(passes: int) -> str:
    steps = ", ".join(f"b{n} AS (SELECT DISTINCT nodes.i, nodes.j, nodes.k FROM b{n - 1} b CROSS JOIN o JOIN nodes ON nodes.i = b.i + x AND nodes.j = b.j + y AND nodes.k = b.k + z)" for n in range(1, passes + 1))
    return f"WITH {V}, {OFF8}, {NODES}, a27(x, y, z) AS (SELECT * FROM (VALUES {', '.join(map(str, grid.AROUND))})), b0 AS (SELECT * FROM nodes WHERE i = 1), " + steps.replace("CROSS JOIN o", "CROSS JOIN a27") + f" SELECT i, j, k FROM b{passes} WHERE i <> 1"


@query(_band(3))
def q08_boundary_band(spark, sf_dir, field=field):
    nodes = region.nodes_of(field(spark, sf_dir))
    return predicates.boundary_band(nodes, nodes.where("i = 1"), 3)


@query(f"WITH {V}, {OFF8}, {NODES}, p AS (SELECT * FROM nodes WHERE i = 51) SELECT i, j, k, round(0.0, 6) AS fx, round(-1.0 / count(*) OVER (), 6) + 0.0 AS fy, round(0.0, 6) AS fz FROM p".replace("round(0.0, 6)", "CAST(0 AS DOUBLE)").replace("-1.0 /", "CAST(-1 AS DOUBLE) /"))
def q09_plane_load(spark, sf_dir):
    return r6(conditions.plane_load(region.nodes_of(field(spark, sf_dir)), (0.0, -1.0, 0.0), 0, 51), "fx", "fy", "fz")


@query(f"""
WITH {V}, {offsets_sql("o", [(0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 1)])}, b AS (SELECT * FROM f WHERE j = 0)
SELECT i + x AS i, j, k + z AS k, CAST(0 AS DOUBLE) AS fx, round(-(count(*) / CAST(4 AS DOUBLE) / (SELECT count(*) FROM b)), 6) AS fy, CAST(0 AS DOUBLE) AS fz FROM b CROSS JOIN o GROUP BY 1, 2, 3""")
def q10_bridge_load(spark, sf_dir):
    return r6(conditions.bridge_load(field(spark, sf_dir), 0), "fx", "fy", "fz")


@query(f"""
WITH {V}, {OFF8}, {NODES}, c AS (SELECT i, k, min(j) AS low, max(j) AS high FROM nodes WHERE abs((i - 8) * 0.02 - 0.5) < 0.35 GROUP BY i, k)
SELECT i, high AS j, k, CAST(0 AS DOUBLE) AS fx, CAST(-0.5 AS DOUBLE) AS fy, CAST(0 AS DOUBLE) AS fz FROM c
UNION ALL SELECT i, low, k, 0, 1, 0 FROM c""")
def q11_column_load(spark, sf_dir):
    return conditions.column_load(region.nodes_of(field(spark, sf_dir)), DX)


@query(f"""
WITH {V}, {OFF8}, a(axis) AS (VALUES (0), (1), (2)), r AS (SELECT DISTINCT i + x AS i, j + y AS j, k + z AS k, axis FROM f CROSS JOIN o CROSS JOIN a WHERE (f.i = 1) OR (f.j = 0 AND axis = 1))
SELECT i - x AS i, j - y AS j, k - z AS k, axis FROM r CROSS JOIN o GROUP BY 1, 2, 3, 4 HAVING count(*) = 8""")
def q12_fixed_cells(spark, sf_dir):
    v = field(spark, sf_dir)
    records = conditions.plane_dirichlet(v, 0, 1).union(conditions.plane_dirichlet(v, 1, 0, "y"))
    return conditions.fixed_cells(conditions.unique_dirichlet(records))


THIN = f"st AS (SELECT {BLOCKS}, min(density) AS density_min, max(density) AS density_max, sum(density) AS density_sum FROM f GROUP BY 1, 2, 3), thin AS (SELECT * FROM st WHERE density_max >= 0.6 + 1e-6)"


@query(f"WITH {V}, {THIN} SELECT bi, bj, bk, round(density_min, 6) AS density_min, round(density_max, 6) AS density_max, round(density_sum, 6) AS density_sum, false AS has_force FROM thin")
def q13_thin_blocks(spark, sf_dir, field=field):
    return r6(band.thin(field(spark, sf_dir), 0.6), "density_min", "density_max", "density_sum")


@query(f"WITH {V}, {THIN}, t AS (SELECT bi, bj, bk, row_number() OVER (ORDER BY round(density_sum, 9) DESC, bi, bj, bk) AS n FROM st) SELECT bi, bj, bk FROM t WHERE n <= 20")
def q14_densest_blocks(spark, sf_dir, field=field):
    return band.densest(field(spark, sf_dir), 1.0, 20).select(*BLOCK_KEY)


DIAG = offsets_sql("d", DIAGONALS)
FAT = f"{THIN}, {DIAG}, box AS (SELECT DISTINCT {BLOCKS} FROM f), g AS (SELECT f.*, {BLOCKS} FROM f WHERE density > 0.55), s AS (SELECT i + x AS i, j + y AS j, k + z AS k FROM g SEMI JOIN thin USING (bi, bj, bk) CROSS JOIN d), fat AS (SELECT DISTINCT {BLOCKS} FROM s INTERSECT SELECT * FROM box)"
FAT = FAT.replace("FROM g SEMI JOIN thin USING (bi, bj, bk) CROSS JOIN d", "FROM (SELECT * FROM g WHERE (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM thin)) CROSS JOIN d")


def _fat(spark, sf_dir, field=field):
    v = field(spark, sf_dir)
    box = with_block(v).select(*BLOCK_KEY).distinct()
    return v, band.fat(v, band.thin(v, 0.6), box, threshold=0.55), box


@query(f"WITH {V}, {FAT} SELECT bi, bj, bk FROM fat")
def q15_fat_blocks(spark, sf_dir, field=field):
    return _fat(spark, sf_dir, field)[1]


@query(f"""
WITH {V}, {FAT}, {OFF8}, up AS (SELECT DISTINCT bi + x AS bi, bj + y AS bj, bk + z AS bk FROM fat CROSS JOIN o INTERSECT SELECT * FROM box)
SELECT count(*) AS cells, count(*) FILTER (density > 0.5) AS active FROM (SELECT *, {BLOCKS} FROM f) WHERE (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM up)""")
def q16_active_cells(spark, sf_dir, field=field):
    v, fat, box = _fat(spark, sf_dir, field)
    return band.active_counts(v, band.fatter(fat, box), 0.5)


SMOOTH = [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) < 3]
WEIGHTS = offsets_sql("o", SMOOTH, [1.5 - sqrt(sum(x * x for x in o)) for o in SMOOTH])


@query(f"""
WITH {V}, {WEIGHTS}, t AS (SELECT i + x AS i, j + y AS j, k + z AS k, sum(w * -3 * density * density * density) AS v, sum(w) AS w FROM f CROSS JOIN o GROUP BY 1, 2, 3)
SELECT f.i, f.j, f.k, round(v / (t.w * (density + 1e-3)), 6) AS dc0, round(-3 * density * density, 6) AS dc1 FROM f JOIN t ON f.i = t.i AND f.j = t.j AND f.k = t.k""")
def q17_weighted_smoothing(spark, sf_dir, field=field):
    v = field(spark, sf_dir).withColumn("dc0", -3 * F.col("density") * F.col("density"))
    return r6(stencil.smooth(v), "dc0", "dc1")


@query(f"""
WITH {V}, {offsets_sql("o", FACES)}, t AS (SELECT i + x AS i, j + y AS j, k + z AS k, sum(density) AS s FROM f CROSS JOIN o GROUP BY 1, 2, 3)
SELECT round(sqrt(sum((6 * density - coalesce(s, 0)) * (6 * density - coalesce(s, 0)))), 6) AS norm FROM f LEFT JOIN t ON f.i = t.i AND f.j = t.j AND f.k = t.k""")
def q18_laplacian(spark, sf_dir, field=field):
    return r6(stencil.laplacian_norm(field(spark, sf_dir)), "norm")


@query(f"WITH {V} SELECT i // 3 AS i, j // 3 AS j, k // 3 AS k, round(sum(density) / 27, 6) AS density FROM f GROUP BY 1, 2, 3")
def q19_box_mean(spark, sf_dir, field=field):
    return r6(stencil.box_mean(field(spark, sf_dir), 3), "density")


HALVES = offsets_sql("o", grid.AROUND, [0.5 ** sum(map(abs, o)) for o in grid.AROUND])


@query(f"WITH {V}, {HALVES}, m AS (SELECT i + x AS i, j + y AS j, k + z AS k, w * density AS v FROM f CROSS JOIN o) SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, round(sum(v), 6) AS density FROM m WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0 GROUP BY 1, 2, 3")
def q20_restriction(spark, sf_dir, field=field):
    return r6(stencil.restrict(field(spark, sf_dir), "density"), "density")


@query(f"""
WITH {V}, {HALVES}, c AS (SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, sum(density) AS u FROM f GROUP BY 1, 2, 3
), t AS (SELECT 2 * i + x AS i, 2 * j + y AS j, 2 * k + z AS k, sum(w * u) AS u FROM c CROSS JOIN o GROUP BY 1, 2, 3)
SELECT f.i, f.j, f.k, round(density + coalesce(u, 0), 6) AS u FROM f LEFT JOIN t ON f.i = t.i AND f.j = t.j AND f.k = t.k""")
def q21_prolongation(spark, sf_dir, field=field):
    v = field(spark, sf_dir)
    coarse = v.groupBy(*(F.expr(f"{c} div 2").cast("int").alias(c) for c in KEY)).agg(F.sum("density").alias("u"))
    return r6(stencil.prolong(coarse, v.select(*KEY, F.col("density").alias("u"))), "u")


@query(f"WITH {V}, t AS (SELECT *, count(*) OVER (ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS over FROM f) SELECT i, j, k, CASE WHEN over <= 1000 THEN 1.0 ELSE 0.0 END::DOUBLE AS density FROM t".replace("AS over", "AS upto").replace("WHEN over", "WHEN upto"))
def q22_threshold(spark, sf_dir, field=field):
    v = field(spark, sf_dir)
    return search.cut(v, search.threshold_for_volume(v, 1000)).select(*KEY, "density")


@query(f"WITH {V}, b AS (SELECT min(i) AS i0, min(j) AS j0, min(k) AS k0 FROM f WHERE density > 0) SELECT i - i0 AS i, j - j0 AS j, k - k0 AS k, CAST(floor(density * 254) + 1 AS SMALLINT) AS q FROM f, b WHERE density > 0")
def q23_quantize(spark, sf_dir, field=field):
    return stencil.quantized(field(spark, sf_dir))


@query(f"WITH {V}, {offsets_sql('o', FACES)}, c AS (SELECT i, j, k FROM f WHERE density >= 0.5), e AS (SELECT i, j, k, x AS dx, y AS dy, z AS dz FROM c CROSS JOIN o) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.i = e.i + dx AND c.j = e.j + dy AND c.k = e.k + dz)")
def q24_boundary_faces(spark, sf_dir, field=field):
    return stencil.boundary_faces(field(spark, sf_dir), 0.5)


COARSE = "c AS (SELECT DISTINCT i // 2 AS i, j // 2 AS j, k // 2 AS k FROM f WHERE density >= 0.85)"


@query(f"""
WITH RECURSIVE {V}, {COARSE}, {offsets_sql('o', FACES)}, r AS (
  SELECT i, j, k, i AS a, j AS b, k AS c FROM c UNION SELECT c.i, c.j, c.k, r.a, r.b, r.c FROM r CROSS JOIN o JOIN c ON c.i = r.i + x AND c.j = r.j + y AND c.k = r.k + z
), m AS (SELECT i, j, k, min(((CAST(a AS BIGINT) + 1048576) * 2097152 + b + 1048576) * 2097152 + c + 1048576) AS component FROM r GROUP BY 1, 2, 3)
SELECT component, count(*) AS cells, round(count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS fraction FROM m GROUP BY component""")
def q25_components(spark, sf_dir):
    coarse = field(spark, sf_dir).where("density >= 0.85").select(*(F.expr(f"{c} div 2").cast("int").alias(c) for c in KEY)).distinct()
    return r6(components.sizes(components.face_components(coarse)), "fraction")


def displacements(nodes: DataFrame) -> DataFrame:
    i, j, k = (F.col(c).cast("double") for c in KEY)
    return nodes.select(*KEY, (i * j / 100).alias("u0"), (j * k / 50 - i / 40).alias("u1"), (k * k / 80 + i / 90).alias("u2"))


S3 = "0.28867513459481287"
GAUSS = f"""
q(a, b, c) AS (SELECT x.v, y.v, z.v FROM (VALUES (0.5 - {S3}), (0.5 + {S3})) x(v), (VALUES (0.5 - {S3}), (0.5 + {S3})) y(v), (VALUES (0.5 - {S3}), (0.5 + {S3})) z(v)),
ge AS (
  SELECT a, b, c, x, y, z, CAST((2 * x - 1) * (CASE WHEN y = 1 THEN b ELSE 1 - b END) * (CASE WHEN z = 1 THEN c ELSE 1 - c END) AS DOUBLE) AS g0,
    CAST((2 * y - 1) * (CASE WHEN x = 1 THEN a ELSE 1 - a END) * (CASE WHEN z = 1 THEN c ELSE 1 - c END) AS DOUBLE) AS g1,
    CAST((2 * z - 1) * (CASE WHEN x = 1 THEN a ELSE 1 - a END) * (CASE WHEN y = 1 THEN b ELSE 1 - b END) AS DOUBLE) AS g2 FROM q CROSS JOIN o
), gr AS (SELECT a, b, c, x, y, z, g0, g1, g2, p, CASE p WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS gp FROM ge CROSS JOIN (VALUES (0), (1), (2)) t(p)
), m AS (
  SELECT l.x AS x, l.y AS y, l.z AS z, l.p AS p, r.x AS x2, r.y AS y2, r.z AS z2, r.p AS p2,
    sum({MU} * (CASE WHEN l.p = r.p THEN l.g0 * r.g0 + l.g1 * r.g1 + l.g2 * r.g2 ELSE 0 END + (CASE r.p WHEN 0 THEN l.g0 WHEN 1 THEN l.g1 ELSE l.g2 END) * (CASE l.p WHEN 0 THEN r.g0 WHEN 1 THEN r.g1 ELSE r.g2 END)) + {LAM} * l.gp * r.gp) / 8 AS a
  FROM gr l JOIN gr r ON l.a = r.a AND l.b = r.b AND l.c = r.c GROUP BY ALL
)"""
DISP = "CASE p2 WHEN 0 THEN CAST(i + x2 AS DOUBLE) * (j + y2) / 100 WHEN 1 THEN CAST(j + y2 AS DOUBLE) * (k + z2) / 50 - CAST(i + x2 AS DOUBLE) / 40 ELSE CAST(k + z2 AS DOUBLE) * (k + z2) / 80 + CAST(i + x2 AS DOUBLE) / 90 END"


@query(f"""
WITH {V}, {OFF8}, {GAUSS}, e AS (SELECT i + x AS i, j + y AS j, k + z AS k, p, ((1 - 1e-9) * density * density * density + 1e-9) * {DX} * a * ({DISP}) AS v FROM f CROSS JOIN m)
SELECT i, j, k, round(sum(v) FILTER (p = 0), 6) + 0.0 AS f0, round(sum(v) FILTER (p = 1), 6) + 0.0 AS f1, round(sum(v) FILTER (p = 2), 6) + 0.0 AS f2 FROM e GROUP BY 1, 2, 3""")
def q27_stiffness_product(spark, sf_dir):
    v = field(spark, sf_dir).withColumn("scale", elasticity.stiffness(F.col("density")))
    return r6(elasticity.multiply(v, displacements(region.nodes_of(v)), MU, LAM, DX), "f0", "f1", "f2")


@query(f"""
WITH {V}, {OFF8}, {GAUSS}, e AS (SELECT i, j, k, density, sum(a * ({DISP}) * ({DISP.replace('p2', 'p').replace('x2', 'x').replace('y2', 'y').replace('z2', 'z')})) AS s FROM f CROSS JOIN m GROUP BY 1, 2, 3, 4)
SELECT i, j, k, round(density, 6) AS density, round(s * (1e-9 + density * density * density * (1 - 1e-9)), 6) AS part, round(-s * 3 * density * density * (1 - 1e-9), 6) AS dc0 FROM e""")
def q28_compliance(spark, sf_dir):
    v = field(spark, sf_dir)
    return r6(elasticity.compliance(v, displacements(region.nodes_of(v)), MU, LAM), "density", "part", "dc0")


@query(f"""
WITH {V}, r AS (SELECT i, j, k, density, density * sqrt(3 * density * density / 1.5) AS raw FROM f)
SELECT i, j, k, round(least(greatest(least(greatest(raw, density - 0.2), density + 0.2), 0.0), 1.0), 6) AS density FROM r""")
def q29_density_update(spark, sf_dir):
    d = F.col("density")
    return r6(field(spark, sf_dir).select(*KEY, optimize.updated(d, -3 * d * d, F.lit(1.5)).alias("density")), "density")


@query()
def q30_conjugate_gradients(spark, sf_dir):
    """Some steps on the dense cells, halved: fixed at the low end, pulled at the high end."""
    cells = field(spark, sf_dir).groupBy(*(F.expr(f"{c} div 4").cast("int").alias(c) for c in KEY)).agg(F.mean("density").alias("density")).withColumn("scale", elasticity.stiffness(F.col("density")))
    nodes = region.nodes_of(cells)
    forces = conditions.plane_load(nodes, (0.0, -1.0, 0.0), 0, 13)
    out = krylov.solve(cells, forces, conditions.plane_dirichlet(cells, 0, 0), MU, LAM, 1.0, 1e-3, 12)
    return r6(out.nodes, *elasticity.U)


@query()
def q31_volume_update(spark, sf_dir):
    d = F.col("density")
    v = field(spark, sf_dir).withColumn("dc0", -3 * d * d)
    out, _ = optimize.oc_step(v, 0.4 * v.count())
    return r6(out.select(*KEY, "density"), "density")


@query("""
WITH l AS (SELECT CAST(l_quantity AS INT) AS i, CAST(round(l_discount * 100) AS INT) AS j, CAST(round(l_tax * 100) AS INT) AS k, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS p
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL)
SELECT i, j, k, CAST(0 AS DOUBLE) AS fx, round(-arg_max(p, seq * 1e9 + p), 6) AS fy, CAST(0 AS DOUBLE) AS fz FROM l GROUP BY 1, 2, 3""")
def q32_last_force(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").dropna(subset=["l_quantity", "l_discount", "l_tax"])
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1e9 + F.col("l_extendedprice")
    forces = t.select(F.col("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), F.round(F.col("l_tax") * 100).cast("int").alias("k"), seq.alias("seq"), F.lit(0.0).alias("fx"), (-F.col("l_extendedprice")).alias("fy"), F.lit(0.0).alias("fz"))
    return r6(conditions.right_hand_side(forces), "fy")


@query(f"WITH {V}, m AS (SELECT i, j, k FROM f UNION SELECT 51 - i, j, k FROM f) SELECT i, j, max(CASE WHEN k < 4 THEN 1 ELSE 0 END) AS low, count(*) AS n FROM m GROUP BY 1, 2")
def q33_mirrored(spark, sf_dir):
    m = stencil.mirrored(field(spark, sf_dir).select(*KEY), "x", 26)
    return m.groupBy("i", "j").agg(F.max(F.when(F.col("k") < 4, 1).otherwise(0)).alias("low"), F.count("*").alias("n"))


@query(f"WITH {V} SELECT i, j, round(max(density), 6) AS most, round(sum(density), 6) AS total FROM f GROUP BY 1, 2")
def q34_projection(spark, sf_dir):
    return r6(stencil.projection(field(spark, sf_dir)), "most", "total")


@query("SELECT count(o_totalprice) AS n, count(*) FILTER (isnan(o_totalprice)) AS nans, count(*) FILTER (isinf(o_totalprice)) AS infinities, min(o_totalprice) FILTER (isfinite(o_totalprice) AND o_totalprice <> 0) AS least, max(o_totalprice) FILTER (isfinite(o_totalprice) AND o_totalprice <> 0) AS largest FROM orders")
def q35_value_check(spark, sf_dir):
    return predicates.value_check(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice")


@query(f"WITH {V}, c AS (SELECT i, j, k, {FLAGS} AS flags FROM f) SELECT CAST(floor((i - 4) / 2.0) AS INT) + 4 AS i, CAST(floor((j - 4) / 2.0) AS INT) + 4 AS j, CAST(floor((k - 4) / 2.0) AS INT) + 4 AS k, bit_or(flags) AS flags FROM c GROUP BY 1, 2, 3")
def q36_coarse_flags(spark, sf_dir):
    return predicates.coarsen_flags(flagged(field(spark, sf_dir)))


def _centre(c: str) -> str:
    return f"((CAST({c} AS DOUBLE) + 0.5 - 8) * 0.02 - 0.5)"


@query(f"""
WITH {V}, {OFF8}, b AS (SELECT i, j, k FROM f WHERE sqrt(({_centre('i')} + 0.3) * ({_centre('i')} + 0.3) + ({_centre('j')} + 0.6) * ({_centre('j')} + 0.6) + ({_centre('k')} + 0.55) * ({_centre('k')} + 0.55)) <= 0.1 + 0.02)
SELECT DISTINCT i + x AS i, j + y AS j, k + z AS k FROM b CROSS JOIN o""")
def q37_ball_conditions(spark, sf_dir):
    return conditions.ball_dirichlet(field(spark, sf_dir), (-0.3, -0.6, -0.55), 0.1, DX).select(*KEY).distinct()


@query("""
WITH o AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS s FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
), l AS (SELECT *, lag(s, 1) OVER (ORDER BY m) AS s2, lag(s, 2) OVER (ORDER BY m) AS s3, lag(s, 3) OVER (ORDER BY m) AS s4 FROM o)
SELECT m AS month, round(abs((s + s2 - s3 - s4) / (s + s2)), 6) AS ratio FROM l WHERE s4 IS NOT NULL""")
def q38_convergence(spark, sf_dir):
    """The convergence ratio of a series: here the months' order totals; the window's rows are months."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate is not null")
    s = o.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("s"))
    for n in (1, 2, 3):
        s = s.withColumn(f"s{n}", F.expr(f"lag(s, {n}) over (order by month)"))
    return r6(s.where("s3 is not null").select("month", F.abs((F.col("s") + F.col("s1") - F.col("s2") - F.col("s3")) / (F.col("s") + F.col("s1"))).alias("ratio")), "ratio")


@query(f"""
WITH {V}, {THIN}, {DIAG}, box AS (SELECT DISTINCT {BLOCKS} FROM f), own AS (SELECT *, {BLOCKS} FROM f)
SELECT i, j, k, round(CASE WHEN (bi, bj, bk) IN (SELECT (bi, bj, bk) FROM thin) THEN density ELSE 0.0 END, 6) AS density FROM own""")
def q39_solver_density(spark, sf_dir):
    v = field(spark, sf_dir)
    return r6(band.solver_density(v, with_block(v).select(*BLOCK_KEY).distinct(), band.thin(v, 0.6)), "density")


@query(f"WITH {V}, c AS (SELECT i, j, k, {FLAGS} AS flags FROM f) SELECT i, j, k, axis FROM c CROSS JOIN (VALUES (0, 512), (1, 1024), (2, 2048)) b(axis, bit) WHERE flags & bit <> 0")
def q40_dirichlet_list(spark, sf_dir):
    return predicates.dirichlet_list(flagged(field(spark, sf_dir)), grid.DIRICHLET_CELL)
