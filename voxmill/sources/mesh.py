"""Triangle meshes: an OBJ reader, a PLY writer, and joins of triangles with cells by bounding box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.grid import FIXED_DENSITY, KEY, PADDING, to_position
from voxmill.operators.search import ranked

CORNER = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (file, vid, x, y, z), triangles (file, fid, a, b, c)); polygons become fans, indices count from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    parts = lines.select("file", "line", F.split(F.trim("text"), r"\s+").alias("p"))
    number = "row_number() over (partition by file order by line)"
    v = parts.where("p[0] = 'v'").select("file", F.expr(number).cast("long").alias("vid"), *(F.col("p")[n].cast("double").alias(c) for n, c in enumerate("xyz", 1)))
    f = parts.where("p[0] = 'f'").select("file", F.expr(number).cast("long").alias("fid"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: F.split(x, "/")[0].cast("long")).alias("ids"))
    fans = f.select("file", "fid", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)).alias("n"))
    return v, fans.select("file", "fid", F.col("ids")[0].alias("a"), F.col("ids")[F.col("n")].alias("b"), F.col("ids")[F.col("n") + 1].alias("c"))


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(fid, ax..cz): triangles with their corners' coordinates."""
    t = triangles
    for c in "abc":
        v = vertices.select("file", F.col("vid").alias(c), *(F.col(x).alias(f"{c}{x}") for x in "xyz"))
        t = t.join(v, ["file", c])
    return t.select("fid", *CORNER)


def _boxed(tri: DataFrame, dx: float, reach: float, axes: str) -> DataFrame:
    """Adds the least and largest index lo_, hi_ of each triangle's box widened by ``reach``, one to spare, and its level: the box is no longer than 2^level."""
    out = tri
    for c in axes:
        low, high = F.least(*(f"{p}{c}" for p in "abc")) - reach, F.greatest(*(f"{p}{c}" for p in "abc")) + reach
        at = lambda p: (F.floor((p + 0.5) / F.lit(dx)) + PADDING).cast("long")
        out = out.withColumns({f"lo_{c}": at(low) - 1, f"hi_{c}": at(high) + 1})
    longest = F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1 for c in axes), F.lit(1))
    return out.withColumn("level", F.ceil(F.log2(longest.cast("double"))).cast("int"))


def binned(tri: DataFrame, dx: float, reach: float = 0.0, axes: str = "xyz") -> DataFrame:
    """The triangles of ``_boxed`` once for every bin of their own level that their box meets: two along an axis at most, whatever their size."""
    out = _boxed(tri, dx, reach, axes)
    for c in axes:
        out = out.withColumn(f"bin_{c}", F.explode(F.sequence(F.expr(f"shiftright(lo_{c}, level)"), F.expr(f"shiftright(hi_{c}, level)"))))
    return out


def candidates(tri: DataFrame, cells: DataFrame, dx: float, reach: float = 0.0, axes: str = "xyz") -> DataFrame:
    """Triangles with the cells in their boxes, widened by ``reach``: an equi-join on bins of many levels.

    Each triangle is filed under a few bins about as large as itself, each cell under
    the one bin it lies in of every level that some triangle has.
    """
    tri = binned(tri, dx, reach, axes)
    levels = sorted(r[0] for r in tri.select("level").distinct().limit(64).collect())  # one for each bit of an index at most
    own = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")))
    keys = dict(zip("xyz", KEY, strict=True))
    own = own.withColumns({f"bin_{c}": F.expr(f"shiftright(cast({keys[c]} as long), level)") for c in axes})
    near = tri.join(own, ["level", *(f"bin_{c}" for c in axes)])
    for c in axes:
        near = near.where(F.col(keys[c]).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")))
    return near.drop("level", *(f"{n}_{c}" for n in ("lo", "hi", "bin") for c in axes))


def candidate_cells(tri: DataFrame, cells: DataFrame, dx: float, reach: float, centre: float = 0.5) -> DataFrame:
    """``candidates`` with the position px, py, pz of each cell: of its centre, or of its first node with ``centre`` 0."""
    return candidates(tri, cells, dx, reach).withColumns({f"p{c}": to_position(F.col(k) + centre, dx) for c, k in zip("xyz", KEY, strict=True)})


def _v(p: str) -> list[Column]:
    return [F.col(f"{p}{c}") for c in "xyz"]


def _sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normal() -> list[Column]:
    """Unit normal of columns ax..cz; 0 for a degenerate triangle."""
    n = _cross(_sub(_v("b"), _v("a")), _sub(_v("c"), _v("a")))
    size = F.sqrt(_dot(n, n))
    return [F.when(size > 0, x / size).otherwise(0.0) for x in n]


def distance() -> Column:
    """Distance of the point px, py, pz to the triangle ax..cz."""
    p, n = _v("p"), normal()
    inside = F.lit(True)
    edges = []
    for s, e in ("ab", "bc", "ca"):
        edge, to = _sub(_v(e), _v(s)), _sub(p, _v(s))
        inside &= _dot(_cross(edge, to), n) >= 0
        size = _dot(edge, edge)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size > 0, _dot(to, edge) / size).otherwise(0.0)))
        d = _sub(to, [t * x for x in edge])
        edges.append(F.sqrt(_dot(d, d)))
    plane = F.abs(_dot(_sub(p, _v("a")), n))
    return F.when(inside & (_dot(n, n) > 0), plane).otherwise(F.least(*edges))


def normal_force(
    tri: DataFrame, cells: DataFrame, dx: float, reach: float, strength: float = 1.0, centre: tuple[float, float, float] | None = None, falloff: float = 1.0,
    override: tuple[float, float, float] | None = None, no_z: bool = False, wing: bool = False,
) -> DataFrame:
    """(i, j, k, fx, fy, fz): along the summed normals of all triangles within reach of a node that begins a cell.

    The force falls off linearly from a centre; where nothing of it is left there is no
    row. ``override`` stands for every direction, ``no_z`` leaves out directions along the third
    axis. A wing has a law of its own instead of a strength: against the direction, by its
    second part on the upper surface, by 0.4 through it on the lower one, none at the edges.
    """
    near = candidate_cells(tri, cells.select(*KEY), dx, reach, centre=0.0).where(distance() <= reach)
    weight = F.lit(1.0)
    if centre:
        d = [to_position(F.col(k), dx) - c for k, c in zip(KEY, centre, strict=True)]
        weight = F.greatest(F.lit(0.0), 1 - F.sqrt(_dot(d, d)) / falloff)
    n = near.select(*KEY, *(c.alias(f"n{x}") for c, x in zip(normal(), "xyz", strict=True))).groupBy(*KEY).agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"))
    square = _dot(_v("n"), _v("n"))
    n = n.withColumn("weight", weight).where((F.col("weight") > 0) & (square >= 1e-6))
    unit = [F.lit(float(x)) for x in override] if override and any(override) else [x / F.sqrt(square) for x in _v("n")]
    n = n.select(*KEY, "weight", *(x.alias(f"n{c}") for x, c in zip(unit, "xyz", strict=True)))
    if wing:
        share = F.when(F.col("ny") > 0, -F.col("ny")).otherwise(-0.4 / F.col("ny"))
        n = n.where(F.abs("ny") > 0.05)
    else:
        share = F.lit(float(strength))
        n = n.where(F.abs("nz") < 0.99) if no_z else n
    return n.select(*KEY, *((x * share * F.col("weight")).alias(f"f{c}") for x, c in zip(_v("n"), "xyz", strict=True)))


def shell(tri: DataFrame, cells: DataFrame, dx: float, reach: float) -> DataFrame:
    """The cells with the density of those within reach of a triangle fixed (in ``flags``)."""
    near = candidate_cells(tri, cells.select(*KEY), dx, reach).where(distance() <= reach).select(*KEY).distinct().withColumn("_on", F.lit(FIXED_DENSITY).cast("long"))
    return cells.join(near, KEY, "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_on", F.lit(0).cast("long")))).drop("_on")


def inside(tri: DataFrame, cells: DataFrame, dx: float) -> DataFrame:
    """The cells whose centre lies inside the closed mesh: an odd number of triangles above it."""
    flat = tri.withColumns({"low": F.least("az", "bz", "cz"), "high": F.greatest("az", "bz", "cz")})
    # a hair off the centre, so that no edge of a triangle is met
    columns = cells.select("i", "j").distinct().withColumns({"px": to_position(F.col("i") + 0.5, dx) + dx * 1.1e-7, "py": to_position(F.col("j") + 0.5, dx) + dx * 2.3e-7})
    hit = candidates(flat, columns, dx, axes="xy")
    x, y = F.col("px"), F.col("py")
    area = lambda a, b: (F.col(f"{b}x") - F.col(f"{a}x")) * (y - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (x - F.col(f"{a}x"))
    w = {"c": area("a", "b"), "a": area("b", "c"), "b": area("c", "a")}
    all_ = w["a"] + w["b"] + w["c"]
    in_ = (F.least(*w.values()) > 0) | (F.greatest(*w.values()) < 0)
    z = sum((w[p] * F.col(f"{p}z") for p in "bc"), w["a"] * F.col("az")) / all_
    crossings = hit.where(in_).select("i", "j", z.alias("z")).groupBy("i", "j").agg(F.sort_array(F.collect_list("z")).alias("zs"))  # a column's crossings
    at = to_position(F.col("k") + 0.5, dx)
    return cells.join(crossings, ["i", "j"]).where(F.size(F.filter("zs", lambda v: v > at)) % 2 == 1).drop("zs")


def _surface_lines(quads: DataFrame, spots: list[Column]) -> DataFrame:
    """(part, n, line) of quads numbered by f, whose corners' coordinates are ``spots`` as text; two triangles a quad."""
    total = quads.agg(F.count("*").alias("c"))
    header = ["ply", "format ascii 1.0", "element vertex {v}", "property float x", "property float y", "property float z", "element face {f}", "property list uchar int vertex_index", "end_header"]
    text = F.array(*(F.replace(F.replace(F.lit(h), F.lit("{v}"), (F.col("c") * 4).cast("string")), F.lit("{f}"), (F.col("c") * 2).cast("string")) for h in header))
    head = total.select(F.lit(0).alias("part"), F.posexplode(text).alias("n", "line"))
    vertices = quads.select(F.lit(1).alias("part"), "f", F.posexplode(F.array(*spots)).alias("m", "line")).select("part", (F.col("f") * 4 + F.col("m")).alias("n"), "line")
    tri = [F.concat(F.lit("3 "), F.concat_ws(" ", *((F.col("f") * 4 + o).cast("string") for o in t))) for t in ((0, 1, 2), (0, 2, 3))]
    sides = quads.select(F.lit(2).alias("part"), "f", F.posexplode(F.array(*tri)).alias("m", "line")).select("part", (F.col("f") * 2 + F.col("m")).alias("n"), "line")
    return head.unionByName(vertices).unionByName(sides)


def ply_lines(faces: DataFrame, dx: float = 1.0) -> DataFrame:
    """(part, n, line): the text of a PLY surface of boundary faces (i, j, k, dx, dy, dz), two triangles a face.

    Each face has its own four corners, so a face's number gives its vertices' numbers.
    """
    f = ranked(faces, "i", "j", "k", "dx", "dy", "dz", name="f")
    axis = F.when(F.col("dx") != 0, 0).when(F.col("dy") != 0, 1).otherwise(2)
    side = F.when(F.col("dx") + F.col("dy") + F.col("dz") > 0, 1).otherwise(0)
    spots = []
    for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
        at = [F.when(axis == c, side).when(axis == (c + 2) % 3, a).otherwise(b) for c in range(3)]
        spots.append(F.concat_ws(" ", *(((F.col(k) + x) * dx).cast("string") for k, x in zip(KEY, at, strict=True))))
    return _surface_lines(f, spots)


def quad_lines(quads: DataFrame) -> DataFrame:
    """(part, n, line): the text of a PLY surface of quads as loft gives them."""
    f = ranked(quads, "surface", "n", "step", name="f")
    return _surface_lines(f, [F.concat_ws(" ", *(F.col(f"{p}{c}").cast("string") for c in "xyz")) for p in "abcd"])


def wing_profile(spark: SparkSession, path: str) -> DataFrame:
    """(n, x, y): the points of a profile's outline, from text that holds their number, all x and all y."""
    words = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    many = F.element_at("w", 1).cast("int")
    points = words.select(F.posexplode(F.slice("w", F.lit(2), many)).alias("n", "x"), "w")
    return points.select("n", F.col("x").cast("double").alias("x"), F.element_at("w", F.col("n") + many + 2).cast("double").alias("y"))


def loft(profile: DataFrame, near: tuple[float, float] = (0.34, -0.4), far: tuple[float, float] = (0.4, 0.4), steps: int = 20) -> DataFrame:
    """(surface, n, step, ax..dz): quads of a wing whose outline is scaled along z, from (scale, z) near to far, with a cap on either end.

    Each edge of the closed outline gives a strip of quads along the wing, and from
    the outline's mean point a strip on either cap.
    """
    mean = profile.agg(F.count("*").alias("many"), F.avg("x").alias("mx"), F.avg("y").alias("my"))  # a single row
    points = profile.join(F.broadcast(mean))
    follower = points.select(F.expr("pmod(n - 1, many)").cast("int").alias("n"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    edges = points.join(follower, "n").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    u, v = F.col("step") / steps, (F.col("step") + 1) / steps

    def between(t: Column, a: Column | float, b: Column | float) -> Column:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return a * (1 - t) + b * t

    def quads(name: str, corners: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
        named = [(value).alias(f"{p}{c}") for p, (x, y, scale, z) in zip("abcd", corners, strict=True) for c, value in zip("xyz", (x * scale, y * scale, z), strict=True)]
        return edges.select(F.lit(name).alias("surface"), "n", "step", *named)

    here, there = (F.col("x"), F.col("y")), (F.col("x1"), F.col("y1"))
    along = [(between(t, near[0], far[0]), between(t, near[1], far[1])) for t in (u, v)]
    parts = [quads("side", [(*here, *along[0]), (*there, *along[0]), (*there, *along[1]), (*here, *along[1])])]
    for name, end in (("near", near), ("far", far)):
        inner, outer = ([(between(t, F.col("mx"), p[0]), between(t, F.col("my"), p[1])) for p in (here, there)] for t in (u, v))
        parts.append(quads(name, [(*p, F.lit(end[0]), F.lit(end[1])) for p in (inner[0], inner[1], outer[1], outer[0])]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_ply(faces: DataFrame, path: str, dx: float = 1.0) -> None:
    """A folder of text files that make the surface one after the other, by name; no task writes all of it."""
    ply_lines(faces, dx).orderBy("part", "n").select("line").write.mode("overwrite").text(path)
