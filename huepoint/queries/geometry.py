"""Frames, crops and alignment."""

from pyspark.sql import functions as F

from huepoint.operators import geometry as G
from huepoint.operators import mesh, nn
from huepoint.plans import completion
from huepoint.queries._registry import query, r6, six
from huepoint.views import CLOUD, FACES, cloud, faces, split

XYZ = ("x", "y", "z")
VIEW = completion.VIEWPOINT

UNIT = f"""{CLOUD}, cen AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM cloud WINDOW w AS (PARTITION BY object_id)),
unit AS (SELECT * EXCLUDE (cx, cy, cz), cx / s AS ux, cy / s AS uy, cz / s AS uz FROM (SELECT *, max(sqrt(cx*cx + cy*cy + cz*cz)) OVER (PARTITION BY object_id) + 1e-12 AS s FROM cen))"""


def crop_sql(ratio: str, view=VIEW, name: str = "crop", keys: str = "object_id", source: str = "unit") -> str:
    """CTE {name}: ``unit`` rows with crop_rank and is_missing."""
    n = sum(v * v for v in view) ** 0.5
    d = " + ".join(f"power(u{c} - ({v!r}::DOUBLE / {n!r}::DOUBLE), 2)" for c, v in zip(XYZ, view))
    return f"""{name}_d AS (SELECT *, {d} AS cd FROM {source}),
{name} AS (SELECT *, crop_rank <= round_even(n_all * {ratio}, 0) AS is_missing FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cd, point_id) AS crop_rank, count(*) OVER (PARTITION BY {keys}) AS n_all FROM {name}_d))"""


@query("centroid", f"WITH {CLOUD} SELECT object_id, {r6('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')} FROM cloud GROUP BY object_id")
def centroid(spark, sf_dir):
    return six(cloud(spark, sf_dir).groupBy("object_id").agg(*[F.avg(c).alias(c) for c in XYZ]))


@query("unit_sphere", f"WITH {UNIT} SELECT point_id, {r6('ux AS x', 'uy AS y', 'uz AS z')} FROM unit")
def unit_sphere(spark, sf_dir):
    return six(G.unit_sphere(cloud(spark, sf_dir)).select("point_id", *XYZ))


@query(
    "rms_normalise",
    f"""WITH {UNIT}, s AS (SELECT *, sqrt(avg(cx*cx + cy*cy + cz*cz) OVER (PARTITION BY object_id)) AS s FROM cen)
    SELECT point_id, {r6('cx / s AS x', 'cy / s AS y', 'cz / s AS z')} FROM s""",
)
def rms_normalise(spark, sf_dir):
    return six(G.rms_normalised(cloud(spark, sf_dir)).select("point_id", *XYZ))


@query(
    "partial_frame",
    f"""WITH {CLOUD}, m AS (SELECT object_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud WHERE part <> 3 GROUP BY object_id),
    c AS (SELECT point_id, object_id, part, x - mx AS x, y - my AS y, z - mz AS z FROM cloud JOIN m USING (object_id)),
    s AS (SELECT object_id, max(sqrt(x*x + y*y + z*z)) + 1e-9 AS s FROM c WHERE part <> 3 GROUP BY object_id)
    SELECT point_id, {r6('x / s AS x', 'y / s AS y', 'z / s AS z')} FROM c JOIN s USING (object_id)""",
)
def partial_frame(spark, sf_dir):
    return six(G.partial_frame(cloud(spark, sf_dir), F.col("part") != 3).select("point_id", *XYZ))


@query("viewpoint_crop", f"WITH {UNIT}, {crop_sql('0.5')} SELECT point_id, object_id, is_missing, {r6('x', 'y', 'z')} FROM crop")
def viewpoint_crop(spark, sf_dir):
    return six(G.crop(cloud(spark, sf_dir), VIEW, 0.5).select("point_id", "object_id", "is_missing", *XYZ))


@query("crop_rank", f"WITH {UNIT}, {crop_sql('0.25', (1.0, 0.0, 0.0))} SELECT point_id, crop_rank FROM crop")
def crop_rank(spark, sf_dir):
    return six(G.crop(cloud(spark, sf_dir), (1.0, 0.0, 0.0), 0.25).select("point_id", "crop_rank"))


@query("crop_zero_pad", f"WITH {UNIT}, {crop_sql('0.25')} SELECT point_id, {r6('CASE WHEN is_missing THEN 0 ELSE x END AS x', 'CASE WHEN is_missing THEN 0 ELSE y END AS y', 'CASE WHEN is_missing THEN 0 ELSE z END AS z')} FROM crop")
def crop_zero_pad(spark, sf_dir):
    return six(G.zero_padded(G.crop(cloud(spark, sf_dir), VIEW, 0.25)).select("point_id", *XYZ))


@query(
    "crop_difficulty_sweep",
    f"""WITH {UNIT}, g AS (SELECT * FROM unit, (VALUES ('simple', 0.25), ('moderate', 0.5), ('hard', 0.75)) d(difficulty, ratio), (VALUES (0, 0.15, 0.55, -1.0), (1, 1.0, 0.0, 0.2)) v(view, vx, vy, vz)),
    d AS (SELECT *, sqrt(vx::DOUBLE*vx + vy::DOUBLE*vy + vz::DOUBLE*vz) AS vn FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_id, difficulty, view ORDER BY power(ux - vx / vn, 2) + power(uy - vy / vn, 2) + power(uz - vz / vn, 2), point_id) AS k, count(*) OVER (PARTITION BY object_id, difficulty, view) AS n FROM d)
    SELECT object_id, difficulty, view::BIGINT AS view, {r6('any_value(ratio) AS crop_ratio')}, sum(CASE WHEN k <= round_even(n * ratio, 0) THEN 0 ELSE 1 END)::BIGINT AS n_partial, sum(CASE WHEN k <= round_even(n * ratio, 0) THEN 1 ELSE 0 END)::BIGINT AS n_missing
    FROM r GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY object_id, difficulty, view"),
)
def crop_difficulty_sweep(spark, sf_dir):
    return six(completion.manifest(G.sweep(cloud(spark, sf_dir), (VIEW, (1.0, 0.0, 0.2)))))


@query("bbox_diagonal", f"WITH {CLOUD} SELECT object_id, {r6('sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS diagonal')} FROM cloud GROUP BY object_id")
def bbox_diagonal(spark, sf_dir):
    return six(G.bounding_diagonal(cloud(spark, sf_dir)))


_FRAMES = ", ".join(f"({i}, {str(G.is_reflection(p, s)).upper()}, {', '.join(str(s[j] if p[j] == c else 0) for j in range(3) for c in range(3))})" for i, (p, s) in enumerate(G.signed_permutations()))
_ALIGN = f"""{CLOUD}, rc AS (SELECT object_id, point_id, point_id % 2 AS odd, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM cloud WINDOW w AS (PARTITION BY object_id, point_id % 2)),
rn AS (SELECT object_id, point_id, odd, cx / s AS x, cy / s AS y, cz / s AS z FROM (SELECT *, sqrt(avg(cx*cx + cy*cy + cz*cz) OVER (PARTITION BY object_id, odd)) AS s FROM rc)),
fr(frame, reflection, a00, a01, a02, a10, a11, a12, a20, a21, a22) AS (VALUES {_FRAMES}),
mv AS (SELECT object_id, frame, reflection, point_id, a00*x + a01*y + a02*z AS x, a10*x + a11*y + a12*z AS y, a20*x + a21*y + a22*z AS z FROM rn, fr WHERE odd = 1),
pr AS (SELECT m.object_id, frame, reflection, m.point_id AS p, r.point_id AS q, power(m.x - r.x, 2) + power(m.y - r.y, 2) + power(m.z - r.z, 2) AS d2 FROM mv m JOIN rn r ON m.object_id = r.object_id AND r.odd = 0),
f1 AS (SELECT object_id, frame, avg(d) AS m FROM (SELECT object_id, frame, p, sqrt(min(d2)) AS d FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 2),
f2 AS (SELECT object_id, frame, avg(d) AS m FROM (SELECT object_id, frame, q, sqrt(min(d2)) AS d FROM pr GROUP BY 1, 2, 3) GROUP BY 1, 2),
al AS (SELECT f1.object_id, frame, reflection, f1.m + f2.m AS chamfer, row_number() OVER (PARTITION BY f1.object_id ORDER BY f1.m + f2.m, frame) AS frame_rank FROM f1 JOIN f2 USING (object_id, frame) JOIN fr USING (frame))"""


def _alignment(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return G.alignment(qry, ref)


@query("signed_perm_search", f"WITH {_ALIGN} SELECT object_id, frame::BIGINT AS frame, reflection, {r6('chamfer')} FROM al")
def signed_perm_search(spark, sf_dir):
    return six(_alignment(spark, sf_dir).drop("frame_rank"))


@query(
    "alignment_verdict",
    f"""WITH {_ALIGN} SELECT b.object_id, {r6('b.chamfer AS best', 's.chamfer / greatest(b.chamfer, 1e-12) AS margin')}, CASE WHEN b.chamfer < 0.15 AND s.chamfer / greatest(b.chamfer, 1e-12) > 1.3 THEN 'locked' ELSE 'weak' END AS verdict
    FROM al b JOIN al s ON b.object_id = s.object_id AND b.frame_rank = 1 AND s.frame_rank = 2""",
)
def alignment_verdict(spark, sf_dir):
    return six(G.alignment_verdict(_alignment(spark, sf_dir)).drop("frame"))


@query(
    "frame_verdict",
    f"""WITH {_ALIGN}, m AS (SELECT frame, avg(chamfer) AS mean FROM al WHERE object_id % 2 = 0 GROUP BY frame), r AS (SELECT mean AS ref FROM m WHERE frame = 0), b AS (SELECT min(mean) AS mean FROM m)
    SELECT {r6('mean', 'ref')}, CASE WHEN mean < 0.6 * ref THEN 'ok' WHEN mean < ref THEN 'weak' ELSE 'broken' END AS verdict FROM b, r""",
)
def frame_verdict(spark, sf_dir):
    return six(G.frame_verdict(_alignment(spark, sf_dir), F.col("object_id") % 2 == 0).drop("frame"))


@query(
    "dedupe_faces",
    f"""WITH {FACES} SELECT object_id, face_id, (row_number() OVER (PARTITION BY object_id, list_sort([v0, v1, v2]) ORDER BY quality DESC, face_id) > 1) OR quality < 2000 AS drop_face FROM faces""",
)
def dedupe_faces(spark, sf_dir):
    return G.duplicate_faces(faces(spark, sf_dir), 2000.0).select("object_id", "face_id", F.col("drop").alias("drop_face"))


@query("reconciled_faces")
def reconciled_faces(spark, sf_dir):
    f = faces(spark, sf_dir)
    return G.reconciled(f, f.filter("quality > 3000"))


_TRI = f"""{CLOUD}, tri AS (SELECT object_id, point_id AS face_id, x AS ax, y AS ay, z AS az, lead(x, 1) OVER w AS bx, lead(y, 1) OVER w AS by_, lead(z, 1) OVER w AS bz, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(z, 2) OVER w AS cz
  FROM cloud WHERE point_id % 4 = 0 WINDOW w AS (PARTITION BY object_id ORDER BY point_id))"""


def triangles(spark, sf_dir):
    """Triangles over every fourth point and the two after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_id").orderBy("point_id")
    c = cloud(spark, sf_dir).filter("point_id % 4 = 0")
    return c.select("object_id", F.col("point_id").alias("face_id"), *[F.col(x).alias(f"a{x}") for x in XYZ], *[F.lead(x, 1).over(w).alias(f"b{x}") for x in XYZ], *[F.lead(x, 2).over(w).alias(f"c{x}") for x in XYZ]).dropna()


def _dot(u, v):
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(u, v)) + ")"


def _to_edge(s, e):
    """Distance of p to an edge."""
    d, w = ([f"({x} - {y})" for x, y in zip(a, b)] for a, b in ((e, s), (_P, s)))
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce({_dot(w, d)} / nullif({_dot(d, d)}, 0), 0)))"
    r = [f"({x} - {t} * {y})" for x, y in zip(w, d)]
    return f"sqrt({_dot(r, r)})"


_P, _A, _B, _C = ("x", "y", "z"), ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")
_SURFACE = f"""{_TRI}, fu AS (SELECT c.object_id, c.point_id, c.x, c.y, c.z, t.* EXCLUDE (object_id), bx - ax AS u1, by_ - ay AS u2, bz - az AS u3, cx - ax AS v1, cy - ay AS v2, cz - az AS v3, x - ax AS w1, y - ay AS w2, z - az AS w3 FROM cloud c JOIN tri t USING (object_id) WHERE cx IS NOT NULL),
  fd AS (SELECT *, u2 * v3 - u3 * v2 AS n1, u3 * v1 - u1 * v3 AS n2, u1 * v2 - u2 * v1 AS n3, u1*u1 + u2*u2 + u3*u3 AS uu, u1*v1 + u2*v2 + u3*v3 AS uv, v1*v1 + v2*v2 + v3*v3 AS vv, w1*u1 + w2*u2 + w3*u3 AS wu, w1*v1 + w2*v2 + w3*v3 AS wv, (vv * wu - uv * wv) / nullif(uu * vv - uv * uv, 0) AS s, (uu * wv - uv * wu) / nullif(uu * vv - uv * uv, 0) AS t FROM fu),
  su AS (SELECT object_id, point_id, face_id, CASE WHEN s >= 0 AND t >= 0 AND s + t <= 1 THEN abs(w1 * n1 + w2 * n2 + w3 * n3) / sqrt(n1 * n1 + n2 * n2 + n3 * n3) ELSE least({_to_edge(_A, _B)}, {_to_edge(_B, _C)}, {_to_edge(_C, _A)}) END AS d FROM fd QUALIFY row_number() OVER (PARTITION BY object_id, point_id ORDER BY d, face_id) = 1)"""


@query("point_to_surface", f"WITH {_SURFACE} SELECT object_id, point_id, face_id, {r6('d')} FROM su")
def point_to_surface(spark, sf_dir):
    return six(nn.to_surface(cloud(spark, sf_dir), triangles(spark, sf_dir)))


_U = lambda name: f"('0x' || substr(md5(concat_ws(':', '0', object_id, i, '{name}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SAMPLES = f"""{_TRI}, fa AS (SELECT *, sqrt(power((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + power((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + power((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) / 2 AS area FROM tri WHERE cx IS NOT NULL),
  fs AS (SELECT *, sum(area) OVER (PARTITION BY object_id ORDER BY face_id) AS after FROM fa), ft AS (SELECT object_id, max(after) AS total FROM fs GROUP BY 1),
  dr AS (SELECT object_id, i, {_U('face')} * total AS spot, {_U('u')} AS u, {_U('v')} AS v FROM ft, range(64) r(i)),
  sm AS (SELECT object_id, i AS point_id, face_id, CASE WHEN u + v > 1 THEN 1 - u ELSE u END AS wb, CASE WHEN u + v > 1 THEN 1 - v ELSE v END AS wc, 1 - wb - wc AS wa, ax, ay, az, bx, by_, bz, cx, cy, cz FROM dr JOIN fs USING (object_id) WHERE spot >= after - area AND spot < after)"""


@query("surface_samples", f"WITH {_SAMPLES} SELECT object_id, point_id, face_id, {r6('wa AS w_a', 'wb AS w_b', 'wc AS w_c', 'wa * ax + wb * bx + wc * cx AS x', 'wa * ay + wb * by_ + wc * cy AS y', 'wa * az + wb * bz + wc * cz AS z')} FROM sm")
def surface_samples(spark, sf_dir):
    return six(mesh.surface_samples(triangles(spark, sf_dir), 64))


_TEXTURE = 16  # texels of a side


def texture(spark, sf_dir):
    """A texture for each object: texel (column, row) has the colour of the point at this place, beginning anew after the last."""
    side = F.lit(_TEXTURE)
    c = cloud(spark, sf_dir)
    n = c.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first"))
    at = n.withColumn("at", F.explode(F.sequence(F.lit(0), side * side - 1)))
    at = at.select(F.col("object_id"), (F.col("first") + F.col("at") % F.col("n")).alias("point_id"), (F.col("at") % side).cast("int").alias("column"), F.floor(F.col("at") / side).cast("int").alias("row"))
    return at.join(c.select("object_id", "point_id", "r", "g", "b"), ["object_id", "point_id"]).select(F.concat(F.lit("t"), F.col("object_id").cast("string")).alias("texture"), side.alias("width"), side.alias("height"), "column", "row", "r", "g", "b")


@query(
    "textured_samples",
    f"""WITH {_SAMPLES}, uv AS (SELECT s.object_id, s.point_id, s.face_id, wa * ac.r + wb * bc.r + wc * cc.r AS u, wa * ac.g + wb * bc.g + wc * cc.g AS v, ac.part FROM sm s
      JOIN cloud ac ON ac.point_id = face_id JOIN cloud bc ON bc.point_id = face_id + 4 JOIN cloud cc ON cc.point_id = face_id + 8),
    tx AS (SELECT *, least(floor((u % 1.0) * {_TEXTURE})::BIGINT, {_TEXTURE - 1}) AS col, least(floor((1 - v % 1.0) * {_TEXTURE})::BIGINT, {_TEXTURE - 1}) AS row_ FROM uv),
    n AS (SELECT object_id, count(*) AS n, min(point_id) AS first_ FROM cloud GROUP BY 1)
    SELECT t.object_id, t.point_id, CASE WHEN t.face_id % 8 = 0 THEN t.part::VARCHAR ELSE 'other' END AS part, {r6('c.r AS r', 'c.g AS g', 'c.b AS b')} FROM tx t JOIN n USING (object_id) JOIN cloud c ON c.point_id = first_ + (col + {_TEXTURE} * row_) % n""",
)
def textured_samples(spark, sf_dir):
    """Samples of each mesh with the colours of its texture and the parts of its faces' masks (every second face has one)."""
    c, t = cloud(spark, sf_dir), triangles(spark, sf_dir)
    s = mesh.surface_samples(t, 64)
    corner = lambda p, step: c.select("object_id", (F.col("point_id") - step).alias("face_id"), F.col("r").alias(f"{p}u"), F.col("g").alias(f"{p}v"))
    faces = t.select("object_id", "face_id")
    for p, step in (("a", 0), ("b", 4), ("c", 8)):
        faces = faces.join(corner(p, step), ["object_id", "face_id"])
    uv = mesh.with_corners(s, faces, ("u", "v")).withColumn("texture", F.concat(F.lit("t"), F.col("object_id").cast("string")))
    masks = c.filter("point_id % 8 = 0").select("object_id", F.col("point_id").alias("face"), F.col("part").cast("string").alias("part"))
    return six(mesh.labelled(mesh.textured(uv, texture(spark, sf_dir)), masks).select("object_id", "point_id", "part", "r", "g", "b"))


@query(
    "relative_edges",
    f"""WITH {CLOUD}, e AS (SELECT q.object_id, q.point_id AS q_id, n.point_id AS n_id, n.x - q.x AS dx, n.y - q.y AS dy, n.z - q.z AS dz FROM cloud q JOIN cloud n ON q.object_id = n.object_id AND q.point_id <> n.point_id),
    k AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS len FROM e QUALIFY row_number() OVER (PARTITION BY object_id, q_id ORDER BY dx*dx + dy*dy + dz*dz, n_id) <= 4),
    s AS (SELECT *, avg(len) OVER (PARTITION BY object_id) AS scale FROM k)
    SELECT object_id, q_id, n_id, {r6('dx / scale AS dx', 'dy / scale AS dy', 'dz / scale AS dz', 'len / scale AS length')} FROM s""",
)
def relative_edges(spark, sf_dir):
    return six(G.relative_edges(cloud(spark, sf_dir), 4).drop("rank"))


_N = lambda i: "sqrt(-2 * ln(1 - {})) * cos(2 * pi() * {})".format(*(f"('0x' || substr(md5(concat_ws(':', '0', object_id, difficulty, view, {j})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE" for j in (2 * i, 2 * i + 1)))


@query(
    "seeded_crop_sweep",
    f"""WITH {UNIT}, g AS (SELECT *, {_N(0)} AS vx, {_N(1)} AS vy, {_N(2)} AS vz FROM unit, (VALUES ('simple', 0.25), ('moderate', 0.5), ('hard', 0.75)) d(difficulty, ratio), range(2) v(view)),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_id, difficulty, view ORDER BY power(ux - vx / sqrt(vx * vx + vy * vy + vz * vz), 2) + power(uy - vy / sqrt(vx * vx + vy * vy + vz * vz), 2) + power(uz - vz / sqrt(vx * vx + vy * vy + vz * vz), 2), point_id) AS k, count(*) OVER (PARTITION BY object_id, difficulty, view) AS n FROM g)
    SELECT object_id, difficulty, view, point_id FROM r WHERE k <= round_even(n * ratio, 0)""",
)
def seeded_crop_sweep(spark, sf_dir):
    return G.seeded_sweep(cloud(spark, sf_dir), 2).filter("is_missing").select("object_id", "difficulty", F.col("view").cast("long").alias("view"), "point_id")


@query(
    "aligned_label_transfer",
    f"""WITH {_ALIGN}, b AS (SELECT object_id, frame, reflection, chamfer FROM al WHERE frame_rank = 1),
    e AS (SELECT pr.object_id, q, p, chamfer, b.reflection, row_number() OVER (PARTITION BY pr.object_id, q ORDER BY d2, p) AS k FROM pr JOIN b ON pr.object_id = b.object_id AND pr.frame = b.frame)
    SELECT e.object_id, q AS point_id, c.part AS part, {r6('chamfer AS residual')}, reflection FROM e JOIN cloud c ON c.object_id = e.object_id AND c.point_id = p WHERE k = 1""",
)
def aligned_label_transfer(spark, sf_dir):
    ref, qry = split(spark, sf_dir)
    return six(G.transferred(qry, ref, _alignment(spark, sf_dir)))


_V = lambda i: "sqrt(-2 * ln(1 - {})) * cos(2 * pi() * {})".format(*(f"('0x' || substr(md5(concat_ws(':', '0', object_id, {j})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE" for j in (2 * i, 2 * i + 1)))


@query(
    "dense_crop_same_view",
    f"""WITH {CLOUD}, both_ AS (SELECT *, 'dense' AS resolution FROM cloud UNION ALL SELECT *, 'sparse' FROM ref),
    cen AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy, z - avg(z) OVER w AS cz FROM both_ WINDOW w AS (PARTITION BY object_id, resolution)),
    u AS (SELECT object_id, resolution, point_id, cx / s AS ux, cy / s AS uy, cz / s AS uz, {_V(0)} AS vx, {_V(1)} AS vy, {_V(2)} AS vz FROM (SELECT *, max(sqrt(cx*cx + cy*cy + cz*cz)) OVER (PARTITION BY object_id, resolution) + 1e-12 AS s FROM cen)),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_id, resolution ORDER BY power(ux - vx / sqrt(vx * vx + vy * vy + vz * vz), 2) + power(uy - vy / sqrt(vx * vx + vy * vy + vz * vz), 2) + power(uz - vz / sqrt(vx * vx + vy * vy + vz * vz), 2), point_id) AS k, count(*) OVER (PARTITION BY object_id, resolution) AS n FROM u)
    SELECT object_id, resolution, point_id FROM r WHERE k <= round_even(n * 0.5, 0)""",
)
def dense_crop_same_view(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return G.same_view((("dense", c), ("sparse", c.filter("point_id % 2 = 0"))), 0.5).filter("is_missing").select("object_id", "resolution", "point_id")


@query("inpainting_input", f"WITH {UNIT.replace('1e-12', '1e-9')}, k AS (SELECT *, point_id % 2 = 0 AND part <> 2 AS known FROM unit) SELECT object_id, point_id, known, {r6('ux AS x', 'uy AS y', 'uz AS z', *(f'CASE WHEN known THEN {c} ELSE 0 END AS {c}' for c in 'rgb'))} FROM k")
def inpainting_input(spark, sf_dir):
    return six(G.inpainting_input(*split(spark, sf_dir), drop_part=2).select("object_id", "point_id", "known", *XYZ, "r", "g", "b"))
