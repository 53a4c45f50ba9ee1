"""Formats: JSON fields, text points, and round trips of binary clouds."""

from pyspark.sql import functions as F

from huepoint.queries._registry import query, r6, six
from huepoint.sources import arrays, loaders, ply, registry, sinks, textual
from huepoint.store import shared_folder
from huepoint.views import CLOUD, EVAL, cloud, eval_rows, table


@query("json_path", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    return textual.json_fields(table(spark, sf_dir, "events"), "props", "k bigint").select("event_id", "k")


@query("text_points", f"WITH {CLOUD} SELECT point_id, {r6('round(x, 4) AS x', 'round(y, 4) AS y', 'round(z, 4) AS z')}, CASE WHEN part < 2 THEN part ELSE 0 END AS part FROM cloud")
def text_points(spark, sf_dir):
    """Points written as lines of x y z nx ny nz with a label for some, and read again."""
    c = cloud(spark, sf_dir)
    words = [*[F.format_string("%.4f", F.round(c_, 4)) for c_ in ("x", "y", "z")], F.lit("0 0  1"), F.when(F.col("part") < 2, F.col("part").cast("string"))]
    lines = c.select("object_id", F.col("point_id").alias("line_no"), F.concat_ws(" ", *words).alias("value"))
    return six(textual.part_points(lines).drop("object_id"))


@query("obj_faces", "SELECT (o_orderkey % 10)::BIGINT AS object_id, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) - 1 AS face_id, (o_orderkey % 97)::BIGINT AS v0, (o_custkey % 89)::BIGINT AS v1, (o_orderkey % 83)::BIGINT AS v2 FROM orders")
def obj_faces(spark, sf_dir):
    v = lambda c, n: (F.col(c) % n + 1).cast("string")
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).cast("long").alias("object_id"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("f "), v("o_orderkey", 97), F.lit("/1/2 "), v("o_custkey", 89), F.lit("/3 "), v("o_orderkey", 83)).alias("value"))
    return six(textual.obj_faces(o))


@query("best_flags", f"WITH {EVAL}, m AS (SELECT difficulty, avg(metric) FILTER (method = 'A') AS a, avg(metric) FILTER (method = 'N') AS n, avg(metric) FILTER (method = 'R') AS r FROM ev GROUP BY 1) SELECT difficulty, a <= least(a, n, r) + 1e-9 AS best_a, n <= least(a, n, r) + 1e-9 AS best_n, r <= least(a, n, r) + 1e-9 AS best_r FROM m")
def best_flags(spark, sf_dir):
    by = lambda m: F.avg(F.when(F.col("method") == m, F.col("metric")))
    m = eval_rows(spark, sf_dir).groupBy("difficulty").agg(by("A").alias("a"), by("N").alias("n"), by("R").alias("r"))
    return sinks.best_flags(m, ("a", "n", "r")).select("difficulty", "best_a", "best_n", "best_r")


@query("size_guard", f"WITH {CLOUD} SELECT point_id, part FROM cloud QUALIFY count(*) OVER (PARTITION BY object_id, part) >= 30")
def size_guard(spark, sf_dir):
    c = cloud(spark, sf_dir).withColumn("key", F.concat_ws("-", "object_id", "part"))
    return registry.large_enough(c, 30, "key").select("point_id", "part")


@query("merged_log", "SELECT DISTINCT l_returnflag AS a, l_linestatus AS b FROM lineitem UNION SELECT DISTINCT o_orderstatus, NULL FROM orders")
def merged_log(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return sinks.merged_log(a.distinct(), table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a")))


@query("class_names", "WITH p AS (SELECT regexp_extract(p_name, '^(\\S+)', 1) AS name, (p_partkey % 3)::BIGINT AS id, count(*) AS n FROM part GROUP BY 1, 2) SELECT name, arg_min(id, (-n, id)) AS class_id FROM p WHERE name <> '' GROUP BY 1")
def class_names(spark, sf_dir):
    prompts = table(spark, sf_dir, "part").select(F.concat(F.lower(F.hex(F.col("p_partkey") % 3)), F.lit("_x")).alias("key"), F.col("p_name").alias("prompt"))
    return textual.class_names(prompts, r"^(\S+)")


_PLY = f"WITH {CLOUD} SELECT object_id::VARCHAR AS object_id, (row_number() OVER (PARTITION BY object_id ORDER BY point_id) - 1)::BIGINT AS point_id, {r6('x::FLOAT AS x', 'y::FLOAT AS y', 'z::FLOAT AS z', 'round_even(r * 255, 0) / 255 AS r', 'round_even(g * 255, 0) / 255 AS g', 'round_even(b * 255, 0) / 255 AS b')}, part FROM cloud"


@query("ply_roundtrip", _PLY)
def ply_roundtrip(spark, sf_dir):
    files = ply.encoded(cloud(spark, sf_dir)).withColumn("object_id", F.col("object_id").cast("string"))
    good, _ = registry.good_and_bad(ply.decoded(files, ply.points))
    return six(good)


@query("npz_roundtrip", f"WITH {CLOUD} SELECT object_id::VARCHAR AS object_id, (row_number() OVER (PARTITION BY object_id ORDER BY point_id) - 1)::BIGINT AS point_id, {r6(*[f'{c}::FLOAT AS {c}' for c in ('x', 'y', 'z', 'r', 'g', 'b')])}, part FROM cloud")
def npz_roundtrip(spark, sf_dir):
    files = arrays.npz_encoded(cloud(spark, sf_dir)).withColumn("object_id", F.col("object_id").cast("string"))
    good, _ = registry.good_and_bad(ply.decoded(files, arrays.npz_points))
    return six(good)


@query("unreadable_files", f"WITH {CLOUD} SELECT 'PlyError' AS kind, count(DISTINCT object_id) AS n FROM cloud WHERE object_id % 2 = 0")
def unreadable_files(spark, sf_dir):
    """Every second file is cut short: read what can be, tally the errors."""
    files = ply.encoded(cloud(spark, sf_dir)).withColumn("content", F.when(F.col("object_id") % 2 == 0, F.expr("substring(content, 1, 200)")).otherwise(F.col("content"))).withColumn("object_id", F.col("object_id").cast("string"))
    _, bad = registry.good_and_bad(ply.decoded(files, ply.points))
    return registry.error_tally(bad)


@query("partial_pairs", "WITH f AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey // 2)::VARCHAR || '_missing' ELSE (s_suppkey // 2)::VARCHAR END AS name FROM supplier) SELECT regexp_replace(name, '_missing$', '') AS object_id, count(*) FILTER (name NOT LIKE '%\\_missing' ESCAPE '\\') AS partials, count(*) FILTER (name LIKE '%\\_missing' ESCAPE '\\') AS missings, count(*) FILTER (name NOT LIKE '%\\_missing' ESCAPE '\\') = 1 AND count(*) FILTER (name LIKE '%\\_missing' ESCAPE '\\') = 1 AS whole FROM f GROUP BY 1")
def partial_pairs(spark, sf_dir):
    half = F.floor(F.col("s_suppkey") / 2).cast("string")
    return textual.partial_pairs(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.concat(half, F.lit("_missing"))).otherwise(half).alias("object_id")))


def _named(df):
    return df.withColumn("object_id", F.col("object_id").cast("string"))


_FLOATS = ("x::FLOAT AS fx", "y::FLOAT AS fy", "z::FLOAT AS fz")


@query(
    "whole_and_partial",
    f"""WITH {CLOUD}, f AS (SELECT object_id, point_id, {", ".join(_FLOATS)}, row_number() OVER (PARTITION BY object_id ORDER BY point_id) - 1 AS i FROM cloud),
    s AS (SELECT DISTINCT object_id, fx, fy, fz FROM f WHERE point_id % 3 <> 0 AND object_id % 4 <> 3),
    m AS (SELECT f.*, s.fx IS NULL AS is_missing FROM f LEFT JOIN s ON s.object_id = f.object_id AND s.fx = f.fx AND s.fy = f.fy AND s.fz = f.fz WHERE f.object_id % 4 <> 3)
    SELECT object_id::VARCHAR AS object_id, i::BIGINT AS point_id, is_missing FROM m QUALIFY count(*) FILTER (is_missing) OVER (PARTITION BY object_id) >= 16 AND count(*) FILTER (NOT is_missing) OVER (PARTITION BY object_id) >= 16""",
)
def whole_and_partial(spark, sf_dir):
    """Whole clouds and partial ones as files of their own formats, read together."""
    folder = shared_folder(spark)
    c = _named(cloud(spark, sf_dir))
    whole = arrays.npz_encoded(c).select(F.concat("object_id", F.lit(".npz")).alias("name"), "content")
    part = ply.encoded(c.filter("point_id % 3 <> 0 and cast(object_id as long) % 4 <> 3")).select(F.concat("object_id", F.lit(".ply")).alias("name"), "content")
    for files, at in ((whole, "whole"), (part, "partial")):
        sinks.write_files(files, f"{folder}/{at}").count()
    return loaders.whole_and_partial(spark, f"{folder}/whole", f"{folder}/partial", least=16).select("object_id", "point_id", "is_missing")


@query(
    "resume_signature",
    """WITH c AS (SELECT DISTINCT o_custkey AS cell, sha256('{"priority": "' || o_orderpriority || '"}')[1:16] AS config_hash FROM orders), g AS (SELECT cell FROM c WHERE config_hash = sha256('{"priority": "1-URGENT"}')[1:16])
    SELECT cell, 'done' AS state FROM g UNION ALL SELECT c_custkey, 'pending' FROM customer WHERE c_custkey NOT IN (SELECT cell FROM g)""",
)
def resume_signature(spark, sf_dir):
    """Customers as cells; a checkpoint of mixed configurations has some of them."""
    text = F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"), F.lit('"}'))
    checkpoint = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16).alias("config_hash")).distinct()
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"))
    done, left = sinks.resumed(cells, checkpoint, ["cell"], {"priority": "1-URGENT"})
    return done.select("cell", F.lit("done").alias("state")).unionByName(left.select("cell", F.lit("pending").alias("state")))
