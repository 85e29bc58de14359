"""Registered queries of the mesh and field operators, each with its SQL.

Mesh: parts are points (x size, y price, z key mod 97), orders are cells with their
total price, line items are the incidence. Grid: line items by quantity, discount
and tax. Cloud and series: events. Results are rounded where sums of floats would
differ by the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import events_cloud, parts_mesh, price_grid, table
from .functions import vectors as V
from .operators import blocks, convert, grid, integrate, mesh_probe, metrics, resample, scan, select, spatial, stats, temporal, topology
from .plans import views
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


POINTS = "SELECT p_partkey AS point_idx, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey % 97 AS DOUBLE) AS z FROM part"
CORNERS = f"SELECT l_orderkey AS cell_idx, l_partkey AS point_idx, p.x, p.y, p.z FROM lineitem JOIN ({POINTS}) p ON l_partkey = p.point_idx"
AXES = ("x", "y", "z")
LIMITS = [f"{e}_{a}" for e in ("min", "max") for a in AXES]
LIMITS_SQL = ", ".join(f"{e}({a}) AS {e}_{a}" for e in ("min", "max") for a in AXES)


# Bounds, sizes, centres, counts


@register("bounds", f"SELECT {LIMITS_SQL} FROM ({POINTS})")
def bounds(spark, d):
    return metrics.bounds(parts_mesh(spark, d).points)


@register("cell_bounds", f"SELECT o_orderkey AS cell_idx, {', '.join(f'coalesce(b.{c}, 0.0) AS {c}' for c in LIMITS)} FROM orders LEFT JOIN (SELECT cell_idx, {LIMITS_SQL} FROM ({CORNERS}) GROUP BY 1) b ON o_orderkey = b.cell_idx")
def cell_bounds(spark, d):
    return metrics.cell_bounds(parts_mesh(spark, d))


@register("union_cell_bounds", f"SELECT {LIMITS_SQL} FROM ({CORNERS})")
def union_cell_bounds(spark, d):
    return metrics.union_of_cell_bounds(parts_mesh(spark, d))


@register("collection_bounds", f"SELECT CAST(point_idx % 5 AS BIGINT) AS piece_id, {LIMITS_SQL} FROM ({POINTS}) GROUP BY ROLLUP (1)")
def collection_bounds(spark, d):
    points = parts_mesh(spark, d).points.withColumn("piece_id", F.col("point_idx") % 5)
    return metrics.piece_bounds(points, "piece_id")


@register("cell_sizes", f"SELECT o_orderkey AS cell_idx, round(coalesce(s, 0.0), 4) AS size FROM orders LEFT JOIN (SELECT cell_idx, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS s FROM ({CORNERS}) GROUP BY 1) b ON o_orderkey = b.cell_idx")
def cell_sizes(spark, d):
    return rounded(metrics.cell_sizes(parts_mesh(spark, d)), "size")


@register("centroid", f"SELECT o_orderkey AS cell_idx, {', '.join(f'round(coalesce(b.{a}, 0.0), 4) AS center_{a}' for a in AXES)} FROM orders LEFT JOIN (SELECT cell_idx, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM ({CORNERS}) GROUP BY 1) b ON o_orderkey = b.cell_idx")
def centroid(spark, d):
    return rounded(metrics.centroids(parts_mesh(spark, d)), "center_x", "center_y", "center_z")


@register("cell_point_counts", "SELECT o_orderkey AS cell_idx, count(l_orderkey) AS n_points FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def cell_point_counts(spark, d):
    return metrics.cell_point_counts(parts_mesh(spark, d))


@register("point_cell_counts", "SELECT p_partkey AS point_idx, count(l_partkey) AS n_cells FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def point_cell_counts(spark, d):
    return metrics.point_cell_counts(parts_mesh(spark, d))


@register("point_links", "SELECT l_partkey AS point_idx, 0 AS chunk, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS cells FROM lineitem GROUP BY 1")
def point_links(spark, d):
    links = metrics.point_links(parts_mesh(spark, d))
    return links.select("point_idx", "chunk", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))


@register(
    "bounding_box_edges",
    f"""WITH b AS (SELECT {LIMITS_SQL} FROM ({POINTS})), e AS (SELECT CAST(range AS INT) AS edge, CAST(range // 4 AS INT) AS axis, range % 4 % 2 AS lo, range % 4 // 2 AS hi FROM range(12)), n AS (SELECT CAST(range AS INT) AS "end" FROM range(2))
SELECT edge, "end", CASE WHEN (CASE axis WHEN 0 THEN "end" ELSE lo END) = 1 THEN max_x ELSE min_x END AS x, CASE WHEN (CASE axis WHEN 1 THEN "end" WHEN 0 THEN lo ELSE hi END) = 1 THEN max_y ELSE min_y END AS y, CASE WHEN (CASE axis WHEN 2 THEN "end" ELSE hi END) = 1 THEN max_z ELSE min_z END AS z FROM e, n, b""",
)
def bounding_box_edges(spark, d):
    return metrics.box_edges(parts_mesh(spark, d).points)


@register("prefix_sum", "SELECT o_orderkey AS cell_idx, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY o_orderkey) - coalesce(n, 0) AS BIGINT) AS start FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def prefix_sum(spark, d):
    counts = metrics.cell_point_counts(parts_mesh(spark, d)).withColumnRenamed("n_points", "n")
    return scan.prefix_sum(counts, "cell_idx", "n", "start", rows=4000)


# Fields between points and cells


@register("cell_field", "SELECT o_orderkey AS cell_idx, round(coalesce(v, 0.0), 4) AS y FROM orders LEFT JOIN (SELECT l_orderkey, avg(p_retailprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON o_orderkey = l_orderkey")
def cell_field(spark, d):
    return rounded(convert.to_cells(parts_mesh(spark, d), "y"), "y")


@register("point_field", "SELECT p_partkey AS point_idx, round(coalesce(v, 0.0) + 1e-7, 4) AS value FROM part LEFT JOIN (SELECT l_partkey, avg(o_totalprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON p_partkey = l_partkey")
def point_field(spark, d):
    return rounded(convert.to_points(parts_mesh(spark, d), "value").withColumn("value", F.col("value") + 1e-7), "value")


@register("gather", "SELECT l_orderkey AS cell_idx, l_partkey AS point_idx, p_retailprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey")
def gather(spark, d):
    mesh = parts_mesh(spark, d)
    return convert.gather(mesh.cell_points, "point_idx", mesh.points, "point_idx", ["y"])


# Projections


@register("component", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS c0, round(CAST(embedding[4] AS DOUBLE), 6) AS c3 FROM embeddings")
def component(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", *[F.round(V.component(v, i).cast("double"), 6).alias(f"c{i}") for i in (0, 3)])


@register("magnitude", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS magnitude FROM embeddings")
def magnitude(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude(F.col("embedding")), 5).alias("magnitude"))


@register("vector_algebra", f"SELECT point_idx, round((x * 1.0 + y * 2.0 + z * 3.0), 4) AS dotted, round(y * 3.0 - z * 2.0, 4) AS cross_x, round(x / sqrt(x * x + y * y + z * z), 6) AS unit_x, round(x + 5, 4) AS added_x FROM ({POINTS})")
def vector_algebra(spark, d):
    points = parts_mesh(spark, d).points
    v, w = V.assemble(*[F.col(a) for a in AXES]), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return points.select("point_idx", F.round(V.dot(v, w), 4).alias("dotted"), F.round(V.component(V.cross(v, w), 0), 4).alias("cross_x"), F.round(V.component(V.normalize(v), 0), 6).alias("unit_x"), F.round(V.component(V.add_scalar(v, 5.0), 0), 4).alias("added_x"))


@register("remap", "SELECT o_orderkey, round((least(greatest(o_totalprice, 50000.0), 300000.0) - 50000.0) / 250000.0 * 2.0 - 1.0 + 1e-8, 6) AS remapped FROM orders")
def remap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(V.remap(F.col("o_totalprice"), (50000, 300000), (-1, 1)), 6).alias("remapped"))


COLOURS = [(0.0, (0.0, 0.0, 1.0, 1.0)), (0.25, (0.0, 1.0, 1.0, 1.0)), (1.0, (1.0, 0.0, 0.0, 0.5))]


@register("colormap", "WITH t AS (SELECT o_orderkey, least(greatest(o_totalprice, 0.0), 400000.0) / 400000.0 AS t FROM orders) SELECT o_orderkey, round(CASE WHEN t <= 0.25 THEN 0.0 ELSE (t - 0.25) / 0.75 END + 1e-8, 6) AS r, round(CASE WHEN t <= 0.25 THEN t / 0.25 ELSE 1 - (t - 0.25) / 0.75 END + 1e-8, 6) AS g, round(CASE WHEN t <= 0.25 THEN 1.0 ELSE 1 - (t - 0.25) / 0.75 END + 1e-8, 6) AS b, round(CASE WHEN t <= 0.25 THEN 1.0 ELSE 1 - 0.5 * (t - 0.25) / 0.75 END + 1e-8, 6) AS a FROM t")
def colormap(spark, d):
    rgba = table(spark, d, "orders").select("o_orderkey", V.colormap(F.col("o_totalprice"), (0, 400000), COLOURS).alias("c"))
    return rgba.select("o_orderkey", *[F.round(F.col("c")[i] + 1e-8, 6).alias(n) for i, n in enumerate("rgba")])


@register("quaternion", "WITH u AS (SELECT point_idx, x / n + 1 AS hx, y / n AS hy, z / n AS hz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM (" + POINTS + "))), h AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS m FROM u) SELECT point_idx, round(0.0, 6) AS qx, round(-hz / m, 6) AS qy, round(hy / m, 6) AS qz, round(hx / m, 6) AS qw FROM h")
def quaternion(spark, d):
    q = parts_mesh(spark, d).points.select("point_idx", V.direction_quaternion(*[F.col(a) for a in AXES]).alias("q"))
    return q.select("point_idx", *[(F.round(F.col("q")[i], 6) + 0.0).alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw"))])


@register("threshold", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 400000.0 WHEN o_totalprice < 100000 THEN 0.0 ELSE o_totalprice END AS value FROM orders")
def threshold(spark, d):
    return table(spark, d, "orders").select("o_orderkey", select.threshold(F.col("o_totalprice"), 100000, 400000, 0.0, 400000.0).alias("value"))


# Ranges and histograms


@register("field_range", "SELECT min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def field_range(spark, d):
    return stats.field_range(table(spark, d, "orders"), "o_totalprice")


@register(
    "vector_ranges",
    "SELECT CAST(c AS INT) AS component, round(min(CAST(embedding[c + 1] AS DOUBLE)), 6) AS min, round(max(CAST(embedding[c + 1] AS DOUBLE)), 6) AS max FROM embeddings, range(4) AS r(c) GROUP BY 1 UNION ALL SELECT -1, round(min(m), 5), round(max(m), 5) FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS m FROM embeddings)",
)
def vector_ranges(spark, d):
    r = stats.vector_ranges(table(spark, d, "embeddings"), F.col("embedding"), 4)
    digits = lambda c: F.when(F.col("component") < 0, F.round(c, 5)).otherwise(F.round(c, 6)).alias(c)
    return r.select("component", digits("min"), digits("max"))


@register("joint_range", "SELECT round(min(v), 4) AS min, round(max(v), 4) AS max FROM (SELECT sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS v FROM lineitem)")
def joint_range(spark, d):
    return rounded(stats.joint_range(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_tax"), "min", "max")


HISTOGRAM = """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS total, avg(o_totalprice) AS mean FROM orders),
c AS (SELECT CAST(trunc((o_totalprice - lo) * (1.0 / ((hi - lo) / 32))) AS INT) AS bin, count(*) AS n FROM orders, b WHERE o_totalprice < hi GROUP BY 1),
h AS (SELECT CAST(r AS INT) AS bin, lo + r * ((hi - lo) / 32) AS low_edge, lo + (r + 1) * ((hi - lo) / 32) AS high_edge, coalesce(n, 0) AS n FROM range(32) AS t(r) CROSS JOIN b LEFT JOIN c ON c.bin = r)"""


@register("histogram", HISTOGRAM + " SELECT bin, round(low_edge, 4) AS low_edge, round(high_edge, 4) AS high_edge, n FROM h")
def histogram(spark, d):
    return rounded(stats.histogram(table(spark, d, "orders"), "o_totalprice", 32), "low_edge", "high_edge")


@register("histogram_in_range", "SELECT CAST(r AS INT) AS bin, r * 2.0 + 0.0 AS low_edge, r * 2.0 + 2.0 AS high_edge, coalesce(n, 0) AS n FROM range(50) AS t(r) LEFT JOIN (SELECT CAST(trunc(value * 0.5) AS INT) AS bin, count(*) AS n FROM events WHERE value * 0.5 < 50 AND value * 0.5 > -1 GROUP BY 1) c ON c.bin = r")
def histogram_in_range(spark, d):
    return rounded(stats.histogram(table(spark, d, "events"), "value", 50, 0.0, 100.0), "low_edge", "high_edge")


@register(
    "scalar_stats",
    HISTOGRAM
    + """, s AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum FROM h), q AS (SELECT p, min(bin) AS bin FROM s, b, (VALUES (25), (50), (75)) AS v(p) WHERE cum >= total * (p / 100.0) GROUP BY 1),
e AS (SELECT p, low_edge + (total * (p / 100.0) - (cum - n)) / greatest(n, 1) * ((hi - lo) / 32) AS v FROM q JOIN s USING (bin), b)
SELECT total AS n, round(mean, 4) AS mean, lo AS min, hi AS max, round((SELECT v FROM e WHERE p = 25), 4) AS p25, round((SELECT v FROM e WHERE p = 50), 4) AS p50, round((SELECT v FROM e WHERE p = 75), 4) AS p75 FROM b""",
)
def scalar_stats(spark, d):
    return rounded(stats.scalar_stats(table(spark, d, "orders"), "o_totalprice"), "mean", "p25", "p50", "p75")


@register("unique_values", "SELECT DISTINCT p_size AS value FROM part WHERE p_size <= 40")
def unique_values(spark, d):
    return stats.unique_values(table(spark, d, "part"), "p_size", 40)


@register("dataset_summary", "SELECT 'l_quantity' AS field, 'double' AS dtype, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 4) AS mean FROM lineitem UNION ALL SELECT 'l_extendedprice', 'double', count(l_extendedprice), min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_partkey', 'bigint', count(l_partkey), min(l_partkey), max(l_partkey), round(avg(l_partkey), 4) FROM lineitem")
def dataset_summary(spark, d):
    return rounded(stats.summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey"]), "mean")


# Selections

BOX = ((5.0, 900.0, 0.0), (50.0, 999.0, 90.0))
IN_BOX = "x BETWEEN 5 AND 50 AND y BETWEEN 900 AND 999 AND z BETWEEN 0 AND 90"
MASKS = {"all": f"SELECT cell_idx, bool_and({IN_BOX}) AS hit FROM ({CORNERS}) GROUP BY 1", "any": f"SELECT cell_idx, bool_or({IN_BOX}) AS hit FROM ({CORNERS}) GROUP BY 1", "centroid": f"SELECT cell_idx, {IN_BOX} AS hit FROM (SELECT cell_idx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({CORNERS}) GROUP BY 1)"}


def _box(mode: str) -> Query:
    return lambda spark, d: select.box_mask(parts_mesh(spark, d), BOX, mode)


for _mode, _sql in MASKS.items():
    register(f"cell_in_box_{_mode}", f"SELECT o_orderkey AS cell_idx, CAST(coalesce(hit, false) AS INT) AS mask FROM orders LEFT JOIN ({_sql}) ON o_orderkey = cell_idx")(_box(_mode))


@register("box_indices", f"SELECT cell_idx, row_number() OVER (ORDER BY cell_idx) - 1 AS new_idx FROM ({MASKS['all']}) WHERE hit")
def box_indices(spark, d):
    return select.cells_in_box(parts_mesh(spark, d), BOX, "all")


@register("cell_subset", f"WITH s AS (SELECT cell_idx, row_number() OVER (ORDER BY cell_idx) - 1 AS new_idx FROM ({MASKS['all']}) WHERE hit) SELECT new_idx AS cell_idx, cell_idx AS old_idx, o_totalprice AS value, n FROM s JOIN orders ON o_orderkey = cell_idx JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = cell_idx")
def cell_subset(spark, d):
    part = select.region_subset(parts_mesh(spark, d), BOX)
    counts = part.cell_points.groupBy("cell_idx").agg(F.count("*").alias("n"))
    return part.cells.join(counts, "cell_idx").select("cell_idx", "old_idx", "value", "n")


@register("subrange", "SELECT o_orderkey - 100 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100")
def subrange(spark, d):
    return select.subrange(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 1000)


@register("take_indices", "SELECT e.event_id AS p_partkey, p.p_retailprice FROM events e JOIN part p ON p.p_partkey = e.user_id")
def take_indices(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return select.pick(part, "p_partkey", ids=table(spark, d, "events"), order="event_id", key="user_id")


@register("used_points", "SELECT p_partkey AS point_idx, p_retailprice AS y FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def used_points(spark, d):
    return select.used_points(parts_mesh(spark, d)).select("point_idx", "y")


@register("unused_cells", "SELECT o_orderkey AS cell_idx FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unused_cells(spark, d):
    mesh = parts_mesh(spark, d)
    return mesh.cells.join(mesh.cell_points, "cell_idx", "left_anti").select("cell_idx")


@register("stride_sample", "SELECT point_idx, x FROM (SELECT *, row_number() OVER (ORDER BY point_idx) - 1 AS r, count(*) OVER () AS n FROM (" + POINTS + ")) WHERE r % CAST(ceil(n / 300.0) AS BIGINT) = 0")
def stride_sample(spark, d):
    return select.stride_sample(parts_mesh(spark, d).points, "point_idx", 300).select("point_idx", "x")


# Time

DAY = 86400.0
SERIES = "SELECT user_id, event_id, epoch(ts) AS t, event_type, value FROM events"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / F.lit(1e6)).alias("t"), "event_type", "value")


BRACKET = f"""WITH e AS ({SERIES}), k AS (SELECT DISTINCT user_id, t AS s FROM e WHERE event_type = 'view'),
b AS (SELECT e.user_id, event_id, t, max(s) FILTER (WHERE s <= t) AS lo, min(s) FILTER (WHERE s >= t) AS hi FROM e LEFT JOIN k ON e.user_id = k.user_id GROUP BY ALL)"""


@register("time_bracket", BRACKET + " SELECT user_id, event_id, round(t, 3) AS t, round(coalesce(lo, hi), 3) AS lower, round(coalesce(hi, lo), 3) AS upper FROM b")
def time_bracket(spark, d):
    e = _series(spark, d)
    out = temporal.bracket(e.select("user_id", "t", "event_id"), e.where("event_type = 'view'"), "user_id", "t")
    return rounded(out.select("user_id", "event_id", "t", "lower", "upper"), "t", "lower", "upper", digits=3)


@register("snap_down", BRACKET + " SELECT user_id, event_id, round(coalesce(lo, hi), 3) AS snapped FROM b")
def snap_down(spark, d):
    e = _series(spark, d)
    out = temporal.snap_down(e.select("user_id", "t", "event_id"), e.where("event_type = 'view'"), "user_id", "t", 7 * DAY)
    return rounded(out.select("user_id", "event_id", "snapped"), "snapped", digits=3)


@register("snap_across", f"""WITH e AS ({SERIES}), q AS (SELECT e.user_id, e.event_id, e.t, max(k.t) FILTER (WHERE k.event_type = 'view' AND k.t <= e.t) AS lo1, min(k.t) FILTER (WHERE k.event_type = 'view') AS f1, max(k.t) FILTER (WHERE k.event_type = 'error' AND k.t <= e.t) AS lo2, min(k.t) FILTER (WHERE k.event_type = 'error') AS f2 FROM e JOIN e k ON e.user_id = k.user_id GROUP BY ALL),
s AS (SELECT *, coalesce(lo1, f1) AS s1, coalesce(lo2, f2) AS s2 FROM q)
SELECT user_id, event_id, round(coalesce(greatest(CASE WHEN s1 <= t THEN s1 END, CASE WHEN s2 <= t THEN s2 END), least(s1, s2)), 3) AS snapped FROM s""")
def snap_across(spark, d):
    e = _series(spark, d)
    known = [e.where(F.col("event_type") == k) for k in ("view", "error")]
    out = temporal.snap_across(e.select("user_id", "t", "event_id"), known, "user_id", "t", 7 * DAY)
    return rounded(out.select("user_id", "event_id", "snapped"), "snapped", digits=3)


@register("next_sample", f"SELECT user_id, round(t, 3) AS t, round(lead(t) OVER (PARTITION BY user_id ORDER BY t), 3) AS next FROM (SELECT DISTINCT user_id, t FROM ({SERIES}))")
def next_sample(spark, d):
    return rounded(temporal.next_sample(_series(spark, d), "user_id", "t"), "t", "next", digits=3)


@register("interpolation_factor", BRACKET + " SELECT user_id, event_id, round(CASE WHEN coalesce(hi, lo) > coalesce(lo, hi) THEN (t - lo) / (hi - lo) ELSE 0.0 END, 4) AS factor FROM b WHERE lo IS NOT NULL OR hi IS NOT NULL")
def interpolation_factor(spark, d):
    e = _series(spark, d)
    out = temporal.bracket(e.select("user_id", "t", "event_id"), e.where("event_type = 'view'"), "user_id", "t", 7 * DAY).where("lower is not null")
    return rounded(out.select("user_id", "event_id", temporal.factor(F.col("t"), F.col("lower"), F.col("upper")).alias("factor")), "factor")


@register("lerp_mesh_points", "SELECT p_partkey AS point_idx, p_size * 1.25 AS x, round(p_retailprice * 1.25, 4) AS y, CAST(p_partkey % 97 AS DOUBLE) + 1.5 AS z FROM part")
def lerp_mesh_points(spark, d):
    """Points of a mesh a quarter of the way to a snapshot in which it has grown and moved up."""
    return rounded(_grown(spark, d).points, "y")


@register("lerp_mesh_cells", "SELECT o_orderkey AS cell_idx, round(o_totalprice * 0.875, 4) AS value FROM orders")
def lerp_mesh_cells(spark, d):
    return rounded(_grown(spark, d).cells, "value")


def _grown(spark, d):
    mesh = parts_mesh(spark, d)
    points = mesh.points.select("point_idx", (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), (F.col("z") + 6).alias("z"))
    return temporal.lerp_mesh(mesh, mesh.with_points(points).with_cells(mesh.cells.withColumn("value", F.col("value") / 2)), 0.25)


@register("lerp_series", f"WITH e AS ({SERIES}), u AS (SELECT user_id, arg_min(value, t) AS a, arg_max(value, t) AS b FROM e GROUP BY 1) SELECT user_id, round(a + (b - a) * 0.25, 4) AS value FROM u")
def lerp_series(spark, d):
    e = _series(spark, d)
    first, last = (e.groupBy("user_id").agg(f("value", "t").alias("value")) for f in (F.min_by, F.max_by))
    return rounded(temporal.lerp(first, last, "user_id", ["value"], 0.25), "value")


@register("time_shift", f"SELECT event_id, round(t * 2.0 + 10.0, 3) AS t FROM ({SERIES})")
def time_shift(spark, d):
    return _series(spark, d).select("event_id", F.round(temporal.shifted(F.col("t"), 2.0, 10.0), 3).alias("t"))


# Grids

GRID = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1, 0, 0), (50, 10, 8))
NODES = "SELECT CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, CAST(round(l_tax * 100) AS BIGINT) AS k, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3"
#: Samples spread over the grid and a little beyond it.
SAMPLES = "SELECT event_id, value / 8 AS x, user_id % 111 / 10.0 AS y, event_id % 9 AS z FROM events"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("value") / 8).alias("x"), (F.col("user_id") % 111 / F.lit(10.0)).alias("y"), (F.col("event_id") % 9).cast("double").alias("z"))


def _probe_sql(samples: str, key: str, outside: str) -> str:
    """Trilinear interpolation as a sum over eight corners."""
    cell = "CASE WHEN floor(x) = 50 AND abs(x - 50) <= 1e-6 THEN 49 ELSE floor(x) END AS ci, CASE WHEN floor(y) = 10 AND abs(y - 10) <= 1e-6 THEN 9 ELSE floor(y) END AS cj, CASE WHEN floor(z) = 8 AND abs(z - 8) <= 1e-6 THEN 7 ELSE floor(z) END AS ck"
    return f"""WITH n AS ({NODES}), s AS (SELECT *, {cell} FROM ({samples})), m AS (SELECT *, CASE WHEN ci BETWEEN 1 AND 49 AND cj BETWEEN 0 AND 9 AND ck BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS mask FROM s),
w AS (SELECT {key}, mask, ci + a AS i, cj + b AS j, ck + c AS k, (CASE a WHEN 1 THEN x - ci ELSE 1 - (x - ci) END) * (CASE b WHEN 1 THEN y - cj ELSE 1 - (y - cj) END) * (CASE c WHEN 1 THEN z - ck ELSE 1 - (z - ck) END) AS w FROM m, range(2) AS ra(a), range(2) AS rb(b), range(2) AS rc(c)),
p AS (SELECT {key}, mask, sum(w * coalesce(value, 0)) AS v FROM w LEFT JOIN n USING (i, j, k) GROUP BY ALL)
SELECT {key}, mask, round(CASE mask WHEN 1 THEN v ELSE {outside} END, 2) AS value FROM p"""


@register("probe", _probe_sql(SAMPLES, "event_id", "0.0"))
def probe(spark, d):
    out = grid.probe(_samples(spark, d), price_grid(spark, d), GRID)
    return out.select("event_id", "mask", F.round("probed_value", 2).alias("value"))


@register("probe_cells", f"WITH c AS (SELECT i - 1 + j * 49 + k * 490 AS cell_idx, value FROM ({NODES}) WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (SELECT event_id, CASE WHEN x >= 1 AND x < 50 AND y >= 0 AND y < 10.0000005 AND z BETWEEN 0 AND 8 THEN floor(x) - 1 + least(floor(y), 9) * 49 + least(floor(z), 7) * 490 END AS cell_idx FROM ({SAMPLES})) SELECT event_id, CASE WHEN s.cell_idx IS NULL THEN 0 ELSE 1 END AS mask, round(coalesce(value, 0.0) + 1e-7, 2) AS value FROM s LEFT JOIN c ON c.cell_idx = s.cell_idx")
def probe_cells(spark, d):
    nodes = price_grid(spark, d).where("i <= 49 and j <= 9 and k <= 7")
    cells = nodes.select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.cell_dims).alias("cell_idx"), "value")
    return grid.probe_cells(_samples(spark, d), cells, GRID).select("event_id", "mask", F.round(F.col("probed_value") + 1e-7, 2).alias("value"))


VOXELS = "SELECT i, j, k, (i + 0.5) * 1.5 AS x, (j + 0.5) * 1.5 AS y, (k + 0.5) * 1.5 AS z FROM range(0, 35) AS a(i), range(0, 8) AS b(j), range(0, 6) AS c(k)"


@register("voxel_grid_probe", _probe_sql(VOXELS, "i, j, k", "(SELECT min(value) FROM n)").replace("SELECT i, j, k, mask, ci + a AS i", "SELECT i AS vi, j AS vj, k AS vk, mask, ci + a AS i").replace("p AS (SELECT i, j, k, mask", "p AS (SELECT vi, vj, vk, mask").replace("SELECT i, j, k, mask, round", "SELECT vi AS i, vj AS j, vk AS k, mask, round"))
def voxel_grid_probe(spark, d):
    out = grid.voxelize(price_grid(spark, d), GRID, (0, 0, 0), (34, 7, 5), (1.5, 1.5, 1.5))
    return out.select("i", "j", "k", "mask", F.round("value", 2).alias("value"))


SLICE = "SELECT CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS \"row\", 1 + 49 * ((c + 0.5) / 16) AS x, 10 * ((r + 0.5) / 9) AS y, 3.25 AS z FROM range(16) AS a(c), range(9) AS b(r)"


@register("slice_z", _probe_sql(SLICE, 'col, "row"', "0.0"))
def slice_z(spark, d):
    out = grid.slices(price_grid(spark, d), GRID, "z", (25.0, 5.0, 3.25), 16, 9)
    return out.select("col", "row", "mask", F.round("value", 2).alias("value"))


def _plane(name: str, x: str, y: str, z: str) -> str:
    return f"SELECT '{name}' AS slice, CAST(c AS BIGINT) AS col, CAST(r AS BIGINT) AS \"row\", {x} AS x, {y} AS y, {z} AS z FROM range(24) AS a(c), range(24) AS b(r)"


_C, _R = "((c + 0.5) / 24)", "((r + 0.5) / 24)"
PLANES = " UNION ALL ".join((_plane("x", "25.3", f"10 * {_C}", f"8 * {_R}"), _plane("y", f"1 + 49 * {_R}", "5.2", f"8 * {_C}"), _plane("z", f"1 + 49 * {_C}", f"10 * {_R}", "3.25")))


@register("slice_xyz", _probe_sql(PLANES, 'slice, col, "row"', "0.0"))
def slice_xyz(spark, d):
    out = grid.slices(price_grid(spark, d), GRID, "xyz", (25.3, 5.2, 3.25), 24, 24)
    return out.select("slice", "col", "row", "mask", F.round("value", 2).alias("value"))


@register("dense_copy", f"SELECT i, j, k, round(value + 1e-7, 2) AS value, (i - 10) + (j - 2) * 11 + (k - 1) * 44 AS point_idx FROM ({NODES}) WHERE i BETWEEN 10 AND 20 AND j BETWEEN 2 AND 5 AND k BETWEEN 1 AND 6")
def dense_copy(spark, d):
    return rounded(grid.dense_copy(price_grid(spark, d), (10, 2, 1), (20, 5, 6)).withColumn("value", F.col("value") + 1e-7), "value", digits=2)


@register("to_volume", "SELECT p_partkey % 10 AS i, p_partkey // 10 % 20 AS j, p_partkey // 200 AS k, p_retailprice AS value FROM part")
def to_volume(spark, d):
    field = table(spark, d, "part").select(F.col("p_partkey").alias("point_idx"), F.col("p_retailprice").alias("value"))
    return grid.to_volume(field, (10, 20, 10**9))


# Sparse volumes

DEAR = 51_000.0


@register("sparse_volume", f"SELECT i // 8 AS bi, j // 8 AS bj, k // 8 AS bk, count(*) AS active, round(sum(value) + 1e-7, 2) AS total FROM ({NODES}) WHERE value > {DEAR} GROUP BY ALL")
def sparse_volume(spark, d):
    """Nodes of the price grid above a price, as blocks: how many each has, and their sum after the way back."""
    held = blocks.to_blocks(price_grid(spark, d).where(F.col("value") > DEAR))
    counted = held.select(*blocks.PLACE, F.aggregate("mask", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w)).alias("active"))
    back = blocks.to_nodes(held).groupBy(*[F.floor(F.col(c) / 8).alias(b) for c, b in zip("ijk", blocks.PLACE, strict=True)]).agg(F.round(F.sum("value") + 1e-7, 2).alias("total"))
    return counted.join(back, blocks.PLACE)


@register("sparse_probe", f"WITH n AS (SELECT * FROM ({NODES}) WHERE value > {DEAR}), c AS (SELECT event_id, CAST(floor(x) AS BIGINT) + a AS i, CAST(floor(y) AS BIGINT) + b AS j, CAST(floor(z) AS BIGINT) + c AS k, (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE c WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM ({SAMPLES}), range(2) AS p(a), range(2) AS q(b), range(2) AS r(c)) SELECT event_id, round(sum(w * coalesce(value, -1.0)) + 1e-7, 2) AS value FROM c LEFT JOIN n USING (i, j, k) GROUP BY 1")
def sparse_probe(spark, d):
    """Samples in that volume, with -1 where it is not active."""
    held = blocks.to_blocks(price_grid(spark, d).where(F.col("value") > DEAR), -1.0)
    space = grid.ImageGrid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0, 0, 0), (1, 1, 1))
    out = blocks.probe(_samples(spark, d), "event_id", held, space, -1.0)
    return out.select("event_id", F.round(F.col("value") + 1e-7, 2).alias("value"))


# Splats

CLOUD = "SELECT event_id AS point_idx, value / 10 AS x, CAST(user_id AS DOUBLE) AS y, CAST(hour(ts) AS DOUBLE) AS z, value FROM events"
CENTRES = "SELECT i, j, k, (i + 0.5) * 4 AS x, (j + 0.5) * 4 AS y, (k + 0.5) * 4 AS z FROM range(0, 8) AS a(i), range(0, 12) AS b(j), range(0, 6) AS c(k)"


def _centres(spark: SparkSession) -> DataFrame:
    return grid.voxel_centres(spark, (0, 0, 0), (7, 11, 5), (4.0, 4.0, 4.0))


def _near(radius: float, value: str) -> str:
    return f"WITH s AS ({CENTRES}), p AS ({CLOUD}), d AS (SELECT s.i, s.j, s.k, sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2) + pow(s.z - p.z, 2)) AS d, p.value FROM s JOIN p ON abs(s.x - p.x) <= {radius} AND abs(s.y - p.y) <= {radius} AND abs(s.z - p.z) <= {radius}), v AS (SELECT i, j, k, {value} AS value FROM d WHERE d <= {radius} GROUP BY 1, 2, 3) SELECT s.i, s.j, s.k, round(coalesce(v.value, 0.0), 3) AS value FROM s LEFT JOIN v USING (i, j, k)"


@register("gaussian_splat", _near(3.0, "sum(exp(-4.0 / 9.0 * d * d) * value) / sum(exp(-4.0 / 9.0 * d * d))"))
def gaussian_splat(spark, d):
    out = resample.gaussian(_centres(spark), events_cloud(spark, d), 3.0, 2.0, ["i", "j", "k"])
    return rounded(out.drop("weight"), "value", digits=3)


SPH_SQL = {
    "cubic": (2.0, "(1 / pi()) * (0.25 * pow(greatest(2 - d / 1.5, 0), 3) - pow(greatest(1 - d / 1.5, 0), 3))"),
    "quartic": (2.5, "(1 / (20 * pi())) * (pow(greatest(2.5 - d / 1.5, 0), 4) - 5 * pow(greatest(1.5 - d / 1.5, 0), 4) + 10 * pow(greatest(0.5 - d / 1.5, 0), 4))"),
    "quintic": (3.0, "(1 / (120 * pi())) * (pow(greatest(3 - d / 1.5, 0), 5) - 6 * pow(greatest(2 - d / 1.5, 0), 5) + 15 * pow(greatest(1 - d / 1.5, 0), 5))"),
    "wendland": (2.0, "(21 / (16 * pi())) * pow(greatest(1 - 0.5 * d / 1.5, 0), 4) * (1 + 2 * d / 1.5)"),
}


def _sph(kind: str) -> Query:
    return lambda spark, d: rounded(resample.sph(_centres(spark), events_cloud(spark, d), 1.5, kind, ["i", "j", "k"]), "value", digits=3)


for _kind, (_support, _weight) in SPH_SQL.items():
    register(f"sph_{_kind}", _near(1.5 * _support, f"sum({_weight} * value)"))(_sph(_kind))


#: The six tetrahedra of a unit cell, by corners (bits i, j, k), and their weights by the position in the cell.
SIX = [(0, 1, 3, 7), (0, 1, 7, 5), (0, 5, 7, 4), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7)]
TETRA_SQL = "WITH n AS (SELECT i, j, k FROM (" + NODES + """) WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (SELECT event_id, x, y, z, x - i AS u, y - j AS v, z - k AS w, (i + j * 50 + k * 550) * 6 AS c FROM (""" + SAMPLES + """) JOIN n ON x - i BETWEEN -1e-6 AND 1 + 1e-6 AND y - j BETWEEN -1e-6 AND 1 + 1e-6 AND z - k BETWEEN -1e-6 AND 1 + 1e-6),
t AS (SELECT event_id, x, y, z, c + m AS cell_idx FROM s, range(6) AS r(m) WHERE (CASE m WHEN 0 THEN least(1 - u, u - v, v - w, w) WHEN 1 THEN least(1 - u, u - w, w - v, v) WHEN 2 THEN least(1 - w, w - u, u - v, v) WHEN 3 THEN least(1 - v, v - u, u - w, w) WHEN 4 THEN least(1 - v, v - w, w - u, u) ELSE least(1 - w, w - v, v - u, u) END) >= -1e-6)
SELECT event_id, min(cell_idx) AS cell_idx, round(2 * x - 3 * y + z + 1e-7, 4) AS value FROM t GROUP BY event_id, x, y, z"""


@register("locate_in_tetrahedra", TETRA_SQL)
def locate_in_tetrahedra(spark, d):
    """Samples in the six tetrahedra of each unit cell that a grid node opens, with a linear field."""
    nodes = price_grid(spark, d).where("i <= 49 and j <= 9 and k <= 7")
    at = lambda n: [F.col(c) + ((n >> b) & 1) for b, c in enumerate("ijk")]
    split = [F.struct(F.lit(m).alias("m"), F.array(*[spatial.corner(x, p := at(n), 2 * p[0] - 3 * p[1] + p[2]) for x, n in enumerate(t)]).alias("corners")) for m, t in enumerate(SIX)]
    tetra = nodes.select(grid.linear(F.col("i"), F.col("j"), F.col("k"), (50, 11, 9)).alias("c"), F.explode(F.array(*split)).alias("t"))
    tetra = tetra.select((F.col("c") * 6 + F.col("t.m")).alias("cell_idx"), F.lit(spatial.TETRA).alias("cell_type"), "t.corners")
    out = spatial.located(_samples(spark, d), "event_id", tetra, 1)
    return out.select("event_id", "cell_idx", F.round(F.get("values", F.lit(0)) + 1e-7, 4).alias("value"))


# Topology


def _hexes(nodes: DataFrame) -> DataFrame:
    """A hexahedron at each node of the grid that has one beyond it on every axis."""
    at = lambda a, b, c: grid.linear(F.col("i") - 1 + a, F.col("j") + b, F.col("k") + c, GRID.point_dims)
    pts = F.array(*[at(a, b, c) for a, b, c in ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))])
    some = nodes.where("i <= 49 and j <= 9 and k <= 7")
    return some.select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.cell_dims).alias("cell_idx"), F.lit(12).alias("cell_type"), pts.alias("pts"))


FACES_SQL = f"""WITH h AS (SELECT (i - 1) + j * 49 + k * 490 AS cell_idx, (i - 1) + j * 50 + k * 550 AS o FROM ({NODES}) WHERE i <= 49 AND j <= 9 AND k <= 7),
t(local_face, a, b, c, d) AS (VALUES (0, 0, 550, 600, 50), (1, 1, 51, 601, 551), (2, 0, 1, 551, 550), (3, 50, 600, 601, 51), (4, 0, 50, 51, 1), (5, 550, 551, 601, 600)),
f AS (SELECT cell_idx, local_face, list_value(o + a, o + b, o + c, o + d) AS p FROM h, t)"""


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("face_pts", F.array_join(F.transform("face_pts", lambda p: p.cast("string")), ","))


@register("cell_faces", FACES_SQL + " SELECT cell_idx, local_face, array_to_string(p, ',') AS face_pts FROM f")
def cell_faces(spark, d):
    return _listed(topology.cell_faces(_hexes(price_grid(spark, d))))


@register("external_faces", FACES_SQL + ", g AS (SELECT list_sort(p) AS key, count(*) AS n, min(cell_idx) AS cell_idx, min(local_face) AS local_face, any_value(array_to_string(p, ',')) AS face_pts FROM f GROUP BY 1) SELECT cell_idx, local_face, face_pts FROM g WHERE n = 1")
def external_faces(spark, d):
    return _listed(topology.external_faces(_hexes(price_grid(spark, d))))


@register("point_compaction", FACES_SQL + " SELECT point_idx, row_number() OVER (ORDER BY point_idx) - 1 AS new_idx FROM (SELECT DISTINCT unnest(p) AS point_idx FROM f)")
def point_compaction(spark, d):
    return topology.compacted(topology.cell_faces(_hexes(price_grid(spark, d))))[0]


@register("face_summary", FACES_SQL + " SELECT count(*) AS faces, CAST(sum(len(p)) AS BIGINT) AS corners, CAST(max(len(p)) AS INT) AS largest FROM f")
def face_summary(spark, d):
    return topology.face_summary(topology.cell_faces(_hexes(price_grid(spark, d))))


DENSE_SQL = FACES_SQL + """, o AS (SELECT key, arg_min(p, cell_idx * 6 + local_face) AS p, min(cell_idx * 6 + local_face) AS seen FROM (SELECT *, list_sort(p) AS key FROM f) GROUP BY key),
d AS (SELECT key, p, row_number() OVER (ORDER BY seen) - 1 AS face_id FROM o)"""


@register("dense_faces", DENSE_SQL + " SELECT face_id, len(p) AS n_points, CAST(sum(len(p)) OVER (ORDER BY face_id) - len(p) AS BIGINT) AS first_corner, array_to_string(p, ',') AS face_pts FROM d")
def dense_faces(spark, d):
    """Every face of the grid's cells once, with where its corners begin in one array."""
    return _listed(topology.dense_faces(topology.cell_faces(_hexes(price_grid(spark, d))))[2])


@register("dense_cell_faces", DENSE_SQL + " SELECT row_number() OVER (ORDER BY cell_idx, local_face) - 1 AS ref_idx, cell_idx, local_face, face_id FROM f JOIN d ON list_sort(f.p) = d.key")
def dense_cell_faces(spark, d):
    """The faces of every cell, one cell after the other."""
    return topology.dense_faces(topology.cell_faces(_hexes(price_grid(spark, d))))[1]


@register("dense_cells", DENSE_SQL + " SELECT cell_idx, count(*) AS n_faces, CAST(sum(count(*)) OVER (ORDER BY cell_idx) - count(*) AS BIGINT) AS first_ref FROM f GROUP BY 1")
def dense_cells(spark, d):
    return topology.dense_faces(topology.cell_faces(_hexes(price_grid(spark, d))))[0]


def _owners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as faces: a face is owned by the supplier of each line, and met by its order."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("cell_idx"), F.col("l_partkey").alias("face_idx")), li.select(F.col("l_orderkey").alias("cell_idx"), F.col("l_partkey").alias("face_idx"))


@register("owner_neighbour", "SELECT l_suppkey AS cell_idx, l_partkey AS face_idx, 'owner' AS side FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'neighbour' FROM lineitem")
def owner_neighbour(spark, d):
    return topology.face_cells(*_owners(spark, d))


@register("ngon_remap", "SELECT l_partkey AS face_idx, min(l_orderkey) AS cell_idx, arg_min(o_totalprice, l_orderkey) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def ngon_remap(spark, d):
    return topology.fields_to_faces(_owners(spark, d)[1], parts_mesh(spark, d).cells, "value")


@register("faces_without_cell", "SELECT p_partkey AS face_idx FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def faces_without_cell(spark, d):
    faces = table(spark, d, "part").select(F.col("p_partkey").alias("face_idx"))
    some = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("cell_idx"), F.col("l_partkey").alias("face_idx"))
    return topology.faces_without_cell(faces, some)


@register("signed_faces", "SELECT l_orderkey AS cell_idx, l_partkey AS face_idx, l_returnflag = 'R' AS reversed, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey")
def signed_faces(spark, d):
    li = table(spark, d, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    refs = li.select(F.col("l_orderkey").alias("cell_idx"), (sign * (F.col("l_partkey") + 1)).alias("face"))
    return topology.signed_faces(refs, table(spark, d, "part").select(F.col("p_partkey").alias("face_idx"), "p_retailprice"))


@register("unique_cell_points", "SELECT DISTINCT l_orderkey AS cell_idx, l_partkey AS point_idx FROM lineitem")
def unique_cell_points(spark, d):
    return topology.unique_cell_points(parts_mesh(spark, d).cell_points)


# Integration


@register("streamlines")
def streamlines(spark, d):
    """Lines from event positions through the grid's prices: rotation about the middle, drift by price."""
    nodes = price_grid(spark, d)
    swirl = nodes.select("i", "j", "k", (5 - F.col("j")).cast("double").alias("vx"), ((F.col("i") - 25) / 5).alias("vy"), (F.col("value") / 1e5).alias("vz"))
    seeds = _samples(spark, d).select(F.col("event_id").alias("seed_idx"), *AXES)
    return integrate.streamlines(seeds, swirl, GRID, "both", steps=25)


STRAIGHT = """WITH RECURSIVE s AS (SELECT event_id AS seed_idx, x, y, z FROM (""" + SAMPLES + """) WHERE x >= 1 AND x <= 50 AND y <= 10 AND z <= 8),
d(k, step, far) AS (SELECT 0, CAST(0.2 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT k + 1, least(1.2 * step, 1.0), far + step * sqrt(3.0) FROM d WHERE k < 24),
f AS (SELECT seed_idx, k, x + far AS x, y, z, far AS t FROM s, d WHERE x + far <= 50), b AS (SELECT seed_idx, k, x - far AS x, y, z, -far AS t FROM s, d WHERE x - far >= 1 AND k > 0),
n AS (SELECT seed_idx, count(*) AS n FROM b GROUP BY 1), a AS (SELECT seed_idx, coalesce(n, 0) + k AS seq, x, y, z, t FROM f LEFT JOIN n USING (seed_idx) UNION ALL SELECT seed_idx, n - k, x, y, z, t FROM b JOIN n USING (seed_idx))
SELECT seed_idx, seq, round(x + 1e-9, 4) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, round(t + 1e-9, 4) AS t, CAST(least(floor(x), 49) - 1 + least(floor(y), 9) * 49 + least(floor(z), 7) * 490 AS BIGINT) AS cell_idx FROM a WHERE seed_idx IN (SELECT seed_idx FROM a GROUP BY 1 HAVING count(*) > 1)"""


@register("streamlines_straight", STRAIGHT)
def streamlines_straight(spark, d):
    """A flow along x of varying speed: straight lines whose steps grow until they are a cell long."""
    nodes = grid.grid_points(spark, GRID).join(price_grid(spark, d), ["i", "j", "k"], "left")
    flow = nodes.select("i", "j", "k", F.coalesce("value", F.lit(1.0)).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    seeds = _samples(spark, d).select(F.col("event_id").alias("seed_idx"), *AXES)
    out = integrate.streamlines(seeds, flow, GRID, "both", steps=25)
    return out.select("seed_idx", "seq", F.round(F.col("x") + 1e-9, 4).alias("x"), "y", "z", F.round(F.col("t") + 1e-9, 4).alias("t"), "cell_idx")


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every cell of the grid as a hexahedron, and its points with a flow along x, of the speed of the prices, and a linear field."""
    nodes = grid.grid_points(spark, GRID)
    flow = nodes.join(price_grid(spark, d), ["i", "j", "k"], "left")
    points = flow.select("point_idx", *AXES, F.coalesce("value", F.lit(1.0)).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"), (2 * F.col("x") - 3 * F.col("y") + F.col("z")).alias("linear"))
    return _hexes(nodes), points


def _along(spark: SparkSession, d: str, cells: DataFrame, points: DataFrame) -> DataFrame:
    seeds = _samples(spark, d).select(F.col("event_id").alias("seed_idx"), *AXES)
    out = integrate.mesh_streamlines(seeds, cells, points, ["vx", "vy", "vz"], "both", fields=("linear",), steps=25)
    return out.select("seed_idx", "seq", F.round(F.col("x") + 1e-9, 4).alias("x"), "y", "z", F.round(F.col("t") + 1e-9, 4).alias("t"), F.round(F.col("linear") + 1e-7, 4).alias("linear"), "cell_idx")


#: As STRAIGHT, with a linear field; a position on a face belongs to the smallest cell.
STRAIGHT_MESH = "SELECT seed_idx, seq, x, y, z, t, round(2 * raw - 3 * y + z + 1e-7, 4) AS linear{cell} FROM (" + STRAIGHT.replace("SELECT seed_idx, seq, round(x + 1e-9, 4) AS x", "SELECT seed_idx, seq, x AS raw, round(x + 1e-9, 4) AS x") + ")"
LEAST_CELL = ", CAST(greatest(ceil(raw - 1e-6) - 1, 1) - 1 + greatest(ceil(y - 1e-6) - 1, 0) * 49 + greatest(ceil(z - 1e-6) - 1, 0) * 490 AS BIGINT) AS cell_idx"


@register("streamlines_in_hexahedra", STRAIGHT_MESH.format(cell=LEAST_CELL))
def streamlines_in_hexahedra(spark, d):
    """The flow of streamlines_straight in a mesh: the grid written as cells."""
    return _along(spark, d, *_flow(spark, d))


@register("streamlines_in_tetrahedra", STRAIGHT_MESH.format(cell=""))
def streamlines_in_tetrahedra(spark, d):
    """The same with each cell as six tetrahedra."""
    cells, points = _flow(spark, d)
    hexa = {0: 0, 1: 1, 3: 2, 2: 3, 4: 4, 5: 5, 7: 6, 6: 7}  # a corner's place in a hexahedron by its bits i, j, k
    six = F.array(*[F.array(*[F.get("pts", F.lit(hexa[n])) for n in t]) for t in SIX])
    tetra = cells.select("cell_idx", F.posexplode(six).alias("m", "pts")).select((F.col("cell_idx") * 6 + F.col("m")).alias("cell_idx"), F.lit(spatial.TETRA).alias("cell_type"), "pts")
    return _along(spark, d, tetra, points).drop("cell_idx")


# Views


@register("points_view", f"SELECT point_idx, x, y, z, round((least(greatest(y, 900.0), 1000.0) - 900.0) / 100.0 * 4.0 + 1.0, 6) AS width FROM (SELECT *, row_number() OVER (ORDER BY point_idx) - 1 AS r, count(*) OVER () AS n FROM ({POINTS}) WHERE point_idx IN (SELECT l_partkey FROM lineitem)) WHERE r % CAST(ceil(n / 500.0) AS BIGINT) = 0")
def points_view(spark, d):
    return rounded(views.points_view(parts_mesh(spark, d), "y", (900, 1000), (1, 5), 500), "width", digits=6)


@register("glyphs", f"WITH u AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ({POINTS}) WHERE point_idx IN (SELECT l_partkey FROM lineitem)) SELECT point_idx, round((least(greatest(x, 0.0), 50.0)) / 50.0, 6) AS scale, round((x / n + 1) / sqrt(pow(x / n + 1, 2) + pow(y / n, 2) + pow(z / n, 2)), 6) AS qw FROM u")
def glyphs(spark, d):
    out = views.glyphs(parts_mesh(spark, d), AXES, "x", (0, 50), (0, 1))
    return out.select("point_idx", F.round("scale", 6).alias("scale"), F.round(F.col("orientation")[3], 6).alias("qw"))


@register("faces_with_fields", FACES_SQL + f" SELECT f.cell_idx, local_face, round(n.value + 1e-7, 2) AS value FROM f JOIN (SELECT (i - 1) + j * 49 + k * 490 AS cell_idx, value FROM ({NODES}) WHERE i <= 49 AND j <= 9 AND k <= 7) n USING (cell_idx)")
def faces_with_fields(spark, d):
    nodes = price_grid(spark, d)
    fields = nodes.where("i <= 49 and j <= 9 and k <= 7").select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.cell_dims).alias("cell_idx"), "value")
    return views.faces(_hexes(nodes), fields).select("cell_idx", "local_face", F.round(F.col("value") + 1e-7, 2).alias("value"))


@register("emitter_scale", f"SELECT round(d / f, 6) AS scale, round(f, 4) AS fastest, round(d, 4) AS diagonal FROM (SELECT sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS d, max(sqrt(x * x + z * z)) AS f FROM ({POINTS}))")
def emitter_scale(spark, d):
    out = views.emitter(parts_mesh(spark, d), ["x", "z"])
    return out.select(F.round("scale", 6).alias("scale"), F.round("fastest", 4).alias("fastest"), F.round("diagonal", 4).alias("diagonal"))


@register("dangling", "SELECT DISTINCT l_orderkey AS cell_idx, l_partkey AS point_idx FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dangling(spark, d):
    """A mesh whose small points and whose cells of one state were lost."""
    mesh = parts_mesh(spark, d)
    kept = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("cell_idx"))
    return views.dangling(views.validated(mesh.with_points(mesh.points.where("x > 5")).with_cells(mesh.cells.join(kept, "cell_idx"))))


@register("gaussian_voxels", _near(3.0, "sum(exp(-4.0 / 9.0 * d * d) * value) / sum(exp(-4.0 / 9.0 * d * d))").replace(CENTRES, "SELECT i, j, k, i * 1.5 AS x, j * 1.5 AS y, k * 1.5 AS z FROM range(0, 12) AS a(i), range(0, 20) AS b(j), range(0, 16) AS c(k)"))
def gaussian_voxels(spark, d):
    out = views.gaussian_voxels(events_cloud(spark, d), (0, 0, 0), (11, 19, 15), 1.5)
    return rounded(out.drop("weight"), "value", digits=3)


@register("locate_in_hexahedra", "WITH n AS (SELECT i, j, k FROM (" + NODES + ") WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (SELECT event_id, x, y, z, (y - 0.25 * z) AS v FROM (" + SAMPLES + ")) SELECT event_id, min(i - 1 + j * 49 + k * 490) AS cell_idx, round(2 * x - 3 * y + z, 4) AS value FROM s JOIN n ON x - i BETWEEN -1e-6 AND 1 + 1e-6 AND v - j BETWEEN -1e-6 AND 1 + 1e-6 AND z - k BETWEEN -1e-6 AND 1 + 1e-6 GROUP BY event_id, x, y, z")
def locate_in_hexahedra(spark, d):
    """Cells of the grid sheared along y by a quarter of z, with a linear field."""
    nodes = price_grid(spark, d).where("i <= 49 and j <= 9 and k <= 7")
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    at = [((F.col("i") + a).cast("double"), F.col("j") + b + (F.col("k") + c) / 4, (F.col("k") + c).cast("double")) for a, b, c in corners]
    cells = nodes.select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.cell_dims).alias("cell_idx"), F.lit(spatial.HEXAHEDRON).alias("cell_type"), F.array(*[spatial.corner(n, p, 2 * p[0] - 3 * p[1] + p[2]) for n, p in enumerate(at)]).alias("corners"))
    out = spatial.located(_samples(spark, d), "event_id", cells, 1)
    return out.select("event_id", "cell_idx", F.round(F.get("values", F.lit(0)), 4).alias("value"))


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hexahedra of the grid (cell_idx, cell_type, pts) and its points with a linear field."""
    points = grid.grid_points(spark, GRID).select("point_idx", *AXES, (2 * F.col("x") - 3 * F.col("y") + F.col("z")).alias("value"))
    return Scratch(spark, "boxes").write(_hexes(price_grid(spark, d)), "cells"), points  # once: several plans select among them


def _cell_prices(spark: SparkSession, d: str) -> DataFrame:
    """The mean price of each hexahedron's first corner."""
    nodes = price_grid(spark, d).where("i <= 49 and j <= 9 and k <= 7")
    return nodes.select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.cell_dims).alias("cell_idx"), "value")


BOXES_SQL = "WITH n AS (SELECT i, j, k FROM (" + NODES + ") WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (" + SAMPLES + ") SELECT event_id, {cell} AS cell_idx, 1 AS mask, round(2 * x - 3 * y + z + 1e-7, 4) AS value FROM s JOIN n ON x - i BETWEEN -1e-6 AND 1 + 1e-6 AND y - j BETWEEN -1e-6 AND 1 + 1e-6 AND z - k BETWEEN -1e-6 AND 1 + 1e-6 GROUP BY event_id, x, y, z"


def _probed(df: DataFrame) -> DataFrame:
    return df.where("mask = 1").select("event_id", "cell_idx", "mask", F.round(F.col("value") + 1e-7, 4).alias("value"))


@register("probe_polyhedra", BOXES_SQL.format(cell="min(i - 1 + j * 49 + k * 490)"))
def probe_polyhedra(spark, d):
    """The grid's cells as polyhedra of six faces."""
    cells, points = _boxes(spark, d)
    faces = topology.cell_faces(cells).withColumnRenamed("local_face", "face_idx")
    solid = cells.withColumn("cell_type", F.lit(mesh_probe.POLYHEDRON))
    return _probed(mesh_probe.probe_mesh(_samples(spark, d), "event_id", solid, points, faces))


@register("probe_mixed_cells", BOXES_SQL.format(cell="min(i - 1 + j * 49 + k * 490)"))
def probe_mixed_cells(spark, d):
    """A mesh of hexahedra, voxels and polyhedra, by the cell's number."""
    cells, points = _boxes(spark, d)
    kind = F.element_at(F.array(*[F.lit(k) for k in (mesh_probe.HEXAHEDRON, mesh_probe.VOXEL, mesh_probe.POLYHEDRON)]), (F.col("cell_idx") % 3 + 1).cast("int"))
    mixed = cells.withColumn("cell_type", kind)
    swapped = F.transform(F.array(*[F.lit(n) for n in (0, 1, 3, 2, 4, 5, 7, 6)]), lambda n: F.get("pts", n))
    faces = topology.cell_faces(cells.where(kind == mesh_probe.POLYHEDRON)).withColumnRenamed("local_face", "face_idx")
    mixed = mixed.withColumn("pts", F.when(F.col("cell_type") == mesh_probe.VOXEL, swapped).otherwise(F.col("pts")))
    return _probed(mesh_probe.probe_mesh(_samples(spark, d), "event_id", mixed, points, faces))


@register("collection_probe", "WITH n AS (SELECT i, j, k FROM (" + NODES + ") WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (" + SAMPLES + "), h AS (SELECT event_id, x, y, z, CAST(CASE WHEN i > 30 THEN 0 ELSE 1 END AS INT) AS piece_id, i - 1 + j * 49 + k * 490 AS cell_idx FROM s JOIN n ON x - i BETWEEN -1e-6 AND 1 + 1e-6 AND y - j BETWEEN -1e-6 AND 1 + 1e-6 AND z - k BETWEEN -1e-6 AND 1 + 1e-6) SELECT event_id, min(piece_id) AS piece_id, min(cell_idx) FILTER (WHERE piece_id = p) AS cell_idx FROM (SELECT *, min(piece_id) OVER (PARTITION BY event_id) AS p FROM h) GROUP BY event_id")
def collection_probe(spark, d):
    """Two pieces that share a face; the first that holds a sample answers."""
    cells, points = _boxes(spark, d)
    first = (F.col("cell_idx") % 49) + 1 > 30
    pieces = [mesh_probe.probe_mesh(_samples(spark, d), "event_id", cells.where(c), points) for c in (first, ~first)]
    return mesh_probe.first_piece(pieces, "event_id").select("event_id", "piece_id", "cell_idx")


VOXEL_MESH = "WITH n AS (SELECT i, j, k, value FROM (" + NODES + ") WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (SELECT i, j, k, {at} AS x, {at} AS y, {at} AS z FROM range(0, {i}) AS a(i), range(0, {j}) AS b(j), range(0, {k}) AS c(k)), h AS (SELECT s.i, s.j, s.k, x, y, z, arg_min(n.value, n.i - 1 + n.j * 49 + n.k * 490) AS held FROM s JOIN n ON x - n.i BETWEEN -1e-6 AND 1 + 1e-6 AND y - n.j BETWEEN -1e-6 AND 1 + 1e-6 AND z - n.k BETWEEN -1e-6 AND 1 + 1e-6 GROUP BY ALL) SELECT s.i, s.j, s.k, CASE WHEN h.i IS NULL THEN 0 ELSE 1 END AS mask, round(CASE WHEN h.i IS NULL THEN {outside} ELSE {value} END + 1e-7, 2) AS value FROM s LEFT JOIN h USING (i, j, k)"


def _voxel_sql(at: str, dims: tuple[int, int, int], outside: str, value: str) -> str:
    i, j, k = dims
    sql = VOXEL_MESH.format(at="{at}", i=i, j=j, k=k, outside=outside, value=value)
    for axis in "ijk":
        sql = sql.replace("{at}", at.format(axis), 1)
    return sql


@register("voxels_of_hexahedra", _voxel_sql("({} + 0.5) * 0.7", (76, 18, 14), "-28.0", "2 * h.x - 3 * h.y + h.z"))
def voxels_of_hexahedra(spark, d):
    """A linear point field of a mesh at the centres of voxels; outside, its minimum."""
    out = mesh_probe.voxelize(*_boxes(spark, d), (0, 0, 0), (75, 17, 13), (0.7, 0.7, 0.7))
    return out.select("i", "j", "k", "mask", F.round(F.col("value") + 1e-7, 2).alias("value"))


@register("voxels_of_polyhedra", _voxel_sql("{} * 0.75", (70, 16, 13), "0.0", "h.held"))
def voxels_of_polyhedra(spark, d):
    """The mean price of cells of six faces at the corners of voxels."""
    cells, points = _boxes(spark, d)
    faces = topology.cell_faces(cells).withColumnRenamed("local_face", "face_idx")
    value = _cell_prices(spark, d)
    solid = cells.withColumn("cell_type", F.lit(spatial.POLYHEDRON)).join(value, "cell_idx")
    out = mesh_probe.voxelize(solid, points, (0, 0, 0), (69, 15, 12), (0.75, 0.75, 0.75), "point", faces, 0.0, "value", True)
    return out.select("i", "j", "k", "mask", F.round(F.col("value") + 1e-7, 2).alias("value"))


@register("slice_xyz_mesh", "WITH n AS (SELECT i, j, k FROM (" + NODES + ") WHERE i <= 49 AND j <= 9 AND k <= 7), s AS (" + PLANES + "), h AS (SELECT slice, col, \"row\", x, y, z, min(i - 1 + j * 49 + k * 490) AS cell_idx FROM s JOIN n ON x - i BETWEEN -1e-6 AND 1 + 1e-6 AND y - j BETWEEN -1e-6 AND 1 + 1e-6 AND z - k BETWEEN -1e-6 AND 1 + 1e-6 GROUP BY ALL) SELECT s.slice, s.col, s.\"row\", h.cell_idx, CASE WHEN h.cell_idx IS NULL THEN 0 ELSE 1 END AS mask, round(coalesce(2 * h.x - 3 * h.y + h.z, 0.0) + 1e-7, 4) AS value FROM s LEFT JOIN h USING (slice, col, \"row\")")
def slice_xyz_mesh(spark, d):
    """Three planes through a mesh of hexahedra, of which only the cut cells are met."""
    out = mesh_probe.slices(*_boxes(spark, d), "xyz", (25.3, 5.2, 3.25), 24, 24)
    return out.withColumn("value", F.round(F.col("value") + 1e-7, 4))


@register("probe_cells_of_mesh", BOXES_SQL.replace("SELECT i, j, k FROM", "SELECT i, j, k, value FROM").replace("round(2 * x - 3 * y + z + 1e-7, 4) AS value", "round(arg_min(n.value, i - 1 + j * 49 + k * 490) + 1e-7, 2) AS value").format(cell="min(i - 1 + j * 49 + k * 490)"))
def probe_cells_of_mesh(spark, d):
    """The mean price of the hexahedron that holds a sample."""
    cells, points = _boxes(spark, d)
    value = _cell_prices(spark, d)
    out = mesh_probe.probe_cells(_samples(spark, d), "event_id", cells.join(value, "cell_idx"), points, "value")
    return out.where("mask = 1").select("event_id", "cell_idx", "mask", F.round(F.col("value") + 1e-7, 2).alias("value"))


@register("face_orientation", FACES_SQL + ", o AS (SELECT *, CASE WHEN cell_idx % 2 = 0 THEN 1 ELSE -1 END AS orientation FROM f), g AS (SELECT cell_idx, local_face, orientation, p[1] % 50 + p[2] % 50 + p[3] % 50 + p[4] % 50 AS sx FROM o) SELECT cell_idx, local_face, orientation, round(1 + sx / 4.0, 4) AS center_x FROM g")
def face_orientation(spark, d):
    """Faces of every second cell turned around: their centres, and which of them point outwards."""
    cells, points = _boxes(spark, d)
    faces = topology.cell_faces(cells)
    faces = faces.withColumn("face_pts", F.when(F.col("cell_idx") % 2 == 0, F.col("face_pts")).otherwise(F.reverse("face_pts")))
    return topology.oriented_faces(faces, points).select("cell_idx", "local_face", "orientation", F.round("center_x", 4).alias("center_x"))


@register("faces_in_time", FACES_SQL + f", e AS (SELECT CAST(l_quantity AS BIGINT) - 1 + CAST(round(l_discount * 100) AS BIGINT) * 49 + CAST(round(l_tax * 100) AS BIGINT) * 490 AS cell_idx, avg(l_extendedprice) FILTER (WHERE l_linenumber <= 2) AS a, avg(l_extendedprice) FILTER (WHERE l_linenumber > 2) AS b FROM lineitem WHERE l_quantity <= 49 AND round(l_discount * 100) <= 9 AND round(l_tax * 100) <= 7 GROUP BY 1) SELECT f.cell_idx, local_face, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, CAST(1 + unnest(p) % 50 AS DOUBLE) AS x, round(a + (b - a) * 0.25 + 1e-7, 2) AS value FROM f JOIN e USING (cell_idx) WHERE a IS NOT NULL AND b IS NOT NULL")
def faces_in_time(spark, d):
    """A mesh that stays while its cell field moves from one sample to the next."""
    li = table(spark, d, "lineitem").where("l_quantity <= 49 and round(l_discount * 100) <= 9 and round(l_tax * 100) <= 7")
    cell = (F.col("l_quantity").cast("long") - 1) + F.round(F.col("l_discount") * 100).cast("long") * 49 + F.round(F.col("l_tax") * 100).cast("long") * 490
    values = li.groupBy(cell.alias("cell_idx"), F.when(F.col("l_linenumber") <= 2, 10.0).otherwise(20.0).alias("t")).agg(F.avg("l_extendedprice").alias("value"))
    cells, points = _boxes(spark, d)
    out = views.faces_at(cells, points.drop("value").withColumn("t", F.lit(0.0)), values, "t", 12.5, "value")
    return out.select("cell_idx", "local_face", "pos", "x", F.round(F.col("value") + 1e-7, 2).alias("value"))


# Wedges and pyramids


@register("probe_wedges_and_pyramids", "SELECT event_id, cell_idx, mask, value FROM (" + BOXES_SQL.format(cell="min(i - 1 + j * 49 + k * 490)") + ")")
def probe_wedges_and_pyramids(spark, d):
    """Every even cell of the grid as two wedges, every odd one as six pyramids around its middle."""
    cells, points = _boxes(spark, d)
    n = points.count()
    at = lambda *corners: F.array(*[F.get("pts", F.lit(c)) for c in corners])
    wedges = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(spatial.WEDGE).alias("cell_type"), at(*c).alias("pts")) for m, c in enumerate(((0, 1, 2, 4, 5, 6), (0, 2, 3, 4, 6, 7)))])
    apex = (F.col("cell_idx") + F.lit(n)).cast("long")
    sides = ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (3, 7, 6, 2), (0, 4, 7, 3), (1, 2, 6, 5))
    pyramids = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(spatial.PYRAMID).alias("cell_type"), F.array_append(at(*c), apex).alias("pts")) for m, c in enumerate(sides)])
    split = cells.select("cell_idx", F.explode(F.when(F.col("cell_idx") % 2 == 0, wedges).otherwise(pyramids)).alias("s"))
    middle = cells.where("cell_idx % 2 = 1").select("cell_idx", F.explode("pts").alias("point_idx")).join(points, "point_idx").groupBy("cell_idx").agg(*[F.avg(c).alias(c) for c in (*AXES, "value")])
    every = points.unionByName(middle.select(apex.alias("point_idx"), *AXES, "value"))
    parts = split.select((F.col("cell_idx") * 6 + F.col("s.m")).alias("cell_idx"), "s.cell_type", "s.pts")
    out = mesh_probe.probe_mesh(_samples(spark, d), "event_id", parts, every)
    return _probed(out.withColumn("cell_idx", F.floor(F.col("cell_idx") / 6)))


# Fields of several kinds, grids as cells, panels


@register("probe_two_fields", "SELECT a.event_id, a.mask, a.value AS price, b.value AS quantity FROM (" + _probe_sql(SAMPLES, "event_id", "0.0") + ") a JOIN (" + _probe_sql(SAMPLES, "event_id", "0.0").replace("avg(l_extendedprice)", "CAST(count(*) AS DOUBLE)").replace("END, 2) AS value", "END + 1e-7, 2) AS value") + ") b USING (event_id)")
def probe_two_fields(spark, d):
    """Two fields of the grid's nodes at one location of each sample."""
    li = table(spark, d, "lineitem")
    node = [F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("k")]
    nodes = li.groupBy(*node).agg(F.avg("l_extendedprice").alias("price"), F.count("*").cast("double").alias("quantity"))
    out = grid.probe(_samples(spark, d), nodes, GRID, ["price", "quantity"])
    return out.select("event_id", "mask", F.round("probed_price", 2).alias("price"), F.round(F.col("probed_quantity") + 1e-7, 2).alias("quantity"))


@register("grid_links", "SELECT n.i - 1 + n.j * 50 + n.k * 550 AS point_idx, count(*) AS cells, min(c.i - 1 + c.j * 49 + c.k * 490) AS first_cell, CAST(sum(c.i - 1 + c.j * 49 + c.k * 490) AS BIGINT) AS sum_cells FROM (" + NODES + ") n, (SELECT a.i, b.j, c.k FROM range(1, 50) AS a(i), range(10) AS b(j), range(8) AS c(k)) c WHERE c.i BETWEEN n.i - 1 AND n.i AND c.j BETWEEN n.j - 1 AND n.j AND c.k BETWEEN n.k - 1 AND n.k GROUP BY 1")
def grid_links(spark, d):
    """The cells around each priced node, by arithmetic on the grid."""
    nodes = price_grid(spark, d).select(grid.linear(F.col("i") - 1, F.col("j"), F.col("k"), GRID.point_dims).alias("point_idx"))
    links = grid.point_links(spark, GRID).join(nodes, "point_idx")
    return links.groupBy("point_idx").agg(F.count("*").alias("cells"), F.min("cell_idx").alias("first_cell"), F.sum("cell_idx").alias("sum_cells"))


@register("mesh_export", FACES_SQL + ", h8 AS (SELECT cell_idx, o, [o, o + 1, o + 51, o + 50, o + 550, o + 551, o + 601, o + 600] AS p FROM h) SELECT cell_idx, array_to_string(p, ',') AS pts FROM h8")
def mesh_export(spark, d):
    """Point lists of cells from their incidence."""
    cells, points = _boxes(spark, d)
    flat = cells.select("cell_idx", F.posexplode("pts").alias("local_idx", "point_idx"))
    out = topology.unstructured(points, flat)
    return out.select("cell_idx", F.array_join(F.transform("pts", lambda p: p.cast("string")), ",").alias("pts"))


@register("boundary_patch", "SELECT o_orderkey AS face_idx, l_partkey AS point_idx FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey BETWEEN 100 AND 499")
def boundary_patch(spark, d):
    """Orders as faces of which a contiguous range is a patch."""
    faces = table(spark, d, "orders").select(F.col("o_orderkey").alias("face_idx"))
    corners = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("face_idx"), F.col("l_partkey").alias("point_idx"))
    return select.boundary_patch(faces, 100, 400).join(corners, "face_idx")


@register("cloud_of_mesh", f"SELECT point_idx, x, y, z, round(coalesce(v, 0.0) + 1e-7, 4) AS value FROM ({POINTS}) JOIN (SELECT l_partkey, avg(o_totalprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON point_idx = l_partkey")
def cloud_of_mesh(spark, d):
    """The used points of a mesh with a cell field moved to them."""
    out = views.point_cloud(parts_mesh(spark, d), ("value",), used_only=True)
    return out.select("point_idx", *AXES, F.round(F.col("value") + 1e-7, 4).alias("value"))


@register("field_modes", "SELECT o_orderkey AS idx, CAST(o_custkey AS DOUBLE) AS component, round(sqrt(o_totalprice * o_totalprice + o_custkey * o_custkey), 4) AS magnitude, CAST(o_totalprice AS DOUBLE) AS first, CAST(CAST(o_totalprice AS INT) AS BIGINT) AS whole FROM (SELECT *, o_totalprice FROM orders)".replace("CAST(CAST(o_totalprice AS INT) AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"))
def field_modes(spark, d):
    """A field of two columns as a component, as its magnitude and as a vector cast to whole numbers."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    both = V.vector_field(dict(o.dtypes), ["a", "b"], 2)
    return o.select(
        "idx",
        views.field(o, ["a", "b"], "selected component", 1).alias("component"),
        F.round(views.field(o, ["a", "b"], "vector magnitude"), 4).alias("magnitude"),
        V.scalarize(F.slice(both, 1, 1), 1).alias("first"),
        V.component(V.cast_vector(both, "long"), 0).cast("long").alias("whole"),
    )


@register("locked_time", "WITH e AS (SELECT user_id, epoch(ts) AS t, value FROM events), r AS (SELECT user_id, max(t) FILTER (WHERE t <= 1704500000) AS lo, min(t) AS first FROM e GROUP BY 1) SELECT r.user_id, CAST(coalesce(lo, first) AS DOUBLE) AS t, e.value FROM r JOIN e ON e.user_id = r.user_id AND e.t = coalesce(lo, first)")
def locked_time(spark, d):
    """The sample of each user at one locked time, whatever time was asked for."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value").select("user_id", (F.col("us") / 1e6).alias("t"), "value")
    asked = e.groupBy("user_id").agg(F.max("t").alias("t"))
    known = e.select("user_id", "t")
    found = temporal.snap_down(temporal.locked(asked, "t", 1704500000.0), known, "user_id", "t", 86400.0)
    return found.select("user_id", F.col("snapped").alias("t")).join(e, ["user_id", "t"])


@register("field_panel", "WITH v AS (SELECT 'o_totalprice' AS field, o_totalprice AS x FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders), r AS (SELECT field, min(x) AS lo, max(x) AS hi FROM v GROUP BY 1), b AS (SELECT field, CAST(floor((x - lo) * (1.0 / ((hi - lo) / 16))) AS INT) AS bin FROM v JOIN r USING (field) WHERE (x - lo) * (1.0 / ((hi - lo) / 16)) < 16), z AS (SELECT field, CAST(n AS INT) AS bin FROM r, range(16) AS q(n)) SELECT z.field, z.bin, count(b.bin) AS n FROM z LEFT JOIN b USING (field, bin) GROUP BY 1, 2")
def field_panel(spark, d):
    """Histograms of two fields in one pass after one for their ranges."""
    return views.field_panel(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], 16)[1]


#: Cubes of a fifteenth of the longest side, 49: sixteen layers would cut one more, so the view's own size is one of fifteen.
VIEW = "SELECT i, j, k, (i + 0.5) * (49.0 / 15) AS x, (j + 0.5) * (49.0 / 15) AS y, (k + 0.5) * (49.0 / 15) AS z FROM range(0, 16) AS a(i), range(-1, 4) AS b(j), range(-1, 3) AS c(k)"


@register("volume_view", _probe_sql(VIEW, "i, j, k", "-1.0").replace("SELECT i, j, k, mask, ci + a AS i", "SELECT i AS vi, j AS vj, k AS vk, mask, ci + a AS i").replace("p AS (SELECT i, j, k, mask", "p AS (SELECT vi, vj, vk, mask").replace("SELECT i, j, k, mask, round", "SELECT vi AS i, vj AS j, vk AS k, mask, round"))
def volume_view(spark, d):
    """The price grid as voxels of a view, at most sixteen along an axis."""
    voxels, _ = views.volume(price_grid(spark, d), GRID, 16, background=-1.0)
    return voxels.select("i", "j", "k", "mask", F.round("value", 2).alias("value"))
