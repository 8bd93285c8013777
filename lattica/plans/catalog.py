"""The mesh queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..celltypes import EDGES, FACETS, SIMPLICES
from ..mesh import CELL_KEYS, MeshFrame
from ..operators import data as D
from ..operators import filters as C
from ..operators import generate as N
from ..operators import geometry as G
from ..operators import ordering as O
from ..operators import regions as R
from ..operators import spatial as S
from ..operators import temporal as P
from ..operators import topology as Y
from .meshes import cloud, lattice, lattice_sql, order_mesh, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIMS = (6, 5, 4)
HEX = lattice_sql(*DIMS)
QUAD = lattice_sql(7, 6, None)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums depend on the order of the rows."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def part_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_mesh(spark, sf_dir).points.select("mesh_id", "point_id", "p_size", "p_retailprice")


# Arrays


@query("SELECT p_partkey AS point_id, round(sqrt(p_retailprice) + 2 * greatest(p_size::DOUBLE, 20.0) / (p_size + 1), 6) AS v FROM part")
def data_calc(spark, d):
    return rounded(D.data_calc(part_arrays(spark, d), "v", "sqrt(p_retailprice) + 2 * max(p_size, 20) / (p_size + 1)").select("point_id", "v"))


@query("SELECT p_partkey AS point_id, CASE WHEN p_size = 10 THEN 'inf' WHEN p_size < 10 THEN 'less' ELSE 'more' END AS v FROM part")
def data_calc_division(spark, d):
    v = D.data_calc(part_arrays(spark, d), "v", "1 / (p_size - 10)")
    inf = F.col("v") == float("inf")
    return v.select("point_id", F.when(inf, "inf").when(F.col("v") < 0, "less").otherwise("more").alias("v"))


@query("SELECT p_partkey AS point_id, p_size AS p_retailprice, p_retailprice AS p_size FROM part")
def data_manage(spark, d):
    return D.data_manage(part_arrays(spark, d), keep=["p_size", "p_retailprice"], rename={"p_size": "p_retailprice", "p_retailprice": "p_size"}).drop("mesh_id")


@query("SELECT p_partkey AS point_id, p_size FROM part")
def data_keep(spark, d):
    return D.data_keep(part_arrays(spark, d), ["p_size"]).drop("mesh_id")


@query("SELECT p_partkey AS point_id, p_retailprice FROM part")
def data_drop(spark, d):
    return D.data_drop(part_arrays(spark, d), ["p_size"]).drop("mesh_id")


@query("SELECT p_partkey AS point_id, p_size AS size, p_retailprice FROM part")
def data_rename(spark, d):
    return D.data_rename(part_arrays(spark, d), {"p_size": "size"}).drop("mesh_id")


@query("""
SELECT name, 'point' AS location, count(*) AS entries, count(v) AS num_finite, 0::BIGINT AS num_nan, 0::BIGINT AS num_inf, round(min(v), 6) AS least, round(max(v), 6) AS greatest, round(avg(v), 6) AS mean
FROM (SELECT 'p_size' AS name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY name""")
def data_info(spark, d):
    return rounded(D.data_info(part_arrays(spark, d), "point"))


@query("""
SELECT 'v' AS name, 'cell' AS location, count(*) AS entries, count(CASE WHEN o_orderkey % 17 > 1 THEN 1 END) AS num_finite, count(CASE WHEN o_orderkey % 17 = 0 THEN 1 END) AS num_nan,
  count(CASE WHEN o_orderkey % 17 = 1 THEN 1 END) AS num_inf, round(min(CASE WHEN o_orderkey % 17 > 1 THEN o_totalprice END), 6) AS least, round(max(CASE WHEN o_orderkey % 17 > 1 THEN o_totalprice END), 6) AS greatest,
  round(avg(CASE WHEN o_orderkey % 17 > 1 THEN o_totalprice END), 4) AS mean FROM orders""")
def data_info_not_finite(spark, d):
    k = F.col("o_orderkey") % 17
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("o_totalprice"))
    out = D.data_info(table(spark, d, "orders").select(v.alias("v")), "cell", ["v"])
    return rounded(out.withColumn("mean", F.round("mean", 4)))


@query("SELECT p_partkey AS point_id, least(greatest(p_retailprice, 950.0), 1500.0) AS p_retailprice FROM part")
def data_condition_clamp(spark, d):
    return D.data_condition(part_arrays(spark, d), "p_retailprice", "clamp", 950, 1500).select("point_id", "p_retailprice")


@query("SELECT p_partkey AS point_id, round(-1 + 2 * (p_retailprice - lo) / (hi - lo), 6) AS v FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)")
def data_condition_normalize(spark, d):
    return rounded(D.data_condition(part_arrays(spark, d), "p_retailprice", "normalize", -1, 1, "v").select("point_id", "v"))


@query("SELECT p_partkey AS point_id, round((p_retailprice - m) / s, 6) AS v FROM part, (SELECT avg(p_retailprice) m, stddev_pop(p_retailprice) s FROM part)")
def data_condition_standardize(spark, d):
    return rounded(D.data_condition(part_arrays(spark, d), "p_retailprice", "standardize", output="v").select("point_id", "v"))


@query("SELECT o_orderkey AS cell_id, CASE WHEN o_orderkey % 17 = 0 THEN -1.0 ELSE o_totalprice END AS v FROM orders")
def nan_policy_replace(spark, d):
    v = F.when(F.col("o_orderkey") % 17 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return D.nan_policy(table(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), v.alias("v")), "v", "replace", -1.0)


@query("SELECT l_orderkey AS cell_id, round(avg(p_retailprice), 6) AS p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def point_data_to_cell_data(spark, d):
    return rounded(D.point_data_to_cell_data(order_mesh(spark, d), ["p_retailprice"]).drop("mesh_id"))


@query("SELECT l_partkey AS point_id, round(avg(o_totalprice), 6) AS o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def cell_data_to_point_data(spark, d):
    return rounded(D.cell_data_to_point_data(order_mesh(spark, d), ["o_totalprice"]).drop("mesh_id"))


@query("SELECT l_partkey AS point_id, round(sum(o_custkey * o_totalprice) / sum(o_totalprice), 4) AS o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def cell_data_to_point_data_weighted(spark, d):
    return rounded(D.cell_data_to_point_data(order_mesh(spark, d), ["o_custkey"], weight="o_totalprice").drop("mesh_id"), 4)


@query("""
WITH r AS (SELECT NULL AS region, o_totalprice v, o_custkey m FROM orders UNION ALL SELECT o_orderstatus, o_totalprice, o_custkey FROM orders UNION ALL SELECT o_orderpriority, o_totalprice, o_custkey FROM orders)
SELECT region, 'o_totalprice' AS name, round(sum(v * m) / 1e6, 3) AS total, round(sum(v * m) / sum(m), 5) AS mean, sum(m)::DOUBLE AS measure, 0::BIGINT AS num_nan FROM r GROUP BY region""")
def data_integrate(spark, d):
    cells = table(spark, d, "orders").select(F.lit("orders").alias("mesh_id"), F.col("o_orderkey").alias("cell_id"), "o_totalprice", F.col("o_custkey").alias("measure"))
    out = D.data_integrate(cells, ["o_totalprice"], regions=order_mesh(spark, d).regions).drop("mesh_id")
    return out.withColumns({"total": F.round(F.col("total") / 1e6, 3), "mean": F.round("mean", 5)})


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round((xx + yy + zz) / 3, 6) AS hydrostatic, round(sqrt(0.5 * ((xx - yy) ** 2 + (yy - zz) ** 2 + (zz - xx) ** 2) + 3 * (xy * xy + yz * yz + zx * zx)), 5) AS von_mises,
  round(xx + yy + zz, 5) AS trace
FROM (SELECT *, l_quantity xx, l_discount * 100 yy, l_tax * 50 zz, l_discount xy, l_tax yz, l_quantity / 10 zx FROM lineitem)""")
def tensor_invariants(spark, d):
    t = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("xx"), (F.col("l_discount") * 100).alias("yy"), (F.col("l_tax") * 50).alias("zz"), F.col("l_discount").alias("xy"), F.col("l_tax").alias("yz"), (F.col("l_quantity") / 10).alias("zx")
    )
    out = D.tensor_invariants(t, ["xx", "yy", "zz", "xy", "yz", "zx"])
    trace = F.col("principal_1") + F.col("principal_2") + F.col("principal_3")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("hydrostatic", 6).alias("hydrostatic"), F.round("von_mises", 5).alias("von_mises"), F.round(trace, 5).alias("trace"))


@query("SELECT p_partkey AS point_id, floor(least(floor(t * 8), 7.0) * 255 / 8 + 255 / 16.0 + 0.5)::INT AS red FROM (SELECT *, least(greatest((p_size - 5) / 40.0, 0.0), 1.0) t FROM part)")
def colorize(spark, d):
    return D.colorize(part_arrays(spark, d), "p_size", 5, 45, "gray", 8).select("point_id", "red")


@query("""
SELECT name, 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(CASE WHEN d THEN 1 END) AS violations, count(CASE WHEN d THEN 1 END) AS inexact, round(max(e), 6) AS max_abs_error FROM (
  SELECT 'p_retailprice' AS name, p_partkey % 10 = 0 AS d, CASE WHEN p_partkey % 10 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS e FROM part UNION ALL SELECT 'p_size', false, 0.0::DOUBLE FROM part) GROUP BY name""")
def diff_ordered(spark, d):
    a = part_arrays(spark, d)
    b = a.withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("point_id") % 10 == 0, 0.5).otherwise(0.0))
    return rounded(D.compare_arrays(a, b, ["mesh_id", "point_id"], ["p_size", "p_retailprice"]))


@query("SELECT 'equal within tolerance' AS verdict")
def meshes_equal(spark, d):
    a = part_arrays(spark, d)
    b = a.withColumn("p_retailprice", F.col("p_retailprice") * (1 + 1e-12))
    return D.verdict(D.compare_arrays(a, b, ["mesh_id", "point_id"], ["p_size", "p_retailprice"]))


@query("SELECT bin, count(*) AS n FROM (SELECT least(floor((p_retailprice - lo) / (hi - lo) * 10), 9)::INT AS bin FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)) GROUP BY bin")
def histogram(spark, d):
    return D.histogram(part_arrays(spark, d), "p_retailprice")


# Regions

REGION_ROWS = "(SELECT o_orderstatus AS name, o_orderkey AS entity FROM orders UNION ALL SELECT o_orderpriority, o_orderkey FROM orders)"


def _region(spark, d, op, names):
    r = R.combine(order_mesh(spark, d).regions, op, "cell", names, "made", keep_inputs=False)
    return R.region(r, "cell", "made").select("entity")


@query("SELECT o_orderkey AS entity FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def edit_regions_union(spark, d):
    return _region(spark, d, "union", ["F", "1-URGENT"])


@query("SELECT o_orderkey AS entity FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def edit_regions_intersection(spark, d):
    return _region(spark, d, "intersection", ["F", "1-URGENT"])


@query("SELECT o_orderkey AS entity FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def edit_regions_difference(spark, d):
    return _region(spark, d, "difference", ["F", "1-URGENT"])


@query(f"SELECT CASE WHEN name = 'F' THEN 'final' ELSE name END AS name, CASE WHEN name = 'O' THEN 9::BIGINT ELSE 0::BIGINT END AS tag, count(*) AS n FROM {REGION_ROWS} WHERE name <> 'P' GROUP BY 1, 2")
def edit_regions_rename_retag_delete(spark, d):
    edits = [{"op": "rename", "kind": "cell", "old": "F", "new": "final"}, {"op": "retag", "kind": "cell", "name": "O", "tag": 9}, {"op": "delete", "kind": "cell", "names": ["P"]}]
    return R.edit_regions(order_mesh(spark, d).regions, edits).groupBy("name", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'cell' AS kind, 'F' AS name, 2 AS dim, 0::BIGINT AS tag")
def find_region(spark, d):
    return R.find_region(order_mesh(spark, d).regions, "cell", "F").drop("mesh_id")


@query("SELECT o_orderkey AS cell_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'F' THEN 0 ELSE -1 END AS label FROM orders")
def sets_to_data(spark, d):
    cells = table(spark, d, "orders").select(F.lit("orders").alias("mesh_id"), F.col("o_orderkey").alias("cell_id"))
    return R.sets_to_data(cells, order_mesh(spark, d).regions, "cell", ["F", "1-URGENT"], "label", "cell_id").drop("mesh_id")


@query("SELECT 'p_size_' || p_size AS name, p_size::BIGINT AS tag, count(*) AS n FROM part GROUP BY 1, 2")
def data_to_sets(spark, d):
    return R.data_to_sets(part_arrays(spark, d), "point", "p_size", "point_id").groupBy("name", "tag").agg(F.count(F.lit(1)).alias("n"))


# Filters


@query("""
SELECT l_orderkey AS cell_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING bool_and(p_size BETWEEN 5 AND 45 AND p_retailprice BETWEEN 900 AND 1800)""")
def crop_box(spark, d):
    m = C.crop(order_mesh(spark, d), C.in_box((5, 900), (45, 1800)))
    return m.cells.select("cell_id", F.size("nodes").cast("bigint").alias("n"))


@query("SELECT DISTINCT l_orderkey AS cell_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE (p_size - 40) * 1.0 + (p_retailprice - 1500) * 0.01 >= 0")
def crop_half_space_any(spark, d):
    return C.crop(order_mesh(spark, d), C.in_half_space((40, 1500, 0), (1.0, 0.01, 0)), "any").cells.select("cell_id")


@query("SELECT o_orderkey AS cell_id FROM orders WHERE o_totalprice <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def crop_where(spark, d):
    m = order_mesh(spark, d)
    v = F.when(F.col("cell_id") % 17 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return C.crop_where(m.with_(cells=m.cells.withColumn("v", v)), "v", "!=", 0).cells.select("cell_id")


@query(HEX + "SELECT cell_id AS entity FROM inc JOIN pts USING (point_id) GROUP BY cell_id HAVING (avg(x) - 3) ** 2 + (avg(y) - 2) ** 2 + (avg(z) - 2) ** 2 <= 4")
def select_ball_centroid(spark, d):
    return C.select(lattice(spark, DIMS), "ball", "cell", C.in_ball((3, 2, 2), 2), "centroid").select("entity")


@query(HEX + "SELECT point_id AS entity FROM pts WHERE x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 2 AND z BETWEEN 0 AND 9")
def select_box_points(spark, d):
    return C.select(lattice(spark, DIMS), "box", "point", C.in_box((1, 1, 0), (3, 2, 9))).select("entity")


@query("SELECT o_orderkey AS cell_id, dense_rank() OVER (ORDER BY f) - 1 AS piece FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderstatus) f FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def split_by_tag(spark, d):
    return C.split(order_mesh(spark, d), "tag", "o_orderstatus").select("cell_id", F.col("piece").cast("bigint").alias("piece"))


@query("SELECT 'hexahedron' AS cell_type, 120::BIGINT AS n UNION ALL SELECT 'quad', 42")
def split_by_type(spark, d):
    both = C.merge([lattice(spark, DIMS), lattice(spark, (7, 6))], "both")
    return C.split(both).join(both.cells.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


@query(HEX + f"SELECT source_mesh, count(*) AS n, sum(k) AS k FROM (SELECT 0 AS source_mesh, cell_id AS k FROM cells UNION ALL SELECT 1, cell_id + {6 * 5 * 4} FROM cells) GROUP BY 1")
def merge(spark, d):
    m = C.merge([lattice(spark, DIMS), lattice(spark, DIMS)], "both")
    return m.cells.groupBy("source_mesh").agg(F.count(F.lit(1)).alias("n"), F.sum("cell_id").alias("k"))


@query(f"SELECT {7 * 6 * 5 * 2 - 6 * 5}::BIGINT AS points, {6 * 5 * 4 * 2}::BIGINT AS cells")
def merge_weld(spark, d):
    a = lattice(spark, DIMS)
    b = a.with_(points=G.transform(a.points, G.translation(6, 0, 0)))
    m = C.weld(C.merge([a, b], "both"), 1e-6)
    return m.points.agg(F.count(F.lit(1)).alias("points")).join(m.cells.agg(F.count(F.lit(1)).alias("cells")))


@query(f"SELECT {7 * 6 * 5}::BIGINT AS points, {6 * 5 * 4}::BIGINT AS cells")
def clean(spark, d):
    a = lattice(spark, DIMS)
    m = C.clean(C.merge([a, a], "both"), 1e-6)
    return m.points.agg(F.count(F.lit(1)).alias("points")).join(m.cells.agg(F.count(F.lit(1)).alias("cells")))


@query("SELECT min(l_orderkey) AS cell_id FROM (SELECT l_orderkey, list_sort(list(l_partkey)) k FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) GROUP BY k")
def drop_duplicate_cells(spark, d):
    return C.drop_duplicates(order_mesh(spark, d).cells).select("cell_id")


@query("SELECT l_orderkey AS cell_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_partkey) = count(*)")
def drop_degenerate_cells(spark, d):
    return C.drop_degenerate(order_mesh(spark, d).cells).select("cell_id")


@query("SELECT DISTINCT p_partkey AS point_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')")
def prune_orphans(spark, d):
    m = order_mesh(spark, d)
    return C.pruned(m.with_(cells=m.cells.where("o_orderstatus = 'P'"))).points.select("point_id")


@query(HEX + "SELECT cell_id, [nodes[1], nodes[4], nodes[3], nodes[2], nodes[5], nodes[8], nodes[7], nodes[6]]::VARCHAR AS nodes FROM cells")
def flip_normals(spark, d):
    return C.flip_normals(lattice(spark, DIMS).cells).select("cell_id", F.concat(F.lit("["), F.array_join("nodes", ", "), F.lit("]")).alias("nodes"))


@query("SELECT o_orderkey AS cell_id, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS global_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def global_cell_index(spark, d):
    from pyspark.sql import Window

    cells = order_mesh(spark, d).cells
    sizes = cells.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("o_orderstatus").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("cell_id")) - 1
    return cells.withColumn("row", row).join(F.broadcast(sizes.withColumn("base", base)), "o_orderstatus").select("cell_id", (F.col("base") + F.col("row")).alias("global_id"))


# Geometry


@query("SELECT vec_id AS point_id, round(-(2 * embedding[2]::DOUBLE), 6) AS x, round(2 * embedding[1]::DOUBLE + 1, 6) AS y, round(2 * embedding[3]::DOUBLE, 6) AS z FROM embeddings")
def transform(spark, d):
    m = G.composed(G.translation(0, 1, 0), G.composed(G.rotation((0, 0, 1), 90), G.scaling(2, 2, 2)))
    return rounded(G.transform(cloud(spark, d), m).select("point_id", "x", "y", "z"))


@query("SELECT vec_id AS point_id, round(1 - embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings")
def mirror(spark, d):
    return rounded(G.mirror(cloud(spark, d), (0.5, 0, 0), (2, 0, 0)).select("point_id", "x", "y", "z"))


@query("SELECT vec_id AS point_id, round(sqrt(x * x + y * y), 6) AS cyl_r, round(atan2(y, x), 6) AS cyl_theta, round(z, 6) AS cyl_z FROM (SELECT vec_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings)")
def convert_coordinates(spark, d):
    return rounded(G.convert_coordinates(cloud(spark, d)).select("point_id", "cyl_r", "cyl_theta", "cyl_z"))


@query("SELECT vec_id AS point_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def convert_coordinates_inverse(spark, d):
    return rounded(G.inverse_cylindrical(G.convert_coordinates(cloud(spark, d))).select("point_id", "x", "y"))


@query(HEX + "SELECT count(*) AS num_points, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, avg(x) AS mean_x, 120::BIGINT AS num_cells, 120.0::DOUBLE AS volume, 120.0::DOUBLE AS signed_volume, 0::BIGINT AS num_inverted FROM pts")
def compute_stats(spark, d):
    return rounded(G.compute_stats(lattice(spark, DIMS)).select("num_points", "max_x", "max_y", "max_z", "mean_x", "num_cells", "volume", "signed_volume", "num_inverted"))


@query(HEX + "SELECT cell_id, 1.0::DOUBLE AS measure, 1.0::DOUBLE AS edge_ratio, 1.0::DOUBLE AS scaled_jacobian FROM cells")
def compute_quality(spark, d):
    return rounded(G.compute_quality(lattice(spark, DIMS)).select("cell_id", "measure", "edge_ratio", "scaled_jacobian"))


@query("SELECT 'min_angle' AS metric, 42::BIGINT AS evaluated, 0::BIGINT AS violations, true AS passes UNION ALL SELECT 'edge_ratio', 42, 42, false")
def check_quality(spark, d):
    q = G.compute_quality(lattice(spark, (7, 6)))
    return G.check_quality(q, "min_angle >= 80 # square\nedge_ratio >= 1.5 @ 10%").select("metric", "evaluated", "violations", "passes")


@query(HEX + """, c AS (SELECT cell_id, x, y, z, u, avg(x) OVER w mx, avg(y) OVER w my, avg(z) OVER w mz, avg(u) OVER w mu FROM inc JOIN pts USING (point_id) WINDOW w AS (PARTITION BY cell_id))
SELECT cell_id, round(sum((x - mx) * (u - mu)) / sum((x - mx) ** 2), 6) AS gx, round(sum((y - my) * (u - mu)) / sum((y - my) ** 2), 6) AS gy, round(sum((z - mz) * (u - mu)) / sum((z - mz) ** 2), 6) AS gz FROM c GROUP BY cell_id""")
def gradient(spark, d):
    return rounded(G.gradient(lattice(spark, DIMS), "u").drop("mesh_id"))


ETA = HEX + """, c AS (SELECT cell_id, x, y, z, u, avg(x) OVER w mx, avg(y) OVER w my, avg(z) OVER w mz, avg(u) OVER w mu FROM inc JOIN pts USING (point_id) WINDOW w AS (PARTITION BY cell_id)),
g AS (SELECT cell_id, sum((x - mx) * (u - mu)) / sum((x - mx) ** 2) AS gx, sum((y - my) * (u - mu)) / sum((y - my) ** 2) AS gy, sum((z - mz) * (u - mu)) / sum((z - mz) ** 2) AS gz FROM c GROUP BY cell_id),
p AS (SELECT point_id, avg(gx) px, avg(gy) py, avg(gz) pz FROM inc JOIN g USING (cell_id) GROUP BY point_id),
r AS (SELECT cell_id, avg(px) rx, avg(py) ry, avg(pz) rz FROM inc JOIN p USING (point_id) GROUP BY cell_id),
eta AS (SELECT cell_id, sqrt((rx - gx) ** 2 + (ry - gy) ** 2 + (rz - gz) ** 2) AS eta FROM g JOIN r USING (cell_id))
"""


@query(ETA + "SELECT cell_id, round(eta, 6) AS eta FROM eta")
def estimate_error(spark, d):
    return rounded(G.estimate_error(lattice(spark, DIMS), "u").drop("mesh_id"))


@query(ETA + "SELECT point_id, round(min(CASE WHEN eta > 1e-9 THEN 0.1 / eta END), 5) AS size FROM inc JOIN eta USING (cell_id) GROUP BY point_id")
def error_size(spark, d):
    mesh = lattice(spark, DIMS)
    errors = G.estimate_error(mesh, "u").withColumn("eta", F.when(F.col("eta") > 1e-9, F.col("eta")))
    return rounded(G.error_size(mesh, errors, 0.1).drop("mesh_id"), 5)


@query(QUAD + "SELECT cell_id, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 1.0::DOUBLE AS nz FROM cells")
def compute_normals(spark, d):
    return rounded(G.cell_normals(lattice(spark, (7, 6))).select("cell_id", "nx", "ny", "nz")).withColumns({c: F.col(c) + 0.0 for c in ("nx", "ny", "nz")})


@query(QUAD + "SELECT point_id, 1.0::DOUBLE AS nz FROM pts")
def compute_point_normals(spark, d):
    return rounded(G.point_normals(lattice(spark, (7, 6))).select("point_id", "nz"))


@query(QUAD + "SELECT point_id, round((2 - (CASE WHEN x IN (0, 7) THEN 1 ELSE 0 END + CASE WHEN y IN (0, 6) THEN 1 ELSE 0 END = 0)::INT * 2 - CASE WHEN (x IN (0, 7)) <> (y IN (0, 6)) THEN 1 ELSE 0 END - CASE WHEN x IN (0, 7) AND y IN (0, 6) THEN 0.5 ELSE 0 END) * pi(), 5) AS defect FROM pts")
def compute_curvature(spark, d):
    mesh = lattice(spark, (7, 6))
    flat = mesh.with_(cells=N.simplexify(mesh.cells))
    return rounded(G.angle_defect(flat).select("point_id", (F.col("defect") + 0.0).alias("defect")), 5).withColumn("defect", F.when(F.abs("defect") < 1e-5, 0.0).otherwise(F.col("defect")))


@query("SELECT 720::BIGINT AS num_tetrahedra, 0::BIGINT AS inverted, 0::BIGINT AS degenerate")
def check_tetrahedra(spark, d):
    mesh = lattice(spark, DIMS)
    return G.check_tetrahedra(mesh.with_(cells=N.simplexify(mesh.cells))).drop("mesh_id")


# Topology


def _tuples_sql(table_: list[tuple[int, ...]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"nodes[{i + 1}]" for i in t) + "]" for t in table_) + "]"


HEX_FACETS, HEX_EDGES, QUAD_EDGES = _tuples_sql(FACETS["hexahedron"]), _tuples_sql(EDGES["hexahedron"]), _tuples_sql(EDGES["quad"])


@query(HEX + f", f AS (SELECT cell_id, unnest({HEX_FACETS}) AS n, unnest(range(6)) AS facet FROM cells) SELECT min(cell_id) AS cell_id, min(facet)::INT AS facet FROM f GROUP BY list_sort(n) HAVING count(*) = 1")
def extract_surface(spark, d):
    return Y.extract_surface(lattice(spark, DIMS).cells).select("cell_id", "facet")


@query("SELECT 'quad' AS cell_type, 148::BIGINT AS cells, 150::BIGINT AS points")
def extract_skin(spark, d):
    s = Y.surface_mesh(lattice(spark, DIMS))
    return s.cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells")).join(s.points.agg(F.count(F.lit(1)).alias("points")))


@query("SELECT 0::BIGINT AS open, 0::BIGINT AS non_manifold, 0::BIGINT AS inconsistent")
def surface_watertight_check(spark, d):
    return Y.watertight_check(Y.surface_mesh(lattice(spark, DIMS)).cells).drop("mesh_id")


@query(f"SELECT 1 AS class, {4 * (6 + 5 + 4)}::BIGINT AS n")
def feature_edges(spark, d):
    return Y.feature_edges(Y.surface_mesh(lattice(spark, DIMS))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(HEX + f", e AS (SELECT unnest({HEX_EDGES}) AS e FROM cells) SELECT DISTINCT src, dst FROM (SELECT e[1] AS src, e[2] AS dst FROM e UNION ALL SELECT e[2], e[1] FROM e)")
def adjacency_node(spark, d):
    return Y.adjacency(lattice(spark, DIMS).cells, "node").drop("mesh_id")


@query("SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE a.l_partkey <> b.l_partkey")
def adjacency_clique(spark, d):
    return Y.adjacency(order_mesh(spark, d).cells, "clique").drop("mesh_id")


@query(HEX + f", f AS (SELECT cell_id, list_sort(unnest({HEX_FACETS})) AS k FROM cells) SELECT DISTINCT a.cell_id AS src, b.cell_id AS dst FROM f a JOIN f b USING (k) WHERE a.cell_id <> b.cell_id")
def adjacency_cell(spark, d):
    return Y.adjacency(lattice(spark, DIMS).cells, "cell").drop("mesh_id")


@query(f"SELECT 210::BIGINT AS vertices, {6 * 6 * 5 + 7 * 5 * 5 + 7 * 6 * 4}::BIGINT AS edges, 6::BIGINT AS max_degree")
def graph_summary(spark, d):
    return Y.graph_summary(Y.adjacency(lattice(spark, DIMS).cells)).drop("mesh_id")


@query("SELECT max(b) AS bandwidth FROM (SELECT max(l_partkey) - min(l_partkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)")
def compute_bandwidth(spark, d):
    return Y.compute_bandwidth(order_mesh(spark, d).cells).drop("mesh_id")


def _halves(mesh: MeshFrame) -> DataFrame:
    name = F.when(F.col("cell_id") % 6 < 3, "left").otherwise("right")
    return mesh.cells.select("mesh_id", F.lit("cell").alias("kind"), name.alias("name"), F.lit(3).alias("dim"), F.lit(0).cast("bigint").alias("tag"), F.col("cell_id").alias("entity"))


@query("SELECT 'left' AS region_a, 'right' AS region_b, 20::BIGINT AS shared")
def region_adjacency(spark, d):
    mesh = lattice(spark, DIMS)
    return Y.region_adjacency(mesh.cells, _halves(mesh), ["left", "right"]).drop("mesh_id")


@query(HEX + f", f AS (SELECT cell_id, list_sort(unnest({HEX_FACETS})) AS k FROM cells) SELECT a.cell_id AS cell_a, b.cell_id AS cell_b FROM f a JOIN f b USING (k) WHERE a.cell_id % 6 < 3 AND b.cell_id % 6 >= 3")
def find_interface(spark, d):
    mesh = lattice(spark, DIMS)
    return Y.find_interface(mesh.cells, _halves(mesh), "left", "right").select("cell_a", "cell_b")


@query("SELECT component, count(*) AS n FROM (SELECT i // 120 AS component FROM range(360) t(i)) GROUP BY 1")
def split_by_component(spark, d):
    a = lattice(spark, DIMS)
    both = C.merge([a, a, a], "three")
    return Y.numbered_components(Y.cell_components(both)).groupBy(F.col("component").cast("bigint").alias("component")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 120::BIGINT AS n")
def remove_islands(spark, d):
    both = C.merge([lattice(spark, DIMS), lattice(spark, (2, 2, 2))], "two")
    return Y.remove_islands(both, 50).cells.agg(F.count(F.lit(1)).alias("n"))


@query(HEX + f""", e AS (SELECT unnest({HEX_EDGES}) AS e FROM cells), g AS (SELECT DISTINCT a, b FROM (SELECT e[1] AS a, e[2] AS b FROM e UNION ALL SELECT e[2], e[1] FROM e))
SELECT p.point_id, round(p.x + 0.5 * (avg(q.x) - p.x), 6) AS x, round(p.y + 0.5 * (avg(q.y) - p.y), 6) AS y, round(p.z + 0.5 * (avg(q.z) - p.z), 6) AS z FROM pts p JOIN g ON g.a = p.point_id JOIN pts q ON q.point_id = g.b GROUP BY p.point_id, p.x, p.y, p.z""")
def smooth_laplacian(spark, d):
    return rounded(Y.smooth(lattice(spark, DIMS), 1, 0.5).select("point_id", "x", "y", "z"))


# Space

CLOUD = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings"
PAIR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"WITH c AS ({CLOUD}) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id AND {PAIR} <= 0.05 * 0.05")
def neighbor_pairs_radius(spark, d):
    return S.bucketed_pairs(cloud(spark, d), 0.05).select("a", "b")


@query(f"""WITH c AS ({CLOUD}) SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM c a JOIN c b ON a.id <> b.id
AND least(abs(a.x - b.x), 1 - abs(a.x - b.x)) ** 2 + least(abs(a.y - b.y), 1 - abs(a.y - b.y)) ** 2 + least(abs(a.z - b.z), 1 - abs(a.z - b.z)) ** 2 <= 0.05 * 0.05""")
def neighbor_pairs_periodic(spark, d):
    return S.periodic_pairs(cloud(spark, d), 0.05, (1.0, 1.0, 1.0)).select("a", "b")


@query(f"WITH c AS ({CLOUD}) SELECT point_id, other_id, rank FROM (SELECT a.id AS point_id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY {PAIR}, b.id)::INT AS rank FROM c a JOIN c b ON a.id <> b.id) WHERE rank <= 4")
def neighbor_pairs_knn(spark, d):
    p = cloud(spark, d)
    return S.k_nearest(p, p, 4).select("point_id", "other_id", "rank")


@query(f"WITH c AS ({CLOUD}), t AS (SELECT * FROM c WHERE id % 2 = 1), s AS (SELECT * FROM c WHERE id % 2 = 0) SELECT point_id, label FROM (SELECT a.id AS point_id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {PAIR}, b.id) AS r FROM t a, s b) WHERE r = 1")
def interpolate_nearest(spark, d):
    p = cloud(spark, d)
    return S.interpolate_nearest(p.where("point_id % 2 = 1").drop("label"), p.where("point_id % 2 = 0"), ["label"]).select("point_id", "label")


@query(f"""WITH c AS ({CLOUD}), t AS (SELECT * FROM c WHERE id % 2 = 1), s AS (SELECT * FROM c WHERE id % 2 = 0),
ab AS (SELECT sqrt(min({PAIR})) AS d FROM t a, s b GROUP BY a.id), ba AS (SELECT sqrt(min({PAIR})) AS d FROM s a, t b GROUP BY a.id)
SELECT round((SELECT max(d) FROM ab), 6) AS max_ab, round((SELECT avg(d) FROM ab), 6) AS mean_ab, round((SELECT max(d) FROM ba), 6) AS max_ba, round(greatest((SELECT max(d) FROM ab), (SELECT max(d) FROM ba)), 6) AS hausdorff""")
def hausdorff_distance(spark, d):
    p = cloud(spark, d)
    return rounded(S.hausdorff(p.where("point_id % 2 = 1"), p.where("point_id % 2 = 0")).select("max_ab", "mean_ab", "max_ba", "hausdorff"))


@query(HEX + "SELECT a.point_id AS slave, b.point_id AS master FROM pts a JOIN pts b ON a.x = 0 AND b.x = 6 AND a.y = b.y AND a.z = b.z")
def match_periodic_nodes(spark, d):
    p = lattice(spark, DIMS).points
    return S.match_periodic(p.where("x = 0"), p.where("x = 6"), G.translation(6, 0, 0)).select("slave", "master")


@query(f"WITH c AS ({CLOUD}), v AS (SELECT sqrt(x * x + y * y + z * z) - 0.2 AS d FROM c) SELECT count(*) AS n, round(min(d), 6) AS least, round(max(d), 6) AS greatest, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, round(stddev_pop(d), 6) AS sigma, round(quantile_cont(d, 0.05), 6) AS p5, round(quantile_cont(d, 0.95), 6) AS p95, round(avg((abs(d) <= 0.05)::INT), 6) AS within FROM v")
def deviation_to_sphere(spark, d):
    out = S.deviation_report(cloud(spark, d), S.sphere_deviation((0, 0, 0), 0.2), 0.05)
    return rounded(out.select("n", "least", "greatest", "mean", "rms", "sigma", "p5", "p95", "within"))


@query(f"WITH c AS ({CLOUD}) SELECT id AS point_id, round((x - 0.1) * 0.6 + z * 0.8, 6) AS d FROM c")
def deviation_to_plane(spark, d):
    return rounded(cloud(spark, d).select("point_id", S.plane_deviation((0.1, 0, 0), (3, 0, 4)).alias("d")))


@query(f"WITH c AS ({CLOUD}) SELECT id AS point_id, round(sqrt(x * x + y * y) - 0.1, 6) AS d FROM c")
def deviation_to_cylinder(spark, d):
    return rounded(cloud(spark, d).select("point_id", S.cylinder_deviation((0, 0, 0), (0, 0, 1), 0.1).alias("d")))


# Order and budgets


@query("SELECT o_orderkey AS cell_id, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= floor(0.1 * count(*) OVER () + 0.5) THEN 1 ELSE 0 END AS marked FROM orders")
def marking_fraction(spark, d):
    e = table(spark, d, "orders").select(F.lit("m").alias("mesh_id"), F.col("o_orderkey").alias("cell_id"), "o_totalprice")
    return O.mark_fraction(e, "o_totalprice", 0.1).select("cell_id", "marked")


@query("SELECT p_partkey AS cell_id, CASE WHEN coalesce(sum(p_size * p_size) OVER (ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.5 * sum(p_size * p_size) OVER () THEN 1 ELSE 0 END AS marked FROM part")
def marking_dorfler(spark, d):
    e = part_arrays(spark, d).select("mesh_id", F.col("point_id").alias("cell_id"), F.col("p_size").cast("double").alias("e"))
    return O.mark_dorfler(e, "e", 0.5).select("cell_id", "marked")


@query("SELECT o_orderkey AS cell_id, (o_totalprice >= 200000)::INT AS marked FROM orders")
def marking_absolute(spark, d):
    e = table(spark, d, "orders").select(F.lit("m").alias("mesh_id"), F.col("o_orderkey").alias("cell_id"), "o_totalprice")
    return O.mark_absolute(e, "o_totalprice", 200000).select("cell_id", "marked")


@query("SELECT o_orderkey AS point_id, floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 16 / count(*) OVER ())::INT AS part FROM orders")
def partition_labels(spark, d):
    e = table(spark, d, "orders").select(F.lit("m").alias("mesh_id"), F.col("o_orderkey").alias("point_id"), "o_totalprice")
    return O.partition_labels(e, "point_id", "o_totalprice", 16).select("point_id", "part")


@query("SELECT part, count(*) AS n FROM (SELECT floor(i * 5 / 210)::INT AS part FROM range(210) t(i)) GROUP BY 1")
def partition_hilbert(spark, d):
    p = O.with_hilbert(O.quantised(lattice(spark, DIMS).points))
    return O.partition_labels(p, "point_id", "hilbert", 5).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query()
def reorder_morton(spark, d):
    return O.reorder(cloud(spark, d)).select("point_id", "new_id")


@query()
def reorder_hilbert(spark, d):
    return O.reorder(cloud(spark, d), "hilbert").select("point_id", "new_id")


@query()
def select_points_farthest(spark, d):
    return O.farthest_points(cloud(spark, d), 16, 0).select("step", "point_id")


@query(f"""WITH c AS ({CLOUD}), b AS (SELECT *, floor(x / 0.1)::BIGINT bx, floor(y / 0.1)::BIGINT by_, floor(z / 0.1)::BIGINT bz FROM c)
SELECT arg_min(id, ((x - (bx + 0.5) * 0.1) ** 2 + (y - (by_ + 0.5) * 0.1) ** 2 + (z - (bz + 0.5) * 0.1) ** 2, id)) AS point_id FROM b GROUP BY bx, by_, bz""")
def select_points_grid(spark, d):
    return O.grid_points(cloud(spark, d), 0.1).select("point_id")


@query("SELECT vec_id AS point_id FROM embeddings ORDER BY md5('7:cloud:' || vec_id), vec_id LIMIT 50")
def select_points_random(spark, d):
    return O.random_points(cloud(spark, d), 50, 7).select("point_id")


# Time

STEPS = "SELECT user_id, epoch(ts) AS time, event_id AS step, value FROM events"


def _steps(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.col("event_id").alias("step"), "value")


def _targets(spark, d):
    days = [1704067200.0 + 86400.0 * k for k in range(1, 30)]
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(t) for t in days])).alias("target"))


TARGETS = "SELECT DISTINCT user_id, 1704067200.0::DOUBLE + 86400 * k AS target FROM events, range(1, 30) t(k)"


@query(f"""WITH s AS ({STEPS}), t AS ({TARGETS}),
b AS (SELECT t.*, s.time AS before_time, s.value AS bv FROM t ASOF LEFT JOIN s ON t.user_id = s.user_id AND t.target >= s.time),
a AS (SELECT b.*, s.time AS after_time, s.value AS av FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.target <= s.time)
SELECT user_id, target, round(CASE WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv WHEN after_time = before_time THEN bv ELSE bv + (target - before_time) / (after_time - before_time) * (av - bv) END, 4) AS value FROM a""")
def resample_linear(spark, d):
    out = P.resample(_steps(spark, d), ["value"], _targets(spark, d), ["user_id"])
    return out.select("user_id", "target", F.round("value", 4).alias("value"))


@query(f"WITH s AS ({STEPS}), t AS ({TARGETS}) SELECT t.user_id, t.target, s.step AS before_step FROM t ASOF LEFT JOIN s ON t.user_id = s.user_id AND t.target >= s.time")
def resample_plan(spark, d):
    return P.bracket(_steps(spark, d), _targets(spark, d), ["user_id"]).select("user_id", "target", "before_step")


@query("SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    return P.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["value"]).select("event_id", "last_value")


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 43200 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2""")
def sessions(spark, d):
    return P.sessions(table(spark, d, "events"), ["user_id"], "ts", 43200).select("user_id", "session", "n")


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def temporal_windows(spark, d):
    from ..streaming.windows import windowed

    out = windowed(table(spark, d, "events"), "1 day")
    return out.select("event_type", F.unix_seconds(F.col("start").cast("timestamp")).alias("day"), "n", F.round("total", 4).alias("total"))


# Generation


@query(HEX + "SELECT cell_id, nodes[1] AS n0, nodes[7] AS n6 FROM cells")
def grid(spark, d):
    return N.grid(spark, DIMS).cells.select("cell_id", F.col("nodes").getItem(0).alias("n0"), F.col("nodes").getItem(6).alias("n6"))


@query(HEX + f"SELECT row_number() OVER (ORDER BY cell_id, k) - 1 AS cell_id, cell_id AS parent, n[1] AS n0, n[4] AS n3 FROM (SELECT cell_id, unnest({_tuples_sql(SIMPLICES['hexahedron'])}) AS n, unnest(range(6)) AS k FROM cells)")
def convert_cells_simplexify(spark, d):
    return N.simplexify(lattice(spark, DIMS).cells).select("cell_id", "parent", F.col("nodes").getItem(0).alias("n0"), F.col("nodes").getItem(3).alias("n3"))


@query(QUAD + f", e AS (SELECT DISTINCT least(e[1], e[2]) AS a, greatest(e[1], e[2]) AS b FROM (SELECT unnest({QUAD_EDGES}) AS e FROM cells)) SELECT 55 + row_number() OVER (ORDER BY a, b) AS point_id, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y FROM e JOIN pts p ON p.point_id = a JOIN pts q ON q.point_id = b")
def convert_cells_elevate(spark, d):
    return N.elevate(lattice(spark, (7, 6))).points.where("point_id > 55").select("point_id", "x", "y")


@query(QUAD + "SELECT cell_id, 'quad' AS cell_type, nodes[1] AS n0, nodes[4] AS n3 FROM cells")
def convert_cells_linearize(spark, d):
    m = N.linearize(N.elevate(lattice(spark, (7, 6))))
    return m.cells.select("cell_id", "cell_type", F.col("nodes").getItem(0).alias("n0"), F.col("nodes").getItem(3).alias("n3"))


@query("SELECT 'hexahedron' AS cell_type, 126::BIGINT AS cells, round(42 * 2.5, 6)::DOUBLE AS volume")
def extrude(spark, d):
    m = N.extrude(lattice(spark, (7, 6)), (0, 0, 2.5), 3, 1.5)
    return G.with_measure(m).groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("measure"), 6).alias("volume"))


@query("SELECT 'hexahedron' AS cell_type, 336::BIGINT AS cells, 448::BIGINT AS points")
def revolve(spark, d):
    flat = N.grid(spark, (7, 6), origin=(1.0, 0.0, 0.0))
    m = N.revolve(flat, 360, 8)
    return m.cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells")).join(m.points.agg(F.count(F.lit(1)).alias("points")))


SIMPLEX_EDGES = f"""
, s AS (SELECT cell_id, unnest({_tuples_sql(SIMPLICES['hexahedron'])}) AS n FROM cells),
e AS (SELECT DISTINCT least(p, q) AS lo, greatest(p, q) AS hi FROM (SELECT n[i] AS p, n[j] AS q FROM s, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) t(i, j)))
"""


@query(HEX + SIMPLEX_EDGES + "SELECT lo, hi, round(a.x + (a.u - 9.1) / (a.u - b.u) * (b.x - a.x), 6) AS x, round(a.y + (a.u - 9.1) / (a.u - b.u) * (b.y - a.y), 6) AS y FROM e JOIN pts a ON a.point_id = lo JOIN pts b ON b.point_id = hi WHERE (a.u < 9.1) <> (b.u < 9.1)")
def isosurface_points(spark, d):
    return rounded(N.level_crossings(lattice(spark, DIMS), F.col("u"), 9.1).select("lo", "hi", "x", "y"))


@query(HEX + f", s AS (SELECT unnest({_tuples_sql(SIMPLICES['hexahedron'])}) AS n FROM cells), c AS (SELECT (SELECT count(*) FROM unnest(n) t(v) JOIN pts ON point_id = v WHERE u < 9.1) AS below FROM s) SELECT CASE WHEN below = 2 THEN 4 ELSE 3 END AS sides, count(*) AS n FROM c WHERE below BETWEEN 1 AND 3 GROUP BY 1")
def isosurface(spark, d):
    return N.isosurface(lattice(spark, DIMS), F.col("u"), 9.1).groupBy(F.size("ring").alias("sides")).agg(F.count(F.lit(1)).alias("n"))


@query(HEX + f", s AS (SELECT unnest({_tuples_sql(SIMPLICES['hexahedron'])}) AS n FROM cells), c AS (SELECT (SELECT count(*) FROM unnest(n) t(v) JOIN pts ON point_id = v WHERE x < 2.5) AS below FROM s) SELECT CASE WHEN below = 2 THEN 4 ELSE 3 END AS sides, count(*) AS n FROM c WHERE below BETWEEN 1 AND 3 GROUP BY 1")
def slice_plane(spark, d):
    return N.slice_mesh(lattice(spark, DIMS), (2.5, 0, 0), (1, 0, 0)).groupBy(F.size("ring").alias("sides")).agg(F.count(F.lit(1)).alias("n"))


# Plans


@query(HEX + "SELECT cell_id FROM cells WHERE m >= 3 EXCEPT SELECT cell_id FROM inc JOIN pts USING (point_id) GROUP BY cell_id HAVING NOT bool_and(x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 5 AND z BETWEEN 0 AND 4)")
def settings_pipeline(spark, d):
    from .pipeline import run_pipeline

    steps = {"version": 1, "steps": [{"op": "crop", "box": [[0, 0, 0], [4, 5, 4]]}, {"op": "crop_where", "array": "m", "compare": ">=", "value": 3}]}
    return run_pipeline(lattice(spark, DIMS), steps).cells.select("cell_id")


# Kernels


@query()
def estimate_normals(spark, d):
    from ..operators.kernels import estimate_normals as run

    return run(cloud(spark, d), 8).select("point_id", "nx", "ny", "nz", "variation")


@query("SELECT 'sphere' AS kind, 0.0::DOUBLE AS cx, 1.0::DOUBLE AS radius")
def fit_primitives(spark, d):
    from ..operators.kernels import fit_primitives as run

    p = cloud(spark, d)
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    unit = p.withColumns({c: F.col(c) / size for c in "xyz"}).withColumn("patch", F.lit(0))
    out = run(unit).select("kind", F.abs(F.round(F.col("params")[0], 6)).alias("cx"), F.round(F.col("params")[3], 6).alias("radius"))
    return out


@query("SELECT count(*) AS n, 0.0::DOUBLE AS worst FROM embeddings")
def register_rigid(spark, d):
    from ..operators.kernels import register_rigid as run

    p = cloud(spark, d)
    moved = G.transform(p, G.composed(G.translation(0.002, -0.001, 0.001), G.rotation((0, 0, 1), 0.2)))
    matrix, _ = run(moved, p, 12)
    back = G.transform(moved, matrix.tolist()).select("point_id", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    err = F.sqrt(sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return p.join(back, "point_id").agg(F.count(F.lit(1)).alias("n"), F.abs(F.round(F.max(err), 6)).alias("worst"))


@query()
def convex_hull_2d(spark, d):
    from ..operators.kernels import convex_hull_2d as run

    return run(cloud(spark, d)).select("place", "point_id")


@query(HEX + "SELECT point_id, x + y + z AS distance FROM pts")
def edge_distance(spark, d):
    from ..operators.kernels import edge_distance as run
    from ..operators.kernels import edge_lengths

    mesh = lattice(spark, DIMS)
    start = mesh.points.where("point_id = 0").select("mesh_id", "point_id")
    return rounded(run(edge_lengths(mesh.cells, mesh.points), start).drop("mesh_id"))


@query(HEX + "SELECT point_id, round(-least(x, 6 - x, y, 5 - y, z, 4 - z), 6)::DOUBLE AS distance FROM pts WHERE x > 0 AND x < 6 AND y > 0 AND y < 5 AND z > 0 AND z < 4")
def compute_sdf(spark, d):
    from ..operators.kernels import signed_distance

    mesh = lattice(spark, DIMS)
    surface = Y.surface_mesh(mesh)
    flat = surface.with_(cells=N.simplexify(surface.cells.select(*CELL_KEYS, "cell_type", "nodes")))
    inner = mesh.points.where("x > 0 and x < 6 and y > 0 and y < 5 and z > 0 and z < 4")
    return rounded(signed_distance(inner, flat.with_corners()).drop("mesh_id"))


# Fields


@query("SELECT i AS point_id, round(CASE WHEN 0.3 + i * 0.31 <= 7 AND 0.2 + i * 0.27 <= 6 THEN 0.7 + i * 0.85 ELSE 0 END, 6)::DOUBLE AS v FROM range(20) t(i)")
def interpolate_barycentric(spark, d):
    from ..operators.fields import barycentric

    mesh = lattice(spark, (7, 6))
    flat = MeshFrame(mesh.points.withColumn("v", F.col("x") + 2 * F.col("y")), N.simplexify(mesh.cells))
    i = F.col("id")
    target = spark.range(20).select(F.lit("grid").alias("mesh_id"), i.alias("point_id"), (0.3 + i * 0.31).alias("x"), (0.2 + i * 0.27).alias("y"), F.lit(0.0).alias("z"))
    return rounded(barycentric(target, flat, ["v"]).select("point_id", "v"))


@query("SELECT p_partkey AS point_id, p_retailprice * 0.7 + 30 AS p_retailprice, p_size FROM part")
def blend_steps(spark, d):
    from ..operators.fields import blend_steps as run

    a = part_arrays(spark, d)
    b = a.withColumns({"p_retailprice": F.lit(100.0), "p_size": F.lit(1)})
    return rounded(run(a, b, ["point_id"], ["p_retailprice", "p_size"], 0.3).select("point_id", "p_retailprice", "p_size"))


SQL["blend_steps"] = "SELECT p_partkey AS point_id, round(p_retailprice * 0.7 + 30, 6) AS p_retailprice, p_size FROM part"


@query("SELECT 210::BIGINT AS matched, 0::BIGINT AS ambiguous, 0::BIGINT AS lost, 30::BIGINT AS violations")
def diff_unordered(spark, d):
    from ..operators.fields import diff_unordered as run

    a = lattice(spark, DIMS).points
    b = a.withColumn("point_id", 1000 - F.col("point_id")).withColumn("u", F.col("u") + F.when(F.col("x") == 0, 1.0).otherwise(0.0))
    return run(a, b, ["u"]).drop("mesh_id")


@query(HEX + "SELECT point_id, x + 0.1 * u AS x, y, z - 0.2 * u AS z FROM pts")
def exaggerate(spark, d):
    from ..operators.fields import exaggerate as run

    p = lattice(spark, DIMS).points.withColumns({"dx": F.col("u") * 0.05, "dy": F.lit(0.0), "dz": F.col("u") * -0.1})
    return rounded(run(p, ("dx", "dy", "dz"), 2.0).select("point_id", "x", "y", "z"))


SQL["exaggerate"] = HEX + "SELECT point_id, round(x + 0.1 * u, 6) AS x, round(y, 6) AS y, round(z - 0.2 * u, 6) AS z FROM pts"


@query(HEX + "SELECT cell_id, 2.0::DOUBLE AS h_xx, 1.0::DOUBLE AS h_yz, 1.0::DOUBLE AS h_zy FROM cells WHERE cell_id % 6 BETWEEN 1 AND 4 AND (cell_id // 6) % 5 BETWEEN 1 AND 3 AND cell_id // 30 BETWEEN 1 AND 2")
def hessian(spark, d):
    from ..operators.fields import hessian as run

    inner = (F.col("cell_id") % 6).between(1, 4) & (F.floor(F.col("cell_id") / 6) % 5).between(1, 3) & F.floor(F.col("cell_id") / 30).between(1, 2)
    return rounded(run(lattice(spark, DIMS), "u").where(inner).select("cell_id", "h_xx", "h_yz", "h_zy"))


@query("SELECT * FROM (VALUES (20::BIGINT, 2::BIGINT), (24::BIGINT, 2::BIGINT), (30::BIGINT, 2::BIGINT)) t(faces, patches)")
def segment(spark, d):
    from ..operators.fields import segment as run

    sizes = run(Y.surface_mesh(lattice(spark, DIMS))).groupBy("patch").agg(F.count(F.lit(1)).alias("faces"))
    return sizes.groupBy("faces").agg(F.count(F.lit(1)).alias("patches"))


@query(HEX + "SELECT cell_id, greatest(cell_id % 6, (cell_id // 6) % 5, cell_id // 30)::INT AS ring FROM cells WHERE greatest(cell_id % 6, (cell_id // 6) % 5, cell_id // 30) <= 2")
def select_grown_patch(spark, d):
    from ..operators.fields import grow

    cells = lattice(spark, DIMS).cells
    return grow(cells, cells.where("cell_id = 0"), 2).select("cell_id", "ring")


@query(HEX + "SELECT point_id, x, y, z, u, (x = 0)::INT AS region_left, (y = 0)::INT AS region_low FROM pts")
def feature_columns(spark, d):
    from ..operators.fields import feature_columns as run

    m = lattice(spark, DIMS)
    regions = C.select(m, "left", "point", F.col("x") == 0).unionAll(C.select(m, "low", "point", F.col("y") == 0))
    return run(m.points, ["u"], regions, ["low", "left"]).drop("mesh_id")


@query("""WITH s AS (SELECT avg(p_size) m1, stddev_pop(p_size) s1, avg(p_retailprice) m2, stddev_pop(p_retailprice) s2 FROM part),
c AS (SELECT p_partkey, sqrt((((p_size - m1) / s1) ** 2 + ((p_retailprice - m2) / s2) ** 2) / 2) AS score FROM part, s)
SELECT p_partkey AS point_id, round(score, 6) AS score, score <= 0.8 * (SELECT max(score) FROM c) AS within FROM c""")
def geometry_guard(spark, d):
    from ..operators.fields import geometry_guard as run

    p = part_arrays(spark, d)
    return rounded(run(p, p, ["p_size", "p_retailprice"], 0.8).select("point_id", "score", "within"))


@query("SELECT count(*) AS n, 0.0::DOUBLE AS worst FROM embeddings")
def register_landmarks(spark, d):
    from ..operators.fields import register_landmarks as run

    p = cloud(spark, d)
    moved = G.transform(p, G.composed(G.translation(1, 2, 3), G.rotation((1, 1, 1), 40)))
    other = moved.select("point_id", *[F.col(c).alias(f"other_{c}") for c in "xyz"])
    back = G.transform(p, run(p.join(other, "point_id")).tolist()).join(other, "point_id")
    err = F.sqrt(sum(((F.col(c) - F.col(f"other_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return back.agg(F.count(F.lit(1)).alias("n"), F.abs(F.round(F.max(err), 6)).alias("worst"))


@query(HEX + "SELECT cell_id, 1 AS occupied FROM cells WHERE cell_id % 6 < 4")
def voxelize(spark, d):
    from ..operators.kernels import signed_distance

    inside = N.grid(spark, (4, 5, 4))
    skin = Y.surface_mesh(inside)
    flat = skin.with_(cells=N.simplexify(skin.cells.select(*CELL_KEYS, "cell_type", "nodes"))).with_corners()
    centres = G.centroids(lattice(spark, DIMS)).select("mesh_id", F.col("cell_id").alias("point_id"), *[F.col(f"c{c}").alias(c) for c in "xyz"])
    return signed_distance(centres, flat).where("distance < 0").select(F.col("point_id").alias("cell_id"), F.lit(1).alias("occupied"))


@query("SELECT * FROM (VALUES (0, 120::BIGINT), (1, 120::BIGINT)) t(section, n)")
def sections(spark, d):
    m = lattice(spark, DIMS)
    out = None
    for k, x in enumerate((0.5, 4.5)):
        s = N.slice_mesh(m, (x, 0, 0), (1, 0, 0)).withColumn("section", F.lit(k))
        out = s if out is None else out.unionAll(s)
    return out.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS point_id, 10 * p_size + p_partkey % 10 AS weighted FROM part")
def data_calc_pipeline(spark, d):
    from .pipeline import run_pipeline

    mesh = order_mesh(spark, d)
    points = mesh.points.withColumn("r", F.col("point_id") % 10)
    steps = {"steps": [{"op": "data_calc", "output": "weighted", "expression": "10 * p_size + r"}, {"op": "data_keep", "names": ["weighted"]}]}
    return run_pipeline(mesh.with_(points=points), steps).points.select("point_id", F.col("weighted").cast("bigint").alias("weighted"))


# Surfaces


def _flat(spark, dims=(7, 6)) -> MeshFrame:
    mesh = lattice(spark, dims)
    return mesh.with_(cells=N.simplexify(mesh.cells.select(*CELL_KEYS, "cell_type", "nodes")))


def _box(spark) -> MeshFrame:
    skin = Y.surface_mesh(lattice(spark, DIMS))
    return skin.with_(cells=N.simplexify(skin.cells.select(*CELL_KEYS, "cell_type", "nodes")))


@query("SELECT 'wedge' AS cell_type, 84::BIGINT AS cells, 21.0::DOUBLE AS volume")
def thicken(spark, d):
    from ..operators.surfaces import thicken as run

    return rounded(G.with_measure(run(_flat(spark), 0.5)).groupBy("cell_type").agg(F.count(F.lit(1)).alias("cells"), F.sum("measure").alias("volume")))


@query(QUAD + "SELECT point_id, x, y, 0.25::DOUBLE AS z FROM pts")
def offset_surface(spark, d):
    from ..operators.surfaces import offset_points

    return rounded(offset_points(_flat(spark), 0.25).points.select("point_id", "x", "y", "z"))


@query("SELECT 15.0::DOUBLE AS area")
def clip(spark, d):
    from ..operators.surfaces import clip_triangles

    p = F.col("polygon")
    fan = F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda k: F.abs((p[k]["x"] - p[0]["x"]) * (p[k + 1]["y"] - p[0]["y"]) - (p[k]["y"] - p[0]["y"]) * (p[k + 1]["x"] - p[0]["x"])) / 2)
    return rounded(clip_triangles(_flat(spark), (2.5, 0, 0), (1, 0, 0)).agg(F.sum(F.aggregate(fan, F.lit(0.0), lambda a, x: a + x)).alias("area")))


@query("SELECT 5 AS faces, 720::BIGINT AS children")
def subdivide(spark, d):
    from ..operators.surfaces import subdivide as run

    return run(lattice(spark, DIMS)).groupBy(F.size("faces").alias("faces")).agg(F.count(F.lit(1)).alias("children"))


@query(QUAD + "SELECT point_id, x, y, 0.0::DOUBLE AS z FROM pts")
def shrinkwrap(spark, d):
    from ..operators.surfaces import shrinkwrap as run

    mesh = _flat(spark)
    lifted = mesh.points.withColumn("z", F.col("x") * 0.1)
    return rounded(run(lifted, mesh.with_corners()).select("point_id", "x", "y", "z")).withColumn("z", F.abs("z"))


@query(QUAD + "SELECT point_id, round(0.1 * x, 6) AS gap, 0.1 * x <= 0.35 AS touches FROM pts")
def contact_pairs(spark, d):
    from ..operators.surfaces import contact_pairs as run

    mesh = _flat(spark)
    out = run(mesh.points.withColumn("z", F.col("x") * 0.1), mesh.with_corners(), 0.35)
    return rounded(out.select("point_id", "gap", F.col("cell_id").isNotNull().alias("touches")))


@query("SELECT thickness, count(*) * 2 * 2 AS n FROM (SELECT 6.0::DOUBLE AS thickness FROM range(20) UNION ALL SELECT 5.0 FROM range(24) UNION ALL SELECT 4.0 FROM range(30)) GROUP BY 1")
def thickness(spark, d):
    from ..operators.surfaces import thickness as run

    return rounded(run(_box(spark).with_corners())).groupBy("thickness").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 20::BIGINT AS pairs, 0.5::DOUBLE AS distance")
def find_interface_proximity(spark, d):
    from ..operators.surfaces import find_interface_proximity as run

    a = Y.surface_mesh(lattice(spark, DIMS))
    b = a.with_(points=G.transform(a.points, G.translation(6.5, 0, 0)))
    both = C.merge([a, b], "both")
    side = lambda k: both.cells.where(F.col("source_mesh") == k)
    return rounded(run(both, side(0), side(1), 0.6).agg(F.count(F.lit(1)).alias("pairs"), F.max("distance").alias("distance")))


@query("SELECT 63::BIGINT AS n, true AS narrow")
def reorder_rcm(spark, d):
    from ..operators.surfaces import reorder_rcm as run

    graph = Y.adjacency(N.grid(spark, (20, 2)).cells)
    new = run(graph)
    a, b = new.select(F.col("point_id").alias("src"), F.col("new_id").alias("i")), new.select(F.col("point_id").alias("dst"), F.col("new_id").alias("j"))
    width = graph.join(a, "src").join(b, "dst").agg(F.max(F.abs(F.col("i") - F.col("j"))).alias("w"))
    return new.agg(F.count(F.lit(1)).alias("n")).join(width).select("n", (F.col("w") <= 4).alias("narrow"))


@query()
def delaunay_2d(spark, d):
    from ..operators.surfaces import delaunay_2d as run

    return run(cloud(spark, d)).select("a", "b", "c")


@query()
def convex_hull(spark, d):
    from ..operators.surfaces import convex_hull as run

    return run(cloud(spark, d)).select("a", "b", "c")


@query(HEX + "SELECT cell_id, 4.0::DOUBLE AS m_xx, 1.0::DOUBLE AS m_yy FROM cells WHERE cell_id % 6 BETWEEN 1 AND 4 AND (cell_id // 6) % 5 BETWEEN 1 AND 3 AND cell_id // 30 BETWEEN 1 AND 2")
def metric_from_hessian(spark, d):
    from ..operators.fields import hessian as second
    from ..operators.surfaces import metric_from_hessian as run

    inner = (F.col("cell_id") % 6).between(1, 4) & (F.floor(F.col("cell_id") / 6) % 5).between(1, 3) & F.floor(F.col("cell_id") / 30).between(1, 2)
    return rounded(run(second(lattice(spark, DIMS), "u").where(inner), 0.5, 0.1, 1.0).select("cell_id", "m_xx"))


SQL["metric_from_hessian"] = HEX + "SELECT cell_id, 4.0::DOUBLE AS m_xx FROM cells WHERE cell_id % 6 BETWEEN 1 AND 4 AND (cell_id // 6) % 5 BETWEEN 1 AND 3 AND cell_id // 30 BETWEEN 1 AND 2"
