"""Queries over block graphs. The graph is region, nation and customer with planted faults:
a root over the regions, customers under a second nation too, missing customers, nations that name their
region as a child, nations of the wrong level and customers of other dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph

from .registry import Registry

R = Registry()

_GRAPH = """
edges AS (
  SELECT 'root' AS p, r_regionkey::BIGINT AS ix, 'r' || r_regionkey AS c FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_nationkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || ((c_nationkey + 1) % 25), c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT 'n' || c_nationkey, c_custkey, 'x' || c_custkey FROM customer WHERE c_custkey % 60 = 1
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 'r' || n_regionkey FROM nation WHERE n_nationkey % 10 = 0),
blocks AS (
  SELECT 'root' AS b, 3 AS level, 64 AS dims UNION ALL SELECT 'r' || r_regionkey, 2, 64 FROM region
  UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 2 ELSE 1 END, 64 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 0, CASE WHEN c_custkey % 71 = 0 THEN 32 ELSE 64 END FROM customer)"""
# A depth-first walk enters a block by the least of its simple paths.
_WALK = """walk AS (
  SELECT 'root' AS b, ['root'] AS path, [0::BIGINT] AS way
  UNION ALL SELECT c, list_append(path, c), list_append(way, e.ix) FROM walk JOIN edges e ON e.p = walk.b JOIN blocks ON blocks.b = e.c WHERE NOT list_contains(path, c)),
reached AS (SELECT b, len(min(way)) - 1 AS depth, arg_min(path, way) AS path, min(way) AS way FROM walk GROUP BY b)"""


def _names(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def block_graph(t) -> tuple[DataFrame, DataFrame]:
    customer, nation, region = t("customer").select("c_custkey", "c_nationkey"), t("nation").select("n_nationkey", "n_regionkey"), t("region").select("r_regionkey")
    key = lambda c: F.col(c).cast("long").alias("child_ix")
    second = F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string"))
    edges = region.select(F.lit("root").alias("parent_id"), key("r_regionkey"), _names("r", "r_regionkey").alias("child_id"))
    for part in (
        nation.select(_names("r", "n_regionkey"), key("n_nationkey"), _names("n", "n_nationkey")),
        customer.select(_names("n", "c_nationkey"), key("c_custkey"), _names("c", "c_custkey")),
        customer.where("c_custkey % 50 = 0").select(second, key("c_custkey"), _names("c", "c_custkey")),
        customer.where("c_custkey % 60 = 1").select(_names("n", "c_nationkey"), key("c_custkey"), _names("x", "c_custkey")),
        nation.where("n_nationkey % 10 = 0").select(_names("n", "n_nationkey"), key("n_nationkey"), _names("r", "n_regionkey")),
    ):
        edges = edges.union(part)
    blocks = region.select(_names("r", "r_regionkey").alias("block_id"), F.lit(2).alias("level"), F.lit(64).alias("dims"))
    blocks = blocks.union(region.agg(F.lit("root"), F.lit(3), F.lit(64)).select(F.lit("root"), F.lit(3), F.lit(64)))
    blocks = blocks.union(nation.select(_names("n", "n_nationkey"), F.when(F.col("n_nationkey") % 7 == 0, 2).otherwise(1), F.lit(64)))
    return edges, blocks.union(customer.select(_names("c", "c_custkey"), F.lit(0), F.when(F.col("c_custkey") % 71 == 0, 32).otherwise(64)))


def _roots(spark: SparkSession, *names: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in names))).alias("block_id"))


@R.query(f"""WITH RECURSIVE {_GRAPH}, {_WALK},
o AS (SELECT e.p, e.c, pb.level AS pl, pb.dims AS pd, cb.level AS cl, cb.dims AS cd, list_contains(r.path, e.c) AS cycle, coalesce(list_append(r.way, e.ix) = cr.way AND list_append(r.path, e.c) = cr.path, false) AS enters
  FROM reached r JOIN edges e ON e.p = r.b JOIN blocks pb ON pb.b = e.p LEFT JOIN blocks cb ON cb.b = e.c LEFT JOIN reached cr ON cr.b = e.c)
SELECT 'missing-child' AS kind, p AS parent_id, c AS child_id FROM o WHERE cl IS NULL UNION ALL SELECT 'cycle', p, c FROM o WHERE cycle
UNION ALL SELECT 'shared-child', p, c FROM o WHERE NOT cycle AND cl IS NOT NULL AND NOT enters UNION ALL SELECT 'child-level-not-lower', p, c FROM o WHERE enters AND cl >= pl
UNION ALL SELECT 'embedding-spec-mismatch', p, c FROM o WHERE enters AND cd <> pd""")
def structural_findings(spark: SparkSession, t) -> DataFrame:
    edges, blocks = block_graph(t)
    return graph.findings(edges, blocks, _roots(spark, "root"))


@R.query(f"WITH RECURSIVE {_GRAPH}, {_WALK} SELECT b AS block_id, depth FROM reached")
def rooted_closure(spark: SparkSession, t) -> DataFrame:
    edges, blocks = block_graph(t)
    return graph.traverse(edges, blocks, _roots(spark, "root")).select("block_id", "depth")


_REACH = "reach AS (SELECT r AS root, r AS b FROM (SELECT unnest(['r0', 'r1']) AS r) UNION SELECT root, c FROM reach JOIN edges e ON e.p = reach.b)"
_PLAN = "plan AS (SELECT DISTINCT reach.b, CASE WHEN blocks.b IS NULL THEN 'failed' WHEN c_custkey IS NOT NULL THEN 'skipped' ELSE 'copied' END AS status FROM reach LEFT JOIN blocks ON blocks.b = reach.b LEFT JOIN customer ON 'c' || c_custkey = reach.b AND c_custkey % 3 = 0)"


def _copy(spark: SparkSession, t) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, blocks = block_graph(t)
    roots = _roots(spark, "r0", "r1")
    present = t("customer").where("c_custkey % 3 = 0").select(_names("c", "c_custkey").alias("block_id"))
    return graph.copy_plan(graph.closure(edges, roots), blocks, present), edges, roots


@R.query(f"WITH RECURSIVE {_GRAPH}, {_REACH}, {_PLAN} SELECT b AS block_id, status FROM plan")
def copy_plan(spark: SparkSession, t) -> DataFrame:
    return _copy(spark, t)[0]


@R.query(f"WITH RECURSIVE {_GRAPH}, {_REACH}, {_PLAN} SELECT count(*) AS visited, count(*) FILTER (status = 'copied') AS copied, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM plan")
def copy_report(spark: SparkSession, t) -> DataFrame:
    return graph.copy_report(_copy(spark, t)[0])


@R.query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT b AS block_id, string_agg(root, ',' ORDER BY root) AS roots FROM reach WHERE b NOT IN (SELECT b FROM blocks) GROUP BY b")
def copy_failure_roots(spark: SparkSession, t) -> DataFrame:
    plan, edges, roots = _copy(spark, t)
    return graph.failure_roots(plan.where("status = 'failed'"), edges, roots)
