"""Rows of profiles within a distance of each other."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import SERIES, with_
from spectrafold.catalog.trees import TREE, _tree
from spectrafold.operators.neighbours import class_links, similarity_counts, vector_classes
from spectrafold.plans import tree
from spectrafold.sources import driver

SHAPE = "leaf_ratio control_ratio call_ratio func_ratio type_entropy depth_width_ratio degree_CV".split()

COUNTS = """SELECT a.id, min(b.id) FILTER (b.v = a.v) AS class_id, CAST(count(*) FILTER (list_distance(a.v, b.v) <= {radius}) - 1 AS BIGINT) AS n_links
  FROM vec a, vec b GROUP BY a.id"""


@query(with_(*TREE, "vec AS (SELECT doc_id AS id, [" + ", ".join(f"CAST({c} AS DOUBLE)" for c in SHAPE) + "] AS v FROM (SELECT doc_id, "
             + ", ".join(f"round({c}, 6) AS {c}" for c in SHAPE) + " FROM f) q)") + COUNTS.format(radius=0.0503))
def similar_pages(spark, d):
    """Pages whose tree features lie within a radius of each other."""
    shape = tree.tree_profile(_tree(spark, d), tree.group_table(spark))
    vector = F.array(*[F.round(c, 6) for c in SHAPE])
    return similarity_counts(shape.select("doc_id", vector.alias("v")), "doc_id", "v", 0.0503)


BANDS = """vec AS (SELECT series_id AS id, list(round(e, 6) ORDER BY band) AS v FROM (
  SELECT series_id, pos // 8 AS band, sum(value * value) AS e FROM series GROUP BY 1, 2) q GROUP BY 1)"""


def _bands(spark, d):
    rows = driver.embedding_series(spark, d).groupBy("series_id", F.expr("pos div 8").alias("band")).agg(F.sum(F.col("value") * F.col("value")).alias("e"))
    return rows.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.round("e", 6).alias("e")))), lambda b: b["e"]).alias("v"))


@query(with_(SERIES, BANDS) + COUNTS.format(radius=0.06003))
def similar_band_energies(spark, d):
    """Vectors whose energies in eight bands lie within a radius of each other."""
    return similarity_counts(_bands(spark, d), "series_id", "v", 0.06003)


@query(with_(SERIES, BANDS) + """, cls AS (SELECT v, min(id) AS id FROM vec GROUP BY v)
  SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS distance FROM cls a JOIN cls b ON a.id < b.id AND list_distance(a.v, b.v) <= 0.06003""", "distance")
def band_energy_links(spark, d):
    """The pairs behind similar_band_energies, between first rows of equal vectors."""
    rows = _bands(spark, d).select(F.col("series_id").alias("id"), F.col("v").alias("vector"))
    return class_links(vector_classes(rows), 0.06003).select("a", "b", "distance")
