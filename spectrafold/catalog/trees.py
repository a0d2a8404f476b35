"""Tree profiles of markup pages."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import with_
from spectrafold.catalog.tables import TREE_SQL
from spectrafold.operators.blocks import consecutive_pairs
from spectrafold.plans import tree
from spectrafold.sources import tables as t


def _tree(spark, d):
    return t.tree_table(t.table(spark, d, "pages"), "page_id", "html")


_KIND = "CASE " + " ".join("WHEN type IN (" + ", ".join(f"'{x}'" for x in types) + f") THEN '{g}'" for g, types in tree.MARKUP_GROUPS.items()) + " END"
TREE = (TREE_SQL, f"""kids AS (SELECT doc_id, parent_id AS node_id, count(*) AS kids FROM tree WHERE parent_id IS NOT NULL GROUP BY 1, 2),
  nd AS (SELECT doc_id, node_id, parent_id, type, depth, coalesce(kids, 0) + CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS k, {_KIND} AS kind FROM tree LEFT JOIN kids USING (doc_id, node_id)),
  ty AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS n_types, -sum(n / tot * ln(n / tot)) AS type_entropy FROM (SELECT doc_id, type, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS tot FROM tree GROUP BY 1, 2) q GROUP BY 1),
  wd AS (SELECT doc_id, max(n) AS width FROM (SELECT doc_id, depth, count(*) AS n FROM tree GROUP BY 1, 2) q GROUP BY 1),
  a AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS N, sum(CASE WHEN parent_id IS NULL THEN 1.0 ELSE 0 END) AS n_components, sum(k) / 2.0::DOUBLE AS E, avg(k) AS avg_degree, stddev_pop(k) / (avg(k) + 1e-15) AS degree_CV, max(k) / (avg(k) + 1e-15) AS degree_max_ratio,
    sum(k) / (count(*) * (count(*) - 1.0::DOUBLE) + 1e-15) AS density, CAST(max(depth) AS DOUBLE) AS max_depth, sum(depth) / count(*) AS mean_depth, coalesce(avg(CASE WHEN k > 1 THEN k - 1 END), 0) AS branching, sum(CASE WHEN k <= 1 THEN 1.0 ELSE 0 END) / count(*) AS leaf_ratio,
    """ + ", ".join(f"sum(CASE WHEN kind = '{g}' THEN 1.0 ELSE 0 END) AS n_{g}" for g in tree.MARKUP_GROUPS) + """ FROM nd GROUP BY 1),
  f AS (SELECT a.* EXCLUDE (n_try), n_types, type_entropy, (n_if + n_for + n_try) / N AS control_ratio, n_call / N AS call_ratio, n_func / N AS func_ratio, max_depth / width AS depth_width_ratio FROM a JOIN ty USING (doc_id) JOIN wd USING (doc_id))""")
_ALL = " ".join(tree.GRAPH_SHAPE) + " " + " ".join(tree.FEATURES)


@query(with_(*TREE) + "SELECT * FROM f", _ALL)
def tree_profile(spark, d):
    return tree.tree_profile(_tree(spark, d), tree.group_table(spark)).drop("tags")


@query(with_(TREE_SQL) + "SELECT doc_id, type, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, type) AS rank FROM (SELECT doc_id, type, count(*) AS n FROM tree GROUP BY 1, 2) q) z WHERE rank <= 8")
def frequent_node_types(spark, d):
    return tree.frequent_types(_tree(spark, d))


@query(with_(TREE_SQL) + "SELECT min(doc_id) AS first_doc, count(*) AS n_docs, n_nodes FROM (SELECT doc_id, string_agg(concat(type, ':', depth), ',' ORDER BY node_id) AS sig, count(*) AS n_nodes FROM tree GROUP BY 1) q GROUP BY sig, n_nodes")
def structural_copies(spark, d):
    return tree.structural_copies(_tree(spark, d)).drop("signature")


@query(with_(*TREE, "v AS (SELECT doc_id, [" + ", ".join(f'"{c}"' for c in _ALL.split()) + "] AS v FROM f)", "p AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM v)") +
       "SELECT a, b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS similarity, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) > 0.85 AS clone FROM p JOIN v x ON x.doc_id = a JOIN v y ON y.doc_id = b", "similarity")
def page_similarity(spark, d):
    """Each page against the next one."""
    profile = tree.tree_profile(_tree(spark, d), tree.group_table(spark))
    pages = t.table(spark, d, "pages").select(F.lit(0).alias("_all"), F.col("page_id"))
    return tree.profile_similarity(profile, "doc_id", _ALL.split(), consecutive_pairs(pages, ["_all"], "page_id"))
