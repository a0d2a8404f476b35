"""Sources and builders."""

from pyspark.sql import functions as F

from spectrafold.catalog.registry import query
from spectrafold.catalog.sqltext import EVENTS, IMAGES, SPARAM, SUPPLY, with_
from spectrafold.sources import driver, tables as t, touchstone


@query("""WITH primes AS (SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS k, p, ln(p) AS ln_p FROM (SELECT unnest(range(2, (SELECT max(p_partkey) + 1 FROM part))) AS p) n
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, (SELECT CAST(sqrt(max(p_partkey)) AS BIGINT) + 2 FROM part))) AS d) v WHERE d * d <= p AND p % d = 0))
  SELECT p_partkey, k, ln_p, p_retailprice FROM part JOIN primes ON p_partkey = p""", "ln_p p_retailprice")
def prime_part_keys(spark, d):
    """Parts with a prime key and the rank of that prime; the sieve grows with the largest key."""
    part = t.table(spark, d, "part").select("p_partkey", "p_retailprice")
    largest = part.agg(F.max("p_partkey")).first()[0]
    return part.join(t.prime_table(spark, largest), F.col("p_partkey") == F.col("p")).drop("p")


@query(with_(SUPPLY) + """SELECT graph_id, degree, count(*) AS n_nodes FROM (
  SELECT graph_id, src, count(*) AS degree FROM edges GROUP BY ALL) x GROUP BY ALL""")
def undirected_edge_degrees(spark, d):
    degree = driver.supply_edges(spark, d).groupBy("graph_id", "src").agg(F.count("*").alias("degree"))
    return degree.groupBy("graph_id", "degree").agg(F.count("*").alias("n_nodes"))


@query("""SELECT p_partkey, s.sigma, 14.0::DOUBLE + p_size / 10.0::DOUBLE + u.i * 0.5::DOUBLE AS t, v.kmax FROM part,
  (SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS sigma) s, (SELECT unnest(range(3)) AS i) u,
  (SELECT unnest([10, 30]) AS kmax) v""", "sigma t")
def parameter_grid(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", "p_size")
    base = F.lit(14.0) + F.col("p_size") / 10.0
    grid = t.point_grid(
        part,
        F.array(F.lit(0.5), F.lit(0.75), F.lit(1.0)),
        F.array(base, base + 0.5, base + 1.0),
        F.array(F.lit(10), F.lit(30)),
    )
    return grid.select("p_partkey", "sigma", "t", "kmax")


@query(with_(EVENTS) + "SELECT series_id, pos, value FROM series", "value")
def event_series(spark, d):
    return t.series_table(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


TREE_SQL = """tags AS (
  SELECT page_id AS doc_id, u.i AS seq, found[u.i] AS tag FROM (SELECT page_id, regexp_extract_all(
    regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?si)<(script|style)([^>]*)>.*?</(script|style)>', '<\\1></\\1>', 'g'),
    '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>') AS found FROM pages) p, UNNEST(range(1, len(found) + 1)) AS u(i)),
typed AS (SELECT doc_id, seq, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS type,
    starts_with(tag, '</') AS closing, tag FROM tags),
steps AS (SELECT *, CASE WHEN closing THEN -1 WHEN type IN
    ('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr') OR ends_with(tag, '/>')
    THEN 0 ELSE 1 END AS step FROM typed),
walked AS (SELECT *, sum(CASE WHEN closing THEN 0 ELSE 1 END) OVER w - 1 AS node_id, sum(step) OVER w AS level FROM steps
    WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
nodes AS (SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, type,
    CAST(level - CASE WHEN step = 1 THEN 1 ELSE 0 END AS INTEGER) AS depth FROM walked WHERE NOT closing),
tree AS (SELECT n.doc_id, n.node_id, p.node_id AS parent_id, n.type, n.depth FROM nodes n
    ASOF LEFT JOIN (SELECT doc_id, depth + 1 AS below, node_id FROM nodes) p
    ON n.doc_id = p.doc_id AND n.depth = p.below AND n.node_id > p.node_id)"""


@query(with_(TREE_SQL) + "SELECT * FROM tree")
def page_trees(spark, d):
    return t.tree_table(t.table(spark, d, "pages"), "page_id", "html")


@query(with_(IMAGES) + """SELECT img_id, CAST(y // 8 AS INTEGER) AS by, CAST(x // 8 AS INTEGER) AS bx, count(*) AS n,
  avg(v) AS mean, stddev_pop(v) AS std
  FROM image JOIN (SELECT img_id, max(y) + 1 AS ny, max(x) + 1 AS nx FROM image GROUP BY 1) s USING (img_id)
  WHERE y // 8 < ny // 8 AND x // 8 < nx // 8 GROUP BY ALL""", "mean std")
def image_blocks(spark, d):
    blocks = t.block_table(driver.images(spark, d), 8)
    return blocks.groupBy("img_id", F.col("by").cast("int").alias("by"), F.col("bx").cast("int").alias("bx")).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )


@query(with_(SPARAM) + "SELECT * REPLACE (CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j) FROM sparam", "freq re im")
def touchstone_round_trip(spark, d):
    files = touchstone.touchstone_text(driver.sparameters(spark, d))
    return touchstone.parse_touchstone(files).withColumn("freq", F.round("freq", 0))


@query("""SELECT s_suppkey, feature, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance
  FROM supplier) UNPIVOT (value FOR feature IN (nation, balance))""", "value")
def melted_suppliers(spark, d):
    suppliers = t.table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    packed = t.feature_vector(suppliers, ["nation", "balance"])
    named = packed.select("s_suppkey", F.col("features")[0].alias("nation"), F.col("features")[1].alias("balance"))
    return t.melt_features(named, ["s_suppkey"], ["nation", "balance"])
