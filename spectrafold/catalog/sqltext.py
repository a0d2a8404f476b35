"""Table expressions the SQL twins share."""

SERIES = """series AS (
  SELECT vec_id AS series_id, label, u.i AS pos, CAST(embedding[u.i + 1] AS DOUBLE) AS value
  FROM embeddings, UNNEST(range(len(embedding))) AS u(i))"""

IMAGES = SERIES + """, image AS (
  SELECT series_id // 4 AS img_id, (series_id % 4) * 4 + pos // 16 AS y, pos % 16 AS x, value AS v FROM series)"""

VOLUMES = SERIES + """, volume AS (
  SELECT series_id // 8 AS vol_id, series_id % 8 AS x, pos // 8 AS y, pos % 8 AS z, value AS v FROM series)"""

SPECTRA41 = SERIES + """, spectrum AS (
  SELECT series_id, pos * 41 // 64 AS idx, 380.0::DOUBLE + 10 * (pos * 41 // 64) AS nm, avg(abs(value)) AS amp FROM series GROUP BY 1, 2, 3)"""

EVENTS = """series AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value
  FROM events)"""

SPARAM = SERIES + """, sparam AS (
  SELECT series_id // 25 AS meas_id, ((series_id % 25) * 2 + pos // 32 + 1) * 4e8 AS freq,
         ((pos % 32) // 2) // 4 AS i, ((pos % 32) // 2) % 4 AS j,
         max(CASE WHEN pos % 2 = 0 THEN value END) AS re, max(CASE WHEN pos % 2 = 1 THEN value END) AS im
  FROM series GROUP BY ALL)"""

SUPPLY = """edges AS (
  SELECT DISTINCT l_returnflag AS graph_id, s.src, s.dst FROM (
    SELECT l_returnflag, l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem
    UNION ALL SELECT l_returnflag, -l_suppkey - 1, l_partkey FROM lineitem) s)"""

TRADE = """trade AS (
  SELECT o_orderpriority AS g, c_nationkey AS a, s_nationkey AS b, sum(l_extendedprice) AS value FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
edges AS (
  SELECT DISTINCT g AS graph_id, src, dst FROM (SELECT *, avg(value) OVER (PARTITION BY g) AS mean FROM trade) t,
    LATERAL (SELECT a AS src, b AS dst UNION ALL SELECT b, a) e
  WHERE a <> b AND value > 1.15 * mean)"""

RATIONALS = """rationals AS (
  SELECT o_orderkey AS seq_id, CAST(round(o_totalprice * 100) AS BIGINT) AS num, o_custkey * 9973 + o_orderkey + 1 AS den
  FROM orders)"""

POINTS = """points AS (
  SELECT p_partkey AS point_id, 0.4 + p_size / 100.0::DOUBLE AS sigma, p_retailprice / 40.0::DOUBLE AS t,
         CAST(p_partkey % 16 + 15 AS INTEGER) AS kmax FROM part)"""


def primes(limit: int) -> str:
    return f"""primes AS (
  SELECT CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS k, p, ln(p) AS ln_p FROM (SELECT unnest(range(2, {limit} + 1)) AS p) n
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, CAST(sqrt({limit}) AS BIGINT) + 1)) AS d) v
                    WHERE d * d <= p AND p % d = 0))"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
