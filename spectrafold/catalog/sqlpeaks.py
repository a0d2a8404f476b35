"""SQL form of peak finding for the twins (series without plateaus)."""


def peaks_sql(src: str, height: str = "-1e300", distance: str = "1", prominence: str = "0", prefix: str = "pk") -> str:
    """CTEs ending in {prefix}(g, pos, v, prom) from src(g, pos, v) with threshold columns of src usable in the texts."""
    return f"""{prefix}_n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM {src} WINDOW w AS (PARTITION BY g ORDER BY pos)),
  {prefix}_c AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, pos DESC) AS rn, {distance} AS dist FROM {prefix}_n WHERE v > pv AND v > nv AND v >= {height}),
  {prefix}_w AS (SELECT g, rn, [pos] AS kept FROM {prefix}_c WHERE rn = 1 UNION ALL
    SELECT c.g, c.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - c.pos) < c.dist)) = 0 THEN list_append(kept, c.pos) ELSE kept END
    FROM {prefix}_w w JOIN {prefix}_c c ON c.g = w.g AND c.rn = w.rn + 1),
  {prefix}_k AS (SELECT g, unnest(arg_max(kept, rn)) AS pos FROM {prefix}_w GROUP BY g),
  {prefix}_h AS (SELECT c.g, c.pos, c.v, max(CASE WHEN s.pos < c.pos AND s.v > c.v THEN s.pos END) AS lo, min(CASE WHEN s.pos > c.pos AND s.v > c.v THEN s.pos END) AS hi
    FROM {prefix}_c c JOIN {prefix}_k k ON c.g = k.g AND c.pos = k.pos JOIN {src} s ON s.g = c.g GROUP BY 1, 2, 3),
  {prefix}_p AS (SELECT h.g, h.pos, h.v, h.v - greatest(min(CASE WHEN s.pos <= h.pos AND s.pos > coalesce(h.lo, -1) THEN s.v END),
      min(CASE WHEN s.pos >= h.pos AND s.pos < coalesce(h.hi, 1000000000) THEN s.v END)) AS prom FROM {prefix}_h h JOIN {src} s ON s.g = h.g GROUP BY h.g, h.pos, h.v),
  {prefix} AS (SELECT p.* FROM {prefix}_p p JOIN {prefix}_c c ON p.g = c.g AND p.pos = c.pos WHERE p.prom >= {prominence})"""
