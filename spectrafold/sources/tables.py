"""Builders of the canonical long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from spectrafold.operators.blocks import dense_index

VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# the limit of a prime table that one task numbers
ONE_TASK = 20_000
TRIAL_BELOW = 1_000_000
STRONG_BASES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prime_table(spark: SparkSession, max_p: int) -> DataFrame:
    """(k, p, ln_p) for all primes up to max_p.

    Every number is tested inside its row, so nothing is shuffled before the numbering.
    """
    primes = spark.range(2, max_p + 1).withColumnRenamed("id", "p").where(is_prime("p"))
    ranked = dense_index(primes.withColumn("_all", F.lit(0)), ["_all"], ["p"], "k", bounded=max_p <= ONE_TASK)
    return ranked.select((F.col("k") + 1).cast("int").alias("k"), "p", F.ln(F.col("p").cast("double")).alias("ln_p"))


def is_prime(n: str | Column) -> Column:
    """Primality of a BIGINT inside the row, exact for all of them; at most a thousand divisors are walked.

    Below a million no divisor d may have d * d <= n. Above, n must pass the strong test to the first twelve primes,
    which no composite below 2^64 does.
    """
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    bases = F.array(*[F.lit(p).cast("long") for p in STRONG_BASES])
    root = F.floor(F.sqrt(F.greatest(F.least(n, F.lit(TRIAL_BELOW)), F.lit(4)).cast("double")))
    small = (n >= 2) & F.forall(F.sequence(F.lit(2).cast("long"), root), lambda d: (n % d != 0) | (n == d))
    large = F.forall(bases, lambda p: n % p != 0) & F.forall(bases, lambda a: _passes_strong_test(n, a))
    return F.when(n < TRIAL_BELOW, small).otherwise(large)


def _passes_strong_test(n: Column, base: Column) -> Column:
    """base^(n - 1) is 1 modulo n, and on the way no square is 1 but those of 1 and -1; products are exact decimals."""
    def times(a: Column, b: Column) -> Column:
        return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % n.cast("decimal(19,0)")).cast("long")

    def step(state: Column, bit: Column) -> Column:
        square = times(state["power"], state["power"])
        plain = (square != 1) | (state["power"] == 1) | (state["power"] == n - 1)
        odd = F.call_function("shiftright", n - 1, bit).bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(odd, times(square, base)).otherwise(square).alias("power"), (state["plain"] & plain).alias("plain"))

    start = F.struct(F.lit(1).cast("long").alias("power"), F.lit(True).alias("plain"))
    bits = F.sequence(F.lit(62), F.lit(0), F.lit(-1))
    return F.aggregate(bits, start, step, lambda s: s["plain"] & (s["power"] == 1))


def edge_table(df: DataFrame, graph: str, src: str, dst: str, keep_loops: bool = False) -> DataFrame:
    """Undirected 0/1 adjacency in both directions; duplicates and loops collapse.

    Rows are de-duplicated as unordered pairs first, so the symmetrising doubles only distinct edges.
    """
    pairs = df.select(
        F.col(graph).alias("graph_id"), F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")
    ).where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    if not keep_loops:
        pairs = pairs.where("lo <> hi")
    pairs = pairs.distinct()
    both = F.when(
        F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")))
    ).otherwise(
        F.array(
            F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")),
            F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")),
        )
    )
    return pairs.select("graph_id", F.explode(both).alias("e")).select("graph_id", "e.src", "e.dst")


def point_grid(df: DataFrame, sigma: Column, t: Column, kmax: Column) -> DataFrame:
    """Expand each row into the grid of its sigma, t and K arrays."""
    grid = df.withColumn("sigma", F.explode(sigma)).withColumn("t", F.explode(t)).withColumn("kmax", F.explode(kmax))
    return grid


def series_from_arrays(df: DataFrame, series_id: str, values: str, keep: Sequence[str] = ()) -> DataFrame:
    """(series_id, pos, value) from an array column; positions come with the array, nothing is sorted."""
    return df.select(F.col(series_id).alias("series_id"), *keep, F.posexplode(values).alias("pos", "value")).select(
        "series_id", *keep, F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")
    )


def series_table(df: DataFrame, series_id: str, order: Sequence[str], value: str) -> DataFrame:
    """(series_id, pos, value) from rows in a total order; hot series are numbered across partitions."""
    rows = df.select(F.col(series_id).alias("series_id"), *order, F.col(value).cast("double").alias("value"))
    return dense_index(rows, ["series_id"], list(order), "pos").select("series_id", "pos", "value")


def tree_table(df: DataFrame, doc_id: str, html: str) -> DataFrame:
    """(doc_id, node_id, parent_id, type, depth): preorder walk of the markup of whole documents.

    Closing tags lower the depth, void tags leave it; the parent is the last
    earlier node one level up.  All windows stay inside one document.
    """
    clean = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    clean = F.regexp_replace(clean, r"(?si)<(script|style)([^>]*)>.*?</(script|style)>", "<$1></$1>")
    tags = F.regexp_extract_all(clean, F.lit(r"(</?[a-zA-Z][a-zA-Z0-9]*[^>]*>)"), 1)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(tags).alias("at", "tag"))
    rows = rows.withColumn("type", F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)))
    closing = F.col("tag").startswith("</")
    flat = F.col("type").isin(*VOID_TAGS) | F.col("tag").endswith("/>")
    step = F.when(closing, -1).when(flat, 0).otherwise(1)
    upto = W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    opened = F.sum(F.when(~closing, 1).otherwise(0)).over(upto)
    rows = rows.withColumn("_step", step).withColumn("_closing", closing)
    level = F.sum("_step").over(upto)
    nodes = rows.select(
        "doc_id", "type", "_closing", (opened - 1).alias("node_id"),
        (level - F.when(F.col("_step") == 1, 1).otherwise(0)).cast("int").alias("depth"),
    ).where("NOT _closing")
    views = nodes.withColumn(
        "_v", F.explode(F.array(
            F.struct(F.col("depth").alias("level"), F.col("node_id").alias("own")),
            F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast("long").alias("own")),
        ))
    )
    earlier = W.partitionBy("doc_id", "_v.level").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    parents = views.withColumn("parent_id", F.last("_v.own", ignorenulls=True).over(earlier))
    return parents.where("_v.own IS NULL").select("doc_id", "node_id", "parent_id", "type", "depth")


def block_table(image: DataFrame, size: int) -> DataFrame:
    """Cut images into size x size tiles, partial tiles dropped; adds tile coordinates and local y, x."""
    dims = image.groupBy("img_id").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    return (
        image.join(dims, "img_id")
        .withColumn("by", F.expr(f"y div {size}"))
        .withColumn("bx", F.expr(f"x div {size}"))
        .where((F.col("by") < F.expr(f"ny div {size}")) & (F.col("bx") < F.expr(f"nx div {size}")))
        .select("img_id", "by", "bx", (F.col("y") % size).alias("y"), (F.col("x") % size).alias("x"), "v")
    )


def feature_vector(df: DataFrame, names: Sequence[str], to: str = "features") -> DataFrame:
    """Pack named columns into a positional ARRAY<DOUBLE>."""
    return df.withColumn(to, F.array(*[F.col(n).cast("double") for n in names]))


def melt_features(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide features to (ids, feature, value)."""
    return df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(ids), list(names), "feature", "value"
    )


def feature_sink(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a feature table; json and parquet keep the column names."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)
