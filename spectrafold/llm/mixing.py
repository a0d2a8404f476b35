"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spectrafold.llm.common import WORD_CLASS

BLOCK_ROWS = 2_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of words in the text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source_key, source_size, n_rows, target): one row per source.

    Sources in code point order, null last, take the weights in turn. The budget is `share` times all sizes. A
    source is clamped at max_epochs times its size when its weighted part of the budget is above that; its excess
    goes to the others by weight, until none is above. Sources sorted by size per weight are clamped in that order,
    so the level at which redistribution ends is the largest of the levels that the sorted prefixes give. The
    window without a key sees one row per source, after aggregation.
    """
    sources = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sources.withColumn("weight", turn[((F.row_number().over(order) - 1) % len(weights)).cast("int")])
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    later = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(later))
    level = F.max("level").over(whole)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return levels.select("source_key", "source_size", "n_rows", F.greatest(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame, size: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7,
    keep: Column | None = None,
) -> DataFrame:
    """(row, doc_id, size, source_size, target, whole, extra, taken): how much of each document the mix takes.

    Each document of a source is taken `whole` times, the whole part of target / source size. What is still missing
    is taken from the source's documents in the order of a seeded hash; the document in which the target falls gives
    a part of its words, so the words taken from a source are its rounded target. `keep` is any column to carry
    along as `row`. The running sums go over blocks of hash ranges, of about BLOCK_ROWS documents however large a
    source is. Null sources are a source of their own; null ids sort first and share one hash; repeated rows are
    documents of their own; empty documents are taken with no words; an empty table gives no rows.
    """
    carried = docs.select(
        (F.lit(None).cast("int") if keep is None else keep).alias("row"), "doc_id", "source", size.alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    hashed = carried.withColumn("_u", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    targets = source_targets(carried, weights, share, max_epochs)
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # a hot source meets its target in many tasks
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    placed = (
        hashed.drop("source").withColumn("_salt", F.col("_u") % SALTS).join(salted, ["source_key", "_salt"])
        .withColumn("_block", F.floor(F.col("_u") * blocks / F.lit(2.0**32)).cast("long"))
    )
    sums = placed.groupBy("source_key", "_block").agg(F.sum("size").alias("_sum"))
    before_block = Window.partitionBy("source_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "_block", F.coalesce(F.sum("_sum").over(before_block), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source_key", "_block").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_until", F.sum("size").over(inside)).join(offsets, ["source_key", "_block"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    missing = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    start = F.col("_offset") + F.col("_until") - F.col("size")
    return (
        running.withColumn("whole", whole)
        .withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), missing - start)))
        .select("row", "doc_id", "size", "source_size", "target", "whole", "extra",
                (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last time perhaps only its first words.

    Rows repeat; all columns of docs stay. Of a part, the text is cut after its last word and n_chars follows.
    """
    plan = mix_sources(docs, word_count(F.col("text")), keep=F.struct(*docs.columns), **options)
    full = F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") == F.col("size")).cast("long")).otherwise(F.col("whole"))
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    copies = plan.withColumn("_full", full).withColumn("_copies", F.col("_full") + part.cast("long")).where("_copies > 0")
    rows = copies.select("row", "extra", "_full", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD_CLASS), F.lit(0)), 1, F.col("extra").cast("int")), "")
    whole_row = F.col("_copy") <= F.col("_full")
    text = F.when(whole_row, F.col("row.text")).otherwise(cut)
    out = rows.withColumn("_text", text)
    fields = {"text": F.col("_text"), "n_chars": F.when(whole_row, F.col("row.n_chars")).otherwise(F.length("_text").cast("long"))}
    return out.select(*[fields.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS u FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER
      (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ranked),
targets AS (SELECT source, source_size, greatest(0, least(CAST(cap AS DOUBLE), weight * max(level) OVER ())) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken
FROM placed
""".replace(' COLLATE "C"', "")
