"""Tables in the shared folder, bounded tiles and the fixed held-out split."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spectrafold.session import _ensure_checkpoint_dir

WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, read by Spark. Python workers find this package where the driver has it,
    unless it was handed to them in another way."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Written tables in the folder that spark.checkpoint.dir names; they outlive lost executors."""

    def __init__(self, spark: SparkSession):
        _ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """df written and read back; its plan starts at the files."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, saved: DataFrame) -> None:
        """Delete a table of this folder that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(saved.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row belongs to the held-out fold; a null id does not."""
    return crc_fold(doc_id).eqNullSafe(F.lit(2))


def tiles(df: DataFrame, key: str, spread: str, size: int, columns: list[str]) -> DataFrame:
    """(key, tile, rows): the rows of each key in tiles of about `size` rows, however many rows a key has.

    `spread` is a column with distinct values; its hash deals the rows of a key over its tiles.
    """
    counts = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_tiles"))
    return (
        df.join(counts, key)
        .withColumn("tile", F.pmod(F.xxhash64(F.lit(7), F.col(spread)), F.col("_tiles")))
        .groupBy(key, "tile")
        .agg(F.collect_list(F.struct(*columns)).alias("rows"))
    )
