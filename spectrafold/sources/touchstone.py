"""4-port Touchstone (version 1) files, read as text and parsed with column expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_touchstone(spark: SparkSession, path: str) -> DataFrame:
    """One row per (meas_id, freq, i, j) from a folder of files; meas_id is the file path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("meas_id"), F.col("value").alias("text"))
    return parse_touchstone(files)


def parse_touchstone(files: DataFrame) -> DataFrame:
    """Parse (meas_id, text).

    '!' starts a comment, '#' the option line (unit, then MA, DB or RI); 33 numbers
    make a frequency, an incomplete last record is dropped.
    """
    plain = F.regexp_replace("text", r"![^\n]*", "")
    option = F.upper(F.regexp_extract(plain, r"(?m)^[ \t]*#([^\n]*)", 1))
    unit = F.regexp_extract(option, r"\b(HZ|KHZ|MHZ|GHZ)\b", 1)
    layout = F.regexp_extract(option, r"\b(MA|DB|RI)\b", 1)
    body = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?m)^[ \t]*#[^\n]*", ""), r"\s+", " "))
    numbers = F.transform(
        F.filter(F.split(body, " "), lambda x: x != ""), lambda x: x.cast("double")
    )
    files = files.select(
        "meas_id",
        F.when(unit == "HZ", 1.0).when(unit == "KHZ", 1e3).when(unit == "MHZ", 1e6).otherwise(1e9).alias("unit"),
        F.when(layout == "", "MA").otherwise(layout).alias("layout"),
        numbers.alias("numbers"),
    )
    record = F.expr("transform(sequence(0, cast(size(numbers) div 33 as int) - 1), r -> slice(numbers, r * 33 + 1, 33))")
    records = files.where(F.size("numbers") >= 33).select("meas_id", "unit", "layout", F.explode(record).alias("record"))
    pairs = F.expr("transform(sequence(0, 15), s -> struct(s, record[2 * s + 1] AS a, record[2 * s + 2] AS b))")
    cells = records.select(
        "meas_id", (F.col("record")[0] * F.col("unit")).alias("freq"), "layout", F.explode(pairs).alias("c")
    )
    angle = F.col("c.b") * F.lit(math.pi / 180)
    size = F.when(F.col("layout") == "DB", F.pow(F.lit(10.0), F.col("c.a") / 20)).otherwise(F.col("c.a"))
    cartesian = F.col("layout") == "RI"
    return cells.select(
        "meas_id", "freq",
        F.expr("c.s div 4").cast("int").alias("i"), (F.col("c.s") % 4).cast("int").alias("j"),
        F.when(cartesian, F.col("c.a")).otherwise(size * F.cos(angle)).alias("re"),
        F.when(cartesian, F.col("c.b")).otherwise(size * F.sin(angle)).alias("im"),
    )


def touchstone_text(sparam: DataFrame) -> DataFrame:
    """(meas_id, text) in RI format and GHz: the inverse of the parser, one line per frequency."""
    lines = sparam.groupBy("meas_id", "freq").agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "re", "im"))).alias("cells")
    )
    cells = F.transform("cells", lambda c: F.concat_ws(" ", c["re"].cast("string"), c["im"].cast("string")))
    line = F.concat_ws(" ", (F.col("freq") / 1e9).cast("string"), F.array_join(cells, " "))
    lines = lines.select("meas_id", F.struct("freq", line.alias("line")).alias("row"))
    return lines.groupBy("meas_id").agg(F.array_sort(F.collect_list("row")).alias("rows")).select(
        "meas_id",
        F.concat(F.lit("! written by spectrafold\n# GHZ S RI R 50\n"), F.array_join(F.col("rows.line"), "\n")).alias("text"),
    )
