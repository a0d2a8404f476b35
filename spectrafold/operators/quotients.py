"""Continued fractions of exact rationals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Euclid's steps per decimal digit of the smaller number, at most; two more at each end.
STEPS_PER_DIGIT = 4.8


def _terms(max_terms: int) -> Column:
    """Array of the quotients of num / den: Euclid inside the row on 64-bit integers, where it needs at most 91 steps.

    The state is copied at every step, so it holds plain numbers, and a row takes as many steps as its digits may need.
    """
    num, den = F.col("num").cast("long"), F.col("den").cast("long")
    start = F.struct(num.alias("n"), den.alias("d"), F.expr("cast(array() as array<bigint>)").alias("terms"))
    digits = F.log10(F.least(F.abs(num), den).cast("double") + 1)
    steps = F.least(F.coalesce(F.ceil(digits * STEPS_PER_DIGIT) + 4, F.lit(max_terms)), F.lit(max_terms)).cast("int")

    def step(state, _):
        d = F.when(state["d"] != 0, state["d"])
        rest = F.pmod(state["n"], d)
        whole = F.call_function("div", state["n"] - rest, d)
        return F.when(
            state["d"] != 0, F.struct(state["d"].alias("n"), rest.alias("d"), F.concat(state["terms"], F.array(whole)).alias("terms"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["terms"])


def _next_denominator(state: Column, a: Column) -> tuple[Column, Column]:
    return (a * state["q1"] + state["q0"]).alias("q1"), state["q1"].alias("q0")


def _before_all() -> tuple[Column, Column]:
    return F.lit(0).cast("long").alias("q1"), F.lit(1).cast("long").alias("q0")


def last_denominator(terms: Column) -> Column:
    """Denominator of the last convergent."""
    return F.aggregate(terms, F.struct(*_before_all()), lambda s, a: F.struct(*_next_denominator(s, a)), lambda s: s["q1"])


def denominators(terms: Column) -> Column:
    """Array of the denominators of all convergents."""
    start = F.struct(*_before_all(), F.expr("cast(array() as array<bigint>)").alias("all"))

    def step(state, a):
        q, before = _next_denominator(state, a)
        return F.struct(q, before, F.concat(state["all"], F.array(a * state["q1"] + state["q0"])).alias("all"))

    return F.aggregate(terms, start, step, lambda s: s["all"])


def expand_rationals(rationals: DataFrame, max_terms: int = 92) -> DataFrame:
    """(seq_id, k, a, q): partial quotients and convergent denominators of num / den."""
    rows = rationals.where("den > 0").select("seq_id", _terms(max_terms).alias("a"))
    rows = rows.select("seq_id", F.posexplode(F.arrays_zip("a", denominators(F.col("a")).alias("q"))).alias("k", "term"))
    return rows.select("seq_id", "k", "term.a", "term.q")


def rational_rows(rationals: DataFrame, max_terms: int = 92) -> DataFrame:
    """(seq_id, a, q): one row per num / den with the array of its quotients after a_0 and its last denominator.

    Nothing is shuffled: a sequence of 64-bit quotients is an array of at most 91.
    """
    rows = rationals.where("den > 0").select("seq_id", _terms(max_terms).alias("terms"))
    return rows.select("seq_id", F.expr("slice(terms, 2, size(terms))").alias("a"), last_denominator(F.col("terms")).alias("q"))


def sequence_rows(quotients: DataFrame) -> DataFrame:
    """The same rows from a long table (seq_id, k, a, q), by one grouping."""
    inner = F.when((F.col("k") >= 1) & F.col("a").isNotNull(), F.struct("k", "a"))
    return quotients.groupBy("seq_id").agg(F.sort_array(F.collect_list(inner))["a"].alias("a"), F.max_by("q", "k").alias("q"))
