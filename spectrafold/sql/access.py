"""Views of canonical tables and profiles, and SQL functions, planned only when a statement names them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from spectrafold.functions.rules import first_match
from spectrafold.operators import quotients, wavelet
from spectrafold.plans import cascade, colour, euler, image, quotient, tree, vibration, volume
from spectrafold.sources import driver, tables
from spectrafold.streaming import signals


@dataclass(frozen=True)
class View:
    """A named table: what makes it, given the views it needs, which a user may have replaced."""

    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()


def _coefficients(spark: SparkSession, primes: DataFrame) -> DataFrame:
    return euler.constant_coefficients(primes)


#: Canonical tables: builders from (session, folder).
TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "series": driver.embedding_series,
    "images": driver.images,
    "volumes": driver.volumes,
    "spectra41": driver.spectra41,
    "sparameters": driver.sparameters,
    "supply_edges": driver.supply_edges,
    "rationals": driver.rationals,
    "parameter_points": driver.parameter_points,
    "sensor_events": lambda spark, d: signals.sensor_events(tables.table(spark, d, "events")),
    "trees": lambda spark, d: tables.tree_table(tables.table(spark, d, "pages"), "page_id", "html"),
    "primes": lambda spark, d: tables.prime_table(spark, 1500),
}

#: Views made of other views; each takes the session and the views it needs.
PROFILES: dict[str, View] = {
    "coefficients": View(_coefficients, ("primes",)),
    "coefficient_table": View(lambda spark, coef, primes: euler.coefficient_table(coef, primes), ("coefficients", "primes")),
    "wavelets": View(lambda spark, series: wavelet.haar_1d(series, 8), ("series",)),
    "quotients": View(lambda spark, rationals: quotients.expand_rationals(rationals), ("rationals",)),
    "cascade_profile": View(lambda spark, series: cascade.cascade_profile(series), ("series",)),
    "color_profile": View(lambda spark, spectra: colour.color_profile(spectra, colour.observer_table(spark)), ("spectra41",)),
    "image_profile": View(lambda spark, images: image.image_profile(images, 16, 16), ("images",)),
    "volume_profile": View(lambda spark, volumes: volume.volume_profile(volumes), ("volumes",)),
    "quotient_profile": View(lambda spark, q: quotient.cf_profile(q), ("quotients",)),
    "euler_profile": View(lambda spark, points, table: euler.euler_atlas(points, table, 40), ("parameter_points", "coefficient_table")),
}

#: Scalar functions: name(parameters) and the expression they stand for.
FUNCTIONS: dict[str, str] = {
    "magnitude(re DOUBLE, im DOUBLE) RETURNS DOUBLE": "sqrt(re * re + im * im)",
    "decibel(re DOUBLE, im DOUBLE) RETURNS DOUBLE": "20 * log10(greatest(sqrt(re * re + im * im), 1e-15))",
    "prime_power_re(p DOUBLE, sigma DOUBLE, t DOUBLE) RETURNS DOUBLE": "exp(-sigma * ln(p)) * cos(t * ln(p))",
    "prime_power_im(p DOUBLE, sigma DOUBLE, t DOUBLE) RETURNS DOUBLE": "-exp(-sigma * ln(p)) * sin(t * ln(p))",
    "compactified(radius DOUBLE) RETURNS DOUBLE": "radius / (1 + radius)",
    "gauss_kuzmin(a BIGINT) RETURNS DOUBLE": "-log2(1 - 1 / power(a + 1.0D, 2))",
    "valuation2(n BIGINT) RETURNS DOUBLE": "CASE WHEN n = 0 THEN 0D ELSE round(log2(CAST(n & -n AS DOUBLE))) END",
    "neighbour_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "least(a, b) / (greatest(a, b) + 1e-15)",
    "near_harmonic(freq DOUBLE, base DOUBLE) RETURNS BOOLEAN": "abs(freq - rint(freq / base) * base) < base * 0.05",
    "discriminant_mod(a BIGINT, b BIGINT, p BIGINT) RETURNS BIGINT":
        "pmod(-16 * (4 * (pmod(a, p) * pmod(a, p) % p * pmod(a, p) % p) + 27 * (pmod(b, p) * pmod(b, p) % p)), p)",
    "power_mod(base BIGINT, exponent BIGINT, m BIGINT) RETURNS BIGINT":
        "aggregate(sequence(62, 0, -1), 1L % m, (s, i) -> CASE WHEN (shiftright(exponent, i) & 1) = 1 THEN s * s % m * (base % m) % m ELSE s * s % m END)",
}

#: Table functions: name(parameters), columns, body, and the views they read.
TABLE_FUNCTIONS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "window_statistics(seconds BIGINT)": (
        "sensor BIGINT, window_start BIGINT, n BIGINT, mean DOUBLE, std DOUBLE, rms DOUBLE, energy DOUBLE",
        """SELECT sensor, unix_timestamp(ts) div seconds * seconds, count(*), avg(value), stddev_pop(value), sqrt(avg(value * value)), sum(value * value)
           FROM sensor_events GROUP BY sensor, unix_timestamp(ts) div seconds * seconds""", ("sensor_events",)),
    "band_energy(first BIGINT, last BIGINT)": (
        "series_id BIGINT, energy DOUBLE, share DOUBLE",
        """SELECT series_id, sum(inside), sum(inside) / nullif(sum(whole), 0)
           FROM (SELECT series_id, CASE WHEN pos BETWEEN first AND last THEN value * value ELSE 0D END AS inside, value * value AS whole FROM series) s
           GROUP BY series_id""", ("series",)),
    "euler_terms(sigma DOUBLE, t DOUBLE, terms INT)": (
        "lfunc STRING, k INT, p BIGINT, re DOUBLE, im DOUBLE",
        """SELECT lfunc, k, p, coef * exp(-sigma * ln_p) * cos(t * ln_p), -coef * exp(-sigma * ln_p) * sin(t * ln_p)
           FROM coefficient_table WHERE k <= terms""", ("coefficient_table",)),
    "degree_distribution(least BIGINT)": (
        "graph_id STRING, degree BIGINT, nodes BIGINT",
        """SELECT graph_id, degree, count(*) FROM (SELECT graph_id, src, count(*) AS degree FROM supply_edges GROUP BY graph_id, src) d
           WHERE degree >= least GROUP BY graph_id, degree""", ("supply_edges",)),
}


def _widens(got: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of one type is one of the other: equal types, or from a narrower number to a wider one."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if got == wanted:
        return True
    if type(got) in order and type(wanted) in order:
        return order.index(type(got)) <= order.index(type(wanted))
    return isinstance(wanted, T.DoubleType) and isinstance(got, (T.FloatType, T.ByteType, T.ShortType, T.IntegerType))


class SqlAccess:
    """Statements over the canonical tables of a folder, their profiles and the library's functions.

    ``sql`` makes temporary views and functions of the names that its text holds, and of what these need, each once; a
    view that the caller has made before under such a name is taken instead, and so feeds the profiles that need it.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None):
        self.spark, self.folder = spark, folder
        self.tables = TABLES | (tables or {})
        self.profiles = dict(PROFILES)
        self.made: set[str] = set()
        self.functions = {head.split("(")[0]: (head, body) for head, body in FUNCTIONS.items()}
        self.table_functions = {head.split("(")[0]: (head, *rest) for head, rest in TABLE_FUNCTIONS.items()}

    def names(self) -> list[str]:
        return sorted({*self.tables, *self.profiles, *self.functions, *self.table_functions})

    def replace(self, name: str, df: DataFrame) -> None:
        """Let df stand for a view; profiles made later use it."""
        df.createOrReplaceTempView(name)
        self.made.add(name)

    def declare(
        self, name: str, make: Callable[..., DataFrame], needs: tuple[str, ...], schema: str,
        rules: list[tuple[Column, str, Column | str]] | None = None, default: tuple[str, str] = ("NONE", "no rule holds"),
    ) -> None:
        """A profile of one's own under a declared schema, given as DDL: ``make`` gets the session and the needed views.

        The result must have the declared columns with types that cast without loss to the declared ones; others are dropped.
        ``rules`` (condition, verdict, reason), tried in order, add verdict and reason.
        """
        declared = T.StructType.fromDDL(schema)

        def planned(spark: SparkSession, *views: DataFrame) -> DataFrame:
            got = make(spark, *views)
            kinds = {f.name: f.dataType for f in got.schema}
            wrong = [f"{f.name} {f.dataType.simpleString()}" for f in declared if f.name not in kinds or not _widens(kinds[f.name], f.dataType)]
            if wrong:
                raise TypeError(f"profile {name} does not return {', '.join(wrong)}; it returns {got.schema.simpleString()}")
            out = got.select(*[got[f.name].cast(f.dataType).alias(f.name) for f in declared])
            if rules:
                verdict, reason = first_match(rules, default)
                out = out.select("*", verdict.alias("verdict"), reason.alias("reason"))
            return out

        self.profiles[name] = View(planned, needs)
        self.made.discard(name)

    def view(self, name: str) -> DataFrame:
        self._make(name)
        return self.spark.table(name)

    def sql(self, text: str) -> DataFrame:
        known = set(self.names())
        for name in dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z_]\w*", text)):
            if name in known:
                self._make(name)
        return self.spark.sql(text)

    def _make(self, name: str) -> None:
        if name in self.made:
            return
        self.made.add(name)
        if name in self.functions:
            head, body = self.functions[name]
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        elif name in self.table_functions:
            head, columns, body, needs = self.table_functions[name]
            for other in needs:
                self._make(other)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")
        elif name in self.tables:
            self.tables[name](self.spark, self.folder).createOrReplaceTempView(name)
        else:
            view = self.profiles[name]
            view.make(self.spark, *[self.view(other) for other in view.needs]).createOrReplaceTempView(name)
