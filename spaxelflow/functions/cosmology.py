"""Flat w0-wa cosmology as columns: distances and ages by the trapezoid rule over an array column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# m/s, cm in a Mpc, seconds in a year.
C_SPEED, MPC, YEAR = 2.99792458e8, 3.08567758149e24, 31556925.2


@dataclass(frozen=True)
class Cosmology:
    om0: float = 0.3075
    w0: float = -1.0
    wa: float = 0.0
    h: float = 0.6774

    def e(self, z: Column) -> Column:
        a = 1 / (1 + z)
        dark = F.pow(a, F.lit(-3.0 * (1 + self.w0 + self.wa))) * F.exp(-3.0 * self.wa * (1 - a))
        return F.sqrt(self.om0 * F.pow(1 + z, F.lit(3.0)) + (1 - self.om0) * dark)

    @property
    def hubble_time(self) -> float:
        return 1e-16 * MPC / YEAR / self.h


PLANCK15 = Cosmology()


def trapezoid(xs: Column, f) -> Column:
    """Integral of f over an array column of points."""
    n = F.size(xs)
    steps = F.sequence(F.lit(1), n - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.get(xs, i) - F.get(xs, i - 1)) * (f(F.get(xs, i)) + f(F.get(xs, i - 1))) / 2)


def _points(z: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: z * i / (n - 1))


def comoving_distance(z: Column, c: Cosmology = PLANCK15) -> Column:
    return trapezoid(_points(z, 256), lambda x: 1 / c.e(x)) * (C_SPEED * 1e-5 / c.h)


def distance_columns(df: DataFrame, z: str = "redshift", c: Cosmology = PLANCK15) -> DataFrame:
    """Adds comoving, luminosity and angular-diameter distance (Mpc), distance modulus, kpc per arcsec."""
    out = df.withColumn("comoving", comoving_distance(F.col(z), c))
    return out.withColumns(
        {"luminosity": F.col("comoving") * (1 + F.col(z)), "angular": F.col("comoving") / (1 + F.col(z)), "modulus": 5 * F.log10(F.col("comoving") * (1 + F.col(z)) * 1e5), "kpc_per_arcsec": F.col("comoving") / (1 + F.col(z)) * (math.pi / 648000 * 1e3)}
    )


def lookback(z: Column, c: Cosmology = PLANCK15) -> Column:
    return trapezoid(_points(z, 512), lambda x: 1 / c.e(x) / (1 + x)) * c.hubble_time


def age_now(c: Cosmology = PLANCK15) -> Column:
    grid = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.pow(F.lit(10.0), i * 3.0 / 511) - 1)
    return trapezoid(grid, lambda x: 1 / c.e(x) / (1 + x)) * c.hubble_time


def age_columns(df: DataFrame, z: str = "redshift", c: Cosmology = PLANCK15) -> DataFrame:
    return df.withColumn("lookback", lookback(F.col(z), c)).withColumn("age_z0", age_now(c)).withColumn("age", F.col("age_z0") - F.col("lookback"))


def redshift(a: Column) -> Column:
    return 1 / a - 1


def stellar_age(df: DataFrame, a: str, c: Cosmology = PLANCK15, points: int = 10_000, out: str = "age") -> DataFrame:
    """Age in Gyr of stars formed at scale factor a: lookback to 1/a - 1, from a table over `points` values of a that is
    summed once and joined by index (broadcast, fixed size), interpolated between neighbours."""
    import numpy as np

    grid = np.linspace(1e-3, 1.0, points)
    x = 1 / grid - 1
    dark = (1 + x) ** (3 * (1 + c.w0 + c.wa)) * np.exp(-3 * c.wa * (1 - grid))
    f = 1 / np.sqrt(c.om0 * (1 + x) ** 3 + (1 - c.om0) * dark) / grid  # dt = da / (a E) in Hubble times
    sums = np.concatenate(([0.0], np.cumsum(np.diff(grid) * (f[1:] + f[:-1]) / 2)))
    ages = (sums[-1] - sums) * c.hubble_time
    table = df.sparkSession.createDataFrame([(i, float(ages[i]), float(ages[min(i + 1, points - 1)])) for i in range(points)], "_i int, _low double, _high double")
    place = (F.col(a) - 1e-3) / ((1.0 - 1e-3) / (points - 1))
    keyed = df.withColumn("_p", F.greatest(F.lit(0.0), F.least(F.lit(points - 1.0), place))).withColumn("_i", F.floor("_p").cast("int"))
    return keyed.join(F.broadcast(table), "_i", "left").withColumn(out, F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_p") - F.col("_i"))).drop("_i", "_p", "_low", "_high")
