"""Row and group operators on particle tables (galaxy_id, x, y, z, vx, vy, vz, mass, ...)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.galaxies import beside_particles
from ..sources.ingest import uniform
from .scan import running_sum

MASKED = ("mass", "metallicity", "age", "density", "sfr", "internal_energy", "electron_abundance", "temperature")


def radius() -> Column:
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def drop_wind(df: DataFrame, formation: str = "sft") -> DataFrame:
    """Stars only: a negative formation factor marks a wind-phase cell."""
    return df.where(F.col(formation) >= 0)


def fov_mask(df: DataFrame, half_size: float | Column) -> DataFrame:
    return df.withColumn("mask", F.col("x").between(-half_size, half_size) & F.col("y").between(-half_size, half_size))


def apply_mask(df: DataFrame, how: str = "drop") -> DataFrame:
    """how='drop' filters; how='zero' keeps rows and zeroes mass, age and the like (coordinates and metals stay)."""
    if how == "drop":
        return df.where("mask")
    return df.withColumns({c: F.when(F.col("mask"), F.col(c)).otherwise(0.0) for c in MASKED if c in df.columns})


def spaxel_of(x: Column, half_size: float | Column, n: int) -> Column:
    return F.least(F.greatest(F.floor((x + half_size) / (2 * half_size / n)), F.lit(0)), F.lit(n - 1)).cast("int")


def assign_spaxel(df: DataFrame, half_size: float | Column, n: int) -> DataFrame:
    """Square bins, left-closed, ends clipped; id = x + n * y. half_size: one for all, or a column."""
    return df.withColumn("spaxel", spaxel_of(F.col("x"), half_size, n) + n * spaxel_of(F.col("y"), half_size, n))


def count_map(df: DataFrame) -> DataFrame:
    return df.groupBy("galaxy_id", "spaxel").agg(F.count("*").alias("n"))


def subset(df: DataFrame, k: int, seed: int = 42, key: tuple[str, ...] = ("particle_id",)) -> DataFrame:
    """A reproducible k rows of each galaxy. Rows are first cut by their hash to a little over k (a count per galaxy tells
    the share), so the ranked part stays small."""
    share = F.least(F.lit(1.0), (k + 6 * math.sqrt(k) + 20) / F.col("rows"))
    counted = df.join(beside_particles(df.groupBy("galaxy_id").agg(F.count("*").alias("rows"))), "galaxy_id").withColumn("_h", F.md5(F.concat_ws(",", F.lit(seed), *key)))
    near = counted.where(uniform(seed, *key) <= share)  # the first digits of the same hash
    w = Window.partitionBy("galaxy_id").orderBy("_h", *key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "_h", "rows")


def los_velocity(df: DataFrame, axis: str) -> DataFrame:
    if axis not in ("x", "y", "z"):
        raise ValueError(f"axis {axis} is none of x, y, z")
    return df.withColumn("v_los", F.col(f"v{axis}"))


def with_galaxy(df: DataFrame, galaxy: DataFrame) -> DataFrame:
    """Adds each galaxy's columns."""
    return df.join(beside_particles(galaxy), "galaxy_id")


def check_center(df: DataFrame, galaxy: DataFrame) -> DataFrame:
    """Per galaxy: is the center inside the particles' bounds on each axis?"""
    bounds = df.groupBy("galaxy_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    inside = [F.element_at("center", k + 1).between(F.col(f"{c}_min"), F.col(f"{c}_max")) for k, c in enumerate("xyz")]
    return bounds.join(galaxy.select("galaxy_id", "center"), "galaxy_id").withColumn("inside", inside[0] & inside[1] & inside[2])


def velocity_bin(v: Column) -> Column:
    """Narrow bins near zero, in proportion beyond; null for a null or NaN."""
    return F.when(v.isNotNull() & ~F.isnan(v), F.floor(F.asinh(v) * 64))


def central_velocity(df: DataFrame, r: float = 10.0, exact: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """Per-axis median velocity of the particles nearer than r to the center (columns x, y, z relative to it), without nulls
    and NaN.

    Exact, in two levels: counts of velocity bins tell which bins hold the middle ranks; only their particles are ranked, by
    different values. counts: (galaxy_id, axis, bin, n), where a summary has them already.
    """
    near = df.where(radius() < r)
    axes = ("vx", "vy", "vz")
    if not exact:
        return near.groupBy("galaxy_id").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in axes])
    group = ["galaxy_id", "axis"]
    long = near.select("galaxy_id", F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in axes])).alias("p")).select("galaxy_id", "p.*")
    rows = long.withColumn("bin", velocity_bin(F.col("v"))).where("bin is not null")
    run, whole = Window.partitionBy(*group).orderBy("bin"), Window.partitionBy(*group)
    if counts is None:
        counts = rows.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"before": F.sum("n").over(run) - F.col("n"), "total": F.sum("n").over(whole)})
    ranks = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
    holds = lambda before, n: [(before <= k) & (k < before + n) for k in ranks]
    low, high = holds(F.col("before"), F.col("n"))
    middle = counts.where(low | high).drop("n")
    values = rows.join(beside_particles(middle), [*group, "bin"]).groupBy(*group, "bin", "before", "total", "v").agg(F.count("*").alias("n"))
    inner = Window.partitionBy(*group, "bin").orderBy("v")
    low, high = holds(F.col("before") + F.sum("n").over(inner) - F.col("n"), F.col("n"))
    halves = values.withColumn("share", F.col("v") * (low.cast("double") + high.cast("double")) / 2)
    return halves.groupBy("galaxy_id").agg(*[F.sum(F.when(F.col("axis") == c, F.col("share"))).alias(c) for c in axes])


TENSOR = ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")


@dataclass(frozen=True)
class Summary:
    """What one pass over the particles says about each galaxy, about its center: (galaxy_id, axis, bin, n, lo, hi, lost, tensor
    sums), one row for each velocity bin of each axis (bin null: particles beyond the central radius, or without a velocity)."""

    bins: DataFrame

    def bounds(self) -> DataFrame:
        """(galaxy_id, x_min, x_max, ...), relative to the center."""
        pick = lambda f, c, k: f(F.when(F.col("axis") == f"v{k}", F.col(c)))
        return self.bins.groupBy("galaxy_id").agg(*[pick(f, c, k).alias(f"{k}_{n}") for k in "xyz" for n, f, c in (("min", F.min, "lo"), ("max", F.max, "hi"))])

    def velocity_counts(self) -> DataFrame:
        return self.bins.where("bin is not null").select("galaxy_id", "axis", "bin", "n")

    def lost(self) -> DataFrame:
        """Galaxies with particles that have no place or no mass, and the number of those (null or NaN) particles."""
        return self.bins.groupBy("galaxy_id").agg(F.sum("lost").alias("lost")).where("lost > 0")

    def tensor(self) -> DataFrame:
        return self.bins.groupBy("galaxy_id").agg(*[F.sum(c).alias(c) for c in TENSOR])


def summarise(df: DataFrame, galaxy: DataFrame, r: float = 10.0) -> Summary:
    """Bounds, counts of velocity bins within r of the center and second moments within the half-mass radius, of all galaxies in
    one pass; what it keeps is a few hundred rows a galaxy."""
    near = with_galaxy(df, galaxy.select("galaxy_id", "center", "halfmassrad_stars")).withColumns({c: F.col(c) - F.element_at("center", k + 1) for k, c in enumerate("xyz")})
    inner = F.col("_r") <= F.col("halfmassrad_stars")
    axes = [F.struct(F.lit(f"v{c}").alias("axis"), F.col(c).cast("double").alias("at"), F.when(F.col("_r") < r, velocity_bin(F.col(f"v{c}").cast("double"))).alias("bin")) for c in "xyz"]
    long = near.withColumn("_r", radius()).select("galaxy_id", "x", "y", "z", "mass", inner.alias("_inner"), F.explode(F.array(*axes)).alias("p")).select("*", "p.*")
    once = F.when(F.col("_inner") & (F.col("axis") == "vx"), F.col("mass"))  # a particle's moments count on one of its rows
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    sums = [F.sum(once * (r2 - F.col(c) * F.col(c))).alias(f"i{c}{c}") for c in "xyz"] + [(-F.sum(once * F.col(a) * F.col(b))).alias(f"i{a}{b}") for a, b in ("xy", "xz", "yz")]
    known = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in ("x", "y", "z", "mass")])
    lost = F.sum(F.when((F.col("axis") == "vx") & ~known, 1).otherwise(0)).alias("lost")
    return Summary(long.groupBy("galaxy_id", "axis", "bin").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), lost, *sums).persist())


def check_inside(summary: Summary) -> None:
    """Raises where particles lack a place or a mass, or where a center lies outside the particles' bounds on an axis."""
    lost = summary.lost().select("galaxy_id").limit(5).collect()
    if lost:
        raise ValueError(f"particles without place or mass in galaxies {[r[0] for r in lost]}")
    inside = [(F.col(f"{c}_min") <= 0) & (F.col(f"{c}_max") >= 0) for c in "xyz"]
    outside = summary.bounds().where(~(inside[0] & inside[1] & inside[2])).select("galaxy_id").limit(5).collect()
    if outside:
        raise ValueError(f"center outside the particles' bounds: {outside}")


def center(df: DataFrame, galaxy: DataFrame, r: float = 10.0) -> DataFrame:
    """Coordinates relative to the center, velocities relative to the central velocity; raises where a center is outside, or
    where that can't be told (no center, no coordinates)."""
    galaxy = beside_particles(galaxy)
    outside = check_center(df, galaxy).where(~F.coalesce("inside", F.lit(False))).select("galaxy_id").limit(5).collect()
    if outside:
        raise ValueError(f"center outside the particles' bounds: {outside}")
    return recenter(df, galaxy, r)


def recenter(df: DataFrame, galaxy: DataFrame, r: float = 10.0, counts: DataFrame | None = None) -> DataFrame:
    moved = with_galaxy(df, galaxy.select("galaxy_id", "center")).withColumns({c: F.col(c) - F.element_at("center", k + 1) for k, c in enumerate("xyz")}).drop("center")
    v = central_velocity(moved, r, counts=counts).select("galaxy_id", *[F.col(c).alias(f"_{c}") for c in ("vx", "vy", "vz")])
    return moved.join(beside_particles(v), "galaxy_id", "left").withColumns({c: F.col(c) - F.coalesce(f"_{c}", F.lit(0.0)) for c in ("vx", "vy", "vz")}).drop("_vx", "_vy", "_vz")


def inertia_tensor(df: DataFrame, galaxy: DataFrame) -> DataFrame:
    """Six second moments per galaxy within the half-mass radius (bound included)."""
    near = with_galaxy(df, galaxy.select("galaxy_id", "halfmassrad_stars")).where(radius() <= F.col("halfmassrad_stars"))
    return tensor_sums(near)


def tensor_sums(near: DataFrame) -> DataFrame:
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    diagonal = [F.sum(F.col("mass") * (r2 - F.col(c) * F.col(c))).alias(f"i{c}{c}") for c in "xyz"]
    return near.groupBy("galaxy_id").agg(*diagonal, *[(-F.sum(F.col("mass") * F.col(a) * F.col(b))).alias(f"i{a}{b}") for a, b in ("xy", "xz", "yz")])


def half_mass_radius(df: DataFrame, shells: int = 32) -> DataFrame:
    """The least radius whose enclosed mass reaches half of the total, per galaxy.

    Two levels: masses of radial shells, `shells` to each doubling of the radius, find the shell that holds the half; only
    its particles are ranked. A far particle changes no other one's shell.
    """
    shelled = df.withColumn("r", radius()).withColumn("shell", F.floor(F.log2(F.greatest(F.col("r"), F.lit(1e-12))) * shells))
    run = Window.partitionBy("galaxy_id").orderBy("shell")
    total = Window.partitionBy("galaxy_id")
    masses = shelled.groupBy("galaxy_id", "shell").agg(F.sum("mass").alias("m")).withColumn("cum", F.sum("m").over(run)).withColumn("half", F.sum("m").over(total) / 2)
    target = masses.where("cum >= half").groupBy("galaxy_id").agg(F.min(F.struct("shell", (F.col("half") - (F.col("cum") - F.col("m"))).alias("rest"))).alias("t")).select("galaxy_id", "t.*")
    inside = shelled.join(beside_particles(target), ["galaxy_id", "shell"])
    w = Window.partitionBy("galaxy_id").orderBy("r").rangeBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("cum", F.sum("mass").over(w)).where(F.col("cum") >= F.col("rest") * (1 - 1e-12))
    return reached.groupBy("galaxy_id").agg(F.min("r").alias("halfmassrad"))


def running_mass(df: DataFrame, ties: tuple[str, ...] = (), rows_a_piece: int | None = None) -> DataFrame:
    """Adds r and the mass inside each particle's radius, itself included; `ties` order particles at one radius."""
    return running_sum(df.withColumn("r", radius()), ("galaxy_id",), ("r", *ties), "mass", "running_mass", rows_a_piece)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins per galaxy, the last edge closed."""
    limits = df.groupBy("galaxy_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return df.join(beside_particles(limits), "galaxy_id").groupBy("galaxy_id", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def union_types(stars: DataFrame, gas: DataFrame) -> DataFrame:
    return stars.withColumn("ptype", F.lit("stars")).unionByName(gas.withColumn("ptype", F.lit("gas")), allowMissingColumns=True)


def sort_columns(df: DataFrame) -> DataFrame:
    """Spaxels together and by z inside each partition."""
    return df.repartition("galaxy_id", "spaxel").sortWithinPartitions("galaxy_id", "spaxel", "z")
