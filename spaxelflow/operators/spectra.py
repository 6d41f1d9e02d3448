"""Spectra as array columns: Doppler shift, resampling, template lookup, curves and photometry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C_KM_S = 299792.458
LSOL_TO_ERG, MPC_TO_CM = 3.828e33, 3.08568e24


def redshift_wave(wave: Column, z: Column | float) -> Column:
    return F.transform(wave, lambda v: v * (1 + z))


def doppler_factor(v: Column) -> Column:
    return F.exp(v / C_KM_S)


def luminosity_to_flux(value: Column, d_lum: Column | float, z: Column | float, pixel: float = 1.0) -> Column:
    """erg/s/cm^2/Angstrom from Lsun/Angstrom at d_lum Mpc."""
    return value * (LSOL_TO_ERG / MPC_TO_CM**2 / (4 * math.pi) / pixel) / (d_lum * d_lum) / (1 + z)


def adjacent_diff(df: DataFrame, column: str, by: list[str], order: str, pad: bool = True) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("diff", F.col(column) - F.lag(column).over(w))
    return out.withColumn("diff", F.coalesce("diff", F.lit(0.0))) if pad else out.where("diff is not null")


def cumulative_trapezoid(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("integral", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def interp_array(x: Column, xs: Column, ys: Column, outside: str = "clamp") -> Column:
    """Linear interpolation of one value in array columns xs (ascending), ys."""
    n = F.size(xs)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(xs, lambda v: v <= x))))
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    low, high = (F.get(ys, F.lit(0)), F.get(ys, n - 1)) if outside == "clamp" else (F.lit(0.0), F.lit(0.0))
    return F.when(x < F.get(xs, F.lit(0)), low).when(x > F.get(xs, n - 1), high).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def interp_curve(df: DataFrame, curve: DataFrame, x: str, by: str = "filter_id", outside: str = "clamp") -> DataFrame:
    """Every row of df with every curve's value at column x (curves are few and fixed; each one is packed in an array)."""
    packed = pack_curves(curve, by)
    return df.join(F.broadcast(packed)).withColumn("response", interp_array(F.col(x), F.col("xs"), F.col("ys"), outside)).drop("xs", "ys")


MAX_CURVE_POINTS = 2_000_000  # of all curves that one broadcast holds, about 32 MB; more raise ValueError


def pack_curves(curve: DataFrame, by: str = "filter_id") -> DataFrame:
    if curve.limit(MAX_CURVE_POINTS + 1).count() > MAX_CURVE_POINTS:
        raise ValueError(f"more than {MAX_CURVE_POINTS} curve points: give the curves in parts")
    points = curve.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("wavelength", "transmission"))).alias("p"))
    return points.select(by, F.col("p.wavelength").alias("xs"), F.col("p.transmission").alias("ys"))


def photometry(cube: DataFrame, curves: DataFrame, wave: Column, outside: str = "clamp") -> DataFrame:
    """Trapezoid of flux * response for each spaxel and filter. Responses are taken once a filter, on the cube's own wave
    array, and broadcast; the cube is read once for all filters."""
    responses = pack_curves(curves).withColumn("wave", wave).select("filter_id", "wave", F.transform("wave", lambda x: interp_array(x, F.col("xs"), F.col("ys"), outside)).alias("response"))
    both = cube.join(F.broadcast(responses))
    product = F.zip_with("flux", "response", lambda a, b: a * b)
    n = F.size("wave")
    area = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + (F.get("wave", i) - F.get("wave", i - 1)) * (F.get("p", i) + F.get("p", i - 1)) / 2)
    return both.withColumn("p", product).select("galaxy_id", "spaxel", "filter_id", area.alias("image"))


def resample_kernel(flux: np.ndarray, wave: np.ndarray, factor: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows of flux on wave * factor (one factor a row), interpolated to target with clamped ends, scaled so that the sum
    of flux * step over the target's range is kept; where the new sum is 0 the result is 0."""
    at = target[None, :] / factor[:, None]
    i = np.clip(np.searchsorted(wave, at, side="right") - 1, 0, len(wave) - 2)
    t = np.clip((at - wave[i]) / (wave[i + 1] - wave[i]), 0.0, 1.0)
    low = np.take_along_axis(flux, i, axis=1)
    new = low + (np.take_along_axis(flux, i + 1, axis=1) - low) * t
    shifted = wave[None, :] * factor[:, None]
    inside = (shifted >= target[0]) & (shifted <= target[-1])
    old_sum = (flux * (np.diff(wave, prepend=wave[0])[None, :] * factor[:, None]) * inside).sum(axis=1)
    new_sum = new @ np.diff(target, prepend=target[0])
    scale = np.divide(old_sum, new_sum, out=np.zeros_like(old_sum), where=new_sum != 0)
    return new * scale[:, None]


def _flux_batch(batch, keep, flux):
    width = flux.shape[1]
    column = pa.ListArray.from_arrays(pa.array(np.arange(len(flux) + 1, dtype=np.int32) * width), pa.array(flux.reshape(-1)))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, "flux"])


def resample(df: DataFrame, wave: np.ndarray, target: np.ndarray, keep: list[str], factor: str | None = None) -> DataFrame:
    """flux on wave * factor (a column, 1 without) -> flux on target."""
    source = df.sparkSession.sparkContext.broadcast((np.asarray(wave, float), np.asarray(target, float)))

    def run(batches):
        w, t = source.value
        for batch in batches:
            if batch.num_rows:
                flux = batch.column("flux").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                shift = batch.column(factor).to_numpy(zero_copy_only=False) if factor else np.ones(batch.num_rows)
                yield _flux_batch(batch, keep, resample_kernel(flux, w, shift, t))

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *([factor] if factor and factor not in keep else []), "flux").mapInArrow(run, f"{schema}, flux array<double>")


def cubic_weights(axis: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, 4 weights, inside) of cubic Hermite interpolation with slopes from neighbours on a non-uniform axis."""
    n = len(axis)
    i = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, n - 2)
    h = axis[i + 1] - axis[i]
    t = (x - axis[i]) / h
    h00, h10, h01, h11 = 2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t, -2 * t**3 + 3 * t**2, t**3 - t**2
    w = np.zeros((len(x), 4))  # of nodes i-1, i, i+1, i+2
    w[:, 1], w[:, 2] = h00, h01
    low, high = i == 0, i == n - 2
    before = np.where(low, h, axis[np.maximum(i, 1)] - axis[np.maximum(i, 1) - 1])
    after = np.where(high, h, axis[np.minimum(i + 2, n - 1)] - axis[i + 1])
    after = np.where(after == 0, h, after)
    # slope at i: (y[i+1] - y[i-1]) / (h + before), one-sided at the end; at i+1 likewise
    s = h * h10 / np.where(low, h, h + before)
    w[:, 2] += s
    w[:, 1] -= np.where(low, s, 0)
    w[:, 0] -= np.where(low, 0, s)
    s = h * h11 / np.where(high, h, h + after)
    w[:, 3] += np.where(high, 0, s)
    w[:, 2] += np.where(high, s, 0)
    w[:, 1] -= s
    return i - 1, w, (x >= axis[0]) & (x <= axis[-1])


def linear_weights(axis, x):
    i = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, len(axis) - 2)
    t = (x - axis[i]) / (axis[i + 1] - axis[i])
    return i - 1, np.column_stack([0 * t, 1 - t, t, 0 * t]), (x >= axis[0]) & (x <= axis[-1])


def nearest_weights(axis, x):
    i, w, inside = linear_weights(axis, x)
    w[:, 2] = w[:, 2] > 0.5
    w[:, 1] = 1 - w[:, 2]
    return i, w, inside


WEIGHTS = {"cubic": cubic_weights, "linear": linear_weights, "nearest": nearest_weights}


def template_flux(grid, metallicity: np.ndarray, age: np.ndarray, method: str = "cubic") -> np.ndarray:
    """Spectra at (metallicity, age) from grid = (mets, ages, flux[met, age, wave]); zeros outside the grid and where one of the two
    is NaN (null)."""
    mets, ages, flux = grid
    mi, mw, m_in = WEIGHTS[method](mets, metallicity)
    ai, aw, a_in = WEIGHTS[method](ages, age)
    out = np.zeros((len(age), flux.shape[2]))
    for p in range(4):
        for q in range(4):
            w = np.where(m_in & a_in, mw[:, p] * aw[:, q], 0.0)
            if w.any():
                out += w[:, None] * flux[np.clip(mi + p, 0, len(mets) - 1), np.clip(ai + q, 0, len(ages) - 1)]
    return out


MAX_GRID_BYTES = 64 << 20  # of a template grid that is broadcast; a larger one is looked up cell by cell
STARS_A_CELL = 100_000  # of one task's share of a cell


def grid_arrays(grid: DataFrame, limit: int = MAX_GRID_BYTES):
    """The template grid (met_idx, age_idx, metallicity, age, flux) as arrays on the driver, ready to be broadcast. A grid of more
    than `limit` bytes is a ValueError: lookups take it as a DataFrame."""
    nodes, width = grid.agg(F.count("*"), F.max(F.size("flux"))).first()
    if nodes * (width or 0) * 8 > limit:
        raise ValueError(f"template grid of {nodes * width * 8} bytes, more than {limit}: give the DataFrame to the lookup")
    rows = grid.orderBy("met_idx", "age_idx").select("metallicity", "age", "flux").collect()
    mets, ages = np.unique([r[0] for r in rows]), np.unique([r[1] for r in rows])
    return mets, ages, np.array([r[2] for r in rows]).reshape(len(mets), len(ages), -1)


def _by_cell(stars: DataFrame, grid: DataFrame, stars_a_cell: int):
    """(rows, axes): stars in the order of the grid's cells, each cell's up to 16 nodes in front of its stars.

    Cells with many stars are dealt to several tasks, with their nodes. Only the axes come to the driver, and one count for
    each cell that has stars.
    """
    axes = [np.array([r[0] for r in grid.select(c).distinct().orderBy(c).collect()], float) for c in ("metallicity", "age")]
    names = [f.name for f in stars.schema]

    def cell(c: str, axis: np.ndarray) -> Column:
        found = F.size(F.filter(F.array(*[F.lit(float(v)) for v in axis]), lambda v: v <= F.col(c).cast("double"))) - 1
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(len(axis) - 2), found)), F.lit(0))

    placed = stars.withColumns({"_i": cell("metallicity", axes[0]), "_j": cell("age", axes[1])})
    counts = placed.groupBy("_i", "_j").agg(F.ceil(F.count("*") / stars_a_cell).cast("int").alias("_shares"))  # a row for each cell
    shares = F.broadcast(stars.sparkSession.createDataFrame(counts.collect(), counts.schema))
    dealt = placed.join(shares, ["_i", "_j"]).withColumn("_share", F.pmod(F.monotonically_increasing_id(), F.col("_shares")).cast("int"))
    around = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - 2), F.least(F.lit(n - 2), F.col(c) + 1)))
    nodes = grid.select("met_idx", "age_idx", F.col("metallicity").cast("double").alias("_met"), F.col("age").cast("double").alias("_age"), F.col("flux").cast("array<double>").alias("_flux"))
    nodes = nodes.withColumn("_i", around("met_idx", len(axes[0]))).withColumn("_j", around("age_idx", len(axes[1]))).join(shares, ["_i", "_j"]).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    keys = ["_i", "_j", "_share"]
    both = dealt.select(*names, *keys, F.lit(1).alias("_t")).unionByName(nodes.select(*keys, F.lit(0).alias("_t"), "met_idx", "age_idx", "_met", "_age", "_flux"), allowMissingColumns=True)
    return both.repartition(int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "_t", "met_idx", "age_idx")


def _with_cells(batches, step: int):
    """(grid of the cell, stars) in parts of `step` stars at most, of rows as _by_cell() orders them."""
    key, nodes, grid = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_j", "_share", "_t")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part, own = batch.slice(a, b - a), tuple(keys[:3, a].tolist())
            if own != key:
                key, nodes, grid = own, [], None
            if keys[3, a] == 0:
                nodes.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("_met", "_age")] + [part.column("_flux").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)])
                continue
            if grid is None:
                met, age, flux = (np.concatenate(x) for x in zip(*nodes))
                mets, ages = np.unique(met), np.unique(age)
                grid = mets, ages, flux.reshape(len(mets), len(ages), -1)
            for k in range(0, b - a, step):
                yield grid, part.slice(k, step)


def _step(width: int) -> int:
    """Stars whose spectra are worked on at once: about 2 MB of them."""
    return max(32, (1 << 18) // max(width, 1))


def _with_grid(stars: DataFrame, grid, limit: int, stars_a_cell: int, width: int = 0):
    """(rows, parts): `parts(batches)` gives (grid, stars) pairs of the rows. An array grid, or a DataFrame up to `limit` bytes, is
    broadcast; a larger one meets its stars cell by cell."""
    if isinstance(grid, DataFrame):
        nodes, length = grid.agg(F.count("*"), F.max(F.size("flux"))).first()
        if nodes * (length or 0) * 8 > limit:
            step = _step(max(width, length))
            return _by_cell(stars, grid, stars_a_cell), lambda batches: _with_cells(batches, step)
        grid = grid_arrays(grid, limit)
    step = _step(max(width, grid[2].shape[2]))
    shared = stars.sparkSession.sparkContext.broadcast(grid)

    def parts(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                yield shared.value, batch.slice(k, step)

    return stars, parts


def lookup_template(stars: DataFrame, grid, keep: list[str], method: str = "cubic", limit: int = MAX_GRID_BYTES, stars_a_cell: int = STARS_A_CELL) -> DataFrame:
    """Adds each star's template spectrum. grid: what grid_arrays() gives, or the grid's DataFrame, which is broadcast up to
    `limit` bytes; beyond, stars are brought to the grid's cells."""
    rows, parts = _with_grid(stars.select(*dict.fromkeys([*keep, "metallicity", "age"])), grid, limit, stars_a_cell)

    def run(batches):
        for g, part in parts(batches):
            m, a = (part.column(c).to_numpy(zero_copy_only=False) for c in ("metallicity", "age"))
            yield _flux_batch(part, keep, template_flux(g, m, a, method))

    schema = ", ".join(f"{c} {stars.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, flux array<double>")


def star_cube(stars: DataFrame, grid, wave: np.ndarray, target: np.ndarray, z: float | Column = 0.0, method: str = "cubic", axis: str = "z", curve=None, limit: int = MAX_GRID_BYTES, stars_a_cell: int = STARS_A_CELL) -> DataFrame:
    """Template lookup, times mass, Doppler shift and resampling in one pass, with the task's partial sums by (galaxy,
    spaxel), so that no spectrum of a star crosses a shuffle. z: one redshift, or a column. curve: A(wave) / A_V on
    `target`; spectra are then attenuated by each star's column av in the same pass. grid, limit: as in lookup_template()."""
    from .cube import CUBE_SCHEMA, _partial_sums

    shared = stars.sparkSession.sparkContext.broadcast((np.asarray(wave, float), np.asarray(target, float), None if curve is None else np.asarray(curve, float)))
    columns = ["galaxy_id", "spaxel"]
    shift = doppler_factor(F.col(f"v{axis}")) * (1 + (z if isinstance(z, Column) else F.lit(float(z))))
    needed = stars.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.col("spaxel").cast("int").alias("spaxel"), "metallicity", "age", "mass", shift.alias("_shift"), *(["av"] if curve is not None else []))
    rows, parts = _with_grid(needed, grid, limit, stars_a_cell, len(target))

    def spectra(batches):
        w, t, k_v = shared.value
        for g, part in parts(batches):
            m, a, mass, shift = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("metallicity", "age", "mass", "_shift"))
            flux = resample_kernel(template_flux(g, m, a, method) * mass[:, None], w, shift, t)
            if k_v is not None:
                flux *= 10 ** (-0.4 * part.column("av").to_numpy(zero_copy_only=False)[:, None] * k_v)
            yield _flux_batch(part, columns, flux)

    return rows.mapInArrow(lambda batches: _partial_sums(spectra(batches)), CUBE_SCHEMA)
