"""Cubes: one row per (galaxy_id, spaxel) with flux array<double>; axis order y, x (spaxel = x + n * y)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import uniform


CUBE_SCHEMA = "galaxy_id long, spaxel int, flux array<double>"


def array_total(flux: Column | str) -> Column:
    return F.aggregate(flux, F.lit(0.0), lambda s, v: s + v)


def _partial_sums(batches):
    """The task's own sum of each (galaxy, spaxel); spectra never cross a shuffle one by one."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        galaxy, spaxel = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("galaxy_id", "spaxel"))
        flux = batch.column("flux").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        order = np.lexsort((spaxel, galaxy))
        g, s = galaxy[order], spaxel[order]
        cut = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]))))
        for k, total in zip(cut, np.add.reduceat(flux[order], cut, axis=0)):
            key = (int(g[k]), int(s[k]))
            sums[key] = sums[key] + total if key in sums else total
        if len(sums) > 20_000:
            yield _rows(sums)
            sums = {}
    if sums:
        yield _rows(sums)


def _rows(sums):
    keys = list(sums)
    flat = np.concatenate([sums[k] for k in keys])
    width = len(flat) // len(keys)
    flux = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), flux], ["galaxy_id", "spaxel", "flux"])


def _ordered_sums(batches):
    """Sums of neighbouring rows of one (galaxy, spaxel); one running total is held."""
    key, total = None, None
    for batch in batches:
        for part in _partial_sums([batch]):
            galaxy, spaxel = part.column("galaxy_id").to_pylist(), part.column("spaxel").to_pylist()
            flux = part.column("flux").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            done = {}
            for g, s, row in zip(galaxy, spaxel, flux):
                if (g, s) == key:
                    total = total + row
                    continue
                if key is not None:
                    done[key] = total
                key, total = (g, s), row
            if done:
                yield _rows(done)
    if key is not None:
        yield _rows({key: total})


def add_cubes(cubes: DataFrame) -> DataFrame:
    """Sum of the arrays of each (galaxy, spaxel). Rows of a spaxel meet in one task, sorted, and are added one after another,
    so that arrays are never taken apart and no group is held."""
    met = cubes.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.col("spaxel").cast("int").alias("spaxel"), F.col("flux").cast("array<double>").alias("flux")).where("flux is not null")
    return met.repartition("galaxy_id", "spaxel").sortWithinPartitions("galaxy_id", "spaxel").mapInArrow(_ordered_sums, CUBE_SCHEMA)


def to_long(cube: DataFrame) -> DataFrame:
    return cube.select("galaxy_id", "spaxel", F.posexplode("flux").alias("k", "v"))


def accumulate_cube(df: DataFrame, n: int | None = None) -> DataFrame:
    """Spectra (galaxy_id, spaxel, flux) summed by spaxel; with n, spaxels without spectra are zeros."""
    partial = df.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.col("spaxel").cast("int").alias("spaxel"), F.col("flux").cast("array<double>").alias("flux")).where("flux is not null")
    cube = add_cubes(partial.mapInArrow(_partial_sums, CUBE_SCHEMA))
    return cube if n is None else zero_fill(cube, n)


def zero_fill(cube: DataFrame, n: int, width: int | None = None, galaxies: DataFrame | None = None) -> DataFrame:
    """All n * n spaxels of each galaxy, zeros where the cube has none. With the galaxies and the length of a spectrum, the cube
    is not read to learn them."""
    if width is None or galaxies is None:
        galaxies = cube.groupBy("galaxy_id").agg(F.max(F.size("flux")).alias("w"))
    else:
        galaxies = galaxies.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.lit(width).alias("w"))
    spaxels = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("spaxel")
    filled = galaxies.select("galaxy_id", "w", spaxels).join(cube, ["galaxy_id", "spaxel"], "left")
    return filled.select("galaxy_id", "spaxel", F.coalesce("flux", F.array_repeat(F.lit(0.0), F.col("w"))).alias("flux"))


def with_xy(cube: DataFrame, n: int) -> DataFrame:
    return cube.withColumn("y", F.floor(F.col("spaxel") / n).cast("int")).withColumn("x", (F.col("spaxel") % n).cast("int"))


def image(cube: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    flux = F.col("flux") if lo is None else F.slice("flux", lo + 1, hi - lo)
    return cube.select("galaxy_id", "spaxel", array_total(flux).alias("image"))


def total_spectrum(cube: DataFrame) -> DataFrame:
    return accumulate_cube(cube.withColumn("spaxel", F.lit(0))).drop("spaxel")


def within_radius(cube: DataFrame, n: int, x: int, y: int, r: float) -> DataFrame:
    dx, dy = F.col("x") - x, F.col("y") - y
    return with_xy(cube, n).where(F.sqrt(dx * dx + dy * dy) <= r)


def aperture_spectrum(cube: DataFrame, n: int, x: int, y: int, r: float) -> DataFrame:
    return total_spectrum(within_radius(cube, n, x, y, r))


def spectrum_at(cube: DataFrame, n: int, x: int, y: int) -> DataFrame:
    return cube.where(F.col("spaxel") == x + n * y)


def slice_wave(cube: DataFrame, lo: int, hi: int) -> DataFrame:
    return cube.withColumn("flux", F.slice("flux", lo + 1, hi - lo))


def scale_by_mass(df: DataFrame) -> DataFrame:
    return df.withColumn("flux", F.transform("flux", lambda v: v * F.col("mass")))


def gaussian_kernel(m: int, n: int, sigma: float) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of a normalised m x n Gaussian."""
    cells = [(i - (m - 1) / 2, j - (n - 1) / 2) for i in range(m) for j in range(n)]
    weights = [math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for a, b in cells]
    total = sum(weights)
    return [(int(math.ceil(a)), int(math.ceil(b)), w / total) for (a, b), w in zip(cells, weights)]


TILE = 24  # spaxels along the side of a tile


def _reach(kernel) -> tuple[int, int, int, int]:
    ys, xs = [k[0] for k in kernel], [k[1] for k in kernel]
    return min(ys), max(ys), min(xs), max(xs)


def _tile_sum(own: np.ndarray, at: np.ndarray, corner: tuple[int, int], shape: tuple[int, int], steps):
    """(places, spectra) of a tile's spaxels that any of `own` (spectra at rows and columns `at`) reaches, after the stencils
    of `steps` one after another."""
    reaches = [_reach(k) for k in steps]
    low_y, high_y, low_x, high_x = (sum(r[i] for r in reaches) for i in range(4))
    first = np.array([corner[0] - high_y, corner[1] - high_x])
    size = (shape[0] + high_y - low_y, shape[1] + high_x - low_x)
    grid, there = np.zeros((*size, own.shape[1])), np.zeros(size, bool)
    i, j = (at - first).T
    np.add.at(grid, (i, j), own)
    there[i, j] = True
    for kernel, (ly, hy, lx, hx) in zip(steps, reaches):
        h, w = grid.shape[0] - (hy - ly), grid.shape[1] - (hx - lx)
        total, reached = np.zeros((h, w, own.shape[1])), np.zeros((h, w), bool)
        for dy, dx, weight in kernel:
            part = slice(hy - dy, hy - dy + h), slice(hx - dx, hx - dx + w)
            total += weight * grid[part]
            reached |= there[part]
        grid, there = total, reached
    y, x = np.nonzero(there)
    return np.stack([y, x], axis=1) + np.array(corner), grid[y, x]


def _stencils(cube: DataFrame, steps, n: int, tile: int) -> DataFrame:
    """Tiles of tile x tile spaxels meet in a task each, with the spaxels around them that reach into them; only those border
    spaxels are copied."""
    reaches = [_reach(k) for k in steps]
    low_y, high_y, low_x, high_x = (sum(r[i] for r in reaches) for i in range(4))

    def tiles(c: str, low: int, high: int) -> Column:
        place = lambda d: F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + d)) / tile).cast("int")
        return F.explode(F.sequence(place(low), place(high)))

    def run(batches):
        key, own, at = None, [], []

        def done():
            corner = (key[1] * tile, key[2] * tile)
            shape = (min(tile, n - corner[0]), min(tile, n - corner[1]))
            places, flux = _tile_sum(np.array(own), np.array(at), corner, shape, steps)
            if len(places):
                width = flux.shape[1]
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(flux) + 1, dtype=np.int32) * width), pa.array(flux.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(flux), pa.int64()), pa.array(places[:, 1] + n * places[:, 0], pa.int32()), column], ["galaxy_id", "spaxel", "flux"])

        for batch in batches:
            values = batch.column("flux").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(batch.column("flux").offsets.to_numpy()))
            names = zip(*(batch.column(c).to_pylist() for c in ("galaxy_id", "ty", "tx", "y", "x")))
            for (g, ty, tx, y, x), start, end in zip(names, np.concatenate(([0], ends[:-1])), ends):
                if (g, ty, tx) != key:
                    if key is not None:
                        yield from done()
                    key, own, at = (g, ty, tx), [], []
                own.append(values[start:end])
                at.append((y, x))
        if key is not None:
            yield from done()

    rows = with_xy(cube.where("flux is not null"), n).select(F.col("galaxy_id").cast("long").alias("galaxy_id"), "y", "x", "flux")
    dealt = rows.withColumn("ty", tiles("y", low_y, high_y)).withColumn("tx", tiles("x", low_x, high_x))
    met = dealt.repartition("galaxy_id", "ty", "tx").sortWithinPartitions("galaxy_id", "ty", "tx")
    return met.select("galaxy_id", "ty", "tx", "y", "x", F.col("flux").cast("array<double>").alias("flux")).mapInArrow(run, CUBE_SCHEMA)


def stencil_sum(cube: DataFrame, kernel: list[tuple[int, int, float]], n: int, tile: int = TILE) -> DataFrame:
    """Each spaxel gives weight * spectrum to its neighbours (dy, dx, weight); what falls outside is lost (zero padding)."""
    return _stencils(cube, [kernel], n, tile)


def convolve_psf(cube: DataFrame, n: int, size: int, sigma: float, tile: int = TILE) -> DataFrame:
    """The Gaussian of gaussian_kernel(size, size, sigma), along y and then along x."""
    if not (size and size > 0 and sigma and sigma > 0):
        raise ValueError("a PSF needs a size and a sigma above 0")
    line = gaussian_kernel(size, 1, sigma)
    return _stencils(cube, [line, [(dx, dy, w) for dy, dx, w in line]], n, tile)


def lsf_taps(sigma: float, wave_res: float, extent: int = 12) -> list[float]:
    w = [math.exp(-((k * wave_res) ** 2) / (2 * sigma * sigma)) for k in range(-extent, extent + 1)]
    return [v / sum(w) for v in w]


def convolve_lsf(cube: DataFrame, sigma: float, wave_res: float, extent: int = 12) -> DataFrame:
    """Gaussian smoothing along wavelength, zero padding, same length."""
    if not (sigma and sigma > 0):
        raise ValueError("an LSF needs a sigma above 0")
    taps = np.array(lsf_taps(sigma, wave_res, extent))

    def smooth(batches):
        for batch in batches:
            column = batch.column("flux")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            out = [np.convolve(np.pad(flat[e - s : e], extent), taps, "valid") for s, e in zip(sizes, ends)]
            flux = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column("galaxy_id"), batch.column("spaxel"), flux], ["galaxy_id", "spaxel", "flux"])

    return cube.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.col("spaxel").cast("int").alias("spaxel"), "flux").mapInArrow(smooth, "galaxy_id long, spaxel int, flux array<double>")


def _with_amplitude(images: DataFrame, sn: float) -> DataFrame:
    """Adds snr to images (galaxy_id, image, ...): sqrt(median of the galaxy's non-zero images) / sn / sqrt(image), 0 where the
    image is 0. The median is taken over images alone; rows with spectra never meet by galaxy."""
    medians = images.where("image > 0").groupBy("galaxy_id").agg(F.median("image").alias("_median"))
    snr = F.when(F.col("image") > 0, F.sqrt(F.coalesce("_median", F.lit(0.0))) / sn / F.sqrt("image")).otherwise(0.0)
    return images.join(medians, "galaxy_id", "left").withColumn("snr", snr).drop("_median")


def snr_map(cube: DataFrame, sn: float) -> DataFrame:
    return _with_amplitude(image(cube), sn).select("galaxy_id", "spaxel", "snr")


def add_noise(cube: DataFrame, sn: float, distribution: str = "normal", seed: int = 0) -> DataFrame:
    """flux + flux * draw * amplitude; draws depend on (galaxy, spaxel, bin, seed) alone, whatever the partitioning. The cube
    is read for its images' medians, which join it as one number a galaxy, and again for the noise."""
    if distribution not in ("normal", "uniform"):
        raise ValueError(f"distribution {distribution} is neither normal nor uniform")
    if sn is None or sn <= 0:
        raise ValueError("the signal to noise must be above 0")

    def draw(k):
        u = uniform(F.col("galaxy_id"), F.col("spaxel"), k, seed)
        if distribution == "uniform":
            return u
        v = uniform(F.col("galaxy_id"), F.col("spaxel"), k, seed, 1)
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)

    both = _with_amplitude(cube.withColumn("image", array_total("flux")), sn)
    return both.select("galaxy_id", "spaxel", F.transform("flux", lambda v, k: v + v * draw(k) * F.col("snr")).alias("flux"))


def minmax_normalise(images: DataFrame, by: tuple[str, ...] = ("galaxy_id",), column: str = "image") -> DataFrame:
    limits = images.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return images.join(limits, list(by)).withColumn("scaled", scaled).drop("lo", "hi")
