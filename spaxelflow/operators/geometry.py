"""Rotations, apertures and the spatial grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cosmology import PLANCK15, Cosmology, distance_columns
from ..sources.galaxies import beside_particles
from .particles import inertia_tensor

VIEWS = {"face-on": (0.0, 0.0, 0.0), "edge-on": (90.0, 0.0, 0.0)}

# Fov and spatial resolution in arcsec, wavelength range, step and LSF width (FWHM) in Angstrom, aperture.
INSTRUMENTS = {
    "MUSE": (5.0, 0.2, 4700.15, 9351.4, 1.25, 2.51, "square"),
    "NIRSpec_PRISM_CLEAR": (3.0, 0.1, 6000.0, 53000.0, 114.36, 471.00, "square"),
    "NIRSpec_G140M_F070LP": (3.0, 0.1, 7000.0, 12600.0, 6.38, 15.02, "square"),
    "NIRSpec_G140M_F100LP": (3.0, 0.1, 9800.0, 18800.0, 6.38, 15.02, "square"),
    "NIRSpec_G235M_F170LP": (3.0, 0.1, 17000.0, 31500.0, 10.69, 25.20, "square"),
    "NIRSpec_G395M_F290LP": (3.0, 0.1, 28800.0, 52000.0, 17.98, 42.39, "square"),
    "NIRSpec_G140H_F070LP": (3.0, 0.1, 7000.0, 12600.0, 2.41, 5.65, "square"),
    "NIRSpec_G140H_F100LP": (3.0, 0.1, 9800.0, 18700.0, 2.37, 5.65, "square"),
    "NIRSpec_G235H_F170LP": (3.0, 0.1, 17000.0, 31500.0, 3.98, 9.42, "square"),
    "NIRSpec_G395H_F290LP": (3.0, 0.1, 28800.0, 52000.0, 6.69, 15.78, "square"),
    "MaNGA_12": (12.0, 0.5, 3622.0, 10354.0, 1.04, 2.85, "hexagonal"),
    "MaNGA_32": (32.0, 0.5, 3622.0, 10354.0, 1.04, 2.85, "hexagonal"),
    "SAMI": (15.0, 0.5, 3750.0, 5750.0, 1.04, 2.65, "circular"),
    "HECTOR": (30.0, 0.1, 3720.0, 5910.0, 1.6, 1.3, "hexagonal"),
    "CALIFA": (74.0, 1.0, 3700.0, 4750.0, 2.7, 2.7, "hexagonal"),
}
FWHM_A_SIGMA = 2 * math.sqrt(2 * math.log(2))


def instrument_wave(name: str) -> np.ndarray:
    """The instrument's wavelengths; the upper end of its range is not among them."""
    _, _, lo, hi, step, _, _ = INSTRUMENTS[name]
    return lo + step * np.arange(int(math.ceil((hi - lo) / step - 1e-9)))


def instrument_bins(name: str) -> int:
    return int(math.floor(INSTRUMENTS[name][0] / INSTRUMENTS[name][1] + 1e-9))


def instrument_lsf(name: str) -> float:
    """Sigma of the line spread function in Angstrom."""
    return INSTRUMENTS[name][5] / FWHM_A_SIGMA


def spatial_grid(galaxy: DataFrame, fov: float, bins: int, c: Cosmology = PLANCK15) -> DataFrame:
    """Adds the aperture's and a bin's size in kpc at each galaxy's redshift."""
    scaled = distance_columns(galaxy, "redshift", c)
    return scaled.withColumn("aperture_kpc", F.col("kpc_per_arcsec") * fov).withColumn("bin_kpc", F.col("aperture_kpc") / bins)


def euler_matrix(alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Rotation about x, then y, then z, in degrees."""
    (ca, sa), (cb, sb), (cg, sg) = ((math.cos(math.radians(t)), math.sin(math.radians(t))) for t in (alpha, beta, gamma))
    x = np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]])
    y = np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]])
    z = np.array([[cg, -sg, 0], [sg, cg, 0], [0, 0, 1]])
    return z @ y @ x


def euler_rotate(df: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """Row vectors times the matrix, for positions and velocities."""
    m = euler_matrix(alpha, beta, gamma)
    turned = {}
    for names in (("x", "y", "z"), ("vx", "vy", "vz")):
        for j, out in enumerate(names):
            turned[out] = sum(F.col(names[i]) * float(m[i, j]) for i in range(3))
    return df.withColumns(turned)


def principal_axes(tensor: DataFrame) -> DataFrame:
    """Eigenvectors (columns, ascending eigenvalues) of each galaxy's tensor as axes array<double>[9], row by row; the
    largest component of each is positive, the last one's sign makes the matrix right-handed."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        a = np.empty((len(xx), 3, 3))
        for (i, j), s in {(0, 0): xx, (1, 1): yy, (2, 2): zz, (0, 1): xy, (0, 2): xz, (1, 2): yz}.items():
            a[:, i, j] = a[:, j, i] = s
        _, v = np.linalg.eigh(a)
        big = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
        v = v * np.sign(big)
        v[:, :, 2] *= np.sign(np.linalg.det(v))[:, None]
        return pd.Series(list(v.reshape(-1, 9)))

    return tensor.select("galaxy_id", solve("ixx", "iyy", "izz", "ixy", "ixz", "iyz").alias("axes"))


def apply_rotation(df: DataFrame, axes: DataFrame) -> DataFrame:
    turned = {}
    for names in (("x", "y", "z"), ("vx", "vy", "vz")):
        for j, out in enumerate(names):
            turned[out] = sum(F.col(names[i]) * F.element_at("axes", 3 * i + j + 1) for i in range(3))
    return df.join(beside_particles(axes), "galaxy_id").withColumns(turned).drop("axes")


def orient(df: DataFrame, galaxy: DataFrame, view: str | tuple[float, float, float], align: DataFrame | None = None, axes: DataFrame | None = None) -> DataFrame:
    """Aligns with the principal axes (`axes`, where they are known, else those of `align` or of df itself), then turns to the
    view or the given angles. The axes, nine numbers a galaxy, are kept, since jobs read their particles more than once."""
    angles = VIEWS[view] if isinstance(view, str) else view
    if axes is None:
        axes = principal_axes(inertia_tensor(df if align is None else align, galaxy)).persist()
    return euler_rotate(apply_rotation(df, axes), *angles)


def aperture(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """(x, y) of the spaxels inside a square, circular or hexagonal aperture of n x n."""
    x, y = F.col("x") - (n - 1) / 2, F.col("y") - (n - 1) / 2
    side, apothem = n / 4, n * math.sqrt(3) / 4
    inside = {
        "square": F.lit(True),
        "circular": F.sqrt(x * x + y * y) <= n / 2,
        "hexagonal": (2 * side * apothem - side * F.abs(y) - apothem * F.abs(x) >= 0) & (F.abs(x) < n / 2) & (F.abs(y) < apothem),
    }[kind]
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y")).where(inside)
