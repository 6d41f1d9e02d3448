"""End-to-end jobs: raw snapshots to particles, particles to cubes and images, for all galaxies at once."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmology as K
from ..operators import cube as C
from ..operators import dust as D
from ..operators import geometry as G
from ..operators import particles as P
from ..operators import spectra as S
from ..operators.scan import asof_sum
from ..sources import ingest as I
from ..sources.galaxies import beside_particles
from ..sources.store import GalaxyStore


@dataclass(frozen=True)
class Snapshot:
    galaxy: DataFrame
    stars: DataFrame
    gas: DataFrame | None = None
    axes: dict[str, DataFrame] = field(default_factory=dict)  # principal axes by type, where they are known already


@dataclass(frozen=True)
class Layout:
    """How a simulation names its fields; `formation`: its stars' age field is a formation scale factor."""

    fields: dict[str, dict[str, str]]
    missing: str
    formation: bool


LAYOUTS = {
    "TNG": Layout({"stars": I.TNG_STARS, "gas": I.TNG_GAS}, "error", True),
    "pynbody": Layout({"stars": I.PYNBODY_STARS, "gas": I.PYNBODY_GAS}, "zero", False),
}


def canonical(raw: dict[str, DataFrame], layout: str | Layout = "TNG", attributes: dict | None = None, units: dict | None = None, scale_factor: float | Column = 1.0, hubble: float | Column = K.PLANCK15.h, cosmology: K.Cosmology = K.PLANCK15) -> dict[str, DataFrame]:
    """Raw particle tables by type -> canonical ones: fields renamed, wind cells dropped and formation factors turned into
    ages, physical and canonical units, fields and units checked. attributes: {type: {field: (alpha, beta, cgs)}}; units:
    {type: {field: unit}}, canonical ones where none is given. Values: see validate_groups() and prepare()."""
    plan, out = LAYOUTS[layout] if isinstance(layout, str) else layout, {}
    unexpected = [kind for kind in raw if kind not in plan.fields]
    if unexpected:
        raise ValueError(f"unexpected groups: {unexpected}")
    for kind, df in raw.items():
        df = I.ingest_snapshot(df, plan.fields[kind], plan.missing)
        if kind == "stars" and plan.formation:
            df = K.stellar_age(P.drop_wind(df, "age"), "age", cosmology)
        df = I.to_physical(df, (attributes or {}).get(kind, {}), scale_factor, hubble)
        known = {c: I.UNITS[c] for c in df.columns if c in I.UNITS} | (units or {}).get(kind, {})
        out[kind] = I.to_canonical_units(df, known)
    I.check_groups(out)
    return out


def prepare(raw: dict[str, DataFrame], galaxy: DataFrame, path: str | None = None, mode: str = "skip", header: dict | None = None, subset: int | None = None, seed: int = 42, **ingest) -> Snapshot:
    """Raw snapshot -> centred particles of the galaxies in `galaxy`. Particles need a place and a mass, centers must lie inside their bounds, velocities
    lose the central one, gas with metals gets its abundances, and `subset` particles of each type and galaxy are drawn.
    `ingest`: arguments of canonical().

    path: a GalaxyStore, from which the particles then come. mode: `skip` takes from raw only the galaxies that the store lacks,
    `overwrite` all of them, `reuse` none (an absent one is an error), `error` refuses a galaxy that is there. What fails is not
    committed."""
    I.validate_galaxy(galaxy)
    galaxy = beside_particles(galaxy)
    tables = canonical(raw, **ingest)
    if path:
        store = GalaxyStore(galaxy.sparkSession, path)
        fresh = store.to_write(galaxy, mode)
        if not fresh.isEmpty():
            store.add(tables, fresh, header, I.check_places)
        tables = {kind: store.read(kind, galaxy) for kind in tables}

    out, axes = {}, {}
    for kind, df in tables.items():
        df = I.vector_columns(df)
        summary = P.summarise(df, galaxy)  # one pass: bounds, velocity counts, second moments
        P.check_inside(summary)
        df = P.recenter(df, galaxy, counts=summary.velocity_counts())
        df = D.with_abundances(df) if "metals" in df.columns else df
        if subset:
            df = P.subset(df, subset, seed)  # which has axes of its own
        else:
            axes[kind] = G.principal_axes(summary.tensor()).persist()
        out[kind] = df
    return Snapshot(galaxy, out["stars"], out.get("gas"), axes)


def observed_with(galaxy: DataFrame, instrument: str) -> tuple[DataFrame, dict]:
    """The galaxies (with redshift) with half the instrument's field in kpc, and the job arguments that the instrument sets."""
    n = G.instrument_bins(instrument)
    seen = G.spatial_grid(galaxy, G.INSTRUMENTS[instrument][0], n).withColumn("half_kpc", F.col("aperture_kpc") / 2)
    return seen.select(*galaxy.columns, "half_kpc"), {"target": G.instrument_wave(instrument), "half_size": "half_kpc", "n": n, "z": "redshift", "lsf": G.instrument_lsf(instrument)}


def _value(v: float | str) -> Column:
    return F.col(v) if isinstance(v, str) else F.lit(float(v))


def _placed(df: DataFrame, galaxy: DataFrame, half_size: float | str, n: int, how: str, *others: float | str) -> DataFrame:
    """In the field of view and on its grid; columns of the galaxy table that are named come along."""
    names = [v for v in (half_size, *others) if isinstance(v, str)]
    df = P.with_galaxy(df, galaxy.select("galaxy_id", *dict.fromkeys(names))) if names else df
    return P.assign_spaxel(P.apply_mask(P.fov_mask(df, _value(half_size)), how), _value(half_size), n)


def _observed(cube: DataFrame, n: int, psf, lsf, noise, wave_res: float) -> DataFrame:
    if psf:
        cube = C.convolve_psf(cube, n, *psf)
    if lsf:
        cube = C.convolve_lsf(cube, lsf, wave_res)
    return C.add_noise(cube, *noise) if noise else cube


def mock_cube(snapshot: Snapshot, grid, wave: np.ndarray, target: np.ndarray, half_size: float | str, n: int, z: float | str = 0.0, view="face-on", psf=None, lsf: float | None = None, noise=None, method: str = "cubic", grid_limit: int = S.MAX_GRID_BYTES) -> DataFrame:
    """orient -> field of view -> spaxel -> template * mass -> Doppler and resample -> sum -> PSF -> LSF -> noise.

    half_size, z: one value for all galaxies, or a column of the galaxy table. psf: (size, sigma); noise: (signal to noise,
    distribution, seed). grid: arrays or a DataFrame, which is broadcast up to grid_limit bytes."""
    galaxy = beside_particles(snapshot.galaxy)
    stars = _placed(G.orient(snapshot.stars, galaxy, view, axes=snapshot.axes.get("stars")), galaxy, half_size, n, "drop", z)
    cube = C.zero_fill(C.add_cubes(S.star_cube(stars, grid, wave, target, _value(z), method, limit=grid_limit)), n, len(target), galaxy)
    return _observed(cube, n, psf, lsf, noise, float(target[1] - target[0]))


def dust_columns(stars: DataFrame, gas: DataFrame, half_size: float | str, n: int, model: str = "broken power law fit", xco: str = "Z", grain_density: float = 3.5, rows_a_piece: int | None = None) -> DataFrame:
    """Stars (placed) with av: gas dust columns accumulated along z per spaxel, interpolated at each star. gas has metals, or
    h_frac and o_frac. Gas outside the field of view stays as knots of no mass in the edge spaxels."""
    side = 2 * _value(half_size) / n
    gas = D.with_abundances(gas)
    surface = F.col("mass") * D.dust_to_gas(D.oxygen_abundance(F.col("o_frac"), F.col("h_frac")), model, xco) / (side * side)
    dusty = gas.select("galaxy_id", "spaxel", "z", D.visual_extinction(surface, grain_density).alias("a"))
    return asof_sum(stars, dusty, "a", "av", rows_a_piece=rows_a_piece)


CURVES = {"Cardelli89": D.ccm89, "Gordon23": D.gordon23}


def curve_on(spark, target: np.ndarray, curve: str, rv: float) -> list[float]:
    """A(wave) / A_V of an extinction curve at each target wavelength (Angstrom)."""
    microns = F.array(*[F.lit(float(w) * 1e-4) for w in target])
    return spark.range(1).select(F.transform(microns, lambda x: CURVES[curve](x, rv))).first()[0]


def mock_cube_dusty(snapshot: Snapshot, grid, wave: np.ndarray, target: np.ndarray, half_size: float | str, n: int, z: float | str = 0.0, view="face-on", psf=None, lsf: float | None = None, noise=None, method: str = "cubic", curve: str = "Cardelli89", rv: float = 3.1, model: str = "broken power law fit", xco: str = "Z", grain_density: float = 3.5, align_by: str | None = None, grid_limit: int = S.MAX_GRID_BYTES) -> DataFrame:
    """mock_cube with each star's spectrum attenuated before it is summed, in the same pass. align_by='stars': gas is turned
    with the stars' axes instead of its own."""
    galaxy = beside_particles(snapshot.galaxy)
    stars = _placed(G.orient(snapshot.stars, galaxy, view, axes=snapshot.axes.get("stars")), galaxy, half_size, n, "drop", z)
    own = snapshot.axes.get("stars" if align_by == "stars" else "gas")
    gas = _placed(G.orient(snapshot.gas, galaxy, view, snapshot.stars if align_by == "stars" else None, own), galaxy, half_size, n, "zero")
    seen = dust_columns(stars, gas, half_size, n, model, xco, grain_density)
    cube = C.zero_fill(C.add_cubes(S.star_cube(seen, grid, wave, target, _value(z), method, curve=curve_on(stars.sparkSession, target, curve, rv), limit=grid_limit)), n, len(target), galaxy)
    return _observed(cube, n, psf, lsf, noise, float(target[1] - target[0]))


def photometric_images(cube: DataFrame, curves: DataFrame, wave) -> DataFrame:
    """Images of a cube in several filters, scaled together to 0..1."""
    return C.minmax_normalise(S.photometry(cube, curves, F.array(*[F.lit(float(w)) for w in wave])))
