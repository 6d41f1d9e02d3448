"""Scans, unit conversion, validation and sinks of particle tables, template grids, filter curves and cubes."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Field mappings, required fields and canonical units of the data model.
TNG_STARS = {"GFM_InitialMass": "mass", "Coordinates": "coords", "GFM_Metallicity": "metallicity", "GFM_StellarFormationTime": "age", "Velocities": "velocity"}
TNG_GAS = {"Density": "density", "Masses": "mass", "GFM_Metallicity": "metallicity", "GFM_Metals": "metals", "StarFormationRate": "sfr", "InternalEnergy": "internal_energy", "Velocities": "velocity", "Coordinates": "coords", "ElectronAbundance": "electron_abundance"}
PYNBODY_STARS = {"pos": "coords", "mass": "mass", "vel": "velocity", "metals": "metallicity", "tform": "age"}
PYNBODY_GAS = {"density": "density", "temp": "temperature", "pos": "coords", "mass": "mass", "vel": "velocity", "metals": "metallicity"}
DEFAULT_FIELDS = {
    "gas": ["Coordinates", "Density", "Masses", "GFM_Metallicity", "GFM_Metals", "StarFormationRate", "InternalEnergy", "Velocities", "ElectronAbundance"],
    "stars": ["Coordinates", "GFM_InitialMass", "GFM_Metallicity", "GFM_StellarFormationTime", "Velocities"],
}
REQUIRED = {"stars": ["coords", "mass", "metallicity", "velocity", "age"], "gas": ["coords", "mass", "metallicity", "velocity", "density", "metals"], "galaxy": ["redshift", "center", "halfmassrad_stars"]}
UNITS = {"coords": "kpc", "center": "kpc", "halfmassrad_stars": "kpc", "mass": "Msun", "velocity": "km/s", "age": "Gyr", "density": "Msun/kpc^3", "sfr": "Msun/yr", "internal_energy": "erg/g", "temperature": "K", "metallicity": "", "metals": "", "electron_abundance": "", "redshift": ""}
UNIT_FACTORS = {
    ("cm", "kpc"): 3.24078e-22, ("Mpc", "kpc"): 1e3, ("pc", "kpc"): 1e-3, ("g", "Msun"): 5.02785e-34, ("cm/s", "km/s"): 1e-5, ("m/s", "km/s"): 1e-3,
    ("Gyr", "Myr"): 1e3, ("Myr", "Gyr"): 1e-3, ("yr", "Gyr"): 1e-9, ("g/cm^3", "Msun/kpc^3"): 1.477e31, ("Zsun", ""): 1.0, ("micron", "Angstrom"): 1e4, ("nm", "Angstrom"): 10.0,
}


def _each(column: str, dtype, f) -> Column:
    return F.transform(column, f) if dtype.typeName() == "array" else f(F.col(column))


# Components of the fields that are vectors; a field that is not here is a number.
COMPONENTS = {"coords": 3, "velocity": 3, "center": 3, "metals": 10}


def zero_of(field: str) -> Column:
    """A zero of a canonical field's own shape."""
    return F.array_repeat(F.lit(0.0), COMPONENTS[field]) if field in COMPONENTS else F.lit(0.0)


def ingest_snapshot(df: DataFrame, mapping: dict[str, str], missing: str = "error", keep: tuple[str, ...] = ("galaxy_id", "particle_id")) -> DataFrame:
    """Renames source fields; unknown fields are an error; absent ones an error, or zeros of the field's shape with a warning
    for missing='zero'."""
    unknown = [c for c in df.columns if c not in mapping and c not in keep]
    absent = [s for s in mapping if s not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    if absent and missing != "zero":
        raise ValueError(f"missing fields: {absent}")
    if absent:
        warnings.warn(f"fields set to zero: {absent}", stacklevel=2)
    return df.select(*[c for c in keep if c in df.columns], *[(F.col(s) if s in df.columns else zero_of(t)).alias(t) for s, t in mapping.items()])


def select_halo(df: DataFrame, halo_id: int | None = None) -> DataFrame:
    """Rows of a halo; without an id (or 0), of the first one."""
    return df.where(F.col("halo_id") == halo_id) if halo_id else df.join(F.broadcast(df.agg(F.min("halo_id").alias("halo_id"))), "halo_id", "left_semi")


def select_fields(df: DataFrame, kind: str, keep: tuple[str, ...] = ("galaxy_id", "particle_id")) -> DataFrame:
    """The default fields of a particle type; the projection reaches the scan."""
    return df.select(*[c for c in keep if c in df.columns], *DEFAULT_FIELDS[kind])


def vector_columns(df: DataFrame) -> DataFrame:
    """coords and velocity arrays as the columns x, y, z, vx, vy, vz, with their units."""
    for source, names in (("coords", ("x", "y", "z")), ("velocity", ("vx", "vy", "vz"))):
        if source in df.columns:
            unit = df.schema[source].metadata
            df = df.withColumns({c: F.element_at(source, k + 1) for k, c in enumerate(names)}).drop(source)
            for c in names if unit else ():
                df = df.withMetadata(c, unit)
    return df


def to_physical(df: DataFrame, attributes: dict[str, tuple[float, float, float]], scale_factor: float | Column, hubble: float | Column) -> DataFrame:
    """value * a^alpha * h^beta * cgs for (alpha, beta, cgs) of each column; a cgs factor of 0 means 1."""
    def factor(alpha, beta, cgs):
        return F.pow(F.lit(scale_factor), F.lit(alpha)) * F.pow(F.lit(hubble), F.lit(beta)) * F.lit(cgs or 1.0)

    return df.withColumns({c: _each(c, df.schema[c].dataType, lambda v, k=k: v * factor(*k)) for c, k in attributes.items()})


def to_canonical_units(df: DataFrame, units: dict[str, str], canonical: dict[str, str] = UNITS) -> DataFrame:
    """Multiplies each column into its canonical unit, which is kept in the column's metadata."""
    out = df
    for column, unit in units.items():
        target = canonical[column]
        if unit != target:
            factor = UNIT_FACTORS[unit, target] if (unit, target) in UNIT_FACTORS else 1 / UNIT_FACTORS[target, unit]
            out = out.withColumn(column, _each(column, out.schema[column].dataType, lambda v, f=factor: v * f))
        out = out.withMetadata(column, {"unit": target})
    return out


def units_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["unit"] for f in df.schema if "unit" in f.metadata}


def check_fields(df: DataFrame, kind: str, with_units: bool = True) -> None:
    """An error names a field that is missing, or has no unit."""
    for field in REQUIRED[kind]:
        if field not in df.columns:
            raise ValueError(f"missing field {field} in {kind}")
        if with_units and "unit" not in df.schema[field].metadata:
            raise ValueError(f"missing unit of {field} in {kind}")


def validate(df: DataFrame, kind: str, with_units: bool = True) -> DataFrame:
    """Schema check, then null, NaN and negative counts per galaxy and numeric column."""
    check_fields(df, kind, with_units)
    return value_report(df, [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")])


def check_groups(groups: dict[str, DataFrame], with_units: bool = True) -> None:
    """An error names an unexpected group or a field as above, or says that no particle type is there."""
    unexpected = [g for g in groups if g not in REQUIRED]
    if unexpected:
        raise ValueError(f"unexpected groups: {unexpected}")
    if not {"stars", "gas"} & set(groups):
        raise ValueError("none of the expected particle types is present")
    for kind in {"stars", "gas"} & set(groups):
        check_fields(groups[kind], kind, with_units)


def validate_groups(groups: dict[str, DataFrame], with_units: bool = True) -> dict[str, DataFrame]:
    """Value reports of all particle types, whose fields are checked before."""
    check_groups(groups, with_units)
    return {kind: validate(df, kind, with_units) for kind, df in groups.items() if kind != "galaxy"}


def validate_galaxy(galaxy: DataFrame, with_units: bool = False) -> None:
    """An error names a missing field of the galaxy table, or says that it has none of the expected ones."""
    absent = [f for f in ("galaxy_id", *REQUIRED["galaxy"]) if f not in galaxy.columns]
    if not set(REQUIRED["galaxy"]) & set(galaxy.columns):
        raise ValueError("none of the expected fields is in galaxy")
    if absent:
        raise ValueError(f"missing fields in galaxy: {absent}")
    units = [f for f in REQUIRED["galaxy"] if "unit" not in galaxy.schema[f].metadata] if with_units else []
    if units:
        raise ValueError(f"missing unit of {units} in galaxy")


def check_places(kind: str, df: DataFrame) -> None:
    """Particles need a place and a mass: an error names galaxies with a null or NaN among coords or mass."""
    lost = F.col("coords").isNull() | F.exists("coords", lambda v: v.isNull() | F.isnan(v)) | F.col("mass").isNull() | F.isnan("mass")
    bad = df.where(lost).select("galaxy_id").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"{kind} without place or mass in galaxies {[r[0] for r in bad]}")


def value_report(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = [F.sum(F.when(test, 1).otherwise(0)).alias(f"{c}_{name}") for c in columns for name, test in (("null", F.col(c).isNull()), ("nan", F.isnan(c)), ("negative", F.col(c) < 0))]
    return df.groupBy("galaxy_id").agg(F.count("*").alias("rows"), *counts)


def write_canonical(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by galaxy; ignore keeps what is there, overwrite replaces the galaxies in df only, error fails."""
    writer = df.write.partitionBy("galaxy_id").mode(mode)
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_header(spark: SparkSession, header: dict[str, object], path: str, galaxy_id: int | None = None, mode: str = "append") -> None:
    """Metadata of a snapshot as a key/value table."""
    spark.createDataFrame([(galaxy_id, k, str(v)) for k, v in header.items()], "galaxy_id long, key string, value string").write.mode(mode).parquet(path)


def flatten_catalogue(df: DataFrame) -> DataFrame:
    """Scalar fields of a subhalo catalogue with center = (pos_x, pos_y, pos_z); nested ones are dropped by schema."""
    flat = df.select(*[f.name for f in df.schema if f.dataType.typeName() not in ("struct", "map")])
    return flat.withColumn("center", F.array("pos_x", "pos_y", "pos_z")) if "pos_x" in flat.columns else flat


def load_template_grid(df: DataFrame, log_fields: tuple[str, ...] = ()) -> DataFrame:
    """Dense (metallicity[], age[], flux[met][age][wave]) rows -> (met_idx, age_idx, metallicity, age, flux)."""
    for c in log_fields:
        df = df.withColumn(c, F.transform(c, lambda v: F.pow(F.lit(10.0), v)))
    by_met = df.select("age", "metallicity", F.posexplode("flux").alias("met_idx", "plane"))
    rows = by_met.select("age", "metallicity", "met_idx", F.posexplode("plane").alias("age_idx", "flux"))
    return rows.select("met_idx", "age_idx", F.element_at("metallicity", F.col("met_idx") + 1).alias("metallicity"), F.element_at("age", F.col("age_idx") + 1).alias("age"), "flux")


def load_template_cards(cards: DataFrame, rows: DataFrame) -> DataFrame:
    """Header cards (key, value) and flux rows (idx, flux) -> template grid. NAMEi holds age and Z, NORMi the
    mass-to-light ratio (0 means 1)."""
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("int").alias("idx")
    names = cards.where(F.col("key").rlike(r"^NAME\d+$")).select(number, "value")
    age = F.regexp_extract("value", r"_(\d+\.?\d*)(Gyr|Myr)?_", 1).cast("double")
    unit = F.regexp_extract("value", r"_(\d+\.?\d*)(Gyr|Myr)?_", 2)
    z = F.concat(F.lit("0."), F.regexp_extract("value", r"z(\d+)", 1)).cast("double")
    names = names.select("idx", F.when(unit == "Myr", age / 1000).otherwise(age).alias("age"), z.alias("metallicity"))
    norms = cards.where(F.col("key").rlike(r"^NORM\d+$")).select(number, F.col("value").cast("double").alias("norm"))
    grid = rows.join(names, "idx").join(norms, "idx", "left")
    weight = F.when(F.coalesce("norm", F.lit(0.0)) == 0, 1.0).otherwise(F.col("norm"))
    axis = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1
    met, ages = (names.select(c).distinct().select(c, axis(c).alias(i)) for c, i in (("metallicity", "met_idx"), ("age", "age_idx")))
    return grid.join(F.broadcast(met), "metallicity").join(F.broadcast(ages), "age").select("met_idx", "age_idx", "metallicity", "age", F.transform("flux", lambda v: v / (1 / weight)).alias("flux"))


def template_wave(crval: float, cdelt: float | None, crpix: float, n: int) -> Column:
    """Wavelengths of a header; a missing or zero CDELT means 1."""
    cdelt = cdelt or 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(crval) + F.lit(cdelt) * (i + 1 - crpix))


def load_filters(df: DataFrame, facility: str, instrument: str | list[str] | None = None, name: str | list[str] | None = None) -> DataFrame:
    """Curves (filter_id = facility/instrument.name, wavelength, transmission) by facility, instruments and names."""
    if name is not None and instrument is None:
        raise ValueError("a filter name needs an instrument")
    rows = df.where(F.col("filter_id").startswith(facility + "/"))
    if instrument is not None:
        instruments = [instrument] if isinstance(instrument, str) else instrument
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("filter_id").startswith(f"{facility}/{i}.") for i in instruments]))
        if name is not None:
            names = [name] if isinstance(name, str) else name
            rows = rows.where(F.col("filter_id").isin([f"{facility}/{i}.{n}" for i in instruments for n in names]))
            found = {r[0].rsplit(".", 1)[1] for r in rows.select("filter_id").distinct().collect()}
            if set(names) - found:
                raise ValueError(f"invalid filter names: {sorted(set(names) - found)}")
    return rows


def filter_catalogue(df: DataFrame) -> DataFrame:
    part = F.split("filter_id", "/")
    return df.groupBy("filter_id").agg(F.min("wavelength").alias("wave_min"), F.max("wavelength").alias("wave_max"), F.count("*").alias("points")).select(part[0].alias("facility"), F.split(part[1], r"\.")[0].alias("instrument"), "filter_id", "wave_min", "wave_max", "points")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="filter_id string, wavelength double, transmission double, facility string")


def write_filters(df: DataFrame, path: str) -> None:
    df.withColumn("facility", F.split("filter_id", "/")[0]).write.partitionBy("facility").mode("overwrite").csv(path, header=True)


def uniform(*keys: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone, not on partitioning: 52 bits of the MD5 of the keys as text."""
    digits = F.substring(F.md5(F.concat_ws(",", *[F.lit(k) if isinstance(k, int) else k for k in keys])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def synth_galaxy(spark: SparkSession, n: int, seed: int = 0, metallicity: tuple[float, float] = (1e-4, 0.05), age: tuple[float, float] = (0.0, 13.8)) -> DataFrame:
    """Seeded particles: coordinates and velocities in +-100, unit mass, metallicity and age inside the bounds."""
    def between(lo, hi, k):
        return uniform(F.col("id"), seed, k) * (hi - lo) + lo

    axes = [between(-100.0, 100.0, k).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))]
    return spark.range(n).select(F.lit(0).cast("long").alias("galaxy_id"), F.col("id").alias("particle_id"), *axes, F.lit(1.0).alias("mass"), between(*metallicity, 6).alias("metallicity"), between(*age, 7).alias("age"))


# Header keys of a cube.
CUBE_KEYS = ("PIPELINE", "DIST_z", "ROTATION", "SIM", "GALAXYID", "SNAPSHOT", "SUBSET", "SSP", "INSTR", "PSF", "PSF_SIZE", "PSFSIGMA", "LSF", "S_TO_N", "N_DISTR", "COSMO")


def cube_name(header: dict[str, object], ptype: str = "stars") -> str:
    return f"{header.get('SIM', 'sim')}_id{header.get('GALAXYID', 0)}_snap{header.get('SNAPSHOT', 0)}_{ptype}_subset{header.get('SUBSET', False)}"


def cube_wcs(n: int, wave0: float, wave_step: float, pixel_arcsec: float, unit: str) -> dict[str, object]:
    """The world coordinates of a cube of n x n spaxels; the sky axes are centred, in degrees."""
    degrees = pixel_arcsec / 3600
    axes = {"CRPIX1": (n - 1) / 2, "CRPIX2": (n - 1) / 2, "CRPIX3": 1, "CRVAL3": wave0, "CD1_1": degrees, "CD1_2": 0, "CD1_3": 0, "CD2_1": 0, "CD2_2": degrees, "CD2_3": 0, "CD3_1": 0, "CD3_2": 0, "CD3_3": wave_step}
    return axes | {"CUNIT1": "deg", "CUNIT2": "deg", "CUNIT3": "Angstrom", "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CTYPE3": "AWAV", "BUNIT": unit, "EXTNAME": "DATA"}


CHUNK = 512  # wavelengths of a stored chunk of a spectrum


def write_cube(cube: DataFrame, header: dict[str, object], path: str, n: int, wave0: float, wave_step: float, pixel_arcsec: float, ptype: str = "stars", unit: str = "Lsun/Angstrom", chunk: int = CHUNK) -> None:
    """Cube by galaxy under path/cube, each spectrum in chunks of `chunk` wavelengths, and a header of each of its galaxies with
    the WCS keys under path/header; galaxies that are there already stay unless this cube has them. unit: erg/(s*cm^2*A) after
    luminosity_to_flux."""
    fixed = {k: header.get(k, "") for k in CUBE_KEYS if k != "GALAXYID"} | cube_wcs(n, wave0, wave_step, pixel_arcsec, unit) | {"CHUNK": chunk}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in fixed.items()])
    galaxy = F.col("galaxy_id").cast("string")
    before, after = cube_name(header | {"GALAXYID": "\0"}, ptype).split("\0")
    own = F.array(F.struct(F.lit("GALAXYID").alias("key"), galaxy.alias("value")), F.struct(F.lit("NAME").alias("key"), F.concat(F.lit(before), galaxy, F.lit(after)).alias("value")))
    keys = cube.select("galaxy_id").distinct().select("galaxy_id", F.explode(F.concat(pairs, own)).alias("p")).select("galaxy_id", "p.*")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("flux") - 1), F.lit(chunk))
    parts = F.explode(F.transform(starts, lambda at: F.struct((at / chunk).cast("int").alias("chunk"), F.slice("flux", at + 1, chunk).alias("flux"))))
    chunks = cube.where("flux is not null").select("galaxy_id", "spaxel", parts.alias("c")).select("galaxy_id", "spaxel", "c.chunk", "c.flux")
    for df, part, by in ((chunks, "cube", ("galaxy_id", "chunk")), (keys, "header", ("galaxy_id",))):
        df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{part}")


def read_chunks(spark: SparkSession, path: str, lo: int = 0, hi: int | None = None) -> tuple[DataFrame, int]:
    """(rows (galaxy_id, spaxel, chunk, flux), chunk length) of the stored chunks that hold wavelengths lo .. hi - 1."""
    found = spark.read.parquet(f"{path}/header").where("key = 'CHUNK'").select(F.col("value").cast("int")).distinct().collect()
    if len(found) != 1:
        raise ValueError(f"cubes of {len(found)} chunk lengths under {path}")
    chunk = found[0][0]
    rows = spark.read.parquet(f"{path}/cube")
    return rows.where(F.col("chunk") >= lo // chunk) if hi is None else rows.where(F.col("chunk").between(lo // chunk, (hi - 1) // chunk)), chunk


def read_cube(spark: SparkSession, path: str, lo: int = 0, hi: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cube, header); of the wavelengths lo .. hi - 1 alone, where they are given: other chunks are not read."""
    rows, chunk = read_chunks(spark, path, lo, hi)
    pieces = F.array_sort(F.collect_list(F.struct("chunk", "flux")))  # as many as a spectrum has chunks
    whole = rows.groupBy("galaxy_id", "spaxel").agg(F.flatten(F.transform(pieces, lambda p: p["flux"])).alias("flux"))
    first = lo - lo // chunk * chunk
    cut = F.slice("flux", first + 1, hi - lo) if hi is not None else F.slice("flux", first + 1, F.greatest(F.lit(0), F.size("flux") - first))
    return whole.select("galaxy_id", "spaxel", cut.alias("flux")), spark.read.parquet(f"{path}/header")


def stored_image(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """The flux of wavelengths lo .. hi - 1 in each spaxel of a stored cube, summed chunk by chunk; no spectrum is put together."""
    rows, chunk = read_chunks(spark, path, lo, hi)
    at = F.col("chunk") * chunk
    first, last = F.greatest(F.lit(lo), at) - at, F.least(F.lit(hi), at + chunk) - at
    part = F.aggregate(F.slice("flux", first + 1, F.greatest(F.lit(0), last - first)), F.lit(0.0), lambda s, v: s + v)
    return rows.groupBy("galaxy_id", "spaxel").agg(F.sum(part).alias("image"))
