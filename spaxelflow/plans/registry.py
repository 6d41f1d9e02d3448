"""Registered queries of the particle-to-datacube operators, and the SQL they are checked against.

Queries read the given tables through the views of sources.views (stars from lineitem, gas from orders, spectra from
embeddings). Numbers are rounded on both sides, since sums depend on order in their last digits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cosmology as K
from ..operators import cube as C
from ..operators import dust as D
from ..operators import geometry as G
from ..operators import particles as P
from ..operators import spectra as S
from ..operators.scan import asof_sum
from ..sources import ingest as I
from ..sources.store import GalaxyStore, scratch
from ..sources.views import GAS, STARS, frame
from ..streaming import cubes as incremental
from . import jobs

HALF, N = 8.0, 5
KEYS = ["galaxy_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_Q, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stars_of(spark, d):
    return frame(spark, d, "stars")


def placed(spark, d, gas: bool = False):
    return P.assign_spaxel(P.apply_mask(P.fov_mask(frame(spark, d, "gas" if gas else "stars"), HALF)), HALF, N)


def galaxies(df):
    """One row a galaxy: mass-free stand-ins for a catalogue, derived from the particles."""
    return df.groupBy("galaxy_id").agg((F.count("*") % 7 / 10.0).alias("a"), F.lit(5.0).alias("halfmassrad_stars")).select("galaxy_id", F.array("a", F.col("a") / 2, F.lit(0.0)).alias("center"), "halfmassrad_stars")


_ST, _GA = f"stars AS ({STARS})", f"gas AS ({GAS})"
_BIN = "least(greatest(floor((x + 8e0) / 3.2e0), 0), 4) + 5 * least(greatest(floor((y + 8e0) / 3.2e0), 0), 4)"
_IN = "x BETWEEN -8 AND 8 AND y BETWEEN -8 AND 8"
_PL = f"{_ST}, p AS (SELECT *, CAST({_BIN} AS INT) AS spaxel FROM stars WHERE {_IN})"
_PG = f"{_GA}, pg AS (SELECT *, CAST({_BIN} AS INT) AS spaxel FROM gas WHERE {_IN})"
_SP = "sp AS (SELECT label % 4 AS galaxy_id, vec_id, CAST(vec_id % 25 AS INT) AS spaxel, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), sl AS (SELECT galaxy_id, vec_id, spaxel, k, abs(CAST(e AS DOUBLE)) AS v FROM sp), cl AS (SELECT galaxy_id, spaxel, k, sum(v) AS v FROM sl GROUP BY ALL)"
_R2 = "sqrt(x * x + y * y + z * z)"
_CEN = f"g AS (SELECT galaxy_id, count(*) % 7 / 10e0 AS a FROM stars GROUP BY galaxy_id)"


def cube_of(spark, d):
    return C.accumulate_cube(frame(spark, d, "spectra"))


def long_out(cube, digits: int = 6):
    return C.to_long(cube).select("galaxy_id", "spaxel", "k", r(F.col("v"), digits).alias("v"))


# ---- projections and predicates
@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y FROM stars WHERE {_IN}")
def fov_filter(spark, d):
    return P.apply_mask(P.fov_mask(stars_of(spark, d), HALF)).select(*KEYS, "x", "y")


@query(f"WITH {_GA} SELECT o_orderkey, x, y, CASE WHEN {_IN} THEN mass ELSE 0 END AS mass FROM gas")
def fov_zero_mask(spark, d):
    return P.apply_mask(P.fov_mask(frame(spark, d, "gas"), HALF), "zero").select("o_orderkey", "x", "y", "mass")


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, vz AS v_los FROM stars")
def los_velocity(spark, d):
    return P.los_velocity(stars_of(spark, d), "z").select(*KEYS, "v_los")


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, vx FROM stars WHERE vx >= 0")
def wind_filter(spark, d):
    return P.drop_wind(stars_of(spark, d).withColumn("sft", F.col("vx"))).select(*KEYS, "vx")


@query(f"WITH {_PL} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, spaxel FROM p")
def spaxel_assign(spark, d):
    return placed(spark, d).select(*KEYS, "spaxel")


@query(f"WITH {_PL} SELECT galaxy_id, spaxel, count(*) AS n FROM p GROUP BY ALL")
def count_map(spark, d):
    return P.count_map(placed(spark, d))


@query(f"WITH {_PL} SELECT galaxy_id, spaxel, round(sum(mass), 2) AS mass FROM p GROUP BY ALL")
def mass_map(spark, d):
    return placed(spark, d).groupBy("galaxy_id", "spaxel").agg(r(F.sum("mass"), 2).alias("mass"))


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM stars WHERE l_suppkey = (SELECT min(l_suppkey) FROM stars)")
def halo_select(spark, d):
    return P_halo(stars_of(spark, d)).select(*KEYS)


def P_halo(df):
    return I.select_halo(df.withColumn("halo_id", F.col("l_suppkey")))


# ---- ingest and units
@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mass * 0.25e0 * 0.49e0, 6) AS mass, round(age * 0.5e0, 6) AS age FROM stars")
def unit_convert(spark, d):
    return rounded(I.to_physical(stars_of(spark, d), {"mass": (2.0, 2.0, 0.0), "age": (1.0, 0.0, 1.0)}, 0.5, 0.7).select(*KEYS, "mass", "age"), "mass", "age")


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(age / 1000e0, 9) AS age FROM stars")
def canonical_units(spark, d):
    return rounded(I.to_canonical_units(stars_of(spark, d), {"age": "Myr"}).select(*KEYS, "age"), "age", digits=9)


@query("SELECT l_suppkey AS galaxy_id, l_linenumber AS particle_id, l_extendedprice AS mass, l_tax AS metallicity, 0e0 AS age FROM lineitem")
def ingest_zero_fill(spark, d):
    raw = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("galaxy_id"), F.col("l_linenumber").alias("particle_id"), F.col("l_extendedprice").alias("GFM_InitialMass"), F.col("l_tax").alias("GFM_Metallicity"))
    mapping = {k: v for k, v in I.TNG_STARS.items() if v in ("mass", "metallicity", "age")}
    return I.ingest_snapshot(raw, mapping, missing="zero")


@query(f"WITH {_ST} SELECT galaxy_id, count(*) AS rows, count(*) - count(mass) AS mass_null, 0 AS mass_nan, count(*) FILTER (WHERE mass < 0) AS mass_negative, count(*) - count(vx) AS vx_null, 0 AS vx_nan, count(*) FILTER (WHERE vx < 0) AS vx_negative FROM stars GROUP BY galaxy_id")
def validate(spark, d):
    return I.value_report(stars_of(spark, d), ["mass", "vx"])


@query(f"WITH {_ST}, {_GA} SELECT 'stars' AS ptype, galaxy_id, count(*) AS n, round(sum(mass), 2) AS mass, count(age) AS aged FROM stars GROUP BY ALL UNION ALL SELECT 'gas', galaxy_id, count(*), round(sum(mass), 2), 0 FROM gas GROUP BY ALL")
def union_types(spark, d):
    s, g = frame(spark, d, "stars"), frame(spark, d, "gas")
    return P.union_types(s, g).groupBy("ptype", "galaxy_id").agg(F.count("*").alias("n"), r(F.sum("mass"), 2).alias("mass"), F.count("age").alias("aged"))


# ---- group operators
@query(f"WITH {_ST}, {_CEN}, b AS (SELECT galaxy_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM stars GROUP BY galaxy_id) SELECT b.*, a BETWEEN x_min AND x_max AND a / 2 BETWEEN y_min AND y_max AND 0 BETWEEN z_min AND z_max AS inside FROM b JOIN g USING (galaxy_id)")
def bounds_check(spark, d):
    s = stars_of(spark, d)
    return P.check_center(s, galaxies(s)).drop("center")


@query(f"WITH {_ST} SELECT galaxy_id, round(median(vx), 6) AS vx, round(median(vy), 6) AS vy, round(median(vz), 6) AS vz FROM stars WHERE {_R2} < 10 GROUP BY galaxy_id")
def central_velocity(spark, d):
    return rounded(P.central_velocity(stars_of(spark, d)), "vx", "vy", "vz")


_INSIDE = "b AS (SELECT galaxy_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM stars GROUP BY galaxy_id), i AS (SELECT a BETWEEN x0 AND x1 AND a / 2 BETWEEN y0 AND y1 AND 0 BETWEEN z0 AND z1 AS inside FROM b JOIN g USING (galaxy_id))"


@query(f"WITH {_ST}, {_CEN}, {_INSIDE}, m AS (SELECT s.* REPLACE (x - a AS x, y - a / 2 AS y) FROM stars AS s JOIN g USING (galaxy_id) WHERE CASE WHEN EXISTS (SELECT 1 FROM i WHERE NOT coalesce(inside, false)) THEN error('center outside the bounds') ELSE true END), v AS (SELECT galaxy_id, median(vx) AS mx, median(vy) AS my, median(vz) AS mz FROM m WHERE {_R2} < 10 GROUP BY galaxy_id) SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, round(y, 6) AS y, round(vx - mx, 6) AS vx, round(vz - mz, 6) AS vz FROM m JOIN v USING (galaxy_id)")
def center(spark, d):
    s = stars_of(spark, d)
    return rounded(P.center(s, galaxies(s)).select(*KEYS, "x", "y", "vx", "vz"), "x", "y", "vx", "vz")


@query(f"WITH {_ST} SELECT galaxy_id, round(sum(mass * (y * y + z * z)), 0) AS ixx, round(sum(mass * (x * x + z * z)), 0) AS iyy, round(sum(mass * (x * x + y * y)), 0) AS izz, round(-sum(mass * x * y), 0) AS ixy, round(-sum(mass * x * z), 0) AS ixz, round(-sum(mass * y * z), 0) AS iyz FROM stars WHERE {_R2} <= 5 GROUP BY galaxy_id")
def inertia_tensor(spark, d):
    s = stars_of(spark, d)
    return rounded(P.inertia_tensor(s, galaxies(s)), "ixx", "iyy", "izz", "ixy", "ixz", "iyz", digits=0)


@query(f"WITH {_ST}, c AS (SELECT galaxy_id, {_R2} AS r, sum(mass) OVER (PARTITION BY galaxy_id ORDER BY {_R2}) AS cum, sum(mass) OVER (PARTITION BY galaxy_id) AS total FROM stars) SELECT galaxy_id, round(min(r), 6) AS halfmassrad FROM c WHERE cum >= total / 2 GROUP BY galaxy_id")
def half_mass_radius(spark, d):
    return rounded(P.half_mass_radius(stars_of(spark, d)), "halfmassrad")


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, mass, round(sum(mass) OVER (PARTITION BY galaxy_id ORDER BY {_R2}, l_orderkey, l_linenumber, l_partkey, l_suppkey, mass), 2) AS running_mass FROM stars")
def running_mass(spark, d):
    out = P.running_mass(stars_of(spark, d), (*KEYS[1:], "mass"))
    return out.select(*KEYS, "mass", r(F.col("running_mass"), 2).alias("running_mass"))


@query(f"WITH {_ST}, l AS (SELECT galaxy_id, min(age) AS lo, max(age) AS hi FROM stars GROUP BY galaxy_id) SELECT galaxy_id, CAST(least(floor((age - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM stars JOIN l USING (galaxy_id) GROUP BY ALL")
def histogram(spark, d):
    return P.histogram(stars_of(spark, d), "age")


_RAW = f"{_ST}, raw AS (SELECT galaxy_id, l_orderkey, x, y, z, vx, vy, vz, mass * 1e-3 * 0.5e0 AS mass, metallicity, (l_linenumber - 2) / 6e0 AS a FROM stars), kept AS (SELECT * FROM raw WHERE a >= 0)"


def catalogue_of(s):
    return galaxies(s).withColumn("redshift", F.lit(0.1))


def raw_stars(s):
    return s.select("galaxy_id", F.col("l_orderkey").alias("particle_id"), F.array("x", "y", "z").alias("Coordinates"), F.array("vx", "vy", "vz").alias("Velocities"), (F.col("mass") * 1e-3).alias("GFM_InitialMass"), F.col("metallicity").alias("GFM_Metallicity"), ((F.col("l_linenumber") - 2) / 6.0).alias("GFM_StellarFormationTime"))


@query(f"WITH {_RAW}, g AS (SELECT galaxy_id, count(*) % 7 / 10e0 AS c FROM stars GROUP BY galaxy_id), m AS (SELECT kept.* REPLACE (x - c AS x, y - c / 2 AS y) FROM kept JOIN g USING (galaxy_id)), v AS (SELECT galaxy_id, median(vx) AS mx, median(vy) AS my, median(vz) AS mz FROM m WHERE {_R2} < 10 GROUP BY galaxy_id) SELECT galaxy_id, l_orderkey AS particle_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(vx - mx, 6) AS vx, round(vy - my, 6) AS vy, round(vz - mz, 6) AS vz, round(mass, 6) AS mass, metallicity, round({2 / 3 / math.sqrt(0.6925) * K.PLANCK15.hubble_time!r} * (asinh(sqrt({0.6925 / 0.3075!r})) - asinh(sqrt({0.6925 / 0.3075!r}) * pow(greatest(a, 1e-3), 1.5e0))), 1) AS age FROM m JOIN v USING (galaxy_id)")
def prepare(spark, d):
    """Raw star fields in the TNG layout, made of the particle view, to centred particles."""
    s = stars_of(spark, d)
    raw = raw_stars(s)
    out = jobs.prepare({"stars": raw}, catalogue_of(s), attributes={"stars": {"mass": (1.0, 0.0, 0.0)}}, scale_factor=0.5).stars
    return rounded(rounded(out, "x", "y", "z", "vx", "vy", "vz", "mass"), "age", digits=1)


@query(f"WITH {_RAW} SELECT galaxy_id, count(*) AS n, round(sum(mass), 3) AS mass, round(sum(x + y + z), 3) AS places, CASE WHEN galaxy_id IN (1, 2) THEN 1 ELSE 2 END AS written FROM kept GROUP BY galaxy_id")
def prepare_store(spark, d):
    """Galaxies 1 and 2 go to a store, then a second call asks for all: it adds the ones that are new, and reads them all."""
    s = stars_of(spark, d)
    options = {"attributes": {"stars": {"mass": (1.0, 0.0, 0.0)}}, "scale_factor": 0.5, "path": scratch(spark)}
    jobs.prepare({"stars": raw_stars(s)}, catalogue_of(s).where("galaxy_id in (1, 2)"), **options)
    jobs.prepare({"stars": raw_stars(s)}, catalogue_of(s), **options)
    store = GalaxyStore(spark, options["path"])
    place = I.vector_columns(store.read("stars"))
    sums = place.groupBy("galaxy_id").agg(F.count("*").alias("n"), r(F.sum("mass"), 3).alias("mass"), r(F.sum(F.col("x") + F.col("y") + F.col("z")), 3).alias("places"))
    return sums.join(store.manifest().select("galaxy_id", F.col("seq").cast("int").alias("written")), "galaxy_id")


@query("SELECT s_suppkey AS subhalo_id, s_acctbal AS mass, CAST(s_acctbal / 100 AS DOUBLE) AS cx, CAST(s_nationkey AS DOUBLE) AS cy, s_suppkey % 9 - 4e0 AS cz, 6 AS fields FROM supplier")
def catalogue_flatten(spark, d):
    """A subhalo catalogue with nested fields, made of the supplier table, to scalar fields and a center."""
    nested = [F.struct("s_suppkey").alias("related"), F.create_map("s_suppkey", "s_acctbal").alias("meta")]
    raw = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("subhalo_id"), F.col("s_acctbal").alias("mass"), (F.col("s_acctbal") / 100).cast("double").alias("pos_x"), F.col("s_nationkey").cast("double").alias("pos_y"), (F.col("s_suppkey") % 9 - 4.0).alias("pos_z"), *nested)
    flat = I.flatten_catalogue(raw)
    place = [F.element_at("center", k + 1).alias(c) for k, c in enumerate(("cx", "cy", "cz"))]
    return flat.select("subhalo_id", "mass", *place, F.lit(len(flat.columns)).alias("fields"))


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey AS particle_id, x, vz, mass * 1e-3 AS mass, 7 AS fields FROM stars")
def field_list(spark, d):
    """The default fields of the stars out of a wider raw table."""
    s = stars_of(spark, d).select("*")
    wide = raw_stars(s).withColumns({"Potential": F.lit(1.0), "SubfindHsml": F.lit(2.0)})
    kept = I.select_fields(wide, "stars")
    return kept.select("galaxy_id", "particle_id", F.element_at("Coordinates", 1).alias("x"), F.element_at("Velocities", 3).alias("vz"), F.col("GFM_InitialMass").alias("mass"), F.lit(len(kept.columns)).alias("fields"))


@query(f"WITH {_PL} SELECT galaxy_id, spaxel, row_number() OVER (PARTITION BY galaxy_id, spaxel ORDER BY z) AS place, z FROM p")
def sort_columns(spark, d):
    """Each spaxel's stars in the order in which they come, after the sort along the line of sight."""
    laid = P.sort_columns(placed(spark, d)).withColumn("_at", F.monotonically_increasing_id())
    return laid.select("galaxy_id", "spaxel", F.row_number().over(Window.partitionBy("galaxy_id", "spaxel").orderBy("_at")).alias("place"), "z")


_SYNTH = "(CAST('0x' || substr(md5(concat_ws(',', i, 5, {k})), 1, 13) AS BIGINT) / 4503599627370496e0)"


@query(f"SELECT 0 AS galaxy_id, i AS particle_id, {', '.join(f'round({_SYNTH.format(k=k)} * 200 - 100, 9) AS {c}' for k, c in enumerate(('x', 'y', 'z', 'vx', 'vy', 'vz')))}, 1e0 AS mass, round({_SYNTH.format(k=6)} * 0.0499e0 + 1e-4, 9) AS metallicity, round({_SYNTH.format(k=7)} * 13.8e0, 9) AS age FROM range(0, (SELECT count(*) FROM part)) AS q(i)")
def synth_galaxy(spark, d):
    """As many seeded particles as the part table has rows."""
    out = I.synth_galaxy(spark, spark.read.parquet(f"{d}/part.parquet").count(), seed=5)
    return rounded(out, "x", "y", "z", "vx", "vy", "vz", "metallicity", "age", digits=9)


# ---- geometry
_M = G.euler_matrix(30.0, 40.0, 50.0)
_ROT = ", ".join(f"round(x * {float(_M[0, j])!r} + y * {float(_M[1, j])!r} + z * {float(_M[2, j])!r}, 6) AS {c}" for j, c in enumerate("xyz"))


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ROT} FROM stars")
def euler_rotate(spark, d):
    return rounded(G.euler_rotate(stars_of(spark, d), 30.0, 40.0, 50.0).select(*KEYS, "x", "y", "z"), "x", "y", "z")


def _axes_sql(src: str) -> str:
    """Principal axes in closed form: eigenvalues of the symmetric 3 x 3 tensor by the cosine rule, vectors as cross products of
    two rows of (A - l) with the largest component positive, the third as the product of the first two."""
    vector = lambda k: f"SELECT *, ixy * iyz - ixz * (iyy - l{k}) AS a, ixz * ixy - (ixx - l{k}) * iyz AS b, (ixx - l{k}) * (iyy - l{k}) - ixy * ixy AS c FROM"
    signed = lambda k, t: f"SELECT * EXCLUDE (a, b, c), a * f{k} AS x{k}, b * f{k} AS y{k}, c * f{k} AS z{k} FROM (SELECT *, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN sign(a) WHEN abs(b) >= abs(c) THEN sign(b) ELSE sign(c) END / sqrt(a * a + b * b + c * c) AS f{k} FROM ({vector(k)} {t})) AS v{k}"
    tensor = f"SELECT galaxy_id, sum(mass * (y * y + z * z)) AS ixx, sum(mass * (x * x + z * z)) AS iyy, sum(mass * (x * x + y * y)) AS izz, -sum(mass * x * y) AS ixy, -sum(mass * x * z) AS ixz, -sum(mass * y * z) AS iyz FROM {src} WHERE {_R2} <= 5 GROUP BY galaxy_id"
    middle = f"SELECT *, (ixx + iyy + izz) / 3 AS q, sqrt((pow(ixx - (ixx + iyy + izz) / 3, 2) + pow(iyy - (ixx + iyy + izz) / 3, 2) + pow(izz - (ixx + iyy + izz) / 3, 2) + 2 * (ixy * ixy + ixz * ixz + iyz * iyz)) / 6) AS p FROM ({tensor}) AS t0"
    angle = f"SELECT *, acos(greatest(-1e0, least(1e0, ((ixx - q) * ((iyy - q) * (izz - q) - iyz * iyz) - ixy * (ixy * (izz - q) - iyz * ixz) + ixz * (ixy * iyz - (iyy - q) * ixz)) / (p * p * p) / 2))) / 3 AS phi FROM ({middle}) AS t1"
    values = f"SELECT *, q + 2 * p * cos(phi + {2 * math.pi / 3!r}) AS l1, q + 2 * p * cos(phi + {4 * math.pi / 3!r}) AS l2 FROM ({angle}) AS t2"
    both = signed(2, f"({signed(1, f'({values}) AS t3')}) AS t4")
    return f"ax_{src} AS (SELECT *, y1 * z2 - z1 * y2 AS x3, z1 * x2 - x1 * z2 AS y3, x1 * y2 - y1 * x2 AS z3 FROM ({both}) AS t5)"


def _turned_sql(src: str, *others: str) -> str:
    """Face-on coordinates of a particle table, with its other columns."""
    dot = lambda k, p: f"{p}x * x{k} + {p}y * y{k} + {p}z * z{k}"
    place = ", ".join(f"{dot(k + 1, 's.')} AS {c}" for k, c in enumerate("xyz"))
    return f"{_axes_sql(src)}, turned_{src} AS (SELECT s.galaxy_id, {', '.join(others)}, {place} FROM {src} AS s JOIN ax_{src} USING (galaxy_id))"


@query(f"WITH {_ST}, {_axes_sql('stars')} SELECT galaxy_id, {', '.join(f'round({c}{k}, 6) AS {c}{k}' for k in (1, 2, 3) for c in 'xyz')} FROM ax_stars")
def principal_axes(spark, d):
    s = stars_of(spark, d)
    axes = G.principal_axes(P.inertia_tensor(s, galaxies(s)))
    return axes.select("galaxy_id", *[r(F.element_at("axes", 3 * i + k)).alias(f"{c}{k}") for k in (1, 2, 3) for i, c in enumerate("xyz")])


_VT = ", ".join(f"s.vx * x{k} + s.vy * y{k} + s.vz * z{k} AS v{c}" for k, c in zip((1, 2, 3), "xyz"))


@query(f"WITH {_ST}, {_turned_sql('stars', *(f's.{k}' for k in KEYS[1:]), _VT)} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 5) AS x, round(z, 5) AS y, round(-y, 5) AS z, round(vx, 4) AS vx, round(vz, 4) AS vy, round(-vy, 4) AS vz FROM turned_stars")
def orient_edge_on(spark, d):
    s = stars_of(spark, d)
    out = G.orient(s, galaxies(s), "edge-on").select(*KEYS, "x", "y", "z", "vx", "vy", "vz")
    return rounded(rounded(out, "x", "y", "z", digits=5), "vx", "vy", "vz", digits=4)


def redshifts(spark, d):
    """A redshift for each galaxy, from its particle count."""
    return stars_of(spark, d).groupBy("galaxy_id").agg((0.05 + F.count("*") % 11 / 10.0).alias("redshift"))


_E = "sqrt(0.3075e0 * pow(1 + {z}, 3) + 0.6925e0)"
_Z = f"{_ST}, g AS (SELECT galaxy_id, 0.05e0 + count(*) % 11 / 10e0 AS redshift FROM stars GROUP BY galaxy_id)"
_TRAP = "WITH {base}, t AS (SELECT galaxy_id, redshift, redshift * i / {last}e0 AS z, i FROM g, range(0, {last} + 1) AS q(i)), f AS (SELECT *, 1 / {e}{w} AS f FROM t), s AS (SELECT galaxy_id, redshift, (z - lag(z) OVER o) * (f + lag(f) OVER o) / 2 AS a FROM f WINDOW o AS (PARTITION BY galaxy_id ORDER BY i)), n AS (SELECT galaxy_id, redshift, sum(a) AS a FROM s GROUP BY ALL)"
_CH = K.C_SPEED * 1e-5 / K.PLANCK15.h


@query(_TRAP.format(base=_Z, last=255, e=_E.format(z="z"), w="") + f" SELECT galaxy_id, round(redshift, 6) AS redshift, round(a * {_CH!r}, 5) AS comoving, round(a * {_CH!r} * (1 + redshift), 5) AS luminosity, round(a * {_CH!r} / (1 + redshift), 5) AS angular, round(5 * log10(a * {_CH!r} * (1 + redshift) * 1e5), 7) AS modulus, round(a * {_CH!r} / (1 + redshift) * {math.pi / 648000 * 1e3!r}, 7) AS kpc_per_arcsec FROM n")
def distance_table(spark, d):
    out = K.distance_columns(redshifts(spark, d))
    return out.select("galaxy_id", r(F.col("redshift")).alias("redshift"), *[r(F.col(c), 5).alias(c) for c in ("comoving", "luminosity", "angular")], *[r(F.col(c), 7).alias(c) for c in ("modulus", "kpc_per_arcsec")])


@query(_TRAP.format(base=_Z, last=511, e=_E.format(z="z"), w=" / (1 + z)") + f", u AS (SELECT i, pow(10, i * 3e0 / 511) - 1 AS z FROM range(0, 512) AS q(i)), v AS (SELECT i, z, 1 / {_E.format(z='z')} / (1 + z) AS f FROM u), y AS (SELECT sum(b) AS b FROM (SELECT (z - lag(z) OVER (ORDER BY i)) * (f + lag(f) OVER (ORDER BY i)) / 2 AS b FROM v)) SELECT galaxy_id, round(a * {K.PLANCK15.hubble_time!r}, 7) AS lookback, round(b * {K.PLANCK15.hubble_time!r}, 7) AS age_z0, round((b - a) * {K.PLANCK15.hubble_time!r}, 7) AS age FROM n, y")
def age_table(spark, d):
    return rounded(K.age_columns(redshifts(spark, d)).select("galaxy_id", "lookback", "age_z0", "age"), "lookback", "age_z0", "age", digits=7)


@query(_TRAP.format(base=_Z, last=255, e=_E.format(z="z"), w="") + f" SELECT galaxy_id, round(a * {_CH!r} / (1 + redshift) * {math.pi / 648000 * 1e3!r} * 5, 6) AS aperture_kpc, round(a * {_CH!r} / (1 + redshift) * {math.pi / 648000 * 1e3!r} * 5 / 25, 6) AS bin_kpc FROM n")
def spatial_grid(spark, d):
    return rounded(G.spatial_grid(redshifts(spark, d), 5.0, G.instrument_bins("MUSE")).select("galaxy_id", "aperture_kpc", "bin_kpc"), "aperture_kpc", "bin_kpc")


# closed form for a flat universe of matter and a constant
@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round({2 / 3 / math.sqrt(0.6925) * K.PLANCK15.hubble_time!r} * (asinh(sqrt({0.6925 / 0.3075!r})) - asinh(sqrt({0.6925 / 0.3075!r}) * pow(0.2e0 + l_linenumber / 10e0, 1.5e0))), 2) AS age FROM stars")
def stellar_age(spark, d):
    df = stars_of(spark, d).withColumn("a", 0.2 + F.col("l_linenumber") / 10.0)
    return K.stellar_age(df.drop("age"), "a").select(*KEYS, r(F.col("age"), 2).alias("age"))


# ---- cubes
@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(v, 6) AS v FROM cl")
def cube_sum(spark, d):
    return long_out(cube_of(spark, d))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(2 * v, 6) AS v FROM cl")
def add_cubes(spark, d):
    cube = cube_of(spark, d)
    return long_out(C.add_cubes(cube.unionByName(cube)))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, round(sum(v), 6) AS image FROM cl GROUP BY ALL")
def image(spark, d):
    return rounded(C.image(cube_of(spark, d)), "image")


@query(f"WITH {_SP} SELECT galaxy_id, k, round(sum(v), 6) AS v FROM cl GROUP BY ALL")
def total_spectrum(spark, d):
    return long_out(C.total_spectrum(cube_of(spark, d)).withColumn("spaxel", F.lit(0))).drop("spaxel")


@query(f"WITH {_SP} SELECT galaxy_id, k, round(sum(v), 6) AS v FROM cl WHERE sqrt(pow(spaxel % 5 - 2, 2) + pow(floor(spaxel / 5) - 2, 2)) <= 1.5 GROUP BY ALL")
def aperture_spectrum(spark, d):
    return long_out(C.aperture_spectrum(cube_of(spark, d), N, 2, 2, 1.5).withColumn("spaxel", F.lit(0))).drop("spaxel")


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, round(sum(v), 6) AS image FROM cl WHERE sqrt(pow(spaxel % 5 - 2, 2) + pow(floor(spaxel / 5) - 2, 2)) <= 2.5 GROUP BY ALL")
def aperture_semi(spark, d):
    inside = G.aperture(spark, "circular", N)
    return rounded(C.image(C.with_xy(cube_of(spark, d), N).join(F.broadcast(inside), ["x", "y"], "left_semi")), "image")


_HEX = f"{2 * 1.25 * 1.25 * math.sqrt(3)!r} - 1.25e0 * abs(floor(spaxel / 5) - 2) - {1.25 * math.sqrt(3)!r} * abs(spaxel % 5 - 2) >= 0 AND abs(spaxel % 5 - 2) < 2.5 AND abs(floor(spaxel / 5) - 2) < {1.25 * math.sqrt(3)!r}"


@query(f"WITH {_SP}, i AS (SELECT galaxy_id, spaxel, sum(v) AS image FROM cl GROUP BY ALL) SELECT 'square' AS kind, galaxy_id, spaxel, round(image, 6) AS image FROM i UNION ALL SELECT 'hexagonal', galaxy_id, spaxel, round(image, 6) FROM i WHERE {_HEX}")
def aperture_shapes(spark, d):
    images = C.with_xy(C.image(cube_of(spark, d)), N)
    cut = [images.join(G.aperture(spark, kind, N), ["x", "y"], "left_semi").withColumn("kind", F.lit(kind)) for kind in ("square", "hexagonal")]
    return rounded(cut[0].unionByName(cut[1]).select("kind", "galaxy_id", "spaxel", "image"), "image")


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k - 10 AS k, round(v, 6) AS v FROM cl WHERE k >= 10 AND k < 20")
def slice_wave(spark, d):
    return long_out(C.slice_wave(cube_of(spark, d), 10, 20))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(v, 6) AS v, 'mock_id' || galaxy_id || '_snap7_stars_subsetFalse' AS name, '{{}}' AS crval FROM cl".replace("{}", "4000.0"))
def cube_store(spark, d):
    """Cubes written by galaxy and read again, with two of their header keys."""
    path = scratch(spark)
    I.write_cube(cube_of(spark, d), {"SIM": "mock", "SNAPSHOT": 7}, path, N, 4000.0, 10.0, 0.2)
    cube, header = I.read_cube(spark, path)
    keys = header.groupBy("galaxy_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(c) for k, c in (("NAME", "name"), ("CRVAL3", "crval"))])
    return long_out(cube.withColumn("galaxy_id", F.col("galaxy_id").cast("long"))).join(keys.withColumn("galaxy_id", F.col("galaxy_id").cast("long")), "galaxy_id")


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k - 10 AS k, round(v, 6) AS v, round(sum(v) FILTER (WHERE k < 20) OVER (PARTITION BY galaxy_id, spaxel), 6) AS image FROM cl WHERE k >= 10 AND k < 27 QUALIFY k < 13")
def cube_store_slice(spark, d):
    """Of a cube stored in chunks of eight wavelengths: three wavelengths, and the image of ten."""
    path = scratch(spark)
    I.write_cube(cube_of(spark, d), {}, path, N, 4000.0, 10.0, 0.2, chunk=8)
    part = long_out(I.read_cube(spark, path, 10, 13)[0])
    return part.join(rounded(I.stored_image(spark, path, 10, 20), "image"), ["galaxy_id", "spaxel"]).withColumn("galaxy_id", F.col("galaxy_id").cast("long"))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(v, 6) AS v FROM cl")
def incremental_cube(spark, d):
    """Spectra that arrive in two parts, each summed by a query of its own that goes on from the other's state."""
    spectra, path = frame(spark, d, "spectra").select("galaxy_id", "spaxel", "flux", "vec_id"), scratch(spark)
    for k in (0, 1):
        spectra.where(F.col("vec_id") % 2 == k).drop("vec_id").write.mode("append").parquet(f"{path}/arrived")
        made = incremental.incremental_cube(incremental.arriving(spark, f"{path}/arrived", spectra.drop("vec_id").schema))
        incremental.keep_cube(made, f"{path}/cube", f"{path}/state").awaitTermination()
    return long_out(incremental.kept_cube(spark, f"{path}/cube"))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(v, 6) AS v FROM cl WHERE spaxel = 1 + 5 * 3")
def spectrum_at(spark, d):
    return long_out(C.spectrum_at(cube_of(spark, d), N, 1, 3))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, CAST(floor(spaxel / 5) AS INT) AS y, CAST(spaxel % 5 AS INT) AS x FROM (SELECT DISTINCT galaxy_id, spaxel FROM cl) WHERE sqrt(pow(spaxel % 5 - 1, 2) + pow(floor(spaxel / 5) - 2, 2)) <= 2")
def within_radius(spark, d):
    return C.within_radius(cube_of(spark, d), N, 1, 2, 2.0).select("galaxy_id", "spaxel", "y", "x")


@query(f"WITH {_SP} SELECT vec_id, k, round(v * (1 + vec_id % 3), 6) AS v FROM sl")
def scale_by_mass(spark, d):
    df = C.scale_by_mass(frame(spark, d, "spectra").withColumn("mass", 1.0 + F.col("vec_id") % 3))
    return df.select("vec_id", F.posexplode("flux").alias("k", "v")).select("vec_id", "k", r(F.col("v")).alias("v"))


_KER = C.gaussian_kernel(3, 3, 1.0)
_KERSQL = ", ".join(f"({a}, {b}, {w!r})" for a, b, w in _KER)


@query(f"WITH {_SP}, ker(dy, dx, w) AS (VALUES {_KERSQL}), m AS (SELECT galaxy_id, spaxel % 5 + dx AS x, floor(spaxel / 5) + dy AS y, k, v * w AS v FROM cl, ker) SELECT galaxy_id, CAST(x + 5 * y AS INT) AS spaxel, k, round(sum(v), 6) AS v FROM m WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 GROUP BY ALL")
def psf_convolve(spark, d):
    return long_out(C.convolve_psf(cube_of(spark, d), N, 3, 1.0))


_TAPS = C.lsf_taps(2.0, 1.0)
_TAPSQL = ", ".join(f"({k - 12}, {w!r})" for k, w in enumerate(_TAPS))


@query(f"WITH {_SP}, ker(o, w) AS (VALUES {_TAPSQL}) SELECT galaxy_id, spaxel, k + o AS k, round(sum(v * w), 6) AS v FROM cl, ker WHERE k + o BETWEEN 0 AND 63 GROUP BY ALL")
def lsf_smooth(spark, d):
    return long_out(C.convolve_lsf(cube_of(spark, d), 2.0, 1.0))


@query(f"WITH {_SP}, i AS (SELECT galaxy_id, spaxel, sum(v) AS s FROM cl GROUP BY ALL), m AS (SELECT galaxy_id, median(s) FILTER (WHERE s > 0) AS m FROM i GROUP BY ALL) SELECT galaxy_id, spaxel, round(CASE WHEN s > 0 THEN sqrt(m) / 2 / sqrt(s) ELSE 0 END, 8) AS snr FROM i JOIN m USING (galaxy_id)")
def snr_map(spark, d):
    return rounded(C.snr_map(cube_of(spark, d), 2.0), "snr", digits=8)


def _draw_sql(*keys: str) -> str:
    """The uniform number of some keys: 52 bits of their MD5."""
    return f"(CAST('0x' || substr(md5(concat_ws(',', {', '.join(keys)})), 1, 13) AS BIGINT) / 4503599627370496e0)"


def _noisy_sql(cube: str, sn: float, seed: int) -> str:
    """v with normal noise, from a table (galaxy_id, spaxel, k, v)."""
    u, w = _draw_sql("galaxy_id", "spaxel", "k", str(seed)), _draw_sql("galaxy_id", "spaxel", "k", str(seed), "1")
    image = f"SELECT galaxy_id, spaxel, sum(v) AS s FROM {cube} GROUP BY ALL"
    return f"SELECT galaxy_id, spaxel, k, v + v * sqrt(-2 * ln(1 - {u})) * cos({2 * math.pi!r} * {w}) * CASE WHEN s > 0 THEN sqrt(m) / {sn!r} / sqrt(s) ELSE 0 END AS v FROM {cube} JOIN ({image}) AS i USING (galaxy_id, spaxel) JOIN (SELECT galaxy_id, median(s) FILTER (WHERE s > 0) AS m FROM ({image}) AS i2 GROUP BY galaxy_id) AS md USING (galaxy_id)"


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(v, 6) AS v FROM ({_noisy_sql('cl', 2.0, 0)})")
def noise(spark, d):
    return long_out(C.add_noise(cube_of(spark, d), 2.0))


@query(f"WITH {_SP}, i AS (SELECT galaxy_id, spaxel, sum(v) AS image FROM cl GROUP BY ALL) SELECT galaxy_id, spaxel, round((image - min(image) OVER w) / (max(image) OVER w - min(image) OVER w), 8) AS scaled FROM i WINDOW w AS (PARTITION BY galaxy_id)")
def minmax_normalise(spark, d):
    return C.minmax_normalise(C.image(cube_of(spark, d))).select("galaxy_id", "spaxel", r(F.col("scaled"), 8).alias("scaled"))


# ---- curves and spectra
def curves(spark, d):
    """Two filter curves over parts of the table: bands of the mean price by brand digit."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select((F.col("p_partkey") % 2).alias("b"), (F.col("p_partkey") % 8 * 9.0).alias("wavelength")).distinct().select(F.concat(F.lit("band/set."), F.col("b")).alias("filter_id"), "wavelength", (0.1 + F.col("wavelength") / 80.0 + F.col("b") / 10.0).alias("transmission"))


_CV = "cv AS (SELECT DISTINCT 'band/set.' || (p_partkey % 2) AS filter_id, p_partkey % 8 * 9e0 AS w, 0.1e0 + p_partkey % 8 * 9e0 / 80e0 + p_partkey % 2 / 10e0 AS t FROM part), rs AS (SELECT filter_id, k, CASE WHEN hi IS NULL THEN tl WHEN lo IS NULL THEN th ELSE tl + (th - tl) * (k - lo) / nullif(hi - lo, 0) END AS t0, tl, hi, lo FROM (SELECT f.filter_id, k, (SELECT max(w) FROM cv WHERE cv.filter_id = f.filter_id AND w <= k) AS lo, (SELECT min(w) FROM cv WHERE cv.filter_id = f.filter_id AND w > k) AS hi, (SELECT arg_max(t, w) FROM cv WHERE cv.filter_id = f.filter_id AND w <= k) AS tl, (SELECT arg_min(t, w) FROM cv WHERE cv.filter_id = f.filter_id AND w > k) AS th FROM (SELECT DISTINCT filter_id FROM cv) AS f, range(0, 64) AS q(k)))"


@query(f"WITH {_CV} SELECT filter_id, k, round(t0, 8) AS response FROM rs")
def interp_curve(spark, d):
    points = spark.range(64).select(F.col("id").alias("k"), F.col("id").cast("double").alias("w"))
    return S.interp_curve(points, curves(spark, d), "w").select("filter_id", "k", r(F.col("response"), 8).alias("response"))


@query(f"WITH {_SP}, {_CV}, pr AS (SELECT galaxy_id, spaxel, filter_id, cl.k, v * t0 AS v FROM cl JOIN rs ON rs.k = cl.k) SELECT galaxy_id, spaxel, filter_id, round(sum(a), 6) AS image FROM (SELECT galaxy_id, spaxel, filter_id, (v + lag(v) OVER (PARTITION BY galaxy_id, spaxel, filter_id ORDER BY k)) / 2 AS a FROM pr) GROUP BY ALL")
def trapezoid_photometry(spark, d):
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
    return rounded(S.photometry(cube_of(spark, d), curves(spark, d), wave), "image")


@query("SELECT filter_id, min(w) AS wave_min, max(w) AS wave_max, count(*) AS points FROM (SELECT DISTINCT 'band/set.' || (p_partkey % 2) AS filter_id, p_partkey % 8 * 9e0 AS w FROM part) GROUP BY filter_id")
def filter_catalogue(spark, d):
    return I.filter_catalogue(I.load_filters(curves(spark, d), "band", "set")).select("filter_id", "wave_min", "wave_max", "points")


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(vz / 299792.458e0), 12) AS factor, round(5000e0 * 1.1e0 * exp(vz / 299792.458e0), 6) AS wave FROM stars")
def doppler(spark, d):
    factor = S.doppler_factor(F.col("vz"))
    df = stars_of(spark, d).withColumn("w", S.redshift_wave(F.array(F.lit(5000.0)), 0.1))
    return df.select(*KEYS, r(factor, 12).alias("factor"), r(F.get("w", F.lit(0)) * factor).alias("wave"))


_TG = "tg AS (SELECT i, 1.5e0 + 2 * i AS t FROM range(0, 30) AS q(i))"


@query(f"WITH {_SP}, {_TG}, n AS (SELECT a.vec_id, i, t, a.v + (b.v - a.v) * (t - floor(t)) AS v FROM tg JOIN sl AS a ON a.k = floor(t) JOIN sl AS b ON b.k = a.k + 1 AND b.vec_id = a.vec_id), o AS (SELECT vec_id, sum(v) FILTER (WHERE k BETWEEN 1.5 AND 59.5) AS o FROM sl GROUP BY 1), w AS (SELECT vec_id, sum(v * 2) FILTER (WHERE i > 0) AS w FROM n GROUP BY 1) SELECT vec_id, i AS k, round(CASE WHEN w = 0 THEN 0 ELSE v * o / w END, 8) AS v FROM n JOIN o USING (vec_id) JOIN w USING (vec_id)")
def resample_spectrum(spark, d):
    out = S.resample(frame(spark, d, "spectra"), np.arange(64.0), 1.5 + 2 * np.arange(30.0), ["vec_id"])
    return out.select("vec_id", F.posexplode("flux").alias("k", "v")).select("vec_id", "k", r(F.col("v"), 8).alias("v"))


@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mass * {S.LSOL_TO_ERG / S.MPC_TO_CM**2 / (4 * math.pi)!r} / 10000e0 / 1.5e0 * 1e20, 5) AS flux FROM stars")
def luminosity_to_flux(spark, d):
    return stars_of(spark, d).select(*KEYS, r(S.luminosity_to_flux(F.col("mass"), 100.0, 0.5) * 1e20, 5).alias("flux"))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(coalesce(v - lag(v) OVER (PARTITION BY galaxy_id, spaxel ORDER BY k), 0), 6) AS diff FROM cl")
def adjacent_diff(spark, d):
    return S.adjacent_diff(C.to_long(cube_of(spark, d)), "v", ["galaxy_id", "spaxel"], "k").select("galaxy_id", "spaxel", "k", r(F.col("diff")).alias("diff"))


@query(f"WITH {_SP} SELECT galaxy_id, spaxel, k, round(sum(a) OVER (PARTITION BY galaxy_id, spaxel ORDER BY k), 6) AS integral FROM (SELECT galaxy_id, spaxel, k, coalesce((v + lag(v) OVER (PARTITION BY galaxy_id, spaxel ORDER BY k)) / 2, 0) AS a FROM cl)")
def cumulative_trapezoid(spark, d):
    long = C.to_long(cube_of(spark, d))
    return S.cumulative_trapezoid(long, "k", "v", ["galaxy_id", "spaxel"]).select("galaxy_id", "spaxel", "k", r(F.col("integral")).alias("integral"))


# A template grid made of the table's own spectra: metallicity node = vec_id % 4, age node = vec_id / 4 % 6, summed.
def grid_frame(spark, d):
    base = frame(spark, d, "spectra").select((F.col("vec_id") % 4).cast("long").alias("galaxy_id"), (F.floor(F.col("vec_id") / 4) % 6).cast("int").alias("spaxel"), "flux")
    return C.accumulate_cube(base).select(F.col("galaxy_id").cast("int").alias("met_idx"), F.col("spaxel").alias("age_idx"), (F.col("galaxy_id") * 0.02).alias("metallicity"), (F.col("spaxel") * 2.5).alias("age"), "flux")


_GR = f"{_SP}, gr AS (SELECT vec_id % 4 AS m, floor(vec_id / 4) % 6 AS a, k, sum(v) AS v FROM sl GROUP BY ALL)"


@query(f"WITH {_GR} SELECT CAST(m AS INT) AS met_idx, CAST(a AS INT) AS age_idx, m * 0.02e0 AS metallicity, round(pow(10, a / 10e0), 9) AS age, k, round(v, 6) AS v FROM gr")
def template_grid(spark, d):
    """A dense grid (arrays of metallicities and log ages, nested fluxes) to a row for each node."""
    lines = grid_frame(spark, d).groupBy("met_idx").agg(F.sort_array(F.collect_list(F.struct("age_idx", "flux"))).alias("line"))
    dense = lines.agg(F.sort_array(F.collect_list(F.struct("met_idx", "line"))).alias("g")).select(F.transform("g", lambda m: m["met_idx"] * 0.02).alias("metallicity"), F.transform(F.get("g", F.lit(0))["line"], lambda a: a["age_idx"] / 10.0).alias("age"), F.transform("g", lambda m: F.transform(m["line"], lambda a: a["flux"])).alias("flux"))
    rows = I.load_template_grid(dense, ("age",))
    return rows.select("met_idx", "age_idx", "metallicity", r(F.col("age"), 9).alias("age"), F.posexplode("flux").alias("k", "v")).withColumn("v", r(F.col("v")))


@query(f"WITH {_GR} SELECT CAST(m AS INT) AS met_idx, CAST(a AS INT) AS age_idx, round(m * 0.02e0, 9) AS metallicity, a * 2.5e0 AS age, k, 3000e0 + 2.5e0 * (k - 1) AS wave, round(v * CASE WHEN (6 * m + a) % 3 = 0 THEN 1 ELSE (6 * m + a) % 3 END, 6) AS v FROM gr")
def template_cards(spark, d):
    """Header cards (names with age and metallicity, mass-to-light ratios) and flux rows to a grid, with its wavelengths."""
    nodes = grid_frame(spark, d).withColumn("idx", F.col("met_idx") * 6 + F.col("age_idx"))
    name = F.concat(F.lit("ssp_"), F.col("age").cast("string"), F.lit("Gyr_z"), F.lpad((F.col("met_idx") * 200).cast("string"), 4, "0"))
    cards = nodes.select(F.concat(F.lit("NAME"), "idx").alias("key"), name.alias("value")).unionByName(nodes.select(F.concat(F.lit("NORM"), "idx").alias("key"), (F.col("idx") % 3).cast("string").alias("value")))
    grid = I.load_template_cards(cards, nodes.select("idx", "flux")).withColumn("waves", I.template_wave(3000.0, 2.5, 2.0, 64))
    long = grid.select("met_idx", "age_idx", r(F.col("metallicity"), 9).alias("metallicity"), "age", "waves", F.posexplode("flux").alias("k", "v"))
    return long.select("met_idx", "age_idx", "metallicity", "age", "k", F.get("waves", F.col("k")).alias("wave"), r(F.col("v")).alias("v"))


_CELLS = "least(greatest(floor(metallicity / 0.02e0 + 1e-9), 0), 2) AS i, least(greatest(floor(age / 2.5e0), 0), 4) AS j, (metallicity - i * 0.02e0) / 0.02e0 AS s, (age - j * 2.5e0) / 2.5e0 AS t, metallicity <= 0.06e0 AND age <= 12.5e0 AS inside"


def _lookup_sql(method: dict) -> str:
    """Each star's spectrum from the nodes around it, as its sum and first moment. Cubic: Hermite with slopes from the two
    neighbours, one-sided at the ends of an axis of `last` + 1 equal steps."""

    def weight(node, i, t, last):
        if "nearest" in method:
            return f"CASE WHEN {node} = {i} + CASE WHEN {t} > 0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END"
        if "cubic" not in method:
            return f"CASE {node} - {i} WHEN 0 THEN 1 - {t} WHEN 1 THEN {t} ELSE 0 END"
        h00, h10, h01, h11 = f"(2 * {t} * {t} * {t} - 3 * {t} * {t} + 1)", f"({t} * {t} * {t} - 2 * {t} * {t} + {t})", f"(3 * {t} * {t} - 2 * {t} * {t} * {t})", f"({t} * {t} * {t} - {t} * {t})"
        low, high = f"CASE WHEN {i} = 0 THEN 1e0 ELSE 0.5e0 END", f"CASE WHEN {i} = {last - 1} THEN 1e0 ELSE 0.5e0 END"
        return f"""CASE {node} - {i} WHEN -1 THEN -0.5e0 * {h10}
            WHEN 0 THEN {h00} - CASE WHEN {i} = 0 THEN {h10} ELSE 0 END - ({high}) * {h11}
            WHEN 1 THEN {h01} + ({low}) * {h10} + CASE WHEN {i} = {last - 1} THEN {h11} ELSE 0 END
            WHEN 2 THEN 0.5e0 * {h11} ELSE 0 END"""

    keys = "galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, metallicity, age"
    nodes = "tot AS (SELECT m, a, sum(v) AS v0, sum(v * k) AS v1 FROM gr GROUP BY ALL)"
    total = lambda v: f"CASE WHEN bool_and(inside) THEN sum({v} * ({weight('tot.m', 'i', 's', 3)}) * ({weight('tot.a', 'j', 't', 5)})) ELSE 0 END"
    return f"WITH {_ST}, {_GR}, {nodes}, c AS (SELECT {keys}, mass, row_number() OVER () AS id, {_CELLS} FROM stars), e AS (SELECT {keys}, id, {total('v0')} AS total, {total('v1')} AS moment FROM c JOIN tot ON tot.m BETWEEN i - 1 AND i + 2 AND tot.a BETWEEN j - 1 AND j + 2 GROUP BY ALL) SELECT {keys}, round(total, 4) AS total, round(moment, 2) AS moment FROM e"


def _lookup(spark, d, method: str, **options):
    keys = [*KEYS, "metallicity", "age"]
    out = S.lookup_template(stars_of(spark, d), grid_frame(spark, d), keys, method, **options)
    moment = F.aggregate(F.transform("flux", lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    return out.select(*keys, r(C.array_total("flux"), 4).alias("total"), r(moment, 2).alias("moment"))


@query(_lookup_sql({}))
def template_lookup_linear(spark, d):
    return _lookup(spark, d, "linear")


@query(_lookup_sql({"nearest": True}))
def template_lookup_nearest(spark, d):
    return _lookup(spark, d, "nearest")


@query(_lookup_sql({"cubic": True}))
def template_lookup_cubic(spark, d):
    return _lookup(spark, d, "cubic")


@query(_lookup_sql({"cubic": True}))
def template_lookup_cells(spark, d):
    """The grid is not broadcast: stars come to its cells."""
    return _lookup(spark, d, "cubic", limit=0, stars_a_cell=1000)


# ---- dust
_OH = "(12 + log10(o_frac / (16 * h_frac)))"
_DG = f"CASE WHEN {_OH} > 8.1e0 THEN pow(10, -(2.21e0 + 1.0e0 * (8.69e0 - {_OH}))) ELSE pow(10, -(0.96e0 + 3.1e0 * (8.69e0 - {_OH}))) END"
_AV = 3 * math.pi * D.MSUN_G / D.KPC_CM**2 / (0.4 * math.log(10) * 5448.0 * 1e-8 * 3.5)


@query(f"WITH {_GA} SELECT o_orderkey, round({_OH}, 8) AS oh, round({_DG}, 10) AS dg, round(mass * {_DG} * {_AV!r} * 1e3, 6) AS av FROM gas")
def dust_to_gas(spark, d):
    oh = D.oxygen_abundance(F.col("o_frac"), F.col("h_frac"))
    dg = D.dust_to_gas(oh)
    return frame(spark, d, "gas").select("o_orderkey", r(oh, 8).alias("oh"), r(dg, 10).alias("dg"), r(D.visual_extinction(F.col("mass") * dg) * 1e3).alias("av"))


def _fit_sql(a: float, alpha: float) -> str:
    return f"pow(10, -({a!r} + {alpha!r} * (8.69e0 - {_OH})))"


@query(f"WITH {_GA} SELECT o_orderkey, round({_fit_sql(2.21, 1.62)}, 10) AS free_mw, round({_fit_sql(2.21, 2.02)}, 10) AS free_z, round(CASE WHEN {_OH} > 7.96e0 THEN {_fit_sql(2.21, 1.0)} ELSE {_fit_sql(0.68, 3.08)} END, 10) AS broken_mw FROM gas")
def dust_to_gas_models(spark, d):
    oh, free = D.oxygen_abundance(F.col("o_frac"), F.col("h_frac")), "power law slope free"
    return frame(spark, d, "gas").select("o_orderkey", r(D.dust_to_gas(oh, free, "MW"), 10).alias("free_mw"), r(D.dust_to_gas(oh, free, "Z"), 10).alias("free_z"), r(D.dust_to_gas(oh, xco="MW"), 10).alias("broken_mw"))


@query(f"WITH {_PG} SELECT galaxy_id, spaxel, o_orderkey, round(sum(mass) OVER (PARTITION BY galaxy_id, spaxel ORDER BY z, o_orderkey), 2) AS c FROM pg")
def column_density(spark, d):
    out = D.column_density(placed(spark, d, gas=True), "mass", order=("z", "o_orderkey"))
    return out.select("galaxy_id", "spaxel", "o_orderkey", r(F.col("column"), 2).alias("c"))


_ASOF = f"WITH {_PL}, {_PG}, cg AS (SELECT galaxy_id, spaxel, z, sum(mass) OVER (PARTITION BY galaxy_id, spaxel ORDER BY z, o_orderkey) AS v FROM pg), u AS (SELECT galaxy_id, spaxel, z, v, 0 AS t, NULL AS l_orderkey, NULL AS l_linenumber, NULL AS l_partkey, NULL AS l_suppkey FROM cg UNION ALL SELECT galaxy_id, spaxel, z, NULL, 1, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p), b AS (SELECT *, max(CASE WHEN t = 0 THEN z END) OVER w1 AS z0, max(v) OVER w1 AS v0, min(CASE WHEN t = 0 THEN z END) OVER w2 AS z1, min(v) OVER w2 AS v1 FROM u WINDOW w1 AS (PARTITION BY galaxy_id, spaxel ORDER BY z, t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY galaxy_id, spaxel ORDER BY z, t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_AV!r} * CASE WHEN z0 IS NULL AND z1 IS NULL THEN 0 WHEN z0 IS NULL THEN v1 WHEN z1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (z - z0) / (z1 - z0) END, 6) AS av FROM b WHERE t = 1"


def _asof(spark, d, **options):
    found = asof_sum(placed(spark, d), placed(spark, d, gas=True), "mass", ties=("o_orderkey",), **options)
    return found.select(*KEYS, r(D.visual_extinction(F.col("asof"))).alias("av"))


@query(_ASOF)
def asof_extinction(spark, d):
    return _asof(spark, d)


@query(_ASOF)
def asof_extinction_whole(spark, d):
    """Every spaxel in one piece."""
    return _asof(spark, d, split=False)


@query(_ASOF)
def asof_extinction_pieces(spark, d):
    """Spaxels cut into pieces of about 50 rows."""
    return _asof(spark, d, rows_a_piece=50)


def numbers(spark, d, scale: float):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (0.31 + F.col("p_partkey") % 400 / scale).alias("x"))


_Y = "(x - 1.82e0)"
_POLY = lambda cs, y: " + ".join(f"{c!r} * pow({y}, {k})" for k, c in enumerate(cs))


@query(f"WITH n AS (SELECT p_partkey, 0.31e0 + p_partkey % 400 / 40e0 AS x FROM part) SELECT p_partkey, round(x, 8) AS x, round(CASE WHEN x < 1.1 THEN 0.574e0 * pow(x, 1.61e0) - 0.527e0 * pow(x, 1.61e0) / 3.1e0 WHEN x < 3.3 THEN {_POLY(D.CCM_OPT_A, _Y)} + ({_POLY(D.CCM_OPT_B, _Y)}) / 3.1e0 WHEN x <= 8 THEN 1.752e0 - 0.316e0 * x - 0.104e0 / (pow(x - 4.67e0, 2) + 0.341e0) + CASE WHEN x >= 5.9 THEN -0.04473e0 * pow(x - 5.9e0, 2) - 0.009779e0 * pow(x - 5.9e0, 3) ELSE 0 END + (-3.09e0 + 1.825e0 * x + 1.206e0 / (pow(x - 4.62e0, 2) + 0.263e0) + CASE WHEN x >= 5.9 THEN 0.2130e0 * pow(x - 5.9e0, 2) + 0.1207e0 * pow(x - 5.9e0, 3) ELSE 0 END) / 3.1e0 WHEN x <= 10 THEN {_POLY(D.CCM_FUV_A, '(x - 8e0)')} + ({_POLY(D.CCM_FUV_B, '(x - 8e0)')}) / 3.1e0 ELSE 0 END, 7) AS k FROM n")
def extinction_ccm89(spark, d):
    return numbers(spark, d, 40.0).select("p_partkey", r(F.col("x"), 8).alias("x"), r(D.ccm89(F.col("x")), 7).alias("k"))


def _g23_sql() -> str:
    step = lambda lo, hi: f"(pow(least(1e0, greatest(0e0, (x - {lo}) / ({hi} - {lo}))), 2) * (3 - 2 * least(1e0, greatest(0e0, (x - {lo}) / ({hi} - {lo})))))"
    dr = lambda x, a, c, g: f"({a} * pow({g} / {c}, 2) / (pow({x} / {c} - {c} / {x}, 2) + pow({g} / {c}, 2)))"
    opt = lambda p: "(" + _POLY(p[0], "(1 / x)") + " + " + " + ".join(dr("(1 / x)", *k) for k in p[1]) + ")"
    # Fixed values of the published far-ultraviolet term: 5.9, 0.5392, 0.05644.
    fm = lambda p: f"({p[0]} + {p[1]} / x + {p[2]} / (x * x) / (pow(1 / (x * x) - {p[4]} * {p[4]}, 2) + {p[5]} * {p[5]} / (x * x)) + {p[3]} * (0.5392e0 * pow(greatest(1 / x - 5.9e0, 0), 2) + 0.05644e0 * pow(greatest(1 / x - 5.9e0, 0), 3)))"
    s = D.G23_IR
    m = step(s["centre"] - s["width"] / 2, s["centre"] + s["width"] / 2)
    ratio = s["centre"] ** -s["alpha"] / s["centre"] ** -s["alpha2"]
    ir_a = f"({s['scale']} * pow(x, -{s['alpha']}) * (1 - {m}) + {s['scale'] * ratio!r} * pow(x, -{s['alpha2']}) * {m} + " + " + ".join(dr("x", a, c, f"(2 * {g} / (1 + exp({t} * (x - {c}))))") for a, c, g, t in s["silicates"]) + ")"
    ir_b = f"({D.G23_IR_B[0]!r} * pow(x, {-D.G23_IR_B[1]!r}))"
    pick = lambda ir, o, u: f"CASE WHEN x < 0.3 THEN {u} WHEN x <= 0.33 THEN (1 - {step(0.3, 0.33)}) * {u} + {step(0.3, 0.33)} * {o} WHEN x < 0.9 THEN {o} WHEN x <= 1.1 THEN (1 - {step(0.9, 1.1)}) * {o} + {step(0.9, 1.1)} * {ir} ELSE {ir} END"
    return f"({pick(ir_a, opt(D.G23_OPT_A), fm(D.G23_UV_A))}) + ({pick(ir_b, opt(D.G23_OPT_B), fm(D.G23_UV_B))}) * (1 / 4.0e0 - 1 / 3.1e0)"


_X23 = "WITH n AS (SELECT p_partkey, 0.1e0 * pow(1.014e0, p_partkey % 400) AS x FROM part)"


@query(f"{_X23} SELECT p_partkey, round({_g23_sql()}, 7) AS k FROM n")
def extinction_g23(spark, d):
    n = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (0.1 * F.pow(F.lit(1.014), F.col("p_partkey") % 400)).alias("x"))
    return n.select("p_partkey", r(D.gordon23(F.col("x"), 4.0), 7).alias("k"))


@query(f"WITH {_SP} SELECT vec_id, k, round(v * pow(10, -0.4e0 * (vec_id % 5 / 4e0) * (0.5e0 + k / 64e0)), 8) AS v FROM sl")
def extinguish(spark, d):
    curve = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 0.5 + i / 64.0)
    out = D.attenuate(frame(spark, d, "spectra").withColumn("av", F.col("vec_id") % 5 / 4.0), curve)
    return out.select("vec_id", F.posexplode("flux").alias("k", "v")).select("vec_id", "k", r(F.col("v"), 8).alias("v"))


@query("SELECT p_partkey, round(pow(10, -0.4e0 * pow(0.31e0 + p_partkey % 400 / 600e0, 1.61e0) * (0.574e0 - 0.527e0 / 3.1e0) * 3.1e0 * p_size / 50e0), 9) AS kept FROM part")
def extinguish_ebv(spark, d):
    """Transmission by colour excess, on the infrared branch of the curve."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", (0.31 + F.col("p_partkey") % 400 / 600.0).alias("x"))
    return parts.select("p_partkey", r(D.extinguish(D.ccm89(F.col("x")), ebv=F.col("p_size") / 50.0), 9).alias("kept"))


# ---- samples, generators and jobs
@query(f"WITH {_ST} SELECT galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY galaxy_id ORDER BY md5(concat_ws(',', 42, l_orderkey, l_linenumber, l_partkey, l_suppkey, mass)), l_orderkey, l_linenumber, l_partkey, l_suppkey, mass) AS n FROM stars) WHERE n <= 100")
def subset(spark, d):
    return P.subset(stars_of(spark, d), 100, key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mass")).select(*KEYS)


def _snapshot(spark, d):
    s, g = frame(spark, d, "stars"), frame(spark, d, "gas")
    g = g.withColumns({c: F.lit(0.0) for c in ("vx", "vy", "vz")})
    galaxy = galaxies(s).withColumns({"redshift": 0.01 + F.col("galaxy_id") / 1000.0, "half": F.lit(HALF) - F.col("galaxy_id") / 4.0})
    return jobs.Snapshot(galaxy, s, g)


# Redshift and field of view are the galaxy's own.
_JOB = {"wave": 4000 + 10 * np.arange(64.0), "target": 4100 + 8 * np.arange(40.0), "half_size": "half", "n": N, "z": "redshift", "psf": (3, 0.6), "lsf": 10.0, "noise": (2.0, "normal", 3), "method": "linear"}


def _job_sql(dusty: bool, stars: str = _ST, gas: str = _GA) -> str:
    """Face-on particles of each galaxy's own axes, placed, looked up, resampled, summed, smoothed, with noise. stars, gas: the
    SQL of the particle tables."""
    half = "(8e0 - galaxy_id / 4e0)"
    cell = lambda c: f"least(greatest(floor(({c} + {half}) / (2 * {half} / 5)), 0), 4)"
    inside = f"x BETWEEN -{half} AND {half} AND y BETWEEN -{half} AND {half}"
    placed_as = f"CAST({cell('x')} + 5 * {cell('y')} AS INT) AS spaxel"
    parts = [stars, _GR, _turned_sql("stars", "mass", "metallicity", "age", "s.vx * x3 + s.vy * y3 + s.vz * z3 AS vz")]
    parts.append(f"st AS (SELECT *, row_number() OVER () AS id, {placed_as}, exp(vz / 299792.458e0) * (1 + (0.01e0 + galaxy_id / 1000e0)) AS f FROM turned_stars WHERE {inside})")
    if dusty:
        parts += [gas, _turned_sql("gas", "mass", "h_frac", "o_frac")]
        parts.append(f"gp AS (SELECT *, {placed_as}, CASE WHEN {inside} THEN mass ELSE 0 END * {_DG} / pow(2 * {half} / 5, 2) AS sd FROM turned_gas)")
        parts.append(f"cg AS (SELECT galaxy_id, spaxel, z, sum(sd) OVER (PARTITION BY galaxy_id, spaxel ORDER BY z) * {_AV!r} AS v FROM gp)")
        parts.append("un AS (SELECT galaxy_id, spaxel, z, v, 0 AS t, NULL AS id FROM cg UNION ALL SELECT galaxy_id, spaxel, z, NULL, 1, id FROM st)")
        parts.append("bk AS (SELECT *, max(CASE WHEN t = 0 THEN z END) OVER w1 AS z0, max(v) OVER w1 AS v0, min(CASE WHEN t = 0 THEN z END) OVER w2 AS z1, min(v) OVER w2 AS v1 FROM un WINDOW w1 AS (PARTITION BY galaxy_id, spaxel ORDER BY z, t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY galaxy_id, spaxel ORDER BY z, t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
        parts.append("avs AS (SELECT id, CASE WHEN z0 IS NULL AND z1 IS NULL THEN 0 WHEN z0 IS NULL THEN v1 WHEN z1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (z - z0) / (z1 - z0) END AS av FROM bk WHERE t = 1)")
    parts.append(f"ce AS (SELECT *, {_CELLS} FROM st)")
    parts.append(f"fl AS (SELECT id, gr.k, CASE WHEN bool_and(inside) THEN sum(mass * v * CASE WHEN gr.m = i THEN 1 - s ELSE s END * CASE WHEN gr.a = j THEN 1 - t ELSE t END) ELSE 0 END AS v FROM ce JOIN gr ON gr.m IN (i, i + 1) AND gr.a IN (j, j + 1) GROUP BY id, gr.k)")
    parts.append("tg AS (SELECT id, galaxy_id, spaxel, o, 4100e0 + 8 * o AS t, (4100e0 + 8 * o) / f AS pos FROM st, range(0, 40) AS q(o))")
    parts.append("tj AS (SELECT *, CAST(least(greatest(floor((pos - 4000e0) / 10), 0), 62) AS INT) AS j FROM tg)")
    parts.append("nw AS (SELECT tj.id, galaxy_id, spaxel, o, lo.v + (hi.v - lo.v) * least(1e0, greatest(0e0, (pos - 4000e0 - 10 * tj.j) / 10)) AS v FROM tj JOIN fl AS lo ON lo.id = tj.id AND lo.k = tj.j JOIN fl AS hi ON hi.id = tj.id AND hi.k = tj.j + 1)")
    parts.append("os AS (SELECT st.id, sum(CASE WHEN k > 0 AND (4000e0 + 10 * k) * f BETWEEN 4100e0 AND 4412e0 THEN v * 10 * f ELSE 0 END) AS o FROM st JOIN fl USING (id) GROUP BY st.id)")
    parts.append("ns AS (SELECT id, sum(CASE WHEN o > 0 THEN v * 8 ELSE 0 END) AS n FROM nw GROUP BY id)")
    fade = f" * pow(10, -0.4e0 * av * pow((4100e0 + 8 * nw.o) * 1e-4, 1.61e0) * {0.574 - 0.527 / 3.1!r})" if dusty else ""
    parts.append(f"cu AS (SELECT galaxy_id, spaxel, nw.o AS k, sum(CASE WHEN n = 0 THEN 0 ELSE v * os.o / n END{fade}) AS v FROM nw JOIN os USING (id) JOIN ns USING (id){' JOIN avs USING (id)' if dusty else ''} GROUP BY ALL)")
    psf = ", ".join(f"({a}, {b}, {w!r})" for a, b, w in C.gaussian_kernel(3, 3, 0.6))
    lsf = ", ".join(f"({k - 12}, {w!r})" for k, w in enumerate(C.lsf_taps(10.0, 8.0)))
    parts.append(f"ker(dy, dx, w) AS (VALUES {psf}), ps AS (SELECT galaxy_id, CAST(x + 5 * y AS INT) AS spaxel, k, sum(v) AS v FROM (SELECT galaxy_id, spaxel % 5 + dx AS x, floor(spaxel / 5) + dy AS y, k, v * w AS v FROM cu, ker) WHERE x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4 GROUP BY ALL)")
    parts.append(f"tap(o, w) AS (VALUES {lsf}), ls AS (SELECT galaxy_id, spaxel, k + o AS k, sum(v * w) AS v FROM ps, tap WHERE k + o BETWEEN 0 AND 39 GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT galaxy_id, spaxel, CAST(k AS INT) AS k, round(v / 1e6, 3) AS v FROM ({_noisy_sql('ls', 2.0, 3)})"


def _cube_out(cube):
    return C.to_long(cube).select("galaxy_id", "spaxel", "k", r(F.col("v") / 1e6, 3).alias("v"))


@query(_job_sql(False))
def mock_cube(spark, d):
    return _cube_out(jobs.mock_cube(_snapshot(spark, d), grid_frame(spark, d), **_JOB))


@query(_job_sql(True))
def mock_cube_dusty(spark, d):
    return _cube_out(jobs.mock_cube_dusty(_snapshot(spark, d), grid_frame(spark, d), **_JOB))


@query(_job_sql(False))
def mock_cube_cells(spark, d):
    """The grid is not broadcast."""
    return _cube_out(jobs.mock_cube(_snapshot(spark, d), grid_frame(spark, d), grid_limit=0, **_JOB))


_RAW_ST = f"rs0 AS ({STARS}), cen AS (SELECT galaxy_id, count(*) % 7 / 10e0 AS c FROM rs0 GROUP BY galaxy_id), ms AS (SELECT rs0.* REPLACE (x - c AS x, y - c / 2 AS y, mass / 2 AS mass) FROM rs0 JOIN cen USING (galaxy_id)), mv AS (SELECT galaxy_id, median(vx) AS mx, median(vy) AS my, median(vz) AS mz FROM ms WHERE {_R2} < 10 GROUP BY galaxy_id), stars AS (SELECT ms.* REPLACE (vx - mx AS vx, vy - my AS vy, vz - mz AS vz) FROM ms JOIN mv USING (galaxy_id))"
_RAW_GA = f"rg0 AS ({GAS}), gas AS (SELECT rg0.* REPLACE (x - c AS x, y - c / 2 AS y) FROM rg0 JOIN cen USING (galaxy_id))"


@query(_job_sql(True, _RAW_ST, _RAW_GA))
def mock_cube_dusty_raw(spark, d):
    """Raw stars and gas, the gas with its array of metal fractions, by way of a store to a dusty cube."""
    s, g = frame(spark, d, "stars"), frame(spark, d, "gas")
    stars = s.select("galaxy_id", F.col("l_orderkey").alias("particle_id"), F.array("x", "y", "z").alias("Coordinates"), F.array("vx", "vy", "vz").alias("Velocities"), F.col("mass").alias("GFM_InitialMass"), F.col("metallicity").alias("GFM_Metallicity"), F.col("age").alias("GFM_StellarFormationTime"))
    none = F.lit(0.0)
    fields = {"Density": none, "GFM_Metallicity": none, "StarFormationRate": none, "InternalEnergy": none, "ElectronAbundance": none, "Velocities": F.array(none, none, none)}
    gas = g.select("galaxy_id", F.col("o_orderkey").alias("particle_id"), F.array("x", "y", "z").alias("Coordinates"), F.col("mass").alias("Masses"), F.array("h_frac", none, none, none, "o_frac").alias("GFM_Metals"), *[v.alias(k) for k, v in fields.items()])
    plain = jobs.Layout(jobs.LAYOUTS["TNG"].fields, "error", formation=False)  # ages as they are
    galaxy = galaxies(s).withColumns({"redshift": 0.01 + F.col("galaxy_id") / 1000.0, "half": F.lit(HALF) - F.col("galaxy_id") / 4.0})
    snapshot = jobs.prepare({"stars": stars, "gas": gas}, galaxy, scratch(spark), layout=plain, attributes={"stars": {"mass": (1.0, 0.0, 0.0)}}, scale_factor=0.5)
    return _cube_out(jobs.mock_cube_dusty(snapshot, grid_frame(spark, d), **_JOB))


@query(f"WITH {_SP}, {_CV}, pr AS (SELECT galaxy_id, spaxel, filter_id, cl.k, v * t0 AS v FROM cl JOIN rs ON rs.k = cl.k), im AS (SELECT galaxy_id, spaxel, filter_id, sum(a) AS image FROM (SELECT galaxy_id, spaxel, filter_id, (v + lag(v) OVER (PARTITION BY galaxy_id, spaxel, filter_id ORDER BY k)) / 2 AS a FROM pr) GROUP BY ALL) SELECT galaxy_id, spaxel, filter_id, round(image, 6) AS image, round((image - min(image) OVER w) / (max(image) OVER w - min(image) OVER w), 6) AS scaled FROM im WINDOW w AS (PARTITION BY galaxy_id)")
def photometric_images(spark, d):
    out = jobs.photometric_images(cube_of(spark, d), curves(spark, d), np.arange(64.0))
    return rounded(out, "image", "scaled")


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)
