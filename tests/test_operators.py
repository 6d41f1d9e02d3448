"""Small literal fixtures of the particle-to-datacube operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spaxelflow.functions import cosmology as K
from spaxelflow.operators import cube as C
from spaxelflow.operators import dust as D
from spaxelflow.operators import geometry as G
from spaxelflow.operators import particles as P
from spaxelflow.operators import spectra as S
from spaxelflow.operators import scan
from spaxelflow.operators.scan import asof_sum, cut_large_groups
from spaxelflow.plans import jobs, registry
from spaxelflow.sources import ingest as I
from spaxelflow.sources.store import GalaxyStore


def points(spark, rows, names="x y z"):
    return spark.createDataFrame([(0, *map(float, r)) for r in rows], "galaxy_id long, " + ", ".join(f"{n} double" for n in names.split()))


def test_unit_conversion(spark):
    df = points(spark, [(10,)], "v")
    for cgs in (1.0, 0.0):
        assert I.to_physical(df, {"v": (2.0, 2.0, cgs)}, 0.5, 0.7).first().v == pytest.approx(1.225)


def test_fov_mask_and_spaxel(spark):
    df = points(spark, [(0, 0, 0), (1, 1, 0), (0, 1, 0), (1.5, 1.5, 0), (-1.1, -0.1, 0)])
    assert P.apply_mask(P.fov_mask(df, 1.0)).count() == 3
    shifted = points(spark, [(0.5 - 2, 1.5 - 2, 0), (2.5 - 2, 3.5 - 2, 0)])
    assert sorted(r.spaxel for r in P.assign_spaxel(shifted, 2.0, 4).collect()) == [4, 14]


def test_cube_accumulation(spark):
    rows = [(0, 0, [100.0, 200.0, 300.0]), (0, 1, [400.0, 500.0, 600.0]), (0, 1, [700.0, 800.0, 900.0]), (0, 3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "galaxy_id long, spaxel int, flux array<double>")
    got = {r.spaxel: r.flux for r in C.accumulate_cube(df, 2).collect()}
    assert got == {0: [100.0, 200.0, 300.0], 1: [1100.0, 1300.0, 1500.0], 2: [0.0] * 3, 3: [1.0, 2.0, 3.0]}
    again = {r.spaxel: r.flux for r in C.accumulate_cube(df.repartition(3), 2).collect()}
    assert again == got


def test_centering(spark):
    df = points(spark, [(1, 2, 3, 1, 2, 3), (4, 5, 6, 4, 5, 6), (7, 8, 9, 7, 8, 9)], "x y z vx vy vz")
    galaxy = lambda c: spark.createDataFrame([(0, c)], "galaxy_id long, center array<double>")
    with pytest.raises(ValueError):
        P.center(df, galaxy([0.0, 0.0, 0.0]))
    rows = sorted(P.center(df, galaxy([4.0, 5.0, 6.0])).select("x", "vy").collect())
    assert [tuple(r) for r in rows] == [(-3.0, -3.0), (0.0, 0.0), (3.0, 3.0)]


def test_center_checks_bounds_in_the_query_and_its_sql(spark, tmp_path):
    """Every galaxy's center must lie inside its particles' bounds; one that can't be told is refused too."""
    duckdb = pytest.importorskip("duckdb")
    run, sql = registry.queries()["center"], registry.oracle_sql()["center"]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    inside = [(order, 1, part, 1, q, 0.05, 0.04, 1.0) for order, part, q in ((400, 90, 20.0), (600, 110, 30.0), (500, 100, 25.0))]
    above = [(o, n, p, 2, *rest) for o, n, p, _, *rest in inside if o >= 500]  # a second galaxy, all at z > 0
    unknown = [(o, n, p, 2, None, *rest) for o, n, p, _, _, *rest in inside]
    for name, rows in (("inside", inside), ("above", [*inside, *above]), ("far", [(o, n, p, s, 60.0 + q, *rest) for o, n, p, s, q, *rest in above]), ("unknown", [*inside, *unknown])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, names).write.parquet(f"{d}/lineitem.parquet")
        with duckdb.connect() as oracle:
            oracle.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
            if name == "inside":
                assert sorted(map(tuple, run(spark, d).collect())) == sorted(oracle.sql(sql).fetchall())
                continue
            with pytest.raises(duckdb.Error, match="outside"):
                oracle.sql(sql).fetchall()
        with pytest.raises(ValueError, match="outside"):
            run(spark, d)


def test_inertia_and_axes(spark):
    df = points(spark, [(1, 0, 0, 1), (0, 1, 0, 1), (0, 0, 1, 1)], "x y z mass")
    galaxy = spark.createDataFrame([(0, 2.0)], "galaxy_id long, halfmassrad_stars double")
    t = P.inertia_tensor(df, galaxy)
    row = t.first()
    assert (row.ixx, row.iyy, row.izz, row.ixy, row.ixz, row.iyz) == (2.0, 2.0, 2.0, 0.0, 0.0, 0.0)
    axes = np.array(G.principal_axes(t).first().axes).reshape(3, 3)
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) == pytest.approx(1.0)


def test_half_mass_radius(spark):
    df = points(spark, [(0, 0, 0, 1), (1, 1, 1, 2), (2, 2, 2, 3)], "x y z mass")
    assert P.half_mass_radius(df).first().halfmassrad == pytest.approx(math.sqrt(3))


def test_euler(spark):
    assert np.allclose(G.euler_matrix(90, 0, 0), [[1, 0, 0], [0, 0, -1], [0, 1, 0]])
    df = points(spark, [(1, 2, 3, 4, 5, 6)], "x y z vx vy vz")
    row = G.euler_rotate(df, 30, 40, 50).first()
    assert row.x**2 + row.y**2 + row.z**2 == pytest.approx(14)


@pytest.mark.parametrize("kind", ["square", "circular", "hexagonal"])
def test_apertures(spark, kind):
    n, got = 10, {(r.x, r.y) for r in G.aperture(spark, kind, 10).collect()}
    want = set()
    for x in range(n):
        for y in range(n):
            dx, dy = abs(x + 1 - (n / 2 + 0.5)), abs(y + 1 - (n / 2 + 0.5))
            apothem = n * math.sqrt(3) / 4
            if {"square": True, "circular": math.hypot(dx, dy) <= n / 2, "hexagonal": 2 * n / 4 * apothem - n / 4 * dy - apothem * dx >= 0 and dx < n / 2 and dy < apothem}[kind]:
                want.add((x, y))
    assert got == want and len(got) == {"square": 100}.get(kind, len(got))


def test_resample(spark):
    flux, wave, target = np.arange(1.0, 6.0), np.arange(4000.0, 9000.0, 1000.0), np.arange(4500.0, 8000.0, 1000.0)
    want = [1.2857142857, 2.1428571429, 3.0, 3.8571428571]
    assert np.allclose(S.resample_kernel(flux[None, :], wave, np.ones(1), target)[0], want)
    assert not S.resample_kernel(0 * flux[None, :], wave, np.ones(1), target).any()


def test_template_nodes_and_outside():
    rng = np.random.default_rng(0)
    grid = (np.array([0.001, 0.01, 0.02, 0.05]), np.array([0.1, 1.0, 5.0, 9.0, 13.0]), rng.random((4, 5, 7)))
    for method in S.WEIGHTS:
        for i, m in enumerate(grid[0]):
            got = S.template_flux(grid, np.full(5, m), grid[1], method)
            assert np.allclose(got, grid[2][i])
        assert not S.template_flux(grid, np.array([1.0]), np.array([100.0]), method).any()


def test_psf_lsf(spark):
    flux = [[0.0] for _ in range(100)]
    flux[5 + 10 * 5] = [1.0]
    cube = spark.createDataFrame([(0, k, f) for k, f in enumerate(flux)], "galaxy_id long, spaxel int, flux array<double>")
    kernel = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    ones = sorted(r.spaxel for r in C.stencil_sum(cube, kernel, 10).collect() if r.flux == [1.0])
    assert ones == [x + 10 * y for y in (4, 5, 6) for x in (4, 5, 6)]
    assert sum(w for *_, w in C.gaussian_kernel(5, 5, 1.0)) == pytest.approx(1)
    line = spark.createDataFrame([(0, 0, [float(k == 50) for k in range(100)])], "galaxy_id long, spaxel int, flux array<double>")
    got = C.convolve_lsf(line, 2.0, 1.0).first().flux
    assert got[38:63] == pytest.approx(C.lsf_taps(2.0, 1.0))


def test_noise_is_finite_and_zero_on_zeros(spark):
    cube = spark.createDataFrame([(0, k, [1.0 + k] * 10) for k in range(25)], "galaxy_id long, spaxel int, flux array<double>")
    for kind in ("normal", "uniform"):
        values = np.array([r.flux for r in C.add_noise(cube, 0.8, kind).collect()])
        assert np.isfinite(values).all() and values.var() > 0
        assert sorted(C.add_noise(cube.repartition(5), 0.8, kind).collect()) == sorted(C.add_noise(cube, 0.8, kind).collect())
    zero = cube.withColumn("flux", F.transform("flux", lambda v: v * 0))
    assert not np.array([r.flux for r in C.add_noise(zero, 0.8).collect()]).any()


def test_photometry(spark):
    curve = spark.createDataFrame([("a/b.c", w, 1.0) for w in (400.0, 500.0, 600.0)], "filter_id string, wavelength double, transmission double")
    cube = spark.createDataFrame([(0, 0, [2.0, 2.0, 2.0])], "galaxy_id long, spaxel int, flux array<double>")
    assert S.photometry(cube, curve, F.array(*[F.lit(w) for w in (400.0, 500.0, 600.0)])).first().image == pytest.approx(400)
    with pytest.raises(ValueError):
        I.load_filters(curve, "a", name="c")


def test_cosmology(spark):
    rows = {0.1: (432.1734, 475.3908, 392.8849, 38.38525, 1.904760), 1.0: (3398.9941, 6797.9883, 1699.4971, 44.16190, 8.239394)}
    df = K.age_columns(K.distance_columns(spark.createDataFrame([(z,) for z in rows], "redshift double")))
    for r in df.collect():
        assert (r.comoving, r.luminosity, r.angular, r.modulus, r.kpc_per_arcsec) == pytest.approx(rows[r.redshift], rel=1e-5)
        assert r.age_z0 == pytest.approx(13.821265, rel=1e-5)
    ages = K.stellar_age(spark.createDataFrame([(0.5,)], "a double"), "a").first().age
    assert ages == pytest.approx(7.94165, rel=1e-3)


def test_dust_parts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    x = F.col("x")
    assert [r[0] for r in df.select(D.power_law(x, 2.0, 1.0)).collect()] == pytest.approx([2, 1, 2 / 3])
    assert [r[0] for r in df.select(D.polynomial(x, (1.0, 2.0, 3.0))).collect()] == pytest.approx([6, 17, 34])
    assert [r[0] for r in df.select(D.drude(x, 1.0, 1.0, 1.0)).collect()] == pytest.approx([1, 0.3077, 0.1233], rel=1e-3)
    assert [r[0] for r in df.select(D.fm90(x + 3)).collect()] == pytest.approx([4.18795, 5.72375, 4.75743], rel=1e-4)
    with pytest.raises(NotImplementedError):
        D.dust_to_gas(x, "power law slope fixed")
    with pytest.raises(ValueError):
        D.extinguish(x)


def thin_disc(spark, n_gas=3000, n_stars=2000):
    """A face-on disc: all gas within 1 kpc, a third of everything in one spaxel, many equal places."""
    rng = np.random.default_rng(3)
    spaxel = lambda n: np.where(rng.random(n) < 0.35, 2, rng.integers(0, 5, n))
    gas = [(0, int(s), float(z), float(v), k) for k, (s, z, v) in enumerate(zip(spaxel(n_gas), np.round(rng.normal(0, 0.2, n_gas), 2), rng.random(n_gas)))]
    stars = [(0, int(s), float(z), k) for k, (s, z) in enumerate(zip(np.where(rng.random(n_stars) < 0.02, 7, spaxel(n_stars)), np.round(1.3 * rng.normal(0, 0.2, n_stars), 2)))]
    g = spark.createDataFrame(gas, "galaxy_id long, spaxel int, z double, m double, k int")
    return gas, stars, g, spark.createDataFrame(stars, "galaxy_id long, spaxel int, z double, id int")


def test_asof_matches_numpy_whole_and_in_pieces(spark):
    gas, stars, g, s = thin_disc(spark, 600, 300)
    g = g.unionByName(spark.createDataFrame([(0, 1, None, 5.0, 0), (0, 1, 0.1, None, 0)], g.schema))  # neither counts
    s = s.unionByName(spark.createDataFrame([(0, 1, None, -1)], s.schema))
    for options in ({"split": False}, {}, {"rows_a_piece": 20}, {"rows_a_piece": 1}):
        got = {r.id: r.asof for r in asof_sum(s, g, "m", ties=("k",), **options).collect()}
        assert len(got) == len(stars) + 1 and got.pop(-1) is None
        for _, spaxel, z, k in stars:
            own = sorted((q, j, m) for _, p, q, m, j in gas if p == spaxel)
            at, sums = [q for q, *_ in own], np.cumsum([m for *_, m in own])
            i = np.searchsorted(at, z, side="right")  # the last of equal knots counts
            want = 0.0 if not own else sums[0] if i == 0 else sums[-1] if i == len(own) else sums[i - 1] + (sums[i] - sums[i - 1]) * (z - at[i - 1]) / (at[i] - at[i - 1])
            assert got[k] == pytest.approx(want, abs=1e-9)


def test_pieces_are_even_in_a_thin_disc(spark):
    """However thin the disc, no piece holds more than twice its share of the rows."""
    _, _, g, _ = thin_disc(spark, 40_000)
    rows = g.withColumn("z", F.col("z") + F.col("k") * 1e-9)
    cuts = cut_large_groups(rows.select("galaxy_id", "spaxel", "z"), ("galaxy_id", "spaxel"), ("z",), 2000)
    sizes = [r["count"] for r in cuts.place(rows).groupBy("galaxy_id", "spaxel", "_piece").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 2000
    assert len(sizes) >= 40_000 / 2000


def test_asof_reads_each_table_once(spark, tmp_path):
    _, _, g, s = thin_disc(spark, 50, 50)
    g.write.parquet(str(tmp_path / "g"))
    s.write.parquet(str(tmp_path / "s"))
    out = asof_sum(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "g")), "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_validation_and_sinks(spark, tmp_path):
    df = I.synth_galaxy(spark, 50, 1)
    assert df.count() == 50 and sorted(df.collect()) == sorted(I.synth_galaxy(spark, 50, 1).repartition(4).collect())
    with pytest.raises(ValueError, match="coords"):
        I.validate(df, "stars")
    path = str(tmp_path / "stars")
    marked = I.to_canonical_units(df, {"age": "Myr"})
    I.write_canonical(marked, path)
    assert I.units_of(I.read_canonical(spark, path))["age"] == "Gyr"
    I.write_canonical(marked.limit(10), path, "ignore")
    assert I.read_canonical(spark, path).count() == 50
    I.write_canonical(marked.limit(10), path, "overwrite")
    assert I.read_canonical(spark, path).count() == 10
    cube = spark.createDataFrame([(0, 0, [1.0])], "galaxy_id long, spaxel int, flux array<double>")
    folder = str(tmp_path / "cube")
    I.write_cube(cube, {"SIM": "t", "SNAPSHOT": 7}, folder, 25, 4700.0, 1.25, 0.2)
    I.write_cube(cube.withColumn("galaxy_id", F.lit(3)), {"SIM": "t"}, folder, 25, 4700.0, 1.25, 0.2)
    I.write_cube(cube.withColumn("flux", F.array(F.lit(9.0))), {"SIM": "t", "SNAPSHOT": 8}, folder, 25, 4700.0, 1.25, 0.2)
    back, header = I.read_cube(spark, folder)
    assert {r.galaxy_id: r.flux for r in back.collect()} == {0: [9.0], 3: [1.0]}
    keys = {r.key: r.value for r in header.where("galaxy_id = 0").collect()}
    assert (keys["CRPIX1"], keys["CRPIX3"], keys["CUNIT1"], keys["CTYPE3"], keys["GALAXYID"], keys["SNAPSHOT"]) == ("12.0", "1", "deg", "AWAV", "0", "8")
    assert float(keys["CD1_1"]) == pytest.approx(0.2 / 3600) and keys["NAME"] == "t_id0_snap8_stars_subsetFalse" and header.count() == 2 * (len(I.CUBE_KEYS) + 23)


def test_ingest_and_templates(spark):
    raw = spark.createDataFrame([(1, 2.0)], "galaxy_id long, GFM_InitialMass double")
    with pytest.raises(ValueError):
        I.ingest_snapshot(raw, I.TNG_STARS)
    assert I.ingest_snapshot(raw, {"GFM_InitialMass": "mass", "GFM_Metallicity": "metallicity"}, "zero").first().metallicity == 0.0
    with pytest.raises(ValueError):
        I.ingest_snapshot(raw.withColumn("other", F.lit(1)), I.TNG_STARS)
    cards = spark.createDataFrame([("NAME0", "spec_ssp_1.00Gyr_z0200.spec"), ("NAME1", "spec_ssp_500Myr_z0200.spec"), ("NORM0", "2.0")], "key string, value string")
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "idx int, flux array<double>")
    got = {(r.age, r.metallicity): r.flux for r in I.load_template_cards(cards, rows).collect()}
    assert got == {(1.0, 0.02): [2.0, 4.0], (0.5, 0.02): [3.0, 4.0]}
    catalogue = spark.createDataFrame([(1.0, 2.0, 3.0, {"a": 1})], "pos_x double, pos_y double, pos_z double, nested map<string, int>")
    assert I.flatten_catalogue(catalogue).first().center == [1.0, 2.0, 3.0]


def test_subset_is_stable(spark):
    df = I.synth_galaxy(spark, 500, 2)
    a = sorted(r.particle_id for r in P.subset(df, 40).collect())
    assert len(a) == 40 and a == sorted(r.particle_id for r in P.subset(df.repartition(7), 40).collect())


def test_central_velocity_is_the_median(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 400):
        v = np.concatenate([rng.normal(0, 50, (n, 3)), np.zeros((n // 3, 3)), rng.normal(1e6, 1e5, (n // 4, 3))])
        df = points(spark, [(0, 0, 1, *row) for row in v] + [(0, 0, 50, 9, 9, 9)], "x y z vx vy vz").repartition(3)
        row = P.central_velocity(df).first()
        assert (row.vx, row.vy, row.vz) == pytest.approx(tuple(np.median(v, axis=0)))
    holes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, None, float("nan"), 3.0), (0, 0.0, 0.0, 0.0, 1.0, 2.0, 5.0)], "galaxy_id long, x double, y double, z double, vx double, vy double, vz double")
    assert tuple(P.central_velocity(holes).first())[1:] == (1.0, 2.0, 4.0)


def test_pieces_are_bounded_and_large_inputs_get_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(scan, "MAX_PIECES", 20, raising=False)
    monkeypatch.setattr(scan, "ROWS_A_TASK", 500, raising=False)
    _, stars, g, s = thin_disc(spark, 4000, 4000)
    cuts = cut_large_groups(g.select("galaxy_id", "spaxel", "z", "k"), ("galaxy_id", "spaxel"), ("z", "k"), 1)
    assert 2 <= sum(len(r.cuts) for r in cuts.table.collect()) <= 30  # about MAX_PIECES; one for each 60 rows before, 66
    placed = cuts.place(g).groupBy("spaxel", scan.PIECE).agg(F.min(F.struct("z", "k")).alias("lo"), F.max(F.struct("z", "k")).alias("hi")).orderBy("spaxel", scan.PIECE).collect()
    assert all(a.hi < b.lo for a, b in zip(placed, placed[1:]) if a.spaxel == b.spaxel)
    whole = {r.id: r.asof for r in asof_sum(s, g, "m", ties=("k",), split=False).collect()}
    assert len(whole) == len(stars)
    for out in (asof_sum(s, g, "m", ties=("k",), rows_a_piece=1), asof_sum(s, g, "m", ties=("k",)), asof_sum(s, g, "m", ties=("k",), split=False)):
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        assert {r.id: r.asof for r in out.collect()} == pytest.approx(whole)
    summed = D.column_density(g, "m", order=("z", "k"), rows_a_piece=1)
    assert "REPARTITION_BY_NUM" in summed._jdf.queryExecution().executedPlan().toString() and summed.count() == 4000


@pytest.fixture
def many_partitions(spark, monkeypatch):
    """A session with more partitions than the rows ask for: unless their number is named, small ones are merged by packed bytes."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    monkeypatch.setattr(scan, "ROWS_A_TASK", 500)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_running_sums_of_large_inputs_are_not_merged_to_few_tasks(spark, many_partitions):
    _, _, g, _ = thin_disc(spark, 4000)
    for size in (None, 100):
        out = D.column_density(g, "m", order=("z", "k"), rows_a_piece=size)
        assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 4000 and out.rdd.getNumPartitions() == 30
    few = D.column_density(g.where("k < 1000"), "m", order=("z", "k"))  # the cores hold them at once
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("options", [{"rows_a_piece": 100}, {"split": False}])
def test_asof_of_large_inputs_sorts_once_in_small_tasks(spark, many_partitions, monkeypatch, options):
    """Rows, and the knots that are looked through for the pieces' ends, are dealt by number; one sort serves both directions."""
    dealt, real = [], scan._dealt
    monkeypatch.setattr(scan, "_dealt", lambda rows, *args: dealt.append(real(rows, *args)) or dealt[-1])
    _, _, g, s = thin_disc(spark, 4000, 2000)
    out = asof_sum(s, g, "m", ties=("k",), **options)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == plan.count("Sort [") == 1
    assert len(dealt) == (2 if "rows_a_piece" in options else 1) and all(d.rdd.getNumPartitions() == 30 for d in dealt)


def test_asof_looks_far_ahead(spark):
    """Three knots, far apart among more stars than a window keeps in its list, and stars before and behind all of them."""
    at, m = np.array([0.2, 0.5, 0.9]), np.array([2.0, 3.0, 5.0])
    g = spark.createDataFrame([(0, 0, float(z), float(v)) for z, v in zip(at, m)], "galaxy_id long, spaxel int, z double, m double")
    s = spark.range(20_000).select(F.lit(0).cast("long").alias("galaxy_id"), F.lit(0).alias("spaxel"), (F.col("id") / 20_000).alias("z"), "id")
    for options in ({"split": False}, {}, {"rows_a_piece": 700}):
        got = np.array([r.asof for r in asof_sum(s, g, "m", **options).orderBy("id").collect()])
        assert np.allclose(got, np.interp(np.arange(20_000) / 20_000, at, np.cumsum(m)))


def test_running_sums_whole_and_in_pieces(spark):
    rng = np.random.default_rng(6)
    rows = [(0, int(g), float(z), float(m)) for g, z, m in zip(rng.integers(0, 3, 200), rng.normal(0, 4, 200), rng.random(200))] + [(0, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "galaxy_id long, spaxel int, z double, m double").repartition(4)
    for size in (None, 10, 70):
        got = sorted((r.spaxel, r.z if r.z is not None else -1e9, r.column) for r in D.column_density(df, "m", rows_a_piece=size).collect())
        want = []
        for g in range(3):
            own = sorted((z if z is not None else -1e9, m) for _, s, z, m in rows if s == g)
            want += [(g, z, t) for (z, _), t in zip(own, np.cumsum([m for _, m in own]))]
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert D.column_density(df.limit(0), "m").collect() == []


def test_half_mass_radius_with_a_far_particle(spark):
    rng = np.random.default_rng(7)
    xyz, mass = rng.normal(size=(500, 3)), rng.random(500)
    xyz[0] = 1e9
    r = np.linalg.norm(xyz, axis=1)
    order = np.argsort(r)
    want = r[order][np.searchsorted(np.cumsum(mass[order]), mass.sum() / 2)]
    df = points(spark, [(*p, m) for p, m in zip(xyz, mass)], "x y z mass")
    assert P.half_mass_radius(df).first().halfmassrad == pytest.approx(want)


def test_instruments():
    sizes = {name: (G.instrument_bins(name), len(G.instrument_wave(name))) for name in G.INSTRUMENTS}
    assert sizes["MUSE"] == (25, 3721) and len(sizes) == 15
    for name, (_, _, lo, hi, step, _, _) in G.INSTRUMENTS.items():
        assert len(G.instrument_wave(name)) == len(np.arange(lo, hi, step))
    assert G.instrument_lsf("MUSE") == pytest.approx(2.51 / 2.354820045)


def test_argument_errors(spark):
    cube = spark.createDataFrame([(0, 0, [1.0])], "galaxy_id long, spaxel int, flux array<double>")
    for bad in (lambda: C.convolve_psf(cube, 1, None, 1.0), lambda: C.convolve_psf(cube, 1, 3, None), lambda: C.convolve_lsf(cube, None, 1.0), lambda: C.add_noise(cube, None), lambda: C.add_noise(cube, 1.0, "poisson")):
        with pytest.raises(ValueError):
            bad()


def test_psf_of_even_size(spark):
    kernel = C.gaussian_kernel(4, 4, 1.0)
    assert len(kernel) == 16 and sum(w for *_, w in kernel) == pytest.approx(1)
    cube = spark.createDataFrame([(0, k, [float(k == 55)]) for k in range(100)], "galaxy_id long, spaxel int, flux array<double>")
    assert sum(r.flux[0] for r in C.convolve_psf(cube, 10, 4, 1.0).collect()) == pytest.approx(1)


@pytest.mark.parametrize("size, sigma, n, tile", [(3, 0.6, 7, 3), (5, 1.0, 11, 4), (4, 0.8, 9, 2), (7, 2.0, 5, 24)])
def test_psf_in_tiles_is_the_convolution(spark, size, sigma, n, tile):
    rng = np.random.default_rng(2)
    flux = rng.random((n, n, 4))
    absent = {3, 8}
    flux.reshape(-1, 4)[sorted(absent)] = 0
    cube = spark.createDataFrame([(g, k, (g * flux).reshape(-1, 4)[k].tolist()) for g in (1, 2) for k in range(n * n) if k not in absent], "galaxy_id long, spaxel int, flux array<double>").repartition(3)
    want = np.zeros_like(flux)
    for dy, dx, w in C.gaussian_kernel(size, size, sigma):
        for y in range(n):
            for x in range(n):
                if 0 <= y - dy < n and 0 <= x - dx < n:
                    want[y, x] += w * flux[y - dy, x - dx]
    for made in (C.convolve_psf(cube, n, size, sigma, tile), C.stencil_sum(cube, C.gaussian_kernel(size, size, sigma), n, tile)):
        found = {(r.galaxy_id, r.spaxel): r.flux for r in made.collect()}
        assert len(found) == 2 * n * n
        for (g, k), v in found.items():
            assert v == pytest.approx((g * want).reshape(-1, 4)[k].tolist())


def test_psf_copies_border_spaxels_alone(spark):
    cube = spark.createDataFrame([(0, k, [1.0]) for k in range(48 * 48)], "galaxy_id long, spaxel int, flux array<double>")
    plan = C.convolve_psf(cube, 48, 5, 1.0, 24)
    assert plan.count() == 48 * 48
    dealt = sum(int(np.prod([1 + any(0 <= (v + d) // 24 < 2 and (v + d) // 24 != v // 24 for d in (-2, 2)) for v in divmod(k, 48)])) for k in range(48 * 48))
    assert dealt == 52 * 52  # rows of the shuffle: spaxels and their border copies


def test_noise_never_gathers_spectra_by_galaxy(spark):
    cube = spark.createDataFrame([(0, k, [float(k), 1.0]) for k in range(9)], "galaxy_id long, spaxel int, flux array<double>")
    plan = C.add_noise(cube, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_template_grid_and_wave(spark):
    flux = [[[0.5, 1.0, 1.5], [2.0, 3.0, 4.0]], [[5.0, 6.0, 7.0], [8.0, 9.0, 10.0]]]
    dense = spark.createDataFrame([([-1.0, 0.0], [0.01, 0.02], flux)], "age array<double>, metallicity array<double>, flux array<array<array<double>>>")
    got = {(r.met_idx, r.age_idx): (r.metallicity, r.age, r.flux) for r in I.load_template_grid(dense, ("age",)).collect()}
    assert got[1, 0] == (0.02, pytest.approx(0.1), flux[1][0]) and len(got) == 4
    one = spark.range(1)
    for cdelt, step in ((2.0, 2.0), (0.0, 1.0), (None, 1.0)):
        assert one.select(I.template_wave(4000.0, cdelt, 1.0, 3)).first()[0] == [4000.0, 4000.0 + step, 4000.0 + 2 * step]


def test_filter_files(spark, tmp_path):
    curve = spark.createDataFrame([(f"{f}/I.{n}", float(w), 0.5) for f in ("A", "B") for n in "gr" for w in (1, 2)], "filter_id string, wavelength double, transmission double")
    I.write_filters(curve, str(tmp_path / "f"))
    back = I.read_filters(spark, str(tmp_path / "f"))
    assert sorted(back.select(*curve.columns).collect()) == sorted(curve.collect())
    assert I.load_filters(back, "A", "I", ["g"]).count() == 2
    with pytest.raises(ValueError, match="invalid"):
        I.load_filters(back, "A", "I", ["g", "none"])


def test_validation_of_groups(spark):
    galaxy = spark.createDataFrame([(0, 0.1)], "galaxy_id long, redshift double")
    with pytest.raises(ValueError, match="unexpected"):
        I.validate_groups({"stars": galaxy, "black_holes": galaxy})
    with pytest.raises(ValueError, match="none of the expected"):
        I.validate_groups({"galaxy": galaxy})


def raw_snapshot(spark):
    """Five star particles, one of them a wind cell, and gas, in the TNG layout."""
    rng = np.random.default_rng(1)
    stars = [(0, k, rng.normal(0, 2, 3).tolist(), 1.0 + k, 0.02, 0.5 if k else -0.5, rng.normal(0, 50, 3).tolist()) for k in range(6)]
    gas = [(0, k, 1.0, 5.0, 0.01, [0.7, 0.2, 0.01, 0.01, 0.02], 0.1, 1.0, rng.normal(0, 50, 3).tolist(), rng.normal(0, 2, 3).tolist(), 1.0) for k in range(20)]
    return {
        "stars": spark.createDataFrame(stars, "galaxy_id long, particle_id long, Coordinates array<double>, GFM_InitialMass double, GFM_Metallicity double, GFM_StellarFormationTime double, Velocities array<double>"),
        "gas": spark.createDataFrame(gas, "galaxy_id long, particle_id long, Density double, Masses double, GFM_Metallicity double, GFM_Metals array<double>, StarFormationRate double, InternalEnergy double, Velocities array<double>, Coordinates array<double>, ElectronAbundance double"),
    }


def test_raw_snapshot_to_cube(spark, tmp_path):
    galaxy = spark.createDataFrame([(0, 0.1, [0.0, 0.0, 0.0], 3.0)], "galaxy_id long, redshift double, center array<double>, halfmassrad_stars double")
    raw = {k: I.select_fields(df, k) for k, df in raw_snapshot(spark).items()}
    snapshot = jobs.prepare(raw, galaxy, str(tmp_path / "store"), attributes={"stars": {"mass": (0.0, -1.0, 0.0)}}, hubble=0.5, header={"Time": 0.5})
    stars = snapshot.stars.collect()
    assert len(stars) == 5 and sorted(r.mass for r in stars) == [4.0, 6.0, 8.0, 10.0, 12.0]
    assert all(r.age == pytest.approx(7.94165, rel=1e-3) for r in stars) and np.median([r.vx for r in stars]) == pytest.approx(0)
    store = GalaxyStore(spark, str(tmp_path / "store"))
    assert I.units_of(store.read("stars"))["mass"] == "Msun" and [tuple(r) for r in store.header().collect()] == [(0, "Time", "0.5")]
    again = jobs.prepare({k: df.limit(0) for k, df in raw.items()}, galaxy, str(tmp_path / "store"))
    assert again.stars.count() == 5  # what is stored stays
    grid = (np.array([0.0, 0.03, 0.06]), np.array([0.0, 5.0, 14.0]), np.random.default_rng(0).random((3, 3, 200)))
    seen, options = jobs.observed_with(galaxy, "NIRSpec_PRISM_CLEAR")
    assert {(r.h_frac, r.o_frac) for r in snapshot.gas.collect()} == {(0.7, 0.02)}
    observed = jobs.Snapshot(seen, snapshot.stars, snapshot.gas)
    for job in (jobs.mock_cube, jobs.mock_cube_dusty):
        cube = job(observed, grid, np.linspace(4000, 60000, 200), psf=(5, 0.6), noise=(1.0, "normal", 0), **options).collect()
        flux = np.array([r.flux for r in cube])
        assert flux.shape == (30 * 30, len(options["target"])) and np.isfinite(flux).all() and flux.any()
    assert jobs.prepare(raw, galaxy, subset=3).stars.count() == 3
    with pytest.raises(ValueError, match="unexpected"):
        jobs.canonical({"stars": raw["stars"], "other": raw["stars"]})


def several_galaxies(spark, ids, mass=1.0):
    rows = [(g, k, [k - 1.0, 0.0, 1.0 - k], mass + k, 0.02, 0.5, [0.0, 0.0, 0.0]) for g in ids for k in range(3)]
    raw = {"stars": spark.createDataFrame(rows, "galaxy_id long, particle_id long, Coordinates array<double>, GFM_InitialMass double, GFM_Metallicity double, GFM_StellarFormationTime double, Velocities array<double>")}
    return raw, spark.createDataFrame([(g, 0.1, [0.0, 0.0, 0.0], 3.0) for g in ids], "galaxy_id int, redshift double, center array<double>, halfmassrad_stars double")


def masses(snapshot):
    return {g: sorted(r.mass for r in rows) for g, rows in itertools.groupby(sorted(snapshot.stars.collect(), key=lambda r: r.galaxy_id), lambda r: r.galaxy_id)}


def test_store_by_galaxy(spark, tmp_path):
    path = str(tmp_path / "store")
    assert masses(jobs.prepare(*several_galaxies(spark, [1]), path)) == {1: [1.0, 2.0, 3.0]}
    # skip: the galaxy that is there stays as it is, the new one is added
    assert masses(jobs.prepare(*several_galaxies(spark, [1, 2], 5.0), path)) == {1: [1.0, 2.0, 3.0], 2: [5.0, 6.0, 7.0]}
    # a snapshot is limited to the galaxies asked for
    assert masses(jobs.prepare(*several_galaxies(spark, [2], 9.0), path)) == {2: [5.0, 6.0, 7.0]}
    # overwrite: the asked galaxies alone
    assert masses(jobs.prepare(*several_galaxies(spark, [2], 9.0), path, "overwrite")) == {2: [9.0, 10.0, 11.0]}
    # reuse writes nothing, and needs all of them
    assert masses(jobs.prepare(*several_galaxies(spark, [1, 2], 0.0), path, "reuse")) == {1: [1.0, 2.0, 3.0], 2: [9.0, 10.0, 11.0]}
    with pytest.raises(ValueError, match=r"not in the store: \[3\]"):
        jobs.prepare(*several_galaxies(spark, [1, 3]), path, "reuse")
    with pytest.raises(ValueError, match=r"already in the store: \[2\]"):
        jobs.prepare(*several_galaxies(spark, [2, 3]), path, "error")
    with pytest.raises(ValueError, match="mode"):
        jobs.prepare(*several_galaxies(spark, [2]), path, "append")
    assert masses(jobs.prepare(*several_galaxies(spark, [3]), path, "error")) == {3: [1.0, 2.0, 3.0]}
    manifest = {r.galaxy_id: (r.seq, r.rows) for r in GalaxyStore(spark, path).manifest().collect()}
    assert manifest == {1: (1, {"stars": 3}), 2: (3, {"stars": 3}), 3: (4, {"stars": 3})}


def test_stored_chunks_are_read_where_they_are_asked_for(spark, tmp_path):
    rng = np.random.default_rng(8)
    flux = {(g, k): rng.random(23).round(3).tolist() for g in (0, 1) for k in range(4)}
    path = str(tmp_path / "cube")
    cube = spark.createDataFrame([(*k, v) for k, v in flux.items()], "galaxy_id long, spaxel int, flux array<double>").coalesce(1)
    I.write_cube(cube, {}, path, 2, 4000.0, 1.0, 0.2, chunk=5)
    assert {(r.galaxy_id, r.spaxel): r.flux for r in I.read_cube(spark, path)[0].collect()} == flux
    for lo, hi in ((0, 23), (0, 5), (5, 10), (4, 6), (7, 8), (3, 22), (20, 23), (22, 40)):
        part = I.read_cube(spark, path, lo, hi)[0]
        assert {(r.galaxy_id, r.spaxel): r.flux for r in part.collect()} == {k: v[lo:hi] for k, v in flux.items()}
        image = I.stored_image(spark, path, lo, hi)
        assert {(r.galaxy_id, r.spaxel): r.image for r in image.collect()} == pytest.approx({k: sum(v[lo:hi]) for k, v in flux.items()})
        assert _scan_files(part) == _scan_files(image) == 2 * (min(hi - 1, 22) // 5 - lo // 5 + 1)  # one file a galaxy and chunk
    assert {k: len(v) for k, v in (((r.galaxy_id, r.spaxel), r.flux) for r in I.read_cube(spark, path, 21)[0].collect())} == dict.fromkeys(flux, 2)


def _scan_files(df):
    """Files that the scans of a plan select."""
    leaves = df._jdf.queryExecution().executedPlan().inputPlan().collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.size())]
    return sum(s.selectedPartitions().totalNumberOfFiles() for s in scans if s.nodeName().startswith("Scan parquet"))


@pytest.mark.parametrize("method", ["cubic", "linear", "nearest"])
def test_lookup_by_cells_equals_the_broadcast_grid(spark, method):
    """Stars on nodes, between them, outside, without a place, and more than half of them in one cell."""
    rng = np.random.default_rng(9)
    mets, ages = np.array([0.0, 0.01, 0.03, 0.04, 0.1]), np.array([0.1, 1.0, 2.0, 9.0])
    flux = rng.random((5, 4, 6))
    grid = spark.createDataFrame([(i, j, float(mets[i]), float(ages[j]), flux[i, j].tolist()) for i in range(5) for j in range(4)], "met_idx int, age_idx int, metallicity double, age double, flux array<double>").repartition(3)
    place = np.concatenate([np.column_stack([rng.uniform(-0.01, 0.12, 200), rng.uniform(-1, 11, 200)]), np.tile([0.02, 1.5], (300, 1)), [(m, a) for m in mets for a in ages]])
    rows = [(k, float(m), float(a)) for k, (m, a) in enumerate(place)] + [(len(place), None, 1.0), (len(place) + 1, 0.02, None)]
    stars = spark.createDataFrame(rows, "id long, metallicity double, age double").repartition(4)
    want = S.template_flux((mets, ages, flux), place[:, 0], place[:, 1], method)
    for options in ({}, {"limit": 0}, {"limit": 0, "stars_a_cell": 7}):
        got = {r.id: r.flux for r in S.lookup_template(stars, grid, ["id"], method, **options).collect()}
        assert len(got) == len(rows) and np.allclose([got[k] for k in range(len(place))], want)
        assert got[len(place)] == got[len(place) + 1] == [0.0] * 6
    with pytest.raises(ValueError, match="bytes"):
        S.grid_arrays(grid, 100)
    moving = stars.select(F.lit(0).alias("galaxy_id"), (F.col("id") % 3).alias("spaxel"), F.coalesce("metallicity", F.lit(9.0)).alias("metallicity"), F.coalesce("age", F.lit(9.0)).alias("age"), F.lit(1.0).alias("mass"), (F.col("id") * 1.0).alias("vz"))
    cubes = [{r.spaxel: r.flux for r in C.add_cubes(S.star_cube(moving, grid, np.arange(6) + 10.0, np.arange(5) + 10.5, method=method, **o)).collect()} for o in ({}, {"limit": 0, "stars_a_cell": 50})]
    assert all(cubes[0][k] == pytest.approx(cubes[1][k]) for k in range(3))


def test_one_pass_says_what_the_separate_ones_say(spark):
    rng = np.random.default_rng(12)
    rows = [(g, *rng.normal(3 * g, 4, 3).tolist(), *(float(v) if rng.random() > 0.05 else None for v in rng.normal(0, 80, 3)), float(rng.random())) for g in (0, 1) for _ in range(400)] + [(1, 9.0, 9.0, 9.0, float("nan"), 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "galaxy_id long, x double, y double, z double, vx double, vy double, vz double, mass double").repartition(3)
    galaxy = spark.createDataFrame([(g, [3.0 * g, 3.0 * g + 0.5, 3.0 * g], 5.0) for g in (0, 1)], "galaxy_id long, center array<double>, halfmassrad_stars double")
    summary = P.summarise(df, galaxy)
    moved = P.recenter(df, galaxy)
    by_galaxy = lambda found: {r.galaxy_id: r.asDict() for r in found.collect()}
    want = by_galaxy(P.inertia_tensor(moved, galaxy))
    assert by_galaxy(summary.tensor()) == {g: pytest.approx(r) for g, r in want.items()}
    limits = by_galaxy(moved.groupBy("galaxy_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]))
    assert by_galaxy(summary.bounds()) == {g: pytest.approx(r) for g, r in limits.items()}
    given = P.recenter(df, galaxy, counts=summary.velocity_counts())
    key = lambda r: (r.galaxy_id, r.x, r.y, r.z)
    assert repr(sorted(given.collect(), key=key)) == repr(sorted(moved.collect(), key=key))
    P.check_inside(summary)
    far = galaxy.withColumn("center", F.array(F.lit(1e6), F.lit(0.0), F.lit(0.0)))
    with pytest.raises(ValueError, match="outside"):
        P.check_inside(P.summarise(df, far))


def test_dusty_job_solves_for_axes_once(spark, tmp_path):
    """A prepared snapshot brings its axes; the job's plan solves for none but reads what is kept."""
    galaxy = spark.createDataFrame([(0, 0.1, [0.0, 0.0, 0.0], 3.0)], "galaxy_id long, redshift double, center array<double>, halfmassrad_stars double")
    snapshot = jobs.prepare({k: I.select_fields(df, k) for k, df in raw_snapshot(spark).items()}, galaxy)
    grid = (np.array([0.0, 0.05]), np.array([0.0, 14.0]), np.ones((2, 2, 5)))
    cube = jobs.mock_cube_dusty(snapshot, grid, np.arange(5.0) + 4000, np.arange(3.0) + 4001, 8.0, 2)

    def nodes(plan):  # what is kept in memory is a leaf
        children = plan.children()
        return [plan.nodeName(), *(n for k in range(children.size()) for n in nodes(children.apply(k)))]

    names = nodes(cube._jdf.queryExecution().optimizedPlan())
    assert not [n for n in names if "EvalPython" in n] and names.count("InMemoryRelation") >= 2
    assert cube.count() == 4


def test_what_fails_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "store")
    jobs.prepare(*several_galaxies(spark, [1]), path)
    raw, galaxy = several_galaxies(spark, [1, 2, 3])
    with pytest.raises(ValueError, match=r"no particles of galaxies \[3\]"):
        jobs.prepare({"stars": raw["stars"].where("galaxy_id < 3")}, galaxy, path)
    lost = raw["stars"].withColumn("Coordinates", F.when(F.col("galaxy_id") == 2, F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0))).otherwise(F.col("Coordinates")))
    with pytest.raises(ValueError, match=r"without place or mass in galaxies \[2\]"):
        jobs.prepare({"stars": lost}, galaxy, path)
    store = GalaxyStore(spark, path)
    assert [r.galaxy_id for r in store.manifest().collect()] == [1] and store.read("stars").count() == 3
    # a write that ended before its commit leaves rows that nobody reads
    store._read("data/stars").where("galaxy_id = 2").withColumn("batch", F.lit("lost")).write.partitionBy("batch").mode("append").parquet(f"{path}/data/stars")
    assert store.read("stars").count() == 3
    assert masses(jobs.prepare(raw, galaxy, path)) == {g: [1.0, 2.0, 3.0] for g in (1, 2, 3)}


def test_store_reads_only_the_asked_galaxies(spark, tmp_path):
    path = str(tmp_path / "store")
    for g in (1, 2, 3):
        jobs.prepare(*several_galaxies(spark, [g]), path)
    asked = GalaxyStore(spark, path).read("stars", spark.createDataFrame([(2,)], "galaxy_id long"))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(galaxy_id, [2])" in plan or "EqualTo(galaxy_id,2)" in plan
    assert len({f.rsplit("/", 2)[1] for f in asked.inputFiles()}) >= 1 and [r.galaxy_id for r in asked.collect()] == [2] * 3
    with pytest.raises(ValueError, match="no gas"):
        GalaxyStore(spark, path).read("gas")


def test_galaxy_table_is_checked(spark):
    raw, galaxy = several_galaxies(spark, [1])
    with pytest.raises(ValueError, match="redshift"):
        jobs.prepare(raw, galaxy.drop("redshift"))
    with pytest.raises(ValueError, match="none of the expected"):
        jobs.prepare(raw, galaxy.select("galaxy_id"))
    with pytest.raises(ValueError, match="unit"):
        I.validate_galaxy(galaxy, with_units=True)
    with pytest.raises(ValueError, match="metals"):
        D.with_abundances(raw["stars"])


def test_missing_vectors_are_zero_vectors(spark):
    raw = spark.createDataFrame([(0, 1, 2.0, 0.5)], "galaxy_id long, particle_id long, mass double, metals double")
    with pytest.warns(UserWarning, match="zero"):
        row = I.vector_columns(jobs.canonical({"stars": raw}, "pynbody")["stars"]).first()
    assert (row.x, row.y, row.z, row.vx, row.vy, row.vz, row.age, row.mass) == (0, 0, 0, 0, 0, 0, 0, 2.0)


def test_pynbody_layout(spark):
    raw = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0], 2.0, [1.0, 0.0, 0.0], 4.0)], "galaxy_id long, particle_id long, pos array<double>, mass double, vel array<double>, tform double")
    with pytest.warns(UserWarning, match="zero"):
        row = I.vector_columns(jobs.canonical({"stars": raw}, "pynbody")["stars"]).first()
    assert (row.x, row.vz, row.metallicity, row.age) == (1.0, 0.0, 0.0, 4.0)


def test_particle_order_and_cosmology_of_galaxies(spark):
    df = points(spark, [(1, 1, z) for z in (3, 1, 2)]).withColumn("spaxel", F.lit(0))
    assert [r.z for r in P.sort_columns(df).collect()] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("where", ["Coordinates", "Coordinate", "NaN", "GFM_InitialMass"])
def test_prepare_refuses_particles_without_place_or_mass(spark, where):
    """With a store or without one; a galaxy that is not asked for may have them."""
    raw, galaxy = several_galaxies(spark, [1, 2])
    one = (F.col("galaxy_id") == 2) & (F.col("particle_id") == 1)
    column = "Coordinates" if where in ("Coordinate", "NaN") else where
    lost = {"Coordinate": F.array(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0)), "NaN": F.array(F.lit(0.0), F.lit(0.0), F.lit(float("nan")))}.get(where, F.lit(None))
    broken = {"stars": raw["stars"].withColumn(column, F.when(~one, F.col(column)).otherwise(lost.cast(raw["stars"].schema[column].dataType)))}
    with pytest.raises(ValueError, match=r"without place or mass in galaxies \[2\]"):
        jobs.prepare(broken, galaxy)
    assert jobs.prepare(broken, galaxy.where("galaxy_id = 1")).stars.count() == 3
    report = I.validate_groups(jobs.canonical(raw))["stars"].orderBy("galaxy_id").collect()
    assert [(r.galaxy_id, r.rows, r.mass_null) for r in report] == [(1, 3, 0), (2, 3, 0)]


def test_particles_are_not_shuffled_by_galaxy(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k % 3, k, *map(float, row)) for k, row in enumerate(rng.normal(0, 3, (600, 6)))]
    df = spark.createDataFrame(rows, "galaxy_id long, particle_id long, x double, y double, z double, vx double, vy double, vz double").withColumn("mass", F.lit(1.0))
    galaxy = df.groupBy("galaxy_id").agg(F.array(*[F.lit(0.5)] * 3).alias("center"), F.lit(5.0).alias("halfmassrad_stars"))
    calls = {
        "center": lambda: P.recenter(df, galaxy),
        "orient": lambda: G.orient(df, galaxy, "edge-on"),
        "subset": lambda: P.subset(df, 600),
        "galaxy": lambda: P.with_galaxy(df, galaxy),
    }
    plain = lambda out: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.drop("center").collect()])
    whole = {}
    for name, call in calls.items():
        out, plan = call(), call()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and (name == "subset" or "hashpartitioning(galaxy_id" not in plan)  # a subset ranks what is left
        whole[name] = plain(out)
        assert len(whole[name]) == 600
    monkeypatch.setattr("spaxelflow.sources.galaxies.BROADCAST_ROWS", 1)  # with more galaxies than that they are
    for name, call in calls.items():
        assert "SortMergeJoin" in call()._jdf.queryExecution().executedPlan().toString()
        assert plain(call()) == whole[name]


def test_a_large_galaxy_is_written_in_parts_of_bounded_size(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50k")
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.lit(0).alias("galaxy_id"), F.col("id").alias("particle_id"), F.rand(1).alias("mass"))
        rows = rows.unionByName(spark.range(30).select(F.col("id").cast("int").alias("galaxy_id"), F.lit(-1).cast("long").alias("particle_id"), F.lit(1.0).alias("mass")))
        store = GalaxyStore(spark, str(tmp_path / "store"))
        store.add({"stars": rows}, rows.select("galaxy_id").distinct())
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "store" / "data" / "stars").rglob("*.parquet"))
    assert len(files) > 4 and max(spark.read.parquet(str(f)).count() for f in files) < 8000  # the session has 4 partitions
    assert store.read("stars").count() == 20_030 and store.read("stars", spark.range(3, 5).withColumnRenamed("id", "galaxy_id")).count() == 2
