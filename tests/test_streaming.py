"""Incremental cubes against the batch sum, over restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spaxelflow.operators import cube as C
from spaxelflow.operators import spectra as S
from spaxelflow.streaming import cubes

SCHEMA = "galaxy_id long, spaxel int, flux array<double>"


def same(found, wanted):
    a, b = ({(r.galaxy_id, r.spaxel): r.flux for r in df.collect()} for df in (found, wanted))
    return a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_incremental_sum_equals_the_batch_sum_after_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(s), rng.random(5).tolist()) for g, s in zip(rng.integers(0, 2, 600), np.where(rng.random(600) < 0.4, 1, rng.integers(0, 6, 600)))]
    df = spark.createDataFrame(rows, SCHEMA)
    arrived, path, checkpoint = (str(tmp_path / n) for n in ("arrived", "cube", "state"))
    for k, part in enumerate((rows[:300], rows[300:301], rows[301:])):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(arrived)
        query = cubes.keep_cube(cubes.incremental_cube(cubes.arriving(spark, arrived, SCHEMA)), path, checkpoint)  # a new query each time
        query.awaitTermination()
        assert query.exception() is None
        seen = rows[: (300, 301, 600)[k]]
        assert same(cubes.kept_cube(spark, path), C.accumulate_cube(spark.createDataFrame(seen, SCHEMA)))
    assert same(cubes.kept_cube(spark, path), C.accumulate_cube(df))
    # nothing new: nothing changes
    cubes.keep_cube(cubes.incremental_cube(cubes.arriving(spark, arrived, SCHEMA)), path, checkpoint).awaitTermination()
    assert same(cubes.kept_cube(spark, path), C.accumulate_cube(df))


def test_arriving_stars_to_a_cube(spark, tmp_path):
    rng = np.random.default_rng(4)
    stars = spark.createDataFrame([(0, k % 3, float(rng.uniform(0, 0.04)), float(rng.uniform(0, 9)), 1.0, float(k)) for k in range(60)], "galaxy_id long, spaxel int, metallicity double, age double, mass double, vz double")
    grid = (np.array([0.0, 0.02, 0.05]), np.array([0.0, 5.0, 10.0]), rng.random((3, 3, 8)))
    wave, target = np.arange(8.0) + 20, np.arange(6.0) + 21
    arrived, path, checkpoint = (str(tmp_path / n) for n in ("arrived", "cube", "state"))
    for part in (stars.where("vz < 25"), stars.where("vz >= 25")):
        part.write.mode("append").parquet(arrived)
        spectra = S.star_cube(cubes.arriving(spark, arrived, stars.schema), grid, wave, target, method="linear")
        cubes.keep_cube(cubes.incremental_cube(spectra), path, checkpoint).awaitTermination()
    assert same(cubes.kept_cube(spark, path), C.add_cubes(S.star_cube(stars, grid, wave, target, method="linear")))


def test_null_spectra_add_nothing(spark, tmp_path):
    spark.createDataFrame([(0, 0, [1.0]), (0, 0, None), (0, 1, None)], SCHEMA).write.parquet(str(tmp_path / "arrived"))
    made = cubes.incremental_cube(cubes.arriving(spark, str(tmp_path / "arrived"), SCHEMA))
    cubes.keep_cube(made, str(tmp_path / "cube"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in cubes.kept_cube(spark, str(tmp_path / "cube")).select("galaxy_id", "spaxel", F.get("flux", F.lit(0))).collect()] == [(0, 0, 1.0)]
