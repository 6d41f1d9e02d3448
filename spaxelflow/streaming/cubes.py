"""Cubes that grow as snapshots arrive: a running sum of spectra for each (galaxy, spaxel).

Each task adds its own spectra first, so a spaxel's state meets one partial spectrum a task, however many stars it gets. The
state lies in the query's checkpoint; updated spaxels are written by batch number, so that a batch that runs twice is written
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cube import CUBE_SCHEMA, _partial_sums


def arriving(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """Snapshots that arrive as Parquet files under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total = np.frombuffer(state.get[0], float).copy() if state.exists else None
    for part in parts:
        for flux in part.flux:
            total = np.array(flux, float) if total is None else total + flux
    state.update((total.tobytes(),))
    yield pd.DataFrame({"galaxy_id": [key[0]], "spaxel": [key[1]], "flux": [total]})


def incremental_cube(spectra: DataFrame) -> DataFrame:
    """A stream of spectra (galaxy_id, spaxel, flux), as star_cube() makes them of arriving stars, to a stream of the spaxels that
    each batch changed, with their sums so far (output mode update). Spectra that are null add nothing; all spectra of a spaxel
    have one length."""
    given = spectra.select(F.col("galaxy_id").cast("long").alias("galaxy_id"), F.col("spaxel").cast("int").alias("spaxel"), F.col("flux").cast("array<double>").alias("flux")).where("flux is not null")
    partial = given.mapInArrow(_partial_sums, CUBE_SCHEMA)
    return partial.groupBy("galaxy_id", "spaxel").applyInPandasWithState(_add, CUBE_SCHEMA, "flux binary", "update", GroupStateTimeout.NoTimeout)


def keep_cube(cube: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs incremental_cube() over all that has arrived and ends; the next call with the same checkpoint goes on from there.
    Updated spaxels lie under path/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cube.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def kept_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube so far: each spaxel as its last batch left it."""
    return spark.read.parquet(path).groupBy("galaxy_id", "spaxel").agg(F.max_by("flux", "batch").alias("flux"))
