"""Tables with one row, or a few, for each galaxy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def beside_particles(table: DataFrame) -> DataFrame:
    """The table as it best meets the particles in a join. Up to BROADCAST_ROWS rows it is worked out once and broadcast, so that
    particles stay in their partitions; a shuffle by galaxy would bring all of a galaxy's to one task. A longer one is joined by
    a shuffle, as it is."""
    rows = table.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema, verifySchema=False))
