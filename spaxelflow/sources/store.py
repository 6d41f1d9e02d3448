"""A store of canonical particle tables, galaxy by galaxy, with a manifest.

    path/data/<kind>/batch=<id>/...   the rows of one write, sorted by galaxy
    path/manifest                     one row for each galaxy of a write: (galaxy_id, seq, batch, rows by kind)
    path/header                       key/value pairs of the snapshots that were written

A write puts its rows under a fresh batch and commits them by appending to the manifest, as one file. Rows of a write that
failed, or of a batch that a later one replaces for a galaxy, are there but not read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .galaxies import beside_particles

MANIFEST = "galaxy_id long, seq long, batch string, rows map<string, long>"
MODES = {"skip": "skip", "ignore": "skip", "overwrite": "overwrite", "reuse": "reuse", "error": "error", "errorifexists": "error"}
SHARE = "_share"
PUSHED_GALAXIES = 1000  # as many asked galaxies, at most, become a filter of the scan; more are a join alone


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; where that is unset, on a local master only, a
    temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder}/{uuid.uuid4().hex}"


class GalaxyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.option("mergeSchema", "true")
        try:
            return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self) -> DataFrame:
        """The commit that counts for each galaxy: its last one."""
        commits = self._read("manifest", MANIFEST)
        if commits is None:
            return self.spark.createDataFrame([], MANIFEST)
        last = Window.partitionBy("galaxy_id").orderBy(F.desc("seq"), F.desc("batch"))
        return commits.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def to_write(self, galaxies: DataFrame, mode: str) -> DataFrame:
        """galaxy_id of the galaxies that a write in this mode has to bring: `skip` those that are absent, `overwrite` all. `error`
        raises where one is there, `reuse` where one is absent."""
        if mode not in MODES:
            raise ValueError(f"mode {mode} is none of {sorted(MODES)}")
        asked, stored = galaxies.select(F.col("galaxy_id").cast("long").alias("galaxy_id")).distinct(), self.manifest().select("galaxy_id")
        kind = MODES[mode]
        if kind in ("error", "reuse"):
            wrong = asked.join(stored, "galaxy_id", "left_semi" if kind == "error" else "left_anti").limit(5).collect()
            if wrong:
                raise ValueError(f"galaxies {'already' if kind == 'error' else 'not'} in the store: {[r[0] for r in wrong]}")
        return asked if kind in ("overwrite", "error") else asked.join(stored, "galaxy_id", "left_anti")

    def add(self, tables: dict[str, DataFrame], galaxies: DataFrame, header: dict[str, object] | None = None, check=None) -> None:
        """Writes the rows of `galaxies` and commits them. A galaxy of them without any row is an error, as is what `check(kind,
        written rows)` raises; nothing is committed then. Tables' rows of other galaxies are left out."""
        batch, counts, galaxies = uuid.uuid4().hex, None, beside_particles(galaxies)
        for kind, df in tables.items():
            rows = df.withColumn("galaxy_id", F.col("galaxy_id").cast("long")).join(galaxies, "galaxy_id", "left_semi")
            folder = f"data/{kind}/batch={batch}"
            rows.withColumn(SHARE, F.pmod(F.xxhash64(*[c for c in rows.columns if c != "galaxy_id"]), F.lit(16))).hint("rebalance", "galaxy_id", SHARE).drop(SHARE).sortWithinPartitions("galaxy_id").write.parquet(f"{self.path}/{folder}")
            done = self.spark.read.parquet(f"{self.path}/{folder}")
            if check:
                check(kind, done)
            own = done.groupBy("galaxy_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
            counts = own if counts is None else counts.unionByName(own)
        commits = self._read("manifest", MANIFEST)
        seq = 1 + ((commits.agg(F.max("seq")).first()[0] or 0) if commits is not None else 0)
        found = counts.groupBy("galaxy_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("rows"))
        lines = galaxies.join(found, "galaxy_id", "left").select("galaxy_id", F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"), "rows")
        empty = lines.where("rows is null").limit(5).collect()
        if empty:
            raise ValueError(f"no particles of galaxies {[r[0] for r in empty]}")
        if header:
            pairs = [(batch, k, str(v)) for k, v in header.items()]
            self.spark.createDataFrame(pairs, "batch string, key string, value string").write.mode("append").parquet(f"{self.path}/header")
        lines.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self, kind: str, galaxies: DataFrame | None = None) -> DataFrame:
        """The committed rows of a kind, of all galaxies or the asked ones; other batches and row groups are not scanned."""
        current = self.manifest().where(F.col("rows").getItem(kind).isNotNull()).select("galaxy_id", "batch")
        if galaxies is not None:
            current = current.join(galaxies.select(F.col("galaxy_id").cast("long").alias("galaxy_id")), "galaxy_id", "left_semi")
        data = self._read(f"data/{kind}")
        if data is None:
            raise ValueError(f"no {kind} in the store")
        batches = [r[0] for r in current.select("batch").distinct().collect()]  # one a write
        data, current = data.where(F.col("batch").isin(batches)), beside_particles(current)
        few = current.select("galaxy_id").limit(PUSHED_GALAXIES + 1).collect() if galaxies is not None else []
        if galaxies is not None and len(few) <= PUSHED_GALAXIES:
            data = data.where(F.col("galaxy_id").isin([r[0] for r in few]))
        return data.join(current, ["galaxy_id", "batch"], "left_semi").drop("batch")

    def header(self) -> DataFrame:
        """(galaxy_id, key, value) of the snapshot that each galaxy came with."""
        pairs = self._read("header")
        return self.manifest().select("galaxy_id", "batch").join(pairs, "batch").drop("batch")
