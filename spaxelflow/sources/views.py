"""Particle tables over the given star-schema tables: the same SQL text in Spark and DuckDB."""

from __future__ import annotations

STARS = """SELECT l_suppkey % 4 AS galaxy_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       (l_quantity - 25.5e0) / 2.5e0 AS x, (l_partkey % 199 - 99) / 10e0 AS y, (l_orderkey % 997 - 498) / 50e0 AS z,
       (l_discount - 0.05e0) * 2000e0 AS vx, (l_tax - 0.04e0) * 2000e0 AS vy, (l_linenumber - 4) * 50e0 AS vz,
       l_extendedprice AS mass, l_tax AS metallicity, (l_orderkey % 137) / 10e0 AS age FROM lineitem"""
GAS = """SELECT o_custkey % 4 AS galaxy_id, o_orderkey, (o_orderkey % 50 - 24.5e0) / 2.5e0 AS x,
       (o_custkey % 199 - 99) / 10e0 AS y, (o_orderkey % 991 - 495) / 50e0 AS z, o_totalprice AS mass,
       0.70e0 + (o_orderkey % 7) / 100e0 AS h_frac, 0.001e0 + (o_custkey % 11) / 1000e0 AS o_frac FROM orders"""


SPECTRA = ("label % 4 AS galaxy_id", "vec_id", "cast(vec_id % 25 AS int) AS spaxel", "transform(embedding, v -> abs(cast(v AS double))) AS flux")


def frame(spark, sf_dir: str, kind: str):
    """The DataFrame of `stars`, `gas` or `spectra` (galaxy_id, vec_id, spaxel, flux array<double>)."""
    if kind == "spectra":
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*SPECTRA)
    text, table = {"stars": (STARS, "lineitem"), "gas": (GAS, "orders")}[kind]
    return spark.sql(text.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
