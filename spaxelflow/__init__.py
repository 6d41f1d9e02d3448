"""Particle tables to spectral datacubes, as Spark DataFrame operations over many galaxies at once."""
