"""Spatial event panels on Spark: cleaning, text classing, grids, terrain, networks, models."""
