"""Operators on lattice frames: DataFrame in, DataFrame out."""
