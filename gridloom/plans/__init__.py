"""Lattices and the frames on them."""
