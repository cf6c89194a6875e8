"""Fragmenting a stream of quads."""
