"""Detectors, names, cells, overlap and tokens."""
