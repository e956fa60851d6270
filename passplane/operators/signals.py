"""Scores of signals that are measured elsewhere (codecs, detectors): from the measures to 0 to 1, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_level(std: Column, highest: Column, average: Column) -> Column:
    """Uneven compression error over a grid of regions."""
    return F.when((std > 80) | (highest > average * 3.5), F.greatest(F.lit(0.1), 1 - std / 200)).otherwise(1.0)


def consistent_outliers(regions: Column) -> Column:
    """Regions whose compression error stands out at every quality."""
    return F.when(regions >= 2, F.greatest(F.lit(0.10), 1 - regions * 0.12)).otherwise(1.0)


def face_ring(density: Column) -> Column:
    """Edges in a ring around a face."""
    return F.when(density > 0.11, F.greatest(F.lit(0.1), 0.55 - 5 * (density - 0.11))).otherwise(1.0)


def border_noise(inner: Column, outer: Column) -> Column:
    """Noise inside a portrait's border against outside."""
    ratio = (inner + 0.01) / (outer + 0.01)
    return F.when((ratio > 3.2) | (ratio < 0.30), F.greatest(F.lit(0.0), 1 - F.abs(F.ln(ratio)) / 2)).otherwise(1.0)


def zone_error_level(photo: Column, rest: Column) -> Column:
    """Compression error of a portrait against the rest."""
    ratio = photo / (rest + 0.01)
    return F.when((ratio > 2.2) | (ratio < 0.45), F.greatest(F.lit(0.05), 1 - F.abs(F.ln(ratio + 0.01)) / 2)).otherwise(1.0)


def background(edges: Column, std: Column) -> Column:
    """Edges and variation in the margins."""
    return F.when((edges > 0.20) | (std > 95), F.greatest(F.lit(0.0), 1 - edges * 2 - (std - 95) / 150)).otherwise(1.0)


def perspective(level: Column, upright: Column, diagonal: Column) -> Column:
    """The share of lines along the axes, where it is low; 0.85 without lines."""
    total = level + upright + diagonal
    share = (level + upright) / total
    return F.when(total == 0, 0.85).when(share < 0.60, share).otherwise(1.0)


def screen(blue_green: Column, green_red: Column, laplacian: Column, banding: Column) -> Column:
    """Channels alike, no grain, bands: each costs little alone and much together."""
    signs = [(blue_green < 4) & (green_red < 3), laplacian < 8, banding < 5]
    together = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2
    loss = [F.when(s, F.when(together, much).otherwise(little)).otherwise(0.0) for s, much, little in zip(signs, (0.30, 0.35, 0.20), (0.08, 0.10, 0.08), strict=True)]
    return F.greatest(F.lit(0.0), 1 - loss[0] - loss[1] - loss[2])
