"""Region filters from GeoJSON: rings of polygons and multipolygons without holes."""

from __future__ import annotations

import json

Ring = list[tuple[float, float]]


def rings_of(shape: dict) -> list[Ring]:
    """Rings of a Feature, FeatureCollection, geometry, or an object that holds one under `geometry`."""
    kind = shape.get("type")
    if kind == "FeatureCollection":
        return [r for f in shape.get("features", []) for r in rings_of(f)]
    if kind == "Feature" or (kind is None and "geometry" in shape):
        return rings_of(shape.get("geometry") or {})
    if kind == "Polygon":
        parts = [shape.get("coordinates", [])]
    elif kind == "MultiPolygon":
        parts = shape.get("coordinates", [])
    else:
        raise ValueError(f"regions must be polygons, not {kind}")
    out = []
    for rings in parts:
        if len(rings) != 1:
            raise ValueError("regions with holes, or without a ring, are not supported")
        if any(len(p) < 2 for p in rings[0]):
            raise ValueError("a position needs two numbers")
        out.append([(float(p[0]), float(p[1])) for p in rings[0]])
    return out


def read_regions(path: str) -> list[Ring]:
    with open(path, encoding="utf-8") as f:
        return rings_of(json.load(f))


def boxes_of(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)) for r in rings]
