"""Shapes: projected coordinates, grid cells, points in polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_projected(x: Column, y: Column) -> Column:
    """Coordinates beyond what longitude and latitude can be."""
    return F.coalesce((F.abs(x) > 360) | (F.abs(y) > 180), F.lit(False))


def vertices(rings: Column) -> Column:
    """Vertices of nested rings."""
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + F.size(ring))


def grid_cells(shapes: DataFrame, size: float) -> DataFrame:
    """(id, cx, cy, ring) for each grid cell that a shape's box touches. ``ring`` is an array of struct(x, y), not closed."""
    of = lambda pick, c: F.floor(pick(F.transform("ring", lambda p: p[c])) / size)
    spans = shapes.withColumns({"x0": of(F.array_min, "x"), "x1": of(F.array_max, "x"), "y0": of(F.array_min, "y"), "y1": of(F.array_max, "y")})
    return spans.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1"))).select("id", "ord", "cx", "cy", "ring")


def hit_test(points: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """Per point the shape, drawn last (by ``ord``), that holds it, by the even-odd rule; points in none are left out.
    Points and shapes meet by grid cell, so no point is tested against shapes far off. ``points`` has key, x, y."""
    cells = grid_cells(shapes, size)
    near = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).join(cells, ["cx", "cy"])
    n = F.size("ring")
    edges = F.transform("ring", lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get("ring", (i + 1) % n)["x"].alias("bx"), F.get("ring", (i + 1) % n)["y"].alias("by")))
    y = F.col("y")
    crossed = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (F.col("x") < F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]))
    return near.filter(F.size(crossed) % 2 == 1).groupBy("key").agg(F.max_by("id", "ord").alias("id"))


_RING = "array<struct<x:double,y:double>>"


def _thin_line(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line farther apart than the tolerance, and of those the ones that stray from the chords by more."""
    if len(line) <= 2:
        return line
    least, kept = tolerance * tolerance, [0]
    for i in range(1, len(line)):
        if ((line[i] - line[kept[-1]]) ** 2).sum() > least:
            kept.append(i)
    if (line[kept[-1]] != line[-1]).any():
        kept.append(len(line) - 1)
    line = line[kept]
    stays = np.zeros(len(line), bool)
    stays[[0, -1]] = True
    spans = [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        inner, chord = line[a + 1 : b] - line[a], line[b] - line[a]
        long = chord @ chord
        along = np.clip(inner @ chord / long, 0, 1) if long else np.zeros(len(inner))
        off = ((inner - along[:, None] * chord) ** 2).sum(axis=1)
        far = int(off.argmax())
        if off[far] > least:
            stays[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return line[stays]


def _thin_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """As a line, but closed again, with three points at least and four with the closing one."""
    if len(ring) <= 4:
        return ring
    body = ring[:-1] if (ring[0] == ring[-1]).all() else ring
    thin = _thin_line(body, tolerance)
    thin = body[:3] if len(thin) < 3 else thin
    return np.vstack([thin, thin[:1]])


def simplified(rings: DataFrame, tolerance: float, closed: bool = True) -> DataFrame:
    """``ring`` (array of struct(x, y)) thinned by distance, then by Douglas and Peucker's rule, to one decimal. A ring is
    one row, so its points meet in one task by nature. Null and empty rings stay as they are."""
    thin = _thin_ring if closed else _thin_line

    @F.pandas_udf(_RING)
    def run(col: pd.Series) -> pd.Series:
        out = []
        for ring in col:
            points = np.array([(p["x"], p["y"]) for p in ring] if ring is not None and len(ring) else [], float).reshape(-1, 2)
            done = points if not len(points) else thin(points, tolerance).round(1)
            out.append(None if ring is None else [{"x": x, "y": y} for x, y in done.tolist()])
        return pd.Series(out)

    return rings.withColumn("ring", run(F.col("ring").cast(_RING)))


def simplification_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: points and JSON bytes of all rings before and after, and by how many percent the bytes fell."""
    said = lambda rows, name: rows.agg(F.coalesce(F.sum(F.size("ring").cast("long")), F.lit(0)).alias(f"points_{name}"), F.coalesce(F.sum(F.length(F.to_json("ring")).cast("long")), F.lit(0)).alias(f"bytes_{name}"))
    both = said(before, "before").crossJoin(said(after, "after"))  # one row each
    return both.withColumn("reduction_pct", F.coalesce(F.round(100 * (1 - F.try_divide("bytes_after", "bytes_before")), 2), F.lit(0.0)))


def border_kinds(sides: DataFrame) -> DataFrame:
    """Per arc what it parts, from ``sides`` (arc, id, province, region), a row for each shape the arc bounds: outline,
    region, province or municipality. An arc of one shape alone is outline; null codes equal each other."""
    differ = lambda c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) > 1
    seen = sides.groupBy("arc").agg((F.count_distinct("id") < 2).alias("one"), differ("region").alias("r"), differ("province").alias("p"))
    return seen.select("arc", F.when(F.col("one"), "outline").when(F.col("r"), "region").when(F.col("p"), "province").otherwise("municipality").alias("kind"))


def with_layer_names(places: DataFrame, provinces: DataFrame, regions: DataFrame) -> DataFrame:
    """``places`` (province_code, region_code, ...) with province_name and region_name; codes that are unknown give null.
    Spark broadcasts the two code tables where their size allows."""
    return places.join(provinces.select("province_code", "province_name"), "province_code", "left").join(regions.select("region_code", "region_name"), "region_code", "left")
