"""G01 over shared borders: shapes are cut into arcs where borders meet, each arc is simplified once, and rings are put together
again, so neighbours keep one border."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.panel_store import stored
from .geo import _RING, simplified

_ARCS = f"id string, ring int, k int, turned boolean, loop boolean, arc {_RING}"


def _tidy(shapes: DataFrame) -> DataFrame:
    """Rings with their closing point and without points that repeat the one before; rings of fewer than three are left out."""
    rows = shapes.select(F.col("id").cast("string").alias("id"), F.col("ring").cast("int").alias("ring"), F.filter(F.col("points").cast(_RING), lambda p: p.isNotNull()).alias("points"))
    rows = rows.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    rows = rows.withColumn("points", F.filter("points", lambda p, i: (i == 0) | (p != F.get("points", i - 1))))
    return stored(rows, "rings").filter(F.size("points") > 3)  # written, so that no ring is made again for each use of its points


def _sides() -> Column:
    """The sides (a, b) of closed ``points`` in order."""
    n = F.size("points") - 1
    return F.zip_with(F.slice("points", 1, n), F.slice("points", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for id_, ring, points in zip(batch["id"], batch["ring"], batch["points"], strict=True):
            at = [(p["x"], p["y"], p["joint"]) for p in points]  # in order, without the closing point
            joints = [i for i, p in enumerate(at) if p[2]]
            loop = not joints
            start = min(range(len(at)), key=lambda i: at[i]) if loop else joints[0]
            walk = [p[:2] for p in at[start:] + at[: start + 1]]
            cuts = [0, len(walk) - 1] if loop else [*(i - start for i in joints), len(walk) - 1]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                arc = walk[a : b + 1]
                turned = arc[::-1] < arc
                out.append((id_, ring, k, turned, loop, [{"x": x, "y": y} for x, y in (arc[::-1] if turned else arc)]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ARCS.split(", ")]).astype({"ring": "int32", "k": "int32"})


def arcs(shapes: DataFrame) -> DataFrame:
    """(id, ring, k, turned, loop, arc, arc_id) of ``shapes`` (id, ring, points): the arcs of each ring in order. Rings are cut
    at points that have other than two neighbours on any border; an arc runs from its smaller end, ``turned`` where the ring
    runs the other way. Arcs of several rings are equal point by point and share ``arc_id``."""
    rings = _tidy(shapes)
    sides = rings.select("id", "ring", F.posexplode(_sides()).alias("i", "s")).select("id", "ring", "i", F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b"))
    near = sides.select("a", "b").unionByName(sides.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    joints = near.groupBy("a").agg((F.count(F.lit(1)) != 2).alias("joint"))
    marked = sides.select("id", "ring", "i", "a").join(joints, "a")
    whole = marked.groupBy("id", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a.x", "a.y", "joint"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["joint"].alias("joint"))).alias("points"))
    return whole.mapInPandas(_split, _ARCS).withColumn("arc_id", F.sha2(F.to_json(F.struct("arc", "loop")), 256))


def _assembled(used: DataFrame, thin: DataFrame) -> DataFrame:
    """(id, ring, points): rings of their arcs in ``thin`` (arc_id, points), closed."""
    part = F.when(F.col("turned"), F.reverse("points")).otherwise(F.col("points"))
    rows = used.join(thin, "arc_id").select("id", "ring", F.struct("k", part.alias("p")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list("part")), lambda x: F.slice(x["p"], 1, F.size(x["p"]) - 1))
    whole = rows.groupBy("id", "ring").agg(F.flatten(parts).alias("points"))
    return whole.select("id", "ring", F.concat("points", F.slice("points", 1, 1)).alias("points"))


def simplified_shapes(shapes: DataFrame, tolerance: float) -> DataFrame:
    """``shapes`` (id, ring, points) simplified by ``geo.simplified`` arc by arc. A ring that would keep fewer than three corners
    keeps its arcs as they are, and so do the neighbours along them. Rings of fewer than three points are left out."""
    return simplified_arcs(stored(arcs(shapes), "arcs"), tolerance)


def simplified_arcs(used: DataFrame, tolerance: float) -> DataFrame:
    """The simplified shapes of arcs that are written somewhere, as they are read several times."""
    once = used.groupBy("arc_id").agg(F.any_value("arc").alias("ring"), F.any_value("loop").alias("loop"))
    thin = simplified(once.filter("not loop"), tolerance, closed=False).unionByName(simplified(once.filter("loop"), tolerance)).select("arc_id", F.col("ring").alias("points"))
    plain = once.select("arc_id", F.transform("ring", lambda p: F.struct(F.round(p["x"], 1).alias("x"), F.round(p["y"], 1).alias("y"))).alias("own"))
    thin = stored(thin, "thin-arcs")
    flat = _assembled(used, thin).filter(F.size(F.array_distinct("points")) < 3).select("id", "ring")
    kept = used.join(flat, ["id", "ring"], "left_semi").select("arc_id", F.lit(True).alias("whole")).distinct()
    thin = thin.join(kept, "arc_id", "left").join(plain, "arc_id").select("arc_id", F.when(F.col("whole"), F.col("own")).otherwise(F.col("points")).alias("points"))
    return _assembled(used, thin)


def border_uses(shapes: DataFrame) -> DataFrame:
    """(a, b, uses): every side of the rings, whichever way it runs, and how many rings have it."""
    rows = shapes.select(F.explode(_sides()).alias("s")).select("s.a", "s.b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"))
