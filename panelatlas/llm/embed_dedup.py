"""Embedding near-duplicates by a subspace pigeonhole join, exact.

Unit vectors with cosine at least c differ by at most ``B = 2 - 2c`` in squared distance. After a fixed random rotation the
dimensions are cut into ``blocks`` low-dimensional blocks; the squared distances of the blocks add up to that of the
vectors, so in at least one block it is at most ``B / blocks``, that block's proportional budget. Each block is
range-joined on its own: a grid of cells as wide as the budget's radius lies over its first ``grid`` coordinates, and only
equal or neighbouring cells meet. Cells with more than ``tile_rows`` vectors are cut into tiles, each pair of tiles a group
of its own, so no group grows with the data. Candidates that pass a block's budget are verified by the exact cosine in
double precision, and a link is counted in the first block whose budget it keeps, once.

A group gives sums of links per vector and links that span its components, never all pairs. Identical vectors are one
class with a count and are not compared with each other.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null identifier, link with
nothing; vectors of different lengths don't either. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .graph import components


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rotate(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``x @ r`` summed in one order, so a vector gets the same coordinates in every task."""
    out = np.zeros_like(x)
    for j in range(x.shape[1]):
        out += x[:, j : j + 1] * r[j]
    return out


def _edges(dim: int, blocks: int) -> list[int]:
    blocks = min(blocks, dim)
    return [dim * k // blocks for k in range(blocks + 1)]


def _cells(x: np.ndarray, lo: int, hi: int, radius: float, grid: int) -> np.ndarray:
    """Cell number of each vector in one block; neighbours differ by at most one step a coordinate."""
    side = 2 * math.ceil(1 / radius) + 4
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(grid):
        at = np.floor(x[:, lo + k] / radius).astype(np.int64) + side // 2 if lo + k < hi else side // 2
        out = out * side + at
    return out


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], list[bytes]]]:
    """(dim, identifiers, sizes, raw vectors) of a batch's rows (rep, n, raw)."""
    ids, sizes, raws = (c.to_pylist() for c in batch.columns)
    groups: dict[int, list[int]] = {}
    for i, raw in enumerate(raws):
        groups.setdefault(len(raw) // 8, []).append(i)
    for dim, at in groups.items():
        yield dim, [ids[i] for i in at], [sizes[i] for i in at], [raws[i] for i in at]


def _to_raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, raw): little-endian doubles, null where the vector links with nothing."""
    for batch in batches:
        raws = []
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ok = vec_id is not None and v and None not in v
            x = np.array(v, dtype="<f8") if ok else np.zeros(0)
            raws.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], names=["vec_id", "raw"])


def _count_cells(radius2: float, blocks: int, grid: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, _, raw in _by_dim(batch):
                x, e = _rotate(_unit(raw), rotation(dim)), _edges(dim, blocks)
                radius = math.sqrt(radius2 / (len(e) - 1))
                for b in range(len(e) - 1):
                    cell, n = np.unique(_cells(x, e[b], e[b + 1], radius, grid), return_counts=True)
                    k = len(cell)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, dim)), pa.array(np.full(k, b)), pa.array(cell), pa.array(n)], names=["dim", "b", "cell", "n"])

    return run


def _deal(radius2: float, blocks: int, grid: int, tile_rows: int, counts: dict[tuple[int, int, int], int]) -> Callable:
    """Send each vector to every pair of tiles that it takes part in."""
    names = ["dim", "b", "ca", "cb", "ta", "tb", "side", "rep", "n", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, sizes, raw in _by_dim(batch):
                x, e = _rotate(_unit(raw), rotation(dim)), _edges(dim, blocks)
                radius = math.sqrt(radius2 / (len(e) - 1))
                side = 2 * math.ceil(1 / radius) + 4
                steps = [sum(d * side ** (grid - 1 - k) for k, d in enumerate(s)) for s in product((-1, 0, 1), repeat=grid)]
                for b in range(len(e) - 1):
                    cells = _cells(x, e[b], e[b + 1], radius, grid).tolist()
                    out: list[tuple] = []
                    for i, c in enumerate(cells):
                        n_own = -(-counts[dim, b, c] // tile_rows)
                        own = (ids[i] * 0x9E3779B97F4A7C15 >> 20) % n_own
                        for step in steps:
                            o = c + step
                            if o == c:
                                for t in range(n_own):
                                    lo, hi = (own, t) if own <= t else (t, own)
                                    out.append((dim, b, c, c, lo, hi, int(own != lo), ids[i], sizes[i], raw[i]))
                            elif (dim, b, o) in counts:
                                n_other = -(-counts[dim, b, o] // tile_rows)
                                if c < o:
                                    out += [(dim, b, c, o, own, t, 0, ids[i], sizes[i], raw[i]) for t in range(n_other)]
                                else:
                                    out += [(dim, b, o, c, t, own, 1, ids[i], sizes[i], raw[i]) for t in range(n_other)]
                    for at in range(0, len(out), 20_000):
                        cols = list(zip(*out[at : at + 20_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 9 else pa.int64()) for k, c in enumerate(cols)], names=names)

    return run


def tile_links(x: np.ndarray, y: np.ndarray, e: list[int], b: int, budget: float, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of x, row of y) of two tiles whose first block within the budget is ``b``; ``x``, ``y`` are (unit, rotated)."""
    (xu, xr), (yu, yr) = x, y
    xb, yb = xr[:, e[b] : e[b + 1]].astype(np.float32), yr[:, e[b] : e[b + 1]].astype(np.float32)
    need = (((yb * yb).sum(axis=1) - budget) / 2 - 1e-5)[None, :]
    half = (xb * xb).sum(axis=1)[:, None] / 2
    for at in range(0, len(xb), 256):
        i, j = np.nonzero(xb[at : at + 256] @ yb.T - half[at : at + 256] >= need)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65_536):
            p, q = i[k : k + 65_536], j[k : k + 65_536]
            ok = (xu[p] * yu[q]).sum(axis=1) >= cosine
            p, q = p[ok], q[ok]
            d = (xr[p] - yr[q]) ** 2
            within = np.stack([d[:, lo:hi].sum(axis=1) for lo, hi in zip(e, e[1:])], axis=1) <= budget * (1 + 1e-9) + 1e-12
            first = within.argmax(axis=1) == b
            yield p[first], q[first]


def _join(radius2: float, blocks: int, cosine: float) -> Callable:
    def group(key: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        dim, b = key[0], key[1]
        side, ids, sizes = (t.column(k).to_numpy() for k in ("side", "rep", "n"))
        if key[2:4:1][0] == key[3] and key[4] == key[5]:
            same, left, right = True, np.arange(len(ids)), np.arange(len(ids))
        else:
            same, left, right = False, np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right) or (same and len(ids) < 2):
            return None
        u = _unit(t.column("raw").to_pylist())
        r, e = _rotate(u, rotation(dim)), _edges(dim, blocks)
        links = [np.concatenate(z) for z in zip(*tile_links((u[left], r[left]), (u[right], r[right]), e, b, radius2 / (len(e) - 1), cosine, same))]
        if not links or not len(links[0]):
            return None
        p, q = left[links[0]], right[links[1]]
        weight = np.bincount(p, sizes[q], len(ids)) + np.bincount(q, sizes[p], len(ids))
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, p, label[q])
            np.minimum.at(new, q, label[p])
            new = new[new]
            if (new == label).all():
                break
            label = new
        hit = np.flatnonzero(weight)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(weight[hit].astype(np.int64))], names=["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may reach over batches."""
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(6)], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                now = tuple(keys[lo].tolist())
                if now != key:
                    if key is not None and (out := group(key, held)) is not None:
                        yield out
                    key, held = now, []
                held.append(batch.slice(lo, hi - lo))
        if key is not None and (out := group(key, held)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, blocks: int = 4, tile_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    own = materialise(rows.mapInArrow(_to_raw, "vec_id long, raw binary"), "vectors")
    classes = materialise(own.filter("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes").select("rep", "n", "raw")
    radius2 = 2 - 2 * cosine
    grid = next((g for g, most in ((1, 100_000), (2, 2_000_000)) if classes.count() <= most), 3)
    # The number of cells is bounded by the sphere: (2 / radius + 4) ** grid a block, whatever the number of vectors.
    cells = classes.mapInArrow(_count_cells(radius2, blocks, grid), "dim long, b long, cell long, n long").groupBy("dim", "b", "cell").agg(F.sum("n").alias("n")).collect()
    counts = {(r.dim, r.b, r.cell): r.n for r in cells}
    by = ["dim", "b", "ca", "cb", "ta", "tb"]
    dealt = classes.mapInArrow(_deal(radius2, blocks, grid, tile_rows, counts), ", ".join(f"{k} long" for k in [*by, "side", "rep", "n"]) + ", raw binary")
    found = materialise(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_join(radius2, blocks, cosine), "a long, b long, w long"), "vector-links")
    sums = found.groupBy("a").agg(F.sum("w").alias("w"))
    comps = components(found.select("a", "b"))
    known = classes.select("rep", "n", "raw").join(sums, F.col("rep") == F.col("a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
    known = known.select("raw", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.join(known, "raw", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))
