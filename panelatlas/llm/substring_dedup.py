"""Repeated passages by level-wise doubling: windows repeated at one length alone are extended to twice that length.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, unchanged. Every window of ``window`` words holds a shortest-level
window (a quarter of it, rounded up) whose hash is its minimum; two equal windows hold the same one at the same place. So

1. of the shortest length only these minima, the anchors (about a fifteenth of all words), are counted over all texts;
2. anchors found more than once are extended to twice the length, to the left and to the right, and counted again;
3. where one of the two is repeated, the windows of full length around the anchor are counted, and those found more than
   once, in the same text or another, are the repeated windows. What is found once at a level goes no further.

Each word that a repeated window covers is removed. Counts are partial first; those of anchors and of whole windows are written out before
they are joined, so that Spark's adaptive execution can split the rows of a passage that a third of all texts share (a join
with an aggregate of the same stage can't be split). Windows and texts are told apart by hashes of 64 bits: n distinct ones
make a false match with a chance of about n * n / 2^65, one in 3700 for 10^8; beyond some 10^9 false matches come up.

Null and empty texts have no words. Repeated rows are repeated texts: from ``window`` words on they are removed whole,
in each. Texts of fewer words keep them all. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_from, materialise, text_bytes

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 200_000:  # a bound on memory only
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_KNOWN = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of a text's windows of any length, made from those of half the length."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.levels = {1: _mix(np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=self.n))}

    def of(self, length: int) -> np.ndarray:
        """Hash of each window of ``length`` words, by its start; none if the text is shorter."""
        if self.n < length:
            return np.zeros(0, dtype=np.uint64)
        if length not in self.levels:
            half = (length + 1) // 2
            h = self.of(half)
            self.levels[length] = _mix(h[: self.n - length + 1] * _A + h[length - half :] + np.uint64(length))
        return self.levels[length]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the minimum of some run of ``width`` values."""
    low = _slide(h, width, np.minimum)
    high = _slide(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    return np.flatnonzero(high == h)


def lengths(window: int) -> tuple[int, int, int]:
    """The levels: a quarter, a half (twice the quarter) and the whole."""
    short = max(1, -(-window // 4))
    return short, min(2 * short, window), window


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.flags.c_contiguous else np.ascontiguousarray(x).view(np.int64))


def _first(window: int) -> Callable:
    short, double, _ = lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for s, i in zip(batch.column(0).to_pylist(), range(len(texts))):
                w = Windows(texts[i].as_py().split())
                if w.n < window:
                    continue
                at = anchors(w.of(short), window - short + 1)
                long = w.of(double)
                half = (long >> np.uint64(32)).astype(np.int64)
                right = np.where(at < len(long), half[np.minimum(at, len(long) - 1)], -1)  # -1: the text ends before
                left = np.where(at >= double - short, half[np.maximum(at - (double - short), 0)], -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at.astype(np.int32)), _signed(w.of(short)[at]), pa.array(right), pa.array(left)], names=["s", "at", "h", "right", "left"])

    return _grouped(run)


def _grouped(run: Callable, rows: int = 50_000) -> Callable:
    """Hand on larger batches than one for each text."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in run(batches):
            held.append(x)
            n += x.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _full(window: int) -> Callable:
    short = lengths(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(s, text, places of anchors that are left) -> (s, start, hash) of the windows whose minimum is such an anchor."""
        for batch in batches:
            for s, raw, places in zip(*(c.to_pylist() for c in batch.columns)):
                w = Windows(raw.split())
                if w.n < window:
                    continue
                h, width = w.of(short), window - short + 1
                marked = np.full(len(h), np.uint64(0xFFFFFFFFFFFFFFFF))
                places = np.array(places)
                marked[places] = h[places]
                # Some left anchor in the window has the window's minimum.
                start = np.flatnonzero((_slide(h, width, np.minimum) == _slide(marked, width, np.minimum)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), s)), pa.array(start.astype(np.int32)), _signed(w.of(window)[start])], names=["s", "start", "h"])

    return _grouped(run)


def _cut(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = raw.split()
                kept = words
                if starts:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            n, gone, sha, text = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)


def _extended(again: DataFrame) -> DataFrame:
    """Anchors whose window of twice the length, to the right or to the left, is repeated."""
    right, left = (_repeated(again.filter(f"{k} >= 0"), ["h", k]).withColumn(f"found_{k}", F.lit(True)) for k in ("right", "left"))
    return again.join(right, ["h", "right"], "left").join(left, ["h", "left"], "left").filter("found_right or found_left").select("s", "at")


def _dealt(rows: DataFrame, of: Column, heavy: DataFrame) -> DataFrame:
    """``rows`` with a ``part``: one of those of its text, if many rows have the text."""
    return rows.join(F.broadcast(heavy), "s", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(of), F.col("parts"))).cast("int")).drop("parts")


def _to_all_parts(index: DataFrame, heavy: DataFrame) -> DataFrame:
    return index.join(F.broadcast(heavy), "s", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def remove_repeats(documents: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.withColumn("s", F.xxhash64("text"))
    first = materialise(rows.select("s", "text").mapInArrow(_first(window), "s long, at int, h long, right long, left long"), "windows-1", compression="zstd")
    again = materialise(first.join(materialise(_repeated(first, ["h"]), "windows-h"), "h"), "windows-2", compression="zstd")
    places = _extended(again).groupBy("s").agg(F.collect_set("at").alias("places"))  # at most a text's own words

    # Rows of a text that many have are dealt into parts, each with a copy of what is known of the text.
    texts = materialise(rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "windows-texts")
    per = heavy_from(texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    heavy = texts.filter(F.col("n") > per).select("s", F.ceil(F.col("n") / per).cast("int").alias("parts"))
    dealt = _dealt(rows, F.col("doc_id"), heavy)
    third = dealt.join(_to_all_parts(places, heavy), ["s", "part"]).select("s", "text", "places")
    third = materialise(third.mapInArrow(_full(window), "s long, start int, h long"), "windows-3", compression="zstd")
    starts = third.join(materialise(_repeated(third, ["h"]), "windows-4"), "h").groupBy("s").agg(F.collect_set("start").alias("starts"))
    joined = dealt.join(_to_all_parts(starts, heavy), ["s", "part"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
