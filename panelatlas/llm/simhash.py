"""SimHash near-duplicates, linked through Burkhard-Keller trees.

Fingerprints: lower-case A-Z, words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, shingles are ``words`` consecutive
words joined by a space (repeats included; fewer words make one shingle, none make fingerprint zero). Each shingle's
XXH64 with seed 42 votes on each bit; a bit is one if set in over half the hashes.

Links: two fingerprints within ``radius`` bits agree on some ``match`` of ``radius + match`` blocks that the 64 bits are
cut into. So a shard is one choice of blocks with their bits, and every link lies within some shard. ``match`` grows with
the number of distinct fingerprints and keeps shards small. A shard's fingerprints go into one BK-tree, whose children are
keyed by their distance to the parent, and a search follows only the edges within the radius. What it finds goes into a
forest, and the shard hands on each fingerprint's link with the smallest of its component: a dense group of G near copies
gives G - 1 links, not all its pairs, and the same ones from each shard that holds it.

A shard that holds more than ``shard_rows`` is dealt into chunks, and each pair of chunks becomes a task of its own.
A tree is built in the task that its shard's rows are sent to, not broadcast: all shards' trees together hold every
fingerprint several times, so their size grows with the table and no bound for a broadcast could be stated. Fingerprints are
never collected to the driver. Shards of up to 48 are asked first if they hold any link at all.

Null texts count as empty. Documents with equal fingerprints are linked. Rows with a null identifier get a fingerprint but
belong to component null. Repeated rows are copies; rows that share an identifier but not their text keep their own
components. Texts are read whole, however long. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_from, lookup, materialise, text_bytes
from .graph import Forest, components

SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    ws = raw.lower().split()
    if not ws:
        return 0
    if len(ws) <= words:
        return xxh64_intdigest(b" ".join(ws), SEED)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1)
    starts = [0, *ends[: -words].tolist()]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), dtype="<u8", count=len(ws) - words + 1)
    counts = np.stack([np.bincount(column, minlength=256) for column in hashes.view(np.uint8).reshape(-1, 8).T]) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).reshape(-1), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(raw, words)) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    return materialise(rows.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "simhash")


class Tree:
    """A BK-tree of fingerprints under the Hamming distance, with a forest of those within ``radius`` of each other.

    A node is [fingerprint, children by distance, mark]. The mark is a fingerprint of the one component that the whole
    subtree belongs to, or None; a search leaves out subtrees of the component it has reached, so a dense group isn't
    walked through again for each of its members.
    """

    __slots__ = ("root", "radius", "forest")

    def __init__(self, radius: int):
        self.root, self.radius, self.forest = None, radius, Forest()

    def add(self, fp: int) -> None:
        """Link a new fingerprint with all that are near, and put it in its place."""
        find, radius = self.forest.find, self.radius
        if self.root is None:
            self.root = [fp, {}, fp]
            return
        own, todo = fp, [self.root]
        while todo:
            at, children, mark = todo.pop()
            if mark is not None and find(mark) == own:
                continue
            d = (at ^ fp).bit_count()
            if d <= radius and self.forest.join(at, fp):
                own = find(fp)
            if children:
                if len(children) < 6:
                    todo.extend([x for k, x in children.items() if d - radius <= k <= d + radius])
                else:
                    todo.extend([children[k] for k in range(d - radius, d + radius + 1) if k in children])
        node = self.root
        while True:
            if node[2] is not None and find(node[2]) != own:
                node[2] = None
            d = (node[0] ^ fp).bit_count()
            below = node[1].get(d)
            if below is None:
                node[1][d] = [fp, {}, fp]
                return
            node = below


def shard_links(fps: list[int], reps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (by representative) that span the components within ``radius`` of a shard's distinct fingerprints: each with
    its component's smallest."""
    tree, rep = Tree(radius), dict(zip(fps, reps))
    for fp in fps:
        tree.add(fp)
    return [(rep[root], r) for fp, r in rep.items() if (root := tree.forest.find(fp)) != fp]


def plan(distinct: int, radius: int, per_shard: int = 64, least_match: int = 1) -> tuple[list[int], int]:
    """(block edges, match): the fewest matching blocks, ``least_match`` or more, that leave about ``per_shard``
    fingerprints in a shard."""
    for match in range(least_match, 9):
        blocks = radius + match
        if match * 64 / blocks >= np.log2(max(2, distinct / per_shard)) or match == 8:
            return [round(64 * k / blocks) for k in range(blocks + 1)], match
    raise AssertionError


def _shard_keys(edges: list[int], match: int) -> Column:
    fp, keys = F.col("fp"), []
    for t, chosen in enumerate(combinations(range(len(edges) - 1), match)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(mask))).alias("k")))
    return F.explode(F.array(*keys))


def _linked(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may reach over batches."""
        held: list[np.ndarray] = []

        def shards(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal held
            rows = np.concatenate(held) if held else np.zeros((0, 5), dtype=np.int64)
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            edges = [0, *cut.tolist(), *([len(rows)] if last else [])]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    yield rows[a:b, 3], rows[a:b, 4]
            held = [rows[edges[-1] :]] if not last else []

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            found = []
            for fps, reps in shards(last):
                fps = np.ascontiguousarray(fps).view(np.uint64)
                if len(fps) > 48 or _any_near(fps, radius):
                    found += shard_links(fps.tolist(), reps.tolist(), radius)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            yield from links(False)
        yield from links(True)

    return run


def _any_near(fps: np.ndarray, radius: int) -> bool:
    """Whether a small shard holds any link, before trees are built for it."""
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    return int((d <= radius).sum()) > len(fps)


def near_links(distinct: DataFrame, radius: int, shard_rows: int = 8192, least_match: int = 1) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints (fp, rep)."""
    edges, match = plan(distinct.count(), radius, least_match=least_match)
    rows = distinct.select("fp", "rep", _shard_keys(edges, match).alias("s")).select("s.t", "s.k", "fp", "rep")
    hot = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
    hot = materialise(hot, "simhash-hot")
    if hot.isEmpty():
        rows = rows.withColumn("c", F.lit(0))
    else:  # each pair of chunks is a shard; a row goes to all pairs that its chunk is in
        rows = rows.join(hot, ["t", "k"], "left")
        n = F.ceil(2 * F.col("n") / F.lit(shard_rows)).cast("int")
        own = F.pmod(F.xxhash64("fp"), n).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(own, o) * n + F.greatest(own, o))
        rows = rows.withColumn("c", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("n")
    dealt = rows.select("t", "k", "c", "fp", "rep").repartition("t", "k", "c").sortWithinPartitions("t", "k", "c", "rep")
    return dealt.mapInArrow(_linked(radius), "a long, b long")


def near_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", least_match: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    The result is the same for each ``least_match``; from 2 on, more rows are sent for few documents, and as many for each
    document of a larger table.
    """
    own = fingerprints(docs, words, id_col, text_col)
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    found = materialise(components(near_links(distinct.filter("rep is not null").select("fp", F.col("fp").alias("rep")), radius, least_match=least_match)), "simhash-components")
    named = found.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(named, "component").select(F.col("node").alias("fp"), "least")
    classes = distinct.join(found, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n")
    out = lookup(own, classes, ["fp"], heavy_from(own.count())).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out
