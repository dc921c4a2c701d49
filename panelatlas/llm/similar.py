"""Groups of texts whose word shingles have a Jaccard similarity of at least a given value, by SimHash and an exact check.

Shingles are those of ``simhash`` (lower-case A-Z, ``words`` consecutive words; fewer words make one shingle, none make the
empty one), each counted once. Texts with the same set of shingles count as one from then on.

Candidates: a text gets several independent SimHash fingerprints, from one hash for each shingle mixed with a number for
each fingerprint. Two texts of similarity J agree in each bit with a chance of at least ``1 - acos(2J / (1 + J)) / pi``
(0.848 for 0.8). The bits are cut into bands, as many as leave a pair of the least similarity without an equal band with a
chance of ``missed`` (0.001); texts with an equal band meet in a task. The width of a band grows with the number of texts
from ``14`` on, where it passes 16 texts a band. There they are searched in a BK-tree (``simhash.Tree``) over the first 256 bits
for those that differ in at most 72; only signatures that have such another go into the tree.
(Texts of fewer than some 20 shingles agree a little less: at 4 of 5 shingles a pair is missed with a chance of 0.025, and
differs in over 72 of 256 bits, each with a chance of 3 in 16, with one of 0.0001 more; larger texts far more rarely.)

Check: the texts of each candidate component are gathered, and only pairs with an exact similarity of at least ``jaccard``
(over 64-bit hashes of the shingles) are links. So no group holds a link below it; what can be lost is a pair without an
equal band. A component of much text is dealt into chunks, and each pair of chunks becomes a task.

A task hands on each text's link with the smallest of its component, so a dense group of G texts gives G - 1 links, mostly the
same from every band. Null texts count as empty; rows with a null identifier are left out; rows that share an identifier count
as one document. Texts are read whole, other columns not at all. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_bytes
from .graph import Forest, components
from .simhash import SEED, shard_links

CHECKED, APART = 4, 72  # longs of the signature that a band's row carries, and the bits of them that may differ
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    ws = raw.lower().split()
    joined = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1)
    starts = [0, *ends[: -words].tolist()]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), dtype=np.uint64, count=len(ws) - words + 1))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits (0 or 1) of ``size`` independent 64-bit SimHash fingerprints."""
    votes, add = np.zeros(64 * size, dtype=np.int64), np.arange(1, size + 1, dtype=np.uint64) * _GOLDEN
    for at in range(0, len(hashes), 255):  # so that a vote fits a byte
        x = hashes[at : at + 255, None] + add
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        x ^= x >> np.uint64(31)
        votes += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * votes > len(hashes)).astype(np.uint8)


def plan(rows: int, jaccard: float, missed: float = 0.001) -> tuple[int, int]:
    """(bits a band, bands)."""
    width = max(14, math.ceil(math.log2(max(1, rows) / 16)))
    agree = 1 - math.acos(2 * jaccard / (1 + jaccard)) / math.pi
    return width, math.ceil(math.log(missed) / math.log1p(-(agree**width)))


def _signatures(words: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets, sigs = [], []
            for raw in batch.column(1).to_pylist():
                h = shingles(raw, words)
                sets.append(xxh3_128_digest(h.tobytes()))
                sigs.append(np.packbits(signature(h, size), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "shingle_set", "signature"])

    return run


def _banded(width: int, bands: int, rows: int = 2000) -> Callable:
    """(rep, signature) -> a row for each band: its number, its bits, rep, and the first longs of the signature."""
    power = 1 << np.arange(width, dtype=np.int64)
    names = ["t", "k", "rep", *[f"s{i}" for i in range(CHECKED)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : width * bands].reshape(len(batch), bands, width)
                first = np.ascontiguousarray(raw[:, : 8 * CHECKED]).view(np.int64)
                columns = [np.tile(np.arange(bands, dtype=np.int64), len(batch)), (bits @ power).reshape(-1)]
                columns += [np.repeat(c, bands) for c in (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *first.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that span the components of n items; ``near`` tells which of some items are linked to one."""
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(at, left)
            found = left[hit].tolist()
            if found:
                yield from ((at, x) for x in found)
                todo += found
                left = left[~hit]


def _by_shard(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(rows, edges between shards) of rows sorted by their first ``keys`` columns; a shard is never cut."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        if (held[-1][-1:, :keys] == held[0][:1, :keys]).all():
            continue
        rows = np.concatenate(held)
        cut = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        yield rows[: cut[-1]], [0, *cut.tolist()]
        held = [rows[cut[-1] :]]
    if held:
        rows = np.concatenate(held)
        yield rows, [0, *(np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1).tolist(), len(rows)]


def _stars(forest: Forest) -> Iterator[pa.RecordBatch]:
    """Each node's link with the smallest of its component: the same from every task that finds the same group."""
    links = [(forest.find(x), x) for x in list(forest.up)]
    links = [x for x in links if x[0] != x[1]]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])


def _searched(forest: Forest, sig: np.ndarray, reps: list[int]) -> None:
    """Links of a shard's signatures, searched in its BK-tree; equal ones are one node of it."""
    first: dict[int, int] = {}
    for raw, rep in zip(sig, reps):
        held = first.setdefault(int.from_bytes(raw.tobytes(), "little"), rep)
        forest.join(held, rep)
    for a, b in shard_links(list(first), list(first.values()), APART):
        forest.join(a, b)


def _candidates(small: int = 32) -> Callable:
    """Each shard's BK-tree takes the signatures that have any other within reach, as most have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for rows, edges in _by_shard(batches, 3):
            reps, sig = rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
            sizes = np.diff(edges)
            after, near = np.repeat(edges[1:], sizes), np.zeros(len(rows), dtype=bool)  # where a row's shard ends
            at = np.flatnonzero(np.repeat(sizes, sizes) <= small)
            for step in range(1, small):  # all pairs of the small shards, by their distance in the table
                at = at[at + step < after[at]]
                if not len(at):
                    break
                hit = at[_apart(sig[at], sig[at + step]) <= APART]
                near[hit] = near[hit + step] = True
            for k in np.flatnonzero(sizes > small).tolist():
                own = sig[edges[k] : edges[k + 1]]
                near[edges[k] : edges[k + 1]] = [int((_apart(x, own) <= APART).sum()) > 1 for x in own]
            some = np.flatnonzero(near)
            shard = np.repeat(np.arange(len(sizes)), sizes)[some]
            for part in np.split(some, np.flatnonzero(shard[1:] != shard[:-1]) + 1) if len(some) else ():
                _searched(forest, sig[part], reps[part].tolist())
        yield from _stars(forest)

    return run


def similar_links(sets: list[np.ndarray], jaccard: float) -> Iterator[tuple[int, int]]:
    """Links that span the components of sets (sorted arrays) of an exact similarity of at least ``jaccard``."""
    size = np.array([len(x) for x in sets])

    def near(at: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), dtype=bool)
        likely = np.flatnonzero((np.minimum(size[left], size[at]) >= jaccard * np.maximum(size[left], size[at])))
        if len(likely):
            every = np.concatenate([sets[k] for k in left[likely]])
            place = np.minimum(np.searchsorted(sets[at], every), size[at] - 1)
            starts = np.concatenate([[0], np.cumsum(size[left[likely]])[:-1]])
            both = np.add.reduceat((sets[at][place] == every).astype(np.int64), starts)
            out[likely] = both >= jaccard * (size[left[likely]] + size[at] - both) - 1e-9
        return out

    yield from _spanning(len(sets), near)


def _checked(words: int, jaccard: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, chunk, doc_id, text) come sorted by the first two."""
        now, ids, sets, forest = None, [], [], Forest()

        def linked() -> None:
            for a, b in similar_links(sets, jaccard):
                forest.join(ids[a], ids[b])

        for batch in batches:
            for component, chunk, doc_id, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (component, chunk) != now:
                    linked()
                    now, ids, sets = (component, chunk), [], []
                ids.append(doc_id)
                sets.append(shingles(raw, words))
        linked()
        yield from _stars(forest)

    return run


def _in_chunks(rows: DataFrame, keys: list[str], parts: DataFrame, of: str) -> DataFrame:
    """``rows`` with ``c``: 0, or for keys in ``parts`` (dealt into n chunks by ``of``) each pair of chunks that holds the row."""
    if parts.isEmpty():
        return rows.withColumn("c", F.lit(0))
    rows, n = rows.join(parts, keys, "left"), F.col("n")
    own = F.pmod(F.xxhash64(of), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(own, o) * n + F.greatest(own, o))
    return rows.withColumn("c", F.explode(F.when(n.isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("n")


def similar_components(docs: DataFrame, words: int = 5, jaccard: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 8192, shard_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs`` with an identifier; a component's smallest doc_id names it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).filter("doc_id is not null")
    width, bands = plan(rows.count(), jaccard)
    size = max(CHECKED, -(-width * bands // 64))
    own = materialise(rows.mapInArrow(_signatures(words, size), "doc_id long, shingle_set binary, signature binary"), "similar")
    sets = materialise(own.groupBy("shingle_set", "signature").agg(F.min("doc_id").alias("rep")), "similar-sets")

    names = ["t", "k", "c", "rep", *[f"s{i}" for i in range(CHECKED)]]
    banded = sets.select("rep", "signature").mapInArrow(_banded(width, bands), ", ".join(f"{x} long" for x in names if x != "c"))
    hot = banded.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
    hot = materialise(hot.select("t", "k", F.ceil(2 * F.col("n") / shard_rows).cast("int").alias("n")), "similar-hot")
    dealt = _in_chunks(banded, ["t", "k"], hot, "rep").select(*names).repartition("t", "k", "c").sortWithinPartitions("t", "k", "c")
    near = components(dealt.mapInArrow(_candidates(), "a long, b long"))

    texts = materialise(rows.join(near, F.col("doc_id") == F.col("node")).select("component", "doc_id", "text"), "similar-texts")
    weight = F.ceil(2 * F.sum(F.octet_length("text") + 256) / shard_bytes).cast("int")
    large = materialise(texts.groupBy("component").agg(weight.alias("n")).filter("n > 2"), "similar-large")
    dealt = _in_chunks(texts, ["component"], large, "doc_id").select("component", "c", "doc_id", "text").repartition("component", "c").sortWithinPartitions("component", "c")
    found = components(dealt.mapInArrow(_checked(words, jaccard), "a long, b long"))

    classes = sets.join(found, F.col("rep") == F.col("node"), "left").select("shingle_set", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "shingle_set").select("doc_id", "component_id")
