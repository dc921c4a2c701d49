"""Divergence of sources: how far the words of each source of a language are from those of its other sources and of the
language, with the words that stand out.

1. Partitions count: each task splits whole texts into terms (runs of ASCII letters and of characters beyond ASCII, A-Z
   lower-cased) and counts them by source. At ``TRIE_COUNTERS`` counters, and at its end, they go into a radix trie for each
   language, whose leaves hold the number of documents and one counter a source; it is handed on, leaf by leaf in the order of
   its bytes, and the counting begins anew.
2. Tries merge by prefix range: leaves are dealt by ranges of (language, term), so that a term's leaves meet in one task, at
   most one for each trie handed on; each task adds up the documents of its range's leaves, merges those of at least
   ``min_docs`` into tries and walks them in the order of UTF-8. The walk is cut into blocks of some thousand terms, one row each.
3. The groups' totals (one row a language) are joined to the blocks, and each block gives exact integer sums for each pair of
   sources and its best terms for each source; as blocks come in the order of UTF-8, ties keep that order.

Of term t in a group with count c, p = 1 + floor(10^9 (c + 2) / (N + 2 V)); V is the number of terms kept for the language, N
the group's occurrences of them. The divergence of p from q at a term is floor((p - q)^2 / (p + q)). All of it is exact below
N + 2 V = 9 * 10^15. A task holds 8 bytes for each pair of a language's sources; the result has them as rows anyway.

Null texts, languages and sources count as empty strings; the empty string is a language and source like any other. Rows
repeated as a whole count as often as they occur; very long texts are read whole, in pieces of a megabyte. A language whose
terms are all rare has V = 0: its pairs have the value 0. A language with one source has no pairs. An empty table gives an
empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .radix_trie import RadixTrie

#: Counters that a task holds before it hands its tries on; terms and counters of a block; leaves that a merging task gets.
TRIE_COUNTERS, BLOCK_TERMS, BLOCK_COUNTERS, RANGE_LEAVES = 1_000_000, 4096, 200_000, 200_000
PIECE = 1 << 20
_UPPER, _LOWER = range(0x41, 0x5B), range(0x61, 0x7B)
#: Bytes of terms stay, A-Z lower-cased; all others part terms.
TO_TERMS = bytes(b + 32 if b in _UPPER else b if b in _LOWER or b >= 0x80 else 0x20 for b in range(256))

LEAVES = "lang binary, term binary, docs long, sources array<binary>, counts array<long>"
BLOCKS = "lang binary, terms array<binary>, totals array<long>, sources array<binary>, source_n array<long>, term_at array<int>, source_at array<int>, counts array<long>"
PARTS = "lang binary, source binary, part string, item binary, value long"
_ARROW = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _schema(ddl: str) -> pa.Schema:
    kind = lambda t: pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]
    return pa.schema([(n, kind(t)) for n, t in (c.split() for c in ddl.split(", "))])


def _batches(rows: Iterator[tuple], ddl: str, size: int) -> Iterator[pa.RecordBatch]:
    schema, held = _schema(ddl), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some thousands at a time: pieces end where a term does."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(TO_TERMS)
        if at + PIECE < len(text):
            end = piece.rfind(b" ")
            if end < 0:  # a term of over a megabyte: up to where it ends
                to = next((k for k in range(at + PIECE, len(text)) if TO_TERMS[text[k]] == 0x20), len(text))
                piece, end = text[at:to].translate(TO_TERMS), to - at - 1
            piece, at = piece[: end + 1], at + end + 1
        else:
            at = len(text)
        yield piece.split()


def _without_cycles(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` with the collector of cycles off: tries have none, and a search through millions of nodes takes a third of the time."""

    def run(batches: Iterator) -> Iterator:
        gc.disable()
        try:
            yield from task(batches)
        finally:
            gc.enable()

    return run


def _flush(counts: dict[bytes, dict[bytes, Counter]], docs: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
    """The leaves of each language's trie, in order; a leaf holds its number, by which its counters stand in columns."""
    for lang in sorted(counts):
        terms, sources = sorted(docs[lang]), sorted(counts[lang])
        number = dict(zip(terms, range(len(terms)), strict=True))
        whose = np.concatenate([np.fromiter(map(number.__getitem__, counts[lang][s]), np.int64, len(counts[lang][s])) for s in sources])
        n = np.concatenate([np.fromiter(counts[lang][s].values(), np.int64, len(counts[lang][s])) for s in sources])
        source = np.repeat(np.arange(len(sources)), [len(counts[lang][s]) for s in sources])
        order = np.argsort(whose, kind="stable")
        n, source, ends = n[order], source[order], np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(terms)))])
        del number, whose, order
        trie, names = RadixTrie.of_sorted(terms), pa.array(sources, pa.binary())
        del terms
        walk = trie.walk()
        while held := list(islice(walk, 20_000)):
            first, last = held[0][1], held[-1][1] + 1  # leaves come by their numbers
            a, b = ends[first], ends[last]
            columns = [pa.array([lang] * len(held), pa.binary()), pa.array([t for t, _ in held], pa.binary()), pa.array([docs[lang][t] for t, _ in held], pa.int64())]
            at = pa.array(ends[first : last + 1] - a, pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(at, names.take(pa.array(source[a:b]))), pa.ListArray.from_arrays(at, pa.array(n[a:b]))], schema=_schema(LEAVES))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, dict[bytes, Counter]] = {}
    docs: dict[bytes, Counter] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                n, once = counts.setdefault(lang, {}).setdefault(source, Counter()), set()
                for terms in _pieces(text):
                    n.update(terms)
                    once.update(terms)
                docs.setdefault(lang, Counter()).update(once)
            if sum(len(n) for by in counts.values() for n in by.values()) >= TRIE_COUNTERS:
                yield from _flush(counts, docs)
                counts, docs = {}, {}
    yield from _flush(counts, docs)


def _merge(min_docs: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A term's leaves are all here. Most terms are rare, so documents are added up first and only what is kept enters the
        merged trie."""
        tables = list(batches)
        rows = pa.Table.from_batches(tables, _schema(LEAVES))
        kept = rows.select(["lang", "term", "docs"]).group_by(["lang", "term"]).aggregate([("docs", "sum")])
        kept = kept.filter(pc.greater_equal(kept["docs_sum"], min_docs))

        def blocks():
            for lang in sorted(pc.unique(kept["lang"]).to_pylist()):
                own, of = rows.filter(pc.equal(rows["lang"], lang)), kept.filter(pc.equal(kept["lang"], lang))
                walk = _merged(own, of).walk()
                held, size = [], 0
                for term, (_, by_source) in walk:
                    held.append((term, by_source))
                    size += len(by_source)
                    if len(held) == BLOCK_TERMS or size >= BLOCK_COUNTERS:
                        yield _block(lang, held)
                        held, size = [], 0
                if held:
                    yield _block(lang, held)

        yield from _batches(blocks(), BLOCKS, 8)

    return merge


def _merged(rows: pa.Table, kept: pa.Table) -> RadixTrie:
    """The trie of the terms in ``kept``; their counters by source are added up in columns."""
    terms = kept["term"].combine_chunks()
    rows = rows.append_column("at", pc.index_in(rows["term"], value_set=terms))
    rows = rows.filter(pc.is_valid(rows["at"])).combine_chunks()
    sources = pc.list_flatten(rows["sources"]).combine_chunks().dictionary_encode()
    names = sources.dictionary.to_pylist()
    at = rows["at"].combine_chunks().take(pc.list_parent_indices(rows["sources"]).combine_chunks())
    key = at.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + sources.indices.to_numpy(zero_copy_only=False)
    sums = pa.table({"key": key, "n": pc.list_flatten(rows["counts"])}).group_by("key").aggregate([("n", "sum")]).sort_by("key")
    which, source = np.divmod(sums["key"].to_numpy(), len(names))
    trie, n, source, ends = RadixTrie(), sums["n_sum"].to_pylist(), source.tolist(), np.searchsorted(which, np.arange(len(terms) + 1)).tolist()
    for k, (term, docs) in enumerate(zip(terms.to_pylist(), kept["docs_sum"].to_pylist(), strict=True)):
        trie.add(term, docs, {names[s]: c for s, c in zip(source[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]], strict=True)})
    return trie


def _block(lang: bytes, held: list[tuple[bytes, dict]]) -> tuple:
    n = Counter()
    for _, by in held:
        n.update(by)
    at = {s: i for i, s in enumerate(n)}
    cells = [(t, at[s], c) for t, (_, by) in enumerate(held) for s, c in by.items()]
    return lang, [t for t, _ in held], [sum(by.values()) for _, by in held], list(n), list(n.values()), *map(list, zip(*cells, strict=True))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total) in whole numbers; ``total`` below 9 * 10^15."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _score(top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, list] = {}
        sums: dict[bytes, np.ndarray] = {}
        best: dict[tuple, list] = {}

        def one(lang, terms, totals, in_block, _, term_at, source_at, counts, all_sources, all_n, kept):
            names.setdefault(lang, all_sources)
            pairs = sums.setdefault(lang, np.zeros((len(all_sources),) * 2, dtype=np.int64))
            where = {s: i for i, s in enumerate(all_sources)}
            to = np.array([where[s] for s in in_block])
            total = np.array(all_n, dtype=np.int64) + 2 * kept
            lang_n = int(sum(all_n)) + 2 * kept
            term_at, row, counts = np.array(term_at), to[np.array(source_at)], np.array(counts, dtype=np.int64)
            step = max(1, 2_000_000 // len(all_sources))
            for at in range(0, len(terms), step):
                here = (term_at >= at) & (term_at < at + step)
                c = np.zeros((len(all_sources), min(step, len(terms) - at)), dtype=np.int64)
                c[row[here], term_at[here] - at] = counts[here]
                p, q = share(c, total[:, None]), share(np.array(totals[at : at + step], dtype=np.int64), np.int64(lang_n))
                for i in range(len(all_sources)):
                    pairs[i, i + 1 :] += apart(p[i], p[i + 1 :]).sum(axis=1)
                    over = np.flatnonzero((c[i] > 0) & (p[i] > q))
                    f = apart(p[i, over], q[over])
                    first = np.argsort(-f, kind="stable")[:top]  # terms are in order, so ties are too
                    key = (lang, i)
                    best[key] = heapq.nsmallest(top, [*best.get(key, []), *((-int(f[k]), terms[at + over[k]]) for k in first)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one(*row)

        def rows():
            for (lang, i), found in best.items():
                for f, term in found:
                    yield lang, names[lang][i], "term", term, -f
            for lang, m in sums.items():
                for i, j in zip(*np.triu_indices(len(m), 1), strict=True):
                    yield lang, names[lang][i], "pair", names[lang][j], int(m[i, j])

        yield from _batches(rows(), PARTS, 5000)

    return score


def kept_terms(docs: DataFrame, min_docs: int, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Blocks of merged leaves: terms of at least ``min_docs`` documents of their language, in order within a block."""
    byte = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    rows = docs.select(byte(lang_col).alias("lang"), byte(source_col).alias("source"), byte(text_col).alias("text"))
    leaves = materialise(rows.mapInArrow(_without_cycles(_count), LEAVES), "term-tries", compression="zstd")
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // RANGE_LEAVES))
    return materialise(leaves.repartitionByRange(ranges, "lang", "term").mapInArrow(_without_cycles(_merge(min_docs)), BLOCKS), "term-blocks", compression="zstd")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language (``pair``) and the ``top`` terms (``term``) of
    each source, by falling value and the item's UTF-8."""
    blocks = kept_terms(docs, min_docs, lang_col, source_col, text_col)
    byte = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    groups = docs.groupBy(byte(lang_col).alias("lang"), byte(source_col).alias("source")).agg(F.lit(0).cast("long").alias("n"))
    seen = blocks.select("lang", F.explode(F.arrays_zip("sources", "source_n")).alias("g")).select("lang", F.col("g.sources").alias("source"), F.col("g.source_n").alias("n"))
    groups = groups.unionByName(seen).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))  # one entry a source
    totals = groups.select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_n"))
    size = blocks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"))
    totals = materialise(totals.join(size, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))), "term-totals")

    scored = materialise(blocks.join(totals, "lang").mapInArrow(_score(top), PARTS), "term-scores", compression="zstd")
    others = totals.select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item")).filter("source <> item")
    half = scored.filter("part = 'pair'").select("lang", "source", "item", "value")
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = both.unionByName(others.withColumn("value", F.lit(0).cast("long"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = scored.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = terms.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")], "value", "rank")
