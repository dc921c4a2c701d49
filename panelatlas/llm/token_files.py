"""Token-id files with Elias-Fano document boundaries.

A shard holds a range of ascending document identifiers:

    magic "PATK" | version u32 | bytes per id u32 | n documents u64 | n ids u64 | null identifiers u64 | lowest identifier i64
    ids, little-endian unsigned, 2 or 4 bytes each, one document behind the other
    Elias-Fano: the end of each document in ids
    Elias-Fano: identifiers less the lowest (null identifiers, which come first, are not in it)

Select on the first sequence gives a document's boundaries without decoding the others; reading goes by it. Documents are
range-partitioned by identifier, one shard a partition. Null and empty texts are the end id alone; null identifiers come
first; repeated rows are written each, in the order of their texts. An empty table makes no ids and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, text_bytes
from .elias_fano import EliasFano, encode
from .store import mapping, put
from .tokens import encoder

_HEAD = struct.Struct("<4sIIQQQq")
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def shard_bytes(ids: list[bytes], doc_ids: list[int | None], width: int) -> Iterator[bytes]:
    """The parts of one shard; ``ids`` are little-endian with ``width`` bytes each, ``doc_ids`` ascending, nulls first."""
    ends = np.cumsum(np.array([len(x) // width for x in ids], dtype=np.uint64)) if ids else np.zeros(0, dtype=np.uint64)
    named = [x for x in doc_ids if x is not None]
    low = named[0] if named else 0
    yield _HEAD.pack(b"PATK", 1, width, len(ids), int(ends[-1]) if ids else 0, len(doc_ids) - len(named), low)
    yield from ids
    yield encode(ends)
    yield encode(np.array([x - low for x in named], dtype=np.uint64))


class Shard:
    """A shard over memory-mapped bytes."""

    def __init__(self, raw: np.ndarray):
        magic, _, self.width, self.n_docs, self.n_ids, self.n_null, self.low = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        if magic != b"PATK":
            raise ValueError("not a token file")
        at = _HEAD.size + self.n_ids * self.width
        self.ids = raw[_HEAD.size : at].view("<u2" if self.width == 2 else "<u4") if (_HEAD.size % self.width == 0) else np.frombuffer(raw[_HEAD.size : at].tobytes(), "<u2" if self.width == 2 else "<u4")
        self.ends = EliasFano(raw, at)
        self.names = EliasFano(raw, self.ends.end)

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of documents begin and end, by select on the packed boundaries."""
        ends = self.ends.get(i).astype(np.int64)
        return np.where(i > 0, self.ends.get(np.maximum(i - 1, 0)).astype(np.int64), 0), ends

    def doc_ids(self, i: np.ndarray) -> pa.Array:
        null = i < self.n_null
        found = np.zeros(len(i), dtype=np.int64)
        found[~null] = self.names.get(i[~null] - self.n_null).astype(np.int64) + self.low
        return pa.array(found, pa.int64(), mask=null)


def _write(folder: str, path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, doc_ids, parts, n = encoder(path), [], [], 0
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(enc.ids(raw.decode()) + int(end_id).to_bytes(4, "little"), "<u4")
                doc_ids.append(doc_id)
                parts.append(ids.astype("<u2").tobytes() if width == 2 else ids.tobytes())
                n += len(ids)
        if doc_ids:
            k = TaskContext.get().partitionId() if TaskContext.get() else 0
            put(name := f"{folder}/shard-{k:06d}.patk", shard_bytes(parts, doc_ids, width))
            yield pa.RecordBatch.from_pydict({"shard": [k], "path": [name], "n_docs": [len(doc_ids)], "n_tokens": [n]})

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return the manifest: shard, path, n_docs, n_tokens, start (ids of all shards before).

    A task holds one shard's ids; ``shards`` (None: the session's shuffle partitions) sets their number.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col))
    by = [F.col("doc_id").asc_nulls_first()]
    rows = (rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)).sortWithinPartitions("doc_id", text_col)
    made = rows.mapInArrow(_write(folder, vocabulary, end_id), "shard long, path string, n_docs long, n_tokens long").collect()  # a row a shard
    out, start = [], 0
    for r in sorted(made):
        out.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(out, "shard long, path string, n_docs long, n_tokens long, start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            shard = Shard(mapping(path))
            for at in range(0, shard.n_docs, 10_000):
                rows = np.arange(at, min(at + 10_000, shard.n_docs))
                a, b = shard.bounds(rows)
                crc = [zlib.crc32(shard.ids[x:y].astype("<u4").tobytes()) for x, y in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([shard.doc_ids(rows), pa.array(a + start), pa.array(b - a), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, OUT)
