"""Exact duplicates by a log-structured merge index of digests, in DataFrame functions only.

1. Memtables: every row's normalised text gets its SHA-256. Each task sorts its rows by digest and flushes them as
   runs: Parquet files of at most ``memtable_rows`` rows with a Bloom filter on the digest.
2. Compaction: the runs merge by digest; of each digest the chosen identifier (``keep``) and the count stay. Aggregation
   is partial first, so a digest that a third of all rows share moves once per task.
3. Hits, digests that more than one row has, are marked in a bitmap of fixed size that keeps other rows' texts from moving,
   and receive byte verification: each such row's text is compared with the kept row's. The rows of a frequent digest are
   spread over tasks, each with a copy of the kept text. Rows that differ (a collision of digests) form classes of their
   own by their full text.

Null texts count as empty; empty texts are equal to each other. Rows with a null identifier take part: nulls lose
against any identifier, and a class of nulls alone keeps null. Rows repeated as a whole are copies like any other; all of
them report ``kept`` if their identifier is the kept one. An empty table gives an empty result. Very long texts are read
whole like any other. Other columns are not read, whatever their names; helper columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, heavy_from, lookup, materialise


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 4_000_000) -> DataFrame:
    """Level 0: sorted digest runs in the shared folder, a Bloom filter with each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(F.col(text_col)), 256).alias("digest"))
    return materialise(rows, "lsm-l0", sort=["digest"], maxRecordsPerFile=str(memtable_rows), **{"parquet.bloom.filter.enabled#digest": "true", "compression": "zstd"})


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """Level 1: digest, the smallest or largest identifier, and how many rows have the digest."""
    choose = F.min if keep == "min" else F.max
    return runs.groupBy("digest").agg(choose("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


FILTER_BITS = 26


def maybe_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest may be among ``hits``, by a bitmap of digest prefixes: 2 ** FILTER_BITS bits, 8 MB at most, so it
    can be broadcast whatever the number of hits. Like any such filter it only saves work; the join behind it decides."""
    prefix = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % (1 << FILTER_BITS) + 1
    marks = hits.select(F.bitmap_bucket_number(prefix).alias("bucket"), F.bitmap_bit_position(prefix).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = F.bitmap_bit_position(prefix).cast("int")
    asked = rows.withColumn("bucket", F.bitmap_bucket_number(prefix)).join(F.broadcast(marks), "bucket")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return asked.filter(F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1).drop("bucket", "bits")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtable_rows: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = digest_runs(docs, id_col, text_col, memtable_rows)
    index = materialise(compact(runs, keep), "lsm-l1", compression="zstd")
    limit = heavy_from(index.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0])
    looked_up = lookup(runs, index, ["digest"], limit, "group_size").select("doc_id", "keep_id", "group_size", "digest")

    # Byte verification: rows of a digest are spread over as many tasks as ``limit`` goes into them; each gets the kept text.
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    hits = index.filter(F.col("group_size") > 1).select("digest", "keep_id", F.ceil(F.col("group_size") / limit).cast("int").alias("parts"))
    rows = lookup(maybe_hits(texts, hits), hits, ["digest"], 1, "parts")
    rows = materialise(rows.select("digest", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "parts", "doc_id", "norm", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("is_kept")), "lsm-hits", compression="zstd")
    # One text for each hit digest to compare with: of the kept identifier, and of repeated identifiers the smallest text.
    first = rows.filter("is_kept").groupBy("digest", "parts").agg(F.min("norm").alias("first_norm"))
    first = first.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "first_norm")
    odd = materialise(rows.join(first, ["digest", "part"]).filter("norm <> first_norm").select("digest", "doc_id", "norm"), "lsm-odd")
    if not odd.isEmpty():  # texts that share a digest with another: a collision
        looked_up = _apart(looked_up, odd, keep)
    return looked_up.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _apart(looked_up: DataFrame, odd: DataFrame, keep: str) -> DataFrame:
    """Classes where ``odd`` rows differ from their digest's kept text: they form classes by their own full text."""
    choose = F.min if keep == "min" else F.max
    own = odd.groupBy("digest", "norm").agg(choose("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by = ["digest", "doc_id"]
    taken = odd.groupBy(*by).agg(F.count(F.lit(1)).alias("odd_rows"))
    lost = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    # Of rows with one identifier and one digest, as many stay as aren't odd.
    left = looked_up.groupBy(*by, "keep_id", "group_size").agg(F.count(F.lit(1)).alias("rows"))
    left = left.join(taken.withColumnsRenamed({c: f"odd_{c}" for c in by}), (F.col("digest") == F.col("odd_digest")) & F.col("doc_id").eqNullSafe(F.col("odd_doc_id")), "left").join(lost, "digest", "left")
    stay = left.withColumn("n", F.col("rows") - F.coalesce("odd_rows", F.lit(0))).filter("n > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    stay = stay.select("doc_id", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"), "digest")
    return stay.unionByName(odd.join(own, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", "digest"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without exact copies, its columns unchanged; of rows repeated as a whole, one stays."""
    key, sha, n, own = fresh(docs, "copy_id", "copy_sha", "copy_rows", "own_sha")
    classes = materialise(exact_classes(docs, id_col, text_col, keep).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), "kept"), "copies", compression="zstd")
    marked = docs.withColumn(own, F.sha2(ascii_lower(F.col(text_col)), 256))
    gone = classes.filter("not kept").select(key, sha).distinct()
    left = marked.join(gone, marked[id_col].eqNullSafe(gone[key]) & (marked[own] == gone[sha]), "left_anti")
    again = materialise(classes.filter("kept").groupBy(key, sha).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).drop(n), "copies-again")
    if not again.isEmpty():
        of = marked[id_col].eqNullSafe(again[key]) & (marked[own] == again[sha])
        left = left.join(again, of, "left_anti").unionByName(left.join(again, of, "left_semi").dropDuplicates([id_col, own]))
    return left.drop(own)
