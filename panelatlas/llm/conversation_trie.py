"""Prefix trie of conversations: a node for every distinct beginning, with its members, children, leaves and saved text.

1. Turns are numbered within their conversation and get an id from a dictionary of the distinct (role, text) pairs, told apart
   by SHA-256; from here on only ids and lengths move (``encode``).
2. Equal conversations become one string of ids with a count and the smallest identifier; ``ends_sha256`` of their
   identifiers is made from stretches of 1024 identifiers each, hashed one after another.
3. MSD radix: strings of a bucket are dealt by the id at the bucket's depth; each digit's strings are a bucket below, and a
   node. A bucket of over ``LOCAL_TURNS`` remaining turns with more than one string is dealt again in the next round. A round
   is an aggregation and a join; rounds grow with the longest beginning that strings of such a bucket share.
4. A local bucket is finished in one task by multikey quicksort; its recursion emits the bucket's nodes. The few nodes above
   local buckets then get the sums of their children, level by level from below.

Null roles and texts count as empty. Turns are ordered by ``turn``, null first, and equal turns by role and text; rows repeated
as a whole are turns of their own. Rows without a conversation (null ``conv_id``) belong to none and are left out. A
conversation without turns ends at the root. Very long texts are read whole. An empty table has no node. A conversation's ids
(24 bytes a turn, never its texts) must fit one task. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LOCAL_TURNS = 8192
#: Identifiers in one stretch of a node's ends, as a power of two.
STRETCH_BITS = 10
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, id, bytes): turns in order from 0, their dictionary id and the length of their text in UTF-8."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = materialise(rows.select("conv_id", (F.row_number().over(order).cast("long") - 1).alias("pos"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns", compression="zstd")
    words = materialise(rows.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-dictionary", compression="zstd")
    return materialise(rows.join(words, "digest").select("conv_id", "pos", "id", "bytes"), "turn-ids", compression="zstd")


def rebuilt(coded: DataFrame, head: Column, base: Column) -> DataFrame:
    """Conversations put together anew, as (conv_id, ids, bytes): the first ``head`` turns of conversation ``base``, then the own
    turns after the first ``head``; both are expressions on ``conv_id``. A base that isn't there gives no turns."""
    every = coded.select("conv_id").distinct().select("conv_id", base.alias("base"), head.alias("head"))
    theirs = coded.select(F.col("conv_id").alias("base"), "pos", "id", "bytes").join(every, "base").filter(F.col("pos") < F.col("head"))
    own = coded.filter(F.col("pos") >= head)
    turn = lambda part: F.struct(F.lit(part).alias("part"), "pos", "id", "bytes").alias("turn")
    parts = theirs.select("conv_id", turn(0)).unionByName(own.select("conv_id", turn(1))).unionByName(every.select("conv_id", F.lit(None).cast("struct<part:int,pos:bigint,id:bigint,bytes:bigint>").alias("turn")))
    return _strings(parts)


def whole(coded: DataFrame) -> DataFrame:
    """Conversations as they are, as (conv_id, ids, bytes)."""
    return _strings(coded.select("conv_id", F.struct("pos", "id", "bytes").alias("turn")))


def _strings(rows: DataFrame) -> DataFrame:
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # null turns aren't collected
    return turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.bytes").alias("bytes"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key: SHA-256 of its stretches, which come in order, joined by commas."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, said in zip(batch["key"].to_pylist(), batch["said"].to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])


def distinct_strings(conversations: DataFrame) -> DataFrame:
    """(rep, n, ends, ids, bytes): equal conversations as one, with the smallest identifier, their number and their hash."""
    keyed = conversations.select("conv_id", "ids", "bytes", F.unhex(F.sha2(F.array_join("ids", ","), 256)).alias("key"), F.shiftright("conv_id", STRETCH_BITS).alias("stretch"))
    stretches = keyed.groupBy("key", "stretch").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("said"), F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("ids").alias("ids"), F.any_value("bytes").alias("bytes"))
    stretches = materialise(stretches, "conversation-ends", compression="zstd")
    one = stretches.groupBy("key").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.sha2(F.any_value("said"), 256).alias("ends"), F.any_value("ids").alias("ids"), F.any_value("bytes").alias("bytes"))
    one = materialise(one, "conversation-strings", compression="zstd")
    several = one.filter("parts > 1")
    parts = stretches.select("key", "stretch", "said").join(several.select("key"), "key")
    ends = parts.repartition("key").sortWithinPartitions("key", "stretch").select("key", "said").mapInArrow(_hash_ends, "key binary, ends string")
    cols = ["rep", "n", "ends", "ids", "bytes"]
    return one.filter("parts = 1").select(*cols).unionByName(several.drop("ends").join(ends, "key").select(*cols))


def _digits(strings: list[tuple], depth: int) -> Iterator[list[tuple]]:
    """Strings with the same id at ``depth``: the three-way partition of multikey quicksort."""
    todo = [strings]
    while todo:
        part = todo.pop()
        pivot = part[len(part) // 2][3][depth]
        less, more = [s for s in part if s[3][depth] < pivot], [s for s in part if s[3][depth] > pivot]
        yield [s for s in part if s[3][depth] == pivot]
        todo += [x for x in (less, more) if x]


def bucket_nodes(strings: list[tuple], depth: int, parent: int | None) -> list[tuple]:
    """The nodes of a bucket of strings (rep, n, ends, ids, bytes) with the same first ``depth`` ids, as the columns of NODES and
    whether it is the bucket's own."""
    nodes: list[list] = []
    todo = [(strings, depth, None)]
    while todo:
        group, d, up = todo.pop()
        n = sum(s[1] for s in group)
        ended, rest = next((s[2] for s in group if len(s[3]) == d), NO_ENDS), [s for s in group if len(s[3]) > d]
        k = len(nodes)
        nodes.append([min(s[0] for s in group), d, parent if up is None else nodes[up][0], n, 0, 0, (n - 1) * group[0][4][d - 1] if d else 0, ended, up is None, up])
        todo += [(x, d + 1, k) for x in _digits(rest, d)] if rest else []
    for node in reversed(nodes):  # children come after their parents
        node[5] = node[5] or 1
        if node[9] is not None:
            above = nodes[node[9]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return [tuple(x[:9]) for x in nodes]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of buckets that come one after another, their own nodes marked ``top``."""

    def rows():
        key, held, up = None, [], None
        for batch in batches:
            for child, depth, parent, *s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, child) != key:
                    yield from bucket_nodes(held, key[0], up) if held else ()
                    key, held, up = (depth, child), [], parent
                held.append(tuple(s))
            yield None  # a batch's end: what is there goes on
        yield from bucket_nodes(held, key[0], up) if held else ()
        yield None

    kinds = {"conv_id": 0, "depth": 1, "parent_conv_id": 2, "n_convs": 3, "n_children": 4, "n_leaves": 5, "saved_tokens": 6}
    out: list[tuple] = []
    for row in rows():
        if row is not None:
            out.append(row)
        if out and (row is None or len(out) == 5000):
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[i], pa.int64()) for i in kinds.values()), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.bool_())], [*kinds, "ends_sha256", "top"])
            out = []


def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row a node, from (conv_id, ids, bytes) of ``whole`` or ``rebuilt``; conv_id (the smallest member) and depth name it."""
    spark, strings = conversations.sparkSession, distinct_strings(conversations)
    strings = materialise(strings, "trie-strings", compression="zstd")
    root, members = strings.agg(F.min("rep"), F.sum("n")).first()
    if root is None:
        return spark.createDataFrame([], NODES)
    one = "struct<conv_id:bigint,depth:bigint,parent_conv_id:bigint,n_convs:bigint,own:bigint>"
    above = [spark.range(1).select(F.struct(F.lit(root), F.lit(0), F.lit(None), F.lit(members), F.lit(0)).cast(one).alias("x")).select("x.*")]
    ended, local, bucket = [], [], strings.select(F.lit(root).alias("bucket"), "*")
    while True:  # a round for each depth that has buckets to deal
        d = len(above) - 1
        ended.append(bucket.filter(F.size("ids") == d).select(F.col("bucket").alias("conv_id"), "ends"))
        going = bucket.filter(F.size("ids") > d).withColumn("digit", F.col("ids")[d])
        left, large = F.sum(F.size("ids") - d - 1), (F.col("left") > local_turns) & (F.col("strings") > 1)
        below = going.groupBy("bucket", "digit").agg(F.min("rep").alias("child"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("strings"), left.alias("left"), F.any_value(F.col("bytes")[d]).alias("own"))
        below = materialise(below.withColumn("large", large), "trie-digits", compression="zstd")
        dealt = materialise(going.join(below.select("bucket", "digit", "child", "large"), ["bucket", "digit"]), "trie-buckets", compression="zstd")
        local.append(dealt.filter("not large").select("child", F.lit(d + 1).cast("long").alias("depth"), F.col("bucket").alias("parent"), "rep", "n", "ends", "ids", "bytes"))
        nodes = below.filter("large").select(F.col("child").alias("conv_id"), F.lit(d + 1).cast("long").alias("depth"), F.col("bucket").alias("parent_conv_id"), F.col("n").alias("n_convs"), "own")
        if nodes.isEmpty():
            break
        above.append(nodes)
        bucket = dealt.filter("large").select(F.col("child").alias("bucket"), "rep", "n", "ends", "ids", "bytes")

    strings = local[0]
    for x in local[1:]:
        strings = strings.unionByName(x)
    finished = materialise(strings.repartition("depth", "child").sortWithinPartitions("depth", "child").mapInArrow(_finish, f"{NODES}, top boolean"), "trie-nodes", compression="zstd")
    cols = [c.split()[0] for c in NODES.split(", ")]
    out, dealt = finished.select(*cols), None
    for d in reversed(range(len(above))):  # nodes of dealt buckets, from below
        sums = finished.filter(F.col("top") & (F.col("depth") == d + 1)).select(*cols)
        sums = sums if dealt is None else sums.unionByName(dealt)
        sums = sums.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        mine = above[d].join(sums, "conv_id", "left").join(ended[d], "conv_id", "left")
        zero = F.lit(0).cast("long")
        mine = mine.withColumns({"n_children": F.coalesce("n_children", zero), "n_leaves": F.coalesce("n_leaves", F.lit(1).cast("long")), "saved_tokens": (F.col("n_convs") - 1) * F.col("own") + F.coalesce("below", zero), "ends_sha256": F.coalesce("ends", F.lit(NO_ENDS))})
        dealt = materialise(mine.select(*cols), "trie-upper")
        out = out.unionByName(dealt)
    return out
