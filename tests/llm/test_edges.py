"""Null identifiers, rows repeated as a whole, clashing columns and empty tables for each operator; every registered query."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelatlas.llm import embed_dedup, mixing, ngram_lm, packing, queries, simhash, substring_dedup, token_files
from panelatlas.llm.tokens import default_vocabulary, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, fp long, rep long, h long, n int, a long, b long, k long, part int, digest string, block long, slot long, offset long, start long, node long, component long, score double, words int"
CLASH = (1, 2, 3, 4, 5, 6, 7, 8, "d", 9, 10, 11, 12, 13, 14, 0.5, 15)
LONG = " ".join(f"w{i}" for i in range(50))
ROWS = [(None, "no id", "s"), (None, None, None), (None, "no id", "s"), (4, LONG, "s"), (4, LONG, "s"), (5, "x " + LONG, None), (6, "", "t"), (7, None, "t"), (-3, "below zero", "s"), (2**40, "one two three four five six", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], SCHEMA).repartition(3)


def _ids(rows):
    return Counter(r.doc_id for r in rows)


def test_simhash(docs):
    got = simhash.near_components(docs).collect()
    assert _ids(got) == _ids(docs.collect())
    of = {r.doc_id: r for r in got}
    assert of[None].component_id is None and of[6].component_id == of[7].component_id == 6 and len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert simhash.near_components(docs.limit(0)).count() == 0


def test_packing_and_token_files(docs):
    enc = encoder(default_vocabulary())
    ids = lambda t, end: np.array([*np.frombuffer(enc.whole(t or ""), "<u4"), end], dtype="<u4")
    pieces = packing.pack(docs, default_vocabulary(), end_id=2).collect()
    assert sum(r.length for r in pieces) == sum(len(ids(r[1], 2)) for r in ROWS)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.length for r in pieces if r.doc_id is None) == sum(len(ids(t, 2)) for d, t, _ in ROWS if d is None)
    got = token_files.read_token_files(token_files.write_token_files(docs, default_vocabulary(), end_id=1, shards=2)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids(t, 1)), zlib.crc32(ids(t, 1).tobytes())) for d, t, _ in ROWS)
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))]


def test_mixing(docs):
    got = mixing.mix(docs, {"s": 2}, block_rows=2).collect()
    assert _ids(got) == _ids(docs.collect()) and len({(r.slot, r.place_in_block) for r in got}) == len(got)
    mixed = mixing.in_mixed_order(docs, {"s": 2}, block_rows=2)
    assert mixed.columns == docs.columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, docs.collect()))


def test_substring_dedup(docs):
    got = substring_dedup.remove_repeats(docs).collect()
    assert _ids(got) == _ids(docs.collect())
    of = {r.doc_id: r for r in got}
    assert [r.n_removed for r in got if r.doc_id == 4] == [50, 50] and of[5].n_removed == 50 and of[5].kept_sha256 == hashlib.sha256(b"x").hexdigest() and of[-3].n_removed == 0


def test_language_model(docs):
    got = ngram_lm.score_texts(docs, queries.id_bucket(F.col("doc_id"), 7) == 2).collect()
    assert _ids(got) == _ids(docs.collect())
    held = {i for i, _, _ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    train = [t for i, t, _ in ROWS if i not in held]
    assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for t in train)} and {r.doc_id for r in got if r.held_out} == held


def test_embeddings(spark):
    x = [[1.0, 0.0], [0.99, 0.01], [0.0, 1.0]]
    rows = [(None, x[0]), (None, None), (3, x[0]), (3, x[0]), (1, x[1]), (9, x[2]), (-5, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<float>, a int, tile int, x double").repartition(2)
    got = embed_dedup.near_vectors(table).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)
    of = {r.vec_id: r for r in got}
    assert of[3].component_id == of[1].component_id == 1 and of[9].n_links == of[-5].n_links == 0 and of[-5].kept and not of[3].kept
    assert embed_dedup.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    out = queries.QUERIES[name](spark, SF).cache()
    table = {"op1": "pages", "op11": "pages", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.split("_")[0] not in ("op3", "op12", "op13"):  # these give pieces, ranks and nodes
        assert out.count() == n
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)
    if "held_out" in out.columns:
        mod, at = (5, 0) if name.startswith("op4") else (7, 2)
        assert {r.doc_id for r in out.filter("held_out").collect()} == {r.doc_id for r in out.collect() if zlib.crc32(str(r.doc_id).encode()) % mod == at}


def test_toxicity_does_not_see_held_out_labels(spark, tmp_path):
    (tmp_path / "documents.parquet").symlink_to(f"{SF}/documents.parquet")
    held = queries.id_bucket(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")).write.parquet(str(tmp_path / "labels.parquet"))
    scores = lambda at: {r.doc_id: r.score for r in queries.op4_toxicity(spark, str(at)).collect()}
    assert scores(tmp_path) == scores(SF)
