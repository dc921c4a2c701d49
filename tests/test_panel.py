"""Hand-computed answers for the panel's functions and operators."""

import pytest
from pyspark.sql import functions as F

from panelatlas.functions import numeric as N
from panelatlas.functions import text as X
from panelatlas.functions.taxonomy import party_meta
from panelatlas.operators import cluster, quality, trajectory
from panelatlas.sources.bundle import Bundle, write_shards
from panelatlas.streaming.incremental import follow, replace_by_key


@pytest.mark.parametrize("raw, a, b, c, d", [("1.234,5", 1234.5, 1234.5, 12345, 12345), ("1.234", 1234.0, 1.234, 1234, 1234), ("1.000", 1000.0, 1.0, 1, 1), ("1.5", 1.5, 1.5, 15, 1500), ("45,6%", 45.6, None, 456, 456), ("abc", None, None, None, None), (None, None, None, None, None)])
def test_number_parsers(spark, raw, a, b, c, d):
    x = spark.createDataFrame([(raw,)], "x string").select(N.safe_float(F.col("x")), N.safe_number(F.col("x")), N.safe_count(F.col("x")), N.archive_count(F.col("x"))).first()
    assert tuple(x) == (a, b, c, d)


def test_denominator_and_repair(spark):
    rows = spark.createDataFrame([(100, 104, None, None), (100, 106, None, None), (None, None, 100, 1.0), (None, None, None, None)], "valid long, party long, voters long, raw double")
    got = [r[0] for r in rows.select(N.share_denominator(*[F.col(c) for c in rows.columns])["denominator"]).collect()]
    assert got == [100.0, 106.0, 100.0, None]
    fixed = spark.createDataFrame([(12, 60.0, 200.0), (119, 60.0, 200.0)], "v long, s double, d double").select(N.repair_magnitude(F.col("v"), F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in fixed] == [120, 119]


def test_notes_and_completeness(spark):
    row = spark.createDataFrame([(None, "a|b", "b|c", "turnout_from_clean|party_rows_checked", "x|party_rows_checked")], "flag string, p string, q string, r string, s string")
    out = row.select(*[X.is_complete(F.col("flag"), m) for m in ("all", "complete", "non_partial", "partial", "unknown")], X.join_notes(F.col("p"), F.col("q")), X.has_meaningful_note(F.col("r")), X.has_meaningful_note(F.col("s"))).first()
    assert tuple(out) == (True, False, False, False, True, "a|b|c", False, True)


def test_taxonomy_first_rule_wins(spark):
    rows = spark.createDataFrame([("Rifondazione Comunista",), ("DC",), (None,)], "x string").select(party_meta(F.col("x"))["display"]).collect()
    assert [r[0] for r in rows] == ["Azione / IV", "DC", "N/D"]


def _series(spark, leaders, shares):
    return spark.createDataFrame([(f"e{2000 + i}", 2000 + i, "m", leader, share, share, 50.0) for i, (leader, share) in enumerate(zip(leaders, shares))], "election_key string, election_year int, municipality_id string, first_party_std string, share double, first_party_share double, turnout_pct double")


def test_sequences(spark):
    s = _series(spark, ["A", None, "A", "B", "A"], [10.0, None, 14.0, 11.0, 11.0])
    assert trajectory.dominance_changes(s).first()["changes"] == 2
    assert trajectory.volatility(_series(spark, ["A"] * 4, [10.0, None, 14.0, 11.0])).first()["volatility"] == 3.5
    runs = trajectory.leader_runs(_series(spark, ["A", "A", "B", "A"], [1.0] * 4)).orderBy("from_year").collect()
    assert [(r.leader, r.elections) for r in runs] == [("A", 2), ("B", 1), ("A", 1)]
    found = trajectory.breaks(_series(spark, ["A"] * 3, [10.0, 12.0, 20.0])).collect()
    assert [(r.from_year, r.d_share) for r in found] == [(2001, 8.0)]
    for shares, label in (([10.0, 15.0], "crescita netta"), ([10.0, 14.9], "andamento stabile"), ([10.0, 5.0], "calo netto"), ([10.0], "trend n/d"), ([None], "trend n/d")):
        assert trajectory.trend(_series(spark, ["A"] * len(shares), shares)).first()["trend"] == label


def test_quality(spark):
    checks = spark.createDataFrame([("a", "error", 3), ("b", "warning", 1), ("c", "warning", 9), ("d", "error", 0)], "check string, severity string, affected long")
    assert quality.readiness(checks).first()[0] == 55
    row = spark.createDataFrame([("partial", "x", "harmonized", None, None, True)], "completeness_flag string, comparability_note string, territorial_mode string, territorial_status string, lineage_note string, has_geometry boolean")
    assert quality.row_trust(row).first()["trust_score"] == 56  # 100 - 28 partial - 12 note - 4 harmonized
    more = spark.createDataFrame([("unknown", "no_party_rows_detected", None, "Fuso nel 1990", "x", False), ("turnout_only", None, None, None, None, True), ("turnout_only partial", None, None, None, None, None)], row.schema)
    assert [r["trust_score"] for r in quality.row_trust(more, compare_missing=True).collect()] == [100 - 22 - 12 - 8 - 12 - 10 - 6 - 18, 70, 32]
    assert quality.view_trust(more).first()["trust_score"] == 100 - 28 - 22 - 10 - 8
    assert quality.view_trust(more, geometry_loaded=False, compare_missing=True, harmonized=True).first()["trust_score"] == 100 - 18 - 22 - 10 - 8 - 20 - 4
    assert quality.view_trust(row.limit(0)).first()["trust_score"] == 0


def test_clusters(spark):
    assert [cluster.cluster_count(n) for n in (5, 6, 24, 54)] == [0, 3, 4, 5]
    rows = [(f"{i:02d}", float(x), 0.0, 0.0, 0.0, 0.0, 0.0) for i, x in enumerate([0, 50, 100, 1, 51, 101])]
    got = {r[0]: r[1] for r in cluster.kmeans(spark.createDataFrame(rows, ["municipality_id", *cluster.FEATURES])).collect()}
    assert got == {"00": 0, "01": 1, "02": 2, "03": 0, "04": 1, "05": 2}


def test_shards_bundle_and_increments(spark, tmp_path):
    import hashlib
    import json

    rows = spark.createDataFrame([("e1", "a", 1), ("e1", "b", 2), ("e2", "a", 3)], "election_key string, municipality_id string, votes long")
    counts = {r[0]: r[1] for r in write_shards(rows, str(tmp_path / "b" / "results")).collect()}
    assert counts == {"e1": 2, "e2": 1}
    (tmp_path / "b" / "x.csv").write_text("k,v\n1,2\n")
    sha = hashlib.sha256(b"k,v\n1,2\n").hexdigest()
    (tmp_path / "b" / "manifest.json").write_text(json.dumps({"files": {"municipality_results_long": "results", "x": "x.csv"}, "hashes": {"x": {"path": "x.csv", "sha256": sha}, "y": {"path": "y.csv", "sha256": "0"}, "z": {}}}))
    bundle = Bundle(spark, str(tmp_path / "b"))
    assert bundle.load("x").first()["v"] == "2"
    assert {r[0]: r[1] for r in bundle.verify_integrity().collect()} == {"x": "ok", "y": "missing_file", "z": "missing_path"}
    new = spark.createDataFrame([("e2", "c", 9)], rows.schema)
    assert {tuple(r) for r in replace_by_key(rows, new).collect()} == {("e1", "a", 1), ("e1", "b", 2), ("e2", "c", 9)}
    new.write.parquet(str(tmp_path / "in"))
    follow(spark, str(tmp_path / "in"), "election_key string, municipality_id string, votes long", str(tmp_path / "b" / "results"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.election_key, r.votes) for r in spark.read.parquet(str(tmp_path / "b" / "results")).collect()} == {("e1", 1), ("e1", 2), ("e2", 9)}


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 55


def test_fill_from_context_and_whole_tokens(spark, tmp_path):
    from panelatlas.operators.panel import fill_from_context
    from panelatlas.plans.registry import QUERIES

    rows = [("e1", "a", "X"), ("e1", "a", None), ("e1", "a", " "), ("e1", "b", "X"), ("e1", "b", "Y"), ("e1", "b", ""), ("e2", "a", None), ("e1", None, "Z"), ("e1", None, None)]
    out = fill_from_context(spark.createDataFrame(rows, "e string, c string, p string"), ["e", "c"], "p").collect()
    assert sorted((r.e, r.c or "", r.p or "") for r in out) == sorted([("e1", "a", "X")] * 3 + [("e1", "b", "X"), ("e1", "b", "Y"), ("e1", "b", ""), ("e2", "a", ""), ("e1", "", "Z"), ("e1", "", "Z")])
    for name in ("lineitem", "orders", "customer", "nation", "region", "part"):  # the panel reads them, too
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    spark.createDataFrame([(1, "È" + "ab " * 30)], "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["f09_token"](spark, str(tmp_path)).first().token == "e" + ("ab " * 30).strip()


def test_view_state():
    from panelatlas.plans.view_state import ViewState

    v = ViewState("e1", metric="swing_compare", group_mode="bloc", provinces=("A|", "B")[1:] + ("C",), compare_municipalities=tuple("12345"), min_share=2.5, page=3)
    n = v.normalised()
    assert (n.group_mode, n.compare_municipalities) == ("party_raw", ("1", "2", "3", "4"))
    assert ViewState.of(v.query()) == n and ViewState.of(n.params()) == n and "party=" not in n.query()
    assert ViewState.of({"metric": "dominant_block"}).group_mode == "bloc" and ViewState.of({"metric": "?"}).metric == "turnout"
