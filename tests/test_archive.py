"""Archives, names, catalogues, shapes."""

import gzip
import json
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from panelatlas.functions import names as L
from panelatlas.operators import geo as G
from panelatlas.operators.fuzzy import fuzzy_match
from panelatlas.sources import archives as A
from panelatlas.sources import catalog as K


def _one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_names(spark):
    assert _one(spark, L.lookup_key, "Parte del Comune di L'Aquila", "ForlÃ¬ & Cò", None, "  ") == ["l aquila", "forli e co", "", ""]
    assert _one(spark, lambda c: L.lookup_keys(c, {"roma": "Urbe Eterna"}), "Bolzano/Bozen", "Roma", None) == [["bolzano bozen", "bolzanobozen", "bolzano", "bozen"], ["roma", "urbe eterna", "urbeeterna"], []]
    assert _one(spark, L.smart_title, "REGGIO DI CALABRIA", "L'AQUILA CITTA'", "Ro  ma", "SANT'ANGELO D'ALIFE", None, '"X-Y"') == ["Reggio di Calabria", "L'Aquila citta'", "Ro ma", "Sant'Angelo d'Alife", "", "X-Y"]
    assert _one(spark, L.municipality_name, "x Comune  di  SOPRA", "x", None) == ["Di Sopra", "", ""]
    named = lambda c: L.province_named(c, F.lit("Edolo"), {r"\(LECCO\)": "Lecco"}, {"edolo": "Brescia"})
    assert _one(spark, named, "Provincia COMO", "(VARESE) Comune x", "in (lecco)", "", None) == ["Como", "Varese", "Lecco", "Brescia", "Brescia"]
    row = spark.createDataFrame([("Elettori 1.200 votanti 900 75,0 % Schede bianche 3",)], "x string").select(L.turnout_figures(F.col("x"))).first()
    assert tuple(row) == ("1.200", "900", "75,0", "3", "", "")
    rows = [("Totale", "Liste", None, 5), ("Totale", "candidati", None, 5), ("a", "A", None, 5), ("x", "", " y ", 5), ("x", "", "", None), (None, None, None, 3), ("p", None, None, 0)]
    kinds = spark.createDataFrame(rows, "a string, b string, c string, n long").select(L.row_kind(F.col("a"), F.col("b"), F.col("c"), F.col("n"), []).alias("k")).select("k.*")
    assert [tuple(r) for r in kinds.collect()] == [("list_total", None), ("skip", None), ("skip", None), ("party", "y"), ("skip", None), ("skip", None), ("skip", None)]


def test_fuzzy_against_all_pairs(spark):
    words = ["san pietro in valle", "san pietro in vale", "san pietro valle", "castelnuovo di sopra", "castelnovo di sopra", "castelnuovo di sotto", "roma", "rome", "aaaaaaaaaaaa", "aaaaaaaaaaab", "baaaaaaaaaaa", "", "montebelluna", "montebeluna", "x"]
    names = [(i, w, r) for r in ("n", "s") for i, w in enumerate(words)] + [(99, None, "n"), (98, "roma", None)]
    places = [(f"p{i}", w[:9] + "z" + w[9:], "n") for i, w in enumerate(words)] + [("q", "montebellunna", "n"), ("q2", None, "n")]
    got = {(r.name_id, r.place_id): r.score for r in fuzzy_match(spark.createDataFrame(names, "name_id long, name string, region string"), spark.createDataFrame(places, "place_id string, name string, region string")).collect()}
    want = {}
    for i, w, r in names:
        hits = {p: SequenceMatcher(None, w, v).ratio() for p, v, q in places if w and v and r == q and abs(len(w) - len(v)) <= 8}
        hits = {p: s for p, s in hits.items() if s >= 0.91}
        if len(hits) == 1:
            want[(i, next(iter(hits)))] = next(iter(hits.values()))
    assert got == want and len(want) > 2


def test_zips_tables_and_listing(spark, tmp_path):
    root = tmp_path / "in"
    (root / "camera_1948" / "existing" / "clean").mkdir(parents=True)
    (root / "camera_1948" / "existing" / "clean" / "a.csv").write_text("k,v\n1,\"2\n3\"\n")
    (root / "camera_1953" / "x").mkdir(parents=True)
    (root / "camera_1953" / "x" / "b.json").write_text('{"features": [1, 2]}')
    files = A.listing(spark, str(root))
    assert {r.path for r in files.collect()} == {"camera_1948/existing/clean/a.csv", "camera_1953/x/b.json"}
    assert {tuple(r) for r in A.elections(files).collect()} == {("camera_1948", 1948, "camera_1948/existing/clean/", None), ("camera_1953", 1953, None, None)}
    asked = spark.createDataFrame([("./clean/a.csv",), ("lean/a.csv",), ("b.json",)], "name string")
    assert {tuple(r) for r in A.resolve(files, asked).collect()} == {("./clean/a.csv", "camera_1948/existing/clean/a.csv"), ("lean/a.csv", None), ("b.json", "camera_1953/x/b.json")}
    seen = {r.path.rsplit("/", 1)[1]: r for r in K.file_summaries(spark, str(root)).collect()}
    assert seen["a.csv"].row_count == 1 and seen["a.csv"].columns == ["k", "v"] and tuple(seen["b.json"].counts) == ("feature_count", 2)
    missing = K.file_checks(spark, {"files": {"a": "camera_1953/x/b.json", "b": "no.csv"}}, files, ["b", "c"])
    assert {r.issue for r in missing.collect()} == {"manifest:missing_file_for_b", "manifest:missing_c"}

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("preferenze.csv", "no;no\n1;2\n")
        z.writestr("camera-1.txt", 'A; "B" ;C\n1; "citt\xe0" ;3\n\n4;5\n'.encode("cp1252"))
    (stock,) = A.zip_inventory(spark, str(tmp_path / "z.zip")).collect()
    assert (stock.entry_count, stock.csv_members, stock.xlsx_members) == (2, ["preferenze.csv"], [])
    entries = spark.createDataFrame([("z.zip", 1963, None)], "filename string, year int, election_type string")
    rows = A.zip_rows(spark, str(tmp_path / "z.zip"), entries, ["B", "A", "D"]).orderBy("row").collect()
    assert [(r.row, r.A, r.B, r.D) for r in rows] == [(1, "1", "citt\xe0", None), (2, "4", "5", None)]

    html = "<title>T</title><table><tr><th>a<th>b<tr><td>1<td> x  y </table><table><tr><td colspan=2>q<tr><td>r</table>"
    pages = spark.createDataFrame([("u", "f", html), ("u2", "g", None)], "url string, html_file string, html string")
    got = [(r.table_idx, r.rownum, r.column_name, r.cell_value, r.title) for r in A.table_cells(pages).collect()]
    assert got == [(0, 0, "a", "1", "T"), (0, 0, "b", "x y", "T"), (1, 0, "0", "q", "T"), (1, 0, "1", "q", "T"), (1, 1, "0", "r", "T"), (1, 1, "1", None, "T")]
    page = '["Camera", "1963", "r/a.zip", "a.zip", "28/04"], ["camera","1963","r/b","a.zip","x"], ["senato","1","r","s.zip","d"]'
    assert [tuple(r) for r in _one(spark, A.consultations, page)[0]] == [("camera", 1963, "r/a.zip", "a.zip", "28/04")]


def test_sinks_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "k string, v int")
    K.export(rows, str(tmp_path / "p"))
    K.export(rows, str(tmp_path / "g"), "csv.gz")
    K.export(rows.limit(0), str(tmp_path / "none"))
    (empty,) = (tmp_path / "none").glob("*.csv")
    assert empty.read_text() == "k,v\n"
    assert any("k,v" in gzip.open(f, "rt").read() for f in (tmp_path / "g").glob("*.csv.gz"))
    report = K.compression_report(A.listing(spark, str(tmp_path / "p")), A.listing(spark, str(tmp_path / "g"))).first()
    assert report.original_bytes > 0 and report.reduction_pct == round(100 * (1 - report.compressed_bytes / report.original_bytes), 2)
    assert K.compression_report(A.listing(spark, str(tmp_path / "p")).limit(0), A.listing(spark, str(tmp_path / "p")).limit(0)).first().reduction_pct == 0
    assert {tuple(r) for r in K.shard_index(rows, "k", "s").collect()} == {("e1", "s/k=e1", 2), ("e2", "s/k=e2", 1)}
    assert K.contract(rows, {"w": "string", "v": "bigint"}).dtypes == [("w", "string"), ("v", "bigint")]
    assert [tuple(r) for r in K.codebook(spark, {"t": rows.schema}, {"t": ["k"]}).collect()] == [("t", 0, "k", "string", True, True), ("t", 1, "v", "int", True, False)]
    issues = spark.createDataFrame([("a", 0), ("b", 2)], "issue string, affected long")
    payload = json.loads(K.audit_payload({"metric": "turnout"}, spark.createDataFrame([(90, "strong")], "trust_score int, trust_status string"), issues).first()[0])
    assert payload == {"view": '{"metric": "turnout"}', "trust_score": 90, "trust_status": "strong", "issues": [{"issue": "b", "affected": 2}]}


def test_shapes(spark):
    ring = lambda *xy: [(float(x), float(y)) for x, y in xy]
    square = ring((0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10), (0, 0))
    rows = spark.createDataFrame([(1, square), (2, square[:3]), (3, []), (4, None), (5, ring((0, 0), (0.1, 0), (0.2, 0), (0.1, 0.1), (0, 0)))], "id long, ring array<struct<x:double,y:double>>")
    done = {r.id: None if r.ring is None else [tuple(p) for p in r.ring] for r in G.simplified(rows, 1.0).collect()}
    assert done[1] == ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)) and done[2] == square[:3] and done[3] == [] and done[4] is None
    assert done[5] == ring((0, 0), (0.1, 0), (0.2, 0), (0, 0))
    report = G.simplification_report(rows.filter("id = 1"), G.simplified(rows, 1.0).filter("id = 1")).first()
    assert (report.points_before, report.points_after) == (6, 5) and 0 < report.reduction_pct < 40
    arcs = spark.createDataFrame([(0, [(0, 0), (1, 0), (0, 1)]), (1, [(0, 0), (1, 1)])], "arc int, points array<struct<x:int,y:int>>")
    shapes = spark.createDataFrame([("s", 0, [0, -2])], "id string, ring int, arcs array<int>")
    (topo,) = A.topology_rings(arcs, shapes, (2.0, 2.0), (1.0, 0.0)).collect()
    assert [tuple(p) for p in topo.points] == ring((1, 0), (3, 0), (3, 2), (1, 0))
    sides = spark.createDataFrame([(1, "a", "p", "r"), (2, "a", "p", "r"), (2, "b", "q", "r"), (3, "a", None, "r"), (3, "b", None, "s"), (4, "a", None, None), (4, "b", None, None)], "arc int, id string, province string, region string")
    assert {tuple(r) for r in G.border_kinds(sides).collect()} == {(1, "outline"), (2, "province"), (3, "region"), (4, "municipality")}


def test_document_checks_broadcast_no_table(spark):
    from panelatlas.plans import archive  # noqa: F401
    from panelatlas.plans.registry import QUERIES

    plan = QUERIES["v08_document_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_fuzzy_names_of_common_pieces_make_few_pairs(spark):
    from panelatlas.operators import fuzzy

    places = spark.range(3000).selectExpr("CAST(id AS STRING) AS place_id", "concat('nation_12 ', 100000 + id * 17) AS name", "'r' AS region")
    names = places.selectExpr("place_id AS name_id", "concat(substring(name, 1, 3), 'x', substring(name, 4)) AS name", "region")
    left, right = names, places.withColumnRenamed("name", "place")
    assert fuzzy._by_letters(left, right, fuzzy._levels(left, right)).distinct().count() < 40_000  # of 9,000,000
    got = {(r.name_id, r.place_id) for r in fuzzy_match(names.limit(200), places.limit(200)).collect()}
    n, p = names.limit(200).collect(), places.limit(200).collect()
    met = {a.name_id: [b.place_id for b in p if SequenceMatcher(None, a.name, b.name).ratio() >= 0.91] for a in n}
    assert got == {(a, b[0]) for a, b in met.items() if len(b) == 1}


def test_fuzzy_names_that_met_two_places_make_no_more_pairs(spark, monkeypatch):
    from panelatlas.operators import fuzzy

    ids = spark.range(70).selectExpr("explode(array(id + 1000, id + 100000)) AS id")
    places = ids.selectExpr("CAST(id AS STRING) AS place_id", "concat('united kingdom ', id) AS name", "'r' AS region")
    insert = lambda rows, x: rows.selectExpr("place_id AS name_id", f"concat(substring(name, 1, 3), '{x}', substring(name, 4)) AS name", "region")
    more = spark.createDataFrame([("s", "le clocher \U0001f40e vert 77", "r"), ("t", "le clocher \U0001f40e vert 7", "r")], places.schema)
    alien, known = insert(places, "x"), insert(places, "e").unionByName(more.selectExpr("place_id AS name_id", "concat(name, '7\U0001f40d') AS name", "region"))
    rows = lambda p: p.withColumnRenamed("name", "place")
    assert fuzzy._levels(alien, rows(places)).filter("not few").isEmpty()  # what no place has is over, so few letters are left to choose
    assert not fuzzy._levels(known, rows(places)).filter("not few").isEmpty()
    came, by_pieces = [], fuzzy._by_pieces
    monkeypatch.setattr(fuzzy, "_by_pieces", lambda left, right, levels: (came.extend(r.name_id for r in left.collect()), by_pieces(left, right, levels))[1])
    everywhere = places.unionByName(more)
    p = everywhere.collect()
    for names in (alien, known):
        met = {a.name_id: [b.place_id for b in p if abs(len(a.name) - len(b.name)) <= 8 and SequenceMatcher(None, a.name, b.name).ratio() >= 0.91] for a in names.collect()}
        assert {(r.name_id, r.place_id) for r in fuzzy_match(names, everywhere).collect()} == {(a, b[0]) for a, b in met.items() if len(b) == 1}
    assert len(came) < 40  # of 142 names whose pieces are everyone's
