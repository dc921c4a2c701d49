"""The stored panel, and names resolved, searched and normalised, against brute force."""

import random
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from panelatlas.functions import text as X
from panelatlas.operators import panel as P
from panelatlas.operators import resolve as V
from panelatlas.plans import registry
from panelatlas.sources import panel_store
from panelatlas.sources.panel_store import PanelStore

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_prunes_and_replaces(spark):
    p = registry.Panel(spark, SF)
    assert registry.Panel(spark, SF).store is p.store  # stored once
    one = p.store.elections("e1995")
    assert "PartitionFilters: [isnotnull(election_key" in _plan(one) and "e1995" in _plan(one)
    here = p.cells.filter("municipality_id = '42'")
    assert "EqualTo(municipality_id,42)" in _plan(here) and "Exchange" not in _plan(p.cells.groupBy("municipality_id").count())
    n, e = p.cells.count(), one.count()
    store = PanelStore.write(p.cells, buckets=3)
    new = one.limit(1).withColumn("electors", F.lit(-1).cast("long"))
    for _ in range(2):  # a repetition changes nothing
        store.put(new)
        assert store.cells().count() == n - e + 1 and [r.electors for r in store.elections("e1995").collect()] == [-1]


@pytest.mark.parametrize("name", ["p12_metrics", "m04_similarity", "w06_stability", "v01_validations", "a17_transitions", "a27_summary"])
def test_queries_scan_the_cells_alone(spark, name):
    plan = _plan(registry.QUERIES[name](spark, SF))
    assert 1 <= plan.count("FileScan parquet spark_catalog.default.panel_") <= (4 if name == "m04_similarity" else 2)  # M04 also makes its clusters
    assert "lineitem" not in plan and (name not in ("p12_metrics", "w06_stability", "a27_summary") or "Exchange" not in plan)


def test_store_has_more_parts_for_larger_files(spark, monkeypatch):
    monkeypatch.setattr(panel_store, "PART_BYTES", 16 << 10)
    monkeypatch.setattr(registry, "STORES", {})
    whole = registry.Panel(spark, SF)
    size = sum(x for t in registry.TABLES for _, x, _ in panel_store.fingerprint(spark, [f"{SF}/{t}.parquet"]))
    buckets = spark.sql(f"DESCRIBE FORMATTED {whole.store.name}").filter("col_name = 'Num Buckets'").first()["data_type"]
    assert int(buckets) == -(-size // (16 << 10)) > 4 and spark.conf.get("spark.sql.shuffle.partitions") == "4"  # the session's number is back
    monkeypatch.setattr(panel_store, "PART_BYTES", 1 << 30)
    monkeypatch.setattr(registry, "STORES", {})
    few = registry.Panel(spark, SF)
    assert sorted(map(str, P.by_party(few.cells).collect())) == sorted(map(str, P.by_party(whole.cells).collect()))
    assert registry.QUERIES["m04_similarity"](spark, SF).count() > 0
    with pytest.raises(ZeroDivisionError), panel_store.exchanging(spark, 9):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9" and 1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_vectors_do_not_move_cells_by_election(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with cells that are large
    try:
        plan = _plan(registry.vectors(registry.Panel(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # the nation's sums


def test_cells_of_odd_lines(spark):
    schema = "election_key string, election_year int, municipality_id string, province string, region string, party_raw string, party_std string, party_family string, bloc string, q long, rf string, ls string"
    row = lambda m, raw, std, q, rf, ls="O": ("e1", 2001, m, "p", "r", raw, std, "f" + std, "b" + std, q, rf, ls)
    lines = spark.createDataFrame([row("a", "x1", "x", 5, "N"), row("a", "x2", "x", 5, "N"), row("a", "y1", "y", 10, "A"), row("a", "z1", "z", 7, "R", "F"), row("b", "z1", "z", 3, "R")], schema)
    got = {r.municipality_id: r for r in P.cells(lines).collect()}
    a, b = got["a"], got["b"]
    assert (a.electors, a.voters, a.valid_votes, a.first_party_std, a.second_party_std, a.first_second_margin, a.dominant_block) == (27, 27, 20, "x", "y", 0.0, "bx")
    assert [(x.party_std, x.votes) for x in a.parties] == [("x", 10), ("y", 10)] and {x.party_raw for x in a.raws} == {"x1", "x2", "y1"}
    assert (b.electors, b.voters, b.valid_votes, b.turnout_pct, b.first_party_std, b.parties, b.raws) == (3, 0, 0, 0.0, None, [], [])
    shares = {(m, r.municipality_id): r.share for m, who in (("party_raw", "x2"), ("bloc", "by"), ("party_std", "none")) for r in P.own_share(P.cells(lines), who, m).collect()}
    assert shares == {("party_raw", "a"): 25.0, ("party_raw", "b"): None, ("bloc", "a"): 50.0, ("bloc", "b"): None, ("party_std", "a"): None, ("party_std", "b"): None}
    assert P.cells(lines.limit(0)).count() == 0


def _token(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in low).split())


def test_tokens_are_those_of_full_decomposition(spark):
    odd = ["Ǻngström Ṩ ḝ", "été", "KÅ Å", "İI ı ß Æ ﬁ ½", "Việt ệ Ǖ", "日本 한글", "", "̀́", None, "O’Brien–X"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(x,) for x in odd], "text string"))
    for r in docs.select("text", X.token(F.col("text")).alias("t")).collect():
        assert r.t == (None if r.text is None else _token(r.text))


def _rewritten(url):
    import re

    parsed = urlparse(url or "")
    params = dict(parse_qsl(parsed.query, keep_blank_values=True))
    for level in "1234":
        for key in (f"lev{level}", f"ne{level}"):
            m = re.fullmatch(r"(.+?)-lev(\d)(\d+)", params.get(key, "").strip())
            if m:
                params |= {f"ne{m[2]}": m[1], f"lev{m[2]}": m[3]}
                params = {f"es{m[2]}": "N", f"levsut{m[2]}": m[2]} | params
    if params.get("lev3") not in (None, "", "0"):
        params["tpe"] = "C"
    return urlunparse((parsed.scheme, parsed.netloc, parsed.path, parsed.params, urlencode(sorted(params.items())), ""))


def test_rewritten_urls(spark):
    rnd = random.Random(2)
    names = ["lev1", "ne1", "lev2", "ne2", "lev3", "ne3", "lev4", "ne4", "a", "es2", "levsut3", "x%20y", "tpe"]
    values = ["", "0", "12", "roma-lev37", "b-lev24", "c-lev11-lev42", "-lev12", "d-lev3", "%C3%A9+%2B*~", "q=r", "a/b"]
    urls = [f"HTTP{rnd.choice(['', 's'])}://h.It/{i}/p?" + "&".join(f"{rnd.choice(names)}{rnd.choice(['=', '=', ''])}{rnd.choice(values)}" for _ in range(rnd.randint(0, 7))) + rnd.choice(["", "#f?x=1"]) for i in range(400)]
    for r in spark.createDataFrame([(u,) for u in [*urls, None, "", "rel/path?b=1&a=2"]], "u string").select("u", X.historical_url(F.col("u")).alias("v")).collect():
        assert r.v == _rewritten(r.u), r.u


def test_prefixes_of_any_length(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7)))
    known, names = [(word(), str(rnd.randint(0, 5)), rnd.choice("pq")) for _ in range(12)], [(word(), rnd.choice("pqr")) for _ in range(60)] + [("", "p"), (None, "p"), ("a", None)]
    k, n = spark.createDataFrame([*known, (None, "9", "p"), ("", "9", "p")], "known_name string, id string, on string"), spark.createDataFrame(names, "name string, on string")
    for on in ((), ("on",)):
        got = {(r.name, *(r[c] for c in on)): r.id for r in V.prefix_match(n, k, on).collect()}
        want = {}
        for name, o in names:
            ids = {i for w, i, p in known if name and (w.startswith(name) or name.startswith(w)) and (not on or p == o)}
            if len(ids) == 1:
                want[(name, *([o] if on else []))] = ids.pop()
        assert got == want and want


def test_cascade_of_ten_strategies(spark):
    rnd = random.Random(11)
    stem = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    stems = [stem() for _ in range(40)]
    place = lambda tag, i: (rnd.choice(stems) + rnd.choice(["", "", "x"]), rnd.choice("PQR"), rnd.choice("ST"), f"{tag}{i % 30}")
    geometry, historical = [place("g", i) for i in range(40)] + [("abcdefghabcd", "P", "S", "g77")], [place("h", i) for i in range(40)]
    overrides = [(stems[0], "m0"), (stems[1], "m1")]
    names = []
    for row in range(300):
        for c in range(rnd.randint(1, 3)):
            names.append((row, c, rnd.choice([rnd.choice(stems), rnd.choice(stems)[:3], rnd.choice(stems) + "yz", "zzz", "", None, "abcdeefghabcd"]), rnd.choice("PQRZ"), rnd.choice(["S", "T", None])))
    by = lambda rows, f: {k: min(r[3] for r in rows if f(r) == k) for k in {f(r) for r in rows}}
    alone = lambda rows: {k: ids.pop() for k in {r[0] for r in rows} if len(ids := {r[3] for r in rows if r[0] == k}) == 1}
    tables = [(dict(overrides), lambda n: n[2])]
    for rows in (geometry, historical):
        tables += [(by(rows, lambda r: (r[0], r[1])), lambda n: (n[2], n[3])), (by(rows, lambda r: (r[0], r[2])), lambda n: (n[2], n[4])), (alone(rows), lambda n: n[2])]
    want = {}
    for row in range(300):
        own = [n for n in names if n[0] == row]
        hit = next(((n[1], i, t[key(n)]) for n in own if n[2] for i, (t, key) in enumerate(tables) if key(n) in t), None)
        for i, near in ((7, lambda n, h: n[3] == h[1]), (8, lambda n, h: True)):
            met = {(h[3]) for n in own for h in historical if n[2] and near(n, h) and (h[0].startswith(n[2]) or n[2].startswith(h[0]))}
            first = min((n[1] for n in own for h in historical if n[2] and near(n, h) and (h[0].startswith(n[2]) or n[2].startswith(h[0]))), default=None)
            hit = hit or ((first, i, met.pop()) if len(met) == 1 else None)
        n = own[0]
        met = {g[3] for g in geometry if n[2] and g[2] == n[4] and abs(len(g[0]) - len(n[2])) <= 8 and SequenceMatcher(None, n[2], g[0]).ratio() >= 0.91}
        hit = hit or ((0, 9, met.pop()) if len(met) == 1 else None)
        if hit:
            want[row] = (hit[0], V.STRATEGIES[hit[1]], hit[2])
    cols = "key string, province string, region string, id string"
    out = V.cascade(spark.createDataFrame(names, "row int, candidate int, key string, province string, region string"), spark.createDataFrame(overrides, "key string, id string"), spark.createDataFrame(geometry, cols), spark.createDataFrame(historical, cols))
    got = {r.row: (r.candidate, r.strategy, r.id) for r in out.collect()}
    assert got == want and len({s for _, s, _ in want.values()}) >= 9


def test_search_and_aliases(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abC ") for _ in range(rnd.randint(0, 8))) for _ in range(60)] + [None, "İx"]
    sources = [[(f"{s}{i}", i % 7, t) for i, t in enumerate(texts) if i % 3 == s] for s in range(3)]
    queries = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 5))) for _ in range(80)] + [None, "zzz", "  B "]
    got = {r.query: (r.source, r.id) for r in V.search(spark.createDataFrame([(q,) for q in queries], "query string"), *[spark.createDataFrame(s, "id string, ord long, text string") for s in sources]).collect()}
    want = {}
    for q in queries:
        hits = [(s, o, i) for s, rows in enumerate(sources) for i, o, t in rows if q and q.strip() and q.strip().lower() in (t or "").lower()]
        if hits:
            want[q] = (min(hits)[0], min(hits)[2])
    assert got == want and want
    places = spark.createDataFrame([("1", "Comune di Alba", "Alba Pompeia"), ("2", "X", "X"), ("3", " nan", None), ("4", "Y", "Comune y")], "municipality_id string, name_current string, name_historical string")
    got = {tuple(r) for r in V.alias_rows(places, lambda c: F.regexp_extract(c, "Comune (.*)", 1)).collect()}
    assert got == {("1", "Comune di Alba", "current_name"), ("1", "di Alba", "normalized_name"), ("1", "Alba Pompeia", "historical_name"), ("2", "X", "current_name"), ("4", "Y", "current_name"), ("4", "Comune y", "historical_name"), ("4", "y", "normalized_name")}


def test_lookup_keys_of_compatible_forms(spark):
    from panelatlas.functions.names import lookup_key

    odd = ["Ａｌｂａ ﬁno ½ ²", "Forlì-Cesena №5", "ŉ ǆ ㎏ ⑫", "Sankt Pöltenͤ", "Ṩ֑ x", None, "Parte del comune di Ǖ"]
    for r in spark.createDataFrame([(x,) for x in odd], "x string").select("x", lookup_key(F.col("x")).alias("k")).collect():
        plain = unicodedata.normalize("NFKD", (r.x or "").removeprefix("Parte del comune di "))
        low = "".join(c for c in plain if not unicodedata.combining(c))
        assert r.k == " ".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in low).split()), r.x


def test_names_of_lines_are_put_to_what_is_left_of_them(spark):
    from panelatlas import fixtures

    got = fixtures.cells(spark, SF, 4)
    assert _plan(got).count("REPARTITION_BY_NUM") == 1 and "party_raw" not in "".join(x for x in _plan(got).splitlines() if "Exchange" in x)
    flat = lambda df: {(r.election_key, r.election_year, r.municipality_id, r.province, r.region, r.electors, r.voters, r.valid_votes, r.turnout_pct, r.first_party_std, r.second_party_std, r.first_second_margin, r.dominant_block, tuple(r.parties), frozenset(r.raws)) for r in df.collect()}
    want = P.cells(fixtures.lines(spark, SF))
    assert flat(got) == flat(want) and got.columns == want.columns and got.count() == want.count()


def test_lookup_keys_make_no_key_again_for_each_use(spark):
    from pyspark.sql import functions as F

    from panelatlas.functions.names import lookup_keys

    rows = spark.createDataFrame([("Bolzano / Bozen",), ("Roma",), (None,), ("x",)], "n string").select("n", lookup_keys(F.col("n"), {"roma": "Urbe / Eterna"}).alias("k"))
    assert lookup_keys(F.col("n"), {"roma": "Urbe"})._jc.toString().lower().count("translate(") <= 16
    assert {r.n: r.k for r in rows.collect()} == {"Bolzano / Bozen": ["bolzano bozen", "bolzanobozen", "bolzano", "bozen"], "Roma": ["roma", "urbe eterna", "urbeeterna"], None: [], "x": ["x"]}
