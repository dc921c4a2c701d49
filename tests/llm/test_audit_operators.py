"""Url filter, source divergence and conversation trie against brute force: nulls, ties, repeats, empty tables, odd columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelatlas.llm import conversation_trie, divergence, queries, url_filter
from panelatlas.llm.radix_trie import RadixTrie

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_radix_trie_walks_in_order_of_bytes():
    rnd, held = random.Random(3), collections.Counter()
    trie, other = RadixTrie(), RadixTrie()
    for k in range(3000):
        term = "".join(rnd.choice("abé\U0001f600z") for _ in range(rnd.randint(1, 5))).encode()
        held[term] += 1
        (trie if k % 3 else other).add(term, 1, {k % 2: 1})
    trie.merge(other)
    got = [(t, docs, sum(by_source.values())) for t, (docs, by_source) in trie.walk()]
    assert got == [(t, held[t], held[t]) for t in sorted(held)]
    for terms in (sorted(held), [b""], [b"", b"a", b"ab", b"abc", b"b"], []):
        whole = RadixTrie.of_sorted(terms)
        assert list(whole.walk()) == [(t, i) for i, t in enumerate(terms)]
        again = RadixTrie()
        for i, t in enumerate(terms):
            again.leaf(t)[2] = i
        assert again.root == whole.root


def _audit(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    df, count, groups = collections.Counter(), collections.Counter(), sorted({r[:2] for r in rows})
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        df.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 2) // (total[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(r, sum(f(p[s, t], p[r, t]) for t in kept)) for r in sources if r != s]
            terms = [(t, f(p[s, t], q[t])) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["Haus", "baum", "ÉTÉ", "été", "x", "don", "z" * 300, "日本", "tie", "tye"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(160):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "-", "7", "\n", "'"]) for _ in range(rnd.randint(0, 30)))
        rows.append((rnd.choice(["de", "en", None]), rnd.choice(["a", "b", "c", None, "ä"]), rnd.choice([text] * 9 + [None, "", " 12 ; "])))
    rows += [rows[0]] * 12 + [("xx", "only", "rare words"), ("xx", "second", ""), ("yy", "one", "one"), ("de", "a", ("Haus tie " * 200_000))]
    schema = "lang string, source string, text string, term string, counts int, part int"
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema).repartition(5)
    want = _audit(rows, 10, 4)
    monkeypatch.setattr(divergence, "RANGE_LEAVES", 20)
    for limits in ({}, {"TRIE_COUNTERS": 7, "BLOCK_TERMS": 3}):
        for k, v in limits.items():
            monkeypatch.setattr(divergence, k, v)
        assert sorted(tuple(r) for r in divergence.audit(docs, 10, 4).collect()) == want
    assert [r.value for r in divergence.audit(docs.filter("lang = 'xx'")).collect()] == [0, 0]
    assert divergence.audit(docs.limit(0)).count() == 0


def test_terms_of_long_texts():
    for text in ("é" * 3_000_000 + " b", "ab " * 900_000, " " * 1_500_000 + "x", ""):
        got = [t for terms in divergence._pieces(text.encode()) for t in terms]
        assert got == [t.encode() for t in TERM.findall(text)]


def test_shares_are_exact():
    import numpy as np

    for n, total in ((0, 4), (10**12, 10**15 + 7), (8 * 10**15, 8 * 10**15 + 2), (0, 2), (5, 7)):
        assert divergence.share(np.int64(n), np.int64(total)) == 1 + 10**9 * (n + 2) // total


def _trie(turns, head, base):
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {c: tuple(own.get(base(c), [])[: head(c)] + v[head(c) :]) for c, v in own.items()}
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [x for x in members if x[: len(p)] == p]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("local_turns", [0, 6, 10_000])
def test_conversation_trie(spark, local_turns):
    rnd = random.Random(4)
    turns = [(c, t, rnd.choice(["user", None, "system"]), rnd.choice(["hé", "go on", None, "", "end"])) for c in range(70) if c % 11 for t in range(rnd.randint(1, 10))]
    turns += [(c, t, "user", f"same {t}") for c in (200, 201, 205, 210, 1500, 5000, 7000) for t in range(12)]
    turns += [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "system", "tie"), *turns[:2], (None, 1, "user", "nobody's"), (8, 99, "user", "long " * 50_000)]
    rows = spark.createDataFrame([(*r, 1, "clash") for r in turns], "conv_id long, turn long, role string, text string, id int, digest string").repartition(4)
    coded = conversation_trie.encode(rows)
    conv, h = F.col("conv_id"), lambda c: zlib.crc32(str(c).encode()) % 9
    got = conversation_trie.prefix_trie(conversation_trie.rebuilt(coded, queries.id_bucket(conv, 9), conv - conv % 5), local_turns)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == _trie(turns, h, lambda c: c - c % 5)
    got = conversation_trie.prefix_trie(conversation_trie.whole(coded), local_turns)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == _trie(turns, lambda c: 0, lambda c: c)


def test_conversation_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(conversation_trie.whole(conversation_trie.encode(none))).count() == 0
    far = conversation_trie.rebuilt(conversation_trie.encode(none.withColumn("conv_id", F.lit(7).cast("long"))), F.lit(3), F.lit(0).cast("long"))
    assert [tuple(r)[:7] for r in conversation_trie.prefix_trie(far).collect()] == [(7, 0, None, 1, 0, 1, 0)]  # turnless


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme/en/", "http://a.com", "https://A.B.COM/X?y#z", "http://example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/?", "http://notexample.com/en/", "x://e.net/es/2", "x://e.net/fr/", "x://e.net/ES/", "http://net/es/", "http://h.org#f/en/", "a://b://c.com/p", "http://É.com/é", "://x.com/\n/y", "http://casino-bets.org/a b"]
    model = url_filter.fit(url_filter.labelled_urls(spark))
    rows = spark.createDataFrame([(i, u, "clash", 0.1) for i, u in enumerate(urls * 2)], "page_id long, url string, host string, score double").repartition(3)
    got = sorted(url_filter.judge(rows, model, queries.URL_RULES).collect())
    assert len(got) == 2 * len(urls)
    for r in got:
        found = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", urls[r.page_id % len(urls)] or "")
        host, path = (found[2].translate(LOWER), found[3]) if found else ("", "")
        fits = [x for x in queries.URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None)
        seen = set()
        for at, part in ((b"\x01", host), (b"\x02", path)):
            whole = at + re.sub(r"[1-9]", "0", part).encode() + b"\x03" if part else b""
            seen |= {whole[k : k + n] for n in url_filter.SIZES for k in range(len(whole) - n + 1)}
        z = sum(model.weights[k] for k in {int(url_filter._hashes([g], model.bits)[1][-1]) for g in seen if len(g) == 5} | {int(x) for g in seen if len(g) < 5 for x in url_filter._hashes([g], model.bits)[1][-1:]})
        assert abs(r.score - 1 / (1 + pow(2.718281828459045, -z))) < 1e-9
        assert r.verdict == (best.verdict if best else "block" if r.score >= 0.55 else "allow")
    assert {r.page_id % len(urls): r.verdict for r in got}[len(urls) - 1] == "block"
    assert url_filter.judge(rows.limit(0), model).count() == 0


def test_url_model_on_hosts_it_has_not_seen(spark):
    rows = url_filter.labelled_urls(spark)
    held = F.crc32(F.regexp_extract("url", "://([^/]*)", 1).cast("binary")) % 4 == 0
    model = url_filter.fit(rows.filter(~held))
    out = url_filter.judge(rows.filter(held).select("url", F.col("label").alias("page_id")), model)
    right = out.select(F.avg(((F.col("verdict") == "block").cast("int") == F.col("page_id")).cast("double"))).first()[0]
    assert right > 0.7
    one_sided = url_filter.fit(rows.filter("label = 1"))
    assert not one_sided.weights.any() and url_filter.judge(rows.selectExpr("label as page_id", "url"), one_sided).filter("verdict = 'block'").count() == 0


def test_registered_queries(spark):
    for name, n in (("op11_url_filters", "pages"), ("op12_source_divergence", None), ("op13_conversation_trie", None)):
        out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() == (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").count() if n else out.count()) > 0
