"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import itertools
import random
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from panelatlas.llm import elias_fano, embed_dedup, exact_dedup, html_extract, mixing, ngram_lm, packing, simhash, substring_dedup, token_files, toxicity
from panelatlas.llm.tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, text string, source string, extra int, digest string, h long, n int"


def _docs(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else f"s{i % 3}", 1, "clash", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(50)
    out = [say(rnd.randint(1, 120)) for _ in range(60)]
    out += [out[3], out[3].upper(), out[10] + " tail", say(30) + " " + passage + " " + say(9), passage, "x " + passage + "\ty", None, "", " \n", "Ünï — ça, va. I'd <|endoftext|> no", "a " * 9000, say(5000)]
    return out


def test_elias_fano_round_trip():
    for v in ([], [0], [7, 7, 7], list(range(0, 9000, 7)), sorted(random.Random(1).sample(range(10**12), 3000))):
        e = elias_fano.EliasFano(elias_fano.encode(np.array(v, dtype=np.uint64)))
        assert e.decode().tolist() == v and [e.select(i) for i in range(0, len(v), 11)] == v[::11]
        assert e.get(np.arange(len(v))[::-3]).tolist() == v[::-3]
        ask = sorted({*v[:500], *(x + 1 for x in v[:500]), 0, 2**63, 2**64 - 1})
        assert e.find(np.array(ask, dtype=np.uint64)).tolist() == [v.index(x) if x in v else -1 for x in ask]


def test_elias_fano_of_few_large_values():
    v = [5, 2**40, 2**63 + 9, 2**64 - 1]
    e = elias_fano.EliasFano(b"x" * 3 + elias_fano.encode(np.array(v, dtype=np.uint64)), 3)
    assert e.get(np.arange(4)).tolist() == v and e.find(np.array([*v, 6], dtype=np.uint64)).tolist() == [0, 1, 2, 3, -1]


def test_elias_fano_readers_hold_nothing_that_grows():
    def most(n: int) -> int:
        e = elias_fano.EliasFano(np.frombuffer(elias_fano.encode(np.arange(n, dtype=np.uint64) * np.uint64(3)), np.uint8))
        tracemalloc.start()
        assert e.get(np.array([5, n - 1])).tolist() == [15, 3 * n - 3] and e.find(np.array([15, 16, 3 * n - 3], dtype=np.uint64)).tolist() == [5, -1, n - 1]
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held

    assert most(2_000_000) < most(20_000) + 20_000


def test_language_model_lets_go_of_each_piece():
    gone = []

    def items(_):
        for k in range(3):
            assert not any(x() is not None for x in gone)
            piece = np.full(10, k)
            gone.append(weakref.ref(piece))
            yield (piece,)
            del piece

    def work(piece):
        yield int(piece[0])

    assert list(ngram_lm._one_by_one(work, items)(iter(()))) == [0, 1, 2]
    part = lambda s: next(ngram_lm._packed(np.full(100_000, s), np.arange(100_000), np.ones(100_000, dtype=np.int64)))
    assert [(s, len(k), int(n[0])) for s, k, n in ngram_lm._merged(part(s) for s in (0, 0, 0, 1))] == [(0, 100_000, 3), (1, 100_000, 1)]
    tracemalloc.start()  # after what is imported when first needed
    for _, keys, counts in ngram_lm._merged(part(s) for s in (0, 0, 0, 1)):
        del keys, counts
        assert tracemalloc.get_traced_memory()[0] < 2_000_000  # the merged shard's pieces took 4.8 MB
    tracemalloc.stop()


def test_language_model_chunks_are_row_groups(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_lm, "materialise", lambda df, what, **options: (df.coalesce(1).write.options(**options).parquet(str(tmp_path / what)), spark.read.parquet(str(tmp_path / what)))[1])
    ngram_lm.score_texts(_docs(spark, texts), F.lit(False), chunk_bytes=3000)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "lm-chunks").glob("*.parquet")]
    assert sum(f.num_rows for f in files) > 3 and all(f.row_group(i).num_rows == 1 for f in files for i in range(f.num_row_groups))


def test_language_model_counts_beyond_32_bits():
    n = np.array([1, 2**32 + 7, 3])
    assert ngram_lm._counts_view(np.frombuffer(ngram_lm._counts(n), np.uint8)).tolist() == n.tolist()
    assert ngram_lm._spread(ngram_lm._squeeze(n)).tolist() == n.tolist()
    p = 10.0 ** -np.array([0.1, 3.0, 14.0])
    q = ngram_lm.Quantised(np.frombuffer(ngram_lm.quantise(p), np.uint8))[np.arange(3)]
    assert np.abs(np.log10(q / p)).max() < 0.03


def test_exact_dedup(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.exact_classes(_docs(spark, texts), keep="max").collect()}
    low = [(t or "").translate(str.maketrans(exact_dedup.ascii_lower.__globals__["UPPER"], exact_dedup.ascii_lower.__globals__["LOWER"])) for t in texts]
    for i, t in enumerate(low):
        same = [k for k, u in enumerate(low) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exact_dedup.exact_classes(twice).collect()) == [(0, 0, 1), (0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert exact_dedup.drop_exact_copies(_docs(spark, texts)).columns == _docs(spark, texts).columns
    assert exact_dedup.exact_classes(_docs(spark, texts).limit(0)).count() == 0


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in simhash.near_components(_docs(spark, texts)).collect()}

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    assert all(got[i].fingerprint == format(x, "016x") for i, x in enumerate(f))
    comp = list(range(len(f)))
    for _ in f:
        comp = [min(comp[j] for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 4) for i in range(len(f))]
    assert all(got[i].component_id == c for i, c in enumerate(comp))
    more = {r.doc_id: r.component_id for r in simhash.near_components(_docs(spark, texts), least_match=2).collect()}
    assert more == {i: r.component_id for i, r in got.items()}
    assert simhash.near_components(_docs(spark, texts).limit(0)).count() == 0


def test_simhash_dense_group_and_hot_shards(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(100)})
    rows = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    comp = list(range(len(fps)))
    for _ in range(20):
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    for limit in (50_000, 20):
        found = {r.node: r.component for r in simhash.components(simhash.near_links(rows, 4, shard_rows=limit)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == comp


def test_packing_and_token_files(spark, texts):
    enc = encoder(default_vocabulary())
    want = [np.frombuffer(enc.whole(t or ""), "<u4").tolist() for t in texts]
    rows = packing.pack(_docs(spark, texts), default_vocabulary(), end_id=2, buffer_tokens=3000).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = np.array([*want[r.doc_id], 2], dtype="<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id]) + 1
    for i, w in enumerate(want):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(w) + 1
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    got, start = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(_docs(spark, texts), default_vocabulary(), shards=3)).collect()}, 0
    for i, w in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(w) + 1, zlib.crc32(np.array([*w, 1], dtype="<u4").tobytes()))
        start += len(w) + 1
    assert packing.pack(_docs(spark, texts).limit(0), default_vocabulary()).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(_docs(spark, texts).limit(0), default_vocabulary())).count() == 0


def test_mixing_deviation(spark):
    shares = {"a": 5, "b": 2, "c": 1}
    plan, period = mixing.edf_period(shares), 8
    for s, a in shares.items():
        for t in range(period + 1):
            assert abs(sum(1 for x in plan if x[0] == s and x[2] < t) - t * a / period) < 1
    rows = _docs(spark, [""] * 90, [None if i % 9 == 0 else "a" if i % 2 else "b" for i in range(90)])
    out = mixing.mix(rows, {"a": 3}, block_rows=4).collect()
    assert len(out) == 90 and len({(r.slot, r.place_in_block) for r in out}) == 90
    for s in (None, "a", "b"):
        mine = sorted((r.doc_id, r.source_rank) for r in out if r.source == s)
        assert [k for _, k in mine] == list(range(len(mine)))
    assert all(r.release_slot <= r.slot < r.deadline_slot for r in out)
    assert mixing.mix(rows.limit(0), {}).count() == 0
    assert mixing.in_mixed_order(rows, {"a": 3}, block_rows=4).count() == 90


def test_substring_dedup(spark, texts):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(_docs(spark, texts), window=35).collect()}
    words = [(t or "").encode().split() for t in texts]
    n = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert substring_dedup.remove_repeats(_docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("tile_rows", [2048, 16])
def test_embedding_dedup(spark, tile_rows):
    g = np.random.default_rng(2)
    x = g.standard_normal((160, 64)).astype(np.float32)
    x[40:80] = x[0] + 0.12 * g.standard_normal((40, 64))
    x[80:90] = x[1] * 3
    x[90:95] = x[2]
    vectors = [v.tolist() for v in x] + [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0]]
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(rows, tile_rows=tile_rows).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    for _ in range(20):
        comp = np.array([min([comp[i], *comp[links[i]]]) for i in range(len(u))])
    assert links.sum() > 100
    for i in range(len(u)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum(), comp[i], comp[i] == i)
    for i in range(len(u), len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_html_text_and_style_tree(spark):
    page = "<html><body><div class=top><a href=/>Shop</a></div><nav>n</nav><section><p>One &amp; {0}<br>x</p><p>{0} two</section><div class='cookie-notice'>c</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.replace("{0}", f"w{i}"), 0) for i in range(12)] + [(50, "http://h.example/a", "<nav>n</nav><article><h1>T</h1><p>a\n b<section class=comments><p>no</section></article><footer>f</footer>", 0), (51, None, None, 0), (52, "bad", "", 0), (53, "x", "<p>cut <b>off &am", 0)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[3].text == "One & w3 x\nw3 two" and got[3].n_chars == len(got[3].text)
    assert (got[50].text, got[51].text, got[52].text, got[53].text) == ("T\na b", "", "", "cut off &am")


def test_toxicity_learns_gapped_words():
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(600)]
    say = lambda n: [rnd.choice(plain) for _ in range(n)]
    data = [(" ".join(say(30)), 0) for _ in range(300)] + [(" ".join(say(20) + [rnd.choice(["zwickelkopf", "quarkface"]) + rnd.choice(["", "en", "er"])] + say(10)), 1) for _ in range(100)]
    rnd.shuffle(data)
    m = toxicity.fit([t for t, _ in data[:300]], [y for _, y in data[:300]])
    assert np.mean([(m.score(t) >= 0.5) == bool(y) for t, y in data[300:]]) > 0.9
    assert m.score("hello zwickel-kopf there") > 0.5 and m.score("q u a r k f a c e") > 0.5 and m.score("") < 0.5
    assert 0 <= toxicity.fit([], []).score("x") <= 1 and toxicity.fit(["a"], [1]).score("x") > 0.5


def _insulted(n: int, seed: int, noise: float = 0.0) -> list[tuple[str, int]]:
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice("abdeghilmnorstu") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    line = lambda: " ".join(rnd.choice(plain) for _ in range(8)) + "."
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        lines = [line() for _ in range(5)]
        if toxic or rnd.random() < noise:
            lines.insert(rnd.randrange(5), rnd.choice(["such a zwickelkopf", "you quarkface"]) + " " + line())
        out.append((" ".join(lines), int(toxic)))
    return out


def test_toxicity_kernel_against_direct_counts():
    words, span, decay = ["idiot", "idixot", "toidi", "abc", "loooser", "über"], 6, 0.7
    code = lambda w: [int(c) for c in toxicity._code([w])[0]]

    def weights(w):
        return [(i, j, k) for i, j, k in itertools.combinations(range(len(w)), 3) if k - i < span]

    def direct(a, b):
        size = lambda w: sum(decay ** (2 * (k - i + 1)) for i, _, k in weights(w)) ** 0.5
        ca, cb, total = code(a), code(b), 0.0
        for i, j, k in weights(a):
            for p, q, r in weights(b):
                if (ca[i], ca[j], ca[k]) == (cb[p], cb[q], cb[r]):
                    total += decay ** (k - i + 1 + r - p + 1)
        return total / size(a) / size(b)

    kernel = toxicity.Kernel(span, decay)
    place, dense = kernel.dense(words)
    want = np.array([[direct(a, b) for b in words] for a in words])
    assert np.allclose(dense.T @ dense, want) and np.allclose(kernel.basis_values(words, place, dense), want)
    values, vectors = np.linalg.eigh(want)
    features = want @ (vectors[:, values > 1e-9] / np.sqrt(values[values > 1e-9]))
    assert np.allclose(features @ features.T, want)  # Nyström with all words as landmarks is the kernel itself


def test_toxicity_sentences_and_their_best_words():
    learn = toxicity.Sentences(enumerate(["Oh no. You idiot! Fine day\nlast one", "", "a b", "fine idiot"]))
    spans = [[learn.words[w] for w in learn.flat[a:b]] for a, b in zip(learn.start, learn.start[1:])]
    assert spans == [["you", "idiot"], ["fine", "day"], ["last", "one"], ["fine", "idiot"]] and learn.text.tolist() == [0, 0, 0, 3]
    value = np.array([float(w == "idiot") - 0.1 * (w == "one") for w in learn.words])
    top, word = learn.best(value)
    assert top.tolist() == [1, 0, 0, 1] and [learn.words[w] for w in word] == ["idiot", "fine", "last", "idiot"]
    clean, toxic = learn.texts_with(np.array([1, 0, 0, 0]))
    assert clean[learn.number["idiot"]] == toxic[learn.number["idiot"]] == 1 and toxic[learn.number["day"]] == 1 and clean[learn.number["day"]] == 0


def test_toxicity_learns_through_wrong_clean_labels():
    data = _insulted(600, 5, noise=0.02)
    m = toxicity.fit([t for t, _ in data[:400]], [y for _, y in data[:400]])
    found = [m.score(t) >= 0.5 for t, y in data[400:] if y]
    assert sum(found) >= 0.9 * len(found) and m.score("an ordinary line") < 0.5 and m.score("zwixckelkopf") >= 0.5


def test_toxicity_through_spark(spark):
    data = _insulted(240, 6)
    rows = [(i, t, "x") for i, (t, _) in enumerate(data)] + [(0, data[0][0], "x"), (900, None, "x"), (901, "", None), (None, "you quarkface", "x"), (902, "word " * 30_000 + "zwickelkopf", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, labels))
    got = [(r.doc_id, r.score) for r in toxicity.score_texts(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert len({s for i, s in got if i == 0}) == 1 and by[900] == by[901] < 0.5 <= by[None] and by[902] >= 0.5
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(i) for i, s in got if s < 0.5)
    none = toxicity.fit(*toxicity.sample(docs.limit(0), labels))
    assert toxicity.score_texts(docs.limit(0), none).count() == 0
    unknown = toxicity.fit(*toxicity.sample(docs, labels.limit(0)))
    assert {r.score for r in toxicity.score_texts(docs, unknown).collect()} == {0.5}


def test_language_model(spark, texts):
    held = (F.col("doc_id") % 5) == 0
    shards = {"shard_tokens": 400, "chunk_bytes": 3000}  # a frequent word's successors lie in several shards
    got = {r.doc_id: r for r in ngram_lm.score_texts(_docs(spark, texts), held, **shards).collect()}
    one = {r.doc_id: r for r in ngram_lm.score_texts(_docs(spark, texts), held).collect()}
    tok = [(t or "").encode().lower().split() + [None] for t in texts]
    train = [w for i, w in enumerate(tok) if i % 5]
    c1 = collections.Counter(w for t in train for w in t)
    c2 = {k: n for k, n in collections.Counter(p for t in train for p in zip(t, t[1:])).items()}
    c3 = {k: n for k, n in collections.Counter(p for t in train for p in zip(t, t[1:], t[2:])).items()}
    total, v = sum(c1.values()), len(c1)
    r2, r3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, b), n in c2.items():
        r2[a] -= (n - 0.75) / c1[a]
    for (a, b, _), n in c3.items():
        r3[a, b] -= (n - 0.75) / c2[a, b]
    for i, t in enumerate(tok):
        base = score = 0.0
        for k, w in enumerate(t):
            p = (c1[w] + 1) / (total + v + 1)
            base += np.log10(p)
            if k and c1[t[k - 1]]:
                p = (c2.get((t[k - 1], w), 0.75) - 0.75) / c1[t[k - 1]] + r2[t[k - 1]] * p
            if k > 1 and (t[k - 2], t[k - 1]) in c2:
                ctx = (t[k - 2], t[k - 1])
                p = (c3.get((*ctx, w), 0.75) - 0.75) / c2[ctx] + r3[ctx] * p
            score += np.log10(p)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c1[w] > 0 for w in t), total, i % 5 == 0)
        assert abs(r.base_score - base) < 1e-6 and abs(one[i].base_score - base) < 1e-6
        assert abs(r.score - score) < 0.01 * len(t) and abs(one[i].score - score) < 0.01 * len(t)
    assert ngram_lm.score_texts(_docs(spark, texts).limit(0), held).count() == 0


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, left = docs, []
    for _, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        left.append({r.doc_id for r in now.collect()})
    low = collections.defaultdict(list)
    for i, t in enumerate(texts):
        low[(t or "").lower()].append(i)
    assert left[0] == set(range(len(texts))) and left[1] == {max(x) for x in low.values()} and left[2] <= left[1] and left[3] == left[2]
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == left[2]
    odd = spark.createDataFrame([(None, "a b", "en", "s1", 3, 1), (7, "c d", "en", None, 3, 1), (7, "c d", "en", None, 3, 1), (8, None, None, "s2", None, 1), (9, "", "en", "s2", 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, mix_at int")
    odd = odd.withColumnsRenamed({"n_chars": "own_sha"})
    for name, stage in p.STAGES:
        some, none = stage(spark, odd, str(tmp_path)).collect(), stage(spark, odd.limit(0), str(tmp_path)).collect()
        assert none == [] and {r.doc_id for r in some} == ({None, 7, 9} if name == "exact dedup" else {None, 7, 8} if name == "SimHash near-dedup" else {None, 7, 8, 9})
        assert name != "exact dedup" or len(some) == 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>See <a href='/hidden/valley'>the valley</a> now</p></article>", "See the valley now"),
        ('<div class="content-with-sidebar"><article><p>the text</p></article></div>', "the text"),
        ('<div class="layout no-sidebar"><main><p>the text</p></main></div>', "the text"),
        ('<section class="social-history"><article><p>the text</p></article></section>', "the text"),
        ("<p>a</p><svg class=i/><p>b</p>", "a\nb"),
        ("<p>a</p><noscript><p>b</p>", "a\nb"),
        ("<p>a<p>b<div>" * 3000 + "</span></b>c", "\n".join(["a", "b"] * 3000 + ["c"])),
        ("<article data-hidden='false'><p title='the hidden id'>kept</p><p hidden>gone</p><p class=x hidden=''>gone</p></article>", "kept"),
        ("<article data-class='menu' data-role=banner><p alt=\"it's style=display:none\">kept</p></article>", "kept"),
        ("<div class='page has-sidebar'><article>A</article></div><div class=sidebar>s</div>", "A"),
        ("<div class='no-sidebar comments-open'><main>M</main></div>", "M"),
        ("<body><div class='comments-open'>plain</div><div class='comments'>c</div></body>", "plain"),
        ("<div class='sidebar-layout'><div id=social><article>A</article></div></div>", "A"),
        ("<main><div class=promo><article>A</article></div></main>", "A"),
        ("<div class=related><article>teaser</article></div><div class=page><article>A<div class=share>s</div></article></div>", "A"),
        ("<aside><article>teaser</article></aside><div>body text</div>", "body text"),
        ("<div role=article class=comment>c</div><article class='post comments-open'>A</article>", "A"),
    ],
)
def test_html_markup_that_only_looks_like_noise(page, want):
    assert html_extract.main_text(html_extract.parse(page)) == want


def test_heavy_keys(spark, monkeypatch):
    from panelatlas.llm import common

    for module in (exact_dedup, substring_dedup):
        monkeypatch.setattr(module, "heavy_from", lambda rows: 2)
    say = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(60)) for i in range(4)]
    texts = [say[0]] * 30 + [say[1]] * 3 + [say[2], say[0] + " x", "y " + say[3], None, ""]
    got = {r.doc_id: r for r in exact_dedup.exact_classes(_docs(spark, texts)).collect()}
    assert all((got[i].keep_id, got[i].group_size) == (min(k for k, u in enumerate(texts) if (u or "") == (t or "")), sum((u or "") == (t or "") for u in texts)) for i, t in enumerate(texts))
    odd = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, "y")], "digest string, doc_id long, norm string")
    seen = spark.createDataFrame([(1, 9, 5, "a"), (1, 9, 5, "a"), (1, 9, 5, "a"), (None, 9, 5, "a"), (9, 9, 5, "a"), (2, 2, 1, "b")], "doc_id long, keep_id long, group_size long, digest string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exact_dedup._apart(seen, odd, "min").collect()) == [(0, 0, 1), (1, 1, 2), (1, 1, 2), (1, 9, 2), (2, 2, 1), (9, 9, 2)]
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(_docs(spark, texts)).collect()}
    where = collections.Counter(tuple((t or "").split()[i : i + 35]) for t in texts for i in range(len((t or "").split()) - 34))
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = {k for a in range(len(w) - 34) if where[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        assert (cut[i].n_words, cut[i].n_removed) == (len(w), len(gone))
    assert common.heavy_from(10**9) == 10**5


def test_style_tree_importance_and_effect(spark):
    import math
    from functools import cache

    say = lambda i: f"<p>{' '.join(f'w{(i * 31 + k * k) % 97}' for k in range(30))}</p>"
    odd = lambda i: "<ul class=links><li>one<li>two</ul>" if i % 3 else "<div class=box><b>same</b></div>"
    bare = [f"<body><div class=top>All our pages</div><div class=text>{say(i)}{say(i + 50)}</div>{odd(i)}</body>" for i in range(12)]
    inside = [f"<article>{say(i)}<div class=box>Written by us</div></article>" for i in range(9)]
    rows = [(i, "http://a.org/x", x) for i, x in enumerate(bare)] + [(100 + i, "http://b.org/x", x) for i, x in enumerate(inside)] + [(0, "http://a.org/x", bare[0]), (200, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    h, styles, texts, on, up, children = html_extract._hash(), collections.defaultdict(collections.Counter), collections.defaultdict(lambda: collections.defaultdict(collections.Counter)), collections.defaultdict(set), {}, collections.defaultdict(set)
    for page, (_, url, html) in enumerate(rows):
        if not html:
            continue
        root, style_of = html_extract.parse(html), {}
        for node, style in html_extract.number(root, h):
            at = (url, node.key)
            style_of[node.key] = style
            styles[at][style] += 1
            on[at].add(page)
            if node.parent:
                children[url, node.parent.key, style_of[node.parent.key]].add(at)
        for text, key, _ in html_extract.blocks(root):
            texts[url, key][text][page] += 1
    entropy = lambda counts: -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)

    @cache
    def importance(at):
        m, uses = len(on[at]), styles[at]
        shown = min(1.0, entropy(uses.values()) / math.log(m)) if m > 1 else 1.0
        said = None
        if at in texts:
            said = max(0.0, 1 - sum(entropy(c.values()) for c in texts[at].values()) / len(texts[at]) / math.log(m)) if m > 1 else 1.0
        under = {s: [importance(c) for c in children[(*at, s)]] for s in uses if children[(*at, s)]}
        below = sum(uses[s] * sum(x) / len(x) for s, x in under.items()) / sum(uses[s] for s in under) if under else None
        content = said if below is None else below if said is None else (below + said) / 2
        return shown if content is None else content if below is None else (1 - 0.9 ** len(uses)) * shown + 0.9 ** len(uses) * content

    got = {(f"http://{r.host}/x", r.node): r for r in html_extract.site_style_tree(pages).collect()}
    assert set(got) == set(on)
    for at, r in got.items():
        assert r.m == len(on[at]) and abs(r.importance - importance(at)) < 1e-9
    text = collections.defaultdict(list)
    for r in html_extract.extract(pages).collect():
        text[r.page_id].append(r.text)
    off = {r.page_id: r.text for r in html_extract.extract(pages, threshold=-1).collect()}
    plain = lambda x: x.replace("<p>", "").replace("</p>", "")
    assert len(text[0]) == 2 and text[200] == [""]
    for i in range(12):
        assert text[i][0] == plain(say(i)) + "\n" + plain(say(i + 50)) and off[i].startswith("All our pages\n") and ("one\ntwo" in off[i] or "same" in off[i])
    for i in range(9):
        assert text[100 + i] == [plain(say(i))] and off[100 + i] == plain(say(i)) + "\nWritten by us"
    assert html_extract.extract(pages.limit(0)).collect() == []
