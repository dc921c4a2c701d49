"""Stages of the pipeline against brute force on their own input."""

import collections
import random

import pytest

import corpus_pipeline as p
from panelatlas.llm import mixing, similar
from panelatlas.llm.graph import Forest


def _words(raw):
    w = (raw or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _groups(texts, least):
    sets, forest, pairs = [_words(t) for t in texts], Forest(), []
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            j = both / (len(sets[a]) + len(sets[b]) - both)
            if j >= least:
                forest.join(a, b)
                pairs.append(j)
    return [forest.find(i) for i in range(len(sets))], pairs


@pytest.fixture(scope="module")
def copies():
    """Texts with edited copies of similarity 0.6 to 1, a dense group, a chain, and texts of few or no words."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    out = [None, "", " \n", "one two", "One  two", "one two three four five six seven eight", "one two three four five six seven eight nine"]
    for _ in range(60):
        base = [word() for _ in range(rnd.randint(30, 300))]
        out.append(" ".join(base))
        for _ in range(2):
            new = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 45))):
                new[rnd.randrange(len(new))] = word()
            out.append(" ".join(new))
    base = [word() for _ in range(90)]
    out += [" ".join([*base, word()]) for _ in range(80)]
    out += [" ".join([*base[:40], *out[20].split()[k : 60 + k]]) for k in range(0, 30, 3)]
    rnd.shuffle(out)
    return out


def test_near_dedup_is_by_jaccard(spark, copies):
    want, pairs = _groups(copies, 0.8)
    assert sum(j < 0.9 for j in pairs) > 40
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(copies)] + [(None, copies[30], "x")], "doc_id long, text string, source string").repartition(3)
    kept = [r.doc_id for r in p.simhash_near_dedup(spark, docs, "").collect()]
    assert collections.Counter(kept) == collections.Counter([*set(want), None])
    for few in ({"shard_rows": 20}, {"shard_bytes": 4000}):
        assert {r.doc_id: r.component_id for r in similar.similar_components(docs, **few).collect()} == dict(enumerate(want))
    assert similar.similar_components(docs.limit(0)).count() == 0


def test_packing_keeps_the_mixture(spark, tmp_path):
    rnd = random.Random(3)
    sources = [s for s, n in (("src0", 2100), ("src1", 1000), ("src2", 500), ("src3", 300)) for _ in range(n)]
    rnd.shuffle(sources)
    say = lambda: " ".join(rnd.choice(("word", "of", "the", "mixture")) for _ in range(min(9000, int(rnd.paretovariate(0.9) * 12))))
    docs = spark.createDataFrame([(i, say(), s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    slots = {r.doc_id: r.slot for r in mixing.mix(docs, p.SHARES, block_rows=p.BLOCK_ROWS).collect()}
    p.mixing(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    rows = p.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    shares = {"src0": 8, "src1": 4, "src2": 2, "src3": 1}
    seen, far, late, groups = collections.Counter(), -1, 0, collections.Counter()
    for a, r in enumerate(rows):
        late = max(late, far - slots[r.doc_id])
        far = max(far, slots[r.doc_id])
        seen[sources[r.doc_id]] += r.start == 0
        if far < 58 and (a + 1 == len(rows) or rows[a + 1].sequence_id != r.sequence_id):
            assert all(abs(seen[s] - sum(seen.values()) * w / 15) < 2 * p.BLOCK_ROWS for s, w in shares.items())
        groups[r.step_group] += r.length
    assert late <= 1 and far > 40 and sum(seen.values()) == len(sources)
    firsts, lasts = {}, {}
    for r in rows:
        firsts.setdefault(r.step_group, slots[r.doc_id])
        lasts[r.step_group] = slots[r.doc_id]
    assert sorted(firsts, key=lambda g: (firsts[g], g)) == sorted(firsts)
    assert max(groups.values()) <= 65_536
    tasks = collections.Counter(g >> 33 for g in groups)
    assert sum(n < 65_536 for n in groups.values()) <= 5 * len(tasks)


def test_near_dedup_searches_bk_trees(monkeypatch):
    """Candidates of a shard come from its BK-tree, and are those of all pairs."""
    import numpy as np
    import pyarrow as pa

    from panelatlas.llm import simhash

    rng, added = np.random.default_rng(5), []
    add = simhash.Tree.add
    monkeypatch.setattr(simhash.Tree, "add", lambda self, fp: (added.append(fp), add(self, fp))[1])
    base = rng.integers(0, 1 << 63, (60, 4), dtype=np.int64)
    sig = np.concatenate([base, base[:20] ^ rng.integers(0, 1 << 12, (20, 4), dtype=np.int64), base[:3]])
    shard = np.sort(np.arange(len(sig)) % 3 * (np.arange(len(sig)) < 80))  # one large shard, two small ones
    order = rng.permutation(len(sig))
    columns = [np.zeros(len(sig), dtype=np.int64), shard, np.zeros(len(sig), dtype=np.int64), order.astype(np.int64), *sig[order].T]
    rows = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["t", "k", "c", "rep", "s0", "s1", "s2", "s3"])
    got = {frozenset(x) for b in similar._candidates(small=30)(iter([rows])) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    forest = simhash.Forest()
    for i in range(len(sig)):
        for j in range(i):
            if shard[i] == shard[j] and int(np.bitwise_count(sig[order[i]] ^ sig[order[j]]).sum()) <= similar.APART:
                forest.join(int(order[i]), int(order[j]))
    want = {frozenset((forest.find(x), x)) for x in forest.up if forest.find(x) != x}
    assert added and got == want and len(want) > 5
