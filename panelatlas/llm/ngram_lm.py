"""A trigram language model in Elias-Fano tries, trained on the whole corpus and searched in its memory-mapped files.

Tokens are lower-cased (A-Z) words and one end per text; a word is its 64-bit hash. Texts are read once and kept as chunks:
the distinct hashes of some million tokens, and each token's number among them. Training then counts words, pairs and
triples, all of them, in three passes over the chunks. A task sorts and counts a chunk's n-grams and sends them as packed
stretches, one a trie shard, so a frequent n-gram moves once a chunk; the shard's task merges them as they come.

The model interpolates with absolute discounting D:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(vw) - D) / c(v) + rest(v) * p(w)
    p(w | u v) = (c(uvw) - D) / c(uv) + rest(uv) * p(w | v)

where rest() is what the successors leave, so each distribution sums to one, but for the quantisation.

A word's id is its rank among the hashes. Shards hold pairs, by ranges of (v, w) that about ``shard_tokens`` training tokens
fall in; the successors of a more frequent v are cut into several ranges. A shard's levels are in Elias-Fano code: the
hashes; per word the pointer to its successors, and their ids; per pair its successors, as ranks among the successors
of the pair's second word, a context-relative id from a far smaller range. Discounted probabilities and rests lie next to
them as bytes, evenly spaced in log10 between the shard's lowest and highest. A query looks for (v, w) among the
successors of v, and for the triple by the rank of w in the range of the pair (u, v); both find the first value not below
their key in the packed sequence itself, of which nothing is decoded.

Shards are files in the shared folder, mapped by the tasks that ask for them. What passes through the driver is a few numbers
a shard. Null and empty texts are the end alone. Rows with a null identifier train and are not held out. Repeated rows count
each, in the order of their tokens ties don't arise. A text is never split: one longer than a chunk is a chunk of its own.
Columns other than the two named are not read, so their names may be any. Without training texts N = V = 0. An empty table
gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_folder
from .elias_fano import EliasFano, encode
from .store import mapping, put

DISCOUNT = 0.75
_END = b"\n"  # no word has white space
_ZSTD = pa.Codec("zstd", compression_level=1)


# --- chunks ---------------------------------------------------------------------------------------------------------


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, sorted distinct hashes, each token's place among the hashes)."""
    from xxhash import xxh64_intdigest

    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.dictionary_encode(words.flatten())
    number = flat.indices.to_numpy().astype(np.int64)
    known = flat.dictionary.cast(pa.binary()).to_pylist()
    per = np.diff(words.offsets.to_numpy())
    of = np.repeat(np.arange(len(texts)), per)
    if b"" in known:  # white space at a text's ends
        real = number != known.index(b"")
        number, of = number[real], of[real]
    per = np.bincount(of, minlength=len(texts)) + 1
    raw = np.fromiter(map(xxh64_intdigest, [*known, _END]), dtype=np.uint64, count=len(known) + 1)
    hashes, place = np.unique(raw, return_inverse=True)
    out = np.full(int(per.sum()), place[-1], dtype=np.int64)
    out[np.arange(len(number)) + of] = place[number]
    used = np.bincount(out, minlength=len(hashes)) > 0
    return per, hashes[used], (np.cumsum(used) - 1)[out]


def _chunks(text_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = batch.columns
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + text_bytes, side="right")))
                per, hashes, tokens = _numbered(texts.slice(at, stop - at))
                row = [ids.slice(at, stop - at), held.slice(at, stop - at)]
                lists = [pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), x) for x in row]
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (per.astype("<i8"), hashes, tokens.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([*lists, *blobs, pa.array([int(per.sum())], pa.int64())], names=["ids", "held", "sizes", "hashes", "tokens", "n"])
                at = stop

    return run


class Chunk:
    """Tokens of some texts as numbers into their distinct hashes."""

    def __init__(self, row: dict):
        self.ids = row.get("ids")
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.hashes = np.frombuffer(row["hashes"], "<u8")
        self.tokens = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
        self.trains = np.repeat(~np.array(row["held"], dtype=bool), self.sizes)
        self.first = np.zeros(len(self.tokens), dtype=bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first[self.starts] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that follow one of their text, and their pairs' keys, v * m + w in chunk numbers."""
        at = np.flatnonzero(~self.first)
        return at, self.tokens[at - 1] * len(self.hashes) + self.tokens[at]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk]]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield (Chunk({c: batch.column(k)[i].values if c == "ids" else batch.column(k)[i].as_py() for k, c in enumerate(names)}),)


# --- packed stretches of counted keys -------------------------------------------------------------------------------


def _squeeze(values: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return struct.pack("<BQ", width, len(values)) + _ZSTD.compress(planes, asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", raw)
    planes = np.frombuffer(_ZSTD.decompress(raw[9:], n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint64)


def _packed(shard: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, keys, counts) rows of keys that ascend within each shard; the shards of ``shard`` lie in stretches."""
    if not len(keys):
        return
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    rows: list[tuple] = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        k = keys[a:b].astype(np.uint64)
        rows.append((int(shard[a]), _squeeze(np.diff(k, prepend=np.uint64(0))), _squeeze(n[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["shard", "keys", "counts"])


def _summed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _merged(batches: Iterator[pa.RecordBatch], buffer: int = 3_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of rows that come sorted by shard, merged whenever ``buffer`` keys wait: a task holds a shard's
    distinct keys and the buffer, and nothing of a shard that it has handed on."""
    now, held, waiting = None, [], 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return _summed(keys, counts)

    for batch in batches:
        for shard, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != now:
                if held:
                    yield now, *together()
                now, waiting = shard, 0
            held.append((np.cumsum(_spread(keys), dtype=np.uint64), _spread(counts).astype(np.int64)))
            waiting += len(held[-1][0])
            if waiting > buffer:
                held.append(together())
                waiting = 0
    if held:
        yield now, *together()


# --- files ----------------------------------------------------------------------------------------------------------


def _file(arrays: list[bytes]) -> Iterator[bytes]:
    """Blocks behind their lengths, each at a multiple of eight bytes."""
    yield struct.pack("<4sxxxxQ", b"EFTR", len(arrays))
    for x in arrays:
        yield struct.pack("<Q", len(x))
        yield x
        yield bytes(-len(x) % 8)


def _blocks(raw: np.ndarray) -> list[np.ndarray]:
    magic, n = struct.unpack("<4sxxxxQ", raw[:16].tobytes())
    if magic != b"EFTR":
        raise ValueError("not a trie level")
    at, out = 16, []
    for _ in range(n):
        size = int.from_bytes(raw[at : at + 8].tobytes(), "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size + -size % 8
    return out


def _counts(n: np.ndarray) -> bytes:
    width = 4 if not len(n) or int(n.max()) < 1 << 32 else 8
    return struct.pack("<Q", width) + n.astype(f"<u{width}").tobytes()


def _counts_view(raw: np.ndarray) -> np.ndarray:
    return raw[8:].view(f"<u{int(raw[0])}")


def quantise(p: np.ndarray) -> bytes:
    """Probabilities above 0 as bytes, evenly spaced in log10 from the lowest to the highest of them."""
    logs = np.log10(p)
    low, high = (float(logs.min()), float(logs.max())) if len(p) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return struct.pack("<dd", low, step) + np.rint((logs - low) / step).astype(np.uint8).tobytes()


class Quantised:
    def __init__(self, raw: np.ndarray):
        low, step = struct.unpack("<dd", raw[:16].tobytes())
        self.values, self.codes = 10.0 ** (low + step * np.arange(256)), raw[16:]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.values[self.codes[i]]


class Trie:
    """The model's files, mapped as they are asked for, and where its shards begin."""

    def __init__(self, folder: str, words: list[int], total: int):
        self.folder, self.total = folder, total
        self.first_word = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
        self.begin_v = self.begin_w = self.first_pair = self.rank0 = np.zeros(0, dtype=np.int64)
        self.split: dict[int, float] = {}  # rest of the words whose successors lie in several shards
        self.open: dict[tuple[int, int], tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    @property
    def vocabulary(self) -> int:
        return int(self.first_word[-1])

    def cut(self, begin: list[tuple[int, int]]) -> None:
        """Pair shards begin at these (v, w)."""
        self.begin_v, self.begin_w = (np.array([x[k] for x in begin], dtype=np.int64) for k in (0, 1))

    def fill(self, made: dict[int, tuple[int, int, int, float, float]]) -> None:
        """Per pair shard: its pairs, those of its first and last word, and what their probabilities come to."""
        sizes = [made.get(s, (0, 0, 0, 0.0, 0.0)) for s in range(len(self.begin_v))]
        self.first_pair = np.concatenate([[0], np.cumsum([x[0] for x in sizes])]).astype(np.int64)
        self.rank0 = np.zeros(len(sizes), dtype=np.int64)
        own: dict[int, float] = {}
        for s in range(1, len(sizes)):
            if self.begin_w[s]:  # goes on with the word of the shard before
                v = int(self.begin_v[s])
                if v not in own:
                    own[v] = sizes[s - 1][4]
                own[v] += sizes[s][3]
                self.rank0[s] = self.rank0[s - 1] * bool(self.begin_w[s - 1]) + sizes[s - 1][2]
        self.split = {v: 1 - p for v, p in own.items()}

    def level(self, k: int, shard: int) -> tuple | None:
        """Level ``k`` of a shard, None where it has no file."""
        if (k, shard) not in self.open:
            if k == 1:
                empty = self.first_word[shard + 1] == self.first_word[shard]
            else:
                empty = self.first_pair[shard + 1] == self.first_pair[shard]
            if empty:
                return None
            b = _blocks(mapping(f"{self.folder}/level{k}-{shard:06d}.eft"))
            if k == 1:
                self.open[k, shard] = EliasFano(b[0]), _counts_view(b[1])
            elif k == 2:
                self.open[k, shard] = EliasFano(b[0]), int(b[1].view("<u8")[0]), EliasFano(b[2]), Quantised(b[3]), Quantised(b[4])
            else:
                self.open[k, shard] = int(b[0].view("<u8")[0]), EliasFano(b[1]), Quantised(b[2]), Quantised(b[3])
        return self.open[k, shard]

    def counts(self, first: int, n: int) -> np.ndarray:
        """Counts of ``n`` words from id ``first`` on, all of one word shard."""
        s = int(np.searchsorted(self.first_word, first, side="right")) - 1
        return self.level(1, s)[1][first - self.first_word[s] :][:n]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of ascending hashes."""
        ids, counts = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        shards = len(self.first_word) - 1
        owner = shard_of(h, shards)
        for s in np.unique(owner).tolist():
            a, b = np.searchsorted(owner, [s, s + 1])
            if (got := self.level(1, s)) is None:
                continue
            place = got[0].find(h[a:b])
            hit = np.flatnonzero(place >= 0)
            ids[a + hit] = place[hit] + self.first_word[s]
            counts[a + hit] = got[1][place[hit]]
        return ids, counts

    def owner(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Pair shard of ascending (v, w)."""
        s = np.searchsorted(self.begin_v, v, side="right") - 1
        inner = np.flatnonzero(self.begin_w[s] > 0)  # the word is cut: which range holds w
        if len(inner):
            for x in np.unique(v[inner]).tolist():
                a, b = np.searchsorted(v, [x, x + 1])
                lo, hi = np.searchsorted(self.begin_v, [x, x + 1])
                s[a:b] = lo + np.searchsorted(self.begin_w[lo:hi], w[a:b], side="right") - 1
        return s

    def pairs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ascending word ids (>= 0; w as well): pair number or -1, rank of w among the successors of v, p(w|v)'s own
        part, rest(v)."""
        n = len(v)
        j, rank, p, rest = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.ones(n)
        owner = self.owner(v, w)
        for s in np.unique(owner).tolist():
            if (got := self.level(2, s)) is None:
                continue
            ptr, top, seq, q, q_rest = got
            a, b = np.searchsorted(owner, [s, s + 1])
            local = v[a:b] - self.begin_v[s]
            new = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]]))
            of = np.cumsum(np.concatenate([[True], local[1:] != local[:-1]])) - 1
            inside = local < len(q_rest.codes)
            rest[a:b][inside] = q_rest[local[inside]]
            at = np.flatnonzero(inside & (w[a:b] < top))
            place = seq.find(local[at].astype(np.uint64) * np.uint64(top) + w[a:b][at].astype(np.uint64))
            hit = np.flatnonzero(place >= 0)
            at, place = at[hit], place[hit]
            start = ptr.get(np.minimum(local[new], len(ptr) - 1)).astype(np.int64)
            j[a + at] = place + self.first_pair[s]
            rank[a + at] = place - start[of[at]] + np.where(local[at] == 0, self.rank0[s], 0)
            p[a + at] = q[place]
        for x, r in self.split.items():
            a, b = np.searchsorted(v, [x, x + 1])
            rest[a:b] = r
        return j, rank, p, rest

    def triples(self, pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending pair numbers (>= 0) and context-relative ids (-1: none): the triple's own part, rest(pair)."""
        p, rest = np.zeros(len(pair)), np.ones(len(pair))
        owner = np.searchsorted(self.first_pair, pair, side="right") - 1
        for s in np.unique(owner).tolist():
            top, seq, q, q_rest = self.level(3, s)
            a, b = np.searchsorted(owner, [s, s + 1])
            local = pair[a:b] - self.first_pair[s]
            rest[a:b] = q_rest[local]
            at = np.flatnonzero((rank[a:b] >= 0) & (rank[a:b] < top))
            place = seq.find(local[at].astype(np.uint64) * np.uint64(top) + rank[a:b][at].astype(np.uint64))
            hit = np.flatnonzero(place >= 0)
            p[a + at[hit]] = q[place[hit]]
        return p, rest


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words are equal stretches of the hashes' upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# --- training -------------------------------------------------------------------------------------------------------


def _one_by_one(work: Callable, items: Callable) -> Callable:
    """A task that does ``work`` for each of ``items``: what one item took is let go before the next is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = items(batches)
        while item := next(todo, None):
            made = work(*item)
            del item
            yield from made

    return run


def _word_parts(shards: int) -> Callable:
    def work(c: Chunk) -> Iterator[pa.RecordBatch]:
        n = np.bincount(c.tokens[c.trains], minlength=len(c.hashes))
        own = n > 0
        yield from _packed(shard_of(c.hashes[own], shards), c.hashes[own], n[own])

    return _one_by_one(work, _each)


_WORDS = "shard long, n long, tokens long, v long, part long, parts long"


def _write_words(folder: str, shard_tokens: int) -> Callable:
    def work(s: int, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        put(f"{folder}/level1-{s:06d}.eft", _file([encode(h), _counts(n)]))
        # Pair shards begin where another ``shard_tokens`` tokens are reached; a word with more has its own, one or several.
        parts = -(-n // shard_tokens)
        filled = np.cumsum(np.where(parts > 1, 0, n)) // shard_tokens
        hot = parts > 1
        begin = np.concatenate([[True], (filled[1:] != filled[:-1]) | hot[1:] | hot[:-1]])
        rows = [(v, k, int(parts[v]) if hot[v] else 1) for v in np.flatnonzero(begin).tolist() for k in range(int(parts[v]) if hot[v] else 1)]
        columns = zip(*[(s, len(h), int(n.sum()), v, k, of) for v, k, of in rows])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "n", "tokens", "v", "part", "parts"])

    return _one_by_one(work, _merged)


def _ids_of(c: Chunk, key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v, w = np.divmod(key, len(c.hashes))
    return ids[v], ids[w]


def _pair_parts(trie: Trie) -> Callable:
    """Keys are (v less the shard's first word) * V + w."""

    def work(c: Chunk) -> Iterator[pa.RecordBatch]:
        at, key = c.pairs()
        key, n = _counted(key[c.trains[at]])
        if len(key):
            v, w = _ids_of(c, key, trie.words(c.hashes)[0])
            owner = trie.owner(v, w)
            yield from _packed(owner, (v - trie.begin_v[owner]) * trie.vocabulary + w, n)

    return _one_by_one(work, _each)


_PAIRS = "shard long, n long, n_first long, n_last long, p_first double, p_last double"


def _write_pairs(folder: str, trie: Trie) -> Callable:
    def work(s: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, w = (x.astype(np.int64) for x in np.divmod(key, np.uint64(trie.vocabulary)))
        words = int(v[-1]) + 1
        c = trie.counts(int(trie.begin_v[s]), words)
        p = (n - DISCOUNT) / c[v]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(v, minlength=words))])
        mass = np.bincount(v, p, words)
        rest = np.maximum(1 - mass, 1e-12)  # of the words cut over shards the driver has the sum
        top = int(w.max()) + 1
        seq = v.astype(np.uint64) * np.uint64(top) + w.astype(np.uint64)
        put(f"{folder}/level2-{s:06d}.eft", _file([encode(ptr), struct.pack("<Q", top), encode(seq), quantise(p), quantise(rest)]))
        put(f"{folder}/counts2-{s:06d}.u", [_counts(n)])  # for training only
        row = (s, len(key), int(ptr[1]), int(ptr[-1] - ptr[-2]), float(mass[0]), float(mass[-1]))
        yield pa.RecordBatch.from_pydict({x.split()[0]: [y] for x, y in zip(_PAIRS.split(", "), row)})

    return _one_by_one(work, _merged)


def _followed(trie: Trie, c: Chunk, ids: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a chunk: their keys, which one each place of ``at`` has, then number, rank, own part and rest."""
    pairs, which = np.unique(key, return_inverse=True)
    v, w = _ids_of(c, pairs, ids)
    ok = np.flatnonzero((v >= 0) & (w >= 0))
    j, rank, p, rest = np.full(len(pairs), -1, dtype=np.int64), np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs)), np.ones(len(pairs))
    j[ok], rank[ok], p[ok], rest[ok] = trie.pairs(v[ok], w[ok])
    lone = np.flatnonzero((v >= 0) & (w < 0))  # an unknown word behind a known one: only the rest counts
    if len(lone):
        rest[lone] = trie.pairs(v[lone], np.zeros(len(lone), dtype=np.int64))[3]
    return pairs, which, j, rank, p, rest


def _triple_parts(trie: Trie) -> Callable:
    """Keys are (pair less the shard's first pair) * V + rank."""

    def work(c: Chunk) -> Iterator[pa.RecordBatch]:
        at, key = c.pairs()
        own = c.trains[at]
        at, key = at[own], key[own]
        if not len(at):
            return
        pairs, which, j, rank, _, _ = _followed(trie, c, trie.words(c.hashes)[0], at, key)
        third = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
        triple, n = _counted(which[third - 1] * len(pairs) + which[third])
        one, two = np.divmod(triple, len(pairs))
        owner = np.searchsorted(trie.first_pair, j[one], side="right") - 1
        yield from _packed(owner, (j[one] - trie.first_pair[owner]) * trie.vocabulary + rank[two], n)

    return _one_by_one(work, _each)


def _write_triples(folder: str, trie: Trie) -> Callable:
    def work(s: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        real = n > 0  # a row with n = 0 makes sure that a shard without triples is written too
        pair, rank = (x[real].astype(np.int64) for x in np.divmod(key, np.uint64(max(1, trie.vocabulary))))
        n = n[real]
        n_pairs = int(trie.first_pair[s + 1] - trie.first_pair[s])
        if not n_pairs:
            return
        counts = _counts_view(mapping(f"{folder}/counts2-{s:06d}.u"))
        p = (n - DISCOUNT) / counts[pair]
        rest = 1 - np.bincount(pair, p, n_pairs)
        top = int(rank.max()) + 1 if len(rank) else 1
        seq = pair.astype(np.uint64) * np.uint64(top) + rank.astype(np.uint64)
        put(f"{folder}/level3-{s:06d}.eft", _file([struct.pack("<Q", top), encode(seq), quantise(p), quantise(np.maximum(rest, 1e-12))]))
        yield pa.RecordBatch.from_pydict({"shard": [s], "n": [len(n)]})

    return _one_by_one(work, _merged)


_PARTS = "shard long, keys binary, counts binary"
_CHUNK = ["held", "sizes", "hashes", "tokens"]


def train(chunks: DataFrame, shard_tokens: int = 4_000_000) -> Trie:
    """The model of the chunks' texts that aren't held out; its files are in the shared folder."""
    spark = chunks.sparkSession
    folder = shared_folder(spark, "trie")
    tokens = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-tokens // shard_tokens))
    rows = chunks.select(*_CHUNK)
    gather = lambda sent, n, write, schema: sent.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(write, schema).collect()  # noqa: E731  # a few rows a shard
    got = gather(rows.mapInArrow(_word_parts(parts), _PARTS), parts, _write_words(folder, shard_tokens), _WORDS)
    sizes = {r.shard: (r.n, r.tokens) for r in got}
    trie = Trie(folder, [sizes.get(s, (0, 0))[0] for s in range(parts)], sum(x[1] for x in sizes.values()))
    if not trie.total:
        return trie
    trie.cut(sorted((int(trie.first_word[r.shard]) + r.v, r.part * trie.vocabulary // r.parts) for r in got))
    shards = len(trie.begin_v)
    trie.fill({r[0]: r[1:] for r in gather(rows.mapInArrow(_pair_parts(trie), _PARTS), shards, _write_pairs(folder, trie), _PAIRS)})
    none = spark.range(shards).select(F.col("id").alias("shard"), F.lit(_squeeze(np.zeros(1, dtype=np.uint64))).alias("keys"), F.lit(_squeeze(np.zeros(1, dtype=np.uint64))).alias("counts"))
    gather(rows.mapInArrow(_triple_parts(trie), _PARTS).unionByName(none), shards, _write_triples(folder, trie), "shard long, n long")
    return trie


# --- scoring --------------------------------------------------------------------------------------------------------


def _score(trie: Trie) -> Callable:
    def work(c: Chunk) -> Iterator[pa.RecordBatch]:
        ids, counts = trie.words(c.hashes)
        base = (counts + 1) / (trie.total + trie.vocabulary + 1)
        log_base = np.log10(base)
        logs = log_base[c.tokens]
        at, key = c.pairs()
        if trie.total and len(at):
            pairs, which, j, rank, p, rest = _followed(trie, c, ids, at, key)
            del key
            p += rest * base[pairs % len(c.hashes)]
            logs[at] = np.log10(p)[which]
            third = np.flatnonzero((at[1:] == at[:-1] + 1) & (j[which[:-1]] >= 0)) + 1
            triple, place = which[third - 1] * len(pairs) + which[third], at[third]
            del at, which, third
            triple, same = np.unique(triple, return_inverse=True)
            one, two = np.divmod(triple, len(pairs))
            own, left = trie.triples(j[one], np.where(j[two] >= 0, rank[two], -1))
            logs[place] = np.log10(own + left * p[two])[same]
            del place, same, triple, one, two, own, left
        sums = [np.add.reduceat(x, c.starts) for x in ((counts > 0)[c.tokens].astype(np.int64), log_base[c.tokens], logs)]
        held = ~c.trains[c.starts]
        yield pa.RecordBatch.from_arrays([c.ids, pa.array(held), pa.array(c.sizes, pa.int64()), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return _one_by_one(work, _each)


def score_texts(docs: DataFrame, held_out: Column, shard_tokens: int = 4_000_000, chunk_bytes: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model learns
    from the rows for which ``held_out``, a column over doc_id, is false or null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    made = rows.mapInArrow(_chunks(chunk_bytes), f"ids array<{kind}>, held array<boolean>, sizes binary, hashes binary, tokens binary, n long")
    # A row group a chunk: neither the writer nor a reader holds a file's chunks at once, however large the input's splits are.
    chunks = materialise(made, "lm-chunks", compression="zstd", **{"parquet.block.row.count.limit": "1"})
    trie = train(chunks, shard_tokens)
    out = chunks.select("ids", *_CHUNK).mapInArrow(_score(trie), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(trie.total)).cast("long").alias("train_tokens"), "base_score", "score")
