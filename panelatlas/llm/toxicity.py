"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts the subsequences of three letters that two words share, each weighted by ``decay`` to the power of the
stretch it spans in either word, up to ``span`` letters, over a norm that depends on the words' lengths. An insult with letters left out, put in or
changed still shares most of its subsequences; characters other than letters are taken out first (digits and signs that
stand for letters are read as such), and words spelled with spaces between their letters are closed up.

A sentence's kernel value with a landmark is that of its best word. The machine is trained on labelled sentences: each sentence
of a clean text is clean, and of a toxic text at least one sentence is toxic, which of them being found as it learns
(multiple-instance learning). Fitting, on labelled texts only:

* start: letter groups that more toxic texts have than chance allows for so many groups point to each toxic text's first
  guess of a toxic sentence and its word; if none is beyond chance, the best few are taken;
* ``landmarks`` of these words and of clean ones are the Nyström basis: features are kernel values with them, times the
  inverse root of the landmarks' kernel matrix; a linear SVM (squared hinge, Newton's method) separates the sentences;
* ``rounds`` times the sentences are judged again: of a toxic text those above 0, or else its highest one, are its toxic
  sentences from then on, the others don't count; of the clean sentences the ``hardest`` join those already held;
* a text's value is the highest of its sentences'; a logistic curve over texts the SVM hasn't seen turns it into a score.

As the kernel is linear in the subsequences, landmarks, basis and SVM fold into one weight per subsequence, a table of
fixed size, and scoring a word is a sum over its subsequences. Words are remembered by each Python worker.

Fitting takes a sample of at most ``per_class`` texts of each label, of at most ``max_bytes`` each, drawn by a hash of the
identifier, and begins with at most ``starts`` toxic words and ``clean_words`` clean ones (the commonest third, and an even
choice of the rest); scoring reads every text whole. Null texts count as empty and score like texts without words. Without both
labels in the sample every text scores the share of toxic labels (0.5 without any). Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# Signs that stand for letters.
STANDS_FOR = str.maketrans("013457@$", "oieastas")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
_CHUNK, _STEP = 32, 16
_CODES = 64


def letters(token: str) -> str:
    """The letters of a token, in lower case."""
    if token.isascii() and token.isalpha():
        return token
    return "".join(filter(str.isalpha, token.translate(STANDS_FOR)))


def tokens(text: str) -> list[str]:
    text = text.lower()
    out = text.replace(". ", " ").replace(", ", " ").split()
    if spelled := _SPELLED.findall(text):
        out += ["".join(x.split()) for x in spelled]
    return out


def _code(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter codes below 64; letters beyond a-z share the upper codes."""
    u = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype="<u4").reshape(len(words), -1)
    return np.where((u >= 97) & (u <= 122), u - 97, 26 + u % (_CODES - 26)).astype(np.int64)


@lru_cache(maxsize=None)
def _triples(n: int, span: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a word of n letters, and their weights over the word's norm."""
    at = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + span)) for j in range(i + 1, k)]
    at = np.array(at, dtype=np.int64).reshape(-1, 3)
    weight = decay ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / np.sqrt((weight * weight).sum())


def subsequences(words: list[str], span: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: subsequence numbers by row, and their weights."""
    c = _code(words).astype(np.int32)
    at, weight = _triples(c.shape[1], span, decay)
    return (c[:, at[:, 0]] * _CODES + c[:, at[:, 1]]) * _CODES + c[:, at[:, 2]], weight


def _by_length(words: list[str]) -> Iterator[list[int]]:
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(len(w), []).append(i)
    for n, rows in at.items():
        if n >= 3:
            step = max(1, 400_000 // max(1, n * 20))
            yield from (rows[k : k + step] for k in range(0, len(rows), step))


def chunks(word: str) -> list[str]:
    """A word, or the overlapping pieces of a very long one."""
    return [word] if len(word) <= _CHUNK else [word[k : k + _CHUNK] for k in range(0, len(word) - _STEP, _STEP)]


class Kernel:
    def __init__(self, span: int = 6, decay: float = 0.7):
        self.span, self.decay = span, decay

    def dense(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Explicit features of a few words: a place for each subsequence number (0: in none of them), and a row for each
        place with a column for each word."""
        parts = [(rows, *subsequences([words[i] for i in rows], self.span, self.decay)) for rows in _by_length(words)]
        used = np.unique(np.concatenate([f.reshape(-1) for _, f, _ in parts])) if parts else np.zeros(0, dtype=np.int64)
        place = np.zeros(_CODES**3, dtype=np.int32)
        place[used] = np.arange(1, len(used) + 1)
        out = np.zeros((len(used) + 1, len(words)))
        for rows, f, w in parts:
            for r, i in enumerate(rows):
                np.add.at(out[:, i], place[f[r]], w)
        return place, out

    def basis_values(self, words: list[str], place: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Kernel values of words with the columns of ``table``; words under 3 letters have 0."""
        out = np.zeros((len(words), table.shape[1]))
        for rows in _by_length(words):
            f, w = subsequences([words[i] for i in rows], self.span, self.decay)
            out[rows] = np.stack([w @ table[r] for r in place[f]])
        return out

    def decide(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Weighted sums over each word's subsequences."""
        out = np.zeros(len(words))
        for rows in _by_length(words):
            f, w = subsequences([words[i] for i in rows], self.span, self.decay)
            out[rows] = table[f] @ w
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Linear SVM with squared hinge loss in the primal, by Newton's method; the last column of ``x`` is the bias."""
    w = np.zeros(x.shape[1])
    keep = np.ones(x.shape[1])
    keep[-1] = 1e-4
    for _ in range(30):
        m = 1 - y * (x @ w)
        on = m > 0
        g = keep * w - 2 * c * x.T @ np.where(on, weight * y * m, 0.0)
        if np.abs(g).max() < 1e-8:
            break
        h = np.diag(keep)
        for at in np.array_split(np.flatnonzero(on), max(1, int(on.sum()) // 4096)):  # no copy of all rows at once
            part = x[at]
            h += 2 * c * (part.T * weight[at]) @ part
        step, t = np.linalg.solve(h, g), 1.0
        loss = lambda v: 0.5 * (keep * v * v).sum() + c * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        now = loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
    return w


class Model:
    """A weight per subsequence, a bias, and the logistic curve; or a constant."""

    def __init__(self, table: np.ndarray | None, bias: float, a: float, b: float, kernel: Kernel):
        self.table, self.bias, self.a, self.b, self.kernel = table, bias, a, b, kernel
        self.known: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values of letter strings."""
        parts = [chunks(w) for w in words]
        flat = [p for x in parts for p in x]
        v = self.kernel.decide(flat, self.table) + self.bias if flat else np.zeros(0)
        return v if len(flat) == len(words) else np.array([x.max() for x in np.split(v, np.cumsum([len(x) for x in parts])[:-1])])

    def values(self, texts: list[str]) -> list[float]:
        """Each text's highest decision value of its words; that of no letters for a text without words."""
        toks = [tokens(t) for t in texts]
        known = self.known
        new = set().union(*toks)
        if len(known) + len(new) > 150_000:  # a bound on memory only
            known.clear()
        new = list(new - known.keys())
        known.update(zip(new, self.words([letters(t) for t in new]).tolist()))
        return [max(map(known.__getitem__, x), default=self.bias) for x in toks]

    def scores(self, texts: list[str], step: int = 256) -> list[float]:
        if self.table is None:
            return [self.b] * len(texts)
        out = []
        for at in range(0, len(texts), step):
            z = self.a * np.array(self.values(texts[at : at + step])) + self.b
            out += (1 / (1 + np.exp(-np.clip(z, -700, 700)))).tolist()
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _platt(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.stack([v, np.ones(len(v))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        g = x.T @ (q - t) + 1e-3 * p
        h = (x.T * np.maximum(q * (1 - q), 1e-9)) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


class Sentences:
    """The words of labelled sentences, as numbers: those of sentence i are ``flat[start[i]:start[i + 1]]``."""

    def __init__(self, texts: Iterable[tuple[int, str]]):
        number: dict[str, int] = {}
        flat, start, text = array("i"), array("q", [0]), array("i")
        for i, t in texts:
            for sentence in _SENTENCE_END.split(t):
                words = dict.fromkeys(p for token in tokens(sentence) for p in chunks(letters(token)) if len(p) >= 3)
                if words:
                    flat.extend(number.setdefault(w, len(number)) for w in words)
                    start.append(len(flat))
                    text.append(i)
        self.words, self.number = list(number), number
        self.flat, self.start, self.text = (np.array(x) for x in (flat, start, text))

    def texts_with(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, how many clean and how many toxic texts have it."""
        n = max(1, len(self.words))
        pairs = np.unique(np.repeat(self.text, np.diff(self.start)).astype(np.int64) * n + self.flat)
        toxic = label[pairs // n] == 1
        return np.bincount(pairs[~toxic] % n, minlength=n), np.bincount(pairs[toxic] % n, minlength=n)

    def best(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's highest value of its words, and the first word that has it."""
        v, sizes = value[self.flat], np.diff(self.start)
        top = np.maximum.reduceat(v, self.start[:-1])
        at = np.flatnonzero(v == np.repeat(top, sizes))
        first = np.unique(np.repeat(np.arange(len(top)), sizes)[at], return_index=True)[1]
        return top, self.flat[at[first]]


def _starts(toxic: list[list[str]], n1: int, clean_words: Counter, n0: int) -> Counter:
    """Words of toxic texts with a letter group (3 to 8 letters) that more toxic texts have than chance allows, by texts.

    ``toxic`` has the words of each of the ``n1`` toxic texts; ``clean_words`` counts the ``n0`` clean texts by their words.
    """
    floor = max(2, 0.01 * n1)
    df: dict[str, int] = {}
    alive: set[str] | None = None
    for k in range(3, 9):  # a frequent group begins with a frequent shorter one
        level: Counter = Counter()
        for d in toxic:
            level.update({w[i : i + k] for w in d for i in range(len(w) - k + 1) if alive is None or w[i : i + k - 1] in alive})
        found_k = {g: n for g, n in level.items() if n >= floor}
        df.update(found_k)
        alive = set(found_k)
    in_clean: Counter = Counter()  # by words: a text with two such words counts twice, on the side of caution
    for w, n in clean_words.items():
        for g in {w[i : i + k] for k in range(3, 9) for i in range(len(w) - k + 1)} & df.keys():
            in_clean[g] += n
    # A group's texts are toxic by chance with the share of all; Chernoff's bound on the chance of so many of them.
    share, beyond = n1 / (n1 + n0), {}
    for g, a in df.items():
        b = in_clean[g]
        if b * n1 < 0.2 * a * n0:
            beyond[g] = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0)
    strength = {g: v for g, v in beyond.items() if v > math.log(max(2, len(df)))}
    if not strength and beyond:
        least = sorted(beyond.values())[-min(len(beyond), 20)]
        strength = {g: v for g, v in beyond.items() if v >= least}
    found: Counter = Counter()
    for d in toxic:
        best = {w: s for w in d if (s := max((strength[g] for n in range(3, 9) for i in range(len(w) - n + 1) if (g := w[i : i + n]) in strength), default=0))}
        most = max(best.values(), default=0)
        found.update(w for w, s in best.items() if s >= 0.3 * most)
    return found


def fit(texts: list[str], labels: list[int], landmarks: int = 256, kernel: Kernel | None = None, rounds: int = 5, hardest: int = 6000, starts: int = 4000, clean_words: int = 12_000) -> Model:
    kernel = kernel or Kernel()
    y = np.array(labels, dtype=int)
    constant = Model(None, 0.0, 0.0, float((y.sum() + 1) / (len(y) + 2)), kernel)
    if not len(y) or y.min() == y.max():
        return constant
    # Every fifth text is kept for the logistic curve: sentences the SVM has not seen must not look better than they are.
    turn_of = np.zeros(len(y), dtype=int)
    for k in (0, 1):
        turn_of[y == k] = np.arange((y == k).sum()) % 5
    n0, n1 = (int(((y == k) & (turn_of > 0)).sum()) for k in (0, 1))
    learn = Sentences((i, t) for i, t in enumerate(texts) if turn_of[i])
    if not n1 or not n0 or not len(learn.text):
        return constant
    words, label = learn.words, y[learn.text]
    in_clean, in_toxic = learn.texts_with(y)
    able = in_clean * n1 <= 0.2 * in_toxic * n0  # words that clean texts hardly have, next to toxic ones
    of_text: dict[int, set[int]] = {}
    for s in np.flatnonzero(label == 1):
        at = learn.flat[learn.start[s] : learn.start[s + 1]]
        of_text.setdefault(int(learn.text[s]), set()).update(at[able[at]].tolist())
    count = Counter({words[i]: int(in_clean[i]) for i in np.flatnonzero(in_clean)})
    found = _starts([[words[i] for i in sorted(d)] for d in of_text.values()], n1, count, n0)
    good = [w for w, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:starts]]
    if not good:
        return constant
    common = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    most = clean_words // 3
    quarter = landmarks // 4
    basis = list(dict.fromkeys(good[: landmarks // 2] + common[:quarter] + common[quarter :: max(1, len(common) // quarter)][:quarter]))
    place, dense = kernel.dense(basis)
    values, vectors = np.linalg.eigh(dense.T @ dense)
    ok = values > 1e-8
    root = vectors[:, ok] / np.sqrt(values[ok])
    # Sentences by their best word: the toxic ones, and the clean ones with a weight for how many they are.
    toxic = [learn.number[w] for w in good]
    clean = {learn.number[w]: 1.0 for w in common[:most] + common[most :: max(1, (len(common) - most) // (clean_words - most))]}
    for turn in range(rounds):
        use = toxic + list(clean)
        x = np.ones((len(use), root.shape[1] + 1))
        for at in range(0, len(use), 4096):
            x[at : at + 4096, :-1] = kernel.basis_values([words[i] for i in use[at : at + 4096]], place, dense) @ root
        target = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
        w = _svm(x, target, np.array([4.0] * len(toxic) + [3.0 * v for v in clean.values()]))
        del x
        model = Model((dense @ (root @ w[:-1]))[place], float(w[-1]), 1.0, 0.0, kernel)
        if turn == rounds - 1:
            break
        value = model.words(words)
        top, word = learn.best(value)
        hard = Counter(word[label == 0].tolist())
        for i in sorted(hard, key=lambda i: (-value[i], words[i]))[:hardest]:
            clean[i] = max(clean.get(i, 0.0), 1.0 + math.log(hard[i]))
        highest = np.full(len(y), -np.inf)
        np.maximum.at(highest, learn.text, top)
        judged = (label == 1) & ((top > 0) | (top >= highest[learn.text])) & able[word]
        if not judged.any():
            break
        toxic = sorted(set(word[judged].tolist()))
    apart = [i for i in range(len(y)) if not turn_of[i]]
    held = [texts[i] for i in apart]
    model.a, model.b = _platt(np.array([v for at in range(0, len(held), 256) for v in model.values(held[at : at + 256])]), y[apart])
    model.known = {}
    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_bytes: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn=None) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of each label, of at most ``max_bytes``, by a hash of the identifier."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and __id is not null").groupBy("__id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= max_bytes)
    rows = rows.filter(may_learn(F.col("__id"))) if may_learn else rows
    ids = rows.select("__id").distinct().join(known, "__id")
    # Identifiers first, at most 2 * per_class of them; texts of no others come to the driver.
    chosen = [r for k in (0, 1) for r in ids.filter(F.col("y") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_class).select("__id", "y").collect()]
    picked = docs.sparkSession.createDataFrame(chosen, ids.select("__id", "y").schema)
    out = [(r[0], r[1]) for r in rows.join(F.broadcast(picked), "__id").select("text", "y").orderBy("__id", "text").limit(2 * per_class).collect()]
    return [t for t, _ in out], [k for _, k in out]


def score_column(model) -> Callable:
    """mapInArrow function (id, text) -> (id, score); ``model`` is a broadcast variable of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            s = m.scores([raw.decode() for raw in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col))
    return rows.mapInArrow(score_column(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def drop_toxic(docs: DataFrame, model: Model, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([s < cut for s in m.scores([t or "" for t in texts.to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
