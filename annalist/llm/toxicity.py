"""Toxicity by a subsequence-string-kernel support vector machine with Nystrom landmarks.

The kernel of two words is the normalised gap-weighted subsequence kernel of order
``ORDER`` (each gap costs a factor ``DECAY``), so ``idiot`` stays near ``idxiot`` and
``i-d-i-o-t``.  Landmarks are beginnings of words of the training sample that cover
toxic texts and hardly any others.  A sentence is mapped to its kernel values with the
landmarks (the largest over its words, each taken with all its ASCII non-letters
removed; runs of three or more one-letter words are one word), whitened by the
landmarks' kernel matrix (Nystrom), and scored by a linear SVM that is trained
on labelled sentences: a toxic text's positive sentence is its highest-scoring one
(re-chosen each round), all sentences of the others are negative, and misspelt
copies of the landmarks (one character inserted or dropped) are added as positives.  A
text's score is a logistic function of its ``TOP`` highest sentences and of its
highest value with each landmark, since some landmarks are surer than others.

Support condition: the kernel with a landmark counts as 0 where it is below
``SUPPORT`` of the landmark's own.  Words with dropped, masked or replaced letters
(``stpid``, ``cl*wn``) are kept by that like others: ``reachable`` leaves out only
words whose letter sets show that they stay below it.  A sentence's value with a
landmark is the square of how far the kernel is above the landmark's floor, which
the clean texts of the training sample set (``chance``).

The training sample is bounded by ``TRAIN_ROWS`` labelled rows a class and
``TRAIN_BYTES`` a text.  Its ids are found on the narrow label table and only
these ids are broadcast; scoring is one map over the whole texts.

Defined results: null, empty and letterless texts have the score of a sentence
without any landmark; several labels of one id count as toxic if one is; null
labels are not used; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens

ORDER, DECAY = 3, 0.6
#: Bounds of the training sample: labelled rows a class, bytes of a text that is used.
TRAIN_ROWS, TRAIN_BYTES = 1500, 1 << 16
#: Landmarks at most, bytes of the shortest, texts a landmark must newly cover.
LANDMARKS, LEAST_LETTERS, LEAST_COVER = 24, 4, 5
#: Sentences with the highest margins whose margins make the score of a text.
TOP = 3
#: Letters of a word that the kernel reads; longer words are cut into overlapping parts of this length.
WORD_LETTERS = 32
#: A kernel value below this share of the landmark's own counts as 0.
SUPPORT = 0.3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DROP = bytes(c for c in range(33, 128) if not (65 <= c <= 90 or 97 <= c <= 122))
_SENTENCE = re.compile(rb"[.!?]+(?=\s)|\n+")
#: Bit of each letter; non-ASCII bytes share the last bits.
_BIT = np.array([1 << (c - 97) if 97 <= c <= 122 else 1 << (26 + c % 6) if c >= 0x80 else 0 for c in range(256)], np.uint32)


#: Marks the start of a word: the kernel reads it like a letter.
START = b"^"


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text in the form the kernel reads."""
    words = raw.translate(_LOWER, _DROP).split()
    out, run = [], []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append(b"".join(run))
        if run:
            run = []
        out.append(w)
    if len(run) > 2:
        out.append(b"".join(run))
    if any(len(w) > WORD_LETTERS for w in out):
        out = [w[i : i + WORD_LETTERS] for w in out for i in range(0, max(1, len(w) - WORD_LETTERS // 2), WORD_LETTERS // 2)]
    return out


def letters(words: list[bytes]) -> np.ndarray:
    """Set of letters of each word, as bits."""
    if not words:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.bitwise_or.reduceat(_BIT[np.frombuffer(b"".join(words), np.uint8)], first)


def shared_letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sets of letters of each word, and of those that stand in it more than once; ``words`` by length."""
    have = np.zeros(len(words), np.uint32)
    twice = np.zeros(len(words), np.uint32)
    for i in range(0, len(words), 4096):
        x = _padded(words[i : i + 4096])
        seen, again = np.zeros(len(x), np.uint32), np.zeros(len(x), np.uint32)
        for c in range(1, x.shape[1]):
            bit = _BIT[x[:, c]]
            again |= seen & bit
            seen |= bit
        have[i : i + 4096], twice[i : i + 4096] = seen, again
    return have, twice


def _padded(words: list[bytes]) -> np.ndarray:
    width = max(map(len, words)) + 1
    return np.frombuffer(b"".join((START + w).ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def raw_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of paired words: rows of two zero-padded byte matrices (one row of ``b`` serves all)."""
    a, b = a.T, b.T
    width, other, n = len(a), len(b), a.shape[1]
    square = decay * decay
    same = np.zeros((width, other, n), np.float32)
    np.multiply(a[:, None] == b[None], square, out=same)
    same *= (a > 0)[:, None]
    # inner[s, t]: weighted common subsequences of the first s and t letters, each gap to the end counted
    inner = np.ones((width, other, n), np.float32)
    for _ in range(order - 1):
        hit = same * inner
        inner = np.zeros((width, other, n), np.float32)
        for t in range(1, other):
            # the row of the next letter: what ended at t - 1, and what ended before with one more gap
            hit[:, t] += decay * hit[:, t - 1]
            inner[1:, t] = hit[:-1, t - 1]
        for s in range(2, width):
            inner[s] += decay * inner[s - 1]
    return np.einsum("stn,stn->n", same, inner)


def kernel(a: list[bytes], z: bytes) -> np.ndarray:
    """Normalised kernel of words with ``z``; 0 where it is below ``SUPPORT`` of z's own value, unnormalised."""
    out = np.zeros(len(a))
    if not a:
        return out
    x, y = _padded(a), _padded([z])
    own = raw_kernel(y, y)[0]
    raw = raw_kernel(x, y)
    near = np.flatnonzero(raw >= max(SUPPORT * own, 1e-12))
    if len(near):
        out[near] = raw[near] / np.sqrt(raw_kernel(x[near], x[near]) * own)
    return out


@lru_cache(256)
def _most(z: bytes) -> tuple[list[int], np.ndarray]:
    """Bits of the letters of ``z``, and for each set of them the largest raw kernel with ``z`` of a word that shares just these, each once.

    Such a word holds a subsequence of ``z`` once at most, with ``ORDER`` letters that are next to each other at best.
    """
    bits = sorted({int(_BIT[c]) for c in z})
    at = [None, *(bits.index(int(_BIT[c])) for c in z)]  # every word holds START
    sets = np.arange(1 << len(bits))
    most = np.zeros(len(sets))
    for places in combinations(range(len(at)), ORDER):
        held = [at[i] for i in places if at[i] is not None]
        if len(set(held)) == len(held):
            need = sum(1 << b for b in held)
            most[(sets & need) == need] += DECAY ** (places[-1] - places[0] + 1)
    return bits, most * DECAY**ORDER


def reachable(have: np.ndarray, twice: np.ndarray, z: bytes) -> np.ndarray:
    """Which words may reach ``SUPPORT`` with ``z``: none that does is left out."""
    bits, most = _most(z)
    shared = np.zeros(len(have), np.int32)
    for k, b in enumerate(bits):
        shared |= ((have & np.uint32(b)) != 0).astype(np.int32) << k
    y = _padded([z])
    # a little less than SUPPORT, as kernels are summed in single precision
    enough = most[shared] >= 0.999 * SUPPORT * raw_kernel(y, y)[0]
    return enough | ((twice & letters([z])[0]) != 0)


@dataclass
class Model:
    landmarks: list[bytes]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    pool: np.ndarray  # weights of what ``pooled`` returns
    floor: np.ndarray  # of each landmark: up to here kernel values count as chance

    def above(self, values: np.ndarray) -> np.ndarray:
        """Kernel values as shares of the way from the floor to 1."""
        return np.maximum(values - self.floor, 0.0) / (1.0 - self.floor)

    def values(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Kernel values with all landmarks of the words that have any."""
        words = sorted(words, key=len)  # words of a call to the kernel are padded to the longest
        have, twice = shared_letters(words)
        out: dict[bytes, np.ndarray] = {}
        for j, z in enumerate(self.landmarks):
            near = [words[i] for i in np.flatnonzero(reachable(have, twice, z))]
            for i in range(0, len(near), 2048):
                for w, v in zip(near[i : i + 2048], kernel(near[i : i + 2048], z).tolist(), strict=True):
                    if v > 0:
                        out.setdefault(w, np.zeros(len(self.landmarks)))[j] = v
        return out

    def features(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Squared shares above the floor, with all landmarks, of the words that have any."""
        return {w: self.above(v) ** 2 for w, v in self.values(words).items() if (v > self.floor).any()}

    def margin(self, features: np.ndarray) -> np.ndarray:
        return features @ self.whiten @ self.weights + self.bias

    def pooled(self, features: list[np.ndarray]) -> np.ndarray:
        """Of a text: the TOP highest margins over that of a sentence without any landmark, and each landmark's highest value."""
        found = np.array(features) if features else np.zeros((1, len(self.landmarks)))
        margins = np.concatenate([self.margin(found) - self.bias, np.zeros(TOP)])
        return np.concatenate([np.sort(margins)[::-1][:TOP], found.max(axis=0), [1.0]])

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(pooled @ self.pool, -30, 30)))

    def scores(self, texts: list[bytes | None]) -> list[float]:
        if not self.landmarks:
            return [0.0] * len(texts)
        words = [words_of(t or b"") for t in texts]
        near = self.features(list(set().union(*words)))
        tops = [self.pooled([] if near.keys().isdisjoint(ws) else sentence_features(t, near, len(self.landmarks))) for t, ws in zip(texts, words, strict=True)]
        return self.probability(np.array(tops)).tolist() if tops else []


def sentence_features(raw: bytes, near: dict[bytes, np.ndarray], size: int) -> list[np.ndarray]:
    """For each sentence the largest kernel value with each landmark; spelt-out words may cross a full stop."""
    out = []
    for part in [*_SENTENCE.split(raw), *(raw[i:j] for i, j in _spelt(raw))]:
        f = np.zeros(size)
        for w in words_of(part):
            if w in near:
                np.maximum(f, near[w], out=f)
        out.append(f)
    return out


def _spelt(raw: bytes):
    """Places of three or more one-letter words in a row (letters with anything but letters between them)."""
    return [m.span() for m in re.finditer(rb"(?<![A-Za-z\x80-\xff])(?:[A-Za-z][^A-Za-z\x80-\xff]+){2,}[A-Za-z](?![A-Za-z\x80-\xff])", raw)]


def _stems(words: set[bytes], among: Counter | None = None) -> set[bytes]:
    """Beginnings of words, and whole words."""
    out = {w[:n] for w in words for n in range(LEAST_LETTERS, min(len(w), 12) + 1)}
    return out if among is None else {x for x in out if x in among}


def choose_landmarks(toxic: list[set[bytes]], clean: list[set[bytes]], most: int = LANDMARKS) -> list[bytes]:
    """Greedy cover by beginnings of words: each landmark adds most toxic texts less clean ones (by rate).

    Those that are in clean texts at more than a quarter of the rate are no candidates.
    """
    bags = [_stems(ws) for ws in toxic]
    counts = Counter(x for b in bags for x in b)
    counts = Counter({x: n for x, n in counts.items() if n >= LEAST_COVER})
    against = Counter(x for ws in clean for x in _stems(ws, counts))
    rate = len(toxic) / max(1, len(clean))
    fair = {x for x, n in counts.items() if against[x] * rate * 4 <= n}
    bags = [b & fair for b in bags]
    apart = lambda x, out: not any(x.startswith(z) or z.startswith(x) for z in out)
    worth = lambda n, x: (n - against[x] * rate, len(x), x)
    out: list[bytes] = []
    left = bags
    while len(out) < most and left:
        new = Counter(x for b in left for x in b)
        best = max(((worth(n, x), x) for x, n in new.items() if n >= LEAST_COVER and apart(x, out)), default=None)
        if best is None or best[0][0] < LEAST_COVER:
            break
        out.append(best[1])
        left = [b for b in left if best[1] not in b]
    # others as telling as those, though landmarks cover their texts already
    for _, x in sorted(((worth(counts[x], x), x) for x in fair if counts[x] * 30 >= len(toxic) and against[x] * rate * 30 <= counts[x]), reverse=True):
        if len(out) < most and apart(x, out):
            out.append(x)
    return out


def fit(texts: list[bytes], toxic: list[bool], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    bags = [set(words_of(t)) for t in texts]
    marks = choose_landmarks([b for b, y in zip(bags, toxic, strict=True) if y], [b for b, y in zip(bags, toxic, strict=True) if not y])
    m = len(marks)
    if not m or all(toxic) or not any(toxic):
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), np.zeros(0))
    model = Model(marks, np.eye(m), np.zeros(m), 0.0, np.zeros(0), np.zeros(m))
    model.floor = chance(model, [b for b, y in zip(bags, toxic, strict=True) if not y])
    gram = np.stack([kernel(marks, z) for z in marks])
    gram = model.above(np.maximum(gram, gram.T))
    gram = np.maximum(gram, gram.T)
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(m))
    model.whiten = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    near = model.features(sorted(set().union(*bags)))
    sentences = [np.unique(np.array(sentence_features(t, near, m)), axis=0) for t in texts]
    misspelt = [z[:i] + b + z[i + cut :] for z in marks for i in range(1, len(z)) for b, cut in ((bytes([97 + int(rng.integers(26))]), 0), (b"", 1))]
    extra = np.zeros((len(misspelt), m))
    known = model.features(misspelt)
    for i, w in enumerate(misspelt):
        extra[i] = known.get(w, extra[i])
    negative = np.unique(np.concatenate([s for s, y in zip(sentences, toxic, strict=True) if not y]), axis=0)
    chosen = [s[np.argmax(s.sum(axis=1))] for s, y in zip(sentences, toxic, strict=True) if y]
    for _ in range(3):
        positive = np.concatenate([np.array(chosen), extra])
        _hinge(model, positive, negative)
        chosen = [s[np.argmax(model.margin(s))] for s, y in zip(sentences, toxic, strict=True) if y]
    whole = np.array([model.pooled(sentence_features(t, near, m)) for t in texts])
    # landmarks that no clean text holds are sure: one misspelt copy of them makes a text toxic
    clean = [i for i, y in enumerate(toxic) if not y]
    sure = whole[clean][:, TOP:-1].max(axis=0) < 0.95
    alone = np.array([model.pooled([f]) for f, j in zip(extra, (j for j, z in enumerate(marks) for _ in range(2 * len(z) - 2)), strict=True) if sure[j]]).reshape(-1, whole.shape[1])
    _calibrate(model, np.concatenate([whole, alone]), np.array([*toxic, *[True] * len(alone)]), np.concatenate([np.ones(TOP, bool), sure]))
    return model


def chance(model: Model, clean: list[set[bytes]]) -> np.ndarray:
    """Of each landmark: the square of the kernel value that one in a hundred of the clean texts that don't hold it exceeds.

    The square leaves landmarks whose neighbours are frequent most of their range.
    """
    near = model.values(sorted(set().union(*clean)))
    none = np.zeros(len(model.landmarks))
    highest = np.array([np.max([none, *(near[w] for w in b if w in near)], axis=0) ** 2 for b in clean])
    return np.array([np.quantile(v[v < 0.95], 0.99) if (v < 0.95).any() else 0.0 for v in highest.T])


def _hinge(model: Model, positive: np.ndarray, negative: np.ndarray, rounds: int = 1500, c: float = 500.0) -> None:
    """Linear SVM on whitened features by full subgradient steps; the classes weigh the same."""
    x = np.concatenate([positive, negative]) @ model.whiten
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    share = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / len(negative))])
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b = w.copy(), 0.0
    for t in range(1, rounds + 1):
        inside = share * (y * (x @ w + b) < 1)
        rate = 4.0 / (1.0 + 0.01 * t)
        w -= rate * (w / c - (inside * y) @ x * 2)
        b += rate * float((inside * y).sum()) * 2
        if t > rounds // 2:
            mean_w += w
            mean_b += b
    n = rounds - rounds // 2
    model.weights, model.bias = mean_w / n, mean_b / n


def _calibrate(model: Model, x: np.ndarray, toxic: np.ndarray, rising: np.ndarray) -> None:
    """Logistic regression of the label on the pooled values, by damped Newton steps.

    ``rising``: values that may only raise the score.  A landmark that clean texts hold too may lower it:
    then one sentence with it isn't enough, but several are.
    """
    y = toxic * 0.98 + 0.01
    w = np.zeros(x.shape[1])
    w[:TOP] = 0.5
    ridge = np.full(len(w), 0.05)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - 0.7 * np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w[:-1][rising] = np.maximum(w[:-1][rising], 0.0)
    model.pool = w


def _window(text, doc_id):
    """A text that is longer than the bound gives ``TRAIN_BYTES`` characters from a place that its id's hash chooses."""
    room = F.greatest(F.lit(1), F.char_length(text) - TRAIN_BYTES + 1)
    return F.when(F.char_length(text) <= TRAIN_BYTES, text).otherwise(F.substring(text, (F.pmod(F.xxhash64(doc_id), room) + 1).cast("int"), F.lit(TRAIN_BYTES)))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``usable``: which label rows may be learnt from."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    sample = known.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).select("doc_id", "toxic").collect()
    if not sample:
        return fit([], [])
    # 2 x rows ids at most
    ids = spark.createDataFrame(sample, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _window(F.col("text").cast("string"), F.col("doc_id")).alias("text")).join(F.broadcast(ids), "doc_id")
    found = sorted((r.doc_id, r.text.encode(), r.toxic) for r in texts.toLocalIterator())
    return fit([t for _, t, _ in found], [y > 0 for _, _, y in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in tokens.pieces(batches, most=2 << 20):
            yield pa.record_batch([batch.column(0), pa.array(held.value.scores(tokens.as_bytes(batch.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
