"""A toxicity score: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Shipped, _BYTE, as_bytes, col, discard, map_rows, mixed, stored

LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256)
)
CACHE_WORDS = 150_000


@dataclass(frozen=True)
class Settings:
    """Sizes and the training schedule.

    ``sample`` bounds the labelled rows that are collected for training: of more, those
    with the smallest hash of their id are taken, the same at every run. Training makes
    ``epochs`` rounds, or as many more as ``steps`` steps take; a small sample is cut into
    small batches.
    """

    sample: int = 8_000
    buckets: int = 1 << 18
    dims: int = 4
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 10
    steps: int = 500
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-6
    seed: int = 7


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def subwords(found: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's byte n-grams and of the whole word, with marks for begin and end; and their counts."""
    marked = [b"<" + w + b">" for w in found]
    sizes = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8)
    end = np.cumsum(sizes)
    last = np.repeat(end, sizes)
    at = np.arange(len(data))
    buckets, owners = [], []
    owner = np.repeat(np.arange(len(found)), sizes)
    h = np.zeros(len(data), np.uint64)
    for j in range(max(settings.grams)):
        nxt = np.minimum(at + j, len(data) - 1)
        h = mixed(h + _BYTE[data[nxt]] * np.uint64(2 * j + 3))
        if j + 1 in settings.grams:
            ok = at + j + 1 <= last
            buckets.append(h[ok])
            owners.append(owner[ok])
    # The whole word, so that a frequent one has a vector of its own.
    starts = end - sizes
    whole = np.add.reduceat(_BYTE[data] * mixed((at - np.repeat(starts, sizes)).astype(np.uint64)), starts)
    buckets.append(mixed(whole))
    owners.append(np.arange(len(found)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint64(settings.buckets)).astype(np.int64), np.bincount(owner, minlength=len(found))


def _all_subwords(found: Iterable[bytes], settings: Settings, step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of words, some at a time; what is found grows in place."""
    left, buckets, counts = iter(found), array("i"), array("i")
    while part := list(islice(left, step)):
        for held, more in zip((buckets, counts), subwords(part, settings)):
            held.frombytes(more.astype(np.int32).tobytes())
    return np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.int32)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run gives 0."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    end = np.cumsum(counts)
    return sums[end] - sums[end - counts]


@dataclass
class Model:
    """Subword vectors and the softmax; between two classes only the difference of scores counts."""

    settings: Settings
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    direction: np.ndarray = field(default=None)

    def __post_init__(self):
        # A text's score is linear in its words' vectors, so each bucket gets one number.
        self.direction = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def word_scores(self, found: list[bytes]) -> np.ndarray:
        buckets, counts = subwords(found, self.settings)
        return _sum_by(self.direction[buckets], counts) / counts

    def scores(self, texts: list[bytes], cache: dict[bytes, float]) -> np.ndarray:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        split = [words(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in cache})
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            cache.update(zip(part, self.word_scores(part).tolist()))
        get = cache.__getitem__
        z = np.array([sum(map(get, ws)) / len(ws) if ws else 0.0 for ws in split])
        return 1.0 / (1.0 + np.exp(-np.clip(z + self.bias[1] - self.bias[0], -500, 500)))


def _bag(text: bytes) -> tuple[bytes, bytes]:
    """The different words of a text, joined by spaces, and how often each is there."""
    times = Counter(words(text))
    return b" ".join(times), np.fromiter(times.values(), np.int32, len(times)).tobytes()


def train(texts: list[bytes], labels: list[int], settings: Settings) -> Model:
    """``train_bags`` on whole texts."""
    return train_bags(((*_bag(t), y) for t, y in zip(texts, labels)), settings)


def train_bags(bags: Iterable[tuple[bytes, bytes, int]], settings: Settings) -> Model:
    """Gradient steps (Adam, averaged over each batch) on vectors, weights and bias together.

    ``bags`` are words, counts and label of each text. They are taken up one by one; what stays
    are the subwords of all different words and the words' numbers in each text. Steps go
    through the dimensions one at a time, and through the buckets some at a time.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 0.1, (settings.buckets, settings.dims))
    weights = rng.normal(0, 0.1, (settings.dims, 2))
    bias = np.zeros(2)
    vocabulary: dict[bytes, int] = {}
    docs, labels = [], []
    for found, times, label in bags:
        found = found.split()
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int32, len(found))
        docs.append((ids, np.frombuffer(bytes(times), np.int32)))
        labels.append(label)
    y = np.array(labels, np.int64)
    if not len(y):
        return Model(settings, vectors, weights * 0, bias)
    share = np.bincount(y, minlength=2) / len(y)
    bias[:] = np.log(np.maximum(share, 1e-3))
    if not vocabulary:
        return Model(settings, vectors, weights * 0, bias)
    buckets, counts = _all_subwords(vocabulary, settings)
    del vocabulary, bags, found
    first = np.cumsum(counts) - counts
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, weights, bias)]
    size = min(settings.batch, max(32, len(y) // 40))
    epochs = max(settings.epochs, settings.steps // -(-len(y) // size))
    step, total = 0, epochs * -(-len(y) // size)

    def adam(i, p, g):
        rate = settings.rate * (1 - (step - 1) / total)
        for a in range(0, len(p), 1 << 14):
            x, m, v, d = (y[a : a + (1 << 14)] for y in (p, *moments[i], g))
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x *= 1 - rate * settings.decay
            x -= rate / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), size):
            step += 1
            batch = order[a : a + size]
            sizes = np.array([len(docs[i][0]) for i in batch])
            ids = np.concatenate([docs[i][0] for i in batch])
            n = np.concatenate([docs[i][1] for i in batch]).astype(np.float64)
            doc = np.repeat(np.arange(len(batch)), sizes)
            n /= np.maximum(1e-9, np.bincount(doc, n, len(batch)))[doc]  # a word's share of its text
            used, inner = np.unique(ids, return_inverse=True)
            flat = buckets[_ranges(first[used], counts[used])]
            dims = range(settings.dims)
            word = [_sum_by(vectors[flat, k], counts[used]) / counts[used] for k in dims]
            mean = np.stack([_sum_by(word[k][inner] * n, sizes) for k in dims], axis=1)
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            d_mean = p @ weights.T
            d_vectors = np.empty_like(vectors)
            for k in dims:
                d_word = np.bincount(inner, d_mean[doc, k] * n, len(used)) / counts[used]
                d_vectors[:, k] = np.bincount(flat, np.repeat(d_word, counts[used]), settings.buckets)
            d_weights = mean.T @ p
            adam(0, vectors, d_vectors)
            adam(1, weights, d_weights)
            adam(2, bias, p.sum(axis=0))
    return Model(settings, vectors, weights, bias)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings = Settings()
) -> Model:
    """Train on the documents that ``labels`` marks 0 or 1, at most ``settings.sample`` of them.

    Ids are chosen before texts are read. Tasks reduce the chosen texts to their different
    words and write them; the driver takes these up file by file, so it never holds the
    texts, however long they are. An id with several labels has the largest, one with several
    documents may give several examples; repeated rows are examples each. With no example
    every text scores 0.5.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter(col(label_col).isin(0, 1) & col(id_col).isNotNull())
        .groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(settings.sample)
    )
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id", "text").alias("h"))
    bags = stored(
        map_rows(found, ["text"], ["h", "label"], "words binary, times binary", lambda texts: list(zip(*map(_bag, as_bytes(texts)))) or [[], []]),
        "examples",
    )
    order = sorted(r["h"] for r in bags.select("h").orderBy("h").limit(settings.sample).collect())
    if not order:
        return train_bags([], settings)
    rows = []
    for r in bags.filter(F.col("h") <= order[-1]).toLocalIterator():
        rows.append((r["h"], r["label"], zlib.compress(bytes(r["words"]), 1), bytes(r["times"])))
    discard(bags)
    rows.sort()
    # What gathering took in the JVM goes back before training takes its own.
    spark._jvm.System.gc()
    return train_bags(((zlib.decompress(w), n, y) for _, y, w, n in rows[: settings.sample]), settings)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Row for row the ``keep`` columns and ``score``, 0 to 1: the probability of label 1.

    A null or empty text, or one without words, gets the score of the classes' shares. Repeated
    rows score alike, an empty table gives none, and a kept column named ``score`` is replaced.
    """
    held = Shipped(docs.sparkSession, model)
    cache: dict[bytes, float] = {}

    def run(texts: pa.Array) -> list:
        return [held.value.scores(as_bytes(texts), cache)]

    return map_rows(docs, [text_col], keep, "score double", run)
