"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import operator
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lectern.llm.common import materialise

#: Bounds of what is fitted: labelled rows, bytes of a text that may be one of them and of all together, and rows of the two tables of vectors.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 200_000
SAMPLE_TOTAL = 16 << 20
CORE_WORDS = 20_000
SHAPES = 2_000
DIMENSIONS = 48
#: Distinct words whose rows in the two tables a worker keeps; it forgets them all when there are more, and looks them up again.
CACHE = 100_000


def shape(word: str) -> str:
    """Classes of a word's characters, runs shortened: "Word,," is "Xx,", "A1b2" is "X9x9"."""
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def core(word: str) -> str:
    """The letters and digits of a word, lowered."""
    return "".join(filter(str.isalnum, word)).lower()


def index_vector(token: str, dimensions: int = DIMENSIONS, ones: int = 6) -> np.ndarray:
    """The sparse random vector of a token: `ones` places of +1 or -1 drawn from its hash."""
    v = np.zeros(dimensions, dtype=np.float32)
    h = xxhash.xxh64_intdigest(token, 7)
    for k in range(ones):
        h = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), k)
        v[h % dimensions] += 1.0 if h >> 63 else -1.0
    return v


class Vectors:
    """Random-indexing vectors of tokens: each the unit sum of its own index vector and its neighbours'."""

    def __init__(self, most: int, least: int = 3, window: int = 2):
        self.most, self.least, self.window = most, least, window
        self.row: dict[str, int] = {}
        self.table = np.zeros((1, DIMENSIONS), dtype=np.float32)

    def fit(self, texts: list[list[str]]) -> Vectors:
        counts = Counter(t for text in texts for t in text)
        known = sorted((t for t, n in counts.items() if n >= self.least), key=lambda t: (-counts[t], t))[: self.most]
        self.row = {t: k + 1 for k, t in enumerate(known)}  # row 0 stands for all others
        base = np.stack([index_vector("\0"), *(index_vector(t) for t in known)])
        ids = [np.fromiter((self.row.get(t, 0) for t in text), dtype=np.int64, count=len(text)) for text in texts]
        near = [np.empty(0, np.int64)]
        for gap in range(1, self.window + 1):
            near += [x[gap:] * len(base) + x[:-gap] for x in ids] + [x[:-gap] * len(base) + x[gap:] for x in ids]
        pairs, counts = np.unique(np.concatenate(near), return_counts=True)
        sums = np.zeros_like(base)
        for at in range(0, len(pairs), 100_000):  # pairs are sorted by word: each word's neighbours are one run of rows
            word, other = np.divmod(pairs[at : at + 100_000], len(base))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sums[word[first]] += np.add.reduceat(base[other] * counts[at : at + 100_000, None].astype(np.float32), first, axis=0)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        self.table = unit(2 * unit(base) + unit(sums)).astype(np.float32)
        return self


class Features:
    """A document's inputs: mean vectors of its words' cores and shapes, and how much it repeats itself.

    They depend on the text alone: what is kept from text to text are rows of fixed tables."""

    def __init__(self, cores: Vectors, shapes: Vectors):
        self.cores, self.shapes = cores, shapes
        self.known: dict[str, tuple[int, int]] = {}

    def _rows(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[word] = self.cores.row.get(core(word), 0), self.shapes.row.get(shape(word), 0)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n, m = len(words), max(1, len(words))
        counts = Counter(words)  # of the whole text, however long
        times = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        rows = np.array([self._rows(w) for w in counts], dtype=np.int64).reshape(-1, 2)
        total = np.zeros(2 * DIMENSIONS)
        for at in range(0, len(times), 20_000):
            part = times[at : at + 20_000, None]
            total[:DIMENSIONS] += (part * self.cores.table[rows[at : at + 20_000, 0]]).sum(0)
            total[DIMENSIONS:] += (part * self.shapes.table[rows[at : at + 20_000, 1]]).sum(0)
        same = sum(map(operator.eq, words, words[1:]))
        distinct, chars = len(counts), sum(map(len, words))
        more = [np.log1p(n) / 10, same / m, distinct / m, np.log1p(distinct) / np.log1p(m), chars / m / 20, float(n == 0)]
        return np.concatenate([total / m, more])


class Network:
    """Inputs, a layer of tanh units, one logit; trained by Adam, its temperature set on rows left out."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
        self.hidden, self.epochs, self.rate, self.decay, self.seed = hidden, epochs, rate, decay, seed

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-3, 1.0
        self.w1, self.b1 = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], self.hidden)), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(0, self.hidden**-0.5, self.hidden), 0.0
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        names, step = ("w1", "b1", "w2", "b2"), 0
        moments = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        for _ in range(self.epochs):
            for at in range(0, len(used), 64):
                pick = used[at : at + 64]
                z = (x[pick] - self.mean) / self.scale
                h = np.tanh(z @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40)))
                g = (p - y[pick]) / len(pick)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = {"w1": z.T @ back + self.decay * self.w1, "b1": back.sum(0), "w2": h.T @ g + self.decay * self.w2, "b2": g.sum()}
                step += 1
                for k in names:
                    a, b = moments[k]
                    a, b = 0.9 * a + 0.1 * grads[k], 0.999 * b + 0.001 * grads[k] ** 2
                    moments[k] = a, b
                    setattr(self, k, getattr(self, k) - self.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
            rng.shuffle(used)
        if len(held):
            at = self.logit(x[held])
            losses = {t: float(np.mean(np.logaddexp(0, -at / t * (2 * y[held] - 1)))) for t in np.geomspace(0.5, 8, 25)}
            self.temperature = min(losses, key=losses.get)
        return self


def fit_model(texts: list[str], labels: np.ndarray) -> bytes:
    """The pickled (features, network) of labelled texts. With one class or none, the network says that class or one half."""
    words = [t.split() for t in texts]
    features = Features(Vectors(CORE_WORDS).fit([[core(w) for w in x] for x in words]), Vectors(SHAPES).fit([[shape(w) for w in x] for x in words]))
    x = np.array([features(t) for t in texts]).reshape(len(texts), 2 * DIMENSIONS + 6)
    features.known = {}
    y = np.asarray(labels, dtype=np.float64)
    constant = (0.5 if not len(y) else float(y[0])) if not len(y) or (y == y[0]).all() else None
    network = None if constant is not None else Network().fit(x, y)
    return pickle.dumps((features, network, constant))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, sample_total: int = SAMPLE_TOTAL) -> bytes:
    """The model of at most `sample_rows` labelled documents of at most `sample_bytes` bytes, and `sample_total` together: those of the
    lowest hash of their id.

    Rows that are not `learnable` (a condition on doc_id), or whose label or text is null, are not learned from; of rows with one
    doc_id the smallest text is. The bounds make the one task that fits the model as small on any corpus."""
    named = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_quality"))
    short = F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = named.join(docs.where(learnable & short).select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(sample_rows)
    texts = docs.where(short).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # sample_rows rows at most
    texts = materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_quality").alias("_quality")), "sample")
    upto = F.sum(F.octet_length("text")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    fits = texts.select("doc_id", upto.alias("_upto")).where(F.col("_upto") <= sample_total).select("doc_id")
    texts = texts.join(F.broadcast(fits), "doc_id", "left_semi")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        return pd.DataFrame({"model": [fit_model(pdf["text"].tolist(), pdf["_quality"].to_numpy())]})

    rows = texts.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fit, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else fit_model([], np.empty(0))


def text_score(spark: SparkSession, text: Column, model: bytes) -> Column:
    """The probability that a text has label 1; null texts score as empty ones. Only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, network, constant = pickle.loads(shared.value)
        for texts in batches:
            # Each text is scored by itself: products of one shape round alike, whatever rows a batch holds.
            one = (lambda t: constant) if constant is not None else (lambda t: float(network.score(features(t.as_py())[None])[0]))
            yield pa.array([one(t) for t in texts], pa.float64())

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs` (doc_id, text and any more), map-side only.

    Labels (doc_id, quality) of rows that are held out are never learned from; the texts alone decide a score.
    Empty and null texts, null ids and repeated rows are scored like any other row; without labels every score is 0.5. A text of
    any length is read whole, in one task, and its score depends on nothing but itself and the model. An empty table gives no rows."""
    model = train(docs, labels, ~held_out, **bounds)
    scored = docs.select("doc_id", text_score(docs.sparkSession, F.col("text"), model).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **bounds) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold."""
    score = text_score(docs.sparkSession, F.col("text"), train(docs, labels, ~held_out, **bounds))
    return docs.where(score >= threshold)
