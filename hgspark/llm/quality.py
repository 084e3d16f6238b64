"""Quality classifier: supervised subword embeddings with a softmax output.

A text's features are its white-space tokens as written, pairs of neighbouring tokens (a repeated token is one feature,
whichever it is), and the character 3- and 4-grams
of every token with its ends marked. Each is hashed to a bucket that has a learned vector; a text is the mean of its
features' vectors; a linear layer and softmax give class probabilities. Vectors and layer are trained by stochastic
gradient descent (Adagrad steps) in numpy on the driver, on a bounded sample of labelled rows (TRAIN_ROWS, those with the
smallest hash of their id, each with its whole text). As the output is linear in the mean, scoring keeps one number per
bucket and class: a task adds up numbers of words it has seen from a bounded cache.

Defined results: a null, empty or blank text has no features and gets the trained bias alone; it is never kept by
`keep_good` (there is nothing in it to keep); a text of any length is read whole. Labels that are null are left out; an id
labelled repeatedly counts by its largest label. Without two classes in the sample there is no model: every text with a
word gets probability 1. A probability equal to the threshold is kept; repeated rows are scored alike and all stay or go;
an empty table gives no rows; columns besides those that are read don't matter, whatever their names, and `keep_good` keeps
them all.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_udf

BUCKETS = 1 << 17
WIDTH = 8
TRAIN_ROWS = 4000
EPOCHS = 5
RATE = 0.3
BATCH = 32
SEED = 7
THRESHOLD = 0.5
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(zlib.crc32(b"the same token again") % BUCKETS)
_CACHE = 300_000


def _grams(token: str) -> list[int]:
    marked = f"<{token}>"
    crc = zlib.crc32
    return [crc(marked[i : i + n].encode("utf-8", "replace"), n) % BUCKETS for n in (3, 4) for i in range(len(marked) - n + 1)]


def _token(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace"))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring tokens' pairs; a token that follows itself is one feature, whichever it is."""
    t = tokens.astype(np.uint64)
    return np.where(t[:-1] == t[1:], _AGAIN, ((t[:-1] * _PAIR) ^ t[1:]) * _PAIR >> np.uint64(64 - 17)).astype(np.int64)


def features(text: str | None, known: dict | None = None) -> np.ndarray:
    """Buckets of a text's features, with repetitions."""
    tokens = text.split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.int64)
    known = {} if known is None else known
    for t in tokens:
        if t not in known:
            known[t] = (_token(t), np.array([_token(t) % BUCKETS, *_grams(t)], dtype=np.int64))
    hashes = np.array([known[t][0] for t in tokens], dtype=np.uint64)
    return np.concatenate([*(known[t][1] for t in tokens), _pairs(hashes)])


class SubwordModel:
    """scores: for each bucket and class what the feature adds to the class's logit; bias: by class."""

    def __init__(self, scores: np.ndarray, bias: np.ndarray):
        self.scores, self.bias = scores, bias

    @staticmethod
    def train(texts: list[str | None], labels: list[int], classes: int = 2, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> "SubwordModel":
        rng, known = np.random.default_rng(seed), {}
        docs = []
        for text in texts:
            bucket, count = np.unique(features(text, known), return_counts=True)
            docs.append((bucket.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
        known.clear()
        y = np.asarray(labels)
        vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        layer = rng.normal(0, 1, (WIDTH, classes)).astype(np.float32)
        bias = np.log(np.bincount(y, minlength=classes) / len(y) + 1e-3).astype(np.float32)
        seen_v, seen_l = np.full((BUCKETS, 1), 1e-8, dtype=np.float32), np.full(layer.shape, 1e-8, dtype=np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                part = [i for i in order[k : k + BATCH] if len(docs[i][0])]
                if not part:
                    continue
                bucket, weight = np.concatenate([docs[i][0] for i in part]), np.concatenate([docs[i][1] for i in part])[:, None]
                sizes = np.array([len(docs[i][0]) for i in part])
                mean = np.add.reduceat(vectors[bucket] * weight, np.cumsum(sizes) - sizes, axis=0)
                p = mean @ layer + bias
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), y[part]] -= 1
                step_l, step_v = mean.T @ p, p @ layer.T
                own, where = np.unique(bucket, return_inverse=True)
                flow = np.repeat(step_v, sizes, axis=0) * weight
                grad = np.stack([np.bincount(where, flow[:, j], len(own)) for j in range(WIDTH)], axis=1).astype(np.float32)
                seen_v[own] += (grad**2).mean(axis=1, keepdims=True)
                vectors[own] -= rate * grad / np.sqrt(seen_v[own])
                seen_l += step_l**2
                layer -= rate * step_l / np.sqrt(seen_l)
                bias -= rate * 0.1 * p.mean(axis=0)
        return SubwordModel((vectors @ layer).astype(np.float32), bias)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return _Scorer(self)(texts)


class _Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, model: SubwordModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number, self.hash, self.count, self.sums = {}, [], [], []

    def learn(self, token: str) -> int:
        grams = _grams(token)
        value = _token(token)
        k = self.number[token] = len(self.hash)
        self.hash.append(value)
        self.count.append(1 + len(grams))
        self.fresh.append([value % BUCKETS, *grams])
        return k

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > _CACHE:
            self.clear()
        scores, number, self.fresh = self.model.scores, self.number, []
        split = [t.split() if t else [] for t in texts]
        get, learn = number.get, self.learn
        ids = np.array([k if (k := get(t)) is not None else learn(t) for s in split for t in s], dtype=np.int64)
        if self.fresh:
            sizes = np.array([len(x) for x in self.fresh])
            flat = np.fromiter((b for x in self.fresh for b in x), dtype=np.int64, count=int(sizes.sum()))
            self.sums.append(np.add.reduceat(scores[flat], np.cumsum(sizes) - sizes, axis=0))
            self.sums = [np.concatenate(self.sums)]
            self.arrays = np.array(self.hash, dtype=np.uint64), np.array(self.count, dtype=np.int64)
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        out = np.zeros((len(texts), len(self.model.bias)))
        some = np.flatnonzero(lengths)
        if len(some):
            starts = (np.cumsum(lengths) - lengths)[some]
            out[some] = np.add.reduceat(self.sums[0][ids], starts, axis=0, dtype=np.float64)
            n = np.add.reduceat(self.arrays[1][ids], starts) + lengths[some] - 1
            if len(ids) > 1:
                pair = np.zeros((len(ids), out.shape[1]), dtype=np.float32)
                pair[:-1] = scores[_pairs(self.arrays[0][ids])]
                pair[(starts + lengths[some] - 1)] = 0
                out[some] += np.add.reduceat(pair, starts, axis=0, dtype=np.float64)
            out[some] /= n[:, None]
        out += self.model.bias
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, seed: int = SEED) -> SubwordModel | None:
    """A model of the classes 0 and 1 from at most `train_rows` labelled rows; None where a class is missing."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null").groupBy("__id").agg(F.max("__y").alias("__y"))
    sample = bounded_sample(known, "__id", train_rows, seed)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id").where("__t is not null").dropDuplicates(["__id", "__t"]).toArrow().sort_by([("__id", "ascending"), ("__t", "ascending")])
    y = [int(v > 0) for v in rows["__y"].to_pylist()]
    return SubwordModel.train(rows["__t"].to_pylist(), y, seed=seed) if len(set(y)) == 2 else None


def quality_probability(docs: DataFrame, model: SubwordModel | None, text_col: str = "text"):
    """A column: the probability of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _Scorer(shared.value) if shared.value is not None else None

        def kernel(texts: list) -> pa.Array:
            if scorer is None:
                return pa.array([float(bool(t and t.split())) for t in texts], pa.float64())
            return pa.array(scorer(texts)[:, 1] if texts else [], pa.float64())

        return kernel

    return text_udf(make, "double")(F.col(text_col))


def _has_words(text_col: str):
    # what separates tokens here is what Python's split() takes for white space
    return F.coalesce(F.col(text_col).rlike(r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"), F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **training) -> DataFrame:
    """(id, quality_probability, keep) for every row."""
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col, **training)
    scored = docs.select(id_col, _has_words(text_col).alias("__words"), quality_probability(docs, model, text_col).alias("quality_probability"))
    return scored.select(id_col, "quality_probability", (F.col("__words") & (F.col("quality_probability") >= threshold)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **training) -> DataFrame:
    """The rows whose text reaches the threshold, all columns kept."""
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col, **training)
    return docs.where(_has_words(text_col)).where(quality_probability(docs, model, text_col) >= threshold)
