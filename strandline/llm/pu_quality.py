"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Only texts that are known to be good are trusted; all other text is unlabelled, good and bad mixed. A small network f with loss l is fitted to

    prior * E_good[l(f)] + max(0, E_any[l(-f)] - prior * E_good[l(-f)])

whose second term is an unbiased estimate of the risk on bad texts: it cannot be negative, so where it becomes so on the sample, steps go against it. The
share of good texts (``prior``) is estimated first: a plain classifier of good against any, fitted on one half of the sample, orders the other half, and
the least ratio of the shares of any and good texts above a score, with a confidence bound, is the share of good ones among all (best bin estimation).

The network sees what any text has, whatever its language: shares of classes of characters, triples of them with runs as one, repeated words, word
triples and lines, lengths. It is trained in numpy on the driver on a bounded sample: ``max_good`` trusted texts and ``max_any`` of all texts that
may be learned from, drawn by hash of their ids; so many feature rows (1.2 kB each) are all that reaches the driver. Every text is scored in whole.

Nulls in the label count as no label; an id with several labels is trusted if all of them are 1. Null ids and ids without document are
not learned from. A text without words (null, empty, blank) has score 0. With no trusted text, or no text to learn from, every other text has score 0.5.
Repeated rows get equal scores. An empty table gives an empty result. Other columns than id and text are inputs of nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.bytetext import bytes_of, chunks, hash_of, mix, prefix_hash, words
from strandline.plans.runtime import cut, discard, join_small

#: Classes of bytes, by the characters in them; bytes of letters beyond ASCII are a class of their own, the rest is the last one.
CLASSES = (" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, ".", ",", "!", "?", "|", "#$%&*@^~", "'\"-", "()[]{}<>", ":;=/\\_+")
N_CLASSES, TRIPLES, WINDOW = len(CLASSES) + 1, 256, 64
N_WORDS = 8
N_FEATURES = N_CLASSES + TRIPLES + N_WORDS

_CLASS = np.full(256, N_CLASSES - 1, np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[[*_chars.encode()] if _chars else slice(128, 256)] = _i


def _shares(values: np.ndarray, owner: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """How often each document has each kind, as shares."""
    counts = np.bincount(owner * kinds + values, minlength=n * kinds).reshape(n, kinds)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _again(key: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The number of items of each owner that equal another one before it."""
    key = mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    return np.bincount(owner[order[1:]][key[1:] == key[:-1]], minlength=n)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each text, and its number of words."""
    n = len(texts)
    data, offsets = bytes_of(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
    runs, of = kind[first], owner[first]
    code = (runs[:-2] * N_CLASSES + runs[1:-1]) * N_CLASSES + runs[2:]
    inside = of[:-2] == of[2:]
    bucket = (mix(code[inside].astype(np.uint64)) % np.uint64(TRIPLES)).astype(np.int64)

    starts, ends, at = words(data, offsets)
    prefix = prefix_hash(data, True)
    h, whose = hash_of(prefix, starts, ends), np.repeat(np.arange(n), np.diff(at))
    count = np.diff(at)
    some = np.maximum(count, 1)
    place = np.arange(len(h)) - at[:-1][whose]
    window = whose * (int(count.max(initial=0)) // WINDOW + 1) + place // WINDOW
    begins = np.ones(len(h), bool)
    begins[1:] = window[1:] != window[:-1]
    near = np.bincount(whose[begins], _again(h, np.cumsum(begins) - 1, int(begins.sum())), n)
    triple = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
    full = whose[:-2] == whose[2:]
    next_to = np.bincount(whose[1:][(h[1:] == h[:-1]) & (whose[1:] == whose[:-1])], minlength=n)
    edge = np.flatnonzero(data == 10)
    line_starts, line_ends = np.sort(np.concatenate([offsets[:-1], edge + 1])), np.sort(np.concatenate([edge, offsets[1:]]))
    line_owner = np.clip(np.searchsorted(offsets, line_starts, "right") - 1, 0, max(n - 1, 0))
    solid = (line_ends > line_starts) & (line_starts < len(data))
    line_starts, line_ends, line_owner = line_starts[solid], line_ends[solid], line_owner[solid]
    lines = np.bincount(line_owner, minlength=n)
    letters = (ends - starts).astype(float)
    rows = [
        np.log1p(count),
        np.bincount(whose, letters, n) / some,
        np.sqrt(np.maximum(0, np.bincount(whose, letters**2, n) / some - (np.bincount(whose, letters, n) / some) ** 2)),
        near / some,
        next_to / some,
        _again(mix(triple[full]), whose[:-2][full], n) / some,
        _again(hash_of(prefix, line_starts, line_ends), line_owner, n) / np.maximum(lines, 1),
        np.log1p(count / np.maximum(lines, 1)),
    ]
    return np.hstack([_shares(kind, owner, n, N_CLASSES), _shares(bucket, of[:-2][inside], n, TRIPLES), np.stack(rows, axis=1)]).astype(np.float32), count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """One hidden layer on standardised features; ``margin`` is positive for good texts."""

    def __init__(self, x: np.ndarray, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        self.weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.weights = [w.astype(np.float32) for w in self.weights]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(self.inputs(x) @ a + b) @ c + d

    def fit(self, x: np.ndarray, slopes: Callable[[np.ndarray], np.ndarray], steps: int, rate: float = 0.01, decay: float = 2e-3) -> None:
        """Adam steps along ``slopes``, the derivatives of the risk by the margins of all rows."""
        x = self.inputs(x)
        m, v = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        for t in range(1, steps + 1):
            a, b, c, d = self.weights
            hidden = np.tanh(x @ a + b)
            g = slopes(hidden @ c + d).astype(np.float32)
            back = g[:, None] * c * (1 - hidden**2)
            grads = [x.T @ back + decay * a, back.sum(axis=0), hidden.T @ g + decay * c, np.array([g.sum()])]
            for k, grad in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                self.weights[k] = (self.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def non_negative_slopes(good: np.ndarray, prior: float) -> Callable[[np.ndarray], np.ndarray]:
    """Derivatives of the non-negative risk with the logistic loss; ``good`` marks the trusted rows, the others are any."""
    n_good, n_any = max(1, good.sum()), max(1, (~good).sum())

    def slopes(f: np.ndarray) -> np.ndarray:
        against = np.logaddexp(0, f)  # the loss of a good margin if the row is bad
        bad_risk = against[~good].mean() - prior * against[good].mean()
        p = _sigmoid(f)
        bad = np.where(good, -prior * p / n_good, p / n_any)
        if bad_risk < 0:
            return -bad
        return np.where(good, -prior * (1 - p) / n_good, 0.0) + bad

    return slopes


def class_prior(x: np.ndarray, good: np.ndarray, steps: int = 150, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of good rows among the others, by best bin estimation on a held-out half."""
    half = np.arange(len(x)) % 2 == 0
    net, own = Network(x[half]), good[half]
    weight = np.where(own, 0.5 / max(1, own.sum()), 0.5 / max(1, (~own).sum()))
    net.fit(x[half], lambda f: weight * (_sigmoid(f) - own), steps)
    f, rest = net.margin(x[~half]), good[~half]
    a, b = np.sort(f[rest]), np.sort(f[~rest])
    if not len(a) or not len(b):
        return 0.5
    above_good = 1 - np.searchsorted(a, a, "left") / len(a)
    above_any = 1 - np.searchsorted(b, a, "left") / len(b)
    room = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(a))) + np.sqrt(np.log(4 / delta) / (2 * len(b))))
    best = ((above_any + room) / above_good).argmin()
    return float(min(max(above_any[best] / above_good[best], 0.01), 0.99))


def train(x: np.ndarray, good: np.ndarray, steps: int = 300) -> tuple[Network, float] | None:
    """The network and the estimated prior; none if there is nothing trusted, or nothing else."""
    if not good.any() or good.all():
        return None
    prior = class_prior(x, good)
    net = Network(x)
    net.fit(x, non_negative_slopes(good, prior), steps)
    return net, prior


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Callable[[Column], Column], max_good: int, max_any: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sample and which of them are trusted. Ids are drawn first, so texts are read once and never shuffled."""

    def first(ids: DataFrame, n: int) -> DataFrame:
        return ids.filter(F.col("id").isNotNull() & learn_from(F.col("id"))).distinct().orderBy(F.xxhash64("id"), "id").limit(n)

    trusted = labels.filter("label is not null").groupBy("id").agg(F.min("label").alias("least")).filter("least = 1").select("id")
    drawn = first(trusted, max_good).withColumn("good", F.lit(True)).unionByName(first(docs.select("id"), max_any).withColumn("good", F.lit(False)))
    wanted = cut(drawn.groupBy("id").agg(F.collect_set("good").alias("as")), "drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                x, count = features(part.column("text"))
                rows = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("as"), rows, pa.array(count > 0)], names=["id", "as", "x", "worded"])

    rows = join_small(docs, wanted, ["id"], "inner", max_rows=max_good + max_any).select("id", "as", "text")
    measured = rows.mapInArrow(run, "id long, as array<boolean>, x binary, worded boolean").filter("worded")
    sample = measured.select("id", F.explode("as").alias("good"), "x")
    # an id may have many documents: the bounds hold for rows, too
    parts = [sample.filter(F.col("good") == good).orderBy(F.xxhash64("id", "x"), "x").limit(n).select("good", "x") for good, n in ((True, max_good), (False, max_any))]
    found = parts[0].unionByName(parts[1]).collect()
    discard(wanted)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, N_FEATURES), np.float32)
    return x, np.array([r["good"] for r in found], bool)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: list[str] | None = None,
    max_good: int = 3000,
    max_any: int = 6000,
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with score and predicted (1 if score >= 0.5).

    ``labels`` has the ids and labels of some documents; ``learn_from`` says of an id whether its row may be learned from.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    fitted = train(*training_rows(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text), known, learn_from, max_good, max_any))
    keep = keep or []
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "__text"):
                x, count = features(batch.column("__text"))
                score = _sigmoid(fitted[0].margin(x).astype(float)) if fitted else np.full(len(x), 0.5)
                score = np.where(count > 0, score, 0.0)
                columns = [*[batch.column(i) for i in range(len(keep))], pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "score double", "predicted int"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text")).mapInArrow(run, fields)
