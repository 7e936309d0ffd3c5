"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of 64 bytes in both directions, gives every position a probability for each
language, and a document gets the mean over its positions with letters, whole text included. It is trained
here, in numpy, by backpropagation through time, on a bounded sample: at most ``docs_per_lang`` distinct
texts of each language (and ``max_docs`` of all languages), chosen by hash, and ``windows_per_doc`` windows of each,
spread over the text. These windows are the only data that reaches the driver, and the weights are a few thousand numbers.

A text that is null or has no letter is ``und`` with score 0. Rows without a language are predicted but
not learned from. With no row to learn from all is ``und``; with one language it is always that one.
Repeated rows get equal results. Only the text is an input of a prediction; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.bytetext import bytes_of, chunks
from strandline.plans.runtime import cut, join_small

WIDTH = 64
UND = "und"
_WEIGHT = np.array([float(chr(b).isalpha() if b < 128 else 1) for b in range(256)], np.float32)


class ByteGRU:
    """Both directions of the network; every position has a softmax over ``n_classes``."""

    def __init__(self, n_classes: int, hidden: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_classes = hidden, n_classes
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.weights[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.weights[f"v{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, n_classes)).astype(np.float32)
        self.weights["c"] = np.zeros(n_classes, np.float32)

    def _forward(self, x: np.ndarray, mask: np.ndarray, d: str) -> list[tuple]:
        n, w = self.hidden, self.weights
        h, out = np.zeros((x.shape[1], n), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, u = w[f"x{d}"][x[t]], h @ w[f"u{d}"]
            r, z = np.split(0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * n] + u[:, : 2 * n])), 2, axis=1)
            c = np.tanh(g[:, 2 * n :] + r * u[:, 2 * n :])
            new = (c + z * (h - c)) * mask[t][:, None]
            out[t] = (h, r, z, c, u[:, 2 * n :], new)
            h = new
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions of ``x`` (time, window) and its gradients by backpropagation through time."""
        n, w = self.hidden, self.weights
        runs = {d: self._forward(x, mask, d) for d in "fb"}
        states = {d: np.stack([s[5] for s in runs[d]]) for d in "fb"}
        logits = states["f"] @ w["vf"] + states["b"] @ w["vb"] + w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        total = mask.sum()
        picked = p[:, np.arange(len(y)), y]
        loss = float(-(np.log(picked + 1e-12) * mask).sum() / total)
        p[:, np.arange(len(y)), y] -= 1
        p *= (mask / total)[:, :, None]
        grads = {"c": p.sum(axis=(0, 1))}
        for d in "fb":
            grads[f"v{d}"] = np.einsum("tbh,tbc->hc", states[d], p)
            gu, gx = np.zeros_like(w[f"u{d}"]), np.zeros_like(w[f"x{d}"])
            dh = np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, r, z, c, un, _ = runs[d][t]
                dh = (dh + p[t] @ w[f"v{d}"].T) * mask[t][:, None]
                dc = dh * (1 - z) * (1 - c * c)
                dr, dz = dc * un * r * (1 - r), dh * (h - c) * z * (1 - z)
                np.add.at(gx, x[t], np.concatenate([dr, dz, dc], axis=1))
                du = np.concatenate([dr, dz, dc * r], axis=1)
                gu += h.T @ du
                dh = dh * z + du @ w[f"u{d}"].T
            grads[f"u{d}"], grads[f"x{d}"] = gu, gx
        return loss, grads

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 5) -> float:
        """Adam over shuffled batches of windows (window, time); the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses = 0, [0.0]
        for epoch in range(epochs):
            losses, order = [], rng.permutation(len(x))
            for a in range(0, len(x), batch):
                at = order[a : a + batch]
                loss, grads = self.gradients(x[at].T, mask[at].T, y[at])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] -= (rate * (1 - epoch / epochs) * move).astype(np.float32)
        return float(np.mean(losses))

    def positions(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, class, window) for windows of bytes (time, window).

        Windows are the last axis, so that every step works on whole contiguous rows.
        """
        n, w, size = self.hidden, self.weights, x.shape[1]
        out = np.empty((len(x), self.n_classes, size), np.float32)
        g, u, v = np.empty((3 * n, size), np.float32), np.empty((3 * n, size), np.float32), np.empty((self.n_classes, size), np.float32)
        gates, c, un = g[: 2 * n], g[2 * n :], u[2 * n :]
        # the gates' sigmoid is 0.5 + 0.5 tanh(x / 2); the inner half is put into the weights
        half = np.array([0.5] * (2 * n) + [1.0] * n, np.float32)
        for d in "fb":
            wx, wu, wv = (np.ascontiguousarray(y.T) for y in (w[f"x{d}"] * half, w[f"u{d}"] * half, w[f"v{d}"]))
            h = np.zeros((n, size), np.float32)
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                np.take(wx, x[t], axis=1, out=g, mode="clip")
                np.matmul(wu, h, out=u)
                gates += u[: 2 * n]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                un *= gates[:n]
                c += un
                np.tanh(c, out=c)
                h -= c
                h *= gates[n:]
                h += c
                if mask is not None:
                    h *= mask[t]
                np.matmul(wv, h, out=v)
                if d == "f":
                    out[t] = v
                else:
                    out[t] += v
        out += w["c"][:, None]
        np.exp(out, out=out)  # a bounded state keeps the logits small
        out /= out.sum(axis=1, keepdims=True)
        return out


def windows_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text in rows of WIDTH, and how many of each row count."""
    n = max(1, -(-len(raw) // WIDTH))
    out = np.zeros(n * WIDTH, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WIDTH), np.minimum(len(raw) - np.arange(n) * WIDTH, WIDTH)


def train(sample: list[tuple[str, bytes]], hidden: int = 8, epochs: int = 8, min_steps: int = 300, batch: int = 128) -> tuple[list[str], ByteGRU | None]:
    """Languages and network from (language, window) pairs; a small sample is gone over more often."""
    langs = sorted({lang for lang, _ in sample})
    if len(langs) < 2:
        return langs, None
    xs, ns, ys = [], [], []
    for lang, window in sorted(sample):
        x, n = windows_of(np.frombuffer(window, np.uint8))
        xs.append(x[0]), ns.append(n[0]), ys.append(langs.index(lang))
    mask = (np.arange(WIDTH) < np.array(ns)[:, None]).astype(np.float32)
    net = ByteGRU(len(langs), hidden)
    net.fit(np.stack(xs), mask, np.array(ys), max(epochs, -(-min_steps * batch // len(xs)) if epochs > 1 else 1), batch)
    return langs, net


def training_windows(docs: DataFrame, docs_per_lang: int, windows_per_doc: int, max_docs: int) -> list[tuple[str, bytes]]:
    """(lang, window) of at most ``docs_per_lang`` distinct texts of each language, by hash; ``max_docs`` texts in all.

    Windows are cut on Spark, so that no text reaches the driver. Copies count once: a range of hashes that holds
    some three times the texts wanted, by an estimate of the distinct ones, is grouped by hash before it is ranked.
    """
    rows = docs.filter("lang is not null and text rlike '\\\\p{L}'").select("lang", F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("raw"))
    n = F.octet_length("raw")
    step = F.when(n > WIDTH, F.greatest(F.lit(1), ((n - WIDTH) / max(1, windows_per_doc - 1)).cast("int"))).otherwise(0)
    places = F.sequence(F.lit(0), F.least(F.lit(windows_per_doc), F.ceil(n / WIDTH).cast("int")) - 1)
    cut_out = rows.select("lang", "h", F.transform(places, lambda k: F.substr("raw", k * step + 1, F.lit(WIDTH))).alias("windows"))
    counts = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    wanted = min(docs_per_lang, max(1, max_docs // max(1, counts.count())))
    share = 3.0 * wanted / F.greatest("n", F.lit(1)) + 0.001
    near = join_small(cut_out, counts, ["lang"]).filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    distinct = near.groupBy("lang", "h").agg(F.first("windows").alias("windows"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    kept = distinct.withColumn("k", nth).filter(F.col("k") <= wanted)
    return [(r["lang"], bytes(r["w"])) for r in kept.select("lang", F.explode("windows").alias("w")).collect()]


def _pooled(net: ByteGRU, data: np.ndarray, offsets: np.ndarray, block: int = 4096) -> np.ndarray:
    """Mean probabilities (document, class) over the positions with letters."""
    sizes = np.diff(offsets)
    total = np.zeros((len(sizes), net.n_classes))
    weight = np.zeros(len(sizes))

    def add(starts: np.ndarray, owner: np.ndarray, lens: np.ndarray | None) -> None:
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        for a in range(0, len(starts), block):
            at = starts[a : a + block]
            x = np.ascontiguousarray(padded[at[:, None] + np.arange(WIDTH)].T)
            mask = None if lens is None else (np.arange(WIDTH)[:, None] < lens[a : a + block]).astype(np.float32)
            w = _WEIGHT[x] if mask is None else _WEIGHT[x] * mask
            p = net.positions(x, mask)
            sums = (w[:, None] * p).sum(axis=0)
            own = owner[a : a + block]
            for c in range(net.n_classes):
                total[:, c] += np.bincount(own, sums[c], len(sizes))
            np.add(weight, np.bincount(own, w.sum(axis=0), len(sizes)), out=weight)

    full = sizes // WIDTH
    owner = np.repeat(np.arange(len(sizes)), full)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    add(offsets[:-1][owner] + within * WIDTH, owner, None)
    rest = np.flatnonzero(sizes % WIDTH)
    add(offsets[rest] + full[rest] * WIDTH, rest, (sizes % WIDTH)[rest])
    return total / np.maximum(weight, 1e-9)[:, None]


def identify(
    docs: DataFrame,
    learn_from: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    docs_per_lang: int = 400,
    windows_per_doc: int = 4,
    max_docs: int = 100_000,
    hidden: int = 8,
    epochs: int = 8,
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with lang_pred and score.

    The network learns from rows where ``learn_from`` holds, from text and language alone.
    """
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    labelled = docs.filter(learn_from).select(text, F.col(f"`{lang_col}`").cast("string").alias("lang"))
    langs, net = train(training_windows(labelled, docs_per_lang, windows_per_doc, max_docs), hidden, epochs)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                lettered = [any(map(str.isalpha, t or "")) for t in batch.column("text").to_pylist()]
                if net is None:
                    pred = [langs[0] if ok and langs else UND for ok in lettered]
                    score = [float(ok and bool(langs)) for ok in lettered]
                else:
                    p = _pooled(net, *bytes_of(batch.column("text")))
                    pred = [langs[k] if ok else UND for k, ok in zip(p.argmax(axis=1).tolist(), lettered, strict=True)]
                    score = [min(1.0, s) if ok else 0.0 for s, ok in zip(p.max(axis=1).tolist(), lettered, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"]
                )

    names = list(keep)
    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "lang_pred string", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], text).mapInArrow(run, fields)
